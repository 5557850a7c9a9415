import numpy as np
import pytest
from pyspark.sql import functions as F

from kinloom.llm import lm, tokens

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \n"), (4, "a"), (5, "naïve 日本 text"), (5, "naïve 日本 text"), (None, "b c")]


def test_op5_scores_rare_words(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    a, b = (spark.createDataFrame([(i, f"we saw the {w} again")], "doc_id long, text string") for i, w in ((-1, "qzvkxj"), (-2, "wbngty")))
    docs.unionByName(a).unionByName(b).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in lm.op5_lm_scoring(spark, str(tmp_path)).collect()}
    assert len(out) == docs.count() + 2
    assert out[-1].sum_logprob != out[-2].sum_logprob  # other words of one form
    text = docs.filter("doc_id = 3").first().text
    assert out[3].n_tokens == len(tokens.encode(text, tokens.default_vocab()))


def test_network_learns_and_is_normalized(spark):
    ids = lm.encoded(spark.read.parquet(f"{SF}/documents.parquet")).cache()
    texts = [r.ids for r in ids.collect()]
    code, n = np.unique(lm.triples(texts)[0], return_counts=True)
    counts = lm.counts_of(ids)
    assert counts.sum() == n.sum() == sum(len(t) // 2 for t in texts)
    loss = lambda net: -(net.log_probs(code) * n).sum() / n.sum()
    start, net = lm.Network(counts), lm.learn(ids)
    assert loss(net) < loss(start) - 0.3
    every = np.arange(lm.VOCAB)
    for left, right in ((lm.END, 5), (262, 300)):
        assert np.exp(net.log_probs((left * lm.SIDE + every) * lm.SIDE + right)).sum() == pytest.approx(1, abs=1e-3)
    first = np.frombuffer(texts[0], "<u2").astype(int)
    around = [lm.END, *first, lm.END]
    want = net.log_probs(np.array([(around[i] * lm.SIDE + around[i + 1]) * lm.SIDE + around[i + 2] for i in range(len(first))])).sum()
    row = lm.score_ids(ids, net).filter(F.col("doc_id") == ids.first().doc_id).first()
    assert row.sum_logprob == pytest.approx(want, rel=1e-4) and row.mean_logprob == pytest.approx(want / len(first), rel=1e-4)
    print("loss", loss(start), loss(net))


def test_cases(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    out = lm.score(docs).collect()
    assert len(out) == len(ODD)
    assert all((r.mean_logprob is None) == (r.n_tokens == 0) and np.isfinite(r.sum_logprob) for r in out)
    assert [r.n_tokens for r in out if r.doc_id in (1, 2)] == [0, 0]
    assert lm.score(docs.filter("false")).isEmpty()
