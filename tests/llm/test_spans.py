import random

from kinloom.llm import spans


def test_any_fifty_common_words_share_a_span(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9)))
    text = lambda n: [word() for _ in range(n)]
    docs = []
    for i in range(3000):
        passage = text(50)
        for k in (0, 1):
            words = text(r.randrange(60)) + passage + text(r.randrange(60))
            docs.append((2 * i + k, "".join(w + (r.choice(" \n") if k else " ") for w in words)))
    out = {x.doc_id: x for x in spans.dedup(spark.createDataFrame(docs, "doc_id long, text string"), ["doc_id"]).collect()}
    assert all(out[i].n_removed_words == 0 for i in range(0, 6000, 2))
    assert all(14 <= out[i].n_removed_words <= 50 for i in range(1, 6000, 2))
