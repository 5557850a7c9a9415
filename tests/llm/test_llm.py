import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from hashlib import md5
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinloom.llm import embeddings, feistel, langid, materialize, minhash, packing, pieces, quality, registry, sharding, spans, tokens
from kinloom.llm.common import scratch_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "word"), (5, "a b c d e f g " * 30), (5, "a b c d e f g " * 30), (None, "no id here, but some text"), (None, None), (6, "x" * 70_000), (7, "日本語 ünï 😀 \x00 ▁ <|endoftext|>"), (8, "$%&#"), (9, "12 34"), (10, "½ ² ①")]
CLASHES = ("shard", "slot", "kept", "h", "a", "b", "key", "rep", "ids", "number", "score", "lang_pred", "n_words", "anomaly", "base_failed", "n_sentences", "removed", "row", "__text", "__text_", "__id")


def frame(spark, rows, extra=True):
    """Documents with columns whose names clash with those that the operators make."""
    df = spark.createDataFrame([(i, t, "en", "s", len(t) if t else 0) for i, t in rows], DOCS)
    return df.withColumns({c: F.lit("x") for c in CLASHES}) if extra else df


def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- sharding --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 1001])
def test_feistel_is_a_permutation(spark, n):
    x = spark.range(n).select("id", F.lit(n).cast("long").alias("n"))
    rows = x.select("id", feistel.permute(F.col("id"), F.col("n"), 9).alias("p"), F.col("n")).withColumn("q", feistel.permute(F.col("p"), F.col("n"), 9, back=True)).collect()
    assert sorted(r.p for r in rows) == list(range(n)) and all(r.q == r.id for r in rows)
    assert all(feistel.permute_int(r.id, n, 9) == r.p for r in rows)
    assert feistel.permute_array(np.arange(n), n, 9).tolist() == [feistel.permute_int(i, n, 9) for i in range(n)]


def test_shards(spark):
    rows = ODD + [(100 + i, f"t{i}") for i in range(50)] + [(77, "same")] * 2500
    out = sharding.shard(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    again = sharding.shard(frame(spark, rows[::-1]).repartition(7)).collect()
    pick = lambda rs: Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in rs)
    assert pick(out) == pick(again)  # whatever the order and the partitions
    assert sharding.shard(empty(spark)).isEmpty()


def test_shard_and_slot_are_computable(spark):
    n = 100
    x = spark.range(n).select("id", F.lit(n).cast("long").alias("n"))
    s, t = sharding.place(F.col("id"), F.col("n"), 8, 3)
    back = x.select("id", "n", s.alias("s"), t.alias("t")).select("id", sharding.number(F.col("s"), F.col("t"), F.col("n"), 8, 3).alias("back"))
    assert all(r.id == r.back for r in back.collect())


# --- quality ---------------------------------------------------------------------------------------------------------


def brute_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams, covered = Counter(zip(w, w[1:], w[2:], strict=False)), set()
    for i in range(len(w) - 2):
        if grams[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)]


def test_rule_counts(spark):
    rows = [t for _, t in ODD] + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + ["a\x0bb\x85c d\xa0e\n\n a\na\na"]
    assert all(quality.rule_counts(t)[:5] == brute_counts(t) for t in rows)


def test_forest_tells_junk(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    forest = quality.learn(docs, labels.filter("doc_id % 2 = 0"))
    got = quality.judge(docs, forest).join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("NOT base_failed").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.97 and got[got.quality == 0].kept.mean() < 0.1


def test_quality_cases(spark):
    labels = spark.createDataFrame([(5, 1), (5, 0), (None, 1), (9, None)], "doc_id long, quality int")
    out = quality.judge(frame(spark, ODD), quality.learn(frame(spark, ODD), labels)).collect()
    assert len(out) == len(ODD) and not any(r.kept for r in out)  # all too short or repetitive
    assert quality.judge(empty(spark), quality.Forest([], 1.0, 1.0)).isEmpty()
    long = frame(spark, [(1, " ".join(f"w{i}" for i in range(60)))])
    assert quality.judge(long, quality.learn(empty(spark), labels)).first().kept  # no forest: the base rules alone
    clash = quality.judge(long, quality.Forest([], 1.0, 1.0), carry=["doc_id", "kept", "__text", "anomaly"])
    assert clash.columns == ["doc_id", "__text", *quality.COUNTS, "base_failed", "kept", "anomaly"] and clash.first().kept is True


def test_labelled_rows_that_repeat(spark):
    r = random.Random(8)
    docs = [(i, " ".join(make_words(r, 80))) for i in range(20)] + [(1, " ".join(make_words(r, 90)))] * 500  # one id with many rows
    labels = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    forest = quality.learn(frame(spark, docs), labels)
    assert len(forest.trees) == quality.TREES
    ties = quality.judge(frame(spark, docs), forest).filter("doc_id = 1 AND n_words = 90").select("anomaly", "kept").distinct().collect()
    assert len(ties) == 1  # equal rows, equal verdicts
    assert quality.repeat_words(np.arange(3_000_000)) == 0  # three numbers of 22 bits
    assert quality.repeat_words(np.concatenate([np.arange(3_000_000), [5, 6, 7]])) == 6


# --- sentencepiece ---------------------------------------------------------------------------------------------------


def test_pieces_are_the_librarys(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    r = random.Random(4)
    rows = ODD + [(1000 + i, "".join(r.choice("ab the\n▁é中x  ") for _ in range(r.randrange(400)))) for i in range(60)] + [(2000, "y" * 500 + " " * 300 + "z")]
    rows += [(x.doc_id, x.text) for x in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = pieces.decode(pieces.encode(frame(spark, rows))).collect()
    want = Counter((i, None if t is None else tuple(sp.encode(t)), None if t is None else t.replace("▁", " ")) for i, t in rows)
    assert Counter((x.doc_id, None if x.ids is None else tuple(x.ids), x.text) for x in out) == want
    assert pieces.encode(empty(spark)).isEmpty()


def test_the_fold_spells_words_like_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    p = pieces.pieces(pieces.default_model())
    assert len(p.late) < 10
    r = random.Random(9)
    words = {w for x in spark.read.parquet(f"{SF}/documents.parquet").collect() for w in pieces.split_words(x.text)}
    words |= {"".join(r.choice("abcdeinorst▁日é😀\x00") for _ in range(r.randrange(1, 20))) for _ in range(3000)}
    words = sorted(w for w in words if not any(x in w for x in p.late))
    table = spark.createDataFrame([(x, rank, i) for x, (rank, i) in p.table.items()], "piece string, rank int, id int")
    got = {x.word: x.ids for x in pieces.spell(spark.createDataFrame([(w,) for w in [*words, words[0], ""]], "word string"), table, p.longest, p.byte_ids).collect()}
    assert sorted(got) == words
    mine = dict(zip(words, pieces.word_ids(words, p), strict=True))
    assert all(np.array(got[w], "<i4").tobytes() == mine[w] for w in words)
    whole = [w for w in words if w[0] == "▁" and "▁" not in w[1:]]
    assert len(whole) > 1000 and all(sp.encode(w[1:]) == got[w] for w in whole if w != "▁")


def test_dictionary_is_bounded(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").coalesce(1)
    count = Counter(w for x in docs.collect() for w in pieces.split_words(x.text))
    assert {x.word: x.n for x in pieces.word_counts(docs.coalesce(1)).collect()} == {w: n for w, n in count.items() if n > 1}
    got = {x.word for x in pieces.dictionary(docs, most=300).collect()}
    assert 200 < len(got) <= 300
    assert min(count[w] for w in got) >= max(n for w, n in count.items() if w not in got)
    assert pieces.dictionary(empty(spark)).isEmpty()


def test_viterbi_against_all_paths(spark):
    table = {"a": -1.0, "b": -1.3, "ab": -1.9, "ba": -2.0, "aba": -2.7, "bb": -3.0}

    def best(w):
        if not w:
            return 0.0
        return max((table[w[:k]] if w[:k] in table else -1e6) + best(w[k:]) for k in range(1, 4) if len(w) >= k and (w[:k] in table or k == 1))

    words = ["".join(x) for n in range(1, 7) for x in np.array(np.meshgrid(*[list("abz")] * n)).T.reshape(-1, n)][:300]
    got = pieces.viterbi_words(spark.createDataFrame([(w,) for w in [*words, "", None]], "word string"), spark.createDataFrame(list(table.items()), "piece string, score double"), 3).collect()
    assert len(got) == len(set(words))
    assert all("".join(r.pieces) == r.word and r.score == pytest.approx(best(r.word)) for r in got)


# --- packing and training order --------------------------------------------------------------------------------------


def check_pieces(rows, docs):
    """Every id in exactly one piece, offsets without gaps, little padding."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[(r.doc_id, r.doc_tokens)].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    padded = 0
    for seq in by_seq.values():
        at = 0
        for o, n in sorted(seq):
            assert o == at
            at += n
        assert at <= 1024
        padded += 0 if at & (at - 1) == 0 else 1024 - at
    total = sum(len(tokens.encode(t, tokens.default_vocab())) + 1 for _, t in docs)
    assert sum(r.length for r in rows) == total
    assert padded <= 0.03 * total


def test_cuts():
    for n in range(1, 3000):
        parts = packing.cuts(n)
        assert sum(parts) == n and all(1024 - 1024 // x * x <= 32 for x in parts)
        assert sum(packing.digits(n)) == n


def test_packing(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokens.default_vocab())
    docs = ODD + [(x.doc_id + 10_000, x.text) for x in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = packing.pack(frame(spark, docs).repartition(3), with_ids=True).collect()
    check_pieces(rows, docs)
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for doc, text in docs:
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 0]
        mine = sorted((r for r in by[doc] if r.doc_tokens == len(ids)), key=lambda r: r.start)
        if docs.count((doc, text)) == 1:
            assert np.frombuffer(b"".join(r.ids for r in mine), "<u4").tolist() == ids
        assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in mine)
    assert Counter(x for r in rows for x in np.frombuffer(r.ids, "<u4").tolist()) == Counter(x for _, t in docs for x in [*own.encode(t or "", add_special_tokens=False).ids, 0])
    assert len(rows) < 3 * len(docs) + sum(r.length == 1024 for r in rows)
    assert packing.pack(empty(spark)).isEmpty()
    with pytest.raises(ValueError, match="power of two"):
        packing.pack(empty(spark), capacity=1000)


def test_training_order_round_trip(spark):
    docs = frame(spark, ODD * 40)
    root = scratch_path(spark, "shards")
    out = materialize.write(docs, root, shard=50, length=256)
    whole = {f.name: f.read_bytes() for f in Path(root.removeprefix("file://")).iterdir() if f.is_file() and not f.name.startswith(".")}
    assert out.limit(1).count() == 1 and out.count() == out.count()
    rows = out.collect()
    n = len(rows)
    assert len(whole) == -(-n // 50) + 1 == len({r.file for r in rows}) + 1
    assert whole == {f.name: f.read_bytes() for f in Path(root.removeprefix("file://")).iterdir() if f.is_file() and not f.name.startswith(".")}
    seqs = dict(materialize.read(root))
    assert sorted(r.slot for r in rows) == sorted(seqs) == list(range(n))
    assert all(zlib.crc32(seqs[r.slot][: r.n_tokens].astype("<u4").tobytes()) == r.ids_crc32 and r.shard == r.slot // 50 and r.position == r.slot % 50 for r in rows)
    used = Counter(np.concatenate([seqs[r.slot][: r.n_tokens] for r in rows]).tolist())
    want = Counter(int(x) for _, t in ODD * 40 for x in [*tokens.encode(t, tokens.default_vocab()), 0])
    assert used == want
    assert [k for k, _ in materialize.read(root, n - 3)] == [n - 3, n - 2, n - 1]  # resumed
    with pytest.raises(FileExistsError):
        materialize.write(docs, root)
    assert materialize.write(empty(spark), scratch_path(spark, "shards")).isEmpty()


def test_slots_are_the_permutation(spark):
    docs = [(i, f"{i} " * 40) for i in range(30)]
    root, seed = scratch_path(spark, "shards"), 5
    rows = materialize.write(frame(spark, docs).coalesce(1), root, shard=8, length=16, seed=seed).collect()
    stream = np.array([x for _, t in docs for x in [*tokens.encode(t, tokens.default_vocab()), 0]])
    n = -(-len(stream) // 16)
    assert len(rows) == n
    seqs = dict(materialize.read(root))
    for x in range(n):  # sequence x of the stream lies in slot permute(x)
        part = stream[16 * x : 16 * x + 16]
        assert seqs[feistel.permute_int(x, n, seed)][: len(part)].tolist() == part.tolist()


def test_an_unfinished_corpus_has_no_meta(spark, monkeypatch):
    root = scratch_path(spark, "shards")
    monkeypatch.setattr(materialize, "SCHEMA", "wrong int")
    with pytest.raises(Exception):  # noqa: B017
        materialize.write(frame(spark, ODD), root, length=256)
    assert not Path(root.removeprefix("file://"), "meta.json").exists()


# --- language models -------------------------------------------------------------------------------------------------


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs, langid.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.98 and got.score.between(0, 1).all()
    assert (got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5) == 0).all()


def test_code_lengths_are_those_of_the_trees():
    texts = {"x": ["abab abba", "ab"], "y": ["bcbc"]}
    model = langid.fit(texts)
    symbol = {c: int(model.index[ord(c)]) for c in "abc q"}

    def cost(lang, context, s):
        grams = []
        for t in texts[lang]:
            seq = [0, 0, 0, *(symbol[c] for c in t)]
            grams += [tuple(seq[i - 3 : i + 1]) for i in range(3, len(seq))]
        counts = Counter(g[-1] for g in grams if not context or g[-1 - len(context) : -1] == context)
        total, distinct = sum(counts.values()), len(counts)
        lower = 1 / model.size if not context else cost(lang, context[1:], s)
        if not total:
            return lower
        return counts[s] / (total + distinct) if counts[s] else distinct / (total + distinct) * lower

    for text in ("abba c", "qqa"):
        for k, lang in enumerate(model.langs):
            seq = [0, 0, 0, *(symbol[c] for c in text)]
            want = -sum(np.log2(cost(lang, tuple(seq[i - 3 : i]), seq[i])) for i in range(3, len(seq)))
            assert model.lengths([text])[0, k] == pytest.approx(want, rel=1e-5)
    long = "abba c" * 5000
    whole = model.lengths([long, "a"])
    langid_chunk, langid.CHUNK = langid.CHUNK, 777
    try:
        assert np.allclose(whole, model.lengths([long, "a"]))
    finally:
        langid.CHUNK = langid_chunk


def test_language_id_cases(spark):
    docs = frame(spark, ODD)
    out = langid.identify(docs, langid.learn(docs)).collect()
    assert len(out) == len(ODD)
    text = dict(zip([i for i, _ in ODD], [t for _, t in ODD], strict=True))
    for r in out:
        t = text.get(r.doc_id)
        if r.doc_id is not None:
            assert (r.lang_pred == "und") == (not any(unicodedata.category(c)[0] == "L" for c in t or ""))
    assert all(r.lang_pred == "und" for r in langid.identify(docs, langid.learn(empty(spark))).collect())
    assert langid.identify(empty(spark), langid.learn(docs)).isEmpty()
    clash = langid.identify(docs, langid.learn(docs), carry=["doc_id", "score", "__text", "lang_pred"])
    assert clash.columns == ["doc_id", "__text", "lang_pred", "score"] and clash.filter("lang_pred = 'und'").count() == 7


def test_language_models_are_bounded(spark, monkeypatch):
    r = random.Random(6)
    texts = {f"l{k}": ["".join(chr(r.randrange(0x100 + 300 * k, 0x200 + 300 * k)) for _ in range(3000)) for _ in range(4)] for k in range(3)}
    whole, small = langid.fit(texts), langid.fit(texts, 1 << 18)
    assert small.cost.nbytes <= 1 << 18 < whole.cost.nbytes
    for k, x in enumerate(small.langs):
        assert small.lengths(texts[x]).argmin(1).tolist() == [k] * 4
    docs = spark.createDataFrame([(i, f"{i} " + "ab cd " * 50, f"l{i % 3}") for i in range(300)], "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "BYTES", 4000)
    got = langid.sample(docs)
    assert set(got) == {"l0", "l1", "l2"} and all(0 < sum(map(len, v)) <= 4000 // 3 for v in got.values())


# --- duplicates ------------------------------------------------------------------------------------------------------


def make_words(r, n):
    return ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(n)]


def test_spans(spark):
    r = random.Random(1)
    passage = " ".join(make_words(r, 60))
    docs = [(i, " ".join(make_words(r, 50)) + (" " + passage + " " if i % 3 == 0 else " ") + " ".join(make_words(r, 50))) for i in range(12)]
    out = {x.doc_id: x for x in spans.dedup(frame(spark, docs).repartition(4), ["doc_id"]).collect()}
    text = dict(docs)
    assert passage in out[0].text and out[0].text == text[0]
    for i in range(1, 12):
        if i % 3:
            assert out[i].text == text[i] and out[i].n_removed_words == 0
        else:
            assert 40 <= out[i].n_removed_words <= 60
            assert set(out[i].text.split()) | set(passage.split()) == set(text[i].split())
    copies = [(i, docs[1][1]) for i in range(5)]
    kept = {x.doc_id: x for x in spans.dedup(frame(spark, copies), ["doc_id"]).collect()}
    assert kept[0].text == docs[1][1] and all(len(kept[i].text.split()) < 40 for i in range(1, 5))


def test_span_cases(spark):
    out = spans.dedup(frame(spark, ODD), ["doc_id"]).collect()
    got = Counter((x.doc_id, x.text) for x in out)
    assert len(out) == len(ODD) and all(got[(i, t)] for i, t in ODD if i not in (5,))
    fives = [x for x in out if x.doc_id == 5]
    assert len(fives) == 2 and fives[0].text == fives[1].text  # rows of one id are one document
    assert spans.dedup(empty(spark), ["doc_id"]).isEmpty()
    clash = spans.dedup(frame(spark, ODD), ["doc_id", "text", "n_sentences", "removed", "__text", "__text_"])
    assert clash.columns == ["doc_id", "removed", "__text", "__text_", "text", *spans.ADDED] and clash.count() == len(ODD)


def brute_spans(docs):
    """{row: (text without repeats, words removed)} by the module's text alone; docs: (doc_id, text)."""
    held, first = [], {}
    for doc, text in docs:
        words = [m.group() for m in re.finditer(rb"[^\x20\x09-\x0D]+", (text or "").encode())]
        h = [int.from_bytes(md5(w).digest()[8:], "little") for w in words]
        ends = {i for i, w in enumerate(words) if w[-1:] in (b".", b"!", b"?")} | ({len(words) - 1} if words else set())
        for i in range(max(1, len(h) - 7) if h else 0):
            part = h[i : i + 8]
            ends.add(i + part.index(min(part)))
        bounds = sorted(e + 1 for e in ends)
        found = []
        for k, start in enumerate([0, *bounds[:-1]] if bounds else []):
            stop = next((e for j, e in enumerate(bounds) if j >= k + 2 and e - start >= 20), None)
            if stop is not None and doc is not None:
                key = tuple(words[start:stop])
                found.append((start, stop, key))
                first[key] = min(first.get(key, (doc, start)), (doc, start))
        held.append((doc, text, found))
    out = []
    for doc, text, found in held:
        gone = {w for start, stop, key in found if first[key] != (doc, start) for w in range(start, stop)}
        data, at, kept = (text or "").encode(), 0, b""
        spots = [m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)] + [len(data)]
        for w in sorted(gone):
            if w - 1 not in gone:
                kept += data[at : spots[w]]
            at = spots[w + 1]
        kept += data[at:]
        new = kept.decode().rstrip() if gone and at == len(data) else kept.decode()
        out.append((doc, text if not gone else new, len(gone)))
    return out


def test_spans_against_brute_force(spark, monkeypatch):
    r = random.Random(12)
    passages = [make_words(r, r.randrange(15, 90)) for _ in range(12)]
    docs = []
    for i in range(150):
        words = []
        for _ in range(r.randrange(1, 5)):
            words += [w + r.choice(["", "", "", ".", "!"]) for w in make_words(r, r.randrange(0, 40))]
            words += r.choice(passages) if r.random() < 0.6 else []
        docs.append((i, "".join(w + r.choice([" ", " ", " ", "\n", "  "]) for w in words)))
    hot = " ".join(passages[0] + make_words(r, 30))
    docs += [(1000 + i, hot) for i in range(60)] + [(2000, hot), (2000, hot), (None, hot), (None, None), (3000, None), (3001, "")]
    want = Counter(brute_spans(docs))
    assert sum(n for _, _, n in want) > 3000
    for block, most in ((1 << 18, 1024), (40, 50)):  # the second: many blocks, spans found hot
        monkeypatch.setattr(spans, "BLOCK", block)
        monkeypatch.setattr(spans, "HOT", most)
        got = spans.dedup(frame(spark, docs).repartition(5), ["doc_id"]).collect()
        assert Counter((x.doc_id, x.text, x.n_removed_words) for x in got) == want


def test_near_duplicates(spark):
    r = random.Random(2)
    docs = []
    for g in range(6):
        base = make_words(r, 120)
        for c in range(8):
            w = list(base)
            for _ in range(c // 2):
                w[r.randrange(len(w))] = "".join(make_words(r, 1))
            docs.append((g * 100 + c, " ".join(w).upper() if c == 3 else " ".join(w)))
    docs += [(1000 + i, " ".join(make_words(r, 80))) for i in range(20)]
    docs += [(2000, "two words"), (2001, "TWO  words"), (2002, "two words more")]
    up = {i: i for i, _ in docs}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    def shingle_set(t):
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", t)]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    sets = {i: shingle_set(t) for i, t in docs}
    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    got = {x.doc_id: x for x in minhash.near_duplicates(frame(spark, docs).repartition(3)).collect()}
    assert {i: find(i) for i in up} == {i: x.component_id for i, x in got.items()}
    assert all(x.n_shingles == len(sets[i]) and x.kept == (x.component_id == i) for i, x in got.items())


@pytest.mark.parametrize("sets", [minhash.SETS, 0])
def test_groups_around_a_passage(spark, monkeypatch, sets):
    """Groups around a common passage: most buckets are large, and few members are near their bucket's centres."""
    monkeypatch.setattr(minhash, "SETS", sets)
    r = random.Random(21)
    passage = make_words(r, 90)
    docs = []
    for g in range(60):
        own = make_words(r, 24)
        for c in range(3):
            w = passage + own
            for _ in range(2 + 2 * c):
                w = list(w)
                w[r.randrange(len(w))] = "".join(make_words(r, 1))
            docs.append((10 * g + c, " ".join(w)))
    docs += [(5000, docs[0][1]), (5000, docs[30][1])]  # one id with two texts
    sets_ = [(i, {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}) for i, t in docs]
    up = {i: i for i, _ in docs}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, s) in enumerate(sets_):
        for j, t in sets_[:k]:
            if find(i) != find(j) and 100 * len(s & t) >= 75 * len(s | t):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(frame(spark, docs)).collect()}
    assert got == {i: find(i) for i in up} and len({*got.values()}) > 3
    assert got[5000] == 0


def test_near_duplicate_cases(spark):
    out = minhash.near_duplicates(frame(spark, ODD)).collect()
    assert len(out) == len(ODD)
    assert all(x.kept and x.component_id == x.doc_id and x.n_shingles == 0 for x in out if x.doc_id in (1, 2, 3))
    assert all(x.kept and x.component_id is None for x in out if x.doc_id is None)
    assert minhash.near_duplicates(empty(spark)).isEmpty()


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((30, 16))
    rows, k = [], 0
    for i in range(30):
        for c in range(int(rng.integers(1, 12))):
            v = base[i] + rng.standard_normal(16) * (0.0 if c == 1 else 0.08)
            rows.append((k, [float(x) for x in v], i % 3))
            k += 1
    rows += [(k + 1, None, 1), (k + 2, [0.0] * 16, 1), (k + 3, [float("nan")] + [1.0] * 15, 1), (k + 4, rows[0][1], None), (k + 5, [], 1), (k + 6, [1.0, None], 1), (k + 7, [1.0, 2.0], 1), (k + 8, [2.0, 4.0], 1)]
    block, embeddings.BLOCK, leaf, embeddings.LEAF = embeddings.BLOCK, 16, embeddings.LEAF, 4
    try:
        got = {x.vec_id: x for x in embeddings.links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("h1", F.lit(1))).collect()}
    finally:
        embeddings.BLOCK, embeddings.LEAF = block, leaf
    ok = {i: np.array(v) for i, v, lab in rows if v and lab is not None and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: lab for i, _, lab in rows}
    links = defaultdict(set)
    for i in ok:
        for j in ok:
            if i != j and label[i] == label[j] and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] / np.linalg.norm(ok[i]) / np.linalg.norm(ok[j]) >= 0.98:
                links[i].add(j)
    for i, x in got.items():
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert (x.n_links, x.component_id, x.kept) == (len(links[i]), min(seen), min(seen) == i)
    assert sum(len(v) for v in links.values()) > 100
    assert embeddings.links(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).isEmpty()


def test_vectors_that_repeat(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.999, 0.01], 1), (3, [0.0, 1.0], 1), (4, [1.0, 0.0], 2), (None, [1.0, 0.0], 1), (5, [1.0, math.sqrt(1 / 0.98**2 - 1)], 3), (6, [1.0, 0.0], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("x") for c in ("h1", "v", "dim", "block", "rep", "copies", "c0", "fine", "kept", "i", "j")})
    got = sorted((x.vec_id or 0, x.n_links, x.component_id, x.kept) for x in embeddings.links(df).collect())
    assert [g for g in got if g[0] in (1, 2, 3, 4)] == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True)]
    assert (0, 0, None, True) in got and len(got) == len(rows)


# --- pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, held, SF)
        assert out.columns == docs.columns and out.count() <= held.count(), name
        held = out
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in held.select("doc_id").collect()}
    check_pieces(rows, [(r.doc_id, r.text) for r in held.collect()])


def test_pipeline_on_odd_rows(spark):
    for extra in (False, True):
        held = frame(spark, ODD, extra=extra)
        for _, stage in corpus_pipeline.STAGES:
            held = stage(spark, held, SF)
        assert held.isEmpty()
        nothing = empty(spark)
        for _, stage in corpus_pipeline.STAGES:
            nothing = stage(spark, nothing, SF)
        assert nothing.isEmpty()


def test_stages_on_any_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({c: F.lit("x") for c in CLASHES})
    docs = docs.unionByName(docs.filter("doc_id < 3").withColumn("doc_id", F.lit(None).cast("long")))
    held = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        held = corpus_pipeline.materialize(stage(spark, held, SF), "stage")
        assert held.schema.names == docs.columns, name
        assert held.filter(" OR ".join(f"`{c}` != 'x'" for c in CLASHES)).isEmpty()
    few = docs.select("doc_id", "text", "lang")
    assert corpus_pipeline.near_dedup(spark, few, SF).columns == few.columns
    assert corpus_pipeline.substring_dedup(spark, few.select("text", "doc_id"), SF).columns == ["text", "doc_id"]


@pytest.mark.parametrize("name", list(registry.SQL))
def test_twin(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(registry.SQL[name])
    got = registry.QUERIES[name](spark, sf)
    order = sorted(got.columns)
    assert sorted(want.columns) == order
    pick = lambda cols, rows: sorted(tuple(str(r[cols.index(c)]) for c in order) for r in rows)
    assert pick(got.columns, got.collect()) == pick(want.columns, want.fetchall())
