import pytest
from pyspark.sql import functions as F

from kinloom.operators import blocking, cascade, decisions, enrichment, evaluate, matching, rubric, shared, survivorship
from kinloom.operators.records import describe_gaps, normalize_records
from kinloom.operators.shared import connected_components
from kinloom.sources import layers

BASE = {"id": "p-0001", "full_name": "Priya Raghavan", "email": "priya.raghavan@vantagesystems.com", "linkedin_url": "https://www.linkedin.com/in/priya-raghavan-2291", "company": "Vantage Systems", "title": "VP Sales", "location": "Bengaluru, India", "bio": "VP Sales at Vantage Systems.", "source": "airtable_export", "needs": [], "offers": [], "created_at": "2025-01-01"}


def people(spark, *changes):
    rows = [BASE | {"id": f"p-{i:04d}"} | c for i, c in enumerate(changes, 1)]
    names = [x.split()[0] for x in layers.PEOPLE.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], layers.PEOPLE)


def norm(spark, *changes):
    return normalize_records(people(spark, *changes))


def score(spark, a, b):
    n = norm(spark, a, b)
    pairs = cascade.attach(spark.createDataFrame([("p-0001", "p-0002", [])], "a string, b string, keys array<string>"), n)
    return cascade.fuzzy(pairs).first()


def test_completeness(spark):
    rows = norm(spark, {"needs": ["x"]}, {"email": " ", "needs": ["x"]}, {"company": None, "needs": ["x"]}, {"email": None, "company": None}, {"title": ""})
    got = rows.select("completeness", describe_gaps(F.col("completeness.missing")).alias("gaps")).collect()
    assert [round(r.completeness.score, 4) for r in got] == [1.0, 0.8, 0.85, 0.55, 0.75]
    assert [r.completeness.blocked for r in got] == [False, True, True, True, False]
    assert got[0].gaps == "Complete" and got[4].gaps == "Missing title, needs or offers"


def test_scores_of_pairs(spark):
    far = {"linkedin_url": None, "email": None}
    assert score(spark, {"full_name": "Rohit Zaidi", "title": "CEO"}, {"full_name": "Rohia Zaidi", "title": "CTO"}).score == 91.0
    one = score(spark, {"full_name": "Michael Mukherjee"}, {"full_name": "Mike Mukherjee"})
    assert one.score == 91.0 and one.name_sim < 90
    assert score(spark, {"full_name": "Kenji Sinha", "company": "Slate Stack"}, {"full_name": "Kenji Sinha", "company": "Obsidian Health"}).score == 79.67
    assert score(spark, {"full_name": "Joseph Whitfield"}, {"full_name": "JOSEPH W."}).score == 99.75
    assert score(spark, {"company": None} | far, {"company": None} | far).score == 91.0  # a name alone never merges
    missing = score(spark, {"title": None}, {"title": "CTO"})
    assert missing.score == 100.0 and missing.title_agrees is None  # absence is not disagreement


def test_oversized_bucket_gives_nothing(spark):
    rows = norm(spark, *[{"full_name": f"Sam {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}x", "email": None, "linkedin_url": None, "company": None, "location": None} for i in range(45)])
    assert blocking.candidates(rows).isEmpty()
    assert blocking.skipped(rows).first().size == 45


def test_routing(spark):
    rows = norm(spark, {}, {"full_name": "P. Raghavan"}, {"full_name": "Priya Raghavan", "email": None, "linkedin_url": None, "title": "CTO"}, {"full_name": "Someone Else", "email": None, "linkedin_url": None, "company": None, "location": None})
    pairs = cascade.route(rows, blocking.candidates(rows))
    got = {(r.a, r.b): (r.stage, r.verdict, r.review_state) for r in pairs.collect()}
    assert got[("p-0001", "p-0002")] == ("deterministic", "same_person", "auto_merged")
    assert got[("p-0001", "p-0003")] == ("fuzzy", "insufficient_evidence", "pending")
    answers = spark.createDataFrame([("p-0001", "p-0003", "same_person", 0.9, "bio")], "a string, b string, verdict string, confidence double, reason string")
    told = {(r.a, r.b): (r.verdict, r.review_state, r.reason) for r in cascade.route(rows, blocking.candidates(rows), answers).filter("stage = 'llm'").collect()}
    assert told[("p-0001", "p-0003")] == ("same_person", "auto_merged", "bio")
    assert told[("p-0002", "p-0003")][:2] == ("insufficient_evidence", "pending")


def test_missing_identifiers_never_match(spark):
    rows = norm(spark, {"email": None, "linkedin_url": None}, {"email": None, "linkedin_url": None})
    settled, rest = cascade.scored(rows, blocking.candidates(rows))
    assert settled.isEmpty() and rest.count() == 1


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 9), (9, 8), (20, 20), (2, 1), (5, 6)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8, 10: 8, 5: 5, 6: 5}
    assert connected_components(spark.createDataFrame([], "a long, b long")).isEmpty()
    chain = [(i, i + 1) for i in range(200)] + [(0, 1000 + i) for i in range(200)]
    assert {c for _, c in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()} == {0}


def plan(spark, *changes):
    rows = norm(spark, *changes).withColumn("cluster", F.lit("c"))
    return survivorship.merge_plans(rows).first()


def test_survivorship(spark):
    p = plan(spark, {"full_name": "Ines Bakshi", "created_at": "2024-01-01", "bio": "A longer biography.", "needs": ["x", "y"]}, {"full_name": "INES B.", "created_at": "2025-06-01", "bio": "Short.", "title": "CTO", "needs": ["y", "z"]})
    assert p.resolved.full_name == "Ines Bakshi" and p.resolved.title == "CTO" and p.resolved.bio == "A longer biography."
    assert p.resolved.needs == ["x", "y", "z"] and p.first_contact_at == "2024-01-01" and p.source_ids == ["p-0001", "p-0002"]
    assert p.provenance["full_name"] == "p-0001" and p.provenance["title"] == "p-0002" and p.status == "merged"


def test_conflicts(spark):
    p = plan(spark, {"email": "a@work.com"}, {"email": "b@other.com"})
    assert [c.field for c in p.conflicts] == ["email"] and p.status == "pending_review"
    work = plan(spark, {"email": "x@gmail.com", "created_at": "2025-09-09"}, {"email": "a@work.com", "created_at": "2020-01-01"})
    assert work.resolved.email == "a@work.com" and not work.conflicts
    assert not plan(spark, {"company": "Delta"}, {"company": "Delta AI"}).conflicts
    assert plan(spark, {"company": "Delta"}, {"company": "Delta AI"}).resolved.company == "Delta AI"
    assert [c.field for c in plan(spark, {"company": "Delta"}, {"company": "Helix Grid"}).conflicts] == ["company"]


def log(spark, *rows):
    return spark.createDataFrame([(*r[:3], "", r[3]) for r in rows], layers.DECISIONS)


def test_decisions(spark):
    rows = norm(spark, {}, {"full_name": "P. Raghavan"})
    pairs = cascade.route(rows, blocking.candidates(rows))
    no = log(spark, ("p-0002", "p-0001", "keep_both", "2025-01-02"), ("p-0001", "p-0002", "merge", "2025-01-01"))
    out = decisions.apply_decisions(pairs, no).first()
    assert out.review_state == "rejected" and out.reason.endswith("[overruled by an operator: keep_both]")
    assert survivorship.build_plans(rows, pairs, decisions.latest_decisions(no)).isEmpty()
    plans = survivorship.build_plans(rows, pairs)
    events = decisions.revert_events(plans, pairs, plans.first().canonical_id, "2025-03-01")
    assert [(r.a, r.b, r.decision) for r in events.collect()] == [("p-0001", "p-0002", "keep_both")]
    assert decisions.revert(plans, plans.first().canonical_id, "2025-03-01").first().status == "reverted"
    with pytest.raises(ValueError, match="no active merge"):
        decisions.revert(plans, "nobody", "2025-03-01")


def test_recomputation_keeps_only_keep_both(spark):
    rows = norm(spark, {}, {"full_name": "P. Raghavan"})
    pairs = cascade.route(rows, blocking.candidates(rows))
    state = pairs.first().review_state
    for decision, after, again in (("keep_both", "rejected", "rejected"), ("merge", "auto_merged", state), ("not_sure", "pending", state)):
        said = log(spark, ("p-0001", "p-0002", decision, "2025-01-01"))
        assert decisions.decide(pairs, said).first().review_state == after
        assert decisions.apply_decisions(pairs, said).first().review_state == again
    both = log(spark, ("p-0001", "p-0002", "merge", "2025-01-01"), ("p-0003", "p-0002", "merge", "2025-01-01"), ("p-0003", "p-0004", "keep_both", "2025-01-01"))
    assert {(r.id, r.merged_into) for r in decisions.pointers(both).collect()} == {("p-0002", "p-0001"), ("p-0003", "p-0002")}
    asserted, _ = evaluate.split_predictions(decisions.apply_decisions(pairs, log(spark, ("p-0001", "p-0002", "keep_both", "1"))))
    assert asserted.count() == 1  # what the pipeline said, whatever a person decided


def test_intro_decisions(spark):
    intros = spark.createDataFrame([("b", "a", 0.9), ("c", "d", 0.8)], "a string, b string, score double")
    blocked = log(spark, ("a", "b", "block", "1"))
    assert {(r.a, r.status, r.decided_at) for r in decisions.intro_states(intros, blocked).collect()} == {("b", "dismissed", "1"), ("c", "suggested", None)}
    assert decisions.blocked_pairs(blocked).count() == 1
    back = log(spark, ("a", "b", "block", "1"), ("b", "a", "restore", "2"))
    assert decisions.blocked_pairs(back).isEmpty() and decisions.intro_states(intros, back).filter("status = 'suggested' AND decided_at IS NULL").count() == 2


def test_rubric(spark):
    apps = spark.createDataFrame([("x", "We grew 40% to 200 customers", "", "mentoring", "m", ""), ("y", "grew a lot", "", " ", "nobody", ""), ("z", None, "", None, None, "")], layers.APPLICATIONS)
    enr = spark.createDataFrame([("x", "founder", "c_level", "growth"), ("y", "ic", "mid", "seed")], "person_id string, persona string, seniority string, company_stage string")
    done = spark.createDataFrame([("x", 1.0), ("y", 0.5)], "id string, score double")
    got = {r.person_id: r for r in rubric.score_applicants(apps, enr, done, spark.createDataFrame([("m",)], "id string")).collect()}
    assert (got["x"].total, got["x"].band, got["x"].kind) == (100.0, "strong", "why")
    assert (got["y"].total, got["y"].band, got["y"].kind) == (8 + 5 + 10 + 8 + 4, "weak", "why_not")
    assert got["z"].total == 6 + 4 + 6 + 4
    bands = spark.createDataFrame([(75.0,), (74.9,), (55.0,), (54.9,)], "t double").select(rubric.band(F.col("t")).alias("b"))
    assert [r.b for r in bands.collect()] == ["strong", "review", "review", "weak"]
    extra = rubric.score_applicants(apps, enr, done, spark.createDataFrame([("m",)], "id string")).filter("person_id = 'x'").select(rubric.unsupported_numbers(F.lit("scored 100.0 of 100, 30 for persona, 17 nobody gave")).alias("u"))
    assert extra.first().u == ["17"]


def test_evidence(spark):
    rows = norm(spark, {"bio": "Built  Café software"})
    schema = "person_id string, evidence array<struct<field: string, quote: string, supports: string>>"
    quotes = [("bio", "cafe SOFTWARE", "persona"), ("bio", "abc", "persona"), ("bio", "never said", "persona"), ("needs", "anything", "persona"), ("shoe_size", "anything", "persona")]
    got = enrichment.verify_evidence(rows, spark.createDataFrame([("p-0001", quotes), ("p-0002", [])], schema)).collect()
    one = next(r for r in got if r.person_id == "p-0001")
    assert (one.total, one.verified) == (5, 1)
    assert sorted(u.why for u in one.unverified) == ["field 'needs' is empty or unknown", "field 'shoe_size' is empty or unknown", "quote does not appear in that field", "quote too short to be evidence"]
    assert next(r for r in got if r.person_id == "p-0002").rate == 1.0


def brute_greedy(edges, cap):
    room, out = {}, set()
    for a, b, s in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if room.get(a, cap) > 0 and room.get(b, cap) > 0:
            out.add((a, b))
            room[a], room[b] = room.get(a, cap) - 1, room.get(b, cap) - 1
    return out


def test_greedy_matching(spark):
    import random

    r = random.Random(3)
    edges = list({(f"v{min(a, b):02d}", f"v{max(a, b):02d}"): (f"v{min(a, b):02d}", f"v{max(a, b):02d}", r.choice([0.6, 0.7, 0.8])) for a, b in (r.sample(range(20), 2) for _ in range(120))}.values())
    got = matching.greedy_match(spark.createDataFrame(edges, "a string, b string, score double"), 3)
    assert {(x.a, x.b) for x in got.collect()} == brute_greedy(edges, 3)
    hub = [(f"offer{i}", "need", 0.9) for i in range(6)]
    assert sorted(x.a for x in matching.greedy_match(spark.createDataFrame(hub, "a string, b string, score double"), 3).collect()) == ["offer0", "offer1", "offer2"]


def brute_scores(people):
    """SCORED rows by a loop over pairs and phrases; people: (id, needs, offers, profile) in order of id."""
    out = set()

    def best(needs, offers):
        found = [(round(float(n @ o), 9), -i, -j) for i, n in enumerate(needs) for j, o in enumerate(offers)]
        return max(found) if found else (0.0, 1, 1)

    for x, (a, an, ao, ap) in enumerate(people):
        for b, bn, bo, bp in people[x + 1 :]:
            f, g = best(an, bo), best(bn, ao)
            hi, lo = max(f[0], g[0]), min(f[0], g[0])
            score = round(0.6 * hi + 0.15 * lo + 0.1 * float(ap @ bp) + (0.15 if lo >= 0.62 else 0), 4)
            if hi >= 0.68 and score >= 0.55:
                (p, q, u, v) = (a, b, f, g) if f[0] >= g[0] else (b, a, g, f)
                out.add((p, q, score, lo >= 0.62, -u[1], -u[2], -v[1], -v[2]))
    return out


@pytest.mark.parametrize("block", [4, 1024])
def test_scores_of_several_needs_and_offers(spark, block):
    import numpy as np

    rng = np.random.default_rng(5)
    base = rng.standard_normal((4, 6))

    def near():
        v = base[rng.integers(4)] + 0.3 * rng.standard_normal(6)
        return v / np.linalg.norm(v)

    people = []
    for i in range(23):
        needs, offers = [near() for _ in range(rng.integers(0, 4))], [near() for _ in range(rng.integers(0, 4))]
        people.append((f"p{i:02d}", needs + needs[:1], offers + offers[:1], near()))  # the first ones tie with the last
    people[3] = ("p03", people[2][1], people[2][2], people[2][3])
    rows = [(i, [v.tolist() for v in n], [v.tolist() for v in o] if k % 5 else None if not o else [v.tolist() for v in o], p.tolist()) for k, (i, n, o, p) in enumerate(people)]
    got = matching.score_pairs(spark.createDataFrame(rows, "id string, needs array<array<double>>, offers array<array<double>>, profile array<double>"), block).collect()
    want = brute_scores(people)
    assert len(want) > 60 and {(r.a, r.b, r.score, r.reciprocal, r.need_i, r.offer_j, r.reverse_i, r.reverse_j) for r in got} == want and len(got) == len(want)


def test_embedding_of_people(spark):
    class Letters:
        def embed(self, texts):
            return texts.select("text", F.array(*(F.length(F.regexp_replace("text", f"[^{c}]", "")).cast("double") for c in "abc")).alias("vector"))

    rows = spark.createDataFrame([("x", ["aa", " ", "b"], None), ("y", [], ["c", "aa"])], "id string, needs array<string>, offers array<string>")
    profiles = spark.createDataFrame([("x", "ab"), ("y", "zzz")], "id string, profile string")
    got = {r.id: r for r in matching.embed_people(rows, profiles, Letters()).collect()}
    assert got["x"].needs == [[1, 0, 0], [0, 1, 0]] and got["x"].offers == [] and got["y"].offers == [[0, 0, 1], [1, 0, 0]]
    assert got["x"].profile == pytest.approx([0.5**0.5, 0.5**0.5, 0]) and got["y"].profile == [0, 0, 0]  # nothing to normalize
    stored = layers.embedding_rows(matching.embed_people(rows, profiles, Letters()), "letters", "t").collect()
    assert {(r.person_id, r.kind, r.dim, r.model) for r in stored} == {("x", "profile", 3, "letters"), ("y", "profile", 3, "letters")}


def test_suggestions_and_rejections(spark):
    e = lambda i: [1.0 if k == i else 0.0 for k in range(8)]
    rows = norm(spark, *[{"email": f"a{i}@x{i}.com", "company": c, "needs": ["n"], "offers": ["o"]} for i, c in enumerate(["One", "One", "Two", "Three", "Four"])])
    vec = spark.createDataFrame([(f"p-{i:04d}", [e(n)], [e(o)], e(7)) for i, (n, o) in enumerate([(0, 1), (1, 0), (1, 0), (2, 3), (4, 5)], 1)], "id string, needs array<array<double>>, offers array<array<double>>, profile array<double>")
    enr = spark.createDataFrame([("p-0004", "founder", "fintech", "seed"), ("p-0005", "founder", "fintech", "series_a")], "person_id string, persona string, sector string, company_stage string")
    none = spark.createDataFrame([], "a string, b string")
    picked, rejected, funnel = matching.suggest(rows, vec, enr, none, none)
    assert {(r.a, r.b, r.score, r.reciprocal) for r in picked.collect()} == {("p-0001", "p-0003", 1.0, True)}
    assert {r.reason: r.n for r in rejected.collect()} == {"same_company": 1, "competitors": 1, "incomplete_profile": 0, "blocked_pair": 0, "already_introduced": 0, "no_shared_signal": 7}
    assert {r.metric: r.n for r in funnel.collect()}["pairs_considered"] == 10
    stop = spark.createDataFrame([("p-0003", "p-0001")], "a string, b string")
    picked, rejected, _ = matching.suggest(rows, vec, enr, stop, none)
    assert picked.isEmpty() and {r.reason: r.n for r in rejected.collect()}["blocked_pair"] == 1


def test_metrics(spark):
    df = lambda rows: spark.createDataFrame(rows, "a string, b string")
    m = evaluate.pair_metrics(df([("a", "b"), ("c", "d"), ("e", "f")]), df([("a", "b"), ("x", "y")]), df([("e", "f")])).first()
    assert (m.tp, m.fp, m.fn, m.precision, m.recall, m.f1, m.unresolved_truth) == (1, 1, 1, 0.5, 0.5, 0.5, 1)
    empty = evaluate.pair_metrics(df([]), df([]), df([])).first()
    assert (empty.precision, empty.recall) == (1.0, 1.0)
    assert evaluate.near_miss_rate(df([]), df([])).first().rejection_rate == 1.0


def test_layers(spark, tmp_path):
    old = people(spark, {}, {"title": "CTO"}).withColumn("ingested_at", F.lit("0")).withColumn("merged_into", F.lit("p-0009"))
    new = people(spark, {"title": "CEO"})
    out = {r.id: (r.title, r.merged_into) for r in layers.load_people(old, new, "1").collect()}
    assert out == {"p-0001": ("CEO", None), "p-0002": ("CTO", "p-0009")}
    (tmp_path / "p.json").write_text('[{"id": "p-1", "full_name": "A", "needs": ["x"]}]')
    assert layers.read_people(spark, str(tmp_path / "p.json")).first().needs == ["x"]
    runs = layers.append_run(spark.createDataFrame([], layers.RUNS), "dedupe", "t", 1, 2, 3, 4, {"x": 5})
    assert layers.append_run(runs, "dedupe", "u", 0, 0, 0, 0, {}).agg(F.max("id")).first()[0] == 2
    d = tmp_path / "answers"
    d.mkdir()
    (d / "k.json").write_text('{"key": "k", "provider": "p", "model": "m", "task": "t", "created_at": "1", "request": {}, "response": {"person_id": "p-1", "persona": "ic", "confidence": 0.5}}')
    answers = layers.read_answers(spark, str(d))
    assert layers.harvest(answers).first().persona == "ic" and layers.answer_stats(answers).first().entries == 1


def test_stream_of_decisions(spark, tmp_path):
    from kinloom.streaming import decisions as stream

    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text('{"a": "x", "b": "y", "decision": "merge", "decided_at": "2025-01-01 00:00:00"}\n')
    root, ck = str(tmp_path / "state"), str(tmp_path / "ck")
    stream.fold(stream.read_stream(spark, str(src)), root, ck).awaitTermination()
    (src / "2.json").write_text('{"a": "y", "b": "x", "decision": "keep_both", "decided_at": "2025-01-02 00:00:00"}\n')
    stream.fold(stream.read_stream(spark, str(src)), root, ck).awaitTermination()
    assert [(r.a, r.b, r.decision) for r in stream.state(spark, root).collect()] == [("x", "y", "keep_both")]


def test_answers(spark):
    from kinloom.sources import answers

    table = spark.createDataFrame([("k1", "old", "1"), ("k1", "new", "2")], "key string, response string, created_at string")
    asked = answers.ask(spark.createDataFrame([("k1", "p1"), ("k2", "p2")], "key string, payload string"), answers.Replay(table))
    assert {r.key: (r.response, r.hit) for r in asked.collect()} == {"k1": ("new", True), "k2": (None, False)}
    u = answers.usage(asked, 10).first()
    assert (u.cache_hits, u.misses, u.calls, u.hit_rate, u.within_budget) == (1, 1, 1, 0.5, True)
    with pytest.raises(LookupError):
        answers.ask(spark.createDataFrame([("k9", "p")], "key string, payload string"), answers.Replay(table), strict=True)
    assert [r.payloads for r in answers.batches(spark.createDataFrame([("b", "2"), ("a", "1"), ("c", "3")], "key string, payload string"), 2).orderBy("batch").collect()] == [["1", "2"], ["3"]]


def test_prompts(spark):
    from kinloom.functions import text

    rows = cascade.attach(spark.createDataFrame([("p-0001", "p-0002")], "a string, b string"), norm(spark, {}, {"email": None}))
    prompt = rows.select(text.render_pair(F.lit(3), F.lit(88.5)).alias("t")).first().t
    assert prompt.startswith("  Pair 3 (fuzzy score 88.5):\n    Record A (p-0001):") and "email: (missing)" in prompt
    intro = rows.select(text.render_intro(F.lit(0), F.lit("n"), F.lit("o"), F.lit("bn"), F.lit("bo"), F.lit(True)).alias("t")).first().t
    assert intro.endswith("B needs: bn\n    A offers: bo") and "reciprocal: True" in intro
    person = people(spark, {"needs": ["x", "y"]}).select(F.struct("*").alias("r")).select(text.render_person("r").alias("t")).first().t
    assert "needs: x; y" in person and person.endswith("offers: (empty)")
    assert "persona" in text.field_spec()


def test_numbers_without_a_global_window(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("x").alias("v")).repartition(6)
    assert {r.k: r.n for r in shared.numbered(rows, ["k"]).collect()} == {k: k for k in range(1000)}
    assert shared.numbered(rows.limit(0), ["k"]).isEmpty()
    table = shared.materialize(rows, "left")
    assert table.count() == 1000 and shared.release(spark) >= 1 and shared.release(spark) == 0


def test_group_metrics_count_pairs(spark):
    members = spark.createDataFrame([(x, c) for c, ids in (("a", "abcd"), ("e", "ef")) for x in ids], "id string, cluster string")
    truth = spark.createDataFrame([("a", "b"), ("e", "f"), ("d", "e")], "a string, b string")
    row = evaluate.group_metrics(truth, members).first()
    assert (row.tp, row.fp, row.fn, row.precision, row.recall) == (2, 5, 1, round(2 / 7, 4), round(2 / 3, 4))
    listed = evaluate.cluster_pairs(members)
    assert listed.count() == 7
    same = evaluate.pair_metrics(truth, listed, truth.limit(0)).first()
    assert (same.tp, same.fp, same.fn, same.f1) == (row.tp, row.fp, row.fn, row.f1)


def test_answers_come_back(spark, tmp_path):
    rows = [("k1", "p", "m", "enrichment_person", "1", '{"a": 1}', '{"person_id": "x", "persona": "ic", "confidence": 0.5}'), ("k2", "p", "m2", "other", "2", "{}", '{"q": "say \\"so\\""}')]
    table = spark.createDataFrame(rows, layers.ANSWERS)
    where = str(tmp_path / "cache")
    layers.write_answers(table, where)
    back = layers.read_answers(spark, where, lines=True)
    assert sorted(tuple(r)[:7] for r in back.collect()) == rows
    assert layers.harvest(back.filter("task = 'enrichment_person'")).first().person_id == "x"
    assert {(r.task, r.entries) for r in layers.answer_stats(back).collect()} == {("enrichment_person", 1), ("other", 1)}
    assert {r.model for r in layers.providers(back).collect()} == {"m", "m2"}
    layers.write_report(back.select("key"), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 2


def test_applications_and_layers(spark, tmp_path):
    old = spark.createDataFrame([("x", "a", "", "", None, "1"), ("y", "b", "", "", None, "1")], layers.APPLICATIONS)
    new = spark.createDataFrame([("x", "c", "", "", "z", "2")], layers.APPLICATIONS)
    assert {(r.person_id, r.building_now) for r in layers.load_applications(old, new).collect()} == {("x", "c"), ("y", "b")}
    for df in (old, new):
        layers.write_layer(df, str(tmp_path / "layer"))
    assert spark.read.parquet(str(tmp_path / "layer")).count() == 1
    people_ = spark.createDataFrame([("x", None), ("y", "x")], "id string, merged_into string")
    assert [r.id for r in layers.canonical_people(people_).collect()] == ["x"]
    runs = layers.append_run(spark.createDataFrame([], layers.RUNS), "dedupe", "t", 1, 2, 3, 4, {"x": 5})
    assert layers.last_run(layers.append_run(runs, "dedupe", "u", 9, 0, 0, 0, {}), "dedupe").first().llm_calls == 9


def test_adjudication_prompts(spark):
    rows = norm(spark, {}, {"full_name": "P. Raghavan"}, {"full_name": "Priya R."})
    pairs = cascade.attach(spark.createDataFrame([("p-0001", "p-0002", 90.0), ("p-0001", "p-0003", 80.0), ("p-0002", "p-0003", 79.5)], "a string, b string, score double"), rows)
    got = {r.batch: r.prompt for r in cascade.prompts(pairs, "Decide.\n\n", 2).collect()}
    assert sorted(got) == [0, 1] and got[0].startswith("Decide.\n\n  Pair 0 (fuzzy score 90.0)") and "\n\n  Pair 1 (fuzzy score 80.0)" in got[0] and "Pair 0 (fuzzy score 79.5)" in got[1]


def test_windowed_counts_of_decisions(spark, tmp_path):
    from kinloom.streaming import decisions as stream

    rows = spark.createDataFrame([("x", "y", "merge", "2025-01-01 00:00:10"), ("x", "z", "merge", "2025-01-01 00:00:40"), ("x", "z", "keep_both", "2025-01-02 00:00:00")], "a string, b string, decision string, decided_at string")
    out = stream.windowed_counts(rows.withColumn("decided_at", F.to_timestamp("decided_at")))
    assert sorted(r[-1] for r in out.collect()) == [1, 2]
