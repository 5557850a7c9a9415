"""Introductions: best need-to-offer match in both directions, deterministic filters, and a capped greedy matching.

All eligible pairs are compared, so people are packed into blocks of BLOCK, a few matrices each, and the blocks are
dealt to block pairs: each pair of blocks is a handful of matrix products, one for each place of a need and of an offer,
and only pairs above the floors come out. Rejections are counted by reason without listing pairs.
"""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import CAPACITY, COMPLETENESS_FLOOR, MIN_DIRECTION, MIN_SCORE, PRIMARY_WEIGHT, REASONS, RECIPROCITY_BONUS, RECIPROCITY_FLOOR, SECOND_WEIGHT, SIMILARITY_WEIGHT, STAGE_ORDER
from .shared import drop_table, materialize

BLOCK, LABEL_BLOCK = 1024, 2048


class Embedder(Protocol):
    def embed(self, texts: DataFrame) -> DataFrame:
        """(text, vector) of every different text; nothing here loads a model or calls a network."""


def phrases(records: DataFrame, profiles: DataFrame) -> DataFrame:
    """(id, kind, place, text) of all that is embedded: each need, each offer, and one profile (id, profile) a person."""
    real = lambda c: F.filter(c, lambda x: x.isNotNull() & (F.trim(x) != ""))
    parts = [records.select("id", F.lit(kind).alias("kind"), F.posexplode(real(c)).alias("place", "text")) for kind, c in (("need", "needs"), ("offer", "offers"))]
    return parts[0].unionByName(parts[1]).unionByName(profiles.select("id", F.lit("profile").alias("kind"), F.lit(0).alias("place"), F.col("profile").alias("text")))


def embed_people(records: DataFrame, profiles: DataFrame, embedder: Embedder) -> DataFrame:
    """(id, needs, offers, profile) with unit vectors in the order of the phrases; equal texts are embedded once, people without needs or offers have empty lists."""
    said = phrases(records, profiles)
    known = embedder.embed(said.select("text").distinct()).select("text", unit(F.col("vector")).alias("v"))
    rows = said.join(known, "text").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("kind", "place", "v"))).alias("all"))
    of = lambda kind: F.transform(F.filter("all", lambda x: x["kind"] == kind), lambda x: x["v"])
    return rows.select("id", of("need").alias("needs"), of("offer").alias("offers"), F.get(of("profile"), F.lit(0)).alias("profile"))


def unit(v: Column) -> Column:
    """A vector (array) of length one, in double precision; norms are at least 1e-9."""
    x = F.transform(v, lambda t: t.cast("double"))
    norm = F.greatest(F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, t: s + t * t)), F.lit(1e-9))
    return F.transform(x, lambda t: t / norm)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, t: s + t)


def actionable(records: DataFrame) -> DataFrame:
    """Records that aren't blocked, complete enough, and need or offer something."""
    return records.filter(~F.col("completeness.blocked") & (F.col("completeness.score") >= COMPLETENESS_FLOOR) & ((F.size("needs") > 0) | (F.size("offers") > 0)))


def stage_index(c: str) -> Column:
    return F.array_position(F.array(*(F.lit(s) for s in STAGE_ORDER)), F.col(c))


def competitors(a: str, b: str) -> Column:
    """Two founders of one known sector at equal or neighbouring stages."""
    x, y = f"{a}.", f"{b}."
    known = lambda c: F.col(c).isNotNull() & (F.col(c) != "unknown") & (F.col(c) != "")
    near = (stage_index(x + "company_stage") > 0) & (stage_index(y + "company_stage") > 0) & (F.abs(stage_index(x + "company_stage") - stage_index(y + "company_stage")) <= 1)
    sector = known(x + "sector") & (F.col(x + "sector") != "other") & (F.col(x + "sector") == F.col(y + "sector"))
    founders = (F.col(x + "persona") == "founder") & (F.col(y + "persona") == "founder")
    return F.coalesce(founders & sector & known(x + "company_stage") & known(y + "company_stage") & ((F.col(x + "company_stage") == F.col(y + "company_stage")) | near), F.lit(False))


SCORED = "a string, b string, score double, complementarity double, reverse_complementarity double, similarity double, reciprocal boolean, need_i int, offer_j int, reverse_i int, reverse_j int"


def score_pairs(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """SCORED rows of all pairs of people above both floors, a being the one whose need is answered best.

    vectors: id, needs and offers (arrays of unit vectors), profile (unit vector). Of equally good needs and offers (at
    nine digits) the first need counts, and of those the first offer; of equally good directions that of the lesser id.
    """
    blocks = max(1, -(-vectors.count() // block))
    rows = vectors.select("id", "needs", "offers", "profile", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("k"))
    packed = rows.groupBy("k").applyInArrow(pack, "k int, ids array<string>, dim int, needs binary, offers binary, profiles binary")
    packed = materialize(packed, "blocks")
    dealt = packed.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumns({"i": F.least("k", "o"), "j": F.greatest("k", "o")}).drop("o")

    def compare(key, table):
        held = {r["k"]: r for r in table.to_pylist()}
        i, j = (x.as_py() for x in key)
        return score_blocks(Block(held[i]), Block(held[j])) if i in held and j in held else EMPTY

    return dealt.select("i", "j", *packed.columns).groupBy("i", "j").applyInArrow(compare, SCORED)


def pack(table: pa.Table) -> pa.Table:
    """People of one block, by id, as matrices: a person's needs and offers padded with nan to the most that one has."""
    table = table.sort_by("id")
    ids, needs, offers, profiles = (table.column(c).to_pylist() for c in ("id", "needs", "offers", "profile"))
    dim = max((len(v) for x in (needs, offers) for vs in x for v in vs or []), default=max((len(p or []) for p in profiles), default=0))

    def padded(lists):
        out = np.full((max((len(x or []) for x in lists), default=0), len(ids), dim), np.nan)
        for at, vs in enumerate(lists):
            for place, v in enumerate(vs or []):
                out[place, at] = v
        return out.tobytes()

    flat = np.array([p if p is not None and len(p) == dim else [0.0] * dim for p in profiles], float)
    cols = [pa.array([table.column("k")[0].as_py()], pa.int32()), pa.array([ids], pa.list_(pa.string())), pa.array([dim], pa.int32()), *(pa.array([x], pa.binary()) for x in (padded(needs), padded(offers), flat.tobytes()))]
    return pa.Table.from_arrays(cols, ["k", "ids", "dim", "needs", "offers", "profiles"])


class Block:
    """What pack() made of some people; needs and offers by (place, person)."""

    def __init__(self, row: dict):
        self.k, self.ids = row["k"], np.array(row["ids"], object)
        shape = (-1, len(row["ids"]), row["dim"])
        self.needs, self.offers = (np.frombuffer(row[c]).reshape(shape) if row[c] else np.empty((0, *shape[1:])) for c in ("needs", "offers"))
        self.profiles = np.frombuffer(row["profiles"]).reshape(shape[1:])


def answered(x: Block, y: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For everyone of x and of y: how well y's offers answer x's needs (0 where one has none), and the places of that need and offer."""
    best = np.full((len(x.ids), len(y.ids)), -np.inf)
    need, offer = np.full(best.shape, -1, np.int32), np.full(best.shape, -1, np.int32)
    for a, n in enumerate(x.needs):
        for b, f in enumerate(y.offers):
            sim = np.round(np.nan_to_num(n) @ np.nan_to_num(f).T, 9)
            sim[np.isnan(n[:, 0])] = -np.inf
            sim[:, np.isnan(f[:, 0])] = -np.inf
            more = sim > best
            best[more], need[more], offer[more] = sim[more], a, b
    best[np.isinf(best)] = 0.0
    return best, need, offer


def score_blocks(x: Block, y: Block) -> pa.Table:
    """SCORED rows of the pairs of one of x with one of y."""
    f, fi, fj = answered(x, y)
    g, gi, gj = answered(y, x)
    g, gi, gj = g.T, gi.T, gj.T
    first, second = np.maximum(f, g), np.minimum(f, g)
    ok = first >= MIN_DIRECTION
    if x.k == y.k:
        ok &= np.triu(np.ones(ok.shape, bool), 1)
    p, q = np.nonzero(ok)
    first, second = first[p, q], second[p, q]
    sim = np.einsum("ij,ij->i", x.profiles[p], y.profiles[q])
    both = second >= RECIPROCITY_FLOOR
    score = np.round(PRIMARY_WEIGHT * first + SECOND_WEIGHT * second + SIMILARITY_WEIGHT * sim + RECIPROCITY_BONUS * both, 4)
    good = score >= MIN_SCORE
    p, q, first, second, sim, both, score = (c[good] for c in (p, q, first, second, sim, both, score))
    ids_p, ids_q = x.ids[p], y.ids[q]
    forward = (f[p, q] > g[p, q]) | ((f[p, q] == g[p, q]) & (ids_p < ids_q).astype(bool))
    pick = lambda u, v: np.where(forward, u, v)
    cols = [pick(ids_p, ids_q), pick(ids_q, ids_p), score, np.round(first, 4), np.round(second, 4), np.round(sim, 4), both]
    cols += [pick(fi[p, q], gi[p, q]), pick(fj[p, q], gj[p, q]), pick(gi[p, q], fi[p, q]), pick(gj[p, q], fj[p, q])]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, KINDS, strict=True)], NAMES)


KINDS = [pa.string(), pa.string(), *[pa.float64()] * 4, pa.bool_(), *[pa.int32()] * 4]
NAMES = [c.split()[0] for c in SCORED.split(", ")]
EMPTY = pa.Table.from_arrays([pa.array([], t) for t in KINDS], NAMES)


def best_of_label(vectors: DataFrame, block: int = LABEL_BLOCK) -> DataFrame:
    """(vec_id, sim, best) of every vector against all others of its label: the highest product, and the least id of those equal to it at nine digits.

    vectors: vec_id, label, v (unit vector). Rows without a label, a vector or another id of their label have no match
    and no row. The vectors of a label are dealt to block pairs, each of which answers both of its sides.
    """
    rows = vectors.filter("label IS NOT NULL AND v IS NOT NULL")
    blocks = rows.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = rows.join(blocks, "label").withColumn("k", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("label", F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"), F.col("vec_id").cast("long").alias("vec_id"), "v", "k")
    kinds = [pa.int64(), pa.float64(), pa.float64(), pa.int64()]

    def side(ids, v, other, w):
        """The best of other for each of ids, in parts of bounded size; other is in ascending order."""
        parts = []
        for a in range(0, len(ids), 512):
            sim = v[a : a + 512] @ w.T
            sim[ids[a : a + 512, None] == other[None]] = -np.inf
            near = np.round(sim, 9)
            at, one = near.argmax(1), np.arange(len(sim))
            parts.append((ids[a : a + 512], sim.max(1), near[one, at], other[at]))
        return [np.concatenate(x) for x in zip(*parts, strict=True)]

    def compare(key, table):
        _, i, j = (x.as_py() for x in key)
        table = table.sort_by("vec_id")
        ids, k = table.column("vec_id").to_numpy(), table.column("k").to_numpy()
        v = table.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        x, y = k == i, k == j
        found = [side(ids[a], v[a], ids[b], v[b]) for a, b in ([(x, y)] if i == j else [(x, y), (y, x)]) if a.any() and b.any()]
        out = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0)] * 4
        real = out[1] > -np.inf
        return pa.Table.from_arrays([pa.array(c[real], t, from_pandas=False) for c, t in zip(out, kinds, strict=True)], ["vec_id", "sim", "near", "best"])

    found = dealt.groupBy("label", "i", "j").applyInArrow(compare, "vec_id long, sim double, near double, best long")
    return found.groupBy("vec_id").agg(F.max("sim").alias("sim"), F.max_by("best", F.struct("near", -F.col("best"))).alias("best"))


def keyed(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()


def filter_pairs(pairs: DataFrame, people: DataFrame, blocked: DataFrame, introduced: DataFrame) -> DataFrame:
    """pairs with reason: the first filter that rejects them, or null. people: id, company_key, persona, sector, company_stage."""
    side = people.select("id", F.struct("company_key", "persona", "sector", "company_stage").alias("r"))
    rows = pairs.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")})
    rows = rows.join(side.select(F.col("id").alias("a"), F.col("r").alias("ra")), "a").join(side.select(F.col("id").alias("b"), F.col("r").alias("rb")), "b")
    rows = rows.join(keyed(blocked).withColumn("is_blocked", F.lit(True)), ["lo", "hi"], "left").join(keyed(introduced).withColumn("is_done", F.lit(True)), ["lo", "hi"], "left")
    same = F.coalesce((F.col("ra.company_key") == F.col("rb.company_key")) & (F.col("ra.company_key") != ""), F.lit(False))
    reason = F.when(same, "same_company").when(competitors("ra", "rb"), "competitors").when(F.col("is_blocked"), "blocked_pair").when(F.col("is_done"), "already_introduced")
    return rows.withColumn("reason", reason).drop("ra", "rb", "is_blocked", "is_done", "lo", "hi")


def rejections(people: DataFrame, filtered_out: int, blocked: DataFrame, introduced: DataFrame, scored: DataFrame) -> DataFrame:
    """(reason, n): pairs by the first filter that rejects them, people for incomplete_profile, all reasons listed.

    Pairs are counted, not listed: those of one company by group sizes, competitors within (sector, persona) groups by
    stage counts less those of one company, listed pairs by joins; the rest of all pairs that wasn't scored shares no signal.
    """
    c2 = lambda n: F.expr(f"sum({n} * ({n} - 1) div 2)")
    total = people.agg(F.expr("count(1) * (count(1) - 1) div 2").alias("n"))
    same = people.filter("company_key IS NOT NULL AND company_key != ''").groupBy("company_key").agg(F.count(F.lit(1)).alias("m")).agg(c2("m").alias("n"))
    founders = people.filter("persona = 'founder' AND sector NOT IN ('unknown', 'other', '') AND company_stage NOT IN ('unknown', '')")

    def rivals(keys: list[str]) -> DataFrame:
        m = founders.filter(" AND ".join(f"{k} IS NOT NULL AND {k} != ''" for k in keys) or "true").groupBy("sector", *keys, "company_stage").agg(F.count(F.lit(1)).alias("m"))
        x, y = m.withColumn("s", stage_index("company_stage")), m.withColumn("s", stage_index("company_stage"))
        near = x.filter("s > 0").select("sector", *keys, "m", (F.col("s") + 1).alias("s")).join(y.filter("s > 0").select("sector", *keys, F.col("m").alias("w"), "s"), ["sector", *keys, "s"])
        return m.agg(c2("m").alias("n")).unionByName(near.agg(F.sum(F.col("m") * F.col("w")).alias("n"))).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))

    one = lambda df: int(df.first()["n"] or 0)
    ids = people.select("id")
    listed = filter_pairs(keyed(blocked).unionByName(keyed(introduced)).distinct().select(F.col("lo").alias("a"), F.col("hi").alias("b")).join(ids.withColumnRenamed("id", "a"), "a").join(ids.withColumnRenamed("id", "b"), "b"), people, blocked, introduced)
    by = {r.reason: r.n for r in listed.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = {"same_company": one(same), "competitors": one(rivals([])) - one(rivals(["company_key"])), "incomplete_profile": filtered_out, "blocked_pair": by.get("blocked_pair", 0), "already_introduced": by.get("already_introduced", 0)}
    n["no_shared_signal"] = one(total) - sum(n[k] for k in ("same_company", "competitors", "blocked_pair", "already_introduced")) - scored.count()
    return people.sparkSession.createDataFrame([(k, n[k]) for k in REASONS], "reason string, n long")


def greedy_match(scored: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The edges that taking edges by (-score, a, b) accepts while both ends have room.

    Equal to the sequential rule: an edge among the best `room` live edges of both its ends is accepted by it too, and
    the best live edge always is one, so rounds of accepting those end at the same set. Each round is a written table.
    """
    live = materialize(scored.withColumns({"room_a": F.lit(capacity), "room_b": F.lit(capacity)}), "edges")
    taken = None
    columns = scored.columns
    while not live.isEmpty():
        ends = live.select("a", "b", "score", F.col("a").alias("v"), F.col("room_a").alias("room")).unionByName(live.select("a", "b", "score", F.col("b").alias("v"), F.col("room_b").alias("room")))
        rank = F.row_number().over(Window.partitionBy("v").orderBy(F.desc("score"), "a", "b"))
        # the constant bound first: it lets each task keep a person's best few edges before they are shuffled
        good = ends.withColumn("r", rank).filter(F.col("r") <= capacity).filter("r <= room").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter("n = 2").select("a", "b")
        new = materialize(live.join(good, ["a", "b"], "left_semi"), "accepted")
        taken = new.select(columns) if taken is None else taken.unionByName(new.select(columns))
        used = new.select(F.col("a").alias("v")).unionByName(new.select(F.col("b").alias("v"))).groupBy("v").agg(F.count(F.lit(1)).alias("u"))
        rest = live.join(new.select("a", "b"), ["a", "b"], "left_anti")
        rest = rest.join(used.select(F.col("v").alias("a"), F.col("u").alias("ua")), "a", "left").join(used.select(F.col("v").alias("b"), F.col("u").alias("ub")), "b", "left")
        rest = rest.withColumns({"room_a": F.col("room_a") - F.coalesce("ua", F.lit(0)), "room_b": F.col("room_b") - F.coalesce("ub", F.lit(0))}).filter("room_a > 0 AND room_b > 0")
        after = materialize(rest.select(live.columns), "edges")
        drop_table(live)
        live = after
    return taken if taken is not None else scored.limit(0)


def suggest(records: DataFrame, vectors: DataFrame, enrichment: DataFrame, blocked: DataFrame, introduced: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(suggestions, rejections by reason, funnel) for normalized canonical records."""
    ready = actionable(records)
    people = materialize(ready.select("id", "company_key").join(enrichment.select(F.col("person_id").alias("id"), "persona", "sector", "company_stage"), "id", "left"), "people")
    scored = score_pairs(vectors.join(people.select("id"), "id", "left_semi"))
    scored = materialize(filter_pairs(scored, people, blocked, introduced).filter("reason IS NULL").drop("reason"), "scored")
    picked = materialize(greedy_match(scored), "suggestions")
    everyone, n = records.count(), people.count()
    rejected = rejections(people, everyone - n, blocked, introduced, scored)
    covered = picked.select(F.col("a").alias("v")).union(picked.select("b")).distinct().count()
    funnel = {"people": everyone, "actionable_people": n, "people_filtered_out": everyone - n, "pairs_considered": n * (n - 1) // 2, "pairs_scored": scored.count(), "suggestions": picked.count(), "reciprocal": picked.filter("reciprocal").count(), "people_with_a_suggestion": covered}
    return picked, rejected, records.sparkSession.createDataFrame(list(funnel.items()), "metric string, n long")
