"""Pair scoring and routing: exact identifiers first, similarity for the rest, adjudication for what is unclear."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import blend, name_score, token_set_ratio, token_sort_ratio
from ..functions.tables import ESCALATE_AT, MERGE_AT
from ..functions.text import render_pair
from .shared import numbered

SIDE = ["id", "full_name", "email", "linkedin_url", "company", "title", "location", "bio", "name", "mail", "slug", "company_key", "title_canonical"]


def attach(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Pairs (a, b, ...) with both records as structs ra and rb."""
    side = records.select(F.col("id"), F.struct(*SIDE).alias("r"))
    left = pairs.join(side.select(F.col("id").alias("a"), F.col("r").alias("ra")), "a")
    return left.join(side.select(F.col("id").alias("b"), F.col("r").alias("rb")), "b")


def exact(pairs: DataFrame) -> DataFrame:
    """With exact: exact_email, exact_linkedin or null. Missing identifiers equal nothing."""
    x, y = F.col("ra"), F.col("rb")
    return pairs.withColumn("exact", F.when(x["mail"]["normalized"] == y["mail"]["normalized"], "exact_email").when(x["slug"] == y["slug"], "exact_linkedin"))


def fuzzy(pairs: DataFrame, only=None) -> DataFrame:
    """(only: where it holds; elsewhere the kernels get empty texts) With name_sim, company_sim (null: can't be compared), title_agrees (null: one is missing), score and title_vetoed."""
    x, y = F.col("ra"), F.col("rb")
    part = lambda c: c if only is None else F.when(only, c)
    base = token_set_ratio(F.coalesce(part(x["name"]["normalized"]), F.lit("")), F.coalesce(part(y["name"]["normalized"]), F.lit("")))
    company = token_sort_ratio(part(x["company_key"]), part(y["company_key"]))
    rows = pairs.withColumns({"base": base, "company_sim": company})
    rows = rows.withColumn("name_sim", name_score("ra", "rb", F.col("base"))).withColumn("title_agrees", x["title_canonical"] == y["title_canonical"])
    rows = rows.withColumn("blend", blend(F.col("name_sim"), F.col("company_sim"), F.col("title_agrees")))
    return rows.withColumn("score", F.col("blend.score")).withColumn("title_vetoed", F.col("blend.title_vetoed")).drop("blend", "base")


PAIR = ["a", "b", "stage", "method", "verdict", "review_state", "score", "confidence", "reason", "llm_used", "keys"]


def scored(records: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs settled by identifiers, all others scored); the kernel only sees the latter."""
    rows = exact(attach(candidates, records))
    return rows.filter("exact IS NOT NULL"), fuzzy(rows.filter("exact IS NULL"))


def _text(c: str):
    return F.coalesce(F.regexp_replace(F.round(c, 2).cast("string"), r"\.0$", ".0"), F.lit("None"))


def route(records: DataFrame, candidates: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """PAIR rows; dropped pairs are left out.

    verdicts: (a, b, verdict, confidence, reason) of an adjudicator; with it, a pair that it skips stays insufficient.
    """
    rows = fuzzy(exact(attach(candidates, records)), F.col("exact").isNull())
    same, s = F.col("exact").isNotNull(), F.col("score")
    rows = rows.withColumn("score", F.when(same, 100.0).otherwise(s)).filter(F.col("score") >= ESCALATE_AT)
    auto, judged = ~same & (F.col("score") >= MERGE_AT), verdicts is not None
    agrees = F.when(F.col("title_agrees"), "True").when(~F.col("title_agrees"), "False").otherwise("None")
    by_score = F.concat(F.lit("name "), _text("name_sim"), F.lit(", company "), _text("company_sim"), F.lit(", title agrees: "), agrees)
    rows = rows.withColumn("step", F.when(same, 1).when(auto, 2).otherwise(3)).withColumn("how", F.when(same, F.when(F.col("exact") == "exact_email", "identical normalized email").otherwise("identical linkedin slug")).when(auto, by_score)).select("a", "b", "keys", "exact", "score", "step", "how")
    if judged:
        v = verdicts.select("a", "b", F.col("verdict").alias("v"), F.col("confidence").alias("vc"), F.col("reason").alias("vr"))
        rows = rows.join(v, ["a", "b"], "left")
    else:
        rows = rows.withColumns({"v": F.lit(None).cast("string"), "vc": F.lit(None).cast("double"), "vr": F.lit("escalated to stage 3 but no LLM provider was configured")})

    def by_step(one, two, three):
        return F.when(F.col("step") == 1, one).when(F.col("step") == 2, two).otherwise(three)

    state = F.when(F.col("v") == "same_person", "auto_merged").when(F.col("v") == "different_people", "rejected").otherwise("pending")
    out = {
        "stage": by_step(F.lit("deterministic"), F.lit("fuzzy"), F.lit("llm" if judged else "fuzzy")),
        "method": by_step(F.col("exact"), F.lit("fuzzy_auto"), F.lit("llm_adjudication" if judged else "escalated_not_adjudicated")),
        "verdict": by_step(F.lit("same_person"), F.lit("same_person"), F.coalesce("v", F.lit("insufficient_evidence"))),
        "review_state": by_step(F.lit("auto_merged"), F.lit("auto_merged"), state),
        "confidence": by_step(F.lit(1.0), F.round(F.col("score") / 100, 3), F.col("vc")),
        "reason": by_step(F.col("how"), F.col("how"), F.coalesce("vr", F.lit("no verdict returned for this pair"))),
        "llm_used": (F.col("step") == 3) & F.lit(judged),
    }
    return rows.withColumns(out).select(PAIR)


def batches(pairs: DataFrame, size: int = 10) -> DataFrame:
    """Pairs to adjudicate, numbered in order of (a, b) through fixed batches."""
    return numbered(pairs, ["a", "b"]).select("*", F.expr(f"n div {size}").alias("batch"), (F.col("n") % size).alias("pair_index")).drop("n")


def prompts(pairs: DataFrame, head: str, size: int = 10) -> DataFrame:
    """(batch, prompt) of scored pairs (a, b, score, ra, rb): the head, then every pair of the batch as a numbered block."""
    rows = batches(pairs, size).select("batch", "pair_index", render_pair(F.col("pair_index"), F.col("score")).alias("block"))
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("pair_index", "block"))), lambda x: x["block"])
    return rows.groupBy("batch").agg(F.concat(F.lit(head), F.array_join(blocks, "\n\n")).alias("prompt"))


def funnel(records: DataFrame, candidates: DataFrame, skipped: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """(metric, n) of all stages."""
    settled, rest = scored(records, candidates)
    people = records.agg(F.count(F.lit(1)).alias("records")).withColumn("possible_pairs", F.expr("records * (records - 1) div 2"))
    s = F.col("score")
    two = rest.agg(
        F.count(F.lit(1)).alias("stage2_scored"),
        F.count_if(s >= MERGE_AT).alias("stage2_auto_merged"),
        F.count_if((s >= ESCALATE_AT) & (s < MERGE_AT)).alias("stage2_escalated"),
        F.count_if(s < ESCALATE_AT).alias("stage2_dropped"),
        F.count_if(F.col("title_vetoed") & (s >= ESCALATE_AT) & (s < MERGE_AT)).alias("stage2_title_vetoed"),
    )
    parts = [people, settled.agg(F.count(F.lit(1)).alias("stage1_merged")), two, skipped.agg(F.count(F.lit(1)).alias("blocking_buckets_skipped")), candidates.agg(F.count(F.lit(1)).alias("candidate_pairs"))]
    if verdicts is not None:
        llm = route(records, candidates, verdicts).filter("stage = 'llm'")
        parts.append(llm.agg(*(F.count_if(F.col("verdict") == v).alias(f"stage3_{v}") for v in ("same_person", "different_people", "insufficient_evidence")), F.ceil(F.count(F.lit(1)) / 10).alias("stage3_batches")))
    rows = None
    for p in parts:
        names = ", ".join(f"'{c}', CAST(`{c}` AS BIGINT)" for c in p.columns)
        part = p.selectExpr(f"stack({len(p.columns)}, {names}) AS (metric, n)")
        rows = part if rows is None else rows.unionByName(part)
    return rows


def explain_miss(truth: DataFrame, records: DataFrame, candidates: DataFrame) -> DataFrame:
    """(a, b, outcome, why) of true pairs that weren't merged automatically."""
    settled, rest = scored(records, candidates)
    s = F.col("score")
    outcome = F.when(s >= MERGE_AT, "stage2_auto_merged").when(s >= ESCALATE_AT, "stage2_escalated").otherwise("stage2_dropped")
    known = settled.select("a", "b", F.lit("stage1_merged").alias("outcome"), F.lit(100.0).alias("score")).unionByName(rest.select("a", "b", outcome.alias("outcome"), "score", "name_sim", "company_sim"), allowMissingColumns=True)
    from .blocking import blocking_keys

    keys = blocking_keys(records).groupBy("id").agg(F.collect_set("key").alias("ks"))
    rows = truth.select("a", "b").join(known, ["a", "b"], "left").join(keys.select(F.col("id").alias("a"), F.col("ks").alias("ka")), "a", "left").join(keys.select(F.col("id").alias("b"), F.col("ks").alias("kb")), "b", "left")
    shared = F.coalesce(F.arrays_overlap("ka", "kb"), F.lit(False))
    why = F.when(F.col("outcome").isNull() & shared, "never became a candidate: blocking bucket too large").when(F.col("outcome").isNull(), "never became a candidate: no shared blocking key").when(F.col("outcome") == "stage2_dropped", F.concat(F.lit("scored "), s.cast("string"), F.lit(" < ESCALATE_FLOOR (name "), _text("name_sim"), F.lit(", company "), _text("company_sim"), F.lit(")"))).when(F.col("outcome") == "stage2_escalated", F.concat(F.lit("escalated at "), s.cast("string"), F.lit(", awaiting stage 3"))).otherwise(F.col("outcome"))
    return rows.select("a", "b", F.coalesce("outcome", F.lit("never_a_candidate")).alias("outcome"), why.alias("why"))

