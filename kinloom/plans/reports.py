"""What an operator asks of the state: queues, logs, searches and counts. State is a dict of tables.

people (id, raw columns, merged_into, completeness struct), pairs (routed, a < b), decisions (a, b, decision, decided_at),
plans (merge plans), enrichment, scores, applications, intros (with status).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.decisions import latest_decisions
from ..operators.evaluate import same_group
from ..operators.records import describe_gaps

DAILY = 10
STATUSES = ["suggested", "approved", "dismissed"]


def decided(state: dict[str, DataFrame]) -> DataFrame:
    return latest_decisions(state["decisions"]).select("a", "b", "decision", "decided_at")


def held_pairs(pairs: DataFrame, plans: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that lie inside one group that waits for review."""
    ids = plans.filter("status = 'pending_review'").select(F.col("canonical_id").alias("cluster"), F.explode("source_ids").alias("id"))
    return same_group(pairs.select("a", "b"), ids).select("a", "b").distinct()


def needs_decision(state: dict[str, DataFrame]) -> DataFrame:
    """Undecided pairs that the pipeline couldn't settle: it abstained, or their group holds a conflict."""
    open_ = state["pairs"].join(decided(state), ["a", "b"], "left_anti")
    held = held_pairs(open_, state["plans"]).withColumn("held", F.lit(True))
    return open_.join(held, ["a", "b"], "left").filter("verdict = 'insufficient_evidence' OR held").drop("held")


def _names(rows: DataFrame, people: DataFrame) -> DataFrame:
    side = people.select("id", "full_name", "company")
    for k in ("a", "b"):
        rows = rows.join(side.select(F.col("id").alias(k), F.col("full_name").alias(f"{k}_name"), F.col("company").alias(f"{k}_company")), k)
    return rows


def pending(state: dict[str, DataFrame]) -> DataFrame:
    return _names(needs_decision(state), state["people"]).orderBy(F.desc("score"), "a", "b")


def duplicates(state: dict[str, DataFrame], status: str = "pending") -> DataFrame:
    """Pairs of a status (pending, decided, all) with both records, decisions and the conflicts that hold them."""
    if status == "pending":
        rows = needs_decision(state).withColumns({"decision": F.lit(None).cast("string"), "decided_at": F.lit(None).cast("string")})
    else:
        rows = state["pairs"].join(decided(state), ["a", "b"], "inner" if status == "decided" else "left")
    held = state["plans"].filter("status = 'pending_review'").select(F.explode("source_ids").alias("a"), "conflicts")
    held = held.groupBy("a").agg(F.first("conflicts").alias("conflicts"))
    return _names(rows, state["people"]).join(held, "a", "left").orderBy(F.desc("score"), "a", "b")


def incomplete(people: DataFrame) -> DataFrame:
    """Canonical people with gaps, blocked ones first."""
    c = F.col("completeness")
    rows = people.filter("merged_into IS NULL").filter(c["blocked"] | (c["score"] < 1.0))
    return rows.select("id", "full_name", c["score"].alias("score"), c["missing"].alias("missing"), c["blocked"].alias("blocked"), c["blocked_reason"].alias("blocked_reason"), describe_gaps(c["missing"]).alias("summary")).orderBy(F.desc("blocked"), "score", "id")


def applicants(state: dict[str, DataFrame], for_queue: bool = False) -> DataFrame:
    rows = state["scores"].join(state["people"].select(F.col("id").alias("person_id"), "full_name", "company", "title", "location"), "person_id")
    rows = rows.join(state["enrichment"].select("person_id", F.col("confidence").alias("enrichment_confidence")), "person_id", "left")
    rows = rows.withColumn("enrichment_missing", F.coalesce("enrichment_confidence", F.lit(0.0)) == 0)
    first = F.when(F.col("band") == "review", 0).when(F.col("band") == "strong", 1).otherwise(2)
    return rows.orderBy(first, F.desc("total"), "person_id") if for_queue else rows.orderBy(F.desc("total"), "person_id")


def todays_intros(state: dict[str, DataFrame], limit: int = DAILY) -> DataFrame:
    """The best suggestions of the day (a top-k report)."""
    return _names(state["intros"].filter("status = 'suggested'"), state["people"]).orderBy(F.desc("score"), "a", "b").limit(limit)


def introductions(state: dict[str, DataFrame], status: str = "suggested") -> DataFrame:
    rows = state["intros"] if status == "all" else state["intros"].filter(F.col("status") == status)
    return _names(rows, state["people"]).orderBy(F.desc("score"), "a", "b")


def status_counts(intros: DataFrame) -> DataFrame:
    """(status, n) of every status, zero included."""
    names = intros.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    return names.join(intros.groupBy("status").agg(F.count(F.lit(1)).alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def search(state: dict[str, DataFrame], q: str = "", persona: str = "", band: str = "", incomplete: bool = False, limit: int | None = 500) -> DataFrame:
    """Canonical people whose joined fields hold q, with persona, band and total, the first limit by id (a top-k report); found: how many there are without it."""
    c = F.col("completeness")
    rows = state["people"].filter("merged_into IS NULL")
    enriched = state["enrichment"].filter("confidence > 0").select(F.col("person_id").alias("id"), "persona")
    rows = rows.join(enriched, "id", "left").join(state["scores"].select(F.col("person_id").alias("id"), "band", "total"), "id", "left")
    needle = q.strip().lower()
    if needle:
        text = F.concat_ws(" ", *(F.coalesce(F.trim("full_name") if f == "full_name" else F.col(f), F.lit("")) for f in ("full_name", "company", "title", "email", "location")))
        rows = rows.filter(F.lower(text).contains(needle))
    if persona:
        rows = rows.filter(F.col("persona") == persona)
    if band:
        rows = rows.filter(F.col("band") == band)
    if incomplete:
        rows = rows.filter(c["blocked"] | (c["score"] < 1.0))
    rows = rows.withColumn("found", F.lit(rows.count()).cast("long")).orderBy("id")
    return rows if limit is None else rows.limit(limit)


def person(state: dict[str, DataFrame], person_id: str) -> dict[str, DataFrame]:
    """Tables about one person: the record, its enrichment, score, application, suggestions with the other side, merged records."""
    one = lambda name, key="person_id": state[name].filter(F.col(key) == person_id)
    intros = state["intros"]
    mine = intros.filter(F.col("a") == person_id).withColumn("other", F.col("b")).unionByName(intros.filter((F.col("b") == person_id) & (F.col("a") != person_id)).withColumn("other", F.col("a")))
    others = state["people"].select(F.col("id").alias("other"), F.col("full_name").alias("other_name"), F.col("company").alias("other_company"))
    return {"person": one("people", "id"), "enrichment": one("enrichment").filter("confidence > 0"), "score": one("scores"), "application": one("applications"), "suggestions": mine.join(others, "other", "left").orderBy(F.desc("score"), "a", "b"), "merged": one("people", "merged_into")}


def merges(plans: DataFrame, limit: int = 100) -> DataFrame:
    """The log of merges, newest first (a top-k report)."""
    return plans.filter("status = 'merged'").orderBy(F.desc("created_at"), F.desc("canonical_id")).limit(limit)


def queue_counts(state: dict[str, DataFrame]) -> DataFrame:
    """(metric, n): what waits and what was settled without a person."""
    undecided = state["pairs"].join(decided(state), ["a", "b"], "left_anti")
    gaps = incomplete(state["people"]).agg(F.count(F.lit(1)).alias("incomplete"), F.count_if("blocked").alias("blocked"))
    parts = [
        needs_decision(state).agg(F.count(F.lit(1)).alias("pending")),
        undecided.agg(F.count_if(F.col("verdict") != "insufficient_evidence").alias("auto_resolved")),
        state["plans"].agg(F.count_if(F.col("status") == "merged").alias("merged_clusters")),
        gaps,
        state["scores"].agg(F.count(F.lit(1)).alias("applicants"), F.count_if(F.col("band") == "review").alias("needs_review"), F.count_if(F.col("band") == "strong").alias("strong")),
        state["intros"].agg(F.count_if(F.col("status") == "suggested").alias("introductions")),
        state["enrichment"].agg(F.count_if(F.col("confidence") > 0).alias("enriched")),
        state["people"].agg(F.count_if(F.col("merged_into").isNull()).alias("canonical")),
    ]
    return stacked(parts)


def by_count(rejections: DataFrame) -> DataFrame:
    """Reasons (reason, n), the most frequent first, with their place; reasons are a short closed list."""
    return rejections.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "reason"))).orderBy("place")


def as_json(rows: DataFrame) -> DataFrame:
    """Rows as JSON objects, one a row (column report)."""
    return rows.select(F.to_json(F.struct("*")).alias("report"))


def stacked(parts: list[DataFrame]) -> DataFrame:
    """One-row tables of counts as (metric, n)."""
    out = None
    for p in parts:
        names = ", ".join(f"'{c}', CAST(`{c}` AS BIGINT)" for c in p.columns)
        rows = p.selectExpr(f"stack({len(p.columns)}, {names}) AS (metric, n)")
        out = rows if out is None else out.unionByName(rows)
    return out


def health(state: dict[str, DataFrame]) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    has = lambda df, c, name: F.count_if(text(c)).alias(name) if c in df.columns else F.lit(0).alias(name)
    return stacked([
        state["people"].agg(F.count(F.lit(1)).alias("people"), F.count_if(F.col("merged_into").isNull()).alias("canonical")),
        state["enrichment"].agg(F.count(F.lit(1)).alias("enrichment"), F.count_if(F.col("confidence") > 0).alias("enriched")),
        state["scores"].agg(F.count(F.lit(1)).alias("applicant_scores"), has(state["scores"], "explanation", "explained")),
        state["intros"].agg(F.count(F.lit(1)).alias("introductions"), has(state["intros"], "why", "intros_with_copy"), F.count_if(F.col("status") == "suggested").alias("intros_suggested")),
    ])
