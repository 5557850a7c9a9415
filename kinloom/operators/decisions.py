"""Human decisions: append-only logs, and states as folds of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.layers import latest

PAIR_STATES = {"merge": "auto_merged", "keep_both": "rejected", "not_sure": "pending"}
INTRO_STATES = {"approve": "approved", "dismiss": "dismissed", "block": "dismissed", "restore": "suggested"}


def _map(values: dict[str, str], c: str):
    return F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), F.col(c))


def ordered(log: DataFrame) -> DataFrame:
    """With a < b whatever the order in which a pair was written."""
    return log.withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b")})


def latest_decisions(log: DataFrame) -> DataFrame:
    """The last decision of each pair (decided_at, then the decision, break ties)."""
    return latest(ordered(log), ["a", "b"], ["decided_at", "decision"])


def apply_decisions(pairs: DataFrame, log: DataFrame) -> DataFrame:
    """Recomputed pairs under the latest decisions: machine verdicts may change, decisions stay. Only keep_both changes a recomputed state."""
    d = latest_decisions(log).select("a", "b", "decision", "decided_at")
    rows = pairs.join(d, ["a", "b"], "left")
    over = (F.col("decision") == "keep_both") & (F.col("verdict") == "same_person") & (F.col("review_state") == "auto_merged")
    rows = rows.withColumn("reason", F.when(over, F.concat("reason", F.lit(" [overruled by an operator: keep_both]"))).otherwise(F.col("reason")))
    return rows.withColumn("review_state", F.when(F.col("decision") == "keep_both", "rejected").otherwise(F.col("review_state")))


def decide(pairs: DataFrame, log: DataFrame) -> DataFrame:
    """The pairs as the latest decisions on them leave them at once: merge joins, keep_both rejects, not_sure reopens."""
    d = latest_decisions(log).select("a", "b", "decision", "decided_at")
    return pairs.join(d, ["a", "b"], "left").withColumn("review_state", F.coalesce(_map(PAIR_STATES, "decision"), "review_state"))


def pointers(log: DataFrame) -> DataFrame:
    """(id, merged_into) from human merges: the greater id points at the smaller one."""
    return latest_decisions(log).filter("decision = 'merge'").select(F.col("b").alias("id"), F.col("a").alias("merged_into"))


def revert_events(plans: DataFrame, pairs: DataFrame, canonical_id: str, now: str, note: str = "") -> DataFrame:
    """Decision rows that undo a merged group: keep_both for every scored pair inside it."""
    group = plans.filter((F.col("canonical_id") == canonical_id) & (F.col("status") == "merged"))
    ids = group.select(F.explode("source_ids").alias("id"))
    inner = pairs.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    return inner.select("a", "b", F.lit("keep_both").alias("decision"), F.lit(note).alias("note"), F.lit(now).alias("decided_at"))


def revert(plans: DataFrame, canonical_id: str, now: str) -> DataFrame:
    """The plans with a group reverted; a group that isn't merged is an error."""
    if plans.filter((F.col("canonical_id") == canonical_id) & (F.col("status") == "merged")).isEmpty():
        raise ValueError(f"no active merge of {canonical_id}")
    hit = (F.col("canonical_id") == canonical_id) & (F.col("status") == "merged")
    at = F.when(hit, F.lit(now)).otherwise(F.col("reverted_at") if "reverted_at" in plans.columns else F.lit(None).cast("string"))
    return plans.withColumns({"reverted_at": at, "status": F.when(hit, "reverted").otherwise(F.col("status"))})


def intro_states(intros: DataFrame, log: DataFrame) -> DataFrame:
    """Suggestions (a, b, ...) with status and decided_at by the latest decision of their unordered pair."""
    d = latest_decisions(log).select(F.col("a").alias("lo"), F.col("b").alias("hi"), "decision", "decided_at")
    rows = intros.drop("status", "decided_at").withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")}).join(d, ["lo", "hi"], "left")
    rows = rows.withColumn("status", F.coalesce(_map(INTRO_STATES, "decision"), F.lit("suggested")))
    return rows.withColumn("decided_at", F.when(F.col("decision") != "restore", F.col("decided_at"))).drop("lo", "hi", "decision")


def blocked_pairs(log: DataFrame) -> DataFrame:
    """(a, b) never to be suggested: blocked and not restored since. A later approval or dismissal doesn't lift a block."""
    marks = ordered(log).filter("decision IN ('block', 'restore')")
    return latest(marks, ["a", "b"], ["decided_at", "decision"]).filter("decision = 'block'").select("a", "b", "decided_at")


def approved_pairs(log: DataFrame) -> DataFrame:
    return latest_decisions(log).filter("decision = 'approve'").select("a", "b")
