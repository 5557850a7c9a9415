"""Clusters of merged pairs, and which values of a cluster survive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fold import strip
from .shared import connected_components

SIMPLE = ["linkedin_url", "title", "location", "source"]


def clusters(edges: DataFrame) -> DataFrame:
    """(id, cluster) of every record in an edge (a, b); a cluster is named by its least id."""
    return connected_components(edges).select(F.col("node").alias("id"), F.col("component").alias("cluster"))


def recency() -> Column:
    return F.struct(F.coalesce("created_at", F.lit("")), F.col("id"))


def _best(value: Column, order: Column, ok: Column) -> Column:
    """struct(value, id) of the row of greatest order among those that are ok."""
    return F.max_by(F.struct(value.alias("value"), F.col("id").alias("id")), F.when(ok, order))


def _sorted_set(value: Column, ok: Column) -> Column:
    return F.sort_array(F.collect_set(F.when(ok, value)))


def merge_plans(members: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """One row a cluster from its records (with cluster): canonical_id, source_ids, resolved values, provenance and conflicts.

    pairs: all scored pairs (a, b, stage), for decided_by. Clusters of one record are left out.
    """
    rec = recency()
    personal = F.col("mail.is_personal")
    raw = strip(F.col("full_name"))
    real = F.size(F.filter("name.tokens", lambda t: F.length(t) > 1))
    cased = F.when((raw != F.upper(raw)) & (raw != F.lower(raw)), 1).otherwise(0)
    fullness = F.struct(real, F.length("name.normalized"), cased, F.coalesce("created_at", F.lit("")), F.col("id"))
    bio = strip(F.col("bio"))
    listed = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("created_at", F.lit("")).alias("d"), "id", F.transform(c, strip).alias("v")))), lambda x: x["v"])))
    out = members.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by("id", F.struct(-F.col("completeness.score"), F.coalesce(F.nullif("created_at", F.lit("")), F.lit("9999")), F.col("id"))).alias("canonical_id"),
        F.sort_array(F.collect_list("id")).alias("source_ids"),
        *(_best(F.col(c), rec, F.col(c).isNotNull() & (F.col(c) != "")).alias(c) for c in SIMPLE),
        _best(F.col("email"), rec, F.col("mail").isNotNull() & ~personal).alias("work"),
        _best(F.col("email"), rec, F.col("mail").isNotNull() & personal).alias("private"),
        _sorted_set(F.col("mail.normalized"), F.col("mail").isNotNull() & ~personal).alias("works"),
        _sorted_set(F.col("mail.normalized"), F.col("mail").isNotNull() & personal).alias("privates"),
        _best(raw, fullness, F.col("name").isNotNull() & (raw != "")).alias("full_name"),
        F.min_by(F.struct(F.col("bio").alias("value"), F.col("id").alias("id")), F.when(bio != "", F.struct(-F.length(bio), F.col("id")))).alias("bio"),
        _best(F.col("company"), F.struct(F.length("company_key"), rec), F.col("company_key").isNotNull()).alias("company"),
        _sorted_set(F.col("company_key"), F.col("company_key").isNotNull()).alias("company_keys"),
        listed("needs").alias("needs"),
        listed("offers").alias("offers"),
        F.min(F.nullif("created_at", F.lit(""))).alias("first_contact_at"),
    ).filter("n > 1")
    longest = F.aggregate("company_keys", F.lit(""), lambda s, k: F.when(F.length(k) > F.length(s), k).otherwise(s))
    fits = F.forall("company_keys", lambda k: (k == F.col("longest")) | ((F.length(k) >= 3) & F.col("longest").startswith(k)))
    conflict = lambda field, values, detail: F.struct(F.lit(field).alias("field"), F.col(values).alias("values"), detail.alias("detail"))
    several = lambda values, label: F.when(F.size(values) > 1, conflict("email", values, F.concat(F.size(values).cast("string"), F.lit(f" different {label} addresses across the cluster"))))
    out = out.withColumn("longest", longest).withColumn("email", F.coalesce("work", "private"))
    conflicts = F.filter(F.array(several("works", "work"), several("privates", "personal"), F.when((F.size("company_keys") > 1) & ~fits, conflict("company", "company_keys", F.lit("records disagree on the employer after canonicalization")))), lambda x: x.isNotNull())
    fields = [*SIMPLE, "full_name", "email", "company", "bio"]
    provenance = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(f).alias("k"), F.col(f)["id"].alias("v")) for f in fields)), lambda e: e["v"].isNotNull()))
    out = out.withColumn("conflicts", conflicts).withColumn("provenance", provenance).withColumn("requires_review", F.size("conflicts") > 0)
    resolved = F.struct(*(F.col(f)["value"].alias(f) for f in fields), "needs", "offers", F.col("first_contact_at").alias("created_at"), F.col("source_ids").alias("source_record_ids"))
    out = out.withColumn("status", F.when(F.col("requires_review"), "pending_review").otherwise("merged"))
    plans = out.select("cluster", "canonical_id", "source_ids", resolved.alias("resolved"), "provenance", "conflicts", "first_contact_at", "requires_review", "status")
    if pairs is None:
        return plans.withColumn("decided_by", F.lit("unknown"))
    side = members.select("id", "cluster")
    inner = pairs.select("a", "b", "stage").join(side.select(F.col("id").alias("a"), "cluster"), "a").join(side.select(F.col("id").alias("b"), F.col("cluster").alias("other")), "b").filter("cluster = other")
    stages = inner.groupBy("cluster").agg(F.collect_set("stage").alias("s"))
    by = F.when((F.size("s") == 1) & F.array_contains("s", "deterministic"), "stage1_exact").when(F.array_contains("s", "llm"), "llm").when(F.array_contains("s", "fuzzy"), "stage2_fuzzy").otherwise("mixed")
    return plans.join(stages.select("cluster", by.alias("decided_by")), "cluster", "left").withColumn("decided_by", F.coalesce("decided_by", F.lit("mixed")))


def build_plans(records: DataFrame, pairs: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """Plans from routed pairs and the latest human decisions (a, b, decision): keep_both cuts its edge, merge adds it."""
    edges = pairs.filter("verdict = 'same_person' AND review_state = 'auto_merged'").select("a", "b")
    if decisions is not None:
        edges = edges.join(decisions.filter("decision = 'keep_both'").select("a", "b"), ["a", "b"], "left_anti").unionByName(decisions.filter("decision = 'merge'").select("a", "b")).distinct()
    return merge_plans(records.join(clusters(edges), "id"), pairs)


def merge_pointers(plans: DataFrame) -> DataFrame:
    """(id, merged_into) of the records that a merged cluster hides behind its canonical one."""
    rows = plans.filter("status = 'merged'").select("canonical_id", F.explode("source_ids").alias("id"))
    return rows.filter("id != canonical_id").select("id", F.col("canonical_id").alias("merged_into"))


def merge_state(plans: DataFrame, history: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(groups, pointers) after a run: its plans as active groups, reverted ones of earlier runs kept as they are, and who is merged into whom."""
    fresh = plans.withColumns({"created_at": F.lit(now), "reverted_at": F.lit(None).cast("string")})
    old = history.filter("reverted_at IS NOT NULL")
    return fresh.unionByName(old.select(fresh.columns)), merge_pointers(plans)


def group_counts(groups: DataFrame) -> DataFrame:
    """One row: groups merged, waiting for review, and reverted."""
    state = {"merged": "merged", "pending": "pending_review", "reverted": "reverted"}
    return groups.agg(*(F.count_if(F.col("status") == v).alias(k) for k, v in state.items()))
