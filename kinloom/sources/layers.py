"""Loads and writes. Layers are immutable tables, one a stage, keyed by id; a new load replaces rows by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import string_list

PEOPLE = "id string, full_name string, email string, linkedin_url string, company string, title string, location string, bio string, source string, needs array<string>, offers array<string>, created_at string"
APPLICATIONS = "person_id string, building_now string, why_join string, contribution string, referred_by string, submitted_at string"
DECISIONS = "a string, b string, decision string, note string, decided_at string"
ANSWERS = "key string, provider string, model string, task string, created_at string, request string, response string"


def read_people(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of people."""
    return spark.read.schema(PEOPLE).option("multiLine", True).json(path)


def read_applications(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(APPLICATIONS).option("multiLine", True).json(path)


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by the order columns; a pre-aggregated max, not a sort of whole groups."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order, *(c for c in rest if c not in order))).alias("r"))
    return best.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest)).select(rows.columns)


def upsert(current: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """current with rows replaced by new ones of equal key; of several new ones of a key, the greatest by all columns."""
    once = latest(new, [key], [c for c in new.columns if c != key])
    return current.join(once, key, "left_anti").select(current.columns).unionByName(once.select(current.columns))


def load_people(current: DataFrame, new: DataFrame, now: str) -> DataFrame:
    """Replaces people by id; a reload forgets a merge pointer."""
    return upsert(current, new.withColumn("ingested_at", F.lit(now)).withColumn("merged_into", F.lit(None).cast("string")))


def load_applications(current: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(current, new, "person_id")


def parse_lists(people: DataFrame) -> DataFrame:
    """needs and offers as arrays where they come as text."""
    out = people
    for c in ("needs", "offers"):
        if dict(people.dtypes)[c] == "string":
            out = out.withColumn(c, string_list(F.col(c)))
        else:
            out = out.withColumn(c, F.coalesce(F.filter(c, lambda x: x.isNotNull() & (F.trim(x) != "")), F.array().cast("array<string>")))
    return out


def canonical_people(people: DataFrame) -> DataFrame:
    return people.filter("merged_into IS NULL")


def write_layer(df: DataFrame, path: str) -> None:
    """Truncate and insert."""
    df.write.mode("overwrite").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A report as JSON, an object a line."""
    df.write.mode("overwrite").json(path)


def embedding_rows(vectors: DataFrame, model: str, now: str) -> DataFrame:
    """Rows of the embedding layer: the profile vector of each person (id, profile) as 32-bit floats, its size and its model."""
    v = F.col("profile").cast("array<float>")
    return vectors.select(F.col("id").alias("person_id"), F.lit("profile").alias("kind"), v.alias("vector"), F.size(v).alias("dim"), F.lit(model).alias("model"), F.lit(now).alias("created_at"))


def rewrite_keeping(current: DataFrame, decided: DataFrame, keys: list[str]) -> DataFrame:
    """Rows decided by a person as they are, and recomputed ones of all other keys."""
    return current.join(decided.select(*keys), keys, "left_anti").select(decided.columns).unionByName(decided)


def append_run(runs: DataFrame, stage: str, started: str, llm_calls: int, cache_hits: int, records_in: int, records_out: int, notes: dict[str, int]) -> DataFrame:
    """The run log with one run more; its id is one above the greatest."""
    n = (runs.agg(F.max("id")).first()[0] or 0) + 1
    return runs.unionByName(runs.sparkSession.createDataFrame([(n, stage, started, llm_calls, cache_hits, records_in, records_out, notes)], runs.schema))


RUNS = "id long, stage string, started_at string, llm_calls long, cache_hits long, records_in long, records_out long, notes map<string,long>"


def last_run(runs: DataFrame, stage: str) -> DataFrame:
    return latest(runs.filter(F.col("stage") == stage).withColumn("notes", F.to_json("notes")), ["stage"], ["id"])


def read_answers(spark: SparkSession, directory: str, lines: bool = False) -> DataFrame:
    """Cached answers with the time of their file: a folder of JSON files of one answer each, or (lines) what write_answers() wrote."""
    raw = spark.read.schema(ANSWERS).option("multiLine", not lines).option("recursiveFileLookup", True).json(directory)
    return raw.withColumn("modified", F.col("_metadata.file_modification_time"))


def write_answers(answers: DataFrame, directory: str) -> None:
    """Appends answers as JSON, one a line."""
    answers.select(*(x.split()[0] for x in ANSWERS.split(", "))).write.mode("append").json(directory)


def answer_stats(answers: DataFrame) -> DataFrame:
    return answers.groupBy("task").agg(F.count(F.lit(1)).alias("entries"))


def providers(answers: DataFrame, sample: int = 40) -> DataFrame:
    """Providers and models among the first `sample` answers of each task by key (a report on a sample by design)."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("task").orderBy("key"))
    return answers.withColumn("rank", rank).filter(F.col("rank") <= sample).select("provider", "model").distinct()


def harvest(answers: DataFrame) -> DataFrame:
    """Enrichment per person from cached answers of single people or batches; the newest file wins, its origin is kept."""
    person = "struct<person_id: string, persona: string, seniority: string, company_stage: string, sector: string, geography: string, needs: array<string>, offers: array<string>, confidence: double, evidence: array<struct<field: string, quote: string, supports: string>>>"
    one = F.from_json("response", person)
    many = F.from_json("response", f"struct<people: array<{person}>>")["people"]
    rows = answers.select("provider", "model", "modified", "key", F.explode(F.coalesce(many, F.array(one))).alias("p")).filter("p.person_id IS NOT NULL")
    best = rows.groupBy(F.col("p.person_id").alias("person_id")).agg(F.max_by(F.struct("provider", "model", "p"), F.struct("modified", "key")).alias("r"))
    return best.select("person_id", *(F.col(f"r.p.{c}").alias(c) for c in ("persona", "seniority", "company_stage", "sector", "geography", "needs", "offers", "confidence", "evidence")), "r.provider", "r.model")
