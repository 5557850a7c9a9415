"""From raw documents to packed sequences: five stages, each a written table that the next one reads.

Every stage works on all rows that its predecessor kept. The first four return the columns of documents, whatever
columns these are: all but id and text travel as one struct, so that no name clashes with those of the operators. Each
stage says below what becomes of nulls; repeated rows, long texts and ties are the operators' affair (see kinloom/llm);
an empty table gives an empty table in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm import langid, minhash, packing, quality, spans
from kinloom.llm.common import materialize


def nested(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns as the struct row."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*rest).alias("row") if rest else F.lit(0).alias("row"))


def flat(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents again."""
    return rows.select(*(F.col(c) if c in ("doc_id", "text") else F.col("row").getField(c).alias(c) for c in columns))


CARRIED = ["doc_id", "text", "row"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no learned language (null text, no letter); the rest get the predicted language.

    A null id or a null language is no reason to drop a row. Without any labelled row all are dropped.
    """
    found = langid.identify(nested(docs), langid.learn(docs), carry=CARRIED).filter("lang_pred != 'und'")
    if "lang" in docs.columns:
        found = found.withColumn("row", F.col("row").withField("lang", F.col("lang_pred")))
    return flat(found, docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules (null and empty texts among them) or that the forest finds anomalous.

    Null ids are judged by their text. Without labelled good documents the base rules alone decide.
    """
    forest = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return flat(quality.judge(nested(docs), forest, carry=CARRIED).filter("kept"), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each group of near duplicates.

    Rows that repeat id and text are one document, of which one row stays; rows without an id, or of one id with other
    texts, all stay, and so do documents without words.
    """
    gone = minhash.near_duplicates(docs).filter("NOT kept").select("doc_id").distinct()
    known = docs.filter("doc_id IS NOT NULL")
    kept = known.join(gone, "doc_id", "left_anti")
    repeated = known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
    if not repeated.isEmpty():
        repeated = materialize(repeated, "repeated")
        kept = kept.join(repeated, "doc_id", "left_anti").unionByName(kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))
    return kept.unionByName(docs.filter("doc_id IS NULL")).select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated spans out of the texts; n_chars follows. No row goes; rows without an id or a text stay as they are."""
    found = flat(spans.dedup(nested(docs), ["doc_id", "row"]), docs.columns)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences; one row a piece, with its token ids. A null text is its end id alone."""
    return packing.pack(docs, with_ids=True)


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", pack)]

#: The forest, the trees and the byte-level vocabulary have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
