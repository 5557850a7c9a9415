"""Queries that compare whole tables: other blocks, planted quotes, and single checks against shared ones."""

import duckdb
import pytest
from pyspark.sql import functions as F

from kinloom.operators import enrichment, matching
from kinloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("block", [16, matching.LABEL_BLOCK])
def test_best_match_is_of_all_vectors(spark, block):
    want = duckdb.sql(f"""WITH u AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-9)) AS v FROM '{SF}/embeddings.parquet')
      SELECT n.vec_id, max(list_dot_product(n.v, o.v)) >= 0.68 AS strong, arg_max(o.vec_id, (round(list_dot_product(n.v, o.v), 9), -o.vec_id)) AS best FROM u n JOIN u o ON o.label = n.label AND o.vec_id != n.vec_id GROUP BY n.vec_id""").fetchall()
    u = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "label", matching.unit(F.col("embedding")).alias("v"))
    got = [tuple(r) for r in matching.best_of_label(u, block).select("vec_id", F.col("sim") >= 0.68, "best").collect()]
    assert len(want) == 500 and sorted(got) == sorted(want)
    if block == matching.LABEL_BLOCK:
        assert sorted(map(tuple, catalog.QUERIES["vec_best_match"](spark, SF).select("vec_id", "strong", "best").collect())) == sorted(want)


def test_every_document_meets_every_whole_quote(spark, tmp_path):
    texts = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(7).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30).collect()
    planted = [(d.doc_id, f"{d.text} {texts[i % 7].text.upper()}  {texts[(i + 3) % 7].text[:40]}") for i, d in enumerate(docs)]
    spark.createDataFrame(planted, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = duckdb.sql(f"""WITH q AS (SELECT trim(text) AS quote, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS folded FROM '{tmp_path}/benchmark.parquet/*.parquet'), d AS (SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS folded FROM '{tmp_path}/documents.parquet/*.parquet')
      SELECT d.doc_id, count(*), sum(CASE WHEN length(q.quote) >= 4 AND contains(d.folded, q.folded) THEN 1 ELSE 0 END)::BIGINT FROM d JOIN q ON true GROUP BY d.doc_id""").fetchall()
    got = catalog.QUERIES["evidence_verify"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want) and all(v >= 1 for _, _, v in want)


def test_shared_quotes_are_checked_as_single_ones(spark):
    null = F.lit(None).cast("string")
    rows = spark.createDataFrame([("a", "Café  owner in Rome", ["funds"]), ("b", None, []), ("c", "rome", None)], "id string, bio string, needs array<string>")
    rows = rows.select("id", "bio", "needs", *(null.alias(c) for c in ("full_name", "email", "linkedin_url", "company", "title", "location")), F.array().cast("array<string>").alias("offers"))
    quotes = [("bio", "cafe owner"), ("bio", " Rome "), ("bio", "Rome"), ("bio", "in"), ("bio", None), ("bio", "日本語の話"), ("needs", "日本語の話"), ("bio", "e owner in"), ("bio", "owner in rome"), ("needs", "funds"), ("nowhere", "Rome"), (None, "Rome")]
    evidence = F.array(*(F.struct(F.lit(f).cast("string").alias("field"), F.lit(q).cast("string").alias("quote"), F.lit("persona").alias("supports")) for f, q in quotes))
    want = enrichment.verify_evidence(rows, rows.select(F.col("id").alias("person_id"), evidence.alias("evidence"))).select("person_id", "total", "verified").collect()
    for block, characters in ((1, 0), (enrichment.QUOTES, 0), (1, enrichment.CHARACTERS)):
        got = enrichment.verify_shared(rows, spark.createDataFrame(quotes, "field string, quote string"), block, characters).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_people_search_returns_all_it_finds(spark, tmp_path):
    con = duckdb.connect()
    con.sql("CREATE VIEW customer AS SELECT * FROM '/root/testdata/sf0.1/customer.parquet' WHERE c_custkey % 12 IN (6, 7)")
    con.sql(f"CREATE VIEW nation AS SELECT * FROM '{SF}/nation.parquet'")
    for t in ("customer", "nation"):
        con.sql(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    want = con.sql(catalog.SQL["people_search"]).fetchall()
    got = catalog.QUERIES["people_search"](spark, str(tmp_path)).select("id", "full_name", "persona", "total").collect()
    assert len(want) > 500 and [tuple(r) for r in got] == sorted(want)
