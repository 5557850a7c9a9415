import zlib

import corpus_pipeline


def test_the_pipeline_ends_with_the_token_ids(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = corpus_pipeline.pack(spark, docs, "").collect()
    assert rows and all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
