import numpy as np
from pyspark.sql import functions as F

from kinloom.llm import quality


def test_threshold_is_of_all_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    forest = quality.learn(docs, labels, sample=60)
    rows = quality.judge(docs, forest).filter("NOT base_failed").join(labels.select("doc_id", "quality"), "doc_id").select(F.col("quality") == 1, "anomaly").collect()
    sides = [np.unique([r.anomaly for r in rows if r[0] == side], return_counts=True) for side in (True, False)]
    assert sides[0][1].sum() > 100  # more than the sample
    want = quality.calibrate(quality.Forest([], 1.0, 1.0), *sides).threshold
    assert want <= forest.threshold < want + 1 / quality.BINS
