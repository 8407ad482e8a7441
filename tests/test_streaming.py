"""The fitted state model applied to a streaming source gives the batch result."""

import os

from pyspark.sql import functions as F

from churnscope.operators import binning
from churnscope.plans import stages
from churnscope.streaming.scoring import score_states

SF = os.environ.get("CHURNSCOPE_TEST_SF", "/root/testdata/sf0.001")


def test_stream_scoring_matches_batch(spark, tmp_path):
    base, model = stages.state_model(spark, SF)
    thresholds = binning.collect_thresholds(model)
    src = str(tmp_path / "engineered")
    base.write.parquet(src)
    batch = score_states(spark.read.parquet(src), thresholds)
    stream = score_states(spark.readStream.schema(batch.select(*base.columns).schema).parquet(src), thresholds)
    q = (stream.select("customer_id", "behavioral_archetype", "value_density_state")
         .writeStream.format("memory").queryName("scored").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "ckpt")).start())
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, spark.sql("SELECT * FROM scored").collect()))
    want = sorted(map(tuple, batch.select("customer_id", "behavioral_archetype", "value_density_state").collect()))
    assert got == want and len(got) > 0
    assert batch.where(F.col("behavioral_archetype").isNull()).count() == 0
