from pyspark.sql import functions as F

from meridian.operators import density
from meridian.streaming import jobs


def _pings(spark):
    """A thousand cells of nine ids each in one hour."""
    return spark.range(9000).select(F.concat(F.lit("user-"), "id").alias("id"), F.lit("2024-01-01 10:00:00").cast("timestamp").alias("event_time"), (F.col("id") % 1000 / 1000 + 10.0005).alias("lat"), F.lit(20.0005).alias("lng"))


def test_few_visitors_are_estimated_as_they_are(spark):
    got = density.hourly(_pings(spark), approximate=True)
    assert got.count() == 1000 and got.filter("visitors <> 9").count() == 0


def test_few_visitors_are_estimated_as_they_are_on_a_stream(spark, tmp_path):
    rows = _pings(spark)
    rows.write.parquet(str(tmp_path / "in"))
    feed = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    jobs.run_available(jobs.hourly_density(feed), str(tmp_path / "cp"), jobs.into_batches(str(tmp_path / "rows")), "update")
    got = jobs.latest_density(spark.read.parquet(str(tmp_path / "rows")))
    assert got.count() == 1000 and got.filter("visitors <> 9").count() == 0
