from meridian.operators import modes


def test_training_uses_every_core(spark, monkeypatch):
    seen = []

    class Recorded:
        def fit(self, rows):
            seen.append((rows.rdd.getNumPartitions(), rows.count()))

    monkeypatch.setattr(modes, "pipeline", lambda *_: Recorded())
    modes.train(spark.range(1000).coalesce(1))
    assert seen == [(spark.sparkContext.defaultParallelism, 1000)]
