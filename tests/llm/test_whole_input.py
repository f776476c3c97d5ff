"""What is learned is learned from all rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cardloom.llm import common, pii


def test_trees_learn_from_every_candidate(spark, monkeypatch):
    rows = spark.range(60_000).select(
        F.col("id").cast("string").alias("key"), F.lit(0).alias("start"), F.lit(9).alias("end"), F.lit("number").alias("family"), F.lit("1 2").alias("hit"), F.lit(False).alias("touched"),
        (F.col("id") % 2).cast("double").alias("label"), *[F.lit(0.0).alias(f"f_{x}") for x in pii.FEATURES],
    )
    seen = []

    class Stop(Exception):
        pass

    class Trees:
        def __init__(self, **_):
            pass

        def fit(self, learned):
            seen.append(learned.count())
            raise Stop

    monkeypatch.setattr(pii, "GBTClassifier", Trees)
    with pytest.raises(Stop):
        pii._selected(rows)
    assert seen == [rows.filter(F.pmod(F.xxhash64("key", F.lit(4)), F.lit(5)) > 0).count()]


def test_places_of_splits_are_fixed(spark):
    """One row in 60,000 differs in its length; MLlib would choose places from some 10,000 rows, if it had any to choose."""
    from pyspark.ml.classification import GBTClassifier

    odd = F.col("id") == 12_345
    values = {x: F.lit(0.0) for x in pii.FEATURES} | {"length": F.when(odd, 50.0).otherwise(20.0)}
    rows = spark.range(60_000).select(odd.cast("double").alias("label"), *[v.alias(f"f_{x}") for x, v in values.items()])
    featured = pii.with_features(rows)
    attrs = featured.schema["features"].metadata["ml_attr"]
    assert set(attrs["attrs"]) == {"binary"} and attrs["num_attrs"] == len(featured.first()["features"])
    model = GBTClassifier(maxIter=1, maxDepth=1, seed=7).fit(featured.select("features", "label"))
    found = model.transform(featured).filter("prediction = 1").select("label").collect()
    assert [x.label for x in found] == [1.0]


def test_a_filter_is_asked_without_a_join(spark):
    rows = spark.range(20_000).select((F.col("id") * 7919).alias("k"))
    for n in (0, 1, 3000):
        keys = rows.filter(F.col("k") < 7919 * n)
        asked = rows.withColumn("in", common.in_filter(keys, "k"))
        joined = common.with_filter(rows, common.bit_filter(keys, "k"), "k", flag="in")
        assert sorted(asked.filter("in").collect()) == sorted(joined.filter("in").collect())
        assert "Join" not in asked._jdf.queryExecution().optimizedPlan().toString()
