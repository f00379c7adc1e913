"""The rows that trees learn from stay in tasks: the driver gets hashes and trees, however wide the rows are."""

import numpy as np
from pyspark.sql import functions as F

from tidewatch.operators import detectors


def test_no_rows_at_the_driver(spark, monkeypatch):
    df = spark.range(400).select(F.transform(F.sequence(F.lit(0), F.lit(299)), lambda i: F.rand(3) + (F.col("id") == 7).cast("int") * 9).alias("x"), "id")
    df = df.localCheckpoint()
    asked = []
    own = type(df).toPandas
    monkeypatch.setattr(type(df), "toPandas", lambda self: (asked.append([t for _, t in self.dtypes]), own(self))[1])
    model = detectors.IsolationForest(("x",), n_estimators=20).fit(df)
    assert asked and not any(t.startswith("array") for types in asked for t in types)
    assert len(model.fitted["trees"]) == 20 and all(len(t) > 100 for t in model.fitted["trees"])
    again = detectors.IsolationForest(("x",), n_estimators=20).fit(df.repartition(7))
    assert again.fitted["trees"] == model.fitted["trees"]
    top = model.transform(df).orderBy(F.desc("score")).first()
    assert top.id == 7 and np.isfinite(top.score)
