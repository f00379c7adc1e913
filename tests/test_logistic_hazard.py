import numpy as np
from pyspark.sql import functions as F

from tidewatch.operators.survival import LogisticHazard


def rows(spark, n=600):
    rng = np.random.default_rng(2)
    x = rng.normal(5, 3, n)
    duration = np.round(rng.exponential(20 * np.exp(-0.1 * x)) + 1, 1)
    return spark.createDataFrame([(i, float(x[i]), float(duration[i]), int(rng.random() < 0.7)) for i in range(n)], "id long, x double, duration double, event int")


def test_newton_steps_find_the_regression_over_rows_and_bins(spark):
    """The same curve as the logistic regression of the expanded table."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import OneHotEncoder, VectorAssembler

    df = rows(spark)
    model = LogisticHazard(["x"], n_bins=12).fit(df)
    own = F.least(F.floor(F.col("duration") / model.fitted["width"]), F.lit(11)).cast("int")
    long = df.select("x", "event", own.alias("own"), F.explode(F.sequence(F.lit(0), own)).alias("bin")).withColumn("y", ((F.col("bin") == F.col("own")) & (F.col("event") == 1)).cast("double"))
    stages = [OneHotEncoder(inputCols=["bin"], outputCols=["b"], handleInvalid="keep"), VectorAssembler(inputCols=["x", "b"], outputCol="v"), LogisticRegression(featuresCol="v", labelCol="y", regParam=1e-4, tol=1e-12, maxIter=500)]
    plain = Pipeline(stages=stages).fit(long).stages[-1]
    level = plain.intercept + plain.coefficients.toArray()[1:]
    x = dict(df.select("id", "x").collect())
    got = {}
    for r in model.curve(df, "id").orderBy("id", "t").collect():
        got.setdefault(r.id, []).append(r.survival)
    for i in (0, 7, 599):
        h = 1 / (1 + np.exp(-(plain.coefficients[0] * x[i] + level)))
        assert np.allclose(np.cumprod(1 - h), got[i], atol=1e-6)


def test_bins_are_not_rows_of_a_table(spark):
    df = rows(spark)
    plan = LogisticHazard(["x"]).fit(df).curve(df, "id")._jdf.queryExecution().toString()
    assert "Window" not in plan and "Exchange" not in plan


def test_without_failures_and_failures_alone(spark):
    df = rows(spark, 40)
    assert LogisticHazard(["x"]).fit(df.withColumn("event", F.lit(0))).curve(df, "id").where("survival < 1").isEmpty()
    dead = df.withColumn("event", F.lit(1)).withColumn("duration", F.lit(0.0))
    assert LogisticHazard(["x"]).fit(dead).curve(df, "id").where("survival > 1e-11").isEmpty()
