"""Models that are used before they have learned, the common survival interface, and the result of a policy."""

import pytest

from tidewatch.functions.rules import PolicyResult
from tidewatch.operators import supervised, survival
from tidewatch.operators.scoring import NotFitted
from tidewatch.operators.survival import CoxModel, LogisticHazard, ParametricSurvival, SurvivalModel


@pytest.mark.parametrize("model", [
    supervised.SequenceClassifier(), supervised.OrdinalClassifier(["x"]), supervised.BoostedOrdinal(["x"]), supervised.StackedOrdinal([]), supervised.ProportionalOdds(["x"]),
])
def test_classifiers_need_fit(spark, model):
    with pytest.raises(NotFitted):
        model.transform(spark.range(1).selectExpr("id", "1.0 AS x"))


def test_survival_interface(spark):
    df = spark.createDataFrame([(i, float(i % 5), float(1 + (i * 7) % 11 + 2 * (i % 5)), int(i % 4 > 0)) for i in range(60)], "id long, x double, duration double, event int")
    for kind in ("cox", "logistic_hazard"):
        model = survival.survival_model(kind, ["x"])
        assert isinstance(model, SurvivalModel) and not model.is_fitted()
        with pytest.raises(NotFitted):
            model.curve(df, "id")
        assert model.fit(df).is_fitted()
        time = {r.id: r.time for r in model.time_to_failure(df, "id").collect()}
        risk = {r.id: r.risk_score for r in model.risk(df, "id").collect()}
        assert len(time) == len(risk) == 60 and time[4] >= time[0] and risk[4] <= risk[0]  # a larger x lives longer
    with pytest.raises(NotFitted):
        ParametricSurvival().curve(df, [1.0])
    assert isinstance(CoxModel(), SurvivalModel) and isinstance(LogisticHazard(), SurvivalModel)


def test_policy_result(spark):
    df = spark.createDataFrame([("a", 2, 1), ("b", 1, 0), ("c", 0, 0)], "asset string, health_state int, before int")
    result = PolicyResult.of(df, ("asset",), previous="before")
    assert result.table().columns == ["asset", "health_state", "action", "cost", "risk"]
    assert [r.action for r in result.table().orderBy("asset").collect()] == [2, 1, 0]
    assert tuple(result.totals().first())[2:] == (1, 1, 1)
    with pytest.raises(ValueError):
        PolicyResult(df)
