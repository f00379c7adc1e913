from tidewatch.operators.components import connected_components


def test_components(spark):
    path = [(i, i + 1) for i in range(100, 140)]
    star = [(7, i) for i in range(200, 300)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(path + star + [(3, 3), (299, 300)], "a long, b long")).collect()}
    assert got == {i: 100 for i in range(101, 141)} | {i: 7 for i in range(200, 301)}
