"""What is cut goes to Python a few megabytes at a time."""

import pyarrow as pa

from tidewatch.sources import scratch


def _sizes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "bytes": [batch.nbytes]})


def test_cut_hands_on_a_few_bytes_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(scratch, "BATCH", 1 << 16)
    texts = spark.range(2000).selectExpr("repeat(cast(id as string), 300) text").repartition(1)
    own = scratch.cut(texts.mapInArrow(_sizes, "rows long, bytes long"), "sizes").collect()
    assert sum(r.rows for r in own) == 2000 and max(r.bytes for r in own) < 1 << 18
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None


def test_a_limit_of_the_session_stays(spark):
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "123456")
    try:
        with scratch.small_batches(spark):
            assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "123456"
        assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "123456"
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
