"""Tables in and out: series and panels, batches of files scored one by one, models as JSON."""

from __future__ import annotations

import importlib
import json
import logging
import re
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.rules import ThresholdRule
from tidewatch.operators import scoring
from tidewatch.sources.scratch import TablePath


def series(spark: SparkSession, data, value: str = "value") -> DataFrame:
    """ts (or position) and value of a pandas Series, a one-column frame or a list."""
    import pandas as pd

    if isinstance(data, pd.DataFrame):
        if data.shape[1] != 1:
            raise ValueError("a series has one column")
        data = data.iloc[:, 0]
    s = data if isinstance(data, pd.Series) else pd.Series(list(data))
    return spark.createDataFrame(pd.DataFrame({"ts": s.index, value: s.to_numpy(float)}))


def panel(wide: DataFrame, key: str, times: list[str] | None = None, value: str = "value") -> DataFrame:
    """A wide table (a column for each time) as key, ts, value; asked times that it lacks are null."""
    own = [c for c in wide.columns if c != key]
    times = times or own
    columns = [(F.col(c) if c in own else F.lit(None)).cast("double").alias(c) for c in times]
    return wide.select(key, *columns).unpivot([key], times, "ts", value)


def batch_score(batches: Iterable[DataFrame], scorer: scoring.Scorer) -> Iterator[DataFrame]:
    """Each batch scored by itself."""
    for df in batches:
        yield scorer.transform(df)


def batch_predict(batches: Iterable[DataFrame], scorer: scoring.Scorer, rule: ThresholdRule | None = None) -> Iterator[DataFrame]:
    """Each batch with score and flag: a detector's own flag, or the score under the rule."""
    for df in batches:
        yield scoring.detect_anomalies(df, scorer, rule)


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _file_system(spark, path)
    return fs.exists(at)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One file on any file system that Hadoop reads."""
    at, fs = _file_system(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """FileNotFoundError if there is none."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.text(path, wholetext=True).first()[0]


def score_files(spark: SparkSession, paths: list[str], scorer: Callable[[DataFrame, tuple[str, ...]], DataFrame]) -> DataFrame:
    """CSV files of any Hadoop file system, their first column scored file by file, all in one read.

    Missing files are skipped with a warning, unreadable ones silently. ``scorer`` takes the rows (file, position, value)
    and the partition columns; file is the full name.
    """
    if not paths:
        raise ValueError("no files")
    found = [p for p in paths if exists(spark, p)]
    if len(found) < len(paths):
        logging.getLogger(__name__).warning("skipped, as they are missing: %s", sorted(set(paths) - set(found)))
    if not found:
        return scorer(spark.createDataFrame([], "file string, position long, value double"), ("file",))
    read = spark.read.option("header", True).option("mode", "PERMISSIVE").option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    rows = read.schema("first string").csv(found)  # columns by position, whatever a file calls them
    return scorer(rows.select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("position"), F.expr("try_cast(first as double)").alias("value")), ("file",))


def table_of(spark: SparkSession, data, names: tuple[str, ...] | None = None) -> tuple[DataFrame, tuple[str, ...]]:
    """A table and its feature columns from a DataFrame, a pandas Series or frame, or rows of numbers (an array or lists)."""
    import numpy as np
    import pandas as pd

    if isinstance(data, DataFrame):
        own = tuple(c for c, t in data.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint"))
        return data, names or own
    if isinstance(data, pd.Series):
        data = data.to_frame(data.name if isinstance(data.name, str) else "value")
    if not isinstance(data, pd.DataFrame):
        x = np.asarray(data, float)
        x = x.reshape(len(x), -1)
        data = pd.DataFrame(x, columns=names or (["value"] if x.shape[1] == 1 else [f"feature_{i}" for i in range(x.shape[1])]))
    return spark.createDataFrame(data.reset_index(drop=True)), names or tuple(str(c) for c in data.select_dtypes("number").columns)


def whitespace_table(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """A text file of numbers between white space, without header."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(*[parts[i].cast("double").alias(n) for i, n in enumerate(names)])


def _packed(x, path: str, parts: list[tuple[str, object]]):
    """A value as JSON; models of pyspark.ml become folders of their own."""
    if hasattr(x, "transform") and hasattr(x, "write"):
        parts.append((f"{path}/part-{len(parts)}", x))
        return {"__ml__": parts[-1][0].rsplit("/", 1)[1]}
    if hasattr(x, "__dataclass_fields__"):
        return {"__class__": f"{type(x).__module__}:{type(x).__name__}", "state": {k: _packed(v, path, parts) for k, v in vars(x).items()}}
    if isinstance(x, TablePath):
        parts.append((f"{path}/table-{len(parts)}", x))
        return {"__table__": f"table-{len(parts) - 1}"}
    if isinstance(x, dict):
        return {"__dict__": [[_packed(k, path, parts), _packed(v, path, parts)] for k, v in x.items()]}
    if isinstance(x, (list, tuple)):
        return {"__tuple__" if isinstance(x, tuple) else "__list__": [_packed(v, path, parts) for v in x]}
    return x.item() if hasattr(x, "item") else x


def _unpacked(x, path: str):
    from pyspark.ml import PipelineModel

    if not isinstance(x, dict):
        return x
    if "__ml__" in x:
        return PipelineModel.load(f"{path}/{x['__ml__']}")
    if "__table__" in x:
        return TablePath(f"{path}/{x['__table__']}")
    if "__dict__" in x:
        return {_unpacked(k, path): _unpacked(v, path) for k, v in x["__dict__"]}
    if "__tuple__" in x:
        return tuple(_unpacked(v, path) for v in x["__tuple__"])
    if "__list__" in x:
        return [_unpacked(v, path) for v in x["__list__"]]
    module, name = x["__class__"].split(":")
    if not module.startswith("tidewatch."):
        raise ValueError(f"not a model of this library: {module}")
    made = object.__new__(getattr(importlib.import_module(module), name))
    vars(made).update({k: _unpacked(v, path) for k, v in x["state"].items()})
    return made


def _is_fitted(model) -> bool:
    return any(v is not None and v not in ({}, []) for k, v in vars(model).items() if k in ("fitted", "model", "models", "meta", "theta"))


def save_model(model, path: str, metadata: dict | None = None, spark: SparkSession | None = None) -> None:
    """model.json (class, parameters, fitted state; folders of pyspark.ml models and of tables) and metadata.json in a folder of any file system.

    All scorers, detectors, ensembles, supervised and survival models; ValueError if the model is not fitted.
    """
    if not _is_fitted(model):
        raise scoring.NotFitted(f"{type(model).__name__} is not fitted")
    spark, parts = spark or SparkSession.builder.getOrCreate(), []
    text = json.dumps(_packed(model, path, parts))
    for at, part in parts:
        if isinstance(part, TablePath):
            if str(part) != at:  # else it is stored where it lies
                spark.read.parquet(part).write.mode("overwrite").parquet(at)
        else:
            part.write().overwrite().save(at)
    write_text(spark, f"{path}/model.json", text)
    params = {k: v for k, v in vars(model).items() if isinstance(v, (str, int, float, bool, tuple, list)) and k != "theta"}
    write_text(spark, f"{path}/metadata.json", json.dumps({"class": type(model).__name__, "module": type(model).__module__, "params": params, "fitted": True, **(metadata or {})}, default=repr))


def load_model(path: str, spark: SparkSession | None = None):
    """FileNotFoundError if the folder or its model is missing."""
    return _unpacked(json.loads(read_text(spark or SparkSession.builder.getOrCreate(), f"{path}/model.json")), path)


def model_metadata(path: str, spark: SparkSession | None = None) -> dict:
    return json.loads(read_text(spark or SparkSession.builder.getOrCreate(), f"{path}/metadata.json"))


_HANDLER = '''"""Loads a saved model and answers JSON or CSV requests."""
import csv, io, json
from tidewatch.sources.io import load_model

def model_fn(model_dir):
    return load_model(model_dir)

def input_fn(body, content_type):
    if content_type == "application/json":
        data = json.loads(body)
        return data.get("instances", data.get("data")) if isinstance(data, dict) else data
    if content_type == "text/csv":
        return [[float(x) for x in row] for row in csv.reader(io.StringIO(body)) if row]
    raise ValueError(f"unsupported content type {content_type}")

def predict_fn(rows, model, spark=None):
    from pyspark.sql import SparkSession
    spark = spark or SparkSession.builder.getOrCreate()
    names = list(getattr(model, "features", ("value",)))
    rows = [r if isinstance(r, (list, tuple)) else [r] for r in rows]
    return [r.score for r in model.transform(spark.createDataFrame(rows, names)).select("score").collect()]

def output_fn(scores, accept):
    if accept == "text/csv":
        return "\\n".join(map(str, scores))
    return json.dumps({"scores": scores})
'''


def export_bundle(model: scoring.Scorer, path: str, target: str, metadata: dict | None = None) -> dict:
    """A folder with the model, a request handler and its requirements, and the command that would upload it."""
    if not re.match(r"^s3://", target):
        raise ValueError("the target must begin with s3://")
    spark = SparkSession.builder.getOrCreate()
    save_model(model, path, metadata, spark)
    write_text(spark, f"{path}/inference.py", _HANDLER)
    write_text(spark, f"{path}/requirements.txt", "pyspark\nnumpy\npandas\npyarrow\n")
    return {"local_path": path, "target": target, "upload_command": f"aws s3 cp --recursive {path} {target}"}
