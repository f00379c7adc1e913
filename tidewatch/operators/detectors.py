"""Fitted detectors: a bounded model is learned, broadcast, and applied as expressions or Arrow batches.

``fit`` reads the whole table where sums suffice (PCA, robust covariance); where a model needs rows (trees,
neighbours) it takes a bounded sample in the order of a seeded hash. ``transform`` adds ``score``
(higher: more anomalous) and ``flag``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidewatch.functions.rules import flag, health_from_distance, no_nan
from tidewatch.operators import arima
from tidewatch.operators.neighbours import ASKED, closest_rows, fit_outliers, nearest, outlier_factors
from tidewatch.operators.ordering import quantile, quantiles
from tidewatch.operators.scoring import Detector, Scorer
from tidewatch.sources.scratch import TablePath, cut, new_path

#: Rows that a model which needs rows learns from, at most.
SAMPLE = 20_000
#: Numbers that the local outlier factor may hold as its model (256 MB).
LARGEST = 32_000_000


def sample_matrix(df: DataFrame, features: list[str], seed: int, rows: int = SAMPLE, block: int = 10_000) -> np.ndarray:
    """At most ``rows`` complete rows, each as likely as any other; a single array column is a whole row.

    They come in the order of a seeded hash of their values and their number among equal rows, so that equal rows are drawn
    one by one and the draw does not depend on how the table is split.
    """
    return matrix(_drawn(df, features, seed, rows, block).select(*features).toPandas(), features)


def _drawn(df: DataFrame, features: list[str], seed: int, rows: int = SAMPLE, block: int = 10_000) -> DataFrame:
    """The rows of ``sample_matrix`` and their hashes ``__h``, as a table."""
    counts = complete(df, features).groupBy(*features).agg(F.count(F.lit(1)).alias("__n"))
    blocks = counts.withColumn("__b", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(__n - 1) div {block}"))))
    each = blocks.withColumn("__k", F.explode(F.sequence(F.col("__b") * block, F.least(F.col("__n"), (F.col("__b") + 1) * block) - 1)))
    return each.select(F.xxhash64(F.lit(seed), *features, "__k").alias("__h"), *features).orderBy("__h").limit(rows)


def matrix(part: pd.DataFrame, features: list[str]) -> np.ndarray:
    """The features of a batch, missing ones as NaN; a single column of arrays is a whole row."""
    x = part[features]
    if len(features) == 1 and len(x) and x.dtypes.iloc[0] == object:
        rows = x.iloc[:, 0].tolist()
        width = max((len(r) for r in rows if r is not None), default=1)
        return np.array([np.full(width, np.nan) if r is None else np.asarray(r, float) for r in rows])
    return x.to_numpy(float)


def add_scores(df: DataFrame, features: list[str], score: Callable[[np.ndarray], np.ndarray], out: str = "score") -> DataFrame:
    """Adds ``score(matrix)`` batch by batch; rows with a missing feature get null."""
    schema = StructType([*df.schema.fields, StructField(out, DoubleType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            x = matrix(part, features)
            whole = ~np.isnan(x).any(axis=1)
            s = np.full(len(x), np.nan)
            if whole.any():
                s[whole] = score(x[whole])
            yield part.assign(**{out: s})

    return df.mapInPandas(run, schema).withColumn(out, no_nan(out))


def complete(df: DataFrame, features: list[str]) -> DataFrame:
    """The features of the rows that have all of them (NaN counts as missing); a single array column is a whole row."""
    if len(features) == 1 and dict(df.dtypes)[features[0]].startswith("array"):
        x = df.select(F.col(features[0]).cast("array<double>").alias(features[0]))
        return x.where(F.col(features[0]).isNotNull() & ~F.exists(features[0], lambda v: v.isNull() | F.isnan(v)))
    return df.select(*[no_nan(c).alias(c) for c in features]).dropna()


def by_matrix(features: list[str], made: Callable[[np.ndarray], np.ndarray]) -> Column:
    """A column computed from the features by numpy, batch by batch; null where one is missing."""

    @F.pandas_udf("double")
    def run(*columns: pd.Series) -> pd.Series:
        x = matrix(pd.concat(columns, axis=1, keys=range(len(columns))), list(range(len(columns))))
        whole, out = ~np.isnan(x).any(axis=1), np.full(len(x), np.nan)
        if whole.any():
            out[whole] = made(x[whole])
        return pd.Series(out)

    return no_nan(run(*[F.col(c) for c in features]))


def moments(df: DataFrame, features: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, means and population covariance: each task's sums of products around a row of the table, added by place."""
    x = complete(df, features)
    first = x.limit(1).toPandas()
    if not len(first):
        d = len(features)
        return 0, np.zeros(d), np.zeros((d, d))
    origin = matrix(first, features)[0]
    d = len(origin)

    def products(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((d + 1, d + 1))
        for part in parts:
            y = np.column_stack([np.ones(len(part)), matrix(part, features) - origin])
            total += y.T @ y
        i, j = np.triu_indices(d + 1)
        yield pd.DataFrame({"i": i, "j": j, "s": total[i, j]})

    total = np.zeros((d + 1, d + 1))
    for r in x.mapInPandas(products, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():  # d * d / 2 rows
        total[r.i, r.j] = total[r.j, r.i] = r.s
    n, shift = total[0, 0], total[0, 1:] / total[0, 0]
    return int(n), origin + shift, total[1:, 1:] / n - np.outer(shift, shift)


def squared_distance(features: list[str], mean: np.ndarray, precision: np.ndarray) -> Column:
    """The squared Mahalanobis distance as a column."""
    return by_matrix(features, lambda x: np.einsum("ij,jk,ik->i", x - mean, precision, x - mean))


def _path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


#: Rows that go through all trees together.
_ROWS = 32_768


def _flat(tree: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """A tree's features, cuts, children (not below and below its cut, side by side; a leaf is its own), path lengths and depth."""
    leaf, own = tree[:, 0] < 0, np.arange(len(tree))
    child = np.column_stack([np.where(leaf, own, tree[:, 3]), np.where(leaf, own, tree[:, 2])]).astype(np.intp)
    depth, level = 0, np.zeros(1, np.intp)
    while not leaf[level].all():
        depth, level = depth + 1, np.unique(child[level[~leaf[level]]])
    return np.maximum(tree[:, 0], 0).astype(np.intp), np.ascontiguousarray(tree[:, 1]), child.ravel(), np.ascontiguousarray(tree[:, 4]), depth


def _grown(x: np.ndarray, depth: int, rng: np.random.Generator) -> list[list[float]]:
    """A tree's nodes: feature, cut, left, right, path; feature -1: a leaf."""
    nodes: list[list[float]] = []

    def grow(rows: np.ndarray, level: int) -> int:
        own = len(nodes)
        nodes.append([-1.0, 0.0, 0.0, 0.0, level + float(_path(len(rows)))])
        spread = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) > 1 else []
        if level < depth and len(spread):
            f = int(rng.choice(spread))
            cut = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
            left, right = grow(rows[rows[:, f] < cut], level + 1), grow(rows[rows[:, f] >= cut], level + 1)
            nodes[own] = [float(f), cut, float(left), float(right), 0.0]
        return own

    grow(x, 0)
    return nodes


@dataclass
class IsolationForest(Detector):
    """Random trees over samples of 256 rows; the offset puts a share ``contamination`` of all training rows above 0 (less, where scores tie).

    Each tree grows in a task from its own rows and with its own generator; the driver gets hashes of rows and whole trees only.
    """

    features: tuple[str, ...] = ("value",)
    contamination: float = 0.05
    n_estimators: int = 200
    seed: int = 0

    def fit(self, df: DataFrame) -> IsolationForest:
        names, seed = list(self.features), self.seed
        held = cut(_drawn(df, names, seed), "sample")
        keys = np.sort(held.select("__h").toPandas()["__h"].to_numpy())
        if len(keys) < 2:
            raise ValueError("too few rows")
        size = min(256, len(keys))
        depth = int(np.ceil(np.log2(max(size, 2))))
        own = [keys[np.random.default_rng([seed, t]).choice(len(keys), size, replace=False)] for t in range(self.n_estimators)]
        pairs = df.sparkSession.createDataFrame(pd.DataFrame({"__h": np.concatenate(own), "__t": np.repeat(np.arange(len(own)), size)}), "__h long, __t int")

        def grown(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"tree": [key[0]], "nodes": [_grown(matrix(part, names), depth, np.random.default_rng([seed, key[0], 1]))]})

        found = held.join(F.broadcast(pairs), "__h").groupBy("__t").applyInPandas(grown, "tree int, nodes array<array<double>>")
        trees = [r.nodes for r in sorted(found.collect(), key=lambda r: r.tree)]  # some 500 nodes each
        self.fitted = {"trees": trees, "size": size}
        raw = self._raw()
        self.fitted["offset"] = quantile(complete(df, names), by_matrix(names, lambda x: -raw(x)), self.contamination)
        return self

    def _raw(self) -> Callable[[np.ndarray], np.ndarray]:
        scale = float(_path(self.fitted["size"])) or 1.0
        trees = [_flat(np.array(t)) for t in self.fitted["trees"]]

        def score(x: np.ndarray) -> np.ndarray:
            out = np.empty(len(x))
            for at in range(0, len(x), _ROWS):
                own = np.ascontiguousarray(x[at : at + _ROWS])
                flat, first, total = own.ravel(), np.arange(len(own)) * own.shape[1], np.zeros(len(own))
                for feature, cut, child, path, depth in trees:
                    node = np.zeros(len(own), np.intp)
                    for _ in range(depth):
                        below = flat.take(first + feature.take(node)) < cut.take(node)
                        node = child.take(2 * node + below)
                    total += path.take(node)
                out[at : at + _ROWS] = total
            return 2.0 ** (-out / len(trees) / scale)

        return score

    def transform(self, df: DataFrame) -> DataFrame:
        self.need_fit()
        raw, offset = self._raw(), self.fitted["offset"]
        out = add_scores(df, list(self.features), lambda x: raw(x) + offset)
        return out.withColumn("flag", flag(F.col("score") > 0))


@dataclass
class LocalOutlierFactor(Detector):
    """Density of a row's neighbourhood against its neighbours' among all training rows (exact search); flag by contamination.

    The training rows are the model. Up to ``LARGEST`` numbers they are held as one matrix; beyond that they stay a table, searched by
    cells around pivots (``operators.neighbours``), and the fitted model holds its path. Both searches are exact.
    """

    features: tuple[str, ...] = ("value",)
    contamination: float = 0.05
    n_neighbors: int = 20
    seed: int = 0

    def fit(self, df: DataFrame) -> LocalOutlierFactor:
        names = list(self.features)
        rows = complete(df, names)
        width = matrix(rows.limit(1).toPandas(), names).shape[1]
        if rows.count() * width > LARGEST:
            return self._fit_table(rows)
        x = matrix(rows.toPandas(), names).reshape(-1, width)
        k = min(self.n_neighbors, len(x) - 1)
        if k < 1:
            raise ValueError("too few rows")
        distance, index = self._neighbours(df.sparkSession, x, k + 1)
        distance, index = distance[:, 1:], index[:, 1:]
        reach = np.maximum(distance, distance[:, -1][index])
        density = 1 / (reach.mean(axis=1) + 1e-10)
        lof = density[index].mean(axis=1) / density
        self.fitted = {"x": x.tolist(), "k": k, "radius": distance[:, -1].tolist(), "density": density.tolist(), "limit": float(np.percentile(lof, 100 * (1 - self.contamination)))}
        return self

    def _numbers(self, df: DataFrame) -> Column:
        names = list(self.features)
        whole = len(names) == 1 and dict(df.dtypes)[names[0]].startswith("array")
        return F.col(names[0]).cast("array<double>") if whole else F.array(*[no_nan(c) for c in names])

    def _fit_table(self, rows: DataFrame) -> LocalOutlierFactor:
        rows = cut(rows.select(F.monotonically_increasing_id().alias("id"), self._numbers(rows).alias("x")), "rows")
        k = min(self.n_neighbors, rows.count() - 1)
        if k < 1:
            raise ValueError("too few rows")
        model, limit = fit_outliers(rows, k, self.contamination)
        path = new_path(rows.sparkSession, "outliers")
        model.write.parquet(path)
        self.fitted = {"table": TablePath(path), "k": k, "limit": limit}
        return self

    def _transform_table(self, df: DataFrame) -> DataFrame:
        row, score = "_row", "score"
        model = df.sparkSession.read.parquet(self.fitted["table"])
        df = cut(df.withColumn(row, F.monotonically_increasing_id()), "scored")
        new = df.select(F.col(row).alias("id"), self._numbers(df).alias("x")).where(F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
        found = outlier_factors(nearest(new, model.select("id", "x"), self.fitted["k"]), model.drop("x"))
        return df.join(found.select(F.col("id").alias(row), F.col("lof").alias(score)), row, "left").drop(row)

    def _neighbours(self, spark: SparkSession, x: np.ndarray, k: int, block: int = 2000) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest of all rows to each row, by blocks of rows against all."""
        held, near = spark.sparkContext.broadcast(x), self._near

        def search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for a in part["id"]:
                    d, i = near(held.value[a : a + block], held.value, k)
                    yield pd.DataFrame({"id": [a], "d": [d.astype("<f8").tobytes()], "i": [i.astype("<i8").tobytes()]})

        blocks = -(-len(x) // block)
        found = spark.range(0, len(x), block, min(blocks, 64)).mapInPandas(search, "id long, d binary, i binary").collect()
        found.sort(key=lambda r: r.id)
        return tuple(np.frombuffer(b"".join(bytes(r[c]) for r in found), t).reshape(-1, k) for c, t in (("d", "<f8"), ("i", "<i8")))

    @staticmethod
    def _near(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        k, ids, ds, ix = min(k, len(b)), np.arange(len(b)), [], []
        for part in (a[at : at + ASKED] for at in range(0, len(a), ASKED)):
            _, d, i = closest_rows(part, np.full(len(part), np.inf), b, ids, k)
            ds.append(d.reshape(-1, k))
            ix.append(i.reshape(-1, k))
        return np.concatenate(ds), np.concatenate(ix)

    def transform(self, df: DataFrame) -> DataFrame:
        self.need_fit()
        if "table" in self.fitted:
            return self._transform_table(df).withColumn("flag", flag(F.col("score") > self.fitted["limit"]))
        x, k = np.array(self.fitted["x"]), self.fitted["k"]
        radius, density = np.array(self.fitted["radius"]), np.array(self.fitted["density"])
        near = self._near

        def score(rows: np.ndarray) -> np.ndarray:
            distance, index = near(rows, x, k)
            own = 1 / (np.maximum(distance, radius[index]).mean(axis=1) + 1e-10)
            return density[index].mean(axis=1) / own

        return add_scores(df, list(self.features), score).withColumn("flag", flag(F.col("score") > self.fitted["limit"]))


def chi_square_quantile(p: float, d: int) -> float:
    """By halving, on the series of the regularised incomplete gamma function."""

    def below(x: float) -> float:
        a, h = d / 2, x / 2
        term = total = math.exp(a * math.log(h) - h - math.lgamma(a + 1))
        n = 0
        while term > total * 1e-16:
            n += 1
            term *= h / (a + n)
            total += term
        return total

    low, high = 1e-12, 4.0 * d + 100
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return low


def _shape(cov: np.ndarray) -> float:
    """The logarithm of the determinant, with a little added to the diagonal."""
    return float(np.linalg.slogdet(cov + np.eye(len(cov)) * (1e-12 * np.trace(cov) / len(cov) + 1e-300))[1])


def _closest(x: np.ndarray, mean: np.ndarray, cov: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the n rows closest by the given ones: a concentration step."""
    d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.pinv(cov), x - mean)
    near = x[np.argpartition(d, n - 1)[:n]]
    return near.mean(axis=0), np.cov(near, rowvar=False, bias=True).reshape(x.shape[1], -1)


@dataclass
class RobustCovariance(Detector):
    """Squared Mahalanobis distance from the covariance of least determinant of a share ``support`` of the rows.

    Many random starts go through two concentration steps on a bounded sample; the best are carried through steps over the
    whole table, all in the same passes, and the one of least determinant until nothing changes. Its covariance is scaled so that
    the median distance is a normal sample's, and learned once more from all rows within the 97.5 % ellipsoid.
    """

    features: tuple[str, ...] = ("value",)
    contamination: float = 0.05
    support: float = 0.8
    steps: int = 8
    starts: int = 100
    carried: int = 5
    sample: int = 1500
    seed: int = 0

    def _started(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        rng, size, n = np.random.default_rng(self.seed), x.shape[1] + 1, max(2, int(np.ceil(self.support * len(x))))
        found = []
        for _ in range(self.starts):
            own = x[rng.choice(len(x), min(len(x), size), replace=False)]
            mean, cov = own.mean(axis=0), np.cov(own, rowvar=False, bias=True).reshape(x.shape[1], -1)
            for _ in range(2):
                mean, cov = _closest(x, mean, cov, n)
            found.append((_shape(cov), len(found), mean, cov))
        for i, (_, k, mean, cov) in enumerate(sorted(found, key=lambda f: f[:2])[: self.carried]):
            for _ in range(self.steps):
                mean, cov = _closest(x, mean, cov, n)
            found[i] = (_shape(cov), k, mean, cov)
        return [(mean, cov) for _, _, mean, cov in sorted(found[: self.carried], key=lambda f: f[:2])]

    def _within(self, rows: DataFrame, models: list[tuple[np.ndarray, np.ndarray]], limits: list[float]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Mean and covariance of the rows within each model's limit, all in one pass."""
        names, d = list(self.features), len(models[0][0])
        known = [(m, np.linalg.pinv(c), x) for (m, c), x in zip(models, limits, strict=True)]

        def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((len(known), d + 1, d + 1))
            for part in parts:
                x = matrix(part, names)
                for k, (mean, precision, limit) in enumerate(known):
                    y = x - mean
                    own = y[np.einsum("ij,jk,ik->i", y, precision, y) <= limit]
                    own = np.column_stack([np.ones(len(own)), own])
                    total[k] += own.T @ own
            k, i, j = np.indices(total.shape).reshape(3, -1)
            yield pd.DataFrame({"k": k, "i": i, "j": j, "s": total.ravel()})

        total = np.zeros((len(known), d + 1, d + 1))
        for r in rows.mapInPandas(sums, "k int, i int, j int, s double").groupBy("k", "i", "j").agg(F.sum("s").alias("s")).collect():  # carried * d * d rows
            total[r.k, r.i, r.j] = r.s
        shift = total[:, 0, 1:] / total[:, :1, 0]
        return [(m + s, t[1:, 1:] / t[0, 0] - np.outer(s, s)) for (m, _, _), s, t in zip(known, shift, total, strict=True)]

    def fit(self, df: DataFrame) -> RobustCovariance:
        names = list(self.features)
        rows = cut(complete(df, names), "complete")
        x = sample_matrix(rows, names, self.seed, self.sample)
        if len(x) < 2:
            raise ValueError("too few rows")
        models = self._started(x.reshape(len(x), -1))
        distance = lambda m: squared_distance(names, m[0], np.linalg.pinv(m[1]))
        for step in range(self.steps):
            limits = quantiles(rows, {str(i): (distance(m), [self.support]) for i, m in enumerate(models)})
            new = self._within(rows, models, [q[0] for q in limits.values()])
            done = len(models) == 1 and np.allclose(new[0][0], models[0][0], atol=1e-9) and np.allclose(new[0][1], models[0][1], atol=1e-9)
            models = new if step < 1 else [min(new, key=lambda m: _shape(m[1]))]
            if done:
                break
        (mean, cov), d = models[0], x.reshape(len(x), -1).shape[1]
        cov = cov * ((quantile(rows, distance(models[0]), 0.5) or 1.0) / chi_square_quantile(0.5, d))
        mean, cov = self._within(rows, [(mean, cov)], [chi_square_quantile(0.975, d)])[0]
        limit = quantile(rows, distance((mean, cov)), 1 - self.contamination)
        self.fitted = {"mean": mean.tolist(), "precision": np.linalg.pinv(cov).tolist(), "limit": limit}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        self.need_fit()
        d = squared_distance(list(self.features), np.array(self.fitted["mean"]), np.array(self.fitted["precision"]))
        df = df.withColumn("score", d - self.fitted["limit"])
        return df.withColumn("flag", flag(F.col("score") > 0))


@dataclass
class PCADetector(Detector):
    """Reconstruction error, Mahalanobis distance in component space, or the mean of both scaled to the training range."""

    features: tuple[str, ...] = ("value",)
    n_components: float | int = 0.95
    method: str = "reconstruction"
    contamination: float = 0.05

    def fit(self, df: DataFrame) -> PCADetector:
        if self.method not in ("reconstruction", "mahalanobis", "both"):
            raise ValueError(f"unknown method {self.method!r}")
        n, mean, cov = moments(df, list(self.features))
        std = np.sqrt(np.diag(cov))
        std[std == 0] = 1.0
        value, vectors = np.linalg.eigh(cov / np.outer(std, std))
        order = np.argsort(-value)
        value, vectors = np.maximum(value[order], 0), vectors[:, order]
        if isinstance(self.n_components, float) and self.n_components < 1:
            k = int(np.searchsorted(np.cumsum(value) / max(value.sum(), 1e-30), self.n_components) + 1)
        else:
            k = int(self.n_components)
        k = max(1, min(k, len(value)))
        variance = value[:k] * n / max(n - 1, 1)
        self.fitted = {"mean": mean.tolist(), "std": std.tolist(), "vectors": vectors[:, :k].tolist(), "inverse": [1 / v if v > 1e-12 else 0.0 for v in variance]}
        own = complete(df, list(self.features))
        parts = own.select(self.reconstruction().alias("r"), self.mahalanobis().alias("m"))
        r = parts.agg(F.min("r"), F.max("r"), F.min("m"), F.max("m")).first()
        self.fitted["range"] = [float(x) for x in r]
        self.fitted["limit"] = quantile(own, self._score(), 1 - self.contamination)
        return self

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return (x - np.array(self.fitted["mean"])) / np.array(self.fitted["std"])

    def components(self, n: int = 2) -> list[Column]:
        """The first n principal components."""
        v = np.array(self.fitted["vectors"])
        return [by_matrix(list(self.features), lambda x, k=k: self._scaled(x) @ v[:, k]) for k in range(min(n, v.shape[1]))]

    def reconstruction(self) -> Column:
        v = np.array(self.fitted["vectors"])

        def error(x: np.ndarray) -> np.ndarray:
            z = self._scaled(x)
            return ((z - z @ v @ v.T) ** 2).sum(axis=1)

        return by_matrix(list(self.features), error)

    def mahalanobis(self) -> Column:
        v, w = np.array(self.fitted["vectors"]), np.array(self.fitted["inverse"])
        return by_matrix(list(self.features), lambda x: np.sqrt(((self._scaled(x) @ v) ** 2 * w).sum(axis=1)))

    def _score(self) -> Column:
        if self.method == "reconstruction":
            return self.reconstruction()
        if self.method == "mahalanobis":
            return self.mahalanobis()
        a, b, c, d = self.fitted["range"]
        return ((self.reconstruction() - a) / (b - a or 1.0) + (self.mahalanobis() - c) / (d - c or 1.0)) / 2

    def transform(self, df: DataFrame) -> DataFrame:
        self.need_fit()
        df = df.withColumn("score", self._score())
        return df.withColumn("flag", flag(F.col("score") > self.fitted["limit"]))


def health_thresholds(df: DataFrame, detector: PCADetector, healthy: float = 75, warning: float = 95) -> tuple[float, float]:
    """Percentiles of the Mahalanobis distance."""
    if healthy >= warning:
        raise ValueError("the healthy percentile must be below the warning one")
    detector.need_fit()
    return tuple(quantiles(df, {"d": (detector.mahalanobis(), [healthy / 100, warning / 100])})["d"])


def track_distance(df: DataFrame, detector: PCADetector) -> DataFrame:
    """Adds ``mahalanobis_distance``; ValueError unless the detector is fitted and scores by that distance."""
    detector.need_fit()
    if detector.method != "mahalanobis":
        raise ValueError("the detector must score by the Mahalanobis distance")
    return df.withColumn("mahalanobis_distance", detector.mahalanobis())


def health_by_distance(df: DataFrame, detector: PCADetector, healthy: float, warning: float) -> DataFrame:
    """Adds mahalanobis_distance and health_state."""
    df = track_distance(df, detector)
    return df.withColumn("health_state", health_from_distance(F.col("mahalanobis_distance"), healthy, warning))


def boundary_points(df: DataFrame, detector: PCADetector) -> DataFrame:
    """The data of a boundary chart: the first two components and the flag of each row."""
    first = detector.components(2)
    return detector.transform(df).select(*[c.alias(f"PC{i + 1}") for i, c in enumerate(first)], "flag")


def reconstruction_errors(df: DataFrame, detector: Detector, keys: list[str]) -> DataFrame:
    """The data of an error chart: keys, error, threshold, flag of each row."""
    detector.need_fit()
    return detector.transform(df).select(*keys, F.col("score").alias("error"), F.lit(float(detector.fitted["limit"])).alias("threshold"), "flag")


def sensor_drift(df: DataFrame, sensors: list[str], partition: list[str], order: list[str], threshold: float = 2.0) -> DataFrame:
    """The data of a drift chart: keys, sensor, value, score, flag of each sensor's series, long."""
    keys = [*partition, *order]
    long = df.select(*keys, *[no_nan(c).alias(c) for c in sensors]).unpivot(keys, sensors, "sensor", "value")
    return arima_drift(long, "value", [*partition, "sensor"], order, threshold=threshold)


def _per_series(df: DataFrame, value: str, partition: list[str], order: list[str], made: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """score and flag of each entity's ordered series by a numpy function; an entity is one task's work."""
    schema = StructType([*df.schema.fields, StructField("score", DoubleType()), StructField("flag", DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        x = pdf[value].to_numpy(float)
        score, marked = made(np.where(np.isnan(x), np.nanmean(x) if (~np.isnan(x)).any() else 0.0, x))
        return pdf.assign(score=score, flag=marked.astype(float))

    return df.groupBy(*partition).applyInPandas(run, schema).withColumn("flag", F.col("flag").cast("int"))


def _arima_terms(x: np.ndarray, mean: float, p: int, d: int, q: int, beta: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients (fitted unless given) and one-step errors of a series; the errors of the last round stand for the moving-average terms."""
    y, lag = np.diff(x, d) if d else x - mean, max(p, q)
    error = np.zeros(len(y))
    if len(y) <= lag:
        return np.zeros(1 + p + q), error, y
    given = beta
    for _ in range(5):
        rows = np.column_stack([np.ones(len(y) - lag), *[y[lag - i : len(y) - i] for i in range(1, p + 1)], *[error[lag - i : len(y) - i] for i in range(1, q + 1)]])
        beta = np.linalg.lstsq(rows, y[lag:], rcond=None)[0] if given is None else given
        error[lag:] = y[lag:] - rows @ beta
    return beta, error, y


def _filled(pdf: pd.DataFrame, value: str, order: list[str]) -> np.ndarray:
    x = pdf.sort_values(order)[value].to_numpy(float)
    return np.where(np.isnan(x), np.nanmean(x) if (~np.isnan(x)).any() else 0.0, x)


#: Rows that are filtered together; series are dealt to bundles of about so many, and a series lies in one.
BUNDLE = 100_000


def _bundled(df: DataFrame, partition: list[str], bundles: int) -> DataFrame:
    return df.withColumn("_bundle", F.pmod(F.xxhash64(F.lit(0), *partition), F.lit(bundles)))


def _by_entity(pdf: pd.DataFrame, partition: list[str]) -> list[tuple[tuple, pd.DataFrame]]:
    """Key (None for null) and rows of each entity; without partition columns all rows are one series."""
    if not len(pdf):
        return []
    groups = [g for _, g in pdf.groupby(partition, dropna=False, sort=False)] if partition else [pdf]
    return [(tuple(None if pd.isna(g[c].iloc[0]) else g[c].iloc[0] for c in partition), g) for g in groups]


def arima_fit(df: DataFrame, value: str, partition: list[str], order: list[str], p: int = 1, d: int = 1, q: int = 1, exact: bool = True) -> DataFrame:
    """partition, mean, beta, deviation, loglik: an ARIMA(p, d, q) of each entity; short series have no deviation.

    Coefficients are the likeliest ones (``operators.arima``; a constant only for d = 0), for many series of a bundle at
    once, or with ``exact=False`` by conditional least squares, with a constant and without loglik. Missing values are
    filled with the series' mean.
    """
    types = dict(df.dtypes)

    def least_squares(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _filled(pdf, value, order)
        beta, error, y = _arima_terms(x, float(x.mean()), p, d, q, None)
        enough = len(y) > 2 * (p + q) + 2
        return pd.DataFrame([[*(pdf[c].iloc[0] for c in partition), float(x.mean()), beta.tolist(), float(error[max(p, q) :].std()) if enough else None, None]], columns=[*partition, "mean", "beta", "deviation", "loglik"])

    def likeliest(pdf: pd.DataFrame) -> pd.DataFrame:
        groups = [g for _, g in _by_entity(pdf, partition)]
        found = arima.fit_many([_filled(g, value, order) for g in groups], p, d, q)
        return pd.DataFrame([[*(g[c].iloc[0] for c in partition), *f] for g, f in zip(groups, found, strict=True)], columns=[*partition, "mean", "beta", "deviation", "loglik"])

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in partition), "mean double", "beta array<double>", "deviation double", "loglik double"])
    own = df.select(*partition, *order, value)
    if not exact:
        return own.groupBy(*partition).applyInPandas(least_squares, schema)
    return _bundled(own, partition, df.count() // BUNDLE + 1).groupBy("_bundle").applyInPandas(likeliest, schema)


def arima_drift(df: DataFrame, value: str, partition: list[str], order: list[str], p: int = 1, d: int = 1, q: int = 1, threshold: float = 2.0, fitted: DataFrame | None = None, exact: bool = True) -> DataFrame:
    """Absolute one-step residual of an ARIMA(p, d, q) in residual deviations.

    Each entity's model is its own row of ``fitted`` (from ``arima_fit`` with the same ``exact``), or is learned from
    ``df`` itself. Entities without a model and series too short for one score 0.
    """
    models = fitted if fitted is not None else arima_fit(df, value, partition, order, p, d, q, exact)
    schema = StructType([*df.schema.fields, StructField("score", DoubleType()), StructField("flag", DoubleType())])

    def errors(series: list[np.ndarray], held: list[pd.Series]) -> list[np.ndarray]:
        betas = [np.array(m["beta"], float) for m in held]
        if exact:
            return arima.errors_many(series, [m["mean"] for m in held], betas, p, d, q)
        return [_arima_terms(x, m["mean"], p, d, q, beta)[1] for x, m, beta in zip(series, held, betas, strict=True)]

    def score(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        known = {k: m.iloc[0] for k, m in _by_entity(found, partition) if pd.notna(m["deviation"].iloc[0])}
        rows = rows.drop(columns="_bundle").sort_values(order).reset_index(drop=True).assign(score=0.0)
        modelled = [(g, known[k]) for k, g in _by_entity(rows, partition) if k in known]
        out = np.zeros(len(rows))
        for (g, m), error in zip(modelled, errors([_filled(g, value, order) for g, _ in modelled], [m for _, m in modelled]), strict=True):
            own = np.zeros(len(g))
            own[d:] = np.abs(error) / (m["deviation"] + 1e-10) if len(error) else 0
            own[:1] = 0
            out[g.index.to_numpy()] = own
        return rows.assign(score=out, flag=(out > threshold).astype(float))

    bundles = df.count() // BUNDLE + 1
    both = _bundled(df, partition, bundles).groupBy("_bundle").cogroup(_bundled(models, partition, bundles).groupBy("_bundle"))
    return both.applyInPandas(score, schema).withColumn("flag", F.col("flag").cast("int"))


#: Low-pass synthesis taps of orthogonal wavelets, and the four filters (analysis low and high, synthesis low and high) of a
#: biorthogonal one (fixed values).
ORTHOGONAL = {
    "haar": (0.7071067811865476, 0.7071067811865476),
    "db2": (0.48296291314469025, 0.836516303737469, 0.22414386804185735, -0.12940952255092145),
    "db4": (0.23037781330885523, 0.7148465705525415, 0.6308807679295904, -0.02798376941698385, -0.18703481171888114, 0.030841381835986965, 0.032883011666982945, -0.010597401784997278),
}
BIOR22 = (
    (0.0, -0.1767766952966369, 0.3535533905932738, 1.0606601717798214, 0.3535533905932738, -0.1767766952966369),
    (0.0, 0.3535533905932738, -0.7071067811865476, 0.3535533905932738, 0.0, 0.0),
    (0.0, 0.3535533905932738, 0.7071067811865476, 0.3535533905932738, 0.0, 0.0),
    (0.0, 0.1767766952966369, 0.3535533905932738, -1.0606601717798214, 0.3535533905932738, 0.1767766952966369),
)


def wavelet_filters(name: str) -> tuple[np.ndarray, ...]:
    """Analysis low and high, synthesis low and high; ValueError for an unknown wavelet."""
    if name == "bior2.2":
        return tuple(np.array(f) for f in BIOR22)
    if name not in ORTHOGONAL:
        raise ValueError(f"unknown wavelet {name!r}")
    low = np.array(ORTHOGONAL[name])
    high = low[::-1] * (-1.0) ** np.arange(len(low))
    return low[::-1], high[::-1], low, high


def wavelet_levels(x: np.ndarray, level: int = 5, name: str = "db4") -> tuple[np.ndarray, list[np.ndarray]]:
    """Approximation and details (finest first) of a decimated transform with symmetric ends."""
    low, high, _, _ = wavelet_filters(name)
    details = []
    for _ in range(level):
        if len(x) < len(low):
            break
        y = np.pad(x, len(low) - 1, "symmetric")
        details.append(np.convolve(y, high, "valid")[1::2])
        x = np.convolve(y, low, "valid")[1::2]
    return x, details


def wavelet_inverse(x: np.ndarray, details: list[np.ndarray], name: str = "db4") -> np.ndarray:
    """The series of an approximation and its details (perhaps with one value more at the end), in time linear in its length."""
    _, _, low, high = wavelet_filters(name)
    for d in reversed(details):
        up = np.zeros((2, 2 * len(d)))
        up[0, ::2], up[1, ::2] = x[: len(d)], d
        x = (np.convolve(up[0], low) + np.convolve(up[1], high))[len(low) - 2 : 2 * len(d)]
    return x


def wavelet_detector(df: DataFrame, value: str, partition: list[str], order: list[str], factor: float = 3.0, level: int = 5, wavelet: str = "db4") -> DataFrame:
    """Detail coefficients over a robust limit of their level add to the rows below them; flag over the 95th percentile."""

    def made(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        score = np.zeros(len(x))
        for d in wavelet_levels(x, level, wavelet)[1]:
            size = np.abs(d)
            limit = np.median(size) + factor * np.median(np.abs(size - np.median(size))) / 0.6745
            width = max(1, len(x) // max(1, len(d)))
            for i in np.flatnonzero(size > limit):
                score[i * width : (i + 1) * width] += size[i]
        over = np.percentile(score[score > 0], 95) if (score > 0).any() else np.inf
        return score, score > over

    return _per_series(df, value, partition, order, made)


def wavelet_denoise(df: DataFrame, value: str, partition: list[str], order: list[str], level: int = 5, soft: bool = True, wavelet: str = "db4") -> DataFrame:
    """Adds ``denoised``: details under the universal threshold are shrunk, the rest put together again. Missing values count as the mean."""
    wavelet_filters(wavelet)
    schema = StructType([*df.schema.fields, StructField("denoised", DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        x = _filled(pdf, value, order)
        rest, details = wavelet_levels(x, level, wavelet)
        if not details:
            return pdf.assign(denoised=x)
        limit = np.median(np.abs(details[0])) / 0.6745 * np.sqrt(2 * np.log(max(len(x), 2)))
        details = [np.sign(d) * np.maximum(np.abs(d) - limit, 0) if soft else np.where(np.abs(d) > limit, d, 0) for d in details]
        return pdf.assign(denoised=wavelet_inverse(rest, details, wavelet)[: len(x)])

    return df.groupBy(*partition).applyInPandas(run, schema)


@dataclass
class Ensemble(Detector):
    """Scorers on one table. ``vote``: flags by how many of them see a row over their 95th percentile; else a combined score."""

    scorers: list[Scorer] = field(default_factory=list)
    method: str = "mean"
    votes: int = 2
    percentile: float = 95.0

    def fit(self, df: DataFrame) -> Ensemble:
        for s in self.scorers:
            s.fit(df)
        self.fitted = {"n": len(self.scorers)}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        kept, names = df.columns, [f"_s{i}" for i in range(len(self.scorers))]
        for name, s in zip(names, self.scorers, strict=True):
            df = s.transform(df).select(*[c for c in df.columns if c not in ("score", "flag") or c in kept], F.col("score").alias(name))
        df = cut(df, "scores")
        all_ = F.array(*names)
        mean = F.aggregate(all_, F.lit(0.0), lambda a, x: a + x) / len(names)
        ordered_ = F.array_sort(all_)
        half = len(names) // 2
        median = ordered_[half] if len(names) % 2 else (ordered_[half - 1] + ordered_[half]) / 2
        combined = {"mean": mean, "vote": mean, "max": F.array_max(all_), "min": F.array_min(all_), "median": median}[self.method]
        df = df.withColumn("score", combined)
        limits = quantiles(df, {c: (F.col(c), [self.percentile / 100]) for c in [*names, "score"]})
        over = {c: flag(F.col(c) > F.lit(x[0])) for c, x in limits.items()}
        votes = sum((over[c] for c in names), F.lit(0))
        df = df.withColumn("votes", votes).withColumn("flag", flag(F.col("votes") >= self.votes) if self.method == "vote" else over["score"])
        return df.select(*kept, "score", "votes", "flag")
