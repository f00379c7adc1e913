"""Exact nearest neighbours by cells around pivots, and the outlier factor whose model is a table.

Every row belongs to the cell of its nearest pivot. The rows known to lie closest to each pivot bound how far a query's k-th
neighbour can be; a query visits only cells that the triangle inequality and the plane between two pivots leave open. Rows are dealt to
slabs and queries to parts by a hash, each slab meets each part in a task of its own: what is moved is a few copies of both tables,
whatever can be left out, and neither a large cell nor a frequent point is ever whole in one task. In a task products of matrices tell
which rows may be near, and those alone are measured exactly. Where no cell can be left out (very many dimensions) the products are
quadratic, memory and disk stay bounded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.ordering import quantile
from tidewatch.sources.scratch import cut

#: At most so many pivots (what tasks are sent grows with them alone); fewer rows or queries than these are not dealt further.
PIVOTS, CHUNK, BLOCK = 512, 4000, 1000

#: Numbers of a slab or a part.
SLAB = 8_000_000

#: Queries and rows of one product.
ASKED, HELD = 1000, 8192


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By products around a common origin, which keeps their error small against the spread of the rows."""
    a, b = a - b.mean(axis=0), b - b.mean(axis=0)
    return np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * a @ b.T, 0))


def _rows(part: pd.Series) -> np.ndarray:
    return np.array(part.tolist(), float)


def _read(part: pd.Series, width: int, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(part), dtype).reshape(-1, width).astype(float)


def _visited(d: np.ndarray, reach: np.ndarray, home: np.ndarray, pivots: np.ndarray, between: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Which cells (queries, pivots) may hold one of the nearest rows, from the queries' distances to the pivots."""
    each, slack = np.arange(len(d)), 1e-6 * (1 + d.max(axis=1) + radius.max())
    plane = (d**2 - d[each, home][:, None] ** 2) / (2 * np.maximum(between[home], 1e-300))
    plane[each, home] = 0
    return (d - radius <= (reach + slack)[:, None]) & (plane <= (reach + slack)[:, None])


def _best(query: np.ndarray, d: np.ndarray, id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k first of each query by distance and id, in order."""
    order = np.lexsort((id, d, query))
    query, d, id = query[order], d[order], id[order]
    kept = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[kept], d[kept], id[kept]


def closest_rows(q: np.ndarray, reach: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query, d, id of the k rows of ``x`` closest to each query among those within its reach, in order.

    Squares of distances come from products (in single precision where its error is small against the reach); what they don't exclude
    is measured by differences. The reach shrinks to the k-th row found so far.
    """
    middle = x.mean(axis=0)
    a, b = q - middle, x - middle
    own, other = (a**2).sum(axis=1), (b**2).sum(axis=1)
    error = 8 * (q.shape[1] + 8) * (own.max() + other.max())
    limit = reach**2 * (1 + 1e-9)
    if len(x) > k:  # a first look in double precision
        first = own[:, None] + other[:HELD] - 2 * (a @ b[:HELD].T)
        if first.shape[1] > k:
            limit = np.minimum(limit, np.partition(first, k - 1, axis=1)[:, k - 1] + error * np.finfo(np.float64).eps)
    dtype = np.float32 if error * np.finfo(np.float32).eps < 0.01 * limit.min() else np.float64
    slack = error * np.finfo(dtype).eps
    a, wide = np.c_[-2 * a, np.ones(len(a))].astype(dtype), np.empty((len(b), b.shape[1] + 1), dtype)
    wide[:, :-1], wide[:, -1] = b, other
    limit += slack
    found = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def settled() -> None:
        nonlocal found
        i, j = (np.concatenate(c) for c in zip(*waiting, strict=True))
        waiting.clear()
        d = np.zeros(len(i))
        for c in range(q.shape[1]):
            d += (q[i, c] - x[j, c]) ** 2
        found = _best(np.concatenate([found[0], i]), np.concatenate([found[1], np.sqrt(d)]), np.concatenate([found[2], ids[j]]), k)
        n = np.bincount(found[0], minlength=len(q))
        full = np.flatnonzero(n >= k)
        limit[full] = np.minimum(limit[full], found[1][np.cumsum(n)[full] - 1] ** 2 * (1 + 1e-9) + slack)

    for at in range(0, len(x), HELD):
        near = a @ wide[at : at + HELD].T
        i, j = np.divmod(np.flatnonzero(near <= (limit - own).astype(dtype)[:, None] + dtype(slack)), near.shape[1])
        if len(i):
            waiting.append((i, j + at))
        if sum(len(i) for i, _ in waiting) > 4 * k * len(q):
            settled()
    if waiting:
        settled()
    return found


def nearest(queries: DataFrame, rows: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """id, near: the k nearest of ``rows(id, x)`` to each of ``queries(id, x)`` as an array of (d, id), closest first.

    ids are longs and unique in each table, x are arrays of one length without missing values. With fewer than k rows all are returned;
    of rows at one distance the smaller ids come first. Without rows or queries there is nothing to return.
    """
    n = rows.count()
    empty = queries.sparkSession.createDataFrame([], "id long, near array<struct<d: double, id: long>>")
    if not n:
        return empty
    k = min(k, n)
    drawn = rows.orderBy(F.xxhash64(F.lit(seed), "id")).limit(min(PIVOTS, max(1, math.isqrt(n)))).select("x").toPandas()
    pivots = np.unique(_rows(drawn["x"]), axis=0)

    def settle(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                d = _distances(_rows(part["x"]), pivots)
                cell = d.argmin(axis=1)
                yield part.assign(cell=cell.astype(np.int32), d=d[np.arange(len(d)), cell])

    def closest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, np.ndarray] = {}
        for part in parts:
            for cell, d in part.groupby("cell")["d"]:
                best[cell] = np.sort(np.concatenate([best.get(cell, np.zeros(0)), d.to_numpy()]))[:k]
        for cell, d in best.items():
            yield pd.DataFrame({"cell": cell, "d": d})

    cells = cut(rows.select("id", "x").mapInPandas(settle, "id long, x array<double>, cell int, d double"), "cells")
    radius, bound = np.zeros(len(pivots)), np.full((len(pivots), k), np.inf)
    for r in cells.groupBy("cell").agg(F.max("d").alias("d")).collect():  # one row a pivot
        radius[r.cell] = r.d
    order = Window.partitionBy("cell").orderBy("d")
    few = cells.select("cell", "d").mapInPandas(closest, "cell int, d double").withColumn("k", F.row_number().over(order)).where(F.col("k") <= k)
    for r in few.collect():  # k rows a pivot
        bound[r.cell, r.k - 1] = r.d
    between = _distances(pivots, pivots)

    asked = queries.count()
    width = pivots.shape[1]
    side = math.isqrt(4 * queries.sparkSession.sparkContext.defaultParallelism) + 1
    slabs, shares = (max(-(-m * width // SLAB), min(side, -(-m // least))) for m, least in ((n, CHUNK), (asked, BLOCK)))
    if not asked:
        return empty
    # half the bytes to move if single precision holds the numbers as they are
    single = F.bool_and(F.col("x").cast("array<float>").cast("array<double>") == F.col("x"))
    dtype = "<f4" if all(t.agg(single).first()[0] for t in (rows, queries)) else "<f8"
    pack = lambda x: [r.tobytes() for r in x.astype(dtype)]

    def visit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, 4_000_000 // bound.size)
        for part in parts:
            for at in range(0, len(part), step):
                x = _rows(part["x"].iloc[at : at + step])
                d = _distances(x, pivots)
                reach = np.partition((d[:, :, None] + bound[None]).reshape(len(d), -1), k - 1, axis=1)[:, k - 1]
                yield pd.DataFrame({"id": part["id"].iloc[at : at + step].to_numpy(), "x": pack(x), "reach": reach + 1e-6 * (1 + d.max(axis=1) + radius.max())})

    def packed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                yield part.assign(x=pack(_rows(part["x"])))

    def search(asking: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        ds, others = [], []
        held = held.sort_values("cell")
        x, ids, cell = _read(held["x"], width, dtype), held["id"].to_numpy(), held["cell"].to_numpy()
        q, reach = _read(asking["x"], width, dtype), asking["reach"].to_numpy()
        d = np.concatenate([_distances(q[at : at + 4000], pivots) for at in range(0, len(q), 4000)]) if len(q) else np.zeros((0, len(pivots)))
        home = d.argmin(axis=1)
        order = np.argsort(home, kind="stable")
        for at in range(0, len(q) if len(x) else 0, ASKED):
            own = order[at : at + ASKED]
            open_to = _visited(d[own], reach[own], home[own], pivots, between, radius).any(axis=0)[cell]
            some, names = (x, ids) if open_to.all() else (x[open_to], ids[open_to])
            query, far, id = closest_rows(q[own], reach[own], some, names, k) if len(some) else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
            cuts = np.searchsorted(query, np.arange(1, len(own)))
            ds += np.split(far, cuts)
            others += np.split(id, cuts)
        return pd.DataFrame({"id": asking["id"].to_numpy()[order[: len(ds)]], "d": ds, "other": others})

    visits = cut(queries.select("id", "x").mapInPandas(visit, "id long, x binary, reach double"), "visits")
    dealt = lambda m: F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    asking = visits.withColumn("part", dealt(shares)).withColumn("slab", every(slabs))
    held = cells.select("id", "x", "cell").mapInPandas(packed, "id long, x binary, cell int").withColumn("slab", dealt(slabs)).withColumn("part", every(shares))
    found = asking.groupBy("slab", "part").cogroup(held.groupBy("slab", "part")).applyInPandas(search, "id long, d array<double>, other array<long>")
    found = found.select("id", F.arrays_zip(F.col("d"), F.col("other").alias("id")).cast("array<struct<d: double, id: long>>").alias("near"))
    merged = F.flatten(F.collect_list("near"))
    return cut(found.groupBy("id").agg(F.slice(F.array_sort(merged), 1, k).alias("near")), "neighbours")


def outlier_factors(near: DataFrame, model: DataFrame | None = None) -> DataFrame:
    """id, lof, radius, density of rows with their neighbours: density against the neighbours'.

    Without a model the rows are each other's neighbours; with ``model(id, radius, density)`` they are new.
    """
    edges = near.select("id", F.explode("near").alias("e")).select("id", "e.d", F.col("e.id").alias("other"))
    own = near.select("id", F.element_at("near", -1)["d"].alias("radius"))
    known = (own if model is None else model).withColumnRenamed("id", "other")
    reach = edges.join(known.select("other", "radius"), "other")
    density = reach.groupBy("id").agg((1 / (F.avg(F.greatest("d", "radius")) + 1e-10)).alias("density"))
    dense = (density if model is None else model).select(F.col("id").alias("other"), F.col("density").alias("of_other"))
    lof = edges.join(dense, "other").groupBy("id").agg(F.avg("of_other").alias("others"))
    return own.join(density, "id").join(lof, "id").select("id", (F.col("others") / F.col("density")).alias("lof"), "radius", "density")


def outliers(rows: DataFrame, k: int) -> DataFrame:
    """id, lof, radius, density of ``rows(id, x)`` among themselves; a row is not its own neighbour."""
    near = nearest(rows, rows, k + 1)
    others = near.select("id", F.slice(F.filter("near", lambda e: e["id"] != F.col("id")), 1, k).alias("near"))
    return cut(outlier_factors(others), "factors")


def fit_outliers(rows: DataFrame, k: int, contamination: float) -> tuple[DataFrame, float]:
    """The model of ``rows(id, x)``: id, x, radius, density as a table, and the limit of the share of outliers."""
    found = outliers(rows, k)
    limit = quantile(found, F.col("lof"), 1 - contamination)
    return cut(rows.join(found.select("id", "radius", "density"), "id"), "outlier-model"), limit
