"""Embedding whitening with an exact scatter by residue numbers.

Each entry c becomes the whole number x = floor(256 * c). The fit list is each distinct x vector
once; it is written, so a vector that a third of all rows repeat is one row. The scatter of the list,
sums of products over all pairs of dimensions, is exact: each task takes its rows modulo several
primes below 2^20, multiplies blocks of at most 4,096 rows as doubles (every partial sum stays below
2^53, so the products are exact whole numbers), and gives one row for each prime and cell of the upper
triangle. Spark sums the cells; the residues are put together by Chinese remaindering. There are as
many primes as n * max(x)^2 needs, so no size of table or entry passes the range. A column of ones
beside the vector gives the sums S and the number of rows n in the same products.

Covariances follow in whole numbers, n * scatter - S * S', which is centring without loss, and are
rounded to double once; `eigh` in double precision gives the components, the largest entry of each
positive. What reaches the driver is the d x d scatter, whatever the number of rows. The last pass
over the fit list measures the covariance of what was whitened, centred, by `covar_pop`.

Defined results: rows are dropped whose vector is null, or holds null, NaN or infinite entries, or
whose length is not the table's commonest (ties: the longer), or is zero; repeated rows and rows
without an id stay, each with its own result; components are numbered to min(`top`, d). An eigenvalue
that is zero but for rounding (at most d * 2^-52 of the largest) has no whitened value: null there,
and null for explained if the whole variance is zero. `deviation` is exact, and null if it passes 64
bits. An empty table gives an empty table; entries whose 256-fold passes 64 bits are held at its ends.
The columns of the result are the id and new ones, so others can't clash.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, settled

BLOCK = 4096


def primes(bound: int, below: int = 1 << 20) -> list[int]:
    """The largest primes under `below` whose product passes `bound`."""
    found, product, p = [], 1, below - 1
    while product <= bound:
        if all(p % q for q in range(3, int(p**0.5) + 1, 2)):
            found.append(p)
            product *= p
        p -= 2
    return found


def whole(vector: str):
    return F.transform(vector, lambda c: F.floor(F.lit(256.0) * c.cast("double")) + F.lit(0).cast("long"))


def usable(rows: DataFrame, vector_col: str) -> DataFrame:
    """(vec_id, x) of the rows that count, before lengths are compared."""
    finite = F.forall(vector_col, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return rows.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & F.coalesce(finite, F.lit(False)))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def residues(batches: Iterator[pa.RecordBatch], moduli: list[int], d: int) -> Iterator[pa.RecordBatch]:
    """One row (prime, cell, residue) for each prime and cell of the upper triangle, for all rows of a task."""
    upper = np.triu_indices(d + 1)
    sums = np.zeros((len(moduli), len(upper[0])), dtype=np.int64)
    seen = False
    for batch in batches:
        x = _matrix(batch.column(0), d)
        for start in range(0, len(x), BLOCK):
            part = x[start : start + BLOCK]
            seen = True
            for k, p in enumerate(moduli):
                m = np.empty((len(part), d + 1))
                m[:, 0], m[:, 1:] = 1, part % p
                sums[k] = (sums[k] + np.fmod(m.T @ m, p)[upper].astype(np.int64)) % p
    if seen:
        cells = np.arange(sums.shape[1], dtype=np.int32)
        for k, p in enumerate(moduli):
            yield pa.record_batch({"prime": pa.array([p] * len(cells), pa.int32()), "cell": cells, "residue": sums[k]})


def remaindered(found: dict[int, list[int]], moduli: list[int]) -> int:
    """The whole number between -M/2 and M/2 that has these residues."""
    product, total = 1, 0
    for p in moduli:
        total += product * ((found[p] - total) * pow(product, -1, p) % p)
        product *= p
    return total if 2 * total < product else total - product


@dataclass
class Model:
    n: int
    sums: list[int]
    vectors: np.ndarray  # d x components
    values: np.ndarray
    trace: float
    positive: np.ndarray  # which components have variance

    def whiten(self, x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """Whitened values (rows x components) and exact deviations."""
        largest = self.n * float(np.abs(x.astype(float)).max(initial=1.0)) + max(map(abs, self.sums), default=0)
        if largest**2 * x.shape[1] < 2.0**62:
            off = self.n * x - np.array(self.sums, dtype=np.int64)
            deviation = (off * off).sum(axis=1).tolist()
        else:
            off = self.n * x.astype(object) - np.array(self.sums, dtype=object)
            deviation = [v if v < 1 << 63 else None for v in (off * off).sum(axis=1)]
        centred = (off / self.n).astype(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            return (centred @ self.vectors) / np.sqrt(np.where(self.positive, self.values, np.nan)), deviation


def _scatter(fit: DataFrame, d: int) -> tuple[int, list[int], list[list[int]]]:
    """(n, S, scatter) of the vectors in `fit`, exact."""
    size, most = fit.agg(F.count("*"), F.max(F.array_max(F.transform("x", lambda v: F.abs(v.cast("decimal(20, 0)")))))).first()
    moduli = primes(2 * size * max(1, int(most)) ** 2)
    parts = fit.select("x").mapInArrow(lambda batches: residues(batches, moduli, d), "prime int, cell int, residue long")
    found: dict[int, dict[int, int]] = {}
    for r in parts.groupBy("prime", "cell").agg(F.sum("residue").alias("residue")).toLocalIterator():
        found.setdefault(r["cell"], {})[r["prime"]] = r["residue"] % r["prime"]
    full = [[0] * (d + 1) for _ in range(d + 1)]
    for cell, (i, j) in enumerate(zip(*np.triu_indices(d + 1), strict=True)):
        full[i][j] = full[j][i] = remaindered(found[cell], moduli)
    return full[0][0], full[0][1:], [row[1:] for row in full[1:]]


def fit(distinct: DataFrame, d: int, top: int = 4) -> Model:
    n, sums, scatter = _scatter(distinct, d)
    v = np.array([[(n * scatter[i][j] - sums[i] * sums[j]) / (n * n) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:top], vectors[:, ::-1][:, :top]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    trace = sum(n * scatter[i][i] - sums[i] * sums[i] for i in range(d)) / (n * n)
    return Model(n, sums, vectors, values, trace, values > d * 2.0**-52 * max(values[0], 0.0))


def _identity_error(distinct: DataFrame, model: Model, d: int) -> float | None:
    """Largest entry of |covariance of the whitened fit list - identity|, over components with variance."""
    used = [k for k in range(len(model.values)) if model.positive[k]]
    if not used:
        return None

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, _ = model.whiten(_matrix(batch.column(0), d))
            yield pa.record_batch({f"w{k}": w[:, k] for k in used})

    rows = distinct.select("x").mapInArrow(whitened, ", ".join(f"w{k} double" for k in used))
    pairs = [(i, j) for i in used for j in used if i <= j]
    found = rows.agg(*(F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs)).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


@settled("whitened")
def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", top: int = 4) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error), a row for each usable row and component."""
    schema = f"{id_col} long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    good = usable(rows, vector_col).select(F.col(id_col).cast("long").alias("id"), whole(vector_col).alias("x"))
    length = good.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if length is None:
        return rows.sparkSession.createDataFrame([], schema)
    d = length["d"]
    good = good.where(F.size("x") == d)
    stage = Stage(good.select("x").distinct(), "vectors")
    model = fit(stage.read(), d, top)
    error, count = _identity_error(stage.read(), model, d), len(model.values)
    explained = [float(v / model.trace) if model.trace > 0 else None for v in model.values]

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, deviation = model.whiten(_matrix(batch.column(1), d))
            rows = batch.num_rows
            yield pa.record_batch({
                id_col: batch.column(0).take(pa.array(np.repeat(np.arange(rows), count))),
                "component": pa.array(np.tile(np.arange(1, count + 1), rows), pa.int32()),
                "n": pa.array([model.n] * (rows * count), pa.int64()),
                "deviation": pa.array([v for v in deviation for _ in range(count)], pa.int64()),
                "whitened": pa.array(w.ravel(), pa.float64(), from_pandas=True),
                "explained": pa.array(explained * rows, pa.float64()),
                "identity_error": pa.array([error] * (rows * count), pa.float64()),
            })

    return good.mapInArrow(results, schema)
