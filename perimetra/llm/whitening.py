"""Embedding whitening from an exact scatter in residues.

Entries become integers, x = floor(64 c) + 1,000,000, whose mean is far larger than their spread; a scatter in doubles
would lose what matters. Each task takes the products of its distinct vectors modulo several primes below 2**20, as
matrix products of doubles that are exact (8,192 rows at a time stay below 2**53), and returns one matrix for each prime.
The matrices are added in Spark by prime and row; so many primes are taken that their product exceeds twice the largest
scatter the table can have, and Chinese remaindering gives the exact sums of the counts, entries and products. Covariance
is made from these integers, centred before anything is rounded, and decomposed twice in double precision.

The driver holds one dims x dims matrix for each prime, whatever the number of rows.

Edge cases: vectors that are null, empty, of another length than the first usable one by vec_id, hold null or non-finite
entries, or entries of 2**55 or more take no part; repeated rows each get their rows, but count once in the fit, as do
ties of x under several vec_ids; rows without a vec_id take part; an empty table gives no rows. Components whose
eigenvalue is zero to double precision have no whitened value (null, and 0 as explained; both null if all are zero), and
identity_error is over the others (0 without any). deviation is null where it exceeds a long. Extra columns are not
carried.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perimetra.llm.common import bounded_batches, common_width, full_vectors, materialize

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
#: Entries must stay below this, so that x is exact in a double and n * x in most tables in a long.
LARGEST = float(2**61 // SCALE)
#: Residues are below 2**20, so the products of this many rows add up to less than 2**53.
EXACT_ROWS = 8192


def primes_beyond(bound: int) -> list[int]:
    """The largest primes below 2**20, so many that their product is more than `bound`."""
    found, product, candidate = [], 1, 2**20
    while product <= bound:
        candidate -= 1
        if all(candidate % k for k in range(2, math.isqrt(candidate) + 1)):
            found.append(candidate)
            product *= candidate
    return found


def integers(vectors: np.ndarray) -> np.ndarray:
    return np.floor(vectors * SCALE).astype(np.int64) + SHIFT


def _largest(vectors: np.ndarray) -> np.ndarray:
    return np.abs(vectors).max(axis=1, initial=0)


def _usable(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    at, vectors = full_vectors(column, width)
    fine = _largest(vectors) < LARGEST if len(at) else np.zeros(0, np.bool_)
    return at[fine], integers(vectors[fine])


def fit_list(rows: DataFrame, width: int) -> DataFrame:
    """key: each distinct x vector once, as bytes of 4 or, where an entry needs them, 8 to an entry."""

    def to_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _usable(batch.column("embedding"), width)[1]
            small = (np.abs(x) < 2**31).all(axis=1)
            keys = [r.tobytes() for r in x[small].astype(np.int32)] + [r.tobytes() for r in x[~small]]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary())], names=["key"])

    return rows.select("embedding").mapInArrow(to_keys, "key binary").distinct()


def _unpacked(column: pa.Array, width: int) -> np.ndarray:
    keys = column.to_pylist()
    few = [k for k in keys if len(k) == 4 * width]
    many = [k for k in keys if len(k) != 4 * width]
    return np.concatenate((np.frombuffer(b"".join(few), np.int32).reshape(-1, width).astype(np.int64), np.frombuffer(b"".join(many), np.int64).reshape(-1, width)))


def residue_scatter(keys: DataFrame, width: int, primes: list[int]) -> DataFrame:
    """prime, row, residues: row by row, from the diagonal on, the products of (1, x) with itself summed modulo each prime."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(primes), width + 1, width + 1), np.int64)
        for batch in batches:
            x = _unpacked(batch.column("key"), width)
            for low in range(0, len(x), EXACT_ROWS):
                few = np.column_stack((np.ones(len(x[low : low + EXACT_ROWS]), np.int64), x[low : low + EXACT_ROWS]))
                for k, p in enumerate(primes):
                    part = (few % p).astype(np.float64)
                    total[k] = (total[k] + (part.T @ part).astype(np.int64)) % p
        rows = [total[k, i, i:] for k in range(len(primes)) for i in range(width + 1)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(primes, width + 1), pa.int64()), pa.array(np.tile(np.arange(width + 1), len(primes)), pa.int32()), pa.array(rows, pa.list_(pa.int64()))], names=["prime", "row", "residues"]
        )

    def add(table: pa.Table) -> pa.Table:
        prime, row = table.column("prime")[0].as_py(), table.column("row")[0].as_py()
        sums = table.column("residues").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1).sum(axis=0) % prime
        return pa.table({"prime": pa.array([prime], pa.int64()), "row": pa.array([row], pa.int32()), "residues": pa.array([sums], pa.list_(pa.int64()))})

    schema = "prime long, row int, residues array<long>"
    return keys.mapInArrow(multiply, schema).groupBy("prime", "row").applyInArrow(add, schema)


def reconstructed(residues: dict[int, np.ndarray]) -> np.ndarray:
    """Chinese remaindering, entry by entry, to Python integers of either sign; the primes' product bounds twice their size."""
    product = math.prod(residues)
    total = sum(values.astype(object) * (product // p * pow(product // p, -1, p)) for p, values in residues.items()) % product
    return np.where(total > product // 2, total - product, total)


def twice_decomposed(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors, by a second decomposition in the basis of the first: the turned matrix, made in longer
    precision, is all but diagonal and falls from the largest value on, so that small values come out right as well."""
    first = np.linalg.eigh(covariance)[1][:, ::-1]
    turned = first.astype(np.longdouble).T @ covariance.astype(np.longdouble) @ first.astype(np.longdouble)
    values, second = np.linalg.eigh(((turned + turned.T) / 2).astype(np.float64))
    vectors = first @ second
    return values, vectors / np.linalg.norm(vectors, axis=0)


class Fit:
    """Exact count and sums, and the components of the covariance."""

    def __init__(self, scatter: np.ndarray, components: int) -> None:
        """scatter: Python integers, of (1, x) with itself."""
        self.n = int(scatter[0, 0])
        self.sums = scatter[0, 1:]
        exact = self.n * scatter[1:, 1:] - np.outer(self.sums, self.sums)
        square = self.n * self.n
        self.covariance = np.array([[int(v) / square for v in row] for row in exact], np.float64)
        values, vectors = twice_decomposed(self.covariance)
        order = np.argsort(-values, kind="stable")[:components]
        self.values, self.vectors = values[order], vectors[:, order]
        self.real = self.values > max(values.max(), 0) * len(values) * 2.0**-52
        self.values = np.where(self.real, self.values, 0.0)
        self.trace = int(sum(int(exact[i, i]) for i in range(len(exact)))) / square
        self.scaled = self.vectors / np.sqrt(np.where(self.real, self.values, np.inf))

    def differences(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly: as longs or, where these could overflow, as Python integers."""
        most = max(int(np.abs(x).max(initial=0)) * self.n, max(map(abs, self.sums)))
        return x * self.n - self.sums.astype(np.int64) if most < 2**62 else x.astype(object) * self.n - self.sums

    def whitened(self, differences: np.ndarray) -> np.ndarray:
        return (differences / self.n).astype(np.float64) @ self.scaled

    def deviations(self, differences: np.ndarray) -> list[int | None]:
        about = (differences.astype(np.float64) ** 2).sum(axis=1)
        if differences.dtype != object and about.max(initial=0) < 2.0**62:
            return (differences**2).sum(axis=1).tolist()
        exact = [sum(int(v) ** 2 for v in row) for row in differences]
        return [v if v < 2**63 else None for v in exact]


def _identity_error(keys: DataFrame, width: int, fit: Fit) -> float:
    """Largest absolute entry of the covariance of the fit list's whitened values (their mean subtracted) minus the identity."""
    k = len(fit.values)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = fit.whitened(fit.differences(_unpacked(batch.column("key"), width)))
            total += np.vstack((w.sum(axis=0), w.T @ w))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], names=["cell", "total"])

    found = keys.mapInArrow(sums, "cell int, total double").groupBy("cell").agg(F.sum("total").alias("total")).collect()
    total = np.zeros((k + 1) * k)
    for r in found:
        total[r["cell"]] = r["total"]
    total = total.reshape(k + 1, k) / fit.n
    error = np.abs(total[1:] - np.outer(total[0], total[0]) - np.eye(k))[np.ix_(fit.real, fit.real)]
    return float(error.max(initial=0))


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, for each usable row and component."""
    spark = embeddings.sparkSession
    bounded_batches(spark)
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    width, count, most = common_width(rows, _largest, LARGEST)
    if not count:
        return spark.createDataFrame([], out)
    keys = materialize(fit_list(rows, width), "fit-list")
    largest = int(most) * SCALE + SCALE + SHIFT
    primes = primes_beyond(2 * count * largest * largest)
    residues = {p: np.zeros((width + 1, width + 1), np.int64) for p in primes}
    for r in residue_scatter(keys, width, primes).collect():
        residues[r["prime"]][r["row"], r["row"] :] = residues[r["prime"]][r["row"] :, r["row"]] = r["residues"]
    fit = Fit(reconstructed(residues), components)
    error = _identity_error(keys, width, fit)
    k = len(fit.values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, low in itertools.chain.from_iterable(((b, low) for low in range(0, b.num_rows, EXACT_ROWS)) for b in batches):
            few = batch.slice(low, EXACT_ROWS)
            at, x = _usable(few.column("embedding"), width)
            differences = fit.differences(x)
            values = np.ascontiguousarray(fit.whitened(differences))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * k, pa.int32()), pa.array(values.ravel(), mask=np.tile(~fit.real, len(at))))
            yield pa.RecordBatch.from_arrays([few.column("vec_id").take(pa.array(at)), pa.array(fit.deviations(differences), pa.int64()), lists], names=["vec_id", "deviation", "values"])

    share = [float(v) / fit.trace if fit.trace else None for v in fit.values]
    explained = F.array(*[F.lit(s).cast("double") for s in share])
    placed = rows.mapInArrow(project, "vec_id long, deviation long, values array<double>").select("vec_id", "deviation", F.posexplode("values").alias("at", "whitened"))
    return placed.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened", explained[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"))
