"""Approximate nearest neighbours: score-aware anisotropic product quantisation, four-bit table scans, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomline.llm.common import cut, groups_for


@dataclass(frozen=True)
class Config:
    sample_rows: int = 20_000  # rows to fit codebooks on: those whose ids hash lowest; every row is indexed
    parallel_threshold: float = 0.2
    rounds: int = 8
    rerank: int = 100  # rows of each block that are measured exactly for each query, at least
    sure: float = 0.995  # share of errors of the codes that the margin for further rows covers
    least_block: int = 1024
    most_block: int = 65_536
    block_bytes: int = 32 << 20  # of the vectors of a block, of rows or of queries
    seed: int = 3


class Quantizer:
    """Two dimensions to a subspace, 16 centres each. The loss weighs the residual along a vector more than that across it, as only the former shifts the inner products that matter."""

    def __init__(self, dim: int, config: Config):
        self.dim, self.m = dim, -(-dim // 4) * 2
        self.extra = max(0.0, (dim - 1) * config.parallel_threshold**2 / (1 - config.parallel_threshold**2) - 1)
        self.books = np.zeros((self.m, 16, 2))
        self.spread = 1.0

    def _split(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        padded = np.zeros((len(x), self.m * 2))
        padded[:, : self.dim] = x
        norm = np.sqrt((padded**2).sum(1))
        return padded.reshape(len(x), self.m, 2), (padded / np.maximum(norm, 1e-300)[:, None]).reshape(len(x), self.m, 2), norm

    def encode(self, x: np.ndarray, rounds: int = 2) -> np.ndarray:
        """Codes (rows, m): nearest centres, then coordinate descent on the anisotropic loss."""
        parts, unit, norm = self._split(x)
        codes = np.empty((len(x), self.m), np.int64)
        for j in range(self.m):
            codes[:, j] = ((parts[:, j, None] - self.books[j]) ** 2).sum(2).argmin(1)
        along = sum((self.books[j][codes[:, j]] * unit[:, j]).sum(1) for j in range(self.m))
        for _ in range(rounds):
            for j in range(self.m):
                dots = unit[:, j] @ self.books[j].T
                rest = norm - along + np.take_along_axis(dots, codes[:, j, None], 1)[:, 0]
                loss = ((parts[:, j, None] - self.books[j]) ** 2).sum(2) + self.extra * (rest[:, None] - dots) ** 2
                codes[:, j] = loss.argmin(1)
                along = norm - rest + np.take_along_axis(dots, codes[:, j, None], 1)[:, 0]
        return codes

    def fit(self, x: np.ndarray, config: Config) -> "Quantizer":
        if not len(x):
            return self
        parts, unit, norm = self._split(x)
        rng = np.random.default_rng(config.seed)
        for j in range(self.m):
            self.books[j] = parts[rng.choice(len(x), 16, replace=len(x) < 16), j]
        for i in range(config.rounds):
            codes = self.encode(x, 0 if i < config.rounds // 2 else 1)
            for j in range(self.m):
                c, u = codes[:, j], unit[:, j]
                rest = norm - sum((self.books[k][codes[:, k]] * unit[:, k]).sum(1) for k in range(self.m) if k != j)
                total = np.stack([np.bincount(c, weights=parts[:, j, d] + self.extra * rest * u[:, d], minlength=16) for d in range(2)], 1)
                gram = np.stack([np.bincount(c, weights=u[:, a] * u[:, b], minlength=16) for a in range(2) for b in range(2)], 1).reshape(16, 2, 2)
                count = np.bincount(c, minlength=16)
                full = count > 0
                self.books[j][full] = np.linalg.solve(count[full, None, None] * np.eye(2) + self.extra * gram[full], total[full][:, :, None])[:, :, 0]
        return self

    def residual(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """x less what its codes stand for."""
        return x - self.books[np.arange(self.m), codes].reshape(len(x), -1)[:, : self.dim]

    def calibrate(self, x: np.ndarray, k: int, sure: float, asks: int = 256) -> "Quantizer":
        """Set spread: what share of |query| |residual| the error of a near row's inner product stays within, for `sure` of all. Measured on the k nearest rows in x of some of its rows."""
        if len(x) > k:
            residual = self.residual(x, self.encode(x))
            off = np.sqrt((residual**2).sum(1))
            errors = []
            for i in range(0, len(x), max(1, len(x) // asks)):
                near = ((x - x[i]) ** 2).sum(1)
                near[i] = np.inf
                best = np.argpartition(near, k - 1)[:k]
                errors.append(np.abs(residual[best] @ x[i]) / np.maximum(off[best] * np.sqrt((x[i] ** 2).sum()), 1e-300))
            self.spread = min(1.0, float(np.quantile(np.concatenate(errors), sure)))
        return self

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(queries, m / 2, 256): the inner products of two subspaces for each byte of two four-bit codes."""
        t = np.einsum("qmd,mcd->qmc", self._split(q)[0], self.books).astype(np.float32)
        return (t[:, 1::2, :, None] + t[:, ::2, None, :]).reshape(len(q), self.m // 2, 256)


def usable(vector: Column) -> Column:
    """Not null, empty or zero; no null or non-finite component."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def _packed(column: pa.ChunkedArray, kind: np.dtype, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim).astype(np.float64)


def search(vectors: DataFrame, k: int = 10, queries: Column | None = None, config: Config = Config(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest rows of each query by Euclidean distance: query_id, rank, vec_id, score; ties go to the smaller id.

    queries: which rows ask (those whose id is divisible by 100); a query's own id is no candidate. Rows with a null id
    or an unusable vector, or of another length than most (of equally frequent, the longer), take no part. Of query rows
    that share an id the smallest vector asks; as candidates all count. Rows are scanned in blocks of a bounded size,
    each against blocks of queries: nearness is maximum inner product less half the squared norm, read from tables of
    four-bit codes. Each block's best config.rerank are measured exactly, then every row whose nearness could beat the
    k-th of those by the error of its codes, however many they are. Fewer candidates than k give fewer rows.
    """
    spark = vectors.sparkSession
    single = dict(vectors.dtypes)[vector_col] == "array<float>"
    kind = np.dtype(np.float32 if single else np.float64)  # as vectors are sent; they are measured as doubles
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    schema = "query_id long, rank int, vec_id long, score double"
    shape = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    if not shape:
        return spark.createDataFrame([], schema)
    dim, total = shape[0]["dim"], shape[0]["n"]
    rows = rows.filter(F.size("v") == dim)
    sample = rows.orderBy(F.xxhash64("id"), "id", "v").limit(config.sample_rows).toArrow()
    known = _matrix(sample["v"].combine_chunks(), dim)
    book = spark.sparkContext.broadcast(Quantizer(dim, config).fit(known, config).calibrate(known, k, config.sure))
    most = max(1, min(config.most_block, config.block_bytes // (8 * dim)))
    block = min(most, max(config.least_block, total // 64))
    n_data = groups_for(total, block)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("v"), dim)
            codes = book.value.encode(x)
            off = np.sqrt((book.value.residual(x, codes) ** 2).sum(1))
            packed = (codes[:, ::2] | codes[:, 1::2] << 4).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array([r.tobytes() for r in a], pa.binary()) for a in (x.astype(kind), packed)), pa.array(off)], ["id", "x", "codes", "off"])

    asks = (F.col("id") % 100 == 0) if queries is None else queries
    wanted = rows.filter(asks).groupBy("id").agg(F.min("v").alias("v"))
    wanted = cut(wanted)
    n_query = groups_for(wanted.count(), most)
    coded = rows.mapInArrow(index, "id long, x binary, codes binary, off double")
    coded = coded.withColumn("data_block", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(n_data)).cast("int")).withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(n_query - 1))))
    wanted = wanted.withColumn("query_block", F.pmod(F.xxhash64("id"), F.lit(n_query)).cast("int")).withColumn("data_block", F.explode(F.sequence(F.lit(0), F.lit(n_data - 1))))
    rerank = max(config.rerank, k)

    def scan(key: tuple, data: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        if data.num_rows and asked.num_rows:
            data = data.sort_by("id")
            ids, x = data["id"].to_numpy(), _packed(data["x"], kind, dim)
            codes = np.frombuffer(b"".join(data["codes"].to_pylist()), np.uint8).reshape(len(ids), -1).astype(np.intp)
            half, margin = ((x**2).sum(1) / 2).astype(np.float32), (book.value.spread * data["off"].to_numpy()).astype(np.float32)
            qid, q = asked["id"].to_numpy(), _matrix(asked["v"].combine_chunks(), dim)
            for i in range(0, len(qid), 64):
                tables = book.value.tables(q[i : i + 64])
                for a, table in zip(range(i, i + len(tables)), tables, strict=True):
                    near = -half
                    for j in range(codes.shape[1]):
                        near += table[j].take(codes[:, j])
                    near[ids == qid[a]] = -np.inf
                    best = np.arange(len(ids))
                    if len(ids) > rerank:
                        best = np.argpartition(near, -rerank)[-rerank:]
                        square = (q[a] ** 2).sum()
                        apart = np.where(ids[best] == qid[a], np.inf, ((x[best] - q[a]) ** 2).sum(1))
                        kth = (square - np.partition(apart, k - 1)[k - 1]) / 2
                        near[best] = np.inf
                        best = np.flatnonzero(near + margin * np.float32(np.sqrt(square)) >= kth)
                    best = best[ids[best] != qid[a]]
                    score = np.sqrt(((x[best] - q[a]) ** 2).sum(1))
                    best_k = np.lexsort((ids[best], score))[:k]
                    found.append((np.full(len(best_k), qid[a]), ids[best][best_k], score[best_k]))
        cols = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    keys = ["data_block", "query_block"]
    near = coded.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInArrow(scan, "query_id long, vec_id long, score double")
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
