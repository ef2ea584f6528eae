"""Hard negatives by rotated one-bit codes: popcount estimates with intervals that always hold sift the rows, and the survivors are scored as integers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomline.llm.common import cut, groups_for, saved


@dataclass(frozen=True)
class Config:
    positives: int = 5
    negatives: int = 3
    low: int = 50  # a negative's score in per cent of the positive's, from ... to
    high: int = 95
    scale: int = 256
    bits: int = 8  # code bits for each dimension
    planes: int = 6  # bits of a component of a rotated anchor
    seeds: int = 64  # rows of a block that are scored first, to set the bar for the others
    blocks: int = 16  # data blocks at least
    most_block: int = 65_536
    block_bytes: int = 32 << 20
    seed: int = 9


class Codes:
    """Signs of a vector after a random rotation into `bits` times as many dimensions, and what they tell of inner products.

    With c the rotated-back code of v, v = along * c + e, e across c. So <q, v> = along <q, c> + <q, e>, and by
    Cauchy-Schwarz |<q, e>| is at most |e| times the length of q across c. Stored beside the code: |v|, its alignment
    cos(v, c), and |c|. <q, c> itself is estimated by popcounts over the bit planes of the rotated q, within the sum of
    the planes' rounding.
    """

    def __init__(self, dim: int, config: Config):
        self.width = -(-dim * config.bits // 64) * 64
        self.planes = config.planes
        self.turn = np.linalg.qr(np.random.default_rng(config.seed).normal(size=(self.width, dim)))[0]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words of bits (rows, width / 64), norm, alignment and code norm of each row."""
        bits = x @ self.turn.T >= 0
        code = np.where(bits, 1.0, -1.0) @ self.turn / np.sqrt(self.width)
        norm, code_norm = np.sqrt((x**2).sum(1)), np.sqrt((code**2).sum(1))
        alignment = (x * code).sum(1) / np.maximum(norm * code_norm, 1e-300)
        return np.packbits(bits, axis=1).view(np.uint64), norm, np.clip(alignment, -1, 1), code_norm

    def ask(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bit planes (anchors, planes, width / 64) of the rotated anchors; least value, step, sum of steps and rounding of each."""
        turned = q @ self.turn.T
        least = turned.min(1)
        step = np.maximum((turned.max(1) - least) / ((1 << self.planes) - 1), 1e-300)
        level = np.rint((turned - least[:, None]) / step[:, None]).astype(np.int64)
        rounding = np.abs(turned - least[:, None] - step[:, None] * level).sum(1) / np.sqrt(self.width)
        bits = (level[:, None, :] >> np.arange(self.planes)[:, None]) & 1
        return np.packbits(bits.astype(bool), axis=2).view(np.uint64), least, step, level.sum(1), rounding

    def intervals(self, asked: tuple, square: np.ndarray, words: np.ndarray, ones: np.ndarray, norm: np.ndarray, alignment: np.ndarray, code_norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimate of each (anchor, row) inner product, and how far it may be off. words: (width / 64, rows)."""
        planes, least, step, total, rounding = asked
        common = np.zeros((len(planes), words.shape[1]), np.int32)
        for p in range(self.planes):
            count = np.zeros(common.shape, np.uint16)
            for w in range(len(words)):
                count += np.bitwise_count(planes[:, p, w, None] & words[w])
            common += count.astype(np.int32) << p
        dot = (least[:, None] * (2 * ones - self.width) + step[:, None] * (2 * common - total[:, None])) / np.sqrt(self.width)
        along = norm * alignment / np.maximum(code_norm, 1e-300)
        inside = np.maximum(np.abs(dot) - rounding[:, None], 0) / np.maximum(code_norm, 1e-300)
        across = np.sqrt(np.maximum(square[:, None] - inside**2, 0)) * (norm * np.sqrt(1 - alignment**2))
        return along * dot, np.abs(along) * rounding[:, None] + across + 1e-7 * (np.sqrt(square)[:, None] * norm + 1)


def inner(x: np.ndarray, q: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products; as doubles where these hold every sum exactly."""
    return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64) if exact else (x.astype(np.int64) * q.astype(np.int64)).sum(1)


def mine(vectors: DataFrame, anchors: Column | None = None, label: Column | None = None, config: Config = Config(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The first hard negatives of each anchor and positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A component x counts as floor(scale * x). A row's score is its integer inner product with the anchor; higher ones
    come first, ties by smaller id. anchors: which rows ask (those whose id is divisible by 50). An anchor's positives are
    its first config.positives rows of the same label, its negatives for one of them the first config.negatives rows of
    another label whose score is from `low` to `high` per cent of that positive's.

    Rows with a null id, label or vector, an empty one, a null or non-finite component, or another length than most (of
    equally frequent, the longer) take no part; zero vectors do. Rows with the anchor's own id are neither positives nor
    negatives. Of anchor rows that share an id the one with the smallest label and vector asks; as candidates repeated
    rows all count. Fewer candidates give fewer rows; an empty table gives none. Components so large that a score could
    leave 64 bits (for 64 dimensions, beyond 3.7e8) are held at that bound. Other columns are ignored.

    Rows and anchors meet in blocks of bounded bytes, twice: for the positives, then for the negatives between their
    bounds. A block scores the rows with the best estimates, and then all whose interval could beat those: no row is left
    out, whatever the codes are worth. A block gives back each anchor's best alone, so what is sent grows with anchors
    and blocks, not with candidates.
    """
    spark = vectors.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.withColumn("_label", (F.col("label") if label is None else label).cast("string")).filter(F.col(id_col).isNotNull() & F.col("_label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col("_label").alias("label"), F.transform(v, lambda x: F.floor(config.scale * x.cast("double")).cast("long")).alias("v"))
    top = F.greatest(F.array_max("v"), -F.array_min("v") - 1)
    shape = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(top).alias("top")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    if not shape:
        return spark.createDataFrame([], schema)
    dim, total, largest = shape[0]["dim"], shape[0]["n"], shape[0]["top"]
    kind = np.dtype(np.int16 if largest < 1 << 15 else np.int32 if largest < 1 << 31 else np.int64)
    bound = isqrt(((1 << 63) - 1) // dim)
    exact, seeds = dim * (min(int(largest), bound) + 1) ** 2 < 1 << 53, max(config.seeds, config.positives, config.negatives)
    coder = spark.sparkContext.broadcast(Codes(dim, config))  # fixed by the dimension
    most = max(1, min(config.most_block, config.block_bytes // (8 * dim)))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).clip(-bound, bound)
                words, norm, alignment, code_norm = coder.value.encode(x.astype(np.float64))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), *(pa.array([r.tobytes() for r in a], pa.binary()) for a in (x.astype(kind), words)), *map(pa.array, (norm, alignment, code_norm))], coded_names)

    coded_names = ["id", "label", "x", "code", "norm", "alignment", "code_norm"]
    coded = saved(rows.filter(F.size("v") == dim).mapInArrow(index, "id long, label string, x binary, code binary, norm double, alignment double, code_norm double"))
    asks = coded.filter((F.col("id") % 50 == 0) if anchors is None else anchors).groupBy("id").agg(F.min(F.struct("label", "x")).alias("a")).select("id", "a.label", "a.x")
    asks = cut(asks)
    n_data, n_asks = max(config.blocks, groups_for(total, most)), groups_for(asks.count(), most)
    deal = lambda df, own, n, other, m: df.withColumn(own, F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    data = deal(coded, "data_block", n_data, "ask_block", n_asks).groupBy("data_block", "ask_block")

    class Block:
        """Rows of a block by label and id, with the anchors that meet them a label at a time."""

        def __init__(self, table: pa.Table, asked: pa.Table):
            table, self.asked = table.sort_by([("label", "ascending"), ("id", "ascending")]), asked.sort_by("label")
            self.ids = table["id"].to_numpy()
            self.x = np.frombuffer(b"".join(table["x"].to_pylist()), kind).reshape(-1, dim)
            self.words = np.ascontiguousarray(np.frombuffer(b"".join(table["code"].to_pylist()), np.uint64).reshape(len(self.ids), -1).T)
            self.facts = [np.bitwise_count(self.words).sum(0, dtype=np.int64), *(table[c].to_numpy() for c in coded_names[4:])]
            self.labels = table["label"].to_numpy(zero_copy_only=False)
            self.q = np.frombuffer(b"".join(self.asked["x"].to_pylist()), kind).reshape(-1, dim)

        def estimates(self, same: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
            """For each anchor its number, which rows have (not) its label, and their estimates and errors."""
            named = self.asked["label"].to_numpy(zero_copy_only=False)
            begin, end = np.searchsorted(self.labels, named, "left"), np.searchsorted(self.labels, named, "right")
            for a in np.unique(begin * (len(self.ids) + 1) + end):
                lo, hi = divmod(int(a), len(self.ids) + 1)
                some = np.flatnonzero((begin == lo) & (end == hi))
                at = np.arange(lo, hi) if same else np.append(np.arange(lo), np.arange(hi, len(self.ids)))
                words, facts = self.words[:, at], [f[at] for f in self.facts]
                step = max(1, (1 << 18) // max(1, len(at)))
                for i in range(0, len(some), step):
                    q = self.q[some[i : i + step]].astype(np.float64)
                    estimate, error = coder.value.intervals(coder.value.ask(q), (q**2).sum(1), words, *facts)
                    for j, n in enumerate(some[i : i + step]):
                        yield int(n), at, estimate[j], error[j]

        def ordered(self, n: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Ids and scores of rows, best first."""
            ids, score = self.ids[at], inner(self.x[at], self.q[n], exact)
            order = np.lexsort((ids, -score))
            return ids[order], score[order]

    def positives(key: tuple, table: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        if table.num_rows and asked.num_rows:
            block = Block(table, asked)
            own = block.asked["id"].to_numpy()
            for n, at, estimate, error in block.estimates(True):
                use = block.ids[at] != own[n]
                at, estimate, error = at[use], estimate[use], error[use]
                if len(at) > seeds:
                    best = np.argpartition(estimate, -seeds)[-seeds :]
                    bar = np.sort(inner(block.x[at[best]], block.q[n], exact))[-config.positives :][0]
                    at = at[estimate + error >= bar]
                ids, score = (c[: config.positives] for c in block.ordered(n, at))
                found.append((np.full(len(ids), own[n]), ids, score))
        return _table(found, ["anchor_id", "positive_id", "positive_score"])

    def negatives(key: tuple, table: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        if table.num_rows and asked.num_rows:
            block = Block(table, asked)
            own, wanted = block.asked["id"].to_numpy(), block.asked["positives"].to_pylist()
            for n, at, estimate, error in block.estimates(False):
                bounds = [(-(-config.low * p["positive_score"] // 100), config.high * p["positive_score"] // 100) for p in wanted[n]]
                if not any(lo <= hi for lo, hi in bounds):
                    continue
                least, largest = min(lo for lo, hi in bounds if lo <= hi), max(hi for lo, hi in bounds if lo <= hi)
                use = (block.ids[at] != own[n]) & (estimate + error >= least) & (estimate - error <= largest)
                at, estimate, error = at[use], estimate[use], error[use]
                if len(at) > seeds:
                    below = np.where(estimate <= largest, estimate, -np.inf)
                    score = -np.sort(-inner(block.x[at[np.argpartition(below, -seeds)[-seeds :]]], block.q[n], exact))
                    bars = [(lo, score[(score <= hi) & (score >= lo)]) for lo, hi in bounds if lo <= hi]
                    at = at[estimate + error >= min(s[config.negatives - 1] if len(s) >= config.negatives else lo for lo, s in bars)]
                ids, score = block.ordered(n, at)
                for p, (lo, hi) in zip(wanted[n], bounds, strict=True):
                    first = int(np.searchsorted(-score, -hi))
                    last = min(first + config.negatives, int(np.searchsorted(-score, -lo, "right")))
                    if last > first:
                        found.append((*(np.full(last - first, c) for c in (own[n], p["n"], p["positive_id"], p["positive_score"])), ids[first:last], score[first:last]))
        return _table(found, ["anchor_id", "n", "positive_id", "positive_score", "negative_id", "negative_score"])

    def _table(found: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.Table:
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * len(names)
        return pa.table([pa.array(c.astype(np.int64)) for c in columns], names)

    met = data.cogroup(deal(asks, "ask_block", n_asks, "data_block", n_data).groupBy("data_block", "ask_block"))
    first = met.applyInArrow(positives, "anchor_id long, positive_id long, positive_score long")
    place = F.row_number().over(W.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    first = first.withColumn("n", place).filter(F.col("n") <= config.positives)
    chosen = cut(first.groupBy(F.col("anchor_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("n", "positive_id", "positive_score"))).alias("positives")))  # a few for each anchor
    again = deal(asks.join(chosen, "id"), "ask_block", n_asks, "data_block", n_data).groupBy("data_block", "ask_block")
    out = data.cogroup(again).applyInArrow(negatives, "anchor_id long, n long, positive_id long, positive_score long, negative_id long, negative_score long")
    w = W.partitionBy("anchor_id", "n").orderBy(F.desc("negative_score"), "negative_id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= config.negatives).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
