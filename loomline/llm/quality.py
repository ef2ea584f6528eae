"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import LOWER, TABLE, flat, list_column, prefix_sums, shingles, slices, span_hash, spans

#: Names of the structure statistics, in the order of their feature numbers.
STRUCTURE = ("log_bytes", "log_words", "word_length", "upper", "digits", "symbols", "marks", "wide", "spaces", "distinct_words", "distinct_triples", "lines", "line_length", "distinct_lines", "run_on", "metadata")
_kind = np.zeros(256, np.int64)
_kind[65:91], _kind[48:58] = 1, 2
_kind[[ord(c) for c in "#$%&*+<=>@\\^_`{|}~/[]"]] = 3
_kind[[ord(c) for c in "!?.,;:'\"()-"]] = 4
_kind[128:], _kind[[9, 10, 11, 12, 13, 32]] = 5, 6
_LINES = np.zeros(256, bool)
_LINES[[10, 13]] = True


@dataclass(frozen=True)
class Config:
    word_bits: int = 16
    rank: int = 8
    sample_rows: int = 4000  # labelled rows to fit on: those whose ids hash lowest
    epochs: int = 12
    batch: int = 128
    rate: float = 0.08
    decay: float = 2e-5
    threshold: float = 0.7
    seed: int = 7


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def _distinct(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[new], minlength=n)


def structure(data: np.ndarray, at: np.ndarray, words: tuple, hashes: np.ndarray, meta: np.ndarray) -> np.ndarray:
    """(texts, len(STRUCTURE)) raw statistics; all are finite for an empty text."""
    n, size = len(at) - 1, np.diff(at)
    owner = np.repeat(np.arange(n), size)
    kinds = np.bincount(owner * 7 + _kind[data], minlength=7 * n).reshape(n, 7).astype(float)
    start, end, own = words
    count, length = np.bincount(own, minlength=n), np.bincount(own, weights=end - start, minlength=n)
    triples, own3 = shingles(hashes, own, n, 3)
    ls, le, lo = spans(data, at, _LINES)
    n_lines = np.bincount(lo, minlength=n)
    longest = np.zeros(n)
    np.maximum.at(longest, own, end - start)
    meta = np.where(np.isfinite(meta), meta, size - np.bincount(owner[(data & 0xC0) == 0x80], minlength=n))
    return np.column_stack([
        np.log1p(size), np.log1p(count), _ratio(length, count), *(_ratio(kinds[:, k], size) for k in range(1, 7)),
        _ratio(_distinct(hashes, own, n), count), _ratio(_distinct(triples, own3, n), np.bincount(own3, minlength=n)),
        np.log1p(n_lines), np.log1p(_ratio(np.bincount(lo, weights=le - ls, minlength=n), n_lines)), _ratio(_distinct(span_hash(prefix_sums(data, TABLE), ls, le), lo, n), n_lines),
        np.log1p(longest), np.log1p(np.maximum(meta, 0)),
    ])


def features(batch: pa.RecordBatch, bits: int, text: str = "text") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Structure statistics; then text number, word bucket and weight (L2-normed counts) of each word feature, ordered by text."""
    data, at = flat(batch.column(text))
    n = len(at) - 1
    words = spans(data, at)
    hashes = span_hash(prefix_sums(data, LOWER), words[0], words[1])
    meta = batch.column("meta").cast(pa.float64()).to_numpy(zero_copy_only=False)
    keys, counts = np.unique(words[2] << bits | (hashes >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
    owner, bucket, weight = keys >> bits, keys & ((1 << bits) - 1), counts.astype(np.float64)
    norm = np.sqrt(np.bincount(owner, weights=weight**2, minlength=n))
    return structure(data, at, words, hashes, meta), owner, bucket, (weight / np.maximum(norm, 1e-9)[owner]).astype(np.float32)


class Machine:
    """score = b + w.x + half the sum over factors of (v.x)^2 - (v^2).(x^2), linear in the number of features."""

    def __init__(self, config: Config, mean: np.ndarray, scale: np.ndarray, bias: float):
        rng = np.random.default_rng(config.seed)
        size = len(STRUCTURE) + (1 << config.word_bits)
        self.mean, self.scale, self.bias = mean, scale, bias
        self.w, self.v = np.zeros(size, np.float32), rng.normal(0, 0.02, (size, config.rank)).astype(np.float32)

    def inputs(self, stats: np.ndarray, owner: np.ndarray, bucket: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text number, feature number and value, ordered by text; the structure statistics come first in each."""
        n, k = stats.shape
        dense = np.clip((stats - self.mean) / self.scale, -4, 4).astype(np.float32) / 2
        own = np.concatenate([np.repeat(np.arange(n), k), owner])
        order = np.argsort(own, kind="stable")
        return own[order], np.concatenate([np.tile(np.arange(k), n), bucket + k])[order], np.concatenate([dense.ravel(), weight])[order]

    def margins(self, own: np.ndarray, index: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        first = np.searchsorted(own, np.arange(n))
        vx = self.v[index] * x[:, None]
        sums = np.add.reduceat(vx, first, axis=0)
        pairs = 0.5 * ((sums**2).sum(1) - np.add.reduceat((vx**2).sum(1), first))
        return self.bias + np.add.reduceat(self.w[index] * x, first) + pairs, sums

    def fit(self, own: np.ndarray, index: np.ndarray, x: np.ndarray, y: np.ndarray, config: Config) -> None:
        """Logistic loss by AdaGrad over shuffled mini-batches."""
        rng, n = np.random.default_rng(config.seed), len(y)
        first = np.searchsorted(own, np.arange(n + 1))
        gw, gv, gb = np.full(self.w.shape, 1e-2, np.float32), np.full(self.v.shape, 1e-2, np.float32), 1e-2
        for _ in range(config.epochs):
            order = rng.permutation(n)
            for i in range(0, n, config.batch):
                rows = order[i : i + config.batch]
                at = np.concatenate([np.arange(first[r], first[r + 1]) for r in rows])
                o = np.repeat(np.arange(len(rows)), first[rows + 1] - first[rows])
                j, xs = index[at], x[at]
                margin, sums = self.margins(o, j, xs, len(rows))
                g = ((1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[rows]) / len(rows)).astype(np.float32)
                by = np.argsort(j, kind="stable")
                used, begin = np.unique(j[by], return_index=True)
                go = g[o] * xs
                dw = np.add.reduceat(go[by], begin) + config.decay * self.w[used]
                dv = np.add.reduceat((go[:, None] * (sums[o] - self.v[j] * xs[:, None]))[by], begin, axis=0) + config.decay * self.v[used]
                gw[used] += dw**2
                gv[used] += dv**2
                gb += float(g.sum()) ** 2
                self.w[used] -= config.rate * dw / np.sqrt(gw[used])
                self.v[used] -= config.rate * dv / np.sqrt(gv[used])
                self.bias -= config.rate * float(g.sum()) / np.sqrt(gb)


def _prepared(docs: DataFrame, id_col: str, text_col: str, meta_col: str | None) -> DataFrame:
    meta = F.col(meta_col).cast("double") if meta_col else F.lit(None).cast("double")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), meta.alias("meta"))


def fit(docs: DataFrame, labels: DataFrame, config: Config = Config(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", meta_col: str | None = "n_chars") -> Machine:
    """Fit on at most config.sample_rows labelled documents (the mean of an id's labels counts; null labels don't). With no labelled rows every score is one half."""
    chosen = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("key")).agg(F.avg(label_col).alias("y"))
    chosen = chosen.orderBy(F.xxhash64("key"), "key").limit(config.sample_rows)
    rows = _prepared(docs, id_col, text_col, meta_col).join(F.broadcast(chosen), F.col("id") == F.col("key"))
    bits = config.word_bits

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            stats, owner, bucket, weight = features(batch, bits)
            ends = np.searchsorted(owner, np.arange(batch.num_rows), side="right")
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), list_column(stats.ravel(), (np.arange(batch.num_rows) + 1) * stats.shape[1], pa.float64()), list_column(bucket, ends, pa.int32()), list_column(weight, ends, pa.float32())], ["id", "y", "stats", "bucket", "weight"])

    kind = dict(rows.dtypes)["id"]
    got = rows.select("id", "text", "meta", "y").mapInArrow(extract, f"id {kind}, y double, stats array<double>, bucket array<int>, weight array<float>").toArrow().combine_chunks()
    got = got.take(pc.sort_indices(got, [("id", "ascending"), ("y", "ascending")])) if got.num_rows else got
    n = got.num_rows
    if not n:
        machine = Machine(config, np.zeros(len(STRUCTURE)), np.ones(len(STRUCTURE)), 0.0)
        machine.v[:] = 0
        return machine
    got = got.combine_chunks()
    stats = got["stats"].combine_chunks().flatten().to_numpy().reshape(n, -1)
    y = got["y"].to_numpy()
    prior = np.clip(y.mean(), 0.02, 0.98)
    machine = Machine(config, stats.mean(0), np.maximum(stats.std(0), 1e-3), float(np.log(prior / (1 - prior))))
    owner = np.repeat(np.arange(n), pc.list_value_length(got["bucket"]).to_numpy())
    machine.fit(*machine.inputs(stats, owner, got["bucket"].combine_chunks().flatten().to_numpy(), got["weight"].combine_chunks().flatten().to_numpy()), y, config)
    return machine


def _scored(docs: DataFrame, machine: Machine, config: Config, id_col: str, text_col: str, meta_col: str | None, keep: list[str]) -> DataFrame:
    """id, score, predicted and keep_0, keep_1, ..."""
    model = docs.sparkSession.sparkContext.broadcast(machine)  # (1 << word_bits) * (rank + 1) floats
    bits, threshold = config.word_bits, config.threshold
    names = [f"keep_{i}" for i in range(len(keep))]
    meta = F.col(meta_col).cast("double") if meta_col else F.lit(None).cast("double")
    text = names[keep.index(text_col)] if text_col in keep else "text"  # a text goes to Python once
    rows = docs.select(F.col(id_col).alias("id"), meta.alias("meta"), *(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)), *[F.col(text_col).alias("text")] * (text == "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            margin, _ = model.value.margins(*model.value.inputs(*features(batch, bits, text)), batch.num_rows)
            p = 1 / (1 + np.exp(-np.clip(margin, -30, 30).astype(np.float64)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(p), pa.array((p >= threshold).astype(np.int32)), *(batch.column(n) for n in names)], ["id", "score", "predicted", *names])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([f"id {kinds['id']}", "score double", "predicted int", *(f"{n} {kinds[n]}" for n in names)]))


def score(docs: DataFrame, machine: Machine, config: Config = Config(), id_col: str = "doc_id", text_col: str = "text", meta_col: str | None = "n_chars") -> DataFrame:
    """Each row's id, score in 0..1 and predicted (score >= config.threshold). Null text counts as empty; an empty text is scored by its statistics. One row for each input row, repeated ones too; other columns are ignored."""
    return _scored(docs, machine, config, id_col, text_col, meta_col, []).select(F.col("id").alias(id_col), "score", "predicted")


def keep_good(docs: DataFrame, machine: Machine, config: Config = Config(), id_col: str = "doc_id", text_col: str = "text", meta_col: str | None = "n_chars") -> DataFrame:
    """The rows of docs with a score of at least config.threshold, all columns as they were."""
    columns = docs.columns
    good = _scored(docs, machine, config, id_col, text_col, meta_col, columns).filter("predicted = 1")
    return good.select(*(F.col(f"keep_{i}").alias(c) for i, c in enumerate(columns)))
