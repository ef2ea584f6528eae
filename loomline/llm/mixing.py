"""Mixing sources to target weights: fixed-length blocks, multinomial counts for each output shard, pseudorandom index permutations."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomline.llm.common import cut, flat, groups_for, mix, slices, spans

#: Shards whose draws are added up together.
_LOT = 1024


@dataclass(frozen=True)
class Config:
    weights: tuple[float, ...] = (5, 2, 1)  # of the sources in order, repeating
    most_repeats: int = 3
    most_block: int = 2048  # words; sources of under least_blocks such blocks have shorter ones
    least_blocks: int = 4096
    shard_slots: int = 1024
    seed: int = 9


def targets(sizes: list[int], config: Config = Config()) -> list[float]:
    """Words to take of each source: shares of all words by weight, none above most_repeats times its size, the excess reshared by weight."""
    weight = [config.weights[i % len(config.weights)] for i in range(len(sizes))]
    out, left, open_ = [0.0] * len(sizes), float(sum(sizes)), set(range(len(sizes)))
    while open_:
        total = sum(weight[i] for i in open_)
        over = {i for i in open_ if left * weight[i] / total > config.most_repeats * sizes[i]}
        for i in over or open_:
            out[i] = float(config.most_repeats * sizes[i]) if over else left * weight[i] / total
        if not over:
            break
        left -= sum(out[i] for i in over)
        open_ -= over
    return out


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where each index in 0..size-1 goes under the pseudorandom permutation that its key names: a Feistel network over the next even power of two, walked on until the value is below size."""
    half = (np.maximum(1, np.ceil(np.log2(np.maximum(size, 2)) / 2))).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, todo = index.astype(np.uint64), np.ones(len(index), bool)
    while todo.any():
        a, b, h, m, k = x[todo] >> half[todo], x[todo] & mask[todo], half[todo], mask[todo], key[todo].astype(np.uint64)
        for r in range(4):
            a, b = b, a ^ (mix(b + k * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r + 1)) & m)
        x[todo] = a << h | b
        todo &= x >= size.astype(np.uint64)
    return x.astype(np.int64)


def _row_hash(columns: list[str]) -> Column:
    """Of all these columns; which of them are null counts too."""
    return F.xxhash64(*columns, *(F.col(c).isNull() for c in columns))


def word_counts(docs: DataFrame, id_col: str, text_col: str, source_col: str, by: list[str] | None = None) -> DataFrame:
    """id, source, k, uid, size of each row, and r, the hash of its columns `by`, if these are given."""
    r = [_row_hash(by).alias("r")] if by else []
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(id_col, text_col).alias("k"), F.monotonically_increasing_id().alias("uid"), *r, F.col(text_col).alias("text"))
    names = rows.columns[:-1]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            _, _, own = spans(*flat(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.bincount(own, minlength=batch.num_rows).astype(np.int64))], [*names, "size"])

    return rows.mapInArrow(count, f"id {dict(rows.dtypes)['id']}, source string, k long, uid long, {'r long, ' * bool(by)}size long")


def running(rows: DataFrame, size: str, part: str, order: list[str]) -> DataFrame:
    """rows with at: the sum of `size` over the rows of its source_no that go before, in order of part and then `order`. Parts are added up first, so a task holds one part, or a row for each part."""
    before = lambda w, *by: F.coalesce(F.sum(size).over(w.orderBy(*by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = rows.groupBy("source_no", part).agg(F.sum(size).alias(size)).select("source_no", part, before(W.partitionBy("source_no"), part).alias("_before"))
    within = rows.withColumn("_within", before(W.partitionBy("source_no", part), *order))
    return within.join(parts, ["source_no", part]).withColumn("at", F.col("_within") + F.col("_before")).drop("_within", "_before")


@dataclass
class Mix:
    """rows: id, uid, k (of id and text), source_no, size, at (words of its source before it), block, source_size, target. slots: shard, source_no, slot, epoch, block_no. pieces: uid, k, source_no, block_no, first (word of the row), words."""

    rows: DataFrame
    slots: DataFrame
    pieces: DataFrame


def plan(docs: DataFrame, config: Config = Config(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", by: list[str] | None = None) -> Mix:
    """The mix of all rows. by: columns whose hash, r, goes with the pieces.

    The rows of a source, in order of a hash of their ids and texts, are one run of words that is cut into blocks; a
    block's length is fixed for its source. Rows with a null or shared id so spread by their texts. Each output shard draws how many blocks it takes of each source from a multinomial with the
    target shares. A source's blocks are then taken in turn through a permutation of their numbers, a new one for each
    pass over the source; draws beyond a source's target are dropped and what is lacking fills a last shard, so that each
    source's words come within a block of its target and no block is used more than most_repeats times. Running totals
    over rows and over shards are taken in two steps, so no task holds a whole source.
    """
    spark = docs.sparkSession
    sized, r = cut(word_counts(docs, id_col, text_col, source_col, by)), ["r"] * bool(by)
    totals = [(r["source"], r["size"], r["n"]) for r in sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()]  # one row a source
    totals.sort(key=lambda r: (r[0] is None, r[0] or ""))
    want = targets([s for _, s, _ in totals], config)
    table = []
    for i, ((source, size, _), target) in enumerate(zip(totals, want, strict=True)):
        block = max(1, min(config.most_block, size // config.least_blocks))
        n_blocks = -(-size // block)
        table.append((source, i, size, target, block, n_blocks, min(config.most_repeats * n_blocks, round(target / (size / n_blocks))) if size else 0))
    sources = spark.createDataFrame(table or [(None, 0, 0, 0.0, 1, 0, 0)], "source string, source_no int, source_size long, target double, block long, n_blocks long, n_slots long")
    n_rows = sum(n for _, _, n in totals)
    bits = max(1, int(np.ceil(np.log2(max(2, n_rows)) / 2)))
    rows = sized.join(sources, sized["source"].eqNullSafe(sources["source"])).select("id", "uid", "k", *r, "size", "source_no", "source_size", "target", "block", F.expr(f"shiftrightunsigned(k, {64 - bits})").alias("part"))
    rows = running(rows, "size", "part", ["k", "id", "uid"]).select("id", "uid", "k", *r, "source_no", "size", "at", "block", "source_size", "target")
    span = F.sequence(F.expr("at div block"), F.expr("(at + size - 1) div block"))
    pieces = rows.filter("size > 0").withColumn("block_no", F.explode(span)).select("uid", "k", *r, "source_no", "block_no", F.expr("greatest(block_no * block - at, 0)").alias("first"), F.expr("least((block_no + 1) * block - at, size) - greatest(block_no * block - at, 0)").alias("words"))

    quota = np.array([t[6] for t in table], np.int64)
    blocks = np.array([t[5] for t in table], np.int64)
    shards, seed, each = groups_for(int(quota.sum()), config.shard_slots), config.seed, config.shard_slots
    share = quota / max(1, quota.sum())

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            n = np.array([np.random.default_rng((seed, int(i))).multinomial(each, share) for i in ids]).reshape(len(ids), -1)
            s, k = np.nonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(ids[s]), pa.array(k.astype(np.int32)), pa.array(n[s, k].astype(np.int64))], ["shard", "source_no", "n"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                slot, s = batch.column("slot").to_numpy(), batch.column("source_no").to_numpy().astype(np.int64)
                size = blocks[s]
                epoch = slot // size
                block = permuted(slot % size, size, (np.uint64(seed) << np.uint64(48)) + (s.astype(np.uint64) << np.uint64(8)) + epoch.astype(np.uint64))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(epoch), pa.array(block)], ["shard", "source_no", "slot", "epoch", "block_no"])

    if quota.sum():
        drawn = spark.range(shards).mapInArrow(draw, "shard long, source_no int, n long").withColumn("lot", F.expr(f"shard div {_LOT}"))
        drawn = running(drawn, "n", "lot", ["shard"]).withColumn("from_slot", F.col("at")).withColumn("to_slot", F.col("at") + F.col("n"))
        ends = drawn.groupBy("source_no").agg(F.max("to_slot").alias("drawn"))
        last = sources.join(ends, "source_no", "left").select(F.lit(shards).cast("long").alias("shard"), "source_no", F.coalesce("drawn", F.lit(0)).alias("from_slot"), F.col("n_slots").alias("to_slot"))
        taken = drawn.join(F.broadcast(sources.select("source_no", "n_slots")), "source_no").select("shard", "source_no", "from_slot", F.least("to_slot", "n_slots").alias("to_slot")).unionByName(last).filter("from_slot < to_slot")
        slots = taken.select("shard", "source_no", F.explode(F.sequence("from_slot", F.col("to_slot") - 1)).alias("slot")).mapInArrow(place, "shard long, source_no int, slot long, epoch long, block_no long")
    else:
        slots = spark.createDataFrame([], "shard long, source_no int, slot long, epoch long, block_no long")
    return Mix(rows, slots, pieces)


def mix_counts(docs: DataFrame, config: Config = Config(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of docs: id, size (words; null text: 0), source_size, target (of its source), taken (words the mix takes, repeats counted). An empty table gives none; repeated rows count each; other columns are ignored."""
    made = plan(docs, config, id_col, text_col, source_col)
    uses = made.slots.groupBy("source_no", "block_no").agg(F.count("*").alias("uses"))
    taken = made.pieces.join(uses, ["source_no", "block_no"]).groupBy("uid").agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
    return made.rows.join(taken, "uid", "left").select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, config: Config = Config(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str | None = "n_chars") -> DataFrame:
    """The mix as rows of docs: one for each document and pass over its source that takes words of it, its text cut to
    the words taken (runs of blocks that don't touch are joined by a newline; a text taken whole stays as it was), and
    length_col, where docs has it, set to the new length. Other columns stay. Rows come out up to most_repeats times."""
    whole = [c for c, t in docs.dtypes if "map<" not in t]  # maps can't be hashed; rows that differ in these alone come out with those of one of them
    made = plan(docs, config, id_col, text_col, source_col, whole)
    taken = made.pieces.join(made.slots.select("source_no", "block_no", "epoch"), ["source_no", "block_no"])
    taken = cut(taken.groupBy("uid", "r", "epoch").agg(F.sort_array(F.collect_list(F.struct("first", "words"))).alias("parts")))
    columns = docs.columns
    names = [f"c{i}" for i in range(len(columns))]
    body = names[columns.index(text_col)]
    rows = docs.select(_row_hash(whole).alias("r"), *(F.col(c).alias(n) for c, n in zip(columns, names, strict=True)))
    if made.rows.groupBy("r").count().filter("count > 1").limit(1).count():
        rows = rows.dropDuplicates(["r"])  # rows alike in all columns: each has its own entry in `taken`
    joined = rows.join(taken, "r").select(*names, F.col("parts.first").alias("first"), F.col("parts.words").alias("words"))

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, body):
            data, at = flat(batch.column(body))
            start, end, own = spans(data, at)
            begin, all_words = np.searchsorted(own, np.arange(batch.num_rows)), np.bincount(own, minlength=batch.num_rows)
            raw, texts = data.tobytes(), []
            for i, (first, words) in enumerate(zip(batch.column("first").to_pylist(), batch.column("words").to_pylist(), strict=True)):
                runs: list[list[int]] = []
                for f, n in zip(first, words, strict=True):
                    if runs and runs[-1][1] == f:
                        runs[-1][1] = f + n
                    else:
                        runs.append([f, f + n])
                if runs == [[0, all_words[i]]]:
                    texts.append(raw[at[i] : at[i + 1]])
                else:
                    texts.append(b"\n".join(raw[start[begin[i] + a] : end[begin[i] + b - 1]] for a, b in runs))
            out = {n: batch.column(n) for n in names}
            out[body] = pa.array([t.decode(errors="replace") for t in texts], pa.string())
            yield pa.RecordBatch.from_pydict(out)

    kinds = dict(rows.dtypes)
    out = joined.mapInArrow(trim, ", ".join(f"{n} {kinds[n]}" for n in names)).select(*(F.col(n).alias(c) for n, c in zip(names, columns, strict=True)))
    return out.withColumn(length_col, F.length(text_col).cast(dict(docs.dtypes)[length_col])) if length_col in columns else out
