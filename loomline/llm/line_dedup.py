"""Near-duplicate lines: a segment-partition edit join with length-aware substring probes and bit-parallel verification."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import SPACE, cut, flat, groups_for, list_column, mix, prefix_sums, signed, slices, span_hash, spans

_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True


@dataclass(frozen=True)
class Config:
    edits: int = 2  # of UTF-8 bytes
    least_bytes: int = 20  # shorter lines go only as exact repeats
    per_bucket: int = 1_500_000  # segment entries that meet in one task, about
    per_key: int = 20_000  # entries of one segment that meet in one task; those of a more frequent one meet block by block
    census: int = 64  # segments are counted over one distinct line in so many; that balances load and never changes a result
    most_bits: int = 1 << 27  # of a broadcast filter of line hashes


def _matrix(data: np.ndarray, start: np.ndarray, size: np.ndarray, width: int, fill: int) -> np.ndarray:
    """A row for each span, padded with fill."""
    place = np.arange(width)
    out = data[np.minimum(start[:, None] + place, len(data) - 1)].astype(np.int16)
    out[place >= size[:, None]] = fill
    return out


def within(one: list[bytes], two: list[bytes], edits: int, at_once: int = 1 << 18) -> np.ndarray:
    """Whether the edit distance of each pair is at most `edits`.

    Common ends go first. Of the rest a band of 2 * edits + 1 diagonals is followed byte by byte, a word of bits for each
    number of errors, for many pairs at once; pairs of like length go together.
    """
    out = np.zeros(len(one), bool)
    m, n = (np.array([len(x) for x in side], np.int64) for side in (one, two))
    a, b = (np.frombuffer(b"".join(side) or b"\0", np.uint8) for side in (one, two))
    at, bt = np.cumsum(m) - m, np.cumsum(n) - n
    todo = np.flatnonzero(np.abs(m - n) <= edits)
    todo = todo[np.argsort(np.maximum(m, n)[todo], kind="stable")]
    i = 0
    while i < len(todo):
        size = np.maximum(m, n)[todo[i:]] + 1
        j = i + max(1, int(np.searchsorted(np.arange(1, len(size) + 1) * size, at_once, side="right")))
        some = todo[i:j]
        out[some] = _band(a, at[some], m[some], b, bt[some], n[some], edits)
        i = j
    return out


def _band(a: np.ndarray, at: np.ndarray, m: np.ndarray, b: np.ndarray, bt: np.ndarray, n: np.ndarray, edits: int) -> np.ndarray:
    least, width = np.minimum(m, n), int(np.minimum(m, n).max(initial=0))
    place = np.arange(width)
    short = place >= least[:, None]
    ends = []
    for x, y in ((at[:, None] + place, bt[:, None] + place), ((at + m)[:, None] - 1 - place, (bt + n)[:, None] - 1 - place)):
        differ = (a[np.clip(x, 0, len(a) - 1)] != b[np.clip(y, 0, len(b) - 1)]) | short
        ends.append(np.where(differ.any(1), differ.argmax(1), least) if width else least)
    head = ends[0]
    tail = np.minimum(ends[1], least - head)
    at, bt, m, n = at + head, bt + head, m - head - tail, n - head - tail
    x, y = (_matrix(d, p, k, int(k.max(initial=0)), f) for d, p, k, f in ((a, at, m, -1), (b, bt, n, -2)))
    full = (1 << 2 * edits + 1) - 1
    # bit d + edits of state e: some alignment of e errors has used j bytes of the second and j + d of the first
    state = [np.full(len(m), 1 << edits, np.int64)]
    for _ in range(edits):
        state.append(state[-1] << 1 & full | state[-1])
    x = np.pad(x, ((0, 0), (edits, edits + max(0, y.shape[1] - x.shape[1]))), constant_values=-1)
    final = [s.copy() for s in state]
    for j in range(y.shape[1]):
        same = sum((x[:, j + d] == y[:, j]).astype(np.int64) << d for d in range(2 * edits + 1))
        ok = sum(((j + 1 + d - edits >= 0) & (j + 1 + d - edits <= m)).astype(np.int64) << d for d in range(2 * edits + 1))
        after: list[np.ndarray] = []
        for e, now in enumerate(state):
            go = now & same
            if e:
                go = go | state[e - 1] | state[e - 1] >> 1 | after[e - 1] << 1
            after.append(go & ok)
        state = after
        here = n == j + 1
        for f, now in zip(final, state, strict=True):
            f[here] = now[here]
    return np.logical_or.reduce([f >> np.clip(m - n + edits, 0, 2 * edits) & 1 for f in final]).astype(bool) & (np.abs(m - n) <= edits)


def _lines(column: pa.Array, least: int, short: bool = False) -> tuple[np.ndarray, ...]:
    """Of the lines of at least `least` bytes (short: also of all others that are not blank): start, end, text number, line number and hash; and the bytes and their running sums."""
    data, at = flat(column)
    start, end, own = spans(data, at, _NEWLINE)
    keep = end - start >= least
    if short:
        dark = np.concatenate([[0], np.cumsum(~SPACE[data])])
        keep |= dark[end] > dark[start]
    start, end, own = start[keep], end[keep], own[keep]
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    sums = prefix_sums(data)
    return start, end, own, (breaks[start] - breaks[at[:-1]][own]).astype(np.int32), span_hash(sums, start, end), data, sums


#: Letters, without case, have a class each; other bytes share six.
_CLASS = np.array([(b | 32) - 97 if 97 <= (b | 32) <= 122 and b < 128 else 26 + b % 6 for b in range(256)])
_GRAY = np.array([0, 1, 3, 2], np.uint64)


def sketches(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits a line: the count of each of 32 classes of bytes, modulo 4, in Gray code. So an edit turns at most two bits."""
    size = end - start
    upto = np.cumsum(size)
    n = len(start)
    if not n:
        return np.zeros(0, np.uint64)
    at = np.repeat(start - (upto - size), size) + np.arange(upto[-1])
    counts = np.bincount(np.repeat(np.arange(n) * 32, size) + _CLASS[data[at]], minlength=32 * n).reshape(n, 32)
    return (_GRAY[counts & 3] << (2 * np.arange(32, dtype=np.uint64))).sum(1, dtype=np.uint64)


def segment_keys(start: np.ndarray, end: np.ndarray, sums: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, line, probe): keys of each line's edits + 1 segments, and of the substrings that a line not longer by more than `edits` could share with it as a segment."""
    length, lines, parts = end - start, np.arange(len(start)), edits + 1
    keys, owner, probe = [], [], []
    for shorter in range(edits + 1):
        size = length - shorter  # of the line that is indexed
        base, more = size // parts, size % parts
        for i in range(parts):
            width = base + (i >= parts - more)
            begin = i * base + np.maximum(0, i - (parts - more))
            for move in [None] * (not shorter) + list(range(max(-i, shorter - (edits - i)), min(i, shorter + edits - i) + 1)):
                at = start + begin + (move or 0)
                ok = (at >= start) & (at + width <= end) & (width > 0)
                h = span_hash(sums, at[ok], (at + width)[ok])
                keys.append(mix(h ^ mix((size[ok] * parts + i).astype(np.uint64))))
                owner.append(lines[ok])
                probe.append(np.full(int(ok.sum()), move is not None))
    return tuple(np.concatenate(x) for x in (keys, owner, probe))


def paired(keys: np.ndarray, lines: np.ndarray, probe: np.ndarray, sketch: np.ndarray, edits: int, chunk: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct pairs of lines of which one probes a key that the other is indexed under, and whose sketches allow so few edits; in chunks of bounded size."""
    order = np.lexsort((lines, probe, keys))
    keys, lines, probe, sketch = keys[order], lines[order], probe[order], sketch[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (lines[1:] != lines[:-1]) | (probe[1:] != probe[:-1])
    keys, lines, probe, sketch = keys[new], lines[new], probe[new], sketch[new]
    ik, il, pk, pl, isk, psk = keys[~probe], lines[~probe], keys[probe], lines[probe], sketch[~probe], sketch[probe]
    lo, hi = np.searchsorted(ik, pk, "left"), np.searchsorted(ik, pk, "right")
    n = hi - lo
    some = np.flatnonzero(n)
    ends = np.cumsum(n[some])
    a = 0
    while a < len(some):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + chunk, "right")))
        rows, count = some[a:b], n[some[a:b]]
        index = np.repeat(lo[rows] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        p, q = np.repeat(pl[rows], count), il[index]
        near = (p != q) & (np.bitwise_count(np.repeat(psk[rows], count) ^ isk[index]) <= 2 * edits)
        p, q = p[near], q[near]
        low, high = np.minimum(p, q), np.maximum(p, q)
        order = np.lexsort((high, low))
        low, high = low[order], high[order]
        new = np.ones(len(low), bool)
        new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        yield low[new], high[new]
        a = b


def _filter_of(hashes: DataFrame, column: str, most_bits: int):
    """A broadcast bitmap of low hash bits: a superset of membership, of at most most_bits / 8 bytes."""
    spark = hashes.sparkSession
    n_bits = min(most_bits, 1 << max(16, (hashes.count() * 16).bit_length()))
    words = hashes.select(F.expr(f"{column} & {n_bits - 1}").alias("p")).groupBy(F.expr("shiftright(p, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("bits")).toArrow()
    bitmap = np.zeros(n_bits // 64, np.int64)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy()
    return spark.sparkContext.broadcast(np.unpackbits(bitmap.view(np.uint8), bitorder="little").view(bool) if n_bits <= 1 << 22 else bitmap), n_bits


def _hits(bitmap: np.ndarray, n_bits: int, h: np.ndarray) -> np.ndarray:
    p = h & np.uint64(n_bits - 1)
    return bitmap[p] if bitmap.dtype == bool else (bitmap.view(np.uint64)[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)


def _first() -> Column:
    return F.min(F.struct("none", "id", "k", "line"))


def dropped_lines(docs: DataFrame, config: Config, id_col: str, text_col: str) -> DataFrame:
    """k (of a row's id and text) and the numbers of the lines that go."""
    least, edits = config.least_bytes, config.edits
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("k"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]

    def occurrences(bitmap=None, n_bits: int = 0, texts: bool = False, short: bool = False):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                start, end, own, line, h, data, _ = _lines(batch.column("text"), least, short)
                keep = _hits(bitmap.value, n_bits, h) if bitmap else np.ones(len(h), bool)
                index = pa.array(own[keep])
                columns = [pa.array(signed(h)[keep]), batch.column("id").take(index), batch.column("k").take(index), pa.array(line[keep])]
                if texts:
                    body = data.tobytes()
                    columns.append(pa.array([body[a:b] for a, b in zip(start[keep].tolist(), end[keep].tolist(), strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["h", "id", "k", "line", *["body"] * texts])

        return rows.mapInArrow(run, f"h long, id {kind}, k long, line int" + ", body binary" * texts).withColumn("none", F.col("id").isNull())

    def entries(batch: pa.RecordBatch, choose) -> tuple[np.ndarray, ...]:
        """Key, line, sketch and whether it is a probe, of each entry of a batch's distinct lines, of those whose hash is chosen."""
        start, end, _, _, h, data, sums = _lines(batch.column("text"), least)
        some = np.flatnonzero(choose(h))
        h, once = np.unique(h[some], return_index=True)
        start, end = start[some[once]], end[some[once]]
        key, owner, probe = segment_keys(start, end, sums, edits)
        return key, h[owner], sketches(data, start, end)[owner], probe

    def census(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            key, line, _, _ = entries(batch, lambda h: mix(h) % np.uint64(config.census) == 0)
            yield pa.RecordBatch.from_pydict({"key": pa.array(signed(key)), "line": pa.array(signed(line))})

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent = np.zeros(0, np.uint64)  # lines that this task has sent, so that a line in many texts is sent about once

        def fresh(h: np.ndarray) -> np.ndarray:
            nonlocal recent
            new = recent[np.minimum(np.searchsorted(recent, h), len(recent) - 1)] != h if len(recent) else np.ones(len(h), bool)
            recent = np.union1d(recent, h) if len(recent) < 1 << 20 else h
            return new

        for batch in slices(batches, "text"):
            key, line, sketch, probe = entries(batch, fresh)
            if not len(key):
                continue
            if len(hot):
                to = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
                n = np.where(hot[to] == key, blocks[to], 1)
                which = np.repeat(np.arange(len(key)), n)
                other = (np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint64)
                key, line, sketch, probe, n = key[which], line[which], sketch[which], probe[which], n[which]
                own = mix(line) % n.astype(np.uint64)  # an indexed line meets all blocks of probes, and a probe all blocks of lines
                tile = np.where(probe, other << np.uint64(32) | own, own << np.uint64(32) | other)
                key = np.where(n > 1, mix(key + mix(tile)), key)
            bucket = (key >> np.uint64(33)).astype(np.int64) % buckets
            order = np.argsort(bucket, kind="stable")
            used, first = np.unique(bucket[order], return_index=True)
            ends = np.append(first[1:], len(order))
            short = (key & np.uint64(0x7FFFFFFF)).astype(np.int64) << 1 | probe  # tells keys of a bucket apart; verification takes care of the rest
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), list_column((short - (1 << 31)).astype(np.int32)[order], ends, pa.int32()), list_column(signed(line)[order], ends, pa.int64()), list_column(signed(sketch)[order], ends, pa.int64())], ["bucket", "keys", "lines", "sketches"])

    def candidates(group: pa.Table) -> pa.Table:
        key = group["keys"].combine_chunks().flatten().to_numpy().astype(np.int64) + (1 << 31)
        found = list(paired(key >> 1, group["lines"].combine_chunks().flatten().to_numpy(), (key & 1).astype(bool), group["sketches"].combine_chunks().flatten().to_numpy().view(np.uint64), edits))
        a, b = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    seen = occurrences(short=True).groupBy("h").agg(_first().alias("first"), F.count("*").alias("n"))
    repeated = cut(seen.filter("n > 1").select("h", "first"))
    sampled = cut(rows.mapInArrow(census, "key long, line long").distinct())
    n_entries = sampled.count() * config.census
    buckets = groups_for(n_entries, config.per_bucket)
    often = sampled.groupBy("key").agg((F.count("*") * config.census).alias("n")).filter(F.col("n") > config.per_key).toArrow()  # at most one for per_key entries
    hot = often["key"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(hot)
    hot, blocks = hot[order], np.ceil(often["n"].to_numpy() / config.per_key).astype(np.int64)[order]
    pairs = cut(rows.mapInArrow(keys, "bucket int, keys array<int>, lines array<long>, sketches array<long>").groupBy("bucket").applyInArrow(candidates, "a long, b long").distinct())
    asked = cut(pairs.select(F.col("a").alias("h")).unionByName(pairs.select(F.col("b").alias("h"))).distinct())
    bodies = occurrences(*_filter_of(asked, "h", config.most_bits), texts=True)
    bodies = bodies.groupBy("h").agg(_first().alias("first"), F.min("body").alias("body"))
    bodies = cut(bodies.join(asked, "h", "left_semi"))
    one, two = (bodies.select(F.col("h").alias(c), F.col("first").alias(f"first_{c}"), F.col("body").alias(f"body_{c}")) for c in "ab")
    met = pairs.join(one, "a").join(two, "b").select(F.when(F.col("first_a") > F.col("first_b"), F.col("a")).otherwise(F.col("b")).alias("h"), "body_a", "body_b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = within(batch.column("body_a").to_pylist(), batch.column("body_b").to_pylist(), edits)
            yield pa.RecordBatch.from_arrays([batch.column("h").filter(pa.array(good))], ["h"])

    near = cut(met.mapInArrow(verify, "h long").distinct())
    fate = cut(repeated.join(near.withColumn("near", F.lit(True)), "h", "full"))  # one plain table, so that Spark can split a hot line in the join
    again = occurrences(*_filter_of(fate, "h", config.most_bits), short=True).join(fate, "h")
    gone = again.filter(F.col("near").isNotNull() | (F.struct("none", "id", "k", "line") > F.col("first")))
    return gone.groupBy("k").agg(F.sort_array(F.collect_set("line")).alias("gone"))


def line_dedup(docs: DataFrame, config: Config = Config(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with near-repeated lines taken out of the text column, and lines (all) and lines_dropped.

    A line (between newlines) goes if the same line, or one within config.edits byte edits where both have at least
    config.least_bytes bytes, is found earlier, by id (null last), then row, then line number; judged on the input, not on
    what is left. Of shorter lines blank ones (of ASCII white space) stay. A null text stays null and has no lines. Rows that share id and text are
    one document for the order, and all come out alike. Lines are told apart by 64-bit hashes; candidates are verified
    on their bytes. An empty table gives an empty result; other columns pass through, but for columns named as the two
    that are added, which they replace.
    """
    gone = dropped_lines(docs, config, id_col, text_col)
    marked = docs.withColumn("_loom_k", F.xxhash64(id_col, text_col)).join(gone.withColumnsRenamed({"k": "_loom_k", "gone": "_loom_gone"}), "_loom_k", "left")
    parts = F.split(F.col(text_col), "\n", -1)
    kept = F.when(F.col("_loom_gone").isNull(), F.col(text_col)).otherwise(F.array_join(F.filter(parts, lambda _, i: ~F.array_contains("_loom_gone", i)), "\n"))
    marked = marked.withColumns({"lines": F.when(F.col(text_col).isNull(), 0).otherwise(F.size(parts)), "lines_dropped": F.coalesce(F.size("_loom_gone"), F.lit(0)), text_col: kept})
    return marked.select(*(c for c in docs.columns if c not in ("lines", "lines_dropped")), "lines", "lines_dropped")


def clean(docs: DataFrame, config: Config = Config(), id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs after line_dedup, with length_col (where docs has it) set to the new length. A document that had lines and lost all but blank ones goes; no other does."""
    out = line_dedup(docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns))), config, f"c{docs.columns.index(id_col)}", body := f"c{docs.columns.index(text_col)}")
    out = out.filter(~((F.col("lines_dropped") > 0) & F.regexp_like(body, F.lit(r"\A[\x09-\x0D\x20]*\z"))))
    if length_col in docs.columns:
        name = f"c{docs.columns.index(length_col)}"
        out = out.withColumn(name, F.when(F.col("lines_dropped") > 0, F.length(body).cast(dict(docs.dtypes)[length_col])).otherwise(F.col(name)))
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
