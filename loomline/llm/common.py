"""What the operators share: lineage cuts, and numpy views of Arrow text columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: ASCII whitespace, as in [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
SPACE_RE = r"[\x20\x09-\x0D]+"
BATCH_BYTES = 1 << 20
_B = 0x9E3779B97F4A7C15 | 1
_B_INV = pow(_B, -1, 1 << 64)
_powers: list[np.ndarray] = []


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session; a temporary one is made only in local mode, where none is set."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        where = sc.getConf().get("spark.checkpoint.dir")
        if not where and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="loomline-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder, so that a lost executor loses nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def saved(df: DataFrame, by: str | None = None) -> DataFrame:
    """df as Parquet in the shared folder, filed by a column if given, and read again: for large tables that several scans follow."""
    where = f"{shared_folder(df.sparkSession)}/saved-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(where)
    return df.sparkSession.read.parquet(where)


def dropped(table: DataFrame) -> None:
    """Delete what saved() wrote; nothing may read table after this."""
    spark = table.sparkSession
    for where in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def groups_for(rows: int, per_group: int) -> int:
    """How many groups hold about per_group rows each."""
    return max(1, -(-rows // per_group))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES, most_rows: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `limit` text bytes (a longer text stands alone) and most_rows rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = min(at + most_rows, max(at + 1, int(np.searchsorted(ends, before + limit, side="right"))))
            yield batch.slice(at, to - at)
            at = to


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end and where each begins; null counts as empty."""
    column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, at - at[0]


def spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each maximal run of bytes outside `gap`; none crosses a text's end."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    word = np.zeros(len(data) + 1, bool)
    np.logical_not(gap[data], out=word[:-1])
    first = word.copy()
    first[1:] &= ~word[:-1]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    first[begins] = word[begins]
    last = word[:-1] & (~word[1:] | first[1:])
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, BATCH_BYTES + 1)
        _powers[:] = [np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]).cumprod(dtype=np.uint64) for b in (_B, _B_INV)]
    return _powers[0], _powers[1]


def byte_table(seed: int, lower: bool = False) -> np.ndarray:
    """A random 64-bit value for each byte; lower: A-Z share those of a-z."""
    table = np.random.Generator(np.random.Philox(seed)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
    if lower:
        table[65:91] = table[97:123]
    return table


TABLE, LOWER = byte_table(11), byte_table(11, lower=True)


def prefix_sums(data: np.ndarray, table: np.ndarray = TABLE) -> np.ndarray:
    """Running sums from which span_hash takes the hash of any span of data in O(1)."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.take(table, data, out=sums[1:], mode="clip")
    sums[1:] *= _power(len(data) + 1)[0][: len(data)]
    return np.cumsum(sums, out=sums)


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of spans, well mixed; equal bytes give equal hashes."""
    return mix((sums[end] - sums[start]) * _power(len(sums))[1][start])


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray = TABLE, piece: int = BATCH_BYTES) -> np.ndarray:
    """span_hash of spans in order that don't overlap, piece by piece: running sums and powers take 24 bytes a byte of a piece, not of all data."""
    out, i = np.empty(len(start), np.uint64), 0
    while i < len(start):
        a = start[i]
        j = max(i + 1, int(np.searchsorted(end, a + piece, side="right")))
        out[i:j] = span_hash(prefix_sums(data[a : end[j - 1]], table), start[i:j] - a, end[i:j] - a)
        i = j
    return out


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, owner: np.ndarray, n_texts: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of `size` words within a text, and their text's number, ordered by it. A shorter text that has words gives one shingle of all of them."""
    count = np.bincount(owner, minlength=n_texts)
    begin = np.cumsum(count) - count
    full = len(words) - size + 1
    out, own = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if full > 0:
        inside = owner[:full] == owner[size - 1 :]
        out = np.zeros(full, np.uint64)
        for j in range(size):
            out = out * np.uint64(0xD6E8FEB86659FD93) + words[j : j + full]
        out, own = mix(out[inside]), owner[:full][inside]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        parts = []
        for i in short:
            h = np.uint64(count[i])
            with np.errstate(over="ignore"):
                for w in words[begin[i] : begin[i] + count[i]]:
                    h = h * np.uint64(0xD6E8FEB86659FD93) + w
            parts.append(h)
        out, own = np.concatenate([out, mix(np.array(parts, np.uint64))]), np.concatenate([own, short])
        order = np.argsort(own, kind="stable")
        out, own = out[order], own[order]
    return out, own


def list_column(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column whose rows end at `ends` in values."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values, kind))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
