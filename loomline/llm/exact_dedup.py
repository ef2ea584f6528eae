"""Exact deduplication: a two-pass Bloom filter finds the hashes that may repeat, and only their rows shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import SPACE_RE, cut, groups_for, list_column

_HELD = 1 << 20  # places that a task collects before it sends them by range


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, per_range: int = 1 << 20, max_bits: int = 1 << 25) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII whitespace became one space; null counts as empty. The row
    with the smallest id stays (null ids last; of rows that share id and text exactly one stays). Rows that the filter
    finds unique pass straight through; only the others shuffle, and are grouped by their full SHA-256, so the filter's
    errors cost a little traffic and never a wrong group.

    Pass one sends a place of four bytes for each row (a word of the filter and two bits in it) to the range of its hash,
    about per_range rows each with a Bloom filter of its own, all ranges in one job; a place whose bits two or more rows
    set may repeat. Pass two tests all rows against one filter of these places alone, which is broadcast: bits_per_row for
    each place, at most max_bits / 64 rows. Beyond that it fills up, and more of the unique rows shuffle too (digests and
    ids, not texts). An empty table gives an empty result; other columns are ignored.
    """
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE_RE, " ")
    hashed = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("sha"), F.monotonically_increasing_id().alias("uid")).withColumn("h", F.xxhash64("sha"))
    hashed = cut(hashed)
    tested = sifted(hashed, hashed.count(), bits_per_row, per_range, max_bits)
    alone = tested.filter("not may_repeat").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    rest = tested.filter("may_repeat")
    groups = cut(rest.groupBy("sha").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "uid")).alias("first"), F.count("*").alias("group_size")))  # a plain table: Spark can then split a hot hash in the join
    met = rest.join(groups, "sha").select("id", F.col("first.id").alias("keep_id"), "group_size", (F.col("uid") == F.col("first.uid")).alias("kept"), "sha")
    out = alone.unionByName(met)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def _bits_of(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two filter positions of each place: its word's number is above its lower 12 bits, which are two places in the word."""
    word = places.astype(np.int64) >> 12 << 6
    return word | places & 63, word | places >> 6 & 63


def _set_twice(sent: np.ndarray, again: np.ndarray, words: int) -> np.ndarray:
    """Distinct places whose filter positions were both set by two or more rows; sent: a place for each chunk that has it, again: places that are repeated in one chunk."""
    once, twice = np.zeros(words * 64, bool), np.zeros(words * 64, bool)
    one, two = _bits_of(sent)
    for p in (one, two[one != two]):
        p, n = np.unique(p, return_counts=True)
        twice[p[(n > 1) | once[p]]] = True
        once[p] = True
    for p in _bits_of(again):
        twice[p] = True
    return np.unique(sent[twice[one] & twice[two]])


def may_repeat(hashed: DataFrame, ranges: int, words: int) -> DataFrame:
    """Pass one: (range, place), distinct, of the rows of `hashed` (range, place) that may have a like one."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each range of each chunk of a task's rows; a place that is frequent in a chunk is sent twice at most."""
        held: list[np.ndarray] = []

        def sent() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            own, place = keys >> 32, (keys & 0xFFFFFFFF).astype(np.int32)
            used, first = np.unique(own, return_index=True)
            upto, more = np.append(first[1:], len(keys)), n > 1
            return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), list_column(place, upto, pa.int32()), list_column(place[more], np.cumsum(more)[upto - 1], pa.int32())], ["range", "places", "again"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch.column("range").to_numpy().astype(np.int64) << 32 | batch.column("place").to_numpy())
            if sum(map(len, held)) >= _HELD:
                yield sent()
        if held:
            yield sent()

    def found(group: pa.Table) -> pa.Table:
        places, again = (group[c].combine_chunks().flatten().to_numpy() for c in ("places", "again"))
        out = _set_twice(places, again, words)
        return pa.table({"range": pa.array(np.full(len(out), group["range"][0].as_py(), np.int32)), "place": pa.array(out.astype(np.int32))})

    sent = hashed.select("range", "place").mapInArrow(chunks, "range int, places array<int>, again array<int>")
    return sent.groupBy("range").applyInArrow(found, "range int, place int")


def sifted(hashed: DataFrame, rows: int, bits_per_row: int, per_range: int, max_bits: int) -> DataFrame:
    """id, sha, uid and may_repeat of hashed (id, sha, uid, h)."""
    ranges = groups_for(rows, per_range)
    words = min(1 << 19, 1 << max(0, (groups_for(rows, ranges) * bits_per_row // 64).bit_length()))
    # ranges by another hash than places, so that these are free in each range
    placed = hashed.withColumns({"range": F.pmod(F.xxhash64("h", F.lit(2)), F.lit(ranges)).cast("int"), "place": F.col("h").bitwiseAND(words * 4096 - 1).cast("int")})
    again = cut(may_repeat(placed, ranges, words))
    n_words = max(1, min(max_bits, again.count() * bits_per_row) // 64)
    h = F.xxhash64("range", "place")
    entry = {"word": F.pmod(F.shiftright(h, 12), F.lit(n_words)).cast("int"), "mask": F.expr("shiftleft(1L, cast(key & 63 as int)) | shiftleft(1L, cast(shiftright(key, 6) & 63 as int))")}
    side = again.withColumn("key", h).withColumns(entry).groupBy("word").agg(F.bit_or("mask").alias("bits"))
    tested = placed.withColumn("key", h).withColumns(entry).join(F.broadcast(side), "word", "left")  # at most max_bits / 64 rows
    return tested.select("id", "sha", "uid", F.expr("coalesce(bits & mask, 0) = mask").alias("may_repeat"))
