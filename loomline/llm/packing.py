"""Packing token sequences: first-fit decreasing on a tournament tree of bin capacities, in randomised groups of documents."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import flat, groups_for, mix, prefix_sums, slices, span_hash

#: First bytes of characters that a Unicode white space may begin with.
_MAYBE_SPACE = np.zeros(256, bool)
_MAYBE_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0xC2, 0xE1, 0xE2, 0xE3]] = True
#: Distinct pieces of text that a Python worker keeps with their ids; about 30 bytes each.
_CACHED = 1_500_000


class Encoder:
    """Ids of pieces of text, encoded once each.

    ranks_path, if given, holds the same byte-level BPE as ranks; it encodes plain pieces faster. Pieces that hold `<` or
    characters of three bytes and more, where libraries could differ, and those at a text's beginning go to `tokenizers`.
    specials: whether the strings of special tokens in a text are these tokens, or plain text.
    """

    def __init__(self, path: str, ranks_path: str | None, specials: bool = True):
        from tokenizers import Tokenizer

        self.full, self.quick = Tokenizer.from_file(path), None
        self.full.encode_special_tokens = not specials
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.width = np.zeros(max(ranks.values()) + 1, np.int64)
            for token, rank in ranks.items():
                self.width[rank] = len(token)
        self.clear()

    def clear(self) -> None:
        self.keys, self.begin, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def learn(self, data: np.ndarray, keys: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Encode the pieces of these (sorted) keys and keep their ids."""
        size = end - start
        ends = np.cumsum(size)
        body = data[np.repeat(start - (ends - size), size) + np.arange(ends[-1])]
        odd = (np.add.reduceat((body >= 0xE0) | (body == 60), ends - size) > 0) | (body[ends - size] != 32)
        if self.quick is None:
            odd[:] = True
        count, parts = np.zeros(len(keys), np.int64), []
        if not odd.all():
            ids = np.array(self.quick.encode_ordinary(body[np.repeat(~odd, size)].tobytes().decode(errors="replace")), np.uint32)
            at, piece_ends = np.cumsum(self.width[ids]), np.cumsum(size[~odd])
            upto = np.searchsorted(at, piece_ends)
            if at[-1] == piece_ends[-1] and (at[upto] == piece_ends).all():
                count[~odd] = np.diff(upto + 1, prepend=0)
                parts.append(ids)
            else:
                odd[:] = True
        if odd.any():
            text = body.tobytes()
            got = self.full.encode_batch([text[e - n : e].decode(errors="replace") for e, n in zip(ends[odd].tolist(), size[odd].tolist(), strict=True)], add_special_tokens=False)
            lists = [x.ids for x in got]
            count[odd] = [len(x) for x in lists]
            parts.append(np.array([i for x in lists for i in x], np.uint32))
        self.keep(keys, count, np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)]), parts)

    def keep(self, keys: np.ndarray, count: np.ndarray, order: np.ndarray, parts: list[np.ndarray]) -> None:
        """Store the ids of these keys, so many each, that come in the given order."""
        begin = np.empty(len(keys), np.int64)
        begin[order] = len(self.ids) + np.cumsum(count[order]) - count[order]
        self.ids = np.concatenate([self.ids, *parts])
        to = np.searchsorted(self.keys, keys)
        self.keys, self.begin, self.size = np.insert(self.keys, to, keys), np.insert(self.begin, to, begin), np.insert(self.size, to, count)

    def find(self, data: np.ndarray, keys: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Where each of these (sorted, distinct) keys is kept."""
        if len(self.keys) > _CACHED:
            self.clear()
        to = np.searchsorted(self.keys, keys)
        new = (self.keys[np.minimum(to, len(self.keys) - 1)] != keys) if len(self.keys) else np.ones(len(keys), bool)
        if new.any():
            self.learn(data, keys[new], start[new], end[new])
            to = np.searchsorted(self.keys, keys)
        return to


_encoders: dict[tuple, Encoder] = {}


def token_ids(data: np.ndarray, at: np.ndarray, path: str, ranks_path: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, and where each text's begin.

    A byte-level BPE never joins a token across a space that a non-space follows. So texts are cut there, and each
    distinct piece is encoded once; the result is that of encoding the whole texts.
    """
    if (path, ranks_path) not in _encoders:  # one for each Python worker
        _encoders[path, ranks_path] = Encoder(path, ranks_path)
    return encoded(_encoders[path, ranks_path], data, at, byte_pieces(data, at))


def byte_pieces(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where a byte-level BPE may be cut: at a text's first byte, and at a space that a non-space follows."""
    opens = np.zeros(len(data), bool)
    if len(data):
        np.logical_and(data[:-1] == 32, ~_MAYBE_SPACE[data[1:]], out=opens[:-1])
        opens[at[1:-1][at[1:-1] > 0] - 1] = False  # a space at a text's end opens nothing
        opens[at[:-1][np.diff(at) > 0]] = True
    return opens


def encoded(encoder: Encoder, data: np.ndarray, at: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, and where each text's begin, from pieces that begin where `opens` says."""
    if not len(data):
        return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
    start = np.flatnonzero(opens)
    end = np.append(start[1:], len(data))
    keys, where, which = np.unique(span_hash(prefix_sums(data), start, end), return_index=True, return_inverse=True)
    order = np.argsort(keys)
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.arange(len(keys))
    keys, where, which = keys[order], where[order], rank[which]
    kept = encoder.find(data, keys, start[where], end[where])
    size, begin = encoder.size[kept][which], encoder.begin[kept][which]
    ends = np.cumsum(size)
    out = encoder.ids[np.repeat(begin - (ends - size), size) + np.arange(ends[-1])]
    return out, np.concatenate([[0], ends])[np.searchsorted(start, at)]


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; items go, largest first, to the first bin with room. A node of the tree holds its bins' largest room, so each item takes O(log bins)."""
    n = len(sizes)
    leaves = 1 << max(0, n - 1).bit_length()
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, node = int(sizes[i]), 1
        while node < leaves:
            node *= 2
            node += tree[node] < size
        bins[i], offsets[i] = node - leaves, capacity - tree[node]
        tree[node] -= size
        while node > 1:
            node //= 2
            tree[node] = max(tree[2 * node], tree[2 * node + 1])
    return bins, offsets


def pack(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, capacity: int = 2048, end_id: int = 1, per_group: int = 2048, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", seed: int = 5) -> DataFrame:
    """Pieces of documents in sequences of at most `capacity` tokens: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for).

    A document's tokens, with end_id after them, are cut into full pieces and one rest; a null text counts as empty and
    has end_id alone. Rests are dealt to random groups of about per_group rows, and each group is packed by itself, so no
    task holds more than its group. Full pieces fill a sequence each and are dealt one by one, so that a very long document
    burdens no group. Ties go by id and start. Each row is packed, repeated ones too; an empty table
    gives an empty result; other columns are ignored.
    """
    groups = groups_for(docs.count(), per_group)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.lit(seed), F.col(id_col), F.monotonically_increasing_id()).alias("h"))
    kind = dict(rows.dtypes)["id"]
    schema = f"bin_group int, id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids, begin = token_ids(*flat(batch.column("text")), tokenizer_path, ranks_path)
            n = np.diff(begin) + 1
            own, crcs, starts, lengths, bodies = [], [], [], [], []
            for i, (b, total) in enumerate(zip(begin[:-1].tolist(), n.tolist(), strict=True)):
                body = np.append(ids[b : b + total - 1], np.uint32(end_id)).astype("<u4")
                for s in range(0, total, capacity):
                    part = body[s : s + capacity]
                    own.append(i), starts.append(s), lengths.append(len(part)), crcs.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        bodies.append(part.astype(np.int32))
            index = pa.array(own, pa.int64())
            alone = np.where(np.array(lengths) == capacity, np.array(starts) + 1, 0).astype(np.uint64)
            group = mix(batch.column("h").to_numpy()[own].view(np.uint64) + alone * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(groups)
            columns = [pa.array(group.astype(np.int32)), batch.column("id").take(index), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64()), pa.array(n[own].astype(np.int64))]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(np.concatenate(bodies))))
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in schema.split(", ")])

    def fit(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), capacity)
        base = group["bin_group"][0].as_py() << 32
        return group.drop_columns(["bin_group"]).append_column("sequence_id", pa.array(bins + base)).append_column("offset", pa.array(offsets))

    out = rows.mapInArrow(pieces, schema).groupBy("bin_group").applyInArrow(fit, schema.partition(", ")[2] + ", sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
