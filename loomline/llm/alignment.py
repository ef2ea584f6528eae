"""Alignment of two tokenizers, in Arrow: flattened token lists with their parents, segmented running sums of bytes, a hash join on document and end, and counts of linked ids that Spark adds up."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import flat, list_column, saved, slices
from loomline.llm.packing import Encoder, byte_pieces, encoded

_SHIFT = 32  # an id pair as one number


class Pieces(Encoder):
    """Ids of a sentencepiece model, a word with the spaces before it at a time."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        # no token reaches over a space that follows another character, so words can be encoded apart
        self.apart = not any(" " in b.decode().lstrip(" ") for i, b in enumerate(self.bytes) if not self.model.is_byte(i)) and self._keeps_spaces()
        self.clear()

    def _keeps_spaces(self) -> bool:
        """Whether the model leaves runs of spaces as they are and puts one before the text."""
        return b"".join(self.bytes[i] for i in self.model.encode("a  b  ")) == b" a  b  "

    def learn(self, data: np.ndarray, keys: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        text = data.tobytes()  # the space before each piece is the model's own
        lists = self.model.encode([text[a + 1 : b].decode(errors="replace") for a, b in zip(start.tolist(), end.tolist(), strict=True)], num_threads=1)
        space = self.model.encode("a ")[-1:]  # a piece that is one space, at a text's end
        lists = [x or space for x in lists]
        self.keep(keys, np.array([len(x) for x in lists], np.int64), np.arange(len(keys)), [np.array([i for x in lists for i in x], np.uint32)])


class Side:
    """One tokenizer: ids of texts, and the bytes of each id."""

    def __init__(self, path: str, ranks_path: str | None = None):
        if path.endswith(".model"):
            self.encoder = Pieces(path)
            token_bytes = self.encoder.bytes
        else:
            from tokenizers import pre_tokenizers

            self.encoder = Encoder(path, ranks_path, specials=False)
            code = _byte_letters(pre_tokenizers.ByteLevel.alphabet())
            vocab = self.encoder.full.get_vocab(with_added_tokens=True)
            token_bytes = [b""] * (max(vocab.values()) + 1)
            for token, i in vocab.items():
                token_bytes[i] = bytes(code[c] for c in token) if all(c in code for c in token) else token.encode()
        self.token_bytes = pa.array(token_bytes, pa.large_binary())
        self.sizes = np.array([len(b) for b in token_bytes], np.int64)
        named = [str(i) for i in range(len(token_bytes))]
        #: each id as text with what may follow it: nothing, a comma, the other side's ids, or the next group.
        self.named = pa.array([n + s for n in named for s in ("", ",", "|", ";")], pa.large_string())

    def lists(self, data: np.ndarray, at: np.ndarray) -> pa.ListArray:
        """Token ids of each text; the data has a space before each text, which is part of it for the first tokenizer and the model's own for the second."""
        encoder = self.encoder
        if isinstance(encoder, Pieces) and not encoder.apart:
            text = data.tobytes()
            ids = encoder.model.encode([text[a + 1 : b].decode(errors="replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], num_threads=1)
            return pa.array(ids, pa.list_(pa.int64()))
        if isinstance(encoder, Pieces):
            opens = data == 32
            opens[1:] &= data[:-1] != 32
            opens[at[:-1]] = True  # each text begins with its space
        else:
            opens = byte_pieces(data, at)
        ids, begin = encoded(encoder, data, at, opens)
        return list_column(ids.astype(np.int64), begin[1:], pa.int64())


def _byte_letters(alphabet: list[str]) -> dict[str, int]:
    """The byte of each letter of a byte-level vocabulary: printable ones stand for themselves, the others follow in order from U+0100."""
    code = {c: ord(c) for c in alphabet if ord(c) < 256}
    others = (b for b in range(256) if b not in code.values())
    return code | {c: next(others) for c in sorted(c for c in alphabet if ord(c) >= 256)}


_sides: dict[tuple, Side] = {}


def side(path: str, ranks_path: str | None = None) -> Side:
    if (path, ranks_path) not in _sides:  # one for each Python worker
        _sides[path, ranks_path] = Side(path, ranks_path)
    return _sides[path, ranks_path]


def _ends(lists: pa.ListArray, sizes: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Ids, texts and byte ends within their text, of all tokens."""
    ids, parents = lists.flatten(), pc.list_parent_indices(lists)
    running = pc.cumulative_sum(pa.array(sizes[ids.to_numpy()]))
    before = np.concatenate([[0], running.to_numpy()])[lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()]
    return ids, parents, pc.subtract(running, pc.take(pa.array(before), parents))


def _same(lists: pa.ListArray, of: Side, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the bytes of each text's tokens, end to end, are the text."""
    body, ends = flat(pc.take(of.token_bytes, lists.flatten()))
    ends = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    a, b = data.tobytes(), body.tobytes()
    return np.array([x1 - x0 == y1 - y0 and a[x0:x1] == b[y0:y1] for x0, x1, y0, y1 in zip(at[:-1].tolist(), at[1:].tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)], bool)


def _emptied(lists: pa.ListArray, keep: np.ndarray) -> pa.ListArray:
    sizes = np.where(keep, np.diff(lists.offsets.to_numpy()), 0)
    return list_column(lists.flatten().to_numpy()[np.repeat(keep, np.diff(lists.offsets.to_numpy()))], np.cumsum(sizes), pa.int64())


def _group_texts(a: Side, b: Side, a_ids: np.ndarray, b_ids: np.ndarray, a_last: np.ndarray, b_last: np.ndarray, doc_ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """All groups as text, end to end, and where each text's begin. a_last, b_last: which tokens end a group, as many on either side. doc_ends: groups of all texts up to each."""
    a_upto, b_upto = np.flatnonzero(a_last) + 1, np.flatnonzero(b_last) + 1
    a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
    a_place = np.arange(len(a_ids)) + np.append(0, b_upto)[a_group]
    b_place = np.arange(len(b_ids)) + a_upto[b_group]
    final = np.zeros(len(a_upto), bool)
    final[doc_ends[np.diff(doc_ends, prepend=0) > 0] - 1] = True
    text = np.zeros(len(a_ids) + len(b_ids), np.int64)
    text[a_place] = a_ids * 4 + np.where(a_last, 2, 1)
    text[b_place] = len(a.named) + b_ids * 4 + np.where(b_last, np.where(final[b_group], 0, 3), 1)
    names = pa.concat_arrays([a.named, b.named])
    body, ends = flat(pc.take(names, pa.array(text)).cast(pa.large_binary()))
    tokens = np.append(0, np.append(0, a_upto + b_upto)[doc_ends])
    return body.tobytes(), ends[tokens]


def align(docs: DataFrame, a_path: str, b_path: str, a_ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A is a byte-level BPE that encodes the text with a space before it, B a sentencepiece model that puts that space there
    itself; special tokens' strings are plain text. Byte offsets where tokens of both end cut them into groups. A link is
    a pair of tokens that end together; a pair of ids counts as often as it is linked in all documents. n_best: links
    whose pair has the highest count of all pairs of its B id, ties included. count_sum: their counts added up over the
    document's links. groups_sha256 is of `a1,a2|b1;a3|b2,b3`, the ids of each group.

    A text that is null or empty, or that the bytes of A's or B's tokens don't give back (after the space), has no tokens:
    zeros, and an empty string for the hash. Each row gets its result and counts, repeated ones and those with a null id
    too; an empty table gives an empty result; other columns are ignored.

    The documents are tokenised once. A batch's token lists are flattened with their parents; a running sum of token
    bytes less its value at the text's start gives each token's end; a hash join of both sides on (text, end) gives the
    links, and a grouping each text's distinct pairs with their numbers, which are written with the text's other figures.
    Spark adds up the pairs' counts. Where two tokens end together one's bytes are a suffix of the other's, so the number
    of different pairs is bounded by the vocabularies (each token has fewer suffixes than bytes), not by the documents:
    their counts are broadcast, and a second pass over the pairs written gives the last two figures.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<int>"

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = side(a_path, a_ranks_path), side(b_path)
        for batch in slices(batches, "text"):
            data, at = flat(batch.column("text"))
            lists = [s.lists(data, at) for s in (a, b)]
            keep = (np.diff(at) > 1) & _same(lists[0], a, data, at) & _same(lists[1], b, data, at)
            lists = [_emptied(x, keep) for x in lists]
            (a_ids, a_docs, a_ends), (b_ids, b_docs, b_ends) = (_ends(x, s.sizes) for x, s in zip(lists, (a, b), strict=True))
            left = pa.table({"doc": a_docs, "end": a_ends, "a": a_ids, "a_at": pa.array(np.arange(len(a_ids)))})
            right = pa.table({"doc": b_docs, "end": b_ends, "b": b_ids, "b_at": pa.array(np.arange(len(b_ids)))})
            links = left.join(right, ["doc", "end"], join_type="inner", use_threads=False)
            pair = pc.bit_wise_or(pc.shift_left(links["a"], _SHIFT), links["b"])
            pairs = pa.table({"doc": links["doc"], "pair": pair}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")]).sort_by([("doc", "ascending"), ("pair", "ascending")])
            last = [np.zeros(len(ids), bool) for ids in (a_ids, b_ids)]
            for flags, name in zip(last, ("a_at", "b_at"), strict=True):
                flags[links[name].to_numpy()] = True
            groups = np.bincount(links["doc"].to_numpy(), minlength=batch.num_rows)
            body, begin = _group_texts(a, b, a_ids.to_numpy(), b_ids.to_numpy(), *last, np.cumsum(groups))
            hashes = [hashlib.sha256(body[i:j]).hexdigest() if j > i else "" for i, j in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
            ends = np.cumsum(np.bincount(pairs["doc"].to_numpy(), minlength=batch.num_rows))
            figures = [pa.array(np.diff(x.offsets.to_numpy()).astype(np.int64)) for x in lists]
            columns = [batch.column("id"), *figures, pa.array(groups.astype(np.int64)), pa.array(hashes, pa.string()), list_column(pairs["pair"].to_numpy(), ends, pa.int64()), list_column(pairs["count_all"].to_numpy().astype(np.int32), ends, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in schema.split(", ")])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's counts; the pairs are bounded by the vocabularies."""
        total = None
        for batch in batches:
            some = pa.table({"pair": batch.column("pairs").flatten(), "n": pc.cast(batch.column("times").flatten(), pa.int64())})
            total = (some if total is None else pa.concat_tables([total, some])).group_by("pair").aggregate([("n", "sum")]).rename_columns(["pair", "n"])
        if total is not None:
            yield from total.combine_chunks().to_batches()

    rows = docs.select(F.col(id_col).alias("id"), F.concat(F.lit(" "), F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    parsed = saved(rows.mapInArrow(tokenise, schema))
    counts = parsed.select("pairs", "times").mapInArrow(add_up, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # bounded by the vocabularies
    pair, n = counts["pair"].to_numpy(), counts["n"].to_numpy()
    order = np.argsort(pair)
    pair, n = pair[order], n[order]
    b_of = pair & ((1 << _SHIFT) - 1)
    most = np.zeros(int(b_of.max(initial=0)) + 1, np.int64)
    np.maximum.at(most, b_of, n)
    table = spark.sparkContext.broadcast((pair, n, n == most[b_of]))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, best = table.value
        for batch in batches:
            lists, times = batch.column("pairs"), batch.column("times").flatten().to_numpy().astype(np.int64)
            at = np.searchsorted(known, lists.flatten().to_numpy())
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            sums = [np.diff(np.append(0, np.cumsum(x))[offsets]) for x in (times * best[at], times * count[at])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "n_a", "n_b", "n_groups", "n_groups")), *(pa.array(x.astype(np.int64)) for x in sums), batch.column("groups_sha256")], names)

    names = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    out = parsed.mapInArrow(weigh, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return out.withColumnRenamed("id", id_col)
