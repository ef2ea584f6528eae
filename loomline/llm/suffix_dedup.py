"""Removal of repeated passages by a prefix-free parse: rolling-hash triggers make phrases, the suffixes of the dictionary of phrases are ordered, and with the parse's order of documents that gives corpus order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import flat, groups_for, mix, prefix_sums, slices, span_hash

GRAM = 16
_LAST = np.int64((1 << 63) - 1)
_STRETCH = 1 << 18  # starts whose triggers are found at once
_PLACE = np.uint64((1 << 20) - 1)
REPEATED, ASK = 1, 2


def _triggers(rolling: np.ndarray, width: int) -> np.ndarray:
    """For each start the place of the least of `width` rolling hashes from there on; of equals the leftmost."""
    out = np.empty(len(rolling) - width + 1, np.int64)
    for a in range(0, len(out), _STRETCH):
        some = rolling[a : a + _STRETCH + width - 1]
        least = some & ~_PLACE | np.arange(len(some), dtype=np.uint64)
        step = 1
        while step * 2 <= width:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if step < width:
            least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
        out[a : a + len(least)] = (least & _PLACE).astype(np.int64) + a
    return out


def phrases(data: np.ndarray, at: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, trigger hash and hash of each phrase.

    A trigger is the gram with the least rolling hash (of equals the leftmost) among those within `length` bytes. A
    phrase holds all strings of `length` bytes in a row that have the same trigger, so phrases overlap by length - 1
    bytes: each such string lies in exactly one phrase, equal strings have equal triggers wherever they stand, and no
    phrase is a prefix of another's suffix that has its trigger at the same place, unless they are the same up to there.
    """
    n = len(data)
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none, none.view(np.uint64), none.view(np.uint64)
    sums = prefix_sums(data)
    place = np.arange(n - gram + 1)
    rolling = span_hash(sums, place, place + gram)
    trigger = _triggers(rolling, length - gram + 1)
    long = np.diff(at) >= length
    inside = np.zeros(n + 1, np.int32)
    np.add.at(inside, at[:-1][long], 1)
    np.add.at(inside, at[1:][long] - length + 1, -1)
    inside = np.cumsum(inside)[: len(trigger)] > 0
    first = inside.copy()
    first[1:] &= (trigger[1:] != trigger[:-1]) | ~inside[:-1]
    first[at[:-1][long]] = True
    last = inside.copy()
    last[:-1] &= first[1:] | ~inside[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + length
    return start, end, rolling[trigger[start]], span_hash(sums, start, end)


def _member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the known ones, that are in order."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values if len(known) else np.zeros(len(values), bool)


class Bundle:
    """The parse of a few documents. Entries: the distinct phrases by part, trigger and phrase, each with the first document that has it here.

    A phrase whose trigger is hot is cut into its strings of `length` bytes, each a phrase and a trigger of its own.
    """

    def __init__(self, docs: pa.Table, parts: int, length: int, hot: np.ndarray):
        self.docs = docs.sort_by([("id", "ascending"), ("k", "ascending")]).combine_chunks()
        ids = self.docs["id"].combine_chunks()
        self.ids = np.where(ids.is_null().to_numpy(zero_copy_only=False), _LAST, ids.fill_null(0).to_numpy())
        self.data, self.at = flat(self.docs["text"].combine_chunks())
        start, end, trigger, phrase = phrases(self.data, self.at, length)
        cut = _member(trigger, hot)
        if cut.any():
            n = (end - start)[cut] - length + 1
            each = np.repeat(start[cut] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            own = span_hash(prefix_sums(self.data), each, each + length)
            start, end, trigger, phrase = (np.concatenate([x[~cut], y]) for x, y in ((start, each), (end, each + length), (trigger, mix(own)), (phrase, own)))
        doc = np.searchsorted(self.at, start, side="right") - 1
        part = ((trigger >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)
        short = trigger.astype(np.uint32)  # with the part, it tells triggers apart; two that it confuses are only looked at together
        order = np.lexsort((doc, phrase, short, part))
        start, end, doc, part, phrase, short = (x[order] for x in (start, end, doc, part, phrase, short))
        new = np.append(True, (phrase[1:] != phrase[:-1]) | (short[1:] != short[:-1]) | (part[1:] != part[:-1]))[: len(phrase)]
        self.occurrence = np.cumsum(new) - 1  # the entry of each occurrence
        self.occurs = (start, end, doc)
        self.start, self.end, self.doc, self.part, self.phrase, self.trigger = (x[new] for x in (start, end, doc, part, phrase, short))

    def rows(self, keep: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Parts among the kept entries, and each part's stretch of these."""
        used, begin = np.unique(self.part[keep], return_index=True)
        return used, list(zip(begin.tolist(), np.append(begin, int(keep.sum()))[1:].tolist(), strict=True))

    def documents(self, doc: np.ndarray) -> tuple[bytes, bytes]:
        """Ids of the distinct documents of a stretch of entries, and which of them each entry has."""
        used, which = np.unique(doc, return_inverse=True)
        return self.ids[used].tobytes(), which.astype(np.uint16 if len(used) < 1 << 16 else np.uint32).tobytes()


def _ids(table: pa.Table) -> np.ndarray:
    """The id of each entry, as documents() sent them."""
    out = []
    for ids, which, triggers in zip(table["ids"].to_pylist(), table["which"].to_pylist(), table["triggers"].to_pylist(), strict=True):
        out.append(np.frombuffer(ids, np.int64)[np.frombuffer(which, np.uint16 if len(which) * 2 == len(triggers) else np.uint32)])
    return np.concatenate([np.zeros(0, np.int64), *out])


def _joined(table: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(table[name].to_pylist()), kind)


def _answers(table: pa.Table, kind: int, values: np.ndarray, count: np.ndarray) -> pa.Table:
    """Values as bytes, row by row as the entries came."""
    body, ends = values.tobytes(), (np.cumsum(count) * values.itemsize).tolist()
    return pa.table({"bundle": table["bundle"], "part": table["part"], "kind": pa.array(np.full(len(count), kind, np.int32)), "answer": pa.array([body[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], pa.binary())})


def later_suffixes(data: np.ndarray, starts: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """Corpus order of suffixes by their first `length` bytes, those of equal bytes by document; and by it, which have a smaller id among their equals."""
    words = -(-length // 8)
    padded = np.concatenate([data, np.zeros(8 * words, np.uint8)])
    keys = padded[starts[:, None] + np.arange(8 * words)].view(">u8").astype(np.uint64)
    if length % 8:
        keys[:, -1] &= np.uint64((1 << 64) - (1 << 8 * (8 * words - length)))
    order = np.lexsort((ids, *keys.T[::-1]))
    keys = keys[order]
    new = np.append(True, (keys[1:] != keys[:-1]).any(1))[: len(keys)]
    later = np.empty(len(starts), bool)
    later[order] = ids[order] > ids[order][new][np.cumsum(new) - 1]
    return later


def remove_repeats(
    docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", bundle_bytes: int = 2 << 20, part_phrases: int = 1_000_000, census: int = 16, at_once: int = 1 << 18, with_kept: bool = False
) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes that remain).

    A byte goes if a string of `length` bytes (32 to 79) that covers it also starts in a document with a smaller id (null
    ids come last and are equal to each other), judged on the input; texts are UTF-8 bytes, null counts as empty, and no
    match crosses documents. Rows with one id don't remove each other's bytes; rows that share id and text come out
    alike. Ids are integers. An empty table gives an empty result; other columns are ignored.

    Documents are parsed in bundles of about bundle_bytes. A bundle sends its distinct phrases (the dictionary, as
    64-bit hashes) with their first documents (the parse) to parts by trigger. A part finds each phrase's first document: others
    are repeated as wholes. First ones whose trigger also has other phrases are asked for: their bundles send the
    strings, whose suffixes of at least `length` bytes are sorted by their bytes and then by document, some triggers at a
    time. As phrases overlap by length - 1 bytes, the suffix array of the parse is needed only as far as one phrase: it
    is the order of documents among equal suffixes. Together this is corpus order, cut into ranges of triggers, and
    neighbours in it that share `length` bytes show the repeats.

    What is sent grows with the phrases alone: a row has the ids of those documents only that its entries name. A trigger
    that has many different phrases in a sample of one document in `census` (it balances load and never changes a result)
    is hot: its phrases are cut into strings that are dealt by their content and settled by their hashes. Rows are dealt
    to bundles with their place, so repeated rows spread, and a phrase has one entry for each bundle at most.
    """
    if not 2 * GRAM <= length <= 63 + GRAM:
        raise ValueError(f"length must be from {2 * GRAM} to {63 + GRAM}")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(id_col, text_col).alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 114).alias("bytes")).first()["bytes"] or 0
    bundles, parts = groups_for(size, bundle_bytes), groups_for(size // 17, part_phrases)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, at = flat(batch.column("text"))
            _, _, trigger, phrase = phrases(data, at, length)
            yield pa.RecordBatch.from_pydict({"trigger": pa.array(trigger.view(np.int64)), "phrase": pa.array(phrase.view(np.int64))})

    sampled = rows.filter(F.pmod(F.xxhash64("k"), F.lit(census)) == 0).mapInArrow(parse, "trigger long, phrase long").distinct()
    frequent = sampled.groupBy("trigger").count().filter(F.col("count") * census * 8 > part_phrases).select("trigger").toArrow()  # at most 8 for each part
    hot = np.sort(frequent["trigger"].to_numpy().astype(np.int64).view(np.uint64))
    rows = rows.withColumn("bundle", F.pmod(F.xxhash64("k", F.monotonically_increasing_id()), F.lit(bundles)).cast("int"))

    def send(table: pa.Table) -> pa.Table:
        b = Bundle(table, parts, length, hot)
        used, stretches = b.rows(np.ones(len(b.part), bool))
        named = [b.documents(b.doc[i:j]) for i, j in stretches]
        return pa.table({"part": pa.array(used, pa.int32()), "bundle": pa.array(np.full(len(used), table["bundle"][0].as_py()), pa.int32()), "phrases": pa.array([b.phrase[i:j].tobytes() for i, j in stretches], pa.binary()), "triggers": pa.array([b.trigger[i:j].tobytes() for i, j in stretches], pa.binary()), "which": pa.array([w for _, w in named], pa.binary()), "ids": pa.array([i for i, _ in named], pa.binary())})

    def judge(table: pa.Table) -> pa.Table:
        phrase, trigger, ids = _joined(table, "phrases", np.uint64), _joined(table, "triggers", np.uint32), _ids(table)
        order = np.lexsort((ids, phrase, trigger))
        p, t, i = phrase[order], trigger[order], ids[order]
        new = np.append(True, (p[1:] != p[:-1]) | (t[1:] != t[:-1]))
        first, of = i[new], np.cumsum(new) - 1
        trigger = t[new]
        begin = np.flatnonzero(np.append(True, trigger[1:] != trigger[:-1]))
        differ = np.minimum.reduceat(first, begin) != np.maximum.reduceat(first, begin)
        differ = np.repeat(differ, np.diff(np.append(begin, len(trigger))))
        status = np.empty(len(p), np.uint8)
        status[order] = np.where(i > first[of], REPEATED, np.where(differ[of], ASK, 0))
        return _answers(table, 0, status, np.array([len(x) // 4 for x in table["triggers"].to_pylist()]))

    def statuses(answers: pa.Table, kind: int) -> np.ndarray:
        found = answers.filter(pa.compute.equal(answers["kind"], kind)).sort_by("part")
        return _joined(found, "answer", np.uint8 if kind == 0 else np.uint64)

    def tell(table: pa.Table, answers: pa.Table) -> pa.Table:
        b = Bundle(table, parts, length, hot) if table.num_rows else None
        keep = statuses(answers, 0) == ASK if b else np.zeros(0, bool)
        if not keep.any():
            return pa.table({"part": pa.array([], pa.int32()), "bundle": pa.array([], pa.int32()), "body": pa.array([], pa.binary()), "sizes": pa.array([], pa.binary()), "triggers": pa.array([], pa.binary()), "which": pa.array([], pa.binary()), "ids": pa.array([], pa.binary())})
        used, stretches = b.rows(keep)
        start, size, trigger, doc = b.start[keep], (b.end - b.start)[keep], b.trigger[keep], b.doc[keep]
        at = np.cumsum(size)
        body = b.data[np.repeat(start - (at - size), size) + np.arange(at[-1])].tobytes()
        at = np.concatenate([[0], at])
        named = [b.documents(doc[i:j]) for i, j in stretches]
        columns = {"body": [body[at[i] : at[j]] for i, j in stretches], "sizes": [size[i:j].astype(np.uint8).tobytes() for i, j in stretches], "triggers": [trigger[i:j].tobytes() for i, j in stretches], "which": [w for _, w in named], "ids": [i for i, _ in named]}
        return pa.table({"part": pa.array(used, pa.int32()), "bundle": pa.array(np.full(len(used), table["bundle"][0].as_py()), pa.int32())} | {c: pa.array(x, pa.binary()) for c, x in columns.items()})

    def compare(table: pa.Table) -> pa.Table:
        size, trigger, ids, data = _joined(table, "sizes", np.uint8).astype(np.int64), _joined(table, "triggers", np.uint32), _ids(table), _joined(table, "body", np.uint8)
        at, suffixes = np.cumsum(size) - size, size - length + 1
        order = np.argsort(trigger, kind="stable")
        total = np.cumsum(suffixes[order])
        edges = np.append(np.flatnonzero(np.append(True, trigger[order][1:] != trigger[order][:-1])), len(order))
        bits = np.zeros(len(size), np.uint64)
        done = 0
        while done < len(order):  # whole triggers, about at_once suffixes
            upto = np.searchsorted(total, (total[done - 1] if done else 0) + at_once, side="right")
            upto = int(edges[max(np.searchsorted(edges, upto, side="right") - 1, np.searchsorted(edges, done) + 1)])
            some = order[done:upto]
            n = suffixes[some]
            begin = np.cumsum(n) - n
            step = np.arange(n.sum()) - np.repeat(begin, n)
            later = later_suffixes(data, np.repeat(at[some], n) + step, np.repeat(ids[some], n), length)
            bits[some] = np.bitwise_or.reduceat(later.astype(np.uint64) << step.astype(np.uint64), begin)
            done = upto
        return _answers(table, 1, bits, np.array([len(x) for x in table["sizes"].to_pylist()]))

    def strip(table: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_kept]
        if not table.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())[: len(names)]], names)
        b = Bundle(table, parts, length, hot)
        status, bits = statuses(answers, 0), statuses(answers, 1)
        start, end, doc = b.occurs
        here = b.ids[doc] == b.ids[b.doc[b.occurrence]]  # else an earlier document of the bundle has the phrase
        whole = ~here | (status[b.occurrence] == REPEATED)
        steps = np.zeros(len(b.data) + 1, np.int64)
        np.add.at(steps, start[whole], 1)
        np.add.at(steps, end[whole], -1)
        asked = np.full(len(status), -1)
        asked[status == ASK] = np.arange(len(bits))
        partly = ~whole & (status[b.occurrence] == ASK)
        start, found = start[partly], bits[asked[b.occurrence[partly]]]
        for j in range(length - GRAM + 1):
            hit = start[(found >> np.uint64(j) & np.uint64(1)).astype(bool)] + j
            np.add.at(steps, hit, 1)
            np.add.at(steps, hit + length, -1)
        gone = np.cumsum(steps)[:-1] > 0
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        begins = b.at[:-1][np.diff(b.at) > 0]
        opens[begins] = gone[begins]
        removed, spans_ = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, opens))
        stay = b.data[~gone].tobytes()
        left = (b.at - removed[b.at]).tolist()
        kept = [stay[i:j] for i, j in zip(left[:-1], left[1:], strict=True)]
        columns = [b.docs["id"].combine_chunks(), *(pa.array(x.astype(np.int64)) for x in (np.diff(b.at), np.diff(removed[b.at]), np.diff(spans_[b.at]))), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
        return pa.table([*columns, *[pa.array(kept, pa.binary())] * with_kept], names)

    by_bundle = rows.groupBy("bundle")
    answer = "bundle int, part int, kind int, answer binary"
    sent = by_bundle.applyInArrow(send, "part int, bundle int, phrases binary, triggers binary, which binary, ids binary")
    whole = sent.groupBy("part").applyInArrow(judge, answer)
    strings = by_bundle.cogroup(whole.groupBy("bundle")).applyInArrow(tell, "part int, bundle int, body binary, sizes binary, triggers binary, which binary, ids binary")
    partly = strings.groupBy("part").applyInArrow(compare, answer)
    out = by_bundle.cogroup(whole.unionByName(partly).groupBy("bundle")).applyInArrow(strip, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept)
    return out.withColumnRenamed("id", id_col)
