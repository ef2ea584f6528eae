"""Near-duplicate documents: a Jaccard join of word n-gram sets by MinHash banding, verified on the full sets."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import LOWER, cut, flat, list_column, mix, prefix_sums, shingles, signed, slices, span_hash, spans
from loomline.llm.components import components


@dataclass(frozen=True)
class Config:
    words: int = 5
    threshold: float = 0.8
    recall: float = 0.995  # of pairs just at the threshold
    most_hashes: int = 128
    block: int = 512  # documents of a large bucket or class that meet in one task, twice
    seed: int = 21


def bands_for(threshold: float, recall: float, most_hashes: int) -> tuple[int, int]:
    """(bands, rows): the most rows a band, and so the fewest chance candidates, with which 1 - (1 - threshold^rows)^bands >= recall. An error if no choice within most_hashes reaches it."""
    best = None
    for rows in range(1, 33):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-p))
        if bands * rows <= most_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError(f"no bands of at most {most_hashes} hashes find a similarity of {threshold} with recall {recall}")
    return best


def text_shingles(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes and their text numbers; word hashes and theirs. Words are runs outside ASCII white space, A-Z lower-cased."""
    data, at = flat(column)
    start, end, own = spans(data, at)
    words = span_hash(prefix_sums(data, LOWER), start, end)
    values, owner = shingles(words, own, len(at) - 1, size)
    return values, owner, words, own


def sequence_print(words: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit print of each text's word sequence."""
    count = np.bincount(own, minlength=n)
    place = (np.arange(len(words)) - np.repeat(np.cumsum(count) - count, count)).astype(np.uint64)
    total = np.zeros(n, np.uint64)
    some = count > 0
    if len(words):
        total[some] = np.add.reduceat(mix(words + mix(place + np.uint64(1))), (np.cumsum(count) - count)[some])
    return mix(total + count.astype(np.uint64))


def distinct_sets(values: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text, and where each text's end."""
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    return v[new], np.searchsorted(o[new], np.arange(n), side="right")


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows that share their keys, from rows ordered by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.column_stack([batch.column(k).to_numpy() for k in keys])
        edges = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1).tolist(), len(marks)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            mark = marks[a].tolist()
            if held and mark != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = mark
    if held:
        yield pa.Table.from_batches(held)


def overlaps(values: np.ndarray, row: np.ndarray, n: int, width: int = 4096) -> np.ndarray:
    """(n, n) sizes of the sets' intersections; values are distinct within a row."""
    order = np.argsort(values, kind="stable")
    v, r = values[order], row[order]
    new = np.ones(len(v), bool)
    new[1:] = v[1:] != v[:-1]
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    r, column = r[shared], column[shared]
    if len(column):
        column = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]]))
    out = np.zeros((n, n), np.float32)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        i, j = np.searchsorted(column, (a, a + width))
        m = np.zeros((n, min(width, int(column[-1]) + 1 - a)), np.float32)
        m[r[i:j], column[i:j] - a] = 1
        out += m @ m.T
    return out


def roots_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each item's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return root


@dataclass
class Joined:
    """rows: id, k (of the row's id and text), node (of the word sequence), one per input row. nodes: node, id, k (of the row that stands for it), copies, class_id, class_k, class_size, links, text_links."""

    rows: DataFrame
    nodes: DataFrame


def join(docs: DataFrame, config: Config = Config(), id_col: str = "doc_id", text_col: str = "text") -> Joined:
    """Link documents whose sets of word n-grams have a Jaccard similarity of at least the threshold.

    Texts of one word sequence are copies and go on as one node. Nodes that share a band's hash are a bucket, and all
    pairs of a bucket are candidates. No candidate joins anything before it is verified on full n-gram sets:

    1. each node is verified against the least node of each of its buckets; its family is the least that it is similar to, else its own;
    2. all pairs within a family are verified;
    3. a bucket that holds several families has the pairs across them verified, each pair in the first band it shares.

    All of them meet in tiles of at most 2 * config.block nodes, so no task holds a whole bucket or family, no pair is
    listed, and each link between different texts is counted once. Chance candidates cost their own verification and
    chain nothing together. A class is a component of verified links. A text of fewer words than n has one n-gram of
    all its words; one without words (or null) links to nothing, not even its like. Ids may be null or repeated: rows
    are told apart by id and text. An empty table gives empty results; other columns are ignored.
    """
    bands, width = bands_for(config.threshold, config.recall, config.most_hashes)
    rng = np.random.Generator(np.random.Philox(config.seed))
    factors = rng.integers(1, 1 << 63, bands * width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    size, block, threshold = config.words, config.block, config.threshold
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("k"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            n = batch.num_rows
            values, owner, words, own = text_shingles(batch.column("text"), size)
            node = sequence_print(words, own, n)
            full = np.unique(owner)
            none = np.setdiff1d(np.arange(n), full)
            node[none] = mix(batch.column("k").to_numpy()[none].view(np.uint64))
            out = np.zeros((len(full), bands), np.uint64)
            if len(full):
                begin = np.searchsorted(owner, full)
                for j in range(bands):
                    h = np.full(len(full), j + 1, np.uint64)
                    for f in factors[j * width : (j + 1) * width]:
                        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + np.minimum.reduceat(mix_fast(values, f), begin))
                    out[:, j] = h
            has = np.zeros(n, np.int64)
            has[full] = bands
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("k"), pa.array(signed(node)), list_column(signed(out.ravel()), np.cumsum(has), pa.int64())], ["id", "k", "node", "bands"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            values, owner, _, _ = text_shingles(batch.column("text"), size)
            values, ends = distinct_sets(values, owner, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("copies"), batch.column("bands"), list_column(signed(values), ends, pa.int64())], ["node", "copies", "bands", "grams"])

    def verify(mode: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in grouped(batches, ["of", "ti", "tj"]):
            nodes, first = np.unique(tile["node"].to_numpy(), return_index=True)
            tile = tile.take(pa.array(first))
            n = len(nodes)
            grams = tile["grams"].combine_chunks()
            length = np.diff(grams.offsets.to_numpy())
            met = overlaps(grams.flatten().to_numpy(), np.repeat(np.arange(n), length), n)
            similar = met >= threshold * (length[:, None] + length[None, :] - met) - 1e-6
            np.fill_diagonal(similar, False)
            of = tile["of"][0].as_py()
            if mode == "head":
                similar[nodes != of] = False
            elif tile["ti"][0].as_py() != tile["tj"][0].as_py():
                block_of = tile["block"].to_numpy()
                similar &= block_of[:, None] != block_of[None, :]
            if mode == "bucket":
                family, band = tile["family"].to_numpy(), tile["bands"].combine_chunks().flatten().to_numpy().reshape(n, bands)
                here = int(np.flatnonzero((band == of).all(0))[0])
                earlier = (band[:, None, :here] == band[None, :, :here]).any(2) if similar.any() else similar
                similar &= (family[:, None] != family[None, :]) & ~earlier
            a, b = np.nonzero(similar)
            if mode == "head":
                if len(b):
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[b]), pa.array(np.full(len(b), of)), pa.array(np.zeros(len(b), np.int64)), pa.array(np.zeros(len(b), np.int64))], ["u", "v", "text_links", "links"])
                continue
            root = roots_of(n, a, b)
            text_links, links = similar.sum(1), similar @ tile["copies"].to_numpy()
            some = text_links > 0
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(nodes[root[some]]), pa.array(text_links[some].astype(np.int64)), pa.array(links[some].astype(np.int64))], ["u", "v", "text_links", "links"])

    def blocked(places: DataFrame) -> DataFrame:
        """places (of, node, ...) with ti, tj, block: the tiles in which the members of each `of` meet, block by block."""
        sizes = places.groupBy("of").agg(F.count("*").alias("n"))
        out = places.join(sizes, "of").withColumn("blocks", F.expr(f"cast((n + {block - 1}) div {block} as int)")).withColumn("block", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
        out = out.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        return out.withColumns({"ti": F.least("block", "other"), "tj": F.greatest("block", "other")})

    def checked(tiles: DataFrame, mode: str) -> DataFrame:
        found = tiles.join(grams, "node").select("of", "ti", "tj", "node", "copies", "block", "grams", *(["family", "bands"] if mode == "bucket" else []))
        found = found.repartition("of", "ti", "tj").sortWithinPartitions("of", "ti", "tj")
        return cut(found.mapInArrow(lambda batches: verify(mode, batches), "u long, v long, text_links long, links long"))

    signs = cut(rows.mapInArrow(sign, f"id {kind}, k long, node long, bands array<long>"))
    heads = cut(signs.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k")).alias("head"), F.count("*").alias("copies"), F.any_value("bands").alias("bands")))
    probes = heads.select("node", F.explode("bands").alias("h"))
    buckets = cut(probes.groupBy("h").agg(F.min("node").alias("m"), F.max("node").alias("x")).filter("m < x").select("h", "m"))
    placed = cut(probes.join(buckets, "h"))
    wanted = heads.join(placed.select("node").distinct(), "node", "left_semi").select("node", F.col("head.k").alias("k"), "copies", "bands")
    texts = rows.join(wanted, "k").dropDuplicates(["node"]) if _repeats(signs) else rows.join(wanted, "k")
    grams = cut(texts.select("node", "copies", "bands", "text").mapInArrow(sets, "node long, copies long, bands array<long>, grams array<long>"))

    # 1: members against their heads; a head goes to each block of its members
    pairs = placed.filter("node <> m").select(F.col("m").alias("of"), "node").distinct()
    many = pairs.groupBy("of").agg(F.count("*").alias("n")).withColumn("blocks", F.expr(f"cast((n + {block - 1}) div {block} as int)"))
    members = pairs.join(many, "of").select("of", "node", F.expr("cast(pmod(xxhash64(node), blocks) as int)").alias("ti"))
    tops = many.select("of", F.col("of").alias("node"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("ti"))
    stars = checked(members.unionByName(tops).withColumns({"tj": F.lit(0), "block": F.lit(0)}), "head")
    families = stars.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    families = cut(families.unionByName(families.select(F.col("root").alias("node"), "root").distinct().join(families.select("node"), "node", "left_anti")))
    # 2: within families
    inner = checked(blocked(families.select(F.col("root").alias("of"), "node")), "family")
    # 3: across the families of a bucket
    several = placed.join(families, "node", "left").select(F.col("h").alias("of"), "node", F.coalesce("root", "node").alias("family"))
    mixed = several.groupBy("of").agg(F.min("family").alias("low"), F.max("family").alias("high")).filter("low < high").select("of")
    across = checked(blocked(several.join(mixed, "of")), "bucket")

    linked = inner.unionByName(across)
    classes = cut(components(linked.select("u", "v")))
    counts = cut(linked.groupBy(F.col("u").alias("node")).agg(F.sum("text_links").alias("text_links"), F.sum("links").alias("links")))
    members = cut(heads.select("node", "head", "copies").join(classes, "node", "left").join(counts, "node", "left").withColumn("root", F.coalesce("root", "node")))
    tops = cut(members.groupBy("root").agg(F.min("head").alias("top"), F.sum("copies").alias("class_size")))
    nodes = members.join(tops, "root").select(
        "node", F.col("head.id").alias("id"), F.col("head.k").alias("k"), "copies", F.col("top.id").alias("class_id"), F.col("top.k").alias("class_k"), "class_size",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("text_links", F.lit(0)).alias("text_links"),
    )
    return Joined(signs.select("id", "k", "node"), cut(nodes))


def _repeats(signs: DataFrame) -> bool:
    """Whether any row repeats another's id and text."""
    return bool(signs.groupBy("id", "k").count().filter("count > 1").limit(1).count())


def mix_fast(values: np.ndarray, factor: np.uint64) -> np.ndarray:
    """One random ordering of already mixed values."""
    x = values * factor
    return x ^ (x >> np.uint64(32))


def near_duplicates(docs: DataFrame, config: Config = Config(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, class_id (the least id of its class), class_size (rows), links (rows it is linked to, copies included), text_links (different texts it is linked to). See join()."""
    made = join(docs, config, id_col, text_col)
    out = made.rows.join(made.nodes.select("node", "class_id", "class_size", "links", "text_links"), "node")
    return out.select(F.col("id").alias(id_col), "class_id", "class_size", "links", "text_links")


def keep_one(docs: DataFrame, config: Config = Config(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stand for their class: the least id of each. Of rows that share id and text one stays."""
    made = join(docs, config, id_col, text_col)
    kept = made.nodes.filter("k = class_k").select("k")
    out = docs.withColumn("_loom_k", F.xxhash64(id_col, text_col)).join(kept.withColumnRenamed("k", "_loom_k"), "_loom_k", "left_semi")
    if _repeats(made.rows):
        out = out.dropDuplicates(["_loom_k"])
    return out.select(*docs.columns)
