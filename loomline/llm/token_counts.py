"""Token counts behind a cache: contents and tokenizer versions are told apart by digests, stored counts are joined, and only distinct misses are encoded and appended."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from importlib.metadata import version
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import flat, saved, shared_folder, slices
from loomline.llm.packing import token_ids

COUNTS = "digest binary, n_tokens long"


class Counter:
    """Numbers of tokens as the library that owns the file gives them: `tokenizers` for .json, `sentencepiece` for .model; no begin, end or padding."""

    def __init__(self, path: str, ranks_path: str | None = None):
        self.path, self.ranks_path = path, ranks_path
        self.model = None
        if path.endswith(".model"):
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            spec = json.loads(Path(path).read_bytes())
            # pieces can be counted by themselves where bytes are cut at spaces and nothing rewrites the text
            self.by_pieces = spec["normalizer"] is None and (spec["pre_tokenizer"] or {}).get("type") == "ByteLevel" and not spec["pre_tokenizer"]["add_prefix_space"] and not any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in spec["added_tokens"])
            if not self.by_pieces:
                from tokenizers import Tokenizer

                self.model = Tokenizer.from_file(path)
                self.model.no_padding(), self.model.no_truncation()

    def __call__(self, texts: pa.Array) -> np.ndarray:
        if self.model is None:
            return np.diff(token_ids(*flat(texts), self.path, self.ranks_path)[1])
        if self.path.endswith(".model"):
            return np.array([len(x) for x in self.model.encode(texts.to_pylist(), num_threads=1)], np.int64)
        return np.array([len(x) for x in self.model.encode_batch(texts.to_pylist(), add_special_tokens=False)], np.int64)


def tokenizer_digest(path: str) -> str:
    """SHA-256 of the library, its version and the file's bytes: counts of another version are never taken for these."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    return hashlib.sha256(f"{library} {version(library)}\n".encode() + Path(path).read_bytes()).hexdigest()


def content_digest(text: Column) -> Column:
    """SHA-256 of the text as UTF-8."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def with_digest(rows: DataFrame, tokenizer_path: str) -> DataFrame:
    """rows (id, text) with the digest of the text's normal form: what the tokenizer itself makes of a text before it looks for tokens.

    A tokenizer without a normaliser, and any whose normaliser can't be asked alone (.model), has texts as they are. A text
    that holds the string of an added token, which is looked for before anything is normalised, stands for itself too.
    """
    spec = {} if tokenizer_path.endswith(".model") else json.loads(Path(tokenizer_path).read_bytes())
    if not spec.get("normalizer"):
        return rows.withColumn("digest", content_digest(F.col("text")))
    added = [t["content"] for t in spec["added_tokens"]]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        normal = Tokenizer.from_file(tokenizer_path).normalizer.normalize_str
        for batch in batches:
            forms = (b"=" + t.encode() if any(a in t for a in added) else b"~" + normal(t).encode() for t in batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([hashlib.sha256(f).digest() for f in forms], pa.binary())], [*batch.schema.names, "digest"])

    return rows.mapInArrow(digest, f"id {dict(rows.dtypes)['id']}, text string, digest binary")


class Cache:
    """Stored counts of one tokenizer version: Parquet files in a folder of its digest.

    append() writes a lot aside and renames it, so a reader sees whole lots alone, and a job that dies leaves nothing
    that counts. Two jobs that append the same digest leave two equal rows; read() gives one.
    """

    def __init__(self, spark, where: str, tokenizer: str):
        self.spark, self.folder = spark, f"{where}/tokenizer-{tokenizer}"

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def read(self) -> DataFrame:
        fs, path = self._fs()
        lots = [str(s.getPath().toString()) for s in fs.listStatus(path) if s.getPath().getName().startswith("lot-")] if fs.exists(path) else []
        if not lots:
            return self.spark.createDataFrame([], COUNTS)
        rows = self.spark.read.schema(COUNTS).parquet(*lots)
        return rows.dropDuplicates(["digest"]) if len(lots) > 1 else rows

    def append(self, counts: DataFrame) -> DataFrame:
        """One lot, its digests distinct; returned as it is stored."""
        name = uuid.uuid4().hex
        counts.write.parquet(f"{self.folder}/_new-{name}")
        fs, path = self._fs()
        at = lambda kind: self.spark._jvm.org.apache.hadoop.fs.Path(path, f"{kind}-{name}")
        if not fs.rename(at("_new"), at("lot")):
            raise OSError(f"{self.folder}: the new counts could not be put in place")
        return self.spark.read.schema(COUNTS).parquet(f"{self.folder}/lot-{name}")


def count_tokens(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, cache: str | None = None, limit: int = 512, few: int = 100_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_bytes (as UTF-8), n_tokens, over_limit (more than `limit` tokens), digest (hex).

    A null text counts as empty; special strings in texts are handled as the library does by default. Each row is
    counted, repeated ones and those with a null id too; an empty table gives an empty result; other columns are ignored.

    cache: folder of the stored counts, that all executors share; without it a new one in the session's checkpoint
    folder. The digests of all rows (of normal forms, see with_digest) are written once, beside their ids. Distinct
    digests that the cache lacks are the misses. Texts are read again for those alone: each task passes on one text for
    each miss, they shuffle by digest, and a second sifting leaves one text each to encode. If there are at most `few`
    misses (32 bytes each), they are broadcast, so only their texts shuffle; otherwise texts and misses meet by digest.
    The result joins known and new counts to all rows; a content that many rows share is split by the session's skew
    handling, as both sides are plain tables.
    """
    spark = docs.sparkSession
    store = Cache(spark, cache or f"{shared_folder(spark)}/token-counts-{uuid.uuid4().hex}", tokenizer_digest(tokenizer_path))
    rows = with_digest(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), tokenizer_path)
    ledger = saved(rows.select("id", "digest", F.octet_length("text").cast("long").alias("n_bytes")))
    asked = saved(ledger.select("digest").distinct().join(store.read(), "digest", "left"))
    misses, counts = asked.filter("n_tokens is null").select("digest"), asked.filter("n_tokens is not null")
    missing = misses.count()

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first row of each digest in this task."""
        seen: set[bytes] = set()
        for batch in batches:
            keep = []
            for i, digest in enumerate(batch.column("digest").to_pylist()):
                if digest not in seen:
                    seen.add(digest)
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64()))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer_path, ranks_path)
        for batch in slices(sift(batches), "text"):
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counter(batch.column("text")).astype(np.int64))], ["digest", "n_tokens"])

    if missing:
        texts = rows.select("digest", "text")
        wanted = texts.join(F.broadcast(misses), "digest", "left_semi") if missing <= few else texts
        spread = wanted.mapInArrow(sift, "digest binary, text string").repartition("digest")
        met = spread if missing <= few else spread.join(misses.hint("shuffle_hash"), "digest", "left_semi")
        counts = counts.unionByName(store.append(met.mapInArrow(encode, COUNTS)))
    out = ledger.join(counts, "digest", "left")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), F.lower(F.hex("digest")).alias("digest"))
