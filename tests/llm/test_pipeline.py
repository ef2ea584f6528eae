from __future__ import annotations

import zlib
from collections import defaultdict
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from loomline.llm.common import shared_folder  # noqa: E402
from loomline.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path  # noqa: E402


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "source mixing", "packing"]
    assert {q.split("_")[0] for q in QUERIES} == {f"op{i}" for i in range(1, 14)} and set(ORACLE_SQL) <= set(QUERIES)


@pytest.fixture(scope="module")
def tables(spark, messy, small, tmp_path_factory):
    """The messy rows beside the small tables' labels."""
    where = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{small}/documents.parquet")
    docs.write.parquet(f"{where}/documents.parquet")
    spark.read.parquet(f"{small}/labels.parquet").write.parquet(f"{where}/labels.parquet")
    return where


def test_each_stage_works_on_all_that_was_kept(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, tables).persist()
        n = docs.count()
        if name != "packing":
            assert docs.columns == columns
        if i < 3:
            assert 0 < n <= before
            before = n
    full = Tokenizer.from_file(tokenizer_path())
    sequences = defaultdict(list)
    for r in docs.collect():
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        sequences[r.sequence_id].append((r.offset, r.length))
        if r.start == 0 and r.length == r.doc_tokens:
            assert r.ids[-1] == 1 and full.encode(full.decode(r.ids[:-1], skip_special_tokens=False), add_special_tokens=False).ids == r.ids[:-1]
    for pieces in sequences.values():
        assert sum(n for _, n in pieces) <= 2048 and sorted(pieces)[0][0] == 0


def test_messy_rows_pass_every_stage(spark, messy, empty, tables):
    for start in (messy, empty):
        docs = start
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, tables)
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert start is not empty or docs.count() == 0


def test_run(spark, tables):
    left = lambda: set(Path(urlparse(shared_folder(spark)).path).glob("saved-*"))
    before = left()
    assert corpus_pipeline.run(spark, tables).filter(F.col("length") > 0).count() > 0
    assert len(left() - before) == 1  # what the last stage reads
