"""JSON Lines stores of samples, labels, candidates and prompts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators.calls import opened
from loomline.operators.labels import LABEL_COLUMNS, LABEL_SCHEMA, last_wins
from loomline.sources.scratch import delete, exists, file_system, names

CANDIDATE_SCHEMA = "stage string, project string, candidate string, score double, wall_time double, extra string"
SAMPLE_SCHEMA = "context_messages array<struct<role: string, content: string>>, target string, project string, harness string, model string, cwd string, source_path string, thread_id string, pos int"


def _there(spark: SparkSession, paths: list[str]) -> list[str]:
    return [p for p in paths if exists(spark, p)]


def read_samples(spark: SparkSession, paths: list[str] | str, n: int | None = None) -> DataFrame:
    """Samples of all files that exist; source_path and thread_id default to empty. n: the first by (source_path, pos)."""
    found = _there(spark, [paths] if isinstance(paths, str) else paths)
    rows = spark.read.schema(SAMPLE_SCHEMA).json(found) if found else spark.createDataFrame([], SAMPLE_SCHEMA)
    rows = rows.fillna("", ["source_path", "thread_id"])
    return rows.orderBy("source_path", "pos").limit(n) if n is not None else rows


def write_samples(samples: DataFrame, path: str) -> None:
    samples.write.mode("overwrite").partitionBy("split").json(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels from elsewhere, as JSON Lines: one record a key, the last by file name and line. What this library writes is in a LabelStore."""
    if not exists(spark, path):
        return spark.createDataFrame([], LABEL_SCHEMA)
    rows = spark.read.schema(LABEL_SCHEMA).json(path).withColumn("_at", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))
    return last_wins(rows, "_at").drop("_at")


def write_labels(labels: DataFrame, path: str) -> None:
    """A store's labels as JSON Lines, for those who read these."""
    labels.select(*LABEL_COLUMNS).write.mode("overwrite").json(path)


def write_files(rows: DataFrame, folder: str, *order: str) -> int:
    """rows (path, line) as text files below folder, one for each path, whose lines are in the given order; how many files.

    For very many small files: Spark's writer takes a folder and a commit for each, this a file. A file is written aside
    and renamed, so a task that runs again replaces it. folder: one that workers reach by pyarrow (a shared mount, hdfs, s3, gs).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(folder)
        made, n, at, aside, out = set(), 0, None, "", None

        def close() -> None:
            if out:
                out.close()
                system.move(aside, f"{root}/{at}")

        for batch in batches:
            paths, lines = batch.column("path").to_pylist(), batch.column("line").to_pylist()
            begins = [i for i, p in enumerate(paths) if not i or p != paths[i - 1]]
            for i, j in zip(begins, [*begins[1:], len(paths)], strict=True):
                if paths[i] != at:
                    close()
                    at, n = paths[i], n + 1
                    of = f"{root}/{at}".rpartition("/")[0]
                    if of not in made:
                        system.create_dir(of)
                        made.add(of)
                    aside = f"{of}/_new-{uuid.uuid4().hex}"
                    out = system.open_output_stream(aside)
                out.write("".join(f"{x}\n" for x in lines[i:j]).encode())
        close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([n])})

    dealt = rows.repartition("path").sortWithinPartitions("path", *order).select("path", F.coalesce("line", F.lit("")).alias("line"))
    return dealt.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def delete_files(spark: SparkSession, folders: list[str]) -> None:
    """Folders of very many files, as write_files leaves them, deleted by tasks and not one file after another by the driver."""

    def run(of: Iterator[str]) -> None:
        for folder in of:
            system, path = opened(folder)
            system.delete_dir(path)

    if folders:
        spark.sparkContext.parallelize(folders, min(len(folders), 4 * spark.sparkContext.defaultParallelism)).foreachPartition(run)


def append_candidates(rows: DataFrame, path: str) -> None:
    """stage, project, candidate, score, wall_time, extra: one more file for each call."""
    rows.write.mode("append").json(path)


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a candidate log; none if it isn't there yet."""
    return spark.read.schema(CANDIDATE_SCHEMA).json(path) if exists(spark, path) else spark.createDataFrame([], CANDIDATE_SCHEMA)


def write_prompt(spark: SparkSession, folder: str, text: str, project: str | None = None) -> None:
    """Replaces the shared prefix, or a project's suffix. It is written aside and renamed under the next version's name, so a reader sees the old text or the new one, never half of either."""
    where = folder if project is None else f"{folder}/suffix"
    name = "prefix" if project is None else project
    fs, aside = file_system(spark, f"{where}/_new-{uuid.uuid4().hex}")
    out = fs.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    version = max(_versions(spark, where, name), default=0) + 1
    while not fs.rename(aside, file_system(spark, f"{where}/{name}.{version:08d}.txt")[1]):  # another writer was first
        version += 1
        if version > 10**8 - 1:
            raise OSError(f"{where}/{name}: no further version")
    for old in _versions(spark, where, name):
        if old < version - 1:  # the last but one stays for those who have just listed it
            delete(spark, f"{where}/{name}.{old:08d}.txt")


def _versions(spark: SparkSession, where: str, name: str) -> list[int]:
    return [int(n[len(name) + 1 : -4]) for n in names(spark, where) if n.startswith(f"{name}.") and n.endswith(".txt") and n[len(name) + 1 : -4].isdigit()]


def read_prompts(spark: SparkSession, folder: str) -> tuple[str, DataFrame]:
    """The shared prefix, and project and suffix of each project that has one. A missing prefix is an error. Files without a version, prefix.txt and suffix/<project>.txt, count where there is none with one."""
    versions = _versions(spark, folder, "prefix")
    found = f"{folder}/prefix.{max(versions):08d}.txt" if versions else f"{folder}/prefix.txt"
    if not exists(spark, found):
        raise FileNotFoundError(found)
    prefix = spark.read.text(found, wholetext=True).first()["value"]
    if not exists(spark, f"{folder}/suffix"):
        return prefix, spark.createDataFrame([], "project string, suffix string")
    rows = spark.read.text(f"{folder}/suffix", wholetext=True, pathGlobFilter="*.txt")
    part = lambda i: F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.(\d{8}))?\.txt$", i)
    return prefix, rows.groupBy(part(1).alias("project")).agg(F.max_by("value", part(2)).alias("suffix"))
