"""Labels: zones and scores by length, an append-once store, a grader for the middle zone, and the join to training rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.config import DEFAULT, Settings
from loomline.functions import messages as M
from loomline.functions import scoring as S
from loomline.functions.keys import label_key
from loomline.operators.calls import Ask, Caller, Calls

LABEL_SCHEMA = "key string, score int, method string, target_len int, thread_id string"
LABEL_COLUMNS = ("key", "score", "method", "target_len", "thread_id")
#: A grader's question. {convo} and {reply} are filled in; the answer has to hold a line CAN_AUTO_RESPOND: <number>%.
GRADER_PROMPT = """\
Recent conversation:
{convo}

The reply:
{reply}

How far could a simple bot have given this reply, from 50 (specific and technical) to 90 (generic)? Answer with one line:
CAN_AUTO_RESPOND: <number>%
"""


def keyed(samples: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """samples with key, target_len and zone."""
    return samples.withColumns({"key": label_key(F.col("thread_id"), F.col("target")), "target_len": F.length("target")}).withColumn("zone", S.zone(F.col("target_len"), s))


def last_wins(labels: DataFrame, order: str | Column) -> DataFrame:
    """One record a key: the last in the given order."""
    latest = labels.groupBy("key").agg(F.max_by(F.struct(*(c for c in labels.columns if c != "key")), order).alias("r"))
    return latest.select("key", "r.*")


def first_wins(samples: DataFrame) -> DataFrame:
    """One sample a key: the first by (source_path, pos)."""
    w = W.partitionBy("key").orderBy("source_path", "pos")
    return samples.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def unlabeled(samples: DataFrame, labels: DataFrame) -> DataFrame:
    return samples.join(labels.select("key"), "key", "left_anti")


def zone_histogram(samples: DataFrame) -> DataFrame:
    return samples.groupBy("zone").agg(F.count("*").alias("n"), F.max("target_len").alias("longest"))


def heuristic_labels(samples: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Records for the short and the long zone; samples as from keyed()."""
    score = F.when(F.col("zone") == "short", S.short_score(F.col("target_len"), s)).otherwise(S.long_score(F.col("target_len"), s))
    rows = first_wins(samples.filter("zone <> 'middle'"))
    return rows.select("key", score.alias("score"), F.concat(F.lit("heuristic_"), "zone").alias("method"), "target_len", "thread_id")


def grade(prompt: Column, ask: Ask, calls: Calls = Calls()) -> Column:
    """Answers of an external grader, in the order of the rows; several calls at once, see Calls. A call that fails for good gives null."""

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with Caller(ask, calls) as caller:
            for texts in batches:
                yield pd.Series(caller.all(texts.tolist()), index=texts.index, dtype=object)

    return run(prompt)


def questions(samples: DataFrame, labels: DataFrame, limit: int | None = None, prompt: str = GRADER_PROMPT, s: Settings = DEFAULT) -> DataFrame:
    """key, question, target_len, thread_id of the middle zone's samples without a label. The limit counts labeled ones too."""
    rows = samples.filter("zone = 'middle'")
    rows = rows.orderBy("source_path", "pos").limit(limit) if limit is not None else rows
    question = F.replace(F.replace(F.lit(prompt), F.lit("{convo}"), M.labeler_text(F.col("context_messages"), s)), F.lit("{reply}"), F.col("target"))
    return unlabeled(first_wins(rows), labels).select("key", question.alias("question"), "target_len", "thread_id")


def answered_labels(answers: DataFrame, name: str, read: Callable[[Column], Column] = lambda x: x) -> DataFrame:
    """Records from answers (key, answer, target_len, thread_id); one without a score stays unlabeled. read: the answer in an output."""
    rows = answers.withColumn("score", S.parse_score(read(F.col("answer")))).filter("score is not null")
    return rows.select("key", "score", F.lit(f"grader:{name}").alias("method"), "target_len", "thread_id")


def graded_labels(samples: DataFrame, labels: DataFrame, ask: Ask, name: str, limit: int | None = None, prompt: str = GRADER_PROMPT, s: Settings = DEFAULT, calls: Calls = Calls()) -> DataFrame:
    """Records for the middle zone, asked for as the rows are read. plans.dataset.label_dataset keeps each answer as it comes."""
    asked = questions(samples, labels, limit, prompt, s)
    return answered_labels(asked.withColumn("answer", grade(F.col("question"), ask, calls)), name)


def training_rows(samples: DataFrame, labels: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """messages, target, target_score, project (and source_path, pos): the label's score where there is one, else that by length. Spark broadcasts the labels if they are small."""
    rows = keyed(samples, s).join(labels.select("key", F.col("score").alias("given")), "key", "left")
    score = F.coalesce("given", S.heuristic_score(F.col("target_len"), s))
    context = F.transform("context_messages", lambda m: F.struct(M.coerce_role(m["role"]).alias("role"), m["content"].alias("content")))
    system = F.array(M.message("system", M.trainer_prompt(F.col("model"), F.col("harness"), F.col("cwd"))))
    return rows.select("source_path", "pos", F.concat(system, context).alias("messages"), M.wrap_target(F.col("target"), score).alias("target"), score.alias("target_score"), "project")
