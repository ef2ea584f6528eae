"""Scoring generated replies with an external judge and embedder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.functions import messages as M
from loomline.functions import scoring as S
from loomline.operators.calls import Ask, Calls
from loomline.operators.labels import grade

Embedder = Callable[[], Callable[[list[str]], np.ndarray]]


def embed(texts: Column, make: Embedder) -> Column:
    """ARRAY<FLOAT> of each text, a batch at a time; a batch that fails is null."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embedder = make()
        for batch in batches:
            try:
                yield pd.Series(list(np.asarray(embedder(batch.fillna("").tolist()), np.float32)))
            except Exception:  # a failed embedding counts as zero similarity
                yield pd.Series([None] * len(batch), dtype=object)

    return run(texts)


def gold_first(key: Column, seed: int = 0) -> Column:
    """A fair coin for each row that reruns repeat."""
    return F.xxhash64(F.lit(seed), key) % 2 == 0


def score_replies(replies: DataFrame, judge: Ask, embedder: Embedder, seed: int = 0, weights: tuple[float, float, float] = (0.6, 0.3, 0.1), calls: Calls = Calls()) -> DataFrame:
    """replies: key, generated, gold, context_messages. Adds judge, embed, length, combined. A task asks the judge several questions at once."""
    first = gold_first(F.col("key"), seed)
    rows = replies.withColumns({"_answer": grade(M.judge_prompt(F.col("context_messages"), F.col("generated"), F.col("gold"), first), judge, calls), "_is": F.when(first, "A").otherwise("B"), "_a": embed(F.col("generated"), embedder), "_b": embed(F.col("gold"), embedder)})
    rows = rows.withColumns({"judge": S.judge_score(S.parse_choice(F.col("_answer")), F.col("_is")), "embed": F.coalesce(S.clip(S.cosine(F.col("_a"), F.col("_b"))), F.lit(0.0)), "length": S.length_score(F.col("generated"), F.col("gold"))})
    return rows.withColumn("combined", S.combined_score(F.col("judge"), F.col("embed"), F.col("length"), weights)).drop("_answer", "_is", "_a", "_b")


def generate(rendered: DataFrame, models: dict[str, Ask], model: str, calls: Calls = Calls()) -> DataFrame:
    """rendered with reply from the model whose name begins with one of the given prefixes; no match is an error."""
    make = next((m for p, m in models.items() if model.startswith(p)), None)
    if make is None:
        raise ValueError(f"no backend for model {model!r}")
    return rendered.withColumn("reply", F.trim(grade(M.command_text(F.col("messages"), F.lit("")), make, calls)))
