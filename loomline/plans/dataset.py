"""The whole way from session logs to samples on disk, and from samples to labels and training rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from loomline.config import DEFAULT, Settings
from loomline.operators import labels as L
from loomline.operators.calls import Ask, Budget, Calls, keep_answers
from loomline.operators.samples import Samples, load_samples
from loomline.operators.stats import loader_stats
from loomline.sources import jsonl
from loomline.sources.label_store import LabelStore
from loomline.sources.scratch import cut, delete, names
from loomline.sources.transcripts import load_a, load_b, load_c, union


def build_dataset(spark: SparkSession, roots: dict[str, str], out: str | None = None, since: str | None = None, s: Settings = DEFAULT) -> tuple[Samples, DataFrame]:
    """roots: folder of each dialect a, b, c. Returns the samples and their statistics; writes train and val if `out` is given."""
    loaders = {"a": load_a, "b": lambda sp, root: load_b(sp, root, s), "c": load_c}
    made = load_samples(union(*(loaders[k](spark, root) for k, root in roots.items())), since, s)
    if out:
        jsonl.write_samples(made.samples, out)
    return made, loader_stats(made)


def label_dataset(
    spark: SparkSession, paths: list[str], store: str, ask: Ask | None = None, name: str = "", limit: int | None = None, s: Settings = DEFAULT,
    read: Callable[[Column], Column] = lambda x: x, calls: Calls = Calls(), tasks: int | None = None, per_second: float | None = None, budget: Budget | None = None, buckets: int = 64,
) -> DataFrame:
    """Adds the labels that the store lacks: the heuristic zones, then the middle one if there is a grader. Returns the zones' histogram.

    Answers are kept beside the store as they come (calls.keep_answers) and become labels at the end. Those that an
    earlier run left when it broke off, or was stopped by its budget, do so first: what was paid for isn't asked again.
    The questions are written once, so samples and contexts are not read again for each task.
    """
    samples, labels = L.keyed(jsonl.read_samples(spark, paths), s), LabelStore(spark, store, buckets)
    labels.add(L.heuristic_labels(samples, s))
    kept = f"{store.rstrip('/')}/_answers"

    def settle() -> None:
        """Kept answers become labels; then they go."""
        if any(n.startswith("a-") for n in names(spark, kept)):
            answers = spark.read.schema("key string, answer string, target_len int, thread_id string").json(f"{kept}/a-*")
            labels.add(L.answered_labels(answers.dropDuplicates(["key"]), name, read))
            delete(spark, kept)

    settle()
    if ask:
        asked = cut(L.questions(samples, labels.read(), limit, s=s))
        try:
            keep_answers(asked, kept, ask, calls, tasks, per_second, budget)
        finally:
            settle()
    return L.zone_histogram(samples)


def training_dataset(spark: SparkSession, paths: list[str], store: str, s: Settings = DEFAULT) -> DataFrame:
    return L.training_rows(jsonl.read_samples(spark, paths), LabelStore(spark, store).read(), s)
