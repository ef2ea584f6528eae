"""Counts of what was loaded and dropped, the corpus report, and costs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.config import DEFAULT, OTHER_PRICE, PRICES, Settings
from loomline.functions.keys import split_side
from loomline.operators.calls import BudgetExceeded
from loomline.operators.samples import Samples

THREAD_REASONS = ("date", "cwd", "slug", "hide_test", "ai_writing", "worker")
#: sidechain, worker_cwd, worker_worktree, worker_slug and tool_result_user can't occur after parsing and the thread gate; they stay in the report as zeros.
TURN_REASONS = ("hook_injected", "too_short", "too_long_target", "sidechain", "worker_cwd", "worker_worktree", "worker_slug", "tool_result_user")


def loader_stats(made: Samples, s: Settings = DEFAULT) -> DataFrame:
    """One row: threads seen and kept (with a sample), dropped by reason; samples by side; turns dropped by reason, and their total.

    One scan: what the gates said is counted by thread, and all threads are added up once; no frame of turns is built.
    """
    judged = F.col("thread_drop").isNull() & (F.col("kind") == "user")
    reason = lambda r: F.count_if(judged & (F.col("drop_reason") == r)).alias(f"turns_{r}")
    head = F.max(F.when(F.col("head"), F.struct(F.col("thread_drop").alias("drop_reason"), split_side(F.col("thread_id"), s).alias("side")))).alias("t")
    rows = made.gated.groupBy("source_path").agg(head, F.count_if(judged & F.col("drop_reason").isNull()).alias("samples"), *map(reason, TURN_REASONS)).select("*", "t.drop_reason", "t.side")
    total = lambda x: F.coalesce(F.sum(x), F.lit(0))
    sides = (total(F.when(F.col("side") == side, F.col("samples"))).alias(side) for side in ("train", "val"))
    out = rows.agg(
        F.count("*").alias("threads_seen"), *(F.count_if(F.col("drop_reason") == r).alias(f"threads_{r}") for r in THREAD_REASONS),
        total("samples").alias("samples"), *sides, F.count_if(F.col("samples") > 0).alias("threads_kept"), *(total(f"turns_{r}").alias(f"turns_{r}") for r in TURN_REASONS),
    )
    drops = reduce(lambda a, b: a + b, (F.col(f"threads_{r}") for r in THREAD_REASONS[3:]), F.lit(0)) + reduce(lambda a, b: a + b, (F.col(f"turns_{r}") for r in TURN_REASONS))
    return out.withColumn("drops_total", drops)


def percent(n: Column, total: Column) -> Column:
    return F.when(total > 0, F.format_string("%5.1f%%", F.bround(100 * n / total, 1))).otherwise("n/a")


def corpus_report(stats: DataFrame) -> DataFrame:
    """loader_stats as rows: section, label, n, share."""
    seen = F.col("threads_seen")
    candidates = F.col("samples") + F.col("turns_too_short") + F.col("turns_too_long_target") + F.col("turns_hook_injected")
    hidden = F.col("threads_hide_test") + F.col("threads_ai_writing") + F.col("threads_worker")
    lines = [
        ("all", "threads seen", seen, seen), ("all", "threads kept", F.col("threads_kept"), seen), ("all", "samples", F.col("samples"), candidates), ("all", "train", F.col("train"), F.col("samples")), ("all", "val", F.col("val"), F.col("samples")),
        *(("threads", r, F.col(f"threads_{r}"), seen) for r in THREAD_REASONS), ("threads", "hidden", hidden, seen),
        *(("turns", r, F.col(f"turns_{r}"), candidates) for r in ("too_long_target", "too_short", "hook_injected")),
    ]
    rows = F.array(*(F.struct(F.lit(s).alias("section"), F.lit(k).alias("label"), n.alias("n"), percent(n, t).alias("share")) for s, k, n, t in lines))
    return stats.select(F.inline(rows))


def price_table(spark) -> DataFrame:
    return spark.createDataFrame(list(PRICES), "model string, price_in double, price_out double")


def costs(usage: DataFrame, prices: DataFrame, **more: Column) -> DataFrame:
    """usage: model, prompt_tokens, completion_tokens, any number of rows. One row a model with usd; a model without a price costs OTHER_PRICE.

    more: further aggregates of a model's rows, taken in the same pass: a second one would make the calls again that gave the rows.
    """
    sums = usage.groupBy("model").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), *(a.alias(name) for name, a in more.items()))
    usd = (F.col("prompt_tokens") * F.coalesce("price_in", F.lit(OTHER_PRICE[0])) + F.col("completion_tokens") * F.coalesce("price_out", F.lit(OTHER_PRICE[1]))) / 1_000_000
    return sums.join(prices, "model", "left").select("model", "prompt_tokens", "completion_tokens", usd.alias("usd"), *more)


def check_budget(usage: DataFrame, prices: DataFrame, most_usd: float) -> float:
    spent = costs(usage, prices).agg(F.coalesce(F.sum("usd"), F.lit(0.0))).first()[0]
    if spent > most_usd:
        raise BudgetExceeded(f"${spent:.2f} > ${most_usd:.2f}")
    return spent


def last_usage(lines: DataFrame) -> DataFrame:
    """Token usage of each call: of its last line that is a JSON object of type turn.completed, else zeros. lines: call, line_no, value."""
    u = F.from_json("value", "type string, usage struct<input_tokens long, output_tokens long>")
    done = F.when(u["type"] == "turn.completed", F.struct("line_no", F.coalesce(u["usage"]["input_tokens"], F.lit(0)).alias("i"), F.coalesce(u["usage"]["output_tokens"], F.lit(0)).alias("o")))
    last = lines.groupBy("call").agg(F.max(done).alias("d"))
    return last.select("call", F.coalesce("d.i", F.lit(0)).alias("prompt_tokens"), F.coalesce("d.o", F.lit(0)).alias("completion_tokens"))
