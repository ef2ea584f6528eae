"""Prompts within a token budget, and token arrays with the prompt masked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.config import DEFAULT, TRUNCATION_MARK, Settings
from loomline.functions import messages as M
from loomline.functions.tokens import Maker, encode, left_truncate, message_tokens, token_counts
from loomline.operators.samples import require_support, sample_key


def kept_suffix(costs: Column, budget: Column) -> Column:
    """How many of the last items fit: the longest suffix whose costs add up to the budget at most."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("sum"), F.lit(True).alias("open"))

    def step(acc: Column, cost: Column) -> Column:
        total = acc["sum"] + cost
        fits = acc["open"] & (total <= budget)
        return F.struct(F.when(fits, acc["n"] + 1).otherwise(acc["n"]).alias("n"), F.when(fits, total).otherwise(acc["sum"]).alias("sum"), fits.alias("open"))

    return F.aggregate(F.reverse(costs), start, step, lambda acc: acc["n"])


def message_costs(messages: Column, make: Maker) -> Column:
    """Tokens of content and role, and four, of each message of an array. Contexts of samples needn't be counted so: see render()."""
    contents = token_counts(F.transform(messages, lambda m: m["content"]), make)
    roles = token_counts(F.transform(messages, lambda m: m["role"]), make)
    return F.zip_with(contents, roles, lambda a, b: a + b + 4)


def render(samples: DataFrame, prefix: Column, suffix: Column, make: Maker, most: int = DEFAULT.render_tokens) -> DataFrame:
    """samples with messages: the system prompt, then as many of the last turns as fit. The last turn stays; if it doesn't fit it loses its beginning.

    Samples that were built with a tokenizer bring context_tokens, the count of each message, made once for a turn however
    many contexts it stands in; else (samples read from a store) each context is counted here.
    """
    system = M.message("system", M.system_prompt(prefix, suffix, F.col("model"), F.col("harness"), F.col("cwd")))
    rows = samples.withColumn("_system", system)
    costs = F.col("context_tokens") if "context_tokens" in samples.columns else message_costs(F.col("context_messages"), make)
    rows = rows.withColumns({"_costs": costs, "_head": message_tokens(F.col("_system.role"), F.col("_system.content"), make)})
    n = kept_suffix(F.col("_costs"), most - F.col("_head") - 2)
    rows = rows.withColumn("_n", n)
    some = F.size("context_messages") > 0
    last = F.get("context_messages", F.size("context_messages") - 1)
    over = some & (F.col("_n") == 0)
    # the text goes to the tokenizer only where it has to be cut
    cut = left_truncate(F.when(over, last["content"]).otherwise(""), F.greatest(most - F.col("_head") - 6, F.lit(1)), make, TRUNCATION_MARK)
    rows = rows.withColumn("_cut", cut)
    tail = F.when(over, F.array(M.message(last["role"], F.col("_cut")))).otherwise(F.slice("context_messages", F.greatest(F.size("context_messages") - F.col("_n") + 1, F.lit(1)), F.col("_n")))
    return rows.withColumn("messages", F.concat(F.array("_system"), tail)).drop("_system", "_costs", "_head", "_n", "_cut", "context_tokens")


def optimizer_examples(rendered: DataFrame) -> DataFrame:
    """system, thread, reply (and sample_key if there): the first system message; all others leave the thread."""
    system = F.get(F.filter("messages", lambda m: m["role"] == "system"), 0)["content"]
    keep = [c for c in ("sample_key",) if c in rendered.columns]
    return rendered.select(*keep, F.coalesce(system, F.lit("")).alias("system"), M.thread_text(M.provider_turns(F.col("messages"))).alias("thread"), F.col("target").alias("reply"))


def build_examples(samples: DataFrame, prefix: Column, suffix: Column, tag: str, make: Maker, project: str | None = None, s: Settings = DEFAULT) -> DataFrame:
    """Keyed examples for a prompt optimizer: of one project, which needs enough samples, or of all. example_contexts() finds the samples again."""
    rows = require_support(samples, project, s) if project else samples
    return optimizer_examples(render(sample_key(rows, tag), prefix, suffix, make, s.render_tokens))


def join_prompts(samples: DataFrame, prefix: str, suffixes: DataFrame) -> DataFrame:
    """samples with prefix, and suffix of their project (null if there is none). suffixes: project, suffix."""
    return samples.join(suffixes.select("project", "suffix"), "project", "left").withColumn("prefix", F.lit(prefix))


def example_contexts(predictions: DataFrame, samples: DataFrame) -> DataFrame:
    """predictions with their sample's messages by sample_key; an unknown key has none."""
    rows = predictions.join(samples.select("sample_key", "context_messages"), "sample_key", "left")
    return rows.withColumn("context_messages", F.coalesce("context_messages", F.array().cast(samples.schema["context_messages"].dataType)))


def mask_tokens(prompt_ids: Column, target_ids: Column, eos: int, pad: int, most: int, s: Settings = DEFAULT) -> Column:
    """struct(input_ids, attention_mask, labels), each of `most` items; null if the target leaves the prompt too few. The prompt keeps its end; labels are -100 on prompt and padding."""
    target = F.concat(target_ids, F.array(F.lit(eos)))
    room = F.lit(most) - F.size(target)
    prompt = F.slice(prompt_ids, F.greatest(F.size(prompt_ids) - room + 1, F.lit(1)), F.greatest(room, F.lit(0)))
    pads = F.lit(most) - F.size(prompt) - F.size(target)
    return F.when(
        room >= s.least_prompt_tokens,
        F.struct(
            F.concat(prompt, target, F.array_repeat(F.lit(pad), pads)).alias("input_ids"),
            F.concat(F.array_repeat(F.lit(1), F.size(prompt) + F.size(target)), F.array_repeat(F.lit(0), pads)).alias("attention_mask"),
            F.concat(F.array_repeat(F.lit(-100), F.size(prompt)), target, F.array_repeat(F.lit(-100), pads)).alias("labels"),
        ),
    )


def chat_text(messages: Column) -> Column:
    """A plain chat template that ends where the assistant's turn begins."""
    turns = F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"], F.lit("\n"))), "")
    return F.concat(turns, F.lit("<|assistant|>\n"))


def token_rows(rows: DataFrame, make: Maker, eos: int, pad: int, most: int, s: Settings = DEFAULT) -> DataFrame:
    """rows (as from training_rows) with input_ids, attention_mask, labels; those with too long a target are left out."""
    ids = rows.withColumn("_ids", encode(make, prompt=chat_text(F.col("messages")), target=F.col("target")))
    ids = ids.withColumn("_m", mask_tokens(F.col("_ids.prompt"), F.col("_ids.target"), eos, pad, most, s)).filter("_m is not null")
    return ids.select(*rows.columns, "_m.*")
