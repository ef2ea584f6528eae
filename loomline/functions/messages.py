"""Message arrays (role, content) as text, and the lines that go before them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomline.config import DEFAULT, Settings


def message(role: Column | str, content: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"))


def log_line(model: Column, harness: Column, cwd: Column) -> Column:
    return F.concat(F.lit("This is a log from model "), model, F.lit(" in harness "), harness, F.lit(", cwd "), cwd, F.lit(". Respond as the user."))


def system_prompt(prefix: Column, suffix: Column, model: Column, harness: Column, cwd: Column) -> Column:
    """Prefix, suffix (if not null: an empty one counts) and the log line, between blank lines."""
    return F.concat(prefix, F.when(suffix.isNotNull(), F.concat(F.lit("\n\n"), suffix)).otherwise(""), F.lit("\n\n"), log_line(model, harness, cwd))


def trainer_prompt(model: Column, harness: Column, cwd: Column) -> Column:
    return F.concat(log_line(model, harness, cwd), F.lit("\nOutput exactly two lines:\nCAN_AUTO_RESPOND: <0-100>%\nAUTO_RESPONSE: <reply>"))


def wrap_target(target: Column, score: Column) -> Column:
    return F.concat(F.lit("CAN_AUTO_RESPOND: "), score.cast("string"), F.lit("%\nAUTO_RESPONSE: "), target)


def coerce_role(role: Column) -> Column:
    return F.when(role.isin("system", "user", "assistant"), role).otherwise("user")


def recent(messages: Column, n: int) -> Column:
    """The last n; slice() counts from 1."""
    return F.slice(messages, F.greatest(F.size(messages) - (n - 1), F.lit(1)), F.lit(n))


def labeler_text(messages: Column, s: Settings = DEFAULT) -> Column:
    """The last turns, a line each; long ones as two thirds of head and one of tail."""
    head = s.labeler_chars * 2 // 3

    def line(m: Column) -> Column:
        c = m["content"]
        cut = F.concat(F.substring(c, 1, head), F.lit("\n…[truncated]…\n"), F.right(c, F.lit(s.labeler_chars - head)))
        return F.concat(m["role"], F.lit(": "), F.when(F.length(c) > s.labeler_chars, cut).otherwise(c))

    return F.array_join(F.transform(recent(messages, s.labeler_turns), line), "\n")


def judge_context(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("["), m["role"], F.lit("]\n"), m["content"])), "\n\n")


def thread_text(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("["), F.upper(m["role"]), F.lit("]: "), m["content"])), "\n\n")


def command_text(messages: Column, prompt: Column) -> Column:
    """For a command-line model; without messages the bare prompt."""
    text = F.array_join(F.transform(messages, lambda m: F.concat(F.lit("["), F.upper(m["role"]), F.lit("]\n"), m["content"])), "\n\n")
    return F.when(F.coalesce(F.size(messages), F.lit(0)) > 0, text).otherwise(F.coalesce(prompt, F.lit("")))


def judge_prompt(messages: Column, generated: Column, gold: Column, gold_first: Column) -> Column:
    """Both replies under A and B; gold_first puts the author's under A."""
    a, b = F.when(gold_first, gold).otherwise(generated), F.when(gold_first, generated).otherwise(gold)
    return F.concat(
        F.lit("Given this conversation thread:\n\n"), judge_context(messages), F.lit("\n\nWhich reply is more in the style of the original author?\nA) "), a, F.lit("\nB) "), b, F.lit("\nAnswer only A or B.")
    )


def last_visible(messages: Column, most: int = 400) -> Column:
    """The last user or assistant message, cut at `most` characters; null if there is none."""
    shown = F.filter(messages, lambda m: m["role"].isin("user", "assistant"))
    text = F.get(shown, F.size(shown) - 1)["content"]
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def provider_system(messages: Column, first: bool = False) -> Column:
    """The system text for providers that take it apart: the last system message, so one in the context replaces the prompt; first=True takes the prompt."""
    found = F.filter(messages, lambda m: m["role"] == "system")
    return F.coalesce(F.get(found, F.lit(0) if first else F.size(found) - 1)["content"], F.lit(""))


def provider_turns(messages: Column) -> Column:
    return F.filter(messages, lambda m: m["role"] != "system")


def strip_prefix(full: Column, prefix: Column) -> Column:
    """What follows the prefix, without leading newlines; all of it if it doesn't begin so."""
    return F.when(F.startswith(full, prefix), F.regexp_replace(F.substr(full, F.length(prefix) + 1), r"\A\n+", "")).otherwise(full)
