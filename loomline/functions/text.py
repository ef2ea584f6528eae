"""Text columns: Unicode trimming, redaction, size caps, turn rendering and the tests that filters use."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomline.config import DEFAULT, HIDDEN_TAGS, HOOK_PREFIXES, REDACTED, SECRET_PATTERNS, WORKER_SLUG_MARK, WORKTREE, Settings

#: All that Python's str.strip() takes for white space; Java's \s under (?U) lacks U+001C to U+001F.
SPACE = r"[\s\x1c-\x1f\x85]"


def strip(text: Column) -> Column:
    return F.regexp_replace(lstrip(text), f"(?U){SPACE}+\\z", "")


def lstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"(?U)\\A{SPACE}+", "")


def word_count(text: Column) -> Column:
    """Words between white space; null for null."""
    bare = strip(text)
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, f"(?U){SPACE}+")))


def redact(text: Column) -> Column:
    """Secrets replaced, pattern after pattern."""
    return reduce(lambda c, p: F.regexp_replace(c, p, REDACTED), SECRET_PATTERNS, text)


def cap_message(text: Column, s: Settings = DEFAULT) -> Column:
    """The head and tail of a text that is too long, and how many characters lie between."""
    cut = F.concat(F.substring(text, 1, s.message_head), F.format_string("\n…[TRUNCATED %d chars]…\n", F.length(text) - (s.message_head + s.message_tail)), F.right(text, F.lit(s.message_tail)))
    return F.when(F.length(text) <= s.message_chars, text).otherwise(cut)


def elide_tool_result(body: Column, s: Settings = DEFAULT) -> Column:
    """A short body redacted, a long one as its length (in characters, though it says bytes)."""
    return F.when(F.length(body) < s.tool_result_below, redact(body)).otherwise(F.format_string("[tool_result: %d bytes]", F.length(body)))


def render_role(kind: Column) -> Column:
    return F.when(kind.isin("user", "tool_result"), "user").when(kind.isin("assistant", "tool_call"), "assistant").when(kind == "system", "system")


def render_content(kind: Column, text: Column, tool_name: Column, tool_input: Column, s: Settings = DEFAULT) -> Column:
    """A turn as message text: plain turns redacted and capped, tool calls spelled out and capped, tool results elided."""
    call = F.concat(F.lit("[tool_use: "), F.coalesce(tool_name, F.lit("")), F.lit("("), redact(F.coalesce(tool_input, F.lit("{}"))), F.lit(")]"))
    return F.when(kind == "tool_call", cap_message(call, s)).when(kind == "tool_result", F.concat(F.lit("[tool_result] "), elide_tool_result(text, s))).otherwise(cap_message(redact(text), s))


def hidden_tag(text: Column) -> Column:
    """The first of the hidden-thread tags that the text opens with, or null."""
    text = F.coalesce(text, F.lit(""))
    return F.coalesce(*(F.when(text.rlike("(?U)" + p), F.lit(n)) for n, p in HIDDEN_TAGS))


def hook_injected(text: Column) -> Column:
    bare = lstrip(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a | b, (bare.startswith(p) for p in HOOK_PREFIXES))


def worker_cwd(cwd: Column, s: Settings = DEFAULT) -> Column:
    """At or below one of the excluded roots; false for null."""
    cwd = F.coalesce(cwd, F.lit(""))
    return reduce(lambda a, b: a | b, ((cwd == r) | cwd.startswith(r + "/") for r in s.worker_roots), F.lit(False))


def worker_worktree(cwd: Column) -> Column:
    return F.coalesce(cwd, F.lit("")).rlike(f"(?U){WORKTREE}(?:/|$)")


def worker_slug(slug: Column) -> Column:
    return F.contains(F.coalesce(slug, F.lit("")), F.lit(WORKER_SLUG_MARK))


def user_drop_reason(text: Column, cwd: Column, sidechain: Column | None = None, s: Settings = DEFAULT) -> Column:
    """Why a user turn is no target, in the order in which reasons are looked for; null if it is one."""
    text = F.coalesce(text, F.lit(""))
    return (
        F.when(F.coalesce(sidechain, F.lit(False)) if sidechain is not None else F.lit(False), "sidechain")
        .when(strip(text) == "", "too_short")
        .when(hook_injected(text), "hook_injected")
        .when(worker_cwd(cwd, s), "worker_cwd")
        .when(worker_worktree(cwd), "worker_worktree")
        .when(word_count(text) < s.least_words, "too_short")
    )
