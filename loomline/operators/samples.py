"""Samples: all that was said before a person's message, and that message.

All works on sessions (sources.transcripts.Logs): a row for each turn, with its thread's columns. One shuffle by
source_path serves the gates, the frame and the places of samples.
"""

from __future__ import annotations

import datetime as dt
import logging
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomline.config import DEFAULT, Settings
from loomline.functions import text as X
from loomline.functions.keys import split_side
from loomline.functions.slugs import project_slug
from loomline.functions.tokens import Maker, message_tokens
from loomline.sources.scratch import cut

log = logging.getLogger(__name__)
SAMPLE_COLUMNS = ("context_messages", "target", "project", "harness", "model", "cwd", "source_path", "thread_id", "split", "pos")


@dataclass
class Samples:
    """gated: sessions with project, thread_drop (null: kept by the gates), target and drop_reason (of user turns of kept threads; null: a sample). samples: one row for each of these."""

    gated: DataFrame
    samples: DataFrame

    @property
    def threads(self) -> DataFrame:
        return self.gated.filter("head").select("source_path", "thread_id", "harness", "model", "cwd", "started_at", "project", F.col("thread_drop").alias("drop_reason"))

    @property
    def turns(self) -> DataFrame:
        """drop_reason of user turns of kept threads."""
        return self.gated.filter("thread_drop is null and kind = 'user'").select("source_path", "pos", "drop_reason")


def parse_since(since: str | None) -> dt.datetime | None:
    """A date or time without a zone is UTC; a bad one is no cutoff."""
    if since is None:
        return None
    try:
        found = dt.datetime.fromisoformat(since)
    except ValueError:
        log.warning("the cutoff %r can't be read and is left out", since)
        return None
    return found if found.tzinfo else found.replace(tzinfo=dt.timezone.utc)


def started(text: Column) -> Column:
    """ISO time, without a zone UTC; null if it can't be read."""
    zoned = F.when(text.rlike(r"(?:Z|[+-]\d\d:?\d\d)$"), text).otherwise(F.concat(text, F.when(F.length(text) > 10, "Z").otherwise("T00:00:00Z")))
    return F.try_to_timestamp(zoned)


def before_cutoff(started_at: Column, since: dt.datetime | None) -> Column:
    """True only where both are known and the thread is older."""
    if since is None:
        return F.lit(False)
    return F.coalesce(started(started_at) < F.lit(since.astimezone(dt.timezone.utc).isoformat()).cast("timestamp"), F.lit(False))


def first_user_text(turns: DataFrame) -> DataFrame:
    """source_path, first_text: of the first user turn of any sort."""
    return turns.filter("kind = 'user'").groupBy("source_path").agg(F.min_by("text", "pos").alias("first_text"))


def thread_drop_reason(cwd: Column, slug: Column, source_path: Column, first_text: Column, old: Column, s: Settings = DEFAULT) -> Column:
    folder = F.get(F.split(source_path, "/"), F.size(F.split(source_path, "/")) - 2)
    return (
        F.when(old, "date")
        .when(X.worker_cwd(cwd, s) | X.worker_worktree(cwd), "cwd")
        .when(X.worker_slug(folder) | X.worker_slug(slug), "slug")
        .when(first_text.isNotNull(), X.hidden_tag(first_text))
    )


def sessions(turns: DataFrame, threads: DataFrame) -> DataFrame:
    """Turns and threads from elsewhere as sessions; a thread without turns has one row of kind null."""
    rows = threads.join(turns, "source_path", "left")
    return rows.withColumn("head", F.row_number().over(W.partitionBy("source_path").orderBy("pos")) == 1)


def gate(rows: DataFrame, since: dt.datetime | None = None, s: Settings = DEFAULT) -> DataFrame:
    """Sessions with project, thread_drop, target and drop_reason, see Samples."""
    whole = W.partitionBy("source_path").orderBy("pos").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    is_user = F.coalesce(F.col("kind") == "user", F.lit(False))
    rows = rows.withColumns({"_first": F.first(F.when(is_user, F.struct("text")), True).over(whole), "project": project_slug(F.coalesce("cwd", F.lit("")), s)})
    rows = rows.withColumn("thread_drop", thread_drop_reason(F.col("cwd"), F.col("project"), F.col("source_path"), F.when(F.col("_first").isNotNull(), F.coalesce("_first.text", F.lit(""))), before_cutoff(F.col("started_at"), since), s)).drop("_first")
    judged = is_user & F.col("thread_drop").isNull()
    rows = rows.withColumns({"target": F.when(judged, X.strip(X.redact(F.coalesce("text", F.lit(""))))), "drop_reason": F.when(judged, X.user_drop_reason(F.col("text"), F.col("cwd"), None, s))})
    late = F.when(F.col("target") == "", "empty_target").when(F.length("target") > s.target_chars, "too_long_target")
    return rows.withColumn("drop_reason", F.coalesce("drop_reason", late))


def framed(rows: DataFrame, wanted: Column, keep: list[str], s: Settings = DEFAULT, make: Maker | None = None) -> DataFrame:
    """`keep` and context_messages of the wanted turns: the last turns before each, rejected ones too, each rendered once.

    A thread is cut into blocks of four times as many turns as a context holds. A block is one array of messages, which
    begins with a context's length of the turns before it; the contexts are index ranges in it, cut as rows leave. So a
    turn is sent and kept 1.25 times on average, not once for each context, and a very long thread is many blocks.
    make: a tokenizer; each message is then counted, once, and context_tokens are the counts of its context.
    """
    most = s.context_turns
    size = 4 * most
    role, content = X.render_role(F.col("kind")), X.render_content(F.col("kind"), F.col("text"), F.col("tool_name"), F.col("tool_input"), s)
    rows = rows.select("source_path", "pos", role.alias("role"), content.alias("content"), F.when(F.coalesce(wanted, F.lit(False)), F.struct(*keep)).alias("kept"))
    if make:
        rows = rows.withColumn("tokens", message_tokens(F.col("role"), F.col("content"), make))
    own = F.floor(F.col("pos") / size)
    blocks = rows.withColumn("block", F.explode(F.when(F.col("pos") % size >= size - most, F.array(own, own + 1)).otherwise(F.array(own))))
    element = F.struct("pos", "role", "content", *["tokens"] * bool(make), F.when(F.col("block") == own, F.col("kept")).alias("kept"))
    blocks = blocks.groupBy("source_path", "block").agg(F.sort_array(F.collect_list(element)).alias("m"), F.count_if(F.col("block") == own).alias("_n")).filter("_n > 0")
    spots = F.filter(F.sequence(F.lit(0), F.size("m") - 1), lambda i: F.get("m", i)["kept"].isNotNull())

    def sample(i: Column) -> Column:
        before = F.slice("m", F.greatest(i - most + 1, F.lit(1)), F.least(i, F.lit(most)))
        context = F.transform(before, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
        counts = [F.transform(before, lambda x: x["tokens"]).alias("context_tokens")] if make else []
        return F.struct(F.get("m", i)["kept"].alias("kept"), context.alias("context_messages"), *counts)

    found = blocks.select(F.explode(F.transform(spots, sample)).alias("s"))
    return found.select("s.kept.*", "s.context_messages", *["s.context_tokens"] * bool(make))


def with_context(turns: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """source_path, pos and context_messages of each turn."""
    return framed(turns, F.lit(True), ["source_path", "pos"], s)


def build_samples(rows: DataFrame, since: dt.datetime | None = None, s: Settings = DEFAULT, make: Maker | None = None) -> Samples:
    """From sessions. make: a tokenizer, for context_tokens (what rendering.render counts by)."""
    gated = gate(rows, since, s)
    turns = gated.filter("thread_drop is null and kind is not null").withColumn("split", split_side(F.col("thread_id"), s))
    found = framed(turns, (F.col("kind") == "user") & F.col("drop_reason").isNull(), [c for c in SAMPLE_COLUMNS if c != "context_messages"], s, make)
    return Samples(gated, found.select(*SAMPLE_COLUMNS, *["context_tokens"] * bool(make)))


def load_samples(logs, since: str | None = None, s: Settings = DEFAULT, make: Maker | None = None) -> Samples:
    """From parsed logs (sources.transcripts.Logs)."""
    return build_samples(logs.sessions, parse_since(since), s, make)


def sample_key(samples: DataFrame, tag: str, ranges: int = 256, counts: DataFrame | None = None) -> DataFrame:
    """samples with sample_key: tag, thread and place in the order of (source_path, pos).

    counts: source_path and n, the number of each thread's samples, if they are known from less than the samples
    themselves (thread_counts of what build_samples gave). They are written once, a row for each thread. Threads are cut
    into ranges of source_path at the paths of some that hash lowest, so a range is a task's work, and only the totals of
    the ranges (at most `ranges`) are added up in one.
    """
    counts = cut(samples.groupBy("source_path").agg(F.count("*").alias("n")) if counts is None else counts)
    bounds = sorted(r[0] for r in counts.select("source_path").orderBy(F.xxhash64("source_path"), "source_path").limit(ranges - 1).collect())
    cuts = F.array(*map(F.lit, bounds)) if bounds else F.array().cast("array<string>")
    counts = counts.withColumn("range", F.size(F.filter(cuts, lambda b: b <= F.col("source_path"))))
    within, over = W.partitionBy("range").orderBy("source_path").rowsBetween(W.unboundedPreceding, -1), W.partitionBy(F.lit(0)).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    totals = counts.groupBy("range").agg(F.sum("n").alias("n")).select("range", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("base"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(within), F.lit(0))).join(F.broadcast(totals), "range").select("source_path", (F.col("base") + F.col("before")).alias("before"))
    place = F.row_number().over(W.partitionBy("source_path").orderBy("pos")) - 1
    return samples.withColumn("_place", place).join(before, "source_path").withColumn("sample_key", F.concat_ws(":", F.lit(tag), "thread_id", (F.col("before") + F.col("_place")).cast("string"))).drop("_place", "before")


def thread_counts(made: Samples) -> DataFrame:
    """Samples of each thread that has any, without the frame."""
    return made.turns.filter("drop_reason is null").groupBy("source_path").agg(F.count("*").alias("n"))


def supported_projects(samples: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    return samples.groupBy("project").count().filter(F.col("count") >= s.project_support)


def require_support(samples: DataFrame, project: str, s: Settings = DEFAULT) -> DataFrame:
    """The project's samples; too few are an error."""
    own = samples.filter(F.col("project") == project)
    if (n := own.limit(s.project_support).count()) < s.project_support:
        raise ValueError(f"project {project!r} has {n} samples; {s.project_support} are needed")
    return own
