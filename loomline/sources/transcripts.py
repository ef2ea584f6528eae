"""Session logs in JSON Lines, in three dialects, as one table of sessions: a row for each turn, with its thread's columns.

A file is one thread. Its records meet in one shuffle and are folded in order, in one pass: the head (thread_id, model,
cwd, started_at), the running model, the places of turns and their number all come from one window. Malformed lines are
skipped; lines that are JSON but no objects are counted (n_rejected) and set aside in `rejected`, and the file is read on.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.config import DEFAULT, PREAMBLE_MARK, SKIPPED_RECORDS, Settings
from loomline.functions.text import lstrip

TURN = "struct<kind:string,text:string,turn_model:string,source_uuid:string,tool_name:string,tool_input:string,call_id:string,is_error:boolean,as_json:boolean>"
TURN_COLUMNS = ("kind", "text", "turn_model", "source_uuid", "tool_name", "tool_input", "call_id", "is_error")


#: Columns of the turn of a session's row; kind is user, assistant, tool_call, tool_result or system, tool_input is JSON.
TURN_OUT = ("source_path", "pos", *TURN_COLUMNS)
THREAD_OUT = ("source_path", "thread_id", "harness", "model", "cwd", "started_at", "n_turns", "n_rejected")


@dataclass
class Logs:
    """sessions: the columns of THREAD_OUT and TURN_OUT, and head, which marks one row of each thread. A thread without turns has that row alone, of kind null."""

    sessions: DataFrame
    rejected: DataFrame

    @property
    def turns(self) -> DataFrame:
        return self.sessions.filter("kind is not null").select(*TURN_OUT)

    @property
    def threads(self) -> DataFrame:
        return self.sessions.filter("head").select(*THREAD_OUT)


@F.pandas_udf(T.StringType())
def spaced_json(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """JSON text with its keys in order and one space after commas and colons; null stays null."""
    for texts in batches:
        yield pd.Series([None if t is None else json.dumps(json.loads(t), ensure_ascii=False) for t in texts], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _all_spaced(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """spaced_json of each item of a list; a null list, as most are, stays null."""
    for lists in batches:
        yield pd.Series([None if ts is None else [None if t is None else json.dumps(json.loads(t), ensure_ascii=False) for t in ts] for ts in lists], dtype=object)


def _plain(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:").rstrip("/")


def plain_path(uri: Column) -> Column:
    """The path of a file as written, from its URI."""
    return F.url_decode(F.replace(F.regexp_replace(uri, "^file:(?://)?", ""), F.lit("+"), F.lit("%2B")))


def read_records(spark: SparkSession, root: str, pattern: str, wanted: Callable[[Column], Column] | None = None) -> DataFrame:
    """The JSON lines of all files: source_path, block, line, value, v. Order within a file is (block, line), taken in the scan, before any shuffle.

    wanted: of a file's path, whether to read it. It stands right on the scan and looks at nothing but the path, so
    Spark leaves files out as it lists them and never opens them.
    """
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True)
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        lines = reader.text(root)
        lines = lines.filter(wanted(plain_path(F.col("_metadata.file_path")))) if wanted else lines
        lines = lines.select(F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), F.expr("make_valid_utf8(value)").alias("value"))
    else:
        lines = spark.createDataFrame([], "uri string, block long, line long, value string")
    return parsed(lines.select(plain_path(F.col("uri")).alias("source_path"), "block", "line", "value"))


def parsed(lines: DataFrame) -> DataFrame:
    """The lines that are JSON, with it as v. It comes out of a generator, so that no filter on it is moved before it and parses the line again."""
    return lines.select("*", F.explode(F.array(F.try_parse_json("value"))).alias("v")).filter("v is not null")


#: Of a line that is JSON, by its first character: naming the schema of a whole record would cost more than parsing it.
_IS_OBJECT = r"value rlike '^\\s*\\{'"


def rejected_lines(records: DataFrame) -> DataFrame:
    return records.filter(f"not {_IS_OBJECT}").select("source_path", "block", "line", "value", F.lit("not an object").alias("reason"))


def _text(path: str, of: str = "v") -> Column:
    return F.expr(f"try_variant_get({of}, '{path}', 'string')")


def _kind(path: str, of: str = "v") -> Column:
    """STRING, VOID, BOOLEAN, ARRAY<...>, OBJECT<...> and so on; null if absent."""
    return F.expr(f"schema_of_variant(try_variant_get({of}, '{path}', 'variant'))")


def _truthy(x: Column) -> Column:
    return x.isNotNull() & ~x.isin("", "false", "0", "0.0", "[]", "{}")


def _turn(kind: str, text: Column | None = None, **more: Column) -> Column:
    values = {"kind": F.lit(kind), "text": text} | more
    return F.struct(*(values.get(c, F.lit(None)).alias(c) if values.get(c) is not None else F.lit(None).alias(c) for c in (*TURN_COLUMNS, "as_json"))).cast(TURN)


def _no_turns() -> Column:
    return F.array().cast(f"array<{TURN}>")


def latest(x: Column, order: Column, first: bool = False) -> Column:
    """The last (or first) value that is not null or empty."""
    found = F.when(F.coalesce(x, F.lit("")) != "", F.struct(order.alias("o"), x.alias("x")))
    return (F.min(found) if first else F.max(found))["x"]


_RESULT_BODY = """
    case when schema_of_variant(try_variant_get(x.b, '$.content', 'variant')) is null then ''
         when try_variant_get(x.b, '$.content', 'array<variant>') is not null then array_join(transform(try_variant_get(x.b, '$.content', 'array<variant>'),
              y -> case when schema_of_variant(y) like 'OBJECT%' then coalesce(try_variant_get(y, '$.text', 'string'), '')
                        when schema_of_variant(y) = 'VOID' then 'None'
                        when schema_of_variant(y) = 'BOOLEAN' then initcap(try_variant_get(y, '$', 'string'))
                        else try_variant_get(y, '$', 'string') end), '\\n')
         when schema_of_variant(try_variant_get(x.b, '$.content', 'variant')) = 'STRING' then try_variant_get(x.b, '$.content', 'string')
         else coalesce(x.raw.content, 'null') end"""
_BODY_IS_JSON = """
    schema_of_variant(try_variant_get(x.b, '$.content', 'variant')) is not null and try_variant_get(x.b, '$.content', 'array<variant>') is null
    and schema_of_variant(try_variant_get(x.b, '$.content', 'variant')) <> 'STRING'"""


def _blocks() -> Column:
    """The texts, tool calls and tool results among a message's content blocks. raw: the same block with its JSON as written, as variants sort keys."""
    return F.expr("""
        filter(transform(try_variant_get(v, '$.message.content', 'array<variant>'), (b, i) -> named_struct('type', try_variant_get(b, '$.type', 'string'), 'b', b, 'raw', from_json(get(texts, i), 'input string, content string'))),
               x -> x.type in ('text', 'tool_use', 'tool_result'))""").alias("blocks")


def parse_a(records: DataFrame) -> DataFrame:
    """Turns and head of each record of dialect A: source_path, block, line, turns, saw, cwd, session, started, model, rejected."""
    rows = records.withColumn("type", _text("$.type")).filter(F.coalesce(~F.col("type").isin(*SKIPPED_RECORDS), F.lit(True)) & ~_truthy(_text("$.isSidechain")))
    # blocks as written are needed for tools alone; their names are in the line as they are, or with escapes
    tools = F.expr("contains(value, 'tool_use') or contains(value, 'tool_result') or contains(value, '\\\\u')")
    rows = rows.withColumn("texts", F.when(tools, F.expr("from_json(value, 'message struct<content array<string>>').message.content"))).withColumn("blocks", _blocks())
    content_kind = F.when(F.col("blocks").isNull(), _kind("$.message.content"))
    rows = rows.withColumns({"content_kind": content_kind, "uuid": _text("$.uuid"), "own_model": F.when(F.col("type") == "assistant", F.nullif(_text("$.message.model"), F.lit("")))})
    rows = rows.withColumn("parts", F.expr(f"""
        transform(blocks, x -> named_struct('type', x.type, 'text', case when x.type = 'text' then coalesce(try_variant_get(x.b, '$.text', 'string'), '') end,
            'name', case when x.type = 'tool_use' then coalesce(try_variant_get(x.b, '$.name', 'string'), '') end, 'id', case when x.type = 'tool_use' then try_variant_get(x.b, '$.id', 'string') end, 'input', x.raw.input,
            'for_id', case when x.type = 'tool_result' then try_variant_get(x.b, '$.tool_use_id', 'string') end, 'error', case when x.type = 'tool_result' then try_variant_get(x.b, '$.is_error', 'string') end,
            'as_json', x.type = 'tool_result' and {_BODY_IS_JSON}, 'body', case when x.type = 'tool_result' then {_RESULT_BODY} end))"""))
    texts = F.transform(F.filter("parts", lambda p: p["type"] == "text"), lambda p: p["text"])
    results = F.transform(F.filter("parts", lambda p: p["type"] == "tool_result"), lambda p: _turn("tool_result", p["body"], call_id=p["for_id"], is_error=_truthy(p["error"]), as_json=p["as_json"]))
    said = F.when(F.size(texts) > 0, F.array(_turn("user", F.array_join(texts, "\n"), source_uuid=F.col("uuid")))).otherwise(_no_turns())
    user = F.when(F.col("content_kind") == "STRING", F.array(_turn("user", _text("$.message.content"), source_uuid=F.col("uuid")))).when(F.col("parts").isNotNull(), F.concat(said, results)).otherwise(_no_turns())

    def flush(held: Column) -> Column:
        return F.when(F.size(held) > 0, F.array(_turn("assistant", F.array_join(held, "\n"), turn_model=F.col("own_model")))).otherwise(_no_turns())

    def step(acc: Column, p: Column) -> Column:
        call = F.array(_turn("tool_call", tool_name=p["name"], tool_input=F.when(_truthy(p["input"]), p["input"]).otherwise("{}"), call_id=p["id"]))
        none = F.array().cast("array<string>")
        return (
            F.when(p["type"] == "text", F.struct(acc["out"].alias("out"), F.concat(acc["held"], F.array(p["text"])).alias("held")))
            .when(p["type"] == "tool_use", F.struct(F.concat(acc["out"], flush(acc["held"]), call).alias("out"), none.alias("held")))
            .otherwise(acc)
        )

    start = F.struct(_no_turns().alias("out"), F.array().cast("array<string>").alias("held"))
    answered = F.aggregate(F.coalesce("parts", F.array().cast(rows.schema["parts"].dataType)), start, step, lambda acc: F.concat(acc["out"], flush(acc["held"])))
    system = F.when(_kind("$.content") == "STRING", F.array(_turn("system", _text("$.content")))).otherwise(_no_turns())
    turns = F.when(F.col("type") == "user", user).when(F.col("type") == "assistant", answered).when(F.col("type") == "system", system).otherwise(_no_turns())
    rows = rows.withColumn("turns", turns)
    saw = (F.col("type") == "assistant") | ((F.col("type") == "user") & (F.size("turns") > 0))
    return rows.select("source_path", "block", "line", "turns", F.coalesce(saw, F.lit(False)).alias("saw"), _text("$.cwd").alias("cwd"), _text("$.sessionId").alias("session"), _text("$.timestamp").alias("started"), F.col("own_model").alias("model"), F.expr(f"not {_IS_OBJECT}").alias("rejected"))


def parse_b(records: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """The same for dialect B, whose heads come from session_meta records alone; leading instruction preambles are gone."""
    rows = records.withColumn("type", _text("$.type")).withColumn("ptype", _text("$.payload.type")).withColumn("raw", F.expr("from_json(value, 'payload struct<arguments string, output string>').payload"))
    meta = F.col("type") == "session_meta"
    flat = F.expr("""
        case when schema_of_variant(try_variant_get(v, '$.payload.content', 'variant')) = 'STRING' then try_variant_get(v, '$.payload.content', 'string')
             else coalesce(array_join(transform(filter(try_variant_get(v, '$.payload.content', 'array<variant>'), x -> schema_of_variant(x) like 'OBJECT%' and
                (try_variant_get(x, '$.type', 'string') in ('input_text', 'output_text') or schema_of_variant(try_variant_get(x, '$.text', 'variant')) is not null)),
                x -> coalesce(try_variant_get(x, '$.text', 'string'), '')), '\\n'), '') end""")
    args_kind, args = _kind("$.payload.arguments"), F.col("raw.arguments")
    inner = F.expr("schema_of_variant(try_parse_json(raw.arguments))")
    given = (
        F.when(args_kind == "STRING", F.when(inner.like("OBJECT%"), args).when(inner.isNotNull(), F.concat(F.lit('{"_raw":'), args, F.lit("}"))).otherwise(F.to_json(F.struct(args.alias("_raw")))))
        .when(args_kind.like("OBJECT%"), args)
        .when(_truthy(args) & (args_kind != "VOID"), F.concat(F.lit('{"_raw":'), args, F.lit("}")))
        .otherwise("{}")
    )
    out_kind = _kind("$.payload.output")
    output = F.when(out_kind.isNull(), "").when(out_kind == "STRING", _text("$.payload.output")).otherwise(F.coalesce("raw.output", F.lit("null")))
    role, item = _text("$.payload.role"), F.col("type") == "response_item"
    turns = (
        F.when(item & (F.col("ptype") == "message") & (role == "developer"), F.array(_turn("system", F.col("flat"))))
        .when(item & (F.col("ptype") == "message") & (role == "user"), F.array(_turn("user", F.col("flat"))))
        .when(item & (F.col("ptype") == "message") & (role == "assistant"), F.array(_turn("assistant", F.col("flat"))))
        .when(item & F.col("ptype").isin("function_call", "custom_tool_call"), F.array(_turn("tool_call", tool_name=F.coalesce(_text("$.payload.name"), F.lit("")), tool_input=given, call_id=_text("$.payload.call_id"))))
        .when(item & F.col("ptype").isin("function_call_output", "custom_tool_call_output"), F.array(_turn("tool_result", output, call_id=_text("$.payload.call_id"), is_error=F.lit(False), as_json=out_kind.isNotNull() & (out_kind != "STRING"))))
        .otherwise(_no_turns())
    )
    rows = rows.withColumn("flat", flat).withColumn("turns", turns)
    text = F.get("turns", 0)["text"]
    is_user = F.get("turns", 0)["kind"] == "user"
    order = F.struct("block", "line")
    first_real = F.min(F.when(is_user & ~preamble(text, s), order)).over(W.partitionBy("source_path"))
    rows = rows.withColumn("real", first_real).filter(~(F.coalesce(is_user, F.lit(False)) & preamble(text, s) & F.coalesce(order < F.col("real"), F.lit(True))))
    head = lambda p: F.when(meta, _text(f"$.payload.{p}"))
    return rows.select("source_path", "block", "line", "turns", (F.size("turns") > 0).alias("saw"), head("cwd").alias("cwd"), head("id").alias("session"), head("timestamp").alias("started"), head("model").alias("model"), F.expr(f"not {_IS_OBJECT}").alias("rejected"))


def preamble(text: Column, s: Settings = DEFAULT) -> Column:
    """Whether a user message before the first real one is machine-made: it opens with the mark, or is very long. An empty one is real."""
    return F.coalesce((text != "") & (lstrip(text).startswith(PREAMBLE_MARK) | (F.length(text) > s.preamble_chars)), F.lit(False))


def fold(rows: DataFrame, harness: str, first_start: bool) -> DataFrame:
    """Sessions of parsed records (as from parse_a, parse_b): one shuffle by file, one sort, one window.

    Python respaces JSON before the shuffle, as Spark takes rows that come from it for dealt at random.
    """
    has_json = lambda t: t["tool_input"].isNotNull() | F.coalesce(t["as_json"], F.lit(False))
    raw = F.transform("turns", lambda t: F.when(has_json(t), F.coalesce(t["tool_input"], t["text"])))
    rows = rows.withColumn("_json", _all_spaced(F.when(F.exists("turns", has_json), raw)))
    w = W.partitionBy("source_path").orderBy("block", "line")
    whole, upto, before = (w.rowsBetween(W.unboundedPreceding, end) for end in (W.unboundedFollowing, W.currentRow, -1))
    last = lambda c: F.last(F.nullif(F.col(c), F.lit("")), True).over(whole)
    started = F.first(F.nullif(F.col("started"), F.lit("")), True).over(whole) if first_start else last("started")
    n = F.size("turns")
    folded = rows.withColumns({
        "_saw": F.max("saw").over(whole), "_session": last("session"), "_model": last("model"), "_cwd": last("cwd"), "started_at": started, "n_turns": F.sum(n).over(whole).cast("int"),
        "n_rejected": F.sum(F.col("rejected").cast("long")).over(whole), "_so_far": F.last("model", True).over(upto), "_from": F.coalesce(F.sum(n).over(before), F.lit(0)), "_at": F.row_number().over(w),
    })
    placed = folded.filter((F.col("_saw")) & ((n > 0) | (F.col("_at") == 1)))
    placed = placed.select("*", F.posexplode_outer("turns").alias("at", "turn"))
    spaced = F.get("_json", F.col("at"))
    body = F.when(F.coalesce("turn.as_json", F.lit(False)), spaced).otherwise(F.col("turn.text"))
    return placed.select(
        "source_path", F.coalesce("_session", "source_path").alias("thread_id"), F.lit(harness).alias("harness"), F.coalesce("_model", F.lit("")).alias("model"), F.coalesce("_cwd", F.lit("")).alias("cwd"), "started_at", "n_turns", "n_rejected",
        (F.coalesce("at", F.lit(0)) + F.col("_at") == 1).alias("head"), F.when(F.col("at").isNotNull(), F.col("_from") + F.col("at")).cast("int").alias("pos"), "turn.kind", body.alias("text"),
        F.when(F.col("turn.kind") == "assistant", F.coalesce("turn.turn_model", "_so_far")).alias("turn_model"), "turn.source_uuid", "turn.tool_name", F.when(F.col("turn.tool_input").isNotNull(), spaced).alias("tool_input"), "turn.call_id", F.coalesce("turn.is_error", F.lit(False)).alias("is_error"),
    )


def load_a(spark: SparkSession, root: str) -> Logs:
    """Files *.jsonl at any depth below a subfolder of root, but for folders named subagents."""
    start = len(_plain(root)) + 2

    def wanted(path: Column) -> Column:
        return F.contains(F.substring(path, start, 1 << 20), F.lit("/")) & ~F.contains(path, F.lit("/subagents/"))

    records = read_records(spark, root, "*.jsonl", wanted)
    return Logs(fold(parse_a(records), "claude", True), rejected_lines(records))


def load_b(spark: SparkSession, root: str, s: Settings = DEFAULT) -> Logs:
    """Files rollout-*.jsonl at any depth."""
    records = read_records(spark, root, "rollout-*.jsonl")
    return Logs(fold(parse_b(records, s), "codex", False), rejected_lines(records))


def load_c(spark: SparkSession, root: str) -> Logs:
    """Dialect C has no known format: it yields nothing."""
    none = spark.createDataFrame([], "source_path string, block long, line long, value string").withColumn("v", F.try_parse_json("value"))
    return Logs(fold(parse_b(none), "gemini", False), rejected_lines(none))


def union(*logs: Logs) -> Logs:
    return Logs(*(reduce(DataFrame.unionByName, (getattr(x, part) for x in logs)) for part in ("sessions", "rejected")))
