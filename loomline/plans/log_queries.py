"""Queries that run the loaders, renderers and graders as shipped, over logs and samples made of the given tables; and the DuckDB SQL of each."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomline.config import DEFAULT, TRUNCATION_MARK
from loomline.functions import messages as M
from loomline.functions.tokens import CodePoints, FileTokenizer, Maker
from loomline.operators import labels as L
from loomline.operators import rendering as R
from loomline.operators import samples as P
from loomline.operators import scoring as C
from loomline.operators import stats as T
from loomline.operators.backends import command, enveloped, usage
from loomline.operators.calls import Calls
from loomline.plans.dataset import label_dataset
from loomline.plans.fixtures import sessions
from loomline.sources import jsonl, transcripts
from loomline.sources.label_store import LabelStore
from loomline.sources.scratch import cut, names, scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _samples(spark: SparkSession, sf_dir: str, make: Maker | None = None) -> DataFrame:
    return P.build_samples(sessions(spark, sf_dir), make=make).samples


def _records(rows: DataFrame, line: str, path: str = "'/r/p/' || cast(conv_id as string)", number: str = "turn") -> DataFrame:
    """Log lines as the scan gives them."""
    return transcripts.parsed(rows.select(F.expr(path).alias("source_path"), F.lit(0).cast("long").alias("block"), F.expr(number).cast("long").alias("line"), F.expr(line).alias("value")))


_QUOTED = "substr(to_json(named_struct('x', text)), 6, length(to_json(named_struct('x', text))) - 6)"
_BLOCKS = f"""
    '{{' || if(conv_id % 7 = 3 and turn = 1, '"isSidechain": true, "cwd": "/side", ', '') || '"sessionId": "s' || cast(conv_id as string) || '", ' ||
    case when role = 'user' then '"type": "user", "uuid": "u' || cast(turn as string) || '", "message": {{"content": [' ||
        case turn % 8
          when 0 then '{{"type": "tool_result", "tool_use_id": "c0", "is_error": true, "content": "out"}}, {{"type": "text", "text": ' || {_QUOTED} || '}}'
          when 2 then '{{"type": "tool_result", "tool_use_id": "c2", "content": [{{"text": "x"}}, {{"text": ' || {_QUOTED} || '}}, "y", null, true, {{"k": 1}}]}}, {{"type": "image"}}'
          when 4 then '{{"type": "tool_result", "tool_use_id": "c4", "content": {{"k":1}}}}, {{"type": "text", "text": "a"}}, 7, {{"type": "text", "text": ' || {_QUOTED} || '}}, {{"type": "tool_result", "tool_use_id": "d4"}}'
          else '{{"type": "thinking", "text": ' || {_QUOTED} || '}}' end || ']}}'
      when role = 'assistant' then '"type": "assistant", "message": {{"model": "m' || cast(turn as string) || '", "content": ' ||
        if(turn % 3 = 0, {_QUOTED}, '[{{"type": "thinking", "text": "t"}}, {{"type": "text", "text": ' || {_QUOTED} || '}}, {{"type": "thinking"}}, {{"type": "text", "text": "more"}}, {{"type": "tool_use", "name": "Run", "id": "k' || cast(turn as string) || '", "input": {{"z":' || cast(turn as string) || ',"a":[1,2]}}}}]') || '}}'
      else '"type": "' || if(conv_id % 2 = 1, 'summary', 'system') || '", "content": ' || {_QUOTED} end || '}}'"""


@query
def transcript_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialect A with block lists: results before and after text, result bodies of all sorts, skipped records and sidechains."""
    records = _records(_table(spark, sf_dir, "conversations"), _BLOCKS)
    return transcripts.fold(transcripts.parse_a(records), "claude", True).filter("kind is not null").select("source_path", "pos", "kind", "text", "source_uuid", "tool_name", "tool_input", "call_id", "is_error", "turn_model", "model", "cwd")


_DIALECT_B = f"""
    case when turn < 0 then '{{"type": "session_meta", "payload": {{"id": "' || if(turn = -1, 's' || cast(conv_id as string), '') || '", "cwd": "/w' || cast(turn as string) || '", "timestamp": "2025-01-0' || cast(-turn as string) || '", "model": "m' || cast(conv_id % 3 as string) || '"}}}}'
      when turn = 0 and role <> 'user' then '{{"type": "response_item", "payload": {{"type": "message", "role": "' || if(conv_id % 3 = 0, 'developer', 'critic') || '", "content": ' || {_QUOTED} || '}}}}'
      when role = 'user' and turn % 4 = 0 then '{{"type": "response_item", "payload": {{"type": "message", "role": "user", "content": ' || {_QUOTED} || '}}}}'
      when role = 'user' then '{{"type": "response_item", "payload": {{"type": "message", "role": "user", "content": [{{"type": "input_text", "text": ' || {_QUOTED} || '}}, {{"type": "image"}}, 5, {{"type": "other", "text": "z"}}]}}}}'
      when turn % 4 = 1 and conv_id % 4 = 0 then '{{"type": "response_item", "payload": {{"type": "function_call", "name": "f", "call_id": "k", "arguments": "{{\\\\"b\\\\":' || cast(turn as string) || '}}"}}}}'
      when turn % 4 = 1 and conv_id % 4 = 1 then '{{"type": "response_item", "payload": {{"type": "custom_tool_call", "name": "g", "call_id": "k", "arguments": "not json"}}}}'
      when turn % 4 = 1 and conv_id % 4 = 2 then '{{"type": "response_item", "payload": {{"type": "function_call", "name": "h", "arguments": [1,2]}}}}'
      when turn % 4 = 3 and conv_id % 2 = 0 then '{{"type": "response_item", "payload": {{"type": "function_call_output", "call_id": "k", "output": {{"o":' || cast(turn as string) || '}}}}}}'
      when turn % 4 = 3 then '{{"type": "response_item", "payload": {{"type": "custom_tool_call_output", "call_id": "k", "output": ' || {_QUOTED} || '}}}}'
      else '{{"type": "response_item", "payload": {{"type": "message", "role": "assistant", "content": [{{"type": "output_text", "text": ' || {_QUOTED} || '}}]}}}}' end"""


def _with_heads(rows: DataFrame) -> DataFrame:
    """Two session headers before each conversation."""
    first = F.col("turn") == F.min("turn").over(W.partitionBy("conv_id"))
    return rows.withColumn("first", first).withColumn("turn", F.explode(F.when(F.col("first"), F.expr("array(-2L, -1L, turn)")).otherwise(F.array("turn")))).drop("first")


@query
def transcript_parse_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as log lines of dialect B, with two session headers each, parsed back."""
    records = _records(_with_heads(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")), _DIALECT_B)
    return transcripts.fold(transcripts.parse_b(records), "codex", False).filter("kind is not null").select("source_path", "pos", "kind", "text", "tool_name", "tool_input", "call_id", "is_error", "thread_id", "model", "cwd", "started_at", "n_turns")


@query
def preamble_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leading machine-made user messages of dialect B."""
    rows = _table(spark, sf_dir, "conversations").withColumn("text", F.expr("case when conv_id % 6 = 1 and turn < 2 then ' # AGENTS.md instructions ' || text when conv_id % 6 = 2 and turn = 0 then repeat('x', cast(1998 + conv_id % 5 as int)) when conv_id % 6 = 3 and turn = 0 then '' else text end"))
    records = _records(rows, "to_json(named_struct('type', 'response_item', 'payload', named_struct('type', 'message', 'role', if(role = 'system', 'developer', role), 'content', text)))")
    return transcripts.fold(transcripts.parse_b(records), "codex", False).filter("kind is not null").select("source_path", "pos", "kind", "text")


@query
def text_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as the blocks of one assistant record: texts merge up to each tool call."""
    block = F.expr("named_struct('type', if(event_type = 'purchase', 'tool_use', 'text'), 'text', event_type, 'name', 'buy')")
    rows = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", block.alias("b")))), lambda x: x["b"]).alias("content"))
    records = _records(rows, "to_json(named_struct('type', 'assistant', 'message', named_struct('content', content)))", "cast(user_id as string)", "0")
    return transcripts.fold(transcripts.parse_a(records), "claude", True).filter("kind is not null").select("source_path", "pos", "kind", "text")


@query
def model_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as assistant records, of which some name a model."""
    line = "to_json(named_struct('type', 'assistant', 'message', named_struct('model', case when event_id % 4 = 0 then event_type when event_id % 4 = 1 then '' end, 'content', array(named_struct('type', 'text', 'text', cast(event_id as string))))))"
    records = _records(_table(spark, sf_dir, "events"), line, "cast(user_id as string)", "unix_micros(cast(ts as timestamp))")
    return transcripts.fold(transcripts.parse_a(records), "claude", True).filter("kind is not null").select(F.col("text").cast("long").alias("event_id"), F.col("turn_model").alias("model"))


@query
def logs_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as log files and loaded from there in all dialects: a file for each, a hundred to a folder, some of them below `subagents`; for dialect B also a file at the root. With blank and malformed lines, and lines that are no objects."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").filter("conv_id is not null")
    bad = rows.filter("turn = 1").select("conv_id", "turn", F.explode(F.array(F.lit(" "), F.lit('{"type": "user"'), F.lit("[1]"))).alias("line"))
    places = {
        "a": "array(concat('a/', if(conv_id % 10 = 9, 'subagents/', ''), conv_id div 100, '/', conv_id, '.jsonl'))",
        "b": "if(conv_id = 7, array('b/rollout-7.jsonl'), transform(array('rollout', 'other'), x -> concat('b/', conv_id div 100, '/', x, '-', conv_id, '.jsonl')))",
    }
    with scratch(spark) as where:
        for kind, line, of in (("a", _BLOCKS, rows), ("b", _DIALECT_B, _with_heads(rows))):
            lines = of.select("conv_id", "turn", F.expr(line).alias("line")).unionByName(bad)
            jsonl.write_files(lines.select(F.explode(F.expr(places[kind])).alias("path"), "turn", "line"), where, "turn")
        logs = transcripts.union(transcripts.load_a(spark, f"{where}/a"), transcripts.load_b(spark, f"{where}/b"), transcripts.load_c(spark, where))
        found = cut(logs.sessions.filter("kind is not null").select("harness", "thread_id", "pos", "kind", "text", "tool_name", "tool_input", "call_id", "model", "cwd", "started_at", "n_turns", "n_rejected"))
        jsonl.delete_files(spark, [f"{where}/{of}/{x}" for of in ("a/subagents", "a", "b") for x in names(spark, f"{where}/{of}") if x.isdigit()])
        return found


@query
def samples_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples written by split and read again from both sides, and a side that isn't there: the first 200."""
    with scratch(spark) as where:
        jsonl.write_samples(_samples(spark, sf_dir), where)
        got = jsonl.read_samples(spark, [f"{where}/split=train", f"{where}/split=val", f"{where}/split=none"], 200)
        return cut(got.select("source_path", "pos", "target", "thread_id", "project", F.md5(F.array_join(F.transform("context_messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")).alias("context")))


@query
def budget_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts within 1,200 tokens, a token for each character: the oldest turns go, and a last one that is too long loses its beginning."""
    got = R.render(_samples(spark, sf_dir, CodePoints), F.lit("PREFIX"), F.lit(None).cast("string"), CodePoints, 1200)
    total = F.aggregate(R.message_costs(F.col("messages"), CodePoints), F.lit(2), lambda a, b: a + b)
    return got.select("source_path", "pos", F.size("messages").alias("n"), F.md5(F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")).alias("text"), total.alias("tokens"))


@query
def project_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed examples of one project, for a prompt optimizer."""
    got = R.build_examples(_samples(spark, sf_dir).withColumn("project", F.expr("if(cast(substr(thread_id, 2) as int) % 3 = 0, 'other', 'own')")), F.lit("P"), F.lit("S"), "val", CodePoints, "own", replace(DEFAULT, project_support=5))
    return got.select("sample_key", F.md5("system").alias("system"), F.md5("thread").alias("thread"), "reply")


@query
def prediction_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions meet their samples by key; unknown keys have no context."""
    samples = P.sample_key(_samples(spark, sf_dir), "t")
    keys = _table(spark, sf_dir, "conversations").select(F.expr("'t:t' || cast(conv_id as string) || ':' || cast(turn * 3 as string)").alias("sample_key"), "conv_id", "turn")
    return R.example_contexts(keys, samples).select("sample_key", "conv_id", "turn", F.size("context_messages").alias("n"))


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reply to each message of a person, that a model could have given: the message before it."""
    return _samples(spark, sf_dir).select("source_path", "pos", F.concat_ws(":", "source_path", F.col("pos").cast("string")).alias("key"), F.col("target").alias("gold"), F.coalesce(F.get("context_messages", F.size("context_messages") - 1)["content"], F.lit("")).alias("generated"), "context_messages")


@query
def judge_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replies(spark, sf_dir).select("source_path", "pos", F.md5(M.judge_prompt(F.col("context_messages"), F.col("generated"), F.col("gold"), F.col("pos") % 4 == 0)).alias("prompt"))


def _judge() -> Callable[[str], str]:
    def ask(prompt: str) -> str:
        if len(prompt) % 3 == 0:
            raise RuntimeError("no answer")
        return "???"

    return ask


def _embedder() -> Callable[[list[str]], np.ndarray]:
    return lambda texts: np.array([[len(t), 100.0] for t in texts])


@query
def reply_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge that fails or can't tell, and an embedder that sees lengths."""
    got = C.score_replies(_replies(spark, sf_dir), _judge, _embedder, calls=_CALLS)
    return got.select("source_path", "pos", "judge", F.round("embed", 5).alias("embed"), F.round("length", 6).alias("length"), F.round("combined", 5).alias("combined"))


def _grader() -> Callable[[str], str]:
    def ask(prompt: str) -> str:
        reply = prompt.split("The reply:\n")[1].split("\n\nHow far")[0]
        if len(reply) % 4 == 0:
            raise RuntimeError("no answer")
        return f"I'd say\nCAN_AUTO_RESPOND: {len(reply) % 100}%"

    return ask


def _sure_grader() -> Callable[[str], str]:
    return lambda prompt: "CAN_AUTO_RESPOND: 50%"


#: Quick second attempts: these graders and judges fail for good or not at all.
_CALLS = Calls(in_flight=8, attempts=2, pause=0.001)


@query
def graded_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle zone by a grader that fails on some, without those labeled before."""
    samples = L.keyed(_samples(spark, sf_dir))
    return L.graded_labels(samples, samples.filter("pos % 4 = 2"), _grader, "lengths", calls=_CALLS).select("key", "score", "method", "target_len", "thread_id")


@query
def stored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way into a label store: samples from disk, heuristic zones, then answers of a grader kept as they come; a second run with a grader that always answers labels what the first left; old and new versions of the store."""
    with scratch(spark) as where:
        jsonl.write_samples(_samples(spark, sf_dir), f"{where}/samples")
        for ask, name in ((_grader, "lengths"), (_sure_grader, "sure")):
            label_dataset(spark, [f"{where}/samples"], f"{where}/labels", ask, name, calls=_CALLS, buckets=8)
        store = LabelStore(spark, f"{where}/labels", 8)
        store.compact()
        return cut(store.read())


@query
def command_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of a command that gives back its input: answers, errors and usage read as columns, and what each model costs."""
    made = F.expr("""case when doc_id % 7 = 0 then 'no json' else to_json(named_struct('result', source || ' says ' || lang, 'is_error', doc_id % 5 = 0, 'usage', if(doc_id % 3 = 0, null, named_struct('input_tokens', n_chars, 'output_tokens', doc_id % 10)))) end""")
    rows = _table(spark, sf_dir, "documents").select("doc_id", "lang", made.alias("prompt"))
    output = rows.withColumn("output", L.grade(F.col("prompt"), command(["cat"]), _CALLS))
    model = F.expr("case lang when 'en' then 'openai/gpt-4o' else 'lang/' || lang end").alias("model")
    told = output.select(model, enveloped(F.col("output")).alias("answer"), usage(F.col("output")).alias("u")).select("model", "answer", "u.prompt_tokens", "u.completion_tokens")
    sums = T.costs(told, T.price_table(spark), answers=F.count("answer"), calls=F.count("*"))
    return sums.select("model", "prompt_tokens", "completion_tokens", F.round("usd", 6).alias("usd"), "answers", "calls")


@query
def prompt_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate log, its best prompt of each project written to the store, some of them twice, and samples that look theirs up."""
    docs = _table(spark, sf_dir, "documents")
    with scratch(spark) as where:
        for stage in ("prefix", "suffix"):
            jsonl.append_candidates(docs.select(F.lit(stage).alias("stage"), F.col("source").alias("project"), F.concat(F.lit(stage), F.lit(": "), "lang").alias("candidate"), (F.col("n_chars") % 1000 / 8).alias("score"), F.lit(0.5).alias("wall_time"), F.col("doc_id").cast("string").alias("extra")), f"{where}/log")
        log = jsonl.read_candidates(spark, f"{where}/log").filter("stage = 'suffix' and project <> 'src3'")
        best = log.groupBy("project").agg(F.max_by("candidate", F.struct("score", F.col("extra").cast("long"))).alias("suffix"))
        jsonl.write_prompt(spark, f"{where}/prompts", "PREFIX\nline two")
        for r in best.toLocalIterator():  # one small file for each project
            jsonl.write_prompt(spark, f"{where}/prompts", "to be replaced", r["project"])
            jsonl.write_prompt(spark, f"{where}/prompts", r["suffix"], r["project"])
        prefix, suffixes = jsonl.read_prompts(spark, f"{where}/prompts")
        rows = R.join_prompts(docs.select("doc_id", F.col("source").alias("project"), F.col("lang").alias("model")), prefix, suffixes)
        return cut(rows.select("doc_id", "suffix", M.system_prompt(F.col("prefix"), F.col("suffix"), F.col("model"), F.lit("h"), F.lit("/c")).alias("system")))


@query
def vocabulary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows as ids of a real vocabulary with the prompt masked."""
    rows = L.training_rows(_samples(spark, sf_dir), spark.createDataFrame([], L.LABEL_SCHEMA))
    return R.token_rows(rows, _vocabulary, 1, 0, 2048).select("source_path", "pos", "input_ids", "attention_mask", "labels")


@query
def vocabulary_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts within 300 tokens of a real vocabulary."""
    got = R.render(_samples(spark, sf_dir, _vocabulary), F.lit("PREFIX"), F.lit("SUFFIX"), _vocabulary, 300)
    return got.select("source_path", "pos", "messages")


def _vocabulary() -> FileTokenizer:
    import public_tokenizers

    return FileTokenizer(str(public_tokenizers.path("byte_bpe_50k.json")))


def _echo() -> Callable[[str], str]:
    return lambda prompt: prompt + " "


@query
def generated_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rendered = _replies(spark, sf_dir).withColumn("messages", F.concat(F.array(M.message("system", F.lit("Be brief."))), F.array(M.message("user", F.col("gold")))))
    return C.generate(rendered, {"other": _judge, "echo-": _echo}, "echo-1").select("source_path", "pos", "reply")


@query
def prefix_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = F.expr("case when doc_id % 3 = 0 then source || chr(10) || chr(10) || text when doc_id % 3 = 1 then source || text else text || source end")
    return _table(spark, sf_dir, "documents").select("doc_id", M.strip_prefix(full, F.col("source")).alias("rest"))


def _sql() -> dict[str, str]:
    from loomline.plans import oracle as o

    samples = o._samples()
    replies = f"{samples}, replies AS (SELECT source_path, pos, ctx, target AS gold, CASE WHEN len(ctx) = 0 THEN '' ELSE substr(ctx[-1], strpos(ctx[-1], ':') + 1) END AS generated FROM samples)"
    line = "'This is a log from model ' || model || ' in harness ' || harness || ', cwd ' || cwd || '. Respond as the user.'"
    shown = lambda of, sep, up: f"array_to_string(list_transform({of}, lambda m: '[' || {'upper' if up else ''}(substr(m, 1, strpos(m, ':') - 1)) || ']{sep}' || substr(m, strpos(m, ':') + 1)), chr(10) || chr(10))"
    blocks = """
        WITH kept AS (SELECT * FROM conversations WHERE NOT (conv_id % 7 = 3 AND turn = 1)),
        made AS (SELECT *, CASE
            WHEN role = 'user' AND turn % 8 = 0 THEN [{'kind': 'user', 'text': text, 'call': NULL, 'err': false}, {'kind': 'tool_result', 'text': 'out', 'call': 'c0', 'err': true}]
            WHEN role = 'user' AND turn % 8 = 2 THEN [{'kind': 'tool_result', 'text': 'x' || chr(10) || text || chr(10) || 'y' || chr(10) || 'None' || chr(10) || 'True' || chr(10), 'call': 'c2', 'err': false}]
            WHEN role = 'user' AND turn % 8 = 4 THEN [{'kind': 'user', 'text': 'a' || chr(10) || text, 'call': NULL, 'err': false}, {'kind': 'tool_result', 'text': '{"k": 1}', 'call': 'c4', 'err': false}, {'kind': 'tool_result', 'text': '', 'call': 'd4', 'err': false}]
            WHEN role = 'assistant' AND turn % 3 <> 0 THEN [{'kind': 'assistant', 'text': text || chr(10) || 'more', 'call': NULL, 'err': false}, {'kind': 'tool_call', 'text': NULL, 'call': 'k' || turn, 'err': false}]
            WHEN role = 'system' AND conv_id % 2 = 0 THEN [{'kind': 'system', 'text': text, 'call': NULL, 'err': false}] ELSE [] END AS turns FROM kept),
        heads AS (SELECT conv_id, coalesce(arg_max('m' || turn, turn) FILTER (WHERE role = 'assistant'), '') AS model FROM made GROUP BY conv_id HAVING bool_or(role = 'assistant' OR (role = 'user' AND len(turns) > 0))),
        parts AS (SELECT conv_id, turn, unnest(turns) AS t, generate_subscripts(turns, 1) AS spot FROM made),
        placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, spot) - 1 AS pos FROM parts JOIN heads USING (conv_id))"""
    dialect_b = """
            made AS (SELECT *, CASE WHEN turn = 0 AND role <> 'user' THEN CASE WHEN conv_id % 3 = 0 THEN 'system' END WHEN role = 'user' THEN 'user' WHEN turn % 4 = 1 AND conv_id % 4 < 3 THEN 'tool_call' WHEN turn % 4 = 3 THEN 'tool_result' ELSE 'assistant' END AS kind FROM conversations),
            flat AS (SELECT *, CASE WHEN kind = 'tool_call' THEN NULL WHEN kind = 'user' AND turn % 4 <> 0 THEN text || chr(10) || 'z' WHEN kind = 'tool_result' AND conv_id % 2 = 0 THEN '{"o": ' || turn || '}' ELSE text END AS body FROM made WHERE kind IS NOT NULL),
            b AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, kind, body AS text, CASE WHEN kind = 'tool_call' THEN ['f', 'g', 'h'][conv_id % 4 + 1] END AS tool_name,
              CASE WHEN kind = 'tool_call' THEN ['{"b": ' || turn || '}', '{"_raw": "not json"}', '{"_raw": [1, 2]}'][conv_id % 4 + 1] END AS tool_input, CASE WHEN kind = 'tool_result' OR (kind = 'tool_call' AND conv_id % 4 < 2) THEN 'k' END AS call_id, false AS is_error,
              's' || conv_id AS thread_id, 'm' || conv_id % 3 AS model, '/w-1' AS cwd, '2025-01-01' AS started_at, (count(*) OVER (PARTITION BY conv_id))::INT AS n_turns FROM flat)"""
    rejected = "(SELECT count(*) FROM conversations c WHERE c.conv_id = x.conv_id AND turn = 1) AS n_rejected"
    return {
        "transcript_blocks": f"""{blocks} SELECT '/r/p/' || conv_id AS source_path, pos, t.kind AS kind, t.text AS text, CASE WHEN t.kind = 'user' THEN 'u' || turn END AS source_uuid, CASE WHEN t.kind = 'tool_call' THEN 'Run' END AS tool_name,
            CASE WHEN t.kind = 'tool_call' THEN '{{"z": ' || turn || ', "a": [1, 2]}}' END AS tool_input, t.call AS call_id, t.err AS is_error, CASE WHEN t.kind = 'assistant' THEN 'm' || turn END AS turn_model, model, '' AS cwd FROM placed""",
        "transcript_parse_b": f"""
            WITH {dialect_b} SELECT '/r/p/' || conv_id AS source_path, pos, kind, text, tool_name, tool_input, call_id, is_error, thread_id, model, cwd, started_at, n_turns FROM b""",
        "preamble_drop": f"WITH p AS ({o._PRE}), f AS (SELECT *, min(CASE WHEN role = 'user' AND NOT {o._MACHINE} THEN turn END) OVER (PARTITION BY conv_id) AS first FROM p) SELECT '/r/p/' || conv_id AS source_path, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, role AS kind, text FROM f WHERE NOT (role = 'user' AND {o._MACHINE} AND coalesce(turn < first, true))",
        "text_runs": """
            WITH r AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM events),
            g AS (SELECT user_id, run * 2 + CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END AS spot, any_value(CASE WHEN event_type = 'purchase' THEN 'tool_call' ELSE 'assistant' END) AS kind, string_agg(CASE WHEN event_type <> 'purchase' THEN event_type END, chr(10) ORDER BY ts, event_id) AS text FROM r GROUP BY ALL)
            SELECT user_id::VARCHAR AS source_path, row_number() OVER (PARTITION BY user_id ORDER BY spot) - 1 AS pos, kind, text FROM g""",
        "model_carry_forward": f"SELECT event_id, last_value({o._OWN} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS model FROM events",
        "logs_scan": f"""{blocks}, {dialect_b.replace("made AS", "made_b AS").replace("FROM made ", "FROM made_b ")}
            SELECT 'claude' AS harness, 's' || conv_id AS thread_id, pos, t.kind AS kind, t.text AS text, CASE WHEN t.kind = 'tool_call' THEN 'Run' END AS tool_name, CASE WHEN t.kind = 'tool_call' THEN '{{"z": ' || turn || ', "a": [1, 2]}}' END AS tool_input, t.call AS call_id,
              model, '' AS cwd, NULL::VARCHAR AS started_at, (count(*) OVER (PARTITION BY conv_id))::INT AS n_turns, {rejected} FROM placed x WHERE conv_id % 10 <> 9
            UNION ALL SELECT 'codex', thread_id, pos, kind, text, tool_name, tool_input, call_id, model, cwd, started_at, n_turns, {rejected} FROM b x""",
        "samples_store": f"WITH {samples} SELECT source_path, pos, target, thread_id, project, md5(array_to_string(ctx, '|')) AS context FROM samples ORDER BY source_path, pos LIMIT 200",
        "budget_render": f"""WITH {samples},
            s AS (SELECT source_path, pos, ctx, 'system:PREFIX' || chr(10) || chr(10) || {line} AS sys FROM samples),
            c AS (SELECT *, 1200 - (length(sys) - 1 + 4) - 2 AS room, list_transform(range(1, len(ctx) + 1), lambda i: list_sum(list_transform(list_slice(ctx, i, len(ctx)), lambda x: length(x) - 1 + 4))) AS upto FROM s),
            k AS (SELECT *, len(list_filter(upto, lambda x: x <= room)) AS n FROM c),
            m AS (SELECT source_path, pos, [sys] || CASE WHEN n > 0 THEN list_slice(ctx, len(ctx) - n + 1, len(ctx)) WHEN len(ctx) = 0 THEN [] ELSE [substr(ctx[-1], 1, strpos(ctx[-1], ':')) || '{TRUNCATION_MARK}' ||
                CASE WHEN room - 4 > {len(TRUNCATION_MARK)} + 8 THEN right(substr(ctx[-1], strpos(ctx[-1], ':') + 1), room - 4 - {len(TRUNCATION_MARK)} - 8) ELSE '' END] END AS messages FROM k)
            SELECT source_path, pos, len(messages)::INT AS n, md5(array_to_string(messages, '|')) AS text, (2 + list_sum(list_transform(messages, lambda x: length(x) - 1 + 4)))::INT AS tokens FROM m""",
        "project_examples": f"""WITH {samples}, s AS (SELECT *, row_number() OVER (ORDER BY source_path, pos) - 1 AS place FROM samples WHERE substr(thread_id, 2)::INT % 3 <> 0),
            c AS (SELECT *, 'P' || chr(10) || chr(10) || 'S' || chr(10) || chr(10) || {line} AS sys FROM s), d AS (SELECT *, 8000 - (length(sys) + 6 + 4) - 2 AS room, list_transform(range(1, len(ctx) + 1), lambda i: list_sum(list_transform(list_slice(ctx, i, len(ctx)), lambda x: length(x) - 1 + 4))) AS upto FROM c),
            k AS (SELECT *, len(list_filter(upto, lambda x: x <= room)) AS n FROM d), m AS (SELECT *, list_filter(list_slice(ctx, len(ctx) - n + 1, len(ctx)), lambda x: NOT starts_with(x, 'system:')) AS kept FROM k)
            SELECT 'val:' || thread_id || ':' || place AS sample_key, md5(sys) AS system, md5({shown('kept', ': ', True)}) AS thread, target AS reply FROM m""",
        "prediction_contexts": f"WITH {samples}, s AS (SELECT 't:' || thread_id || ':' || (row_number() OVER (ORDER BY source_path, pos) - 1) AS sample_key, len(ctx) AS n FROM samples), k AS (SELECT 't:t' || conv_id || ':' || turn * 3 AS sample_key, conv_id, turn FROM conversations) SELECT k.*, coalesce(n, 0)::INT AS n FROM k LEFT JOIN s USING (sample_key)",
        "judge_prompt": f"""WITH {replies} SELECT source_path, pos, md5('Given this conversation thread:' || chr(10) || chr(10) || {shown('ctx', "' || chr(10) || '", False)} || chr(10) || chr(10) || 'Which reply is more in the style of the original author?' || chr(10) || 'A) ' || CASE WHEN pos % 4 = 0 THEN gold ELSE generated END || chr(10) || 'B) ' || CASE WHEN pos % 4 = 0 THEN generated ELSE gold END || chr(10) || 'Answer only A or B.') AS prompt FROM replies""",
        "reply_scores": f"""WITH {replies}, s AS (SELECT *, (length(generated)::DOUBLE * length(gold) + 10000) / (sqrt(length(generated)::DOUBLE ** 2 + 10000) * sqrt(length(gold)::DOUBLE ** 2 + 10000)) AS cos, CASE WHEN length(generated) = 0 THEN 0 ELSE greatest(0, least(1, 1 - greatest(0, abs(log2(length(generated) / greatest(length(gold), 1))) - 1))) END AS len FROM replies)
            SELECT source_path, pos, 0.5::DOUBLE AS judge, round(greatest(0, least(1, cos)), 5) AS embed, round(len, 6)::DOUBLE AS length, round(0.6::DOUBLE * 0.5 + 0.3::DOUBLE * greatest(0, least(1, cos)) + 0.1::DOUBLE * len, 5) AS combined FROM s""",
        "graded_labels": f"""WITH {samples}, k AS (SELECT *, {o._KEY.format('thread_id', 'target')} AS key FROM samples WHERE length(target) > 150 AND length(target) <= 800), f AS (SELECT key, arg_min(target, (source_path, pos)) AS target, any_value(thread_id) AS thread_id FROM k GROUP BY key),
            done AS (SELECT {o._KEY.format('thread_id', 'target')} AS key FROM samples WHERE pos % 4 = 2)
            SELECT key, greatest(50, least(90, length(target) % 100))::INT AS score, 'grader:lengths' AS method, length(target)::INT AS target_len, thread_id FROM f WHERE key NOT IN (SELECT key FROM done) AND length(target) % 4 <> 0""",
        "generated_replies": f"WITH {samples} SELECT source_path, pos, trim('[SYSTEM]' || chr(10) || 'Be brief.' || chr(10) || chr(10) || '[USER]' || chr(10) || target, ' ') AS reply FROM samples",
        "stored_labels": f"""WITH {samples}, k AS (SELECT *, {o._KEY.format('thread_id', 'target')} AS key, length(target)::INT AS n FROM samples), f AS (SELECT key, arg_min(n, (source_path, pos)) AS target_len, any_value(thread_id) AS thread_id FROM k GROUP BY key)
            SELECT key, target_len, thread_id, (CASE WHEN target_len <= 150 THEN round(100 - 10 * target_len / 150) WHEN target_len > 800 THEN greatest(0, round(50 * exp(-0.002 * (target_len - 800)))) WHEN target_len % 4 <> 0 THEN greatest(50, least(90, target_len % 100)) ELSE 50 END)::INT AS score,
              CASE WHEN target_len <= 150 THEN 'heuristic_short' WHEN target_len > 800 THEN 'heuristic_long' WHEN target_len % 4 <> 0 THEN 'grader:lengths' ELSE 'grader:sure' END AS method FROM f""",
        "command_costs": """WITH u AS (SELECT CASE lang WHEN 'en' THEN 'openai/gpt-4o' ELSE 'lang/' || lang END AS model, CASE WHEN doc_id % 7 = 0 OR doc_id % 3 = 0 THEN 0 ELSE n_chars END AS i, CASE WHEN doc_id % 7 = 0 OR doc_id % 3 = 0 THEN 0 ELSE doc_id % 10 END AS o, doc_id % 7 <> 0 AND doc_id % 5 <> 0 AS fine FROM documents)
            SELECT model, sum(i)::BIGINT AS prompt_tokens, sum(o)::BIGINT AS completion_tokens, round((sum(i) * CASE WHEN model LIKE 'openai%' THEN 2.5 ELSE 1.0 END + sum(o) * CASE WHEN model LIKE 'openai%' THEN 10.0 ELSE 3.0 END)::DOUBLE / 1000000, 6) AS usd, count(*) FILTER (WHERE fine) AS answers, count(*) AS calls FROM u GROUP BY model""",
        "prompt_store": """WITH best AS (SELECT source, 'suffix: ' || arg_max(lang, (n_chars % 1000, doc_id)) AS suffix FROM documents WHERE source <> 'src3' GROUP BY source)
            SELECT doc_id, suffix, 'PREFIX' || chr(10) || 'line two' || coalesce(chr(10) || chr(10) || suffix, '') || chr(10) || chr(10) || 'This is a log from model ' || lang || ' in harness h, cwd /c. Respond as the user.' AS system FROM documents LEFT JOIN best USING (source)""",
        "prefix_strip": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN regexp_replace(text, '^\\n+', '') WHEN 1 THEN regexp_replace(text, '^\\n+', '') ELSE CASE WHEN starts_with(text || source, source) THEN regexp_replace(substr(text || source, length(source) + 1), '^\\n+', '') ELSE text || source END END AS rest FROM documents",
    }


ORACLE_SQL: dict[str, str] = _sql()
