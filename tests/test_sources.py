from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from loomline.config import Settings
from loomline.operators import samples as P
from loomline.plans import log_queries
from loomline.plans.dataset import build_dataset, label_dataset, training_dataset
from loomline.sources import jsonl
from loomline.sources.label_store import LabelStore
from loomline.sources import transcripts as T
from loomline.streaming.labels import label_stream


def lines(*records) -> str:
    return "\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in records) + "\n"


def user(content, **more):
    return {"type": "user", "message": {"content": content}} | more


@pytest.fixture(scope="module")
def root_a(tmp_path_factory):
    root = tmp_path_factory.mktemp("a")
    (root / "p" / "subagents").mkdir(parents=True)
    (root / "q").mkdir()
    say = lambda t: {"type": "text", "text": t}
    (root / "p" / "one.jsonl").write_bytes(
        lines(
            {"type": "summary", "cwd": "/wrong", "timestamp": "2020"},
            user("[fix] it now", sessionId="s1", cwd="/home/user/git/alpha/x", timestamp="2025-02-03T04:05:06Z", uuid="u1"),
            "", "{broken", "5", "[1]",
            {"type": "assistant", "message": {"model": "m1", "content": [say("a"), {"type": "thinking", "thinking": "no"}, say("b"), {"type": "tool_use", "id": "c1", "name": "Bash", "input": {"z": 1.0, "a": [1, {"k": "é"}]}}, say("c"), {"type": "tool_use", "id": "c2", "name": "Ls", "input": {}}]}},
            user([{"type": "tool_result", "tool_use_id": "c1", "content": [say("r1"), "r2", {"type": "image"}]}, say("and go on"), {"type": "tool_result", "tool_use_id": "c2", "content": {"b": 1, "a": 2}, "is_error": True}, {"type": "tool_result", "tool_use_id": "c3"}, {"type": "tool_result", "tool_use_id": "c4", "content": None}], uuid="u2"),
            user("hidden", isSidechain="yes", cwd="/side"), {"type": "system", "content": "sys"}, {"type": "system", "content": {"no": 1}}, {"type": "assistant", "message": {"model": "m2", "content": "text"}}, user([{"type": "image"}]),
            '{"type":"user","type":"system","content":"last key wins"}',
        ).encode()
        + b'{"type":"user","message":{"content":"bad \xff byte"}}\r{"type":"user","message":{"content":"after a lone return"}}\r\n'
    )
    (root / "p" / "subagents" / "no.jsonl").write_text(lines(user("not me")))
    (root / "q" / "two.jsonl").write_text(lines({"type": "system", "content": "alone"}))
    (root / "q" / "three.jsonl").write_text(lines(user("same session here", sessionId="s1")))
    (root / "q" / "four.jsonl").write_text(lines(user("no session id here")))
    (root / "top.jsonl").write_text(lines(user("too high up")))
    return str(root)


def test_dialect_a(spark, root_a):
    logs = T.load_a(spark, root_a)
    threads = {r.source_path.split("/")[-1]: r for r in logs.threads.collect()}
    assert set(threads) == {"one.jsonl", "three.jsonl", "four.jsonl"}
    one = threads["one.jsonl"]
    assert (one.thread_id, one.harness, one.model, one.cwd, one.started_at, one.n_turns) == ("s1", "claude", "m2", "/home/user/git/alpha/x", "2025-02-03T04:05:06Z", 14)
    assert threads["four.jsonl"].thread_id == threads["four.jsonl"].source_path
    turns = [(r.kind, r.text, r.source_uuid, r.tool_name, r.tool_input, r.call_id, r.is_error) for r in logs.turns.filter("source_path like '%one.jsonl'").orderBy("pos").collect()]
    plain = lambda kind, text, uuid=None: (kind, text, uuid, None, None, None, False)
    assert turns == [
        plain("user", "[fix] it now", "u1"), plain("assistant", "a\nb"), ("tool_call", None, None, "Bash", '{"z": 1.0, "a": [1, {"k": "é"}]}', "c1", False), plain("assistant", "c"), ("tool_call", None, None, "Ls", "{}", "c2", False),
        plain("user", "and go on", "u2"), ("tool_result", "r1\nr2\n", None, None, None, "c1", False), ("tool_result", '{"b": 1, "a": 2}', None, None, None, "c2", True), ("tool_result", "", None, None, None, "c3", False), ("tool_result", "null", None, None, None, "c4", False),
        plain("system", "sys"), plain("system", "last key wins"), plain("user", "bad � byte"), plain("user", "after a lone return"),
    ]
    assert sorted(r.value for r in logs.rejected.collect()) == ["5", "[1]"]
    assert T.load_a(spark, root_a + "/nowhere").threads.count() == 0


def test_dialect_b(spark, tmp_path):
    item = lambda **p: {"type": "response_item", "payload": p}
    said = lambda role, text: item(type="message", role=role, content=text)
    (tmp_path / "2025").mkdir()
    (tmp_path / "2025" / "rollout-1.jsonl").write_text(lines(
        {"type": "session_meta", "payload": {"id": "i1", "cwd": "/c", "timestamp": "t1", "model": "gm"}}, {"type": "session_meta", "payload": {"cwd": "/c2", "timestamp": "t2", "id": ""}},
        said("developer", [{"type": "input_text", "text": "dev"}]), said("user", " # AGENTS.md instructions for x"), said("user", "y" * 2001), said("user", [{"type": "input_text", "text": "real"}, {"type": "x", "text": 5}, {"no": 1}, "s"]),
        said("user", "y" * 2002), said("assistant", []), said("tool", "dropped"),
        item(type="function_call", name="f", call_id="k", arguments='{"b": 1, "a": 2}'), item(type="function_call", name="f", arguments="no json"), item(type="function_call", name="f", arguments="[1,2]"), item(type="custom_tool_call", name="g"), item(type="custom_tool_call", arguments={"q": 1, "b": 2}),
        item(type="function_call_output", call_id="k", output={"o": [1, 2]}), item(type="function_call_output", call_id="k", output="ok"), item(type="custom_tool_call_output", output=None), {"type": "event_msg", "payload": {}}, {"type": "other"},
    ))
    (tmp_path / "rollout-2.jsonl").write_text(lines(said("user", ""), said("user", "# AGENTS.md instructions now stay")))
    (tmp_path / "rollout-3.jsonl").write_text(lines({"type": "session_meta", "payload": {"id": "none"}}))
    (tmp_path / "other.jsonl").write_text(lines(said("user", "not a rollout")))
    logs = T.load_b(spark, str(tmp_path))
    threads = {r.source_path.split("/")[-1]: r for r in logs.threads.collect()}
    assert set(threads) == {"rollout-1.jsonl", "rollout-2.jsonl"}
    assert (threads["rollout-1.jsonl"].thread_id, threads["rollout-1.jsonl"].cwd, threads["rollout-1.jsonl"].started_at, threads["rollout-1.jsonl"].model) == ("i1", "/c2", "t2", "gm")
    got = [(r.kind, r.text if r.kind != "tool_call" else r.tool_input) for r in logs.turns.filter("source_path like '%-1.jsonl'").orderBy("pos").collect()]
    assert got == [
        ("system", "dev"), ("user", "real\n5"), ("user", "y" * 2002), ("assistant", ""), ("tool_call", '{"b": 1, "a": 2}'), ("tool_call", '{"_raw": "no json"}'), ("tool_call", '{"_raw": [1, 2]}'), ("tool_call", "{}"), ("tool_call", '{"q": 1, "b": 2}'),
        ("tool_result", '{"o": [1, 2]}'), ("tool_result", "ok"), ("tool_result", "null"),
    ]
    assert [r.text for r in logs.turns.filter("source_path like '%-2.jsonl'").orderBy("pos").collect()] == ["", "# AGENTS.md instructions now stay"]
    assert T.load_c(spark, str(tmp_path)).threads.count() == 0


def test_line_order_across_splits(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "big.jsonl").write_text(lines(*(user(f"line {i} " + "x" * (i % 50)) for i in range(5000))))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = T.load_a(spark, str(tmp_path)).turns.orderBy("pos").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.text.split()[1] for r in rows] == [str(i) for i in range(5000)]


def test_from_logs_to_training_rows(spark, root_a, tmp_path):
    made, stats = build_dataset(spark, {"a": root_a, "b": str(tmp_path / "none"), "c": root_a}, str(tmp_path / "samples"))
    targets = sorted(r.target for r in made.samples.collect())
    assert targets == ["[fix] it now", "after a lone return", "and go on", "bad � byte", "no session id here", "same session here"]
    row = stats.first()
    assert (row.threads_seen, row.threads_kept, row.samples) == (3, 3, 6)
    again = jsonl.read_samples(spark, [str(tmp_path / "samples"), str(tmp_path / "missing")])
    assert sorted(r.target for r in again.collect()) == targets
    assert [r.target for r in jsonl.read_samples(spark, str(tmp_path / "samples"), 1).collect()] == [min(made.samples.collect(), key=lambda r: (r.source_path, r.pos)).target]
    store = str(tmp_path / "labels")
    for _ in range(2):  # a rerun adds nothing
        label_dataset(spark, [str(tmp_path / "samples")], store)
        assert LabelStore(spark, store).read().count() == 6 == spark.read.parquet(f"{store}/v1").count()
    rows = training_dataset(spark, [str(tmp_path / "samples")], store).collect()
    assert len(rows) == 6 and all(r.messages[0].role == "system" and r.target.startswith("CAN_AUTO_RESPOND: ") for r in rows)
    streamed = str(tmp_path / "streamed")
    for _ in range(2):
        label_stream(spark, str(tmp_path / "samples"), streamed, str(tmp_path / "checkpoint")).awaitTermination()
    assert LabelStore(spark, streamed).read().count() == 6 == spark.read.parquet(f"{streamed}/v1").count()
    lines = str(tmp_path / "lines")
    jsonl.write_labels(LabelStore(spark, store).read(), lines)
    (tmp_path / "lines" / "z.json").write_text("".join(json.dumps({"key": spark.read.json(lines).first()["key"], "score": n}) + "\n" for n in (2, 3)))
    assert jsonl.read_labels(spark, lines).count() == 6 and jsonl.read_labels(spark, lines).filter("score = 3").count() == 1  # the last record of a key counts
    assert jsonl.read_labels(spark, str(tmp_path / "no labels")).count() == 0


def test_since_and_prompts(spark, root_a, tmp_path):
    assert P.parse_since("never") is None and P.parse_since("2025-01-01").isoformat() == "2025-01-01T00:00:00+00:00"
    made, stats = build_dataset(spark, {"a": root_a}, since="2025-02-04", s=Settings())
    assert stats.first().threads_date == 1 and made.samples.count() == 2  # unknown starts are kept
    with pytest.raises(FileNotFoundError):
        jsonl.read_prompts(spark, str(tmp_path))
    jsonl.write_prompt(spark, str(tmp_path), "to be replaced")
    jsonl.write_prompt(spark, str(tmp_path), "Be brief.\nAlways.")
    assert jsonl.read_prompts(spark, str(tmp_path))[1].count() == 0
    jsonl.write_prompt(spark, str(tmp_path), "Tests first.", "alpha")
    prefix, suffixes = jsonl.read_prompts(spark, str(tmp_path))
    assert prefix == "Be brief.\nAlways." and [tuple(r) for r in suffixes.collect()] == [("alpha", "Tests first.")]


def test_write_files(spark, tmp_path):
    """A file for each path, lines in order though rows are dealt at random, none aside left, and a rerun replaces files."""
    rows = spark.range(2000).selectExpr("concat('d', id % 3, '/sub/', id % 50, '.jsonl') path", "id at", "if(id = 7, null, concat('é ', id)) line")
    for _ in range(2):
        assert jsonl.write_files(rows.repartition(7, "at").orderBy(F.desc("at")), f"file:{tmp_path}", "at") == 150
    found = {str(p.relative_to(tmp_path)): p.read_text().split("\n") for p in tmp_path.rglob("*") if p.is_file()}
    assert len(found) == 150 and all(x == ["" if i == 7 else f"é {i}" for i in range(2000) if f"d{i % 3}/sub/{i % 50}.jsonl" == p] + [""] for p, x in found.items())
    jsonl.delete_files(spark, [f"file:{tmp_path}/d{i}" for i in range(3)])
    assert not any(tmp_path.iterdir())
    jsonl.delete_files(spark, [])
    assert jsonl.write_files(rows.limit(0), str(tmp_path), "at") == 0


def test_logs_of_a_scan_share_folders(spark, small, monkeypatch):
    """A hundred conversations to a folder: a folder and a commit for each took most of the time."""
    deleted, of = [], jsonl.delete_files
    monkeypatch.setattr(jsonl, "delete_files", lambda s, folders: (deleted.extend(folders), of(s, folders)))
    n = log_queries.logs_scan(spark, small).select("thread_id").distinct().count()
    last = spark.read.parquet(f"{small}/conversations.parquet").agg(F.max("conv_id")).first()[0]
    assert n and 0 < len(deleted) <= 3 * (last // 100 + 1)
