"""External calls: several at once, tried again, within a rate and a budget, each answer kept; and the stores that take them."""

from __future__ import annotations

import json
import os
import shutil
import sys
import threading
import time
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from loomline.operators.backends import command
from loomline.operators.calls import Budget, BudgetExceeded, Caller, Calls, json_tokens, keep_answers, spent, usd
from loomline.operators.labels import LABEL_SCHEMA, grade, unlabeled
from loomline.plans import log_queries
from loomline.plans.dataset import label_dataset
from loomline.sources import jsonl
from loomline.sources.label_store import LabelStore

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this file


def slow(seconds: float):
    def make():
        def ask(prompt: str) -> str:
            time.sleep(seconds)
            return prompt.upper()

        return ask

    return make


def test_calls_overlap_and_keep_their_order():
    with Caller(slow(0.05), Calls(in_flight=10)) as caller:
        began = time.monotonic()
        assert caller.all([f"p{i}" for i in range(40)]) == [f"P{i}" for i in range(40)]
        assert 0.2 <= time.monotonic() - began < 1.0  # 2 s one after another


def test_a_column_of_calls(spark):
    rows = spark.createDataFrame([(i, f"p{i}" if i else None) for i in range(30)], "i int, p string").coalesce(1)
    got = rows.select("i", grade(F.coalesce("p", F.lit("none")), slow(0.01), Calls(in_flight=8)).alias("a")).orderBy("i").collect()
    assert [r.a for r in got] == ["NONE", *(f"P{i}" for i in range(1, 30))]


def test_second_attempts():
    tries: dict[str, int] = {}

    def make():
        def ask(prompt: str) -> str:
            tries[prompt] = tries.get(prompt, 0) + 1
            if tries[prompt] < int(prompt):
                raise RuntimeError("busy")
            return f"after {tries[prompt]}"

        return ask

    with Caller(make, Calls(attempts=3, pause=0.01)) as caller:
        assert caller.all(["1", "2", "3", "4"]) == ["after 1", "after 2", "after 3", None]
    assert tries == {"1": 1, "2": 2, "3": 3, "4": 3}


def test_a_command_runs_once_for_each_row(spark, small, tmp_path, monkeypatch):
    """Answers, errors and costs are read from the same outputs: a second pass over them would call the command again."""
    log = tmp_path / "log"
    monkeypatch.setattr(log_queries, "command", lambda argv: command(["sh", "-c", f"echo called >> {log}; exec {argv[0]}"]))
    got = log_queries.command_costs(spark, small).collect()
    assert len(asked(str(log))) == sum(r.calls for r in got) == spark.read.parquet(f"{small}/documents.parquet").count()


def test_rate():
    with Caller(slow(0), Calls(in_flight=8, per_second=50)) as caller:
        began = time.monotonic()
        caller.all([str(i) for i in range(21)])
        assert time.monotonic() - began >= 20 / 50


def asked(log: str) -> list[str]:
    return Path(log).read_text().split() if Path(log).exists() else []


def logging_ask(log: str, dies: str | None = None, cost: int = 0, seconds: float = 0.0):
    """Notes each prompt; the worker dies at one of them."""

    def make():
        def ask(prompt: str) -> str:
            with open(log, "a") as f:
                f.write(prompt + "\n")
            time.sleep(seconds)
            if prompt == dies:
                time.sleep(0.5)  # what else is in flight may end
                os._exit(1)
            return json.dumps({"result": f"CAN_AUTO_RESPOND: {len(prompt)}%", "usage": {"input_tokens": cost, "output_tokens": cost}})

        return ask

    return make


def questions(spark, n: int):
    return spark.createDataFrame([(f"k{i}", f"q{i}", 200, "t") for i in range(n)], "key string, question string, target_len int, thread_id string")


def kept(spark, folder: str) -> dict:
    return {r.key: r for r in spark.read.json(f"{folder}/a-*").collect()}


def test_a_killed_task_keeps_its_answers(spark, tmp_path):
    """A worker dies midway; what was answered is there, and the rerun asks for the rest alone."""
    folder, log = str(tmp_path / "answers"), str(tmp_path / "log")
    with pytest.raises(Exception, match="(?s)crash|EOF|exit"):
        keep_answers(questions(spark, 40), folder, logging_ask(log, dies="q17"), Calls(in_flight=2, flush=1), tasks=2)
    first, before = kept(spark, folder), asked(log)
    assert 0 < len(first) < 40 and "k17" not in first and len(before) - len(first) <= 2 * 2  # at most what was in flight
    Path(log).unlink()
    assert keep_answers(questions(spark, 40), folder, logging_ask(log), Calls(in_flight=2), tasks=2) == 40
    assert sorted(asked(log)) == sorted(f"q{i}" for i in range(40) if f"k{i}" not in first)
    assert set(kept(spark, folder)) == {f"k{i}" for i in range(40)} and kept(spark, folder)["k3"].target_len == 200


def test_a_budget_stops_the_job(spark, tmp_path):
    """200 calls of a dollar each with 20 to spend: no more than what was in flight is asked beyond that, and all of it is kept."""
    folder, log = str(tmp_path / "answers"), str(tmp_path / "log")
    dollar = 250_000  # tokens in and out of a call, at 1 and 3 dollars a million
    budget = Budget(20.0, "some model", json_tokens, look=0.02)
    with pytest.raises(BudgetExceeded, match="answers are kept"):
        keep_answers(questions(spark, 200), folder, logging_ask(log, cost=dollar, seconds=0.3), Calls(in_flight=4, flush=1), tasks=2, budget=budget)
    n = len(asked(log))
    assert 20 < n <= 20 + 2 * 4 * 2 and len(kept(spark, folder)) == n and usd("some model", *spent(folder)) == n
    assert keep_answers(questions(spark, 200).limit(0), folder, logging_ask(log), budget=Budget(1e9, "some model", json_tokens)) == 0
    with pytest.raises(BudgetExceeded):
        keep_answers(questions(spark, 1), str(tmp_path / "other"), logging_ask(log), budget=budget, before=(dollar * 81, 0))


def test_a_rate_for_the_whole_job(spark, tmp_path):
    began = time.monotonic()
    assert keep_answers(questions(spark, 30), str(tmp_path / "answers"), logging_ask(str(tmp_path / "log")), tasks=3, per_second=30.0) == 30
    assert time.monotonic() - began >= 0.6


def samples(spark, path: str, n: int) -> None:
    rows = spark.createDataFrame([("t", "m" * 160 + f" {i:04d}", "/p/x", i) for i in range(n)], "thread_id string, target string, source_path string, pos int")
    full = rows.select(F.array().cast("array<struct<role:string,content:string>>").alias("context_messages"), "target", *(F.lit("x").alias(c) for c in ("project", "harness", "model", "cwd")), "source_path", "thread_id", "pos", F.lit("train").alias("split"))
    jsonl.write_samples(full, path)


def test_a_killed_labeling_run(spark, tmp_path):
    """Labels of a run that dies are stored as far as answers came; the next run asks for the others and loses none."""
    from loomline.operators.backends import enveloped

    where, store, log = str(tmp_path / "samples"), str(tmp_path / "labels"), str(tmp_path / "log")
    samples(spark, where, 30)

    def ask(dies: bool):
        def make():
            def one(prompt: str) -> str:
                n = prompt.split("mmm ")[1][:4] if "mmm " in prompt else prompt[-4:]
                with open(log, "a") as f:
                    f.write(n + "\n")
                if dies and n == "0011":
                    time.sleep(0.3)
                    os._exit(1)
                return json.dumps({"result": "CAN_AUTO_RESPOND: 66%"})

            return one

        return make

    with pytest.raises(Exception):  # noqa: B017  the worker's death, however it is told
        label_dataset(spark, [where], store, ask(True), "g", read=enveloped, calls=Calls(in_flight=1, flush=1), tasks=1)
    labels = LabelStore(spark, store)
    got = labels.read().count()
    assert 0 < got == len(asked(log)) - 1 and not (tmp_path / "labels" / "_answers").exists()
    Path(log).unlink()
    label_dataset(spark, [where], store, ask(False), "g", read=enveloped, calls=Calls(in_flight=4), tasks=2)
    assert labels.read().count() == 30 and len(asked(log)) == 30 - got
    assert {(r.score, r.method) for r in labels.read().collect()} == {(66, "grader:g")}


def labels_of(spark, *rows):
    return spark.createDataFrame([(k, score, "m", 1, "t") for k, score in rows], LABEL_SCHEMA)


def test_the_last_commit_wins_wherever_files_are(spark, tmp_path):
    store = LabelStore(spark, str(tmp_path / "a"), buckets=4)
    assert store.read().count() == 0
    store.append(labels_of(spark, ("x", 1), ("y", 1)))
    store.append(labels_of(spark, ("x", 2), ("z", 2)))
    store.add(labels_of(spark, ("y", 9), ("w", 3)))
    want = {"x": 2, "y": 1, "z": 2, "w": 3}
    assert {r.key: r.score for r in store.read().collect()} == want
    for f in sorted((tmp_path / "a").rglob("*"), reverse=True):  # copied in another order, and with other times
        if f.is_file():
            to = tmp_path / "b" / f.relative_to(tmp_path / "a")
            to.parent.mkdir(parents=True, exist_ok=True)
            shutil.copyfile(f, to)
            os.utime(to, (1000 + len(str(to)), 1000 + hash(f.name) % 999))
    copy = LabelStore(spark, str(tmp_path / "b"), buckets=4)
    assert {r.key: r.score for r in copy.read().collect()} == want
    copy.compact()
    assert {r.key: r.score for r in copy.read().collect()} == want and spark.read.parquet(str(tmp_path / "b" / "v2")).count() == 4
    copy.append(labels_of(spark, ("x", 7)))
    copy.prune()
    assert {r.key: r.score for r in copy.read().collect()} == want | {"x": 7} and not (tmp_path / "b" / "v1").exists()


def test_only_the_new_side_shuffles(spark, tmp_path):
    store = LabelStore(spark, str(tmp_path), buckets=4)
    store.append(labels_of(spark, *((f"k{i}", i) for i in range(500))))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = unlabeled(labels_of(spark, ("k1", 0), ("new", 0)), store.read())
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert [r.key for r in found.collect()] == ["new"] and plan.count("Exchange hashpartitioning") == 1, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_commit_numbers_are_taken_once(spark, tmp_path):
    store = LabelStore(spark, str(tmp_path))
    taken: list[int] = []
    threads = [threading.Thread(target=lambda: taken.append(store._commit())) for _ in range(8)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert len(set(taken)) == 8 and store._commit() > max(taken)


def test_readers_of_prompts_never_see_half_a_file(spark, tmp_path):
    folder, texts = str(tmp_path), {"a" * 20_000, "b" * 30_000}
    jsonl.write_prompt(spark, folder, "a" * 20_000, "p")
    (tmp_path / "prefix.txt").write_text("from elsewhere")
    done = threading.Event()

    def write() -> None:
        for i in range(10):
            jsonl.write_prompt(spark, folder, ("a" * 20_000, "b" * 30_000)[i % 2], "p")
        done.set()

    writer = threading.Thread(target=write)
    writer.start()
    seen = 0
    while not done.is_set() or not seen:
        current = max(tmp_path.glob("suffix/p.*.txt"))
        try:
            assert current.read_text() in texts
            seen += 1
        except FileNotFoundError:  # two versions older by now
            pass
    writer.join()
    prefix, suffixes = jsonl.read_prompts(spark, folder)
    assert prefix == "from elsewhere" and [tuple(r) for r in suffixes.collect()] == [("p", "b" * 30_000)] and len(list(tmp_path.glob("suffix/*"))) <= 4
