from __future__ import annotations

import json
import sys

import pytest

from pyspark.sql import functions as F

from loomline.operators.backends import command, enveloped, plain, usage
from loomline.operators.calls import BudgetExceeded
from loomline.plans.cli import main
from loomline.sources.label_store import LabelStore


def test_jobs(spark, tmp_path, capsys):
    (tmp_path / "logs" / "p").mkdir(parents=True)
    say = lambda t: json.dumps({"type": "user", "sessionId": "s", "message": {"content": t}})
    (tmp_path / "logs" / "p" / "x.jsonl").write_text("\n".join([say("do this first"), say("m" * 100 + " " + "n" * 200), say("no")]))
    samples, labels, rows = (str(tmp_path / x) for x in ("samples", "labels", "rows"))
    main(["build", "--root-a", str(tmp_path / "logs"), "--out", samples], spark)
    main(["report", "--root-a", str(tmp_path / "logs"), "--since", "2024-01-01"], spark)
    assert "too_short" in capsys.readouterr().out
    main(["label", "--samples", samples, "--labels", labels, "--dry-run"], spark)
    grader = f"{sys.executable} -c \"print('CAN_AUTO_RESPOND: 55%')\""
    main(["label", "--samples", samples, "--labels", labels, "--grader", grader], spark)
    assert sorted(r.score for r in LabelStore(spark, labels).read().collect()) == [55, 99]
    main(["rows", "--samples", samples, "--labels", labels, "--out", rows], spark)
    assert sorted(r.target_score for r in spark.read.parquet(rows).collect()) == [55, 99]


def test_failing_command():
    with pytest.raises(Exception, match="non-zero"):
        command([sys.executable, "-c", "raise SystemExit(3)"])()("x")


def test_answers_in_an_envelope(spark):
    outputs = ['{"result": "yes", "is_error": false, "usage": {"input_tokens": 7, "output_tokens": null}}', '{"result": "no credit", "is_error": true, "usage": {"input_tokens": 3}}', '{"result": "plain"}', "no json", None]
    rows = spark.createDataFrame(list(enumerate(outputs)), "i int, x string").orderBy("i").select(enveloped(F.col("x")).alias("a"), usage(F.col("x")).alias("u"), plain(F.concat(F.lit(" \n"), "x", F.lit("\n\n"))).alias("p"))
    assert [(r.a, *r.u) for r in rows.collect()] == [("yes", 7, 0), (None, 3, 0), ("plain", 0, 0), (None, 0, 0), (None, 0, 0)]
    assert [r.p for r in rows.collect()] == outputs
    assert command([sys.executable, "-c", "print(input())"])()("hello") == "hello\n"


def test_a_budget_on_the_command_line(spark, tmp_path):
    """The answers that were paid for become labels; the job says that it stopped, and a rerun with more to spend has nothing left to ask."""
    (tmp_path / "logs" / "p").mkdir(parents=True)
    say = lambda i: json.dumps({"type": "user", "sessionId": "s", "message": {"content": f"question {i} " + "n" * 200}})
    (tmp_path / "logs" / "p" / "x.jsonl").write_text("\n".join(map(say, range(3))))
    samples, labels, asked = (str(tmp_path / x) for x in ("samples", "labels", "asked"))
    main(["build", "--root-a", str(tmp_path / "logs"), "--out", samples], spark)
    script = tmp_path / "grader.py"
    script.write_text(f"open({asked!r}, 'a').write('x'); print('{{\"result\": \"CAN_AUTO_RESPOND: 77%\", \"usage\": {{\"input_tokens\": 1000000, \"output_tokens\": 0}}}}')")
    job = ["label", "--samples", samples, "--labels", labels, "--grader", f"{sys.executable} {script}", "--answers", "json", "--model", "openai/gpt-4o", "--in-flight", "1", "--budget"]
    with pytest.raises(BudgetExceeded, match="spent"):
        main([*job, "2.4999"], spark)
    stored = {r.score for r in LabelStore(spark, labels).read().collect()}
    assert stored == {77} and (tmp_path / "asked").stat().st_size == LabelStore(spark, labels).read().count()
    main([*job, "100"], spark)
    assert LabelStore(spark, labels).read().count() == 3 == (tmp_path / "asked").stat().st_size
