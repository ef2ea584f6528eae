from __future__ import annotations

import math
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from loomline.config import TRUNCATION_MARK
from loomline.functions import messages as M
from loomline.functions import scoring as S
from loomline.functions import text as X
from loomline.functions.keys import label_key, split_side
from loomline.functions.slugs import inference_slug, project_slug
from loomline.functions.tokens import CodePoints
from loomline.operators import labels as L
from loomline.operators import rendering as R
from loomline.operators import samples as P
from loomline.operators import scoring as J
from loomline.operators import stats


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this file


def each(spark, column, *values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("x"))).collect()]


SPACES = "".join(map(chr, [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, 0x2000, 0x2028, 0x202F, 0x205F, 0x3000]))


def test_white_space_is_pythons(spark):
    texts = [f"{SPACES}a{SPACES}b{SPACES}", SPACES, "", "x", "a​b"]
    assert each(spark, X.strip, *texts) == [t.strip() for t in texts]
    assert each(spark, X.lstrip, *texts) == [t.lstrip() for t in texts]
    assert each(spark, X.word_count, *texts) == [len(t.split()) for t in texts]


def test_redaction(spark):
    sk = "sk" + "-"
    secrets = [sk + "ant-" + "a" * 20, sk + "b" * 20, "gh" + "p_" + "c" * 30, "AK" + "IA" + "A1" * 8, "-----BEGIN RSA " + "PRIVATE KEY-----\nx\n-----END", "Bearer " + "d" * 20]
    for s in secrets:
        assert each(spark, X.redact, f"a {s} b {s}") == ["a [REDACTED_SECRET] b [REDACTED_SECRET]"]
    assert each(spark, X.redact, sk + "b" * 19, "ta" + sk + "b" * 25, secrets[4] + " RSA-----") == [sk + "b" * 19, "ta[REDACTED_SECRET]", "[REDACTED_SECRET] RSA-----"]


def test_caps(spark):
    a, b = "x" * 4000, "h" * 2000 + "m" * 1001 + "t" * 1000
    assert each(spark, X.cap_message, a, b) == [a, "h" * 2000 + "\n…[TRUNCATED 1001 chars]…\n" + "t" * 1000]
    assert each(spark, X.elide_tool_result, "y" * 199, "y" * 200) == ["y" * 199, "[tool_result: 200 bytes]"]


def test_tags_and_hooks(spark):
    texts = [' "[_HIDE_TEST_] go', "'[ai-writing-tool] x", "[oompa] x", "[oompa:a:b] x", "[oompa:a:b x", "say [_HIDE_TEST_]", None, "  [_HIDE_TEST_]"]
    assert each(spark, X.hidden_tag, *texts) == ["hide_test", "ai_writing", "worker", "worker", None, None, None, "hide_test"]
    assert each(spark, X.hook_injected, " Caveat: x", "\n<system-reminder>", "caveat:", None) == [True, True, False, False]


def test_user_predicate(spark):
    reason = lambda x: X.user_drop_reason(x, F.lit("/srv"))
    assert each(spark, reason, "ok then", "ok", "  ", None, "Caveat: no good", "two\x1cwords") == [None, "too_short", "too_short", "too_short", "hook_injected", None]
    at = lambda x: X.user_drop_reason(F.lit("go on"), x)
    assert each(spark, at, "/home/user/git/oompa", "/home/user/git/oompa/x", "/home/user/git/oompas", "/a.ww1-i2/b", "/a.ws0f-w1-i2", "/a.ww1-i2b", "", None) == ["worker_cwd", "worker_cwd", None, "worker_worktree", "worker_worktree", None, None, None]


def test_slugs(spark):
    paths = ["", None, "/home/user/git/a/b", "/home/user/b/c", "/srv/x", "/home/user/git/conductor-workspaces/w.ww1-i2/z", "/home/user/git/a.ww3-i4/b", "/home/user/.x/y", "/home/user/git/", "/home/user/git/conductor-workspaces", "/mnt/home/user/git/q.ws1f-w2-i3"]
    assert each(spark, project_slug, *paths) == ["_unknown", "_unknown", "a", "b", "srv", "w.ww1-i2", "a", "_unknown", "_unknown", "conductor-workspaces", "mnt"]
    assert each(spark, inference_slug, *paths) == ["_unknown", "_unknown", "a", "home", "srv", "w", "a", "home", "_unknown", "conductor-workspaces", "q"]


def test_length_scores(spark):
    n = [0, 150, 151, 800, 801, 900, 5000]
    assert each(spark, S.zone, *n, kind="int") == ["short", "short", "middle", "middle", "long", "long", "long"]
    assert each(spark, S.heuristic_score, *n, kind="int") == [100, 90, 70, 70, 50, round(50 * math.exp(-0.2)), 0]


@pytest.mark.parametrize(("n", "want"), [(10, 1.0), (20, 1.0), (5, 1.0), (40, 0.0), (0, 0.0), (2, 0.0), (10_240, 0.0), (30, 1 - (math.log2(3) - 1))])
def test_length_band(spark, n, want):
    assert each(spark, lambda x: S.length_score(x, F.lit("g" * 10)), "x" * n)[0] == pytest.approx(want)


def test_choices_and_scores(spark):
    assert each(spark, S.parse_choice, "The answer is B", "b", "", "zzz", None) == ["A", "B", None, None, None]
    assert each(spark, S.parse_score, "CAN_AUTO_RESPOND: 70%", "x CAN_AUTO_RESPOND:5", "CAN_AUTO_RESPOND: 999", "none", None) == [70, 50, 90, None, None]
    assert each(spark, lambda x: S.judge_score(x, F.lit("A")), "A", "B", None) == [0.0, 1.0, 0.5]


def test_cosine(spark):
    vectors = [[1.0, 0.0], [-1.0, 0.0], [0.0, 0.0], [1.0, 1.0]]
    got = each(spark, lambda x: S.clip(S.cosine(x, F.array(F.lit(1.0), F.lit(0.0)))), *vectors, kind="array<float>")
    assert got == pytest.approx([1.0, 0.0, 0.0, 2**-0.5])


def messages(spark, *pairs, **more):
    kind = "array<struct<role:string,content:string>>"
    return spark.createDataFrame([([*pairs], *more.values())], ", ".join([f"context_messages {kind}", *(f"{k} string" for k in more)]))


def sample(spark, *pairs):
    return messages(spark, *pairs, target="reply", model="m", harness="h", cwd="/c")


def shown(spark, column, *pairs):
    return messages(spark, *pairs).select(column(F.col("context_messages"))).first()[0]


def test_message_texts(spark):
    pairs = [("user", "a"), ("system", "s"), ("assistant", "b")]
    assert shown(spark, M.judge_context, *pairs) == "[user]\na\n\n[system]\ns\n\n[assistant]\nb"
    assert shown(spark, M.thread_text, *pairs) == "[USER]: a\n\n[SYSTEM]: s\n\n[ASSISTANT]: b"
    assert shown(spark, lambda m: M.command_text(m, F.lit("p"))) == "p"
    assert shown(spark, M.last_visible, *pairs) == "b" and shown(spark, M.last_visible) is None
    assert shown(spark, M.last_visible, ("user", "x" * 401)) == "x" * 400 + "…"
    assert shown(spark, M.provider_system, ("system", "p"), ("user", "u"), ("system", "q")) == "q"
    assert shown(spark, lambda m: M.provider_system(m, True), ("system", "p"), ("system", "q")) == "p"
    long = shown(spark, M.labeler_text, *[("user", "x" * 1001)] * 31)
    assert long.split("\nuser: ")[0] == "user: " + "x" * 666 + "\n…[truncated]…\n" + "x" * 334 and long.count("user: ") == 30
    assert each(spark, M.coerce_role, "tool", "user", None) == ["user", "user", "user"]
    assert each(spark, lambda x: M.strip_prefix(x, F.lit("ab")), "ab\n\nc", "xab") == ["c", "xab"]


def rendered(spark, most, *pairs, suffix=None):
    rows = R.render(sample(spark, *pairs), F.lit("PREFIX"), F.lit(suffix), CodePoints, most)
    return [(m.role, m.content) for m in rows.first().messages]


LINE = "This is a log from model m in harness h, cwd /c. Respond as the user."


def test_render_keeps_the_system_and_the_newest(spark):
    pairs = [("user", "u" * 40), ("assistant", "a" * 40), ("user", "last")]
    head = len(f"PREFIX\n\n{LINE}") + len("system") + 4
    assert rendered(spark, 10_000, *pairs) == [("system", f"PREFIX\n\n{LINE}"), *pairs]
    assert rendered(spark, 10_000, *pairs, suffix="")[0][1] == f"PREFIX\n\n\n\n{LINE}"
    fits = head + 2 + (4 + 4 + 4) + (40 + 9 + 4)
    assert rendered(spark, fits, *pairs)[1:] == pairs[1:] and rendered(spark, fits - 1, *pairs)[1:] == pairs[2:]
    assert rendered(spark, 10) == [("system", f"PREFIX\n\n{LINE}")]
    text = "START " + "w" * 500 + " END"
    cut = rendered(spark, head + 106, ("user", text))[1][1]
    keep = 100 - len(TRUNCATION_MARK) - 8
    assert cut == TRUNCATION_MARK + text[-keep:]
    assert rendered(spark, 50, ("user", text))[1] == ("user", TRUNCATION_MARK)


def test_optimizer_example(spark):
    rows = R.render(sample(spark, ("user", "u"), ("system", "other")), F.lit("P"), F.lit(None).cast("string"), CodePoints)
    assert tuple(R.optimizer_examples(rows).first()) == (f"P\n\n{LINE}", "[USER]: u", "reply")


def test_keyed_examples(spark):
    rows = spark.createDataFrame([("f2", 4, "t2"), ("f1", 9, "t1"), ("f1", 3, "t1")], "source_path string, pos int, thread_id string")
    rows = rows.crossJoin(sample(spark, ("user", "u")).withColumn("project", F.lit("p")))
    made = R.build_examples(rows, F.lit("P"), F.lit(None).cast("string"), "val", CodePoints)
    assert sorted(r.sample_key for r in made.collect()) == ["val:t1:0", "val:t1:1", "val:t2:2"]
    back = R.example_contexts(spark.createDataFrame([("val:t1:1", "x"), ("gone", "y")], "sample_key string, reply string"), P.sample_key(rows, "val"))
    assert {r.reply: len(r.context_messages) for r in back.collect()} == {"x": 1, "y": 0}
    with pytest.raises(ValueError, match="3"):
        R.build_examples(rows, F.lit("P"), F.lit(None).cast("string"), "val", CodePoints, "p")


def test_label_mask(spark):
    rows = spark.createDataFrame([([1, 2, 3], [7, 8], 20), (list(range(1, 31)), [7, 8], 20), ([1], [7] * 3, 20), ([1], [7] * 4, 20)], "p array<int>, t array<int>, n int")
    got = [r[0] for r in rows.select(R.mask_tokens(F.col("p"), F.col("t"), 2, 0, 20)).collect()]
    assert (got[0].input_ids, got[0].labels, got[0].attention_mask) == ([1, 2, 3, 7, 8, 2] + [0] * 14, [-100] * 3 + [7, 8, 2] + [-100] * 14, [1] * 6 + [0] * 14)
    assert got[1].input_ids == list(range(14, 31)) + [7, 8, 2] and got[1].labels[:17] == [-100] * 17
    assert got[2] is not None and got[3] is None  # 16 and 15 tokens are left for the prompt


def test_token_rows(spark):
    rows = spark.createDataFrame([([("system", "s"), ("user", "u")], "ok", 90, "p"), ([("system", "s")], "x" * 90, 90, "p")], "messages array<struct<role:string,content:string>>, target string, target_score int, project string")
    got = R.token_rows(rows, CodePoints, 2, 0, 80).collect()
    assert len(got) == 1 and len(got[0].input_ids) == len(got[0].labels) == 80 and [i for i in got[0].labels if i != -100] == [ord("o"), ord("k"), 2]


def replies(spark, generated="gen text", gold="gold text"):
    return messages(spark, ("user", "hi"), key="k", generated=generated, gold=gold)


def picks(which):
    """A judge that finds its choice by the text."""
    return lambda: lambda prompt: "A" if f"A) {which}" in prompt else "B"


def fails():
    def judge(_):
        raise RuntimeError

    return judge


def same(texts):
    return np.array([[1.0, 0.0]] * len(texts), np.float32)


def opposite(texts):
    return np.array([[1.0, 0.0] if t.startswith("gen") else [-1.0, 0.0] for t in texts], np.float32)


@pytest.mark.parametrize("seed", range(4))
def test_scores(spark, seed):
    score = lambda judge, embedder: J.score_replies(replies(spark), judge, embedder, seed).first()
    won, lost = score(picks("gen"), lambda: same), score(picks("gold"), lambda: opposite)
    assert (won.judge, won.embed, won.length) == (1.0, 1.0, 1.0) and won.combined == pytest.approx(1.0)
    assert (lost.judge, lost.embed) == (0.0, 0.0) and lost.combined == pytest.approx(0.1)
    assert score(fails, lambda: same).judge == 0.5 and score(lambda: lambda _: "??", lambda: fails()).embed == 0.0


def test_labels(spark):
    rows = spark.createDataFrame([("t", "a b", "p", 1, [("user", "x")]), ("t", "a b", "p", 0, []), ("t", "m" * 200, "p", 2, [("user", "q")]), ("t", "l" * 900, "p", 3, []), ("t", "n" * 300, "p", 4, [])], "thread_id string, target string, source_path string, pos int, context_messages array<struct<role:string,content:string>>")
    keyed = L.keyed(rows)
    made = {r.method: r.score for r in L.heuristic_labels(keyed).collect()}
    assert made == {"heuristic_short": 100, "heuristic_long": round(50 * math.exp(-0.2))}
    grader = lambda: lambda prompt: "CAN_AUTO_RESPOND: 61%" if "user: q" in prompt and "mmm" in prompt else "none"
    none = L.heuristic_labels(keyed).limit(0)
    got = L.graded_labels(keyed, none, grader, "g").collect()
    assert [(r.score, r.method, r.target_len) for r in got] == [(61, "grader:g", 200)]
    assert L.graded_labels(keyed, L.graded_labels(keyed, none, grader, "g"), grader, "g").count() == 0
    assert L.graded_labels(keyed, none, fails, "g").count() == 0
    hist = {r.zone: (r.n, r.longest) for r in L.zone_histogram(keyed).collect()}
    assert hist == {"short": (2, 3), "middle": (2, 300), "long": (1, 900)}


def test_support_and_generation(spark):
    rows = spark.createDataFrame([("p",)] * 30 + [("q",)] * 29, "project string")
    assert P.require_support(rows, "p").count() == 30
    with pytest.raises(ValueError, match="29"):
        P.require_support(rows, "q")
    one = messages(spark, ("user", "u")).withColumnRenamed("context_messages", "messages")
    assert J.generate(one, {"openai/": lambda: lambda t: f" {t} "}, "openai/x").first().reply == "[USER]\nu"
    with pytest.raises(ValueError, match="backend"):
        J.generate(one, {}, "x")


def test_costs(spark):
    usage = spark.createDataFrame([("openai/gpt-4o", 1_000_000, 100_000), ("openai/gpt-4o", 0, 100_000), ("new", 1_000_000, 1_000_000)], "model string, prompt_tokens long, completion_tokens long")
    got = {r.model: r.usd for r in stats.costs(usage, stats.price_table(spark)).collect()}
    assert got == pytest.approx({"openai/gpt-4o": 2.5 + 2.0, "new": 4.0})
    assert stats.check_budget(usage, stats.price_table(spark), 9) == pytest.approx(8.5)
    with pytest.raises(stats.BudgetExceeded):
        stats.check_budget(usage, stats.price_table(spark), 8)


def test_keys(spark):
    sides = each(spark, split_side, *map(str, range(2000)))
    assert 60 < sides.count("val") < 140 and set(sides) == {"train", "val"}
    assert each(spark, lambda x: label_key(F.lit("t"), x), "abc") == ["t:a9993e364706"]
