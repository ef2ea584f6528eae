"""Plans and costs of the loader and the frame: one scan, one shuffle, each turn sent and counted once."""

from __future__ import annotations

import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomline.config import Settings
from loomline.functions import tokens
from loomline.functions.tokens import CodePoints, FileTokenizer
from loomline.operators import labels, rendering, samples
from loomline.operators.stats import loader_stats
from loomline.plans import catalog, log_queries
from loomline.plans.fixtures import sessions
from loomline.sources import transcripts


def executed(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def scans(df) -> int:
    return df._jdf.queryExecution().sparkPlan().toString().count("FileScan ")


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_a_log_is_parsed_once(spark, small):
    for made in (catalog.transcript_parse(spark, small), log_queries.transcript_blocks(spark, small), log_queries.model_carry_forward(spark, small)):
        assert scans(made) == 1 and exchanges(made) == 1, made._jdf.queryExecution().executedPlan().toString()


def test_samples_and_statistics_read_once(spark, small):
    made = samples.build_samples(sessions(spark, small), make=CodePoints)
    assert scans(made.samples) == 1 and exchanges(made.samples) <= 3  # turns are made by conv_id, gated by source_path, and dealt by block after Python has counted them
    assert exchanges(samples.build_samples(sessions(spark, small)).samples) <= 2
    stats = loader_stats(made)
    assert scans(stats) == 1 and "collect_list" not in stats._jdf.queryExecution().executedPlan().toString()


def test_from_logs_to_samples_in_one_shuffle(spark, small):
    rows = spark.read.parquet(f"{small}/conversations.parquet")
    records = log_queries._records(rows, log_queries._BLOCKS)
    made = samples.build_samples(transcripts.fold(transcripts.parse_a(records), "claude", True)).samples
    assert scans(made) == 1 and exchanges(made) == 1 and made.count() > 0


def test_other_folders_are_never_opened(spark, tmp_path):
    """Files below `subagents`, and for dialect A those at the root, are left out as files are listed."""
    line = json.dumps({"type": "user", "sessionId": "s", "message": {"content": "hello there"}})
    for name in ("p/one.jsonl", "p/q/two.jsonl", "p/subagents/three.jsonl", "subagents/four.jsonl", "five.jsonl", "p/a b+c%.jsonl"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(line)
    logs = transcripts.load_a(spark, str(tmp_path))
    assert {Path(r.source_path).name for r in logs.threads.collect()} == {"one.jsonl", "two.jsonl", "a b+c%.jsonl"}
    read = logs.turns.select("source_path")
    read.collect()
    plan = read._jdf.queryExecution().executedPlan()

    def files(node) -> int:
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return files(node.executedPlan())
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            return files(node.plan())
        own = node.metrics().get("numFiles").get().value() if node.nodeName().startswith("Scan text") else 0
        return own + sum(files(node.children().apply(i)) for i in range(node.children().size()))

    assert files(plan) == 3


def long_thread(spark, n: int):
    turns = spark.range(n).select(F.lit("/p/x.jsonl").alias("source_path"), F.col("id").cast("int").alias("pos"), F.expr("case id % 3 when 0 then 'user' when 1 then 'assistant' else 'tool_result' end").alias("kind"), F.concat(F.lit("turn number "), "id").alias("text"), F.lit(None).cast("string").alias("tool_name"), F.lit(None).cast("string").alias("tool_input"))
    threads = spark.createDataFrame([("/p/x.jsonl", "t", "h", "m", "/w", None), ("/p/none.jsonl", "u", "h", "m", "/w", None)], "source_path string, thread_id string, harness string, model string, cwd string, started_at string")
    return samples.sessions(turns.repartition(5), threads)


@pytest.mark.parametrize("most", [1, 3, 150])
def test_frames_of_a_long_thread(spark, most):
    """Blocks of a thread give each turn what a window over the whole thread gives it."""
    n, s = 1000, Settings(context_turns=most)
    got = {r.pos: r for r in samples.build_samples(long_thread(spark, n), s=s, make=CodePoints).samples.collect()}
    assert set(got) == set(range(0, n, 3))
    shown = [("user", f"turn number {i}") if i % 3 == 0 else ("assistant", f"turn number {i}") if i % 3 == 1 else ("user", f"[tool_result] turn number {i}") for i in range(n)]
    for pos, r in got.items():
        assert [tuple(m) for m in r.context_messages] == shown[max(0, pos - most) : pos]
        assert r.context_tokens == [len(a) + len(b) + 4 for a, b in shown[max(0, pos - most) : pos]]
    made = samples.build_samples(long_thread(spark, n), s=s)
    assert made.threads.count() == 2 and loader_stats(made).first().threads_kept == 1


def shuffled(node) -> int:
    """Bytes that the shuffles of an executed plan have written."""
    if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return shuffled(node.executedPlan())
    if node.getClass().getSimpleName().endswith("QueryStageExec"):
        return shuffled(node.plan())
    own = node.metrics().get("shuffleBytesWritten").get().value() if node.nodeName().startswith("Exchange") else 0
    return own + sum(shuffled(node.children().apply(i)) for i in range(node.children().size()))


def test_what_is_sent_grows_with_turns_alone(spark):
    """Twice the turns are twice the bytes, and contexts of 150 turns send hardly more than those of one."""

    def sent(n: int, most: int) -> int:
        rows = spark.range(n).select(F.lit("/p").alias("source_path"), F.col("id").alias("pos"), F.lit("user").alias("kind"), F.concat(F.sha2(F.col("id").cast("string"), 512), F.sha2(F.concat("id", F.lit("b")), 512)).alias("text"), F.lit(None).cast("string").alias("tool_name"), F.lit(None).cast("string").alias("tool_input"))
        frames = samples.framed(rows.repartition(4), F.lit(True), ["pos"], Settings(context_turns=most))
        assert len(frames.select("pos", F.size("context_messages").alias("n")).collect()) == n
        frames.write.format("noop").mode("overwrite").save()
        frames.collect()
        return shuffled(frames._jdf.queryExecution().executedPlan())

    one, short, long = sent(1500, 150), sent(3000, 1), sent(3000, 150)
    assert 1.7 * one < long < 2.3 * one and long < 1.6 * short


def counted(log: str):
    def make():
        class Spy(CodePoints):
            def encode(self, text):
                with open(log, "a") as f:
                    f.write(text.replace("\n", " ")[:40] + "\n")
                return super().encode(text)

        return Spy()

    return make


def test_a_turn_is_encoded_once(spark, tmp_path):
    log = str(tmp_path / "encoded")
    make = counted(log)
    made = samples.build_samples(long_thread(spark, 400), make=make).samples
    got = rendering.render(made, F.lit("P"), F.lit(None).cast("string"), make, 2000)
    assert len(got.collect()) == 134 and "context_tokens" not in got.columns
    lines = [x for x in Path(log).read_text().splitlines() if "turn number" in x]
    assert len(lines) == 400 == len(set(lines))
    plain = rendering.render(made.drop("context_tokens"), F.lit("P"), F.lit(None).cast("string"), CodePoints, 2000)
    key = lambda r: r.pos
    assert sorted(got.collect(), key=key) == sorted(plain.collect(), key=key)


def test_vocabularies(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    texts = ["Hello there, world! 12345", "<|endoftext|> stays text", "é 日本 🙂", ""]
    ids = {}
    for name in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"):
        t = FileTokenizer(str(public_tokenizers.path(name)), public_tokenizers.PATTERN)
        ids[name] = t.encode_batch(texts)
        assert [t.decode(x) for x in ids[name]] == texts and t.encode(texts[0]) == ids[name][0]
    assert ids["byte_bpe_50k.json"] == ids["byte_bpe_50k.tiktoken"]


def brute_budget(head: str, context: list[tuple[str, str]], count, decode, most: int) -> list[tuple[str, str]]:
    """The newest messages that fit beside the system prompt; a last one that doesn't fit alone loses its beginning."""
    cost = lambda role, text: len(count(text)) + len(count(role)) + 4
    kept = list(context)
    while len(kept) > 1 and cost("system", head) + sum(cost(*m) for m in kept) + 2 > most:
        kept.pop(0)
    if len(kept) == 1 and cost("system", head) + cost(*kept[0]) + 2 > most:
        mark = "…[truncated]…"
        room = max(most - cost("system", head) - 6, 1) - len(count(mark)) - 8
        kept = [(kept[0][0], mark + (decode(count(kept[0][1])[-room:]) if room > 0 else ""))]
    return [("system", head), *kept]


def test_prompts_by_a_vocabulary(spark, small):
    tokenizer = log_queries._vocabulary()
    want = {}
    for r in log_queries._samples(spark, small).collect():
        head = f"PREFIX\n\nSUFFIX\n\nThis is a log from model {r.model} in harness {r.harness}, cwd {r.cwd}. Respond as the user."
        want[r.source_path, r.pos] = brute_budget(head, [tuple(m) for m in r.context_messages], tokenizer.encode, tokenizer.decode, 300)
    got = {(r.source_path, r.pos): [tuple(m) for m in r.messages] for r in log_queries.vocabulary_render(spark, small).collect()}
    assert got == want and any(len(m) < 3 for m in want.values())


def test_token_rows_by_a_vocabulary(spark, small):
    tokenizer = log_queries._vocabulary()
    got = {(r.source_path, r.pos): (r.input_ids, r.attention_mask, r.labels) for r in log_queries.vocabulary_rows(spark, small).collect()}
    want = {}
    for r in labels.training_rows(log_queries._samples(spark, small), spark.createDataFrame([], labels.LABEL_SCHEMA)).collect():
        prompt = "".join(f"<|{m.role}|>\n{m.content}\n" for m in r.messages) + "<|assistant|>\n"
        target = [*tokenizer.encode(r.target), 1]
        room = 2048 - len(target)
        if room >= 16:
            ids = tokenizer.encode(prompt)[-room:]
            pads = 2048 - len(ids) - len(target)
            want[r.source_path, r.pos] = (ids + target + [0] * pads, [1] * (2048 - pads) + [0] * pads, [-100] * len(ids) + target + [-100] * pads)
    assert got == want and got


def test_texts_are_encoded_in_slices():
    """A library keeps hundreds of bytes for a token of the texts it encodes at once, so a list of any length goes to it in slices."""

    class Counting:
        most = 0

        def encode_batch(self, texts):
            self.most = max(self.most, sum(map(len, texts)) if len(texts) > 1 else 0)
            return [[ord(c) for c in t] for t in texts]

    texts = ["", "ab", "x" * 5000, "", *(["word " * 20] * 9000), "y" * 700_000, ""]
    seen = Counting()
    found = [x for ids in tokens.encode_all(seen, texts) for x in ids]
    assert ["".join(map(chr, x)) for x in found] == texts and 0 < seen.most <= tokens.SLICE and found[2].nbytes == 20_000
    assert tokens.count_all(seen, texts) == [len(t) for t in texts] and tokens.count_all(seen, []) == []


def test_a_vocabulary_holds_one_text_at_a_time():
    """In a process of its own, since the peak counts: texts of over a token a character leave no trace in it. In the library's own batches they took 60 MB."""
    code = """
import resource
from loomline.functions.tokens import count_all
from loomline.plans.log_queries import _vocabulary
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10
tokenizer, texts = _vocabulary(), [chr(0x4E00 + i) + "日本語 " * 800 for i in range(200)]
before = peak()
print(sum(count_all(tokenizer, texts)), peak() - before)"""
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], capture_output=True, text=True, timeout=120, check=True)
    count, grown = map(int, done.stdout.split())
    assert count > 1_000_000 and grown < 25
