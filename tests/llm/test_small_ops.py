from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomline.llm import ann, common, mixing, packing
from pyspark.sql import functions as F

from loomline.llm.exact_dedup import _set_twice, exact_dedup, may_repeat, sifted
from loomline.llm.queries import tokenizer_path
from loomline.llm.url_filter import PATTERN_RULES, domain_rule, pattern_rule, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab \n\té", max_size=12)), max_size=8))
def test_spans_are_the_words_of_each_text(texts):
    data, at = common.flat(pa.array(texts, pa.string()))
    start, end, own = common.spans(data, at)
    body = data.tobytes()
    found = [(int(o), body[s:e].decode()) for s, e, o in zip(start, end, own, strict=True)]
    assert found == [(i, w) for i, t in enumerate(texts) for w in WORD.findall(t or "")]
    hashes = common.span_hash(common.prefix_sums(data), start, end)
    assert len({w for _, w in found}) == len(set(hashes.tolist()))


def test_exact_dedup(messy, empty):
    rows = messy.collect()
    got = exact_dedup(messy).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for r in rows:
        groups[hashlib.sha256(norm(r.text).encode()).hexdigest()].append(r.doc_id)
    assert len(got) == len(rows)
    for sha, ids in groups.items():
        own = [g for g in got if g.text_sha256 == sha]
        least = min((i for i in ids if i is not None), default=None)
        assert sorted(map(str, ids)) == sorted(str(g.doc_id) for g in own)
        assert {(g.keep_id, g.group_size) for g in own} == {(least, len(ids))}
        assert [g.doc_id for g in own if g.kept] == [least]
    assert exact_dedup(messy, bits_per_row=0, max_bits=64).filter("kept").count() == len(groups)  # full filters only cost traffic
    key = lambda rows: sorted(map(str, rows))
    assert key(exact_dedup(messy, per_range=8, max_bits=128).collect()) == key(got)  # nine ranges with a filter each
    assert exact_dedup(empty).count() == 0


@pytest.mark.parametrize("ranges", [1, 16, 37])
def test_few_unique_hashes_shuffle_at_any_number_of_ranges(spark, ranges):
    """Unique rows pass, repeated ones never do, and one job serves all ranges."""
    rows = 40_000
    some = spark.range(rows).select("id", F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("sha"), F.col("id").alias("uid")).withColumn("h", F.xxhash64("sha"))
    sift = lambda df, n: sifted(df, n, 16, -(-n // ranges), 1 << 25)
    assert sift(some, rows).filter("may_repeat").count() < 0.05 * rows
    mixed = some.unionByName(some.filter("id < 2000").withColumn("uid", F.col("uid") + rows))
    got = sift(mixed, rows + 2000)
    assert got.filter("may_repeat and id < 2000").count() == 4000
    assert got.filter("may_repeat and id >= 2000").count() < 0.08 * rows


def test_a_frequent_hash_is_sent_a_few_times(spark):
    """A third of all rows alike: a chunk names their place once, and their range's task holds no more for it."""
    rows = spark.range(30_000, numPartitions=3).select(F.lit(0).alias("range"), F.when(F.col("id") % 3 == 0, 5).otherwise(F.pmod(F.xxhash64("id"), F.lit(1 << 27))).cast("int").alias("place"))
    assert {(r.range, r.place) for r in may_repeat(rows, 1, 1 << 15).filter("place = 5").collect()} == {(0, 5)}
    assert may_repeat(rows, 1, 1 << 15).count() < 0.05 * 20_000


def test_places_set_twice_against_counting():
    r = np.random.default_rng(5)
    for words in (1, 4, 64):
        chunks = [r.integers(0, words * 4096, r.integers(1, 200)) for _ in range(4)]
        every = np.concatenate(chunks)
        n = defaultdict(int)
        for x in every.tolist():
            for p in {(x >> 12, x & 63), (x >> 12, x >> 6 & 63)}:
                n[p] += 1
        right = {x for x in every.tolist() if n[x >> 12, x & 63] > 1 and n[x >> 12, x >> 6 & 63] > 1}
        sent = np.concatenate([np.unique(c) for c in chunks]).astype(np.int32)
        again = np.concatenate([np.unique(c)[np.unique(c, return_counts=True)[1] > 1] for c in chunks]).astype(np.int32)
        assert set(_set_twice(sent, again, words).tolist()) == right


def test_url_filter(spark):
    urls = ["https://a.example.net/en/1", "http://EXAMPLE.net/de/", "http://x.net", "http://x.net?q=/", "https://www.example.com/de/x?y", "https://example.com/DE/x", "ftp://org/fr/", "https://notexample.net.org/fr/z", "no scheme", "", None, "https://b.io/ads/1", "https://b.io/x?PHPSESSID=1", "https://u@h.net:80/p#f", "://", "https://a.example.net/en/1"]
    rows = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, rule int")
    got = {r.page_id: r for r in url_filter(rows).collect()}
    assert len(got) == len(urls)
    assert [got[i].rule for i in range(len(urls))] == ["example.net/en/", "net/", None, None, "example.com/de/", None, "org/fr/", "org/fr/", None, None, None, None, None, None, None, "example.net/en/"]
    assert [got[i].verdict for i in range(len(urls))] == ["allow", "block", "allow", "allow", "block", "allow", "allow", "allow", "allow", "allow", "allow", "block", "block", "allow", "allow", "allow"]
    assert (got[1].host, got[1].path, got[13].host, got[10].host, got[14].path) == ("example.net", "/de/", "u@h.net:80", "", "")
    assert url_filter(rows.limit(0)).count() == 0
    assert url_filter(rows, ()).filter("verdict = 'block'").count() == 0
    only = (domain_rule("b.io", "block"), pattern_rule("x", "x", "x"))
    assert {r.page_id for r in url_filter(rows, only).filter("verdict = 'block'").collect()} == {11, 12, 2, 3, 4, 5}


def test_null_urls_are_spread(spark):
    rows = spark.range(3000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 100 == 0, F.lit("http://x.net/")).alias("url"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = url_filter(rows)
        assert re.search(r"hashpartitioning\(url#\d+, spread#\d+", got._jdf.queryExecution().executedPlan().toString())
        assert {(r.verdict, r["count"]) for r in got.groupBy("verdict").count().collect()} == {("allow", 2970), ("block", 30)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_each_alternative_of_a_rule_is_fetched(spark):
    names = ["ad", "ads", "xad", "adsx", "sessionid", "jsessionid", "phpsessionid", "xsessionid", "phpsessid", "print", "banner", "login", "signup", "cart", "checkout"]
    urls = [u for n in names for u in (f"https://b.io/{n}/1", f"https://b.io/{n}", f"https://b.io/x?{n}=1", f"https://b.io/x;{n.upper()}=y", f"https://b.io/x?a=1&{n}=1")] + ["https://b.io/a.ics?x", "https://b.io/ads/x;jsessionid=1?sessionid=2", "https://b.io/ad/ads/"]
    got = {r.page_id: r for r in url_filter(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    for i, u in enumerate(urls):
        want = sorted(r.name for r in PATTERN_RULES if re.search(r.regex, u.lower()))
        assert ((got[i].patterns or ""), got[i].verdict) == (",".join(want), "block" if want else "allow"), u
    both = (pattern_rule("both", "/(?:a|b)/c/", "a|b c"),)
    assert {r.page_id for r in url_filter(spark.createDataFrame([(0, "h://x/a/c/"), (1, "h://x/b/c/"), (2, "h://x/c/")], "page_id long, url string"), both).filter("verdict = 'block'").collect()} == {0, 1}


def test_encoding_matches_whole_texts():
    r = random.Random(3)
    bits = ["a", "'s", " ", "  ", "\n", "\t", "é", "日本", " ", "　", "12", "!?", "<|endoftext|>", "word", "\x1c", " x", "ſ", "İ"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 25))) for _ in range(300)] + [None, "", " ", "x ", " y"]
    full = Tokenizer.from_file(tokenizer_path())
    for ranks in (None, tokenizer_path("byte_bpe_50k.tiktoken")):
        ids, at = packing.token_ids(*common.flat(pa.array(texts, pa.string())), tokenizer_path(), ranks)
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == full.encode(t or "", add_special_tokens=False).ids, t


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=40))
def test_first_fit_decreasing(sizes):
    bins, offsets = packing.first_fit_decreasing(np.array(sizes), 20)
    want: list[int] = []
    for i in np.argsort(-np.array(sizes), kind="stable"):
        j = next((j for j, used in enumerate(want) if used + sizes[i] <= 20), len(want))
        if j == len(want):
            want.append(0)
        assert (bins[i], offsets[i]) == (j, want[j])
        want[j] += sizes[i]


def test_pack(messy, empty):
    full = Tokenizer.from_file(tokenizer_path())
    got = packing.pack(messy, tokenizer_path(), tokenizer_path("byte_bpe_50k.tiktoken"), capacity=64, per_group=8, with_ids=True).collect()
    want = Counter()
    for r in messy.collect():
        ids = [*full.encode(r.text or "", add_special_tokens=False).ids, 1]
        for s in range(0, len(ids), 64):
            want[r.doc_id, s, tuple(ids[s : s + 64]), len(ids)] += 1
    assert want == Counter((g.doc_id, g.start, tuple(g.ids), g.doc_tokens) for g in got)
    sequences = defaultdict(list)
    for g in got:
        assert g.ids_crc32 == zlib.crc32(np.array(g.ids, "<u4").tobytes()) and g.length == len(g.ids)
        sequences[g.sequence_id].append((g.offset, g.length))
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 64
    assert packing.pack(empty, tokenizer_path()).count() == 0


def test_a_long_document_is_dealt_to_many_groups(spark):
    docs = spark.createDataFrame([(None, "word " * 5000), *((i, f"short text {i}") for i in range(40))], "doc_id long, text string")
    got = packing.pack(docs, tokenizer_path(), capacity=64, per_group=4).collect()
    groups = Counter(g.sequence_id >> 32 for g in got if g.doc_id is None and g.length == 64)
    assert len(groups) > 5 and max(groups.values()) < sum(groups.values()) / 3
    assert len({g.sequence_id for g in got if g.length == 64}) == sum(groups.values())


def test_running_totals_in_two_steps(spark):
    rows = [(s, (i * 37) % 11, i, i % 5) for s in (0, 1) for i in range(200)]
    got = mixing.running(spark.createDataFrame(rows, "source_no int, part long, i long, n long"), "n", "part", ["i"]).collect()
    want, total = {}, Counter()
    for s, part, i, n in sorted(rows):
        want[s, i] = total[s]
        total[s] += n
    assert {(r.source_no, r.i): r["at"] for r in got} == want


def test_rows_without_ids_spread_by_their_texts(spark):
    docs = spark.createDataFrame([(None, f"some words {i}", "s") for i in range(400)], "doc_id long, text string, source string")
    parts = Counter(r.k >> 60 for r in mixing.word_counts(docs, "doc_id", "text", "source").collect())
    assert max(parts.values()) < 100
    assert sum(r.taken for r in mixing.mix_counts(docs).collect()) == 1200


def test_mix(messy, empty):
    rows = messy.collect()
    got = mixing.mix_counts(messy).collect()
    assert sorted((str(r.doc_id), len(WORD.findall(r.text or ""))) for r in rows) == sorted((str(g.doc_id), g.size) for g in got)
    assert all(0 <= g.taken <= 3 * g.size for g in got)
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip([sizes[s] for s in order], mixing.targets([sizes[s] for s in order]), strict=True))
    taken = Counter()
    for g in got:
        assert g.target == pytest.approx(want[g.source_size])
        taken[g.source_size] += g.taken
    for size, target in want.items():
        assert abs(taken[size] - target) <= 1 + size / 1000
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_counts(messy).collect()))
    assert mixing.mix_counts(empty).count() == 0
    blank = messy.withColumn("text", messy.lang)  # one-word texts
    assert mixing.mix_counts(blank.filter("text is null")).selectExpr("sum(taken)").first()[0] == 0


def test_mixed_documents_hold_what_is_taken(messy):
    out = mixing.mixed_documents(messy)
    assert out.columns == messy.columns
    taken = Counter()
    for r in out.collect():
        assert r.n_chars == len(r.text)
        taken[r.doc_id] += len(WORD.findall(r.text))
    want = Counter()
    for g in mixing.mix_counts(messy).collect():
        want[g.doc_id] += g.taken
    assert +want == +taken


def test_mixed_rows_keep_their_own_columns(spark):
    """Rows alike in id and text, but not in source, lang or what is null, come out with their own."""
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text, "a", "en"), (1, text, "b", "de"), (1, text, None, "fr"), (1, text, "fr", None), (2, text, "a", "en"), (1, text, "a", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    out = mixing.mixed_documents(docs)
    taken = Counter()
    for r in out.collect():
        assert (r.doc_id, r.source, r.lang) in {(i, s, x) for i, _, s, x in rows}
        taken[r.source] += len(WORD.findall(r.text))
    plan = mixing.plan(docs)
    uses = plan.slots.groupBy("source_no", "block_no").count().join(plan.pieces, ["source_no", "block_no"]).join(plan.rows.select("uid", "source_size", "target"), "uid")
    assert sum(taken.values()) == uses.selectExpr("sum(count * words)").first()[0] and set(taken) == {"a", "b", "fr", None}


def test_targets():
    assert mixing.targets([100, 100, 100]) == [187.5, 75.0, 37.5]
    assert mixing.targets([10, 100, 100]) == [30.0, 120.0, 60.0]
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0.0, 0.0]


def test_permutations_are_whole():
    for size in (1, 2, 3, 10, 257, 5000):
        for key in (0, 7, 1 << 40):
            out = mixing.permuted(np.arange(size), np.full(size, size), np.full(size, key, np.uint64))
            assert sorted(out.tolist()) == list(range(size))


def test_nearest(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 10))
    x[700:760] = x[3]
    rows = [(i, v.tolist(), 0, "q") for i, v in enumerate(x)]
    rows += [(None, x[0].tolist(), 0, "q"), (1600, None, 0, "q"), (1700, [0.0] * 10, 0, "q"), (1800, [float("nan")] * 10, 0, "q"), (1801, [None] * 10, 0, "q"), (1802, [float("inf")] + [1.0] * 9, 0, "q"), (1900, [1.0], 0, "q"), (1901, [], 0, "q")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, query_id string")
    got = defaultdict(list)
    for r in ann.search(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert sorted(got) == list(range(0, 1500, 100))
    hit = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(d)), d))[:10]
        hit += len({i for i, _ in found} & set(best.tolist()))
        assert len(found) == 10 and all(s == pytest.approx(d[i], abs=1e-12) for i, s in found)
        assert found == sorted(found, key=lambda t: (t[1], t[0]))
    assert hit >= 0.9 * 150
    assert [i for i, _ in got[700]][:3] == [3, 701, 702]  # ties go to the smaller id
    assert ann.search(df.limit(0)).count() == 0
    assert {r.vec_id for r in ann.search(df.filter("vec_id in (100, 7, 9)")).collect()} == {7, 9}


def test_single_precision_is_measured_in_double(spark):
    """Vectors of floats are sent as such; distances are those of their values as doubles."""
    x = np.random.default_rng(2).normal(size=(300, 7)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    for r in ann.search(df).collect():
        assert r.score == pytest.approx(np.sqrt(((x[r.vec_id].astype(float) - x[r.query_id].astype(float)) ** 2).sum()), rel=1e-14)


def test_nearest_in_one_large_block_of_clusters(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(5, 32))
    x = centres[rng.integers(0, 5, 6000)] + 0.1 * rng.normal(size=(6000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = defaultdict(set)
    for r in ann.search(df, config=ann.Config(least_block=65_536, rerank=20)).collect():
        found[r.query_id].add(r.vec_id)
    hit = 0
    for q, ids in found.items():
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hit += len(ids & set(np.argsort(d)[:10].tolist()))
    assert len(found) == 60 and hit >= 0.95 * 600
