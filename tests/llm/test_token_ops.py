from __future__ import annotations

import bisect
import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from loomline.llm import alignment, hard_negatives, token_counts
from loomline.llm.queries import op11_onebit_negatives, op12_digest_counts, op13_tokenizer_alignment, tokenizer_path

A, B, RANKS = (tokenizer_path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"))


def brute_negatives(rows, config, every=50):
    """rows: id, vector of floats, label; the definition, one pair at a time."""
    ok = [(i, str(label), [int(np.floor(config.scale * float(x))) for x in v]) for i, v, label in rows if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    dims = Counter(len(v) for _, _, v in ok)
    dim = max(dims, key=lambda d: (dims[d], d)) if dims else 0
    ok = [r for r in ok if len(r[2]) == dim]
    asks = {}
    for i, label, v in ok:
        if i % every == 0:
            asks[i] = min(asks.get(i, (label, v, None))[:2], (label, v), key=lambda a: (a[0], np.array(a[1], np.int16).tobytes()))
    out = []
    for a, (label, q) in asks.items():
        scored = sorted(((-sum(x * y for x, y in zip(q, v, strict=True)), i, other) for i, other, v in ok if i != a))
        for score, p, _ in [s for s in scored if s[2] == label][: config.positives]:
            found = [(i, -s) for s, i, other in scored if other != label and config.low * -score <= 100 * -s <= config.high * -score]
            out += [(a, p, rank, i, -score, s) for rank, (i, s) in enumerate(found[: config.negatives], 1)]
    return Counter(out)


VECTORS = "vec_id long, embedding array<float>, label int, id long, code string, n int"


def vector_rows(seed: int, n: int, dim: int = 24, spread: float = 0.6):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(4, dim))
    rows = []
    for i in range(n):
        v = centres[i % 4] * 0.3 + r.normal(size=dim) * spread
        rows.append((i, [float(np.float32(x)) for x in v / np.linalg.norm(v)], int(r.integers(0, 3)), 1, "c", 2))
    return rows


@pytest.mark.parametrize("config", [hard_negatives.Config(), hard_negatives.Config(bits=1, planes=2, seeds=4, blocks=3, most_block=60), hard_negatives.Config(positives=2, negatives=9, low=20, high=100)])
def test_hard_negatives(spark, config):
    rows = vector_rows(3, 400)
    rows += [(400, None, 1), (401, rows[0][1], None), (402, [float("nan")] * 24, 1), (403, [None] * 24, 1), (404, [float("inf")] * 24, 1), (405, [1.0, 2.0], 1), (406, [], 1), (None, rows[0][1], 1)]
    rows += [(450, [0.0] * 24, 1), (451, [0.0] * 24, 2), rows[7], rows[50], (50, rows[60][1], 2), *[(500 + i, rows[9][1], 1) for i in range(80)], *[(600 + i, rows[9][1], 2) for i in range(80)]]
    rows = [r if len(r) == 6 else (*r[:3], 1, "c", 2) for r in rows]
    got = hard_negatives.mine(spark.createDataFrame(rows, VECTORS).repartition(3), config=config)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert Counter(map(tuple, got.collect())) == brute_negatives([r[:3] for r in rows], config)


def test_hard_negatives_of_few_and_none(spark):
    none = spark.createDataFrame([], VECTORS)
    assert hard_negatives.mine(none).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([(50, [1.0, 0.5], 1, 1, "c", 2)], VECTORS)).count() == 0
    huge = spark.createDataFrame([(0, [3e38, 1.0], 1, 1, "c", 2), (1, [3e38, 3e38], 1, 1, "c", 2), (2, [1e38, 2.0], 2, 1, "c", 2), (3, [0.5e-2, 0.0], 2, 1, "c", 2)], VECTORS)
    assert hard_negatives.mine(huge).count() == 0  # held at the bound, row 2 scores as much as row 1


def test_intervals_hold():
    r = np.random.default_rng(5)
    for bits, planes in ((1, 1), (2, 4), (8, 6)):
        codes = hard_negatives.Codes(20, hard_negatives.Config(bits=bits, planes=planes))
        x, q = np.floor(256 * r.normal(size=(500, 20))), np.floor(256 * r.normal(size=(30, 20)))
        x[3], q[4], x[7] = 0, 0, q[2]
        words, norm, alignment_, code_norm = codes.encode(x)
        ones = np.bitwise_count(words).sum(1, dtype=np.int64)
        estimate, error = codes.intervals(codes.ask(q), (q**2).sum(1), np.ascontiguousarray(words.T), ones, norm, alignment_, code_norm)
        off = np.abs(estimate - q @ x.T)
        assert (off <= error).all()
        assert bits < 8 or np.median(error) < 0.45 * np.median(np.sqrt((q**2).sum(1))) * np.median(norm)


def test_query_of_hard_negatives(spark, small):
    table = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in table.collect()]
    got = Counter(map(tuple, op11_onebit_negatives(spark, small).collect()))
    assert got == brute_negatives(rows, hard_negatives.Config()) and got


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    default, plain = Tokenizer.from_file(A), Tokenizer.from_file(A)
    plain.encode_special_tokens = True
    return default, plain, sentencepiece.SentencePieceProcessor(model_file=B)


ODD = ["a  b \n c", "  lead", "trail   ", "▁x", "a ▁ b", "<|endoftext|> and <|ENDOFTEXT|>", "x<0x41>y <s> </s>", "\x00\x01 \t\t  é ü　日本語 🙂👨‍👩‍👧", "́ combining", "I'll we're THEY'LL", " ", "  ", "\n", "1234567 89", "Ångström", "ﬁ", "İSTANBUL Straße", "a" * 3000, "word " * 4000]


def odd_docs(spark, messy):
    extra = [(1000 + i, t, "en", "s", len(t)) + (None,) * 9 for i, t in enumerate(ODD)]
    return messy.unionByName(spark.createDataFrame(extra + extra[:3], messy.schema))


def test_token_counts(spark, messy, empty, libraries):
    docs = odd_docs(spark, messy)
    rows = docs.collect()
    for path, ranks in ((A, RANKS), (A, None), (tokenizer_path("word_bpe_49k.json"), None), (B, None)):
        if path == B:
            size = lambda t: len(libraries[2].encode(t))
        else:
            from tokenizers import Tokenizer

            one = Tokenizer.from_file(path)
            size = lambda t, one=one: len(one.encode(t, add_special_tokens=False).ids)
        want = Counter((r.doc_id, len((r.text or "").encode()), n := size(r.text or ""), n > 512) for r in rows)
        for few in (100_000, 0):
            got = token_counts.count_tokens(docs, path, ranks, few=few)
            assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit", "digest"]
            assert Counter(tuple(r)[:4] for r in got.collect()) == want
    assert token_counts.count_tokens(empty, A).count() == 0


def test_only_misses_are_encoded(spark, tmp_path, monkeypatch):
    """The second call finds all but the new text stored; a lot that was never put in place counts for nothing; another version sees none of it."""
    texts = spark.createDataFrame([(i, f"text number {i % 7}") for i in range(50)], "doc_id long, text string")
    where = str(tmp_path)
    lots = lambda: {p: spark.read.parquet(str(p)).count() for p in tmp_path.glob("tokenizer-*/lot-*")}
    first = token_counts.count_tokens(texts, A, cache=where).collect()
    assert list(lots().values()) == [7] and {r.n_tokens for r in first} == {3}
    more = texts.unionByName(spark.createDataFrame([(99, "quite another text"), (100, None)], texts.schema))
    folder = next(tmp_path.glob("tokenizer-*"))
    spark.createDataFrame([(hashlib.sha256(b"text number 1").digest(), 77)], token_counts.COUNTS).write.parquet(f"{folder}/_new-dead")
    second = token_counts.count_tokens(more, A, cache=where).collect()
    assert sorted(lots().values()) == [2, 7] and len(second) == 52 and {r.n_tokens for r in second if r.doc_id == 100} == {0}
    assert Counter(r.n_tokens for r in token_counts.count_tokens(more, A, cache=where).collect()) == Counter(r.n_tokens for r in second) and len(lots()) == 2
    monkeypatch.setattr(token_counts, "version", lambda _: "other")
    token_counts.count_tokens(texts, A, cache=where).collect()
    assert len(lots()) == 3 and len(list(tmp_path.glob("tokenizer-*"))) == 2


def test_normal_forms(spark, tmp_path):
    """Texts that this tokenizer takes for the same share a stored count, but for those that hold an added token's string."""
    texts = ["Two  Words", "two words", "TWO\nWORDS", "<|startoftext|> two", "<|STARTOFTEXT|> two"]
    got = token_counts.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tokenizer_path("word_bpe_49k.json"), cache=str(tmp_path)).orderBy("doc_id").collect()
    assert len({r.digest for r in got}) == 3 and got[3].n_tokens != got[4].n_tokens


def brute_alignment(rows, libraries):
    """rows: id, text; from whole texts, the libraries' own encodings, and one token at a time."""
    from tokenizers import decoders

    _, plain, model = libraries
    letters = {bytes([b]): None for b in range(256)}
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    code = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    assert len(code) == len(letters) and decoders
    parsed, links = [], Counter()
    for i, text in rows:
        a = b = []
        if text:
            a = [(t, bytes(code[c] for c in plain.id_to_token(t))) for t in plain.encode(" " + text, add_special_tokens=False).ids]
            b = [(t, bytes([int(p[3:5], 16)]) if model.is_byte(t) else p.replace("▁", " ").encode()) for t in model.encode(text) for p in [model.id_to_piece(t)]]
            if b"".join(x for _, x in a) != (" " + text).encode() or b"".join(x for _, x in b) != (" " + text).encode():
                a = b = []
        ends = []
        for side in (a, b):
            at, upto = 0, {}
            for t, x in side:
                at += len(x)
                upto[at] = t
            ends.append(upto)
        common = sorted(set(ends[0]) & set(ends[1]))
        pairs = [(ends[0][e], ends[1][e]) for e in common]
        links.update(pairs)
        groups, at = [], [0, 0]
        places = [sorted(upto) for upto in ends]
        for e in common:
            to = [bisect.bisect(p, e) for p in places]
            groups.append("|".join(",".join(str(upto[x]) for x in p[a:b]) for upto, p, a, b in zip(ends, places, at, to, strict=True)))
            at = to
        parsed.append((i, len(a), len(b), pairs, ";".join(groups)))
    best = Counter()
    for (_, t), n in links.items():
        best[t] = max(best[t], n)
    return Counter((i, a, b, len(p), len(p), sum(links[x] == best[x[1]] for x in p), sum(links[x] for x in p), hashlib.sha256(g.encode()).hexdigest() if g else "") for i, a, b, p, g in parsed)


def test_alignment(spark, messy, empty, libraries):
    docs = odd_docs(spark, messy).filter("doc_id is null or doc_id <> 60")  # the brute force is slow on the longest
    got = alignment.align(docs, A, B, RANKS)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = brute_alignment([(r.doc_id, r.text) for r in docs.collect()], libraries)
    assert Counter(map(tuple, got.collect())) == want
    assert any(k[1] == 0 and k[7] == "" for k in want)
    assert alignment.align(empty, A, B).count() == 0


def test_queries_on_whole_tables(spark, small, libraries):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert Counter(map(tuple, op13_tokenizer_alignment(spark, small).collect())) == brute_alignment(docs, libraries)
    want = Counter((i, len(t.encode()), n := len(libraries[0].encode(t, add_special_tokens=False).ids), n > 512) for i, t in docs)
    assert Counter(tuple(r)[:4] for r in op12_digest_counts(spark, small).collect()) == want


def test_pieces_apart_are_the_whole(libraries):
    """Words encoded apart give what the model gives for whole texts. (Texts with U+2581, which the model takes for a space, have no tokens here anyway.)"""
    r = random.Random(2)
    texts = ["".join(r.choices(["a", "the", " ", "  ", "é", "\n", "日", "x1", ".", "'s"], k=40)) for _ in range(300)]
    pieces = alignment.Side(B)
    data, at = alignment.flat(alignment.pa.array([" " + t for t in texts]))
    assert pieces.encoder.apart and pieces.lists(data, at).to_pylist() == libraries[2].encode(texts)
    pieces.encoder.apart = False
    assert pieces.lists(data, at).to_pylist() == libraries[2].encode(texts)
