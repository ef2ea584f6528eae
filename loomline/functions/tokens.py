"""Tokenizers behind one small interface, and columns that use them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Tokenizer(Protocol):
    """encode() takes any text, special tokens as plain text; decode() is its inverse."""

    def encode(self, text: str) -> list[int]: ...

    def decode(self, ids: list[int]) -> str: ...


#: Characters that are encoded at once. A library keeps some hundred bytes for a token while it encodes a list of texts.
SLICE = 1 << 18


def slices(texts: Sequence[str], most: int = SLICE) -> Iterator[Sequence[str]]:
    """The texts in order, in lists of at most `most` characters; a longer text stands alone."""
    begin, held = 0, 0
    for i, text in enumerate(texts):
        if i > begin and held + len(text) > most:
            yield texts[begin:i]
            begin, held = i, 0
        held += len(text)
    if len(texts) > begin:
        yield texts[begin:]


def encode_all(tokenizer: Tokenizer, texts: Sequence[str], most: int = SLICE) -> Iterator[list[np.ndarray]]:
    """Ids of many texts, slice by slice: by the tokenizer's encode_batch, if it has one."""
    batch = getattr(tokenizer, "encode_batch", None) or (lambda of: [tokenizer.encode(t) for t in of])
    for of in slices(texts, most):
        yield [np.asarray(x, np.int32) for x in batch(of)]


def count_all(tokenizer: Tokenizer, texts: Sequence[str]) -> list[int]:
    """How many tokens each has."""
    return [len(x) for ids in encode_all(tokenizer, texts) for x in ids]


class FileTokenizer:
    """A vocabulary file: .json by `tokenizers`, .model by `sentencepiece`, .tiktoken (ranks) by `tiktoken`. Special tokens' strings are plain text."""

    def __init__(self, path: str, pattern: str | None = None):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode_batch, self.decode = lambda texts: model.encode(texts, num_threads=1), model.decode
        elif path.endswith(".tiktoken"):
            import base64

            import tiktoken

            with open(path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            coder = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self.encode_batch, self.decode = lambda texts: [coder.encode_ordinary(t) for t in texts], coder.decode
        else:
            from tokenizers import Tokenizer as Library

            coder = Library.from_file(path)
            coder.encode_special_tokens = True
            coder.no_truncation(), coder.no_padding()
            # one by one: its own batches start a thread for each of the machine's cores in each worker, and keep all that is known of every token until the last text is done
            self.encode_batch = lambda texts: [coder.encode(t, add_special_tokens=False).ids for t in texts]
            self.decode = lambda ids: coder.decode(ids, skip_special_tokens=False)

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0]


class CodePoints:
    """A token for each character: needs no vocabulary, and round trips."""

    def encode(self, text: str) -> list[int]:
        return [ord(c) for c in text]

    def decode(self, ids: list[int]) -> str:
        return "".join(map(chr, ids))


#: A function that makes a tokenizer, called once in each Python worker.
Maker = Callable[[], Tokenizer]
_made: dict[Maker, Tokenizer] = {}


def _of(make: Maker) -> Tokenizer:
    if make not in _made:
        _made[make] = make()
    return _made[make]


def token_counts(texts: Column, make: Maker) -> Column:
    """ARRAY<STRING> to ARRAY<INT>: the number of tokens of each text."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = _of(make)
        for lists in batches:
            yield lists.map(lambda texts: count_all(tokenizer, list(texts)))

    return count(texts)


def message_tokens(role: Column, content: Column, make: Maker) -> Column:
    """What a message counts: the tokens of its content and role, and four. A role is encoded once in each worker."""

    @F.pandas_udf(T.IntegerType())
    def count(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        tokenizer, roles = _of(make), {}
        for names, texts in batches:
            for name in set(names) - roles.keys():
                roles[name] = len(tokenizer.encode(name or ""))
            yield pd.Series([x + roles[n] + 4 for n, x in zip(names, count_all(tokenizer, [t or "" for t in texts]), strict=True)], dtype="int32")

    return count(role, content)


def encode(make: Maker, **texts: Column) -> Column:
    """STRUCT of an ARRAY<INT> of ids for each text, by one worker of a task; they leave slice by slice, so it holds those of one."""
    names = list(texts)  # the function below may not hold columns
    kind = T.StructType([T.StructField(name, T.ArrayType(T.IntegerType())) for name in names])

    @F.pandas_udf(kind)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        tokenizer = _of(make)
        for columns in batches:
            every = [t or "" for row in zip(*columns, strict=True) for t in row]
            held: list[np.ndarray] = []
            for ids in encode_all(tokenizer, every):
                held += ids
                whole = len(held) // len(names) * len(names)
                if whole:
                    yield pd.DataFrame({name: pd.Series(held[i : whole : len(names)], dtype=object) for i, name in enumerate(names)})
                    held = held[whole:]

    return run(*texts.values())


def left_truncate(text: Column, budget: Column, make: Maker, mark: str) -> Column:
    """The mark and the last tokens that fit the budget beside it and a reserve of eight; the mark alone if none do."""

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        tokenizer = _of(make)
        taken = len(tokenizer.encode(mark)) + 8
        for texts, budgets in batches:
            yield pd.Series([mark + tokenizer.decode(tokenizer.encode(t)[-(b - taken) :]) if b > taken else mark for t, b in zip(texts, budgets, strict=True)], dtype=object)

    return run(text, budget.cast("int"))
