"""Scores of targets and replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomline.config import DEFAULT, Settings


def zone(length: Column, s: Settings = DEFAULT) -> Column:
    return F.when(length <= s.short_chars, "short").when(length <= s.middle_chars, "middle").otherwise("long")


def short_score(length: Column, s: Settings = DEFAULT) -> Column:
    return F.round(100 - 10 * (length / s.short_chars)).cast("int")


def long_score(length: Column, s: Settings = DEFAULT) -> Column:
    return F.greatest(F.lit(0), F.round(50 * F.exp(-s.decay * (length - s.middle_chars))).cast("int"))


def heuristic_score(length: Column, s: Settings = DEFAULT) -> Column:
    """The score by length; the middle zone, which a grader labels, gets a neutral one."""
    return F.when(length <= s.short_chars, short_score(length, s)).when(length <= s.middle_chars, s.unlabeled_middle).otherwise(long_score(length, s))


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 if a norm is 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)
    na, nb = (F.sqrt(F.aggregate(v, F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))) for v in (a, b))
    return F.when((na == 0) | (nb == 0), 0.0).otherwise(dot / (na * nb))


def clip(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))  # the two pass over nulls


def length_score(generated: Column, gold: Column) -> Column:
    """1 from half to twice the gold length, 0 at a quarter and at four times."""
    ratio = F.length(generated) / F.greatest(F.length(gold), F.lit(1))
    return F.when(ratio <= 0, 0.0).otherwise(clip(1 - F.greatest(F.lit(0.0), F.abs(F.log2(ratio)) - 1)))


def parse_choice(response: Column) -> Column:
    """The first letter a or b anywhere, in upper case; null if there is none."""
    return F.upper(F.regexp_substr(response, F.lit("[AaBb]")))


def judge_score(choice: Column, gold_is: Column) -> Column:
    """1 when the judge takes the generated reply for the author's."""
    return F.when(choice.isNull(), 0.5).when(choice == gold_is, 0.0).otherwise(1.0)


def parse_score(response: Column, low: int = 50, high: int = 90) -> Column:
    """The first CAN_AUTO_RESPOND number, held to low..high; null if there is none."""
    found = F.regexp_extract(response, r"(?U)CAN_AUTO_RESPOND:\s*(\d{1,3})", 1)
    return F.when(found != "", F.greatest(F.lit(low), F.least(F.lit(high), found.cast("int"))))


def combined_score(judge: Column, embed: Column, length: Column, weights: tuple[float, float, float] = (0.6, 0.3, 0.1)) -> Column:
    """A judge or embedder that failed (null) counts as 0.5 and 0."""
    return weights[0] * F.coalesce(judge, F.lit(0.5)) + weights[1] * F.coalesce(embed, F.lit(0.0)) + weights[2] * length
