"""Graders, judges and generators that run as commands. Anything that makes a function from text to text will do in their place.

A command's output is kept as it is; what it says is read from it as columns.
"""

from __future__ import annotations

import subprocess
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomline.operators.calls import Ask

ENVELOPE = "result string, is_error boolean, usage struct<input_tokens long, output_tokens long>"


def plain(output: Column) -> Column:
    """All of the output, without the spaces and newlines around it."""
    return F.regexp_replace(output, r"\A\s+|\s+\z", "")


def enveloped(output: Column) -> Column:
    """The result of an output that is one JSON object; null if it isn't one, or reports an error."""
    told = F.from_json(output, ENVELOPE)
    return F.when(~F.coalesce(told["is_error"], F.lit(False)), told["result"])


def usage(output: Column) -> Column:
    """struct(prompt_tokens, completion_tokens) of such an output, zeros where it names none: for stats.costs()."""
    told = F.from_json(output, ENVELOPE)["usage"]
    return F.struct(*(F.coalesce(told[a], F.lit(0).cast("long")).alias(b) for a, b in (("input_tokens", "prompt_tokens"), ("output_tokens", "completion_tokens"))))


#: How the answer is read from a command's output, by name.
READERS: dict[str, Callable[[Column], Column]] = {"plain": plain, "json": enveloped}


def command(argv: list[str], timeout: float = 60.0) -> Ask:
    """A backend that gives the prompt to a command's standard input and returns its output; a failure or timeout raises."""

    def make() -> Callable[[str], str]:
        return lambda prompt: subprocess.run(argv, input=prompt, capture_output=True, text=True, timeout=timeout, check=True).stdout

    return make
