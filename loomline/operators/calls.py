"""Calls to external models from tasks: several at once, tried again after a pause, within a rate, and each answer kept as it comes."""

from __future__ import annotations

import json
import random
import re
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.config import OTHER_PRICE, PRICES

#: Makes the function that asks, once in each Python worker.
Ask = Callable[[], Callable[[str], str]]


@dataclass(frozen=True)
class Calls:
    in_flight: int = 4  # calls of one task at a time
    attempts: int = 3
    pause: float = 0.5  # seconds before the second attempt; twice as long before each further one, and up to half as much again at random
    per_second: float | None = None  # calls that one task may start; for a whole job see keep_answers
    flush: int = 4  # answers to a file of keep_answers


class Caller:
    """A task's pool of calls."""

    def __init__(self, ask: Ask, calls: Calls):
        self.ask, self.calls, self.next = ask(), calls, 0.0
        self.lock, self.pool = threading.Lock(), ThreadPoolExecutor(calls.in_flight)

    def __enter__(self) -> Caller:
        return self

    def __exit__(self, *_: object) -> None:
        self.pool.shutdown(wait=True, cancel_futures=True)

    def _turn(self) -> None:
        """Waits until a call may start."""
        if self.calls.per_second:
            with self.lock:
                at = max(time.monotonic(), self.next)
                self.next = at + 1 / self.calls.per_second
            time.sleep(max(0.0, at - time.monotonic()))

    def one(self, prompt: str) -> str | None:
        """The answer, or None if the last attempt fails too: its row is asked again in the next run."""
        for attempt in range(self.calls.attempts):
            if attempt:
                time.sleep(self.calls.pause * 2 ** (attempt - 1) * (1 + random.random() / 2))
            self._turn()
            try:
                return self.ask(prompt)
            except Exception:  # whatever a backend raises; the next attempt or run may get through
                continue
        return None

    def all(self, prompts: list[str]) -> list[str | None]:
        """Answers in the order of the prompts."""
        return list(self.pool.map(self.one, prompts))

    def stream(self, items: Iterator[tuple], go_on: Callable[[], bool]) -> Iterator[tuple[tuple, str | None]]:
        """(item, answer) as answers come, for items that begin with their prompt; nothing new is asked once go_on() is false."""
        running: dict[Future, tuple] = {}
        items, more = iter(items), True
        while more or running:
            while more and len(running) < self.calls.in_flight:
                item = next(items, None) if go_on() else None
                more = item is not None
                if more:
                    running[self.pool.submit(self.one, item[0])] = item
            done, _ = wait(running, return_when=FIRST_COMPLETED) if running else ((), ())
            for future in done:
                yield running.pop(future), future.result()


def opened(folder: str):
    """A folder as workers reach it (file, hdfs, s3 or gs), and its path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", folder))


class BudgetExceeded(RuntimeError):
    """More was spent than allowed."""


@dataclass(frozen=True)
class Budget:
    """Stops a running job once its answers have cost more than this. tokens: prompt and completion tokens of an output."""

    most_usd: float
    model: str
    tokens: Callable[[str], tuple[int, int]]
    look: float = 0.2  # seconds between looks at what was spent


def usd(model: str, prompt_tokens: int, completion_tokens: int) -> float:
    price = {m: (a, b) for m, a, b in PRICES}.get(model, OTHER_PRICE)
    return (prompt_tokens * price[0] + completion_tokens * price[1]) / 1_000_000


def json_tokens(output: str) -> tuple[int, int]:
    """All counts that an output names input_tokens and output_tokens, added up."""
    found = re.findall(r'"(input|output)_tokens"\s*:\s*(\d+)', output)
    return sum(int(n) for side, n in found if side == "input"), sum(int(n) for side, n in found if side == "output")


def spent(folder: str) -> tuple[int, int]:
    """Prompt and completion tokens of all answers kept in a folder; files name their own."""
    from pyarrow import fs

    system, path = opened(folder)
    files = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    counts = [f.base_name.split(".")[0].split("-")[-2:] for f in files if f.base_name.startswith("a-")]
    return sum(int(a) for a, _ in counts), sum(int(b) for _, b in counts)


def keep_answers(questions: DataFrame, folder: str, ask: Ask, calls: Calls = Calls(), tasks: int | None = None, per_second: float | None = None, budget: Budget | None = None, before: tuple[int, int] = (0, 0)) -> int:
    """Asks all questions (key, question and what else is to be kept) and keeps each answer in `folder` as it comes; how many were answered.

    Answers are JSON lines (key, answer, and the other columns), a few to a file, each written aside and renamed: a task
    or a job that is killed has lost what was in flight and at most calls.flush - 1 answers. Questions are dealt to tasks by
    their key, and a task that runs again asks only for what its files lack. Answers that failed for good are left out.

    tasks: how many ask at a time (as many as the session has cores); per_second: calls that the whole job may start a
    second, divided among them. With a budget, the driver adds up what the files say was spent, together with `before`,
    and beyond it tells the tasks to ask nothing new; what they have in flight is still kept, then BudgetExceeded is
    raised. questions should be written (scratch.cut) if they are costly to make. folder: one that workers reach by
    pyarrow (a shared mount, hdfs, s3, gs).
    """
    spark = questions.sparkSession
    tasks = tasks or spark.sparkContext.defaultParallelism
    each = Calls(calls.in_flight, calls.attempts, calls.pause, per_second / tasks if per_second else calls.per_second, calls.flush)
    names = [c for c in questions.columns if c != "question"]
    tokens = budget.tokens if budget else lambda _: (0, 0)
    system, path = opened(folder)
    system.create_dir(path)
    stop = f"{path}/_stop"
    if system.get_file_info(stop).is_file:
        system.delete_file(stop)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, path = opened(folder)
        part = TaskContext.get().partitionId()
        known: set = set()
        for f in system.get_file_info(fs.FileSelector(path)):
            if f.base_name.startswith(f"a-{part}-"):
                known.update(json.loads(x)["key"] for x in system.open_input_file(f.path).read().decode().splitlines())
        n, held = len(known), []

        def flush() -> None:
            if held:
                used = [sum(x) for x in zip(*(tokens(r["answer"]) for r in held), strict=True)]
                name = f"{part}-{uuid.uuid4().hex}-{used[0]}-{used[1]}.jsonl"
                with system.open_output_stream(f"{path}/_new-{name}") as out:
                    out.write("".join(json.dumps(r) + "\n" for r in held).encode())
                system.move(f"{path}/_new-{name}", f"{path}/a-{name}")
                held.clear()

        rows = ((r["question"], {c: r[c] for c in names}) for batch in batches for r in batch.to_dict("records") if r["key"] not in known)
        with Caller(ask, each) as caller:
            try:
                for (_, row), answer in caller.stream(rows, lambda: not system.get_file_info(stop).is_file):
                    if answer is not None:
                        held.append(row | {"answer": answer})
                        n += 1
                        if len(held) >= each.flush:
                            flush()
            finally:
                flush()
        yield pd.DataFrame({"n": [n]})

    over = threading.Event()

    def watch() -> None:
        while not done.wait(budget.look):
            if usd(budget.model, *(a + b for a, b in zip(before, spent(folder), strict=True))) > budget.most_usd:
                over.set()
                system.open_output_stream(stop).close()
                return

    done = threading.Event()
    watcher = threading.Thread(target=watch, daemon=True) if budget else None
    if watcher:
        watcher.start()
    try:
        answered = questions.repartition(tasks, "key").mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    finally:
        done.set()
        if watcher:
            watcher.join()
    if budget:
        cost = usd(budget.model, *(a + b for a, b in zip(before, spent(folder), strict=True)))
        if over.is_set() or cost > budget.most_usd:
            raise BudgetExceeded(f"${cost:.4f} of ${budget.most_usd:.4f} spent; {answered} answers are kept")
    return answered
