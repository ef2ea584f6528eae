"""python -m loomline.plans.cli build|report|label|rows: the batch jobs, for spark-submit."""

from __future__ import annotations

import argparse
import shlex

from pyspark.sql import SparkSession

from loomline.operators.backends import READERS, command
from loomline.operators.calls import Budget, Calls, json_tokens
from loomline.operators.stats import corpus_report
from loomline.plans.dataset import build_dataset, label_dataset, training_dataset


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="loomline")
    jobs = parser.add_subparsers(dest="job", required=True)
    for name in ("build", "report"):
        job = jobs.add_parser(name)
        for dialect in "abc":
            job.add_argument(f"--root-{dialect}", help=f"folder of the logs in dialect {dialect}")
        job.add_argument("--since", help="ISO date or time; threads known to be older are left out")
        job.add_argument("--out", required=name == "build", help="folder for the samples, by split")
    label = jobs.add_parser("label")
    label.add_argument("--samples", nargs="+", required=True)
    label.add_argument("--labels", required=True)
    label.add_argument("--grader", help="a command that reads a prompt and answers for the middle zone")
    label.add_argument("--answers", choices=list(READERS), default="plain", help="plain text, or a JSON object with result, is_error and usage")
    label.add_argument("--in-flight", type=int, default=4, help="calls of a task at a time")
    label.add_argument("--per-second", type=float, help="calls that the job may start a second")
    label.add_argument("--budget", type=float, help="dollars; beyond them nothing more is asked. Needs --answers json")
    label.add_argument("--model", default="", help="whose prices the budget counts by")
    label.add_argument("--limit", type=int)
    label.add_argument("--dry-run", action="store_true", help="only count the zones")
    rows = jobs.add_parser("rows")
    rows.add_argument("--samples", nargs="+", required=True)
    rows.add_argument("--labels", required=True)
    rows.add_argument("--out", required=True)
    a = parser.parse_args(args)
    spark = spark or SparkSession.builder.appName(f"loomline {a.job}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.job in ("build", "report"):
        roots = {d: getattr(a, f"root_{d}") for d in "abc" if getattr(a, f"root_{d}")}
        _, stats = build_dataset(spark, roots, a.out, a.since)
        corpus_report(stats).show(100, truncate=False)
    elif a.job == "label" and a.dry_run:
        from loomline.operators.labels import keyed, zone_histogram
        from loomline.sources.jsonl import read_samples

        zone_histogram(keyed(read_samples(spark, a.samples))).show()
    elif a.job == "label":
        grader = command(shlex.split(a.grader)) if a.grader else None
        budget = Budget(a.budget, a.model, json_tokens) if a.budget is not None else None
        label_dataset(spark, a.samples, a.labels, grader, a.grader or "", a.limit, read=READERS[a.answers], calls=Calls(a.in_flight), per_second=a.per_second, budget=budget).show()
    else:
        training_dataset(spark, a.samples, a.labels).write.mode("overwrite").parquet(a.out)


if __name__ == "__main__":
    main()
