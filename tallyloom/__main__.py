"""Command line: python -m tallyloom score | bootstrap | check-runs | schema. Inputs are JSON lines, outputs new folders of JSON lines."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.rng import twister_draws
from tallyloom.operators import run_checks, scoring, statistics
from tallyloom.operators.json_schema import Schema, schema_violations
from tallyloom.sources.records import write_jsonl

GOLD = f"sample_id string, site_id string, platform string, intent string, entry_value string, obfuscation_types array<string>, messages {scoring.MESSAGES}"
PREDICTIONS = f"sample_id string, input_view string, platform string, intent string, abstain boolean, messages {scoring.MESSAGES}, candidates {scoring.CANDIDATES}"
PAIRED = "model string, ordinal long, task2_case_ref string, gold_decision string, gold_type string, web_pred_decision string, web_pred_type string, gate_pass boolean, gated_pred_decision string, gated_pred_type string"
FILES, LINES = "run_id string, path string, sha256 string, text string", "run_id string, path string, line_no long, text string"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def score(spark: SparkSession, a: argparse.Namespace) -> int:
    """The scoring report: overall, by platform, by type."""
    cases = scoring.score_cases(_read(spark, a.gold, GOLD), _read(spark, a.predictions, PREDICTIONS), top_k=a.top_k, allow_missing=a.allow_missing)
    write_jsonl(scoring.report(cases), a.out, order=["scope", "value"], single=True)
    return 0


def bootstrap(spark: SparkSession, a: argparse.Namespace) -> int:
    """Paired web and gated scores of each model with intervals, drawn by the Mersenne Twister."""
    rows = _read(spark, a.cases, PAIRED)
    wrong = statistics.aligned(rows).limit(10).collect()  # ten are told
    if wrong:
        raise SystemExit("models differ in gold, or lack or repeat: " + ", ".join(str(r.ordinal) for r in wrong))
    types = tuple(r[0] for r in rows.where(F.col("gold_decision") == statistics.DECISIONS[0]).select("gold_type").distinct().orderBy("gold_type").collect())  # the types that are told apart
    size = rows.select("ordinal").distinct().count()
    draws = twister_draws(spark, seeds=statistics.model_seeds(rows, a.seed), replicates=a.replicates, size=size)
    write_jsonl(statistics.paired_bootstrap(rows, draws, types), a.out, order=["model", "metric"], single=True)
    return 0


def check_runs(spark: SparkSession, a: argparse.Namespace) -> int:
    """Findings and verdicts of runs; 1 if any fails."""
    files, lines = _read(spark, a.files, FILES), _read(spark, a.lines, LINES)
    if a.kind == "smoke":
        made = run_checks.smoke_checks(files, lines)
    else:
        with open(a.schema, encoding="utf-8") as f:
            made = run_checks.text_batch_checks(files, lines, json.load(f), **({"protocol": a.protocol} if a.protocol else {}))
    made = run_checks.written(made, "checks")
    write_jsonl(run_checks.findings(made), f"{a.out}/findings", order=["run_id", "ref", "code"])
    write_jsonl(run_checks.verdicts(made), f"{a.out}/verdicts", order=["run_id"], single=True)
    return int(not made.where("NOT ok").isEmpty())


def schema(spark: SparkSession, a: argparse.Namespace) -> int:
    """Errors of each record by line; 1 if there are any."""
    with open(a.schema, encoding="utf-8") as f:
        compiled = Schema(json.load(f), formats=a.formats)
    rows = spark.read.text(a.records).where(F.trim("value") != "").select(F.sha2("value", 256).alias("record_sha256"), "value")
    found = run_checks.written(schema_violations(rows, compiled, "record_sha256", "value"), "errors")
    write_jsonl(found, a.out, order=["record_sha256", "pointer", "keyword"])
    return int(not found.isEmpty())


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tallyloom", description=__doc__)
    commands = top.add_subparsers(required=True)

    def command(name: str, run, **options: dict) -> None:
        p = commands.add_parser(name, help=run.__doc__)
        p.set_defaults(run=run)
        p.add_argument("--out", required=True, help="a new folder")
        for option, how in options.items():
            p.add_argument(f"--{option.replace('_', '-')}", **how)

    need = {"required": True}
    command("score", score, gold=need, predictions=need, top_k={"type": int, "default": 5}, allow_missing={"action": "store_true"})
    command("bootstrap", bootstrap, cases=need, replicates={"type": int, "default": 2000}, seed={"type": int, "default": 20260727})
    command("check-runs", check_runs, files=need, lines=need, kind={"choices": ("text", "smoke"), "default": "text"}, schema={"help": "of predictions, for text batches"}, protocol={"help": "name of the request protocol of text batches"})
    command("schema", schema, schema=need, records=need, formats={"action": "store_true"})
    return top


def main(argv: Sequence[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.run is check_runs and a.kind == "text" and not a.schema:
        parser().error("text batches need --schema")
    return a.run(SparkSession.builder.appName("tallyloom").getOrCreate(), a)


if __name__ == "__main__":
    sys.exit(main())
