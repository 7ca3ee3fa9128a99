"""python -m moenda.plans.cli prepare|run|capacity|allocate|validate|inspect"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from ..operators import validate as checks
from ..runtime import discard_written, session
from . import pipeline
from .manifest import write_json_atomic


def _candidates(value: str) -> int | str:
    return value if value == pipeline.ALL else int(value)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="moenda")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("run", "capacity"):
        sub = commands.add_parser(name)
        sub.add_argument("--documents", required=True, help="Parquet with position, text, source_ref; domain for --decision remove_exact or pending and for --line-characters")
        sub.add_argument("--dataset", required=True)
        sub.add_argument("--profile", default="smoke")
        sub.add_argument("--decision", default="keep", choices=pipeline.DECISIONS)
        sub.add_argument("--line-characters", type=int, help="shorter lines go; 40 unless the decision is keep")
        sub.add_argument("--page-markers", help="JSON with the arguments of filters.PageRules; needs the columns of the page filters")
        sub.add_argument("--eval-reserve", type=int, default=256)
        sub.add_argument("--output", default="output")
        if name == "capacity":
            sub.add_argument("--candidate-documents", type=_candidates, default=pipeline.ALL, help="number of documents looked at, whatever the profile; all by default")
    whole = commands.add_parser("prepare", help="from the files of a source, as configured")
    for option in ("--configs", "--dataset", "--data"):
        whole.add_argument(option, required=True)
    whole.add_argument("--profile", default="smoke")
    whole.add_argument("--output", default="output")
    for name in ("validate", "inspect"):
        commands.add_parser(name).add_argument("--path", required=True)
    allocate = commands.add_parser("allocate")
    allocate.add_argument("--reports", nargs="+", required=True)
    allocate.add_argument("--target", type=int, required=True)
    allocate.add_argument("--output")
    args = parser.parse_args(argv)
    if args.command == "allocate":
        reports = []
        for path in args.reports:
            with open(path, encoding="utf-8") as f:
                reports.append(json.load(f))
        result = pipeline.allocate(reports, args.target)
        if args.output:
            write_json_atomic(os.path.join(args.output, "allocations", f"{result['allocation_sha256'][:20]}.json"), result)
    else:
        spark = session()
        if args.command == "validate":
            result = pipeline.validate_preparation(spark, args.path)
        elif args.command == "inspect":
            manifest = pipeline.validate_preparation(spark, args.path)
            result = {}
            for split in manifest["shards"]:
                from pyspark.sql import functions as F

                rows = spark.read.parquet(f"{args.path}/{split}").withColumns({"dataset_id": F.lit(manifest["dataset_id"]), "split": F.lit(split)})
                result[split] = checks.summary(rows).first().asDict()
        else:
            markers = None
            if args.command == "prepare":
                try:
                    result = pipeline.prepare(spark, args.configs, args.dataset, args.profile, args.data, args.output)
                except pipeline.ReviewRequired as gate:
                    print(f"review required: {gate}", file=sys.stderr)
                    return gate.exit_code
                print(json.dumps(result, indent=2, sort_keys=True, ensure_ascii=False))
                return 0
            if args.page_markers:
                with open(args.page_markers, encoding="utf-8") as f:
                    markers = json.load(f)
            spec = pipeline.Spec(args.dataset, args.profile, decision=args.decision, line_characters=args.line_characters, page_markers=markers)
            documents = spark.read.parquet(args.documents)
            try:
                result = pipeline.run(spark, documents, spec, args.output) if args.command == "run" else pipeline.capacity(documents, spec, eval_reserve=args.eval_reserve, candidate_documents=args.candidate_documents)
            except pipeline.ReviewRequired as gate:
                print(f"review required: {gate}", file=sys.stderr)
                return gate.exit_code
        if args.command == "capacity":
            write_json_atomic(os.path.join(args.output, "capacity", f"{args.dataset}-{result['capacity_report_id']}.json"), result)
    print(json.dumps(result, indent=2, sort_keys=True, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    status = main()
    if spark := SparkSession.getActiveSession():
        discard_written(spark)
    sys.exit(status)
