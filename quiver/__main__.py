"""Command line: run an evaluation or a variance analysis over a table folder and append results.

    python -m quiver evaluate --tables DIR --results OUT/results --errors OUT/errors --run-id 3
    python -m quiver variance --tables DIR --out OUT/variance --run-id 3

Uses the active session if one exists (spark-submit), else a local one. Results are appended
(never overwritten) with the run id; ``plans.results.consolidate`` keeps the latest run per key.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from quiver.session import release_tables


def _session() -> SparkSession:
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    from quiver.session import local_session

    return local_session()


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="quiver")
    sub = ap.add_subparsers(dest="cmd", required=True)
    ev = sub.add_parser("evaluate", help="evaluate every configuration, append results and errors")
    ev.add_argument("--tables", required=True)
    ev.add_argument("--results", required=True)
    ev.add_argument("--errors", required=True)
    ev.add_argument("--run-id", type=int, required=True)
    ev.add_argument("--format", default="parquet", choices=["parquet", "csv"])
    va = sub.add_parser("variance", help="single vs double bootstrap, append paired rows")
    va.add_argument("--tables", required=True)
    va.add_argument("--out", required=True)
    va.add_argument("--run-id", type=int, required=True)
    va.add_argument("--format", default="parquet", choices=["parquet", "csv"])
    args = ap.parse_args(argv)

    spark = _session()
    read = lambda name: spark.read.parquet(f"{args.tables.rstrip('/')}/{name}.parquet")
    if args.cmd == "evaluate":
        from quiver.plans import evaluate as EV

        ev_ = EV.evaluate(read("embeddings"), EV.configs_from_nation(read("nation")), runs=(args.run_id,))
        EV.run_and_record(ev_, args.results, args.errors, args.run_id, args.format)
    else:
        from quiver.plans import variance as VA
        from quiver.sources.sinks import append_variance_report

        from quiver.plans import derived, experiment

        cases = VA.variance_cases(experiment.experiment_clean(derived.experiment_table(read("orders"))), derived.hyperparams(spark))
        _, paired = VA.single_vs_double(read("embeddings"), cases)
        rows = paired.select("config", "model_name", "task", "single_accuracy", "single_macro_f1", "double_accuracy", "double_macro_f1")
        append_variance_report(rows, args.out, args.run_id, args.format)
    release_tables(spark)


if __name__ == "__main__":
    main()
