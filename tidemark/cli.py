"""``python -m tidemark.cli TASK``: the jobs of a risk team from a command line.

``list`` names tasks and queries; ``run`` runs single queries; ``features`` and ``snapshot`` write tables; any other
task runs its queries one after the other and prints their reports, or writes them below ``--out``.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

#: Queries of each task, by the beginnings of their names.
TASKS: dict[str, tuple[str, ...]] = {
    "load": ("csv_scan", "month_partitions", "constraints"),
    "parity": ("parity_diff",),
    "replay": ("stream_scoring_pipeline", "stream_warm_start", "idempotent_decisions"),
    "policies": ("policy_cost_table", "capacity_policy", "conformal_policy", "segment_audit", "review_queue_topk"),
    "metrics": ("roc_auc", "average_precision", "calibration_bins", "cluster_bootstrap", "paired_difference"),
    "calibrate": ("isotonic", "platt", "prior_shift"),
    "drift": ("psi", "ks_statistic", "feature_drift", "live_drift", "adversarial_validation"),
    "sketches": ("count_min", "bloom_filter", "sketch_evaluation"),
    "tune": ("hyper_search",),
    "backtest": ("retraining_backtest",),
    "imbalance": ("imbalance_study",),
    "compare": ("model_comparison", "leaf_ftrl"),
    "train": ("train_bundle",),
    "desk": ("card_view", "card_live_view", "transaction_detail", "decision_explanation", "options_view", "score_manual"),
}


def _spark() -> SparkSession:
    return SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _report(name: str, sf_dir: str, out: str | None) -> None:
    from tidemark.queries import QUERIES
    from tidemark.sources.storage import markdown

    df = QUERIES[name](_spark(), sf_dir)
    if out:
        df.write.mode("overwrite").parquet(f"{out.rstrip('/')}/{name}")
    else:
        print(f"## {name}\n{markdown(df, 40)}\n")


def main(argv: list[str] | None = None) -> None:
    from tidemark.plans.features import compute, events
    from tidemark.plans.spec import CARD_RISK
    from tidemark.queries import ORACLES, QUERIES
    from tidemark.sources import storage
    from tidemark.sources import tables as T
    from tidemark.streaming.features import snapshot

    parser = argparse.ArgumentParser(prog="tidemark")
    tasks = parser.add_subparsers(dest="task", required=True)
    tasks.add_parser("list", help="names of tasks and queries")
    for name in ("run", "features", "snapshot", "predictions", *TASKS):
        task = tasks.add_parser(name)
        if name == "run":
            task.add_argument("query", nargs="+", choices=sorted(QUERIES))
        task.add_argument("--sf-dir", default="/root/testdata/sf0.001")
        task.add_argument("--out", required=name in ("features", "snapshot", "predictions"), help="folder to write to")
        if name == "snapshot":
            task.add_argument("--group", default="card")
            task.add_argument("--until-us", type=int, help="only events before")
    args = parser.parse_args(argv)
    if args.task == "list":
        for name, parts in TASKS.items():
            print(name, "=", ", ".join(parts))
        for name in sorted(QUERIES):
            print(name, "(with SQL)" if name in ORACLES else "")
    elif args.task in ("features", "snapshot"):
        spark = _spark()
        txns = T.from_events(spark, args.sf_dir)
        backs = T.chargebacks(txns)
        if args.task == "features":
            print(storage.materialize(compute(CARD_RISK, txns, backs), args.out, CARD_RISK))
            return
        seen = events(txns, backs)
        if args.until_us is not None:
            seen = seen.where(seen["us"] < args.until_us)
        snapshot(CARD_RISK.pick(CARD_RISK.of_group(args.group)), seen, args.out)
    elif args.task == "predictions":
        storage.write_csv(QUERIES["stream_scoring_pipeline"](_spark(), args.sf_dir), args.out)
    else:
        for name in args.query if args.task == "run" else TASKS[args.task]:
            _report(name, args.sf_dir, args.out)


if __name__ == "__main__":
    main()
