"""spark-submit entry: logs in, tables and findings out."""

from __future__ import annotations

import argparse
from datetime import datetime, timedelta, timezone

from pyspark.sql import SparkSession

from wirebook import catalog
from wirebook.operators.detect import finding_counts, parse_allowlist
from wirebook.plans.pipeline import run
from wirebook.session import configure


def _utc(text: str) -> datetime:
    value = datetime.fromisoformat(text)
    return value if value.tzinfo else value.replace(tzinfo=timezone.utc)


def main() -> None:
    parser = argparse.ArgumentParser(prog="wirebook")
    parser.add_argument("logs", help="directory tree of Zeek logs")
    parser.add_argument("output", help="directory for the tables")
    parser.add_argument("--now", type=_utc, default=None)
    parser.add_argument("--baseline-end", type=_utc, default=None, help="default: 24 hours before now")
    parser.add_argument("--allowed-protocols", default=",".join(catalog.ALLOWED_PROTOCOLS))
    args = parser.parse_args()
    now = args.now or datetime.now(timezone.utc)
    spark = configure(SparkSession.builder.appName("wirebook").getOrCreate())
    tables = run(
        spark,
        args.logs,
        args.output,
        args.baseline_end or now - timedelta(hours=24),
        now,
        parse_allowlist(args.allowed_protocols),
    )
    finding_counts(tables["findings"]).show(truncate=False)


if __name__ == "__main__":
    main()
