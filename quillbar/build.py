"""Builds a store of bars: python -m quillbar.build --source bars.csv --data-root DIR"""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from datetime import UTC, date, datetime

from pyspark.sql import SparkSession

from .sources import bars as B

# Fixed value: the first day of the default range.
START = date(2010, 1, 1)


def parse(args: Sequence[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--source", required=True, help="CSV files of bars with a symbol column")
    p.add_argument("--data-root", required=True)
    p.add_argument("--start", type=date.fromisoformat, default=START)
    p.add_argument("--end", type=date.fromisoformat, default=None, help="today (UTC) if left out")
    p.add_argument("--force-refresh", action="store_true")
    return p.parse_args(args)


def main(args: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    given = parse(args)
    config = B.BuildConfig(given.start, given.end or datetime.now(UTC).date(), given.data_root, given.force_refresh)
    spark = spark or SparkSession.builder.appName("build").getOrCreate()
    B.build(spark, config, B.read_csv(spark, given.source, index="dt"))


if __name__ == "__main__":
    main()
