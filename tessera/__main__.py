"""Command line: python -m tessera reviews.jsonl metadata.jsonl output [label mode]."""

from __future__ import annotations

import sys
from dataclasses import replace

from pyspark.sql import SparkSession

from tessera.config import PipelineConfig
from tessera.plans.pipeline import run
from tessera.sources.console import report
from tessera.storage import close


def main(args: list[str]) -> int:
    names = ("reviews_path", "metadata_path", "output_path", "label_mode")
    if not 3 <= len(args) <= 4:
        print(__doc__, file=sys.stderr)
        return 2
    config = replace(PipelineConfig(), **dict(zip(names, args)))
    spark = SparkSession.builder.appName("tessera").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        print(f"reviews {config.reviews_path}, metadata {config.metadata_path}, output {config.output_path}")
        print(report(run(spark, config), config.top_k))
        print("done")
    finally:
        close(spark)
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
