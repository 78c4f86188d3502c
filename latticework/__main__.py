"""``python -m latticework <pipeline> --config FILE``"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans import pipelines

RUNS = {"preparation": pipelines.run_preparation, "autocorrelation": pipelines.run_autocorrelation, "regression": pipelines.run_regression, "experiment": pipelines.run_experiment}


def main() -> None:
    parser = argparse.ArgumentParser(prog="latticework")
    parser.add_argument("pipeline", choices=RUNS)
    parser.add_argument("--config", required=True)
    args = parser.parse_args()
    spark = SparkSession.builder.appName(f"latticework-{args.pipeline}").getOrCreate()
    print(RUNS[args.pipeline](spark, args.config))


if __name__ == "__main__":
    main()
