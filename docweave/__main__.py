"""python -m docweave QUERY PATH: the results of a jq query over files of JSON values, one a line."""

from __future__ import annotations

import argparse
from collections.abc import Iterator

from pyspark.sql import SparkSession

from docweave.operators import json as J
from docweave.sources import readers


def results(spark: SparkSession, query: str, path: str) -> Iterator[str]:
    """A partition at a time comes to the driver."""
    for row in J.jq_run(readers.whole_texts(spark, path), "doc", query).select("result").toLocalIterator():
        yield row["result"]


def main() -> None:
    parser = argparse.ArgumentParser(prog="docweave", description=__doc__)
    parser.add_argument("query")
    parser.add_argument("path")
    args = parser.parse_args()
    for text in results(SparkSession.builder.appName("docweave").getOrCreate(), args.query, args.path):
        print(text)


if __name__ == "__main__":
    main()
