"""spark-submit entry: references to an index. python -m nearledger.sources.jobs REFERENCES INDEX [NLIST [ITERS]]"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from ..operators.index import build_index
from .payloads import read_references


def main(args: list[str]) -> None:
    refs, path, nlist, iters = [*args, *["1024", "10"][len(args) - 2 :]][:4]
    spark = SparkSession.builder.appName("build-index").getOrCreate()
    index = build_index(read_references(spark, refs), path, int(nlist), int(iters))
    print(f"{index.n} rows, {index.nlist} cells a bucket, in {path}")


if __name__ == "__main__":
    main(sys.argv[1:])
