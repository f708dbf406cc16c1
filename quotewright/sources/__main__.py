"""python -m quotewright.sources CORPUS.json INDEX [arabic|latin]: store the index of a corpus."""

import sys

from pyspark.sql import SparkSession

from .files import build_index

if __name__ == "__main__":
    spark = SparkSession.builder.getOrCreate()
    build_index(spark, sys.argv[1], sys.argv[2], "idx long, section long, pos long, text string", *sys.argv[3:4])
