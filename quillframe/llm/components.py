"""Connected components over a table of links, by alternating large-star and small-star steps, never on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm import common as C


#: Links of a file, on average: small tables are not cut into as many files as a shuffle has partitions.
LINKS = 50_000


def components(links: DataFrame) -> DataFrame:
    """``links`` (a long, b long) gives (node, label), label the smallest node reachable; nodes without a link to another have no row.

    A step joins each node's links to their minimum, so a hub of many links is two joins that Spark can split, not one group in
    a task. Each round is written to the shared folder; the loop ends when a round changes nothing.
    """
    spark = links.sparkSession
    to = C.shared_dir(spark)
    edges = C.written(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{to}/0")
    seen, k = None, 0
    while True:
        # a sum of hashes may wrap, so it is one of decimals
        sign = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(sign) == seen or not sign[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        seen, k, files = tuple(sign), k + 1, -(-sign[0] // LINKS)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = C.written(large.coalesce(files), f"{to}/{k}l")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = C.written(small.coalesce(files), f"{to}/{k}")
