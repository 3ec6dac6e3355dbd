"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticelake.llm.common import few_files, written


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of ``links`` (a, b of one ordered type); component is the smallest node reachable.

    Links with a null end and loops are left out; repeated links count once. Every round
    is written to the shared folder, so a lost executor costs at most that round. The
    number of rounds grows with the logarithm of the nodes; only a count reaches the driver.
    """
    pairs = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = written(few_files(pairs), "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        larger = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = larger.groupBy("u").agg(F.min("v").alias("m"))
        joined = larger.join(small, "u")
        smaller = joined.select("u", F.col("m").alias("v")).unionByName(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        edges = written(few_files(smaller), "edges")
        # the pairs have settled when every node points at a node that points nowhere
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if seen == tuple(now):
            break
        seen = tuple(now)
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
