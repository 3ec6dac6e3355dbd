"""Which notices are one launch: time clusters and the splitting of what does not fit together."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def gap_and_span(rows: DataFrame, part: str, time: str, order: str, gap: int, span: int) -> DataFrame:
    """Rows with a cluster number within each part: a row joins the cluster before it if it is at most ``gap`` after the last row and ``span`` after the first.

    Rows without a time or a part are in no cluster. A part is folded in one task as a stream
    that keeps the first and last time of a cluster, however many rows follow without a gap.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, first, last, n = None, 0, 0, 0
        for batch in batches:
            clusters = []
            for p, t in zip(batch.column(part).to_pylist(), batch.column(time).to_pylist(), strict=True):
                if p != of:
                    of, first, n = p, t, 1
                elif t - last > gap or t - first > span:
                    first, n = t, n + 1
                last = t
                clusters.append(n)
            yield batch.append_column("cluster", pa.array(clusters, pa.int32()))

    known = rows.where(F.col(part).isNotNull() & F.col(time).isNotNull())
    ranked = known.repartition(part).sortWithinPartitions(part, time, order)
    return ranked.mapInArrow(fold, StructType([*known.schema.fields, StructField("cluster", IntegerType())]))


def _spread(azimuths: list[float]) -> float:
    best = 0.0
    for i, a in enumerate(azimuths):
        for b in azimuths[:i]:
            d = abs(a - b) % 360
            best = max(best, min(d, 360 - d))
    return best


def _splits(sites: dict[int, dict[str, float]], limit: float) -> list[list[int]]:
    """Members by row -> azimuth from each plausible site: members that no site explains within the limit are taken out one by one."""
    members = sorted(sites)
    common = set.intersection(*(set(sites[m]) for m in members)) if members else set()
    spreads = [_spread([sites[m][s] for m in members]) for s in common]
    if len(members) <= 1 or (spreads and min(spreads) <= limit):
        return [members] if members else []

    def without(m: int) -> float:
        rest = [x for x in members if x != m]
        shared = set.intersection(*(set(sites[x]) for x in rest))
        return min((_spread([sites[x][s] for x in rest]) for s in shared), default=float("inf"))

    costs = {m: without(m) for m in members}
    if min(costs.values()) == float("inf"):
        return [[m] for m in members]
    out = min(members, key=lambda m: (costs[m], m))
    return [*_splits({m: sites[m] for m in members if m != out}, limit), [out]]


def split_clusters(azimuths: DataFrame, limit: float = 15.0) -> DataFrame:
    """(cluster, row, part): parts of each cluster whose members one site explains with azimuths within ``limit`` degrees.

    azimuths: (cluster, row, site, azimuth) of the sites that are plausible for a member.
    Clusters are the notices of one launch window, so a group is a handful of rows.
    """

    def split(group: pd.DataFrame) -> pd.DataFrame:
        sites = {int(row): dict(zip(g["site"], g["azimuth"], strict=True)) for row, g in group.groupby("row")}
        parts = _splits(sites, limit)
        rows = [(group["cluster"].iloc[0], m, i) for i, part in enumerate(parts) for m in part]
        return pd.DataFrame(rows, columns=["cluster", "row", "part"])

    return azimuths.groupBy("cluster").applyInPandas(split, "cluster long, row long, part int")


