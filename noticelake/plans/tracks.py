"""Clusters of notices cut into parts that lie on one track, each with the site it starts from: one of the reference, or a point at sea.

A cluster is what was published for one launch window. It is split in one task: work for a
step grows with the cluster times the sites of its nations. What a removal leaves as it is
(the widest angle that other notices span, the sums of distances and directions) is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticelake.functions.geo import EARTH_RADIUS_KM
from noticelake.operators import joins

#: Fixed values of a track: degrees between its zones, km from which a course says nothing, courses that no launch takes.
SPREAD_DEG = 15.0
FAR_KM = 8000.0
WEST = (225.0, 325.0)

#: Notices, and points of zones, up to which all pairs of a cluster are worked out at once; larger clusters take them row by row.
PAIRED = 64

#: Rows of a batch that a task hands back.
_BATCH = 4096

#: Fixed values of a start at sea: radius of the platform's circle, km to the nearest site, km to a zone that counts as a target, degrees by which its track must be narrower.
CIRCLE_KM = 60.0
SITE_KM = 150.0
TARGET_KM = 50.0
MARGIN_DEG = 5.0

SCHEMA = "row_index long, cluster long, part int, code string, sea_lat double, sea_lon double, sea_azimuth double, sea_nation string"


def distances(lat1, lon1, lat2, lon2) -> np.ndarray:
    dlat, dlon = np.radians(lat2 - lat1) / 2, np.radians(lon2 - lon1) / 2
    a = np.sin(dlat) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(dlon) ** 2
    return 2 * EARTH_RADIUS_KM * np.arcsin(np.minimum(1.0, np.sqrt(a)))


def courses(lat1, lon1, lat2, lon2) -> np.ndarray:
    p, q, d = np.radians(lat1), np.radians(lat2), np.radians(lon2 - lon1)
    return np.degrees(np.arctan2(np.sin(d) * np.cos(q), np.cos(p) * np.sin(q) - np.sin(p) * np.cos(q) * np.cos(d))) % 360


def widest(angles: np.ndarray) -> tuple[float, int, int]:
    """The largest angle between two of some directions, and where these two are; zero for fewer than two."""
    if len(angles) < 2:
        return 0.0, -1, -1
    order = np.argsort(angles, kind="stable")
    ranked = angles[order]
    # the direction farthest from an angle stands beside its opposite
    at = np.searchsorted(ranked, (ranked + 180) % 360)
    beside = np.stack([at - 1, at % len(ranked)])
    gap = np.abs(ranked - ranked[beside])
    gap = np.minimum(gap, 360 - gap)
    side, k = np.unravel_index(gap.argmax(), gap.shape)
    return float(gap[side, k]), int(order[k]), int(order[beside[side, k]])


@dataclass
class Sites:
    """The reference, in its order."""

    code: list[str]
    nation: list[str]
    lat: np.ndarray
    lon: np.ndarray
    auto: np.ndarray  # whether geometry may choose it; all may where the reference does not say

    @classmethod
    def of(cls, rows: list) -> Sites:
        rows = sorted(rows, key=lambda r: (r["ord"], r["code"]))
        return cls([r["code"] for r in rows], [r["nation"] for r in rows], np.array([r["place_lat"] for r in rows], float), np.array([r["place_lon"] for r in rows], float), np.array(["auto" not in r or r["auto"] for r in rows], bool))


@cache
def _pairs_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of ``n`` notices, at most ``PAIRED``."""
    return np.triu_indices(n, 1)


class _Chosen:
    """The site that explains the remaining notices best, kept up while notices are taken out."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray, nations: list[set[str]], hints: list[set[str]], sites: Sites):
        wanted, said = set().union(*nations), set().union(*hints)
        auto = np.flatnonzero(sites.auto)
        # a set of nations without a site leaves all sites in question
        every = len({sites.nation[s] for s in auto} & wanted) < len(wanted)
        own = {s for s in auto if every or sites.nation[s] in wanted} | {s for s, c in enumerate(sites.code) if c in said}
        self.sites, self.own, self.nations, self.hints = sites, np.array(sorted(own), int), nations, hints
        y, x = sites.lat[self.own], sites.lon[self.own]
        self.km = distances(y, x, lat[:, None], lon[:, None]).reshape(len(lat), -1)
        self.course = courses(y, x, lat[:, None], lon[:, None]).reshape(len(lat), -1)
        self.near = self.km <= FAR_KM
        self.odd = self.near & (self.course >= WEST[0]) & (self.course <= WEST[1])
        self.live = np.ones(len(lat), bool)
        self.pairs = self._all_pairs() if 1 < len(lat) <= PAIRED and len(self.own) else [self._pair(s) for s in range(len(self.own))]
        self.known: dict[tuple[frozenset, frozenset], np.ndarray] = {}

    def _all_pairs(self) -> list[tuple[float, int, int]]:
        """``_pair`` of every site, from the angles between all notices."""
        a, b = _pairs_of(len(self.live))
        gap = np.abs(self.course[a] - self.course[b])
        gap = np.where(self.near[a] & self.near[b], np.minimum(gap, 360 - gap), -1.0)
        most = gap.argmax(0)
        spread = gap.max(0)
        return [(x, int(a[k]), int(b[k])) if x >= 0 else (0.0, -1, -1) for x, k in zip(spread.tolist(), most.tolist(), strict=True)]

    def _pair(self, s: int, without: int = -1) -> tuple[float, int, int]:
        rows = np.flatnonzero(self.live & self.near[:, s])
        rows = rows[rows != without]
        spread, a, b = widest(self.course[rows, s])
        return (spread, int(rows[a]), int(rows[b])) if a >= 0 else (0.0, -1, -1)

    def remove(self, i: int) -> None:
        self.live[i] = False
        self.pairs = [self._pair(s) if i in p[1:] else p for s, p in enumerate(self.pairs)]

    def _allowed(self, names: frozenset, said: frozenset) -> np.ndarray:
        """Sites of the nations, or all if these have none; of these the ones that the texts name, or else whatever they name."""
        if (names, said) not in self.known:
            auto = self.sites.auto[self.own]
            fits = auto & np.array([self.sites.nation[s] in names for s in self.own], bool)
            fits = fits if fits.any() else auto
            named = np.array([self.sites.code[s] in said for s in self.own], bool)
            self.known[names, said] = next((x for x in (fits & named, named) if x.any()), fits)
        return self.known[names, said]

    def _names(self, counts: dict[str, int], n: int) -> frozenset:
        """What all have in common, or else what any has."""
        return frozenset(k for k, c in counts.items() if c == n) or frozenset(k for k, c in counts.items() if c)

    def _counts(self, of: list[set[str]]) -> dict[str, int]:
        counts: dict[str, int] = {}
        for i in np.flatnonzero(self.live):
            for k in of[i]:
                counts[k] = counts.get(k, 0) + 1
        return counts

    def best(self) -> tuple[float, int] | None:
        """(spread, site)."""
        n = int(self.live.sum())
        spreads = np.array([p[0] for p in self.pairs])
        score = 100 * spreads + self.km[self.live].sum(0) / n
        score[self.odd[self.live].any(0) | ~self._allowed(self._names(self._counts(self.nations), n), frozenset(self._counts(self.hints)))] = np.inf
        s = int(score.argmin()) if len(score) else 0
        return (float(spreads[s]), int(self.own[s])) if len(score) and np.isfinite(score[s]) else None

    def to_remove(self) -> int | None:
        """The notice without which the rest's track is narrowest; None if no rest has a site."""
        rows = np.flatnonzero(self.live)
        n = len(rows)
        spreads = np.repeat(np.array([p[0] for p in self.pairs])[None], n, 0)
        place = {int(r): k for k, r in enumerate(rows)}
        for s, (_, a, b) in enumerate(self.pairs):
            for i in {a, b} - {-1}:
                spreads[place[i], s] = self._pair(s, i)[0]
        score = 100 * spreads + (self.km[rows].sum(0) - self.km[rows]) / (n - 1)
        score[self.odd[rows].sum(0) - self.odd[rows] > 0] = np.inf
        counts, said = self._counts(self.nations), self._counts(self.hints)
        for k, i in enumerate(rows):
            left = {name: c - (name in self.nations[i]) for name, c in counts.items()}
            still = frozenset(code for code, c in said.items() if c > (code in self.hints[i]))
            score[k, ~self._allowed(self._names(left, n - 1), still)] = np.inf
        if not score.size:
            return None
        chosen = score.argmin(1)
        cost = np.where(np.isfinite(score.min(1)), spreads[np.arange(n), chosen], np.inf)
        k = int(cost.argmin())
        return int(rows[k]) if np.isfinite(cost[k]) else None


class _AtSea:
    """The start that the zones themselves point to: one of them is the platform, and from it the others lie on one track."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray, owner: np.ndarray, circle: np.ndarray, sites: Sites):
        self.lat, self.lon, self.owner, self.circle, self.sites = lat, lon, owner, circle, sites
        self.live = np.ones(len(lat), bool)
        self.targets, self.east, self.north = np.zeros(len(lat), int), np.zeros(len(lat)), np.zeros(len(lat))
        self.all = self._seen(slice(None)) if len(lat) <= PAIRED else None
        for x in range(len(lat)):
            self._count(x, 1)
        # two points that an origin sees more than a track apart; -1 where none is known
        self.apart = np.full((len(lat), 2), -1)

    def _seen(self, x) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Points x seen from every origin: whether they are targets, their course, its sine and cosine where they are."""
        y0, x0 = self.lat[:, None], self.lon[:, None]
        far = distances(y0, x0, self.lat[x], self.lon[x]) >= TARGET_KM
        course = courses(y0, x0, self.lat[x], self.lon[x])
        angle = np.radians(course)
        return far, course, far * np.sin(angle), far * np.cos(angle)

    def _count(self, x: int, sign: int) -> None:
        """A point as a target of every origin, added or taken away."""
        far, _, east, north = (v[:, x] for v in self.all) if self.all else (v[:, 0] for v in self._seen([x]))
        self.targets += sign * far
        self.east += sign * east
        self.north += sign * north

    def remove(self, member: int) -> None:
        for x in np.flatnonzero(self.owner == member):
            self.live[x] = False
            self._count(x, -1)
            self.apart[(self.apart == x).any(1)] = -1

    def _spread(self, o: int) -> float | None:
        """The angle that an origin's targets span if it is that of a track."""
        if self.all:
            at = np.flatnonzero(self.live & self.all[0][o])
            angles = self.all[1][o, at]
        else:
            at = np.flatnonzero(self.live & (distances(self.lat[o], self.lon[o], self.lat, self.lon) >= TARGET_KM))
            angles = courses(self.lat[o], self.lon[o], self.lat[at], self.lon[at])
        lean = (angles - angles[0] + 180) % 360 - 180
        low, high = int(lean.argmin()), int(lean.argmax())
        far = int(np.abs(lean).argmax())
        if abs(lean[far]) > SPREAD_DEG:
            self.apart[o] = at[0], at[far]
        elif lean[high] - lean[low] > SPREAD_DEG:
            self.apart[o] = at[low], at[high]
        else:
            return float(lean[high] - lean[low])
        return None

    def best(self) -> tuple[float, float, float, float, int] | None:
        """(lat, lon, mean course, spread, notice) of the start; circles first, and none within reach of a known site."""
        if self.live.sum() < 3:
            return None
        mean = np.degrees(np.arctan2(self.east, self.north)) % 360
        fits = self.live & (self.targets >= 2) & ~((mean >= WEST[0]) & (mean <= WEST[1]))
        tried = fits & self.circle if (fits & self.circle).any() else fits
        found = [(s, o) for o in np.flatnonzero(tried & (self.apart[:, 0] < 0)) if (s := self._spread(int(o))) is not None]
        if not found:
            return None
        spread, o = min(found)
        if len(self.sites.code) and distances(self.lat[o], self.lon[o], self.sites.lat, self.sites.lon).min() < SITE_KM:
            return None
        return float(self.lat[o]), float(self.lon[o]), float(mean[o]), spread, int(self.owner[o])


def parts(members: list[dict], sites: Sites, targets: frozenset[str]) -> list[tuple[list[int], str | None, tuple | None]]:
    """(members by number, site code, (lat, lon, mean course, nation) at sea) of each part; members in their order.

    Where no start explains all, the notice whose removal narrows the track most goes, until
    the rest is one track or one notice. A start at sea keeps a cluster together, and replaces
    the reference's site where its track is narrower by the margin and a nation is known: that
    of the airspace of the platform's notice, its own, or the only one in question.
    """
    n = len(members)
    if n == 1:
        return [([0], None, None)]
    column = lambda c: np.array([m[c] for m in members], float)  # noqa: E731  a null is not a number
    site = _Chosen(column("lat"), column("lon"), [set(m["nations"]) for m in members], [set(m["site_hints"] or ()) for m in members], sites)
    spots = [(p["lat"], p["lon"], i) for i, m in enumerate(members) for p in m["points"]]
    radius = column("radius_km")
    owner = np.array([s[2] for s in spots], int)
    sea = _AtSea(np.array([s[0] for s in spots], float), np.array([s[1] for s in spots], float), owner, radius[owner] <= CIRCLE_KM, sites)
    gone: list[int] = []
    while True:
        rest = [int(i) for i in np.flatnonzero(site.live)]
        singles = [([i], None, None) for i in reversed(gone)]
        if len(rest) == 1:
            return [(rest, None, None), *singles]
        found, derived = site.best(), sea.best()
        if found and found[0] <= SPREAD_DEG or derived:
            if derived and (not found or derived[3] + MARGIN_DEG < found[0]):
                lat, lon, mean, _, i = derived
                left = site._names(site._counts(site.nations), len(rest))
                named = (members[i]["fir_country"], members[i]["nation"], next(iter(left)) if len(left) == 1 else None)
                nation = next((x for x in named if x in targets), None)
                if nation:
                    return [(rest, None, (lat, lon, mean, nation)), *singles]
            return [(rest, sites.code[found[1]] if found else None, None), *singles]
        out = site.to_remove()
        if out is None:
            return [*(([i], None, None) for i in rest), *singles]
        gone.append(out)
        site.remove(out)
        sea.remove(out)


_ARROW = pa.schema([("row_index", pa.int64()), ("cluster", pa.int64()), ("part", pa.int32()), ("code", pa.string()), ("sea_lat", pa.float64()), ("sea_lon", pa.float64()), ("sea_azimuth", pa.float64()), ("sea_nation", pa.string())])


def _clusters(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each cluster, from rows sorted by cluster."""
    found: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if found and found[0]["cluster"] != row["cluster"]:
                yield found
                found = []
            found.append(row)
    if found:
        yield found


def tracks(clustered: DataFrame, sites: DataFrame, targets: tuple[str, ...] | None = None) -> DataFrame:
    """``SCHEMA``: each row's part of its cluster, with the site code of a part of several notices, or its start at sea.

    clustered: (row_index, cluster, valid_from, lat, lon, nations, points, radius_km,
    fir_country, nation), where ``points`` are the centres of a notice's zones, with site_hints
    where texts name sites; sites: (code, place_lat, place_lon, ord, nation), of checked size,
    with auto where geometry may not choose all; targets: the nations that a start at
    sea may have, those of the sites if none are given. Only clusters of several rows are gathered.
    """
    rows = joins.reference_rows(sites)
    if "site_hints" not in clustered.columns:
        clustered = clustered.withColumn("site_hints", F.array().cast("array<string>"))
    known = clustered.sparkSession.sparkContext.broadcast((Sites.of(rows), frozenset(targets if targets is not None else (r["nation"] for r in rows))))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)
        out: list[tuple] = []
        for cluster in _clusters(batches):
            for k, (part, code, at) in enumerate(parts(cluster, *known.value)):
                out += [(cluster[i]["row_index"], cluster[i]["cluster"], k, code, *(at or (None,) * 4)) for i in part]
            if len(out) >= _BATCH:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    several = clustered.groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1")
    alone = clustered.join(several, "cluster", "left_anti").select("row_index", "cluster", F.lit(0).alias("part"), *(F.lit(None).cast(kind).alias(c) for c, kind in (x.split() for x in SCHEMA.split(", ")[3:])))
    met = clustered.join(several.select("cluster"), "cluster")
    # the time gives the order alone: years beyond 9999 are no times in Python
    together = met.repartition("cluster").sortWithinPartitions("cluster", "valid_from", "row_index").drop("valid_from")
    return together.mapInArrow(split, SCHEMA).unionByName(alone)
