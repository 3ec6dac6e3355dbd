"""Joins of notices with reference tables and with each other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.functions.geo import angular_spread, bearing_deg, haversine_km
from noticelake.operators.staging import spread, written

#: Rows up to which a reference table counts as small enough to meet every row.
REFERENCE_ROWS = 10_000

#: Ids of a set up to which any three of them are a key; there are 2,024 threes of 24.
TRIPLES = 24


def checked_reference(reference: DataFrame) -> DataFrame:
    """A reference table that every row is compared with; its size is checked, since the work grows with it."""
    n = reference.limit(REFERENCE_ROWS + 1).count()
    if n > REFERENCE_ROWS:
        raise ValueError(f"a reference table may have {REFERENCE_ROWS} rows")
    return F.broadcast(reference)


def reference_rows(reference: DataFrame) -> list:
    """The rows of a reference table, for use inside tasks; its size is checked."""
    rows = reference.limit(REFERENCE_ROWS + 1).collect()
    if len(rows) > REFERENCE_ROWS:
        raise ValueError(f"a reference table may have {REFERENCE_ROWS} rows")
    return rows


def _cells(lat: Column, lon: Column, degrees: int) -> tuple[Column, Column]:
    return F.floor((lat + 90) / degrees).cast("int"), F.floor((F.pmod(lon + 180, F.lit(360.0))) / degrees).cast("int")


def _beside(rows: DataFrame, places: DataFrame, *columns: str) -> DataFrame:
    """``rows``, each with a whole checked reference as the array ``places``: a row's choice among them needs neither sort nor shuffle."""
    listed = checked_reference(places).agg(F.collect_list(F.struct(*columns)).alias("places"))
    return rows.join(F.broadcast(listed), F.lit(True))


def nearest_within(rows: DataFrame, key: str, places: DataFrame, cap_km: float) -> DataFrame:
    """rows with the code and distance of the nearest place, null beyond ``cap_km``; ties go to the place with the lower ord.

    rows: (key, lat, lon, ...), a row for each key; places: (code, place_lat, place_lon, ord), a checked reference.
    """
    best = nearest_any(rows, key, places)
    near = F.col("distance_km") <= cap_km
    return best.select(key, F.when(near, F.col("code")).alias("code"), F.when(near, F.col("distance_km")).alias("distance_km"))


def nearest_any(rows: DataFrame, key: str, places: DataFrame) -> DataFrame:
    """(key, code, distance_km) of the nearest place, however far; a row for each key."""
    pairs = _beside(rows.select(key, "lat", "lon"), places, "place_lat", "place_lon", "ord", "code")
    measured = lambda p: F.struct(haversine_km(F.col("lat"), F.col("lon"), p["place_lat"], p["place_lon"]).alias("distance_km"), p["ord"].alias("ord"), p["code"].alias("code"))
    best = F.filter(F.array(F.array_min(F.transform("places", measured))), lambda m: m.isNotNull())
    return pairs.select(key, F.explode(best).alias("best")).select(key, "best.code", "best.distance_km")


def nearest_by_direction(
    rows: DataFrame, key: str, sites: DataFrame, near_km: float = 8000.0, west: tuple[float, float] = (225.0, 325.0), rank: Callable[[Column], Column] | None = None, carried: tuple[str, ...] = (), ranked: tuple[str, ...] = ()
) -> DataFrame:
    """The nearest site from which the course is plausible, or the nearest at all if none is.

    A course is implausible for a target within ``near_km`` at an azimuth in ``west``. Order:
    distance, azimuth, ord. ``passed_over`` tells that a nearer site was left out. With a
    ``rank`` of a site (a struct with the columns ``ranked`` too) only sites of a row's lowest rank count, and those without a
    rank never; ``carried`` are more columns of the chosen site to return, with ``odd`` for
    an implausible course. rows have a row for each key.
    """
    pairs = _beside(rows, sites, *dict.fromkeys(("place_lat", "place_lon", "ord", "code", *carried, *ranked)))
    rank = rank or (lambda p: F.lit(0))

    def measured(p: Column) -> Column:
        at = (p["place_lat"], p["place_lon"], F.col("lat"), F.col("lon"))
        return F.struct(rank(p).alias("rank"), haversine_km(*at).alias("distance_km"), bearing_deg(*at).alias("azimuth"), *(p[c].alias(c) for c in ("ord", "code", *carried)))

    def judged(m: Column) -> Column:
        odd = (m["distance_km"] <= near_km) & m["azimuth"].between(*west)
        return F.struct(m["rank"].alias("rank"), odd.alias("odd"), *(m[c].alias(c) for c in ("distance_km", "azimuth", "ord", "code", *carried)))

    counted = F.transform(F.filter("places", lambda p: rank(p).isNotNull()), measured)
    nearest = lambda x: F.array_min(F.transform(x, lambda m: F.struct(m["rank"].alias("rank"), m["distance_km"].alias("distance_km"))))
    both = F.transform(F.array(counted), lambda x: F.struct(F.array_min(F.transform(x, judged)).alias("best"), nearest(x).alias("nearest")))
    best = pairs.select(key, F.explode(F.filter(both, lambda x: x["best"].isNotNull())).alias("x")).select(key, "x.best", "x.nearest")
    more = [F.col(f"best.{c}") for c in (*carried, "odd")] if carried else []
    return best.select(key, "best.code", "best.distance_km", "best.azimuth", (F.col("best.distance_km") > F.col("nearest.distance_km")).alias("passed_over"), *more)


def common_site(zones: DataFrame, group: str, sites: DataFrame, near_km: float = 8000.0, west: tuple[float, float] = (225.0, 325.0)) -> DataFrame:
    """For each group of zone points (group, lat, lon) the site that explains all: least 100 * spread of azimuths + mean distance.

    A site is out if one zone is implausible from it; a group without a site has no row. The
    spread is the smallest arc that holds all azimuths, from sorted neighbours. Points are dealt out by their group
    first, so that pairs of points and sites stay in their task.
    """
    pairs = spread(zones.select(group, "lat", "lon"), group).join(checked_reference(sites), F.lit(True))
    distance = haversine_km(F.col("place_lat"), F.col("place_lon"), F.col("lat"), F.col("lon"))
    azimuth = bearing_deg(F.col("place_lat"), F.col("place_lon"), F.col("lat"), F.col("lon"))
    each = pairs.select(group, "code", "ord", distance.alias("d"), azimuth.alias("a"))
    odd = (F.col("d") <= near_km) & F.col("a").between(*west)
    scored = each.groupBy(group, "code", "ord").agg(
        F.max(odd).alias("out"), F.avg("d").alias("mean_km"), F.sort_array(F.collect_set(F.when(F.col("d") <= near_km, F.col("a")))).alias("angles")
    ).where("not out")
    width = angular_spread(F.col("angles"))
    best = scored.select(group, F.struct((100 * width + F.col("mean_km")).alias("score"), "ord", "code", width.alias("spread"), "mean_km").alias("s")).groupBy(group).agg(F.min("s").alias("s"))
    return best.select(group, "s.code", "s.score", "s.spread", "s.mean_km")


def first_known(rows: DataFrame, key: str, candidates: str, reference: DataFrame) -> DataFrame:
    """(key, code, method): the first candidate code in order that the reference has; ``outside:<first>`` if there are candidates but none known, ``-`` if none."""
    listed = rows.select(key, F.posexplode(candidates).alias("pos", "code"))
    known = listed.join(reference.select("code").distinct(), "code").groupBy(key).agg(F.min(F.struct("pos", "code")).alias("hit"))
    first = F.get(candidates, F.lit(0))
    method = F.when(F.col("hit").isNotNull(), "icao").when(first.isNotNull(), F.concat(F.lit("outside:"), first)).otherwise("-")
    return rows.select(key, candidates).join(known, key, "left").select(key, F.col("hit.code").alias("code"), method.alias("method"))


def contains_interval(wide: DataFrame, narrow: DataFrame, min_ratio: float = 4.0, min_hours: float = 24.0) -> DataFrame:
    """Pairs in which a long window holds a short one: at least ``min_hours`` long and ``min_ratio`` times the short one; only wide rows with exactly one partner.

    wide: (wide_id, part, w_from, w_to); narrow: (narrow_id, part, n_from, n_to). The join is on
    the part and the day of the narrow window's start, which the wide window's days include.
    """
    days = wide.withColumn("day", F.explode(F.sequence(F.to_date("w_from"), F.to_date("w_to"))))
    met = days.join(narrow.withColumn("day", F.to_date("n_from")), ["part", "day"]).where("w_from <= n_from and n_to <= w_to")
    hours = lambda a, b: (F.unix_timestamp(b) - F.unix_timestamp(a)) / 3600
    long = hours("w_from", "w_to")
    kept = met.where((long >= min_hours) & (long >= min_ratio * hours("n_from", "n_to")))
    only = kept.groupBy("wide_id").agg(F.count("*").alias("n"), F.min("narrow_id").alias("narrow_id")).where("n = 1")
    return only.select("wide_id", "narrow_id")


def matches_in_window(windows: DataFrame, instants: DataFrame, slack_minutes: int = 30) -> DataFrame:
    """(window_id, instant_id) with the same part and the instant in the window, stretched by the slack on both ends.

    windows: (window_id, part, w_from, w_to); instants: (instant_id, part, at).
    """
    slack = F.expr(f"INTERVAL {slack_minutes} MINUTES")
    stretched = windows.withColumn("lo", F.col("w_from") - slack).withColumn("hi", F.col("w_to") + slack)
    days = stretched.withColumn("day", F.explode(F.sequence(F.to_date("lo"), F.to_date("hi"))))
    return days.join(instants.withColumn("day", F.to_date("at")), ["part", "day"]).where("at between lo and hi").select("window_id", "instant_id")


def _variants(rows: DataFrame) -> DataFrame:
    """(id, own, all): each different row of an id as the struct ``own``, with the rows of its id where it has several, else null."""
    each = rows.groupBy("id").agg(F.collect_set(F.struct("day", "nation", F.array_distinct("ids").alias("s"))).alias("all"))
    return each.select("id", F.explode("all").alias("own"), F.when(F.size("all") > 1, F.col("all")).alias("all"))


def same_launch(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (left_id, right_id) that share a notice id, are at most a day apart (an unknown date is near) and do not name different nations.

    Both: (id, ids array, day date, nation). A pair that meets several times is given at its first meeting, which the
    two rows tell by themselves: at their least shared id, and where an id has several rows, at the least two that fit.
    So no table of all pairs is kept to tell which are known.
    """
    named = lambda rows, n: _variants(rows).select(F.col("id").alias(f"id{n}"), F.col("own").alias(f"v{n}"), F.col("all").alias(f"all{n}"), F.col("own.day").alias(f"day{n}"), F.explode("own.s").alias("shared"))
    a, b = named(left, 1), named(right, 2)
    alike = lambda v, w: F.coalesce(v["nation"] == w["nation"], F.lit(True))
    near = lambda v, w: F.coalesce(F.abs(F.datediff(v["day"], w["day"])) <= 1, F.lit(True))
    v, w = F.col("v1"), F.col("v2")
    fits = lambda x, y: alike(x, y) & near(x, y) & F.coalesce(F.arrays_overlap(x["s"], y["s"]), F.lit(False))
    before = lambda x, y: (F.struct(x, y) < F.struct(v, w)) & fits(x, y)
    known = F.exists(F.coalesce("all1", F.array(v)), lambda x: F.exists(F.coalesce("all2", F.array(w)), lambda y: before(x, y)))
    first = (F.col("shared") == F.array_min(F.array_intersect("v1.s", "v2.s"))) & ((F.col("all1").isNull() & F.col("all2").isNull()) | ~known)
    # dated rows meet on the day, so that a frequent id costs no more than its rows of three days
    around = a.where("day1 is not null").withColumn("day2", F.explode(F.sequence(F.date_sub("day1", 1), F.date_add("day1", 1))))
    pairs = around.join(b, ["shared", "day2"])
    undated = a.where("day1 is null").join(b, "shared")
    other = a.where("day1 is not null").join(b.where("day2 is null"), "shared")
    out = [x.where(alike(v, w) & first).select(F.col("id1").alias("left_id"), F.col("id2").alias("right_id")) for x in (pairs, undated, other)]
    return out[0].unionByName(out[1]).unionByName(out[2])


def _keys(s: Column, wide: bool) -> Column:
    """What a sorted set answers to: single elements for sets of one or two, three elements together for larger ones; beyond ``TRIPLES`` single ones for these too."""
    after = lambda x, i: F.slice(x, i + 2, F.size(x))
    single = lambda kind: F.transform(s, lambda x: F.struct(F.lit(kind).alias("kind"), F.array(x).alias("of")))
    of_three = F.transform(s, lambda x, i: F.flatten(F.transform(after(s, i), lambda y, j: F.transform(after(after(s, i), j), lambda z: F.struct(F.lit(3).alias("kind"), F.array(x, y, z).alias("of"))))))
    few = F.size(s) <= TRIPLES
    return F.concat(single(1), F.flatten(F.when(few, of_three).otherwise(F.array(single(2)))) if wide else F.flatten(of_three))


def without_subsumed(rows: DataFrame) -> DataFrame:
    """Rows (id, ids array, day, nation, ...) whose id set is not a proper part of the set of another row of the same launch.

    Rows belong to one launch if they are at most a day apart and do not name different
    nations; an unknown day or nation fits any. Rows of equal sets, day and nation are judged
    once. A set meets only those that have its rarest id, or its three rarest together where it has as many, dated ones on
    their days. Of what meets, a mask of hashed ids tells most pairs apart before their sets are compared.
    """
    each = rows.select("id", F.sort_array(F.array_distinct("ids")).alias("s"), "day", "nation")
    mask = F.aggregate("s", F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(x), F.lit(64)).cast("int"))))
    sets = written(each.select("s", "day", "nation").distinct().select("*", mask.alias("mask"), F.array_compact("s").alias("known"), F.monotonically_increasing_id().alias("sid")))
    wide, undated = (not sets.where(x).isEmpty() for x in (F.size("known") > TRIPLES, F.col("day").isNull()))
    elements = sets.select("sid", F.explode("known").alias("e"))
    counts = elements.groupBy("e").agg(F.count("*").alias("n"))
    ranked = elements.join(counts, "e").groupBy("sid").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "e"))), 1, 3).alias("rare"))
    key = lambda kind, of: F.struct(F.lit(kind).alias("kind"), of.alias("of"))
    first, three = F.array(F.col("rare")[0]["e"]), F.sort_array(F.transform("rare", lambda x: x["e"]))
    keys = F.when(F.size("rare") < 3, F.array(key(1, first))).otherwise(F.array(key(3, three), *([key(2, first)] if wide else [])))
    small = sets.join(ranked, "sid").select("s", "day", "nation", "mask", F.explode(keys).alias("e"))
    large = sets.where(F.size("s") > 1).select(*(F.col(c).alias(f"{c}2") for c in ("s", "day", "nation", "mask")), F.explode(_keys(F.col("known"), wide)).alias("e2"))
    agree = F.coalesce(F.col("nation") == F.col("nation2"), F.lit(True))
    part = (F.col("mask").bitwiseAND(F.col("mask2")) == F.col("mask")) & (F.size("s") < F.size("s2")) & (F.size(F.array_intersect("s", "s2")) == F.size("s"))
    meets = (F.col("e") == F.col("e2")) & agree & part
    dated = large.where("day2 is not null")
    around = small.where("day is not null").withColumn("near", F.explode(F.sequence(F.date_sub("day", 1), F.date_add("day", 1))))
    found = around.join(dated, (F.col("near") == F.col("day2")) & meets, "left_semi").drop("near")
    if undated:
        found = found.unionByName(small.join(large.where("day2 is null"), meets, "left_semi")).unionByName(small.where("day is null").join(dated, meets, "left_semi"))
    held = found.select(*(F.col(c).alias(f"held_{c}") for c in ("s", "day", "nation"))).distinct()
    same = (F.col("s") == F.col("held_s")) & F.col("day").eqNullSafe(F.col("held_day")) & F.col("nation").eqNullSafe(F.col("held_nation"))
    return rows.join(each.join(held, same, "left_semi").select("id"), "id", "left_anti")


def sharing_ids(rows: DataFrame) -> DataFrame:
    """(id) of rows (id, day, ids array) that share an element with another row of the same day."""
    shared = rows.select("id", "day", F.explode(F.array_distinct("ids")).alias("e")).groupBy("day", "e").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    busy = shared.where("n > 1").select("day", "e")
    return rows.select("id", "day", F.explode("ids").alias("e")).join(busy, ["day", "e"]).select("id").distinct()


def co_located(sites: DataFrame, within_km: float = 5.0) -> DataFrame:
    """(code, first_code): sites of one country within ``within_km`` of an earlier one (by ord) point to the earliest such; others to themselves."""
    cell_lat, cell_lon = _cells(F.col("place_lat"), F.col("place_lon"), 1)
    celled = sites.withColumn("cy", cell_lat).withColumn("cx", cell_lon)
    around = celled.withColumn("cy", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.col("cy") + d)))
    around = around.withColumn("cx", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.pmod(F.col("cx") + d, F.lit(360)))))
    earlier = around.select(F.col("code").alias("code2"), F.col("ord").alias("ord2"), "country", "cy", "cx", F.col("place_lat").alias("lat2"), F.col("place_lon").alias("lon2"))
    near = haversine_km(F.col("place_lat"), F.col("place_lon"), F.col("lat2"), F.col("lon2")) <= within_km
    found = celled.join(earlier, ["country", "cy", "cx"]).where(near & (F.col("ord2") <= F.col("ord")))
    return found.groupBy("code").agg(F.min(F.struct("ord2", "code2")).alias("m")).select("code", F.col("m.code2").alias("first_code"))
