"""Parts of clusters against a plain statement of the rules, a start at sea with published figures, and a cluster of two thousand."""

import datetime as dt
import math
import random
import time

import pytest

from noticelake.plans import launches, tracks


def km(a, b):
    return float(tracks.distances(*map(tracks.np.float64, (*a, *b))))


def course(a, b):
    return float(tracks.courses(*map(tracks.np.float64, (*a, *b))))


def spread(angles):
    return max((min(abs(a - b) % 360, 360 - abs(a - b) % 360) for a in angles for b in angles), default=0.0)


def plain_site(members, sites):
    sets = [set(m["nations"]) for m in members]
    names = set.intersection(*sets) or set.union(*sets)
    said = {c for m in members for c in m["site_hints"]}
    auto = [x for x in sites if x[5]]
    fits = [x for x in auto if x[4] in names] or auto
    best = None
    for s in [x for x in fits if x[0] in said] or [x for x in sites if x[0] in said] or fits:
        seen = [(km((s[1], s[2]), (m["lat"], m["lon"])), course((s[1], s[2]), (m["lat"], m["lon"]))) for m in members]
        if any(d <= 8000 and 225 <= a <= 325 for d, a in seen):
            continue
        wide = spread([a for d, a in seen if d <= 8000])
        score = 100 * wide + sum(d for d, _ in seen) / len(seen)
        if best is None or score < best[0] - 1e-9:
            best = (score, wide, s[0])
    return best and best[1:]


def plain_sea(members, sites):
    spots = [(p["lat"], p["lon"], m) for m in members for p in m["points"]]
    if len(spots) < 3:
        return None
    best = None
    for tried in ([s for s in spots if s[2]["radius_km"] is not None and s[2]["radius_km"] <= 60], spots):
        for lat, lon, m in tried:
            angles = [course((lat, lon), s[:2]) for s in spots if km((lat, lon), s[:2]) >= 50]
            mean = math.degrees(math.atan2(sum(math.sin(math.radians(a)) for a in angles), sum(math.cos(math.radians(a)) for a in angles))) % 360
            if len(angles) >= 2 and not 225 <= mean <= 325 and (best is None or spread(angles) < best[3] - 1e-9):
                best = (lat, lon, mean, spread(angles), m)
        if best:
            break
    return best if best and best[3] <= 15 and min(km(best[:2], s[1:3]) for s in sites) >= 150 else None


def plain_parts(members, sites, targets):
    if len(members) == 1:
        return [([members[0]["row_index"]], None, None)]
    site, sea = plain_site(members, sites), plain_sea(members, sites)
    if site and site[0] <= 15 or sea:
        rows = [m["row_index"] for m in members]
        if sea and (not site or sea[3] + 5 < site[0]):
            sets = [set(m["nations"]) for m in members]
            names = set.intersection(*sets) or set.union(*sets)
            nation = next((n for n in (sea[4]["fir_country"], sea[4]["nation"], min(names) if len(names) == 1 else None) if n in targets), None)
            if nation:
                return [(rows, None, (round(sea[0], 6), round(sea[1], 6), round(sea[2], 6), nation))]
        return [(rows, site[1] if site else None, None)]
    costs = [(r[0], i) for i in range(len(members)) if (r := plain_site(members[:i] + members[i + 1 :], sites))]
    if not costs:
        return [([m["row_index"]], None, None) for m in members]
    low = min(c for c, _ in costs)
    out = next(i for c, i in costs if c <= low + 1e-9)
    return [*plain_parts(members[:out] + members[out + 1 :], sites, targets), ([members[out]["row_index"]], None, None)]


SITES = [("S1", 0.0, 0.0, 1, "A", True), ("S2", 30.0, 40.0, 2, "A", True), ("S3", -20.0, 10.0, 3, "B", True), ("S4", 5.0, 100.0, 4, "C", True), ("S5", 5.0, 100.02, 5, "C", False)]


def known(sites):
    return tracks.Sites.of([dict(zip(("code", "place_lat", "place_lon", "ord", "nation", "auto"), s, strict=True)) for s in sites])


def member(row, lat, lon, nations, points=None, radius=None, country=None, nation=None, hints=()):
    return {"site_hints": list(hints), "row_index": row, "lat": lat, "lon": lon, "nations": nations, "points": points or [{"lat": lat, "lon": lon}], "radius_km": radius, "fir_country": country, "nation": nation}


def random_cluster(seed):
    rng = random.Random(seed)
    base, lean = (rng.uniform(-30, 40), rng.uniform(-60, 120)), rng.uniform(0, 360)
    out = []
    for row in range(rng.randrange(1, 9)):
        far = 0.0 if row == 0 and rng.random() < 0.6 else rng.uniform(2, 25)
        angle = math.radians(lean + rng.choice((rng.uniform(-4, 4), rng.uniform(-4, 4), rng.uniform(-180, 180))))
        lat, lon = base[0] + far * math.cos(angle), base[1] + far * math.sin(angle)
        points = [{"lat": lat + i * 3.0, "lon": lon} for i in range(rng.choice((1, 1, 2)))]
        out.append(member(row, lat, lon, rng.sample("ABCD", rng.choice((1, 1, 2))), points, rng.choice((None, 20.0, 90.0)), rng.choice("ABX"), rng.choice(("A", None)), rng.sample(("S1", "S2", "S3", "S4", "S5", "none"), rng.choice((0, 0, 0, 1, 2)))))
    return out


@pytest.mark.parametrize("seed", range(400))
def test_parts_follow_the_rules(seed):
    cluster, targets = random_cluster(seed), frozenset("ABC")
    got = [([cluster[i]["row_index"] for i in part], code, at and (*(round(x, 6) for x in at[:3]), at[3])) for part, code, at in tracks.parts(cluster, known(SITES), targets)]
    assert got == plain_parts(cluster, SITES, targets)


#: A start from a ship: the platform's circle and two notices of drop zones, one of them with two areas.
BASE = dt.datetime(2026, 7, 22, 2, 30)
SHIP = [
    (1, "A2827/26", 0, ["China"], [(31.2, 123.7)], 30.0, "China", "China"),
    (2, "A2385/26", 10, ["China", "Taiwan"], [(28.2, 123.8)], None, "Taiwan", None),
    (3, "P3438/26", 15, ["China", "Japan"], [(25.0, 124.0), (18.4, 124.4)], None, "Japan", None),
]
EVENT = """row_index long, id string, kind string, level string, valid_from timestamp, valid_to timestamp, lat double, lon double, fir string, nation string, nations array<string>, site string,
distance_km double, azimuth double, inclination double, orbit string, reliability string, branch int, status string, requires_group boolean, override boolean, zones array<array<struct<lat double, lon double>>>,
radius_km double, fir_country string, daily string"""


def event(row, name, start, end, nations, points, radius, country, nation, branch=9, daily=""):
    middle = (sum(p[0] for p in points) / len(points), sum(p[1] for p in points) / len(points))
    square = lambda p: [p] if radius else [(p[0] + a, p[1] + b) for a, b in ((-0.4, -0.4), (-0.4, 0.4), (0.4, 0.4), (0.4, -0.4))]
    none = (None,) * 6
    return (row, name, "Launch", "HIGH", start, end, *middle, "F", nation, nations, *none, branch, "REVIEW", branch == 9, False, [square(p) for p in points], radius, country, daily)


def ship_events():
    hour = dt.timedelta(hours=1)
    rows = [event(r, name, BASE + dt.timedelta(minutes=m), BASE + dt.timedelta(minutes=50), nations, points, radius, country, nation, 13 if radius else 9) for r, name, m, nations, points, radius, country, nation in SHIP]
    rows.append(event(4, "A2371/26", BASE - 24.733 * hour, BASE + 40 * hour, ["China", "Taiwan"], [(28.21, 123.8)], None, "Taiwan", None, 6, "DLY 0200-0500"))
    rows.append(event(5, "P3423/26", BASE - 20 * hour, BASE + 40 * hour, ["China", "Japan"], [(25.0, 124.01)], None, "Japan", None, 6))
    rows.append(event(6, "X1/26", BASE - 20 * hour, BASE + 40 * hour, ["Japan"], [(25.0, 124.01)], None, "Japan", None, 6))  # another nation
    rows.append(event(7, "X2/26", BASE - 20 * hour, BASE + 40 * hour, ["China"], [(25.0, 125.5)], None, "Japan", None, 6))  # another place
    return rows


def test_a_start_at_sea_and_its_announcements(spark):
    events = spark.createDataFrame(ship_events(), EVENT)
    sites = spark.createDataFrame([("HYOS", 36.7, 121.2, 1, "China"), ("XSLC", 28.2, 102.0, 2, "China"), ("TNSC", 30.4, 131.0, 3, "Japan")], "code string, place_lat double, place_lon double, ord long, nation string")
    found = launches.grouped(events, sites, targets=("China",))
    [start] = found.launches.collect()
    assert (start.site, start.nation, start.n, start.at_sea, start.ids) == ("SEA-31N124E", "China", 3, True, ["A2827/26", "A2385/26", "P3438/26"])
    assert start.spread < 5 and 170 < start.azimuth < 185 and 85 < start.inclination < 90 and (round(start.site_lat, 6), round(start.site_lon, 6)) == (31.2, 123.7)
    advance = launches.advance_notices(events, found)
    assert sorted((r.row_index, r.label, round(r.lead_hours, 3)) for r in advance.collect()) == [(4, "START-01", 24.733), (5, "START-01", 20.0)]
    [with_them] = launches.with_advance(found, events, advance).collect()
    assert with_them.n == 3 and with_them.advance_ids == ["A2371/26", "P3423/26"] and round(with_them.advance_hours, 3) == 24.733
    settled = {r.row_index: r for r in launches.settled_events(events, found, advance).collect()}
    assert {i: (r.label, r.status, r.nation, r.kind) for i, r in settled.items() if i in (1, 3, 4, 6)} == {
        1: ("START-01", "OK", "China", "Launch"), 3: ("START-01", "OK", "China", "Launch"), 4: ("START-01", "OK", "China", "Advance notice"), 6: (None, "REVIEW", None, "Launch")}
    assert settled[1].distance_km < 1e-6 and abs(settled[1].azimuth - start.azimuth) < 3
    [row] = launches.archive_rows(found).collect()
    assert (row.NOTAM, row.Startdatum, row.Startzeit, row.Weltraumbahnhof) == ("A2827/26, A2385/26, P3438/26", "22.07.2026", "02:30", "SEA-31N124E")
    assert row.Dropzones == "28.2000 123.8000; 25.0000 124.0000; 18.4000 124.4000" and row.key == "22.07.2026|A2385/26,A2827/26,P3438/26"
    nothing = launches.grouped(events.limit(0), sites)
    assert nothing.launches.collect() == [] and launches.advance_notices(events.limit(0), nothing).collect() == []


def test_a_notice_that_fits_two_starts_stays_in_review(spark):
    rows = ship_events()[:4]
    later = [event(r + 10, name + "b", BASE + dt.timedelta(hours=20, minutes=m), BASE + dt.timedelta(hours=20, minutes=50), nations, points, radius, country, nation, 13 if radius else 9) for r, name, m, nations, points, radius, country, nation in SHIP]
    rows[3] = (*rows[3][:-1], "")
    events = spark.createDataFrame(rows + later, EVENT)
    sites = spark.createDataFrame([("XSLC", 28.2, 102.0, 2, "China")], "code string, place_lat double, place_lon double, ord long, nation string")
    found = launches.grouped(events, sites)
    assert found.launches.count() == 2 and launches.advance_notices(events, found).collect() == []


def test_a_cluster_of_two_thousand():
    rng = random.Random(1)
    cluster = [member(i, rng.uniform(-40, 60), rng.uniform(5, 150), ["A"]) for i in range(2000)]
    began = time.time()
    found = tracks.parts(cluster, known(SITES), frozenset("A"))
    assert sorted(i for part, _, _ in found for i in part) == list(range(2000)) and time.time() - began < 120
