"""Golden outcomes of parsing, geodesy, decisions, clusters and state."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from noticelake.functions import coords, geo, text, timeparse
from noticelake.operators import cluster, merge
from noticelake.plans import attribution
from noticelake.sources import tables


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def points(spark, t):
    return [(round(p.lat, 4), round(p.lon, 4)) for p in value(spark, coords.coordinates(F.lit(t)))]


@pytest.mark.parametrize(
    ("t", "want"),
    [
        ("1936N11057E", [(19.6, 110.95)]),
        ("1975N11057E", []),
        ("12.50S 130.25W", [(-12.5, -130.25)]),
        ("59-42.60S 165-49.20E", [(-59.71, 165.82)]),
        ("59 03 00 S 131 00 00 W", [(-59.05, -131.0)]),
        ("1936N11057E 1936N11057E", [(19.6, 110.95)]),
        ("0000N00000E", []),
        ("", []),
    ],
)
def test_coordinates(spark, t, want):
    assert points(spark, t) == want


def test_geodesy(spark):
    d = lambda *x: [F.lit(float(v)) for v in x]
    assert value(spark, geo.haversine_km(*d(0, 0, 1, 0))) == pytest.approx(111.195, abs=0.01)
    assert value(spark, geo.bearing_deg(*d(0, 0, 0, 10))) == pytest.approx(90)
    assert value(spark, geo.inclination_deg(*d(28.5, 90))) == pytest.approx(28.5)
    assert 88.0 < value(spark, geo.inclination_deg(*d(45, 180))) < 88.5
    spread = lambda *x: value(spark, geo.angular_spread(F.array(*d(*x))))
    assert spread(350, 10) == 20 and spread(5) == 0
    classes = [value(spark, geo.orbit_class(F.lit(i).cast("double"))) for i in (98, 108, 51.6, 20, 30.5, None)]
    assert classes == ["SSO", "RETRO", "LEO/MEO", "GTO", "Undetermined", "Undetermined"]
    assert value(spark, geo.derived_code(*d(31.2, 123.7))) == "SEA-31N124E"
    assert len(value(spark, geo.great_circle_path(*d(0, 0, 90, 1000)))) == 97
    square = F.array(*(F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon")) for a, b in ((0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0))))
    middle = value(spark, geo.centroid(square))
    assert (round(middle.lat, 9), round(middle.lon, 9)) == (1, 1)
    same = geo.zones_congruent(geo.zone_shape(square, F.lit(None).cast("double")), geo.zone_shape(square, F.lit(None).cast("double")))
    assert value(spark, same) is True


def test_notice_items_and_times(spark):
    notice = "A1234/25 Q) ZGZU/QRDCA/IV/BO/W/000/999/1936N11057E050 A) ZGZU B) 2509210130 C) 2509210430 D) 0130-0430 E) ROCKET LAUNCH WILL TAKE PLACE F) SFC G) UNL | col: E) other"
    items = value(spark, text.items(F.lit(notice)))
    assert items["E"] == "ROCKET LAUNCH WILL TAKE PLACE" and items["G"] == "UNL" and items["B"] == "2509210130"
    assert value(spark, timeparse.notice_time(F.lit("2509210130"))) == datetime(2025, 9, 21, 1, 30)
    for bad in ("PERM", "2513990130", "", "nonsense"):
        assert value(spark, timeparse.notice_time(F.lit(bad))) is None
    found = value(spark, text.triggers(F.lit(notice), F.lit("SFC"), F.lit("UNL"), F.lit(items["Q"])))
    assert {"ROCKET", "LAUNCH", "SFC-UNL (F/G)", "000/999 (Q)"} <= set(found)
    assert value(spark, text.kind(F.lit("launch and re-entry of debris"))) == "Re-entry"
    keys = [value(spark, text.event_key(F.lit(t))) for t in ("A  b\nc", "a B c")]
    assert keys[0] == keys[1] and len(keys[0]) == 12


def test_each_decision(spark):
    """One row for each branch: the first rule that fits decides."""
    fine = {
        "foreign": False, "hint": None, "hint_is_target": False, "confirmed": False, "rejected": False, "has_centroid": True, "fir_method": "icao", "fir_nations": ["CN"], "fir_country_is_target": True,
        "fir_distance_km": 0.0, "level": "HIGH", "has_site": True, "distance_km": 900.0, "implausible": False,
    }
    cases = [
        ({"foreign": True}, 1, "REVIEW"),
        ({"has_centroid": False}, 2, "REVIEW"),
        ({"has_centroid": False, "confirmed": True}, 2, "OK"),
        ({"fir_method": "-"}, 4, "REVIEW"),
        ({"fir_method": "-", "level": "LOW"}, 5, "REVIEW"),
        ({"fir_method": "outside:XXXX"}, 5, "REVIEW"),
        ({"fir_method": "-", "hint": "CN", "hint_is_target": True}, 17, "OK"),
        ({"fir_nations": []}, 6, "REVIEW"),
        ({"fir_method": "geo", "fir_distance_km": 900.0}, 9, "REVIEW"),
        ({"fir_country_is_target": False}, 10, "REVIEW"),
        ({"fir_nations": ["CN", "RU"]}, 11, "REVIEW"),
        ({"level": "LOW"}, 12, "REVIEW"),
        ({"has_site": False}, 13, "REVIEW"),
        ({"distance_km": 0.5}, 14, "REVIEW"),
        ({"implausible": True}, 15, "REVIEW"),
        ({"implausible": True, "confirmed": True}, 15, "OK"),
        ({"distance_km": 20001.0}, 16, "REVIEW"),
        ({}, 17, "OK"),
        ({"rejected": True}, 17, "REVIEW"),
        ({"confirmed": None, "foreign": None}, 17, "OK"),
    ]
    schema = "foreign boolean, hint string, hint_is_target boolean, confirmed boolean, rejected boolean, has_centroid boolean, fir_method string, fir_nations array<string>, fir_country_is_target boolean, fir_distance_km double, level string, has_site boolean, distance_km double, implausible boolean, n int"
    rows = spark.createDataFrame([(*(fine | change).values(), i) for i, (change, _, _) in enumerate(cases)], schema)
    decided = rows.select("n", attribution.decided(attribution.Inputs(**{k: F.col(k) for k in fine})).alias("d")).orderBy("n").collect()
    assert [(r.d.branch, r.d.status) for r in decided] == [(b, s) for _, b, s in cases]


def test_clusters_split_where_no_site_fits(spark):
    rows = [(1, r, "A", az) for r, az in ((1, 90.0), (2, 95.0), (3, 150.0))] + [(2, 1, "A", 10.0), (2, 2, "B", 10.0)]
    found = {(r.cluster, r.row): r.part for r in cluster.split_clusters(spark.createDataFrame(rows, "cluster long, row long, site string, azimuth double")).collect()}
    assert found == {(1, 1): 0, (1, 2): 0, (1, 3): 1, (2, 1): 1, (2, 2): 0}  # of equals the first is taken out and comes after the rest


def test_snapshots_are_replaced_only_if_unchanged(spark, tmp_path):
    path = str(tmp_path / "store")
    first = merge.replace_if_unchanged(spark, path, spark.createDataFrame([(1, "a")], "k int, v string"), None)
    second = merge.replace_if_unchanged(spark, path, spark.createDataFrame([(1, "b")], "k int, v string"), first)
    with pytest.raises(RuntimeError):
        merge.replace_if_unchanged(spark, path, spark.createDataFrame([(1, "c")], "k int, v string"), first)
    assert second != first and spark.read.parquet(merge.newest_snapshot(spark, path)).first().v == "b"


def test_saved_pages(spark):
    html = '<div class="inner">one<br>two<blockquote>quoted</blockquote></div></b><div id="msg_2"><script>x()</script>three &amp; four'
    rows = spark.createDataFrame([(1, html), (2, None), (3, "<p>plain</p><p>page</p>")], "id long, html string")
    found = [(r.id, r.pos, r.text) for r in tables.html_texts(rows, "id", "html").orderBy("id", "pos").collect()]
    assert found == [(1, 0, "one\ntwo"), (1, 1, "three & four"), (3, 0, "plain\npage")]


def test_catalogue(spark):
    line = lambda tag, date, site="JQ?": "\t".join([tag, "x", date, "CZ-2D?", *"----", "Payload", "-", "-", site, *"------", "97.4?", "190"])
    lines = ["#Launch_Tag", line("2024-001", "2024 Jan  3 0312:10"), line("2024-F02", "2024 Feb 30"), line("2024-002", "2024 Mar  1"), line("2019-001", "2019 Jan  3 0312"), line("S-1", "2024 Jan  3"), "short"]
    found = tables.launch_catalogue(spark.createDataFrame([(x,) for x in lines], "value string")).orderBy("tag").collect()
    assert [(r.tag, r.date_only, r.vehicle, r.site, r.inclination) for r in found] == [("2024-001", False, "CZ-2D", "JQ", 97.4), ("2024-002", True, "CZ-2D", "JQ", 97.4)]
    assert found[0].at == datetime(2024, 1, 3, 3, 12)


def test_column_roles(spark):
    frame = spark.createDataFrame([("A1", "ZGZU", "long notice text")], "`NOTAM ID` string, FIR string, `NOTAM Text` string")
    assert tables.column_roles(frame) == {"text": "NOTAM Text", "id": "NOTAM ID", "fir": "FIR"}
    assert tables.column_roles(spark.createDataFrame([("x", "a longer value")], "a string, b string"))["text"] == "b"


def test_notices_are_read_as_they_are_written(spark):
    """Forms that agencies use beside the usual ones."""
    none = F.lit("")
    hits = lambda t: value(spark, text.triggers(F.lit(t), none, none, none))
    assert hits("A TEMPORARY DANGER AREA ESTABLISHED") == ["DANGER AREA"] and hits("AIRSPACE  CLSD") == ["AIRSPACE CLSD"]
    assert hits("UNLIT CRANE 50FT") == [] and hits("LASER UNLESS NOTIFIED") == [] and hits("PRELAUNCH") == []
    assert value(spark, text.triggers(F.lit("X"), F.lit("GROUND"), F.lit("UNLTD"), none)) == ["SFC-UNL (F/G)"]
    assert hits("Q) X/QRDCA/IV/BO/W/000/999/1") == ["000/999 (Q)"]
    assert value(spark, timeparse.notice_time(F.lit("2611161500EST"))) == datetime(2026, 11, 16, 15, 0)
    assert value(spark, timeparse.notice_time(F.lit("03/12/2010 13:06"))) == datetime(2010, 3, 12, 13, 6)
    for form in ("FROM 142100Z TO 232100Z JUL 2026", "FROM 142100 TO 232100 JUL2026", "FROM 142100 UTC TO 232100 UTC JUL 2026"):
        period = value(spark, timeparse.navarea_period(F.lit(form)))
        assert (period.valid_from, period.valid_to) == (datetime(2026, 7, 14, 21, 0), datetime(2026, 7, 23, 21, 0))
    assert value(spark, timeparse.daily_hours(F.lit("0100 - 0400"))) == 3.0
    assert value(spark, text.notice_id(none, F.lit("see A123/25"), F.lit(1))) == "A123/25"
    assert value(spark, text.normalised(F.lit("30&#176; &eacute; &#x27; &amp;lt; &nope; &#1114112; &"))) == "30° é ' &lt; &nope; &#1114112; &"
    point = value(spark, coords.coordinates(F.lit("1936N-11057E")))[0]
    assert (round(point.lat, 4), round(point.lon, 4)) == (19.6, 110.95)
    corners = "1936N11057E 1940N11057E 1940N11100E"
    assert len(value(spark, coords.zones(F.lit(f"1. {corners} 2. {corners.replace('11', '12')}")))) == 2


def test_rows_are_subsumed_within_a_launch_alone(spark):
    from noticelake.operators import joins

    rows = [(1, ["a"], "2025-01-01", "X"), (2, ["a", "b"], "2025-01-02", None), (3, ["b"], "2025-03-01", None), (4, ["a"], None, "Y"), (5, ["a", "b"], "2025-01-02", None), (6, [], "2025-01-01", None), (7, ["a"], "2025-01-01", "Z")]
    frame = spark.createDataFrame(rows, "id long, ids array<string>, day string, nation string").withColumn("day", F.to_date("day"))
    assert {r.id for r in joins.without_subsumed(frame).collect()} == {2, 3, 5, 6}
    pairs = {tuple(r) for r in joins.same_launch(frame.where("id < 5"), frame.where("id >= 5")).collect()}
    assert pairs == {(1, 5), (2, 5), (2, 7), (4, 5)}


def test_named_sites(spark):
    rows = [(1, "space x  starship ftl-14"), (2, "FALCON 9 STARLINK MISSION FROM VANDENBERG SFB"), (3, "SOYUZ FROM PLESETSK\nCOSMODROME"), (4, "A TEMPORARY DANGER AREA ESTABLISHED"), (5, None), (6, "BOCA\nCHICA " * 5000)]
    named = spark.createDataFrame(rows, "i int, t string").select("i", text.named_sites(F.col("t")).alias("s"), text.named_sites(F.col("t"), {}).alias("none")).collect()
    found = {r.i: (r.s.codes, r.s.evidence) for r in named}
    assert found == {
        1: (["KBRO"], ["STARSHIP"]), 2: (["KXMR", "KTTS", "KVBG", "KCOI"], ["FALCON 9", "STARLINK", "VANDENBERG"]), 3: (["GIK-1"], ["PLESETSK"]),
        4: ([], []), 5: ([], []), 6: (["KBRO"], ["BOCA CHICA"])}
    assert all(r.none.codes == [] == r.none.evidence for r in named)
