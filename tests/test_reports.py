"""Texts of reports, hidden launches and tracks from other sites: golden values, nulls and empty tables."""

import datetime as dt

from pyspark.sql import functions as F

from noticelake.plans import launches, past, reports
from tests.test_tracks import BASE, EVENT, ship_events

SITES = "code string, place_lat double, place_lon double, ord long, nation string"


def test_texts(spark):
    rows = [(1, None, None), (2, BASE, None), (3, None, BASE), (4, BASE, BASE + dt.timedelta(hours=1))]
    found = {r.i: r.w for r in spark.createDataFrame(rows, "i int, a timestamp, b timestamp").select("i", reports.window_text(F.col("a"), F.col("b")).alias("w")).collect()}
    assert found == {1: "-", 2: "ab 22.07.2026 02:30Z", 3: "bis 22.07.2026 02:30Z", 4: "22.07.2026 02:30Z - 22.07.2026 03:30Z"}
    hours = [None, 0.75, 1.99, 2.0, 47.96, 48.0, 60.0, 84.0]
    texts = [r.t for r in spark.createDataFrame([(i, h) for i, h in enumerate(hours)], "i int, h double").orderBy("i").select(reports.hours_text(F.col("h")).alias("t")).collect()]
    assert texts == ["unknown", *(f"{h * 60:.0f} minutes" if h < 2 else f"{h:.1f} hours" if h < 48 else f"{h / 24:.0f} days" for h in hours[1:])]
    one = spark.range(1).select(reports.named(F.lit("Indien"), reports.NATION_NAMES).alias("a"), reports.named(F.lit(""), reports.NATION_NAMES).alias("b"), reports.marked_id(F.lit("A1/26"), F.lit(True)).alias("c"), reports.hide_reason(F.lit("LOW"), F.lit(None)).alias("d")).first()
    assert tuple(one) == ("India", "-", "⬢ A1/26", "")


def test_track_from_another_site(spark):
    rows = [(1, 28.2, 102.0, "27.0 103.5; 20.0 110.0"), (2, 28.2, 102.0, "28.2 102.0; 20.0 110.0"), (3, 28.2, 102.0, None), (4, 28.2, 102.0, "x; 1")]
    tracked = {r.i: tuple(r.t) for r in spark.createDataFrame(rows, "i int, y double, x double, z string").select("i", reports.track_from_site(F.col("y"), F.col("x"), F.col("z")).alias("t")).collect()}
    assert tracked[2] == ("", "", "-", "zone on the launch site") and tracked[3] == tracked[4] == ("", "", "-", "no drop zones to compute the orbit from")
    assert 120 < float(tracked[1][1]) < 145 and 35 < float(tracked[1][0]) < 60 and tracked[1][2:] == ("LEO/MEO", "")


def test_past_launches(spark):
    events = spark.createDataFrame(ship_events(), EVENT)
    sites = spark.createDataFrame([("XSLC", 28.2, 102.0, 2, "China")], SITES)
    found = launches.grouped(events, sites)
    advance = launches.advance_notices(events, found)
    keys = launches.archive_rows(found).select("key")
    end = BASE + dt.timedelta(hours=40)  # the announcements run longest
    at = lambda hours: F.lit(end + dt.timedelta(hours=hours)).cast("timestamp")
    over = lambda archived, hours, removed=None: past.past_launches(found, events, advance, archived, at(hours), removed)
    assert over(keys, 24).count() == 0 and over(keys.where("false"), 25).count() == 0 and over(keys, 25, keys).count() == 0
    [row] = over(keys, 25).collect()
    assert (row.label, row.last_end) == ("START-01", end)
    gone = over(keys, 25)
    assert sorted(r.row_index for r in past.past_rows(found, advance, gone).collect()) == [1, 2, 3, 4, 5]
    note = lambda removed: [tuple(r) for r in past.archive_notes(found, gone, removed).collect()]
    assert note(None) == note(keys.where("false")) == [("START-01", "past")] and note(keys) == [("START-01", "removed from archive")]
    hidden = lambda rows: past.hidden_launches(found, gone, events.where(F.col("row_index").isin(rows))).first().n
    assert hidden([2]) == 1 and hidden([4, 6]) == 0
    settled = launches.settled_events(events, found, advance)
    assert sorted(r.row_index for r in past.shown_points(settled, events.where("row_index in (1, 4, 6)")).collect()) == [1, 4]
    [shown] = reports.launch_report(launches.with_advance(found, events, advance), notes=past.archive_notes(found, gone)).collect()
    assert (shown["Vorankündigung"], shown["Archiv"], shown["Sperrzonen"], shown["Pad"]) == ("A2371/26, P3423/26 (25 h)", "past", 3, "-")
    assert shown["Startfenster (UTC)"].startswith("22.07.2026 02:30Z - ") and shown["Weltraumbahnhof"] == "SEA-31N124E"
    table = {r["row_index"]: r for r in reports.event_report(settled).collect()}
    assert table[4]["Start"] == "START-01" and table[6]["Start"] == "-" and table[1]["Trägersystem"] == "-" and table[3]["Punkte"] == 8
    nothing = launches.grouped(events.limit(0), sites)
    assert reports.launch_report(nothing.launches).count() == 0 and reports.event_report(settled.limit(0)).count() == 0
