"""What may be confirmed in bulk, and which archive rows are complete."""

from noticelake.plans import days, launches


def test_bulk_candidates(spark):
    none, some = [], ["x"]
    found = spark.createDataFrame(
        [("good", None, none, none), ("decided", "confirmed", none, none), ("replaces", None, some, none), ("archived", None, none, some), ("two", None, none, none), ("warned", None, none, none), ("unknown", None, none, none), ("blank", None, none, none)],
        "key string, decision string, replaces array<string>, in_archive array<string>",
    )
    keys = ["good", "decided", "replaces", "archived", "two", "two"]
    matches = spark.createDataFrame([*((k, "V1", f"p-{k}", none) for k in keys), ("warned", "V1", "p", some), ("unknown", "V9", "p", none), ("blank", "V2", "p", none)], "key string, vehicle string, payload string, warnings array<string>")
    vehicles = spark.createDataFrame([("V1", "CZ"), ("V1", "CZ"), ("V2", "")], "vehicle string, vehicle_code string")
    assert [tuple(r) for r in days.bulk_candidates(found, matches, vehicles).collect()] == [("good", "CZ", "p-good")]
    assert days.bulk_candidates(found.limit(0), matches, vehicles).collect() == []


def test_incomplete_archive_rows_are_told_apart(spark):
    rows = spark.createDataFrame([("A1", "01.01.2026", "China"), ("A2", "", "China"), ("A3", "01.01.2026", None), (" ", "01.01.2026", "China")], "NOTAM string, Startdatum string, Nation string")
    full, rest = launches.complete(rows)
    assert [r.NOTAM for r in full.collect()] == ["A1"] and sorted(r.NOTAM for r in rest.collect()) == [" ", "A2", "A3"]
