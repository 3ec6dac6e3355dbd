"""Tables with preambles, pasted texts, co-located sites and distances on the ellipsoid."""

import pytest
from pyspark.sql import functions as F

from noticelake.functions import geo, text
from noticelake.operators import sites as places
from noticelake.sources import tables


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def written(tmp_path, name, content):
    path = tmp_path / name
    path.write_bytes(content)
    return str(path)


def test_surface_distances(spark):
    """Published pairs: GeographicLib's documentation, Karney 2013, the line from Flinders Peak to Buninyong; opposite points and poles."""
    pairs = [
        (-41.32, 174.81, 40.96, -5.50, 19959.679267), (0.0, 0.0, 0.5, 179.5, 19936.288579), (-30.0, 0.0, 29.9, 179.8, 19989.832828),
        (-37.95103341667, 144.42486788889, -37.65282113889, 143.92649552778, 54.972271), (0.0, 0.0, 90.0, 7.0, 10001.965729),
        (0.0, 0.0, 0.0, 180.0, 20003.931459), (10.0, 20.0, -10.0, -160.0, 20003.931459), (90.0, 0.0, -90.0, 50.0, 20003.931459),
        (0.0, 0.0, 0.0, 1.0, 111.319491), (0.0, 179.5, 0.0, -179.5, 111.319491), (40.0, 10.0, 40.0, 10.0, 0.0),
    ]
    frame = spark.createDataFrame(pairs, "a double, b double, c double, d double, km double")
    both = frame.select("km", geo.surface_km(*(F.col(x) for x in "abcd")).alias("one"), geo.surface_km(*(F.col(x) for x in "cdab")).alias("two"))
    for r in both.collect():
        assert abs(r.one - r.km) < 1e-6 and abs(r.two - r.km) < 1e-6
    odd = spark.createDataFrame([(91.0, 0.0), (float("nan"), 0.0), (0.0, float("nan")), (None, 0.0), (0.0, None)], "a double, b double")
    assert all(r.km is None for r in odd.select(geo.surface_km(F.col("a"), F.col("b"), F.lit(1.0), F.lit(1.0)).alias("km")).collect())


def test_both_ways_to_a_distance_agree(spark):
    rows = spark.range(300).select(*(((F.rand(i) - 0.5) * w).alias(c) for i, (c, w) in enumerate(zip("abcd", (178, 360, 178, 360), strict=True))))
    reduced = lambda lat: F.atan((1 - geo.WGS84_F) * F.tan(F.radians(lat)))
    apart = F.pmod(F.col("d") - F.col("b"), F.lit(360.0))
    p = F.struct(reduced(F.col("a")).alias("u"), reduced(F.col("c")).alias("v"), F.radians(F.least(apart, 360 - apart)).alias("l"))
    bisected = text.once(p, lambda e: geo._opposite_km(e))
    assert rows.select(F.max(F.abs(bisected - geo.surface_km(*(F.col(x) for x in "abcd"))))).first()[0] < 1e-6


def test_pasted_texts_are_tidied(spark):
    tidy = lambda t: value(spark, text.pasted(F.lit(t)))
    assert tidy("A B") == "A B" and tidy("12°30′N") == "12°30'N" and tidy("12º30'N") == "12°30'N"
    assert tidy("A\r\nB") == "A\nB" and tidy("NOTAM: A1/25 X") == "A1/25 X" and tidy("A – B") == "A - B"
    assert tidy("‚a„ ∘̊ʹʺ⁄∕ x &rsquo; &NotEqualTilde; &hellip;") == "'a\" °°'\"// x ' ≂̸ …"
    assert tidy("") == "" and tidy(" \n ") == "" and value(spark, text.pasted(F.lit(None).cast("string"))) is None


def test_pasted_texts_are_cut(spark):
    blocks = lambda t: value(spark, text.notice_blocks(F.lit(t)))
    assert len(blocks("A1234/25 NOTAMN\nA) ZJSA\n\nE) SPACE LAUNCH 1936N11057E\nF) SFC G) UNL")) == 1
    assert len(blocks("A1234/25 NOTAMN A) ZJSA E) SPACE LAUNCH\nB0456/25 NOTAMN A) ZWUQ E) ROCKET")) == 2
    assert len(blocks("!FDC 6/1234 ZKC ROCKET LAUNCH\n!FDC 6/1235 ZKC ROCKET LAUNCH")) == 2
    assert len(blocks("!ABC rocket\nnavarea xi rocket\n(a123/25 x")) == 3
    assert blocks("SPACE LAUNCH DEBRIS\n \nROCKET LAUNCH") == ["SPACE LAUNCH DEBRIS", "ROCKET LAUNCH"]
    assert blocks("see A1234/25\n\nbelow") == ["see A1234/25\n\nbelow"]
    assert blocks("   \n  ") == [] and blocks("") == []
    cut = lambda t: value(spark, text.cut_block(F.lit(t)))
    assert cut("A1/25 E) x\nF) SFC G) UNL  \nlooks like E) y") == "A1/25 E) x\nF) SFC G) UNL"
    assert cut("A1/25 E) x\nF) SFC\nmore") == "A1/25 E) x\nF) SFC"
    assert cut("A1/25 E) x\ny\n \nmore\n\nE and") == "A1/25 E) x\ny"
    assert cut(" A1/25 plain\n\ntext ") == "A1/25 plain\n\ntext" and cut("") == ""


def test_unusable_notices_are_counted(spark):
    posts = [
        (1, "talk A1/25\nA1234/25 Q) X B) 2509210130 E) y"), (2, "A1234/25 B) 2509210130 no item"), (3, "A1234/25 E) y"), (4, "A1234/25 B) UFN E) y"),
        (5, "!FDC 1/1 x\nNAVAREA XI x"), (6, None), (7, ""), (8, "A1234/25 B) 2509210130 E) y\n(A1234/25 B) 2509210130 E) y)"), (9, "A1234/25 E) " + "long text " * 50_000 + "B) 2509210130"),
    ]
    found = tables.pasted_notices(spark.createDataFrame(posts, "id long, post string").withColumn("text", F.lit("x")).withColumn("part", F.lit("x")), "id", "post")
    assert {(r.id, r.usable): r.n for r in found.groupBy("id", "usable").agg(F.count("*").alias("n")).collect()} == {(1, True): 1, (2, False): 1, (3, False): 1, (4, False): 1, (5, False): 2, (8, True): 2, (9, True): 1}
    first = found.where("id = 1").first()
    assert (first.notice_id, first.start, first.text) == ("A1234/25", "2509210130", "A1234/25 Q) X B) 2509210130 E) y")
    assert len(found.where("id = 9").first().text) > 500_000
    assert found.where("false").count() == 0


def test_tables_with_a_preamble(spark, tmp_path):
    head = "Notices of all regions;;;\r\nFilter: none;;;\r\n\r\nLocation;Number;Start Validity;Message Text\r\n"
    body = 'ZJSA;A0001/25;2509210130;"ROCKET\r\nLAUNCH; ""now"""\r\n;;;\r\nZWUQ;A0002/25;;NO SPACE\r\n'
    frame = tables.read_notice_table(spark, written(tmp_path, "a.csv", (head + body).encode("utf-8-sig")))
    assert frame.columns == ["Location", "Number", "Start Validity", "Message Text"]
    rows = [tuple(r) for r in frame.collect()]
    assert [r[1] for r in rows] == ["A0001/25", "A0002/25"] and rows[0][3].replace("\r", "") == 'ROCKET\nLAUNCH; "now"' and rows[1][2] is None
    assert tables.column_roles(frame) == {"text": "Message Text", "id": "Number", "fir": "Location", "start": "Start Validity"}
    notices = tables.notices_of_table(frame).collect()
    assert (notices[1].id, notices[1].text, notices[1].fir, notices[1].valid_to) == ("A0002/25", "NO SPACE | Location: ZWUQ | Number: A0002/25", "ZWUQ", None)


def test_tables_of_other_forms(spark, tmp_path):
    plain = tables.read_notice_table(spark, written(tmp_path, "b.csv", "id,text,Id,\n1,été,x,\n".encode("latin-1")))
    assert plain.columns == ["id", "text", "Id_2", "column_4"] and plain.first().text == "été"
    tabbed = tables.read_notice_table(spark, written(tmp_path, "c.txt", "id\ttext\n1\té, a\n2\tb\n".encode()))
    assert [tuple(r) for r in tabbed.collect()] == [("1", "é, a"), ("2", "b")]
    # a byte that is no UTF-8 far below the head decides as well
    far = tables.read_notice_table(spark, written(tmp_path, "d.csv", b"id,text\n" + b"".join(b"%d,plain\n" % i for i in range(500)) + "500,é\n".encode("latin-1")))
    assert far.count() == 501 and far.where("id = 500").first().text == "é"
    for content in (b"PK\x03\x04rest\n", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1rest\n", b"", b"\n\n"):
        with pytest.raises(ValueError):
            tables.read_notice_table(spark, written(tmp_path, "e.xls", content))
    assert tables.read_notice_table(spark, written(tmp_path, "f.csv", b"id,text\n")).count() == 0


def test_roles_by_position(spark):
    names = lambda *c: tables.column_roles(spark.createDataFrame([tuple("x" * len(c))], ", ".join(f"`{x}` string" for x in c)))
    assert names("Raw Texts", "Text", "Valid To", "Valid From") == {"text": "Text", "id": "Valid To", "start": "Valid From", "end": "Valid To"}
    assert names("NOTAM Text", "Airspace FIR") == {"text": "NOTAM Text", "fir": "Airspace FIR"}
    assert tables.column_roles(spark.createDataFrame([("x",)], "a string"), left_out=("a",)) == {}


def _sites(spark, rows):
    frame = [(c, lat, 10.0, i, n) for i, (c, lat, n) in enumerate(rows)]
    return spark.createDataFrame(frame, "code string, place_lat double, place_lon double, ord long, nation string")


def test_groups_of_sites(spark):
    km = 1 / 110.6
    rows = [("A", 0.0, "X"), ("B", 8 * km, "X"), ("C", 4 * km, "X"), ("D", 4 * km, "Y"), ("E", 11 * km, "X"), ("F", None, "X"), ("G", 40 * km, None), ("H", 41 * km, None), ("I", 80.0, "X")]
    sites = _sites(spark, rows)
    found = {r.code: r.members for r in places.site_groups(sites).collect()}
    assert found == {"A": ["A", "C"], "C": ["A", "C"], "B": ["B", "E"], "E": ["B", "E"], "G": ["G", "H"], "H": ["G", "H"]}
    chosen = places.choosable(sites)
    assert chosen.columns == sites.columns and {r.code for r in chosen.collect()} == {"A", "B", "D", "F", "G", "I"}
    assert places.site_groups(sites.where("false")).count() == 0 and places.choosable(sites.where("false")).count() == 0
    wide = places.separation_km(sites).where("first_code = 'B'").first()
    assert wide.n == 2 and abs(wide.km - 3) < 0.01
    rows = spark.createDataFrame([(1, "C", "old"), (2, None, "old"), (3, "?", "old")], "members long, site string, site_alternatives string")
    assert [(r.members, r.site_alternatives) for r in places.with_alternatives(rows, sites).orderBy("members").collect()] == [(1, ["A"]), (2, []), (3, [])]


def test_sites_chosen_by_hand_come_back(spark):
    """A choice moves a launch and its notices; taken back, geometry's own site returns."""
    sites = _sites(spark, [("A", 0.0, "X"), ("B", 0.01, "X")])
    launches = spark.createDataFrame([("L1", "A", 0.0, 10.0), ("L2", None, None, None)], "label string, site string, site_lat double, site_lon double")
    members = spark.createDataFrame([(1, "L1", "A", 0.0, 10.0), (2, "L1", "A", 0.0, 10.0), (3, "L2", None, None, None)], "row_index long, label string, site string, site_lat double, site_lon double")
    choice = spark.createDataFrame([(1, "B"), (2, " ")], "row_index long, site string")
    moved, theirs = places.with_assigned_sites(launches, members, sites, choice)
    first = moved.where("label = 'L1'").first()
    assert (first.site, first.site_lat, first.auto_site, first.launch_site, first.site_alternatives) == ("B", 0.01, "A", "B", ["A"])
    assert [r.site for r in theirs.orderBy("row_index").collect()] == ["B", "B", None]
    back, again = places.with_assigned_sites(moved, theirs, sites, choice.where("false"))
    first = back.where("label = 'L1'").first()
    assert (first.site, first.site_lat, first.launch_site) == ("A", 0.0, None) and again.first() is not None
    assert {r.site for r in again.where("label = 'L1'").collect()} == {"A"}
