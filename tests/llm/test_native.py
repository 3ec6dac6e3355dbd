"""Decontamination, pseudonyms, fingerprints and licences."""

import hashlib
import random
import re
import struct
from datetime import date
from types import SimpleNamespace

import pytest
import xxhash
from pyspark.sql import functions as F

from noticelake.llm import decontaminate, license_scan, pii, simhash
from noticelake.llm.common import shared_dir

ITEM = "A train leaves the old station at 9 and travels 120 km to the coast before it turns back towards the hills"
SHORT = "a box of 9 apples and 120 pears"


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, ITEM), (2, "Compute the sum of six odd numbers"), (3, None), (None, ITEM), (4, "too short here"), (5, SHORT)]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_contamination(documents, benchmark):
    rows = [
        (1, "Before. " + ITEM + ". After."),
        (2, "and " + ITEM.replace("9", "11").replace("120", "75") + " again"),  # other parameters
        (3, SHORT.replace("9", "120")),  # two values of the item, one of the document
        (10, SHORT.replace("9", "7") + " " + SHORT.replace("9", "8")),  # two copies, each with its own parameters
        (9, SHORT.replace("9", "7").replace("120", "5")),
        (4, "The train leaves but nothing else is shared with any item at all"),
        (5, None),
        (6, ""),
        (None, ITEM),
        (7, "we compute THE sum, of six (odd) numbers!"),
        (8, ITEM.upper()),
    ]
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(documents(rows), benchmark).collect()}
    assert found == {(1, 1), (2, 1), (7, 2), (8, 1), (9, 5), (10, 5), (None, 1)}
    kept = {r.doc_id for r in decontaminate.without_benchmark(documents(rows), benchmark).collect()}
    assert kept == {3, 4, 5, 6}


def test_contamination_of_dense_and_recased_items(spark, documents):
    dense, units, german = "Multiply 14 by 27 then add 19", "Add 12 km 30 m and 4 km 75 m", "Der Hund lief durch den Wald und fand am Bach eine alte Karte von der großen Stadt"
    table = "First list " + " ".join(str(i * i) for i in range(3, 23)) + " second list then close both of them"
    items = spark.createDataFrame([(1, dense), (2, units), (3, german), (4, "Compute the sum of six odd numbers"), (5, table)], "item_id long, text string")
    rows = [
        (1, f'we say "{dense}."'),
        (2, units),
        (3, german.lower()),
        (4, german.upper()),
        (5, "please solve Compute the sum of six odd numbers"),
        (6, dense.replace("14", "3").replace("27", "5").replace("19", "8")),
        (7, dense.replace("14", "3").replace("27", "3")),  # two values of the item, one of the document
        (8, table.replace("81", "82")),
        (9, "First list " + " ".join(str(i * i) for i in range(3, 23)) + " and nothing else"),
        (10, "First list 1 2 3 4 5 6 7 8 9"),
    ]
    found = {(r.doc_id, r.item_id): r.coverage for r in decontaminate.contaminated(documents(rows), items).collect()}
    assert set(found) == {(1, 1), (2, 2), (3, 3), (4, 3), (5, 4), (6, 1), (8, 5), (9, 5)}
    assert {found[k] for k in ((1, 1), (2, 2), (3, 3), (4, 3), (5, 4), (6, 1))} == {1.0}


def test_every_item_is_found_as_a_copy_and_no_other(spark, documents):
    rng = random.Random(8)
    filler = [f"filler{i}" for i in range(50)]
    pick = lambda: rng.choice([str(rng.randrange(1000)), f"{rng.randrange(9)} km", "Compute", "plus", "Anna", "and", "the", "+", "sum", "of", f"w{rng.randrange(60)}"])
    items = [(i, " ".join([f"Item{i}", *(pick() for _ in range(rng.randrange(0, 25)))])) for i in range(60)]
    plain = lambda t: [w for w in (re.sub(r"[^a-z0-9]", "", x) for x in t.lower().split()) if w]
    rows = []
    for i, text in items:
        around = " ".join(rng.choices(filler, k=6))
        rows.append((i, text if len(plain(text)) < decontaminate.LITERALS else f"{around}. {text} {around}"))
        rows.append((1000 + i, f"{around} {around}"))
    rows += [(None, rows[0][1]), (7, rows[2][1]), (7, rows[2][1])]
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(documents(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    # by brute force: a run of eight plain words of an item, the whole item if it is shorter, an entire text if it is very short
    want = set()
    for doc_id, text in rows:
        ours = plain(text)
        for i, item in items:
            theirs = plain(item)
            n = min(8, len(theirs))
            runs = {tuple(theirs[k : k + n]) for k in range(len(theirs) - n + 1)}
            if tuple(ours) in runs if n < decontaminate.LITERALS else any(tuple(ours[k : k + n]) in runs for k in range(len(ours) - n + 1)):
                want.add((doc_id, i))
    assert found == want and {(i, i) for i, _ in items} <= found and (None, 0) in found


def test_contamination_of_empty_tables(spark, documents, benchmark):
    assert decontaminate.contaminated(documents([]), benchmark).collect() == []
    assert decontaminate.contaminated(documents([(1, ITEM)]), benchmark.where("false")).collect() == []


def test_window_hashes_are_of_the_windows(spark):
    rng = random.Random(3)
    words = [rng.choice("abc") for _ in range(40)]
    frame = spark.createDataFrame([(words,)], "t array<string>")
    for length in (1, 5, 8):
        hashes = frame.select(decontaminate.window_hashes(F.col("t"), length).alias("h")).first().h
        windows = [tuple(words[i : i + length]) for i in range(len(words) - length + 1)]
        assert len(hashes) == len(windows) and len(set(zip(hashes, windows, strict=True))) == len(set(windows)) == len(set(hashes))


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def test_digit_permutation_is_a_bijection(spark):
    numbers = spark.range(1000).select(F.format_string("%03d", F.col("id")).alias("d"))
    out = [r[0] for r in numbers.select(pii.permuted_digits(F.col("d"))).collect()]
    assert len(set(out)) == 1000 and all(re.fullmatch(r"\d{3}", x) for x in out)
    assert [r[0] for r in numbers.select(pii.permuted_digits(F.col("d"), "other")).collect()] != out


def test_day_permutation_is_a_bijection(spark):
    days = spark.range(146_097).select(F.date_add(F.lit("1801-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    row = days.select(pii.permuted_day(F.col("d")).alias("p")).agg(F.countDistinct("p"), F.min("p"), F.max("p")).first()
    assert tuple(row) == (146_097, date(1801, 1, 1), date(2200, 12, 31))


def test_pseudonyms(documents):
    card, wrong = "4539578763621486", "4539578763621487"
    assert luhn(card) and not luhn(wrong)
    rows = [
        (1, f"pay {card} or 4539-5787-6362-1486 now"),
        (2, f"card {card}. call +1 (217) 555-0134, host 10.20.30.40"),
        (3, f"number {wrong}, host 300.1.1.1, 1.2.3.4.5, 2021-02-30"),
        (4, "born 1999-12-31 or 31.12.1999 or 12/31/1999, 123-45-6789"),
        (5, None),
        (6, ""),
        (7, "write a.b@mail.example.com!"),
        (None, card),
    ]
    found = {r.doc_id: r for r in pii.pseudonymise(documents(rows)).collect()}
    one = found[1].found
    assert [f.kind for f in one] == ["card", "card"] and one[0].pseudonym == one[1].pseudonym.replace("-", "") == found[None].clean_text
    assert luhn(one[0].pseudonym) and one[0].pseudonym != card and re.fullmatch(r"pay \d{16} or \d{4}-\d{4}-\d{4}-\d{4} now", found[1].clean_text)
    assert found[2].found[0].pseudonym == one[0].pseudonym
    assert re.fullmatch(r"card \d{16}\. call \+1 \(\d{3}\) \d{3}-\d{4}, host (?:\d{1,3}\.){3}\d{1,3}", found[2].clean_text) and "555-0134" not in found[2].clean_text
    assert found[3].found == [] and found[3].clean_text == rows[2][1]
    iso, dotted, slashed = (f.pseudonym for f in found[4].found[:3])
    assert f"{iso[8:]}.{iso[5:7]}.{iso[:4]}" == dotted and f"{iso[5:7]}/{iso[8:]}/{iso[:4]}" == slashed and found[4].found[3].kind == "national"
    assert found[5].clean_text is None and found[5].found == [] and found[6].clean_text == ""
    assert found[7].clean_text.endswith("@example.invalid!") and "a.b@" not in found[7].clean_text
    assert pii.pii_report(documents([])).collect() == []


def test_pseudonyms_of_valid_numbers_are_valid(spark):
    """All of a sample of American, national and trunk numbers, and a whole small set that walks within its classes."""
    n = F.col("id")
    mixed = lambda i, m: F.pmod(F.xxhash64(F.lit(i), n), F.lit(m)).cast("int")
    american = F.format_string("(%03d) %03d-%04d", mixed(1, 1000), mixed(2, 1000), mixed(3, 10000))
    national = F.format_string("%03d-%02d-%04d", mixed(4, 1000), mixed(5, 100), mixed(6, 10000))
    trunk = F.format_string("0%d%02d %04d %04d", 1 + mixed(7, 9), mixed(8, 100), mixed(9, 10000), mixed(10, 10000))
    rows = spark.range(1500).select(F.explode(F.array(american, national, trunk)).alias("v")).withColumn("kind", pii.kind_of(F.col("v"))).where("kind is not null")
    coded = rows.withColumn("p", pii.pseudonym(F.col("kind"), F.col("v"))).withColumn("again", pii.kind_of(F.col("p"))).collect()
    assert len(coded) > 3000 and {r.kind for r in coded} == {"phone", "national"}
    assert [r for r in coded if r.kind != r.again or re.sub(r"\d", "0", r.v) != re.sub(r"\d", "0", r.p)] == []
    assert len({r.p for r in coded}) == len({r.v for r in coded})
    small = spark.range(1000).select(F.format_string("%03d", n).alias("d"))
    even = lambda x: x.rlike("[02468]$")
    walked = small.select("d", pii.walked_digits(F.col("d"), even).alias("w")).collect()
    assert len({r.w for r in walked}) == 1000 and all((int(r.d) - int(r.w)) % 2 == 0 for r in walked)


def feistel(digits, key="noticelake"):
    """The digit permutation written again, with the library of the hash."""
    high = len(digits) - len(digits) // 2
    half, size = [int(digits[:high]), int(digits[high:])], [10**high, 10 ** (len(digits) - high)]

    def mix(i, other):
        seed = 42
        for part in (key.encode(), b"digits", struct.pack("<i", i), struct.pack("<i", len(digits)), struct.pack("<q", other)):
            seed = xxhash.xxh64_intdigest(part, seed)
        return (seed - 2**64 if seed >= 2**63 else seed) % 2**62

    for i in range(1, 9):
        at = 0 if i % 2 else 1
        half[at] = (half[at] + mix(i, half[1 - at]) % size[at]) % size[at]
    return str(half[0]).zfill(high) + str(half[1]).zfill(len(digits) - high)


def test_whole_texts_against_pseudonyms_written_again(documents):
    """Cards and national numbers in whole texts: found, checked, permuted and put back without Spark."""
    rng = random.Random(4)
    valid = re.compile(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}")

    def again(m):
        v = m.group()
        digits = re.sub(r"\D", "", v)
        if "-" in v:
            if not valid.fullmatch(v):
                return v
            x = feistel(digits)
            while not valid.fullmatch(f"{x[:3]}-{x[3:5]}-{x[5:]}"):
                x = feistel(x)
            return f"{x[:3]}-{x[3:5]}-{x[5:]}"
        payload = feistel(digits[:-1])
        return next(payload + c for c in "0123456789" if luhn(payload + c)) if luhn(digits) else v

    def part():
        payload = "".join(rng.choices("0123456789", k=15))
        card = payload + (next(c for c in "0123456789" if luhn(payload + c)) if rng.random() < 0.7 else rng.choice("0123456789"))
        number = f"{rng.randrange(1000):03}-{rng.randrange(100):02}-{rng.randrange(10000):04}"
        return rng.choice([card, number, "000-12-3456", "word", "é🙂", ""])

    texts = [" x ".join(part() for _ in range(rng.randrange(0, 12))) for _ in range(150)] + ["", "x 123-45-6789 " * 3000]
    got = {r.doc_id: r.clean_text for r in pii.pseudonymise(documents(list(enumerate(texts)))).collect()}
    expected = {i: re.sub(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])|(?<!\d)\d{16}(?!\d)", again, t) for i, t in enumerate(texts)}
    assert got == expected


def test_notations_of_a_value_have_one_pseudonym(documents):
    same = ["+1 (663) 555-6869", "+16635556869", "(663) 555-6869", "663-555-6869", "663.555.6869", "1-663-555-6869"]
    german = ["+49 171 1234567", "+491711234567", "+49 (0)171 1234567", "0171 1234567", "0171/1234567"]
    cards, dates = ["378282246310005", "3782 822463 10005", "3782-822463-10005"], ["31/12/1999", "12/31/1999", "1999-12-31"]
    rows = [(i, f"see {v}, now") for i, v in enumerate(same + german + cards + dates)]
    rows += [(90, "no 123-456-7890, 3782 822463 10006, 32/12/1999, 02139-1234, 1.663.555.68690"), (91, "tel. 01 23 45 67 89"), (92, "tel. 020 7946 0958")]
    got = {r.doc_id: r for r in pii.pseudonymise(documents(rows)).collect()}
    digits = [re.sub(r"\D", "", got[i].found[0].pseudonym) for i in range(len(rows) - 3)]
    for i, v in enumerate(same + german + cards + dates):
        assert len(got[i].found) == 1 and got[i].found[0].value == v and v not in got[i].clean_text, v
        assert re.sub(r"\d", "0", got[i].found[0].pseudonym) == re.sub(r"\d", "0", v)
    assert [got[i].found[0].kind for i in range(17)] == ["phone"] * 11 + ["card"] * 3 + ["date"] * 3
    assert len({d[-10:] for d in digits[:6]}) == 1 and digits[0][-10:] != "6635556869" and {d[:-10] for d in digits[:6]} == {"", "1"}
    assert len({d[-10:] for d in digits[6:11]}) == 1 and {d[:-10] for d in digits[6:11]} == {"49", "490", "0"}
    assert len(set(digits[11:14])) == 1 and luhn(digits[11])
    day, us, iso = digits[14:17]
    assert iso == day[4:] + day[2:4] + day[:2] == us[4:] + us[:2] + us[2:4]
    assert got[90].found == [] and [f.kind for i in (91, 92) for f in got[i].found] == ["phone"] * 2


def test_fingerprints_follow_the_next_document(documents):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    rows = [(i * 700, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))) for i in range(40)] + [(1, None), (2, ""), (3, "same text"), (4, "same text"), (5000, "é🙂" * 9)]
    got = {r.doc_id: r for r in simhash.edited_fingerprints(documents(rows)).collect()}
    ordered = sorted(rows, key=lambda r: -r[0])
    prints = {r.doc_id: r.fingerprint for r in simhash.fingerprints(documents(rows)).collect()}
    for k, (i, t) in enumerate(ordered):
        t, nxt = t or "", ordered[(k + 1) % len(ordered)]
        half = len(t) // 2
        edited = t[: len(t) - half] + (nxt[1] or "")[:half]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = int(got[i].fingerprint, 16), int(got[nxt[0]].fingerprint, 16)
        assert got[i].near_next == 1 - bin(a ^ b).count("1") / 64 and a == prints[i] % 2**64
    assert got[3].fingerprint == got[4].fingerprint and got[1].fingerprint == "0" * 16
    assert simhash.edited_fingerprints(documents([])).collect() == []


def test_repeated_and_null_ids_keep_their_rows(documents):
    rows = [(1, "a b c"), (1, "a b c"), (None, "x y"), (None, "x y"), (2, "z")]
    assert sorted(r.n_chars for r in simhash.edited_fingerprints(documents(rows)).collect()) == [1, 3, 3, 5, 5]


def test_block_tables_find_all_near_fingerprints(spark):
    rng = random.Random(11)
    base = [rng.getrandbits(63) for _ in range(30)]
    prints = base + [x ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for x in base] + [base[0]]
    want = {(a, b, bin(a ^ b).count("1")) for a in prints for b in prints if a < b and bin(a ^ b).count("1") <= 3}
    frame = spark.createDataFrame([(p,) for p in prints] + [(None,)], "fingerprint long")
    assert {tuple(r) for r in simhash.near_fingerprints(frame).collect()} == want


def test_licences(spark, documents):
    mit = next(t for name, t in license_scan.KNOWN if name == "MIT" and len(t) > 500)
    rows = [
        (1, "Copyright (c) 2020 Someone\n\n" + mit.upper()),
        (2, "prose\nReleased under the MIT Licence!\nprose\n  released UNDER the mit license"),
        (3, "Released under the MIT License and more"),
        (4, None),
        (5, ""),
        (6, "Licensed under CC BY-NC 4.0."),
    ]
    found = {tuple(r) for r in license_scan.scan_licenses(documents(rows), license_scan.known_digests(license_scan.known_texts(spark))).collect()}
    assert found == {(1, "text", "MIT", 1), (1, "line", "MIT", 1), (2, "line", "MIT", 2), (6, "text", "CC-BY-NC-4.0", 1), (6, "line", "CC-BY-NC-4.0", 1)}
    assert license_scan.scan_licenses(documents([]), license_scan.known_digests(license_scan.known_texts(spark))).collect() == []


def test_licence_files_with_titles_and_wrapped_clauses(spark, documents):
    mit, isc = (next(t for name, t in license_scan.KNOWN if name == wanted and len(t) > 500) for wanted in ("MIT", "ISC"))
    wrapped = lambda t: t.replace(" copyright ", "\ncopyright ").replace(" COPYRIGHT ", "\nCOPYRIGHT ")
    files = [
        (1, "ISC License\n\nCopyright (c) 2020, Someone\n\n" + wrapped(isc)),
        (2, "The MIT License (MIT)\n\nCopyright 2020 Someone\nCopyright Jane Doe. All rights reserved.\n(c) 2021 Someone\n\n" + wrapped(mit)),
        (3, "MIT License"),
        (4, " \n!"),
    ]
    found = {tuple(r) for r in license_scan.scan_licenses(documents(files), license_scan.known_digests(license_scan.known_texts(spark))).collect()}
    assert found == {(1, "text", "ISC", 1), (1, "paragraph", "ISC", 1), (2, "text", "MIT", 1), (2, "paragraph", "MIT", 1)}


def test_licences_equal_their_sql(spark, documents):
    import duckdb

    known = license_scan.known_digests(license_scan.known_texts(spark))
    notice = next(t for name, t in license_scan.KNOWN if name == "Apache-2.0" and len(t) > 300)
    header = "\n".join(f"# {line}" for line in (notice[:70] + notice[70:].replace(" ", "\n", 3)).split("\n"))
    rows = [
        (1, "本软件不是 Released under the MIT License 的"),
        (2, "Это не Released under the MIT License."),
        (3, f"#!/bin/sh\n\n{header}\n\nset -e\r\n"),
        (4, "BSD 3-Clause License\nCopyright Holder X\n\n" + next(t for name, t in license_scan.KNOWN if name == "BSD-3-Clause" and len(t) > 500)),
        (5, "LICENSED UNDER CC BY 4.0!\r\nreleased under the isc licence\n\n\nLicensed under the MIT\nLicence"),
        (6, None),
        (7, "Copyright Notice\nReleased under the MIT License. \ncopyright 2020 Released under the MIT License."),
        (None, "Released under the MIT License."),
        (None, "Released under the MIT License."),
    ]
    found = sorted((tuple(r) for r in license_scan.scan_licenses(documents(rows), known).collect()), key=str)
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    assert found == sorted(con.sql(license_scan.oracle_sql()).fetchall(), key=str)
    assert not any(r[0] in (1, 2) for r in found)
    assert (3, "paragraph", "Apache-2.0", 1) in found and (5, "paragraph", "MIT", 1) in found and (None, "text", "MIT", 2) in found


def test_shared_folder_where_none_is_set():
    session = lambda master, app: SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master=master, applicationId=app))
    assert shared_dir(session("local[2]", "a")) == shared_dir(session("local[2]", "a")) != shared_dir(session("local[2]", "b"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session("spark://host:7077", "c"))


def test_hits_are_few_keys_and_texts_do_not_move(spark):
    docs = spark.createDataFrame([(i, f"plain text number {i} of no question") for i in range(50)] + [(50, "how many red apples does the old farmer sell in one week")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "how many red apples does the old farmer sell in one week")], "item_id long, text string")
    kept = decontaminate.without_benchmark(docs, bench)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(50))
    assert "Exchange hashpartitioning" not in kept._jdf.queryExecution().executedPlan().toString()
