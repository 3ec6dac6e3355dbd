"""Secrets, languages, URLs."""

import base64
import json
import random
import re
import zlib

from noticelake.llm import langid, language_model, secret_scan, url_filter


def length(n):
    return bytes([n]) if n < 128 else b"\x82" + n.to_bytes(2, "big")


def der(tag, content):
    return bytes([tag]) + length(len(content)) + content


def rsa_key():
    rng = random.Random(1)
    numbers = [b"\x00"] + [bytes([1]) + rng.randbytes(n) for n in (128, 2, 128, 64, 64, 64, 64, 64)]
    return der(0x30, b"".join(der(2, n) for n in numbers))


def base_spans(text):
    out = []
    either = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
    for kind, pattern, least in (("assign", rf"""({either})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6), ("access", r"AKIA[A-Z0-9]+", 20), ("hex", r"[0-9a-f]+", 24)):
        out += [(kind, *m.span()) for m in re.finditer(pattern, text) if len(m[2] if kind == "assign" else m[0]) >= least]
    return sorted(out, key=lambda s: (s[1], secret_scan.KINDS.index(s[0])))


def test_base_spans():
    for text in ("", "token = 'abcdef' TOKEN:abc secret=token=abcdefg", "Api_Key: zzzzzz apikey=zzzzzz", "AKIA" + "A" * 16 + " AKIA1", "é🙂 " + "ab12" * 8 + "X" + "a" * 23, "ſecret=abcdefg toKen=abcdefg"):
        found = [s for s in secret_scan.find_secrets(text) if s[0] in ("assign", "access", "hex")]
        assert found == base_spans(text), text
    assert secret_scan.find_secrets(None) == []


def test_structures_are_confirmed():
    key = rsa_key()
    plain = base64.b64encode(key).decode()
    url = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")
    jwt = ".".join((url(json.dumps({"alg": "HS256"}).encode()), url(b'{"sub":1}'), url(bytes(32))))
    openssh = base64.b64encode(b"openssh-key-v1\0" + b"".join(len(x).to_bytes(4, "big") + x for x in (b"none", b"none", b"")) + (1).to_bytes(4, "big")).decode()
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(plain[i : i + 64] for i in range(0, len(plain), 64)) + "\n-----END RSA PRIVATE KEY-----"
    for kind, secret in (("der", plain), ("jwt", jwt), ("openssh", openssh), ("pem", pem), ("der", key.hex())):
        spans = [s for s in secret_scan.find_secrets("é " + secret + " end") if s[0] == kind]
        assert spans == [(kind, 2, 2 + len(secret))], kind
    broken = base64.b64encode(key[:-1] + b"\0\0").decode()
    forged = ".".join((url(b'{"typ":"x"}'), url(b'{"sub":1}'), url(bytes(32))))
    for text in (broken, forged, "-----BEGIN RSA PRIVATE KEY-----\nabcd\n-----END RSA PRIVATE KEY-----", base64.b64encode(bytes(60)).decode()):
        assert not [s for s in secret_scan.find_secrets(text) if s[0] not in ("assign", "access", "hex")]


def test_wrapped_and_escaped_keys():
    plain = base64.b64encode(rsa_key()).decode()
    lines = [plain[i : i + 64] for i in range(0, len(plain), 64)]
    cipher = base64.b64encode(bytes(range(256)) * 2).decode()
    armour = lambda body, br: f"-----BEGIN RSA PRIVATE KEY-----{br}{body}{br}-----END RSA PRIVATE KEY-----"
    locked = lambda br, size: armour(br.join(["Proc-Type: 4,ENCRYPTED", f"DEK-Info: AES-128-CBC,{'0A' * size}", "", cipher]), br)
    for br in ("\n", "\r\n", "\\n", "\\r\\n"):
        joined = br.join(lines)
        narrow = br.join(plain[i : i + 32] for i in range(0, len(plain), 32))
        for kind, secret in (("pem", armour(joined, br)), ("pem", locked(br, 16)), ("der", joined), ("der", narrow)):
            for before, after in (('{"key": "', '"}'), ("é word" + br, br + "word")):
                spans = [s for s in secret_scan.find_secrets(before + secret + after) if s[0] not in ("assign", "access", "hex")]
                assert spans == [(kind, len(before), len(before) + len(secret))], (kind, br, before)
    assert "MII" not in secret_scan.redact(armour("\\n".join(lines), "\\n"), secret_scan.find_secrets(armour("\\n".join(lines), "\\n")))
    for text in (locked("\n", 5), armour("\\n".join(lines[:-1]), "\\n"), "\n".join(lines[1:])):
        assert not [s for s in secret_scan.find_secrets(text) if s[0] not in ("assign", "access", "hex")]


def test_scan_and_mask(documents):
    rows = [(1, "token = 'abcdef12' end"), (2, None), (3, ""), (None, "clean"), (4, "clean"), (4, "clean")]
    found = secret_scan.secret_digests(documents(rows)).collect()
    assert len(found) == 6 and {r.doc_id: r.spans for r in found}[1] == "assign:0:17"
    masked = {r.doc_id: (r.text, r.n_chars) for r in secret_scan.mask_secrets(documents(rows)).collect()}
    assert masked[1] == ("<secret>' end", 13) and masked[2] == (None, None) and masked[3] == ("", 0) and masked[4] == ("clean", 5)
    assert secret_scan.secret_digests(documents([])).collect() == []


WORDS = {
    "en": "the and of that with from this which there have would their".split(),
    "de": "der die und nicht mit sich auch werden einen über für schön".split(),
    "fr": "le les des qui dans être avec pour même où très déjà".split(),
    "es": "el los que para una como más pero niño está año según".split(),
}


def test_languages_on_held_out_documents(documents):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(WORDS[lang]) for _ in range(25)), lang) for i in range(400) for lang in [rng.choice(sorted(WORDS))]]
    rows += [(1000, None), (1001, ""), (1002, "123 !!! \u3000"), (None, rows[0][1])]
    got = langid.language_labels(documents(rows)).collect()
    truth = {r[0]: r[2] for r in rows if len(r) > 2}
    tested = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(got) == len(rows) and len(tested) > 50 and all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(truth[r.doc_id] == r.lang_pred for r in tested) >= 0.97 * len(tested)
    assert {r.doc_id: (r.lang_pred, r.score) for r in got if r.doc_id in (1000, 1001, 1002)} == {i: ("und", 0.0) for i in (1000, 1001, 1002)}
    assert all(0 <= r.score <= 1 for r in got) and next(r for r in got if r.doc_id is None).lang_pred == rows[0][2]


def test_languages_without_labels(documents):
    assert [r.lang_pred for r in langid.language_labels(documents([(1, "some text")])).collect()] == ["und"]
    assert langid.language_labels(documents([])).collect() == []


def test_a_machine_separates_and_all_rows_are_scored_alike():
    rng = language_model.np.random.default_rng(4)
    x = rng.normal(size=(300, 20)).astype("float32")
    yes = x[:, 0] + 0.5 * x[:, 1] > 0.2
    w, b = language_model.support_vector_machine(x, yes)
    assert ((x @ w + b > 0) == yes).mean() > 0.98
    vote = language_model.Vote(["b", "a", "c"], [("a", "b", w, b), ("a", "c", w, b), ("b", "c", w, b)])
    names = [vote.names[k] for k in vote.choose(x)[0]]
    assert all((n == "a") == bool(p) for n, p in zip(names, x @ w + b >= 0, strict=True)) and set(names) == {"a", "c"}


def test_only_the_most_frequent_languages_are_learned(documents):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(WORDS[lang]) for _ in range(25)), lang) for i in range(90) for lang in [sorted(WORDS)[min(i % 7, 2)]]]
    model = langid.fit(documents(rows), most_languages=1)
    assert [x for names in model.within for x in names.names] == [sorted(WORDS)[2]]


def expected_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]+", lambda m: m[0].lower(), host)
    best = None
    for verdict, rule in url_filter.RULES:
        name, _, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best


def test_url_rules_and_trees(spark):
    urls = ["http://A.Example.ORG/es/1?x=1", "https://example.org/en/12", "https://example.org/en/2#a", "http://x.com/fr/", "http://x.com/de", "http://x.com/de/", "http://org", "http://org/", "http://com.net/fr/", "no scheme", "", None, "a://b://c/d", "http://xorg/a", "http://h?q/es", "http://E.com/fr/é"]
    urls += [f"http://s{i}.example.com/{'fr' if i % 2 else 'de'}/{i}" for i in range(60)]
    frame = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(None, urls[0], "x")], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.judge(frame).collect()}
    assert len(got) == len(urls) + 1
    for i, u in enumerate(urls):
        host, path, best = expected_rule(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best and best[1]), u
        assert got[i].verdict == best[0] if best else got[i].verdict in ("allow", "block") and 0 <= got[i].score <= 1
    plain = frame.where("url = 'no scheme'")
    assert [(r.verdict, r.rule) for r in url_filter.judge(plain).collect()] == [("allow", None)]
    assert url_filter.judge(frame.where("false")).collect() == []


def test_no_url_sees_its_own_label_in_the_record_of_its_suffix(spark):
    rows = [("http://a.one.net/x", "a.one.net", "/x", 1), ("http://b.one.net/y", "b.one.net", "/y", 0), ("http://c.two.net/", "c.two.net", "/", 1)]
    frame = spark.createDataFrame(rows, "url string, host string, path string, blocked int")
    records = url_filter.suffix_records(frame)
    at = url_filter.FEATURES.index("suffix_share")
    share = lambda own: {r.url[7]: r.features[at] for r in url_filter.lexical(frame, "url", records, own=own).collect()}
    assert share("blocked") == {"a": 2 / 5, "b": 3 / 5, "c": 2 / 4}
    assert share(None) == {"a": 3 / 6, "b": 3 / 6, "c": 3 / 5}


def test_columns_of_clashing_names_stay(spark):
    rows = spark.createDataFrame([("token = 'abcdef1234567'", 1, "mine", "too")], "text string, n_chars long, _masked string, _judged string")
    masked = secret_scan.mask_secrets(rows).first()
    assert masked["_masked"] == "mine" and "abcdef1234567" not in masked.text
    judged = langid.predict(rows, langid.LanguageModel({}, [], {})).first()
    assert judged["_judged"] == "too" and judged.lang_pred == langid.UNKNOWN
