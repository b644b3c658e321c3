"""Surrogates: form, coreference, distinctness, and awkward tables."""

import re

import pytest

from loglens.llm import surrogates as S

EMAIL, IP, PHONE, CARD = r"[\w.+-]+@[\w.-]+\w", r"\b\d+\.\d+\.\d+\.\d+\b", r"\+1 \(\d{3}\) \d{3}-\d{4}", r"\b\d{16}\b"


def replaced(spark, texts, key="test key"):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return [r.text for r in S.with_surrogates(df, key).orderBy("doc_id").collect()]


def test_forms_and_coreference(spark):
    out = replaced(spark, [
        "Mr Smith met Mrs. Anna Müller. JOHN SMITH and John Smith left.",
        "Write to Jo.Smith9@Example.com or jo.smith9@example.com",
        "+1 (407) 555-7710 is +1 407 555 7710", "4111 1111 1111 1111 is 4111111111111111",
        "10.0.0.7 and 8.8.8.8", "Госпожа Иванова и Иван Петров", "plain 12 text", None, ""])
    found = re.fullmatch(r"Mr (\w+) met Mrs\. (\w+) (\w+)\. ([A-Z]+) ([A-Z]+) and (\w+) (\w+) left\.", out[0])
    assert found and found[1] == found[7] and found[5] == found[1].upper() and found[4] == found[6].upper()
    assert found[2] in S.GIVEN["latin f"] and found[6] in S.GIVEN["latin m"] and "Smith" not in out[0]
    a, b = re.fullmatch(r"Write to (\S+) or (\S+)", out[1]).groups()
    assert a.lower() == b and re.fullmatch(r"[a-z]{2}\.[a-z]{5}\d@[a-z]{7}\.com", b) and b != "jo.smith9@example.com"
    a, b = out[2].split(" is ")
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", a) and re.sub(r"\D", "", a) == re.sub(r"\D", "", b)
    a, b = out[3].split(" is ")
    assert a.replace(" ", "") == b and b != "4111111111111111" and b[0] == "4"
    assert sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(b))) % 10 == 0
    assert out[4].startswith("10.") and "8.8.8.8" not in out[4]
    assert re.fullmatch(r"Госпожа [а-яё]+ова|.*", out[5], re.I) and "Иванова" not in out[5] and out[5].split()[3] in S.GIVEN["cyrillic m"]
    assert out[6:] == ["plain 12 text", None, ""]


PHONES = [
    "+14155552671", "+33123456789", "+49 30 12345678", "+91 98765 43210", "(212) 555-0123", "212-555-0123", "212.555.0123",
    "1-212-555-0123", "+44 (0)20 7946 0958", "0044 20 7946 0958", "030 12345678", "(030) 1234567", "0171/1234567", "01 23 45 67 89",
    "612 34 56 78", "91 234 56 78", "+1 22 33"]


def test_telephone_forms(spark):
    out = replaced(spark, [f"call {p}, now" for p in PHONES])
    shape = lambda t: re.sub(r"\d", "9", t)
    for p, o in zip(PHONES, out):
        assert o != f"call {p}, now" and shape(o) == shape(f"call {p}, now"), (p, o)
    assert out[0].startswith("call +1") and out[1].startswith("call +33") and "(0)20" not in out[8] and "+44 (0)" in out[8]
    assert out[10].startswith("call 0") and out[9].startswith("call 0044")


def test_telephone_coreference(spark):
    out = replaced(spark, ["+12125550123 (212) 555-0123 1-212-555-0123 212.555.0123", "+44 (0)20 7946 0958;+442079460958;0044 20 7946 0958"])
    a, b, c, d = re.fullmatch(r"\+1(\d{10}) (\(\d{3}\) \d{3}-\d{4}) 1-([\d-]{12}) ([\d.]{12})", out[0]).groups()
    assert a != "2125550123" and {re.sub(r"\D", "", x) for x in (b, c, d)} == {a}
    x, y, z = (re.sub(r"\D", "", t.replace("(0)", "")) for t in out[1].split(";"))
    assert x == y == z[2:] != "442079460958"


@pytest.mark.parametrize("text", [
    "2024-01-15 10:20:30", "01.02.2024 15:42", "05/06/24 12:30", "08.30 09.45", "12 345 678", "v1.212.555.0123.4", "0306406152"])
def test_numbers_that_are_no_telephone_stay(spark, text):
    assert replaced(spark, [text]) == [text]


def test_long_names(spark):
    out = replaced(spark, [
        "saw Anna Maria Schmidt there; Mr John Paul Jones came; Mr Carlos de la Cruz sat; Mary J. Watson ran; Carlos de la Cruz slept; "
        "Dr. J.R. Keller wrote; Herr Dr. Weber von der Heide; Anna Schmidt left; Mr Jones, Ms Watson y Anna Cruz.",
        "Carlos Cruz y Laura Schmidt bailan"])
    w = r"([A-Z][a-z]+)"
    found = re.fullmatch(
        rf"saw {w} {w} {w} there; Mr {w} {w} {w} came; Mr {w} de la {w} sat; {w} ([A-Z])\. {w} ran; {w} de la {w} slept; "
        rf"Dr\. ([A-Z])\.([A-Z])\. {w} wrote; Herr Dr\. {w} von der {w}; {w} {w} left; Mr {w}, Ms {w} y {w} {w}\.", out[0])
    assert found, out[0]
    g = found.groups()
    assert not {"Schmidt", "Jones", "Cruz", "Watson", "Keller", "Weber", "Heide", "Paul", "Maria"} & set(g)
    schmidt, jones, cruz, watson = g[2], g[5], g[7], g[10]
    assert len({schmidt, jones, cruz, watson}) == 4 and g[9] != "J" and g[13] == g[9] and g[14] != "R"
    assert (g[12], g[19], g[20], g[21], g[23]) == (cruz, schmidt, jones, watson, cruz) and g[0] == g[18] and g[6] == g[11]
    assert re.fullmatch(rf"{w} {cruz} y {w} {schmidt} bailan", out[1])


def test_cards_of_other_lengths(spark):
    kept = "at 1700000000000 and 1700000000000000000, order 98765432101234"
    out = replaced(spark, [kept, "3782 822463 10005; 378282246310005", "30569309025904 3056 930902 5904", "4222222222222"])
    assert out[0] == kept
    a, b = re.fullmatch(r"(3\d{3} \d{6} \d{5}); (\d{15})", out[1]).groups()
    assert a.replace(" ", "") == b != "378282246310005"
    a, b = re.fullmatch(r"(3\d{13}) (3\d{3} \d{6} \d{4})", out[2]).groups()
    assert b.replace(" ", "") == a != "30569309025904"
    assert re.fullmatch(r"4\d{12}", out[3]) and out[3] != "4222222222222"


def test_key_decides(spark):
    text = ["a.b@c.org +1 (407) 555-7710"]
    assert replaced(spark, text) == replaced(spark, text) != replaced(spark, text, key="other")


def test_crowded_names_stay_distinct(spark):
    """More surnames than the list has: every one still gets a name of its own."""
    names = [f"Mr Q{a}{b}" for a in "abcdefgh" for b in "abcdefghij"]
    out = replaced(spark, names)
    assert len({t.lower() for t in out}) == len(names) and not set(out) & set(names)


def test_full_forms_find_a_way_out(spark):
    """All values of a form are originals: the space must widen."""
    hosts = spark.range(254 * 254).selectExpr("'ip' AS kind", "concat('192.168.', id div 254 + 1, '.', id % 254 + 1) AS norm")
    phones = spark.range(10_000).selectExpr("'phone' AS kind", "concat('7 7', lpad(id, 4, '0')) AS norm")
    mails = spark.range(676).selectExpr("'email' AS kind", "concat(char(97 + id div 26), '@', char(97 + id % 26), '.com') AS norm")
    odd = spark.createDataFrame([("email", "日本@例.jp")], "kind string, norm string")
    got = S.assigned(hosts.unionByName(phones).unionByName(mails).unionByName(odd), "test key").toPandas()
    assert len(got) == 254 * 254 + 10_000 + 676 + 1 and not got.duplicated(["kind", "candidate"]).any()
    assert not set(got["candidate"]) & set(got["norm"])
    assert got[got["kind"] == "ip"]["candidate"].str.match(r"10\.|192\.168\.").all()
    assert got[got["kind"] == "phone"]["candidate"].str.match(r"7 7\d{5,}").all()


def test_longer_numbers_keep_their_form(spark):
    row = spark.createDataFrame([("+7 11 22", "phone", "7 7334455", "7 71122")], "raw string, kind string, made string, norm string")
    made = S._in_form(*[row[c] for c in row.columns])
    assert row.select(made.alias("m")).first().m == "+7 33 4455"


def test_corpus(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    after = {r.doc_id: r.text for r in S.with_surrogates(docs, "test key").collect()}
    assert before.keys() == after.keys()
    forward, backward = {}, {}
    for key, text in before.items():
        for pattern in (EMAIL, IP, PHONE, CARD):
            old, new = re.findall(pattern, text), re.findall(pattern, after[key])
            assert len(old) == len(new)
            for a, b in zip(old, new):
                assert a != b and forward.setdefault(a.lower(), b.lower()) == b.lower() and backward.setdefault(b.lower(), a.lower()) == a.lower()
    assert forward and not forward.keys() & backward.keys()


def test_rows_and_columns(spark):
    rows = [(1, "a@b.org", "x"), (1, "a@b.org", "x"), (None, "a@b.org", None), (2, None, "y")]
    got = S.with_surrogates(spark.createDataFrame(rows, "doc_id int, text string, kind string"), "test key").collect()
    assert sorted((r.doc_id is None, r.doc_id, r.kind, r.pii_count) for r in got if r.text) == [
        (False, 1, "x", 1), (False, 1, "x", 1), (True, None, None, 1)]
    assert len(got) == 4 and len({r.text for r in got}) == 2
    none = spark.createDataFrame([], "doc_id int, text string")
    assert S.with_surrogates(none, "test key").collect() == []


@pytest.mark.parametrize("text", ["1.2.3.4.5", "1234-5678", "@", "a@b", "x" * 100_000 + "@", "1" * 50])
def test_lookalikes_stay(spark, text):
    assert replaced(spark, [text]) == [text]


def test_long_runs_do_not_use_up_the_stack(spark):
    texts = ["x@" + "a-" * 50_000 + ".b", "1." * 100_000, "+1" + " 2" * 100_000, "Mr " * 50_000,
             "Mr " + "von " * 50_000 + "Berg", "A.-" * 100_000 + " Anna B.C. Smith", "x@" + "a." * 100_000 + "com",
             "Anna " + "A." * 100_000 + " Smith"]
    out = replaced(spark, texts)
    assert out[6].count(".") == 100_000 and out[6].endswith(".com") and not out[6].startswith("x@a.")
    assert not out[7].startswith("Anna") and not out[7].endswith("Smith")
    assert not out[5].endswith("Smith") and out[1] == texts[1]


def test_names_and_security_numbers_stay_distinct(spark):
    """Each surname and each number gets one replacement everywhere, no two the same, none that occurs in the corpus."""
    import random

    draw = random.Random(6)
    surnames = [f"Q{a}{b}{c}" for a in "aeiou" for b in "lmnr" for c in "aeo"]
    numbers = [f"{draw.randint(100, 899)}-{draw.randint(10, 99)}-{draw.randint(1000, 9999)}" for _ in range(60)]
    rows = [(draw.choice(surnames), draw.choice(numbers)) for _ in range(400)]
    out = replaced(spark, [f"Mr {name} has {number}." for name, number in rows])
    forward, backward = {}, {}
    for (name, number), text in zip(rows, out):
        new_name, new_number = re.fullmatch(r"Mr (\S+) has (\d{3}-\d\d-\d{4})\.", text).groups()
        for old, new in ((name, new_name), (number, new_number)):
            assert forward.setdefault(old, new) == new and backward.setdefault(new, old) == old
    assert not set(forward) & set(backward)
