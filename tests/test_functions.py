"""Column functions against fixed rows and plain Python."""

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quillspark.functions import fields as V
from quillspark.functions import geometry as G
from quillspark.functions import parse as P
from quillspark.functions import repair as R
from quillspark.functions import text as X
from quillspark.operators import label


def one(spark, col, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(col.alias("x")).first().x


@pytest.mark.parametrize(
    ("value", "family", "conf", "want"),
    [("Tand", "long_text", 0.99, "known_token"), ("Meera Iyer", "name_text", 0.2, None), ("zzzzzz", "name_text", 0.9, "gibberish"), ("ieaoua", "short_text", 0.9, "gibberish"), ("boo boooo", "short_text", 0.9, "repetitive"), ("44", "numeric", 0.1, None), ("forty", "numeric", 0.9, "numeric_without_digits"), ("Rs none yet", "amount", 0.9, "amount_without_digits"), ("31.12.1999", "date", 0.5, None), (" ", "amount", 0.9, None), ("id" * 21 + "7", "short_id", 0.9, "id_too_long"), ("one and other words " * 8, "name_text", 0.9, "text_too_long"), ("checked", "binary_mark", 0.9, None), ("chequered", "binary_mark", 0.9, "unexpected_mark")],
)
def test_hallucination(spark, value, family, conf, want):
    assert one(spark, V.hallucination(F.lit(value), F.lit(family), F.lit(conf))) == want


@pytest.mark.parametrize(
    ("name", "value", "want"),
    [("LA_State", "Goa", None), ("LA_State", "zz", "unknown_state"), ("LA_State", "Atlantis", None), ("Plan_Name", "JP", "plan_name_too_short"), ("proposed_premium_mode", "Monthly", None), ("proposed_premium_mode", "weekly", "unknown_premium_mode"), ("LA_Email", "a@b.co", None), ("LA_Email", "a@b", "bad_email"), ("LA_Mobile", "60000 00001", None), ("LA_Mobile", "5000000001", "bad_mobile"), ("LA_Mobile", "", None)],
)
def test_semantic(spark, name, value, want):
    assert one(spark, V.semantic_issue(F.lit(name), F.lit(value))) == want


def test_checksum(spark):
    def digit(n):  # the dihedral group's product by its definition, places permuted by powers of one permutation
        times = lambda a, b: (a + b) % 5 if a < 5 and b < 5 else (a + b) % 5 + 5 if a < 5 else (a - b) % 5 + 5 if b < 5 else (a - b) % 5
        first = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)
        for d in range(10):
            left = 0
            for i, c in enumerate(reversed(f"{n}{d}")):
                x = int(c)
                for _ in range(i % 8):
                    x = first[x]
                left = times(left, x)
            if left == 0:
                return str(d)

    numbers = [str(k * 982_451_653 + 20_000_000_000)[:11] for k in range(40)]
    rows = spark.createDataFrame([(n + d, d == digit(n)) for n in numbers for d in ("0", "4", "9", digit(n))] + [("", False), ("77b", False)], "n string, want boolean")
    assert rows.where(X.verhoeff_ok(F.col("n")) != F.col("want")).count() == 0
    made = spark.createDataFrame([(n,) for n in numbers], "n string").select("n", R.verhoeff_digit(F.col("n")).alias("d")).collect()
    assert all(r.d == digit(r.n) for r in made)


def test_soundex_variant(spark):
    got = {r.t: r.c for r in spark.createDataFrame([("ASHCRAFT",), ("ROBERT",), ("TYMCZAK",), ("A",), ("LLOYD",), ("PFISTER",)], "t string").select("t", X.soundex(F.col("t")).alias("c")).collect()}

    def plain(t):
        m = {c: d for d, cs in zip("123456", ("BFPV", "CGJKQSXZ", "DT", "L", "MN", "R"), strict=True) for c in cs}
        out, last = t[0], m.get(t[0], "")
        for c in t[1:]:
            d = m.get(c, "")
            if d != last:
                out += d
                last = d
        return (out + "000")[:4]

    assert got == {t: plain(t) for t in got} and got["ASHCRAFT"] == "A226"


def test_ngrams_jaccard_and_shares(spark):
    r = random.Random(4)
    rows = [("".join(r.choice("AB C") for _ in range(r.randint(0, 9))).strip(), "".join(r.choice("ABC") for _ in range(r.randint(0, 9)))) for _ in range(60)]
    grams = lambda t: (lambda k: {k} - {""} if len(k) <= 3 else {k[i : i + 3] for i in range(len(k) - 2)})(t.replace(" ", ""))
    df = spark.createDataFrame(rows, "a string, b string")
    for x in df.select("a", "b", X.ngrams(F.col("a")).alias("g"), X.jaccard(X.ngrams(F.col("a")), X.ngrams(F.col("b"))).alias("j"), X.top_share(F.col("b")).alias("t"), X.variety(F.col("a")).alias("v")).collect():
        assert set(x.g) == grams(x.a) and len(x.g) == len(set(x.g))
        u = grams(x.a) | grams(x.b)
        assert abs(x.j - (len(grams(x.a) & grams(x.b)) / len(u) if grams(x.a) and grams(x.b) else 0)) < 1e-9
        assert abs(x.t - (max(map(x.b.lower().count, x.b.lower())) / len(x.b) if x.b else 0)) < 1e-9
        assert abs(x.v - len(set(x.a) - {" "}) / max(len(x.a.replace(" ", "")), 1)) < 1e-9


def test_gender_and_marital(spark):
    assert one(spark, V.gender(F.lit("female"))) == "Female" and one(spark, V.gender(F.lit("FEMALE"), compat=True)) == "Male"
    assert one(spark, R.marital(F.lit("Unmarried"))) == "Unmarried" and one(spark, R.marital(F.lit("Unmarried"), compat=True)) == "Married"


def test_repairs(spark):
    rows = [("Proposer_PAN", "A8CDE12S4F", "ABCDE1254F"), ("Bank_IFSC", "SB1N O000123".replace(" ", ""), "SBIN0000123"), ("Proposer_Mobile_Number", "+91 98765 43210", "9876543210"), ("Proposer_Mobile_Number", "09876543210", "9876543210"), ("Proposer_Pincode", "400-0011", "400001"), ("Nominee_Name", "raj ", "RAJ")]
    for name, value, want in rows:
        assert one(spark, V.repaired(F.lit(name), F.lit(value))) == want
    c = one(spark, V.checked(F.lit("Proposer_PAN"), F.lit("ABCDE12E4F")))
    assert (c.valid, c.correctable) == (False, False)
    assert one(spark, V.checked(F.lit("Proposer_Pincode"), F.lit("4000011"))).correctable


def test_dates_and_ages(spark):
    as_of = F.lit("2020-01-01").cast("date")
    for name, value, want in [("Date_of_Proposal", "01/02/2019", None), ("x", "31/02/2019", "unparsable"), ("x", "1.2.1899", "year_out_of_range"), ("Proposer_Date_of_Birth", "01-06-2010", "proposer_under_18"), ("LA_DOB", "2025-01-01", "age_unreasonable"), ("x", "", "unparsable")]:
        assert one(spark, V.date_issue(F.lit(name), F.lit(value), as_of)) == want, value
    assert one(spark, V.age_issue(F.lit("Proposer_Age"), F.lit("17 yrs"))) == "out_of_range" and one(spark, V.age_issue(F.lit("Nominee_Age"), F.lit("3"))) is None
    assert one(spark, R.date_text(F.lit("1-2-85"))) == "01/02/1985" and one(spark, R.date_text(F.lit("5 6"))) is None


def test_tables_and_json(spark):
    html = "<table><tr><td>1</td><td>Name</td><td>Sanvika</td></tr><tr><td>Age</td><td> 30 </td></tr><tr><th>Head</th></tr><tr><td>City</td><td></td></tr></table>"
    assert [tuple(p) for p in one(spark, P.pairs(F.lit(html)))] == [("Name", "Sanvika", "standard"), ("Age", "30", "standard"), ("Head", "", "header"), ("City", "", "empty")]
    assert one(spark, P.json_map(F.lit('```json\n{"a": "1", "b": 2,}\n```'))) == {"a": "1", "b": "2"} and one(spark, P.json_map(F.lit("none"))) is None
    assert one(spark, P.answer(F.lit('x {"value": "v", "confidence": 0.7}'))).confidence == 0.7 and one(spark, P.answer(F.lit("nothing"))) is None


def test_boxes(spark):
    a, b = G.box(F.lit(10), F.lit(0), F.lit(0), F.lit(10)), G.box(F.lit(5), F.lit(5), F.lit(15), F.lit(15))
    assert one(spark, G.area(a)) == 100 and abs(one(spark, G.iou(a, b)) - 25 / 175) < 1e-9 and not one(spark, G.contains(a, b))
    assert one(spark, R.box_of(F.lit("[0.1, 0.2, 0.5, 0.4]"), F.lit(1000), F.lit(500))) == [100, 100, 500, 200]
    assert one(spark, R.box_of(F.lit("bbox: 500 100 250 900"), F.lit(2000), F.lit(2000))) == [500, 200, 1000, 1800]
    assert one(spark, R.box_of(F.lit("no box"), F.lit(9), F.lit(9))) is None


def test_jaro_winkler():
    assert round(label.jaro("MARTHA", "MARHTA"), 4) == 0.9444 and round(label.jaro_winkler("MARTHA", "MARHTA"), 4) == 0.9611
    assert label.jaro("", "a") == 0 and label.jaro("MARTHA", "MARHTA", transpositions=False) == 1.0


def test_mask(spark):
    t = one(spark, X.mask_pii(F.lit("PAN ABCDE1234F id 2345 6789 0123 tel 9876543210 no 12345")))
    assert t == "PAN ********** id ************ tel ********** no 12345"


def test_smart_title_and_scripts(spark):
    assert one(spark, X.smart_title(F.lit("ABC lic limited RAJ  kumar"))) == "ABC LIC Limited RAJ Kumar"
    for t, want in [("नमस्ते", "devanagari"), ("abc नम", "mixed"), ("12", "numeric"), ("?", "other"), ("abc", "latin")]:
        assert one(spark, X.script(F.lit(t))) == want


def test_ratio_is_the_standard_one(spark):
    from quillspark.operators.resolve import ratio

    rows = [("ABCD", "BCDE"), ("", "A"), ("SAME", "SAME")]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", ratio("a", "b").alias("r")).collect()
    assert all(abs(x.r - SequenceMatcher(None, x.a, x.b).ratio()) < 1e-12 for x in got) and re.match("S", got[2].a)
