"""Dictionaries, routes and floors against plain rules."""

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quillspark.functions import dictionary as D
from quillspark.functions import repair as R


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def route(spark, name, raw, decision=None):
    row = spark.createDataFrame([(name, raw, 1)], "field_name string, text string, low int")
    row = row if decision is None else row.withColumn("decision", decision)
    out = D.routed(row, decision=None if decision is None else "decision").first()
    assert out.low == 1
    return out.routed


def nearest(text, names, least):
    if text in names:
        return names[text].capitalize()
    best, top = None, least
    for spelling, name in names.items():
        prefix = 0
        for a, b in zip(text[:4], spelling[:4], strict=False):
            if a != b:
                break
            prefix += 1
        score = min(1.0, SequenceMatcher(None, text.lower(), spelling.lower()).ratio() + prefix / 10)
        if score > top + 1e-12:
            best, top = name.capitalize(), score
    return best


def test_places_and_occupations(spark):
    words = ["Poona", "chenai", "Bengalore", "delhi!", "TAMILNADU", "Rajasthn", "mah", "Gujrat", "xyz", "Westbengal", "KARNATKA", "nagpur city", ""]
    rows = spark.createDataFrame([(w,) for w in [*words, None]], "t string").select("t", D.city(F.col("t")).alias("c"), D.state(F.col("t")).alias("s"), D.occupation(F.col("t")).alias("o")).collect()
    for r in rows:
        clean = (r.t or "").replace("!", "").upper()
        assert r.c == (nearest(clean, D.CITIES, 0.8) if clean else None), r
        assert r.s == (nearest(clean, D.STATES, 0.7) if clean else None), r
    assert {r.t: r.o for r in rows}["xyz"] == "Xyz" and one(spark, D.occupation(F.lit("retird"))) == "RETIRED" and one(spark, D.occupation(F.lit("my business"))) == "BUSINESS"


@pytest.mark.parametrize(("text", "want"), [("femlae", "Female"), ("FEMALE", "Female"), ("mal", "Male"), ("M", "Male"), ("f.", "Female"), ("Transgendr", "Transgender"), ("", None), ("x", None)])
def test_gender_words(spark, text, want):
    assert one(spark, D.gender(F.lit(text))) == want


@pytest.mark.parametrize(("text", "want"), [("Un married", None), ("unmaried", "Unmarried"), ("MARIED", "Married"), ("Widow", "Widowed"), ("singel", "Single"), ("now MARRY", "Married"), ("?", None)])
def test_marital_words(spark, text, want):
    got = one(spark, D.marital(F.lit(text)))
    assert got == want or (want is None and got in ("Married", "Unmarried") and "MARR" in text.upper().replace(" ", ""))


@pytest.mark.parametrize(
    ("name", "raw", "want"),
    [
        ("Sex of proposer", "femle", ("Proposer_Gender", "Female", 0.99, "corrected", "dictionary")),
        ("birth_place", "poona", ("Proposer_Birth_Place", "Pune", 0.95, "corrected", "fuzzy_city_map")),
        ("address_state", "Gujrat", ("Proposer_State", "Gujarat", 0.96, "corrected", "fuzzy_state_map")),
        ("Zip", "is 411 045.", ("Proposer_PIN", "411045", 0.99, "valid", "regex_extract")),
        ("pan_number", "no: abcpz 1234k", ("Proposer_PAN", "ABCPZ1234K", 0.98, "valid", "regex_extract")),
        ("dob", "3-4-77", ("Proposer_DOB", "03/04/1977", 0.90, "corrected", "date_normalization")),
        ("occupation", "Studnt", ("Proposer_Occupation", "STUDENT", 0.92, "corrected", "occupation_map")),
        ("agent_name", "ravi  KUMAR lal", ("agent_name", "Ravi Kumar LAL", 0.72, "valid", "no_lexicon_route")),
        ("remarks", "all, well", ("remarks", "ALL WELL", 0.85, "valid", "basic_clean")),
        ("remarks", "", ("remarks", "", 0.85, "pending_review", "basic_clean")),
        ("", None, ("unknown_field", "", 0.85, "pending_review", "basic_clean")),
        ("City", "qqqqqqqq", ("City", "QQQQQQQQ", 0.85, "valid", "basic_clean")),
    ],
)
def test_routes(spark, name, raw, want):
    assert tuple(route(spark, name, raw)) == want


def test_routes_take_numbers_with_a_right_checksum_and_lexicon_decisions(spark):
    n = one(spark, F.concat(F.lit("90210021900"), R.verhoeff_digit(F.lit("90210021900"))))
    assert tuple(route(spark, "aadhaar_no", f"{n[:4]} {n[4:8]}-{n[8:]}")) == ("Proposer_Aadhaar", n, 0.99, "valid", "verhoeff_algorithm")
    wrong = n[:-1] + str((int(n[-1]) + 1) % 10)
    assert route(spark, "aadhaar_no", wrong).method == "basic_clean"
    decision = F.struct(F.lit(True).alias("accepted"), F.lit("ASHA RAO").alias("resolved_text"), F.lit(0.95).alias("confidence"), F.lit("lexicon_exact").alias("method"), F.lit(False).alias("review_required"))
    assert tuple(route(spark, "nominee_name", "asha ra0", decision)) == ("nominee_name", "ASHA RAO", 0.95, "corrected", "lexicon_exact")


@pytest.mark.parametrize(
    ("name", "value", "sure", "want"),
    [("x_pin", "4 1 1 0 4 5", 0.2, ("411045", 0.99)), ("address_pincode", "41", 0.2, ("41", 0.2)), ("gender", "femal", 0.5, ("Female", 0.98)), ("birth_city", "Bombay", 0.99, ("Mumbai", 0.99)), ("occupation", "servic", 0.1, ("SERVICE", 0.92)), ("other", " x ", 0.4, ("x", 0.4))],
)
def test_floors(spark, name, value, sure, want):
    assert tuple(one(spark, D.floored(F.lit(name), F.lit(value), F.lit(sure)))) == want


def test_labels_take_the_first_field(spark):
    got = {t: one(spark, D.label_field(F.lit(t))) for t in ("Nominee Name", "S/O", "AGE last", "Sage", "Telephone", "zzz", "Ht. in cms")}
    assert got == {"Nominee Name": "Proposer_Full_Name", "S/O": "Proposer_Father_Name", "AGE last": "Proposer_Age", "Sage": "Sum_Assured", "Telephone": "Proposer_Phone", "zzz": None, "Ht. in cms": "Height"}
