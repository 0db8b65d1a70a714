"""Column functions over fixed dictionaries: places, occupations, labels, kinds of fields, lexicon routes."""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import repair as R

# Spellings of places and occupations, and what they stand for.
CITIES = {
    "MUMBAI": "MUMBAI", "BOMBAY": "MUMBAI", "MUNBAI": "MUMBAI", "NAGPUR": "NAGPUR", "NAGPUO": "NAGPUR", "PUNE": "PUNE", "POONA": "PUNE",
    "DELHI": "DELHI", "KOLKATA": "KOLKATA", "CHENNAI": "CHENNAI", "MADRAS": "CHENNAI", "BANGALORE": "BENGALURU", "BENGALURU": "BENGALURU",
}
STATES = {
    "MAHARASHTRA": "MAHARASHTRA", "MAHARASH": "MAHARASHTRA", "MAHARASHHS": "MAHARASHTRA", "MAH": "MAHARASHTRA", "GUJARAT": "GUJARAT",
    "RAJASTHAN": "RAJASTHAN", "TAMIL NADU": "TAMIL NADU", "KARNATAKA": "KARNATAKA", "WEST BENGAL": "WEST BENGAL",
}
OCCUPATIONS = {
    "SALESPERSON": "SALES", "SALESMAN": "SALES", "SASE": "SALES", "BUSINESS": "BUSINESS", "SERVICE": "SERVICE", "PROFESSIONAL": "PROFESSIONAL",
    "EMPLOYEE": "EMPLOYEE", "HOUSEWIFE": "HOUSEWIFE", "STUDENT": "STUDENT", "RETIRED": "RETIRED",
}
GENDERS = ("FEMALE", "MALE", "TRANSGENDER", "OTHER")
MARITAL = ("UNMARRIED", "MARRIED", "DIVORCED", "WIDOWED", "SINGLE")
# Canonical fields in the order in which labels are tried, with their kind and label patterns.
LABELS = (
    ("Proposer_Full_Name", "text", (r"name", r"full name", r"proposer name", r"life to be assured")),
    ("Proposer_Father_Name", "text", (r"father", r"father's name", r"mother name", r"mother's name", r"s/o", r"d/o")),
    ("Proposer_DOB", "date", (r"date of birth", r"dob", r"birth date", r"born")),
    ("Proposer_Age", "number", (r"\bage\b", r"years", r"age last", r"age nearer")),
    ("Proposer_Gender", "choice", (r"gender", r"sex", r"male", r"female", r"transgender")),
    ("Proposer_Marital_Status", "choice", (r"marital", r"married", r"unmarried", r"spouse")),
    ("Proposer_Spouse_Name", "text", (r"spouse", r"husband", r"wife", r"married")),
    ("Proposer_Birth_Place", "text", (r"place of birth", r"birth place", r"born at", r"birth city")),
    ("Proposer_Nationality", "text", (r"nationality",)),
    ("Proposer_Citizenship", "text", (r"citizenship",)),
    ("Proposer_Permanent_Address", "address", (r"permanent address", r"address", r"residence", r"correspondence address")),
    ("Proposer_PIN", "pincode", (r"pin", r"pin code", r"postal code", r"zip")),
    ("Proposer_Phone", "phone", (r"phone", r"mobile", r"tel", r"telephone", r"std")),
    ("Proposer_Email", "email", (r"email", r"e-mail", r"mail")),
    ("Proposer_Occupation", "text", (r"occupation", r"profession", r"job", r"business", r"service")),
    ("Proposer_Income", "money", (r"income", r"annual income", r"salary", r"rs\.", r"rupees")),
    ("Proposer_PAN", "pan", (r"pan", r"permanent account", r"income tax")),
    ("Proposer_Aadhaar", "aadhaar", (r"aadhaar", r"aadhar", r"uidai", r"uid")),
    ("Customer_ID", "text", (r"customer id", r"client id", r"proposer id")),
    ("KYC_Number", "text", (r"kyc", r"kyc number", r"kyc registry")),
    ("Plan_Name", "text", (r"plan", r"plan name", r"product", r"scheme")),
    ("Policy_Term", "number", (r"term", r"policy term", r"years")),
    ("Sum_Assured", "money", (r"sum assured", r"sum assured \(", r"coverage", r"sa")),
    ("Premium_Amount", "money", (r"premium", r"premium amount", r"rs\.", r"rupees")),
    ("Premium_Mode", "choice", (r"mode", r"premium mode", r"frequency", r"yearly", r"half yearly", r"monthly")),
    ("Nominee_Name", "text", (r"nominee", r"nominee name", r"nomination")),
    ("Nominee_Relationship", "text", (r"relationship", r"relation", r"nominee relation")),
    ("Agent_Code", "alphanumeric", (r"agent", r"agent code", r"agent no", r"agent number")),
    ("Agent_Name", "text", (r"agent name", r"agent/intermediary")),
    ("Branch_Name", "text", (r"branch", r"branch name", r"branch office", r"branch code")),
    ("Height", "text", (r"height", r"ht\.", r"cms", r"feet")),
    ("Weight", "text", (r"weight", r"wt\.", r"kgs", r"kg")),
)
# Which fields are looked up in which lexicons.
PERSON_TOKEN_FIELDS = ("first_name", "middle_name", "last_name")
PERSON_FULL_FIELDS = ("father_full_name", "mother_full_name", "spouse_full_name", "nominee_name", "appointee_name", "declarant_name", "husband_full_name", "agent_name", "development_officer_name", "proposer_full_name", "proposer_father_name", "proposer_spouse_name")
EMPLOYER_FIELDS = ("employer_name", "branch_name")
PLAN_FIELDS = ("preferred_plan_name", "proposed_plan_name", "plan_name")


def near(a: str, b: str) -> float:
    """Matching-blocks similarity, case folded."""
    return SequenceMatcher(None, a.lower(), b.lower()).ratio()


def near_with_prefix(a: str, b: str) -> float:
    """near(), and a tenth for each equal leading character, four at most; 1 at most."""
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return 1.0 if a == b else min(near(a, b) + 0.1 * same, 1.0)


def place_of(text: str, names: dict[str, str], least: float) -> str | None:
    """The name whose spelling is text, else that of the nearest spelling above `least`, the first on ties; else None."""
    best, top = names.get(text), least
    if best is None:
        for spelling, name in names.items():
            score = near_with_prefix(text, spelling)
            if score > top:
                best, top = name, score
    return best.capitalize() if best else None


def occupation_of(text: str) -> str:
    """The first occupation whose word is in the text or nearer to it than 0.7, else the text."""
    for word, name in OCCUPATIONS.items():
        if word in text or near(text, word) > 0.7:
            return name
    return text.capitalize()


def _word_in(text: str, words: tuple[str, ...]) -> str | None:
    """The first word that the text contains, else the nearest above 0.8; longer words come before those inside them."""
    held = next((w for w in words if w in text), None) or max((w for w in words if near(text, w) > 0.8), key=lambda w: near(text, w), default=None)
    return held.capitalize() if held else None


def gender_of(text: str) -> str | None:
    return _word_in(text, GENDERS) or ("Male" if "M" in text[:2] else "Female" if "F" in text[:2] else None)


def marital_of(text: str) -> str | None:
    return _word_in(text, MARITAL) or ("Unmarried" if "UNMARR" in text else "Married" if "MARR" in text else None)


def _by_dictionary(of: Callable[[str], str | None]) -> Callable[[Column], Column]:
    """A column function on cleaned texts; built-ins have no matching-blocks similarity, so texts are looked up by Arrow batch."""

    @F.pandas_udf(T.StringType())
    def look_up(texts: pd.Series) -> pd.Series:
        known = lru_cache(1 << 16)(of)
        return pd.Series([known(t) if t else None for t in texts], dtype=object)

    return lambda c: look_up(F.when(F.coalesce(c, F.lit("")) != "", R.cleaned(c)))


#: The city, state or occupation that a text names; null for an empty text and, for places, if none is near.
city = _by_dictionary(lambda t: place_of(t, CITIES, 0.8))
state = _by_dictionary(lambda t: place_of(t, STATES, 0.7))
occupation = _by_dictionary(occupation_of)
gender = _by_dictionary(gender_of)
marital = _by_dictionary(marital_of)


def label_field(label: Column) -> Column:
    """The first canonical field with a pattern that the label contains, case folded; null if none."""
    low, out = F.lower(F.trim(label)), F.lit(None).cast("string")
    for field, _, patterns in reversed(LABELS):
        out = F.when(low.rlike("|".join(f"(?:{p})" for p in patterns)), field).otherwise(out)
    return out


def field_kind(field: Column) -> Column:
    """A canonical field's kind; text for all others."""
    out = F.lit("text")
    for kind in dict.fromkeys(k for _, k, _ in LABELS):
        out = F.when(field.isin([f for f, k, _ in LABELS if k == kind]), kind).otherwise(out)
    return out


def lexicon_categories(field: Column) -> Column:
    """array<string>: the lexicons that a field's values are looked up in, the first being its own; empty if none."""
    key = F.lower(F.trim(F.coalesce(field, F.lit(""))))
    listed = lambda *names: F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    person = listed("person_full", "person_token")
    return (
        F.when(key.isin(*PERSON_TOKEN_FIELDS), listed("person_token"))
        .when(key.isin(*PERSON_FULL_FIELDS), person)
        .when(key.isin(*EMPLOYER_FIELDS) | key.rlike("employer|branch"), listed("employer_name"))
        .when(key.isin(*PLAN_FIELDS) | key.contains("plan_name"), listed("plan_name"))
        .when(key.rlike("name|father|mother|spouse"), person)
        .otherwise(listed())
    )


def routed(rows: DataFrame, name: str = "field_name", raw: str = "text", decision: str | None = None) -> DataFrame:
    """Adds routed, struct(field, value, confidence, status, method): the first of nine ordered ways to read a field that gives a value.

    Names that are no structured ids (letters, digits and _, with a _ or in lower case) are taken as labels; a label that
    fits no field gives way to a raw text of six words at most. decision: a column of the lexicon's struct(accepted,
    resolved_text, confidence, method, review_required), if there is one. A null name counts as empty, a null text too.
    The steps are columns of their own, so that none is worked out twice.
    """
    own = [F.col(f"`{c}`") for c in rows.columns]
    none = F.lit(None).cast("struct<accepted:boolean,resolved_text:string,confidence:double,method:string,review_required:boolean>")
    packed = rows.select(F.struct(*own).alias("row"), F.coalesce(F.col(f"`{name}`"), F.lit("")).alias("name"), F.coalesce(F.col(f"`{raw}`"), F.lit("")).alias("raw"), (none if decision is None else F.col(f"`{decision}`")).alias("d"))
    n, t = F.col("name"), F.col("raw")
    by_id = n.rlike("^[A-Za-z0-9_]+$") & (n.contains("_") | (n.rlike("[a-z]") & ~n.rlike("[A-Z]")))
    words = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    step = packed.withColumn("field", F.when(by_id, n).otherwise(F.coalesce(label_field(n), F.when((t != "") & (words <= 6), label_field(t)), n)))
    step = step.withColumns({"low": F.lower("field"), "kind": field_kind(F.col("field")), "clean": R.cleaned(t), "pretty": R.pretty(t)})
    low, kind, field, clean, pretty = (F.col(c) for c in ("low", "kind", "field", "clean", "pretty"))
    job = (kind == "text") & (low.contains("occupation") | F.lower(t).contains("occup"))
    step = step.withColumns({
        "choice": F.coalesce(gender(F.when((kind == "choice") & low.contains("gender"), t)), marital(F.when((kind == "choice") & low.contains("marital"), t))),
        "place": city(F.when(low.rlike("city|place"), t)),
        "region": state(F.when(low.contains("state"), t)),
        "work": occupation(F.when(job, t)),
        "pin": F.when((kind == "pincode") | low.contains("pin"), R.pincode(t)),
        "pan": F.when((kind == "pan") | low.contains("pan"), R.pan(t)),
        "number": F.when((kind == "aadhaar") | low.contains("aadhaar"), R.aadhaar_in(t)),
        "date": F.when((kind == "date") | low.rlike("dob|birth|date"), R.date_text(t)),
        "named": (kind == "text") & R.is_name_field(field),
    })

    def way(value: Column, confidence: Column | float, status: str | Column, method: str | Column, to: str | None = None) -> Column:
        text = lambda x: F.lit(x) if isinstance(x, str) else x
        return F.struct((F.lit(to) if to else field).alias("field"), value.alias("value"), (F.lit(confidence) if isinstance(confidence, float) else confidence).alias("confidence"), text(status).alias("status"), text(method).alias("method"))

    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    sure, method = F.coalesce("d.confidence", F.lit(0.0)), F.coalesce("d.method", F.lit("no_lexicon_route"))
    number = F.when(R.aadhaar(F.col("number"))["valid"], way(F.col("number"), 0.99, "valid", "verhoeff_algorithm", "Proposer_Aadhaar")).otherwise(way(F.col("number"), 0.70, "invalid", "verhoeff_failed", "Proposer_Aadhaar"))
    default = F.struct(F.when(field == "", "unknown_field").otherwise(field).alias("field"), F.when(clean != "", clean).otherwise(t).alias("value"), F.lit(0.85).alias("confidence"), F.when(clean != "", "valid").otherwise("pending_review").alias("status"), F.lit("basic_clean").alias("method"))
    out = (
        F.when(given("choice"), way(F.col("choice"), 0.99, "corrected", "dictionary"))
        .when(given("place"), way(F.col("place"), 0.95, "corrected", "fuzzy_city_map", "Proposer_Birth_Place"))
        .when(given("region"), way(F.col("region"), 0.96, "corrected", "fuzzy_state_map", "Proposer_State"))
        .when(given("pin"), way(F.col("pin"), 0.99, "valid", "regex_extract", "Proposer_PIN"))
        .when(given("pan"), way(F.col("pan"), 0.98, "valid", "regex_extract", "Proposer_PAN"))
        .when(given("number"), number)
        .when(given("date"), way(F.col("date"), 0.90, "corrected", "date_normalization", "Proposer_DOB"))
        .when(given("work"), way(F.col("work"), 0.92, "corrected", "occupation_map", "Proposer_Occupation"))
        .when(F.col("named") & F.coalesce("d.accepted", F.lit(False)), way(F.col("d.resolved_text"), F.greatest(F.lit(0.88), sure), F.when(F.col("d.resolved_text") != pretty, "corrected").otherwise("valid"), method))
        .when(F.col("named") & (pretty != ""), way(pretty, F.greatest(F.lit(0.72), sure), F.when(F.coalesce("d.review_required", F.lit(False)), "pending_review").otherwise("valid"), method))
        .otherwise(default)
    )
    return step.select("row.*", out.alias("routed"))


def floored(name: Column, value: Column, confidence: Column) -> Column:
    """struct(value, confidence): a value repaired by its field's name is at least so sure; others stay as they are."""
    v, low = F.trim(value), F.lower(name)
    out = F.struct(v.alias("value"), confidence.cast("double").alias("confidence"))

    def mended(fixed: Column, floor: float) -> Column:
        return F.when(F.coalesce(fixed, F.lit("")) != "", F.struct(fixed.alias("value"), F.greatest(confidence, F.lit(floor)).cast("double").alias("confidence"))).otherwise(out)

    only = lambda part, of: of(F.when(low.rlike(part), v))
    return (
        F.when(low.contains("pincode") | low.endswith("_pin"), mended(R.pincode(v), 0.99))
        .when(low.contains("aadhaar"), mended(R.aadhaar_in(v), 0.99))
        .when(low.contains("gender"), mended(only("gender", gender), 0.98))
        .when(low.rlike("city|birth"), mended(only("city|birth", city), 0.95))
        .when(low.contains("occupation"), mended(only("occupation", occupation), 0.92))
        .otherwise(out)
    )
