"""Column functions on field values: rules by family, repairs, validation, review categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X

# The field families' rules (canonical shape, score) and markers.
YES, NO = ("Y", "YES", "✓", "/", "TRUE"), ("N", "NO", "X", "FALSE")
NUMERIC_FIELDS = ("mobile_number", "aadhaar_last_or_id_number", "address_pincode", "annual_income", "proposed_sum_assured", "proposed_premium_amount")
STATES = ("andhra pradesh", "arunachal pradesh", "assam", "bihar", "chhattisgarh", "goa", "gujarat", "haryana", "himachal pradesh", "jharkhand", "karnataka", "kerala", "madhya pradesh", "maharashtra", "manipur", "meghalaya", "mizoram", "nagaland", "odisha", "punjab", "rajasthan", "sikkim", "tamil nadu", "telangana", "tripura", "uttar pradesh", "uttarakhand", "west bengal", "delhi", "chandigarh", "puducherry", "jammu and kashmir", "ladakh", "andaman and nicobar", "dadra and nagar haveli", "daman and diu", "lakshadweep")
PREMIUM_MODES = ("yearly", "half-yearly", "quarterly", "monthly", "y", "h", "q", "m", "वार्षिक", "अर्धवार्षिक", "तिमाही", "मासिक")
RULES = {
    "Proposer_PAN": r"^[A-Z]{5}[0-9]{4}[A-Z]$",
    "Proposer_Aadhaar": r"^[0-9]{12}$",
    "Proposer_Pincode": r"^[0-9]{6}$",
    "Proposer_Mobile_Number": r"^[6-9][0-9]{9}$",
    "Bank_IFSC": r"^[A-Z]{4}0[A-Z0-9]{6}$",
    "Bank_Account_Number": r"^[0-9]{8,18}$",
    "Proposer_Email": r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$",
}
# Look-alikes between letters and digits.
TO_LETTER, TO_DIGIT = ("01586", "OISBG"), ("OIlSBG", "011586")
REJECT, LOW, MEDIUM = 0.30, 0.50, 0.70


def _outcome(canonical: Column, score: float, issue: str | None = None) -> Column:
    return F.struct(canonical.alias("canonical"), F.lit(issue is None).alias("valid"), F.lit(score).alias("score"), (F.lit(issue) if issue else F.lit(None).cast("string")).alias("issue"))


def normalize(family: Column, name: Column, raw: Column) -> Column:
    """struct(canonical, valid, score, issue) of a raw value by its family's rule; an empty value is invalid with score 0."""
    t = X.collapse(raw)
    mark = F.replace(F.upper(t), F.lit("."), F.lit(""))
    tight = F.replace(t, F.lit(" "), F.lit(""))
    plain = F.replace(tight, F.lit(","), F.lit(""))
    figures = X.digits(t)
    ident = X.upper_alnum(t)
    words = X.collapse(F.translate(t, "|_", "  "))

    def shaped(ok: Column, good: Column, score: float, issue: str, bad: float) -> Column:
        return F.when(ok, _outcome(good, score)).otherwise(_outcome(good, bad, issue))

    short = F.length(words) < 2
    of_id = (
        F.when(name == "pan_number", shaped(ident.rlike("^[A-Z]{5}[0-9]{4}[A-Z]$"), ident, 0.99, "bad_pan_shape", 0.15))
        .when(name == "address_pincode", shaped(ident.rlike("^[0-9]{6}$"), ident, 0.98, "bad_pincode_shape", 0.20))
        .when(name == "aadhaar_last_or_id_number", shaped(ident.rlike("^[0-9]{12}$"), ident, 0.98, "bad_aadhaar_shape", 0.20))
        .when(name == "ckyc_number", shaped(ident.rlike("^[A-Z]{3,6}[0-9]{5,9}$"), ident, 0.94, "weak_ckyc_shape", 0.55))
        .when(name == "customer_id", shaped(ident.rlike("^[A-Z]{3,6}[0-9]{5,9}$"), ident, 0.94, "weak_customer_id_shape", 0.55))
        .otherwise(shaped(ident.rlike("^[A-Z0-9]{3,20}$"), ident, 0.90, "bad_short_id_shape", 0.25))
    )
    return (
        F.when(t == "", _outcome(F.lit(""), 0.0, "empty"))
        .when(family == "binary_mark", F.when(mark.isin(*YES), _outcome(F.lit("YES"), 0.98)).when(mark.isin(*NO), _outcome(F.lit("NO"), 0.98)).otherwise(_outcome(t, 0.15, "unknown_mark")))
        .when(
            family == "date",
            F.when(tight.rlike(r"^[0-9]{2}[/\-.][0-9]{2}[/\-.][0-9]{4}$"), _outcome(F.translate(tight, "-.", "//"), 0.98)).when(F.upper(tight).isin("NA", "N/A"), _outcome(F.upper(tight), 0.90)).otherwise(_outcome(t, 0.20, "bad_date_shape")),
        )
        .when(family == "amount", F.when(plain.rlike("^[0-9]{1,12}$"), _outcome(plain, 0.97)).otherwise(_outcome(t, 0.20, "bad_amount_shape")))
        .when(family == "numeric", F.when(figures != "", _outcome(figures, 0.96)).otherwise(_outcome(t, 0.15, "bad_numeric_shape")))
        .when(family == "short_id", of_id)
        .when(family.isin("name_text", "short_text", "long_text") & short, _outcome(words, 0.15, "too_short"))
        .when(family == "name_text", shaped(words.rlike(r"^[A-Za-z .'-/]+$"), words, 0.90, "non_name_chars", 0.55))
        .when(family == "short_text", shaped(F.length(words) <= 40, words, 0.88, "too_long_for_short_text", 0.45))
        .when(family == "long_text", shaped(F.length(words) <= 120, words, 0.86, "too_long_for_long_text", 0.40))
        .otherwise(_outcome(t, 0.70))
    )


def same_label(x: Column, y: Column) -> Column:
    return F.upper(X.collapse(x)) == F.upper(X.collapse(y))


def hallucination(value: Column, family: Column, confidence: Column) -> Column:
    """The first reason that fits, or null: known token, gibberish, repetition, then by family."""
    v = F.trim(value)
    figures = v.rlike("[0-9]")
    return (
        F.when(F.coalesce(v, F.lit("")) == "", F.lit(None).cast("string"))
        .when(F.lower(v).isin(*X.HALLUCINATIONS), "known_token")
        .when(X.is_gibberish(v), "gibberish")
        .when(X.is_repetitive(v), "repetitive")
        .when(family.isin("name_text", "short_text") & (F.length(v) > 2) & (X.variety(v) < 0.2) & (confidence < 0.7), "low_variety")
        .when((family == "numeric") & ~figures, "numeric_without_digits")
        .when((family == "amount") & ~figures, "amount_without_digits")
        .when((family == "date") & ~figures, "date_without_digits")
        .when((family == "short_id") & (F.length(v) > 40), "id_too_long")
        .when(family.isin("name_text", "short_text") & (F.length(v) > 150), "text_too_long")
        .when((family == "binary_mark") & (F.length(v) > 5) & ~F.lower(v).isin("checked", "unchecked", "marked", "unmarked"), "unexpected_mark")
    )


def semantic_issue(name: Column, value: Column) -> Column:
    """Why a value cannot stand in its field, or null; empty values pass."""
    v, low = F.trim(value), F.lower(F.trim(value))
    figures = X.digits(value)
    return (
        F.when(F.coalesce(v, F.lit("")) == "", F.lit(None).cast("string"))
        .when(F.lower(name).contains("state") & ~low.isin(*STATES) & (F.length(v) < 3), "unknown_state")
        .when(name.rlike("Plan_Name|proposed_plan_name") & (F.length(v) < 3), "plan_name_too_short")
        .when(name.rlike("Premium_Mode|proposed_premium_mode") & ~low.isin(*PREMIUM_MODES), "unknown_premium_mode")
        .when(F.lower(name).contains("email") & ~((F.instr(v, "@") > 0) & F.contains(F.substring_index(v, "@", -1), F.lit("."))), "bad_email")
        .when(name.rlike("Mobile|mobile_number") & ~figures.rlike("^[6-9][0-9]{9}$"), "bad_mobile")
    )


def repaired(name: Column, value: Column) -> Column:
    """The value after its field's repair: letters and digits swapped by place, prefixes and other marks dropped."""
    v = F.replace(F.upper(F.trim(value)), F.lit(" "), F.lit(""))
    figures = X.digits(v)
    pan = F.concat(F.translate(F.substring(v, 1, 5), *TO_LETTER), F.translate(F.substring(v, 6, 4), *TO_DIGIT), F.translate(F.substring(v, 10, 1), *TO_LETTER))
    ifsc = F.concat(F.translate(F.substring(v, 1, 4), *TO_LETTER), F.lit("0"), F.substring(v, 6, 6))
    mobile = F.when((F.length(figures) == 12) & figures.startswith("91"), F.substring(figures, 3, 10)).when((F.length(figures) == 11) & figures.startswith("0"), F.substring(figures, 2, 10)).otherwise(figures)
    return (
        F.when(name.contains("PAN"), F.when(F.length(v) == 10, pan).otherwise(v))
        .when(name.contains("IFSC"), F.when(F.length(v) == 11, ifsc).otherwise(v))
        .when(name.contains("Mobile"), mobile)
        .when(name.contains("Pincode"), F.substring(figures, 1, 6))
        .when(name.contains("Aadhaar"), F.substring(figures, 1, 12))
        .otherwise(v)
    )


def checked(name: Column, value: Column) -> Column:
    """struct(valid, correctable, corrected): a value against its field's pattern, before and after repair."""
    v = F.replace(F.upper(F.trim(value)), F.lit(" "), F.lit(""))
    fixed = repaired(name, value)
    ok, mended, ruled = F.lit(False), F.lit(False), name.isin(*RULES)
    for field, pattern in RULES.items():
        ok = ok | ((name == field) & v.rlike(pattern))
        mended = mended | ((name == field) & fixed.rlike(pattern))
    return F.struct((~ruled | ok).alias("valid"), (ruled & ~ok & mended).alias("correctable"), F.when(~ruled, value).when(ok, v).when(mended, fixed).alias("corrected"))


def parsed_date(value: Column) -> Column:
    """The first of five formats that fits, as a date; null if none does."""
    v = F.replace(F.trim(value), F.lit(" "), F.lit(""))
    shapes = ((r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "d/M/yyyy"), (r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$", "d-M-yyyy"), (r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}$", "d.M.yyyy"), (r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", "yyyy-M-d"), (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}$", "d/M/yy"))
    return F.coalesce(*(F.when(v.rlike(p), F.try_to_timestamp(v, F.lit(f)).cast("date")) for p, f in shapes))


def date_issue(name: Column, value: Column, as_of: Column) -> Column:
    """Why a date does not stand, or null. Ages are taken on the given day, never on today's."""
    d = parsed_date(value)
    age = F.datediff(as_of, d) / 365.25
    birth = name.rlike("Birth|DOB")
    return (
        F.when(d.isNull(), "unparsable")
        .when((F.year(d) < 1900) | (F.year(d) > 2030), "year_out_of_range")
        .when(birth & ((age < 0) | (age > 120)), "age_unreasonable")
        .when(birth & name.contains("Proposer") & (age < 18), "proposer_under_18")
    )


def age_issue(name: Column, value: Column) -> Column:
    n = X.digits(value)
    age = F.substring(n, 1, 9).cast("int")
    return F.when(n == "", "unparsable").when(name.contains("Proposer") & ~age.between(18, 100), "out_of_range").when(name.contains("Nominee") & ~age.between(0, 120), "out_of_range")


def category(confidence: Column, valid: Column) -> Column:
    return F.when(confidence < REJECT, "Rejected").when(confidence < LOW, "Low Confidence").when(confidence < MEDIUM, "Needs Review").when(~valid, "Validation Failed").otherwise("Extracted")


def calibrated(value: Column, confidence: Column, kb: Column, status: Column, cross: Column, verified: Column) -> Column:
    """struct(confidence, category) after the evidence, in this order: dictionary hit, status (VALID, INVALID or
    HALLUCINATION), cross-field issue, verification. An empty value has 0 and is missing; only a VALID one is accepted.
    """
    c = F.when(kb, F.least(confidence + 0.05, F.lit(0.98))).otherwise(confidence)
    c = F.when(status == "INVALID", c * 0.5).when(status == "HALLUCINATION", F.lit(0.0)).otherwise(c)
    c = F.when(cross, c * 0.85).otherwise(c)
    c = F.when(verified, F.least(c + 0.10, F.lit(0.99))).otherwise(c)
    c = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), 4)
    band = F.when((c >= 0.85) & (status == "VALID"), "auto_accepted").when(c >= 0.70, "needs_review").when(c >= 0.50, "low_confidence").otherwise("rejected")
    empty = F.coalesce(value, F.lit("")) == ""
    return F.struct(F.when(empty, 0.0).otherwise(c).alias("confidence"), F.when(empty, "missing").otherwise(band).alias("category"))


def review_band(confidence: Column) -> Column:
    return F.when(confidence >= 0.85, "auto_accepted").when(confidence >= 0.70, "needs_review").when(confidence >= 0.50, "low_confidence").otherwise("rejected")


def gender(c: Column, compat: bool = False) -> Column:
    """Male, Female or null; compat lets MALE inside FEMALE win."""
    u = F.upper(F.trim(c))
    female, male = u.contains("FEMALE") | (u == "F"), u.contains("MALE") | (u == "M")
    return F.when(male, "Male").when(female, "Female") if compat else F.when(female, "Female").when(male, "Male")


def family_of(name: Column) -> Column:
    """Families of the fields used in views."""
    return F.when(name == "date_of_birth", "date").when(name == "annual_income", "amount").when(name == "age_years", "numeric").when(name == "pan_number", "short_id").when(name == "first_name", "name_text").otherwise("binary_mark")
