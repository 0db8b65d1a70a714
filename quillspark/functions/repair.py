"""Column functions that repair and read single values: dictionaries, identifiers, dates, boxes, confidences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X

# Which fields hold names or entities.
NAME_PARTS = "name|father|mother|spouse|nominee|appointee|employer|agent"


def cleaned(c: Column) -> Column:
    """Word characters, white space and / . ( ) - stay; upper case."""
    return F.upper(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[^\w\s/.()\-]", ""), r"\s+", " ")))


def marital(c: Column, compat: bool = False) -> Column:
    """The marital status in a text, or null; compat lets MARRIED inside UNMARRIED win."""
    u = cleaned(c)
    rest = F.when(u.contains("SINGLE"), "Single").when(u.contains("DIVORC"), "Divorced").when(u.contains("WIDOW"), "Widowed")
    if compat:
        return F.when(u.contains("MARR"), "Married").otherwise(rest)
    return F.when(u.contains("UNMARR"), "Unmarried").when(u.contains("MARR"), "Married").otherwise(rest)


def pincode(c: Column) -> Column:
    """The first six digits in a row, spaces and dots apart, else the first six digits of all."""
    bare = F.translate(c, " .", "")
    hit, figures = F.regexp_extract(bare, "([0-9]{6})", 1), X.digits(c)
    return F.when(hit != "", hit).when(F.length(figures) >= 6, F.substring(figures, 1, 6))


def pan(c: Column) -> Column:
    hit = F.regexp_extract(F.replace(F.upper(c), F.lit(" "), F.lit("")), "([A-Z]{5}[0-9]{4}[A-Z])", 1)
    return F.when(hit != "", hit)


def date_text(c: Column) -> Column:
    """DD/MM/YYYY of the first three numbers; years of two digits turn at 50, those of one or three follow 200."""
    n = F.regexp_extract_all(c, F.lit("([0-9]+)"), 1)
    y = F.get(n, F.lit(2))
    year = F.when(F.length(y) == 2, F.concat(F.when(y.cast("int") < 50, "20").otherwise("19"), y)).when(F.length(y).isin(1, 3), F.concat(F.lit("200"), y)).otherwise(y)
    two = lambda x: F.when(F.length(x) < 2, F.lpad(x, 2, "0")).otherwise(x)
    return F.when(F.size(n) >= 3, F.concat_ws("/", two(F.get(n, F.lit(0))), two(F.get(n, F.lit(1))), year))


def verhoeff_digit(c: Column) -> Column:
    """The digit that makes a digit string's checksum 0."""
    out = F.lit(None).cast("string")
    for d in "9876543210":
        out = F.when(X.verhoeff_ok(F.concat(c, F.lit(d))), d).otherwise(out)
    return out


def aadhaar(c: Column) -> Column:
    """struct(number, well_formed, valid) of a 12-digit number with spaces or dashes; 0 and 1 cannot lead."""
    n = F.translate(F.trim(c), " -", "")
    shaped = n.rlike("^[2-9][0-9]{11}$")
    return F.struct(n.alias("number"), shaped.alias("well_formed"), (shaped & X.verhoeff_ok(n)).alias("valid"))


def aadhaar_in(c: Column) -> Column:
    """The first 12 digits in a row if their checksum is right, else the first three groups of four if theirs is; else null."""
    run, groups = F.regexp_extract(c, "([0-9]{12})", 1), X.digits(F.regexp_extract(c, r"([0-9]{4}[\s\-]?[0-9]{4}[\s\-]?[0-9]{4})", 1))
    return F.when(X.verhoeff_ok(run), run).when(X.verhoeff_ok(groups), groups)


def pretty(c: Column) -> Column:
    """Cleaned words capitalised; words of letters alone stay in capitals up to three."""
    one = lambda w: F.when((F.length(w) <= 3) & w.rlike(r"^\p{L}+$"), w).otherwise(F.concat(F.substring(w, 1, 1), F.lower(F.substring(w, 2, 1 << 20))))
    return F.array_join(F.transform(F.filter(F.split(cleaned(c), " "), lambda w: w != ""), one), " ")


def by_family(family: Column, name: Column, value: Column) -> Column:
    """A reading cleaned by its field's family: figures of numbers and amounts, the date in a text, ids without marks, marks as YES or NO."""
    v = F.trim(value)
    figures, plain, low = X.digits(v), F.regexp_replace(v, "[^A-Za-z0-9]", ""), F.lower(v)
    date = F.regexp_extract(F.replace(v, F.lit(" "), F.lit("")), r"([0-9]{1,2}[/.\-][0-9]{1,2}[/.\-][0-9]{2,4})", 1)
    mobile = F.when((F.length(figures) == 12) & figures.startswith("91"), F.substring(figures, 3, 10)).when((F.length(figures) == 11) & figures.startswith("0"), F.substring(figures, 2, 10)).otherwise(figures)
    short = (
        F.when(name == "pan_number", F.upper(plain))
        .when(name == "aadhaar_last_or_id_number", figures)
        .when(name == "mobile_number", mobile)
        .when(name.contains("customer_id") | name.contains("ckyc") | name.isin("agent_code", "branch_code"), plain)
        .otherwise(v)
    )
    return (
        F.when(family.isin("numeric", "amount") & (figures != ""), figures)
        .when(family == "date", F.when(date != "", F.translate(date, ".-", "//")).otherwise(F.replace(v, F.lit(" "), F.lit(""))))
        .when(family == "short_id", short)
        .when((family == "binary_mark") & low.rlike("yes|ha|हाँ|✓|tick|checked"), "YES")
        .when((family == "binary_mark") & low.rlike("no|nahi|नहीं|unchecked"), "NO")
        .when(family.isin("signature_presence", "photo_presence") & (v != ""), "PRESENT")
        .otherwise(v)
    )


def family_confidence(family: Column, name: Column, value: Column, confidence: Column) -> Column:
    """A reading's confidence by what its family asks for: digits, an id's shape, a mobile number's; an empty value has 0."""
    v = F.coalesce(value, F.lit(""))
    lowered = F.when((name == "pan_number") & ~v.rlike("^[A-Z]{5}[0-9]{4}[A-Z]$"), confidence * 0.7).otherwise(confidence)
    lowered = F.when(name.contains("mobile") & ~((F.length(v) == 10) & v.rlike("^[6-9]")), lowered * 0.6).otherwise(lowered)
    return F.when(v == "", 0.0).when(family.isin("numeric", "amount") & ~v.rlike("[0-9]"), F.greatest(F.lit(0.1), confidence * 0.3)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), lowered)))


def extracted(name: Column, text: Column) -> Column:
    """The part of a text that a field wants by its name (name, date, pin, aadhaar, pan), marks at both ends gone."""
    low = F.lower(name)
    t = F.trim(F.regexp_replace(F.regexp_replace(text, r"^[:\-*.]\s*", ""), r"\s*[:\-*.]$", ""))
    first = lambda c, p: F.coalesce(F.nullif(F.regexp_extract(c, f"({p})", 1), F.lit("")), c)
    pan_found = F.regexp_extract(F.upper(t), "([A-Z]{5}[0-9]{4}[A-Z])", 1)
    return F.trim(
        F.when(low.contains("name"), F.regexp_replace(t, r"(?U)[^\w\s.]", ""))
        .when(low.rlike("date|dob"), first(t, r"[0-9\-./]+"))
        .when(low.contains("pin"), first(t, "[0-9]{6}"))
        .when(low.contains("aadhaar"), first(t, "[0-9]{12}"))
        .when(low.contains("pan"), F.when(pan_found != "", pan_found).otherwise(t))
        .otherwise(t)
    )


def value_error(kind: Column, value: Column, pattern: Column) -> Column:
    """Why a value does not fit its field's pattern or, without one, its kind; null if it does. Patterns are met anywhere, kinds at the start."""
    return (
        F.when(pattern.isNotNull(), F.when(~F.rlike(value, pattern), "pattern_mismatch"))
        .when(kind == "date", F.when(~value.rlike(r"^[0-9]{1,2}[/\-.][0-9]{1,2}[/\-.][0-9]{2,4}"), "bad_date"))
        .when(kind == "pincode", F.when(~value.rlike("^[0-9]{6}"), "not_six_digits"))
        .when(kind == "aadhaar", F.when(~value.rlike("^[0-9]{12}"), "not_twelve_digits").when(~X.verhoeff_ok(value), "checksum"))
        .when(kind == "pan", F.when(~F.upper(value).rlike("^[A-Z]{5}[0-9]{4}[A-Z]"), "bad_pan"))
    )


def length_penalty(confidence: Column, value: Column, kind: Column) -> Column:
    """0.30 less where a number's length cannot be right."""
    n = F.length(X.digits(value))
    wrong = ((kind == "mobile") & (n != 10)) | ((kind == "pincode") & (n != 6)) | ((kind == "aadhaar") & (n != 12)) | ((kind == "pan") & (F.length(F.trim(value)) != 10))
    return F.when(wrong, F.greatest(confidence - 0.30, F.lit(0.0))).otherwise(confidence)


def is_name_field(name: Column) -> Column:
    return F.lower(name).rlike(NAME_PARTS)


def box_of(text: Column, width: Column, height: Column) -> Column:
    """array<int> of pixels from a model's box: a list, an object with bbox or bbox_2d, or the first four numbers.

    Values up to 1 are shares of the page, values up to 1000 (on a larger page) thousandths, others pixels; corners are put in order.
    """
    listed = F.from_json(F.regexp_extract(text, r"(\[[^\[\]]*\])", 1), "array<double>")
    loose = F.transform(F.slice(F.regexp_extract_all(text, F.lit(r"(-?[0-9]+\.?[0-9]*)"), 1), 1, 4), lambda x: x.cast("double"))
    b = _once(listed, lambda v: F.when(F.size(v) >= 4, F.slice(v, 1, 4)).otherwise(_once(loose, lambda v: F.when(F.size(v) == 4, v))))
    wide = F.greatest(width, height) > 1000
    scale = lambda top, m: F.when(top <= 1.0, m).when((top <= 1000) & wide, m / 1000).otherwise(F.lit(1.0))
    clip = lambda v, m: F.greatest(F.lit(0), F.least(F.floor(v).cast("int"), m.cast("int")))

    def corners(b: Column, s: Column) -> Column:
        x, y = (F.get(b, F.lit(0)) * s["x"], F.get(b, F.lit(2)) * s["x"]), (F.get(b, F.lit(1)) * s["y"], F.get(b, F.lit(3)) * s["y"])
        return F.array(clip(F.least(*x), width), clip(F.least(*y), height), clip(F.greatest(*x), width), clip(F.greatest(*y), height))

    scales = lambda top: F.struct(scale(top, width).alias("x"), scale(top, height).alias("y"))
    return _once(b, lambda b: F.when(b.isNotNull(), _once(_once(F.array_max(b), scales), lambda s: corners(b, s))))


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def back_mapped(h: Column, b: Column, width: Column, height: Column) -> Column:
    """A box through a 3 x 3 homography (9 numbers, row by row): the corners' hull, rounded outwards, clamped."""

    def point(x: Column, y: Column) -> tuple[Column, Column]:
        at = lambda r: F.get(h, F.lit(3 * r)) * x + F.get(h, F.lit(3 * r + 1)) * y + F.get(h, F.lit(3 * r + 2))
        return at(0) / at(2), at(1) / at(2)

    corners = [point(b[x], b[y]) for x in ("x1", "x2") for y in ("y1", "y2")]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    return F.struct(F.greatest(F.floor(F.least(*xs)), F.lit(0)).alias("x1"), F.greatest(F.floor(F.least(*ys)), F.lit(0)).alias("y1"), F.least(F.ceil(F.greatest(*xs)), width).alias("x2"), F.least(F.ceil(F.greatest(*ys)), height).alias("y2"))


def percent(value: Column, whole: Column) -> Column:
    return F.format_string("%.2f", (value * 100 / whole).cast("double"))
