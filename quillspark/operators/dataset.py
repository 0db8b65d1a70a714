"""Training manifests: quality, priorities, splits without leaks, caps, synthetic rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# How much a family's labels are wanted.
FAMILY_PRIORITY = {"long_text": 3.2, "name_text": 3.0, "short_id": 2.8, "date": 2.6, "amount": 2.5, "short_text": 2.3, "numeric": 2.1, "binary_mark": 1.5}


# Limits of crop quality.
BLANK_DARK, BLANK_STD, QC_DARK, QC_EDGES, QC_INK = 0.015, 20.0, 0.01, 20, 0.20
SIDES = ("top", "bottom", "left", "right")


def is_blank(dark_ratio: Column, std: Column) -> Column:
    """A crop with hardly any ink and hardly any contrast. Null metrics count as not blank."""
    return F.coalesce((dark_ratio < BLANK_DARK) & (std < BLANK_STD), F.lit(False))


def qc_status(metrics: DataFrame) -> DataFrame:
    """metrics(is_blank, dark_ratio, edge_var, top_edge, bottom_edge, left_edge, right_edge): flags, score and status of a crop.

    A row without dark_ratio stands for a missing image: score 0. A crop that is known to be blank loses nothing for it.
    """
    tests = {"very_blank": F.col("dark_ratio") < QC_DARK, "low_edge_energy": F.col("edge_var") < QC_EDGES} | {f"ink_{s}_edge": F.col(f"{s}_edge") > QC_INK for s in SIDES}
    costs = {"very_blank": F.when(F.coalesce("is_blank", F.lit(False)), 0.0).otherwise(0.35), "low_edge_energy": F.lit(0.20)}
    score, gone = F.lit(1.0), F.col("dark_ratio").isNull()
    for name, bad in tests.items():
        score = score - F.when(bad, costs.get(name, F.lit(0.10))).otherwise(0.0)
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4)
    flags = F.array_compact(F.array(*(F.when(bad, name) for name, bad in tests.items())))
    out = metrics.withColumn("qc_flags", F.when(gone, F.array(F.lit("missing_image"))).otherwise(flags)).withColumn("qc_score", F.when(gone, 0.0).otherwise(score))
    return out.withColumn("qc_status", F.when(gone, "missing_image").when(F.col("qc_score") < 0.45, "poor").when(F.col("qc_score") < 0.70, "review").otherwise("good"))


def prioritized(rows: DataFrame, cap: int = 40) -> DataFrame:
    """rows(id, field_family, qc_score, qc_status, is_blank): up to `cap` rows of each family by priority, then id.

    The cap is the feature: a worklist for people. The rank filter runs before the shuffle as a group limit.
    """
    base = F.lit(1.0)
    for f, p in FAMILY_PRIORITY.items():
        base = F.when(F.col("field_family") == f, p).otherwise(base)
    score = base * (0.6 + 0.4 * F.col("qc_score")) + F.when(F.col("field_family").isin("long_text", "name_text"), 0.20).otherwise(0.0) + F.when(F.col("qc_status") == "review", 0.10).otherwise(0.0)
    r = rows.where(~F.col("is_blank")).withColumn("priority_score", F.round(score, 4))
    w = Window.partitionBy("field_family").orderBy(F.desc("priority_score"), "id")
    return r.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap)


def first_of_each(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    w = Window.partitionBy(by).orderBy(order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def pick(m: int, *key: object) -> Column:
    """A number under m that the key decides: the first 8 hexadecimal digits of its MD5, the same in any engine."""
    parts = [k if isinstance(k, Column) else F.lit(str(k)) for k in key]
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts)).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(m))


def split_by_group(rows: DataFrame, group: str, seed: int = 42, percent: int = 10) -> DataFrame:
    """Adds split, train or val, by a hash of the group: no group is in both, and no sort or collection is needed."""
    return rows.withColumn("split", F.when(pick(100, seed, F.col(group)) < percent, "val").otherwise("train"))


def split_exact(rows: DataFrame, group: str, seed: int = 42, percent: int = 10, name: str | None = None) -> DataFrame:
    """As split_by_group, but val has max(1, percent of the groups): those with the least hashes, found by a top-n.

    The hash is that of the group, or of its `name`, which groups may share.
    """
    h = pick(1 << 32, seed, F.col(name or group))
    groups = rows.select(*dict.fromkeys((group, name or group))).distinct().withColumn("h", h)
    n = max(1, groups.count() * percent // 100)
    val = groups.orderBy("h", name or group, group).limit(n).select(group, F.lit("val").alias("v"))
    return rows.join(val, group, "left").withColumn("split", F.coalesce("v", F.lit("train"))).drop("v")


def synthetic_records(ids: DataFrame, seed: int = 42) -> DataFrame:
    """A coherent record for each row of ids(id): gender decides the name, marital status the spouse, city the pin code, income the premium and sum.

    Every value is a function of the record number and the seed, so any part can be made again on any machine. The id has
    five digits; from 100,000 on the last ones go, and records share it.
    """
    h = lambda k, m: pick(m, seed, k, F.col("id")).cast("int")
    one = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), i + 1)
    men, women, last = ("Rajesh", "Amit", "Suresh", "Vikram"), ("Priya", "Sunita", "Kavita", "Meena"), ("Kumar", "Sharma", "Patel", "Singh", "Reddy")
    cities, pins = ("Mumbai", "Delhi", "Pune", "Chennai"), ("400001", "110001", "411001", "600001")
    r = ids.select(F.col("id").cast("long").alias("id")).withColumn("gender", F.when(h(1, 2) == 0, "Male").otherwise("Female")).withColumn("married", h(2, 3) > 0)
    r = r.withColumn("last_name", one(last, h(3, 5))).withColumn("first_name", F.when(F.col("gender") == "Male", one(men, h(4, 4))).otherwise(one(women, h(4, 4))))
    r = r.withColumn("spouse_full_name", F.when(F.col("married"), F.concat_ws(" ", F.when(F.col("gender") == "Male", one(women, h(5, 4))).otherwise(one(men, h(5, 4))), F.col("last_name"))).otherwise(""))
    r = r.withColumn("c", h(6, 4)).withColumn("address_city", one(cities, F.col("c"))).withColumn("address_pincode", one(pins, F.col("c"))).drop("c")
    r = r.withColumn("annual_income", (h(7, 46) + 3) * 50_000).withColumn("premium", (F.col("annual_income") * 0.06).cast("int")).withColumn("sum_assured", F.col("premium") * 20)
    return r.withColumn("record_id", F.concat(F.lit("REC_"), F.lpad((F.col("id") + 1).cast("string"), 5, "0"))).withColumn("date_of_birth", F.date_format(F.date_add(F.lit("1955-01-01").cast("date"), h(8, 16_000)), "dd/MM/yyyy"))


def crops_of(records: DataFrame, names: list[str], *more: str) -> DataFrame:
    """One row per record and field: crop id, field, text, and further columns of the record."""
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("field_name"), F.col(n).cast("string").alias("target_text")) for n in names))).alias("f")
    return records.select("record_id", *more, pairs).select(F.concat_ws("__", "record_id", "f.field_name").alias("id"), "record_id", *more, "f.field_name", "f.target_text")


def pages_of(records: DataFrame, layout: dict[str, list[str]]) -> DataFrame:
    """One row per record and page type with a map of the page's labels; layout is a fixed form's."""
    rows = F.explode(F.array(*(F.struct(F.lit(p).alias("page_type"), F.create_map(*(x for n in names for x in (F.lit(n), F.col(n).cast("string")))).alias("labels")) for p, names in layout.items()))).alias("p")
    return records.select("record_id", rows).select("record_id", "p.page_type", "p.labels")


def mutated(texts: DataFrame, text: str, seed: int = 7) -> DataFrame:
    """Adds mutated: a character dropped, doubled or swapped with its look-alike digit, by a hash of the row's id."""
    n = F.length(text)
    at = F.pmod(pick(1 << 32, seed, F.col("id")), F.greatest(n, F.lit(1))).cast("int")
    left, mid, right = F.substring(F.col(text), F.lit(1), at), F.substring(F.col(text), at + 1, F.lit(1)), F.substring(F.col(text), at + 2, n)
    kind = pick(3, seed + 1, F.col("id"))
    return texts.withColumn("mutated", F.when(kind == 0, F.concat(left, right)).when(kind == 1, F.concat(left, mid, mid, right)).otherwise(F.concat(left, F.translate(mid, "OISB", "0158"), right)))


# Parts of made-up form texts.
BANKS = ("SBIN", "HDFC", "ICIC", "PUNB", "BARB")
STREETS = ("MG Road", "Station Road", "Main Street", "Park Lane", "Temple Road")
AREAS = ("Andheri", "Kothrud", "Dadar", "Adyar", "Karol Bagh")
NAMES = ("Rajesh Kumar", "Sunita Sharma", "Amit Patel", "Meena Reddy", "Vikram Singh")
RELATIONS = ("Spouse", "Son", "Daughter", "Father", "Mother")


def taxonomy_texts(ids: DataFrame, seed: int = 42) -> DataFrame:
    """ids(id, field_type): adds text, made up by its type: Name, PAN, Date, Mobile, Address, Amount, Numeric, IFSC, Relationship; else UNKNOWN.

    Every part is decided by the seed and the id, so a row can be made again anywhere.
    """
    h = lambda k, m: pick(m, seed, k, F.col("id")).cast("int")
    one = lambda xs, k: F.element_at(F.array(*map(F.lit, xs)), h(k, len(xs)) + 1)
    digits = lambda k, n: F.lpad(h(k, 10**n).cast("string"), n, "0")
    letters = lambda k, n: F.concat(*(F.char(h(k + j, 26) + 65) for j in range(n)))
    name = one(NAMES, 1)
    year = F.when(h(2, 10) < 7, h(3, 56) + 1950).otherwise(h(4, 3) + 2024)
    mark = one(("/", "-", "."), 5)
    amount = h(6, 9_900_001) + 100_000
    texts = {
        "Name": F.when(h(7, 3) == 0, F.upper(name)).when(h(7, 3) == 1, F.lower(name)).otherwise(name),
        "PAN": F.concat(letters(10, 5), digits(20, 4), letters(30, 1)),
        "Date": F.concat(F.lpad((h(8, 28) + 1).cast("string"), 2, "0"), mark, F.lpad((h(9, 12) + 1).cast("string"), 2, "0"), mark, year.cast("string")),
        "Mobile": F.concat((h(11, 4) + 6).cast("string"), digits(12, 9)),
        "Address": F.concat_ws(", ", (h(13, 999) + 1).cast("string"), one(STREETS, 14), one(AREAS, 15)),
        "Amount": F.when(h(16, 10) < 3, F.format_number(amount, 0)).otherwise(amount.cast("string")),
        "Numeric": (h(17, 99) + 1).cast("string"),
        "IFSC": F.concat(one(BANKS, 18), F.lit("0"), digits(19, 6)),
        "Relationship": one(RELATIONS, 21),
    }
    out = F.lit("UNKNOWN")
    for kind, text in texts.items():
        out = F.when(F.col("field_type") == kind, text).otherwise(out)
    return ids.withColumn("text", out)
