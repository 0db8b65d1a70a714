"""Column functions on text: cleaning, tokens, similarity, checksums, predicates. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits that recognisers put for letters.
DIGITS = "0123456789"
DIGIT_LETTERS = "OIZEASGTBG"
# Words that mean "no value".
NULL_WORDS = ("", "none", "null", "not found", "n/a", "na", "nil", "-")
# Words kept in capitals.
KEEP_UPPER = ("LIC", "HCL", "TCS", "WIPRO", "ONGC", "SBI", "PNB", "HDFC", "ICICI")
# Known recogniser hallucinations.
HALLUCINATIONS = ("avelandian", "linsularate", "thelasthe", "india", "lhe", "lhe_", "tha", "dhe", "fhe", "tand", "tion", "tion_", "ing", "ing_", "nan", "none", "null")


def collapse(c: Column) -> Column:
    """White space runs as one space, trimmed; null as ''."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def upper_alnum(c: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^A-Za-z0-9/.\-]", ""))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[^0-9]", "")


def name_key(c: Column, keep_digits: bool = False) -> Column:
    """Upper case, digits as the letters they resemble, punctuation as space."""
    u = F.upper(F.coalesce(c, F.lit("")))
    u = u if keep_digits else F.translate(u, DIGITS, DIGIT_LETTERS)
    return F.trim(F.regexp_replace(F.regexp_replace(u, r"[^A-Z0-9& ]", " "), r"\s+", " "))


def tokens(key: Column) -> Column:
    return F.regexp_extract_all(key, F.lit("([A-Z0-9]+)"), 1)


def ngrams(key: Column, n: int = 3) -> Column:
    """The distinct n-grams of a key without its spaces; a key of n characters or fewer is its own gram."""
    k = F.replace(key, F.lit(" "), F.lit(""))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(k) - (n - 1), F.lit(1))), lambda i: F.substring(k, i, F.lit(n)))
    return F.when(F.length(k) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(grams))


def bag(key: Column) -> Column:
    """A key's characters, each with the number of its kind before it: common elements of two bags are common characters."""
    at = F.when(F.length(key) > 0, F.sequence(F.lit(1), F.length(key))).otherwise(F.array().cast("array<int>"))

    def one(i: Column) -> Column:
        c, before = F.substring(key, i, F.lit(1)), F.substring(key, F.lit(1), i)
        return F.concat(c, (F.length(before) - F.length(F.replace(before, c, F.lit("")))).cast("string"))

    return F.transform(at, one)


def soundex(token: Column) -> Column:
    """Like the usual code, but H and W part equal neighbours as vowels do."""
    code = F.translate(F.upper(token), "BFPVCGJKQSXZDTLMNRAEIOUYHW0123456789&", "1111222222223345560000000000000000000")
    squeezed = F.regexp_replace(code, r"(.)\1+", "$1")
    return F.rpad(F.concat(F.substring(F.upper(token), 1, 1), F.replace(F.substring(squeezed, 2, 99), F.lit("0"), F.lit(""))), 4, "0").substr(1, 4)


def jaccard(x: Column, y: Column) -> Column:
    either = F.size(F.array_union(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / either)


def prefix_share(x: Column, y: Column, most: int = 4) -> Column:
    out = F.lit(0)
    for k in range(1, most + 1):
        out = F.when((F.length(x) >= k) & (F.length(y) >= k) & (F.substring(x, 1, k) == F.substring(y, 1, k)), F.lit(k)).otherwise(out)
    return out / F.lit(most)


def smart_title(c: Column) -> Column:
    """Words capitalised; listed names and short words already in capitals stay upper."""

    def one(w: Column) -> Column:
        keep = F.upper(w).isin(*KEEP_UPPER) | ((F.length(w) <= 3) & w.rlike("^[A-Z]+$"))
        return F.when(keep, F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20))))

    return F.array_join(F.transform(F.filter(F.split(collapse(c), " "), lambda w: w != ""), one), " ")


def levenshtein_similarity(x: Column, y: Column) -> Column:
    most = F.greatest(F.length(x), F.length(y))
    return F.when(most == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(x, y) / most)


def cer(predicted: Column, truth: Column) -> Column:
    """Edit distance over the truth's length; of an empty truth 0 if the prediction is empty too, else 1."""
    return F.when(F.length(truth) == 0, F.when(F.length(predicted) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(predicted, truth) / F.length(truth))


def is_missing(c: Column) -> Column:
    return c.isNull() | F.lower(F.trim(c)).isin("", "none", "null", "not found")


def null_tokens(c: Column) -> Column:
    """Trimmed; null where the text is a word for no value."""
    return F.when(~F.lower(F.trim(c)).isin(*NULL_WORDS), F.trim(c))


def script(c: Column) -> Column:
    deva, latin = c.rlike(r"[ऀ-ॿ]"), c.rlike("[A-Za-z]")
    return F.when(deva & latin, "mixed").when(deva, "devanagari").when(latin, "latin").when(c.rlike("[0-9]"), "numeric").otherwise("other")


def looks_handwritten(c: Column) -> Column:
    """Look-alike pairs in the upper-cased text, or odd spaces."""
    return (F.length(c) > 0) & (F.upper(c).rlike("0O|O0|5S|S5|8B|B8") | c.contains("  ") | c.startswith(" ") | c.endswith(" "))


def is_gibberish(c: Column) -> Column:
    """Too short, marks only, five equal characters at the start, five consonants or five vowels and nothing else, or a known token."""
    low = F.lower(c)
    return F.coalesce(
        (F.length(c) < 2) | c.rlike(r"^[^a-zA-Z0-9\s]+$") | c.rlike(r"^(.)\1{4,}") | low.rlike("^[bcdfghjklmnpqrstvwxyz]{5,}$") | low.rlike("^[aeiou]{5,}$") | low.isin(*HALLUCINATIONS),
        F.lit(True),
    )


def top_share(c: Column) -> Column:
    """The most frequent character's share of the text, case folded."""
    low = F.lower(c)
    kinds = F.array_distinct(F.split(low, ""))
    counts = F.transform(kinds, lambda k: F.length(low) - F.length(F.replace(low, k, F.lit(""))))
    return F.when(F.length(c) > 0, F.array_max(counts) / F.length(c)).otherwise(0.0)


def is_repetitive(c: Column, most: float = 0.6) -> Column:
    return (F.length(c) >= 3) & ~c.rlike("[0-9]") & (top_share(c) > most)


def variety(c: Column) -> Column:
    """Distinct characters over characters, spaces left out, case folded."""
    bare = F.replace(F.lower(c), F.lit(" "), F.lit(""))
    return F.size(F.filter(F.array_distinct(F.split(bare, "")), lambda x: x != "")) / F.greatest(F.length(bare), F.lit(1))


def mask_pii(c: Column) -> Column:
    """PAN, then 12-digit numbers, then mobile numbers, as stars."""
    c = F.regexp_replace(c, r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", "**********")
    c = F.regexp_replace(c, r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b", "************")
    return F.regexp_replace(c, r"\b[6-9][0-9]{9}\b", "**********")


def fix_ocr_digits(c: Column) -> Column:
    return F.translate(c, "lOo", "100")


# The checksum's multiplication and permutation tables, as published. The variant's rows differ.
MULTIPLY = ("0123456789", "1234067895", "2340178956", "3401289567", "4012395678", "5987604321", "6598710432", "7659821043", "8765932104", "9876543210")
PERMUTE = ("0123456789", "1576283094", "5803796142", "8916043527", "9453126870", "4286573901", "2793806415", "7046913258")
PERMUTE_VARIANT = ("0123456789", "1725389046", "2419763850", "3850124967", "4392607185", "5068417239", "6931584207", "7286940531")


def verhoeff_ok(c: Column, compat: bool = False) -> Column:
    """Whether a digit string has residue 0; compat takes the variant permutation."""
    table = F.array(*(F.lit(r) for r in (PERMUTE_VARIANT if compat else PERMUTE)))
    times = F.array(*(F.lit(r) for r in MULTIPLY))
    figures = F.reverse(F.filter(F.split(c, ""), lambda x: x != ""))
    placed = F.transform(figures, lambda x, i: F.substring(F.element_at(table, (i % 8 + 1).cast("int")), x.cast("int") + 1, F.lit(1)))
    left = F.aggregate(placed, F.lit("0"), lambda a, p: F.substring(F.element_at(times, a.cast("int") + 1), p.cast("int") + 1, F.lit(1)))
    return F.when(c.rlike("^[0-9]+$"), left == "0").otherwise(False)
