"""Line-first cleaning with DataFrame functions alone (operator 5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as C

#: White space between words.
SPACES = r"[\x20\x09-\x0D]+"
#: Lines of site furniture and notices, in the corpus's languages; a parameter of line_fails.
BOILERPLATE = (
    r"(?i)all rights reserved|copyright (\(c\)|©)|privacy policy|terms of (use|service)|cookie (policy|settings)|enable javascript|(licensed|released) under (the|a|cc) |subscribe to our|sign (in|up) to|click here|lorem ipsum"
    r"|alle rechte vorbehalten|datenschutzerkl|nutzungsbedingungen|cookie-einstellungen|newsletter abonnieren|hier klicken|lizenziert unter"
    r"|todos los derechos reservados|política de (privacidad|cookies)|términos (de uso|y condiciones)|suscríb[ae]te a|haga clic aquí|bajo (la )?licencia"
    r"|tous droits réservés|politique de confidentialité|conditions d.utilisation|gestion des cookies|abonnez-vous|cliquez ici|sous licence"
)
#: Marks between navigation links.
SEPARATORS = "[|»›•]"
#: Marks that prose hardly uses, for a line's share of them.
NOISE = r"[#*$%&|<>!{}=~^\\@_]"
TERMINAL = r"[.!?:;…。！？][\x22\x27”’)\]]*[\x20\x09-\x0D]*$"

MIN_WORDS = 20
REPEAT_WIDTH = 8
MAX_REPEAT_PERCENT = 30
#: A line fails with over this percentage of noise among its characters.
MAX_NOISE_PERCENT = 10
#: A navigation line has this many separators at least.
MIN_SEPARATORS = 2
#: A document fails when the removed lines hold over this percentage of its characters.
MAX_LOST_PERCENT = 50


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def line_fails(line: Column, boilerplate: str = BOILERPLATE) -> Column:
    """Punctuation, navigation and boilerplate rules; a line without words is left alone."""
    size = F.length(line)
    some = line.rlike(r"[^\x20\x09-\x0D]")
    noise = F.size(F.split(line, NOISE)) - 1
    bars = F.size(F.split(line, SEPARATORS)) - 1
    return some & (
        (noise * 100 > size * MAX_NOISE_PERCENT)  # punctuation: a line of marks
        | ~line.rlike(r"[A-Za-z0-9\x80-\x{10FFFF}]")  # punctuation: no letter or digit
        | ((bars >= MIN_SEPARATORS) & ~line.rlike(TERMINAL))  # navigation
        | line.rlike(boilerplate)
    )


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds lines that stay (clean_text), n_lines, n_lines_removed, lost_chars and all_chars to docs' columns.

    Null texts count as empty: clean_text is then "". Names that docs already has are replaced.
    """
    kept_names = [F.col(f"`{c}`") for c in docs.columns if c not in ("clean_text", "n_lines", "n_lines_removed", "lost_chars", "all_chars")]
    lines = F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), "\n")
    all_lines, left = C.free_names(docs.columns, "lines", "kept")
    staged = docs.select(*kept_names, lines.alias(all_lines)).withColumn(left, F.filter(all_lines, lambda x: ~line_fails(x)))
    return (
        staged.withColumn("clean_text", F.array_join(left, "\n"))
        .withColumn("n_lines", F.size(all_lines).cast("long"))
        .withColumn("n_lines_removed", (F.size(all_lines) - F.size(left)).cast("long"))
        .withColumn("all_chars", F.length(F.array_join(all_lines, "")).cast("long"))
        .withColumn("lost_chars", F.col("all_chars") - F.length(F.array_join(left, "")))
        .drop(all_lines, left)
    )


def repeated_words(words: str, width: int = REPEAT_WIDTH) -> list[tuple[str, str]]:
    """Staged columns that count the words of windows found twice or more; the last is n_repeat_words.

    A window is known by its 64-bit hash. Only rows with an equal pair go on to sort (hash, place) and merge the windows'
    stretches: neighbours in that order are equal exactly when a window repeats.
    """
    return [
        ("__h", f"IF(size({words}) >= {width}, transform(sequence(1, size({words}) - {width - 1}), i -> xxhash64(slice({words}, i, {width}))), CAST(array() AS array<bigint>))"),
        ("__s", "IF(size(array_distinct(__h)) < size(__h), array_sort(transform(__h, (x, i) -> struct(x AS h, i AS i))), NULL)"),
        ("__e", "zip_with(__s, slice(__s, 2, size(__s)), (x, y) -> coalesce(x.h = y.h, false))"),
        ("__p", "sort_array(array_compact(zip_with(__s, zip_with(__e, concat(array(false), __e), (a, b) -> coalesce(a, false) OR coalesce(b, false)), (x, f) -> IF(f, x.i, NULL))))"),
        ("n_repeat_words", f"coalesce(aggregate(zip_with(__p, slice(__p, 2, size(__p)), (a, b) -> coalesce(least(b - a, {width}), {width})), 0L, (s, x) -> s + x), 0L)"),
    ]


def judge(docs: DataFrame) -> DataFrame:
    """Base figures, base_failed and kept for each row of docs (doc_id, text), and what line cleaning removed.

    kept: not base_failed, and lines with more than half of the characters stay. Null and empty texts have no words
    and fail. Repeated rows give a row each; an empty table gives none; further columns are not read.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", t.alias("text"))
    df = clean(df).withColumn("__w", words_of(F.col("text")))
    df = df.withColumn("n_words", F.size("__w").cast("long")).withColumn("word_chars", F.length(F.array_join("__w", "")).cast("long"))
    df = df.withColumn("n_symbols", (F.size(F.split("text", "[#*$%&|<>]")) - 1).cast("long"))
    df = df.withColumn("__l", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("n_dup_lines", (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"))
    for name, e in repeated_words("__w"):
        df = df.withColumn(name, F.expr(e))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    df = df.withColumn("base_failed", failed)
    df = df.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= MAX_LOST_PERCENT * F.col("all_chars")))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.col("n_repeat_words").cast("long").alias("n_repeat_words"), "base_failed", "kept", "n_lines", "n_lines_removed", "lost_chars")


def filtered(docs: DataFrame) -> DataFrame:
    """docs' rows that keep half of their characters or more, with their cleaned text; all columns, whatever their names.

    Null texts become empty and stay, as nothing is lost of them; repeated rows are judged alike; an empty table gives none.
    """
    names = docs.columns
    own = C.free_names([], *(f"c{k}" for k in range(len(names))))
    j = clean(docs.select(*(F.col(f"`{c}`").alias(o) for c, o in zip(names, own, strict=True)), "text"))
    ok = 100 * F.col("lost_chars") <= MAX_LOST_PERCENT * F.col("all_chars")
    return j.where(ok).select(*(F.col("clean_text").alias("text") if c == "text" else F.col(o).alias(c) for c, o in zip(names, own, strict=True)))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
k AS (
  SELECT r, list_filter(l, lambda x: NOT (regexp_matches(x, '[^\x20\x09-\x0D]') AND (
      100 * length(regexp_replace(x, '[^#*$%&|<>!{}=~^\\@_]', '', 'g')) > 10 * length(x)
      OR NOT regexp_matches(x, '[A-Za-z0-9\x{80}-\x{10FFFF}]')
      OR (length(regexp_replace(x, '[^|»›•]', '', 'g')) >= 2 AND NOT regexp_matches(x, '[.!?:;…。！？][\x22\x27”’)\]]*[\x20\x09-\x0D]*$'))
      OR regexp_matches(x, '(?i)all rights reserved|copyright (\(c\)|©)|privacy policy|terms of (use|service)|cookie (policy|settings)|enable javascript|(licensed|released) under (the|a|cc) |subscribe to our|sign (in|up) to|click here|lorem ipsum')))) AS kl FROM d),
g AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
p AS (
  SELECT r, count(DISTINCT p) AS n FROM (
    SELECT r, unnest(range(i, i + 8)) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM g) WHERE c > 1)
  GROUP BY r),
f AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(kl) AS BIGINT) AS n_lines_removed,
    CAST(length(array_to_string(l, '')) - coalesce(length(array_to_string(kl, '')), 0) AS BIGINT) AS lost_chars, length(array_to_string(l, '')) AS all_chars
  FROM d JOIN k ON d.r = k.r LEFT JOIN p ON d.r = p.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * lost_chars <= 50 * all_chars AS kept,
  n_lines, n_lines_removed, lost_chars
FROM f
"""
