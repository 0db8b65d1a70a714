"""Column functions that read HTML tables and JSON of models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bare(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"\s+", " "))


def table_rows(html: Column) -> Column:
    """The cells of each row: array<array<string>>, tags stripped."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), 1), bare))


def pairs(html: Column) -> Column:
    """array<struct<label, value, row_type>> of a table's rows: header for one cell, empty where the value is, else standard."""

    def one(c: Column) -> Column:
        n = F.size(c)
        label = F.when(n >= 3, F.element_at(c, 2)).otherwise(F.element_at(c, 1))
        value = F.when(n >= 3, F.element_at(c, 3)).when(n == 2, F.element_at(c, 2)).otherwise(F.lit(""))
        return F.struct(label.alias("label"), value.alias("value"), F.when(n == 1, "header").when(value == "", "empty").otherwise("standard").alias("row_type"))

    return F.transform(F.filter(table_rows(html), lambda c: F.size(c) > 0), one)


def _joined_text(cell: Column) -> Column:
    """A cell's texts, each trimmed, one after the other."""
    return F.trim(F.regexp_replace(cell, r"(?s)\s*<[^>]*>\s*", ""))


def _raw_rows(html: Column) -> Column:
    cells = lambda r: F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), 1)
    return F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1), lambda r: F.transform(cells(r), _joined_text))


def _loose_cells(html: Column) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<t[hd][^>]*>(.*?)</t[hd]>"), 1), lambda c: F.trim(F.regexp_replace(c, r"(?s)<[^>]+>", "")))


def _row(label: Column, value: Column, structure: str) -> Column:
    return F.struct(label.alias("label"), value.alias("value"), F.lit(structure).alias("structure"))


def _steps(cells: Column, width: int) -> Column:
    """Where groups of `width` cells begin; a group that is cut short counts only for width 3, where none is."""
    n = F.floor(F.size(cells) / width).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: i * width)).otherwise(F.array().cast("array<int>"))


_NO_ROWS = "array<struct<label:string,value:string,structure:string>>"


def pairs_by_columns(html: Column) -> Column:
    """array<struct<label, value, structure>> of a table that is read by the number of its first row's cells.

    Three or more: a number, label and value, rows with a value; rows of two cells are label and value. Two: label and
    value, or a label alone. One: every cell of over two characters is a label. Text that is no markup has none; markup
    without a table is read cell by cell, in threes if their number allows, else in pairs.
    """
    at = lambda c, k: F.get(c, F.lit(k))
    rows, loose = _raw_rows(html), F.filter(F.transform(_loose_cells(html), lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))), lambda c: c != "")
    none = F.array().cast(_NO_ROWS)
    width = F.size(F.get(rows, F.lit(0)))
    three = F.transform(F.filter(rows, lambda c: ((F.size(c) >= 3) & (at(c, 2) != "")) | ((F.size(c) == 2) & (at(c, 1) != ""))), lambda c: F.when(F.size(c) >= 3, _row(at(c, 1), at(c, 2), "3col_value_only")).otherwise(_row(at(c, 0), at(c, 1), "2col_fallback")))
    two = F.transform(F.filter(rows, lambda c: (F.size(c) >= 2) & (at(c, 0) != "")), lambda c: F.when(at(c, 1) != "", _row(at(c, 0), at(c, 1), "2col")).otherwise(_row(at(c, 0), F.lit(""), "label_only")))
    one = F.transform(F.filter(F.flatten(rows), lambda c: F.length(c) > 2), lambda c: _row(c, F.lit(""), "1col"))
    threes = F.transform(_steps(loose, 3), lambda i: _row(F.get(loose, i + 1), F.get(loose, i + 2), "3col_regex"))
    twos = F.transform(_steps(loose, 2), lambda i: _row(F.get(loose, i), F.get(loose, i + 1), "2col_regex"))
    in_table = F.when(F.size(rows) == 0, none).when(width >= 3, three).when(width == 2, two).otherwise(one)
    return F.when(~F.coalesce(F.ltrim(html).startswith("<"), F.lit(False)), none).when(html.rlike(r"(?i)<table\b"), in_table).when(F.size(loose) % 3 == 0, threes).otherwise(twos)


def pairs_with_one_side(html: Column) -> Column:
    """array<struct<label, value>>: the first two cells of each row if either has text, a lone cell as a label; without a table, cells in pairs."""
    at = lambda c, k: F.get(c, F.lit(k))
    pair = lambda x, y: F.struct(x.alias("label"), y.alias("value"))
    rows, loose = _raw_rows(html), _loose_cells(html)
    kept = F.filter(rows, lambda c: ((F.size(c) >= 2) & ((at(c, 0) != "") | (at(c, 1) != ""))) | ((F.size(c) == 1) & (at(c, 0) != "")))
    of_rows = F.transform(kept, lambda c: pair(at(c, 0), F.coalesce(at(c, 1), F.lit(""))))
    of_cells = F.filter(F.transform(_steps(loose, 2), lambda i: pair(F.get(loose, i), F.get(loose, i + 1))), lambda p: (p["label"] != "") | (p["value"] != ""))
    none = F.array().cast("array<struct<label:string,value:string>>")
    return F.when(~F.coalesce(F.ltrim(html).startswith("<"), F.lit(False)), none).when(html.rlike(r"(?i)<table\b"), of_rows).otherwise(of_cells)


def title(html: Column) -> Column:
    return bare(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def json_map(text: Column) -> Column:
    """A model's answer as a map: fences off, cut to the outer braces, trailing commas gone; null if it is no object."""
    t = F.regexp_replace(text, r"```(json)?", "")
    t = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    plain = F.from_json(t, "map<string,string>")
    mended = F.from_json(F.regexp_replace(t, r",\s*([}\]])", "$1"), "map<string,string>")
    return F.when(t != "", F.coalesce(plain, mended))


def answer(text: Column) -> Column:
    """struct(value, confidence) of a reasoning answer: a flat object, else a quoted value with confidence 0.4."""
    flat = F.from_json(F.regexp_extract(text, r"(?s)(\{[^{}]*\})", 1), "value string, confidence double")
    quoted = F.regexp_extract(text, r'"value"\s*:\s*"([^"]*)"', 1)
    return F.when(flat["value"].isNotNull(), F.struct(F.trim(flat["value"]).alias("value"), F.coalesce(flat["confidence"], F.lit(0.5)).alias("confidence"))).when(quoted != "", F.struct(F.trim(quoted).alias("value"), F.lit(0.4).alias("confidence")))


def key_values(text: Column) -> Column:
    """array<struct<key, value>> of lines with : = -> or →."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^[^:=→]+?(:|=|->|→).+$"))
    part = lambda x, k: F.trim(F.regexp_extract(x, r"^([^:=→]+?)\s*(?::|=|->|→)\s*(.+)$", k))
    return F.transform(lines, lambda x: F.struct(part(x, 1).alias("key"), part(x, 2).alias("value")))
