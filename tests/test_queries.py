"""Every query with SQL gives DuckDB's rows; the others run and keep their schema."""

import decimal
import hashlib
import re
import sys

import duckdb
import pytest

from quillspark.functions import text as X
from quillspark.plans import forms, more, registry  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v):
    if isinstance(v, float):
        return repr(round(v, 9))
    if isinstance(v, decimal.Decimal):
        return str(v.normalize())
    return str(v)


#: Where the views' keys are unique, so that ties have one order.
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_rows_are_those_of_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    cur = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(shown(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert sorted(tuple(shown(r[c]) for c in cols) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_others_run(spark, sf, name):
    df = registry.queries()[name](spark, sf)
    rows = df.collect()
    assert rows and all(any(r[c] is not None for r in rows) for c in df.columns)


def test_entry_without_training_data_operators(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    sys.modules.pop("__spark_entry__", None)
    import __spark_entry__ as e

    assert not any(k.startswith("op") or k == "pipeline" for k in e.queries()) and e.oracle_sql().keys() <= e.queries().keys()
    sys.modules.pop("__spark_entry__", None)


def test_no_query_joins_by_cross_product(spark, sf):
    for name, f in registry.queries().items():
        plan = f(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join Cross" not in plan, name


@pytest.fixture
def with_documents(spark, tmp_path):
    """A folder whose documents are those of SF and the given (doc_id, text, lang)."""

    def add(rows):
        cols = "doc_id long, text string, lang string"
        known = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("CAST(doc_id AS LONG) AS doc_id", "text", "lang")
        known.unionByName(spark.createDataFrame(rows, cols)).write.parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return add


def brute_gibberish(t):
    if t is None or len(t) < 2:
        return True
    rules = (r"[^a-zA-Z0-9\s]+$", r"(.)\1{4,}", "(?i)[bcdfghjklmnpqrstvwxyz]{5,}$", "(?i)[aeiou]{5,}$")
    return any(re.match(x, t) for x in rules) or t.lower() in X.HALLUCINATIONS


def test_gibberish_is_judged_on_every_whole_text(spark, with_documents):
    odd = [None, "", "x", "aaaaa and more", "aaab", "bcdfghjklmnp and words", "bcdfghjklmnpqrst", "?!?!?!?!?!?! word", "?!?!?!?!?!?!?!", "aeiouaeiouae then", "AEIOUAEIOUAEIOU", "Tion", "11111"]
    folder = with_documents([(-1 - k, t, None) for k, t in enumerate(odd)])
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    got = {r.doc_id: r.bad for r in registry.queries()["f10_gibberish"](spark, folder).collect()}
    assert got == {r.doc_id: brute_gibberish(r.text) for r in rows} and len(got) == len(rows)
    assert not got[-6] and got[-4] and got[-1]


def test_texts_of_all_languages_are_cleaned(spark, with_documents):
    odd = [(-1, "Straße «zu» (1/2)", "de"), (-2, " l'été,  déjà ", "fr"), (-3, "nul ¿lang?", None), (-4, None, "de"), (-5, "", None), (-6, "мир — да_1", "ru")]
    folder = with_documents(odd)
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    got = {r.doc_id: r.cleaned for r in registry.queries()["s21_clean_text"](spark, folder).collect()}
    brute = lambda t: re.sub(r"\s+", " ", re.sub(r"[^\w\s/\.(\)-]", "", t or "")).strip().upper()
    assert got == {r.doc_id: hashlib.md5(brute(r.text).encode()).hexdigest() for r in rows} and len(got) == len(rows)
    assert {r.lang for r in rows} >= {"de", "en", "es", "fr", "ru", None}


def test_every_region_has_its_place(spark):
    out = registry.queries()["t3_surest_first"](spark, SF).collect()
    assert len(out) == registry.regions(spark, SF).count() > 100 and min(r.place for r in out) == 1
