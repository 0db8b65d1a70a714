"""Operators without SQL, sources and streams against brute force."""

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark.functions import repair
from quillspark.operators import dataset, fuse, label, match, resolve, score
from quillspark.operators.fixed import MOST_ROWS, fixed_rows, page_by_page, pairs
from quillspark.sources import files
from quillspark.sources.desk import Desk
from quillspark.streaming import review

BOX = "doc_id long, page_num int, label int, det_id long, score double, x1 double, y1 double, x2 double, y2 double"


@pytest.fixture(scope="module")
def boxes(spark):
    r = np.random.default_rng(3)
    rows = []
    for k in range(120):
        x, y = r.uniform(0, 60, 2)
        rows.append((k % 2, 1, k % 3 % 2, k, float(round(r.uniform(), 3)), float(x), float(y), float(x + r.uniform(10, 40)), float(y + r.uniform(10, 40))))
    return spark.createDataFrame(rows, BOX)


def overlap(a, b):
    w, h = min(a.x2, b.x2) - max(a.x1, b.x1), min(a.y2, b.y2) - max(a.y1, b.y1)
    i = max(w, 0) * max(h, 0)
    return i / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - i)


def test_nms(boxes):
    rows = sorted(boxes.collect(), key=lambda r: (-r.score, r.det_id))
    kept = []
    for r in rows:
        if not any((k.doc_id, k.page_num, k.label) == (r.doc_id, r.page_num, r.label) and overlap(k, r) > 0.4 for k in kept):
            kept.append(r)
    assert sorted(r.det_id for r in fuse.nms(boxes, 0.4).collect()) == sorted(r.det_id for r in kept)


def test_box_fusion_keeps_mass(boxes):
    out = fuse.fuse_boxes(boxes, 0.4).collect()
    assert sum(r.n for r in out) == boxes.count() and all(r.x1 < r.x2 for r in out)
    alone = boxes.where("det_id = 5")
    assert fuse.fuse_boxes(alone).first().x1 == alone.first().x1 and fuse.fuse_boxes(boxes.limit(0)).count() == 0


def test_widened_boxes_stay_apart(spark):
    rows = [(1, 1, 1, 0.0, 0.0, 10.0, 10.0), (1, 1, 2, 11.0, 0.0, 20.0, 10.0), (1, 1, 3, 0.0, 10.5, 10.0, 20.0)]
    out = label.widened(spark.createDataFrame(rows, "doc_id int, page_num int, det_id int, x1 double, y1 double, x2 double, y2 double"), 0.2).collect()
    for i, a in enumerate(out):
        for b in out[:i]:
            assert not (min(a.x2, b.x2) > max(a.x1, b.x1) and min(a.y2, b.y2) > max(a.y1, b.y1))


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_pages_are_whole_in_batches_of_any_size(spark, small_batches):
    want = {(d, p): n for n, (d, p) in enumerate(((d, p) for d in ("a", None, "b") for p in (1, 2, None)), 1)} | {("big", 1): 40}
    df = spark.createDataFrame([k for k, n in want.items() for _ in range(n)], "doc_id string, page_num int")

    def count(rows, page):
        assert len(set(page)) == page[-1] + 1
        g = rows.assign(page=page, n=1).groupby("page").agg({"doc_id": "first", "page_num": "first", "n": "sum"})
        return g.assign(page_num=g.page_num.astype("Int32"))

    got = page_by_page(df, count, "doc_id string, page_num int, n long").collect()
    assert {(r.doc_id, r.page_num): r.n for r in got} == want and len(got) == len(want)
    blocks = list(pairs(np.array([0, 2, 5]), np.array([2, 2, 1 << 21])))
    assert len(blocks) == 2 and sum(len(i) for i, _ in blocks) == 2 + (1 << 21) - 5 and blocks[0][1].tolist() == [0, 1]


PLACED = "doc_id long, page_num int, det_id long, kind string, label int, score double, x1 double, y1 double, x2 double, y2 double"


@pytest.fixture(scope="module")
def placed(spark):
    """Pages of 1 to 30 boxes in the unit square, and one page of 200 of one label."""
    r, rows = np.random.default_rng(8), []
    for d, n in [(d, int(r.integers(1, 31))) for d in range(12)] + [(99, 200)]:
        for _ in range(n):
            x, y = r.uniform(0, 0.8, 2).round(2)
            rows.append((d, 1, len(rows), ("title", "table", "chart")[int(r.integers(3))], 0 if d == 99 else int(r.integers(2)), round(r.uniform(), 1), float(x), float(y), float(x + r.uniform(0.02, 0.2)), float(y + r.uniform(0.02, 0.2))))
    return spark.createDataFrame(rows, PLACED)


def pages_of(rows, *keys):
    out = {}
    for r in rows:
        out.setdefault(tuple(r[k] for k in ("doc_id", "page_num", *keys)), []).append(r)
    return out.values()


def runs_of_pages(df):
    return "MapInPandas" in plan(df) and "FlatMapGroupsInPandas" not in plan(df)


def test_titles_go_to_the_nearest(placed, small_batches):
    want = []
    for page in pages_of(placed.collect()):
        titles, used = [t for t in page if t.kind == "title"], set()
        for kind in ("table", "chart"):
            found = []
            for o in (o for o in page if o.kind == kind):
                for t in titles:
                    dy, dx = max(o.y1 - t.y2, t.y1 - o.y2, 0.0), max(o.x1 - t.x2, t.x1 - o.x2, 0.0)
                    share = max(0.0, min(o.x2, t.x2) - max(o.x1, t.x1)) * max(0.0, min(o.y2, t.y2) - max(o.y1, t.y1)) / max((t.x2 - t.x1) * (t.y2 - t.y1), 1e-9)
                    found.append(((dy + dx / 2 + 0.01) * 10 if kind == "chart" and share > 0.9 else 0.0 if share > 0.25 else dy + dx / 2, o.det_id, t.det_id))
            taken = set()
            for d, o, t in sorted(found):
                if d < 0.1 and o not in taken and t not in used:
                    taken.add(o)
                    used.add(t)
                    want.append((o, t, d))
    out = label.titles_of(placed.select("doc_id", "page_num", "det_id", "kind", "x1", "y1", "x2", "y2"))
    assert runs_of_pages(out) and sorted((r.det_id, r.title_id, r.distance) for r in out.collect()) == sorted(want) and len(want) > 50


def test_titles_join_the_boxes_beside_them(placed, small_batches):
    want = {}
    for page in pages_of(placed.orderBy("det_id").collect()):
        titles, free = [t for t in page if t.kind == "title"], set()
        free = {t.det_id for t in titles}
        for o in (o for o in page if o.kind == "chart"):
            far = {t.det_id: min(abs(t.y2 - o.y1), abs(o.y2 - t.y1)) + min(abs(t.x1 - o.x1), abs(t.x1 + t.x2 - o.x1 - o.x2) / 2) / 2 for t in titles}
            least = min(far.values(), default=9.0)
            for t in titles:
                if min(t.x2, o.x2) > max(t.x1, o.x1) and min(t.y2, o.y2) > max(t.y1, o.y1):
                    far[t.det_id] = min(0.09, least / 1.5)
            near = min((far[t] for t in free), default=9.0)
            mine = [t for t in titles if t.det_id in free and near <= 0.1 and far[t.det_id] <= min(0.1, near * 1.5)]
            free -= {t.det_id for t in mine}
            hull = [o, *mine]
            want[o.det_id] = (min(b.x1 for b in hull), min(b.y1 for b in hull), max(b.x2 for b in hull), max(b.y2 for b in hull), [t.det_id for t in mine])
    out = label.merged_with_titles(placed.select("doc_id", "page_num", "det_id", "kind", "x1", "y1", "x2", "y2"), delta=1.5)
    assert runs_of_pages(out) and {r.det_id: (r.x1, r.y1, r.x2, r.y2, r.titles) for r in out.collect()} == want and any(len(w[4]) > 1 for w in want.values())


def test_labels_choose_for_all_pages_of_a_run(spark, small_batches):
    rows = []
    for d in range(9):
        rows += [(d, 1, 10 * d + k, t, c, x, y, x + 40, y + 20) for k, (t, c, x, y) in enumerate([("Name", 0.9, 0, 0), ("Full Name", 0.2, 0, 300), (f"R{d} Kumar", 0.9, 60, 0), ("Age", 0.9, 0, 40), (f"{30 + d}", 0.9, 60, 40), ("x", 0.9, 45, 0), (None, 0.9, 45, 0)][: 7 - d % 3])]
    df = spark.createDataFrame(rows, "doc_id int, page_num int, region_id long, text string, confidence double, x1 int, y1 int, x2 int, y2 int")
    out = label.label_values(df, spark.createDataFrame([(1, "name", "name"), (2, "age", "age")], "ord int, field string, pattern string"))
    got = {(r.doc_id, r.field): (r.label_id, r.value) for r in out.collect()}
    assert runs_of_pages(out) and got == {(d, f): v for d in range(9) for f, v in (("name", (10 * d, f"R{d} Kumar")), ("age", (10 * d + 3, f"{30 + d}")))}


def test_widening_is_that_of_all_pairs(placed, small_batches):
    want = {}
    for page in pages_of(placed.orderBy("det_id").collect()):
        old = [[b.x1, b.y1, b.x2, b.y2] for b in page]
        new = [[a - (c - a) * 0.1, b - (d - b) * 0.1, c + (c - a) * 0.1, d + (d - b) * 0.1] for a, b, c, d in old]
        meet = lambda p, q: min(p[2], q[2]) > max(p[0], q[0]) and min(p[3], q[3]) > max(p[1], q[1])
        for j in range(len(new)):
            for i in range(j):
                if meet(new[i], new[j]) and not meet(old[i], old[j]):
                    for side, other in ((3, 1), (1, 3), (2, 0), (0, 2)):
                        if side == 0 or (old[j][other] >= old[i][side] if side > 1 else old[j][other] <= old[i][side]):
                            f, g = (min, max) if side > 1 else (max, min)
                            new[i][side] = f(new[i][side], old[j][other])
                            new[j][other] = g(new[j][other], new[i][side])
                            break
        want |= {b.det_id: tuple(n) for b, n in zip(page, new, strict=True)}
    out = label.widened(placed.select("doc_id", "page_num", "det_id", "x1", "y1", "x2", "y2"))
    got = {r.det_id: (r.x1, r.y1, r.x2, r.y2) for r in out.collect()}
    assert runs_of_pages(out) and got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=0, atol=1e-12) for k in want)


def test_fusion_is_that_of_one_box_after_the_other(placed, small_batches):
    want = {}
    for group in pages_of(sorted(placed.collect(), key=lambda r: (-r.score, r.det_id)), "label"):
        fused = []
        for r in group:
            box = np.array([r.x1, r.y1, r.x2, r.y2])
            i = [max(min(f[0][2], box[2]) - max(f[0][0], box[0]), 0) * max(min(f[0][3], box[3]) - max(f[0][1], box[1]), 0) for f in fused]
            area = lambda b: (b[2] - b[0]) * (b[3] - b[1])
            iou = [s / max(area(f[0]) + area(box) - s, 1e-9) for s, f in zip(i, fused, strict=True)]
            if iou and max(iou) > 0.2:
                f = fused[int(np.argmax(iou))]
                f[0], f[1], f[2] = (f[0] * f[1] + box * r.score) / (f[1] + r.score) if f[1] + r.score else f[0], f[1] + r.score, f[2] + 1
            else:
                fused.append([box, r.score, 1])
        want |= {(r.doc_id, r.label, k): (f[2], *f[0].round(9)) for k, f in enumerate(fused)}
    out = fuse.fuse_boxes(placed.drop("kind"), 0.2)
    got = {(r.doc_id, r.label, r.cluster): (r.n, *np.round((r.x1, r.y1, r.x2, r.y2), 9)) for r in out.collect()}
    assert runs_of_pages(out) and got == want and max(w[0] for w in want.values()) > 2


def test_suppression_is_that_of_one_box_after_the_other(placed, small_batches):
    kept = []
    for group in pages_of(sorted(placed.collect(), key=lambda r: (-r.score, r.det_id))):
        mine = []
        for r in group:
            if not any(k.label == r.label and overlap(k, r) > 0.3 for k in mine):
                mine.append(r)
        kept += mine
    out = fuse.nms(placed.drop("kind"), 0.3)
    assert runs_of_pages(out) and sorted(r.det_id for r in out.collect()) == sorted(r.det_id for r in kept) and len(kept) < placed.count()
    apart = fuse.nms(placed.drop("kind").withColumn("label", F.lit(1)), 0.3).count()
    assert fuse.nms(placed.drop("kind"), 0.3, True).count() == apart


def test_labels_take_each_value_once(spark):
    rows = [(1, 1, 1, "Name", 0.9, 0, 0, 50, 20), (1, 1, 2, "Rajesh", 0.9, 60, 0, 120, 20), (1, 1, 3, "Age", 0.9, 0, 40, 50, 60), (1, 1, 4, "30", 0.9, 60, 40, 90, 60), (1, 1, 5, "Surname", 0.8, 0, 2, 50, 22)]
    df = spark.createDataFrame(rows, "doc_id int, page_num int, region_id long, text string, confidence double, x1 int, y1 int, x2 int, y2 int")
    out = {r.field: r.value for r in label.label_values(df, spark.createDataFrame([(1, "name", "name"), (2, "age", "age"), (3, "surname", "surname")], "ord int, field string, pattern string")).collect()}
    assert out["name"] == "Rajesh" and out["age"] == "30" and len(set(out.values())) == len(out)


def test_resolver_decisions(spark):
    lex = spark.createDataFrame([(1, "person_full", "HARISH MENON", 50), (2, "person_full", "HARIS MENON", 5), (3, "person_full", "LEELA NAIR", 9), (4, "plan_name", "NEW BEEMA GOLD", 7), (5, "person_token", "LEELA", 3)], "entry_id long, category string, text string, frequency long")
    asked = [(1, "nominee_name", "Harish Menon"), (2, "nominee_name", "LEELA NA1R"), (3, "plan_name", "NEW BEEMA GOL"), (4, "nominee_name", "##"), (5, "nominee_name", None), (6, "remarks", "LEELA NAIR"), (7, "nominee_name", "XQ ZW"), (8, "first_name", "leela")]
    q = spark.createDataFrame(asked, "qid long, field_name string, raw_text string")
    top, d = resolve.resolve(q, lex)
    got = {r.qid: r for r in d.collect()}
    assert {k: r.method for k, r in got.items()} == {1: "lexicon_exact", 2: "lexicon_exact", 3: "lexicon_fuzzy_accept", 4: "empty_query", 5: "no_lexicon_route", 6: "no_lexicon_route", 7: "no_candidate", 8: "lexicon_exact"}
    assert got[3].resolved_text == "NEW BEEMA GOLD" and got[7].resolved_text == "XQ ZW" and got[7].confidence == 0 and got[7].category == "person_full" and got[6].category == "" and got[8].category == "person_token"
    assert top.where("rank > 5").count() == 0 and resolve.resolve(q.limit(0), lex)[1].count() == 0 and resolve.resolve(q, lex.limit(0))[1].where("accepted").count() == 0


def test_resolver_scores_are_those_of_all_pairs(spark):
    """Every pair scored in plain Python: postings by length and token number, and the bound, lose none at the least score."""
    r = np.random.default_rng(5)
    word = lambda: "".join(r.choice(list("ABEIKS"), r.integers(2, 7)))
    names = sorted({" ".join(word() for _ in range(r.integers(1, 4))) for _ in range(60)})
    asked = [names[k][:2] + names[k][3:] if k % 2 else " ".join(word() for _ in range(r.integers(1, 3))) for k in range(60)]
    lex = spark.createDataFrame([(k, "person_token", n, k * k) for k, n in enumerate(names)], "entry_id long, category string, text string, frequency long")
    q = resolve.indexed(spark.createDataFrame([(k, ["person_token"], n) for k, n in enumerate(asked)], "qid long, categories array<string>, raw_text string"), "raw_text")
    e = resolve.indexed(lex, "text")
    got = {(x.qid, x.entry_id): x.score for x in resolve.scored(resolve.candidates(q, e), q, e).collect()}
    ratio = lambda a, b: SequenceMatcher(None, a, b).ratio()
    jac = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0.0
    want = {}
    for x in q.collect():
        for y in e.collect():
            char, token = ratio(x.norm, y.norm), jac(x.toks, y.toks)
            aligned = sum(ratio(a, b) for a, b in zip(x.toks, y.toks, strict=True)) / len(x.toks) if len(x.toks) == len(y.toks) else 0.0
            if len(x.toks) == len(y.toks) == 1:
                token, aligned = max(token, char), max(aligned, char)
            same = next((k for k in range(4) if x.norm[k : k + 1] != y.norm[k : k + 1] or not x.norm[k : k + 1]), 4)
            s = 0.34 * char + 0.2 * token + 0.15 * jac(x.grams, y.grams) + 0.14 * aligned + 0.1 * jac(x.codes, y.codes) + 0.07 * same / 4 + min(np.log1p(y.frequency) / 20, 0.05) + 0.15 * (x.norm == y.norm)
            if s >= 0.55:
                want[x.qid, y.entry_id] = min(s, 1.0)
    assert sorted(got) == sorted(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want) and len(want) > 40


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def asked_often(spark):
    names = ["ABEL ONE", "ABLE TWO", "CAIN", "ZED ONE"]
    lex = spark.createDataFrame([(k, "person_full", n, 1) for k, n in enumerate(names)], "entry_id long, category string, text string, frequency long")
    return spark.createDataFrame([(k, "nominee_name", ("Abel 0ne", "XONEX", "", "Abel")[k % 4]) for k in range(40)], "qid long, field_name string, raw_text string"), lex


def test_postings_are_those_of_distinct_texts_and_stay_off_the_driver(spark):
    q, lex = asked_often(spark)
    q, e = resolve.indexed(q.withColumn("categories", F.array(F.lit("person_full"))), "raw_text"), resolve.indexed(lex, "text")
    found = resolve.candidates(q, e)
    assert "Broadcast" not in plan(found)
    ids = {}
    for r in found.collect():
        ids.setdefault(r.qid, []).append(r.entry_id)
    assert set(ids) == {k for k in range(40) if k % 4 != 2} and all(sorted(ids[k]) == sorted(ids[k % 4]) and len(set(ids[k])) == len(ids[k]) for k in ids)
    assert resolve.texts(resolve.with_text_id(q)).count() == 4


def test_best_candidates_of_one_text_are_the_same_and_stay_off_the_driver(spark):
    q, lex = asked_often(spark)
    top, _ = resolve.resolve(q, lex, 2)
    assert "Broadcast" not in plan(top)
    got = {}
    for r in top.collect():
        got.setdefault(r.qid, {})[r["rank"]] = r.text
    assert got[0][1] == "ABEL ONE" and all(got[k] == got[k % 4] for k in got) and {k for k in range(40) if k % 4 == 0} <= set(got)


def test_decisions_of_one_text_are_the_same_and_postings_stay_off_the_driver(spark):
    q, lex = asked_often(spark)
    _, d = resolve.resolve(q, lex)
    assert "Broadcast" not in plan(d)
    got = {r.qid: tuple(r)[1:] for r in d.collect()}
    assert len(got) == 40 and all(got[k] == got[k % 4] for k in got) and [got[k][-1] for k in (0, 2)] == ["lexicon_exact", "no_lexicon_route"]


def test_resolver_candidates_lose_none(spark):
    """All entries that share a posting, by brute force, when lengths alone are postings."""
    names = ["ABEL ONE", "ABLE TWO", "CAIN", "QQQQQQQQQQQQQQ", "ZED ONE"]
    lex = spark.createDataFrame([(k, "p", n, 1) for k, n in enumerate(names)], "entry_id long, category string, text string, frequency long")
    q = spark.createDataFrame([(k, ["p"], n) for k, n in enumerate(("ABEL", "XONEX", "CANE"))], "qid long, categories array<string>, raw_text string")
    a, b = resolve.indexed(q, "raw_text"), resolve.indexed(lex, "text")
    got = {tuple(r) for r in resolve.candidates(a, b, every_length=True).collect()}
    for x in a.collect():
        for y in b.collect():
            share = x.norm == y.norm or set(x.toks) & set(y.toks) or set(x.codes) & set(y.codes) or set(x.grams) & set(y.grams) or abs(len(x.norm) - len(y.norm)) <= 3
            assert ((x.qid, y.entry_id) in got) == bool(share)


def test_splits_do_not_leak(spark):
    rows = spark.range(500).select((F.col("id") % 37).cast("string").alias("g"), "id")
    for s in (dataset.split_by_group(rows, "g"), dataset.split_exact(rows, "g")):
        assert s.groupBy("g").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0 and s.count() == 500
    assert dataset.split_exact(rows, "g").where("split = 'val'").select("g").distinct().count() == 3


def test_records_that_share_an_id_are_split_one_by_one(spark):
    rows = spark.range(200).select("id", F.concat(F.lit("R"), F.col("id") % 20).alias("name"))
    out = dataset.split_exact(rows, "id", name="name").where("split = 'val'")
    assert out.count() == 20 and out.select("name").distinct().count() <= 3


def test_scores_that_are_equal_but_for_rounding_go_to_the_first_region(spark):
    v = spark.createDataFrame([(1, 1, "f", "ab")], "doc_id int, page_num int, field string, value string")
    r = spark.createDataFrame([(1, 1, 1, "abcd", 0.8932), (1, 1, 2, "abc", 0.6699)], "doc_id int, page_num int, region_id long, text string, confidence double")
    assert 0.7 * 2 / 4 * 0.8932 < 0.7 * 2 / 3 * 0.6699
    assert match.simply_verified(v, r).first().box_region_id == 1


def test_verification_and_tiles_hold_no_regions(spark):
    v = spark.createDataFrame([(1, 1, "f", "ab"), (2, 1, "f", "zz")], "doc_id int, page_num int, field string, value string")
    r = spark.createDataFrame([(1, 1, "abq", 0.5), (1, 1, "abq", 0.9), (1, 1, "ax", 1.0), (1, 1, None, 1.0)], "doc_id int, page_num int, text string, confidence double")
    out = match.verified_values(v, r)
    assert {x.doc_id: round(x.best, 9) for x in out.collect()} == {1: 0.5, 2: 0.0}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate ") == 1
    t = spark.createDataFrame([(1, k, tile, f, x) for k, (tile, f, x) in enumerate([("half_a", "n", "half"), ("tile_b", "n", "own"), ("tile_b", None, "none"), (None, "m", "bare"), ("tile_b", "m", " ")])], "doc_id int, ord int, tile string, field string, value string")
    m = fuse.merge_tiles(t, spark.createDataFrame([("n", "tile_b"), ("n", "tile_b"), (None, "x")], "field string, tile string"))
    assert "Join" not in plan(m) and {(x.field, x.value) for x in m.collect()} == {("n", "own"), (None, "none"), ("m", "bare")}


def test_a_form_of_mean_one_half_is_so_in_any_order(spark):
    f = spark.createDataFrame([(d, "m", "v", c, "Extracted") for d, cs in enumerate([(0.2, 0.5, 0.6, 0.7), (0.7, 0.6, 0.5, 0.2), (0.2, 0.5, 0.6, 0.7), (0.4, None)]) for c in cs], "doc_id int, field_name string, value string, confidence double, category string").coalesce(1)
    out = score.form_results(f, spark.createDataFrame([("m",)], "field_name string")).collect()
    assert {r.doc_id: (r.overall_confidence, r.form_status) for r in out} == {0: (0.5, "Processed"), 1: (0.5, "Processed"), 2: (0.5, "Processed"), 3: (0.4, "Rejected")}
    assert (0.2 + 0.5 + 0.6 + 0.7) / 4 < 0.5


def test_a_box_is_parsed_once(spark):
    df = spark.createDataFrame([("[1, 2, 30, 4]",), ("x 9 8 7 6 5",), ("[1, 2] 3 4",), ("[0.5, 0.1, 1, 0.2]",), ("",), (None,)], "t string").select(repair.box_of(F.col("t"), F.lit(2000), F.lit(2000)).alias("b"))
    assert [r.b for r in df.collect()] == [[2, 4, 60, 8], [14, 12, 18, 16], [2, 4, 6, 8], [1000, 200, 2000, 400], None, None]
    assert plan(df).lower().count("from_json(") <= 1


def test_synthetic_records_are_coherent_and_repeatable(spark):
    ids = spark.range(300)
    a, b = dataset.synthetic_records(ids).collect(), dataset.synthetic_records(ids).collect()
    assert a == b and dataset.synthetic_records(ids, seed=1).collect() != a
    assert all((r.spouse_full_name != "") == r.married and r.sum_assured == 20 * r.premium for r in a)


def test_verified_values_use_matching_blocks(spark):
    texts = ["Rahul Verma", "RAHUL", "verma rahul", "12 Rahool Verma", "nothing", "", "rahul verm"]
    r = spark.createDataFrame([(1, 1, k, t, 0.5 + k / 20) for k, t in enumerate(texts)], "doc_id int, page_num int, region_id long, text string, confidence double")
    values = ["Rahul Verma", "rahul varma", "Q", "other words"]
    v = spark.createDataFrame([(1, 1, f"f{k}", t) for k, t in enumerate(values)] + [(2, 1, "f", "x")], "doc_id int, page_num int, field string, value string")
    got = {(x.doc_id, x.value): x.best for x in match.verified_values(v, r).collect()}

    def alike(a, b):
        a, b = a.lower().strip(), b.lower().strip()
        return 1.0 if a == b else 0.8 * min(len(a), len(b)) / max(len(a), len(b), 1) if a in b or b in a else SequenceMatcher(None, a, b).ratio()

    for t in values:
        assert abs(got[1, t] - max(alike(t, x) * (0.5 + k / 20) for k, x in enumerate(texts))) < 1e-9
    assert got[2, "x"] == 0


def test_titles_merge_into_charts(spark):
    rows = [(1, 1, 1, "chart", 0.1, 0.2, 0.5, 0.6), (1, 1, 2, "title", 0.1, 0.12, 0.4, 0.17), (1, 1, 3, "title", 0.6, 0.9, 0.9, 0.95), (1, 1, 4, "chart", 0.1, 0.15, 0.5, 0.19), (1, 1, 5, "table", 0.1, 0.1, 0.2, 0.2), (1, 2, 6, "chart", 0.0, 0.0, 1.0, 1.0), (1, 3, 7, "chart", 0.2, 0.2, 0.6, 0.6), (1, 3, 8, "title", 0.25, 0.25, 0.3, 0.3), (1, 3, 9, "title", 0.25, 0.5, 0.3, 0.55)]
    df = spark.createDataFrame(rows, "doc_id int, page_num int, det_id int, kind string, x1 double, y1 double, x2 double, y2 double")
    got = {r.det_id: ((r.x1, r.y1, r.x2, r.y2), r.titles) for r in label.merged_with_titles(df).collect()}
    assert got == {1: ((0.1, 0.12, 0.5, 0.6), [2]), 4: ((0.1, 0.15, 0.5, 0.19), []), 6: ((0.0, 0.0, 1.0, 1.0), []), 7: ((0.2, 0.2, 0.6, 0.6), [8, 9])}
    assert label.merged_with_titles(df.limit(0)).count() == 0


def test_vocabulary_is_met_by_sound_or_nearness(spark):
    words = spark.createDataFrame([("Pune",), ("Nashik",), ("Kochi",), ("Cochin",), (None,)], "word string")
    v = spark.createDataFrame([("pune ",), ("Nasik",), ("KOCHIN",), ("Zzz",), ("",), (None,)], "value string")
    got = {r.value: (r.resolved, r.status) for r in label.fuzzy_lookup(v, words).collect()}
    assert got == {"pune ": ("Pune", "verified"), "Nasik": ("Nashik", "verified"), "KOCHIN": ("Kochi", "verified"), "Zzz": ("Zzz", "original"), "": ("", "original"), None: (None, "original")}
    sounds = {"THUMB": "0M", "KNIGHT": "NT", "PHASE": "FS", "SCHOOL": "SKL", "XENON": "SNN", "EDGE": "EJ", "NATION": "NXN", "WHITE": "WT", "CIA": "X", "BOX": "BKS"}
    assert {w: label.metaphone(w) for w in sounds} == sounds


def test_fixed_lists_are_bounded(spark):
    with pytest.raises(ValueError, match="at most"):
        fixed_rows(spark.range(MOST_ROWS + 1))


def test_requested_fields(spark):
    aliases = spark.createDataFrame([(1, "First Name", "first_name", True), (2, "photo", "photo", False)], "ord int, alias string, public_id string, supported boolean")
    q = spark.createDataFrame([(1, "first-name, x", None), (2, None, None), (3, "photo", "surgical25")], "request_id int, fields string, bundle string")
    got = {r.request_id: (r.field_ids, r.unknown) for r in label.requested_fields(q, aliases).collect()}
    assert got == {1: (["first_name"], ["x"]), 2: (["first_name"], []), 3: (["first_name"], [])}


def test_purge_only_when_told(spark, tmp_path):
    (tmp_path / "r").mkdir()
    assert files.purge(spark, str(tmp_path / "r"), str(tmp_path / "none")) == [str(tmp_path / "r")] and (tmp_path / "r").exists()
    files.purge(spark, str(tmp_path / "r"), really=True)
    assert not (tmp_path / "r").exists()


def test_jsonl_and_csv(spark, tmp_path):
    p = str(tmp_path / "rows.jsonl")
    open(p, "w").write('{"id": "a", "n": 1}\n\n{bad\n{"id": "b", "n": null}\n')
    rows = files.read_jsonl(spark, p, "id string, n long")
    assert sorted(r.id for r in rows.collect() if r.id) == ["a", "b"]
    assert files.read_jsonl(spark, str(tmp_path / "none.jsonl"), "id string").count() == 0
    files.write_jsonl(rows.where("id = 'b'"), str(tmp_path / "out"))
    assert '"n":null' in "".join(f.read_text() for f in (tmp_path / "out").glob("part-*"))
    gold = spark.createDataFrame([("x", "Raj, K"), ("y", " "), ("z", None)], "crop_id string, gold_text string")
    files.write_csv(gold, str(tmp_path / "gold"))
    assert [r.gold_text for r in files.read_gold(spark, str(tmp_path / "gold")).collect()] == ["Raj, K"]
    files.write_csv(gold.limit(0), str(tmp_path / "empty"))
    assert not (tmp_path / "empty").exists()


def test_lexicons(spark, tmp_path):
    (tmp_path / "cities.txt").write_text("Pune\n\nDelhi\n")
    (tmp_path / "plans.csv").write_text("value,count\nJeevan,5\nBima,0\n")
    (tmp_path / "banks.json").write_text('["SBI", "PNB"]')
    (tmp_path / "names.json").write_text('{"Raj": 3}')
    got = sorted((r.category, r.text, r.frequency) for r in files.read_lexicons(spark, str(tmp_path)).collect())
    assert got == [("banks", "PNB", 1), ("banks", "SBI", 1), ("cities", "Delhi", 1), ("cities", "Pune", 1), ("names", "Raj", 3), ("plans", "Bima", 1), ("plans", "Jeevan", 5)]
    assert files.read_lexicons(spark, str(tmp_path / "none")).count() == 0


def test_documents_and_renderer(spark, tmp_path):
    for n in ("b.pdf", "a.png", "c.txt"):
        (tmp_path / n).write_bytes(b"x" * 10)
    found = files.read_documents(spark, str(tmp_path))
    assert [r.path.rpartition("/")[2] for r in found.collect()] == ["a.png", "b.pdf"]

    def render(batches):
        for b in batches:
            yield pd.DataFrame({"doc_id": b.path.str.rpartition("/")[2], "page_num": 1, "width": 10, "height": 20, "image": b.content})

    assert files.rendered(found, render).count() == 2 and files.read_documents(spark, str(tmp_path), 1).count() == 1


def test_results_round_trip(spark, tmp_path):
    f = spark.createDataFrame([("d1", 1, "a", "x", 0.5), ("d2", 1, "b", "y", 0.7)], "doc_id string, page_num int, field_name string, value string, confidence double")
    files.write_results(f, str(tmp_path / "r"))
    back = files.read_results(spark, str(tmp_path / "r"), "doc_id string, page_num int, field_name string, value string, confidence double")
    assert sorted((r.doc_id, r.value) for r in back.collect()) == [("d1", "x"), ("d2", "y")]
    assert files.page_spec("2,4-6,5") == [2, 4, 5, 6]


def test_corrections_stream(spark, tmp_path):
    ts = pd.Timestamp("2024-01-01")
    rows = [(k, k % 3, "f", (ts + pd.Timedelta(minutes=(k * 7) % 11)).to_pydatetime(), k) for k in range(30)]
    schema = "event_id long, doc_id long, field_name string, ts timestamp, new_value long"
    df = spark.createDataFrame(rows, schema)
    for part in range(3):
        df.where(f"event_id % 3 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = review.start_latest(stream, str(tmp_path / "t"), str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, review.newest(spark, str(tmp_path / "t")).select("doc_id", "new_value", "edits").collect()))
    assert got == sorted(map(tuple, review.latest(df).select("doc_id", "new_value", "edits").collect()))


def test_majority_and_tiles_on_odd_input(spark):
    v = spark.createDataFrame([("a", 1, "", 0.9), ("a", 2, None, 0.9), ("b", 1, "x", 0.5), ("b", 2, "y", 0.9), ("b", 3, "x", 0.7)], "id string, ord int, value string, confidence double")
    out = fuse.majority_vote(v).collect()
    assert [(r.id, r.value, round(r.confidence, 6)) for r in out] == [("b", "x", round(0.6 * (0.7 + 0.3 * 2 / 3), 6))]
    assert fuse.majority_vote(v.limit(0)).count() == 0


def test_desk(spark, tmp_path):
    d = Desk(spark, str(tmp_path / "desk"))
    assert d.results().count() == 0 and d.log().count() == 0 and d.purge() == []
    d.upload(spark.createDataFrame([("a", "f1"), ("b", "f2"), ("a", "f3")], "doc_id string, path string"))

    def extract(uploads):
        return uploads.select("doc_id", F.lit(1).alias("page_num"), F.lit("name").alias("field_name"), F.col("path").alias("value"), F.lit(0.5).alias("confidence"), F.lit("Needs Review").alias("category"))

    d.process(extract)
    d.process(extract, spark.createDataFrame([("b",)], "doc_id string"))
    assert d.results().count() == 2 and d.to_review().count() == 2 and d.results("b").first().value == "f2"
    d.review(spark.createDataFrame([("a", "name", "Asha", "me")], "doc_id string, field_name string, new_value string, reviewer string"))
    a = d.results("a").first()
    assert (a.value, a.confidence, a.reviewer) == ("Asha", 1.0, "me") and [r.doc_id for r in d.to_review().collect()] == ["b"]
    assert d.log(2).count() == 2 and len(d.purge()) == 4 and d.results().count() == 2
    d.purge(really=True)
    assert d.results().count() == 0


def test_corrections_per_window(spark):
    ts = pd.Timestamp("2024-01-01")
    rows = [("f", (ts + pd.Timedelta(minutes=m)).to_pydatetime()) for m in (0, 9, 10, 25)] + [("g", ts.to_pydatetime())]
    out = review.counts_by_window(spark.createDataFrame(rows, "field_name string, ts timestamp")).collect()
    assert sorted((r.field_name, r.n) for r in out) == [("f", 1), ("f", 1), ("f", 2), ("g", 1)]
