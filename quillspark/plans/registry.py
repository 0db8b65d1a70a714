"""All queries of the engine's own operators, by name, and DuckDB SQL for the same rows.

Scores are shown as whole millionths, so that two engines' roundings agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fields as V
from ..functions import geometry as G
from ..functions import parse as P
from ..functions import text as X
from ..operators import dataset, fuse, match, resolve, score
from ..sources import files
from ..streaming import review
from .views import pick_sql, residue_sql, view, with_views

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = with_views(sql)
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def e6(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c * 1_000_000).cast("long")


def e9(c: Column | str) -> Column:
    """Billionths: means of a few four-digit shares have no ties there."""
    return F.round((F.col(c) if isinstance(c, str) else c) * 1_000_000_000).cast("long")


def teacher(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v_teacher").withColumn("confidence", F.col("confidence_bp") / 10000)


def regions(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v_region").withColumn("confidence", F.col("confidence_bp") / 10000).withColumn("rbox", G.box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))


def templates(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v_template").withColumn("fbox", G.box(F.col("fx1"), F.col("fy1"), F.col("fx2"), F.col("fy2"))).select("ford", "fname", "page_num", "fbox")


def form_fields(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v_field").withColumn("confidence", F.col("confidence_bp") / 10000)


NORM_SQL = r"""n AS (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM v_teacher),
m AS (SELECT *, replace(t, ' ', '') AS tight, regexp_replace(t, '[^0-9]', '', 'g') AS figures, upper(regexp_replace(t, '[^A-Za-z0-9/.\-]', '', 'g')) AS ident, replace(upper(t), '.', '') AS mark,
  trim(regexp_replace(translate(t, '|_', '  '), '\s+', ' ', 'g')) AS words FROM n),
r AS (SELECT *, CASE field_family
  WHEN 'date' THEN regexp_matches(tight, '^[0-9]{2}[/\-.][0-9]{2}[/\-.][0-9]{4}$')
  WHEN 'amount' THEN regexp_matches(replace(tight, ',', ''), '^[0-9]{1,12}$')
  WHEN 'numeric' THEN figures <> '' WHEN 'short_id' THEN regexp_matches(ident, '^[A-Z]{5}[0-9]{4}[A-Z]$')
  WHEN 'name_text' THEN regexp_matches(words, '^[A-Za-z .''-/]+$') ELSE mark IN ('Y','YES','✓','/','TRUE','N','NO','X','FALSE') END AS valid FROM m),
s AS (SELECT *, CASE field_family
  WHEN 'date' THEN CASE WHEN valid THEN translate(tight, '-.', '//') ELSE t END
  WHEN 'amount' THEN CASE WHEN valid THEN replace(tight, ',', '') ELSE t END
  WHEN 'numeric' THEN CASE WHEN valid THEN figures ELSE t END WHEN 'short_id' THEN ident WHEN 'name_text' THEN words
  ELSE CASE WHEN mark IN ('Y','YES','✓','/','TRUE') THEN 'YES' WHEN valid THEN 'NO' ELSE t END END AS canonical,
 CASE field_family WHEN 'date' THEN CASE WHEN valid THEN 98 ELSE 20 END WHEN 'amount' THEN CASE WHEN valid THEN 97 ELSE 20 END
  WHEN 'numeric' THEN CASE WHEN valid THEN 96 ELSE 15 END WHEN 'short_id' THEN CASE WHEN valid THEN 99 ELSE 15 END
  WHEN 'name_text' THEN CASE WHEN valid THEN 90 ELSE 55 END ELSE CASE WHEN valid THEN 98 ELSE 15 END END AS score FROM r)"""


@query("s1_normalize_field_value", f"WITH {NORM_SQL} SELECT ord, canonical, valid, CAST(score * 10000 AS BIGINT) AS score_e6 FROM s")
def s1(spark, sf):
    t = teacher(spark, sf).withColumn("n", V.normalize(F.col("field_family"), F.col("field_name"), F.col("text")))
    return t.select("ord", "n.canonical", "n.valid", e6("n.score").alias("score_e6"))


@query(
    "fu1_weak_label_acceptance",
    f"""WITH {NORM_SQL}, c AS (SELECT *, 6500 * score + 35 * confidence_bp AS comb, row_number() OVER (PARTITION BY id ORDER BY 6500 * score + 35 * confidence_bp DESC, ord) AS rn, upper(trim(canonical)) AS k FROM s),
 b AS (SELECT x.*, EXISTS (SELECT 1 FROM c y WHERE y.id = x.id AND y.rn > 1 AND y.k = x.k) AS consensus FROM c x WHERE x.rn = 1),
 f AS (SELECT *, comb + CASE WHEN consensus THEN 80000 ELSE 0 END AS sc FROM b)
 SELECT id, field_name, field_family, model AS teacher_model, canonical AS canonical_text, CAST(sc AS BIGINT) AS acceptance_e6, consensus FROM f
 WHERE valid AND sc >= CASE field_family WHEN 'binary_mark' THEN 700000 WHEN 'name_text' THEN 800000 ELSE 780000 END""",
)
def fu1(spark, sf):
    out = fuse.accept_weak_labels(teacher(spark, sf))
    return out.select("id", "field_name", "field_family", "teacher_model", "canonical_text", e6("acceptance_score").alias("acceptance_e6"), "consensus")


@query(
    "fu2_majority_vote",
    """WITH g AS (SELECT id, text AS value, count(*) AS n, min(ord) AS first, avg(confidence_bp / 10000.0) AS mean FROM v_teacher WHERE text <> '' GROUP BY id, text),
 r AS (SELECT *, sum(n) OVER (PARTITION BY id) AS votes, row_number() OVER (PARTITION BY id ORDER BY n DESC, first) AS rn FROM g)
 SELECT id, value, CAST(votes AS BIGINT) AS votes, CAST(round(least(1.0, mean * (0.7 + 0.3 * n / votes)) * CASE WHEN n / votes < 0.5 THEN 0.5 ELSE 1.0 END * 1e6) AS BIGINT) AS confidence_e6 FROM r WHERE rn = 1""",
)
def fu2(spark, sf):
    v = fuse.majority_vote(teacher(spark, sf).withColumnRenamed("text", "value"))
    return v.select("id", "value", "votes", e6("confidence").alias("confidence_e6"))


@query(
    "fu3_two_model_consensus",
    r"""WITH p AS (SELECT a.id, a.field_name, a.text AS p, b.text AS q, a.confidence_bp / 10000.0 AS pc, b.confidence_bp / 10000.0 AS qc, lower(trim(a.text)) AS a, lower(trim(b.text)) AS b
  FROM v_teacher a JOIN v_teacher b ON a.id = b.id AND b.ord = a.ord + 2500),
 d AS (SELECT *, regexp_replace(a, '[^0-9]', '', 'g') AS da, regexp_replace(b, '[^0-9]', '', 'g') AS db, greatest(pc, qc) AS top, 1 - levenshtein(a, b) / CAST(greatest(length(a), length(b)) AS DOUBLE) AS sim FROM p)
 SELECT id, CASE WHEN a = b THEN 'full_agreement' WHEN replace(a, ' ', '') = replace(b, ' ', '') THEN 'agree_no_space' WHEN da <> '' AND da = db THEN 'numeric_agree' WHEN sim > 0.7 THEN 'partial_agree' ELSE 'disagree' END AS kind,
  CASE WHEN a = b OR replace(a, ' ', '') = replace(b, ' ', '') THEN p WHEN da <> '' AND da = db THEN CASE WHEN field_name = 'annual_income' THEN da ELSE p END WHEN pc >= qc THEN a ELSE b END AS value,
  CAST(round(1e6 * CASE WHEN a = b THEN least(1.0, top * 1.1) WHEN replace(a, ' ', '') = replace(b, ' ', '') THEN top * 1.05 WHEN da <> '' AND da = db THEN top * 0.95 WHEN sim > 0.7 THEN top * (0.5 + 0.5 * sim) ELSE top * 0.6 END) AS BIGINT) AS confidence_e6, pc_ord AS ord
 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pc, qc, p, q) AS pc_ord FROM d)""",
)
def fu3(spark, sf):
    from pyspark.sql.window import Window

    t = teacher(spark, sf)
    b = t.select("id", (F.col("ord") - 2500).alias("ord"), F.col("text").alias("q"), F.col("confidence").alias("qc"))
    m = t.select("id", "ord", "field_name", F.col("text").alias("p"), F.col("confidence").alias("pc")).join(b, ["id", "ord"])
    m = m.withColumn("c", fuse.consensus(F.col("p"), F.col("q"), F.col("pc"), F.col("qc"), F.col("field_name")))
    w = Window.partitionBy("id").orderBy("pc", "qc", "p", "q")
    return m.select("id", "c.kind", "c.value", e6("c.confidence").alias("confidence_e6"), F.row_number().over(w).cast("long").alias("ord"))


@query(
    "fu4_tile_merge",
    """WITH t AS (SELECT l_orderkey AS doc_id, (l_linenumber * 1000003 + l_partkey) * 10007 + l_suppkey AS ord, CASE l_linenumber % 4 WHEN 0 THEN 'half_top' WHEN 1 THEN 'tile_r0_c1' WHEN 2 THEN 'tile_r2_c0' ELSE 'other' END AS tile,
   CASE l_suppkey % 2 WHEN 0 THEN 'First' ELSE 'City' END AS field, l_returnflag AS value FROM lineitem),
 s AS (SELECT *, CASE WHEN tile LIKE 'half%' THEN 300 WHEN tile LIKE 'tile%' THEN 200 ELSE 100 END + CASE WHEN (field = 'First' AND tile IN ('half_top', 'tile_r0_c1')) OR (field = 'City' AND tile = 'tile_r2_c0') THEN 500 ELSE 0 END + length(trim(value)) AS p FROM t WHERE trim(value) <> '')
 SELECT doc_id, field, trim(value) AS value FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY p DESC, ord) AS rn FROM s) WHERE rn = 1""",
)
def fu4(spark, sf):
    n = F.col("l_linenumber") % 4
    t = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), ((F.col("l_linenumber") * 1000003 + F.col("l_partkey")) * 10007 + F.col("l_suppkey")).alias("ord"), F.when(n == 0, "half_top").when(n == 1, "tile_r0_c1").when(n == 2, "tile_r2_c0").otherwise("other").alias("tile"), F.when(F.col("l_suppkey") % 2 == 0, "First").otherwise("City").alias("field"), F.col("l_returnflag").alias("value"))
    near = spark.createDataFrame([("First", "half_top"), ("First", "tile_r0_c1"), ("City", "tile_r2_c0")], "field string, tile string")
    return fuse.merge_tiles(t, near)


@query("fu6_weighted_box_fusion")
def fu6(spark, sf):
    d = detections(spark, sf)
    out = fuse.fuse_boxes(d, 0.3)
    return out.select("doc_id", "page_num", "label", "cluster", "n", e6("score").alias("score_e6"), e6("x1").alias("x1_e6"))


@query(
    "fu7_nms",
    """WITH RECURSIVE d AS (SELECT doc_id, page_num, region_id % 4 AS label, region_id AS det_id, {'a': CAST(x1 AS DOUBLE), 'b': CAST(y1 AS DOUBLE), 'c': CAST(x2 AS DOUBLE), 'd': CAST(y2 AS DOUBLE), 'i': region_id} AS box, row_number() OVER (PARTITION BY doc_id, page_num, region_id % 4 ORDER BY confidence_bp DESC, region_id) AS k FROM v_region),
 w AS (SELECT doc_id, page_num, label, k, [box] AS kept FROM d WHERE k = 1
  UNION ALL SELECT d.doc_id, d.page_num, d.label, d.k, CASE WHEN len(list_filter(list_transform(w.kept, lambda q: {'s': greatest(least(q.c, d.box.c) - greatest(q.a, d.box.a), 0) * greatest(least(q.d, d.box.d) - greatest(q.b, d.box.b), 0), 't': (q.c - q.a) * (q.d - q.b) + (d.box.c - d.box.a) * (d.box.d - d.box.b)}), lambda z: z.s / greatest(z.t - z.s, 1e-9) > 0.3)) = 0 THEN list_append(w.kept, d.box) ELSE w.kept END
   FROM w JOIN d ON d.doc_id = w.doc_id AND d.page_num = w.page_num AND d.label = w.label AND d.k = w.k + 1),
 l AS (SELECT doc_id, page_num, label, arg_max(kept, k) AS kept FROM w GROUP BY 1, 2, 3) SELECT doc_id, page_num, label, unnest(kept).i AS det_id FROM l""",
)
def fu7(spark, sf):
    return fuse.nms(detections(spark, sf), 0.3).select("doc_id", "page_num", "label", "det_id")


def detections(spark, sf):
    r = regions(spark, sf)
    return r.select("doc_id", "page_num", (F.col("region_id") % 4).cast("int").alias("label"), F.col("region_id").alias("det_id"), F.col("confidence").alias("score"), *(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")))


@query(
    "fu8_region_dedup",
    """SELECT region_id FROM (SELECT region_id, row_number() OVER (PARTITION BY doc_id, page_num, lower(substr(text, 1, 30)), y1 // 20, x1 // 20 ORDER BY region_id) AS rn FROM v_region) WHERE rn = 1""",
)
def fu8(spark, sf):
    return match.dedup_regions(regions(spark, sf)).select("region_id")


@query(
    "fu9_stable_zone",
    """WITH z AS (SELECT DISTINCT r.doc_id, t.page_num, t.fname, fx1 AS lx1, fy1 AS ly1, fx2 AS lx2, fy2 AS ly2, greatest(fx1 - 100, 0) AS sx1, greatest(fy1 - 90, 0) AS sy1, least(fx2 + 120, 1100) AS sx2, least(fy2 + 60, 1400) AS sy2 FROM v_template t JOIN v_region r ON r.page_num = t.page_num),
 c AS (SELECT z.doc_id, z.fname, quantile_cont((x1 + x2) / 2.0, 0.5) AS mx, quantile_cont((y1 + y2) / 2.0, 0.5) AS my, quantile_cont(x2 - x1, 0.75) AS pw, quantile_cont(y2 - y1, 0.75) AS ph, max(x2) - min(x1) AS uw, max(y2) - min(y1) AS uh
  FROM z JOIN v_region r ON r.doc_id = z.doc_id AND r.page_num = z.page_num WHERE x1 >= sx1 AND x2 <= sx2 AND y1 >= sy1 AND y2 <= sy2 GROUP BY z.doc_id, z.fname),
 a AS (SELECT z.*, mx, my, pw, ph, uw, uh, greatest(1, lx2 - lx1) AS lw, greatest(1, ly2 - ly1) AS lh FROM z LEFT JOIN c ON z.doc_id = c.doc_id AND z.fname = c.fname),
 b AS (SELECT *, CASE WHEN mx IS NULL THEN (lx1 + lx2) / 2.0 ELSE 0.7 * mx + 0.3 * ((lx1 + lx2) / 2.0) END AS cx, CASE WHEN my IS NULL THEN (ly1 + ly2) / 2.0 ELSE 0.75 * my + 0.25 * ((ly1 + ly2) / 2.0) END AS cy,
  CASE WHEN mx IS NULL THEN greatest(60, CAST(round_even(lw * CAST(1.05 AS DOUBLE), 0) AS INT)) ELSE CAST(round_even(greatest(60.0, greatest(uw, 1) + 48.0, pw + 36.0, lw * CAST(0.92 AS DOUBLE)), 0) AS INT) END AS w0,
  CASE WHEN mx IS NULL THEN greatest(30, CAST(round_even(lh * CAST(1.2 AS DOUBLE), 0) AS INT)) ELSE CAST(round_even(greatest(30.0, greatest(uh, 1) + 28.0, ph + 24.0, lh * CAST(1.18 AS DOUBLE)), 0) AS INT) END AS h0,
  greatest(sy1, ly1 - CAST(round_even(lh * CAST(0.45 AS DOUBLE), 0) AS INT)) AS top, least(sy2, ly2 + CAST(round_even(lh * CAST(0.55 AS DOUBLE), 0) AS INT)) AS bottom FROM a),
 d AS (SELECT *, least(w0, greatest(1, sx2 - sx1)) AS w, least(h0, greatest(1, bottom - top)) AS h FROM b),
 e AS (SELECT *, greatest(sx1, least(sx2 - w, CAST(round_even(CAST(cx AS DOUBLE) - w / 2.0, 0) AS INT))) AS nx, greatest(top, least(bottom - h, CAST(round_even(CAST(cy AS DOUBLE) - h / 2.0, 0) AS INT))) AS ny FROM d)
 SELECT doc_id, fname, nx AS x1, ny AS y1, nx + w AS x2, ny + h AS y2 FROM e""",
)
def fu9(spark, sf):
    r, t = regions(spark, sf), view(spark, sf, "v_template")
    side = lambda c, d, f, m: f(F.col(c) + d, F.lit(m))
    search = [side("fx1", -100, F.greatest, 0).alias("sx1"), side("fy1", -90, F.greatest, 0).alias("sy1"), side("fx2", 120, F.least, 1100).alias("sx2"), side("fy2", 60, F.least, 1400).alias("sy2")]
    own = [F.col(f"f{c}").alias(f"l{c}") for c in ("x1", "y1", "x2", "y2")]
    z = r.select("doc_id", "page_num").distinct().join(t, "page_num").select("doc_id", "page_num", "fname", *own, *search, F.lit(60).alias("min_w"), F.lit(30).alias("min_h"))
    inside = r.join(z, ["doc_id", "page_num"]).where("x1 >= sx1 AND x2 <= sx2 AND y1 >= sy1 AND y2 <= sy2").select("doc_id", "fname", "x1", "y1", "x2", "y2")
    return fuse.stable_zone(z, inside, ["doc_id", "fname"], 1100, 1400)


@query(
    "fu10_escalation_override",
    """WITH a AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS value, CAST(floor(o_totalprice) AS BIGINT) % 1000 AS c FROM orders),
 b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderstatus END AS value, CAST(floor(o_totalprice) AS BIGINT) % 997 AS c FROM orders WHERE o_orderkey % 5 <> 0)
 SELECT a.k, CASE WHEN coalesce(b.value, '') <> '' AND (a.value = '' OR b.c > a.c) THEN b.value ELSE a.value END AS value, CASE WHEN coalesce(b.value, '') <> '' AND (a.value = '' OR b.c > a.c) THEN b.c ELSE a.c END AS confidence,
  coalesce(coalesce(b.value, '') <> '' AND (a.value = '' OR b.c > a.c), false) AS replaced FROM a LEFT JOIN b ON a.k = b.k""",
)
def fu10(spark, sf):
    o = table(spark, sf, "orders")
    k, total = F.col("o_orderkey"), F.floor("o_totalprice").cast("long")
    a = o.select(k.alias("k"), F.when(k % 3 == 0, "").otherwise(F.col("o_orderpriority")).alias("value"), (total % 1000).alias("confidence"))
    b = o.where(k % 5 != 0).select(k.alias("k"), F.when(k % 4 == 0, "").otherwise(F.col("o_orderstatus")).alias("value"), (total % 997).alias("confidence"))
    return fuse.escalate(a, b, ["k"])


@query(
    "fu12_manifest_merge",
    """SELECT tier, count(*) AS n, count(quality) AS with_quality FROM (SELECT 'gold' AS tier, quality FROM labels UNION ALL SELECT 'weak', NULL FROM documents UNION ALL SELECT 'synthetic', NULL FROM conversations) GROUP BY tier""",
)
def fu12(spark, sf):
    m = fuse.merge_manifests(gold=table(spark, sf, "labels"), weak=table(spark, sf, "documents").select("doc_id"), synthetic=table(spark, sf, "conversations").select("conv_id"))
    return m.groupBy("tier").agg(F.count("*").alias("n"), F.count("quality").alias("with_quality"))


SPATIAL_SQL = """p AS (SELECT r.doc_id, r.page_num, t.fname, r.region_id, greatest(least(x2, fx2) - greatest(x1, fx1), 0) * greatest(least(y2, fy2) - greatest(y1, fy1), 0) AS shared,
  (x2 - x1) * (y2 - y1) AS ra, (fx2 - fx1) * (fy2 - fy1) AS fa,
  sqrt(pow((((x1 + x2) / 2.0) - ((fx1 + fx2) / 2.0)) / 1100, 2) + pow((((y1 + y2) / 2.0) - ((fy1 + fy2) / 2.0)) / 1400, 2)) AS dist FROM v_region r JOIN v_template t ON r.page_num = t.page_num),
q AS (SELECT *, shared / CAST(greatest(ra, 1) AS DOUBLE) AS overlap, shared / CAST(greatest(least(ra, fa), 1) AS DOUBLE) AS share FROM p),
s AS (SELECT *, CASE WHEN overlap > 0.4 THEN dist - 0.5 * share WHEN dist < 0.05 THEN dist END AS score FROM q),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_num, fname ORDER BY score, region_id) AS rn FROM s WHERE score IS NOT NULL) WHERE rn = 1 AND (overlap > 0.3 OR score < 0.05))"""


@query("j1_spatial_best_match", f"WITH {SPATIAL_SQL} SELECT doc_id, page_num, fname, region_id, CAST(round(1e6 * score) AS BIGINT) AS score_e6 FROM m")
def j1(spark, sf):
    m = match.spatial_match(regions(spark, sf), templates(spark, sf), 1100, 1400)
    return m.select("doc_id", "page_num", "fname", "region_id", e6("score").alias("score_e6"))


@query(
    "j2_fallback_match",
    f"""WITH first AS (SELECT * FROM v_region WHERE region_id % 3 = 0), {SPATIAL_SQL.replace("FROM v_region r JOIN", "FROM first r JOIN")},
 few AS (SELECT doc_id, page_num FROM v_region GROUP BY doc_id, page_num HAVING count(*) FILTER (WHERE region_id % 3 = 0) < 6),
 o AS (SELECT r.doc_id, r.page_num, t.fname, r.region_id, greatest(least(x2, fx2) - greatest(x1, fx1), 0) * greatest(least(y2, fy2) - greatest(y1, fy1), 0) / CAST(greatest((x2 - x1) * (y2 - y1), 1) AS DOUBLE) AS overlap,
   sqrt(pow((((x1 + x2) / 2.0) - ((fx1 + fx2) / 2.0)) / 1100, 2) + pow((((y1 + y2) / 2.0) - ((fy1 + fy2) / 2.0)) / 1400, 2)) AS dist FROM v_region r JOIN v_template t ON r.page_num = t.page_num JOIN few ON r.doc_id = few.doc_id AND r.page_num = few.page_num),
 f AS (SELECT o.*, o.dist - 0.35 * o.overlap AS score FROM o LEFT JOIN m ON o.doc_id = m.doc_id AND o.page_num = m.page_num AND o.fname = m.fname WHERE m.fname IS NULL AND (o.overlap > 0.25 OR o.dist < 0.035))
 SELECT doc_id, page_num, fname, region_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_num, fname ORDER BY score, region_id) AS rn FROM f) WHERE rn = 1 AND (overlap > 0.3 OR score < 0.05)""",
)
def j2(spark, sf):
    r, t = regions(spark, sf), templates(spark, sf)
    first = r.where("region_id % 3 = 0")  # the cleaned page's regions; all are those of the page as it was
    return match.fallback_match(first, r, t, match.spatial_match(first, t, 1100, 1400), 1100, 1400).select("doc_id", "page_num", "fname", "region_id")


@query("j4_value_verification")
def j4(spark, sf):
    r = regions(spark, sf)
    v = r.select("doc_id", "page_num").distinct().select("doc_id", "page_num", F.lit("name").alias("field"), F.concat(F.lit("F"), (F.col("doc_id") % 97).cast("string")).alias("value"))
    return match.verified_values(v, r).select("doc_id", "page_num", e6("best").alias("best_e6"), "verified", e6("confidence").alias("confidence_e6"))


LABELS = [(1, "name", "proposer_name"), (2, "pan", "pan_number"), (3, "age", "age_years"), (4, "brass", "metal"), (5, "steel", "metal"), (6, "anodized", "finish"), (7, "o", "any")]


@query(
    "j11_label_router",
    "WITH l AS (SELECT DISTINCT p_type AS label FROM part), k AS (SELECT * FROM (VALUES " + ", ".join(map(str, LABELS)) + ") t(ord, pattern, field)) SELECT label, field FROM (SELECT label, field, row_number() OVER (PARTITION BY label ORDER BY ord NULLS LAST) AS rn FROM l LEFT JOIN k ON contains(lower(label), pattern)) WHERE rn = 1",
)
def j11(spark, sf):
    labels = table(spark, sf, "part").select(F.col("p_type").alias("label")).distinct()
    return match.label_routes(labels, spark.createDataFrame(LABELS, "ord int, pattern string, field string"))


@query("w6_next_in_order", "SELECT region_id, lead(text) OVER (PARTITION BY doc_id, page_num ORDER BY y1 // 20, x1, region_id) AS next_text FROM v_region")
def w6(spark, sf):
    return match.next_in_order(regions(spark, sf)).select("region_id", "next_text")


@query("w5_reading_order", "SELECT region_id, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY y1 // 20, x1, region_id) AS place FROM v_region")
def w5(spark, sf):
    return match.reading_order(regions(spark, sf)).select("region_id", F.col("place").cast("long").alias("place"))


@query(
    "w10_pairs_by_two",
    """WITH o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY y1 // 20, x1, region_id) - 1 AS k FROM v_region)
 SELECT doc_id, page_num, k // 2 AS pair, max(CASE WHEN k % 2 = 0 THEN text END) AS label, max(CASE WHEN k % 2 = 1 THEN text END) AS value, min(confidence_bp) AS confidence_bp FROM o GROUP BY doc_id, page_num, k // 2 HAVING count(*) = 2""",
)
def w10(spark, sf):
    return match.pairs_by_two(regions(spark, sf)).select("doc_id", "page_num", F.col("pair").cast("long").alias("pair"), "label", "value", F.round(F.col("confidence") * 10000).cast("long").alias("confidence_bp"))


@query(
    "w3_rows_by_gap",
    """WITH RECURSIVE o AS (SELECT doc_id, page_num, region_id, y1, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY y1, x1, region_id) AS k FROM v_region),
 w AS (SELECT doc_id, page_num, region_id, k, y1 AS anchor, 0 AS row_no FROM o WHERE k = 1
  UNION ALL SELECT o.doc_id, o.page_num, o.region_id, o.k, CASE WHEN o.y1 - w.anchor > 30 THEN o.y1 ELSE w.anchor END, CASE WHEN o.y1 - w.anchor > 30 THEN w.row_no + 1 ELSE w.row_no END FROM w JOIN o ON o.doc_id = w.doc_id AND o.page_num = w.page_num AND o.k = w.k + 1)
 SELECT region_id, row_no FROM w""",
)
def w3(spark, sf):
    return match.rows_by_gap(regions(spark, sf)).select("region_id", "row_no")


@query(
    "j22_contained_box_anti_join",
    """SELECT a.region_id FROM v_region a WHERE NOT EXISTS (SELECT 1 FROM v_region b WHERE a.doc_id = b.doc_id AND a.page_num = b.page_num AND a.region_id <> b.region_id AND b.x1 <= a.x1 AND b.y1 <= a.y1 AND b.x2 >= a.x2 AND b.y2 >= a.y2
  AND ((b.x2 - b.x1) * (b.y2 - b.y1) > (a.x2 - a.x1) * (a.y2 - a.y1) OR ((b.x2 - b.x1) * (b.y2 - b.y1) = (a.x2 - a.x1) * (a.y2 - a.y1) AND b.region_id < a.region_id)))""",
)
def j22(spark, sf):
    return match.drop_contained(regions(spark, sf)).select("region_id")


ZONES = [("z1", 0.0, 0.0, 0.5, 0.5), ("z2", 0.4, 0.3, 0.9, 0.8)]


@query(
    "f6_zone_window",
    "WITH z AS (SELECT * FROM (VALUES " + ", ".join(map(str, ZONES)) + """) t(zone, zx1, zy1, zx2, zy2)), c AS (SELECT *, (x1 + x2) / 2.0 / 1100 AS cx, (y1 + y2) / 2.0 / 1400 AS cy FROM v_region WHERE confidence_bp >= 5000 AND NOT regexp_matches(text, '^[0-9]{1,3}$'))
 SELECT doc_id, page_num, zone, region_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_num, zone ORDER BY confidence_bp DESC, region_id) AS rn FROM c JOIN z ON cx BETWEEN zx1 AND zx2 AND cy BETWEEN zy1 AND zy2) WHERE rn = 1""",
)
def f6(spark, sf):
    z = spark.createDataFrame(ZONES, "zone string, zx1 double, zy1 double, zx2 double, zy2 double")
    return match.in_zones(regions(spark, sf), F.broadcast(z), 1100, 1400).select("doc_id", "page_num", "zone", "region_id")


SIGNATURES = [(1, "a", "the "), (1, "a", "and "), (2, "b", "der "), (2, "b", "und "), (2, "b", "die "), (3, "c", "les "), (3, "c", "que "), (4, "d", "el "), (4, "d", "los ")]


@query(
    "a18_page_classifier",
    "WITH s AS (SELECT * FROM (VALUES " + ", ".join(map(str, SIGNATURES)) + """) t(ord, page_type, sig)), n AS (SELECT doc_id, ord, page_type, count(sig) AS n FROM documents LEFT JOIN s ON contains(lower(text), sig) GROUP BY doc_id, ord, page_type)
 SELECT doc_id, CASE WHEN n >= 2 THEN page_type END AS page_type, n AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, ord) AS rn FROM n) WHERE rn = 1""",
)
def a18(spark, sf):
    return match.page_class(table(spark, sf, "documents"), spark.createDataFrame(SIGNATURES, "ord int, page_type string, sig string"))


@query(
    "j14_name_bridge",
    """WITH b AS (SELECT * FROM (VALUES ('Proposer_PAN', 'pan'), ('Sum_Assured', 'money'), ('Premium_Amount', 'money')) t(field_name, config_name)),
 n AS (SELECT doc_id, coalesce(config_name, v.field_name) AS name, value, confidence_bp, doc_key FROM v_field v LEFT JOIN b ON v.field_name = b.field_name)
 SELECT doc_id, name, value, confidence_bp FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY confidence_bp DESC, doc_key) AS rn FROM n) WHERE rn = 1""",
)
def j14(spark, sf):
    bridge = spark.createDataFrame([("Proposer_PAN", "pan"), ("Sum_Assured", "money"), ("Premium_Amount", "money")], "field_name string, config_name string")
    out = fuse.best_per_name(form_fields(spark, sf).withColumnRenamed("doc_key", "ord"), bridge)
    return out.select("doc_id", "name", "value", F.round(F.col("confidence") * 10000).cast("long").alias("confidence_bp"))


@query(
    "j15_prediction_vs_truth",
    """WITH p AS (SELECT qid, lower(trim(raw_text)) AS p FROM v_query WHERE qid % 7 <> 0), t AS (SELECT qid, lower(trim(truth)) AS t FROM v_query WHERE qid % 11 <> 0),
 m AS (SELECT p.p, t.t, p.qid AS pq, t.qid AS tq FROM p FULL JOIN t ON p.qid = t.qid),
 c AS (SELECT count(*) FILTER (WHERE pq IS NOT NULL AND tq IS NOT NULL AND p = t) AS tp, count(*) FILTER (WHERE pq IS NOT NULL AND (tq IS NULL OR p <> t)) AS fp, count(*) FILTER (WHERE pq IS NULL) AS fn,
  avg(CASE WHEN p <> t AND p <> '' AND t <> '' THEN levenshtein(p, t) / CAST(length(t) AS DOUBLE) END) AS cer FROM m)
 SELECT tp AS true_positives, fp AS false_positives, fn AS false_negatives, CAST(round(1e6 * cer) AS BIGINT) AS cer_e6, CAST(round(1e6 * tp / (tp + fp)) AS BIGINT) AS precision_e6, CAST(round(1e6 * tp / (tp + fn)) AS BIGINT) AS recall_e6, CAST(round(2e6 * tp / (2 * tp + fp + fn)) AS BIGINT) AS f1_e6 FROM c""",
)
def j15(spark, sf):
    q = view(spark, sf, "v_query")
    g = score.against_truth(q.where("qid % 7 <> 0").select("qid", F.col("raw_text").alias("value")), q.where("qid % 11 <> 0").select("qid", F.col("truth").alias("value")), ["qid"])
    return g.select("true_positives", "false_positives", "false_negatives", e6("mean_cer").alias("cer_e6"), e6("precision").alias("precision_e6"), e6("recall").alias("recall_e6"), e6("f1").alias("f1_e6"))


@query(
    "j16_accuracy",
    """WITH c AS (SELECT lower(raw_text) = lower(truth) AS same, levenshtein(lower(trim(raw_text)), lower(trim(truth))) / CAST(length(trim(truth)) AS DOUBLE) AS e FROM v_query)
 SELECT count(*) AS n, CAST(round(1e6 * avg(CAST(same AS INT))) AS BIGINT) AS exact_e6, CAST(round(1e6 * min(e)) AS BIGINT) AS min_e6, CAST(round(1e6 * avg(e)) AS BIGINT) AS avg_e6, CAST(round(1e6 * max(e)) AS BIGINT) AS max_e6 FROM c""",
)
def j16(spark, sf):
    a = score.accuracy(view(spark, sf, "v_query").select(F.col("raw_text").alias("predicted"), "truth"))
    return a.select("n", e6("exact_rate").alias("exact_e6"), e6("min_cer").alias("min_e6"), e6("avg_cer").alias("avg_e6"), e6("max_cer").alias("max_e6"))


@query("j20_mandatory_anti_join", "WITH m AS (SELECT DISTINCT doc_id, n AS field_name FROM v_field, (VALUES ('Proposer_PAN'), ('Sum_Assured'), ('Nominee_Name')) t(n)) SELECT doc_id, field_name FROM m WHERE NOT EXISTS (SELECT 1 FROM v_field v WHERE v.doc_id = m.doc_id AND v.field_name = m.field_name AND v.value <> '')")
def j20(spark, sf):
    v = form_fields(spark, sf)
    must = F.array(*map(F.lit, ("Proposer_PAN", "Sum_Assured", "Nominee_Name")))
    return v.select("doc_id").distinct().select("doc_id", F.explode(must).alias("field_name")).join(v.where("value <> ''"), ["doc_id", "field_name"], "left_anti")


@query("j24_cell_table_offset", "SELECT o_orderkey AS table_id, l_linenumber AS cell_id, l_linenumber * 10 + o_custkey % 50 AS x1, l_linenumber * 20 + o_custkey % 70 AS y1, l_linenumber * 10 + 9 + o_custkey % 50 AS x2, l_linenumber * 20 + 18 + o_custkey % 70 AS y2 FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def j24(spark, sf):
    n = F.col("l_linenumber")
    cells = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("table_id"), n.alias("cell_id"), (n * 10).alias("x1"), (n * 20).alias("y1"), (n * 10 + 9).alias("x2"), (n * 20 + 18).alias("y2"))
    corners = table(spark, sf, "orders").select(F.col("o_orderkey").alias("table_id"), (F.col("o_custkey") % 50).alias("tx"), (F.col("o_custkey") % 70).alias("ty"))
    return match.with_offsets(cells, corners)


@query(
    "a1_form_kpis",
    """WITH g AS (SELECT doc_id, count(*) AS total_fields, count(*) FILTER (WHERE status = 'Extracted') AS extracted, count(*) FILTER (WHERE status = 'Low Confidence') AS low_confidence, count(*) FILTER (WHERE status = 'Rejected') AS rejected, coalesce(avg(CASE WHEN confidence_bp > 0 THEN confidence_bp / 10000.0 END), 0) AS c FROM v_field GROUP BY doc_id)
 SELECT doc_id, total_fields, extracted, low_confidence, rejected, CAST(round(1e9 * c) AS BIGINT) AS confidence_e9, CASE WHEN rejected > 0 OR c < 0.3 THEN 'rejected' WHEN low_confidence > 0 THEN 'needs_review' ELSE 'completed' END AS form_status FROM g""",
)
def a1(spark, sf):
    k = score.form_kpis(form_fields(spark, sf))
    return k.select("doc_id", "total_fields", "extracted", "low_confidence", "rejected", e9("overall_confidence").alias("confidence_e9"), "form_status")


@query(
    "a2_review_kpis",
    """WITH b AS (SELECT doc_id, value <> '' AS found, confidence_bp / 10000.0 AS c, CASE WHEN confidence_bp >= 8500 THEN 'a' WHEN confidence_bp >= 7000 THEN 'n' WHEN confidence_bp >= 5000 THEN 'l' ELSE 'r' END AS band FROM v_field),
 g AS (SELECT doc_id, count(*) AS total_fields, count(*) FILTER (WHERE found) AS fields_extracted, count(*) FILTER (WHERE NOT found) AS fields_missing, count(*) FILTER (WHERE found AND band = 'a') AS auto_accepted, count(*) FILTER (WHERE found AND band = 'n') AS needs_review, count(*) FILTER (WHERE found AND band = 'l') AS low_confidence, count(*) FILTER (WHERE found AND band = 'r') AS rejected, coalesce(avg(CASE WHEN found THEN c END), 0) AS c FROM b GROUP BY doc_id)
 SELECT doc_id, total_fields, fields_extracted, fields_missing, auto_accepted, needs_review, low_confidence, rejected, CAST(round(1e9 * c) AS BIGINT) AS confidence_e9, CASE WHEN rejected > 0 OR low_confidence > auto_accepted THEN 'needs_review' WHEN needs_review > 0 THEN 'mostly_confident' ELSE 'auto_accepted' END AS form_status FROM g""",
)
def a2(spark, sf):
    k = score.review_kpis(form_fields(spark, sf))
    return k.withColumn("confidence_e9", e9("avg_confidence")).drop("avg_confidence")


def categorized(spark, sf):
    f = form_fields(spark, sf)
    valid = V.semantic_issue(F.col("field_name"), F.col("value")).isNull() & V.age_issue(F.col("field_name"), F.when(F.col("field_name") == "Proposer_Age", F.col("value")).otherwise("50")).isNull()
    return f.withColumn("category", F.when(F.col("value") == "", "Missing").otherwise(V.category(F.col("confidence"), valid)))


CATEGORY_SQL = """c AS (SELECT doc_id, field_name, value, confidence_bp, CASE WHEN value = '' THEN 'Missing' WHEN confidence_bp < 3000 THEN 'Rejected' WHEN confidence_bp < 5000 THEN 'Low Confidence' WHEN confidence_bp < 7000 THEN 'Needs Review'
  WHEN field_name = 'Proposer_Age' AND NOT (CAST(value AS BIGINT) BETWEEN 18 AND 100) THEN 'Validation Failed' ELSE 'Extracted' END AS category FROM v_field)"""


@query("s30_categorize", f"WITH {CATEGORY_SQL} SELECT field_name, category, count(*) AS n FROM c GROUP BY field_name, category")
def s30(spark, sf):
    return categorized(spark, sf).groupBy("field_name", "category").agg(F.count("*").alias("n"))


@query(
    "a3_form_results",
    f"""WITH {CATEGORY_SQL}, g AS (SELECT doc_id, count(*) FILTER (WHERE category IN ('Extracted', 'Needs Review')) AS extracted, count(*) FILTER (WHERE category = 'Missing') AS missing, count(*) FILTER (WHERE category = 'Low Confidence') AS low_confidence, count(*) FILTER (WHERE category = 'Rejected') AS rejected, count(*) FILTER (WHERE category = 'Validation Failed') AS validation_failed,
  coalesce(avg(CASE WHEN value <> '' THEN confidence_bp / 10000.0 END), 0) AS c, count(DISTINCT CASE WHEN category IN ('Extracted', 'Needs Review') AND field_name IN ('Proposer_PAN', 'Sum_Assured') THEN field_name END) AS present FROM c GROUP BY doc_id)
 SELECT doc_id, extracted, missing, low_confidence, rejected, validation_failed, present AS mandatory_present, CAST(round(1e9 * c) AS BIGINT) AS confidence_e9, CASE WHEN c < 0.5 OR present / 2.0 < 0.5 THEN 'Rejected' WHEN low_confidence + validation_failed > extracted * 0.3 THEN 'Needs Review' ELSE 'Processed' END AS form_status FROM g""",
)
def a3(spark, sf):
    r = score.form_results(categorized(spark, sf), spark.createDataFrame([("Proposer_PAN",), ("Sum_Assured",)], "field_name string"))
    return r.select("doc_id", "extracted", "missing", "low_confidence", "rejected", "validation_failed", "mandatory_present", e9("overall_confidence").alias("confidence_e9"), "form_status")


@query(
    "a4_batch_kpis",
    """WITH g AS (SELECT doc_id, count(*) AS total, count(*) FILTER (WHERE status = 'Extracted') AS extracted, count(*) FILTER (WHERE status = 'Rejected') AS rej, count(*) FILTER (WHERE status = 'Low Confidence') AS low, avg(CASE WHEN confidence_bp > 0 THEN confidence_bp / 10000.0 END) AS c FROM v_field GROUP BY doc_id),
 s AS (SELECT *, CASE WHEN rej > 1 THEN 'Rejected' WHEN low > 2 THEN 'Needs Review' ELSE 'Processed' END AS form_status FROM g)
 SELECT count(*) AS total_forms, count(*) FILTER (WHERE form_status <> 'Rejected') AS forms_processed, count(*) FILTER (WHERE form_status = 'Rejected') AS forms_rejected, count(*) FILTER (WHERE form_status = 'Needs Review') AS forms_needs_review,
  CAST(round(1e6 * sum(extracted) / sum(total)) AS BIGINT) AS coverage_e6, CAST(round(1e6 * count(*) FILTER (WHERE form_status = 'Rejected') / count(*)) AS BIGINT) AS rejection_e6 FROM s""",
)
def a4(spark, sf):
    k = score.form_kpis(form_fields(spark, sf))
    forms = k.select(F.when(F.col("rejected") > 1, "Rejected").when(F.col("low_confidence") > 2, "Needs Review").otherwise("Processed").alias("form_status"), F.col("total_fields").alias("total"), "extracted", F.col("overall_confidence").alias("confidence"))
    b = score.batch_kpis(forms)
    return b.select("total_forms", "forms_processed", "forms_rejected", "forms_needs_review", e6("field_coverage").alias("coverage_e6"), e6("rejection_rate").alias("rejection_e6"))


@query("a5_dashboard_fields", "SELECT field_name, CAST(round(1e6 * avg(confidence_bp / 10000.0)) AS BIGINT) AS mean_e6, count(*) AS n FROM v_field GROUP BY field_name ORDER BY field_name LIMIT 10")
def a5(spark, sf):
    d = score.field_dashboard(form_fields(spark, sf))
    return d.select("field_name", e6("mean_confidence").alias("mean_e6"), "n")


LEX_SQL = r"""WITH t AS (SELECT category, list_aggregate(list_transform(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda w: CASE WHEN w IN ('LIC','HCL','TCS','WIPRO','ONGC','SBI','PNB','HDFC','ICICI') OR (length(w) <= 3 AND regexp_matches(w, '^[A-Z]+$')) THEN w ELSE upper(w[1]) || lower(w[2:]) END), 'string_agg', ' ') AS value, frequency FROM v_lexicon),
 w AS (SELECT category, value, frequency, unnest(regexp_extract_all(trim(regexp_replace(translate(upper(value), '0123456789', 'OIZEASGTBG'), '[^A-Z0-9& ]', ' ', 'g')), '[A-Z0-9]+')) AS tok FROM t WHERE category = 'person_full'),
 c AS (SELECT category, value, sum(frequency) AS n FROM t GROUP BY category, value UNION ALL SELECT 'person_token', upper(tok[1]) || lower(tok[2:]), sum(frequency) FROM w WHERE length(tok) >= 2 AND tok NOT IN ('MR','MRS','MS','SHRI','SMT','KUMARI','DR') GROUP BY tok)"""


def lexicon_texts(spark, sf):
    part, cust = table(spark, sf, "part"), table(spark, sf, "customer")
    return part.select(F.lit("person_full").alias("category"), F.upper("p_name").alias("text")).unionByName(part.select(F.lit("plan_name").alias("category"), F.upper("p_brand").alias("text"))).unionByName(cust.select(F.lit("employer_name").alias("category"), F.upper("c_mktsegment").alias("text")))


@query("a9_lexicon_counts", LEX_SQL + " SELECT category, value, CAST(sum(n) AS BIGINT) AS frequency FROM c GROUP BY category, value")
def a9(spark, sf):
    return score.lexicon_counts(lexicon_texts(spark, sf))


@query("a10_lexicon_summary", LEX_SQL + " SELECT category, count(DISTINCT value) AS distinct_values, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY category")
def a10(spark, sf):
    return score.lexicon_summary(score.lexicon_counts(lexicon_texts(spark, sf)))


@query("a15_latency_percentiles", "SELECT count(*) AS n, CAST(round(1e3 * avg(value)) AS BIGINT) AS mean_e3, CAST(round(1e3 * quantile_cont(value, 0.5)) AS BIGINT) AS p50_e3, CAST(round(1e3 * quantile_cont(value, 0.95)) AS BIGINT) AS p95_e3, CAST(round(1e3 * quantile_cont(value, 0.99)) AS BIGINT) AS p99_e3 FROM events")
def a15(spark, sf):
    p = score.latency(table(spark, sf, "events"), "value")
    return p.select("n", *(F.round(F.col(c) * 1000).cast("long").alias(f"{c}_e3") for c in ("mean", "p50", "p95", "p99")))


@query("a20_elements_per_label", "SELECT doc_id, page_num, region_id % 4 AS label, count(*) AS n FROM v_region GROUP BY 1, 2, 3")
def a20(spark, sf):
    return detections(spark, sf).groupBy("doc_id", "page_num", F.col("label").cast("long").alias("label")).agg(F.count("*").alias("n"))


@query("a19_rows_per_family", "SELECT field_family, count(*) AS n FROM v_teacher GROUP BY field_family")
def a19(spark, sf):
    return teacher(spark, sf).groupBy("field_family").agg(F.count("*").alias("n"))


@query(
    "w1_top_n_per_family",
    """WITH p AS (SELECT ord, field_family, confidence_bp, round(CASE field_family WHEN 'date' THEN 2.6 WHEN 'amount' THEN 2.5 WHEN 'numeric' THEN 2.1 WHEN 'short_id' THEN 2.8 WHEN 'name_text' THEN 3.0 ELSE 1.5 END * (0.6 + 0.4 * (ord % 11) / 10.0) + CASE WHEN field_family = 'name_text' THEN 0.2 ELSE 0 END + CASE WHEN ord % 11 < 7 THEN 0.1 ELSE 0 END, 4) AS s FROM v_teacher WHERE ord % 13 <> 0)
 SELECT ord, field_family, CAST(round(1e4 * s) AS BIGINT) AS priority_e4 FROM (SELECT *, row_number() OVER (PARTITION BY field_family ORDER BY s DESC, ord) AS rn FROM p) WHERE rn <= 40""",
)
def w1(spark, sf):
    t = teacher(spark, sf)
    k = F.col("ord") % 11
    rows = t.select(F.col("ord").alias("id"), "field_family", (k / 10).alias("qc_score"), F.when(k < 7, "review").otherwise("good").alias("qc_status"), (F.col("ord") % 13 == 0).alias("is_blank"))
    return dataset.prioritized(rows).select(F.col("id").alias("ord"), "field_family", F.round(F.col("priority_score") * 10000).cast("long").alias("priority_e4"))


@query("w2_first_n_per_family", "SELECT ord, field_family FROM (SELECT ord, field_family, row_number() OVER (PARTITION BY field_family ORDER BY ord) AS rn FROM v_teacher) WHERE rn <= 20")
def w2(spark, sf):
    return dataset.first_of_each(teacher(spark, sf), "field_family", "ord", 20).select("ord", "field_family")


@query("w9_latest_correction", "SELECT doc_id, field_name, new_value, edits FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, field_name) AS edits, row_number() OVER (PARTITION BY doc_id, field_name ORDER BY ts DESC, event_id DESC) AS rn FROM v_review) WHERE rn = 1")
def w9(spark, sf):
    return review.latest(view(spark, sf, "v_review")).select("doc_id", "field_name", "new_value", "edits")


@query("w9_correction_trail", "SELECT event_id, lag(new_value) OVER (PARTITION BY doc_id, field_name ORDER BY ts, event_id) AS old_value, new_value FROM v_review")
def w9_trail(spark, sf):
    return review.trail(view(spark, sf, "v_review")).select("event_id", "old_value", "new_value")


@query("w8_last_log_lines", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def w8(spark, sf):
    return table(spark, sf, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "event_type")


@query("t5_group_split", f"WITH g AS (SELECT id, row_number() OVER (ORDER BY {pick_sql(1 << 32, '42', 'id')}, id) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT id FROM v_teacher)) SELECT t.id, t.ord, CASE WHEN g.rn <= greatest(1, n * 10 // 100) THEN 'val' ELSE 'train' END AS split FROM v_teacher t JOIN g ON t.id = g.id")
def t5(spark, sf):
    return dataset.split_exact(teacher(spark, sf).select("id", "ord"), "id")


@query("s2_same_label", "SELECT a.doc_id, count(*) FILTER (WHERE upper(a.text) = upper(b.text)) AS same, count(*) AS n FROM v_region a JOIN v_region b ON a.doc_id = b.doc_id AND a.page_num = b.page_num AND a.region_id < b.region_id GROUP BY a.doc_id")
def s2(spark, sf):
    r = regions(spark, sf).select("doc_id", "page_num", "region_id", "text")
    m = r.alias("a").join(r.alias("b"), (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page_num") == F.col("b.page_num")) & (F.col("a.region_id") < F.col("b.region_id")))
    return m.groupBy(F.col("a.doc_id").alias("doc_id")).agg(F.count_if(V.same_label(F.col("a.text"), F.col("b.text"))).alias("same"), F.count("*").alias("n"))


@query("s3_cleaners", r"SELECT p_partkey, upper(regexp_replace(p_name, '[^A-Za-z0-9/.\-]', '', 'g')) AS alnum, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, trim(regexp_replace(p_type, '\s+', ' ', 'g')) AS squeezed FROM part")
def s3(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.upper_alnum(F.col("p_name")).alias("alnum"), X.slug(F.col("p_name")).alias("slug"), X.collapse(F.col("p_type")).alias("squeezed"))


KEY_SQL = "trim(regexp_replace(regexp_replace(translate(upper({}), '0123456789', 'OIZEASGTBG'), '[^A-Z0-9& ]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("s4_name_key", f"SELECT qid, {KEY_SQL.format('raw_text')} AS k FROM v_query")
def s4(spark, sf):
    return view(spark, sf, "v_query").select("qid", X.name_key(F.col("raw_text")).alias("k"))


@query("s5_ngrams", f"WITH k AS (SELECT qid, replace({KEY_SQL.format('raw_text')}, ' ', '') AS k FROM v_query) SELECT qid, CAST(len(list_distinct(list_transform(range(1, greatest(length(k) - 2, 1) + 1), lambda i: substr(k, i, 3)))) AS BIGINT) AS n FROM k")
def s5(spark, sf):
    return view(spark, sf, "v_query").select("qid", F.size(X.ngrams(X.name_key(F.col("raw_text")))).cast("long").alias("n"))


@query("s7_similarities", "SELECT qid, CAST(round(1e6 * CASE WHEN substr(raw_text, 1, 4) = substr(truth, 1, 4) AND length(raw_text) >= 4 THEN 1 WHEN substr(raw_text, 1, 3) = substr(truth, 1, 3) THEN 0.75 WHEN substr(raw_text, 1, 2) = substr(truth, 1, 2) THEN 0.5 WHEN substr(raw_text, 1, 1) = substr(truth, 1, 1) THEN 0.25 ELSE 0 END) AS BIGINT) AS prefix_e6 FROM v_query")
def s7(spark, sf):
    return view(spark, sf, "v_query").select("qid", e6(X.prefix_share(F.col("raw_text"), F.col("truth"))).alias("prefix_e6"))


@query("s16_cer", "SELECT qid, CAST(round(1e6 * levenshtein(raw_text, truth) / CAST(length(truth) AS DOUBLE)) AS BIGINT) AS cer_e6, CAST(round(1e6 * (1 - levenshtein(raw_text, truth) / CAST(greatest(length(raw_text), length(truth)) AS DOUBLE))) AS BIGINT) AS sim_e6 FROM v_query")
def s16(spark, sf):
    a, b = F.col("raw_text"), F.col("truth")
    return view(spark, sf, "v_query").select("qid", e6(X.cer(a, b)).alias("cer_e6"), e6(X.levenshtein_similarity(a, b)).alias("sim_e6"))


@query("s18_verhoeff", f"WITH n AS (SELECT o_orderkey, lpad(CAST(o_orderkey * 7919 + o_custkey AS STRING), 12, '7') AS t FROM orders) SELECT o_orderkey, {residue_sql('t')} = 0 AS ok, {residue_sql('t', X.PERMUTE_VARIANT)} = 0 AS ok_compat FROM n")
def s18(spark, sf):
    c = F.lpad((F.col("o_orderkey") * 7919 + F.col("o_custkey")).cast("string"), 12, "7")
    return table(spark, sf, "orders").select("o_orderkey", X.verhoeff_ok(c).alias("ok"), X.verhoeff_ok(c, compat=True).alias("ok_compat"))


@query(
    "s27_repair_and_check",
    """WITH t AS (SELECT ord, replace(upper(trim(text)), ' ', '') AS v FROM v_teacher WHERE field_name = 'pan_number'), f AS (SELECT *, CASE WHEN length(v) = 10 THEN translate(substr(v, 1, 5), '01586', 'OISBG') || translate(substr(v, 6, 4), 'OIlSBG', '011586') || translate(substr(v, 10, 1), '01586', 'OISBG') ELSE v END AS w FROM t),
 k AS (SELECT *, regexp_matches(v, '^[A-Z]{5}[0-9]{4}[A-Z]$') AS ok, regexp_matches(w, '^[A-Z]{5}[0-9]{4}[A-Z]$') AS mended FROM f) SELECT ord, ok AS valid, NOT ok AND mended AS correctable, CASE WHEN ok THEN v WHEN mended THEN w END AS corrected FROM k""",
)
def s27(spark, sf):
    t = teacher(spark, sf).where("field_name = 'pan_number'")
    return t.select("ord", V.checked(F.lit("Proposer_PAN"), F.col("text")).alias("c")).select("ord", "c.*")


@query(
    "s28_date_rules",
    """WITH d AS (SELECT ord, text, try_strptime(text, ['%d/%m/%Y', '%d-%m/%Y', '%d-%m-%Y']) AS d FROM v_teacher WHERE field_name = 'date_of_birth'), e AS (SELECT ord, CASE WHEN regexp_matches(text, '^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$') THEN CAST(strptime(text, '%d/%m/%Y') AS DATE) END AS d FROM d)
 SELECT ord, CASE WHEN d IS NULL THEN 'unparsable' WHEN year(d) < 1900 OR year(d) > 2030 THEN 'year_out_of_range' WHEN (DATE '2020-01-01' - d) / 365.25 < 0 OR (DATE '2020-01-01' - d) / 365.25 > 120 THEN 'age_unreasonable' WHEN (DATE '2020-01-01' - d) / 365.25 < 18 THEN 'proposer_under_18' END AS issue FROM e""",
)
def s28(spark, sf):
    t = teacher(spark, sf).where("field_name = 'date_of_birth'")
    return t.select("ord", V.date_issue(F.lit("Proposer_Date_of_Birth"), F.col("text"), F.lit("2020-01-01").cast("date")).alias("issue"))


@query("s29_semantic_rules", r"SELECT c_custkey, CASE WHEN NOT regexp_matches(CAST(5000000000 + c_custkey * 3000017 AS VARCHAR), '^[6-9][0-9]{9}$') THEN 'bad_mobile' END AS mobile, CASE WHEN lower(c_mktsegment) NOT IN ('yearly', 'monthly', 'quarterly', 'half-yearly') THEN 'unknown_premium_mode' END AS mode FROM customer")
def s29(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", V.semantic_issue(F.lit("Proposer_Mobile_Number"), (F.lit(5000000000) + F.col("c_custkey") * 3000017).cast("string")).alias("mobile"), V.semantic_issue(F.lit("Premium_Mode"), F.col("c_mktsegment")).alias("mode"))


@query(
    "s31_cross_field",
    """WITH g AS (SELECT doc_id, max(CASE WHEN field_name = 'Sum_Assured' AND value <> '' THEN CAST(value AS DOUBLE) END) AS s, max(CASE WHEN field_name = 'Premium_Amount' AND value <> '' THEN CAST(value AS DOUBLE) END) AS p FROM v_field GROUP BY doc_id)
 SELECT v.doc_key, coalesce(s > 0 AND p > 0 AND s / p < 1, false) AS cross_issue FROM v_field v JOIN g ON v.doc_id = g.doc_id""",
)
def s31(spark, sf):
    v = form_fields(spark, sf)
    number = lambda n: F.max(F.when((F.col("field_name") == n) & (F.col("value") != ""), F.col("value").cast("double")))
    g = v.groupBy("doc_id").agg(number("Sum_Assured").alias("s"), number("Premium_Amount").alias("p"))
    issue = F.coalesce((F.col("s") > 0) & (F.col("p") > 0) & (F.col("s") < F.col("p")), F.lit(False))
    return v.join(g, "doc_id").select("doc_key", issue.alias("cross_issue"))


@query(
    "s32_calibrated_confidence",
    """WITH a AS (SELECT doc_key, value, doc_key % 2 = 0 AS kb, CASE WHEN doc_key % 17 = 0 THEN 'HALLUCINATION' WHEN doc_key % 3 = 0 THEN 'INVALID' ELSE 'VALID' END AS st, doc_key % 5 = 0 AS cr, doc_key % 7 = 0 AS ver, (confidence_bp // 40 * 40 + CASE WHEN doc_key % 2 = 0 THEN 20 ELSE 0 END) / 10000.0 AS c FROM v_field),
 b AS (SELECT *, CASE WHEN kb THEN least(c + 0.05, 0.98) ELSE c END AS d FROM a), e AS (SELECT *, CASE st WHEN 'INVALID' THEN d * 0.5 WHEN 'HALLUCINATION' THEN 0 ELSE d END * CASE WHEN cr THEN 0.85 ELSE 1 END AS f FROM b),
 g AS (SELECT doc_key, value, st, round(least(1.0, CASE WHEN ver THEN least(f + 0.10, 0.99) ELSE f END), 4) AS h FROM e)
 SELECT doc_key, CAST(round(1e4 * CASE WHEN value = '' THEN 0 ELSE h END) AS BIGINT) AS confidence_e4, CASE WHEN value = '' THEN 'missing' WHEN h >= 0.85 AND st = 'VALID' THEN 'auto_accepted' WHEN h >= 0.7 THEN 'needs_review' WHEN h >= 0.5 THEN 'low_confidence' ELSE 'rejected' END AS category FROM g""",
)
def s32(spark, sf):
    k = F.col("doc_key")
    status = F.when(k % 17 == 0, "HALLUCINATION").when(k % 3 == 0, "INVALID").otherwise("VALID")
    c = V.calibrated(F.col("value"), (F.floor(F.col("confidence_bp") / 40) * 40 + F.when(k % 2 == 0, 20).otherwise(0)) / 10000, k % 2 == 0, status, k % 5 == 0, k % 7 == 0)
    return form_fields(spark, sf).select("doc_key", c.alias("c")).select("doc_key", F.round(F.col("c.confidence") * 10000).cast("long").alias("confidence_e4"), "c.category")


@query("s36_pii_mask", r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '\b[A-Z]{5}[0-9]{4}[A-Z]\b', '**********', 'g'), '\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b', '************', 'g'), '\b[6-9][0-9]{9}\b', '**********', 'g')) AS masked FROM documents")
def s36(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(X.mask_pii(F.col("text")).cast("binary")).alias("masked"))


@query("s37_gender", "SELECT ord, CASE WHEN contains(u, 'FEMALE') OR u = 'F' THEN 'Female' WHEN contains(u, 'MALE') OR u = 'M' THEN 'Male' END AS g FROM (SELECT event_id AS ord, CASE event_id % 5 WHEN 0 THEN 'FEMALE' WHEN 1 THEN 'MALE' WHEN 2 THEN 'F' WHEN 3 THEN 'M' ELSE 'OTHER' END AS u FROM events)")
def s37(spark, sf):
    k = F.col("event_id") % 5
    return table(spark, sf, "events").select(F.col("event_id").alias("ord"), V.gender(F.when(k == 0, "Female").when(k == 1, "male").when(k == 2, "f").when(k == 3, "M ").otherwise("other")).alias("g"))


@query("f8_missing_test", "SELECT event_id, x IS NULL OR lower(trim(x)) IN ('', 'none', 'null', 'not found') AS missing FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN 'Not Found' WHEN 3 THEN event_type ELSE 'None' END AS x FROM events)")
def f8(spark, sf):
    k = F.col("event_id") % 5
    x = F.when(k == 1, " ").when(k == 2, "Not Found").when(k == 3, F.col("event_type")).when(k == 4, "None")
    return table(spark, sf, "events").select("event_id", X.is_missing(x).alias("missing"))


@query("f9_null_tokens", "SELECT ord, CASE WHEN lower(trim(text)) NOT IN ('', 'none', 'null', 'not found', 'n/a', 'na', 'nil', '-') THEN trim(text) END AS v FROM v_teacher")
def f9(spark, sf):
    return teacher(spark, sf).select("ord", X.null_tokens(F.col("text")).alias("v"))


@query("f5_region_filter", "SELECT region_id FROM v_region WHERE confidence_bp >= 3000 AND length(trim(text)) > 1 AND NOT regexp_matches(text, '^[0-9]+$')")
def f5(spark, sf):
    return regions(spark, sf).where((F.col("confidence") >= 0.3) & (F.length(F.trim("text")) > 1) & ~F.col("text").rlike("^[0-9]+$")).select("region_id")


@query("f7_per_class_threshold", "WITH t AS (SELECT * FROM (VALUES (0, 2000), (1, 5000), (2, 8000)) t(label, least)) SELECT region_id, least FROM v_region JOIN t ON region_id % 4 = label WHERE confidence_bp > least")
def f7(spark, sf):
    t = spark.createDataFrame([(0, 2000), (1, 5000), (2, 8000)], "label int, least int")
    d = regions(spark, sf).withColumn("label", (F.col("region_id") % 4).cast("int"))
    return d.join(F.broadcast(t), "label").where("confidence_bp > least").select("region_id", "least")


@query(
    "f13_hallucination",
    r"""WITH t AS (SELECT ord, field_family AS f, confidence_bp AS c, trim(text) AS v, lower(trim(text)) AS l FROM v_teacher),
 k AS (SELECT *, list_max(list_transform(list_distinct(string_split(l, '')), lambda x: length(l) - length(replace(l, x, '')))) / length(l) AS top, len(list_distinct(string_split(replace(l, ' ', ''), ''))) / length(replace(l, ' ', '')) AS var FROM t)
 SELECT ord, CASE WHEN v = '' THEN NULL WHEN l IN ('avelandian', 'linsularate', 'thelasthe', 'india', 'lhe', 'lhe_', 'tha', 'dhe', 'fhe', 'tand', 'tion', 'tion_', 'ing', 'ing_', 'nan', 'none', 'null') THEN 'known_token'
  WHEN length(v) < 2 OR regexp_matches(v, '^[^a-zA-Z0-9\s]+$') OR (length(v) >= 5 AND left(v, 5) = repeat(left(v, 1), 5)) OR regexp_matches(l, '^[bcdfghjklmnpqrstvwxyz]{5,}$') OR regexp_matches(l, '^[aeiou]{5,}$') THEN 'gibberish'
  WHEN length(v) >= 3 AND NOT regexp_matches(v, '[0-9]') AND top > 0.6 THEN 'repetitive' WHEN f IN ('name_text', 'short_text') AND length(v) > 2 AND var < 0.2 AND c < 7000 THEN 'low_variety'
  WHEN f = 'numeric' AND NOT regexp_matches(v, '[0-9]') THEN 'numeric_without_digits' WHEN f = 'amount' AND NOT regexp_matches(v, '[0-9]') THEN 'amount_without_digits' WHEN f = 'date' AND NOT regexp_matches(v, '[0-9]') THEN 'date_without_digits'
  WHEN f = 'short_id' AND length(v) > 40 THEN 'id_too_long' WHEN f IN ('name_text', 'short_text') AND length(v) > 150 THEN 'text_too_long' WHEN f = 'binary_mark' AND length(v) > 5 AND l NOT IN ('checked', 'unchecked', 'marked', 'unmarked') THEN 'unexpected_mark' END AS reason FROM k""",
)
def f13(spark, sf):
    t = teacher(spark, sf)
    return t.select("ord", V.hallucination(F.col("text"), F.col("field_family"), F.col("confidence")).alias("reason"))


@query("f14_pseudo_label_filter", "SELECT ord FROM v_teacher WHERE confidence_bp >= 9000 AND length(text) >= 2 AND NOT (field_name = 'pan_number' AND length(trim(text)) <> 10) AND NOT (field_name = 'annual_income' AND NOT regexp_matches(replace(text, ',', ''), '^[0-9]+$'))")
def f14(spark, sf):
    t, text = teacher(spark, sf), F.col("text")
    return t.where((F.col("confidence") >= 0.9) & (F.length(text) >= 2) & ~((F.col("field_name") == "pan_number") & (F.length(F.trim(text)) != 10)) & ~((F.col("field_name") == "annual_income") & ~F.replace(text, F.lit(","), F.lit("")).rlike("^[0-9]+$"))).select("ord")


@query("f15_low_confidence_queue", "SELECT ord FROM v_teacher WHERE field_family <> 'binary_mark' AND (confidence_bp < 7000 OR length(text) < 2)")
def f15(spark, sf):
    return teacher(spark, sf).where("field_family <> 'binary_mark' AND (confidence < 0.7 OR length(text) < 2)").select("ord")


@query("f16_fallback_cap", "SELECT region_id FROM (SELECT region_id, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY confidence_bp, region_id) AS rn FROM v_region) WHERE rn <= 5")
def f16(spark, sf):
    from pyspark.sql.window import Window

    w = Window.partitionBy("doc_id", "page_num").orderBy("confidence", "region_id")
    return regions(spark, sf).withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("region_id")


@query("f18_handwriting_heuristic", "SELECT ord, regexp_matches(upper(text), '0O|O0|5S|S5|8B|B8') OR contains(text, '  ') OR starts_with(text, ' ') OR ends_with(text, ' ') AS hand FROM v_teacher WHERE length(text) > 0")
def f18(spark, sf):
    return teacher(spark, sf).where("length(text) > 0").select("ord", X.looks_handwritten(F.col("text")).alias("hand"))


@query("f19_script_detection", "SELECT doc_id, CASE WHEN regexp_matches(text, '[ऀ-ॿ]') AND regexp_matches(text, '[A-Za-z]') THEN 'mixed' WHEN regexp_matches(text, '[ऀ-ॿ]') THEN 'devanagari' WHEN regexp_matches(text, '[A-Za-z]') THEN 'latin' WHEN regexp_matches(text, '[0-9]') THEN 'numeric' ELSE 'other' END AS script FROM documents")
def f19(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.script(F.col("text")).alias("script"))


@query("f21_field_partition", "SELECT CASE WHEN status = 'Rejected' THEN 'hallucinated' WHEN value <> '' AND confidence_bp > 3000 THEN 'extracted' ELSE 'missing' END AS part, count(*) AS n FROM v_field GROUP BY 1")
def f21(spark, sf):
    part = F.when(F.col("status") == "Rejected", "hallucinated").when((F.col("value") != "") & (F.col("confidence") > 0.3), "extracted").otherwise("missing")
    return form_fields(spark, sf).groupBy(part.alias("part")).agg(F.count("*").alias("n"))


@query(
    "f23_line_text",
    "SELECT doc_id, page_num, string_agg(text, ' ' ORDER BY y1, x1, region_id) AS line FROM v_region WHERE confidence_bp > 5000 GROUP BY doc_id, page_num",
)
def f23(spark, sf):
    r = regions(spark, sf).where("confidence > 0.5").groupBy("doc_id", "page_num").agg(F.sort_array(F.collect_list(F.struct("y1", "x1", "region_id", "text"))).alias("r"))
    return r.select("doc_id", "page_num", F.array_join(F.transform("r", lambda x: x["text"]), " ").alias("line"))


@query(
    "s47_table_pairs",
    r"""WITH r AS (SELECT doc_id, unnest(regexp_extract_all(html, '<tr>(.*?)</tr>', 1)) AS r FROM v_html), c AS (SELECT doc_id, regexp_extract_all(r, '<td>(.*?)</td>', 1) AS c FROM r)
 SELECT doc_id, c[1] AS label, coalesce(c[2], '') AS value, CASE WHEN len(c) = 1 THEN 'header' WHEN c[2] = '' THEN 'empty' ELSE 'standard' END AS row_type FROM c""",
)
def s47(spark, sf):
    return view(spark, sf, "v_html").select("doc_id", F.explode(P.pairs(F.col("html"))).alias("p")).select("doc_id", "p.*")


@query("s47_page_titles", r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title FROM pages")
def s47_titles(spark, sf):
    return table(spark, sf, "pages").select("page_id", P.title(F.col("html")).alias("title"))


@query("s41_json_repair", "SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value, CAST(len(json_keys(props)) AS BIGINT) AS n FROM events")
def s41(spark, sf):
    e = table(spark, sf, "events")
    broken = F.concat(F.lit("```json\n"), F.regexp_replace("props", r"\}$", ",}"), F.lit("\n```"))
    m = P.json_map(broken)
    return e.select("event_id", F.element_at(F.map_values(m), 1).alias("first_value"), F.size(m).cast("long").alias("n"))


@query("s43_key_values", "SELECT event_id, 'Kind' AS key, event_type AS value FROM events UNION ALL SELECT event_id, 'User', CAST(user_id AS STRING) FROM events")
def s43(spark, sf):
    text = F.concat(F.lit("Kind: "), "event_type", F.lit("\nno pair here\nUser -> "), F.col("user_id").cast("string"))
    return table(spark, sf, "events").select("event_id", F.explode(P.key_values(text)).alias("p")).select("event_id", "p.*")


@query(
    "s45_document_json",
    """WITH p AS (SELECT doc_id, doc_key % 3 AS page, string_agg('{"field_name":"' || field_name || '","value":"' || value || '","confidence":' || CASE WHEN confidence_bp = 0 THEN '0.0' WHEN confidence_bp = 10000 THEN '1.0' WHEN confidence_bp < 10 THEN confidence_bp || '.0E-4' ELSE rtrim('0.' || lpad(CAST(confidence_bp AS STRING), 4, '0'), '0') END || '}', ',' ORDER BY doc_key) AS f, count(*) AS n FROM v_field GROUP BY 1, 2)
 SELECT doc_id, md5('{"document_id":' || doc_id || ',"pages":[' || string_agg('{"page_num":' || page || ',"fields":[' || f || ']}', ',' ORDER BY page) || ']}') AS json_md5 FROM p GROUP BY doc_id""",
)
def s45(spark, sf):
    f = form_fields(spark, sf).withColumn("page_num", (F.col("doc_key") % 3).cast("int")).withColumnRenamed("doc_key", "ord")
    return files.document_json(f).select("doc_id", F.md5(F.col("json").cast("binary")).alias("json_md5"))


@query("s46_source_map", "SELECT doc_id, count(DISTINCT region_id) AS n, arg_max(text, struct_pack(k := CAST(region_id AS STRING), c := confidence_bp, p := page_num, t := text)) AS last_value FROM v_region GROUP BY doc_id")
def s46(spark, sf):
    r = regions(spark, sf).select("doc_id", "page_num", F.col("region_id").cast("string").alias("field_name"), F.col("text").alias("value"), "confidence")
    return files.source_map(r).select("doc_id", F.size("sources").cast("long").alias("n"), F.element_at("sources", F.array_max(F.map_keys("sources")))["value"].alias("last_value"))


@query(
    "s51_box_geometry",
    """SELECT region_id, (x2 - x1) * (y2 - y1) AS area, greatest(least(x2, 700) - greatest(x1, 300), 0) * greatest(least(y2, 900) - greatest(y1, 200), 0) AS shared, greatest(x1 - 5, 0) AS ex1, least(y2 + 5, 1400) AS ey2, x2 - x1 AS w, y2 - y1 AS h FROM v_region""",
)
def s51(spark, sf):
    b, f = F.col("rbox"), G.box(F.lit(300), F.lit(200), F.lit(700), F.lit(900))
    e, c = G.expand(b, F.lit(5), F.lit(1100), F.lit(1400)), G.coco(b)
    return regions(spark, sf).select("region_id", G.area(b).alias("area"), G.common(b, f).alias("shared"), e["x1"].alias("ex1"), e["y2"].alias("ey2"), c["w"].alias("w"), c["h"].alias("h"))


@query("s55_tile_grid", "SELECT p.doc_id, 'tile_r' || r || '_c' || c AS tile, greatest(c * 550 - 50, 0) AS x1, greatest(r * 466 - 50, 0) AS y1, least((c + 1) * 550 + 50, 1100) AS x2, least((r + 1) * 466 + 50, 1400) AS y2 FROM (SELECT doc_id FROM documents) p, range(3) a(r), range(2) b(c)")
def s55(spark, sf):
    pages = table(spark, sf, "documents").select("doc_id", F.lit(1).alias("page_num"), F.lit(1100).alias("width"), F.lit(1400).alias("height"))
    return match.tiles(pages).select("doc_id", "tile", "x1", "y1", "x2", "y2")


J13_KEYS = """SELECT {id}, category, unnest(list_distinct(list_concat(['e:' || norm], list_transform(toks, lambda t: 't:' || t), list_transform(toks, lambda t: 's:' || {code}), grams, {lengths}))) AS key FROM {src}"""
NORM_KEY = "trim(regexp_replace(regexp_replace(translate(upper({c}), '0123456789', 'OIZEASGTBG'), '[^A-Z0-9& ]', ' ', 'g'), '\\s+', ' ', 'g'))"
SOUND = "substr(rpad(substr(t, 1, 1) || replace(substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(upper(t), 'BFPVCGJKQSXZDTLMNRAEIOUYHW0123456789&', '1111222222223345560000000000000000000'), '0+', '0', 'g'), '1+', '1', 'g'), '2+', '2', 'g'), '3+', '3', 'g'), '4+', '4', 'g'), '5+', '5', 'g'), '6+', '6', 'g'), 2), '0', ''), 4, '0'), 1, 4)"
GRAMS = "list_transform(range(1, greatest(length(replace(norm, ' ', '')) - 2, 1) + 1), lambda i: 'g:' || substr(replace(norm, ' ', ''), i, 3))"


@query(
    "j13_lexicon_candidates",
    f"""WITH q0 AS (SELECT qid, category, {NORM_KEY.format(c="raw_text")} AS norm FROM v_query), q1 AS (SELECT *, regexp_extract_all(norm, '[A-Z0-9]+') AS toks, {GRAMS} AS grams FROM q0),
 e0 AS (SELECT category, text, {NORM_KEY.format(c="text")} AS norm FROM v_lexicon), e1 AS (SELECT *, regexp_extract_all(norm, '[A-Z0-9]+') AS toks, {GRAMS} AS grams FROM e0),
 qk AS ({J13_KEYS.format(id="qid", src="q1 WHERE len(toks) > 0", code=SOUND, lengths="list_transform(range(greatest(length(norm) - 3, 1), length(norm) + 4), lambda n: 'l:' || n)")}),
 ek AS ({J13_KEYS.format(id="text", src="e1", code=SOUND, lengths="['l:' || length(norm)]")})
 SELECT DISTINCT qid, e.text FROM qk q JOIN ek e ON q.category = e.category AND q.key = e.key""",
)
def j13(spark, sf):
    q, e = resolver_inputs(spark, sf)
    q = resolve.indexed(q.withColumn("categories", F.array("category")), "raw_text")
    return resolve.candidates(q, resolve.indexed(e, "text"), every_length=True).join(e.select("entry_id", "text"), "entry_id").select("qid", "text")


def resolver_inputs(spark, sf):
    """Queries of four kinds of fields, one of them without a lexicon, some empty."""
    k = F.col("qid")
    name = F.when(k % 10 == 9, "plan_name").when(k % 10 == 8, "remarks").otherwise("proposer_full_name")
    text = F.when(k % 13 == 12, "  ").when(k % 13 == 11, "%%").otherwise(F.col("raw_text"))
    q = view(spark, sf, "v_query").select("qid", "category", name.alias("field_name"), "raw_text", text.alias("asked"))
    return q, view(spark, sf, "v_lexicon").withColumn("entry_id", F.xxhash64("category", "text"))


def resolver_queries(spark, sf):
    q, e = resolver_inputs(spark, sf)
    return q.select("qid", "field_name", F.col("asked").alias("raw_text")), e


@query("t1_resolver_top_k")
def t1(spark, sf):
    top, _ = resolve.resolve(*resolver_queries(spark, sf))
    return top.select("qid", "category", "text", e6("score").alias("score_e6"), "frequency", "exact", "rank")


@query("s10_resolver_decision")
def s10(spark, sf):
    _, d = resolve.resolve(*resolver_queries(spark, sf))
    return d.select("qid", "resolved_text", "category", e6("confidence").alias("confidence_e6"), "accepted", "review_required", "method")


LAST_SQL = f"""['Kumar', 'Sharma', 'Patel', 'Singh', 'Reddy'][{pick_sql(5, "42", "3", "id")} + 1]"""
RECORDS_SQL = f"""h AS (SELECT id, {pick_sql(2, "42", "1", "id")} = 0 AS man, {pick_sql(3, "42", "2", "id")} > 0 AS married, {LAST_SQL} AS last_name, {pick_sql(4, "42", "4", "id")} + 1 AS a, {pick_sql(4, "42", "5", "id")} + 1 AS b, {pick_sql(4, "42", "6", "id")} + 1 AS c, ({pick_sql(46, "42", "7", "id")} + 3) * 50000 AS annual_income, {pick_sql(16000, "42", "8", "id")} AS days FROM ids),
 rec AS (SELECT 'REC_' || lpad(CAST(id + 1 AS STRING), 5, '0') AS record_id, CASE WHEN man THEN 'Male' ELSE 'Female' END AS gender, last_name, CASE WHEN man THEN ['Rajesh', 'Amit', 'Suresh', 'Vikram'][a] ELSE ['Priya', 'Sunita', 'Kavita', 'Meena'][a] END AS first_name,
  CASE WHEN married THEN CASE WHEN man THEN ['Priya', 'Sunita', 'Kavita', 'Meena'][b] ELSE ['Rajesh', 'Amit', 'Suresh', 'Vikram'][b] END || ' ' || last_name ELSE '' END AS spouse_full_name, ['Mumbai', 'Delhi', 'Pune', 'Chennai'][c] AS address_city, ['400001', '110001', '411001', '600001'][c] AS address_pincode,
  annual_income, CAST(floor(annual_income * 6 / 100) AS BIGINT) AS premium, CAST(floor(annual_income * 6 / 100) AS BIGINT) * 20 AS sum_assured, strftime(DATE '1955-01-01' + CAST(days AS INTEGER), '%d/%m/%Y') AS date_of_birth FROM h)"""
IDS_SQL = "ids AS (SELECT c_custkey AS id FROM customer)"


def records(spark, sf):
    """A made-up record for each customer."""
    return dataset.synthetic_records(table(spark, sf, "customer").select(F.col("c_custkey").alias("id")))


@query(
    "g2_record_field_product",
    f"WITH {IDS_SQL}, {RECORDS_SQL}, f AS (SELECT record_id, unnest(['first_name', 'last_name', 'spouse_full_name', 'address_city', 'address_pincode', 'annual_income', 'date_of_birth']) AS field_name, unnest([first_name, last_name, spouse_full_name, address_city, address_pincode, CAST(annual_income AS STRING), date_of_birth]) AS target_text FROM rec) SELECT record_id || '__' || field_name AS id, record_id, field_name, target_text FROM f",
)
def g2(spark, sf):
    return dataset.crops_of(records(spark, sf), ["first_name", "last_name", "spouse_full_name", "address_city", "address_pincode", "annual_income", "date_of_birth"])


@query(
    "g3_projected_pages",
    f"WITH {IDS_SQL}, {RECORDS_SQL} SELECT record_id, 'proposer_details' AS page_type, 3 AS n, gender AS one FROM rec UNION ALL SELECT record_id, 'plan_details', 2, CAST(sum_assured AS STRING) FROM rec",
)
def g3(spark, sf):
    p = dataset.pages_of(records(spark, sf), {"proposer_details": ["first_name", "last_name", "gender"], "plan_details": ["premium", "sum_assured"]})
    return p.select("record_id", "page_type", F.size("labels").alias("n"), F.coalesce(F.col("labels")["gender"], F.col("labels")["sum_assured"]).alias("one"))


@query(
    "g5_mutated_queries",
    f"""WITH t AS (SELECT p_partkey AS id, upper(p_name) AS text FROM part), k AS (SELECT id, text, length(text) AS n, {pick_sql(1 << 32, "7", "id")} % greatest(length(text), 1) AS pos, {pick_sql(3, "8", "id")} AS kind FROM t)
 SELECT id, CASE kind WHEN 0 THEN substr(text, 1, pos) || substr(text, pos + 2) WHEN 1 THEN substr(text, 1, pos + 1) || substr(text, pos + 1) ELSE substr(text, 1, pos) || translate(substr(text, pos + 1, 1), 'OISB', '0158') || substr(text, pos + 2) END AS mutated FROM k""",
)
def g5(spark, sf):
    t = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.upper("p_name").alias("text"))
    return dataset.mutated(t, "text").select("id", "mutated")


@query(
    "s57_crop_qc",
    """WITH m AS (SELECT region_id, region_id % 11 = 0 AS blank, (region_id % 50) / 1000.0 AS d, region_id % 120 AS v, (region_id % 23) / 50.0 AS top, (region_id % 29) / 50.0 AS bottom, (region_id % 31) / 60.0 AS l, (region_id % 37) / 80.0 AS r FROM v_region),
 s AS (SELECT region_id, greatest(0, 1 - CASE WHEN d < 0.01 AND NOT blank THEN 0.35 ELSE 0 END - CASE WHEN v < 20 THEN 0.2 ELSE 0 END - 0.1 * (CAST(top > 0.2 AS INT) + CAST(bottom > 0.2 AS INT) + CAST(l > 0.2 AS INT) + CAST(r > 0.2 AS INT))) AS q,
  CAST(d < 0.01 AS INT) + CAST(v < 20 AS INT) + CAST(top > 0.2 AS INT) + CAST(bottom > 0.2 AS INT) + CAST(l > 0.2 AS INT) + CAST(r > 0.2 AS INT) AS n FROM m)
 SELECT region_id, CAST(round(1e4 * q) AS BIGINT) AS score_e4, n AS n_flags, CASE WHEN round(1e4 * q) < 4500 THEN 'poor' WHEN round(1e4 * q) < 7000 THEN 'review' ELSE 'good' END AS qc_status FROM s""",
)
def s57(spark, sf):
    k = F.col("region_id")
    edges = [(k % m / F.lit(d)).alias(f"{n}_edge") for n, m, d in (("top", 23, 50.0), ("bottom", 29, 50.0), ("left", 31, 60.0), ("right", 37, 80.0))]
    m = regions(spark, sf).select("region_id", (k % 11 == 0).alias("is_blank"), (k % 50 / F.lit(1000.0)).alias("dark_ratio"), (k % 120).alias("edge_var"), *edges)
    return dataset.qc_status(m).select("region_id", F.round(F.col("qc_score") * 10000).cast("long").alias("score_e4"), F.size("qc_flags").alias("n_flags"), "qc_status")


@query("src20_page_catalog", "SELECT doc_id, page_num, lang, string_agg(t, '|' ORDER BY region_id) AS texts FROM (SELECT doc_id, page_num, lang, region_id, substr(text, 1, 100) AS t, row_number() OVER (PARTITION BY doc_id, page_num, lang ORDER BY region_id) AS rn FROM v_region) WHERE rn <= 20 GROUP BY doc_id, page_num, lang")
def src20(spark, sf):
    from pyspark.sql.window import Window

    w = Window.partitionBy("doc_id", "page_num", "lang").orderBy("region_id")
    first = regions(spark, sf).withColumn("rn", F.row_number().over(w)).where("rn <= 20").groupBy("doc_id", "page_num", "lang")
    texts = F.sort_array(F.collect_list(F.struct("region_id", F.substring("text", 1, 100).alias("t"))))
    return first.agg(texts.alias("r")).select("doc_id", "page_num", "lang", F.array_join(F.transform("r", lambda x: x["t"]), "|").alias("texts"))


@query("src19_text_harvest", "SELECT region_id, text FROM v_region WHERE confidence_bp > 7000 AND length(text) BETWEEN 2 AND 50 ORDER BY region_id LIMIT 500")
def src19(spark, sf):
    return regions(spark, sf).where("confidence > 0.7 AND length(text) BETWEEN 2 AND 50").orderBy("region_id").limit(500).select("region_id", "text")
