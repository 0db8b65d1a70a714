"""Further queries: labels and vocabularies, repairs, summaries, checks of sources and streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dictionary as D
from ..functions import geometry as G
from ..functions import parse as P
from ..functions import repair as R
from ..functions import text as X
from ..operators import dataset, fuse, label, match, score
from ..sources import files
from .registry import IDS_SQL, NORM_KEY, RECORDS_SQL, SOUND, e6, form_fields, query, records, regions, table, teacher
from .views import DIGITS11, pick_sql, residue_sql, view

FIELD_LABELS = [(1, "first", "f1"), (1, "first", "o1"), (2, "second", "f2"), (3, "third", "o3"), (4, "fourth", "f9")]


@query("j3_label_value_greedy")
def j3(spark, sf):
    r = regions(spark, sf).select("doc_id", "page_num", "region_id", "text", "confidence", "x1", "y1", "x2", "y2")
    out = label.label_values(r, spark.createDataFrame(FIELD_LABELS, "ord int, field string, pattern string"))
    return out.select("doc_id", "page_num", "field", "label_id", "region_id", "value", e6("score").alias("score_e6"))


@query(
    "j6_label_box_lookup",
    """WITH k AS (SELECT * FROM (VALUES (1, 'first', 'f1'), (1, 'first', 'o1'), (2, 'second', 'f2'), (3, 'third', 'o3'), (4, 'fourth', 'f9')) t(ord, field, pattern)),
 m AS (SELECT doc_id, page_num, field, region_id, row_number() OVER (PARTITION BY doc_id, page_num, field ORDER BY ord, pattern, region_id) AS rn FROM v_region JOIN k ON contains(lower(text), pattern)) SELECT doc_id, page_num, field, region_id FROM m WHERE rn = 1""",
)
def j6(spark, sf):
    k = spark.createDataFrame(FIELD_LABELS, "ord int, field string, pattern string")
    m = regions(spark, sf).join(k, F.contains(F.lower("text"), F.col("pattern")))
    return m.groupBy("doc_id", "page_num", "field").agg(F.min(F.struct("ord", "pattern", "region_id")).alias("b")).select("doc_id", "page_num", "field", "b.region_id")


@query(
    "j7_override_box",
    """SELECT doc_key, CASE WHEN doc_key % 3 = 0 THEN CAST(0.1 * 1100 AS INT) ELSE 5 END AS x1, CASE WHEN doc_key % 3 = 0 THEN CAST(0.5 * 1400 AS INT) ELSE 90 END AS y2, doc_key % 3 = 0 AS overridden FROM v_field""",
)
def j7(spark, sf):
    f = form_fields(spark, sf).select("doc_key", G.box(F.lit(5), F.lit(10), F.lit(50), F.lit(90)).alias("box"))
    s = form_fields(spark, sf).where("doc_key % 3 = 0").select("doc_key", F.lit(0.1).alias("sx1"), F.lit(0.2).alias("sy1"), F.lit(0.4).alias("sx2"), F.lit(0.5).alias("sy2")).distinct()
    return label.box_or_override(f, s, ["doc_key"], F.lit(1100), F.lit(1400)).select("doc_key", "box.x1", "box.y2", "overridden")


@query("j8_grid_address", "SELECT region_id, f AS field FROM v_region JOIN (VALUES (0, 0, 'a'), (1, 2, 'b'), (3, 3, 'c')) t(r, c, f) ON y1 // 200 = r AND x1 // 200 = c")
def j8(spark, sf):
    grid = spark.createDataFrame([(0, 0, "a"), (1, 2, "b"), (3, 3, "c")], "r int, c int, field string")
    cells = regions(spark, sf).select("region_id", F.floor(F.col("y1") / 200).cast("int").alias("r"), F.floor(F.col("x1") / 200).cast("int").alias("c"))
    return cells.join(grid, ["r", "c"]).select("region_id", "field")


@query(
    "j10_fuzzy_label_fields",
    """WITH k AS (SELECT * FROM (VALUES (1, 'small brass', 'brass'), (2, 'steel', 'steel'), (3, 'economy', 'economy'), (4, 'standrd', 'standard')) t(ord, keyword, field)), m AS (SELECT DISTINCT p_type AS label, ord, field, CASE WHEN contains(lower(p_type), keyword) THEN 0.9 ELSE jaro_winkler_similarity(lower(p_type), keyword) END AS s, contains(lower(p_type), keyword) AS inside FROM part, k)
 SELECT label, field, CAST(round(1e6 * s) AS BIGINT) AS score_e6 FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, ord) AS rn FROM m WHERE inside OR s > 0.85) WHERE rn = 1""",
)
def j10(spark, sf):
    k = spark.createDataFrame([(1, "small brass", "brass"), (2, "steel", "steel"), (3, "economy", "economy"), (4, "standrd", "standard")], "ord int, keyword string, field string")
    return label.label_fields(table(spark, sf, "part").select(F.col("p_type").alias("label")), k).select("label", "field", e6("score").alias("score_e6"))


@query(
    "j12_next_cell",
    """WITH c AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, text) AS nx, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS o FROM conversations),
 m AS (SELECT conv_id, nx, row_number() OVER (PARTITION BY conv_id ORDER BY o) AS rn FROM c WHERE contains(lower(text), 'the')) SELECT conv_id, md5(trim(replace(nx, 'the', ''))) AS value FROM m WHERE rn = 1""",
)
def j12(spark, sf):
    c = table(spark, sf, "conversations").withColumn("ord", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text")))
    k = spark.createDataFrame([(1, "the_field", "the")], "ord int, field string, pattern string")
    out = label.cell_leads(c.select(F.col("conv_id").alias("doc_id"), "ord", "text"), k)
    return out.select(F.col("doc_id").alias("conv_id"), F.md5(F.col("value").cast("binary")).alias("value"))


@query(
    "j17_title_assignment",
    """WITH RECURSIVE r AS (SELECT doc_id, page_num, region_id, region_id % 3 AS kind, x1 / CAST(1100 AS DOUBLE) AS x1, y1 / CAST(1400 AS DOUBLE) AS y1, x2 / CAST(1100 AS DOUBLE) AS x2, y2 / CAST(1400 AS DOUBLE) AS y2 FROM v_region),
 p AS (SELECT o.doc_id, o.page_num, o.kind, o.region_id AS o, t.region_id AS t, greatest(o.y1 - t.y2, t.y1 - o.y2, 0) AS dy, greatest(o.x1 - t.x2, t.x1 - o.x2, 0) AS dx, greatest(least(o.x2, t.x2) - greatest(o.x1, t.x1), 0) * greatest(least(o.y2, t.y2) - greatest(o.y1, t.y1), 0) / greatest((t.x2 - t.x1) * (t.y2 - t.y1), 1e-9) AS share FROM r o JOIN r t ON o.doc_id = t.doc_id AND o.page_num = t.page_num WHERE o.kind > 0 AND t.kind = 0),
 q AS (SELECT *, CASE WHEN kind = 2 AND share > 0.9 THEN (dy + dx / 2 + 0.01) * 10 WHEN share > 0.25 THEN 0 ELSE dy + dx / 2 END AS d FROM p),
 k AS (SELECT doc_id, page_num, o, t, d, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY kind, d, o, t) AS k FROM q WHERE d < 0.1),
 w AS (SELECT doc_id, page_num, k, [o] AS os, [t] AS ts, true AS took FROM k WHERE k = 1
  UNION ALL SELECT k.doc_id, k.page_num, k.k, CASE WHEN list_contains(w.os, k.o) OR list_contains(w.ts, k.t) THEN w.os ELSE list_append(w.os, k.o) END, CASE WHEN list_contains(w.os, k.o) OR list_contains(w.ts, k.t) THEN w.ts ELSE list_append(w.ts, k.t) END, NOT (list_contains(w.os, k.o) OR list_contains(w.ts, k.t)) FROM w JOIN k ON k.doc_id = w.doc_id AND k.page_num = w.page_num AND k.k = w.k + 1)
 SELECT k.doc_id, k.page_num, k.o AS det_id, k.t AS title_id, CAST(round(1e6 * k.d) AS BIGINT) AS distance_e6 FROM k JOIN w ON k.doc_id = w.doc_id AND k.page_num = w.page_num AND k.k = w.k WHERE w.took""",
)
def j17(spark, sf):
    k = F.col("region_id") % 3
    r = regions(spark, sf).select("doc_id", "page_num", F.col("region_id").alias("det_id"), F.when(k == 0, "title").when(k == 1, "table").otherwise("chart").alias("kind"), *((F.col(c) / F.lit(1100.0 if c[0] == "x" else 1400.0)).alias(c) for c in ("x1", "y1", "x2", "y2")))
    return label.titles_of(r).select("doc_id", "page_num", "det_id", "title_id", e6("distance").alias("distance_e6"))


SEGMENT_ALIASES = [("Buil-ding", "b1"), ("machi nery.", "m1"), ("BUILDING", "b2"), ("House Hold", "h1"), ("auto mobiles", "a1")]


@query(
    "j19_alias_lookup",
    f"""WITH a AS (SELECT regexp_replace(lower(alias), '[^a-z0-9]', '', 'g') AS k, min(public_id) AS public_id FROM (VALUES {", ".join(map(str, SEGMENT_ALIASES))}) t(alias, public_id) GROUP BY 1), c AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN lower(c_mktsegment) || '.' ELSE substr(c_mktsegment, 1, 4) || ' - ' || substr(c_mktsegment, 5) END AS name FROM customer)
 SELECT c_custkey, public_id FROM c LEFT JOIN a ON regexp_replace(lower(name), '[^a-z0-9]', '', 'g') = k""",
)
def j19(spark, sf):
    k = F.col("c_custkey") % 3
    name = F.when(k == 0, F.col("c_mktsegment")).when(k == 1, F.concat(F.lower("c_mktsegment"), F.lit("."))).otherwise(F.concat(F.substring("c_mktsegment", 1, 4), F.lit(" - "), F.substring("c_mktsegment", 5, 99)))
    return label.alias_lookup(table(spark, sf, "customer").select("c_custkey", name.alias("name")), spark.createDataFrame(SEGMENT_ALIASES, "alias string, public_id string")).select("c_custkey", "public_id")


@query("j21_page_route", "SELECT doc_id, coalesce(CASE doc_id % 10 WHEN 1 THEN 'cover' WHEN 2 THEN 'plan' END, CASE WHEN contains(lower(text), 'the ') THEN 'english' END) AS page_type FROM documents")
def j21(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 10).cast("int").alias("page_num"), "text")
    by_text = d.where(F.contains(F.lower("text"), F.lit("the "))).select("doc_id", F.lit("english").alias("page_type"))
    return label.page_route(d, spark.createDataFrame([(1, "cover"), (2, "plan")], "page_num int, page_type string"), by_text).select("doc_id", "page_type")


@query(
    "j23_better_of",
    """SELECT a.doc_key, CASE WHEN a.value = '' OR (b.v <> '' AND b.c > a.confidence_bp) THEN b.v ELSE a.value END AS value FROM v_field a JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderstatus END AS v, o_custkey % 9000 AS c FROM orders) b ON a.doc_key = b.k""",
)
def j23(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("long").alias("doc_key"), F.when(F.col("o_orderkey") % 4 == 0, "").otherwise(F.col("o_orderstatus")).alias("value"), (F.col("o_custkey") % 9000).alias("confidence"))
    return label.better_of(form_fields(spark, sf).select("doc_key", "value", F.col("confidence_bp").alias("confidence")), o, ["doc_key"]).select("doc_key", "value")


@query("fu5_group_coalesce", "SELECT doc_id, coalesce(max(CASE WHEN field_name = 'Proposer_PAN' THEN nullif(value, '') END), max(CASE WHEN field_name = 'Nominee_Name' THEN nullif(value, '') END)) AS id_text, max(CASE WHEN field_name = 'Sum_Assured' THEN nullif(nullif(value, ''), '0') END) AS sum_assured FROM v_field GROUP BY doc_id")
def fu5(spark, sf):
    p = form_fields(spark, sf).groupBy("doc_id").pivot("field_name", ["Proposer_PAN", "Nominee_Name", "Sum_Assured"]).agg(F.max(F.nullif("value", F.lit(""))))
    return p.select("doc_id", F.coalesce("Proposer_PAN", "Nominee_Name").alias("id_text"), F.nullif("Sum_Assured", F.lit("0")).alias("sum_assured"))


@query("fu11_widen_without_overlap")
def fu11(spark, sf):
    r = regions(spark, sf).select("doc_id", "page_num", F.col("region_id").alias("det_id"), *(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")))
    return label.widened(r).select("doc_id", "page_num", "det_id", *(e6(c).alias(f"{c}_e6") for c in ("x1", "y1", "x2", "y2")))


@query("q4_last_writer_bridge", "SELECT field_name, config_name FROM (VALUES ('first_name', 'LA_Full_Name'), ('age_years', 'LA_Age')) t(field_name, config_name)")
def q4(spark, sf):
    b = [(1, "Proposer_First_Name", "first_name"), (2, "Proposer_Age", "age_years"), (3, "LA_Full_Name", "first_name"), (4, "LA_Age", "age_years")]
    return fuse.last_writer(spark.createDataFrame(b, "ord int, config_name string, field_name string"))


@query(
    "f10_gibberish",
    r"""SELECT doc_id, coalesce(length(text) < 2 OR regexp_matches(text, '^[^a-zA-Z0-9\s]+\n?$') OR (length(text) >= 5 AND left(text, 5) = repeat(left(text, 1), 5) AND left(text, 1) NOT IN (chr(10), chr(13), chr(133), chr(8232), chr(8233)))
  OR regexp_matches(lower(text), '^[bcdfghjklmnpqrstvwxyz]{5,}\n?$') OR regexp_matches(lower(text), '^[aeiou]{5,}\n?$') OR lower(text) IN ('avelandian', 'linsularate', 'thelasthe', 'india', 'lhe', 'lhe_', 'tha', 'dhe', 'fhe', 'tand', 'tion', 'tion_', 'ing', 'ing_', 'nan', 'none', 'null'), true) AS bad FROM documents""",
)
def f10(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.is_gibberish(F.col("text")).alias("bad"))


@query("f11_repetition", "WITH c AS (SELECT ord, lower(text) AS t FROM v_teacher WHERE NOT regexp_matches(text, '[0-9]') AND length(text) >= 3) SELECT ord, list_max(list_transform(list_distinct(string_split(t, '')), lambda k: length(t) - length(replace(t, k, '')))) / length(t) > 0.4 AS rep FROM c")
def f11(spark, sf):
    t = teacher(spark, sf).where("NOT text RLIKE '[0-9]' AND length(text) >= 3")
    return t.select("ord", X.is_repetitive(F.col("text"), 0.4).alias("rep"))


@query("f12_variety", "SELECT ord, CAST(round(1e6 * len(list_filter(list_distinct(string_split(replace(lower(text), ' ', ''), '')), lambda x: x <> '')) / greatest(length(replace(text, ' ', '')), 1)) AS BIGINT) AS variety_e6 FROM v_teacher")
def f12(spark, sf):
    return teacher(spark, sf).select("ord", e6(X.variety(F.col("text"))).alias("variety_e6"))


@query("f3_weak_label_requests", "SELECT ord, CASE WHEN field_family = 'binary_mark' THEN 'YES/NO' ELSE 'TEXT' END AS expected FROM v_teacher WHERE ord % 13 <> 0")
def f3(spark, sf):
    return teacher(spark, sf).where("ord % 13 <> 0").select("ord", F.when(F.col("field_family") == "binary_mark", "YES/NO").otherwise("TEXT").alias("expected"))


@query(
    "f4_usable_pages",
    """WITH u AS (SELECT conv_id, turn, text, turn IN (2, 4) AS target, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS rn FROM conversations WHERE length(text) >= 50), t AS (SELECT *, max(CAST(target AS INT)) OVER (PARTITION BY conv_id) AS any_target FROM u)
 SELECT conv_id, turn, count(*) AS n FROM t WHERE target OR (any_target = 0 AND rn <= 5) GROUP BY conv_id, turn""",
)
def f4(spark, sf):
    u = table(spark, sf, "conversations").where("length(text) >= 50").withColumn("target", F.col("turn").isin(2, 4))
    w = Window.partitionBy("conv_id")
    u = u.withColumn("rn", F.row_number().over(w.orderBy("turn", "text"))).withColumn("any_target", F.max("target").over(w))
    return u.where("target OR (NOT any_target AND rn <= 5)").groupBy("conv_id", "turn").agg(F.count("*").alias("n"))


@query("f20_field_candidates", r"SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+'))) AS BIGINT) AS mails, regexp_matches(text, '[0-9]{12,}') AS long_numbers FROM documents")
def f20(spark, sf):
    mails = F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+)"), 1))
    return table(spark, sf, "documents").select("doc_id", F.size(mails).cast("long").alias("mails"), F.col("text").rlike("[0-9]{12,}").alias("long_numbers"))


@query("f22_meaningful_results", "SELECT doc_key FROM v_field WHERE status <> 'Rejected' OR length(value) > 3")
def f22(spark, sf):
    return form_fields(spark, sf).where("status <> 'Rejected' OR length(value) > 3").select("doc_key")


@query("s8_smart_title", "SELECT p_partkey, list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ') AS title FROM part")
def s8(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.smart_title(F.lower("p_name")).alias("title"))


@query("s6_soundex_variant", f"WITH k AS (SELECT qid, {NORM_KEY.format(c='raw_text')} AS norm FROM v_query) SELECT qid, array_to_string(list_transform(regexp_extract_all(norm, '[A-Z0-9]+'), lambda t: {SOUND}), ' ') AS codes FROM k")
def s6(spark, sf):
    return view(spark, sf, "v_query").select("qid", F.transform(X.tokens(X.name_key(F.col("raw_text"))), X.soundex).alias("codes")).select("qid", F.array_join("codes", " ").alias("codes"))


@query("s13_jaro_winkler", "SELECT qid, CAST(round(1e6 * jaro_winkler_similarity(raw_text, truth)) AS BIGINT) AS jw_e6 FROM v_query")
def s13(spark, sf):
    return view(spark, sf, "v_query").select("qid", e6(label.jaro_winkler_udf("raw_text", "truth")).alias("jw_e6"))


@query("s13_boosted_ratio")
def s13_boosted(spark, sf):
    return view(spark, sf, "v_query").select("qid", e6(label.boosted_ratio("raw_text", "truth")).alias("boosted_e6"))


@query("s14_fuzzy_vocabulary")
def s14(spark, sf):
    words = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("word")).distinct()
    v = table(spark, sf, "customer").select(F.expr("concat(substr(c_mktsegment, 1, 3 + c_custkey % 2), substr(c_mktsegment, 5 + c_custkey % 2))").alias("value"))
    return label.fuzzy_lookup(v, words).select("value", "resolved", "status", e6("score").alias("score_e6"))


@query("s15_prefix_search", "SELECT a.p_partkey, count(*) AS n FROM part a JOIN (SELECT DISTINCT substr(p_name, 1, 3) AS pre FROM part) b ON starts_with(a.p_name, b.pre) GROUP BY a.p_partkey")
def s15(spark, sf):
    p = table(spark, sf, "part")
    pre = p.select(F.substring("p_name", 1, 3).alias("pre")).distinct()
    return p.join(pre, (F.substring("p_name", 1, 3) == F.col("pre")) & F.col("p_name").startswith(F.col("pre"))).groupBy("p_partkey").agg(F.count("*").alias("n"))


@query("s20_aadhaar", f"WITH n AS (SELECT o_orderkey, {DIGITS11} || o_orderkey % 10 AS t FROM orders) SELECT o_orderkey, regexp_matches(t, '^[2-9]') AS well_formed, regexp_matches(t, '^[2-9]') AND {residue_sql('t')} = 0 AS valid FROM n")
def s20(spark, sf):
    n = F.lpad((F.col("o_orderkey") * 104729 + 275492384).cast("string"), 11, "3")
    a = R.aadhaar(F.concat(n, (F.col("o_orderkey") % 10).cast("string")))
    return table(spark, sf, "orders").select("o_orderkey", a["well_formed"].alias("well_formed"), a["valid"].alias("valid"))


@query("s21_clean_text", r"SELECT doc_id, md5(replace(upper(trim(regexp_replace(regexp_replace(coalesce(text, ''), '[^\p{L}\p{M}\p{Nd}_\s/.()\-]', '', 'g'), '\s+', ' ', 'g'))), 'ẞ', 'SS')) AS cleaned FROM documents")
def s21(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(R.cleaned(F.col("text")).cast("binary")).alias("cleaned"))


MARITAL = ["un-Unmarried!", "Marr ied Married", "widow", "?", "DIVORCED 2010", "single.", "re-divorcee", "mARRIED (2nd)", "x unmarr y", "", "Widower / single"]


@query(
    "s22_marital",
    f"""WITH t AS (SELECT event_id, upper(regexp_replace({MARITAL}[event_id % {len(MARITAL)} + 1], '[^A-Za-z0-9_ /.()-]', '', 'g')) AS u FROM events)
 SELECT event_id, CASE WHEN contains(u, 'UNMARR') THEN 'Unmarried' WHEN contains(u, 'MARR') THEN 'Married' WHEN contains(u, 'SINGLE') THEN 'Single' WHEN contains(u, 'DIVORC') THEN 'Divorced' WHEN contains(u, 'WIDOW') THEN 'Widowed' END AS status FROM t""",
)
def s22(spark, sf):
    text = F.element_at(F.array(*map(F.lit, MARITAL)), (F.col("event_id") % len(MARITAL) + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", R.marital(text).alias("status"))


@query(
    "s25_extractors",
    r"""WITH t AS (SELECT ord, text, regexp_extract_all(text, '[0-9]+') AS n FROM v_teacher) SELECT ord, nullif(regexp_extract(replace(upper(text), ' ', ''), '[A-Z]{5}[0-9]{4}[A-Z]'), '') AS pan,
 CASE WHEN len(n) >= 3 THEN lpad(n[1], CAST(greatest(2, length(n[1])) AS INTEGER), '0') || '/' || lpad(n[2], CAST(greatest(2, length(n[2])) AS INTEGER), '0') || '/' || n[3] END AS d FROM t""",
)
def s25(spark, sf):
    return teacher(spark, sf).select("ord", R.pan(F.col("text")).alias("pan"), R.date_text(F.col("text")).alias("d"))


@query("s26_forensic_router")
def s26(spark, sf):
    """Fields under ids and labels; values of names by the lexicon's decisions stand in the last quarter."""
    k = F.col("ord") % 8
    t = teacher(spark, sf).select("ord", F.when(k == 0, "Place of Birth").when(k == 1, "address_state").when(k == 2, "Sex").otherwise(F.col("field_name")).alias("field_name"), F.when(k == 0, F.element_at(F.array(*map(F.lit, PLACES)), (F.col("ord") % 5 + 1).cast("int"))).when(k == 1, "Gujrat").when(k == 2, "femal").otherwise(F.col("text")).alias("text"))
    d = F.when(k >= 6, F.struct(F.lit(True).alias("accepted"), F.upper("text").alias("resolved_text"), F.lit(0.9).alias("confidence"), F.lit("lexicon_exact").alias("method"), F.lit(False).alias("review_required")))
    out = D.routed(t.withColumn("decision", d), decision="decision")
    return out.select("ord", "routed.field", "routed.value", e6("routed.confidence").alias("confidence_e6"), "routed.status", "routed.method")


PLACES = ["Mumbai", "poona", "Kolkatta", "Xyz", "bangalor", ""]


@query("s34_floored_confidence")
def s34(spark, sf):
    k = F.col("ord") % 5
    name = F.when(k == 0, "address_pincode").when(k == 1, "address_city").when(k == 2, "occupation").when(k == 3, "gender_mark").otherwise("first_name")
    text = F.when(k == 0, F.concat(F.lit("Pin "), (F.col("ord") % 8 * 100_000 + 12_345).cast("string"))).when(k == 1, F.element_at(F.array(*map(F.lit, PLACES)), (F.col("ord") % 6 + 1).cast("int"))).when(k == 2, F.when(F.col("ord") % 2 == 0, "sales man").otherwise("Servise")).when(k == 3, F.when(F.col("ord") % 2 == 0, "femal").otherwise("x")).otherwise(F.col("text"))
    return teacher(spark, sf).select("ord", D.floored(name, text, F.col("confidence")).alias("r")).select("ord", "r.value", e6("r.confidence").alias("confidence_e6"))


@query("s38_ocr_digits", "SELECT ord, translate(text, 'lOo', '100') AS t FROM v_teacher")
def s38(spark, sf):
    return teacher(spark, sf).select("ord", X.fix_ocr_digits(F.col("text")).alias("t"))


@query("s39_length_penalty", "SELECT ord, CAST(round(1e6 * CASE WHEN length(trim(text)) <> 10 THEN greatest(confidence_bp / 10000.0 - 0.3, 0) ELSE confidence_bp / 10000.0 END) AS BIGINT) AS confidence_e6 FROM v_teacher")
def s39(spark, sf):
    return teacher(spark, sf).select("ord", e6(R.length_penalty(F.col("confidence"), F.col("text"), F.lit("pan"))).alias("confidence_e6"))


@query("s40_name_fields", "SELECT DISTINCT field_name, regexp_matches(lower(field_name), 'name|father|mother|spouse|nominee|appointee|employer|agent') AS is_name FROM v_teacher")
def s40(spark, sf):
    return teacher(spark, sf).select("field_name", R.is_name_field(F.col("field_name")).alias("is_name")).distinct()


@query("s44_box_parse", "SELECT region_id, x1, y1, x2, y2 FROM v_region")
def s44(spark, sf):
    text = F.concat(F.lit('{"bbox_2d": ['), F.concat_ws(", ", "x1", "y1", "x2", "y2"), F.lit("]}"))
    r = regions(spark, sf).withColumn("b", R.box_of(text, F.lit(100000), F.lit(100000)))
    over = F.array_max(F.array("x2", "y2")) > 1000
    part = lambda k: F.when(over, F.get("b", F.lit(k))).otherwise(F.floor(F.get("b", F.lit(k)) / 100).cast("int"))
    return r.select("region_id", *(part(k).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))))


@query("s50_box_to_pixels", "SELECT region_id, CAST(greatest(floor((x1 / 1100.0 - 0.006) * 1100), 0) AS BIGINT) AS px1, CAST(least(floor((y2 / 1400.0 + 0.006) * 1400), 1400) AS BIGINT) AS py2 FROM v_region")
def s50(spark, sf):
    b = F.struct((F.col("x1") / F.lit(1100.0)).alias("x1"), (F.col("y1") / F.lit(1400.0)).alias("y1"), (F.col("x2") / F.lit(1100.0)).alias("x2"), (F.col("y2") / F.lit(1400.0)).alias("y2"))
    p = G.to_pixels(b, F.lit(1100), F.lit(1400))
    return regions(spark, sf).select("region_id", p["x1"].cast("long").alias("px1"), p["y2"].cast("long").alias("py2"))


@query("s54_percent_coordinates", "SELECT region_id, printf('%.2f', x1 * 100 / 1100.0) AS left_pc FROM v_region")
def s54(spark, sf):
    return regions(spark, sf).select("region_id", R.percent(F.col("x1"), F.lit(1100.0)).alias("left_pc"))


@query("s56_homography_box", "SELECT region_id, CAST(greatest(floor(2 * x1 + 10), 0) AS BIGINT) AS x1, CAST(least(ceil(2 * y2 - 5), 2800) AS BIGINT) AS y2 FROM v_region")
def s56(spark, sf):
    h = F.array(*map(F.lit, (2.0, 0.0, 10.0, 0.0, 2.0, -5.0, 0.0, 0.0, 1.0)))
    b = R.back_mapped(h, F.col("rbox"), F.lit(2200), F.lit(2800))
    return regions(spark, sf).select("region_id", b["x1"].cast("long").alias("x1"), b["y2"].cast("long").alias("y2"))


@query("s63_crop_text", "SELECT doc_id, page_num, coalesce(string_agg(CASE WHEN lang = 'en' THEN text END, ' ' ORDER BY y1, x1, region_id), string_agg(CASE WHEN lang = 'hi' THEN text END, ' ' ORDER BY y1, x1, region_id)) AS line FROM v_region GROUP BY doc_id, page_num")
def s63(spark, sf):
    of = lambda code: F.sort_array(F.collect_list(F.when(F.col("lang") == code, F.struct("y1", "x1", "region_id", "text"))))
    g = regions(spark, sf).groupBy("doc_id", "page_num").agg(of("en").alias("e"), of("hi").alias("h"))
    text = lambda c: F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda x: x["text"]), " "))
    return g.select("doc_id", "page_num", F.coalesce(text("e"), text("h")).alias("line"))


@query("s42_cot_answer", "SELECT event_id, event_type AS value, CAST(CASE WHEN event_id % 2 = 0 THEN 0.9 ELSE 0.4 END AS DOUBLE) AS confidence FROM events")
def s42(spark, sf):
    good = F.concat(F.lit('I think {"value": " '), "event_type", F.lit('", "confidence": 0.9} so'))
    broken = F.concat(F.lit('I think {"value": "'), "event_type", F.lit('", oops'))
    return table(spark, sf, "events").select("event_id", P.answer(F.when(F.col("event_id") % 2 == 0, good).otherwise(broken)).alias("a")).select("event_id", "a.*")


@query("a7_accuracy_stats", "SELECT count(*) AS total, count(*) FILTER (WHERE confidence_bp >= 8500) AS high, count(*) FILTER (WHERE status = 'Low Confidence') AS low, count(*) FILTER (WHERE value = '') AS failed FROM v_field")
def a7(spark, sf):
    return form_fields(spark, sf).agg(F.count("*").alias("total"), F.count_if(F.col("confidence") >= 0.85).alias("high"), F.count_if(F.col("status") == "Low Confidence").alias("low"), F.count_if(F.col("value") == "").alias("failed"))


@query("a8_batch_stats", "WITH g AS (SELECT doc_id, count(*) AS n FROM v_field WHERE value <> '' GROUP BY doc_id) SELECT count(*) AS forms, CAST(round(1e6 * avg(n)) AS BIGINT) AS fields_e6 FROM g")
def a8(spark, sf):
    return form_fields(spark, sf).where("value <> ''").groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("forms"), e6(F.avg("n")).alias("fields_e6"))


@query("a11_sample_summary", "SELECT lang, count(*) AS n, min(n_chars) AS least, max(n_chars) AS most, CAST(round(1e6 * avg(n_chars)) AS BIGINT) AS mean_e6 FROM documents GROUP BY lang")
def a11(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), e6(F.avg("n_chars")).alias("mean_e6"))


@query("a12_template_summary", "SELECT page_num, count(*) AS n, string_agg(fname, ',' ORDER BY ford) AS names FROM v_template GROUP BY page_num")
def a12(spark, sf):
    t = view(spark, sf, "v_template").groupBy("page_num").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("ford", "fname"))).alias("f"))
    return t.select("page_num", "n", F.array_join(F.transform("f", lambda x: x["fname"]), ",").alias("names"))


@query("a13_document_summary", "SELECT doc_id, count(*) FILTER (WHERE value <> '') AS extracted, count(*) FILTER (WHERE value = '') AS missing, count(*) FILTER (WHERE value <> '' AND confidence_bp < 7000) AS needs_review FROM v_field GROUP BY doc_id")
def a13(spark, sf):
    has = F.col("value") != ""
    return form_fields(spark, sf).groupBy("doc_id").agg(F.count_if(has).alias("extracted"), F.count_if(~has).alias("missing"), F.count_if(has & (F.col("confidence") < 0.7)).alias("needs_review"))


@query("a14_audit_listing", "SELECT page_num, count(*) AS n, string_agg(DISTINCT text, ',' ORDER BY text) AS texts FROM v_region WHERE confidence_bp > 9000 GROUP BY page_num")
def a14(spark, sf):
    g = regions(spark, sf).where("confidence > 0.9").groupBy("page_num").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("text")), ",").alias("texts"))
    return g


@query("a16_sequence_confidence", "SELECT event_id, CAST(round(1e6 * (greatest((event_id % 7) / 10.0, 0.3) + greatest(0.1 * (event_id % 10), 0.5)) / 2) AS BIGINT) AS c_e6 FROM events")
def a16(spark, sf):
    steps = F.array(F.array(F.col("event_id") % 7 / F.lit(10.0), F.lit(0.3)), F.array(F.lit(0.1) * (F.col("event_id") % 10), F.lit(0.5)))
    return table(spark, sf, "events").select("event_id", e6(score.sequence_confidence(steps)).alias("c_e6"))


@query("a17_pipeline_statistics", "SELECT status, count(*) FILTER (WHERE confidence_bp >= 8000) AS high, count(*) FILTER (WHERE confidence_bp < 5000) AS low FROM v_field GROUP BY status")
def a17(spark, sf):
    return form_fields(spark, sf).groupBy("status").agg(F.count_if(F.col("confidence") >= 0.8).alias("high"), F.count_if(F.col("confidence") < 0.5).alias("low"))


@query(
    "w4_value_column",
    "WITH o AS (SELECT l_orderkey, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) SELECT l_orderkey, l_partkey FROM o WHERE (n >= 3 AND rn = 3) OR (n = 2 AND rn = 2)",
)
def w4(spark, sf):
    w = Window.partitionBy("l_orderkey")
    o = table(spark, sf, "lineitem").withColumn("rn", F.row_number().over(w.orderBy("l_linenumber", "l_partkey", "l_suppkey"))).withColumn("n", F.count("*").over(w))
    return o.where("(n >= 3 AND rn = 3) OR (n = 2 AND rn = 2)").select("l_orderkey", "l_partkey")


@query("w7_margin", "WITH r AS (SELECT id, confidence_bp, row_number() OVER (PARTITION BY id ORDER BY confidence_bp DESC, ord) AS rn FROM v_teacher) SELECT id, max(CASE WHEN rn = 1 THEN confidence_bp END) - coalesce(max(CASE WHEN rn = 2 THEN confidence_bp END), 0) AS margin FROM r GROUP BY id")
def w7(spark, sf):
    top = teacher(spark, sf).groupBy("id").agg(F.slice(F.sort_array(F.collect_list("confidence_bp"), asc=False), 1, 2).alias("t"))
    return top.select("id", (F.get("t", F.lit(0)) - F.coalesce(F.get("t", F.lit(1)), F.lit(0))).alias("margin"))


@query("t3_surest_first", "SELECT region_id, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY confidence_bp DESC, region_id) AS place FROM v_region")
def t3(spark, sf):
    w = Window.partitionBy("doc_id", "page_num").orderBy(F.desc("confidence"), "region_id")
    return regions(spark, sf).select("region_id", F.row_number().over(w).alias("place"))


@query("t7_bilingual_union", "SELECT doc_id, page_num, text FROM v_region WHERE lang = 'en' UNION SELECT doc_id, page_num, text FROM v_region WHERE lang = 'hi'")
def t7(spark, sf):
    r = regions(spark, sf)
    return r.where("lang = 'en'").select("doc_id", "page_num", "text").unionByName(r.where("lang = 'hi'").select("doc_id", "page_num", "text")).distinct()


@query("t8_expected_minus_found", "SELECT DISTINCT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def t8(spark, sf):
    return table(spark, sf, "part").select("p_partkey").distinct().join(table(spark, sf, "lineitem").where("l_quantity > 45"), F.col("p_partkey") == F.col("l_partkey"), "left_anti")


@query("t11_first_of_listed", "SELECT min(ord) AS ord, field_family FROM v_teacher WHERE field_family IN ('date', 'amount') GROUP BY field_family")
def t11(spark, sf):
    return dataset.first_of_each(teacher(spark, sf).where("field_family IN ('date', 'amount')"), "field_family", "ord", 1).select("ord", "field_family")


@query("g1_synthetic_records", f"WITH {IDS_SQL}, {RECORDS_SQL} SELECT * FROM rec")
def g1(spark, sf):
    return records(spark, sf).select("record_id", "gender", "last_name", "first_name", "spouse_full_name", "address_city", "address_pincode", F.col("annual_income").cast("long").alias("annual_income"), F.col("premium").cast("long").alias("premium"), F.col("sum_assured").cast("long").alias("sum_assured"), "date_of_birth")


@query(
    "g6_factory_summary",
    f"WITH {IDS_SQL}, {RECORDS_SQL}, s AS (SELECT record_id, row_number() OVER (ORDER BY {pick_sql(1 << 32, '42', 'record_id')}, record_id) <= greatest(1, (SELECT count(*) FROM rec) * 10 // 100) AS v FROM rec), f AS (SELECT unnest(['first_name', 'address_city', 'annual_income']) AS field_name) SELECT CASE WHEN v THEN 'val' ELSE 'train' END AS split, field_name, count(*) AS n FROM s, f GROUP BY 1, 2",
)
def g6(spark, sf):
    crops = dataset.crops_of(records(spark, sf).withColumnRenamed("id", "record"), ["first_name", "address_city", "annual_income"], "record")
    return dataset.split_exact(crops, "record", name="record_id").groupBy("split", "field_name").agg(F.count("*").alias("n"))


@query("src12_polygon_adapter", "SELECT region_id, x1, y1, x2, y2 FROM v_region")
def src12(spark, sf):
    c = lambda x, y: F.array(F.col(x).cast("double"), F.col(y).cast("double"))
    poly = F.array(c("x2", "y1"), c("x1", "y1"), c("x1", "y2"), c("x2", "y2"))
    r = regions(spark, sf).select("doc_id", "page_num", "lang", F.array("text").alias("texts"), F.array("confidence").alias("scores"), F.array(poly).alias("polys"), F.col("region_id").alias("rid"))
    out = files.polygons(r.withColumn("doc_id", F.col("rid")))
    return out.select(F.col("doc_id").alias("region_id"), "bbox.x1", "bbox.y1", "bbox.x2", "bbox.y2")


@query("src13_layout_adapter", "SELECT doc_id, count(*) AS n FROM v_region WHERE region_id % 5 <> 0 GROUP BY doc_id")
def src13(spark, sf):
    block = F.struct(F.lit("text").alias("label"), F.when(F.col("region_id") % 5 == 0, " ").otherwise(F.col("text")).alias("text"), F.array("x1", "y1", "x2", "y2").alias("bbox"))
    r = regions(spark, sf).groupBy("doc_id", "page_num").agg(F.collect_list(block).alias("blocks"))
    return files.layout_blocks(r).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("src21_page_spec", "SELECT region_id FROM v_region WHERE page_num IN (1, 3, 4, 5)")
def src21(spark, sf):
    return regions(spark, sf).where(F.col("page_num").isin(files.page_spec("1,3-5"))).select("region_id")


@query(
    "s33_family_penalties",
    r"""WITH p AS (SELECT ord, field_family, field_name, confidence_bp / 10000.0 AS c, CASE field_family WHEN 'numeric' THEN regexp_replace(text, '[^0-9]', '', 'g') WHEN 'amount' THEN regexp_replace(text, '[^0-9]', '', 'g')
   WHEN 'date' THEN coalesce(nullif(translate(regexp_extract(replace(text, ' ', ''), '[0-9]{1,2}[/.\-][0-9]{1,2}[/.\-][0-9]{2,4}'), '.-', '//'), ''), replace(text, ' ', '')) WHEN 'short_id' THEN upper(regexp_replace(text, '[^A-Za-z0-9]', '', 'g'))
   WHEN 'binary_mark' THEN CASE WHEN regexp_matches(lower(text), 'yes|ha|हाँ|✓|tick|checked') THEN 'YES' WHEN regexp_matches(lower(text), 'no|nahi|नहीं|unchecked') THEN 'NO' ELSE trim(text) END ELSE trim(text) END AS value FROM v_teacher)
 SELECT ord, value, CAST(round(1e6 * CASE WHEN value = '' THEN 0 WHEN field_family IN ('numeric', 'amount') AND NOT regexp_matches(value, '[0-9]') THEN greatest(0.1, c * 0.3) WHEN field_name = 'pan_number' AND NOT regexp_matches(value, '^[A-Z]{5}[0-9]{4}[A-Z]$') THEN least(1.0, c * 0.7) ELSE least(1.0, c) END) AS BIGINT) AS confidence_e6 FROM p""",
)
def s33(spark, sf):
    f, n = F.col("field_family"), F.col("field_name")
    v = R.by_family(f, n, F.col("text"))
    return teacher(spark, sf).select("ord", v.alias("value"), e6(R.family_confidence(f, n, v, F.col("confidence"))).alias("confidence_e6"))
