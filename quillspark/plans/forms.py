"""Queries of sources and sinks, label dictionaries, table readers, verification and checks on metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dictionary as D
from ..functions import geometry as G
from ..functions import parse as P
from ..functions import repair as R
from ..functions import text as X
from ..operators import dataset, label, match, resolve, score
from ..sources import files
from .registry import e6, form_fields, query, regions, table, teacher
from .views import DIGITS11, pick_sql, residue_sql, view


@query("src1_jsonl_scan", "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS note FROM orders")
def src1(spark, sf):
    """SRC1 and SRC3: a manifest written with its nulls and read again."""
    path = files.scratch(spark, "manifest")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("note"))
    files.write_jsonl(o, path)
    return files.read_jsonl(spark, path, o.schema, strict=True)


@query("src2_permissive_scan", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 7 <> 0")
def src2(spark, sf):
    path = files.scratch(spark, "broken")
    line = F.to_json(F.struct("o_orderkey", "o_orderstatus"))
    table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("oops "), line)).otherwise(line).alias("value")).write.text(path)
    return files.read_jsonl(spark, path, "o_orderkey long, o_orderstatus string")


@query("src4_gold_sheet", "SELECT doc_key, value AS gold_text FROM v_field WHERE value <> ''")
def src4(spark, sf):
    """SRC4 and SRC5: a sheet with a header, of which labelled rows count."""
    path = files.scratch(spark, "gold")
    files.write_csv(form_fields(spark, sf).select("doc_key", F.col("value").alias("gold_text")), path)
    return files.read_gold(spark, path).select(F.col("doc_key").cast("long").alias("doc_key"), "gold_text")


@query("src6_lexicons", "SELECT 'names' AS category, p_name AS text, count(*) AS frequency FROM part GROUP BY p_name UNION ALL SELECT 'segments', c_mktsegment, count(*) FROM customer GROUP BY c_mktsegment UNION ALL SELECT 'brands', p_brand, count(*) FROM part GROUP BY p_brand")
def src6(spark, sf):
    """A folder with a list of lines, a sheet with counts and a JSON object; equal texts are summed."""
    path = files.scratch(spark, "lexicons")
    p, c = table(spark, sf, "part"), table(spark, sf, "customer")
    p.select("p_name").write.text(f"{path}/a")
    p.groupBy(F.col("p_brand").alias("value")).agg(F.count("*").alias("count")).write.option("header", True).csv(f"{path}/b")
    c.groupBy("c_mktsegment").agg(F.count("*").alias("n")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("c_mktsegment", "n")))).alias("value")).write.text(f"{path}/c")
    for part, name, suffix in (("a", "names", "txt"), ("b", "brands", "csv"), ("c", "segments", "json")):
        files.gather(spark, f"{path}/{part}", f"{path}/all", f"{name}.{suffix}")
    return files.read_lexicons(spark, f"{path}/all").groupBy(F.regexp_replace("category", "-[0-9]+$", "").alias("category"), "text").agg(F.sum("frequency").alias("frequency"))


@query("src9_result_store", "SELECT doc_id, field_name, value, status FROM v_field")
def src9(spark, sf):
    path = files.scratch(spark, "results")
    files.write_results(form_fields(spark, sf).select("doc_id", "field_name", "value", "status"), path, by="field_name")
    return files.read_results(spark, path, "doc_id long, field_name string, value string, status string").where("_corrupt_record IS NULL").drop("_corrupt_record")


@query("src10_flat_fields", "SELECT doc_id, doc_key, field_name, value, confidence_bp, status FROM v_field")
def src10(spark, sf):
    path = files.scratch(spark, "flat")
    f = form_fields(spark, sf).select("doc_id", "doc_key", "field_name", "value", "confidence_bp", "status")
    files.write_csv(f, path)
    return spark.read.option("header", True).option("escape", '"').option("emptyValue", "").schema(f.schema).csv(path).fillna("", ["value"])


@query("src11_partial_writes", "SELECT page_num, count(*) AS n, sum(CASE WHEN page_num <= 2 THEN 2 ELSE 1 END) AS turns FROM v_region WHERE page_num <= 4 GROUP BY page_num")
def src11(spark, sf):
    """Pages written in turns: the first two are written twice and count once."""
    path = files.scratch(spark, "partial")
    r = regions(spark, sf).select(F.lit(1).alias("doc_id"), "page_num", "region_id")
    for turn, most in ((1, 2), (2, 4)):
        files.write_partial(r.where(F.col("page_num") <= most).withColumn("turn", F.when(F.col("page_num") <= 2, F.lit(turn)).otherwise(F.lit(1))), path)
    return spark.read.schema("region_id long, turn int, doc_id int, page_num int").json(path).groupBy("page_num").agg(F.count("*").alias("n"), F.sum("turn").alias("turns"))


@query("src14_page_dumps", "SELECT doc_id, page_num, '# Page ' || page_num || chr(10) || chr(10) || string_agg('[' || lang || '] ' || text || chr(10) || chr(10), '' ORDER BY region_id) AS markdown, count(*) AS n FROM v_region GROUP BY doc_id, page_num")
def src14(spark, sf):
    r = regions(spark, sf).select("doc_id", "page_num", "region_id", F.col("lang").alias("label"), "text")
    d = files.page_dumps(r)
    return d.select("doc_id", "page_num", "markdown", F.get_json_object("json", "$.num_regions").cast("long").alias("n"))


@query(
    "src18_box_store",
    """WITH w AS (SELECT region_id AS ord, page_num, 'f' || (region_id % 5) AS f, x1, y1, x2, y2 FROM v_region), l AS (SELECT *, row_number() OVER (PARTITION BY page_num, f ORDER BY ord DESC) AS rn FROM w)
 SELECT page_num, f AS field_name, CAST(round_even(x1 * CAST(1650 AS DOUBLE) / 1100, 0) AS INT) AS x1, CAST(round_even(y1 * CAST(2100 AS DOUBLE) / 1400, 0) AS INT) AS y1, CAST(round_even(x2 * CAST(1650 AS DOUBLE) / 1100, 0) AS INT) AS x2, CAST(round_even(y2 * CAST(2100 AS DOUBLE) / 1400, 0) AS INT) AS y2 FROM l WHERE rn = 1""",
)
def src18(spark, sf):
    r = regions(spark, sf)
    w = r.select(F.col("region_id").alias("ord"), "page_num", F.lit(1100).alias("width"), F.lit(1400).alias("height"), F.concat(F.lit("f"), (F.col("region_id") % 5).cast("string")).alias("field_name"), "x1", "y1", "x2", "y2", "confidence")
    sizes = r.select("page_num").distinct().select(F.lit(1).alias("doc_id"), "page_num", F.lit(1650).alias("page_width"), F.lit(2100).alias("page_height"))
    return files.scaled_boxes(files.stored_boxes(w), sizes).drop("doc_id")


@query("src22_document_dumps", "SELECT doc_id, count(DISTINCT page_num) AS total_pages, count(*) FILTER (WHERE lang = 'hi' AND page_num = first) AS n_first FROM (SELECT *, min(page_num) OVER (PARTITION BY doc_id) AS first FROM v_region) GROUP BY doc_id")
def src22(spark, sf):
    r = regions(spark, sf).select("doc_id", "page_num", "region_id", "text", "confidence", "lang", "rbox")
    pages = r.select("doc_id", "page_num").distinct().select("doc_id", "page_num", F.lit(1100).alias("width"), F.lit(1400).alias("height"), F.lit(0.25).alias("seconds"))
    d = files.document_dumps(r, pages, "hi")
    return d.select("doc_id", F.col("total_pages").cast("long").alias("total_pages"), F.get_json_object("json", "$.pages[0].num_regions").cast("long").alias("n_first"))


@query("f1_blankness", "SELECT region_id, (region_id % 40) / 1000.0 < 0.015 AND region_id % 33 < 20 AS is_blank FROM v_region")
def f1(spark, sf):
    k = F.col("region_id")
    return regions(spark, sf).select("region_id", dataset.is_blank(k % 40 / F.lit(1000.0), (k % 33).cast("double")).alias("is_blank"))


@query("f2_non_blank", "SELECT region_id FROM v_region WHERE NOT ((region_id % 40) / 1000.0 < 0.015 AND region_id % 33 < 20)")
def f2(spark, sf):
    k = F.col("region_id")
    return regions(spark, sf).where(~dataset.is_blank(k % 40 / F.lit(1000.0), (k % 33).cast("double"))).select("region_id")


ALIASES = [(1, "First Name", "first_name", True), (2, "given-name", "first_name", True), (3, "last name", "last_name", True), (4, "DOB", "date_of_birth", True), (5, "date_of_birth", "date_of_birth", True), (6, "marital_status", "marital_status", True), (7, "address line 1", "address_line1", True), (8, "signature", "signature", False)]


@query(
    "f17_requested_fields",
    """SELECT c_custkey AS request_id, CASE c_custkey % 4 WHEN 0 THEN 'last_name,first_name' WHEN 1 THEN 'first_name,last_name,date_of_birth,marital_status,address_line1' WHEN 2 THEN 'first_name,last_name,date_of_birth,marital_status,address_line1' ELSE 'date_of_birth' END AS field_ids, CASE c_custkey % 4 WHEN 3 THEN 1 ELSE 0 END AS n_unknown FROM customer""",
)
def f17(spark, sf):
    k = F.col("c_custkey") % 4
    r = table(spark, sf, "customer").select(F.col("c_custkey").alias("request_id"), F.when(k == 0, "LAST-NAME, first name,given name").when(k == 1, "").when(k == 2, "dob").otherwise("dob,, nothing, signature").alias("fields"), F.when(k == 2, "surgical25").alias("bundle"))
    out = label.requested_fields(r, spark.createDataFrame(ALIASES, "ord int, alias string, public_id string, supported boolean"))
    return out.select("request_id", F.array_join("field_ids", ",").alias("field_ids"), F.size("unknown").alias("n_unknown"))


@query(
    "j5_simple_verification",
    """WITH v AS (SELECT DISTINCT doc_id, page_num, CASE doc_id % 3 WHEN 0 THEN 'o' || (doc_id % 97) WHEN 1 THEN 'F1' ELSE 'some printed words' END AS value FROM v_region),
 m AS (SELECT v.*, r.region_id, lower(v.value) AS a, lower(trim(r.text)) AS b, r.confidence_bp / 10000.0 AS c FROM v JOIN v_region r ON v.doc_id = r.doc_id AND v.page_num = r.page_num),
 s AS (SELECT *, contains(a, b) OR contains(b, a) AS inside, len(list_filter(list_distinct(string_split(a, '')), lambda x: contains(b, x))) AS same, len(list_distinct(string_split(a || b, ''))) AS either FROM m),
 t AS (SELECT *, CASE WHEN a = b THEN 0.95 WHEN inside AND same / either > 0.6 THEN 0.85 END AS borne, CASE WHEN a = b THEN c WHEN inside THEN 0.7 * least(length(a), length(b)) / greatest(length(a), length(b)) * c END AS box FROM s)
 SELECT doc_id, page_num, value, CAST(round(100 * coalesce(arg_min(borne, region_id) FILTER (WHERE borne IS NOT NULL), CASE WHEN regexp_matches(value, '[0-9]') OR len(string_split(value, ' ')) <= 2 THEN 0.7 ELSE 0.5 END)) AS BIGINT) AS confidence_e2,
  first(region_id ORDER BY round(box, 12) DESC, region_id) FILTER (WHERE box > 0.3) AS box_region_id FROM t GROUP BY doc_id, page_num, value""",
)
def j5(spark, sf):
    r, k = regions(spark, sf), F.col("doc_id")
    value = F.when(k % 3 == 0, F.concat(F.lit("o"), (k % 97).cast("string"))).when(k % 3 == 1, "F1").otherwise("some printed words")
    v = r.select("doc_id", "page_num").distinct().withColumn("field", F.lit("f")).withColumn("value", value)
    return match.simply_verified(v, r).select("doc_id", "page_num", "value", F.round(F.col("confidence") * 100).cast("long").alias("confidence_e2"), "box_region_id")


_LABEL_CASES = " ".join(f"WHEN regexp_matches(l, '{'|'.join('(?:' + p.replace(chr(39), chr(39) * 2) + ')' for p in patterns)}') THEN '{field}'" for field, _, patterns in D.LABELS)
_WORDED = "SELECT p_partkey, lower(trim(p_name || ' ' || CASE p_partkey % 8 WHEN 0 THEN 'Date of Birth' WHEN 1 THEN 'Age (last)' WHEN 2 THEN 'S/O' WHEN 3 THEN 'Zip' WHEN 4 THEN 'E-Mail' WHEN 5 THEN 'Wt. in Kgs' WHEN 6 THEN 'Rs. 5' ELSE '' END)) AS l FROM part"


@query("j9_label_field", f"SELECT p_partkey, CASE {_LABEL_CASES} END AS field FROM ({_WORDED})")
def j9(spark, sf):
    k = F.col("p_partkey") % 8
    tail = F.lit("")
    for n, words in enumerate(("Date of Birth", "Age (last)", "S/O", "Zip", "E-Mail", "Wt. in Kgs", "Rs. 5")):
        tail = F.when(k == n, words).otherwise(tail)
    return table(spark, sf, "part").select("p_partkey", D.label_field(F.concat_ws(" ", "p_name", tail)).alias("field"))


@query("j18_box_title_merge")
def j18(spark, sf):
    k = F.col("region_id") % 3
    r = regions(spark, sf).select("doc_id", "page_num", F.col("region_id").alias("det_id"), F.when(k == 0, "title").when(k == 1, "table").otherwise("chart").alias("kind"), *((F.col(c) / F.lit(1100.0 if c[0] == "x" else 1400.0)).alias(c) for c in ("x1", "y1", "x2", "y2")))
    m = label.merged_with_titles(r)
    return m.select("doc_id", "page_num", "det_id", *(e6(c).alias(f"{c}_e6") for c in ("x1", "y1", "x2", "y2")), F.size("titles").alias("n_titles"))


_NAMES = ("first_name", "Proposer_Full_Name", "branch_office", "plan_name_2", "spouse", "pan_number", "")


@query("s11_lexicon_routes", "SELECT ord, CASE ord % 7 WHEN 0 THEN 'person_token' WHEN 2 THEN 'employer_name' WHEN 3 THEN 'plan_name' WHEN 1 THEN 'person_full,person_token' WHEN 4 THEN 'person_full,person_token' ELSE '' END AS categories FROM v_teacher")
def s11(spark, sf):
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("ord") % 7 + 1).cast("int"))
    return teacher(spark, sf).select("ord", F.array_join(D.lexicon_categories(name), ",").alias("categories"))


@query("s12_matching_blocks")
def s12(spark, sf):
    return view(spark, sf, "v_query").select("qid", e6(resolve.ratio("raw_text", "truth")).alias("ratio_e6"))


@query("s17_edit_similarity", "SELECT qid, CAST(round(1e6 * (1 - levenshtein(raw_text, truth) / CAST(greatest(length(raw_text), length(truth)) AS DOUBLE))) AS BIGINT) AS similarity_e6 FROM v_query")
def s17(spark, sf):
    return view(spark, sf, "v_query").select("qid", e6(X.levenshtein_similarity(F.col("raw_text"), F.col("truth"))).alias("similarity_e6"))


@query("s23_places")
def s23(spark, sf):
    names = [*D.CITIES, *D.STATES]
    n = table(spark, sf, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % len(names) + 1).cast("int")).alias("text"))
    at = (F.col("p_partkey") % 5 + 1).cast("int")
    spelt = F.concat(F.substring("text", F.lit(1), at), F.substring(F.col("text"), at + 2, F.lit(99)))
    return n.select("p_partkey", D.city(spelt).alias("city"), D.state(spelt).alias("state"))


@query("s24_occupations")
def s24(spark, sf):
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("self "), F.element_at(F.array(*map(F.lit, D.OCCUPATIONS)), (F.col("p_partkey") % 10 + 1).cast("int")))).when(F.col("p_partkey") % 3 == 1, "Studnt").otherwise(F.col("p_type"))
    return table(spark, sf, "part").select("p_partkey", D.occupation(text).alias("occupation"))


@query("s19_check_digit", f"WITH n AS (SELECT o_orderkey, {DIGITS11} AS t FROM orders), d AS (SELECT o_orderkey, CAST(k AS STRING) AS digit, t || k AS whole FROM n, range(10) r(k)) SELECT o_orderkey, digit FROM d WHERE {residue_sql('whole')} = 0")
def s19(spark, sf):
    n = F.lpad((F.col("o_orderkey") * 104729 + 275492384).cast("string"), 11, "3")
    return table(spark, sf, "orders").select("o_orderkey", R.verhoeff_digit(n).alias("digit"))


@query(
    "s35_extracted_values",
    r"""WITH t AS (SELECT ord, CASE ord % 5 WHEN 0 THEN 'birth_date' WHEN 1 THEN 'pin' WHEN 2 THEN 'pan' WHEN 3 THEN 'full_name' ELSE 'other' END AS f, ': ' || text || ' -' AS raw FROM v_teacher), c AS (SELECT ord, f, trim(regexp_replace(regexp_replace(raw, '^[:\-*.]\s*', ''), '\s*[:\-*.]$', '')) AS t FROM t),
 v AS (SELECT ord, f, trim(CASE f WHEN 'birth_date' THEN coalesce(nullif(regexp_extract(t, '[0-9\-./]+'), ''), t) WHEN 'pin' THEN coalesce(nullif(regexp_extract(t, '[0-9]{6}'), ''), t) WHEN 'pan' THEN coalesce(nullif(regexp_extract(upper(t), '[A-Z]{5}[0-9]{4}[A-Z]'), ''), t) WHEN 'full_name' THEN regexp_replace(t, '[^\p{L}\p{M}\p{Nd}_\s.]', '', 'g') ELSE t END) AS value FROM c)
 SELECT ord, value, CASE f WHEN 'birth_date' THEN CASE WHEN NOT regexp_matches(value, '^[0-9]{1,2}[/\-.][0-9]{1,2}[/\-.][0-9]{2,4}') THEN 'bad_date' END WHEN 'pin' THEN CASE WHEN NOT regexp_matches(value, '^[0-9]{6}') THEN 'not_six_digits' END WHEN 'pan' THEN CASE WHEN NOT regexp_matches(upper(value), '^[A-Z]{5}[0-9]{4}[A-Z]') THEN 'bad_pan' END WHEN 'other' THEN CASE WHEN NOT regexp_matches(value, '[0-9]') THEN 'pattern_mismatch' END END AS error FROM v""",
)
def s35(spark, sf):
    k = F.col("ord") % 5
    name = F.when(k == 0, "birth_date").when(k == 1, "pin").when(k == 2, "pan").when(k == 3, "full_name").otherwise("other")
    kind = F.when(k == 0, "date").when(k == 1, "pincode").when(k == 2, "pan").otherwise("text")
    v = R.extracted(name, F.concat(F.lit(": "), "text", F.lit(" -")))
    return teacher(spark, sf).select("ord", v.alias("value"), R.value_error(kind, v, F.when(k == 4, "[0-9]")).alias("error"))


HTML3 = "'<table><tr><td>1</td><td> <b>Name</b></td><td>' || s_name || '</td></tr><tr><td>2</td><td>Phone</td><td></td></tr><tr><td>Extra</td><td>' || s_suppkey || '</td></tr><tr><td>alone</td></tr></table>'"
HTML2 = "'<table><tr><th>Name</th><th>' || s_name || '</th></tr><tr><td>Phone</td><td></td></tr><tr><td></td><td>x</td></tr><tr><td>alone</td></tr></table>'"
HTML1 = "'<table><tr><td>Section ' || s_suppkey || '</td></tr><tr><td>ab</td></tr></table>'"
LOOSE = "'<p><td>No</td><td>Name</td><td> ' || s_name || ' </td><td></td></p>'"


@query(
    "s48_pairs_by_columns",
    """SELECT s_suppkey, unnest(CASE s_suppkey % 4 WHEN 0 THEN ['Name', 'Extra'] WHEN 1 THEN ['Name', 'Phone'] WHEN 2 THEN ['Section ' || s_suppkey] ELSE ['Name'] END) AS label, unnest(CASE s_suppkey % 4 WHEN 0 THEN [s_name, CAST(s_suppkey AS STRING)] WHEN 1 THEN [s_name, ''] WHEN 2 THEN [''] ELSE [s_name] END) AS value,
 unnest(CASE s_suppkey % 4 WHEN 0 THEN ['3col_value_only', '2col_fallback'] WHEN 1 THEN ['2col', 'label_only'] WHEN 2 THEN ['1col'] ELSE ['3col_regex'] END) AS structure FROM supplier""",
)
def s48(spark, sf):
    return _html(spark, sf).select("s_suppkey", F.explode(P.pairs_by_columns(F.col("html"))).alias("p")).select("s_suppkey", "p.*")


def _html(spark, sf):
    k = F.col("s_suppkey") % 4
    return table(spark, sf, "supplier").select("s_suppkey", F.when(k == 0, F.expr(HTML3)).when(k == 1, F.expr(HTML2)).when(k == 2, F.expr(HTML1)).otherwise(F.expr(LOOSE)).alias("html"))


@query(
    "s49_pairs_with_one_side",
    """SELECT s_suppkey, unnest(CASE s_suppkey % 4 WHEN 0 THEN ['1', '2', 'Extra', 'alone'] WHEN 1 THEN ['Name', 'Phone', '', 'alone'] WHEN 2 THEN ['Section ' || s_suppkey, 'ab'] ELSE ['No', s_name] END) AS label, unnest(CASE s_suppkey % 4 WHEN 0 THEN ['Name', 'Phone', CAST(s_suppkey AS STRING), ''] WHEN 1 THEN [s_name, '', 'x', ''] WHEN 2 THEN ['', ''] ELSE ['Name', ''] END) AS value FROM supplier""",
)
def s49(spark, sf):
    return _html(spark, sf).select("s_suppkey", F.explode(P.pairs_with_one_side(F.col("html"))).alias("p")).select("s_suppkey", "p.*")


@query("s53_search_boxes", "SELECT region_id, greatest(0, x1 - 30) AS px1, least(1400, y2 + 25) AS py2, greatest(0, least(1099, x1 + 400)) AS cx1, greatest(greatest(0, least(1099, x1 + 400)) + 1, least(1100, x1 + x2)) AS cx2 FROM v_region")
def s53(spark, sf):
    b, n = F.col("rbox"), F.lit
    p = G.padded(b, n(30), n(15), n(25), n(1100), n(1400))
    local = F.struct(n(400).alias("x1"), n(5).alias("y1"), F.col("x2").alias("x2"), n(20).alias("y2"))
    search = F.struct(F.col("x1").alias("x1"), F.col("y1").alias("y1"))
    c = G.clip(F.struct((search["x1"] + local["x1"]).alias("x1"), (search["y1"] + local["y1"]).alias("y1"), (search["x1"] + local["x2"]).alias("x2"), (search["y1"] + local["y2"]).alias("y2")), n(1100), n(1400))
    return regions(spark, sf).select("region_id", p["x1"].alias("px1"), p["y2"].alias("py2"), c["x1"].alias("cx1"), c["x2"].alias("cx2"))


@query("s58_quality_score", "SELECT region_id, CAST(round(1e6 * CASE WHEN region_id % 9 = 0 THEN 50 ELSE least(100, (region_id % 260) / 100.0 * 50 + (region_id % 90) / 128.0 * 50) END) AS BIGINT) AS quality_e6 FROM v_region")
def s58(spark, sf):
    k = F.col("region_id")
    return regions(spark, sf).select("region_id", e6(G.quality(F.when(k % 9 != 0, k % 260), k % 90)).alias("quality_e6"))


@query("s59_tick_density", "WITH b AS (SELECT doc_id, page_num, text, region_id, (region_id % 130) / 1000.0 AS d FROM v_region) SELECT doc_id, page_num, arg_max(text, struct_pack(d := d, o := -region_id)) AS label FROM b WHERE d > 0.05 GROUP BY doc_id, page_num")
def s59(spark, sf):
    b = regions(spark, sf).select("doc_id", "page_num", "text", "region_id", (F.col("region_id") % 130).alias("ink"))
    return b.where(G.is_ticked(F.col("ink"), F.lit(1000))).groupBy("doc_id", "page_num").agg(F.max_by("text", F.struct("ink", -F.col("region_id"))).alias("label"))


@query("a6_precision_recall", "WITH t AS (SELECT o_orderkey AS k, o_orderstatus AS t FROM orders WHERE o_orderkey % 3 <> 0), p AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS p FROM orders WHERE o_orderkey % 4 <> 0), m AS (SELECT p.k AS pk, t.k AS tk, p, t FROM p FULL JOIN t ON p.k = t.k), c AS (SELECT count(*) FILTER (WHERE p = t) AS tp, count(*) FILTER (WHERE pk IS NOT NULL AND (tk IS NULL OR p <> t)) AS fp, count(*) FILTER (WHERE pk IS NULL) AS fn FROM m) SELECT CAST(round(1e6 * tp / (tp + fp)) AS BIGINT) AS precision_e6, CAST(round(1e6 * tp / (tp + fn)) AS BIGINT) AS recall_e6, CAST(round(1e6 * 2 * tp / (2 * tp + fp + fn)) AS BIGINT) AS f1_e6 FROM c")
def a6(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    t = o.where(k % 3 != 0).select(k.alias("k"), F.col("o_orderstatus").alias("value"))
    p = o.where(k % 4 != 0).select(k.alias("k"), F.when(k % 5 == 0, "X").otherwise(F.col("o_orderstatus")).alias("value"))
    return score.against_truth(p, t, ["k"]).select(e6("precision").alias("precision_e6"), e6("recall").alias("recall_e6"), e6("f1").alias("f1_e6"))


@query("a21_registration_audit", "WITH p AS (SELECT doc_id, page_num, count(*) AS n, sum(confidence_bp) AS c FROM v_region GROUP BY doc_id, page_num) SELECT doc_id, page_num, 'type_' || page_num AS page_type, n > 3 AS success, n AS match_count, CASE WHEN n > 3 THEN NULL ELSE 'too_few_matches' END AS failure_reason, n AS json_matches FROM p WHERE page_num <= 5")
def a21(spark, sf):
    p = regions(spark, sf).groupBy("doc_id", "page_num").agg(F.count("*").alias("match_count"))
    p = p.withColumn("success", F.col("match_count") > 3).withColumn("failure_reason", F.when(~F.col("success"), "too_few_matches"))
    t = view(spark, sf, "v_template").where("page_num <= 5").select("page_num", F.concat(F.lit("type_"), F.col("page_num").cast("string")).alias("page_type"))
    a = files.registration_audit(p, t)
    return a.select("doc_id", "page_num", "page_type", "success", "match_count", "failure_reason", F.get_json_object("metrics", "$.match_count").cast("long").alias("json_matches"))


def _h(k: int, m: int) -> str:
    return pick_sql(m, "42", str(k), "id")


def _letters(k: int, n: int) -> str:
    return " || ".join(f"chr(CAST({_h(k + j, 26)} + 65 AS INT))" for j in range(n))


def _one(xs: tuple[str, ...], k: int) -> str:
    return f"[{', '.join(repr(x) for x in xs)}][{_h(k, len(xs))} + 1]"


KINDS = ("Name", "PAN", "Date", "Mobile", "Address", "Numeric", "IFSC", "Relationship", "Other", "Amount")


@query(
    "g4_taxonomy_texts",
    f"""WITH i AS (SELECT p_partkey AS id, {list(KINDS)}[p_partkey % 10 + 1] AS field_type FROM part)
 SELECT id, field_type, CASE field_type WHEN 'Name' THEN CASE {_h(7, 3)} WHEN 0 THEN upper({_one(dataset.NAMES, 1)}) WHEN 1 THEN lower({_one(dataset.NAMES, 1)}) ELSE {_one(dataset.NAMES, 1)} END WHEN 'PAN' THEN {_letters(10, 5)} || lpad(CAST({_h(20, 10000)} AS STRING), 4, '0') || {_letters(30, 1)}
  WHEN 'Date' THEN lpad(CAST({_h(8, 28)} + 1 AS STRING), 2, '0') || {_one(("/", "-", "."), 5)} || lpad(CAST({_h(9, 12)} + 1 AS STRING), 2, '0') || {_one(("/", "-", "."), 5)} || CASE WHEN {_h(2, 10)} < 7 THEN {_h(3, 56)} + 1950 ELSE {_h(4, 3)} + 2024 END
  WHEN 'Mobile' THEN CAST({_h(11, 4)} + 6 AS STRING) || lpad(CAST({_h(12, 10**9)} AS STRING), 9, '0') WHEN 'Address' THEN CAST({_h(13, 999)} + 1 AS STRING) || ', ' || {_one(dataset.STREETS, 14)} || ', ' || {_one(dataset.AREAS, 15)} WHEN 'Numeric' THEN CAST({_h(17, 99)} + 1 AS STRING)
  WHEN 'IFSC' THEN {_one(dataset.BANKS, 18)} || '0' || lpad(CAST({_h(19, 10**6)} AS STRING), 6, '0') WHEN 'Relationship' THEN {_one(dataset.RELATIONS, 21)} WHEN 'Amount' THEN CASE WHEN {_h(16, 10)} < 3 THEN format('{{:,}}', {_h(6, 9_900_001)} + 100000) ELSE CAST({_h(6, 9_900_001)} + 100000 AS STRING) END ELSE 'UNKNOWN' END AS text FROM i""",
)
def g4(spark, sf):
    ids = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.element_at(F.array(*map(F.lit, KINDS)), (F.col("p_partkey") % 10 + 1).cast("int")).alias("field_type"))
    return dataset.taxonomy_texts(ids)


@query("t2_folded_candidates", "SELECT doc_id, text, max(confidence_bp) AS best, sum(confidence_bp) AS total, bool_or(lang = 'hi') AS exact FROM v_region GROUP BY doc_id, text")
def t2(spark, sf):
    s = regions(spark, sf).select(F.col("doc_id").alias("qid"), F.lit("c").alias("category"), "text", F.col("confidence_bp").alias("score"), F.col("confidence_bp").alias("frequency"), (F.col("lang") == "hi").alias("exact"))
    return resolve.folded(s).select(F.col("qid").alias("doc_id"), "text", F.col("score").alias("best"), F.col("frequency").alias("total"), "exact")


@query("t9_token_jaccard", "WITH k AS (SELECT qid, list_distinct(string_split(raw_text, ' ')) AS a, list_distinct(string_split(truth, ' ')) AS b FROM v_query) SELECT qid, CAST(round(1e6 * len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))) AS BIGINT) AS jaccard_e6 FROM k")
def t9(spark, sf):
    return view(spark, sf, "v_query").select("qid", e6(X.jaccard(F.split("raw_text", " "), F.split("truth", " "))).alias("jaccard_e6"))
