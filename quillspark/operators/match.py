"""Regions to fields: by place, label, order and verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from .fixed import fixed_rows
from .resolve import ratio

# Acceptance limits of the spatial match.
OVERLAP, NEAR, ACCEPT_OVERLAP = 0.4, 0.05, 0.3
FALLBACK_OVERLAP, FALLBACK_NEAR = 0.25, 0.035


def _pairs(regions: DataFrame, templates: DataFrame, width: int, height: int) -> DataFrame:
    """Regions beside the templates of their page: doc_id, page_num, region_id, rbox, ... and fname, ford, fbox.

    Templates are a fixed form's fields; the equi-join on page_num broadcasts them by their size alone.
    """
    m = regions.join(templates, "page_num")
    r, f = F.col("rbox"), F.col("fbox")
    shared = G.common(r, f)
    return m.withColumn("overlap", shared / F.greatest(G.area(r), F.lit(1))).withColumn("share", shared / F.greatest(F.least(G.area(r), G.area(f)), F.lit(1))).withColumn("dist", G.distance(r, f, F.lit(width), F.lit(height)))


def spatial_match(regions: DataFrame, templates: DataFrame, width: int, height: int) -> DataFrame:
    """Each page's and field's best region: least score, then least region_id; a grouped minimum, so no sort."""
    p = _pairs(regions, templates, width, height)
    score = F.when(F.col("overlap") > OVERLAP, F.col("dist") - 0.5 * F.col("share")).when(F.col("dist") < NEAR, F.col("dist"))
    best = p.withColumn("score", score).where("score IS NOT NULL").groupBy("doc_id", "page_num", "fname").agg(F.min(F.struct("score", "region_id", "overlap", "text", "confidence")).alias("b")).select("doc_id", "page_num", "fname", "b.*")
    return best.where((F.col("overlap") > ACCEPT_OVERLAP) | (F.col("score") < NEAR))


def fallback_match(regions: DataFrame, second: DataFrame, templates: DataFrame, matched: DataFrame, width: int, height: int, few: int = 6) -> DataFrame:
    """The second try for fields that spatial_match left open: on pages with under `few` regions, in a second reading of the page."""
    enough = regions.groupBy("doc_id", "page_num").agg(F.count("*").alias("n")).where(F.col("n") >= few).select("doc_id", "page_num")
    p = _pairs(second.join(enough, ["doc_id", "page_num"], "left_anti"), templates, width, height).join(matched.select("doc_id", "page_num", "fname"), ["doc_id", "page_num", "fname"], "left_anti")
    p = p.where((F.col("overlap") > FALLBACK_OVERLAP) | (F.col("dist") < FALLBACK_NEAR)).withColumn("score", F.col("dist") - 0.35 * F.col("overlap"))
    best = p.groupBy("doc_id", "page_num", "fname").agg(F.min(F.struct("score", "region_id", "overlap")).alias("b")).select("doc_id", "page_num", "fname", "b.*")
    return best.where((F.col("overlap") > ACCEPT_OVERLAP) | (F.col("score") < NEAR))


def rows_by_gap(regions: DataFrame, gap: int = 30) -> DataFrame:
    """Adds row_no: a region opens a row when it lies more than gap below the row's first region (by y1).

    The anchor is the row's first region, not the one before, so a page's tops are folded, in order, into the tops of its
    rows; a region's row is the number of row tops that are not below it.
    """
    page = regions.groupBy("doc_id", "page_num").agg(F.sort_array(F.collect_set("y1")).alias("ys"))
    opens = F.aggregate("ys", F.array().cast("array<int>"), lambda a, y: F.when((F.size(a) == 0) | (y - F.element_at(a, -1) > gap), F.array_append(a, y)).otherwise(a))
    own = regions.select("doc_id", "page_num", "region_id", "y1").join(page.select("doc_id", "page_num", opens.alias("opens")), ["doc_id", "page_num"])
    return own.select("doc_id", "page_num", "region_id", (F.size(F.filter("opens", lambda y: y <= F.col("y1"))) - 1).alias("row_no"))


def reading_order(regions: DataFrame, band: int = 20) -> DataFrame:
    w = Window.partitionBy("doc_id", "page_num").orderBy(F.floor(F.col("y1") / band), "x1", "region_id")
    return regions.withColumn("place", F.row_number().over(w))


def next_in_order(regions: DataFrame, band: int = 20) -> DataFrame:
    """Adds next_text, the text of the region that follows in reading order."""
    w = Window.partitionBy("doc_id", "page_num").orderBy(F.floor(F.col("y1") / band), "x1", "region_id")
    return regions.withColumn("next_text", F.lead("text").over(w))


def pairs_by_two(regions: DataFrame, band: int = 20) -> DataFrame:
    """Regions 2k and 2k+1 in reading order as label and value; the last of an odd number is dropped."""
    r = reading_order(regions, band).withColumn("pair", F.floor((F.col("place") - 1) / 2)).withColumn("odd", F.col("place") % 2)
    agg = r.groupBy("doc_id", "page_num", "pair").agg(F.max(F.when(F.col("odd") == 1, F.col("text"))).alias("label"), F.max(F.when(F.col("odd") == 0, F.col("text"))).alias("value"), F.min("confidence").alias("confidence"), F.count("*").alias("n"))
    return agg.where("n = 2").drop("n")


def dedup_regions(regions: DataFrame, cell: int = 20, chars: int = 30) -> DataFrame:
    """First region (by region_id) of each page, text beginning and grid cell."""
    key = [F.col("doc_id"), F.col("page_num"), F.lower(F.substring("text", 1, chars)), F.floor(F.col("y1") / cell), F.floor(F.col("x1") / cell)]
    return regions.withColumn("rn", F.row_number().over(Window.partitionBy(*key).orderBy("region_id"))).where("rn = 1").drop("rn")


def drop_contained(regions: DataFrame) -> DataFrame:
    """Regions that lie in no larger region of their page; of equal boxes the first stays."""
    a, b = regions.alias("a"), regions.select("doc_id", "page_num", "region_id", "rbox").alias("b")
    inside = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page_num") == F.col("b.page_num")) & (F.col("a.region_id") != F.col("b.region_id"))
    bigger = (G.area(F.col("b.rbox")) > G.area(F.col("a.rbox"))) | ((G.area(F.col("b.rbox")) == G.area(F.col("a.rbox"))) & (F.col("b.region_id") < F.col("a.region_id")))
    return a.join(b, inside & G.contains(F.col("b.rbox"), F.col("a.rbox")) & bigger, "left_anti")


def in_zones(regions: DataFrame, zones: DataFrame, width: int, height: int, least: float = 0.5) -> DataFrame:
    """The surest region whose centre lies in each zone (shares of the page); short numbers are left out."""
    cx, cy = G.center(F.col("rbox"))
    ok = (F.col("confidence") >= least) & ~F.col("text").rlike("^[0-9]{1,3}$")
    m = regions.where(ok).withColumn("cx", cx / width).withColumn("cy", cy / height).join(zones, (F.col("cx").between(F.col("zx1"), F.col("zx2"))) & (F.col("cy").between(F.col("zy1"), F.col("zy2"))))
    best = F.min(F.struct((-F.col("confidence")).alias("c"), F.col("region_id"), F.col("text"))).alias("b")
    return m.groupBy("doc_id", "page_num", "zone").agg(best).select("doc_id", "page_num", "zone", "b.region_id", "b.text", (-F.col("b.c")).alias("confidence"))


def verified_values(values: DataFrame, regions: DataFrame) -> DataFrame:
    """values(doc_id, page_num, field, value) against the page's regions: similarity times confidence, at its greatest.

    Equal texts count 1, contained ones 0.8 by their lengths, others by matching blocks. Verified from 0.65. Each region is
    compared as it comes from the join, so that no task holds its regions in a hash table.
    """
    m = values.join(regions.select("doc_id", "page_num", F.lower(F.trim("text")).alias("r"), F.col("confidence").alias("rc")), ["doc_id", "page_num"], "left").withColumn("v", F.lower(F.trim("value")))
    inside = F.contains("v", "r") | F.contains("r", "v")
    other = ratio(F.when(inside, "").otherwise(F.col("v")), F.when(inside, "").otherwise(F.col("r")))
    sim = F.when(F.col("v") == F.col("r"), 1.0).when(inside, 0.8 * F.least(F.length("v"), F.length("r")) / F.greatest(F.length("v"), F.length("r"), F.lit(1))).otherwise(other)
    best = m.groupBy("doc_id", "page_num", "field", "value").agg(F.coalesce(F.max(sim * F.col("rc")), F.lit(0.0)).alias("best"))
    found = F.col("best") >= 0.65
    return best.withColumn("verified", found).withColumn("confidence", F.when(F.col("best") <= 0, 0.6).when(found, F.least(F.col("best") + 0.3, F.lit(0.95))).otherwise(0.5))


def simply_verified(values: DataFrame, regions: DataFrame) -> DataFrame:
    """values(doc_id, page_num, field, value): confidence by the first region, in order of region_id, that bears it out, and the box.

    An equal text gives 0.95; one that contains the value or is contained, with over 0.6 of all characters in common,
    0.85. Else a value with a digit or of two words at most, as by hand, has 0.70 and others 0.50; an empty one 0. The
    box is that of the best region: 1 if equal, 0.7 by the lengths if contained, times its confidence, above 0.3; scores
    that are equal to 12 digits are equal, and the first region wins.
    """
    v, r = F.lower(F.trim("value")), F.lower(F.trim("text"))
    m = values.join(regions.select("doc_id", "page_num", "region_id", "text", F.col("confidence").alias("rc")), ["doc_id", "page_num"], "left")
    inside = F.contains(v, r) | F.contains(r, v)
    a, b = F.array_distinct(F.split(v, "")), F.array_distinct(F.split(r, ""))
    common = F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))
    borne = F.when(v == r, 0.95).when(inside & (common > 0.6), 0.85)
    score = F.when(v == r, 1.0).when(inside, 0.7 * F.least(F.length(v), F.length(r)) / F.greatest(F.length(v), F.length(r), F.lit(1))) * F.col("rc")
    g = m.groupBy("doc_id", "page_num", "field", "value").agg(F.min(F.when(borne.isNotNull(), F.struct("region_id", borne.alias("c")))).alias("b"), F.max(F.when(score > 0.3, F.struct(F.round(score, 12).alias("s"), (-F.col("region_id")).alias("o")))).alias("box"))
    by_hand = F.col("value").rlike("[0-9]") | (F.size(F.split(F.trim("value"), r"\s+")) <= 2)
    empty = F.trim(F.coalesce("value", F.lit(""))) == ""
    confidence = F.when(empty, 0.0).otherwise(F.coalesce("b.c", F.when(by_hand, 0.70).otherwise(0.50)))
    return g.select("doc_id", "page_num", "field", "value", confidence.alias("confidence"), F.when(~empty, -F.col("box.o")).alias("box_region_id"))


def label_routes(labels: DataFrame, patterns: DataFrame) -> DataFrame:
    """The first field (by ord) whose pattern occurs in the lower-cased label; patterns(ord, pattern, field) is a fixed list."""
    low, out = F.lower("label"), F.lit(None).cast("string")
    for _, pattern, field in reversed(sorted((r.ord, r.pattern, r.field) for r in fixed_rows(patterns))):
        out = F.when(low.contains(pattern), field).otherwise(out)
    return labels.select("label").distinct().withColumn("field", out)


def page_class(pages: DataFrame, signatures: DataFrame, least: int = 2) -> DataFrame:
    """The page type with most signature texts, the first on ties, null under `least`; signatures(ord, page_type, sig) is a fixed list."""
    kinds: dict[tuple[int, str], list[str]] = {}
    for r in fixed_rows(signatures):
        kinds.setdefault((r.ord, r.page_type), []).append(r.sig)
    low = F.lower(F.coalesce("text", F.lit("")))
    scores = [F.struct(sum((low.contains(x).cast("long") for x in sigs), F.lit(0).cast("long")).alias("n"), F.lit(-k).alias("o"), F.lit(name).alias("page_type")) for (k, name), sigs in kinds.items()]
    b = pages.select("doc_id", F.array_max(F.array(*scores)).alias("b"))
    return b.select("doc_id", F.when(F.col("b.n") >= least, F.col("b.page_type")).alias("page_type"), F.col("b.n").alias("score"))


def with_offsets(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """Cells' boxes on the page: the table's corner plus the cell's box."""
    return cells.join(tables, "table_id").select("table_id", "cell_id", *((F.col(c) + F.col(f"t{c[0]}")).alias(c) for c in ("x1", "y1", "x2", "y2")))


def tiles(pages: DataFrame, rows: int = 3, cols: int = 2, overlap: int = 50) -> DataFrame:
    """A grid of overlapping tiles for each page(doc_id, page_num, width, height)."""
    g = pages.select("*", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("r")).select("*", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("c"))
    w, h = F.floor(F.col("width") / cols), F.floor(F.col("height") / rows)
    return g.select("doc_id", "page_num", F.concat(F.lit("tile_r"), "r", F.lit("_c"), "c").alias("tile"), F.greatest(F.col("c") * w - overlap, F.lit(0)).alias("x1"), F.greatest(F.col("r") * h - overlap, F.lit(0)).alias("y1"), F.least((F.col("c") + 1) * w + overlap, F.col("width")).alias("x2"), F.least((F.col("r") + 1) * h + overlap, F.col("height")).alias("y2"))
