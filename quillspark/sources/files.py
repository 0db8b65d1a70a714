"""Readers and writers of manifests, lexicons, results and recogniser output."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUFFIXES = ("pdf", "png", "jpg", "jpeg", "tif", "tiff", "bmp")
REGION_SCHEMA = "doc_id string, page_num int, region_id long, text string, confidence double, lang string, bbox struct<x1:int,y1:int,x2:int,y2:int>"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob has files, in any store that Spark reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p))


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, strict: bool = False) -> DataFrame:
    """Rows of a JSONL manifest; a missing path is an empty table. Bad lines are dropped, or fail the read when strict."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """The gold sheet's rows with a label."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).where(F.trim(F.coalesce("gold_text", F.lit(""))) != "")


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """With a header; an empty table writes nothing."""
    if not df.isEmpty():
        df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def read_lexicons(spark: SparkSession, folder: str) -> DataFrame:
    """category (the file's stem), text, frequency (1 at least) of a folder's .txt, .csv and .json files."""
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^.]+$", 1)
    parts = []
    if exists(spark, f"{folder}/*.txt"):
        parts.append(spark.read.text(f"{folder}/*.txt").select(stem.alias("category"), F.trim("value").alias("text"), F.lit(1).cast("long").alias("frequency")))
    if exists(spark, f"{folder}/*.csv"):
        rows = spark.read.option("header", True).option("enforceSchema", False).csv(f"{folder}/*.csv")
        name = F.coalesce(*(F.col(c) for c in ("value", "text", "name") if c in rows.columns))
        count = F.coalesce(F.col("count").cast("long"), F.lit(1)) if "count" in rows.columns else F.lit(1)
        parts.append(rows.select(stem.alias("category"), F.trim(name).alias("text"), F.greatest(count, F.lit(1)).cast("long").alias("frequency")))
    if exists(spark, f"{folder}/*.json"):
        whole = spark.read.option("wholetext", True).text(f"{folder}/*.json").withColumn("category", stem)
        counts = F.from_json("value", "map<string,long>")
        listed = whole.select("category", F.explode(F.from_json("value", "array<string>")).alias("text"), F.lit(1).cast("long").alias("frequency"))
        parts += [listed, whole.select("category", F.explode(counts).alias("text", "frequency")).withColumn("frequency", F.greatest("frequency", F.lit(1)))]
    if not parts:
        return spark.createDataFrame([], "category string, text string, frequency long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.coalesce("text", F.lit("")) != "")


def read_documents(spark: SparkSession, folder: str, most: int | None = None) -> DataFrame:
    """Form files of the known suffixes; with `most`, a batch's limit, the first by path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(SUFFIXES) + "}").option("recursiveFileLookup", True).load(folder)
    return files if most is None else files.orderBy("path").limit(most)


def rendered(files: DataFrame, render: Callable, schema: str = "doc_id string, page_num int, width int, height int, image binary") -> DataFrame:
    """Pages of files through a renderer: a function from an iterator of pandas frames to one; the plug-in of inference too."""
    return files.mapInPandas(render, schema)


def polygons(results: DataFrame) -> DataFrame:
    """results(doc_id, page_num, lang, texts, scores, polys) of a recogniser to region rows; polygons become boxes."""
    z = results.select("doc_id", "page_num", "lang", F.posexplode(F.arrays_zip("texts", "scores", "polys")).alias("region_id", "z"))
    at = lambda k, f: f(F.transform(F.col("z.polys"), lambda p: p[k])).cast("int")
    box = F.struct(at(0, F.array_min).alias("x1"), at(1, F.array_min).alias("y1"), at(0, F.array_max).alias("x2"), at(1, F.array_max).alias("y2"))
    return z.select("doc_id", "page_num", F.col("region_id").cast("long").alias("region_id"), F.col("z.texts").alias("text"), F.col("z.scores").alias("confidence"), "lang", box.alias("bbox")).where(F.trim("text") != "")


def layout_blocks(results: DataFrame) -> DataFrame:
    """results(doc_id, page_num, blocks array<struct<label, text, bbox array<int>>>) to rows with confidence 1; empty texts go."""
    b = results.select("doc_id", "page_num", F.posexplode("blocks").alias("region_id", "b"))
    box = F.struct(*(F.col("b.bbox")[k].alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))))
    return b.where(F.trim("b.text") != "").select("doc_id", "page_num", F.col("region_id").cast("long").alias("region_id"), "b.label", "b.text", F.lit(1.0).alias("confidence"), box.alias("bbox"))


def write_results(fields: DataFrame, path: str, mode: str = "append", by: str = "doc_id") -> None:
    """A folder per document, or per value of another column where documents are many, with its fields as JSON."""
    fields.write.mode(mode).partitionBy(by).json(path)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Stored results; lines that are no JSON come back in _corrupt_record."""
    return spark.read.schema(f"{schema}, _corrupt_record string").json(path)


def document_json(fields: DataFrame) -> DataFrame:
    """fields(doc_id, page_num, field_name, value, confidence, ord) to one nested JSON text per document."""
    f = F.struct("field_name", "value", "confidence")
    pages = fields.groupBy("doc_id", "page_num").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", f.alias("f")))), lambda x: x["f"]).alias("fields"))
    docs = pages.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_num", "fields"))).alias("pages"))
    return docs.select("doc_id", F.to_json(F.struct(F.col("doc_id").alias("document_id"), "pages")).alias("json"))


def source_map(fields: DataFrame) -> DataFrame:
    """One row per document: a map from field name to where its value stands; of two values the surer, then the later page's."""
    best = fields.groupBy("doc_id", "field_name").agg(F.max(F.struct("confidence", "page_num", "value")).alias("b"))
    return best.groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field_name", F.struct("b.page_num", "b.value", "b.confidence").alias("s"))))).alias("sources"))


def page_spec(spec: str) -> list[int]:
    """'2', '1-5' or '2,3,7-9' as a list of pages, in order, each once."""
    out: list[int] = []
    for part in spec.split(","):
        a, _, b = part.strip().partition("-")
        out += [k for k in range(int(a), int(b or a) + 1) if k not in out]
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in a folder that driver and executors share: spark.checkpoint.dir, or the warehouse where that is not set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/quillspark/{name}-{uuid.uuid4().hex}"


def gather(spark: SparkSession, folder: str, to: str, name: str) -> None:
    """Moves the one part file of a small written folder to a file of a given name, as lexicons have; more parts get numbers."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(conf)
    fs.mkdirs(path(to))
    for k, f in enumerate(fs.globStatus(path(f"{folder}/part-*"))):
        fs.rename(f.getPath(), path(f"{to}/{name if not k else name.replace('.', f'-{k}.')}"))


def write_partial(fields: DataFrame, path: str) -> None:
    """The results of some pages, beside those written before: a page that is written again replaces itself alone."""
    fields.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_id", "page_num").json(path)


def page_dumps(regions: DataFrame) -> DataFrame:
    """regions(doc_id, page_num, region_id, label, text, ...): for each page json, its regions in order, and markdown, a line for each."""
    own = [c for c in regions.columns if c not in ("doc_id", "page_num")]
    page = regions.groupBy("doc_id", "page_num").agg(F.sort_array(F.collect_list(F.struct("region_id", F.struct(*own).alias("r")))).alias("rs")).select("doc_id", "page_num", F.transform("rs", lambda x: x["r"]).alias("regions"))
    body = F.transform("regions", lambda r: F.concat(F.lit("["), r["label"], F.lit("] "), r["text"], F.lit("\n\n")))
    json = F.to_json(F.struct("page_num", F.size("regions").alias("num_regions"), "regions"))
    return page.select("doc_id", "page_num", json.alias("json"), F.concat(F.lit("# Page "), F.col("page_num").cast("string"), F.lit("\n\n"), F.array_join(body, "")).alias("markdown"))


def save_page_dumps(dumps: DataFrame, path: str) -> None:
    """A folder json and a folder markdown, each with a folder per document and page."""
    for kind in ("json", "markdown"):
        dumps.select("doc_id", "page_num", F.col(kind).alias("value")).write.partitionBy("doc_id", "page_num").text(f"{path}/{kind}")


def document_dumps(regions: DataFrame, pages: DataFrame, lang_mode: str = "bilingual") -> DataFrame:
    """pages(doc_id, page_num, width, height, seconds) with their regions, in one of the modes, as a nested JSON text per document.

    Pages without regions stay, with none.
    """
    used = regions if lang_mode == "bilingual" else regions.where(F.col("lang") == lang_mode)
    own = [c for c in regions.columns if c not in ("doc_id", "page_num")]
    r = used.groupBy("doc_id", "page_num").agg(F.sort_array(F.collect_list(F.struct("region_id", F.struct(*own).alias("r")))).alias("rs"))
    m = pages.join(r, ["doc_id", "page_num"], "left").withColumn("regions", F.coalesce(F.transform("rs", lambda x: x["r"]), F.array()))
    page = F.struct("page_num", F.col("width").alias("page_width"), F.col("height").alias("page_height"), F.round("seconds", 2).alias("ocr_time_seconds"), F.size("regions").alias("num_regions"), "regions")
    d = m.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_num", page.alias("p")))).alias("ps"), F.round(F.sum("seconds"), 2).alias("t"))
    whole = F.struct(F.col("doc_id").alias("source_name"), F.size("ps").alias("total_pages"), F.col("t").alias("total_ocr_time_seconds"), F.lit(lang_mode).alias("lang_mode"), F.transform("ps", lambda x: x["p"]).alias("pages"))
    return d.select("doc_id", F.size("ps").alias("total_pages"), F.to_json(whole).alias("json"))


def stored_boxes(writes: DataFrame) -> DataFrame:
    """writes(ord, page_num, width, height, field_name, x1..y2, confidence): the last box of each page and field, the page's last size."""
    size = writes.groupBy("page_num").agg(F.max_by(F.struct("width", "height"), "ord").alias("s"))
    last = writes.groupBy("page_num", "field_name").agg(F.max_by(F.struct("x1", "y1", "x2", "y2", F.round("confidence", 4).alias("confidence")), "ord").alias("b"))
    return last.join(size, "page_num").select("page_num", "field_name", "s.width", "s.height", "b.*")


def scaled_boxes(store: DataFrame, sizes: DataFrame) -> DataFrame:
    """Stored boxes on pages(doc_id, page_num, page_width, page_height) of other sizes, rounded to even halves."""
    m = sizes.join(store, "page_num")
    whole = lambda c, to, of: F.when(F.col(of) > 0, F.rint(F.col(c) * (F.col(to) / F.greatest(F.col(of), F.lit(1))))).otherwise(F.col(c)).cast("int").alias(c)
    return m.select("doc_id", "page_num", "field_name", *(whole(c, f"page_{'width' if c[0] == 'x' else 'height'}", "width" if c[0] == "x" else "height") for c in ("x1", "y1", "x2", "y2")))


def purge(spark: SparkSession, *paths: str, really: bool = False) -> list[str]:
    """Deletes results and inputs for good, and only when told so; returns the paths that were there."""
    gone = []
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(p):
            gone.append(path)
            if really:
                fs.delete(p, True)
    return gone


def registration_audit(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """pages(doc_id, page_num, success, method, ... of the alignment) that have a template(page_num, page_type), with their metrics as JSON."""
    metrics = [c for c in pages.columns if c not in ("doc_id", "page_num")]
    m = pages.join(templates.select("page_num", "page_type").distinct(), "page_num")
    return m.select("doc_id", "page_num", "page_type", *metrics, F.to_json(F.struct("page_type", *metrics)).alias("metrics"))
