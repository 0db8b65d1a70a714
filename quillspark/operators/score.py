"""Aggregates: form and batch figures, accuracy against truth, dashboards, lexicon counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fields as V
from ..functions import text as X


def _count(c: Column) -> Column:
    return F.count_if(c)


def _mean(c: Column) -> Column:
    """The mean of doubles to 12 digits, summed as decimals: the order of rows, which bends sums of doubles, does not count."""
    return F.avg(c.try_cast("decimal(20,12)")).cast("double")


def form_kpis(fields: DataFrame) -> DataFrame:
    """fields(doc_id, status, confidence): counts by status, mean of positive confidences, and the form's status."""
    g = fields.groupBy("doc_id").agg(
        F.count("*").alias("total_fields"),
        *(_count(F.col("status") == s).alias(n) for s, n in (("Extracted", "extracted"), ("Missing", "missing"), ("Low Confidence", "low_confidence"), ("Rejected", "rejected"))),
        F.coalesce(_mean(F.when(F.col("confidence") > 0, F.col("confidence"))), F.lit(0.0)).alias("overall_confidence"),
    )
    bad = (F.col("rejected") > 0) | (F.col("overall_confidence") < V.REJECT)
    return g.withColumn("form_status", F.when(bad, "rejected").when((F.col("low_confidence") > 0) | (F.col("missing") > 0), "needs_review").otherwise("completed"))


def review_kpis(fields: DataFrame) -> DataFrame:
    """fields(doc_id, value, confidence): found, missing, review bands, mean confidence of found ones, form status."""
    found = F.coalesce("value", F.lit("")) != ""
    band = V.review_band(F.col("confidence"))
    g = fields.groupBy("doc_id").agg(
        F.count("*").alias("total_fields"),
        _count(found).alias("fields_extracted"),
        _count(~found).alias("fields_missing"),
        *(_count(found & (band == b)).alias(b) for b in ("auto_accepted", "needs_review", "low_confidence", "rejected")),
        F.coalesce(_mean(F.when(found, F.col("confidence"))), F.lit(0.0)).alias("avg_confidence"),
    )
    return g.withColumn("form_status", F.when((F.col("rejected") > 0) | (F.col("low_confidence") > F.col("auto_accepted")), "needs_review").when(F.col("needs_review") > 0, "mostly_confident").otherwise("auto_accepted"))


def form_results(fields: DataFrame, mandatory: DataFrame) -> DataFrame:
    """fields(doc_id, field_name, value, confidence, category) with mandatory(field_name): counts, completion, status."""
    n = mandatory.count()
    good = F.col("category").isin("Extracted", "Needs Review")
    m = fields.join(mandatory.select("field_name", F.lit(True).alias("must")).distinct(), "field_name", "left")
    g = m.groupBy("doc_id").agg(
        _count(good).alias("extracted"),
        *(_count(F.col("category") == c).alias(k) for c, k in (("Missing", "missing"), ("Low Confidence", "low_confidence"), ("Rejected", "rejected"), ("Validation Failed", "validation_failed"))),
        F.coalesce(_mean(F.when(F.coalesce("value", F.lit("")) != "", F.col("confidence"))), F.lit(0.0)).alias("overall_confidence"),
        F.count_distinct(F.when(good & F.col("must"), F.col("field_name"))).alias("mandatory_present"),
    )
    g = g.withColumn("completion", F.col("mandatory_present") / max(n, 1))
    return g.withColumn("form_status", F.when((F.col("overall_confidence") < 0.5) | (F.col("completion") < 0.5), "Rejected").when((F.col("low_confidence") + F.col("validation_failed")) > F.col("extracted") * 0.3, "Needs Review").otherwise("Processed"))


def batch_kpis(forms: DataFrame) -> DataFrame:
    """forms(form_status, total, extracted, confidence) to one row of rates."""
    n = F.count("*")
    return forms.agg(
        n.alias("total_forms"),
        _count(~F.col("form_status").isin("Failed", "Rejected")).alias("forms_processed"),
        _count(F.col("form_status") == "Rejected").alias("forms_rejected"),
        _count(F.col("form_status") == "Needs Review").alias("forms_needs_review"),
        (F.sum("extracted") / F.greatest(F.sum("total"), F.lit(1))).alias("field_coverage"),
        F.coalesce(F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))), F.lit(0.0)).alias("avg_confidence"),
        (_count(F.col("form_status") == "Rejected") / F.greatest(n, F.lit(1))).alias("rejection_rate"),
        (_count(F.col("form_status") == "Needs Review") / F.greatest(n, F.lit(1))).alias("manual_correction_rate"),
    )


def field_dashboard(fields: DataFrame, most: int = 10) -> DataFrame:
    """Mean confidence of the first `most` field names in order of name."""
    return fields.groupBy("field_name").agg(F.avg("confidence").alias("mean_confidence"), F.count("*").alias("n")).orderBy("field_name").limit(most)


def against_truth(predicted: DataFrame, truth: DataFrame, on: list[str]) -> DataFrame:
    """One row: exact matches, false ones, misses, precision, recall, F1 and mean CER of unequal pairs.

    predicted and truth have the keys `on` and a value each; a full outer join gives misses and extras in one pass.
    """
    norm = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    m = predicted.select(*on, norm("value").alias("p"), F.lit(1).alias("hp")).join(truth.select(*on, norm("value").alias("t"), F.lit(1).alias("ht")), on, "full")
    both = F.col("hp").isNotNull() & F.col("ht").isNotNull()
    g = m.agg(
        _count(both & (F.col("p") == F.col("t"))).alias("true_positives"),
        _count(F.col("hp").isNotNull() & (F.col("ht").isNull() | (F.col("p") != F.col("t")))).alias("false_positives"),
        _count(F.col("hp").isNull()).alias("false_negatives"),
        F.coalesce(F.avg(F.when(both & (F.col("p") != F.col("t")) & (F.col("p") != "") & (F.col("t") != ""), X.cer(F.col("p"), F.col("t")))), F.lit(0.0)).alias("mean_cer"),
    )
    tp, fp, fn = (F.col(c) for c in ("true_positives", "false_positives", "false_negatives"))
    g = g.withColumn("precision", F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)).withColumn("recall", F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0))
    return g.withColumn("f1", F.when(tp > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0))


def accuracy(pairs: DataFrame) -> DataFrame:
    """pairs(predicted, truth), empty truths left out: exact rate, least, mean and greatest CER."""
    p, t = F.lower(F.trim("predicted")), F.lower(F.trim("truth"))
    e = X.cer(p, t)
    return pairs.where(F.trim(F.coalesce("truth", F.lit(""))) != "").agg(F.count("*").alias("n"), F.avg((p == t).cast("double")).alias("exact_rate"), F.min(e).alias("min_cer"), F.avg(e).alias("avg_cer"), F.max(e).alias("max_cer"))


def latency(rows: DataFrame, value: str) -> DataFrame:
    """Interpolated percentiles and the mean."""
    p = lambda q: F.percentile(value, F.lit(q))
    return rows.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"))


# Titles that are no names.
STOP_TOKENS = ("MR", "MRS", "MS", "SHRI", "SMT", "KUMARI", "DR")


def lexicon_counts(texts: DataFrame) -> DataFrame:
    """texts(category, text) to category, value, frequency; full names also count their tokens, but for titles and initials."""
    t = texts.withColumn("value", X.smart_title(F.col("text"))).where(X.name_key(F.col("value"), keep_digits=True) != "")
    words = t.where("category = 'person_full'").select(F.explode(X.tokens(X.name_key(F.col("value")))).alias("w")).where((F.length("w") >= 2) & ~F.col("w").isin(*STOP_TOKENS))
    both = t.select("category", "value").unionByName(words.select(F.lit("person_token").alias("category"), X.smart_title(F.lower("w")).alias("value")))
    return both.groupBy("category", "value").agg(F.count("*").alias("frequency"))


def lexicon_listing(counts: DataFrame) -> DataFrame:
    """Each category's values with their rank: most frequent first, then by value."""
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("frequency"), "value")))


def lexicon_summary(counts: DataFrame) -> DataFrame:
    return counts.groupBy("category").agg(F.count_distinct("value").alias("distinct_values"), F.sum("frequency").alias("total"))


def sequence_confidence(steps: Column) -> Column:
    """Mean of the steps' greatest probabilities; an empty sequence has 0."""
    return F.when(F.size(steps) > 0, F.aggregate(F.transform(steps, lambda s: F.array_max(s)), F.lit(0.0), lambda a, x: a + x) / F.size(steps)).otherwise(0.0)
