"""Competing readings into one: acceptance, votes, consensus, merges, box fusion."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fields as V
from ..functions import text as X
from .fixed import fixed_rows, page_by_page, pairs


def accept_weak_labels(predictions: DataFrame) -> DataFrame:
    """predictions(id, ord, field_name, field_family, text, confidence, model) to one accepted label per id.

    Rule score and confidence weigh 65 to 35; the best counts 0.08 more if any other reading has the same label. All
    readings of an id are few, and meet in one grouped sort.
    """
    p = predictions.withColumn("n", V.normalize(F.col("field_family"), F.col("field_name"), F.col("text")))
    p = p.withColumn("combined", 0.65 * F.col("n.score") + 0.35 * F.coalesce("confidence", F.lit(0.0)))
    w = Window.partitionBy("id").orderBy(F.desc("combined"), "ord")
    p = p.withColumn("rn", F.row_number().over(w)).withColumn("key", F.upper(X.collapse(F.col("n.canonical"))))
    p = p.withColumn("best_key", F.first("key").over(w))
    agree = F.max((F.col("rn") > 1) & (F.col("key") == F.col("best_key"))).over(Window.partitionBy("id"))
    best = p.withColumn("consensus", agree).where("rn = 1")
    score = F.col("combined") + F.when(F.col("consensus"), 0.08).otherwise(0.0)
    limit = F.when(F.col("field_family") == "binary_mark", 0.70).when(F.col("field_family").isin("name_text", "long_text"), 0.80).otherwise(0.78)
    out = best.withColumn("acceptance_score", score).where(F.col("n.valid") & (F.col("acceptance_score") >= limit))
    return out.select("id", "field_name", "field_family", F.lit("weak").alias("source_tier"), F.col("model").alias("teacher_model"), F.trim("text").alias("label_text"), F.col("n.canonical").alias("canonical_text"), "acceptance_score", "consensus")


def majority_vote(votes: DataFrame) -> DataFrame:
    """votes(id, ord, value, confidence): the most frequent non-empty value, the first seen on ties, by partial sums."""
    v = votes.where(F.coalesce("value", F.lit("")) != "").groupBy("id", "value").agg(F.count("*").alias("n"), F.min("ord").alias("first"), F.avg("confidence").alias("mean"))
    best = v.groupBy("id").agg(F.sum("n").alias("votes"), F.max(F.struct("n", (-F.col("first")).alias("f"), "value", "mean")).alias("b"))
    share = F.col("b.n") / F.col("votes")
    conf = F.least(F.lit(1.0), F.col("b.mean") * (0.7 + 0.3 * share)) * F.when(share < 0.5, 0.5).otherwise(1.0)
    return best.select("id", F.col("b.value").alias("value"), conf.alias("confidence"), share.alias("agreement"), "votes")


def consensus(p: Column, q: Column, pc: Column, qc: Column, name: Column) -> Column:
    """struct(value, confidence, kind) of two readings of a field, by eight ordered cases."""
    a, b = (F.lower(F.trim(F.coalesce(x, F.lit("")))) for x in (p, q))
    da, db = X.digits(a), X.digits(b)
    top = F.greatest(pc, qc)
    sim = X.levenshtein_similarity(a, b)
    surer = F.when(pc >= qc, a).otherwise(b)

    def out(value: Column, conf: Column, kind: str) -> Column:
        return F.struct(value.alias("value"), conf.cast("double").alias("confidence"), F.lit(kind).alias("kind"))

    return (
        F.when((a == "") & (b == ""), out(F.lit(""), F.lit(0.0), "both_empty"))
        .when(a == "", out(q, qc * 0.85, "second_only"))
        .when(b == "", out(p, pc, "first_only"))
        .when(a == b, out(p, F.least(F.lit(1.0), top * 1.1), "full_agreement"))
        .when(F.replace(a, F.lit(" "), F.lit("")) == F.replace(b, F.lit(" "), F.lit("")), out(p, top * 1.05, "agree_no_space"))
        .when((da != "") & (da == db), out(F.when(name.isin(*V.NUMERIC_FIELDS), da).otherwise(p), top * 0.95, "numeric_agree"))
        .when(sim > 0.7, out(surer, top * (0.5 + 0.5 * sim), "partial_agree"))
        .otherwise(out(surer, top * 0.6, "disagree"))
    )


def merge_tiles(tiles: DataFrame, affinity: DataFrame) -> DataFrame:
    """tiles(doc_id, ord, tile, field, value) to one value per document and field; affinity(field, tile) is a fixed list.

    Halves count 3, tiles 2, others 1; a field's own tiles 5 more; each character 0.01. The first wins on ties.
    """
    own: dict[str, list[str]] = {}
    for r in fixed_rows(affinity.select("field", "tile").where("field IS NOT NULL AND tile IS NOT NULL")):
        own.setdefault(r.field, []).append(r.tile)
    near = F.lit(0.0)
    for field, names in own.items():
        near = F.when((F.col("field") == field) & F.col("tile").isin(*names), 5.0).otherwise(near)
    v = tiles.where(F.trim(F.coalesce("value", F.lit(""))) != "")
    rank = F.when(F.col("tile").startswith("half_"), 3.0).when(F.col("tile").startswith("tile_"), 2.0).otherwise(1.0) + near + 0.01 * F.length(F.trim("value"))
    best = v.groupBy("doc_id", "field").agg(F.max(F.struct(F.round(rank, 6).alias("p"), (-F.col("ord")).alias("o"), F.trim("value").alias("value"))).alias("b"))
    return best.select("doc_id", "field", "b.value")


def escalate(base: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Base readings, replaced where the other's is not empty and the base's is empty or less sure."""
    o = other.select(*on, F.col("value").alias("ov"), F.col("confidence").alias("oc"))
    take = (F.coalesce("ov", F.lit("")) != "") & ((F.coalesce("value", F.lit("")) == "") | (F.col("oc") > F.col("confidence")))
    return base.join(o, on, "left").select(*on, F.when(take, F.col("ov")).otherwise(F.col("value")).alias("value"), F.when(take, F.col("oc")).otherwise(F.col("confidence")).alias("confidence"), F.coalesce(take, F.lit(False)).alias("replaced"))


def best_per_name(fields: DataFrame, bridge: DataFrame) -> DataFrame:
    """Fields under their config names; the surer reading stays where two meet, the first on ties."""
    named = fields.join(bridge, "field_name", "left").withColumn("name", F.coalesce("config_name", "field_name"))
    return named.groupBy("doc_id", "name").agg(F.max(F.struct("confidence", (-F.col("ord")).alias("o"), "value")).alias("b")).select("doc_id", "name", "b.value", "b.confidence")


def last_writer(bridge: DataFrame) -> DataFrame:
    """bridge(ord, config_name, field_name) turned round: the last config name of each field."""
    return bridge.groupBy("field_name").agg(F.max_by("config_name", "ord").alias("config_name"))


def merge_manifests(**tiers: DataFrame) -> DataFrame:
    """Rows of all tiers with their tier's name; columns that a tier lacks are null."""
    out = None
    for name, df in tiers.items():
        df = df.withColumn("tier", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def _iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of boxes along the last axis."""
    w = np.minimum(a[..., 2], b[..., 2]) - np.maximum(a[..., 0], b[..., 0])
    h = np.minimum(a[..., 3], b[..., 3]) - np.maximum(a[..., 1], b[..., 1])
    common = np.maximum(w, 0) * np.maximum(h, 0)
    area = lambda x: (x[..., 2] - x[..., 0]) * (x[..., 3] - x[..., 1])
    return common / np.maximum(area(a) + area(b) - common, 1e-9)


#: Boxes of a group that go with others; a larger group goes alone.
TOGETHER = 64


def _groups(df: pd.DataFrame, page: np.ndarray, keys: list[str]) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """Rows of a run by group (page and keys), the surest first; where each group starts, and how many rows it has."""
    code = page
    for k in keys:
        of = pd.factorize(df[k], use_na_sentinel=False)[0]
        code = code * (of.max(initial=0) + 1) + of
    df = df.assign(code=code).sort_values(["code", "score", "det_id"], ascending=[True, False, True])
    starts = np.flatnonzero(np.diff(df.code.to_numpy(), prepend=-1))
    return df.drop(columns="code"), starts, np.diff(np.append(starts, len(df)))


def nms(detections: DataFrame, threshold: float = 0.45, agnostic: bool = False) -> DataFrame:
    """detections(doc_id, page_num, label, det_id, score, x1..y2) without those that overlap a surer one of their page (and label) kept before.

    The pairs of small groups that overlap are found together, and settled in order; a large group goes box by box.
    """

    def run(df: pd.DataFrame, page: np.ndarray) -> pd.DataFrame:
        df, starts, sizes = _groups(df, page, [] if agnostic else ["label"])
        boxes, keep = df[["x1", "y1", "x2", "y2"]].to_numpy(float), np.ones(len(df), bool)
        first = np.repeat(starts, sizes)
        for j, i in pairs(np.where(np.repeat(sizes, sizes) <= TOGETHER, first, len(df)), np.arange(len(df))):
            hit = np.flatnonzero(~(_iou(boxes[i], boxes[j]) <= threshold))
            for a, b in zip(i[hit].tolist(), j[hit].tolist(), strict=True):
                if keep[a]:
                    keep[b] = False
        for s, n in zip(starts[sizes > TOGETHER], sizes[sizes > TOGETHER], strict=True):
            left = np.arange(s, s + n)
            while len(left):
                apart = _iou(boxes[left[0]], boxes[left[1:]]) <= threshold
                keep[left[1:][~apart]] = False
                left = left[1:][apart]
        return df[keep]

    return page_by_page(detections, run, detections.schema)


def fuse_boxes(detections: DataFrame, threshold: float = 0.5, least: float = 0.0) -> DataFrame:
    """Weighted box fusion per page and label: clusters by the best overlap with a cluster's fused box, in score order.

    Small groups go together, the boxes of one place in each at a time; a large group goes alone.
    """

    def clusters(rows: np.ndarray) -> tuple[np.ndarray, ...]:
        """rows(groups, places, 5), nan where a group has no more: number of clusters, and their weights, sums, counts, boxes."""
        g, most = rows.shape[:2]
        fused, weight, total, n, m = np.full((g, most, 4), np.nan), np.zeros((g, most)), np.zeros((g, most)), np.zeros((g, most), int), np.zeros(g, int)
        for place in range(most):
            at = np.flatnonzero(~np.isnan(rows[:, place, 4]))
            row, top = rows[at, place], int(m[at].max(initial=0))
            k = m[at]
            if top:
                overlap = _iou(row[:, None, :4], fused[at, :top])
                overlap = np.where(np.arange(top) < m[at, None], overlap, -1.0)
                best = overlap.argmax(1)
                k = np.where(overlap[np.arange(len(at)), best] > threshold, best, k)
            new = k == m[at]
            m[at] += new
            s, w = row[:, 4], weight[at, k] + row[:, 4]
            old = np.where(new[:, None], row[:, :4], fused[at, k])
            with np.errstate(divide="ignore", invalid="ignore"):
                mixed = (old * weight[at, k][:, None] + row[:, :4] * s[:, None]) / w[:, None]
            fused[at, k] = np.where((new | (w == 0))[:, None], old, mixed)
            weight[at, k], total[at, k], n[at, k] = w, total[at, k] + s, n[at, k] + 1
        return m, total, n, fused

    def run(df: pd.DataFrame, page: np.ndarray) -> pd.DataFrame:
        sure = (df.score >= least).to_numpy()
        df, starts, sizes = _groups(df[sure], page[sure], ["label"])
        values, out = df[["x1", "y1", "x2", "y2", "score"]].to_numpy(float), []
        small = np.flatnonzero(sizes <= TOGETHER)
        for at in ([small] if len(small) else []) + [np.array([g]) for g in np.flatnonzero(sizes > TOGETHER)]:
            of = np.repeat(np.arange(len(at)), sizes[at])
            place = np.arange(len(of)) - np.repeat(np.cumsum(sizes[at]) - sizes[at], sizes[at])
            rows = np.full((len(at), int(sizes[at].max()), 5), np.nan)
            rows[of, place] = values[starts[at][of] + place]
            m, total, n, fused = clusters(rows)
            of = np.repeat(np.arange(len(at)), m)
            k = np.arange(len(of)) - np.repeat(np.cumsum(m) - m, m)
            head = df.iloc[starts[at][of]]
            boxes = dict(zip(("x1", "y1", "x2", "y2"), fused[of, k].T, strict=True))
            out.append(pd.DataFrame({"doc_id": head.doc_id.to_numpy(), "page_num": head.page_num.to_numpy(), "label": head.label.to_numpy(), "cluster": k, "score": total[of, k] / n[of, k], "n": n[of, k], **boxes}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=["doc_id", "page_num", "label", "cluster", "score", "n", "x1", "y1", "x2", "y2"])

    kinds = dict(detections.dtypes)
    return page_by_page(detections, run, f"doc_id {kinds['doc_id']}, page_num {kinds['page_num']}, label {kinds['label']}, cluster int, score double, n int, x1 double, y1 double, x2 double, y2 double")


def stable_zone(zones: DataFrame, boxes: DataFrame, by: list[str], width: int, height: int) -> DataFrame:
    """zones(by, lx1..ly2 of the template's box, sx1..sy2 of the search box, min_w, min_h) and candidate boxes(by, x1..y2): a zone per row.

    The centre is the candidates' median centre, blended .70 to .30 across and .75 to .25 down with the template's; the
    size is the greatest of the least size, the hull and the 75 % size with their margins, and the template's. Without
    candidates the template's box is enlarged. The zone is kept within a band around the template's row, the search box
    and the page.
    """
    mid = lambda a, b: F.percentile((F.col(a) + F.col(b)) / 2, F.lit(0.5))
    part = lambda a, b: F.percentile(F.col(b) - F.col(a), F.lit(0.75))
    seen = boxes.groupBy(*by).agg(mid("x1", "x2").alias("mx"), mid("y1", "y2").alias("my"), part("x1", "x2").alias("pw"), part("y1", "y2").alias("ph"), (F.max("x2") - F.min("x1")).alias("uw"), (F.max("y2") - F.min("y1")).alias("uh"))
    z = zones.join(seen, by, "left")
    whole = lambda c: F.rint(c).cast("int")
    lw, lh = F.greatest(F.lit(1), F.col("lx2") - F.col("lx1")), F.greatest(F.lit(1), F.col("ly2") - F.col("ly1"))
    cx0, cy0 = (F.col("lx1") + F.col("lx2")) / 2, (F.col("ly1") + F.col("ly2")) / 2
    some = F.col("mx").isNotNull()
    cx = F.when(some, 0.70 * F.col("mx") + 0.30 * cx0).otherwise(cx0)
    cy = F.when(some, 0.75 * F.col("my") + 0.25 * cy0).otherwise(cy0)
    size = lambda least, hull, m, p, n, own, k, alone: F.when(some, whole(F.greatest(F.col(least).cast("double"), F.greatest(F.col(hull), F.lit(1)) + m, F.col(p) + n, own * k))).otherwise(F.greatest(F.col(least), whole(own * alone)))
    top, bottom = F.greatest("sy1", F.col("ly1") - whole(lh * 0.45)), F.least("sy2", F.col("ly2") + whole(lh * 0.55))
    z = z.select(*by, "sx1", "sx2", cx.alias("cx"), cy.alias("cy"), size("min_w", "uw", 48.0, "pw", 36.0, lw, 0.92, 1.05).alias("w"), size("min_h", "uh", 28.0, "ph", 24.0, lh, 1.18, 1.20).alias("h"), top.alias("top"), bottom.alias("bottom"))
    z = z.withColumn("w", F.least("w", F.greatest(F.lit(1), F.col("sx2") - F.col("sx1")))).withColumn("h", F.least("h", F.greatest(F.lit(1), F.col("bottom") - F.col("top"))))
    x = F.greatest("sx1", F.least(F.col("sx2") - F.col("w"), whole(F.col("cx") - F.col("w") / 2)))
    y = F.greatest("top", F.least(F.col("bottom") - F.col("h"), whole(F.col("cy") - F.col("h") / 2)))
    z = z.withColumn("x1", x).withColumn("y1", y)
    return z.select(*by, *clipped(F.col("x1"), F.col("y1"), F.col("x1") + F.col("w"), F.col("y1") + F.col("h"), width, height))


def clipped(x1: Column, y1: Column, x2: Column, y2: Column, width: int, height: int) -> list[Column]:
    """Corners within the page, at least one pixel apart."""
    left, above = F.greatest(F.lit(0), F.least(x1, F.lit(width - 1))), F.greatest(F.lit(0), F.least(y1, F.lit(height - 1)))
    right, below = F.greatest(left + 1, F.least(x2, F.lit(width))), F.greatest(above + 1, F.least(y2, F.lit(height)))
    return [c.cast("int").alias(n) for c, n in ((left, "x1"), (above, "y1"), (right, "x2"), (below, "y2"))]
