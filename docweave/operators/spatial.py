"""Spatial evaluation: box matching page by page, reading order, confusion matrix, per-category metrics."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.functions import columns as c

BOX = ("x0", "y0", "x1", "y1")


def candidate_edges(references: DataFrame, predictions: DataFrame, page: list[str], threshold: float = 0.5) -> DataFrame:
    """(page, ref_id, ref_order, pred_id, pred_order, iou) of the pairs on a page whose IoU reaches the threshold.

    An equi-join on the page; ``references`` and ``predictions`` have the page, id, order and x0 .. y1.  Pairs without a
    box, or of boxes without area, have none.  A page's regions are few by nature, so a page's pairs are too.
    """
    if not 0 <= threshold <= 1:
        raise ValueError("threshold is a share")
    r = references.select(*page, F.col("id").alias("ref_id"), F.col("order").alias("ref_order"), *(F.col(x).alias(f"r_{x}") for x in BOX))
    p = predictions.select(*page, F.col("id").alias("pred_id"), F.col("order").alias("pred_order"), *(F.col(x).alias(f"p_{x}") for x in BOX))
    both = r.join(p, page)
    apart = (F.col("r_x1") <= F.col("p_x0")) | (F.col("p_x1") <= F.col("r_x0")) | (F.col("r_y1") <= F.col("p_y0")) | (F.col("p_y1") <= F.col("r_y0"))
    if threshold > 0:
        both = both.where(~apart)  # cheap test before the division
    value = c.iou([F.col(f"r_{x}") for x in BOX], [F.col(f"p_{x}") for x in BOX])
    return both.select(*page, "ref_id", "ref_order", "pred_id", "pred_order", value.alias("iou")).where(F.col("iou") >= threshold)


def best_assignment(edges: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """Among the assignments with the most pairs, one whose exact sum of weights is largest.

    Successive cheapest augmenting paths with exact rational costs: after k rounds the assignment is the best of k pairs,
    so the last round has the most pairs and, of those, the largest sum.  Of equally cheap paths the lexicographically
    smallest sequence of vertices is taken, so repeated runs agree.
    """
    left = sorted({a for a, _, _ in edges})
    weight = {(a, b): Fraction(w) for a, b, w in edges}
    near: dict[int, list[int]] = {a: sorted(b for x, b in weight if x == a) for a in left}
    mate_of_left: dict[int, int] = {}
    mate_of_right: dict[int, int] = {}
    while True:
        # label of a right vertex: (cost, path); cost counts an edge into the assignment as -weight and out of it as +weight
        label: dict[int, tuple[Fraction, tuple[int, ...]]] = {}
        at_left: dict[int, tuple[Fraction, tuple[int, ...]]] = {a: (Fraction(0), (a,)) for a in left if a not in mate_of_left}
        active = list(at_left)
        while active:
            reached: set[int] = set()
            for a in active:
                cost, path = at_left[a]
                for b in near[a]:
                    if mate_of_left.get(a) == b:
                        continue
                    offer = (cost - weight[a, b], (*path, b))
                    if b not in label or offer < label[b]:
                        label[b] = offer
                        reached.add(b)
            active = []
            for b in sorted(reached):
                if (a := mate_of_right.get(b)) is not None:
                    cost, path = label[b]
                    offer = (cost + weight[a, b], (*path, a))
                    if a not in at_left or offer < at_left[a]:
                        at_left[a] = offer
                        active.append(a)
        ends = [label[b] for b in label if b not in mate_of_right]
        if not ends:
            break
        path = min(ends)[1]
        for a, b in zip(path[::2], path[1::2], strict=True):
            mate_of_left[a], mate_of_right[b] = b, a
    return [(a, b, float(weight[a, b])) for a, b in sorted(mate_of_left.items())]


def matches(edges: DataFrame, page: list[str]) -> DataFrame:
    """(page, ref_id, pred_id, iou): each page's assignment of most pairs and largest exact sum of IoU.

    Edges that are alone on both sides are matched natively; only pages where regions compete go to Python.
    """
    both = edges.withColumn("_r", F.count("*").over(Window.partitionBy(*page, "ref_id"))).withColumn("_p", F.count("*").over(Window.partitionBy(*page, "pred_id")))
    alone = (F.col("_r") == 1) & (F.col("_p") == 1)
    kinds = dict(edges.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in (*page, "ref_id", "pred_id", "iou"))

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["ref_order", "ref_id", "pred_order", "pred_id"], kind="stable")
        refs = {k: i for i, k in enumerate(dict.fromkeys(zip(group["ref_order"], group["ref_id"], strict=True)))}
        preds = {k: i for i, k in enumerate(sorted(set(zip(group["pred_order"], group["pred_id"], strict=True))))}
        edges_ = [(refs[ro, r], preds[po, p], w) for ro, r, po, p, w in zip(group["ref_order"], group["ref_id"], group["pred_order"], group["pred_id"], group["iou"], strict=True)]
        ref_ids, pred_ids = [k[1] for k in refs], [k[1] for k in preds]
        rows = [(*(group[k].iloc[0] for k in page), ref_ids[a], pred_ids[b], w) for a, b, w in best_assignment(edges_)]
        return pd.DataFrame(rows, columns=[*page, "ref_id", "pred_id", "iou"])

    contested = both.where(~alone).groupBy(*page).applyInPandas(solve, schema)
    return both.where(alone).select(*page, "ref_id", "pred_id", "iou").unionByName(contested)


def order_accuracy(pairs: DataFrame, document: list[str]) -> DataFrame:
    """(document, comparable, concordant, order_accuracy): pairs of matches whose predicted order agrees with the reference's.

    ``pairs``: document, ref_rank (a total order of all audited pages' matches) and pred_order.  Under two matches there
    is no row.  Equal predicted orders are wrong.  Pairs are counted, not made: in reference order each match asks a
    sorted list how many before it are smaller.
    """
    kinds = dict(pairs.dtypes)

    def count(group: pd.DataFrame) -> pd.DataFrame:
        seen: list[int] = []
        concordant = 0
        for order in group.sort_values("ref_rank")["pred_order"].tolist():
            place = bisect_left(seen, order)
            concordant += place
            seen.insert(place, order)
        n = len(seen)
        return pd.DataFrame([(*(group[k].iloc[0] for k in document), n * (n - 1) // 2, concordant)], columns=[*document, "comparable", "concordant"])

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in document) + ", comparable bigint, concordant bigint"
    done = pairs.select(*document, "ref_rank", "pred_order").groupBy(*document).applyInPandas(count, schema).where("comparable > 0")
    return done.withColumn("order_accuracy", F.col("concordant") / F.col("comparable"))


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0.0 where the whole is 0."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """Precision, recall and F1 with zero for undefined ones."""
    p, r = share(tp, tp + fp), share(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), share(2 * p * r, p + r).alias("f1")]


def overall(references: DataFrame, predictions: DataFrame, matched: DataFrame, document: list[str]) -> DataFrame:
    """(document, references, predictions, tp, fp, fn, precision, recall, f1, mean_iou, accuracy).

    ``matched`` may have ``same``: whether a pair's categories agree; ``accuracy`` is the share of pairs for which they do.
    Mean IoU and accuracy are 0 without a match; the mean is rounded to 6 places, since sums depend on their order.
    """
    counts = (
        references.groupBy(*document).agg(F.count("*").alias("references"))
        .join(predictions.groupBy(*document).agg(F.count("*").alias("predictions")), document, "full")
        .join(matched.groupBy(*document).agg(F.count("*").alias("tp"), F.round(F.avg("iou"), 6).alias("mean_iou"), (F.count_if("same") if "same" in matched.columns else F.max(F.lit(None).cast("bigint"))).alias("_same")), document, "left")
        .fillna(0, ["references", "predictions", "tp", *(["_same"] if "same" in matched.columns else [])]).fillna(0.0, ["mean_iou"])
    )
    tp, fp, fn = F.col("tp"), F.col("predictions") - F.col("tp"), F.col("references") - F.col("tp")
    return counts.select(*document, "references", "predictions", "tp", fp.alias("fp"), fn.alias("fn"), *prf(tp, fp, fn), "mean_iou", (share(F.col("_same"), tp) if "same" in matched.columns else F.lit(None).cast("double")).alias("accuracy"))


def confusion(pairs: DataFrame, unmatched_references: DataFrame, unmatched_predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, ref_category, pred_category, pairs): dense square over all seen categories, in long form.

    ``pairs`` has ref_category and pred_category; the unmatched sides have category.  Categories are a closed list of
    eleven, so the square is small whatever the data.
    """
    seen = pairs.select(*by, F.explode(F.array("ref_category", "pred_category")).alias("k")).union(unmatched_references.select(*by, "category")).union(unmatched_predictions.select(*by, "category")).where("k is not null")
    every = seen.groupBy(*by).agg(F.sort_array(F.collect_set("k")).alias("all"))
    square = every.select(*by, F.explode("all").alias("ref_category"), "all").select(*by, "ref_category", F.explode("all").alias("pred_category"))
    key = [*by, "ref_category", "pred_category"]
    return square.join(pairs.groupBy(*key).agg(F.count("*").alias("pairs")), key, "left").fillna(0, ["pairs"])


def per_category(pairs: DataFrame, unmatched_references: DataFrame, unmatched_predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, category, tp, fp, fn, precision, recall, f1): diagonal, and off-diagonal plus unmatched on either side."""
    rows = (
        pairs.select(*by, F.inline(F.array(F.struct(F.col("ref_category").alias("category"), (F.col("ref_category") == F.col("pred_category")).cast("int").alias("tp"), F.lit(0).alias("fp"), (F.col("ref_category") != F.col("pred_category")).cast("int").alias("fn")), F.struct(F.col("pred_category").alias("category"), F.lit(0).alias("tp"), (F.col("ref_category") != F.col("pred_category")).cast("int").alias("fp"), F.lit(0).alias("fn")))))
        .union(unmatched_references.select(*by, "category", F.lit(0), F.lit(0), F.lit(1)))
        .union(unmatched_predictions.select(*by, "category", F.lit(0), F.lit(1), F.lit(0)))
    )
    sums = rows.groupBy(*by, "category").agg(*(F.sum(k).alias(k) for k in ("tp", "fp", "fn")))
    return sums.select(*by, "category", "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def unmatched(side: DataFrame, matched: DataFrame, page: list[str], id_: str) -> DataFrame:
    """The rows of one side without a match (anti-join)."""
    return side.join(matched.select(*page, F.col(id_).alias("id")), [*page, "id"], "left_anti")


