"""Structural evaluation: hierarchy-aware matching of outlines, edges, titles, agreement between parsers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.functions import columns as c

GROUP = ("page_index", "kind", "ordinal_key")


def in_scope(references: DataFrame, predictions: DataFrame, document: list[str]) -> tuple[DataFrame, DataFrame]:
    """(scored references, predictions on audited pages less those on context-only paths).

    ``references``: document, page_index, kind, ordinal_key, path, parent_path, title, scored; null ``scored`` counts as
    scored.  A path is context only if it is referenced, but never scored.
    """
    scored = F.coalesce("scored", F.lit(True))
    pages = references.select(*document, "page_index").distinct()
    context = references.groupBy(*document, "path").agg(F.bool_or(scored).alias("_s")).where(~F.col("_s")).select(*document, "path")
    return references.where(scored), predictions.join(pages, [*document, "page_index"], "left_semi").join(context, [*document, "path"], "left_anti")


def match(references: DataFrame, predictions: DataFrame, document: list[str]) -> DataFrame:
    """(document, group, ref_id, pred_id, ambiguous): matched nodes.

    Groups share page, kind and ordinal key (nulls are equal).  One against one matches outright; then equal path and
    parent path, in order; the rest by parent paths that are unique on both sides, until none is.  The first two stages
    are native; only groups with something left over on both sides go to Python.  ``ambiguous`` marks matches of repeated
    identities, whose titles are not scored.
    """
    key = [*document, "_page", "_kind", "_key"]
    side = lambda df, p: df.select(*document, F.col("page_index").alias("_page"), F.col("kind").alias("_kind"), F.coalesce("ordinal_key", F.lit("")).alias("_key"), F.col("id").alias(f"{p}_id"), F.col("path").alias("_path"), F.coalesce("parent_path", F.lit("")).alias("_parent"))
    r, p = side(references, "ref"), side(predictions, "pred")
    count = lambda df, n: df.groupBy(*key).agg(F.count("*").alias(n))
    sizes = count(r, "nr").join(count(p, "np"), key)
    single = sizes.where("nr = 1 and np = 1").select(*key)
    first = r.join(single, key).select(*key, "ref_id").join(p.join(single, key).select(*key, "pred_id"), key).withColumn("ambiguous", F.lit(False))
    many = sizes.where("nr > 1 or np > 1").select(*key)
    rm, pm = r.join(many, key, "left_semi"), p.join(many, key, "left_semi")
    same = [*key, "_path", "_parent"]
    place = lambda df, i: df.withColumn("_n", F.row_number().over(Window.partitionBy(*same).orderBy(i))).withColumn("_c", F.count("*").over(Window.partitionBy(*same)))
    re_, pe = place(rm, "ref_id"), place(pm, "pred_id").withColumnRenamed("_c", "_d")
    exact = re_.join(pe, [*same, "_n"]).select(*key, "ref_id", "pred_id", ((F.col("_c") > 1) | (F.col("_d") > 1)).alias("ambiguous"))
    left_r, left_p = rm.join(exact.select(*key, "ref_id"), [*key, "ref_id"], "left_anti"), pm.join(exact.select(*key, "pred_id"), [*key, "pred_id"], "left_anti")
    kinds = dict(r.dtypes) | dict(p.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in (*key, "ref_id", "pred_id")) + ", ambiguous boolean"

    def by_parent(rs: pd.DataFrame, ps: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(rs) and len(ps):
            head = tuple(rs[k].iloc[0] for k in key)
            # a parent path that one reference and one prediction have pairs them; nothing else changes by that, so once is enough
            sides = [{p: list(ids) for p, ids in side.groupby("_parent")[name]} for side, name in ((rs, "ref_id"), (ps, "pred_id"))]
            rows = [(*head, sides[0][p][0], sides[1][p][0], False) for p in sides[0] if len(sides[0][p]) == len(sides[1].get(p, ())) == 1]
        return pd.DataFrame(rows, columns=[*key, "ref_id", "pred_id", "ambiguous"])

    # only parent paths that occur on both sides can meet
    shared = left_r.select(*key, "_parent").join(left_p.select(*key, "_parent"), [*key, "_parent"], "left_semi").distinct()
    third = left_r.join(shared, [*key, "_parent"], "left_semi").groupBy(*key).cogroup(left_p.join(shared, [*key, "_parent"], "left_semi").groupBy(*key)).applyInPandas(by_parent, schema)
    columns = [*key, "ref_id", "pred_id", "ambiguous"]
    return first.select(*columns).unionByName(exact.select(*columns)).unionByName(third).withColumnsRenamed({"_page": "page_index", "_kind": "kind", "_key": "ordinal_key"})


def match_diagnostics(references: DataFrame, predictions: DataFrame, matched: DataFrame, document: list[str]) -> DataFrame:
    """(document, page_index, kind, ordinal_key, category) of groups that matching could not tell apart.

    ambiguous_duplicate_identity_title_excluded: a repeated identity was paired in order; ambiguous_duplicate_group_unmatched:
    both sides have nodes, one has several, and some stay unmatched.
    """
    key = [*document, "page_index", "kind", "ordinal_key"]
    grouped = lambda df, n: df.withColumn("ordinal_key", F.coalesce("ordinal_key", F.lit(""))).groupBy(*key).agg(F.count("*").alias(n))
    pairs = matched.groupBy(*key).agg(F.count("*").alias("m"), F.bool_or("ambiguous").alias("a"))
    every = grouped(references, "r").join(grouped(predictions, "p"), key).join(pairs, key, "left").fillna(0, ["m"]).fillna(False, ["a"])
    left = ((F.col("r") > 1) | (F.col("p") > 1)) & ((F.col("m") < F.col("r")) | (F.col("m") < F.col("p")))
    found = F.array(F.when(F.col("a"), "ambiguous_duplicate_identity_title_excluded"), F.when(left, "ambiguous_duplicate_group_unmatched"))
    return every.select(*key, F.explode(F.array_compact(found)).alias("category"))


def traces(references: DataFrame, predictions: DataFrame, matched: DataFrame, document: list[str]) -> DataFrame:
    """(document, side, page_index, kind, ordinal_key, path, parent_path, block_kind, excerpt): nodes without a match, missed and invented ones.

    Block kind and excerpt are those of an invented node's line, and null for missed ones, which have none.
    """
    columns = [*document, "page_index", "kind", "ordinal_key", "path", "parent_path"]
    for name in ("block_kind", "excerpt"):
        references, predictions = (df if name in df.columns else df.withColumn(name, F.lit(None).cast("string")) for df in (references, predictions))
        columns.append(name)
    missed = references.join(matched.select(*document, F.col("ref_id").alias("id")), [*document, "id"], "left_anti").select(F.lit("missed").alias("side"), *columns)
    invented = predictions.join(matched.select(*document, F.col("pred_id").alias("id")), [*document, "id"], "left_anti").select(F.lit("invented").alias("side"), *columns)
    return missed.unionByName(invented)


def metric(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """Precision, recall and F1; undefined ones are null, F1 is 0.0 where both are defined and 0."""
    p, r = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), F.when(p + r == 0, 0.0).otherwise(F.try_divide(2 * p * r, p + r)).alias("f1")]


def folded_title(title: Column) -> Column:
    """Titles compare case-folded with blanks collapsed."""
    return F.trim(F.regexp_replace(c.casefold(title), "(?U)\\s+", " "))


def compare(references: DataFrame, predictions: DataFrame, matched: DataFrame, document: list[str]) -> DataFrame:
    """One row per matched pair: whether path, parent and title agree (title null where not scored)."""
    r = references.select(*document, F.col("id").alias("ref_id"), F.col("path").alias("r_path"), F.col("parent_path").alias("r_parent"), F.col("title").alias("r_title"))
    p = predictions.select(*document, F.col("id").alias("pred_id"), F.col("path").alias("p_path"), F.col("parent_path").alias("p_parent"), F.col("title").alias("p_title"))
    both = matched.join(r, [*document, "ref_id"]).join(p, [*document, "pred_id"])
    title = F.when(F.col("r_title").isNotNull() & ~F.col("ambiguous"), F.coalesce(folded_title(F.col("p_title")) == folded_title(F.col("r_title")), F.lit(False)))
    return both.select(*document, "page_index", "kind", "ref_id", "pred_id", F.col("p_path").eqNullSafe(F.col("r_path")).alias("path_exact"), F.col("p_parent").eqNullSafe(F.col("r_parent")).alias("parent_exact"), title.alias("title_exact"))


def node_metrics(references: DataFrame, predictions: DataFrame, matched: DataFrame, by: list[str]) -> DataFrame:
    """(by, tp, fp, fn, precision, recall, f1); sums of documents recomputed, so any grouping is a micro-average."""
    one = (
        matched.select(*by, F.lit(1).alias("tp"), F.lit(0).alias("p"), F.lit(0).alias("r"))
        .unionByName(predictions.select(*by, F.lit(0).alias("tp"), F.lit(1).alias("p"), F.lit(0).alias("r")))
        .unionByName(references.select(*by, F.lit(0).alias("tp"), F.lit(0).alias("p"), F.lit(1).alias("r")))
    )
    s = one.groupBy(*by).agg(F.sum("tp").alias("tp"), F.sum("p").alias("p"), F.sum("r").alias("r"))
    tp, fp, fn = F.col("tp"), F.col("p") - F.col("tp"), F.col("r") - F.col("tp")
    return s.select(*by, "tp", fp.alias("fp"), fn.alias("fn"), *metric(tp, fp, fn))


def edge_metrics(references: DataFrame, predictions: DataFrame, compared: DataFrame, by: list[str]) -> DataFrame:
    """(by, tp, fp, fn, precision, recall, f1) of parent edges.

    ``compared``: by and parent_exact of each matched pair.  A wrong parent is one too many and one missing, as are the
    edges of invented and of missed nodes; so fp and fn are what the right ones leave of either side.
    """
    return node_metrics(references, predictions, compared.where("parent_exact"), by)


def jaccard(left: DataFrame, right: DataFrame, by: list[str], item: list[str]) -> DataFrame:
    """(by, shared, only_left, only_right, jaccard) of two sets; null where both are empty."""
    a, b = left.select(*by, *item).distinct().withColumn("_a", F.lit(1)), right.select(*by, *item).distinct().withColumn("_b", F.lit(1))
    both = a.join(b, [*by, *item], "full").groupBy(*by).agg(
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("shared"), F.count_if(F.col("_b").isNull()).alias("only_left"), F.count_if(F.col("_a").isNull()).alias("only_right")
    )
    return both.withColumn("jaccard", F.try_divide(F.col("shared"), F.col("shared") + F.col("only_left") + F.col("only_right")))


def shared_items(left: DataFrame, right: DataFrame, by: list[str], item: list[str]) -> DataFrame:
    """(by, item, side): each item of two sets, as shared, only_left or only_right."""
    a, b = left.select(*by, *item).distinct().withColumn("_a", F.lit(1)), right.select(*by, *item).distinct().withColumn("_b", F.lit(1))
    side = F.when(F.col("_b").isNull(), "only_left").when(F.col("_a").isNull(), "only_right").otherwise("shared")
    return a.join(b, [*by, *item], "full").select(*by, *item, side.alias("side"))


def agreement(left: DataFrame, right: DataFrame, document: list[str]) -> DataFrame:
    """Per document, Jaccard of (kind, path) over legal kinds, generic sections and all."""
    generic = F.col("kind") == "generic_section"
    scope = F.explode(F.array(F.lit("all"), F.when(generic, "generic").otherwise("legal"))).alias("scope")
    pick = lambda df: df.where("kind <> 'document'").select(*document, scope, "kind", "path")
    return jaccard(pick(left), pick(right), [*document, "scope"], ["kind", "path"])


def unresolved(lines: DataFrame, markers: DataFrame, document: list[str], examples: int = 3) -> DataFrame:
    """(document, shape, line_total, examples): marker-shaped lines in which no node's marker starts, with a few examples.

    A range anti-join within a block.  The example list is a top-k report; the count covers all lines.
    """
    s = F.regexp_replace("line", " ", " ")
    shape = F.when(s.rlike("(?iuUd)^\\s*[a-zđ]\\)\\s"), "letter").when(s.rlike("(?iuUd)^\\s*\\d+(\\.\\d+)*\\.\\s"), "decimal").when(s.rlike("(?iuUd)^\\s*(ch[uư][oơ]ng|[dđ]i[eề]u|m[uụ]c|ph[aầ]n|ph[uụ]\\s+l[uụ]c)\\s"), "keyword")
    shaped = lines.withColumn("shape", shape).where("shape is not null")
    l, m = shaped.alias("l"), markers.select(*document, "block_id", F.col("char_start").alias("at")).alias("m")
    same = [F.col(f"l.{k}") == F.col(f"m.{k}") for k in (*document, "block_id")]
    left = l.join(m, [*same, F.col("m.at") >= F.col("l.char_start"), F.col("m.at") < F.col("l.char_end")], "left_anti")
    rank = F.row_number().over(Window.partitionBy(*document, "shape").orderBy("block_id", "char_start"))
    total = left.groupBy(*document, "shape").agg(F.count("*").alias("line_total"))
    top = left.withColumn("_k", rank).where(F.col("_k") <= examples).groupBy(*document, "shape").agg(F.concat_ws(" | ", F.transform(F.array_sort(F.collect_list(F.struct("_k", "line"))), lambda x: F.trim(x["line"]))).alias("examples"))
    return total.join(top, [*document, "shape"])
