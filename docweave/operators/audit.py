"""Corpus audits: histograms, transitions, roll-ups, throughput, coverage, determinism."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def histogram(df: DataFrame, *by: str) -> DataFrame:
    """(by, n): counts of each combination; nulls are a value of their own."""
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def transitions(blocks: DataFrame) -> DataFrame:
    """(kind_v0, kind, n): how kinds changed between the generations."""
    return histogram(blocks, "kind_v0", "kind")


def rolled_up(df: DataFrame, *by: str, **measures: str) -> DataFrame:
    """Counts and sums by all prefixes of ``by``; ``level`` tells totals from null keys."""
    return df.rollup(*by).agg(F.grouping_id().cast("bigint").alias("level"), F.count("*").alias("n"), *(F.sum(c).cast("bigint").alias(name) for name, c in measures.items()))


def block_summary(blocks: DataFrame) -> DataFrame:
    """One row per run: blocks, content blocks, titles, tables, images, characters."""
    return blocks.groupBy("run_id").agg(
        F.count("*").alias("blocks"), F.count_if(F.col("disposition") == "content").alias("content"), F.count_if(F.col("kind") == "title").alias("titles"), F.count_if(F.col("kind") == "table").alias("tables"),
        F.count_if(F.col("kind").isin("image", "figure")).alias("images"), F.sum(F.length("text")).cast("bigint").alias("characters"), (F.max("page_index") + 1).cast("bigint").alias("pages"),
    )


def throughput(runs: DataFrame, pages: DataFrame) -> DataFrame:
    """(run_id, pages, duration_seconds, pages_per_second) of runs with a positive duration."""
    good = runs.where("duration_seconds > 0").select("run_id", "duration_seconds")
    return pages.select("run_id", F.col("page_count").cast("bigint").alias("pages")).join(good, "run_id").withColumn("pages_per_second", F.col("pages") / F.col("duration_seconds"))


def coverage(runs: DataFrame) -> DataFrame:
    """(document_id, version_id, marker, mineru): which parsers succeeded on a version; spelling of names set aside."""
    ok = runs.where(F.col("run_status") == "success").select("document_id", "version_id", F.lower(F.trim("parser")).alias("p"))
    return ok.groupBy("document_id", "version_id").agg(F.bool_or(F.col("p") == "marker").alias("marker"), F.bool_or(F.col("p") == "mineru").alias("mineru"))


def same_twice(first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """(key, first, second) where two runs of an operator differ; empty when it is deterministic."""
    a, b = first.select(key, F.col(value).alias("first")), second.select(key, F.col(value).alias("second"))
    return a.join(b, key, "full").where(~F.col("first").eqNullSafe(F.col("second")))


def row_spans(cells: DataFrame, key: str) -> DataFrame:
    """(key, cells, row_spans, column_spans, headers) of each accepted table."""
    return cells.where("grid_ok").groupBy(key).agg(F.count("row_start").alias("cells"), F.count_if(F.col("row_span") > 1).alias("row_spans"), F.count_if(F.col("column_span") > 1).alias("column_spans"), F.count_if("is_header").alias("headers"))


def measures(blocks: DataFrame, by: list[str]) -> DataFrame:
    """(by, measure, value, n): histograms of several measures in one pass."""
    value = lambda name, v: F.struct(F.lit(name).alias("measure"), v.alias("value"))
    every = F.array(value("kind", F.col("kind")), value("kind_disposition", F.concat_ws("/", "kind", "disposition")), value("raw_type", F.coalesce("raw_type", F.lit(""))), value("transition", F.concat_ws(">", "kind_v0", "kind")))
    return histogram(blocks.select(*by, F.inline(every)), *by, "measure", "value")


def diagram_pages(blocks: DataFrame) -> DataFrame:
    """(run_id, parser, page_index, pictures, blocks): pages that hold pictures, and neither text, titles nor tables."""
    pages = blocks.groupBy("run_id", "parser", "page_index").agg(F.count_if(F.col("kind").isin("image", "figure")).alias("pictures"), F.count_if(F.col("kind").isin("text", "title", "table")).alias("_words"), F.count("*").alias("blocks"))
    return pages.where("pictures > 0 and _words = 0").drop("_words")


def provenance_variants(runs: DataFrame) -> DataFrame:
    """(document_id, version_id, parser, runs, variants) where a parser ran a version with several versions or backends; null is a value of its own."""
    kinds = F.struct(F.coalesce("parser_version", F.lit("")), F.coalesce("backend", F.lit("")))
    return runs.groupBy("document_id", "version_id", F.lower(F.trim("parser")).alias("parser")).agg(F.count("*").alias("runs"), F.count_distinct(kinds).alias("variants")).where("variants > 1")


def conflicts(df: DataFrame, keys: list[str], fields: dict[str, tuple[str, str]]) -> DataFrame:
    """(keys, field, recorded, found) of each field whose two columns differ; nulls are equal."""
    every = F.array(*(F.struct(F.lit(n).alias("field"), F.col(a).alias("recorded"), F.col(b).alias("found")) for n, (a, b) in fields.items()))
    return df.select(*keys, F.inline(F.filter(every, lambda x: ~x["recorded"].eqNullSafe(x["found"]))))


def boolean_agreement(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """(by, value, conflict): the one value that all non-null booleans of a group share; null without any, or with a conflict."""
    both = df.groupBy(*by).agg(F.bool_or(column).alias("_any"), F.bool_and(column).alias("_all"))
    same = F.col("_any") == F.col("_all")
    return both.select(*by, F.when(same, F.col("_any")).alias("value"), F.coalesce(~same, F.lit(False)).alias("conflict"))


def totals_by(df: DataFrame, *sets: list[str]) -> DataFrame:
    """(grouping, columns of all sets, n): counts by each set of columns and over all, in one pass; columns outside a row's set are null."""
    names = list(dict.fromkeys(n for s in sets for n in s))
    label = F.array_join(F.array_compact(F.array(*(F.when(F.grouping(n) == 0, F.lit(n)) for n in names))), "+")
    counted = df.groupingSets([[F.col(n) for n in s] for s in (*sets, [])], *names).agg(label.alias("grouping"), F.count("*").alias("n"))
    return counted.select("grouping", *names, "n")


def zipped(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rule_id): places that only one of two positional tables has; none if they can be zipped strictly."""
    a, b = first.groupBy(*keys).agg(F.count("*").alias("_a")), second.groupBy(*keys).agg(F.count("*").alias("_b"))
    rule = F.when(F.col("_b").isNull(), "only_first").when(F.col("_a").isNull(), "only_second").when((F.col("_a") > 1) | (F.col("_b") > 1), "place_repeated")
    return a.join(b, keys, "full").select(*keys, rule.alias("rule_id")).where("rule_id is not null")
