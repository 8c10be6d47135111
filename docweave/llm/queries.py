"""Named queries of the language-model text operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import packing, subjects, text_repair, tokens
from docweave.sources.tables import read_table, spread

GARBLED = (("manifests", "manifest_row_id", ["title"]), ("ref_regions", "region_row_id", ["text"]), ("ref_nodes", "node_row_id", ["title"]))
LOOK_ALIKE = (("manifests", "manifest_row_id", ["title"]), ("ref_nodes", "node_row_id", ["title", "marker_text"]))


def _garbled(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for table, key, fields in GARBLED:
        rows = spread(read_table(spark, d, table).select(key, *fields))
        parts.append(text_repair.find_garbled(rows, key, fields).withColumnRenamed(key, "row_id").withColumn("table_name", F.lit(table)))
    return reduce(DataFrame.unionByName, parts)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose title or text was decoded wrongly."""
    return _garbled(spark, d).select("table_name", "row_id")


def p1_restored(spark: SparkSession, d: str) -> DataFrame:
    """The same rows with the text before and after."""
    return _garbled(spark, d).select("table_name", "row_id", "field_name", "original", "restored", "encodings", "lossy")


def _look_alikes(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for table, key, fields in LOOK_ALIKE:
        rows = spread(read_table(spark, d, table).select(key, *fields))
        found = text_repair.find_look_alikes(rows, key, fields, markers=["marker_text"], garbled=["title"])
        parts.append(found.withColumnRenamed(key, "row_id").withColumn("table_name", F.lit(table)))
    return reduce(DataFrame.unionByName, parts)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Titles and markers that differ from their consistent form."""
    return _look_alikes(spark, d).select("table_name", "row_id", "field_name")


def p2_forms(spark: SparkSession, d: str) -> DataFrame:
    """The same values with their consistent form."""
    return _look_alikes(spark, d).select("table_name", "row_id", "field_name", "original", "consistent")


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return spread(read_table(spark, d, "marker_blocks").select("block_row_id", "html", "block_type"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of markup in each block's visible text."""
    found = text_repair.clean_markup(_blocks(spark, d), "block_row_id", "html", "block_type", only_found=True)
    return found.select("block_row_id", F.explode("markup").alias("markup"))


def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    """Clean text of every block."""
    return text_repair.clean_markup(_blocks(spark, d), "block_row_id", "html", "block_type").select("block_row_id", "clean_text")


QUERIES = {f.__name__: f for f in (p1_found, p1_restored, p2_found, p2_forms, p3_found, p3_clean)}
ORACLE_SQL: dict[str, str] = {}


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(read_table(spark, d, "documents").select("doc_id", "text"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return tokens.token_ids(_documents(spark, d), "doc_id", "text")


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    """Length of every document in tokens."""
    return tokens.token_counts(_documents(spark, d), "doc_id", "text")


def _capacities(spark: SparkSession, d: str) -> dict[str, int]:
    rows = read_table(spark, d, "pack_capacities").select("capacity_code", "capacity_tokens").where("capacity_tokens > 0").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("pack_capacities is a list of permitted lengths; over 1,000 of them are not one")
    return {r["capacity_code"]: r["capacity_tokens"] for r in rows}


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    """Every document packed into containers of each capacity, and once more into all capacities jointly."""
    capacities = _capacities(spark, d)
    packings = {code: {code: tokens_} for code, tokens_ in sorted(capacities.items())} | {"joint": capacities}
    return packing.pack(tokens.token_counts(_documents(spark, d), "doc_id", "text"), "doc_id", "tokens", packings)


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """The containers of each packing with their contents in tokens."""
    return packing.containers(p7_pack(spark, d))


def p7_waste(spark: SparkSession, d: str) -> DataFrame:
    """What each packing leaves unused, by capacity."""
    return packing.waste(p7_containers(spark, d))


QUERIES |= {f.__name__: f for f in (p6_ids, p6_counts, p7_pack, p7_containers, p7_waste)}


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """The subject areas of every document."""
    return subjects.subjects_of(read_table(spark, d, "documents"), read_table(spark, d, "subject_labels"), read_table(spark, d, "subjects"))


def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    """How many documents treat each subject area."""
    found = p8_found(spark, d)
    every = read_table(spark, d, "subjects").select(F.lower(F.trim("subject_code")).alias("subject_code")).distinct()
    return every.join(found.groupBy("subject_code").agg(F.count("*").alias("documents")), "subject_code", "left").fillna(0, ["documents"])


QUERIES |= {f.__name__: f for f in (p8_found, p8_composition)}
