"""Queries that audit runs, raw evidence and outlines over both raw formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import columns as c
from docweave.operators import audit, outline, physical
from docweave.plans.extraction import ITEMS, run_outline
from docweave.plans.extraction_sql import TREE_BLOCKS
from docweave.sources.tables import read_table


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return physical.all_blocks(read_table(spark, d, "mineru_items"), read_table(spark, d, "marker_trees"))


def run_histograms(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of each run by kind, kind and disposition, raw type, and change of kind between the generations; one scan."""
    return audit.measures(_blocks(spark, d), ["run_id", "parser"])


def raw_types(spark: SparkSession, d: str) -> DataFrame:
    """Blocks by parser and raw type."""
    return audit.histogram(_blocks(spark, d), "parser", "raw_type")


def diagram_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages with pictures and without text of their own."""
    return audit.diagram_pages(_blocks(spark, d))


def table_objects(spark: SparkSession, d: str) -> DataFrame:
    """The kinds that raw table objects became, by raw type (semi-join on the raw index)."""
    items = read_table(spark, d, "mineru_items")
    tables = items.where("table_body is not null or item_type = 'table'").select("run_id", "raw_index").distinct()
    blocks = physical.list_blocks(items).join(tables, ["run_id", "raw_index"], "left_semi")
    return audit.histogram(blocks, "raw_type", "kind", "disposition")


def provenance_variants(spark: SparkSession, d: str) -> DataFrame:
    """Versions that one parser ran with several versions or backends; a benchmark asks for one."""
    return audit.provenance_variants(read_table(spark, d, "parser_runs"))


def benchmark_runs(spark: SparkSession, d: str) -> DataFrame:
    """Pages, blocks, duration and pages a second (to 4 places) of each run that succeeded."""
    counts = _blocks(spark, d).groupBy("run_id", "parser").agg((F.max("page_index") + 1).cast("bigint").alias("pages"), F.count("*").alias("blocks"))
    runs = read_table(spark, d, "parser_runs").where("run_status = 'success' and duration_seconds > 0").select("run_id", "duration_seconds")
    return counts.join(runs, "run_id").withColumn("pages_per_second", F.round(F.col("pages") / F.col("duration_seconds"), 4))


def run_provenance_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Fields in which a run's record differs from its blocks or from its manifest, with both values."""
    m = read_table(spark, d, "manifests").groupBy("document_id", "version_id").agg(F.max("sha256").alias("m_sha"))
    seen = _blocks(spark, d).select("run_id", F.col("document_id").alias("b_document"), F.col("version_id").alias("b_version"), F.col("parser").alias("b_parser")).distinct()
    runs = read_table(spark, d, "parser_runs").select("run_id", "document_id", "version_id", "input_sha256", "parser").join(m, ["document_id", "version_id"], "left").join(seen, "run_id")
    fields = {"document_id": ("document_id", "b_document"), "version_id": ("version_id", "b_version"), "parser": ("parser", "b_parser"), "input_sha256": ("input_sha256", "m_sha")}
    return audit.conflicts(runs, ["run_id"], fields)


def ordinals_by_system(spark: SparkSession, d: str) -> DataFrame:
    """Keys of the reference nodes' raw ordinals by their own ordinal system."""
    n = read_table(spark, d, "ref_nodes").where("ordinal_system is not null")
    return n.select("node_row_id", "ordinal_system", c.key_for_system(F.col("ordinal_system"), F.col("ordinal_raw")).alias("key"))


def ocr_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Whether all runs of a version agree on disable_ocr; nulls say nothing."""
    return audit.boolean_agreement(read_table(spark, d, "parser_runs"), ["document_id", "version_id"], "disable_ocr")


def duplicate_rejections(spark: SparkSession, d: str) -> DataFrame:
    """Headings refused because their path was taken: totals by document, parser, kind, ordinal and page, by grouping sets."""
    found = outline.diagnostics(run_outline(spark, d), "run_id").where("category = 'duplicate_structural_key_rejected'")
    names = read_table(spark, d, "mineru_items").select("run_id", "document_id").distinct().withColumn("parser", F.lit("mineru")).union(read_table(spark, d, "marker_trees").select("run_id", "document_id").distinct().withColumn("parser", F.lit("marker")))
    return audit.totals_by(found.join(names, "run_id"), ["document_id"], ["parser"], ["kind"], ["kind", "ordinal_raw"], ["document_id", "parser", "page_index"])


QUERIES = {f.__name__: f for f in (run_histograms, raw_types, diagram_pages, table_objects, provenance_variants, benchmark_runs, run_provenance_conflicts, ordinals_by_system, ocr_agreement, duplicate_rejections)}

_EVERY = TREE_BLOCKS + ", " + ITEMS + """, every as (select run_id, document_id, version_id, 'mineru' as parser, page_index, item_type as raw_type, kind_v0, kind, disposition from blocks
  union all select run_id, document_id, version_id, 'marker', page_index, raw_type, kind_v0, kind, disposition from tree_block)
"""
_ROMAN = "regexp_full_match(upper(s), 'M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})') and s <> ''"
_VALUE = " + ".join(f"{v} * (length(s) - length(replace(upper(s), '{r}', '')))" for r, v in (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100), ("D", 500), ("M", 1000))) + "".join(f" - case when regexp_matches(upper(s), '{p}') then {v} else 0 end" for p, v in (("I[VX]", 2), ("X[LC]", 20), ("C[DM]", 200)))
ORACLE_SQL = {
    "run_histograms": _EVERY + """select run_id, parser, m.measure as measure, m.value as value, count(*) as n from (select run_id, parser, unnest([{'measure': 'kind', 'value': kind}, {'measure': 'kind_disposition', 'value': kind || '/' || disposition}, {'measure': 'raw_type', 'value': coalesce(raw_type, '')},
      {'measure': 'transition', 'value': kind_v0 || '>' || kind}]) as m from every) group by all""",
    "raw_types": _EVERY + "select parser, raw_type, count(*) as n from every group by all",
    "diagram_pages": _EVERY + "select run_id, parser, page_index, count(*) filter (where kind in ('image', 'figure')) as pictures, count(*) as blocks from every group by run_id, parser, page_index having count(*) filter (where kind in ('image', 'figure')) > 0 and count(*) filter (where kind in ('text', 'title', 'table')) = 0",
    "table_objects": "with " + ITEMS + " select item_type as raw_type, kind, disposition, count(*) as n from blocks b where exists (select 1 from mineru_items m where m.run_id = b.run_id and m.raw_index = b.raw_index and (m.table_body is not null or m.item_type = 'table')) group by all",
    "provenance_variants": """select document_id, version_id, lower(trim(parser)) as parser, count(*) as runs, count(distinct (coalesce(parser_version, ''), coalesce(backend, ''))) as variants from parser_runs group by 1, 2, 3 having count(distinct (coalesce(parser_version, ''), coalesce(backend, ''))) > 1""",
    "benchmark_runs": _EVERY + """, b as (select run_id, parser, cast(max(page_index) + 1 as bigint) as pages, count(*) as blocks from every group by all)
      select b.*, duration_seconds, round(pages / duration_seconds, 4) as pages_per_second from b join parser_runs r on b.run_id = r.run_id where run_status = 'success' and duration_seconds > 0""",
    "run_provenance_conflicts": _EVERY + """, m as (select document_id, version_id, max(sha256) as m_sha from manifests group by all), s as (select distinct run_id, document_id as bd, version_id as bv, parser as bp from every),
      v as (select r.run_id, unnest([{'f': 'document_id', 'a': r.document_id, 'b': bd}, {'f': 'version_id', 'a': r.version_id, 'b': bv}, {'f': 'parser', 'a': r.parser, 'b': bp}, {'f': 'input_sha256', 'a': input_sha256, 'b': m_sha}]) as x from parser_runs r left join m using (document_id, version_id) join s on s.run_id = r.run_id)
      select run_id, x.f as field, x.a as recorded, x.b as found from v where x.a is distinct from x.b""",
    "ordinals_by_system": f"""with n as (select *, lower(regexp_replace(trim(ordinal_raw), '^[.:-]+|[.:-]+$', '', 'g')) as s from ref_nodes where ordinal_system is not null),
      k as (select *, case when regexp_full_match(s, '\\d+[a-zđ]?') then s end as num, case when regexp_full_match(s, '[a-zđ]') then s end as letter, case when regexp_full_match(s, '\\d+(\\.\\d+)*') then s end as dotted, case when {_ROMAN} then cast({_VALUE} as varchar) end as roman from n)
      select node_row_id, ordinal_system, case when ordinal_system = 'formal_container' then coalesce(num, roman) when ordinal_system in ('article', 'clause') then num when ordinal_system in ('point', 'generic_letter') then letter when ordinal_system in ('generic_roman', 'roman') then roman when ordinal_system = 'generic_decimal' then dotted end as key from k""",
    "ocr_agreement": "select document_id, version_id, case when bool_or(disable_ocr) = bool_and(disable_ocr) then bool_or(disable_ocr) end as value, coalesce(bool_or(disable_ocr) <> bool_and(disable_ocr), false) as conflict from parser_runs group by all",
    "kind_disposition_matrix_all": _EVERY + "select raw_type, kind, disposition, parser, count(*) as n from every group by all",
    "kind_transitions_all": _EVERY + "select kind_v0, kind, parser, count(*) as n from every group by all",
    "run_throughput_all": _EVERY + ", b as (select run_id, parser, cast(max(page_index) + 1 as bigint) as pages from every group by all) select b.run_id as run_id, pages, duration_seconds, pages / duration_seconds as pages_per_second, b.parser as parser from b join parser_runs r on b.run_id = r.run_id where duration_seconds > 0",
    "page_checks_all": _EVERY + ", b as (select run_id, parser, min(page_index) as low, max(page_index) as high, count(distinct page_index) as n from every group by all) select run_id, cast(null as integer) as page_index, 'pages_not_contiguous' as rule_id, parser from b where low <> 0 or high <> n - 1",
}
