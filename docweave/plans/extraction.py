"""Queries from raw parser output to blocks, tables and outlines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators import assets, audit, canonical, checks, html_text, nested, outline, physical
from docweave.plans import extraction_sql as sql
from docweave.sources.tables import checkpointed, read_table, spread


def list_blocks_of(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of the flat lists."""
    return physical.list_blocks(read_table(spark, d, "mineru_items"))


def tree_blocks_of(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of the nested trees."""
    return physical.tree_blocks(read_table(spark, d, "marker_trees"))


def list_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Flat-list items as blocks of both generations."""
    b = list_blocks_of(spark, d)
    return b.select("run_id", "raw_index", "page_index", F.col("reading_order").cast("bigint").alias("reading_order"), "block_id", "kind_v0", "disposition_v0", "kind", "disposition", F.md5("text").alias("text_md5"), "x0", "y1", "heading_level")


def tree_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Nested-tree blocks with projected boxes and visible text."""
    return tree_blocks_of(spark, d)


def kind_disposition_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Blocks by raw type, kind and disposition."""
    return audit.histogram(list_blocks_of(spark, d), "raw_type", "kind", "disposition")


def kind_transitions(spark: SparkSession, d: str) -> DataFrame:
    """How kinds changed between the generations."""
    return audit.transitions(list_blocks_of(spark, d))


def block_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counts of each run's blocks."""
    return audit.block_summary(list_blocks_of(spark, d))


def run_throughput(spark: SparkSession, d: str) -> DataFrame:
    """Pages per second of each run."""
    return audit.throughput(read_table(spark, d, "parser_runs"), physical.page_counts(list_blocks_of(spark, d)))


def _each(spark: SparkSession, d: str, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The operator on the blocks of each raw format, with the parser's name.  Queries without _all keep to the flat lists, as their SQL does."""
    trees = tree_blocks_of(spark, d).drop("problem")
    return operator(list_blocks_of(spark, d)).withColumn("parser", F.lit("mineru")).unionByName(operator(trees).withColumn("parser", F.lit("marker")))


def kind_disposition_matrix_all(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of both parsers by raw type, kind and disposition."""
    return _each(spark, d, lambda b: audit.histogram(b, "raw_type", "kind", "disposition"))


def kind_transitions_all(spark: SparkSession, d: str) -> DataFrame:
    """How kinds changed between the generations, for both parsers."""
    return _each(spark, d, audit.transitions)


def block_summary_all(spark: SparkSession, d: str) -> DataFrame:
    """Counts of each run's blocks, for both parsers."""
    return _each(spark, d, audit.block_summary)


def run_throughput_all(spark: SparkSession, d: str) -> DataFrame:
    """Pages per second of each run of both parsers."""
    return _each(spark, d, lambda b: audit.throughput(read_table(spark, d, "parser_runs"), physical.page_counts(b)))


def block_checks_all(spark: SparkSession, d: str) -> DataFrame:
    """Rules that single blocks of both parsers break; tree_contract stands for broken references of a tree's block."""
    broken = tree_blocks_of(spark, d).where("problem is not null").select("run_id", "block_id", F.lit("tree_contract").alias("rule_id"), F.lit("marker").alias("parser"))
    return _each(spark, d, checks.block_violations).unionByName(broken)


def page_checks_all(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose reading order is not contiguous, and runs whose pages are not, for both parsers."""
    return _each(spark, d, lambda b: checks.page_violations(b).unionByName(checks.document_violations(b).withColumn("page_index", F.lit(None).cast("int"))))


def block_checks(spark: SparkSession, d: str) -> DataFrame:
    """Rules that single blocks break."""
    return checks.block_violations(list_blocks_of(spark, d))


def page_checks(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose reading order is not contiguous, and runs whose pages are not."""
    b = list_blocks_of(spark, d)
    return checks.page_violations(b).unionByName(checks.document_violations(b).withColumn("page_index", F.lit(None).cast("int")))


def _documents_of(spark: SparkSession, d: str, blocks: DataFrame) -> DataFrame:
    """Blocks with the provenance of their runs: digest, version and backend; blank ones count as unknown."""
    said = lambda n: F.when(F.trim(n) != "", F.trim(n))
    runs = read_table(spark, d, "parser_runs").select("run_id", F.lower(said("input_sha256")).alias("source_artifact_sha256"), said("parser_version").alias("parser_version"), said("backend").alias("parser_backend"))
    return blocks.join(runs, "run_id", "left")


def canonical_identity(spark: SparkSession, d: str) -> DataFrame:
    """Identity hash of each run's canonical physical document, for both parsers."""
    blocks = physical.all_blocks(read_table(spark, d, "mineru_items"), read_table(spark, d, "marker_trees"))
    return canonical.chunks(_documents_of(spark, d, blocks), with_text=False).select("run_id", "parser", "sha256", "n_chars")


def canonical_identity_lists(spark: SparkSession, d: str) -> DataFrame:
    """The same for the flat lists in the first generation's form."""
    return canonical.identities(_documents_of(spark, d, list_blocks_of(spark, d)).withColumn("parser", F.lit("mineru")), generation=1)


def canonical_determinism(spark: SparkSession, d: str) -> DataFrame:
    """Runs whose identity differs when their blocks come in another order; none if all is well."""
    blocks = _documents_of(spark, d, list_blocks_of(spark, d)).withColumn("parser", F.lit("mineru"))
    return audit.same_twice(canonical.identities(blocks), canonical.identities(blocks.repartition(7, "block_id")), "run_id", "sha256")


def tree_block_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Nested-tree blocks with kinds and projected boxes, without their text."""
    t = tree_blocks_of(spark, d)
    return t.select("run_id", "page_index", "reading_order", "raw_index", "block_id", "raw_type", "kind_v0", "kind", "disposition", "x0", "y0", "x1", "y1")


def embedded_assets(spark: SparkSession, d: str) -> DataFrame:
    """Embedded images of all tree nodes, fingerprinted; problem says why one is refused."""
    nodes = nested.nodes(spread(read_table(spark, d, "marker_trees").select("tree_id", "raw_json")), "tree_id", "raw_json")
    found = assets.embedded(nodes.select("tree_id", "node_path", F.explode("images").alias("image_id", "image")), ["tree_id", "node_path", "image_id"], "image")
    return found.select("tree_id", "node_path", "image_id", "asset.storage_kind", "asset.media_type", "asset.sha256", "asset.byte_size", "problem")


def _tables(spark: SparkSession, d: str) -> DataFrame:
    return html_text.table_cells(spread(read_table(spark, d, "mineru_items").select("item_id", "table_body")), "item_id", "table_body")


def table_grid_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of every table on its logical grid."""
    return _tables(spark, d)


def table_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Rows, columns and cells of each accepted table."""
    return _tables(spark, d).where("grid_ok").groupBy("item_id", F.col("row_count").cast("bigint").alias("row_count"), F.col("column_count").cast("bigint").alias("column_count")).agg(F.count("row_start").alias("cells"))


def table_grid_cells_all(spark: SparkSession, d: str) -> DataFrame:
    """Cells of every table of both parsers on its logical grid; table_id is the item's id, or the run's and the node's path.

    Tables of trees count at any depth, since most stand in table groups; a tree delivered again counts once.
    """
    once = physical.latest(read_table(spark, d, "marker_trees").select("run_id", "ingested_at", "tree_id", "raw_json"), ["run_id"], "ingested_at", "tree_id")
    tables = nested.of_type(nested.nodes(once, "run_id", "raw_json"), "Table")
    trees = tables.select(F.concat_ws("/", F.lit("marker"), F.col("tree_id").cast("string"), "node_path").alias("table_id"), "html")
    items = read_table(spark, d, "mineru_items").select(F.concat_ws("/", F.lit("mineru"), "item_id").alias("table_id"), F.col("table_body").alias("html"))
    return html_text.table_cells(spread(items.unionByName(trees)), "table_id", "html").withColumn("parser", F.substring_index("table_id", "/", 1))


def table_shapes_all(spark: SparkSession, d: str) -> DataFrame:
    """Rows, columns and cells of each accepted table of both parsers."""
    cells = table_grid_cells_all(spark, d).where("grid_ok")
    return cells.groupBy("parser", "table_id", F.col("row_count").cast("bigint").alias("row_count"), F.col("column_count").cast("bigint").alias("column_count")).agg(F.count("row_start").alias("cells"))


def grid_overlap_violations(spark: SparkSession, d: str) -> DataFrame:
    """Grid places that two cells cover; none by construction."""
    return html_text.grid_overlaps(_tables(spark, d), "item_id")


def visible_text_stats(spark: SparkSession, d: str) -> DataFrame:
    """Length of each block's visible text, and its heading level."""
    v = html_text.visible_columns(spread(read_table(spark, d, "marker_blocks").select("block_row_id", "html")), "block_row_id", "html")
    return v.select("block_row_id", F.length("visible_text").alias("n"), "heading_level")


def _text_blocks(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "documents").where(F.length("text") > 0)
    return spread(t.select("doc_id", F.coalesce("page_index", F.lit(0)).alias("page_index"), F.format_string("d%d", "doc_id").alias("block_id"), F.lit("text").alias("kind"), F.lit("content").alias("disposition"), "text"))


def text_outline(spark: SparkSession, d: str) -> DataFrame:
    """Outline records of every document text, each a document of one block."""
    return outline.outline_records(_text_blocks(spark, d), "doc_id", ordered=False)


def run_outline(spark: SparkSession, d: str) -> DataFrame:
    """Outline records of every parser run's blocks, both raw formats."""
    blocks = physical.all_blocks(read_table(spark, d, "mineru_items"), read_table(spark, d, "marker_trees"))
    return outline.outline_records(blocks, "run_id")


def outline_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of the outlines of all document texts."""
    return outline.nodes(text_outline(spark, d), "doc_id").drop("sequence")


def outline_run_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of the outlines of all parser runs."""
    return outline.nodes(run_outline(spark, d), "run_id").drop("sequence")


def outline_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Nodes by kind and depth over all document texts."""
    return audit.histogram(text_outline(spark, d).where("record = 'node'"), "kind", "depth")


def outline_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Refused candidates by category and kind: contents entries, prose references, duplicates, bad Roman numerals."""
    return audit.histogram(outline.diagnostics(text_outline(spark, d), "doc_id"), "category", "kind")


def outline_partition(spark: SparkSession, d: str) -> DataFrame:
    """Content blocks that the anchors do not cover exactly; none if all is well."""
    records = text_outline(spark, d)
    return checks.anchor_partition(_text_blocks(spark, d), outline.anchors(records, "doc_id"), "doc_id")


def hierarchy_edges(spark: SparkSession, d: str) -> DataFrame:
    """Broken nodes, anchors and parent edges of the outlines; none if all is well."""
    records = checkpointed(text_outline(spark, d))  # read three times
    n = outline.nodes(records, "doc_id")
    own = checks.node_violations(n, "doc_id").unionByName(checks.hierarchy_violations(n, "doc_id"))
    return own.unionByName(checks.anchor_violations(outline.anchors(records, "doc_id"), "doc_id").drop("block_id"))


def outline_cover(spark: SparkSession, d: str) -> DataFrame:
    """What the anchors of each text cover: characters, extent, and the digest of their slices put together in order."""
    a = outline.anchors(text_outline(spark, d), "doc_id").where("role <> 'object'")
    total = a.groupBy("doc_id").agg(
        F.sum(F.col("char_end") - F.col("char_start")).cast("bigint").alias("covered"), F.min("char_start").cast("bigint").alias("first_start"), F.max("char_end").cast("bigint").alias("last_end"),
        F.sort_array(F.collect_list(F.struct("char_start", "char_end"))).alias("spans"),
    )
    joined = total.join(read_table(spark, d, "documents").where(F.length("text") > 0).select("doc_id", "text"), "doc_id")
    slices = F.array_join(F.transform("spans", lambda x: F.substring(F.col("text"), x["char_start"] + 1, x["char_end"] - x["char_start"])), "")
    return joined.select("doc_id", "covered", "first_start", "last_end", F.sha2(slices, 256).alias("sha256"))


def outline_articles(spark: SparkSession, d: str) -> DataFrame:
    """Articles of the texts whose articles follow from single lines, as SQL can tell: no other formal head, no contents or leaders, no odd line ends."""
    t = F.col("text")
    plain = read_table(spark, d, "documents").where((F.length(t) > 0) & ~t.rlike(f"(?iuUdm){sql.CONTAINER_HEAD}") & ~t.rlike(f"(?iuUd){sql.CONTENTS}") & ~t.rlike(sql.ODD_ENDS)).select("doc_id")
    n = outline.nodes(text_outline(spark, d), "doc_id").where("kind = 'article'")
    return n.join(plain, "doc_id", "left_semi").select("doc_id", "ordinal_key", "path", "depth")


def outline_binding(spark: SparkSession, d: str) -> DataFrame:
    """The outline of each run bound to its canonical document: number of nodes and the document's hash."""
    blocks = physical.all_blocks(read_table(spark, d, "mineru_items"), read_table(spark, d, "marker_trees"))
    n = outline.nodes(outline.outline_records(blocks, "run_id"), "run_id").groupBy("run_id").agg(F.count("*").alias("nodes"))
    return canonical.source_binding(n, canonical.identities(_documents_of(spark, d, blocks)))


def evidence_backing(spark: SparkSession, d: str) -> DataFrame:
    """Outline nodes whose marker or title is not backed by the text; none if all is well."""
    records = checkpointed(text_outline(spark, d))  # read twice
    return checks.evidence_violations(_text_blocks(spark, d), outline.nodes(records, "doc_id"), outline.anchors(records, "doc_id"), "doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        list_blocks, tree_blocks, kind_disposition_matrix, kind_transitions, block_summary, run_throughput, block_checks, page_checks, canonical_identity, canonical_identity_lists, canonical_determinism, tree_block_boxes, embedded_assets, table_grid_cells, table_shapes, grid_overlap_violations,
        kind_disposition_matrix_all, kind_transitions_all, block_summary_all, run_throughput_all, block_checks_all, page_checks_all, table_grid_cells_all, table_shapes_all,
        visible_text_stats, outline_nodes, outline_run_nodes, outline_kinds, outline_diagnostics, outline_partition, hierarchy_edges, evidence_backing, outline_cover, outline_articles, outline_binding,
    )
}

ITEMS = """once as (select * from mineru_items qualify row_number() over (partition by run_id, raw_index order by ingested_at desc, item_id desc) = 1),
blocks as (select *, page_idx as page_index, row_number() over (partition by run_id, page_idx order by raw_index) - 1 as reading_order,
  case when item_type = 'text' and text_level is not null then 'title' when item_type in ('text', 'header', 'page_number') then item_type else 'unknown' end as kind_v0,
  case when item_type = 'text' then 'content' when item_type in ('header', 'page_number') then 'discarded' else 'unknown' end as disposition_v0,
  case when item_type = 'text' and text_level is not null then 'title' when item_type in ('text', 'header', 'page_number', 'table', 'image') then item_type else 'unknown' end as kind,
  case when item_type in ('text', 'table', 'image') then 'content' when item_type in ('header', 'page_number') then 'discarded' else 'unknown' end as disposition,
  coalesce(regexp_replace(item_text, '^[\\s\\x{00a0}\\x{3000}]+|[\\s\\x{00a0}\\x{3000}]+$', '', 'g'), '') as clean, case when len(bbox) = 4 then bbox[1] end as x0, case when len(bbox) = 4 then bbox[2] end as y0, case when len(bbox) = 4 then bbox[3] end as x1, case when len(bbox) = 4 then bbox[4] end as y1,
  case when item_type = 'text' and text_level >= 1 then text_level end as heading_level from once)"""
_BLOCKS = "with " + ITEMS + " "
ORACLE_SQL = {
    "tree_block_boxes": sql.TREE_BLOCKS + "select run_id, page_index, reading_order, raw_index, block_id, raw_type, kind_v0, kind, disposition, x0, y0, x1, y1 from tree_block",
    "visible_text_stats": sql.VISIBLE, "canonical_identity_lists": _BLOCKS + sql.CANONICAL, "table_grid_cells": sql.GRID, "embedded_assets": sql.ASSETS, "outline_cover": sql.COVER, "outline_articles": sql.ARTICLES,
    "list_blocks": _BLOCKS + """select run_id, raw_index, page_index, reading_order, document_id || '_' || coalesce(version_id, '') || '_p' || printf('%04d', page_index) || '_b' || printf('%04d', reading_order) as block_id,
      kind_v0, disposition_v0, kind, disposition, md5(clean) as text_md5, x0, y1, heading_level from blocks""",
    "kind_disposition_matrix": _BLOCKS + "select item_type as raw_type, kind, disposition, count(*) as n from blocks group by all",
    "kind_transitions": _BLOCKS + "select kind_v0, kind, count(*) as n from blocks group by all",
    "block_summary": _BLOCKS + """select run_id, count(*) as blocks, count(*) filter (where disposition = 'content') as content, count(*) filter (where kind = 'title') as titles, count(*) filter (where kind = 'table') as tables,
      count(*) filter (where kind in ('image', 'figure')) as images, cast(sum(length(clean)) as bigint) as characters, cast(max(page_index) + 1 as bigint) as pages from blocks group by run_id""",
    "run_throughput": _BLOCKS + """, p as (select run_id, cast(max(page_index) + 1 as bigint) as pages from blocks group by run_id)
      select p.run_id as run_id, pages, duration_seconds, pages / duration_seconds as pages_per_second from p join parser_runs r on p.run_id = r.run_id where duration_seconds > 0""",
    "block_checks": _BLOCKS + """, v as (select run_id, document_id || '_' || coalesce(version_id, '') || '_p' || printf('%04d', page_index) || '_b' || printf('%04d', reading_order) as block_id, unnest([
        case when heading_level is not null and kind <> 'title' then 'heading_level_on_non_title' end, case when x0 is not null and not coalesce(x0 >= 0 and y0 >= 0 and x1 <= 1000 and y1 <= 1000 and x0 <= x1 and y0 <= y1, false) then 'box_invalid' end,
        case when x0 is null then 'box_missing' end, case when table_body is not null and kind <> 'table' then 'table_on_non_table' end, case when img_path is not null and kind not in ('image', 'figure') then 'image_on_non_image' end]) as rule_id from blocks)
      select run_id, block_id, rule_id from v where rule_id is not null""",
    "table_shapes": """with t as (select item_id, (length(table_body) - length(replace(table_body, '<tr', ''))) // 3 as row_count, (length(table_body) - length(replace(replace(table_body, '<td', ''), '<th', ''))) // 3 as cells
      from mineru_items where table_body like '%<table%') select item_id, cast(row_count as bigint) as row_count, cast(cells // row_count as bigint) as column_count, cast(cells as bigint) as cells from t""",
    "page_checks": _BLOCKS + """, r as (select run_id, min(page_index) as low, max(page_index) as high, count(distinct page_index) as pages from blocks group by run_id)
      select run_id, cast(null as integer) as page_index, 'pages_not_contiguous' as rule_id from r where low <> 0 or high <> pages - 1""",
}
