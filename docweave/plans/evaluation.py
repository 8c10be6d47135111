"""Queries that score parser output and outlines against the reference annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.functions import columns as c
from docweave.operators import checks, outline, physical, spatial, structural
from docweave.plans.extraction import ITEMS
from docweave.plans.extraction_sql import TREE_BLOCKS, block_id
from docweave.sources.tables import checkpointed, read_table

PAGE = ["document_id", "version_id", "page_index", "run_id"]
DOCUMENT = ["document_id", "version_id", "run_id"]
RUN_PAGE, RUN = [*PAGE, "parser"], [*DOCUMENT, "parser"]


def _regions(spark: SparkSession, d: str) -> DataFrame:
    """Reference regions as delivered last, with their box."""
    r = read_table(spark, d, "ref_regions").select("document_id", "version_id", "page_index", "region_id", "created_at", "region_row_id", "reading_order", "kind", "bbox", "heading_level")
    once = physical.latest(r, ["document_id", "version_id", "page_index", "region_id"], "created_at", "region_row_id")
    return once.select("document_id", "version_id", "page_index", F.col("region_id").alias("id"), F.col("reading_order").alias("order"), "kind", *(F.col(f"bbox.{x}").alias(x) for x in spatial.BOX))


def _sides(spark: SparkSession, d: str, lists_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """References repeated for each run of their version, and the run's blocks on the audited pages; runs of both parsers."""
    items = read_table(spark, d, "mineru_items")
    blocks = physical.list_blocks(items).withColumn("parser", F.lit("mineru")) if lists_only else physical.all_blocks(items, read_table(spark, d, "marker_trees"))
    regions = _regions(spark, d)
    pages = regions.select("document_id", "version_id", "page_index").distinct()
    predictions = blocks.join(pages, ["document_id", "version_id", "page_index"], "left_semi").select(*RUN_PAGE, F.col("block_id").alias("id"), F.col("reading_order").alias("order"), "kind", *spatial.BOX)
    runs = blocks.select(*RUN).distinct()
    return regions.join(runs, ["document_id", "version_id"]), predictions


def iou_edges(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of regions and blocks that overlap by half, for the flat lists only, as its SQL has them; iou_edges_all has both parsers."""
    return spatial.candidate_edges(*_sides(spark, d, lists_only=True), RUN_PAGE).drop("parser")


def iou_edges_all(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of regions and blocks that overlap by half, for the runs of both parsers."""
    return spatial.candidate_edges(*_sides(spark, d), RUN_PAGE)


def _matched(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    references, predictions = (checkpointed(x) for x in _sides(spark, d))  # read by the matching and by what follows it
    return references, predictions, spatial.matches(spatial.candidate_edges(references, predictions, RUN_PAGE), RUN_PAGE)


def spatial_matches(spark: SparkSession, d: str) -> DataFrame:
    """The assignment of blocks to regions, page by page."""
    return _matched(spark, d)[2]


def spatial_overall(spark: SparkSession, d: str) -> DataFrame:
    """Precision, recall, F1, mean IoU and classification accuracy of each run."""
    references, predictions, matched = _matched(spark, d)
    return spatial.overall(references, predictions, _paired(references, predictions, matched).withColumn("same", F.col("ref_category") == F.col("pred_category")), RUN)


def spatial_order(spark: SparkSession, d: str) -> DataFrame:
    """Reading-order accuracy of each run over all audited pages."""
    references, predictions, matched = _matched(spark, d)
    pairs = matched.join(references.select(*RUN_PAGE, F.col("id").alias("ref_id"), F.col("order").alias("r")), [*RUN_PAGE, "ref_id"]).join(predictions.select(*RUN_PAGE, F.col("id").alias("pred_id"), F.col("order").alias("pred_order")), [*RUN_PAGE, "pred_id"])
    rank = F.row_number().over(Window.partitionBy(*RUN).orderBy("r", "page_index", "ref_id"))
    return spatial.order_accuracy(pairs.withColumn("ref_rank", rank), RUN)


def _paired(references: DataFrame, predictions: DataFrame, matched: DataFrame) -> DataFrame:
    r = references.select(*RUN_PAGE, F.col("id").alias("ref_id"), F.col("kind").alias("ref_category"))
    p = predictions.select(*RUN_PAGE, F.col("id").alias("pred_id"), c.category(F.col("kind")).alias("pred_category"))
    return matched.join(r, [*RUN_PAGE, "ref_id"]).join(p, [*RUN_PAGE, "pred_id"])


def _categories(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    references, predictions, matched = _matched(spark, d)
    pairs = _paired(references, predictions, matched)
    return pairs, spatial.unmatched(references, matched, RUN_PAGE, "ref_id").withColumn("category", F.col("kind")), spatial.unmatched(predictions, matched, RUN_PAGE, "pred_id").withColumn("category", c.category(F.col("kind")))


def evaluation_problems(spark: SparkSession, d: str) -> DataFrame:
    """Runs that cannot be scored as they stand: their version has no annotation, another source digest, or fewer pages than are audited."""
    runs = read_table(spark, d, "parser_runs").select("run_id", "document_id", "version_id", F.lower(F.trim("input_sha256")).alias("sha"))
    sources = read_table(spark, d, "manifests").groupBy("document_id", "version_id").agg(F.max(F.lower(F.trim("sha256"))).alias("source"))
    audited = read_table(spark, d, "ref_regions").groupBy("document_id", "version_id").agg(F.max("page_index").alias("last"))
    pages = physical.page_counts(physical.all_blocks(read_table(spark, d, "mineru_items"), read_table(spark, d, "marker_trees")))
    both = runs.join(sources, ["document_id", "version_id"], "left").join(audited, ["document_id", "version_id"], "left").join(pages, "run_id", "left")
    rules = {"annotation_missing": F.col("last").isNull(), "source_sha256_differs": F.col("sha") != F.col("source"), "page_out_of_range": F.col("last") >= F.coalesce("page_count", F.lit(0))}
    return checks.violations(both, ["run_id"], rules)


def confusion_long(spark: SparkSession, d: str) -> DataFrame:
    """Confusion matrix of categories in long form, for each parser."""
    return spatial.confusion(*_categories(spark, d), ["parser"])


def category_prf(spark: SparkSession, d: str) -> DataFrame:
    """Precision, recall and F1 by parser and category."""
    return spatial.per_category(*_categories(spark, d), ["parser"])


def region_checks(spark: SparkSession, d: str) -> DataFrame:
    """Spatial annotations that break the contract."""
    return checks.region_violations(read_table(spark, d, "ref_regions"))


def reference_checks(spark: SparkSession, d: str) -> DataFrame:
    """Structural annotations that break the contract."""
    return checks.reference_node_violations(read_table(spark, d, "ref_nodes"))


def cycle_check(spark: SparkSession, d: str) -> DataFrame:
    """Reference instances that are their own ancestor."""
    n = read_table(spark, d, "ref_nodes").select("document_id", "version_id", "annotation_version", "reference_instance_id", "parent_reference_instance_id")
    return checks.cycles(n, ["document_id", "version_id", "annotation_version"], "reference_instance_id", "parent_reference_instance_id")


def _run_names(spark: SparkSession, d: str) -> DataFrame:
    """(run_id, document_id, version_id, parser) of the runs in the raw tables, from narrow columns."""
    of = lambda table, parser: read_table(spark, d, table).select(*DOCUMENT).distinct().withColumn("parser", F.lit(parser))
    return of("mineru_items", "mineru").union(of("marker_trees", "marker"))


def _outline_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(references of each run's version, predicted nodes) for structural matching; outlines are made once and written."""
    blocks = physical.all_blocks(read_table(spark, d, "mineru_items"), read_table(spark, d, "marker_trees"))
    every = checkpointed(outline.nodes(outline.outline_records(blocks, "run_id"), "run_id").join(_run_names(spark, d), "run_id"))
    runs = every.where("kind = 'document'").select(*(F.concat(F.col(n)).alias(n) if n != "run_id" else (F.col(n) + 0).alias(n) for n in RUN))  # columns of their own, since both sides meet again
    predictions = every.where("kind <> 'document'").select(*RUN, "page_index", "kind", "ordinal_key", F.col("node_id").alias("id"), "path", "parent_path", "title", "block_kind", "excerpt")
    r = read_table(spark, d, "ref_nodes").select("document_id", "version_id", "page_index", "kind", "canonical_path", "created_at", "node_row_id", "ordinal_key", "parent_canonical_path", "title", "scored")
    once = physical.latest(r, ["document_id", "version_id", "page_index", "kind", "canonical_path"], "created_at", "node_row_id")
    references = once.select("document_id", "version_id", "page_index", "kind", "ordinal_key", F.format_string("%012d", "node_row_id").alias("id"), F.col("canonical_path").alias("path"), F.col("parent_canonical_path").alias("parent_path"), "title", "scored")
    return references.join(runs, ["document_id", "version_id"]), predictions


def _scored_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Both sides within scope, written once: matching reads them in each of its stages, and outlines are costly."""
    r, p = _outline_sides(spark, d)
    r, p = structural.in_scope(r, p, DOCUMENT)
    return checkpointed(r), checkpointed(p)


def structural_prf(spark: SparkSession, d: str) -> DataFrame:
    """Node metrics by parser and kind, summed over documents."""
    r, p = _scored_sides(spark, d)
    m = structural.match(r, p, DOCUMENT)
    parser = r.select("run_id", "parser").union(p.select("run_id", "parser")).distinct()
    return structural.node_metrics(r, p, m.join(parser, "run_id"), ["parser", "kind"])


def structural_edges(spark: SparkSession, d: str) -> DataFrame:
    """How often paths, parents and titles of matched nodes agree, by kind."""
    r, p = _scored_sides(spark, d)
    pairs = structural.compare(r, p, structural.match(r, p, DOCUMENT), DOCUMENT)
    return pairs.groupBy("kind").agg(F.count("*").alias("matched"), F.count_if("path_exact").alias("path_exact"), F.count_if("parent_exact").alias("parent_exact"), F.count("title_exact").alias("titles"), F.count_if("title_exact").alias("title_exact"))


def structural_edge_prf(spark: SparkSession, d: str) -> DataFrame:
    """Parent-edge metrics by parser and kind, edges of missed and invented nodes included."""
    r, p = _scored_sides(spark, d)
    parser = r.select("run_id", "parser").union(p.select("run_id", "parser")).distinct()
    return structural.edge_metrics(r, p, structural.compare(r, p, structural.match(r, p, DOCUMENT), DOCUMENT).join(parser, "run_id"), ["parser", "kind"])


def structural_traces(spark: SparkSession, d: str) -> DataFrame:
    """Missed and invented nodes on audited pages."""
    r, p = _scored_sides(spark, d)
    return structural.traces(r, p, structural.match(r, p, DOCUMENT), DOCUMENT)


def jaccard_cross(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of the two parsers' outlines for each version, over legal, generic and all nodes."""
    _, p = _outline_sides(spark, d)
    side = lambda name: p.where(F.col("parser") == name)
    return structural.agreement(side("marker"), side("mineru"), ["document_id", "version_id"])


def jaccard_items(spark: SparkSession, d: str) -> DataFrame:
    """The nodes behind that agreement: shared by both parsers' outlines of a version, or only in one."""
    _, p = _outline_sides(spark, d)
    side = lambda name: p.where(F.col("parser") == name)
    return structural.shared_items(side("marker"), side("mineru"), ["document_id", "version_id"], ["kind", "path"])


def structural_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Groups of nodes that matching could not tell apart."""
    r, p = _scored_sides(spark, d)
    return structural.match_diagnostics(r, p, structural.match(r, p, DOCUMENT), DOCUMENT)


def annotation_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of the third and fourth annotation version of a document on (kind, path), over legal, generic and all nodes."""
    n = read_table(spark, d, "ref_nodes").select("document_id", "version_id", "kind", F.col("canonical_path").alias("path"), "annotation_version")
    side = lambda v: n.where(F.col("annotation_version") == v)
    return structural.agreement(side("v3"), side("v4"), ["document_id", "version_id"])


def reference_scope(spark: SparkSession, d: str) -> DataFrame:
    """What of each version's annotation is scored: distinct records, instances, scored instances, and paths that are context only."""
    n = read_table(spark, d, "ref_nodes").withColumn("s", F.coalesce("scored", F.lit(True)))
    paths = n.groupBy("document_id", "version_id", "canonical_path").agg(F.bool_or("s").alias("s")).groupBy("document_id", "version_id").agg(F.count_if(~F.col("s")).alias("context_paths"))
    counts = n.groupBy("document_id", "version_id").agg(
        F.count("*").alias("rows"), F.count_distinct("reference_record_id").alias("records"), F.count_distinct("reference_instance_id").alias("instances"), F.count_distinct(F.when(F.col("s"), F.col("reference_instance_id"))).alias("scored_instances"), F.count_distinct("page_index").alias("pages")
    )
    return counts.join(paths, ["document_id", "version_id"])


def unresolved_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Marker-shaped lines of document texts in which no node begins."""
    from docweave.operators import lines
    from docweave.plans.extraction import text_outline

    t = read_table(spark, d, "documents").where(F.length("text") > 0).select("doc_id", F.format_string("d%d", "doc_id").alias("block_id"), "text")
    events = lines.line_events(t, ["doc_id", "block_id"], "text")
    markers = outline.anchors(text_outline(spark, d), "doc_id").where("role = 'marker'")
    return structural.unresolved(events, markers, ["doc_id"])


QUERIES = {f.__name__: f for f in (iou_edges, iou_edges_all, spatial_matches, spatial_overall, spatial_order, confusion_long, category_prf, region_checks, reference_checks, cycle_check, structural_prf, structural_edges, structural_edge_prf, structural_traces, jaccard_cross, unresolved_candidates, evaluation_problems, jaccard_items, structural_diagnostics, annotation_agreement, reference_scope)}

# The assignment in SQL: pairs that are alone on both sides.  Pages on which regions compete are tested against brute force.
_SIDES = TREE_BLOCKS + ", " + ITEMS + f""",
every as (select document_id, version_id, run_id, 'mineru' as parser, page_index, {block_id()} as block_id, reading_order, kind, x0, y0, x1, y1 from blocks
  union all select document_id, version_id, run_id, 'marker', page_index, block_id, reading_order, kind, x0, y0, x1, y1 from tree_block),
refs0 as (select * from ref_regions qualify row_number() over (partition by document_id, version_id, page_index, region_id order by created_at desc, region_row_id desc) = 1),
runs as (select distinct document_id, version_id, run_id, parser from every),
refs as (select r.*, run_id, parser from refs0 r join runs u on r.document_id = u.document_id and r.version_id = u.version_id),
preds as (select *, case when kind = 'title' then 'heading' when kind in ('text', 'header', 'page_number', 'table', 'figure') then kind else 'unknown' end as category from every e where exists (select 1 from refs0 r where r.document_id = e.document_id and r.version_id = e.version_id and r.page_index = e.page_index)),
pairs as (select r.document_id, r.version_id, r.page_index, r.run_id, r.parser, r.region_id as ref_id, r.reading_order as ref_order, r.kind as ref_category, b.block_id as pred_id, b.reading_order as pred_order, b.category as pred_category,
  greatest(0.0, least(r.bbox.x1, b.x1) - greatest(r.bbox.x0, b.x0)) * greatest(0.0, least(r.bbox.y1, b.y1) - greatest(r.bbox.y0, b.y0)) as o, (r.bbox.x1 - r.bbox.x0) * (r.bbox.y1 - r.bbox.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) as s
  from refs r join preds b on r.page_index = b.page_index and r.run_id = b.run_id and r.parser = b.parser where b.x0 is not null and b.y0 is not null and b.x1 is not null and b.y1 is not null),
edges as (select *, o / (s - o) as iou from pairs where s - o > 0 and o / (s - o) >= 0.5),
matched as (select * from edges qualify count(*) over (partition by parser, run_id, page_index, ref_id) = 1 and count(*) over (partition by parser, run_id, page_index, pred_id) = 1)
"""
_UNMATCHED = """, free_refs as (select r.parser, r.kind as category from refs r where not exists (select 1 from matched m where m.parser = r.parser and m.run_id = r.run_id and m.page_index = r.page_index and m.ref_id = r.region_id)),
free_preds as (select p.parser, p.category from preds p where not exists (select 1 from matched m where m.parser = p.parser and m.run_id = p.run_id and m.page_index = p.page_index and m.pred_id = p.block_id))
"""
_EDGE = "document_id, version_id, page_index, run_id, ref_id, cast(ref_order as integer) as ref_order, pred_id, cast(pred_order as integer) as pred_order, iou"
_PRF = "case when tp + fp = 0 then 0.0 else tp / (tp + fp) end as precision, case when tp + fn = 0 then 0.0 else tp / (tp + fn) end as recall"
_F1 = "case when precision + recall = 0 then 0.0 else 2 * precision * recall / (precision + recall) end as f1"
ORACLE_SQL = {
    "iou_edges": _SIDES + f"select {_EDGE} from edges where parser = 'mineru'",
    "iou_edges_all": _SIDES + f"select {_EDGE}, parser from edges",
    "spatial_matches": _SIDES + "select document_id, version_id, page_index, run_id, parser, ref_id, pred_id, iou from matched",
    "spatial_overall": _SIDES + f""", r as (select document_id, version_id, run_id, parser, count(*) as n from refs group by all), p as (select document_id, version_id, run_id, parser, count(*) as n from preds group by all),
      m as (select document_id, version_id, run_id, parser, count(*) as tp, round(avg(iou), 6) as mean_iou, count(*) filter (where ref_category = pred_category) as same from matched group by all),
      b as (select document_id, version_id, run_id, parser, coalesce(r.n, 0) as "references", coalesce(p.n, 0) as predictions from r full join p using (document_id, version_id, run_id, parser)),
      c as (select b.*, coalesce(tp, 0) as tp, predictions - coalesce(tp, 0) as fp, "references" - coalesce(tp, 0) as fn, coalesce(mean_iou, 0.0) as mean_iou, coalesce(same, 0) as same from b left join m using (document_id, version_id, run_id, parser)),
      d as (select *, {_PRF} from c) select * exclude (same), {_F1}, case when tp = 0 then 0.0 else same / tp end as accuracy from d""",
    "spatial_order": _SIDES + """, k as (select *, row_number() over (partition by parser, run_id order by ref_order, page_index, ref_id) as place from matched),
      q as (select a.document_id, a.version_id, a.run_id, a.parser, count(*) as comparable, count(*) filter (where a.pred_order < b.pred_order) as concordant from k a join k b on a.parser = b.parser and a.run_id = b.run_id and a.place < b.place group by all)
      select *, concordant / comparable as order_accuracy from q""",
    "confusion_long": _SIDES + _UNMATCHED + """, seen as (select parser, ref_category as k from matched union select parser, pred_category from matched union select parser, category from free_refs where category is not null union select parser, category from free_preds)
      select a.parser as parser, a.k as ref_category, b.k as pred_category, count(m.ref_id) as pairs from seen a join seen b on a.parser = b.parser left join matched m on m.parser = a.parser and m.ref_category = a.k and m.pred_category = b.k group by all""",
    "category_prf": _SIDES + _UNMATCHED + f""", e as (select parser, ref_category as category, case when ref_category = pred_category then 1 else 0 end as tp, 0 as fp, case when ref_category = pred_category then 0 else 1 end as fn from matched
      union all select parser, pred_category, 0, case when ref_category = pred_category then 0 else 1 end, 0 from matched union all select parser, category, 0, 0, 1 from free_refs union all select parser, category, 0, 1, 0 from free_preds),
      c as (select parser, category, cast(sum(tp) as bigint) as tp, cast(sum(fp) as bigint) as fp, cast(sum(fn) as bigint) as fn from e group by all), d as (select *, {_PRF} from c) select *, {_F1} from d""",
    "evaluation_problems": TREE_BLOCKS + ", " + ITEMS + """, pc as (select run_id, max(page_index) + 1 as pages from (select run_id, page_index from blocks union all select run_id, page_index from tree_block) group by run_id),
      s as (select document_id, version_id, max(lower(trim(sha256))) as source from manifests group by all), a as (select document_id, version_id, max(page_index) as last from ref_regions group by all),
      v as (select r.run_id, unnest([case when last is null then 'annotation_missing' end, case when lower(trim(r.input_sha256)) <> source then 'source_sha256_differs' end, case when last >= coalesce(pages, 0) then 'page_out_of_range' end]) as rule_id
        from parser_runs r left join s using (document_id, version_id) left join a using (document_id, version_id) left join pc on pc.run_id = r.run_id) select run_id, rule_id from v where rule_id is not null""",
    "annotation_agreement": """with n as (select distinct document_id, version_id, unnest(['all', case when kind = 'generic_section' then 'generic' else 'legal' end]) as scope, kind, canonical_path as path, annotation_version as v from ref_nodes where kind <> 'document'),
      a as (select document_id, version_id, scope, kind, path, bool_or(v = 'v3') as x, bool_or(v = 'v4') as y from n where v in ('v3', 'v4') group by all),
      c as (select document_id, version_id, scope, count(*) filter (where x and y) as shared, count(*) filter (where x and not y) as only_left, count(*) filter (where y and not x) as only_right from a group by all) select *, shared / (shared + only_left + only_right) as jaccard from c""",
    "reference_scope": """with p as (select document_id, version_id, canonical_path, bool_or(coalesce(scored, true)) as s from ref_nodes group by all), q as (select document_id, version_id, count(*) filter (where not s) as context_paths from p group by all)
      select n.document_id as document_id, n.version_id as version_id, count(*) as rows, count(distinct reference_record_id) as records, count(distinct reference_instance_id) as instances, count(distinct case when coalesce(scored, true) then reference_instance_id end) as scored_instances,
        count(distinct page_index) as pages, any_value(context_paths) as context_paths from ref_nodes n join q on n.document_id = q.document_id and n.version_id = q.version_id group by 1, 2""",
    "region_checks": """with v as (select document_id, version_id, page_index, region_id, unnest([
        case when not coalesce(bbox.x0 >= 0 and bbox.y0 >= 0 and bbox.x1 <= 1000 and bbox.y1 <= 1000 and bbox.x0 < bbox.x1 and bbox.y0 < bbox.y1, false) then 'box_invalid' end,
        case when heading_level is not null and kind <> 'heading' then 'level_on_non_heading' end]) as rule_id from ref_regions),
      p as (select document_id, version_id, page_index, min(reading_order) as low, max(reading_order) as high, count(distinct reading_order) as d from ref_regions group by document_id, version_id, page_index, annotation_version, created_at)
      select document_id, version_id, page_index, region_id, rule_id from v where rule_id is not null
      union all select document_id, version_id, page_index, null, 'order_not_contiguous' from p where low <> 0 or high + 1 <> d""",
    "cycle_check": """with recursive e as (select distinct document_id, version_id, annotation_version, reference_instance_id as c, parent_reference_instance_id as p from ref_nodes where parent_reference_instance_id is not null),
      w as (select document_id, version_id, annotation_version, c, p, 1 as n from e union select w.document_id, w.version_id, w.annotation_version, w.c, e.p, n + 1 from w join e on w.document_id = e.document_id and w.version_id = e.version_id
        and w.annotation_version is not distinct from e.annotation_version and w.p = e.c where w.c <> w.p and n < 12)
      select distinct document_id, version_id, annotation_version, c as reference_instance_id from w where c = p""",
}
