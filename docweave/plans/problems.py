"""Queries of the general training-data problems: schema drift and nested records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators import nested, schema_drift
from docweave.sources.tables import read_table, spread


def _files(spark: SparkSession, d: str) -> DataFrame:
    return spread(read_table(spark, d, "annotation_files").select("file_id", "raw_json"))


def _trees(spark: SparkSession, d: str) -> DataFrame:
    return spread(read_table(spark, d, "marker_trees").select("tree_id", "raw_json"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Each file's changes against schema 4."""
    return schema_drift.changes(_files(spark, d), "file_id", "raw_json")


def p4_nodes(spark: SparkSession, d: str) -> DataFrame:
    """All nodes of all files in one consistent table."""
    return schema_drift.consistent_nodes(_files(spark, d), "file_id", "raw_json")


def p4_versions(spark: SparkSession, d: str) -> DataFrame:
    """The true schema version of each file, found from its fields."""
    return schema_drift.file_versions(_files(spark, d), "file_id", "raw_json")


def p4_steps(spark: SparkSession, d: str) -> DataFrame:
    """Every change that a step of the migration chain made to a file."""
    return schema_drift.steps(_files(spark, d), "file_id", "raw_json")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Every block below a page with its place, parent, id and section."""
    return nested.links(_trees(spark, d), "tree_id", "raw_json").select("tree_id", "node_path", "parent_path", "node_id", "section_id")


def p5_nodes(spark: SparkSession, d: str) -> DataFrame:
    """All nodes with interval labels and every field; the tables below are keyed by its (tree_id, pre)."""
    return nested.nodes(_trees(spark, d), "tree_id", "raw_json")


def p5_trees(spark: SparkSession, d: str) -> DataFrame:
    """The fields of each readable tree itself."""
    return nested.tree_fields(_trees(spark, d), "tree_id", "raw_json")


def p5_polygons(spark: SparkSession, d: str) -> DataFrame:
    """Polygon points of all nodes."""
    return nested.polygon_points(p5_nodes(spark, d))


def p5_images(spark: SparkSession, d: str) -> DataFrame:
    """Image entries of all nodes."""
    return nested.images(p5_nodes(spark, d))


def p5_sections(spark: SparkSession, d: str) -> DataFrame:
    """Section references of all nodes and levels."""
    return nested.sections(p5_nodes(spark, d))


def p5_containers(spark: SparkSession, d: str) -> DataFrame:
    """Links between the tables by type: each block's nearest enclosing node of each type, by interval containment."""
    return nested.containers(_trees(spark, d), "tree_id", "raw_json")


def p5_sections_by_level(spark: SparkSession, d: str) -> DataFrame:
    """Section references by level."""
    return p5_sections(spark, d).groupBy("level").agg(F.count("*").alias("links"), F.count_distinct("tree_id").alias("trees"))


def p5_depths(spark: SparkSession, d: str) -> DataFrame:
    """Nodes by type and depth, and how many have a polygon."""
    return p5_nodes(spark, d).groupBy("block_type", F.col("depth").alias("depth")).agg(F.count("*").alias("nodes"), F.count("polygon").alias("polygons"))


def p5_points(spark: SparkSession, d: str) -> DataFrame:
    """Number of points and first point of each polygon."""
    nodes = p5_nodes(spark, d)
    first = nested.polygon_points(nodes).groupBy("tree_id", "pre").agg(F.count("*").alias("points"), F.max(F.when(F.col("point") == 0, F.col("x"))).alias("x"), F.max(F.when(F.col("point") == 0, F.col("y"))).alias("y"))
    return first.join(nodes.select("tree_id", "pre", "node_path"), ["tree_id", "pre"]).drop("pre")


# Block types with a table of their own; p5_other_blocks has the rest.
BLOCK_TABLES = {
    "p5_pages": "Page", "p5_texts": "Text", "p5_section_headers": "SectionHeader", "p5_list_groups": "ListGroup", "p5_list_items": "ListItem", "p5_table_groups": "TableGroup", "p5_tables": "Table",
    "p5_figure_groups": "FigureGroup", "p5_pictures": "Picture", "p5_captions": "Caption", "p5_page_headers": "PageHeader", "p5_page_footers": "PageFooter",
}


def _of_type(block_type: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: nested.of_type(p5_nodes(spark, d), block_type)


def p5_other_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Nodes whose type has no table of its own."""
    return p5_nodes(spark, d).where(~F.col("block_type").isin(list(BLOCK_TABLES.values())))


QUERIES = {f.__name__: f for f in (p4_found, p4_nodes, p4_versions, p4_steps, p5_found, p5_nodes, p5_trees, p5_polygons, p5_images, p5_sections, p5_containers, p5_other_blocks, p5_sections_by_level, p5_depths, p5_points)}
QUERIES |= {name: _of_type(block_type) for name, block_type in BLOCK_TABLES.items()}


# ---------------------------------------------------------------- SQL
def _kids(node: str) -> str:
    """SQL for the children of a JSON node as a list: an array, an object of children or a single one, or either as text."""
    plain = "case json_type({c}) when 'ARRAY' then json_extract({c}, '$[*]') when 'OBJECT' then case when json_exists({c}, '$.block_type') then [{c}] else json_extract({c}, '$.*') end else [] end"
    child = f"json_extract({node}, '$.children')"
    text = f"json_extract_string({node}, '$.children')"
    return f"case when json_type({child}) = 'VARCHAR' then case when json_valid({text}) then {plain.format(c=f'cast({text} as json)')} else [] end else {plain.format(c=child)} end"


def _text(node: str, path: str) -> str:
    return f"coalesce(json_extract_string({node}, '{path}'), '')"


TREE = f"""with recursive roots as (select tree_id, cast(raw_json as json) as j from marker_trees where json_valid(raw_json) and json_type(raw_json) = 'OBJECT'),
first as (select tree_id, {_kids("j")} as kids from roots),
n(tree_id, depth, page, node_path, parent_path, j) as (
  select tree_id, 0, k, cast(k as varchar), '', j from (select tree_id, unnest(kids) as j, generate_subscripts(kids, 1) - 1 as k from first) where json_type(j) = 'OBJECT'
  union all
  select tree_id, depth + 1, page, node_path || '/' || k, node_path, j from (
    select tree_id, depth, page, node_path, unnest(kids) as j, generate_subscripts(kids, 1) - 1 as k from (select tree_id, depth, page, node_path, {_kids("j")} as kids from n)) where json_type(j) = 'OBJECT')
"""
_SECTION = """case when json_type(j, '$.section_hierarchy') = 'OBJECT' then coalesce(json_extract_string(j, '$.section_hierarchy."3"'), '') else '' end"""
_RENAMES = {old: new for step in schema_drift.MIGRATIONS for old, new in step.renames.items()}
_NAMES = ", ".join(f"('{old}', '{new}')" for old, new in sorted(_RENAMES.items()))
_FIELDS = ", ".join(f"('{name}', '{kind}')" for name, kind in sorted(schema_drift.SCHEMA_4.items()))
NODES = f"""with names(old, new) as (values {_NAMES}), wanted(field, kind) as (values {_FIELDS}),
files as (select file_id, cast(raw_json as json) as j from annotation_files where json_valid(raw_json)),
pages as (select file_id, unnest(json_extract(j, '$.audited_pages[*]')) as p from files),
nodes as (select file_id, unnest(json_extract(p, '$.nodes[*]')) as n from pages),
named as (select file_id, n, unnest(json_keys(n)) as name from nodes where json_type(n) = 'OBJECT'),
typed as (select distinct file_id, name, case json_type(json_extract(n, '$."' || name || '"')) when 'BIGINT' then 'integer' when 'UBIGINT' then 'integer' when 'HUGEINT' then 'integer' when 'DOUBLE' then 'number' when 'BOOLEAN' then 'boolean'
  when 'VARCHAR' then 'string' when 'ARRAY' then 'array' when 'OBJECT' then 'object' else 'null' end as kind from named),
spelt as (select *, lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[- ]', '_', 'g')) as snake from typed),
stands as (select t.file_id, t.name, t.kind, coalesce(a.new, b.new) as new from spelt t left join names a on t.name = a.old left join names b on t.snake = b.old),
f as (select file_id, name, kind, case when new = name or not exists (select 1 from stands o where o.file_id = s.file_id and o.name = s.new) then new end as field from stands s)
"""
ORACLE_SQL: dict[str, str] = {
    "p4_found": NODES + """select distinct file_id, name as field_name, 'added' as change_kind from f where field is null
      union all select distinct file_id, field, 'renamed' from f where field <> name
      union all select distinct f.file_id, f.field, 'retyped' from f join wanted w on f.field = w.field where f.kind <> 'null' and f.kind <> w.kind
      union all select file_id, field, 'removed' from (select distinct file_id, field from (select distinct file_id from f) cross join (select field from wanted) except select file_id, field from f)""",
    "p5_found": TREE + f"""select tree_id, node_path, parent_path, {_text("j", "$.id")} as node_id, {_SECTION} as section_id from n where depth > 0""",
    "p5_sections_by_level": TREE + """select level, count(*) as links, count(distinct tree_id) as trees from (select tree_id, unnest(json_keys(j, '$.section_hierarchy')) as level from n where json_type(j, '$.section_hierarchy') = 'OBJECT') group by level""",
    "p5_depths": TREE + f"""select {_text("j", "$.block_type")} as block_type, depth, count(*) as nodes, count(*) filter (where json_type(j, '$.polygon') = 'ARRAY') as polygons from n group by all""",
    "p5_points": TREE + """select tree_id, node_path, cast(json_array_length(j, '$.polygon') as bigint) as points, cast(json_extract(j, '$.polygon[0][0]') as double) as x, cast(json_extract(j, '$.polygon[0][1]') as double) as y from n where json_type(j, '$.polygon') = 'ARRAY' and json_array_length(j, '$.polygon') > 0""",
}
