"""Readers for raw evidence: JSON and YAML files, parser runs, sidecars, artifact inventories."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class SourceError(ValueError):
    """A source that breaks its contract."""


def json_files(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """(path, directory, raw, tree): whole JSON files as VARIANT; tree is null where the text is no JSON."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))
    return raw.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("directory"), "raw", F.try_parse_json("raw").alias("tree"))


def unique_by_directory(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(directories with exactly one file, problems): discovery by suffix must be unique."""
    counted = files.groupBy("directory").agg(F.count("*").alias("n"), F.min("path").alias("path"))
    return counted.where("n = 1").select("directory", "path"), counted.where("n <> 1").select("directory", "n")


def is_document_tree(tree: Column) -> Column:
    """Whether a JSON value has the shape of a nested document tree: an object of type Document with a list of children."""
    kids = F.schema_of_variant(F.try_variant_get(tree, "$.children", "variant"))
    return F.coalesce((F.try_variant_get(tree, "$.block_type", "string") == "Document") & kids.startswith("ARRAY"), F.lit(False))


def document_trees(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Discovery by content: the one tree of each directory, sidecars set aside; and directories with several."""
    trees = files.where(~F.col("path").endswith("_meta.json") & is_document_tree(F.col("tree")))
    return unique_by_directory(trees)


def content_list(files: DataFrame) -> DataFrame:
    """(directory, raw_index, item, is_object): each element of flat lists in order; elements that are no objects are marked."""
    items = files.select("directory", F.try_variant_get("tree", "$", "array<variant>").alias("items")).where("items is not null")
    return items.select("directory", F.posexplode("items").alias("raw_index", "item")).withColumn("is_object", F.schema_of_variant("item").startswith("OBJECT"))


def page_geometry(files: DataFrame) -> DataFrame:
    """(directory, page_count, ok): page-size sidecars; indexes must be 0 .. n-1, each with two positive sizes."""
    pages = files.select("directory", F.explode(F.try_variant_get("tree", "$.pdf_info", "array<struct<page_idx:int,page_size:array<double>>>")).alias("p"))
    sizes = (F.size("p.page_size") == 2) & (F.col("p.page_size")[0] > 0) & (F.col("p.page_size")[1] > 0)
    d = pages.groupBy("directory").agg(F.count("*").alias("page_count"), F.count_distinct("p.page_idx").alias("d"), F.min("p.page_idx").alias("low"), F.max("p.page_idx").alias("high"), F.bool_and(F.coalesce(sizes, F.lit(False))).alias("sizes"))
    return d.select("directory", "page_count", ((F.col("d") == F.col("page_count")) & (F.col("low") == 0) & (F.col("high") == F.col("page_count") - 1) & F.col("sizes")).alias("ok"))


def page_methods(files: DataFrame) -> DataFrame:
    """(directory, page_index, method): extraction methods by page from ``*_meta.json`` sidecars; see page_method_problems."""
    stats = files.where(F.col("path").endswith("_meta.json")).select("directory", F.explode(F.try_variant_get("tree", "$.page_stats", "array<struct<page_id:int,text_extraction_method:string>>")).alias("s"))
    return stats.select("directory", F.col("s.page_id").alias("page_index"), F.lower(F.trim("s.text_extraction_method")).alias("method"))


def page_method_problems(methods: DataFrame, page_counts: DataFrame) -> DataFrame:
    """(directory, page_index, problem): pages named twice, out of range, or without index or method."""
    counted = methods.groupBy("directory", "page_index").agg(F.count("*").alias("n"), F.bool_or(F.coalesce("method", F.lit("")) == "").alias("blank")).join(page_counts.select("directory", "page_count"), "directory", "left")
    found = F.array(F.when(F.col("n") > 1, "page_repeated"), F.when((F.col("page_index") < 0) | (F.col("page_index") >= F.col("page_count")), "page_out_of_range"), F.when(F.col("page_index").isNull() | F.col("blank"), "malformed"))
    return counted.select("directory", "page_index", F.explode(F.array_compact(found)).alias("problem"))


def run_records(inside: DataFrame, beside: DataFrame, directories: DataFrame) -> DataFrame:
    """(directory, path, problem): the run record inside or beside each raw directory; both, or neither, is a problem."""
    a, b = inside.select("directory", F.col("path").alias("inside")), beside.select("directory", F.col("path").alias("beside"))
    both = directories.select("directory").distinct().join(a, "directory", "left").join(b, "directory", "left")
    problem = F.when(F.col("inside").isNotNull() & F.col("beside").isNotNull(), "two run records").when(F.coalesce("inside", "beside").isNull(), "no run record")
    return both.select("directory", F.coalesce("inside", "beside").alias("path"), problem.alias("problem"))


def artifact_inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, byte_size, sha256, artifact_kind) of every file below a directory; the kind follows from the name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.lower(F.regexp_extract("path", "[^/]*$", 0))
    kind = (
        F.when(name.endswith("_content_list.json"), "content_list").when(name.endswith("_middle.json"), "middle").when(name.endswith("_meta.json"), "metadata").when(name.endswith(".json"), "document_tree")
        .when(name.endswith(".md"), "markdown").when(name.endswith(".html"), "html").when(name.rlike(r"\.(png|jpe?g|gif|webp)$"), "image").when(name.endswith(".pdf"), "pdf").when(name.endswith(".log"), "log").otherwise("other")
    )
    return files.select("path", F.col("length").alias("byte_size"), F.sha2("content", 256).alias("sha256"), kind.alias("artifact_kind"))


def verify_artifacts(expected: DataFrame, inventory: DataFrame) -> DataFrame:
    """(path, problem): files missing, of another size or of another digest; all mismatches, not just the first."""
    e, i = expected.select("path", F.col("byte_size").alias("want"), F.lower("sha256").alias("want_sha")), inventory.select("path", "byte_size", "sha256")
    both = e.join(i, "path", "left")
    problems = F.array(F.when(F.col("sha256").isNull(), "missing"), F.when(F.col("byte_size") != F.col("want"), "size"), F.when(F.col("sha256") != F.col("want_sha"), "sha256"))
    return both.select("path", F.explode(F.filter(problems, lambda p: p.isNotNull())).alias("problem"))


MANIFEST_SCHEMA = (
    "path string, problem string, document_id string, document_number string, title string, document_type string, issuer string, version_id string, issued_on string, effective_on string, "
    "source_type string, publisher string, landing_page_url string, asset_url string, retrieved_at string, filename string, media_type string, byte_size bigint, sha256 string"
)
_SECTIONS = {
    "document": ("id", "document_number", "title", "document_type", "issuer"), "version": ("id", "issued_on", "effective_on"),
    "source": ("source_type", "publisher", "landing_page_url", "asset_url", "retrieved_at"), "artifact": ("filename", "media_type", "byte_size", "sha256"),
}


def manifests(spark: SparkSession, path: str, pattern: str = "*.yaml") -> DataFrame:
    """Manifest files as rows; ``problem`` is yaml, schema or mismatch where a file breaks the contract."""

    def parse(text: str) -> tuple[str | None, list[object]]:
        import yaml

        empty: list[object] = [None] * sum(map(len, _SECTIONS.values()))
        try:
            value = yaml.safe_load(text)
        except yaml.YAMLError:
            return "yaml", empty
        if not isinstance(value, dict) or not all(isinstance(value.get(s), dict) and all(f in value[s] for f in fields) for s, fields in _SECTIONS.items()):
            return "schema", empty
        fields = [value[s][f] for s, names in _SECTIONS.items() for f in names]
        wrong = value["version"].get("document_id") != value["document"]["id"]
        return "mismatch" if wrong else None, [x if isinstance(x, int) or x is None else str(x) for x in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = [parse(t or "") for t in batch.column(1).to_pylist()]
            columns = [[p[1][k] for p in parsed] for k in range(17)]
            arrays = [pa.array(c, pa.int64()) if k == 15 else pa.array([None if x is None else str(x) for x in c], pa.string()) for k, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p[0] for p in parsed], pa.string()), *arrays], names=[c.split()[0] for c in MANIFEST_SCHEMA.split(", ")])

    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("path"), "value").mapInArrow(run, MANIFEST_SCHEMA)


def dispatch_by_version(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(first form, second form, rejected): physical documents by their explicit integer version; true and "1" are no version."""
    v = F.try_variant_get("tree", "$.physical_ir_version", "variant")
    number = F.when(F.schema_of_variant(v) == "BIGINT", F.try_variant_get("tree", "$.physical_ir_version", "int"))
    tagged = files.withColumn("_v", number)
    return tagged.where("_v = 1").drop("_v"), tagged.where("_v = 2").drop("_v"), tagged.where("_v is null or _v not in (1, 2)").drop("_v")


def unknown_keys(tree: Column, allowed: list[str]) -> Column:
    """Keys of a JSON object that its schema does not know (readers would drop them silently)."""
    return F.array_except(F.map_keys(F.try_variant_get(tree, "$", "map<string,variant>")), F.array(*(F.lit(k) for k in allowed)))


def spatial_annotations(files: DataFrame) -> DataFrame:
    """(path, document_id, version_id, page_index, region ...): regions of spatial annotation files."""
    shape = "struct<document_id:string,version_id:string,audited_pages:array<struct<page_index:int,regions:array<struct<id:string,reading_order:int,kind:string,bbox:struct<x0:double,y0:double,x1:double,y1:double,coordinate_system:string>,text:string,heading_level:int>>>>>"
    a = files.select("path", F.from_json("raw", shape).alias("a")).select("path", "a.document_id", "a.version_id", F.explode("a.audited_pages").alias("p"))
    return a.select("path", "document_id", "version_id", "p.page_index", F.inline("p.regions"))


def structural_annotations(files: DataFrame, audit_suffix: str = "audit.v4.json") -> tuple[DataFrame, DataFrame]:
    """(node rows, problems) of structural annotation files ``*.v4.json``, audit files set aside; one file a document.

    Problems: unreadable text, a file without document id, and documents that several files claim (none of them counts).
    """
    mine = files.where(F.col("path").endswith(".v4.json") & ~F.col("path").endswith(audit_suffix))
    named = mine.select("path", "tree", F.try_variant_get("tree", "$.document_id", "string").alias("document_id"), F.try_variant_get("tree", "$.version_id", "string").alias("version_id"))
    twice = named.where("document_id is not null").groupBy("document_id").agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n > 1")
    why = F.when(F.col("tree").isNull(), "unreadable").when(F.col("document_id").isNull(), "document_id_missing")
    problems = named.select("path", why.alias("problem")).where("problem is not null").unionByName(twice.select("path", F.lit("document_repeated").alias("problem")))
    good = named.where("document_id is not null").join(twice, "document_id", "left_anti")
    pages = good.select("document_id", "version_id", F.posexplode(F.try_variant_get("tree", "$.audited_pages", "array<struct<page_index:int,nodes:array<variant>>>")).alias("page_position", "p"))
    nodes = pages.select("document_id", "version_id", "page_position", "p.page_index", F.posexplode("p.nodes").alias("node_position", "n"))
    texts = ("reference_record_id", "reference_instance_id", "parent_reference_instance_id", "kind", "ordinal_raw", "ordinal_key", "ordinal_system", "marker_text", "title", "canonical_path", "parent_canonical_path", "source_excerpt")
    fields = [F.try_variant_get("n", f"$.{name}", "string").alias(name) for name in texts]
    return nodes.select("document_id", "version_id", "page_index", "page_position", "node_position", *fields, F.try_variant_get("n", "$.scored", "boolean").alias("scored")), problems


def sidecar_provenance(files: DataFrame) -> DataFrame:
    """(directory, parser, parser_version, backend) that page-geometry sidecars state; the parser's name is mineru by default."""
    sidecars = files.where(F.col("path").endswith("_middle.json"))
    said = lambda n: F.nullif(F.trim(F.try_variant_get("tree", f"$.{n}", "string")), F.lit(""))
    return sidecars.select("directory", F.coalesce(said("_parser"), F.lit("mineru")).alias("parser"), said("_version_name").alias("parser_version"), said("_backend").alias("backend"))
