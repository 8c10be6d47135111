"""Integrity rules as violation rows: an empty result means the data keep the contract."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions import columns as c

# Parents that each node kind may have.
ALLOWED_PARENTS = {
    "appendix": ["document"],
    "part": ["document", "appendix"],
    "chapter": ["document", "appendix", "part"],
    "section": ["document", "appendix", "part", "chapter"],
    "subsection": ["document", "appendix", "part", "chapter", "section"],
    "article": ["document", "appendix", "part", "chapter", "section", "subsection"],
    "clause": ["article"],
    "point": ["clause"],
    "generic_section": ["document", "appendix", "part", "chapter", "section", "subsection", "article", "clause", "generic_section"],
}


class IntegrityError(ValueError):
    """Raised in strict mode when a rule is broken."""


def violations(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """(rule_id, keys ...) for each row and rule whose condition is true; one scan for all rules.  Null conditions hold."""
    found = F.array(*(F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules.items()))
    return df.select(*keys, F.explode(F.filter(found, lambda r: r.isNotNull())).alias("rule_id"))


def require(found: DataFrame) -> None:
    """Strict mode: raise at the first violation."""
    first = found.limit(1).collect()
    if first:
        raise IntegrityError(str(first[0].asDict()))


def block_rules(generation: int = 2) -> dict[str, Column]:
    """Conditional fields and boxes of a block."""
    kind = F.col("kind" if generation == 2 else "kind_v0")
    rules = {
        "heading_level_on_non_title": F.col("heading_level").isNotNull() & (kind != "title"),
        "box_invalid": F.col("x0").isNotNull() & ~c.box_ok(*(F.col(x) for x in ("x0", "y0", "x1", "y1"))),
        "box_missing": F.col("x0").isNull(),
        "block_id_mismatch": F.col("block_id") != c.block_id(F.col("document_id"), F.coalesce("version_id", F.lit("")), F.col("page_index"), F.col("reading_order")),
    }
    if generation == 2:
        rules |= {"table_on_non_table": F.col("table_html").isNotNull() & (kind != "table"), "image_on_non_image": F.col("image_path").isNotNull() & ~kind.isin("image", "figure"), "image_path_unsafe": F.col("image_path").isNotNull() & ~c.safe_path(F.col("image_path"))}
    return rules


def block_violations(blocks: DataFrame, generation: int = 2) -> DataFrame:
    """Violations of single blocks."""
    return violations(blocks, ["run_id", "block_id"], block_rules(generation))


def page_violations(blocks: DataFrame) -> DataFrame:
    """(rule_id, run_id, page_index): reading order not 0 .. n-1, or a repeated block id; by aggregates, without a window."""
    pages = blocks.groupBy("run_id", "page_index").agg(F.count("*").alias("n"), F.min("reading_order").alias("low"), F.max("reading_order").alias("high"), F.count_distinct("reading_order").alias("orders"), F.count_distinct("block_id").alias("ids"))
    gap = (F.col("low") != 0) | (F.col("high") != F.col("n") - 1) | (F.col("orders") != F.col("n"))
    return violations(pages, ["run_id", "page_index"], {"reading_order_not_contiguous": gap, "block_id_repeated": F.col("ids") != F.col("n")})


def document_violations(blocks: DataFrame) -> DataFrame:
    """(rule_id, run_id): pages not 0 .. n-1."""
    d = blocks.groupBy("run_id").agg(F.min("page_index").alias("low"), F.max("page_index").alias("high"), F.count_distinct("page_index").alias("pages"))
    return violations(d, ["run_id"], {"pages_not_contiguous": (F.col("low") != 0) | (F.col("high") != F.col("pages") - 1)})


def anchor_violations(anchors: DataFrame, key: str) -> DataFrame:
    """Anchors whose offsets do not fit their role."""
    object_ = F.col("role") == "object"
    both = F.col("char_start").isNotNull() & F.col("char_end").isNotNull()
    return violations(anchors, [key, "node_id", "block_id"], {"object_with_offsets": object_ & (F.col("char_start").isNotNull() | F.col("char_end").isNotNull()), "text_without_span": ~object_ & (~both | (F.col("char_start") >= F.col("char_end")))})


def node_violations(nodes: DataFrame, key: str) -> DataFrame:
    """Nodes whose fields contradict each other."""
    root = F.col("kind") == "document"
    expected = c.key_for_system(c.system_of(F.col("kind"), F.col("method")), F.col("ordinal_raw"))
    name = F.when(F.col("kind") == "generic_section", "generic").otherwise(F.col("kind"))
    rules = {
        "root_with_marker": root & F.coalesce("parent_id", "ordinal_raw", "ordinal_key", "marker_text", "title").isNotNull(),
        "node_without_marker": ~root & F.col("marker_text").isNull(),
        "raw_without_key": ~root & (F.col("ordinal_raw").isNull() != F.col("ordinal_key").isNull()),
        "key_not_recomputed": ~root & F.col("ordinal_raw").isNotNull() & ~expected.eqNullSafe(F.col("ordinal_key")),
        "path_segment": ~root & (F.substring_index("path", "/", -1) != F.concat(name, F.lit(":"), F.coalesce("ordinal_key", F.lit("unnumbered")))),
    }
    return violations(nodes, [key, "node_id"], rules)


def hierarchy_violations(nodes: DataFrame, key: str) -> DataFrame:
    """Broken parent edges: missing, later or deeper parents, kinds not allowed, paths that do not extend the parent's."""
    parent = nodes.select(key, F.col("node_id").alias("parent_id"), F.col("kind").alias("p_kind"), F.col("depth").alias("p_depth"), F.col("path").alias("p_path"), F.col("sequence").alias("p_seq"), F.lit(True).alias("p"))
    both = nodes.join(parent, [key, "parent_id"], "left")
    allowed = reduce(lambda a, kv: a.when((F.col("kind") == kv[0]) & F.col("p_kind").isin(kv[1]), True), ALLOWED_PARENTS.items(), F.when(F.lit(False), True)).otherwise(False)
    child = F.col("kind") != "document"
    prefix = F.when(F.col("p_kind") == "document", F.lit("")).otherwise(F.concat("p_path", F.lit("/")))
    rules = {
        "parent_missing": child & F.col("p").isNull(),
        "parent_not_earlier": F.col("p_seq") >= F.col("sequence"),
        "depth_not_parent_plus_one": F.col("p_depth") + 1 != F.col("depth"),
        "parent_kind": F.col("p").isNotNull() & ~allowed,
        "path_not_extending": F.col("path") != F.concat(prefix, F.substring_index("path", "/", -1)),
    }
    broken = violations(both, [key, "node_id"], rules)
    twice = nodes.groupBy(key, "path").agg(F.count("*").alias("n"), F.min("node_id").alias("node_id")).where("n > 1").select(key, "node_id", F.lit("path_repeated").alias("rule_id"))
    return broken.unionByName(twice)


def anchor_partition(blocks: DataFrame, anchors: DataFrame, key: str) -> DataFrame:
    """(key, block_id, rule_id): content blocks that anchors do not cover exactly, and anchors on other blocks.

    Aggregates only: spans tile a text if starts are distinct, they begin at 0, and lengths add up to the extent and to
    the text's length.
    """
    per = anchors.groupBy(key, "block_id").agg(
        F.count_if(F.col("role") == "object").alias("objects"), F.count_if(F.col("role") != "object").alias("spans"), F.min("char_start").alias("low"), F.max("char_end").alias("high"),
        F.sum(F.col("char_end") - F.col("char_start")).alias("total"), F.count_distinct("char_start").alias("starts"), F.min("page_index").alias("first_page"), F.max("page_index").alias("last_page"),
    )
    both = blocks.select(key, "block_id", "disposition", F.length("text").alias("n"), F.col("page_index").alias("_page")).join(per, [key, "block_id"], "full")
    content, none = F.col("disposition") == "content", F.col("spans").isNull()
    tiled = (F.col("low") == 0) & (F.col("high") == F.col("n")) & (F.col("total") == F.col("n")) & (F.col("starts") == F.col("spans"))
    rules = {
        "anchor_on_unknown_block": F.col("disposition").isNull(),
        "anchor_on_other_block": ~content & ~none,
        "anchor_on_other_page": ~none & ((F.col("first_page") != F.col("_page")) | (F.col("last_page") != F.col("_page"))),
        "text_not_covered": content & (F.col("n") > 0) & (none | ~tiled | (F.col("objects") > 0)),
        "empty_block_not_owned_once": content & (F.col("n") == 0) & (none | (F.col("objects") != 1) | (F.col("spans") > 0)),
    }
    return violations(both, [key, "block_id"], rules)


def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def evidence_violations(blocks: DataFrame, nodes: DataFrame, anchors: DataFrame, key: str) -> DataFrame:
    """(rule_id, key, node_id): nodes whose marker is not one anchor, or whose marker text or title is not what stands there; titles without anchor.

    A title is compared with the slices of its anchors in their order, joined, in NFKC and with blanks collapsed.
    """
    heads = anchors.where("role in ('marker', 'title')").join(blocks.select(key, "block_id", "text"), [key, "block_id"])
    raw = F.expr("substring(text, char_start + 1, char_end - char_start)")
    part = F.when(F.col("role") == "title", F.struct("sequence", "char_start", raw.alias("slice")))
    per = heads.groupBy(key, "node_id").agg(
        F.count_if(F.col("role") == "marker").alias("markers"), F.count_if(F.col("role") == "title").alias("titles"), F.max(F.when(F.col("role") == "marker", c.strip(raw))).alias("seen"),
        F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["slice"]), "").alias("_slices"),
    )
    per = per.withColumn("seen_title", c.strip(F.regexp_replace(F.pandas_udf(_nfkc, "string")("_slices"), "[\\t\\f\\x0B \u00a0]+", " "))).drop("_slices")
    both = nodes.where("kind <> 'document'").join(per, [key, "node_id"], "left")
    titles = F.coalesce("titles", F.lit(0))
    rules = {
        "marker_not_once": F.coalesce("markers", F.lit(0)) != 1, "marker_text_differs": c.strip(F.col("marker_text")) != F.col("seen"), "title_without_anchor": F.col("title").isNotNull() & (titles == 0),
        "anchor_without_title": F.col("title").isNull() & (titles > 0), "title_text_differs": F.col("title").isNotNull() & (titles > 0) & ~F.col("title").eqNullSafe(F.col("seen_title")),
    }
    return violations(both, [key, "node_id"], rules)


def region_violations(regions: DataFrame) -> DataFrame:
    """Spatial annotation: empty or reversed boxes, levels on other kinds, and pages whose order is not 0 .. n-1."""
    one = violations(regions, ["document_id", "version_id", "page_index", "region_id"], {"box_invalid": ~c.box_ok(*(F.col(f"bbox.{x}") for x in ("x0", "y0", "x1", "y1")), strict=True), "level_on_non_heading": F.col("heading_level").isNotNull() & (F.col("kind") != "heading")})
    pages = regions.groupBy("document_id", "version_id", "page_index", "annotation_version", "created_at").agg(F.count("*").alias("n"), F.min("reading_order").alias("low"), F.max("reading_order").alias("high"), F.count_distinct("reading_order").alias("d"))
    page = violations(pages, ["document_id", "version_id", "page_index"], {"order_not_contiguous": (F.col("low") != 0) | (F.col("high") + 1 != F.col("d"))})
    return one.unionByName(page.withColumn("region_id", F.lit(None).cast("string")))


def reference_node_violations(nodes: DataFrame) -> DataFrame:
    """Structural annotation: instances defined differently or scored twice, record ids given twice, and parents that are
    missing, on later pages, of other paths or of a kind not allowed."""
    doc = ["document_id", "version_id", "annotation_version"]
    same = F.struct("kind", "ordinal_key", "canonical_path", "parent_canonical_path", "parent_reference_instance_id")
    defined = nodes.where("reference_instance_id is not null").groupBy(*doc, "reference_instance_id").agg(F.count_distinct(same).alias("n")).where("n > 1").select(*doc, "reference_instance_id", F.lit("instance_defined_differently").alias("rule_id"))
    parent = nodes.where("reference_instance_id is not null").groupBy(*doc, F.col("reference_instance_id").alias("parent_reference_instance_id")).agg(F.min("page_index").alias("p_page"), F.collect_set("canonical_path").alias("p_paths"))
    child = nodes.where("parent_reference_instance_id is not null").select(*doc, "reference_instance_id", "parent_reference_instance_id", "page_index", "parent_canonical_path").distinct()
    both = child.join(parent, [*doc, "parent_reference_instance_id"], "left")
    edge = violations(both, [*doc, "reference_instance_id"], {"parent_missing": F.col("p_page").isNull(), "parent_on_later_page": F.col("p_page") > F.col("page_index"), "parent_path": ~F.array_contains("p_paths", F.col("parent_canonical_path"))})
    # a node delivered again is the same in all but row id and time
    content = F.struct(*(x for x in nodes.columns if x not in ("node_row_id", "created_at", "ingested_at")))
    record = nodes.where("reference_record_id is not null").groupBy(*doc, "reference_record_id").agg(F.count_distinct(content).alias("n"), F.min("reference_instance_id").alias("reference_instance_id")).where("n > 1")
    scored = nodes.where("reference_instance_id is not null").where(F.coalesce("scored", F.lit(True))).groupBy(*doc, "reference_instance_id").agg(F.count_distinct(content).alias("n")).where("n > 1")
    rule = lambda df, name: df.select(*doc, "reference_instance_id", F.lit(name).alias("rule_id"))
    # an instance without a parent stands under the document; older versions have paths only, which say so too
    kinds = nodes.where("reference_instance_id is not null").select(*doc, F.col("reference_instance_id").alias("parent_reference_instance_id"), F.col("kind").alias("p_kind")).distinct()
    below = nodes.where("reference_instance_id is not null").select(*doc, "reference_instance_id", "parent_reference_instance_id", "kind", "parent_canonical_path").distinct().join(kinds, [*doc, "parent_reference_instance_id"], "left")
    top = F.col("parent_reference_instance_id").isNull() & F.coalesce("parent_canonical_path", F.lit("document")).isin("", "document")
    parent_kind = F.when(top, "document").otherwise(F.col("p_kind"))
    allowed = reduce(lambda a, kv: a.when((F.col("kind") == kv[0]) & parent_kind.isin(kv[1]), True), ALLOWED_PARENTS.items(), F.when(F.lit(False), True)).otherwise(False)
    wrong = below.where(parent_kind.isNotNull() & ~allowed).select(*doc, "reference_instance_id").distinct()
    more = rule(record, "record_id_repeated").unionByName(rule(scored, "scored_instance_repeated")).unionByName(rule(wrong, "parent_kind"))
    return defined.unionByName(edge.select(*defined.columns)).unionByName(more)


def _strong_components(edges: list[tuple[str, str]]) -> set[str]:
    """Nodes that are their own ancestor: those in a strongly connected part of several nodes, or with an edge to themselves."""
    after: dict[str, list[str]] = {}
    for child, parent in edges:
        after.setdefault(child, []).append(parent)
    number: dict[str, int] = {}
    low: dict[str, int] = {}
    path: list[str] = []
    on_path: set[str] = set()
    out = {c for c, p in edges if c == p}
    for start in after:
        if start in number:
            continue
        work = [(start, iter(after.get(start, ())))]
        number[start] = low[start] = len(number)
        path.append(start)
        on_path.add(start)
        while work:
            node, rest = work[-1]
            nxt = next(rest, None)
            if nxt is None:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == number[node]:
                    part = path[path.index(node) :] if path[-1] != node else [node]
                    del path[len(path) - len(part) :]
                    on_path.difference_update(part)
                    out |= set(part) if len(part) > 1 else set()
            elif nxt not in number:
                number[nxt] = low[nxt] = len(number)
                path.append(nxt)
                on_path.add(nxt)
                work.append((nxt, iter(after.get(nxt, ()))))
            elif nxt in on_path:
                low[node] = min(low[node], number[nxt])
    return out


def cycles(edges: DataFrame, scope: list[str], child: str, parent: str) -> DataFrame:
    """(scope, child): nodes that are their own ancestor.

    Nodes without parents and nodes without children cannot be on a cycle; they are taken off round by round with
    semi-joins until none is left to take.  What stays, nothing in sound data, is cycles and ways between them; each
    scope's is cut into its strongly connected parts.  Rounds are as many as the hierarchy is deep.  Null parents and no
    edges give no cycles.
    """
    from docweave.sources.tables import checkpointed

    rest = checkpointed(edges.where(F.col(parent).isNotNull() & F.col(child).isNotNull()).select(*scope, F.col(child).alias("_c"), F.col(parent).alias("_p")).distinct())
    size = rest.count()
    while size:
        children, parents = rest.select(*scope, F.col("_c").alias("_p")).distinct(), rest.select(*scope, F.col("_p").alias("_c")).distinct()
        rest = checkpointed(rest.join(children, [*scope, "_p"], "left_semi").join(parents, [*scope, "_c"], "left_semi"))
        before, size = size, rest.count()
        if size == before:
            break
    kinds = dict(rest.dtypes)

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        found = sorted(_strong_components(list(zip(group["_c"], group["_p"], strict=True))))
        return pd.DataFrame([(*(group[k].iloc[0] for k in scope), c) for c in found], columns=[*scope, child])

    return rest.groupBy(*scope).applyInPandas(solve, ", ".join(f"`{k}` {kinds[k]}" for k in scope) + f", `{child}` {kinds['_c']}")


def manifest_violations(manifests: DataFrame) -> DataFrame:
    """Manifests whose addresses, file name, digest, ids or size break the contract."""
    rules = {
        "landing_page_not_https": ~c.https_url(F.col("landing_page_url")),
        "asset_not_https": ~c.https_url(F.col("asset_url")),
        "addresses_equal": F.col("landing_page_url") == F.col("asset_url"),
        "file_name_not_plain": ~c.plain_file_name(F.col("artifact_filename")),
        "sha256_malformed": ~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)),
        "size_not_positive": ~F.coalesce(F.col("byte_size") > 0, F.lit(False)),
        "document_id_malformed": ~F.coalesce(F.col("document_id").rlike("^[a-z0-9]+(-[a-z0-9]+)*$"), F.lit(False)),
        "version_id_malformed": ~F.coalesce(F.col("version_id").rlike("^v[1-9][0-9]*$"), F.lit(False)),
        "effective_before_issue": F.col("effective_on") < F.col("issued_on"),
    }
    return violations(manifests, ["manifest_row_id"], rules)


def run_violations(runs: DataFrame) -> DataFrame:
    """Runs whose provenance or duration cannot be used."""
    rules = {
        "duration_not_positive": ~F.coalesce(F.col("duration_seconds") > 0, F.lit(False)),
        "version_missing": F.coalesce(c.strip(F.col("parser_version")), F.lit("")) == "",
        "input_sha256_malformed": ~F.coalesce(F.col("input_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)),
        "marker_baseline": (F.lower(F.trim("parser")) == "marker") & ~c.baseline_ok(F.col("parser_version"), F.col("backend"), F.col("run_mode"), F.col("output_format"), F.col("disable_ocr")),
        "ingested_before_finish": F.col("ingested_at") < F.col("finished_at"),
        "artifact_path_unsafe": F.exists("artifacts", lambda a: ~c.safe_path(a["relative_path"])),
    }
    return violations(runs, ["run_id"], rules)
