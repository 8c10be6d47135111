"""From raw parser output to the parser-independent block table (both generations of the physical form)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.functions import columns as c
from docweave.functions.deep_json import loads
from docweave.operators.html_text import HtmlError, expand_references, heading_level, visible_text
from docweave.operators.nested import children_of

BLOCK_COLUMNS = (
    "run_id", "document_id", "version_id", "page_index", "reading_order", "raw_index", "block_id", "raw_type", "kind_v0", "disposition_v0", "kind", "disposition", "text", "x0", "y0", "x1", "y1",
    "heading_level", "table_html", "image_path", "width", "height",
)


def latest(df: DataFrame, keys: list[str], *newest: str) -> DataFrame:
    """One row per key, the one delivered last: the largest of the ``newest`` columns in turn; of rows repeated as a whole, one.

    The rank is limited to 1 before the shuffle as well as after it, so that a row delivered many times makes no hot window.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.col(n).desc() for n in newest)))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def latest_wide(df: DataFrame, keys: list[str], newest: str, row_id: str) -> DataFrame:
    """As ``latest`` for rows with a long value: the last delivery is found on narrow columns, and its row looked up by its id.

    ``row_id`` is unique but for rows repeated as a whole, of which one stays.
    """
    last = df.groupBy(*keys).agg(F.max(F.struct(newest, row_id)).alias("_b")).select(F.col(f"_b.{row_id}").alias(row_id))
    return df.join(last, row_id, "left_semi").dropDuplicates([row_id])


def list_blocks(items: DataFrame) -> DataFrame:
    """Blocks of flat-list items (run_id, document_id, version_id, raw_index, page_idx, item_type, item_text, bbox, ...).

    Reading order counts a page's items in list order; the block id follows from it.  An item delivered again counts
    once, as delivered last.  Missing boxes stay null; a level counts only on text; null text is ''.
    """
    once = latest(items, ["run_id", "raw_index"], "ingested_at", "item_id")
    order = (F.row_number().over(Window.partitionBy("run_id", "page_idx").orderBy("raw_index")) - 1).alias("reading_order")
    level, kind = F.col("text_level"), F.col("item_type")
    box = [F.try_element_at("bbox", F.lit(k)).try_cast("double") for k in (1, 2, 3, 4)]
    rows = once.select(
        "run_id", "document_id", "version_id", F.col("page_idx").alias("page_index"), order, "raw_index", kind.alias("raw_type"),
        c.list_kind(kind, level, 0).alias("kind_v0"), c.list_disposition(kind, 0).alias("disposition_v0"), c.list_kind(kind, level, 1).alias("kind"), c.list_disposition(kind, 1).alias("disposition"),
        F.coalesce(c.strip(F.col("item_text")), F.lit("")).alias("text"), *(F.when(F.size("bbox") == 4, b).alias(n) for b, n in zip(box, ("x0", "y0", "x1", "y1"), strict=True)),
        F.when((kind == "text") & (level >= 1), level).alias("heading_level"), F.col("table_body").alias("table_html"), F.col("img_path").alias("image_path"),
        F.lit(None).cast("double").alias("width"), F.lit(None).cast("double").alias("height"),
    )
    return rows.withColumn("block_id", c.block_id(F.col("document_id"), F.coalesce("version_id", F.lit("")), F.col("page_index"), F.col("reading_order"))).select(*BLOCK_COLUMNS)


# Fixed value: the id of a page, with its number.
PAGE_ID = re.compile(r"/page/([0-9]+)/Page/[0-9]+")


def _page_problem(page: dict[str, Any], number: int) -> str | None:
    """Why a page breaks the contract: an id of another form or number, or a box without extent."""
    named = PAGE_ID.fullmatch(page["id"]) if isinstance(page.get("id"), str) else None
    if not named or int(named[1]) != number:
        return "page id"
    x0, y0, x1, y1 = _box(page)
    return None if x0 is not None and x0 < x1 and y0 < y1 else "page box"


_TREE_FIELDS = {
    "page_index": pa.int32(), "reading_order": pa.int32(), "raw_index": pa.int32(), "raw_type": pa.string(), "text": pa.string(), "px0": pa.float64(), "py0": pa.float64(), "px1": pa.float64(),
    "py1": pa.float64(), "bx0": pa.float64(), "by0": pa.float64(), "bx1": pa.float64(), "by1": pa.float64(), "heading": pa.int32(), "table_html": pa.string(), "problem": pa.string(),
}


def _box(node: dict[str, Any]) -> list[float | None]:
    b = node.get("bbox")
    ok = isinstance(b, list) and len(b) == 4 and all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in b) and b[0] <= b[2] and b[1] <= b[3]
    return [float(x) for x in b] if ok else [None] * 4


def tree_blocks(trees: DataFrame) -> DataFrame:
    """Blocks of nested trees (tree_id, run_id, document_id, version_id, raw_json): the direct children of each page.

    Nested children are not blocks of their own; their text comes in by content references.  Boxes are projected on the
    page's 0 .. 1000 scale.  ``problem`` names what breaks the contract (references, else the page's id or box, else the
    block's box); unreadable trees give no rows.  A tree delivered again counts once.
    """
    once = latest_wide(trees.select("run_id", "document_id", "version_id", "ingested_at", "tree_id", "raw_json"), ["run_id"], "ingested_at", "tree_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            head = [batch.column(k).to_pylist() for k in range(3)]
            kinds = [batch.column(k).type for k in range(3)]
            for i, raw in enumerate(batch.column(3)):
                rows: list[tuple[Any, ...]] = []
                try:
                    root = loads(raw.as_py() or "")
                except ValueError:
                    continue
                if not isinstance(root, dict):
                    continue
                number = 0
                for p, page in enumerate(children_of(root)):
                    if not isinstance(page, dict):
                        continue
                    page_box, broken = _box(page), _page_problem(page, p)
                    for k, block in enumerate(children_of(page)):
                        if not isinstance(block, dict):
                            continue
                        problem, source = broken or (None if _box(block)[0] is not None else "box"), block.get("html") or ""
                        try:
                            source = expand_references({**block, "children": children_of(block)})
                        except HtmlError as e:
                            problem = str(e)
                        kind = block.get("block_type")
                        rows.append((p, k, number, kind if isinstance(kind, str) else None, visible_text(source), *page_box, *_box(block), heading_level(source) if kind == "SectionHeader" else None, block.get("html") if kind == "Table" else None, problem))
                        number += 1
                names = ["run_id", "document_id", "version_id", *_TREE_FIELDS]
                same = [pa.array([h[i]] * len(rows), t) for h, t in zip(head, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*same, *(pa.array([r[j] for r in rows], t) for j, t in enumerate(_TREE_FIELDS.values()))], names=names)

    spell = {pa.int32(): "int", pa.string(): "string", pa.float64(): "double"}
    schema = "run_id bigint, document_id string, version_id string, " + ", ".join(f"{n} {spell[t]}" for n, t in _TREE_FIELDS.items())
    flat = once.select("run_id", "document_id", "version_id", "raw_json").mapInArrow(run, schema)
    kind = F.col("raw_type")
    at = lambda v, axis: c.projected(F.col(f"b{v}"), F.col(f"p{axis}0"), F.col(f"p{axis}1") - F.col(f"p{axis}0")).alias(v)
    return flat.select(
        "run_id", "document_id", "version_id", "page_index", "reading_order", "raw_index", c.block_id(F.col("document_id"), F.coalesce("version_id", F.lit("")), F.col("page_index"), F.col("reading_order")).alias("block_id"),
        "raw_type", c.tree_kind(kind, 0).alias("kind_v0"), c.tree_disposition(kind).alias("disposition_v0"), c.tree_kind(kind, 1).alias("kind"), c.tree_disposition(kind).alias("disposition"), "text",
        at("x0", "x"), at("y0", "y"), at("x1", "x"), at("y1", "y"), F.col("heading").alias("heading_level"), "table_html", F.lit(None).cast("string").alias("image_path"),
        (F.col("px1") - F.col("px0")).alias("width"), (F.col("py1") - F.col("py0")).alias("height"), "problem",
    )


def all_blocks(items: DataFrame, trees: DataFrame) -> DataFrame:
    """Blocks of both raw formats in one table, with the parser's name."""
    return list_blocks(items).withColumn("parser", F.lit("mineru")).unionByName(tree_blocks(trees).drop("problem").withColumn("parser", F.lit("marker")))


def page_counts(blocks: DataFrame, sidecar: DataFrame | None = None) -> DataFrame:
    """(run_id, page_count): the sidecar's count where there is one, else the largest page index plus one."""
    own = blocks.groupBy("run_id").agg((F.max("page_index") + 1).alias("_own"))
    if sidecar is None:
        return own.withColumnRenamed("_own", "page_count")
    return own.join(sidecar.select("run_id", F.col("page_count").alias("_given")), "run_id", "full").select("run_id", F.coalesce("_given", "_own").alias("page_count"))


def extraction_evidence(blocks: DataFrame, page_methods: DataFrame | None = None) -> DataFrame:
    """Blocks with ``extraction_method``: native_text where a page's sidecar says pdftext, else unknown; null for no text."""
    if page_methods is None:
        return blocks.withColumn("extraction_method", F.when(F.col("text") != "", "unknown"))
    m = page_methods.select("run_id", "page_index", F.lower(F.trim("method")).alias("_m")).dropDuplicates(["run_id", "page_index"])
    found = blocks.join(m, ["run_id", "page_index"], "left")
    return found.withColumn("extraction_method", F.when(F.col("text") != "", F.when(F.col("_m") == "pdftext", "native_text").otherwise("unknown"))).drop("_m")
