"""Deeply nested records as flat tables: interval labels by depth-first traversal.

Each tree is one row, walked once in Python with an explicit stack (any depth).  A node gets its pre-order and
post-order number; an ancestor's interval contains its descendants' intervals.  Everything that links nodes comes from
the intervals: parents, depths and paths by a stack of the intervals still open, the tables by type through
``containers``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions.deep_json import dumps, loads

NODE_SCHEMA = (
    "tree_id bigint, pre bigint, post bigint, depth int, node_path string, parent_path string, page_position int, node_id string, block_type string, "
    "section_id string, html string, x0 double, y0 double, x1 double, y1 double, polygon_points int, image_count int, polygon array<array<double>>, images map<string,string>, sections map<string,string>, other string"
)
CONTAINER_SCHEMA = "tree_id bigint, pre bigint, block_type string, container_pre bigint, container_type string, levels int"
LINK_SCHEMA = "tree_id bigint, pre bigint, post bigint, depth int, node_path string, parent_path string, node_id string, section_id string"


def children_of(node: dict[str, Any]) -> list[Any]:
    """A node's children in delivered order: a list, an object of numbered children, or either as JSON text."""
    value = node.get("children")
    if isinstance(value, str):
        try:
            value = loads(value)
        except ValueError:
            return []
    if isinstance(value, dict):
        value = [value] if "block_type" in value else list(value.values())
    return value if isinstance(value, list) else []


def _text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else dumps(value)


class Label(NamedTuple):
    """A node with its interval and its position among its siblings as delivered."""

    node: dict[str, Any]
    pre: int
    post: int
    position: int


def labels(root: dict[str, Any]) -> list[Label]:
    """All objects below the root in pre-order, pages first of their blocks; children that are no objects have no label."""
    out: list[Any] = []
    post = 0
    stack: list[tuple[Any, int, int]] = [(page, k, -1) for k, page in reversed(list(enumerate(children_of(root))))]
    while stack:
        node, position, pre = stack.pop()
        if not isinstance(node, dict):
            continue
        if pre >= 0:  # on the way up
            out[pre] = Label(node, pre, post, position)
            post += 1
            continue
        stack.append((node, position, len(out)))
        out.append(None)
        kids = children_of(node)
        stack += [(kids[k], k, -1) for k in range(len(kids) - 1, -1, -1)]
    return out


class Linked(NamedTuple):
    """A labelled node with what its intervals say: depth below its page, paths of itself and its parent, and its page."""

    label: Label
    depth: int
    path: str
    parent_path: str
    page: int


def linked(nodes: list[Label]) -> Iterator[Linked]:
    """Nodes in pre-order linked by interval containment: the parent is the innermost interval still open that contains the node's."""
    open_: list[tuple[int, str, int]] = []  # (post, path, page)
    for label in nodes:
        while open_ and open_[-1][0] < label.post:
            open_.pop()
        above = open_[-1] if open_ else (0, "", label.position)
        path = f"{above[1]}/{label.position}" if open_ else str(label.position)
        yield Linked(label, len(open_), path, above[1], above[2])
        open_.append((label.post, path, above[2]))


def _section(node: dict[str, Any], level: str) -> str:
    sections = node.get("section_hierarchy")
    return _text(sections.get(level)) if isinstance(sections, dict) else ""


_OWN = {"children", "id", "block_type", "html", "bbox", "polygon", "images", "section_hierarchy"}


def _numbers(value: Any, count: int | None = None) -> bool:
    return isinstance(value, list) and (count is None or len(value) == count) and all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in value)


def _details(node: dict[str, Any]) -> tuple[Any, ...]:
    """(polygon, images, sections, other): coordinates, image entries by id, section ids by level, and as JSON all that has no column."""
    polygon, images, sections = node.get("polygon"), node.get("images"), node.get("section_hierarchy")
    other = {k: v for k, v in node.items() if k not in _OWN}
    good = isinstance(polygon, list) and all(_numbers(p) for p in polygon)
    odd = {"polygon": not good, "images": not isinstance(images, dict), "section_hierarchy": not isinstance(sections, dict), "bbox": not _numbers(node.get("bbox"), 4)}
    other |= {k: node[k] for k, bad in odd.items() if bad and node.get(k) is not None}
    texts = lambda d: [(k, None if v is None else _text(v)) for k, v in d.items()] if isinstance(d, dict) else None
    return [[float(x) for x in p] for p in polygon] if good else None, texts(images), texts(sections), dumps(other) if other else None


def _flatten(full: bool, level: str):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            rows: list[list[Any]] = [[] for _ in range(len(_FULL) if full else 8)]
            size = 0
            for key, text in zip(keys.to_pylist(), texts, strict=True):
                source = text.as_py()
                try:
                    root = loads(source) if source else None
                except ValueError:
                    continue
                if not isinstance(root, dict):
                    continue
                for (node, pre, post, _), depth, path, parent, page in linked(labels(root)):
                    values: tuple[Any, ...]
                    if full:
                        box = node.get("bbox")
                        box = box if _numbers(box, 4) else [None] * 4
                        polygon, images = node.get("polygon"), node.get("images")
                        values = (
                            key, pre, post, depth, path, parent, page, _text(node.get("id")), _text(node.get("block_type")), _section(node, level), _text(node.get("html")),
                            *(None if x is None else float(x) for x in box), len(polygon) if isinstance(polygon, list) else 0, len(images) if isinstance(images, dict) else 0, *_details(node),
                        )
                    elif depth:
                        values = (key, pre, post, depth, path, parent, _text(node.get("id")), _section(node, level))
                    else:
                        continue
                    for column, value in zip(rows, values, strict=True):
                        column.append(value)
                size += len(source)
                if len(rows[0]) >= 20_000 or full and size >= 1 << 23:  # images can be long
                    yield _batch(rows, full)
                    rows, size = [[] for _ in rows], 0
            if rows[0]:
                yield _batch(rows, full)

    return run


_I, _L, _S, _D = pa.int32(), pa.int64(), pa.string(), pa.float64()
_M = pa.map_(_S, _S)
_FULL = dict(zip([c.split()[0] for c in NODE_SCHEMA.split(", ")], (_L, _L, _L, _I, _S, _S, _I, _S, _S, _S, _S, _D, _D, _D, _D, _I, _I, pa.list_(pa.list_(_D)), _M, _M, _S), strict=True))
_LINK = dict(zip([c.split()[0] for c in LINK_SCHEMA.split(", ")], (_L, _L, _L, _I, _S, _S, _S, _S), strict=True))


def _batch(rows: list[list[Any]], full: bool) -> pa.RecordBatch:
    kinds = _FULL if full else _LINK
    return pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, kinds.values(), strict=True)], names=list(kinds))


def nodes(trees: DataFrame, key: str, raw: str, section_level: str = "3") -> DataFrame:
    """Every page and block of every readable tree with interval labels; see NODE_SCHEMA.

    Null, empty and cut-off text gives no rows.  A missing id or section is ''.  Children that are not objects are passed
    over but keep their position.  Repeated ids do no harm, since paths and intervals identify nodes.  Fields without a
    column, and polygons, images, sections and boxes of another shape, are in ``other`` as JSON.
    """
    return trees.select(key, raw).mapInArrow(_flatten(True, section_level), NODE_SCHEMA)


def links(trees: DataFrame, key: str, raw: str, section_level: str = "3") -> DataFrame:
    """The blocks below pages with their labels, paths and sections only; see LINK_SCHEMA."""
    return trees.select(key, raw).mapInArrow(_flatten(False, section_level), LINK_SCHEMA)


def of_type(frame: DataFrame, *block_types: str) -> DataFrame:
    """The node table of some block types."""
    return frame.where(F.col("block_type").isin(list(block_types)))


def polygon_points(frame: DataFrame) -> DataFrame:
    """(tree_id, pre, point, x, y, point_values): the polygons of a node table point by point, in order."""
    p = frame.select("tree_id", "pre", F.posexplode("polygon").alias("point", "point_values"))
    return p.select("tree_id", "pre", "point", F.try_element_at("point_values", F.lit(1)).alias("x"), F.try_element_at("point_values", F.lit(2)).alias("y"), "point_values")


def images(frame: DataFrame) -> DataFrame:
    """(tree_id, pre, image_id, image): the image entries of a node table."""
    return frame.select("tree_id", "pre", F.explode("images").alias("image_id", "image"))


def sections(frame: DataFrame) -> DataFrame:
    """(tree_id, pre, level, section_id): the section references of a node table, of every level."""
    return frame.select("tree_id", "pre", F.explode("sections").alias("level", "section_id"))


def tree_fields(trees: DataFrame, key: str, raw: str) -> DataFrame:
    """(tree_id, block_type, other): each readable tree's own fields; ``other`` is JSON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    root = loads(text.as_py() or "null")
                except ValueError:
                    continue
                if isinstance(root, dict):
                    other = {n: v for n, v in root.items() if n not in ("children", "block_type")}
                    rows.append((k, _text(root.get("block_type")), dumps(other) if other else None))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((_L, _S, _S))], names=["tree_id", "block_type", "other"])

    return trees.select(key, raw).mapInArrow(run, "tree_id bigint, block_type string, other string")


def containers(trees: DataFrame, key: str, raw: str) -> DataFrame:
    """Each block's nearest enclosing node of each type, its page included; see CONTAINER_SCHEMA.

    Intervals in pre-order against a stack of those still open, one stack a type: no join, no shuffle, and at most one row
    a node and type, however deep the tree is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    root = loads(text.as_py() or "null")
                except ValueError:
                    continue
                if not isinstance(root, dict):
                    continue
                rows: list[tuple[Any, ...]] = []
                open_: dict[str, list[tuple[int, int, int]]] = {}
                for (node, pre, post, _), depth, *_rest in linked(labels(root)):
                    kind = _text(node.get("block_type"))
                    for other in list(open_):
                        stack = open_[other]
                        while stack and stack[-1][1] < post:
                            stack.pop()
                        if stack:
                            rows.append((k, pre, kind, stack[-1][0], other, depth - stack[-1][2]))
                        else:
                            del open_[other]
                    open_.setdefault(kind, []).append((pre, post, depth))
                for at in range(0, len(rows), 20_000):
                    part = rows[at : at + 20_000]
                    yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in part], t) for j, t in enumerate((_L, _L, _S, _L, _S, _I))], names=[c.split()[0] for c in CONTAINER_SCHEMA.split(", ")])

    return trees.select(key, raw).mapInArrow(run, CONTAINER_SCHEMA)


def contained(ancestors: DataFrame, descendants: DataFrame) -> DataFrame:
    """(tree_id, ancestor_pre, descendant_pre, levels): pairs of two node tables linked by interval containment.

    An equi-join on the tree with the interval test; pairs are within one tree and one page only, whose depth bounds
    the ancestors of a node.
    """
    a = ancestors.select("tree_id", "page_position", F.col("pre").alias("ancestor_pre"), F.col("post").alias("ancestor_post"), F.col("depth").alias("ancestor_depth"))
    d = descendants.select("tree_id", "page_position", F.col("pre").alias("descendant_pre"), F.col("post").alias("descendant_post"), F.col("depth").alias("descendant_depth"))
    both = a.join(d, ["tree_id", "page_position"]).where((F.col("ancestor_pre") < F.col("descendant_pre")) & (F.col("ancestor_post") > F.col("descendant_post")))
    return both.select("tree_id", "ancestor_pre", "descendant_pre", (F.col("descendant_depth") - F.col("ancestor_depth")).alias("levels"))
