"""Canonical physical documents: the exact JSON text of each run, streamed page by page, and its identity hash.

The text has the fields in their fixed order, two blanks of indent, non-ASCII characters as they are, and a line feed at
the end; its SHA-256 is a document's identity.  A run's blocks are brought together by key and sorted within the
partition; the writer holds one page and a hash, never a whole run.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from json.encoder import encode_basestring
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.operators.html_text import HtmlError, table_grid

#: Characters of text after which a chunk is sent.
CHUNK = 1 << 20
#: Columns of a run that go before its pages.
HEADER = ("document_id", "version_id", "source_artifact_sha256", "parser", "parser_version", "parser_backend")
_BLOCK = (
    "page_index", "reading_order", "block_id", "kind", "disposition", "text", "x0", "y0", "x1", "y1", "heading_level", "source_raw_artifact", "raw_index", "raw_type", "extraction_method", "table_html", "asset",
    "width", "height",
)


def canonical_json(value: Any, sort_keys: bool = False) -> str:
    """Canonical JSON of plain values: field order kept (or keys sorted for reports), no NaN; ValueError if there is one."""
    return json.dumps(_plain(value), ensure_ascii=False, indent=2, sort_keys=sort_keys, allow_nan=False) + "\n"


def _plain(value: Any) -> Any:
    return {k: _plain(v) for k, v in value.asDict().items()} if hasattr(value, "asDict") else [_plain(v) for v in value] if isinstance(value, list) else value


def _table(html: str | None) -> dict[str, Any] | None:
    """The grid of a table, or None where there is none or its markup is rejected."""
    try:
        grid = table_grid(html)
    except HtmlError:
        return None
    return grid and {"row_count": grid.row_count, "column_count": grid.column_count, "cells": [c._asdict() for c in grid.cells]}


_NO_ASSET = {"storage_kind": "unavailable", "relative_path": None, "media_type": None, "sha256": None, "byte_size": None}


def _scalar(value: Any) -> str:
    """A number, text or null as JSON; ValueError for a number that is not finite."""
    if isinstance(value, str):
        return encode_basestring(value)
    if value is None:
        return "null"
    if isinstance(value, float) and math.isfinite(value) or type(value) is int:
        return repr(value)
    return json.dumps(value, allow_nan=False)


def _members(pairs: list[tuple[str, str]], indent: int) -> str:
    """Members of an object whose values are JSON already, in the order given."""
    blank = "\n" + " " * indent
    return "{" + blank + f",{blank}".join(f'"{name}": {value}' for name, value in pairs) + "\n" + " " * (indent - 2) + "}"


def block_text(b: dict[str, Any], run: dict[str, str], generation: int) -> str:
    """A block as it is written inside its page; ``generation`` 1 or 2, ``run`` the run's parser fields as JSON."""
    provenance = [*run.items(), ("source_raw_artifact", _scalar(b["source_raw_artifact"])), ("source_raw_index", _scalar(b["raw_index"]))]
    box = [*((n, _scalar(b[n])) for n in ("x0", "y0", "x1", "y1")), ("coordinate_system", '"normalized_1000"')]
    own = [
        ("id", _scalar(b["block_id"])), ("page_index", _scalar(b["page_index"])), ("reading_order", _scalar(b["reading_order"])), ("kind", _scalar(b["kind"])), ("disposition", _scalar(b["disposition"])), ("text", _scalar(b["text"])),
        ("bbox", _members(box, 12)), ("heading_level", _scalar(b["heading_level"] if b["kind"] == "title" else None)),
    ]
    if generation == 2:
        provenance.append(("source_raw_type", _scalar(b["raw_type"])))
    own.append(("provenance", _members(provenance, 12)))
    if generation == 2:
        own.append(("text_extraction", _members([("method", _scalar(b["extraction_method"] or "unknown")), ("confidence", "null")], 12) if b["text"] else "null"))
        own.append(("table_structure", _indented(_table(b["table_html"]), 10) if b["kind"] == "table" else "null"))
        own.append(("visual_asset", _indented(b["asset"] or _NO_ASSET, 10) if b["kind"] in ("figure", "image") else "null"))
    return _members(own, 10)


def _indented(value: Any, by: int) -> str:
    """JSON with an indent of two, all lines but the first moved to the right; strings have no line feeds in JSON."""
    return json.dumps(value, ensure_ascii=False, indent=2, allow_nan=False).replace("\n", "\n" + " " * by)


class Writer:
    """Pieces of one run's canonical text, page after page in order."""

    def __init__(self, run: dict[str, Any], generation: int) -> None:
        self.run, self.generation, self.next = run, generation, 0
        self.parser = {n: _scalar(run[n]) for n in ("parser", "parser_version", "parser_backend")}

    def begin(self) -> str:
        head = {"physical_ir_version": self.generation, **{n: self.run[n] for n in HEADER}, "page_count": self.run["page_count"]}
        return _indented(head, 0).removesuffix("\n}") + ',\n  "pages": ['

    def page(self, number: int, blocks: list[dict[str, Any]]) -> str:
        """A page, after the empty pages before it."""
        out = []
        for n in range(self.next, number + 1):
            own = blocks if n == number else []
            texts = ",\n        ".join(block_text(b, self.parser, self.generation) for b in own)
            size = [("width", _scalar(own[0]["width"] if own else None)), ("height", _scalar(own[0]["height"] if own else None))]
            out.append(f"{',' if n else ''}\n    " + _members([("page_index", _scalar(n)), *size, ("blocks", f"[\n        {texts}\n      ]" if own else "[]")], 6))
        self.next = number + 1
        return "".join(out)

    def end(self) -> str:
        rest = self.page(self.run["page_count"] - 1, []) if self.next < self.run["page_count"] else ""
        return rest + ("\n  ]\n}\n" if self.next else "]\n}\n")


def _prepared(blocks: DataFrame, generation: int) -> DataFrame:
    """The columns that are written, with each run in one partition."""
    have = set(blocks.columns)
    kinds = {"source_raw_artifact": "string", "extraction_method": "string", "width": "double", "height": "double", "asset": "struct<storage_kind:string,relative_path:string,media_type:string,sha256:string,byte_size:bigint>", **dict.fromkeys(HEADER, "string")}
    name = {"kind": "kind_v0", "disposition": "disposition_v0"} if generation == 1 else {}

    def column(n: str) -> Column:
        source = name.get(n, n)
        value = F.col(source) if source in have else F.lit(None).cast(kinds[n])
        return (F.coalesce(value, F.lit("unknown")) if n.startswith("parser") or n == "source_raw_artifact" else value).alias(n)

    rows = blocks.select("run_id", *map(column, HEADER), *(column(n) for n in _BLOCK), *(["page_count"] if "page_count" in have else []))
    if "page_count" in have:
        return rows.repartition("run_id")
    # the same exchange serves the count and the writer
    return rows.withColumn("page_count", (F.max("page_index").over(Window.partitionBy("run_id")) + 1).cast("int"))


def chunks(blocks: DataFrame, generation: int = 2, with_text: bool = True) -> DataFrame:
    """(run_id, part, chunk, sha256, n_chars, parser): each run's canonical text in parts; the last part has the hash and length of the whole, and the parser.

    ``blocks``: the block table of one or more runs, with HEADER's columns where known (parser fields are 'unknown' if
    null or missing), and page_count, width, height, source_raw_artifact, extraction_method and asset where known.  Null
    boxes are written as nulls.  Runs without blocks have no text; blocks of equal place are taken by block id.
    ``with_text`` False leaves the text out, for the hash alone.
    """
    rows = _prepared(blocks, generation).sortWithinPartitions("run_id", "page_index", "reading_order", "block_id")
    schema = pa.schema([("run_id", pa.int64()), ("part", pa.int32()), ("chunk", pa.string()), ("sha256", pa.string()), ("n_chars", pa.int64()), ("parser", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer: Writer | None = None
        key = number = None
        page: list[dict[str, Any]] = []
        held: list[str] = []
        digest, size, part, waiting = hashlib.sha256(), 0, 0, 0
        out: list[tuple[Any, ...]] = []

        def put(text: str) -> None:
            nonlocal size, part, waiting
            digest.update(text.encode())
            size += len(text)
            if with_text:
                held.append(text)
                waiting += len(text)
                if waiting > CHUNK:
                    out.append((key, part, "".join(held), None, None, None))
                    held.clear()
                    part, waiting = part + 1, 0

        def close() -> None:
            if writer is not None:
                put(writer.page(number, page))
                put(writer.end())
                out.append((key, part, "".join(held) if with_text else None, digest.hexdigest(), size, writer.run["parser"]))
                held.clear()

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)
            out.clear()
            return batch

        for batch in batches:
            for b in batch.to_pylist():
                if writer is None or b["run_id"] != key:
                    close()
                    if len(out) > 1000:
                        yield flush()
                    key, number, page, digest, size, part, waiting = b["run_id"], b["page_index"], [], hashlib.sha256(), 0, 0, 0
                    writer = Writer(b, generation)
                    put(writer.begin())
                elif b["page_index"] != number:
                    put(writer.page(number, page))
                    number, page = b["page_index"], []
                    if len(out) > 16:
                        yield flush()
                page.append(b)
        close()
        if out:
            yield flush()

    return rows.mapInArrow(run, "run_id bigint, part int, chunk string, sha256 string, n_chars bigint, parser string")


def identities(blocks: DataFrame, generation: int = 2) -> DataFrame:
    """(run_id, sha256, n_chars): the identity hash of each run's canonical document, and its length in characters."""
    return chunks(blocks, generation, with_text=False).select("run_id", "sha256", "n_chars")


def source_binding(outline: DataFrame, identity: DataFrame) -> DataFrame:
    """Outline rows with the hash of the canonical document they were made from (source_physical_ir_sha256)."""
    return outline.join(identity.select("run_id", F.col("sha256").alias("source_physical_ir_sha256")), "run_id", "left")


def stale(outline: DataFrame, identity: DataFrame) -> DataFrame:
    """(run_id, rule_id): outlines bound to another document than the one at hand, or to none."""
    now = identity.select("run_id", F.col("sha256").alias("_now"))
    both = outline.select("run_id", "source_physical_ir_sha256").distinct().join(now, "run_id", "left")
    rule = F.when(F.col("_now").isNull(), "document_missing").when(~F.col("_now").eqNullSafe(F.col("source_physical_ir_sha256")), "source_sha256_differs")
    return both.select("run_id", rule.alias("rule_id")).where("rule_id is not null")
