"""Line events with code point offsets, the exact partition check, and reconstruction."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are split together; bounds a worker's memory, changes no result.
BYTES_AT_ONCE = 1 << 24


def split_lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, order, start, line) of each line of some texts: slices after each line feed, which stays with its line.

    Array operations only, linear in the characters: pieces between line feeds, their lengths, and running sums that
    begin anew with each text.
    """
    pieces = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    bounds = pieces.offsets.to_numpy()
    flat = pieces.flatten()
    counts = np.diff(bounds)
    row = np.repeat(np.arange(counts.size), counts)
    order = np.arange(row.size) - np.repeat(bounds[:-1] - bounds[0], counts)
    fed = order < np.repeat(counts, counts) - 1  # followed by a line feed
    length = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64) + fed
    total = np.concatenate([[0], np.cumsum(length)])
    start = total[:-1] - np.repeat(total[bounds[:-1] - bounds[0]], counts)
    line = pc.binary_join_element_wise(flat, pc.if_else(pa.array(fed), "\n", ""), "")
    kept = length > 0
    return row[kept], order[kept], start[kept], line.filter(pa.array(kept))


def line_events(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """(keys, line_order, char_start, char_end, line): one row per line of each text, offsets in code points, half open.

    Null and empty texts give no rows; nothing is dropped, so the slices put together give the text; repeated keys are
    different texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(len(keys))), 0).to_numpy(zero_copy_only=False))
            first = 0
            while first < batch.num_rows:
                before = sizes[first - 1] if first else 0
                end = max(first + 1, int(np.searchsorted(sizes, before + BYTES_AT_ONCE, "right")))
                part = batch.slice(first, end - first)
                row, order, start, line = split_lines(part.column(len(keys)))
                width = pc.utf8_length(line).to_numpy(zero_copy_only=False)
                columns = [part.column(k).take(pa.array(row)) for k in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.int32()) for x in (order, start, start + width)), line], names=[*keys, "line_order", "char_start", "char_end", "line"])
                first = end

    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", line_order int, char_start int, char_end int, line string"
    return df.select(*keys, F.col(text).cast("string")).where(F.length(F.col(text)) > 0).mapInArrow(run, schema)


def partition_summary(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, lines, first_start, last_end, characters, gapless): whether slices tile each text from 0 on.

    Tiles without gap or overlap are those whose lengths add up to their extent with distinct starts, which one
    aggregation decides without a window.
    """
    width = F.col("char_end") - F.col("char_start")
    one = events.groupBy(*keys).agg(
        F.count("*").alias("lines"), F.min("char_start").cast("bigint").alias("first_start"), F.max("char_end").cast("bigint").alias("last_end"), F.sum(width).cast("bigint").alias("characters"),
        F.count_distinct("char_start").alias("_starts"),
    )
    return one.withColumn("gapless", (F.col("first_start") == 0) & (F.col("characters") == F.col("last_end")) & (F.col("_starts") == F.col("lines"))).drop("_starts")


def reconstruct(events: DataFrame, keys: Sequence[str], slice_: str = "line") -> DataFrame:
    """(keys, text): the slices of each text put together in order; a group is one text, bounded by its own length."""
    parts = F.array_sort(F.collect_list(F.struct("char_start", slice_)))
    return events.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p[slice_]), "").alias("text"))
