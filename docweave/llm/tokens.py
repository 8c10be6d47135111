"""Spark operators over a public tokenizer: ids of whole texts, and their lengths in tokens."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.bpe import DEFAULT_VOCABULARY, encoder

#: Texts encoded together, by number and by characters; bounds a worker's memory, changes no result.
ROWS_AT_ONCE, CHARACTERS_AT_ONCE = 512, 1 << 22


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """(keys, texts) of a batch, a bounded amount at a time; a longer text is alone."""
    texts = batch.column(1).to_pylist()
    first = size = 0
    for k, text in enumerate(texts):
        more = len(text or "")
        if k > first and (k - first >= ROWS_AT_ONCE or size + more > CHARACTERS_AT_ONCE):
            yield batch.column(0).slice(first, k - first), texts[first:k]
            first, size = k, 0
        size += more
    if texts:
        yield batch.column(0).slice(first), texts[first:]


def token_ids(df: DataFrame, key: str, text: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, ids): the token ids of each text, without special tokens.

    Null and empty texts have the empty list.  Blank text has the ids of its white space.  Strings of special tokens in a
    text are ordinary text.  Repeated rows each get their ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_all
        for batch in batches:
            for keys, texts in _parts(batch):
                ids, offsets = encode(texts)
                yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))], names=[key, "ids"])

    return df.select(key, F.col(text).cast("string")).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, ids array<int>")


def token_counts(df: DataFrame, key: str, text: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, tokens): the length of each text in tokens; 0 for null and empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(vocabulary).counts
        for batch in batches:
            for keys, texts in _parts(batch):
                yield pa.RecordBatch.from_arrays([keys, pa.array(count(texts), pa.int64())], names=[key, "tokens"])

    return df.select(key, F.col(text).cast("string")).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, tokens bigint")
