"""Subject areas of documents: training with gradients summed over partitions, and scoring of every document."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm import subject_model as sm
from docweave.sources.tables import checkpointed, spread

#: Labelled documents to learn from at most, taken by the hash of their id; the classifier's documented bound.
MAX_LABELLED = 1_500
#: Steps, and those before which sentences are assigned anew to their documents' subjects.
STEPS, REASSIGN = 48, (20, 30, 40)
RATE = 0.07
#: Chunks of each part; a step takes one chunk of every part in turn.
CHUNKS = 4
#: Labelled documents of a part at least; there are as many parts as the cluster has cores, if the labels are enough for them.
PART_DOCUMENTS = 32
ROWS_AT_ONCE = 256


def _pack(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as z:
        return {k: z[k] for k in z.files}


def _mapped(f: Callable[[int, dict[str, np.ndarray]], dict[str, np.ndarray]]):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_pack(f(p, _unpack(d))) for p, d in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["part", "chunk", "data"])

    return run


_PART_SCHEMA = "part int, chunk int, data binary"


def labelled_documents(documents: DataFrame, labels: DataFrame, key: str, text: str, code: str, codes: list[str], most: int = MAX_LABELLED) -> DataFrame:
    """(key, text, subjects as indexes into ``codes``) of at most ``most`` labelled documents.

    Codes count in any letter case and spacing; unknown and null codes, repeated rows and documents without text are passed over.
    """
    place = F.create_map(*(F.lit(x) for k, c in enumerate(codes) for x in (c, k)))
    clean = labels.select(F.col(key), F.try_element_at(place, F.lower(F.trim(F.col(code)))).alias("_k")).where("_k is not null")
    chosen = clean.groupBy(key).agg(F.sort_array(F.collect_set("_k")).alias("subjects")).orderBy(F.xxhash64(key), key).limit(most)
    return documents.select(key, text).where(F.length(F.trim(F.col(text))) > 0).join(F.broadcast(chosen), key)


def train(labelled: DataFrame, key: str, text: str, subjects: int, steps: int = STEPS) -> sm.Model | None:
    """The model after ``steps`` gradients, each summed over a chunk of every part; None if there is nothing to learn from.

    The features are written once to the checkpoint folder.  Every step sends the model out and gets one gradient a part,
    of the rows that the part touches; its size is bounded by the table, not by the data.
    """
    spark = labelled.sparkSession
    sc = spark.sparkContext

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[tuple[int, int, str, list[int]]] = []
        for b in batches:
            texts += zip(*(b.column(k).to_pylist() for k in range(4)), strict=True)
        for part, chunk in sorted({(p, c) for p, c, _, _ in texts}):
            own = [(t, labels) for p, c, t, labels in texts if (p, c) == (part, chunk)]
            split = [sm.sentences(t) for t, _ in own]
            labels = np.zeros((len(own), subjects), np.float32)
            for k, (_, some) in enumerate(own):
                labels[k, some] = 1
            documents = np.repeat(np.arange(len(own)), [len(s) for s in split])
            f = sm.training_features([s for ss in split for s in ss])
            targets, importance = sm.assign(np.zeros((documents.size, subjects), np.float32), documents, labels, True)
            data = _pack(f._asdict() | {"documents": documents, "labels": labels, "targets": targets, "importance": importance})
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([chunk], pa.int32()), pa.array([data], pa.binary())], names=["part", "chunk", "data"])

    number = max(1, min(sc.defaultParallelism, labelled.count() // PART_DOCUMENTS))
    chunk = F.pmod(F.xxhash64(key), F.lit(CHUNKS)).cast("int")  # what a step learns from does not depend on the number of parts
    dealt = labelled.select(F.pmod(F.xxhash64(key, F.lit(1)), F.lit(number)).cast("int").alias("part"), chunk.alias("chunk"), text, "subjects")
    # repartitionByRange puts each part in a task of its own; sorting makes sums come out the same every time
    parts = checkpointed(dealt.repartitionByRange(number, "part").sortWithinPartitions("part", "chunk", text).mapInArrow(features, _PART_SCHEMA))
    if not parts.limit(1).collect():
        return None
    model = sm.initial(subjects)
    optimiser = sm.Adam(model, RATE)

    def feature_of(d: dict[str, np.ndarray]) -> sm.Features:
        return sm.Features(*(d[k] for k in sm.Features._fields))

    for step in range(steps):
        sent = sc.broadcast(tuple(model))
        if step in REASSIGN:

            def again(_: int, d: dict[str, np.ndarray], sent: Any = sent) -> dict[str, np.ndarray]:
                targets, importance = sm.assign(sm.logits(feature_of(d), sm.Model(*sent.value))[:, :subjects], d["documents"], d["labels"], False)
                return d | {"targets": targets, "importance": importance}

            parts = checkpointed(parts.mapInArrow(_mapped(again), _PART_SCHEMA))

        def gradient(_: int, d: dict[str, np.ndarray], sent: Any = sent) -> dict[str, np.ndarray]:
            touched, rows, outputs, bias, loss = sm.gradient(feature_of(d), sm.Model(*sent.value), d["targets"], d["importance"])
            return {"touched": touched.astype(np.int32), "rows": rows, "outputs": outputs, "bias": bias, "loss": np.array(loss), "n": np.array(len(d["targets"]))}

        got = [_unpack(r["data"]) for r in sorted(parts.where(F.col("chunk") == step % CHUNKS).mapInArrow(_mapped(gradient), _PART_SCHEMA).collect(), key=lambda r: r["part"])]
        sent.destroy()
        n = sum(int(g["n"]) for g in got)
        if not n:
            continue
        total = [np.zeros_like(x) for x in model]
        for g in got:
            total[0][g["touched"]] += g["rows"]
            total[1] += g["outputs"]
            total[2] += g["bias"]
        model = optimiser.step([x / n for x in total])
    return model


def score(documents: DataFrame, key: str, text: str, model: sm.Model, codes: list[str], threshold: float = 0.0, share: float = 0.25) -> DataFrame:
    """(key, subject_code): each document's subjects; null, blank and purely formal texts have none.  The model's last output is the formal one.

    The per-row table that scoring needs has a fixed size (buckets x subjects) and is broadcast.
    """
    sent = documents.sparkSession.sparkContext.broadcast((tuple(model), codes, threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, names, least = sent.value
        scorer = sm.Scorer(sm.Model(*parts), least)
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(k, ROWS_AT_ONCE)
                found = scorer.subjects([sm.sentences(t) for t in part.column(1).to_pylist()], share)
                keys = part.column(0).to_pylist()
                pairs = [(key_, names[s]) for key_, ss in zip(keys, found, strict=True) for s in ss]
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], part.column(0).type), pa.array([p[1] for p in pairs], pa.string())], names=[key, "subject_code"])

    return documents.select(key, text).where(F.length(text) > 0).mapInArrow(run, f"`{key}` {dict(documents.dtypes)[key]}, subject_code string")


def subjects_of(documents: DataFrame, labels: DataFrame, subjects: DataFrame, key: str = "doc_id", text: str = "text", code: str = "subject_code") -> DataFrame:
    """(key, subject_code): the subject areas of every document, learned from the labelled ones.

    No labels or no subjects give no rows.  ``subjects`` is a list of at most 1,000 areas.
    """
    rows = subjects.select(F.lower(F.trim(F.col(code))).alias("c")).where("c is not null").distinct().limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("the list of subjects has over 1,000 entries")
    codes = sorted(r["c"] for r in rows)
    model = train(labelled_documents(documents, labels, key, text, code, codes), key, text, len(codes)) if codes else None
    if model is None:
        return documents.select(F.col(key), F.lit("").alias("subject_code")).where(F.lit(False))
    return score(spread(documents.select(key, text)), key, text, model, codes)
