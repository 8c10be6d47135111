"""Writers: canonical JSON with overwrite guards, evidence with file hashes, Markdown reports of small tables."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

PROTECTED = ("run.json", "stdout.log", "stderr.log", "artifact_manifest.json")
REPORT_ROWS = 10_000


class OverwriteError(ValueError):
    """The target would overwrite evidence."""


def guard(target: str | Path, raw_directory: str | Path, source: str | Path | None = None) -> Path:
    """The resolved target, unless it lies in the raw directory, is the source, or is a run's evidence."""
    out, raw = Path(target).resolve(), Path(raw_directory).resolve()
    if source is not None and out == Path(source).resolve():
        raise OverwriteError("target is the source artifact")
    if out == raw or raw in out.parents:
        raise OverwriteError("target is inside the raw directory")
    if out.parent == raw.parent and out.name in PROTECTED:
        raise OverwriteError(f"target is {out.name} of the run")
    return out


def publish(text: str, target: Path) -> str:
    """Write UTF-8 bytes with LF beside the target, then move it there at once; returns the SHA-256."""
    data = text.encode()
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(f".{target.name}.part")
    part.write_bytes(data)
    os.replace(part, target)
    return hashlib.sha256(data).hexdigest()


def write_canonical(chunks: DataFrame, target: str, raw_directory: str) -> DataFrame:
    """One file a run, ``<run_id>.json``, from the parts of canonical texts; (run_id, sha256, byte_size) of what was written.

    ``target`` is a folder that all executors share.  A file is written beside its place and moved there at once, so a
    task that runs again leaves the same file.  Nothing is written until the result is read.
    """
    guard(target, raw_directory)
    names = ["run_id", "sha256", "byte_size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Path(target).mkdir(parents=True, exist_ok=True)
        done: list[tuple[int, str, int]] = []
        key, file, digest = None, None, hashlib.sha256()

        def close() -> None:
            if file is not None:
                size = file.tell()
                file.close()
                os.replace(file.name, Path(target) / f"{key}.json")
                done.append((key, digest.hexdigest(), size))

        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if file is None or k != key:
                    close()
                    key, digest = k, hashlib.sha256()
                    file = open(Path(target) / f".{k}.{os.getpid()}.part", "wb")
                data = text.encode()
                digest.update(data)
                file.write(data)
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[n] for d in done], t) for n, t in enumerate((pa.int64(), pa.string(), pa.int64()))], names=names)

    parts = chunks.select("run_id", "part", "chunk").repartition("run_id").sortWithinPartitions("run_id", "part")
    return parts.mapInArrow(run, "run_id bigint, sha256 string, byte_size bigint")


def evidence_json(tables: dict[str, DataFrame]) -> str:
    """Report JSON with sorted keys of small result tables."""
    body = {name: _small(df) for name, df in tables.items()}
    return json.dumps(body, ensure_ascii=False, indent=2, sort_keys=True, allow_nan=False, default=str) + "\n"


def _small(df: DataFrame) -> list[dict[str, object]]:
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"a report table has over {REPORT_ROWS} rows; aggregate it first")
    return [r.asDict(recursive=True) for r in rows]


def markdown_table(df: DataFrame, columns: Sequence[str] | None = None) -> str:
    """A small result as a Markdown table; numbers to four places, missing values as N/A."""
    names = list(columns or df.columns)
    show = lambda v: "N/A" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"| {' | '.join(names)} |", f"|{'---|' * len(names)}"]
    lines += [f"| {' | '.join(show(r[n]) for n in names)} |" for r in sorted(_small(df), key=lambda r: [str(r[n]) for n in names])]
    return "\n".join(lines) + "\n"


def markdown_report(title: str, sections: dict[str, DataFrame]) -> str:
    """A Markdown report of small result tables, in the order given."""
    return "\n".join([f"# {title}\n", *(f"## {name}\n\n{markdown_table(df)}" for name, df in sections.items())])
