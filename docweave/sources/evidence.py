"""Evidence files of results: written with their digests, verified offline, and reports and run records beside them."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.sources import sinks

INDEX = "evidence_index.json"


def sha256_of(path: str | Path) -> tuple[str, int]:
    """(digest, size) of a file, read in pieces."""
    digest, size = hashlib.sha256(), 0
    with open(path, "rb") as f:
        while piece := f.read(1 << 20):
            digest.update(piece)
            size += len(piece)
    return digest.hexdigest(), size


def write_evidence(folder: str | Path, results: dict[str, dict[str, DataFrame]], reports: dict[str, str] | None = None) -> dict[str, str]:
    """Write each result (a name and its small tables) as sorted JSON, each report as Markdown, and an index of their digests.

    Returns the digests by file name.  Tables over the report limit are refused; files are replaced at once.
    """
    root = Path(folder)
    texts = {f"{name}.json": sinks.evidence_json(tables) for name, tables in results.items()} | {f"{name}.md": text for name, text in (reports or {}).items()}
    digests = {name: sinks.publish(text, root / name) for name, text in sorted(texts.items())}
    index = {"files": [{"path": name, "sha256": digest, "byte_size": len(texts[name].encode())} for name, digest in digests.items()]}
    sinks.publish(json.dumps(index, indent=2, sort_keys=True) + "\n", root / INDEX)
    return digests


def verify_evidence(folder: str | Path) -> list[tuple[str, str]]:
    """(file, problem) of evidence that is missing, or of another digest or size than the index says, or that the index does not list; empty if all is well."""
    root = Path(folder)
    index = json.loads((root / INDEX).read_text(encoding="utf-8"))
    listed = {e["path"]: e for e in index["files"]}
    problems = []
    for name, e in sorted(listed.items()):
        if not (root / name).is_file():
            problems.append((name, "missing"))
            continue
        digest, size = sha256_of(root / name)
        problems += [(name, "size")] * (size != e["byte_size"]) + [(name, "sha256")] * (digest != e["sha256"])
    found = {p.name for p in root.iterdir() if p.suffix in (".json", ".md")} - {INDEX}
    return problems + [(name, "not_listed") for name in sorted(found - set(listed))]


def verify_against(folder: str | Path, results: dict[str, dict[str, DataFrame]]) -> list[str]:
    """Names of results whose evidence differs from what they give now."""
    return [name for name, tables in sorted(results.items()) if not (p := Path(folder) / f"{name}.json").is_file() or p.read_text(encoding="utf-8") != sinks.evidence_json(tables)]


def run_record(raw_directory: str | Path, run: dict[str, Any], now: datetime | None = None) -> dict[str, Any]:
    """The record of a parser run with its artifacts (path, size, digest) in order of path; run.json and logs are not artifacts."""
    raw = Path(raw_directory)
    artifacts = []
    for path in sorted(p for p in raw.rglob("*") if p.is_file() and p.name not in sinks.PROTECTED):
        digest, size = sha256_of(path)
        artifacts.append({"relative_path": path.relative_to(raw).as_posix(), "byte_size": size, "sha256": digest})
    return {**run, "recorded_at": (now or datetime.now(UTC)).isoformat(), "artifacts": artifacts}


def write_run_record(raw_directory: str | Path, run: dict[str, Any], now: datetime | None = None) -> Path:
    """Write run.json and artifact_manifest.json beside a raw directory; an existing record is not overwritten."""
    raw = Path(raw_directory).resolve()
    target = raw.parent / "run.json"
    if target.exists():
        raise sinks.OverwriteError("the run has a record")
    record = run_record(raw, run, now)
    sinks.publish(json.dumps({"artifacts": record["artifacts"]}, ensure_ascii=False, indent=2) + "\n", raw.parent / "artifact_manifest.json")
    sinks.publish(json.dumps(record, ensure_ascii=False, indent=2) + "\n", target)
    return target


def catalog(spark: SparkSession, documents: dict[str, Sequence[str]], root: str = "data") -> DataFrame:
    """(document_id, parser, raw_directory, physical_path, structural_path): a fixed corpus, each document with the parsers that ran on it.

    Documents without parsers give no rows.
    """
    rows = [(doc, parser) for doc, parsers in sorted(documents.items()) for parser in parsers]
    frame = spark.createDataFrame(rows, "document_id string, parser string")
    at = lambda kind, ending: F.concat_ws("/", F.lit(root), F.lit(kind), F.col("document_id"), F.concat("parser", F.lit(ending)))
    return frame.select("document_id", "parser", at("raw", "/raw").alias("raw_directory"), at("physical_ir", ".v1.json").alias("physical_path"), at("structural_ir", ".v1.json").alias("structural_path"))


# ---------------------------------------------------------------- reports
def parser_report(name: str, runs: DataFrame, overall: DataFrame, categories: DataFrame) -> str:
    """One parser's runs and scores."""
    return sinks.markdown_report(f"Parser {name}", {"Runs": runs, "Scores": overall, "Categories": categories})


def corpus_report(coverage: DataFrame, benchmark: DataFrame, variants: DataFrame) -> str:
    """Which parsers ran on which versions, how fast, and where they ran in several variants."""
    return sinks.markdown_report("Corpus", {"Coverage": coverage, "Throughput": benchmark, "Several variants": variants})


def gap_report(problems: DataFrame, diagrams: DataFrame, tables: DataFrame) -> str:
    """What the block table cannot show: runs that cannot be scored, pages of pictures only, what table objects became."""
    return sinks.markdown_report("Gaps", {"Not to be scored": problems, "Pictures only": diagrams, "Table objects": tables})


def physical_report(kinds: DataFrame, transitions: DataFrame, violations: DataFrame, determinism: DataFrame) -> str:
    """Audit of the block table."""
    return sinks.markdown_report("Physical documents", {"Kinds": kinds, "Transitions": transitions, "Violations": violations, "Not deterministic": determinism})


def structural_report(nodes: DataFrame, edges: DataFrame, agreement: DataFrame, duplicates: DataFrame, diagnostics: DataFrame) -> str:
    """Scores and audits of the outlines."""
    return sinks.markdown_report("Outlines", {"Nodes": nodes, "Parent edges": edges, "Agreement": agreement, "Duplicates": duplicates, "Refused": diagnostics})
