import datetime
import json

import pytest

from docweave.plans import audits, evaluation, extraction

NOW = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """One version that only a tree has read, one that only a flat list has read."""
    d = tmp_path_factory.mktemp("tables")
    page = {"id": "/page/0/Page/0", "block_type": "Page", "bbox": [0, 0, 500, 500], "children": [{"id": "a", "block_type": "Text", "html": "<p>x</p>", "bbox": [0, 0, 250, 250]}]}
    table = {"id": "b", "block_type": "Table", "html": "<table><tr><td>1</td><td>2</td></tr></table>", "bbox": [0, 300, 250, 400]}
    page["children"] += [table, {"id": "g", "block_type": "TableGroup", "html": "", "bbox": [0, 300, 250, 400], "children": [table]}]
    rows = {
        "marker_trees": ([(1, 7, "d", "v1", NOW, json.dumps({"block_type": "Document", "children": [page]}))], "tree_id bigint, run_id bigint, document_id string, version_id string, ingested_at timestamp, raw_json string"),
        "mineru_items": ([(1, 8, "e", "v1", 0, 0, "text", "x", [0.0, 0.0, 500.0, 500.0], None, None, None, NOW)], "item_id bigint, run_id bigint, document_id string, version_id string, raw_index int, page_idx int, item_type string, item_text string, bbox array<double>, text_level int, table_body string, img_path string, ingested_at timestamp"),
        "ref_regions": ([(k, x, "v1", "1", 0, "r", 0, "text", (0.0, 0.0, 500.0, 500.0, "n"), None, NOW) for k, x in enumerate("de")], "region_row_id bigint, document_id string, version_id string, annotation_version string, page_index int, region_id string, reading_order int, kind string, bbox struct<x0:double,y0:double,x1:double,y1:double,coordinate_system:string>, heading_level int, created_at timestamp"),
        "parser_runs": ([(7, "d", "v1", "A" * 64, "Marker", None, " ", "success", 2.0, True), (8, "e", "v1", "b" * 64, "mineru", "3.4.5", "pipeline", "failed", 4.0, None)], "run_id bigint, document_id string, version_id string, input_sha256 string, parser string, parser_version string, backend string, run_status string, duration_seconds double, disable_ocr boolean"),
        "manifests": ([("d", "v1", "a" * 64), ("e", "v1", "c" * 64)], "document_id string, version_id string, sha256 string"),
    }
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(str(d / f"{name}.parquet"))
    return str(d)


def test_spatial_scores_both_parsers(spark, tables):
    assert {(r["run_id"], r["parser"], r["iou"]) for r in evaluation.iou_edges_all(spark, tables).collect()} == {(7, "marker", 1.0), (8, "mineru", 1.0)}
    assert {(r["run_id"], r["iou"]) for r in evaluation.iou_edges(spark, tables).collect()} == {(8, 1.0)}
    assert {(r["run_id"], r["parser"], r["tp"], r["fp"]) for r in evaluation.spatial_overall(spark, tables).collect()} == {(7, "marker", 1, 2), (8, "mineru", 1, 0)}
    assert {(r["parser"], r["category"], r["tp"], r["fp"]) for r in evaluation.category_prf(spark, tables).collect()} == {("marker", "text", 1, 0), ("marker", "table", 0, 1), ("marker", "unknown", 0, 1), ("mineru", "text", 1, 0)}
    assert sum(r["pairs"] for r in evaluation.confusion_long(spark, tables).collect()) == 2


def test_audits_cover_both_parsers(spark, tables):
    rows = lambda query, *columns: {tuple(r[c] for c in columns) for r in query(spark, tables).collect()}
    assert rows(extraction.block_summary_all, "run_id", "parser", "blocks", "tables") == {(7, "marker", 3, 1), (8, "mineru", 1, 0)}
    assert rows(extraction.canonical_identity, "run_id", "parser") == {(7, "marker"), (8, "mineru")}
    assert rows(extraction.run_throughput_all, "run_id", "parser", "pages_per_second") == {(7, "marker", 0.5), (8, "mineru", 0.25)}
    assert rows(extraction.table_shapes_all, "table_id", "row_count", "column_count", "cells") == {("marker/7/0/1", 1, 2, 2), ("marker/7/0/2/0", 1, 2, 2)}
    assert {"marker", "mineru"} == {p for p, in rows(extraction.kind_disposition_matrix_all, "parser")} == {p for p, in rows(extraction.kind_transitions_all, "parser")}
    assert extraction.block_checks_all(spark, tables).count() == extraction.page_checks_all(spark, tables).count() == 0


def test_runs_that_cannot_be_scored_and_conflicts(spark, tables):
    rows = lambda query, *columns: {tuple(r[c] for c in columns) for r in query(spark, tables).collect()}
    assert rows(evaluation.evaluation_problems, "run_id", "rule_id") == {(8, "source_sha256_differs")}
    assert rows(audits.run_provenance_conflicts, "run_id", "field") == {(7, "parser"), (7, "input_sha256"), (8, "input_sha256")}
    assert rows(audits.benchmark_runs, "run_id", "blocks", "pages_per_second") == {(7, 3, 0.5)} and rows(audits.ocr_agreement, "document_id", "value", "conflict") == {("d", True, False), ("e", None, False)}
    assert rows(audits.run_histograms, "parser", "measure", "value", "n") >= {("marker", "kind", "table", 1), ("mineru", "transition", "text>text", 1), ("marker", "raw_type", "TableGroup", 1)}
    assert audits.diagram_pages(spark, tables).count() == audits.provenance_variants(spark, tables).count() == audits.duplicate_rejections(spark, tables).where("grouping <> ''").count() == 0
    assert rows(extraction.outline_binding, "run_id", "nodes") == {(7, 1), (8, 1)} and extraction.canonical_determinism(spark, tables).count() == 0
