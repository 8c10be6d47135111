import base64
import hashlib
import itertools
import json
import os
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from docweave.__main__ import main as docweave_main
from docweave.operators import assets, audit, canonical, checks, html_text, physical, spatial, structural
from docweave.sources import evidence, raw, settings, sinks


@pytest.mark.parametrize(
    ("source", "shape"),
    [
        ("<table><tr><td colspan='3'>x</td></tr><tr><th>1</th><td rowspan='2'>2</td><td>3</td></tr><tr><td>4</td><td>5</td></tr></table>", (3, 3, 6)),
        ("<p>x</p><table> y </table>", (0, 0, 0)),
        ("<table><tr><td>x</td><td rowspan='3'>y</td></tr><tr></tr><tr></tr></table>", (3, 2, 2)),
        ("<table><tr><td rowspan>x</td></tr><tr><td colspan='2'>y</td></tr></table>", (2, 2, 2)),
        ("<table><tr><td>x</td><td rowspan='2'>y</td></tr><tr><td colspan='2'>z</td></tr></table>", (2, 4, 3)),
    ],
)
def test_grids(source, shape):
    g = html_text.table_grid(source)
    assert (g.row_count, g.column_count, len(g.cells)) == shape


CELL = "<table><tr><td{}>x</td></tr></table>"


@pytest.mark.parametrize("source", [*(CELL.format(f" {a}='{v}'") for a in ("rowspan", "colspan") for v in ("-1", "0", "", " ", "1.5")), CELL.format(" rowspan='2'"), CELL.format("") * 2, CELL.format("")[:-8], "</table>" + CELL.format(""), CELL.format("><table></table><b"), "<table><tr><tr></tr></table>", "<table><th>x</th></table>", "<table></td></table>"])
def test_bad_grids(source):
    with pytest.raises(html_text.HtmlError):
        html_text.table_grid(source)


def test_cell_text_and_no_table():
    assert html_text.table_grid(CELL.format("").replace("x", "\n một \t hai<br/><br>\n<b>ba</b> &lt;"))[2][0].text == "một hai\n\nba <"
    assert html_text.table_grid("<p>x</p>") is None and html_text.table_grid(None) is None and html_text.table_grid("") is None


def test_table_cells(spark):
    df = spark.createDataFrame([(1, "<table><tr><td>a</td><td>b</td></tr></table>", 1), (2, "<table><tr><td>", 1), (3, None, 1), (4, "x", 1), (5, "<table></table>", 1)], "k bigint, html string, row_count int")
    cells = html_text.table_cells(df, "k", "html").cache()
    assert sorted((r["k"], r["grid_ok"], r["cell_text"]) for r in cells.where("k <> 5 and k <> 2").collect()) == [(1, True, "a"), (1, True, "b")]
    assert cells.where("not grid_ok").select("k").collect()[0]["k"] == 2 and html_text.grid_overlaps(cells, "k").count() == 0
    doubled = cells.union(cells)
    assert html_text.grid_overlaps(doubled, "k").count() == 2
    assert html_text.table_cells(df.limit(0), "k", "html").count() == 0
    assert audit.row_spans(cells, "k").count() == 2


def test_visible_text_and_references():
    assert html_text.visible_text("<table><tr><td>a</td><th>b</th></tr></table><dl><dt>c</dt><dd>d</dd></dl><h4>e</h4>f<br>g  &gt;\u2028h") == "a\nb\ncde\nf\ng >\nh"
    assert html_text.visible_text("<script>x<b>y</script>") == "x<b>y"
    assert html_text.visible_text(None) == "" and html_text.heading_level("<!-- <h2> --><p><H3 class='a'>x</h3><h1>y</h1>") == 3 and html_text.heading_level("") is None
    child = {"id": "c", "html": "<li>in</li>"}
    refer = "<content-ref src='{}'></content-ref>"
    assert html_text.expand_references({"id": "p", "html": "<ul>" + refer.format("c") + "</ul>", "children": [child]}) == "<ul><li>in</li></ul>"
    for stays in ("<content-ref src='c'/>", "<content-ref src='c'> </content-ref>"):
        assert html_text.expand_references({"id": "p", "html": stays, "children": [child]}) == stays
    for bad in ({"id": "p", "html": refer.format("z"), "children": []}, {"id": "p", "html": "", "children": [child, child]}, {"id": "p", "html": refer.format("p"), "children": []}):
        with pytest.raises(html_text.HtmlError):
            html_text.expand_references(bad)


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, run_id bigint, document_id string, version_id string, raw_index int, page_idx int, item_type string, item_text string, bbox array<double>, text_level int, table_body string, img_path string, ingested_at timestamp, kind string")


def test_list_blocks(spark):
    from datetime import datetime

    t, later = datetime(2024, 1, 1), datetime(2024, 2, 1)
    box = [1.0, 2.0, 3.0, 4.0]
    df = items(spark, [
        (1, 1, "d", "v1", 0, 0, "text", " A ", box, 1, None, None, t, "x"), (2, 1, "d", "v1", 1, 0, "text", "old", box, None, None, None, t, "x"), (3, 1, "d", "v1", 1, 0, "text", "new", box, None, None, None, later, "x"),
        (4, 1, "d", "v1", 2, 1, "table", None, None, None, "<table></table>", None, t, "x"), (5, 1, "d", "v1", 3, 1, "page_number", "2", box, None, None, None, t, "x"), (6, 2, "e", None, 0, 0, None, None, None, None, None, None, None, None),
    ])
    got = {(r["run_id"], r["raw_index"]): r for r in physical.list_blocks(df).collect()}
    assert len(got) == 5 and got[1, 1]["text"] == "new" and got[1, 0]["kind"] == "title" and got[1, 0]["text"] == "A" and got[1, 0]["heading_level"] == 1
    assert (got[1, 2]["kind_v0"], got[1, 2]["kind"], got[1, 2]["disposition"], got[1, 2]["x0"]) == ("unknown", "table", "content", None)
    assert got[1, 3]["block_id"] == "d_v1_p0001_b0001" and got[1, 3]["disposition"] == "discarded" and got[2, 0]["kind"] == "unknown"
    assert physical.list_blocks(df.limit(0)).count() == 0
    again = physical.list_blocks(df.union(df))
    assert again.count() == 5 and checks.page_violations(again).count() == 0
    a, b = (canonical.identities(physical.list_blocks(x)) for x in (df, df.repartition(3)))
    assert audit.same_twice(a, b, "run_id", "sha256").count() == 0


def test_tree_blocks(spark):
    from datetime import datetime

    page = {"id": "/page/0/Page/1", "block_type": "Page", "bbox": [10, 20, 210, 420], "children": [{"id": "t", "block_type": "Text", "html": "<p>A<br>b</p>", "bbox": [30, 60, 110, 220]}, {"id": "l", "block_type": "ListGroup", "html": "<ul><content-ref src='i'></content-ref></ul>", "bbox": None, "children": [{"id": "i", "block_type": "ListItem", "html": "<li>x</li>"}]}]}
    df = spark.createDataFrame([(1, 1, "d", "v1", None, json.dumps({"block_type": "Document", "children": [page]})), (2, 2, "d", "v1", None, "{"), (3, 3, None, None, None, None)], "tree_id bigint, run_id bigint, document_id string, version_id string, ingested_at timestamp, raw_json string")
    a, b = physical.tree_blocks(df).orderBy("reading_order").collect()
    assert (a["text"], a["x0"], a["y0"], a["x1"], a["y1"]) == ("A\nb", 100.0, 100.0, 500.0, 500.0)
    assert (a["problem"], b["text"], b["x0"], b["kind"], b["problem"]) == (None, "x", None, "unknown", "box")
    for wrong, why in (({"id": "/page/1/Page/1"}, "page id"), ({"id": None}, "page id"), ({"bbox": [10, 20, 10, 420]}, "page box")):
        bad = spark.createDataFrame([(1, 1, "d", "v1", None, json.dumps({"children": [page | wrong]}))], df.schema)
        assert [r["problem"] for r in physical.tree_blocks(bad).collect()] == [why] * 2
    later = df.union(spark.createDataFrame([(9, 1, "d", "v1", datetime(2024, 1, 1), json.dumps({"children": [page, page]}))] * 2, df.schema))
    assert physical.tree_blocks(later).count() == 4


# A published flat list and the digest of its canonical document in the first form.
PUBLISHED_LIST = [
    ("header", "ỦY BAN NHÂN DÂN THÀNH PHỐ HÀ NỘI", [184, 64, 401, 102], None, 0), ("text", "QUYẾT ĐỊNH", [242, 229, 816, 252], 1, 0), ("text", "Số: /QĐ-UBND", [189, 123, 396, 142], None, 0), ("page_number", "1", [500, 950, 520, 970], None, 0),
    ("text", "Điều 1. Quy định chung", [100, 150, 600, 180], 2, 1), ("text", "Nội dung điều 1 thi hành quy hoạch tổng thể.", [100, 200, 700, 250], None, 1), ("page_number", "2", [500, 950, 520, 970], None, 1),
]
PUBLISHED_DIGEST = "9dccdb5baf6a918619fca79645b23d67bd749a85fe84c9cd609d3656a457efd0"


def test_canonical_text(spark, tmp_path):
    rows = [(k, 1, "test-document", "v1", k, page, kind, text, [float(x) for x in box], level, None, None, None, "x") for k, (kind, text, box, level, page) in enumerate(PUBLISHED_LIST)]
    head = {"source_artifact_sha256": hashlib.sha256(b"source").hexdigest(), "parser": "mineru", "parser_version": "3.4.5", "parser_backend": "pipeline", "source_raw_artifact": "sample_content_list.json"}
    blocks = physical.list_blocks(items(spark, rows)).withColumns({**{k: F.lit(v) for k, v in head.items()}, "width": F.lit(595.0), "height": F.lit(841.0)})
    assert [(r["run_id"], r["sha256"]) for r in canonical.identities(blocks, 1).collect()] == [(1, PUBLISHED_DIGEST)]
    chunks = canonical.chunks(blocks, 1).cache()
    written = sinks.write_canonical(chunks, str(tmp_path / "out"), str(tmp_path / "raw")).collect()
    data = (tmp_path / "out" / "1.json").read_bytes()
    assert [(r["sha256"], r["byte_size"]) for r in written] == [(PUBLISHED_DIGEST, len(data))] and hashlib.sha256(data).hexdigest() == PUBLISHED_DIGEST and os.listdir(tmp_path / "out") == ["1.json"]
    whole = json.loads(data)
    assert canonical.canonical_json(whole).encode() == data and [len(p["blocks"]) for p in whole["pages"]] == [4, 3]
    outline_row = spark.createDataFrame([(1, 5), (2, 1)], "run_id bigint, nodes int")
    bound = canonical.source_binding(outline_row, canonical.identities(blocks, 1))
    assert {r["run_id"]: r["rule_id"] for r in canonical.stale(bound, canonical.identities(blocks, 2)).collect()} == {1: "source_sha256_differs", 2: "document_missing"}


def test_canonical_second_form_and_empty_pages(spark):
    table = "<table><tr><td colspan='2'>đ</td></tr></table>"
    rows = [(1, 7, "d", None, 0, 2, "table", None, None, None, table, None, None, "x"), (2, 7, "d", None, 1, 4, "image", "x", [0.0, 1.0, 2.0, 3.0], None, None, "a.png", None, "x"), (3, 8, "e", "v1", 0, 0, "text", "a\n\"b\"", None, 2, None, None, None, "x")]
    chunks = canonical.chunks(physical.list_blocks(items(spark, rows)).withColumn("parser", F.lit(None).cast("string"))).collect()
    texts = {r["run_id"]: r["chunk"] for r in chunks}
    first, second = json.loads(texts[7]), json.loads(texts[8])
    assert all(canonical.canonical_json(json.loads(t)) == t for t in texts.values()) and {r["run_id"]: r["n_chars"] for r in chunks} == {k: len(t) for k, t in texts.items()}
    assert [len(p["blocks"]) for p in first["pages"]] == [0, 0, 1, 0, 1] and first["parser"] == "unknown" and first["version_id"] is None and first["page_count"] == 5
    assert first["pages"][2]["blocks"][0]["table_structure"] == {"row_count": 1, "column_count": 2, "cells": [{"row_start": 0, "column_start": 0, "row_span": 1, "column_span": 2, "text": "đ", "is_header": False}]}
    assert first["pages"][4]["blocks"][0]["visual_asset"]["storage_kind"] == "unavailable" and second["pages"][0]["blocks"][0]["text_extraction"] == {"method": "unknown", "confidence": None}
    assert canonical.chunks(physical.list_blocks(items(spark, rows)).limit(0)).count() == 0


def test_assets(spark):
    png = base64.b64encode(b"\x89PNG\r\n\x1a\n12").decode()
    got = {r["k"]: r for r in assets.embedded(spark.createDataFrame([(1, png, 0), (2, "", 0), (3, "AAA", 0), (4, "QUJD", 0), (5, None, 0)], "k int, image string, asset int"), ["k"], "image").collect()}
    assert (got[1]["asset"]["media_type"], got[1]["asset"]["byte_size"], got[1]["asset"]["sha256"]) == ("image/png", 10, hashlib.sha256(b"\x89PNG\r\n\x1a\n12").hexdigest())
    assert [got[k]["problem"] for k in (1, 2, 3, 4, 5)] == [None, "empty", "not_base64", "unknown_signature", None] and got[5]["asset"]["storage_kind"] == "unavailable"
    rows = [(1, "images/a.gif", "src/auto"), (2, "../a.gif", "src"), (3, "none.png", "src"), (4, "empty.png", "src/."), (5, None, "src"), (6, "a.txt", "")]
    files = spark.createDataFrame([("src/auto/images/a.gif", bytearray(b"GIF89a..")), ("./src/empty.png", bytearray(b"")), ("a.txt", bytearray(b"text"))], "file_path string, content binary")
    found = assets.relative(spark.createDataFrame(rows, "k int, path string, directory string"), ["k"], "path", "directory", files).cache()
    out = {r["k"]: r for r in found.collect()}
    assert {k: r["problem"] for k, r in out.items()} == {1: None, 2: "unsafe_path", 3: None, 4: "empty_file", 5: None, 6: None}
    assert (out[1]["asset"]["relative_path"], out[1]["asset"]["media_type"], out[1]["asset"]["byte_size"]) == ("src/auto/images/a.gif", "image/gif", 8) and out[6]["asset"]["media_type"] is None and out[3]["asset"]["storage_kind"] == "unavailable"
    assert assets.contract_violations(found, ["k"]).count() == 0
    broken = found.where("k = 1").withColumn("asset", F.struct(F.lit("embedded_raw").alias("storage_kind"), F.lit("p").alias("relative_path"), F.lit(None).cast("string").alias("media_type"), F.lit("s").alias("sha256"), F.lit(1).cast("bigint").alias("byte_size")))
    assert [r["rule_id"] for r in assets.contract_violations(broken, ["k"]).collect()] == ["embedded_with_path"]


def test_assignment_against_brute_force():
    def best(edges):
        top = (0, 0.0)
        for n in range(len(edges) + 1):
            for some in itertools.combinations(edges, n):
                if len({a for a, _, _ in some}) == n == len({b for _, b, _ in some}):
                    top = max(top, (n, sum(w for *_, w in some)))
        return top

    random.seed(7)
    for _ in range(200):
        edges = [(a, b, random.random()) for a in range(3) for b in range(3) if random.random() < 0.6]
        got = spatial.best_assignment(edges)
        assert len(got) == best(edges)[0] and abs(sum(w for *_, w in got) - best(edges)[1]) < 1e-12
    assert spatial.best_assignment([(0, 0, 0.50010), (0, 1, 0.50004), (1, 0, 0.50012), (1, 1, 0.50001)]) == [(0, 1, 0.50004), (1, 0, 0.50012)]
    assert spatial.best_assignment([]) == [] and spatial.best_assignment([(0, 0, 0.5), (1, 1, 0.5), (0, 1, 0.5), (1, 0, 0.5)]) == spatial.best_assignment([(1, 0, 0.5), (0, 1, 0.5), (1, 1, 0.5), (0, 0, 0.5)])


BOXES = "page int, id string, `order` int, kind string, x0 double, y0 double, x1 double, y1 double"


def test_spatial(spark):
    r = spark.createDataFrame([(0, "A", 0, "heading", 0.0, 0.0, 100.0, 100.0), (0, "B", 1, "text", 40.0, 0.0, 140.0, 100.0), (0, "C", 2, "text", None, None, None, None)], BOXES)
    p = spark.createDataFrame([(0, "X", 1, "text", 10.0, 0.0, 110.0, 100.0), (0, "Y", 0, "title", 0.0, 0.0, 70.0, 100.0), (1, "Z", 0, "text", 0.0, 0.0, 1.0, 1.0)], BOXES)
    m = spatial.matches(spatial.candidate_edges(r, p, ["page"]), ["page"]).cache()
    assert {(x["ref_id"], x["pred_id"]) for x in m.collect()} == {("A", "Y"), ("B", "X")}
    one = spatial.overall(r.withColumn("d", F.lit(1)), p.withColumn("d", F.lit(1)), m.withColumn("d", F.lit(1)), ["d"]).collect()[0]
    assert (one["tp"], one["fp"], one["fn"]) == (2, 1, 1) and abs(one["f1"] - 2 / 3) < 1e-9
    assert spatial.matches(spatial.candidate_edges(r.limit(0), p, ["page"]), ["page"]).count() == 0
    pairs = spark.createDataFrame([("text", "text"), ("text", "unknown")], "ref_category string, pred_category string")
    none = spark.createDataFrame([("table",)], "category string")
    assert {(x["ref_category"], x["pred_category"]): x["pairs"] for x in spatial.confusion(pairs, none, none.limit(0)).collect()}["text", "unknown"] == 1
    assert {x["category"]: (x["tp"], x["fp"], x["fn"]) for x in spatial.per_category(pairs, none, none.limit(0)).collect()} == {"text": (1, 0, 1), "unknown": (0, 1, 0), "table": (0, 0, 1)}
    order = spark.createDataFrame([(1, 0, 0), (1, 1, 2), (1, 2, 1), (2, 0, 0)], "d int, ref_rank int, pred_order int")
    assert [(x["d"], x["comparable"], x["concordant"]) for x in spatial.order_accuracy(order, ["d"]).collect()] == [(1, 3, 2)]


NODES = "d int, page_index int, kind string, ordinal_key string, id string, path string, parent_path string, title string"


def test_structural(spark):
    r = spark.createDataFrame([(1, 0, "article", "1", "r1", "article:1", "document", "A  b"), (1, 0, "clause", "1", "r2", "article:1/clause:1", "article:1", None), (1, 0, "clause", "1", "r3", "article:2/clause:1", "article:2", None), (1, 0, "appendix", None, "r4", "appendix:unnumbered", "document", None), (1, 0, "point", "a", "r5", "x/point:a", "x", None)], NODES)
    p = spark.createDataFrame([(1, 0, "article", "1", "p1", "chapter:1/article:1", "chapter:1", "a B"), (1, 0, "clause", "1", "p2", "article:1/clause:1", "article:1", None), (1, 0, "clause", "1", "p3", "q/clause:1", "article:2", None), (1, 0, "appendix", None, "p4", "appendix:unnumbered", "document", None), (1, 1, "point", "a", "p5", "x/point:a", "x", None)], NODES)
    scored_r, scored_p = structural.in_scope(r.withColumn("scored", F.lit(None).cast("boolean")), p, ["d"])
    m = structural.match(scored_r, scored_p, ["d"]).cache()
    assert {(x["ref_id"], x["pred_id"]) for x in m.collect()} == {("r1", "p1"), ("r2", "p2"), ("r3", "p3"), ("r4", "p4")}
    pairs = {x["ref_id"]: x for x in structural.compare(scored_r, scored_p, m, ["d"]).collect()}
    assert (pairs["r1"]["path_exact"], pairs["r1"]["parent_exact"], pairs["r1"]["title_exact"], pairs["r2"]["title_exact"]) == (False, False, True, None)
    assert [(x["side"], x["kind"]) for x in structural.traces(scored_r, scored_p, m, ["d"]).collect()] == [("missed", "point")]
    total = structural.node_metrics(scored_r, scored_p, m, ["d"]).collect()[0]
    assert (total["tp"], total["fp"], total["fn"]) == (4, 0, 1)
    j = {x["scope"]: x["jaccard"] for x in structural.agreement(r, p, ["d"]).collect()}
    assert abs(j["all"] - 3 / 7) < 1e-9


def test_edges_count_unmatched_nodes(spark):
    r = spark.createDataFrame([(1, 0, "article", "1", "r1", "a", "document", None), (1, 0, "article", "2", "r2", "b", "document", None), (1, 0, "article", "3", "r3", "c", "document", None)], NODES)
    p = spark.createDataFrame([(1, 0, "article", "1", "p1", "a", "document", None), (1, 0, "article", "2", "p2", "x/b", "x", None), (1, 0, "article", "4", "p4", "d", "document", None), (1, 0, "article", "5", "p5", "e", "document", None)], NODES)
    one = structural.edge_metrics(r, p, structural.compare(r, p, structural.match(r, p, ["d"]), ["d"]), ["d"]).collect()[0]
    assert (one["tp"], one["fp"], one["fn"]) == (1, 3, 2)


def test_reference_rules(spark):
    schema = "node_row_id bigint, document_id string, version_id string, annotation_version string, page_index int, reference_record_id string, reference_instance_id string, parent_reference_instance_id string, kind string, ordinal_key string, canonical_path string, parent_canonical_path string, scored boolean"
    row = lambda k, record, instance, parent, kind, path, above, scored=True, page=0: (k, "d", "v1", "4", page, record, instance, parent, kind, "1", path, above, scored)
    good = [row(1, "n1", "i1", None, "article", "a", "document"), row(2, "n2", "i2", "i1", "clause", "a/c", "a"), row(3, "n2", "i2", "i1", "clause", "a/c", "a"), row(4, "n3", "i2", "i1", "clause", "a/c", "a", False)]
    assert checks.reference_node_violations(spark.createDataFrame(good, schema)).count() == 0
    bad = [*good, row(5, "n1", "i5", None, "article", "e", "document"), row(6, "n6", "i2", "i1", "clause", "a/c", "a"), row(7, "n7", "i7", "i1", "point", "a/p", "a"), row(8, "n8", "i8", None, "clause", "c", "document")]
    assert {(r["reference_instance_id"], r["rule_id"]) for r in checks.reference_node_violations(spark.createDataFrame(bad, schema)).collect()} == {("i1", "record_id_repeated"), ("i2", "scored_instance_repeated"), ("i7", "parent_kind"), ("i8", "parent_kind")}


def test_titles_are_what_their_anchors_hold(spark):
    blocks = spark.createDataFrame([(1, "b", "Điều 1. Phạm  vi\u00a0ﬁnal")], "k int, block_id string, text string")
    anchors = spark.createDataFrame([(1, 0, "n", "marker", "b", 0, 7), (1, 1, "n", "title", "b", 7, 21)], "k int, sequence int, node_id string, role string, block_id string, char_start int, char_end int")
    of = lambda title: [r["rule_id"] for r in checks.evidence_violations(blocks, spark.createDataFrame([(1, "n", "article", "Điều 1.", title)], "k int, node_id string, kind string, marker_text string, title string"), anchors, "k").collect()]
    assert of("Phạm vi final") == [] and of("Phạm") == ["title_text_differs"]


def test_cycles(spark):
    e = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "c", "a"), (1, "d", "a"), (1, "a", "w"), (1, "w", "x"), (1, "x", "y"), (1, "y", "x"), (1, "c", "b"), (2, "a", "b"), (2, "b", None), (3, "s", "s")], "g int, c string, p string")
    assert {(r["g"], r["c"]) for r in checks.cycles(e, ["g"], "c", "p").collect()} == {(1, "a"), (1, "b"), (1, "c"), (1, "x"), (1, "y"), (3, "s")}
    assert checks.cycles(e.limit(0), ["g"], "c", "p").count() == 0


def rules(found):
    return {r["rule_id"] for r in found.collect()}


def test_every_rule_finds_its_planted_case(spark):
    blocks = "run_id int, page_index int, reading_order int, block_id string"
    assert rules(checks.page_violations(spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 2, "b"), (2, 0, 0, "a"), (2, 0, 1, "a"), (3, 0, 0, "x"), (3, 0, 1, "y")], blocks))) == {"reading_order_not_contiguous", "block_id_repeated"}
    assert sorted(r["run_id"] for r in checks.document_violations(spark.createDataFrame([(1, 1, 0, "a"), (2, 0, 0, "a"), (2, 2, 0, "b"), (3, 0, 0, "c")], blocks)).collect()) == [1, 2]
    anchors = spark.createDataFrame([(1, "n", "b", "object", 0, None), (1, "n", "b", "body", None, 3), (1, "n", "b", "body", 3, 3), (1, "n", "b", "body", 0, 3)], "k int, node_id string, block_id string, role string, char_start int, char_end int")
    assert [r["rule_id"] for r in checks.anchor_violations(anchors, "k").collect()] == ["object_with_offsets", "text_without_span", "text_without_span"]
    nodes = "k int, sequence int, node_id string, kind string, method string, parent_id string, depth int, ordinal_raw string, ordinal_key string, marker_text string, title string, path string"
    root = (1, 0, "r", "document", "document_root", None, 0, None, None, None, None, "document")
    good = [root, (1, 1, "a", "article", "explicit_legal_marker", "r", 1, "1", "1", "Điều 1.", None, "article:1"), (1, 2, "c", "clause", "contextual_clause", "a", 2, "2", "2", "2.", None, "article:1/clause:2")]
    frame = lambda *rows: spark.createDataFrame([*good, *rows], nodes)
    assert checks.node_violations(frame(), "k").count() == 0 == checks.hierarchy_violations(frame(), "k").count()
    bad = [(1, 3, "d", "article", "explicit_legal_marker", "c", 1, "I", "1", None, None, "article:9"), (1, 4, "e", "part", "explicit_legal_marker", "z", 1, "2", None, "x", None, "part:2"), (1, 0, "f", "clause", "contextual_clause", "a", 2, "2", "2", "2.", None, "article:1/clause:2"), (2, 0, "g", "document", "document_root", None, 0, "1", None, None, None, "document")]
    assert rules(checks.node_violations(frame(*bad), "k")) == {"root_with_marker", "node_without_marker", "raw_without_key", "key_not_recomputed", "path_segment"}
    assert rules(checks.hierarchy_violations(frame(*bad), "k")) == {"parent_missing", "parent_not_earlier", "depth_not_parent_plus_one", "parent_kind", "path_not_extending", "path_repeated"}
    text = spark.createDataFrame([(1, "a", 0, "content", "abc"), (1, "b", 0, "content", "abc"), (1, "c", 0, "content", ""), (1, "d", 0, "discarded", "abc"), (1, "f", 0, "content", "abc")], "k int, block_id string, page_index int, disposition string, text string")
    spans = [(1, "a", 0, "body", 0, 2), (1, "a", 0, "body", 2, 3), (1, "b", 0, "body", 0, 2), (1, "d", 0, "body", 0, 3), (1, "e", 0, "body", 0, 3), (1, "f", 1, "body", 0, 3)]
    partition = checks.anchor_partition(text, spark.createDataFrame(spans, "k int, block_id string, page_index int, role string, char_start int, char_end int"), "k")
    assert {(r["block_id"], r["rule_id"]) for r in partition.collect()} == {("b", "text_not_covered"), ("c", "empty_block_not_owned_once"), ("d", "anchor_on_other_block"), ("e", "anchor_on_unknown_block"), ("f", "anchor_on_other_page")}
    manifest = {"manifest_row_id": 1, "landing_page_url": "https://a/x", "asset_url": "https://a/y", "artifact_filename": "a.pdf", "sha256": "0" * 64, "byte_size": 1, "document_id": "a-1", "version_id": "v1", "issued_on": date(2024, 1, 2), "effective_on": None}
    wrong = {"landing_page_url": "http://a", "asset_url": None, "artifact_filename": "a/b", "sha256": "x", "byte_size": 0, "document_id": "A", "version_id": "1", "effective_on": date(2024, 1, 1)}
    schema = "manifest_row_id int, landing_page_url string, asset_url string, artifact_filename string, sha256 string, byte_size int, document_id string, version_id string, issued_on date, effective_on date"
    of = lambda *changes: rules(checks.manifest_violations(spark.createDataFrame([tuple((manifest | c).values()) for c in changes], schema)))
    assert of({}) == set() and of(wrong, {"asset_url": "https://a/x"}) == {"landing_page_not_https", "asset_not_https", "addresses_equal", "file_name_not_plain", "sha256_malformed", "size_not_positive", "document_id_malformed", "version_id_malformed", "effective_before_issue"}
    assert of() == set()


def test_strict_mode(spark):
    with pytest.raises(checks.IntegrityError):
        checks.require(checks.violations(spark.createDataFrame([(1,)], "k int"), ["k"], {"bad": F.col("k") == 1}))


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.json").write_text(json.dumps({"block_type": "Document", "children": []}, indent=1))
    (tmp_path / "a" / "x_meta.json").write_text(json.dumps({"page_stats": [{"page_id": 0, "text_extraction_method": "PDFText "}]}))
    (tmp_path / "a" / "b_content_list.json").write_text(json.dumps([{"type": "text"}, 3]))
    (tmp_path / "a" / "bad.json").write_text("{")
    files = raw.json_files(spark, str(tmp_path))
    one, several = raw.document_trees(files)
    assert one.count() == 1 and several.count() == 0
    assert [r["is_object"] for r in raw.content_list(files).orderBy("raw_index").collect()] == [True, False]
    assert [r["method"] for r in raw.page_methods(files).collect()] == ["pdftext"]
    inventory = raw.artifact_inventory(spark, str(tmp_path)).cache()
    assert {r["artifact_kind"] for r in inventory.collect()} == {"document_tree", "metadata", "content_list"}
    wrong = inventory.select("path", (F.col("byte_size") + 1).alias("byte_size"), F.upper("sha256").alias("sha256"))
    assert {r["problem"] for r in raw.verify_artifacts(wrong, inventory).collect()} == {"size"}
    v = spark.createDataFrame([("1",), ("2",), ("true",), ('"1"',), ("3",)], "v string").select(F.try_parse_json(F.concat(F.lit('{"physical_ir_version": '), "v", F.lit("}"))).alias("tree"))
    assert [x.count() for x in raw.dispatch_by_version(v)] == [1, 1, 3]


def test_manifests(spark, tmp_path):
    pytest.importorskip("yaml")
    good = "document: {id: a, document_number: 1, title: T, document_type: x, issuer: y}\nversion: {id: v1, document_id: a, issued_on: 2024-01-02, effective_on: null}\nsource: {source_type: s, publisher: p, landing_page_url: u, asset_url: w, retrieved_at: z}\nartifact: {filename: f.pdf, media_type: m, byte_size: 3, sha256: q}\n"
    (tmp_path / "good.yaml").write_text(good)
    (tmp_path / "other.yaml").write_text(good.replace("document_id: a", "document_id: b"))
    (tmp_path / "schema.yaml").write_text("document: {}\n")
    (tmp_path / "broken.yaml").write_text("a: [")
    got = {r["path"].rsplit("/", 1)[1]: r for r in raw.manifests(spark, str(tmp_path)).collect()}
    assert [got[k]["problem"] for k in ("good.yaml", "other.yaml", "schema.yaml", "broken.yaml")] == [None, "mismatch", "schema", "yaml"]
    assert got["good.yaml"]["byte_size"] == 3 and got["good.yaml"]["issued_on"] == "2024-01-02" and got["good.yaml"]["effective_on"] is None


def test_sinks(spark, tmp_path):
    run = tmp_path / "raw"
    run.mkdir()
    for bad in (run / "x.json", tmp_path / "run.json", run):
        with pytest.raises(sinks.OverwriteError):
            sinks.guard(bad, run)
    with pytest.raises(sinks.OverwriteError):
        sinks.guard(tmp_path / "s.pdf", run, tmp_path / "s.pdf")
    digest = sinks.publish("đ\n", sinks.guard(tmp_path / "out" / "x.json", run))
    assert (tmp_path / "out" / "x.json").read_bytes() == "đ\n".encode() and len(digest) == 64
    df = spark.createDataFrame([("a|b", 0.5), ("c", None)], "name string, v double")
    assert sinks.markdown_report("R", {"T": df}) == "# R\n\n## T\n\n| name | v |\n|---|---|\n| a\\|b | 0.5000 |\n| c | N/A |\n"
    assert json.loads(sinks.evidence_json({"t": df}))["t"][1]["v"] is None
    assert canonical.canonical_json({"b": 1, "a": ["đ"]}) == '{\n  "b": 1,\n  "a": [\n    "đ"\n  ]\n}\n'


def test_more_files(spark, tmp_path):
    node = {"reference_record_id": "r", "kind": "article", "canonical_path": "article:1", "scored": True, "title": None}
    files = {"a.v4.json": {"document_id": "a", "version_id": "v1", "audited_pages": [{"page_index": 2, "nodes": [node, {}]}]}, "b.v4.json": {"document_id": "b"}, "c.v4.json": {"document_id": "b"}, "d.v4.json": {}, "x.audit.v4.json": {"document_id": "z"}, "e.v3.json": {"document_id": "e"}}
    for name, value in files.items():
        (tmp_path / name).write_text(json.dumps(value))
    (tmp_path / "f.v4.json").write_text("{")
    (tmp_path / "s_middle.json").write_text(json.dumps({"_version_name": " 3.1 ", "_backend": ""}))
    (tmp_path / "t_meta.json").write_text(json.dumps({"page_stats": [{"page_id": 0, "text_extraction_method": "pdftext"}, {"page_id": 0, "text_extraction_method": "pdftext"}, {"page_id": 9, "text_extraction_method": " "}]}))
    read = raw.json_files(spark, str(tmp_path))
    nodes, problems = raw.structural_annotations(read)
    assert [(r["document_id"], r["page_index"], r["node_position"], r["kind"], r["scored"]) for r in nodes.orderBy("node_position").collect()] == [("a", 2, 0, "article", True), ("a", 2, 1, None, None)]
    assert {(r["path"].rsplit("/", 1)[1], r["problem"]) for r in problems.collect()} == {("b.v4.json", "document_repeated"), ("d.v4.json", "document_id_missing"), ("f.v4.json", "unreadable")}
    assert [tuple(r)[1:] for r in raw.sidecar_provenance(read).collect()] == [("mineru", "3.1", None)]
    methods = raw.page_methods(read)
    counts = methods.select("directory", F.lit(3).alias("page_count")).distinct()
    assert {(r["page_index"], r["problem"]) for r in raw.page_method_problems(methods, counts).collect()} == {(0, "page_repeated"), (9, "page_out_of_range"), (9, "malformed")}
    one = spark.createDataFrame([("d1", "p1"), ("d2", "p2")], "directory string, path string")
    every = spark.createDataFrame([("d1",), ("d2",), ("d3",)], "directory string")
    assert {r["directory"]: r["problem"] for r in raw.run_records(one, one.where("directory = 'd2'"), every).collect()} == {"d1": None, "d2": "two run records", "d3": "no run record"}


def test_evidence_and_settings(spark, tmp_path, monkeypatch):
    t = spark.createDataFrame([("a", 0.5)], "name string, v double")
    digests = evidence.write_evidence(tmp_path / "e", {"scores": {"t": t}}, {"corpus": evidence.corpus_report(t, t, t)})
    assert sorted(digests) == ["corpus.md", "scores.json"] and evidence.verify_evidence(tmp_path / "e") == [] and evidence.verify_against(tmp_path / "e", {"scores": {"t": t}}) == []
    assert docweave_main(["verify", str(tmp_path / "e")]) == 0
    (tmp_path / "e" / "scores.json").write_text("{}\n")
    (tmp_path / "e" / "more.md").write_text("x")
    (tmp_path / "e" / "corpus.md").unlink()
    assert evidence.verify_evidence(tmp_path / "e") == [("corpus.md", "missing"), ("scores.json", "size"), ("scores.json", "sha256"), ("more.md", "not_listed")]
    assert docweave_main(["verify", str(tmp_path / "e")]) == 1 and evidence.verify_against(tmp_path / "e", {"scores": {"t": t}}) == ["scores"]
    for report in (evidence.parser_report("x", t, t, t), evidence.gap_report(t, t, t), evidence.physical_report(t, t, t, t), evidence.structural_report(t, t, t, t, t)):
        assert report.startswith("# ") and "| a | 0.5000 |" in report
    (tmp_path / "run" / "raw" / "sub").mkdir(parents=True)
    (tmp_path / "run" / "raw" / "sub" / "x.json").write_text("1")
    assert docweave_main(["record", str(tmp_path / "run" / "raw"), "--run", '{"parser": "marker"}']) == 0
    record = json.loads((tmp_path / "run" / "run.json").read_text())
    assert record["parser"] == "marker" and record["artifacts"] == [{"relative_path": "sub/x.json", "byte_size": 1, "sha256": hashlib.sha256(b"1").hexdigest()}]
    with pytest.raises(sinks.OverwriteError):
        evidence.write_run_record(tmp_path / "run" / "raw", {})
    (tmp_path / ".env").write_text("# x\nexport DOCWEAVE_DATA_DIR='d'\nDOCWEAVE_SHUFFLE_PARTITIONS=5\nOTHER=1\n")
    got = settings.load({"docweave_shuffle_partitions": "7"}, tmp_path / ".env")
    assert (got.data_dir, got.shuffle_partitions, got.output_dir) == ("d", 7, "out")
    with pytest.raises(ValueError):
        settings.load({"DOCWEAVE_SHUFFLE_PARTITIONS": "x"}, tmp_path / "none")
    assert [tuple(r) for r in evidence.catalog(spark, {"b": ["marker"], "a": []}).collect()] == [("b", "marker", "data/raw/b/marker/raw", "data/physical_ir/b/marker.v1.json", "data/structural_ir/b/marker.v1.json")]


def test_audit_operators(spark):
    rows = [("d", "m", "a", 1), ("d", "m", "b", 1), ("e", "n", "a", 2)]
    df = spark.createDataFrame(rows, "doc string, parser string, kind string, page int")
    got = {(r["grouping"], r["doc"], r["parser"], r["kind"]): r["n"] for r in audit.totals_by(df, ["doc"], ["parser", "kind"]).collect()}
    assert got == {("", None, None, None): 3, ("doc", "d", None, None): 2, ("doc", "e", None, None): 1, ("parser+kind", None, "m", "a"): 1, ("parser+kind", None, "m", "b"): 1, ("parser+kind", None, "n", "a"): 1}
    b = spark.createDataFrame([(1, True), (1, None), (2, True), (2, False), (3, None)], "k int, v boolean")
    assert {r["k"]: (r["value"], r["conflict"]) for r in audit.boolean_agreement(b, ["k"], "v").collect()} == {1: (True, False), 2: (None, True), 3: (None, False)}
    z = spark.createDataFrame([(1,), (2,), (2,)], "k int")
    assert {(r["k"], r["rule_id"]) for r in audit.zipped(z, spark.createDataFrame([(2,), (3,)], "k int"), ["k"]).collect()} == {(1, "only_first"), (2, "place_repeated"), (3, "only_second")}


def test_match_diagnostics(spark):
    node = lambda side, n, path, parent: (1, 0, "clause", "1", f"{side}{n}", path, parent, None)
    r = spark.createDataFrame([node("r", 1, "a", "x"), node("r", 2, "a", "x"), node("r", 3, "b", "y")], NODES)
    p = spark.createDataFrame([node("p", 1, "a", "x"), node("p", 2, "a", "x"), node("p", 3, "c", "z")], NODES)
    m = structural.match(r, p, ["d"])
    assert {x["category"] for x in structural.match_diagnostics(r, p, m, ["d"]).collect()} == {"ambiguous_duplicate_identity_title_excluded", "ambiguous_duplicate_group_unmatched"}
    assert {(x["path"], x["side"]) for x in structural.shared_items(r, p, ["d"], ["path"]).collect()} == {("a", "shared"), ("b", "only_left"), ("c", "only_right")}


def test_streaming(spark, tmp_path):
    from docweave.streaming.ingest import ingest

    spark.range(3).write.parquet(str(tmp_path / "in"))
    q = ingest(spark, str(tmp_path / "in"), "id bigint", str(tmp_path / "out"), str(tmp_path / "cp"), lambda df: df.where("id > 0"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
