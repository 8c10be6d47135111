import pytest
from pyspark.sql import functions as F

from docweave.operators import checks, outline
from docweave.operators.outline import Block, extract


def read(text, kind="text"):
    return extract([Block("b0", 0, kind, "content", text)])


def paths(text, kind="text"):
    return [n.path for n in read(text, kind).nodes[1:]]


def refused(text, kind="text"):
    return [f["category"] for record, f in read(text, kind).rows if record == "diagnostic"]


def rebuilt(r):
    spans = sorted((f["char_start"], f["char_end"]) for record, f in r.rows if record == "anchor" and f["role"] != "object")
    return spans


@pytest.mark.parametrize(
    ("text", "kind", "want"),
    [
        # contents: a heading with its entries, entries alone, an entry of two lines, and a body on the same page
        ("Mục lục\nPhần I ..... 4\nPhần II . . . trang 9\nPHẦN I\nĐiều 7. Lưu trữ bản vẽ", "text", ["part:1", "part:1/article:7"]),
        ("MUC LUC\nChương 2\nQuản lý kho ....... 11\nChương 2\nNỘI DUNG\nvà phần sau ..... 30 trang", "text", ["chapter:2"]),
        ("Điều 4. Bản đồ nền ........ 17\nĐiều 4. Bản đồ nền", "text", ["article:4"]),
        ("mục lục\nPhần III", "text", ["part:3"]),
        # formal levels, restarts, appendices
        ("Phụ lục 4\nMục IV\nII. BẢN ĐỒ\nMục V\nII. BẢNG BIỂU", "title", ["appendix:4", "appendix:4/section:4", "appendix:4/section:4/generic:2", "appendix:4/section:5", "appendix:4/section:5/generic:2"]),
        ("Phu luc: danh sách\nTIỂU MỤC 3 - TÊN", "text", ["appendix:unnumbered", "appendix:unnumbered/subsection:3"]),
        ("Phụ lục II, III\nPHẦN 1 (bản thảo) ghi chú", "text", ["appendix:unnumbered"]),
        ("PHẦN 1 TÊN (bản thảo)\nDieu 6: x\nĐiều 6a- y\nĐiều 40. z", "text", ["part:1", "part:1/article:6", "part:1/article:6a", "part:1/article:40"]),
        # clauses and points need their parents; an open outline overrides them until the clause that is due
        ("Điều 9. Kho\n3. Nhập kho\nd) Cân\nđ) Đo\n4. Xuất kho", "text", ["article:9", "article:9/clause:3", "article:9/clause:3/point:d", "article:9/clause:3/point:đ", "article:9/clause:4"]),
        ("Điều 2. Kho\n7. Kiểm kê\n7.1. THIẾT BỊ\nb) Máy in\n9. máy quét\n8. Thanh lý", "title", ["article:2", "article:2/clause:7", "article:2/clause:7/generic:7.1", "article:2/clause:7/generic:7.1/generic:b", "article:2/clause:7/generic:9", "article:2/clause:8"]),
        # generic outlines
        ("V. HIỆN TRẠNG\n2. DÂN SỐ\n2.1. Theo vùng\n2.1.4. Theo xã\n2.2. theo năm;", "text", ["generic:5", "generic:5/generic:2", "generic:5/generic:2/generic:2.1", "generic:5/generic:2/generic:2.1/generic:2.1.4"]),
        ("Chương IV. Tên\n3. dân số tăng nhanh", "text", ["chapter:4"]),
        ("2. dân số tăng", "text", []), ("c) nhập", "text", []), ("xem Điều 8 và Chương II", "text", []), ("", "text", []), ("\n \n", "text", []),
        # a title that holds more than one head
        ("PHẦN II KHO TÀNG Mục 5 NHẬP\nMục 6 XUẤT", "title", ["part:2", "part:2/section:5", "part:2/section:6"]),
        ("PHẦN II KHO TÀNG MỤC 5 NHẬP", "text", ["part:2"]),
    ],
)
def test_paths(text, kind, want):
    assert paths(text, kind) == want


@pytest.mark.parametrize("text", ["Điều 12 cũng nói vậy", "Phần IV nói về kho", "Phụ lục I nêu  trên thì bỏ", "Mục 9. của bản này", "Chuong V kem theo ban ve"])
def test_prose_is_no_heading(text):
    assert paths(text, "title") == [] and "line_start_prose_reference_rejected" in refused(text, "title")


@pytest.mark.parametrize(
    ("text", "category"),
    [("Phần VX", "invalid_roman_ordinal_rejected"), ("IIV. KHO", "invalid_roman_ordinal_rejected"), ("Điều 8. Kho\nĐiều 8. Kho", "duplicate_structural_key_rejected"), ("4.2. cân mỗi tuần", "generic_heading_evidence_rejected"), ("Mục lục\nPhần I ...... 3", "table_of_contents_entry_rejected")],
)
def test_refusals(text, category):
    assert category in refused(text)


def test_lists_inside_lines_keep_the_partition():
    text = "Điều 5. Kho\n8. Khi nhập:\na) cân; đo; b) dán nhãn;\nc) ghi sổ: d) ký; e) bỏ qua; đ) chụp ảnh. 9. Khi xuất: a) ký\nb) giao"
    r = read(text)
    assert [n.path.removeprefix("article:5/") for n in r.nodes[2:]] == ["clause:8", "clause:8/point:a", "clause:8/point:b", "clause:8/point:c", "clause:8/point:d", "clause:8/point:đ", "clause:9", "clause:9/point:a", "clause:9/point:b"]
    assert "".join(text[a:b] for a, b in rebuilt(r)) == text


def test_entries_of_contents_are_bounded():
    entry = lambda n: "Mục lục\n" + "x\n" * n + "y .... 5\nChương I"
    hidden = lambda text: len(outline.contents_lines(outline.lines_of(Block("b", 0, "text", "content", text))))
    assert hidden(entry(23)) == 25 and hidden(entry(24)) == 1


def test_title_on_the_next_line_and_objects():
    blocks = [Block("b0", 0, "text", "content", "Phần 3\n"), Block("b1", 0, "table", "content", ""), Block("b2", 1, "title", "content", "Kho tàng"), Block("b3", 1, "text", "content", "Nội dung."), Block("b4", 1, "header", "discarded", "Điều 5"), Block("b5", 1, "table", "content", "")]
    r = extract(blocks)
    assert r.nodes[1].title == "Kho tàng" and r.nodes[1].page_index == 0 and len(r.nodes) == 2
    assert [(f["role"], f["block_id"], f["document_order"]) for record, f in r.rows if record == "anchor"] == [("marker", "b0", 0), ("object", "b1", 1), ("title", "b2", 2), ("body", "b3", 3), ("object", "b5", 5)]
    assert [f["title"] for record, f in r.rows if record == "node"] == [None, "Kho tàng"]


def test_a_node_waits_for_its_title_before_it_is_sent():
    r = outline.Recogniser()
    r.page([Block("a", 0, "text", "content", "Nội dung\nChương 2")])
    assert [record for record, _ in r.drain(last=False)] == ["node", "anchor"]
    r.page([Block("b", 1, "title", "content", "Kho"), Block("c", 1, "text", "content", "x")])
    assert [(record, f.get("title"), f.get("role")) for record, f in r.drain(last=False)] == [("node", "Kho", None), ("anchor", None, "marker"), ("anchor", None, "title"), ("anchor", None, "body")]
    r.page([Block("d", 2, "text", "content", "Phần 1")])
    assert r.drain(last=False) == [] and len(r.drain()) == 2


@pytest.mark.parametrize(("raw", "key"), [("v", "5"), ("XLII", "42"), ("MMMCMXCIX", "3999"), ("MMMM", None), ("IC", None), ("VV", None), ("", None), ("X1", None)])
def test_roman(raw, key):
    assert outline.roman_value(raw) == key


def test_spark_records(spark):
    rows = [(1, 0, 0, "a", "text", "content", "Điều 1. A\n1. B"), (1, 1, 0, "b", "text", "content", "a) C\n"), (2, 0, 0, "c", "text", "content", None), (2, 0, 1, "d", None, None, "x"), (None, 0, 0, "e", "text", "content", "Điều 2. Z"), (3, 0, 0, "f", "text", "content", "Điều 1. x\n" + "nội dung dài " * 20_000)]
    blocks = spark.createDataFrame(rows, "k bigint, page_index int, reading_order int, block_id string, kind string, disposition string, text string")
    records = outline.outline_records(blocks, "k").cache()
    n = outline.nodes(records, "k")
    assert {(r["k"], r["path"], r["page_index"]) for r in n.where("kind <> 'document'").collect()} == {(1, "article:1", 0), (1, "article:1/clause:1", 0), (1, "article:1/clause:1/point:a", 1), (None, "article:2", 0), (3, "article:1", 0)}
    assert checks.hierarchy_violations(n.where("k is not null"), "k").count() == 0 and checks.node_violations(n, "k").count() == 0
    whole = blocks.where("k is not null and disposition is not null").fillna("", ["text"])
    assert checks.anchor_partition(whole, outline.anchors(records, "k").where("k is not null"), "k").count() == 0
    assert checks.evidence_violations(whole, n.where("k is not null"), outline.anchors(records, "k"), "k").count() == 0
    broken = checks.evidence_violations(whole.withColumn("text", F.lit("x" * 30)), n.where("k is not null"), outline.anchors(records, "k"), "k").collect()
    assert sorted((r["k"], r["rule_id"]) for r in broken) == [(1, "marker_text_differs")] * 3 + [(1, "title_text_differs"), (3, "marker_text_differs"), (3, "title_text_differs")]
    assert checks.anchor_partition(whole.withColumn("page_index", F.lit(7)), outline.anchors(records, "k").where("k is not null"), "k").count() == 4
    assert outline.outline_records(blocks.limit(0), "k").count() == 0
    swapped = outline.outline_records(blocks.orderBy("block_id", ascending=False).withColumnRenamed("k", "key").withColumn("node_id", F.lit(0)), "key")
    assert swapped.count() == records.count()
