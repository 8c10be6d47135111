import json
import random

import pytest

from docweave.functions import deep_json
from docweave.operators import nested, schema_drift
from docweave.operators.schema_drift import SCHEMA_4


def node(**changes):
    base = {n: (1 if k == "integer" else True if k == "boolean" else "x") for n, k in SCHEMA_4.items()}
    return {k: v for k, v in (base | changes).items() if v != "absent"}


def file_of(*nodes):
    return json.dumps({"audited_pages": [{"nodes": list(nodes)}]}, ensure_ascii=False)


def changes(spark, *texts):
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "file_id bigint, raw string, fields string")
    return {(r["file_id"], r["field_name"], r["change_kind"]) for r in schema_drift.changes(df, "file_id", "raw").collect()}


def test_changes(spark):
    got = changes(
        spark,
        file_of(node()),  # no change
        file_of(node(title="absent", node_title="t"), node(title="absent", node_title=["t"])),  # renamed and retyped
        file_of(node(scored="absent")),
        file_of(node(extra=1, page_index="5"), node()),
        file_of(node(title=None), node(kind="absent")),  # nulls and partly missing fields are none
        file_of(node(sourceExcerpt="s", source_excerpt="absent")),
        file_of(node(path="p")),  # beside the field's own name
        file_of()[:-3],
        file_of(),
        "",
        None,
        "[]",
    )
    assert got == {(1, "title", "renamed"), (1, "title", "retyped"), (2, "scored", "removed"), (3, "extra", "added"), (3, "page_index", "retyped"), (5, "source_excerpt", "renamed"), (6, "path", "added")}


def test_changes_of_nothing_and_repeats(spark):
    assert changes(spark) == set()
    df = spark.createDataFrame([(1, file_of(node(scored="absent")))] * 2, "file_id bigint, raw string")
    assert schema_drift.changes(df, "file_id", "raw").count() == 2


def test_consistent_nodes_cast(spark):
    text = file_of(node(page_index="7", pdf_page_number_1_based=[8], scored="yes", marker_text=["Điều", "1."], ordinal_system={"code": "article"}, reference_record_id=12, title="absent", heading_title={"value": "T"}), node(scored=0, page_index="x"))
    df = spark.createDataFrame([(1, text), (2, None)], "file_id bigint, raw string")
    a, b = schema_drift.consistent_nodes(df, "file_id", "raw").orderBy("node_position").collect()
    assert (a["page_index"], a["pdf_page_number_1_based"], a["scored"], a["marker_text"], a["ordinal_system"], a["reference_record_id"], a["title"]) == (7, 8, True, "Điều 1.", "article", "12", "T")
    assert b["scored"] is False and b["page_index"] is None


def test_consistent_nodes_keep_other_fields_and_names(spark):
    text = file_of({**node(title="absent", page_index="absent", pdf_page_number_1_based="absent", path="p", alt_titles=["a"], text_lang="vi", nothing=None), "Title": "T", "PageIndex": 3, "pdfPageNumber1Based": 4})
    df = spark.createDataFrame([(1, text)], "file_id bigint, raw string")
    a = schema_drift.consistent_nodes(df, "file_id", "raw").collect()[0]
    assert (a["title"], a["page_index"], a["pdf_page_number_1_based"], a["canonical_path"]) == ("T", 3, 4, "x")
    assert a["other_fields"] == {"path": '"p"', "alt_titles": '["a"]', "text_lang": '"vi"'}
    assert (0, "pdf_page_number_1_based", "renamed") in changes(spark, text)


def test_chain_records_each_step(spark):
    text = file_of({**{k: v for k, v in node(scored="yes").items() if k not in ("title", "ordinal_system", "reference_record_id")}, "Node-Title": "t", "recordId": 5, "extra": 1})
    df = spark.createDataFrame([(1, text), (2, file_of(node())), (3, file_of())], "file_id bigint, raw string")
    got = {tuple(r) for r in schema_drift.steps(df, "file_id", "raw").collect()}
    assert got == {(1, 1, 2, "title", "renamed", "Node-Title"), (1, 2, 3, "ordinal_system", "removed", None), (1, 3, 4, "reference_record_id", "renamed", "recordId"), (1, 3, 4, "reference_record_id", "retyped", "integer"), (1, 3, 4, "scored", "retyped", "string"), (1, 3, 4, "extra", "added", None)}
    assert {r["file_id"]: r["entered_at"] for r in schema_drift.file_versions(df, "file_id", "raw").collect()} == {1: 1, 2: 4, 3: 1}


def test_fingerprints_route(spark):
    of = lambda v: file_of({k: x for k, x in node().items() if k in schema_drift.version_fields(v)})
    df = spark.createDataFrame([(v, of(v)) for v in (2, 3, 4)], "file_id bigint, raw string")
    rows = schema_drift.file_versions(df, "file_id", "raw").collect()
    assert all(schema_drift.known_fingerprints()[r["fingerprint"]] == r["file_id"] == r["entered_at"] for r in rows)
    assert {(r["file_id"], r["from_version"]) for r in schema_drift.steps(df, "file_id", "raw").collect()} == {(2, 2), (2, 3), (3, 3)}


def test_repeated_keys_are_read(spark):
    text = '{"audited_pages": [{"nodes": [' + json.dumps(node())[:-1] + ', "title": 5}]}], "a": 1, "a": 2}'
    assert changes(spark, text) == {(0, "title", "retyped")}


def test_versions(spark):
    v2 = {k: v for k, v in node().items() if k not in ("ordinal_system", "reference_instance_id", "reference_record_id", "parent_reference_instance_id")}
    df = spark.createDataFrame([(1, file_of(node())), (2, file_of(v2)), (3, file_of({**v2, "ordinal_system": "x"}))], "file_id bigint, raw string")
    assert {r["file_id"]: r["true_version"] for r in schema_drift.file_versions(df, "file_id", "raw").collect()} == {1: 4, 2: 2, 3: 3}


TREE = {
    "block_type": "Document",
    "children": [
        {
            "id": "/page/0", "block_type": "Page", "section_hierarchy": {"3": "s0"}, "bbox": [0, 0, 10, 10],
            "children": [
                {"id": "a", "block_type": "ListGroup", "section_hierarchy": {"3": "s"}, "children": {"0": {"block_type": "ListItem"}, "1": {"id": 5, "block_type": "ListItem", "children": None}}},
                {"id": "a", "block_type": "Text", "section_hierarchy": None, "children": "[{\"id\": \"deep\", \"block_type\": \"Text\"}]"},
            ],
        },
        {"block_type": "Page", "children": ["no object", {"id": "b", "block_type": "Text"}]},
    ],
}


def test_links(spark):
    text = json.dumps(TREE)
    df = spark.createDataFrame([(1, text, "x"), (2, text[:-9], "x"), (3, None, "x"), (4, "", "x"), (5, "3", "x")], "tree_id bigint, raw string, pre string")
    got = {(r["tree_id"], r["node_path"], r["parent_path"], r["node_id"], r["section_id"]) for r in nested.links(df, "tree_id", "raw").collect()}
    assert got == {(1, "0/0", "0", "a", "s"), (1, "0/0/0", "0/0", "", ""), (1, "0/0/1", "0/0", "5", ""), (1, "0/1", "0", "a", ""), (1, "0/1/0", "0/1", "deep", ""), (1, "1/1", "1", "b", "")}
    assert nested.links(df.limit(0), "tree_id", "raw").count() == 0
    assert nested.links(df.union(df), "tree_id", "raw").count() == 12


def test_intervals_link_like_paths(spark):
    df = spark.createDataFrame([(1, json.dumps(TREE))], "tree_id bigint, raw string")
    n = nested.nodes(df, "tree_id", "raw").cache()
    pairs = {(r["ancestor_pre"], r["descendant_pre"]) for r in nested.contained(n, n).collect()}
    by = {r["node_path"]: r["pre"] for r in n.collect()}
    assert pairs == {(by[a], by[b]) for a in by for b in by if b.startswith(a + "/")}
    assert nested.of_type(n, "ListItem").count() == 2


def test_related_tables_keep_every_field(spark):
    block = {"id": "a", "block_type": "Text", "polygon": [[0, 1], [2.5, 3]], "images": {"i": "png"}, "section_hierarchy": {"1": "s1", "3": "s3"}, "extraction_method": "surya", "bbox": [1]}
    odd = {"id": "b", "block_type": "Table", "polygon": ["x"], "images": ["y"], "section_hierarchy": "z"}
    text = json.dumps({"block_type": "Document", "metadata": {"m": 1}, "children": [{"block_type": "Page", "children": [block, odd]}]})
    df = spark.createDataFrame([(1, text), (2, "{"), (3, None)], "tree_id bigint, raw string")
    n = nested.nodes(df, "tree_id", "raw").cache()
    assert [tuple(r) for r in nested.polygon_points(n).orderBy("point").collect()] == [(1, 1, 0, 0.0, 1.0, [0.0, 1.0]), (1, 1, 1, 2.5, 3.0, [2.5, 3.0])]
    assert [tuple(r) for r in nested.images(n).collect()] == [(1, 1, "i", "png")]
    assert sorted(tuple(r) for r in nested.sections(n).collect()) == [(1, 1, "1", "s1"), (1, 1, "3", "s3")]
    other = {r["pre"]: json.loads(r["other"] or "{}") for r in n.collect()}
    assert other == {0: {}, 1: {"extraction_method": "surya", "bbox": [1]}, 2: {"polygon": ["x"], "images": ["y"], "section_hierarchy": "z"}}
    assert [(r["tree_id"], r["block_type"], json.loads(r["other"])) for r in nested.tree_fields(df, "tree_id", "raw").collect()] == [(1, "Document", {"metadata": {"m": 1}})]


def test_containers_are_the_nearest(spark):
    df = spark.createDataFrame([(1, json.dumps(TREE)), (2, "[")], "tree_id bigint, raw string")
    n = nested.nodes(df, "tree_id", "raw").cache()
    kind = {r["pre"]: r["block_type"] for r in n.collect()}
    nearest = {}
    for r in nested.contained(n, n).collect():
        at = (r["descendant_pre"], kind[r["ancestor_pre"]])
        nearest[at] = min(nearest.get(at, (99, 0)), (r["levels"], r["ancestor_pre"]))
    assert {((r["pre"], r["container_type"]), (r["levels"], r["container_pre"])) for r in nested.containers(df, "tree_id", "raw").collect()} == set(nearest.items())


def test_very_deep_tree(spark):
    deep = 12_000
    text = '{"children": [{"block_type": "Page", "children": [' + '{"id": "g", "children": [' * deep + '{"id": "leaf", "section_hierarchy": {"3": "s"}}' + "]}" * deep + "]}]}"
    df = spark.createDataFrame([(1, text), (2, text[:-1])], "tree_id bigint, raw string")
    out = nested.links(df, "tree_id", "raw").select("tree_id", "depth", "node_id", "section_id").orderBy("depth").collect()
    assert len(out) == deep + 1 and tuple(out[-1]) == (1, deep + 1, "leaf", "s") and nested.containers(df, "tree_id", "raw").count() > deep


def test_deep_json_reads_and_writes_like_the_library():
    random.seed(3)

    def value(depth):
        kind = random.random()
        if depth and kind < 0.4:
            return {random.choice(["a", "đ\n", "", '"']): value(depth - 1) for _ in range(random.randint(0, 3))}
        if depth and kind < 0.7:
            return [value(depth - 1) for _ in range(random.randint(0, 3))]
        return random.choice([None, True, False, 0, -12, 1.5, -2e-7, "", "x\u2028", "\\"])

    for _ in range(400):
        v = value(5)
        text = json.dumps(v, ensure_ascii=random.random() < 0.5, indent=random.choice([None, 1]))
        assert deep_json._loads_flat(f" {text}\n") == v and deep_json._dumps_flat(v) == json.dumps(v, ensure_ascii=False)
        for cut in random.sample(range(len(text)), min(4, len(text))):
            broken = text[:cut] + random.choice(["", ",", "]", "}", '"', "x"]) + text[cut + 1 :]
            try:
                want = json.loads(broken)
            except ValueError:
                with pytest.raises(ValueError):
                    deep_json._loads_flat(broken)
            else:
                assert deep_json._loads_flat(broken) == want
