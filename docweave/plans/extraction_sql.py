"""SQL counterparts of the extraction queries that need long preparation: tree blocks, canonical text, grids, visible text, outlines."""

from __future__ import annotations

from docweave.operators.html_text import LINE_ENDS
from docweave.plans.problems import TREE

_TAGS = "|".join(sorted(LINE_ENDS, key=len, reverse=True))
# visible text of markup without comments, scripts and quoted angle brackets
VISIBLE = rf"""with a as (select block_row_id, regexp_replace(regexp_replace(coalesce(html, ''), '<br(\s[^>]*)?/?>', chr(10), 'gi'), '</({_TAGS})\s*>', chr(10), 'gi') as h, regexp_extract(coalesce(html, ''), '(?i)<h([1-6])[\s>]', 1) as level from marker_blocks),
b as (select block_row_id, level, regexp_replace(h, '</?[A-Za-z][^<>]*>', '', 'g') as h from a),
c as (select block_row_id, level, replace(replace(replace(replace(replace(replace(h, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', chr(160)), '&amp;', '&') as h from b),
l as (select block_row_id, level, trim(regexp_replace(unnest(string_split(h, chr(10))), '[\s\x{{00a0}}]+', ' ', 'g')) as line from c),
x as (select block_row_id, max(level) as level, cast(sum(length(line)) + count(*) - 1 as integer) as n from l where line <> '' group by block_row_id)
select m.block_row_id as block_row_id, coalesce(x.n, 0) as n, cast(nullif(a.level, '') as integer) as heading_level from marker_blocks m join a on m.block_row_id = a.block_row_id left join x on m.block_row_id = x.block_row_id"""


def _projected(at: int, axis: int) -> str:
    good = f"len(pb) = 4 and pb[{axis + 2}] > pb[{axis}] and len(bb) = 4 and bb[1] <= bb[3] and bb[2] <= bb[4]"
    return f"case when {good} then round((bb[{at}] - pb[{axis}]) / (pb[{axis + 2}] - pb[{axis}]) * 1000, 6) end"


def block_id(page: str = "page_index", order: str = "reading_order") -> str:
    """SQL for a block's id."""
    return f"document_id || '_' || coalesce(version_id, '') || '_p' || printf('%04d', {page}) || '_b' || printf('%04d', {order})"


TREE_BLOCKS = (
    TREE
    + f""", newest as (select run_id, arg_max(tree_id, (coalesce(ingested_at, timestamp '0001-01-01'), tree_id)) as tree_id from marker_trees group by run_id),
t as (select m.run_id, m.document_id, m.version_id, m.tree_id from marker_trees m join newest w on m.tree_id = w.tree_id),
b0 as (select t.*, b.page as page_index, cast(string_split(b.node_path, '/')[2] as integer) as reading_order, b.j, p.j as pj from t join n b on t.tree_id = b.tree_id and b.depth = 1 join n p on p.tree_id = b.tree_id and p.node_path = b.parent_path),
b1 as (select *, json_extract_string(j, '$.block_type') as raw_type, row_number() over (partition by run_id order by page_index, reading_order) - 1 as raw_index, try_cast(json_extract(pj, '$.bbox') as double[]) as pb, try_cast(json_extract(j, '$.bbox') as double[]) as bb from b0),
b2 as (select *, {_projected(1, 1)} as x0, {_projected(2, 2)} as y0, {_projected(3, 1)} as x1, {_projected(4, 2)} as y1 from b1),
tree_block as (select run_id, document_id, version_id, cast(page_index as integer) as page_index, reading_order, cast(raw_index as integer) as raw_index, {block_id()} as block_id, raw_type,
  case raw_type when 'Text' then 'text' when 'SectionHeader' then 'title' when 'PageHeader' then 'header' else 'unknown' end as kind_v0,
  case raw_type when 'Text' then 'text' when 'SectionHeader' then 'title' when 'PageHeader' then 'header' when 'Table' then 'table' when 'Figure' then 'figure' when 'Picture' then 'image' else 'unknown' end as kind,
  case when raw_type in ('PageHeader', 'PageFooter') then 'discarded' else 'content' end as disposition, case when x0 between 0 and 1000 then x0 end as x0, case when y0 between 0 and 1000 then y0 end as y0, case when x1 between 0 and 1000 then x1 end as x1, case when y1 between 0 and 1000 then y1 end as y1 from b2)
"""
)


def _lines(indent: int, *parts: str) -> str:
    """SQL for lines of JSON text: each part is SQL for what follows the indent; lines are joined by commas outside."""
    return " || chr(10) || ".join(f"'{' ' * indent}' || {p}" for p in parts)


def _field(name: str, value: str, last: bool = False) -> str:
    return f"'\"{name}\": ' || {value}" + ("" if last else " || ','")


_NUMBER = "coalesce(cast({} as varchar), 'null')"
_BLOCK = " || chr(10) || ".join(
    (
        "'        {'",
        _lines(10, _field("id", f"to_json({block_id()})"), _field("page_index", "page_index"), _field("reading_order", "reading_order"), _field("kind", "to_json(kind_v0)"), _field("disposition", "to_json(disposition_v0)"), _field("text", "to_json(clean)"), "'\"bbox\": {'"),
        _lines(12, *(_field(n, _NUMBER.format(n)) for n in ("x0", "y0", "x1", "y1")), _field("coordinate_system", "'\"normalized_1000\"'", True)),
        _lines(10, "'},'", _field("heading_level", _NUMBER.format("case when kind_v0 = 'title' then heading_level end")), "'\"provenance\": {'"),
        _lines(12, _field("parser", "'\"mineru\"'"), _field("parser_version", "to_json(coalesce(pv, 'unknown'))"), _field("parser_backend", "to_json(coalesce(pb, 'unknown'))"), _field("source_raw_artifact", "'\"unknown\"'"), _field("source_raw_index", "raw_index", True)),
        "'          }'",
        "'        }'",
    )
)
_TEXT = "coalesce(cast(to_json({}) as varchar), 'null')"
_PAGE = f"""'    {{' || chr(10) || {_lines(6, _field("page_index", "e.page_index"), _field("width", "'null'"), _field("height", "'null'"))} || chr(10) || '      "blocks": [' || case when bs is null then ']' else chr(10) || bs || chr(10) || '      ]' end || chr(10) || '    }}'"""
_HEAD = _lines(
    2, _field("physical_ir_version", "1"), _field("document_id", _TEXT.format("document_id")), _field("version_id", _TEXT.format("version_id")), _field("source_artifact_sha256", _TEXT.format("sha")), _field("parser", "'\"mineru\"'"),
    _field("parser_version", "to_json(coalesce(pv, 'unknown'))"), _field("parser_backend", "to_json(coalesce(pb, 'unknown'))"), _field("page_count", "(last + 1)"), "'\"pages\": ['",
)
#: Follows the blocks of the flat lists.
CANONICAL = f""", r as (select run_id, lower(nullif(trim(input_sha256), '')) as sha, nullif(trim(parser_version), '') as pv, nullif(trim(backend), '') as pb from parser_runs),
js as (select run_id, page_index, reading_order, {_BLOCK} as b from blocks left join r using (run_id)),
pg as (select run_id, page_index, string_agg(b, ',' || chr(10) order by reading_order) as bs from js group by all),
span as (select run_id, max(page_index) as last from pg group by run_id), every as (select run_id, last, unnest(generate_series(0, last)) as page_index from span),
pages as (select e.run_id, e.last, string_agg({_PAGE}, ',' || chr(10) order by e.page_index) as ps from every e left join pg on e.run_id = pg.run_id and e.page_index = pg.page_index group by all),
doc as (select distinct on (run_id) run_id, document_id, version_id from blocks),
texts as (select run_id, '{{' || chr(10) || {_HEAD} || chr(10) || ps || chr(10) || '  ]' || chr(10) || '}}' || chr(10) as t from pages join doc using (run_id) left join r using (run_id))
select run_id, sha256(t) as sha256, length(t) as n_chars from texts"""

# tables without spans
GRID = r"""with r as (select item_id, string_split(table_body, '<tr>') as rs from mineru_items where table_body like '%<table%'),
rows as (select item_id, len(rs) - 1 as row_count, unnest(rs[2:]) as row, generate_subscripts(rs[2:], 1) - 1 as row_start from r),
cells as (select item_id, row_count, row_start, string_split_regex(row, '<t[dh]>') as cs from rows), wide as (select item_id, max(len(cs) - 1) as column_count from cells group by item_id)
select c.item_id as item_id, true as grid_ok, cast(row_count as integer) as row_count, cast(column_count as integer) as column_count, cast(row_start as integer) as row_start, cast(generate_subscripts(cs[2:], 1) - 1 as integer) as column_start, 1 as row_span, 1 as column_span,
  replace(replace(replace(trim(regexp_replace(regexp_replace(unnest(cs[2:]), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') as cell_text, false as is_header from cells c join wide w on c.item_id = w.item_id"""

ASSETS = (
    TREE
    + r""", i as (select tree_id, node_path, unnest(map_entries(cast(json_extract(j, '$.images') as map(varchar, json)))) as m from n where json_type(j, '$.images') = 'OBJECT'),
v as (select tree_id, node_path, m.key as image_id, json_extract_string(m.value, '$') as e from i),
o as (select *, coalesce(regexp_full_match(e, '(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?') and e <> '', false) as good from v), d as (select *, case when good then from_base64(e) end as data from o),
m as (select *, case when hex(data)[1:6] = 'FFD8FF' then 'image/jpeg' when hex(data)[1:16] = '89504E470D0A1A0A' then 'image/png' when hex(data)[1:12] in ('474946383761', '474946383961') then 'image/gif' when hex(data)[1:8] = '52494646' and hex(data)[17:24] = '57454250' then 'image/webp' end as media from d)
select tree_id, node_path, image_id, case when e is null then 'unavailable' when media is not null then 'embedded_raw' end as storage_kind, media as media_type, case when media is not null then sha256(data) end as sha256, case when media is not null then octet_length(data) end as byte_size,
  case when e = '' then 'empty' when e is not null and not good then 'not_base64' when e is not null and media is null then 'unknown_signature' end as problem from m"""
)

COVER = "select doc_id, length(text) as covered, cast(0 as bigint) as first_start, length(text) as last_end, sha256(text) as sha256 from documents where length(text) > 0"
#: Texts whose articles follow from single lines: no other formal head, no contents or leaders, no odd line ends.
CONTAINER_HEAD = r"^\s*(chương|chuong|phần|phan|mục|muc|tiểu|tieu|phụ|phu)\s"
CONTENTS = r"mục\s+lục|muc\s+luc|\.\s*\.|…"
ODD_ENDS = "[" + "".join(map(chr, (13, 11, 12, 28, 29, 30, 0x85, 0x2028, 0x2029, 0xA0))) + "]"
ARTICLES = rf"""with t as (select doc_id, text from documents where length(text) > 0 and not regexp_matches(text, '(?im){CONTAINER_HEAD}') and not regexp_matches(text, '(?i){CONTENTS}') and not regexp_matches(text, '{ODD_ENDS}')),
l as (select doc_id, unnest(string_split(text, chr(10))) as line from t), a as (select doc_id, lower(regexp_extract(line, '(?i)^\s*(?:điều|dieu)\s+(\d+[a-zđ]?)[.:-]?(?:\s|$)', 1)) as k, regexp_extract(line, '(?i)^\s*(?:điều|dieu)\s+\d+[a-zđ]?([.:-]?)(?:\s|$)', 1) as sep,
  trim(regexp_extract(line, '(?i)^\s*(?:điều|dieu)\s+\d+[a-zđ]?[.:-]?(?:\s|$)(.*)$', 1)) as rest from l)
select distinct doc_id, k as ordinal_key, 'article:' || k as path, 1 as depth from a where k <> '' and (rest = '' or sep <> '' and not regexp_matches(rest, '(?i)^(của|cua|nêu\s+trên|neu\s+tren|kèm\s+theo|kem\s+theo)([^\p{{L}}\p{{N}}_]|$)'))"""
