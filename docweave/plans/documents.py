"""Queries over texts and provenance tables: lines, partition, ordinals, manifests, runs, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import columns as c
from docweave.operators import audit, checks, lines
from docweave.sources.tables import read_table, spread


def _events(spark: SparkSession, d: str) -> DataFrame:
    return lines.line_events(spread(read_table(spark, d, "documents").select("doc_id", "text")), ["doc_id"], "text")


def line_events(spark: SparkSession, d: str) -> DataFrame:
    """Every line of every document with its offsets."""
    return _events(spark, d).select("doc_id", F.col("line_order").cast("bigint").alias("line_order"), F.col("char_start").cast("bigint").alias("char_start"), F.col("char_end").cast("bigint").alias("char_end"), F.md5("line").alias("line_md5"))


def block_partition_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether the lines of each document tile its text."""
    return lines.partition_summary(_events(spark, d), ["doc_id"])


def reconstruct_text_sha(spark: SparkSession, d: str) -> DataFrame:
    """Digest of each text put together again from its lines."""
    return lines.reconstruct(_events(spark, d), ["doc_id"]).select("doc_id", F.sha2("text", 256).alias("sha256"))


def artifact_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Size and digest of each document's text as stored."""
    t = read_table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", F.octet_length("text").cast("bigint").alias("byte_size"), F.sha2("text", 256).alias("sha256"))


def topk_examples(spark: SparkSession, d: str) -> DataFrame:
    """The three longest lines of each source, ties by document and place."""
    from pyspark.sql.window import Window

    rows = _events(spark, d).join(read_table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("(none)")).alias("source")), "doc_id")
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.length("line").desc(), "doc_id", "line_order"))
    return rows.select("source", "doc_id", F.col("line_order").cast("bigint").alias("line_order"), F.length("line").cast("bigint").alias("n"), rank.cast("bigint").alias("place")).where("place <= 3")


def rollup_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Documents and characters by language and source, with totals."""
    return audit.rolled_up(read_table(spark, d, "documents").select("lang", "source", "n_chars"), "lang", "source", characters="n_chars")


def reference_ordinals(spark: SparkSession, d: str) -> DataFrame:
    """Ordinal keys of the reference nodes recomputed from the raw ordinals."""
    n = read_table(spark, d, "ref_nodes")
    kind = F.col("kind")
    key = F.when(kind.isin("part", "chapter", "section", "subsection", "appendix"), c.container_key(F.col("ordinal_raw"))).when(kind.isin("article", "clause"), c.number_key(F.col("ordinal_raw"))).when(kind == "point", c.letter_key(F.col("ordinal_raw")))
    return n.select("node_row_id", "kind", "ordinal_raw", key.alias("recomputed_key"), key.eqNullSafe(F.col("ordinal_key")).alias("agrees"))


def provenance_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Digest and parser name that a run and its manifest agree on."""
    m = read_table(spark, d, "manifests").groupBy("document_id", "version_id").agg(F.max("sha256").alias("m_sha"))
    r = read_table(spark, d, "parser_runs").select("run_id", "document_id", "version_id", "input_sha256", "parser")
    both = r.join(m, ["document_id", "version_id"], "left")
    sha = c.agreement([F.col("input_sha256"), F.col("m_sha")], lower=True)
    return both.select("run_id", sha["value"].alias("sha256"), sha["conflict"].alias("sha_conflict"), c.agreement([F.col("parser")], lower=True)["value"].alias("parser"))


def manifest_checks(spark: SparkSession, d: str) -> DataFrame:
    """Manifests that break the contract, by rule."""
    return checks.manifest_violations(read_table(spark, d, "manifests"))


def run_checks(spark: SparkSession, d: str) -> DataFrame:
    """Parser runs that break the contract, by rule."""
    return checks.run_violations(read_table(spark, d, "parser_runs"))


def parser_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Which parsers succeeded on each version."""
    return audit.coverage(read_table(spark, d, "parser_runs"))


def artifact_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Artifacts by kind: number, bytes, unsafe paths."""
    a = read_table(spark, d, "parser_runs").select(F.inline("artifacts"))
    return a.groupBy("artifact_kind").agg(F.count("*").alias("n"), F.sum("byte_size").cast("bigint").alias("bytes"), F.count_if(~c.safe_path(F.col("relative_path"))).alias("unsafe"))


QUERIES = {f.__name__: f for f in (line_events, block_partition_check, reconstruct_text_sha, artifact_inventory, topk_examples, rollup_by_source, reference_ordinals, provenance_agreement, manifest_checks, run_checks, parser_coverage, artifact_kinds)}

_LINES = """
with pieces as (select doc_id, string_split(text, chr(10)) as p from documents where length(text) > 0),
rows as (select doc_id, unnest(p) as piece, generate_subscripts(p, 1) as k, len(p) as n from pieces),
whole as (select doc_id, k, case when k < n then piece || chr(10) else piece end as line from rows),
kept as (select * from whole where line <> ''),
events as (select doc_id, line, k - 1 as line_order, coalesce(sum(length(line)) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding), 0) as char_start,
  sum(length(line)) over (partition by doc_id order by k) as char_end from kept)
"""
_ROMAN = """case when upper(s) <> '' and regexp_full_match(upper(s), 'M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})') then cast(
  (length(upper(s)) - length(replace(upper(s), 'I', ''))) + 5 * (length(s) - length(replace(upper(s), 'V', ''))) + 10 * (length(s) - length(replace(upper(s), 'X', ''))) + 50 * (length(s) - length(replace(upper(s), 'L', '')))
  + 100 * (length(s) - length(replace(upper(s), 'C', ''))) + 500 * (length(s) - length(replace(upper(s), 'D', ''))) + 1000 * (length(s) - length(replace(upper(s), 'M', '')))
  - case when regexp_matches(upper(s), 'I[VX]') then 2 else 0 end - case when regexp_matches(upper(s), 'X[LC]') then 20 else 0 end - case when regexp_matches(upper(s), 'C[DM]') then 200 else 0 end as varchar) end"""

ORACLE_SQL = {
    "line_events": _LINES + "select doc_id, cast(line_order as bigint) as line_order, cast(char_start as bigint) as char_start, cast(char_end as bigint) as char_end, md5(line) as line_md5 from events",
    "block_partition_check": _LINES + """select doc_id, count(*) as lines, cast(min(char_start) as bigint) as first_start, cast(max(char_end) as bigint) as last_end, cast(sum(length(line)) as bigint) as characters, min(char_start) = 0 and sum(char_end - char_start) = max(char_end) and count(distinct char_start) = count(*) as gapless from events group by doc_id""",
    "reconstruct_text_sha": "select doc_id, sha256(text) as sha256 from documents where length(text) > 0",
    "artifact_inventory": "select doc_id, cast(octet_length(encode(text)) as bigint) as byte_size, sha256(text) as sha256 from documents where text is not null",
    "topk_examples": _LINES + """, ranked as (select coalesce(source, '(none)') as source, e.doc_id, cast(line_order as bigint) as line_order, cast(length(line) as bigint) as n,
      row_number() over (partition by coalesce(source, '(none)') order by length(line) desc, e.doc_id, line_order) as place from events e join documents d on e.doc_id = d.doc_id) select * from ranked where place <= 3""",
    "rollup_by_source": "select lang, source, cast(grouping(lang, source) as bigint) as level, count(*) as n, cast(sum(n_chars) as bigint) as characters from documents group by rollup (lang, source)",
    "reference_ordinals": f"""with n as (select *, lower(regexp_replace(trim(ordinal_raw), '^[.:-]+|[.:-]+$', '', 'g')) as s from ref_nodes),
      k as (select *, case when regexp_full_match(s, '\\d+[a-zđ]?') then s end as num, case when regexp_full_match(s, '[a-zđ]') then s end as letter, {_ROMAN} as roman from n),
      r as (select *, case when kind in ('part','chapter','section','subsection','appendix') then coalesce(num, roman) when kind in ('article','clause') then num when kind = 'point' then letter end as recomputed_key from k)
      select node_row_id, kind, ordinal_raw, recomputed_key, recomputed_key is not distinct from ordinal_key as agrees from r""",
    "provenance_agreement": """with m as (select document_id, version_id, max(sha256) as m_sha from manifests group by all),
      b as (select run_id, nullif(lower(trim(input_sha256)), '') as a, nullif(lower(trim(m_sha)), '') as b, nullif(lower(trim(parser)), '') as parser from parser_runs r left join m on r.document_id = m.document_id and r.version_id = m.version_id)
      select run_id, case when a is not null and b is not null and a <> b then null else coalesce(a, b) end as sha256, coalesce(a <> b, false) as sha_conflict, parser from b""",
    "manifest_checks": """with v as (select manifest_row_id, unnest([
        case when not coalesce(regexp_matches(landing_page_url, '^https://[^/\\s?#]+'), false) then 'landing_page_not_https' end, case when not coalesce(regexp_matches(asset_url, '^https://[^/\\s?#]+'), false) then 'asset_not_https' end,
        case when landing_page_url = asset_url then 'addresses_equal' end,
        case when not coalesce(artifact_filename <> '' and artifact_filename not in ('.', '..') and not regexp_matches(artifact_filename, '[/\\\\]') and not regexp_matches(artifact_filename, '^[A-Za-z]:'), false) then 'file_name_not_plain' end,
        case when not coalesce(regexp_full_match(sha256, '[0-9a-f]{64}'), false) then 'sha256_malformed' end, case when not coalesce(byte_size > 0, false) then 'size_not_positive' end,
        case when not coalesce(regexp_full_match(document_id, '[a-z0-9]+(-[a-z0-9]+)*'), false) then 'document_id_malformed' end, case when not coalesce(regexp_full_match(version_id, 'v[1-9][0-9]*'), false) then 'version_id_malformed' end,
        case when effective_on < issued_on then 'effective_before_issue' end]) as rule_id from manifests) select manifest_row_id, rule_id from v where rule_id is not null""",
    "run_checks": """with v as (select run_id, unnest([case when not coalesce(duration_seconds > 0, false) then 'duration_not_positive' end, case when coalesce(trim(parser_version), '') = '' then 'version_missing' end,
        case when not coalesce(regexp_full_match(input_sha256, '[0-9a-f]{64}'), false) then 'input_sha256_malformed' end,
        case when lower(trim(parser)) = 'marker' and not coalesce(parser_version = '2.0.0' and backend = 'fast-no-ocr' and run_mode = 'fast' and output_format = 'json' and disable_ocr, false) then 'marker_baseline' end,
        case when ingested_at < finished_at then 'ingested_before_finish' end,
        case when len(list_filter(artifacts, lambda a: coalesce(a.relative_path = '' or regexp_matches(a.relative_path, '\\\\|^/|^[A-Za-z]:|//|/$|(^|/)\\.{1,2}(/|$)'), true))) > 0 then 'artifact_path_unsafe' end]) as rule_id from parser_runs)
      select run_id, rule_id from v where rule_id is not null""",
    "parser_coverage": """select document_id, version_id, bool_or(lower(trim(parser)) = 'marker') as marker, bool_or(lower(trim(parser)) = 'mineru') as mineru from parser_runs where run_status = 'success' group by all""",
    "artifact_kinds": """with a as (select unnest(artifacts) as a from parser_runs) select a.artifact_kind as artifact_kind, count(*) as n, cast(sum(a.byte_size) as bigint) as bytes,
      count(*) filter (where coalesce(a.relative_path = '' or regexp_matches(a.relative_path, '\\\\|^/|^[A-Za-z]:|//|/$|(^|/)\\.{1,2}(/|$)'), true)) as unsafe from a group by 1""",
}
