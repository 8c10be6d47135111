"""Scalar operators as native column expressions: ordinals, agreement, identifiers, kinds, boxes, assets, paths."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Regex flags under which Java patterns treat case, classes and line ends as Python's do.
UNICODE = "(?iuUd)"
# Blanks that Python's str.strip removes.
STRIP = "[\\s\\x1c-\\x1f\\x85\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"
_FULL_WIDTH, _ASCII = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F)))


def strip(c: Column) -> Column:
    """Without outer white space of any kind; null stays null."""
    return F.regexp_replace(F.regexp_replace(c, f"^{STRIP}", ""), f"{STRIP}$", "")


def casefold(c: Column) -> Column:
    """Lower case, with the letters folded that lower case leaves apart (sharp s, final sigma)."""
    return F.replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def detection_text(c: Column) -> Column:
    """Text for detection: full-width forms as ASCII, runs of blanks as one, outer blanks off; line feeds stay.

    Full compatibility forms (NFKC) need Python and are applied inside the extractor.
    """
    return strip(F.regexp_replace(F.translate(c, _FULL_WIDTH + "\u00a0", _ASCII + " "), "[\\t\\f\\x0b ]+", " "))


# ---------------------------------------------------------------- ordinals
def _bare_ordinal(raw: Column) -> Column:
    return casefold(F.regexp_replace(detection_text(raw), "^[.:-]+|[.:-]+$", ""))


def roman_key(raw: Column) -> Column:
    """The decimal key of a canonical Roman numeral 1 .. 3999, else null."""
    s = F.upper(_bare_ordinal(raw))
    strict = s.rlike("^M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$") & (s != "")
    count = lambda ch: F.length(s) - F.length(F.replace(s, F.lit(ch), F.lit("")))
    total = reduce(lambda a, b: a + b, (count(ch) * n for ch, n in (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100), ("D", 500), ("M", 1000))))
    for pair, less in (("I[VX]", 2), ("X[LC]", 20), ("C[DM]", 200)):
        total = total - F.when(s.rlike(pair), less).otherwise(0)
    return F.when(strict, total.cast("string"))


def number_key(raw: Column) -> Column:
    """Digits with at most one letter after them (article, clause), else null."""
    s = _bare_ordinal(raw)
    return F.when(s.rlike("^\\d+[a-zđ]?$"), s)


def letter_key(raw: Column) -> Column:
    """One letter (point, generic letter), never Roman, else null."""
    s = _bare_ordinal(raw)
    return F.when(s.rlike("^[a-zđ]$"), s)


def container_key(raw: Column) -> Column:
    """A formal container's number or Roman numeral."""
    return F.coalesce(number_key(raw), roman_key(raw))


def decimal_key(raw: Column) -> Column:
    """Dotted digits, else null."""
    s = _bare_ordinal(raw)
    return F.when(s.rlike("^\\d+(\\.\\d+)*$"), s)


def key_for_system(system: Column, raw: Column) -> Column:
    """The one key that an ordinal system allows for a raw ordinal; null for none, unknown systems and null ordinals."""
    return (
        F.when(system == "formal_container", container_key(raw))
        .when(system.isin("article", "clause"), number_key(raw))
        .when(system.isin("point", "generic_letter"), letter_key(raw))
        .when(system.isin("generic_roman", "roman"), roman_key(raw))
        .when(system == "generic_decimal", decimal_key(raw))
    )


def system_of(kind: Column, method: Column) -> Column:
    """The ordinal system of a node kind and the method that recognised it."""
    return (
        F.when(kind.isin("part", "chapter", "section", "subsection", "appendix"), "formal_container")
        .when(kind.isin("article", "clause", "point"), kind)
        .when((kind == "generic_section") & method.isin("generic_roman_heading", "generic_letter_heading", "generic_decimal_heading"), F.replace(method, F.lit("_heading"), F.lit("")))
        .when(kind == "document", "none")
    )


# ---------------------------------------------------------------- provenance
def agreement(candidates: Sequence[Column], lower: bool = False) -> Column:
    """struct(value, conflict): the one value that all non-blank candidates share.

    Null and blank candidates say nothing; without any the value is null; different ones are a conflict with null value.
    """
    clean = [strip(c.cast("string")) for c in candidates]
    said = F.array_distinct(F.filter(F.array(*[F.lower(c) if lower else c for c in clean]), lambda x: x.isNotNull() & (x != "")))
    return F.struct(F.when(F.size(said) == 1, said[0]).alias("value"), (F.size(said) > 1).alias("conflict"))


def block_id(document: Column, version: Column, page: Column, order: Column) -> Column:
    """document_version_p0000_b0000."""
    return F.format_string("%s_%s_p%04d_b%04d", document, version, page, order)


def baseline_ok(parser_version: Column, backend: Column, mode: Column, output_format: Column, disable_ocr: Column) -> Column:
    """Whether a nested-tree run is of the supported baseline; nulls are not."""
    return F.coalesce((parser_version == "2.0.0") & (backend == "fast-no-ocr") & (mode == "fast") & (output_format == "json") & disable_ocr, F.lit(False))


# ---------------------------------------------------------------- kinds
def list_kind(raw_type: Column, level: Column, generation: int) -> Column:
    """Block kind of a flat-list item: text or title by its level, header, page number; later also table and image."""
    kind = F.when((raw_type == "text") & level.isNotNull(), "title").when(raw_type == "text", "text").when(raw_type.isin("header", "page_number"), raw_type)
    return (kind.when(raw_type.isin("table", "image"), raw_type) if generation else kind).otherwise("unknown")


def list_disposition(raw_type: Column, generation: int) -> Column:
    """content, discarded or unknown for a flat-list item."""
    content = ("text", "table", "image") if generation else ("text",)
    return F.when(raw_type.isin(*content), "content").when(raw_type.isin("header", "page_number"), "discarded").otherwise("unknown")


def tree_kind(raw_type: Column, generation: int) -> Column:
    """Block kind of a nested-tree block."""
    kind = F.when(raw_type == "Text", "text").when(raw_type == "SectionHeader", "title").when(raw_type == "PageHeader", "header")
    return (kind.when(raw_type == "Table", "table").when(raw_type == "Figure", "figure").when(raw_type == "Picture", "image") if generation else kind).otherwise("unknown")


def tree_disposition(raw_type: Column) -> Column:
    """Page headers and footers are discarded, all else is content."""
    return F.when(raw_type.isin("PageHeader", "PageFooter"), "discarded").otherwise("content")


def category(kind: Column, generation: int = 1) -> Column:
    """Evaluation category of a block kind: title counts as heading; kinds without a category are unknown."""
    same = ("text", "header", "page_number", "table", "figure") if generation else ("text", "header", "page_number")
    return F.when(kind == "title", "heading").when(kind.isin(*same), kind).otherwise("unknown")


# ---------------------------------------------------------------- boxes
def projected(value: Column, origin: Column, extent: Column) -> Column:
    """A coordinate on the 0 .. 1000 scale of its page, to 6 places; overshoots up to 1e-6 snap, larger ones are null."""
    x = F.round(F.try_divide(value - origin, extent) * 1000, 6)
    snapped = F.when((x < 0) & (x >= -1e-6), 0.0).when((x > 1000) & (x <= 1000 + 1e-6), 1000.0).otherwise(x)
    return F.when((extent > 0) & snapped.between(0, 1000), snapped + 0.0)


def box_ok(x0: Column, y0: Column, x1: Column, y1: Column, strict: bool = False) -> Column:
    """Ordered within 0 .. 1000; ``strict`` forbids empty boxes.  Nulls and NaN are not."""
    inside = reduce(lambda a, b: a & b, (c.between(0, 1000) & ~F.isnan(c) for c in (x0, y0, x1, y1)))
    order = (x0 < x1) & (y0 < y1) if strict else (x0 <= x1) & (y0 <= y1)
    return F.coalesce(inside & order, F.lit(False))


def iou(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Intersection over union of two boxes (x0, y0, x1, y1); 0.0 where the union is empty."""
    width = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    height = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    overlap = width * height
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - overlap
    return F.when(union > 0, F.try_divide(overlap, union)).otherwise(0.0)


# ---------------------------------------------------------------- assets and paths
def image_type(data: Column) -> Column:
    """Media type by signature: JPEG, PNG, GIF or WEBP, else null."""
    h = F.hex(F.substring(data, 1, 12))
    return (
        F.when(h.startswith("FFD8FF"), "image/jpeg")
        .when(h.startswith("89504E470D0A1A0A"), "image/png")
        .when(h.startswith("474946383761") | h.startswith("474946383961"), "image/gif")
        .when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), "image/webp")
    )


def strict_base64(text: Column) -> Column:
    """The bytes of strictly written base64 (alphabet and padding), else null."""
    ok = text.rlike("^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$") & (text != "")
    return F.when(ok, F.try_to_binary(text, F.lit("base64")))


def safe_path(path: Column) -> Column:
    """Whether a path is a safe relative POSIX path: no backslash, root, drive, empty, "." or ".." part."""
    bad = path.rlike(r"\\|^/|^[A-Za-z]:|//|/$|(^|/)\.{1,2}(/|$)") | (path == "")
    return F.coalesce(~bad, F.lit(False))


def plain_file_name(name: Column) -> Column:
    """A file name without any directory part."""
    return F.coalesce((name != "") & ~name.isin(".", "..") & ~name.rlike(r"[/\\]") & ~name.rlike("^[A-Za-z]:"), F.lit(False))


def https_url(url: Column) -> Column:
    """An absolute https address."""
    return F.coalesce(url.rlike(r"^https://[^/\s?#]+"), F.lit(False))


def asset_problem(storage: Column, path: Column, media: Column, sha: Column, size: Column) -> Column:
    """Why visual evidence breaks the storage contract, or null."""
    return (
        F.when(sha.isNull() != size.isNull(), "hash_without_size")
        .when((storage == "relative_file") & (path.isNull() | sha.isNull()), "file_without_path_or_hash")
        .when((storage == "embedded_raw") & path.isNotNull(), "embedded_with_path")
        .when((storage == "embedded_raw") & (media.isNull() | sha.isNull()), "embedded_without_evidence")
        .when((storage == "unavailable") & F.coalesce(path, media, sha, size.cast("string")).isNotNull(), "unavailable_with_evidence")
        .when(path.isNotNull() & ~safe_path(path), "unsafe_path")
        .when(~storage.isin("relative_file", "embedded_raw", "unavailable") | storage.isNull(), "unknown_storage")
    )
