"""Node objects whose fields drift from file to file, brought to one table, with a report of each file's changes.

Every file is parsed once into VARIANT and stays one row: field names and JSON types are collected per file with
higher-order functions, so there is no shuffle and a file with a third of all nodes is only a longer row.  The set of
names and types is the file's fingerprint.  It decides at which version the file enters the chain of migrations; from
there every step runs its rename, default and cast rules in turn and records each change that it makes.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The node fields of schema 4 and their JSON types.
SCHEMA_4: dict[str, str] = {
    "page_index": "integer",
    "pdf_page_number_1_based": "integer",
    "scored": "boolean",
    "kind": "string",
    "ordinal_raw": "string",
    "ordinal_key": "string",
    "ordinal_system": "string",
    "marker_text": "string",
    "title": "string",
    "canonical_path": "string",
    "parent_canonical_path": "string",
    "source_excerpt": "string",
    "visual_evidence_note": "string",
    "reference_instance_id": "string",
    "reference_record_id": "string",
    "parent_reference_instance_id": "string",
}

# Names under which earlier writers stored a field of schema 4, besides its camel-case form.
FORMER_NAMES: dict[str, tuple[str, ...]] = {
    "page_index": ("page_idx",),
    "pdf_page_number_1_based": ("pdf_page_number", "pdf_page", "page_number"),
    "scored": ("is_scored", "include_in_score", "counted"),
    "kind": ("node_kind", "node_type"),
    "ordinal_raw": ("raw_ordinal",),
    "ordinal_key": ("key_ordinal",),
    "ordinal_system": ("ordinal_scheme", "numbering_system"),
    "marker_text": ("marker", "heading_marker"),
    "title": ("heading_title", "node_title"),
    "canonical_path": ("path", "outline_path"),
    "parent_canonical_path": ("parent_path",),
    "source_excerpt": ("excerpt",),
    "visual_evidence_note": ("evidence_note",),
    "reference_instance_id": ("instance_id",),
    "reference_record_id": ("record_id", "ref_record"),
    "parent_reference_instance_id": ("parent_instance_id", "parent_ref"),
}


def _camel(name: str) -> str:
    return "".join(w if k == 0 else w.capitalize() for k, w in enumerate(name.split("_")))


@dataclass(frozen=True)
class Migration:
    """One step from a schema version to the next: renames, then defaults for fields that are missing, then casts.

    ``renames`` go from a name in lower case with underscores, or from a name as it stands; a name counts in any case
    and with hyphens or blanks for underscores.
    """

    source: int
    target: int
    renames: dict[str, str] = field(default_factory=dict)
    defaults: tuple[str, ...] = ()
    casts: dict[str, str] = field(default_factory=dict)


# The fields that version 3 added to version 2, and version 4 to version 3.
NEW_IN = {3: ("ordinal_system", "reference_instance_id"), 4: ("reference_record_id", "parent_reference_instance_id")}


def _step(source: int) -> Migration:
    """The step from ``source``: it knows the former names and spellings of the fields of its target that earlier steps do not."""
    own = [f for f in SCHEMA_4 if f not in NEW_IN[3] + NEW_IN[4]] if source == 1 else NEW_IN[source + 1]
    renames = {old: new for new in own for old in (new, *FORMER_NAMES[new], _camel(new))}
    return Migration(source, source + 1, renames, tuple(own), SCHEMA_4 if source == 3 else {})


#: The chain.  Version 1 stands for writers with names of their own.
MIGRATIONS = tuple(map(_step, (1, 2, 3)))


def version_fields(version: int) -> frozenset[str]:
    """The fields that a version knows: the target's, less what later steps add."""
    return frozenset(SCHEMA_4) - {f for v, new in NEW_IN.items() if v > version for f in new}


def _json_type(value: Column) -> Column:
    """integer, number, boolean, string, array, object or null."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind == "VOID", "null")
        .when(kind == "BIGINT", "integer")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind == "STRING", "string")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind.startswith("OBJECT"), "object")
        .otherwise("number")
    )


def parse_files(files: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, nodes, fields, fingerprint) of every readable file; cut-off or broken text gives no row.

    ``nodes`` is array<map<string, variant>>; ``fields`` lists each distinct (name, json type), and ``fingerprint`` is
    its hash.  A file without pages or nodes has empty arrays.  Null and empty text is unreadable.  Of a key repeated in
    an object the last value counts, as usual for JSON readers.
    """
    files.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    tree = files.select(F.col(key).alias("file_key"), F.try_parse_json(F.col(raw)).alias("tree")).where(F.col("tree").isNotNull())
    pages = F.coalesce(F.try_variant_get("tree", "$.audited_pages", "array<struct<nodes:array<map<string,variant>>>>"), F.array())
    nodes = tree.select("file_key", F.flatten(F.transform(pages, lambda p: F.coalesce(p["nodes"], F.array()))).alias("nodes")).select(
        "file_key", F.filter("nodes", lambda n: n.isNotNull()).alias("nodes")
    )
    entries = F.flatten(F.transform("nodes", lambda n: F.transform(F.map_entries(n), lambda e: F.struct(e["key"].alias("name"), _json_type(e["value"]).alias("type")))))
    named = nodes.select("file_key", "nodes", F.array_sort(F.array_distinct(entries)).alias("fields"))
    return named.select("file_key", "nodes", "fields", F.sha2(F.to_json("fields"), 256).alias("fingerprint"))


def _table(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in sorted(values.items()) for x in pair)) if values else F.create_map().cast("map<string,string>")


def _snake(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"), "[- ]", "_"))


def _renamed_to(renames: Column, name: Column) -> Column:
    """The name that a table of renames gives to a field, or null if none of its rules is for it."""
    return F.nullif(F.coalesce(F.try_element_at(renames, name), F.try_element_at(renames, _snake(name))), name)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


_CHANGES = "array<struct<from_version:int,to_version:int,field_name:string,change_kind:string,was:string>>"


def _change(step: Column, name: Column, kind: str, was: Column) -> Column:
    return F.struct(step["source"].alias("from_version"), step["target"].alias("to_version"), name.alias("field_name"), F.lit(kind).alias("change_kind"), was.cast("string").alias("was"))


def _run(state: Column, step: Column) -> Column:
    """One step on one file; state: fields (name, now, type, given), log, and the version at which the file entered."""
    nothing = F.lit(None).cast("string")

    def rename(fields: Column) -> Column:
        """A field's own name goes before a former one, which then stays a field of its own."""

        def offered(names: Column) -> Column:
            return F.transform(fields, lambda f: _let(_renamed_to(step["renames"], f["now"]), lambda to: F.struct(f["name"].alias("name"), F.coalesce(F.when(~F.array_contains(names, to), to), f["now"]).alias("now"), f["type"].alias("type"), f["given"].alias("given"), f["now"].alias("was"))))

        return _let(F.transform(fields, lambda f: f["now"]), offered)

    def finish(moved: Column) -> Column:
        lacking = F.array_except(step["defaults"], F.transform(moved, lambda f: f["now"]))

        def log(missing: Column) -> Column:
            renamed = F.transform(F.filter(moved, lambda f: f["now"] != f["was"]), lambda f: _change(step, f["now"], "renamed", f["was"]))
            removed = F.transform(missing, lambda c: _change(step, c, "removed", nothing))
            other = F.filter(moved, lambda f: (f["type"] != "null") & (f["type"] != F.try_element_at(step["casts"], f["now"])))
            retyped = F.transform(other, lambda f: _change(step, f["now"], "retyped", f["type"]))
            kept = F.transform(moved, lambda f: F.struct(f["name"].alias("name"), f["now"].alias("now"), f["type"].alias("type"), f["given"].alias("given")))
            new = F.transform(missing, lambda c: F.struct(c.alias("name"), c.alias("now"), F.lit("null").alias("type"), F.lit(False).alias("given")))
            return _let(
                F.array_distinct(F.concat(renamed, removed, retyped)),
                lambda made: F.struct(F.concat(kept, new).alias("fields"), F.concat(state["log"], made).alias("log"), F.coalesce(state["version"], F.when(F.size(made) > 0, step["source"])).alias("version")),
            )

        return _let(lacking, log)

    return _let(rename(state["fields"]), finish)


def fingerprint_of(fields: dict[str, str]) -> str:
    """The fingerprint of a file whose nodes have these names and types throughout."""
    entries = sorted(fields.items())
    return hashlib.sha256(json.dumps([{"name": n, "type": t} for n, t in entries], ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def known_fingerprints() -> dict[str, int]:
    """The fingerprints of the versions themselves, which route a file without a look at its fields."""
    return {fingerprint_of({n: t for n, t in SCHEMA_4.items() if n in version_fields(v)}): v for v in (2, 3, 4)}


def migrate(parsed: DataFrame) -> DataFrame:
    """Files taken through the chain: (file_key, nodes, fingerprint, fields, log, version).

    ``version`` is the source of the first step that a file runs: that of its fingerprint where a version has just this
    one, else of the first step that finds work to do; 4 if none.  ``fields`` has each name, the name it has now, the JSON type
    and whether the file gives it; ``log`` every change by step, and at the end the fields that no version knows, as added.
    """
    known = F.try_element_at(F.create_map(*(F.lit(x) for pair in known_fingerprints().items() for x in pair)), F.col("fingerprint"))
    chain = F.array(*(F.struct(F.lit(m.source).alias("source"), F.lit(m.target).alias("target"), _table(m.renames).alias("renames"), F.array(*map(F.lit, m.defaults)).alias("defaults"), _table(m.casts).alias("casts")) for m in MIGRATIONS))
    routed = F.filter(chain, lambda step: F.coalesce(known <= step["source"], F.lit(True)))
    start = F.struct(F.transform("fields", lambda f: F.struct(f["name"].alias("name"), f["name"].alias("now"), f["type"].alias("type"), F.lit(True).alias("given"))).alias("fields"), F.array().cast(_CHANGES).alias("log"), F.lit(None).cast("int").alias("version"))
    done = parsed.select("file_key", "nodes", "fingerprint", F.aggregate(routed, start, _run).alias("_state"))
    last = F.struct(F.lit(MIGRATIONS[-1].source).alias("source"), F.lit(MIGRATIONS[-1].target).alias("target"))
    extra = F.transform(F.filter("_state.fields", lambda f: ~f["now"].isin(list(SCHEMA_4))), lambda f: _change(last, f["now"], "added", F.lit(None)))
    return done.select("file_key", "nodes", "fingerprint", F.col("_state.fields").alias("fields"), F.concat("_state.log", F.array_distinct(extra)).alias("log"), F.coalesce("_state.version", F.lit(4)).alias("version"))


def steps(files: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, from_version, to_version, field_name, change_kind, was): every change that a step of the chain made to a file."""
    return migrate(parse_files(files, key, raw).where(F.size("nodes") > 0)).select(F.col("file_key").alias(key), F.inline("log"))


def changes(files: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, field_name, change_kind) against schema 4 for every readable file with at least one node: what the chain recorded.

    renamed: only under another name; removed: under no name; retyped: a non-null value of another JSON type; added: a
    field that stands for none of schema 4.  A former name beside the field's own is an addition.  Order, nulls and
    fields missing from only some nodes are no change.  No row for unreadable files, files without nodes, and no files.
    """
    logged = migrate(parse_files(files, key, raw).where(F.size("nodes") > 0))
    return logged.select(F.col("file_key").alias(key), F.inline(F.array_distinct(F.transform("log", lambda x: F.struct(x["field_name"].alias("field_name"), x["change_kind"].alias("change_kind"))))))


def _as_text(v: Column) -> Column:
    """A string of any JSON value: an array's items joined by spaces, an object's value, code or id, else its JSON text."""
    kind = F.schema_of_variant(v)
    member = F.coalesce(*(F.try_variant_get(v, f"$.{m}", "string") for m in ("value", "code", "id", "text", "name")))
    return (
        F.when(kind.startswith("ARRAY"), F.array_join(F.try_variant_get(v, "$", "array<string>"), " "))
        .when(kind.startswith("OBJECT"), F.coalesce(member, F.to_json(v)))
        .otherwise(F.try_variant_get(v, "$", "string"))
    )


def _cast(v: Column, kind: str) -> Column:
    if kind == "integer":
        text = F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$[0]", "string")).otherwise(F.try_variant_get(v, "$", "string"))
        return text.try_cast("bigint")
    if kind == "boolean":
        text = F.lower(_as_text(v))
        return F.when(text.isin("true", "yes", "1"), True).when(text.isin("false", "no", "0"), False)
    return _as_text(v)


def consistent_nodes(files: DataFrame, key: str, raw: str) -> DataFrame:
    """One row per node of every readable file in the types of schema 4, with its place in the file.

    Columns: key, node_position (0-based), fingerprint, then the schema's fields.  Values that cannot be cast are null.
    Names are taken as in the report of changes, a field's own name first.  ``other_fields`` has, as JSON by the file's
    name, every value that is none of the schema's, and a former name's beside the field's own.
    """
    migrated = migrate(parse_files(files, key, raw))
    # in a node without the field's own name a former one gives the value, also where other nodes of the file have the own one
    every = _table({old: new for step in MIGRATIONS for old, new in step.renames.items()})
    known = F.transform(F.filter("fields", lambda f: f["given"]), lambda f: F.struct(f["name"].alias("name"), F.coalesce(_renamed_to(every, f["name"]), f["now"]).alias("now")))
    migrated = migrated.withColumn("fields", known)
    standing = lambda c: F.filter("fields", lambda f: f["now"] == c)
    alias = lambda c: F.array_distinct(F.transform(F.concat(F.filter(standing(c), lambda f: f["name"] == c), standing(c)), lambda f: f["name"]))
    named = migrated.select("file_key", "fingerprint", "nodes", *(alias(c).alias(f"_names_{c}") for c in SCHEMA_4))
    nodes = named.select("file_key", "fingerprint", *(f"_names_{c}" for c in SCHEMA_4), F.posexplode("nodes").alias("node_position", "node"))
    given = lambda n: F.try_element_at("node", n).isNotNull() & (F.schema_of_variant(F.try_element_at("node", n)) != "VOID")
    chosen = nodes.select("file_key", "fingerprint", "node_position", "node", *(F.try_element_at(F.filter(f"_names_{c}", given), F.lit(1)).alias(f"_name_{c}") for c in SCHEMA_4))
    values = [F.when(F.col(f"_name_{c}").isNotNull(), _cast(F.try_element_at("node", F.col(f"_name_{c}")), kind)).alias(c) for c, kind in SCHEMA_4.items()]
    used = F.array_compact(F.array(*(f"_name_{c}" for c in SCHEMA_4)))
    rest = F.transform_values(F.map_filter("node", lambda k, v: ~F.array_contains(used, k) & (F.schema_of_variant(v) != "VOID")), lambda _, v: F.to_json(v))
    return chosen.select(F.col("file_key").alias(key), "node_position", "fingerprint", *values, rest.alias("other_fields"))


def file_versions(files: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, true_version, entered_at, node_count, fingerprint) of every readable file.

    ``true_version`` is the earliest version whose fields cover what a file has of schema 4 after renaming;
    ``entered_at`` the version at which its fingerprint sends it into the chain.
    """
    migrated = migrate(parse_files(files, key, raw))
    has = F.transform(F.filter("fields", lambda f: f["given"] & f["now"].isin(list(SCHEMA_4))), lambda f: f["now"])
    covered = lambda v: F.size(F.array_except(has, F.array(*map(F.lit, sorted(version_fields(v)))))) == 0
    version = F.when(covered(2), 2).when(covered(3), 3).otherwise(4)
    return migrated.select(F.col("file_key").alias(key), version.alias("true_version"), F.col("version").alias("entered_at"), F.size("nodes").alias("node_count"), "fingerprint")
