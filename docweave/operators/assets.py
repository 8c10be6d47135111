"""Visual evidence: embedded images decoded and fingerprinted, relative paths joined to retained files; all native."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions import columns as c

ASSET = "struct<storage_kind:string,relative_path:string,media_type:string,sha256:string,byte_size:bigint>"


def embedded(images: DataFrame, keys: list[str], encoded: str) -> DataFrame:
    """(keys, asset, problem) of embedded base64 images.

    ``problem``: not_base64 (alphabet or padding), empty, or unknown_signature; ``asset`` is null then.  Null text is no
    embedded image: its evidence is unavailable.
    """
    data = c.strict_base64(F.col(encoded))
    media = c.image_type(data)
    problem = F.when(F.col(encoded) == "", "empty").when(F.col(encoded).isNotNull() & data.isNull(), "not_base64").when(F.col(encoded).isNotNull() & media.isNull(), "unknown_signature")
    none = F.struct(F.lit("unavailable").alias("storage_kind"), *(F.lit(None).cast(t).alias(n) for n, t in (("relative_path", "string"), ("media_type", "string"), ("sha256", "string"), ("byte_size", "bigint"))))
    found = F.struct(F.lit("embedded_raw").alias("storage_kind"), F.lit(None).cast("string").alias("relative_path"), media.alias("media_type"), F.sha2(data, 256).alias("sha256"), F.length(data).cast("bigint").alias("byte_size"))
    return images.select(*keys, F.when(F.col(encoded).isNull(), none).when(problem.isNull(), found).cast(ASSET).alias("asset"), problem.alias("problem"))


def _resolved(path: str) -> str:
    """SQL for a path with "." and empty parts gone; safe paths have none, directories may."""
    return f"array_join(filter(split({path}, '/'), p -> p not in ('', '.')), '/')"


def relative(items: DataFrame, keys: list[str], path: str, directory: str, files: DataFrame) -> DataFrame:
    """(keys, asset, problem) of parser-relative image paths against the files retained below the raw directory.

    ``directory`` is the referring directory's column, relative to the raw directory; ``files`` has file_path (relative to
    the raw directory), content.  ``problem``: unsafe_path or empty_file.  A missing file, and a null path, are
    unavailable.  Files are looked up by an equi-join on the path.
    """
    safe = c.safe_path(F.col(path))
    wanted = items.select(*keys, F.col(path).alias("_path"), F.when(safe, F.expr(_resolved(f"concat_ws('/', `{directory}`, `{path}`)"))).alias("_file"), safe.alias("_safe"))
    have = files.select(F.expr(_resolved("file_path")).alias("_file"), c.image_type(F.col("content")).alias("_media"), F.sha2("content", 256).alias("_sha"), F.length("content").cast("bigint").alias("_size"))
    both = wanted.join(have, "_file", "left")
    problem = F.when(F.col("_path").isNotNull() & ~F.col("_safe"), "unsafe_path").when(F.col("_size") == 0, "empty_file")
    there = problem.isNull() & F.col("_size").isNotNull()
    asset = F.struct(
        F.when(there, "relative_file").otherwise("unavailable").alias("storage_kind"), F.when(there, F.col("_file")).alias("relative_path"), F.when(there, F.col("_media")).alias("media_type"),
        F.when(there, F.col("_sha")).alias("sha256"), F.when(there, F.col("_size")).alias("byte_size"),
    )
    return both.select(*keys, F.when(problem.isNull(), asset).cast(ASSET).alias("asset"), problem.alias("problem"))


def contract_violations(assets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rule_id): assets that break the storage contract."""
    a = F.col("asset")
    broken = c.asset_problem(a["storage_kind"], a["relative_path"], a["media_type"], a["sha256"], a["byte_size"])
    return assets.where(a.isNotNull()).select(*keys, broken.alias("rule_id")).where("rule_id is not null")
