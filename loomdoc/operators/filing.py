"""Rules for naming, placing and batching files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdoc.functions.names import INSTALLER_TYPES, PHOTO_TYPES, basename, depth_of, dirname, extension, is_id_document, junk_reason
from loomdoc.session import plan_bytes, written


def target_name(kind: Column, date: Column, code: Column, what: Column, path: Column, fallback_date: Column) -> Column:
    """The name that a file should have; null for those that keep theirs (installers, photos, code)."""
    day, ext = F.coalesce(date, fallback_date), extension(path)
    join = lambda *parts: F.concat(F.concat_ws("_", *parts), ext)
    return (
        F.when(kind.isin("installer", "photo", "code"), F.lit(None).cast("string"))
        .when(kind == "screenshot", join(day, F.lit("Screenshot"), what))
        .when(kind == "application", join(day, F.lit("BEW"), what))
        .when(kind == "form", join(F.lit("Vorlage"), what))
        .otherwise(join(day, code, what))
    )


def kind_of(path: Column) -> Column:
    """installer, photo, screenshot or document, by name."""
    name, ext = F.lower(basename(path)), extension(path)
    return F.when(ext.isin(*INSTALLER_TYPES), F.lit("installer")).when(name.startswith("screenshot") | name.startswith("bildschirmfoto"), F.lit("screenshot")).when(ext.isin(*PHOTO_TYPES), F.lit("photo")).otherwise(F.lit("document"))


def disposition(files: DataFrame) -> DataFrame:
    """path, disposition of (path, size, confidence): delete, unclear (ID documents too), keep_name or rename."""
    kind = kind_of(F.col("path"))
    return files.select("path", F.when(junk_reason(F.col("path"), F.col("size")).isNotNull(), F.lit("delete")).when(is_id_document(F.col("path")), F.lit("unclear")).when(kind.isin("installer", "photo"), F.lit("keep_name")).when(F.col("confidence") == "high", F.lit("rename")).otherwise(F.lit("unclear")).alias("disposition"))


def superseded_installers(files: DataFrame) -> DataFrame:
    """path, newest of installers with a newer version of the same software in their folder."""
    stem = F.regexp_replace(basename(F.col("path")), r"\.[^.]*$", "")
    version = F.transform(F.split(F.regexp_extract(stem, r"(\d+(?:\.\d+)*)", 1), r"\."), lambda x: F.expr("0") + F.coalesce(F.try_to_number(x, F.lit("999999999")).cast("int"), F.lit(0)))
    found = files.where(extension(F.col("path")).isin(*INSTALLER_TYPES)).select("path", dirname(F.col("path")).alias("folder"), F.lower(F.regexp_replace(stem, r"[-_ ]*v?\d.*$", "")).alias("software"), version.alias("version"))
    top = F.max(F.struct("version", "path")).over(Window.partitionBy("folder", "software"))
    return found.withColumn("top", top).where("version < top.version").select("path", F.col("top.path").alias("newest"))


def age_candidates(files: DataFrame, asof: Column) -> DataFrame:
    """Files unchanged for over 12 months: uncertain candidates only."""
    return files.where(F.col("mtime") < F.add_months(asof, -12)).withColumn("certainty", F.lit("uncertain"))


def too_deep(files: DataFrame, closed: DataFrame | None = None, most: int = 3) -> DataFrame:
    """path, depth of files over most folder levels; folders of closed (folder) are units and count once."""
    if closed is None:
        return files.select("path", depth_of(F.col("path")).alias("depth")).where(F.col("depth") > most)
    held = _prefixes(files).join(closed.select("folder").distinct(), "folder").groupBy("path").agg(F.min(F.char_length("folder")).alias("n"))
    unit = F.when(F.col("n").isNotNull(), F.substr("path", F.lit(1), F.col("n"))).otherwise(F.col("path"))
    return files.select("path").distinct().join(held, "path", "left").select("path", depth_of(unit).alias("depth")).where(F.col("depth") > most)


def _prefixes(files: DataFrame) -> DataFrame:
    """path, folder: each file with itself and every folder above it, so that folders are found by an equi-join, not a scan of all pairs."""
    parts = F.split("path", "/")
    return files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("folder"))


def without(files: DataFrame, excluded: DataFrame) -> DataFrame:
    """files that lie in no folder of excluded (folder)."""
    held = _prefixes(files).join(excluded.select("folder").distinct(), "folder").select("path").distinct()
    return files.join(held, "path", "left_anti")


def home_scheme(folders: DataFrame) -> DataFrame:
    """root, n, separator of roots (root, name) that hold numbered folders; the separator most of them have."""
    sep = F.regexp_extract("name", r"^\d+([_-]|\. )\S", 1)
    return folders.select("root", sep.alias("separator")).where("separator <> ''").groupBy("root").agg(F.count("*").alias("n"), F.mode("separator", True).alias("separator"))


def batches(files: DataFrame, size: int = 50) -> DataFrame:
    """path, batch: in order of type, size and mtime, size files a batch.

    Files are dealt by ranges of that order and ranked within their range, so that no task sorts all files, whatever they have in
    common; only the number of files of each range meets in one place.
    """
    order = ("ext", "size", "mtime", "path")
    ranges = max(8, min(1 << 14, plan_bytes(files) // (64 << 20)))
    # the id of a row is its partition, shifted, and its place there
    dealt = files.withColumn("ext", extension(F.col("path"))).select(*order).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    placed = written(dealt.withColumn("id", F.monotonically_increasing_id()), "ranges").select("path", F.shiftright("id", 33).alias("range"), F.col("id").bitwiseAND((1 << 33) - 1).alias("place"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return placed.join(F.broadcast(starts), "range").select("path", F.floor((F.col("base") + F.col("place")) / size).cast("long").alias("batch"))  # at most 1 << 14 rows
