"""Manifest checks and records, triage, the redundancy loop, free names, undo plans."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomdoc.functions.names import basename, is_state_file, is_under, junk_reason
from loomdoc.operators.components import components
from loomdoc.operators.dedupe import SALTS, known_hashes, newest
from loomdoc.session import written

MOST_PASSES = 3


def manifest_check(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """path, hash, done, target for files against the manifest's latest entries (hash, ziel)."""
    seen = manifest.select("hash", F.col("ziel").alias("target"), F.lit(True).alias("seen"))
    return files.select("path", "hash").join(seen, "hash", "left").select("path", "hash", F.col("seen").isNotNull().alias("done"), "target")


def manifest_record(files: DataFrame, manifest: DataFrame, action: str = "verschoben") -> DataFrame:
    """hash, path, name, action to append: files that the manifest doesn't have, the first path of each hash."""
    fresh = files.groupBy("hash").agg(F.min("path").alias("path")).join(manifest.select("hash").distinct(), "hash", "left_anti")
    return fresh.select("hash", "path", basename(F.col("path")).alias("name"), F.lit(action).alias("action"))


def triage(files: DataFrame, manifest: DataFrame, queue: DataFrame, home: DataFrame, quarantine: str | None = None) -> DataFrame:
    """path, hash, size, verdict, reason, n_hits, first_hit for each file; a null hash is a file that couldn't be read.

    In this order: state (left alone), unreadable, manifest, junk, queue, then duplicate (home has it) or content; of several new
    files with one hash the first path is queued and the others are 'queue'. What is known of a hash is one row, and so is the first
    path of a new one; files join them by hash and salt, so that a hash which many files have is nobody's alone.
    """
    quarantined = is_under(F.col("path"), F.lit(quarantine)) if quarantine else F.lit(False)
    known = lambda df, name: df.select("hash").distinct().withColumn(name, F.lit(True))
    seen = files.where("hash is not null").groupBy("hash").agg(F.count("*").alias("n_files"))
    about = seen.join(known(manifest, "in_manifest"), "hash", "left").join(known(queue, "in_queue"), "hash", "left").join(known_hashes(home), "hash", "left")
    f = salted(files, about)
    reason = junk_reason(F.col("path"), F.col("size"))
    verdict = (
        F.when(quarantined | is_state_file(F.col("path")), F.lit("state"))
        .when(F.col("hash").isNull(), F.lit("unreadable"))
        .when(F.col("in_manifest"), F.lit("manifest"))
        .when(reason.isNotNull(), F.lit("junk"))
        .when(F.col("in_queue"), F.lit("queue"))
        .when(F.col("n_hits").isNotNull(), F.lit("duplicate"))
        .otherwise(F.lit("content"))
    )
    judged = f.withColumn("verdict", verdict)
    fresh = F.col("verdict").isin("duplicate", "content")
    first = judged.where(fresh).groupBy("hash").agg(F.min("path").alias("first_path"))
    ranked = salted(judged, first).withColumn("verdict", F.when(fresh & (F.col("path") != F.col("first_path")), F.lit("queue")).otherwise(F.col("verdict")))
    kept = F.col("verdict") == "duplicate"
    return ranked.select("path", "hash", "size", "verdict", F.when(F.col("verdict") == "junk", reason).alias("reason"), F.when(kept, F.col("n_hits")).alias("n_hits"), F.when(kept, F.col("first_hit")).alias("first_hit"))


def salted(files: DataFrame, about: DataFrame) -> DataFrame:
    """files with the columns of about, a row for each hash, or nulls; many files of one hash, or of none, are split by salts."""
    dealt = files.withColumn("__salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int"))
    return dealt.join(about.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["hash", "__salt"], "left").drop("__salt")


def free_names(moves: DataFrame, taken: DataFrame, style: str = " ({n})") -> DataFrame:
    """folder, name, seq, target: names that are free in folder, by seq; (folder, name) pairs of taken exist already.

    The k-th file of a name takes the k-th free form of stem, stem + style(1), ..; the extension stays.
    """
    before, after = style.split("{n}")
    stem, ext = F.regexp_replace("name", r"(?<=.)\.[^.]*$", ""), F.regexp_extract("name", r"^.+?(\.[^.]*)$", 1)
    rank = F.row_number().over(Window.partitionBy("folder", "name").orderBy("seq"))
    asked = moves.select("folder", "name", "seq", stem.alias("stem"), ext.alias("ext"), rank.alias("rank"))
    # at most as many forms as there are names taken in the folder, and one for each file
    most = taken.groupBy("folder").agg(F.count("*").alias("n_taken"))
    groups = asked.groupBy("folder", "name", "stem", "ext").agg(F.max("rank").alias("n")).join(most, "folder", "left")
    forms = groups.select("folder", "name", "stem", "ext", F.explode(F.sequence(F.lit(0), F.col("n") + F.coalesce("n_taken", F.lit(0)))).alias("i"))
    form = F.when(F.col("i") == 0, F.col("name")).otherwise(F.concat("stem", F.lit(before), F.col("i").cast("string"), F.lit(after), "ext"))
    free = forms.withColumn("target", form).join(taken.select("folder", F.col("name").alias("target")), ["folder", "target"], "left_anti")
    free = free.withColumn("rank", F.row_number().over(Window.partitionBy("folder", "name").orderBy("i"))).select("folder", "name", "rank", "target")
    return asked.join(free, ["folder", "name", "rank"]).select("folder", "name", "seq", "target")


def scan_for_redundancy(files: DataFrame, quarantine: str, log: str | None = None) -> DataFrame:
    kept = files.where(~is_under(F.col("path"), F.lit(quarantine)))
    return kept.where(F.col("path") != log) if log else kept


def redundancy_passes(files: DataFrame, quarantine: str, most: int = MOST_PASSES, apply: bool = True) -> tuple[DataFrame, DataFrame, bool]:
    """(moves: pass, path, keep, target; what stays; whether a pass found nothing). Loops until no losers or most passes."""
    left, moves, stable = scan_for_redundancy(files, quarantine), None, False
    for n in range(1, most + 1):
        roles = newest(left)
        keep = roles.where("role = 'keep'").select("hash", F.col("path").alias("keep"))
        losers = roles.where("role = 'loser'").join(keep, "hash").select(F.lit(n).alias("pass"), "path", "keep", F.concat(F.lit(quarantine + "/"), "path").alias("target"))
        if losers.limit(1).count() == 0:
            stable = True
            break
        moves = losers if moves is None else moves.unionByName(losers)
        if not apply:
            break
        left = left.join(losers.select("path"), "path", "left_anti")
    if moves is None:
        moves = files.sparkSession.createDataFrame([], "pass int, path string, keep string, target string")
    return moves, left, stable


def undo_plan(log: DataFrame, exists: DataFrame) -> DataFrame:
    """seq, alt, neu, aktion, status for the rows of a log, to be undone from the last seq on.

    The state of the file system is the paths of exists, changed by the steps that are planned before. A step reads and changes only
    its own two paths, so steps depend on each other only through paths they share: each chain (component of shared paths) is folded
    by itself. Steps of one chain depend on the ones before and meet in one task; steps that share no path are no fold at all.
    """
    rows = log.select("seq", "alt", "neu", "aktion")
    node = lambda c: F.xxhash64(c)  # noqa: E731 - equal hashes only join two chains, which changes no status
    ends = rows.select(F.explode(F.array_distinct(F.array("alt", "neu"))).alias("p"))
    shared = ends.groupBy("p").agg(F.count("*").alias("n")).where("n > 1").select("p")
    touches = rows.join(shared.select(F.col("p").alias("alt"), F.lit(True).alias("a")), "alt", "left").join(shared.select(F.col("p").alias("neu"), F.lit(True).alias("b")), "neu", "left")
    steps = written(touches.select("seq", "alt", "neu", "aktion", (F.col("a").isNotNull() | F.col("b").isNotNull()).alias("chained")), "steps")
    there = exists.select(F.col("path").alias("p")).distinct()

    has = lambda c: there.select(F.col("p").alias(c), F.lit(True).alias(f"has_{c}"))
    alone = steps.where("not chained").join(has("alt"), "alt", "left").join(has("neu"), "neu", "left")
    status = F.when(F.col("alt").eqNullSafe(F.col("neu")), F.lit("identisch")).when(F.col("has_neu").isNull(), F.lit("quelle_fehlt")).when(F.col("has_alt").isNotNull(), F.lit("ziel_belegt")).otherwise(F.lit("bereit"))
    alone = alone.select("seq", "alt", "neu", "aktion", status.alias("status"))

    chained = steps.where("chained")
    part = components(chained.select(node("alt").alias("a"), node("neu").alias("b")))
    chained = chained.withColumn("node", node("alt")).join(part, "node", "left").select(F.coalesce("component", "node").alias("k"), "seq", "alt", "neu", "aktion")
    named = chained.select("k", F.explode(F.array("alt", "neu")).alias("p")).distinct().join(there, "p", "left_semi").select(F.col("k").alias("j"), "p")

    def fold(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        there, out = set(found["p"]), []
        for r in rows.sort_values("seq", ascending=False).itertuples():
            if r.alt == r.neu:
                status = "identisch"
            elif r.neu not in there:
                status = "quelle_fehlt"
            elif r.alt in there:
                status = "ziel_belegt"
            else:
                status = "bereit"
                there.discard(r.neu)
                there.add(r.alt)
            out.append((r.seq, r.alt, r.neu, r.aktion, status))
        return pd.DataFrame(out, columns=["seq", "alt", "neu", "aktion", "status"])

    folded = chained.groupBy("k").cogroup(named.groupBy("j")).applyInPandas(fold, "seq long, alt string, neu string, aktion string, status string")
    return alone.unionByName(folded)


def tail(plan: DataFrame, n: int) -> DataFrame:
    """The last n rows of the log; to be taken after planning over all."""
    return plan.orderBy(F.desc("seq")).limit(n)
