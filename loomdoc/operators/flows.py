"""Whole flows: triage with queue, quarantine and log; the redundancy loop with its end report; repository metrics as they are fetched.

Plans are DataFrames; what changes files is carried out on the driver after the plan, and only with apply.
"""

from __future__ import annotations

import urllib.error
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.functions.names import basename, dirname, extension, is_under
from loomdoc.operators import dedupe, intake, metadata, scoring
from loomdoc.operators.moves import carry_out
from loomdoc.session import written
from loomdoc.sources.readers import RateLimited, get_json, repo_rows
from loomdoc.sources.state import append_json, append_log

#: Names of the queue's fields for what is read from a text.
FOUND = {"confidence": "confidence", "date": "erkanntes_datum", "code": "erkanntes_kuerzel", "alternatives": "kuerzel_alternativen", "sender": "absender_hinweis", "file_name": "vorschlag_dateiname", "snippet": "redigierter_ausschnitt", "warning": "warnungen"}
CLASSES = {"duplicate": "dublette", "content": "inhalt"}


@dataclass
class Triage:
    """queue: new entries; moves: source, target, reason of what goes to quarantine; skipped: path, reason; warnings: path, reason."""

    queue: DataFrame
    moves: DataFrame
    skipped: DataFrame
    warnings: DataFrame

    def counts(self) -> str:
        return f"{self.queue.count()} new files, {self.moves.count()} to quarantine, {self.skipped.count()} left out, {self.warnings.count()} unreadable"


def triage_plan(files: DataFrame, manifest: DataFrame, queue: DataFrame, home: DataFrame, quarantine: str, stamp: Column, texts: DataFrame | None = None, types: DataFrame | None = None) -> Triage:
    """files: path, hash, size, and error where one couldn't be read. texts (path, text): queue entries get what analyze reads."""
    judged = written(intake.triage(files.select("path", "hash", "size"), manifest, queue, home, quarantine), "triage")
    new = judged.where(F.col("verdict").isin(*CLASSES))
    entries = new.select(
        "hash", F.col("path").alias("quelle"), F.col("size").alias("groesse"), F.when(F.col("verdict") == "duplicate", CLASSES["duplicate"]).otherwise(CLASSES["content"]).alias("klasse"),
        (F.col("verdict") == "duplicate").alias("bereits_im_ziel"), F.when(F.col("first_hit").isNotNull(), F.array("first_hit")).otherwise(F.array().cast("array<string>")).alias("ziel_treffer"),
        F.coalesce("n_hits", F.lit(0)).alias("n_ziel_treffer"), stamp.cast("string").alias("zeitstempel"),
    )
    if texts is not None and types is not None:
        read = metadata.analyze(texts.select(F.col("path").alias("id"), extension(F.col("path")).alias("ext"), "text"), types)
        entries = entries.join(read.select(F.col("id").alias("quelle"), *[F.col(c).alias(x) for c, x in FOUND.items()]), "quelle", "left")
    there = files.where(is_under(F.col("path"), F.lit(quarantine))).select(F.lit(quarantine).alias("folder"), basename(F.col("path")).alias("name"))
    junk = judged.where("verdict = 'junk'").select(F.lit(quarantine).alias("folder"), basename(F.col("path")).alias("name"), F.col("path").alias("seq"), "reason")
    free = intake.free_names(junk.select("folder", "name", "seq"), there.distinct())
    moves = junk.join(free.select("seq", "target"), "seq").select(F.col("seq").alias("source"), F.concat("folder", F.lit("/"), "target").alias("target"), "reason")
    skipped = judged.where(F.col("verdict").isin("manifest", "queue")).select("path", F.col("verdict").alias("reason"))
    error = files["error"] if "error" in files.columns else F.lit(None).cast("string")
    warnings = files.select("path", error.alias("error")).join(judged.where("verdict = 'unreadable'").select("path"), "path").select("path", F.coalesce("error", F.lit("unreadable")).alias("reason"))
    return Triage(entries, moves, skipped, warnings)


def triage_run(plan: Triage, queue_path: str, log_path: str, stamp: str, notify: Callable[[str], None] | None = None, apply: bool = False) -> list[tuple[str, str, str | None]]:
    """Carry out a plan: quarantine on the driver (source, target, error of each), then the log of what was moved, then the queue. A dry run unless apply."""
    spark = plan.queue.sparkSession
    done = carry_out(((r["source"], r["target"]) for r in plan.moves.orderBy("source").toLocalIterator()), apply)
    if apply:
        moved = [(i, stamp, "quarantäne", a, b) for i, (a, b, e) in enumerate(done, 1) if e is None]
        if moved:
            append_log(spark.createDataFrame(moved, "seq long, zeitstempel string, aktion string, alt string, neu string").coalesce(1), log_path)
        n = plan.queue.count()
        if n:
            append_json(plan.queue, queue_path)
        if notify and (n or moved):
            notify(f"{n} new files, {len(moved)} in quarantine")
    return done


@dataclass
class Redundancy:
    """moves: pass, path, keep, target; left: the files that stay; stable: whether a pass found nothing; near, warnings: near-duplicates of what stays."""

    moves: DataFrame
    left: DataFrame
    stable: bool
    near: DataFrame
    warnings: list[str]

    def report(self) -> str:
        kept, groups = self.moves.count(), self.near.count()
        return "\n".join([f"{kept} redundant files, {'stable' if self.stable else 'not stable yet'}", f"{groups} groups of near-duplicates are left", *self.warnings])


def redundancy_flow(files: DataFrame, quarantine: str, apply: bool = False) -> Redundancy:
    """files: path, hash, mtime, text. Exact copies go to quarantine under free names, pass by pass; near-duplicates of the end state are told."""
    moves, left, stable = intake.redundancy_passes(files, quarantine)
    moves, left = written(moves, "moves"), written(left, "left")
    # a name that an earlier run put into quarantine is taken
    there = files.where(is_under(F.col("path"), F.lit(quarantine))).select(dirname(F.col("path")).alias("folder"), basename(F.col("path")).alias("name")).distinct()
    asked = moves.select(dirname(F.col("target")).alias("folder"), basename(F.col("target")).alias("name"), F.col("path").alias("seq"))
    free = intake.free_names(asked, there, "_{n}").select(F.col("seq").alias("path"), F.concat("folder", F.lit("/"), "target").alias("target"))
    moves = written(moves.drop("target").join(free, "path").select("pass", "path", "keep", "target"), "moves")
    if apply:
        carry_out(((r["path"], r["target"]) for r in moves.orderBy("pass", "path").toLocalIterator()), True)
    near, warnings = dedupe.near_duplicates(left)
    return Redundancy(moves, left, stable, near, warnings)


def fetch_repos(spark: SparkSession, slugs: Iterable[str], get: Callable[..., tuple[object, str | None]] = get_json, token: str | None = None, api: str = "https://api.github.com", sample: int = 30) -> tuple[DataFrame, DataFrame, bool]:
    """(payloads: repo, repo_json, releases_json, link; errors: repo, error; whether the rate limit ended it).

    One request after the other, as the limit is one for all; a repository that fails is an error row, and what was fetched before the
    limit is kept.
    """
    import json

    rows, errors, ended = [], [], False
    for slug in slugs:
        try:
            about, _ = get(f"{api}/repos/{slug}", token)
            releases, _ = get(f"{api}/repos/{slug}/releases?per_page={sample}", token)
            _, link = get(f"{api}/repos/{slug}/contributors?per_page=1&anon=true", token)
            rows.append((slug, json.dumps(about), json.dumps(releases), link))
        except RateLimited as e:
            errors.append((slug, f"rate limit: {e}"))
            ended = True
            break
        except urllib.error.HTTPError as e:
            errors.append((slug, f"HTTP {e.code}"))
        except urllib.error.URLError as e:
            errors.append((slug, f"network: {e.reason}"))
    return spark.createDataFrame(rows, "repo string, repo_json string, releases_json string, link string"), spark.createDataFrame(errors, "repo string, error string"), ended


def repo_report(spark: SparkSession, args: Iterable[str], asof: Column, **options: object) -> tuple[DataFrame, DataFrame, bool]:
    """Metrics of the arguments that are owner/name, the errors, and whether the rate limit ended it."""
    slugs = [r["value"] for r in scoring.slugs(spark.createDataFrame([(x,) for x in args], "value string")).collect()]
    payloads, errors, ended = fetch_repos(spark, slugs, **options)
    return scoring.repo_metrics(*repo_rows(payloads), asof), errors, ended


#: Plans of this library's flows: step, what has to be there before it.
PLAN_ORDER = (("scan", ()), ("exact", ("scan",)), ("near", ("exact",)), ("manifest", ("scan",)), ("triage", ("manifest", "exact")), ("metadata", ("triage",)), ("names", ("metadata",)), ("moves", ("names",)), ("log", ("moves",)), ("undo", ("log",)))


def in_order(steps: Iterable[tuple[str, Iterable[str]]]) -> list[str]:
    """Steps (name, names before) so that each comes after those it needs; the given order on ties. A circle is an error."""
    left, out = [(n, set(b)) for n, b in steps], []
    while left:
        ready = next((n for n, before in left if before <= set(out)), None)
        if ready is None:
            raise ValueError(f"steps wait for each other: {', '.join(n for n, _ in left)}")
        out.append(ready)
        left = [x for x in left if x[0] != ready]
    return out
