"""Golden cases: tables of cases, and the checks that each track makes of them (metric, ok, detail), for the scorecard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.functions import text as T
from loomdoc.functions.names import extension
from loomdoc.operators import dedupe, intake, metadata
from loomdoc.operators.scoring import CATEGORIES

_FILES = "array<struct<name: string, inhalt: string>>"
# The fields of each table of cases.
METADATA = "id string, dateiname string, inhalt string, erwartetes_datum string, erwartetes_kuerzel string, erwartete_confidence string, erwartet_garbled boolean, erwartet_alternativen array<string>"
REDACTION = "id string, dateiname string, inhalt string, darf_nicht_enthalten array<string>"
DEDUPE = f"id string, fixture {_FILES}, home {_FILES}, erwartet_exakte_gruppen bigint, erwartet_behalten string, erwartet_near_gruppen bigint, erwartet_bereits_im_ziel bigint"
TRIAGE = f"id string, fixture {_FILES}, home {_FILES}, erwartet_muell bigint, erwartet_inhalt bigint, erwartet_dublette bigint"
TRIGGER = "id string, prompt string, soll_triggern boolean"
PARA = "id string, dateiname string, kontext string, erwartete_kategorie string"


def load_cases(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Cases of a .jsonl file (a line each; blank lines go) or of a .json file (one array)."""
    rows = spark.read.schema(schema)
    return (rows.json(path) if path.endswith(".jsonl") else rows.option("multiLine", True).json(path)).where("id is not null")


def _check(metric: str, ok: Column, detail: Column, where: Column | None = None) -> Column:
    """A struct for a check, null where it isn't made."""
    made = F.struct(F.lit(metric).alias("metric"), F.coalesce(ok, F.lit(False)).alias("ok"), detail.alias("detail"))
    return made if where is None else F.when(where, made)


def _rows(df: DataFrame, *checks: Column) -> DataFrame:
    return df.select(F.inline(F.filter(F.array(*checks), lambda x: x.isNotNull())))


def metadata_checks(cases: DataFrame, types: DataFrame) -> DataFrame:
    """Garbled texts are to be caught and are judged by nothing else; of others the date, code and confidence, and alternatives."""
    read = metadata.analyze(cases.select("id", extension(F.col("dateiname")).alias("ext"), F.col("inhalt").alias("text")), types)
    both = cases.join(read, "id")
    garbled, plain = F.coalesce("erwartet_garbled", F.lit(False)), ~F.coalesce("erwartet_garbled", F.lit(False))
    codes = F.coalesce(F.transform("alternatives", lambda a: a["code"]), F.array().cast("array<string>"))
    return _rows(
        both,
        _check("garbled_gefangen", F.col("snippet").isNull() & (F.col("warning") == "garbled"), F.col("id"), garbled),
        _check("datum_korrekt", F.col("date").eqNullSafe(F.col("erwartetes_datum")), F.col("id"), plain & F.col("erwartetes_datum").isNotNull()),
        _check("kuerzel_korrekt", F.col("code").eqNullSafe(F.col("erwartetes_kuerzel")), F.col("id"), plain & F.col("erwartetes_kuerzel").isNotNull()),
        _check("confidence_korrekt", F.col("confidence") == F.col("erwartete_confidence"), F.col("id"), plain),
        _check("mehrdeutigkeit_gemeldet", F.size(F.array_except("erwartet_alternativen", codes)) == 0, F.col("id"), plain & (F.size("erwartet_alternativen") > 0)),
    )


def redaction_checks(cases: DataFrame) -> DataFrame:
    """A check for each string that must not be left."""
    cleaned = cases.select("id", F.inline(F.array(F.struct(T.redact(F.col("inhalt")).alias("text")))), "darf_nicht_enthalten")
    each = cleaned.select("id", "text", F.explode("darf_nicht_enthalten").alias("v"))
    return _rows(each, _check("schwaerzung_leak_frei", ~F.contains("text", "v"), F.concat_ws(": ", "id", "v")))


def _files(cases: DataFrame, of: str) -> DataFrame:
    """path, hash, mtime, size, text of the files of all cases; path and hash begin with the case, so that cases don't meet."""
    each = cases.select("id", F.posexplode(of).alias("mtime", "f"))
    text = F.coalesce("f.inhalt", F.lit(""))
    return each.select("id", F.concat_ws("/", "id", "f.name").alias("path"), F.concat_ws(":", "id", F.sha2(text, 256)).alias("hash"), F.col("mtime").cast("long").alias("mtime"), F.octet_length(text).cast("long").alias("size"), text.alias("text"))


def _counted(cases: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """cases with the number of rows (id) of each; 0 where there are none."""
    return cases.join(rows.groupBy("id").agg(F.count("*").alias(name)), "id", "left").fillna(0, [name])


def dedupe_checks(cases: DataFrame) -> DataFrame:
    files, home = _files(cases, "fixture"), _files(cases, "home")
    groups = dedupe.exact_groups(files).select("hash", F.split("hash", ":")[0].alias("id"), "keep").distinct()
    redundant = dedupe.redundant_paths(files).select("path")
    near = dedupe.leader_groups(dedupe.near_edges(files.join(redundant, "path", "left_anti").select(F.concat_ws(":", "id", extension(F.col("path"))).alias("ext"), "path", "text")))
    found = _counted(_counted(_counted(cases, groups, "exact"), near.select(F.split("ext", ":")[0].alias("id")), "near"), dedupe.already_in_target(files, home).select(F.split("hash", ":")[0].alias("id")), "held")
    found = found.join(groups.groupBy("id").agg(F.min(F.element_at(F.split("keep", "/"), -1)).alias("kept")), "id", "left")
    return _rows(
        found,
        _check("exakte_dup_precision", F.col("exact") == F.col("erwartet_exakte_gruppen"), F.col("id"), F.col("erwartet_exakte_gruppen").isNotNull()),
        _check("exakte_dup_precision", F.col("kept") == F.col("erwartet_behalten"), F.col("id"), F.col("erwartet_behalten").isNotNull() & (F.col("exact") > 0)),
        _check("near_dup_erkannt", F.col("near") == F.col("erwartet_near_gruppen"), F.col("id"), F.col("erwartet_near_gruppen").isNotNull()),
        _check("bereits_im_ziel_erkannt", F.col("held") == F.col("erwartet_bereits_im_ziel"), F.col("id"), F.col("erwartet_bereits_im_ziel").isNotNull()),
    )


def triage_checks(cases: DataFrame) -> DataFrame:
    """Three checks a case: the numbers of junk, content and duplicates."""
    none = cases.sparkSession.createDataFrame([], "hash string")
    judged = intake.triage(_files(cases, "fixture").select("path", "hash", "size"), none, none, _files(cases, "home"))
    n = judged.select(F.split("path", "/")[0].alias("id"), "verdict")
    found = _counted(_counted(_counted(cases, n.where("verdict = 'junk'"), "junk"), n.where("verdict = 'content'"), "content"), n.where("verdict = 'duplicate'"), "duplicate")
    return _rows(found, *[_check("triage_klassifikation", F.col(a) == F.col(b), F.concat_ws(": ", "id", F.lit(a))) for a, b in (("junk", "erwartet_muell"), ("content", "erwartet_inhalt"), ("duplicate", "erwartet_dublette"))])


def category_checks(answers: DataFrame, allowed: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """answers: id, kategorie (as a judge gave it), erwartete_kategorie. An answer that is no category is wrong."""
    given, wanted = F.lower(F.regexp_replace(F.trim("kategorie"), r"\.+$", "")), F.lower("erwartete_kategorie")
    known = F.exists(F.array(*[F.lit(x.lower()) for x in allowed]), lambda x: F.startswith(given, x))
    return _rows(answers, _check("para_kategorie_korrekt", known & F.startswith(given, wanted), F.col("id")))


def track(metadata_cases: DataFrame, redaction_cases: DataFrame, dedupe_cases: DataFrame, triage_cases: DataFrame, types: DataFrame) -> DataFrame:
    """All checks that need no judge."""
    return metadata_checks(metadata_cases, types).unionByName(redaction_checks(redaction_cases)).unionByName(dedupe_checks(dedupe_cases)).unionByName(triage_checks(triage_cases))


def failures(checks: DataFrame) -> DataFrame:
    """metric, detail of what failed, for a report."""
    return checks.where("not ok").select("metric", "detail")
