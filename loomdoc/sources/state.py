"""State files: manifest and queue (JSON lines), move log (CSV with ;), the table of document types, cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MANIFEST = "hash string, ziel string, aktion string, quelle string, zeitstempel string"
QUEUE = f"{MANIFEST}, groesse bigint, klasse string, bereits_im_ziel boolean, ziel_treffer array<string>"
LOG_HEADER = ("zeitstempel", "aktion", "alt", "neu")

# Document types, in their order.
DOCUMENT_TYPES = (
    ("RG", "Rechnung"), ("ANG", "Angebot"), ("VTR", "Vertrag"), ("AB", "Auftragsbestätigung"), ("MAHN", "Mahnung"),
    ("KVA", "Kostenvoranschlag"), ("BEW", "Bewerbungsunterlage"), ("ZEUG", "Zeugnis/Zertifikat"), ("PROT", "Protokoll"),
    ("PRES", "Präsentation"), ("ANL", "Anleitung/Handbuch"), ("VERS", "Versicherungsunterlage"), ("STEU", "Steuerunterlage"),
    ("GEHALT", "Gehaltsabrechnung"), ("VERD", "Verdienstbescheinigung"), ("KUEND", "Kündigung"), ("ANTR", "Antrag"),
    ("BESCH", "Bescheid (Behörde/Amt)"), ("TICKET", "Reise-/Veranstaltungsbuchung"), ("EXPORT", "Datenexport (CSV, JSON o.ä.)"),
    ("NOTIZ", "Notiz/Freitext-Dokument"),
)


def document_types(spark: SparkSession) -> DataFrame:
    """ord, code, label: a fixed 21 rows."""
    return spark.createDataFrame([(i, c, t) for i, (c, t) in enumerate(DOCUMENT_TYPES)], "ord int, code string, label string")


def parse_document_types(lines: DataFrame) -> DataFrame:
    """ord, code, label from lines (line_no, value) of a table | CODE | label |; codes are upper-case."""
    row = r"(?U)^\|\s*([A-ZÄÖÜ]+)\s*\|\s*(.+?)\s*\|\s*$"
    found = lines.select("line_no", F.regexp_extract("value", row, 1).alias("code"), F.regexp_extract("value", row, 2).alias("label")).where("code <> ''")
    return found.select((F.row_number().over(Window.orderBy("line_no")) - 1).alias("ord"), "code", "label")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 1), value of one text file. A state file is one file, read whole so that its order is known."""
    whole = spark.read.text(path, wholetext=True)
    lines = F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n"))
    return whole.select(lines.alias("pos", "value")).select((F.col("pos") + 1).alias("line_no"), "value")


def json_rows(lines: DataFrame, schema: str) -> DataFrame:
    """line_no and the columns of schema for lines that are objects with a hash; others are left out, as are blank lines."""
    parsed = lines.where(F.trim("value") != "").select("line_no", F.from_json("value", f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    return parsed.where("r._corrupt_record is null and r.hash is not null and r.hash <> ''").select("line_no", "r.*").drop("_corrupt_record")


def skipped_lines(lines: DataFrame, schema: str) -> DataFrame:
    """line_no of lines, other than blank ones, that json_rows leaves out: for a warning."""
    return lines.where(F.trim("value") != "").select("line_no").join(json_rows(lines, schema).select("line_no"), "line_no", "left_anti")


def latest(entries: DataFrame) -> DataFrame:
    """One row for each hash: the last line wins."""
    rest = [c for c in entries.columns if c not in ("hash", "line_no")]
    return entries.groupBy("hash").agg(F.max_by(F.struct(*rest), "line_no").alias("r")).select("hash", "r.*")


def queue_hashes(entries: DataFrame) -> DataFrame:
    return entries.where("hash is not null and hash <> ''").select("hash").distinct()


def _fields(value: Column) -> Column:
    """The ;-separated fields of a line; quotes keep a ; and are taken off."""
    raw = F.regexp_extract_all(F.concat(value, F.lit(";")), F.lit(r'("(?:[^"]|"")*"|[^;"]*);'), F.lit(1))
    return F.transform(raw, lambda f: F.when(f.startswith('"'), F.replace(F.regexp_replace(f, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(f))


def move_log(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(seq, zeitstempel, aktion, alt, neu) of a log's lines, and (seq, warning) of lines that are broken. Headers and blank lines go."""
    split = lines.select(F.col("line_no").alias("seq"), _fields(F.col("value")).alias("f"))
    split = split.where(F.exists("f", lambda x: F.trim(x) != "") & (F.col("f") != F.array(*map(F.lit, LOG_HEADER))))
    part = lambda i: F.trim(F.get("f", F.lit(i)))
    reason = F.when(F.size("f") != 4, F.concat(F.lit("4 fields expected, found "), F.size("f").cast("string"))).when((part(2) == "") | (part(3) == ""), F.lit("empty path"))
    read = split.select("seq", *[part(i).alias(n) for i, n in enumerate(LOG_HEADER)], reason.alias("warning"))
    return read.where("warning is null").drop("warning"), read.where("warning is not null").select("seq", "warning")


def newest_log(files: DataFrame) -> DataFrame:
    """path of the log (path, mtime) that was changed last."""
    return files.agg(F.max_by("path", F.struct("mtime", "path")).alias("path"))


def append_json(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Structured rows with their seq, so that a path with a ; can be undone."""
    rows.select("seq", *LOG_HEADER).write.mode("append").csv(path, sep=";", header=True)
