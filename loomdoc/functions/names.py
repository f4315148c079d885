"""Predicates and functions of file names and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
JUNK_NAMES = (".DS_Store", "Thumbs.db", "desktop.ini")
JUNK_SUFFIXES = (".tmp", ".crdownload", ".part", ".download", ".partial")
JUNK_PREFIX = "~$"
STATE_PREFIX = ".para-"
COPY_MARKERS = ("(1)", "(2)", "(3)", " copy", "-kopie", "_kopie", " kopie")
TEXT_TYPES = (".txt", ".md", ".pdf", ".docx")
ID_DOCUMENT = r"(?iU)personalausweis|reisepass|f[üu]hrerschein|ausweis|passport|identity[-_]?card"
FOLDER_VARIANT = r"(?iU)\s*(?:\(\d+\)|\d+|copy|kopie)\s*$"
INSTALLER_TYPES = (".dmg", ".exe", ".pkg", ".msi")
PHOTO_TYPES = (".jpg", ".jpeg", ".heic", ".raw")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def extension(path: Column) -> Column:
    """With its dot, lower-cased; '' without one. A leading dot doesn't begin an extension."""
    return F.lower(F.regexp_extract(basename(path), r"[^.].*?(\.[^.]*)$", 1))


def junk_reason(path: Column, size: Column) -> Column:
    """Why a file is a throw-away artefact, or null; the first reason that holds."""
    name = basename(path)
    ending = F.lit(False)
    for suffix in JUNK_SUFFIXES:
        ending = ending | F.lower(name).endswith(suffix)
    return (
        F.when(name.isin(*JUNK_NAMES), F.lit("system"))
        .when(name.startswith(JUNK_PREFIX), F.lit("lock"))
        .when(ending, F.lit("partial"))
        .when(size == 0, F.lit("empty"))
    )


def is_state_file(path: Column) -> Column:
    return basename(path).startswith(STATE_PREFIX)


def is_under(path: Column, folder: Column) -> Column:
    """path is folder or lies below it."""
    return (path == folder) | F.startswith(path, F.concat(folder, F.lit("/")))


def has_copy_marker(path: Column) -> Column:
    name, found = F.lower(basename(path)), F.lit(False)
    for marker in COPY_MARKERS:
        found = found | F.contains(name, F.lit(marker))
    return found


def is_id_document(path: Column) -> Column:
    return basename(path).rlike(ID_DOCUMENT)


def folder_base(name: Column) -> Column:
    """The name without one trailing variant mark, trimmed and lower-cased; null if nothing is left."""
    return F.nullif(F.lower(F.trim(F.regexp_replace(name, FOLDER_VARIANT, ""))), F.lit(""))


def depth_of(path: Column) -> Column:
    """Folder levels above the file."""
    return F.size(F.split(path, "/")) - 1
