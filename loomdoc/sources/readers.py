"""Texts of files, optional readers, and the REST source of repository metrics."""

from __future__ import annotations

import importlib.util
import json
import os
import urllib.error
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values.
PDF_PAGES, DOCX_PARAGRAPHS, HTTP_SECONDS = 3, 60, 15
PLAIN = (".txt", ".md")
PAGES_SETTING, PARAGRAPHS_SETTING, OCR_SETTING, OCR_LANGUAGE = "PARA_PDF_MAX_PAGES", "PARA_DOCX_MAX_PARAGRAPHS", "PARA_OCR_LANG", "deu+eng"
EXIF_TAGS = ("EXIF DateTimeOriginal", "EXIF DateTimeDigitized", "Image DateTime")


def int_option(value: str | None, default: int) -> int:
    """A whole number of at least 1, else the default."""
    try:
        found = int(value) if value is not None else default
    except ValueError:
        return default
    return found if found >= 1 else default


def int_env(name: str, default: int) -> int:
    return int_option(os.environ.get(name), default)


def _utf8(content: bytes) -> str:
    return bytes(content).decode("utf-8", "ignore")


def _pdf(path: str, pages: int | None) -> str:
    import pypdf

    return "\n".join(p.extract_text() or "" for p in list(pypdf.PdfReader(path).pages)[:pages])


def _docx(path: str, paragraphs: int | None) -> str:
    import docx

    return "\n".join(p.text for p in docx.Document(path).paragraphs[:paragraphs])


def file_texts(files: DataFrame, pages: int | None = 0, paragraphs: int | None = 0, warn_unknown: bool = True) -> DataFrame:
    """path, text, warning of files (path, ext). Plain texts as UTF-8 without broken bytes; pdf and docx if their library is there,
    the first pages or paragraphs (0: as the environment says, else 3 and 60; None: all); other types null, with a warning if
    warn_unknown."""
    pages = int_env(PAGES_SETTING, PDF_PAGES) if pages == 0 else pages
    paragraphs = int_env(PARAGRAPHS_SETTING, DOCX_PARAGRAPHS) if paragraphs == 0 else paragraphs

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for path, ext in zip(pdf["path"], pdf["ext"], strict=True):
                text = warning = None
                try:
                    if ext in PLAIN:
                        with open(path, "rb") as f:
                            text = _utf8(f.read())
                    elif ext in (".pdf", ".docx"):
                        library = {".pdf": "pypdf", ".docx": "docx"}[ext]
                        if importlib.util.find_spec(library) is None:
                            warning = f"{library} is missing"
                        else:
                            text = _pdf(path, pages) if ext == ".pdf" else _docx(path, paragraphs)
                    elif warn_unknown:
                        warning = f"no reader for {ext or 'files without an extension'}"
                except Exception as e:  # a broken file is a warning, whatever its library raises
                    warning = str(e)
                out.append((path, text, warning))
            yield pd.DataFrame(out, columns=["path", "text", "warning"])

    return files.select("path", "ext").mapInPandas(read, "path string, text string, warning string")


def image_facts(files: DataFrame, ocr: bool = False) -> DataFrame:
    """path, tags (EXIF dates, in order), text, warning of images (path). Text is read only with ocr; both need libraries that may be missing."""
    language = os.environ.get(OCR_SETTING, OCR_LANGUAGE)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        missing = {x: importlib.util.find_spec(x) is None for x in ("exifread", "PIL", "pytesseract")}
        for pdf in frames:
            out = []
            for path in pdf["path"]:
                tags, text = [], None
                warning = "; ".join(f"{x} is missing" for x, gone in missing.items() if gone and (ocr or x == "exifread")) or None
                try:
                    if not missing["exifread"]:
                        import exifread

                        with open(path, "rb") as f:
                            found = exifread.process_file(f, details=False)
                        tags = [str(found[t]) for t in EXIF_TAGS if t in found]
                    if ocr and not missing["PIL"] and not missing["pytesseract"]:
                        import pytesseract
                        from PIL import Image

                        with Image.open(path) as image:
                            text = pytesseract.image_to_string(image, lang=language)
                except Exception as e:  # a broken image is a warning, whatever its library raises
                    warning = str(e)
                out.append((path, tags, text, warning))
            yield pd.DataFrame(out, columns=["path", "tags", "text", "warning"])

    return files.select("path").mapInPandas(read, "path string, tags array<string>, text string, warning string")


class RateLimited(Exception):
    pass


def get_json(url: str, token: str | None = None) -> tuple[object, str | None]:
    """The JSON at url and its Link header."""
    request = urllib.request.Request(url, headers={"Accept": "application/vnd.github+json"} | ({"Authorization": f"Bearer {token}"} if token else {}))
    try:
        with urllib.request.urlopen(request, timeout=HTTP_SECONDS) as got:
            return json.loads(got.read()), got.headers.get("Link")
    except urllib.error.HTTPError as e:
        if e.code in (403, 429) and e.headers.get("X-RateLimit-Remaining") == "0":
            raise RateLimited(url) from e
        raise


def repo_rows(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repos, releases) as repo_metrics takes them, of fetched payloads (repo, repo_json, releases_json, link)."""
    about = F.from_json("repo_json", "stargazers_count bigint, pushed_at timestamp, archived boolean, open_issues_count bigint")
    repos = payloads.select("repo", about.alias("r"), "link").select("repo", F.col("r.stargazers_count").alias("stars"), F.col("r.pushed_at").alias("pushed_at"), F.col("r.archived").alias("archived"), F.col("r.open_issues_count").alias("open_issues"), "link")
    releases = payloads.select("repo", F.explode(F.from_json("releases_json", "array<struct<published_at: timestamp>>")).alias("r")).select("repo", "r.published_at")
    return repos, releases
