"""Views over the test tables, in SQL that both engines run. SHA(x) stands for the hex SHA-256 of x."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from loomdoc.session import file_count

_TYPE = "CASE o_orderkey % 5 WHEN 0 THEN 'Rechnung' WHEN 1 THEN 'Vertrag' WHEN 2 THEN 'Angebot' WHEN 3 THEN 'Mahnung' ELSE 'Bescheid' END"
_SECOND = "CASE WHEN o_orderkey % 7 = 0 THEN 'Zum Protokoll und zum Vertrag sowie zum Antrag. ' ELSE '' END"
_Y, _M, _D = (f"CAST({f}(o_orderdate) AS STRING)" for f in ("year", "month", "day"))

VIEWS: dict[str, str] = {
    "files_v": """SELECT doc_id, source || '/doc_' || CAST(doc_id AS STRING) || CASE doc_id % 7 WHEN 1 THEN ' (1)' WHEN 3 THEN '-kopie' WHEN 5 THEN ' copy' ELSE '' END || '.txt' AS path,
  (doc_id * 7919) % 100003 AS mtime, SHA(text) AS hash, n_chars AS size, text FROM documents""",
    "home_v": "SELECT path, mtime, hash, size, text FROM files_v WHERE doc_id % 2 = 1",
    "src_v": "SELECT path, mtime, hash, size, text FROM files_v WHERE doc_id % 2 = 0",
    "names_v": """SELECT source || '/' || CASE doc_id % 11 WHEN 0 THEN '.DS_Store' WHEN 1 THEN 'x' || CAST(doc_id AS STRING) || '.crdownload' WHEN 2 THEN '~$x' || CAST(doc_id AS STRING) || '.docx' WHEN 3 THEN '.para-x' || CAST(doc_id AS STRING)
  WHEN 4 THEN 'Reisepass-' || CAST(doc_id AS STRING) || '.jpg' WHEN 5 THEN 'setup-1.' || CAST(doc_id % 97 AS STRING) || '.dmg' WHEN 6 THEN 'Screenshot ' || CAST(doc_id AS STRING) || '.png' ELSE 'doc_' || CAST(doc_id AS STRING) || '.txt' END AS path,
  doc_id, CASE WHEN doc_id % 23 = 0 THEN 0 ELSE n_chars END AS size, (doc_id * 7919) % 100003 AS mtime, SHA(text) AS hash FROM documents""",
    "triage_v": "SELECT path, hash, size FROM names_v WHERE doc_id % 2 = 0",
    "manifest_v": "SELECT hash, 'ablage/' || CAST(min(doc_id) AS STRING) AS ziel FROM files_v WHERE doc_id % 13 = 0 GROUP BY hash",
    "queue_v": "SELECT DISTINCT hash FROM files_v WHERE doc_id % 17 = 0",
    "folders_v": "SELECT 'ordner ' || CAST(l_orderkey AS STRING) || CASE l_orderkey % 3 WHEN 0 THEN ' (2)' WHEN 1 THEN ' kopie' ELSE '' END AS folder, SHA('' || l_partkey) AS hash FROM lineitem",
    "letters_v": f"""SELECT o_orderkey AS id, '.txt' AS ext,
  'Absender: Firma ' || CAST(100000 + o_custkey AS STRING) || CASE o_orderkey % 4 WHEN 0 THEN ' GmbH' WHEN 1 THEN ' AG' WHEN 2 THEN ' Bank' ELSE '' END || chr(10)
  || {_TYPE} || ' vom ' || CASE o_orderkey % 3 WHEN 0 THEN {_Y} || '-' || lpad({_M}, 2, '0') || '-' || lpad({_D}, 2, '0') WHEN 1 THEN {_D} || '.' || {_M} || '.' || {_Y} ELSE 'Monatsende' END || '. ' || {_SECOND}
  || 'Diese ' || {_TYPE} || ' betrifft Kundennummer: K-' || CAST(o_custkey AS STRING) || '. Betrag ' || CAST(10 + o_orderkey % 900 AS STRING) || ',' || lpad(CAST(o_orderkey % 100 AS STRING), 2, '0') || ' EUR fällig.' || chr(10)
  || 'Kontakt kunde' || CAST(o_custkey AS STRING) || '@example.org oder 030' || CAST(1000000 + o_custkey AS STRING) || ' oder +49 170 ' || CAST(1000000 + o_custkey AS STRING) || ', Herr Max Muster, Hauptstraße ' || CAST(10 + o_orderkey % 80 AS STRING) || ', 10115 Berlin.' || chr(10)
  || CASE o_orderkey % 6 WHEN 0 THEN 'IBAN DE89 3704 0044 0532 0130 00. ' WHEN 1 THEN 'Karte 4242 4242 4242 4242 Ablauf offen. ' WHEN 2 THEN 'Karte 4242 4242 4242 4243 Ablauf offen. ' WHEN 3 THEN 'Vorgang 123456789012 offen. ' WHEN 4 THEN 'Steuer-ID: 12 345 678 901 genannt. ' ELSE 'SV 12 34 56 A 789 genannt. ' END || 'Ende' AS text FROM orders""",
    "cases_v": "SELECT CASE doc_id % 3 WHEN 0 THEN 'schwaerzung_leak_frei' WHEN 1 THEN 'datum_korrekt' ELSE 'triage_klassifikation' END AS metric, CASE WHEN doc_id % 29 = 0 THEN NULL ELSE quality = 1 END AS ok, quality = 1 AS said, toxic = 0 AS truth FROM labels",
    "repos_v": """SELECT 'org/' || n_name AS repo, CASE WHEN n_nationkey % 9 = 0 THEN 0 ELSE n_nationkey * 137 END AS stars, n_nationkey % 8 = 7 AS archived, n_nationkey * 11 AS open_issues,
  CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE '<https://example.org/c?per_page=1&page=' || CAST(n_nationkey + 1 AS STRING) || '>; rel="last"' END AS link, n_nationkey FROM nation""",
    "releases_v": "SELECT 'org/' || n_name AS repo, CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE o_orderdate END AS published_at, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
    "pushed_v": "SELECT 'org/' || n_name AS repo, max(o_orderdate) - INTERVAL '1' DAY AS pushed_at FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "rubric_v": """SELECT 'k' || CAST(p_partkey % 40 AS STRING) AS category, 'p' || CAST(p_partkey AS STRING) AS candidate, 1 + p_partkey % 5 AS maintenance, 1 + (p_partkey / 5 - (p_partkey / 5) % 1) % 5 AS community, 1 + p_size % 5 AS docs,
  1 + p_size % 4 AS maturity, 1 + p_partkey % 3 AS fit, p_size % 10 = 0 AS archived, p_size % 17 = 0 AS deprecated, p_partkey % 36 AS months FROM part""",
}
VIEWS["rubric_v"] = VIEWS["rubric_v"].replace("1 + (p_partkey / 5 - (p_partkey / 5) % 1) % 5", "1 + (p_partkey + p_size) % 5")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark", "labels", "conversations", "pages")


def _needs(sql: str) -> list[str]:
    """Views below sql, each after those it needs."""
    out: list[str] = []
    for name in re.findall(r"\b\w+_v\b", sql):
        if name in VIEWS and name not in out:
            out += [x for x in [*_needs(VIEWS[name]), name] if x not in out]
    return out


def duck(sql: str) -> str:
    """sql with its views before it, for DuckDB; sql may begin with WITH [RECURSIVE]."""
    parts = [f"{n} AS ({VIEWS[n]})" for n in _needs(sql)]
    body = sql.strip()
    recursive = body.upper().startswith("WITH RECURSIVE")
    if body.upper().startswith("WITH"):
        first, rest = re.match(r"WITH(?: RECURSIVE)?\s+(.*)$", body, re.S | re.I)[1], ""
        text = ", ".join([*parts, ""])[:-2] + (", " if parts else "") + first if parts else first
        out = f"WITH {'RECURSIVE ' if recursive else ''}{text}{rest}"
    else:
        out = (f"WITH {', '.join(parts)} " if parts else "") + body
    return re.sub(r"\bSHA\(", "sha256(", out)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame, over the tables of sf_dir."""
    names = [*_needs(VIEWS[name]), name]
    sql = f"WITH {', '.join(f'{n} AS ({VIEWS[n]})' for n in names)} SELECT * FROM {name}"
    sql = re.sub(r"\bSHA\(([^()]*)\)", r"sha2(\1, 256)", sql)
    used = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used}
    if name == "letters_v":  # letters are costly to read, and a file that few tasks can share is small: its keys are dealt out, not its texts
        orders = frames["orders"].select("o_orderkey", "o_custkey", "o_orderdate")
        frames["orders"] = orders.repartition(2 * file_count(orders), "o_orderkey")
    sql = re.sub(r"\b(FROM|JOIN) (\w+)\b", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in used else m[0], sql)
    return spark.sql(sql, **frames)
