"""The registered queries of the document-hygiene operators over the test tables, and their SQL."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.functions import names as N
from loomdoc.functions import text as T
from loomdoc.operators import dedupe, filing, intake, metadata, scoring
from loomdoc.plans.views import duck, view
from loomdoc.sources import state
from loomdoc.sources.readers import repo_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = duck(sql)
        return f

    return keep


_MARKED = "(" + " OR ".join(f"contains(lower(regexp_replace(path, '^.*/', '')), '{m}')" for m in N.COPY_MARKERS) + ")"


def _joined(c: str) -> F.Column:
    return F.array_join(c, "|").alias(c)


# --- copies, membership, folders -----------------------------------------------------------------------------------------------


@_query("exact_duplicates", f"""WITH g AS (SELECT hash, count(*)::BIGINT AS n_files, arg_min(path, ({_MARKED}, mtime, path)) AS keep FROM files_v GROUP BY hash HAVING count(*) > 1)
  SELECT f.hash, path, n_files, keep FROM files_v f JOIN g ON f.hash = g.hash""")
def exact_duplicates(spark, sf_dir):
    return dedupe.exact_groups(view(spark, sf_dir, "files_v"))


@_query("content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(spark, sf_dir):
    return dedupe.with_hash(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text").select("doc_id", "hash")


@_query("redundant_copies", f"SELECT hash, path FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY {_MARKED}, mtime, path) AS r FROM files_v) WHERE r > 1")
def redundant_copies(spark, sf_dir):
    return dedupe.redundant_paths(view(spark, sf_dir, "files_v"))


@_query("newest_copy", """SELECT hash, path, CASE WHEN r = 1 THEN 'keep' ELSE 'loser' END AS role FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY mtime DESC, path) AS r,
  count(*) OVER (PARTITION BY hash) AS n FROM files_v) WHERE n > 1""")
def newest_copy(spark, sf_dir):
    return dedupe.newest(view(spark, sf_dir, "files_v"))


@_query("known_hashes", "SELECT hash, count(*)::BIGINT AS n_hits, min(path) AS first_hit FROM (SELECT hash, path FROM home_v UNION ALL SELECT hash, path FROM src_v) GROUP BY hash")
def known_hashes(spark, sf_dir):
    return dedupe.known_hashes(view(spark, sf_dir, "home_v"), view(spark, sf_dir, "src_v"))


@_query("already_in_target", "SELECT s.path, s.hash, h.n_hits, h.first_hit FROM src_v s JOIN (SELECT hash, count(*)::BIGINT AS n_hits, min(path) AS first_hit FROM home_v GROUP BY hash) h ON s.hash = h.hash")
def already_in_target(spark, sf_dir):
    return dedupe.already_in_target(view(spark, sf_dir, "src_v"), view(spark, sf_dir, "home_v"))


@_query("top_folders", "SELECT split_part(path, '/', 1) AS folder, count(DISTINCT hash)::BIGINT AS n FROM files_v WHERE contains(path, '/') GROUP BY 1")
def top_folders(spark, sf_dir):
    return dedupe.top_folder(view(spark, sf_dir, "files_v")).groupBy("folder").agg(F.countDistinct("hash").alias("n"))


@_query("subset_folders")
def subset_folders(spark, sf_dir):
    """Without SQL, which would compare all pairs of folders; held against brute force."""
    return dedupe.folder_relations(view(spark, sf_dir, "folders_v"))


@_query("folder_base_names", r"SELECT DISTINCT folder, nullif(lower(trim(regexp_replace(folder, '(?i)\s*(?:\(\d+\)|\d+|copy|kopie)\s*$', ''))), '') AS base FROM folders_v")
def folder_base_names(spark, sf_dir):
    return view(spark, sf_dir, "folders_v").select("folder", N.folder_base(F.col("folder")).alias("base")).distinct()


@_query("near_duplicates")
def near_duplicates(spark, sf_dir):
    found, warned = dedupe.near_duplicates(view(spark, sf_dir, "files_v").select("path", "hash", "mtime", "text"))
    for said in warned:
        warnings.warn(said, stacklevel=2)
    return found.select("ext", "leader", _joined("files"))


@_query("near_duplicates_scaled")
def near_duplicates_scaled(spark, sf_dir):
    return dedupe.near_duplicates_scaled(view(spark, sf_dir, "files_v").select("path", "hash", "mtime", "text"))


# --- manifest, queue, triage, undo ---------------------------------------------------------------------------------------------


@_query("manifest_check", "SELECT path, s.hash, m.hash IS NOT NULL AS done, ziel AS target FROM src_v s LEFT JOIN manifest_v m ON s.hash = m.hash")
def manifest_check(spark, sf_dir):
    return intake.manifest_check(view(spark, sf_dir, "src_v"), view(spark, sf_dir, "manifest_v"))


@_query("manifest_record", "SELECT hash, min(path) AS path, regexp_replace(min(path), '^.*/', '') AS name, 'verschoben' AS action FROM src_v WHERE hash NOT IN (SELECT hash FROM manifest_v) GROUP BY hash")
def manifest_record(spark, sf_dir):
    return intake.manifest_record(view(spark, sf_dir, "src_v"), view(spark, sf_dir, "manifest_v"))


def _state_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a manifest with broken, blank and repeated ones, made from documents."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    entry = F.to_json(F.struct(F.sha2("text", 256).alias("hash"), F.concat(F.lit("ziel/"), F.col("doc_id").cast("string")).alias("ziel"), F.lit("verschoben").alias("aktion")))
    broken = F.when(F.col("doc_id") % 10 == 0, F.lit("not json")).when(F.col("doc_id") % 10 == 1, F.lit("")).when(F.col("doc_id") % 10 == 2, F.lit('{"ziel": "x"}')).when(F.col("doc_id") % 10 == 3, F.lit("[1]"))
    return d.select(F.col("doc_id").alias("line_no"), F.coalesce(broken, entry).alias("value"))


@_query("manifest_latest", "SELECT sha256(text) AS hash, 'ziel/' || max(doc_id) AS ziel, 'verschoben' AS aktion FROM documents WHERE doc_id % 10 > 3 GROUP BY 1")
def manifest_latest(spark, sf_dir):
    return state.latest(state.json_rows(_state_lines(spark, sf_dir), state.MANIFEST)).select("hash", "ziel", "aktion")


@_query("queue_hashes", "SELECT DISTINCT sha256(text) AS hash FROM documents WHERE doc_id % 10 > 3")
def queue_hashes(spark, sf_dir):
    return state.queue_hashes(state.json_rows(_state_lines(spark, sf_dir), state.QUEUE))


_LOG = "SELECT o_orderkey AS line_no, CASE o_orderkey % 9 WHEN 0 THEN 'zeitstempel;aktion;alt;neu' WHEN 1 THEN ' ' WHEN 2 THEN 'a;b;c' WHEN 3 THEN '1;2;3;4;5' WHEN 4 THEN 't;verschoben;;x' WHEN 5 THEN 't;verschoben;\"a;b\";c' ELSE 't;verschoben; alt' || CAST(o_orderkey AS STRING) || ' ;neu' || CAST(o_orderkey AS STRING) END AS value FROM orders"


@_query("move_log", """SELECT o_orderkey AS seq, 't' AS zeitstempel, 'verschoben' AS aktion, CASE WHEN o_orderkey % 9 = 5 THEN 'a;b' ELSE 'alt' || o_orderkey END AS alt, CASE WHEN o_orderkey % 9 = 5 THEN 'c' ELSE 'neu' || o_orderkey END AS neu
  FROM orders WHERE o_orderkey % 9 >= 5""")
def move_log(spark, sf_dir):
    lines = spark.sql(_LOG.replace("FROM orders", "FROM {orders}"), orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    return state.move_log(lines)[0]


@_query("move_log_warnings", "SELECT o_orderkey AS seq, CASE o_orderkey % 9 WHEN 2 THEN '4 fields expected, found 3' WHEN 3 THEN '4 fields expected, found 5' ELSE 'empty path' END AS warning FROM orders WHERE o_orderkey % 9 IN (2, 3, 4)")
def move_log_warnings(spark, sf_dir):
    lines = spark.sql(_LOG.replace("FROM orders", "FROM {orders}"), orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    return state.move_log(lines)[1]


@_query("newest_log", "SELECT arg_max(path, (mtime, path)) AS path FROM files_v")
def newest_log(spark, sf_dir):
    return state.newest_log(view(spark, sf_dir, "files_v"))


_JUNK = "CASE WHEN n IN ('.DS_Store', 'Thumbs.db', 'desktop.ini') THEN 'system' WHEN starts_with(n, '~$') THEN 'lock' WHEN regexp_matches(lower(n), '\\.(tmp|crdownload|part|download|partial)$') THEN 'partial' WHEN size = 0 THEN 'empty' END"


@_query("junk_files", f"SELECT path, size, {_JUNK} AS reason FROM (SELECT *, regexp_replace(path, '^.*/', '') AS n FROM names_v)")
def junk_files(spark, sf_dir):
    return view(spark, sf_dir, "names_v").select("path", "size", N.junk_reason(F.col("path"), F.col("size")).alias("reason"))


@_query("name_predicates", f"""SELECT path, starts_with(n, '.para-') AS state, {_MARKED} AS copy_name, regexp_matches(lower(n), 'personalausweis|reisepass|f[üu]hrerschein|ausweis|passport|identity[-_]?card') AS id_document, path = 'src1' OR starts_with(path, 'src1/') AS under
  FROM (SELECT path, regexp_replace(path, '^.*/', '') AS n FROM (SELECT path FROM names_v UNION SELECT path FROM files_v))""")
def name_predicates(spark, sf_dir):
    both = view(spark, sf_dir, "names_v").select("path").union(view(spark, sf_dir, "files_v").select("path")).distinct()
    p = F.col("path")
    return both.select("path", N.is_state_file(p).alias("state"), N.has_copy_marker(p).alias("copy_name"), N.is_id_document(p).alias("id_document"), N.is_under(p, F.lit("src1")).alias("under"))


_TRIAGE = f"""WITH h AS (SELECT hash, count(*)::BIGINT AS n_hits, min(path) AS first_hit FROM home_v GROUP BY hash),
  j AS (SELECT path, hash, size, n, {_JUNK} AS why FROM (SELECT *, regexp_replace(path, '^.*/', '') AS n FROM triage_v)),
  v AS (SELECT j.path, j.hash, size, why, n_hits, first_hit, CASE WHEN starts_with(n, '.para-') THEN 'state' WHEN m.hash IS NOT NULL THEN 'manifest' WHEN why IS NOT NULL THEN 'junk' WHEN q.hash IS NOT NULL THEN 'queue' WHEN n_hits IS NOT NULL THEN 'duplicate' ELSE 'content' END AS v
    FROM j LEFT JOIN (SELECT DISTINCT hash FROM manifest_v) m ON j.hash = m.hash LEFT JOIN queue_v q ON j.hash = q.hash LEFT JOIN h ON j.hash = h.hash),
  r AS (SELECT *, row_number() OVER (PARTITION BY hash, v IN ('duplicate', 'content') ORDER BY path) AS k FROM v),
  t AS (SELECT path, hash, size, CASE WHEN v IN ('duplicate', 'content') AND k > 1 THEN 'queue' ELSE v END AS verdict, why, n_hits, first_hit FROM r)
"""


@_query("triage_classify", _TRIAGE + "SELECT path, hash, size, verdict, CASE WHEN verdict = 'junk' THEN why END AS reason, CASE WHEN verdict = 'duplicate' THEN n_hits END AS n_hits, CASE WHEN verdict = 'duplicate' THEN first_hit END AS first_hit FROM t")
def triage_classify(spark, sf_dir):
    return intake.triage(*(view(spark, sf_dir, x) for x in ("triage_v", "manifest_v", "queue_v", "home_v")))


@_query("triage_counts", _TRIAGE + "SELECT verdict, count(*)::BIGINT AS n FROM t GROUP BY verdict")
def triage_counts(spark, sf_dir):
    return triage_classify(spark, sf_dir).groupBy("verdict").agg(F.count("*").alias("n"))


@_query("free_names", """WITH m AS (SELECT split_part(path, '/', 1) AS folder, 'doc.txt' AS name, doc_id AS seq FROM files_v),
  f AS (SELECT folder, 'doc' || CASE WHEN i = 0 THEN '' ELSE ' (' || i || ')' END || '.txt' AS target, row_number() OVER (PARTITION BY folder ORDER BY i) AS k FROM (SELECT DISTINCT folder FROM m), generate_series(0, 5000) g(i) WHERE i NOT IN (0, 2) )
  SELECT m.folder, m.name, m.seq, f.target FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY seq) AS k FROM m) m JOIN f ON m.folder = f.folder AND m.k = f.k""")
def free_names(spark, sf_dir):
    moves = view(spark, sf_dir, "files_v").select(F.split("path", "/")[0].alias("folder"), F.lit("doc.txt").alias("name"), F.col("doc_id").alias("seq"))
    taken = moves.select("folder").distinct().select("folder", F.explode(F.array(F.lit("doc.txt"), F.lit("doc (2).txt"))).alias("name"))
    return intake.free_names(moves, taken)


@_query("redundancy_moves", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY mtime DESC, path) AS k FROM files_v WHERE NOT starts_with(path, 'src3/'))
  SELECT 1 AS pass, a.path, b.path AS keep, 'src3/' || a.path AS target FROM r a JOIN r b ON a.hash = b.hash AND b.k = 1 WHERE a.k > 1""")
def redundancy_moves(spark, sf_dir):
    return intake.redundancy_passes(view(spark, sf_dir, "files_v").select("path", "hash", "mtime"), "src3")[0]


@_query("undo_plan", "SELECT doc_id AS seq, 'alt/' || path AS alt, path AS neu, 'verschoben' AS aktion, CASE WHEN doc_id % 10 = 0 THEN 'bereit' ELSE 'quelle_fehlt' END AS status FROM files_v")
def undo_plan(spark, sf_dir):
    files = view(spark, sf_dir, "files_v")
    log = files.select(F.col("doc_id").alias("seq"), F.concat(F.lit("alt/"), F.col("path")).alias("alt"), F.col("path").alias("neu"), F.lit("verschoben").alias("aktion"))
    return intake.undo_plan(log, files.where("doc_id % 10 = 0").select("path"))


# --- text ----------------------------------------------------------------------------------------------------------------------


@_query("garbled_documents", r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ts FROM documents)
  SELECT doc_id, len(ts) >= 20 AND len(list_filter(ts, lambda x: length(x) <= 2)) / nullif(len(ts), 0) > 0.35 AS garbled FROM t""")
def garbled_documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce(T.is_garbled(F.col("text")), F.lit(False)).alias("garbled"))


_BLANK_MARK = r"regexp_matches(coalesce(c[{0}], ' '), '[\t-\r\x{{85}}\pZ]')"
_MARK = lambda i: f"(c[{i}] IS NOT NULL AND NOT {_BLANK_MARK.format(i)})"


@_query("letter_spacing", f"""SELECT doc_id, array_to_string(list_transform(generate_series(4, len(c) - 3), lambda i: CASE WHEN c[i] = ' ' AND {_MARK('i-1')} AND {_MARK('i+1')}
  AND ((c[i+2] = ' ' AND {_MARK('i+3')}) OR (c[i-2] = ' ' AND {_MARK('i-3')})) THEN '' ELSE c[i] END), '') AS text FROM (SELECT doc_id, [NULL, NULL, NULL] || string_split(text, '') || [NULL, NULL, NULL] AS c FROM documents)""")
def letter_spacing(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", T.collapse_letter_spacing(F.col("text")).alias("text"))


def _re2(pattern: str) -> str:
    """A pattern for DuckDB: no flags but i and m."""
    return pattern.replace("(?U)", "").replace("(?iU)", "(?i)").replace("(?imdU)", "(?im)").replace("'", "''")


def _step(text: str, pattern: str, label: str) -> str:
    return f"regexp_replace({text}, '{_re2(pattern)}', '{label}', 'g')"


_STEPS = {label.strip("[]").lower().replace("/", "_").replace("-", "_").replace("__", "_") + ("_any" if i == 2 else ""): (p, label) for i, (p, label) in enumerate((*T.BEFORE_CARD, *T.AFTER_CARD))}
for _name, (_pattern, _label) in _STEPS.items():

    @_query(f"redact_{_name}", f"SELECT id, {_step('text', _pattern, _label)} AS text FROM letters_v")
    def _one(spark, sf_dir, pattern=_pattern, label=_label):
        return view(spark, sf_dir, "letters_v").select("id", F.regexp_replace("text", pattern, label).alias("text"))


def _redacted_sql() -> str:
    text = "text"
    for pattern, label in T.BEFORE_CARD:
        text = _step(text, pattern, label)
    text = _step(text, r"\b4242 4242 4242 4242[ \-]?\b", "[KREDITKARTE]")  # the only run with a valid check digit in these letters
    for pattern, label in T.AFTER_CARD:
        text = _step(text, pattern, label)
    return text


@_query("redact_cards", f"SELECT id, {_step('text', r'\b4242 4242 4242 4242[ \-]?\b', '[KREDITKARTE]')} AS text FROM letters_v")
def redact_cards(spark, sf_dir):
    return view(spark, sf_dir, "letters_v").select("id", T.redact_cards(F.col("text")).alias("text"))


@_query("redact_all", f"SELECT id, {_redacted_sql()} AS text FROM letters_v")
def redact_all(spark, sf_dir):
    return view(spark, sf_dir, "letters_v").select("id", T.redact(F.col("text")).alias("text"))


@_query("redaction_leaks", f"SELECT id, contains({_redacted_sql()}, '@example.org') AS mail, contains({_redacted_sql()}, '+49 170') AS phone FROM letters_v")
def redaction_leaks(spark, sf_dir):
    found = T.leaks(F.col("text"), F.array(F.lit("@example.org"), F.lit("+49 170")))
    return view(spark, sf_dir, "letters_v").select("id", found.alias("f")).select("id", F.array_contains("f", "@example.org").alias("mail"), F.array_contains("f", "+49 170").alias("phone"))


@_query("luhn_numbers", """WITH n AS (SELECT o_orderkey AS id, CAST(4000000000000000 + o_orderkey * 7919 AS VARCHAR) AS d FROM orders)
  SELECT id, list_sum(list_transform(generate_series(1, 16), lambda i: CASE WHEN i % 2 = 1 THEN (CAST(d[i] AS INT) * 2) % 10 + (CAST(d[i] AS INT) * 2) // 10 ELSE CAST(d[i] AS INT) END)) % 10 = 0 AS ok FROM n""")
def luhn_numbers(spark, sf_dir):
    digits = (F.lit(4000000000000000).cast("long") + F.col("o_orderkey") * 7919).cast("string")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), T.luhn(digits).alias("ok"))


def _date_sql(text: str) -> str:
    dmy = _re2(T.DMY_DATE)
    part = lambda i: f"regexp_extract({text}, '{dmy}', {i})"
    return f"coalesce(nullif(regexp_extract({text}, '{_re2(T.ISO_DATE)}', 1), ''), CASE WHEN {part(3)} <> '' THEN {part(3)} || '-' || lpad({part(2)}, 2, '0') || '-' || lpad({part(1)}, 2, '0') END)"


@_query("find_dates", f"SELECT id, {_date_sql('text')} AS date FROM letters_v")
def find_dates(spark, sf_dir):
    return view(spark, sf_dir, "letters_v").select("id", T.find_date(F.col("text")).alias("date"))


_HINT = f"nullif(left(trim(regexp_extract(text, '{_re2(T.SENDER)}', 0)), 80), '')"


@_query("sender_hints", f"SELECT id, {_HINT} AS sender FROM letters_v")
def sender_hints(spark, sf_dir):
    return view(spark, sf_dir, "letters_v").select("id", T.sender_hint(F.col("text")).alias("sender"))


_TYPES = "(VALUES " + ", ".join(f"({i}, '{c}', '{t}')" for i, (c, t) in enumerate(state.DOCUMENT_TYPES)) + ") AS x(ord, code, label)"
_VARIANTS = rf"""vs AS (SELECT ord, code, list_filter(list_transform(string_split(regexp_replace(label, '\([^)]*\)', ' ', 'g'), '/'), lambda p: lower(trim(regexp_replace(trim(p), '^[-–—]+|[-–—]+$', '', 'g')))), lambda p: length(p) >= 3) AS v FROM {_TYPES}),
  va AS (SELECT ord, code, unnest(v) AS variant, unnest(generate_series(0, len(v) - 1)) AS variant_ord FROM vs)"""


@_query("type_variants", f"WITH {_VARIANTS} SELECT ord, code, variant_ord::INT AS variant_ord, variant FROM va")
def type_variants(spark, sf_dir):
    return metadata.type_variants(state.document_types(spark))


def _types_sql(source: str) -> str:
    return rf"""WITH {source}, {_VARIANTS},
  tk AS (SELECT id, unnest(regexp_extract_all(lower(text), '[\pL\pN_]+(?:-[\pL\pN_]+)*')) AS t FROM base),
  tw AS (SELECT id, t FROM tk UNION ALL SELECT id, unnest(string_split(t, '-')) FROM tk WHERE contains(t, '-')),
  ct AS (SELECT id, ord, code, variant, variant_ord, count(*) AS hits FROM tw JOIN va ON t = variant GROUP BY ALL),
  b1 AS (SELECT *, row_number() OVER (PARTITION BY id, code ORDER BY hits DESC, variant_ord) AS r FROM ct WHERE hits > 0),
  ft AS (SELECT id, code, variant AS term, hits::INT AS hits, row_number() OVER (PARTITION BY id ORDER BY hits DESC, length(variant) DESC, ord)::INT AS place FROM b1 WHERE r = 1)"""


@_query("document_types_found", _types_sql("base AS (SELECT id, text FROM letters_v)") + " SELECT id, code, term, hits, place FROM ft")
def document_types_found(spark, sf_dir):
    return metadata.document_types_found(view(spark, sf_dir, "letters_v"), state.document_types(spark))


_META = _types_sql(f"base AS (SELECT id, {_redacted_sql()} AS text FROM letters_v)") + f""",
  w AS (SELECT id, max(code) FILTER (place = 1) AS code, max(term) FILTER (place = 1) AS term, string_agg(code || ' (' || term || '×' || hits || ')', ', ' ORDER BY place) FILTER (place > 1) AS others FROM ft GROUP BY id),
  f AS (SELECT base.id, text, code, term, others, {_date_sql('text')} AS date, {_HINT} AS sender FROM base LEFT JOIN w ON base.id = w.id)"""
_SLUG = "regexp_replace(regexp_replace(sender, '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@_query("metadata_pipeline", _META + f"""
  SELECT id, CASE WHEN date IS NOT NULL AND code IS NOT NULL THEN 'high' ELSE 'low' END AS confidence, date, code, term, sender,
  CASE WHEN date IS NOT NULL AND code IS NOT NULL THEN date || '_' || code || '_' || coalesce({_SLUG}, 'ABSENDER-PRUEFEN') || '.txt' END AS file_name,
  CASE WHEN date IS NULL OR code IS NULL THEN left(replace(trim(text), chr(10), ' '), 400) END AS snippet, CASE WHEN date IS NOT NULL AND code IS NOT NULL AND others IS NOT NULL THEN 'ambiguous: ' || others END AS warning FROM f""")
def metadata_pipeline(spark, sf_dir):
    return metadata.analyze(view(spark, sf_dir, "letters_v"), state.document_types(spark)).drop("alternatives")


@_query("image_metadata", _META + f""",
  i AS (SELECT *, coalesce(date, '2024-03-05') AS day FROM f WHERE id % 10 <> 0)
  SELECT id, false AS id_document, CASE WHEN code IS NOT NULL THEN 'high' ELSE 'low' END AS confidence, day AS date, code, sender, CASE WHEN code IS NOT NULL THEN day || '_' || code || '_' || coalesce({_SLUG}, 'Screenshot') || '.png' END AS file_name,
  CASE WHEN code IS NULL THEN left(replace(trim(text), chr(10), ' '), 400) END AS snippet, CASE WHEN date IS NOT NULL AND code IS NOT NULL AND others IS NOT NULL THEN 'ambiguous: ' || others END AS warning FROM i
  UNION ALL SELECT id, true AS id_document, 'low' AS confidence, NULL AS date, NULL AS code, NULL AS sender, NULL AS file_name, NULL AS snippet, 'id document' AS warning FROM f WHERE id % 10 = 0""")
def image_metadata(spark, sf_dir):
    letters = view(spark, sf_dir, "letters_v")
    name = F.when(F.col("id") % 10 == 0, F.lit("scan/reisepass.png")).otherwise(F.concat(F.lit("scan/"), F.col("id").cast("string"), F.lit(".png")))
    exif = F.array(F.lit("?"), F.lit("2024:03:05 10:00:00"))
    return metadata.analyze_images(letters.select("id", name.alias("path"), F.lit(".png").alias("ext"), "text", metadata.exif_date(exif).alias("exif_date")), state.document_types(spark))


@_query("placeholders", r"SELECT page_id, len(regexp_extract_all(html || CASE WHEN page_id % 3 = 0 THEN '{{NAME}}' ELSE '' END, '\{\{[^}]*\}\}'))::INT AS n FROM pages")
def placeholders(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", T.placeholders(F.concat("html", F.when(F.col("page_id") % 3 == 0, F.lit("{{NAME}}")).otherwise(F.lit("")))).cast("int").alias("n"))


# --- scoring, repositories, rules ----------------------------------------------------------------------------------------------

_LIMITS = "(VALUES " + ", ".join(f"({i}, '{m}', {r}::DOUBLE, {str(h).lower()})" for i, (m, r, h) in enumerate(scoring.THRESHOLDS)) + ") AS l(ord, metric, least, hard)"
_RATES = "SELECT metric, count(*) FILTER (ok)::BIGINT AS hits, count(ok)::BIGINT AS total, coalesce(count(*) FILTER (ok) / nullif(count(ok), 0), 1.0)::DOUBLE AS rate FROM cases_v GROUP BY metric"


@_query("metric_rates", _RATES)
def metric_rates(spark, sf_dir):
    return scoring.metric_rates(view(spark, sf_dir, "cases_v"))


@_query("metric_scorecard", f"SELECT ord, r.metric, hits, total, rate, least, hard, rate >= least AS passed FROM ({_RATES}) r JOIN {_LIMITS} ON r.metric = l.metric")
def metric_scorecard(spark, sf_dir):
    return scoring.scorecard(view(spark, sf_dir, "cases_v"), scoring.thresholds(spark))


@_query("gate_verdict", f"SELECT coalesce(bool_and(rate >= least), true) AS passed FROM ({_RATES}) r JOIN {_LIMITS} ON r.metric = l.metric")
def gate_verdict(spark, sf_dir):
    return scoring.verdict(metric_scorecard(spark, sf_dir))


@_query("precision_recall", "SELECT coalesce(count(*) FILTER (said AND truth) / nullif(count(*) FILTER (said), 0), 1.0)::DOUBLE AS precision, coalesce(count(*) FILTER (said AND truth) / nullif(count(*) FILTER (truth), 0), 1.0)::DOUBLE AS recall FROM cases_v")
def precision_recall(spark, sf_dir):
    return scoring.precision_recall(view(spark, sf_dir, "cases_v"))


_ASOF = "TIMESTAMP '2002-05-15 00:00:00'"


def _repos(spark, sf_dir):
    repos = view(spark, sf_dir, "repos_v").join(view(spark, sf_dir, "pushed_v"), "repo")
    return scoring.repo_metrics(repos, view(spark, sf_dir, "releases_v"), F.expr(_ASOF))


_METRICS = rf"""WITH rr AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY published_at DESC NULLS FIRST) AS k FROM releases_v),
  ra AS (SELECT repo, count(*) FILTER (published_at > {_ASOF} - INTERVAL 365 DAY)::BIGINT AS releases_last_year, max(CASE WHEN k = 1 THEN strftime(published_at, '%Y-%m-%dT%H:%M:%SZ') END) AS last_release FROM rr WHERE k <= 30 GROUP BY repo),
  mm AS (SELECT r.repo, stars, strftime(pushed_at, '%Y-%m-%dT%H:%M:%SZ') AS last_commit, archived, open_issues, round_even(open_issues / nullif(stars, 0) * 1000, 1) AS issues_per_1k_stars, coalesce(releases_last_year, 0) AS releases_last_year, last_release,
    coalesce(CAST(nullif(regexp_extract(link, '[?&]page=(\d+)>; rel="last"', 1), '') AS INT), 1) AS contributors_approx, pushed_at FROM repos_v r JOIN pushed_v p ON r.repo = p.repo LEFT JOIN ra ON r.repo = ra.repo)"""


@_query("repo_metrics", _METRICS + " SELECT * EXCLUDE (pushed_at) FROM mm")
def repo_metrics(spark, sf_dir):
    return _repos(spark, sf_dir)


_LIGHTS = _METRICS + f""",
  li AS (SELECT repo, CASE WHEN c < DATE '2001-05-15' THEN 'red' WHEN c < DATE '2001-11-15' THEN 'yellow' ELSE 'green' END AS commit_light, CASE WHEN releases_last_year = 0 AND c < DATE '2001-05-15' THEN 'red' WHEN releases_last_year <= 1 THEN 'yellow' ELSE 'green' END AS release_light,
    CASE WHEN stars < 300 THEN 'red' WHEN stars < 2000 THEN 'yellow' ELSE 'green' END AS star_light, CASE WHEN contributors_approx < 5 THEN 'red' WHEN contributors_approx < 20 THEN 'yellow' ELSE 'green' END AS contributor_light,
    CASE WHEN issues_per_1k_stars > 150 THEN 'yellow' ELSE 'green' END AS issue_light FROM (SELECT *, CAST(pushed_at AS DATE) AS c FROM mm))"""


@_query("traffic_lights", _LIGHTS + " SELECT * FROM li")
def traffic_lights(spark, sf_dir):
    return scoring.lights(_repos(spark, sf_dir).withColumn("commit", scoring.iso_time(F.col("last_commit"))), F.to_date(F.expr(_ASOF)))


@_query("rubric_points", _LIGHTS + """, n AS (SELECT repo, len(list_filter(l, lambda x: x = 'red')) AS r, len(list_filter(l, lambda x: x = 'yellow')) AS y FROM (SELECT repo, [commit_light, release_light, star_light, contributor_light, issue_light] AS l FROM li))
  SELECT repo, CASE WHEN r > 0 THEN 2 WHEN y = 0 THEN 5 WHEN y = 1 THEN 4 ELSE 3 END AS points FROM n""")
def rubric_points(spark, sf_dir):
    return scoring.points(traffic_lights(spark, sf_dir))


_SCORED = "SELECT category, candidate, (25 * maintenance + 25 * community + 20 * docs + 20 * maturity + 10 * fit) / 100 AS score, fit, archived OR deprecated OR months > 24 AS knocked_out FROM rubric_v"


def _candidates(spark, sf_dir):
    asof = F.to_date(F.expr(_ASOF))
    scored = scoring.weighted_score(view(spark, sf_dir, "rubric_v").withColumn("commit", F.add_months(asof, -F.col("months").cast("int"))))
    return scoring.knocked_out(scored, asof)


@_query("rubric_score", _SCORED)
def rubric_score(spark, sf_dir):
    return _candidates(spark, sf_dir).select("category", "candidate", "score", "fit", "knocked_out")


@_query("rubric_recommended", f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, candidate) AS k FROM ({_SCORED}) WHERE NOT knocked_out),
  p AS (SELECT a.category, a.candidate AS ca, b.candidate AS cb, a.fit AS fa, b.fit AS fb, b.candidate IS NOT NULL AND round(a.score - b.score, 6) < 0.3 AS near FROM s a LEFT JOIN s b ON a.category = b.category AND b.k = 2 WHERE a.k = 1)
  SELECT category, CASE WHEN near AND fb > fa THEN cb ELSE ca END AS candidate, CASE WHEN near THEN 'fit' ELSE 'score' END AS reason FROM p""")
def rubric_recommended(spark, sf_dir):
    return scoring.recommended(_candidates(spark, sf_dir))


@_query("slug_filter", "SELECT repo AS value FROM repos_v")
def slug_filter(spark, sf_dir):
    r = view(spark, sf_dir, "repos_v")
    return scoring.slugs(r.select(F.col("repo").alias("value")).union(r.select(F.col("n_nationkey").cast("string"))))


@_query("iso_times", "SELECT event_id, epoch_us(date_trunc('second', ts)) // 1000000 AS t FROM events")
def iso_times(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", F.unix_timestamp(scoring.iso_time(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))).alias("t"))


def _profiles(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    k = F.col("n_nationkey")
    kinds = F.array(F.when(k % 4 == 0, F.lit("web-app")).when(k % 4 == 1, F.lit("ki-projekt")).when(k % 4 == 2, F.lit("library")).otherwise(F.lit("cli")))
    return n.select(k.alias("id"), kinds.alias("types"), (k % 3 == 0).alias("persistence"), F.when(k % 5 == 0, F.lit("lokal")).otherwise(F.lit("cloud")).alias("hosting"), (k % 7 == 0).alias("ai"), (k % 2 == 0).alias("backend"))


_PROFILE = "(SELECT n_nationkey AS id, CASE n_nationkey % 4 WHEN 0 THEN 'web-app' WHEN 1 THEN 'ki-projekt' WHEN 2 THEN 'library' ELSE 'cli' END AS k, n_nationkey % 3 = 0 AS p, n_nationkey % 5 > 0 AS h, n_nationkey % 7 = 0 AS a, n_nationkey % 2 = 0 AS b FROM nation)"


@_query("research_categories", f"""SELECT id, concat_ws('|', 'Programmiersprache', CASE WHEN k <> 'library' THEN 'Framework (App/Web/Backend)' END, 'Wichtige Libraries', CASE WHEN p THEN 'Datenbank + ORM' END, 'Testing', 'Automatisierung / CI-CD',
  CASE WHEN h THEN 'Deployment / Hosting' END, CASE WHEN k = 'ki-projekt' OR a THEN 'KI-SDK / Provider' END, CASE WHEN k = 'web-app' THEN 'UI / Design-System-Basis' END) AS categories FROM {_PROFILE}""")
def research_categories(spark, sf_dir):
    return scoring.research_categories(_profiles(spark, sf_dir)).select("id", _joined("categories"))


@_query("context_files", f"""SELECT id, concat_ws('|', 'projekt-brief', 'architektur', 'tech-stack', 'coding-standards', 'testing', 'automatisierung', 'sicherheit', CASE WHEN b THEN 'api-design' END, CASE WHEN p THEN 'datenmodell' END,
  CASE WHEN k = 'web-app' THEN 'design-system' END, CASE WHEN h THEN 'deployment' END, CASE WHEN k = 'ki-projekt' OR a THEN 'ki-integration' END) AS files FROM {_PROFILE}""")
def context_files(spark, sf_dir):
    p = _profiles(spark, sf_dir)
    return scoring.context_files(scoring.research_categories(p).join(p.select("id", "backend"), "id")).select("id", _joined("files"))


_NAMES = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in scoring.FILE_NAMES) + ") AS t(name, english)"


@_query("translated_names", f"SELECT name, english FROM {_NAMES} UNION ALL SELECT n_name AS name, n_name AS english FROM nation")
def translated_names(spark, sf_dir):
    names = spark.createDataFrame([(a,) for a, _ in scoring.FILE_NAMES], "name string").union(spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_name"))
    return scoring.translated(names)


@_query("reference_errors", "SELECT CAST(o_custkey AS VARCHAR) AS name, 'missing' AS problem FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 > 0) UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'unreferenced' FROM customer WHERE c_custkey % 3 > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)")
def reference_errors(spark, sf_dir):
    name = lambda t, c: spark.read.parquet(f"{sf_dir}/{t}.parquet").select(F.col(c).cast("string").alias("name"))
    return scoring.reference_errors(name("orders", "o_custkey"), name("customer", "c_custkey").where("cast(name as bigint) % 3 > 0"))


@_query("meeting_defaults", """WITH m AS (SELECT conv_id, string_agg(text, '|' ORDER BY turn) FILTER (role = 'assistant') AS d, count(*) FILTER (role = 'assistant') AS n FROM conversations GROUP BY conv_id)
  SELECT conv_id AS id, CASE WHEN conv_id % 3 = 0 THEN '2024-01-01' ELSE 'nicht angegeben' END AS date, coalesce(d, 'Keine') AS decisions, CASE WHEN conv_id % 2 = 0 THEN 'anna' ELSE 'nicht genannt' END AS owner, 'Keine' AS open, 'nicht angegeben' AS participants FROM m""")
def meeting_defaults(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    said = F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", "text")))), lambda x: x["text"])
    item = F.struct(F.lit("t").alias("task"), F.when(F.col("conv_id") % 2 == 0, F.lit("anna")).alias("owner"), F.lit(None).cast("string").alias("due"))
    none = F.array().cast("array<string>")
    m = c.groupBy("conv_id").agg(said.alias("decisions")).select(F.col("conv_id").alias("id"), F.when(F.col("conv_id") % 3 == 0, F.lit("2024-01-01")).alias("date"), none.alias("participants"), "decisions", F.array(item).alias("items"), none.alias("open"))
    return scoring.filled_meeting(m).select("id", "date", _joined("decisions"), F.col("items")[0]["owner"].alias("owner"), _joined("open"), _joined("participants"))


@_query("dispositions", rf"""SELECT path, CASE WHEN j IS NOT NULL THEN 'delete' WHEN regexp_matches(lower(n), 'personalausweis|reisepass|f[üu]hrerschein|ausweis|passport|identity[-_]?card') THEN 'unclear' WHEN ends_with(n, '.dmg') THEN 'keep_name' WHEN doc_id % 3 = 0 THEN 'rename' ELSE 'unclear' END AS disposition
  FROM (SELECT path, doc_id, n, {_JUNK} AS j FROM (SELECT *, regexp_replace(path, '^.*/', '') AS n FROM names_v))""")
def dispositions(spark, sf_dir):
    return filing.disposition(view(spark, sf_dir, "names_v").withColumn("confidence", F.when(F.col("doc_id") % 3 == 0, F.lit("high")).otherwise(F.lit("low"))))


@_query("target_names", rf"""SELECT path, CASE WHEN ends_with(path, '.dmg') OR regexp_matches(path, '\.jpg$') THEN NULL WHEN contains(path, '/Screenshot') THEN '2024-05-06_Screenshot_was.png' ELSE '2024-05-06_RG_was' || regexp_extract(lower(regexp_replace(path, '^.*/', '')), '^.+(\.[^.]*)$', 1) END AS target
  FROM (SELECT DISTINCT path FROM (SELECT path, n, {_JUNK} AS j FROM (SELECT *, regexp_replace(path, '^.*/', '') AS n FROM names_v)) WHERE j IS NULL AND NOT starts_with(n, '.para-'))""")
def target_names(spark, sf_dir):
    """Of every file that is neither junk nor a state file."""
    p = F.col("path")
    lit = lambda x: F.lit(x).cast("string")
    kept = view(spark, sf_dir, "names_v").where(N.junk_reason(p, F.col("size")).isNull() & ~N.is_state_file(p))
    return kept.select("path").distinct().select("path", filing.target_name(filing.kind_of(p), lit(None), lit("RG"), lit("was"), p, lit("2024-05-06")).alias("target"))


@_query("superseded_installers", r"""WITH i AS (SELECT path, split_part(path, '/', 1) AS f, CAST(regexp_extract(path, 'setup-1\.(\d+)\.dmg$', 1) AS INT) AS v FROM names_v WHERE ends_with(path, '.dmg')),
  t AS (SELECT f, arg_max(path, (v, path)) AS newest, max(v) AS top FROM i GROUP BY f) SELECT i.path, t.newest FROM i JOIN t ON i.f = t.f WHERE v < top""")
def superseded_installers(spark, sf_dir):
    return filing.superseded_installers(view(spark, sf_dir, "names_v"))


@_query("age_candidates", "SELECT o_orderkey, 'uncertain' AS certainty FROM orders WHERE CAST(o_orderdate AS DATE) < DATE '2000-05-15'")
def age_candidates(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.to_date("o_orderdate").alias("mtime"))
    return filing.age_candidates(o, F.to_date(F.lit("2001-05-15"))).select("o_orderkey", "certainty")


@_query("depth_rule", "SELECT doc_id, 4 AS depth FROM documents WHERE doc_id % 4 = 0 AND source <> 'src1'")
def depth_rule(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    paths = d.select("doc_id", F.concat_ws("/", "source", F.when(F.col("doc_id") % 4 == 0, F.lit("a/b/c")).otherwise(F.lit("a")), F.col("doc_id").cast("string")).alias("path"))
    closed = spark.createDataFrame([("src1/a",)], "folder string")
    return filing.too_deep(paths, closed).select(F.element_at(F.split("path", "/"), -1).cast("long").alias("doc_id"), "depth")


@_query("scan_exclusions", "SELECT path FROM files_v WHERE NOT starts_with(path, 'src1/') AND NOT starts_with(path, 'src2/')")
def scan_exclusions(spark, sf_dir):
    return filing.without(view(spark, sf_dir, "files_v").select("path"), spark.createDataFrame([("src1",), ("src2",)], "folder string"))


@_query("home_scheme", r"""WITH n AS (SELECT n_regionkey AS root, CASE n_nationkey % 4 WHEN 0 THEN '1_' || n_name WHEN 1 THEN '2-' || n_name WHEN 2 THEN n_name ELSE '3_' || n_name END AS name FROM nation),
  s AS (SELECT root, regexp_extract(name, '^\d+([_-]|\. )\S', 1) AS sep FROM n), c AS (SELECT root, sep, count(*) AS k FROM s WHERE sep <> '' GROUP BY root, sep)
  SELECT root, sum(k)::BIGINT AS n, arg_max(sep, (k, -ascii(sep))) AS separator FROM c GROUP BY root""")
def home_scheme(spark, sf_dir):
    k, name = F.col("n_nationkey") % 4, F.col("n_name")
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_regionkey").alias("root"), F.when(k == 0, F.concat(F.lit("1_"), name)).when(k == 1, F.concat(F.lit("2-"), name)).when(k == 2, name).otherwise(F.concat(F.lit("3_"), name)).alias("name"))
    return filing.home_scheme(n)


@_query("batch_order", "SELECT path, (row_number() OVER (ORDER BY size, mtime, path) - 1) // 50 AS batch FROM files_v")
def batch_order(spark, sf_dir):
    return filing.batches(view(spark, sf_dir, "files_v"))


@_query("repo_payloads", "SELECT 'org/' || n_name AS repo, n_nationkey * 10 AS stars, 1::BIGINT AS n FROM nation")
def repo_payloads(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    about = F.to_json(F.struct((F.col("n_nationkey") * 10).alias("stargazers_count"), F.lit("2024-01-02T03:04:05Z").alias("pushed_at"), F.lit(False).alias("archived"), F.lit(3).alias("open_issues_count")))
    payloads = n.select(F.concat(F.lit("org/"), "n_name").alias("repo"), about.alias("repo_json"), F.lit('[{"published_at": "2024-01-02T03:04:05Z"}]').alias("releases_json"), F.lit(None).cast("string").alias("link"))
    repos, releases = repo_rows(payloads)
    return repos.join(releases.groupBy("repo").agg(F.count("*").alias("n")), "repo").select("repo", "stars", "n")
