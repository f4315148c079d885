"""Document-hygiene operators on small fixtures: quirks of the order of steps, ties, edges, state files, trees and streams."""

import os
import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from loomdoc.functions import names as N
from loomdoc.functions import text as T
from loomdoc.operators import dedupe, evaluation, filing, flows, intake, metadata, scoring
from loomdoc.operators.moves import apply_moves, apply_undo
from loomdoc.plans.queries import ORACLE_SQL, QUERIES
from loomdoc.plans.views import view
from loomdoc.sources import state
from loomdoc.sources.filetree import file_tree
from loomdoc.sources.readers import file_texts, int_option
from loomdoc.streaming.intake import file_stream, triage_stream


def one(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_redaction(spark):
    got = one(
        spark, T.redact, "GB29 NWBK 6016 1331 9268 19 as agreed. Ende", "GB29 NWBK 6016 1331 9268 19 2026-07-02", "Karte 4242 4242 4242 4242 Ablauf", "Karte 4242 4242 4242 4243 x", "4242424242424243",
        "Tel +49 170 1234567", "a.b@c.org und 2024-05-06 sowie 6.5.2024", "Herr Max Muster, Lindenweg 12a", "Kundennummer: AB-1/2 für 1.234,50 EUR", None, "",
    )
    assert got == ["[IBAN]. Ende", "[IBAN]-07-02", "Karte [KREDITKARTE]Ablauf", "Karte 4242 4242 4242 4243 x", "[NUMMER]", "Tel +49 170 1234567", "[EMAIL] und 2024-05-06 sowie 6.5.2024", "[NAME], [ADRESSE]", "[KUNDEN-/KONTONUMMER] für [BETRAG]", None, ""]
    assert one(spark, lambda c: T.redact(c, True), "Tel +49 170 1234567") == ["Tel [TELEFON]"]


def test_cards_of_all_letters(spark, sf):
    """Against Python's expressions and a check digit of its own, over every kind of letter and over random runs."""
    def valid(run):
        d = [int(x) for x in run if x.isdigit()][::-1]
        return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0

    cards = lambda text: re.sub(T.CARD.replace("(?U)", ""), lambda m: "[KREDITKARTE]" if valid(m[0]) else m[0], text)
    letters = {x["id"]: x["text"] for x in view(spark, sf, "letters_v").select("id", "text").collect()}
    got = {x["id"]: x["text"] for x in QUERIES["redact_cards"](spark, sf).collect()}
    assert got == {i: cards(t) for i, t in letters.items()} and {i % 6 for i in got} == set(range(6))
    r = random.Random(13)
    texts = [" x ".join("".join(r.choice("0123456789") + r.choice(["", "", "", " ", "-"]) for _ in range(r.randint(11, 22))) for _ in range(4)) for _ in range(200)]
    assert one(spark, T.redact_cards, *texts) == [cards(x) for x in texts] and any("[KREDITKARTE]" in cards(x) for x in texts)


def test_targets_of_all_names(spark, sf):
    rows = view(spark, sf, "names_v").select("path", "size").collect()
    junk = lambda n, size: size == 0 or n == ".DS_Store" or n.startswith("~$") or n.endswith(".crdownload")
    want = {x["path"] for x in rows if not junk(n := x["path"].split("/")[-1], x["size"]) and not n.startswith(".para-")}
    got = {x["path"]: x["target"] for x in QUERIES["target_names"](spark, sf).collect()}
    assert set(got) == want and want
    end = lambda p: "2024-05-06_Screenshot_was.png" if "/Screenshot" in p else None if p.endswith((".jpg", ".dmg")) else "2024-05-06_RG_was.txt"
    assert got == {p: end(p) for p in want}


def test_letter_spacing_matches_the_greedy_scan(spark):
    r = random.Random(1)
    given = ["".join(r.choice("ab  ä\n") for _ in range(r.randint(0, 25))) for _ in range(400)]
    assert one(spark, T.collapse_letter_spacing, *given) == [re.sub(r"(?:\S ){2,}\S", lambda m: m[0].replace(" ", ""), x) for x in given]


def test_dates_and_garbled(spark):
    assert one(spark, T.find_date, "am 3.4.2020, nicht 2021-05-06", "3.4.2020", "2026-13-99", "x", None) == ["2021-05-06", "2020-04-03", "2026-13-99", None, None]
    assert one(spark, T.is_garbled, "ab " * 19, "ab " * 7 + "abc " * 13, "ab " * 8 + "abc " * 12, "") == [False, False, True, False]


def test_names(spark):
    assert one(spark, N.folder_base, "files (2)", "Kit 2", "a kopie", "(1)", "plain") == ["files", "kit", "a", None, "plain"]
    assert one(spark, lambda c: N.junk_reason(c, F.lit(1)), "a/.DS_Store", "~$x.docx", "b.PART", "b.txt") == ["system", "lock", "partial", None]
    assert one(spark, lambda c: N.is_under(c, F.lit("a/b")), "a/b", "a/b/c", "a/bc") == [True, True, False]
    assert one(spark, N.extension, "a/.hidden", "x.tar.GZ", "x") == ["", ".gz", ""]


def test_document_types(spark):
    types = state.document_types(spark)
    rows = spark.createDataFrame([(1, "Vertrag Rechnung rechnung, Rechnung"), (2, "vertraglich"), (3, "Antrag Protokoll"), (4, "Angebot Angebot Vertrag/Vertrag")], "id long, text string")
    got = {r["id"]: r for r in metadata.best_types(rows, types).collect()}
    assert got[1]["code"] == "RG" and [tuple(x) for x in got[1]["alternatives"]] == [("VTR", "vertrag", 1)]
    assert 2 not in got and got[3]["code"] == "PROT" and got[4]["code"] == "ANG"
    assert one(spark, T.variants, "Bescheid (Behörde/Amt)", "Reise-/Veranstaltungsbuchung", "ab/cde") == [["bescheid"], ["reise", "veranstaltungsbuchung"], ["cde"]]


def test_no_snippet_of_garbled_text(spark):
    rows = spark.createDataFrame([(1, ".txt", "xy zq " * 20), (2, ".txt", " "), (3, ".txt", "Rechnung vom 1.2.2024"), (4, ".txt", "Herr Max Muster schreibt")], "id long, ext string, text string")
    got = {r["id"]: r for r in metadata.analyze(rows, state.document_types(spark)).collect()}
    assert got[1]["warning"] == "garbled" and got[1]["snippet"] is None and got[2]["warning"] == "empty"
    assert got[3]["file_name"] == "2024-02-01_RG_ABSENDER-PRUEFEN.txt" and got[4]["snippet"] == "[NAME] schreibt"


def test_near_duplicates(spark):
    r = random.Random(3)
    base = "".join(r.choice("abcdefgh ") for _ in range(180))
    texts = {"a/1.txt": base, "a/2.txt": base[:170] + "zzzzzzzzzz", "a/3.txt": base[:150] + "y" * 30, "a/4.txt": "quite another text", "b/5.md": base, "a/6.txt": " "}
    files = spark.createDataFrame([(p, str(hash(t + p)), 1, t) for p, t in texts.items()], "path string, hash string, mtime long, text string")
    edges = {(x["path_a"], x["path_b"]): x["ratio"] for x in dedupe.near_edges(files.withColumn("ext", N.extension(F.col("path")))).collect()}
    want = {(a, b): q for a in texts for b in texts if a < b and a[-3:] == b[-3:] and texts[a].strip() and texts[b].strip() and (q := SequenceMatcher(None, texts[a], texts[b]).ratio()) >= 0.85}
    assert edges == want and want
    groups, warnings = dedupe.near_duplicates(files)
    assert [r["leader"] for r in groups.collect()] == ["a/1.txt"] and not warnings
    assert dedupe.near_duplicates(files, most=2)[0].count() == 0 and dedupe.near_duplicates(files, most=2)[1]


def test_near_duplicates_scaled_is_exact(spark):
    """A group of over 200 near copies, short texts, and texts over 200 characters, where the matcher leaves out frequent characters."""
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzäß") for _ in range(r.randint(2, 9))) for _ in range(60)]
    said = lambda n: " ".join(r.choice(words) for _ in range(n))
    base, longer = said(16), said(60)
    texts = [base[:i] + r.choice("xyz#") + base[i + 1 :] + str(j) for j in range(230) for i in [r.randrange(len(base))]]
    texts += [longer[:i] + said(2) + longer[i + 9 :] for i in range(0, 300, 12)] + [said(n) for n in range(1, 60)] + ["abc", "abcd", "abcde", "abcdef", "Abcdef", "a b c d", "\U0001f600" * 9, "\U0001f600" * 8]
    files = spark.createDataFrame([(f"d/{i}.{'md' if i % 40 == 0 else 'txt'}", str(i), 1, t) for i, t in enumerate(texts)], "path string, hash string, mtime long, text string")
    rows = [(x["ext"], x["path_a"], x["path_b"], x["ratio"]) for x in dedupe.near_duplicates_scaled(files).collect()]
    by = sorted((f"d/{i}.{'md' if i % 40 == 0 else 'txt'}", t) for i, t in enumerate(texts))
    want = {(os.path.splitext(a)[1], a, b, q) for x, (a, s) in enumerate(by) for b, t in by[x + 1 :] if a.split(".")[1] == b.split(".")[1] and (q := SequenceMatcher(None, s, t).ratio()) >= 0.85}
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 20_000
    some = sorted(texts[200:290], key=len)
    pairs = {(a, b) for a, b, _ in dedupe.block_pairs((list(map(str, range(90))),) * 2, (some,) * 2, 0.85, True)}
    assert pairs == {(a, b) for i in range(90) for j in range(90) if (a := str(i)) < (b := str(j)) and SequenceMatcher(None, some[i], some[j]).ratio() >= 0.85}


def test_leaders_are_not_transitive(spark):
    edges = spark.createDataFrame([(".txt", "a", "b", 0.9), (".txt", "b", "c", 0.9), (".txt", "c", "d", 0.9)], "ext string, path_a string, path_b string, ratio double")
    assert sorted(tuple(r["files"]) for r in dedupe.leader_groups(edges).collect()) == [("a", "b"), ("c", "d")]


def test_folders(spark):
    rows = [("x", 1), ("x", 2), ("y (2)", 1), ("z", 1), ("z", 2), ("w", 9), ("y (2)", 1)]
    got = {tuple(r) for r in dedupe.folder_relations(spark.createDataFrame(rows, "folder string, hash long")).collect()}
    assert got == {("identical", "x", "z", None), ("a_in_b", "y (2)", "x", "y"), ("a_in_b", "y (2)", "z", "y")}


def test_folders_of_the_whole_table(spark, sf):
    """Against brute force, with classes of equal folders and a hash that all folders have."""
    r = random.Random(7)
    sets = {f"f{i}": {0, *(r.randrange(1, 9) for _ in range(r.randint(0, 4)))} for i in range(80)}
    got = [tuple(x) for x in dedupe.folder_relations(spark.createDataFrame([(f, h) for f, hs in sets.items() for h in hs], "folder string, hash long")).select("relation", "folder_a", "folder_b").collect()]
    want = {("identical" if s == t else "a_in_b", a, b) for a, s in sets.items() for b, t in sets.items() if (s == t and a < b) or s < t}
    assert len(got) == len(set(got)) and set(got) == want
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_partkey").collect()
    held, having = {}, {}
    for k, p in lines:
        held.setdefault(k, set()).add(p)
        having.setdefault(p, set()).add(k)
    want = {("identical" if held[a] == held[b] else "a_in_b", a, b) for a, s in held.items() for b in having[min(s)] if s <= held[b] and a != b}
    got = QUERIES["subset_folders"](spark, sf).selectExpr("relation", "cast(split(folder_a, ' ')[1] as bigint) a", "cast(split(folder_b, ' ')[1] as bigint) b").collect()
    key = lambda rel, a, b: (rel, *(sorted((a, b)) if rel == "identical" else (a, b)))
    assert len(got) == len({tuple(x) for x in got}) and {key(*x) for x in got} == {key(*x) for x in want} and max(a for _, a, _ in want) > 200
    assert QUERIES["folder_base_names"](spark, sf).count() == len(held)


def test_folders_write_little(spark, sf):
    """What meets is left out before it is written: pairs that lie in each other, and few besides. Unread files count for nothing."""
    sets = {f"f{i}": {0, *range(1 + 3 * i, 4 + 3 * i)} for i in range(300)}  # one hash in all folders, the others in none but one
    sets |= {f"g{i}": {i % 50, 60 + i % 7, 70 + i % 11, 90 + i % 13} for i in range(900)} | {f"s{i}": {i % 50} for i in range(60)}
    rows = [(f, h) for f, hs in sets.items() for h in hs] + [("f1", None), ("none", None)]
    kept, put = [], dedupe.written
    dedupe.written = lambda df, label, *by, **more: kept.append((label, put(df, label, *by, **more))) or kept[-1][1]
    try:
        got = [tuple(x) for x in dedupe.folder_relations(spark.createDataFrame(rows, "folder string, hash long")).select("relation", "folder_a", "folder_b").collect()]
    finally:
        dedupe.written = put
    want = {("identical" if s == t else "a_in_b", a, b) for a, s in sets.items() for b, t in sets.items() if (s == t and a < b) or s < t}
    assert len(got) == len(set(got)) and set(got) == want and {r for r, _, _ in want} == {"identical", "a_in_b"}
    assert [x for x, _ in kept] == ["folders", "met"] and kept[0][1].count() == len(sets) and kept[1][1].count() < 1.2 * len(want)


def test_undo_chain(spark):
    log = spark.createDataFrame([(1, "a", "b", "m"), (2, "b", "c", "m"), (3, "p", "q", "m"), (4, "s", "s", "m"), (5, "t", "u", "m")], "seq long, alt string, neu string, aktion string")
    exists = spark.createDataFrame([("c",), ("t",), ("u",)], "path string")
    plan = intake.undo_plan(log, exists)
    assert [r["status"] for r in plan.orderBy(F.desc("seq")).collect()] == ["ziel_belegt", "identisch", "quelle_fehlt", "bereit", "bereit"]
    assert [r["seq"] for r in intake.tail(plan, 2).collect()] == [5, 4]


def test_undo_folds_each_chain_by_itself(spark, sf):
    """Against the fold over the whole log, with chains, paths used again and again, and steps that share no path."""
    r = random.Random(11)
    log = [(i, f"n{r.randrange(60)}", f"n{r.randrange(60)}", "m") for i in range(40)] + [(40 + i, f"a{i}", r.choice([f"a{i}", f"b{i}"]), "m") for i in range(60)]
    log += [(100 + i, f"c{i}", f"c{i + 1}", "m") for i in range(12)]
    exists = {"c12", *(f"n{i}" for i in range(0, 60, 2)), *(f"b{i}" for i in range(0, 60, 2)), *(f"a{i}" for i in range(0, 60, 3))}
    there, want = set(exists), {}
    for seq, alt, neu, _ in sorted(log, reverse=True):
        want[seq] = "identisch" if alt == neu else "quelle_fehlt" if neu not in there else "ziel_belegt" if alt in there else "bereit"
        if want[seq] == "bereit":
            there = (there - {neu}) | {alt}
    plan = intake.undo_plan(spark.createDataFrame(log, "seq long, alt string, neu string, aktion string"), spark.createDataFrame([(x,) for x in exists], "path string"))
    got = plan.collect()
    assert len(got) == len(log) and {x["seq"]: x["status"] for x in got} == want and len(set(want.values())) == 4
    assert QUERIES["undo_plan"](spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_moves_are_carried_out_and_undone(spark, tmp_path):
    at = lambda *p: str(tmp_path.joinpath(*p))
    for name in ("a", "b", "c"):
        (tmp_path / name).write_text(name)
    moves = spark.createDataFrame([(1, at("a"), at("bin", "a")), (1, at("b"), at("c")), (1, at("no"), at("bin", "no"))], "pass int, path string, target string")
    want = [None, "target is taken", "source is missing"]
    assert [e for *_, e in apply_moves(moves)] == want and sorted(os.listdir(tmp_path)) == ["a", "b", "c"]
    assert [e for *_, e in apply_moves(moves, apply=True)] == want and (tmp_path / "bin" / "a").read_text() == "a" and (tmp_path / "c").read_text() == "c" and not (tmp_path / "a").exists()
    log = spark.createDataFrame([(1, at("a"), at("x"), "m"), (2, at("x"), at("bin", "a"), "m")], "seq long, alt string, neu string, aktion string")
    plan = intake.undo_plan(log, spark.createDataFrame([(at("bin", "a"),), (at("b"),), (at("c"),)], "path string"))
    assert [e for *_, e in apply_undo(plan)] == [None, None] and not (tmp_path / "a").exists()
    assert [e for *_, e in apply_undo(plan, apply=True)] == [None, None] and (tmp_path / "a").read_text() == "a" and not (tmp_path / "bin" / "a").exists()
    (tmp_path / "bin" / "a").write_text("new")
    assert [e for *_, e in apply_undo(plan, apply=True)] == [None, "target is taken"] and (tmp_path / "a").read_text() == "a"


def test_redundancy(spark):
    files = spark.createDataFrame([("a", "h", 1), ("b", "h", 3), ("c", "h", 3), ("bin/d", "h", 9), ("e", "k", 1)], "path string, hash string, mtime long")
    moves, left, stable = intake.redundancy_passes(files, "bin")
    assert sorted(r["path"] for r in moves.collect()) == ["a", "c"] and stable and sorted(r["path"] for r in left.collect()) == ["b", "e"]
    assert not intake.redundancy_passes(files, "bin", most=1)[2]
    assert intake.redundancy_passes(files.limit(0), "bin")[2]


def test_state_files(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"hash": "h", "ziel": "a"}\n\nno\n[1]\n{"ziel": "x"}\n{"hash": "h", "ziel": "b"}\n')
    rows = state.json_rows(state.numbered_lines(spark, str(tmp_path / "m.jsonl")), state.MANIFEST)
    assert [(r["hash"], r["ziel"]) for r in state.latest(rows).collect()] == [("h", "b")]
    assert sorted(r["line_no"] for r in state.skipped_lines(state.numbered_lines(spark, str(tmp_path / "m.jsonl")), state.MANIFEST).collect()) == [3, 4, 5]
    (tmp_path / "log.csv").write_text('zeitstempel;aktion;alt;neu\nt;m; a ;b\n;;;\nt;m;x\nzeitstempel;aktion;alt;neu\nt;m;"a;1";"q""q"\nt;m;;b\n')
    good, bad = state.move_log(state.numbered_lines(spark, str(tmp_path / "log.csv")))
    assert [(r["seq"], r["alt"], r["neu"]) for r in good.orderBy("seq").collect()] == [(2, "a", "b"), (6, "a;1", 'q"q')] and sorted(r["seq"] for r in bad.collect()) == [4, 7]
    (tmp_path / "t.md").write_text("| Code | Label |\n|---|---|\n| RG | Rechnung |\n| ANG | Angebot |\n")
    assert [tuple(r) for r in state.parse_document_types(state.numbered_lines(spark, str(tmp_path / "t.md"))).orderBy("ord").collect()] == [(0, "RG", "Rechnung"), (1, "ANG", "Angebot")]


def test_file_tree_and_stream(spark, tmp_path):
    root = tmp_path / "in"
    for p, text in {".DS_Store": "x", "empty.pdf": "", "a.txt": "same", "sub/b.txt": "same", "proj/package.json": "{}", "proj/x.txt": "no", "node_modules/y.txt": "no", "sub/_q/z.tmp": "z"}.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(text)
    files, broken, skipped = file_tree(spark, str(root))
    rel = lambda df: sorted(os.path.relpath(r["path"], root) for r in df.collect())
    assert rel(files) == [".DS_Store", "a.txt", "empty.pdf", "sub/_q/z.tmp", "sub/b.txt"] and rel(skipped) == ["proj"] and not broken.count()
    assert dedupe.exact_groups(files).first()["n_files"] == 2
    gone = file_tree(spark, str(tmp_path / "no such folder"))
    assert gone[0].count() == 0 and "no such folder" in gone[1].first()["error"]
    texts = {os.path.basename(r["path"]): r for r in file_texts(files).collect()}
    assert texts["a.txt"]["text"] == "same" and texts["empty.pdf"]["text"] is None and texts["z.tmp"]["warning"]


def test_triage_stream(spark, tmp_path):
    """Two empty files, junk and a document of one content, a file moved in with an old time, one that can't be read, and copies."""
    root, out = tmp_path / "in", str(tmp_path / "out")
    none = spark.createDataFrame([], "hash string, path string")
    runs = []

    def write(**files):
        for p, text in files.items():
            p = p.replace("__", ".")
            (root / p).parent.mkdir(parents=True, exist_ok=True)
            (root / p).write_text(text)

    def run():
        triage_stream(file_stream(spark, str(root), str(tmp_path / "seen")), none, none, out, str(tmp_path / "ck"), notify=lambda b, n: runs.append(n)).awaitTermination()
        return {os.path.basename(r["path"]): r for r in spark.read.parquet(out).collect()}

    write(empty1__pdf="", empty2__pdf="", a__part="same", b__pdf="same", c__txt="copy", d__txt="copy", __DS_Store="x")
    os.symlink(root / "nowhere", root / "broken.txt")
    got = run()
    assert {n: r["verdict"] for n, r in got.items()} == {"empty1.pdf": "junk", "empty2.pdf": "junk", "a.part": "junk", "b.pdf": "content", "c.txt": "content", "d.txt": "queue", ".DS_Store": "junk", "broken.txt": "unreadable"}
    assert got["broken.txt"]["error"] and got["b.pdf"]["error"] is None
    write(moved_in__txt="old", again__pdf="same", empty3__pdf="")
    os.utime(root / "moved_in.txt", (1_000_000_000, 1_000_000_000))
    got = run()
    assert {n: got[n]["verdict"] for n in ("moved_in.txt", "again.pdf", "empty3.pdf")} == {"moved_in.txt": "content", "again.pdf": "queue", "empty3.pdf": "junk"}
    assert len(run()) == len(got) == sum(runs) == 11
    write(b__pdf="changed")
    assert run()["b.pdf"]["verdict"] == "content" and sum(runs) == 12


def test_free_names(spark):
    moves = spark.createDataFrame([("d", "a.b.txt", 2), ("d", "a.b.txt", 1), ("e", "a.b.txt", 1), ("d", ".x", 1)], "folder string, name string, seq int")
    taken = spark.createDataFrame([("d", "a.b.txt"), ("d", "a.b (1).txt"), ("d", "other")], "folder string, name string")
    got = {(r["folder"], r["name"], r["seq"]): r["target"] for r in intake.free_names(moves, taken).collect()}
    assert got == {("d", "a.b.txt", 1): "a.b (2).txt", ("d", "a.b.txt", 2): "a.b (3).txt", ("e", "a.b.txt", 1): "a.b.txt", ("d", ".x", 1): ".x"}
    assert intake.free_names(moves.where("folder = 'd' and seq = 1 and name = 'a.b.txt'"), taken, "_{n}").first()["target"] == "a.b_1.txt"


def test_gate_catches_a_planted_leak(spark):
    limits = scoring.thresholds(spark)
    checks = lambda ok: spark.createDataFrame([("schwaerzung_leak_frei", ok), ("datum_korrekt", True)], "metric string, ok boolean")
    assert scoring.verdict(scoring.scorecard(checks(True), limits)).first()[0] and not scoring.verdict(scoring.scorecard(checks(False), limits)).first()[0]
    rates = scoring.metric_rates(spark.createDataFrame([("m", None)], "metric string, ok boolean")).first()
    assert rates["rate"] == 1.0 and rates["total"] == 0


def test_rules(spark):
    files = spark.createDataFrame([("d/App-1.2.dmg",), ("d/App-1.10.dmg",), ("e/App-1.2.dmg",)], "path string")
    assert [tuple(r) for r in filing.superseded_installers(files).collect()] == [("d/App-1.2.dmg", "d/App-1.10.dmg")]
    assert [int_option(x, 3) for x in (None, "x", "0", "7")] == [3, 3, 3, 7]


def test_triage_flow(spark, tmp_path):
    src, bin_ = tmp_path / "in", tmp_path / "in" / "bin"
    bin_.mkdir(parents=True)
    for name, text in {"a.part": "x", "b.part": "y", "brief.txt": "Rechnung vom 1.2.2024", "copy.txt": "Rechnung vom 1.2.2024", "held.md": "held", "done.txt": "done"}.items():
        (src / name).write_text(text)
    (bin_ / "a.part").write_text("older")
    os.symlink(src / "nowhere", src / "broken.txt")
    files, broken, _ = file_tree(spark, str(src))
    files = files.withColumn("error", F.lit(None).cast("string")).unionByName(broken, allowMissingColumns=True)
    by = {os.path.basename(r["path"]): r["hash"] for r in files.collect()}
    one = lambda h, c: spark.createDataFrame([(h, "ziel/x")], f"hash string, {c} string")
    queue = str(tmp_path / "queue")

    def plan():
        known = spark.read.schema(state.QUEUE).json(queue).select("hash") if os.path.exists(queue) else spark.createDataFrame([], "hash string")
        return flows.triage_plan(files, one(by["done.txt"], "ziel"), known, one(by["held.md"], "path"), str(bin_), F.lit("t"), file_texts(files), state.document_types(spark))

    dry = flows.triage_run(plan(), queue, str(tmp_path / "log"), "t")
    assert [e for *_, e in dry] == [None, None] and (src / "a.part").exists() and not os.path.exists(queue)
    said = []
    done = plan()
    assert done.counts() == "2 new files, 2 to quarantine, 2 left out, 1 unreadable"
    flows.triage_run(done, queue, str(tmp_path / "log"), "t", said.append, apply=True)
    assert said == ["2 new files, 2 in quarantine"] and (bin_ / "a (1).part").read_text() == "x" and (bin_ / "a.part").read_text() == "older" and (src / "brief.txt").exists()
    rows = {os.path.basename(r["quelle"]): r for r in spark.read.json(queue).collect()}
    assert set(rows) == {"brief.txt", "held.md"} and rows["held.md"]["klasse"] == "dublette" and rows["held.md"]["ziel_treffer"] == ["ziel/x"]
    assert rows["brief.txt"]["vorschlag_dateiname"] == "2024-02-01_RG_ABSENDER-PRUEFEN.txt" and rows["brief.txt"]["klasse"] == "inhalt"
    log = spark.read.csv(str(tmp_path / "log"), sep=";", header=True).collect()
    assert sorted(os.path.basename(r["alt"]) for r in log) == ["a.part", "b.part"] and {r["aktion"] for r in log} == {"quarantäne"}
    assert plan().queue.count() == 0


def test_redundancy_flow(spark, tmp_path):
    base = "a text that is long enough to be compared with another one, twice over and over"
    for name, text in {"a.txt": "same", "b.txt": "same", "n1.txt": base, "n2.txt": base + "!"}.items():
        (tmp_path / name).write_text(text)
    files = file_tree(spark, str(tmp_path))[0]
    files = files.join(file_texts(files).select("path", "text"), "path").select("path", "hash", "mtime", "text")
    found = flows.redundancy_flow(files, str(tmp_path / "bin"))
    assert found.report() == "1 redundant files, stable\n1 groups of near-duplicates are left" and sorted(os.listdir(tmp_path)) == ["a.txt", "b.txt", "n1.txt", "n2.txt"]
    gone = found.moves.first()
    taken = files.unionByName(spark.createDataFrame([(gone["target"], "other", None, "t")], "path string, hash string, mtime timestamp, text string"))
    assert flows.redundancy_flow(taken, str(tmp_path / "bin")).moves.first()["target"] == gone["target"].replace(".txt", "_1.txt")
    flows.redundancy_flow(files, str(tmp_path / "bin"), apply=True)
    assert not os.path.exists(gone["path"]) and open(gone["target"]).read() == "same" and os.path.exists(gone["keep"])


def test_repositories_are_fetched_until_the_limit(spark):
    import urllib.error

    from loomdoc.sources.readers import RateLimited

    def get(url, token=None):
        slug = "/".join(url.split("/repos/")[1].split("/")[:2])
        if slug == "o/gone":
            raise urllib.error.HTTPError(url, 404, "no", {}, None)
        if slug == "o/net":
            raise urllib.error.URLError("down")
        if slug == "o/limit":
            raise RateLimited(url)
        if "/releases" in url:
            return [{"published_at": "2024-01-02T03:04:05Z"}, {"published_at": None}], None
        if "/contributors" in url:
            return [], '<https://x/?per_page=1&page=7>; rel="last"'
        return {"stargazers_count": 2000, "pushed_at": "2024-02-03T04:05:06Z", "archived": False, "open_issues_count": 3}, None

    got, errors, ended = flows.repo_report(spark, ["o/a", "nothing", "o/gone", "o/net", "o/limit", "o/never"], F.lit("2024-06-01").cast("timestamp"), get=get)
    rows = got.collect()
    assert [(r["repo"], r["stars"], r["last_commit"], r["releases_last_year"], r["contributors_approx"], r["issues_per_1k_stars"]) for r in rows] == [("o/a", 2000, "2024-02-03T04:05:06Z", 1, 7, 1.5)]
    assert ended and [(r["repo"], r["error"].split(":")[0]) for r in errors.collect()] == [("o/gone", "HTTP 404"), ("o/net", "network"), ("o/limit", "rate limit")]


def test_golden_cases(spark, tmp_path):
    import json

    def cases(name, rows, schema):
        (tmp_path / name).write_text("\n\n".join(json.dumps(r) for r in rows) if name.endswith("l") else json.dumps(rows))
        return evaluation.load_cases(spark, str(tmp_path / name), schema)

    file = lambda n, t="": {"name": n, "inhalt": t}
    near = "Ein Entwurf über die Zusammenarbeit von zwei Seiten, die zwölf Monate dauert und sich verlängert"
    meta = cases("metadata.jsonl", [
        {"id": "good", "dateiname": "x.txt", "inhalt": "Rechnung vom 2026-07-15. Vertrag", "erwartetes_datum": "2026-07-15", "erwartetes_kuerzel": "RG", "erwartete_confidence": "high", "erwartet_garbled": False, "erwartet_alternativen": ["VTR"]},
        {"id": "bad", "dateiname": "x.txt", "inhalt": "Angebot", "erwartetes_datum": "2026-01-01", "erwartetes_kuerzel": "ANG", "erwartete_confidence": "low", "erwartet_garbled": False, "erwartet_alternativen": []},
        {"id": "torn", "dateiname": "x.txt", "inhalt": "ab cd " * 20, "erwartetes_datum": None, "erwartetes_kuerzel": None, "erwartete_confidence": "low", "erwartet_garbled": True, "erwartet_alternativen": []},
    ], evaluation.METADATA)
    red = cases("redaction.jsonl", [{"id": "r", "dateiname": "x", "inhalt": "an a.b@c.org, Mara", "darf_nicht_enthalten": ["a.b@c.org", "Mara"]}], evaluation.REDACTION)
    dup = cases("dedupe.json", [
        {"id": "d", "fixture": [file("v.txt", "same"), file("v-kopie.txt", "same"), file("o.txt", "other")], "erwartet_exakte_gruppen": 1, "erwartet_behalten": "v.txt"},
        {"id": "n", "fixture": [file("1.txt", near), file("2.txt", near + "t")], "erwartet_near_gruppen": 1, "erwartet_exakte_gruppen": 0},
        {"id": "h", "fixture": [file("a.txt", "same"), file("b.txt", "x")], "home": [file("z.txt", "same")], "erwartet_bereits_im_ziel": 1},
    ], evaluation.DEDUPE)
    tri = cases("triage.json", [{"id": "t", "fixture": [file(".DS_Store"), file("n.txt", "new"), file("k.txt", "known")], "home": [file("k2.txt", "known")], "erwartet_muell": 1, "erwartet_inhalt": 1, "erwartet_dublette": 2}], evaluation.TRIAGE)
    checks = evaluation.track(meta, red, dup, tri, state.document_types(spark))
    got = {r["metric"]: (r["hits"], r["total"]) for r in scoring.metric_rates(checks).collect()}
    assert got == {"datum_korrekt": (1, 2), "kuerzel_korrekt": (2, 2), "confidence_korrekt": (2, 2), "garbled_gefangen": (1, 1), "mehrdeutigkeit_gemeldet": (1, 1), "schwaerzung_leak_frei": (1, 2), "exakte_dup_precision": (3, 3), "near_dup_erkannt": (1, 1), "bereits_im_ziel_erkannt": (1, 1), "triage_klassifikation": (2, 3)}
    assert {r["detail"] for r in evaluation.failures(checks).collect()} == {"bad", "r: Mara", "t: duplicate"}
    answers = spark.createDataFrame([("a", "projects.", "Projects"), ("b", "Areas", "Projects"), ("c", "Whatever", "Whatever"), ("d", None, "Areas")], "id string, kategorie string, erwartete_kategorie string")
    assert [r["ok"] for r in evaluation.category_checks(answers).orderBy("detail").collect()] == [True, False, False, False]
    assert evaluation.load_cases(spark, str(tmp_path / "metadata.jsonl"), evaluation.METADATA).count() == 3


def test_plan_order():
    assert flows.in_order(flows.PLAN_ORDER) == [n for n, _ in flows.PLAN_ORDER] and flows.in_order([("b", ["a"]), ("a", []), ("c", [])]) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        flows.in_order([("a", ["b"]), ("b", ["a"])])


def test_images_without_libraries_give_warnings(spark, tmp_path):
    (tmp_path / "x.jpg").write_bytes(b"no image")
    from loomdoc.sources.readers import image_facts

    got = image_facts(spark.createDataFrame([(str(tmp_path / "x.jpg"),)], "path string"), ocr=True).first()
    assert got["warning"] and got["tags"] == [] and got["text"] is None


def test_hot_keys(spark):
    """Most files have one hash, one type, or none that could be read: the same answers, from tasks that share them."""
    rows = [(f"d/{i:04d}.txt", "hot" if i % 10 else f"h{i}", i % 7, 1) for i in range(1000)] + [(f"e/{i}.txt", None, 0, None) for i in range(100)]
    files = spark.createDataFrame(rows, "path string, hash string, mtime long, size long")
    kept = files.where("hash is not null")
    groups = dedupe.exact_groups(kept).collect()
    assert len(groups) == 900 and {(r["n_files"], r["keep"]) for r in groups} == {(900, "d/0007.txt")}
    assert dedupe.redundant_paths(kept).count() == 899
    none = spark.createDataFrame([], "hash string, path string")
    judged = intake.triage(files.select("path", "hash", "size"), none, none, none).groupBy("verdict").count().collect()
    assert {r["verdict"]: r["count"] for r in judged} == {"content": 101, "queue": 899, "unreadable": 100}
    got = {r["path"]: r["batch"] for r in filing.batches(kept.select("path", "size", "mtime")).collect()}
    want = [p for p, *_ in sorted(((p, m) for p, h, m, _ in rows if h), key=lambda x: (x[1], x[0]))]
    assert got == {p: i // 50 for i, p in enumerate(want)}


#: May be empty where the table is small.
SPARSE = {"near_duplicates", "near_duplicates_scaled", "redact_iban_any", "superseded_installers"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"near_duplicates"}))
def test_queries_have_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).limit(1).count() == 1 or name in SPARSE


def test_letters_are_dealt_out(spark, sf):
    """A file of orders that one task reads is work for all cores."""
    assert spark.read.parquet(f"{sf}/orders.parquet").rdd.getNumPartitions() == 1
    assert view(spark, sf, "letters_v").rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_images_are_read_once(spark):
    """A row in, a row out, without a join: also where two images have one id."""
    rows = [(1, "a/1.png", ".png", "Rechnung der Muster GmbH", "2024-03-05"), (1, "a/2.png", ".png", "Vertrag", None), (2, "a/reisepass.png", ".png", "Pass", None)]
    images = spark.createDataFrame(rows, "id long, path string, ext string, text string, exif_date string")
    got = sorted((r["id"], r["date"] or "", r["file_name"] or "", r["id_document"]) for r in metadata.analyze_images(images, state.document_types(spark)).collect())
    assert got == [(1, "", "", False), (1, "2024-03-05", "2024-03-05_RG_Rechnung-der-Muster-GmbH.png", False), (2, "", "", True)]


def test_queries_against_sql(spark, sf):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark", "labels", "conversations", "pages"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    norm = lambda row: tuple(round(x, 6) if isinstance(x, float) else x for x in row)
    for name in ("exact_duplicates", "redundant_copies", "newest_copy", "known_hashes", "already_in_target", "triage_classify", "manifest_record", "redact_cards", "target_names", "undo_plan", "letter_spacing", "document_types_found", "image_metadata", "batch_order", "depth_rule", "redundancy_moves", "redact_all", "metadata_pipeline", "repo_metrics", "rubric_recommended"):
        df = QUERIES[name](spark, sf)
        columns = ", ".join(f'"{c}"' for c in df.columns)
        want = [norm(r) for r in con.sql(f"select {columns} from ({ORACLE_SQL[name]})").fetchall()]
        assert sorted(map(norm, df.collect()), key=repr) == sorted(want, key=repr) and want, name
