"""The pipeline's stages against brute force, each on its own input."""

import itertools
import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(6)
    words = [f"{a}{b}" for a in ("ba", "ke", "li", "mo", "nu", "ra", "so", "ti") for b in ("den", "fel", "gor", "han", "jup", "kas", "lem", "mir", "nos", "pat")]
    make = lambda k: [r.choice(words) + str(r.randrange(9)) for _ in range(k)]
    passage, item = make(70), make(30)
    rows = []
    for i in range(120):
        w = make(r.randint(60, 160))
        if i % 10 == 1:
            w[5:5] = ["idiot", "scum", "moron"]
        if i % 17 == 2:
            w[10:10] = passage
        if i % 23 == 3:
            w[20:20] = item
        rows.append((i, " ".join(w), "en", "s", len(" ".join(w))))
    base = rows[4][1].split()
    for k in range(200, 206):
        near = list(base)
        near[k % len(near)] = "changed"
        rows.append((k, " ".join(near), "en", "s", 1))
    rows += [(300, None, "en", "s", None), (301, "", "en", "s", 0), (None, "no id at all", None, None, None)]
    out = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 10 == 1)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(0, " ".join(item))], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = stage(spark, docs, folder)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen[name] = docs
        if name == "packing":
            break
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "toxicity":
            assert set(before) - set(after) == {i for i in range(120) if i % 10 == 1}
        if name == "jaccard_join":
            sets = {i: {tuple((t or "").split()[j : j + 5]) for j in range(len((t or "").split()) - 4)} for i, t in before.items()}
            gone = {max(a, b) for a, b in itertools.combinations([i for i in sets if i is not None], 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0}
            assert set(before) - set(after) == gone and 4 in after and gone
        if name == "substring_dedup":
            cut = [i for i in after if after[i] != before[i]]
            assert cut and all(i % 17 == 2 for i in cut) and 2 not in cut
        if name == "decontamination":
            assert set(before) - set(after) == {i for i in before if i is not None and i < 120 and i % 23 == 3}
    assert {r["doc_id"] for r in seen["packing"].collect()} == {r["doc_id"] for r in seen["decontamination"].collect()}


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 50


def test_run_on_odd_tables(spark, tmp_path):
    """Empty tables; columns whose names the operators use; repeated rows and ids."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, g int, node long, votes binary, salt long, kind int"
    labels, items = "doc_id long, quality int, toxic int", "item_id long, text string"
    words = [f"w{i}" for i in range(90)]
    rows = [(1, " ".join(words), "en", "s", 1), (1, " ".join(words), "en", "s", 1), (1, "another text of the same id", "en", "s", 2), (2, " ".join(words[::-1]), None, None, None), (None, None, None, None, None)]
    for name, given in (("none", []), ("odd", [(*r, 1, 2, b"x", 3, 4) for r in rows])):
        folder = str(tmp_path / name)
        spark.createDataFrame(given, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], labels).write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([], items).write.parquet(f"{folder}/benchmark.parquet")
        got = [x["doc_id"] for x in corpus_pipeline.run(spark, folder).collect()]
        assert sorted(got, key=repr) == ([] if name == "none" else [1, 1, 1, 2, None])


def test_files_follow_the_table(spark, folder, monkeypatch):
    """However many shuffle partitions there are, a small table is written to few files: each costs a process on some file systems."""
    from collections import Counter
    from pathlib import Path

    from loomdoc import session

    paths, fresh = [], session.new_folder
    monkeypatch.setattr(session, "new_folder", lambda *a: paths.append(fresh(*a)) or paths[-1])
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        assert corpus_pipeline.run(spark, folder).count() > 50
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    files = Counter(x.parent for path in paths for x in Path(path.removeprefix("file:")).rglob("part-*.parquet"))
    assert len(files) > 12 and max(files.values()) <= 8, files


def test_workers_give_memory_back():
    """A worker is kept for later stages: what a batch's work has freed isn't held on until then."""
    from pathlib import Path

    from loomdoc.llm.blocks import lean

    held = lambda: int(Path("/proc/self/status").read_text().split("RssAnon:")[1].split()[0]) // 1024
    pins, seen = [], []

    def work(frames):
        for frame in frames:
            parts = [b"x" * 50_000 for _ in range(4000)]  # 200 MB in pieces, with one that stays
            pins.append(b"x" * 50_000)
            yield frame
            del parts

    before = held()
    for _ in lean(work)(iter([1, 2])):
        seen.append(held() - before)
    assert max(seen) > 150 and held() - before < 50
