"""The operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from loomdoc.llm import blocks, encoders
from loomdoc.llm.chat import format_chats, loss_text, read_chats, turns_text
from loomdoc.llm.components import components
from loomdoc.llm.context_tree import context_tree_scores
from loomdoc.llm.decontamination import contained_items, decontaminated
from loomdoc.llm.encoders import encoder
from loomdoc.llm.jaccard_join import Limits, jaccard_components, one_of_each
from loomdoc.llm.packing import pack_documents, refilled, shortest_pack_first
from loomdoc.llm.quality_rules import cascade, order_rules, quality_verdicts, rules, statistics
from loomdoc.llm.substring_dedup import FMIndex, substring_dedup
from loomdoc.llm.token_counts import spliced, token_counts
from loomdoc.llm.token_files import Shard, open_tokens, write_tokens
from loomdoc.llm.toxicity import LabelModel, Voters, fit_label_model, parents, toxicity_scores

SCHEMA = "doc_id long, text string, g int, b string, node long, row int, n int, score double, rank int, blob binary, tie long"


def long_text(seed=5, n=15_000):
    """A text of some 100 kB, with a toxic word at its end, and no other word twice in a window."""
    r = random.Random(seed)
    return " ".join(f"l{r.randrange(90_000)}" for _ in range(n)) + " idiot"


def low(text):
    return bytes(x + 32 if 65 <= x <= 90 else x for x in (text or "").encode())


def table(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 1, "x", 2, 3, 4, 0.5, 6, None, 7) for i, t in rows], SCHEMA)


def texts(seed=3, n=70):
    """Random texts over few words, copies, near copies, shared passages, and the odd cases."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["Äpfel", "naïve", "ab cd", "x y"]
    make = lambda k: [r.choice(words) for _ in range(k)]
    passage, base = make(30), make(120)
    out = [" ".join(make(r.randint(1, 150))) for _ in range(n)]
    out += [" ".join(make(20) + passage + make(r.randint(0, 20))) for _ in range(8)]
    for _ in range(12):
        near = list(base)
        for _ in range(r.randint(0, 4)):
            near[r.randrange(len(near))] = "edit" + str(r.randrange(999))
        out.append("\n".join([" ".join(near[:60]), " ".join(near[60:])]))
    out += [out[0]] * 3 + [" ".join(base)] * 4 + [out[0].upper()]
    for k in range(1, 24):  # small sets, to either side of the boundary
        short = make(k)
        out += [" ".join(short), " ".join([*short, "tail"]), " ".join([*short[:-1], "swap"])]
    out += ["", " ", "\t\n", None, "one", "one", "two words", "same " * 40, "same " * 55, "  lead and trail  ", "a\x0bb\x0cc\rd"]
    rows = list(enumerate(out)) + [(None, out[5]), (None, None), (None, "alone here"), (3, out[9]), (3, out[9])]
    return rows


@pytest.fixture(scope="module")
def rows():
    return texts()


def key(i):
    return (1, 0) if i is None else (0, i)


def test_word_arrays():
    given = ["a bc", None, "", " x\tyy \n z", "ä ö", "q" * 300_000 + " end"]
    w = blocks.Words(pa.array(given))
    assert w.count.tolist() == [2, 0, 0, 3, 2, 2]
    assert [w.data[s:e].tobytes() for s, e in zip(w.start, w.end)][2:5] == [b"x", b"yy", b"z"]
    h = w.hashes(slab=2)
    assert (h == w.hashes()).all() and len(set(h.tolist())) == len(h)
    assert blocks.Words(pa.array(["x yy x"])).hashes().tolist()[:2] == h[2:4].tolist()
    assert blocks.unpack(blocks.pack(h, w.count))[1].tolist() == w.count.tolist()


def test_fm_index_matches_naive_search():
    r = np.random.default_rng(1)
    text = np.concatenate([np.append(r.integers(1, 5, 40), 0) for _ in range(20)])
    index = FMIndex(text)
    starts = lambda p: sum((text[i : i + len(p)] == p).all() for i in range(len(text) - len(p) + 1))
    asked = r.integers(1, 6, 300)
    lo, hi, length = index.matching(np.where(asked > 4, 0, asked), np.arange(300), 8)
    for e in range(0, 300, 7):
        k = 0
        while k < 8 and k <= e and starts(asked[e - k : e + 1]):
            k += 1
        assert length[e] == k
        if k:
            assert hi[e] - lo[e] == starts(asked[e - k + 1 : e + 1])


@pytest.mark.parametrize(("size", "groups", "hot"), [(13, 32, 4096), (5, 2, 4096), (13, 3, 2), (5, 32, 1)])
def test_substring_dedup(spark, monkeypatch, size, groups, hot):
    monkeypatch.setattr("loomdoc.llm.substring_dedup.group_count", lambda _: groups)
    monkeypatch.setattr("loomdoc.llm.substring_dedup.HOT", hot)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = texts() + [(2000 + i, f"a{i} {passage} {passage if i % 3 else ''} b{i % 4}") for i in range(120)]  # one passage in many
    got = sorted(map(tuple, substring_dedup(table(spark, rows), size, with_text=True).collect()), key=repr)
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for j in range(len(w) - size + 1):
            first[tuple(w[j : j + size])] = min(first.get(tuple(w[j : j + size]), (9, 9)), key(i))
    want = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for j in range(len(w) - size + 1):
            if first[tuple(w[j : j + size])] < key(i):
                gone[j : j + size] = [True] * size
        kept = [x for x, d in zip(w, gone) if not d]
        want.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
        if sum(gone):
            text = next(x[4] for x in got if x[:4] == want[-1])
            assert text.encode().split() == kept
    assert [x[:4] for x in got] == sorted(want, key=repr) and sum(x[2] for x in want) > 100


def cluster():
    """90 near copies of one text, some at the edge of the limit, and as many texts that share a passage and no more."""
    r = random.Random(6)
    base, passage = [f"b{i}" for i in range(140)], [f"p{i}" for i in range(25)]
    out = []
    for _ in range(90):
        near = list(base)
        for _ in range(r.randint(0, 5)):
            near[r.randrange(140)] = f"e{r.randrange(9999)}"
        out.append(" ".join(near[: r.choice([140, 140, 139, 130])]))
    out += [" ".join([f"q{r.randrange(999)}" for _ in range(40)] + passage) for _ in range(90)]
    return list(enumerate(out))


@pytest.mark.parametrize(("size", "percent", "groups", "given"), [(3, 90, 32, texts), (5, 80, 2, texts), (3, 50, 2, texts), (3, 90, 1, cluster), (5, 80, 3, cluster)])
def test_jaccard_components(spark, monkeypatch, size, percent, groups, given):
    monkeypatch.setattr("loomdoc.llm.jaccard_join.group_count", lambda _: groups)
    rows = given()
    got = sorted(map(tuple, jaccard_components(table(spark, rows), size, percent, whole_prefix=groups == 3).collect()), key=repr)
    sets = []
    for _, t in rows:
        w = low(t).split()
        sets.append({tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))} if w else set())
    part = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = part[a], part[b]
            part = [x if p == y else p for p in part]
    want = []
    for k, (i, _) in enumerate(rows):
        least = min((key(rows[j][0]) for j in range(len(rows)) if part[j] == part[k]), default=key(i))
        want.append((i, len(sets[k]), None if least[0] else least[1]))
    assert got == sorted(want, key=repr)


def test_one_of_each_keeps_all_columns(spark, rows):
    docs = table(spark, rows)
    left = one_of_each(docs)
    assert left.columns == docs.columns
    ids = [r["doc_id"] for r in left.collect()]
    assert 0 in ids and len(ids) < len(rows)


def test_limits():
    x = Limits(90)
    assert x.light >= 15 and x.shared(9, 10) == 9 and list(x.partners(10)) == [9, 10, 11]


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 90)]
    part = {}
    find = lambda x: x if part.setdefault(x, x) == x else find(part[x])
    for a, b in edges:
        x, y = find(a), find(b)
        part[max(x, y)] = min(x, y)
    got = {n: c for n, c in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for a, b in edges if a != b for n in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("depth", [3, 6])
def test_context_tree(spark, depth):
    given = [(1, "Hello there"), (2, "the cat sat"), (3, ""), (4, None), (5, "thé CAT sat"), (6, "hello hello"), (None, "zzz"), (6, "hello hello")]
    got = collections.defaultdict(list)
    for r in context_tree_scores(table(spark, given), lambda i: i % 2 == 1, depth).collect():
        got[r["doc_id"]].append(r)
    lesson = [i is None or i % 2 == 1 for i, _ in given]

    def symbols(t):
        a = b"\xff" * depth + low(t) + b"\xff"
        return [(a[i - depth : i][::-1], a[i]) for i in range(depth, len(a))]

    count = collections.Counter()
    for (_, t), teach in zip(given, lesson):
        for c, y in symbols(t) if teach else ():
            for bit in range(8):
                for d in range(depth + 1):
                    count[c[:d], y >> (8 - bit), bit, (y >> (7 - bit)) & 1] += 1
    kids = collections.defaultdict(set)
    for c, p, bit, _ in count:
        if c:
            kids[c[:-1], p, bit].add((c, p, bit))
    count = collections.defaultdict(int, count)

    def weigh(node):
        a, b = count[(*node, 0)], count[(*node, 1)]
        pe = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        return (pe, pe) if len(node[0]) == depth else (pe, math.log(0.5) + np.logaddexp(pe, sum(weigh(k)[1] for k in kids[node])))

    tokens = [[*low(t).split(), "end"] for _, t in given]
    c = collections.Counter(w for ws, teach in zip(tokens, lesson) if teach for w in ws)
    n, v = sum(c.values()), len(c)
    for (i, t), teach, ws in zip(given, lesson, tokens):
        total = 0.0
        for context, y in symbols(t):
            for bit in range(8):
                # Pw with the bit after all training bits, over Pw without
                nodes = [(context[:d], y >> (8 - bit), bit) for d in range(depth + 1)]
                before = weigh(nodes[0])[1]
                for node in nodes:
                    count[(*node, (y >> (7 - bit)) & 1)] += 1
                kids.update({a: kids[a] | {b} for a, b in zip(nodes, nodes[1:])})
                total += (weigh(nodes[0])[1] - before) / math.log(10)
                for node in nodes:
                    count[(*node, (y >> (7 - bit)) & 1)] -= 1
        r = got[i][0]
        assert abs(r["score"] - total) < 1e-4
        assert r["n_tokens"] == len(ws) and r["train_tokens"] == n and r["held_out"] != teach
        assert r["n_known"] == sum(c[w] > 0 for w in ws)
        assert abs(r["base_score"] - sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) < 1e-9
    assert len(got[6]) == 2
    assert context_tree_scores(table(spark, []), lambda i: i > 0, depth).count() == 0


def test_toxicity(spark):
    r = random.Random(2)
    words = [f"wort{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(500)]
    bad = ["grimblaton", "grimblaten", "grimblatix", "vexor"]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        w = [r.choice(words) for _ in range(60)]
        for _ in range(3 if toxic else 0):
            w[r.randrange(60)] = r.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    odd = [(None, "grimblatung and vexor vexor"), (1000, None), (1001, ""), (1002, "you idiot scum"), (7, rows[7][1])]
    known = spark.createDataFrame([x for x in labels if x[0] % 3] + [(None, 1), (5, None), (10, 0)], "doc_id long, toxic int")
    got = toxicity_scores(table(spark, rows + odd), known, keep=("text", "rank")).collect()
    assert len(got) == len(rows) + len(odd) and got[0]["rank"] == 6
    held = {x["doc_id"]: x for x in got if x["doc_id"] is not None and x["doc_id"] < 400 and x["doc_id"] % 3 == 0}
    right = sum(held[i]["predicted"] == t for i, t in labels if i in held)
    assert right >= 0.97 * len(held) and all(0 <= x["score"] <= 1 for x in got)
    by = {x["text"]: x for x in got}
    assert by[None]["predicted"] == by[""]["predicted"] == 0 and by[None]["score"] == by[""]["score"] and by["you idiot scum"]["predicted"] == 1
    none = toxicity_scores(table(spark, odd), spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert {x["doc_id"]: x["predicted"] for x in none}[1002] == 1
    assert toxicity_scores(table(spark, []), known).count() == 0


def test_label_model_against_brute_force():
    """A round of expectation maximisation, row by row and voter by voter; and parents against all trees' weights."""
    r = np.random.default_rng(4)
    votes, n = r.integers(0, 2, (40, 4)).astype(float), r.integers(1, 5, 40).astype(float)
    model = LabelModel(0.3, np.array([-1, 0, 1, 0]), r.uniform(0.05, 0.95, (4, 2, 2)))
    model.rates[0, :, 1] = model.rates[0, :, 0]
    joint = np.zeros((40, 2))
    model.silent = 0.05
    for i, v in enumerate(votes):
        for y in (0, 1):
            joint[i, y] = (1 - 0.3, 0.3)[y]
            for k in range(4):
                rate = model.rates[k, y, int(v[model.parent[k]]) if model.parent[k] >= 0 else 0]
                joint[i, y] *= rate if v[k] else 1  # the silent abstain
        if not v.any():
            joint[i] = 0.95, 0.05
    p = joint / joint.sum(1, keepdims=True)
    assert np.allclose(model.posterior(votes), p[:, 1])
    new = model.maximised(model.expected(votes, n))
    for k, y, a in itertools.product(range(4), (0, 1), (0, 1)):
        w = n * p[:, y]
        own = ((w * votes[:, k]).sum() + 0.5) / (w.sum() + 1)
        of = votes[:, model.parent[k]] == a if model.parent[k] >= 0 else np.full(40, a == 0)
        assert np.isclose(new.rates[k, y, a], ((w * votes[:, k])[of].sum() + 2 * own) / (w[of].sum() + 2))
    # two voters that nearly always go together in both classes are tied, one that goes its own way is not
    a, b = r.random(4000) < 0.3, r.random(4000) < 0.4
    v = np.stack([a, b, np.where(r.random(4000) < 0.05, ~a, a)], 1).astype(float)
    half = np.arange(4000) % 2 == 0
    found = parents(np.stack([v[half].T @ v[half], v[~half].T @ v[~half]]), np.array([2000.0, 2000.0]))
    assert {frozenset((i, int(j))) for i, j in enumerate(found) if j >= 0} == {frozenset((0, 2))}


def test_label_model_learns_from_unlabelled_votes(spark):
    """A planted model whose voters abstain whatever the class, two of them copies: nearly as good as its true rates, from votes alone."""
    r = np.random.default_rng(9)
    toxic = r.random(6000) < 0.3
    right, votes = np.array([0.9, 0.85, 0.8, 0.9, 0.75]), []
    for x in right:
        spoken, truth = r.random(6000) < 0.6, r.random(6000) < x
        votes += [spoken & (truth == toxic), spoken & (truth != toxic)]  # for toxic, for clean
    votes.append(votes[0] ^ (r.random(6000) < 0.01))
    votes = np.stack(votes, 1)
    speaks = np.array([True, False] * 5 + [True])
    rates = np.array([[(0.6 * (1 - x), 0.6 * x), (0.6 * x, 0.6 * (1 - x))] for x in right]).reshape(10, 2)
    rates = np.concatenate([rates, rates[:1]])
    rough = np.clip(rates * np.where(rates > 0.3, 0.85, 1.5), 0.01, 0.9)
    rows = collections.Counter(x.tobytes() for x in np.packbits(votes, axis=1))
    model = fit_label_model(spark.createDataFrame(list(rows.items()), "votes binary, n long"), Voters(np.arange(11, dtype=np.uint64), speaks, rough), 0.3, rounds=15)
    odds = np.log(0.3 / 0.7) + votes[:, :10] @ np.log(rates[:10, 1] / rates[:10, 0])
    best = ((odds > 0) == toxic).mean()
    assert ((model.posterior(votes.astype(float)) > 0.5) == toxic).mean() > best - 0.02 > 0.85
    assert 10 in model.parent[:1] or model.parent[10] == 0


def test_decontamination(spark, rows):
    r = random.Random(8)
    long = [f"v{r.randrange(3000)}" for _ in range(6000)]
    docs = rows + [(500, " ".join(long)), (501, " ".join(long[:3000]).upper())]
    items = [(j, " ".join(long[j * 100 : j * 100 + k])) for j, k in enumerate((3, 5, 8, 30, 60, 90))] + [(6, " ".join(long[900:940] + ["zz"] * 6)), (7, " ".join(long[900:930] + ["zz"] * 30))]
    items += [(8, ""), (9, None), (None, "w1 w2"), (10, rows[0][1]), (10, "one"), (11, "two words")]
    got = sorted(tuple(x)[:4] for x in contained_items(table(spark, docs), spark.createDataFrame(items, "item_id long, text string"), block_bytes=300).collect() if x["doc_id"] is not None)
    want = []
    for i, t in docs:
        w = low(t).split()
        for j, s in items:
            x = low(s).split()
            k = min(5, len(x))
            if i is None or j is None or not k:
                continue
            mine, have = {tuple(x[a : a + k]) for a in range(len(x) - k + 1)}, {tuple(w[a : a + k]) for a in range(len(w) - k + 1)}
            if len(mine & have) >= 0.8 * len(mine) - 1e-9:
                want.append((i, j, len(mine & have), len(mine)))
    assert got == sorted(want) and len(want) > 10
    left = decontaminated(table(spark, docs), spark.createDataFrame(items[:8], "item_id long, text string"))
    assert left.columns == SCHEMA.replace(",", "").split()[::2] and 500 not in {x["doc_id"] for x in left.collect()}
    assert contained_items(table(spark, docs), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_shortest_pack_first():
    r = random.Random(4)
    histogram = collections.Counter(r.randint(1, 100) for _ in range(2000))
    packs = shortest_pack_first(dict(histogram), 100)
    placed = collections.Counter()
    for pattern, n in packs:
        assert sum(pattern) <= 100
        for x in pattern:
            placed[x] += n
    assert placed == histogram
    assert sum(100 - sum(p) for p, n in packs for _ in range(n)) < 0.03 * sum(k * v for k, v in histogram.items())


@pytest.mark.parametrize("histogram", [{600: 5000}, {600: 5000, 30: 10, 1000: 300}, {700: 401, 341: 777, 5: 20}, {1024: 7, 513: 1}, {520: 2, 100: 1}])
def test_holes_are_filled_by_cutting(histogram):
    packs = shortest_pack_first(dict(histogram), 1024)
    patterns, plans = refilled(packs, 1024)
    slots = collections.Counter()
    for pattern, n in patterns:
        assert sum(m for _, m in pattern) <= 1024 and n > 0
        for slot in pattern:
            slots[slot] += n
    for length, n in histogram.items():
        cut = plans.get(length, [])
        assert slots.pop((-length, length), 0) == n - sum(k for k, _ in cut)
        for k, parts in cut:
            assert sum(m for *_, m in parts) == length
            for key, first, m in parts:
                assert first + k <= sum(x for (a, _), x in slots.items() if a == key)
    parts = collections.Counter()
    for found in plans.values():
        for k, own in found:
            for key, _, m in own:
                parts[key, m] += k
    assert parts == slots  # each part has a slot of its own, and each slot a part
    total, n = sum(k * v for k, v in histogram.items()), sum(n for _, n in patterns)
    assert n <= sum(n for _, n in packs) and (total < 10_000 or 1024 * n < 1.05 * total)


def ids_of(text):
    return np.array([*T.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


T = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ODD = [(900, "x <|endoftext|> y"), (901, "a \nb\n c  d "), (902, "emoji 😀 ok"), (903, " lead"), (904, "word " * 3000)]


def test_packing_of_one_hot_length(spark):
    """Documents of 600 ids, one of them twice: no id is lost, each part has its own crc, and there is little padding."""
    word = next(w for w in (" the", " a") if len(ids_of(w)) == 2)
    docs = [(i, word * 590 + f" {i % 10}" * (9 - (len(str(i % 10)) > 1))) for i in range(60)] + [(3, word * 590 + " 3" * 9), (None, None)]
    got = pack_documents(table(spark, docs), "byte_bpe_50k.json").collect()
    whole, by = {i: ids_of(t) for i, t in docs}, collections.defaultdict(list)
    for x in got:
        assert x["ids_crc32"] == zlib.crc32(whole[x["doc_id"]][x["start"] : x["start"] + x["length"]].tobytes()) and x["doc_tokens"] == len(whole[x["doc_id"]])
        by[x["doc_id"]].append((x["start"], x["length"]))
    total = sum(len(ids_of(t)) for _, t in docs)
    assert sum(x["length"] for x in got) == total and len(by[3]) >= 2 and max(map(len, by.values())) > 1
    for i, found in by.items():
        covered = collections.Counter(j for a, n in found for j in range(a, a + n))
        assert set(covered) == set(range(len(whole[i]))) and set(covered.values()) == {2 if i == 3 else 1}
    sequences = collections.defaultdict(list)
    for x in got:
        sequences[x["sequence_id"]].append((x["offset"], x["length"]))
    for pieces in sequences.values():
        pieces.sort()
        assert [a for a, _ in pieces] == [0, *np.cumsum([n for _, n in pieces])[:-1]] and sum(n for _, n in pieces) <= 1024
    assert len(sequences) * 1024 < 1.06 * total


def test_packing(spark, rows):
    docs = rows + ODD
    got = pack_documents(table(spark, docs), "byte_bpe_50k.json", size=64, most_padding=1.0).collect()
    whole = collections.Counter((i, zlib.crc32(ids_of(t)[a : a + 64].tobytes()), a, len(ids_of(t))) for i, t in docs for a in range(0, len(ids_of(t)), 64))
    assert collections.Counter((x["doc_id"], x["ids_crc32"], x["start"], x["doc_tokens"]) for x in got) == whole
    sequences = collections.defaultdict(list)
    for x in got:
        sequences[x["sequence_id"]].append((x["offset"], x["length"]))
    for pieces in sequences.values():
        pieces.sort()
        assert [a for a, _ in pieces] == [0, *np.cumsum([n for _, n in pieces])[:-1]] and sum(n for _, n in pieces) <= 64
    assert pack_documents(table(spark, []), "byte_bpe_50k.json").count() == 0


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_token_counts(spark, rows, name):
    model = encoder(name)
    docs = rows + ODD + [(905, "x" * 900 + " y" * 200), (906, "ä" * 700), (907, "▁a ▁▁ b " * 90)]
    got = token_counts(table(spark, docs), name, limit=50, chunk=120, overlap=8).collect()
    want = collections.Counter((i, len((t or "").encode()), len(model.ids([t or ""])[0])) for i, t in docs)
    assert collections.Counter((x["doc_id"], x["n_bytes"], x["n_tokens"]) for x in got) == want
    assert all(x["over_limit"] == (x["n_tokens"] > 50) for x in got)
    for _, t in docs:
        if t and len(t) > 60:
            assert list(spliced(model, t, 60, 6)[0]) == list(model.ids([t])[0])
    if name != "word_bpe_49k.json":  # that one lower-cases and drops white space
        long = {i: x["n_splices"] for x in got if (i := x["doc_id"]) is not None and len(dict(docs)[i] or "") > 300 and i < 900}
        assert len(long) > 30 and all(long.values())
    if name.endswith(".model"):
        plain = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        assert all(list(plain.encode(t or "")) == list(model.ids([t or ""])[0]) for _, t in docs)


def test_long_documents_are_spliced():
    import duckdb

    model = encoder("piece_bpe_32k.model")
    found = duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet' where length(text) > 4096").fetchall()
    for (t,) in found:
        ids, n = spliced(model, t, 4096, 256)
        assert list(ids) == list(model.ids([t])[0]) and n >= len(t) // 4096 - 1 and (n > 0)
    assert len(found) > 100


def test_memoised_ids(rows):
    model = encoder("byte_bpe_50k.json")
    given = [t or "" for _, t in rows + ODD] + ["nb sp a", "a\r\nb c", "Ġ x ▁y Ġ Ġ", "don't we'll 123 45,6 --- a", "a\x1c b", "a \u00a0b", "end \n", "\n\n x\t y \r\n", " ", "  two", "tab\tq \t r", "é è\u2003z"]
    for _ in range(2):
        ids, first = model.flat(pa.array(given))
        assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == model.ids(given)
        ended, place = model.flat(pa.array([*given, None]), 7)
        assert [ended[a:b].tolist() for a, b in zip(place, place[1:])] == [[*x, 7] for x in [*model.ids(given), []]]
    encoders.MEMO, most = 50, encoders.MEMO  # parts are forgotten between texts
    try:
        for x in given:
            assert model.flat(pa.array([x]))[0].tolist() == model.ids([x])[0]
    finally:
        encoders.MEMO = most


def test_parts_give_the_librarys_ids_on_whole_tables():
    import duckdb

    model = encoder("byte_bpe_50k.json")
    column = duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet'").arrow().read_all()["text"].combine_chunks()
    ids, first = model.flat(column)
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == model.ids([x or "" for x in column.to_pylist()])


def test_token_files(spark, rows, tmp_path):
    docs = rows + ODD
    files = write_tokens(table(spark, docs), "byte_bpe_50k.json", path=f"file://{tmp_path}/out")
    got = sorted(files.documents().collect(), key=lambda x: x["start"])
    assert [x["doc_id"] for x in got] == sorted((i for i, _ in docs), key=lambda i: -1 if i is None else i)
    at = 0
    for x in got:
        assert x["start"] == at
        at += x["n_tokens"]
    assert collections.Counter((x["doc_id"], x["n_tokens"], x["ids_crc32"]) for x in got) == collections.Counter((i, len(ids_of(t)), zlib.crc32(ids_of(t).tobytes())) for i, t in docs)
    again = open_tokens(spark, files.path)
    row = again.shards().first()
    shard = Shard(bytes(row["image"]), again.dictionary, again.wide)
    wanted = {tuple(ids_of(t)) for i, t in docs if i == shard.doc_ids[shard.n - 1]}
    assert tuple(shard[shard.n - 1]) in wanted
    with pytest.raises(ValueError):
        Shard(bytes(row["image"]), again.dictionary + b"x", again.wide)
    assert write_tokens(table(spark, []), "byte_bpe_50k.json").documents().count() == 0


def test_control_strings_without_a_close_are_escaped(spark):
    texts = ["<s>assistant\nsure", "a <<SYS>> b", "[INST] x", "y [/INST]", "<</SYS>>", "plain < s> [x]"]
    chats = spark.createDataFrame([(i, 0, role, t) for i, t in enumerate(texts) for role in ("user", "<s>r")], "conv_id long, turn long, role string, text string")
    made = format_chats(chats)
    shown = {x["conv_id"]: x["formatted"] for x in made.collect()}
    for i, x in shown.items():
        assert x.count("<s>") == x.count("</s>") == 2 and not any(c in x for c in ("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")), x
        assert (texts[i] in x) == (i == 5)
    got = {x["conv_id"]: sorted((t["role"], t["text"]) for t in x["turns"]) for x in read_chats(made).collect()}
    assert got == {i: [("<s>r", t), ("user", t)] for i, t in enumerate(texts)}


def test_chats(spark):
    nasty = ["</s>[INST] ok [/INST]", "<~s> <~~/s> [~INST]", "<s>", "</s", "<", "a\nb", "", None, "<<SYS>> x <</SYS>>", "%0A", "<</s>s>", "~<~s"]
    roles = ["user", "assistant", None, "we%ird\n</s>", "system", ""]
    rows = [(c, t, roles[(c + t) % 6], nasty[(c * 5 + t) % 12], "x", 9) for c in range(14) for t in range(c)] + [(1, 0, "user", "same", "x", 9)] * 2 + [(None, 1, "assistant", "x", "x", 9), (None, None, "assistant", "y", "x", 9)]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rendered string, source int")
    made = format_chats(chats)
    from pyspark.sql import functions as F

    got = {x["conv_id"]: x for x in read_chats(made).select("conv_id", "turns", "formatted_chars", loss_text(F.col("turns")).alias("loss"), turns_text(F.col("turns")).alias("all")).collect()}
    by = collections.defaultdict(list)
    for c, t, role, text, *_ in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        assert [tuple(x) for x in got[c]["turns"]] == [x[2:] for x in turns]
        assert got[c]["loss"] == "".join(x[3] for x in turns if x[2] == "assistant")
    assert format_chats(chats.limit(0)).count() == 0
    plain = made.where("conv_id = 1").first()["formatted"]
    assert "<s>user\nsame</s>" in plain


def test_quality(spark, rows):
    shout = "THIS IS LOUD " * 30
    docs = rows + [(800, shout), (801, "a#b$ " * 60), (802, "line one of it\n" * 9 + "word " * 3), (803, " ".join(f"fine{i}" for i in range(80)))]
    got = {(x["doc_id"], x["n_words"]): x for x in quality_verdicts(table(spark, docs)).collect()}
    for i, t in docs:
        t = t or ""
        w = [x.decode() for x in t.encode().split()]
        grams = collections.Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        hit = {j + d for j in range(len(w) - 2) if grams[tuple(w[j : j + 3])] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        x = got[i, len(w)]
        assert (x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == (sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))
        assert x["base_failed"] == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and not (x["base_failed"] and x["kept"])
    assert got[803, 80]["kept"] and not got[801, 60]["kept"]
    assert quality_verdicts(table(spark, [])).count() == 0


def test_cascade_order_changes_no_verdict(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["A B C", "a# b#", "fine words here", "x!! y!!"])], "doc_id long, text string")
    held = statistics(docs)
    found = order_rules(docs, rules())
    assert sorted(x.name for x, _, _ in found) == sorted(x.name for x in rules())
    shares = [s / t for _, t, s in found]
    assert shares == sorted(shares, reverse=True)
    orders = [rules(), rules()[::-1], [x for x, _, _ in found]]
    assert len({tuple(r[0] for r in held.orderBy("doc_id").select(cascade(o)).collect()) for o in orders}) == 1


def test_very_long_texts(spark, monkeypatch):
    """Texts of 100 kB, one of them a copy, through the operators that cut their work into slabs of bytes."""
    monkeypatch.setattr("loomdoc.llm.context_tree.SLAB", 1000)
    monkeypatch.setattr("loomdoc.llm.toxicity.SLAB", 1000)
    one, two = long_text(), long_text(6)
    docs = table(spark, [(1, one), (2, one), (3, two), (4, one.replace("l1", "m1", 3)), (5, "short text"), (6, None)])
    cut = {x["doc_id"]: (x["n_words"], x["n_removed"]) for x in substring_dedup(docs, 13, with_text=False).collect()}
    assert cut[1] == (15001, 0) and cut[2] == (15001, 15001) and cut[3][1] == 0 and 14900 < cut[4][1] < 15001
    linked = {x["doc_id"]: x["component_id"] for x in jaccard_components(docs).collect()}
    assert linked == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5, 6: 6}
    scored = {x["doc_id"]: x for x in context_tree_scores(docs, lambda i: i != 3, 3).collect()}
    assert scored[1]["score"] == scored[2]["score"] and scored[1]["n_tokens"] == 15002 and 0 < scored[3]["bits_per_byte"] < 8
    toxic = {x["doc_id"]: x["predicted"] for x in toxicity_scores(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()}
    assert toxic == {1: 1, 2: 1, 3: 1, 4: 1, 5: 0, 6: 0}
    good = {x["doc_id"]: x for x in quality_verdicts(docs).collect()}
    assert good[1]["n_words"] == 15001 and good[1]["n_repeat_words"] == 0 and good[1]["kept"]
    chats = spark.createDataFrame([(1, 0, "user", one + "</s>"), (1, 1, "assistant", two)], "conv_id long, turn long, role string, text string")
    assert [t["text"] for t in read_chats(format_chats(chats)).first()["turns"]] == [one + "</s>", two]


def test_decontamination_keeps_null_ids_apart(spark):
    docs = table(spark, [(None, "a b c d e f g h"), (1, "a b c d e f g h"), (2, "no such words here at all")])
    items = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (8, None)], "item_id long, text string")
    assert sorted(map(tuple, contained_items(docs, items).select("doc_id", "item_id").collect()), key=repr) == [(1, 7), (None, 7)]
    assert [x["doc_id"] for x in decontaminated(docs, items).collect()] == [2]


def test_token_queries_against_the_library(spark, sf):
    """op6, op7 and op8 over a whole table, and op2's columns about words."""
    from loomdoc.llm.queries import QUERIES

    docs = sorted(map(tuple, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()))
    whole, at = {i: ids_of(t) for i, t in docs}, 0
    files = {x["doc_id"]: x for x in QUERIES["op8_token_files"](spark, sf).collect()}
    for i, _ in docs:
        assert (files[i]["start"], files[i]["n_tokens"], files[i]["ids_crc32"]) == (at, len(whole[i]), zlib.crc32(whole[i].tobytes()))
        at += len(whole[i])
    pieces, sequences = collections.defaultdict(list), collections.Counter()
    for x in QUERIES["op6_packing"](spark, sf).collect():
        assert x["ids_crc32"] == zlib.crc32(whole[x["doc_id"]][x["start"] : x["start"] + x["length"]].tobytes()) and x["doc_tokens"] == len(whole[x["doc_id"]])
        pieces[x["doc_id"]].append((x["start"], x["length"]))
        sequences[x["sequence_id"]] += x["length"]
    for i, _ in docs:
        ends = sorted(pieces[i])
        assert [a for a, _ in ends] == [0, *np.cumsum([n for _, n in ends])[:-1]] and sum(n for _, n in ends) == len(whole[i])
    assert max(sequences.values()) <= 1024 and sum(sequences.values()) == at
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    counted = {x["doc_id"]: (x["n_bytes"], x["n_tokens"], x["over_limit"]) for x in QUERIES["op7_token_counts"](spark, sf).collect()}
    for i, t in docs:
        n = len(model.encode(t or ""))
        assert counted[i] == (len((t or "").encode()), n, n > 4096)
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs}
    tokens = {i: [*low(t).split(), "end"] for i, t in docs}
    c = collections.Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for x in QUERIES["op2_lm_scoring"](spark, sf).collect():
        ws = tokens[x["doc_id"]]
        assert (x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"]) == (held[x["doc_id"]], len(ws), sum(c[w] > 0 for w in ws), n)
        assert abs(x["base_score"] - sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) < 1e-6 * len(ws) and x["score"] < 0
