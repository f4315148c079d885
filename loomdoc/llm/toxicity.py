"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier on its posteriors.

Method. Voters are lexicon entries (whole words) and patterns (a word that begins with a stem of 4 to 8 bytes); each fires on a
document or stays silent. SEEDS always take part; the others are chosen from labelled rows: entries that several toxic rows
have and that speak for a class, toxic (least_support rows) or clean, by the cautious end of what their precision may be; of those
the most_voters with the most cases. Every document's votes are written as bits and added up by pattern.

The generative model has two classes. Each voter fires with a rate of its own in either class, which also depends on whether its
parent voter fires: that is how correlations enter, as parameters. A silent voter abstains and says nothing of the class. Parents are a maximum spanning forest of the voters' mutual
information given the class, from the pair counts of all documents. Rates are fitted by expectation maximisation over the votes of
all documents, labelled or not; labels give the voters, the class each speaks for, the class share and where the fit begins, no more. A ridge logistic
regression on votes, hits and density is then trained on the model's posteriors of the labelled texts, and scores every document.

Bounds. Labels come from the rows that the caller passes, at most sample_rows of them (those with the least hash of their id).
most_voters is the size of the model; the entries it is chosen from are counted without a limit. Votes are counted over all words of
every text, and patterns over all documents. Each step of the fit sends one row a voter to the driver, the search for parents one row
a pair of voters that fire together, however many documents there are.

Defined results. A-Z is lower-cased; words are runs of ASCII letters and non-ASCII bytes. A null text is empty and gets the score
of a text without votes. A doc_id that is labelled twice is toxic if one label says so; labels with a null id or toxic are left
out. Repeated rows and null ids give a row each. Without labels SEEDS alone vote. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdoc.llm.blocks import Words, lean, slabs_of
from loomdoc.session import file_count, written

#: Insults that vote without having been learned.
SEEDS = ("idiot", "moron", "stupid", "scum", "loser", "pathetic", "worthless", "disgusting", "imbecile", "dumbass", "asshole", "bastard", "retard", "filthy")
STEMS = range(4, 9)
SLAB = 4 << 20  # bytes of text whose votes are worked out at once
ROWS = 4096  # votes that are held as numbers at once
PARTS = ("total", "fires", "above", "both", "spoken")
DRAW = 2.0  # cases that draw a rate towards the voter's own
_WORD, _STEM = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def _features(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, entry) for each word and each of its stems, kind by kind."""
    length = words.end - words.start
    yield words.doc, words.hashes() ^ _WORD
    for n in STEMS:
        of = length >= n
        yield words.doc[of], words.hashes(prefix=n)[of] * _STEM


def _seed_entries() -> np.ndarray:
    return Words(pa.array([" ".join(SEEDS)]), lower=True, letters=True).hashes() ^ _WORD


def _counts(frames: Iterator[pa.RecordBatch], among: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Documents that hold each entry, for a batch of texts."""
    for frame in frames:
        for a, b in slabs_of(frame.column(0), SLAB):
            words = Words(frame.column(0)[a:b], lower=True, letters=True)
            for row, entry in _features(words):
                if among is not None:
                    of = np.isin(entry, among)
                    row, entry = row[of], entry[of]
                pairs = np.unique(np.stack([entry, row.astype(np.uint64)], 1), axis=0)
                entry, n = np.unique(pairs[:, 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(entry.view(np.int64)), pa.array(n, pa.int64())], ["entry", "n"])


@dataclass
class Voters:
    """entries: sorted hashes; toxic: the class each speaks for; fires: its rate in labelled rows, clean and toxic."""

    entries: np.ndarray
    toxic: np.ndarray
    fires: np.ndarray

    def hits(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each voter in each text, and the texts' word counts."""
        words = Words(column, lower=True, letters=True)
        out = np.zeros((len(words), len(self.entries)), np.int32)
        for row, entry in _features(words):
            at = np.minimum(np.searchsorted(self.entries, entry), len(self.entries) - 1)
            of = self.entries[at] == entry
            np.add.at(out, (row[of], at[of]), 1)
        return out, words.count


@dataclass
class LabelModel:
    """share: of the toxic class; silent: of it among rows where no voter fires. parent: of each voter, -1 for none.
    rates[voter, class, whether the parent fires]: of firing. prior: log odds of the toxic class before any vote, None: those of share."""

    share: float
    parent: np.ndarray
    rates: np.ndarray
    silent: float = 0.02
    prior: float | None = None

    def before(self) -> float:
        return float(np.log(self.share / (1 - self.share))) if self.prior is None else self.prior

    def above(self, votes: np.ndarray) -> np.ndarray:
        """Whether each voter's parent fires."""
        return np.where(self.parent >= 0, votes[:, self.parent], 0)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """The probability of the toxic class for rows of 0 and 1. A silent voter abstains: only those that fire speak."""
        fires = np.log(self.rates[:, 1]) - np.log(self.rates[:, 0])
        z = votes @ fires[:, 0] + (votes * self.above(votes)) @ (fires[:, 1] - fires[:, 0])
        p = 1 / (1 + np.exp(-np.clip(z + self.before(), -40, 40)))
        return np.where(votes.any(1), p, self.silent)

    def expected(self, votes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """[class, voter]: weight of all rows, of those where the voter fires, its parent does, both do, and any voter does; n rows of each kind."""
        p, held = self.posterior(votes), self.above(votes)
        return np.stack([np.stack([np.full(votes.shape[1], w.sum()), w @ votes, w @ held, w @ (votes * held), np.full(votes.shape[1], w[votes.any(1)].sum())], 1) for w in (n * (1 - p), n * p)])

    def maximised(self, expected: np.ndarray) -> LabelModel:
        """The rates that make these weights likeliest, drawn a little towards the voter's rate whatever its parent does; and the share
        of silent rows that makes up the share of all, or, where none can, a prior nearer to it."""
        total, fires, above, both, any_ = np.moveaxis(expected, 2, 0)  # [class, voter] each
        rate = (fires + 0.5) / (total + 1)
        of = [((fires - both) + DRAW * rate) / ((total - above) + DRAW), (both + DRAW * rate) / (above + DRAW)]
        rows, spoken = total[:, 0].sum(), any_[:, 0]
        silent = float(np.clip((self.share * rows - spoken[1]) / max(1.0, rows - spoken.sum()), 0.001, self.share / 2))
        rates = np.clip(np.moveaxis(np.stack(of, 2), 0, 1), 1e-5, 1 - 1e-5)
        held = float(np.clip((spoken[1] + silent * (rows - spoken.sum())) / max(1.0, rows), 1e-6, 1 - 1e-6))
        return LabelModel(self.share, self.parent, rates, silent, self.before() + float(np.log(self.share / (1 - self.share)) - np.log(held / (1 - held))))

    def better_than_chance(self, toxic: np.ndarray) -> LabelModel:
        """Voters that would speak for the other class say nothing instead, so that the classes can't change places."""
        wrong = (self.rates[:, 1] < self.rates[:, 0]) == toxic[:, None]
        rates = np.where(wrong[:, None], self.rates.mean(1, keepdims=True), self.rates)
        return LabelModel(self.share, self.parent, rates, self.silent, self.prior)


def parents(pairs: np.ndarray, total: np.ndarray, least: float = 10.0) -> np.ndarray:
    """A parent for each voter, or -1: the maximum spanning forest of mutual information given the class, over voters that fire
    together more often than the classes explain; voters that shut each other out are abstentions of each other.

    pairs[class]: weight of rows where both of two voters fire, on the diagonal where one does; total[class]: of all rows. Only
    pairs with a likelihood ratio statistic over least are joined.
    """
    k = pairs.shape[1]
    gain = np.zeros((k, k))
    for both, n in zip(pairs, total, strict=True):
        one = np.diag(both)
        for x, a, b in ((both, one[:, None], one[None, :]), (one[:, None] - both, one[:, None], n - one[None, :]), (one[None, :] - both, n - one[:, None], one[None, :]), (n - one[:, None] - one[None, :] + both, n - one[:, None], n - one[None, :])):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain += np.where(x > 1e-9, 2 * x * np.log(x * n / (a * b)), 0)
    one = np.diagonal(pairs, axis1=1, axis2=2)
    gain[pairs.sum(0) <= (one[:, :, None] * one[:, None, :] / np.maximum(total, 1e-9)[:, None, None]).sum(0)] = 0
    out, best, to = np.full(k, -1), np.full(k, -np.inf), np.full(k, -1)
    left = np.ones(k, bool)
    for _ in range(k):  # from the part so far, the voter with the strongest tie; else another root
        j = int(np.argmax(np.where(left, best, -np.inf))) if np.isfinite(best[left]).any() else int(np.flatnonzero(left)[0])
        left[j] = False
        out[j] = to[j] if best[j] > least else -1
        nearer = left & (gain[j] > best)
        best[nearer], to[nearer] = gain[j][nearer], j
    return out


def _bits(votes: pa.Array, k: int) -> np.ndarray:
    """Rows of 0 and 1 from packed votes."""
    return np.unpackbits(np.frombuffer(b"".join(votes.to_pylist()), np.uint8).reshape(len(votes), (k + 7) // 8), axis=1, count=k).astype(float)


def fit_label_model(patterns: DataFrame, voters: Voters, share: float, rounds: int = 12) -> LabelModel:
    """patterns: votes (packed), n. Each round is one pass over them; it ends early where no rate moves any more."""
    k = len(voters.entries)
    model = LabelModel(share, np.full(k, -1), np.repeat(np.clip(voters.fires, 1e-5, 1 - 1e-5)[:, :, None], 2, axis=2), share / 4)

    def over(step: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, ...]], schema: str) -> DataFrame:
        def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for frame in frames:
                for a in range(0, len(frame), ROWS):
                    part = frame.slice(a, ROWS)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in step(_bits(part.column(0), k), part.column(1).to_numpy(zero_copy_only=False).astype(float))], [x.split()[0] for x in schema.split(", ")])

        return patterns.mapInArrow(work, schema)

    def pair_step(votes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        p = model.posterior(votes)
        clean, toxic = ((votes * w[:, None]).T @ votes for w in (n * (1 - p), n * p))
        i, j = np.nonzero(np.triu(clean + toxic))
        return np.append(i, -1), np.append(j, -1), np.append(clean[i, j], (n * (1 - p)).sum()), np.append(toxic[i, j], (n * p).sum())

    def rate_step(votes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        e = model.expected(votes, n)
        return (np.arange(k), *e[0].T, *e[1].T)

    pairs, total = np.zeros((2, k, k)), np.zeros(2)
    for r in over(pair_step, "i long, j long, clean double, toxic double").groupBy("i", "j").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).collect():
        for y, x in ((0, r["clean"]), (1, r["toxic"])):
            if r["i"] < 0:
                total[y] = x
            else:
                pairs[y, r["i"], r["j"]] = pairs[y, r["j"], r["i"]] = x
    if not total.any():
        return model
    model.parent = parents(pairs, total)
    names = [f"{x}{y}" for y in "01" for x in PARTS]
    for _ in range(rounds):
        rows = over(rate_step, "k long, " + ", ".join(f"{x} double" for x in names)).groupBy("k").agg(*[F.sum(x).alias(x) for x in names]).toArrow().sort_by("k")
        new = model.maximised(np.stack([np.stack([rows[f"{x}{y}"].to_numpy() for x in PARTS], 1) for y in "01"]))
        new = new.better_than_chance(voters.toxic)
        moved = np.abs(np.log(new.rates) - np.log(model.rates)).max()
        model = new
        if moved < 0.02:
            break
    return model


def _design(votes: np.ndarray, hits: np.ndarray, n_words: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Features of the classifier: whether any toxic voter fires, each voter's vote, hits (of the toxic voter with most), hits a word, and 1.

    The first speaks for voters that never fired on the sample, such as seeds in another corpus.
    """
    return np.column_stack([votes[:, toxic].any(1), votes, np.log1p(hits), np.minimum(1, 20 * hits / np.maximum(n_words, 1)), np.ones(len(votes))]).astype(float)


def fit_logistic(x: np.ndarray, target: np.ndarray, ridge: float = 3.0, rounds: int = 25) -> np.ndarray:
    """Ridge logistic regression on soft targets by Newton's method; the first weight and the last are all but free."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[[0, -1]] = 0.01, 1e-4
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - target) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Classifier:
    voters: Voters
    weights: np.ndarray

    def score(self, votes: np.ndarray, hits: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_design(votes, hits, n_words, self.voters.toxic) @ self.weights, -30, 30)))


def labelled_texts(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """text, toxic of at most sample_rows labelled ids; copies of a text count once."""
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # at most sample_rows pairs of numbers
    known = docs.sparkSession.createDataFrame([tuple(r) for r in known.collect()], "known_id long, toxic int")
    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    rows = plain.join(F.broadcast(known), plain["doc_id"] == known["known_id"]).groupBy(F.xxhash64("text"), F.length("text")).agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))
    return written(rows.select("text", "toxic"), "labelled", files=file_count(docs))


def choose_voters(rows: DataFrame, n_toxic: int, n_clean: int, least_support: int, least_precision: float, most_voters: int) -> Voters:
    """Voters for either class from labelled texts (text, toxic), by counts of the rows of each class that hold an entry."""
    count = lambda of, among: of.select("text").mapInArrow(lean(lambda f: _counts(f, among)), "entry long, n long").groupBy("entry").agg(F.sum("n").alias("n"))
    found = count(rows.where("toxic = 1"), None).where("n > 1").toArrow().sort_by("entry")  # of the sample's toxic texts
    entry, n = found["entry"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(entry)
    entry, n, m = entry[order], n[order], np.zeros(len(order), np.int64)
    if len(entry):
        clean = count(rows.where("toxic = 0"), entry).toArrow()
        m[np.searchsorted(entry, clean["entry"].to_numpy().view(np.uint64))] = clean["n"].to_numpy()
    # precision for the toxic class, and how far it may be off, so that few cases that happen to be right don't make a voter
    share, precision = n_toxic / max(1, n_toxic + n_clean), (n + 0.5) / (n + m + 1)
    off = np.sqrt((n + 0.5) * (m + 0.5) / (n + m + 1.0) ** 3)
    toxic = np.flatnonzero((n >= least_support) & (precision - off >= least_precision))
    clean = np.flatnonzero(precision + 2 * off <= share / 2)
    most = most_voters // 8  # of the clean class, whose words say less
    pick = np.concatenate([toxic[np.lexsort((entry[toxic], -n[toxic] * precision[toxic]))][: most_voters - most], clean[np.lexsort((entry[clean], -m[clean]))][:most]])
    chosen = {int(entry[i]): (bool(i in set(toxic.tolist())), (m[i] + 0.5) / (n_clean + 1), (n[i] + 0.5) / (n_toxic + 1)) for i in pick.tolist()}
    for e in _seed_entries():
        chosen.setdefault(int(e), (True, 0.0005, 0.02))
    keys = np.array(sorted(chosen), np.uint64)
    return Voters(keys, np.array([chosen[int(e)][0] for e in keys]), np.array([chosen[int(e)][1:] for e in keys]))


VOTED = ("votes", "hits", "n_words")


def _voted(voters: Voters, plain: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of keep, votes (a bit for each voter), hits (of the toxic voter with most), n_words of each text."""
    kinds = {f.name: f.dataType.simpleString() for f in plain.schema}

    def vote(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for a, b in slabs_of(frame.column("text"), SLAB):
                hits, n_words = voters.hits(frame.column("text")[a:b])
                packed = [x.tobytes() for x in np.packbits(hits > 0, axis=1)]
                yield pa.RecordBatch.from_arrays([*[frame.column(c)[a:b] for c in keep], pa.array(packed, pa.binary()), pa.array(hits[:, voters.toxic].max(1, initial=0).astype(np.int64)), pa.array(n_words, pa.int64())], [*keep, *VOTED])

    return plain.mapInArrow(lean(vote), ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "votes binary, hits long, n_words long"]))


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, keep: tuple[str, ...] = (), sample_rows: int = 30_000, least_support: int = 6, least_precision: float = 0.85, most_voters: int = 256) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= threshold, else 0), and the columns of keep, for docs (doc_id, text).

    labels: doc_id, toxic. Texts are read once for their votes, which the fit and the scores then take.
    """
    rows = labelled_texts(docs, labels, sample_rows)
    n_all, n_toxic = rows.agg(F.count("*"), F.count_if(F.col("toxic") == 1)).first()
    share = min(0.5, max(0.01, n_toxic / n_all)) if n_all else 0.1
    voters = choose_voters(rows, n_toxic, n_all - n_toxic, least_support, least_precision, most_voters)
    k = len(voters.entries)
    named = {c: f"__{i}" for i, c in enumerate(keep)}  # so that no column of keep clashes with votes, hits or n_words
    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), *[docs[c].alias(x) for c, x in named.items()])
    files = file_count(docs)
    voted = written(_voted(voters, plain, ["doc_id", *named.values()]), "votes", files=files)
    patterns = written(voted.groupBy("votes").agg(F.count("*").alias("n")), "patterns", files=files)
    model = fit_label_model(patterns, voters, share)
    # at most sample_rows rows of a bit for each voter
    table = _voted(voters, rows, []).toArrow().sort_by([(c, "ascending") for c in VOTED]).combine_chunks()
    if len(table):
        votes = _bits(table["votes"].combine_chunks(), k)
        weights = fit_logistic(_design(votes, table["hits"].to_numpy(), table["n_words"].to_numpy(), voters.toxic), model.posterior(votes))
    else:  # nothing to learn from: any seed makes a text likelier toxic than not
        weights = np.concatenate([[4.0], np.zeros(k), [1.0, 0.0, -3.0]])
    classifier = docs.sparkSession.sparkContext.broadcast(Classifier(voters, weights))  # at most most_voters + len(SEEDS) voters

    def score(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for a in range(0, len(frame), ROWS):
                part = frame.slice(a, ROWS)
                s = classifier.value.score(_bits(part.column("votes"), k), *[part.column(c).to_numpy(zero_copy_only=False) for c in VOTED[1:]])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32)), *[part.column(x) for x in named.values()]], ["doc_id", "score", "predicted", *keep])

    kinds = {f.name: f.dataType.simpleString() for f in plain.schema}
    return voted.mapInArrow(score, ", ".join(["doc_id long, score double, predicted int", *[f"`{c}` {kinds[x]}" for c, x in named.items()]]))


def may_teach(doc_id: Column) -> Column:
    """Rows whose labels may be learned from: crc32 of the id as text, modulo 3, isn't 1."""
    from loomdoc.llm.blocks import crc_of_id

    return crc_of_id(doc_id) % 3 != 1
