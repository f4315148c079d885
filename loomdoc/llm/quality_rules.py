"""Quality rules as a short-circuit cascade, in SQL functions alone.

Method. Each rule rejects a text. On a sample of about sample_bytes of input each rule's cost (time over the sample) and
selectivity (share it rejects) are estimated; rules are then tried by rejection per cost, the best first, in one CASE
expression that stops at the first rejection. The order changes what a document costs, never its verdict.

Defined results. Words are runs of characters other than \\x20 and \\x09-\\x0D. A null text is empty: no words, so it fails the
base. Equality of words and of word windows is told by 64-bit hashes within a document. Repeated rows and null ids give a row
each. Other columns are left out. Empty tables give empty results.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdoc.session import plan_bytes

BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"


@dataclass(frozen=True)
class Rule:
    """rejects: true for a text that fails, over text, words and the columns of statistics()."""

    name: str
    rejects: Column


def _count_of(marks: str) -> Column:
    return F.char_length("text") - F.char_length(F.translate("text", marks, ""))


def _lines() -> Column:
    return F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def rules() -> list[Rule]:
    """Limits are shares of words, characters or lines."""
    n, chars = F.col("n_words"), F.col("word_chars")
    return [
        Rule("symbols", 10 * F.col("n_symbols") > n),
        Rule("exclamation", 2 * _count_of("!") > n),
        Rule("shouting", 10 * _count_of(UPPER) > 3 * F.char_length("text")),
        Rule("word_length", (chars < 2 * n) | (chars > 15 * n)),
        Rule("repeated_lines", 2 * F.col("n_dup_lines") > F.col("n_lines")),
        Rule("vocabulary", 100 * F.size(F.array_distinct("words")) < 15 * n),
    ]


def _held(df: DataFrame, *columns: Column) -> DataFrame:
    """df with columns, each worked out once a row: the optimizer doesn't copy expressions through a generator."""
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def _texts(docs: DataFrame) -> DataFrame:
    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    return _held(plain, F.filter(F.split("text", BLANK), lambda x: x != "").alias("words"))


def order_rules(docs: DataFrame, given: list[Rule], sample_bytes: int = 4 << 20) -> list[tuple[Rule, float, float]]:
    """(rule, seconds over the sample, share rejected), by rejection per cost. The sample is drawn before anything is worked out."""
    sample = statistics(docs.sample(min(1.0, sample_bytes / max(1, plan_bytes(docs))), seed=7)).persist()
    try:
        n = sample.count()
        found = []
        for rule in given:
            seconds = []
            for _ in range(2):
                began = time.perf_counter()
                hits = sample.agg(F.count_if(rule.rejects)).first()[0]
                seconds.append(time.perf_counter() - began)
            found.append((rule, min(seconds), hits / n if n else 0.0))
    finally:
        sample.unpersist()
    return sorted(found, key=lambda x: -x[2] / x[1])


def cascade(ordered: list[Rule]) -> Column:
    """True for texts that no rule rejects."""
    verdict = F.lit(True)
    for rule in reversed(ordered):
        verdict = F.when(rule.rejects, F.lit(False)).otherwise(verdict)
    return verdict


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, text, words, n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words of docs (doc_id, text)."""
    lines = _lines()
    hashed = _held(_texts(docs), F.transform("words", lambda x: F.xxhash64(x)).alias("h"), lines.alias("lines"))
    n = F.size("h")
    pairs = F.zip_with("h", F.slice("h", F.lit(2), n), lambda a, b: F.xxhash64(a, b))
    triples = F.zip_with(pairs, F.slice("h", F.lit(3), n), lambda a, b: F.xxhash64(a, b))
    none = F.array().cast("array<bigint>")
    grams = _held(hashed, F.when(n >= 3, F.slice(triples, F.lit(1), n - 2)).otherwise(none).alias("grams"))
    placed = F.array_sort(F.transform("grams", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    repeats = F.size(F.array_distinct("grams")) < F.size("grams")
    empty = F.array().cast("array<struct<x:bigint,i:int>>")
    sorted_ = _held(grams, F.when(repeats, placed).otherwise(empty).alias("placed"))
    following = F.slice("placed", F.lit(2), F.size("placed"))
    same = F.zip_with("placed", following, lambda a, b: F.coalesce(a["x"] == b["x"], F.lit(False)))
    compared = _held(sorted_, same.alias("same"))
    either = F.zip_with("same", F.concat(F.array(F.lit(False)), F.col("same")), lambda a, b: F.coalesce(a, F.lit(False)) | b)
    hits = _held(compared, F.filter(F.zip_with("placed", either, lambda p, e: F.when(e, p["i"])), lambda x: x.isNotNull()).alias("hits"))
    covered = F.concat("hits", F.transform("hits", lambda i: i + 1), F.transform("hits", lambda i: i + 2))
    return hits.select(
        "doc_id", "text", "words",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _count_of(SYMBOLS).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct(covered)).cast("long").alias("n_repeat_words"),
    )


def quality_verdicts(docs: DataFrame, given: list[Rule] | None = None, sample_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of docs (doc_id, text).

    base_failed: fewer than 50 words, or more than half of them in repeated 3-word windows. kept: neither that, nor a rule rejects.
    """
    ordered = [rule for rule, _, _ in order_rules(docs, given if given is not None else rules(), sample_bytes)]
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return statistics(docs).withColumn("base_failed", failed).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(ordered)).alias("kept"),
    )
