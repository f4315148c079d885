"""Document types, and the metadata of texts from their redacted form. No output column has unredacted text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdoc.functions import text as T
from loomdoc.functions.names import is_id_document


def type_variants(types: DataFrame) -> DataFrame:
    """ord, code, variant_ord, variant of the types (ord, code, label): a few dozen rows."""
    return types.select("ord", "code", F.posexplode(T.variants(F.col("label"))).alias("variant_ord", "variant"))


def types_in(text: Column, types: DataFrame) -> Column:
    """The types (code, term, hits) whose term a text has as a whole word, the best first, as an array.

    Of a type its most frequent term counts, the first on ties; types go by hits, length of the term, order in the table. The table
    is a few dozen rows and becomes part of the expression: terms of one word are found in one scan, others each by itself.
    """
    table: dict[tuple[int, str], list[str]] = {}
    for r in sorted(type_variants(types).collect()):
        table.setdefault((r["ord"], r["code"]), []).append(r["variant"])
    words = sorted({v for vs in table.values() for v in vs if re.fullmatch(r"\w+", v)}, key=lambda v: (-len(v), v))
    whole = lambda v: rf"(?iU)(?<!\w)(?:{v})(?!\w)"
    none = F.array().cast("array<struct<code:string,term:string,hits:int>>")
    if not table:
        return none
    quoted = lambda v: rf"\Q{v}\E"

    def term(m: Column) -> Column:
        """The term that a match stands for: nearly always its lower case; the others (as with a long s) are told by the patterns."""
        other = F.coalesce(*[F.when(m.rlike(rf"(?iU)^{quoted(v)}$"), F.lit(v)) for v in words])
        return F.when(F.lower(m).isin(words), F.lower(m)).otherwise(other)

    def ranked(text: Column, found: Column) -> Column:
        hits = lambda v: F.size(F.filter(found, lambda m: m == v)) if v in words else F.regexp_count(text, F.lit(whole(quoted(v))))

        def best(place: int, code: str, variants: list[str]) -> Column:
            one = [F.struct(hits(v).cast("int").alias("hits"), F.lit(-i).alias("i"), F.lit(v).alias("term")) for i, v in enumerate(variants)]
            row = lambda x: F.struct((-x["hits"]).alias("hits"), (-F.char_length(x["term"])).alias("length"), F.lit(place).alias("ord"), F.lit(code).alias("code"), x["term"].alias("term"))
            return T.let(F.array_max(F.array(*one)), row)

        there = lambda variants: F.lit(True) if any(v not in words for v in variants) else F.arrays_overlap(found, F.array(*map(F.lit, variants)))
        some = F.filter(F.array(*[F.when(there(variants), best(*of, variants)) for of, variants in table.items()]), lambda x: x["hits"] < 0)
        return F.transform(F.array_sort(some), lambda x: F.struct(x["code"].alias("code"), x["term"].alias("term"), (-x["hits"]).alias("hits")))

    scan = lambda t: F.regexp_extract_all(t, F.lit(whole("|".join(map(quoted, words)))), F.lit(0)) if words else F.array().cast("array<string>")
    alone = any(v not in words for vs in table.values() for v in vs)
    return T.let(text, lambda t: T.let(F.transform(scan(t), term) if words else scan(t), lambda found: F.when((F.size(found) > 0) | F.lit(alone), ranked(t, found)).otherwise(none)))


def document_types_found(texts: DataFrame, types: DataFrame) -> DataFrame:
    """id, code, term, hits, place: a row for each type of a text, in order."""
    found = texts.select("id", F.posexplode(types_in(F.col("text"), types)).alias("pos", "t"))
    return found.select("id", "t.code", "t.term", "t.hits", (F.col("pos") + 1).alias("place"))


def best_types(texts: DataFrame, types: DataFrame) -> DataFrame:
    """id, code, term, alternatives (array of code, term, hits in order); only texts with a type."""
    found = texts.select("id", F.inline(F.array(F.struct(types_in(F.col("text"), types).alias("a"))))).where(F.size("a") > 0)
    return found.select("id", F.col("a")[0]["code"].alias("code"), F.col("a")[0]["term"].alias("term"), F.slice("a", F.lit(2), F.size("a")).alias("alternatives"))


def _held(df: DataFrame, *columns: Column) -> DataFrame:
    """df with columns, each worked out once a row: the optimizer doesn't copy expressions through a generator."""
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def analyze(texts: DataFrame, types: DataFrame, *more: str) -> DataFrame:
    """id, confidence, date, code, term, alternatives, sender, file_name, snippet, warning of texts (id, ext, text); more: columns kept.

    Empty and garbled texts stop with a warning and without a snippet; everything else is read from the redacted text, which is
    made once. A row in, a row out: no shuffle.
    """
    t = _held(texts.select("id", *{"ext": 0, **dict.fromkeys(more)}, F.col("text").alias("raw")), T.collapse_letter_spacing(F.col("raw")).alias("plain"))
    empty = F.coalesce(F.trim("plain"), F.lit("")) == ""
    stop = F.when(empty, F.lit("empty")).when(T.is_garbled(F.col("plain")), F.lit("garbled"))
    judged = _held(t.select("id", *{"ext": 0, **dict.fromkeys(more)}, "plain"), stop.alias("stop"))
    red = _held(judged, F.when(F.col("stop").isNull(), T.redact(F.col("plain"))).alias("text")).drop("plain")
    full = _held(red, T.find_date(F.col("text")).alias("date"), T.sender_hint(F.col("text")).alias("sender"), types_in(F.col("text"), types).alias("types"))
    full = full.withColumn("code", F.get("types", F.lit(0))["code"]).withColumn("term", F.get("types", F.lit(0))["term"]).withColumn("alternatives", F.when(F.size("types") > 0, F.slice("types", F.lit(2), F.size("types"))))
    high = F.col("date").isNotNull() & F.col("code").isNotNull()
    listed = F.array_join(F.transform("alternatives", lambda a: F.concat(a["code"], F.lit(" ("), a["term"], F.lit("×"), a["hits"].cast("string"), F.lit(")"))), ", ")
    return full.select(
        "id",
        F.when(high, F.lit("high")).otherwise(F.lit("low")).alias("confidence"),
        *more, "date", "code", "term", "alternatives", "sender",
        F.when(high, F.concat("date", F.lit("_"), "code", F.lit("_"), T.slug(F.col("sender")), "ext")).alias("file_name"),
        F.when(~high & F.col("stop").isNull(), T.snippet(F.col("text"))).alias("snippet"),
        F.when(F.col("stop").isNotNull(), F.col("stop")).when(high & (F.size("alternatives") > 0), F.concat(F.lit("ambiguous: "), listed)).alias("warning"),
    )


def analyze_images(images: DataFrame, types: DataFrame) -> DataFrame:
    """As analyze, for images (id, path, ext, text as read by OCR, exif_date), with id_document.

    ID documents are told by their name and taken out before anything is read. The date falls back on EXIF's, unless there is no
    text; the sender's place in the file name falls back on Screenshot.
    """
    guarded = images.withColumn("id_document", is_id_document(F.col("path")))
    plain = guarded.where(~F.col("id_document"))
    done = analyze(plain, types, "ext", "exif_date")
    date = F.coalesce("date", F.when(F.coalesce("warning", F.lit("")) != "empty", F.col("exif_date")))
    high = date.isNotNull() & F.col("code").isNotNull() & ~F.coalesce("warning", F.lit("")).isin("empty", "garbled")
    name = F.concat(date, F.lit("_"), "code", F.lit("_"), F.when(F.col("sender").isNotNull(), T.slug(F.col("sender"))).otherwise(F.lit("Screenshot")), "ext")
    read = done.select("id", F.lit(False).alias("id_document"), F.when(high, F.lit("high")).otherwise(F.lit("low")).alias("confidence"), date.alias("date"), "code", "sender", F.when(high, name).alias("file_name"), F.when(~high, F.col("snippet")).alias("snippet"), "warning")
    refused = guarded.where("id_document").select("id", F.lit(True).alias("id_document"), F.lit("low").alias("confidence"), *[F.lit(None).cast("string").alias(c) for c in ("date", "code", "sender", "file_name", "snippet")], F.lit("id document").alias("warning"))
    return read.unionByName(refused)


def exif_date(tags: Column) -> Column:
    """The first of an array of EXIF values that reads as Y:M:D, as YYYY-MM-DD."""
    dates = F.transform(tags, lambda t: F.regexp_replace(F.nullif(F.regexp_extract(t, r"^\s*(\d{4}:\d{2}:\d{2})", 1), F.lit("")), ":", "-"))
    return F.get(F.filter(dates, lambda d: d.isNotNull()), F.lit(0))
