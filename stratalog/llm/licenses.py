"""License scans by diagonal voting, in DataFrame functions only.

Hashes of all word 2-grams of the documents join the positions of license phrases and notices.
A match votes for its diagonal (place in the document less place in the template). Votes
are the bits of a mask, so counting is a bit_or that neither repeated rows nor hot documents
make larger. Neighbouring diagonals are merged, which bridges inserted or missing words, and
a span counts by the share of its template's 2-grams that it covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

# The phrases whose every place counts, and their labels.
PHRASES = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]
# Openings of public license notices, lower case, words only.
NOTICES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this work is licensed under the gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "mozilla public license version 2 0"),
    ("cc-by-nc", "cc by nc"),
    ("cc-by-nd", "cc by nd"),
    ("cc-by-sa", "cc by sa"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = "".join(chr(c) for c in [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: Diagonals up to this far apart are one span; a notice is found from this share of its 2-grams on.
NEAR, COVER = 3, 0.75


def templates() -> list[tuple[int, str, bool, int, int, str, str]]:
    """(template, label, phrase?, 2-grams, place, word, next word) of every 2-gram; a fixed, small table."""
    rows = []
    for t, (label, text, base) in enumerate([(a, b, True) for a, b in PHRASES] + [(a, b, False) for a, b in NOTICES]):
        w = text.split()
        if not 2 <= len(w) <= 64:
            raise ValueError("a template has 1 to 63 2-grams, as its votes are the bits of a long")
        rows += [(t, label, base, len(w) - 1, i, w[i], w[i + 1]) for i in range(len(w) - 1)]
    return rows


def words(text: Column) -> Column:
    """Translating separators to spaces and splitting at these is several times faster than a pattern."""
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER + SEPARATORS, LOWER + " " * len(SEPARATORS))
    return F.array_remove(F.split(plain, " "), "")


def spans(docs: DataFrame, near: int = NEAR) -> DataFrame:
    """Rows key, template, label, phrase, start, last, covered of every span with two 2-grams
    of a template or all of a shorter one. docs: key, of any type that can be grouped by, and text."""
    spark = docs.sparkSession
    known = spark.createDataFrame(templates(), "template int, label string, phrase boolean, grams int, at int, a string, b string").withColumn("gram", F.xxhash64("a", "b"))
    own = docs.select("key", words(F.col("text")).alias("w"))
    pairs = own.select("key", F.posexplode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))).alias("b"))).alias("i", "p"))
    grams = pairs.where("p.b is not null").select("key", F.col("i").cast("long").alias("i"), F.col("p.a").alias("_a"), F.col("p.b").alias("_b"), F.xxhash64("p.a", "p.b").alias("gram"))
    votes = grams.join(F.broadcast(known), "gram").where("_a = a and _b = b")
    diagonals = votes.groupBy("key", "template", "label", "phrase", "grams", (F.col("i") - F.col("at")).alias("diagonal")).agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("mask"))
    diagonals = diagonals.where((F.bit_count("mask") > 1) | (F.col("grams") == 1))
    over = W.partitionBy("key", "template").orderBy("diagonal")
    far = F.when(F.col("phrase") | (F.col("diagonal") - F.lag("diagonal").over(over) > near), 1).otherwise(0)
    merged = diagonals.withColumn("_far", far).withColumn("span", F.sum("_far").over(over))
    merged = merged.groupBy("key", "template", "label", "phrase", "grams", "span").agg(F.min("diagonal").alias("start"), F.max("diagonal").alias("last"), F.bit_or("mask").alias("mask"))
    return merged.select("key", "template", "label", "phrase", "start", "last", (F.bit_count("mask") / F.col("grams")).alias("covered"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cover: float = COVER) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    base: every place where all words of a phrase stand in a row. labels adds those of
    notices of which a span covers at least `cover`; score is the largest cover of any span,
    0 without one. Documents are told apart by their id, and texts of one id by two 64-bit
    hashes, of the text and of its reverse. Null and empty texts have no words and labels ''. Rows with equal id and
    text each get a row with the same values; an empty table gives none; other columns don't matter."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    text = F.coalesce("text", F.lit(""))
    own = own.withColumn("key", F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.xxhash64(text).alias("print"), F.xxhash64(F.reverse(text)).alias("reverse")))
    found = spans(own.select("key", "text"))
    base = F.col("phrase") & (F.col("covered") == 1)
    per_doc = found.groupBy("key").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(base | (~F.col("phrase") & (F.col("covered") >= cover)), F.col("label")))), ",").alias("labels"),
        F.max("covered").alias("score"),
    )
    count = own.select("doc_id", "key", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    return count.join(per_doc, "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    quoted = lambda x: f"'{x}'" if isinstance(x, str) else str(x).lower()
    values = ", ".join(f"({', '.join(map(quoted, r))})" for r in templates())
    return rf"""
with k(template, label, phrase, grams, "at", a, b) as (values {values}),
d as (select row_number() over () as key, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') as w from documents),
g as (select key, i - 1 as i, w[i] as a, w[i + 1] as b from (select key, w, unnest(range(1, len(w))) as i from d)),
v as (select key, template, label, phrase, grams, i - "at" as diagonal, bit_or(1::bigint << "at") as mask from g join k using (a, b) group by all),
m as (
  select *, case when phrase or diagonal - lag(diagonal) over (partition by key, template order by diagonal) > {NEAR} then 1 else 0 end as far
  from v where bit_count(mask) > 1 or grams = 1),
n as (select *, sum(far) over (partition by key, template order by diagonal rows unbounded preceding) as span from m),
s as (select key, template, label, phrase, min(diagonal) as start, bit_count(bit_or(mask))::double / grams as covered from n group by key, template, label, phrase, grams, span),
p as (
  select key, count(*) filter (phrase and covered = 1) as n_base, min(start) filter (phrase and covered = 1) as first_word, max(start) filter (phrase and covered = 1) as last_word,
    string_agg(distinct label, ',' order by label) filter (phrase and covered = 1) as base_labels,
    string_agg(distinct label, ',' order by label) filter (phrase and covered = 1 or not phrase and covered >= {COVER}) as labels, max(covered) as score
  from s group by key)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0)::double as score
from d left join p using (key)
"""


OP6_SQL = _sql()
