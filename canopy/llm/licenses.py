"""License scans: a positional index of rare template words, alignment by relative position, key phrases."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm import common

# Phrases and their labels.
BASE = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}

# Label, words of the licence's notice, and the phrase that must stand in the file.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "permission is hereby granted"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache license version"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", "released into the public domain"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law", "dedicated the work to the public domain"),
    ("cc-by", "this work is licensed under the creative commons attribution 4 0 international license", "creative commons attribution"),
    ("mit", "released under the mit license", "under the mit license"),
    ("apache", "licensed under the apache license version 2 0", "under the apache license"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable"),
]

#: A licence word is rare if its IDF over all documents is so high at least; others count around the key phrase only.
LEAST_IDF = 1.5
#: So many of a file's rarest licence words are looked up for the score; all rare ones vote for labels.
LOOK_UP = 8
#: So many template words have to stand at their relative places.
ALIGNED = 4


def words_of(text: Column) -> Column:
    return F.filter(F.split(common.ascii_lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def vocabulary() -> list[str]:
    return sorted({w for _, text, _ in TEMPLATES for w in text.split()})


def rare_words(docs: DataFrame, text_col: str, least_idf: float) -> list[tuple[str, float]]:
    """Licence words with their IDF over all documents, rarest first; as many rows as the templates have words come to the driver, no more."""
    vocab = F.array(*map(F.lit, vocabulary()))
    seen = docs.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect(vocab, words_of(F.coalesce(F.col(text_col).cast("string"), F.lit("")))))).alias("w"))
    df = {r.w: r.n for r in seen.groupBy("w").agg(F.count("*").alias("n")).collect()}
    n = df.pop("", 0)
    idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) for w in vocabulary()}
    # a word that almost no document has is rare whatever the size of the corpus
    return sorted(((w, x) for w, x in idf.items() if x >= least_idf or df.get(w, 0) <= 1), key=lambda p: (-p[1], p[0]))


def phrase_starts(words: str, phrase: tuple[str, ...]) -> Column:
    """Places (words from 0) where the words of a phrase stand one after the other."""
    last = len(phrase) - 1
    hit = lambda w, i: F.aggregate(F.array(*[F.coalesce(F.get(words, i - last + k) == p, F.lit(False)) for k, p in enumerate(phrase[:-1])]), w == phrase[-1], lambda a, b: a & b)
    return F.transform(F.filter(F.transform(words, lambda w, i: F.when(hit(w, i), i - last).otherwise(F.lit(-1))), lambda i: i >= 0), lambda i: i.cast("long"))


def with_alignments(own: DataFrame, picked: str, runs: str, words: Column, postings: Column, aligned: int) -> DataFrame:
    """Add runs, array<struct<n, t>>: where so many words of column `picked` as `aligned` stand at their places in a verified template t."""
    at = f"{runs}_votes"
    own = own.withColumn(at, F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.cast("long").alias("i"))), lambda x: F.array_contains(picked, x["w"])))
    of_verified = lambda x: F.filter(F.get(postings, F.array_position(words, x["w"]).cast("int") - 1), lambda p: F.array_contains("verified", p["t"]))
    own = own.withColumn(at, F.sort_array(F.flatten(F.transform(at, lambda x: F.transform(of_verified(x), lambda p: F.shiftleft(p["t"], 40) + (x["i"] - p["at"] + (1 << 39)))))))
    # votes are sorted: where there are n equal ones, n - aligned + 1 of them have an equal one aligned - 1 further on
    own = own.withColumn(at, F.filter(at, lambda v, i: F.coalesce(F.get(at, i + (aligned - 1)) == v, F.lit(False))))
    longest = max(len(text.split()) for _, text, _ in TEMPLATES)
    return own.withColumn(runs, F.transform(at, lambda v, i: F.struct((F.size(F.filter(F.sequence(F.lit(0), F.lit(longest)), lambda r: F.coalesce(F.get(at, i + r) == v, F.lit(False)))) + (aligned - 1)).alias("n"), F.shiftright(v, 40).cast("int").alias("t"))))


def at_phrase(t: Column) -> Column:
    """struct<n, t>: how many words of template t, rare or not, stand at their places around its key phrase, where that is best."""
    listed = lambda xs: F.array(*[F.array(*map(F.lit, x.split())) for x in xs])
    text, phrase = F.get(listed(x for _, x, _ in TEMPLATES), t.cast("int")), F.get(listed(p for _, _, p in TEMPLATES), t.cast("int"))
    before = F.get(F.array(*[F.lit(f" {x} ".split(f" {p} ")[0].count(" ")) for _, x, p in TEMPLATES]), t.cast("int"))
    places = F.filter(F.transform("words", lambda w, i: F.when((w == F.get(phrase, F.lit(0))) & (F.slice("words", i + 1, F.size(phrase)) == phrase), i - before)), lambda i: i.isNotNull())
    n = F.transform(places, lambda i: F.size(F.filter(F.transform(text, lambda w, k: F.get("words", i + k) == w), lambda x: F.coalesce(x, F.lit(False)))))
    return F.struct(F.array_max(n).alias("n"), t.cast("int").alias("t"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_idf: float = LEAST_IDF, look_up: int = LOOK_UP, aligned: int = ALIGNED) -> DataFrame:
    """Licences of every document, a row for each row of docs.

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score. The score is
    the share of looked-up words that stand where the best template has them, or of all rare words
    if no template has enough of those looked up, or the share of the template's words, rare or not,
    if only they are enough; a base phrase alone gives 0.5; nothing gives 0. Null and empty texts have no words and no labels, a null id is kept,
    ties between templates give all their labels, other columns are not looked at.
    """
    rare = [w for w, _ in rare_words(docs, text_col, least_idf)]
    words = F.array(*map(F.lit, rare)) if rare else F.array().cast("array<string>")
    postings = F.array(*[F.array(*[F.struct(F.lit(t).cast("long").alias("t"), F.lit(at).cast("long").alias("at")) for t, (_, text, _) in enumerate(TEMPLATES) for at, x in enumerate(text.split()) if x == w]) for w in rare])
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("words", words_of(F.col("text")))
    none = F.array().cast("array<long>")
    has = F.array_contains("words", "license")
    own = own.withColumn("has", has)
    for phrase, label in BASE.items():
        own = own.withColumn(f"at_{label}", F.when(F.col("has"), phrase_starts("words", phrase)).otherwise(none))
    own = own.withColumn("base", F.array_sort(F.concat(*[F.col(f"at_{x}") for x in BASE.values()])))
    own = own.withColumn("base_list", F.filter(F.array(*[F.when(F.size(f"at_{x}") > 0, F.lit(x)) for x in sorted(BASE.values())]), lambda x: x.isNotNull()))
    joined = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    own = own.withColumn("joined", joined).withColumn("verified", F.filter(F.array(*[F.when(F.col("joined").contains(f" {p} "), F.lit(t).cast("long")) for t, (_, _, p) in enumerate(TEMPLATES)]), lambda t: t.isNotNull()))
    if rare:
        own = own.withColumn("held", F.when(F.size("verified") > 0, F.array_intersect(words, F.col("words"))))
        own = own.withColumn("top", F.slice("held", 1, look_up)).withColumn("top", F.when(F.size("top") >= aligned, F.col("top")))
        for picked, runs in (("held", "good"), ("top", "scored")):
            own = with_alignments(own, picked, runs, words, postings, aligned)
        most = lambda runs: F.array_max(F.transform(runs, lambda r: r["n"]))
        own = own.withColumn("share", F.when(F.size("scored") > 0, F.least(F.lit(1.0), most("scored") / F.size("top"))).when(F.size("good") > 0, F.least(F.lit(1.0), most("good") / F.size("held"))))
    else:
        own = own.withColumn("good", F.array().cast("array<struct<n:int,t:int>>")).withColumn("share", F.lit(None).cast("double"))
    # common words have no say where chance may align them, only beside the key phrase at its own place
    own = own.withColumn("whole", F.when(F.size("verified") > 0, F.filter(F.transform("verified", at_phrase), lambda r: r["n"] >= aligned)))
    names = F.array(*[F.lit(x) for x, _, _ in TEMPLATES])
    labels = lambda runs: F.coalesce(F.transform(runs, lambda r: F.get(names, r["t"])), F.array().cast("array<string>"))
    own = own.withColumn("found", F.array_distinct(F.concat(labels("good"), labels("whole"))))
    lengths = F.array(*[F.lit(len(text.split())) for _, text, _ in TEMPLATES])
    own = own.withColumn("share", F.coalesce("share", F.array_max(F.transform("whole", lambda r: r["n"] / F.get(lengths, r["t"]))), F.lit(0.0)))
    return own.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base").alias("first_word"),
        F.array_max("base").alias("last_word"),
        F.array_join("base_list", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base_list", "found"))), ",").alias("labels"),
        F.greatest(F.col("share"), F.when(F.size("base") > 0, F.lit(0.5)).otherwise(F.lit(0.0))).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))


_POSTINGS = ", ".join(f"({t}, '{label}', {at}, '{w}')" for t, (label, text, _) in enumerate(TEMPLATES) for at, w in enumerate(text.split()))
_KEYS = ", ".join(f"({t}, ' {phrase} ')" for t, (_, _, phrase) in enumerate(TEMPLATES))
SQL = rf"""
WITH tv(t, label, pos, word) AS (VALUES {_POSTINGS}),
keys(t, phrase) AS (VALUES {_KEYS}),
d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT k, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM d),
b AS (SELECT k, i, word AS a1, lead(word) OVER win AS a2, lead(word, 2) OVER win AS a3 FROM o WINDOW win AS (PARTITION BY k ORDER BY i)),
hits AS (SELECT k, i, CASE WHEN a1 = 'mit' THEN 'mit' WHEN a1 = 'apache' THEN 'apache' ELSE 'gpl' END AS label FROM b
         WHERE a1 IN ('mit', 'apache') AND a2 = 'license' OR a1 = 'general' AND a2 = 'public' AND a3 = 'license'),
base AS (SELECT k, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM hits GROUP BY k),
df AS (SELECT v.word, count(DISTINCT o.k) AS n FROM (SELECT DISTINCT word FROM tv) v LEFT JOIN o ON o.word = v.word GROUP BY v.word),
rare AS (SELECT * FROM df WHERE n <= 1 OR ln(((SELECT count(*) FROM d) + 1) / (n + 1)) >= {LEAST_IDF}),
ranked AS (SELECT k, word, row_number() OVER (PARTITION BY k ORDER BY n, word) AS r FROM (SELECT DISTINCT o.k, rare.word, rare.n FROM o JOIN rare ON o.word = rare.word)),
top AS (SELECT k, word, count(*) OVER (PARTITION BY k) AS size FROM ranked WHERE r <= {LOOK_UP}),
ok AS (SELECT d.k, keys.t FROM d JOIN (SELECT DISTINCT k FROM top WHERE size >= {ALIGNED}) c ON c.k = d.k JOIN keys ON contains(' ' || array_to_string(w, ' ') || ' ', phrase)),
votes AS (SELECT o.k, tv.t, tv.label, o.i - tv.pos AS start, count(*) AS n, min(top.size) AS size FROM top JOIN o ON o.k = top.k AND o.word = top.word JOIN tv ON tv.word = o.word
          JOIN ok ON ok.k = o.k AND ok.t = tv.t GROUP BY ALL HAVING count(*) >= {ALIGNED}),
found AS (SELECT k, max(least(1.0, n / size)) AS share FROM votes GROUP BY k),
names AS (SELECT k, label, TRUE AS is_base FROM hits UNION ALL SELECT k, label, FALSE FROM votes),
lists AS (SELECT k, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM names GROUP BY k)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(greatest(coalesce(share, 0.0), CASE WHEN n_base > 0 THEN 0.5 ELSE 0.0 END) AS DOUBLE) AS score
FROM d LEFT JOIN base USING (k) LEFT JOIN found USING (k) LEFT JOIN lists USING (k)
"""
