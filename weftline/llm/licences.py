"""Licence scans by a positional rare-token index, with DataFrame functions only.

A template is a licence phrase or notice. Its postings say at which places each of its words stands. One pass over the corpus counts in how many documents
each template word occurs; that gives the words' inverse document frequencies. Then, in one narrow stage, every file

1. finds the licence words it holds, and with them the templates whose mandatory words are all there,
2. looks up, for each such template, the `rare` words with the highest IDF among those the file holds,
3. intersects their postings by relative position: a word at i that stands at p in the template proposes the start i - p, and a start stands if enough of
   the looked-up words are at their places,
4. verifies what stands: a phrase must be there word by word, a notice must have every mandatory key phrase within `slack` words of it.

A phrase's occurrence holds all its words, so the file's highest-IDF word of it is among the looked-up ones and proposes the right start: no place is lost,
whatever the IDFs. Nothing is shuffled but the counts of the template words, which are as many as the templates are long.

A null text is empty: no words, no labels, score 0. Rows with equal ids or texts are judged one by one; an empty table gives an empty result; extra columns are dropped.
Labels are distinct and sorted; `score` is the greatest share of a found template's words that stand at their places (1 for a phrase), 0 without a label.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A phrase (no keys: every word must be there) or a notice with its mandatory key phrases."""

    label: str
    text: str
    keys: tuple[str, ...] = ()

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def mandatory(self) -> list[list[str]]:
        return [k.split() for k in self.keys or (self.text,)]


# The phrases and labels that the contract names.
BASE = (
    Template("gpl", "gnu general public license"),
    Template("apache", "apache license"),
    Template("cc-by", "cc by"),
    Template("mit", "mit license"),
)

# The words of common licence notices, lower-cased and without marks.
NOTICES = (
    Template("agpl-3.0", "under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("in compliance with the license", "apache org licenses license 2 0")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "with or without modification")),
    Template("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("accompanying documentation covered by this license",)),
    Template("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
    Template("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse public license 2 0",)),
    Template("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("gpl-or-later", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license", "free software foundation", "any later version")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "to deal in the software without restriction")),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software", "public domain")),
    Template("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", ("plainly marked as such", "misrepresented as being the original software")),
)


#: The signs that separate words.
MARKS = "".join(map(chr, (*range(48), *range(58, 97), *range(123, 128))))


def file_words(text: Column) -> Column:
    """A text's words after A-Z went to a-z, as far as words of ASCII letters go.

    Spark's own lower-casing is many times faster than a translation of letters. It maps one sign outside ASCII to an ASCII letter, the Kelvin sign, which is put
    aside first; what it does to other words can make none of them equal to a template's, nor change where words end. Splitting at spaces is many times
    faster than extracting matches.
    """
    lower = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u00b5")))
    spaced = F.btrim(F.translate(lower, MARKS, " " * len(MARKS)))
    return F.array_remove(F.split(spaced, " +"), "")  # an empty text splits into one empty word


def frequencies(files: DataFrame, vocabulary: Sequence[str]) -> dict[str, int]:
    """In how many of all files(_words) each template word occurs. Sums up before the shuffle; a number for each template word comes to the driver."""
    held = files.select(F.explode(F.array_intersect(F.lit(list(vocabulary)), "_words")).alias("word"))
    return {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}


def ranked(words: Sequence[str], counts: dict[str, int]) -> list[str]:
    """The distinct words, the highest inverse document frequency first; ties by the word."""
    return sorted(set(words), key=lambda w: (counts.get(w, 0), w))


def _index(templates: Sequence[Template], counts: dict[str, int]) -> Column:
    """The templates as one constant: their words by IDF, their postings, their key phrases."""
    strings = lambda xs: F.array(*map(F.lit, xs))

    def entry(t: Template) -> Column:
        return F.struct(
            F.lit(t.label).alias("label"),
            F.lit(not t.keys).alias("phrase"),
            strings(ranked(t.words, counts)).alias("by_idf"),
            strings(ranked([w for k in t.mandatory for w in k], counts)).alias("needed"),
            F.array(*(F.struct(F.lit(w).alias("word"), F.lit(p).alias("p")) for p, w in enumerate(t.words))).alias("postings"),
            F.array(*(strings(k) for k in t.mandatory)).alias("keys"),
        )

    return F.array(*map(entry, templates))


def _at(words: Column, i: Column) -> Column:
    """The word at i, or null outside the file."""
    return F.get(words, i)


def _found(words: Column, held: Column, template: Column, rare: int, share: float, slack: int) -> Column:
    """The starts of a template in a file, each with the share of its words that are at their places."""
    looked = F.slice(F.array_intersect(template["by_idf"], held), 1, rare)
    postings = F.filter(template["postings"], lambda q: F.array_contains(looked, q["word"]))
    places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.array_contains(looked, _at(words, i)))
    starts = F.array_distinct(F.flatten(F.transform(places, lambda i: F.transform(F.filter(postings, lambda q: q["word"] == _at(words, i)), lambda q: i - q["p"]))))
    fits = lambda which, d: F.size(F.filter(which, lambda q: F.coalesce(_at(words, d + q["p"]) == q["word"], F.lit(False))))
    stands = lambda key, s: F.forall(F.sequence(F.lit(0), F.size(key) - 1), lambda j: F.coalesce(_at(words, s + j) == _at(key, j), F.lit(False)))
    length = F.size(template["postings"])

    def verified(d: Column) -> Column:
        nearby = F.sequence(F.greatest(F.lit(0), d - slack), F.greatest(F.lit(0), d + length + slack))
        keyed = F.forall(template["keys"], lambda key: F.exists(nearby, lambda s: stands(key, s)))
        return F.when(template["phrase"], stands(F.flatten(template["keys"]), d)).otherwise(keyed)

    # the intersection by relative position decides first: verifying costs more
    crossed = F.filter(starts, lambda d: fits(postings, d) >= F.greatest(F.lit(1), F.ceil(F.size(postings) * F.when(template["phrase"], F.lit(1.0)).otherwise(share))))
    return F.transform(F.filter(crossed, verified), lambda d: F.struct(d.alias("start"), (fits(template["postings"], d) / length).alias("share")))


def scan(docs: DataFrame, templates: Sequence[Template], base: Sequence[Template] = (), rare: int = 8, share: float = 0.5, slack: int = 8) -> DataFrame:
    """docs with _n_words and _found: (label, base, start, share) of every place of every template. docs must be cheap to read twice.

    rare: how many of a template's highest-IDF words a file looks up. share: of those words' postings, how many must be at their places for a notice.
    """
    every = [*base, *templates]
    files = docs.withColumn("_words", file_words(F.col("text")))
    counts = frequencies(files.select("_words"), sorted({w for t in every for w in t.words}))
    vocabulary = ranked([w for t in every for w in t.words], counts)
    held = F.array_intersect(F.lit(vocabulary), "_words")
    index = _index(every, counts)
    of_base = F.array(*(F.lit(i < len(base)) for i in range(len(every))))
    entries = F.arrays_zip(index.alias("t"), of_base.alias("base"))
    with_held = files.withColumn("_held", held)
    candidates = F.filter(entries, lambda e: F.size(F.array_except(e["t"]["needed"], F.col("_held"))) == 0)
    places = F.flatten(
        F.transform(
            "_candidates",
            lambda e: F.transform(
                _found(F.col("_words"), F.col("_held"), e["t"], rare, share, slack),
                lambda x: F.struct(e["t"]["label"].alias("label"), e["base"].alias("base"), x["start"].alias("start"), x["share"].alias("share")),
            ),
        )
    )
    return with_held.withColumn("_candidates", candidates).withColumns({"_n_words": F.size("_words"), "_found": places}).drop("_words", "_held", "_candidates")


def op11_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, NOTICES, BASE).drop("text")
    base = F.filter("_found", lambda x: x["base"])
    joined = lambda xs: F.array_join(F.array_sort(F.array_distinct(F.transform(xs, lambda x: x["label"]))), ",")
    starts = F.transform("_base", lambda x: x["start"].cast("long"))
    return found.withColumn("_base", base).select(
        "doc_id",
        F.col("_n_words").cast("long").alias("n_words"),
        F.size("_base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(F.col("_base")).alias("base_labels"),
        joined(F.col("_found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("_found", lambda x: x["share"])), F.lit(0.0)).alias("score"),
    )


def _oracle(templates: Sequence[Template] = NOTICES, base: Sequence[Template] = BASE, rare: int = 8, share: float = 0.5, slack: int = 8) -> str:
    """The method by joins: a row for each word of a file, template, proposed start and looked-up word."""
    every = [*base, *templates]
    listed = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    rows = ", ".join(f"({i}, '{t.label}', {'true' if i < len(base) else 'false'}, {'true' if not t.keys else 'false'}, {listed(t.words)}, [{', '.join(map(listed, t.mandatory))}])" for i, t in enumerate(every))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH t AS (SELECT * FROM (VALUES {rows}) v(t, label, base, phrase, words, keys)),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{WORD}') AS w FROM documents),
v AS MATERIALIZED (SELECT DISTINCT unnest(words) AS word FROM t),
h AS MATERIALIZED (SELECT r, word, i FROM (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS i FROM d) JOIN v USING (word)),
hd AS MATERIALIZED (SELECT DISTINCT r, word FROM h),
df AS (SELECT word, count(*) AS n FROM hd GROUP BY word),
need AS (SELECT DISTINCT t, unnest(flatten(keys)) AS word FROM t),
cand AS (SELECT r, t FROM need JOIN hd USING (word) GROUP BY r, t, (SELECT count(*) FROM need x WHERE x.t = need.t) HAVING count(*) = (SELECT count(*) FROM need x WHERE x.t = need.t)),
tw AS (SELECT t, unnest(words) AS word, unnest(range(len(words))) AS p FROM t),
looked AS (SELECT r, t, word FROM (SELECT DISTINCT cand.r, cand.t, tw.word, df.n FROM cand JOIN tw ON cand.t = tw.t JOIN hd ON hd.r = cand.r AND hd.word = tw.word JOIN df ON df.word = tw.word) QUALIFY row_number() OVER (PARTITION BY r, t ORDER BY n, word) <= {rare}),
post AS (SELECT r, t, word, p FROM looked JOIN tw USING (t, word)),
need_n AS (SELECT r, t, count(*) AS n FROM post GROUP BY r, t),
start AS (SELECT post.r, post.t, h.i - post.p AS d, count(*) AS hit FROM post JOIN h ON h.r = post.r AND h.word = post.word GROUP BY ALL),
crossed AS (SELECT s.r, s.t, s.d, d.doc_id, d.w, t.label, t.base, t.phrase, t.words, t.keys FROM start s JOIN need_n USING (r, t) JOIN t USING (t) JOIN d USING (r)
  WHERE s.hit >= greatest(1, ceil(need_n.n * CASE WHEN t.phrase THEN 1.0 ELSE {share} END))),
found AS (SELECT r, label, base, d, len(list_filter(range(len(words)), lambda j: d + j >= 0 AND coalesce(w[d + j + 1] = words[j + 1], false))) / cast(len(words) AS DOUBLE) AS share FROM crossed
  WHERE CASE WHEN phrase THEN d >= 0 AND w[d + 1 : d + len(words)] = words
    ELSE len(list_filter(keys, lambda k: len(list_filter(range(greatest(0, d - {slack}), greatest(0, d + len(words) + {slack}) + 1), lambda s: w[s + 1 : s + len(k)] = k)) > 0)) = len(keys) END),
g AS (SELECT r, count(*) FILTER (base) AS n_base, min(d) FILTER (base) AS first_word, max(d) FILTER (base) AS last_word,
  list_sort(list_distinct(list(label) FILTER (base))) AS bl, list_sort(list_distinct(list(label))) AS al, max(share) AS share FROM found GROUP BY r)
SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(bl, ','), '') AS base_labels,
  coalesce(array_to_string(al, ','), '') AS labels, coalesce(share, 0.0E0) AS score FROM d LEFT JOIN g USING (r)
"""


ORACLE_SQL = _oracle()


def brute_force(text: str | None, base: Sequence[Template] = BASE) -> tuple[int, list[tuple[int, str]]]:
    """A text's number of words and all places of the phrases, by plain loops, for tests."""
    words = re.findall(WORD, (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return len(words), sorted((i, t.label) for t in base for i in range(len(words)) if words[i : i + len(t.words)] == t.words)
