"""License scan by a positional index of rare words, in DataFrame functions only.

Templates are license names, notices and the sentences of license texts.  Every file keeps the positions of the
words that any template uses; document frequencies of those words over all files give their rarity.  A template
counts at a placement (file position less template position) where at least ``SHARE`` of its words stand at
their places and its mandatory key phrase stands word for word.

Such a placement holds at least one of the template's rarest words, of as many as it may lack and one more.  So
a file looks up its rarest license words first; only if one of them is posted are the postings of all its
license words intersected: every posting of a word at a position names a template and a placement, and equal
names are counted.  Rarity decides what is looked up, never what is found.  All of it is per row, with one
small aggregate for the frequencies.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm.common import own_columns, stored, table

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The phrases of the base labels
BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))

# License names, notices and sentences as they are commonly written (label, words, mandatory key phrase)
TEMPLATES = (
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "hereby granted free"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "copies or substantial portions"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "except in compliance"),
    ("apache", "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind", "as is basis"),
    ("gpl", "licensed under the gnu general public license version 3", "general public license"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license as published"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("lgpl", "licensed under the gnu lesser general public license version 3", "lesser general public license"),
    ("agpl", "gnu affero general public license", "affero general public license"),
    ("agpl", "licensed under the gnu affero general public license version 3", "affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "binary forms"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", "binary form must reproduce"),
    ("bsd", "released under the bsd license", "bsd license"),
    ("mpl", "subject to the terms of the mozilla public license version 2 0", "mozilla public license"),
    ("epl", "available under the terms of the eclipse public license version 2 0", "eclipse public license"),
    ("isc", "released under the isc license", "isc license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
    ("cc-by", "licensed under cc by 4 0", "cc by"),
    ("cc-by", "licensed under a creative commons attribution license", "creative commons attribution"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc0", "dedicated to the public domain under cc0", "public domain"),
    ("proprietary", "all rights reserved", "all rights reserved"),
    ("proprietary", "confidential and proprietary do not distribute", "confidential and proprietary"),
)

SHARE = 0.7  # of a template's words must stand at their places

# Words too frequent in English prose to be kept with their positions, key phrases apart
STOP = frozenset("the of is to a this or in with are do not use and any on by".split())


def _vocabulary() -> list[str]:
    kept = {w for _, text, _ in TEMPLATES for w in text.split() if w not in STOP}
    return sorted(kept | {w for _, _, phrase in TEMPLATES for w in phrase.split()} | {w for _, p in BASE for w in p.split()})


def words_of(text: Column) -> Column:
    """Words of the text with A-Z lower-cased, in order; a null text has none."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(low, F.lit(WORDS), F.lit(0))


def _has(word_at: Column, position: Column, word: str) -> Column:
    return F.array_contains(word_at, F.struct(position.cast("int").alias("i"), F.lit(word).alias("w")))


def _phrase_starts(hits: Column, phrase: str) -> Column:
    """Positions where the phrase's words stand one after the other."""
    first, *rest = phrase.split()

    def at(h: Column) -> Column:
        found = h["w"] == first
        for k, word in enumerate(rest, 1):
            found = found & _has(hits, h["i"] + k, word)
        return found

    return F.transform(F.filter(hits, at), lambda h: h["i"])


def _templates() -> list[tuple[str, list[tuple[int, str]], list[tuple[int, str]], int]]:
    """(label, indexed words with their places, the key phrase's words with theirs, least number of words) of each template."""
    vocabulary, out = set(_vocabulary()), []
    for label, notice, phrase in TEMPLATES:
        words, key = notice.split(), phrase.split()
        at = next(p for p in range(len(words)) if words[p : p + len(key)] == key)
        indexed = [(p, w) for p, w in enumerate(words) if w in vocabulary]
        out.append((label, indexed, [(at + k, w) for k, w in enumerate(key)], math.ceil(SHARE * len(indexed) - 1e-9)))
    return out


# a placement's name: the template's number, then the file position less the template's (which may be negative)
_TEMPLATE, _ORIGIN = 1 << 40, 1 << 20


def _index(postings: dict[str, list[int]]) -> Column:
    """A map literal from words to their postings."""
    return F.create_map(*[x for w, names in sorted(postings.items()) for x in (F.lit(w), F.array(*[F.lit(n).cast("long") for n in names]))])


def _named(hits: Column, index: Column) -> Column:
    """Names of the placements that the hits' postings point to."""
    return F.flatten(F.transform(hits, lambda h: F.transform(F.element_at(index, h["w"]), lambda v: v + h["i"])))


def scanned(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``; see the module's text.

    Null and empty texts have no words, labels '' and score 0.  Repeated rows and doc_ids keep a row each; an
    empty table gives no rows.  Labels are distinct, sorted and comma-joined; the score is the largest share of
    a template's words at a placement that counts.
    """
    vocabulary, templates = _vocabulary(), _templates()
    base = own_columns(docs, doc_id="doc_id", text="text").select("doc_id", words_of(F.col("text")).alias("words"))
    # positions of license words first, as plain numbers; only those get a struct
    places = F.filter(F.transform("words", lambda w, i: F.when(w.isin(vocabulary), i).otherwise(-1)), lambda i: i >= 0)
    base = base.select("doc_id", F.size("words").cast("long").alias("n_words"), "words", places.alias("places"))
    hits = F.transform("places", lambda i: F.struct(i.alias("i"), F.get("words", i).alias("w")))
    base = stored(base.select("doc_id", "n_words", hits.alias("hits")), "license-words")

    # at most one row for each word of the vocabulary
    seen = base.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["w"]))).alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    df = {r.w: r.df for r in seen.collect()}

    starts = [(label, _phrase_starts(F.col("hits"), phrase)) for label, phrase in BASE]
    base = base.withColumns({f"at_{label}": s for label, s in starts})
    every = F.concat(*[F.col(f"at_{label}") for label, _ in starts])

    whole: dict[str, list[int]] = {}
    rare: dict[str, list[int]] = {}
    for t, (_, indexed, _, least) in enumerate(templates):
        rarest = sorted(indexed, key=lambda x: (df.get(x[1], 0), x))[: len(indexed) - least + 1]
        for p, w in indexed:
            whole.setdefault(w, []).append(t * _TEMPLATE + _ORIGIN - p)
        for p, w in rarest:
            rare.setdefault(w, []).append(t * _TEMPLATE + _ORIGIN - p)
    looked_up = F.filter("hits", lambda h: h["w"].isin(sorted(rare)))
    none = F.array().cast("array<bigint>")
    base = base.withColumn("names", F.when(F.size(looked_up) > 0, F.sort_array(_named(F.col("hits"), _index(whole)))).otherwise(none))

    # equal names stand together: a run as long as the template asks for is a placement
    run_starts = F.filter(F.sequence(F.lit(1), F.size("names")), lambda k: (k == 1) | (F.get("names", k - 1) != F.get("names", k - 2)))
    base = base.withColumn("starts", F.when(F.size("names") > 0, run_starts).otherwise(F.array().cast("array<int>")))
    size_of = lambda k: F.coalesce(F.get("starts", k + 1), F.size("names") + 1) - F.get("starts", k)
    runs = F.transform("starts", lambda a, k: F.struct(
        F.shiftright(F.get("names", a - 1), 40).cast("int").alias("t"),
        (F.get("names", a - 1).bitwiseAND(_TEMPLATE - 1) - _ORIGIN).cast("int").alias("at"),
        size_of(k).alias("n"),
    ))
    least = F.array(*[F.lit(least) for *_, least in templates])
    base = base.withColumn("runs", F.filter(runs, lambda r: r["n"] >= F.get(least, r["t"])))

    # what is left is verified and scored
    phrases = F.array(*[F.array(*[F.struct(F.lit(o).alias("o"), F.lit(w).alias("w")) for o, w in key]) for _, _, key, _ in templates])
    stands = lambda r: F.forall(F.get(phrases, r["t"]), lambda x: F.array_contains(F.col("hits"), F.struct((r["at"] + x["o"]).alias("i"), x["w"].alias("w"))))
    base = base.withColumn("found", F.filter("runs", stands))
    labels = F.array(*[F.lit(label) for label, *_ in templates])
    sizes = F.array(*[F.lit(float(len(indexed))) for _, indexed, *_ in templates])

    own_base = F.array_compact(F.array(*[F.when(F.size(f"at_{label}") > 0, F.lit(label)) for label, _ in BASE]))
    own_labels = F.transform("found", lambda r: F.get(labels, r["t"]))
    joined = lambda xs: F.concat_ws(",", F.array_sort(F.array_distinct(xs)))
    return base.select(
        "doc_id",
        "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        joined(own_base).alias("base_labels"),
        joined(F.concat(own_base, own_labels)).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda r: r["n"] / F.get(sizes, r["t"]))), F.lit(0.0)).alias("score"),
    )


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License scan of the whole ``documents`` table."""
    return scanned(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The same in SQL: a template counts at a place of its key phrase if enough of its words stand at theirs."""
    places = lambda words: f"list_filter(range(1, len(w) + 1), lambda i: {' AND '.join(f'w[i + {k}] = {chr(39)}{x}{chr(39)}' for k, x in enumerate(words))})"
    starts = ", ".join(f"{places(p.split())} AS at_{label}" for label, p in BASE)
    scores = []
    for t, (_, indexed, key, least) in enumerate(_templates()):
        at = key[0][0]
        found = " + ".join(f"CASE WHEN i + {p - at} >= 1 AND w[i + {p - at}] = '{x}' THEN 1 ELSE 0 END" for p, x in indexed)
        counts = f"list_filter(list_transform({places([x for _, x in key])}, lambda i: {found}), lambda n: n >= {least})"
        scores.append(f"coalesce(list_max({counts}) / CAST({len(indexed)} AS DOUBLE), 0.0) AS s{t}")
    labels = ", ".join(f"CASE WHEN s{t} > 0 THEN '{label}' END" for t, (label, _, _) in enumerate(TEMPLATES))
    base = ", ".join(f"CASE WHEN len(at_{label}) > 0 THEN '{label}' END" for label, _ in BASE)
    every = " || ".join(f"at_{label}" for label, _ in BASE)
    join = lambda xs: f"coalesce(array_to_string(list_sort(list_distinct([{xs}])), ','), '')"
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return (
        f"WITH d AS (SELECT doc_id, regexp_extract_all({low}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents), "
        f"p AS (SELECT *, {starts}, {', '.join(scores)} FROM d) "
        f"SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len({every}) AS BIGINT) AS n_base, CAST(list_min({every}) - 1 AS BIGINT) AS first_word, "
        f"CAST(list_max({every}) - 1 AS BIGINT) AS last_word, {join(base)} AS base_labels, {join(base + ', ' + labels)} AS labels, "
        f"greatest({', '.join(f's{t}' for t in range(len(TEMPLATES)))}) AS score FROM p"
    )


QUERIES = {"op6_licenses": op6_licenses}
ORACLE_SQL = {"op6_licenses": _sql()}
