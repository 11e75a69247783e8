"""Licence scans over a positional index of the words of licence notices.

Counts over all documents rank the notices' words by rarity.  All of a text's
licence words are looked up in the notices' postings, so notices do not take
each other's votes; a notice is a candidate where several of them agree on its
relative position, and its key phrase must then stand at that place.  Short
phrases that name a licence are found by the same consecutive match.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, column, fixed, unfold, with_row

#: Phrases that name a licence wherever they stand.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Openings of notices (label, words, key phrase); fixed public texts.
NOTICES = (
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "not use this file except in compliance"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "you can redistribute it and or modify it"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "for any purpose with or without fee"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "subject to the terms of the mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
)
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """A text in which words of ASCII stand as if only A-Z had been lower-cased, and words begin and end as they do then.

    lower() also changes other capitals, into characters beyond ASCII that no
    phrase holds; all but the two that become ASCII letters.
    """
    return F.when(text.contains("\u0130") | text.contains("\u212a"), ascii_lower(text)).otherwise(F.lower(text))


def postings() -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {}
    for k, (_, text, _) in enumerate(NOTICES):
        for i, word in enumerate(text.split()):
            out.setdefault(word, []).append((k, i))
    return out


def starts(found: Column, phrase: str) -> Column:
    """Places where a phrase's words stand one after the other in a column of words."""
    parts = phrase.split()
    places = F.when(F.size(found) >= len(parts), F.sequence(F.lit(0), F.size(found) - len(parts))).otherwise(F.array().cast("array<int>"))

    def at(i: Column) -> Column:
        out = F.get(found, i) == parts[0]
        for k, word in enumerate(parts[1:], 1):
            out = out & (F.get(found, i + k) == word)
        return out

    return F.filter(places, at)


def rarity(docs: DataFrame, text_col: str = "text") -> dict[str, float]:
    """Inverse document frequency of each word of the notices, from counts over all documents."""
    vocabulary = F.array(*[F.lit(w) for w in sorted(postings())])
    found = docs.select(F.explode(F.array_intersect(F.split(lowered(column(text_col)), SPLIT), vocabulary)).alias("word"))
    held = {r["word"]: r["count"] for r in found.groupBy("word").count().collect()}  # a row per notice word at most
    n = docs.count()
    return {w: math.log((n + 1) / (held.get(w, 0) + 1)) + 1 for w in postings()}


def scan_licenses(docs: DataFrame, text_col: str = "text", agree: int = 3) -> DataFrame:
    """The input's columns with n_words, n_base, first_word, last_word, base_labels, labels, score and notices.

    Words are runs of digits, a-z (A-Z lower-cased) and characters beyond ASCII.
    n_base: places of the naming phrases; first_word and last_word: their
    smallest and largest start, null without one.  notices: (label, start)
    structs that the index finds with `agree` or more of the text's licence
    words in line and the key phrase in place.  labels: both
    kinds, distinct, sorted, comma-joined (empty for none).  score: 1 for a
    naming phrase, else the best notice's share of rarity found (to 9 places),
    else 0.  Null texts count as empty; an empty table gives an empty table; columns of the
    new names are replaced.
    """
    idf = rarity(docs, text_col)
    index = postings()
    rows = with_row(docs, __text=text_col)
    norm = F.btrim(F.regexp_replace(lowered(F.coalesce("__text", F.lit(""))), SPLIT, " "))
    rows = fixed(rows, norm=norm)
    rows = fixed(rows, w=F.when(F.col("norm") != "", F.split("norm", " ")).otherwise(F.array().cast("array<string>")))
    none = F.array().cast("array<int>")
    base = [F.when(F.col("norm").contains(p), starts(F.col("w"), p)).otherwise(none) for p in PHRASES]
    ranked = sorted(idf, key=lambda w: (-idf[w], w))
    order = F.array(*[F.lit(w) for w in ranked])
    rows = fixed(rows, **{f"b{k}": b for k, b in enumerate(base)}, top=F.array_intersect(order, F.col("w")))
    # the places of the text's licence words, as (notice, start of the notice) votes
    kind = "array<struct<k:int,i:int>>"
    table = F.create_map(*[x for w in ranked for x in (F.lit(w), F.array(*[F.struct(F.lit(k).alias("k"), F.lit(i).alias("i")) for k, i in index[w]]))])
    places = F.filter(F.transform("w", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda p: F.array_contains("top", p["x"]))
    votes = F.flatten(F.transform(places, lambda p: F.transform(F.element_at(table, p["x"]), lambda q: F.struct(q["k"].alias("k"), (p["i"] - q["i"]).alias("i")))))
    rows = fixed(rows, votes=F.sort_array(F.when(F.size("top") >= agree, votes).otherwise(F.array().cast(kind))))
    lined = F.filter("votes", lambda v, j: F.coalesce(F.get("votes", j + agree - 1) == v, F.lit(False)))
    rows = fixed(rows, lined=F.array_distinct(lined))

    def phrase_there(v: Column) -> Column:
        out = F.lit(False)
        for k, (_, text, phrase) in enumerate(NOTICES):
            whole, key = text.split(), phrase.split()
            at = next(i for i in range(len(whole)) if whole[i : i + len(key)] == key)
            out = out | ((v["k"] == k) & (F.slice("w", F.greatest(v["i"] + at + 1, F.lit(1)), len(key)) == F.array(*[F.lit(x) for x in key])) & (v["i"] + at >= 0))
        return out

    names = F.array(*[F.lit(n[0]) for n in NOTICES])
    full = F.array(*[F.lit(sum(idf[w] for w in sorted(set(n[1].split())))) for n in NOTICES])
    rows = fixed(rows, seen=F.filter("lined", phrase_there))
    weigh = F.create_map(*[x for w in ranked for x in (F.lit(w), F.lit(idf[w]))])
    notice_words = F.array(*[F.array(*[F.lit(x) for x in sorted(set(n[1].split()))]) for n in NOTICES])

    def share(v: Column) -> Column:
        near = F.slice("w", F.greatest(v["i"] + 1, F.lit(1)), 40)
        got = F.aggregate(F.array_intersect(F.get(notice_words, v["k"]), near), F.lit(0.0), lambda s, x: s + F.element_at(weigh, x))
        return F.round(F.least(got / F.get(full, v["k"]), F.lit(1.0)), 9)

    starts_all = F.concat(*[F.col(f"b{k}") for k in range(len(base))])
    said = F.filter(F.array(*[F.when(F.size(f"b{k}") > 0, F.lit(label)) for k, label in enumerate(PHRASES.values())]), lambda x: x.isNotNull())
    found = F.transform("seen", lambda v: F.get(names, v["k"]))
    join = lambda x: F.array_join(F.sort_array(F.array_distinct(x)), ",")
    best = F.when(F.size(starts_all) > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("seen", share)), F.lit(0.0)))
    return unfold(
        rows, docs.columns, n_words=F.size("w").cast("long"), n_base=F.size(starts_all).cast("long"), first_word=F.array_min(starts_all).cast("long"), last_word=F.array_max(starts_all).cast("long"),
        base_labels=join(said), labels=join(F.concat(said, found)), score=best, notices=F.transform("seen", lambda v: F.struct(F.get(names, v["k"]).alias("label"), v["i"].alias("start"))),
    )
