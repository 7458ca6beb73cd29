"""License scan by a positional index of rare words, with built-in functions only.

Templates are passages and notices of licences, each with a mandatory key phrase. How rare each of their words is, is counted
over all documents. The LOOKED_UP rarest words of a key phrase are its postings: (word, place in the template). A file that
lacks one of them holds no such phrase. In a file that has them, every place of such a word less its place in the template is
where the template would have to start; the starts that all postings agree on are kept, and the key phrase is verified there word by
word. The score of a place is the share of the template's words, weighted by rarity, that the file has at most SHIFT words from
where they would stand, so a few words put in or left out cost no more than themselves.

Defined cases: a null text is an empty one, without words. Rows are looked at one by
one, so repeated rows and ids are no matter. A word no document has is as rare as can
be. Result columns replace columns of their names; other extra columns are passed on.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least score of a template beyond its key phrase.
LEAST = 0.6
#: Words of a key phrase whose places are intersected, and how far words of a passage may have moved.
LOOKED_UP, SHIFT = 3, 8
_WORDLESS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The base phrases, each its own key phrase.
BASE = [
    ("mit", "under the mit license", "under the mit license"),
    ("apache-2", "apache license version 2", "apache license version 2"),
    ("cc-by-nc", "cc by nc", "cc by nc"),
]
# Label, passage of the licence, mandatory key phrase.
MORE = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "this permission notice shall be included in all copies"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("bsd", "redistributions of source code must retain", "redistributions of source code must retain"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice", "redistributions in binary form must reproduce"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "distribute this software for any purpose with or without fee"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software", "the author disclaims all warranties with regard to this software"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "www apache org licenses license 2 0"),
    ("gpl", "gnu general public license", "gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "free software you can redistribute it and or modify it"),
    ("gpl-2", "gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3", "gnu general public license version 3", "gnu general public license version 3"),
    ("lgpl", "gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license", "gnu affero general public license"),
    ("mpl", "mozilla public license", "mozilla public license"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("epl", "eclipse public license", "eclipse public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    ("boost", "boost software license version 1 0", "boost software license"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages", "in no event will the authors be held liable for any damages"),
    ("wtfpl", "do what the fuck you want to public license", "do what the fuck you want to public license"),
    ("artistic", "artistic license 2 0", "artistic license"),
    ("cc0", "cc0 1 0 universal", "cc0 1 0 universal"),
    ("cc-by-sa", "cc by sa", "cc by sa"),
    ("cc-by-sa", "creative commons attribution sharealike", "creative commons attribution sharealike"),
    ("cc-by-nc", "creative commons attribution noncommercial", "creative commons attribution noncommercial"),
    ("cc-by", "creative commons attribution", "creative commons attribution"),
]
# Label, and how its identifier reads after "SPDX-License-Identifier:".
IDENTIFIERS = [
    ("mit", "mit"), ("apache-2", "apache 2 0"), ("bsd", "bsd 2 clause"), ("bsd", "bsd 3 clause"), ("isc", "isc"), ("gpl-2", "gpl 2 0"), ("gpl-3", "gpl 3 0"),
    ("lgpl", "lgpl 2 1"), ("lgpl", "lgpl 3 0"), ("agpl", "agpl 3 0"), ("mpl-2", "mpl 2 0"), ("epl", "epl 2 0"), ("unlicense", "unlicense"), ("boost", "bsl 1 0"),
    ("zlib", "zlib"), ("artistic", "artistic 2 0"), ("cc0", "cc0 1 0"), ("cc-by", "cc by 4 0"), ("cc-by-sa", "cc by sa 4 0"), ("cc-by-nc", "cc by nc 4 0"),
]
MORE += [(label, f"spdx license identifier {name}", f"spdx license identifier {name}") for label, name in IDENTIFIERS]


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    key: tuple[str, ...]
    base: bool

    @property
    def key_at(self) -> int:
        return next(i for i in range(len(self.words)) if self.words[i : i + len(self.key)] == self.key)


TEMPLATES = [Template(label, tuple(words.split()), tuple(key.split()), base) for rows, base in ((BASE, True), (MORE, False)) for label, words, key in rows]
VOCABULARY = sorted({w for t in TEMPLATES for w in t.words})


def words(text: Column) -> Column:
    """All words of a text, A-Z as a-z."""
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)
    return F.filter(F.split(plain, _WORDLESS, -1), lambda w: w != "")


def rarity(docs: DataFrame, text: str = "text") -> dict[str, float]:
    """Inverse document frequency of the words of all templates, over all documents. One row per word of the templates reaches the driver."""
    vocabulary = F.array(*(F.lit(w) for w in VOCABULARY))
    # No word is empty: the empty one counts the documents.
    found = docs.select(F.explode(F.array_append(F.array_intersect(words(F.col(text)), vocabulary), F.lit(""))).alias("word")).groupBy("word").count()
    counts = {row.word: row["count"] for row in found.collect()}
    total = counts.get("", 0)
    return {w: math.log((1 + total) / (1 + counts.get(w, 0))) + 1e-9 for w in VOCABULARY}


def _postings(template: Template, rare: dict[str, float]) -> list[tuple[str, int]]:
    """The rarest words of the key phrase with their places in the template, rarest first."""
    return sorted(((w, template.key_at + i) for i, w in enumerate(template.key)), key=lambda x: (-rare[x[0]], x[1]))[:LOOKED_UP]


def _listed(values) -> str:
    """An array of words or numbers in SQL; words of templates are letters and digits."""
    return "array(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v!r}D" for v in values) + ")"


def _places(template: Template, rare: dict[str, float]) -> Column:
    """(label, start, score, base) of the places in `w` where the key phrase is verified; `hits` has the words that are looked up.

    Stated in SQL: one expression a template costs the driver far less than hundreds of column calls.
    """
    key_at, size = template.key_at, len(template.words)
    own = [f"transform(filter(hits, h -> h.word = '{word}'), h -> h.at - {at})" for word, at in _postings(template, rare)]
    starts = functools.reduce(lambda x, y: f"array_intersect({x}, {y})", own)
    # A longer passage may begin before the text does; its key phrase may not.
    stands = f"s + {key_at} >= 0 AND slice(w, greatest(s + {key_at}, 0) + 1, {len(template.key)}) = {_listed(template.key)}"
    total = sum(rare[w] for w in template.words)
    low, high = f"greatest(s + i - {SHIFT}, 0)", f"greatest(s + i + {SHIFT + 1}, 0)"
    found = f"array_contains(slice(w, {low} + 1, {high} - {low}), element_at({_listed(template.words)}, i + 1))"
    weight = f"element_at({_listed([rare[w] / total for w in template.words])}, i + 1)"
    score = f"least(1.0D, round(aggregate(sequence(0, {size - 1}), 0.0D, (sum, i) -> sum + if({found}, {weight}, 0.0D)), 9))"
    score = "1.0D" if template.words == template.key else score
    placed = f"transform(filter({starts}, s -> {stands}), s -> named_struct('label', '{template.label}', 'start', bigint(s + {key_at}), 'score', {score}, 'base', {str(template.base).lower()}))"
    return F.expr(placed if template.base else f"filter({placed}, p -> p.score >= {LEAST}D)")


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with n_words, n_base, first_word, last_word, base_labels, labels, score and `places` (label, start of the key phrase, score)."""
    rare = rarity(docs, text)
    postings = [[w for w, _ in _postings(t, rare)] for t in TEMPLATES]
    looked_up = sorted({w for own in postings for w in own})
    results = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"]
    names = [c for c in docs.columns if c not in results]
    rows = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(names)), words(F.col(text)).alias("w"))
    rows = rows.withColumn("own", F.array_intersect("w", F.array(*(F.lit(w) for w in looked_up))))
    rows = rows.withColumn("held", F.expr("array(" + ", ".join(" AND ".join(f"array_contains(own, '{w}')" for w in words_) for words_ in postings) + ")"))
    located = F.filter(F.transform("w", lambda x, i: F.struct(x.alias("word"), i.alias("at"))), lambda h: h["word"].isin(looked_up))
    # Only files that hold all postings of some template have hits.
    rows = rows.withColumn("hits", F.when(F.array_contains("held", True), located).otherwise(F.array().cast("array<struct<word:string,at:int>>")))
    rows = rows.withColumns({f"p{i}": F.when(F.get("held", F.lit(i)), _places(template, rare)) for i, template in enumerate(TEMPLATES)})
    places = F.flatten(F.array(*(F.coalesce(f"p{i}", F.array().cast("array<struct<label:string,start:bigint,score:double,base:boolean>>")) for i in range(len(TEMPLATES)))))
    rows = rows.select(*(F.col(f"c{i}") for i in range(len(names))), F.size("w").cast("long").alias("n_words"), places.alias("places"))
    rows = rows.withColumn("base", F.filter("places", lambda p: p["base"]))
    joined = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda p: p["label"]))), ",")
    starts = F.transform("base", lambda p: p["start"])
    return rows.select(
        *(F.col(f"c{i}").alias(c) for i, c in enumerate(names)),
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(F.col("base")).alias("base_labels"),
        joined(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["score"])), F.lit(0.0)).alias("score"),
        "places",
    )
