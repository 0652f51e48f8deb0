"""License scan by a positional rare-token index, with DataFrame functions only.

Templates are the clauses of licence texts and the short names by which texts refer to them. The vocabulary of the templates is fixed
and small. One pass over every whole text keeps the positions of vocabulary words; the inverse document frequencies of those words
come from all rows. Each template is looked up by its rarest words, as many as hold more of its IDF weight than may be missing, so
that every alignment that can reach the threshold has one of them. A rare word at position p that a template holds at offset r points
to the alignment p - r; these are intersected with the alignments of the template's mandatory key phrase, which stands word by word.
Where any is left, all words of the template vote with their IDF, and the votes are summed by alignment. A template is a label if
enough of its weight agrees on an alignment with the key phrase. Everything after the first pass is local to a row, so that no key can be hot.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, staged

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Phrases whose every place counts, and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Fixed values: (label, clause or name, mandatory key phrase, which tells the licence from others of like wording).
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "hereby granted"),
    ("mit", "of this software and associated documentation files the software to deal in the software without restriction", "associated documentation files"),
    ("mit", "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "without limitation"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "permission notice shall"),
    ("apache", "licensed under the apache license version", "apache license"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "applicable law"),
    ("gpl", "gnu general public license", "general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license"),
    ("gpl", "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", "gnu general public license"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lesser general public license"),
    ("agpl", "gnu affero general public license", "affero general public license"),
    ("bsd", "redistribution and use in source and binary forms", "binary forms"),
    ("bsd", "with or without modification are permitted provided that the following conditions are met", "without modification"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "code must retain"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", "binary form must reproduce"),
    ("bsd", "may be used to endorse or promote products derived from this software without specific prior written permission", "prior written permission"),
    ("isc", "isc license", "isc license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "hereby granted"),
    ("mpl", "mozilla public license", "mozilla public license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", "mozilla public license"),
    ("epl", "eclipse public license", "eclipse public license"),
    ("cc-by", "creative commons attribution", "creative commons attribution"),
    ("cc-by", "licensed under cc by", "licensed under"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released"),
    ("unlicense", "either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "compiled binary"),
    ("zlib", "in no event will the authors be held liable for any damages arising from the use of this software", "held liable"),
    ("zlib", "including commercial applications and to alter it and redistribute it freely subject to the following restrictions", "redistribute"),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", "misrepresented"),
)
SHORT = 4  # template words of fewer letters keep their place but are not looked up, unless a base or key phrase holds them or the template has up to NAME words
NAME = 4
LEAST = 0.8  # share of a template's IDF weight that has to agree


def searched(template: str, key: str) -> list[tuple[str, int]]:
    """(word, offset) of the template's words that vote."""
    words = template.split()
    return [(w, i) for i, w in enumerate(words) if len(w) >= SHORT or w in key.split() or len(words) <= NAME]


def vocabulary() -> list[str]:
    return sorted({w for p, _ in BASE for w in p.split()} | {w for _, t, k in TEMPLATES for w in k.split() + [w for w, _ in searched(t, k)]})


def index_words(own: list[tuple[str, int]], idf: dict[str, float], least: float) -> list[tuple[str, int]]:
    """The rarest of a template's words, as few as hold more of its weight than an alignment with a share of `least` may lack."""
    out, left = [], sum(idf[w] for w, _ in own) * (1 - least) + 1e-6
    for w, i in sorted(own, key=lambda x: (-idf[x[0]], x)):
        if left >= 0:
            out.append((w, i))
            left -= idf[w]
    return out


def _places(phrase: str) -> str:
    """SQL: first positions of the places where all words of a phrase stand consecutively."""
    starts = [f"transform(filter(hits, h -> h.w = '{w}'), h -> h.p - {i})" for i, w in enumerate(phrase.split())]
    out = starts[0]
    for x in starts[1:]:
        out = f"array_intersect({out}, {x})"
    return out


def _aligned(template: str, key: str, idf: dict[str, float], least: float) -> str:
    """SQL: the largest share of the template's IDF weight that agrees on one alignment with the key phrase in its place and an index
    word in its own; 0 without such an alignment. Votes are sorted by alignment and summed in one pass."""
    words, phrase = template.split(), key.split()
    first = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
    own = searched(template, key)
    weight = sum(idf[w] for w, _ in own)
    rare = index_words(own, idf, least)
    # Postings of the template: word -> its offsets. Of an alignment, the key phrase comes first, then index words, then the others.
    postings: dict[str, list[str]] = {}
    for w, i in own:
        postings.setdefault(w, []).append(f"named_struct('offset', {i}, 'kind', {1 if (w, i) in rare else 2}, 'idf', {idf[w]!r}D)")
    table = "map(" + ", ".join(f"'{w}', array({', '.join(x)})" for w, x in postings.items()) + ")"
    listed = lambda some: ", ".join(f"'{w}'" for w in sorted(set(some)))
    pointed = f"""transform(filter(hits, h -> h.w IN ({listed(postings)})),
        h -> transform({table}[h.w], x -> named_struct('at', h.p - x.offset, 'kind', x.kind, 'idf', x.idf)))"""
    keyed = f"transform({_places(key)}, p -> named_struct('at', p - {first}, 'kind', 0, 'idf', 0D))"
    same = "coalesce(acc.at = x.at, false)"
    got = f"(IF({same}, acc.got, 0D) + x.idf)"
    # 0: no key phrase here; 1: the key phrase; 2: an index word too.
    stands = f"(CASE WHEN x.kind = 0 THEN 1 WHEN NOT {same} OR acc.stands = 0 THEN 0 WHEN x.kind = 1 THEN 2 ELSE acc.stands END)"
    # Rounded, so that a whole template is 1 whatever the order of additions.
    share = f"greatest(acc.share, IF({stands} = 2, round({got} / {weight!r}D, 9), 0D))"
    # The words present decide for most rows; only where they allow a label are positions looked at.
    some = " AND ".join([f"array_contains(present, '{w}')" for w in phrase] + [f"arrays_overlap(present, array({listed(w for w, _ in rare)}))"])
    return f"""CASE WHEN {some} THEN aggregate(array_sort(concat({keyed}, flatten({pointed}))),
        named_struct('at', CAST(NULL AS INT), 'got', 0D, 'stands', 0, 'share', 0D),
        (acc, x) -> named_struct('at', x.at, 'got', {got}, 'stands', {stands}, 'share', {share}), acc -> acc.share) ELSE 0D END"""


def license_scan(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """One row per row of `docs` (doc_id, text): n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null and empty texts have no words, empty labels and score 0. Repeated rows give repeated results, a null doc_id stays null,
    other columns are ignored, an empty table gives no rows. score is the best template's share of IDF weight that agrees on an
    alignment with its key phrase, 0 without one, and 1 where a base phrase stands; labels are templates with a share of `least`.
    """
    words = F.regexp_extract_all(lower_ascii(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit(WORD), 0)
    vocab = vocabulary()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words.alias("words")).select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.filter(F.transform("words", lambda w, i: F.struct(i.alias("p"), w.alias("w"))), lambda x: x.w.isin(vocab)).alias("hits"),
    )
    rows = staged(rows.withColumn("present", F.array_distinct(F.col("hits.w"))), "hits")
    # At most one row per vocabulary word.
    seen = rows.select(F.explode("present").alias("w")).groupBy("w").count().collect()
    total, seen = rows.count(), {r.w: r["count"] for r in seen}
    idf = {w: math.log((total + 1) / (seen.get(w, 0) + 1)) + 1e-3 for w in vocab}

    places = [F.expr(_places(phrase)).alias(f"b{i}") for i, (phrase, _) in enumerate(BASE)]
    aligned, found = [], []
    for i, (label, template, key) in enumerate(TEMPLATES):
        aligned.append(F.expr(_aligned(template, key, idf, least)).alias(f"t{i}"))
        found.append((label, F.col(f"t{i}") >= least, F.col(f"t{i}")))
    some = rows.where(F.size("hits") > 0).select("doc_id", "n_words", *places, *aligned)
    base = F.concat(*(F.col(f"b{i}") for i in range(len(BASE))))
    base_labels = [F.when(F.size(f"b{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(BASE)]
    own_labels = [F.when(ok, F.lit(label)) for label, ok, _ in found]
    joined = lambda cols: F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*cols)))), ",")
    score = F.when(F.size(base) > 0, F.lit(1.0)).otherwise(F.least(F.greatest(*(s for _, _, s in found)), F.lit(1.0)))
    some = some.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base).cast("long").alias("first_word"),
        F.array_max(base).cast("long").alias("last_word"),
        joined(base_labels).alias("base_labels"),
        joined(base_labels + own_labels).alias("labels"),
        score.alias("score"),
    )
    none = rows.where(F.size("hits") == 0).selectExpr("doc_id", "n_words", "0L n_base", "cast(null as long) first_word", "cast(null as long) last_word", "'' base_labels", "'' labels", "0D score")
    return some.unionByName(none)
