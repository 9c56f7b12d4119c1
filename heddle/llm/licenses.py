"""Licence scans with a positional rare-token index, on DataFrame and SQL functions only.

1. The vocabulary is the words of the licence templates.  One pass over the corpus counts in how many files each of
   these words stands (a table of at most one row per vocabulary word), which gives their inverse document frequency.
2. A file's licence words are looked up.  A template is open in a file if the file has all words of the template's
   mandatory phrases; of these words, the ``rare`` ones of highest IDF are what the file is searched for.
3. The index has the positions of these words in their templates.  A posting at template position p for a word at file
   position i says that the template may start at i - p.  The starts of all of a template's postings are intersected:
   sorted, a start that each posting proposes stands there as often as there are postings.
4. A start counts if every mandatory key phrase of the template stands, word by word, where the start puts it.

All of that happens inside one row with array functions, so files are never shuffled.  The work is linear in a file's
words, but for the sort of the starts; a file without an open template, the usual case, ends after the look-up.

Labels: those of the base phrases, and the templates' own.  The score is the largest share of a labelled template's
words that stand in place (1 for a base phrase), 0 without any label.

Defined results: a null text is empty (no words, no labels, score 0); repeated rows are scanned each; only the id and
text columns are read; for an empty table the IDF of every word is equal and the result is empty.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words: every ASCII character but digits and letters (lower-cased before).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...]
    base: bool = False


#: Phrases and the labels they give.
BASE = (
    Template("cc-by", "cc by", ("cc by",), True),
    Template("gpl", "general public license", ("general public license",), True),
    Template("reserved", "all rights reserved", ("all rights reserved",), True),
)
#: Opening words of public licences and notices, each with the phrases that must be there.
TEMPLATES = BASE + (
    Template("agpl", "gnu affero general public license", ("affero general public license",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("artistic", "the artistic license 2 0", ("artistic license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("bsd", "licensed under the bsd license", ("bsd license",)),
    Template("bsl-1.0", "boost software license version 1 0", ("boost software license",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by", "creative commons attribution 4 0 international", ("creative commons attribution",)),
    Template("cc0", "cc0 1 0 universal", ("cc0 1 0",)),
    Template("epl", "eclipse public license", ("eclipse public license",)),
    Template("gpl-2.0", "gnu general public license version 2", ("general public license version 2",)),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("general public license version 3",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("distribute this software for any purpose",)),
    Template("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("hereby granted free of charge",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mpl", "mozilla public license version 2 0", ("mozilla public license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
)


def words_of(text: Column) -> Column:
    """A-Z lower-cased, cut at the separators; other letters stay as they are."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, SEPARATORS), lambda w: w != "")


def _text_array(words: list[str]) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


def idf(files: DataFrame, words_col: str, vocabulary: list[str]) -> dict[str, float]:
    """Of each vocabulary word over all files; what comes to the driver is one row per vocabulary word at most."""
    inside = F.array_distinct(F.filter(words_col, lambda w: w.isin(vocabulary)))
    counts = {r["word"]: r["n"] for r in files.select(F.explode(inside).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    return {w: -math.log1p(counts.get(w, 0)) for w in vocabulary}  # the corpus size adds the same to every word


def scan(files: DataFrame, templates: tuple[Template, ...] = TEMPLATES, rare: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_places) of every row."""
    texts = [t.text.split() for t in templates]
    read = files.select(F.col(id_col).alias("id"), words_of(F.col(text_col).cast("string")).alias("words"))
    weight = idf(read, "words", sorted({w for t in texts for w in t}))
    postings: dict[str, list[str]] = {}
    shapes, needs, counts = [], [], []
    for k, (template, text) in enumerate(zip(templates, texts, strict=True)):
        keys = []
        for key in template.keys:
            part = key.split()
            start = next(i for i in range(len(text)) if text[i : i + len(part)] == part)
            keys.append((start, len(part)))
        # the places of the mandatory words of highest IDF
        places = [i for s, n in keys for i in range(s, s + n)]
        rarest = sorted({text[i] for i in places}, key=lambda w: (-weight[w], w))[:rare]
        chosen = sorted({i for i in places if text[i] in rarest})
        for p in chosen:
            postings.setdefault(text[p], []).append(f"named_struct('t', {k}, 'p', {p})")
        counts.append(len(chosen))
        needs.append(_text_array(sorted({text[i] for i in places})))
        spots = ", ".join(f"named_struct('s', {s}, 'n', {n})" for s, n in keys)
        shapes.append(f"named_struct('label', '{template.label}', 'base', {str(template.base).lower()}, 'words', {_text_array(text)}, 'keys', array({spots}))")
    quoted = lambda some: ", ".join(f"'{w}'" for w in sorted(some))
    mandatory = {w for t in templates for key in t.keys for w in key.split()}
    index = "map(" + ", ".join(f"'{w}', array({', '.join(found)})" for w, found in postings.items()) + ")"
    shape = lambda t: f"element_at(array({', '.join(shapes)}), {t} + 1)"
    # a start is a number: template * 2^40 + start + 2^20; starts before the text are negative and fail the check
    steps = {
        "present": f"array_distinct(filter(words, w -> w IN ({quoted(mandatory)})))",
        "open": f"filter(transform(array({', '.join(needs)}), (n, t) -> IF(size(present) > 0 AND forall(n, w -> array_contains(present, w)), t, NULL)), t -> t IS NOT NULL)",
        "hits": f"IF(size(open) = 0, NULL, filter(transform(words, (w, i) -> IF(w IN ({quoted(postings)}), i, NULL)), i -> i IS NOT NULL))",
        "starts": f"sort_array(flatten(transform(hits, i -> transform(filter({index}[element_at(words, i + 1)], q -> array_contains(open, q.t)), q -> q.t * 1099511627776 + i - q.p + 1048576))))",
        "agreed": f"filter(starts, (c, i) -> (i = 0 OR get(starts, i - 1) <> c) AND get(starts, CAST(i + element_at(array({', '.join(map(str, counts))}), CAST(c DIV 1099511627776 AS INT) + 1) - 1 AS INT)) <=> c)",
        "places": "transform(agreed, c -> named_struct('t', CAST(c DIV 1099511627776 AS INT), 'o', CAST(c % 1099511627776 - 1048576 AS INT)))",
        "proven": f"filter(places, c -> forall({shape('c.t')}.keys, k -> IF(c.o + k.s < 0, false, slice(words, c.o + k.s + 1, k.n) = slice({shape('c.t')}.words, k.s + 1, k.n))))",
        "found": f"transform(proven, c -> named_struct('label', {shape('c.t')}.label, 'base', {shape('c.t')}.base, 'o', c.o, 'share', size(filter(transform({shape('c.t')}.words, (w, i) -> IF(c.o + i < 0, false, try_element_at(words, c.o + i + 1) <=> w)), m -> m)) / size({shape('c.t')}.words)))",
        "at": "transform(filter(found, c -> c.base), c -> c.o)",
    }
    some = read
    for name, step in steps.items():
        some = some.withColumn(name, F.expr(step))
    names = lambda array: F.coalesce(F.array_join(F.array_sort(F.array_distinct(array)), ","), F.lit(""))
    return some.select(
        F.col("id").alias(id_col), F.size("words").cast("long").alias("n_words"), F.when(F.col("at").isNull(), 0).otherwise(F.size("at")).cast("long").alias("n_base"),
        F.array_min("at").cast("long").alias("first_word"), F.array_max("at").cast("long").alias("last_word"),
        names(F.expr("transform(filter(found, c -> c.base), c -> c.label)")).alias("base_labels"), names(F.expr("transform(found, c -> c.label)")).alias("labels"),
        F.coalesce(F.expr("array_max(transform(found, c -> c.share))"), F.lit(0.0)).cast("double").alias("score"),
        F.when(F.col("found").isNull(), 0).otherwise(F.size("found")).cast("long").alias("n_places"),
    )
