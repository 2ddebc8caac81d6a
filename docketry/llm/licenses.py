"""License scans with DataFrame functions only: a positional index of rare words.

Templates are short license texts with a mandatory key phrase. Document frequencies of
the templates' words, over all documents, order them by rarity. Per file, the places of
the rarest word of each key phrase are looked up; a place stands where the phrase's other
words are at their relative positions. From there the template's own rare words are
looked up at their positions relative to the phrase, and the share that is in place is
the score.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values. label: (is a base phrase, key phrase, words after the key phrase)
BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
TEMPLATES = {
    "apache2": ("apache license version 2 0", ""),
    "gpl3": ("gnu general public license version 3", ""),
    "gpl2": ("gnu general public license version 2", ""),
    "lgpl": ("gnu lesser general public license", ""),
    "agpl": ("gnu affero general public license", ""),
    "cc-by-nc": ("cc by nc 4 0", ""),
    "cc-by": ("cc by 4 0", ""),
    "cc-by-sa": ("cc by sa 4 0", ""),
    "mpl": ("mozilla public license", "version 2 0"),
    "isc": ("permission to use copy modify and or distribute this software", "for any purpose with or without fee is hereby granted"),
    "mit-text": ("permission is hereby granted free of charge", "to any person obtaining a copy of this software and associated documentation files"),
    "bsd": ("redistribution and use in source and binary forms", "with or without modification are permitted provided that the following conditions are met"),
    "apache-text": ("licensed under the apache license", "version 2 0 the license you may not use this file except in compliance with the license"),
}
#: Share of a template's further words that must stand in place for its label.
ENOUGH = 0.5

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words after A-Z are lower-cased; null text has none."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def template_words() -> list[str]:
    phrases = [*BASE.values(), *(" ".join(t) for t in TEMPLATES.values())]
    return sorted({w for p in phrases for w in p.split()})


def word_weights(documents: DataFrame, text: str = "text") -> dict[str, float]:
    """Inverse document frequency of each template word over all documents.

    The result has a row per template word at most. Documents without any word of a key
    phrase are counted, but not split into words.
    """
    vocabulary = template_words()
    found = documents.select(F.array_distinct(F.array_intersect(words_of(F.col(text)), _strings(vocabulary))).alias("found"))
    counted = found.select(F.explode(F.array_append(F.col("found"), F.lit(""))).alias("word")).groupBy("word").count()
    counts = {r["word"]: r["count"] for r in counted.collect()}
    total = counts.pop("", 0)
    return {w: math.log((1 + total) / (1 + counts.get(w, 0))) for w in vocabulary}


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def scan_licenses(documents: DataFrame, weights: dict[str, float], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, one row
    for each row of `documents`.

    n_base counts all places of base phrases, overlapping ones too; first_word and
    last_word are their smallest and largest start. `labels` adds those templates whose key
    phrase stands somewhere and of whose further words at least half stand in place behind
    it. `score` is the largest such share (1 for a phrase without further words), 0 without
    a phrase. Null and empty texts have no words; ties need no rule, as all places count;
    repeated rows and null ids stay; other columns are left out; no rows give no rows.
    """
    phrases = {**{k: (v, "") for k, v in BASE.items()}, **TEMPLATES}
    split = {label: (key.split(), more.split()) for label, (key, more) in phrases.items()}
    # Of each key phrase the word that is rarest in the documents, by its place in it.
    anchor = {label: max(range(len(key)), key=lambda i: (weights.get(key[i], 0.0), -i)) for label, (key, _) in split.items()}
    anchors = sorted({split[label][0][i] for label, i in anchor.items()})

    def places(label: str) -> Column:
        key, at = split[label][0], anchor[label]

        def stands(p: Column) -> Column:
            # F.get gives null outside of the array.
            tests = [F.get(F.col("words"), p + (i - at)) == w for i, w in enumerate(key)]
            all_of = tests[at]
            for i, test in enumerate(tests):
                if i != at:
                    all_of = all_of & test
            return (p >= at) & F.coalesce(all_of, F.lit(False))

        return F.transform(F.filter(F.col("spots"), stands), lambda p: p - at)

    def share(label: str) -> Column:
        """The largest share of further words in place over the key phrase's places; 0 without one."""
        key, more = split[label]
        if not more:
            return F.when(F.size(label) > 0, F.lit(1.0)).otherwise(F.lit(0.0))
        rare = sorted(range(len(more)), key=lambda i: (-weights.get(more[i], 0.0), i))

        def in_place(p: Column) -> Column:
            hits = [F.when(F.get(F.col("words"), p + (len(key) + i)) == more[i], 1).otherwise(0) for i in rare]
            total = hits[0]
            for h in hits[1:]:
                total = total + h
            return total / F.lit(float(len(more)))

        return F.coalesce(F.array_max(F.transform(F.col(label), in_place)), F.lit(0.0))

    words = documents.select(F.col(doc_id).alias("doc_id"), words_of(F.col(text)).alias("words"))
    spots = F.when(
        F.arrays_overlap("words", _strings(anchors)),
        F.array_compact(F.transform("words", lambda w, i: F.when(w.isin(anchors), i))),
    ).otherwise(F.array().cast("array<int>"))
    found = words.withColumn("spots", spots).select("doc_id", "words", "spots", *(places(k).alias(k) for k in split))
    found = found.select("doc_id", "words", *split, *(share(k).alias(f"{k} share") for k in TEMPLATES))
    base = F.concat(*(F.col(k) for k in BASE))
    named = [F.when(F.size(k) > 0, F.lit(k)) for k in BASE]
    more = [F.when(F.col(f"`{k} share`") >= ENOUGH, F.lit(k)) for k in TEMPLATES]
    joined = lambda labels: F.array_join(F.sort_array(F.array_compact(F.array(*labels))), ",")
    return found.select(
        "doc_id",
        F.size("words").cast("bigint").alias("n_words"),
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(base).cast("bigint").alias("first_word"),
        F.array_max(base).cast("bigint").alias("last_word"),
        joined(named).alias("base_labels"),
        joined(named + more).alias("labels"),
        F.greatest(F.when(F.size(base) > 0, 1.0).otherwise(0.0), *(F.col(f"`{k} share`") for k in TEMPLATES)).alias("score"),
    )
