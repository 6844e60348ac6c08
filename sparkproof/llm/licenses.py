"""License scans: an exact set-similarity join of text blocks with license templates, in SQL functions.

A template's tokens are a set; a block of words meets it if it holds at least `THRESHOLD` of that set. All
tokens of templates are ordered by the number of documents that hold them, rarest first. By the prefix
principle a template of n tokens that needs m of them is met only by blocks that hold one of its first
n - m + 1. Documents without any such token are done after one look; of the others only the blocks around
such tokens are compared, behind a length and a positional filter.

Templates are a parameter, so their side is small by construction: each row looks itself up and nothing
is shuffled but the token counts. The base phrases are templates that must be met whole, with prefix
one; their candidates are then compared word by word.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkproof.functions.text import let

#: Share of a template's distinct words that a block must hold.
THRESHOLD = 0.9
# Phrases and labels of the base, then notices of common licenses.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = {
    "mit": ["released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"],
    "apache-2.0": ["licensed under the apache license version 2 0"],
    "gpl-3.0": ["licensed under the gnu general public license version 3"],
    "gpl-2.0": ["licensed under the gnu general public license version 2"],
    "lgpl": ["licensed under the gnu lesser general public license"],
    "mpl-2.0": ["subject to the terms of the mozilla public license v 2 0"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted"],
    "cc-by-4.0": ["licensed under a creative commons attribution 4 0 international license"],
    "cc-by-nc-4.0": ["licensed under cc by nc 4 0", "licensed under a creative commons attribution noncommercial 4 0 license"],
    "cc-by-sa-4.0": ["licensed under cc by sa 4 0", "licensed under a creative commons attribution sharealike 4 0 license"],
    "cc0-1.0": ["dedicated to the public domain under cc0 1 0"],
}
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Its small letter is an ASCII k, which the contract's lower case must not give.
KELVIN = "K"


def word_array(text: Column) -> Column:
    """Words of a text; those made of ASCII are in lower case. Null gives none."""
    lower = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(KELVIN), F.lit("Å")))
    return F.array_remove(F.split(lower, SEPARATORS, -1), "")


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def token_order(words: DataFrame, tokens: list[str]) -> list[str]:
    """Tokens by the number of rows that hold them, then by name. One count for each token of a template."""
    held = words.select(F.explode(F.array_intersect("words", strings(tokens))).alias("token"))
    counts = {r["token"]: r["count"] for r in held.groupBy("token").count().collect()}
    return sorted(tokens, key=lambda t: (counts.get(t, 0), t))


def scan(
    docs: DataFrame,
    templates: dict[str, list[str]] = TEMPLATES,
    base: dict[str, str] = BASE,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Places of the base phrases and labels of all templates met by some block of a document.

    Input: doc_id, text; other columns are ignored. Null and empty texts have no words, no places and
    score 0. Repeated rows give repeated rows, an empty table none. A block is 2m words from a multiple
    of m, m being the longest template's length, so every run of m words lies in one. Output: doc_id,
    n_words, n_base, first_word, last_word, base_labels, labels, score (the largest share of a template
    that met its threshold; 1 where a base phrase stands)."""
    notices = [(label, text.split()) for label, texts in templates.items() for text in texts]
    longest = max(len(words) for _, words in notices)
    tokens = sorted({w for _, words in notices for w in words} | {w for phrase in base for w in phrase.split()})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), word_array(F.col("text")).alias("words"))
    order = token_order(rows, tokens)
    rank = {t: i for i, t in enumerate(order)}

    sets, prefixes = [], set()
    for label, words in notices:
        held = sorted(set(words), key=rank.get)
        need = ceil(threshold * len(held) - 1e-9)
        sets.append((label, need, held, held[: len(held) - need + 1]))
        prefixes.update(sets[-1][3])
    phrases = []
    for phrase, label in base.items():
        words = phrase.split()
        at = min(range(len(words)), key=lambda i: rank[words[i]])
        phrases.append((label, words, at))
        prefixes.add(words[at])
    rare = sorted(prefixes, key=rank.get)
    known = F.array(*[
        F.struct(F.lit(label).alias("label"), F.lit(need).alias("need"), strings(held).alias("tokens"), strings(prefix).alias("prefix"))
        for label, need, held, prefix in sets
    ])

    words, at = F.col("words"), F.col("at")

    def met(block: Column) -> Column:
        """Templates that a block of ordered tokens meets, with the share that it holds."""

        def candidate(t: Column) -> Column:
            first = F.get(F.array_intersect(t["prefix"], block), 0)
            left = F.least(
                F.size(t["tokens"]) - F.array_position(t["tokens"], first),
                F.size(block) - F.array_position(block, first),
            )
            return (F.size(block) >= t["need"]) & F.arrays_overlap(t["prefix"], block) & (left + 1 >= t["need"])

        def share(t: Column) -> Column:
            n = F.size(F.array_intersect(t["tokens"], block))
            return F.struct(t["label"].alias("label"), (n / F.size(t["tokens"])).alias("share"), (n >= t["need"]).alias("whole"))

        return F.filter(F.transform(F.filter(known, candidate), share), lambda m: m["whole"])

    blocks = F.filter(
        F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(F.floor(i / longest) - 1, F.floor(i / longest))))),
        lambda b: b >= 0,
    )
    in_block = F.transform(
        blocks,
        # The order of all tokens, met with the block's words, gives its tokens in that order.
        lambda b: F.array_intersect(strings(order), F.slice(words, (b * longest + 1).cast("int"), 2 * longest)),
    )

    def starts(phrase: list[str], prefix: int) -> Column:
        found = F.filter(
            at,
            lambda i: (F.get(words, i) == phrase[prefix])
            & (i >= prefix)
            & (F.slice(words, F.greatest(i - prefix + 1, F.lit(1)), len(phrase)) == strings(phrase)),
        )
        return F.transform(found, lambda i: i - prefix)

    places = F.array(*[
        F.struct(F.lit(label).alias("label"), starts(phrase, prefix).alias("starts")) for label, phrase, prefix in phrases
    ])
    none = F.array().cast("array<int>")
    looked = (
        rows.withColumn(
            "at",
            F.when(
                F.arrays_overlap("words", strings(rare)),
                F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get(words, i).isin(rare)),
            ).otherwise(none),
        )
        .withColumn("places", F.when(F.size("at") > 0, F.filter(places, lambda p: F.size(p["starts"]) > 0)))
        .withColumn("met", F.when(F.size("at") > 0, F.flatten(F.transform(in_block, lambda b: let(b, met)))))
        .select("doc_id", F.size("words").alias("n_words"), "places", "met")
        .withColumn("starts", F.flatten(F.transform("places", lambda p: p["starts"])))
        .withColumn("base", F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"]))))
    )
    added = F.transform("met", lambda m: m["label"])
    base_found = F.coalesce(F.size("base") > 0, F.lit(False))
    return looked.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce(F.when(F.size("starts") > 0, F.size("starts")), F.lit(0)).cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"),
        F.array_max("starts").cast("long").alias("last_word"),
        F.coalesce(F.array_join("base", ","), F.lit("")).alias("base_labels"),
        F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.concat("base", added))), ","), F.lit("")).alias("labels"),
        F.when(base_found, 1.0)
        .otherwise(F.coalesce(F.array_max(F.transform("met", lambda m: m["share"])), F.lit(0.0)))
        .alias("score"),
    )
