"""Operator 8: license scan by exact phrases and an exact set-similarity join of text blocks with license templates."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Words of the scan: what is left of ASCII after removing all but digits and lower-case letters, and every other character.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Template sentences whose token sets are looked for, with the label that each gives.
TEMPLATES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("unless required by applicable law or agreed to in writing software distributed under the license", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("creative commons attribution noncommercial 4 0 international", "cc-by-nc"),
    ("creative commons attribution sharealike 4 0 international", "cc-by-sa"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("gnu affero general public license as published by the free software foundation", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl-2"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
]
THRESHOLD = 0.8
#: A block is any run of so many words of the whole text (or the whole text, if it is shorter), across its lines.
BLOCK = 48


def _lower(text: Column) -> Column:
    """A-Z in lower case. Other letters may change too, but to letters that no ASCII word holds: the Kelvin sign, which would
    become a k, is replaced, and a dotted capital I keeps its dot."""
    return F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u00e9")))


def occurrences(docs: DataFrame, tokens: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of every row: row (a number of its own), the key, n_words, and occ, the places (p, word t) of the given tokens.

    The only pass over the texts. Splitting is several times as fast as extracting the words; it leaves an empty string
    before a text that begins with no word, and one behind a text that ends so.
    """
    parts, at = F.col("_parts"), F.col("_lead")
    rows = docs.select(F.col(key).alias("_key"), F.split(_lower(F.coalesce(F.col(text), F.lit(""))), BETWEEN).alias("_parts"))
    rows = rows.withColumn("_lead", F.when(F.get("_parts", F.lit(0)) == "", 1).otherwise(0))
    tail = F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    placed = F.transform(parts, lambda w, i: F.when(w.isin(tokens), F.struct((i - at).alias("p"), w.alias("t"))))
    return rows.select(F.monotonically_increasing_id().alias("_row"), "_key", (F.size(parts) - at - tail).cast("long").alias("n_words"), F.array_compact(placed).alias("occ"))


def token_order(found: DataFrame, tokens: list[str]) -> list[str]:
    """The given tokens, rarest first by the number of rows of occurrences() that hold them; ties by the token.

    Only counts of these tokens (a fixed list) reach the driver.
    """
    held = found.select(F.explode(F.array_distinct("occ.t")).alias("token"))
    count = {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count("*").alias("n")).collect()}
    return sorted(tokens, key=lambda t: (count.get(t, 0), t))


def _starts(phrase: str) -> Column:
    """Places in occ where the words of a phrase follow each other."""
    first, *rest = phrase.split()
    occ = F.col("occ")

    def begins(x: Column, j: Column) -> Column:
        same = x["t"] == first
        for k, w in enumerate(rest, 1):
            y = F.get(occ, j + k)
            same = same & (y["t"] == w) & (y["p"] == x["p"] + k)
        return F.coalesce(same, F.lit(False))

    return F.transform(F.filter(occ, begins), lambda x: x["p"])


def matches(found: DataFrame, templates: list[tuple[str, str]], threshold: float = THRESHOLD) -> DataFrame:
    """_row, label and share (of the template's distinct tokens) for each template and prefix occurrence with a block that matches."""
    sets = [(set(t.split()), label) for t, label in templates]
    rank = {w: i for i, w in enumerate(token_order(found, sorted(set().union(*[s for s, _ in sets]))))}
    index = []
    for s, label in sets:
        tokens, least = sorted(s, key=rank.get), ceil(threshold * len(s) - 1e-9)
        # If a block's rarest shared token is tokens[i], all that it shares are tokens[i:].
        index += [(w, label, tokens[i:], least, len(tokens)) for i, w in enumerate(tokens[: len(tokens) - least + 1])]
    literal = F.array(*[F.struct(F.lit(w).alias("token"), F.lit(label).alias("label"), F.array(*map(F.lit, rest)).alias("rest"), F.lit(least).alias("least"), F.lit(n).alias("n")) for w, label, rest, least, n in index])
    probe = F.broadcast(found.sparkSession.range(1).select(F.inline(literal)))  # prefixes of the given templates, no more
    occ = F.col("occ")
    at = F.filter(F.transform(occ, lambda x, j: F.when(x["t"].isin(sorted({i[0] for i in index})), j)), lambda j: j.isNotNull())
    seen = found.where(F.size(at) > 0).select("_row", "occ", F.explode(at).alias("_j"))
    x = F.get(occ, F.col("_j"))
    around = F.filter(F.slice(occ, F.greatest(F.col("_j") - BLOCK + 2, F.lit(1)), F.lit(2 * BLOCK - 1)), lambda y: F.abs(y["p"] - F.get(F.col("occ"), F.col("_j"))["p"]) < BLOCK)
    near = seen.select("_row", x["t"].alias("token"), x["p"].alias("p"), around.alias("near")).join(probe, "token")
    able = near.where(F.size("near") >= F.col("least")).where(F.size(F.array_intersect("near.t", "rest")) >= F.col("least"))

    def overlap(start: Column) -> Column:
        block = F.filter(F.col("near"), lambda y: (y["p"] >= start["p"]) & (y["p"] < start["p"] + BLOCK))
        return F.size(F.array_intersect(F.transform(block, lambda y: y["t"]), F.col("rest")))

    best = F.array_max(F.transform(F.filter(F.col("near"), lambda y: y["p"] <= F.col("p")), overlap))
    return able.withColumn("_best", best).where(F.col("_best") >= F.col("least")).select("_row", "label", (F.col("_best") / F.col("n")).alias("share"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Finds license phrases and license templates in every whole text.

    Base: all places where a phrase's words stand consecutively. Method: an exact set-similarity join of the text's
    blocks with the templates. A block (any run of BLOCK words) matches a template if it holds at least `threshold` of
    the template's distinct tokens. Tokens are ordered by their document frequency in the whole corpus; a template's
    prefix is its rarest tokens, so many that a match must hold one of them. One pass over the texts notes the places of
    the templates' and phrases' words in a table in the shared folder; places of prefix tokens are joined with the
    inverted index of the templates' prefixes. A pair goes on if enough words of the templates stand around (length
    filter) and enough of them are tokens of the template behind the shared one (positional filter); then the exact
    overlap of every block through that place is counted. Only labels and shares by row are shuffled.

    Returns key, n_words, n_base, first_word, last_word, base_labels, labels and score (the best containment of a match,
    1.0 for a base phrase, 0.0 for none). A null or empty text has no words and no labels; null keys and repeated rows
    are kept as they are; an empty table gives an empty result; other columns of docs are ignored.
    """
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
    tokens = sorted({w for t in (*phrases, *(t for t, _ in templates)) for w in t.split()})
    found = written(occurrences(docs, tokens, key, text), "license")
    more = matches(found, templates, threshold).groupBy("_row").agg(F.collect_set("label").alias("_more"), F.max("share").alias("_share"))
    rows = found.select("_row", "_key", "n_words", *[_starts(p).alias(f"_at{k}") for k, p in enumerate(phrases)])
    places = F.concat(*[F.col(f"_at{k}") for k in range(len(phrases))])
    base = F.array_compact(F.array(*[F.when(F.size(f"_at{k}") > 0, F.lit(label)) for k, label in enumerate(phrases.values())]))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return rows.join(more, "_row", "left").select(
        F.col("_key").alias(key),
        "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, F.coalesce("_more", F.array().cast("array<string>")))).alias("labels"),
        F.greatest(F.lit(0.0), F.when(F.size(places) > 0, F.lit(1.0)), F.col("_share")).alias("score"),
    )
