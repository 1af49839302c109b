"""Column expressions over text: normalising, cleaning, packing, similarity, tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any script, for trimming.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: What ends a line besides the newline.
LINE_ENDS = r"\r\n|[\r\x0B\x0C\x1C-\x1E\u0085  ]"
CJK = "[一-鿿]"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def normalise(c: Column) -> Column:
    """Drops one leading byte order mark; CRLF and CR become LF."""
    return F.regexp_replace(F.regexp_replace(c, "^﻿", ""), r"\r\n?", "\n")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once a row, however often use refers to it and in whatever loop."""
    return F.element_at(F.transform(F.array(value), use), 1)


def clean_body(c: Column) -> Column:
    """Strips white space at line ends, leaves at most one blank line in a row, strips the whole."""
    lines = F.regexp_replace(c, LINE_ENDS, "\n")
    # A run of white space is looked at from its start only, so long runs take linear time.
    return strip(F.regexp_replace(F.regexp_replace(lines, r"(?U)(?<![\s&&[^\n]])[\s&&[^\n]]++(?=\n|\z)", ""), r"\n{3,}", "\n\n"))


def clean_title(c: Column) -> Column:
    """A section title without one leading number; the raw title if nothing else is left."""
    short = strip(F.regexp_replace(strip(c), r"^[0-9]+\s*[.、]\s*", ""))
    return F.when(short == "", strip(c)).otherwise(short)


def pack_blocks(body: Column, limit: int) -> Column:
    """Pieces of a body: itself up to `limit` characters, else blocks between blank lines, packed greedily and never cut.

    A block costs its length and 2; a block longer than the limit is a piece of its own.
    """
    blocks = F.filter(F.split(body, r"\n\s*\n"), lambda b: strip(b) != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("n"))

    def add(acc: Column, b: Column) -> Column:
        full = (acc["n"] > 0) & (acc["n"] + F.length(b) + 2 > limit)
        joined = F.when(acc["n"] == 0, b).otherwise(F.concat(acc["now"], F.lit("\n\n"), b))
        return F.struct(
            F.when(full, F.array_append(acc["done"], acc["now"])).otherwise(acc["done"]).alias("done"),
            F.when(full, b).otherwise(joined).alias("now"),
            (F.when(full, 0).otherwise(acc["n"]) + F.length(b) + 2).alias("n"),
        )

    packed = F.aggregate(blocks, start, add, lambda a: F.when(a["n"] > 0, F.array_append(a["done"], a["now"])).otherwise(a["done"]))
    return F.when(F.length(body) <= limit, F.array(body)).otherwise(packed)


def token_estimate(c: Column) -> Column:
    """One token for each CJK character and 1.3 for each other word, rounded half to even."""
    words = F.regexp_count(c, F.lit("[A-Za-z0-9_]+"))
    return (F.regexp_count(c, F.lit(CJK)) + F.rint(words * F.lit(1.3))).cast("long")


def distinct_words(c: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(c), r"[^\p{L}\p{N}]+")), lambda w: w != "")


def _grams(words: Column) -> Column:
    long = F.filter(words, lambda w: F.length(w) > 2)
    return F.array_distinct(F.flatten(F.transform(long, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def trigrams(c: Column) -> Column:
    """Distinct trigrams of the words of lower-cased text; a word is padded with two spaces before and one behind."""
    return _grams(F.transform(distinct_words(c), lambda w: F.concat(F.lit("  "), w, F.lit(" "))))


def inner_trigrams(c: Column) -> Column:
    """Distinct trigrams inside the words of lower-cased text: every text that holds this one has them among its trigrams."""
    return _grams(distinct_words(c))


def set_similarity(a: Column, b: Column) -> Column:
    """Shared elements over all elements of two sets; 0 for two empty ones."""
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce(shared / F.nullif(F.size(a) + F.size(b) - shared, F.lit(0)), F.lit(0.0))


def trigram_similarity(a: Column, b: Column) -> Column:
    return set_similarity(trigrams(a), trigrams(b))


def contains_literal(text: Column, term: Column) -> Column:
    """Whether text holds term, in any case; no character is a wildcard."""
    return F.contains(F.lower(text), F.lower(term))


def distinct_terms(terms: Column, most: int | None = None, longest: int | None = None) -> Column:
    """Trimmed terms without blanks (and without too long ones), the first form of each in any case, `most` at most.

    Case is compared by lower(), which keeps a sharp s and a final sigma apart from their folded forms.
    """
    kept = F.filter(F.transform(F.coalesce(terms, F.array().cast("array<string>")), strip), lambda t: t.isNotNull() & (t != "") & ((F.length(t) <= longest) if longest else F.lit(True)))
    # Sorted by form and place, a term is the first of its form if the one before it has another: no term is compared with all.
    placed = F.sort_array(F.transform(kept, lambda t, i: F.struct(F.lower(t).alias("low"), i.alias("place"), t.alias("term"))))
    first = let(placed, lambda all_: F.filter(all_, lambda x, i: (i == 0) | (F.get(all_, i - 1)["low"] != x["low"])))
    ordered = F.transform(F.sort_array(F.transform(first, lambda x: F.struct(x["place"], x["term"]))), lambda x: x["term"])
    return F.slice(ordered, 1, most) if most is not None else ordered


def redact(c: Column) -> Column:
    """SQL statements, from their first keyword to the end of the line, become [redacted]."""
    return F.regexp_replace(c, r"(?i)\b(?:select|insert|update|delete|drop|alter|create|truncate)\b[^\n]*", "[redacted]")


def mask(c: Column, secret: str) -> Column:
    """Every literal occurrence of a secret becomes ***."""
    return F.replace(c, F.lit(secret), F.lit("***")) if secret else c


def preview(c: Column, n: int = 120) -> Column:
    """Text with runs of white space as one space, cut at n characters with an ellipsis."""
    flat = strip(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n), F.lit("…"))).otherwise(flat)
