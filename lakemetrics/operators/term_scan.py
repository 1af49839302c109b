"""Terms of a bounded table searched for in texts of any number: each task holds the terms and reads each text once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import texts as X
from . import questions
from .keyword_index import LEAST_SIMILARITY

#: Size of a table of terms that goes to every task.
TERM_BYTES = 32 << 20
#: Words whose trigrams a task keeps.
WORDS = 100_000
_SIMILAR = pa.list_(pa.struct([("term", pa.string()), ("similarity", pa.float64())]))


class TermScan:
    """A table of terms that texts are scanned for; nothing of the texts is stored or shuffled.

    Literal terms are found by one automaton. For similarity, the terms of each trigram are counted over the trigrams of
    a text, so a text costs its trigrams times the terms that have them.
    """

    def __init__(self, terms: DataFrame):
        found = terms.where(F.col("term").isNotNull()).select("term", X.trigrams(F.col("term")).alias("grams")).distinct().collect()
        self.terms = [r["term"] for r in found]
        self.grams = [(r["term"], r["grams"]) for r in found if r["grams"]]

    @classmethod
    def of(cls, terms: DataFrame) -> TermScan | None:
        """The scan for terms(term), or none if they exceed TERM_BYTES."""
        size = terms.agg(F.coalesce(F.sum(F.octet_length("term") + 16), F.lit(0)).alias("n")).head()["n"]
        return cls(terms) if size <= TERM_BYTES else None

    def contained(self, chunks: DataFrame, field: str) -> DataFrame:
        """chunks, a row for each term that the field holds in any case, with the term; an empty term is in every text."""
        rows = questions.find(chunks.where(F.col(field).isNotNull()), [("term", i, t) for i, t in enumerate(self.terms)], field, "_found")
        held = F.transform("_found", lambda w: w["word"])
        empty = F.array(F.lit("")) if "" in self.terms else F.array().cast("array<string>")
        return rows.withColumn("term", F.explode(F.concat(held, empty))).drop("_found")

    def similar(self, chunks: DataFrame, field: str = "search_text") -> DataFrame:
        """(term, chunk_id, similarity) of terms and texts that share LEAST_SIMILARITY of all their trigrams or more."""
        names, sizes = [t for t, _ in self.grams], np.array([len(g) for _, g in self.grams], dtype=np.int64)
        postings: dict[str, list[int]] = {}
        for i, (_, grams) in enumerate(self.grams):
            for g in grams:
                postings.setdefault(g, []).append(i)
        places = {g: np.array(p, dtype=np.int64) for g, p in postings.items()}

        least, most = (int(sizes.min() * LEAST_SIMILARITY), int(sizes.max() / LEAST_SIMILARITY) + 1) if names else (1, 0)

        def near(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            known: dict[str, list[str]] = {}  # trigrams of words, as X.trigrams has them
            for batch in batches:
                out = []
                for words in batch.to_pylist():
                    grams: set[str] = set()
                    for w in words or ():
                        if w not in known:
                            if len(known) >= WORDS:
                                known.clear()
                            known[w] = [f"  {w} "[i : i + 3] for i in range(len(w) + 1)]
                        grams.update(known[w])
                    met = [p for p in map(places.get, grams) if p is not None] if least <= len(grams) <= most else []
                    if not met:
                        out.append([])
                        continue
                    shared = np.bincount(np.concatenate(met), minlength=len(names))
                    similarity = shared / (sizes + len(grams) - shared)
                    out.append([{"term": names[i], "similarity": float(similarity[i])} for i in np.flatnonzero(similarity >= LEAST_SIMILARITY)])
                yield pa.array(out, _SIMILAR)

        words = chunks.select("chunk_id", X.distinct_words(F.col(field)).alias("_words"))
        found = words.select("chunk_id", F.explode(F.arrow_udf(near, "array<struct<term:string,similarity:double>>")("_words")).alias("_s"))
        return found.select("_s.term", "chunk_id", "_s.similarity")
