"""Operator 5: benchmark items inside documents, by size-partitioned MinHash containment search."""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rolling, through_pandas, word_hashes, word_spans

SHINGLE, CONTAINMENT = 5, 0.8
#: Bytes of items that are broadcast together (one longer item goes alone); a larger benchmark is searched for block by block.
BLOCK_BYTES = 16 << 20
#: Bins of a signature: so many for each shingle that a window of the class can hold, and never fewer than LEAST_BINS. A
#: contained shingle is lost only if a smaller hash falls into its bin, which happens to one in BINS_A_SHINGLE at most;
#: the item is lost only if that happens to all its contained shingles.
BINS_A_SHINGLE, LEAST_BINS = 16, 1 << 20


def shingles(text: str | None, k: int = SHINGLE) -> tuple[list[bytes], np.ndarray]:
    """The lower-cased words of a text, and the hash of each run of k of them."""
    data = text.lower().encode() if text else b""
    starts, ends = word_spans(data)
    if len(starts) < k:
        return [], np.empty(0, np.uint64)
    return data.split(), rolling(word_hashes(data, starts, ends), k)


def _strings(words: list[bytes], k: int) -> set[bytes]:
    return {b" ".join(w) for w in zip(*[words[i:] for i in range(k)])}


def size_class(n: int) -> int:
    """The power of two at or above a number of shingles: class c holds items of 2**(c - 1) + 1 to 2**c shingles."""
    return max(n - 1, 0).bit_length()


def bins(c: int) -> np.uint64:
    return np.uint64(max(LEAST_BINS, BINS_A_SHINGLE << (c + 1)))


def signature(hashes: np.ndarray, n_bins: np.uint64) -> np.ndarray:
    """One-permutation MinHash: the smallest hash in each bin that holds any, where a hash's bin is its remainder."""
    order = np.lexsort((hashes, hashes % n_bins))
    bin_ = hashes[order] % n_bins
    return hashes[order][np.concatenate(([True], bin_[1:] != bin_[:-1]))]


class Index:
    """Signatures of a block of items by size class, with the exact shingles to verify candidates by."""

    def __init__(self, items: list[tuple[object, str | None]], k: int):
        self.items: list[tuple[object, set[bytes]]] = []
        signatures: dict[int, list[tuple[np.ndarray, int]]] = {}
        for name, text in items:
            words, hashes = shingles(text, k)
            if not len(hashes):
                continue
            hashes = np.unique(hashes)
            c = size_class(len(hashes))
            signatures.setdefault(c, []).append((signature(hashes, bins(c)), len(self.items)))
            self.items.append((name, _strings(words, k)))
        self.classes = {}
        for c, found in signatures.items():
            values = np.concatenate([s for s, _ in found])
            owner = np.repeat([i for _, i in found], [len(s) for s, _ in found])
            order = np.argsort(values, kind="stable")
            self.classes[c] = (values[order], owner[order])
        self.any = np.unique(np.concatenate([v for v, _ in self.classes.values()])) if self.classes else np.empty(0, np.uint64)

    def candidates(self, hashes: np.ndarray) -> set[int]:
        """Items whose signature meets that of a window of their size class.

        Windows of class c have 2**(c + 1) shingles and start at every multiple of 2**c, so a run of 2**c lies in one.
        """
        out: set[int] = set()
        if not len(self.any) or not len(hashes):
            return out
        at = np.searchsorted(self.any, hashes)
        at[at == len(self.any)] = 0
        places = np.flatnonzero(self.any[at] == hashes)  # only these can meet an item's signature
        if not len(places):
            return out
        for c, (values, owner) in self.classes.items():
            step, n_bins = 1 << c, bins(c)
            low, high = np.searchsorted(values, hashes[places]), np.searchsorted(values, hashes[places], side="right")
            for p, a, b in zip(places[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist()):
                if out.issuperset(owners := owner[a:b].tolist()):
                    continue
                first = p // step
                for start in (first, first - 1) if first else (first,):
                    window = hashes[start * step : (start + 2) * step]
                    if not ((window % n_bins == hashes[p] % n_bins) & (window < hashes[p])).any():
                        out.update(owners)
                        break
        return out


def contained(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", k: int = SHINGLE, threshold: float = CONTAINMENT) -> DataFrame:
    """Pairs of a document and a benchmark item whose k-word shingles stand in the document to `threshold` or more.

    The items are partitioned by size. For each size class a document is cut into windows of about that size, so that a
    short item inside a long document still has a high resemblance to one of the windows; an item is a candidate if
    the MinHash signatures of both agree in some bin. Candidates are verified by the exact containment of the item's
    distinct shingles in the whole document. The benchmark is broadcast in blocks of BLOCK_BYTES, whose index is built in
    the tasks; documents are scanned once for each block and never shuffled.

    Returns key, item, n_shingles, n_found and containment. Words are lower-cased and cut at white space. Texts
    that are null, empty or shorter than k words have no shingles: such a document holds nothing, such an item is never
    found. Null keys and repeated rows are searched like any other; empty tables give an empty result; other columns of
    both tables are ignored.
    """
    spark = docs.sparkSession
    kinds = docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    sent_key, as_ = through_pandas(key, kinds[0])
    schema = f"`{key}` {as_}, `{item}` {kinds[1]}, n_shingles long, n_found long, containment double"
    rows = docs.select(sent_key.alias("key"), F.col(text).alias("text"))
    out = spark.createDataFrame([], schema)
    for sent in _sent(benchmark, item, text):
        out = out.unionByName(rows.mapInPandas(_search(sent, key, item, k, threshold), schema))
    return out.withColumn(key, F.col(key).cast(kinds[0]))


def _sent(benchmark: DataFrame, item: str, text: str) -> Iterator[Broadcast]:
    """Blocks of (item, text), each with a name of its own."""
    context = benchmark.sparkSession.sparkContext
    block, size = [], 0
    for name, body in benchmark.select(F.col(item), F.col(text)).toLocalIterator():
        if block and size + len(body or "") > BLOCK_BYTES:
            yield context.broadcast((uuid4().hex, block))
            block, size = [], 0
        block.append((name, body))
        size += len(body or "")
    if block:
        yield context.broadcast((uuid4().hex, block))


_built: dict[tuple[str, int], Index] = {}


def _index(sent: Broadcast, k: int) -> Index:
    """The index of a block, kept by the worker while its tasks ask for no other one."""
    name, items = sent.value
    if (name, k) not in _built:
        _built.clear()
        _built[name, k] = Index(items, k)
    return _built[name, k]


def _search(sent, key: str, item: str, k: int, threshold: float):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = _index(sent, k)
        for pdf in batches:
            found = [
                (None if pd.isna(name) else name, which, wanted, n, n / wanted)
                for name, text in zip(pdf["key"], pdf["text"])
                for which, wanted, n in _held(index, text, k, threshold)
            ]
            yield pd.DataFrame(found, columns=[key, item, "n_shingles", "n_found", "containment"])

    return search


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", k: int = SHINGLE, threshold: float = CONTAINMENT) -> DataFrame:
    """The rows of docs that hold no benchmark item (see contained()), with all their columns; nothing is shuffled.

    Only the texts go through Python, once for each block of the benchmark. Null and empty texts are clean.
    """
    for sent in _sent(benchmark, item, item_text):
        docs = docs.where(~_dirty(sent, k, threshold)(F.col(text)))
    return docs


def _dirty(sent, k: int, threshold: float):
    @F.pandas_udf("boolean")
    def dirty(texts: pd.Series) -> pd.Series:
        index = _index(sent, k)
        return pd.Series([bool(_held(index, text, k, threshold)) for text in texts], dtype=bool)

    return dirty


def _held(index: Index, text: str | None, k: int, threshold: float) -> list[tuple[object, int, int]]:
    """(item, shingles, shingles found) of every item of the index that the text holds."""
    words, hashes = shingles(text, k)
    near = index.candidates(hashes)
    if not near:
        return []
    held = _strings(words, k)
    found = [(name, len(wanted), len(wanted & held)) for name, wanted in (index.items[i] for i in sorted(near))]
    return [x for x in found if x[2] >= threshold * x[1]]
