"""Operator 6: repeated passages of words, by relative Lempel-Ziv parsing of every document against all reference blocks."""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .common import mix, rolling, word_hashes, word_spans

#: Words of the shortest factor that is a duplicate, and of the seeds that find it.
WINDOW, SEED_WORDS = 13, 5
#: Kinds of questions.
SEEDS, COPIES, WINDOWS = 1, 2, 3
_LAST = np.iinfo(np.int64).max


@dataclass
class Block:
    """The words of a block's documents, in ascending order of their key (null keys last)."""

    keys: np.ndarray  # of the documents; null keys are the largest number
    rows: np.ndarray  # where each document is in the table
    texts: list[bytes]
    data: bytes  # all words, joined by single spaces
    begin: np.ndarray  # first word of each document, and the end of the last
    starts: np.ndarray  # bytes of data where the words start and end
    ends: np.ndarray
    doc: np.ndarray  # document of each word
    window: int

    def __init__(self, table: pa.Table, window: int = WINDOW, seed: int = SEED_WORDS):
        keys = table.column("_key").fill_null(_LAST).to_numpy()
        self.rows = np.argsort(keys, kind="stable")
        self.keys = keys[self.rows]
        found = table.column("_text").to_pylist()
        self.texts = [(found[i] or "").encode() for i in self.rows]
        self.data = b" ".join(b" ".join(t.split()) for t in self.texts)
        self.starts, self.ends = word_spans(self.data)
        n_words = np.array([len(t.split()) for t in self.texts], np.int64)
        self.begin = np.concatenate(([0], np.cumsum(n_words)))
        self.doc = np.repeat(np.arange(len(self.texts)), n_words)
        self.window = window
        n = max(0, len(self.starts) - window + 1)
        # A window's seed is the smallest hash of its runs of `seed` words, so equal windows have equal seeds.
        self.valid = self.doc[:n] == self.doc[window - 1 : window - 1 + n]
        # The smallest hashes are all small; mixed again they spread over all bins.
        self.seed = mix(B.sliding_min(rolling(word_hashes(self.data, self.starts, self.ends), seed), window - seed + 1))
        self.id = self.keys[self.doc[:n]]

    def seeds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct seeds in ascending order, which of them stand in documents of different keys, and the seed of each valid window."""
        seed, key = self.seed[self.valid], self.id[self.valid]
        if not len(seed):
            return seed, np.empty(0, bool), np.empty(0, np.int64)
        order = np.argsort(seed, kind="stable")  # keys stay ascending
        first = np.flatnonzero(np.concatenate(([True], seed[order][1:] != seed[order][:-1])))
        last = np.concatenate((first[1:], [len(order)])) - 1
        place = np.empty(len(order), np.int64)
        place[order] = np.repeat(np.arange(len(first)), last - first + 1)
        return seed[order][first], key[order][first] < key[order][last], place

    def digests(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each document two 64-bit halves of a digest of its text; ascending, with the documents' numbers."""
        both = np.array([np.frombuffer(blake2b(t, digest_size=16).digest(), np.uint64) for t in self.texts], np.uint64).reshape(-1, 2)
        order = np.lexsort((self.keys, both[:, 1], both[:, 0]))
        return both[order, 0], both[order, 1], order

    def candidates(self, shared: np.ndarray, copied: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows with a shared seed in documents that aren't copies: the two halves of their digests, distinct and
        ascending, the smallest key and the place in that document of each, and of each candidate window its number among
        them and its start. A digest of 128 bits stands for the bytes of the words."""
        _, _, place = self.seeds()
        at = np.flatnonzero(self.valid)
        at = at[shared[place]] if len(at) else at
        at = at[~copied[self.doc[at]]]
        data = self.data
        found = b"".join([blake2b(data[a:b], digest_size=16).digest() for a, b in zip(self.starts[at].tolist(), self.ends[at + self.window - 1].tolist())])
        one, two = np.frombuffer(found, np.uint64).reshape(-1, 2).T
        order = np.lexsort((two, one))  # keys and places stay ascending
        a, b = one[order], two[order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(at) else np.empty(0, bool)
        group = np.empty(len(at), np.int64)
        group[order] = np.cumsum(new) - 1
        first = at[order[new]]
        return a[new], b[new], self.id[first], first - self.begin[self.doc[first]], group, at

    def factors(self, key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The parse: first and last window of each factor, a longest run of windows that follow one reference place.

        key and place: of each window the reference document and the word in it where the window stands too (key _LAST: none).
        """
        known, doc = key < _LAST, self.doc[: len(key)]
        follows = np.zeros(len(key), bool)
        follows[1:] = known[1:] & (key[1:] == key[:-1]) & (place[1:] == place[:-1] + 1) & (doc[1:] == doc[:-1])
        first = np.flatnonzero(known & ~follows)
        return first, np.flatnonzero(known & ~np.append(follows[1:], False))

    def result(self, table: pa.Table, key: np.ndarray, place: np.ndarray, joined: bool) -> pa.Table:
        """The rows of the result, from the reference of every window (see factors())."""
        first, last = self.factors(key, place)
        step = np.zeros(len(self.doc) + 1, np.int64)
        np.add.at(step, first, 1)
        np.add.at(step, last + self.window, -1)
        gone = np.cumsum(step[:-1]) > 0
        each = np.searchsorted(first, self.begin)
        texts, removed, spans, parse = [], [], [], []
        for i, text in enumerate(self.texts):
            a, b = self.begin[i], self.begin[i + 1]
            out = gone[a:b]
            edge = np.flatnonzero(np.diff(np.concatenate(([False], out, [False])).view(np.int8)))
            spans.append([{"start": s, "end": e} for s, e in edge.reshape(-1, 2).tolist()])
            mine = slice(each[i], each[i + 1])
            parse.append([{"start": s, "length": e - s + self.window, "ref_key": k, "ref_start": p} for s, e, k, p in zip((first[mine] - a).tolist(), (last[mine] - a).tolist(), key[first[mine]].tolist(), place[first[mine]].tolist())])
            removed.append(int(out.sum()))
            if joined:
                words = text.split()
                text = b" ".join([w for w, o in zip(words, out.tolist()) if not o] if len(edge) else words)
            elif len(edge):
                # A removed run ends where the next kept word starts.
                marks = np.append(word_spans(text)[0], len(text))
                at, parts = 0, []
                for s, e in edge.reshape(-1, 2).tolist():
                    parts.append(text[at : marks[s]])
                    at = marks[e]
                text = b"".join([*parts, text[at:]]).rstrip() if edge[-1] == len(out) else b"".join([*parts, text[at:]])
            texts.append(text.decode())
        order = pa.array(self.rows)
        keys, rest = table.column("_key").take(order), table.column("_rest").take(order)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        factor = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("ref_key", pa.int64()), ("ref_start", pa.int64())]))
        n_words = np.diff(self.begin)
        return pa.table({"_key": keys, "text": pa.array(texts, pa.string()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, kind), "factors": pa.array(parse, factor), "_rest": rest})


def _shared(seeds: np.ndarray) -> np.ndarray:
    """Which seeds more than one block holds."""
    _, place, n = np.unique(seeds, return_inverse=True, return_counts=True)
    return n[place] > 1


def _first(one: np.ndarray, two: np.ndarray, *named: np.ndarray) -> np.ndarray:
    """Of each row the smallest name (as rows of an array) among the rows with the same digest."""
    order = np.lexsort((*named[::-1], two, one))
    new = np.concatenate(([True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])))
    least = np.empty((len(one), len(named)), np.int64)
    least[order] = np.stack(named, 1)[order][new][np.cumsum(new) - 1]
    return least if len(named) > 1 else least[:, 0]


def _copies(block: Block, least: np.ndarray) -> np.ndarray:
    """The smallest key of each document's text; least: the same in the order of the digests."""
    out = np.empty(len(block.texts), np.int64)
    out[block.digests()[2]] = least
    return out


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, seed: int = SEED_WORDS, joined: bool = True) -> DataFrame:
    """Removes from every text the passages of at least `window` words that stand in a document with a smaller key.

    Relative Lempel-Ziv parsing of every document against all reference blocks. The blocks' index is spread over bins by
    hash: a first round finds the seeds (runs of `seed` words, the smallest hash of each window) that more than one
    document holds, a second one asks the index for every window with such a seed and gets the reference: the smallest
    key, and the first place in that document, where the window's words stand too. The parse goes from left to right: a
    factor begins at a window that has a reference and is lengthened while the next window continues in the same
    reference. A window that crosses the boundary of two factors is asked for like any other, and begins a factor that
    overlaps both. Factors are whole windows or longer, and all of them are removed. Windows are compared by 128-bit
    cryptographic digests of their words, so hostile texts find no collision as they would for the hashes of the seeds,
    which only choose candidates. Whole copies are found by a digest of their text and are one factor.

    Returns key, text (what is left), n_words, n_removed, spans (start and end of each removed run of words), factors
    (start, length, and key and start in the reference) and, as struct `rest`, all other columns of docs. With joined the kept words are joined by single spaces; otherwise the text
    is kept as it is but for the removed words and the white space behind them, and untouched if nothing was removed.
    A null or empty text has no words. Rows with a null key come after all others and are never a reference for each
    other; nor are rows with the same key. Repeated rows stay; an empty table gives an empty result. The key is an integer.
    """
    n_blocks, n = B.count(docs, text)
    dealt = B.deal(docs, key, text, n_blocks)
    rest = dealt.schema["_rest"].dataType.simpleString()

    def number(table: pa.Table) -> int:
        return table.column("_block")[0].as_py()

    def ask_seeds(table: pa.Table) -> pa.Table:
        block = Block(table, window, seed)
        one, two, order = block.digests()
        return pa.concat_tables([B.ask(number(table), n, SEEDS, block.seeds()[0]), B.ask(number(table), n, COPIES, one, two, block.keys[order])])

    def candidates(block: Block, told: pa.Table) -> tuple:
        _, local, _ = block.seeds()
        original = _copies(block, B.answers(told, COPIES, np.int64))
        copied = original < block.keys
        return copied, original, *block.candidates(local | B.answers(told, SEEDS, bool), copied)

    def ask_windows(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return B.ask(0, n, WINDOWS, np.empty(0, np.uint64))
        _, _, one, two, least, place, _, _ = candidates(Block(table, window, seed), told)
        return B.ask(number(table), n, WINDOWS, one, two, least, place)

    def finish(table: pa.Table, told: pa.Table) -> pa.Table:
        block = Block(table, window, seed)
        copied, original, _, _, _, _, group, at = candidates(block, told)
        named = B.answers(told, WINDOWS, np.int64).reshape(-1, 2)[group]
        smaller = named[:, 0] < block.id[at]
        key, place = np.full(len(block.seed), _LAST, np.int64), np.zeros(len(block.seed), np.int64)
        key[at[smaller]], place[at[smaller]] = named[smaller].T
        whole = np.flatnonzero(block.valid & copied[block.doc[: len(key)]])
        key[whole], place[whole] = original[block.doc[whole]], whole - block.begin[block.doc[whole]]
        return block.result(table, key, place, joined)

    found = B.rounds(dealt, ask_seeds, ask_windows, {SEEDS: _shared, COPIES: _first, WINDOWS: _first}, finish, f"_key long, text string, n_words long, n_removed long, spans array<struct<start:long,end:long>>, factors array<struct<start:long,length:long,ref_key:long,ref_start:long>>, _rest {rest}")
    return found.select(F.col("_key").alias(key), F.col("text").alias(text), "n_words", "n_removed", "spans", "factors", F.col("_rest").alias("rest"))
