"""Operator 7: repeated byte strings, by hash-compared suffix sorting of the places where they may be."""

from __future__ import annotations

from collections import Counter
from functools import cached_property
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .common import BASES, mix, powers

#: Bytes of the shortest string that counts as repeated, and of the anchors that find such strings.
LENGTH, ANCHOR = 400, 100
#: Text bytes of a block, about.
BLOCK_BYTES = 4 << 20
#: Bytes of a block whose hashes are in memory at a time.
SEGMENT = 1 << 19
#: Places that an anchor may have in different texts for its contexts to meet in one bin. Of an anchor with more of them the
#: bins are asked about every string through it, each distinct one of a block once, so that no bin gathers its contexts.
GROUP = 1024
#: Kinds of questions.
ANCHORS, COPIES, CONTEXTS, STRINGS = 1, 2, 3, 4
#: What is said of an anchor: it stands once, its contexts are compared, its strings are asked about.
ALONE, FEW, MANY = 0, 1, 2


class Prefix:
    """Prefix polynomial hashes of a byte string, modulo 2**64: the hash of any part in constant time."""

    def __init__(self, data: bytes, which: int = 0):
        base = BASES[which]
        self.raw = np.frombuffer(data, np.uint8)
        n = len(self.raw)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(n + 1, np.uint64)
            terms = powers(base, n)
            terms *= self.raw.astype(np.uint64) + np.uint64(1)
            np.cumsum(terms, out=self.sums[1:])
        self.back = powers(pow(base, -1, 1 << 64), n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[end] - self.sums[start]) * self.back[start]


class Block:
    """The texts of a block as bytes, and the anchors among their positions.

    Every string of `length` bytes has an anchor in it: the `anchor` bytes with the smallest hash. Equal strings have
    their anchors at the same place.
    """

    def __init__(self, table: pa.Table, length: int, anchor: int):
        found = table.column("_text").to_pylist()
        self.texts = [(t or "").encode() for t in found]
        size = np.array([len(t) for t in self.texts], np.int64)
        self.end = np.cumsum(size)
        self.begin = self.end - size
        self.data = b"".join(self.texts)
        self.length, self.anchor = length, anchor
        self._place()

    def _place(self) -> None:
        """Finds the anchors segment by segment, each with as many bytes around it as a string through an anchor reaches."""
        found = [self._segment(a, min(a + SEGMENT, len(self.data))) for a in range(0, len(self.data), SEGMENT)]
        self.at = np.concatenate([np.empty(0, np.int64), *[at for at, _ in found]])
        self.hash = np.concatenate([np.empty(0, np.uint64), *[h for _, h in found]])
        self.doc = np.searchsorted(self.end, self.at, side="right")

    def _segment(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        k, w = self.anchor, self.length - self.anchor + 1
        low, high = max(0, first - self.length), min(len(self.data), last + self.length)
        n = high - low
        if n < self.length:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        prefix, start = Prefix(self.data[low:high]), np.arange(n - k + 1)
        gram = mix(prefix.of(start, start + k))
        least = B.sliding_min(gram, w)
        # Strings across two documents don't count: their minimum becomes 0, which no anchor has.
        doc = np.searchsorted(self.end, np.arange(low, high), side="right")
        least[doc[: len(least)] != doc[self.length - 1 : self.length - 1 + len(least)]] = 0
        edge = np.zeros(w - 1, np.uint64)
        most = ~B.sliding_min(~np.concatenate((edge, least, edge)), w)  # the largest minimum of the strings around a position
        at = np.flatnonzero((most == gram) & (gram > 0))
        at = at[(at >= first - low) & (at < last - low)]
        return at + low, mix(gram[at])  # the smallest hashes are all small; mixed again they spread over all bins

    @cached_property
    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes of the anchors, how many places each has in the block, how many in different texts, and each
        anchor's hash's place among them."""
        values, place, count = np.unique(self.hash, return_inverse=True, return_counts=True)
        speaks = np.zeros(len(self.texts), bool)
        speaks[np.unique(self.digests[3], return_index=True)[1]] = True
        return values, count, np.bincount(place[speaks[self.doc]], minlength=len(values)), place

    @cached_property
    def digests(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct digests of the texts in two halves, whether several texts have it, and each text's place among them."""
        both = np.array([np.frombuffer(blake2b(t, digest_size=16).digest(), np.uint64) for t in self.texts], np.uint64).reshape(-1, 2)
        values, place, count = np.unique(both, axis=0, return_inverse=True, return_counts=True)
        return values[:, 0].copy(), values[:, 1].copy(), count > 1, place.ravel()

    def among(self, said: np.ndarray, copied: np.ndarray) -> np.ndarray:
        """Which anchors have a hash of which `said` is true, in texts that aren't copies."""
        return np.flatnonzero(said[self.anchors[3]] & ~copied[self.doc]) if len(self.at) else np.empty(0, np.int64)

    def strings(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Every string through the given anchors: the distinct digests in two halves, whether each has several places, and
        of each place its string's number among them and where it starts. A digest of 128 bits stands for the bytes."""
        reach = self.length - self.anchor
        low = np.maximum(self.begin[self.doc[at]], self.at[at] - reach)
        high = np.minimum(self.end[self.doc[at]] - self.length, self.at[at])
        step = np.zeros(len(self.data) + 2, np.int32)
        np.add.at(step, low[high >= low], 1)
        np.add.at(step, high[high >= low] + 1, -1)
        start = np.flatnonzero(np.cumsum(step[:-1]) > 0)
        data, n = self.data, self.length
        both = np.frombuffer(b"".join([blake2b(data[i : i + n], digest_size=16).digest() for i in start.tolist()]), np.uint64).reshape(-1, 2)
        order = np.lexsort((both[:, 1], both[:, 0]))
        one, two = both[order, 0], both[order, 1]
        new = np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1]))) if len(order) else np.empty(0, bool)
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        return one[new], two[new], np.bincount(place, minlength=new.sum()) > 1, place, start

    def contexts(self, at: np.ndarray) -> tuple[np.ndarray, list, np.ndarray, np.ndarray, np.ndarray]:
        """What surrounds the given anchors, as far as a string through the anchor reaches: distinct (hash, bytes before the
        anchor, bytes), whether each has several places, and of each anchor its place among them and itself."""
        reach = self.length - self.anchor
        low = np.maximum(self.begin[self.doc[at]], self.at[at] - reach).tolist()
        high = np.minimum(self.end[self.doc[at]], self.at[at] + self.length).tolist()
        named = [(h, p - a, self.data[a:b]) for h, p, a, b in zip(self.hash[at].tolist(), self.at[at].tolist(), low, high)]
        distinct = sorted(set(named))
        number = {c: i for i, c in enumerate(distinct)}
        place = np.fromiter((number[c] for c in named), np.int64, len(named))
        return np.array([c[0] for c in distinct], np.uint64), distinct, np.bincount(place, minlength=len(distinct)) > 1, place, at


class Contexts:
    """Contexts of equal anchors, sorted by the suffixes that start at the anchors."""

    def __init__(self, group: np.ndarray, before: np.ndarray, parts: list[bytes], which: int = 0):
        self.group, self.before = group, before
        size = np.array([len(p) for p in parts], np.int64)
        self.at = np.cumsum(size) - size + before  # the anchors in the joined text
        self.after = size - before
        self.data = b"".join(parts)
        self.prefix = Prefix(self.data, which)

    def common(self, x: np.ndarray, y: np.ndarray, right: bool) -> np.ndarray:
        """Length of the longest common extension of the anchors x and y to the right or left, by binary search on hashes."""
        a, b = self.at[x], self.at[y]
        low = np.zeros(len(x), np.int64)
        high = np.minimum(self.after[x], self.after[y]) if right else np.minimum(self.before[x], self.before[y])
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.prefix.of(a, a + mid) == self.prefix.of(b, b + mid) if right else self.prefix.of(a - mid, a) == self.prefix.of(b - mid, b)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def below(self, x: np.ndarray, y: np.ndarray, right: bool) -> np.ndarray:
        """-1, 0 or 1: the order of what stands right (or, read backwards, left) of the anchors x and y."""
        n = self.common(x, y, right)
        room = self.after if right else self.before
        last = len(self.prefix.raw) - 1
        next_ = lambda i: np.clip(self.at[i] + n if right else self.at[i] - n - 1, 0, last)
        byte_x, byte_y = (np.where(n == room[i], -1, self.prefix.raw[next_(i)].astype(np.int64)) for i in (x, y))
        return np.sign(byte_x - byte_y)

    def sort(self, right: bool = True) -> np.ndarray:
        """Mergesort of the suffixes at the anchors (or of the reversed prefixes before them) within each group, all groups
        at once: the place of one is its place in its own run and its rank in the other one, which a binary search finds."""
        order = np.argsort(self.group, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], self.group[order][1:] != self.group[order][:-1])))
        size = np.diff(np.append(first, len(order)))
        start, total = np.repeat(first, size), np.repeat(size, size)
        j = np.arange(len(order)) - start
        width = 1
        while width < size.max():
            run = j // width
            other = (run ^ 1) * width
            low, high = np.zeros(len(j), np.int64), np.clip(total - other, 0, width)
            while len(open_ := np.flatnonzero(low < high)):
                mid = (low[open_] + high[open_]) // 2
                rival = order[start[open_] + other[open_] + mid]
                sign = self.below(rival, order[open_], right)
                before = (sign < 0) | ((sign == 0) & (run[open_] % 2 == 1))  # equal suffixes keep their order
                low[open_], high[open_] = np.where(before, mid + 1, low[open_]), np.where(before, high[open_], mid)
            place = start + (run & ~1) * width + (j - run * width) + low
            after = np.empty_like(order)
            after[place] = order
            order, width = after, width * 2
        return order

    def same_bytes(self, x: np.ndarray, y: np.ndarray, left: np.ndarray, right: np.ndarray) -> bool:
        """Verifies that the extensions found really are equal."""
        data, a, b = self.data, self.at[x] - left, self.at[y] - left
        return all(data[i : i + n] == data[j : j + n] for i, j, n in zip(a.tolist(), b.tolist(), (left + right).tolist()))


def _by_bytes(c: Contexts, length: int, left: np.ndarray, right: np.ndarray) -> None:
    """Fills in left and right by the bytes of all strings, group by group: where both hashes proved wrong."""
    for g in np.unique(c.group).tolist():
        members = np.flatnonzero(c.group == g).tolist()
        starts = [(i, a) for i in members for a in range(int(c.at[i] - c.before[i]), int(c.at[i] + c.after[i]) - length + 1)]
        count = Counter(c.data[a : a + length] for _, a in starts)
        for i, a in starts:
            if count[c.data[a : a + length]] > 1:
                o = int(c.at[i]) - a
                left[i], right[i] = max(left[i], o), max(right[i], length - o)


def repeated(anchor: np.ndarray, before: np.ndarray, multiple: np.ndarray, parts: np.ndarray, length: int) -> np.ndarray:
    """For each context how far the strings of `length` bytes reach left and right of its anchor that lie elsewhere too.

    All these strings hold the anchor, so their union is one range. Returned as left * 2**32 + right, -1 for none.
    """
    left, right = np.full(len(anchor), -1, np.int64), np.full(len(anchor), -1, np.int64)
    size = np.array([len(p) for p in parts], np.int64)
    left[multiple], right[multiple] = before[multiple], (size - before)[multiple]
    _, group, count = np.unique(anchor, return_inverse=True, return_counts=True)
    some = np.flatnonzero(count[group] > 1)
    for which in range(len(BASES)) if len(some) else ():
        c = Contexts(group[some], before[some], [parts[i] for i in some], which)
        to_left, to_right = left[some], right[some]
        if _extend(c, to_left, to_right, length):
            left[some], right[some] = to_left, to_right
            break
    else:
        if len(some):
            to_left, to_right = left[some], right[some]
            _by_bytes(c, length, to_left, to_right)
            left[some], right[some] = to_left, to_right
    return np.where(left < 0, -1, (left << 32) + right)


def _extend(c: Contexts, left: np.ndarray, right: np.ndarray, length: int) -> bool:
    """Fills in left and right; False if a hash gave two different strings for equal.

    What a suffix shares with its neighbours in suffix order only gets less with their distance, so the first neighbour
    on either side that gives `length` bytes in all reaches furthest to the right; that in the order of the reversed
    prefixes reaches furthest to the left.
    """
    some = np.flatnonzero((left < c.before) | (right < c.after))
    for to_right, best in ((True, right), (False, left)):
        order = c.sort(to_right)
        n, place = len(order), np.empty(len(order), np.int64)
        place[order] = np.arange(n)
        follows = c.group[order][1:] == c.group[order][:-1]
        shared = np.where(follows, c.common(order[:-1], order[1:], to_right), 0)
        for side in (1, -1):
            # open_: places in the order; reach: what stands there shares with the neighbour t places away
            open_ = place[some]
            reach = np.full(len(open_), np.iinfo(np.int64).max)
            t = 0
            while len(open_):
                t += 1
                edge = open_ + (t - 1 if side > 0 else -t)
                ok = (edge >= 0) & (edge < n - 1)
                ok[ok] = follows[edge[ok]]
                open_, reach = open_[ok], np.minimum(reach[ok], shared[edge[ok]])
                x, y = order[open_], order[open_ + side * t]
                back = c.common(x, y, not to_right)
                hit = back + reach >= length
                if not c.same_bytes(x[hit], y[hit], *((back[hit], reach[hit]) if to_right else (reach[hit], back[hit]))):
                    return False
                best[x[hit]] = np.maximum(best[x[hit]], reach[hit])
                # A neighbour that shares less to this side than the anchor and the other side can make up for ends the walk.
                more = ~hit & (reach + (c.before if to_right else c.after)[x] >= length)
                open_, reach = open_[more], reach[more]
    return True


def _spread(anchors: np.ndarray, places: np.ndarray, texts: np.ndarray, group: int) -> np.ndarray:
    """Of each anchor whether it stands once, in few or in many places."""
    _, place = np.unique(anchors, return_inverse=True)
    many = np.bincount(place, texts)[place] > group
    return np.where(np.bincount(place, places)[place] < 2, ALONE, np.where(many, MANY, FEW))


def _twice(one: np.ndarray, two: np.ndarray, several: np.ndarray) -> np.ndarray:
    """Which strings have several places, in one block or in several."""
    order = np.lexsort((two, one))
    new = np.concatenate(([True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])))
    place = np.empty(len(one), np.int64)
    place[order] = np.cumsum(new) - 1
    return (np.bincount(place)[place] > 1) | several


def _copies(one: np.ndarray, two: np.ndarray, several: np.ndarray, block: np.ndarray) -> np.ndarray:
    """0 for a text that stands alone, 1 where the block with the smallest number speaks for all its copies, 2 for the others."""
    order = np.lexsort((block, two, one))
    new = np.concatenate(([True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])))
    group = np.cumsum(new) - 1
    n = np.bincount(group)[group]
    out = np.empty(len(one), np.int64)
    out[order] = np.where(new, np.where((n > 1) | several[order], 1, 0), 2)
    return out


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, anchor: int = ANCHOR, group: int = GROUP) -> DataFrame:
    """Removes from every text each byte that lies in a string of `length` bytes which also starts anywhere else.

    Every such string holds an anchor: its `anchor` bytes of the smallest hash. Anchors that occur once in the corpus are
    out. The bytes around the others (as far as a string through the anchor reaches) meet in bins, each distinct context
    of a block once, and are sorted there by the suffixes that start at the anchors: a mergesort whose comparisons find
    the common extension by binary search on prefix polynomial hashes. Neighbours in suffix order share the longest
    extensions to the right, those in the order of the reversed prefixes to the left; where both sides reach `length`
    bytes, they are verified byte by byte and mark a range.
    A hash that proves wrong is replaced by another one. Copies of whole texts are found by digests. The contexts of an
    anchor with more than GROUP places in different texts don't meet: the bins are asked about the digests of all strings
    through it instead, each distinct one of a block once, so a passage that very many texts share costs a bin a question
    a block for each of its strings.

    Returns key, bytes (what is left, as binary), n_bytes, n_removed, n_spans (maximal removed runs), spans (their starts
    and ends) and, as struct `rest`, all other columns of docs. A null text is empty. Rows with null or equal keys are
    texts of their own, so repeated rows remove each other; an empty table gives an empty result. The key is an integer.
    """
    n_blocks, n = B.count(docs, text, BLOCK_BYTES)
    dealt = B.deal(docs, key, text, n_blocks)
    rest = dealt.schema["_rest"].dataType.simpleString()

    def number(table: pa.Table) -> int:
        return table.column("_block")[0].as_py()

    def ask_anchors(table: pa.Table) -> pa.Table:
        block = Block(table, length, anchor)
        one, two, several, _ = block.digests
        return pa.concat_tables([B.ask(number(table), n, ANCHORS, *block.anchors[:3]), B.ask(number(table), n, COPIES, one, two, several, np.full(len(one), number(table)))])

    def candidates(block: Block, told: pa.Table) -> tuple:
        state = B.answers(told, COPIES, np.int64)
        place = block.digests[3]
        first = np.zeros(len(block.texts), bool)
        first[np.unique(place, return_index=True)[1]] = True
        copied = (state[place] == 2) | ((state[place] == 1) & ~first)
        said = B.answers(told, ANCHORS, np.int64)
        return state[place] > 0, block.contexts(block.among(said == FEW, copied)), block.strings(block.among(said == MANY, copied))

    def ask_contexts(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return B.ask(0, n, CONTEXTS, np.empty(0, np.uint64))
        _, (first, distinct, several, _, _), (one, two, twice, _, _) = candidates(Block(table, length, anchor), told)
        before, parts = np.array([c[1] for c in distinct], np.int64), np.empty(len(distinct), object)
        parts[:] = [c[2] for c in distinct]
        return pa.concat_tables([B.ask(number(table), n, CONTEXTS, first, before, several, parts), B.ask(number(table), n, STRINGS, one, two, twice)])

    def finish(table: pa.Table, told: pa.Table) -> pa.Table:
        block = Block(table, length, anchor)
        whole, (_, _, _, place, at), (_, _, _, string, start) = candidates(block, told)
        found = B.answers(told, CONTEXTS, np.int64)[place]
        hit = found >= 0
        left, right, middle = found[hit] >> 32, found[hit] & 0xFFFFFFFF, block.at[at[hit]]
        step = np.zeros(len(block.data) + 1, np.int32)
        np.add.at(step, middle - left, 1)
        np.add.at(step, middle + right, -1)
        twice = start[B.answers(told, STRINGS, bool)[string]]
        step[twice] += 1
        step[twice + length] -= 1
        for i in np.flatnonzero(whole & (block.end - block.begin >= length)):
            step[block.begin[i]] += 1
            step[block.end[i]] -= 1
        gone = np.cumsum(step[:-1]) > 0
        kept, removed, spans = [], [], []
        raw = np.frombuffer(block.data, np.uint8)
        for a, b, t in zip(block.begin.tolist(), block.end.tolist(), block.texts):
            out = gone[a:b]
            edge = np.flatnonzero(np.diff(np.concatenate(([False], out, [False])).view(np.int8))).reshape(-1, 2).tolist()
            spans.append([{"start": s, "end": e} for s, e in edge])
            removed.append(int(out.sum()))
            kept.append(raw[a:b][~out].tobytes() if edge else t)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({
            "_key": table.column("_key"), "bytes": pa.array(kept, pa.binary()), "n_bytes": pa.array(block.end - block.begin, pa.int64()),
            "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, kind), "_rest": table.column("_rest"),
        })

    kinds = {ANCHORS: lambda *asked: _spread(*asked, group), COPIES: _copies, CONTEXTS: lambda *asked: repeated(*asked, length), STRINGS: _twice}
    found = B.rounds(dealt, ask_anchors, ask_contexts, kinds, finish, f"_key long, bytes binary, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, _rest {rest}")
    return found.select(F.col("_key").alias(key), "bytes", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "spans", F.col("_rest").alias("rest"))
