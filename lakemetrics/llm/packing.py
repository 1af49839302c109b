"""Operator 10: tokenizing, and vector bin packing of documents into training sequences."""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import through_pandas

TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
END = 1
LENGTH = 2048
#: Limits of a sequence besides its tokens: segments, and tokens that bear loss.
SEGMENTS, LOSS = 64, 2048
#: Remainders of documents that wait for a place, in a task.
POOL = 256
#: Texts that are encoded together; words, and ids of words, that a worker remembers.
GROUP, MEMORY, MEMORY_IDS = 128, 1_000_000, 1 << 24


#: A space that begins a piece of the pre-tokenizer, and one that doesn't. re counts four controls more as white space than
#: the tokenizer does, so every space taken for a beginning is one.
CUT, UNCUT = re.compile(r" (?=\S)"), re.compile(r" (?!\S)")


class Coder:
    """Encodes texts, remembering the ids of words.

    The pre-tokenizer of byte-level BPE begins a new piece at every space that is followed by anything but white space
    (a run of white space gives its last space to what follows). So a text is cut at these spaces and encoded word by
    word, each with the space before it; a word may hold other white space, also spaces that don't begin a piece. A text
    with the string of a special token is encoded whole.
    """

    def __init__(self, path: str, ranks: str | None = None, special: bool = True):
        """path: a file of the tokenizers library; ranks: the same vocabulary as a tiktoken file, which encodes new words faster;
        special: the string of a special token is that token, as the library reads it, else ordinary text."""
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.strings = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.bulk = _fast(ranks) if ranks else self._whole
        names = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(names.values()) + 1, bool)
        self.spaced[[i for name, i in names.items() if name.startswith("\u0120")]] = True  # as byte-level BPE writes a space
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.n_ids = np.empty(1 << 16, np.uint32), 0
        self.start, self.n = np.zeros(1 << 16, np.int64), 0

    def _learn(self, words: list[str]) -> None:
        """Encodes new words: those without a space in one text, in which a token that begins with a space begins a word."""
        plain = [w for w in words if " " not in w]
        got = self.bulk(" " + " ".join(plain)) if plain else np.empty(0, np.uint32)
        begin = np.flatnonzero(self.spaced[got])
        if len(begin) == len(plain):
            self._keep(plain, got, begin)
            words = [w for w in words if " " in w]
        for w in words:
            self._keep([w], self.bulk(f" {w}"), np.zeros(1, np.int64))

    def _keep(self, words: list[str], got: np.ndarray, begin: np.ndarray) -> None:
        while self.n + len(words) + 1 > len(self.start):
            self.start = np.concatenate((self.start, np.zeros_like(self.start)))
        while self.n_ids + len(got) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.empty_like(self.ids)))
        self.ids[self.n_ids : self.n_ids + len(got)] = got
        self.start[self.n : self.n + len(words)] = self.n_ids + begin
        self.place.update(zip(words, range(self.n, self.n + len(words))))
        self.n += len(words)
        self.n_ids += len(got)
        self.start[self.n] = self.n_ids

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _places(self, split: list[list[str]]) -> np.ndarray:
        """The number of every word but the first of each text, -1 for new ones."""
        rest = chain.from_iterable(s[1:] for s in split)
        return np.fromiter(map(self.place.get, rest, repeat(-1)), np.int64, sum(map(len, split)) - len(split))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.place) > MEMORY or self.n_ids > MEMORY_IDS:
            self._forget()
        whole = {i: self._whole(t) for i, t in enumerate(texts) if any(s in t for s in self.strings)}
        split = [[""] if i in whole else t.split(" ") for i, t in enumerate(texts)]
        at = self._places(split)
        if (at < 0).any():
            if any(UNCUT.search(t) for t in texts):
                split = [CUT.split(t) if i not in whole and UNCUT.search(t) else s for i, (t, s) in enumerate(zip(texts, split))]
                at = self._places(split)
            new = np.flatnonzero(at < 0)
            rest = list(chain.from_iterable(s[1:] for s in split))
            self._learn(list(dict.fromkeys(rest[i] for i in new)))
            at[new] = [self.place[rest[i]] for i in new]
        begin, n = self.start[at], self.start[at + 1] - self.start[at]
        ids = self.ids[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        ends = np.concatenate(([0], np.cumsum(n)))
        out, done = [], 0
        for i, s in enumerate(split):
            k = len(s) - 1
            out.append(whole[i] if i in whole else np.concatenate((self._whole(s[0]), ids[ends[done] : ends[done + k]])))
            done += k
        return out


def _fast(ranks: str) -> Callable[[str], np.ndarray]:
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        vocabulary = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary, special_tokens={}).encode_to_numpy


@cache
def coder(path: str | None, special: bool = True) -> Coder:
    """The coder of a worker process, which its tasks share; of the installed byte-level BPE where path is None."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core already
    if path is not None:
        return Coder(path, special=special)
    import public_tokenizers

    return Coder(public_tokenizers.path(TOKENIZER), public_tokenizers.path(RANKS), special)


class Packer:
    """Fills sequences under limits on tokens, segments and loss-bearing tokens.

    An item is (document number, first token, tokens, prompt tokens left): all tokens but those of the prompt bear loss.
    Of the items that fit, the one whose demand vector has the largest dot product with the room that is left goes in
    (all in parts of the limits). Where none fits whole, or the last segment is due, the item with the largest product is
    cut. Where the items are so short that segments run out first, the sequence is made for a power of two tokens that
    they can fill, and one that loss-bearing tokens end early is taken back to such a length, so that neither is padded.
    """

    def __init__(self, length: int = LENGTH, segments: int = SEGMENTS, loss: int = LOSS, pool: int = POOL):
        if min(length, segments, loss) < 1:
            raise ValueError("every limit of a sequence must be at least 1")
        self.limits = np.array([length, segments, loss], float)
        self.length, self.pool = length, pool
        self.items: list[tuple[int, int, int, int]] = []
        self.out: list[tuple[int, int, int, int, int]] = []  # document, start, length, sequence, offset
        self.sequence = 0

    def add(self, doc: int, tokens: int, prompt: int = 0) -> None:
        start = 0
        while tokens >= self.length and min(self.length, prompt) + self.limits[2] >= self.length and self.limits[1] >= 1:
            self.out.append((doc, start, self.length, self.sequence, 0))
            self.sequence += 1
            start, tokens, prompt = start + self.length, tokens - self.length, max(0, prompt - self.length)
        if tokens:
            self.items.append((doc, start, tokens, prompt))
        while len(self.items) >= self.pool and sum(x[2] for x in self.items) >= self.length:
            self._fill(self.length)

    def _fill(self, length: int) -> None:
        """Makes one sequence of at most length tokens."""
        pool = np.array([x[2:] for x in self.items], float)
        most = int(np.sort(pool[:, 0])[::-1][: int(self.limits[1])].sum())  # tokens that the segments can hold
        if 0 < most < length:
            length = 1 << (most.bit_length() - 1)
        alive = np.ones(len(pool), bool)
        limits = np.array([length, *self.limits[1:]])
        room, offset, placed = limits.copy(), 0, []
        while room[0] >= 1 and room[1] >= 1 and alive.any():
            need = np.stack([pool[:, 0], np.ones(len(pool)), np.maximum(pool[:, 0] - pool[:, 1], 0)], 1)
            score = (need / limits) @ (room / limits)
            fits = alive & (need <= room).all(1)
            if room[1] < 2 and (alive & (need[:, 0] >= room[0])).any():  # the last segment: fill what is left
                fits = alive & (need[:, 0] >= room[0])
            i = int(np.argmax(np.where(fits if fits.any() else alive, score, -1.0)))
            doc, start, tokens, prompt = self.items[i]
            n = int(min(tokens, room[0], prompt + room[2]))
            if n <= 0:
                break
            placed.append((i, doc, start, n, prompt))
            offset += n
            room -= [n, 1, max(n - prompt, 0)]
            if n == tokens:
                alive[i] = False
            else:
                self.items[i] = (doc, start + n, tokens - n, max(0, prompt - n))
                pool[i] = self.items[i][2:]
        full = offset if offset == self.length else 1 << max(offset.bit_length() - 1, 0)
        at = 0
        for i, doc, start, n, prompt in placed:
            stay = min(n, max(0, full - at))
            if stay:
                self.out.append((doc, start, stay, self.sequence, at))
            if stay < n:  # its end waits again; an item is cut in one place, so what follows it is joined to it
                back = self.items[i] if alive[i] else (doc, start + n, 0, 0)
                self.items[i] = (doc, start + stay, n - stay + back[2], max(0, prompt - stay))
                alive[i] = True
            at += stay
        self.items = [x for x, a in zip(self.items, alive) if a]
        self.sequence += 1

    def close(self) -> None:
        """Places what is left: full sequences, then ever smaller ones of a power of two tokens, so that none is padded."""
        while self.items:
            left = sum(x[2] for x in self.items)
            self._fill(min(self.length, 1 << (left.bit_length() - 1)))

    def taken(self) -> list[tuple[int, int, int, int, int]]:
        out, self.out = self.out, []
        return out


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, length: int = LENGTH, segments: int = SEGMENTS, loss: int = LOSS, prompt: str | None = None, with_ids: bool = False, special: bool = True) -> DataFrame:
    """Tokenizes every whole text and packs the documents into sequences of at most `length` tokens.

    Each document is its ids and the end id 1. Documents are cut freely, at the end of a sequence; each id lies in
    exactly one piece. `prompt` names a column with the number of leading tokens that bear no loss (null or absent: 0).
    Every task packs the rows of its own partition, in order, and holds at most POOL remainders, so nothing is shuffled
    and memory is bounded. A sequence has `length` tokens or a power of two, so none is padded: shorter are the last few
    of a task, and those that are full in segments or loss before they are full in tokens.

    Returns a row for each piece: key, start, length, ids_crc32, doc_tokens, sequence_id (task number * 2**40 + number
    in the task) and offset, and the ids where with_ids. A null or empty text is the end id alone; null keys and
    repeated rows are packed like any other; an empty table gives an empty result; other columns are ignored.
    `tokenizer` is the path of a tokenizers file that all executors can read (the installed byte-level BPE if None);
    `special`: the string of a special token in a text is that token, as the library has it, else ordinary text.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, packer = coder(tokenizer, special).encode, Packer(length, segments, loss)
        task = TaskContext.get().partitionId() << 40
        held: dict[int, tuple[object, np.ndarray, int]] = {}  # documents with tokens that have no place yet
        number = 0

        def pieces() -> pd.DataFrame:
            rows = []
            for doc, start, n, sequence, offset in packer.taken():
                name, ids, left = held[doc]
                part = ids[start : start + n]
                rows.append((name, start, n, zlib.crc32(part.astype("<u4").tobytes()), len(ids), task + sequence, offset, *([part.tolist()] if with_ids else [])))
                if left == n:
                    del held[doc]
                else:
                    held[doc] = (name, ids, left - n)
            return pd.DataFrame(rows, columns=columns)

        for pdf in batches:
            for at in range(0, len(pdf), GROUP):
                part = pdf.iloc[at : at + GROUP]
                for name, ids, first in zip(part["key"], encode([t or "" for t in part["text"]]), part["prompt"]):
                    ids = np.append(ids, np.uint32(END))
                    held[number] = (None if pd.isna(name) else name, ids, len(ids))
                    packer.add(number, len(ids), int(first))
                    number += 1
                yield pieces()
        packer.close()
        yield pieces()

    columns = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    sent, as_ = through_pandas(key, kind)
    schema = f"`{key}` {as_}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if with_ids else "")
    first = F.coalesce(F.col(prompt).cast("long"), F.lit(0)) if prompt else F.lit(0).cast("long")
    return docs.select(sent.alias("key"), F.col(text).alias("text"), first.alias("prompt")).mapInPandas(run, schema).withColumn(key, F.col(key).cast(kind))
