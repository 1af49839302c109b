"""Operator 11: collocations from n-grams that mergeable Misra-Gries summaries of hash partitions leave, counted exactly."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import cuts
from .common import mix, partitions, rolling, word_hashes, written

#: What ends a piece, and what parts the words of a piece.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
#: Bytes of text that are read together; a longer text is read alone.
CHUNK = 4 << 20
#: Counters that a task holds before it sends them off.
HELD = 1 << 21
#: Phrases that a task holds as text before it sends their counts off.
PHRASES = 1 << 18
#: n-gram occurrences of a hash partition, about.
MOST_MASS = 1 << 23
#: Bits of a hash that address a bitmap of survivors (16 MB, whatever the size of the corpus).
BITS = 27
SALTS = 64

_ENDS, _SPACE = np.zeros(256, bool), np.zeros(256, bool)
_ENDS[list(ENDS)] = _SPACE[list(ENDS + BLANKS)] = True

WORDS = "lang string, phrase string, size int, hash long, n long"
CELLS = "part int, mass long, keys binary, counts binary"
_CELLS = pa.schema([("part", pa.int32()), ("mass", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
_WORDS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("size", pa.int32()), ("hash", pa.int64()), ("n", pa.int64())])


class Chunk:
    """The words of some texts, in order: where they stand, the piece and language of each, and two hashes of word and language."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        self.langs = langs
        self.data = b"\n".join(texts).lower()  # bytes: A-Z only
        raw = np.frombuffer(self.data, np.uint8)
        edge = np.diff(np.concatenate(([False], ~_SPACE[raw], [False])).view(np.int8))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.piece = np.cumsum(_ENDS[raw])[self.starts] if len(raw) else self.starts
        first = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
        self.doc = np.searchsorted(first, self.starts, "right") - 1
        tag = {x: xxhash.xxh64_intdigest(x) for x in set(langs)}
        tags = np.array([tag[x] for x in langs], np.uint64)[self.doc]
        self.hash, self.check = (mix(word_hashes(self.data, self.starts, self.ends, k) ^ tags) for k in (0, 1))

    def grams(self, size: int, which: str = "hash") -> np.ndarray:
        """A hash of each run of `size` words, whether or not it lies in one piece."""
        return getattr(self, which) if size == 1 else rolling(getattr(self, which), size)

    def within(self, size: int) -> np.ndarray:
        """Which runs of `size` words lie in one piece."""
        n = max(0, len(self.piece) - size + 1)
        return self.piece[:n] == self.piece[size - 1 :]

    def phrase(self, at: int, size: int) -> str:
        return b" ".join([self.data[self.starts[i] : self.ends[i]] for i in range(at, at + size)]).decode()


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """Chunks of about CHUNK bytes from batches of (text, lang)."""
    for batch in batches:
        texts, langs, size = [], [], 0
        for text, lang in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist()):
            data = text.as_py()
            if texts and size + len(data) > CHUNK:
                yield Chunk(texts, langs)
                texts, langs, size = [], [], 0
            texts.append(data)
            langs.append(lang)
            size += len(data)
        if texts:
            yield Chunk(texts, langs)


class Tally:
    """Counts of the phrases of one task, each decoded when it is first met; two runs are the same when 128 bits of hash are."""

    def __init__(self):
        self.count: dict[tuple[int, int], int] = {}
        self.phrase: dict[tuple[int, int], tuple[str, str, int]] = {}

    def add(self, chunk: Chunk, size: int, mask: np.ndarray) -> None:
        """Counts the runs of `size` words under the mask."""
        at = np.flatnonzero(mask)
        a, b = chunk.grams(size)[at], chunk.grams(size, "check")[at]
        order = np.lexsort((b, a))
        a, b, at = a[order], b[order], at[order]
        head = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))[: len(a)]
        n = np.diff(np.append(head, len(a)).astype(np.int64))
        for i, key, more in zip(at[head].tolist(), zip(a[head].tolist(), b[head].tolist()), n.tolist()):
            if key in self.count:
                self.count[key] += more
            else:
                self.count[key] = more
                self.phrase[key] = (chunk.langs[chunk.doc[i]], chunk.phrase(i, size), size)

    def rows(self) -> pa.RecordBatch:
        """WORDS of all phrases, in the order of their hashes; the tally is empty then."""
        keys = sorted(self.count)
        columns = list(zip(*[self.phrase[k] for k in keys])) or [[]] * 3
        hashes = np.array([k[0] for k in keys], np.uint64).view(np.int64)
        out = pa.record_batch([pa.array(c, t) for c, t in zip([*columns, hashes, [self.count[k] for k in keys]], _WORDS.types)], schema=_WORDS)
        self.count, self.phrase = {}, {}
        return out


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally = Tally()
    for chunk in chunks(batches):
        tally.add(chunk, 1, np.ones(len(chunk.starts), bool))
        if len(tally.count) > PHRASES:
            yield tally.rows()
    yield tally.rows()


def has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes a bitmap may hold: true for all that were put in."""
    at = hashes >> np.uint64(64 - BITS)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def possible(chunk: Chunk, size: int, bits: np.ndarray) -> np.ndarray:
    """Runs of `size` words in one piece of which every run of one word less may be frequent.

    A run occurs no more often than any run within it, so no frequent one is left out.
    """
    parts = has(bits, chunk.grams(size - 1))
    n = max(0, len(chunk.starts) - size + 1)
    return chunk.within(size) & parts[:n] & parts[1 : n + 1]


def possible_longer(chunk: Chunk, size: int, pairs: np.ndarray) -> np.ndarray:
    """Runs of `size` words in one piece of which every pair of neighbours may be frequent."""
    near = has(pairs, chunk.grams(2))
    out = chunk.within(size)
    for i in range(size - 1):
        out &= near[i : i + len(out)]
    return out


def merged(keys: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Misra-Gries: counters of equal keys added; of more than `capacity`, all are lowered by the largest that must go.

    Returns keys, counts and by how much they were lowered. Lowering by c takes c from more than `capacity` counters, so
    over any sequence of merges no key loses more than mass / (capacity + 1).
    """
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))[: len(keys)]
    keys, counts = keys[head], np.add.reduceat(counts, head) if len(head) else counts
    if len(keys) <= capacity:
        return keys, counts, 0
    lost = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
    stay = counts > lost
    return keys[stay], counts[stay] - lost, lost


def summarise(choose: Callable[[Chunk], Iterator[np.ndarray]], parts: int) -> Callable:
    """Local counts of the n-grams that choose(chunk) gives (arrays of hashes), cut by hash partition."""

    def send(held: list[np.ndarray], n: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, counts, _ = merged(np.concatenate(held), np.concatenate(n), 1 << 62)
        at = cuts(keys, parts)
        full = np.flatnonzero(at[1:] > at[:-1])
        cells = [(counts[at[p] : at[p + 1]], keys[at[p] : at[p + 1]]) for p in full]
        yield pa.record_batch([pa.array(full, pa.int32()), pa.array([int(c.sum()) for c, _ in cells], pa.int64()), pa.array([k.tobytes() for _, k in cells], pa.binary()), pa.array([c.astype(np.uint32).tobytes() for c, _ in cells], pa.binary())], schema=_CELLS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, size = [], [], 0
        for chunk in chunks(batches):
            for keys in choose(chunk):
                keys, counts = np.unique(keys, return_counts=True)
                held.append(keys)
                n.append(counts)
                size += len(keys)
            if size > HELD:
                keys, counts, _ = merged(np.concatenate(held), np.concatenate(n), 1 << 62)
                held, n, size = [keys], [counts], len(keys)
                if size > HELD // 2:
                    yield from send(held, n)
                    held, n, size = [], [], 0
        if size:
            yield from send(held, n)

    return run


def survivors(cells: DataFrame, least: int) -> DataFrame:
    """Hashes (column hash) of each hash partition that a Misra-Gries summary keeps; all with `least` occurrences or more.

    Its capacity exceeds mass / least, so it lowers no key by `least` or more, and a key whose counter plus all that was
    taken from it stays below `least` is let go in the end. The masses come first: one number for each cell.
    """

    def summary(table: pa.Table) -> pa.Table:
        capacity = int(np.sum(table.column("mass").to_numpy())) // least + 1
        keys, counts, lost = np.empty(0, np.uint64), np.empty(0, np.int64), 0
        wait_k, wait_n, size = [], [], 0

        def merge() -> None:
            nonlocal keys, counts, lost, wait_k, wait_n, size
            keys, counts, taken = merged(np.concatenate([keys, *wait_k]), np.concatenate([counts, *wait_n]), capacity)
            lost += taken
            wait_k, wait_n, size = [], [], 0

        for k, n in zip(table.column("keys"), table.column("counts")):
            wait_k.append(np.frombuffer(k.as_buffer(), np.uint64))
            wait_n.append(np.frombuffer(n.as_buffer(), np.uint32).astype(np.int64))
            size += len(wait_k[-1])
            if size > max(capacity, 1 << 16):
                merge()
        merge()
        return pa.table({"hash": keys[counts + lost >= least].view(np.int64)})

    return cells.groupBy("part").applyInArrow(summary, "hash long")


def bitmap(hashes: DataFrame) -> Broadcast:
    """A bitmap of 2**BITS bits with the bit of each hash set, for all tasks: its size doesn't depend on the data."""
    at = F.shiftrightunsigned("hash", 64 - BITS)
    rows = hashes.groupBy(F.shiftright(at, 15).alias("_page")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit((1 << 15) - 1))).alias("_bits"))
    out = np.zeros(1 << (BITS - 3), np.uint8)
    for page, bits in rows.collect():
        out[page << 12 : (page << 12) + len(bits)] = np.frombuffer(bits, np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(out)


def phrase_counts(docs: DataFrame, text: str, lang: str, least: int, longest: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of all phrases of 1 to `longest` words that occur `least` times or more in their language,
    and (lang, n) of all languages."""
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(lang), F.lit("und")).alias("lang"))
    words = written(texts.mapInArrow(count_words, WORDS).groupBy("lang", "phrase", "size", "hash").agg(F.sum("n").alias("f")), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = words.where(F.col("f") >= least)
    if longest < 2:
        return frequent.drop("hash"), totals
    mass = words.agg(F.sum("f")).first()[0] or 0
    parts = lambda sizes: max(partitions(docs.sparkSession), -(-mass * sizes // MOST_MASS))
    single = bitmap(frequent)

    def pairs(chunk: Chunk) -> Iterator[np.ndarray]:
        yield chunk.grams(2)[possible(chunk, 2, single.value)]

    two = bitmap(survivors(texts.mapInArrow(summarise(pairs, parts(1)), CELLS), least))

    def more(chunk: Chunk) -> Iterator[np.ndarray]:
        for size in range(3, longest + 1):
            yield chunk.grams(size)[possible_longer(chunk, size, two.value)]

    long = bitmap(survivors(texts.mapInArrow(summarise(more, parts(longest - 2)), CELLS), least)) if longest > 2 else two

    n_parts = parts(longest - 1)

    def cells(rows: pa.RecordBatch) -> pa.RecordBatch:
        at = cuts(rows.column("hash").to_numpy().view(np.uint64), n_parts)
        full = np.flatnonzero(at[1:] > at[:-1])
        return pa.record_batch([pa.array(full, pa.int32()), pa.array([_packed(rows.slice(at[p], at[p + 1] - at[p])) for p in full], pa.binary())], names=["part", "rows"])

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for chunk in chunks(batches):
            for size in range(2, longest + 1):
                bits = two if size == 2 else long
                tally.add(chunk, size, possible_longer(chunk, size, two.value) & has(bits.value, chunk.grams(size)))
            if len(tally.count) > PHRASES:
                yield cells(tally.rows())
        yield cells(tally.rows())

    def add_up(table: pa.Table) -> pa.Table:
        rows = pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in table.column("rows")])
        sums = rows.group_by(["lang", "phrase", "size"]).aggregate([("n", "sum")]).rename_columns(["lang", "phrase", "size", "f"])
        return sums.filter(pc.greater_equal(sums.column("f"), least))

    grams = texts.mapInArrow(count_grams, "part int, rows binary").groupBy("part").applyInArrow(add_up, "lang string, phrase string, size int, f long")
    return written(frequent.drop("hash").unionByName(grams), "phrases"), totals


def _packed(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, longest: int = 5, top: int = 2000, percent: int = 100) -> DataFrame:
    """The `top` collocations of each language: phrases of 2 to `longest` words with `least` occurrences or more.

    Texts are read in four passes, each by tasks that hold a few MB: words are counted exactly; Misra-Gries summaries of
    pairs of frequent words, then of the longer runs of such pairs, are merged for each hash partition and leave all
    n-grams that may be frequent; those are counted exactly. What a pass leaves goes to the next as a bitmap of 16 MB,
    which may let through more than it should and never less; so the counts don't depend on it.

    a, l, r and n are the occurrences of the phrase, of its two parts at the cut with the smallest score (ties to the
    smaller first part) and of all words of the language, score is floor(1000 * a * n / (l * r)) in decimals of 38
    digits. A phrase within a longer one that has at least `percent` of its occurrences is dropped. Order: score and a
    descending, then the phrase's UTF-8 bytes.

    Returns lang, rank (from 1), phrase, a, l, r, n, score. A null language is ``und``; a null text is empty; repeated
    rows count each; an empty table gives an empty result; other columns of docs are ignored, whatever their names.
    """
    counts, totals = phrase_counts(docs, text, lang, least, longest)
    words = F.split("phrase", " ")
    found = counts.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), words.alias("w"))
    part = lambda at, n: F.array_join(F.slice("w", at, n), " ")
    cut = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cut = cut.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("_left"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("_right"))
    side = lambda name, f: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cut = cut.join(side("_left", "l"), ["lang", "_left"]).join(side("_right", "r"), ["lang", "_right"]).join(totals, "lang")
    score = F.expr("(cast(1000 as decimal(38,0)) * a * n) div (cast(l as decimal(38,0)) * r)")
    best = cut.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(F.slice("w", i, m), " "))))
    longer = found.where("size > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(F.coalesce(F.col("_longer") * 100 < F.col("a") * percent, F.lit(True)))
    kept = kept.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # First within parts of a language, so that no task sorts all its phrases.
    few = kept.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
