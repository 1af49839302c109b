"""Operator 2: SimHash fingerprints of word shingles, and near-duplicate groups by BK-trees of shards."""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, log2, pi, sqrt

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, mix, partitions, through_pandas, written
from .components import components

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Rows of a shard task, about; a task holds the trees of many shards.
TASK_ROWS = 50_000
#: Pairs (query, tree node) that are looked at in one step of the search.
STEP_PAIRS = 1_000_000
#: For documents of a given similarity: fingerprints of PARTS * 64 bits, dealt by samples of at least SAMPLED of their bits, so
#: many that a shard holds about ROWS_A_SHARD unrelated fingerprints, and by as many samples as give RECALL.
NEAR_SHINGLE, SIMILARITY, PARTS, SAMPLED, ROWS_A_SHARD, RECALL = 5, 0.8, 4, 16, 100, 0.97
#: Samples, and bits of each, by which a document first finds a leader of its family.
LEADER_TABLES, LEADER_BITS = 12, 32
#: Fingerprints that a shard may hold in one task; a shard with more is searched in pairs of blocks of that size.
MOST_SHARD, MOST_BLOCKS = 250_000, 1 << 10
#: Nearest partners that a document names over all its shards; what is beyond them is left to the join.
NAMED = 8

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """XXH64 of each k-word shingle of the lower-cased text (of all its words together, if they are fewer)."""
    words = text.encode().translate(_LOWER).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1].tolist()
    digest, seed = xxhash.xxh64_intdigest, SEED
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[k - 1 :].tolist())), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """The signed 64-bit number whose bit i is 1 if bit i is set in over half of the hashes."""
    if not len(hashes):
        return 0
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        count += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view(np.int64)[0])


def wide_fingerprint(hashes: np.ndarray, parts: int = PARTS) -> list[int]:
    """Independent fingerprints of the distinct hashes, each of them mixed anew."""
    distinct = np.unique(hashes)
    with np.errstate(over="ignore"):
        return [fingerprint(mix(distinct + np.uint64(i) * np.uint64(0x9E3779B97F4A7C15))) for i in range(parts)]


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE) -> DataFrame:
    """key and fp (signed 64-bit fingerprint) of every row of docs."""
    kind = docs.schema[key].dataType.simpleString()

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf["key"], "fp": np.array([fingerprint(shingle_hashes(t, k)) for t in pdf["text"]], np.int64)})

    sent, as_ = through_pandas(key, kind)
    return docs.select(sent.alias("key"), F.col(text).alias("text")).mapInPandas(measure, f"`{key}` {as_}, fp long").withColumn(key, F.col(key).cast(kind))


class Forest:
    """BK-trees, one for each group of values, built level by level for all groups at once.

    A value (a row of 64-bit words) goes down from the root of its group: at each node it takes the edge named by its
    Hamming distance to that node. child holds node * span + distance of every edge, in ascending order, and end the
    node that it leads to; span is one more than the largest distance.
    """

    def __init__(self, groups: np.ndarray, values: np.ndarray):
        self.values = values = values.reshape(len(values), -1)
        self.span = 64 * values.shape[1] + 1
        names, place = np.unique(groups, return_inverse=True)
        self.root_of = np.empty(len(names), np.int64)
        edges, ends = [], []
        left = np.arange(len(values))
        first = True
        while len(left):
            _, at, place = np.unique(place, return_index=True, return_inverse=True)
            nodes = left[at]  # the first value that comes to a place becomes its node
            if first:
                self.root_of, first = nodes, False
                self.group = place.copy()
            else:
                edges.append(key[at])
                ends.append(nodes)
            rest = np.ones(len(left), bool)
            rest[at] = False
            node, left = nodes[place[rest]], left[rest]
            key = node * self.span + self.distance(left, node)
            place = key
        edge, end = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (edges, ends))
        order = np.argsort(edge)
        self.child, self.end = edge[order], end[order]

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.values[a] ^ self.values[b]).sum(1, dtype=np.int64)

    def near(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, found) index pairs of values of the same group at most radius apart, in parts."""
        todo = [(queries, self.root_of[self.group[queries]])]
        while todo:
            q, node = todo.pop()
            if len(q) > STEP_PAIRS:
                half = len(q) // 2
                todo += [(q[:half], node[:half]), (q[half:], node[half:])]
                continue
            d = self.distance(q, node)
            hit = (d <= radius) & (q != node)
            if hit.any():
                yield q[hit], node[hit]
            if not len(self.child):
                continue
            low = np.searchsorted(self.child, node * self.span + np.maximum(d - radius, 0))
            high = np.searchsorted(self.child, node * self.span + np.minimum(d + radius, self.span - 1), side="right")
            n = high - low
            if n.any():
                at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
                todo.append((np.repeat(q, n), self.end[at]))


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the groups of a[i] and b[i]; label leads each element to the smallest of its group, perhaps in steps."""
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, after := label[label]):
            label[:] = after


def shard_links(groups: np.ndarray, values: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places (of a value, of the first value of its part) that connect all values of the same group within radius."""
    order = np.argsort(groups, kind="stable")
    of = groups[order]
    alone = np.concatenate(([True], of[1:] != of[:-1])) & np.concatenate((of[1:] != of[:-1], [True])) if len(of) else np.empty(0, bool)
    order = order[~alone]
    if not len(order):
        return order, order
    forest, label = Forest(groups[order], values[order].view(np.uint64)), np.arange(len(order))
    for at in range(0, len(order), 20_000):
        for q, found in forest.near(np.arange(at, min(at + 20_000, len(order))), radius):
            _merge(label, q, found)
    linked = label != np.arange(len(order))
    return order[linked], order[label[linked]]


def links(fps: DataFrame, radius: int = RADIUS, shard_rows: int = MOST_SHARD) -> DataFrame:
    """Links (u, v) between the distinct fingerprints in column fp that connect all those at most radius bits apart.

    Two fingerprints that differ in at most `radius` bits agree in at least one of radius + 1 equal parts. So each part
    with its value names a shard; a fingerprint is dealt to one shard of each part, and every shard has a BK-tree of its
    own. The trees stay where their shard is and its queries come to them (broadcasting all trees would grow with the
    corpus). A shard with more than `shard_rows` fingerprints is dealt once more, by equal parts of the bits that are left,
    and for the same reason loses no pair. A shard returns a spanning forest of its pairs, so never more rows than it has
    members.
    """
    parts = radius + 1
    width = 64 // parts
    distinct = fps.select("fp").distinct()
    spark, n = fps.sparkSession, distinct.count()
    tasks = max(4 * partitions(spark), n * parts // TASK_ROWS)
    pieces = [F.shiftrightunsigned("fp", i * width).bitwiseAND((1 << width) - 1) for i in range(parts)]
    dealt = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("part"), p.alias("value")) for i, p in enumerate(pieces)])).alias("s")).select("fp", "s.*")
    whole = dealt.withColumn("shard", F.xxhash64("part", "value"))
    if n > shard_rows:
        hot = cut(dealt.groupBy("part", "value").count().where(F.col("count") > shard_rows).drop("count"))
        if not hot.isEmpty():
            sub = 64 - width
            left = F.aggregate(F.filter(F.array(*pieces), lambda _, i: i != F.col("part")), F.lit(0).cast("long"), lambda a, p: F.shiftleft(a, width) + p)
            again = [F.struct(F.lit(i).alias("sub"), F.shiftrightunsigned(left, i * (sub // parts)).bitwiseAND((1 << sub // parts) - 1).alias("rest")) for i in range(parts)]
            deep = dealt.join(hot, ["part", "value"], "left_semi").select("fp", "part", "value", F.explode(F.array(*again)).alias("s")).select("fp", F.xxhash64("part", "value", "s.sub", "s.rest").alias("shard"))
            whole = dealt.join(hot, ["part", "value"], "left_anti").select("fp", F.xxhash64("part", "value").alias("shard")).unionByName(deep)
    dealt = whole.select("fp", "shard", F.pmod(F.xxhash64("shard"), F.lit(tasks)).alias("task"))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = pdf["fp"].to_numpy(np.int64)
        u, v = shard_links(pdf["shard"].to_numpy(np.int64), fp, radius)
        return pd.DataFrame({"u": fp[u], "v": fp[v]})

    return dealt.groupBy("task").applyInPandas(search, "u long, v long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Groups the documents whose SimHash fingerprints are linked by steps of at most `radius` differing bits.

    Returns key, fingerprint (16 lower-case hex digits) and component_id, the smallest key that can be reached. Texts
    are lower-cased (A-Z), cut into words at white space and shingled whole; a text with fewer words than k is one
    shingle; a null or empty text, or one of white space, has fingerprint zero and is linked like any other. Rows with
    a null key are grouped too, but never name a component unless it has no other key (then it is null). Repeated rows
    stay; an empty table gives an empty result; other columns of docs are ignored.
    """
    fps = cut(fingerprints(docs, key, text, k))
    nodes = fps.groupBy("fp").agg(F.min(key).alias("least"))
    roots = components(links(nodes, radius)).withColumnsRenamed({"node": "fp"})
    placed = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of = placed.select("fp", "root").join(named, "root").select("fp", "component_id")
    return fps.join(of, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def radius_of(similarity: float, bits: int) -> int:
    """Bits in which the fingerprints of two sets with a Jaccard similarity may differ: each of them does with the angle of
    the sets over pi, and two standard deviations are allowed on top."""
    p = acos(2 * similarity / (1 + similarity)) / pi
    return round(bits * p + 2 * sqrt(bits * p * (1 - p)))


def tables_for(similarity: float, sampled: int, recall: float = RECALL) -> int:
    """How many samples of `sampled` bits are needed for a pair of that similarity to meet in one of them with probability `recall`."""
    p = acos(2 * similarity / (1 + similarity)) / pi
    return ceil(log(1 - recall) / log(1 - (1 - p) ** sampled))


def shard_pairs(groups: np.ndarray, values: np.ndarray, parts: np.ndarray, radius: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of places that each value names, and the places of pairs that are left for a later search.

    Pairs are of the same group, of different parts and within radius. Of each part of a group `most` values ask, but for
    the largest part, as the other end of its pairs asks. A value that asks names `most` of its partners: first the
    nearest one of every part, then the second nearest ones, and so on (ties: the first). Of a pair that was found and
    isn't named, both ends are left; so are all values that didn't ask, if those of a group are of several parts.
    """
    order = np.lexsort((parts, groups))
    of, part = groups[order], parts[order]
    new = np.concatenate(([True], of[1:] != of[:-1])) if len(of) else np.empty(0, bool)
    new_part = new | np.concatenate(([True], part[1:] != part[:-1])) if len(of) else new
    several = np.bincount((np.cumsum(new) - 1)[new_part & ~new], minlength=new.sum())[np.cumsum(new) - 1] > 0 if len(of) else new
    order, of, part = order[several], of[several], part[several]  # a group of one part has no pair
    if not len(order):
        return order, order, order
    _, group, size = np.unique(of, return_inverse=True, return_counts=True)
    new_part = np.concatenate(([True], (of[1:] != of[:-1]) | (part[1:] != part[:-1])))
    run = np.cumsum(new_part) - 1
    in_part, of_run = np.bincount(run), group[new_part]
    largest = np.full(len(size), -1)
    by_size = np.argsort(in_part, kind="stable")
    largest[of_run[by_size]] = by_size
    within = np.arange(len(order)) - np.flatnonzero(new_part)[run]
    asking = (within < most) & ((run != largest[group]) | (in_part[run] == 1))
    asks = np.flatnonzero(asking)
    silent = np.unique(run[~asking])
    silent_parts = np.bincount(of_run[silent], minlength=len(size))
    left = ~asking & (silent_parts[group] > 1)
    forest = Forest(of, values[order].view(np.uint64))
    step = int(np.clip(STEP_PAIRS // 4 // size.max(), 1, 20_000))  # what a step finds is held at once
    named = []
    for at in range(0, len(asks), step):
        met = [(q[other], f[other]) for q, f in forest.near(asks[at : at + step], radius) if (other := run[q] != run[f]).any()]
        if not met:
            continue
        q, f = (np.concatenate(x) for x in zip(*met))
        d = forest.distance(q, f)
        rank = np.zeros(len(q), np.int64)
        if len(in_part) < len(order):
            near = np.lexsort((f, d, run[f], q))
            q, f, d = q[near], f[near], d[near]
            first = np.concatenate(([True], (q[1:] != q[:-1]) | (run[f[1:]] != run[f[:-1]])))
            rank = np.arange(len(q)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        near = np.lexsort((f, d, rank, q))
        q, f = q[near], f[near]
        first = np.concatenate(([True], q[1:] != q[:-1]))
        kept = np.arange(len(q)) - np.flatnonzero(first)[np.cumsum(first) - 1] < most
        named.append((q[kept], f[kept]))
        left[q[~kept]] = left[f[~kept]] = True
    if not named:
        return order[:0], order[:0], order[left]
    u, v = (np.concatenate(x) for x in zip(*named))
    return order[u], order[v], order[left]


def _similar(pairs: DataFrame, docs: DataFrame, key: str, text: str, k: int, similarity: float) -> DataFrame:
    """The pairs (u, v) of keys whose sets of shingles have the similarity, by the whole sets of their hashes, cut to 32 bits."""

    def shingled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"node": pdf["key"], "held": [np.unique(shingle_hashes(t, k).astype(np.uint32)).tobytes() for t in pdf["text"]]})

    def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for a, b in zip(pdf["held_u"], pdf["held_v"]):
                a, b = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both >= similarity * (len(a) + len(b) - both))
            yield pdf.loc[keep, ["u", "v"]]

    named = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    sets = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).join(named, F.col("key") == F.col("node"), "left_semi").mapInPandas(shingled, "node long, held binary")
    sets = cut(sets)
    joined = pairs.join(sets.withColumnsRenamed({"node": "u", "held": "held_u"}), "u").join(sets.withColumnsRenamed({"node": "v", "held": "held_v"}), "v")
    return joined.select("u", "v", "held_u", "held_v").mapInPandas(verified, "u long, v long")


def _leaders(nodes: DataFrame, names: list[str], tables: int = LEADER_TABLES, bits: int = LEADER_BITS) -> DataFrame:
    """(u, v): of each node the smallest node that has the same bits in one of `tables` samples, where that is another one.

    Copies that differ little nearly all find the same leader, whose verified followers are a part from the beginning. So
    however large a family is, it gives a pair for each member, and its members aren't compared with each other.
    """
    samples = np.random.default_rng(11)
    places = [np.sort(samples.choice(64 * len(names), bits, replace=False)) for _ in range(tables)]

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            all_bits = np.unpackbits(np.ascontiguousarray(pdf[names].to_numpy(np.int64)).view(np.uint8), axis=1, bitorder="little")
            for i, at in enumerate(places):
                yield pd.DataFrame({"sample": (i << bits) + all_bits[:, at].astype(np.int64) @ (1 << np.arange(bits)), "node": pdf["node"]})

    dealt = nodes.select("node", *names).mapInPandas(deal, "sample long, node long")
    least = dealt.groupBy("sample").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1")
    return dealt.join(least, "sample").where("node <> leader").groupBy(F.col("node").alias("u")).agg(F.min("leader").alias("v"))


def _joined(docs: DataFrame, members: DataFrame, key: str, text: str, k: int, similarity: float) -> DataFrame:
    """All pairs (u, v) of members (node, part) of different parts that may have the similarity, by an exact join of their sets.

    Shingles are ordered by the number of members that hold them. Of two sets with the similarity each has one of the
    other's shingles among the first n - ceil(similarity * n) + 1 of its own n in this order (prefix filter), neither is
    much larger (length filter), and behind the first shingle that both hold enough are left in both (positional filter).
    What a single member holds comes first and pairs nothing, so a member that differs from all others by enough words of
    its own is out, however many of its shingles it shares with a large family.
    """

    def shingled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 64):
                part = pdf.iloc[at : at + 64]
                sets = [np.unique(shingle_hashes(t, k).astype(np.uint32)).astype(np.int64) for t in part["text"]]
                size = [len(s) for s in sets]
                yield pd.DataFrame({"node": np.repeat(part["key"].to_numpy(np.int64), size), "token": np.concatenate(sets), "n": np.repeat(size, size)})

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).join(members.select(F.col("node").alias("key")), "key", "left_semi")
    tokens = written(rows.mapInPandas(shingled, "node long, token long, n long").distinct(), "shingles")
    several = tokens.groupBy("token").agg(F.count("*").alias("holders")).where("holders > 1")
    held = tokens.join(several, "token").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("holders", "token"))).alias("_held"))
    alone = F.col("n") - F.size("_held")
    first = F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1 - alone
    prefix = held.where(first > 0).join(members, "node").select("node", "part", "n", alone.alias("alone"), F.posexplode(F.slice("_held", F.lit(1), first.cast("int"))["token"]).alias("at", "token"))
    prefix = prefix.select("node", "part", "n", "token", (F.col("n") - F.col("alone") - F.col("at")).alias("rest"))
    other = prefix.select("token", *[F.col(c).alias(f"_{c}") for c in ("node", "part", "n", "rest")])
    able = F.expr(f"node > _node and part <> _part and n >= {similarity}D * _n - 1e-9D and _n >= {similarity}D * n - 1e-9D and least(rest, _rest) >= {similarity / (1 + similarity)}D * (n + _n) - 1e-6D")
    return prefix.join(other, "token").where(able).select(F.col("node").alias("u"), F.col("_node").alias("v")).distinct()


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = NEAR_SHINGLE, similarity: float = SIMILARITY, parts: int = PARTS, sampled: int = SAMPLED, shard_rows: int = MOST_SHARD) -> DataFrame:
    """Groups documents whose sets of k-word shingles have a Jaccard similarity of `similarity` or more.

    Candidates have fingerprints of parts * 64 bits that differ in no more bits than radius_of() gives. Fixed samples of
    their bits deal them to shards with BK-trees; at the least similarity a pair meets in one of them with a probability of
    RECALL, more similar ones almost surely, and what is linked through a third document needn't meet. The bits of a
    sample grow with the logarithm of the corpus, so that shards don't grow with it. First every document names a leader
    (see _leaders()), then the nearest ones of other parts in its shards, NAMED in all; these pairs are verified by the
    similarity of their whole sets, and the verified ones are contracted to parts. Documents that have further partners in a shard (of
    other parts, within the radius) are left over; among these all similar pairs of different parts are found by an exact
    set-similarity join (see _joined()). So a family of copies gives few pairs, and no candidate is given up. A shard with
    more than `shard_rows` fingerprints is searched in pairs of blocks, so no task holds it whole.

    Returns key and component_id, the smallest key that can be reached. Words are those of near_duplicates(). Texts
    without shingle (null, empty, blank) have the same fingerprint and are one group. Rows with a null key
    join the group of an equal set of shingles only, and never name a component that has another key. Repeated rows stay; an empty table gives an empty result.
    """
    kind = docs.schema[key].dataType.simpleString()
    names = [f"f{i}" for i in range(parts)]

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = np.array([wide_fingerprint(shingle_hashes(t, k), parts) for t in pdf["text"]], np.int64).reshape(-1, parts)
            yield pd.DataFrame({"_key": pdf["key"]} | {n: found[:, i] for i, n in enumerate(names)})

    sent, as_ = through_pandas(key, kind)
    schema = f"_key {as_}, " + ", ".join(f"{n} long" for n in names)
    fps = cut(docs.select(sent.alias("key"), F.col(text).alias("text")).mapInPandas(measure, schema).withColumn("_key", F.col("_key").cast(kind)))
    # A distinct fingerprint is named by its smallest key, so the smallest name of a component is its id.
    nodes = cut(fps.groupBy(*names).agg(F.min("_key").cast("long").alias("_least")).withColumn("node", F.coalesce("_least", F.lit(1 << 62) + F.abs(F.xxhash64(*names) % (1 << 60)))))
    n = nodes.count()
    sampled = max(sampled, ceil(log2(max(n, 1) / ROWS_A_SHARD)))
    tables, radius, chosen = tables_for(similarity, sampled), radius_of(similarity, 64 * parts), np.random.default_rng(7)
    bits = [np.sort(chosen.choice(64 * parts, sampled, replace=False)).tolist() for _ in range(tables)]
    tasks = max(4 * partitions(docs.sparkSession), n * tables // TASK_ROWS)

    def shards(pdf: pd.DataFrame) -> Iterator[np.ndarray]:
        all_bits = np.unpackbits(np.ascontiguousarray(pdf[names].to_numpy(np.int64)).view(np.uint8), axis=1, bitorder="little")
        for i, places in enumerate(bits):
            yield (i << sampled) + all_bits[:, places].astype(np.int64) @ (1 << np.arange(sampled))

    def only_shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield from (pd.DataFrame({"shard": s}) for s in shards(pdf))

    def search(members: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Of the members (node, fingerprint, part): the pairs (u, v) that they name, and the nodes with pairs that are left."""
        blocks = {}
        if n > shard_rows:
            held = members.select(*names).mapInPandas(only_shards, "shard long").groupBy("shard").count().where(F.col("count") > shard_rows)
            blocks = {r["shard"]: min(MOST_BLOCKS, -(-r["count"] // shard_rows)) for r in held.collect()}  # at most tables * n / shard_rows

        def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for shard in shards(pdf):
                    out = pdf.assign(shard=shard * MOST_BLOCKS * MOST_BLOCKS)
                    if blocks:
                        n_blocks = out["shard"].floordiv(MOST_BLOCKS * MOST_BLOCKS).map(blocks).fillna(1).to_numpy(np.int64)
                        block = pdf["node"].to_numpy(np.int64) * 0x9E3779B1 % 0x7FFFFFFF % n_blocks
                        copy = np.arange(n_blocks.sum()) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)  # the other block
                        block, out = np.repeat(block, n_blocks), out.loc[out.index.repeat(n_blocks)]
                        out["shard"] += np.minimum(block, copy) * MOST_BLOCKS + np.maximum(block, copy)
                    yield out.assign(task=out["shard"].to_numpy(np.int64) % 0x7FFFFFFF * 0x9E3779B1 % tasks)

        def name(pdf: pd.DataFrame) -> pd.DataFrame:
            node = pdf["node"].to_numpy(np.int64)
            values = np.ascontiguousarray(pdf[names].to_numpy(np.int64))
            u, v, left = shard_pairs(pdf["shard"].to_numpy(np.int64), values, pdf["part"].to_numpy(np.int64), radius, 1)
            d = np.bitwise_count(values[u] ^ values[v]).sum(1, dtype=np.int64)
            # A node that is left comes as a pair with itself.
            return pd.DataFrame({"u": np.concatenate((node[u], node[left])), "v": np.concatenate((node[v], node[left])), "d": np.concatenate((d, np.zeros(len(left), np.int64)))}).drop_duplicates()

        columns = ", ".join(f"{n} long" for n in ("node", *names, "part", "shard", "task"))
        dealt = members.select("node", *names, "part").mapInPandas(deal, columns)
        found = cut(dealt.groupBy("task").applyInPandas(name, "u long, v long, d long").distinct())
        ranked = found.where("u <> v").withColumn("rank", F.row_number().over(Window.partitionBy("u").orderBy("d", "v")))  # a row for each table at most
        beyond = ranked.where(F.col("rank") > NAMED)
        left = found.where("u = v").select(F.col("u").alias("node")).unionByName(beyond.select(F.col("u").alias("node"))).unionByName(beyond.select(F.col("v").alias("node")))
        named = ranked.where(F.col("rank") <= NAMED).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        return named.distinct(), left.distinct()

    tried = cut(_leaders(nodes, names))
    alike = cut(_similar(tried, docs, key, text, k, similarity))
    roots = components(alike)
    of_parts = lambda: nodes.join(roots, "node", "left").withColumn("part", F.coalesce("root", "node"))
    named, left = search(of_parts())
    for step in range(2):
        fresh = cut(named.join(tried, ["u", "v"], "left_anti"))
        alike, tried = cut(_similar(fresh, docs, key, text, k, similarity)), tried.unionByName(fresh)
        if not alike.isEmpty():
            roots = components(alike.unionByName(roots.toDF("u", "v")))
        if step or left.isEmpty():
            break
        named = _joined(docs, of_parts().join(left, "node").select("node", "part"), key, text, k, similarity)
    roots = roots.withColumnRenamed("root", "component")
    root = F.coalesce("component", "node")
    named = nodes.join(roots, "node", "left").select(*names, F.when(root < (1 << 62), root).cast(kind).alias("component_id"))
    return fps.join(named, names).select(F.col("_key").alias(key), "component_id")


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """One row of docs for each group of similar documents (see similar_documents()): that with the smallest key.

    Only keys are joined, not texts. Rows with a null key stay, as no key names them; of rows with the same key one stays.
    """
    found = cut(similar_documents(docs, key, text, **limits))
    kept = docs.join(found.where(F.col(key) != F.col("component_id")).select(key).distinct(), key, "left_anti").select(*docs.columns)
    twins = cut(found.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key))
    if twins.isEmpty():
        return kept
    return kept.join(twins, key, "left_anti").select(*docs.columns).unionByName(kept.join(twins, key, "left_semi").select(*docs.columns).dropDuplicates([key]))
