"""Operator 9: quality rules, and an isolation forest over their statistics with a threshold from labelled rows."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import through_pandas

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = re.compile(r"[#*$%&|<>]")

LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words

#: Labelled rows that the forest and its threshold are fitted on, at most; the smallest hashes of doc_id are taken.
SAMPLE = 4000
TREES, SUBSAMPLE = 200, 256
#: Share of good labelled rows that the threshold may reject.
FALSE_REJECTS = 0.01

STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Shares up to which repetition is usual in good text, and so no sign of an anomaly.
USUAL_REPEATS = 0.25


def statistics(text: str | None) -> list[float]:
    """The five counts of the contract, then the features of the forest."""
    words = WORDS.findall(text) if text else []
    n = len(words)
    chars = sum(map(len, words))
    symbols = len(SYMBOLS.findall(text)) if text else 0
    seen: set[str] = set()
    n_lines = dup_lines = 0
    for line in text.split("\n") if text else ():
        if WORDS.search(line):
            n_lines += 1
            dup_lines += line in seen
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    repeated = 0
    if len(counts) < len(windows):
        hit = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows))
        mark = np.zeros(n, bool)
        for k in range(3):
            mark[k : k + len(hit)] |= hit
        repeated = int(mark.sum())
    m = max(n, 1)
    features = [
        min(symbols / m, 1.0),
        max(repeated / m - USUAL_REPEATS, 0.0),
        max(dup_lines / max(n_lines, 1) - USUAL_REPEATS, 0.0),
        min(abs(chars / m - 5.2), 5.0),
        sum(map(str.isupper, words)) / m,
        min(text.count("!") / m, 1.0) if text else 0.0,
        sum(len(w) > 12 for w in words) / m,
    ]
    return [n, chars, symbols, dup_lines, repeated, *features]


def _harmonic(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n
    return np.where(n > 2, out, np.where(n == 2, 1.0, 0.0))


def grow(rows: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 7) -> list[tuple]:
    """Isolation trees as arrays (feature, split, left child, right child, leaf value).

    A node splits a random feature at a random place of the range that its own rows have or, every other time, of the
    range from low to high that all labelled rows have: so a row is isolated early too by a feature that never varies
    among the rows of the tree. A leaf's value is its depth plus the mean path length of the rows that it still holds.
    """
    rng = np.random.default_rng(seed)
    forest = []
    deepest = int(np.ceil(np.log2(max(2, min(subsample, len(rows))))))
    for _ in range(trees):
        part = rows[rng.choice(len(rows), min(subsample, len(rows)), replace=False)]
        nodes: list[list[float]] = []
        todo = [(part, 0, -1, 0, low, high)]
        while todo:
            held, depth, parent, side, least, most = todo.pop()
            at = len(nodes)
            if parent >= 0:
                nodes[parent][2 + side] = at
            wide = rng.random() < 0.5
            a, b = (least, most) if wide or not len(held) else (held.min(0), held.max(0))
            open_ = np.flatnonzero(b > a)
            if depth >= deepest or len(held) < 2 or not len(open_):
                nodes.append([-1, 0.0, at, at, depth + float(_harmonic(len(held)))])
                continue
            f = rng.choice(open_)
            split = rng.uniform(a[f], b[f])
            nodes.append([f, split, 0, 0, 0.0])
            less = held[:, f] <= split
            under, over = most.copy(), least.copy()
            under[f], over[f] = min(most[f], split), max(least[f], split)
            todo += [(held[less], depth + 1, at, 0, least, under), (held[~less], depth + 1, at, 1, over, most)]
        forest.append(tuple(np.array(c) for c in zip(*nodes)))
    return forest


def anomaly(forest: list[tuple], rows: np.ndarray, subsample: int = SUBSAMPLE) -> np.ndarray:
    """2 ** -(mean path length / expected path length): near 1 for rows that few splits isolate."""
    total = np.zeros(len(rows))
    index = np.arange(len(rows))
    for feature, split, left, right, value in forest:
        feature, left, right = feature.astype(int), left.astype(int), right.astype(int)
        at = np.zeros(len(rows), int)
        while (inner := feature[at] >= 0).any():
            f = np.maximum(feature[at], 0)
            down = np.where(rows[index, f] <= split[at], left[at], right[at])
            at = np.where(inner, down, at)
        total += value[at]
    return 2.0 ** -(total / max(len(forest), 1) / float(max(_harmonic(subsample), 1e-9)))


def _measured(docs: DataFrame, key: str, text: str) -> DataFrame:
    names = [key, *STATISTICS, "features"]
    kind = docs.schema[key].dataType.simpleString()

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [statistics(t) for t in pdf["text"]]
            out = {n: [int(x[i]) for x in found] for i, n in enumerate(STATISTICS)}
            yield pd.DataFrame({key: pdf["key"], **out, "features": [x[len(STATISTICS) :] for x in found]}, columns=names)

    sent, as_ = through_pandas(key, kind)
    schema = f"`{key}` {as_}, " + ", ".join(f"{n} long" for n in STATISTICS) + ", features array<double>"
    return docs.select(sent.alias("key"), F.col(text).alias("text")).mapInPandas(measure, schema).withColumn(key, F.col(key).cast(kind))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, false_rejects: float = FALSE_REJECTS) -> tuple[list[tuple], float]:
    """The forest and its threshold, from at most `sample` labelled rows, chosen by the hash of their key; of rows of docs
    with the same key the smallest text counts.

    The trees are grown on the good rows, so that what is unlike them is isolated early. The threshold is the lowest
    score that at most `false_rejects` of the good rows exceed. Without good labelled rows there is no forest and nothing is anomalous.
    """
    chosen = labels.where(F.col(key).isNotNull() & F.col("quality").isNotNull()).groupBy(key).agg(F.min("quality").alias("_quality")).orderBy(F.xxhash64(key), key).limit(sample)
    picked = docs.select(F.col(key), F.col(text)).join(F.broadcast(chosen.select(key)), key, "left_semi").groupBy(key).agg(F.min(text).alias(text))
    measured = _measured(picked, key, text).join(F.broadcast(chosen), key).select("n_words", "features", "_quality").orderBy(F.xxhash64(key), key).toPandas()  # `sample` rows at most
    if not len(measured) or not (measured["_quality"] == 1).any():
        return [], 2.0
    rows, good = np.array(measured["features"].tolist(), float), (measured["_quality"] == 1).to_numpy()
    long = (measured["n_words"] >= LEAST_WORDS).to_numpy()
    use = good & long if (good & long).sum() >= 2 else good
    forest = grow(rows[use], rows.min(0), rows.max(0))
    score = anomaly(forest, rows)
    return forest, float(np.quantile(score[use], 1 - false_rejects))


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", fitted: tuple[list[tuple], float] | None = None) -> DataFrame:
    """Statistics and verdict of every document, from its whole text.

    base_failed: fewer than 50 words, or over half of the words stand in repeated 3-word windows. kept: not base_failed
    and the isolation forest's score is not above the threshold that fit() takes from the labelled rows.

    Returns key, the five statistics, base_failed, anomaly and kept. A null text has no words (base_failed); null keys
    and repeated rows are judged like any other; an empty table gives an empty result; without labels only the base
    rules judge; other columns of docs and labels are ignored.
    """
    forest, threshold = fit(docs, labels, key, text) if fitted is None else fitted
    sent = docs.sparkSession.sparkContext.broadcast((forest, threshold))  # TREES * 2 * SUBSAMPLE nodes at most
    kind = docs.schema[key].dataType.simpleString()

    def verdict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest, threshold = sent.value
        for pdf in batches:
            found = np.array([statistics(t) for t in pdf["text"]], float).reshape(len(pdf), -1)
            n_words, repeated = found[:, 0], found[:, 4]
            failed = (n_words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n_words)
            score = anomaly(forest, found[:, len(STATISTICS) :]) if forest and len(pdf) else np.zeros(len(pdf))
            out = {n: found[:, i].astype(np.int64) for i, n in enumerate(STATISTICS)}
            yield pd.DataFrame({key: pdf["key"], **out, "base_failed": failed, "anomaly": score, "kept": ~failed & (score <= threshold)})

    name, as_ = through_pandas(key, kind)
    schema = f"`{key}` {as_}, " + ", ".join(f"{n} long" for n in STATISTICS) + ", base_failed boolean, anomaly double, kept boolean"
    return docs.select(name.alias("key"), F.col(text).alias("text")).mapInPandas(verdict, schema).withColumn(key, F.col(key).cast(kind))


def kept(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns; only the texts go through Python."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, key, text))

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        forest, threshold = sent.value
        found = np.array([statistics(t) for t in texts], float).reshape(len(texts), -1)
        failed = (found[:, 0] < LEAST_WORDS) | (100 * found[:, 4] > MOST_REPEATED * found[:, 0])
        score = anomaly(forest, found[:, len(STATISTICS) :]) if forest and len(texts) else np.zeros(len(texts))
        return pd.Series(~failed & (score <= threshold))

    return docs.where(good(F.col(text)))
