"""Collocations, the digest index and hard negatives: against plain versions, on nulls, ties, repeated rows and clashing names."""

import math
import random
import re
from collections import Counter
from fractions import Fraction
from hashlib import sha256
from uuid import uuid4

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakemetrics.llm import collocations, exact_dedup, hard_negatives
from lakemetrics.llm.common import join_sized, shared_dir

LOWER = str.maketrans(exact_dedup.UPPER, exact_dedup.LOWER)


# 11 collocations


def plain_collocations(rows, least, longest, top, percent=100):
    """(lang, rank, phrase, a, l, r, n, score) by counting every phrase."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    often = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = []
    for (lang, w), a in often.items():
        if any(lang == other and len(v) > len(w) and percent * a <= 100 * b and any(v[i : i + len(w)] == w for i in range(len(v))) for (other, v), b in often.items()):
            continue
        cut = [(math.floor(Fraction(1000 * a * n[lang], f[lang, w[:k]] * f[lang, w[k:]])), k) for k in range(1, len(w))]
        score, k = min(cut)
        out.append((lang, " ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
    out.sort(key=lambda x: (x[0], -x[6], -x[2], x[1].encode()))
    rank = Counter()
    found = []
    for lang, *rest in out:
        rank[lang] += 1
        if rank[lang] <= top:
            found.append((lang, rank[lang], *rest))
    return found


def texts(seed, n=120):
    rng = random.Random(seed)
    words = ["a", "B", "b", "É", "é", "new", "york", "x y", "K", "of", "the", "City"]
    gap = lambda: rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " ;"])
    rows = [("".join(rng.choice(words) + gap() for _ in range(rng.randint(0, 60))) + rng.choice(["", "new york city of the"]), rng.choice(["en", "fr", None, "und"])) for _ in range(n)]
    return rows + [(None, "en"), ("", None), (" \t\n", "de"), ("?!", "en"), *[("one two three one two three one two", "en")] * 9]


@pytest.mark.parametrize(("least", "longest", "percent"), [(10, 5, 100), (1, 3, 100), (6, 4, 70), (5, 2, 100), (10**6, 5, 100)])
def test_collocations_equal_plain_counts(spark, least, longest, percent):
    rows = texts(least)
    docs = spark.createDataFrame([(t, x, 1, 2) for t, x in rows], "text string, lang string, n int, rank int").repartition(5)
    found = collocations.mine(docs, least=least, longest=longest, top=50, percent=percent)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == sorted(plain_collocations(rows, least, longest, 50, percent))


def test_collocations_with_many_hash_partitions(spark, monkeypatch):
    rows = texts(77, 200)
    monkeypatch.setattr(collocations, "MOST_MASS", 400)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    words = collocations.phrase_counts(docs, "text", "lang", 12, 5)[0]
    assert {r["size"] for r in words.select("size").distinct().collect()} == {1, 2, 3, 4, 5}
    assert sorted(map(tuple, collocations.mine(docs, least=12).collect())) == sorted(plain_collocations(rows, 12, 5, 2000))


def test_scores_beyond_64_bits_are_exact(spark):
    big = 3 * 10**15
    one = spark.range(1).select(F.lit(big).alias("a"), F.lit(big * 1000).alias("n"), F.lit(big + 7).alias("l"), F.lit(big + 11).alias("r"))
    got = one.select(F.expr("(cast(1000 as decimal(38,0)) * a * n) div (cast(l as decimal(38,0)) * r)")).first()[0]
    assert got == 1000 * big * big * 1000 // ((big + 7) * (big + 11))


def test_collocations_of_an_empty_table(spark):
    assert collocations.mine(spark.createDataFrame([], "text string, lang string")).count() == 0


def test_summaries_keep_every_frequent_key():
    rng = np.random.default_rng(5)
    for least in (2, 7, 40):
        stream = np.concatenate((rng.integers(0, 4000, 6000), rng.zipf(1.4, 6000) % 4000)).astype(np.uint64)
        rng.shuffle(stream)
        capacity = len(stream) // least + 1
        keys, counts, lost = np.empty(0, np.uint64), np.empty(0, np.int64), 0
        for part in np.array_split(stream, 37):
            keys, counts, taken = collocations.merged(np.concatenate((keys, part)), np.concatenate((counts, np.ones(len(part), np.int64))), capacity)
            lost += taken
            assert len(keys) <= capacity
        true = Counter(stream.tolist())
        kept = dict(zip(keys.tolist(), counts.tolist()))
        assert lost < least and all(k in kept and v - lost <= kept[k] <= v for k, v in true.items() if v >= least)


# 12 exact dedup


def plain_dedup(rows):
    groups = {}
    for key, text in rows:
        groups.setdefault((text or "").translate(LOWER), []).append(key)
    small = lambda k: (k is not None, k or 0)
    keep = {t: max(keys, key=small) for t, keys in groups.items()}
    return groups, keep


def odd_documents(seed=1, n=300):
    rng = random.Random(seed)
    base = ["", None, "Same TEXT", "same text", "SAME text ", "Kelvin", "kelvin", "KÉ", "ké", "İx", "x" * 70_000, *[f"doc {i}" for i in range(60)]]
    rows = [(i, rng.choice(base)) for i in rng.sample(range(10_000), n)]
    return rows + [(None, "same text"), (None, "alone"), (None, "alone"), (None, None), (5, "twice"), (5, "twice"), (5, "Twice"), *[(i, "hot") for i in range(20_000, 20_400)]]


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_exact_dedup_equals_plain_groups(spark, batches):
    rows = odd_documents(batches)
    docs = spark.createDataFrame([(k, t, 1, "d") for k, t in rows], "doc_id long, text string, row int, digest string").repartition(4)
    found = exact_dedup.dedup(docs, batches=batches)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    groups, keep = plain_dedup(rows)
    expected = Counter((k, keep[x := (t or "").translate(LOWER)], len(groups[x]), sha256(x.encode()).hexdigest()) for k, t in rows)
    got = found.collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == expected
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept) and len({r["text_sha256"] for r in kept}) == len(groups)


def test_index_outlives_its_session_state_and_takes_new_data(spark):
    path = f"{shared_dir(spark)}/index-{uuid4().hex}"
    rows = [(i, f"text {i % 70}") for i in range(200)]
    first = exact_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string"))
    exact_dedup.DigestIndex(spark, path, buckets=3).add(first, 0)
    again = exact_dedup.DigestIndex(spark, path)
    assert again.buckets == 3 and list(again.batches()) == [0]
    more = [(1000 + i, f"TEXT {i}") for i in range(60, 90)]
    second = exact_dedup.digests(spark.createDataFrame(more, "doc_id long, text string"))
    with pytest.raises(ValueError, match="already"):
        again.add(second, 0)
    again.add(second, 1)
    got = {r["key"]: r for r in again.resolve(second).collect()}
    for key, text in more:
        old = [k for k, t in rows if t == text.lower()]
        assert got[key]["keep_key"] == (max(old) if old else key) and got[key]["group_size"] == len(old) + 1
    held = again.entries().where("fresh")
    assert held.count() == held.select("digest").distinct().count() == 90


def test_the_index_is_joined_in_its_buckets(spark):
    index = exact_dedup.DigestIndex(spark, f"{shared_dir(spark)}/index-{uuid4().hex}")
    rows = exact_dedup.digests(spark.createDataFrame([(i, str(i)) for i in range(100)], "doc_id long, text string"))
    index.add(rows, 0)
    held = index.entries().where("fresh").select("digest").hint("merge")
    plan = rows.join(held, "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1


def test_an_interrupted_batch_is_not_read(spark, monkeypatch):
    index = exact_dedup.DigestIndex(spark, f"{shared_dir(spark)}/index-{uuid4().hex}")
    rows = exact_dedup.digests(spark.createDataFrame([(i, str(i % 5)) for i in range(20)], "doc_id long, text string"))
    real = spark.createDataFrame

    def fails(*_a, **_k):
        raise RuntimeError("lost")

    monkeypatch.setattr(spark, "createDataFrame", fails)
    with pytest.raises(RuntimeError, match="lost"):
        index.add(rows, 0)
    monkeypatch.setattr(spark, "createDataFrame", real)
    assert index.batches() == {} and index.entries().count() == 0
    index.add(rows, 0)
    assert {r["group_size"] for r in index.resolve(rows).collect()} == {4}


def test_exact_dedup_of_an_empty_table(spark):
    assert exact_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_join_sized_with_a_hot_key(spark):
    rows = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(900)], "k long, v long")
    sizes = rows.groupBy("k").agg(F.count("*").alias("n"))
    got = join_sized(rows, sizes, "k", "n", 900, share=10).select("k", "v", "n").collect()
    count = Counter(0 if i % 3 else i for i in range(900))
    assert sorted(map(tuple, got)) == sorted((0 if i % 3 else i, i, count[0 if i % 3 else i]) for i in range(900))


# 13 hard negatives


def plain_negatives(rows, anchors, positives=5, negatives=10, low=30, high=90):
    usable = {(k, y, tuple(math.floor(256 * e) for e in x)) for k, y, x in rows if None not in (k, y) and x is not None and all(e is not None and math.isfinite(e) for e in x)}
    out = []
    for key, label, x in usable:
        if not anchors(key):
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, z)), k, y) for k, y, z in usable if k != key)
        for s, p, _ in [t for t in scored if t[2] == label][:positives]:
            fit = [(k, -n) for n, k, y in scored if y != label and low * -s <= 100 * -n <= high * -s][:negatives]
            out += [(key, p, i, k, -s, n) for i, (k, n) in enumerate(fit, 1)]
    return sorted(out)


def vectors(seed, n=260, dims=6, labels=4):
    rng = random.Random(seed)
    base = [[rng.gauss(0, 0.5) for _ in range(dims)] for _ in range(12)]
    near = lambda: [np.float32(e + rng.gauss(0, 0.2)).item() for e in rng.choice(base)]
    rows = [(i, rng.randrange(labels), near()) for i in range(n)]
    rows += [(n + i, i % 2, [0.5] * dims) for i in range(30)]  # ties
    rows += [rows[10], rows[10], (10, 1, near()), (n + 40, 3, [0.0] * dims), (20, 2, [0.0] * dims)]
    odd = [None] + [[e] + [0.1] * (dims - 1) for e in (None, math.nan, math.inf, -math.inf)]
    return rows + [(500 + i, 1, x) for i, x in enumerate(odd)] + [(None, 1, near()), (600, None, near())]


@pytest.mark.parametrize("sizes", [(1 << 16, 1 << 11), (40, 16)])
def test_hard_negatives_equal_plain_search(spark, monkeypatch, sizes):
    monkeypatch.setattr(hard_negatives, "MOST", sizes[0])
    monkeypatch.setattr(hard_negatives, "LEAST", sizes[1])
    monkeypatch.setattr(hard_negatives, "STEP", 2)
    rows = vectors(sizes[0])
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, label int, embedding array<float>, id int, x int").repartition(3)
    found = hard_negatives.mine(df, F.col("vec_id") % 10 == 0)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert dict(found.dtypes)["rank"] == "int"
    expected = plain_negatives(rows, lambda k: k % 10 == 0)
    assert len(expected) > 300 and sorted(map(tuple, found.collect())) == expected


def test_the_threshold_stops_early_and_is_exact():
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(5000, 3)) * 200).astype(np.int64)
    lists, met = hard_negatives.Lists(np.arange(5000)[::-1].copy(), np.zeros(5000, np.int64), x), []
    plain = lists.scores
    lists.scores = lambda rows, a: met.append(len(rows)) or plain(rows, a)
    for a in x[:20]:
        met.clear()
        rows, scores = lists.search(a, np.ones(5000, bool), [(-(1 << 62), 1 << 62)], 5)[0]
        order = sorted(range(5000), key=lambda i: (-int(x[i] @ a), lists.ids[i]))[:5]
        assert rows.tolist() == order and scores.tolist() == [int(x[i] @ a) for i in order]
        assert sum(met) < 5000


def test_scores_beyond_doubles_are_exact():
    x = np.array([[1 << 29, 3], [(1 << 29) + 1, -5], [7, 11]])
    lists = hard_negatives.Lists(np.arange(3), np.zeros(3, np.int64), x)
    assert lists.scores(np.arange(3), x[1]).tolist() == [int(a) * ((1 << 29) + 1) + int(b) * -5 for a, b in x.tolist()]
    with pytest.raises(ValueError, match="64 bits"):
        lists.scores(np.arange(3), np.array([1 << 40, 0]))


def test_hard_negatives_of_few_rows(spark):
    schema = "vec_id long, label int, embedding array<float>"
    assert hard_negatives.mine(spark.createDataFrame([], schema), F.col("vec_id") % 100 == 0).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([(0, 1, [1.0]), (1, 2, [1.0])], schema), F.col("vec_id") % 100 == 0).count() == 0
    one = spark.createDataFrame([(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.5]), (3, 2, [0.95])], schema)
    assert [tuple(r) for r in hard_negatives.mine(one, F.col("vec_id") % 100 == 0).collect()] == [(0, 1, 1, 2, 65536, 32768)]
