"""The pipeline's stages on their own inputs."""

import random
import re

import corpus_pipeline
import numpy as np
from lakemetrics.llm import quality_rules, simhash
from lakemetrics.llm.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns and docs.count() > 0
    before, after = kept["quality rules"]
    judged = quality_rules.judge(before, spark.read.parquet(f"{DATA}/labels.parquet"))
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in judged.where("kept").collect()}
    before, after = kept["SimHash near-dedup"]
    rows = sorted((r["doc_id"], set(simhash.shingle_hashes(r["text"], 5).tolist())) for r in before.collect())
    root = {i: i for i, _ in rows}
    for n, (i, a) in enumerate(rows):
        for j, b in rows[:n]:
            if len(a & b) >= 0.8 * len(a | b):
                while root[i] != i:
                    i = root[i]
                while root[j] != j:
                    j = root[j]
                root[max(i, j)] = min(i, j)
    assert {r["doc_id"] for r in after.collect()} == {i for i, r in root.items() if i == r}
    before, after = kept["substring dedup"]
    old = {r["doc_id"]: r["text"] for r in before.collect()}
    seen = set()
    for r in after.orderBy("doc_id").collect():
        windows = set(zip(*[re.findall(r"[^\x20\x09-\x0D]+", old[r["doc_id"]])[k:] for k in range(13)]))
        assert (r["text"] == old[r["doc_id"]]) == (not windows & seen) and r["n_chars"] == len(r["text"])
        seen |= windows
    before, after = kept["benchmark decontamination"]
    items = [set(zip(*[r["text"].lower().split()[k:] for k in range(5)])) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    clean = lambda t: all(len(s & set(zip(*[t.lower().split()[k:] for k in range(5)]))) < 0.8 * len(s) for s in items)
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect() if clean(r["text"])}
    before, after = kept["packing"]
    assert {r["doc_id"] for r in after.select("doc_id").distinct().collect()} == {r["doc_id"] for r in before.collect()}
    assert corpus_pipeline.run(spark, DATA).count() == after.count()


def test_registered(spark):
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)


def test_sql(spark):
    import glob
    import os

    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    for name, sql in ORACLE.items():
        mine = QUERIES[name](spark, DATA)
        c.execute(sql)
        names = [d[0] for d in c.description]
        order = sorted(names)
        assert sorted(mine.columns) == order
        theirs = sorted(str([row[names.index(n)] for n in order]) for row in c.fetchall())
        assert sorted(str([row[n] for n in order]) for row in mine.collect()) == theirs, name


def near_families(rng, base, families, members, run):
    """Texts of families of near copies (one word at the end differs), each family with a run of words of its own."""
    out = []
    for f in range(families):
        at = 20 + 37 * f % (len(base) - run - 40)
        words = base[:at] + [f"f{rng.randint(0, 10**9)}" for _ in range(run)] + base[at + run :]
        out += [" ".join(words + [f"m{rng.randint(0, 10**9)}"]) for _ in range(members)]
    return out


def brute_near(texts):
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if root[i] != root[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                x, y = max(root[i], root[j]), min(root[i], root[j])
                root = [y if r == x else r for r in root]
    return root


def test_families_of_near_copies_are_linked(spark):
    rng, texts = random.Random(4), []
    for run in (9, 10, 10, 11, 14, 14):  # cross similarities of 0.83 to 0.81, and of 0.78: those stay apart
        texts += near_families(rng, [f"w{rng.randint(0, 10**9)}" for _ in range(300)], 2, 80, run)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(frame).collect()}
    assert [found[i] for i in range(len(texts))] == brute_near(texts) and len(set(found.values())) == 8
    # Shards in blocks of 30 fingerprints.
    assert found == {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(frame, shard_rows=30).collect()}


def test_pairs_amid_decoys_are_verified(spark):
    rng, texts = random.Random(5), []
    word = lambda: f"w{rng.randint(0, 10**9)}"
    for _ in range(6):  # 60 documents of one template, 0.79 alike, and a pair of 0.81 among them
        base, shared = [word() for _ in range(300)], [word() for _ in range(4)]
        runs = [[word() for _ in range(31)] for _ in range(60)] + [shared + [word() for _ in range(27)] for _ in range(2)]
        texts += [" ".join(base[:100] + r + base[131:]) for r in runs]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(frame).collect()}
    assert [found[i] for i in range(len(texts))] == brute_near(texts)


def test_shard_pairs_name_all_in_the_end():
    rng = np.random.default_rng(2)
    groups, values = rng.integers(0, 3, 150), rng.integers(0, 2**8, 150).astype(np.int64)
    parts = rng.integers(0, 40, 150)
    near = lambda i, j: i != j and groups[i] == groups[j] and parts[i] != parts[j] and int(values[i] ^ values[j]).bit_count() <= 3
    wanted = {(i, j) for i in range(150) for j in range(i) if near(i, j)}
    for most in (1, 4, 1000):
        u, v, left = simhash.shard_pairs(groups, values, parts, 3, most)
        named = {(max(p), min(p)) for p in zip(u.tolist(), v.tolist())}
        assert named <= wanted and {x for p in wanted - named for x in p} <= set(left.tolist())
    assert named == wanted and not len(left) and len(wanted) > 100
