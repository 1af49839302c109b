"""Each corpus operator against a brute-force version, and on nulls, empty and long texts, ties, repeated rows and clashing names."""

import hashlib
import html
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lakemetrics.llm import blocks, decontamination, html_extraction, license_scan, packing, quality_rules, sharding, simhash, substring, suffix, warc

DATA = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, _block int, key string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and texts, empty and blank texts, repeated rows, a long text, columns whose names clash with internal ones."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8)))
    passage = " ".join(word() for _ in range(150))
    rows = [(None, "a b c"), (None, None), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, passage), (5, passage), (6, "x " + passage), (None, passage), (7, " ".join(word() for _ in range(30_000))), (8, "a  b   c\n\n d"), (9, "ab" * 900)]
    rows += [(10 + i, " ".join(word() for _ in range(rng.randint(0, 80))) + " " + passage[rng.randint(0, 300) :]) for i in range(30)]
    return spark.createDataFrame([(i, t, "l", 1, "k") for i, t in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_large_keys_beside_nulls(spark):
    big = (1 << 60) + 1
    frame = spark.createDataFrame([(None, "one two three four five six"), (big, "one two three four five seven")], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(1, "three four five six seven"), (2, "one two three four five")], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality long")
    pages = frame.withColumnsRenamed({"doc_id": "page_id", "text": "html"}).withColumn("url", F.lit("u"))
    found = [simhash.near_duplicates(frame), simhash.similar_documents(frame), quality_rules.judge(frame, labels), packing.pack(frame), decontamination.contained(frame, items)]
    assert all({r[0] for r in f.select("doc_id").collect()} == {None, big} for f in found)
    assert {r["page_id"] for r in html_extraction.extract(pages).collect()} == {None, big}


# 1 html extraction


def test_html_articles(spark):
    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)(</article>|<footer>|$)", r["html"], re.S)[1]
        assert html_extraction.main_text(r["html"]) == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", article))).split())


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("plain", "plain"),
        ("<p>One.<p>Two", "One. Two"),
        ("<div>a<b>b</b>c<br>d</div><script>x<y</script>", "abc d"),
        ("<body><main><section><p>First, section text.</p></section><section><p>Second section.</p></section></main><aside>no</aside></body>", "First, section text. Second section."),
        ("<article><p>Text, with a &lt;tag&gt; &amp; &eacute;.</p><div class='ad'>BUY</div><form>f</form></article><div id=comments><p>A reader comment, quite long, really.</p></div>", "Text, with a <tag> & é."),
        ("<div class='cookie-notice'>We use cookies, a lot of them.</div><div id=c><h1>Title</h1><p>Body text, of some length.</p><ul><li>x<li>y</ul></div><div class=sidebar>Side, bar</div>", "Title Body text, of some length. x y"),
        ("<div>" * 3000 + "deep", "deep"),
        ("<p hidden>no</p><p>yes, it is here</p><!-- <p>no</p> --", "yes, it is here"),
        ("<p class=it's>Text, <img alt=\"5\" screen\">of two </ p>parts.</p><p title='a > b'>More<//><p", "Text, of two parts. More"),
        ("<a<b " * 3 + "<p>One, two", "One, two"),
        ("<div class='main'><p>The story, with a first part, goes on.</p></div><div class='content sidebar'><p>Side, bar.</p></div>", "The story, with a first part, goes on."),
        ("<section class='legal'><h1>Law</h1><p>An article, on the law, of some length, stands here.</p></section><div class='legal'>All rights, reserved.</div>", "Law An article, on the law, of some length, stands here."),
        ("<div id=post><p>Short, text.</p></div><div class='comments list'>" + "<p>A reader's comment, long, and longer, than the text.</p>" * 9 + "</div>", "Short, text."),
        ("<div class='entry-header'><h1>Title, of a post</h1></div><div class='entry-content'><p>Body, of the post.</p><p>And, more.</p></div><ul class='related-posts'><li>Another, post</ul>", "Title, of a post Body, of the post. And, more."),
    ],
)
def test_html_cases(page, text):
    assert html_extraction.main_text(page) == text


def test_html_of_broken_tags_takes_linear_time():
    for page in ("<a<b" * 50_000, '<p a="' * 50_000, "<p a='x' " * 50_000, "</ " * 50_000, "<!-" * 50_000):
        began = time.perf_counter()
        html_extraction.main_text(page)
        assert time.perf_counter() - began < 10


def test_html_odd_rows(spark):
    pages = spark.createDataFrame([(None, "u", None, "t"), (1, None, "", "t"), (1, None, "", "t"), (2, "u", "<p>x</p>", "t")], "page_id long, url string, html string, text string")
    assert sorted(r["text"] for r in html_extraction.extract(pages).collect()) == ["", "", "", "x"]
    assert html_extraction.extract(pages.where("false")).count() == 0


# 2 simhash


def brute_fingerprint(text):
    words = WORDS.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    grams = [" ".join(w) for w in zip(words, words[1:], words[2:])] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, radius=3):
    label = list(range(len(ids)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    v = np.array(fps, np.uint64)
    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v[i] ^ v) <= radius):
            a, b = root(i), root(int(j))
            label[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(root(i), []).append(ids[i])
    return {i: min((x for x in groups[root(i)] if x is not None), default=None) for i in range(len(ids))}


def test_simhash(docs, pairs):
    rows = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    fps = {i: brute_fingerprint(t) for i, t in pairs}
    assert all(rows[i]["fingerprint"] == f"{f:016x}" for i, f in fps.items())
    ids = sorted(fps)
    assert {i: rows[i]["component_id"] for i in ids} == {ids[k]: v for k, v in brute_components(ids, [fps[i] for i in ids]).items()}


def test_simhash_trees():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, 40, np.uint64)
    values = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 64, 40, np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40, np.uint64)) for _ in range(4)]]))
    forest = simhash.Forest(np.zeros(len(values), np.int64), values)
    found = {(int(a), int(b)) for q, n in forest.near(np.arange(len(values)), 3) for a, b in zip(q, n)}
    wanted = {(i, int(j)) for i in range(len(values)) for j in np.flatnonzero(np.bitwise_count(values[i] ^ values) <= 3) if i != j}
    assert found == wanted and len(wanted) > 100


def test_hot_shards_of_fingerprints(spark):
    rng = np.random.default_rng(3)
    fps = np.unique(np.concatenate([np.bitwise_or.reduce([np.uint64(1) << rng.integers(0, 64, 400, np.uint64) for _ in range(2)], axis=0), np.uint64(1) << np.arange(64, dtype=np.uint64), rng.integers(0, 2**64, 50, np.uint64)])).view(np.int64).tolist()
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    wanted = {fps[i]: v for i, v in brute_components(fps, [f & (2**64 - 1) for f in fps], 1).items()}
    assert len(set(wanted.values())) < len(fps) - 300
    for rows in (50, 10_000):
        found = {r["node"]: r["root"] for r in simhash.components(simhash.links(frame, 1, shard_rows=rows)).collect()}
        assert {f: found.get(f, f) for f in fps} == wanted


def test_simhash_odd(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    blank = {r["component_id"] for r in rows if r["fingerprint"] == "0" * 16}
    assert blank == {1}
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.representatives(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 5").count() == 1 and kept.where("doc_id in (2, 3)").count() == 0


# 3 sharding


def test_sharding(docs, odd, empty, pairs):
    rows = sharding.shard(docs, 16).collect()
    text = dict(pairs)
    slots = {}
    for r in rows:
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text[r["doc_id"]].encode()) + 1, zlib.crc32(text[r["doc_id"]].encode()), "rows", None)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(slots) == 16 and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard(docs.repartition(5), 16).collect()}
    assert again == {r["doc_id"]: (r["shard"], r["slot"]) for r in rows}
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: (r["slot"], r["shard"]))]
    assert order != sorted(order)
    found = sharding.shard(odd, 4).collect()
    assert sorted((r["slot"], r["shard"]) for r in found) == [(i // 4, i % 4) for i in range(odd.count())]
    assert sharding.shard(empty).count() == 0


def test_sharding_of_equal_rows(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 10 == 0, F.col("id")).alias("doc_id"), F.lit("same").alias("text"))
    found = sharding.shard(rows, 16)
    assert sorted((r["slot"], r["shard"]) for r in found.collect()) == [(i // 16, i % 16) for i in range(30_000)]
    assert Counter(r["doc_id"] for r in found.collect()) == Counter(r["doc_id"] for r in rows.collect())
    again = sharding.shard(rows.repartition(7), 16)
    assert found.exceptAll(again).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000])
def test_permutation_is_a_bijection(spark, n):
    got = [r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), n)).collect()]
    assert sorted(got) == list(range(n))


# 4 warc


@pytest.mark.parametrize("groups", [500_000, 0])
def test_warc(spark, monkeypatch, groups):
    monkeypatch.setattr(warc, "MOST_GROUPS", groups)
    pages = spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url", "html", F.lit(1).alias("record_type"))
    pages = pages.unionByName(pages.where("page_id % 3 = 0").withColumn("page_id", F.col("page_id") + 1000))
    pages = pages.unionByName(spark.range(5000, 6000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit("<h1>Not found</h1>" * 9).alias("html"), F.lit(1).alias("record_type")))
    pages = pages.unionByName(spark.createDataFrame([(2000, None, None, 1), (2001, "u\r\nX: y", "short", 1), (2002, "u", "short", 1), (None, "u", "z" * 200, 1), (2003, "u", "z" * 200, 1)], pages.schema))
    folder = warc.new_folder(spark)
    got = {r["page_id"]: tuple(r)[1:] for r in warc.archive(pages, folder).collect()}
    first, wanted = {}, {}
    source = pages.select("page_id", "html").collect()
    for r in source:
        if len(b := (r["html"] or "").encode()) >= 100 and r["page_id"] is not None:
            first[b] = min(first.get(b, r["page_id"]), r["page_id"])
    for r in source:
        b = (r["html"] or "").encode()
        revisit = len(b) >= 100 and first[b] != r["page_id"]
        wanted[r["page_id"]] = (len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", first[b] if revisit else None)
    assert got == wanted
    read = spark.read.format("warc").load(folder)
    assert read.where("record_type = 'revisit'").where("payload is not null").count() == 0
    some = spark.read.format("warc").load(folder).where("target_uri like 'http%' and record_type in ('response')").select("payload").collect()
    assert all(r["payload"].startswith(b"<!DOCTYPE") for r in some) and len(some) == 50
    bare = spark.read.format("warc").option("payload", "false").load(folder)
    assert bare.where("payload is not null").count() == 0 and bare.count() == len(source)
    assert warc.archive(pages.where("false"), warc.new_folder(spark)).count() == 0


def test_warc_foreign_files(spark, tmp_path):
    import gzip

    rows = [{"record_id": f"<urn:x:{i}>", "record_type": "resource", "payload": bytes([65 + i]) * (9000 * i), "payload_bytes": 9000 * i, "content_type": "text/plain"} for i in range(3)]
    (tmp_path / "a.warc").write_bytes(b"".join(map(warc.record_bytes, rows)))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(warc.record_bytes(r)) for r in rows))
    warc.register(spark)
    got = spark.read.format("warc").load(str(tmp_path)).where("record_id <> '<urn:x:0>'").collect()
    assert sorted((r["record_id"], len(r["payload"])) for r in got) == [("<urn:x:1>", 9000)] * 2 + [("<urn:x:2>", 18000)] * 2


# 5 decontamination


def shingle_set(text, k=5):
    w = WORDS.findall((text or "").lower())
    return set(zip(*[w[i:] for i in range(k)]))


def test_decontamination(spark, docs, pairs, odd, empty):
    benchmark = spark.read.parquet(f"{DATA}/benchmark.parquet")
    items = {r["item_id"]: shingle_set(r["text"]) for r in benchmark.collect()}
    wanted = {(i, j): len(s & shingle_set(t)) / len(s) for i, t in pairs for j, s in items.items() if len(s & shingle_set(t)) >= 0.8 * len(s)}
    got = {(r["doc_id"], r["item_id"]): r["containment"] for r in decontamination.contained(docs, benchmark).collect()}
    assert got == pytest.approx(wanted) and wanted
    assert decontamination.clean(docs, benchmark).count() == len(pairs) - len({i for i, _ in wanted})
    asked = spark.createDataFrame([(1, None), (2, "too short"), (3, "")], "item_id long, text string")
    assert decontamination.contained(odd, asked).count() == 0 and decontamination.clean(odd, asked).count() == odd.count()
    assert decontamination.contained(empty, benchmark).count() == 0 and decontamination.contained(odd, asked.where("false")).count() == 0


def test_short_items_in_long_documents(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([5, 6, 9, 20, 70, 300])))) for i in range(60)]
    texts = []
    for i in range(60):
        t = [rng.choice(words) for _ in range(5000)]
        piece = items[i][1].split()
        if i % 3 == 1 and len(piece) > 60:  # one word in the middle differs
            piece = [*piece[: len(piece) // 2], "other", *piece[len(piece) // 2 + 1 :]]
        at = rng.randint(0, 4990)
        texts.append((i, " ".join(t[:at] + piece + t[at:])))
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 2000)
    found = decontamination.contained(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} >= {(i, i) for i in range(60)}


# 6 substring dedup


def brute_words(rows, window=13):
    first = {}
    for i, t in rows:
        for g in zip(*[WORDS.findall(t or "")[k:] for k in range(window)]):
            first[g] = min(first.get(g, float("inf")), i if i is not None else float("inf"))
    out = []
    for i, t in rows:
        w = WORDS.findall(t or "")
        gone = [False] * len(w)
        for a, g in enumerate(zip(*[w[k:] for k in range(window)])):
            if first[g] < (i if i is not None else float("inf")):
                gone[a : a + window] = [True] * window
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return Counter(out)


def test_substring(docs, pairs, odd, empty, monkeypatch):
    monkeypatch.setattr(blocks, "LEAST", 20_000)
    columns = ["doc_id", "n_words", "n_removed", "text"]
    assert Counter(map(tuple, substring.dedup(docs).select(*columns).collect())) == brute_words(pairs)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert Counter(map(tuple, substring.dedup(odd).select(*columns).collect())) == brute_words(rows)
    kept = substring.dedup(odd, joined=False)
    assert Counter((i, n, m, " ".join(WORDS.findall(t))) for i, n, m, t in map(tuple, kept.select(*columns).collect())) == brute_words(rows)
    assert kept.select("rest.*").columns == ["lang", "_block", "key"]
    assert substring.dedup(empty).count() == 0


def test_substring_factors(spark, monkeypatch):
    monkeypatch.setattr(blocks, "LEAST", 2000)
    rng = random.Random(6)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    one, two = [word() for _ in range(60)], [word() for _ in range(60)]
    rows = [(-3, [word(), *one]), (2, two), (3, [*one[10:40], *two[20:50]]), (4, [*one[:9], *two[:9]]), (5, [word(), *one[30:60]]), (6, two), (7, [*one[40:], *one[:20]])]
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    texts, found = dict(rows), {r["doc_id"]: r for r in substring.dedup(frame).collect()}
    factors = {i: [tuple(f) for f in r["factors"]] for i, r in found.items()}
    assert factors == {-3: [], 2: [], 3: [(0, 30, -3, 11), (30, 30, 2, 20)], 4: [], 5: [(1, 30, -3, 31)], 6: [(0, 60, 2, 0)], 7: [(0, 20, -3, 41), (20, 20, -3, 1)]}
    assert all(texts[i][s : s + n] == texts[k][p : p + n] for i, parse in factors.items() for s, n, k, p in parse)
    # A window that stands in document 8 crosses the boundary of two factors of document 9 and makes a third.
    rows += [(8, [word(), *one[54:], *two[:7], word()]), (9, [*one[40:], *two[:20]])]
    found = {r["doc_id"]: r for r in substring.dedup(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()}
    assert [tuple(f) for f in found[9]["factors"]] == [(0, 20, -3, 41), (14, 13, 8, 1), (20, 20, 2, 0)]


def test_words_whose_hashes_collide(spark):
    thue = "a"
    for _ in range(11):
        thue += thue.translate(str.maketrans("ab", "ba"))
    base = [f"w{i}" for i in range(13)]
    rows = [(1, " ".join([*base[:6], thue, *base[6:]])), (2, " ".join([*base[:6], thue.translate(str.maketrans("ab", "ba")), *base[6:]]))]
    assert {r["n_removed"] for r in substring.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {0}


# 7 suffix-array dedup


def brute_bytes(rows, length=400):
    count = Counter(t[a : a + length] for _, t in rows for a in range(len(t) - length + 1))
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for a in range(len(t) - length + 1):
            if count[t[a : a + length]] > 1:
                gone[a : a + length] = b"\1" * length
        spans = sum(1 for j in range(len(t)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((i, len(t), sum(gone), spans, bytes(c for c, g in zip(t, gone) if not g)))
    return Counter(out)


def similar(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 9))) for _ in range(200)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(40, 160))) for _ in range(5)]
    for i in range(n):
        t = " ".join(rng.choice(words) for _ in range(rng.randint(0, 50)))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            if rng.random() < 0.5:
                c = rng.randint(0, len(p) - 1)
                p = p[:c] + rng.choice("xyz") + p[c + 1 :]
            t += p[rng.randint(0, 200) * (rng.random() < 0.3) :] + " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))
        yield i, t


@pytest.mark.parametrize("group", [1024, 20, 1])
def test_suffix(spark, odd, empty, monkeypatch, group):
    monkeypatch.setattr(suffix, "SEGMENT", 3000)
    monkeypatch.setattr(blocks, "LEAST", 20_000)
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "bytes"]
    for frame in (spark.createDataFrame(list(similar(250, 5)), "doc_id long, text string"), odd.where("doc_id is null or doc_id <> 7")):
        rows = [(r["doc_id"], (r["text"] or "").encode()) for r in frame.collect()]
        got = Counter((i, n, m, s, bytes(b)) for i, n, m, s, b in map(tuple, suffix.dedup(frame, group=group).select(*columns).collect()))
        assert got == brute_bytes(rows)
    assert suffix.dedup(empty).count() == 0


def test_suffix_passage_in_many_contexts(spark, monkeypatch):
    monkeypatch.setattr(blocks, "LEAST", 20_000)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(70))
    rows = [(i, " ".join([word() for _ in range(rng.randint(5, 60))] + [passage] + [word() for _ in range(rng.randint(5, 60))])) for i in range(300)]
    rows += [(None, passage * 3)] * 200 + [(300, "ab" * 700)] * 2
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((i, n, m, s, bytes(b)) for i, n, m, s, b in map(tuple, suffix.dedup(frame, group=50).select("doc_id", "n_bytes", "n_removed", "n_spans", "bytes").collect()))
    assert got == brute_bytes([(i, t.encode()) for i, t in rows])
    assert frame.transform(lambda f: blocks.deal(f, "doc_id", "text", 50)).where("_key is null").select("_block").distinct().count() > 1


def test_suffix_sort():
    rng = random.Random(2)
    parts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 40))) for _ in range(300)]
    c = suffix.Contexts(np.array([i % 3 for i in range(300)]), np.zeros(300, np.int64), parts)
    order = c.sort()
    assert [(i % 3, parts[i]) for i in order] == sorted((i % 3, p) for i, p in enumerate(parts))


# 8 license scan


def test_license_scan(spark, docs, odd, empty):
    extra = spark.createDataFrame([(900, "Under the MIT license, under THE mit-license. cc by nc cc by nc"), (901, "permission is hereby granted free of charge to any person who obtains a copy of software"), (902, None), (903, "Apache License\nversion 2"), (904, "... "), (905, "under the M\u0130T license, \u212a"), (906, "-cc by nc"), (907, "mar\u212aed " * 3 + "İ under the mit license")], "doc_id long, text string")
    frame = docs.select("doc_id", "text").unionByName(extra)
    lower = str.maketrans(license_scan.UPPER, license_scan.LOWER)
    word = re.compile(license_scan.WORD)
    templates = [(set(t.split()), label) for t, label in license_scan.TEMPLATES]
    for r in license_scan.scan(frame).join(frame, "doc_id").collect():
        low = (r["text"] or "").translate(lower)
        w = word.findall(low)
        starts, base = [], set()
        for phrase, label in license_scan.PHRASES.items():
            p = phrase.split()
            at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            starts += at
            base |= {label} if at else set()
        labels, score = set(base), 1.0 if starts else 0.0
        for i in range(len(w)):
            for template, label in templates:
                share = len(template & set(w[i : i + license_scan.BLOCK])) / len(template) if w[i] in template else 0
                if share >= license_scan.THRESHOLD:
                    labels.add(label)
                    score = max(score, share)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(starts), min(starts, default=None), max(starts, default=None))
        assert (r["base_labels"], r["labels"]) == (",".join(sorted(base)), ",".join(sorted(labels))) and r["score"] == pytest.approx(score)
    assert license_scan.scan(odd).count() == odd.count() and license_scan.scan(empty).count() == 0


def test_wrapped_license_headers(spark):
    headers = {
        "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that",
        "lgpl": "# under the terms of the GNU Lesser General Public\n# License as published by\n# the Free Software Foundation",
        "gpl": "This is free software: you can redistribute it\nand/or modify it under the terms\nof the GNU General Public License",
        "apache-2": "Unless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed",
    }
    filler = "\n".join(f"word{i} other{i}" for i in range(40))
    rows = [(i * 100 + n, label, (filler[: n * 13] + "\n" if n else "") + text + "\n" + filler) for i, (label, text) in enumerate(headers.items()) for n in range(0, 40, 3)]
    found = license_scan.scan(spark.createDataFrame(rows, "doc_id long, label string, text string")).collect()
    label = {i: x for i, x, _ in rows}
    assert all(label[r["doc_id"]] in r["labels"].split(",") and r["score"] >= 0.8 for r in found) and len(found) == len(rows)
    same = spark.createDataFrame([(None, "Under the MIT license")] * 300 + [(1, "software " * 2000)], "doc_id long, text string")
    assert Counter((r["doc_id"], r["labels"]) for r in license_scan.scan(same).collect()) == {(None, "mit"): 300, (1, ""): 1}


# 9 quality rules


def test_quality_statistics(docs, pairs, spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = {r["doc_id"]: r for r in quality_rules.judge(docs, labels).collect()}
    for i, t in pairs:
        w = WORDS.findall(t)
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        grams = Counter(zip(w, w[1:], w[2:]))
        repeated = {j for a, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for j in (a, a + 1, a + 2)}
        failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
        r = rows[i]
        assert tuple(r)[1:6] == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated))
        assert r["base_failed"] == failed and (not failed or not r["kept"])


def test_forest_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    fitted = quality_rules.fit(docs, labels.where("doc_id % 2 = 0"))
    found = quality_rules.judge(docs, labels, fitted=fitted).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").collect()
    good, bad = ([r["kept"] for r in found if r["quality"] == q] for q in (1, 0))
    assert np.mean(good) >= 0.97 and np.mean(bad) <= 0.15


def test_quality_odd(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality long, toxic long, text string")
    nulls = spark.createDataFrame([(None, 1, 0), (5, None, 0), (5, 1, 0), (5, 1, 1)], "doc_id long, quality long, toxic long")
    assert quality_rules.judge(odd, none).where("kept = base_failed").count() == 0
    assert quality_rules.judge(odd, nulls).count() == odd.count() and quality_rules.judge(empty, none).count() == 0
    assert quality_rules.kept(odd, none).columns == odd.columns
    twice = spark.createDataFrame([(i % 20, f"{'word ' * (i % 7)}{i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality long")
    forests = [quality_rules.fit(f, labels, sample=15) for f in (twice, twice.orderBy(F.desc("text")))]
    assert str(forests[0]) == str(forests[1])


# 10 packing


def test_packing(spark, docs, pairs, odd, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(5000, None), (5001, ""), (5002, "a  b   c \n\n d "), (5003, "x " * 9000), (5004, " x<|endoftext|>")], "doc_id long, text string"))
    rows = packing.pack(frame, with_ids=True).collect()
    pieces, fill = {}, Counter()
    for r in rows:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        pieces.setdefault(r["doc_id"], []).append(r)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill[r["sequence_id"]]
        fill[r["sequence_id"]] += r["length"]
    for r in frame.collect():
        own = sorted(pieces[r["doc_id"]], key=lambda p: p["start"])
        ids = [i for p in own for i in p["ids"]]
        assert ids == [*whole.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        assert all(p["doc_tokens"] == len(ids) for p in own) and own[0]["start"] == 0
    assert max(fill.values()) <= 2048 and all(n == 2048 or n & (n - 1) == 0 for n in fill.values())
    assert packing.pack(odd).groupBy("doc_id").count().count() and packing.pack(empty).count() == 0


def test_ids_of_odd_white_space(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    rng, coder = random.Random(1), packing.coder(None)
    parts = ["a", "b", "the", " ", " ", " ", "\n", "\t", "\xa0", "\u2003", "\x0b", "\r", "\x1c", "\u200b", "\x85", "\u3000", "22", "'s", "'", "!", "é", "漢", "Ġ", "<|endoftext|>", "\ufeff"]
    for _ in range(3000):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3)]
        assert [g.tolist() for g in coder.encode(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    rows = packing.pack(spark.createDataFrame([(1, "a \xa0 \xa0\n b"), (2, " \xa0 \xa0")], "doc_id long, text string"), with_ids=True).collect()
    got = {i: [x for r in sorted(rows, key=lambda r: r["start"]) if r["doc_id"] == i for x in r["ids"]] for i in (1, 2)}
    assert got == {1: [*whole.encode("a \xa0 \xa0\n b").ids, 1], 2: [*whole.encode(" \xa0 \xa0").ids, 1]}


def test_packer_keeps_all_limits():
    rng = random.Random(4)
    p = packing.Packer(length=100, segments=3, loss=60, pool=20)
    docs = {i: (n := rng.randint(1, 250), rng.randint(0, n)) for i in range(200)}
    for i, (n, prompt) in docs.items():
        p.add(i, n, prompt)
    p.close()
    use, seen = {}, Counter()
    for doc, start, n, sequence, offset in p.taken():
        u = use.setdefault(sequence, [0, 0, 0])
        assert offset == u[0]
        u[0], u[1], u[2] = u[0] + n, u[1] + 1, u[2] + max(0, start + n - max(start, docs[doc][1]))
        seen[doc] += n
    assert seen == {i: n for i, (n, _) in docs.items()}
    assert all(a <= 100 and b <= 3 and c <= 60 for a, b, c in use.values())
    assert all(a == 100 or a & (a - 1) == 0 for a, _, _ in use.values())


@pytest.mark.parametrize("sizes", [(1, 1), (3, 3), (20, 20), (1, 30), (1, 400), (30, 3000), (1500, 1), (33, 1)])
def test_packer_pads_nothing(sizes):
    rng = random.Random(5)
    p = packing.Packer()
    docs = [rng.randint(*sizes) if sizes[0] < sizes[1] else sizes[i % 50 > 1] for i in range(3000)]
    for i, n in enumerate(docs):
        p.add(i, n)
    p.close()
    use, seen, full = Counter(), Counter(), Counter()
    for doc, start, n, sequence, offset in p.taken():
        assert start == seen[doc] and offset == use[sequence]
        use[sequence] += n
        seen[doc] += n
        full[sequence] += 1
    assert [seen[i] for i in range(3000)] == docs and max(full.values()) <= packing.SEGMENTS
    assert all(n & (n - 1) == 0 and n <= 2048 for n in use.values())
    longest = min(2048, 1 << (sum(sorted(docs)[-64:]).bit_length() - 1))
    assert sum(n for n in use.values() if n >= min(longest, 64)) > 0.9 * sum(docs)


def test_special_strings(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole, text = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER)), "a <|endoftext|> b"
    for special in (True, False):
        whole.encode_special_tokens = not special
        row = packing.pack(spark.createDataFrame([(1, text)], "doc_id long, text string"), with_ids=True, special=special)
        assert [i for r in sorted(row.collect(), key=lambda r: r["start"]) for i in r["ids"]] == [*whole.encode(text, add_special_tokens=False).ids, 1]
    assert 50256 not in whole.encode(text).ids
