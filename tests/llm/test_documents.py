"""Line dedup, suffix dedup, sketches, quality rules, SimHash, mixing, pieces, LM scores, pipeline: all against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from kinweave.llm import bloom_lm, line_dedup, mixing, quality_rules, queries, scaled_sketch, simhash, suffix_dedup, unigram_pieces
from kinweave.llm.common import ask_groups

suffix_dedup_segments = suffix_dedup.segments
SMALL = "/root/testdata/sf0.001"
WS = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, id long, t string, fp string, key long, shard long, kept string, did long, c0 string"


def rows(n=60, seed=0):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "Δelta", "эпсилон", "zeta#", "THE", "of", "and", "x"]
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage, line = say(40), "A  line Found often. "
    texts = [None, "", " \t\n", "\n\n", "x", passage, passage, "é" * 99, "ab" * 120, line, "▁ marked \x00 ▁▁", "日本語のテキスト " * 30, say(30_000)]
    for k in range(n):
        body = [say(rng.randint(1, 60)) for _ in range(rng.randint(1, 4))]
        if k % 3 == 0:
            body.insert(rng.randrange(len(body) + 1), passage)
        if k % 2 == 0:
            body.append(line if k % 4 else line.upper().strip() + "\t")
        texts.append("\n".join(body))
    texts += texts[-5:]
    out = [(k, t, f"s{k % 4}" if k % 5 else None) for k, t in enumerate(texts)]
    return [(d, t, s, "en", None, 7, "clash", "clash", 1, 2, "clash", 3, "clash") for d, t, s in out]


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(messy):
    return messy.limit(0)


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def small(spark):
    return texts_of(spark.read.parquet(f"{SMALL}/documents.parquet"))


# --- line dedup


def brute_lines(texts, least, group=None):
    """group: of each document the group that counts once; None: a document counts by itself."""
    key = lambda x: x.strip(WS).translate({c: c + 32 for c in range(65, 91)})
    split = {d: (t or "").split("\n") for d, t in texts.items()}
    seen = Counter(k for k, _ in {(key(x), (d, "own") if group is None or group[d] is None else group[d]) for d, ls in split.items() for x in ls} if k)
    out = {}
    for d, ls in split.items():
        gone = [seen[key(x)] >= least for x in ls]
        out[d] = (len(ls), sum(gone), "\n".join(x for x, g in zip(ls, gone) if not g))
    return out


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "run_bytes": 3000}])
@pytest.mark.parametrize("least", [1, 2, 10])
def test_lines(messy, options, least):
    out = line_dedup.line_dedup(messy, min_docs=least, keys_per_shard=16, **options)
    assert {r["doc_id"]: (r["__n_lines"], r["__n_dropped"], r["text"]) for r in out.collect()} == brute_lines(texts_of(messy), least)


def test_lines_of_one_long_document(spark):
    """Many lines in one document, nearly all of them frequent."""
    long = "\n".join(f"line {k % 5000}" for k in range(60_000))
    df = spark.createDataFrame([(1, long), (2, long), (3, None)], "doc_id long, text string")
    for options in ({}, {"broadcast_bytes": 0}):
        got = {r["doc_id"]: (r["__n_lines"], r["__n_dropped"], r["text"]) for r in line_dedup.line_dedup(df, min_docs=2, keys_per_shard=100, **options).collect()}
        assert got == {1: (60_000, 60_000, ""), 2: (60_000, 60_000, ""), 3: (1, 0, "")}


def test_lines_counted_by_groups(spark, messy):
    group = {d: None if d % 7 == 0 else d % 12 for d in texts_of(messy)}
    marked = messy.withColumn("grp", F.when(F.col("doc_id") % 7 != 0, F.col("doc_id") % 12))
    roots = spark.createDataFrame([(k, k // 2 * 2) for k in range(10)], "g long, root long")
    for groups, root in ((None, group), (roots, {d: g if g is None or g >= 10 else g // 2 * 2 for d, g in group.items()})):
        for least in (2, 5, 8):
            out = line_dedup.line_dedup(messy, min_docs=least, counts=line_dedup.line_counts(marked, group_col="grp", groups=groups))
            assert {r["doc_id"]: (r["__n_lines"], r["__n_dropped"], r["text"]) for r in out.collect()} == brute_lines(texts_of(messy), least, root)


def test_lines_edges(spark, messy, empty):
    assert line_dedup.line_dedup(empty).count() == 0
    assert line_dedup.line_dedup(messy).columns[: len(messy.columns)] == messy.columns
    twice = spark.createDataFrame([(None, "a\nb"), (None, "a\nb"), (1, "b\nc")], "doc_id long, text string")
    got = sorted(r["text"] for r in line_dedup.line_dedup(twice, min_docs=3).collect())
    assert got == ["a", "a", "c"]


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        h = line_dedup.PerfectHash(keys)
        assert sorted(h.index(keys).tolist()) == list(range(len(keys))) and len(h) == len(keys)
    prints, counts = rng.integers(0, 2**63, len(keys)).astype(np.uint64), rng.integers(1, 99, len(keys))
    shard = line_dedup.Shard.load(line_dedup.Shard(keys, prints, counts).dump())
    assert (shard.count(keys, prints) == counts).all()
    assert not shard.count(keys, prints + np.uint64(1)).any()
    assert not shard.count(keys + np.uint64(1), prints).any()


# --- suffix dedup


def brute_suffixes(pairs, length):
    seen, out = set(), []
    signed = lambda t: int(np.uint64(xxhash.xxh64_intdigest((t or "").encode(), 42)).view(np.int64))
    for d, t in sorted(pairs, key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1]))):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            if s in seen:
                gone[i : i + length] = True
            seen.add(s)
        turn = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out.append((d, bytes(np.frombuffer(b, np.uint8)[~gone]), len(b), int(gone.sum()), int((turn == 1).sum())))
    return sorted(out, key=str)


def suffixes(df, **kw):
    return sorted(((r["doc_id"], bytes(r["kept"]), r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix_dedup.suffix_dedup(df, **kw).collect()), key=str)


@pytest.mark.parametrize(("length", "anchor", "hot"), [(100, 32, 4096), (100, 32, 1), (40, 8, 3), (30, 29, 2)])
def test_suffixes(messy, length, anchor, hot):
    assert suffixes(messy, length=length, anchor=anchor, hot=hot) == brute_suffixes(texts_of(messy).items(), length)


def test_suffixes_edges(spark, empty):
    assert suffix_dedup.suffix_dedup(empty).count() == 0
    text = "".join(random.Random(4).choice("abc ") for _ in range(400))
    pairs = [(None, text), (None, text[50:]), (5, text), (5, text), (9, "a" * 5000), (10, "a" * 99), (11, text[:100] + "é" * 60 + text[100:])]
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    for hot in (4096, 1):
        assert suffixes(df, hot=hot) == brute_suffixes(pairs, 100)


def test_suffixes_of_a_shared_id(spark):
    """100,000 rows without an id: numbered by ranges, no task or list holds them all."""
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcd") for _ in range(120)) for _ in range(500)]
    df = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.element_at(F.array(*map(F.lit, texts)), (F.col("id") % 500 + 1).cast("int")).alias("text"))
    got = suffix_dedup.suffix_dedup(df.repartition(4)).groupBy("doc_id", "n_removed").count().collect()
    assert sorted((r["n_removed"], r["count"]) for r in got) == [(0, 500), (120, 99_500)] and got[0]["doc_id"] is None


def test_long_documents_in_runs(messy, monkeypatch):
    for m in (suffix_dedup, scaled_sketch, bloom_lm):
        monkeypatch.setattr(m, "LONG_BYTES", 300)
        monkeypatch.setattr(m, "CHUNK_BYTES", 200) if hasattr(m, "CHUNK_BYTES") else None
    import pyarrow as pa

    from kinweave.llm.common import text_buffers

    rng = random.Random(6)
    text = " ".join("".join(rng.choice("abcÄ") for _ in range(rng.randint(1, 400))) for _ in range(40))
    raw = np.frombuffer(text.encode(), np.uint8)
    one = np.array([0, len(raw)])
    runs = bloom_lm.token_hashes(raw, one)[0].tolist(), scaled_sketch._long(raw, 20, np.uint64(1 << 44))
    few = scaled_sketch._long(raw, 20, np.uint64(0))
    segs = []
    pa_texts = [text, text[500:] + text[:500]]

    def scan():
        batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([1, 1], pa.int32()), pa.array(pa_texts)], names=["did", "rn", "t"])
        return sum((int(((b.column(3).to_numpy() >> 1) & 0x7F).sum()) for b in suffix_dedup._scan(100, 32)(iter([batch]))), 0)

    segs.append(scan())
    monkeypatch.undo()
    segs.append(scan())
    # hashes that call everything equal: bytes tell segments and windows under hot anchors apart
    found = suffix_dedup.segments(*text_buffers(pa.array([text * 2])), 100, 32)
    monkeypatch.setattr(suffix_dedup, "segments", lambda data, offsets, *a: (*suffix_dedup_segments(data, offsets, *a)[:3], *(np.zeros_like(k) for k in suffix_dedup_segments(data, offsets, *a)[3:])))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([1, 1], pa.int32()), pa.array([text, "z" * 70 + text])], names=["did", "rn", "t"])
    out = next(suffix_dedup._scan(100, 32)(iter([batch])))
    monkeypatch.undo()
    row, start, windows, _, _ = suffix_dedup.segments(*text_buffers(batch.column(2)), 100, 32)
    raws = [t.encode() for t in batch.column(2).to_pylist()]
    strings = [raws[r][p : p + w + 99] for r, p, w in zip(row.tolist(), start.tolist(), windows.tolist())]
    assert ((out.column(3).to_numpy() & 1) == [k > 0 and x == strings[0] for k, x in enumerate(strings)]).all() and len(found[0])
    monkeypatch.setattr(suffix_dedup, "mix64", np.zeros_like)
    doc = "".join(rng.choice("ab") for _ in range(100)) + "c" * 300
    seen = pa.array([[{"loc": (1 << 40) | (60 * k << 8) | (60 << 1), "kind": 2, "k1": 7} for k in range(5)]], pa.list_(pa.struct([("loc", pa.int64()), ("kind", pa.int32()), ("k1", pa.int64())])))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([1], pa.int32()), pa.array([doc]), seen], names=["did", "rn", "t", "seen"])
    out = next(suffix_dedup._fetch(100)(iter([batch])))
    _, pos, _, flag = suffix_dedup._unpack(out.column(2).to_numpy())
    assert [bool(f) for f in flag] == [p > 0 and doc[p : p + 100] == doc[:100] for p in pos.tolist()]
    monkeypatch.undo()
    assert segs[0] == segs[1] == sum(len(t.encode()) - 99 for t in pa_texts)
    assert runs[0] == bloom_lm.token_hashes(raw, one)[0].tolist()
    v, _, g = scaled_sketch.sketches(*text_buffers(pa.array([text])), 20, 16)
    assert runs[1][0].tolist() == v.tolist() and g[0] == runs[1][1] == scaled_sketch.BELOW
    least = scaled_sketch.sketches(*text_buffers(pa.array([text])), 20, 1)[0][:64]
    assert few[1] == scaled_sketch.SMALLEST and few[0].tolist() == least.tolist()


def test_suffix_sort_and_collisions(monkeypatch):
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 900).astype(np.uint8)
    position, group = np.arange(800), np.sort(rng.integers(0, 40, 800))
    order = suffix_dedup.Suffixes(data, 24).sort(position, group)
    raw = data.tobytes()
    assert order.tolist() == sorted(range(800), key=lambda i: (group[i], raw[i : i + 24], i))
    # hashes that call everything equal: only the verification of bytes tells suffixes apart
    monkeypatch.setattr(suffix_dedup.Suffixes, "common", lambda self, x, y: np.full(len(x), self.length))
    got = suffix_dedup.repeated(suffix_dedup.Suffixes(data, 6), position, group)
    seen, want = set(), []
    for p, g in zip(position.tolist(), group.tolist()):
        want.append((g, raw[p : p + 6]) in seen)
        seen.add((g, raw[p : p + 6]))
    assert got.tolist() == want


# --- sketches


def test_sketch_query(messy, empty):
    t = {d: x or "" for d, x in texts_of(messy).items()}
    ids = sorted(t, reverse=True)
    follow = dict(zip(ids, ids[1:] + ids[:1]))
    for parts in (1, 3, 40):
        got = {r["doc_id"]: r for r in scaled_sketch.fingerprint_next(messy, partitions=parts).collect()}
        assert set(got) == set(ids)
        for d in ids:
            h = len(t[d]) // 2
            e = t[d][: len(t[d]) - h] + t[follow[d]][:h]
            assert got[d]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest() and got[d]["n_chars"] == len(t[d])
            assert got[d]["near_next"] == scaled_sketch.containment(got[d]["fingerprint"], got[follow[d]]["fingerprint"])
            assert 0 <= got[d]["near_edited"] <= 1
    assert len({got[d]["fingerprint"] for d in ids if t[d] == ""}) == 1
    assert got[5]["fingerprint"] == got[6]["fingerprint"] and got[6]["near_next"] == 1.0
    assert scaled_sketch.fingerprint_next(empty).count() == 0


def test_sketch_ties(spark):
    pairs = [(3, "bbb"), (3, "aaa"), (None, "nnn"), (1, "ccc"), (3, "aaa")]
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    signed = lambda t: int(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).view(np.int64))
    order = [*sorted(["aaa", "aaa", "bbb"], key=signed, reverse=True), "ccc", "nnn"]
    want = sorted(hashlib.sha256((a[:2] + b[:1]).encode()).hexdigest() for a, b in zip(order, order[1:] + order[:1]))
    for parts in (1, 4):
        assert sorted(r["edited_sha256"] for r in scaled_sketch.fingerprint_next(df, partitions=parts).collect()) == want


def test_sketch_estimates():
    import pyarrow as pa

    from kinweave.llm.common import text_buffers

    rng = random.Random(5)
    text = "".join(rng.choice("abcdefgh ") for _ in range(60_000))
    part, other = text[20_000:30_000], "".join(rng.choice("abcdefgh ") for _ in range(60_000))
    one = lambda x: scaled_sketch.strings(*scaled_sketch.sketches(*text_buffers(pa.array([x]))))[0]
    whole, small_, far = one(text), one(part), one(other)
    assert scaled_sketch.containment(whole, small_) > 0.98
    assert scaled_sketch.containment(whole, far) < 0.02
    half = one(part[:5000] + other[:5000])
    assert abs(scaled_sketch.containment(whole, half) - 0.5) < 0.06
    joined = scaled_sketch.merge(whole, far)
    assert scaled_sketch.containment(joined, far) == 1.0 and scaled_sketch.containment(joined, whole) == 1.0
    assert scaled_sketch.merge("=", "=") == "=" == one("") and scaled_sketch.merge(one("tiny"), whole) in (whole, scaled_sketch.merge(whole, one("tiny")))
    # merging sketches is sketching the union, whatever their sizes
    for x, y in ((part[:400], part[200:900]), (part[:90], other[:90]), (part, other[:50]), (part[:3000], part[1000:9000]), ("", part[:60])):
        both = {bytes(z[i : i + 20].encode()) for z in (x, y) for i in range(max(1, len(z) - 19)) if z}
        hashes = sorted({h for z in both for h in scaled_sketch.parse(one(z.decode()))[0].tolist()})
        got, mark = scaled_sketch.parse(scaled_sketch.merge(one(x), one(y)))
        reach = scaled_sketch._reach(got, mark, (1 << 48) // 16)
        assert got.tolist() == [h for h in hashes if h < reach] and (mark != scaled_sketch.ALL or len(hashes) <= 64)
    # short texts: half of a text of n bytes has n/2 - 19 shingles of n - 19
    for n in (50, 60, 80, 120, 300, 800):
        alike = [scaled_sketch.containment(one(text[k : k + n]), one(text[k : k + n // 2] + other[k : k + n // 2])) for k in range(0, 40_000, 800)]
        assert sum(a == 0 for a in alike) <= (3 if n > 50 else 10) and abs(sum(alike) / len(alike) - (n // 2 - 19) / (n - 19)) < 0.06


def test_sketches_of_a_shared_id(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcd") for _ in range(30)) for _ in range(500)]
    df = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.element_at(F.array(*map(F.lit, texts)), (F.col("id") % 500 + 1).cast("int")).alias("text"))
    got = scaled_sketch.fingerprint_next(df.repartition(4))
    assert got.count() == 100_000 and got.select("fingerprint").distinct().count() == 500 and got.where("near_next = 1.0").count() >= 99_500


# --- quality rules


def brute_measure(text):
    words = [w for w in (text or "").translate({ord(c): " " for c in WS}).split(" ") if w]
    grams = list(zip(words, words[1:], words[2:]))
    c = Counter(grams)
    rep = set()
    for i, g in enumerate(grams):
        if c[g] > 1:
            rep |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if x.strip(WS)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(rep)


def test_quality_measures(spark, messy, empty):
    texts = texts_of(messy) | {1000 + d: t for d, t in small(spark).items()}
    for t in texts.values():
        assert quality_rules.measure(t)[:5] == brute_measure(t)
    got = {r["doc_id"]: r for r in quality_rules.quality(messy).collect()}
    for d, t in texts_of(messy).items():
        n, *_, rep = brute_measure(t)
        assert got[d]["base_failed"] == (n < 50 or 100 * rep > 50 * n)
        assert not (got[d]["base_failed"] and got[d]["kept"])
    assert quality_rules.quality(empty).count() == 0
    kept = sorted(d for d, r in got.items() if r["kept"])
    assert sorted(r["doc_id"] for r in quality_rules.keep_quality(messy).collect()) == kept
    assert quality_rules.keep_quality(messy).columns == messy.columns
    assert quality_rules.keep_quality(empty).count() == 0


def test_quality_against_labels(spark):
    d = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    judged = {r["doc_id"]: r for r in queries.op6_quality_rules(spark, d).collect()}
    free = [(labels[k], r["kept"]) for k, r in judged.items() if k in labels and not r["base_failed"]]
    assert sum(bool(q) == k for q, k in free) / len(free) > 0.98


def test_em_recovers_accuracies():
    rng = np.random.default_rng(0)
    y = rng.random(40_000) < 0.85
    acc = np.array([0.95, 0.85, 0.75, 0.9])
    votes = np.where(rng.random((len(y), 4)) < acc, np.where(y, 1, -1)[:, None], np.where(y, -1, 1)[:, None])
    votes[rng.random(votes.shape) < 0.3] = 0
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    _, prior, post = quality_rules.fit_votes(patterns, counts.astype(float))
    lookup = {tuple(p): x for p, x in zip(patterns, post)}
    assert np.mean(np.array([lookup[tuple(v)] > 0.5 for v in votes]) == y) > 0.9
    assert abs(prior - 0.85) < 0.06


# --- SimHash


def brute_simhash(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 2]) for i in range(len(words) - 1)] or ([words[0]] if words else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_near(texts, radius=6):
    fp = {d: brute_simhash(t) for d, t in texts.items()}
    ids = sorted(fp)
    root = {d: d for d in ids}
    near = Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fp[a] ^ fp[b]).bit_count() <= radius:
                near[a] += 1
                near[b] += 1
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {d: (f"{fp[d]:016x}", near[d], find(d)) for d in ids}


@pytest.mark.parametrize("options", [{}, {"parts": 4, "leaf": 4}, {"parts": 2, "leaf": 8}, {"parts": 1, "leaf": 16}])
def test_near_duplicates(messy, options):
    got = simhash.near_duplicates(messy, **options)
    got = {r["doc_id"]: (f"{r['fp'] & (1 << 64) - 1:016x}", r["n_near"], r["component_id"]) for r in got.collect()}
    assert got == brute_near(texts_of(messy))


def test_clusters_across_tree_borders(spark):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 60).astype(np.uint64)
    points = [int(c) for c in centres]
    for c in centres:
        p = int(c)
        for _ in range(8):
            for k in rng.choice(64, int(rng.integers(1, 7)), replace=False):
                p ^= 1 << int(k)
            points.append(p)
    fp = np.unique(np.array(points, np.uint64))
    df = spark.createDataFrame([(int(x), 1) for x in fp.view(np.int64)], "fp long, n long")
    want = (np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 6).sum(axis=1) - 1
    for parts, leaf in ((4, 8), (3, 16), (2, 16)):
        near, forest = simhash.links(df, 6, parts, leaf)
        got = {r["fp"]: r["near"] for r in near.collect()}
        assert [got.get(int(x), 0) for x in fp.view(np.int64)] == want.tolist()
        roots = {r["node"]: r["root"] for r in simhash.components(forest).collect()}
        i, j = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 6)
        ids = fp.view(np.int64).tolist()
        assert all(roots[ids[a]] == roots[ids[b]] for a, b in zip(i, j) if a != b)


def test_keep_one(spark, messy, empty):
    want = {d for d, (_, _, c) in brute_near(texts_of(messy)).items() if c == d}
    assert {r["doc_id"] for r in simhash.keep_one(messy).collect()} == want
    assert simhash.keep_one(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0
    a, b = "one two three four five", "six seven eight nine ten"
    odd = spark.createDataFrame([(1, a), (1, a), (1, b), (None, b), (None, "x y"), (2, "x y"), (None, "lone")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["text"]) for r in simhash.keep_one(odd).collect())
    assert got == sorted([("1", a), ("1", b), ("2", "x y"), ("None", "lone")])


def test_chain_component(spark):
    n = 300
    e = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(1000, 1001)], "u long, v long")
    got = {r["node"]: r["root"] for r in simhash.components(e).collect()}
    assert got == {**{k: 0 for k in range(n + 1)}, 1000: 1000, 1001: 1000}
    assert simhash.components(e.limit(0)).count() == 0


def test_components_are_complete_or_an_error(spark):
    edges = spark.range(2000).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r["root"] for r in simhash.components(edges).collect()} == {0}
    with pytest.raises(RuntimeError):
        simhash.components(edges, most_rounds=2)


# --- mixing


def test_exponent():
    tokens = [900.0, 80.0, 15.0, 5.0]
    a, met = mixing.fit_exponent(tokens, 1000, target_entropy=1.0)
    assert met == "entropy" and a < 1 and abs(mixing.entropy(mixing.tempered([t / 1000 for t in tokens], a)) - 1.0) < 1e-9
    a, met = mixing.fit_exponent(tokens, 1000, max_repeats=3)
    weights = mixing.tempered([t / 1000 for t in tokens], a)
    assert met == "repeats" and abs(max(w * 1000 / t for w, t in zip(weights, tokens)) - 3) < 1e-6
    for none in ([], [0.0, 0.0], tokens):
        assert mixing.fit_exponent(none, sum(none)) == (1.0, "proportional")
    # flatter than the target: steeper than the sources
    tokens = [100.0, 110.0, 90.0, 105.0]
    a, met = mixing.fit_exponent(tokens, 405, target_entropy=1.317)
    assert met == "entropy" and a > 1 and abs(mixing.entropy(mixing.tempered([t / 405 for t in tokens], a)) - 1.317) < 1e-9
    a, met = mixing.fit_exponent(tokens, 405, target_entropy=0.5, max_repeats=1.5)
    weights = mixing.tempered([t / 405 for t in tokens], a)
    assert met == "repeats" and a > 1 and abs(max(w * 405 / t for w, t in zip(weights, tokens)) - 1.5) < 1e-6
    # out of reach
    assert mixing.fit_exponent([5.0] * 4, 20, target_entropy=1.0) == (1.0, "unreachable")
    assert mixing.fit_exponent(tokens, 4050, max_repeats=4) == (1.0, "unreachable")
    assert mixing.fit_exponent([9.0], 9, target_entropy=0.0, max_repeats=4) in [(0.0, "entropy"), (1.0, "entropy")]
    assert mixing.fit_exponent(tokens, 405, target_entropy=9.0) == (0.0, "unreachable")


def test_equal_sources_are_left_alone(spark):
    df = spark.createDataFrame([(k, f"one two three {k}", f"s{k % 3}") for k in range(30)], "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert {(r["__copies"], r["__met"], r["__exponent"]) for r in got} == {(1, "unreachable", 1.0)}


def test_hot_and_steep_mixtures(spark):
    """A third of all rows in one source, hundreds of small ones, repeated rows, mixes flatter and steeper than the sources."""
    rng = random.Random(4)
    body = lambda: " ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 30)))
    data = [(k, body(), "hot") for k in range(600)] + [(k, body(), f"s{k % 400}") for k in range(600, 1800)] + [(7, "the same row", "hot")] * 50
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    for options in ({}, {"entropy_share": 0.5, "max_repeats": None}, {"entropy_share": None, "max_repeats": 3.0}, {"budget": 2500}, {"entropy_share": 1.0, "max_repeats": None}):
        got = mixing.mix(df, **options).collect()
        assert len(got) == len(data) and len({r["__exponent"] for r in got}) == 1
        by = {}
        for r in got:
            by.setdefault(r["source"], []).append(r)
        total = sum(r["__tokens"] for r in got)
        budget = options.get("budget", total)
        weights = {s: rs[0]["__weight"] for s, rs in by.items()}
        assert abs(sum(weights.values()) - 1) < 1e-9
        some = [sum(r["__tokens"] for r in rs) for rs in by.values()]
        assert abs(got[0]["__exponent"] - mixing.fit_exponent(some, budget, None if (e := options.get("entropy_share", 0.95)) is None else e * math.log(sum(t > 0 for t in some)), options.get("max_repeats", 4.0))[0]) < 1e-9
        if got[0]["__met"] == "entropy":
            assert abs(mixing.entropy(weights.values()) - options.get("entropy_share", 0.95) * math.log(sum(t > 0 for t in some))) < 1e-9
        for s, rs in by.items():
            used, largest = sum(r["__tokens"] * r["__copies"] for r in rs), max(r["__tokens"] for r in rs) * (50 if s == "hot" else 1)
            assert weights[s] * budget - 0.51 <= used <= weights[s] * budget + 0.51 + largest
            same = {}
            for r in rs:
                same.setdefault((r["doc_id"], r["text"]), set()).add(r["__copies"])
            assert all(len(x) == 1 for x in same.values())


@pytest.mark.parametrize("blocks", [1, 7, 1024])
def test_mixture(messy, empty, blocks):
    t = texts_of(messy)
    count = {d: len([w for w in (x or "").translate({ord(c): " " for c in WS}).split(" ") if w]) for d, x in t.items()}
    got = mixing.mix(messy, blocks=blocks, entropy_share=None, target_entropy=1.2, max_repeats=2.5).collect()
    assert {r["doc_id"]: r["__tokens"] for r in got} == count
    by = {}
    for r in got:
        by.setdefault(r["source"], []).append(r)
    total = sum(count.values())
    shares = {s: sum(r["__tokens"] for r in rs) / total for s, rs in by.items()}
    exponent = got[0]["__exponent"]
    names = list(shares)
    weights = dict(zip(names, mixing.tempered([shares[s] for s in names], exponent)))
    for s, rs in by.items():
        want, own = weights[s] * total, sum(r["__tokens"] for r in rs)
        assert abs(rs[0]["__weight"] - weights[s]) < 1e-9
        used = sum(r["__tokens"] * r["__copies"] for r in rs)
        largest = max(r["__tokens"] for r in rs)
        assert want - 0.51 <= used <= want + 0.51 + largest
        assert max(r["__copies"] for r in rs) - min(r["__copies"] for r in rs) <= 1
        assert used <= (2.5 + 1) * own
    again = mixing.mix(messy, blocks=blocks, entropy_share=None, target_entropy=1.2, max_repeats=2.5)
    assert sorted((r["doc_id"], r["__copies"]) for r in again.collect()) == sorted((r["doc_id"], r["__copies"]) for r in got)
    copies = Counter(r["doc_id"] for r in mixing.realise(again, messy.columns).collect())
    assert copies == Counter({r["doc_id"]: r["__copies"] for r in got if r["__copies"]})
    assert mixing.mix(empty).count() == 0


# --- pieces


@pytest.fixture(scope="module")
def pieces():
    return unigram_pieces.load(queries.MODEL)


def best_score(pieces, text):
    """Viterbi by hand over characters; the score only, as equal ones may differ in tokens."""
    s = " " + text
    known = {t: pieces.scores[i] for i, t in enumerate(pieces.text) if t and i not in set(pieces.byte_ids.tolist())}
    best = [0.0] + [-math.inf] * len(s)
    for i in range(len(s)):
        if s[i].encode() not in known:
            best[i + 1] = max(best[i + 1], best[i] + pieces.unknown)
        for j in range(i + 1, min(len(s), i + 17) + 1):
            k = s[i:j].encode()
            if k in known:
                best[j] = max(best[j], best[i] + known[k])
    return best[-1]


def score_of(pieces, text, ids):
    """Score of a segmentation; each character in bytes costs the unknown score once."""
    bytes_ = set(pieces.byte_ids.tolist())
    lost = sum(1 for i in ids if i in bytes_ and pieces.text[i][0] & 0xC0 != 0x80)
    return sum(pieces.scores[i] for i in ids if i not in bytes_) + lost * pieces.unknown


def test_pieces(spark, pieces, messy):
    sample = [t for t in texts_of(messy).values() if t and len(t) < 3000] + [t for t in list(small(spark).values())[:40] if len(t) < 3000]
    sample += ["a", " ", "  a  b ", "\n", "\t\n x", "▁", "a▁b", "🙂é\u0000", "x" * 2000, "日本\n語"]
    for t in sample:
        ids = pieces.encode(t)
        assert pieces.decode(ids) == t
        assert abs(score_of(pieces, t, ids) - best_score(pieces, t)) < 1e-6
    assert pieces.encode("") == pieces.encode(None) == [] and pieces.decode([]) == ""


def test_pieces_against_the_library(spark, pieces):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(queries.MODEL, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    for i, x in enumerate(m.pieces):
        x.score = float(pieces.scores[i])
    sp = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    texts = [t for t in small(spark).values() if t][:120]
    assert sum(sp.encode(t) == pieces.encode(t) for t in texts) / len(texts) > 0.9
    assert all(abs(sum(pieces.scores[i] for i in sp.encode(t)) - sum(pieces.scores[i] for i in pieces.encode(t))) < 0.05 for t in texts if t.isascii() and "\n" not in t)


def test_pieces_across_words():
    """A model whose pieces hold spaces after words and newlines: texts are not cut, the best segmentation is found."""
    names = ["<unk>", *(f"<0x{b:02X}>" for b in range(256)), "a", "b", "▁", "a▁b", "b▁", "a\nb", "\n", "ab"]
    scores = [0.0] * 257 + [-3.0, -3.0, -3.0, -2.0, -1.0, -1.5, -4.0, -5.0]
    p = unigram_pieces.Pieces(names, scores, list(range(1, 257)), {0})
    assert not p.falls_apart and unigram_pieces.load(queries.MODEL).falls_apart
    rng = random.Random(3)
    for _ in range(60):
        text = "".join(rng.choice("ab \n") for _ in range(rng.randint(1, 12)))
        ids = p.encode(text)
        assert p.decode(ids) == text and abs(sum(scores[i] if i > 256 else p.unknown for i in ids) - best_score(p, text)) < 1e-9


def test_double_array():
    rng = random.Random(1)
    keys = {bytes(rng.choice(b"abc\xff\x00") for _ in range(rng.randint(1, 6))): k for k in range(400)}
    trie = unigram_pieces.DoubleArray(keys)
    data = bytes(rng.choice(b"abc\xff\x00") for _ in range(300))
    start, length, value = trie.matches(np.frombuffer(data, np.uint8).astype(np.int32), np.arange(300), np.full(300, 300))
    got = {(s, n): v for s, n, v in zip(start.tolist(), length.tolist(), value.tolist())}
    assert got == {(i, j - i): keys[data[i:j]] for i in range(300) for j in range(i + 1, min(300, i + 6) + 1) if data[i:j] in keys}


def test_encode_rows(messy, empty, pieces):
    out = unigram_pieces.encode(messy, queries.MODEL).collect()
    t = texts_of(messy)
    assert all(r["exact"] for r in out) and {r["doc_id"] for r in out} == set(t)
    for r in out:
        assert r["n_tokens"] == len(r["token_ids"]) and pieces.decode(r["token_ids"]) == (t[r["doc_id"]] or "")
    again = unigram_pieces.decode(unigram_pieces.encode(messy.where("length(text) < 500"), queries.MODEL), queries.MODEL).collect()
    assert all(r["decoded"] == (t[r["doc_id"]] or "") for r in again)
    assert unigram_pieces.encode(empty, queries.MODEL).count() == 0


def test_encoder_forgets(pieces):
    tight, wide = unigram_pieces.Encoder(pieces, most=5), unigram_pieces.Encoder(pieces)
    for k in range(6):
        texts = [f"word{k} and more words {k}", "", None, "and"]
        assert all((a == b).all() for a, b in zip(tight.batch(texts), wide.batch(texts)))


# --- language model


def brute_lm(texts):
    toks = {d: [*(t or "").encode().lower().split(), None] for d, t in texts.items()}
    held = {d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d in texts}
    c = Counter(w for d, ws in toks.items() if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    return {d: (held[d], len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for d, ws in toks.items()}


@pytest.mark.parametrize("options", [{}, {"exact": 4}, {"group_tokens": 5_000}, {"broadcast_bits": 1 << 29}])
def test_lm(messy, options):
    want = brute_lm(texts_of(messy))
    got = {r["doc_id"]: r for r in bloom_lm.score(messy, **options).collect()}
    assert set(got) == set(want)
    for d, w in want.items():
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4]
        assert abs(r["base_score"] - w[4]) <= 1e-9 * max(1, abs(w[4]))
        assert -math.inf < r["score"] < 0


def test_lm_edges(spark, empty):
    assert bloom_lm.score(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (1, None)], "doc_id long, text string")
    assert bloom_lm.score(odd).count() == 4


def test_lm_helps_on_held_out(spark):
    got = bloom_lm.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_lm_keeps_everything(spark, messy):
    """Rare bigrams of rare tokens count, and a filter too large to broadcast scores alike."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for df in (docs, messy):
        rows_ = [sorted(((str(r["doc_id"]), r["n_known"], round(r["base_score"], 6), round(r["score"], 9)) for r in bloom_lm.score(df, **o).collect())) for o in ({}, {"broadcast_bits": 1 << 29}, {"run_bytes": 5_000})]
        assert rows_[0] == rows_[1] == rows_[2]
    words = [f"w{k}" for k in range(9000)]
    held = next(k for k in range(99) if zlib.crc32(str(k).encode()) % 7 == 2)
    seen = next(k for k in range(99) if zlib.crc32(str(k).encode()) % 7 != 2)
    other = next(k for k in range(held + 1, 999) if zlib.crc32(str(k).encode()) % 7 == 2)
    text = " ".join(words)
    df = spark.createDataFrame([(seen, text), (held, text), (other, " ".join(words[::-1]))], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in bloom_lm.score(df).collect()}
    # every pair of the first was seen once after a token seen once with one follower: 1/2 + 1/2 * 2 / (N + V + 1)
    want = 9001 * math.log10(0.5 + 1 / (9001 + 9001 + 1))
    assert abs(got[held] - want) < 0.05 * abs(want) and got[other] < 5 * got[held]


def test_groups_answer_many_runs_together(spark):
    """The number of blobs is that of runs times that of groups, so none may cost a pass of its own; answers come back by group."""
    df = spark.createDataFrame([(k, f"text {k}") for k in range(60)], "id long, text string").coalesce(1)
    bits = spark.createDataFrame([(g, bytes([g])) for g in range(4)], "grp int, blob binary")

    def answer(grp, held, asked):
        return [x + bytes([held[0] if held else 99, min(len(asked), 255)]) for x in asked]

    def finish(rid, columns, found):
        assert [g for g, _ in found] == [0, 1, 2, 3, 4] and len({x[:-2] for _, x in found}) == 1
        return pa.RecordBatch.from_arrays([columns[0], pa.array([[x[-2] for _, x in found]] * len(rid)), pa.array([min(x[-1] for _, x in found)] * len(rid))], names=["id", "held", "together"])

    out = ask_groups(df, 1, bits, lambda texts: [(g, texts[0].as_py().encode()) for g in range(5)], answer, finish, "id long, held array<long>, together long", 1).collect()
    assert sorted(r["id"] for r in out) == list(range(60)) and all(r["held"] == [0, 1, 2, 3, 99] for r in out)
    assert min(r["together"] for r in out) == 60  # 60 runs: one pass for each group


def test_lm_many_groups(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id % 4 = 0")
    few, many = ({r["doc_id"]: r["score"] for r in bloom_lm.score(docs, group_tokens=1_000, **o).collect()} for o in ({"broadcast_bits": 1 << 29}, {"run_bytes": 20_000}))
    assert len(few) == docs.count() and few.keys() == many.keys() and all(abs(few[k] - many[k]) <= 1e-9 * abs(few[k]) for k in few)


def test_probe_in_parts(monkeypatch):
    keys = bloom_lm.item_of(np.arange(5_000, dtype=np.uint64))
    data = np.frombuffer(bloom_lm.fill(keys, np.arange(5_000) % 9 + 1), np.uint8)
    at_once = bloom_lm._probe(data, keys, np.uint64(0), np.uint64(len(data) * 8))
    monkeypatch.setattr(bloom_lm, "PROBE_ITEMS", 700)
    for start, size in ((np.uint64(0), np.uint64(len(data) * 8)), (np.zeros(5_000, np.uint64), np.full(5_000, len(data) * 8, np.uint64))):
        assert (bloom_lm._probe(data, keys, start, size) == at_once).all()
    assert (at_once >= np.arange(5_000) % 9 + 1).all()


def test_merged_and_distinct():
    rng = np.random.default_rng(3)
    parts = [np.unique(rng.integers(0, 50, 40).astype(np.uint64), return_counts=True) for _ in range(5)]
    k, n = bloom_lm._merged(parts)
    want = Counter()
    for x, c in parts:
        want.update(dict(zip(x.tolist(), c.tolist())))
    assert dict(zip(k.tolist(), n.tolist())) == want and (np.diff(k.astype(np.int64)) > 0).all()
    none = np.zeros(0, np.uint64)
    assert not len(bloom_lm._merged([(none, none)])[1]) and not len(bloom_lm._distinct(none))
    assert bloom_lm._distinct(np.array([3, 1, 3, 0], np.uint64)).tolist() == [0, 1, 3]


def test_token_hashes():
    """Words by content alone; those that collide in polynomials modulo 2**64 are told apart."""
    thue = [0]
    for _ in range(12):
        thue += [1 - x for x in thue]
    a, b = ("".join("ab"[x ^ k] for x in thue) for k in (0, 1))
    text = f"{a} {b} {a.upper()} x\tX"
    h, off = bloom_lm.token_hashes(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    assert h[0] == h[2] != h[1] and h[3] == h[4] and h[5] == bloom_lm.END and off.tolist() == [0, 6]
    one = bloom_lm._planes(h, 8)
    assert (bloom_lm._unplanes(one, 8) == h).all() and (bloom_lm._unplanes(bloom_lm._planes(h >> np.uint64(16), 6), 6) == h >> np.uint64(16)).all()


def test_filter_levels():
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 2**63, 30_000).astype(np.uint64))
    levels = bloom_lm.level(rng.zipf(1.8, len(keys)).clip(1, 10**6))
    keys, home = bloom_lm.item_of(keys), bloom_lm.group_of(bloom_lm.item_of(keys), 5)
    f = bloom_lm.Filter(6, {})
    assert not f.levels(keys).any()
    f = bloom_lm.Filter(5, {g: bloom_lm.fill(keys[home == g], levels[home == g]) for g in range(5)})
    got = f.levels(keys)
    assert (got >= levels).all() and np.mean(got == levels) > 0.95
    unseen = np.setdiff1d(bloom_lm.item_of(rng.integers(0, 2**63, 30_000).astype(np.uint64)), keys)
    assert np.mean(f.levels(unseen) == 0) > 0.95
    for c in (1, 2, 3, 4, 10, 1000):
        q = int(bloom_lm.level(np.array([c]))[0])
        assert bloom_lm._LEAST[q] <= c < bloom_lm._LEAST[q + 1] or bloom_lm._LEAST[q] == bloom_lm._LEAST[q + 1]


# --- pipeline


def test_pipeline(spark):
    import corpus_pipeline as cp

    texts = small(spark)
    kept = {d for d, r in ((r["doc_id"], r) for r in quality_rules.quality(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()) if r["kept"]}
    good = {d: texts[d] for d in kept}
    after = {d: x for d, (_, _, x) in brute_lines(good, 10, {d: c for d, (_, _, c) in brute_near(good).items()}).items()}
    one = {d: after[d] for d, (_, _, c) in brute_near(after).items() if c == d}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    mixed = mixing.mix(spark.createDataFrame([(d, t, source[d]) for d, t in one.items()], "doc_id long, text string, source string"))
    want = Counter({r["doc_id"]: r["__copies"] for r in mixed.collect() if r["__copies"]})
    out = cp.run(spark, SMALL).collect()
    assert Counter(r["doc_id"] for r in out) == want
    p = unigram_pieces.load(queries.MODEL)
    assert all(p.decode(r["token_ids"]) == one[r["doc_id"]] for r in out)


def test_pipeline_lines_of_copies(spark):
    """A line of ten documents goes, however much of them it is; a text with ten copies stays."""
    import corpus_pipeline as cp

    rng, line = random.Random(3), "the same licence line"
    say = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(30))
    own = [say() for _ in range(12)]
    copied = f"{say()}\n{say()}"
    texts = {k: f"{x}\n{line}" for k, x in enumerate(own)} | {50: f"{own[0]}\n{line}"} | {100 + k: copied for k in range(15)}
    near = brute_near(texts)
    assert near[0][1] == near[50][1] == 1 and len({near[d][2] for d in range(12)}) == 12
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    got = texts_of(cp.lines(spark, docs, SMALL))
    assert got == {d: t.removesuffix(f"\n{line}") for d, t in texts.items()}


@pytest.mark.parametrize("stage", range(4))
def test_stages_on_messy_input(spark, messy, empty, stage):
    import corpus_pipeline as cp

    _, f = cp.STAGES[stage]
    for docs in (messy, empty):
        assert f(spark, docs, SMALL).columns == cp.COLUMNS
        f(spark, docs, SMALL).write.format("noop").mode("overwrite").save()
