"""Operators across rows: near-duplicates of texts and vectors, groups, packing, the pipeline."""

from __future__ import annotations

import bisect
import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from gridloom.llm import clusters, embedding_dedup, minhash_dedup, packing, quality_rules, tokens


def closure(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        ra, rb = sorted((find(a), find(b)))
        root[rb] = ra
    return {n: find(n) for n in nodes}


def test_groups_equal_union_find(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 460)] + [(900, k) for k in range(901, 980)]
    got = {r["node"]: r["root"] for r in clusters.groups(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == closure(nodes, [x for x in links if x[0] != x[1]])
    assert clusters.groups(spark.createDataFrame([], "a long, b long")).count() == 0


def texts():
    rng = random.Random(8)
    words = [f"w{k}" for k in range(3000)]
    base = [[rng.choice(words) for _ in range(rng.randint(20, 120))] for _ in range(40)]
    rows, at = [], 0
    for k, doc in enumerate(base):
        for _ in range(1 + 3 * (k % 3 == 0)):
            copy = list(doc)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((at, " ".join(copy), "x"))
            at += 1
    big = [rng.choice(words) for _ in range(200)]
    for _ in range(60):  # one large group of near copies
        copy = list(big)
        copy[rng.randrange(200)] = rng.choice(words)
        rows.append((at, "\t".join(copy).upper(), "x"))
        at += 1
    rows += [(500, None, None), (501, "", "x"), (502, " \n ", "x"), (503, "one Two", "x"), (504, "ONE two", "x"), (None, "one two", "x"),
             (505, "solo", None), (505, "solo", None), (506, "word " * 20_000, "x"), (507, "word", "x")]
    return rows


def sets_of(rows, size):
    found = []
    for _, text, _ in rows:
        words = (text or "").encode().lower().split()
        found.append(frozenset(tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset())
    return found


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_all_pairs(spark, size, percent):
    rows = texts()
    sets = sets_of(rows, size)
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    root = closure(range(len(rows)), links)
    ids = {}
    for k, r in root.items():
        if rows[k][0] is not None:
            ids[r] = min(ids.get(r, 10**9), rows[k][0])
    want = sorted((rows[k][0] if rows[k][0] is not None else -1, len(sets[k]), ids[root[k]], rows[k][0] == ids[root[k]]) for k in root)
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    settings = minhash_dedup.Settings(words=size, percent=percent)
    got = minhash_dedup.near_duplicates(df, settings=settings).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"], r["component_id"], r["kept"]) for r in got) == want
    kept = minhash_dedup.keep_one(df, settings=settings)
    assert kept.columns == df.columns
    stay = kept.collect()
    blank = sum(not s for s in sets)
    assert len(stay) == blank + len({root[k] for k in root if sets[k]})


def test_superminhash_estimates_similarity_and_fills_every_slot():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 62, 600, dtype=np.uint64))
    b = np.concatenate([a[:400], np.unique(rng.integers(0, 1 << 62, 200, dtype=np.uint64))])
    sa, sb, one = minhash_dedup.signatures([a, b, a[:1]], 1000)
    assert abs((sa == sb).mean() - 400 / 800) < 0.06
    assert sorted((one >> np.uint64(32)).tolist()) == list(range(1000))
    assert (minhash_dedup.signatures([a], 1000)[0] == sa).all()


def test_no_texts(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash_dedup.near_duplicates(empty).count() == 0 and minhash_dedup.keep_one(empty).count() == 0


def test_vectors_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 20)  # so that the large group is dealt into several blocks
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 32))
    rows = [(k, v.tolist()) for k, v in enumerate(base)]
    rows += [(100 + k, (base[0] * 3 + 0.1 * rng.normal(size=32)).tolist()) for k in range(70)]
    rows += [(200 + k, (base[k % 60] + 0.45 * rng.normal(size=32)).tolist()) for k in range(60)]
    rows += [(300, base[5].tolist()), (300, base[5].tolist()), (None, base[6].tolist()), (301, [0.0] * 32), (302, None), (303, []),
             (304, [float("nan")] * 32), (305, [None] + [1.0] * 31), (306, [1.0, 0.0]), (307, [2.0, 0.01]), (308, [1e300] * 32), (309, [1e-300] * 32)]
    good = [k for k, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)]
    unit = {}
    for k in good:
        v = np.array(rows[k][1])
        v = v / np.abs(v).max()
        unit[k] = v / np.sqrt((v * v).sum())
    links = [(a, b) for a in good for b in good if b < a and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9]
    degree = {k: 0 for k in range(len(rows))}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    root, ids = closure(range(len(rows)), links), {}
    for k, r in root.items():
        if rows[k][0] is not None:
            ids[r] = min(ids.get(r, 10**9), rows[k][0])
    want = sorted((rows[k][0] if rows[k][0] is not None else -1, degree[k], ids[root[k]]) for k in root)
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["n_links"], r["component_id"]) for r in got) == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_no_vectors(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("counts,space", [({5: 2, 7: 1}, 16), ({9: 3, 4: 2}, 30), ({3: 10}, 100), ({2048: 1}, 10)])
def test_fullest_combination(counts, space):
    best = 0
    for picked in np.ndindex(*[c + 1 for c in counts.values()]):
        total = sum(n * k for n, k in zip(counts, picked))
        best = max(best, total if total <= space else 0)
    taken = packing.fullest(dict(counts), space, max(counts))
    assert sum(n * k for n, k in taken.items()) == best
    assert all(k <= counts[n] for n, k in taken.items())


def test_plan_places_every_piece_once():
    rng = random.Random(6)
    counts = {rng.randint(1, 64): rng.randint(1, 50) for _ in range(30)}
    runs = packing.plan(dict(counts), 64)
    filled, seen = {}, {}
    for length, first, last, sequence, per_bin, offset in runs:
        for place in range(first, last):
            at = (sequence + (place - first) // per_bin, offset + (place - first) % per_bin * length)
            filled.setdefault(at[0], []).append((at[1], length))
            seen[length] = seen.get(length, 0) + 1
    assert seen == counts
    for pieces in filled.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 64
    bins: list[int] = []
    for length in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):  # first fit, longest first
        at = next((k for k, room in enumerate(bins) if room >= length), None)
        if at is None:
            bins.append(64 - length)
        else:
            bins[at] -= length
    assert len(filled) <= len(bins)


def best_fit(counts, capacity):
    """Sequences that best fit takes, longest piece first."""
    rooms: list[int] = []
    for length in sorted(counts.elements(), reverse=True):
        at = bisect.bisect_left(rooms, length)
        bisect.insort(rooms, rooms.pop(at) - length if at < len(rooms) else capacity - length)
    return len(rooms)


@pytest.mark.parametrize("kind", range(6))
def test_plan_is_never_worse_than_best_fit(kind):
    rng = random.Random(kind)
    draw = [lambda: rng.gauss(700, 150), lambda: rng.gauss(rng.choice([300, 1100]), 120), lambda: rng.lognormvariate(6, 1), lambda: rng.uniform(1, 2048),
            lambda: rng.choice([1025, 683, 513, 200]) + rng.randint(-20, 20), lambda: rng.gauss(500, 40)][kind]
    for size in (50, 300, 1000):
        counts = Counter(int(min(2048, max(1, draw()))) for _ in range(size))
        used = max(sequence + (last - first) // per_bin for _, first, last, sequence, per_bin, _ in packing.plan(dict(counts)))
        assert packing.least_sequences(counts, 2048) <= used <= best_fit(counts, 2048)


def test_packed_pieces_give_every_document_back(spark):
    rows = [(k, f"document {k} " + "lorem ipsum dolor " * (k % 40), "x") for k in range(150)] + [(None, None, None), (1, "document 1 ", "x"), (900, "", None), (901, "word " * 9000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = packing.pack(df, capacity=256).collect()
    encode = tokens.encoder(tokens.default_path())
    want = []
    for key, text, _ in rows:
        ids = np.append(tokens.ids_of(encode, text), np.array([0], "<u4"))
        head = len(ids) % 256 or 256
        edges = [0, *range(head, len(ids) + 1, 256)]
        want += [(-1 if key is None else key, k, a, b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in bins.values():
        ends = np.cumsum([0] + [n for _, n in sorted(pieces)])
        assert [o for o, _ in sorted(pieces)] == ends[:-1].tolist() and ends[-1] <= 256
    assert len(bins) <= best_fit(Counter(r["length"] for r in got), 256)
    assert packing.pack(spark.createDataFrame([], df.schema)).count() == 0


def test_stages_keep_clean_documents_and_their_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    clean = {r["doc_id"] for r in labels.where("quality = 1 AND toxic = 0").collect()}
    at = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, at, "/root/testdata/sf0.01")
        assert out.columns == docs.columns, name
        before, after = {r["doc_id"] for r in at.collect()}, {r["doc_id"] for r in out.collect()}
        assert after <= before
        if name == "language":
            assert len(before - after) < 0.01 * len(before)
        if name == "quality":
            words = {r["doc_id"]: len((r["text"] or "").split()) for r in at.collect()}
            failed = {r["row"]["doc_id"] for r in quality_rules.judged(at).collect() if r["base_failed"]}  # the stated base rule, whatever the label
            lost = {d for d in (before - after) & clean if words[d] >= 10} - failed
            assert len(lost) < 0.01 * len(clean)
        at = spark.createDataFrame(out.collect(), docs.schema)
    packed = corpus_pipeline.STAGES[4][1](spark, at, "/root/testdata/sf0.01").collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in at.collect()}
