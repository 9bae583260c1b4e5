"""Exact duplicates, ranked search and resampling, held against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gridloom.llm import exact_dedup, lexical_search, resampling

SCHEMA = "doc_id long, text string, keep_id string, at string, recipe string"


def prose(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlcumwé") for _ in range(rng.randint(1, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    passage = prose(rng, 300)
    found = [(k, prose(rng, rng.randint(1, 200)) + passage * (k % 4), "x", None, "y") for k in range(40)]
    found += [(100 + k, found[k][1].replace(" ", "\n  "), None, "x", None) for k in range(0, 40, 2)]
    found += [(200 + k, passage, None, None, None) for k in range(50)] + [(199, passage + "\t", None, None, None)]
    found += [(300, None, "x", "x", "x"), (301, "", None, None, None), (302, " \r\n\v\f\t", None, None, None), (None, " ", None, None, None),
              (None, "only without id", None, None, None), (400, "same", None, None, None), (400, "same", None, None, None),
              (401, "a" * 200_000, None, None, None), (402, "a" * 200_001, None, None, None), (403, "日本語のテキスト" * 3000, None, None, None),
              (404, "日本語 のテキスト" * 3000, None, None, None), (405, "ea" + " ", None, None, None), (406, "ea", None, None, None)]
    return found


def equal_groups(rows):
    groups: dict[str, list] = {}
    for at, r in enumerate(rows):
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", r[1] or ""), []).append((-len(r[1] or ""), r[0] is None, r[0] or 0, at))
    want = []
    for text, found in groups.items():
        first = rows[min(found)[3]][0]
        for _, none, key, at in found:
            want.append((rows[at][0], first, len(found), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(want, key=str), len(groups)


@pytest.mark.parametrize("settings", [exact_dedup.Settings(), exact_dedup.Settings(least=20, most=64, bits=4)])
def test_equal_texts_equal_brute_force(spark, rows, settings):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want, groups = equal_groups(rows)
    got = exact_dedup.equal_texts(df, settings=settings).collect()
    assert sorted(((r["row"]["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == groups and all(r["row"]["doc_id"] == r["keep_id"] for r in kept)


def test_few_hot_groups_and_many_others(spark, rows, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_SHARE", 10)
    df = spark.createDataFrame(rows, SCHEMA)
    got = exact_dedup.equal_texts(df, keep=["doc_id"]).collect()
    assert sorted(((r["row"]["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == equal_groups(rows)[0]


@pytest.mark.parametrize("bits", [64, 3])
def test_texts_come_back_from_recipes(spark, rows, bits):
    settings = exact_dedup.Settings(least=16, most=128, bits=bits)
    df = spark.createDataFrame(rows, SCHEMA)
    store, recipes = exact_dedup.chunk_store(df, settings=settings), exact_dedup.recipes(df, settings=settings)
    back = exact_dedup.rebuilt(recipes, store).join(recipes, "at").select("t", "row.text", "text_sha256").collect()
    assert len(back) == len(rows)
    for r in back:
        assert r["t"] == re.sub("[\x20\x09-\x0d]", "", r["text"] or "") and hashlib.sha256(r["t"].encode()).hexdigest() == r["text_sha256"]
    pieces = [bytes(r["chunk"]) for r in store.collect()]
    assert len(pieces) == len(set(pieces)) and max(map(len, pieces)) <= 128


def test_equal_texts_keep_columns_and_take_no_rows(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    kept = exact_dedup.keep_one(df)
    assert kept.columns == df.columns and kept.count() == equal_groups(rows)[1]
    none = exact_dedup.equal_texts(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0 and exact_dedup.keep_one(spark.createDataFrame([], SCHEMA)).columns == df.columns


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def hard_texts():
    rng = random.Random(3)
    found = [(k, " ".join(rng.choice(["Ab", "cd,", "é1", "the", "ZÜ-q", "x\x00y", "12", "日本"]) for _ in range(rng.randint(0, 60))), "x", None, "y")
             for k in range(120)]
    return found + [(500, None, None, None, None), (501, "", None, None, None), (502, " -- \n", None, None, None), (None, "the cd " * 15, None, None, None),
                    (503, "the cd " * 15, None, None, None), (503, "the cd " * 15, None, None, None), (504, "one " * 3000 + "Two three", None, None, None),
                    (505, "x" * 50_000 + " y", None, None, None)]


TARGET = [(1, "the cd the é1 12", "x"), (2, None, None), (3, "AB cd 日本 - ab", None)]


def brute_resampling(rows, target, settings):
    def runs(text):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(text))
        return len(w), [" ".join(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    def bucket(f):
        return zlib.crc32(f.encode()) % settings.buckets

    s, t = (Counter(bucket(f) for r in side for f in runs(r[1])[1]) for side in (rows, target))
    all_s, all_t = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1) * (all_s + settings.buckets) / ((s[b] + 1) * (all_t + settings.buckets))))

    scored = []
    for at, r in enumerate(rows):
        n, found = runs(r[1])
        h = int(hashlib.sha256(f"42:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in found)
        scored.append([r[0], len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((x for x in scored if x[5] >= settings.least_words), key=lambda x: (-x[3], x[0] is None, x[0]))
    for place, x in enumerate(able[:len(able) * settings.percent // 100]):
        x[4] = place + 1
    return [tuple(x[:5]) for x in scored]


@pytest.mark.parametrize("cut", [(1 << 20, 1 << 16), (100, 7)])
def test_resampling_equals_brute_force(spark, monkeypatch, cut):
    monkeypatch.setattr(resampling, "BUFFER", cut[0])
    monkeypatch.setattr(resampling, "SLICE", cut[1])
    settings = resampling.Settings(buckets=97, percent=40)
    df = spark.createDataFrame(hard_texts(), "doc_id long, text string, score string, rank string, n_words string").repartition(3)
    target = spark.createDataFrame(TARGET, "item_id long, text string, weight string")
    got = resampling.resampled(df, target, settings=settings).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_resampling(hard_texts(), TARGET, settings)))
    chosen = resampling.drawn(df, target, settings=settings)
    assert chosen.columns == df.columns and {r["doc_id"] for r in chosen.collect()} == {r["doc_id"] for r in got if r["rank"] and r["doc_id"] is not None}


def test_runs_of_one_buffer_stay_within_documents(monkeypatch):
    monkeypatch.setattr(resampling, "SLICE", 2)
    texts = ["a b c", "d", "", "e f\x00g h"]
    joined = b"\x00".join(t.encode() for t in texts)
    begins = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
    got = Counter()
    for _, owner, bucket in resampling.features(joined, begins, 1 << 32):
        got.update(zip(owner.tolist(), bucket.tolist()))
    want = ["a", "b", "c", "a b", "b c", "a b c"], ["d"], [], ["e", "f", "g", "h", "e f", "f g", "g h", "e f g", "f g h"]
    assert got == Counter((k, zlib.crc32(f.encode())) for k, fs in enumerate(want) for f in fs)


def test_resampling_of_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resampled(none, none).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [tuple(r)[:3] for r in resampling.resampled(one, none).collect()] == [(1, 2, 3)]


def brute_search(rows, items, k):
    def terms(text):
        return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lowered(text))

    docs = [(r[0], Counter(terms(r[1]))) for r in rows]
    docs = [(key, c, c.total()) for key, c in docs if c]
    n_docs, words = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item in items:
        hits = []
        for key, c, n in docs:
            m = 100 - 50 + 50 * n * n_docs // words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                        for t in set(terms(item[1])) if c[t])
            if score > 0:
                hits.append((-score, key is None, key or 0))
        out += [(item[0], at + 1, None if none else key, -score) for at, (score, none, key) in enumerate(sorted(hits)[:k])]
    return out


@pytest.mark.parametrize("shard,first,terms,k", [(16_384, 64, 200_000, 5), (16, 2, 3, 5), (40, 1, 200_000, 50)])
def test_search_equals_brute_force(spark, monkeypatch, shard, first, terms, k):
    for name, value in (("SHARD", shard), ("FIRST_READ", first), ("BLOCK_TERMS", terms)):
        monkeypatch.setattr(lexical_search, name, value)
    items = [*TARGET, (None, "q zü the 12", None), (7, "x y one", None), (7, "x y one", None), (8, "nowhere", None)]
    df = spark.createDataFrame(hard_texts(), "doc_id long, text string, q string, n string, rank string").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string, rank string")
    got = lexical_search.search(df, asked, k=k).collect()
    assert sorted(((r["row"]["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got), key=str) == sorted(brute_search(hard_texts(), items, k), key=str)


def test_reading_stops_early_and_long_texts_are_cut_between_terms(monkeypatch):
    size = 20_000
    rng = np.random.default_rng(5)
    impact = np.sort(rng.integers(1, 1000, size))[::-1].copy()
    impact[:40] += 5000
    reads = []

    class Watched(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                reads.append(key.stop)
            return super().__getitem__(key)

    owner = rng.permutation(size).view(Watched)
    found, scores = lexical_search.nra([(owner, impact)], size, 10)
    assert len(found) >= 10 and sorted(scores.tolist())[::-1][:10] == impact[:10].tolist() and max(reads) < 200
    monkeypatch.setattr(lexical_search, "WINDOW", 10)
    text = ("abc DEFG\u00e9 " * 50 + "k" * 40 + "-z").encode()
    assert [t for w in lexical_search.windows(text) for t in lexical_search.TERM.findall(w)] == lexical_search.TERM.findall(text.lower())


def test_search_of_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lexical_search.search(none, none).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert lexical_search.search(none, one).count() == 0 and lexical_search.search(one, none).count() == 0
    assert lexical_search.search(one, one).count() == 1
