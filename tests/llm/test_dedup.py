import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lynceus.llm import common, exact_dedup, simhash
from tests.llm.data import docs, frame


def least(ids):
    return min((i for i in ids if i is not None), default=None)


def norm(t):
    return re.sub("[\x20\x09-\x0d]+", " ", t or "")


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.substring(F.md5(c), 1, 1)], ids=["sha", "clashing"])
@pytest.mark.parametrize("hot", [1, 100])
def test_exact(spark, monkeypatch, digest, hot):
    monkeypatch.setattr(common, "MIN_HOT_ROWS", hot)
    groups = defaultdict(list)
    for i, t in docs():
        groups[norm(t)].append(i)
    want = sorted((repr((i, least(groups[norm(t)]), len(groups[norm(t)]), i == least(groups[norm(t)])))) for i, t in docs())
    got = exact_dedup.duplicate_groups(frame(spark), digest)
    assert sorted(repr(tuple(r)[:4]) for r in got.collect()) == want
    assert exact_dedup.duplicate_groups(frame(spark, [])).count() == 0


def test_exact_digest(spark):
    got = exact_dedup.duplicate_groups(frame(spark, [(1, "a \n b"), (2, None)])).collect()
    assert {r.doc_id: r.digest for r in got} == {1: hashlib.sha256(b"a b").hexdigest(), 2: hashlib.sha256(b"").hexdigest()}


def test_drop_duplicates(spark):
    kept = exact_dedup.drop_duplicates(frame(spark))
    assert kept.columns == frame(spark, []).columns
    texts = sorted(norm(r.text) for r in kept.collect())
    assert texts == sorted({norm(t) for _, t in docs()})
    plain = [(1, "a"), (2, "a"), (3, "b")]
    assert sorted(r.doc_id for r in exact_dedup.drop_duplicates(frame(spark, plain)).collect()) == [1, 3]
    assert exact_dedup.drop_duplicates(frame(spark, [])).count() == 0


def test_lookup(spark, monkeypatch):
    monkeypatch.setattr(common, "MIN_HOT_ROWS", 3)
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(60)] + [(99, None)], "id long, k string")
    stats = rows.where("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("v"))
    got = {r.id: r.v for r in common.lookup(rows, stats, "k", F.col("id")).collect()}
    assert got == {i: 1 if i % 3 else i for i in range(60)} | {99: None}


def plain_simhash(t):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), 42) for k in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark):
    for i, t in docs():
        assert simhash.simhash(t) % (1 << 64) == plain_simhash(t), i
    assert simhash.simhash("A B") == simhash.simhash("a  b") != 0


def check_components(spark, fps, monkeypatch, **settings):
    for k, v in settings.items():
        monkeypatch.setattr(simhash, k, v)
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    classes = spark.createDataFrame([(i, f) for i, f in enumerate(signed)], "id long, fp long").repartition(3)
    found = {r.id: r.root for r in simhash.components(simhash.links(classes)).collect()}
    assert {i: found.get(i, i) for i in range(len(fps))} == {i: find(i) for i in range(len(fps))}


def families(n, size, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        f = int(rng.integers(0, 1 << 63)) * 2
        for _ in range(size):
            for b in rng.choice(64, int(rng.integers(0, 5)), replace=False):
                f ^= 1 << int(b)
            out.append(f)
    return list(dict.fromkeys(out))


def test_components(spark, monkeypatch):
    check_components(spark, families(30, 8), monkeypatch)


def test_heavy_buckets_are_cut(spark, monkeypatch):
    check_components(spark, families(2, 120, 1), monkeypatch, BUCKET=10)


@pytest.mark.parametrize("total", [10, 10**6, 10**10])
def test_plan_keeps_every_link(total):
    rng = np.random.default_rng(total)
    sample = rng.integers(0, 1 << 63, 500, dtype="uint64")
    plan = simhash.plan(sample, total, 3)
    bits = [b for part, _ in plan for b in part]
    assert len(bits) == len(set(bits))
    for _ in range(300):
        flips = set(rng.choice(64, 3, replace=False).tolist())
        assert any(len(flips & set(part)) <= t for part, t in plan)


def test_near_duplicates(spark):
    rows = docs()
    fps = [plain_simhash(t) for _, t in rows]
    group = list(range(len(rows)))  # rows with one id are one document
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(a):
                if group[a] != group[b] and ((fps[a] ^ fps[b]).bit_count() <= 3 or (rows[a][0] == rows[b][0] and rows[a][0] is not None)):
                    group = [group[b] if g == group[a] else g for g in group]
                    changed = True
    names = {g: least(rows[k][0] for k in range(len(rows)) if group[k] == g) for g in set(group)}
    got = simhash.near_duplicates(frame(spark)).collect()
    assert sorted(repr((r.doc_id, r.fp % (1 << 64), r.component_id)) for r in got) == sorted(repr((rows[k][0], fps[k], names[group[k]])) for k in range(len(rows)))
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    kept = simhash.drop_near_duplicates(frame(spark, [(5, "a b c d"), (3, "A b  c d"), (9, "q r s t u")]))
    assert sorted(r.doc_id for r in kept.collect()) == [3, 9] and kept.columns == frame(spark, []).columns


def test_rounds_grow_as_a_logarithm(spark):
    """A chain of 4,096 ids in a shuffled order, with a star beside it, takes few rounds."""
    order = list(range(1, 4097))
    random.Random(5).shuffle(order)
    edges = list(zip(order, order[1:])) + [(5000, 5000 + k) for k in range(1, 300)]
    found, rounds = simhash._components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.root for r in found.where("id < 5000").select("root").distinct().collect()} == {1} and found.where("id >= 5000 and root <> 5000").isEmpty()
    assert found.count() == 4096 + 300 and rounds < 20
