"""SimHash near-duplicate groups by the general pigeonhole principle.

Fingerprints are linked at up to `distance` differing bits. Bits that go together are put into one part, so
that parts are as independent as can be, and each part gets a threshold of its own, at least -1: if the
thresholds plus one sum to distance plus one, two linked fingerprints differ in no more than its threshold
in at least one part. Dynamic programming over candidate counts, estimated from a sample of fingerprints,
chooses the thresholds; a wrong estimate costs time, never a link. A fingerprint is probed under its part's
value and every value within the threshold. All fingerprints under one key are compared, but only as many
links leave the task as connect them, and keys with many fingerprints are cut on by further bits first.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynceus.llm.common import discard, lookup, small, table

#: Fingerprints that the plan is made from.
PLAN_SAMPLE = 20_000
#: Fingerprints under one key from which on the key is cut further, how often at most, and words hashed at a time.
BUCKET, CUTS, CHUNK = 4_000, 12, 1 << 16
#: Heavy keys that are broadcast, of about 60 bytes each; more of them are joined by a shuffle.
MAX_HEAVY = 200_000
#: Classes without any doc_id are numbered from here on, so that ids that exist come first.
NAMELESS = 1 << 62
UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz     ")


def simhash(text: str | None, width: int = 3) -> int:
    """The fingerprint of a text, as a signed 64-bit integer; 0 for a text without words."""
    import xxhash

    words = (text or "").encode().translate(UPPER).split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), "int64", len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    lasts = ends[width - 1 :] if len(words) >= width else ends[-1:]
    counts, h = np.zeros(64, "int64"), xxhash.xxh64_intdigest
    for k in range(0, n, CHUNK):
        hashes = np.array([h(joined[a:b], 42) for a, b in zip(starts[k : k + CHUNK][: n - k].tolist(), lasts[k : k + CHUNK].tolist())], "<u8")
        counts += np.unpackbits(hashes.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="int64")
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and fp (signed 64-bit) of every row of docs, from whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [simhash(x.as_py(), width) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _extract(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    """The value that the given bits make."""
    out = np.zeros(len(fps), "uint64")
    for i, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(i)
    return out


def plan(sample: np.ndarray, total: int, distance: int, bits: int = 64) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part that is probed.

    For each number of parts from 1 to distance + 1, bits are dealt so that correlated ones share a part, and
    thresholds that sum to distance + 1 - parts are chosen by dynamic programming; the cheapest plan wins.
    The cost is the number of probes and of candidate pairs, scaled from the sample to all fingerprints.
    """
    fps = sample.astype("uint64") if len(sample) > 1 else np.arange(2, dtype="uint64")
    ones = ((fps[:, None] >> np.arange(bits, dtype="uint64")) & np.uint64(1)).astype("float64")
    ones -= ones.mean(0)
    norm = np.sqrt((ones**2).sum(0)) + 1e-9
    corr = np.abs(ones.T @ ones) / np.outer(norm, norm)
    total = max(total, len(fps))
    scale, best = total / len(fps), (np.inf, [])
    for m in range(1, distance + 2):
        parts, left = [], list(range(bits))
        for i in range(m):  # seeded with the bit least like those taken, filled with those most like its own
            size = (bits - sum(map(len, parts))) // (m - i)
            taken = [b for p in parts for b in p]
            part = [min(left, key=lambda b: (corr[b, taken].sum() if taken else 0, b))]
            left.remove(part[0])
            while len(part) < size:
                part.append(max(left, key=lambda b: (corr[b, part].sum(), -b)))
                left.remove(part[-1])
            parts.append(sorted(part))
        costs = []
        for part in parts:
            values, counts = np.unique(_extract(fps, part), return_counts=True)
            same = (counts.astype("float64") * (counts - 1)).sum() / 2 * scale**2  # pairs that agree in the part
            uniform = (total**2 / 2) / 2.0 ** len(part)
            per = {-1: 0.0}
            for t in range(distance + 1):
                probes = sum(len(list(combinations(range(len(part)), k))) if len(part) <= 24 or k < 3 else len(part) ** k // 6 for k in range(t + 1))
                per[t] = (total * probes * 8) + max(same, uniform) * probes
            costs.append(per)
        # reach[s]: the least cost of thresholds so far that, each plus one, sum to s.
        reach = {0: (0.0, [])}
        for per in costs:
            step: dict[int, tuple[float, list[int]]] = {}
            for s, (c, ts) in reach.items():
                for t in range(-1, distance - s + 1):
                    step[s + t + 1] = min(step.get(s + t + 1, (np.inf, [])), (c + per[t], [*ts, t]))
            reach = step
        cost, thresholds = reach[distance + 1]
        if cost < best[0]:
            best = (cost, [(p, t) for p, t in zip(parts, thresholds, strict=True) if t >= 0])
    return best[1]


def _gather(fp: Column, bits: list[int]) -> Column:
    """The value that the given bits make, in few shifts: runs of bits move together."""
    runs, out = [], F.lit(0).cast("long")
    for i, b in enumerate(bits):
        if runs and runs[-1][0] + runs[-1][2] == b:
            runs[-1][2] += 1
        else:
            runs.append([b, i, 1])
    for b, i, n in runs:
        mask = (1 << n) - 1
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, b).bitwiseAND(F.lit(mask).cast("long") if n < 64 else F.lit(-1).cast("long")), i))
    return out


def _probes(fp: Column, plan_: list[tuple[list[int], int]]) -> Column:
    """An array of (part, key) under which a fingerprint is found; at part's threshold t, all keys within t bits."""

    def keyed(i: int, key: Column, masks: Column) -> Column:
        return F.transform(masks, lambda m: F.struct(F.lit(i).alias("part"), key.bitwiseXOR(m).alias("key")))

    every = []
    for i, (part, t) in enumerate(plan_):
        flips = [0] + [sum(1 << b for b in c) for k in range(1, t + 1) for c in combinations(range(len(part)), k)]
        masks = F.array(*[F.lit(x).cast("long") for x in flips])
        every.append(keyed(i, _gather(fp, part), masks))
    return F.concat(*every)


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Index pairs that connect all fingerprints that chains of links connect; at most len(fps) - 1."""
    left, links = np.arange(len(fps)), []
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            at = front.pop()
            near = popcount(fps[left] ^ fps[at]) <= distance
            for x in left[near].tolist():
                links.append((at, x))
                front.append(x)
            left = left[~near]
    return links


def _linker(distance: int):
    """Reads rows sorted by (part, key, sub); writes links between the fingerprints under one key."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def group(ids: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fps, first = np.unique(fps, return_index=True)
        links = _forest(fps, distance)
        pairs = np.array(links, "int64").reshape(-1, 2)
        return ids[first[pairs[:, 0]]], ids[first[pairs[:, 1]]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def links(keys, ids, fps, ends) -> pa.RecordBatch:
            a, b = [], []
            sizes = np.diff(ends)
            # Short groups together: each row with the next, the one after it, and so on.
            small_rows = np.repeat(sizes <= 32, sizes)
            for d in range(1, int(sizes[sizes <= 32].max(initial=1))):
                i = np.flatnonzero(small_rows[:-d] & (keys[:-d] == keys[d:]))
                i = i[(popcount(fps[i] ^ fps[i + d]) <= distance) & (ids[i] != ids[i + d])]
                a.append(ids[i])
                b.append(ids[i + d])
            for g in np.flatnonzero(sizes > 32):
                x, y = group(ids[ends[g] : ends[g + 1]], fps[ends[g] : ends[g + 1]])
                a.append(x)
                b.append(y)
            cat = [np.concatenate(x) if x else np.zeros(0, "int64") for x in (a, b)]
            pairs = np.unique(np.stack([np.minimum(*cat), np.maximum(*cat)]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in pairs], schema=schema)

        for batch in batches:
            held.append((batch.column("bucket").to_numpy(zero_copy_only=False), batch.column("id").to_numpy(), batch.column("fp").to_numpy().view("uint64")))
            if batch.num_rows and held[0][0][0] == held[-1][0][-1]:
                continue  # the group goes on
            yield from flush(held, links, whole=False)
        if held:
            yield from flush(held, links, whole=True)

    def flush(held, links, whole):
        keys, ids, fps = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        if not len(keys):
            return
        ends = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
        if not whole:
            cut = ends[-2]
            held.append((keys[cut:], ids[cut:], fps[cut:]))
            keys, ids, fps, ends = keys[:cut], ids[:cut], fps[:cut], ends[:-1]
        if len(keys):
            yield links(keys, ids, fps, ends)

    return run


def _cut_further(probes: DataFrame, plan_: list[tuple[list[int], int]], distance: int, level: int) -> tuple[DataFrame, bool]:
    """Keys with more than BUCKET fingerprints are cut by distance + 1 groups of bits, one of which linked ones share."""
    probes = table(probes, "simhash-probes")
    heavy = table(probes.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUCKET), "simhash-heavy")
    if heavy.isEmpty():
        return probes, False
    heavy = small(heavy.select(F.col("bucket").alias("_b")), MAX_HEAVY)
    dense = probes.join(heavy, F.col("bucket") == F.col("_b"), "left_semi")
    groups = []
    for g in range(distance + 1):
        bits = [b for b in range(64) if (b // (level + 1) + b * level) % (distance + 1) == g]
        groups.append(F.struct(F.lit(g).alias("g"), _gather(F.col("fp"), bits).alias("v")))
    dense = dense.withColumn("_g", F.explode(F.array(*groups))).select(F.concat_ws("/", "bucket", F.concat_ws(".", F.lit(level), "_g.g", F.hex("_g.v"))).alias("bucket"), "id", "fp")
    light = probes.join(heavy, F.col("bucket") == F.col("_b"), "left_anti")
    return light.unionByName(dense), True


def links(classes: DataFrame, distance: int = 3) -> DataFrame:
    """(a, b) of ids whose fingerprints connect; classes has an id for each different fp.

    Not all links come out, but every chain of links is replaced by a chain of those that do.
    """
    n = classes.count()
    share = min(1.0, 2 * PLAN_SAMPLE / max(n, 1))
    sampled = classes.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(PLAN_SAMPLE).select("fp").collect()
    chosen = plan(np.array([r.fp for r in sampled], "int64").view("uint64"), n, distance)
    probes = classes.withColumn("_p", F.explode(_probes(F.col("fp"), chosen))).select(F.concat_ws(".", "_p.part", F.hex("_p.key")).alias("bucket"), "id", "fp")
    for level in range(CUTS):
        probes, more = _cut_further(probes, chosen, distance, level)
        if not more:
            break
    dealt = probes.repartition("bucket").sortWithinPartitions("bucket", "id")
    return dealt.mapInArrow(_linker(distance), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every id of edges (a, b): root is the smallest id that chains of edges reach."""
    return _components(edges)[0]


def _components(edges: DataFrame) -> tuple[DataFrame, int]:
    """The components and the number of rounds they took.

    Every id has a parent, at first the smallest id next to it. In a round an id sees the smallest grandparent of
    its neighbours; it takes that as its parent if it is smaller, so does its parent (which moves whole trees at
    once), and every id climbs to its grandparent. Parents only fall, and stay within a component. Trees merge
    and halve their height in each round, so rounds grow as the logarithm of the longest chain. All of it is joins
    of tables in the shared folder, those of a round deleted after it. No id has more edges than there are
    fingerprints near it, so edges have no hot key; parents may have, and are looked up in a way that spreads them.
    """
    both = table(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    parents = table(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).select(F.col("a").alias("id"), "root"), "parents")
    rounds = 0
    while True:
        rounds += 1
        sizes = parents.groupBy(F.col("root").alias("_r")).agg(F.count(F.lit(1)).alias("n"))
        known = table(sizes.join(parents.select(F.col("id").alias("_r"), F.col("root").alias("up")), "_r", "left"), "grandparents")
        up = lookup(parents.withColumnRenamed("root", "_r"), known, "_r", F.xxhash64("id"))
        up = table(up.select("id", F.col("_r").alias("root"), F.coalesce("up", "_r").alias("up")), "heights")
        near = both.join(up.select(F.col("id").alias("b"), "up"), "b").groupBy("a").agg(F.min("up").alias("near"))
        seen = table(up.join(near, up.id == near.a).select("id", "root", "up", "near"), "neighbours")
        hooks = seen.groupBy(F.col("root").alias("_h")).agg(F.min("near").alias("hook"))
        lowest = F.least("root", "up", "near", F.coalesce("hook", "root"))
        after = table(seen.join(hooks, F.col("id") == F.col("_h"), "left").select("id", lowest.alias("root"), (lowest < F.col("root")).alias("fell")), "parents")
        done = after.where("fell").isEmpty()
        discard(parents, known, up, seen)
        parents = after
        if done:
            discard(both)
            return parents.select("id", "root"), rounds


def near_duplicates(docs: DataFrame, distance: int = 3, width: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, fp (signed), component_id, the smallest doc_id that links reach.

    docs needs doc_id and text; other columns are ignored. Texts without words (null ones too) have
    fingerprint 0 and link like any other. Rows that share a doc_id count as one document, which links as each
    of its texts does. A row with a null doc_id links too but never names a component, so a component
    without any id has a null one. An empty table gives an empty result.
    """
    keys = table(fingerprints(docs, width), "fingerprints")
    classes = table(keys.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n")).withColumn("id", F.coalesce("id", F.lit(NAMELESS) + F.shiftrightunsigned(F.xxhash64("fp"), 2))), "classes")
    found = links(classes.select("id", "fp"), distance)
    several = keys.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("doc_id IS NOT NULL AND lo <> hi").select("doc_id")
    if not several.isEmpty():  # one id with different texts
        own = keys.join(several, "doc_id", "left_semi").distinct().join(classes.select("fp", "id"), "fp").groupBy("doc_id").agg(F.collect_set("id").alias("ids"), F.min("id").alias("a"))
        found = found.unionByName(own.select("a", F.explode("ids").alias("b")).where("a <> b")).distinct()
    roots = components(found)
    named = classes.join(roots, "id", "left").select("fp", "n", F.coalesce("root", "id").alias("component_id"))
    named = named.withColumn("component_id", F.when(F.col("component_id") < NAMELESS, F.col("component_id")))
    return lookup(keys, table(named, "class-components"), "fp", F.xxhash64("doc_id"))


def drop_near_duplicates(docs: DataFrame, distance: int = 3, width: int = 3) -> DataFrame:
    """The rows of docs, with all their columns, of which no row with a smaller doc_id is a near duplicate.

    A row with a null doc_id stays if no row with an id is near it.
    """
    groups = table(near_duplicates(docs, distance, width), "near-groups")
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"))  # columns of docs may have any name
    kept = whole.join(gone.hint("shuffle_hash"), F.col("id") == F.col("_gone"), "left_anti")
    known = groups.where("doc_id IS NULL AND component_id IS NOT NULL").select(F.col("fp").alias("_gone")).distinct()
    if known.isEmpty():
        return kept.select("row.*")

    @F.pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, width) for t in texts], dtype="int64")

    nameless = whole.where("id IS NULL").withColumn("_fp", fingerprint(F.col("row.text")))
    nameless = nameless.join(known, F.col("_fp") == F.col("_gone"), "left_anti").select("row.*")
    return kept.where("id IS NOT NULL").select("row.*").unionByName(nameless)
