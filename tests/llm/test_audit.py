"""Conversation tries, filter audits and quality rules against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import zstandard

from lynceus.llm import filter_audit, prefix_trie, quality_rules
from tests.llm.data import docs, frame

WORD = re.compile("[^\x20\x09-\x0d]+")


def link(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def plain_trie(rows):
    """{(sequence of turns): the eight columns}, prefix by prefix."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, link(role or "", text or ""), role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + v[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
        ends[tuple(v)].append(c)
    children = Counter(n[:-1] for n in members if n)
    leaves, saved = Counter(), Counter()
    for n, m in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += not children[n]
            saved[n[:d]] += (len(m) - 1) * len(WORD.findall(n[-1][1])) if n else 0
    digest = lambda n: hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n], digest(n)) for n, m in members.items())


def conversations(spark, rows, partitions=3):
    return spark.createDataFrame([(*r, "clash", b"x", 7, 8) for r in rows], "conv_id long, turn long, role string, text string, node string, link binary, depth int, n int").repartition(partitions)


def made_conversations(seed=3):
    rng = random.Random(seed)
    rows = []
    for c in [*range(-45, 90), 1000, 1003, 1021]:
        if c in (40, 60):
            continue  # families without a first conversation
        words = lambda: " ".join(rng.choice("ab") for _ in range(rng.randint(0, 2)))
        rows += [(c, k if rng.random() < 0.9 else None, rng.choice(["user", "user", None]), rng.choice([words(), None, "\t", "é ß"])) for k in range(rng.randint(1, 9))]
    rows += [(1000, k, "user", "same") for k in range(40)] + [(1003, k, "user", "same") for k in range(39)] + [(1021, k, "user", f"word {k % 3}") for k in range(75)]
    rows += [(5, 1, "user", "twice"), (5, 1, "user", "twice"), (7, 2, "a", "b"), (7, 2, "ab", ""), (8, 3, None, "x " * 30_000)]
    rows += [(None, 0, "user", "nobody's"), (None, None, None, None)]
    return rows


def trie_rows(spark, rows):
    return sorted(map(tuple, prefix_trie.trie(conversations(spark, rows)).collect()))


@pytest.mark.parametrize("fan", [16, 2, 3])
def test_trie(spark, monkeypatch, fan):
    """With blocks of 2 and 3, long conversations go through several levels of them."""
    monkeypatch.setattr(prefix_trie, "FAN", fan)
    rows = made_conversations()
    got, want = trie_rows(spark, rows), plain_trie(rows)
    assert got == want and max(w[1] for w in want) > 64


def test_trie_of_nothing(spark):
    assert trie_rows(spark, []) == [] == trie_rows(spark, [(None, 1, "user", "x")])
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4)
    one = trie_rows(spark, [(c, None, None, None)])  # its first turn is another's, which there is not: turnless
    assert one == plain_trie([(c, None, None, None)]) and len(one) == 1


def test_trie_of_one_large_group(spark, monkeypatch):
    """One conversation with most of the turns, and most conversations alike: no task gets either, and lists are hashed in pieces."""
    monkeypatch.setattr(prefix_trie, "PIECE", 100)
    rows = [(100, k, "user", f"t{k % 50}") for k in range(700)] + [(c, k, "user", f"same {k}") for c in range(200, 700) for k in range(2)]
    assert trie_rows(spark, rows) == plain_trie(rows)
    ordered, cuts = prefix_trie._ordered(prefix_trie.turns(conversations(spark, rows)))
    assert ordered.groupBy("range").count().agg({"count": "max"}).first()[0] < 0.6 * len(rows)
    assert cuts.where("conv_id = 100").count() > 1
    lists = [r.n for r in prefix_trie._ordered(prefix_trie.turns(conversations(spark, rows)))[1].groupBy("conv_id").agg({"total": "max"}).selectExpr("`max(total)` AS n").collect()]
    assert max(lists) == 700


def plain_flags(rows):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    out = []
    for i, t, s in rows:
        t = t or ""
        w = WORD.findall(t)
        e = i is not None and i > first[t]
        out.append((i, s or "", {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": e}))
    return out


def plain_audit(rows, labels):
    flags = plain_flags(rows)
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, x in labels if x == 1} - {None}
    out, orders = {}, ["".join(o) for o in itertools.permutations("ABCDE")]
    for part in {s for _, s, _ in flags}:
        here, total = [(i, f) for i, s, f in flags if s == part], Counter()
        for o in orders:
            left = here
            for step, k in enumerate(o, 1):
                gone = [(i, f) for i, f in left if f[k]]
                redundant = sum(f[k] for _, f in here) - len(gone)
                unique = sum(f[k] and sum(f.values()) == 1 for _, f in here)
                left = [(i, f) for i, f in left if not f[k]]
                total[k] += len(gone)
                out[part, o, step] = [len(left), len(gone), redundant, unique, sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for o in orders:
            for step, k in enumerate(o, 1):
                out[part, o, step].append(total[k])
    return {k: tuple(v) for k, v in out.items()}


def audit_tables(spark, rows, labels):
    wide = spark.createDataFrame([(*r, "clash", 1, True, 5) for r in rows], "doc_id long, text string, source string, part string, n int, A boolean, subset int").repartition(3)
    return wide, spark.createDataFrame([(*x, "clash") for x in labels], "doc_id long, quality int, toxic int, source string")


def audited(spark, rows, labels):
    found = filter_audit.audit(*audit_tables(spark, rows, labels)).collect()
    out = {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in found}
    assert len(out) == len(found)
    return out


def test_audit(spark):
    rng = random.Random(5)
    rows = [(i, t, rng.choice(["a", "b", None, ""])) for i, t in docs()]
    text = lambda: " ".join(rng.choice(["The", "an", "on", "#x", "RE", "it", f"w{rng.randint(0, 500)}"]) for _ in range(rng.randint(0, 140)))
    base = [text() for _ in range(30)]
    rows += [(1000 + i, rng.choice(base) if rng.random() < 0.4 else text(), rng.choice("abc")) for i in range(300)] + [(1000, base[0], "c"), (1000, base[0], "c")]
    labels = [(1000 + i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(200)] + [(1001, 1, 0), (1001, 0, 1), (None, 1, 1), (9999, 1, 1), (400, 1, 1)]
    got, want = audited(spark, rows, labels), plain_audit(rows, labels)
    assert got == want and len(want) == 600 * len({s or "" for *_, s in rows})
    assert any(v[2] for v in want.values()) and any(v[3] for v in want.values()) and any(v[5] for v in want.values())


def test_audit_of_nothing(spark):
    assert audited(spark, [], []) == {} and audited(spark, [], [(1, 1, 1)]) == {}
    assert audited(spark, [(1, None, None)], []) == plain_audit([(1, None, None)], [])


def test_audit_of_one_large_group(spark):
    """One text, one id and one source hold most rows; all of them count."""
    rows = [(i, "copy " * 60, "hot") for i in range(2000)] + [(5, "one id " * 30, "hot")] * 800 + [(i, f"text {i} " * 30, "cold") for i in range(3000, 3040)]
    assert audited(spark, rows, [(5, 1, 1), (7, 1, 0)]) == plain_audit(rows, [(5, 1, 1), (7, 1, 0)])


def plain_rules(text, bands=quality_rules.Bands()):
    t = text or ""
    w = WORD.findall(t)
    grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    hit = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
    lines, seen, dup = t.split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    data = t.encode()

    def outside(piece):
        band = [(a, b) for n, a, b in bands.limits if len(piece) >= n]
        size = len(zstandard.ZstdCompressor(level=bands.level).compress(piece))
        return bool(band) and not band[-1][0] * len(piece) <= size <= band[-1][1] * len(piece)

    odd = sum(len(c) for k in range(0, len(data), bands.chunk) for c in [data[k : k + bands.chunk]] if outside(c))
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), dup, len(hit), failed, not failed and not outside(data) and odd <= len(data) / 3


def rule_rows():
    rng = random.Random(9)
    noise = lambda n: "".join(chr(rng.choice(range(33, 127))) for _ in range(n))
    prose = lambda n: " ".join("".join(rng.choice(["the", "an", "er", "ing", "on", "st", "re", "ou"]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    rows = docs() + [(600 + n, prose(n)) for n in (9, 10, 11, 40, 200, 3000, 4100, 9000)]
    rows += [(710, " ".join(noise(7) for _ in range(400))), (711, "say it again and again. " * 300), (712, " ".join(f"{i} again" for i in range(3000))), (713, prose(1200) + " " + " ".join(noise(9) for _ in range(500)))]
    rows += [(614, "a b c d e a b c d e"), (615, "one line\none line\n \n \n\tone line\r\none line\r\n"), (616, "x " * 5000), (617, prose(4500) + "\n" + prose(6) * 2), (618, "\x1c\x85   a" * 5)]
    return rows


def test_rules(spark):
    rows = rule_rows()
    got = quality_rules.judged(frame(spark, rows)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert sorted((repr(r.doc_id), *[r[n] for n in names]) for r in got) == sorted((repr(i), *plain_rules(t)) for i, t in rows)
    kept = {r.doc_id: r.kept for r in got}
    assert kept[640] and not kept[710] and not kept[711] and not kept[616] and {r.doc_id for r in got if not r.kept and not r.base_failed} >= {710, 712, 713}
    whole = quality_rules.accepted(frame(spark, rows))
    assert whole.columns == frame(spark, rows).columns and whole.count() == sum(r.kept for r in got)
    assert quality_rules.judged(frame(spark, [])).count() == 0 == quality_rules.accepted(frame(spark, [])).count()


def test_rules_bands(spark):
    """Repetition that no rule of words sees, and noise in some chunks of a text that is plain otherwise."""
    rng = random.Random(2)
    few = [f"w{k}" for k in range(6)]
    text = " ".join(rng.choice(few) for _ in range(3000))
    rows = [(1, text), (2, text[:90])]
    got = {r.doc_id: r for r in quality_rules.judged(frame(spark, rows), quality_rules.Bands(limits=((100, 0.5, 1.2),))).collect()}
    assert got[1].odd_chunk_bytes == got[1].n_bytes and not got[1].kept
    assert got[2].odd_chunk_bytes == 0
    assert quality_rules.repeated_words([b"a"] * 4) == 0 and quality_rules.repeated_words([b"a"] * 6) == 6
    words = [str(rng.randint(0, 9)).encode() for _ in range(6000)]
    short = quality_rules.repeated_words(words[:3000])
    at = quality_rules.LONG
    quality_rules.LONG = 0
    try:
        assert quality_rules.repeated_words(words[:3000]) == short > 0
    finally:
        quality_rules.LONG = at
