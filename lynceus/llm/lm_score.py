"""Stupid-backoff scores of documents under n-gram counts of the whole corpus.

A word's score falls back until its n-gram is known: V(g) = log10 c(g) / c(beginning of g) where g is in the count
table, and log10 alpha + V(g without its first word) elsewhere.

Up to order 3, every word m of a document is a row (x, m, y) with its neighbours, dealt by m. All counts that the row
needs meet there: m, xm, my and xmy occur as often as rows with them do. The row adds the score of y unless that falls
back to the word alone, and, where xm isn't known, the score of m alone. So rows are shuffled once, counted, joined to
their counts within a partition, and summed per document.

A word that is frequent would be a hot key: its rows are dealt by xm, which tells whether xmy is known, and a second time
by my, which has what y falls back to; c(m) is broadcast. Where xm or my is frequent too, its count is broadcast and the
row goes by the other; where both are, by xmy. There is a proven maximum of frequent n-grams.

Beyond order 3, V telescopes: each n-gram of the document, of any order, adds delta(g) = V(g) - V(g without its first
word), which depends on g alone and is log10 alpha for each n-gram that isn't in the table. So the whole job is

1. a count table: exploded n-grams, combined within tasks and then, shuffled by hash, within partitions;
2. deltas of the n-grams in it, by joins of the table with itself;
3. the documents' exploded n-grams joined to the deltas by hash, and a sum per document.

Rows grow with the corpus either way. Each step takes one part of the hashes after the other, and
what a part has shuffled is deleted before the next: all rows are shuffled, but only a part of them is on disk at a
time. The price is that texts are read once for each part.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lynceus.llm.common import ascii_lower, discard, new_folder, table

#: Words that an n-gram has at most, and the backoff factor.
ORDER, ALPHA = 3, 0.4
#: N-grams whose deltas every task gets at most: each is one of so many parts of all occurrences at least. A row has 16 bytes.
MAX_FREQUENT, MIN_FREQUENT = 200_000, 100
#: Up to order 3, an n-gram is frequent from this share of all words on, or from so many times on: no key has more rows in a task.
SHARE, MOST = 4_000, 1 << 21
#: Rows of words that a task has, about.
TASK_ROWS = 1 << 20
#: Rows of one document that a task doesn't add up, at most.
MOST_OF_ONE = 1 << 10
#: Parts of the n-grams' hashes, one on disk at a time.
PARTS = 6
#: Text whose n-grams are made at a time, and whose words are hashed at a time.
BLOCK, PIECE = 4 << 20, 1 << 17
#: Rows of n-grams that a task holds before it combines them.
HELD = 1 << 21
KEY = ["doc_id", "_h"]
#: Deletes what a query has shuffled when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BLANK = re.compile(b"[\\x20\\x09-\\x0D]")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
IN_WORD = np.array([not BLANK.match(bytes([b])) for b in range(256)])
#: What word hashes are made of: a random number for each byte, and an odd ratio.
BYTES, RATIO = np.random.default_rng(2).integers(0, 1 << 64, 256, "u8"), 0x9E6D62D06F6A9A9B


def words(text: Column) -> Column:
    """Runs of anything but ASCII white space, A-Z in lower case."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+", -1), "")


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a text, as `words` has them, and the places where they begin; PIECE bytes of it at a time.

    A word's hash is a sum over its bytes, each a random number times a power of RATIO by its place, then mixed; sums of
    words come as differences of running sums.
    """
    text, start, hashes, places = text.translate(LOWER), 0, [np.zeros(0, "u8")], [np.zeros(0, "i8")]
    while start < len(text):
        blank = BLANK.search(text, start + PIECE)
        end = blank.start() if blank else len(text)
        b = np.frombuffer(text, "u1", end - start, start)
        inside = np.concatenate([[False], IN_WORD[b], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        first, after = edges[::2], edges[1::2]
        up, down = _powers(len(b)) if len(b) > 2 * PIECE else [x[: len(b)] for x in _usual_powers()]
        sums = np.concatenate([np.zeros(1, "u8"), np.cumsum(BYTES[b] * down)])
        hashes.append(_mixed((sums[after] - sums[first]) * up[first]))
        places.append(first + start)
        start = end
    return np.concatenate(hashes), np.concatenate(places)


def _powers(n: int) -> list[np.ndarray]:
    """The first n powers of RATIO and of its inverse, modulo 2^64."""
    return [np.cumprod(np.concatenate([np.ones(1, "u8"), np.full(n - 1, r, "u8")])) for r in (RATIO, pow(RATIO, -1, 1 << 64))]


@lru_cache(maxsize=1)
def _usual_powers() -> list[np.ndarray]:
    return _powers(2 * PIECE)


def _mixed(h: np.ndarray) -> np.ndarray:
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def _longer(begin: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of n-grams from those of their beginnings and of their last words."""
    return _mixed(begin * np.uint64(0x9E3779B97F4A7C15) + word)


def _grams(first: np.ndarray, doc: np.ndarray, order: int, part: int, parts: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For each n, of the n-grams in a part: gram, begin, rest (None for words), and the index of its text; first has the words and doc their texts.

    An n-gram's hash is made of its beginning's and its last word's.
    """
    gram, last = first, None
    for n in range(order):
        if n:
            last, gram = gram, _longer(gram[:-1], first[n:]) if len(doc) > n else gram[:0]
        mine = (gram >> np.uint64(40)) % np.uint64(parts) == part
        at = np.flatnonzero(mine & (doc[n:] == doc[: len(gram)]) if n else mine)
        yield gram[at], None if last is None else last[at], None if last is None else last[at + 1], doc[at]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows, their words' hashes and the index of each word's row, about BLOCK bytes of text at a time."""
    for rows in batches:
        held, size, start = [], 0, 0
        for k, text in enumerate(rows.column("text")):
            held.append((text.as_py() or "").encode())
            size += len(held[-1])
            if size >= BLOCK or k == rows.num_rows - 1:
                hashes, places = word_hashes(b" ".join(held))
                firsts = np.searchsorted(places, np.cumsum([0, *(len(x) + 1 for x in held[:-1])]))
                yield rows.slice(start, k + 1 - start), hashes, np.repeat(np.arange(len(held)), np.diff(firsts, append=len(places)))
                held, size, start = [], 0, k + 1


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view("i8"))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, _h (a hash of the text) and text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_h"), F.col("text").cast("string").alias("text"))


def _sums(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One row per n-gram of held, with the sum of n."""
    rows = pa.concat_batches(held)
    gram = rows.column("gram").to_numpy()
    by = np.argsort(gram)
    ordered = gram[by]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(by)])
    n = np.add.reduceat(rows.column("n").to_numpy()[by], starts) if len(by) else np.zeros(0, "i8")
    return rows.select(["gram", "begin", "rest"]).take(pa.array(by[starts])).append_column("n", pa.array(n))


def _combined(batches: Iterator[pa.RecordBatch], flush: bool) -> Iterator[pa.RecordBatch]:
    """Rows with equal n-grams as one; with flush, only among HELD rows."""
    held, size, most = [], 0, HELD
    for rows in batches:
        held.append(rows)
        size += rows.num_rows
        if size >= most:
            held = [_sums(held)]
            size = held[0].num_rows
            most = HELD + 2 * size
            if flush:
                yield held[0]
                held, size, most = [], 0, HELD
    if held:
        yield _sums(held)


def counts(docs: DataFrame, order: int = ORDER, part: int = 0, parts: int = 1) -> DataFrame:
    """The count table: gram, begin, rest and n of every different n-gram of 1 to order words in docs, or of one part of them.

    begin is the n-gram without its last word and rest the one without its first; both are null for words.
    Rows are combined in Arrow batches, before the shuffle and after it: Spark's aggregate costs several times that.
    """
    schema = pa.schema([(c, pa.int64()) for c in ("gram", "begin", "rest", "n")])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, hashes, docs_of in _blocks(batches):
            for gram, begin, rest, _ in _grams(hashes, docs_of, order, part, parts):
                ends = [pa.nulls(len(gram), pa.int64())] * 2 if begin is None else [_long(begin), _long(rest)]
                yield pa.RecordBatch.from_arrays([_long(gram), *ends, pa.array(np.ones(len(gram), "i8"))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _combined(grams(batches), True)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _combined(batches, False)

    kind = "gram long, begin long, rest long, n long"
    return _keyed(docs).select("text").mapInArrow(run, kind).repartition("gram").mapInArrow(total, kind)


def occurrences(docs: DataFrame, order: int, part: int, parts: int, grams: np.ndarray, values: np.ndarray) -> DataFrame:
    """One row per n-gram of a part in docs: doc_id, _h and gram; those among grams, which ascend, are left out, and each text has a row without gram for them, with the sum v of their values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, hashes, docs_of in _blocks(batches):
            ids = rows.column("doc_id"), rows.column("_h")
            sums = np.zeros(rows.num_rows)
            for gram, _, _, doc in _grams(hashes, docs_of, order, part, parts):
                if len(grams):
                    place = np.minimum(np.searchsorted(grams, gram), len(grams) - 1)
                    there = grams[place] == gram
                    sums += np.bincount(doc[there], values[place[there]], rows.num_rows)
                    gram, doc = gram[~there], doc[~there]
                doc = pa.array(doc)
                yield pa.RecordBatch.from_arrays([*(c.take(doc) for c in ids), _long(gram), pa.nulls(len(gram), pa.float64())], ["doc_id", "_h", "gram", "v"])
            yield pa.RecordBatch.from_arrays([*ids, rows.column("_h"), pa.array(sums)], ["doc_id", "_h", "gram", "v"])

    return _keyed(docs).mapInArrow(run, "doc_id long, _h long, gram long, v double")


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """Queries within leave nothing of what they shuffled."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def _in_parts(spark: SparkSession, name: str, parts: int, make: Callable[[int], DataFrame]) -> DataFrame:
    """The rows of make(0) to make(parts - 1), written one after the other."""
    path = new_folder(spark, name)
    with _cleaned(spark):
        for k in range(parts):
            rows = make(k)
            rows.write.mode("append").parquet(path)
    out = spark.read.schema(rows.schema).parquet(path)
    out._written_at = path
    return out


def _part(column: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(column, F.lit(0))), F.lit(parts))


def deltas(counted: DataFrame, tokens: int, alpha: float = ALPHA, min_count: int = 1, left_out: int = 1, parts: int = 1, keep: bool = False) -> DataFrame:
    """(gram, n, delta) of the n-grams that are known: what each adds to a document's score beyond an unknown one.

    left_out is taken off every count, the number of words too. Whatever is known, its beginning and its rest
    are: they occur as often at least. counted, a written table, is deleted unless it is to be kept.
    """
    spark, floor = counted.sparkSession, math.log10(max(1, tokens - left_out))
    known = counted.where((F.col("n") - left_out) >= F.when(F.col("begin").isNull(), 1).otherwise(min_count))
    known = known.withColumn("c", F.log10((F.col("n") - left_out).cast("double")))
    word = known.where("begin IS NULL").select("gram", "rest", "n", (F.col("c") - floor).alias("v"))

    def direct(k: int) -> DataFrame:
        begins = known.where(_part("gram", parts) == k).select(F.col("gram").alias("begin"), F.col("c").alias("_cb"))
        longer = known.where(F.col("begin").isNotNull() & (_part("begin", parts) == k)).join(begins.hint("shuffle_hash"), "begin")
        longer = longer.select("gram", "rest", "n", (F.col("c") - F.col("_cb")).alias("v"))
        return longer if k else longer.unionByName(word)

    v = _in_parts(spark, "lm-direct", parts, direct)
    if not keep:
        discard(counted)
    out = v.where("rest IS NULL").select("gram", "n", (F.col("v") + floor - math.log10(alpha)).alias("delta"))

    def delta(k: int) -> DataFrame:
        rests = v.where(_part("gram", parts) == k).select(F.col("gram").alias("rest"), F.col("v").alias("_vr"))
        longer = v.where(F.col("rest").isNotNull() & (_part("rest", parts) == k)).join(rests.hint("shuffle_hash"), "rest")
        longer = longer.select("gram", "n", (F.col("v") - F.col("_vr") - math.log10(alpha)).alias("delta"))
        return longer if k else longer.unionByName(out)

    made = _in_parts(spark, "lm-deltas", parts, delta)
    discard(v)
    return made


class Frequent(NamedTuple):
    """Ascending hashes of n-grams of one length, how often each occurs, and whether any begins with some 16 bits."""

    grams: np.ndarray
    n: np.ndarray
    begun: np.ndarray

    @staticmethod
    def of(grams: np.ndarray, n: np.ndarray) -> Frequent:
        by, begun = np.argsort(grams), np.zeros(1 << 16, bool)
        begun[grams >> np.uint64(48)] = True
        return Frequent(grams[by], n[by], begun)

    def places(self, grams: np.ndarray) -> np.ndarray:
        """Where each of grams stands here, or -1."""
        out, maybe = np.full(len(grams), -1), np.flatnonzero(self.begun[grams >> np.uint64(48)])
        if len(maybe):
            place = np.minimum(np.searchsorted(self.grams, grams[maybe]), len(self.grams) - 1)
            out[maybe] = np.where(self.grams[place] == grams[maybe], place, -1)
        return out


class Rule(NamedTuple):
    """How counts make scores; floor is log10 of the number of words."""

    order: int
    alpha: float
    least: int
    left_out: int
    floor: float

    def values(self, x: np.ndarray, y: np.ndarray, xm: np.ndarray, my: np.ndarray, m: np.ndarray, xmy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For words m, whether xmy is known, what y adds unless it falls back to the word alone, and what m adds if it does.

        x and y are whether there are such neighbours, the others are counts.
        """

        def log(n: np.ndarray) -> np.ndarray:
            return np.log10(np.maximum(n - self.left_out, 1))

        down = math.log10(self.alpha)
        known = x & y & (xmy - self.left_out >= self.least) & (self.order > 2)
        fallen = np.where(my - self.left_out >= self.least, log(my) - log(m), down) + down * (x & (self.order > 2))
        after = np.where(y, np.where(known, log(xmy) - log(xm), fallen), 0.0)
        alone = np.where(m - self.left_out >= 1, log(m), down) - self.floor
        return known, after, np.where(x & (xm - self.left_out >= self.least), 0.0, alone)


#: What a row has beside its key: all of a word's n-grams; those with x, those with y; the same where xm or my is frequent; both are; or a sum of a document.
WHOLE, BEFORE, AFTER, BEFORE_KNOWN, AFTER_KNOWN, BOTH_KNOWN, SUMMED = range(7)
ROW = "_d long, a long, b long, c long"


def _neighbours(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words before and after each, 0 where there is none in its text."""
    before, after, same = np.zeros_like(hashes), np.zeros_like(hashes), doc[1:] == doc[:-1]
    before[1:] = np.where(same, hashes[:-1], 0)
    after[:-1] = np.where(same, hashes[1:], 0)
    return before, after


def _much(grams: np.ndarray, least: float) -> Frequent:
    grams, n = np.unique(grams, return_counts=True)
    return Frequent.of(grams[n >= least], n[n >= least])


def _surveyed(docs: DataFrame, share: int) -> DataFrame:
    """doc_id, _h and n (words) of every row of docs, and order, gram and n of n-grams that are frequent among some words in a task.

    An n-gram is left out among words of which it is less than one in 2 share; so all that is left out is, for any
    n-gram, less than that of all words.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("_h", pa.int64()), ("order", pa.int32()), ("gram", pa.int64()), ("n", pa.int64())])

    def frequent(words: np.ndarray, begins: np.ndarray) -> Iterator[pa.RecordBatch]:
        least, at, gram = len(words) / (2 * share), np.arange(len(words)), words
        for n in (1, 2, 3):
            much = _much(gram, least)
            size = len(much.grams)
            yield pa.RecordBatch.from_arrays([*[pa.nulls(size, pa.int64())] * 2, pa.array(np.full(size, n, "i4")), _long(much.grams), pa.array(much.n)], schema=schema)
            there = much.places(gram) >= 0  # a longer one occurs less often than what it begins with
            at, gram = at[there], gram[there]
            more = (at + n < len(words)) & ~begins[np.minimum(at + n, len(words) - 1)]
            at, gram = at[more], gram[more]
            gram = _longer(gram, words[at + n])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for rows, hashes, doc in _blocks(batches):
            n = pa.array(np.bincount(doc, minlength=rows.num_rows))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("_h"), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.int64()), n], schema=schema)
            held.append((hashes, np.diff(doc, prepend=-1) != 0))
            size += len(hashes)
            if size >= HELD:
                yield from frequent(*map(np.concatenate, zip(*held, strict=True)))
                held, size = [], 0
        if size:
            yield from frequent(*map(np.concatenate, zip(*held, strict=True)))

    return _keyed(docs).mapInArrow(run, "doc_id long, _h long, order int, gram long, n long")


def _counted(docs: DataFrame, candidates: list[np.ndarray], least: int) -> list[Frequent]:
    """Those among candidates, n-grams of 1, 2 and 3 words, that occur least times in docs."""
    wanted = [Frequent.of(g, np.zeros(len(g), "i8")) for g in candidates]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(len(x.grams), "i8") for x in wanted]
        for _, hashes, doc in _blocks(batches):
            at, gram = np.arange(len(hashes)), hashes
            for n, (want, total) in enumerate(zip(wanted, sums, strict=True), 1):
                place = want.places(gram)
                there = place >= 0
                total += np.bincount(place[there], minlength=len(total))
                at, gram = at[there], gram[there]
                more = at + n < len(hashes)
                more[more] = doc[at[more] + n] == doc[at[more]]
                at, gram = at[more], gram[more]
                gram = _longer(gram, hashes[at + n])
        for n, (want, total) in enumerate(zip(wanted, sums, strict=True), 1):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(total), n, "i4")), _long(want.grams), pa.array(total)], ["order", "gram", "n"])

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "order int, gram long, n long").where("n > 0")
    return _by_order(found.groupBy("order", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least))


def _by_order(found: DataFrame) -> list[Frequent]:
    rows = found.select("order", "gram", "n").toArrow()
    order, grams, n = (rows.column(c).to_numpy() for c in ("order", "gram", "n"))
    return [Frequent.of(grams[order == k].view("u8"), n[order == k].astype("i8")) for k in (1, 2, 3)]


def _dealt(docs: DataFrame, rule: Rule, frequent: list[Frequent], part: int, parts: int) -> DataFrame:
    """A row or two for each word of docs, of one part of the keys: a is the key, _d a document's key, and the kind of row in three bits."""
    one, two, three = frequent

    def mine(keys: np.ndarray) -> np.ndarray:
        return ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32) == part

    def block(ids: np.ndarray, w: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """The kind of rows, _d, a, b and c."""
        x, y = _neighbours(w, doc) if rule.order > 1 else (np.zeros_like(w), np.zeros_like(w))
        im = one.places(w)
        at = np.flatnonzero((im < 0) & mine(w))
        yield WHOLE, ids[doc[at]], w[at], x[at], y[at]
        at = np.flatnonzero(im >= 0)
        x, m, y, im, doc, d = x[at], w[at], y[at], im[at], doc[at], ids[doc[at]]
        has_x, has_y, xm, my = x != 0, y != 0, _longer(x, m), _longer(m, y)
        ix, iy = np.where(has_x, two.places(xm), -1), np.where(has_y, two.places(my), -1)
        xmy, it = _longer(xm, y), np.full(len(at), -1)
        both = np.flatnonzero((ix >= 0) & (iy >= 0))
        it[both] = three.places(xmy[both])

        def rows(kind: int, where: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            at = np.flatnonzero(where)
            at = at[mine(a[at])]
            return kind, d[at], a[at], b[at].astype("u8"), c[at].astype("u8")

        high = im << 32
        yield rows(BEFORE, has_x & (ix < 0) & (iy < 0), xm, im, y)
        yield rows(AFTER, has_y & (ix < 0) & (iy < 0), ~my, x, im)  # another key than the same two words have as x and m
        yield rows(BEFORE_KNOWN, (ix >= 0) & has_y & (iy < 0), ~my, x, ix | high)
        yield rows(AFTER_KNOWN, (iy >= 0) & has_x & (ix < 0), xm, iy | high, y)
        yield rows(BOTH_KNOWN, (ix >= 0) & (iy >= 0) & (it < 0), xmy, ix | high, iy)
        here = np.flatnonzero(((it >= 0) | ((ix >= 0) & ~has_y) | ~has_x) & mine(m))

        def n(of: Frequent, places: np.ndarray) -> np.ndarray:
            return np.where(places[here] >= 0, of.n[places[here]], 0) if len(of.n) else np.zeros(len(here), "i8")

        _, after, alone = rule.values(has_x[here], has_y[here] & (iy[here] >= 0), n(two, ix), n(two, iy), n(one, im), n(three, it))
        sums = np.bincount(doc[here], after + alone, len(ids))
        at = np.flatnonzero(sums)
        yield SUMMED, ids[at], ids[at], sums[at].view("u8"), np.zeros(len(at), "u8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, hashes, doc in _blocks(batches):
            for kind, d, a, b, c in block(rows.column("_d").to_numpy().view("u8"), hashes, doc):
                if len(d):
                    yield pa.RecordBatch.from_arrays([*map(_long, (d << np.uint64(3) | np.uint64(kind), a, b, c))], ["_d", "a", "b", "c"])

    return docs.mapInArrow(run, ROW)


def _times(*keys: np.ndarray) -> np.ndarray:
    """How often each row's keys occur among all rows."""
    key = keys[0]
    for k in keys[1:]:
        key = _longer(key, k)
    by = np.argsort(key)
    ordered = key[by]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(by)])
    n = np.diff(starts, append=len(by))
    out = np.empty(len(by), "i8")
    out[by] = np.repeat(n, n)
    return out


def _added(rows: list[np.ndarray], rule: Rule, frequent: list[Frequent]) -> tuple[np.ndarray, np.ndarray]:
    """_d of documents and what the rows of a partition add to each; several rows of a document may have one each, if they are few."""
    one, two, _ = frequent
    d, a, b, c = rows
    kind, d, v = d & np.uint64(7), d >> np.uint64(3), np.zeros(len(d))
    v[kind == SUMMED] = b[kind == SUMMED].view("f8")
    at = np.flatnonzero(kind != SUMMED)
    kind, a, b, c = kind[at], a[at], b[at], c[at]
    low, n = np.uint64((1 << 32) - 1), _times(a)

    def among(kinds: tuple[int, ...], *keys: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Times of the keys of rows of some kinds; once where the caller knows it."""
        out, at = np.ones(len(n), "i8"), np.flatnonzero(np.isin(kind, kinds) & where)
        out[at] = _times(*(k[at] for k in keys))
        return out

    with_b = among((WHOLE, AFTER, BEFORE_KNOWN), a, b, where=n > 1)
    with_c = among((WHOLE, BEFORE, AFTER_KNOWN), a, c, where=n > 1)
    with_both = among((WHOLE,), a, b, c, where=(with_b > 1) & (with_c > 1))
    # x and y: whether there are such neighbours; counts of xm, my, m and xmy
    x, y, xm, my, m, xmy = b != 0, c != 0, with_b, with_c, n, with_both

    def put(k: int, has_x: bool | None, has_y: bool | None, counts: Callable[[np.ndarray], tuple[np.ndarray, ...]]) -> None:
        at = np.flatnonzero(kind == k)
        if len(at):
            x[at], y[at] = x[at] if has_x is None else has_x, y[at] if has_y is None else has_y
            xm[at], my[at], m[at], xmy[at] = counts(at)

    # each reads n, with_b and with_c of its own rows before they are replaced
    put(BEFORE, True, None, lambda i: (n[i], 0, one.n[b[i]], with_c[i]))
    put(AFTER, None, True, lambda i: (0, n[i], one.n[c[i]], with_b[i]))
    put(BEFORE_KNOWN, True, True, lambda i: (two.n[c[i] & low], n[i], one.n[c[i] >> np.uint64(32)], with_b[i]))
    put(AFTER_KNOWN, True, True, lambda i: (n[i], two.n[b[i] & low], one.n[b[i] >> np.uint64(32)], with_c[i]))
    put(BOTH_KNOWN, True, True, lambda i: (two.n[b[i] & low], two.n[c[i]], one.n[b[i] >> np.uint64(32)], n[i]))
    known, after, alone = rule.values(x, y, xm, my, m, xmy)
    after[((kind == BEFORE) & ~known) | ((kind == AFTER) & known)] = 0.0  # the other row of the word has it
    alone[kind == AFTER] = 0.0
    v[at] = after + alone
    # sums are left to the shuffle by document, whose rows then grow with the corpus, but no document is a hot key there
    much = np.bincount((d & np.uint64(0xFFFF)).astype("i8"), minlength=1 << 16) >= MOST_OF_ONE
    many = much[d & np.uint64(0xFFFF)]
    few = ~many & (v != 0)
    documents, place = np.unique(d[many], return_inverse=True)
    return np.concatenate([d[few], documents]), np.concatenate([v[few], np.bincount(place, v[many], len(documents))])


def _sums_of_documents(docs: DataFrame, rule: Rule, frequent: list[Frequent], part: int, parts: int, tasks: int) -> DataFrame:
    """_d and v, the sum of what one part of the keys adds to a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x for x in batches if x.num_rows]
        if held:
            d, v = _added([np.concatenate([x.column(c).to_numpy() for x in held]).view("u8") for c in ("_d", "a", "b", "c")], rule, frequent)
            yield pa.RecordBatch.from_arrays([_long(d), pa.array(v)], ["_d", "v"])

    dealt = _dealt(docs, rule, frequent, part, parts).repartition(tasks, "a")
    return dealt.mapInArrow(run, "_d long, v double").repartition(tasks, "_d").groupBy("_d").agg(F.sum("v").alias("v"))


def _document(salt: int) -> Column:
    """A key of 61 bits of doc_id and _h."""
    return F.shiftrightunsigned(F.xxhash64("doc_id", "_h", F.lit(salt)), 3)


def _scores(docs: DataFrame, rule: Rule, parts: int) -> DataFrame:
    """As backoff_scores, for orders up to 3; the rule's floor isn't known yet."""
    spark, share = docs.sparkSession, SHARE
    with _cleaned(spark):
        while True:
            survey = table(_surveyed(docs, share), "lm-survey")
            tokens = survey.where("gram IS NULL").agg(F.sum("n")).first()[0] or 0
            if tokens <= share * MOST:
                break
            discard(survey)
            share = -(-tokens // MOST)
        base = survey.where("gram IS NULL").groupBy(*KEY).agg(F.first("n").alias("n_tokens"), F.count(F.lit(1)).alias("_copies"))
        base = table(base, "lm-documents")
        salt = 0
        while base.groupBy(_document(salt).alias("_d")).count().where("count > 1").limit(1).count():
            salt += 1  # no two documents share a key
        some = survey.where("gram IS NOT NULL").groupBy("order", "gram").agg(F.sum("n").alias("n"))
        candidates = [x.grams for x in _by_order(some.where(F.col("n") >= tokens / (2 * share)))]
        discard(survey)
        frequent = _counted(docs, candidates, max(MIN_FREQUENT, math.ceil(tokens / share)))
    rule = rule._replace(floor=math.log10(max(1, tokens - rule.left_out)))
    keyed = _keyed(docs).select(_document(salt).alias("_d"), "text")
    tasks = max(1, -(-tokens * 3 // (2 * parts * TASK_ROWS)))
    added = _in_parts(spark, "lm-sums", parts, lambda k: _sums_of_documents(keyed, rule, frequent, k, parts, tasks)).groupBy("_d").agg(F.sum("v").alias("v"))
    out = base.withColumn("_k", _document(salt)).join(added, F.col("_k") == F.col("_d"), "left")
    return out.select("doc_id", "n_tokens", (F.coalesce("v", F.lit(0.0)) / F.col("_copies")).alias("log10_score"), "_copies")


def _scores_by_joins(docs: DataFrame, order: int, alpha: float, min_count: int, leave_one_out: bool, parts: int) -> DataFrame:
    """As backoff_scores, for any order: the count table, its deltas, and the documents' n-grams joined to them."""
    base = _documents(docs)
    tokens = base.agg(F.sum(F.col("n_tokens") * F.col("_copies"))).first()[0] or 0
    counted = _in_parts(docs.sparkSession, "lm-counts", parts, lambda k: counts(docs, order, k, parts).where(F.col("n") > int(leave_one_out)))  # no other n-gram can be known
    known = deltas(counted, tokens, alpha, min_count, int(leave_one_out), -(-parts // 3))  # far fewer rows than n-grams occur
    return _joined(docs, base, known, order, max(1, tokens - int(leave_one_out)), alpha, parts)


def _documents(docs: DataFrame) -> DataFrame:
    """doc_id, _h, n_tokens and _copies of each different row, written."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_h"), F.size(words(F.col("text"))).alias("n_tokens"))
    return table(base.groupBy(*KEY, "n_tokens").agg(F.count(F.lit(1)).alias("_copies")), "lm-documents")


def _joined(docs: DataFrame, base: DataFrame, known: DataFrame, order: int, total: int, alpha: float, parts: int) -> DataFrame:
    """Scores of docs by the deltas of known n-grams, of a corpus of so many words."""
    per = sum((F.greatest(F.col("n_tokens") - k, F.lit(0)) for k in range(order)), F.lit(0))
    grams = base.agg(F.sum(per * F.col("_copies"))).first()[0] or 0
    # An n-gram of which the scored documents have many is one of the corpus's frequent ones, or is seldom there and has few rows here.
    counted = known.agg(F.sum("n")).first()[0] or 0
    frequent = F.col("n") >= max(MIN_FREQUENT, math.ceil(max(grams, counted) / MAX_FREQUENT))
    few = known.where(frequent).select("gram", "delta").toArrow()
    seldom = known.where(~frequent).select(F.col("gram").alias("_g"), "delta")
    often, values = few.column("gram").to_numpy().view("u8"), few.column("delta").to_numpy()
    by_gram = np.argsort(often)
    often, values = often[by_gram], values[by_gram]

    def sums(k: int) -> DataFrame:
        mine = (often >> np.uint64(40)) % np.uint64(parts) == k
        rows = occurrences(docs, order, k, parts, often[mine], values[mine])
        part = seldom.where(F.pmod(F.shiftrightunsigned("_g", 40), F.lit(parts)) == k)
        joined = rows.join(part.hint("shuffle_hash"), (F.col("gram") == F.col("_g")) & F.col("v").isNull(), "left")
        joined = joined.where(F.coalesce("v", "delta").isNotNull())  # what isn't known adds nothing
        return joined.groupBy(*KEY).agg(F.sum(F.coalesce("v", "delta")).alias("v"))

    added = _in_parts(docs.sparkSession, "lm-sums", parts, sums).groupBy(*KEY).agg(F.sum("v").alias("v"))
    out = base.select(F.col("doc_id").alias("_id"), F.col("_h").alias("_t"), "n_tokens", "_copies", per.alias("_n"))
    out = out.join(added, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_t") == F.col("_h")), "left")
    floor = F.col("_n") * math.log10(alpha) - F.col("n_tokens") * math.log10(total)
    score = F.coalesce(F.col("v"), F.lit(0.0)) / F.col("_copies") + floor
    return out.select(F.col("_id").alias("doc_id"), F.col("n_tokens").cast("long").alias("n_tokens"), score.alias("log10_score"), "_copies")


class CountTables(NamedTuple):
    """Count tables that are kept: a folder of (part, gram, begin, rest, n), the n-grams' order, and the number of words counted."""

    path: str
    order: int
    tokens: int
    parts: int

    def counts(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/counts")


def write_counts(docs: DataFrame, path: str, order: int = ORDER, parts: int = PARTS) -> CountTables:
    """Counts of all n-grams of docs up to an order, written under path, a folder for each part of their hashes.

    docs needs text; null and empty texts have no words, rows that repeat are counted each, and an empty table has no
    counts. The number of words is written last: tables without it are not whole.
    """
    spark = docs.sparkSession
    with _cleaned(spark):
        for k in range(parts):
            counts(docs.select(F.lit(None).cast("long").alias("doc_id"), "text"), order, k, parts).withColumn("part", F.lit(k)).write.mode("append").partitionBy("part").parquet(f"{path}/counts")
    known = spark.read.schema("gram long, begin long, rest long, n long, part int").parquet(f"{path}/counts")
    tokens = known.where("begin IS NULL").agg(F.sum("n")).first()[0] or 0
    spark.createDataFrame([(order, tokens, parts)], "order int, tokens long, parts int").write.parquet(f"{path}/size")
    return CountTables(path, order, tokens, parts)


def read_counts(spark: SparkSession, path: str) -> CountTables:
    """Tables that write_counts has written."""
    size = spark.read.parquet(f"{path}/size").first()
    return CountTables(path, size.order, size.tokens, size.parts)


def score(docs: DataFrame, tables: CountTables, alpha: float = ALPHA, min_count: int = 1) -> DataFrame:
    """As backoff_scores, by the counts of other texts: docs are exploded into n-grams, joined to the tables by hash, and summed per document.

    A word that the tables lack scores alpha / number of words counted. An n-gram of which docs have very many rows without its being frequent in the
    tables meets them in one task's join; docs are cut into parts of hashes as the tables are.
    """
    spark = docs.sparkSession
    counted = spark.read.schema("gram long, begin long, rest long, n long, part int").parquet(f"{tables.path}/counts").drop("part")
    known = deltas(counted, tables.tokens, alpha, min_count, 0, -(-tables.parts // 3), keep=True)
    out = _joined(docs, _documents(docs), known, tables.order, max(1, tables.tokens), alpha, tables.parts)
    return out.select("doc_id", "n_tokens", "log10_score", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("col")


def backoff_scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, min_count: int = 1, leave_one_out: bool = True, parts: int = PARTS) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens and log10_score, the sum of its words' log10 scores.

    A word's score after the words before it, up to order - 1 of them in its text, is c(n-gram) / c(its
    beginning) if the n-gram's count is min_count at least, and else alpha times the score after one word less;
    for the word alone c(word) / number of words, and alpha / number of words if it has no count. Counts are
    over all of docs. With leave_one_out (the deleted estimate) the occurrence that is scored is taken off every count:
    otherwise no n-gram of a scored corpus is ever unknown, and a text that nothing else resembles scores like
    one that the corpus repeats. N-grams are told apart by 64-bit hashes; two share one with a
    chance of about n^2 / 2^65. More parts take less disk and read docs more often; the result is the same.

    docs needs doc_id and text; other columns are ignored. Null and empty texts have no words and score 0. Rows
    that repeat are counted and scored each; null ids stay null; an empty table gives an empty result.
    """
    if order <= 3:
        out = _scores(docs, Rule(order, alpha, min_count, int(leave_one_out), 0.0), parts)
    else:
        out = _scores_by_joins(docs, order, alpha, min_count, leave_one_out, parts)
    return out.select("doc_id", "n_tokens", "log10_score", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("col")
