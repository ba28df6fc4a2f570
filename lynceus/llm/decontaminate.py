"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

A window is a run of consecutive words of a benchmark item. The corpus is counted for the benchmark's terms;
each window that can occur at all then has its two rarest terms looked up in the positional index, their
posting lists are shifted by the terms' offsets in the window, and where both lists agree the whole window is
compared with the document. The lists alone give proximity matches: both terms at about their distance, or
most of the window's rarest terms that occur at all (NEAR_TERMS), so that a changed word doesn't hide a copy.

Every step is a scan or a join that grows with the corpus. What is broadcast is counted first; beyond the
bound the same join is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lynceus.llm.common import ascii_lower, matched, path_exists, small, table

#: What separates words: ASCII without letters and digits. The same before they are lower-cased.
SEPARATOR = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
CASED_SEPARATOR = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: Rows up to which a side is broadcast: terms and windows have about 100 bytes, document keys 16, with a benchmark row 24.
MAX_TERMS, MAX_WINDOWS, MAX_DOCS, MAX_NEAR = 100_000, 100_000, 500_000, 1_000_000
KEY = ["_id", "_h"]
#: Parts into which a term's postings are dealt for a shuffled join.
SALTS = 32
#: Terms of a window that are looked up for exact matches and for proximity, and how many of the latter stand in place in a near copy.
EXACT_TERMS, NEAR_TERMS, NEAR_LEAST = 2, 4, 3


def words(text: Column) -> Column:
    """The words of a text; splitting at what separates them costs less than extracting them."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATOR, -1), "")


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), CASED_SEPARATOR, -1), "")).cast("long")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id may be null or repeat, so a row is known by its id and a hash of its text."""
    return docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_id"), F.xxhash64("text").alias("_h"))


def benchmark_windows(benchmark: DataFrame, length: int = 10) -> tuple[DataFrame, DataFrame]:
    """The different windows (wid, window, len) and where they are: (wid, item, row, at), row being a hash of an item's row.

    An item with fewer words than length, but not none, is one window. A null item_id is the item "null".
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(length))
    starts = F.sequence(F.lit(1), F.size("w") - n + 1)
    each = F.transform(starts, lambda s: F.array_join(F.slice("w", s, n), " "))
    cut = table(items.select("item", F.xxhash64("item", "w").alias("row"), n.alias("len"), F.posexplode(each).alias("at", "window")).distinct(), "bench-cut")
    windows = table(cut.select("window", "len").distinct().withColumn("wid", F.monotonically_increasing_id()), "bench-windows")
    return windows, table(cut.join(windows, ["window", "len"]).select("wid", "item", "row", "at"), "bench-places")


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """How often each of terms (term) stands in docs; a term that doesn't occur has no row."""
    tokens = docs.select(F.explode(words(F.col("text"))).alias("term"))
    listed = terms.limit(MAX_TERMS + 1).count() <= MAX_TERMS
    if listed:
        return tokens.join(F.broadcast(terms), "term").groupBy("term").agg(F.count(F.lit(1)).alias("cf"))
    return tokens.groupBy("term").agg(F.count(F.lit(1)).alias("cf")).join(terms, "term")


def rarest_terms(windows: DataFrame, counts: DataFrame, k: int = EXACT_TERMS) -> DataFrame:
    """(wid, len, needed, role, term, off): up to k different terms of each window that are in counts, the rarest first.

    needed is the number of roles that an exact match takes; it is null for a window with a term that isn't in
    counts, which can't occur. Such a window, and roles from EXACT_TERMS on, are only there for proximity: if
    the window has more than k words and at least NEAR_LEAST of its terms are looked up.
    """
    spread = windows.select("wid", "len", F.posexplode(F.split("window", " ")).alias("off", "term"))
    known = spread.join(small(counts, MAX_TERMS), "term")
    terms = known.groupBy("wid", "len", "term", "cf").agg(F.min("off").alias("off"), F.count(F.lit(1)).alias("times"))
    ranked = terms.groupBy("wid", "len").agg(F.sum("times").alias("_n"), F.array_sort(F.collect_list(F.struct("cf", "term", "off"))).alias("_t"))
    ranked = ranked.withColumn("_t", F.slice("_t", 1, k)).withColumn("needed", F.when(F.col("_n") == F.col("len"), F.least(F.size("_t"), F.lit(EXACT_TERMS))))
    near = (F.col("len") > k) & (F.size("_t") >= NEAR_LEAST)
    roles = ranked.select("wid", "len", "needed", near.alias("_near"), F.posexplode("_t").alias("role", "_x")).where("_near or role < needed")
    return roles.select("wid", "len", "needed", "role", F.col("_x.term").alias("term"), F.col("_x.off").alias("off"))


def postings(docs: DataFrame, counts: DataFrame, index: str | None = None) -> DataFrame:
    """The positional index of docs for the terms of counts (term, cf): (term, _id, _h, pos), stored in the shared folder.

    index is the folder of an index of these documents that is kept, a new one by default: only the terms that it
    lacks are read from the documents and added to it, so a second benchmark finds most of its postings there.
    """
    spark = docs.sparkSession
    known = lambda: spark.read.schema("term string, cf long").parquet(f"{index}/terms")
    fresh = counts if index is None or not path_exists(spark, f"{index}/terms") else counts.join(known().select("term"), "term", "left_anti")
    tokens = _keyed(docs).select(*KEY, F.posexplode(words(F.col("text"))).alias("pos", "term"))
    if fresh.limit(MAX_TERMS + 1).count() <= MAX_TERMS:
        found = tokens.join(F.broadcast(fresh.select("term")), "term")
    else:
        found = matched(tokens, fresh.select("term", F.col("cf").alias("n")), "term")
    found = found.select("term", *KEY, "pos")
    if index is None:
        return table(found, "postings")
    found.write.mode("append").parquet(f"{index}/postings")
    fresh.select("term", "cf").write.mode("append").parquet(f"{index}/terms")
    return spark.read.schema(found.schema).parquet(f"{index}/postings").join(small(counts.select("term"), MAX_TERMS), "term", "left_semi")


def window_starts(index: DataFrame, rare: DataFrame) -> DataFrame:
    """(wid, len, needed, role, _id, _h, start): the posting lists of each window's terms, shifted by their offsets.

    Where there are too many windows for a broadcast, a term's postings are dealt over salts, each of which has its windows.
    """
    if rare.limit(MAX_WINDOWS + 1).count() <= MAX_WINDOWS:
        lists = index.join(F.broadcast(rare), "term")
    else:
        salted = rare.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        lists = index.withColumn("_salt", F.pmod(F.xxhash64(*KEY, "pos"), F.lit(SALTS)).cast("int")).join(salted, ["term", "_salt"]).drop("_salt")
    return lists.withColumn("start", F.col("pos") - F.col("off")).where("start >= 0").select("wid", "len", "needed", "role", *KEY, "start")


def exact_matches(docs: DataFrame, windows: DataFrame, starts: DataFrame) -> DataFrame:
    """(wid, _id, _h, start, len) of every occurrence of a window.

    The shifted lists are intersected; the places in which all of a window's lists agree are then compared
    with the words that stand there.
    """
    agreed = starts.groupBy("wid", "len", "needed", *KEY, "start").agg(F.countDistinct("role").alias("_roles")).where("_roles = needed")
    places = agreed.groupBy(*KEY).agg(F.collect_set(F.struct("wid", "start", "len")).alias("_places"))
    places = table(places, "match-places")
    wanted = _keyed(docs).join(small(places.select(*KEY), MAX_DOCS), KEY, "left_semi").dropDuplicates(KEY)
    texts = wanted.select(*KEY, words(F.col("text")).alias("_w")).join(places, KEY)
    found = texts.select(*KEY, F.explode(F.transform("_places", lambda p: F.struct(p.wid.alias("wid"), p.start.alias("start"), F.array_join(F.slice("_w", p.start + 1, p.len), " ").alias("window")))).alias("_p"))
    found = found.select(*KEY, "_p.wid", "_p.start", "_p.window")
    return found.join(small(windows, MAX_WINDOWS), ["wid", "window"]).select("wid", *KEY, "start", "len")


def near_rows(index: DataFrame, rare: DataFrame, places: DataFrame, slop: int = 3) -> DataFrame:
    """(row, _id, _h): benchmark rows and documents that may have a proximity match; no others have one.

    A match of any of a row's windows stands on diagonals (place in the document less place in the row) that differ by
    slop at most, with terms from several places of the row. So diagonals go to cells, those near the end of a cell
    to both, and bits count the places in a cell: two of terms that are among a known window's two rarest, or three.
    """
    top = (F.col("role") < 2) & (F.col("needed") > 1)
    chains = rare.join(places.select("wid", "row", "at"), "wid").groupBy("row", "term", (F.col("at") + F.col("off")).alias("place")).agg(F.max(F.coalesce(top, F.lit(False))).alias("top"))
    dealt = index.repartition(*KEY).join(small(table(chains, "bench-chains"), MAX_WINDOWS), "term")
    diagonal, cell = F.col("pos") - F.col("place"), F.expr(f"floor((pos - place) / {slop + 1})")
    cells = F.when(F.floor((diagonal - slop) / (slop + 1)) < cell, F.array(cell, cell - 1)).otherwise(F.array(cell))
    bit = F.expr("shiftleft(1L, cast(place % 64 AS int))")
    marks = dealt.select("row", *KEY, bit.alias("_all"), F.when(F.col("top"), bit).otherwise(F.lit(0).cast("long")).alias("_top"), F.explode(cells).alias("_cell"))
    met = marks.groupBy("row", *KEY, "_cell").agg(F.bit_or("_all").alias("_all"), F.bit_or("_top").alias("_top")).where((F.bit_count("_all") >= NEAR_LEAST) | (F.bit_count("_top") >= 2))
    return met.select("row", *KEY).distinct()


def proximity_matches(index: DataFrame, rare: DataFrame, places: DataFrame, slop: int = 3) -> DataFrame:
    """(wid, _id, _h): documents in which a window's terms stand at their distances, give or take slop.

    Either its two rarest terms, if all its terms are in the corpus, or NEAR_LEAST of its NEAR_TERMS rarest that
    are in the corpus, if it has more words than that. Exact occurrences count too. Windows with only one
    different term have no proximity matches. Only what near_rows leaves is put in order.
    """
    rare = rare.where("needed is null or needed > 1")
    met = table(near_rows(index, rare, places, slop), "near-rows")
    own = rare.join(places.select("wid", "row").distinct(), "wid")
    terms = table(own.select("row", "term").distinct(), "near-terms")
    kept = index.join(small(terms, MAX_WINDOWS), "term").join(small(met, MAX_NEAR), ["row", *KEY], "left_semi")
    starts = kept.join(small(own, MAX_WINDOWS), ["row", "term"]).withColumn("start", F.col("pos") - F.col("off")).where("start >= 0")
    order = Window.partitionBy("wid", *KEY).orderBy("start", "role").rowsBetween(Window.unboundedPreceding, 0)
    placed = [F.coalesce(F.col("start") - F.last(F.when(F.col("role") == r, F.col("start")), True).over(order) <= slop, F.lit(False)) for r in range(NEAR_TERMS)]
    found = starts.select("wid", "needed", *KEY, F.array(*placed).alias("_placed"))
    pair = F.col("needed").isNotNull() & F.col("_placed")[0] & F.col("_placed")[1]
    most = F.size(F.filter("_placed", lambda x: x)) >= NEAR_LEAST
    return found.where(pair | most).select("wid", *KEY).distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, length: int = 10, slop: int = 3, index: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near.

    docs needs doc_id and text, benchmark item_id and text; other columns are ignored. n_hit counts the words
    inside any occurrence of any window, each once; n_items the items that have an occurring window, and
    items_sha256 is the SHA-256 of their ids, sorted as strings and joined by commas. n_near counts windows
    with a proximity match: see proximity_matches; a copy with more words changed than that allows has none. Null and
    empty texts have no words; an empty benchmark contaminates nothing. Rows that repeat get equal results each.
    index is the folder of a kept index of docs: see postings.
    """
    found = _summary(docs, benchmark, length, slop, NEAR_TERMS, index)
    base = _keyed(docs).select("doc_id", *KEY, n_words(F.col("text")).alias("n_words"))
    out = base.join(small(found, MAX_WINDOWS), KEY, "left")
    n_hit, listed = F.coalesce("n_hit", F.lit(0)), F.coalesce("_items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.coalesce("n_near", F.lit(0)).alias("n_near"))


def _summary(docs: DataFrame, benchmark: DataFrame, length: int, slop: int, k: int = EXACT_TERMS, kept: str | None = None) -> DataFrame:
    """(_id, _h, n_hit, _items) of the documents in which anything was found, with n_near if more than the exact terms are looked up."""
    windows, places = benchmark_windows(benchmark, length)
    owners = places.select("wid", "item").distinct()
    terms = table(windows.select(F.explode(F.split("window", " ")).alias("term")).distinct(), "bench-terms")
    counts = table(term_counts(docs, terms), "bench-counts")
    rare = table(rarest_terms(windows, counts, k), "bench-rare")
    index = postings(docs, counts.join(rare.select("term").distinct(), "term", "left_semi"), kept)
    starts = table(window_starts(index, rare.where("role < needed")), "match-starts")
    matches = table(exact_matches(docs, windows, starts), "matches")

    by_start = Window.partitionBy(*KEY).orderBy("start")
    ends = matches.groupBy(*KEY, "start").agg(F.max(F.col("start") + F.col("len")).alias("end"))
    reached = F.coalesce(F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hits = ends.withColumn("_new", F.greatest(F.lit(0), F.col("end") - F.greatest("start", reached))).groupBy(*KEY).agg(F.sum("_new").alias("n_hit"))
    items = matches.select("wid", *KEY).distinct().join(owners, "wid").groupBy(*KEY).agg(F.sort_array(F.collect_set("item")).alias("_items"))
    if k == EXACT_TERMS:
        return table(hits.join(items, KEY, "full"), "match-summary")
    near = proximity_matches(index, rare, places, slop).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_near"))
    return table(hits.join(items, KEY, "full").join(near, KEY, "full"), "match-summary")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, length: int = 10) -> DataFrame:
    """The rows of docs, with all their columns, in which no window of the benchmark occurs.

    Rows that repeat stay or go together; null and empty texts stay, as does everything if the benchmark is empty.
    """
    gone = _summary(docs, benchmark, length, 0).where("n_hit > 0").select(F.col("_id").alias("gone"), F.col("_h").alias("gone_h"))
    whole = docs.select(F.struct("*").alias("row"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("h"))
    return whole.join(small(gone, MAX_DOCS), (F.col("id") == F.col("gone")) & (F.col("h") == F.col("gone_h")), "left_anti").select("row.*")
