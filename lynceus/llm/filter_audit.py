"""How filters interact: what each removes, alone and after others, in every order.

Documents become flags, one for each filter that they fail. One CUBE over the flags and the part counts, for
each set of filters, the documents that fail none of the set: the grouping row in which exactly the set's flags are
grouped and all of them are false. Everything else is arithmetic between the counts of a set and of the same set with one filter more, so
orders cost nothing: a pair of sets serves every order that has it at some step.
"""

from __future__ import annotations

from itertools import combinations, permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynceus.llm.common import discard, lookup, table

#: The filters, in the order of their names.
NAMES = "ABCDE"
WORD = "[^\\x20\\x09-\\x0D]+"
COUNTS = ("docs", "good", "toxic")


def text_flags(text: Column) -> dict[str, Column]:
    """The failure conditions that a text decides by itself; text isn't null.

    A: under 50 words. B: different words under 65 in a hundred. C: A-Z over 5 in a hundred code points. D: any of `#$%&*|`.
    """
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 65 * F.size(words).cast("long"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 5 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def flagged(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, part, and a boolean for each of A to E.

    docs needs doc_id, text and source; other columns are ignored. E is true where a row of any part has an equal text and a
    smaller doc_id; equal texts are found by SHA-256, copies meet in the partial aggregate, and no digest's rows
    meet in one task. Null texts equal empty ones, a null source is the empty part, and a row without an id is
    no copy and makes none. Rows that repeat an id and a text are no copies of each other.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text")).select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *[c.alias(k) for k, c in text_flags(F.col("text")).items()])
    rows = table(rows, "audit-flags")
    copies = table(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where("n > 1"), "audit-copies")
    found = lookup(rows, copies, "digest", F.xxhash64("doc_id"))
    out = table(found.select("doc_id", "part", *"ABCD", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("E")), "audit-copied")
    discard(rows, copies)
    return out


def survivors(flags: DataFrame, labels: DataFrame, names: str = NAMES) -> DataFrame:
    """part, subset (a number, bit k for the k-th filter), docs, good, toxic: documents of the part that fail no filter of the subset.

    flags is as `flagged` returns it. labels needs doc_id, quality and toxic: a document is good, or toxic, if any label of its id
    says 1. Every part has every subset, those that nothing survives with zeros.
    """
    label = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(*[F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(o) for c, o in (("quality", "good"), ("toxic", "toxic"))]).where("good + toxic > 0")
    # Rows that repeat an id are added up before they are joined, so a hot id is as many rows as it has parts and flags.
    rows = flags.groupBy("doc_id", "part", *names).agg(F.count(F.lit(1)).alias("docs"))
    rows = rows.join(label, F.col("doc_id") == F.col("_id"), "left")
    marked = [F.sum(F.when(F.col(c) == 1, F.col("docs")).otherwise(0)).alias(c) for c in COUNTS[1:]]
    cells = rows.groupBy("part", *names).agg(F.sum("docs").alias("docs"), *marked)
    cube = cells.cube("part", *names).agg(F.grouping("part").alias("_all"), *[F.grouping(k).alias(f"_g{k}") for k in names], *[F.sum(c).alias(c) for c in COUNTS])
    chosen = F.lit(True)
    for k in names:
        chosen = chosen & ((F.col(f"_g{k}") == 1) | ~F.col(k))
    subset = sum(((1 - F.col(f"_g{k}").cast("int")) * (1 << i) for i, k in enumerate(names)), F.lit(0))
    left = cube.where((F.col("_all") == 0) & chosen).select("part", subset.alias("subset"), *COUNTS)
    every = left.where("subset = 0").select("part", F.explode(F.sequence(F.lit(0), F.lit((1 << len(names)) - 1))).alias("subset"))
    return every.join(left, ["part", "subset"], "left").fillna(0, COUNTS)


def steps(counts: DataFrame, names: str = NAMES) -> DataFrame:
    """For each part, order of filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley.

    counts is as `survivors` returns it. A step is a pair of subsets: the filters before it, and those with its own.
    """
    spark, n = counts.sparkSession, len(names)
    bit = {k: 1 << i for i, k in enumerate(names)}
    subsets = [sum(c) for r in range(n) for c in combinations(bit.values(), r)]
    pairs = [(s, b, s | b, factorial(s.bit_count()) * factorial(n - 1 - s.bit_count())) for s in subsets for b in bit.values() if not s & b]
    pairs = spark.createDataFrame(pairs, "before int, filter int, after int, orders long")
    orders = [("".join(o), k + 1, sum(bit[x] for x in o[:k]), bit[o[k]]) for o in permutations(names) for k in range(n)]
    orders = spark.createDataFrame(orders, "filter_order string, step int, before int, filter int")
    named = lambda name, key: counts.select("part", F.col("subset").alias(key), F.struct(*COUNTS).alias(name))
    # 80 pairs and 600 steps for five filters, whatever the input: these are broadcast.
    pair = named("b", "before").join(F.broadcast(pairs), "before").join(named("a", "after"), ["part", "after"])
    pair = pair.select("part", "before", "filter", "orders", F.col("a.docs").alias("kept"), *[(F.col(f"b.{c}") - F.col(f"a.{c}")).alias(f"lost_{c}") for c in COUNTS])
    alone = pair.groupBy("part", "filter").agg(
        F.sum(F.col("lost_docs") * F.col("orders")).alias("shapley"),
        F.max(F.when(F.col("before") == 0, F.col("lost_docs"))).alias("fails"),
        F.max(F.when(F.col("before") + F.col("filter") == (1 << n) - 1, F.col("lost_docs"))).alias("unique_fails"),
    )
    out = pair.join(alone, ["part", "filter"]).join(F.broadcast(orders), ["before", "filter"])
    lost = [("removed", F.col("lost_docs")), ("redundant", F.col("fails") - F.col("lost_docs")), ("unique_fails", F.col("unique_fails")), ("good_lost", F.col("lost_good")), ("toxic_lost", F.col("lost_toxic")), ("shapley", F.col("shapley"))]
    return out.select("part", "filter_order", "step", "kept", *[c.alias(k) for k, c in lost])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every order and step of the filters A to E over docs, by part (600 rows each); see `flagged`, `survivors` and `steps`.

    Nulls and repeated rows are as those say; columns of docs and labels beside those named are ignored; an empty
    table has no parts and gives no rows.
    """
    flags = flagged(docs)
    counts = table(survivors(flags, labels), "audit-counts")
    discard(flags)
    return steps(counts)
