"""Exact deduplication that no group of copies can skew.

Copies are combined in three stages: first within each task (the partial aggregate), then within (digest, salt)
groups, then the winners of a digest's salts. Where rows are merged, the whole normalised text is part of the
key. Only digests with a large share of all rows get more than one salt, and there is a proven maximum of those;
the others have met all their copies after the second stage, so nothing is left to compare in the third. A digest alone
never decides: where two texts share one, their rows are told apart by the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynceus.llm.common import hot_keys, lookup, table

#: Tasks among which the rows of one hot digest are dealt.
SALTS = 64


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null becomes the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def duplicate_groups(docs: DataFrame, digest=sha256, salts: int = SALTS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, digest.

    docs needs doc_id and text; other columns are ignored, whatever their names. keep_id is the smallest
    doc_id of the rows with an equal normalised text and group_size the number of those rows. kept says that
    doc_id is keep_id: rows that repeat a doc_id and its text are all marked kept, as is every row of a
    group that has only null ids. Null texts equal empty ones; an empty table gives an empty result.
    digest maps the normalised text to a string; it may collide.
    """
    rows = docs.select("doc_id", normalised(F.col("text")).alias("_norm"))
    rows = rows.withColumn("digest", digest(F.col("_norm")))
    keys = table(rows.select("doc_id", "digest"), "dedup-keys")
    counts = keys.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    hot = hot_keys(counts, "digest").select(F.col("digest").alias("_hot"))
    salt = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.lit(salts))).otherwise(F.lit(-1))
    local = rows.join(F.broadcast(hot), F.col("digest") == F.col("_hot"), "left").withColumn("_salt", salt)
    salted = local.groupBy("digest", "_salt", "_norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # A digest without salts has met all its copies; its winners pass by their own number and leave the text behind.
    cold = F.col("_salt") == -1
    final = (
        salted.withColumn("_text", F.when(~cold, F.col("_norm")))
        .withColumn("_own", F.when(cold, F.xxhash64("_norm", "keep_id")))
        .withColumn("_size", F.when(cold, F.length("_norm")))
        .groupBy("digest", "_text", "_own", "_size")
        .agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    )
    winners = table(final.select("digest", "keep_id", "group_size"), "dedup-winners")
    classes = winners.groupBy("digest").agg(F.sum("group_size").alias("n"), F.count(F.lit(1)).alias("_texts"), F.min("keep_id").alias("keep_id"), F.min("group_size").alias("group_size"))
    classes = table(classes, "dedup-classes")
    clash = classes.where("_texts > 1").select(F.col("digest").alias("_clash"))
    result = lookup(keys, classes, "digest", F.xxhash64("doc_id"))
    if not clash.isEmpty():
        # The digest has met two texts: those rows are decided by the text itself.
        texts = rows.join(clash, F.col("digest") == F.col("_clash"), "left_semi")
        own = texts.groupBy("digest", "_norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        apart = texts.join(own, ["digest", "_norm"]).select("doc_id", "digest", "keep_id", "group_size")
        result = result.where("_texts = 1").select("doc_id", "digest", "keep_id", "group_size").unionByName(apart)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return result.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest")


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns: one row for each different normalised text.

    Of repeated rows with one doc_id and text, one stays.
    """
    groups = table(duplicate_groups(docs).select("doc_id", "kept", "digest"), "dedup-groups")
    odd = groups.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL")
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"))  # columns of docs may have any name
    if odd.isEmpty():  # ids tell rows apart
        gone = groups.where(~F.col("kept")).select(F.col("doc_id").alias("gone"))
        return whole.join(gone.hint("shuffle_hash"), F.col("id") == F.col("gone"), "left_anti").select("row.*")
    stay = groups.where("kept").select(F.col("doc_id").alias("kept_id"), F.col("digest").alias("kept_digest")).distinct()
    rows = whole.withColumn("digest", sha256(normalised(F.col("row.text"))))
    rows = rows.join(stay, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("digest") == F.col("kept_digest")), "left_semi")
    return rows.dropDuplicates(["id", "digest"]).select("row.*")
