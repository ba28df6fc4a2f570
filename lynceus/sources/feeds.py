"""Readers of the labelled sources: blocklist feeds, rankings, crawl indexes and dumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lynceus.functions.url import surt


def quoted_csv(spark: SparkSession, path: str, header: bool = True, sep: str = ",", comment: str = "") -> DataFrame:
    """A CSV with doubled quotes and line breaks in quotes; bz2 and gz files are read as they are."""
    reader = spark.read.option("header", header).option("sep", sep).option("multiLine", True).option("escape", '"')
    return (reader.option("comment", comment) if comment else reader).csv(path)


def plain_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated with a header, in which quotes mean nothing."""
    return spark.read.option("header", True).option("sep", "\t").option("quote", "\u0000").csv(path)


def line_feed(spark: SparkSession, path: str) -> DataFrame:
    """(url): one on a line, blanks and comments skipped."""
    lines = spark.read.text(path).select(F.trim("value").alias("url"))
    return lines.where((F.col("url") != "") & ~F.startswith("url", F.lit("#"))).distinct()


def json_domains(spark: SparkSession, path: str, field: str) -> DataFrame:
    """(host) of a JSON array of objects."""
    return spark.read.option("multiLine", True).json(path).select(F.lower(F.col(field)).alias("host")).distinct()


def dump_rows(spark: SparkSession, path: str, pattern: str, fields: dict[str, int]) -> DataFrame:
    """Rows that a pattern finds in an SQL dump, line by line: each field is one of its groups."""
    rows = spark.read.text(path).select(F.explode(F.regexp_extract_all("value", F.lit(pattern), F.lit(0))).alias("row"))
    return rows.select(*[F.regexp_extract("row", pattern, g).alias(name) for name, g in fields.items()])


def ranking(spark: SparkSession, path: str, top: int | None = None) -> DataFrame:
    """(domain, rank) of a rank,domain list, the best rank of each; a top bound reaches the scan's filter."""
    rows = spark.read.schema("rank long, domain string").csv(path).where(F.col("rank").isNotNull())
    rows = rows.where(F.col("rank") <= top) if top else rows
    return rows.groupBy(F.lower("domain").alias("domain")).agg(F.min("rank").alias("rank"))


def newest_snapshot(files: DataFrame, path: str = "path") -> DataFrame:
    """The rows of the file whose name sorts last; files has the path of each row."""
    last = files.agg(F.max(path).alias("_last"))
    return files.join(F.broadcast(last), F.col(path) == F.col("_last")).drop("_last")  # one row


def union_of(frames: list[DataFrame], date: str | None = None) -> DataFrame:
    """Sources with different columns under each other; an empty or missing date becomes the given one."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    if date is None:
        return out
    known = F.nullif(F.col("date"), F.lit("")) if "date" in out.columns else F.lit(None).cast("string")
    return out.withColumn("date", F.coalesce(known, F.lit(date)))


def day_of(text: Column) -> Column:
    """The date that a text begins with, as text; null if it begins with none."""
    return F.nullif(F.regexp_extract(text, "^(\\d{4}-\\d{2}-\\d{2})", 1), F.lit(""))


def crawl_index(spark: SparkSession, path: str) -> DataFrame:
    """(key, file, offset, length) of a crawl's block index."""
    return spark.read.option("sep", "\t").schema("key string, file string, offset long, length long").csv(path)


def captures(lines: DataFrame, column: str = "value") -> DataFrame:
    """(surt, time, url, status, mime) of capture lines: a key, a time and a JSON object."""
    parts = F.split(column, " ", 3)
    j = F.from_json(parts[2], "url string, status string, mime string")
    return lines.select(parts[0].alias("surt"), parts[1].alias("time"), j["url"].alias("url"), j["status"].alias("status"), j["mime"].alias("mime"))


def index_range(index: DataFrame, reg: Column) -> Column:
    """The condition under which an index key belongs to a domain or a host below it: a range, so sorted files are pruned."""
    key = surt(reg)
    return index["key"].between(F.concat(key, F.lit(")")), F.concat(key, F.lit(",~")))


def latest_by_day(rows: DataFrame, key: str = "url", order: str = "ts") -> DataFrame:
    """Pages of an API pulled day by day, with repeats: the first row of each key."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("_r")).select(key, "_r.*")
