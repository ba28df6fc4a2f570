"""Building labelled datasets: deduplication, caps, class separation, splits and samples.

Sampling goes by a hash of the URL and a seed, so a draw is the same however the data is partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lynceus.functions import values as V
from lynceus.functions.suffix import SuffixRules
from lynceus.functions.text import bucket, strip
from lynceus.functions.url import loose_key, parse

SPLITS = (("train", 60), ("val", 70), ("cal", 80), ("test", 100))


def draw(key: Column | str, seed: int = 0) -> Column:
    """A random order that depends on nothing but the key and the seed, the same in any engine that has MD5."""
    return F.md5(F.concat_ws("|", F.col(key).cast("string") if isinstance(key, str) else key.cast("string"), F.lit(str(seed))))


def dedupe(df: DataFrame, key: str = "url", label: str = "label", least: int = 4, order: str | None = None) -> DataFrame:
    """One row per key: keys with both labels go, as do those shorter than least; the first by order (a hash by default) stays."""
    clean = df.withColumn(key, strip(F.col(key).cast("string"))).where(F.length(key) >= least)
    one = clean.groupBy(key).agg(F.min(label).alias("_lo"), F.max(label).alias("_hi")).where(F.col("_lo").eqNullSafe(F.col("_hi")))
    first = Window.partitionBy(key).orderBy(F.col(order) if order else F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    return clean.join(one.select(key), key, "left_semi").withColumn("_n", F.row_number().over(first)).where("_n = 1").select(*df.columns)


def split_of(group: Column, salt: str = V.SPLIT_SALT, splits: tuple[tuple[str, int], ...] = SPLITS) -> Column:
    """train, val, cal or test by a hash of the group, so that a group is never in two of them."""
    b, out = bucket(group, salt), F.lit(splits[-1][0])
    for name, below in reversed(splits[:-1]):
        out = F.when(b < below, name).otherwise(out)
    return out


def annotate(df: DataFrame, column: str = "url", rules: SuffixRules | None = None) -> DataFrame:
    """df with host, group (the registrable domain, or the host where it has none) and split; rows without a host go."""
    out = parse(df, column, rules)
    out = out.withColumns({"host": F.col("p.host"), "group": F.coalesce(F.nullif(F.col("p.reg"), F.lit("")), F.col("p.host"))}).drop("p")
    return out.where("host <> ''").withColumn("split", split_of(F.col("group")))


def cap(df: DataFrame, by: str, limit: Column | int, order: Column, most: int | None = None) -> DataFrame:
    """At most limit rows of each value of by, in the given order; the limit may depend on the row, and is most at most.

    Where the limit is one number, Spark keeps that many rows of a value on each task before it shuffles, so a
    value with most of the rows costs no more than others. A limit that depends on the row is preceded by its greatest
    value for that reason.
    """
    if most is not None:
        df = cap(df, by, most, order)
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order)))
    return ranked.where(F.col("_n") <= limit).drop("_n")


def cap_hosts(df: DataFrame, per_host: int | None = None, per_group: int | None = None, seed: int = 0) -> DataFrame:
    """Caps hosts first, and groups among what is left."""
    if per_host:
        df = cap(df, "host", per_host, draw("url", seed))
    return cap(df, "group", per_group, draw("url", seed)) if per_group else df


def cap_platforms(df: DataFrame, platforms: DataFrame, per_host: int = 3, small: int = 3, big: int = 30, seed: int = 0) -> DataFrame:
    """As cap_hosts, with a higher limit for the groups in platforms (group); adds is_platform."""
    known = platforms.select(F.col("group").alias("_g")).distinct()
    df = cap(df, "host", per_host, draw("url", seed)).join(known, F.col("group") == F.col("_g"), "left")
    df = df.withColumn("is_platform", F.col("_g").isNotNull()).drop("_g")
    df = cap(df, "group", max(small, big), draw("url", seed))  # a plain limit first, for the sake of groups with most of the rows
    return cap(df, "group", F.when(F.col("is_platform"), big).otherwise(small), draw("url", seed))


def without_feeds(legit: DataFrame, hosts: DataFrame, groups: DataFrame, urls: DataFrame) -> DataFrame:
    """legit (with is_platform) without what feeds name: of platforms only the URLs, of others hosts and groups.

    Two anti-joins on separate branches; a single one with OR would be a nested loop.
    """
    plain = legit.where(~F.col("is_platform")).join(hosts.select("host").distinct(), "host", "left_anti").join(groups.select("group").distinct(), "group", "left_anti")
    shared = legit.where("is_platform").withColumn("_u", F.substring_index("url", "#", 1)).join(urls.select(F.col("url").alias("_u")).distinct(), "_u", "left_anti").drop("_u")
    return plain.select(*legit.columns).unionByName(shared.select(*legit.columns))


def single_class(a: DataFrame, b: DataFrame, platforms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both without the groups that both have, platforms aside."""
    both = a.select("group").intersect(b.select("group")).join(platforms.select("group"), "group", "left_anti")
    return a.join(both, "group", "left_anti"), b.join(both, "group", "left_anti")


def unseen(df: DataFrame, seen: DataFrame, column: str = "url", other: str = "url") -> DataFrame:
    """df without the addresses that seen has in any spelling."""
    keys = seen.select(loose_key(F.col(other)).alias("_k")).distinct()
    return df.withColumn("_k", loose_key(F.col(column))).join(keys, "_k", "left_anti").drop("_k")


def unseen_groups(df: DataFrame, seen: DataFrame, group: str = "group") -> DataFrame:
    return df.join(seen.select(group).distinct(), group, "left_anti")


def balanced(df: DataFrame, label: str = "label", per_class: int | None = None, key: str = "url", seed: int = 0) -> DataFrame:
    """As many rows of either class: per_class, or as many as the smaller one has."""
    sizes = [r["count"] for r in df.groupBy(label).count().collect()]
    n = min([*sizes, *([per_class] if per_class is not None else [])], default=0)
    return smallest(df, label, n, draw(key, seed))


def smallest(df: DataFrame, by: str, n: int, order: Column) -> DataFrame:
    """The first n rows of each value of by in the given order; a value's rows are thinned before they meet."""
    return cap(df, by, n, order)


def stratified(df: DataFrame, label: str, n: int, key: str = "url", seed: int = 0) -> DataFrame:
    """About n rows with the classes' shares of df, each rounded."""
    sizes = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    total = sum(sizes.values()) or 1
    limit = F.lit(0)
    for value, count in sizes.items():
        limit = F.when(F.col(label).eqNullSafe(F.lit(value)), int(round(n * count / total))).otherwise(limit)
    return cap(df, label, limit, draw(key, seed), max((int(round(n * count / total)) for count in sizes.values()), default=0))


def tiered(ranked: DataFrame, n: int, tiers: tuple[tuple[int, float], ...] = ((10_000, 0.2), (100_000, 0.3), (1_000_000, 0.5)), seed: int = 0) -> DataFrame:
    """n domains of a ranked list (domain, rank), by shares of tiers, each given by its last rank."""
    tier = F.lit(None).cast("int")
    limit = F.lit(0)
    for i, (last, share) in reversed(list(enumerate(tiers))):
        tier = F.when(F.col("rank") <= last, i).otherwise(tier)
        limit = F.when(F.col("_tier") == i, int(round(n * share))).otherwise(limit)
    first = ranked.groupBy("domain").agg(F.min("rank").alias("rank")).withColumn("_tier", tier).where("_tier IS NOT NULL")
    return cap(first, "_tier", limit, draw("domain", seed), max(int(round(n * share)) for _, share in tiers)).drop("_tier")


def sample_rows(df: DataFrame, n: int, key: str = "url", seed: int = 0) -> DataFrame:
    """n rows without replacement: a top-n by hash, which never sorts the whole."""
    return df.orderBy(draw(key, seed)).limit(n)


def resample_rows(df: DataFrame, n: int, key: str = "url", seed: int = 0) -> DataFrame:
    """n rows with replacement among different keys; adds draw_id.

    Rows are numbered within partitions of a hash, whose sizes tell where a drawn number lies, so no task
    numbers them all.
    """
    spark, parts = df.sparkSession, 256
    rows = df.dropDuplicates([key]).withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
    rows = rows.withColumn("_i", F.row_number().over(Window.partitionBy("_part").orderBy(key)))
    sizes = {r["_part"]: r["count"] for r in rows.groupBy("_part").count().collect()}
    starts, total = [], 0
    for k in sorted(sizes):
        starts.append((k, total, sizes[k]))
        total += sizes[k]
    if not total:
        return rows.drop("_part", "_i").withColumn("draw_id", F.lit(0).cast("long"))
    drawn = spark.range(n).select(F.col("id").alias("draw_id"), F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(total)).alias("_x"))
    lookup = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("s"), F.lit(c).alias("c")) for k, s, c in starts]), lambda p: (p["s"] <= F.col("_x")) & (F.col("_x") < p["s"] + p["c"]))[0]
    drawn = drawn.withColumn("_p", lookup).select("draw_id", F.col("_p.k").alias("_part"), (F.col("_x") - F.col("_p.s") + 1).cast("int").alias("_i"))
    return drawn.join(rows, ["_part", "_i"]).drop("_part", "_i")


def domain_ranks(ranked: DataFrame, top: int | None = None) -> DataFrame:
    """(domain, rank) with the best rank of each domain, of the first `top` ranks."""
    rows = ranked.where(F.col("rank") <= top) if top else ranked
    return rows.groupBy("domain").agg(F.min("rank").alias("rank"))


def first_seen(snapshots: DataFrame, key: str = "url", time: str = "ts") -> DataFrame:
    return snapshots.groupBy(key).agg(F.min(time).alias("first_seen"))


def capture_filter(captures: DataFrame, ranking: DataFrame, feeds: DataFrame) -> DataFrame:
    """Crawl captures of pages (status 200, HTML, no robots.txt) on ranked domains (domain) that no feed names."""
    pages = captures.where((F.col("status") == "200") & F.contains(F.lower("mime"), F.lit("html")) & ~F.endswith("url", F.lit("/robots.txt")))
    return pages.join(ranking.select("domain").distinct(), "domain", "left_semi").join(feeds.select("domain").distinct(), "domain", "left_anti")


def platform_counts(urls: DataFrame, n: int, group: str = "group") -> DataFrame:
    """The n groups with the most rows, ties by name."""
    return urls.groupBy(group).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), group).limit(n)


def sample_weights(df: DataFrame, shares: dict[str, float], dataset: str = "dataset") -> DataFrame:
    """df with weight: a dataset's share of the whole, spread over its rows, times all rows."""
    sizes = df.groupBy(dataset).agg(F.count(F.lit(1)).alias("_n"))
    table = df.sparkSession.createDataFrame(list(shares.items()), f"{dataset} string, _share double")
    sizes = sizes.join(F.broadcast(table), dataset)
    total = sizes.agg(F.sum("_n").alias("_all"))
    sizes = sizes.crossJoin(F.broadcast(total))  # one row
    return df.join(F.broadcast(sizes), dataset).withColumn("weight", F.col("_share") / F.col("_n") * F.col("_all")).drop("_share", "_n", "_all")


def usable(df: DataFrame, url: str = "url", least: int = 4, since: str | None = None, date: str = "date", groups: DataFrame | None = None, group: str = "group") -> DataFrame:
    """Rows with a URL of some length, seen on a day or after it, of the given domains; a missing date is no day."""
    out = df.where(F.length(strip(F.col(url))) >= least)
    out = out.where(F.nullif(F.col(date), F.lit("")) >= since) if since else out
    return out.join(groups.select(group).distinct(), group, "left_semi") if groups is not None else out
