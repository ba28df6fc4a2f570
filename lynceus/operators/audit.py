"""Reports and checks over inputs, results and look-ups."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lynceus.operators.ranges import neighbour_gaps, quantiles, running
from lynceus.sources.folder import delete, kept

#: So many ranks are broadcast.
FEW = 100_000


def verdict_counts(df: DataFrame, verdict: str = "fraud_verdict") -> DataFrame:
    return df.groupBy(verdict).agg(F.count(F.lit(1)).alias("n"))


def crosstab(df: DataFrame, row: str, column: str, values: list, by_column: bool = False) -> DataFrame:
    """Counts of each row value by the given column values, and their shares of the row, or of the column."""
    counts = df.groupBy(row).agg(*[F.sum(F.when(F.col(column) == v, 1).otherwise(0)).cast("long").alias(f"n_{v}") for v in values])
    total = sum((F.col(f"n_{v}") for v in values), F.lit(0))
    if by_column:
        sums = counts.agg(*[F.sum(f"n_{v}").alias(f"_{v}") for v in values])
        counts = counts.crossJoin(F.broadcast(sums))  # one row
        return counts.select(row, *[f"n_{v}" for v in values], *[F.when(F.col(f"_{v}") > 0, F.col(f"n_{v}") / F.col(f"_{v}")).alias(f"share_{v}") for v in values])
    return counts.withColumns({f"share_{v}": F.when(total > 0, F.col(f"n_{v}") / total) for v in values})


def deciles(df: DataFrame, value: str, by: str) -> DataFrame:
    """Deciles with linear interpolation, for each value of by."""
    return quantiles(df, [by], value, [k / 10 for k in range(11)], "deciles")


def medians_missing(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    """For each value of by: each column's median without missing values, and the share missing (null or NaN)."""
    real = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c))
    out = df.groupBy(by).agg(*[F.avg(real(c).isNull().cast("double")).alias(f"missing_{c}") for c in columns])
    for c in columns:
        median = quantiles(df.select(by, real(c).alias(c)), [by], c, [0.5], "_q").select(F.col(by).alias("_by"), F.col("_q")[0].alias(f"median_{c}"))
        out = out.join(median, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")
    return out


def determinism(df: DataFrame, key: str, results: list[str]) -> DataFrame:
    """(key, rows, variants) of keys whose rows don't all have the same results."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(F.struct(*results)).alias("variants")).where("variants > 1")


def top_reasons(df: DataFrame, n: int = 10, reasons: str = "reasons", verdict: str = "fraud_verdict") -> DataFrame:
    """(verdict, template, n, rank): the most frequent reasons of each verdict, numbers in them replaced by #."""
    each = df.select(verdict, F.explode(reasons).alias("reason"))
    counts = each.groupBy(verdict, F.regexp_replace("reason", "[0-9]+(\\.[0-9]+)?", "#").alias("template")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(verdict).orderBy(F.desc("n"), "template")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def csv_bytes(cell: Column) -> Column:
    """Bytes of a cell in a CSV file: quotes around it and doubled in it where it needs them."""
    cell = F.coalesce(cell.cast("string"), F.lit(""))
    quoted = F.octet_length(cell) + 2 + F.length(cell) - F.length(F.replace(cell, F.lit('"')))
    return F.when(cell.rlike('[,"\\r\\n]'), quoted).otherwise(F.octet_length(cell))


def bytes_by_column(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, bytes) that the columns take in a CSV file, separators aside."""
    sums = df.agg(*[F.coalesce(F.sum(csv_bytes(F.col(f"`{c}`"))), F.lit(0)).alias(c) for c in columns])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("long").alias("bytes")) for c in columns])).alias("x")).select("x.column", "x.bytes")


def multi_line(df: DataFrame, columns: list[str], row_id: str = "_row_id") -> DataFrame:
    """(n, first): rows with a line break in a cell, and the first such row's number."""
    broken = F.exists(F.array(*[F.col(f"`{c}`").cast("string") for c in columns]), lambda c: F.coalesce(c.rlike("[\\r\\n]"), F.lit(False)))
    return df.agg(F.sum(broken.cast("long")).alias("n"), F.min(F.when(broken, F.col(row_id) + 1)).alias("first"))


def chunks(row_id: Column, chunk: int = 20_000, part: int = 1_000) -> dict[str, Column]:
    """The chunk and the part that a row number belongs to."""
    return {"chunk": F.floor(row_id / chunk).cast("long"), "part": F.floor(row_id / part).cast("long")}


def _micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def sessions(df: DataFrame, by: str, time: str, gap_seconds: int = 120) -> DataFrame:
    """df with session: a number that grows where more than the gap lies between neighbours of one value of by."""
    order = Window.partitionBy(by).orderBy(time)
    away = _micros(F.col(time)) - _micros(F.lag(time).over(order)) > gap_seconds * 1_000_000
    return df.withColumn("_new", F.when(away, 1).otherwise(0)).withColumn("session", F.sum("_new").over(order).cast("long")).drop("_new")


def median_gap(df: DataFrame, by: str, time: str) -> DataFrame:
    """The median number of seconds between neighbours, for each value of by."""
    gaps = neighbour_gaps(df.select(by, _micros(F.col(time)).alias("_t")), [by], "_t", "_g")
    return quantiles(gaps, [by], "_g", [0.5], "_q").select(by, (F.col("_q")[0] / 1e6).alias("median_gap"))


def arg_ranges(df: DataFrame, name: str, values: list[str]) -> DataFrame:
    """For each value column its least and greatest value, and the first name (in order) that has it."""
    cells = []
    for v in values:
        key = F.struct(F.col(v), F.col(name))
        high = F.struct((-F.col(v)).alias("v"), F.col(name))
        cells += [F.min(v).alias(f"min_{v}"), F.min(key)[name].alias(f"argmin_{v}"), F.max(v).alias(f"max_{v}"), F.min(high)[name].alias(f"argmax_{v}")]
    return df.agg(*cells)


def nearest(df: DataFrame, value: Column, point: float, n: int, ties: str) -> DataFrame:
    """The n rows nearest to a cut-off."""
    return df.orderBy(F.abs(value - point), ties).limit(n)


def source_ranges(df: DataFrame, label: str = "label", date: str = "date", source: str = "source") -> DataFrame:
    """Rows, first and last date for each label and source; an empty date is none."""
    day = F.nullif(F.col(date), F.lit(""))
    return df.groupBy(label, source).agg(F.count(F.lit(1)).alias("n"), F.min(day).alias("first_date"), F.max(day).alias("last_date"))


def spearman(df: DataFrame, columns: list[str], at_least: float = 0.9) -> DataFrame:
    """(a, b, rho): rank correlations of all pairs of columns beyond a size. Rows with a null or NaN in any column are left out.

    The different values of a column are counted and ranked, not its rows. With the counts come the sums of the ranks that the rows have in earlier columns,
    so a pair's product is a sum over the values of the later one. The column with most values comes last: its ranks never go back to the rows.
    """
    names = [f"_{i}" for i in range(len(columns))]
    rows = df.select(*[F.col(f"`{c}`").cast("double").alias(x) for c, x in zip(columns, names)])
    for x in names:
        rows = rows.where(F.col(x).isNotNull() & ~F.isnan(x)).withColumn(x, F.when(F.col(x) == 0, 0.0).otherwise(F.col(x)))  # 0.0 for -0.0
    total, *different = rows.agg(F.count(F.lit(1)), *[F.approx_count_distinct(x) for x in names]).first()
    order = sorted(range(len(columns)), key=lambda i: different[i])
    products, paths = {}, []
    try:
        for k, i in enumerate(order):
            sums = [F.sum(f"_rank{j}").alias(f"_sum{j}") for j in order[:k]]
            values, path = kept(rows.groupBy(names[i]).agg(F.count(F.lit(1)).alias("n"), *sums), "rank-values")
            paths.append(path)
            rank = F.col("upto") - (F.col("n") - 1) / 2 - (total + 1) / 2  # the mean place of equal values, from the middle
            ranks = running(values, [], names[i]).withColumn("_rank", rank)
            if k + 1 < len(order):
                ranks, path = kept(ranks, "ranks")
                paths.append(path)
                rows, more = _with_ranks(rows, ranks, names[i], f"_rank{i}", total)
                paths += more
            pairs = [F.sum(F.col("_rank") * F.col(f"_sum{j}")).alias(f"_p{j}") for j in order[:k]]
            products[i, i], *found = ranks.agg(F.sum(F.col("n") * F.col("_rank") * F.col("_rank")), *pairs).first()
            products |= {(min(i, j), max(i, j)): p for j, p in zip(order[:k], found)}
    finally:
        delete(df.sparkSession, *paths)
    pairs = []
    for i, a in enumerate(columns):
        for j in range(i + 1, len(columns)):
            if products[i, i] and products[j, j]:  # neither empty nor all equal
                rho = products[i, j] / math.sqrt(products[i, i]) / math.sqrt(products[j, j])
                pairs += [(a, columns[j], rho)] if abs(rho) > at_least else []
    return df.sparkSession.createDataFrame(pairs, "a string, b string, rho double")


def _with_ranks(rows: DataFrame, ranks: DataFrame, key: str, out: str, total: int) -> tuple[DataFrame, list[str]]:
    """rows with the ranks of a column's values, and folders to delete.

    Few values are broadcast. Of more, those with a ten-thousandth of all rows each are 10,000 at most and broadcast, so that no task gets all rows of one; the others' rows are dealt by value.
    """
    if ranks.count() <= FEW:
        return rows.join(F.broadcast(ranks.select(key, F.col("_rank").alias(out))), key), []
    often = F.col("n") * 10_000 >= total
    rows = rows.join(F.broadcast(ranks.where(often).select(key, F.col("_rank").alias("_often"))), key, "left")
    # a row that has its rank goes anywhere: no other value is equal to its own
    rows = rows.withColumn("_deal", F.when(F.col("_often").isNull(), F.xxhash64(key)).otherwise(F.monotonically_increasing_id()))
    others = ranks.where(~often).select(F.col(key).alias("_key"), F.xxhash64(key).alias("_dealt"), F.col("_rank").alias("_other"))
    rows = rows.join(others, (F.col("_deal") == F.col("_dealt")) & (F.col(key) == F.col("_key")), "left")
    rows, path = kept(rows.withColumn(out, F.coalesce("_often", "_other")).drop("_often", "_other", "_deal", "_dealt", "_key"), "ranked")
    return rows, [path]


def lookup_workload(parsed: DataFrame, row_id: str, chunk: int = 20_000, queries: int = 4) -> DataFrame:
    """(chunk, hosts, domains, dns_queries): look-ups that each chunk adds, as keys are looked up once, where first met."""
    rows = parsed.where("p.host <> '' AND p.ip = 0").select(F.floor(F.col(row_id) / chunk).cast("long").alias("chunk"), "p.host", F.when(~F.col("p.private_suffix"), F.col("p.reg")).alias("reg"))
    hosts = rows.groupBy("host").agg(F.min("chunk").alias("chunk")).groupBy("chunk").agg(F.count(F.lit(1)).alias("hosts"))
    domains = rows.where("reg IS NOT NULL").groupBy("reg").agg(F.min("chunk").alias("chunk")).groupBy("chunk").agg(F.count(F.lit(1)).alias("domains"))
    out = hosts.join(domains, "chunk", "full")
    return out.select("chunk", F.coalesce("hosts", F.lit(0)).alias("hosts"), F.coalesce("domains", F.lit(0)).alias("domains"), (F.coalesce("hosts", F.lit(0)) * queries).alias("dns_queries"))


def compare_outputs(before: DataFrame, after: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    """(rows_only_before, rows_only_after, differing) of two tables aligned by row number."""
    a, b = (d.select(row_id, F.struct(*columns).alias(n)) for d, n in ((before, "_a"), (after, "_b")))
    j = a.join(b, row_id, "full")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return j.agg(count(F.col("_b").isNull()).alias("rows_only_before"), count(F.col("_a").isNull()).alias("rows_only_after"), count(F.col("_a").isNotNull() & F.col("_b").isNotNull() & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("differing"))


def lookup_bounds(work: DataFrame, threads: int = 8, dns_seconds: float = 0.15, rdap_seconds: float = 0.6, rate: float = 2.0) -> DataFrame:
    """Least wall-clock seconds of look-ups by threads and by the busiest registry; work is (registry, domains, dns_queries)."""
    return work.agg(
        (F.sum(F.col("dns_queries") * dns_seconds + F.col("domains") * rdap_seconds) / threads).alias("thread_bound"), (F.max("domains") / rate).alias("registry_bound")
    ).withColumn("bound", F.greatest("thread_bound", "registry_bound"))


def registry_workload(parsed: DataFrame, bootstrap: DataFrame, queries: int = 4) -> DataFrame:
    """(base_url, hosts, domains, dns_queries) of the look-ups that each registry's domains need; null is no registry."""
    rows = parsed.where("p.host <> '' AND p.ip = 0").select("p.host", F.when(~F.col("p.private_suffix"), F.col("p.reg")).alias("reg"), F.substring_index("p.host", ".", -1).alias("_tld"))
    rows = rows.join(F.broadcast(bootstrap), F.col("_tld") == F.col("tld"), "left")
    return rows.groupBy("base_url").agg(F.countDistinct("host").alias("hosts"), F.countDistinct("reg").alias("domains")).withColumn("dns_queries", F.col("hosts") * queries)


def reverse_host_order(df: DataFrame, host: str = "host") -> DataFrame:
    """df sorted by the reversed labels of its hosts, so that hosts of one domain are neighbours; a range sort, not one task's."""
    from lynceus.functions.url import surt

    return df.withColumn("surt", surt(F.col(host))).orderBy("surt")


def align_scores(a: DataFrame, b: DataFrame, key: str = "url", score: str = "score") -> DataFrame:
    """a with other, b's score of the same key; keys that b lacks go. b has a key once."""
    return a.join(b.select(key, F.col(score).alias("other")), key)
