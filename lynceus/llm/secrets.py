"""Secret scans over an incremental ledger of contents, in DataFrame operations only.

Every version of every path is addressed by the SHA-256 of its text. The ledger, a Parquet table in the shared
folder, says which blob has been scanned by which rule version and what was found. A scan adds only pairs of
blob and rule version that the ledger doesn't have, reading each blob's text once, and joins the findings
back to all paths that hold the blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lynceus.llm.common import lookup, new_folder, path_exists, table


@dataclass(frozen=True)
class Rule:
    """A finding is a leftmost, non-overlapping match of pattern (Java's syntax) that keep accepts."""

    kind: str
    version: int
    pattern: str
    #: Whether a match (a column) counts; a match that doesn't is dropped after it has used up its characters.
    keep: object
    #: How many of a match's first characters (a column of the match) don't belong to the finding.
    trim: object = None
    #: What every match holds: texts without it are told apart without the pattern.
    holds: str = ""

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


KEYWORD = "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?"
VALUE = "[A-Za-z0-9+/_.=-]"
#: In the order in which kinds are listed.
RULES = (
    Rule("assign", 1, f"{KEYWORD}{VALUE}+", lambda m: F.length(F.regexp_extract(m, f"^{KEYWORD}({VALUE}+)$", 1)) >= 6),
    Rule("access", 1, "AKIA[A-Z0-9]+", lambda m: F.length(m) >= 20),
    Rule("hex", 1, "[0-9a-f]{24,}", lambda m: F.lit(True)),
)
TOKEN = "[A-Za-z0-9_-]"
#: Formats that services publish for their own keys and tokens (fixed values), and private keys in PEM. A text of any content is read
#: in one pass: Java's matcher calls itself for each repeat of a group, so words in capitals are one class in which two blanks in a row
#: are looked for first; and a token starts at the first `eyJ` of a run of its characters, so a run is tried once, from where it starts.
SERVICE_RULES = (
    Rule("private_key", 1, "-----BEGIN (?! )(?![A-Z ]*  )(?:[A-Z ]* )?PRIVATE KEY-----", lambda m: F.lit(True), holds="PRIVATE KEY-----"),
    Rule("web_token", 1, f"(?<!{TOKEN})(?={TOKEN}*?eyJ{TOKEN}{{8}}){TOKEN}++\\.eyJ{TOKEN}{{8,}}+\\.{TOKEN}++", lambda m: F.lit(True), lambda m: F.regexp_instr(m, F.lit(f"eyJ{TOKEN}{{8}}")) - 1, holds=".eyJ"),
    Rule("github", 1, "gh[opsur]_[A-Za-z0-9]{36,}", lambda m: F.lit(True)),
    Rule("slack", 1, "xox[abprs]-[A-Za-z0-9-]{10,}", lambda m: F.lit(True), holds="xox"),
    Rule("google", 1, "AIza[A-Za-z0-9_-]{35}", lambda m: F.lit(True), holds="AIza"),
    Rule("stripe", 1, "[rs]k_(?:live|test)_[A-Za-z0-9]{16,}", lambda m: F.lit(True), holds="k_"),
)
LEDGER = "blob string, rule string, spans array<struct<start:int,end:int>>"


def steps(text: Column, rule: Rule) -> Column:
    """For each match of a rule: gap, the characters since the last one, n, its length, and ok, whether it counts; null without matches.

    SQL has no offsets of matches, but what stands between them, and their lengths, add up to them.
    """
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    trim = rule.trim or (lambda m: F.lit(0))
    each = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, gap: F.struct((gap + trim(m)).alias("gap"), (F.length(m) - trim(m)).alias("n"), rule.keep(m).alias("ok")))
    there = text.rlike(rule.pattern)
    return F.when(F.contains(text, F.lit(rule.holds)) & there if rule.holds else there, each)


def _found(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, rule, spans) for every blob of texts (blob, text, _known) and every rule that isn't known of it.

    Places are running sums over a blob's matches: one row each, so a text with very many costs no more for each.
    """
    wanted = F.array(*[F.struct(F.lit(r.key).alias("rule"), (~F.array_contains("_known", r.key)).alias("new"), F.when(~F.array_contains("_known", r.key), steps(F.col("text"), r)).alias("steps")) for r in rules])
    pairs = texts.select("blob", F.explode(wanted).alias("_w")).where("_w.new").select("blob", "_w.rule", F.posexplode_outer("_w.steps").alias("k", "s"))
    run = Window.partitionBy("blob", "rule").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    ends = pairs.select("blob", "rule", F.col("s.ok").alias("ok"), F.col("s.n").alias("n"), F.sum(F.col("s.gap") + F.col("s.n")).over(run).cast("int").alias("end"))
    span = F.when(F.col("ok"), F.struct((F.col("end") - F.col("n")).alias("start"), "end"))
    return ends.groupBy("blob", "rule").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def _ledger(spark: SparkSession, path: str) -> DataFrame:
    if path_exists(spark, path):
        return spark.read.schema(LEDGER).parquet(path)
    return spark.createDataFrame([], LEDGER)


def scan(versions: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of versions: its id, blob, and a column of spans for each rule, named by its kind.

    versions has id (a path, with its version if it has several) and text; other columns are ignored. ledger
    is the ledger's folder, a new one by default; rows that it lacks are appended to it. Null texts are
    scanned as empty ones, null and repeated ids count as they stand, and an empty table finds nothing.
    Several rules at different versions may share the ledger.
    """
    spark = versions.sparkSession
    ledger = ledger or new_folder(spark, "secret-ledger")
    paths = table(versions.select("id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob"), F.monotonically_increasing_id().alias("_row")), "scan-paths")
    seen = table(_ledger(spark, ledger).where(F.col("rule").isin([r.key for r in rules])).select("blob", "rule").distinct(), "scan-seen")
    blobs = paths.groupBy("blob").agg(F.count(F.lit(1)).alias("n"))
    known = seen.groupBy("blob").agg(F.collect_set("rule").alias("_known"))
    wanted = blobs.join(known, "blob", "left").where(F.coalesce(F.size("_known"), F.lit(0)) < len(rules))
    wanted = table(wanted.select("blob", F.coalesce("_known", F.array().cast("array<string>")).alias("_known")), "scan-wanted")
    # One text for each wanted blob: copies meet in the partial aggregate, and none is scanned twice.
    texts = versions.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
    if seen.isEmpty():  # then everything is wanted, and nothing is known
        once = texts.groupBy("blob", "text").agg(F.array().cast("array<string>").alias("_known"))
    else:
        once = texts.join(wanted.select("blob"), "blob", "left_semi").groupBy("blob", "text").agg(F.lit(1).alias("_one")).join(wanted, "blob")
    fresh = _found(once, rules)
    fresh.write.mode("append").parquet(ledger)
    rows = _ledger(spark, ledger).where(F.col("rule").isin([r.key for r in rules]))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    by_blob = rows.groupBy("blob").agg(*[F.coalesce(F.first(F.when(F.col("rule") == r.key, F.col("spans")), True), empty).alias(r.kind) for r in rules])
    stats = table(blobs.join(by_blob, "blob"), "scan-blobs")
    return lookup(paths, stats, "blob", F.col("_row")).drop("_row")


def joined(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans by start, then kind as listed, joined by commas."""
    every = F.concat(*[_named(k, i) for i, k in enumerate(kinds)])
    return F.array_join(F.transform(F.array_sort(every), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _named(kind: str, order: int) -> Column:
    return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def findings(docs: DataFrame, ledger: str | None = None, more: tuple[Rule, ...] = SERVICE_RULES) -> DataFrame:
    """Per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256 and spans, by the rules in RULES and more.

    The numbers and the digest are those of RULES alone, spans has the findings of all rules. docs needs doc_id and
    text; see scan for nulls, repeated rows, empty tables and the ledger.
    """
    found = scan(docs.select(F.col("doc_id").alias("id"), "text"), ledger, (*RULES, *more))
    kinds, every = tuple(r.kind for r in RULES), tuple(r.kind for r in (*RULES, *more))
    return found.select(F.col("id").alias("doc_id"), *[F.size(k).cast("long").alias(f"n_{k}") for k in kinds], F.sha2(joined(kinds), 256).alias("base_sha256"), joined(every).alias("spans"))
