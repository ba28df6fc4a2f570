"""Public-suffix rules and the split of hosts by them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A few rules for use without a list: suffixes of common domains, made-up ones of every kind included (fixed values).
SAMPLE = """
com
net
org
info
edu
gov
io
dev
app
de
fr
es
uk
co.uk
org.uk
jp
co.jp
*.ck
!www.ck
*.kawasaki.jp
!city.kawasaki.jp
br
com.br
gov.br
au
com.au
test
// ===BEGIN PRIVATE DOMAINS===
github.io
pages.dev
blogspot.com
*.compute.example
"""

#: A list has about ten thousand rules; beyond this many, the list isn't one.
MAX_RULES = 100_000


@dataclass(frozen=True)
class SuffixRules:
    """Rules by name: kind (normal, exception or wildcard) and whether they are private; a wildcard goes by its parent."""

    rules: dict[tuple[str, str], bool]

    @staticmethod
    def parse(text: str) -> SuffixRules:
        """From the text of a list: comments and blanks are skipped, private rules follow their heading."""
        rules, private = {}, False
        for line in map(str.strip, text.splitlines()):
            if line.startswith("//"):
                private = private or "===BEGIN PRIVATE DOMAINS===" in line
            elif line:
                name = line.split()[0].lower()
                kind = "exception" if name[0] == "!" else "wildcard" if name.startswith("*.") else "normal"
                name = name.removeprefix("!").removeprefix("*.")
                if not name.isascii():
                    name = ".".join(_label(x) for x in name.split("."))
                rules[kind, name] = private
        if len(rules) > MAX_RULES:
            raise ValueError(f"{len(rules)} rules are too many for a suffix list")
        return SuffixRules(rules)

    @staticmethod
    def read(spark: SparkSession, path: str) -> SuffixRules:
        """From a file in any store that Spark reads; its size is checked by the number of rules."""
        lines = spark.read.text(path, wholetext=True).limit(1).collect()
        return SuffixRules.parse(lines[0][0] if lines else "")

    @property
    def depth(self) -> int:
        return 1 + max((name.count(".") + 1 + (kind == "wildcard") for kind, name in self.rules), default=1)

    def frame(self, spark: SparkSession, private: bool = True) -> DataFrame:
        """One row per name: null, or whether the rule of that kind is private."""
        names: dict[str, dict[str, bool]] = {}
        for (kind, name), own in self.rules.items():
            if private or not own:
                names.setdefault(name, {})[kind] = own
        rows = [(n, k.get("normal"), k.get("exception"), k.get("wildcard")) for n, k in names.items()]
        return spark.createDataFrame(rows, "_name string, _normal boolean, _exception boolean, _wildcard boolean")


def _label(label: str) -> str:
    try:
        return label.encode("idna").decode()
    except UnicodeError:
        return "xn--" + label.encode("punycode").decode()


def sample_rules() -> SuffixRules:
    return SuffixRules.parse(SAMPLE)


def split_hosts(df: DataFrame, host: Column, rules: SuffixRules | None = None, private: bool = True) -> DataFrame:
    """df with _sub, _reg, _suffix and _private, all null where host is null.

    The longest candidate with a rule wins, and of its rules exception before normal before wildcard; without
    any the last label is the suffix. Each possible depth is one broadcast look-up of the rules, whose number
    is bounded, so nothing is shuffled. private says whether private rules count.
    """
    rules = rules or sample_rules()
    table = rules.frame(df.sparkSession, private)
    kept = [F.col(f"`{c}`") for c in df.columns]
    step = df.withColumn("_labels", F.split(host, "\\."))
    n = F.size("_labels")
    tail = lambda k: F.when((n >= k), F.array_join(F.slice("_labels", -k, k), "."))
    for k in range(1, rules.depth + 1):
        at = table.select(*[F.col(c).alias(f"{c}{k}") for c in table.columns])
        step = step.withColumn(f"_tail{k}", tail(k)).join(F.broadcast(at), F.col(f"_tail{k}") == F.col(f"_name{k}"), "left").drop(f"_name{k}", f"_tail{k}")
    hits = []
    for k in range(rules.depth, 0, -1):
        kinds = [(F.col(f"_exception{k}"), k - 1), (F.col(f"_normal{k}"), k)]
        if k > 1:  # a wildcard needs a label in front of its parent
            kinds.append((F.when(n >= k, F.col(f"_wildcard{k - 1}")), k))
        hits += [F.when(own.isNotNull(), F.struct(F.lit(size).alias("size"), own.alias("own"))) for own, size in kinds]
    step = step.withColumn("_hit", F.coalesce(*hits, F.struct(F.lit(1).alias("size"), F.lit(False).alias("own"))))
    size = F.col("_hit.size")
    join = lambda start, length: F.when(length > 0, F.array_join(F.slice("_labels", start, length), ".")).otherwise("")
    known, whole = F.col("_labels").isNotNull(), size >= n
    return step.select(
        *kept,
        F.when(known, F.when(whole, "").otherwise(join(F.lit(1), F.greatest(n - size - 1, F.lit(0))))).alias("_sub"),
        F.when(known, F.when(whole, "").otherwise(join(F.greatest(n - size, F.lit(1)), size + 1))).alias("_reg"),
        F.when(known, join(F.greatest(n - size + 1, F.lit(1)), size)).alias("_suffix"),
        F.when(known, F.col("_hit.own")).alias("_private"),
    )
