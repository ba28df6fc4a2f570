"""Column expressions over text that Spark has no function for."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynceus.functions.values import OTHER_DIGITS

#: What counts as white space: the Unicode property and the four ASCII separators.
SPACE = "[\\s\\x1C-\\x1F]"
ASCII_DIGITS = "0123456789"
ASCII_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGIT = f"[\\p{{Nd}}{OTHER_DIGITS}]"


def settled(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns, added or replaced, through a generator that makes one row of each.

    Joins by them are planned in no time: the optimiser looks for the origin of a join's keys through every
    projection below, which takes seconds where they are made of many others, and stops at a generator.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


def strip(s: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(s, f"(?U)^{SPACE}+|{SPACE}+$", "")


def has_space(s: Column) -> Column:
    return s.rlike(f"(?U){SPACE}")


def is_ascii(s: Column) -> Column:
    return F.octet_length(s) == F.length(s)


def count_of(s: Column, mark: str) -> Column:
    """How often a single character occurs."""
    return F.length(s) - F.length(F.replace(s, F.lit(mark)))


def _members(s: Column, ascii_set: str, pattern: str) -> Column:
    """How many characters are in a class; ASCII texts take the way without a regular expression."""
    fast = F.length(s) - F.length(F.translate(s, ascii_set, ""))
    return F.when(is_ascii(s), fast).otherwise(F.length(s) - F.length(F.regexp_replace(s, pattern, "")))


def n_digits(s: Column) -> Column:
    return _members(s, ASCII_DIGITS, DIGIT)


def n_letters(s: Column) -> Column:
    return _members(s, ASCII_LETTERS, "\\p{L}")


def n_upper(s: Column) -> Column:
    return _members(s, ASCII_LETTERS[26:], "\\p{IsUppercase}")


def n_non_ascii(s: Column) -> Column:
    return F.length(F.regexp_replace(s, "[\\x00-\\x7F]", ""))


def entropy(s: Column) -> Column:
    """Shannon entropy in bits per character; 0 for the empty text."""
    n = F.length(s).cast("double")

    def add(total: Column, ch: Column) -> Column:
        share = (F.length(s) - F.length(F.replace(s, ch))) / n
        return total - share * F.log2(share)

    return F.when(s == "", 0.0).otherwise(F.aggregate(F.array_distinct(F.split(s, "")), F.lit(0.0), add))


def max_run(s: Column, char_class: str) -> Column:
    """The length of the longest run of characters of a class."""
    runs = F.regexp_extract_all(s, F.lit(f"{char_class}+"), F.lit(0))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def switches(s: Column) -> Column:
    """How often neighbouring characters differ in being a digit: each run of digits has two ends, less those of the text."""
    runs = F.size(F.regexp_extract_all(s, F.lit(f"{DIGIT}+"), F.lit(0)))
    ends = s.rlike(f"^{DIGIT}").cast("int") + s.rlike(f"{DIGIT}$").cast("int")
    return F.when(runs == 0, 0).otherwise(2 * runs - ends)


def unquote(s: Column) -> Column:
    """Percent-decoding that leaves plus signs and malformed escapes as they are."""
    safe = F.regexp_replace(F.replace(s, F.lit("+"), F.lit("%2B")), "%(?![0-9a-fA-F]{2})", "%25")
    return F.when(F.contains(s, F.lit("%")), F.url_decode(safe)).otherwise(s)


def tokens(s: Column) -> Column:
    """Runs of lower-case ASCII letters and digits."""
    return F.regexp_extract_all(s, F.lit("[a-z0-9]+"), F.lit(0))


def one_zero(c: Column) -> Column:
    """1.0 where c holds, else 0.0."""
    return F.when(c, 1.0).otherwise(0.0)


def bucket(group: Column, salt: str) -> Column:
    """A bucket from 0 to 99, by the first 32 bits of an MD5 of salt, a bar and the group."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(f"{salt}|"), group)), 1, 8), 16, 10).cast("long") % 100).cast("int")


#: Powers of ten as sums of powers of two, in an order in which each partial sum is at least half and at most twice what is left.
BINARY = {1: (8.0, 2.0), 3: (1024.0, -16.0, -8.0)}


def fixed(v: Column, digits: int) -> Column:
    """A number with one or three digits after the point; a half goes by the binary value, and to the even digit if it is one exactly.

    How far a scaled number is from a half is found without rounding: its parts are powers of two times the number,
    and differences of doubles within a factor of two of each other are exact.
    """
    size, first, *others = F.abs(v), *BINARY[digits]
    low = F.floor(size * float(10**digits))
    over = size * first - (low + F.lit(0.5))
    for part in others:
        over = over + size * part
    n = low + F.when((over > 0) | ((over == 0) & (low % 2 == 1)), 1).otherwise(0)
    return F.concat(F.when(v < 0, "-").otherwise(""), (n.cast("decimal(18,0)") * F.lit(Decimal(1).scaleb(-digits))).cast("string"))
