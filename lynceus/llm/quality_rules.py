"""Quality rules by counts and by compression bands.

A text is measured once: its words, lines, symbols and repeated windows, and how far zstandard compresses it, whole
and in chunks of a fixed size. Short text compresses less than long text, so each length has its own band: below it
a text says the same thing over and over, above it there is no language in it. The whole text must lie in the band of
its length, and the chunks that lie outside the bands of theirs must not hold more than a share of the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of `[#*$%&|<>]`, and those that part words (fixed values).
SYMBOLS, BLANKS = b"#*$%&|<>", b"\x20\x09\x0a\x0b\x0c\x0d"
#: Words of a repeated window; the least number of words of a text; repeated words in a hundred, at most.
WINDOW, LEAST_WORDS, REPEATED = 5, 10, 20
#: From this many words on, windows are compared by ranks in arrays instead of by tuples, which take more memory.
LONG = 4000


@dataclass(frozen=True)
class Bands:
    """Limits of compressed bytes by byte: (from this many bytes on, least, greatest), shortest first.

    Texts and chunks shorter than the first have no band and pass. Frames and tables make up much of what a short text is compressed
    to, so its band is wide; plain language in UTF-8 lies between 0.3 and 0.7 from about 1,000 bytes on.
    """

    limits: tuple[tuple[int, float, float], ...] = ((100, 0.25, 1.20), (200, 0.25, 0.95), (500, 0.22, 0.84), (1000, 0.20, 0.74), (4000, 0.15, 0.68))
    chunk: int = 4096
    #: Bytes in chunks out of their bands, at most, as a share of all.
    share: float = 1 / 3
    level: int = 3

    def outside(self, size: int, compressed: int) -> bool:
        """Whether so many bytes, compressed to so many, lie outside the band of their length."""
        least, greatest = next(((a, b) for n, a, b in reversed(self.limits) if size >= n), (0.0, np.inf))
        return not least * size <= compressed <= greatest * size


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_bytes long, compressed_bytes long, odd_chunk_bytes long, base_failed boolean, kept boolean"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words stand in windows of so many that occur twice or more, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    if len(words) < LONG:
        grams = list(zip(*(words[k : k + n] for k in range(window)), strict=True))
        if len(set(grams)) == n:
            return 0
        places: dict = {}
        ids = np.fromiter((places.setdefault(g, len(places)) for g in grams), "int64", n)
    else:
        numbers: dict = {}
        each = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), "int64", len(words))
        ids = each[:n]
        for k in range(1, window):  # the rank of the first k + 1 words, from that of k and the next word
            ids = np.unique(ids * len(numbers) + each[k : k + n], return_inverse=True)[1]
    often = np.bincount(ids)[ids] > 1
    edges = np.zeros(len(words) + 1, "int64")
    np.add.at(edges, np.flatnonzero(often), 1)
    np.add.at(edges, np.flatnonzero(often) + window, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def repeated_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in data.split(b"\n") if x.strip(BLANKS)]
    return len(lines) - len(set(lines))


def measure(text: str | None, compressor, bands: Bands) -> tuple:
    """The columns of MEASURES for one text; null counts as empty, which has no words, no band and fails the base rules."""
    data = (text or "").encode()
    words = data.split()  # of bytes: exactly at the characters of BLANKS
    n_repeat = repeated_words(words)
    n_symbols = len(data) - len(data.translate(None, SYMBOLS))
    word_chars = len(text or "") - (len(data) - len(data.translate(None, BLANKS)))
    chunks = [data[k : k + bands.chunk] for k in range(0, len(data), bands.chunk)]
    whole = len(compressor.compress(data)) if data else 0
    odd = sum(len(c) for c in chunks if bands.outside(len(c), whole if len(chunks) == 1 else len(compressor.compress(c))))
    failed = len(words) < LEAST_WORDS or 100 * n_repeat > REPEATED * len(words)
    kept = not failed and not bands.outside(len(data), whole) and odd <= bands.share * len(data)
    return len(words), word_chars, n_symbols, repeated_lines(data), n_repeat, len(data), whole, odd, failed, kept


def measured(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """docs with a column `measures`, a struct of MEASURES; docs needs text, whole texts are measured.

    A null text counts as an empty one; rows that repeat are measured alike; an empty table gives an empty
    result; texts of any length are measured whole, one at a time. A column `measures` of docs is replaced.
    """

    @F.pandas_udf(MEASURES)
    def rules(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import zstandard

        names = [c.split()[0] for c in MEASURES.split(", ")]
        compressor = zstandard.ZstdCompressor(level=bands.level)
        for texts in batches:
            yield pd.DataFrame([measure(t, compressor, bands) for t in texts], columns=names)

    return docs.drop("measures").withColumn("measures", rules(F.col("text")))


def judged(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """One row per row of docs: doc_id and the columns of MEASURES; other columns of docs are ignored, whatever their names."""
    return measured(docs.select("doc_id", "text"), bands).select("doc_id", "measures.*")


def accepted(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The rows of docs, with all their columns, that neither the base rules nor the bands reject."""
    whole = docs.select(F.struct("*").alias("row"), "text")  # columns of docs may have any name
    return measured(whole, bands).where("measures.kept").select("row.*")
