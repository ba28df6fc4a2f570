"""Documents with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, n long, digest string, _norm string, start int, bucket int, block int, shard int, wid long, _h long, _id long, term string, fp long, part string, html string"
EXTRA = ("x", 7, "clash", "clash", 1, 2, 3, 4, 5, 6, 7, "t", 8, "p", "h")


def docs():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = [text(rng.randint(1, 120)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[i % 5].replace(" ", " \n\t")) for i in range(20)]  # copies but for white space
    rows += [(200 + i, base[7] + " tail" * (i % 2)) for i in range(6)]
    rows += [(300, None), (301, ""), (302, " \t "), (303, "\x1c\x85 "), (None, base[3]), (None, "only null"), (None, None)]
    rows += [(400, base[2]), (400, base[2]), (401, base[4]), (401, "another text of the same id")]
    rows += [(500, text(20_000)), (501, "x" * 50_000), (502, "É́ İ ΣΑΣ ß <|endoftext|> ½ 12ab don't"), (503, "A\r\nB b a")]
    return rows


def frame(spark, rows=None, partitions=3):
    rows = docs() if rows is None else rows
    return spark.createDataFrame([(i, t, *EXTRA) for i, t in rows], SCHEMA).repartition(partitions)
