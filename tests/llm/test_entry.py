"""The registered queries on the smallest tables, and the pipeline against its operators."""

import hashlib
import os
import re

import pytest
import xxhash
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from lynceus.llm import quality
from lynceus.llm.oracle import ORACLE_SQL
from lynceus.llm.queries import QUERIES, tokenizer_path
from tests.llm.data import docs, frame
from tests.llm.test_classifiers import made, plain_quality
from tests.llm.test_text import low, plain_contamination
from tests.test_queries import SF, same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, name):
    same(QUERIES[name](spark, SF), ORACLE_SQL[name])


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and "pipeline" in entry.queries()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        path = f"{spark.conf.get('spark.checkpoint.dir')}/{name.replace(' ', '-')}-{os.getpid()}"
        out.write.parquet(path)
        new = spark.read.parquet(path)
        left.append(new.count())
        if stage is not corpus_pipeline.tokenize:
            assert new.columns == docs.columns and new.select("doc_id").subtract(docs.select("doc_id")).isEmpty()
        last, docs = docs, new
    assert left == sorted(left, reverse=True) and left[-1] == left[-2] and left[-1] > left[0] / 2
    run = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, SF).collect()}
    assert run == {r.doc_id: r.ids_sha256 for r in docs.collect()} and last.count() == len(run)


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", low(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_pipeline(rows, model, items, library):
    """The five stages over (doc_id, text) in plain Python; the classifier is given, its scores are not."""
    left = [(i, t) for i, t in rows if plain_quality(model, t or "") >= quality.THRESHOLD]
    first = {}
    for i, t in left:
        key = re.sub("[\x20\x09-\x0d]+", " ", t or "")
        first[key] = min(first.get(key, i), i)
    left = [(i, t) for i, t in left if first[re.sub("[\x20\x09-\x0d]+", " ", t or "")] == i]
    fps, root = {i: plain_fingerprint(t) for i, t in left}, {i: i for i, _ in left}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 3 and root[b] < root[a]:
                    root[a], changed = root[b], True
    left = [(i, t) for i, t in left if root[i] == i]
    left = [r for r, c in zip(left, plain_contamination(left, items)) if not c[5]]
    return {i: library.encode(t or "", add_special_tokens=False).ids for i, t in left}


def tables(spark, path, rows, labels, items):
    frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_pipeline_by_brute_force(spark, tmp_path):
    good = [t for t, q, _ in made(260, 4) if q]
    rows = [(i, t) for i, (t, _, _) in enumerate(made(260, 4))] + [(1000 + i, t.replace(" ", " \n")) for i, t in enumerate(good[:15])]
    rows += [(1100 + i, t + " tail") for i, t in enumerate(good[20:30])] + [(1200, None), (1201, ""), (1202, " \t"), (1203, good[40] + " " + good[41]), (1204, "the an er " * 5000)]
    labels, items = [(i, q, x) for i, (_, q, x) in enumerate(made(260, 4))], [(1, good[40]), (2, None), (3, "not to be found")]
    tables(spark, f"file://{tmp_path}/a", rows, labels, items)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, f"file://{tmp_path}/a").collect()}
    model = quality.train(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    want = plain_pipeline(rows, model, items, Tokenizer.from_file(tokenizer_path()))
    assert got == {i: (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()) for i, ids in want.items()}
    assert 100 < len(got) < len(rows) - 30


@pytest.mark.parametrize("rows", [docs(), []], ids=["awkward", "empty"])
def test_stages_take_awkward_rows(spark, tmp_path, rows):
    """Null and repeated ids, null texts, columns of clashing names, empty tables: each stage returns whole rows of its input."""
    path = f"file://{tmp_path}/a"
    tables(spark, path, rows, [(i, i % 2, 0) for i in range(30)] if rows else [], [(1, rows[2][1])] if rows else [])
    left = spark.read.parquet(f"{path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        new = spark.createDataFrame(stage(spark, left, path).collect(), left.schema)
        assert new.schema == left.schema and new.exceptAll(left).isEmpty(), k
        left = new
    out = corpus_pipeline.STAGES[-1][1](spark, left, path)
    assert out.count() == left.count() and corpus_pipeline.run(spark, path).count() == left.count()
