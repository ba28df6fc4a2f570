import base64
import gzip
import hashlib
import json
import os
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from lynceus.llm import bpe, files, token_files, warc
from lynceus.llm.queries import tokenizer_path
from lynceus.llm.sharding import range_bounds
from lynceus.llm.words import WordEncoder
from tests.llm.data import docs, frame

PAGES = [(i, f"http://example.com/{i}", f"<p>{i % 7}</p>" * (i % 5)) for i in range(60)] + [(60, None, None), (61, "http://a\r\nb", ""), (None, "u", "<p>1</p>"), (None, None, "only"), (5, "again", "<p>5</p>" * 0), (62, "é %0A%", "ü" * 70_000), (62, "é %0A%", "ü" * 70_000)]


def pages(spark, rows=PAGES, n=3):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, shard int").repartition(n)


def plain_records(rows, least=0):
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        first[b] = i if first.get(b) is None else first[b] if i is None else min(i, first[b])
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        f = first[b] if len(b) >= least else i
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if f == i else "revisit", None if f == i else f))
    return out


@pytest.mark.parametrize("least", [0, 10])
def test_warc(spark, tmp_path, least):
    root = f"file://{tmp_path}/w"
    got = warc.archive(pages(spark), root, roll_bytes=3_000, rows_per_shard=20, min_bytes=least)
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(map(repr, plain_records(PAGES, least)))
    full = warc.read_warc(spark, root).collect()
    assert {(r.page_id, r.url) for r in full} == {(i, u) for i, u, _ in PAGES}
    assert all(r.payload is not None and hashlib.sha1(r.payload).digest() == base64.b32decode(r.payload_digest) for r in full if r.record_type == "response")
    names = sorted(f for f in os.listdir(tmp_path / "w") if f.endswith(".gz"))
    assert len(names) > 3 and not os.path.exists(tmp_path / "w/_tmp")
    assert gzip.decompress((tmp_path / "w" / names[0]).read_bytes()).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    again = f"file://{tmp_path}/v"
    warc.write_warc(pages(spark, PAGES[::-1], 7), again, roll_bytes=3_000, rows_per_shard=20, min_bytes=least)
    assert [(tmp_path / "w" / n).read_bytes() for n in names] == [(tmp_path / "v" / n).read_bytes() for n in names]


def test_warc_empty(spark):
    assert warc.archive(pages(spark, [])).count() == 0


def test_commit_resumes(tmp_path):
    root = f"file://{tmp_path}/c"
    entries = []
    for k in range(3):
        uri = files.temporary(root)
        with files.create(uri) as f:
            f.write(b"%d" % k)
        entries.append({"tmp": uri, "name": f"f{k}"})
    with files.create(f"{root}/{files.PENDING}") as f:
        f.write(json.dumps({"files": entries}).encode())
    os.rename(entries[0]["tmp"][7:], tmp_path / "c/f0")  # the first was renamed before the driver stopped
    assert len(files.resume(root)["files"]) == 3 and sorted(os.listdir(tmp_path / "c")) == [files.DONE, "f0", "f1", "f2"]
    assert files.resume(root)["files"] == entries


def test_range_bounds(spark):
    rng = random.Random(1)
    keys = [rng.randrange(1000) for _ in range(3000)] + [10**15] * 5 + [7] * 2000
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    b = range_bounds(df, "k", 500)
    assert b == sorted(set(b)) == range_bounds(df.repartition(9), "k", 500)
    sizes = np.bincount(np.searchsorted(b, keys, side="right"))
    assert max(sizes) < 2700 and 5 < len(b) < 30
    assert range_bounds(df.limit(0), "k", 5) == [] and range_bounds(spark.createDataFrame([(None,)], "k long"), "k", 5) == []


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def test_token_files(spark, tmp_path, library):
    root = f"file://{tmp_path}/t"
    got = token_files.encode_to_files(frame(spark), tokenizer_path(), 2, root, sequence=64, batch=4, rows_per_shard=30).collect()
    rows = sorted(docs(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start, want = 0, []
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
    f = token_files.TokenFile(f"{root}/tokens-000000.arrows")
    ids, mask = f[1]
    assert len(ids) == len(mask) == 64 and mask.all()
    assert not any(x.flags.owndata or x.flags.writeable for x in (ids, mask))  # views of the mapped file
    manifest = files.resume(root)
    assert manifest["ids"] == start and sum(s["docs"] for s in manifest["shards"]) == len(rows)
    for s in manifest["shards"]:  # a shard's masks mark its ids and nothing else
        f = token_files.TokenFile(f"{root}/{s['name']}")
        assert sum(int(f[k][1].sum()) for k in range(-(-sum(len(x) for x in f.flat) // 64))) == s["ids"]
    assert token_files.encode_to_files(frame(spark, []), tokenizer_path(), 2).count() == 0


ALPHABET = "aB é́Éß'\n\t\r\x1c\x85  İΣς½12１<|endoftext|>_-!字𝄞"


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoders(name):
    import public_tokenizers

    path = public_tokenizers.path(name)
    lib, words, chunks = Tokenizer.from_file(path), WordEncoder(path), bpe.ChunkEncoder(path)
    rng = random.Random(5)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += [t or "" for _, t in docs()[:60]] + ["it's I'LL ''s 's don't", "<|endoftext|>a<|startoftext|>"]
    for t in texts:
        want = lib.encode(t, add_special_tokens=False).ids
        assert words.ids(t).tolist() == want, t
        ids = chunks.encode(t)
        assert ids.tolist() == want, t
        assert chunks.decode(ids).decode() == lib.decode(want, skip_special_tokens=False), t


def test_joins_are_repaired():
    """Cuts fall inside words, whose pieces have other ids than the word: only repaired joins give the library's."""
    encoder, lib = bpe.ChunkEncoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    rng = random.Random(8)
    odd = 0
    for spacing in ("", " ", "\u00a0"):  # one word of many chunks, words, and words that no plain blank parts
        text = spacing.join("".join(rng.choice("abcdefé𝄞") for _ in range(rng.randint(1, 40))) for _ in range(400))
        data = text.encode()
        at = [0, *bpe.cuts(data), len(data)]
        assert len(at) > 10
        alone = [x for a, b in zip(at, at[1:]) for x in lib.encode(data[a:b].decode(), add_special_tokens=False).ids]
        want = lib.encode(text, add_special_tokens=False).ids
        before = encoder.repaired
        assert encoder.encode(text).tolist() == want and encoder.repaired > before
        odd += alone != want
    assert odd == 3


def test_rules_are_compared(tmp_path):
    """A tokenizer of the same shape with another pattern isn't cut into words."""
    from lynceus.llm.words import drops_blanks

    spec = json.load(open(tokenizer_path(), encoding="utf-8"))
    assert drops_blanks(spec)
    for change in (lambda s: s["pre_tokenizer"]["pretokenizers"][0]["pattern"].update(Regex="[a-z]+"), lambda s: s["normalizer"]["normalizers"][1].update(content="_"), lambda s: s["added_tokens"][0].update(content="two words")):
        other = json.loads(json.dumps(spec))
        change(other)
        assert not drops_blanks(other)


def test_chunks_are_shared():
    encoder, rng = bpe.ChunkEncoder(tokenizer_path()), random.Random(3)
    passage = " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(2000))
    encoder.encode("other words first " + passage)
    before = encoder.encoded
    encoder.encode("and now something else " + passage)
    assert encoder.encoded - before <= 3 < encoder.reused  # only the chunks beside the difference are new


def test_tables_have_a_size(monkeypatch):
    """What a worker keeps is bounded by its bytes, and ids don't depend on what it keeps."""
    import sys

    encoder, lib, rng = bpe.ChunkEncoder(tokenizer_path()).words, Tokenizer.from_file(tokenizer_path()), random.Random(6)
    for _ in range(50):
        encoder.encode(" ".join("".join(rng.choices("abcdefghij", k=9)) for _ in range(10_000)))
    tables = [t for t in vars(encoder).values() if isinstance(t, dict)]
    assert sum(sys.getsizeof(t) + sum(map(sys.getsizeof, [*t, *t.values()])) for t in tables) < 40 << 20
    monkeypatch.setattr(bpe, "PARTS_BYTES", 6000, raising=False)
    monkeypatch.setattr(bpe, "CHUNKS_BYTES", 6000, raising=False)
    chunks, texts = bpe.ChunkEncoder(tokenizer_path()), [t or "" for _, t in docs()]
    for t in texts + texts:
        assert chunks.encode(t).tolist() == lib.encode(t, add_special_tokens=False).ids
    assert chunks.chunks_bytes <= 6000 and chunks.words.parts_bytes <= 6000 and chunks.reused


def test_encode_and_decode(spark, library):
    got = bpe.encode_and_decode(frame(spark), tokenizer_path()).collect()
    want = [(i, e.ids, library.decode(e.ids, skip_special_tokens=False)) for (i, _), e in zip(docs(), library.encode_batch([t or "" for _, t in docs()], add_special_tokens=False))]
    assert sorted(repr((r.doc_id, r.ids, r.decoded)) for r in got) == sorted(map(repr, want))
    assert bpe.encode_and_decode(frame(spark, []), tokenizer_path()).count() == 0
