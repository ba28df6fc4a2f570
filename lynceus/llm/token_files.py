"""Token ids in Arrow stream files: equal-length sequences with masks, readable without copying.

All ids of a shard's documents, each document ended by the end id, are laid end to end and cut into
sequences of one length; only the last sequence of a shard is padded, and the mask says so. A file holds
record batches of fixed-size lists, of the same number of sequences each (the last may hold fewer), so
sequence k of a memory-mapped file is found by division alone. Masks are fixed-size lists of bytes too, by
dictionary: a file holds the mask of full sequences once. An index file beside it names the documents.
Shards are exact ranges of doc_id, files get their names in one commit, and the manifest holds the number
of ids before each shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lynceus.llm import files
from lynceus.llm.common import new_folder, table
from lynceus.llm.sharding import range_bounds, shard_column
from lynceus.llm.words import word_encoder

SEQUENCE, BATCH = 2048, 64
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
MANIFEST = "tmp string, index_tmp string, shard int, ids long, docs long, dtype string"


def sequence_schema(dtype: str, sequence: int) -> pa.Schema:
    return pa.schema([("input_ids", pa.list_(pa.from_numpy_dtype(np.dtype(dtype)), sequence)), ("mask", pa.dictionary(pa.int32(), pa.list_(pa.uint8(), sequence)))])


class TokenWriter:
    """One shard's two files; holds at most one batch of sequences and one of index rows."""

    def __init__(self, root: str, shard: int, dtype: str, sequence: int, batch: int):
        self.row = {"tmp": files.temporary(root), "index_tmp": files.temporary(root), "shard": shard, "ids": 0, "docs": 0, "dtype": dtype}
        self.dtype, self.sequence, self.size = np.dtype(dtype), sequence, sequence * batch
        self.schema = sequence_schema(dtype, sequence)
        self.outs = [files.create(self.row["tmp"]), files.create(self.row["index_tmp"])]
        self.ids, self.index = pa.ipc.new_stream(self.outs[0], self.schema), pa.ipc.new_stream(self.outs[1], INDEX)
        self.held, self.parts, self.docs = 0, [], ([], [], [])

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        for column, value in zip(self.docs, (doc_id, self.row["ids"], len(ids)), strict=True):
            column.append(value)
        self.row["ids"] += len(ids)
        self.row["docs"] += 1
        self.parts.append(ids)
        self.held += len(ids)
        if self.held >= self.size:
            flat = np.concatenate(self.parts)
            for k in range(0, len(flat) - self.size + 1, self.size):
                self._batch(flat[k : k + self.size], self.size)
            rest = flat[len(flat) // self.size * self.size :]
            self.parts, self.held = [rest.copy()], len(rest)
        if len(self.docs[0]) >= 10_000:
            self._index()

    def _batch(self, flat: np.ndarray, n: int) -> None:
        """Writes sequences of which the first n ids are real. All but the last have the same mask, which a file holds once."""
        masks = np.ones((1, self.sequence), "uint8")
        which = np.zeros(len(flat) // self.sequence, "int32")
        if n < len(flat):
            masks = np.concatenate([masks, (np.arange(self.sequence)[None] < n % self.sequence).astype("uint8")])
            which[-1] = 1
        ids = pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(flat)), self.sequence)
        mask = pa.DictionaryArray.from_arrays(which, pa.FixedSizeListArray.from_arrays(pa.array(masks.ravel()), self.sequence))
        self.ids.write_batch(pa.RecordBatch.from_arrays([ids, mask], schema=self.schema))

    def _index(self) -> None:
        self.index.write_batch(pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in self.docs], schema=INDEX))
        self.docs = ([], [], [])

    def close(self) -> dict:
        if self.held:
            padded = np.zeros(-(-self.held // self.sequence) * self.sequence, self.dtype)
            padded[: self.held] = np.concatenate(self.parts)
            self._batch(padded, self.held)
        if self.docs[0]:
            self._index()
        for x in (self.ids, self.index, *self.outs):
            x.close()
        return self.row


class TokenFile:
    """Random access to a file of sequences; a local file's arrays are views of the mapped file."""

    def __init__(self, uri: str):
        self.source = files.open_map(uri)
        with pa.ipc.open_stream(self.source) as stream:
            self.batches = list(stream)
        self.sequence = self.batches[0].schema.field("input_ids").type.list_size if self.batches else 0
        self.flat = [b.column("input_ids").flatten().to_numpy() for b in self.batches]
        self.masks = [(b.column("mask").indices.to_numpy(), b.column("mask").dictionary.flatten().to_numpy()) for b in self.batches]
        self.size = len(self.flat[0]) if self.flat else 1

    def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Sequence k and its mask (1 for ids, 0 for padding), both views of the file."""
        b, i = divmod(k, self.size // self.sequence)
        which, masks = self.masks[b]
        own = lambda x, j: x[j * self.sequence : (j + 1) * self.sequence]
        return own(self.flat[b], i), own(masks, which[i])

    def pieces(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids from start on, as views: more than one where they cross batches."""
        while n > 0:
            b, i = divmod(start, self.size)
            piece = self.flat[b][i : i + n]
            yield piece
            start, n = start + len(piece), n - len(piece)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def write_tokens(docs: DataFrame, root: str, tokenizer: str, end_id: int, sequence: int = SEQUENCE, batch: int = BATCH, rows_per_shard: int | None = None) -> dict:
    """Encodes every whole text of docs (doc_id, text; other columns are ignored) into files under root.

    Documents come in ascending doc_id order, null ids first; rows that repeat a doc_id all count, in the
    order of their texts. Null and empty texts have the end id alone. An empty table gives no files. A shard
    has rows_per_shard rows (by default a 64th of all, 500 to 20,000). Returns the manifest, in which base is
    the number of ids before a shard; the driver holds one row for each shard.
    """
    n = docs.count()
    bounds = range_bounds(docs, "doc_id", rows_per_shard or max(500, min(20_000, n // 64)))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer = word_encoder(tokenizer), None
        end = np.array([end_id], encoder.dtype)
        done: list[dict] = []
        for rows in batches:
            for shard, doc_id, text in zip(*(rows.column(c) for c in ("shard", "doc_id", "text")), strict=True):
                if writer is None or writer.row["shard"] != shard.as_py():
                    done += [writer.close()] if writer else []
                    writer = TokenWriter(root, shard.as_py(), encoder.dtype.name, sequence, batch)
                writer.add(doc_id.as_py(), np.concatenate([encoder.ids(text.as_py() or ""), end]))
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=_schema(MANIFEST))
                done = []
        if writer:
            yield pa.RecordBatch.from_pylist([writer.close()], schema=_schema(MANIFEST))

    dealt = docs.select("doc_id", "text").withColumn("shard", shard_column(bounds, "doc_id")).repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", "doc_id", "text")
    written = table(dealt.mapInArrow(write, MANIFEST), "tokens-manifest").orderBy("shard").collect()
    entries, shards, base = [], [], 0
    for r in written:
        names = {"name": f"tokens-{r.shard:06d}.arrows", "index": f"index-{r.shard:06d}.arrows"}
        entries += [{"tmp": r.tmp, "name": names["name"]}, {"tmp": r.index_tmp, "name": names["index"]}]
        shards.append(names | {"base": base, "ids": r.ids, "docs": r.docs})
        base += r.ids
    return files.commit(root, entries, shards=shards, ids=base, sequence=sequence, batch=batch)


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens and the CRC-32 of its ids as unsigned 32-bit integers."""
    shards = [(f"{root}/{s['name']}", f"{root}/{s['index']}", s["base"]) for s in files.resume(root)["shards"]]
    listed = spark.createDataFrame(shards, "uri string, index string, base long").repartition(max(1, len(shards)))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, index, base in zip(*(batch.column(c).to_pylist() for c in ("uri", "index", "base")), strict=True):
                tokens = TokenFile(uri)
                with pa.ipc.open_stream(files.open_map(index)) as stream:
                    for rows in stream:
                        crcs = []
                        for start, n in zip(rows.column("start").to_pylist(), rows.column("n_tokens").to_pylist(), strict=True):
                            crc = 0
                            for piece in tokens.pieces(start, n):
                                crc = zlib.crc32(piece.astype("<u4"), crc)
                            crcs.append(crc)
                        starts = pa.array(rows.column("start").to_numpy() + base)
                        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), starts, rows.column("n_tokens"), pa.array(crcs, pa.int64())], schema=schema)

    return listed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_to_files(docs: DataFrame, tokenizer: str, end_id: int, root: str | None = None, **options) -> DataFrame:
    """Writes docs under root (by default a new folder in the shared one) and describes each document from the files."""
    root = root or new_folder(docs.sparkSession, "tokens")
    write_tokens(docs, root, tokenizer, end_id, **options)
    return read_documents(docs.sparkSession, root)
