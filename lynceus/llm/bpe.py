"""BPE encoding with content-defined chunks, and decoding.

A text is cut where a rolling hash of the last bytes says so, so texts that share a passage share its chunks,
wherever it stands in them. Each worker encodes a chunk it meets again only once. Cuts fall where they may, most of
them inside words, so the ids of chunks can't just be put together: what stands around a join is encoded anew.

For tokenizers that drop white space, ids depend on nothing beyond a word, so a chunk is encoded from its first blank
to its last, and the pieces of a word that cuts have parted, over as many chunks as it takes, are encoded together. For
others, chunks begin at blanks; the words beside each cut are encoded together and apart, and chunks whose join
disagrees are merged and encoded anew, until every join agrees.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lynceus.llm.words import word_encoder

#: Bytes that the rolling hash sees, bytes per chunk and blanks per chunk on average, text in one output batch.
WINDOW, SIZE, SPACING, BATCH_BYTES = 16, 256, 32, 4 << 20
#: Memory for the chunks that a worker keeps with their ids, and what one takes besides its bytes and ids.
CHUNKS_BYTES, CHUNK_BYTES = 32 << 20, 160
#: Memory for each table of parts, less than where no chunks are kept beside them.
PARTS_BYTES = 32 << 20
GEAR = np.random.default_rng(1).integers(1, 1 << 32, 256, "uint32")
POWERS = np.array([pow(0x9E3779B1, k, 1 << 32) for k in range(WINDOW)], "uint32")
#: Bytes hashed at a time.
BLOCK = 1 << 20


def _hashes(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The hash of the WINDOW bytes before each place."""
    h = np.zeros(len(at), "uint32")
    for k in range(WINDOW):
        h += GEAR[b[at - 1 - k]] * POWERS[k]
    return h >> np.uint32(7)


def cuts(data: bytes, size: int = SIZE) -> list[int]:
    """Ascending places in data, without 0, at which a chunk begins: anywhere between characters."""
    b, out = np.frombuffer(data, "u1"), []
    for k in range(WINDOW, len(b), BLOCK):
        n = min(BLOCK, len(b) - k)
        gear, h = GEAR[b[k - WINDOW : k + n - 1]], np.zeros(n, "uint32")
        for j in range(WINDOW):
            h += gear[WINDOW - 1 - j : WINDOW - 1 - j + n] * POWERS[j]
        at = np.flatnonzero((h >> np.uint32(7)) % np.uint32(size) == 0) + k
        out += at[(b[at] & 0xC0) != 0x80].tolist()
    return out


def blank_cuts(data: bytes, spacing: int = SPACING) -> list[int]:
    """As cuts, at single blanks between other characters only."""
    b = np.frombuffer(data, "u1")
    if len(b) <= WINDOW + 1:
        return []
    blank = b <= 32
    at = np.flatnonzero((b[1:-1] == 32) & ~blank[:-2] & ~blank[2:]) + 1
    at = at[at >= WINDOW]
    return at[_hashes(b, at) % np.uint32(spacing) == 0].tolist()


class ChunkEncoder:
    """encode(text) equals the library's encode(text, add_special_tokens=False).ids, decode(ids) its decode(ids, skip_special_tokens=False)."""

    def __init__(self, path: str):
        self.words = word_encoder(path, PARTS_BYTES)
        self.library, self.dtype = self.words.library, self.words.dtype
        self.chunks: dict[bytes, bytes] = {}
        self.chunks_bytes = 0
        self.reused = self.encoded = self.repaired = 0
        self.names = None
        if self.library.decoder is None:  # then tokens are joined by blanks
            n = self.library.get_vocab_size()
            self.names = [(self.library.id_to_token(i) or "").encode() for i in range(n)]

    def _chunk(self, data: bytes, whole: bool = False) -> tuple[bytes, bytes, bytes]:
        """What stands before a chunk's first blank, the ids up to its last one, and what stands from there on; all of it is ids if whole."""
        first, last = (0, len(data)) if whole else (data.find(b" "), data.rfind(b" "))
        ids = self.chunks.get(data)
        if ids is None:
            ids = self.words.encode(data[first:last].decode())
            self.encoded += 1
            if len(data) < 1 << 12:
                size = CHUNK_BYTES + len(data) + len(ids)
                if self.chunks_bytes + size > CHUNKS_BYTES:
                    self.chunks, self.chunks_bytes = {}, 0
                self.chunks[data] = ids
                self.chunks_bytes += size
        else:
            self.reused += 1
        return data[:first], ids, data[last:]

    def _agree(self, a: bytes, b: bytes) -> bool:
        """Whether the last two words of a and the first two of b are encoded alike together and apart."""
        left, right = b" ".join(a.split(b" ")[-2:]), b" ".join(b.split(b" ")[:3])
        return self.words.encode((left + right).decode()) == self.words.encode(left.decode()) + self.words.encode(right.decode())

    def encode(self, text: str) -> np.ndarray:
        data = text.encode()
        at = [0, *(cuts(data) if self.words.by_word else blank_cuts(data)), len(data)]
        parts = [data[a:b] for a, b in zip(at, at[1:], strict=False)]
        return np.frombuffer(b"".join(self._words(parts) if self.words.by_word else self._agreed(parts)), self.dtype)

    def _words(self, parts: list[bytes]) -> list[bytes]:
        """Ids of chunks and, between them, of the words that their ends make up."""
        out, left = [], b""
        for p in parts:
            if b" " not in p:
                self.repaired += bool(left) and bool(p)
                left += p
                continue
            before, ids, after = self._chunk(p)
            self.repaired += bool(left.strip(b" ")) and bool(before)
            out += [self.words.encode((left + before).decode()), ids]
            left = after
        return [*out, self.words.encode(left.decode())]

    def _agreed(self, parts: list[bytes]) -> list[bytes]:
        """Ids of chunks, merged where their joins disagree."""
        whole: list[bytes] = []
        for p in parts:
            while whole and not self._agree(whole[-1], p):
                p = whole.pop() + p
                self.repaired += 1
            whole.append(p)
        return [self._chunk(p, whole=True)[1] for p in whole]

    def decode(self, ids: np.ndarray) -> bytes:
        """The decoded text in UTF-8."""
        if self.names is None:
            return self.library.decode(ids.tolist(), skip_special_tokens=False).encode()
        return b" ".join(map(self.names.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def chunk_encoder(path: str) -> ChunkEncoder:
    """One encoder for each worker process and tokenizer."""
    return ChunkEncoder(path)


def encode_and_decode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per row of docs: doc_id, ids (array of int) and decoded (string), of the whole text.

    docs needs doc_id and text; other columns are ignored. Null texts are encoded as empty ones, which have
    no ids and decode to the empty text. Rows that repeat are encoded each, null ids stay null, and an empty
    table gives an empty result.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def batch(doc_ids: list, ids: list[np.ndarray], decoded: list[bytes]) -> pa.RecordBatch:
        ends = np.cumsum([0, *map(len, ids)]).astype("int32")
        flat = np.concatenate(ids).astype("int32") if ids else np.zeros(0, "int32")
        return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(decoded, pa.binary()).cast(pa.string())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunk_encoder(tokenizer)
        for rows in batches:
            held, size = ([], [], []), 0
            for doc_id, text in zip(rows.column("doc_id"), rows.column("text"), strict=True):
                text = text.as_py() or ""
                ids = encoder.encode(text)
                for column, value in zip(held, (doc_id.as_py(), ids, encoder.decode(ids)), strict=True):
                    column.append(value)
                size += len(text)
                if size >= BATCH_BYTES:
                    yield batch(*held)
                    held, size = ([], [], []), 0
            if held[0]:
                yield batch(*held)
            rows = text = held = None  # before the next rows come
            pa.default_memory_pool().release_unused()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")
