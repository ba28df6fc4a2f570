"""Encoding with the tokenizers library, word by word, with the words that repeat encoded once."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

#: Memory for each of the two tables of parts that one worker keeps with their ids, and what a part takes besides its characters and ids.
PARTS_BYTES, PART_BYTES = 100 << 20, 200
#: Texts of ASCII and Latin-1 letters only have one normal form; the tokenizer cuts them, lower-cased, into these
#: parts (fixed values).
PLAIN = re.compile("[\\t\\n\\r -~À-ÖØ-öø-ÿ]*")
PARTS = re.compile("[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\\sa-z0-9ß-öø-ÿ]+")


#: What a tokenizer file must say for PARTS to be its parts (fixed values of the format).
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}


def drops_blanks(spec: dict) -> bool:
    """Whether a tokenizer's words can be encoded one by one: its very rules are compared, and others are left to the library."""
    normalizers, pre, model = ((spec.get("normalizer") or {}).get("normalizers"), (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}], spec["model"])
    plain = all(t["content"].startswith("<|") and not any(c.isspace() for c in t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in spec.get("added_tokens", []))
    rest = [{"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}]
    same = [{k: v for k, v in x.items() if k != "trim_offsets"} for x in pre[1:]] == rest
    return plain and normalizers == NORMALIZERS and pre[0] == SPLIT and same and model.get("end_of_word_suffix") is not None and model.get("dropout") is None


class WordEncoder:
    """Exactly what the library's encode(text, add_special_tokens=False) gives, for tokenizers that drop white space.

    Such a tokenizer never joins what a blank parts, neither when it normalises nor when it merges, so a
    text's ids are those of its words in order. Plain texts are cut on into the tokenizer's own parts, which
    repeat more than words do; a word that isn't plain is left whole. The library encodes each part once, as
    long as a worker's tables hold it: a full one is kept until the next is full, and parts that are met again move on.
    """

    def __init__(self, path: str, most: int = PARTS_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks fill the cores already
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = drops_blanks(spec)
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.parts: dict[str, bytes] = {}
        self.most, self.parts_bytes = most, 0
        self.older: dict[str, bytes] = {}  # the last full table

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.dtype).tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _cut(text: str) -> list[str]:
        if PLAIN.fullmatch(text) and "<|" not in text:
            return PARTS.findall(text.lower())
        parts: list[str] = []
        for word in text.replace("\n", " ").split(" "):
            if PLAIN.fullmatch(word) and "<|" not in word:
                parts += PARTS.findall(word.lower())
            else:
                parts.append(word)
        return parts

    def encode(self, text: str) -> bytes:
        """The ids as little-endian integers of the encoder's dtype."""
        if not self.by_word:
            return self._library([text])[0]
        parts = self._cut(text)
        out = list(map(self.parts.get, parts))
        try:
            return b"".join(out)
        except TypeError:  # some are new
            places = [i for i, ids in enumerate(out) if ids is None]
        known = {p: self.older.get(p) for p in {parts[i] for i in places}}
        new = [p for p, ids in known.items() if ids is None]
        known.update(zip(new, self._library(new), strict=True))
        size = sum(PART_BYTES + 4 * len(p) + len(ids) for p, ids in known.items())  # a character has 4 bytes at most
        if self.parts_bytes + size > self.most:
            self.older, self.parts, self.parts_bytes = self.parts, {}, 0
        if size < self.most // 2:  # a text of very many different words isn't remembered
            self.parts.update(known)
            self.parts_bytes += size
        for i in places:
            out[i] = known[parts[i]]
        return b"".join(out)

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode(text), self.dtype)


@lru_cache(maxsize=2)
def word_encoder(path: str, most: int = PARTS_BYTES) -> WordEncoder:
    """One encoder for each worker process, tokenizer and size of its tables."""
    return WordEncoder(path, most)
