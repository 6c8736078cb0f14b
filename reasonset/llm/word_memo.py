"""Encoding of texts chunk by chunk, for tokenizers that never join anything across white space or between letters, digits and marks.

A batch of texts is cut in one pass over its bytes: at white space, and between ASCII letters, digits and marks where the
tokenizer's pattern always cuts (not beside an apostrophe or a non-ASCII character). The distinct chunks of a batch are found by
Arrow, and the ids of all texts are gathered from those of the chunks.

Chunks are remembered in two generations of bounded bytes: when the young one is full it becomes the old one, and what is
met again comes back from there. So frequent chunks stay and those seen once go first; it costs time when one comes
again and changes nothing.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer

#: Bytes of one generation, with what an entry costs besides its own bytes.
GENERATION, ENTRY = 48 << 20, 170

# White space beyond ASCII as Unicode has it, in UTF-8.
_WIDE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
# Characters that composition leaves as they are and that lower case maps one to one.
_PLAIN = re.compile("[!-~¡-įı-ɏ]*")

# What the words of a file must be made by, so that they can be cut as above.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

# Kinds of bytes: 0 white space, 1 letters, 2 digits, 4 marks, 8 what is never cut off (apostrophes and parts of other characters).
_KIND = np.full(256, 8, np.uint8)
_KIND[33:127] = 4
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_KIND[39] = 8
_KIND[[9, 10, 11, 12, 13, 32]] = 0


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    own = {b: chr(b) for b in shown}
    return [own.get(b) or chr(next(rest)) for b in range(256)]


def supported(spec: dict) -> bool:
    """Whether the file cuts and writes words as this module takes it."""
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split = {"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True}
    level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
    model = spec["model"]
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    whole = all(not any(t[k] for k in ("single_word", "lstrip", "rstrip", "normalized")) and not re.search(r"\s", t["content"]) for t in spec["added_tokens"])
    cuts = len(steps) == 2 and steps[0] == split and {k: steps[1].get(k) for k in level} == level
    return spec["normalizer"] == _NORMALIZER and cuts and model["type"] == "BPE" and plain and whole


class WordPieces:
    """The parts of a tokenizer file that prepare a word: normalization, cutting, and bytes as characters."""

    def __init__(self, path: str):
        self.path = path
        spec = json.loads(open(path, encoding="utf-8").read())
        if not supported(spec):
            raise ValueError(f"{path} normalizes or cuts words in another way")
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.model = spec["model"]
        self.cut = regex.compile(_PATTERN)
        self.table = str.maketrans({chr(b): c for b, c in enumerate(byte_alphabet())})
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added_cut = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        self.suffix = self.model["end_of_word_suffix"] or ""

    def pieces(self, word: str) -> list[str]:
        """The word, free of added tokens, as pieces written in the byte alphabet."""
        if _PLAIN.fullmatch(word):
            found = self.cut.findall(word.lower())
        else:
            found = self.cut.findall(self.normalizer.normalize_str(word))
        return [p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(self.table) for p in found]

    def parts(self, word: str) -> list[int | str]:
        """The ids of added tokens inside a word, and the pieces between them."""
        if word.isascii() and word.isalpha():
            return [word.lower()]
        if not self.added_cut or not self.added_cut.search(word):
            return self.pieces(word)
        out: list[int | str] = []
        for part in self.added_cut.split(word):
            out += [self.added[part]] if part in self.added else self.pieces(part) if part else []
        return out


def chunks(texts: list[bytes], added: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The chunks of the texts in order, and where each text's begin."""
    texts = [t if t.isascii() else _WIDE.sub(b" ", t) for t in texts]
    joined = b"\n".join(texts)
    buffer = np.frombuffer(joined, np.uint8)
    kind = _KIND[buffer]
    inside = kind > 0
    cut = np.zeros(len(buffer) + 1, bool)
    cut[1:-1] = inside[1:] != inside[:-1]
    cut[:1] = cut[-1:] = len(buffer) > 0
    fine = not any(token in joined for token in added)
    if fine:  # between different kinds of ASCII characters
        cut[1:-1] |= (kind[1:] | kind[:-1] | 8 != 8) & (kind[1:] != kind[:-1]) & ((kind[1:] | kind[:-1]) < 8)
    edges = np.flatnonzero(cut)
    filled = inside[edges[:-1]] if len(edges) else np.zeros(0, bool)
    starts, sizes = edges[:-1][filled], np.diff(edges)[filled]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    data = buffer[inside]
    if fine and len(starts):  # ASCII chunks differ by case only to the eye
        wide = np.repeat(np.add.reduceat(data > 127, offsets[:-1], dtype=np.int32) > 0, sizes)
        data = np.where((data >= 65) & (data <= 90) & ~wide, data | 32, data)
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    begins = np.cumsum([0, *[len(t) + 1 for t in texts]])
    return found, np.searchsorted(starts, begins)


class WordMemo:
    """Texts to id arrays through a function that encodes many new chunks at once."""

    def __init__(self, resolve: Callable[[list[str]], list[bytes]], dtype: str, added: list[str], generation: int = GENERATION):
        self.resolve, self.dtype, self.generation = resolve, np.dtype(dtype), generation
        self.added = [a.encode() for a in added]
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.size = 0

    def _remember(self, word: bytes, ids: bytes) -> None:
        if self.size > self.generation:
            self.young, self.old, self.size = {}, self.young, 0
        self.young[word] = ids
        self.size += len(word) + len(ids) + ENTRY

    def known(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words."""
        out = [self.young.get(w) for w in words]
        missing = [k for k, ids in enumerate(out) if ids is None]
        new = []
        for k in missing:
            ids = self.old.get(words[k])
            if ids is None:
                new.append(k)
            else:
                out[k] = ids
                self._remember(words[k], ids)
        for start in range(0, len(new), 1 << 14):
            some = new[start : start + (1 << 14)]
            for k, ids in zip(some, self.resolve([words[k].decode() for k in some])):
                out[k] = ids
                self._remember(words[k], ids)
        return out

    def encode_flat(self, texts: list[str | bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text's begin, with the end at last."""
        found, begins = chunks([t.encode() if isinstance(t, str) else t for t in texts], self.added)
        encoded = found.dictionary_encode()
        index = encoded.indices.to_numpy()
        ids = self.known(encoded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        pool = np.frombuffer(b"".join(ids), self.dtype)
        length = sizes[index]
        ends = np.concatenate([[0], np.cumsum(length)])
        place = np.repeat((np.cumsum(sizes) - sizes)[index] - ends[:-1], length)
        place += np.arange(len(place))
        return pool[place], ends[begins]

    def encode(self, texts: list[str | bytes]) -> list[np.ndarray]:
        flat, bounds = self.encode_flat(texts)
        return [flat[a:b] for a, b in zip(bounds, bounds[1:])]


class LibraryTexts:
    """The same for tokenizers that do otherwise: whole texts through the library."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def encode(self, texts: list[str | bytes]) -> list[np.ndarray]:
        return [np.array(self.tokenizer.encode(t if isinstance(t, str) else t.decode(), add_special_tokens=False).ids, "<u4") for t in texts]
