"""Pre-tokenisation for the lower-casing word BPE, and cached word codes.

The tokenizer file asks for NFC, white space runs -> one blank, lower case, then a split into
contractions, letter runs, single numerals and runs of anything else. Texts made of characters whose
treatment is plain are split by Arrow's compute functions over a whole batch, and their distinct
words are looked up once per batch. Any other text goes through the tokenizers library's own
normaliser and pre-tokeniser, so the answer is the library's.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

# FIXED VALUES of the tokenizer file format this module understands.
NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}

#: A character outside these is not plain: composed forms, special casing, odd white space.
NOT_PLAIN = r"[^\t-\r\x20-\x{12f}\x{131}-\x{24f}\x{2010}-\x{2027}\x{2030}-\x{205e}\x{20ac}]"
#: The words of ``SPLIT`` that are not letter runs; blanks around them leave words between blanks.
APART = r"'s|'t|'re|'ve|'m|'ll|'d|\p{N}|[^\s\x0b\x{85}\x{a0}\p{L}\p{N}]+"


def byte_chars() -> list[str]:
    """The printable stand-in for every byte: itself if printable Latin-1, else 256 upwards."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


class WordSplitter:
    """Cuts texts into words as the tokenizer file says."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        if self.spec["normalizer"] != NORMALIZER or self.spec["pre_tokenizer"] != PRE_TOKENIZER \
                or self.spec.get("post_processor") or self.spec.get("decoder"):
            raise ValueError(f"{path}: not the lower-casing word BPE this operator encodes for")
        self.library = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        self._special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def needs_library(self, texts: pa.Array) -> np.ndarray:
        """Which texts hold characters that are not plain, or the string of a special token."""
        odd = pc.match_substring_regex(texts, NOT_PLAIN)
        for content in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, content))
        return odd.to_numpy(zero_copy_only=False)

    def plain_words(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(words, offsets) of plain texts; empty strings among the words stand for nothing."""
        lists = pc.utf8_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), APART, r" \0 "))
        return lists.flatten(), lists.offsets.to_numpy()

    def library_words(self, text: str) -> list[str | int]:
        """Words of any text, in order; a special token stands as its id."""
        out: list[str | int] = []
        for i, part in enumerate(self._special.split(text) if self._special else [text]):
            if i % 2:
                out.append(self.special[part])
            elif part:
                norm = self.library.normalizer.normalize_str(part)
                out += [norm[s:e] for _, (s, e) in self.library.pre_tokenizer.pre_tokenize_str(norm)]
        return out


class WordCodes:
    """word -> ids, computed by ``encode_words`` (distinct words -> bytes of unsigned 32-bit ids).

    Words are kept in two generations of ``limit`` entries: when the young one is full it becomes
    the old one, and words met again move to the young. The bound only limits memory: a word that
    was dropped is computed anew.
    """

    def __init__(self, splitter: WordSplitter, encode_words, limit: int = 120_000):
        self.splitter, self.encode_words, self.limit = splitter, encode_words, limit
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def codes(self, words: list[str]) -> list[bytes]:
        """Of distinct words."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {"": b""}
        young, old = self.young, self.old
        out = list(map(young.get, words))
        todo = []
        for i, w in enumerate(words):
            if out[i] is None:
                code = old.get(w)
                if code is None:
                    todo.append(i)
                else:
                    out[i] = young[w] = code
        for i, code in zip(todo, self.encode_words([words[i] for i in todo])):
            out[i] = young[words[i]] = code
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one after another, offsets of the texts); a null counts as empty."""
        texts = pc.fill_null(texts, "")
        odd = self.splitter.needs_library(texts)
        words, offsets = self.splitter.plain_words(pc.if_else(pa.array(odd), "", texts) if odd.any() else texts)
        table = words.dictionary_encode()
        codes = self.codes(table.dictionary.to_pylist())
        size = np.fromiter(map(len, codes), np.int64, len(codes)) // 4
        pool = np.frombuffer(b"".join(codes), "<u4")
        at = table.indices.to_numpy()
        n = size[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = pool[np.arange(ends[-1]) - np.repeat(ends[:-1] - (np.cumsum(size) - size)[at], n)]
        ends = ends[offsets]
        if not odd.any():
            return ids, ends
        parts = [self._odd(texts[i].as_py()) if odd[i] else ids[ends[i]:ends[i + 1]] for i in range(len(texts))]
        return np.concatenate(parts), np.cumsum([0] + [len(p) for p in parts])

    def _odd(self, text: str) -> np.ndarray:
        units = self.splitter.library_words(text)
        words = list({u for u in units if isinstance(u, str)})
        code = dict(zip(words, self.codes(words)))
        return np.frombuffer(b"".join(code[u] if isinstance(u, str) else u.to_bytes(4, "little") for u in units), "<u4")


def slices(texts: pa.Array, size: int = 4_000_000):
    """Consecutive runs of texts of about ``size`` bytes (one text at least)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    lo, before = 0, 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, before + size, "right")))
        yield lo, hi
        lo, before = hi, int(ends[hi - 1])
