"""Token ids of whole texts by a Hugging Face `tokenizers` file, looked up by distinct chunk.

If the file's normaliser and pre-tokeniser are those of FIXED, neither looks across white space, so a text's ids are the
ids of its space-separated chunks, one after the other. A block of texts is cut into chunks and reduced to the distinct
ones by Arrow; a chunk of Latin letters and end punctuation is cut once more, as letters are looked up without their
case or punctuation. What a worker has looked up stays in one table of bounded bytes. Files with any other normaliser or
pre-tokeniser are encoded text by text by the library. tests/llm compares both with the library on whole texts.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common

END_ID = 1
#: The normaliser and pre-tokeniser that are known not to look across white space.
FIXED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
}
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_ENDS = ".,;:!?*$%&#"  # no apostrophe: 's and the like are tokens of their own
_LOWER = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if chr(c) != "÷")


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Table:
    """Known strings and their ids."""

    def __init__(self, kind: np.dtype):
        self.known = pa.array([], pa.string())
        self.sizes, self.flat = np.empty(0, dtype=np.int32), np.empty(0, dtype=kind)

    def nbytes(self) -> int:
        return self.known.nbytes + self.sizes.nbytes + self.flat.nbytes

    def rows(self, strings: pa.Array, encode: Callable) -> np.ndarray:
        """Places of distinct strings; those that the table lacks are encoded and added."""
        at = pc.index_in(strings, value_set=self.known)
        if not at.null_count:
            return at.to_numpy()
        missing = strings.filter(pc.is_null(at))
        rows = at.fill_null(-1).to_numpy().copy()
        rows[rows < 0] = np.arange(len(self.known), len(self.known) + len(missing))
        sizes, flat = encode(missing.to_pylist())
        self.known = pa.concat_arrays([self.known, missing])
        self.sizes, self.flat = np.concatenate([self.sizes, sizes.astype(np.int32)]), np.concatenate([self.flat, flat])
        return rows


class ChunkTokenizer:
    """max_bytes bounds the tables of known chunks, block_bytes the texts that are looked up at a time."""

    def __init__(self, path: str, max_bytes: int = 32 << 20, block_bytes: int = 4 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        parts = {"normalizer": self.tokenizer.normalizer, "pre_tokenizer": self.tokenizer.pre_tokenizer}
        self.by_chunk = all(x is not None and json.loads(x.__getstate__()) == FIXED[k] for k, x in parts.items())
        # lower-case words of Latin letters need no normaliser; many are encoded as one text and cut at the word ends
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        size = max(self.tokenizer.get_vocab_size(), END_ID + 1)
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.ends = np.zeros(size, dtype=bool)
        self.ends[[i for piece, i in self.tokenizer.get_vocab().items() if suffix and piece.endswith(suffix)]] = True
        self.max_bytes, self.block_bytes = max_bytes, block_bytes
        self._clear()

    def _clear(self) -> None:
        self.words, self.others = _Table(self.kind), _Table(self.kind)

    def _encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        return np.array([len(x) for x in got], dtype=np.int32), np.array([i for x in got for i in x], dtype=self.kind)

    def _encode_words(self, words: list[str], together: int = 2000) -> tuple[np.ndarray, np.ndarray]:
        sizes, flat = [], []
        for i in range(0, len(words), together):
            part = words[i : i + together]
            ids = np.asarray(self.plain.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype=self.kind)
            size = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
            if len(size) != len(part):  # a vocabulary without word ends
                size, ids = self._encode(part)
            sizes.append(size)
            flat.append(ids)
        return np.concatenate(sizes), np.concatenate(flat)

    def _flat(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks, one after the other, and their numbers of ids."""
        plain = pc.match_substring_regex(distinct, f"^[{_LETTERS}]+[{_ENDS}]*$")
        mask, low = plain.to_numpy(zero_copy_only=False), pc.utf8_lower(distinct.filter(plain))
        words, ends = pc.utf8_rtrim(low, _ENDS).dictionary_encode(), pc.utf8_ltrim(low, _LOWER).dictionary_encode()
        word = self.words.rows(words.dictionary, self._encode_words)[words.indices.to_numpy()] if len(low) else np.empty(0, dtype=np.int32)
        end = self.others.rows(ends.dictionary, self._encode)[ends.indices.to_numpy()] if len(low) else np.empty(0, dtype=np.int32)
        rest = self.others.rows(distinct.filter(pc.invert(plain)), self._encode)
        # a chunk is a word and an end; one of another form has no word
        flat, shift = np.concatenate([self.words.flat, self.others.flat]), len(self.words.flat)
        at_word, at_other = (np.cumsum(t.sizes, dtype=np.int64) - t.sizes for t in (self.words, self.others))
        begin, size = np.zeros((len(distinct), 2), dtype=np.int64), np.zeros((len(distinct), 2), dtype=np.int32)
        begin[mask, 0], size[mask, 0] = at_word[word], self.words.sizes[word]
        begin[mask, 1], size[mask, 1] = shift + at_other[end], self.others.sizes[end]
        begin[~mask, 1], size[~mask, 1] = shift + at_other[rest], self.others.sizes[rest]
        return _gather(flat, begin.ravel(), size.ravel()), size.sum(axis=1, dtype=np.int32)

    def _block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id, and where each text begins (and the last ends)."""
        if self.words.nbytes() + self.others.nbytes() > self.max_bytes:
            self._clear()
        lists = pc.split_pattern(pc.replace_substring_regex(texts, r"[\n\t\r]", " "), " ")
        ends = np.cumsum(pc.list_value_length(lists).to_numpy())
        chunks = lists.flatten().dictionary_encode()
        flat, size = self._flat(chunks.dictionary)
        flat, size = np.append(flat, np.array([END_ID], dtype=self.kind)), np.append(size, np.int32(1))
        at = np.insert(chunks.indices.to_numpy(), ends, len(size) - 1)
        sizes = size[at]
        ids = _gather(flat, (np.cumsum(size, dtype=np.int64) - size)[at], sizes)
        last = np.cumsum(sizes, dtype=np.int64)[ends + np.arange(len(ends))]
        return ids, np.concatenate([[0], last])

    def _long(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """A text of more than a block, cut where a chunk ends."""
        text, at, parts = text.replace("\n", " ").replace("\t", " ").replace("\r", " "), 0, []
        while at < len(text):
            cut = text.find(" ", at + self.block_bytes // 4)
            cut = len(text) if cut < 0 else cut + 1
            parts.append(self._block(pa.array([text[at:cut]]))[0][:-1])
            at = cut
        ids = np.concatenate([*parts, np.array([END_ID], dtype=self.kind)])
        return ids, np.array([0, len(ids)])

    def encoded(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of texts in order: the ids of the block's texts, each with the end id (null: the end id only), and
        the places where each text begins, with the place after the last."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        total = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
        at = 0
        while at < len(texts):
            done = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, done + self.block_bytes, side="right")))
            if not self.by_chunk:
                sizes, flat = self._encode(texts.slice(at, to - at).to_pylist())
                ends = np.cumsum(sizes, dtype=np.int64)
                yield np.insert(flat, ends, END_ID), np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])
            elif to == at + 1 and total[at] - done > self.block_bytes:
                yield self._long(texts[at].as_py())
            else:
                yield self._block(texts.slice(at, to - at))
            at = to
            common.trim()

    def ids(self, texts: list[str | None]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers, without an end id."""
        for ids, starts in self.encoded(pa.array(texts, pa.string())):
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                yield ids[a : b - 1].astype("<u4").tobytes()


def _gather(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[begin : begin + size] of every pair, one after the other."""
    total = np.cumsum(size, dtype=np.int64)
    n = int(total[-1]) if len(total) else 0
    kind = np.int32 if max(n, len(flat)) < 1 << 30 else np.int64
    place = np.repeat((begin - (total - size)).astype(kind), size)
    place += np.arange(n, dtype=kind)
    return flat[place]


_LOADED: dict[str, ChunkTokenizer] = {}


def tokenizer(path: str) -> ChunkTokenizer:
    """One per worker and file."""
    if path not in _LOADED:
        _LOADED[path] = ChunkTokenizer(path)
    return _LOADED[path]
