"""Exact token ids in Arrow batches, with a vocabulary of words already encoded.

A tokenizer whose pre-tokenizer drops white space encodes a text as the concatenation of
its white-space-separated words. So each batch is split and dictionary-encoded by Arrow,
each new word is encoded once, and ids are gathered by numpy. Texts of plain Latin letters,
digits and ASCII punctuation without apostrophes are first lower-cased and split into
pre-tokens by Arrow; their words go to the same merges in tiktoken's core, in which the
word end is a byte that UTF-8 never has. All other words go through the tokenizer itself.
Its added tokens, such as <|endoftext|>, cut a text as they do in the tokenizer as loaded:
each becomes a word of its own, whose id is the added token's.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tallyloom.llm.common import per_process

#: Texts are handled in slices of so many bytes, or one text, if that is longer.
SLICE_BYTES = 2_000_000
#: Words kept from earlier slices; beyond it the memory is emptied.
WORDS_KEPT = 150_000
#: Texts that need no Unicode rules: such texts, their punctuation and digits, and their words.
PLAIN = "^[\\t\\n\\r -&(-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*$"
PUNCTUATION = r"([!-&(-/:-@\[-`{-~]+|[0-9])"
PLAIN_WORD = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[!-&(-/:-@\\[-`{-~]+")
#: Stands for the end of a word.
WORD_END = b"\xff"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class WordEncoder:
    """Ids of texts, equal to the tokenizer's with add_special_tokens=False."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        if model["model"].get("end_of_word_suffix") != "</w>" or len(model["normalizer"]["normalizers"]) != 3:
            raise ValueError(f"{path} isn't a lower-casing BPE with word ends")
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in model["added_tokens"]):
            raise ValueError(f"{path} has added tokens that depend on what is around them")
        self.special, of = sorted({t["content"] for t in model["added_tokens"]}, key=len), _byte_of_char()
        self.any_special = "|".join(re.escape(t) for t in reversed(self.special)) or "$^"
        ranks = {}
        for token, i in model["model"]["vocab"].items():
            if token not in self.special:
                ends = token.endswith("</w>")
                ranks[bytes(of[c] for c in (token[:-4] if ends else token)) + WORD_END * ends] = i
        self.piece = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self._empty()

    def _empty(self) -> None:
        self.slot: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.begin, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _learn(self, words: list[str]) -> None:
        got = [self.piece(w.encode() + WORD_END) if PLAIN_WORD.fullmatch(w) else None for w in words]
        hard = [w for w, ids in zip(words, got, strict=True) if ids is None]
        own = iter(self.tokenizer.encode_batch(hard, add_special_tokens=False) if hard else ())
        got = [next(own).ids if ids is None else ids for ids in got]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        total, n = int(sizes.sum()), len(self.slot)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(words) > len(self.begin):
            self.begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size))
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(got), np.uint32, total)
        self.begin[n : n + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.size[n : n + len(words)] = sizes
        self.used += total
        self.slot.update(zip(words, range(n, n + len(words)), strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """flat word slots with the texts' offsets into them, and each text's number of ids, and its words' sizes."""
        cut = pc.match_substring_regex(texts, self.any_special)
        plain = pc.and_not(pc.match_substring_regex(texts, PLAIN), cut)
        spaced = pc.if_else(cut, pc.replace_substring_regex(texts, f"({self.any_special})", r" \1 "), texts) if pc.any(cut).as_py() else texts
        for mark in ("\n", "\t", "\r"):
            spaced = pc.replace_substring(spaced, mark, " ")
        simple = pc.replace_substring_regex(pc.utf8_lower(spaced), PUNCTUATION, r" \1 ")
        lists = pc.split_pattern(pc.if_else(plain, simple, spaced), " ")
        words = lists.flatten().dictionary_encode()
        names = words.dictionary.to_pylist()
        if len(self.slot) > WORDS_KEPT:
            self._empty()
        new = [w for w in names if w not in self.slot]
        if new:
            self._learn(new)
        slots = np.fromiter((self.slot[w] for w in names), np.int64, len(names))[words.indices.to_numpy(zero_copy_only=False)]
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        sizes = self.size[slots]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return slots, sizes, ends[offsets], ends

    def ids(self, slots: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """All ids of the words in order."""
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes) + np.repeat(self.begin[slots], sizes)
        return self.flat[at]


def encoder(path: str) -> WordEncoder:
    return per_process(f"encoder:{path}", lambda: WordEncoder(path))


def slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Parts of a batch with their texts (null as empty), of SLICE_BYTES or one row."""
    texts = pc.fill_null(batch.column(batch.schema.get_field_index(column)), "").cast(pa.large_string())
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(batch):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + SLICE_BYTES, side="right")))
        yield batch.slice(start, stop - start), texts.slice(start, stop - start)
        start = stop
