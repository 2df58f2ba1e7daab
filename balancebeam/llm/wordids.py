"""Token ids of whole texts by way of a memo of space-delimited words.

A byte-level BPE of this kind first cuts a text by a pattern in which a single space belongs to the word after it, and a single line feed between two words
stands alone. So a text whose white space is of these two kinds can be cut there without changing any piece, and most words are met again. A line with any
other white space is given to the encoder whole.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable

import tiktoken
from tokenizers import Tokenizer

from balancebeam.llm.common import Memo


STOPS = ".,;:!?"  # one of them after a letter is a piece of its own at the end of a word


class Irregular(Exception):
    """A word holds white space of another kind, or is empty: two spaces, or one at an end of the line."""


class WordEncoder:
    """``encode(text) -> bytes``: little-endian unsigned 32-bit ids. ``chunk`` encodes any string by itself in the same form."""

    def __init__(self, chunk: Callable[[str], bytes], memo: int = 150_000):
        self.chunk = chunk
        self.first = Memo(self._first, memo)
        self.inner = Memo(self._inner, memo)

    def _first(self, word: str) -> bytes:
        if word.split() != [word]:
            raise Irregular
        if word[-1] in STOPS and word[-2:-1].isalpha():
            return self.first[word[:-1]] + self.first[word[-1]]
        return self.chunk(word)

    def _inner(self, word: str) -> bytes:
        if word.split() != [word]:
            raise Irregular
        if word[-1] in STOPS and word[-2:-1].isalpha():
            return self.inner[word[:-1]] + self.first[word[-1]]
        return self.chunk(" " + word)

    def encode(self, text: str) -> bytes:
        lines = text.split("\n")
        try:
            out = []
            for line in lines:
                words = line.split(" ")
                out.append(self.first[words[0]])
                if len(words) > 1:
                    out[-1] += b"".join(map(self.inner.__getitem__, words[1:]))
            return self.chunk("\n").join(out)
        except Irregular:
            return self._mixed(lines)

    def _mixed(self, lines: list[str]) -> bytes:
        """Regular lines by words; a run of other lines whole, with the line feed before it. The line feed between a run and a regular line is a piece of its own: the
        pattern leaves the last white space before a word out of what comes before it."""
        out, run, feed = [], [], self.chunk("\n")
        for k, line in enumerate(lines):
            try:
                words = line.split(" ")
                ids = self.first[words[0]] + b"".join(map(self.inner.__getitem__, words[1:]))
            except Irregular:
                run.append(line)
                continue
            if run:
                out.append(self.chunk("\n".join(run if k == len(run) else ["", *run])))
                run = []
            if k:
                out.append(feed)
            out.append(ids)
        if run:
            out.append(self.chunk("\n".join(run if len(lines) == len(run) else ["", *run])))
        return b"".join(out)


#: Fixed value: how a byte-level tokeniser file of this kind cuts texts.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_of_sign() -> dict[str, int]:
    """The printable sign that stands for each byte in such a file: itself where it prints, else the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


#: White space that the faster library's pattern engine may not hold on its stack.
LONG_SPACE = re.compile(r"\s{100000}")


def file_encoder(path: str) -> Callable[[str], array]:
    """An encoder of whole texts for a byte-level BPE file of the tokenizers library, without special tokens.

    Where ids follow the order of the merges, ranks say the same as the file, and the faster library for rank files gives the same ids; else, and for a text with a
    run of 100,000 white-space characters, the file's own library encodes it.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    tokenizer = Tokenizer.from_str(json.dumps(spec))
    tokenizer.encode_special_tokens = True
    vocab, merges, cut = spec["model"]["vocab"], spec["model"].get("merges", []), spec.get("pre_tokenizer") or {}
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
    plain = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and not spec.get("normalizer") and made == sorted(set(made))

    def slow(text: str) -> array:
        return array("I", tokenizer.encode(text, add_special_tokens=False).ids)

    if not plain:
        return slow
    special, sign = {t["content"] for t in spec.get("added_tokens", [])}, byte_of_sign()
    ranks = {bytes(sign[c] for c in token): k for token, k in vocab.items() if token not in special}
    encode = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda text: slow(text) if len(text) >= 100_000 and LONG_SPACE.search(text) else array("I", encode(text))
