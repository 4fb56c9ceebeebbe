"""Token ids of whole texts with a byte-level BPE vocabulary.

Byte-level BPE never merges across its pre-tokens, and a pre-token never spans
from one word into the next, so a text whose words are divided by single
spaces or single newlines has the concatenation of its words' ids (each word
with the space or newline before it).  Those words' ids are kept in a bounded
per-worker table; any text with other white space is encoded as a whole.
"""

from __future__ import annotations

import os
import re
from array import array

from .common import worker_state

#: where one word's tokens end and the next word's begin, whatever stands around
SEAM = re.compile(r"(?<=\S)(?=[ \n])")
TABLE_LIMIT = 1_000_000        # entries of the per-worker table (about 200 MB); emptied when full
SLICE_CHARS = 2_000_000        # texts are split into words in slices of about this size


class WordIds(dict):
    """word (with its leading newline, or standing for ' ' + word) -> ids as
    little-endian unsigned 32-bit integers; None for white space of other kinds."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.starts: dict[str, bytes] = {}
        self.marks = {c: self._whole(c) for c in ".,;:!?"}

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn(self, words: set[str]) -> None:
        if len(self) + len(words) > TABLE_LIMIT:
            self.clear()
            self.starts.clear()
        bare, marked = set(), []
        for w in words:
            if w[:1] != "\n" and w[-1:] in self.marks and w[:-1].isalpha():
                marked.append(w)
                if w[:-1] not in self:
                    bare.add(w[:-1])
            elif not w or w == "\n" or any(c.isspace() for c in w[1:]) or (w[0] != "\n" and w[0].isspace()):
                self[w] = None
            else:
                bare.add(w)
        bare = list(bare)
        found = self.tokenizer.encode_batch_fast([w if w[0] == "\n" else " " + w for w in bare],
                                                 add_special_tokens=False)
        self.update((w, array("I", e.ids).tobytes()) for w, e in zip(bare, found, strict=True))
        self.update((w, self[w[:-1]] + self.marks[w[-1]]) for w in marked)

    def _split(self, texts: list[str]) -> list[list[str]]:
        """Words of the texts, all of them learnt."""
        parts = [t.replace("\n", " \n").split(" ") for t in texts]
        unseen: set[str] = set()
        for p in parts:
            unseen.update(p[1:])
        unseen = {w for w in unseen if w not in self}
        if len(self) + len(unseen) > TABLE_LIMIT:       # starting afresh, learn all of this slice
            self.clear()
            self.starts.clear()
            for p in parts:
                unseen.update(p[1:])
        if unseen:
            self._learn(unseen)
        return parts

    def _slice(self, texts: list[str]) -> list[bytes]:
        parts = self._split(texts)
        out = []
        for text, p in zip(texts, parts, strict=True):
            first = self.starts.get(p[0])
            if first is None:
                if any(c.isspace() for c in p[0]):
                    out.append(self._whole(text))
                    continue
                if len(self.starts) >= TABLE_LIMIT:
                    self.starts.clear()
                first = self.starts[p[0]] = self._whole(p[0]) if p[0] else b""
            try:
                out.append(first + b"".join(map(self.__getitem__, p[1:])))
            except TypeError:                           # a None: unusual white space
                out.append(self._whole(text))
        return out

    def _units(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        out = []
        for text, p in zip(texts, self._split(texts), strict=True):
            first = self._whole(p[0])
            try:
                tokens = [len(first) // 4, *(len(self[w]) // 4 for w in p[1:])]
                chars = [len(p[0]), *(len(w) + (w[0] != "\n") for w in p[1:])]
                if any(c.isspace() for c in p[0]):
                    raise TypeError
            except TypeError:                           # unusual white space
                units = SEAM.split(text)
                tokens, chars = [len(b) // 4 for b in self.encode(units)], [len(u) for u in units]
            out.append((chars, tokens))
        return out

    def units(self, texts) -> list[tuple[list[int], list[int]]]:
        """For each text, the characters and the tokens of its runs between seams."""
        return [u for part in _slices(texts) for u in self._units(part)]

    def encode(self, texts) -> list[bytes]:
        return [ids for part in _slices(texts) for ids in self._slice(part)]


def _slices(texts):
    part, chars = [], 0
    for t in texts:
        part.append(t)
        chars += len(t)
        if chars >= SLICE_CHARS:
            yield part
            part, chars = [], 0
    if part:
        yield part


def word_ids(path: str) -> WordIds:
    """The worker's table for one vocabulary file."""
    return worker_state(f"word_ids:{path}", lambda: WordIds(path))


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)
