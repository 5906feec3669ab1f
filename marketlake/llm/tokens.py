"""Token ids by a file of the tokenizers library, with a bounded memory of words.

A byte-level tokenizer without a normalizer never joins across a single space between two
characters that are no white space. Texts are cut there, and a word seen before takes its
ids from memory. Other tokenizers, and texts that hold the string of an added token, are
encoded whole. The ids are those of ``encode(text, add_special_tokens=False)`` either way.
A line feed between two such characters is a token of its own, so texts are cut there too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
from tokenizers import Tokenizer

REMEMBERED = 300_000
LONG = 1 << 20
CUT = re.compile(r"(?<=\S) (?=\S)")
OTHER_SPACE = re.compile(r"[^\S \n]")


def _smooth(text: str) -> bool:
    """True if every space stands between two characters that are no white space."""
    return not (
        "  " in text
        or " \n" in text
        or "\n " in text
        or text[:1] == " "
        or text[-1:] == " "
        or OTHER_SPACE.search(text)
    )


def _byte_signs() -> dict[int, str]:
    """How a byte-level vocabulary writes bytes: printable ones as they are, others moved."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(moved)}


class Memory(dict):
    """Ids of words behind a lead (a space or nothing), in two generations of bounded size."""

    def __init__(self, lead: str, tokenizer: Tokenizer, size: int, bare: Memory | None = None):
        super().__init__()
        self.size = size
        self.lead, self.old, self.ends = lead, {}, {}
        self.bare = self if bare is None else bare
        self.merge = tokenizer.model.tokenize
        self.codes = [pack("<I", i) for i in range(max(tokenizer.get_vocab().values()) + 1)]
        self.split = tokenizer.pre_tokenizer.pre_tokenize_str
        self.signs = _byte_signs()
        self.sign = self.signs[32] if lead else ""

    def __missing__(self, word: str) -> bytes:
        if "\n" in word:
            # a single line feed is a token of its own, and a word after it has no lead; such
            # a pair of words is hardly seen again and not kept
            head, *rest = parts = word.split("\n")
            if all(p and p == p.strip() for p in parts):
                return self[head] + b"".join([self._end("\n") + self.bare[w] for w in rest])
        ids = self.old.get(word)
        if ids is None:
            core = word.rstrip(".,")
            if len(core) < len(word) and core.isalpha():  # letters, then a run of points: two parts
                seen = core in self
                ids = self[core] + self._end(word[len(core) :])
                if not seen:  # a rare word is hardly seen again with the same points
                    return ids
            else:
                ids = self._made(word)
        self[word] = ids
        return ids

    def _made(self, word: str) -> bytes:
        if word.isalpha():
            signs = word if word.isascii() else word.encode().decode("latin-1").translate(self.signs)
            codes = self.codes
            return b"".join([codes[t.id] for t in self.merge(self.sign + signs)])
        tokens = [t for part, _ in self.split(self.lead + word) for t in self.merge(part)]
        return pack(f"<{len(tokens)}I", *[t.id for t in tokens])

    def _end(self, signs: str) -> bytes:
        """Ids of a run of points, or of the line feed."""
        if signs not in self.ends:
            tokens = self.merge(self.signs[10] if signs == "\n" else signs)
            self.ends[signs] = pack(f"<{len(tokens)}I", *[t.id for t in tokens])
        return self.ends[signs]

    def trim(self) -> None:
        if len(self) > self.size:
            self.old = dict(self)
            self.clear()
            self.ends.clear()


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.whole = Tokenizer.from_file(path)
        before = self.whole.pre_tokenizer
        self.cuts = (
            self.whole.normalizer is None
            and type(before).__name__ == "ByteLevel"
            and not before.add_prefix_space
            and before.use_regex
        )
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        if self.cuts:
            self.bare = Memory("", self.whole, remembered)
            self.spaced = Memory(" ", self.whole, remembered, self.bare)

    def _slices(self, text: str) -> Iterator[str]:
        """Parts of a long text, cut where words end; each but the first lost its space."""
        at = 0
        while len(text) - at > LONG:
            cut = CUT.search(text, at + LONG)
            if cut is None:
                break
            yield text[at : cut.start()]
            at = cut.end()
        yield text[at:]

    def encode(self, text: str | None) -> bytes:
        text = text or ""
        if not self.cuts or any(a in text for a in self.added):
            ids = self.whole.encode(text, add_special_tokens=False).ids
            return np.array(ids, "<u4").tobytes()
        self.bare.trim()
        self.spaced.trim()
        out, first = [], self.bare
        for part in self._slices(text):
            words = part.split(" ") if _smooth(part) else CUT.split(part)
            out += [first[words[0]], *map(self.spaced.__getitem__, words[1:])]
            first = self.spaced
        return b"".join(out)


@lru_cache(maxsize=2)
def encoder(path: str, remembered: int = REMEMBERED) -> Encoder:
    """One encoder per worker process, file and size of the memory of words."""
    return Encoder(path, remembered)
