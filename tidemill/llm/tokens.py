"""Byte-level BPE ids of whole texts, by the tokenizers library, fast enough for skewed vocabularies.

A text splits safely before each space that does not follow white space, and before each line feed but in longer runs
of white space: no token of a byte-level BPE with the usual splitting pattern reaches over such a place. So the ids of
a text are the joined ids of its units. The units of a block of texts are told apart by Arrow, each worker asks the library only
for those that it has not met lately, and Arrow lays the ids out again in the order of the texts.
Texts with other white space or longer runs of it, units with letters outside the Latin blocks, and texts that hold the
characters of a special token go to the library whole, which gives such characters the special token's id.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex

BYTE_BPE = "byte_bpe_50k.json"
#: The splitting pattern of this family of tokenizers, as its files state it.
PATTERN = public_tokenizers.PATTERN
#: Stands before the first unit of a text, which no space precedes.
START = "\0"
BARE = (START, "\n")
#: White space that is neither a space nor a line feed; the first of it in ASCII.
OTHER_WHITE = re.compile(r"[^\S \n]")
ASCII_WHITE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
BEYOND_LATIN = re.compile("[^\x00-\u024f]")
MAX_UNITS, MAX_PIECES = 700_000, 150_000


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Encodes texts as bytes of little-endian unsigned 32-bit ids. Its caches are bounded and only save time."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split = regex.compile(PATTERN).findall
        self.letters = byte_letters()
        self.units: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.id_bytes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn_pieces(self, pieces: set[str]) -> None:
        known, tokenize, letters, raw = self.pieces, self.model.tokenize, self.letters, self.id_bytes
        space = letters[32]
        for p in pieces:
            shown = p.replace(" ", space) if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(letters)
            known[p] = b"".join([raw[t.id] for t in tokenize(shown)])

    def _learn_bare(self, units: list[str]) -> None:
        """Units without a space before them: after START, and after a line feed, whose id comes first."""
        feed = self.whole("\n")
        for u in units:
            rest, before = u[1:], feed if u[0] == "\n" else b""
            if BEYOND_LATIN.search(rest):
                self.units[u] = before + self.whole(rest)
            else:
                pieces = self.split(rest)
                self._learn_pieces(set(pieces).difference(self.pieces))
                self.units[u] = before + b"".join(map(self.pieces.__getitem__, pieces))

    def _learn(self, units: list[str]) -> None:
        joined = " " + " ".join(units)
        odd = BEYOND_LATIN.search(joined) is not None
        pieces = [] if odd else self.split(joined)
        # a piece that starts with a space starts a unit, unless white space stands at the end of units
        at = [i for i, p in enumerate(pieces) if p[0] == " "]
        if odd or len(at) != len(units):
            if len(units) == 1:
                self.units[units[0]] = self.whole(joined)
            else:  # halve until the odd units are alone
                self._learn(units[: len(units) // 2])
                self._learn(units[len(units) // 2 :])
            return
        self._learn_pieces(set(pieces).difference(self.pieces))
        ids = list(map(self.pieces.__getitem__, pieces))
        at.append(len(pieces))
        self.units.update(zip(units, [ids[a] if b - a == 1 else b"".join(ids[a:b]) for a, b in zip(at, at[1:])]))

    def spread(self, text: str) -> str | None:
        """The units of a text, parted by spaces; None if it must go to the library whole."""
        if any(c in text for c in ASCII_WHITE) if text.isascii() else OTHER_WHITE.search(text):
            return None
        out = START + text.replace("\n", " \n")  # a line feed starts a unit, as a space does
        if "  " in out or "\n " in text or "\n\n\n" in text or out.endswith("\n \n") or START in text or any(t in text for t in self.special):
            return None
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes."""
        if len(self.units) > MAX_UNITS:
            self.units = {}
        if len(self.pieces) > MAX_PIECES:
            self.pieces = {}
        spread = [self.spread(x) for x in texts]
        lists = pc.split_pattern(pa.array([x for x in spread if x is not None], pa.string()), " ")
        named = lists.flatten().dictionary_encode()
        names, known = named.dictionary.to_numpy(zero_copy_only=False).tolist(), self.units
        new = [u for u in names if u not in known]
        self._learn_bare([u for u in new if u[:1] in BARE])
        spaced = [u for u in new if u[:1] not in BARE]
        if spaced:
            self._learn(spaced)
        parts = list(map(known.__getitem__, names))
        ends = np.cumsum([0, *map(len, parts)], dtype=np.int32) // 4
        ids = pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(parts), dtype="<u4")).take(named.indices)
        flat = ids.flatten().to_numpy()
        starts = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(), dtype=np.int64)])[lists.offsets.to_numpy()].tolist()
        made = (flat[a:b].tobytes() for a, b in zip(starts, starts[1:]))
        return [self.whole(x) if y is None else next(made) for x, y in zip(texts, spread)]


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file; one for all its tasks."""
    return Encoder(path)


def encode_in_blocks(path: str, texts: list[str], most_chars: int = 3_000_000):
    """Yield (index of first text, ids of each) for blocks of texts of bounded size."""
    enc, start, size = encoder(path), 0, 0
    for i, x in enumerate(texts):
        size += len(x)
        if size >= most_chars:
            yield start, enc.encode(texts[start : i + 1])
            start, size = i + 1, 0
    if start < len(texts):
        yield start, enc.encode(texts[start:])
