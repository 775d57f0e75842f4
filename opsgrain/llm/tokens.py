"""Token ids of texts, equal to those of the tokenizers library and several times faster on prose.

The library spends its time on alignments that nobody reads here. Texts made of ASCII, Latin-1 and
Latin Extended-A characters are cut into words as the vocabulary's own pattern cuts them, each distinct word
is encoded by the library's model once, and the ids of words seen before come from a bounded table.
All other texts go through the library whole, and so do those that hold the string of an added token, which the
library gives that token's id.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Units whose ids are held, about.
KEPT = 600_000
_RANGE = [chr(c) for c in (9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x180)) if c not in (0x130, 0x17F)]
_LETTERS = re.escape("".join(c for c in _RANGE if unicodedata.category(c)[0] == "L"))
_NUMBERS = re.escape("".join(c for c in _RANGE if unicodedata.category(c)[0] == "N"))
_OTHER = re.compile(f"[^{re.escape(''.join(_RANGE))}]")
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
_SPACED = re.compile(rf"{_SHORT}| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^\s{_LETTERS}{_NUMBERS}]+|\s+(?!\S)|\s+")
_UNSPACED = re.compile(rf"{_SHORT}|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")
#: Control characters, which no plain text holds, before a text's first unit and a line's first unit.
_FIRST, _LINE = "\x02", "\x01"
#: Runs of white space that the pattern takes as one; all others fall apart into single characters.
_RUNS = [a + b + c for a in " \n" for b in " \n" for c in " \n"] + ["\t", "\r"]


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Table(dict):
    """A bounded table that makes missing values; a full one is emptied."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        if len(self) >= KEPT // 6:
            self.clear()
        self[key] = ids = self.make(key)
        return ids


class _Known:
    """The ids of units met before, as arrays; once there are over :data:`KEPT`, those of the last batch are kept."""

    def __init__(self, make):
        self.make, self.units = make, pa.array([], pa.large_string())
        self.sizes, self.flat = np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def ids(self, units: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, and of each of the distinct ``units`` where its own begin and how many they are."""
        at = pc.fill_null(pc.index_in(units, value_set=self.units), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = units.take(pa.array(new))
            # one text of all of them, split again: units hold no space
            one = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(fresh)], pa.int32()), fresh), pa.scalar(" ", pa.large_string()))
            values = list(map(self.make, one[0].as_py().split(" ")))
            at[new] = len(self.units) + np.arange(len(new))
            self.units = pa.concat_arrays([self.units, fresh])
            self.sizes = np.concatenate((self.sizes, np.fromiter(map(len, values), np.int32, len(values)) // 4))
            self.flat = np.concatenate((self.flat, np.frombuffer(b"".join(values), np.uint32)))
        starts = np.cumsum(self.sizes, dtype=np.int64) - self.sizes
        flat, starts, sizes = self.flat, starts[at], self.sizes[at]
        if len(self.units) > KEPT:
            ends = np.cumsum(sizes, dtype=np.int64)
            self.units, self.sizes = units, sizes
            self.flat = flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1])]
        return flat, starts, sizes


class Encoder:
    """Encodes batches of texts; ids are unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self._tokenize, self._letters = self.library.model.tokenize, _byte_letters()
        self._space, self._line = self._letters[32], self._letters[10]
        added = [t.content.lower() for t in self.library.get_added_tokens_decoder().values()]
        self._added = re.compile("|".join(map(re.escape, added)), re.I) if added else None
        self._marks = sorted({x[:2] for x in added})
        self._lowered = self.library.normalizer is not None  # and white space only divides
        self._units = _Known(self._unit)
        self._words = _Table(self._piece if self._lowered else self._word)
        self._pieces = _Table(self._piece)

    def _ids(self, piece: str) -> bytes:
        return array("I", [t.id for t in self._tokenize(piece)]).tobytes()

    def _word(self, word: str) -> bytes:
        """The ids of letters after a space."""
        return self._ids(self._space + (word if word.isascii() else word.encode().decode("latin-1").translate(self._letters)))

    def _piece(self, piece: str) -> bytes:
        if piece.isascii():
            return self._ids(piece.replace(" ", self._space).replace("\n", self._line))
        return self._ids(piece.encode().decode("latin-1").translate(self._letters))

    def _unit(self, unit: str) -> bytes:
        """The ids of what stands between two spaces, with the space or line end before it."""
        if unit.isalpha():
            return self._words[unit]  # also looked up with a sign after it
        if unit[:-1].isalpha() and unit[-1] in ".,":
            return self._words[unit[:-1]] + self._pieces[unit[-1]]
        if self._lowered:
            return self._joined(_UNSPACED, unit)
        if unit[:1] == _LINE and unit[1:].isalpha():
            return self._pieces["\n"] + self._pieces[unit[1:]]
        unit = "\n" + unit[1:] if unit[:1] == _LINE else unit[1:] if unit[:1] == _FIRST else " " + unit
        return self._joined(_SPACED, unit)

    def _joined(self, pattern: re.Pattern, unit: str) -> bytes:
        return b"".join(map(self._pieces.__getitem__, pattern.findall(unit)))

    def _plain(self, text: str) -> bool:
        """Whether the ids of the text are those of its units, one after the other."""
        if _OTHER.search(text) or any(m in text for m in self._marks) and self._added.search(text):
            return False
        return self._lowered or not (text[-2:].isspace() or any(run in text for run in _RUNS))

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text's begin, with the end of the last."""
        texts = [text or "" for text in texts]
        plain = [self._plain(text) for text in texts]
        column = pa.array([text if ok else "" for text, ok in zip(texts, plain, strict=True)], pa.large_string())
        if self._lowered:
            parts = pc.utf8_split_whitespace(pc.utf8_lower(column))
        else:
            marked = pc.replace_substring(column, "\n", " " + _LINE)
            parts = pc.split_pattern(pc.binary_join_element_wise(pa.scalar(_FIRST, pa.large_string()), marked, pa.scalar("", pa.large_string())), " ")
        coded = parts.values.dictionary_encode()
        codes, units = coded.indices.to_numpy(), coded.dictionary
        flat, starts, sizes = self._units.ids(units)
        if not all(plain):  # each other text is one more unit
            whole = [self.library.encode(text, add_special_tokens=False).ids for text, ok in zip(texts, plain, strict=True) if not ok]
            more = np.array([len(x) for x in whole], np.int32)
            starts = np.concatenate((starts, len(flat) + np.cumsum(more, dtype=np.int64) - more))
            flat = np.concatenate((flat, *(np.array(x, np.uint32) for x in whole)))
            sizes = np.concatenate((sizes, more))
        bounds = parts.offsets.to_numpy().astype(np.int64)
        if not all(plain):
            other = np.flatnonzero(~np.array(plain))
            codes = np.insert(codes, bounds[other + 1], len(units) + np.arange(len(other), dtype=codes.dtype))
            bounds = bounds + np.concatenate(([0], np.cumsum(~np.array(plain))))
        each = sizes[codes]
        ends = np.concatenate(([0], np.cumsum(each, dtype=np.int64)))
        kind = np.int32 if max(ends[-1], len(flat)) < 1 << 31 else np.int64
        ids = flat[np.repeat(starts.astype(kind)[codes] - ends[:-1].astype(kind), each) + np.arange(ends[-1], dtype=kind)]
        del column, parts, coded, units, codes, starts
        pa.default_memory_pool().release_unused()
        return ids, ends[bounds]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The encoder of this Python worker."""
    return Encoder(path)


def public(name: str) -> str:
    """The path of one of the installed vocabularies."""
    import public_tokenizers

    return public_tokenizers.path(name)
