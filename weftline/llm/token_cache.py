"""Exact whole-text encoding: parts are found in Arrow, each distinct part is encoded once.

Both kinds of vocabulary here cut a text into pieces before merging bytes, so a text may be cut
where a piece is bound to end, and its ids are those of its parts in order. Cuts are made at line
ends, before spaces and between a letter and one of ``MARKS``; Arrow makes them for a whole slice
of texts, ``dictionary_encode`` leaves the slice's distinct parts, and their ids are gathered by
numpy. Ids of a part come from a bounded cache of the worker or from the tokenizers library: its
merge model for plain letters, its whole pipeline for other parts. What the cache holds never
changes a result.

A run of white space is one piece but for its last character. So runs of two are cut as well as
lone spaces, but a text with longer runs, with a run at its end or with white space beyond the
ASCII kinds is cut more carefully, and one that holds a special token's string is left whole to
the library, which gives that token's id.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer


_AFTER_SPACE = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S) ")
SEP = "\x1f"
#: Marks after a word's letters; no apostrophe, which can begin a contraction.
MARKS = ".,;:!?#*$%&|<>"
#: A letter that stays one letter in lower case, and a mark.
_LETTER_MARK = r"([\p{Ll}A-Z])([.,;:!?#*$%&|<>])"
_CAREFUL = r"\s\s\s|\s\s\z|[\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable Latin-1 bytes stand for themselves, the others
    follow from code point 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def slices(column: pa.Array, most_bytes: int = 8 << 20) -> Iterator[tuple[int, pa.Array]]:
    """Parts of a column of texts, of about ``most_bytes`` or a single text, with their first row."""
    sizes = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(column):
        upto = (sizes[start - 1] if start else 0) + most_bytes
        end = max(start + 1, int(np.searchsorted(sizes, upto, side="right")))
        yield start, column.slice(start, end - start)
        start = end


def strings(column: pa.Array, sep: str) -> list[str]:
    """The strings of a column (none null, none with ``sep``), by one conversion."""
    if not len(column):
        return []
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column), sep)[0].as_py().split(sep)


def gathered(found: list[bytes], code: np.dtype, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries ``at`` of a list of coded ids one after another, and where each ends."""
    size = np.fromiter(map(len, found), np.int64, len(found)) // code.itemsize
    start = np.cumsum(size) - size
    pool = np.frombuffer(b"".join(found), code)
    n = size[at]
    ends = np.cumsum(n)
    place = np.repeat(start[at] - (ends - n), n)
    place += np.arange(len(place))
    return pool[place], ends


class Kept(dict):
    """Values that ``make(key)`` gives, in two generations, so that frequent keys outlive a full cache."""

    def __init__(self, make: Callable, entries: int):
        super().__init__()
        self.make, self.half, self.older = make, max(1, entries // 2), {}

    def __missing__(self, key: str):
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.half:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found

    def many(self, keys: list[str], make: Callable) -> list:
        """The values of different keys; ``make`` gives those of all that are not held at once."""
        found = list(map(self.get, keys))
        held = [i for i, x in enumerate(found) if x is None]
        if not held:
            return found
        older = list(map(self.older.get, [keys[i] for i in held]))
        made = iter(make([keys[i] for i, x in zip(held, older, strict=True) if x is None]))
        for i, x in zip(held, older, strict=True):
            found[i] = next(made) if x is None else x
        new = {keys[i]: found[i] for i in held if len(keys[i]) <= 64}
        if self and len(self) + len(new) > self.half:
            self.older = dict(self)
            self.clear()
        self.update(new)
        return found


class CachedTokenizer:
    """``encode_all(texts)`` gives the ids of each text as arrays of ``dtype``."""

    def __init__(self, path: str, entries: int = 600_000):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.lower = spec["normalizer"] is not None  # lower case, white space dropped
        known = {"Sequence", "ByteLevel"}
        if spec["pre_tokenizer"]["type"] not in known or spec["model"]["type"] != "BPE":
            raise ValueError(f"{path}: not a byte-level merge vocabulary")
        self.special = [t["content"] for t in spec["added_tokens"]]
        small = self.tokenizer.get_vocab_size() <= 1 << 16
        self.dtype, self.code = np.dtype("<u2" if small else "<u4"), "H" if small else "I"
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.parts = Kept(self.make, entries)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def merged(self, letters: str) -> bytes:
        return array(self.code, [t.id for t in self.model.tokenize(letters)]).tobytes()

    def make(self, part: str) -> bytes:
        if not part:
            return b""
        space = not self.lower and part[0] == " "
        word = part[1:] if space else part
        if not word.isalpha():
            return self.whole(part)
        if word.isascii():
            return self.merged("\u0120" + word if space else word.lower() if self.lower else word)  # the byte alphabet's space
        if self.lower:
            word = "".join(c.lower() for c in unicodedata.normalize("NFC", word))
            if not word.isalpha():
                return self.whole(part)
        return self.merged((" " * space + word).encode().decode("latin-1").translate(self.letters))

    def make_all(self, parts: list[str]) -> list[bytes]:
        if self.lower:
            return [self.make(x) for x in parts]
        tokenize, code, out = self.model.tokenize, self.code, []
        for x in parts:
            if x.isascii() and (x.isalpha() or x[:1] == " " and x[1:].isalpha()):
                out.append(array(code, [t.id for t in tokenize(x.replace(" ", "\u0120"))]).tobytes())  # as in ``make``
            else:
                out.append(self.make(x))
        return out

    def careful(self, text: str) -> np.ndarray:
        """One text, cut only where a space follows a non-space."""
        if any(x in text for x in self.special):
            return np.frombuffer(self.whole(text), self.dtype)
        parts = _CUT.split(text) if _AFTER_SPACE.search(text) else text.split(" ")
        space = "" if self.lower else " "
        found = [self.whole(parts[0]), *(self.parts[space + x] for x in parts[1:])]
        return np.frombuffer(b"".join(found), self.dtype)

    def cut(self, texts: pa.Array) -> pa.ListArray:
        if self.lower:
            texts = pc.replace_substring(pc.ascii_lower(texts), "\n", " ")
            return pc.split_pattern(pc.replace_substring_regex(texts, _LETTER_MARK, r"\1 \2"), " ")
        texts = pc.replace_substring_regex(texts, _LETTER_MARK, rf"\1{SEP}\2")
        texts = pc.replace_substring(pc.replace_substring(texts, "\n", f"{SEP}\n{SEP}"), " ", f"{SEP} ")
        return pc.split_pattern(texts, SEP)

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text (none null), in order."""
        for _, part in slices(texts):
            apart = pc.match_substring(part, self.special[0]) if self.special else pa.array(np.zeros(len(part), bool))
            for x in self.special[1:]:
                apart = pc.or_(apart, pc.match_substring(part, x))
            if not self.lower:
                apart = pc.or_(apart, pc.match_substring_regex(part, _CAREFUL))
            apart = apart.to_numpy(zero_copy_only=False)
            lists = self.cut(part.filter(pa.array(~apart)) if apart.any() else part)
            coded = lists.flatten().dictionary_encode()
            found = self.parts.many(strings(coded.dictionary, " " if self.lower else SEP), self.make_all)
            ids, ends = gathered(found, self.dtype, coded.indices.to_numpy())
            edges = lists.offsets.to_numpy()
            upto = np.concatenate([[0], ends])[edges - edges[0]].tolist()
            k = 0
            for i, other in enumerate(apart.tolist()):
                if other:
                    yield self.careful(part[i].as_py())
                else:
                    yield ids[upto[k] : upto[k + 1]]
                    k += 1

    def encode(self, text: str) -> bytes:
        return next(self.encode_all(pa.array([text], pa.string()))).tobytes()


_WORKER: dict[str, CachedTokenizer] = {}


def cached(path: str) -> CachedTokenizer:
    """One tokenizer for each worker process, kept from task to task."""
    if path not in _WORKER:
        _WORKER[path] = CachedTokenizer(path)
    return _WORKER[path]
