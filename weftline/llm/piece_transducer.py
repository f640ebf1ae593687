"""Piece encoding and decoding as shortest paths of weighted finite-state transducers.

Compiled from a SentencePiece model file:

* Normaliser: a transducer over a character trie. At each place it reads the longest key of the
  model's character map and writes its replacement, or copies a character; spaces are squeezed
  and one is put in front if the model says so, and each becomes U+2581.
* Pieces: a trie whose arcs read a piece's characters and write its id, with a weight of minus the
  piece's score; user-defined pieces weigh less than any path around them.
* Fallback: an arc for each character that is no piece, which writes its bytes or the unknown id.

An input is composed with them place by place. ``shortest_path`` finds the path of least weight in
the tropical semiring (weights of a path add up, of two paths the lesser counts), over pairs of a
place and a state, for both kinds of model:

* Unigram models have one state, so the path is the most probable segmentation.
* Merge (BPE) models have the last piece as state. The model merges the best-scored neighbours
  first, which no weights by piece alone give. But a sequence of pieces is the merge result exactly
  if each two neighbours are what their own text merges to. So an arc to a piece weighs infinity,
  the semiring's zero, where that fails, and the one path of finite weight is the encoding.

No piece holds certain pairs of characters, so no arc of the composition crosses them, and the
shortest path is that of the parts in between. Parts recur: Arrow finds the distinct ones of a
slice of texts, a bounded cache of the worker keeps their paths, and a text's ids are gathered.

Defined results: null or empty text has no pieces; a literal U+2581 decodes as a space; rows that
repeat an id or have a null one are encoded each; an empty table gives an empty result; other
columns are ignored. Of paths of equal weight the one whose last piece begins first is taken; weights
add up in double precision.
"""

from __future__ import annotations

import math
import struct
import zlib
from array import array
from collections.abc import Iterator
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import text_column
from weftline.llm.token_cache import SEP, Kept, gathered, slices, strings

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, OWN, BYTE = 1, 2, 3, 4, 6
UNIGRAM, MERGES = 1, 2
START = ""  # state before the first piece
COLUMNS = "doc_id long, n_pieces long, n_bytes long, ids_crc32 long, cost double, round_trip boolean"


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = raw[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The (number, value) pairs of a protocol-buffer message."""
    at = 0
    while at < len(raw):
        key, at = _varint(raw, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(raw, at)
        elif kind == 2:
            size, at = _varint(raw, at)
            value, at = raw[at : at + size], at + size
        else:
            size = {1: 8, 5: 4}[kind]
            value, at = raw[at : at + size], at + size
        yield key >> 3, value


class PieceModel:
    """What a model file says: pieces, scores, kinds and the normaliser's switches."""

    def __init__(self, raw: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.kind, self.byte_fallback, self.map = UNIGRAM, False, b""
        self.dummy_prefix, self.squeeze, self.escape = True, True, True
        suffix = False
        for number, value in _fields(raw):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                spec = dict(_fields(value))
                self.kind, self.byte_fallback, suffix = spec.get(3, UNIGRAM), bool(spec.get(35, 0)), bool(spec.get(24, 0))
            elif number == 3:
                spec = dict(_fields(value))
                self.dummy_prefix, self.squeeze, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
                self.map = spec.get(2, b"")
        if self.kind not in (UNIGRAM, MERGES) or not self.escape or suffix:
            raise ValueError("unigram and merge models that escape spaces and put them in front are supported")
        if set(self.kinds) - {NORMAL, UNKNOWN, CONTROL, OWN, BYTE}:
            raise ValueError("unused pieces are not supported")


def character_map(blob: bytes) -> dict[str, str]:
    """Keys and replacements of a compiled character map: the size of a double-array trie, its
    units (32 bits, little-endian), then the replacements, each ended by a zero byte.

    A unit holds its label in the low byte, whether a value follows in bit 8, and its offset in
    the bits from 10 on, times 256 if bit 9 is set; the value unit's low 31 bits are the place
    of the replacement."""
    if not blob:
        return {}
    size = struct.unpack_from("<I", blob)[0]
    units, texts = np.frombuffer(blob, "<u4", size // 4, 4).tolist(), blob[4 + size :]
    out: dict[str, str] = {}

    def children(at: int) -> int:
        unit = units[at]
        return at ^ ((unit >> 10) << (8 if unit >> 9 & 1 else 0))

    stack = [(0, b"")]
    while stack:
        at, key = stack.pop()
        base = children(at)
        if units[at] >> 8 & 1:
            place = units[base] & 0x7FFFFFFF
            out[key.decode()] = texts[place : texts.index(b"\0", place)].decode()
        for label in range(1, 256):
            to = base ^ label
            if to < len(units) and units[to] & 0x800000FF == label:
                stack.append((to, key + bytes([label])))
    return out


def trie_of(entries: dict[str, object]) -> dict:
    """Nested dicts by character; what a key stands for lies under the empty string."""
    root: dict = {}
    for key, value in entries.items():
        node = root
        for c in key:
            node = node.setdefault(c, {})
        node[""] = value
    return root


def arcs_of(trie: dict) -> dict[str, tuple[dict | None, object]]:
    """The same trie by character as what lies below (None: nothing) and what the key stands for."""
    return {c: (arcs_of(node) or None, node.get("")) for c, node in trie.items() if c}


def longest(trie: dict, text: str, at: int) -> tuple[int, object]:
    """Where the longest key at a place ends and what it stands for; (at, None) without one."""
    node, found = trie, (at, None)
    for i in range(at, len(text)):
        node = node.get(text[i])
        if node is None:
            break
        if "" in node:
            found = i + 1, node[""]
    return found


class Transducer:
    """Normaliser, pieces and fallback of one model, compiled."""

    def __init__(self, model: PieceModel, most_states: int = 100_000):
        self.model, self.merging, self.most_states = model, model.kind == MERGES, most_states
        kinds = list(enumerate(zip(model.pieces, model.kinds, strict=True)))
        self.ids = {p: i for i, (p, k) in kinds if k in (NORMAL, OWN)}
        self.own = [p for _, (p, k) in kinds if k == OWN]
        self.unknown = model.kinds.index(UNKNOWN)
        self.bytes = {int(p[1:-1], 16): i for i, (p, k) in kinds if k == BYTE}
        self.score = {p: model.scores[i] for p, i in self.ids.items()}
        normal = [model.scores[i] for i, (_, k) in kinds if k == NORMAL]
        # An unspelt character costs more than any piece, a user-defined piece less than its
        # characters, as in the public unigram encoder.
        self.unknown_cost = 10.0 - min(normal, default=0.0)
        if not self.merging:
            self.score |= {p: len(p) * max(normal, default=0.0) - 0.1 for p in self.own}
        self.trie = arcs_of(trie_of({p: (p, -self.score[p]) for p in self.ids}))
        self.own_trie = trie_of({p: p for p in self.own})
        self.map = character_map(model.map)
        self.map_trie = trie_of(self.map)
        self.pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.spelt = {c for p in self.ids for c in p}
        self.known: dict[str, dict[str, bool]] = {}

    # The normaliser.

    def mapped(self, text: str) -> Iterator[str]:
        """What the character map makes of a text, one read key or character at a time."""
        at = 0
        while at < len(text):
            end, kept = longest(self.own_trie, text, at)
            if kept is None:
                end, kept = longest(self.map_trie, text, at)
            if kept is None:
                end, kept = at + 1, text[at]
            yield kept
            at = end

    def normalise(self, text: str) -> str:
        model = self.model
        parts = self.mapped(text) if self.map or self.own else iter(text)
        if not model.squeeze:
            whole = "".join(parts)
            return (" " * model.dummy_prefix + whole).replace(" ", SPACE) if whole or text else ""
        out, spaced = [], True  # no space at the start or after another
        for part in parts:
            kept = part.lstrip(" ") if spaced else part
            if kept:
                out.append(kept)
                spaced = kept.endswith(" ")
        whole = "".join(out).replace(" ", SPACE)
        return (SPACE * model.dummy_prefix + whole).rstrip(SPACE) if whole else ""

    # Pieces.

    def merge(self, text: str) -> list[str]:
        """Merge the best-scored neighbouring pair, the leftmost of equals, until none is a piece."""
        parts, get, none = list(text), self.score.get, -math.inf
        scores = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while scores and (best := max(scores)) > none:
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = get(parts[at - 1] + parts[at], none)
            if at < len(scores):
                scores[at] = get(parts[at] + parts[at + 1], none)
        return parts

    def zero(self, state: str, piece: str) -> bool:
        """Whether the arc that reads ``piece`` out of ``state`` weighs infinity: not what the two
        texts merge to."""
        return self.merging and self.merge(state + piece) != ([state, piece] if state else [piece])

    def zeros(self, state: str) -> dict[str, bool]:
        """What is known of the arcs out of a state."""
        if len(self.known) >= self.most_states:
            self.known.clear()
        return self.known.setdefault(state, {})

    def arcs(self, text: str, at: int, state: str, zeros: dict[str, bool]) -> list[tuple[int, str, float]]:
        """What the composition can read at a place out of a state: where it ends, the piece, minus
        its score. Arcs of weight infinity are left out."""
        found, end, n, out = self.trie.get(text[at]), at, len(text), []
        if found is None or found[1] is None:
            zero = zeros.get(text[at])
            if zero is None:
                zero = zeros[text[at]] = self.zero(state, text[at])
            if not zero:
                out.append((end + 1, text[at], self.unknown_cost))
        while found is not None:
            end += 1
            below, held = found
            if held is not None:
                piece, cost = held
                zero = zeros.get(piece)
                if zero is None:
                    zero = zeros[piece] = self.zero(state, piece)
                if not zero:
                    out.append((end, piece, cost))
            if below is None or end == n:
                break
            found = below.get(text[end])
        return out

    def shortest_path(self, text: str) -> tuple[list[str], float]:
        """Pieces and weight of the best path through the composition with a text."""
        n, merging, known = len(text), self.merging, self.known
        # By place and state: the least weight to get there, and the place, state and piece before.
        reached: list[dict[str, tuple] | None] = [None] * (n + 1)
        reached[0] = {START: (0.0, 0, START, START)}
        for at in range(n):
            here = reached[at]
            if here is None:
                continue
            for state, back in here.items():
                total, zeros = back[0], known.get(state)
                if zeros is None:
                    zeros = self.zeros(state)
                for end, piece, cost in self.arcs(text, at, state, zeros):
                    there, to, new = reached[end], piece if merging else START, total + cost
                    if there is None:
                        reached[end] = {to: (new, at, state, piece)}
                    elif to not in there or new < there[to][0]:
                        there[to] = (new, at, state, piece)
        last = reached[n]
        best = min(last, key=lambda s: last[s][0])
        pieces, at, state, total = [], n, best, last[best][0]
        while at:
            _, at, state, piece = reached[at][state]
            pieces.append(piece)
        return pieces[::-1], total

    def parts(self, text: str) -> list[str]:
        """A text cut wherever no arc crosses: between characters that no piece joins, and around
        user-defined pieces of merge models."""
        if self.own and self.merging:
            out, at, held = [], 0, ""
            while at < len(text):
                end, kept = longest(self.own_trie, text, at)
                if kept is None:
                    held, at = held + text[at], at + 1
                else:
                    out, held, at = [*out, *self.joined(held), kept], "", end
            return out + self.joined(held)
        return self.joined(text)

    def joined(self, text: str) -> list[str]:
        pairs, out, start = self.pairs, [], 0
        if text and pairs.issuperset(map(add, text, text[1:])):
            return [text]
        for i in range(1, len(text)):
            if text[i - 1 : i + 1] not in pairs:
                out.append(text[start:i])
                start = i
        return [*out, text[start:]] if text else out

    def piece_ids(self, piece: str) -> list[int]:
        if piece in self.ids:
            return [self.ids[piece]]
        if self.model.byte_fallback:
            return [self.bytes[b] for b in piece.encode()]
        return [self.unknown]

    # Decoding.

    def decoded(self, ids: list[int], lead: bool = False) -> str:
        """Pieces back to normalised text; runs of byte pieces are read as UTF-8. With ``lead`` the
        space that the normaliser put in front goes; all of them where it squeezes."""
        out, pending, model = [], bytearray(), self.model
        lead = lead and (model.dummy_prefix or model.squeeze)
        for i in ids:
            kind = model.kinds[i]
            if kind == BYTE:
                pending.append(int(model.pieces[i][1:-1], 16))
                continue
            if pending:
                out.append(pending.decode(errors="replace"))
                pending = bytearray()
            piece = " ⁇ " if kind == UNKNOWN else "" if kind == CONTROL else model.pieces[i]
            if lead and piece and not any(out):
                first, piece = piece[0] == SPACE, piece.removeprefix(SPACE)
                lead = not first or model.squeeze
            out.append(piece)
        out.append(pending.decode(errors="replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        return self.decoded(ids, lead=True).replace(SPACE, " ")


class Encoder:
    """Whole texts through the transducer; paths of words and of their parts are kept."""

    def __init__(self, raw: bytes):
        self.machine = Transducer(PieceModel(raw))
        self.paths, self.words = Kept(self.path, 700_000), Kept(self.word, 400_000)
        model, pairs = self.machine.model, self.machine.pairs
        #: Spaces and line ends are cut in Arrow, where no piece but a run of spaces crosses them.
        plain = not any(p[1] == SPACE != p[0] for p in pairs) and not any("\n" in p for p in pairs)
        self.simple = plain and not model.squeeze and not self.machine.map and not self.machine.own
        self.byte_ids = set(self.machine.bytes.values())
        #: What a piece decodes to by itself, where no piece beside it matters.
        self.spelling = [p if k in (NORMAL, OWN) else None for p, k in zip(model.pieces, model.kinds, strict=True)]
        #: A single unknown id stands for unspelt neighbours, so words must not be taken apart.
        self.fused = not model.byte_fallback

    def path(self, part: str) -> tuple[bytes, float]:
        """Ids and weight of a part's shortest path."""
        machine = self.machine
        if machine.merging and part in machine.own:
            return array("I", [machine.ids[part]]).tobytes(), -machine.score[part]
        pieces, cost = machine.shortest_path(part)
        return array("I", [i for x in pieces for i in machine.piece_ids(x)]).tobytes(), cost

    def word(self, word: str) -> tuple[bytes, int, float, bool]:
        """Ids, byte pieces, weight and whether the ids decode to the word again."""
        ids, cost = self.encoded(word)
        spelt = [self.spelling[i] for i in ids]
        whole = None in spelt
        text = self.machine.decoded(ids) if whole else "".join(spelt)
        return array("I", ids).tobytes(), self.unspelt(ids) if whole else 0, cost, text == word

    def unspelt(self, ids: list[int]) -> int:
        return sum(i in self.byte_ids for i in ids)

    def encoded(self, normal: str) -> tuple[list[int], float]:
        parts = self.machine.parts(normal)
        if len(parts) == 1 and not self.fused:
            raw, cost = self.paths[parts[0]]
            return array("I", raw).tolist(), cost
        found = [self.paths[x] for x in parts]
        ids = array("I", b"".join([f[0] for f in found])).tolist()
        if self.fused:
            unknown = self.machine.unknown
            ids = [i for k, i in enumerate(ids) if i != unknown or not k or ids[k - 1] != unknown]
        return ids, sum(f[1] for f in found)

    def encode(self, text: str) -> tuple[list[int], float]:
        return self.encoded(self.machine.normalise(text))

    def decode(self, ids: list[int]) -> str:
        return self.machine.decode(ids)

    def cut(self, texts: pa.Array) -> pa.ListArray:
        """The words of each text, normalised: cut at line ends and before a space that begins a
        word; a run of spaces stays with the word after it."""
        front = SPACE if self.machine.model.dummy_prefix else ""
        spaced = pc.replace_substring(texts, " ", SPACE)
        spaced = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(pa.scalar(front), spaced, ""))
        spaced = pc.replace_substring(spaced, "\n", f"{SEP}\n{SEP}")
        return pc.split_pattern(pc.replace_substring_regex(spaced, f"({SPACE}+)", rf"{SEP}\1"), SEP)

    def digests(self, texts: pa.Array) -> Iterator[list]:
        """Pieces, byte pieces, CRC-32 of the ids, weight and round trip of each text, by slices
        and as columns."""
        for _, part in slices(texts):
            if not self.simple or pc.any(pc.match_substring(part, SEP)).as_py():
                yield [list(c) for c in zip(*map(self.digest, part.to_pylist()), strict=True)]
                continue
            lists = self.cut(part)
            coded = lists.flatten().dictionary_encode()
            found = [self.words[w] for w in strings(coded.dictionary, SEP)]
            at, edges = coded.indices.to_numpy(), lists.offsets.to_numpy()
            edges = edges - edges[0]
            ids, ends = gathered([f[0] for f in found], np.dtype("<u4"), at)
            upto = np.concatenate([[0], ends])[edges]
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
            sums = [np.add.reduceat(np.append(np.array([f[k] for f in found])[at], 0), edges[:-1]) for k in (1, 2)]
            broken = np.add.reduceat(np.append(np.array([not f[3] for f in found], np.int64)[at], 0), edges[:-1])
            yield [np.diff(upto), sums[0], crc, sums[1].astype(float), broken == 0]

    def digest(self, text: str) -> tuple[int, int, int, float, bool]:
        """The same of one text."""
        ids, cost = self.encode(text)
        return len(ids), self.unspelt(ids), zlib.crc32(np.array(ids, "<u4")), float(cost), self.decode(ids) == text.replace(SPACE, " ")


_WORKER: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    if path not in _WORKER:
        with open(path, "rb") as f:
            _WORKER[path] = Encoder(f.read())
    return _WORKER[path]


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """Counts, id checksum, path weight and round trip of every document's pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = encoder(model)
        names = [x.split()[0] for x in COLUMNS.split(", ")]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_())
        for batch in batches:
            row = 0
            for columns in use.digests(batch.column(1)):
                n = len(columns[0])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)
                row += n

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    return texts.mapInArrow(run, COLUMNS)


def encode_ids(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, ids`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = encoder(model)
        for batch in batches:
            ids = pa.array([use.encode(t.as_py())[0] for t in batch.column(1)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    return texts.mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(rows: DataFrame, model: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = encoder(model)
        for batch in batches:
            texts = pa.array([use.decode(x.as_py() or []) for x in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
