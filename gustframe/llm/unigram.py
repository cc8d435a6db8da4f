"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

``load_model`` reads pieces, scores and kinds from a SentencePiece model file on
the driver. A unigram model's scores are used as they are; the file of a BPE
model holds merge ranks instead, which become log probabilities by Zipf's law,
-log(rank + 1) - log(H). The pieces go into a double-array trie over their UTF-8
bytes; its three arrays (a few bytes a piece, so bounded by the vocabulary) are
handed to the tasks with the function.

A text is escaped (space to U+2581, one more in front) and cut before each run of
markers and around characters that no piece holds next to others; no piece
crosses such a cut, so the best path of the text is the best paths of the parts
one after the other. Parts repeat a lot: a task remembers about ``CACHE`` of them.
Within a part, Viterbi looks up all pieces that start at a character; short parts
go through it thousands at a time. A character without a piece costs the least
score minus 10 and becomes its bytes' pieces.

Decoding joins pieces and bytes and turns the marker back into a space, so every
text but one holding U+2581 itself (which the encoding can't tell from a space)
comes back unchanged.

Defined results: null and empty texts have no ids and decode to the empty text;
equal scores prefer the path whose last piece starts first; texts of any length
are encoded whole, in time linear in their length; repeated rows give equal rows;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType

from .common import map_arrow, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, BYTE, UNIGRAM = 1, 2, 6, 1
UNKNOWN_COST = 10.0
#: Parts remembered in a task, and the longest one to be remembered.
CACHE, LONGEST = 400_000, 64


@dataclass(frozen=True)
class Model:
    pieces: list  # bytes of each id
    scores: np.ndarray
    kinds: np.ndarray
    base: np.ndarray  # the double array
    check: np.ndarray
    value: np.ndarray  # id of the piece that ends at a node, or -1


def _fields(data: bytes):
    """(field number, value) of a protocol-buffer message."""
    def varint(i):
        out = shift = 0
        while True:
            b = data[i]
            out, shift, i = out | (b & 127) << shift, shift + 7, i + 1
            if b < 128:
                return out, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        if key & 7 == 0:
            v, i = varint(i)
        else:
            n, i = varint(i) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], i)
            v, i = data[i:i + n], i + n
        yield key >> 3, v


def read_pieces(path: str) -> tuple[list, bool]:
    """[(piece, score, kind)] and whether the scores are a unigram model's."""
    pieces, kind = [], UNIGRAM
    with open(path, "rb") as f:
        for number, v in _fields(f.read()):
            if number == 1:
                one = dict(_fields(v))
                pieces.append((one[1].decode(), struct.unpack("<f", one[2])[0] if 2 in one else 0.0, one.get(3, NORMAL)))
            elif number == 2:
                kind = dict(_fields(v)).get(3, UNIGRAM)
    return pieces, kind == UNIGRAM


def zipf(pieces: list) -> list:
    """Log probabilities of normal pieces from the order of their scores."""
    order = sorted((i for i, p in enumerate(pieces) if p[2] == NORMAL), key=lambda i: (-pieces[i][1], i))
    norm = math.log(sum(1 / (r + 1) for r in range(len(order))) or 1)
    score = {i: -math.log(r + 1) - norm for r, i in enumerate(order)}
    return [(p, score.get(i, s), k) for i, (p, s, k) in enumerate(pieces)]


def double_array(keys: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Base, check and value arrays of a trie over byte strings: the child of node
    n by byte b is base[n] + b, if its check is n. Node 0 is the root."""
    tree: list[dict] = [{}]
    ends: dict[int, int] = {}
    for key, v in keys.items():
        at = 0
        for b in key:
            at = tree[at].setdefault(b, len(tree))
            if at == len(tree):
                tree.append({})
        ends[at] = v
    size = 2 * len(tree) + 512
    base, check, value = [0] * size, [-1] * size, [-1] * size
    check[0], todo, low = 0, [(0, 0)], 1
    for node, slot in todo:  # breadth first; ``todo`` grows
        if node in ends:
            value[slot] = ends[node]
        kids = sorted(tree[node].items())
        if not kids:
            continue
        first, slot_tried, filled = kids[0][0], max(low, kids[0][0] + 1), 0
        begun = slot_tried
        while True:
            if slot_tried + 256 >= len(base):
                more = len(base)
                base, check, value = base + [0] * more, check + [-1] * more, value + [-1] * more
            if check[slot_tried] >= 0:
                filled += 1
            elif all(check[slot_tried - first + b] < 0 for b, _ in kids):
                break
            slot_tried += 1
        at = slot_tried - first
        if filled >= 0.9 * (slot_tried - begun + 1):
            low = max(low, slot_tried)  # what lies below is nearly full
        base[slot] = at
        for b, kid in kids:
            check[at + b] = slot
            todo.append((kid, at + b))
    used = max(i for i, c in enumerate(check) if c >= 0) + 257
    pad = [0] * max(0, used - len(base))
    return tuple(np.array((x + (pad if f == 0 else [-1] * len(pad)))[:used], np.int32) for x, f in ((base, 0), (check, -1), (value, -1)))


def build_model(pieces: list) -> Model:
    keys = {p.encode(): i for i, (p, _, k) in enumerate(pieces) if k == NORMAL}
    raw = [bytes([int(p[3:5], 16)]) if k == BYTE else p.encode() if k == NORMAL else b"" for p, _, k in pieces]
    return Model(raw, np.array([s for _, s, _ in pieces]), np.array([k for *_, k in pieces], np.int8), *double_array(keys))


def load_model(path: str = MODEL) -> Model:
    pieces, unigram = read_pieces(path)
    return build_model(pieces if unigram else zipf(pieces))


class Codec:
    """Encoder and decoder of a task."""

    def __init__(self, model: Model):
        self.pieces = model.pieces
        self.base, self.check, self.value = model.base.tolist(), model.check.tolist(), model.value.tolist()
        self.scores = model.scores.tolist()
        self.arrays = model.base, model.check, model.value, np.append(model.scores, -np.inf)  # no piece (-1): the last
        self.bytes = {p[0]: i for i, p in enumerate(model.pieces) if model.kinds[i] == BYTE}
        self.unknown = next((i for i, k in enumerate(model.kinds) if k == UNKNOWN), 0)
        normal = model.kinds == NORMAL
        self.cost = float(model.scores[normal].min() if normal.any() else 0.0) - UNKNOWN_COST
        mark = MARK.encode()
        words = {p for p, n in zip(model.pieces, normal, strict=True) if n}
        # no piece goes on with a marker after another character, nor holds a line end
        self.cut = re.compile(r"\n| *[^ \n]+| +") if not any(b"\n" in p or _inner(p, mark) for p in words) else None
        self.known: dict[str, bytes] = {}

    def _best(self, part: str) -> bytes:
        """int32 ids of the best path of one part (spaces not yet escaped)."""
        text = part.replace(" ", MARK).encode()
        n = len(text)
        best, back = [-math.inf] * (n + 1), [(0, -1)] * (n + 1)
        best[0] = 0.0
        base, check, value, scores = self.base, self.check, self.value, self.scores
        at = 0
        while at < n:
            lead = text[at]
            step = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            here, node, single = best[at], 0, False
            for i in range(at, n):
                kid = base[node] + text[i]
                if check[kid] != node or kid == 0:
                    break
                node = kid
                v = value[node]
                if v >= 0:
                    s = here + scores[v]
                    if s > best[i + 1]:
                        best[i + 1], back[i + 1] = s, (at, v)
                    single = single or i + 1 == at + step
                if not base[node]:
                    break
            if not single and here + self.cost > best[at + step]:
                best[at + step], back[at + step] = here + self.cost, (at, -1)
            at += step
        out, at = [], n
        while at:
            start, v = back[at]
            if v >= 0:
                out.append(v)
            elif self.bytes:
                out += [self.bytes[b] for b in reversed(text[start:at])]
            else:
                out.append(self.unknown)
            at = start
        return np.array(out[::-1], np.int32).tobytes()

    def _best_of_many(self, parts: list[str]) -> list[bytes]:
        """``_best`` of many short parts at once: a matrix of their bytes, and one
        step of the trie and of the lattice for all of them at a time."""
        texts = [p.replace(" ", MARK).encode() for p in parts]
        n = np.array([len(t) for t in texts])
        width, all_rows = int(n.max()), np.arange(len(texts))
        text = np.frombuffer(b"".join([t.ljust(width, b"\0") for t in texts]), np.uint8).reshape(len(texts), width)
        base, check, value, scores = self.arrays
        begins = (text & 0xC0) != 0x80
        step = 1 + (text >= 0xC0).astype(np.int64) + (text >= 0xE0) + (text >= 0xF0)
        best = np.full((len(texts), width + 1), -np.inf)
        best[:, 0] = 0.0
        start, piece = np.zeros((len(texts), width + 1), np.int32), np.full((len(texts), width + 1), -1, np.int32)
        for at in range(width):
            rows = np.flatnonzero((n > at) & begins[:, at])
            here, end = best[rows, at], at + step[rows, at]
            single, nth, node = np.zeros(len(rows), bool), np.arange(len(rows)), np.zeros(len(rows), np.int32)
            for j in range(at, width):
                kid = base[node] + text[rows[nth], j]
                on = (check[kid] == node) & (n[rows[nth]] > j)
                nth, node = nth[on], kid[on]
                if not len(nth):
                    break
                v = value[node]
                hit = v >= 0
                single[nth[hit & (end[nth] == j + 1)]] = True
                s, r = here[nth] + scores[v], rows[nth]
                better = hit & (s > best[r, j + 1])
                r = r[better]
                best[r, j + 1], start[r, j + 1], piece[r, j + 1] = s[better], at, v[better]
            r, e, s = rows[~single], end[~single], here[~single] + self.cost
            better = s > best[r, e]
            best[r[better], e[better]], start[r[better], e[better]], piece[r[better], e[better]] = s[better], at, -1
        at, back, odd = n.copy(), [], np.zeros(len(texts), bool)
        while at.any():
            v = np.where(at > 0, piece[all_rows, at], -2)
            odd |= v == -1
            back.append(v)
            at = np.where(at > 0, start[all_rows, at], 0)
        ids = np.stack(back[::-1], axis=1).astype(np.int32)
        there = ids >= 0
        flat, ends = ids[there].tobytes(), np.cumsum(there.sum(axis=1) * 4).tolist()
        out = [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        for i in np.flatnonzero(odd).tolist():  # characters without a piece become bytes
            out[i] = self._best(parts[i])
        return out

    def encode_all(self, texts: list) -> list[np.ndarray]:
        """Ids of each text."""
        cut = self.cut.findall if self.cut else lambda t: [t]
        parts = [cut(" " + t) if t else [] for t in texts]
        if len(self.known) >= CACHE:
            self.known.clear()
        known = self.known
        new = {p for ps in parts for p in ps if p not in known}
        short = sorted((p for p in new if len(p) <= LONGEST), key=len)
        for i in range(0, len(short), 4096):
            known.update(zip(short[i:i + 4096], self._best_of_many(short[i:i + 4096]), strict=True))
        for p in (long := [p for p in new if len(p) > LONGEST]):
            known[p] = self._best(p)
        out = [np.frombuffer(b"".join(map(known.__getitem__, ps)), np.int32) for ps in parts]
        for p in long:
            del known[p]
        return out

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text."""
        return self.encode_all([text])[0]

    def decode(self, ids) -> str:
        """The text of ids."""
        pieces = self.pieces
        text = b"".join([pieces[i] for i in ids]).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


    def decode_any(self, ids) -> str:
        """The text of ids of any origin: null ones and those outside the vocabulary
        give the replacement character."""
        n = len(self.pieces)
        if all(i is not None and 0 <= i < n for i in ids):
            return self.decode(ids)
        foreign = "\ufffd".encode()
        text = b"".join([self.pieces[i] if i is not None and 0 <= i < n else foreign for i in ids]).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


_CODECS: dict = {}


def codec(model: Model) -> Codec:
    """The worker's codec of a model; its remembered parts outlast a task."""
    key = (len(model.pieces), hash(model.scores.tobytes()), hash(b"".join(model.pieces)))
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(model)
    return _CODECS[key]


def _inner(piece: bytes, mark: bytes) -> bool:
    while piece.startswith(mark):
        piece = piece[len(mark):]
    return mark in piece


def encode(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, ids, n_tokens, n_byte_tokens, round_trip (the decoded ids are the
    text) of every document."""
    model = load_model(path)
    schema = docs.select("doc_id").schema.add("ids", ArrayType(IntegerType())).add("n_tokens", "long").add("n_byte_tokens", "long").add("round_trip", "boolean")

    def run(batches):
        own = codec(model)
        is_byte = model.kinds == BYTE
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            ids = own.encode_all(texts)
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = np.concatenate([np.empty(0, np.int32), *ids])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())),
                 pa.array([len(x) for x in ids], pa.int64()), pa.array([int(is_byte[x].sum()) for x in ids], pa.int64()),
                 pa.array([own.decode(x.tolist()) == (t or "").replace(MARK, " ") for x, t in zip(ids, texts, strict=True)], pa.bool_())],
                names=["doc_id", "ids", "n_tokens", "n_byte_tokens", "round_trip"])

    return map_arrow(docs.select("doc_id", "text"), run, schema)


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id and text of ``encoded(doc_id, ids)``; a null list decodes
    to the empty text, a null id or one outside the vocabulary to U+FFFD."""
    model = load_model(path)
    schema = encoded.select("doc_id").schema.add("text", "string")

    def run(batches):
        own = codec(model)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([own.decode_any(x or []) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return map_arrow(encoded.select("doc_id", "ids"), run, schema)
