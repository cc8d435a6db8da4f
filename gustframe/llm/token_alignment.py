"""Alignment of two tokenizers' tokens over the bytes of a text.

A text is encoded by a byte-level BPE (A, over a space and the text) and by a
SentencePiece model (B, which adds the space itself). Both libraries tell the
span of characters of every token: A by its character offsets, B by its offset
mapping. These spans are coarse cuts: where a token's span ends and the next one's
begins, the byte offset of that character is a token end. They say nothing where
a character of several bytes is split over tokens of A (whose spans overlap) or
written as byte-fallback tokens of B (whose spans are empty); there the decoded
bytes of the tokens are counted on from the last cut. Byte offsets at which tokens
of both end cut the tokens into groups and are the links: an A and a B token that
end together.

Both encoders never look past a place where a space follows a character that is no
white space (A cuts words there first; no piece of B has its space mark after
another character, which is checked when the model is read). So a text is cut into
parts at these places, each distinct part of a batch is encoded and aligned once,
and short ones are remembered; a part's end is an end of both, so the alignment of
a text is that of its parts in a row.

Links are counted over the corpus by id pair. A task hands on one row per document
and distinct pair. A pair's total is looked up again for every document that holds
it: pairs that make up at least 1 / ``HOT`` of all links, hence at most ``HOT`` of
them, are broadcast, so a pair that every document holds is no key of a shuffle;
all others are joined by shuffle, and each has less than that share of the rows.

Defined results: a null or empty text, and one whose joined bytes of A or B differ
from a space and the text, has no tokens: counts are 0 and ``groups_sha256`` is '';
special tokens' strings in a text are plain text; repeated rows and null ids are
rows of their own, each counted; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import map_arrow, slices, store

BYTE_BPE, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Pairs that may be broadcast: those with at least 1 / HOT of all links.
HOT = 200_000
#: Aligned parts that a task remembers, and their longest one in characters.
KEPT, SHORT = 700_000, 40

_ODD = re.compile(r"\A |\s | \Z")
_CUT = re.compile(r"(?<=\S)(?= )")


def byte_alphabet() -> dict[str, int]:
    """The character that byte-level BPE writes for each byte, inverted: printable
    Latin-1 characters stand for themselves, the rest for those from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class _Side:
    """Token bytes, their sizes, and ids as text with the two marks that follow."""

    def __init__(self, entries: list[bytes], within: str, last: str):
        self.bytes = entries
        self.size = np.array([len(e) for e in entries], np.int64)
        self.within = np.array([f"{i}{within}" for i in range(len(entries))], object)
        self.last = np.array([f"{i}{last}" for i in range(len(entries))], object)


def char_bytes(text: str, data: bytes) -> np.ndarray | None:
    """The byte offset of every character and of the end; None if they are the same."""
    if len(data) == len(text):
        return None
    c = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return np.concatenate(([0], np.cumsum(1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))))


def token_ends(begin: np.ndarray, end: np.ndarray, sizes: np.ndarray, at_byte: np.ndarray | None) -> np.ndarray:
    """Byte end of every token: the coarse cut where a span ends and the next one
    begins, and elsewhere the decoded bytes from the last cut on."""
    total = np.cumsum(sizes)
    sure = np.zeros(len(end), bool)
    wide = end > begin
    sure[:-1] = (end[:-1] == begin[1:]) & wide[:-1] & wide[1:]
    coarse = end if at_byte is None else at_byte[end]
    last = np.maximum.accumulate(np.where(sure, np.arange(len(end)), -1))
    ends = np.where(last < 0, total, coarse[last] + total - total[last])
    return ends if np.array_equal(ends, total) else total  # the joined bytes are the text: they decide


class Aligner:
    def __init__(self, path_a: str = BYTE_BPE, path_b: str = PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet, vocab = byte_alphabet(), self.a.get_vocab(with_added_tokens=True)
        entries = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            entries[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self.side_a = _Side(entries, ",", "|")
        self.side_b = _Side([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                             for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))], ",", ";")

        words = type(self.a.pre_tokenizer).__name__ == "ByteLevel" and self.a.normalizer is None
        self.cut = words and all(b" " not in e.lstrip(b" ") for e in self.side_b.bytes)
        self.known = {}

    @property
    def size_b(self) -> int:
        return len(self.side_b.bytes)

    def parts(self, text: str) -> list[str]:
        """The parts of a space and the text; each begins with a space."""
        if not self.cut:
            return [" " + text]
        if not _ODD.search(text):
            return [" " + p for p in text.split(" ")]
        out = _CUT.split(" " + text)
        if out[-1] == " ":  # B would see an empty text
            out[-2:] = ["".join(out[-2:])]
        return out

    def align_parts(self, parts: list[str]) -> list[tuple | None]:
        """For each part (number of A and of B tokens, groups as text, id pairs of
        the links as bytes), all aligned as one text, or None where bytes differ."""
        found_a = self.a.encode_batch(parts, add_special_tokens=False)
        found_b = self.b.encode([p[1:] for p in parts], return_type="offset_mapping", return_bytes=False, num_threads=1)
        right = [True] * len(parts)
        data = "".join(parts).encode()
        for side, found in ((self.side_a, [a.ids for a in found_a]), (self.side_b, [b["ids"] for b in found_b])):
            if b"".join(map(side.bytes.__getitem__, chain.from_iterable(found))) != data:
                right = [ok and b"".join(map(side.bytes.__getitem__, ids)) == p.encode() for ok, ids, p in zip(right, found, parts, strict=True)]
        if not all(right):
            some = iter(self.align_parts([p for p, ok in zip(parts, right, strict=True) if ok]) if any(right) else ())
            return [next(some) if ok else None for ok in right]
        text = "".join(parts)
        first = np.cumsum([0, *map(len, parts)])[:-1]
        at_byte = char_bytes(text, data)
        ids_a, n_a, begin, end = _tokens([a.ids for a in found_a], [a.offsets for a in found_a], first)
        ends_a = token_ends(begin, end, self.side_a.size[ids_a], at_byte)
        ids_b, n_b, begin, end = _tokens([b["ids"] for b in found_b], [b["offsets"] for b in found_b], first + 1)
        begin[np.cumsum(n_b) - n_b] -= 1  # B's spans are those of the text without the space
        ends_b = token_ends(begin, end, self.side_b.size[ids_b], at_byte)
        place = np.searchsorted(ends_b, ends_a)
        cuts_a = np.flatnonzero(ends_b[place] == ends_a)
        cuts_b = place[cuts_a]
        shown = self.groups(ids_a, ids_b, cuts_a, cuts_b)
        pairs = (ids_a[cuts_a] * self.size_b + ids_b[cuts_b]).tobytes()
        stop = np.cumsum(n_a + n_b).tolist()
        links = (8 * np.searchsorted(cuts_a, np.cumsum(n_a))).tolist()  # a part ends with a cut
        return [(a, b, "".join(shown[lo:hi])[:-1], pairs[i:j]) for a, b, lo, hi, i, j in
                zip(n_a.tolist(), n_b.tolist(), [0, *stop], stop, [0, *links], links, strict=False)]

    def align_all(self, texts: list) -> list:
        """For each text (number of A and of B tokens, groups as text, id pairs of
        the links), or None without tokens."""
        if len(self.known) > KEPT:
            self.known.clear()
        cut = [self.parts(t) if t else [] for t in texts]
        missing = list({p for ps in cut for p in ps}.difference(self.known))
        self.known.update(zip(missing, self.align_parts(missing) if missing else (), strict=True))
        out, known = [], self.known
        for ps in cut:
            entries = [known[p] for p in ps]
            if not ps or None in entries:
                out.append(None)
                continue
            n_a, n_b, groups, pairs = zip(*entries, strict=True)
            out.append((sum(n_a), sum(n_b), ";".join(groups), np.frombuffer(b"".join(pairs), np.int64)))
        for p in missing:
            if len(p) > SHORT:
                del self.known[p]
        return out

    def groups(self, ids_a: np.ndarray, ids_b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray) -> list[str]:
        """``a1,`` ``a2|`` ``b1;``: the ids of the groups between cuts, in order,
        with the mark that follows each."""
        n_a, n_b = np.arange(len(ids_a)), np.arange(len(ids_b))
        group_a, group_b = np.searchsorted(cuts_a, n_a), np.searchsorted(cuts_b, n_b)
        out = np.empty(len(ids_a) + len(ids_b), object)
        own = self.side_a.within[ids_a]
        own[cuts_a] = self.side_a.last[ids_a[cuts_a]]
        out[n_a + np.concatenate(([0], cuts_b + 1))[group_a]] = own
        own = self.side_b.within[ids_b]
        own[cuts_b] = self.side_b.last[ids_b[cuts_b]]
        out[n_b + (cuts_a + 1)[group_b]] = own
        return out.tolist()


def _tokens(ids: list, spans: list, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all parts in a row, their number per part, and the spans' begins and
    ends, moved to where each part begins."""
    n = np.array([len(x) for x in ids])
    flat = np.fromiter(chain.from_iterable(chain.from_iterable(spans)), np.int64, 2 * n.sum()).reshape(-1, 2) + np.repeat(first, n)[:, None]
    return np.fromiter(chain.from_iterable(ids), np.int64, n.sum()), n, flat[:, 0].copy(), flat[:, 1].copy()


def aligned_rows(docs: DataFrame, path_a: str = BYTE_BPE, path_b: str = PIECES) -> DataFrame:
    """row (a number of its own), doc_id, n_a, n_b, n_groups, n_links,
    groups_sha256, and the distinct linked id pairs (A id * size of B + B id) with
    the number of links each has in the document."""
    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"

    def run(batches):
        gc.disable()  # millions of small tuples and no cycles
        own, row = Aligner(path_a, path_b), TaskContext.get().partitionId() << 33
        for b in slices(batches, rows=256, mb=2):
            counts, digests, pairs, times = np.zeros((3, b.num_rows), np.int64), [], [], []
            for i, found in enumerate(own.align_all(b.column(1).to_pylist())):
                digest, links = "", np.zeros(0, np.int64)
                if found:
                    n_a, n_b, groups, links = found
                    counts[:, i] = n_a, n_b, len(links)
                    digest = hashlib.sha256(groups.encode()).hexdigest()
                pair, n = np.unique(links, return_counts=True)
                digests.append(digest)
                pairs.append(pair)
                times.append(n)
            at = pa.array(np.concatenate(([0], np.cumsum([len(p) for p in pairs]))).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(row + np.arange(b.num_rows)), b.column(0), *map(pa.array, counts), pa.array(counts[2]), pa.array(digests, pa.string()),
                 pa.ListArray.from_arrays(at, pa.array(np.concatenate(pairs))),
                 pa.ListArray.from_arrays(at, pa.array(np.concatenate(times).astype(np.int32)))],
                names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
            row += b.num_rows

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)


def align(docs: DataFrame, path_a: str = BYTE_BPE, path_b: str = PIECES, hot: int = HOT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    import sentencepiece
    size_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    rows = store(aligned_rows(docs, path_a, path_b), "aligned")
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("row", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
    counts = store(links.groupBy("pair").agg(F.sum("times").alias("count")).withColumn("b", F.col("pair") % size_b), "pair-counts")
    tops = counts.groupBy("b").agg(F.max("count").alias("top"))  # a row per B id at most
    judged = store(counts.join(F.broadcast(tops), "b").select("pair", "count", (F.col("count") == F.col("top")).cast("long").alias("best")), "pair-best")

    total = rows.agg(F.sum("n_links")).first()[0] or 0
    bar = -(-total // hot)
    many, few = F.broadcast(judged.where(F.col("count") >= bar)), judged.where(F.col("count") < bar)
    found = links.join(many, "pair")
    if bar > 1:
        found = found.unionByName(links.join(many, "pair", "left_anti").join(few.hint("merge"), "pair"))
    sums = found.groupBy("row").agg(F.sum(F.col("best") * F.col("times")).alias("n_best"), F.sum(F.col("count") * F.col("times")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return (rows.join(sums, "row", "left")
            .select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
                    F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256"))
