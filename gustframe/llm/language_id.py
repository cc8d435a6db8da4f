"""Language identification by hierarchical discrimination.

A text is lower-cased, every run of characters that are no letters becomes one
space, and its 1-, 2- and 3-grams of characters are hashed to ``BUCKETS`` relative
frequencies. A multinomial logistic regression predicts the language family (a
fixed table; a language that it does not name is a family of its own). Within the
family, one-versus-one linear support vector machines, one per pair of languages,
vote; ties go to the larger sum of margins, then to the first name.

Models are fitted on a bounded sample: about ``TRAIN_ROWS`` labelled texts per
language (all, if there are fewer), chosen by a hash of id and text. Spark ML fits
the regression; the machines are fitted side by side, one group of a grouped map
per pair, which holds the sample of two languages.
Prediction reads whole texts, and only them: a linear score is the mean of the
weights at a text's grams, so that a task holds one block of grams at a time.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so
is every text if nothing can be learned; a row whose id is null is not held out
and not learned from; null languages are not learned; with one language every
text with a letter is predicted as it; repeated rows are predicted each; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from gustframe.session import ship_package

from .common import join_small, map_arrow, slices, store

BUCKETS, ORDERS, TRAIN_ROWS = 4096, 3, 500
#: Grams weighed at a time.
BLOCK = 1 << 19
UNKNOWN = "und"

# ISO 639-1 codes by language family.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy lb af yi fo",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv", "uralic": "fi et hu", "hellenic": "el", "celtic": "ga gd cy br", "indic": "hi ur bn pa mr gu ne si",
    "iranian": "fa ps ku tg", "semitic": "ar he mt am", "turkic": "tr az kk uz tk ky tt", "sinitic": "zh", "japonic": "ja", "koreanic": "ko",
    "austronesian": "id ms tl jv mg", "dravidian": "ta te kn ml", "austroasiatic": "vi km", "tai": "th lo", "bantu": "sw zu xh rw",
}
FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}

_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    """Whether a code point is a letter, for all of them."""
    global _letters
    if _letters is None:
        _letters = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _letters


def family_of(lang: str) -> str:
    return FAMILY.get(lang, f"language:{lang}")


def grams(texts: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (number of the text, bucket) of the grams of ``texts``; the
    numbers never fall within a block."""
    lowered = [(t or "").lower() for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in lowered])
    letter = _is_letter()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1] & (owner[1:] == owner[:-1])
    points, owner = np.where(letter, points, 32).astype(np.uint32)[keep], owner[keep]
    for at in range(0, len(points), BLOCK):
        mixed = np.zeros(min(BLOCK, len(points) - at), np.uint32)
        for k in range(ORDERS):
            n = min(BLOCK, len(points) - at - k)
            if n <= 0:
                break
            mixed = (mixed[:n] + points[at + k:at + k + n]) * _FACTORS[k]
            mixed ^= mixed >> np.uint32(15)
            own = owner[at:at + n]
            whole = own == owner[at + k:at + k + n] if k else points[at:at + n] != 32
            yield own[whole], ((mixed + np.uint32(k)) * np.uint32(0x27D4EB2F) >> np.uint32(20))[whole] % BUCKETS


def frequencies(texts: list) -> np.ndarray:
    """Relative frequencies of the buckets, a row per text (0 without letters)."""
    out = np.zeros((len(texts), BUCKETS))
    for own, bucket in grams(texts):
        out += np.bincount(own.astype(np.int64) * BUCKETS + bucket, minlength=out.size).reshape(out.shape)
    return out / np.maximum(out.sum(axis=1), 1)[:, None]


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


@dataclass
class Model:
    """Weights are columns: first the families (if more than one), then the pairs
    (indices of two languages)."""
    languages: list[str]
    families: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray
    bias: np.ndarray

    def scores(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Linear scores of each text, and whether it has a letter."""
        total, n = np.zeros((len(texts), len(self.bias))), np.zeros(len(texts))
        for own, bucket in grams(texts):
            n += np.bincount(own, minlength=len(texts))
            if len(own) and len(self.bias):
                first = np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1))
                total[own[first]] += np.add.reduceat(self.weights[bucket], first, axis=0)
        return total / np.maximum(n, 1)[:, None] + self.bias, n > 0

    def predict(self, texts: list) -> tuple[list[str], np.ndarray]:
        """Language and score (0 to 1) of each text."""
        s, known = self.scores(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        n_families = len(self.families) if len(self.families) > 1 else 0
        if n_families:
            e = np.exp(s[:, :n_families] - s[:, :n_families].max(axis=1, keepdims=True))
            share = e / e.sum(axis=1, keepdims=True)
        else:
            share = np.ones((len(texts), 1))
        family = share.argmax(axis=1)
        own = np.array([self.families.index(family_of(lang)) for lang in self.languages])
        votes, margins, sure = (np.zeros((len(texts), len(self.languages))) for _ in range(3))
        for j, (a, b) in enumerate(self.pairs):
            m = s[:, n_families + j]  # above 0: the second language
            votes[:, a], votes[:, b] = votes[:, a] + (m <= 0), votes[:, b] + (m > 0)
            margins[:, a], margins[:, b] = margins[:, a] - m, margins[:, b] + m
            p = 1 / (1 + np.exp(-2 * np.clip(m, -30, 30)))
            sure[:, a], sure[:, b] = sure[:, a] + 1 - p, sure[:, b] + p
        inside = own == family[:, None]
        best = np.lexsort((np.broadcast_to(-np.arange(len(own)), votes.shape), margins, np.where(inside, votes, -1)), axis=1)[:, -1]
        rows = np.arange(len(texts))
        rivals = np.bincount(own, minlength=len(self.families))[own[best]] - 1
        score = share[rows, family] * np.where(rivals > 0, sure[rows, best] / np.maximum(rivals, 1), 1.0)
        return [self.languages[i] if k else UNKNOWN for i, k in zip(best, known, strict=True)], np.where(known, score, 0.0)


def training_sample(docs: DataFrame, learn: Column, rows: int = TRAIN_ROWS) -> DataFrame:
    """lang, freq of about ``rows`` texts per language out of those for which ``learn``."""
    usable = docs.where(learn & F.col("lang").isNotNull() & has_letter(F.col("text"))).select("doc_id", "text", "lang")
    shares = store(usable.groupBy("lang").agg(F.least(F.lit(1.0), rows / F.count("*")).alias("share")), "language-shares")
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 31)) < F.col("share") * (1 << 31)
    chosen = join_small(usable, shares, "lang").where(drawn).select("lang", "text")

    def run(batches):
        for b in slices(batches, rows=64, mb=2):
            freq = frequencies(b.column(1).to_pylist())
            at = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * BUCKETS)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(at, pa.array(freq.ravel()))], names=["lang", "freq"])

    return store(map_arrow(chosen, run, "lang string, freq array<double>"), "language-sample")


def support_vector_machine(x: np.ndarray, y: np.ndarray, cost: float = 1.0, rounds: int = 30, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine with squared hinge loss and labels -1
    and 1, by coordinate descent over the dual. Columns are scaled by the root of
    their mean, as counts vary."""
    scale = 1 / np.sqrt(x.mean(axis=0) + 0.1 / x.shape[1])
    x = np.concatenate((x * scale, np.ones((len(x), 1))), axis=1)
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    slack = 0.5 / cost
    curve = np.einsum("ij,ij->i", x, x) + slack
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            step = max(alpha[i] - (y[i] * (x[i] @ w) - 1 + slack * alpha[i]) / curve[i], 0.0) - alpha[i]
            if step:
                alpha[i] += step
                w += step * y[i] * x[i]
    return w[:-1] * scale, w[-1]


def fit(docs: DataFrame, learn: Column, rows: int = TRAIN_ROWS) -> Model:
    """Family model and the support vector machines of each pair within a family."""
    sample = training_sample(docs, learn, rows)
    languages = sorted(r[0] for r in sample.select("lang").distinct().collect())  # language codes
    families = sorted({family_of(lang) for lang in languages})
    pairs = [(a, b) for a, b in combinations(range(len(languages)), 2) if family_of(languages[a]) == family_of(languages[b])]
    weights, bias = [np.zeros((BUCKETS, 0))], [np.zeros(0)]
    if len(families) > 1:
        label = F.lit(None).cast("double")
        for lang in languages:
            label = F.when(F.col("lang") == lang, F.lit(float(families.index(family_of(lang))))).otherwise(label)
        m = LogisticRegression(family="multinomial", maxIter=60, regParam=0.001).fit(sample.select(label.alias("label"), array_to_vector("freq").alias("features")))
        weights.append(m.coefficientMatrix.toArray().T)
        bias.append(m.interceptVector.toArray())
    if pairs:
        places = F.lit(None)
        for i, lang in enumerate(languages):
            own = [F.struct(F.lit(j).alias("pair"), F.lit(2.0 * (b == i) - 1).alias("y")) for j, (a, b) in enumerate(pairs) if i in (a, b)]
            if own:
                places = F.when(F.col("lang") == lang, F.array(*own)).otherwise(places)

        def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            w, b = support_vector_machine(np.stack(part["freq"].to_numpy()), part["y"].to_numpy())
            return pd.DataFrame({"pair": [key[0]], "w": [w], "b": [b]})

        ship_package(docs.sparkSession)
        found = (sample.select(F.explode(places).alias("p"), "freq").select("p.pair", "p.y", "freq")
                 .groupBy("pair").applyInPandas(one, "pair int, w array<double>, b double").orderBy("pair").collect())  # a row per pair
        weights.append(np.array([r.w for r in found]).T)
        bias.append(np.array([r.b for r in found]))
    return Model(languages, families, pairs, np.concatenate(weights, axis=1), np.concatenate(bias))


def predict(docs: DataFrame, model: Model, extra: list[str]) -> DataFrame:
    """The columns ``extra``, lang_pred and score of every row; only ``text`` is used."""
    schema = docs.select(*extra).schema.add("lang_pred", "string").add("score", "double")

    def run(batches):
        for b in slices(batches, mb=1):
            langs, score = model.predict(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(langs, pa.string()), pa.array(score)], names=[*extra, "lang_pred", "score"])

    return map_arrow(docs.select("text", *extra), run, schema)


def held_out() -> Column:
    """A quarter of the documents, by a checksum of the id's digits."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the documents not held out."""
    narrow = docs.select("doc_id", "text", "lang")
    model = fit(narrow, F.col("doc_id").isNotNull() & ~held_out(), rows)
    return predict(narrow.select("doc_id", held_out().alias("held_out"), "text"), model, ["doc_id", "held_out"])
