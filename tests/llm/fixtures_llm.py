"""Small document tables and brute-force helpers for the training-data tests."""

from __future__ import annotations

import random
import re

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
EXTRA = ("shard", "key", "label", "tkey", "skey", "mix_leaf", "mix_copies", "MIX_NTH", "jaccard_key", "quality_n_words", "copies", "domain")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    out = []
    for i in range(n):
        out.append(rng.choice(WORDS) + str(rng.randrange(90)))
        if i % 17 == 16:
            out.append("\n")
    return " ".join(out)


def near(text: str, seed: int, edits: int) -> str:
    rng, words = random.Random(seed), text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def documents(spark, n: int = 60):
    """Prose, exact and near copies, nulls in every column, empty and long texts,
    repeated rows, and extra columns with names that operators use."""
    rows = []
    for i in range(n):
        text = prose(i, 60 + 7 * (i % 9))
        if i % 5 == 1:
            text = prose(3, 120)  # copies
        if i % 7 == 2:
            text = near(prose(4, 200), i, 1 + i % 6)
        rows.append((i, text, ["en", "de", None][i % 3], f"src{i % 4}" if i % 6 else None))
    rows += [(100, None, "en", "src1"), (101, "", "de", "src2"), (102, "  \n ", None, None), (None, prose(50, 70), "en", "src0"),
             (None, None, None, None), (103, "one two", "en", "src1"), (104, "One, two!", "en", "src1"), (105, prose(77, 9000), "en", "src3"),
             (0, rows[0][1], "en", "src0"), (0, rows[0][1], "en", "src0"), (-7, "x" * 5000, "en", "src3"), (2**62, "é漢🙂 \t tab", "es", "src2")]
    return spark.createDataFrame([(a, b, c, d, len(b) if b is not None and i % 11 else None, *[(c_, None, "")[i % 3] for c_ in EXTRA])
                                  for i, (a, b, c, d) in enumerate(rows)], SCHEMA)


def empty(df):
    return df.sparkSession.createDataFrame([], df.schema)


def shingles(text) -> frozenset:
    w = re.findall(r"\w+", (text or "").lower())
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
