"""Quality rules with risk-controlled thresholds.

Every text gets a few measures. A path of strictness levels, each a cutoff for
every rule, runs from lenient to strict; a document is rejected at a level if any
rule's ratio passes that level's cutoff. Per stratum (language) the labelled good
documents are a holdout: a level is certified if the exact upper binomial
(Clopper-Pearson) bound of its false rejections is at most ``alpha``, that is, if
so few rejections had probability ``delta / strata`` at most under a rate of
``alpha``. Levels are tested in a fixed order from the lenient end until one
fails, which keeps the error of the whole path at the level of one test; the
strata are corrected for by Bonferroni. With probability 1 - ``delta``, no
stratum's last certified level rejects more than ``alpha`` of its good documents.
A stratum without a certified level rejects only by the base rules.

Only counts per (stratum, level) reach the driver, and only of strata with enough
labelled documents that any level could be certified.

Defined results: a null text has no words; a null language is a stratum of its
own; a document with several labels is good if one says so, and labels with null
doc_id or quality, or of other documents, are left out; repeated rows are judged
alike; empty tables give no rows (no labels: base rules only); other columns,
whatever their names, are handed through by ``keep_good``.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh, map_arrow, slices, store

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts")


@dataclass(frozen=True)
class RuleSpec:
    """``path``: cutoffs of each level, lenient to strict, of the rules below; it
    ends at published values for web text (symbols 0.1, repeated lines 0.3, mean
    word length 10)."""

    alpha: float = 0.01  # false rejections allowed among good documents of a stratum
    delta: float = 0.05  # chance that any stratum's allowance is broken
    path: tuple = ((1.0, 0.9, 0.5, 16, 0.5), (0.5, 0.8, 0.5, 15, 0.4), (0.25, 0.7, 0.5, 14, 0.3), (0.2, 0.6, 0.48, 13, 0.25),
                   (0.15, 0.5, 0.46, 12, 0.2), (0.12, 0.4, 0.43, 11, 0.15), (0.1, 0.3, 0.4, 10, 0.1))


#: Ratios that reject above their cutoff, in the order of a level's cutoffs.
RULES = ("symbols per word", "repeated lines", "repeated words", "mean word length", "shouts per word")


def measure(text: str | None) -> tuple[int, ...]:
    """The measures of one text, in the order of MEASURES."""
    text = text or ""
    words = text.encode().split()  # bytes split at \x20 and \x09-\x0D only
    n = len(words)
    word_chars = len(text) - sum(map(text.count, SPACE))
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    repeats = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            often, upto = Counter(windows), 0
            for i, w in enumerate(windows):
                if often[w] > 1:
                    repeats += i + 3 - max(i, upto)
                    upto = i + 3
    return n, word_chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeats, len(lines), text.count("!")


def with_measures(docs: DataFrame, keep: list[str], out: str = "") -> DataFrame:
    """``keep`` columns and the measures (named with the prefix ``out``) of ``text``."""
    plain = docs.select(*keep, *([] if "text" in keep else ["text"]))
    schema = docs.select(*keep).schema
    names = [out + m for m in MEASURES]
    for name in names:
        schema = schema.add(name, "long")

    def run(batches):
        for b in slices(batches):
            at = b.schema.get_field_index("text")
            got = list(zip(*(measure(t) for t in b.column(at).to_pylist()), strict=True)) or [[]] * len(MEASURES)
            kept = [b.column(i) for i, f in enumerate(b.schema) if f.name in keep]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(g, pa.int64()) for g in got)], names=[*(f.name for f in b.schema if f.name in keep), *names])

    return map_arrow(plain, run, schema)


def base_failed(out: str = "") -> Column:
    n, r = F.col(out + "n_words"), F.col(out + "n_repeat_words")
    return (n < 50) | (100 * r > 50 * n)


def strictness(spec: RuleSpec, out: str = "") -> Column:
    """The first (most lenient) level that rejects a document; len(path): none."""
    c = lambda m: F.col(out + m)
    words, lines = F.greatest(c("n_words"), F.lit(1)), F.greatest(c("n_lines"), F.lit(1))
    ratios = (c("n_symbols") / words, c("n_dup_lines") / lines, c("n_repeat_words") / words, c("word_chars") / words, c("n_shouts") / words)
    level = F.lit(len(spec.path))
    for i in reversed(range(len(spec.path))):
        hit = F.lit(False)
        for ratio, cutoff in zip(ratios, spec.path[i], strict=True):
            hit = hit | (ratio > cutoff)
        level = F.when(hit, i).otherwise(level)
    return level


def tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial(n, p), summed in logarithms."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def certified_levels(measured: DataFrame, labels: DataFrame, spec: RuleSpec = RuleSpec(), stratum: str = "lang") -> dict:
    """Stratum -> number of levels certified. ``measured``: doc_id, the stratum and
    the measures of every document. A labelled doc_id is one trial of a stratum
    however many rows carry it, as the binomial bound counts independent documents;
    if its rows differ, the first level that rejects any of them counts."""
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("good")).where("good = 1")
    trials = (measured.where(~base_failed() & F.col("doc_id").isNotNull()).groupBy("doc_id", F.col(stratum).alias("stratum"))
              .agg(F.min(strictness(spec)).alias("level")))
    first = trials.join(good.select("doc_id"), "doc_id").groupBy("stratum", "level").agg(F.count("*").alias("n"))
    fewest = math.log(spec.delta) / math.log1p(-spec.alpha)  # labels without which no level can pass
    per = first.groupBy("stratum").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("level", "n"))).alias("by"))
    rows = per.where(F.col("n") >= fewest).collect()
    out = {}
    for r in rows:
        rejected = passed = 0
        for i in range(len(spec.path)):
            rejected += (r["by"] or {}).get(i, 0)
            if rejected >= spec.alpha * r["n"] or tail(rejected, r["n"], spec.alpha) > spec.delta / len(rows):
                break
            passed = i + 1
        out[r["stratum"]] = passed
    return out


def _rejected(levels: dict, spec: RuleSpec, stratum: str, out: str = "") -> Column:
    """True where the stratum's certified levels reject a document."""
    level = strictness(spec, out)
    hit = F.lit(False)
    for name, passed in levels.items():
        if passed:
            hit = F.when(F.col(stratum).eqNullSafe(F.lit(name)), level < passed).otherwise(hit)
    return hit


def judge(docs: DataFrame, labels: DataFrame, spec: RuleSpec = RuleSpec(), stratum: str = "lang") -> DataFrame:
    """doc_id, stratum, the measures, base_failed, kept of every document."""
    measured = store(with_measures(docs.select("doc_id", stratum, "text"), ["doc_id", stratum]), "quality-measures")
    levels = certified_levels(measured, labels, spec, stratum)
    return (measured.withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & ~_rejected(levels, spec, stratum)))


def keep_good(docs: DataFrame, labels: DataFrame, spec: RuleSpec = RuleSpec(), stratum: str = "lang") -> DataFrame:
    """The documents that the rules keep, with all their columns. Texts are
    measured again here rather than shuffled to a stored verdict."""
    measured = store(with_measures(docs.select("doc_id", stratum, "text"), ["doc_id", stratum]), "quality-measures")
    levels = certified_levels(measured, labels, spec, stratum)
    out = fresh(docs, "quality_")
    while any(c.lower().startswith(out) for c in docs.columns):
        out += "_"
    good = with_measures(docs, docs.columns, out).where(~base_failed(out) & ~_rejected(levels, spec, stratum, out))
    return good.select(*docs.columns)


def oracle_sql(spec: RuleSpec = RuleSpec()) -> str:
    """``judge`` of ``documents`` with ``labels`` in DuckDB: the measures by lists
    and windows, the binomial sums by the log-gamma function."""
    n = len(spec.path)
    ratios = ("n_symbols / n", "n_dup_lines / ln", "n_repeat_words / n", "word_chars / n", "n_shouts / n")
    level = "CASE " + " ".join("WHEN " + " OR ".join(f"{r} > {float(c)!r}" for r, c in zip(ratios, row, strict=True)) + f" THEN {i}" for i, row in enumerate(spec.path)) + f" ELSE {n} END"
    space, word = "[\\x20\\x09-\\x0D]", "[^\\x20\\x09-\\x0D]"
    fewest = math.log(spec.delta) / math.log1p(-spec.alpha)
    a, b = math.log(spec.alpha), math.log1p(-spec.alpha)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '{word}+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS ls FROM d),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i + 1], ws[i + 2]) AS c FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
h AS (SELECT rid, count(DISTINCT i + j) AS n_repeat_words FROM g, (VALUES (0), (1), (2)) AS o(j) WHERE c > 1 GROUP BY rid),
m AS (SELECT d.rid, doc_id, lang, len(ws) AS n_words, length(regexp_replace(t, '{space}', '', 'g')) AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words, greatest(len(ws), 1)::DOUBLE AS n, greatest(len(ls), 1)::DOUBLE AS ln,
        length(regexp_replace(t, '[^!]', '', 'g')) AS n_shouts
      FROM d JOIN w USING (rid) LEFT JOIN h USING (rid)),
s AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {level} AS level FROM m),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING max(quality) = 1),
u AS (SELECT doc_id, lang, min(level) AS level FROM s JOIN good USING (doc_id) WHERE NOT base_failed GROUP BY doc_id, lang),
c AS (SELECT lang, level, count(*) AS k FROM u GROUP BY lang, level),
z AS (SELECT lang, sum(k)::BIGINT AS total FROM c GROUP BY lang HAVING sum(k) >= {fewest!r}),
r AS (SELECT z.lang, total, v.i, coalesce((SELECT sum(k) FROM c WHERE c.lang IS NOT DISTINCT FROM z.lang AND level <= v.i), 0)::BIGINT AS x
      FROM z, (SELECT unnest(range({n})) AS i) v),
q AS (SELECT lang, i, x < {spec.alpha!r} * total AND list_sum(list_transform(range(x + 1), lambda j: exp(lgamma(total + 1) - lgamma(j + 1)
        - lgamma(total - j + 1) + j * ({a!r}) + (total - j) * ({b!r})))) <= {spec.delta!r} / (SELECT count(*) FROM z) AS ok FROM r),
p AS (SELECT lang, min(CASE WHEN ok THEN {n} ELSE i END) AS passed FROM q GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT level < coalesce(passed, 0) AS kept
FROM s LEFT JOIN p ON s.lang IS NOT DISTINCT FROM p.lang"""
