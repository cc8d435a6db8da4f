"""Mixing sources to target weights by hierarchical budgets.

The corpus is a tree: domain, language, source (a leaf). A token budget goes down
the tree. At every node the children get shares in proportion to their weights;
a child whose subtree cannot take its share (its tokens times ``max_epochs``)
gets what it can take, and what is left is shared again among its siblings. As a
node's budget is fixed before its children are looked at, a shortage is made up
by siblings first and reaches an ancestor's siblings only when the whole subtree
is used up. The shares are found in closed form: children in order of capacity
over weight, and prefix sums tell which of them are full.

A leaf with budget b over t tokens takes every document ``b div t`` times (its
full epochs) and, in one more epoch, a prefix of the leaf in that epoch's seeded
order until the rest of the budget is reached. The order is a 60-bit hash of
seed, epoch and doc_id. The last key of the prefix is found by two histograms
over 12 bits of the key each and a sort of the few keys that share those 24 bits,
so no leaf is ever sorted or gathered, however large. Documents are then chosen
by comparing keys, without a shuffle of texts.

Defined results: null levels form nodes of their own, named ``(none)``; a null
text has no tokens; a document without tokens follows its leaf's epochs; rows
with the same doc_id in a leaf are one unit of the order, all in or all out; a
leaf without tokens has budget 0; an empty table gives no rows; other columns,
whatever their names, are handed through by ``mix`` and left out of ``plan_mix``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import fresh, join_small, store

WORD = r"[^\x20\x09-\x0D]+"
LEVELS = ("domain", "lang", "source")
NONE = "(none)"


def domain_of(source: Column) -> Column:
    """Default domain rule: four domains by the last character of the source."""
    return F.concat(F.lit("d"), F.pmod(F.ascii(F.right(source, F.lit(1))), F.lit(4)).cast("string"))


@dataclass(frozen=True)
class MixSpec:
    """Weights of tree nodes by level and name (others: 1), and the budget."""

    weights: dict = field(default_factory=lambda: {
        "domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 1}, "source": {}})
    budget_share: tuple[int, int] = (1, 1)  # of all tokens, as a fraction
    max_epochs: int = 3
    seed: int = 17


def _weight(level: str, spec: MixSpec) -> Column:
    known = spec.weights.get(level) or {}
    out = F.lit(1)
    for name, w in known.items():
        out = F.when(F.col(level) == name, F.lit(w)).otherwise(out)
    return out.cast("long")


def _shares(nodes: DataFrame, parent: list[str], level: str, spec: MixSpec) -> DataFrame:
    """Split each parent's ``budget`` among its children (columns: parent, level,
    cap, budget of the parent); returns parent, level, budget of the child."""
    big = lambda c: F.col(c).cast("decimal(20,0)")
    rest = Window.partitionBy(*parent).orderBy("ratio", level)
    below, after = rest.rowsBetween(Window.unboundedPreceding, -1), rest.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(*parent)
    tried = (nodes.withColumn("w", _weight(level, spec))
             .withColumn("ratio", F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(F.lit(float("inf"))))
             .withColumns({"used": F.coalesce(F.sum("cap").over(below), F.lit(0)), "w_rest": F.sum("w").over(after)})
             .withColumn("full", big("cap") * big("w_rest") <= big("w") * (big("budget") - big("used"))))
    open_w = F.when(F.col("full"), 0).otherwise(F.col("w"))
    parts = (tried.withColumns({
        "left": F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(whole),
        "w_open": F.sum(open_w).over(whole), "w_upto": F.sum(open_w).over(rest.rowsBetween(Window.unboundedPreceding, 0))}))
    cut = lambda w: F.expr(f"cast(left as decimal(20,0)) * cast({w} as decimal(18,0)) div greatest(w_open, 1)")
    share = F.when(F.col("full"), F.col("cap")).otherwise(cut("w_upto") - cut("(w_upto - w)"))
    return parts.select(*parent, level, share.cast("long").alias("budget"))


def leaf_budgets(leaves: DataFrame, spec: MixSpec) -> DataFrame:
    """``leaves(domain, lang, source, tokens)`` -> with budget, epochs (full ones)
    and rest (tokens of the prefix in one more epoch)."""
    caps = leaves.withColumn("cap", F.col("tokens") * spec.max_epochs)
    num, den = spec.budget_share
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    root = min(total * num // den, total * spec.max_epochs)
    parent, out = [], None
    for level in LEVELS:
        nodes = caps.groupBy(*parent, level).agg(F.sum("cap").alias("cap"))
        nodes = nodes.withColumn("budget", F.lit(root).cast("long")) if out is None else nodes.join(out, parent)
        out = _shares(nodes, parent, level, spec)
        parent.append(level)
    got = leaves.join(out, list(LEVELS))
    epochs = F.expr("case when tokens > 0 then budget div tokens else 0 end")
    return got.withColumn("epochs", epochs).withColumn("rest", F.expr("case when tokens > 0 then budget % tokens else 0 end"))


def _levels(docs: DataFrame, domain) -> dict[str, Column]:
    none = lambda c: F.coalesce(c, F.lit(NONE))
    return {"domain": none(domain(F.col("source"))), "lang": none(F.col("lang")), "source": none(F.col("source"))}


def _key(seed: int) -> Column:
    """60-bit order key of a document in the leaf's last epoch."""
    text = F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def plan_mix(docs: DataFrame, spec: MixSpec = MixSpec(), domain=domain_of) -> tuple[DataFrame, DataFrame]:
    """(narrow rows, leaves): rows doc_id, domain, lang, source, n_tokens; leaves
    with budget, epochs, rest and ``last_key``, the prefix's last key (null: no
    prefix)."""
    rows = store(docs.select("doc_id", *(c.alias(n) for n, c in _levels(docs, domain).items()),
                             F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens")), "mix-rows")
    leaves = store(leaf_budgets(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), spec), "mix-leaves")

    cut = leaves.where("rest > 0").select(*LEVELS, "epochs", F.col("rest").alias("need"), F.lit(0).cast("long").alias("prefix"))
    for shift in (48, 36):  # 12 bits of the key at a time
        bins = (join_small(rows, cut, list(LEVELS)).withColumn("key", _key(spec.seed))
                .where(F.shiftright("key", shift + 12) == F.col("prefix"))
                .groupBy(*LEVELS, "epochs", "need", F.shiftright("key", shift).alias("bin")).agg(F.sum("n_tokens").alias("t")))
        cut = store(_reached(bins, "bin").select(*LEVELS, "epochs", F.col("need_left").alias("need"), F.col("bin").alias("prefix")), "mix-cut")
    keys = (join_small(rows, cut, list(LEVELS)).withColumn("key", _key(spec.seed))
            .where(F.shiftright("key", 36) == F.col("prefix"))
            .groupBy(*LEVELS, "epochs", "need", "key").agg(F.sum("n_tokens").alias("t")))
    last = _reached(keys, "key").select(*LEVELS, F.col("key").alias("last_key"))
    return rows, store(leaves.join(last, list(LEVELS), "left"), "mix-plan")


def _reached(bins: DataFrame, by: str) -> DataFrame:
    """The bin of each leaf in which the tokens needed are reached, and what is
    needed within it (at most 4,096 bins of a leaf)."""
    upto = Window.partitionBy(*LEVELS).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    return (bins.withColumn("upto", F.sum("t").over(upto)).withColumn("need_left", F.col("need") - (F.col("upto") - F.col("t")))
            .where("need_left > 0 and upto >= need"))


def _copies(seed: int) -> Column:
    return (F.col("epochs") + F.coalesce((_key(seed) <= F.col("last_key")).cast("long"), F.lit(0))).cast("long")


def mix_counts(docs: DataFrame, spec: MixSpec = MixSpec(), domain=domain_of) -> DataFrame:
    """One row per document: how often it goes into the mix."""
    rows, leaves = plan_mix(docs, spec, domain)
    return (join_small(rows, leaves.drop("tokens", "rest"), list(LEVELS))
            .select("doc_id", *LEVELS, "n_tokens", F.col("budget").alias("leaf_budget"), "epochs", _copies(spec.seed).alias("copies")))


def mix(docs: DataFrame, spec: MixSpec = MixSpec(), domain=domain_of) -> DataFrame:
    """The mixed corpus: every document as often as its leaf's epochs take it,
    with the columns of ``docs``."""
    _, leaves = plan_mix(docs, spec, domain)
    leaf = fresh(docs, "mix_leaf")
    copies, nth = fresh(docs, "mix_copies"), fresh(docs, "mix_nth")
    small = leaves.select(F.struct(*LEVELS).alias(leaf), F.struct("epochs", "last_key").alias(copies))
    keyed = docs.withColumn(leaf, F.struct(*(c.alias(n) for n, c in _levels(docs, domain).items())))
    joined = join_small(keyed, small, leaf)
    text = F.concat_ws(":", F.lit(str(spec.seed)), F.col(f"{copies}.epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    key = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    times = F.col(f"{copies}.epochs") + F.coalesce((key <= F.col(f"{copies}.last_key")).cast("long"), F.lit(0))
    return (joined.withColumn(copies, times).where(F.col(copies) > 0)
            .withColumn(nth, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*docs.columns))


def oracle_sql(spec: MixSpec = MixSpec()) -> str:
    """``mix_counts`` of ``documents`` in DuckDB: the same shares level by level,
    and running sums over each leaf's keys."""
    def weight(level: str) -> str:
        known = spec.weights.get(level) or {}
        cases = "".join(f" WHEN '{k}' THEN {v}" for k, v in known.items())
        return f"(CASE {level}{cases} ELSE 1 END)" if cases else "1"

    num, den = spec.budget_share
    ctes = [f"""r AS (SELECT doc_id, coalesce('d' || (ascii(right(source, 1)) % 4), '{NONE}') AS domain, coalesce(lang, '{NONE}') AS lang,
        coalesce(source, '{NONE}') AS source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n_tokens FROM documents)""",
            "leaves AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS tokens FROM r GROUP BY ALL)",
            f"b0 AS (SELECT 0 AS root, least(sum(tokens) * {num} // {den}, sum(tokens) * {spec.max_epochs}) AS budget FROM leaves)"]
    parent = ["root"]
    for i, level in enumerate(LEVELS):
        keys = ", ".join(parent)
        source = "(SELECT *, 0 AS root FROM leaves)" if i == 0 else "leaves"
        order = f"PARTITION BY {keys} ORDER BY ratio, {level}"
        ctes += [
            f"n{i} AS (SELECT *, CASE WHEN w > 0 THEN cap / w ELSE 'inf'::DOUBLE END AS ratio FROM (SELECT {keys}, {level}, "
            f"sum(tokens)::HUGEINT * {spec.max_epochs} AS cap, {weight(level)}::HUGEINT AS w FROM {source} GROUP BY ALL) JOIN b{i} USING ({keys}))",
            f"f{i} AS (SELECT *, cap * sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= w * (budget - "
            f"coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS full_ FROM n{i})",
            f"g{i} AS (SELECT *, budget - sum(CASE WHEN full_ THEN cap ELSE 0 END) OVER (PARTITION BY {keys}) AS left_, "
            f"greatest(sum(CASE WHEN full_ THEN 0 ELSE w END) OVER (PARTITION BY {keys}), 1) AS wo, "
            f"sum(CASE WHEN full_ THEN 0 ELSE w END) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS wu FROM f{i})"]
        kept = [p for p in parent if p != "root"] + [level]
        ctes.append(f"b{i + 1} AS (SELECT {', '.join(kept)}, CASE WHEN full_ THEN cap ELSE left_ * wu // wo - left_ * (wu - w) // wo END AS budget FROM g{i})")
        parent = kept
    ctes += [
        f"""l AS (SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS epochs,
        CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest FROM leaves JOIN b{len(LEVELS)} USING (domain, lang, source))""",
        f"""k AS (SELECT r.*, l.budget, l.epochs, l.rest, CAST('0x' || substr(md5('{spec.seed}:' || l.epochs || ':' || coalesce(doc_id::VARCHAR, 'null')), 1, 15) AS BIGINT) AS key
        FROM r JOIN l USING (domain, lang, source))""",
        """u AS (SELECT domain, lang, source, rest, key, sum(sum(n_tokens)) OVER (PARTITION BY domain, lang, source ORDER BY key) - sum(n_tokens) AS before
        FROM k GROUP BY domain, lang, source, rest, key)""",
        "p AS (SELECT domain, lang, source, max(key) AS last_key FROM u WHERE before < rest GROUP BY ALL)"]
    return ("WITH " + ",\n".join(ctes) + """
SELECT doc_id, domain, lang, source, n_tokens, budget::BIGINT AS leaf_budget, epochs::BIGINT AS epochs,
  (epochs + CASE WHEN key <= last_key THEN 1 ELSE 0 END)::BIGINT AS copies FROM k LEFT JOIN p USING (domain, lang, source)""")
