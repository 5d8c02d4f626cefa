"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

Sources are the leaves of a tree (domain, language, source). A token budget goes down the tree: a node's budget is
dealt to its children in proportion to their weights, but to none more than its subtree can supply (its tokens times
``max_epochs``). What a child can't use goes to its siblings first, by their weights; only what all siblings
together can't use reaches the next ancestor's siblings, because the node's own budget was held to its supply before.
The split is exact in integers: children are taken in the order of supply per weight; those that are filled form a
prefix, and the rest share what is left by cumulative rounding.

A leaf with budget b and t tokens gives b div t whole epochs, and of the next epoch the prefix of documents, in an order
seeded by (seed, epoch, id), whose running total of tokens stays within the rest. Running totals don't put a leaf into
one task: tokens are summed by cells of the order first, cells below the boundary cell are taken whole, and only
the rows of the boundary cell (a 4096th of the leaf) are ordered one by one.

Tokens are words, ``[^\\x20\\x09-\\x0D]+``.

Defined results: null sources and languages are leaves of their own ("?"); a null text has no tokens; texts without
tokens go with the prefix at their place; an empty table gives an empty result; repeated rows count each on its
own; further columns stay as they are (names that begin with ``_mix_`` are reserved).
"""

from __future__ import annotations

from collections.abc import Mapping
from math import lcm

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialise, table

LEVELS = ("_mix_domain", "_mix_lang", "_mix_source")
CELL_DIGITS = 3
#: Production parameters: sources carry equal weights, domains and languages these (others 1).
WEIGHTS: dict[str, dict[str, int]] = {"_mix_domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "_mix_lang": {"en": 4, "de": 2, "fr": 2, "es": 2}, "_mix_source": {}}
SHARE, MAX_EPOCHS, SEED = (3, 5), 2, 17


def tokens(text: Column) -> Column:
    words = F.btrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(words == "", F.lit(0)).otherwise(F.size(F.split(words, r"[\x20\x09-\x0D]+", -1))).cast("long")


def with_leaves(docs: DataFrame) -> DataFrame:
    """The tree of documents: a source's domain is made from its name's last character."""
    source = F.coalesce(F.col("source").cast("string"), F.lit("?"))
    return docs.withColumns({
        "_mix_domain": F.concat(F.lit("d"), (F.ascii(F.right(source, F.lit(1))) % 4).cast("string")),
        "_mix_lang": F.coalesce(F.col("lang").cast("string"), F.lit("?")),
        "_mix_source": source,
    })


def scale(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    """The least common multiple of a level's weights, divided by a node's."""
    named = weights.get(level) or {}
    every = lcm(*map(int, named.values()))
    out = F.lit(every)
    for name, w in named.items():
        out = F.when(F.col(level) == name, F.lit(every // int(w))).otherwise(out)
    return out.cast("decimal(18,0)")


def weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    named = weights.get(level) or {}
    out = F.lit(1)
    for name, w in named.items():
        out = F.when(F.col(level) == name, F.lit(int(w))).otherwise(out)
    return out.cast("decimal(38,0)")


def deal(nodes: DataFrame, parent: list[str], level: str) -> DataFrame:
    """(…, budget): each parent's ``_budget`` dealt to its children (level, cap, weight)."""
    siblings = Window.partitionBy(*(parent or [F.lit(0)]))
    order = siblings.orderBy(F.expr("cap * scale"), level)  # by supply per weight, in integers
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("decimal(38,0)")
    x = nodes.withColumn("used", F.coalesce(F.sum("cap").over(before), zero))
    x = x.withColumn("share", F.sum("weight").over(siblings) - F.coalesce(F.sum("weight").over(before), zero))
    x = x.withColumn("filled", F.expr("cap * share <= (_budget - used) * weight"))
    x = x.withColumn("rest", F.col("_budget") - F.sum(F.when(F.col("filled"), F.col("cap")).otherwise(zero)).over(siblings))
    x = x.withColumn("open", F.when(F.col("filled"), zero).otherwise(F.col("weight")))
    x = x.withColumn("all", F.sum("open").over(siblings)).withColumn("upto", F.sum("open").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    part = F.expr("(rest * upto) div all - (rest * (upto - open)) div all").cast("decimal(38,0)")
    return x.withColumn("budget", F.when(F.col("filled"), F.col("cap")).otherwise(F.least("cap", part)))


def budgets(leaves: DataFrame, weights: Mapping[str, Mapping[str, int]], share: tuple[int, int], max_epochs: int) -> DataFrame:
    """(levels, supply, budget) for leaves of (levels, supply)."""
    leaves = leaves.withColumn("cap", (F.col("supply") * max_epochs).cast("decimal(38,0)"))
    total = leaves.agg(F.least(F.sum("cap"), F.expr(f"(coalesce(sum(supply), 0) * {share[0]}) div {share[1]}")).cast("decimal(38,0)").alias("_budget"))
    above: DataFrame | None = None
    for k, level in enumerate(LEVELS):
        own = leaves.groupBy(*LEVELS[: k + 1]).agg(F.sum("cap").cast("decimal(38,0)").alias("cap"))
        own = own.withColumn("weight", weight(level, weights)).withColumn("scale", scale(level, weights))
        own = own.crossJoin(F.broadcast(total)) if above is None else own.join(above, list(LEVELS[:k]))  # total is one row
        above = deal(own, list(LEVELS[:k]), level).select(*LEVELS[: k + 1], F.col("budget").alias("_budget"))
    return leaves.join(above, list(LEVELS)).select(*LEVELS, "supply", F.col("_budget").cast("long").alias("budget"))


def seeded(seed: int, epoch: Column, key: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), epoch, F.coalesce(key.cast("string"), F.lit("?"))))


def mix(docs: DataFrame, id_col: str = "doc_id", *, weights: Mapping[str, Mapping[str, int]] = WEIGHTS, share: tuple[int, int] = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """``docs`` (with the columns of LEVELS and ``_mix_tokens``) with ``_mix_copies``, how many times a row is taken."""
    leaf = list(LEVELS)
    small = materialise(docs.select(F.col(id_col).alias("_mix_id"), *leaf, "_mix_tokens"), "mix-rows")
    plan = budgets(small.groupBy(*leaf).agg(F.sum("_mix_tokens").alias("supply")), weights, share, max_epochs)
    whole = F.when(F.col("supply") > 0, F.expr("budget div supply")).otherwise(F.lit(0))
    plan = plan.withColumn("_mix_whole", whole).withColumn("_mix_rest", F.col("budget") - F.col("_mix_whole") * F.col("supply"))
    budgeted = plan = materialise(plan.select(*leaf, "supply", "budget", "_mix_whole", "_mix_rest"), "mix-budgets")
    key = seeded(seed, F.col("_mix_whole"), F.col("_mix_id"))
    cells = small.join(plan, leaf).groupBy(*leaf, "_mix_rest", F.substring(key, 1, CELL_DIGITS).alias("cell")).agg(F.sum("_mix_tokens").alias("n"))
    by_leaf = Window.partitionBy(*leaf).orderBy("cell")
    cells = cells.withColumn("upto", F.sum("n").over(by_leaf))
    edge = cells.filter(F.col("upto") > F.col("_mix_rest")).groupBy(*leaf).agg(F.min("cell").alias("_mix_edge"), F.min_by(F.col("upto") - F.col("n"), "cell").alias("_mix_below"))
    plan = materialise(plan.join(edge, leaf, "left").select(*leaf, "budget", "_mix_whole", "_mix_rest", F.coalesce("_mix_edge", F.lit("~")).alias("_mix_edge"), F.coalesce("_mix_below", F.lit(0)).alias("_mix_below")), "mix-plan")
    discard(small, budgeted)
    rows = docs.join(plan.withColumnRenamed("budget", "_mix_budget"), leaf)
    rows = rows.withColumn("_mix_key", seeded(seed, F.col("_mix_whole"), F.col(id_col))).withColumn("_mix_cell", F.substring("_mix_key", 1, CELL_DIGITS))
    sure = rows.filter(F.col("_mix_cell") != F.col("_mix_edge")).withColumn("_mix_in", F.col("_mix_cell") < F.col("_mix_edge"))
    one_by_one = Window.partitionBy(*leaf, "_mix_cell").orderBy("_mix_key", id_col).rowsBetween(Window.unboundedPreceding, 0)
    tight = rows.filter(F.col("_mix_cell") == F.col("_mix_edge")).withColumn("_mix_in", F.sum("_mix_tokens").over(one_by_one) + F.col("_mix_below") <= F.col("_mix_rest"))
    both = sure.unionByName(tight)
    return both.withColumn("_mix_copies", (F.col("_mix_whole") + F.col("_mix_in").cast("long")).cast("int"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, *, share: tuple[int, int] = (9, 10)) -> DataFrame:
    """Each document as often as it is taken, with all its columns."""
    taken = mix(with_leaves(docs).withColumn("_mix_tokens", tokens(F.col("text"))), share=share).filter("_mix_copies > 0")
    return taken.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies")))).select(*docs.columns)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_leaves(table(spark, sf_dir, "documents")).select("doc_id", *LEVELS, tokens(F.col("text")).alias("_mix_tokens"))
    out = mix(docs)
    names = {"_mix_domain": "domain", "_mix_lang": "lang", "_mix_source": "source", "_mix_tokens": "tokens", "_mix_budget": "leaf_budget", "_mix_copies": "copies"}
    return out.select("doc_id", *[F.col(k).alias(v) for k, v in names.items()])


def _level_sql(k: int) -> str:
    cols, parent, level = ["domain", "lang", "source"][: k + 1], ["domain", "lang", "source"][:k], ["domain", "lang", "source"][k]
    named = WEIGHTS[f"_mix_{level}"]
    w = "CASE " + " ".join(f"WHEN {level} = '{n}' THEN {v}" for n, v in named.items()) + " ELSE 1 END" if named else "1"
    up = "total" if not k else f"b{k - 1}"
    join = "CROSS JOIN total" if not k else f"JOIN {up} USING ({', '.join(parent)})"
    by = f"PARTITION BY {', '.join(parent)}" if parent else ""
    names, order = ", ".join(cols), f"CAST(cap AS DOUBLE) / CAST(weight AS DOUBLE), {level}"
    return f"""
n{k} AS (SELECT g.*, {w} AS weight, budget AS parent_budget FROM
  (SELECT {names}, CAST(sum(cap) AS HUGEINT) AS cap FROM leaves GROUP BY {names}) g {join}),
o{k} AS (SELECT *, coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
  sum(weight) OVER ({by}) - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS share
  FROM n{k} WINDOW w AS ({by} ORDER BY {order})),
f{k} AS (SELECT *, cap * share <= (parent_budget - used) * weight AS filled FROM o{k}),
r{k} AS (SELECT *, parent_budget - sum(CASE WHEN filled THEN cap ELSE 0 END) OVER ({by}) AS rest,
  CASE WHEN filled THEN 0 ELSE weight END AS open FROM f{k}),
p{k} AS (SELECT *, sum(open) OVER ({by}) AS all_open, sum(open) OVER ({by} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM r{k}),
b{k} AS (SELECT {names}, CASE WHEN filled THEN cap ELSE least(cap, (rest * upto) // all_open - (rest * (upto - open)) // all_open) END AS budget FROM p{k})"""


def mixing_sql(docs: str, share: tuple[int, int]) -> str:
    return rf"""
d AS (SELECT doc_id, 'd' || CAST(ascii(right(coalesce(source, '?'), 1)) % 4 AS VARCHAR) AS domain, coalesce(lang, '?') AS lang,
  coalesce(source, '?') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens FROM {docs}),
leaves AS (SELECT domain, lang, source, CAST(sum(tokens) AS HUGEINT) AS supply, CAST(sum(tokens) * {MAX_EPOCHS} AS HUGEINT) AS cap FROM d GROUP BY ALL),
total AS (SELECT least(sum(cap), (sum(supply) * {share[0]}) // {share[1]}) AS budget FROM leaves),
{",".join(_level_sql(k) for k in range(3))},
plan AS (SELECT domain, lang, source, CAST(budget AS BIGINT) AS budget, CASE WHEN supply > 0 THEN CAST(budget // supply AS BIGINT) ELSE 0 END AS whole,
  CASE WHEN supply > 0 THEN CAST(budget % supply AS BIGINT) ELSE CAST(budget AS BIGINT) END AS rest FROM b2 JOIN leaves USING (domain, lang, source)),
mixed AS (SELECT doc_id, domain, lang, source, tokens, budget AS leaf_budget,
  CAST(whole + CASE WHEN sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{SEED}:' || whole || ':' || doc_id), doc_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= rest THEN 1 ELSE 0 END AS INT) AS copies
  FROM d JOIN plan USING (domain, lang, source))"""


OP7_SQL = f"WITH {mixing_sql('documents', SHARE)} SELECT * FROM mixed"
