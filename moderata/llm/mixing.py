"""Mixing sources to target weights by hierarchical budgeting (operator 9), DataFrame functions only.

The token budget flows down a domain - language - source tree. Siblings share
their parent's budget in proportion to their weights; what a child cannot use
(its documents times ``epochs`` hold fewer tokens) goes to its siblings, and
only what all siblings cannot use goes to the parent's siblings. Both follow
from filling each level to a common water line with the subtrees' capacities:
with siblings ordered by capacity / weight, the line is the largest
(budget - capacity of those before) / (weight of the rest), so one window per
level gives it without iteration.

A leaf that gets b of its t tokens takes b // t whole epochs and, from the
next epoch, the documents whose running sum of tokens stays within the rest.
An epoch's order is the md5 of (seed, epoch, id). The prefix ends at a cut key,
found without sorting a leaf: tokens are summed by the key's first 16 bits, and
only the one bucket that holds the cut is summed key by key.

Defined cases: tokens are words of the whole text (null or empty: 0); a null
language counts as ``und``, a null source as ``unknown``, a null id as ``null``;
rows that repeat an id share a key and are taken or left together; documents
of leaves without tokens get 0 copies; budgets are rounded down; a weight of 0
gets nothing; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SEED = 9
BUDGET_PERCENT = 60
EPOCHS = 2
DOMAIN_WEIGHTS = {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}
LANG_WEIGHTS = {"en": 4, "de": 2, "fr": 2}
SOURCE_WEIGHTS: dict[str, int] = {"src0": 2}
_WORD = r"[^\x20\x09-\x0D]+"
TREE = ["domain", "lang", "source"]


def domain_of(source: Column) -> Column:
    """Four domains by the first hex digit of the source name's md5."""
    return F.concat(F.lit("domain"), F.floor((F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(source), 1, 1)) - 1) / 4)
                    .cast("string"))


def _weight(col: Column, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for name, w in weights.items():
        out = F.when(col == name, F.lit(int(w))).otherwise(out)
    return out.cast("long")


def _tree(docs: DataFrame, lang_col: str, source_col: str) -> dict[str, Column]:
    source = F.coalesce(F.col(source_col), F.lit("unknown"))
    return {"domain": domain_of(source), "lang": F.coalesce(F.col(lang_col), F.lit("und")), "source": source}


def filled(rows: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``rows`` (parent columns, name, budget, cap, weight) with their share of the parent's budget."""
    around = Window.partitionBy(*(parent or [F.lit(0)]))
    order = around.orderBy(F.col("cap") / F.col("weight"), name)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    lined = rows.where("weight > 0").withColumn(
        "line", F.greatest(F.col("budget") - before, F.lit(0)).cast("double") / rest.cast("double"))
    return (lined.withColumn("line", F.max("line").over(around))
            .withColumn("share", F.least("cap", F.floor(F.col("weight") * F.col("line")).cast("long")))
            .drop("line"))


def budgets(leaves: DataFrame, percent: int, epochs: int, weights: dict[str, dict[str, int]]) -> DataFrame:
    """``leaves`` (domain, lang, source, tokens) with ``leaf_budget``."""
    budget = None
    for depth, name in enumerate(TREE):
        keys = TREE[:depth + 1]
        rows = (leaves.groupBy(*keys).agg((F.sum("tokens") * epochs).alias("cap"))
                .withColumn("weight", _weight(F.col(name), weights.get(name, {}))))
        if budget is None:
            total = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * percent / 100).cast("long").alias("budget"))
            rows = rows.join(F.broadcast(total))  # one row
        else:
            rows = rows.join(budget, TREE[:depth])
        budget = filled(rows, TREE[:depth], name).select(*keys, F.col("share").alias("budget"))
    return leaves.join(budget.withColumnRenamed("budget", "leaf_budget"), TREE, "left").withColumn(
        "leaf_budget", F.coalesce("leaf_budget", F.lit(0).cast("long")))


def _key(epoch: Column, doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def plan(docs: DataFrame, percent: int = BUDGET_PERCENT, epochs: int = EPOCHS, seed: int = SEED,
         weights: dict[str, dict[str, int]] | None = None, id_col: str = "doc_id", text_col: str = "text",
         lang_col: str = "lang", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, tree, n_tokens) and (leaves: tree, leaf_budget, full, cut)."""
    weights = weights or {"domain": DOMAIN_WEIGHTS, "lang": LANG_WEIGHTS, "source": SOURCE_WEIGHTS}
    told = written(docs.select(
        F.col(id_col).alias("doc_id"), *[c.alias(n) for n, c in _tree(docs, lang_col, source_col).items()],
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(_WORD)), F.lit(0)).cast("long").alias("n_tokens")), "tokens")
    leaves = written(told.groupBy(*TREE).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    leaves = budgets(leaves, percent, epochs, weights)
    full = F.when(F.col("tokens") > 0, F.floor(F.col("leaf_budget") / F.col("tokens"))).otherwise(0).cast("long")
    leaves = written(leaves.withColumn("full", full)
                     .withColumn("rest", F.col("leaf_budget") - F.col("full") * F.col("tokens")), "budgets")
    keyed = (told.join(leaves.where("rest > 0").select(*TREE, "full", "rest"), TREE)
             .withColumn("key", _key(F.col("full") + 1, F.col("doc_id"), seed))
             .withColumn("bucket", F.substring("key", 1, 4)))
    by_bucket = keyed.groupBy(*TREE, "rest", "bucket").agg(F.sum("n_tokens").alias("sum"))
    run = Window.partitionBy(*TREE).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    edge = (by_bucket.withColumn("upto", F.sum("sum").over(run)).where("upto > rest and upto - sum <= rest")
            .select(*TREE, "bucket", (F.col("rest") - F.col("upto") + F.col("sum")).alias("room")))
    inside = (keyed.join(edge, [*TREE, "bucket"]).groupBy(*TREE, "bucket", "room", "key")
              .agg(F.sum("n_tokens").alias("sum")))
    run = Window.partitionBy(*TREE, "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    ends = (inside.withColumn("upto", F.sum("sum").over(run))
            .groupBy(*TREE, "bucket").agg(F.max(F.when(F.col("upto") <= F.col("room"), F.col("key"))).alias("key"))
            .select(*TREE, F.coalesce("key", "bucket").alias("cut")))
    return told, written(leaves.join(ends, TREE, "left").select(*TREE, "leaf_budget", "full",
                                                              F.coalesce("cut", F.lit("")).alias("cut")), "plan")


def _copies(doc_id: Column, seed: int) -> Column:
    return F.col("full") + (_key(F.col("full") + 1, doc_id, seed) <= F.col("cut")).cast("long")


def mix(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """One row per document row: doc_id, tree, n_tokens, leaf_budget and copies (0: left out)."""
    told, leaves = plan(docs, seed=seed, **options)
    return (told.join(leaves, TREE).select("doc_id", *TREE, "n_tokens", "leaf_budget",
                                           _copies(F.col("doc_id"), seed).alias("copies")))


def selected(docs: DataFrame, seed: int = SEED, lang_col: str = "lang", source_col: str = "source",
             id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, all columns, that the plan takes, once per copy."""
    _, leaves = plan(docs, seed=seed, id_col=id_col, lang_col=lang_col, source_col=source_col, **options)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                      *[c.alias(n) for n, c in _tree(docs, lang_col, source_col).items()])
    return (own.join(leaves, TREE).withColumn("copies", _copies(F.col("row").getField(id_col), seed))
            .where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
            .select("row.*"))


def _sql_weight(col: str, weights: dict[str, int]) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {int(w)}" for k, w in weights.items())
    return f"CASE {col} {whens} ELSE 1 END"


def oracle_sql() -> str:
    """The same rows in DuckDB SQL: explicit water lines, and plain running sums over whole leaves."""
    levels = []
    for depth, (name, weights) in enumerate(zip(TREE, (DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS))):
        keys, parent = ", ".join(TREE[:depth + 1]), ", ".join(TREE[:depth])
        part = f"PARTITION BY {parent}" if parent else ""
        source = f"JOIN b{depth - 1} USING ({parent})" if depth else "CROSS JOIN total"
        levels.append(f"""c{depth} AS (SELECT {keys}, SUM(tokens)::BIGINT * {EPOCHS} AS cap, {_sql_weight(name, weights)} AS weight
  FROM leaves GROUP BY {keys}),
l{depth} AS (SELECT c.*, budget, GREATEST(budget - COALESCE(SUM(cap) OVER ({part} ORDER BY cap / weight, {name}
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)::DOUBLE
  / (SUM(weight) OVER ({part} ORDER BY cap / weight, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS line
  FROM c{depth} c {source}),
b{depth} AS (SELECT {keys}, LEAST(cap, FLOOR(weight * MAX(line) OVER ({part}))::BIGINT) AS budget FROM l{depth})""")
    tree = ", ".join(TREE)
    return f"""WITH told AS (SELECT doc_id, 'domain' || ((strpos('0123456789abcdef', substr(md5(COALESCE(source, 'unknown')), 1, 1)) - 1) // 4) AS domain,
  COALESCE(lang, 'und') AS lang, COALESCE(source, 'unknown') AS source,
  len(regexp_extract_all(COALESCE(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM documents),
leaves AS (SELECT {tree}, SUM(n_tokens)::BIGINT AS tokens FROM told GROUP BY {tree}),
total AS (SELECT FLOOR(SUM(tokens) * {BUDGET_PERCENT} / 100)::BIGINT AS budget FROM leaves),
{", ".join(levels)},
planned AS (SELECT l.*, budget AS leaf_budget, budget // tokens AS full_epochs, budget % tokens AS rest
  FROM leaves l JOIN b2 USING ({tree}) WHERE tokens > 0),
keyed AS (SELECT t.*, leaf_budget, full_epochs, rest,
  md5('{SEED}:' || (full_epochs + 1) || ':' || COALESCE(doc_id::VARCHAR, 'null')) AS k FROM told t JOIN planned USING ({tree})),
run AS (SELECT *, SUM(n_tokens) OVER (PARTITION BY {tree} ORDER BY k RANGE UNBOUNDED PRECEDING) AS upto FROM keyed)
SELECT doc_id, {tree}, n_tokens, leaf_budget::BIGINT AS leaf_budget,
  (full_epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM run
UNION ALL SELECT doc_id, {tree}, n_tokens, 0, 0 FROM told JOIN leaves USING ({tree}) WHERE tokens = 0"""
