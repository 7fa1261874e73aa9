"""Mixing sources to target weights over a tree of domains, languages and sources.

A leaf can give at most its tokens times `max_epochs`. From the root down, each node's budget is shared out among its
children by weight; a child that can't take its share gives the shortage to its siblings (by weight, again up to what
they can take). A node never gets more than its whole subtree can take, so a shortage leaves the siblings for
the ancestors only when all of them are full. Shares are whole tokens, rounded down.

A leaf's budget is spent on whole epochs and then on a token-prefix of the next one: its documents in the order of
md5(seed:epoch:doc_id), up to the last that fits.

Scale: one narrow pass counts tokens; the leaves are a small table, shared out with window functions over one parent's
children. The prefix is found in two levels: sums of 4096 key ranges of a leaf, then the order within the one range where the
budget ends, so a leaf with a third of all rows is never sorted in one task. Each leaf's plan is a number of
epochs and a cut-off key; choosing documents is a lookup in that table, and texts are not moved where it is small enough
to be broadcast (Spark's own size check).

Defined cases: a null domain, language or source is the name `unknown`; unlisted names have weight 1; a null or empty
text has no tokens and comes with the prefix that reaches its key; rows with equal doc_id share one key and are taken
together; a leaf without tokens has no epochs and no documents; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, written

LEVELS = ["domain", "lang", "source"]
#: Production parameters of the query and the pipeline; names not listed have weight 1.
WEIGHTS = {"domain": {"web": 2, "reference": 3}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}, "source": {}}
#: Sources whose name ends in one of these digits are of the domain web, the others of reference.
WEB_DIGITS = "01234"
SEED, RANGE_DIGITS = 17, 3
#: Parts into which the rows of a leaf are dealt where they meet its plan.
SALTS = 32


def leaf_columns(docs: DataFrame, text_col: str = "text") -> list[Column]:
    source = F.coalesce(F.col("source"), F.lit("unknown"))
    domain = F.when(F.substring(source, -1, 1).isin(*WEB_DIGITS), "web").otherwise("reference")
    tokens = F.size(F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), SPACES), lambda w: w != "")).cast("long")
    return [domain.alias("domain"), F.coalesce("lang", F.lit("unknown")).alias("lang"), source.alias("source"), tokens.alias("tokens")]


def order_key(epoch: Column, seed: int = SEED) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def shared(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """children (parent, name, weight, most, budget of the parent) with `share`: integer water-filling among siblings."""
    siblings = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    rising = siblings.orderBy(F.col("most") / F.col("weight"), name).rowsBetween(Window.unboundedPreceding, -1)
    before = children.withColumn("_c", F.coalesce(F.sum("most").over(rising), F.lit(0))).withColumn("_w", F.sum("weight").over(siblings) - F.coalesce(F.sum("weight").over(rising), F.lit(0)))
    full = before.withColumn("_full", F.col("most") * F.col("_w") <= F.col("weight") * (F.col("budget") - F.col("_c")))
    left = F.col("budget") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("most"))).over(siblings), F.lit(0))
    open_weight = F.sum(F.when(~F.col("_full"), F.col("weight"))).over(siblings)
    rest = full.withColumn("_left", left).withColumn("_open", open_weight)
    share = F.when(F.col("_full"), F.col("most")).otherwise(F.expr("weight * _left div _open"))
    return rest.withColumn("share", share).drop("_c", "_w", "_full", "_left", "_open")


def _weight(level: str, weights: dict) -> Column:
    out = F.lit(1)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, F.lit(w)).otherwise(out)
    return out.cast("long").alias("weight")


def leaf_budgets(leaves: DataFrame, budget: Column, weights: dict = WEIGHTS, max_epochs: int = 4, levels: list[str] = LEVELS) -> DataFrame:
    """leaves (levels, tokens) with their token budgets. `budget` is the root's: a column over the sum `tokens` of all leaves."""
    capable = leaves.withColumn("most", F.col("tokens") * max_epochs)
    root = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).select(budget.cast("long").alias("budget"))
    given = root
    for k, level in enumerate(levels):
        path = levels[: k + 1]
        nodes = capable.groupBy(*path).agg(F.sum("most").alias("most")).withColumn("weight", _weight(level, weights))
        fitted = nodes.join(given, path[:-1]) if k else nodes.crossJoin(given)  # the root is one row
        given = shared(fitted, path[:-1], level).select(*path, F.col("share").alias("budget"))
    return leaves.join(given, levels)


def with_leaf(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """rows joined to their leaf; a leaf's row is there once for each of SALTS parts of its rows (any part serves any row)."""
    salted = leaves.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(salted, [*LEVELS, "_salt"]).drop("_salt")


def leaf_plan(counted: DataFrame, budget: Column, weights: dict = WEIGHTS, max_epochs: int = 4, seed: int = SEED) -> DataFrame:
    """(levels, tokens, budget, epochs, cut): take each document `epochs` times, and once more if its key is not above `cut`."""
    leaves = counted.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    budgets = written(leaf_budgets(leaves, budget, weights, max_epochs), "budgets")
    epochs = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0))
    plan = budgets.select(*LEVELS, F.col("tokens").alias("leaf_tokens"), "budget", epochs.alias("epochs")).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("leaf_tokens"))
    keyed = with_leaf(counted, plan.filter("leaf_tokens > 0").select(*LEVELS, "epochs", "rest")).select(*LEVELS, "tokens", "rest", order_key(F.col("epochs"), seed).alias("key"))
    ranged = keyed.withColumn("part", F.substring("key", 1, RANGE_DIGITS))
    parts = ranged.groupBy(*LEVELS, "part").agg(F.sum("tokens").alias("sum"), F.first("rest").alias("rest"))
    upto = F.sum("sum").over(Window.partitionBy(*LEVELS).orderBy("part"))
    last = parts.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("sum")).filter("upto > rest")
    edge = written(last.groupBy(*LEVELS).agg(F.min_by(F.struct("part", "before"), "part").alias("e")).select(*LEVELS, "e.part", "e.before"), "edge")
    inside = ranged.join(edge, [*LEVELS, "part"])
    reach = F.col("before") + F.sum("tokens").over(Window.partitionBy(*LEVELS).orderBy("key"))
    cut = inside.withColumn("reach", reach).filter("reach <= rest").groupBy(*LEVELS).agg(F.max("key").alias("cut"))
    return plan.join(edge, LEVELS, "left").join(cut, LEVELS, "left").select(*LEVELS, "leaf_tokens", "budget", "epochs", F.coalesce("cut", "part").alias("cut"))


def copies(counted: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    """counted with copies, the number of times that its document is taken, and the leaf's budget."""
    chosen = F.col("cut").isNotNull() & (order_key(F.col("epochs"), seed) <= F.col("cut"))
    return with_leaf(counted, plan).withColumn("copies", F.col("epochs") + F.when(chosen, 1).otherwise(0))


def mix_plan(docs: DataFrame, budget: Column, weights: dict = WEIGHTS, max_epochs: int = 4) -> DataFrame:
    counted = docs.select("doc_id", *leaf_columns(docs))
    return copies(written(counted, "counted"), leaf_plan(counted, budget, weights, max_epochs))


def mixed(docs: DataFrame, budget: Column, weights: dict = WEIGHTS, max_epochs: int = 4) -> DataFrame:
    """docs, each row as often as it is taken, with its own columns only."""
    counted = written(docs.select("doc_id", *leaf_columns(docs)), "counted")
    plan = written(leaf_plan(counted, budget, weights, max_epochs), "plan")
    names = docs.columns
    whole = docs.select(F.struct(*names).alias("_row"), "doc_id", *leaf_columns(docs)[:3])
    taken = copies(whole, plan).filter("copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_k")).select(*[F.col("_row").getField(n).alias(n) for n in names])


def digest(docs: DataFrame) -> DataFrame:
    """The op8 result: half of all tokens, at most 4 epochs of a leaf; every document with its copies."""
    counted = written(docs.select("doc_id", *leaf_columns(docs)), "counted")
    plan = leaf_plan(counted, F.expr("tokens div 2"))
    return copies(counted, plan).select("doc_id", *LEVELS, "tokens", F.col("budget").alias("leaf_budget"), "copies")
