"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions only.

Documents hang in a tree: domain, language, source. The whole budget of tokens is
shared among the domains by their weights, each domain's among its languages, each
language's among its sources. No node gets more than its documents give in the
allowed epochs; what a node cannot use goes to its siblings by their weights, and
only what a whole subtree cannot use goes to the siblings of its ancestor. A leaf
takes whole epochs as long as they fit, and of the next one a prefix of the
documents in an order that is drawn anew for each epoch from the seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.llm.common import measured, settle, unused

LEVELS = ("domain", "language", "source")
SEED = "mix-1"
MAX_EPOCHS = 3
#: Documents of a leaf that a bucket of the drawn order holds on average, and the most buckets of a leaf.
BUCKET_ROWS, MOST_BUCKETS = 1000, 65536
#: Weights that differ from 1, by level and name. The domain is the source's number modulo 4.
WEIGHTS = {"domain": {"domain0": 4, "domain1": 3, "domain2": 2}, "language": {"en": 5, "de": 2, "fr": 2}, "source": {}}
NONE = "none"


def domain_of(source: Column) -> Column:
    """The domain that a source name stands for: ``domain`` and the number it ends in, modulo 4; ``none`` without a number."""
    number = F.regexp_extract(source, r"(\d{1,9})$", 1).try_cast("int")
    return F.coalesce(F.concat(F.lit("domain"), F.pmod(number, F.lit(4)).cast("string")), F.lit(NONE))


def words(text: Column) -> Column:
    """Number of words of a text, null: 0. The tokens of this operator."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(id_text: Column, epoch: Column, seed: str) -> Column:
    """A document's place in an epoch's order: a digest in hex."""
    return F.md5(F.concat_ws("|", F.lit(seed), epoch.cast("string"), id_text).cast("binary"))


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    named = weights.get(level, {})
    if not named:
        return F.lit(1).cast("long")
    table = F.create_map(*[F.lit(x) for pair in named.items() for x in pair])
    return F.coalesce(F.element_at(table, F.col(level)), F.lit(1)).cast("long")


def share_out(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """``nodes`` (with cap, weight, budget of the parent) with ``given``: budgets of siblings under a common level.

    Siblings whose cap per weight is at most the level get their cap, the others the
    level times their weight. In order of cap per weight, the level is what is left
    over after the caps before, per weight that is left, at the first sibling whose
    cap is above it.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), nodes.columns[len(parent)])
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    leveled = nodes.withColumn("level", (F.col("budget") - before) / rest).withColumn("full", F.col("cap") / F.col("weight") <= F.col("level"))
    common = F.max(F.when(~F.col("full"), F.col("level"))).over(Window.partitionBy(*parent))
    return leveled.withColumn("given", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(common * F.col("weight"))).drop("level", "full")


def budgets(leaves: DataFrame, total: Column, weights: dict[str, dict[str, int]] = WEIGHTS) -> DataFrame:
    """(domain, language, source, given): the tokens each leaf shall give.

    ``leaves`` has a row per leaf with the tokens it can give, cap. ``total`` is an
    expression over ``all_tokens``, the sum of the column have. Nodes of weight 0 and
    all below them get nothing.
    """
    weight = F.lit(1)
    for level in LEVELS:
        weight = weight * F.least(F.lit(1), _weight(level, weights))
    usable = leaves.where((weight > 0) & (F.col("cap") > 0))
    root = leaves.agg(F.coalesce(F.sum("have"), F.lit(0)).alias("all_tokens")).select(F.lit(0).alias("root"), total.cast("double").alias("budget"))
    above, keys = root, ["root"]
    for i, level in enumerate(LEVELS):
        named = [*LEVELS[: i + 1]]
        nodes = usable.groupBy(*named).agg(F.sum("cap").alias("cap")).withColumn("root", F.lit(0)).withColumn("weight", _weight(level, weights))
        parents = F.broadcast(above) if level == LEVELS[0] else above
        joined = nodes.join(parents, keys).select(*keys, level, "cap", "weight", "budget")
        above = share_out(joined, keys).select(*keys, level, F.col("given").alias("budget"))
        keys = [*keys, level]
    return above.select(*LEVELS, F.floor(F.col("budget") + F.lit(1e-6)).alias("given"))


def mixing_plan(rows: DataFrame, total: Column, max_epochs: int = MAX_EPOCHS, seed: str = SEED, weights: dict[str, dict[str, int]] = WEIGHTS) -> DataFrame:
    """A row per leaf: its names, given, epochs (whole ones) and last (the largest draw of the partial epoch that is taken, or null).

    ``rows`` (domain, language, source, id_text, tokens) is a written table. Sums run
    over buckets of the drawn order first, and only the bucket in which a leaf's
    budget ends is looked at row by row; so a leaf of any size is spread over tasks.
    """
    leaves = settle(rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("have"), F.count("*").alias("docs")).withColumn("cap", F.col("have") * max_epochs), "leaves")
    given = leaves.join(budgets(leaves, total, weights), [*LEVELS])
    given = given.withColumn("epochs", F.floor(F.col("given") / F.col("have"))).withColumn("rest", F.col("given") - F.col("epochs") * F.col("have"))
    buckets = F.least(F.lit(MOST_BUCKETS), F.greatest(F.lit(1), F.ceil(F.col("docs") / BUCKET_ROWS)))
    given = settle(given.withColumn("buckets", buckets.cast("long")), "leaves")

    drawn = rows.join(measured(given.where("rest > 0").select(*LEVELS, "epochs", "rest", "buckets")), [*LEVELS]).withColumn("draw", draw(F.col("id_text"), F.col("epochs"), seed))
    drawn = drawn.withColumn("bucket", F.floor(F.conv(F.substring("draw", 1, 8), 16, 10).cast("long") * F.col("buckets") / F.lit(float(1 << 32))).cast("long"))
    sums = drawn.groupBy(*LEVELS, "bucket").agg(F.sum("tokens").alias("tokens"), F.first("rest").alias("rest"), F.max("draw").alias("last"))
    running = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = settle(sums.withColumn("upto", F.sum("tokens").over(running)), "buckets")
    whole = sums.where("upto <= rest").groupBy(*LEVELS).agg(F.max("last").alias("last"))
    cut = sums.where("upto > rest and upto - tokens < rest").select(*LEVELS, "bucket", (F.col("rest") - F.col("upto") + F.col("tokens")).alias("room"))
    inside = drawn.drop("rest").join(measured(settle(cut, "buckets")), [*LEVELS, "bucket"])
    peers = Window.partitionBy(*LEVELS).orderBy("draw").rangeBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("upto", F.sum("tokens").over(peers)).where("upto <= room").groupBy(*LEVELS).agg(F.max("draw").alias("last"))
    last = whole.unionByName(inside).groupBy(*LEVELS).agg(F.max("last").alias("last"))
    return given.join(last, [*LEVELS], "left").select(*LEVELS, "have", "given", "epochs", "last")


def mix(docs: DataFrame, total: Column, max_epochs: int = MAX_EPOCHS, seed: str = SEED, weights: dict[str, dict[str, int]] = WEIGHTS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Rows of ``docs``, all columns, once for each epoch they are taken in, and epoch, tokens and draw.

    ``total`` is the whole budget, an expression over ``all_tokens``. A leaf takes its
    documents whole: in the partial epoch those whose running sum of tokens, in the
    order of the draws, is within the budget. Documents without words cost nothing
    and come with the draws before the last one taken. A null language or source
    belongs to the node ``none``. Rows with the same id have the same draw and are
    taken together or not at all; a null id counts as an empty one. Columns named
    epoch, tokens, draw, domain or language are replaced. An empty table gives an
    empty table.
    """
    id_text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    temporary = unused(docs, "_domain", "_language", "_source", "_id", "_epochs", "_last", "_next")
    *leaf, own_id, whole, last, following = temporary
    names = (domain_of(F.col(source_col).cast("string")), F.coalesce(F.col(lang_col).cast("string"), F.lit(NONE)), F.coalesce(F.col(source_col).cast("string"), F.lit(NONE)), id_text)
    tree = docs.withColumns(dict(zip([*leaf, own_id], names, strict=True)))
    rows = settle(tree.select(*[F.col(x).alias(level) for x, level in zip(leaf, LEVELS, strict=True)], F.col(own_id).alias("id_text"), words(F.col(text_col).cast("string")).alias("tokens")), "rows")
    plan = settle(mixing_plan(rows, total, max_epochs, seed, weights), "plan")
    plan = plan.select(*[F.col(level).alias(x) for x, level in zip(leaf, LEVELS, strict=True)], F.col("epochs").alias(whole), F.col("last").alias(last))
    taken = tree.join(measured(plan), leaf).withColumn(following, draw(F.col(own_id), F.col(whole), seed))
    epochs = F.col(whole) + F.when(F.col(following) <= F.col(last), 1).otherwise(0)
    taken = taken.withColumn("epoch", F.explode(F.when(epochs > 0, F.sequence(F.lit(0).cast("long"), epochs - 1)).otherwise(F.array().cast("array<long>"))))
    taken = taken.withColumn("draw", draw(F.col(own_id), F.col("epoch"), seed)).withColumn("tokens", words(F.col(text_col).cast("string")))
    return taken.withColumn("domain", F.col(leaf[0])).withColumn("language", F.col(leaf[1])).drop(*temporary)
