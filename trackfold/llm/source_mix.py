"""Mix sources to target weights with a multivariate-hypergeometric splitting tree.

1. Targets: sources, by code point of their name and null last, weigh ``weights`` in turn and
   share the words of all documents; no target is above ``cap`` times its source's size, what is
   cut off goes to the others by weight.
2. Blocks: documents of a source in the order of a hash are cut, by prefixes of the hash, into
   blocks of about ``block_words``. A source is drawn in whole passes over its blocks and one
   more pass up to the document at which the target is met. That fixes exact block quotas.
3. Tree: the quotas are split among the output shards. At each node the blocks of all sources,
   put into random order, are dealt to the left child up to its share, so a child's counts are
   multivariate hypergeometric. Only quotas (one row per node and source) go down the tree.
4. Draw: a shard's quota of a source is the next stretch of the source's permuted blocks, so
   shards are disjoint. Documents are put into random order inside their shard.

All randomness is a hash of ids and ``seed``: reruns agree. Sums run in two steps, over blocks
and inside blocks, so no source meets in one task.

Null sources are a source of their own, named last. Null or blank texts have no words and are
not drawn. An id that repeats: each of its rows is a document of its own; the query's ``taken``
sums up per id and size. Empty table: empty result.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackfold.llm.base import bounded, words
from trackfold.session import cut

WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK_WORDS = 50_000
SHARD_WORDS = 2_000_000
SEED = "mix"
SLOTS = 64


def running(rows: DataFrame, group: list[str], slot: str, order: list[str], value: Column) -> DataFrame:
    """Add ``before``: the sum of ``value`` over the group's rows with a smaller (slot, order).

    Sums of whole slots first, then inside each slot: a group is spread over its slots.
    """
    slots = rows.groupBy(*group, slot).agg(F.sum(value).alias("_in"))
    over = Window.partitionBy(*group).orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select(
        *[F.col(g).alias(f"_{g}") for g in group], F.col(slot).alias("_slot"),
        F.coalesce(F.sum("_in").over(over), F.lit(0)).alias("_lead"))
    same = rows[slot] == F.col("_slot")
    for g in group:
        same = same & rows[g].eqNullSafe(F.col(f"_{g}"))
    inside = Window.partitionBy(*group, slot).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.join(slots, same)
        .withColumn("before", F.col("_lead") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_lead", "_slot", *[f"_{g}" for g in group])
    )


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Per source: ``source, source_size, target``. Works on one row per source.

    Sources sorted by the share at which they reach their cap: each one before the first that
    keeps below its cap is held at it, the others share what is left by weight.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(named) - 1) % len(weights) + 1)
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    each = each.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * cap).alias("most"))
    full_at = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = full_at.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(full_at.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    level = (left - F.coalesce(F.sum("most").over(upto), F.lit(0))) / F.sum("weight").over(
        full_at.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    each = each.withColumn("level", level).withColumn("at", F.row_number().over(full_at))
    free = F.col("most") > F.col("level") * F.col("weight")
    first = F.min(F.when(free, F.struct("at", "level"))).over(Window.partitionBy())
    share = F.col("weight") * first["level"]
    return each.select(
        "source", "source_size",
        F.when(share < F.col("most"), share).otherwise(F.col("most").cast("double")).alias("target"))


def _split(nodes: DataFrame, seed: str) -> DataFrame:
    """One level of the tree: every node with several leaves becomes its two children."""
    inner = nodes.filter("leaves > 1")
    totals = inner.groupBy("node", "leaves").agg(F.sum("quota").alias("total"))
    left_leaves = F.floor(F.col("leaves") / 2)
    totals = totals.select(
        F.col("node").alias("_node"), F.round(F.col("total") * left_leaves / F.col("leaves")).alias("go_left"))
    units = (
        inner.select("node", "source", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("quota"))).alias("unit"))
        .withColumn("key", F.xxhash64(F.lit(seed), "node", "source", "unit"))
        .withColumn("slot", F.pmod("key", F.lit(SLOTS)))
    )
    ranked = running(units, ["node"], "slot", ["key", "source", "unit"], F.lit(1))
    lefts = (
        ranked.join(totals, F.col("node") == F.col("_node"))
        .filter(F.col("before") < F.col("go_left"))
        .groupBy(F.col("node").alias("_node"), F.col("source").alias("_source")).agg(F.count(F.lit(1)).alias("lefts"))
    )
    both = inner.join(
        lefts, (F.col("node") == F.col("_node")) & F.col("source").eqNullSafe(F.col("_source")), "left"
    ).withColumn("lefts", F.coalesce("lefts", F.lit(0)))
    child = F.explode(F.array(
        F.struct((F.col("node") * 2).alias("node"), F.col("first").alias("first"), left_leaves.alias("leaves"),
                 F.col("lefts").alias("quota")),
        F.struct((F.col("node") * 2 + 1).alias("node"), (F.col("first") + left_leaves).alias("first"),
                 (F.col("leaves") - left_leaves).alias("leaves"), (F.col("quota") - F.col("lefts")).alias("quota")),
    ))
    children = both.select("source", child.alias("c")).select("c.node", "c.first", "c.leaves", "source", "c.quota")
    return children.filter("quota > 0").unionByName(nodes.filter("leaves = 1"))


def quotas_by_shard(quotas: DataFrame, shards: int, seed: str = SEED) -> DataFrame:
    """Split ``source, quota`` among shards: ``shard, source, quota``."""
    nodes = quotas.select(
        F.lit(1).cast("bigint").alias("node"), F.lit(0).cast("bigint").alias("first"),
        F.lit(shards).cast("bigint").alias("leaves"), "source", F.col("quota").cast("bigint").alias("quota"))
    for _ in range(ceil(shards - 1).bit_length()):
        nodes = cut(_split(nodes, seed))
    return nodes.select(F.col("first").alias("shard"), "source", "quota")


def source_mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple = WEIGHTS, cap: int = CAP, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS,
    seed: str = SEED,
) -> tuple[DataFrame, DataFrame]:
    """The mix as two tables.

    ``sizes``: every document with ``doc_id, source, size, row, source_size, target``.
    ``draws``: one row per drawn copy with ``row, doc_id, mark, copy, shard, position``.
    ``row`` numbers the rows of ``sizes``; ``mark`` is a hash of the document's whole row.
    """
    hashed = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    sizes = cut(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
            F.size(words(F.col(text_col))).cast("bigint").alias("size"), F.xxhash64("*").alias("mark"))
        .withColumn("hash", hashed).withColumn("row", F.monotonically_increasing_id())
    )
    targets = cut(source_targets(sizes, weights, cap))
    # as many leading bits of the hash as give blocks of the wanted size
    bits = F.greatest(F.ceil(F.log2(F.greatest(F.col("source_size"), F.lit(1)) / block_words)), F.lit(0))
    wanted = targets.select(
        F.col("source").alias("_source"), "source_size", "target", bits.cast("int").alias("bits"),
        F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).alias("passes"),
    ).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    placed = sizes.join(bounded(wanted), sizes["source"].eqNullSafe(F.col("_source"))).drop("_source")
    prefix = F.conv(F.substring("hash", 1, 8), 16, 10).cast("bigint")
    placed = placed.withColumn("block", F.floor(prefix / F.pow(F.lit(2.0), 32 - F.col("bits"))))
    drawn = running(placed.filter("size > 0"), ["source"], "block", ["hash", "row"], F.col("size"))
    # of the last pass: up to the document that brings the sum nearest to the target
    drawn = cut(drawn.withColumn("copies", F.col("passes") + (F.col("before") + F.col("size") / 2 <= F.col("rest")).cast("bigint")))

    blocks = drawn.groupBy("source", "block").agg(F.max("copies").alias("copies"))
    in_source = Window.partitionBy("source").orderBy("block")
    blocks = blocks.withColumn("rank", F.row_number().over(in_source) - 1)
    each_source = blocks.groupBy("source").agg(F.sum("copies").alias("quota"), F.count(F.lit(1)).alias("n_blocks"))
    blocks, each_source = cut(blocks), cut(each_source)
    total = sizes.agg(F.sum("size")).first()[0] or 0
    shards = max(1, ceil(total / shard_words))
    leaves = quotas_by_shard(each_source.filter("quota > 0").select("source", "quota"), shards, seed)
    stretch = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    leaves = leaves.withColumn("start", F.coalesce(F.sum("quota").over(stretch), F.lit(0)))
    turn = leaves.select(
        F.col("source").alias("_source"), "shard",
        F.explode(F.sequence(F.col("start"), F.col("start") + F.col("quota") - 1)).alias("turn"))
    counted = each_source.select(F.col("source").alias("_named"), "n_blocks")
    turn = turn.join(counted, F.col("_source").eqNullSafe(F.col("_named"))).select(
        "_source", "shard", F.floor(F.col("turn") / F.col("n_blocks")).alias("copy"),
        (F.col("turn") % F.col("n_blocks")).alias("_rank"))
    dealt = blocks.join(
        turn, blocks["source"].eqNullSafe(F.col("_source")) & (F.col("rank") == F.col("_rank"))
    ).select("source", "block", "copy", "shard")
    dealt = dealt.select(F.col("source").alias("_source"), F.col("block").alias("_block"), "copy", "shard")
    copies = drawn.join(
        dealt, drawn["source"].eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block"))
    ).filter("copy < copies")
    local = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "row", "copy"), "row", "copy")
    draws = copies.select(
        "row", "doc_id", "mark", "copy", "shard", F.row_number().over(local).cast("bigint").alias("position"))
    own = targets.select(F.col("source").alias("_source"), "source_size", "target")
    sizes = sizes.join(bounded(own), sizes["source"].eqNullSafe(F.col("_source"))).drop("_source", "hash")
    return sizes, draws


def taken_words(sizes: DataFrame, draws: DataFrame) -> DataFrame:
    """Per document the words the mix takes: ``doc_id, size, source_size, target, taken``."""
    times = draws.groupBy(F.col("row").alias("_row")).agg(F.count(F.lit(1)).alias("copies"))
    return sizes.join(times, sizes["row"] == F.col("_row"), "left").select(
        "doc_id", "size", "source_size", "target",
        (F.coalesce("copies", F.lit(0)) * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, as often as drawn, shard by shard in shuffled order.

    Rows that share an id are told apart by a hash of the row and, where even that repeats, by
    number: equal rows are as good as one another.
    """
    id_col = options.get("id_col", "doc_id")
    sizes, draws = source_mix(docs, **options)
    key = ["_id", "_mark"]
    marked = docs.select(F.struct("*").alias("_doc"), F.col(id_col).alias("_id"), F.xxhash64("*").alias("_mark"))
    times = draws.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "row", "copy", "shard", "position")
    rows, ids = sizes.agg(F.count(F.lit(1)), F.count_distinct(F.struct("doc_id", "mark"))).first()
    if rows > ids:
        nth = Window.partitionBy(*key)
        numbers = F.row_number().over(nth.orderBy("row"))
        own = sizes.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "row").withColumn("_nth", numbers)
        times = times.join(own.select(F.col("row").alias("_row"), "_nth"), F.col("row") == F.col("_row")).drop("_row")
        marked = marked.withColumn("_nth", F.row_number().over(nth.orderBy("_mark")))
        key = [*key, "_nth"]
    times = cut(times.select(*[F.col(k).alias(f"{k}_") for k in key], "copy", "shard", "position"))
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
    parts = (sizes.agg(F.sum("size")).first()[0] or 0) // options.get("shard_words", SHARD_WORDS) + 1
    out = marked.join(bounded(times), same)
    return out.repartition(parts, "shard").sortWithinPartitions("shard", "position").select("_doc.*")
