"""Exact copies, combined in three stages so that no group of copies meets in one task early.

1. Within a task: copies met by one task are combined by Spark's map-side aggregation.
2. Salted: what the tasks hand over is dealt by digest and salt, so a text that every task
   holds still goes to many tasks.
3. Global: the winners of the salts are combined by digest.

Every stage groups by the digest *and* the whole normalised text, so two texts with one digest
stay two groups. Documents find their group by digest; only for a digest that stands for
several texts the text is compared again.

Nulls: a null text is an empty text, and empty texts are copies of each other. A null id takes
part as the smallest id; it is the survivor only of a group in which all ids are null. Rows
with the same id and text: all carry ``kept = true`` in ``exact_copies``; ``drop_copies`` keeps
one. An empty table gives an empty result; other columns of the table are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackfold.llm.base import lowered, without
from trackfold.session import cut

SALTS = 16


def _digests(docs: DataFrame, id_col: str, text_col: str, normalise) -> DataFrame:
    text = normalise(F.col(text_col))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn(
        "digest", F.unhex(F.sha2("text", 256)))


def groups(digests: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per distinct text: ``digest, keep_id, group_size, text``.

    ``text`` is null unless another text has the same digest.
    """
    best, size = F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    salted = (
        digests.withColumn("salt", F.spark_partition_id() % salts)
        .groupBy("digest", "salt", "text").agg(best, size)
    )
    whole = (
        salted.select("digest", "text", "keep_id", "group_size")
        .repartition("digest")
        .groupBy("digest", "text")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    )
    texts = F.count(F.lit(1)).over(Window.partitionBy("digest"))
    return whole.select(
        "digest", "keep_id", "group_size", F.when(texts > 1, F.col("text")).alias("text"))


def exact_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=lowered, salts: int = SALTS,
) -> DataFrame:
    """Per document its group: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when ``normalise`` makes them equal; of equal texts the largest id stays.
    """
    digests = _digests(docs, id_col, text_col, normalise)
    found = cut(groups(digests, salts))
    alone = found.filter("text is null").drop("text")
    shared = found.filter("text is not null")
    ids = digests.select("doc_id", "digest")
    joined = ids.join(alone, "digest")
    if not shared.isEmpty():
        joined = joined.unionByName(
            digests.join(shared, ["digest", "text"]).select("digest", "doc_id", "keep_id", "group_size"))
    return joined.select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=lowered, salts: int = SALTS,
) -> DataFrame:
    """The documents that stay, with all their columns as they are.

    Rows that share an id (or have none) and whose texts are equal are one document: any one of them stays.
    """
    found = cut(exact_copies(docs, id_col, text_col, normalise, salts).select("doc_id", "keep_id", "kept", "text_sha256"))
    gone = found.filter("not kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("mark"))
    mark = lambda: F.sha2(normalise(F.col(text_col)), 256)
    stay = without(docs, gone, id_col, mark)
    kept, texts = found.filter("kept").agg(
        F.count(F.lit(1)), F.count_distinct(F.struct("keep_id", "text_sha256"))).first()
    if kept == texts:
        return stay
    marked = stay.select(F.struct("*").alias("_doc"), F.col(id_col).alias("_id"), mark().alias("_mark"))
    return marked.dropDuplicates(["_id", "_mark"]).select("_doc.*")
