"""Jaccard join on word n-grams with adaptive prefixes of several matches, and its components.

A document's set is its distinct n-word shingles as 64-bit hashes; a shorter text is one shingle.
Two documents link when ``100 * common >= percent * union``.

1. A fixed-size table of counts, filled from the shingles of all documents, estimates how common
   a shingle is. It only sets the order of shingles, rarest first; any order gives right results.
2. Documents with the same words are one text from here on, under its smallest id.
3. Of ``n`` shingles in order, two linked texts share at least ``m`` among the first
   ``n - ceil(t * n) + m`` of each, for every ``m``. Each text takes the ``m`` at which the cost
   of its candidates is estimated least: the longer its prefix and the more common its shingles,
   the more matches it asks for. A pair has to share the smaller ``m`` of the two.
4. Shingles of prefixes that two texts have are posting lists. In a list of over ``SMALL`` texts
   only pairs with one text of the list, its hub, are checked; texts linked that way become one
   component, and the step is repeated with other hubs while it joins anything and long lists are
   left. Large groups of near copies go away in this step without their pairs being made.
5. Then all pairs of lists that are not in one component yet are made, and those that share
   enough shingles and could still overlap enough by their sizes and the position of their first
   common one are compared in full. Nothing is capped: step 4 only saves pairs whose answer is known.
6. Components by alternating large and small stars over the links, a table per round.

A null, blank or empty text has no shingles and is linked with nothing. Rows with the same words
are linked. A null id cannot name a component: a row without id gets a null component unless a
row with an id has the same words. Repeated ids are one document with several texts: each row
gets the component of its text, named by the smallest id in it. Empty table: empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackfold.llm.base import bounded, slices, text_bytes, without
from trackfold.session import cut

WIDTH = 3
PERCENT = 90
COUNT_BITS = 22
COUNT_CHUNK = 1 << 16
MOST_MATCHES = 8
CHANCE = 0.3  # partners that a shingle below the noise of the counts has by chance
COMPARE = 0.1  # cost of comparing one shingle of a candidate, in prefix entries
SMALL = 8
WORDS_KEPT = 1 << 16  # more take longer to find than to hash again, and 60 MB a worker at 400,000
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
TEXTS_DDL = "doc_id bigint, digest binary, n bigint, matches int, prefix binary"


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        number = self[word] = xxhash.xxh64_intdigest(word)
        return number


def shingles(words: list[bytes], hashes: WordHashes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; of all words where there are fewer."""
    x = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    span = min(width, len(x))
    if not span:
        return x
    y = np.full(len(x) - span + 1, span, np.uint64)
    for k in range(span):
        y = (y + x[k : len(x) - span + 1 + k]) * MIX[k % 3]
        y ^= y >> np.uint64(29)
    return np.unique(y)


def _words(text: bytes) -> list[bytes]:
    return text.lower().split()


def shingle_counts(docs: DataFrame, text_col: str, width: int, bits: int = COUNT_BITS) -> np.ndarray:
    """How many documents have a shingle, by the lowest ``bits`` of its hash: ``2**bits`` counts.

    Each task fills a table of its own and sends it in pieces, as bytes where counts are small.
    """
    mask = np.uint64((1 << bits) - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, table = WordHashes(), np.zeros(1 << bits, np.uint32)
        for batch in slices(batches, 0):
            held = [shingles(_words(text), hashes, width) & mask for text in text_bytes(batch.column(0))]
            np.add.at(table, np.concatenate(held).astype(np.int64), np.uint32(1))
        step = min(COUNT_CHUNK, 1 << bits)
        for n, at in enumerate(range(0, 1 << bits, step)):
            part = table[at : at + step]
            if part.any():
                part = part.astype(np.min_scalar_type(part.max()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n], pa.int32()), pa.array([part.itemsize], pa.int32()), pa.array([part.tobytes()])],
                    names=["chunk", "width", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, w, part in zip(*(c.to_pylist() for c in batch.columns)):
                part = np.frombuffer(part, f"<u{w}").astype(np.uint64)
                sums[chunk] = sums[chunk] + part if chunk in sums else part
        for chunk, total in sums.items():
            total = np.minimum(total, np.uint64(2**32 - 1)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk], pa.int32()), pa.array([total.tobytes()])], names=["chunk", "counts"])

    parts = docs.select(text_col).mapInArrow(count, "chunk int, width int, counts binary")
    sums = parts.repartition("chunk").mapInArrow(add, "chunk int, counts binary")
    table = np.zeros(1 << bits, np.uint32)
    step = min(COUNT_CHUNK, 1 << bits)
    for row in sums.collect():
        table[row["chunk"] * step : (row["chunk"] + 1) * step] = np.frombuffer(row["counts"], np.uint32)
    return table


def needed(n, percent: int):
    """ceil(percent / 100 * n): shingles of ``n`` that a linked text has at least."""
    return -(-percent * n // 100)


def choose_matches(partners: np.ndarray, n: int, percent: int) -> int:
    """The number of matches whose prefix is estimated to cost least.

    ``partners`` are estimates for the shingles in order. A prefix costs an entry per shingle and
    one per partner; what shares ``m`` of them falls with the square of ``m`` and is compared.
    The prefix looked at is the one that counts for partners of the same size.
    """
    base = n + (-2 * percent * n // (100 + percent))
    m = np.arange(1, min(MOST_MATCHES, needed(n, percent)) + 1)
    size = base + m
    met = np.cumsum(partners[: size[-1]])[size - 1]
    cost = size + met + met / m**2 * n * COMPARE
    return int(m[np.argmin(cost)])


def texts_with_prefixes(
    docs: DataFrame, counts: np.ndarray, width: int, percent: int, id_col: str, text_col: str,
) -> DataFrame:
    """Per row: ``doc_id, digest`` of the words, ``n`` shingles, ``matches`` and the ``prefix``."""
    load = float(counts.sum(dtype=np.float64)) / len(counts)
    noise = load + 2 * load**0.5
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    mask = np.uint64(len(counts) - 1)

    def cut_prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = WordHashes(), shared.value
        for batch in slices(batches, 1):
            rows = []
            for text in text_bytes(batch.column(1)):
                words = _words(text)
                y = shingles(words, hashes, width)
                n = len(y)
                digest = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
                if not n:
                    rows.append((digest, 0, 0, b""))
                    continue
                common = counts[(y & mask).astype(np.int64)]
                order = np.lexsort((y, common))
                m = choose_matches(np.maximum(common[order] - noise, 0) + CHANCE, n, percent)
                rows.append((digest, n, m, y[order[: n - needed(n, percent) + m]].tobytes()))
            if rows:
                digest, n, m, prefix = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(digest, pa.binary()), pa.array(n, pa.int64()), pa.array(m, pa.int32()),
                     pa.array(prefix, pa.binary())], names=["doc_id", "digest", "n", "matches", "prefix"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut_prefix, TEXTS_DDL)


def posting_lists(texts: DataFrame, percent: int) -> DataFrame:
    """Entries of prefixes that at least two texts have: ``token, id, n, matches, copies, at, lone``.

    ``lone`` counts the text's earlier shingles that no other prefix has. A text that shares this
    entry cannot have them: in its order they would come before it, so in its prefix. Entries
    with too many of these are left out. They travel as four numbers.
    """
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = 500
            for begin in range(0, batch.num_rows, size):
                part = batch.slice(begin, size)
                ids, n, matches, copies = (part.column(c).to_numpy() for c in range(4))
                tokens = [np.frombuffer(p, np.int64) for p in part.column(4).to_pylist()]
                many = np.array([len(t) for t in tokens])
                at = np.concatenate([np.arange(m) for m in many])
                place = np.repeat(n.astype(np.int64) << 32, many) | at
                weight = np.repeat(copies.astype(np.int64) << 8 | matches, many)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens)), pa.array(np.repeat(ids, many)), pa.array(place), pa.array(weight)],
                    names=["token", "id", "place", "weight"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows whose token is that of the row before or after; the last row waits for the next batch."""
        waiting, before = None, None
        for batch in batches:
            table = pa.Table.from_batches([batch] if waiting is None else [waiting, batch]).combine_chunks()
            token = table.column(0).to_numpy()
            same = token[1:] == token[:-1]
            first = before is not None and token[0] == before
            keep = np.concatenate(([first], same)) | np.concatenate((same, [False]))
            before = token[-2] if len(token) > 1 else before
            waiting = table.slice(len(token) - 1).to_batches()[0]
            yield from table.slice(0, len(token) - 1).filter(pa.array(keep[:-1])).to_batches()
        if waiting is not None and before is not None and waiting.column(0)[0].as_py() == before:
            yield waiting

    ddl = "token bigint, id bigint, place bigint, weight bigint"
    rows = texts.select("id", "n", "matches", "copies", "prefix").mapInArrow(spread, ddl)
    rows = cut(rows.repartition("token").sortWithinPartitions("token").mapInArrow(shared, ddl)).selectExpr(
        "token", "id", "shiftright(place, 32) AS n", "cast(weight & 255 AS int) AS matches",
        "shiftright(weight, 8) AS copies", "place & 4294967295L AS at")
    shared_before = F.row_number().over(Window.partitionBy("id").orderBy("at")) - 1
    rows = rows.withColumn("lone", (F.col("at") - shared_before).cast("bigint"))
    return rows.filter(f"100 * (n - lone) >= {percent} * n")


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``a, b``: ``id, component`` (its smallest id) for all linked ids.

    Large and small stars in turn; a round is one table, and the loop ends when a round leaves
    the table as it was.
    """
    stars = cut(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).filter("v <> m").distinct())
    state = None
    while True:
        now = tuple(stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first())
        if now == state:
            return stars.select(F.col("v").alias("id"), F.col("m").alias("component"))
        state = now
        both = stars.unionByName(stars.select(F.col("m").alias("v"), F.col("v").alias("m")))
        least = both.groupBy(F.col("v").alias("u")).agg(F.least(F.min("m"), F.first("v")).alias("least"))
        large = both.join(least, F.col("v") == F.col("u")).filter("m > v").select(
            F.col("m").alias("v"), F.col("least").alias("m")).filter("v <> m").distinct()
        least = large.groupBy(F.col("v").alias("u")).agg(F.min("m").alias("least"))
        small = large.join(least, F.col("v") == F.col("u")).filter("m <> least").select(
            F.col("m").alias("v"), F.col("least").alias("m"))
        stars = cut(small.unionByName(least.select(F.col("u").alias("v"), F.col("least").alias("m")))
                    .filter("v <> m").distinct())


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("component", F.col("id"))
    named = labels.select(F.col("id").alias("_id"), F.col("component").alias("_component"))
    return rows.join(named, F.col("id") == F.col("_id"), "left").withColumn(
        "component", F.coalesce("_component", "id")).drop("_id", "_component")


def _possible(left: str, right: str, percent: int) -> str:
    """Two entries of one list that can belong to linked texts and count for the smaller ``m``.

    Linked texts have at least ``common`` shingles in common, and none of either's lone ones. So
    ``m`` of them are among the first ``n - common + m`` of either: the sizes of the two allow a
    shorter prefix than the one a text takes for all its partners.
    """
    m = f"least({left}.matches, {right}.matches)"
    common = f"ceil({percent} * ({left}.n + {right}.n) / {100 + percent})"
    inside = " AND ".join(f"{x}.at < {x}.n - {common} + {m} AND {x}.n - {x}.lone >= {common}" for x in (left, right))
    return f"{left}.component <> {right}.component AND {inside}"


def _pair_columns(x: str, y: str, percent: int) -> list[str]:
    """Two entries as one pair, smaller id first; ``reach``: whether it may overlap enough from here on."""
    rest = f"least({x}.n - {x}.at, {y}.n - {y}.at)"
    return [
        f"least({x}.id, {y}.id) AS a", f"greatest({x}.id, {y}.id) AS b",
        f"least({x}.matches, {y}.matches) AS m",
        f"{100 + percent} * {rest} >= {percent} * ({x}.n + {y}.n) AS reach"]


def _candidates(pairs: DataFrame, whole: bool) -> DataFrame:
    """Pairs worth comparing, from an entry per common shingle.

    Where ``whole``, all common shingles of the pair's prefixes are there: there have to be ``m``.
    What two texts have in common is what follows their first common shingle, at most.
    """
    found = pairs.groupBy("a", "b").agg(
        F.max("m").alias("m"), F.count(F.lit(1)).alias("common"), F.max("reach").alias("reach"))
    if whole:
        found = found.filter("reach AND common >= m")
    return found.select("a", "b")


def _compare(pairs: DataFrame, docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs that link, by their whole sets. Only texts that are in a pair are read again."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("_wanted")).distinct()
    wanted = bounded(cut(wanted), rows=1_000_000)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, 1):
            held = [shingles(_words(t), hashes, width).tobytes() for t in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.binary())], names=["id", "held"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            out = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int((y[at] == x).sum())
                out.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(out, pa.bool_()))

    held = cut(rows.join(wanted, F.col("doc_id") == F.col("_wanted")).select("doc_id", "text")
               .mapInArrow(sets, "id bigint, held binary"))
    with_a = pairs.join(held.select(F.col("id").alias("a"), F.col("held").alias("held_a")), "a")
    with_both = with_a.join(held.select(F.col("id").alias("b"), F.col("held").alias("held_b")), "b")
    return with_both.select("a", "b", "held_a", "held_b").mapInArrow(linked, "a bigint, b bigint").distinct()


def _hub_pairs(lists: DataFrame, labels: DataFrame | None, turn: int, percent: int) -> DataFrame:
    """Pairs of each long list's hub with its other texts, one entry per common shingle.

    The hub is at first the text with the fewest lone shingles, as the middle of a group of near
    copies has, later one by chance, so other pairs turn up.
    """
    rows = _labelled(lists, labels)
    central = (-F.col("lone"), F.col("copies")) if turn == 0 else ()
    rank = F.struct(*central, F.xxhash64("id", F.lit(turn)), F.col("id"))
    entry = F.struct("id", "n", "matches", "component", "at", "lone")
    hubs = rows.groupBy("token").agg(
        F.count(F.lit(1)).alias("long"), F.min("component").alias("least"), F.max("component").alias("most"),
        F.max(F.struct(rank.alias("rank"), entry.alias("hub"))).alias("best"))
    hubs = hubs.filter((F.col("long") > SMALL) & (F.col("least") < F.col("most"))).select(
        F.col("token").alias("_token"), F.col("best.hub.*"))
    return rows.alias("x").join(hubs.alias("y"), F.expr("x.token = y._token AND " + _possible("x", "y", percent))).selectExpr(
        *_pair_columns("x", "y", percent))


def _all_pairs(lists: DataFrame, labels: DataFrame | None, percent: int) -> DataFrame:
    rows = _labelled(lists, labels)
    if labels is not None:
        open_lists = rows.groupBy("token").agg(F.min("component").alias("least"), F.max("component").alias("most"))
        open_lists = open_lists.filter("least < most").select("token")
        rows = cut(rows.join(open_lists, "token", "left_semi"))
    both = F.expr("x.token = y.token AND x.id < y.id AND " + _possible("x", "y", percent))
    return rows.alias("x").join(rows.alias("y"), both).selectExpr(*_pair_columns("x", "y", percent))


def _long_lists(lists: DataFrame, labels: DataFrame | None) -> int:
    """Entries in long lists that are not in one component yet."""
    spans = _labelled(lists, labels).groupBy("token").agg(
        F.count(F.lit(1)).alias("long"), F.min("component").alias("least"), F.max("component").alias("most"))
    return spans.filter((F.col("long") > SMALL) & (F.col("least") < F.col("most"))).agg(F.sum("long")).first()[0] or 0


def similar_documents(
    docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text",
    count_bits: int = COUNT_BITS,
) -> DataFrame:
    """Per row ``doc_id, n_shingles, component_id``: the smallest id reachable by links."""
    counts = shingle_counts(docs, text_col, width, count_bits)
    rows = cut(texts_with_prefixes(docs, counts, width, percent, id_col, text_col))
    texts = rows.groupBy("digest").agg(
        F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("matches").alias("matches"),
        F.count(F.lit(1)).alias("copies"), F.first("prefix").alias("prefix"))
    # an id that repeats has several texts: the texts of one id are joined by it
    names = cut(texts.select("digest", "id"))
    lists = cut(posting_lists(cut(texts.filter("id is not null and n > 0")), percent))

    links, labels, turn = None, None, 0
    left = _long_lists(lists, labels)
    while left:
        pairs = cut(_candidates(_hub_pairs(lists, labels, turn, percent), whole=False))
        found = cut(_compare(pairs, docs, width, percent, id_col, text_col))
        links = found if links is None else cut(links.unionByName(found))
        labels = components(links)
        before, left, turn = left, _long_lists(lists, labels), turn + 1
        # other hubs help as long as they take a good part of the long lists away
        if left > before // 2:
            break
    pairs = cut(_candidates(_all_pairs(lists, labels, percent), whole=True))
    found = cut(_compare(pairs, docs, width, percent, id_col, text_col))
    labels = components(found if links is None else cut(links.unionByName(found)))
    named = names.join(labels.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left").select(
        "digest", F.coalesce("component", "id").alias("component"), "id")
    filled = rows.filter("n > 0").select("doc_id", "digest", "n").join(named, "digest")
    alone = rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return filled.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id")).unionByName(alone)


def drop_similar(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component stays, the one with the smallest id; all columns as they are.

    Documents without words are linked with nothing and stay. Where ids repeat or are missing, links
    and removal go by row instead, so a text is not dropped for another one of its id: of a component
    one row stays, the one of the smallest id, null being the largest.
    """
    rows, ids = docs.agg(F.count(F.lit(1)), F.count_distinct(id_col)).first()
    if rows == ids:
        found = similar_documents(docs, width, percent, id_col, text_col)
        gone = found.filter("n_shingles > 0 and doc_id <> component_id").select(
            F.col("doc_id").alias("id"), F.lit(0).alias("mark"))
        return without(docs, cut(gone), id_col, lambda: F.lit(0))
    held = cut(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("number")))
    numbered = held.select("number", F.col("doc")[id_col].alias("id"), F.col("doc")[text_col].alias("text"))
    found = cut(similar_documents(numbered, width, percent, "number", "text").filter("n_shingles > 0"))
    named = numbered.select("number", "id").join(found, F.col("number") == F.col("doc_id"))
    stay = named.groupBy("component_id").agg(
        F.min_by("number", F.struct(F.col("id").isNull(), F.col("id"), F.col("number"))).alias("stays"))
    gone = named.join(stay, "component_id").filter("number <> stays").select(
        F.col("number").alias("id"), F.lit(0).alias("mark"))
    return without(held, cut(gone), "number", lambda: F.lit(0)).select("doc.*")
