"""Quality rules by divergence: does a document look like any of the corpus' languages?

References: for every value of ``lang``, over all its documents, the shares of character classes
and of its ``COMMON`` most frequent words, in lower case (A-Z) and without punctuation around them;
word histograms have one more bin for all other words. A document is compared with every reference
by Jensen-Shannon distance (the square root of the divergence to base 2, from 0 to 1). The nearest
reference counts, so a document's own language need not be known.

How far a text can be from a word reference follows from the reference: a text without any of its
common words is at the same distance whatever its words are. Word distances are given as a multiple
of that one, so 1 means no likeness, in any language, and documents of a language stay well
below. A document with words enough to be judged and not one between its punctuation is at 1.

Guards: below ``min_chars`` bytes the character distance and below ``min_words`` words the word
distance is not judged. A value of ``lang`` with less than ``min_share`` of all words says too little to be
a reference, so there are at most ``1 / min_share``, whatever the column holds; documents under
such a value are not judged by distance.

Counts are array functions inside the row and sums that combine on the map side. What goes
through the driver is the references: ``COMMON`` words and a few shares for each.

Nulls: a null text has no words and fails the base rule, as do blank texts. Documents without
language take part in no reference and are judged. Without any reference (all languages null, empty table) no
distance is judged. Rows that repeat are judged one by one. Columns beyond id, text and language
are not looked at, and are kept as they are by ``keep_good``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackfold.llm.base import lowered, without, words
from trackfold.session import cut

SYMBOLS = "[#*$%&|<>]+"
# letters count alike in either case; "wide" are the second and further bytes of a character
CLASSES = {"symbols": SYMBOLS, "digits": "[0-9]+", "stops": "[.,;:!?'\"()-]+"}
SHARES = ("blanks", *CLASSES, "wide", "rest")
COMMON = 60
MIN_CHARS = 200
MIN_WORDS = 50
MIN_SHARE = 0.001
MAX_CHAR_DISTANCE = 0.25
MAX_WORD_DISTANCE = 0.95
PUNCTUATION = "!-/:-@\\[-`{-~"
# blanks with the punctuation before and after them
APART = f"[{PUNCTUATION}]*[\\x20\\x09-\\x0D][\\x20\\x09-\\x0D{PUNCTUATION}]*"


def _apart(text: Column) -> Column:
    """``plain_words`` between two empty strings, the first and the last."""
    return F.split(F.concat(F.lit(" "), lowered(text), F.lit(" ")), APART)


def plain_words(text: Column) -> Column:
    """Words in lower case (A-Z) without punctuation around them; what is punctuation only is none."""
    return F.array_remove(_apart(text), "")


def with_repeats(docs: DataFrame) -> DataFrame:
    """Add ``n_repeat_words`` from the words ``w``: words in a 3-word window found twice or more.

    Hashes of the windows tell which may be the same. Their last bits, as many as places need, are the place:
    plain numbers are sorted, not structs. Only the windows found so are compared, as text, sorted, each with
    its neighbours. The sum takes each word once where windows overlap.
    """
    at = lambda i: [F.get(F.col("w"), i + k) for k in range(3)]
    beside = lambda column, x, k, same: (
        (same(x) == same(F.get(F.col(column), k + 1))) | (same(x) == same(F.get(F.col(column), k - 1))))
    hashes = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(*at(i)))
    docs = docs.withColumn("hashes", F.when(F.size("w") > 3, hashes))
    bits = F.coalesce(F.length(F.bin(F.size("w"))), F.lit(32))
    docs = docs.withColumn("mask", F.call_function("shiftleft", F.lit(-1).cast("bigint"), bits))
    of_hash, place = lambda x: x.bitwiseAND(F.col("mask")), lambda x: x.bitwiseAND(F.bitwise_not("mask")).cast("int")
    keys = F.sort_array(F.transform("hashes", lambda h, i: of_hash(h).bitwiseOR(i.cast("bigint"))))
    docs = docs.withColumn("keys", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), keys))
    alike = F.transform(F.filter("keys", lambda x, k: beside("keys", x, k, of_hash)), place)
    placed = F.sort_array(F.transform(alike, lambda i: F.struct(F.concat_ws(" ", *at(i)).alias("g"), i.alias("i"))))
    docs = docs.withColumn("placed", F.coalesce(placed, F.array().cast("array<struct<g:string,i:int>>")))
    twice = F.filter("placed", lambda x, k: beside("placed", x, k, lambda y: y["g"]))
    docs = docs.withColumn("hits", F.array_sort(F.transform(twice, lambda x: x["i"])))
    new_words = F.transform("hits", lambda i, k: F.least(F.lit(3), F.coalesce(F.get(F.col("hits"), k + 1) - i, F.lit(3))))
    count = F.aggregate(new_words, F.lit(0).cast("bigint"), lambda a, b: a + b)
    return docs.withColumn("n_repeat_words", count).drop("hashes", "mask", "keys", "placed", "hits")


def common_words(docs: DataFrame, text_col: str, lang_col: str, common: int, min_share: float) -> DataFrame:
    """The most frequent words of each reference, with their share of its words: ``lang, word, share``."""
    each = docs.filter(F.col(lang_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.explode(plain_words(F.col(text_col))).alias("word"))
    counts = cut(each.groupBy("lang", "word").count())
    totals = counts.groupBy("lang").agg(F.sum("count").alias("total"))
    whole = totals.agg(F.sum("total")).first()[0] or 0
    totals = totals.filter(F.col("total") >= min_share * whole)
    top = Window.partitionBy("lang").orderBy(F.desc("count"), "word")
    return (
        counts.withColumn("n", F.row_number().over(top)).filter(F.col("n") <= common)
        .join(totals, "lang").select("lang", "word", (F.col("count") / F.col("total")).alias("share"))
    )


def counted(docs: DataFrame, common: list[str], id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """Per row the base counts, bytes by character class, and its common words.

    Each step hands on no more than the next ones need, as it copies what it hands on.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    taken_off = lambda regex: F.octet_length("text") - F.octet_length(F.regexp_replace("text", regex, ""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), text.alias("text"),
        F.monotonically_increasing_id().alias("row"), F.xxhash64(F.col(text_col)).alias("mark"),
    )
    rows = rows.select(
        "doc_id", "lang", "row", "mark", "text", _apart(F.col("text")).alias("plain"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"),
        F.octet_length("text").alias("bytes"), F.char_length("text").alias("chars"),
        *[taken_off(regex).cast("bigint").alias(name) for name, regex in CLASSES.items()],
    )
    rows = rows.select(
        "doc_id", "lang", "row", "mark", "bytes", "chars", *CLASSES, words(F.col("text")).alias("w"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        (F.size("plain") - 2).cast("bigint").alias("n_plain"), F.filter("plain", lambda x: x.isin(common)).alias("common"),
    )
    rows = with_repeats(rows).withColumns({
        "n_words": F.size("w").cast("bigint"), "word_chars": F.char_length(F.array_join("w", "")).cast("bigint")}).drop("w")
    named = sum((F.col(n) for n in CLASSES), F.lit(0))
    return rows.withColumns({
        "blanks": F.col("chars") - F.col("word_chars"),
        "wide": F.col("bytes") - F.col("chars"),
        "rest": F.col("word_chars") - named,
    })


def _divergence(p: Column, q: Column) -> Column:
    """One bin's part of the Jensen-Shannon divergence."""
    middle = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / middle)).otherwise(0.0)
    return (part(p) + part(q)) / 2


def _distance(divergence: Column) -> Column:
    return F.sqrt(F.least(F.greatest(divergence, F.lit(0.0)), F.lit(1.0)))


def quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", common: int = COMMON,
    min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS, min_share: float = MIN_SHARE,
    max_char_distance: float = MAX_CHAR_DISTANCE, max_word_distance: float = MAX_WORD_DISTANCE,
) -> DataFrame:
    """Per row: base counts, ``base_failed``, both distances to the nearest reference, ``kept``."""
    spark = docs.sparkSession
    top = common_words(docs, text_col, lang_col, common, min_share).collect()
    languages = sorted({r["lang"] for r in top})
    rows = cut(counted(docs, sorted({r["word"] for r in top}), id_col, text_col, lang_col))
    if not languages:
        none = F.lit(None).cast("double")
        return _verdict(rows.withColumns({"char_distance": none, "word_distance": none}), 1.0, 1.0)
    shares = rows.filter(F.col("lang").isin(languages)).groupBy("lang").agg(
        F.sum("bytes").alias("bytes"), *[F.sum(n).alias(n) for n in SHARES]).collect()
    histogram = F.array(*[F.col(n) / F.col("bytes") for n in SHARES])
    to = F.array(*[F.array(*[F.lit(r[n] / r["bytes"]) for n in SHARES]) for r in shares])
    far = F.array_min(F.transform(to, lambda reference: _distance(F.aggregate(
        F.zip_with(histogram, reference, _divergence), F.lit(0.0), lambda a, b: a + b))))
    judged = F.col("lang").isNull() | F.col("lang").isin(languages)
    rows = rows.withColumn("char_distance", F.when(judged & (F.col("bytes") >= max(min_chars, 1)), far))

    bins = F.broadcast(spark.createDataFrame(top, "reference string, word string, share double"))
    found = (
        rows.filter(F.col("n_words") >= max(min_words, 1))
        .select("row", "n_plain", F.explode("common").alias("word"))
        .groupBy("row", "n_plain", "word").count().join(bins, "word")
    )
    p, q = F.col("count") / F.col("n_plain"), F.col("share")
    # a bin of the reference that the document lacks adds half its share
    by_language = found.groupBy("row", "reference").agg(
        F.sum(_divergence(p, q) - q / 2).alias("seen"), F.sum(p).alias("p"))
    rest = F.broadcast(bins.groupBy("reference").agg(F.sum("share").alias("all_share")))
    others = 1 - F.col("all_share")
    distance = _distance(
        F.col("seen") + F.col("all_share") / 2 + _divergence(F.greatest(1 - F.col("p"), F.lit(0.0)), others))
    without_any = _distance(F.col("all_share") / 2 + _divergence(F.lit(1.0), others))
    nearest = by_language.join(rest, "reference").groupBy("row").agg(F.min(distance / without_any).alias("near"))
    rows = rows.join(nearest, "row", "left").withColumn("word_distance", F.when(
        judged & (F.col("n_words") >= max(min_words, 1)), F.least(F.coalesce("near", F.lit(1.0)), F.lit(1.0))))
    return _verdict(rows, max_char_distance, max_word_distance)


def _verdict(rows: DataFrame, max_char_distance: float, max_word_distance: float) -> DataFrame:
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    unlike = (
        F.coalesce(F.col("char_distance") > max_char_distance, F.lit(False))
        | F.coalesce(F.col("word_distance") > max_word_distance, F.lit(False)))
    return rows.select(
        "doc_id", "n_words", "word_chars", F.col("symbols").alias("n_symbols"), "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~unlike).alias("kept"), "char_distance", "word_distance", "mark")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
              **limits) -> DataFrame:
    """The documents that pass, with all their columns as they are."""
    verdict = quality(docs, id_col, text_col, lang_col, **limits)
    gone = cut(verdict.filter("not kept").select(F.col("doc_id").alias("id"), "mark"))
    return without(docs, gone, id_col, lambda: F.xxhash64(F.col(text_col)))
