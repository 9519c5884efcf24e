"""Exact copies, shards, quality rules and the mix: SQL on the tables, brute force on odd rows."""

from __future__ import annotations

import math
import random
import string
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from tests.compare import difference, oracle_frame
from tests.llm.conftest import TEXTS
from trackfold.llm import divergence_rules, exact_copies, extendible_shards, queries, source_mix

BLANKS = str.maketrans({c: " " for c in "\t\n\v\f\r"})
CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return (text or "").encode().split()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, sf_dir, name):
    got = driver.queries()[name](spark, sf_dir).toPandas()
    assert len(got)
    assert difference(got, oracle_frame(sf_dir, driver.oracle_sql()[name])) is None


def test_copies_of_odd_rows(odd):
    got = exact_copies.exact_copies(odd).collect()
    assert len(got) == len(TEXTS)
    groups = defaultdict(list)
    for i, text, _, _ in TEXTS:
        groups[(text or "").translate(CAPITALS)].append(i)
    want = Counter()
    for members in groups.values():
        ids = [i for i in members if i is not None]
        keep = max(ids) if ids else None
        want.update((i, keep, len(members), i == keep) for i in members)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == want


def test_dropping_copies_keeps_columns_and_one_row_each(odd, empty):
    got = exact_copies.drop_copies(odd)
    assert got.columns == odd.columns
    texts = [(r["text"] or "").translate(CAPITALS) for r in got.collect()]
    assert sorted(texts) == sorted({(t or "").translate(CAPITALS) for _, t, _, _ in TEXTS})
    assert exact_copies.drop_copies(empty).count() == 0


def test_texts_with_one_digest_stay_apart(odd, monkeypatch):
    constant = lambda docs, id_col, text_col, normalise: docs.select(
        docs[id_col].alias("doc_id"), normalise(docs[text_col]).alias("text")).selectExpr("*", "unhex('00') AS digest")
    want = {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_copies.exact_copies(odd).collect()}
    monkeypatch.setattr(exact_copies, "_digests", constant)
    got = {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_copies.exact_copies(odd).collect()}
    assert got == want


def test_shards_fit_and_are_as_large_as_they_can_be(documents):
    got = extendible_shards.extendible_shards(documents, max_bytes=20_000, step=3).collect()
    assert len(got) == documents.count()
    sums, prefixes = Counter(), {}
    for r in got:
        sums[r["shard"]] += r["bytes"]
        prefixes[r["shard"]] = r
    for shard, r in prefixes.items():
        assert len(shard) == r["depth"] and sums[shard] == r["shard_bytes"]
        assert r["shard_bytes"] <= 20_000 or r["shard_docs"] == 1
        # the bucket it was split from did not fit
        if shard:
            assert sum(b for s, b in sums.items() if s.startswith(shard[:-1])) > 20_000
        assert not any(s != shard and s.startswith(shard) for s in sums)


def test_shards_of_repeated_ids(spark, odd, empty):
    many = spark.range(400).selectExpr("1L AS doc_id", "repeat('x', 100) AS text")
    got = extendible_shards.extendible_shards(many, max_bytes=1000).collect()
    assert len(got) == 400 and all(r["shard_bytes"] <= 1000 and r["depth"] > 64 for r in got)
    assert len(extendible_shards.extendible_shards(odd, max_bytes=500).collect()) == len(TEXTS)
    assert extendible_shards.extendible_shards(empty).count() == 0


def test_written_shards(odd, tmp_path):
    path = f"file://{tmp_path}/shards"
    extendible_shards.write_shards(odd, path, max_bytes=500)
    back = odd.sparkSession.read.parquet(path)
    assert sorted(map(str, back.select(odd.columns).collect())) == sorted(map(str, odd.collect()))


def repeated(w):
    windows = [tuple(w[n : n + 3]) for n in range(len(w) - 2)]
    often = Counter(windows)
    return len({n + k for n, g in enumerate(windows) if often[g] > 1 for k in range(3)})


def base_counts(text):
    text = text or ""
    w = words(text)
    lines = [line for line in text.split("\n") if line.encode().split()]
    return (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeated(w))


def test_repeats_and_plain_words_at_any_length(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["a", "B.", "(c", "!?", "\u00e4,"], k=n)) for n in (*range(10), 15, 16, 17, 255, 256, 3000)]
    texts += ["", " . ", "?!", "x y z x y z", "(x y) z", "x-y y z. x-y y z"]
    docs = spark.createDataFrame([(n, t, None) for n, t in enumerate(texts)], "doc_id long, text string, lang string")
    rows = divergence_rules.counted(docs, ["a", "c", "x-y"], "doc_id", "text", "lang").collect()
    assert len(rows) == len(texts)
    for r in rows:
        plain = [x for x in (w.strip(string.punctuation) for w in texts[r["doc_id"]].translate(CAPITALS).split()) if x]
        assert r["n_repeat_words"] == repeated(words(texts[r["doc_id"]]))
        assert (r["n_plain"], r["common"]) == (len(plain), [x for x in plain if x in ("a", "c", "x-y")])


def js(p, q):
    keys = {*p, *q}
    m = {k: (p.get(k, 0) + q.get(k, 0)) / 2 for k in keys}
    half = lambda x: sum(v * math.log2(v / m[k]) for k, v in x.items() if v > 0)
    return math.sqrt(min(max((half(p) + half(q)) / 2, 0), 1))


def plain_words(text):
    """Lower case, punctuation off both ends; what is left of it."""
    return [w for w in (x.strip(string.punctuation) for x in (text or "").translate(CAPITALS).translate(BLANKS).split(" ")) if w]


def relative_distance(plain, ref):
    """Distance of the words to a reference, as a multiple of that of words it does not know."""
    counts = Counter(plain)
    shares = {k: counts.get(k, 0) / max(len(plain), 1) for k in ref if k is not None}
    return js(shares | {None: 1 - sum(shares.values())}, ref) / js({None: 1.0}, ref)


def test_quality_against_brute_force(documents, texts):
    """Counts, both distances and verdicts, computed anew in plain Python."""
    rows = documents.select("doc_id", "text", "lang").collect()
    by_lang = defaultdict(Counter)
    for r in rows:
        by_lang[r["lang"]].update(plain_words(r["text"]))
    references = {}
    for lang, counts in by_lang.items():
        top = sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))[: divergence_rules.COMMON]
        total = sum(counts.values())
        references[lang] = {w: c / total for w, c in top} | {None: 1 - sum(c for _, c in top) / total}

    def classes(text):
        w = sum(len(x.decode()) for x in words(text))
        named = [sum(c in s for c in text) for s in
                 ("#*$%&|<>", "0123456789", ".,;:!?'\"()-")]
        return Counter(dict(enumerate([len(text) - w, *named, len(text.encode()) - len(text), w - sum(named)])))

    sums = defaultdict(Counter)
    for r in rows:
        sums[r["lang"]].update(classes(r["text"]))
    share = lambda c: {k: v / sum(c.values()) for k, v in c.items()}
    for r in divergence_rules.quality(documents).collect():
        text = texts[r["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base_counts(text)
        assert r["base_failed"] == (r["n_words"] < 50 or r["n_repeat_words"] * 100 > 50 * r["n_words"])
        far = unlike = False
        if len(text.encode()) >= divergence_rules.MIN_CHARS:
            want = min(js(share(classes(text)), share(s)) for s in sums.values())
            assert r["char_distance"] == pytest.approx(want, abs=1e-6)
            far = r["char_distance"] > divergence_rules.MAX_CHAR_DISTANCE
        else:
            assert r["char_distance"] is None
        if r["n_words"] >= divergence_rules.MIN_WORDS:
            want = min([1.0] + [relative_distance(plain_words(text), ref) for ref in references.values()])
            assert r["word_distance"] == pytest.approx(want, abs=1e-6)
            unlike = r["word_distance"] > divergence_rules.MAX_WORD_DISTANCE
        else:
            assert r["word_distance"] is None
        assert r["kept"] == (not r["base_failed"] and not far and not unlike)


def test_quality_of_odd_rows(odd, empty):
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
                  for r in divergence_rules.quality(odd).collect())
    assert got == Counter((i, *base_counts(t)) for i, t, _, _ in TEXTS)
    assert divergence_rules.quality(empty).count() == 0
    kept = divergence_rules.keep_good(odd)
    assert kept.columns == odd.columns
    nameless = divergence_rules.quality(odd.withColumn("lang", F.lit(None).cast("string")))
    assert nameless.filter("char_distance is not null").count() == 0


def test_clean_documents_are_kept(spark, documents, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = divergence_rules.quality(documents).join(labels.filter("quality = 1"), "doc_id").filter("not base_failed")
    assert good.filter("not kept").count() <= 0.01 * good.count()


def test_planted_texts(spark, documents):
    """Made-up words and keyword lists go, clean texts in capitals stay, with very many values of ``lang``."""
    rng = random.Random(4)
    clean = [r["text"] for r in documents.filter("lang = 'en'").orderBy("doc_id").collect()
             if len(words(r["text"])) >= 150 and not repeated(words(r["text"]))][:8]
    assert len(clean) == 8
    made_up = [". ".join(" ".join("".join(rng.choices(string.ascii_lowercase, k=rng.randint(4, 9))) for _ in range(9))
                         for _ in range(35)) for _ in range(8)]
    longer = sorted({w for t in clean for w in plain_words(t) if len(w) > 7})
    keywords = [", ".join(rng.sample(longer, 120)) for _ in range(4)]
    shouted = [t.upper() for t in clean]
    marks = ["- ~ ^ _ " * 20 + " ".join(f"_{'~' * n}_" for n in range(60))]
    planted = [(10_000 + n, t) for n, t in enumerate(made_up + keywords + shouted + clean + marks)]
    extra = spark.createDataFrame([(i, t, "en") for i, t in planted], "doc_id long, text string, lang string")
    # labels of one document each are no references
    dirty = spark.createDataFrame(
        [(20_000 + n, f"{clean[n % 8]} {n}", f"label{n}") for n in range(600)], "doc_id long, text string, lang string")
    docs = documents.select("doc_id", "text", "lang").unionByName(extra).unionByName(dirty)
    got = {r["doc_id"]: r for r in divergence_rules.quality(docs, min_share=0.01).collect()}
    verdicts = [got[i]["kept"] for i, _ in planted]
    assert verdicts == [False] * 12 + [True] * 16 + [False]
    assert [got[i]["base_failed"] for i, _ in planted[:12]] == [False] * 12
    assert {got[20_000 + n]["word_distance"] for n in range(600)} == {None}


def test_mix_takes_what_the_targets_say(documents):
    sizes, draws = source_mix.source_mix(documents, block_words=300, shard_words=4000)
    rows = source_mix.taken_words(sizes, draws).join(documents.select("doc_id", "source"), "doc_id").collect()
    by_source = defaultdict(list)
    for r in rows:
        assert r["taken"] <= 3 * r["size"]
        by_source[r["source"]].append(r)
    assert sum(r[0]["target"] for r in by_source.values()) == pytest.approx(sum(r["size"] for r in rows))
    for own in by_source.values():
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own) / 2
    # shards share nothing, and each has near its part of every source
    drawn = draws.collect()
    assert len({(d["row"], d["copy"]) for d in drawn}) == len(drawn)
    assert {d["shard"] for d in drawn} == set(range(math.ceil(sum(r["size"] for r in rows) / 4000)))
    for shard in {d["shard"] for d in drawn}:
        places = sorted(d["position"] for d in drawn if d["shard"] == shard)
        assert places == list(range(1, len(places) + 1))
    again = source_mix.source_mix(documents.repartition(5), block_words=300, shard_words=4000)[1].collect()
    assert Counter((d["doc_id"], d["copy"], d["shard"]) for d in again) == Counter(
        (d["doc_id"], d["copy"], d["shard"]) for d in drawn)


def test_quotas_are_split_exactly(spark):
    quotas = {"a": 40, "b": 7, None: 1, "c": 25}
    table = spark.createDataFrame(list(quotas.items()), "source string, quota bigint")
    for shards in (1, 2, 5, 8):
        got = source_mix.quotas_by_shard(table, shards).collect()
        by_source, by_shard = Counter(), Counter()
        for r in got:
            by_source[r["source"]] += r["quota"]
            by_shard[r["shard"]] += r["quota"]
        assert by_source == Counter(quotas)
        assert max(by_shard.values()) - min(by_shard.values()) <= 2


def test_mix_of_odd_rows(odd, empty):
    sizes, draws = source_mix.source_mix(odd)
    taken = source_mix.taken_words(sizes, draws).collect()
    assert Counter((r["doc_id"], r["size"]) for r in taken) == Counter((i, len(words(t))) for i, t, _, _ in TEXTS)
    mixed = source_mix.mixed_documents(odd)
    assert mixed.columns == odd.columns
    assert sum(len(words(r["text"])) for r in mixed.collect()) == sum(r["taken"] for r in taken)
    assert source_mix.mixed_documents(empty).count() == 0
    assert source_mix.taken_words(*source_mix.source_mix(empty)).count() == 0


def test_copies_that_differ_in_case_under_one_id(spark):
    rows = [(1, "Hello"), (1, "hello"), (None, "ABC"), (None, "abc"), (2, "other"), (2, "another")]
    got = exact_copies.drop_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted((r["doc_id"] or 0, r["text"].lower()) for r in got.collect()) == [
        (0, "abc"), (1, "hello"), (2, "another"), (2, "other")]
