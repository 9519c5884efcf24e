"""Scores, pieces, token files, span dedup, language and similarity: brute force and exact round trips."""

from __future__ import annotations

import io
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.conftest import PASSAGE, TEXTS
from trackfold.llm import hmm_score, lang_centroids, piece_lattice, prefix_join, queries, span_dedup, token_frames
from trackfold.session import scratch_path

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


# --- language model scores ----------------------------------------------------------------------

def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def base_model(pairs, remainder=1):
    counts = Counter()
    for i, text in pairs:
        if i is None or zlib.crc32(str(i).encode()) % 5 != remainder:
            counts.update(tokens(text))
    total = sum(counts.values())
    return counts, total, lambda w: np.log10((counts[w] + 0.5) / (total + 0.5 * (len(counts) + 1)))


def check_scores(got, pairs):
    counts, total, base = base_model(pairs)
    want = Counter((i, len(tokens(t)), sum(counts[w] > 0 for w in tokens(t))) for i, t in pairs)
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"]) for r in got) == want
    assert all(r["train_tokens"] == total and np.isfinite(r["score"]) for r in got)
    sums = sorted(r["base_score"] for r in got)
    assert sums == pytest.approx(sorted(sum(base(w) for w in tokens(t)) for _, t in pairs))


def test_scores_and_held_out_gain(spark, sf_dir, texts):
    got = queries.op1_hmm_score(spark, sf_dir).collect()
    check_scores(got, list(texts.items()))
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in texts if zlib.crc32(str(i).encode()) % 5 == 1}
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_scores_of_odd_rows(odd, empty):
    held = queries.id_remainder(5) == 1
    check_scores(hmm_score.score_documents(odd, held).collect(), [(i, t) for i, t, _, _ in TEXTS])
    assert hmm_score.score_documents(empty, held).count() == 0
    untrained = hmm_score.score_documents(odd, F.lit(True)).collect()
    assert all(r["score"] == pytest.approx(0) and r["base_score"] == 0 and r["n_known"] == 0 for r in untrained)


def test_blocks_do_not_change_scores(odd, monkeypatch):
    held = queries.id_remainder(5) == 1
    whole = sorted((r["n_tokens"], r["score"]) for r in hmm_score.score_documents(odd.coalesce(1), held).collect())
    monkeypatch.setattr(hmm_score, "BLOCK_BYTES", 300)
    cut = sorted((r["n_tokens"], r["score"]) for r in hmm_score.score_documents(odd.repartition(4), held).collect())
    assert [n for n, _ in cut] == [n for n, _ in whole]
    assert [s for _, s in cut] == pytest.approx([s for _, s in whole], rel=1e-4)


def plain_scores(pairs, rounds):
    """Scores by loops over words: the same model without blocks, buckets, matrices or spans."""
    docs = [(i is None or zlib.crc32(str(i).encode()) % 5 != 1, tokens(t)) for i, t in pairs]
    c = Counter(w for train, words in docs if train for w in words)
    suffix = lambda w: zlib.crc32(w[-2:]) % 64
    kind = lambda w: w if c[w] >= 5 else 0 if not c[w] else 1 + suffix(w) + (64 if c[w] > 1 else 0)
    room = sum(c.values()) + 0.5 * (len(c) + 1)
    base, counts = Counter({0: 0.5 / room}), {0: np.zeros(8)}
    for w in c:
        lean = np.full(8, 0.2)
        lean[suffix(w) % 8] += 1
        base[kind(w)] += (c[w] + 0.5) / room
        counts[kind(w)] = counts.get(kind(w), 0) + c[w] * lean / lean.sum()
    moves, first = np.full((8, 8), 0.1 / 7) + np.eye(8) * (0.9 - 0.1 / 7), np.full(8, 1 / 8)

    def forward(words):
        alphas, scales = [], []
        for w in words:
            alpha = (alphas[-1] @ moves if alphas else first) * (counts[kind(w)] + 20_000 * base[kind(w)]) / (totals + 20_000)
            scales.append(alpha.sum())
            alphas.append(alpha / alpha.sum())
        return alphas, scales

    for turn in range(rounds + 1):
        totals = sum(counts.values())
        if turn == rounds:
            break
        new, pairs_, firsts = {k: np.zeros(8) for k in counts}, np.ones((8, 8)), np.ones(8)
        for train, words in docs:
            if not train:
                continue
            alphas, scales = forward(words)
            beta = np.ones(8)
            for t in range(len(words) - 1, -1, -1):
                new[kind(words[t])] += alphas[t] * beta
                if t:
                    ahead = beta * (counts[kind(words[t])] + 20_000 * base[kind(words[t])]) / (totals + 20_000) / scales[t]
                    pairs_ += alphas[t - 1][:, None] * moves * ahead
                    beta = moves @ ahead
            firsts += alphas[0] * beta
        counts, moves, first = new, pairs_ / pairs_.sum(axis=1, keepdims=True), firsts / firsts.sum()
    part = lambda w: np.log10((c[w] + 0.5) / room / base[kind(w)]) if c[w] < 5 else 0.0
    return [sum(np.log10(forward(words)[1])) + sum(map(part, words)) for _, words in docs]


def test_scores_against_plain_loops(spark, texts):
    """Trained on whole documents, also ones longer than a span; every document's score."""
    pairs = [(i, texts[i]) for i in sorted(texts)[:60]] + [(None, "the Cat sat"), (10**6, None)]
    assert max(len(tokens(t)) for _, t in pairs) > 2 * hmm_score.SPAN
    df = spark.createDataFrame(pairs, "doc_id bigint, text string").repartition(3)
    rows = hmm_score.score_documents(df, queries.id_remainder(5) == 1).collect()
    got = {r["doc_id"]: r["score"] for r in rows}
    assert [got[i] for i, _ in pairs] == pytest.approx(plain_scores(pairs, hmm_score.ROUNDS), rel=1e-5)


def paths(seq, emission, moves, start):
    """Probability of every sequence of states."""
    for states in itertools.product(range(len(start)), repeat=len(seq)):
        p = start[states[0]] * emission[seq[0], states[0]]
        for t in range(1, len(seq)):
            p *= moves[states[t - 1], states[t]] * emission[seq[t], states[t]]
        yield states, p


@pytest.mark.parametrize("span, counted", [(1, 1), (2, 3), (4, 1 << 18), (128, 1 << 18)])
def test_recursions_against_all_paths(monkeypatch, span, counted):
    monkeypatch.setattr(hmm_score, "SPAN", span)
    monkeypatch.setattr(hmm_score, "COUNTED", counted)
    rng = np.random.default_rng(3)
    emission = rng.random((5, 3))
    moves = rng.random((3, 3))
    moves /= moves.sum(axis=1, keepdims=True)
    start = np.array([0.5, 0.3, 0.2])
    seqs = [[0, 1, 4, 2], [3], [2, 2, 0], [1, 0, 3, 3, 4]]
    flat = np.array(list(itertools.chain(*seqs)))
    length = np.array([len(s) for s in seqs])
    first = np.cumsum(length) - length
    counts, pairs, firsts = np.zeros((5, 3)), np.zeros((3, 3)), np.zeros(3)
    logs = []
    for seq in seqs:
        total = sum(p for _, p in paths(seq, emission, moves, start))
        logs.append(np.log10(total))
        for states, p in paths(seq, emission, moves, start):
            firsts[states[0]] += p / total
            for t, s in enumerate(states):
                counts[seq[t], s] += p / total
                if t:
                    pairs[states[t - 1], s] += p / total
    assert hmm_score.log_likelihoods(flat, first, length, emission, moves, start) == pytest.approx(logs)
    got = hmm_score.expected_counts(flat, first, length, emission, moves, start)
    for have, want in zip(got, (counts, pairs, firsts)):
        assert have == pytest.approx(want, rel=1e-4)


# --- pieces -------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def coder():
    return piece_lattice.PieceCoder(piece_lattice.Model(PIECES))


@settings(max_examples=150, deadline=None)
@given(text=st.text(st.sampled_from(list("abehinorst  ▁\n\téßñ中\U0001f600.,0E\x00")) | st.characters(exclude_categories=["Cs"]), max_size=60))
def test_pieces_are_those_of_the_library(library, coder, text):
    ids = coder.encode([text])[0]
    assert ids.tolist() == library.encode(text)
    assert coder.decode(ids.astype(np.int64)) == library.decode(ids.tolist())


def test_long_chunks_are_merged_alike(library, coder):
    rnd = random.Random(5)
    long = ["a" * 1200, "".join(rnd.choice("theinganor") for _ in range(3000)), " " * 700, "ab" * 300 + "  " + "the" * 200]
    assert [i.tolist() for i in coder.encode(long)] == library.encode(long)


def test_piece_digests(spark, sf_dir, texts, library, odd, empty):
    for got, pairs in (
        (queries.op2_piece_lattice(spark, sf_dir).collect(), list(texts.items())),
        (piece_lattice.piece_digests(odd, PIECES).collect(), [(i, t) for i, t, _, _ in TEXTS]),
    ):
        want = Counter()
        for i, t in pairs:
            ids = library.encode(t or "")
            want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), "▁" not in (t or "")] += 1
        assert Counter(map(tuple, got)) == want
    assert piece_lattice.piece_digests(empty, PIECES).count() == 0


def test_encoded_documents_decode(odd):
    encoded = piece_lattice.encode_documents(odd, PIECES)
    assert sorted(encoded.columns) == sorted(odd.columns)
    back = piece_lattice.decode_documents(encoded.drop("text"), PIECES).select("doc_id", "text").collect()
    assert Counter(map(tuple, back)) == Counter((i, (t or "").replace("▁", " ")) for i, t, _, _ in TEXTS)


# --- token files --------------------------------------------------------------------------------

def library_ids(pairs):
    tokenizer = Tokenizer.from_file(WORDS)
    return [[*e.ids, 2] for e in tokenizer.encode_batch([t or "" for _, t in pairs], add_special_tokens=False)]


def test_token_files(spark, sf_dir, texts):
    pairs = sorted(texts.items())
    ids = library_ids(pairs)
    got = sorted(queries.op3_token_frames(spark, sf_dir).collect())
    starts = np.cumsum([0, *map(len, ids)]).tolist()
    assert [tuple(r) for r in got] == [
        (i, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, _), x, start in zip(pairs, ids, starts)]


def test_token_files_of_odd_rows(spark, odd, empty):
    pairs = [(i, t) for i, t, _, _ in TEXTS]
    index = token_frames.write_tokens(odd, scratch_path(spark, "tokens"), WORDS)
    got = token_frames.read_tokens(index, WORDS).collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == Counter(
        (i, tuple(x)) for (i, _), x in zip(pairs, library_ids(pairs)))
    # one document alone, from the middle of a file
    assert [r["ids"] for r in token_frames.read_tokens(index.filter("doc_id = 16"), WORDS).collect()] == [
        x for (i, _), x in zip(pairs, library_ids(pairs)) if i == 16]
    assert token_frames.token_digests(token_frames.write_tokens(empty, scratch_path(spark, "tokens"), WORDS), WORDS).count() == 0


@settings(max_examples=60, deadline=None)
@given(parts=st.lists(st.sampled_from([*"abT'sé\u0301  \n\x1c\x85<|>中9.Σ", "<|endoftext|>", "<|ENDOFTEXT|>", "'LL"]), max_size=40))
def test_words_alone_give_the_ids_of_the_text(parts):
    text = "".join(parts)
    coder = token_frames.WordCoder(WORDS)
    want = Tokenizer.from_file(WORDS).encode(text, add_special_tokens=False).ids
    assert coder.encode([text.encode()])[0].tolist() == want


def test_frames_are_independent_and_checked():
    import zstandard

    sink = io.BytesIO()
    writer = token_frames.FrameWriter(sink, "<u2")
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 49_000, n).astype(np.uint32) for n in (5, 0, 70_000, 600_000, 1, 65_536, 9)]
    at = [writer.add(d) for d in docs]
    writer.close()
    data = sink.getvalue()
    reader = token_frames.FrameReader(io.BytesIO(data), len(data), "<u2")
    assert len(reader.table) > 3 and max(reader.table[:, 1]) <= 2 * 5 * token_frames.FRAME_IDS
    for n in reversed(range(len(docs))):
        assert (reader.read(at[n], len(docs[n])) == docs[n]).all()
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert whole == np.concatenate(docs).astype("<u2").tobytes()
    reader.table[0, 2] ^= 1
    reader.last = (-1, reader.last[1])
    with pytest.raises(ValueError):
        reader.read(0, 3)


# --- spans --------------------------------------------------------------------------------------

def expected_spans(pairs):
    first = {}
    found = [(i, t or "", span_dedup.runs(t or "", span_dedup.RUN, span_dedup.MIN_WORDS)) for i, t in pairs]
    for i, _, own in found:
        for key, at, _ in own:
            place = (i is not None, i or 0, at)
            first[key] = min(first.get(key, place), place)
    for i, text, own in found:
        gone = {n for key, at, many in own if first[key] != (i is not None, i or 0, at) for n in range(at, at + many)}
        parts, gaps = span_dedup.sentences(text)
        yield i, "".join(p + g for n, (p, g) in enumerate(zip(parts, gaps)) if n not in gone)


def test_spans(spark, sf_dir, texts, odd, empty):
    got = queries.op4_span_dedup(spark, sf_dir).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(expected_spans(list(texts.items())))
    pairs = [(i, t) for i, t, _, _ in TEXTS]
    got = span_dedup.without_repeats(odd).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(expected_spans(pairs))
    by_id = {r["doc_id"]: r for r in got}
    # the passage stays where it is first, and goes where it is pasted or in capitals
    assert PASSAGE in by_id[1]["text"] and "Nobody owned the mill" not in by_id[3]["text"]
    assert by_id[3]["first_docs"] == [1] and by_id[1]["n_removed"] == 0
    assert span_dedup.without_repeats(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(text=st.text(st.sampled_from(list("ab. A\n,!é")), max_size=50))
def test_sentences_lose_nothing(text):
    parts, gaps = span_dedup.sentences(text)
    assert "".join(p + g for p, g in zip(parts, gaps)) == text


# --- language -----------------------------------------------------------------------------------

def test_language(spark, sf_dir, documents):
    got = {r["doc_id"]: r for r in queries.op5_lang_centroids(spark, sf_dir).collect()}
    truth = {r["doc_id"]: r["lang"] for r in documents.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sorted(i for i, r in got.items() if r["held_out"]) == sorted(held)
    assert sum(got[i]["lang_pred"] == truth[i] for i in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_of_odd_rows(odd, empty):
    held = queries.id_remainder(4) == 2
    got = lang_centroids.predict(odd, held).collect()
    assert len(got) == len(TEXTS)
    plain = {r["doc_id"]: r for r in got}
    for i, text, _, _ in TEXTS:
        assert (plain[i]["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))
    assert plain[5]["lang_pred"] == "de" and plain[12]["lang_pred"] == "en"
    assert lang_centroids.predict(empty, held).count() == 0
    assert {r["lang_pred"] for r in lang_centroids.predict(odd, F.lit(True)).collect()} == {"und"}


def test_sample_is_the_smallest_hashes_of_each_label(documents):
    rows = documents.filter("lang IS NOT NULL").select("doc_id", "text", "lang")
    both = rows.unionByName(rows)  # rows that repeat count once
    all_of = defaultdict(set)
    for r in rows.select("lang", F.xxhash64("doc_id", "text").alias("hash")).collect():
        all_of[r["lang"]].add(r["hash"])
    got = defaultdict(list)
    for r in lang_centroids.chosen_rows(both, 7, 500).collect():
        got[r["_lang"]].append(r["_hash"])
    assert {lang: sorted(h) for lang, h in got.items()} == {lang: sorted(h)[:7] for lang, h in all_of.items()}


def test_any_number_of_labels(documents):
    rows = documents.select("doc_id", "text", "lang")
    dirty = rows.unionByName(rows.select(
        "doc_id", "text", F.concat(F.lit("x"), F.col("doc_id").cast("string")).alias("lang")))
    got = lang_centroids.predict(dirty, F.lit(False), sample=40, languages=3)
    top = [r["lang"] for r in rows.filter("lang IS NOT NULL").groupBy("lang").count()
           .orderBy(F.desc("count"), "lang").limit(3).collect()]
    assert {r["lang_pred"] for r in got.select("lang_pred").distinct().collect()} <= {*top, "und"}


def plain_vector(text, idf):
    """Counts of n-grams in a dictionary, one n-gram after the other."""
    words = "".join(c if c.isalpha() else " " for c in text.lower())
    while "  " in words:
        words = words.replace("  ", " ")
    shown = " " + words.lstrip() + " "
    counts, mask = Counter(), 0xFFFFFFFF
    for begin in range(len(shown)):
        mixed = 0
        for n, factor in enumerate(int(f) for f in lang_centroids.SPREAD):
            if begin + n >= len(shown):
                break
            mixed = (mixed + ord(shown[begin + n])) * factor & mask
            mixed ^= mixed >> 15
            counts[mixed % lang_centroids.DIMENSIONS] += 1
    weights = {at: (1 + math.log(c)) * idf[at] for at, c in counts.items()}
    length = math.sqrt(sum(w * w for w in weights.values()))
    return {at: w / length for at, w in weights.items()}


def test_language_by_plain_loops(documents):
    rows = documents.filter("lang IS NOT NULL").select("doc_id", "text", "lang").filter("doc_id < 80")
    idf, found = lang_centroids.fit(rows, sample=10, centroids=2)
    frequencies, total = Counter(), 0
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    for text in texts.values():
        if any(c.isalpha() for c in text or ""):
            total += 1
            frequencies.update(plain_vector(text, np.ones(lang_centroids.DIMENSIONS)).keys())
    want_idf = [math.log((1 + total) / (1 + frequencies[at])) + 1 for at in range(lang_centroids.DIMENSIONS)]
    assert np.allclose(idf, want_idf)
    centers = [(lang, np.frombuffer(c, np.float32)) for lang, c in zip(found["lang"], found["center"])]
    got = {r["doc_id"]: r for r in lang_centroids.predict(rows, F.lit(False), sample=10, centroids=2).collect()}
    for i, text in texts.items():
        if not any(c.isalpha() for c in text or ""):
            assert got[i]["lang_pred"] == "und"
            continue
        vector = plain_vector(text, want_idf)
        near = [(sum(w * float(c[at]) for at, w in vector.items()), lang) for lang, c in centers]
        best = max(score for score, _ in near)
        assert abs(got[i]["score"] - best) < 1e-5
        assert got[i]["lang_pred"] in {lang for score, lang in near if score > best - 1e-5}


def test_far_texts_are_rejected(documents):
    held = queries.id_remainder(4) == 2
    strange = documents.limit(20).selectExpr("-doc_id - 1 AS doc_id", "'ъыц жщш ѣѣ юфх ' || doc_id AS text", "lang")
    got = lang_centroids.predict(documents.select("doc_id", "text", "lang").unionByName(
        strange.withColumn("lang", F.lit(None).cast("string"))), held).collect()
    assert all(r["rejected"] for r in got if r["doc_id"] < 0)
    assert sum(r["rejected"] for r in got if r["doc_id"] >= 0) < 0.1 * len(got)


# --- similarity ---------------------------------------------------------------------------------

def shingle_set(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[n : n + width]) for n in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def expected_components(pairs, width, percent):
    sets = [(i, shingle_set(t, width)) for i, t in pairs]
    parent = list(range(len(sets)))

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    holders = defaultdict(list)
    for n, (_, s) in enumerate(sets):
        for g in s:
            holders[g].append(n)
    for n, (i, s) in enumerate(sets):
        common = Counter(m for g in s for m in holders[g] if m < n)
        for m, k in common.items():
            if 100 * k >= percent * (len(s) + len(sets[m][1]) - k):
                parent[root(n)] = root(m)
    names = defaultdict(list)
    for n, (i, _) in enumerate(sets):
        if i is not None:
            names[root(n)].append(i)
    return Counter((i, len(s), min(names[root(n)], default=None)) for n, (i, s) in enumerate(sets))


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80)])
def test_components(documents, texts, width, percent):
    got = Counter(map(tuple, prefix_join.similar_documents(documents, width, percent, count_bits=12).collect()))
    assert got == expected_components(list(texts.items()), width, percent)


def test_components_of_a_dense_group(spark):
    """Copies with up to four edits each: some link to the base, some to each other, some to nothing."""
    rnd = random.Random(7)
    base = [f"w{rnd.randrange(400)}" for _ in range(150)]
    pairs = [(0, " ".join(base))]
    for i in range(1, 150):
        own = list(base)
        for _ in range(rnd.randrange(5)):
            own[rnd.randrange(150)] = f"x{rnd.randrange(40)}"
        pairs.append((i, " ".join(own)))
    pairs += [(1000 + i, " ".join(base[: 80] + [f"y{i}-{k}" for k in range(70)])) for i in range(40)]
    table = spark.createDataFrame(pairs, "doc_id bigint, text string").repartition(4)
    got = Counter(map(tuple, prefix_join.similar_documents(table, 3, 90, count_bits=10).collect()))
    assert got == expected_components(pairs, 3, 90)


def test_components_of_odd_rows(odd, empty):
    got = Counter((r["doc_id"], r["n_shingles"]) for r in prefix_join.similar_documents(odd).collect())
    assert got == Counter((i, len(shingle_set(t, 3))) for i, t, _, _ in TEXTS)
    named = {r["doc_id"]: r["component_id"] for r in prefix_join.similar_documents(odd).collect()}
    assert named[2] == 1 and named[5] == 4 and named[11] == 10 and named[13] == 12 and named[8] == 8
    assert prefix_join.similar_documents(empty).count() == 0
    kept = prefix_join.drop_similar(odd)
    assert kept.columns == odd.columns
    assert {r["doc_id"] for r in kept.collect()} >= {1, 3, 4, 6, 7, 8, 9, 10, 12}
    assert not {r["doc_id"] for r in kept.collect()} & {2, 5, 11, 13}


def test_matches_are_the_cheapest():
    for n in (1, 5, 60, 700):
        for partners in (np.zeros(n), np.full(n, 50.0), np.linspace(0, 300, n)):
            m = prefix_join.choose_matches(partners, n, 90)
            assert 1 <= m <= min(prefix_join.MOST_MATCHES, prefix_join.needed(n, 90))
    assert prefix_join.choose_matches(np.zeros(300), 300, 90) == 1
    assert prefix_join.choose_matches(np.full(300, 50.0), 300, 90) > 4


def test_encode_and_decode_in_one_pass(odd, spark):
    two = piece_lattice.decode_documents(piece_lattice.encode_documents(odd, PIECES), PIECES)
    one = piece_lattice.encode_documents(odd, PIECES, decode=True)
    assert Counter(map(str, one.select(two.columns).collect())) == Counter(map(str, two.collect()))
    # texts far longer than a slice, between others
    long = "many words of one long text " * 120_000
    docs = spark.createDataFrame([(1, "a b"), (2, long), (3, None), (4, "c")], "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r for r in piece_lattice.encode_documents(docs, PIECES, decode=True).collect()}
    assert got[2]["text"] == long and got[3]["text"] == "" and got[3]["ids"] == [] and got[4]["text"] == "c"
    back = piece_lattice.decode_documents(piece_lattice.encode_documents(docs, PIECES).drop("text"), PIECES)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: r["text"] for i, r in got.items()}


def test_a_text_is_not_dropped_for_another_of_its_id(spark):
    text = " ".join(f"word{n}" for n in range(60))
    near = text.replace("word59", "other")
    rows = [(1, text), (2, text), (2, "something with nothing in common at all"), (None, text), (None, near),
            (None, "one more text that is like no other"), (3, near), (4, None), (4, ""), (None, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, number string").repartition(3)
    got = prefix_join.drop_similar(docs)
    assert got.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter(
        [rows[0], rows[2], rows[5], rows[7], rows[8], rows[9]])
