"""Language-model scores by a hidden Markov model over words.

``STATES`` hidden states emit words; Baum-Welch trains them on the training documents, and the
scaled forward recursion gives the exact likelihood of every whole document, its end included.

Tokens are words in lower case (A-Z) and one end token per document. A word seen ``OWN`` times or
more in training has an emission of its own; rarer words share the emissions of their class (how
often seen, and a hash of the last two bytes) in proportion to their base probability, and all
unseen words are one outcome. Emissions are smoothed by ``MU`` tokens of the base distribution,
so they sum to one over the same outcomes as the base model does. A training sequence is a whole
document. Many advance together; of the forward pass only the vectors at every ``SPAN``-th token are
kept and the rest is computed again on the way back, so long documents need little memory.

How it is spread: a task turns its documents into blocks of numbered tokens, a file each in the
shared folder, and a list of the block's distinct words. Words are dealt into buckets by hash;
each bucket counts its words and holds their expected counts per state as one small matrix. In a
round, every block asks the buckets for the rows of its own words, computes forward and backward
over its files and sends expected counts back to the buckets, where they are added up. Only class
counts, transitions and sums per state (about a thousand numbers) meet in the driver; words,
counts and emissions never do. A block's files are named by rows of the task attempts that Spark
committed.

A null or blank text is its end token alone. A null id is given to a training document. Rows that
repeat are scored each and, in training, counted each. Without training documents every token
has base probability one. Empty table: empty result. Columns beyond id and text are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackfold.llm.base import text_bytes
from trackfold.session import cut, scratch_path

STATES = 8
ROUNDS = 3
OWN = 5
MU = 20_000.0
SPAN = 128
SUFFIXES = 64
STAY = 0.9
CLASSES = 1 + 2 * SUFFIXES  # unseen; seen once by suffix; seen up to OWN - 1 times by suffix
BLOCK_BYTES = 32 << 20
BUCKETS = (64, 4096)
TOGETHER = 4096
COUNTED = 1 << 18
SUMS = CLASSES * STATES + STATES * STATES + STATES
END = b""

REQUEST = "block string, file string, bucket int, words binary, local binary, counts binary"
ANSWER = "block string, file string, bucket int, slots int, local binary, row binary, c binary"
ASK = "block string, file string, words string, bucket int, slots int, row binary"
GATHERED = ASK + ", part binary"


@dataclass(frozen=True)
class Model:
    """What every task needs besides the buckets: totals, class counts, transitions."""

    tokens: int
    distinct: int
    class_base: np.ndarray  # base probability of each class
    class_counts: np.ndarray  # classes x states
    state_totals: np.ndarray
    transitions: np.ndarray
    first: np.ndarray

    def base(self, c: np.ndarray) -> np.ndarray:
        return (c + 0.5) / (self.tokens + 0.5 * (self.distinct + 1))

    def emission(self, counts: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Rows of states' probabilities, from expected counts and base probabilities."""
        return (counts + MU * base[:, None]) / (self.state_totals + MU)


def word_class(word: bytes, c: int) -> int:
    """The class of a word that has no emission of its own."""
    return 0 if c == 0 else 1 + zlib.crc32(word[-2:]) % SUFFIXES + (SUFFIXES if c > 1 else 0)


def first_share(suffix: np.ndarray) -> np.ndarray:
    """Where counts start from: words of one suffix lean to one state."""
    share = np.full((len(suffix), STATES), 0.2)
    share[np.arange(len(suffix)), suffix % STATES] += 1
    return share / share.sum(axis=1, keepdims=True)


# --- blocks -------------------------------------------------------------------------------------

class Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def _blocks(rows: DataFrame, path: str, buckets: int) -> DataFrame:
    """Write blocks of ``doc_id, train, text`` as numbered tokens; what each asks of each bucket."""
    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        numbers, ids, flags, tokens, size, made = Numbers(), [], [], [], 0, 0

        def close() -> Iterator[pa.RecordBatch]:
            block = f"{task.partitionId():06d}-{made:04d}"
            file = f"{path}/{block}-{task.taskAttemptId()}.parquet"
            lengths = np.array([len(t) for t in tokens])
            flat = np.concatenate(tokens)
            offsets = pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int64())
            table = pa.table({
                "doc_id": pa.array(ids, pa.int64()), "train": pa.array(flags, pa.bool_()),
                "tokens": pa.LargeListArray.from_arrays(offsets, pa.array(flat))})
            fs, at = pa.fs.FileSystem.from_uri(file)
            fs.create_dir(at.rpartition("/")[0], recursive=True)
            pq.write_table(table, at, filesystem=fs, compression="zstd", use_dictionary=False)
            counts = np.bincount(
                flat[np.repeat(np.array(flags, bool), lengths)], minlength=len(numbers)).astype(np.int64)
            words = list(numbers)
            bucket = np.fromiter((xxhash.xxh32_intdigest(w) % buckets for w in words), np.int64, len(words))
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in range(buckets):
                own = order[edges[b] : edges[b + 1]]
                if len(own):
                    yield pa.RecordBatch.from_arrays([
                        pa.array([block]), pa.array([file]), pa.array([b], pa.int32()),
                        pa.array([b"\n".join(words[n] for n in own)], pa.binary()),
                        pa.array([own.astype(np.uint32).tobytes()], pa.binary()),
                        pa.array([counts[own].tobytes()], pa.binary())],
                        names=["block", "file", "bucket", "words", "local", "counts"])

        for batch in batches:
            for doc_id, train, text in zip(
                    batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2))):
                words = text.lower().split()
                words.append(END)
                tokens.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
                ids.append(doc_id)
                flags.append(train)
                size += len(text) + 1
                if size >= BLOCK_BYTES:
                    yield from close()
                    numbers, ids, flags, tokens, size, made = Numbers(), [], [], [], 0, made + 1
        if ids:
            yield from close()

    return rows.mapInArrow(tokenize, REQUEST)


def _split(words: bytes) -> list[bytes]:
    return words.split(b"\n")


def _count_words(requests: DataFrame) -> DataFrame:
    """Per bucket its words and their training counts, as one row: ``bucket, words, counts``."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, numbers, sums = None, Numbers(), np.zeros(0, np.int64)

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int32()), pa.array([b"\n".join(numbers)], pa.large_binary()).cast(pa.binary()),
                 pa.array([sums[: len(numbers)].tobytes()], pa.binary())], names=["bucket", "words", "counts"])

        for batch in batches:
            for bucket, words, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != now:
                    if now is not None:
                        yield close()
                    now, numbers, sums = bucket, Numbers(), np.zeros(0, np.int64)
                words = _split(words)
                at = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
                if len(numbers) > len(sums):
                    sums = np.concatenate([sums, np.zeros(len(numbers), np.int64)])
                sums[at] += np.frombuffer(counts, np.int64)
        if now is not None:
            yield close()

    rows = requests.select("bucket", "words", "counts")
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        count, "bucket int, words binary, counts binary")


def _own_rows(words: list[bytes], counts: np.ndarray) -> np.ndarray:
    """Row of each word in its bucket's matrix, or ``-1 - class`` for words without one."""
    own = counts >= OWN
    row = np.where(own, np.cumsum(own) - 1, 0).astype(np.int64)
    for n in np.flatnonzero(~own).tolist():
        row[n] = -1 - word_class(words[n], int(counts[n]))
    return row


def _answers(requests: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Per block and bucket the row and the training count of each of its words."""
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        row = counts = None
        slots = 0
        for batch in batches:
            for kind, bucket, block, file, words, local, held in zip(*(c.to_pylist() for c in batch.columns)):
                words = _split(words)
                if kind == 0:
                    counts = np.frombuffer(held, np.int64)
                    known = {w: n for n, w in enumerate(words)}
                    row, slots = _own_rows(words, counts), int((counts >= OWN).sum())
                    continue
                at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                yield pa.RecordBatch.from_arrays([
                    pa.array([block]), pa.array([file]), pa.array([bucket], pa.int32()), pa.array([slots], pa.int32()),
                    pa.array([local], pa.binary()), pa.array([row[at].astype(np.int32).tobytes()], pa.binary()),
                    pa.array([counts[at].tobytes()], pa.binary())],
                    names=["block", "file", "bucket", "slots", "local", "row", "c"])

    asked = requests.select(F.lit(1).alias("kind"), "bucket", "block", "file", "words", "local", F.lit(None).cast("binary").alias("held"))
    head = vocabulary.select(
        F.lit(0).alias("kind"), "bucket", F.lit(None).cast("string").alias("block"), F.lit(None).cast("string").alias("file"),
        "words", F.lit(None).cast("binary").alias("local"), F.col("counts").alias("held"))
    rows = head.unionByName(asked).repartition("bucket").sortWithinPartitions("bucket", "kind")
    return rows.mapInArrow(answer, ANSWER)


def _start(vocabulary: DataFrame) -> tuple[DataFrame, Model]:
    """The buckets' first matrices and the model they begin with."""
    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, words, counts in zip(*(c.to_pylist() for c in batch.columns)):
                words, counts = _split(words), np.frombuffer(counts, np.int64)
                suffix = np.fromiter((zlib.crc32(w[-2:]) % SUFFIXES for w in words), np.int64, len(words))
                own = counts >= OWN
                matrix = counts[own, None] * first_share(suffix[own])
                kind = -1 - _own_rows(words, counts)
                rare = ~own & (counts > 0)
                numbers = np.bincount(kind[rare], minlength=CLASSES)
                sums = np.bincount(kind[rare], weights=counts[rare], minlength=CLASSES)
                yield pa.RecordBatch.from_arrays([
                    pa.array([bucket], pa.int32()), pa.array([matrix.astype(np.float32).tobytes()], pa.binary()),
                    pa.array([matrix.sum(axis=0).tolist()], pa.list_(pa.float64())),
                    pa.array([int(counts.sum())], pa.int64()), pa.array([int((counts > 0).sum())], pa.int64()),
                    pa.array([numbers.tolist()], pa.list_(pa.int64())), pa.array([sums.astype(np.int64).tolist()], pa.list_(pa.int64()))],
                    names=["bucket", "matrix", "totals", "tokens", "distinct", "class_words", "class_tokens"])

    started = cut(vocabulary.select("bucket", "words", "counts").mapInArrow(
        begin, "bucket int, matrix binary, totals array<double>, tokens bigint, distinct bigint, "
               "class_words array<bigint>, class_tokens array<bigint>"))
    tokens, distinct = started.agg(F.sum("tokens"), F.sum("distinct")).first()
    tokens, distinct = tokens or 0, distinct or 0
    words = _summed(started, "class_words", CLASSES)
    sums = _summed(started, "class_tokens", CLASSES)
    share = first_share(np.concatenate(([0], np.arange(SUFFIXES), np.arange(SUFFIXES))))
    counts = sums[:, None] * share
    base = (sums + 0.5 * words) / (tokens + 0.5 * (distinct + 1))
    base[0] = 0.5 / (tokens + 0.5 * (distinct + 1))
    moves = np.full((STATES, STATES), (1 - STAY) / (STATES - 1))
    np.fill_diagonal(moves, STAY)
    model = Model(tokens, distinct, base, counts, _summed(started, "totals", STATES) + counts.sum(axis=0), moves,
                  np.full(STATES, 1 / STATES))
    return started.select("bucket", "matrix", "totals"), model


def _summed(rows: DataFrame, column: str, length: int) -> np.ndarray:
    """Sum of an array column of fixed length, place by place."""
    out = np.zeros(length)
    parts = rows.select(F.posexplode(column).alias("at", "value")).groupBy("at").agg(F.sum("value").alias("value"))
    for r in parts.collect():
        out[r["at"]] = r["value"]
    return out


def _asks(answers: DataFrame, path: str) -> DataFrame:
    """Keep what a block knows of its words in a file of its own; what it asks for in every round.

    The file has, in the order of the block's numbers, the row of each word in the block's matrix
    (classes first, then own words bucket by bucket) and its training count. Asked for are the
    bucket rows of own words: one row per bucket, or an empty one for a block without such words.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        names = [f.split()[0] for f in ASK.split(", ")]
        for rows in _by_block(batches):
            block, file = rows[0][0], rows[0][1]
            local = [np.frombuffer(r[4], np.uint32) for r in rows]
            at, c = np.zeros(sum(map(len, local)), np.int32), np.zeros(sum(map(len, local)), np.int64)
            first, asked = CLASSES, []
            for r, numbers in zip(rows, local):
                row = np.frombuffer(r[5], np.int32)
                own = row >= 0
                c[numbers] = np.frombuffer(r[6], np.int64)
                at[numbers[~own]] = -1 - row[~own]
                at[numbers[own]] = first + np.arange(own.sum())
                first += int(own.sum())
                if own.any():
                    asked.append((r[2], r[3], row[own].tobytes()))
            name = f"{path}/{block}-words-{attempt}.parquet"
            fs, place = pa.fs.FileSystem.from_uri(name)
            fs.create_dir(place.rpartition("/")[0], recursive=True)
            pq.write_table(pa.table({"at": at, "c": c}), place, filesystem=fs, compression="zstd", use_dictionary=False)
            for bucket, slots, row in asked or [(rows[0][2], rows[0][3], b"")]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], t) for v, t in zip((block, file, name, bucket, slots, row), GATHERED_TYPES)], names=names)

    rows = answers.repartition("block").sortWithinPartitions("block", "bucket")
    return rows.mapInArrow(write, ASK)


# --- one round ----------------------------------------------------------------------------------

def _gather(asks: DataFrame, matrices: DataFrame) -> DataFrame:
    """The asked rows of the buckets' matrices, by block and bucket."""
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = None
        for batch in batches:
            for kind, *rest, held in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    matrix = np.frombuffer(held, np.float32).reshape(-1, STATES)
                    continue
                row = np.frombuffer(rest[5], np.int32)
                part = matrix[row].tobytes() if len(row) else b""
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], t) for v, t in zip([*rest, part], GATHERED_TYPES)], names=GATHERED_NAMES)

    names = [f.split()[0] for f in ASK.split(", ")]
    asked = asks.select(F.lit(1).alias("kind"), *names, F.lit(None).cast("binary").alias("matrix"))
    head = matrices.select(F.lit(0).alias("kind"), "bucket", "matrix")
    rows = head.unionByName(asked, allowMissingColumns=True).select("kind", *names, "matrix")
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(pick, GATHERED)
    return rows.repartition("block").sortWithinPartitions("block", "bucket")


GATHERED_TYPES = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
GATHERED_NAMES = [f.split()[0] for f in GATHERED.split(", ")]


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each block, from rows sorted by block; holds one block's at a time."""
    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if rows and row[0] != rows[0][0]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _read(file: str) -> pa.Table:
    fs, at = pa.fs.FileSystem.from_uri(file)
    return pq.read_table(at, filesystem=fs).combine_chunks()


class Block:
    """A block's tokens with everything its words need: emission rows, counts, base probabilities."""

    def __init__(self, rows: list[tuple], model: Model):
        words = _read(rows[0][2])
        self.at, self.c = words.column("at").to_numpy().astype(np.int64), words.column("c").to_numpy()
        parts, self.buckets = [model.class_counts], []
        first = CLASSES
        for r in rows:
            own = np.frombuffer(r[5], np.int32)
            parts.append(np.frombuffer(r[6], np.float32).reshape(-1, STATES))
            self.buckets.append((r[3], r[4], own, first, first + len(own)))
            first += len(own)
        base = np.concatenate([model.class_base, np.zeros(first - CLASSES)])
        own = self.at >= CLASSES
        base[self.at[own]] = model.base(self.c[own])
        self.emission = model.emission(np.concatenate(parts), base)
        # a rare word's part of its class does not depend on the state
        self.log_base = np.log10(model.base(self.c))
        self.log_part = np.where(own, 0.0, self.log_base - np.log10(np.maximum(base[self.at], 1e-300)))
        table = _read(rows[0][1])
        self.ids = table.column("doc_id")
        self.train = table.column("train").to_numpy()
        tokens = table.column("tokens").chunk(0)
        self.first = tokens.offsets.to_numpy()[:-1]
        self.length = np.diff(tokens.offsets.to_numpy())
        self.tokens = tokens.values.to_numpy()


def expected_counts(
    tokens: np.ndarray, first: np.ndarray, length: np.ndarray, emission: np.ndarray, moves: np.ndarray, start: np.ndarray,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch expectations of sequences: per emission row, per transition, per first state.

    ``tokens`` are rows of ``emission``. States run along the first axis, sequences along the
    second, longest first; a step handles all sequences that are that long.
    """
    states = len(start)
    emission = np.ascontiguousarray(emission.T, np.float32)
    into, start_column = np.ascontiguousarray(moves.T, np.float32), start.astype(np.float32)[:, None]
    moves32 = moves.astype(np.float32)
    counts = np.zeros((states, emission.shape[1]))
    pairs, firsts = np.zeros((states, states)), np.zeros(states)
    where, gammas, held = [], [], 0

    def forward(alpha: np.ndarray | None, now: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        reached = np.repeat(start_column, len(now), axis=1) if alpha is None else into @ alpha[:, : len(now)]
        alpha = reached * emission.take(now, axis=1)
        scale = alpha.sum(axis=0)
        alpha /= scale
        return alpha, scale

    def count() -> None:
        flat = np.concatenate(where)
        for k in range(states):
            counts[k] += np.bincount(flat, weights=np.concatenate([g[k] for g in gammas]), minlength=counts.shape[1])
        where.clear()
        gammas.clear()

    order = np.argsort(-length, kind="stable")
    for at in range(0, len(order), TOGETHER):
        begin, long = first[order[at : at + TOGETHER]], length[order[at : at + TOGETHER]]
        alive = (len(long) - np.searchsorted(long[::-1], np.arange(long[0]), "right")).tolist()
        kept, alpha = [], None
        for t, n in enumerate(alive):
            if t % SPAN == 0:
                kept.append(alpha)
                if t + SPAN >= len(alive):
                    break
            alpha, _ = forward(alpha, tokens[begin[:n] + t])
        ahead = None
        for low in range((len(kept) - 1) * SPAN, -1, -SPAN):
            alpha, steps = kept.pop(), []
            for t, n in enumerate(alive[low : low + SPAN], low):
                now = tokens[begin[:n] + t]
                alpha, scale = forward(alpha, now)
                steps.append((alpha, scale, now))
            for alpha, scale, now in reversed(steps):
                beta = np.ones((states, len(now)), np.float32)
                if ahead is not None:
                    n = ahead.shape[1]
                    pairs += alpha[:, :n] @ ahead.T
                    beta[:, :n] = moves32 @ ahead
                gammas.append(alpha * beta)
                where.append(now)
                held += len(now)
                ahead = emission.take(now, axis=1) * beta / scale
            if low == 0:
                firsts += gammas[-1].sum(axis=1)
            if held >= COUNTED:
                count()
                held = 0
    if where:
        count()
    return counts.T, pairs * moves, firsts


def log_likelihoods(
    tokens: np.ndarray, first: np.ndarray, length: np.ndarray, emission: np.ndarray, moves: np.ndarray, start: np.ndarray,
) -> np.ndarray:
    """log10 probability of each whole sequence by the scaled forward recursion."""
    emission, into = np.ascontiguousarray(emission.T), np.ascontiguousarray(moves.T)
    out = np.zeros(len(length))
    order = np.argsort(-length, kind="stable")
    begin, long = first[order], length[order]
    sums, alpha = np.zeros(len(order)), None
    alive = len(long) - np.searchsorted(long[::-1], np.arange(long[0]), "right") if len(long) else []
    for t, n in enumerate(np.asarray(alive).tolist()):
        reached = np.repeat(start[:, None], n, axis=1) if alpha is None else into @ alpha[:, :n]
        alpha = reached * emission.take(tokens[begin[:n] + t], axis=1)
        scale = alpha.sum(axis=0)
        alpha /= scale
        sums[:n] += np.log10(scale)
    out[order] = sums
    return out


def _expect(gathered: DataFrame, model: Model) -> DataFrame:
    """Expected counts of all blocks: a row per block and bucket, and each task's sums (bucket -1)."""
    shared = gathered.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        classes, pairs, firsts = np.zeros((CLASSES, STATES)), np.zeros((STATES, STATES)), np.zeros(STATES)
        row = lambda bucket, slots, at, counts: pa.RecordBatch.from_arrays(
            [pa.array([bucket], pa.int32()), pa.array([slots], pa.int32()), pa.array([at.tobytes()], pa.binary()),
             pa.array([counts.tobytes()], pa.binary())], names=["bucket", "slots", "row", "counts"])
        for block in (Block(rows, model) for rows in _by_block(batches)):
            if not block.train.any():
                continue
            counts, p, f = expected_counts(
                block.at[block.tokens], block.first[block.train], block.length[block.train], block.emission,
                model.transitions, model.first)
            classes, pairs, firsts = classes + counts[:CLASSES], pairs + p, firsts + f
            for bucket, slots, own, low, high in block.buckets:
                if high > low:
                    yield row(bucket, slots, own.astype(np.int32), counts[low:high].astype(np.float32))
        yield row(-1, 0, np.zeros(0, np.int32), np.concatenate([classes.ravel(), pairs.ravel(), firsts]))

    return gathered.mapInArrow(run, "bucket int, slots int, row binary, counts binary")


def _add_up(expected: DataFrame) -> DataFrame:
    """The buckets' new matrices: expected counts of all blocks summed per bucket.

    The tasks' sums come out as the totals of bucket -1.
    """
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, matrix = None, None

        def close() -> pa.RecordBatch:
            held, totals = (b"", matrix) if now < 0 else (matrix.astype(np.float32).tobytes(), matrix.sum(axis=0))
            return pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int32()), pa.array([held], pa.binary()),
                 pa.array([totals.tolist()], pa.list_(pa.float64()))], names=["bucket", "matrix", "totals"])

        for batch in batches:
            for bucket, slots, row, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != now:
                    if now is not None:
                        yield close()
                    now, matrix = bucket, np.zeros((slots, STATES) if bucket >= 0 else SUMS)
                if bucket < 0:
                    matrix += np.frombuffer(counts)
                else:
                    matrix[np.frombuffer(row, np.int32)] += np.frombuffer(counts, np.float32).reshape(-1, STATES)
        if now is not None:
            yield close()

    rows = expected.repartition("bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(add, "bucket int, matrix binary, totals array<double>")


def _reestimate(model: Model, added: DataFrame) -> Model:
    """The next model from the tasks' sums of class counts, transitions and first states."""
    sums = _summed(added.filter("bucket = -1"), "totals", SUMS)
    classes = sums[: CLASSES * STATES].reshape(CLASSES, STATES)
    moves = sums[CLASSES * STATES : -STATES].reshape(STATES, STATES) + 1
    firsts = sums[-STATES:] + 1
    return replace(
        model, class_counts=classes,
        state_totals=_summed(added.filter("bucket >= 0"), "totals", STATES) + classes.sum(axis=0),
        transitions=moves / moves.sum(axis=1, keepdims=True), first=firsts / firsts.sum())


def _score(gathered: DataFrame, model: Model) -> DataFrame:
    shared = gathered.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for block in (Block(rows, model) for rows in _by_block(batches)):
            sums = lambda values: np.add.reduceat(values[block.tokens], block.first)
            score = log_likelihoods(
                block.at[block.tokens], block.first, block.length, block.emission, model.transitions, model.first)
            yield pa.RecordBatch.from_arrays([
                block.ids.combine_chunks(), pa.array(~block.train), pa.array(block.length.astype(np.int64)),
                pa.array(sums((block.c > 0).astype(np.int64))), pa.array(np.full(len(score), model.tokens)),
                pa.array(sums(block.log_base)), pa.array(score + sums(block.log_part))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return gathered.mapInArrow(run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, "
                                    "train_tokens bigint, base_score double, score double")


def score_documents(
    docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS,
) -> DataFrame:
    """Per row ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Scores are log10 probabilities; training takes all rows for which ``held_out`` is not true.
    """
    path = scratch_path(docs.sparkSession, f"blocks-{uuid.uuid4().hex[:6]}")
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), (~F.coalesce(held_out, F.lit(False))).alias("train"),
        F.col(text_col).alias("text"))
    # words per bucket stay about the same while the table grows
    buckets = int(np.clip(2 * rows.rdd.getNumPartitions(), *BUCKETS))
    requests = cut(_blocks(rows, path, buckets))
    vocabulary = cut(_count_words(requests))
    asks = cut(_asks(_answers(requests, vocabulary), path))
    matrices, model = _start(vocabulary)
    for _ in range(rounds):
        added = cut(_add_up(_expect(_gather(asks, matrices), model)))
        matrices, model = added.filter("bucket >= 0"), _reestimate(model, added)
    return _score(_gather(asks, matrices), model)
