"""Language-model scoring by a hidden Markov model over word classes.

A token's class is a hash of it. A state emits a class, and a class emits its tokens
by their corpus counts, so the states' tables are of a fixed size while the counts
grow with the vocabulary. Baum-Welch counts are made in every partition over all
training documents and added up, from a starting point that is drawn from all of them
as well; how far tables are smoothed is chosen by documents set aside. The forward
recursion, scaled at each step, gives a text's exact probability. Counts of tokens never meet in one place: blocks of
documents ask buckets of tokens for the counts that they need.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Kept
from .common import LOWER, TEXT, bounded_batches, checkpointed, drop_path, gathered, plan_bytes, quoted, runs_of_equal, work_dir

#: Hidden states, classes, Baum-Welch rounds over all training documents, at most.
STATES, CLASSES, ROUNDS = 6, 8192, 3
#: The rounds end when the log-likelihood of the documents set aside gains less than this part of it.
GAIN = 2e-3
#: Classes are folded to so many for the starting point; rounds, and tries, of a mixture that groups documents there.
FOLDED, SEED_ROUNDS, SEED_TRIES = 256, 15, 4
#: Rows of groups that one task unites.
UNITED = 256
#: One document in so many is set aside to choose the prior.
ASIDE = 8
#: Weights of the classes' overall shares in a state's table, in tokens, to choose from.
PRIORS = (10.0, 30.0, 100.0, 300.0, 1000.0, 3000.0, 10000.0, 30000.0, 100000.0)
#: Tokens of a batch of sequences, and bytes of text from which batches are made.
BATCH_TOKENS, SLICE = 300_000, 12 << 20
BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 8 << 20
#: Buckets of whole classes, at most; a divisor of CLASSES.
WHOLE = 4096
#: The end of a text as a token: no word holds white space.
END = xxhash.xxh3_64_intdigest(b"\n")


class Hasher:
    """64-bit hashes of a text's tokens: words without white space, A-Z in lower case, and the end."""

    def __init__(self):
        self.known = Kept(lambda words: [xxhash.xxh3_64_intdigest(w) for w in words])

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "replace").translate(LOWER).split()
        known = self.known.having(set(words))
        out = np.empty(len(words) + 1, np.uint64)
        out[:-1] = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        out[-1] = END
        return out


def class_of(hashes: np.ndarray) -> np.ndarray:
    return ((hashes >> np.uint64(32)) % np.uint64(CLASSES)).astype(np.int32)


class Model:
    """start[k], move[k, j], emit[c, k]: emit holds a state's share of each class."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @staticmethod
    def of_counts(start: np.ndarray, move: np.ndarray, emit: np.ndarray, prior: float) -> Model:
        """From expected counts; no probability is 0."""
        return Model((start + 0.1) / (start + 0.1).sum(), (move + 0.1) / (move + 0.1).sum(1, keepdims=True), table_of(emit, prior))

    @staticmethod
    def seeded(groups: np.ndarray, prior: float) -> Model:
        """A starting point, in which a document mostly stays in the state of its group; `groups`: tokens of each class by group."""
        emit = groups.T
        weight = (emit.sum(0) + 1) / (emit.sum() + STATES)
        return Model(weight, np.full((STATES, STATES), 0.1 / STATES) + 0.9 * np.eye(STATES), table_of(emit, prior))


def table_of(emit: np.ndarray, prior: float) -> np.ndarray:
    share = (emit.sum(1) + 1) / (emit.sum() + len(emit))
    return (emit + prior * share[:, None]) / (emit.sum(0) + prior)


def deleted(rest: np.ndarray, aside: np.ndarray) -> float:
    """The prior with which tables of the counts `rest` give the counts `aside` the largest likelihood."""
    return max(PRIORS, key=lambda p: float((aside * np.log(table_of(rest, p))).sum()))


def grouped(rows: np.ndarray) -> np.ndarray:
    """A group for each row of numbers of tokens by class: a mixture fitted by expectation and maximisation."""
    counts = rows.reshape(len(rows), -1, FOLDED).sum(1).astype(np.float64)
    counts /= np.maximum(1.0, counts.sum(1, keepdims=True) / 1000)  # a long document weighs as a thousand tokens
    overall = (counts.sum(0) + 1) / (counts.sum() + FOLDED)
    rng, best = np.random.default_rng(7), (-math.inf, np.zeros(len(rows), np.int64))
    for _ in range(SEED_TRIES):
        part = rng.dirichlet(np.full(STATES, 0.3), len(rows))
        for _ in range(SEED_ROUNDS):
            emit = counts.T @ part
            table = (emit + 100 * overall[:, None]) / (emit.sum(0) + 100)
            log = counts @ np.log(table) + np.log((part.sum(0) + 1) / (len(rows) + STATES))
            most = log.max(1, keepdims=True)
            part = np.exp(log - most)
            whole = part.sum(1, keepdims=True)
            part /= whole
        best = max(best, (float((most + np.log(whole)).sum()), log.argmax(1)), key=lambda x: x[0])
    return best[1]


def united(rows: np.ndarray) -> np.ndarray:
    """Rows of numbers of tokens by class, united to STATES groups."""
    out = np.zeros((STATES, CLASSES))
    if len(rows):
        np.add.at(out, grouped(rows), rows)
    return out


def groups_of(docs: list[np.ndarray]) -> np.ndarray:
    """The same for documents, without a row of all classes for each."""
    if not docs:
        return np.zeros((STATES, CLASSES))
    flat, of = np.concatenate(docs), np.repeat(np.arange(len(docs)), list(map(len, docs)))
    folded = np.bincount(of * FOLDED + flat % FOLDED, minlength=len(docs) * FOLDED).reshape(len(docs), FOLDED)
    return np.bincount(grouped(folded)[of] * CLASSES + flat, minlength=STATES * CLASSES).reshape(STATES, CLASSES).astype(float)


def batches_of(docs: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Documents by falling length, as (their places, lengths, classes by step and document)."""
    order = sorted(range(len(docs)), key=lambda k: -len(docs[k]))
    at = 0
    while at < len(order):
        steps = len(docs[order[at]])
        part = order[at : at + max(1, BATCH_TOKENS // steps)]
        seen = np.zeros((steps, len(part)), np.int32)
        for j, k in enumerate(part):
            seen[: len(docs[k]), j] = docs[k]
        yield np.array(part), np.array([len(docs[k]) for k in part]), seen
        at += len(part)


def forward(model: Model, lengths: np.ndarray, seen: np.ndarray, keep: bool = False):
    """Logarithms (base 10) of the sequences' probabilities; if `keep`, the scaled states and the scales too."""
    steps, n = seen.shape
    active = np.searchsorted(-lengths, -np.arange(steps), "left").tolist()  # sequences longer than t
    scale = np.ones((steps, n))
    states = np.zeros((steps, n, len(model.start))) if keep else None
    alpha = None
    for t in range(steps):
        m = active[t]
        own = model.emit[seen[t, :m]]
        alpha = own * model.start if t == 0 else (alpha[:m] @ model.move) * own
        s = alpha.sum(1)
        alpha /= s[:, None]
        scale[t, :m] = s
        if keep:
            states[t, :m] = alpha
    log = np.log10(scale).sum(0)
    return (log, states, scale, active) if keep else log


def expected(model: Model, docs: list[np.ndarray], into: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> None:
    """Adds the documents' expected counts and log-likelihood to (start, move, emit, likelihood)."""
    start, move, emit, likelihood = into
    for _, lengths, seen in batches_of(docs):
        log, states, scale, active = forward(model, lengths, seen, keep=True)
        likelihood += log.sum()
        steps, n = seen.shape
        ahead = np.ones((n, len(model.start)))
        back = model.move.T.copy()
        for t in range(steps - 1, 0, -1):
            m = active[t]
            right = model.emit[seen[t, :m]] * ahead[:m] / scale[t, :m, None]
            before = states[t - 1, :m]
            states[t, :m] *= ahead[:m]
            move += model.move * (before.T @ right)
            ahead[:m] = right @ back
        states[0] *= ahead
        start += states[0].sum(0)
        inside = np.arange(steps)[:, None] < lengths
        own, part = seen[inside], states[inside]
        for k in range(part.shape[1]):
            emit[:, k] += np.bincount(own, part[:, k], CLASSES)


def zeros() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((CLASSES, STATES)), np.zeros(1)


def sums_of(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    s, m = STATES, STATES + STATES * STATES
    return flat[:s], flat[s:m].reshape(STATES, STATES), flat[m:-1].reshape(CLASSES, STATES), flat[-1:]


def rounds(model: Model, prior: float, count) -> Model:
    """Baum-Welch: `count` gives a model's sums over the documents set aside and over the rest.

    What is set aside has no part in any model but the last one, so that it tells
    which prior serves unseen text, and when to stop.
    """
    before = -math.inf
    for k in range(ROUNDS):
        aside, rest = count(model)
        if not rest[2].sum():
            return Model.of_counts(*(a + r for a, r in zip(aside[:3], rest[:3], strict=True)), prior)
        if aside[2].sum():
            prior = deleted(rest[2], aside[2])
        done = k == ROUNDS - 1 or float(aside[3][0]) - before < GAIN * abs(before)
        before = float(aside[3][0])
        used = [a + r for a, r in zip(aside[:3], rest[:3], strict=True)] if done else rest[:3]
        model = Model.of_counts(*used, prior)
        if done:
            break
    return model


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits on every row of `docs`: a pass that turns them to classes and groups them, then up to ROUNDS rounds.

    The classes are written to the shared folder for the rounds, and deleted behind
    them. Each task groups its documents slice by slice, and groups are united in
    turn until there are as many as states: the starting point, over all rows.
    Null and empty texts are an end alone; null ids and repeated rows count as
    other rows. Sums are taken in the order of the partitions. What is gathered from
    a partition is of fixed size, and is added up in slices on the executors.
    """
    spark = docs.sparkSession
    aside = F.coalesce(F.pmod(F.xxhash64(F.col(quoted(id_col))), F.lit(ASIDE)) == 0, F.lit(False))
    texts = bounded_batches(docs).select(F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias(TEXT), aside.alias("aside"))

    def classes(batches):
        hasher, own, k = Hasher(), TaskContext.get().partitionId(), 0
        for b in gathered(batches, SLICE):
            made = [class_of(hasher(x)) for x in b.column(0).to_pylist()]
            groups = groups_of([d for d, a in zip(made, b.column(1).to_pylist(), strict=True) if not a])
            row = [own, k, np.concatenate(made).astype("<u2").tobytes(), np.array(list(map(len, made)), "<i8").tobytes(), b.column(1).to_numpy(zero_copy_only=False).tobytes(), groups.astype("<f4").tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names)
            k += 1

    names = ["part", "k", "classes", "lengths", "aside", "groups"]
    folder = work_dir(spark, "hmm")
    texts.mapInArrow(classes, "part long, k long, classes binary, lengths binary, aside binary, groups binary").write.parquet(folder)
    held = spark.read.parquet(folder)

    def unite(table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("k", "ascending")])
        rows = np.concatenate([np.frombuffer(x, "<f4").reshape(STATES, CLASSES) for x in table.column("groups").to_pylist()])
        made = united(rows[rows.sum(1) > 0]).astype("<f4").tobytes()
        return pa.table({"part": table.column("part")[:1], "k": table.column("k")[:1], "groups": pa.array([made], pa.binary())})

    groups = held.select("part", "k", "groups")
    left = groups.count()
    while left > 1:
        left = math.ceil(left / UNITED)
        groups = checkpointed(groups.groupBy(F.pmod(F.xxhash64("part", "k"), F.lit(left)).alias("to")).applyInArrow(unite, "part long, k long, groups binary"))
        left = min(left, groups.count())
    first = groups.first()
    seeds = np.frombuffer(first["groups"], "<f4").reshape(STATES, CLASSES).astype(float) if first else np.zeros((STATES, CLASSES))
    width = 2 * (STATES + STATES * STATES + CLASSES * STATES + 1)
    cut = 4096

    def count(model: Model):
        sent = spark.sparkContext.broadcast(model)

        def work(batches):
            own, sums = sent.value, (zeros(), zeros())
            for b in batches:
                for flat, lengths, aside in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                    docs = np.split(np.frombuffer(flat, "<u2").astype(np.int32), np.cumsum(np.frombuffer(lengths, "<i8"))[:-1])
                    for mark, into in zip((True, False), sums, strict=True):
                        expected(own, [d for d, a in zip(docs, np.frombuffer(aside, bool).tolist(), strict=True) if a == mark], into)
            flat = np.concatenate([s.ravel() for part in sums for s in part])
            parts = [flat[k : k + cut].tobytes() for k in range(0, width, cut)]
            here = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([here] * len(parts), pa.int32()), pa.array(parts, pa.binary())], ["slice", "part", "sums"])

        def add(table: pa.Table) -> pa.Table:
            rows = sorted(zip(table.column("part").to_pylist(), table.column("sums").to_pylist(), strict=True), key=lambda r: r[0])
            total = np.zeros(len(rows[0][1]) // 8)
            for _, x in rows:
                total += np.frombuffer(x)
            return pa.table({"slice": table.column("slice")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

        rows = held.select("classes", "lengths", "aside").mapInArrow(work, "slice int, part int, sums binary").groupBy("slice").applyInArrow(add, "slice int, sums binary").collect()
        sent.destroy()
        if not rows:
            return zeros(), zeros()
        flat = np.frombuffer(b"".join(bytes(r["sums"]) for r in sorted(rows, key=lambda r: r["slice"])))
        return sums_of(flat[: width // 2]), sums_of(flat[width // 2 :])

    model = rounds(Model.seeded(seeds, 100.0), PRIORS[-1], count)
    drop_path(spark, folder)
    return model


def score(docs: DataFrame, model: Model, training, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id`, `n_tokens`, `n_known`, `train_tokens`, `base_score` and `score` for each row.

    `training` is a boolean column that marks the rows whose tokens are counted; a
    null there counts as false. With c a token's count, N all and V the distinct
    counted tokens, base_score adds log10((c + 0.5) / (N + 0.5 (V + 1))) over a text's
    tokens. Score is the log10 of the probability under `model`, where a class with T
    tokens of D kinds gives a token (c + 0.5) / (T + 0.5 (D + 1)). Null and empty
    texts are an end alone. All rows stay. Tokens are told apart by 64-bit hashes.
    """
    size = plan_bytes(docs, text_col)
    blocks, wanted = max(1, math.ceil(size / BLOCK_BYTES)), max(1, math.ceil(size / BUCKET_BYTES))
    # a bucket has whole classes, or, where there are more buckets than classes, parts of one
    spread = min(WHOLE, wanted)
    buckets = spread * math.ceil(wanted / spread)
    spark = docs.sparkSession
    number = F.col(quoted(id_col))
    base = docs.select(
        number.alias("doc_id"),
        F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias("text"),
        F.coalesce(training, F.lit(False)).alias("train"),
        F.pmod(F.xxhash64(number), F.lit(blocks)).alias("block"),
    )

    def tokens(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """The documents' hashes, all distinct ones in the order of buckets, and their buckets."""
        hasher = Hasher()
        docs = [hasher(x) for x in table.column("text").to_pylist()]
        own = np.unique(np.concatenate([np.zeros(0, np.uint64), *docs]))
        bucket = class_of(own).astype(np.int64) % spread + spread * (own % np.uint64(buckets // spread)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        return docs, own[order], bucket[order]

    def ask(table: pa.Table) -> pa.Table:
        docs, own, bucket = tokens(table)
        counted = np.concatenate([np.zeros(0, np.uint64), *(d for d, t in zip(docs, table.column("train").to_pylist(), strict=True) if t)])
        name, count = np.unique(counted, return_counts=True)
        n = np.zeros(len(own), np.int64)
        if len(name):
            at = np.minimum(np.searchsorted(name, own), len(name) - 1)
            n = np.where(name[at] == own, count[at], 0)
        here = table.column("block")[0].as_py()
        # a row for each bucket that it has tokens of: never more rows than tokens
        asked = [(k, own[a:b].tobytes(), n[a:b].astype("<i4").tobytes()) for k, a, b in runs_of_equal(bucket)]
        return pa.table({"bucket": pa.array([x[0] for x in asked], pa.int64()), "block": pa.array([here] * len(asked), pa.int64()), "names": pa.array([x[1] for x in asked], pa.binary()), "counts": pa.array([x[2] for x in asked], pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        """The counts that each block asks for, and for block -1 the bucket's tokens and kinds by class."""
        names = [np.frombuffer(x, np.uint64) for x in table.column("names").to_pylist()]
        counts = np.concatenate([np.frombuffer(x, "<i4") for x in table.column("counts").to_pylist()]).astype(np.int64)
        own, place = np.unique(np.concatenate(names), return_inverse=True)
        total = np.zeros(len(own), np.int64)
        np.add.at(total, place, counts)
        classes, bucket = class_of(own), table.column("bucket")[0].as_py()
        sums = np.stack([np.bincount(classes, total, CLASSES), np.bincount(classes[total > 0], minlength=CLASSES)])[:, bucket % spread :: spread]
        cut, out = np.cumsum([0, *map(len, names)]), total[place]
        found = [out[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return pa.table({"block": pa.array([*table.column("block").to_pylist(), -1], pa.int64()), "bucket": pa.array([bucket] * (len(found) + 1), pa.int64()), "counts": pa.array([*found, sums.astype(np.int64).tobytes()], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist()], axis=0)
        return pa.table({"part": pa.array([table.column("bucket")[0].as_py() % spread], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary())})

    by_block = base.groupBy("block")
    asked = by_block.applyInArrow(ask, "bucket long, block long, names binary, counts binary")
    answers = checkpointed(asked.groupBy("bucket").applyInArrow(answer, "block long, bucket long, counts binary"))
    # of a fixed size: two numbers a class
    totals = np.zeros((2, CLASSES), np.int64)
    for r in answers.where("block < 0").groupBy(F.col("bucket") % spread).applyInArrow(add, "part long, sums binary").collect():
        totals[:, r["part"] :: spread] = np.frombuffer(r["sums"], np.int64).reshape(2, -1)
    all_tokens, kinds = totals.sum(1).tolist()

    sent = spark.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *T.StructType.fromDDL("n_tokens long, n_known long, train_tokens long, base_score double, score double").fields])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        docs, own, _ = tokens(left)
        model = sent.value
        rows = sorted(zip(right.column("bucket").to_pylist(), right.column("counts").to_pylist(), strict=True))
        count = np.frombuffer(b"".join(c for _, c in rows), np.int64)
        order = np.argsort(own)
        name, count = own[order], count[order]
        weight = np.log10(count + 0.5) - np.log10(all_tokens + 0.5 * (kinds + 1))
        within = np.log10(count + 0.5) - np.log10(totals[0] + 0.5 * (totals[1] + 1))[class_of(name)]
        at = [np.searchsorted(name, d) for d in docs]
        score = np.array([within[a].sum() for a in at])
        for part, lengths, seen in batches_of([class_of(d) for d in docs]):
            score[part] += forward(model, lengths, seen)
        columns = [left.column("doc_id"), pa.array([len(d) for d in docs], pa.int64()), pa.array([int((count[a] > 0).sum()) for a in at], pa.int64()), pa.array([all_tokens] * len(docs), pa.int64()), pa.array([float(weight[a].sum()) for a in at], pa.float64()), pa.array(score, pa.float64())]
        return pa.table(columns, names=schema.names)

    return by_block.cogroup(answers.where("block >= 0").groupBy("block")).applyInArrow(finish, schema)
