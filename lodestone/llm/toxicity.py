"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are all words and word beginnings; a log-likelihood ratio that ties a term to the
label in a bounded sample of labelled documents raises its weight, and no term of a text
or an example is left out of its vector. Examples are ordered so that alike ones share a
block. Postings are read for the terms of few examples; what the others can add is bounded
by the sum of their largest weights in a block, and only blocks whose bound reaches the
k-th best score so far are read, for a batch of texts together. The best examples are
then scored in double precision by all terms.
"""

from __future__ import annotations

from itertools import chain, islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, crc_mod5, map_texts, quoted, release
from .decontam import NORMAL

#: Labelled documents that a model is fitted on, at most.
EXAMPLES = 6000
#: The log-likelihood ratio at which a term has about half of its weight.
HALF_RATIO = 25.0
#: Lengths of word beginnings.
BEGINNINGS = (4, 5, 6)
NEIGHBOURS, BLOCK = 15, 64
#: Terms of more than this part of the examples have no postings; blocks that are read at first; room for single precision.
WIDE, FIRST_BLOCKS, SLACK = 16, 2, 1e-5
#: Texts that are scored together; terms of examples that are inverted at a time.
TOGETHER, PART = 128, 1 << 18
#: Words, and terms of no example, that a worker remembers.
REMEMBERED = 1 << 16
#: Weight of the whole sample's share in each vote, in neighbours of cosine 1.
PRIOR = 0.5


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(NORMAL).split()


def beginnings_of(word: bytes) -> list[bytes]:
    """A word's beginnings, in whole characters."""
    if word.isascii():
        return [word[:n] for n in BEGINNINGS if len(word) > n]
    w = word.decode("utf-8", "ignore")
    return [w[:n].encode() for n in BEGINNINGS if len(w) > n]


def terms_of(word: bytes) -> list[bytes]:
    """A word and, marked, its beginnings."""
    return [word, *(b"^" + b for b in beginnings_of(word))]


class Numbers(dict):
    """Numbers what is asked for in turn."""

    def __missing__(self, key: bytes) -> int:
        self[key] = number = len(self)
        return number


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers from each start on, `length` of them, one range behind the other."""
    out = np.repeat(start - np.cumsum(length) + length, length)
    out += np.arange(len(out))
    return out


class BlockMaxIndex:
    """Exact top-k by inner product over examples of sparse unit vectors: dicts, or pairs of arrays of terms and weights.

    Terms of few examples have postings. Those of more than a WIDE-th have a column in
    each block of examples, under the block's maxima.
    """

    def __init__(self, rows: list, n_terms: int):
        rows = [(np.array(list(r), np.int32), np.array(list(r.values()))) if isinstance(r, dict) else r for r in rows]
        self.order = np.array(sorted(range(len(rows)), key=lambda k: (rows[k][0][np.lexsort((rows[k][0], -rows[k][1]))[:3]].tolist(), k)), np.int64)
        self.n, self.n_terms, self.blocks = len(rows), n_terms, -(-len(rows) // BLOCK)
        self.size = np.array([len(rows[k][0]) for k in self.order], np.int64)
        self.own_terms = np.concatenate([np.zeros(0, np.int32), *(rows[k][0] for k in self.order)])
        self.own_weights = np.concatenate([np.zeros(0), *(rows[k][1] for k in self.order)])
        self.query = None

    def _invert(self) -> None:
        """What is made where the index is asked, and not sent."""
        of = np.repeat(np.arange(self.n, dtype=np.uint16 if self.n <= 1 << 16 else np.int32), self.size)
        self.own_start = np.cumsum(self.size) - self.size
        number = np.bincount(self.own_terms, minlength=self.n_terms)
        self.wide = number > max(BLOCK, self.n // WIDE)
        self.column = np.cumsum(self.wide, dtype=np.int32) - 1
        # by parts, and postings before the table: what is made in between is never as large as they are
        wide = self.wide[self.own_terms]
        narrow = np.flatnonzero(~wide).astype(np.int32)
        narrow = narrow[np.argsort(self.own_terms[narrow], kind="stable")]
        self.example, self.weight = of[narrow], np.empty(len(narrow), np.float32)
        for k in range(0, len(narrow), PART):
            self.weight[k : k + PART] = self.own_weights[narrow[k : k + PART]]
        del narrow
        self.table = np.zeros((self.blocks, int(self.wide.sum()), BLOCK), np.float32)
        for k in range(0, len(wide), PART):
            at = np.flatnonzero(wide[k : k + PART]) + k
            block, slot = np.divmod(of[at], BLOCK)
            self.table[block, self.column[self.own_terms[at]], slot] = self.own_weights[at]
        self.most = np.ascontiguousarray(self.table.max(2).T)
        self.start = np.append(0, np.cumsum(np.where(self.wide, 0, number)))
        del of, wide, number
        release()
        self.query = np.zeros(self.n_terms)

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("order", "n", "n_terms", "blocks", "size", "own_terms", "own_weights")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.query = None

    def _scores(self, examples: np.ndarray) -> np.ndarray:
        """Scores of examples by all their terms, in double precision."""
        length = self.size[examples]
        at = ranges(self.own_start[examples], length)
        return np.add.reduceat(self.own_weights[at] * self.query[self.own_terms[at]], np.cumsum(length) - length)

    def tops(self, of: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each of n queries the k best examples and their scores, best first, ties by example; `of`, ascending: whose term it is."""
        nothing = np.zeros(0, np.int64), np.zeros(0)
        if not self.n:
            return [nothing] * n
        if self.query is None:
            self._invert()
        k = min(k, self.n)
        cut = np.searchsorted(of, np.arange(n + 1))
        wide = self.wide[terms]
        asked = np.zeros((n, self.table.shape[1]), np.float32)
        asked[of[wide], self.column[terms[wide]]] = weights[wide]
        score = np.empty((n, self.blocks * BLOCK), np.float32)
        for q, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
            own = terms[a:b]
            length = self.start[own + 1] - self.start[own]
            at = ranges(self.start[own], length)
            score[q] = np.bincount(self.example[at], np.repeat(weights[a:b], length) * self.weight[at], self.blocks * BLOCK)
        by_block = score.reshape(n, self.blocks, BLOCK)
        bound = by_block.max(2) + asked @ self.most + SLACK

        def read(due: np.ndarray) -> None:
            for block in np.flatnonzero(due.any(0)).tolist():
                rows = np.flatnonzero(due[:, block])
                by_block[rows, block] += asked[rows] @ self.table[block]

        def least(read: np.ndarray) -> np.ndarray:
            known = np.where(read[:, :, None], by_block, -1.0).reshape(n, -1)[:, : self.n]
            return np.partition(known, self.n - k, axis=1)[:, self.n - k]

        # the blocks of the largest bounds give a score to beat; then only those that may beat it are read
        done = np.zeros((n, self.blocks), bool)
        first = min(self.blocks, FIRST_BLOCKS)
        np.put_along_axis(done, np.argpartition(-bound, first - 1, axis=1)[:, :first], True, 1)
        read(done)
        more = ~done & (bound >= least(done)[:, None] - SLACK)
        read(more)
        done |= more
        floor = least(done) - SLACK
        out = []
        for q, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
            chosen = np.flatnonzero((score[q, : self.n] >= floor[q]) & np.repeat(done[q], BLOCK)[: self.n]) if b > a else nothing[0]
            if not len(chosen):
                out.append(nothing)
                continue
            self.query[terms[a:b]] = weights[a:b]
            found = self._scores(chosen)
            self.query[terms[a:b]] = 0
            top = np.lexsort((self.order[chosen], -found))[:k]
            top = top[found[top] > 0]
            out.append((self.order[chosen[top]], found[top]))
        return out

    def top(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for one query."""
        return self.tops(np.zeros(len(terms), np.int64), np.asarray(terms), np.asarray(weights), 1, k)[0]


class Model:
    """`terms`: those of the examples, joined by spaces, with the weights of one occurrence; `rows`: an example's terms and their weights in its unit vector; `other`: weight of a term of no example."""

    def __init__(self, terms: bytes, weights: np.ndarray, other: float, rows: list | None = None, labels: list[int] | None = None, ids: list | None = None):
        self.joined, self.weights, self.other = terms, weights, other
        rows, labels, ids = rows or [], labels or [], ids or []
        kept = [k for k, (own, _) in enumerate(rows) if len(own)]
        self.index = BlockMaxIndex([rows[k] for k in kept], len(weights))
        self.labels = np.array([labels[k] for k in kept], float)
        self.ids = [ids[k] for k in kept]
        blank = [labels[k] for k, (own, _) in enumerate(rows) if not len(own)]
        share = sum(labels) / len(labels) if labels else 0.5
        #: share of label 1 among the examples without any word, smoothed by one example of the whole sample's share
        self.blank = (sum(blank) + share) / (len(blank) + 1)
        self.share = share
        self.terms = self.words = self.starts = self.others = self.of_word = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "terms": None, "words": None, "starts": None, "others": None, "of_word": None, "expand": None}

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of texts, ascending, their terms, ascending, and how often each occurs; terms of no example have numbers behind the others."""
        if self.terms is None:
            self.terms = self.joined.split()
            self.words = {t: k for k, t in enumerate(self.terms) if t[:1] != b"^"}
            self.starts = {t[1:]: k for k, t in enumerate(self.terms) if t[:1] == b"^"}
        if self.of_word is None or len(self.others) > REMEMBERED or len(self.of_word) > REMEMBERED:
            self.others, self.of_word, self.expand = Numbers(), Numbers(), np.full((1 << 12, 1 + len(BEGINNINGS)), -1, np.int32)
        of_word, before = self.of_word, len(self.of_word)
        split = [words_of(x) for x in texts]
        lengths = np.array(list(map(len, split)))
        word = np.fromiter(map(of_word.__getitem__, chain.from_iterable(split)), np.int64, int(lengths.sum()))
        new = list(islice(of_word, before, None))
        if len(of_word) > len(self.expand):
            self.expand = np.pad(self.expand, ((0, len(of_word)), (0, 0)), constant_values=-1)
        self.expand[before : len(of_word)] = self._terms_of_words(new, before)
        key, times = np.unique(np.repeat(np.arange(len(texts)), lengths) << 32 | word, return_counts=True)
        found = self.expand[key & 0xFFFFFFFF].astype(np.int64)
        real = found >= 0
        key, at = np.unique((np.broadcast_to((key >> 32 << 32)[:, None], found.shape) | found)[real], return_inverse=True)
        number = np.bincount(at, np.broadcast_to(times[:, None], found.shape)[real], len(key))
        return key >> 32, key & 0xFFFFFFFF, number.astype(np.int64)

    def _terms_of_words(self, new: list[bytes], before: int) -> np.ndarray:
        """Numbers of the terms of new words, -1 where there are fewer. Of terms of no example words have even numbers, beginnings odd ones."""
        words, starts, others, unknown = self.words, self.starts, self.others, len(self.terms)
        out = np.full((len(new), 1 + len(BEGINNINGS)), -1, np.int32)
        out[:, 0] = [words.get(w, -1) for w in new]
        out[:, 0] = np.where(out[:, 0] < 0, unknown + 2 * np.arange(before, before + len(new)), out[:, 0])
        parts = list(map(beginnings_of, new))
        number = np.fromiter(map(len, parts), np.int64, len(parts))
        every = list(chain.from_iterable(parts))
        found = np.fromiter((starts.get(b, -1) for b in every), np.int64, len(every))
        lost = np.flatnonzero(found < 0).tolist()
        found[lost] = [unknown + 1 + 2 * others[every[k]] for k in lost]
        out[np.repeat(np.arange(len(new)), number), 1 + ranges(np.zeros(len(new), np.int64), number)] = found
        return out

    def vectors(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The texts' unit vectors: places of texts, terms and weights."""
        of, own, counts = self.counts(texts)
        raw = (1 + np.log(counts)) * self.other
        known = own < len(self.terms)
        raw[known] = (1 + np.log(counts[known])) * self.weights[own[known]]
        return of, own, raw / np.sqrt(np.bincount(of, raw * raw, len(texts)))[of]

    def score(self, texts: list[str]) -> list[tuple[float, list, list[str]]]:
        """Score, ids of the nearest examples of label 1, the text's terms by weight, for each text."""
        of, own, raw = self.vectors(texts)
        n = len(texts)
        some, known = np.bincount(of, minlength=n), own < len(self.terms)
        of, own, weights = of[known], own[known], raw[known]
        cut = np.searchsorted(of, np.arange(n + 1)).tolist()
        out = []
        for k, (near, cosine) in enumerate(self.index.tops(of, own, weights, n, NEIGHBOURS)):
            a, b = cut[k], cut[k + 1]
            if a == b:
                out.append(((self.share if some[k] else self.blank), [], []))
                continue
            votes = cosine**2
            score = float((votes @ self.labels[near] + PRIOR * self.share) / (votes.sum() + PRIOR))
            evidence = [self.ids[e] for e in near if self.labels[e]][:5]
            best = np.lexsort((own[a:b], -weights[a:b]))[:5]
            out.append((score, evidence, [self.terms[t].decode("utf-8", "replace") for t in own[a:b][best]]))
        return out


def weights_of(n: np.ndarray, p: np.ndarray, size: int, positive: int) -> np.ndarray:
    """Weight of one occurrence of a term of `n` of `size` examples, `p` of the `positive` ones: its inverse document frequency, raised by its log-likelihood ratio."""
    clean = size - positive

    def part(seen, rows, share):
        # 0 where nothing is seen
        return np.where(seen > 0, seen * np.log(np.where(seen > 0, seen * float(size), 1.0) / np.where(seen > 0, rows * float(share), 1.0)), 0.0)

    ratio = 2 * (part(p, n, positive) + part(n - p, n, clean) + part(positive - p, size - n, positive) + part(clean - n + p, size - n, clean))
    ratio = np.maximum(ratio, 0.0)
    return (np.log((size + 1) / (n + 1)) + 1) * (1 + ratio) / (1 + ratio + HALF_RATIO)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", examples: int = EXAMPLES) -> Model:
    """Fits on at most `examples` labelled documents that are not held out, those of the least hash of their id.

    Rows of a null id or label, and documents without a label, teach nothing. An id
    with several labels counts by its largest, one with several rows by the least text.
    """
    chosen = (
        labels.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(label)).cast("int").alias("label"))
        .where((crc_mod5("doc_id") != 0) & F.col("label").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(examples)
    )
    # of a proven size: `examples` rows
    held = checkpointed(
        docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text"))
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "label")
        .agg(F.min("text").alias("text"))
    )
    size, positive = held.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()

    def make_terms():
        def work(texts):
            return [[sorted({t for w in set(words_of(x)) for t in terms_of(w)}) for x in texts]]

        return work

    per_term = (
        map_texts(held, make_terms, "terms array<binary>", "text", ["label"])
        .select("label", F.explode("terms").alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("n"), F.sum("label").alias("p"))
    )
    # the sample bounds its terms
    table = per_term.toArrow().sort_by("term")
    names = b" ".join(table.column("term").to_pylist())
    weights = weights_of(table.column("n").to_numpy(), table.column("p").to_numpy(), size, positive)
    other = float(weights_of(np.zeros(1, np.int64), np.zeros(1, np.int64), size, positive)[0])
    sent = docs.sparkSession.sparkContext.broadcast(Model(names, weights, other))

    def make_vectors():
        bare = sent.value

        def work(texts):
            of, own, weight = bare.vectors(texts)
            cut = np.searchsorted(of, np.arange(1, len(texts)))
            return [np.split(own, cut), np.split(weight, cut)]

        return work

    rows = map_texts(held, make_vectors, "terms array<int>, weights array<double>", "text", ["doc_id", "label"]).toArrow().sort_by("doc_id")
    sent.destroy()
    pairs = [(t.values.to_numpy(), w.values.to_numpy()) for t, w in zip(rows.column("terms"), rows.column("weights"), strict=True)]
    model = Model(names, weights, other, pairs, rows.column("label").to_pylist(), rows.column("doc_id").to_pylist())
    # the driver lives on: what it has made the model of goes back to the system
    del pairs, rows, table
    release()
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Adds `score` (0 to 1), `evidence` (ids of up to five nearest toxic examples) and `terms` (up to five of the text's).

    Null and empty texts have the share of label 1 among examples without any word, and
    texts that have no term in common with the examples the share among all. Among
    examples of equal cosine those of the least id come first. All rows stay. No shuffle; the model is bounded by its examples, and broadcast.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = sent.value

        def work(texts):
            scored = chain.from_iterable(model.score(texts[k : k + TOGETHER]) for k in range(0, len(texts), TOGETHER))
            scores, evidence, terms = zip(*scored, strict=True)
            return [list(scores), [list(map(str, e)) for e in evidence], list(terms)]

        return work

    return map_texts(docs, make, "score double, evidence array<string>, terms array<string>", text_col, carry)
