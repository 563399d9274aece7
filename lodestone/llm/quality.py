"""Quality by histogram gradient-boosted trees over document statistics.

Statistics are binned by quantiles of a bounded sample of labelled documents; each
tree grows level by level on histograms of gradients. All trees are flattened into
arrays, which numpy walks for a batch of documents at once.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod5, map_texts, quoted

#: Labelled documents that a model is fitted on, at most.
EXAMPLES = 20_000
TREES, DEPTH, BINS, RATE, LEAST_ROWS, L2 = 80, 4, 64, 0.15, 20, 1.0

FEATURES = (
    "bytes words lines letters upper digits spaces signs marks stops commas exclaims questions pipes brackets markup "
    "other_ascii non_ascii control word_length distinct_words top_word upper_words sign_words long_words "
    "line_length distinct_lines short_lines longest_line stop_rate"
).split()


def statistics(text: str) -> list[float]:
    """The FEATURES of a text; those of an empty one are all 0."""
    raw = text.encode("utf-8", "replace")
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters, upper, digits = int(h[97:123].sum() + h[65:91].sum()), int(h[65:91].sum()), int(h[48:58].sum())
    share = lambda s: int(h[list(s)].sum()) / n
    ascii_signs = int(h[33:127].sum()) - letters - digits
    words = raw.split()
    w = max(1, len(words))
    seen = Counter(words)
    lines = raw.split(b"\n")
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    return [
        np.log1p(n),
        np.log1p(len(words)),
        np.log1p(len(lines)),
        letters / n,
        upper / max(1, letters),
        digits / n,
        share(b" \t\n\r"),
        ascii_signs / n,
        share(b"#$%&*@^~"),
        share(b".;:"),
        share(b","),
        share(b"!"),
        share(b"?"),
        share(b"|"),
        share(b"()[]{}"),
        share(b"<>/=\\"),
        share(b"\"'`_+-"),
        int(h[128:].sum()) / n,
        (int(h[:32].sum()) - int(h[9:14].sum()) + int(h[127])) / n,
        (n - int(h[32]) - int(h[9:14].sum())) / w,
        len(seen) / w,
        max(seen.values(), default=0) / w,
        sum(c for x, c in seen.items() if x.isupper() and len(x) > 1) / w,
        sum(c for x, c in seen.items() if not x[-1:].isalnum() and x[-1] < 128 and x[-1:] not in b".,;:!?\"')") / w,
        sum(c for x, c in seen.items() if len(x) > 20) / w,
        np.log1p(sizes.mean()),
        len(set(lines)) / len(lines),
        float((sizes < 30).mean()),
        np.log1p(sizes.max()),
        (int(h[46]) + int(h[33]) + int(h[63])) / w,
    ]


class Trees:
    """Node k of the flattened arrays: left[k] if x[feature[k]] <= cut[k], else right[k]; a leaf points to itself."""

    def __init__(self):
        self.feature, self.cut, self.left, self.right, self.value, self.roots, self.base = [], [], [], [], [], [], 0.0

    def _leaf(self) -> int:
        k = len(self.feature)
        self.feature.append(0)
        self.cut.append(np.inf)
        self.left.append(k)
        self.right.append(k)
        self.value.append(0.0)
        return k

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, width = x.shape
        share = (y.sum() + 1) / (n + 2)
        self.base = float(np.log(share / (1 - share)))
        if n:
            cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
            bins = np.stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(width)], 1)
            margin = np.full(n, self.base)
            for _ in range(TREES):
                p = 1 / (1 + np.exp(-margin))
                margin += self._grow(bins, cuts, p - y, p * (1 - p))
        for name in ("feature", "left", "right", "roots"):
            setattr(self, name, np.array(getattr(self, name), np.int64))
        self.cut, self.value = np.array(self.cut), np.array(self.value)
        return self

    def _grow(self, bins: np.ndarray, cuts: list, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        n, width = bins.shape
        root = self._leaf()
        self.roots.append(root)
        at, level = np.full(n, root), [root]
        offsets = np.arange(width) * BINS
        for _ in range(DEPTH):
            grown = []
            for node in level:
                rows = np.flatnonzero(at == node)
                if len(rows) < 2 * LEAST_ROWS:
                    continue
                flat = (bins[rows] + offsets).ravel()
                hist = [np.bincount(flat, np.repeat(v, width) if v is not None else None, width * BINS).reshape(width, BINS).cumsum(1) for v in (g[rows], h[rows], None)]
                gl, hl, cl = hist
                gt, ht, ct = gl[:, -1:], hl[:, -1:], cl[:, -1:]
                gain = gl**2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt**2 / (ht + L2)
                gain[(cl < LEAST_ROWS) | (ct - cl < LEAST_ROWS)] = -1
                f, b = divmod(int(gain.argmax()), BINS)
                if gain[f, b] <= 1e-9 or b >= len(cuts[f]):
                    continue
                self.feature[node], self.cut[node] = f, float(cuts[f][b])
                self.left[node], self.right[node] = self._leaf(), self._leaf()
                at[rows] = np.where(bins[rows, f] <= b, self.left[node], self.right[node])
                grown += [self.left[node], self.right[node]]
            level = grown
        nodes, own = np.unique(at, return_inverse=True)
        values = -RATE * np.bincount(own, g) / (np.bincount(own, h) + L2)
        for node, v in zip(nodes, values, strict=True):
            self.value[node] = float(v)
        return values[own]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        rows = np.arange(len(x))[:, None]
        at = np.tile(self.roots, (len(x), 1))
        for _ in range(DEPTH):
            at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(1))))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", examples: int = EXAMPLES) -> Trees:
    """Fits on at most `examples` labelled documents that are not held out, those of the least hash of their id.

    Rows of a null id or label, and documents without a label, teach nothing. An id
    with several labels counts by its largest, one with several rows by the least
    statistics among them; equal rows are one example. Without examples every score is 0.5.
    """
    chosen = (
        labels.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(label)).cast("int").alias("label"))
        .where((crc_mod5("doc_id") != 0) & F.col("label").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(examples)
    )
    held = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("text")).join(F.broadcast(chosen), "doc_id")

    def make():
        return lambda texts: [list(map(statistics, texts))]

    # of a bounded size: `examples` rows of numbers, sorted so that sums do not depend on tasks
    rows = map_texts(held, make, "x array<double>", "text", ["doc_id", "label"]).groupBy("doc_id", "label").agg(F.min("x").alias("x")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return Trees().fit(np.array([r["x"] for r in rows], float).reshape(-1, len(FEATURES)), np.array([r["label"] for r in rows], float))


def score(docs: DataFrame, model: Trees, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Adds `score`, the probability of label 1.

    Null and empty texts are scored by statistics that are all 0. All rows stay. No
    shuffle; the model is bounded by its numbers of trees and levels, and broadcast.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        return lambda texts: [sent.value.predict(np.array(list(map(statistics, texts)), float))]

    return map_texts(docs, make, "score double", text_col, carry)
