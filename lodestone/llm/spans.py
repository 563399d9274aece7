"""Substring deduplication by sliding spans of sentences.

A sentence ends behind . ! or ? before white space, behind their ideographic forms,
and at a line's end. It is cut into pieces behind each word whose hash, with the word
before it, is least in some window of REACH such places inside the sentence: whether a
place is a cut depends on the words within REACH of it alone, so that the pieces of a
passage realign wherever it starts. Hashed are every run of RUN sentences, and the
shortest run of pieces of at least LEAST_WORDS words that starts, or that ends, at each
piece; any common passage of 50 words has such a run. Spans are joined over all
documents; of equal spans the first (by document id, then place) stays, and the pieces
of the others go.

A block of documents sends each of its hashes once, with the document that has it
first, and is answered which of them another block has earlier: a passage that is in
a third of all documents costs a row entry a block.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import plan_bytes, quoted, runs_of_equal
from .minhash import mix

#: Sentences and words of a span; words of a piece, at most.
RUN, LEAST_WORDS, PIECE = 3, 25, 20
#: Places of a window; a power of two. No piece has more than REACH + 1 words.
REACH = 8
#: Input file bytes of a block of documents, and of a bucket of hashes.
BLOCK_BYTES, BUCKET_BYTES = 2 << 20, 8 << 20
SPACE, ALONE, ENDING = 1, 2, 3
#: Scripts written without spaces, each character of which is a word: South-East Asian, Japanese and Chinese.
_UNSPACED = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x3029), (0x3031, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1AFF0, 0x1B16F), (0x20000, 0x3FFFF)]
_BASE = 0x9E3779B97F4A7C15


def _kinds() -> np.ndarray:
    kinds = np.zeros(sys.maxunicode + 1, np.uint8)
    for a, b in _UNSPACED:
        kinds[a : b + 1] = ALONE
    kinds[[c for c in range(0x3001) if chr(c).isspace()]] = SPACE
    kinds[[ord(c) for c in "\u3002\uff01\uff1f\uff61"]] = ENDING
    return kinds


_KINDS = _kinds()


class _Hashes(dict):
    """Hashes of words, as met."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        made = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))
        return made


_HASHES = _Hashes()
_POWERS = np.ones((2, 1), np.uint64)


def _powers(n: int) -> np.ndarray:
    """Powers of _BASE, and of its inverse, modulo 2**64."""
    global _POWERS
    if _POWERS.shape[1] < n:
        size = 1 << n.bit_length()
        steps = np.array([[_BASE], [pow(_BASE, -1, 1 << 64)]], np.uint64).repeat(size, 1)
        steps[:, 0] = 1
        _POWERS = np.cumprod(steps, axis=1)
    return _POWERS


def _least_in_reach(own: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Which places are least in a window of REACH places; `inside`: whether the one that ends at a place counts."""
    n = len(own)
    if n < REACH:
        return np.zeros(n, bool)
    least, step = own, 1
    while step < REACH:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    # 0: less than any place
    most = np.zeros(n + REACH - 1, np.uint64)
    most[REACH - 1 : n] = np.where(inside[REACH - 1 :], least, 0)
    step = 1
    while step < REACH:
        most = np.maximum(most[:-step], most[step:])
        step *= 2
    return most == own


class Pieces:
    """A text's pieces: `offset` of each first character, `words` before each and in all, `opens`: whether a sentence starts; and its spans."""

    def __init__(self, text: str, compared: bool = True):
        none = np.zeros(0, np.int64)
        self.hash, self.first, self.last = none.view(np.uint64), none, none
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = _KINDS[code]
        space, alone = kind == SPACE, kind >= ALONE
        start = ~space
        start[1:] &= space[:-1]
        plain = not alone.any()
        if not plain:
            start |= alone
            start[1:] |= ~space[1:] & alone[:-1]
        starts = np.flatnonzero(start)
        n = len(starts)
        if not n:
            some = min(1, len(text))
            self.offset, self.words, self.opens = np.zeros(some, np.int64), np.zeros(some + 1, np.int64), np.ones(some, bool)
            return
        ends = np.flatnonzero(~space & np.append(start[1:] | space[1:], True))
        ending = code[ends]
        done = ((ending == 46) | (ending == 33) | (ending == 63)) & np.append(space, False)[ends + 1] | (kind[ends] == ENDING)
        before = np.searchsorted(starts, np.flatnonzero(code == 10))
        done[before[before > 0] - 1] = True
        done[-1] = True
        own = text.split() if plain else [text[a:b] for a, b in zip(starts.tolist(), (ends + 1).tolist(), strict=True)]
        word = np.fromiter(map(_HASHES.__getitem__, own), np.uint64, n)
        opens = np.append(True, done[:-1])
        at = np.arange(n)
        since = at - np.maximum.accumulate(np.where(opens, at, 0))
        place = mix(word + np.append(np.uint64(0), word[:-1]) * np.uint64(_BASE)) | np.uint64(1)
        cut = done | _least_in_reach(place, since >= REACH)
        first = np.flatnonzero(np.append(True, cut[:-1]))
        self.offset, self.words, self.opens = starts[first], np.append(first, n), opens[first]
        self.offset[0] = 0
        if compared:
            self._span(word)

    def _span(self, word: np.ndarray) -> None:
        total, n = self.words, len(self.offset)
        i = np.arange(n)
        last = np.searchsorted(total, total[:-1] + LEAST_WORDS) - 1
        first = np.searchsorted(total, total[1:] - LEAST_WORDS, "right") - 1
        sentence = np.append(np.flatnonzero(self.opens), n)
        key = np.unique(np.concatenate([(i * n + last)[last < n], (first * n + i)[first >= 0], sentence[: max(0, len(sentence) - RUN)] * n + sentence[RUN:] - 1]))
        self.first, self.last = np.divmod(key, n)
        power, inverse = _powers(len(word))
        sums = np.append(np.uint64(0), np.cumsum(word * power[: len(word)]))
        a = total[self.first]
        self.hash = mix((sums[total[self.last + 1]] - sums[a]) * inverse[a])

    def of(self, text: str) -> list[str]:
        at = [*self.offset.tolist(), len(text)]
        return [text[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def sentences(text: str) -> list[str]:
    """The pieces of sentences with the white space behind them; joined they are the text."""
    return Pieces(text, False).of(text)


def spans_of(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, first and last pieces of the spans of a text cut by sentences()."""
    found = Pieces("".join(parts))
    return found.hash, found.first, found.last


class Block:
    """A block's documents in ascending order of ids, then of texts, and all their spans."""

    def __init__(self, ids: list, texts: list[str]):
        self.order = sorted((k for k in range(len(ids))), key=lambda k: (ids[k] is not None, ids[k] or 0, texts[k]))
        self.ids = [ids[k] for k in self.order]
        self.texts = [texts[k] for k in self.order]
        self.pieces = [Pieces(t, d is not None) for d, t in zip(self.ids, self.texts, strict=True)]
        self.hash = np.concatenate([np.zeros(0, np.uint64), *(p.hash for p in self.pieces)])
        self.doc = np.repeat(np.arange(len(self.pieces)), [len(p.hash) for p in self.pieces])
        self.first = np.concatenate([np.zeros(0, np.int64), *(p.first for p in self.pieces)])
        self.last = np.concatenate([np.zeros(0, np.int64), *(p.last for p in self.pieces)])

    @property
    def parts(self) -> list[list[str]]:
        return [p.of(t) for p, t in zip(self.pieces, self.texts, strict=True)]

    def firsts(self) -> tuple[np.ndarray, np.ndarray]:
        """Each hash and where it is first."""
        return np.unique(self.hash, return_index=True)

    def removed(self, earlier: np.ndarray) -> list[np.ndarray]:
        """For each document, which pieces go; `earlier`: hashes that another block has first, ascending."""
        own, at = self.firsts()
        gone = np.ones(len(self.hash), bool)
        gone[at] = np.isin(own, earlier, assume_unique=True)
        cut = np.cumsum([0, *(len(p.offset) for p in self.pieces)])
        base = cut[self.doc[gone]]
        edge = np.bincount(base + self.first[gone], minlength=cut[-1] + 1) - np.bincount(base + self.last[gone] + 1, minlength=cut[-1] + 1)
        return np.split((np.cumsum(edge) > 0)[:-1], cut[1:-1])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """`doc_id`, the columns `carry`, `n_sentences`, `n_removed`, `removed_words` and `kept_text` for each row.

    `n_removed` counts the sentences of which a piece or all goes. Null and empty texts
    have no sentences and keep the empty text; texts of fewer than RUN sentences and
    fewer than LEAST_WORDS words have no spans. Words are parted by white space; a
    character of a script without spaces is a word. A row of a null id is
    neither compared nor changed. Rows of one id are ordered by their texts. An empty
    table gives an empty result. Columns of `carry` that have the name of an output
    are replaced. A worker holds a block or a bucket.
    """
    outputs = ["doc_id", "n_sentences", "n_removed", "removed_words", "kept_text"]
    carry = [c for c in (carry or []) if c not in outputs]
    size = plan_bytes(docs, text_col)
    blocks, buckets = max(1, math.ceil(size / BLOCK_BYTES)), max(1, math.ceil(size / BUCKET_BYTES))
    number = F.col(quoted(id_col)).cast("long")
    base = docs.select(
        number.alias("doc_id"),
        F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias("text"),
        F.pmod(F.xxhash64(number), F.lit(blocks)).cast("int").alias("block"),
        *(F.col(quoted(c)).alias(f"__{k}") for k, c in enumerate(carry)),
    )

    def send(table: pa.Table) -> pa.Table:
        block = Block(table.column("doc_id").to_pylist(), table.column("text").to_pylist())
        own, at = block.firsts()
        owner = np.array([d if d is not None else 0 for d in block.ids], np.int64)[block.doc[at]]
        bucket = ((own >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        own, owner = own[order], owner[order]
        # a row for each bucket that it has hashes of: never more rows than hashes
        rows = [(b, own[s:e].tobytes(), owner[s:e].tobytes()) for b, s, e in runs_of_equal(bucket[order])]
        here = table.column("block")[0].as_py()
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([here] * len(rows), pa.int32()), "hashes": pa.array([r[1] for r in rows], pa.binary()), "owners": pa.array([r[2] for r in rows], pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        owners = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("owners").to_pylist()])
        name, own = np.unique(np.concatenate(hashes), return_inverse=True)
        least = np.full(len(name), np.iinfo(np.int64).max)
        np.minimum.at(least, own, owners)
        late = owners > least[own]
        cut = np.cumsum([0, *map(len, hashes)])
        out = [h[late[s:e]].tobytes() for h, s, e in zip(hashes, cut[:-1], cut[1:], strict=True)]
        return pa.table({"block": table.column("block"), "earlier": pa.array(out, pa.binary())})

    schema = T.StructType([*T.StructType.fromDDL("doc_id long").fields, *(docs.schema[c] for c in carry), *T.StructType.fromDDL("n_sentences long, n_removed long, removed_words long, kept_text string").fields])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(left.column("doc_id").to_pylist(), left.column("text").to_pylist())
        earlier = np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in right.column("earlier").to_pylist())]))
        gone = block.removed(earlier)
        own = left.take(pa.array(block.order, pa.int64()))
        words = [int(np.diff(p.words)[bad].sum()) for p, bad in zip(block.pieces, gone, strict=True)]
        kept = ["".join(x for x, g in zip(p.of(t), bad.tolist(), strict=True) if not g) if bad.any() else t for t, p, bad in zip(block.texts, block.pieces, gone, strict=True)]
        whole = [int(p.opens.sum()) for p in block.pieces]
        cut = [len(np.unique(np.cumsum(p.opens)[bad])) if bad.any() else 0 for p, bad in zip(block.pieces, gone, strict=True)]
        columns = [own.column("doc_id"), *(own.column(f"__{k}") for k in range(len(carry))), pa.array(whole, pa.int64()), pa.array(cut, pa.int64()), pa.array(words, pa.int64()), pa.array(kept, pa.string())]
        return pa.table(columns, names=schema.names)

    by_block = base.groupBy("block")
    sent = by_block.applyInArrow(send, "bucket int, block int, hashes binary, owners binary")
    answers = sent.groupBy("bucket").applyInArrow(answer, "block int, earlier binary")
    return by_block.cogroup(answers.groupBy("block")).applyInArrow(finish, schema)
