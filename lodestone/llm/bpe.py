"""BPE encoding and decoding by a segment tree over adjacent pair ranks.

The leaves of a tree are the ranks of a word's adjacent pairs, the root is their
minimum: the leftmost pair of the lowest rank. A merge changes three leaves, so it
costs the logarithm of the word's length. Trees of many short words are kept as the
rows of one array and step together; a long word has a tree of its own.

The vocabulary is a file of the tokenizers library: normaliser NFC, white space,
lower case; pre-tokeniser words, digits and signs, then bytes; BPE with word ends;
special tokens found in the raw text; no decoder (tokens joined by spaces).
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import map_texts, release


#: Words that a worker keeps, in each of two generations.
CACHE_ENTRIES = 250_000
#: Symbols of a word up to which words share an array of trees.
SHARED_TREE = 64
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Letters and numbers of the regex module's Unicode that the tokenizers library's does not know yet.
NEWER = """
558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb
11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191
191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4
1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f
"""
# Capitals that the library lower-cases and Python does not yet: first, last, distance.
CAPITALS = [(7305, 7305, 1), (42955, 42955, -42343), (42956, 42956, 1), (42958, 42958, 1), (42962, 42962, 1), (42964, 42964, 1), (42970, 42970, 1), (42972, 42972, -42561), (68944, 68965, 32), (93856, 93880, 27)]
_NEWER = "[" + "".join("-".join(f"\\U{int(x, 16):08x}" for x in r.split("-")) for r in NEWER.split()) + "]"
_WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--{_NEWER}]+|[\p{{N}}--{_NEWER}]|[[^\s\p{{L}}\p{{N}}]||{_NEWER}]+", regex.V1)
_CAPITALS = {c: c + d for a, b, d in CAPITALS for c in range(a, b + 1)}
#: The same on lower-case ASCII, and on texts of signs that Python's re and the pattern take alike.
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)
_USUAL_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
_USUAL = re.compile("[\t-\r -~\xa1\xab\xbb\xbf\xc0-\u024f\u0400-\u0481\u048a-\u052f\u2013-\u2026]*")
_NONE = np.int64(1) << 62


def byte_symbols() -> list[str]:
    """Byte-level BPE's printable character for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    named = {b: chr(b) for b in plain}
    rest = (b for b in range(256) if b not in named)
    named |= {b: chr(256 + k) for k, b in enumerate(rest)}
    return [named[b] for b in range(256)]


class Kept:
    """A bounded cache: when the young generation is full it becomes the old one."""

    def __init__(self, make, most: int = CACHE_ENTRIES):
        self.make, self.most, self.young, self.old = make, most, {}, {}

    def having(self, keys: set) -> dict:
        """A dict that holds all of `keys`; what is missing is made in one go."""
        lacking = list(keys.difference(self.young))
        if lacking and len(self.young) + len(lacking) > self.most:
            self.old, self.young = self.young, {}
            lacking = list(keys)
        new = []
        for k in lacking:
            if (v := self.old.get(k)) is None:
                new.append(k)
            else:
                self.young[k] = v
        if new:
            self.young.update(zip(new, self.make(new), strict=True))
        return self.young


class Splitter:
    """Normalises and pre-tokenises as a vocabulary file of this kind says, without calling the library."""

    def __init__(self, spec: dict):
        split = next((p for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"), {})
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        #: whether the file is of this kind
        self.fits = split.get("pattern", {}).get("Regex") == PATTERN and kinds == ["NFC", "Replace", "Lowercase"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None

    @staticmethod
    def _words(text: str) -> list[str]:
        if text.isascii():
            return _ASCII_WORDS.findall(text.lower())
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # character by character: a capital sigma at a word's end is no exception here
        text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        return _USUAL_WORDS.findall(text) if _USUAL.fullmatch(text) else _WORDS.findall(text.translate(_CAPITALS))

    def words_of(self, text: str) -> list[str]:
        """The pre-tokenised words of a text; special tokens stand for themselves."""
        if self.special is None or "<|" not in text or not self.special.search(text):
            return self._words(text)
        found: list[str] = []
        for p in self.special.split(text):
            found += [p] if p in self.added else self._words(p)
        return found


class WordBpe:
    """Encodes and decodes as the tokenizers library does with the same file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.final = np.array([vocab[s + suffix] for s in symbols], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.rank_of = dict(zip(keys.tolist(), range(len(pairs)), strict=True))
        self.splitter = Splitter(spec)
        if not self.splitter.fits:
            raise ValueError(f"{path} has another normaliser or pre-tokeniser")
        added = self.splitter.added
        self.special_ids = {t: np.array([i], "<u4").tobytes() for t, i in added.items()}
        self.tokens = [""] * (1 + max([*vocab.values(), *added.values()]))
        for token, i in [*vocab.items(), *added.items()]:
            self.tokens[i] = token
        self.forget()

    def forget(self) -> None:
        self.known = Kept(lambda words: [self.special_ids.get(w) or x for w, x in zip(words, self.encode_words([w.encode() for w in words]), strict=True)])

    # -- words ------------------------------------------------------------

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or _NONE."""
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of pre-tokenised words, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        by_size: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            n = len(w)
            if n == 1:
                out[k] = self.final[w[0]].astype("<u4").tobytes()
            elif n > SHARED_TREE:
                out[k] = self._one_tree(w)
            elif n:
                by_size.setdefault(n, []).append(k)
        for n, at in by_size.items():
            for k in range(0, len(at), 8192):
                part = at[k : k + 8192]
                for j, ids in zip(part, self._many_trees([words[i] for i in part], n), strict=True):
                    out[j] = ids
        return out

    def _many_trees(self, words: list[bytes], n: int) -> list[bytes]:
        """Words of n > 1 symbols each: row r of the arrays is the tree of word r."""
        raw = np.frombuffer(b"".join(words), np.uint8).reshape(-1, n)
        rows, leaves = len(words), 1 << (n - 2).bit_length()
        ids = self.inner[raw]
        ids[:, -1] = self.final[raw[:, -1]]
        # a slot more at either end: no symbol there, so no pair with it has a rank
        ids = np.pad(ids, ((0, 0), (1, 1)), constant_values=-1)
        after = np.tile(np.arange(1, n + 3), (rows, 1))
        before = np.tile(np.arange(-1, n + 1), (rows, 1))
        alive = np.ones((rows, n), bool)
        tree = np.full((rows, 2 * leaves), _NONE, np.int64)
        slot = np.arange(n - 1)
        ranks = self._rank(ids[:, 1:n], ids[:, 2 : n + 1])
        tree[:, leaves : leaves + n - 1] = np.where(ranks < _NONE, ranks << 8 | slot, _NONE)
        node = leaves
        while node > 1:
            half = tree[:, node : 2 * node]
            tree[:, node // 2 : node] = np.minimum(half[:, 0::2], half[:, 1::2])
            node //= 2
        live = np.flatnonzero(tree[:, 1] < _NONE)
        while live.size:
            root = tree[live, 1]
            at = (root & 255) + 1
            gone = after[live, at]
            ids[live, at] = self.merged[root >> 8]
            alive[live, gone - 1] = False
            following = after[live, gone]
            after[live, at] = following
            before[live, following] = at
            previous = before[live, at]
            here = self._rank(ids[live, at], ids[live, following])
            there = self._rank(ids[live, previous], ids[live, at])
            r2 = np.concatenate([live, live, live])
            leaf = np.concatenate([gone, at, np.maximum(previous, 1)]) - 1
            value = np.concatenate([np.full(live.size, _NONE), np.where(here < _NONE, here << 8 | (at - 1), _NONE), np.where(there < _NONE, there << 8 | (previous - 1), _NONE)])
            # a word's last symbol has no leaf; the missing symbol before its first has none either
            ok = leaf < n - 1
            ok[2 * live.size :] &= previous > 0
            r2, leaf, value = r2[ok], leaf[ok] + leaves, value[ok]
            tree[r2, leaf] = value
            while leaf.size and leaf[0] > 1:
                leaf = leaf >> 1
                tree[r2, leaf] = np.minimum(tree[r2, 2 * leaf], tree[r2, 2 * leaf + 1])
            live = live[tree[live, 1] < _NONE]
        flat = ids[:, 1 : n + 1][alive].astype("<u4").tobytes()
        ends = np.cumsum(alive.sum(1) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _one_tree(self, word: bytes) -> bytes:
        """A long word."""
        n = len(word)
        ids = self.inner[np.frombuffer(word, np.uint8)].tolist()
        ids[-1] = int(self.final[word[-1]])
        leaves = 1 << (n - 2).bit_length()
        none, shift = 1 << 62, (n - 1).bit_length()
        mask, rank_of = (1 << shift) - 1, self.rank_of.get
        tree = [none] * (2 * leaves)

        def pair(a: int, b: int) -> int:
            rank = rank_of(ids[a] << 32 | ids[b])
            return none if rank is None else rank << shift | a

        for k in range(n - 1):
            tree[leaves + k] = pair(k, k + 1)
        for k in range(leaves - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(leaf: int, value: int) -> None:
            k = leaves + leaf
            tree[k] = value
            while k > 1:
                k >>= 1
                a, b = tree[2 * k], tree[2 * k + 1]
                value = a if a < b else b
                if tree[k] == value:
                    return
                tree[k] = value

        while tree[1] < none:
            at = tree[1] & mask
            gone = after[at]
            ids[at] = int(self.merged[tree[1] >> shift])
            ids[gone] = -1
            following = after[gone]
            after[at] = following
            if gone < n - 1:
                put(gone, none)
            if following < n:
                before[following] = at
                put(at, pair(at, following))
            else:
                put(at, none)
            if before[at] >= 0:
                put(before[at], pair(before[at], at))
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    # -- texts ------------------------------------------------------------

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        split = [self.splitter.words_of(x) for x in texts]
        known = self.known.having(set(chain.from_iterable(split)))
        return [b"".join(map(known.__getitem__, s)) for s in split]

    def decode(self, ids: bytes) -> str:
        tokens = self.tokens
        return " ".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordBpe:
    return WordBpe(path)


def encode_decode(df: DataFrame, path: str, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Adds `ids` (binary: little-endian unsigned 32-bit token ids) and `decoded`.

    Every whole text is encoded without special tokens being added, then its ids are
    decoded again. Null and empty texts, and texts of white space only, have no ids
    and decode to the empty text. Repeated rows stay. The columns `carry` pass
    through; outputs replace columns of their name. No shuffle; a worker holds its
    two caches of bounded size and one slice of texts.
    """

    def make():
        bpe = tokenizer(path)

        def work(texts: list[str]):
            ids = bpe.encode_texts(texts)
            return [ids, [bpe.decode(x) for x in ids]]

        def close() -> None:
            bpe.forget()
            release()

        work.close = close
        return work

    return map_texts(df, make, "ids binary, decoded string", text_col, carry)


def decode_ids(df: DataFrame, path: str, ids_col: str = "ids", carry: list[str] | None = None) -> DataFrame:
    """Decodes a binary column of ids as `encode_decode` makes them; null ids: empty text."""
    import pyarrow as pa
    from pyspark.sql import types as T

    carry = [c for c in (carry or []) if c != "decoded"]
    schema = T.StructType([*(df.schema[c] for c in carry), T.StructField("decoded", T.StringType())])

    def run(batches):
        bpe = tokenizer(path)
        for b in batches:
            texts = [bpe.decode(x or b"") for x in b.column(len(carry)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(carry))), pa.array(texts, pa.string())], [*carry, "decoded"])

    return df.select(*carry, ids_col).mapInArrow(run, schema)
