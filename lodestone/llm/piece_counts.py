"""Token counts by a finite-state transducer compiled from a byte-pair model of the sentencepiece library.

A token sequence is the model's encoding of a text exactly if each token is the encoding
of its own characters and each two neighbours are the encoding of theirs. So the last
token of every prefix of a text follows from the last tokens of shorter prefixes, and
reading one character more is a transition of a deterministic transducer:

* a state holds, for each place where a longer piece may still begin, the token that ends
  there and how many tokens fewer or more the prefix up to there has than the whole one;
  tokens that no continuation tells apart are one;
* a transition is annotated with the tokens that it adds to the prefix's encoding: 1 where
  a token begins, 0 where the last one grows, less where short ones become one.

States and transitions are compiled when a text first asks for them and kept, up to a
bound, in a table of states by classes of characters.

Texts are run in chunks, all at once, one step a character. A chunk begins where two
characters stand together in no piece: its map of states is constant there. Longer chunks
(long runs without a space) are cut, and the map of what follows a cut is known for the
state that the characters before it lead to from scratch; a prefix scan composes the maps
by doubling and shows where they fit together, and where they don't the map gets the state
that really comes in.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, quoted, release

#: Characters of a chunk, about, and those before it from which the state at its start is guessed.
CHUNK, BEFORE = 256, 48
#: Characters that are run at a time, which a text may pass.
WINDOW = 4 << 20
#: Beyond so many states a worker forgets them before its next texts.
STATES = 100_000
#: Tokens before a place are told apart by the pieces that may begin there, if those are this many at most.
TOLD_APART = 10
#: Classes of characters: a text's start, then characters of no longer piece by the tokens they are.
START, ALONE = 0, 5
SPACE = "▁"


def _fields(raw: bytes) -> dict[int, list]:
    """The fields of a protocol-buffer message: numbers, or bytes."""
    at, found = 0, {}

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        key = number()
        if key & 7 == 0:
            value = number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            value, at = raw[at : at + size], at + size
        found.setdefault(key >> 3, []).append(value)
    return found


class Transducer:
    """The model's pieces, and the states and transitions compiled so far."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            spec = _fields(f.read())
        trainer, normal = _fields(spec[2][0]), _fields(spec[3][0])
        # model type 2 is byte pairs; 35 is byte fallback; no table of replacements, a space added in front, no space removed
        if trainer.get(3) != [2] or trainer.get(35) != [1] or any(normal.get(2, [])) or normal.get(3, [1]) != [1] or normal.get(4, [1]) != [0] or normal.get(5, [1]) != [1]:
            raise ValueError(f"{path} is not a byte-pair model with byte fallback that leaves texts as they are")
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        if len(plain) != sum(_fields(p).get(3, [1]) == [1] for p in spec[1]):
            raise ValueError(f"{path} has pieces of other kinds")
        self.rank = {model.id_to_piece(i): -model.get_score(i) for i in plain}
        self.sorted = sorted(self.rank)
        self.inner = {x[:k] for x in self.rank for k in range(len(x))}
        self.together = {x[k : k + 2] for x in self.rank for k in range(len(x) - 1)}
        self.letters = sorted({c for x in self.rank if len(x) > 1 for c in x})
        # a letter that is no piece itself would be bytes until it is merged
        if not set(self.letters) <= set(self.rank) or any(SPACE in x.lstrip(SPACE) for x in self.rank):
            raise ValueError(f"{path} has pieces that this transducer doesn't take")
        self.classes = ALONE + len(self.letters)
        table = np.empty(0x110000, np.int16)
        for first, width in ((0, 1), (0x80, 2), (0x800, 3), (0x10000, 4)):
            table[first:] = width
        for x in self.rank:
            if len(x) == 1:
                table[ord(x)] = 1
        for k, c in enumerate(self.letters):
            table[ord(c)] = ALONE + k
        table[ord(" ")] = table[ord(SPACE)]
        self.class_of = table
        self.width = np.ones(self.classes, np.int8)
        self.width[2:ALONE] = (2, 3, 4)
        #: by two classes, the state after them where they stand in no piece together, or -1
        self.jump = np.tile(np.arange(self.classes, dtype=np.int16), (self.classes, 1))
        at = {c: ALONE + k for k, c in enumerate(self.letters)}
        for a, b in self.together:
            self.jump[at[a], at[b]] = -1
        # a text starts with a space of its own
        self.jump[START] = self.jump[at[SPACE]]
        self.merges: dict[str, list[tuple[float, str, str]] | None] = {}
        self.forget()

    # -- compiling ----------------------------------------------------------

    def forget(self) -> None:
        self.states: dict[tuple, int] = {}
        self.rows: list[tuple] = []
        self.valid_pairs: dict[tuple[str, str], bool] = {}
        self.stand_ins: dict[tuple[str, str], object] = {}
        self.first_of: dict[tuple, str] = {}
        #: by state and class: the next state, and the tokens added plus 16 in the last five bits; 0: not compiled yet
        self.table = np.zeros(self.classes << 12, np.int32)
        # states 0 to classes - 1: after a character that stands in no piece with the one before
        for c in range(self.classes):
            letter = SPACE if c == START else self.letters[c - ALONE] if c >= ALONE else ""
            state = ("", ((None, 0),)) if c and c < ALONE else self._after(("", ((None, 0),)), letter)[0]
            self.rows.append(state)
            self.states.setdefault(state, c)

    def _merges(self, piece: str) -> list[tuple[float, str, str]] | None:
        """The merges that make a piece of its characters: rank, first and last part after each; None if they make others."""
        found = self.merges.get(piece, False)
        if found is False:
            parts, rank, found = list(piece), self.rank, []
            while len(parts) > 1:
                best, at = min((rank.get(a + b, np.inf), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if best == np.inf:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                found.append((best, parts[0], parts[-1]))
            found.append((np.inf, "", ""))
            found = self.merges[piece] = found if parts == [piece] and piece in rank else None
        return found

    def _valid(self, before: str | None, piece: str) -> bool:
        """Whether a piece may follow a token (None: any piece may): whether no merge joins them before both are whole."""
        if before is None or before[-1] + piece[0] not in self.together:
            return True
        found = self.valid_pairs.get((before, piece))
        if found is None:
            rank, left, right, i, j = self.rank, self._merges(before), self._merges(piece), 0, 0
            a, b = before[-1], piece[0]
            across = rank.get(a + b, np.inf)
            while True:
                one, other = left[i][0], right[j][0]
                # of equal ranks the leftmost pair is merged
                if across < one and across <= other:
                    found = False
                    break
                if one <= other:
                    if one == np.inf:
                        found = True
                        break
                    new, i = (left[i][2], b), i + 1
                else:
                    new, j = (a, right[j][1]), j + 1
                if new != (a, b):
                    a, b = new
                    across = rank.get(a + b, np.inf)
            self.valid_pairs[before, piece] = found
        return found

    def _stand_in(self, before: str | None, part: str) -> object:
        """The first token known that allows the same pieces to begin with `part`; None: all, False: none."""
        if before is None or before[-1] + part[0] not in self.together:
            return None
        key = (before, part)
        if key not in self.stand_ins:
            a, b = bisect_right(self.sorted, part), bisect_left(self.sorted, part + "\U0010ffff")
            made: object = before
            if b - a <= TOLD_APART:
                fits = tuple(self._merges(x) is not None and self._valid(before, x) for x in self.sorted[a:b])
                made = None if all(fits) else self.first_of.setdefault((part, fits), before) if any(fits) else False
            self.stand_ins[key] = made
        return self.stand_ins[key]

    def _after(self, state: tuple, letter: str) -> tuple[tuple, int]:
        """The state after one letter more, and the tokens it adds.

        A state is the longest end of the text with which a longer piece may begin, and
        for 0, 1, ... characters from the end: None if no piece can begin there, or the
        token that ends there and its distance in tokens.
        """
        text, places = state[0] + letter, state[1]
        for n in range(len(text), 0, -1):
            place = places[n - 1]
            if place is not None and self._merges(text[-n:]) is not None and self._valid(place[0], text[-n:]):
                added = place[1] + 1
                break
        new: list = [(text[-n:], 0)]
        for k in range(1, len(text) + 1):
            place, part = places[k - 1], text[-k:]
            before = self._stand_in(place[0], part) if place is not None and part in self.inner else False
            new.append(None if before is False else (before, place[1] - added))
        while new[-1] is None:
            new.pop()
        return (text[len(text) - len(new) + 1 :], tuple(new)), added

    def _moves(self, states: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """The transitions of states by classes; those that lack are compiled."""
        keys = states * np.int64(self.classes) + kinds
        moves = self.table.take(keys)
        if not moves.all():
            for key in np.unique(keys[moves == 0]).tolist():
                state, c = divmod(key, self.classes)
                after, added = self._after(self.rows[state], self.letters[c - ALONE])
                at = self.states.setdefault(after, len(self.rows))
                if at == len(self.rows):
                    self.rows.append(after)
                    if len(self.rows) * self.classes > len(self.table):
                        self.table = np.append(self.table, np.zeros_like(self.table))
                self.table[key] = at << 5 | added + 16
            moves = self.table.take(keys)
        return moves

    # -- running --------------------------------------------------------------

    def _walk(self, kinds: np.ndarray, starts: np.ndarray, ends: np.ndarray, states: np.ndarray, added: np.ndarray | None) -> np.ndarray:
        """The states after each chunk of characters, from those before it; `added` gets each character's tokens."""
        sizes = ends - starts
        order = np.argsort(-sizes, kind="stable")
        # chunks that have more than t characters come first
        more = len(sizes) - np.cumsum(np.bincount(sizes))
        at, now = starts[order], states[order]
        for n in more[:-1].tolist():
            at, part = at[:n], now[:n]
            moves = self._moves(part, kinds.take(at))
            now[:n] = moves >> 5
            if added is not None:
                added[at] = (moves & 31) - 16
            at = at + 1
        out = np.empty_like(now)
        out[order] = now
        return out

    def run(self, kinds: np.ndarray, before: int = START, state: int = 1) -> tuple[np.ndarray, int]:
        """The tokens that each character adds, and the last state. `before`, `state`: class and state ahead of the first one."""
        jumps = self.jump[np.append(np.int16(before), kinds[:-1]), kinds]
        jumps[kinds == START] = START
        added = self.width[kinds]
        # chunks begin where maps are constant; longer ones are cut
        free = np.flatnonzero(jumps >= 0)
        starts = free if free.size and free[0] == 0 else np.append(0, free)
        sizes = np.diff(np.append(starts, len(kinds)))
        long = np.flatnonzero(sizes > CHUNK)
        if long.size:
            starts = np.sort(np.concatenate([starts, *(np.arange(a + CHUNK, a + n, CHUNK) for a, n in zip(starts[long].tolist(), sizes[long].tolist(), strict=True))]))
        ends = np.append(starts[1:], len(kinds))
        came_in = jumps[starts].astype(np.int32)
        constant = came_in >= 0
        guessed = np.flatnonzero(~constant)
        if guessed.size:
            came_in[guessed] = self._walk(kinds, np.maximum(starts[guessed] - BEFORE, 0), starts[guessed], np.ones(guessed.size, np.int32), None)
            if not constant[0]:
                came_in[0] = state
        # a constant map's first character is in its state already
        left = self._walk(kinds, starts + constant, ends, came_in, added)
        if guessed.size:
            self._join(kinds, starts, ends, constant, came_in, left, added)
        return added, int(left[-1])

    def _join(self, kinds, starts, ends, constant, came_in, left, added) -> None:
        """Puts right the chunks whose guessed state isn't the one that their predecessor leaves."""
        while True:
            wrong = np.flatnonzero(~fitting(constant, came_in, left))
            if not wrong.size:
                return
            # the first wrong chunk of each row of them: what comes in there is sure
            first = wrong[np.append(True, np.diff(wrong) > 1) | constant[wrong - 1]]
            maps: dict[tuple[bytes, int], tuple[int, np.ndarray]] = {}
            for j in first.tolist():
                state = int(left[j - 1])
                while j < len(starts) and not constant[j] and state != came_in[j]:
                    a, b = starts[j], ends[j]
                    key = (kinds[a:b].tobytes(), state)
                    if key not in maps:
                        end = self._walk(kinds, starts[j : j + 1], ends[j : j + 1], np.array([state], np.int32), added)
                        maps[key] = (int(end[0]), added[a:b].copy())
                    came_in[j] = state
                    left[j], added[a:b] = maps[key]
                    state, j = int(left[j]), j + 1

    def count(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text."""
        if len(self.rows) > STATES:
            self.forget()
        out, held, size = [0] * len(texts), [], 0
        for k, text in enumerate(texts):
            if len(text) > WINDOW:
                out[k] = self._count_long(text)
            elif text:
                held.append(k)
                size += len(text)
                if size > WINDOW:
                    self._count_short(texts, held, out)
                    held, size = [], 0
        self._count_short(texts, held, out)
        return out

    def _kinds(self, text: str) -> np.ndarray:
        return self.class_of[np.frombuffer(text.encode("utf-32-le"), np.uint32)]

    def _count_short(self, texts: list[str], which: list[int], out: list[int]) -> None:
        if not which:
            return
        sizes = np.array([len(texts[k]) for k in which])
        first = np.cumsum(sizes) - sizes
        kinds = np.insert(self._kinds("".join(texts[k] for k in which)), first, START)
        added, _ = self.run(kinds)
        for k, n in zip(which, np.add.reduceat(added, first + np.arange(len(which)), dtype=np.int64).tolist(), strict=True):
            out[k] = n

    def _count_long(self, text: str) -> int:
        """A window at a time; the state goes from one to the next."""
        total, before, state = 1, START, START
        for a in range(0, len(text), WINDOW):
            kinds = self._kinds(text[a : a + WINDOW])
            added, state = self.run(kinds, before, state)
            total, before = total + int(added.sum(dtype=np.int64)), int(kinds[-1])
        return total


def fitting(constant: np.ndarray, came_in: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Whether the maps of chunks compose, from the last constant one up to each chunk.

    A map known for one state is (state in, state out); two compose if the first's state
    out is the second's state in, or the second is constant. The scan doubles the length
    of what is composed.
    """
    n = len(left)
    fits = np.append(True, constant[1:] | (left[:-1] == came_in[1:]))
    closed = constant.copy()
    closed[:1] = True
    step = 1
    while step < n and not closed.all():
        fits[step:] &= closed[step:] | fits[:-step]
        closed[step:] |= closed[:-step]
        step *= 2
    return fits


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def count_tokens(df: DataFrame, path: str, text_col: str = "text", carry: list[str] | None = None, limit: int = 4096) -> DataFrame:
    """Adds `n_bytes`, `n_tokens` and `over_limit` (more than `limit` tokens), as the sentencepiece library counts whole texts.

    Null and empty texts have no bytes and no tokens; a text of spaces has tokens.
    Special pieces' strings in a text are ordinary text. Repeated rows stay. The columns
    `carry` pass through; outputs replace columns of their name. No shuffle; a worker
    holds the transitions that its texts have asked for, up to STATES, and one window.
    """

    def make():
        machine = transducer(path)

        def work(texts: list[str]):
            return [machine.count(texts)]

        work.close = release
        return work

    names = ("n_bytes", "n_tokens", "over_limit")
    carry = [c for c in (carry or []) if c not in names]
    text = F.col(quoted(text_col)).cast("string")
    held = df.select(*(F.col(quoted(c)).alias(f"__own_{k}") for k, c in enumerate(carry)), text.alias("__text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    made = map_texts(held, make, "n_tokens long", "__text", [f"__own_{k}" for k in range(len(carry))] + ["n_bytes"])
    return made.select(*(F.col(f"__own_{k}").alias(c) for k, c in enumerate(carry)), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
