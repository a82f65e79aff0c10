"""Token counts without tokens: a BPE vocabulary compiled to deterministic transducers.

Two machines read the text. The first divides it into words as the vocabulary's pattern does. It has five states; every stretch of text
is a map from entry state to exit state, the maps of all stretches are composed by a parallel prefix scan, and each stretch then knows
its entry state and marks its word starts.

The second reads the bytes of a word. After any prefix of a word the last token of the prefix's encoding is the one token that ends
there and follows the token before it, which is so if BPE leaves the two side by side. So a state is the longest end of the prefix that
still starts a token, with, for every place inside it where a token may start, the token before that place and the number of tokens
up to it, counted back from the end. Each transition is annotated with the tokens it adds. Prefixes with the same state share it, which
keeps the machine small; states are compiled when a text first needs them, and a worker drops its table when it outgrows a bound.

Defined results: null and empty texts have no bytes and no tokens; a special string inside a text counts as one token; texts are read
whole; repeated rows are counted alike; other columns pass through untouched.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codegraph_spark.llm import vocabulary as voc
from codegraph_spark.llm.batches import text_slices

MAX_STATES = 1 << 17
MAX_PAIRS = 1 << 19  # token pairs whose fit is remembered
ROWS, COLUMNS = 1 << 15, 64  # by which the tables grow
STRETCH = 256  # code points of a stretch of the word splitter

# The pattern of the supported vocabularies: contractions, letter runs, single numbers, runs of other characters.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

SPACE, LETTER, NUMBER, OTHER, SHORT, LONG = range(6)  # SHORT: 's 't 'm 'd, LONG: 're 've 'll, both at the apostrophe
BOUND, IN_LETTERS, IN_OTHER, TWO_LEFT, ONE_LEFT = range(5)
#: next state, and whether a word starts, by state and class
STEP = np.array([
    [BOUND, IN_LETTERS, BOUND, IN_OTHER, ONE_LEFT, TWO_LEFT],
    [BOUND, IN_LETTERS, BOUND, IN_OTHER, ONE_LEFT, TWO_LEFT],
    [BOUND, IN_LETTERS, BOUND, IN_OTHER, IN_OTHER, IN_OTHER],
    [ONE_LEFT] * 6,
    [BOUND] * 6,
], np.uint8)
STARTS = np.array([[0, 1, 1, 1, 1, 1], [0, 0, 1, 1, 1, 1], [0, 1, 1, 0, 0, 0], [0] * 6, [0] * 6], bool)

_CLASS: np.ndarray | None = None


def _classes() -> np.ndarray:
    """Class of every code point, apostrophes as OTHER."""
    global _CLASS
    if _CLASS is None:
        kind = {"L": LETTER, "N": NUMBER, "Z": SPACE}
        _CLASS = np.fromiter((kind.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
        _CLASS[[9, 10, 11, 12, 13, 0x85]] = SPACE
    return _CLASS


def word_starts(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every code point: does a word start there, and is it white space."""
    n = len(code)
    kind = _classes()[code]
    quote = np.flatnonzero(code == 39)
    if len(quote):
        after = np.append(code, [0, 0])
        one, two = after[quote + 1], after[quote + 2]
        kind[quote[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        kind[quote[((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))]] = LONG
    stretches = -(-n // STRETCH)
    padded = np.full(stretches * STRETCH, SPACE, np.uint8)
    padded[:n] = kind
    padded = padded.reshape(stretches, STRETCH).T.copy()
    flat = STEP.ravel()
    state = np.tile(np.arange(5, dtype=np.uint8), (stretches, 1))
    for t in range(STRETCH):
        state = flat[state * 6 + padded[t][:, None]]
    # inclusive prefix scan of the stretch maps by doubling
    scanned, hop = state, 1
    while hop < stretches:
        scanned = np.concatenate([scanned[:hop], np.take_along_axis(scanned[hop:], scanned[:-hop].astype(np.intp), axis=1)])
        hop *= 2
    now = np.concatenate([[BOUND], scanned[:-1, BOUND]]).astype(np.uint8)
    starts, marks = np.empty((STRETCH, stretches), bool), STARTS.ravel()
    for t in range(STRETCH):
        at = now * 6 + padded[t]
        starts[t], now = marks[at], flat[at]
    return starts.T.reshape(-1)[:n], kind == SPACE


class Compiler:
    """The word transducer of a vocabulary, compiled on demand."""

    def __init__(self, vocabulary: voc.Vocabulary, max_states: int = MAX_STATES):
        if vocabulary.pattern.pattern != PATTERN:
            raise ValueError("the word splitter is compiled for another pattern")
        v, self.max_states = vocabulary, max_states
        self.pairs, self.merged = v.by_pair, v.merged.tolist()
        self.inner, self.final = v.inner.tolist(), v.final.tolist()
        byte_of = {int(s): (b, end) for end, ids in ((False, v.inner), (True, v.final)) for b, s in enumerate(ids)}
        spelled: dict[int, tuple[int, ...]] = {s: (s,) for s in byte_of}
        for rank, key in sorted(zip(v.pair_ranks.tolist(), v.pair_keys.tolist(), strict=True)):
            spelled.setdefault(self.merged[rank], spelled[key >> 32] + spelled[key & 0xFFFFFFFF])
        self.by_spelling = {}
        self.prefixes: set[tuple[int, ...]] = set()  # proper prefixes of tokens, in inner symbols
        for t, s in spelled.items():
            if self._bpe(s) == [t]:  # a token that its own spelling does not give never occurs
                self.by_spelling[s] = t
                for k in range(1, len(s)):
                    self.prefixes.add(s[:k])
        self.spelled = spelled
        self.column = np.full(256, -1, np.int32)  # of a byte; bytes get theirs when a text first has them
        self.bytes: list[int] = []
        self.width = COLUMNS
        self._forget()

    def _forget(self) -> None:
        self.states = [((), ((None, 0),))]
        self.index = {self.states[0]: 0}
        self.beside: dict[tuple[int, int], bool] = {}
        self.step = np.full((ROWS, self.width), -1, np.int32)
        self.adds = np.zeros((ROWS, self.width), np.int8)
        self.ends = np.full((ROWS, self.width), -1, np.int16)

    def _restart(self, live: np.ndarray) -> np.ndarray:
        """Forget all states but those that words stand in; their new numbers."""
        kept, place = np.unique(live, return_inverse=True)
        found = [self.states[i] for i in kept.tolist()]
        self._forget()
        return np.array([self._add_state(x) for x in found], np.int32)[place]

    def _grow(self, rows: int, columns: int) -> None:
        wider = lambda a, fill: np.pad(a, ((0, rows), (0, columns)), constant_values=fill)
        self.step, self.adds, self.ends = wider(self.step, -1), wider(self.adds, 0), wider(self.ends, -1)
        self.width += columns

    def _columns(self, raw: np.ndarray) -> np.ndarray:
        for b in np.flatnonzero(np.bincount(raw, minlength=256)).tolist():
            if self.column[b] < 0:
                if len(self.bytes) == self.step.shape[1]:
                    self._grow(0, COLUMNS)
                self.column[b] = len(self.bytes)
                self.bytes.append(b)
        return self.column[raw]

    def _bpe(self, symbols) -> list[int]:
        symbols = list(symbols)
        while len(symbols) > 1:
            ranks = [self.pairs.get(a << 32 | b, -1) for a, b in zip(symbols, symbols[1:], strict=False)]
            lowest = min((r for r in ranks if r >= 0), default=-1)
            if lowest < 0:
                break
            at = ranks.index(lowest)
            symbols[at : at + 2] = [self.merged[lowest]]
        return symbols

    def _fits(self, left: int | None, right: int) -> bool:
        """Whether BPE leaves the two tokens side by side."""
        if left is None:
            return True
        key = (left, right)
        if key not in self.beside:
            self.beside[key] = self._bpe(self.spelled[left] + self.spelled[right]) == [left, right]
        return self.beside[key]

    def _last(self, state, symbol: int) -> tuple[int, int]:
        """Token that ends with ``symbol``, and the count up to and with it, relative to the state's end."""
        tail, before = state
        for back in range(len(tail), -1, -1):
            entry = before[len(tail) - back]
            if entry is not None:
                t = self.by_spelling.get(tail[len(tail) - back :] + (symbol,))
                if t is not None and self._fits(entry[0], t):
                    return t, entry[1] + 1
        raise AssertionError("a single byte is a token")

    def _add_state(self, state) -> int:
        if state not in self.index:
            if len(self.states) == len(self.step):
                self._grow(ROWS, 0)
            self.index[state] = len(self.states)
            self.states.append(state)
        return self.index[state]

    def compile_step(self, s: int, column: int) -> None:
        tail, before = state = self.states[s]
        symbol = self.inner[self.bytes[column]]
        t, count = self._last(state, symbol)
        text, entries = tail + (symbol,), (*before, (t, count))
        cut = 0
        while cut < len(text) and text[cut:] not in self.prefixes:
            cut += 1
        # places where no token that is still open can start are dropped
        kept = tuple((e[0], e[1] - count) if e is not None and (i + cut == len(text) or text[i + cut :] in self.prefixes) else None for i, e in enumerate(entries[cut:]))
        to = self._add_state((text[cut:], kept))
        self.step[s, column], self.adds[s, column] = to, count

    def compile_end(self, s: int, column: int) -> None:
        self.ends[s, column] = self._last(self.states[s], self.final[self.bytes[column]])[1]

    def count(self, raw: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Tokens of each word, given as stretches of bytes."""
        if len(self.states) > self.max_states or len(self.beside) > MAX_PAIRS:
            self._forget()
        column = self._columns(raw)
        order = np.argsort(-length, kind="stable")
        begin, length = begin[order], length[order]
        state, total, bound = np.zeros(len(order), np.int32), np.zeros(len(order), np.int32), self.max_states
        for k in range(int(length[0]) if len(length) else 0):
            live = int(np.searchsorted(-length, -k, "left"))
            more = int(np.searchsorted(-length, -k - 1, "left"))
            at = column[begin[:live] + k]
            if more < live:
                s, b = state[more:live], at[more:]
                self._complete("ends", self.compile_end, s, b)
                total[more:live] += self.ends[s, b]
            if more:
                s, b = state[:more], at[:more]
                self._complete("step", self.compile_step, s, b)
                total[:more] += self.adds[s, b]
                state[:more] = self.step[s, b]
                # one unbroken run of letters can make a state a byte
                if len(self.states) > bound or len(self.beside) > MAX_PAIRS:
                    state[:more] = self._restart(state[:more])
                    bound = max(self.max_states, 2 * len(self.states))
        out = np.empty(len(order), np.int32)
        out[order] = total
        return out

    def _complete(self, table: str, compile_one, s: np.ndarray, b: np.ndarray) -> None:
        lack = np.flatnonzero(getattr(self, table)[s, b] == -1)
        for key in np.unique(s[lack].astype(np.int64) << 8 | b[lack]).tolist():
            compile_one(key >> 8, key & 255)


def count_tokens(texts: list[str | None], machine: Compiler, vocabulary: voc.Vocabulary) -> np.ndarray:
    total = np.zeros(len(texts), np.int64)
    pieces, owner = [], []
    for d, text in enumerate(texts):
        for i, piece in enumerate(voc.segments(text, vocabulary)):
            if i % 2:
                total[d] += 1
            elif piece:
                pieces.append(voc.normalized(piece))
                owner.append(d)
    if not pieces:
        return total
    joined = "\n".join(pieces)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    raw = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
    starts, space = word_starts(code)
    width = 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)
    place = np.cumsum(width) - width
    first = np.flatnonzero(starts)
    if not len(first):
        return total
    edge = np.flatnonzero(starts | space)
    following = np.append(edge, len(code))[np.searchsorted(edge, first, "right")]
    begin = place[first]
    length = np.append(place, len(raw))[following] - begin
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1
    piece_of = np.searchsorted(np.cumsum(sizes) - sizes, first, "right") - 1
    np.add.at(total, np.array(owner)[piece_of], machine.count(raw, begin, length))
    return total


_MACHINES: dict[str, tuple[Compiler, voc.Vocabulary]] = {}


def _machine(path: str, text: str) -> tuple[Compiler, voc.Vocabulary]:
    if path not in _MACHINES:
        v = voc.parse(text)
        _MACHINES[path] = Compiler(v), v
    return _MACHINES[path]


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """Columns ``row`` (the input row as a struct), ``n_bytes`` and ``n_tokens``. The text column is ``text``."""
    with open(path, encoding="utf-8") as f:  # the vocabulary travels with the job: executors need no file
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        machine, v = _machine(path, shared.value)
        for part, texts in text_slices(batches, "row", max_bytes=1 << 20):
            n_bytes = [len((t or "").encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(n_bytes, pa.int64()), pa.array(count_tokens(texts, machine, v))], ["row", "n_bytes", "n_tokens"])

    rows = docs.select(F.struct("*").alias("row"))
    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]))
