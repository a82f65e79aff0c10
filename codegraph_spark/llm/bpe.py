"""BPE encoding and decoding in batched numpy merge rounds.

The words of a batch that are not known yet lie in one flat array of symbols. Every round finds the rank of each neighbouring pair by
binary search over the sorted pair keys, picks the lowest-ranked pair of every word, merges all its places in all words at once and
looks up only the pairs that a merge has changed. Known words are kept per Python worker up to a bound.

Defined results: null and empty texts have no tokens and decode to the empty string; special strings inside a text become their special
token; text is read whole, whatever its length; repeated rows are encoded alike; other columns pass through untouched.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codegraph_spark.llm import vocabulary as voc
from codegraph_spark.llm.batches import ragged, text_slices

KNOWN_CHUNKS = 1 << 18  # chunks of text between white space whose ids a worker keeps
KNOWN_CHARS = 1 << 24  # and their code points
_NONE = np.int32(2**31 - 1)


def merge_words(words: list[bytes], v: voc.Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of all words and the number of ids of each."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    if not len(words) or not lengths.sum():
        return np.zeros(0, np.int32), lengths
    raw = np.frombuffer(b"".join(words), np.uint8)
    symbol = v.inner[raw]
    last = np.cumsum(lengths)[lengths > 0] - 1
    symbol[last] = v.final[raw[last]]
    word = np.repeat(np.arange(len(words)), lengths)

    def ranks(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(v.pair_keys, key), len(v.pair_keys) - 1)
        return np.where(v.pair_keys[at] == key, v.pair_ranks[at], _NONE)

    done_word, done_symbol, done_place = [], [], []
    place = np.arange(len(symbol))
    rank = np.full(len(symbol), _NONE, np.int32)  # of a symbol and its right neighbour
    inside = np.flatnonzero(word[1:] == word[:-1])
    rank[inside] = ranks(symbol[inside], symbol[inside + 1])
    while len(symbol):
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        size = np.diff(np.append(first, len(word)))
        lowest = np.minimum.reduceat(rank, first)
        over = np.repeat(lowest == _NONE, size)
        if over.any():  # words without a pair to merge leave the array
            done_word.append(word[over])
            done_symbol.append(symbol[over])
            done_place.append(place[over])
            keep = ~over
            symbol, word, place, rank = symbol[keep], word[keep], place[keep], rank[keep]
            lowest, size = lowest[lowest != _NONE], size[lowest != _NONE]
            if not len(symbol):
                break
        hit = rank == np.repeat(lowest, size)
        at = np.flatnonzero(hit)
        # of overlapping places (aaa) every second one from the left merges
        chain = np.concatenate([[True], at[1:] != at[:-1] + 1])
        begin = np.maximum.accumulate(np.where(chain, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - begin) % 2 == 0]
        symbol[at] = v.merged[rank[at]]
        keep = np.ones(len(symbol), bool)
        keep[at + 1] = False
        moved = np.cumsum(keep) - 1
        symbol, word, place, rank = symbol[keep], word[keep], place[keep], rank[keep]
        changed = moved[at]
        changed = np.unique(np.concatenate([changed, changed[changed > 0] - 1]))
        rank[changed] = _NONE
        changed = changed[changed + 1 < len(symbol)]
        changed = changed[word[changed] == word[changed + 1]]
        rank[changed] = ranks(symbol[changed], symbol[changed + 1])
    word, symbol, place = (np.concatenate(x) for x in (done_word, done_symbol, done_place))
    order = np.argsort(place)
    return symbol[order].astype(np.int32), np.bincount(word, minlength=len(words))


class Encoder:
    """Encodes texts; keeps the ids of the chunks between white space that it has met."""

    def __init__(self, vocabulary: voc.Vocabulary, keep: int = KNOWN_CHUNKS):
        self.v, self.keep = vocabulary, keep
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.begin = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)
        self.used = self.chars = 0

    def _learn(self, chunks: list[str]) -> None:
        words, per_chunk = [], []
        for c in chunks:
            found = self.v.pattern.findall(c)
            per_chunk.append(len(found))
            words += [w.encode("utf-8", "surrogatepass") for w in found]
        ids, n_ids = merge_words(words, self.v)
        first = np.concatenate([[0], np.cumsum(n_ids)])
        edge = np.concatenate([[0], np.cumsum(per_chunk)]).astype(np.int64)
        begin, end = first[edge[:-1]], first[edge[1:]]
        n = len(self.index)
        while n + len(chunks) > len(self.begin):
            self.begin, self.size = np.append(self.begin, np.zeros_like(self.begin)), np.append(self.size, np.zeros_like(self.size))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.append(self.ids, np.zeros_like(self.ids))
        self.ids[self.used : self.used + len(ids)] = ids
        self.begin[n : n + len(chunks)], self.size[n : n + len(chunks)] = begin + self.used, end - begin
        self.used += len(ids)
        self.chars += sum(map(len, chunks))
        self.index.update(zip(chunks, range(n, n + len(chunks)), strict=True))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.index) > self.keep or self.chars > KNOWN_CHARS:
            self._forget()
        parts: list[list] = []
        for text in texts:
            pieces = voc.segments(text, self.v)
            parts.append([voc.chunks(p) if i % 2 == 0 else self.v.special[p] for i, p in enumerate(pieces)])
        seen = {c for doc in parts for p in doc if isinstance(p, list) for c in p}
        self._learn([c for c in seen if c not in self.index])
        out = []
        for doc in parts:
            ids = []
            for p in doc:
                if isinstance(p, list):
                    known = np.fromiter(map(self.index.__getitem__, p), np.int64, len(p))
                    ids.append(self.ids[ragged(self.begin[known], self.size[known])])
                else:
                    ids.append(np.array([p], np.int32))
            out.append(ids[0] if len(ids) == 1 else np.concatenate(ids))
        return out


def decode(ids: np.ndarray, names: list[bytes]) -> bytes:
    """The tokens' own strings with a space between, as vocabularies without a decoder are decoded; in UTF-8."""
    return b" ".join(map(names.__getitem__, ids.tolist()))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, text: str) -> Encoder:
    """This worker's encoder for the vocabulary that came from ``path``."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(voc.parse(text))
    return _ENCODERS[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Columns ``row`` (the input row as a struct) and ``ids`` (array of int). The text column is ``text``."""
    return _encoded(docs, path, T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType()))]), lambda e, ids: [pa.array(ids, pa.list_(pa.int32()))])


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Columns ``row``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``: encoded and decoded where the text lies, only digests leave."""

    def of(e: Encoder, ids: list[np.ndarray]) -> list[pa.Array]:
        names = [t.encode("utf-8") for t in e.v.tokens]
        return [
            pa.array([len(x) for x in ids], pa.int64()),
            pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
            pa.array([hashlib.sha256(decode(x, names)).hexdigest() for x in ids], pa.string()),
        ]

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return _encoded(docs, path, T.StructType(fields), of)


def _encoded(docs: DataFrame, path: str, added: T.StructType, columns) -> DataFrame:
    with open(path, encoding="utf-8") as f:  # the vocabulary travels with the job: executors need no file
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        e = encoder(path, shared.value)
        for part, texts in text_slices(batches, "row", max_bytes=1 << 20):
            yield pa.RecordBatch.from_arrays([part.column("row"), *columns(e, e.encode(texts))], ["row", *added.names])

    rows = docs.select(F.struct("*").alias("row"))
    return rows.mapInArrow(run, T.StructType([rows.schema["row"], *added.fields]))


def decode_ids(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``: the text of the ids (null ids: null); an existing ``decoded`` is replaced."""
    names = docs_names(path)
    shared = rows.sparkSession.sparkContext.broadcast(names)

    def run(batches):
        for batch in batches:
            out = [None if x is None else decode(np.array(x, np.int64), shared.value).decode("utf-8") for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.string())], ["row", "decoded"])

    kept = [c for c in rows.columns if c != "decoded"]
    packed = rows.select(F.col(ids).alias("ids"), F.struct(*kept).alias("row"))
    return packed.mapInArrow(run, T.StructType([packed.schema["row"], T.StructField("decoded", T.StringType())])).select("row.*", "decoded")


def docs_names(path: str) -> list[bytes]:
    return [t.encode("utf-8") for t in voc.load(path).tokens]
