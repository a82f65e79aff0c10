"""Benchmark passages in documents by a prefix-filtered set join.

Every window of an item (``window`` words, or the whole of a shorter item) is a set of word shingles. A document that contains the window
contains all its shingles, so it is enough to meet one: shingles are ordered by how often they stand in the documents, and the rarest is
the window's prefix (at exact containment a prefix has one token). A first pass over the documents counts the shingles of the benchmark, a
second one emits the places of prefix shingles with the words around them; these join the prefixes by hash. A place and the prefix's
offset give the only possible start; it has to leave room for the window on both sides, and then the words are compared one by one.

Both passes look shingles up in a Bloom filter of at most ``FILTER_BITS`` bits, whatever the size of the benchmark; what it lets through by
mistake ends in the join. Equal windows of several items are one window. Which items a document meets follows from its set of windows;
the items of each distinct set are listed once, however many documents share it.

Words are runs of ASCII digits, letters and all bytes beyond ASCII after A-Z were lower-cased, found by byte tables; texts are read whole,
in segments of ``SEGMENT`` bytes, and a word may be longer than that.

Defined results: null and blank texts have no words; an item without words has no window; repeated rows are documents each; a repeated
item counts once; a null ``item_id`` is the item named by the empty string; an empty benchmark hits nothing; other columns do not matter.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codegraph_spark.llm.batches import ragged
from codegraph_spark.llm.small import beside
from codegraph_spark.plans.lineage import cut

WINDOW = 10
SHINGLE = 4
SEGMENT = 1 << 18
SLICE_BYTES = 1 << 20
FILTER_BITS = 1 << 27
_BASE = 0x9E3779B97F4A7C15
_STEP = 0xD6E8FEB86659FD93
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@functools.cache
def _tables():
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    inside = np.zeros(256, bool)
    inside[48:58] = inside[97:123] = inside[128:] = True
    power = np.full(SEGMENT + 1, _BASE, np.uint64)
    power[0] = 1
    back = np.full(SEGMENT + 1, pow(_BASE, -1, 1 << 64), np.uint64)
    back[0] = 1
    return lower, inside, np.cumprod(power, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word of the bytes, and the bytes in lower case."""
    lower, inside, power, back = _tables()
    data = lower[data]
    hashes, begins, ends = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo in range(0, len(data), SEGMENT):
        seg = data[lo : lo + SEGMENT]
        edge = np.flatnonzero(np.diff(inside[seg].astype(np.int8), prepend=0, append=0))
        start, end = edge[0::2], edge[1::2]
        upto = np.zeros(len(seg) + 1, np.uint64)
        np.cumsum((seg.astype(np.uint64) + np.uint64(1)) * power[: len(seg)], out=upto[1:])
        hashes.append((upto[end] - upto[start]) * back[start])
        begins.append(start + lo)
        ends.append(end + lo)
    h, start, end = np.concatenate(hashes), np.concatenate(begins), np.concatenate(ends)
    new = np.ones(len(h), bool)
    new[1:] = start[1:] != end[:-1]
    if not new.all():  # pieces of words that cross segments
        first = np.flatnonzero(new)
        for i in np.flatnonzero(~new).tolist():
            offset = int(start[i] - start[first[np.searchsorted(first, i) - 1]])
            h[i : i + 1] *= np.uint64(pow(_BASE, offset, 1 << 64))
        last = np.append(first[1:], len(h)) - 1
        h, start, end = np.add.reduceat(h, first), start[first], end[last]
    return _mix(h), start, end, data


def shingles_of(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``k`` words from each place on, and the places where they are of one document."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out, factor = np.full(n, k, np.uint64), 1
    for j in range(k):
        out += h[j : j + n] * np.uint64(factor)
        factor = factor * _STEP & ((1 << 64) - 1)
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return _mix(out)[at], at


def _slices(batches):
    """Batches with the bytes of their texts, one after the other with a line feed between, and where each text starts."""
    for batch in batches:
        texts = pc.fill_null(batch.column("text").cast(pa.binary()), b"")
        upto = np.cumsum(np.asarray(pc.binary_length(texts)), dtype=np.int64)
        lo, base = 0, 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(upto, base + SLICE_BYTES, "right")))
            part = texts.slice(lo, hi - lo)
            size = np.asarray(pc.binary_length(part), dtype=np.int64) + 1
            yield batch.slice(lo, hi - lo), np.frombuffer(b"\n".join(part.to_pylist()), np.uint8), np.cumsum(size) - size
            lo, base = hi, int(upto[hi - 1])


class Filter:
    """A Bloom filter with two probes."""

    def __init__(self, bits: np.ndarray, log2: int):
        self.bits, self.log2 = bits, log2

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """Places of ``h`` that may be in the filter."""
        at = np.flatnonzero(self._test(h, 0))
        return at[self._test(h[at], 32)]

    def _test(self, h, shift):
        i = (h >> np.uint64(shift)) & np.uint64((1 << self.log2) - 1)
        return (self.bits[(i >> np.uint64(6)).astype(np.int64)] >> (i & np.uint64(63))) & np.uint64(1) != 0


def filter_of(hashes: DataFrame, most_bits: int = FILTER_BITS) -> Filter:
    """A filter of the column ``hash``: about 32 bits a hash, at least 2 ** 20 and at most ``most_bits``."""
    log2 = min(most_bits.bit_length() - 1, max(20, int(hashes.count()).bit_length() + 5))
    mask = F.lit((1 << log2) - 1)
    probes = F.array(F.col("hash").bitwiseAND(mask), F.shiftrightunsigned("hash", 32).bitwiseAND(mask))
    words = hashes.select(F.explode(probes).alias("i")).groupBy(F.shiftright("i", 6).alias("word"))
    got = words.agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("i").bitwiseAND(F.lit(63)).cast("int"))).alias("bits")).toArrow()
    bits = np.zeros(1 << max(0, log2 - 6), np.uint64)
    bits[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return Filter(bits, log2)


def item_words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def windows_of(benchmark: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (wid, text, n_words) and their items (wid, item)."""
    split = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), item_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    begin = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    each = split.select("item", "w", F.explode(begin).alias("at")).select("item", F.array_join(F.slice("w", F.col("at"), F.lit(window)), " ").alias("text"), F.least(F.size("w"), F.lit(window)).alias("n_words"))
    each = cut(each.distinct())
    distinct = cut(each.select("text", "n_words").distinct().withColumn("wid", F.monotonically_increasing_id()))
    return distinct, cut(each.join(distinct, ["text", "n_words"]).select("wid", "item"))


def window_shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """wid, ``offset`` (words) and ``hash`` of every shingle; a window of fewer words is one shingle."""

    def run(batches):
        for part, data, begins in _slices(batches):
            h, start, _, _ = words_of(data)
            doc = np.searchsorted(begins, start, "right") - 1
            first = np.searchsorted(doc, np.arange(part.num_rows))
            length = np.searchsorted(doc, np.arange(part.num_rows), "right") - first
            wid = part.column("wid").to_numpy()
            for k in range(1, shingle + 1):
                s, at = shingles_of(h, doc, k)
                ours = np.minimum(length[doc[at]], shingle) == k
                s, at = s[ours], at[ours]
                yield pa.RecordBatch.from_arrays([pa.array(wid[doc[at]]), pa.array((at - first[doc[at]]).astype(np.int32)), pa.array(s.view(np.int64))], ["wid", "offset", "hash"])

    return windows.select("wid", "text").mapInArrow(run, "wid long, offset int, hash long")


def shingle_counts(docs: DataFrame, wanted: Filter, ks: list[int]) -> DataFrame:
    """``hash`` and ``freq`` (places in all documents) of the shingles that the filter lets through."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        for _, data, begins in _slices(batches):
            h, start, _, _ = words_of(data)
            doc = np.searchsorted(begins, start, "right") - 1
            for k in ks:
                s, _ = shingles_of(h, doc, k)
                found, n = np.unique(s[shared.value(s)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["hash", "n"])

    return docs.select("text").mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("freq"))


def places(docs: DataFrame, wanted: Filter, ks: list[int], window: int) -> DataFrame:
    """Per document one row (``row``, doc_id, n_words), and one per place of a wanted shingle: row, n_words, pos, hash, and the words around it.

    ``before`` words of ``around`` stand before the place.
    """
    shared = docs.sparkSession.sparkContext.broadcast(wanted)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    kind = rows.schema["doc_id"].dataType

    def run(batches):
        for part, data, begins in _slices(batches):
            h, start, end, data = words_of(data)
            doc = np.searchsorted(begins, start, "right") - 1
            first = np.searchsorted(doc, np.arange(part.num_rows))
            last = np.searchsorted(doc, np.arange(part.num_rows), "right")
            row, n = part.column("row"), pa.array((last - first).astype(np.int64))
            none = lambda t: pa.nulls(part.num_rows, t)
            names = ["row", "doc_id", "n_words", "pos", "hash", "before", "around"]
            yield pa.RecordBatch.from_arrays([row, part.column("doc_id"), n, none(pa.int64()), none(pa.int64()), none(pa.int32()), none(pa.string())], names)
            for k in ks:
                s, at = shingles_of(h, doc, k)
                met = shared.value(s)
                s, at = s[met], at[met]
                if not len(at):
                    continue
                of = doc[at]
                lo, hi = np.maximum(at - window + 1, first[of]), np.minimum(at + window, last[of])
                which = ragged(lo, hi - lo)
                text, begin = _joined(data, start[which], end[which], hi - lo)
                around = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(begin), pa.py_buffer(text)]).cast(pa.string())
                owner = pa.array(of)
                yield pa.RecordBatch.from_arrays(
                    [row.take(owner), part.column("doc_id").take(owner), n.take(owner), pa.array(at - first[of]), pa.array(s.view(np.int64)), pa.array((at - lo).astype(np.int32)), around], names
                )

    return rows.mapInArrow(run, f"row long, doc_id {kind.simpleString()}, n_words long, pos long, hash long, before int, around string")


def _joined(data, start, end, n_words) -> tuple[np.ndarray, np.ndarray]:
    """The words, each followed by a blank, as one array of bytes, and where every group of ``n_words`` begins."""
    length = end - start + 1
    text = data[np.minimum(ragged(start, length), len(data) - 1)]
    text[np.cumsum(length) - 1] = 32
    upto = np.concatenate([[0], np.cumsum(length)])
    return text, upto[np.concatenate([[0], np.cumsum(n_words)])].astype(np.int64)


def prefixes(docs: DataFrame, windows: DataFrame, shingle: int) -> DataFrame:
    """wid, text, n_words, ``offset`` and ``hash`` of the rarest shingle of every window; windows with a shingle that no document has are gone."""
    grams = cut(window_shingles(windows, shingle))
    distinct = cut(grams.select("hash").distinct())
    counts = cut(shingle_counts(docs, filter_of(distinct), sizes_of(windows, shingle)).join(distinct, "hash", "left_semi"))
    ranked = grams.join(counts, "hash", "left").groupBy("wid").agg(F.min(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "hash", "offset")).alias("rarest"))
    return windows.join(ranked.where("rarest.freq > 0"), "wid").select("wid", "text", "n_words", "rarest.offset", "rarest.hash")


def sizes_of(windows: DataFrame, shingle: int) -> list[int]:
    return sorted(r[0] for r in windows.select(F.least("n_words", F.lit(shingle))).distinct().collect())


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """Per document doc_id, n_words, ``spans`` (start and end of every occurring window, in words), n_hit (words inside any), n_items, the
    digest of its items (items_sha256) and ``met`` (names its set of windows, null without one); and per ``met`` its ``items``, sorted as
    strings."""
    windows, items = windows_of(benchmark, window)
    tokens = cut(prefixes(docs, windows, shingle))
    found = cut(places(docs, filter_of(tokens.select("hash").distinct()), sizes_of(tokens, shingle), window))
    candidates = found.where("pos is not null").select("row", F.col("n_words").alias("n_doc"), "pos", "hash", "before", "around").join(beside(tokens), "hash")
    start = F.col("pos") - F.col("offset")
    fits = (F.col("before") >= F.col("offset")) & (start + F.col("n_words") <= F.col("n_doc"))
    words = F.slice(F.split("around", " "), F.greatest(F.col("before") - F.col("offset"), F.lit(0)) + 1, F.col("n_words"))
    exact = candidates.where(fits).where(F.array_join(words, " ") == F.col("text")).select("row", F.struct(start.alias("start"), (start + F.col("n_words")).alias("end")).alias("span"), "wid")
    each = exact.groupBy("row").agg(F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.collect_set("wid")).alias("wids"))
    hit = F.aggregate(
        "spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")),
        lambda a, s: F.struct((a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["upto"]), F.lit(0))).alias("n"), F.greatest(s["end"], a["upto"]).alias("upto")),
    )["n"]
    each = cut(each.select("row", "spans", hit.alias("n_hit"), "wids", F.sha2(F.array_join(F.col("wids").cast("array<string>"), ","), 256).alias("met")))
    sets = each.groupBy("met").agg(F.first("wids").alias("wids")).select("met", F.explode("wids").alias("wid"))
    listed = cut(sets.join(items, "wid").groupBy("met").agg(F.array_sort(F.collect_set("item")).alias("items")))
    told = listed.select("met", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    # only documents with a window meet the sets; one set may be that of very many
    each = each.drop("wids").join(beside(told), "met")
    facts = found.where("pos is null").select("row", "doc_id", "n_words")
    out = facts.join(each, "row", "left")
    none = F.lit(0).cast("long")
    spans = F.coalesce("spans", F.array().cast(each.schema["spans"].dataType))
    out = out.select("doc_id", "n_words", spans.alias("spans"), F.coalesce("n_hit", none).alias("n_hit"), F.coalesce("n_items", none).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), "met")
    return out, listed
