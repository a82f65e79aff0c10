"""Substring joins as equi-joins.

A text contains a needle only when it contains every gram (short run of bytes) of that needle, so it is enough to meet one of them.
How often each gram of the needles stands in the texts is counted first; a needle is met through its rarest gram, and one with a gram
that no text has is met nowhere. Up to ``MOST_HELD`` needles go to the texts: a text meets them where it stands and is verified there, so
neither texts nor candidates are shuffled. More needles meet the texts' keys: texts then offer the grams so chosen, candidates are
verified after a join, and grams that many texts have are cut into counted parts, each with its own copy of the needles met there.

A gram is a number: its size and its bytes. A table of fixed size tells which ones may be a needle's, so texts offer few others. It
errs on one side only, and the equi-join leaves out the rest. The plan is the same for one needle and for many thousands.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegraph_spark.plans.lineage import cut

# workers get this module with the task and need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NAME_GRAMS = (1, 3)
LINE_GRAMS = (1, 2, 5)
SPLIT_AT = 100_000  # texts of a gram in one part
MOST_SPLIT = 10_000  # grams that may be cut into parts
MOST_HELD = 100_000  # needles that every task may hold
PLACES = 22  # bits of a place in the table of needle grams
SLICE = 1 << 19  # bytes of text that are cut into grams at once


def _places(gram: np.ndarray) -> np.ndarray:
    return (gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PLACES)


def _slices(texts: pa.Array):
    """(first row, bytes, starts and ends of the rows) of runs of rows; a row longer than a slice is a run of its own."""
    at = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(at, at[row] + SLICE, "right")) - 1)
        yield row, data[at[row] : at[end]], at[row:end] - at[row], at[row + 1 : end + 1] - at[row]
        row = end


def _grams(data: np.ndarray, start: np.ndarray, end: np.ndarray, size: int, wanted: np.ndarray | None):
    """(row, gram) of the distinct grams of each row; with ``wanted`` those that may be a needle's."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gram = np.full(n, size, np.int64)
    for k in range(size):
        gram = (gram << 8) | data[k : n + k]
    inside = np.zeros(n + 1, np.int32)  # a gram lies in one row
    np.add.at(inside, np.minimum(start, n), 1)
    np.add.at(inside, np.minimum(np.maximum(end - size + 1, start), n), -1)
    keep = np.cumsum(inside[:-1]) > 0
    if wanted is not None:
        keep &= wanted[_places(gram)]
    spot = np.flatnonzero(keep)
    gram, row = gram[spot], np.searchsorted(end, spot, "right")
    order = np.lexsort((gram, row))
    gram, row = gram[order], row[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
    return row[first], gram[first]


def text_grams(texts: DataFrame, text: str, keys, sizes, wanted=None) -> DataFrame:
    """``keys`` and ``_gram`` of every distinct gram of each text; ``wanted`` is a broadcast table of needle grams."""
    def of(batches):
        table = None if wanted is None else np.unpackbits(wanted.value).astype(bool)
        for batch in batches:
            col = batch.column(len(keys)).cast(pa.string()).fill_null("")
            for row, data, start, end in _slices(col):
                for size in sizes:
                    at, gram = _grams(data, start, end, size, table)
                    if len(at):
                        yield pa.RecordBatch.from_arrays([*batch.select(list(range(len(keys)))).take(pa.array(at + row)).columns, pa.array(gram)], [*keys, "_gram"])

    rows = texts.select(*keys, text)
    return rows.mapInArrow(of, rows.select(*keys, F.lit(0).cast("long").alias("_gram")).schema)


def text_lists(texts: DataFrame, text: str, sizes, wanted) -> DataFrame:
    """The rows of ``texts`` that have grams of the table ``wanted``, with the distinct ones as ``_grams``."""
    columns, place = texts.columns, texts.columns.index(text)

    def of(batches):
        table = np.unpackbits(wanted.value).astype(bool)
        for batch in batches:
            col = batch.column(place).cast(pa.string()).fill_null("")
            for row, data, start, end in _slices(col):
                found = [_grams(data, start, end, size, table) for size in sizes]
                at, gram = (np.concatenate(c) for c in zip(*found, strict=True))
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                rows, first = np.unique(at[order], return_index=True)
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)).astype(np.int32)), pa.array(gram[order]))
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows + row)).columns, lists], [*columns, "_grams"])

    return texts.mapInArrow(of, texts.withColumn("_grams", F.lit(None).cast("array<long>")).schema)


def needle_grams(needles: DataFrame, needle: str, keys, sizes) -> DataFrame:
    """``keys``, the needle and ``_gram``: the distinct grams of each needle, of the largest size that fits it."""
    sizes = sorted(sizes)
    out = None
    for size, more in zip(sizes, [*sizes[1:], None], strict=True):
        n = F.octet_length(needle)
        fits = (n >= size if size > sizes[0] else n > 0) & (F.lit(True) if more is None else n < more)
        part = text_grams(needles.filter(fits).withColumn("_text", F.col(needle)), "_text", [*keys, needle], [size])
        out = part if out is None else out.unionByName(part)
    return out


def gram_table(asked: DataFrame):
    """Broadcast bits of the places of the grams of ``asked``; as large for any number of them."""
    def of(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_places(batch.column(0).to_numpy())).astype(np.int64))], ["p"])

    got = asked.select("_gram").mapInArrow(of, "p long").distinct().toArrow().column("p").to_numpy()
    bits = np.zeros(1 << PLACES, bool)
    bits[got] = True
    return asked.sparkSession.sparkContext.broadcast(np.packbits(bits))


def rarest_grams(offered: DataFrame, asked: DataFrame, on) -> DataFrame:
    """(needle, gram, parts): the gram by which to meet each needle of ``asked``, by its count among the ``offered`` ones."""
    by = [*on, "_gram"]
    counts = cut(offered.join(asked.select(*by).distinct(), by, "left_semi").groupBy(*by).agg(F.count(F.lit(1)).alias("_n")))
    limit = max(SPLIT_AT, math.ceil((counts.agg(F.sum("_n")).first()[0] or 0) / MOST_SPLIT))
    least = F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("gram"))).alias("_least")
    best = asked.join(counts, by, "left").groupBy(*on, "_needle").agg(least).filter("_least.n > 0")
    return best.select(*on, "_needle", F.col("_least.gram").alias("_gram"), F.ceil(F.col("_least.n") / limit).cast("int").alias("_parts"))


def contains_join(
    texts: DataFrame,
    text: str,
    needles: DataFrame,
    needle: str,
    key,
    sizes=NAME_GRAMS,
    on=(),
    ignore_case: bool = True,
    repeated: bool = True,
) -> DataFrame:
    """Rows of ``texts`` joined with every needle that occurs in their ``text``.

    ``key`` names the columns that identify a text; ``on`` adds equi-join columns both sides share.  Blank needles match nothing.  With
    ``repeated``, texts are short and recur, like names: each distinct one is looked at once, and its rows join the answer.
    """
    fold = F.lower if ignore_case else (lambda c: c)
    folded = needles.filter(F.length(F.col(needle)) > 0).withColumn("_needle", fold(F.col(needle)))
    hay = fold(F.col(text))
    asked = folded.select(*on, "_needle").distinct()
    longest = max(sizes)
    lengths = {r[0] for r in asked.select(F.least(F.octet_length("_needle"), F.lit(longest)).alias("n")).distinct().collect()}
    used = sorted({max(s for s in sizes if s <= n) for n in lengths}) or [min(sizes)]
    asked = cut(needle_grams(cut(asked), "_needle", list(on), used))
    shared = [*on, "_folded"] if repeated else [*key, *[c for c in on if c not in key]]
    values = texts.select(*on, hay.alias("_folded")).distinct() if repeated else texts.select(*shared, hay.alias("_folded"))
    if repeated:
        values = cut(values)
    offered = text_grams(values.withColumn("_text", F.col("_folded")) if repeated else values, "_text" if repeated else "_folded", shared, used, gram_table(asked))
    chosen = cut(rarest_grams(offered, asked, on))
    held = chosen.join(folded, [*on, "_needle"]).drop("_parts")
    if held.count() <= MOST_HELD:
        rows = values if repeated else texts.withColumn("_folded", hay)
        met = text_lists(rows, "_folded", used, gram_table(chosen)).withColumn("_gram", F.explode("_grams")).drop("_grams")
        sought = F.broadcast(chosen.select(*on, "_needle", "_gram") if repeated else held)
        hits = met.join(sought, [*on, "_gram"]).drop("_gram").filter(F.contains("_folded", F.col("_needle")))
        if not repeated:
            return hits.drop("_folded", "_needle")
        hits = texts.withColumn("_folded", hay).join(hits.select(*shared, "_needle"), shared)
        return hits.drop("_folded").join(F.broadcast(folded), [*on, "_needle"]).drop("_needle")
    split = F.broadcast(chosen.filter("_parts > 1").select(*on, "_gram", "_parts").distinct())  # at most MOST_SPLIT
    part = F.coalesce(F.pmod(F.xxhash64(*shared), F.col("_parts")), F.lit(0)).alias("_part")
    met = offered.join(split, [*on, "_gram"], "left").select(*shared, "_gram", part)
    sought = chosen.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    pairs = met.join(sought, [*on, "_gram", "_part"])
    if repeated:
        pairs = pairs.filter(F.contains("_folded", F.col("_needle"))).select(*shared, "_needle")
        hits = texts.withColumn("_folded", hay).join(pairs, shared).drop("_folded")
    else:
        hits = texts.join(pairs.select(*shared, "_needle"), shared).filter(F.contains(hay, F.col("_needle")))
    return hits.join(folded, [*on, "_needle"]).drop("_needle")
