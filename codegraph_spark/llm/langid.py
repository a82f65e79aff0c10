"""Language identification of mixed-language text.

Words are maximal runs of letters. The script of a word (code point ranges) narrows the languages it may belong to, hashed letter
n-grams score the word under each of those, and a Viterbi pass with a switching penalty labels the words, so a text becomes spans of
one language each. A document's language is the one that holds most of its letters.

Training counts features on a sample of labelled rows whose expected size per language is bounded; prediction reads whole texts.

Defined results: null texts and texts without letters are ``und`` with score 0 and no spans; ties go to the alphabetically first
language; letters of a script that no training text used carry no evidence; without any labelled text everything is ``und``;
repeated rows are labelled alike; other columns pass through untouched.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codegraph_spark.llm.batches import ragged, text_slices

UNKNOWN = "und"
BUCKETS = 1 << 17  # hashed features of a model
DOCS_PER_LANGUAGE = 2000  # expected number of training documents of a language, at most
SWITCH_PENALTY = 14.0  # in nats
SCRIPT_SHARE = 0.001  # a language may use a script that holds this share of its training words
PIECE = 1 << 18  # code points of text whose features are held at once
TRAINING_PIECE = 1 << 18  # the same while features are counted
BLOCK = 64  # words of a Viterbi block
IMPOSSIBLE = np.float32(-60.0)

# Code point ranges of the scripts, first and last.
SCRIPT_RANGES = [
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("latin", 0x2C60, 0x2C7F), ("latin", 0xA720, 0xA7FF), ("latin", 0xFF21, 0xFF5A),
    ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x0400, 0x052F), ("cyrillic", 0x1C80, 0x1C8F), ("cyrillic", 0x2DE0, 0x2DFF), ("cyrillic", 0xA640, 0xA69F),
    ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF), ("arabic", 0x0750, 0x077F), ("arabic", 0x08A0, 0x08FF),
    ("arabic", 0xFB50, 0xFDFF), ("arabic", 0xFE70, 0xFEFF), ("syriac", 0x0700, 0x074F), ("thaana", 0x0780, 0x07BF),
    ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F), ("gujarati", 0x0A80, 0x0AFF), ("oriya", 0x0B00, 0x0B7F),
    ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F), ("kannada", 0x0C80, 0x0CFF), ("malayalam", 0x0D00, 0x0D7F), ("sinhala", 0x0D80, 0x0DFF),
    ("thai", 0x0E00, 0x0E7F), ("lao", 0x0E80, 0x0EFF), ("tibetan", 0x0F00, 0x0FFF), ("myanmar", 0x1000, 0x109F), ("georgian", 0x10A0, 0x10FF),
    ("ethiopic", 0x1200, 0x139F), ("cherokee", 0x13A0, 0x13FF), ("khmer", 0x1780, 0x17FF), ("mongolian", 0x1800, 0x18AF),
    ("hangul", 0x1100, 0x11FF), ("hangul", 0x3130, 0x318F), ("hangul", 0xAC00, 0xD7FF),
    ("kana", 0x3040, 0x30FF), ("kana", 0x31F0, 0x31FF), ("kana", 0xFF66, 0xFF9F),
    ("han", 0x2E80, 0x2FDF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("han", 0xF900, 0xFAFF), ("han", 0x20000, 0x3FFFF),
]
SCRIPTS = ["other", *dict.fromkeys(name for name, _, _ in SCRIPT_RANGES)]


@dataclass
class Model:
    """``weights[l, b]``: log-probability of feature ``b`` in language ``l``; ``allowed[s, l]``: whether ``l`` uses script ``s``."""

    languages: list[str]
    weights: np.ndarray
    allowed: np.ndarray


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: is it a letter, its lower case form (where that is one code point), its script."""
    n = 0x110000
    letter = np.fromiter((chr(i).isalpha() for i in range(n)), bool, n)
    lower = np.fromiter((ord(x) if len(x := chr(i).lower()) == 1 else i for i in range(n)), np.uint32, n)
    script = np.zeros(n, np.uint8)
    for name, first, last in SCRIPT_RANGES:
        script[first : last + 1] = SCRIPTS.index(name)
    return letter, lower, script


def _mix(h: np.ndarray) -> np.ndarray:
    """Feature hash to bucket."""
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32)


@dataclass
class Words:
    """The words of some texts: document, first position in it, length, script, and buckets of their features by position."""

    doc: np.ndarray
    begin: np.ndarray
    length: np.ndarray
    script: np.ndarray
    edges: np.ndarray  # positions of word k: edges[2k] .. edges[2k + 1] - 1
    grams: list[np.ndarray]
    whole: np.ndarray


def words_of(texts: list[str | None]) -> Words:
    letter, lower, script = _tables()
    joined = "\n".join([t or "" for t in texts]) + "\n\n"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letter[code]
    before = np.empty_like(is_letter)
    before[0], before[1:] = False, is_letter[:-1]
    first = np.flatnonzero(is_letter & ~before)
    end = np.flatnonzero(before & ~is_letter)
    sizes = np.fromiter((len(t or "") + 1 for t in texts), np.int64, len(texts))
    offsets = np.cumsum(sizes) - sizes
    doc = np.searchsorted(offsets, first, "right") - 1
    c = np.where(is_letter, lower[code], 0).astype(np.uint64)
    c1 = np.zeros_like(c)
    c1[1:] = c[:-1]
    c2 = np.zeros_like(c)
    c2[2:] = c[:-2]
    c2[c1 == 0] = 0
    pair = (c1 << np.uint64(21)) | c
    grams = [_mix(pair + np.uint64(1 << 60)), _mix((c2 << np.uint64(42)) | pair)]
    edges = np.empty(2 * len(first), np.int64)
    edges[0::2], edges[1::2] = first, end + 1
    if len(first):
        # a word as a polynomial of its letters: powers from the text's start, brought down to the word's start
        power = np.full(len(c), 0x100000001B3, np.uint64)
        power[0] = 1
        power = np.cumprod(power, dtype=np.uint64)
        down = np.full(len(c), pow(0x100000001B3, -1, 1 << 64), np.uint64)
        down[0] = 1
        down = np.cumprod(down, dtype=np.uint64)
        whole = _mix(np.add.reduceat(c * power, edges)[0::2] * down[first] + np.uint64(2 << 60))
    else:
        whole = np.zeros(0, np.int32)
    return Words(doc, first - offsets[doc], end - first, script[code[first]], edges, grams, whole)


def word_scores(w: Words, model: Model) -> np.ndarray:
    """Log-likelihood of every word under every language; languages that do not use its script are out of reach."""
    out = np.empty((len(w.doc), len(model.languages)), np.float32)
    for i in range(len(model.languages)):
        table = model.weights[i]
        out[:, i] = np.add.reduceat(table[w.grams[0]] + table[w.grams[1]], w.edges)[0::2] + table[w.whole]
    out -= out.max(axis=1, keepdims=True)
    allowed = model.allowed[w.script]
    known = allowed.any(axis=1)
    out[known & ~allowed.all(axis=1)] += np.where(allowed[known & ~allowed.all(axis=1)], 0, IMPOSSIBLE)
    out[~known] = 0
    return out


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """Best label sequence of several word sequences laid end to end.

    Sequences are cut into blocks. The best score between every entry and exit label of a block is found for all blocks in step, blocks
    are chained per sequence, and the labels inside a block follow from its entry and exit.
    """
    n_labels = scores.shape[1]
    kind = np.int8 if n_labels <= 127 else np.int32
    block = max(BLOCK, n_labels)  # longer with more labels: the tables of a block are then no larger than its scores
    lengths = lengths[lengths > 0]
    if not len(scores):
        return np.zeros(0, kind)
    n_blocks = -(-lengths // block)
    first_block = np.cumsum(n_blocks) - n_blocks
    starts = np.cumsum(lengths) - lengths
    at = np.arange(len(scores)) + np.repeat(first_block * block - starts, lengths)
    padded = np.zeros((int(n_blocks.sum()) * block, n_labels), np.float32)
    padded[at] = scores
    steps = padded.reshape(-1, block, n_labels)
    through = np.full((len(steps), n_labels, n_labels), -1e9, np.float32)
    through[:, np.arange(n_labels), np.arange(n_labels)] = 0
    for t in range(block):
        through = np.maximum(through, through.max(axis=2, keepdims=True) - np.float32(penalty)) + steps[:, t, None, :]

    order = np.argsort(-n_blocks, kind="stable")
    longest = n_blocks[order]
    value = np.zeros((len(order), n_labels), np.float32)
    entry = np.zeros((len(steps), n_labels), kind)
    for k in range(int(longest[0])):
        live = int(np.searchsorted(-longest, -k, "left"))
        b = first_block[order[:live]] + k
        total = value[:live, :, None] + through[b]
        entry[b] = total.argmax(axis=1)
        value[:live] = total.max(axis=1)
        value[:live] -= value[:live].max(axis=1, keepdims=True)
    leave = np.zeros(len(steps), kind)
    enter = np.zeros(len(steps), kind)
    state = value.argmax(axis=1).astype(kind)
    for k in range(int(longest[0]) - 1, -1, -1):
        live = int(np.searchsorted(-longest, -k, "left"))
        b = first_block[order[:live]] + k
        leave[b] = state[:live]
        state[:live] = entry[b, state[:live]]
        enter[b] = state[:live]

    rows = np.arange(len(steps))
    v = np.full((len(steps), n_labels), -1e9, np.float32)
    v[rows, enter] = 0
    came = np.empty((block, len(steps), n_labels), kind)
    for t in range(block):
        best = v.argmax(axis=1)
        switched = v[rows, best][:, None] - np.float32(penalty)
        came[t] = np.where(switched > v, best[:, None], np.arange(n_labels))
        v = np.maximum(v, switched) + steps[:, t]
    labels = np.empty((len(steps), block), kind)
    now = leave
    for t in range(block - 1, -1, -1):
        labels[:, t] = now
        now = came[t, rows, now]
    return labels.reshape(-1)[at]


def _count_features(languages: list[str]):
    """Partial feature counts of a partition: (language, bucket, n); script counts follow the buckets."""

    def count(batches):
        total = np.zeros((len(languages), BUCKETS + len(SCRIPTS)), np.int64)
        index = {name: i for i, name in enumerate(languages)}
        for part, texts in text_slices(batches):
            langs = np.array([index[x] for x in part.column("lang").to_pylist()])
            for group in _pieces(texts, TRAINING_PIECE):
                w = words_of([piece for _, _, piece in group])
                if not len(w.doc):
                    continue
                lang_of = langs[[d for d, _, _ in group]][w.doc]
                spot = ragged(w.edges[0::2], w.edges[1::2] - w.edges[0::2])
                of = np.repeat(lang_of, w.edges[1::2] - w.edges[0::2])
                for i in range(len(languages)):
                    at = spot[of == i]
                    mine = lang_of == i
                    for buckets in (w.grams[0][at], w.grams[1][at], w.whole[mine]):
                        total[i, :BUCKETS] += np.bincount(buckets, minlength=BUCKETS)
                    total[i, BUCKETS:] += np.bincount(w.script[mine], minlength=len(SCRIPTS))
        lang, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[lang, bucket])], ["l", "b", "n"])

    return count


def train(docs: DataFrame, usable: Column | None = None, docs_per_language: int = DOCS_PER_LANGUAGE) -> Model:
    """Fit a model on ``text`` and ``lang`` of a sample of the rows where ``usable`` holds.

    The sample keeps a row by a hash of its text, with the chance that brings ``docs_per_language`` rows of each language in the mean
    (all, where there are fewer). Gathered on the driver: one count per language and per (language, bucket).
    """
    rows = docs.where((usable if usable is not None else F.lit(True)) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, BUCKETS), np.float32), np.zeros((len(SCRIPTS), 0), bool))
    chance = F.create_map(*[x for name in languages for x in (F.lit(name), F.lit(min(1.0, docs_per_language / sizes[name])))])
    unit = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.where(unit < chance[F.col("lang")]).select("text", "lang")
    parts = sample.mapInArrow(_count_features(languages), "l int, b int, n long")
    counts = np.zeros((len(languages), BUCKETS + len(SCRIPTS)))
    for part in parts.groupBy("l", "b").agg(F.sum("n").alias("n")).toPandas().itertuples():
        counts[part.l, part.b] = part.n
    features, scripts = counts[:, :BUCKETS], counts[:, BUCKETS:]
    weights = np.log((features + 0.2) / (features.sum(axis=1, keepdims=True) + 0.2 * BUCKETS))
    shares = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    return Model(languages, weights.astype(np.float32), (shares >= SCRIPT_SHARE).T.copy())


def _pieces(texts: list[str | None], piece: int = PIECE):
    """Groups of (document, offset, piece) of about ``piece`` code points; longer texts are cut between words where a word allows it."""
    group, held = [], 0
    for d, text in enumerate(texts):
        at, text = 0, text or ""
        while at < len(text):
            end = min(len(text), at + piece)
            if end < len(text):
                cut = end
                while cut > at and (text[cut - 1].isalpha() and text[cut].isalpha()):
                    cut -= 1
                end = cut if cut > at else end
            if held + end - at > piece and group:
                yield group
                group, held = [], 0
            group.append((d, at, text[at:end]))
            held += end - at
            at = end
    if group:
        yield group


def scored_words(texts: list[str | None], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, begin, length and scores of all words; memory beside the result is that of one piece."""
    parts = []
    for group in _pieces(texts):
        w = words_of([piece for _, _, piece in group])
        if len(w.doc):
            doc, offset = (np.array(x, np.int64) for x in zip(*[(d, o) for d, o, _ in group], strict=True))
            parts.append((doc[w.doc], w.begin + offset[w.doc], w.length, word_scores(w, model)))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros((0, len(model.languages)), np.float32)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def label_texts(texts: list[str | None], model: Model, penalty: float = SWITCH_PENALTY) -> tuple[list, list, list]:
    """Languages, scores (share of the letters) and spans (start, end in code points, language) of some texts."""
    langs: list = [UNKNOWN] * len(texts)
    scores: list = [0.0] * len(texts)
    spans: list = [[] for _ in texts]
    if not model.languages:
        return langs, scores, spans
    doc, begin, length, likelihood = scored_words(texts, model)
    if not len(doc):
        return langs, scores, spans
    labels = viterbi(likelihood, np.bincount(doc, minlength=len(texts)), penalty)
    letters = np.zeros((len(texts), len(model.languages)), np.int64)
    np.add.at(letters, (doc, labels), length)
    total, best = letters.sum(axis=1), letters.argmax(axis=1)
    share = letters[np.arange(len(texts)), best] / np.maximum(total, 1)
    for d in np.flatnonzero(total):
        langs[d], scores[d] = model.languages[best[d]], float(share[d])
    new = np.ones(len(labels), bool)
    new[1:] = (labels[1:] != labels[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(labels)) - 1
    for d, a, b, i in zip(doc[first].tolist(), begin[first].tolist(), (begin[last] + length[last]).tolist(), labels[first].tolist(), strict=True):
        spans[d].append({"start": a, "end": b, "lang": model.languages[i]})
    return langs, scores, spans


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())]))
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))


def identify(docs: DataFrame, model: Model, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """Columns ``row`` (the input row as a struct), ``lang_pred``, ``score`` and ``spans``. The text column is ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches):
        for part, texts in text_slices(batches, "row", max_bytes=1 << 20):
            langs, scores, spans = label_texts(texts, shared.value, penalty)
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, _ARROW_SPANS)], ["row", "lang_pred", "score", "spans"]
            )

    rows = docs.select(F.struct("*").alias("row"))
    schema = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", SPANS)])
    return rows.mapInArrow(label, schema)


def keep_identified(docs: DataFrame, min_share: float = 0.0) -> DataFrame:
    """The documents in which a language was found, with the columns of ``docs``; mixed ones stay, by their main language.

    ``min_share`` is the least share of the letters that the main language must hold. A table without labels teaches no language; then
    nothing can be told and all of it stays.
    """
    model = train(docs)
    if not model.languages:
        return docs
    return identify(docs, model).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_share)).select("row.*")
