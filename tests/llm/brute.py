"""Plain versions of the operators, one document at a time."""

import hashlib
import re
from collections import Counter

import numpy as np
import xxhash

TEXTS = [
    None, "", "   \n ", "a", "\x00\x1c", "Das ist ein Haus und die Katze ist in dem Garten.", "The cat is in the house and the dog is in the garden.",
    "the end\nthe end\nthe end\n\nthe  end", "x#*$ %& |<> y", "Released under the MIT License.", "released UNDER the, mit-license!! under the MIT license",
    "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0. cc by nc cc by nc", "under the mit licenKe apache license version 2",
    "This work is licensed under the big GNU General Public License, version 3.", "ÉCOLE é́ﬁ ΑΣ Σ 漢字 🎉 ١٢ ²", "<|endoftext|>it's we'll 'tis <|startoftext|>",
    "word " * 400, "one two three four five six " * 30, "z" * 3000, "line with five tokens here 12\n" * 3, "a b c a b c a b",
]


def base_licenses(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    found = []
    for label, phrase in (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")):
        p = phrase.split()
        found += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    starts = [i for i, _ in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def quality_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if windows[x] > 1 for k in range(3)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered), failed


def fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints, bits):
    """Least index reachable over links of at most ``bits`` bits."""
    prints = np.array(prints, np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= bits
    label = np.arange(len(prints))
    while True:
        new = np.where(near, label[None, :], len(prints)).min(axis=1)
        if (new == label).all():
            return label
        label = new


def copies(texts, k=5, similarity=0.8):
    """Least index reachable over links of enough Jaccard similarity, and how many links differ in over four bits of SimHash."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    label, far = list(range(len(texts))), 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 10 * len(a & b) >= round(10 * similarity) * len(a | b):
                far += (fingerprint(texts[i]) ^ fingerprint(texts[j])).bit_count() > 4
                lo, hi = sorted((label[i], label[j]))
                label = [lo if x == hi else x for x in label]
    return label, far


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")).hexdigest()


def water_fill(children, budget):
    """children: {name: (weight, supply)} to {name: budget}, by filling step after step."""
    got, open_ = dict.fromkeys(children, 0.0), {n for n, (w, s) in children.items() if w > 0 and s > 0}
    left = budget
    while open_ and left > 1e-9:
        total = sum(children[n][0] for n in open_)
        step = min(min((children[n][1] - got[n]) / children[n][0] for n in open_), left / total)
        for n in open_:
            got[n] += step * children[n][0]
        left -= step * total
        open_ = {n for n in open_ if children[n][1] - got[n] > 1e-9}
    return got
