"""License scans by diagonal voting.

Every rolling word k-gram of a document is joined with the positions that the k-gram has in license templates. A document position minus
a template position is a diagonal, and each shared k-gram votes for its diagonal. Neighbouring diagonals, which words left out or put in
lead to, are merged into one span, and a span counts if it covers enough of its template within a fitting length. Phrases are templates
too; theirs is an exact span: every k-gram on one diagonal.

Words are runs of digits, letters and all beyond ASCII, after A-Z were lower-cased. k-grams meet by their hash and then word by word.
Only the templates are broadcast; their size is checked.

Defined results: null and empty texts have no words; documents without a license have empty labels and null places; rows equal in
``doc_id`` and text answer once; null ``doc_id`` is a value like any other; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K = 3
MAX_TEMPLATE_GRAMS = 100_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases that must stand word by word, and their labels.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]

# Notices of well-known licenses, found also where words differ.
NOTICES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
            "publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
              "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
]


def lower_ascii(text: Column) -> Column:
    """Lower case in which no letter beyond ASCII becomes an ASCII one: the Kelvin sign and the dotted capital I would."""
    return F.lower(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ß")), F.lit("İ"), F.lit("ß")))


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0))


def template_grams(spark, phrases, notices, k: int = K) -> DataFrame:
    """One row per template position: template, label, exact, n_grams, n_template_words, at, gram (words); at most ``MAX_TEMPLATE_GRAMS``."""
    import re

    rows = []
    for t, (label, text, exact) in enumerate([*((a, b, True) for a, b in phrases), *((a, b, False) for a, b in notices)]):
        w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text))
        if len(w) < k:
            raise ValueError(f"a template needs {k} words: {text!r}")
        rows += [(t, label, exact, len(w) - k + 1, len(w), i, w[i : i + k]) for i in range(len(w) - k + 1)]
    if len(rows) > MAX_TEMPLATE_GRAMS:
        raise ValueError(f"{len(rows)} template positions; at most {MAX_TEMPLATE_GRAMS} may be broadcast")
    schema = "template int, label string, exact boolean, n_grams int, n_template_words int, at int, gram array<string>"
    return spark.createDataFrame(rows, schema)


def scan(docs: DataFrame, phrases=PHRASES, notices=NOTICES, k: int = K, gap: int = 3, coverage: float = 0.8) -> DataFrame:
    """doc_id, text_hash, n_words and ``spans``: label, exact, start, end (words from 0) and coverage of every license found."""
    grams = template_grams(docs.sparkSession, phrases, notices, k)
    hash_of = lambda *w: F.xxhash64(*w)
    table = grams.withColumn("h", hash_of(*[F.col("gram")[i] for i in range(k)]))
    # one row of no template meets each document, so that all documents stay and are read once
    every = docs.sparkSession.range(1).select(
        F.lit(-1).alias("template"), F.lit(None).cast("string").alias("label"), F.lit(False).alias("exact"), F.lit(1).alias("n_grams"), F.lit(1).alias("n_template_words"),
        F.lit(0).alias("at"), F.lit(None).cast("array<string>").alias("gram"), F.lit(0).cast("long").alias("h"),
    )
    table = F.broadcast(table.unionByName(every))
    split = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("words"))
    n = F.size("words")
    rolling = F.when(n >= k, F.transform(F.slice("words", 1, F.greatest(n - k + 1, F.lit(0))), lambda w, i: hash_of(w, *[F.get(F.col("words"), i + j) for j in range(1, k)]))).otherwise(F.array().cast("array<bigint>"))
    hashed = split.select("doc_id", "text_hash", "words", n.cast("long").alias("n_words"), F.concat(rolling, F.array(F.lit(0).cast("long"))).alias("hs"))
    # outer: else Spark would test the array for emptiness below the scan and compute it again for that
    each = hashed.select("doc_id", "text_hash", "words", "n_words", F.posexplode_outer("hs").alias("pos", "h"))
    last = F.col("pos") == F.greatest(F.col("n_words") - (k - 1), F.lit(0))
    true_match = F.when(F.col("template") < 0, last).otherwise(~last & (F.slice("words", F.col("pos") + 1, k) == F.col("gram")))
    votes = each.join(table, "h").where(true_match)
    votes = votes.select("doc_id", "text_hash", "n_words", "template", "label", "exact", "n_grams", "n_template_words", "at", "pos", (F.col("pos") - F.col("at")).alias("diagonal"))
    votes = votes.repartition("doc_id", "text_hash")  # the one shuffle: all steps below keep to a document
    facts = ["doc_id", "text_hash", "n_words", "template", "label", "exact", "n_grams", "n_template_words"]
    diagonals = votes.groupBy(*facts, F.when(F.col("template") >= 0, F.col("diagonal")).alias("diagonal")).agg(
        F.collect_set("at").alias("met"), F.min("pos").alias("first"), F.max("pos").alias("last")
    )
    w = Window.partitionBy("doc_id", "text_hash", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(w) > F.when(F.col("exact"), 0).otherwise(gap)
    runs = diagonals.withColumn("new", F.when(apart, 1).otherwise(0)).withColumn("run", F.sum("new").over(w))
    merged = runs.groupBy(*facts, "run").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("met")))).alias("hits"), F.min("first").cast("long").alias("start"), (F.max("last") + k).cast("long").alias("end")
    )
    share = F.col("hits") / F.col("n_grams")
    length = F.col("end") - F.col("start")
    verified = F.when(F.col("exact"), (F.col("hits") == F.col("n_grams")) & (length == F.col("n_template_words"))).otherwise((share >= coverage) & (length <= 1.5 * F.col("n_template_words") + gap))
    span = F.struct("label", "exact", "start", "end", share.alias("coverage"))
    return merged.groupBy("doc_id", "text_hash").agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.collect_list(F.when((F.col("template") >= 0) & verified, span))).alias("spans")
    )
