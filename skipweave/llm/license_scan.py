"""License scans by diagonal voting over word k-grams, in DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skipweave.llm.common import full_text, numbered, ROW

# The phrases and their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

# Passages of public license notices, and their labels.
NOTICES = [
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies",
        "mit-text",
    ),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "apache-notice",
    ),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "gpl-notice",
    ),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "bsd-text",
    ),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc-text"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-notice"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-notice"),
]

#: Words of a k-gram: pairs for phrases (which have two words at least), four for notices.
PHRASE_K, NOTICE_K = 2, 4
#: Diagonals this far apart are neighbours: a word or two put in or left out.
SLACK = 3
#: The share of a notice's k-grams that its merged diagonals must hold.
COVERED = 0.6
_SPLIT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def template_grams(spark: SparkSession, phrases=tuple(PHRASES), notices=tuple(NOTICES)) -> DataFrame:
    """gram, template, at, k, grams, label, base: a few hundred rows, as many as the given templates have words."""
    rows = []
    for base, k, group in ((True, PHRASE_K, phrases), (False, NOTICE_K, notices)):
        for text, label in group:
            words = _WORD.findall(text)
            if len(words) < k:
                raise ValueError(f"a template of under {k} words: {text!r}")
            n = len(words) - k + 1
            rows += [(f"{'p' if base else 'n'}:{text}", at, k, n, label, base, words[at : at + k]) for at in range(n)]
    frame = spark.createDataFrame(rows, "template string, at int, k int, grams int, label string, base boolean, words array<string>")
    get = lambda i: F.get("words", F.lit(i))
    gram = F.when(F.col("k") == PHRASE_K, F.xxhash64(*map(get, range(PHRASE_K)))).otherwise(F.xxhash64(*map(get, range(NOTICE_K))))
    return frame.select(gram.alias("gram"), "template", "at", "k", "grams", "label", "base", "words")


def _matching(k: int, grams: list[int]):
    """Where a rolling k-gram's hash is one of grams: the place, the hash and the words there."""
    n = F.col("__n")
    steps = F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))
    gram = lambda i: F.xxhash64(*(F.get("__words", i + j) for j in range(k)))
    return F.transform(F.filter(steps, lambda i: gram(i).isin(grams)), lambda i: F.struct(i.alias("p"), F.lit(k).alias("k"), gram(i).alias("gram"), F.slice("__words", i + 1, k).alias("held")))


def license_scan(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=tuple(PHRASES), notices=tuple(NOTICES), covered: float = COVERED) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are runs of digits, ASCII letters (lower-cased) and non-ASCII characters. Each place where a phrase's words stand
    in a row counts, overlaps too. Labels of notices come from merged diagonals that hold the share `covered` of a
    notice's k-grams; score is 1 with a phrase, else the best such share, else 0. Null and empty texts have no words; no
    phrase gives null places, empty labels. Repeated rows are scanned each on its own; an empty table gives no rows;
    other columns play no part.

    Every rolling k-gram of every text is hashed; hashes that no template has go at once, and the rest meet the template positions in one
    broadcast join (the templates are code, of a fixed size), with the few words at their place, which are compared with the template's before they vote. So
    the work is linear in a text's length. Only verified hits are shuffled, with one row for each document that carries its word count.
    """
    templates = template_grams(spark, phrases, notices)
    known = {k: [r.gram for r in templates.filter(F.col("k") == k).select("gram").distinct().collect()] for k in (PHRASE_K, NOTICE_K)}  # of the templates alone
    mark = F.lit(0).cast("long")  # stands for the document itself, so that one without hits has a row too
    own = spark.createDataFrame([("", -1, 0, 0, "", False, [])], "template string, at int, k int, grams int, label string, base boolean, words array<string>")
    templates = templates.unionByName(own.select(mark.alias("gram"), "*"))

    # the Kelvin sign is the one non-ASCII character that lower() turns into an ASCII letter alone
    text = F.regexp_replace(F.replace(full_text(docs, text_col), F.lit("\u212a"), F.lit("\ufffd")), _SPLIT, " ")
    worded = numbered(docs.select(F.col(id_col).alias("doc_id"), text.alias("__text")))
    worded = worded.withColumn("__low", F.lower(F.btrim("__text")))
    worded = worded.withColumn("__words", F.when(F.col("__low") == "", F.array().cast("array<string>")).otherwise(F.split("__low", " "))).withColumn("__n", F.size("__words"))
    itself = F.array(F.struct(F.lit(-1).alias("p"), F.lit(0).alias("k"), mark.alias("gram"), F.array().cast("array<string>").alias("held")))
    grams = worded.select("doc_id", ROW, F.col("__n").alias("n"), F.explode(F.concat(itself, _matching(PHRASE_K, known[PHRASE_K]), _matching(NOTICE_K, known[NOTICE_K]))).alias("g"))
    grams = grams.select("doc_id", ROW, "n", "g.*")
    # a hash only points to a place: the words there have to be the template's, so that every vote is a verified one
    hits = grams.join(F.broadcast(templates.withColumnRenamed("k", "of")), "gram").filter((F.col("k") == F.col("of")) & (F.col("held") == F.col("words")))
    hits = hits.select("doc_id", ROW, "n", "template", "grams", "label", "base", "at", (F.col("p") - F.col("at")).alias("diagonal"))

    votes = hits.groupBy("doc_id", ROW, "n", "template", "grams", "label", "base", "diagonal").agg(F.count("*").alias("votes"), F.collect_set("at").alias("ats"))
    of = Window.partitionBy("doc_id", ROW, "n", "template").orderBy("diagonal")
    votes = votes.withColumn("cut", (F.col("diagonal") - F.lag("diagonal").over(of) > SLACK).cast("int"))
    votes = votes.withColumn("span", F.sum(F.coalesce("cut", F.lit(0))).over(of))
    spans = votes.groupBy("doc_id", ROW, "n", "template", "grams", "label", "base", "span").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("held"),
        F.collect_list(F.when(F.col("votes") == F.col("grams"), F.col("diagonal"))).alias("whole"),
    )
    phrase, share = F.col("base") & (F.size("whole") > 0), F.col("held") / F.col("grams")
    notice = ~F.col("base") & (F.col("template") != "") & (share >= covered)
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    out = spans.groupBy("doc_id", ROW, "n").agg(
        F.sum(F.when(phrase, F.size("whole")).otherwise(0)).cast("long").alias("n_base"),
        F.min(F.when(phrase, F.array_min("whole"))).cast("long").alias("first_word"),
        F.max(F.when(phrase, F.array_max("whole"))).cast("long").alias("last_word"),
        joined(F.when(phrase, F.col("label"))).alias("base_labels"),
        joined(F.when(phrase | notice, F.col("label"))).alias("labels"),
        F.max(F.when(phrase, F.lit(1.0)).when(notice, share).otherwise(0.0)).alias("score"),
    )
    return out.select("doc_id", F.col("n").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
