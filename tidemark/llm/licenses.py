"""License scans by diagonal voting over word k-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import free, plain_words, written

#: Words in a k-gram; the shortest template has as many.
K = 2
#: Share of a long template's k-grams that a span must vote for.
COVER = 0.7
#: Words added or left out in a span, at most: its diagonals lie in a band of this width.
DRIFT = 6

# The phrases and labels of the base, whose words must stand consecutively.
BASE = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)
# Further notices, matched with gaps if they are long.
NOTICES = (
    ("mit license", "mit"),
    ("apache license version 2 0", "apache-2.0"),
    ("bsd license", "bsd"),
    ("mozilla public license", "mpl"),
    ("creative commons attribution", "cc-by"),
    ("creative commons zero", "cc0"),
    ("cc0 1 0 universal", "cc0"),
    ("public domain", "public-domain"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this "
        "software and associated documentation files",
        "mit",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are "
        "permitted provided that the following conditions are met",
        "bsd",
    ),
    (
        "you may not use this file except in compliance with the license you may obtain a copy "
        "of the license at",
        "apache-2.0",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms "
        "of the gnu general public license",
        "gpl",
    ),
)


def templates(spark: SparkSession, notices=NOTICES) -> DataFrame:
    """(template, label, base, length, place, gram): every k-gram of every template.

    The templates are written in this module (or passed as such a list), which
    bounds their number.
    """
    rows = []
    for number, (phrase, label) in enumerate([*BASE, *notices]):
        words = phrase.split()
        if len(words) < K:
            raise ValueError(f"{phrase!r} has fewer than {K} words")
        for place in range(len(words) - K + 1):
            gram = " ".join(words[place : place + K])
            rows.append((number, label, number < len(BASE), len(words), place, gram))
    return spark.createDataFrame(
        rows, "template int, label string, base boolean, length int, place int, gram string"
    )


def spans(docs: DataFrame, keys: list[str], text: str = "text", notices=NOTICES) -> DataFrame:
    """(keys, template, label, base, first, last, votes, cover): verified license spans.

    `first` and `last` are places of words, counted from 0, both included. All
    rolling k-gram hashes of all words are joined to the template positions; the
    words themselves then decide, so a hash that agrees by chance is no vote. Votes
    are added by diagonal (place in the text less place in the template). A
    diagonal with a vote for every k-gram is the phrase standing there in full. For
    templates of over eight words, neighbouring diagonals are merged in bands of DRIFT, which
    bounds how far a span may drift as a whole, and a band is kept if COVER of the template's
    k-grams stand in it: a k-gram that the text repeats is one place of the template and
    counts once. Bands that overlap are one span, with the best band's ends and cover.
    """
    marks = templates(docs.sparkSession, notices)
    # at most one row for each k-gram of the lists above
    marks = F.broadcast(marks.withColumn("hash", F.xxhash64("gram")))
    words = docs.select(*keys, plain_words(F.col(f"`{text}`")).alias("_words"))
    grams = F.transform(
        F.slice("_words", F.lit(1), F.greatest(F.size("_words") - (K - 1), F.lit(0))),
        lambda w, i: F.xxhash64(
            F.concat_ws(" ", w, *[F.get(F.col("_words"), i + j) for j in range(1, K)])
        ),
    )
    rolled = words.select(*keys, "_words", F.posexplode(grams).alias("_at", "_hash"))
    votes = (
        rolled.join(marks, F.col("_hash") == marks["hash"])
        .where(F.array_join(F.slice("_words", F.col("_at") + 1, F.lit(K)), " ") == F.col("gram"))
        .select(
            *keys, "template", "label", "base", "length", "place",
            (F.col("_at") - F.col("place")).alias("diagonal"),
        )
    )
    # few beside the k-grams they come from, and read twice below
    votes = written(votes, "license-votes")
    long_one = F.col("length") > 8
    diagonals = votes.groupBy(*keys, "template", "label", "base", "length", "diagonal").agg(
        # at most one place for each word of the template
        F.collect_set("place").alias("places"),
        F.min("place").alias("low"),
        F.max("place").alias("high"),
    )
    exact = diagonals.where(~long_one & (F.size("places") == F.col("length") - K + 1)).select(
        *keys, "template", "label", "base",
        F.col("diagonal").cast("long").alias("first"),
        (F.col("diagonal") + F.col("length") - 1).cast("long").alias("last"),
        F.size("places").cast("long").alias("votes"),
        F.lit(1.0).alias("cover"),
    )
    # a band's diagonals, at most DRIFT + 1 of them
    order = Window.partitionBy(*keys, "template").orderBy("diagonal")
    band = order.rangeBetween(0, DRIFT)
    verified = (
        diagonals.where(long_one)
        .withColumn("votes", F.size(F.array_distinct(F.flatten(F.collect_list("places").over(band)))))
        .withColumn("begin", F.min(F.col("diagonal") + F.col("low")).over(band))
        .withColumn("end", F.max(F.col("diagonal") + F.col("high") + (K - 1)).over(band))
        .withColumn("cover", F.col("votes") / (F.col("length") - K + 1))
        .where(F.col("cover") >= COVER)
    )
    step = F.col("diagonal") - F.lag("diagonal").over(order)
    best = F.max(F.struct("votes", (-F.col("begin")).alias("back"), "end", "cover"))
    merged = (
        verified.withColumn("new", F.when(step <= DRIFT, 0).otherwise(1))
        .withColumn("span", F.sum("new").over(order))
        .groupBy(*keys, "template", "label", "base", "span")
        .agg(best.alias("best"))
        .select(
            *keys, "template", "label", "base",
            (-F.col("best.back")).cast("long").alias("first"), F.col("best.end").cast("long").alias("last"),
            F.col("best.votes").cast("long").alias("votes"), F.col("best.cover").alias("cover"),
        )
    )
    return exact.unionByName(merged)


def scan(docs: DataFrame, text: str = "text", notices=NOTICES) -> DataFrame:
    """`docs` with a struct `license`: n_words, n_base, first_word, last_word, base_labels, labels,
    score and n_spans.

    n_base counts all places where a base phrase stands, first_word and last_word
    are the smallest and largest start of those (null without one); labels are
    distinct, sorted and joined by commas. The score is the share that the best
    span covers of its template, 0 without a span. Rows are told apart by doc_id and text
    hash, so equal rows get equal results and different texts under one doc_id
    their own; a null doc_id or text (no words) is a row like any other. A column
    `license` of `docs` is replaced.
    """
    columns = [c for c in docs.columns if c != "license"]
    own = [F.col(f"`{c}`") for c in columns]
    # counted before the join, which then moves texts only if they are asked for
    keys = ["_id", "_hash_of_text"]
    own_id, own_hash, n_words = free(docs, "_own_id", "_own_hash", "_n_words")
    keyed = docs.select(
        *own,
        F.col("doc_id").alias(own_id),
        F.xxhash64(f"`{text}`").alias(own_hash),
        F.size(plain_words(F.col(f"`{text}`"))).cast("long").alias(n_words),
    )
    once = docs.select(
        F.col("doc_id").alias("_id"),
        F.xxhash64(f"`{text}`").alias("_hash_of_text"),
        F.col(f"`{text}`").alias("_text"),
    )
    found = spans(once, keys, "_text", notices)
    # equal rows vote alike; distinct spans make them count once
    per = (
        found.distinct()
        .groupBy(*keys)
        .agg(
            F.count_if("base").alias("n_base"),
            F.min(F.when(F.col("base"), F.col("first"))).alias("first_word"),
            F.max(F.when(F.col("base"), F.col("first"))).alias("last_word"),
            F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))).alias("base_labels"),
            F.array_sort(F.collect_set("label")).alias("labels"),
            F.max("cover").alias("score"),
            F.count("*").alias("n_spans"),
        )
    )
    results = ["n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_spans"]
    # one column, so that no name of the documents' meets one of these
    (license_,) = free(docs, "_license")
    per = per.select(*keys, F.struct(*results).alias(license_))
    other_id, other_hash = free(docs, "_other_id", "_other_hash")
    renamed = {"_id": other_id, "_hash_of_text": other_hash}
    match = F.col(own_id).eqNullSafe(F.col(other_id)) & (F.col(own_hash) == F.col(other_hash))
    of = F.col(license_)
    zero: Column = F.lit(0).cast("long")
    none = F.array().cast("array<string>")
    return keyed.join(per.withColumnsRenamed(renamed), match, "left").select(
        *own,
        F.struct(
            F.col(n_words).alias("n_words"),
            F.coalesce(of["n_base"], zero).alias("n_base"),
            of["first_word"].alias("first_word"),
            of["last_word"].alias("last_word"),
            F.array_join(F.coalesce(of["base_labels"], none), ",").alias("base_labels"),
            F.array_join(F.coalesce(of["labels"], none), ",").alias("labels"),
            F.coalesce(of["score"], F.lit(0.0)).alias("score"),
            F.coalesce(of["n_spans"], zero).alias("n_spans"),
        ).alias("license"),
    )
