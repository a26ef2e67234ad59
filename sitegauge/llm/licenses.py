"""Licence scans by diagonal voting.

Every rolling word k-gram of a text is joined to the places where it stands in the licence templates.  A hit at text
place p and template place q votes for the diagonal p - q; a passage copied from a template puts its votes on one
diagonal, and words added or left out move the rest to a neighbouring one.  Votes are counted per diagonal,
neighbouring diagonals are merged, and a merged run is verified gram by gram: only what follows the template in order,
nearly step by step, counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sitegauge.session import small_table, stage

# The given phrases with their labels, then opening passages of published licences.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
PASSAGES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files", "mit"),
    ("licensed under the apache license version 2 0 you may not use this file except in compliance with the license", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
     "license as published by the free software foundation", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the "
     "following conditions are met", "bsd"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
)
GRAM = 2
#: Diagonals at most so far apart are one run; the share of a passage's grams that must be found.
DRIFT, LEAST_SHARE = 3, 0.6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def grams(words: Column, size: int) -> Column:
    """Structs (``hash``, ``at``) of all rolling ``size``-word grams."""
    return F.transform(
        F.when(F.size(words) >= size, F.sequence(F.lit(0), F.size(words) - size)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.xxhash64(*[F.get(words, i + k) for k in range(size)]).alias("hash"), i.alias("at")))


def templates(spark: SparkSession, phrases: Sequence[tuple[str, str]] = PHRASES,
              passages: Sequence[tuple[str, str]] = PASSAGES) -> DataFrame:
    """(``template``, ``label``, ``phrase``, ``t_words``): given phrases must stand whole, passages in part."""
    rows = [(i, label, i < len(phrases), text) for i, (text, label) in enumerate([*phrases, *passages])]
    return small_table(spark, rows, "template int, label string, phrase boolean, text string").select(
        "template", "label", "phrase", F.split("text", " ").alias("t_words"))


def hits(docs: DataFrame, known: DataFrame, id_col: str, text_col: str, size: int = GRAM) -> DataFrame:
    """(``key``, ``template``, ``p``, ``q``): every place of a template gram in a text."""
    table = known.select("template", F.explode(grams(F.col("t_words"), size)).alias("g")).select(
        "template", F.col("g.hash").alias("hash"), F.col("g.at").alias("q"))
    rolled = docs.select(row_key(id_col, text_col).alias("key"), F.explode(
        F.transform(F.array(words_of(F.col(text_col))), lambda w: grams(w, size))[0]).alias("g"))
    # The templates are fixed values, some hundred grams in all.
    return rolled.select("key", F.col("g.hash").alias("hash"), F.col("g.at").alias("p")).join(
        F.broadcast(table), "hash").select("key", "template", "p", "q")


def row_key(id_col: str, text_col: str) -> Column:
    """What tells rows apart: id and text.  Rows equal in both have equal results."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.length(text), F.xxhash64(text))


def steps(places: Column) -> Column:
    """Grams of a run that stand in order: the first, and each that comes at most ``DRIFT`` words late after the one before.

    ``places`` are structs (``q``, ``p``) by template place; of several text places of one gram the first is meant.
    """
    start = F.struct(F.lit(-1).alias("q"), F.lit(0).alias("p"), F.lit(0).alias("n"))

    def add(state: Column, place: Column) -> Column:
        ahead, gone = place["p"] - state["p"], place["q"] - state["q"]
        counts = (state["q"] < 0) | ((ahead > 0) & (ahead <= gone + DRIFT))
        return F.when(place["q"] == state["q"], state).otherwise(F.struct(
            place["q"].alias("q"), place["p"].alias("p"), (state["n"] + counts.cast("int")).alias("n")))

    return F.aggregate(F.array_sort(places), start, add)["n"]


def spans(voted: DataFrame, known: DataFrame, size: int = GRAM) -> DataFrame:
    """(``key``, ``label``, ``phrase``, ``start``, ``end``, ``share``): verified runs of merged diagonals, in words.

    A phrase's runs are single diagonals that hold all its grams.  A passage's run joins diagonals at most ``DRIFT``
    apart; its share is the part of the template's grams found in the template's order, each counted once.
    """
    n_grams = F.size("t_words") - (size - 1)
    # Equal rows vote once.
    diagonals = voted.distinct().withColumn("diagonal", F.col("p") - F.col("q")).join(
        F.broadcast(known.select("template", "label", "phrase", n_grams.alias("n_grams"))), "template")
    counted = diagonals.groupBy("key", "template", "label", "phrase", "n_grams", "diagonal").agg(
        F.collect_set("q").alias("found"))
    whole = counted.where("phrase AND size(found) = n_grams").select(
        "key", "label", "phrase", F.col("diagonal").alias("start"), (F.col("diagonal") + F.col("n_grams") + (size - 1)).alias("end"),
        F.lit(1.0).alias("share"))
    by_place = Window.partitionBy("key", "template").orderBy("diagonal")
    runs = counted.where("NOT phrase").withColumn(
        "fresh", (F.col("diagonal") - F.coalesce(F.lag("diagonal").over(by_place), F.lit(-1 << 30)) > DRIFT).cast("int"))
    places = F.transform("found", lambda q: F.struct(q.alias("q"), (q + F.col("diagonal")).alias("p")))
    runs = runs.withColumn("run", F.sum("fresh").over(by_place)).groupBy("key", "template", "label", "n_grams", "run").agg(
        F.flatten(F.collect_list(places)).alias("places"))
    part = runs.withColumn("share", steps(F.col("places")) / F.col("n_grams")).where(F.col("share") >= LEAST_SHARE).select(
        "key", "label", F.lit(False).alias("phrase"), F.array_min("places.p").alias("start"),
        (F.array_max("places.p") + size).alias("end"), "share")
    return whole.unionByName(part)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: word count, places of the given phrases, labels and score.

    ``score`` is the largest share found of any template, 0 without one.  A null or empty text has no words; a text of
    fewer words than a gram has no places.  Null ids and repeated rows stay; an empty table gives an empty result; other
    columns are left out.
    """
    spark = docs.sparkSession
    known = templates(spark)
    found = spans(stage(hits(docs, known, id_col, text_col), "licence-hits"), known)
    base = F.col("phrase")
    per_text = found.groupBy("key").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("share").alias("score"))
    rows = docs.select(F.col(id_col), row_key(id_col, text_col).alias("key"), F.transform(
        F.array(words_of(F.col(text_col))), F.size)[0].cast("long").alias("n_words"))
    empty = {"n_base": 0, "base_labels": "", "labels": "", "score": 0.0}
    return rows.join(per_text, "key", "left").fillna(empty).select(
        id_col, "n_words", F.col("n_base").cast("long").alias("n_base"), "first_word", "last_word", "base_labels", "labels", "score")
