"""Licence scans: normalised lines against licence templates by the Dice coefficient.

Text is lower-cased and cut to letters and digits. The score of a line and a template is the Dice
coefficient of their sets of word bigrams, 2 * shared / (left + right). A score of t needs set
sizes within t / (2 - t) and its inverse, so a line meets only the templates its size admits: an
equality join on the size, with the template list written once for every admissible size.

A notice that is wrapped over lines or stands inside a longer one is a passage: a window of the
whole text's words. The best window starts and ends with a bigram of its template, since a foreign
bigram at either end only adds to the total, so just windows between such places are scored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions.evaluate import evaluate_once
from sessionloom.llm.text import documents_table

THRESHOLD_PERCENT = 80

# Customary notices and opening passages of public licences.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions:",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License v3.0."),
    (
        "GPL",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met:",
    ),
)


def normalised(text: Column) -> Column:
    """Lower-case letters and digits; every other run of characters is one blank."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def bigrams(of_words: Column) -> Column:
    """Distinct pairs of neighbouring words; a single word is its own only pair."""
    pairs = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(of_words) - 1, F.lit(1))),
        lambda at: F.array_join(F.slice(of_words, at, 2), " "),
    )
    return F.array_distinct(pairs)


def template_table(spark: SparkSession, templates: tuple[tuple[str, str], ...], percent: int) -> DataFrame:
    """Templates with their bigrams, one row for every admissible size of a line. The list is fixed."""
    listed = spark.createDataFrame(
        [(at, name, text) for at, (name, text) in enumerate(templates)], "template int, licence string, body string"
    )
    sized = listed.withColumn("pairs", bigrams(F.split(normalised(F.col("body")), " ")))
    own = F.size("pairs")
    low = F.greatest(F.lit(1), F.ceil(own * percent / (200 - percent)).cast("int"))
    high = F.floor(own * (200 - percent) / percent).cast("int")
    return sized.select("template", "licence", "pairs", F.explode(F.sequence(low, high)).alias("size"))


def licence_lines(
    frame: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    percent: int = THRESHOLD_PERCENT,
) -> DataFrame:
    """One row per line and template that reach the threshold: id, line, template, licence, shared, total.

    ``line`` counts from 1 in the whole text; ``template`` is the place in the list; ``total`` is the
    sum of both set sizes and ``2 * shared / total`` the coefficient. Null, empty and blank texts and
    lines have no words and match nothing. Repeated rows and ids, also null ones, give repeated
    results. Other columns are ignored. Nothing is shuffled.
    """
    listed = template_table(frame.sparkSession, templates, percent)
    lines = frame.select(
        F.col(f"`{doc_id}`").alias("id"),
        F.posexplode(F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), "\n")).alias("at", "line_text"),
    )
    lines = evaluate_once(lines, {"line_words": F.split(normalised(F.col("line_text")), " ")})
    lines = lines.where(F.col("line_words")[0] != "")
    lines = evaluate_once(
        lines.select("id", "at", "line_words"), {"line_pairs": bigrams(F.col("line_words"))}
    ).withColumn("size", F.size("line_pairs"))
    met = lines.join(F.broadcast(listed), "size")
    met = evaluate_once(
        met.select("id", "at", "template", "licence", "line_pairs", "pairs"),
        {
            "score": F.struct(
                F.size(F.array_intersect("line_pairs", "pairs")).alias("shared"),
                (F.size("line_pairs") + F.size("pairs")).alias("total"),
            )
        },
    ).where(F.col("score.shared") * 200 >= F.col("score.total") * percent)
    return met.select(
        "id",
        (F.col("at") + 1).cast("bigint").alias("line"),
        "template",
        "licence",
        F.col("score.shared").cast("bigint").alias("shared"),
        F.col("score.total").cast("bigint").alias("total"),
    )


def _template_array(spark: SparkSession, templates: tuple[tuple[str, str], ...], percent: int) -> tuple[Column, list]:
    """The templates with their bigrams and admissible sizes as one constant array, and as rows."""
    sized = template_table(spark, templates, percent).groupBy("template", "licence", "pairs")
    rows = sized.agg(F.min("size").alias("low"), F.max("size").alias("high")).orderBy("template").collect()
    schema = "array<struct<template:int,licence:string,pairs:array<string>,low:int,high:int>>"
    return F.from_json(F.lit(json.dumps([row.asDict() for row in rows])), schema), rows


def _reaches(pairs: Column, template: Column, percent: int) -> Column:
    shared, total = F.size(F.array_intersect(pairs, template["pairs"])), F.size(pairs) + F.size(template["pairs"])
    return shared * 200 >= total * percent


def licence_passages(
    frame: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    percent: int = THRESHOLD_PERCENT,
) -> DataFrame:
    """One row per passage that reaches the threshold, with the columns of ``licence_lines``.

    A passage is a window of the words of the whole text, across line ends, that starts and ends
    with a bigram of the template and has no more bigrams than the template's size admits. Of
    windows of one licence that overlap, the one with the best score stays, then that with more
    shared bigrams, then the first. ``line`` is the line in which it starts. A passage inside one
    line that reaches the threshold for the same licence is left to ``licence_lines``. A template
    of one word is its own only bigram here too. Nothing is shuffled.
    """
    listed, rows = _template_array(frame.sparkSession, templates, percent)
    if not rows:
        return licence_lines(frame, doc_id=doc_id, text=text, templates=templates, percent=percent).where("false")
    twos = sorted({pair for row in rows for pair in row.pairs if " " in pair})
    ones = sorted({pair for row in rows for pair in row.pairs if pair and " " not in pair})
    firsts = sorted({pair.split(" ")[0] for pair in twos})
    found = frame.select(
        F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body")
    )
    found = evaluate_once(found, {"all_words": F.split(normalised(F.col("body")), " ")})
    word = lambda at: F.get(F.col("all_words"), at)
    pair = lambda at: F.concat(word(at), F.lit(" "), F.coalesce(word(at + 1), F.lit("")))
    hit = lambda at: (word(at).isin(firsts) & pair(at).isin(twos)) | word(at).isin(ones)
    found = evaluate_once(
        found.select("id", "body", "all_words"),
        {"hits": F.filter(F.sequence(F.lit(0), F.size("all_words") - 1), hit)},
    ).where(F.size("hits") >= min(row.low for row in rows))
    # Texts that hold too few of a template's bigrams, wherever they are, cannot reach it.
    held = F.array_distinct(F.flatten(F.transform("hits", lambda at: F.array(word(at), pair(at)))))
    found = evaluate_once(found.select("id", "body", "all_words", "hits"), {"held": held})
    near = F.filter(listed, lambda one: F.size(F.array_intersect(one["pairs"], "held")) >= one["low"])
    found = evaluate_once(found.select("id", "body", "all_words", "hits", "held"), {"near": near}).where(
        F.size("near") > 0
    )
    # A bigram has one word more than its place says, a template of one word has none.
    wide = lambda one: F.when(F.get(one["pairs"], F.lit(0)).contains(" "), 1).otherwise(0)
    every = F.sequence(F.lit(0), F.size("all_words") - 1)
    # For every place the last one before it with the same bigram, -1 for none.
    by_pair = F.array_sort(F.transform(every, lambda at: F.struct(pair(at).alias("pair"), at.alias("at"))))
    found = evaluate_once(found.select("id", "body", "all_words", "near"), {"by_pair": by_pair})
    same = lambda one, at: F.get(F.col("by_pair"), at - 1)["pair"].eqNullSafe(one["pair"])
    before = F.transform(
        "by_pair",
        lambda one, at: F.struct(
            one["at"].alias("at"), F.when(same(one, at), F.get(F.col("by_pair"), at - 1)["at"]).otherwise(-1).alias("last")
        ),
    )
    found = evaluate_once(found.select("id", "body", "all_words", "near", "by_pair"), {"before": F.array_sort(before)})
    own = lambda one: F.transform(
        every, lambda at: F.array_contains(one["pairs"], F.when(wide(one) == 1, pair(at)).otherwise(word(at)))
    )
    places = F.transform("near", lambda one: F.struct(one.alias("one"), wide(one).alias("wide"), own(one).alias("own")))
    found = evaluate_once(
        found.select("id", "body", "all_words", "near", F.transform("before", lambda one: one["last"]).alias("last")),
        {"places": places},
    )
    spans = F.flatten(F.transform("places", lambda place: _windows(place, percent)))
    found = evaluate_once(found.select("id", "body", "all_words", "last", "places"), {"spans": spans})
    found = found.where(F.size("spans") > 0)
    ranked = F.transform(
        "spans",
        lambda one: F.struct(
            (-one["shared"] / one["total"]).alias("worse"), (-one["shared"]).alias("fewer"),
            one["start"].alias("start"), one["end"].alias("end"),
            one["template"].alias("template"), one["licence"].alias("licence"), one["total"].alias("total"),
        ),
    )
    found = evaluate_once(
        found.select("id", "body", F.size("all_words").alias("n"), "spans"), {"ranked": F.sort_array(ranked)}
    )
    licences = F.array_distinct(F.transform("ranked", lambda one: one["licence"]))
    best = F.flatten(F.transform(licences, _best_apart))
    lines = F.split("body", "\n")
    found = evaluate_once(
        found.select("id", "body", "n", "ranked"),
        {"best": best, "parts": F.transform(lines, lambda line: F.split(normalised(line), " "))},
    )
    numbers = F.flatten(
        F.transform(
            "parts", lambda part, at: F.array_repeat(at, F.when(part[0] == "", 0).otherwise(F.size(part)))
        )
    )
    found = evaluate_once(found.select("id", "best", "parts"), {"line_of": numbers})
    line_of = lambda place: F.get(F.col("line_of"), place)
    inside = F.filter("best", lambda one: line_of(one["start"]) == line_of(one["end"]))
    held = F.array_distinct(F.transform(inside, lambda one: line_of(one["start"])))
    # The licences that a line with a passage in it reaches as a whole; each such line is judged once.
    cut = F.transform(
        held, lambda line: F.struct(line.alias("line"), bigrams(F.get(F.col("parts"), line)).alias("pairs"))
    )
    told = F.transform(
        cut,
        lambda line: F.struct(
            line["line"].alias("line"),
            F.transform(
                F.filter(listed, lambda one: _reaches(line["pairs"], one, percent)), lambda one: one["licence"]
            ).alias("licences"),
        ),
    )
    found = evaluate_once(found.select("id", "best", "parts", "line_of"), {"told": told})
    found = found.select("id", "line_of", "told", F.explode("best").alias("one"))
    first, last = line_of(F.col("one.start")), line_of(F.col("one.end"))
    left = F.exists(
        "told", lambda line: (line["line"] == first) & F.array_contains(line["licences"], F.col("one.licence"))
    )
    return found.where((first != last) | ~left).select(
        "id",
        (first + 1).cast("bigint").alias("line"),
        F.col("one.template").alias("template"),
        F.col("one.licence").alias("licence"),
        (-F.col("one.fewer")).cast("bigint").alias("shared"),
        F.col("one.total").cast("bigint").alias("total"),
    )


def _windows(place: Column, percent: int) -> Column:
    """The windows of one template that reach the threshold, with their shared and total bigrams.

    From a start, the places that are the first with their bigram number the distinct bigrams of every
    window, and those of them in the template the shared ones, so all ends are scored in one pass.
    A window that ends with a bigram it holds before has the score of the shorter one at best and
    is left out: it overlaps that one, and whatever overlaps that one.
    """
    one = place["one"]
    reach = F.when(place["wide"] == 1, one["high"] - 1).otherwise(0)
    limit = F.size("all_words") - 1 - place["wide"]

    def starting(start: Column) -> Column:
        firsts = F.filter(
            F.sequence(start, F.least(start + reach, limit)), lambda at: F.get(F.col("last"), at) < start
        )
        numbered = F.transform(firsts, lambda at, number: F.struct(at.alias("at"), (number + 1).alias("distinct")))
        mine = F.filter(numbered, lambda item: F.get(place["own"], item["at"]))
        spans = F.transform(
            mine,
            lambda item, number: F.struct(
                one["template"].alias("template"), one["licence"].alias("licence"), start.alias("start"),
                (item["at"] + place["wide"]).alias("end"), (number + 1).alias("shared"),
                (item["distinct"] + F.size(one["pairs"])).alias("total"),
            ),
        )
        return F.filter(spans, lambda span: span["shared"] * 200 >= span["total"] * percent)

    starts = F.filter(F.sequence(F.lit(0), limit), lambda at: F.get(place["own"], at))
    return F.when(limit >= 0, F.flatten(F.transform(starts, starting)))


def _best_apart(licence: Column) -> Column:
    """Of the ranked windows of one licence, those that overlap no better one that is kept."""
    own = F.filter("ranked", lambda one: one["licence"] == licence)
    start = F.struct(
        F.slice("ranked", F.lit(1), F.lit(0)).alias("kept"), F.array_repeat(F.lit(False), F.col("n")).alias("taken")
    )

    def step(state: Column, one: Column) -> Column:
        overlaps = F.array_contains(F.slice(state["taken"], one["start"] + 1, one["end"] - one["start"] + 1), F.lit(True))
        taken = F.transform(state["taken"], lambda used, at: used | at.between(one["start"], one["end"]))
        return F.when(overlaps, state).otherwise(
            F.struct(F.concat(state["kept"], F.array(one)).alias("kept"), taken.alias("taken"))
        )

    return F.aggregate(own, start, step, lambda state: state["kept"])


def licence_notices(frame: DataFrame, **settings) -> DataFrame:
    """The rows of ``licence_lines`` and, for notices that no line holds as a whole, of ``licence_passages``."""
    return licence_lines(frame, **settings).unionByName(licence_passages(frame, **settings))


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in the lines and passages of every document."""
    return licence_notices(documents_table(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_TEMPLATE_ROWS = ", ".join(f"({at}, {_quoted(name)}, {_quoted(text)})" for at, (name, text) in enumerate(TEMPLATES))

LICENCE_SQL = rf"""
WITH split AS (
  SELECT row_number() OVER () AS row_id, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (
  SELECT row_id, doc_id, unnest(parts) AS body, unnest(generate_series(1, len(parts))) AS line FROM split
), units AS (
  SELECT 'line' AS kind, row_id AS a, line AS b,
         string_split(trim(regexp_replace(lower(body), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), ' ') AS tokens FROM lines
  UNION ALL
  SELECT 'template', template, 0,
         string_split(trim(regexp_replace(lower(body), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), ' ')
  FROM (VALUES {_TEMPLATE_ROWS}) AS t(template, licence, body)
), tokens AS (
  SELECT kind, a, b, len(tokens) AS n, unnest(tokens) AS token, unnest(generate_series(1, len(tokens))) AS pos
  FROM units WHERE tokens[1] <> ''
), pairs AS (
  SELECT kind, a, b, n, pos, token, lead(token) OVER (PARTITION BY kind, a, b ORDER BY pos) AS follower FROM tokens
), sets AS (
  SELECT DISTINCT kind, a, b, CASE WHEN n = 1 THEN token ELSE token || ' ' || follower END AS pair
  FROM pairs WHERE n = 1 OR follower IS NOT NULL
), sized AS (
  SELECT *, count(*) OVER (PARTITION BY kind, a, b) AS size FROM sets
), met AS (
  SELECT l.a AS row_id, l.b AS line, t.a AS template, count(*) AS shared, any_value(l.size + t.size) AS total
  FROM sized l JOIN sized t ON l.pair = t.pair AND l.kind = 'line' AND t.kind = 'template'
  GROUP BY l.a, l.b, t.a
)
SELECT lines.doc_id, CAST(met.line AS BIGINT) AS line, CAST(met.template AS INTEGER) AS template, t.licence,
       CAST(met.shared AS BIGINT) AS shared, CAST(met.total AS BIGINT) AS total
FROM met JOIN lines ON lines.row_id = met.row_id AND lines.line = met.line
JOIN (VALUES {_TEMPLATE_ROWS}) AS t(template, licence, body) ON t.template = met.template
WHERE 200 * met.shared >= {THRESHOLD_PERCENT} * met.total
"""
