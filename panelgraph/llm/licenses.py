"""License scans: MinHash over overlapping windows finds candidates, exact containment decides.

Words are runs of a-z and 0-9 of the lower-cased text, shingles have five words. A text's shingle hashes
are read in windows of ``WINDOW``, each starting half a window after the last; templates are cut into
runs of half a window. One-permutation MinHash splits the hash space into ``2^BIN_BITS`` bands of one
row: a band's value is the least hash of the window in it. A run of a template that stands in a text
lies wholly in one window at least. One of its shingles is that window's value unless one of at most
63 others falls into the same band below it: a chance under 63 / 2 / 65536, or 0.05 %, for a template
of a single shingle, and that to the power of the number of shingles for others. Candidates are then
checked on the shingles themselves, as text.

Windows of all texts are met with the templates in the row itself: templates are a fixed list, so
nothing is shuffled or broadcast but a few hundred numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import let, whole

WIDTH, WINDOW, BIN_BITS, CONTAINED = 5, 64, 16, 0.8

#: Notices by which texts state their licence, and the heads of common licence texts.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at"
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met"
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-grant": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated '
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def plain_words(text: Column) -> Column:
    cleaned = F.trim(F.regexp_replace(F.lower(whole(text)), "[^a-z0-9]+", " "))
    return F.when(cleaned == "", F.array().cast("array<string>")).otherwise(F.split(cleaned, " "))


def _shingles(ws: Column) -> Column:
    """Shingles as text: all of five words, or the only one of a shorter text."""
    n = F.size(ws)
    long = F.transform(F.sequence(F.lit(1), n - WIDTH + 1), lambda i: F.array_join(F.slice(ws, i, WIDTH), " "))
    return F.when(n >= WIDTH, long).when(n > 0, F.array(F.array_join(ws, " "))).otherwise(F.array().cast("array<string>"))


def _hashes(ws: Column) -> Column:
    """Hashes of the shingles, from their words."""
    n = F.size(ws)
    all_places = F.transform(ws, lambda w, i: F.xxhash64(w, *[F.get(ws, i + k) for k in range(1, WIDTH)]))
    return F.slice(all_places, 1, F.when(n >= WIDTH, n - WIDTH + 1).otherwise(F.least(n, F.lit(1))))


def _values(window: Column) -> Column:
    """Least hash of every band that has one. Bands are the highest bits, so they follow each other when sorted."""
    band = lambda x: F.shiftright(x, 64 - BIN_BITS)
    return let(F.sort_array(window), lambda s: F.filter(s, lambda x, i: (i == 0) | (band(x) != band(F.get(s, i - 1)))))


def _window_values(hashes: Column, length: int, step: int) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.size(hashes), F.lit(1)), F.lit(step))
    return F.flatten(F.transform(starts, lambda i: _values(F.slice(hashes, i, length))))


def template_table(spark, templates: dict[str, str] = TEMPLATES) -> list[dict]:
    """name, values (of its runs), shingles of each template: a few rows that any session can compute."""
    rows = F.explode(F.create_map(*[F.lit(x) for pair in templates.items() for x in pair])).alias("name", "text")
    found = spark.range(1).select(rows).select(
        "name", let(plain_words(F.col("text")), lambda ws: F.struct(
            let(_hashes(ws), lambda h: _window_values(h, WINDOW // 2, WINDOW // 2)).alias("values"), F.array_distinct(_shingles(ws)).alias("shingles"),
        )).alias("t"),
    )
    return [{"name": r["name"], "values": r["t"]["values"], "shingles": r["t"]["shingles"]} for r in found.collect()]


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, keep: tuple[str, ...] = ("doc_id",), contained: float = CONTAINED) -> DataFrame:
    """keep columns, license, n_shingles, n_shared, containment: a row for each template that a text contains.

    docs: text and what ``keep`` names; others are ignored. A template is contained if the text holds at
    least ``contained`` of its different shingles. Null and empty texts hold none and give no row;
    repeated rows give theirs each; several templates may be found in one text; an empty table gives
    an empty result.
    """
    known = template_table(docs.sparkSession, templates)
    every = F.array(*[F.lit(v) for v in sorted({v for t in known for v in t["values"]})])
    table = F.array(*[
        F.struct(F.lit(t["name"]).alias("name"), F.array(*map(F.lit, t["values"])).alias("values"), F.array(*map(F.lit, t["shingles"])).alias("shingles"))
        for t in known
    ])

    def verified(ws: Column, met: Column) -> Column:
        candidates = F.filter(table, lambda t: F.arrays_overlap(t["values"], met))
        return let(_shingles(ws), lambda own: F.filter(
            F.transform(candidates, lambda t: F.struct(
                t["name"].alias("license"), F.size(t["shingles"]).cast("long").alias("n_shingles"),
                F.size(F.array_intersect(t["shingles"], own)).cast("long").alias("n_shared"),
            )),
            lambda f: f["n_shared"] >= contained * f["n_shingles"],
        ))

    none = F.array().cast("array<struct<license:string,n_shingles:bigint,n_shared:bigint>>")
    found = let(plain_words(F.col("text")), lambda ws: let(
        let(_hashes(ws), lambda h: F.array_intersect(_window_values(h, WINDOW, WINDOW // 2), every)),
        lambda met: F.when(F.size(met) > 0, verified(ws, met)).otherwise(none),
    ))
    return docs.select(*keep, F.explode(found).alias("f")).select(*keep, "f.*").withColumn("containment", F.col("n_shared") / F.col("n_shingles"))
