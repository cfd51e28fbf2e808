"""License scan: MinHash bands over overlapping windows retrieve templates, containment verifies.

A text is lower-cased and cut into runs of letters and digits. Overlapping
windows of six of these words (two shingles of five) at a step of two hold
every shingle of the text; the windows of a template start at every word. The
signature of a window has ``BANDS`` values: the least shingle hash after
exclusive or with a constant, one constant a band. Two windows that share a
shingle have a Jaccard similarity of at least 1/3, and 1/2 or 1 where a
template's window lies in step, so they collide in some band with a probability
of at least 1 - (2/3)^BANDS, or 1 - (1/2)^BANDS; a document that holds a
template meets it with many windows. A retrieved template is then verified by
exact containment: the share of its distinct shingles that the document holds.

Templates are a small table whose size is checked; their keys are constants of
the plan, so the scan is one pass over the texts without a shuffle.

Edge cases: null and blank texts and texts of under five words match nothing;
templates of under five words are refused. Repeated rows are scanned alike, an
empty table gives an empty result, and clashing columns are not read.
"""

from __future__ import annotations

import random
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmine.llm.common import let

SHINGLE, WINDOW, BANDS, CONTAINED = 5, 6, 24, 0.8
#: Shingles of all templates together: they become constants of the plan.
MAX_TEMPLATE_SHINGLES = 20_000

# Wordings of public license notices.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file '
                         "except in compliance with the License. You may obtain a copy of the License at",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted "
                    "provided that the following conditions are met:",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                  "General Public License as published by the Free Software Foundation",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                 "associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    spaced = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def _shingles(words: Column) -> Column:
    """Hashes of all shingles, in order."""
    return F.when(F.size(words) >= SHINGLE, F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(words) - (SHINGLE - 1), F.lit(1))),
        lambda i: F.xxhash64(F.slice(words, i, SHINGLE)))).otherwise(F.array().cast("array<bigint>"))


def _band_constants(bands: int) -> list[int]:
    rnd = random.Random(29)
    return [rnd.getrandbits(63) for _ in range(bands)]


def _template_hashes(df: DataFrame, templates: Mapping[str, str]) -> dict[str, list[int]]:
    """Shingle hashes of each template, by the expressions that hash the texts."""
    spark = df.sparkSession
    pairs = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(v).alias("text")) for k, v in sorted(templates.items())])
    rows = (spark.range(1).select(F.explode(pairs).alias("t"))
            .select("t.name", _shingles(terms(F.col("t.text"))).alias("h")).collect())
    found = {r["name"]: list(r["h"]) for r in rows}
    short = [k for k, h in found.items() if not h]
    if short:
        raise ValueError(f"templates of under {SHINGLE} words: {short}")
    if sum(map(len, found.values())) > MAX_TEMPLATE_SHINGLES:
        raise ValueError(f"more than {MAX_TEMPLATE_SHINGLES} shingles of templates")
    return found


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", templates: Mapping[str, str] = TEMPLATES,
         bands: int = BANDS, contained: float = CONTAINED) -> DataFrame:
    """(doc_id, license, containment, first_word, last_word) of each template that a document contains.

    The words are places of the first and the last of the template's shingles in
    the document, counted from zero.
    """
    hashes = _template_hashes(docs, templates)
    constants = _band_constants(bands)
    step = WINDOW - SHINGLE + 1
    keys: list[dict[int, set[int]]] = []
    names = sorted(hashes)
    for c in constants:
        band: dict[int, set[int]] = {}
        for k, name in enumerate(names):
            h = hashes[name]
            for i in range(max(1, len(h) - step + 1)):
                band.setdefault(min(x ^ c for x in h[i:i + step]), set()).add(k)
        keys.append(band)

    def window_hits(h: Column, i: Column) -> Column:
        """Whether a window's signature meets a template's in some band."""
        a, b = F.get(h, i), F.coalesce(F.get(h, i + 1), F.get(h, i))
        hit = F.lit(False)
        for c, band in zip(constants, keys):
            hit = hit | F.least(a.bitwiseXOR(F.lit(c)), b.bitwiseXOR(F.lit(c))).isin(*band)
        return hit

    def retrieved(h: Column) -> Column:
        """First places of the windows that meet a template."""
        starts = F.when(F.size(h) > 0, F.sequence(F.lit(0), F.greatest(F.size(h) - 1, F.lit(0)), F.lit(step)))
        return F.filter(starts, lambda i: window_hits(h, i))

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"))
    met = rows.select("doc_id", let(let(terms(F.col("text")), _shingles), lambda h: let(
        retrieved(h), lambda s: F.when(F.size(s) > 0, F.struct(h.alias("h"), s.alias("s"))))).alias("m"))
    met = met.filter(F.col("m").isNotNull()).select("doc_id", "m.h", "m.s")

    def bands_of(name_at: int) -> Column:
        """Whether a retrieved window meets this template."""
        def hit(i: Column) -> Column:
            a, b = F.get("h", i), F.coalesce(F.get("h", i + 1), F.get("h", i))
            out = F.lit(False)
            for c, band in zip(constants, keys):
                own = [v for v, of in band.items() if name_at in of]
                out = out | F.least(a.bitwiseXOR(F.lit(c)), b.bitwiseXOR(F.lit(c))).isin(*own)
            return out
        return F.exists("s", hit)

    found = []
    for k, name in enumerate(names):
        own = F.array(*[F.lit(x) for x in sorted(set(hashes[name]))])
        held = F.size(F.array_intersect(own, F.col("h"))) / F.lit(float(len(set(hashes[name]))))
        places = F.filter(F.transform("h", lambda x, i: F.when(F.array_contains(own, x), i)), lambda x: x.isNotNull())
        found.append(F.when(bands_of(k) & (held >= contained), F.struct(
            F.lit(name).alias("license"), held.alias("containment"),
            F.array_min(places).cast("long").alias("first_word"),
            (F.array_max(places) + SHINGLE - 1).cast("long").alias("last_word"))))
    hits = F.filter(F.array(*found), lambda x: x.isNotNull())
    return met.select("doc_id", F.explode(hits).alias("f")).select("doc_id", "f.*")

