"""Licence scan by diagonal voting.

Every rolling hash of k words of every text is joined with the positions of the same hash in the
templates. A hit votes for the diagonal (position in the text minus position in the template) of
its text and template; neighbouring diagonals, which differ where words were added or left out,
are merged to spans; and a span counts once its words are verified against the template's.
Where notices of different labels stand on one place, the one that covers it best counts.
Phrases are templates too: they need every vote, one diagonal and equal words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import shipped
from .common import bounded, cut, parts, row_key, texts_of
from .textbytes import ALNUM, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {k: k + 32 for k in range(65, 91)}


@dataclass(frozen=True)
class Template:
    """A text to look for. exact: all of its words must stand consecutively."""

    name: str
    label: str
    text: str
    exact: bool = False

    @property
    def words(self) -> list[str]:
        return WORD.findall(self.text.translate(FOLD))


# The phrases and their labels.
PHRASES = (
    Template("phrase mit", "mit", "mit license", True),
    Template("phrase apache", "apache", "apache license", True),
    Template("phrase gpl", "gpl", "general public license", True),
)
# Wording of public licence notices.
NOTICES = (
    Template("mit grant", "mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    Template("mit notice", "mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    Template("isc grant", "isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    Template("bsd grant", "bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("bsd source", "bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    Template("apache header", "apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    Template("apache short", "apache", "Licensed under the Apache License, Version 2.0"),
    Template("mit short", "mit", "Released under the MIT License"),
    Template("gpl header", "gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    Template("gpl short", "gpl", "licensed under the GNU General Public License, version 3"),
    Template("lgpl header", "lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    Template("agpl header", "agpl", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    Template("mpl notice", "mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("cc by", "cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc by sa", "cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    Template("unlicense", "unlicense", "This is free and unencumbered software released into the public domain"),
    Template("rights reserved", "all-rights-reserved", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means"),
)
TEMPLATES = PHRASES + NOTICES
#: Words of a rolling hash; shorter templates use their own length.
K = 3
#: Diagonals at most so far apart are one span of a notice.
SHIFT = 3
#: Share of a notice's rolling hashes that must vote, and of its words that must be verified.
VOTES, COVER = 0.25, 0.7

SPAN = "array<struct<template:int, first:int, last:int>>"
FOUND = "array<struct<name:string, label:string, first:int, words:int, cover:double>>"


def _positions(templates: tuple[Template, ...], k: int) -> list[tuple[int, int, int, int, int, int]]:
    """(gram, template, place, size of the gram, allowed shift, votes needed); as many as the templates have words."""
    found = []
    for number, template in enumerate(templates):
        own = words([" ".join(template.words).encode()], ALNUM)
        size = min(k, int(own.counts[0]))
        grams, at = own.windows(size)
        need = len(grams) if template.exact else max(1, int(VOTES * len(grams)))
        found += [(int(g.view("int64")), number, int(p), size, 0 if template.exact else SHIFT, need) for g, p in zip(grams, at, strict=True)]
    return found


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, k: int = K, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_words, found) of every row of ``docs``; found lists the verified spans by place.

    A null or empty text has no words. Repeated rows give repeated results, rows that share an id
    stay apart, other columns aren't read. Texts of any length are scanned whole.
    """
    table = _positions(templates, k)
    sizes = sorted({x[3] for x in table})
    spark = docs.sparkSession
    positions = spark.createDataFrame(table, "gram long, template int, place int, size int, shift int, need int")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "text", 1 << 21):
            own = words(texts_of(batch, "text"), ALNUM)
            owners, places = own.owners, own.places
            for size in sizes:
                hashes, at = own.windows(size)
                for low in range(0, len(at), 1 << 17):
                    some = at[low : low + (1 << 17)]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("key").take(pa.array(owners[some])), pa.array(places[some].astype("int32")), pa.array(hashes[low : low + (1 << 17)].view("int64"))],
                        names=["key", "at", "gram"],
                    )

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), row_key(id_column, text_column).alias("key"))
    hits = shipped(rows.select("key", "text")).mapInArrow(grams, "key long, at int, gram long").join(F.broadcast(positions), "gram")
    # the templates are fixed, so the broadcast doesn't grow with the data
    diagonals = (
        hits.groupBy("key", "template", (F.col("at") - F.col("place")).alias("diagonal"), "shift", "need")
        .agg(F.size(F.collect_set("place")).alias("votes"), F.min("at").alias("first"), F.max(F.col("at") + F.col("size")).alias("last"))
    )
    along = Window.partitionBy("key", "template").orderBy("diagonal")
    merged = diagonals.withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > F.col("shift")).cast("int"), F.lit(1)))
    merged = merged.withColumn("run", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    spans = (
        merged.groupBy("key", "template", "run", "need")
        .agg(F.sum("votes").alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"))
        .where("votes >= need")
        .groupBy("key")
        .agg(F.sort_array(F.collect_list(F.struct("template", "first", "last"))).alias("spans"))
    )
    spans = cut(spans)
    texts = [t.words for t in templates]
    joined = rows.join(bounded(spans), "key", "left").select("id", "text", "spans")
    kind = f"id {docs.schema[id_column].dataType.simpleString()}, n_words long, found {FOUND}"

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.list_(pa.struct([("name", pa.string()), ("label", pa.string()), ("first", pa.int32()), ("words", pa.int32()), ("cover", pa.float64())]))
        for batch in parts(batches, "text", 1 << 22):
            own = texts_of(batch, "text")
            counts = words(own, ALNUM).counts
            found = [verified(x, s, templates, texts) if s else [] for x, s in zip(own, batch.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts), pa.array(found, shape)], names=["id", "n_words", "found"])

    return shipped(joined).mapInArrow(verify, kind)


def verified(text: bytes, spans: list[dict], templates: tuple[Template, ...], texts: list[list[str]]) -> list[dict]:
    """Compare the words of each span with its template's."""
    own = WORD.findall(text.decode("utf-8", "replace").translate(FOLD))
    found = []
    for span in spans:
        template, wanted = templates[span["template"]], texts[span["template"]]
        if template.exact:
            first, n = span["first"], len(wanted)
            cover = float(own[first : first + n] == wanted)
        else:
            low = max(0, span["first"] - SHIFT)
            blocks = [b for b in SequenceMatcher(None, own[low : span["last"] + SHIFT], wanted, autojunk=False).get_matching_blocks() if b.size]
            cover = sum(b.size for b in blocks) / len(wanted)
            first, n = (low + blocks[0].a, blocks[-1].a + blocks[-1].size - blocks[0].a) if blocks else (low, 0)
        if cover >= (1 if template.exact else COVER):
            found.append({"name": template.name, "label": template.label, "first": first, "words": n, "cover": cover, "exact": template.exact, "size": len(wanted)})
    kept: list[dict] = []
    for own in sorted(found, key=lambda x: (not x["exact"], -x["cover"], -x["size"], x["name"], x["first"])):
        if own["exact"] or not any(_rivals(own, other) for other in kept):
            kept.append(own)
    return sorted(kept, key=lambda x: (x["first"], x["name"]))


def _rivals(a: dict, b: dict) -> bool:
    """Whether two notices of different labels share over half of the words of the shorter."""
    shared = min(a["first"] + a["words"], b["first"] + b["words"]) - max(a["first"], b["first"])
    return not b["exact"] and a["label"] != b["label"] and 2 * shared > min(a["words"], b["words"])
