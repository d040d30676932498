"""License scan in DataFrame functions only: MinHash bands over text windows, then exact shingle containment.

Overlapping windows of a text are cut into bands of MinHash values and meet the bands of all windows of the license
templates in a broadcast join; the templates found this way are verified with the whole shingle sets.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import checkpointed, let

#: The wording of public license notices, as (license, template).
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
]
_SPLIT = "[^a-z0-9]+"


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text."""
    return F.filter(F.split(F.lower(text), _SPLIT), lambda t: t != "")


def shingles(words: Column, size: int) -> Column:
    """All shingles of ``size`` words in order; a shorter text is one shingle, an empty one none."""

    def of(w: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.size(w) - (size - 1), F.lit(1)))
        return F.when(F.size(w) > 0, F.transform(places, lambda i: F.array_join(F.slice(w, i, size), " "))).otherwise(F.array().cast("array<string>"))

    return let(words, of)


def windows(each: Column, width: int, stride: int) -> Column:
    """Overlapping windows of ``width`` shingles, ``stride`` apart; the last one may be shorter."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(each), F.lit(1)), F.lit(stride)), lambda i: F.slice(each, i, width))


def minhashes(window: Column, bands: int) -> Column:
    """One MinHash value a band: bands of one row, so that a window that shares a quarter of its shingles is all but certain to meet."""
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.xxhash64(k, F.array_min(F.transform(window, lambda s: F.xxhash64(s, k)))))


def cover(templates: list[tuple[str, str]], size: int, percent: int) -> list[str]:
    """Words that a text needs at least one of to contain a template.

    Of each template, the words stand in more than 100 - ``percent`` hundredths of its shingles; a text without any of
    them lacks all these shingles, so it cannot have ``percent`` hundredths.
    """
    out: set[str] = set()
    for _, text in templates:
        w = [t for t in re.split(_SPLIT, text.lower()) if t]
        all_ = {tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))}
        left = {s for s in all_ if not out & set(s)}
        while 100 * (len(all_) - len(left)) <= (100 - percent) * len(all_):
            # Long words are rare in texts.
            best = max(sorted({x for s in left for x in s}), key=lambda x: (len(x) ** 2 * sum(x in s for s in left), x))
            out.add(best)
            left = {s for s in left if best not in s}
    return sorted(out)


def template_table(spark: SparkSession, templates: list[tuple[str, str]], size: int) -> DataFrame:
    rows = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "template int, license string, text string")
    return rows.select("template", "license", shingles(tokens(F.col("text")), size).alias("each")).withColumn("wanted", F.array_distinct("each"))


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, shingle: int = 5, percent: int = 80, width: int = 4, stride: int = 2, bands: int = 48) -> DataFrame:
    """doc_id, template, license, n_matched and n_template of every template that a text contains.

    A text contains a template if it has ``percent`` of the template's distinct ``shingle``-word shingles or more.
    Windows of ``width`` shingles stand ``stride`` apart, those of the templates one apart, so a window inside a copy
    equals a template's and meets it for sure. Two windows that share just one of their four shingles have a similarity
    of 1/7 and miss all 48 bands with a probability of (6/7) ** 48 = 6e-4; an edited copy has several such windows.
    ``templates`` is a parameter of bounded size, which is broadcast.

    Only texts that have one of the words in ``cover`` are cut into windows; no other text can contain a template. Null
    or empty text matches nothing. Rows with the same or a null ``doc_id`` are each reported. An empty table gives an
    empty result. Texts of any length are cut whole. Templates that match equally are all reported.
    """
    spark = docs.sparkSession
    known = template_table(spark, templates, shingle)
    low = F.lower(F.col("text"))
    has = F.lit(False)
    for word in cover(templates, shingle, percent):
        has = has | low.contains(word)
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(has)
    texts = checkpointed(text.select(F.monotonically_increasing_id().alias("row"), "doc_id", shingles(tokens(F.col("text")), shingle).alias("each")))
    own = known.select("template", F.explode(windows(F.col("each"), width, 1)).alias("window")).select("template", F.explode(minhashes(F.col("window"), bands)).alias("band")).distinct()
    seen = texts.select("row", F.explode(windows(F.col("each"), width, stride)).alias("window")).select("row", F.explode(minhashes(F.col("window"), bands)).alias("band"))
    found = seen.join(F.broadcast(own), "band").select("row", "template").distinct()
    both = found.join(texts, "row").join(F.broadcast(known.select("template", "license", "wanted")), "template")
    matched = F.size(F.array_intersect("each", "wanted"))
    return both.select("doc_id", "template", "license", matched.cast("long").alias("n_matched"), F.size("wanted").cast("long").alias("n_template")).where(100 * F.col("n_matched") >= percent * F.col("n_template"))
