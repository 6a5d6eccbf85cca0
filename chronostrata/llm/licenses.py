"""Licences of texts: TF-IDF cosine to templates, and inheritance from the nearest ancestor directory.

Headers are compared as a whole: the lines of a text that have a cue such as "licen" or "copyright", its
paragraphs (up to an empty line, without the marks of comments, so that wrapped lines are one) that have a word
of a template which isn't a common one, and the whole text of a licence file. Each becomes a sparse vector of
its words, TF weighted by the words' IDF over all lines with a cue of the corpus and the templates; words that
no template has count as never seen, with the highest IDF. Its licence is the template of the highest cosine, if
that is CUT at least (ties: the first by name); of a text, the best of its headers. All rights being reserved
(GENERIC) counts only where nothing else is found, as free licences begin with it too. Licence files (LICENSE,
COPYING, NOTICE and the like) give their licence to their directory; a row without one of its own inherits from
the nearest ancestor directory that has one, found by joining the ancestors of the rows' directories to those.

Vectors hold the words of the templates alone, and the squares of what the others add to the length, so that
they are made where the texts are read, and no word is ever shuffled. A paragraph whose cosine can't reach CUT,
whatever the IDF, is left out there.

Null and empty texts have no headers and may inherit; a row without a path has no ancestors, an empty path is
the root. Several licence files in one directory: the best counts as among headers, then the first by name.
Repeated rows give repeated results. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, slices, small

CUT = 0.55
CUE = r"licen[sc]e|copyright|spdx|public domain"
FILES = r"(?i)(^|/)(licen[sc]e|copying|copyright|notice|unlicense)([.-][A-Za-z0-9.-]*)?$"
#: What begins a line of a comment, and what is between paragraphs.
MARKS = r"(?m)^[ \t]*(?:#+|//+|/?\*+/?|--+|;+|%+|<!--+|\{-)?[ \t\r]*"
GAP = r"\n[ \t\r\f\v]*\n"
WORD = r"[a-z]+|[0-9]+(?:\.[0-9]+)*"
#: Words that say nothing of a licence ("mit" is German, too, and no template has it alone); a text that shares only these with a template isn't compared with it.
COMMON = frozenset("a all also an and any are as at be been below but by can do following for found from has have if in is it law may mit more must not of on one only or other out see subject terms that the their this to under up use using v we who whom with without work you your".split())
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT OWNER OR HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY"
_BSD = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES"
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT license. See the LICENSE file for details"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License version 3"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal Public Domain Dedication"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS.replace("COPYRIGHT OWNER OR", "AUTHORS OR COPYRIGHT")),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: " + _BSD + _BSD_END),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: " + _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_END),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("proprietary", "Copyright. All rights reserved"),
]
GENERIC = "proprietary"

_COUNTS = [Counter(re.findall(WORD, t.lower())) for _, t in TEMPLATES]
VOCABULARY = sorted(set().union(*_COUNTS))
_INDEX = {w: i for i, w in enumerate(VOCABULARY)}
RARE = frozenset(w for w in VOCABULARY if len(w) > 1 and w.isalpha()) - COMMON
_RARE_BYTES = frozenset(w.encode() for w in RARE)
_LETTERS = bytes(c if 97 <= c < 123 else 32 for c in range(256))
_CUE, _MARKS, _GAP, _WORDS = re.compile(CUE), re.compile(MARKS), re.compile(GAP), re.compile(WORD)
Vector = tuple[list[int], list[int], float]


def _ancestors(path: Column) -> Column:
    """The directories above a path, the nearest first, the root as ''."""
    parts = F.split(F.regexp_replace(path, r"/+", "/"), "/")
    n = F.size(parts) - 1
    return F.when(path.isNotNull(), F.transform(F.sequence(n, F.lit(0), F.lit(-1)), lambda k: F.concat_ws("/", F.slice(parts, F.lit(1), k))))


def vector(lower: str) -> Vector:
    """The numbers of the words of templates, how often they occur, and the sum of the squares of how often the others do."""
    own, other = {}, 0
    for w, n in Counter(_WORDS.findall(lower)).items():
        if (i := _INDEX.get(w)) is None:
            other += n * n
        else:
            own[i] = n
    return sorted(own), [own[i] for i in sorted(own)], float(other)


def _may(lower: str) -> bool:
    """Whether a text has a rare word; found without the pattern, as most texts have none."""
    return not _RARE_BYTES.isdisjoint(lower.encode("utf-8", "replace").translate(_LETTERS).split())


def headers(text: str, is_file: bool) -> Iterator[tuple[Vector, bool]]:
    """The vectors of a text's headers, and whether each is a line with a cue."""
    low = text.lower()
    if "licen" in low or "copyright" in low or "spdx" in low or "public domain" in low:
        for line in low.split("\n"):
            if _CUE.search(line):
                yield vector(line), True
    if is_file:
        yield vector(low), False
    if not _may(low):
        return
    for part in _GAP.split(_MARKS.sub("", low)):
        if _may(part):
            v = vector(part)
            # the others weigh most: an upper bound of any cosine
            n = sum(x * x for x in v[1])
            if n >= (CUT * CUT - 1e-4) * (n + v[2]):
                yield v, False


def _found(base: DataFrame) -> DataFrame:
    """(doc_id, path, line, words, times, others) for each header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            at, line, words, times, others = [], [], [], [], []
            for i, (text, is_file) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                for (w, n, o), cue in headers(text, is_file):
                    at.append(i)
                    line.append(cue)
                    words.append(w)
                    times.append(n)
                    others.append(o)
            if at:
                numbers = pa.list_(pa.int32())
                rows = pa.array(at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(line), pa.array(words, numbers), pa.array(times, numbers), pa.array(others)], names)

    schema = base.select("doc_id", "path").schema
    for name, kind in (("line", "boolean"), ("words", "array<int>"), ("times", "array<int>"), ("others", "double")):
        schema = schema.add(name, T._parse_datatype_string(kind))
    names = schema.names
    return base.where("text IS NOT NULL").select("doc_id", "path", "text", F.coalesce(F.col("path").rlike(FILES), F.lit(False)).alias("is_file")).mapInArrow(run, schema)


def weights(n: int, seen: dict[int, int]) -> tuple[np.ndarray, np.ndarray, float]:
    """IDF of the vocabulary, unit vectors of the templates, and the IDF of other words; for n lines, of which seen[i] have word i."""
    n += len(TEMPLATES)
    df = np.array([seen.get(i, 0) + sum(w in c for c in _COUNTS) for i, w in enumerate(VOCABULARY)], float)
    idf = np.log((n + 1.0) / (df + 1.0)) + 1.0
    y = np.array([[c.get(w, 0) for w in VOCABULARY] for c in _COUNTS]) * idf
    return idf, y / np.sqrt((y * y).sum(axis=1, keepdims=True)), float(np.log(n + 1.0) + 1.0)


def classify(words: list[list[int]], times: list[list[int]], others: list[float], model: tuple[np.ndarray, np.ndarray, float]) -> list[tuple[str, float] | None]:
    """(licence, cosine) for each vector that matches a template."""
    idf, y, most = model
    sizes = [len(w) for w in words]
    flat = np.concatenate([np.asarray(w, np.int64) for w in words]) if words else np.zeros(0, np.int64)
    x = np.concatenate([np.asarray(t, float) for t in times]) * idf[flat] if words else np.zeros(0)
    row = np.repeat(np.arange(len(words)), sizes)
    dots = np.zeros((len(words), len(y)))
    for t in range(len(y)):
        dots[:, t] = np.bincount(row, x * y[t, flat], len(words))
    norm = np.sqrt(np.bincount(row, x * x, len(words)) + np.asarray(others) * most * most)
    cosine = np.round(dots / np.where(norm > 0, norm, 1.0)[:, None], 6)
    out = []
    for c in cosine:
        near = [(TEMPLATES[t][0] == GENERIC, -c[t], TEMPLATES[t][0]) for t in np.flatnonzero(c >= CUT)]
        out.append((min(near)[2], -float(min(near)[1])) if near else None)
    return out


def _matched(found: DataFrame) -> DataFrame:
    """(doc_id, path, licence, cosine, generic) of the headers that match."""
    lines = found.where("line")
    # a row for each word of the templates
    seen = {r["w"]: r["n"] for r in lines.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    model = found.sparkSession.sparkContext.broadcast(weights(lines.count(), seen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = classify(batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist(), model.value)
            at = pa.array([i for i, b in enumerate(best) if b], pa.int64())
            if len(at):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([b[0] for b in best if b]), pa.array([b[1] for b in best if b])], ["doc_id", "path", "licence", "cosine"])

    return found.mapInArrow(run, found.select("doc_id", "path").schema.add("licence", "string").add("cosine", "double"))


def find_licences(docs: DataFrame, id_col: str, text_col: str, path: Column) -> DataFrame:
    """(doc_id, path, licence, cosine, how, from_dir) for each row that has a licence; how: header, file or inherited."""
    base = docs.select(F.col(id_col).alias("doc_id"), path.cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    # few texts have headers, and their vectors are short: written once, so that the texts are read once
    found = materialise(_found(base), "headers")
    rank = [F.col("licence") == GENERIC, F.desc("cosine"), F.col("licence")]
    order = Window.partitionBy("doc_id", "path").orderBy(*rank)
    own = materialise(_matched(found).withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth"), "own")
    n = own.count()
    is_file = F.coalesce(F.col("path").rlike(FILES), F.lit(False))
    here = F.get(_ancestors(F.col("path")), 0)
    mine = small(own.withColumnsRenamed({"doc_id": "o_id", "path": "o_path"}), n)
    rows = base.select("doc_id", "path").join(mine, F.col("doc_id").eqNullSafe(F.col("o_id")) & F.col("path").eqNullSafe(F.col("o_path")), "left").drop("o_id", "o_path")
    with_own = rows.where("licence IS NOT NULL").select("doc_id", "path", "licence", "cosine", F.when(is_file, "file").otherwise("header").alias("how"), F.lit(None).cast("string").alias("from_dir"))
    of_dir = Window.partitionBy("dir").orderBy(*rank, "path")
    given = own.where(is_file).withColumn("dir", here).withColumn("nth", F.row_number().over(of_dir)).where("nth = 1").select("dir", F.col("licence").alias("d_licence"), F.col("cosine").alias("d_cosine"))
    # the directories of rows are fewer than rows: each is joined by its ancestors once
    places = base.where("path IS NOT NULL").select("path", here.alias("at")).groupBy("at").agg(F.min("path").alias("path"))
    up = places.select("at", F.posexplode(_ancestors(F.col("path"))).alias("distance", "dir")).join(small(given, n), "dir")
    nearest = materialise(up.groupBy("at").agg(F.min(F.struct("distance", "d_licence", "d_cosine", "dir")).alias("m")).select("at", "m.d_licence", "m.d_cosine", "m.dir"), "inherited")
    without = rows.where("licence IS NULL AND path IS NOT NULL").withColumn("at", here)
    inherited = without.join(small(nearest, nearest.count()), "at").select("doc_id", "path", F.col("d_licence").alias("licence"), F.col("d_cosine").alias("cosine"), F.lit("inherited").alias("how"), F.col("dir").alias("from_dir"))
    return with_own.unionByName(inherited)


def document_path() -> Column:
    """A path for a row of documents, which have none: a folder for 64 ids of a source, in it one for each language.

    Every sixteenth document stands for the licence file of its folder, so that the others may inherit what it has.
    """
    folder = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce(F.expr("doc_id div 64").cast("string"), F.lit("")))
    return F.when(F.expr("doc_id % 16 = 0"), F.concat(folder, F.lit("/LICENSE"))).otherwise(F.concat_ws("/", folder, F.coalesce("lang", F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


_VALUES = ", ".join("({}, '{}', '{}')".format(k, name, text.replace("'", "''")) for k, (name, text) in enumerate(TEMPLATES))
_RARE = "[" + ", ".join(f"'{w}'" for w in sorted(RARE)) + "]"
#: find_licences() over documents, for DuckDB.
SQL = f"""
WITH templates(t, licence, header) AS (VALUES {_VALUES}
), base AS (
    SELECT doc_id, lower(text) AS text, coalesce(source, '') || '/' || coalesce(CAST(doc_id // 64 AS VARCHAR), '') AS folder,
        CASE WHEN doc_id % 16 = 0 THEN folder || '/LICENSE' ELSE folder || '/' || coalesce(lang, '') || '/' || coalesce(CAST(doc_id AS VARCHAR), '') END AS path,
        CASE WHEN doc_id % 16 = 0 THEN folder ELSE folder || '/' || coalesce(lang, '') END AS dir
    FROM documents
), found AS (
    SELECT row_number() OVER () AS h, * FROM (
        SELECT doc_id, path, line, header, regexp_extract_all(header, '{WORD}') AS words FROM (
            SELECT doc_id, path, true AS line, unnest(string_split(text, chr(10))) AS header FROM base WHERE regexp_matches(text, '{CUE}')
        ) WHERE regexp_matches(header, '{CUE}')
        UNION ALL SELECT doc_id, path, false, text, regexp_extract_all(text, '{WORD}') FROM base WHERE doc_id % 16 = 0 AND text IS NOT NULL
        UNION ALL SELECT * FROM (
            SELECT doc_id, path, false, header, regexp_extract_all(header, '{WORD}') AS words FROM (
                SELECT doc_id, path, unnest(regexp_split_to_array(regexp_replace(text, '{MARKS}', '', 'g'), '{GAP}')) AS header FROM base
                WHERE list_has_any(regexp_extract_all(text, '{WORD}'), {_RARE}))
        ) WHERE list_has_any(words, {_RARE}))
), terms AS (
    SELECT h, line, word, count(*) AS tf FROM (SELECT h, line, unnest(words) AS word FROM found) GROUP BY ALL
), t_terms AS (
    SELECT t, licence, word, count(*) AS tf FROM (SELECT t, licence, unnest(regexp_extract_all(lower(header), '{WORD}')) AS word FROM templates) GROUP BY ALL
), total AS (
    SELECT (SELECT count(*) FROM found WHERE line) + (SELECT count(*) FROM templates) + 1.0 AS n
), idf AS (
    SELECT word, ln(any_value(n) / (count(*) + 1.0)) + 1.0 AS idf
    FROM (SELECT word FROM terms WHERE line AND word IN (SELECT word FROM t_terms) UNION ALL SELECT word FROM t_terms), total GROUP BY word
), v AS (
    SELECT h, word, tf * coalesce(idf, ln(n) + 1.0) AS x FROM terms LEFT JOIN idf USING (word), total
), tv AS (
    SELECT t, licence, word, tf * idf AS y FROM t_terms JOIN idf USING (word)
), cosines AS (
    SELECT v.h, tv.licence, round(sum(x * y) / any_value(nv.norm) / any_value(nt.norm), 6) AS cosine
    FROM v JOIN tv USING (word)
    JOIN (SELECT h, sqrt(sum(x * x)) AS norm FROM v GROUP BY h) nv ON nv.h = v.h
    JOIN (SELECT t, sqrt(sum(y * y)) AS norm FROM tv GROUP BY t) nt ON nt.t = tv.t
    GROUP BY v.h, tv.t, tv.licence
), own AS (
    SELECT doc_id, path, licence, cosine FROM cosines JOIN found USING (h) WHERE cosine >= {CUT}
    QUALIFY row_number() OVER (PARTITION BY doc_id, path ORDER BY licence = '{GENERIC}', cosine DESC, licence) = 1
), given AS (
    SELECT dir, licence, cosine FROM own JOIN base USING (doc_id, path) WHERE doc_id % 16 = 0
    QUALIFY row_number() OVER (PARTITION BY dir ORDER BY licence = '{GENERIC}', cosine DESC, licence, path) = 1
)
SELECT b.doc_id, b.path, o.licence, o.cosine, CASE WHEN b.doc_id % 16 = 0 THEN 'file' ELSE 'header' END AS how, CAST(NULL AS VARCHAR) AS from_dir
FROM base b JOIN own o ON o.doc_id = b.doc_id AND o.path = b.path
UNION ALL
SELECT b.doc_id, b.path, g.licence, g.cosine, 'inherited', g.dir FROM base b JOIN given g ON g.dir = b.dir OR g.dir = b.folder
WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.doc_id = b.doc_id AND o.path = b.path)
"""
