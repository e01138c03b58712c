"""License scans by diagonal voting.

Templates (whole licences and notices, one-line statements and short phrases) are sequences of words. A
document's words get their numbers in the templates' vocabulary (found by hash, then compared byte for byte; 0
for all others). Spark makes every rolling k-gram of every document from them and joins all of these to the
k-grams' positions in the templates. A hit votes for the diagonal ``position in the document - position in
the template``. Votes are aggregated by diagonal, neighbouring diagonals (where words were put in or left
out) are merged into one place if they lie together, and a place is verified by the share of the template's
words that its k-grams cover. Hashes of k-grams pack the numbers of their words, so they are equal only for
equal words. A phrase of up to k words is one k-gram; its places are counted without being collected.

The table of templates is fixed and its size is checked, so it is broadcast; beyond the bound it is joined.

Defined cases: a null or empty text has no words and no labels; very long texts are whole, each a block of
its own; ids may be null or repeat (ties), every row is scanned by itself; overlapping places of one template
count each; an empty table gives none; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm._bytes import LOWER, lanes, row_blocks, span_bytes, span_hashes, spans, text_column, trimmed, vocabulary
from tessera.session import materialize, ship

#: label, text; base phrases
PHRASES = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("gpl-2.0", "under the terms of the GNU General Public License version 2"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("lgpl", "GNU Lesser General Public License"),
    ("agpl", "GNU Affero General Public License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc", "CC BY-NC 4.0"),
    ("cc-by-sa", "CC BY-SA 4.0"),
    ("cc-by-nd", "CC BY-ND 4.0"),
    ("cc-by-4.0", "licensed under CC BY 4.0"),
    ("cc-by-4.0", "Creative Commons Attribution 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd-3-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
        1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
        2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
        3. This notice may not be removed or altered from any source distribution."""),
    ("unlicense", """This is free and unencumbered software released into the public domain.
        Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
        In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""),
    ("bsl-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
        The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."""),
    ("gpl", """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""),
)
BITS = 12  # of a word's number
MAX_BROADCAST = 200_000


def template_words(text: str) -> list[str]:
    buf, offsets = text_column(pa.array([text]))
    starts, ends, _ = spans(LOWER[buf], offsets)
    raw = LOWER[buf].tobytes()
    return [raw[a:b].decode() for a, b in zip(starts, ends)]


def numbering(templates: list[tuple[str, str, bool]]) -> dict[str, int]:
    """Numbers from 1 of all words of templates."""
    words = dict.fromkeys(w for _, text, _ in templates for w in template_words(text))
    if len(words) >= 1 << BITS:
        raise ValueError(f"templates of {len(words)} different words; at most {(1 << BITS) - 1}")
    return {w: i for i, w in enumerate(words, 1)}


def template_grams(templates: list[tuple[str, str, bool]], k: int) -> list[tuple]:
    """(template, label, base, size, k, position, hash) of all k-grams of templates."""
    number, out = numbering(templates), []
    for t, (label, text, base) in enumerate(templates):
        ids = [number[w] for w in template_words(text)]
        size = min(k, len(ids))
        for i in range(len(ids) - size + 1):
            out.append((t, label, base, len(ids), size, i, sum(w << BITS * j for j, w in enumerate(ids[i : i + size]))))
    return out


def word_numbers(docs: DataFrame, id_col: str, text_col: str, number: dict[str, int]) -> DataFrame:
    """row (a key), doc_id, n_words and w (the number of each word) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    known = [w.encode() for w in number]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, (table, seed) = TaskContext.get().partitionId() << 36, vocabulary(known)
        for batch in batches:
            data, at = text_column(batch.column(1))
            for i, j in row_blocks(at):
                folded = LOWER[data[at[i] : at[j]]]
                starts, ends, counts = spans(folded, at[i : j + 1] - at[i])
                view, size = lanes(folded), ends - starts
                ids = table.find(view, starts, size, span_hashes(view, starts, size, seed)) + 1
                n = j - i
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids.astype(np.int16)))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(key, key + n)), batch.column(0).slice(i, n), pa.array(counts, pa.int64()), lists], names=["row", "doc_id", "n_words", "w"])
                key += n

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")).mapInArrow(trimmed(scan), f"row long, doc_id {kind}, n_words long, w array<smallint>")


def rolling_grams(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """row, pos, k and hash of every run of k words, for each k."""
    longest = max(sizes)
    shifted = F.arrays_zip(F.col("w").alias("w0"), *[F.slice("w", i + 1, F.greatest(F.size("w"), F.lit(0))).alias(f"w{i}") for i in range(1, longest)])
    one = rows.filter(F.size("w") >= min(sizes)).select("row", F.posexplode(shifted).alias("pos", "z"))

    def packed(k: int) -> Column:
        out = F.col("z.w0").cast("long")
        for i in range(1, k):
            out = out + F.shiftleft(F.col(f"z.w{i}").cast("long"), BITS * i)
        return out  # null where the text ends before

    return one.select("row", "pos", F.inline(F.array(*[F.struct(F.lit(k).alias("k"), packed(k).alias("hash")) for k in sizes])))


def license_places(hits: DataFrame, drift: int = 3, min_cover: float = 0.6) -> DataFrame:
    """Verified places of templates of more than one k-gram: row, template, label, first and last (words) and cover (share of the template)."""
    votes = hits.withColumn("diagonal", F.col("pos") - F.col("at"))
    diagonals = votes.groupBy("row", "template", "diagonal").agg(F.count("*").alias("n"))
    by = Window.partitionBy("row", "template").orderBy("diagonal")
    new = F.when(F.lag("diagonal").over(by).isNull() | (F.col("diagonal") - F.lag("diagonal").over(by) > drift), 1).otherwise(0)
    placed = diagonals.withColumn("place", F.sum(new).over(by)).drop("n")
    covered = votes.join(placed, ["row", "template", "diagonal"])
    # each of the template's words once, however many votes cover it
    words = covered.select("row", "template", "label", "size", "place", "pos", "k", F.explode(F.sequence("at", F.col("at") + F.col("k") - 1)).alias("word"))
    per_word = words.groupBy("row", "template", "label", "size", "place", "word").agg(F.min("pos").alias("first"), F.max(F.col("pos") + F.col("k") - 1).alias("last"))
    places = per_word.groupBy("row", "template", "label", "size", "place").agg(F.min("first").alias("first"), F.max("last").alias("last"), (F.count("*") / F.first("size")).alias("cover"))
    return places.filter(F.when(F.col("size") < 8, F.col("cover") == 1).otherwise(F.col("cover") >= min_cover)).drop("place", "size")


def template_table(spark: SparkSession, templates: list[tuple[str, str, bool]], k: int) -> DataFrame:
    return spark.createDataFrame(template_grams(templates, k), "template int, label string, base boolean, size int, k int, at int, hash long")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places of every row.

    ``places`` are those of templates other than the base phrases.
    """
    spark = docs.sparkSession
    ship(spark)
    templates = [(label, text, True) for label, text in PHRASES] + [(label, text, False) for label, text in TEMPLATES]
    every = template_grams(templates, k)
    table = template_table(spark, templates, k)
    rows = materialize(word_numbers(docs, id_col, text_col, numbering(templates)), "words")
    joined = rolling_grams(rows, sorted({g[4] for g in every})).join(F.broadcast(table) if len(every) <= MAX_BROADCAST else table, ["k", "hash"])
    hits = materialize(joined.drop("hash"), "hits")
    whole = hits.filter(F.col("k") == F.col("size"))  # a phrase of one k-gram stands where it is met
    base = whole.filter("base").groupBy("row", "label").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    short = whole.filter("not base").select("row", "template", "label", F.col("pos").alias("first"), (F.col("pos") + F.col("k") - 1).alias("last"), F.lit(1.0).alias("cover"))
    found = license_places(hits.filter(F.col("k") < F.col("size"))).unionByName(short)
    per_row = (
        base.select("row", "label", "n", "first", "last", F.lit(True).alias("base"), F.lit(1.0).alias("cover"), F.lit(None).cast("struct<first:int,last:int,label:string,cover:double>").alias("place"))
        .unionByName(found.select("row", "label", F.lit(0).cast("long").alias("n"), "first", "last", F.lit(False).alias("base"), "cover", F.struct("first", "last", "label", "cover").alias("place")))
        .groupBy("row").agg(
            F.sum("n").alias("n_base"),
            F.min(F.when(F.col("base"), F.col("first"))).alias("first_word"),
            F.max(F.when(F.col("base"), F.col("last"))).alias("last_word"),
            F.concat_ws(",", F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label"))))).alias("base_labels"),
            F.concat_ws(",", F.array_sort(F.collect_set("label"))).alias("labels"),
            F.max("cover").alias("score"),
            F.array_sort(F.collect_list("place")).alias("places"),
        )
    )
    return rows.select("row", "doc_id", "n_words").join(per_row, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long"), F.col("last_word").cast("long"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), "places",
    )
