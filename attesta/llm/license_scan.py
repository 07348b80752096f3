"""License scans: normalised text is compared with licence templates by the Dice coefficient over word bigrams.

A document is compared as a whole, by its paragraphs, by its lines and by its sentences, so a notice is found wherever
it stands. Words are runs of letters and digits, lower-cased; a unit's bigrams are a set. A Dice coefficient of t needs
set sizes within t / (2 - t) and (2 - t) / t of each other: templates are dealt to every size of a unit that they
can match, and the equi-join on that size is the pruning. The template table is a constant of this module (or a list of
the caller, such as the folder of licence texts that :func:`read_templates` reads), so its broadcast does not grow with
the data: a row for each template and size that it can match, and one with each template's bigrams. There is no shuffle
but that of the few matches.

Defined results: a null or empty text and units of fewer than two words match nothing; of several matching units of
one document and licence the best is kept, and their number; rows that repeat a doc_id are one document; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import let

THRESHOLD = 0.8

# The whole texts of the short licences.
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal '
    "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies "
    "of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_THREE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
    "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED "
    "AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_TAIL = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code "
    "form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software "
    "dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and "
    "successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."
)

#: Licence identifiers and the texts of their usual notices; of short licences the whole text.
TEMPLATES = [
    ("MIT", f"{_MIT} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}"),
    ("BSD-2-Clause", f"{_BSD_HEAD} {_BSD_TWO} {_BSD_TAIL}"),
    ("BSD-3-Clause", f"{_BSD_HEAD} {_BSD_TWO} {_BSD_THREE} {_BSD_TAIL}"),
    ("ISC", f"{_ISC} {_ISC_TAIL}"),
    ("Unlicense", f"{_UNLICENSE} {_AS_IS}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", _MIT),
    ("BSD-3-Clause", _BSD_HEAD),
    ("BSD-3-Clause", "Licensed under the 3-Clause BSD License."),
    ("ISC", _ISC),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright to the public domain under CC0 1.0."),
]


def read_templates(spark: SparkSession, folder: str, most: int = 2000) -> list[tuple[str, str]]:
    """(file name without its suffix, whole text) of the licence texts in a folder; more than ``most`` files are an error."""
    rows = spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.txt)?$", 1).alias("name"), "value").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} licence texts in {folder}")
    return sorted((r.name, r.value) for r in rows)


def template_bigrams(templates: list[tuple[str, str]]) -> list[tuple[str, list[str]]]:
    out = []
    for name, text in templates:
        parts = re.findall(r"[^\W_]+", text.lower())
        out.append((name, sorted({f"{a} {b}" for a, b in zip(parts, parts[1:], strict=False)})))
    return out


def size_bounds(size: int, threshold: float = THRESHOLD) -> range:
    """Sizes of a unit's bigram set that can reach the threshold with a template of ``size`` bigrams."""
    low, high = size * threshold / (2 - threshold), size * (2 - threshold) / threshold
    return range(math.ceil(low - 1e-9), math.floor(high + 1e-9) + 1)


def units(text: Column) -> Column:
    """The whole text, its paragraphs, lines and sentences, each once."""
    by = [F.split(text, p) for p in (r"\n\s*\n", r"\n", r"(?<=[.!?])\s+")]
    return F.array_distinct(F.concat(F.array(text), *by))


def bigrams(unit: Column) -> Column:
    """The set of word bigrams of a text, as hashes."""

    def pairs(w: Column) -> Column:
        starts = F.when(F.size(w) >= 2, F.sequence(F.lit(1), F.size(w) - 1)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i))))

    return let(F.regexp_extract_all(F.lower(unit), F.lit(r"[\p{L}\p{N}]+"), 0), pairs)


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and licence found: doc_id, license_id, dice, n_units."""
    known = [(i, name, grams) for i, (name, grams) in enumerate(template_bigrams(templates)) if grams]
    sizes = [(n, i) for i, _, grams in known for n in size_bounds(len(grams), threshold)]
    spark, most = docs.sparkSession, max((n for n, _ in sizes), default=0)
    sizes = spark.createDataFrame(sizes, "n int, template int")
    table = spark.createDataFrame(known, "template int, license_id string, grams array<string>")
    table = table.select("template", "license_id", F.transform("grams", lambda g: F.xxhash64(F.split_part(g, F.lit(" "), F.lit(1)), F.split_part(g, F.lit(" "), F.lit(2)))).alias("grams"))
    # The sets are made below the explode, which no filter on them passes.
    parts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.explode_outer(F.transform(units(F.col(text_col)), bigrams)).alias("g"))
    parts = parts.select("doc_id", "g", F.size("g").alias("n")).where((F.col("n") > 0) & (F.col("n") <= most))
    both = parts.join(F.broadcast(sizes), "n").join(F.broadcast(table), "template")
    dice = 2.0 * F.size(F.array_intersect("g", "grams")) / (F.col("n") + F.size("grams"))
    found = both.select("doc_id", "license_id", dice.alias("dice")).where(F.col("dice") >= threshold)
    return found.groupBy("doc_id", "license_id").agg(F.max("dice").alias("dice"), F.count("*").alias("n_units"))
