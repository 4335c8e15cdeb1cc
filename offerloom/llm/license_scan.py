"""Licence scans: Dice coefficient over word bigrams against templates.

All of it is DataFrame expressions. Units of a text (each line, each paragraph,
the whole) are normalised to lower-case words of letters and digits. A unit and
a template with a and b distinct bigrams can reach a Dice coefficient d only if
d * (a + b) <= 2 * min(a, b), so units are held only against templates within
these size bounds, and units out of all bounds are dropped before their bigrams
are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.9
#: What divides paragraphs: a line with nothing but white space and comment marks.
DIVIDER = "\\n[ \\t\\r#*/;%]*\\n"

#: Public licence texts and notices. What several licences share is
#: told as a choice of them.
_MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_CLAUSES = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_APACHE_GRANT = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'
_APACHE_WARRANTY = 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
_APACHE_PLACE = "http://www.apache.org/licenses/LICENSE-2.0"
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the MIT License.",
        _MIT_GRANT,
        _MIT_WARRANTY,
        f"{_MIT_GRANT} {_MIT_NOTICE} {_MIT_WARRANTY}",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License 2.0.",
        _APACHE_GRANT,
        f"{_APACHE_GRANT} {_APACHE_PLACE}",
        _APACHE_WARRANTY,
        f"{_APACHE_GRANT} {_APACHE_PLACE} {_APACHE_WARRANTY}",
        'Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to You under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under the GPL v2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GPL v3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "LGPL-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", f"{_BSD_GRANT} {_BSD_CLAUSES} {_BSD_WARRANTY}"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", _BSD_NAMES, f"{_BSD_GRANT} {_BSD_CLAUSES} {_BSD_NAMES} {_BSD_WARRANTY}"],
    "BSD-2-Clause OR BSD-3-Clause": [_BSD_GRANT, _BSD_WARRANTY],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "ISC": [_ISC_GRANT, _ISC_WARRANTY, f"{_ISC_GRANT} {_ISC_WARRANTY}"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
}


def normalised_words(text: Column) -> Column:
    """Words of letters and digits, in lower case."""
    return F.array_remove(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), "")


def bigrams(words: str) -> Column:
    """Distinct pairs of neighbouring words, joined by a space."""
    pairs = F.transform(words, lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1)))
    return F.array_distinct(F.filter(pairs, lambda p: p.isNotNull()))


def license_matches(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Licences named in each document.

    Takes (doc_id bigint, text, ...) and returns (doc_id, license, n_units,
    dice): for each licence that a line, paragraph (lines between ones that are
    blank but for comment marks) or whole text comes to by ``threshold`` or more, the number of distinct such
    units and the best coefficient. A unit counts for the closest template, on a
    tie for the first licence by name. Units longer than any template allows are
    dropped by their size, so a long text costs its words and lines alone. Null, empty and one-word units match
    nothing. Rows that share an id, a null one included, count together. Other
    columns are ignored.
    """
    spark = docs.sparkSession
    rows = [(n, i, t) for n, texts in (templates or TEMPLATES).items() for i, t in enumerate(texts)]
    plain = spark.createDataFrame(rows, "license string, version int, body string").select("license", "version", normalised_words(F.col("body")).alias("words"))
    known = plain.select("license", "version", bigrams("words").alias("pairs")).withColumn("b", F.size("pairs")).filter("b > 0").cache()
    sizes = sorted({r["b"] for r in known.select("b").collect()})
    ratio = threshold / (2 - threshold)
    longest = max(sizes, default=0) / ratio
    allowed = [a for a in range(1, int(longest + 1e-9) + 1) if any(ratio * b - 1e-9 <= a <= b / ratio + 1e-9 for b in sizes)]

    text = F.coalesce("text", F.lit(""))
    units = F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, DIVIDER), F.array(text)))
    unit = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.explode(units).alias("unit"))
    # a generator's output is not computed again where filters use it
    words = unit.select("doc_id", F.xxhash64("unit").alias("uid"), F.explode(F.array(normalised_words(F.col("unit")))).alias("words"))
    words = words.filter(F.size("words") > min(allowed, default=0))
    sized = words.select("doc_id", "uid", F.explode(F.array(bigrams("words"))).alias("pairs"))
    sized = sized.withColumn("a", F.size("pairs")).filter(F.array_contains(F.array(*[F.lit(a) for a in allowed]), F.col("a")))
    terms = F.broadcast(known.select("license", "version", "b", F.explode("pairs").alias("pair")))
    hits = sized.select("doc_id", "uid", "a", F.explode("pairs").alias("pair")).join(terms, "pair").filter(threshold * (F.col("a") + F.col("b")) <= 2 * F.least("a", "b") + 1e-9)
    shared = hits.groupBy("doc_id", "uid", "a", "license", "version", "b").agg(F.count(F.lit(1)).alias("n"))
    dice = shared.withColumn("dice", 2 * F.col("n") / (F.col("a") + F.col("b"))).filter(F.col("dice") >= threshold)
    best = dice.groupBy("doc_id", "uid").agg(F.max("dice").alias("dice"), F.min_by("license", F.struct(-F.col("dice"), "license")).alias("license"))
    return best.groupBy("doc_id", "license").agg(F.count(F.lit(1)).alias("n_units"), F.max("dice").alias("dice"))
