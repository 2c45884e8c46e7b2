"""License scan by canonical digest lookup.

A text is put into a canonical form: lower case, copyright lines (with a year, (c) or the sign) removed, equivalent spellings unified, each
run of characters other than letters, digits and line breaks replaced by one space. Its units are the whole
text, every block between blank lines and every line. The SHA-256 digests of the units are joined to the
digests of the known licences' texts in the same form; a unit matches only as a whole. Known texts of several
blocks are found wherever they stand in a text: where one may begin (its first ANCHOR words), the digest of as many
words as it has is a unit too, so titles, text around it, other line breaks and comment marks don't matter. Long licences are
known by their digests alone.

Null and empty texts have no unit and no licence. Rows with the same id are reported together in one row;
a null id is an id like any other. Only the id and the text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Variant and canonical spellings of licence texts; whole words, in the order they are applied.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("authorisation", "authorization"), ("authorised", "authorized"),
    ("catalogue", "catalog"), ("centre", "center"), ("copyright holder", "copyright owner"), ("favour", "favor"), ("fulfil", "fulfill"),
    ("https", "http"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"), ("licence", "license"), ("licenced", "licensed"),
    ("merchantibility", "merchantability"), ("organisation", "organization"), ("per cent", "percent"), ("programme", "program"),
    ("recognise", "recognize"), ("sub license", "sublicense"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
)

#: Notices and full texts by licence id; copyright lines are left out.
KNOWN: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.\n\nYou should have received a copy of the GNU General Public License along with this program. If not, see <http://www.gnu.org/licenses/>.",
    ),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC0-1.0": ("Licensed under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"),
    "ISC": (
        "SPDX-License-Identifier: ISC",
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ),
}

#: Licence id, number of words, first words and digest of the canonical forms of long licences as their
#: stewards publish them, from title to end; Apache-2.0 also without its appendix.
LONG: tuple[tuple[str, int, str, str], ...] = (
    ("Apache-2.0", 1608, "apache license version", "95f35d79ea3bab75c250549d6a03cef242e0547d78c99e26fcede49936fb0184"),
    ("Apache-2.0", 1431, "apache license version", "f45538b138cf9aea39fa205de037a0bede8305e68281650e7ab809a8b3ebb2f0"),
    ("GPL-2.0", 2975, "gnu general public", "cf74dfa78ca9ac981c7ae9e50c4ecfb828df2e5ef2f1646368388676215766b5"),
    ("GPL-3.0", 5684, "gnu general public", "d0789f68ce73b9e5aca95bb2dba2f119b08a484f0c2b8875edd430f7ac40622c"),
    ("LGPL-2.1", 4401, "gnu lesser general", "ac0856eb11aebb30c08445444c942c1ddcde9d0a0447c9ed2b8a19ab7d51eba5"),
    ("LGPL-3.0", 1231, "gnu lesser general", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-2.0", 2426, "mozilla public license", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
    ("CC0-1.0", 1088, "creative commons legal", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
)

#: A join to more known digests than this is left to the planner instead of broadcast.
MAX_BROADCAST = 50_000
#: Words by which the beginning of a known text of several blocks is found.
ANCHOR = 3

#: In lower case. What merely begins with the word, as wrapped lines of licence texts do, isn't one.
_COPYRIGHT = r"(?m)^[ \t#*/;-]*(?:©|(?:\(c\)|copyright)[^\n]*?(?:[12][0-9]{3}|©|\(c\)))[^\n]*$"
_MARKS = r"[^\p{L}\p{N}\n]+"


def canonical_text(text: str) -> str:
    """The canonical form of a known licence, without line breaks."""
    text = re.sub(_COPYRIGHT, "", text.lower())
    text = re.sub(r"[\W_]+", " ", text).strip()
    for a, b in SPELLINGS:
        text = re.sub(rf"(?<= ){a}(?= )", b, f" {text} ")[1:-1]
    return text


Long = tuple[tuple[str, int, str, str], ...]


def known_digests(known: dict[str, tuple[str, ...]], long: Long = ()) -> list[tuple[str, str]]:
    return sorted({(hashlib.sha256(canonical_text(t).encode()).hexdigest(), name) for name, texts in known.items() for t in texts} | {(digest, name) for name, _, _, digest in long})


def known_spans(known: dict[str, tuple[str, ...]], long: Long = ()) -> dict[str, dict[int, set[str]]]:
    """Of the known texts of several blocks: numbers of words and digests by their first words."""
    out: dict[str, dict[int, set[str]]] = {}
    for _, n, first, digest in long:
        out.setdefault(first, {}).setdefault(n, set()).add(digest)
    for texts in known.values():
        for t in texts:
            words = canonical_text(t).split(" ")
            if re.search(r"\n[ \t]*\n", t.strip()):
                out.setdefault(" ".join(words[:ANCHOR]), {}).setdefault(len(words), set()).add(hashlib.sha256(" ".join(words).encode()).hexdigest())
    return out


def span_finder(spans: dict[str, dict[int, set[str]]]) -> Callable[[str], list[str]]:
    """The digests of the known texts of several blocks that stand in a flat canonical text."""
    begins = re.compile("(?<![^ ])(?=(" + "|".join(re.escape(a) for a in sorted(spans, key=len, reverse=True)) + ")(?![^ ]))")

    def found(text: str) -> list[str]:
        out = set()
        for m in begins.finditer(text):
            for n, digests in spans[m[1]].items():
                words = text[m.start() :].split(" ", n)[:n]
                d = hashlib.sha256(" ".join(words).encode()).hexdigest()
                if d in digests:
                    out.add(d)
        return sorted(out)

    return found


def canonical(text: Column) -> Column:
    """The canonical form with line breaks kept."""
    out = F.regexp_replace(F.regexp_replace(F.lower(text), _COPYRIGHT, ""), _MARKS, " ")
    found = "(?<![\\p{L}\\p{N}])(?:" + "|".join(a for a, _ in SPELLINGS) + ")(?![\\p{L}\\p{N}])"
    fixed = F.replace(F.regexp_replace(out, r"\n", " \n "), F.lit(" "), F.lit("  "))  # each word has a space of its own on either side
    for a, b in SPELLINGS:
        fixed = F.replace(fixed, F.lit(f" {a} ".replace(" ", "  ")[1:-1]), F.lit(f" {b} ".replace(" ", "  ")[1:-1]))
    fixed = F.replace(F.regexp_replace(fixed, " *\n *", "\n"), F.lit("  "), F.lit(" "))
    return F.when(F.regexp_like(out, F.lit(found)), fixed).otherwise(out)


def scan(docs: DataFrame, known: dict[str, tuple[str, ...]] | None = None, doc_id: str = "doc_id", text: str = "text", long: Long | None = None) -> DataFrame:
    """Per id: license_ids (sorted, joined by commas, empty if none), n_units (distinct matching units), whole (the
    whole text is a known licence). known and long: KNOWN and LONG without either."""
    spark: SparkSession = docs.sparkSession
    long = (LONG if known is None else ()) if long is None else long
    rows = known_digests(KNOWN if known is None else known, long)
    table = spark.createDataFrame(rows or [("", "")], "digest string, license string").where(F.col("digest") != "")
    table = F.broadcast(table) if len(rows) <= MAX_BROADCAST else table

    def flat(c: Column) -> Column:
        """Without line breaks; spellings of several words may have stood across one. Twice, for neighbours share a space."""
        out = F.regexp_replace(c, "[ \n]+", " ")
        for a, b in [x for x in SPELLINGS if " " in x[0]] * 2:
            out = F.replace(out, F.lit(f" {a} "), F.lit(f" {b} "))
        return F.trim(out)

    canon = docs.select(F.col(doc_id).alias("doc_id"), canonical(F.concat(F.lit(" "), F.col(text), F.lit(" "))).alias("c"))
    units = canon.select(
        "doc_id",
        flat(F.concat(F.lit(" "), F.col("c"), F.lit(" "))).alias("w"),
        F.array_union(F.transform(F.split("c", r"\n ?\n"), lambda x: flat(F.concat(F.lit(" "), x, F.lit(" ")))), F.transform(F.split("c", "\n"), lambda x: F.trim(x))).alias("u"),
    )
    every = F.transform(F.array_union(F.array("w"), "u"), lambda x: F.sha2(x, 256))
    spans = known_spans(KNOWN if known is None else known, long)
    if spans:

        @F.pandas_udf("array<string>")
        def inside(texts: pd.Series) -> pd.Series:
            find = span_finder(spans)
            return pd.Series([None if t is None else find(t) for t in texts], dtype=object)

        # only texts with such a beginning go to Python
        begins = F.regexp_like(F.col("w"), F.lit("(?:^| )(?:" + "|".join(spans) + ")(?: |$)"))
        units = units.withColumn("s", inside(F.when(begins, F.col("w"))))
        every = F.array_union(every, F.coalesce("s", F.array().cast("array<string>")))
    digests = units.select("doc_id", F.sha2("w", 256).alias("w"), F.explode(F.array_distinct(every)).alias("digest"))
    hits = digests.join(table, "digest").groupBy("doc_id").agg(
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("_l"), F.countDistinct("digest").alias("_n"), F.max(F.col("w") == F.col("digest")).alias("_w")
    )
    ids = docs.select(F.col(doc_id).alias("doc_id")).distinct()
    found = hits.withColumnRenamed("doc_id", "_id")
    return ids.join(found, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select(
        "doc_id", F.coalesce("_l", F.lit("")).alias("license_ids"), F.coalesce("_n", F.lit(0)).cast("long").alias("n_units"), F.coalesce("_w", F.lit(False)).alias("whole")
    )
