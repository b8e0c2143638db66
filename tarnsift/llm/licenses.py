"""Licence texts by canonical digest.

A text is brought to a canonical form (lower case, no copyright notices, words and numbers between single spaces, equivalent spellings as one), and its digest meets those of known licences in a hash join, for the entire text; the same is looked up for each entire line that may be a notice. Only DataFrame functions take part.

Known in full: MIT, ISC, BSD-2-Clause, BSD-3-Clause, Zlib, and the files in texts/ (Apache-2.0, GPL-2.0, GPL-3.0, LGPL-2.1, LGPL-3.0, MPL-2.0, CC0-1.0, CC-BY-SA-4.0), these also without what follows their END OF TERMS AND CONDITIONS. Others, AGPL-3.0 and the further CC licences among them, are known by one-line notices only; a table of texts can be given in their place.

Edge cases: a null text has no digest and no licence; a text that is empty in canonical form has the digest of nothing, which no licence has. Very long texts are canonical as a whole. A digest that two licences share goes to the lesser name. Repeated rows are answered alike; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Equivalent spellings, put in place in this order on lower-case words between single spaces.
SPELLINGS = (
    ("licenc", "licens"),
    ("sub licens", "sublicens"),
    ("copyright holder", "copyright owner"),
    ("merchantibility", "merchantability"),
    ("non infringement", "noninfringement"),
    ("per cent", "percent"),
    ("favour", "favor"),
    ("acknowledgement", "acknowledgment"),
    ("analyse", "analyze"),
    ("organisation", "organization"),
    ("initialise", "initialize"),
    ("labour", "labor"),
    ("whilst", "while"),
    ("https", "http"),
)
#: A notice: the sign, years, and the holder up to the end of the line or sentence or the first words of a licence; at most 200 characters. The end stays.
_SIGNS = ("copyright", "(c)", "©")
_NOTICE = r"(?:copyright|\(c\)|©)(?:[ \t,:;–-]|copyright|\(c\)|©|and|by|[0-9]{4}){0,40}[0-9]{4}(?:inc\.|ltd\.|co\.|corp\.|llc\.|[^\n]){0,200}?(\n|\. |permission is hereby|permission to use|redistribution and use|licensed under|licenced under|this software is|\z)"
_RIGHTS = "all rights reserved"
#: Canonical texts of at most so many characters are looked for in lines; a line is one only if it holds a mark.
LINE, MARKS = 200, ("licen", "spdx", "under")
END = "END OF TERMS AND CONDITIONS"

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

#: (licence, text). Short notices stand for the licence they name.
KNOWN: tuple[tuple[str, str], ...] = (
    ("MIT", MIT),
    ("MIT", "MIT License\n\n" + MIT),
    ("MIT", "The MIT License (MIT)\n\n" + MIT),
    ("ISC", ISC),
    ("ISC", "ISC License\n\n" + ISC),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _THIRD + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD + _THIRD + _BSD_END),
    ("Zlib", ZLIB),
    ("Zlib", "zlib License\n\n" + ZLIB),
    ("Apache-2.0", APACHE_NOTICE),
    *(
        (name, form.format(what))
        for name, whats in (
            ("MIT", ("the MIT License", "MIT License", "the MIT license (MIT)")),
            ("Apache-2.0", ("the Apache License, Version 2.0", "Apache License 2.0", "the Apache License 2.0", "Apache 2.0", "Apache-2.0")),
            ("GPL-3.0", ("the GNU General Public License, version 3", "the GNU General Public License version 3", "GNU GPL v3", "GPL-3.0")),
            ("GPL-2.0", ("the GNU General Public License, version 2", "the GNU General Public License version 2", "GNU GPL v2", "GPL-2.0")),
            ("LGPL-3.0", ("the GNU Lesser General Public License, version 3", "LGPL-3.0")),
            ("AGPL-3.0", ("the GNU Affero General Public License, version 3", "AGPL-3.0")),
            ("BSD-3-Clause", ("the BSD 3-Clause License", "BSD-3-Clause")),
            ("BSD-2-Clause", ("the BSD 2-Clause License", "BSD-2-Clause")),
            ("MPL-2.0", ("the Mozilla Public License, v. 2.0", "the Mozilla Public License, version 2.0", "MPL-2.0")),
            ("CC-BY-4.0", ("CC BY 4.0", "the Creative Commons Attribution 4.0 International License")),
            ("CC-BY-SA-4.0", ("CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License")),
            ("CC-BY-NC-4.0", ("CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License")),
            ("CC0-1.0", ("CC0 1.0", "CC0")),
        )
        for what in whats
        for form in ("Licensed under {}.", "Released under {}.", "This work is licensed under {}.", "This software is licensed under {}.", "This project is licensed under {}.", "Distributed under {}.")
    ),
    *((name, f"SPDX-License-Identifier: {name}") for name in ("MIT", "Apache-2.0", "GPL-3.0-only", "GPL-2.0-only", "BSD-3-Clause", "BSD-2-Clause", "MPL-2.0", "CC-BY-4.0", "CC0-1.0", "ISC", "Zlib")),
    *((p.stem, p.read_text("utf-8")) for p in sorted((Path(__file__).parent / "texts").glob("*.txt"))),
)


def _without_notices(text: Column) -> Column:
    """Lower case, notices gone."""
    low = F.lower(text)
    some = F.contains(low, F.lit(_SIGNS[0])) | F.contains(low, F.lit(_SIGNS[1])) | F.contains(low, F.lit(_SIGNS[2]))
    return F.replace(F.when(some, F.regexp_replace(low, _NOTICE, "$1")).otherwise(low), F.lit(_RIGHTS), F.lit(" "))


def _words(low: Column) -> Column:
    """Words and numbers between single spaces, spellings made equal."""
    c = F.trim(F.regexp_replace(low, r"[^a-z0-9\x{80}-\x{10FFFF}]+", " "))
    for a, b in SPELLINGS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def canonical(text: Column) -> Column:
    """The canonical form of an entire text."""
    return _words(_without_notices(text))


def digest(text: Column) -> Column:
    return F.md5(canonical(text).cast("binary"))


def known(licenses: DataFrame) -> DataFrame:
    """(digest, license, line), one row per digest, from (license, text): of each text, and where it has an end mark, of what stands before it, with and without the mark. line: whether it may be a line."""
    at = F.locate(END, F.col("text"))
    forms = F.when(at > 0, F.array("text", F.substring(F.col("text"), F.lit(1), at - 1), F.substring(F.col("text"), F.lit(1), at + len(END) - 1))).otherwise(F.array("text"))
    df = licenses.select("license", F.explode(forms).alias("text")).select("license", canonical(F.col("text")).alias("c")).where("c <> ''")
    return df.select(F.md5(F.col("c").cast("binary")).alias("digest"), "license", (F.length("c") <= LINE).alias("line")).groupBy("digest").agg(F.min("license").alias("license"), F.max("line").alias("line"))


def texts(spark: SparkSession, given: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """(license, text), a few hundred rows, whatever the input."""
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(n).alias("license"), F.lit(t).alias("text")) for n, t in given])))


def find(docs: DataFrame, licenses: DataFrame | None = None, marks: tuple[str, ...] = MARKS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: the key, digest, license (of the entire text), notices (sorted licences of entire lines, comma-joined), n_notices (lines that are one).

    licenses: a table (license, text) in place of the known ones. The entire text meets their digests in a hash join; those short enough for a line, which must be few, make a map that the lines are looked up in. marks: parts of which a line that is looked up must hold one; none: all lines are.
    """
    table_of = known(texts(docs.sparkSession) if licenses is None else licenses)
    short = table_of.where("line").select("digest", "license").toArrow().to_pylist()
    by_digest = F.map_from_arrays(F.array(*[F.lit(r["digest"]) for r in short]), F.array(*[F.lit(r["license"]) for r in short])) if short else F.lit(None).cast("map<string,string>")
    clean = docs.select(F.col(key).alias("doc_id"), _without_notices(F.col(text)).alias("clean"))

    def marked(x: Column) -> Column:
        test = F.lit(not marks)
        for m in marks:
            test = F.contains(x, F.lit(m)) | test
        return test

    lines = F.when(marked(F.col("clean")), F.filter(F.split("clean", "\n"), marked))
    named = F.filter(F.transform(lines, lambda x: F.try_element_at(by_digest, F.md5(_words(x).cast("binary")))), lambda x: x.isNotNull())
    df = clean.select("doc_id", F.md5(_words(F.col("clean")).cast("binary")).alias("digest"), F.coalesce(named, F.array().cast("array<string>")).alias("named"))
    whole = table_of.select("digest", "license")
    # Their number hangs on the table of texts, not on the documents; the known ones are a few hundred.
    whole = F.broadcast(whole) if licenses is None else whole
    return df.join(whole, "digest", "left").select("doc_id", "digest", "license", F.array_join(F.array_sort(F.array_distinct("named")), ",").alias("notices"), F.size("named").cast("long").alias("n_notices"))


def query(spark, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    clean = lambda t: f"replace(regexp_replace(lower({t}), {quoted(_NOTICE)}, '\\1', 'g'), {quoted(_RIGHTS)}, ' ')"

    def words(x: str) -> str:
        c = f"trim(regexp_replace({x}, '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g'))"
        for a, b in SPELLINGS:
            c = f"replace({c}, {quoted(a)}, {quoted(b)})"
        return c

    rows = ", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in KNOWN)
    return f"""
WITH v(license, text) AS (VALUES {rows}),
f AS (SELECT license, text FROM v UNION ALL SELECT license, split_part(text, '{END}', 1) FROM v WHERE contains(text, '{END}') UNION ALL SELECT license, split_part(text, '{END}', 1) || '{END}' FROM v WHERE contains(text, '{END}')),
c AS (SELECT license, {words(clean("text"))} AS c FROM f),
k AS (SELECT md5(c) AS digest, min(license) AS license, max(length(c) <= {LINE}) AS line FROM c WHERE c <> '' GROUP BY 1),
d AS (SELECT row_number() OVER () AS r, doc_id, {clean("text")} AS clean FROM documents),
l AS (SELECT r, k.license FROM (SELECT r, unnest(string_split(clean, chr(10))) AS line FROM d) x JOIN k ON k.line AND md5({words("x.line")}) = k.digest),
n AS (SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS notices, count(*) AS n_notices FROM l GROUP BY r)
SELECT doc_id, md5({words("d.clean")}) AS digest, k.license, coalesce(notices, '') AS notices, CAST(coalesce(n_notices, 0) AS BIGINT) AS n_notices
FROM d LEFT JOIN k ON md5({words("d.clean")}) = k.digest LEFT JOIN n USING (r)
"""


SQL = _sql()
