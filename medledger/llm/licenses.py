"""Licence scan by canonical digests of whole texts, with DataFrame functions.

A text is brought to a canonical form (lower case; no copyright lines; equivalent spellings made one;
punctuation and white space to single spaces), and the SHA-256 of that form is joined with the digests of
known licences and licence notices. Two units of a document are looked up as entire texts: the document
itself and each of its lines, so a licence file is found and so is a notice line in prose. A text that only
mentions a licence has no digest in common with it.

The known texts are a table (``license``, ``text``), canonicalised by the same expressions; ``known_texts``
gives the short licences and common notices below. Long licences are known by their digests alone
(``license``, ``digest``; ``known_digests``). Documents are digested in one pass; only digests and ids
move. Lines are looked up with distinct digests of the known texts, which Spark broadcasts when they are
small and joins by a shuffle otherwise; a hot line is one digest, and its rows are spread by the adaptive
skew join.

Defined cases: a null or empty text, or one that is nothing but copyright lines and signs, has an empty
canonical form and matches nothing; a null id stays null; repeated rows are scanned row by row; if several
known names have one digest, the first in the alphabet is reported; an empty table gives an empty result; no
known texts: nothing matches. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medledger.session import cut_lineage

#: Equivalent spellings (pattern, replacement), applied to lower-cased text in this order.
EQUIVALENT = (
    ("licen[cs]e", "license"), ("licen[cs]ing", "licensing"), (r"sub[- ]license", "sublicense"), (r"non[- ]infringement", "noninfringement"),
    ("merchantibility", "merchantability"), ("favour", "favor"), ("organisation", "organization"), ("acknowledgement", "acknowledgment"),
    ("https://", "http://"), ("&", " and "), ("per cent", "percent"), ("copyright holder", "copyright owner"), (r"\bv(?:er(?:sion)?)?\.? ?([0-9])", "version $1"),
    (r"([0-9])\.0\b", "$1"),
)
COPYRIGHT_LINE = r"^[^\p{L}\p{N}\n(©]*(?:copyright[ \t]*(?:\(c\)|©|[0-9]{4})|(?:\(c\)|©)[ \t]*(?:copyright[ \t]*)?[0-9]{4}|all rights reserved).*$"


def canonical(text: Column) -> Column:
    """The canonical form, with line ends kept."""
    out = F.lower(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, "(?md)" + COPYRIGHT_LINE, "")
    for pattern, to in EQUIVALENT:
        out = F.regexp_replace(out, pattern, to)
    out = F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " ")
    return F.trim(F.regexp_replace(out, r" ?\n[ \n]*", "\n"))


def _digest(form: Column) -> Column:
    flat = F.trim(F.regexp_replace(form, r"\s+", " "))
    return F.when(flat != "", F.sha2(flat, 256))


def digest(text: Column) -> Column:
    """The digest of an entire text; null if nothing is left of it."""
    return _digest(canonical(text))


def digests(known: DataFrame, license: str = "license", text: str = "text") -> DataFrame:
    """digest and license, one row per digest."""
    made = known.select(F.col(license).alias("license"), digest(F.col(text)).alias("digest")).dropna()
    return made.groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame, doc_id: str = "doc_id", text: str = "text", listed: DataFrame | None = None) -> DataFrame:
    """``listed``: more known licences, by digest. Per row: doc_id, digest (of the entire text), license (of the entire text), notices (sorted names of
    licences that lines are, each once), notice_lines (how many lines are)."""
    table = digests(known)
    if listed is not None:
        table = table.unionByName(listed.select("digest", "license").dropna()).groupBy("digest").agg(F.min("license").alias("license"))
    table = cut_lineage(table)
    read = docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row"), canonical(F.col(text)).alias("form"))
    lines = F.filter(F.transform(F.split("form", "\n"), lambda s: _digest(s)), lambda d: d.isNotNull())
    # One pass over the texts; what is written has digests only.
    read = cut_lineage(read.select("doc_id", "row", _digest(F.col("form")).alias("digest"), lines.alias("lines")))
    named = table.select(F.col("digest").alias("line"), F.col("license").alias("notice"))
    found = read.select("row", F.explode("lines").alias("line")).join(named, "line")
    found = found.groupBy("row", "notice").agg(F.count(F.lit(1)).alias("n"))
    found = found.groupBy("row").agg(F.sort_array(F.collect_set("notice")).alias("notices"), F.sum("n").alias("notice_lines"))
    out = read.select("doc_id", "row", "digest").join(table, "digest", "left").join(found, "row", "left")
    return out.select("doc_id", "digest", "license", F.coalesce("notices", F.array().cast("array<string>")).alias("notices"),
                      F.coalesce("notice_lines", F.lit(0)).cast("long").alias("notice_lines"))


_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED
TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
_MAY = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""
#: Names and texts of short licences, and of notices that name a licence.
TEXTS = (
    ("MIT", f"""MIT License
Copyright (c) <year> <holder>
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
{_AS_IS}"""),
    ("ISC", f"""ISC License
{_MAY}, provided that the above copyright notice and this permission notice appear in all copies.
{_ISC_AS_IS}"""),
    ("0BSD", f"""BSD Zero Clause License
{_MAY}.
{_ISC_AS_IS}"""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"), ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
)


def known_texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEXTS), "license string, text string")


#: Names of long licences and the digests of their canonical forms, as their stewards publish them in plain
#: text (BSD-3-Clause: the wording that names the University and its contributors; GPL and LGPL: with the annexes).
DIGESTS = (
    ("Apache-2.0", "0c4aafcd372b29dce7002f5252605abd524f0606b733a205561cbc2f89f8b754"),
    ("Artistic-1.0-Perl", "bc4d0c00d493021b9f3b1041689fa28b4bf980cf2e37601f7cb475a7265e3b93"),
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("CC0-1.0", "edfcae7e301ff2624e2aa67f2bb0171018ce8aa6befdf1154ec830eb85592f3d"),
    ("GFDL-1.2", "66919c3537107c2c9f5219f6ba4c41fe9c0d7c14d885087e3db69494463a778e"),
    ("GFDL-1.3", "1fa4b7a342ee9057958409e8aa349ac2792dd592a1deae0de875a81075a3e82f"),
    ("GPL-1.0", "37f380f152339f34a15db620545eb53f0b5c7d9e6a9542aa09ed0d22f186920f"),
    ("GPL-2.0", "ae2be2aaa68f5e52ef402874fc8c7c691879b445cb12e49d84f88168cc2d7dd6"),
    ("GPL-3.0", "42b67f6c2a10d2b6cb4c48a2c1a454953ad6d664174e0493c9d92e45feb4b408"),
    ("LGPL-2.0", "bea988245c65edbddad6f43ff12ca2472c232324e916d42648b90eac944d833e"),
    ("LGPL-2.1", "ed875dac9045cba09a17867210991f3a4a82f80b82096b054560a3a8dae9d692"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "954b106eb60695f2558963d4146b6eb16fe31247a737e53ef3319973e9678bad"),
    ("MPL-2.0", "2638ec1de5f618d4d5adaf842aa68080d637d04880441753102cfff54099cca2"),
)


def known_digests(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DIGESTS), "license string, digest string")
