"""Licence scan: canonical digests of whole texts, joined to the digests of known licences.

Canonical form: lower case, equivalent spellings as one, punctuation as a space, lines that state a copyright left out, and a
first one that only names the licence, white space as single spaces.  So it does not matter how a text is wrapped; a line of running prose
that begins with "copyright" stays.  The table of known licences is a parameter with few rows, so it is broadcast.
One-line notices inside other texts are found too, by the canonical line itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

# Texts of known licences.
_PERMISSION = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_DISCLAIMER = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution."
_BOOST = "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_UNLICENSE = "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>"
_APACHE_NOTICE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
# Whole texts, without their copyright lines and titles.
TEXTS = (
    ("MIT", _PERMISSION),
    ("ISC", _GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _DISCLAIMER),
    ("ISC", _GRANT.replace("and/or", "and") + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _DISCLAIMER),
    ("0BSD", _GRANT + ".\n\n" + _DISCLAIMER),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_NAMES + _BSD_END),
    ("Zlib", _ZLIB),
    ("BSL-1.0", _BOOST),
    ("Unlicense", _UNLICENSE),
    ("Apache-2.0", _APACHE_NOTICE),
)
# One-line notices.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
)
# Digests of the canonical form of long licence texts, as published.
DIGESTS = (
    ("Apache-2.0", "e87dea5078ce2faaea46d3475af18d30a5c0ac0f09425b60b3e0c6569f72f8d2"),
    ("GPL-1.0", "9e12a40a9b22c45d116f19e1746b08ea0b853519de3e03ceb780f2a36d5f388c"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "0d3c171c5c43c8ba6cb7c5850249fc6766dd85cca709271b31086b150e91716e"),
    ("LGPL-2.0", "289c8b47fa0ec7e5f22cd33d32feaa06f015b0f2fdb9ad916979b1011ca8c015"),
    ("LGPL-2.1", "5ddd6039d3b090c51328879800301dd19b1ad99e14d00f3c6f221ab45a32db57"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("Artistic-1.0", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("GFDL-1.2", "1c057ea35084eb195331cec1a49fca335c176422a7726a9a23636906fd4e241f"),
    ("GFDL-1.3", "7e8edd3abe6258bb82bb853d91a0c24fcd9976894fd0592747354cffe1cb18e7"),
)
#: Equivalent spellings, after the matching guidelines of the SPDX licence list.
SPELLINGS = (("©", " copyright "), ("licence", "license"), ("organis", "organiz"), ("authoris", "authoriz"), ("recognis", "recogniz"), ("favour", "favor"), ("fulfilment", "fulfillment"), ("whilst", "while"), ("acknowledgement", "acknowledgment"), ("and/or", "and or"))
#: And those of several words, which a line may end between.
PHRASES = (("sub license", "sublicense"), ("non commercial", "noncommercial"), ("per cent", "percent"))
# How canonical lines begin that state a copyright, and those that only speak of it.
STATEMENT = r"^((copyright|c)( c| copyright)* [0-9]{4}( .*)?|copyright( c| copyright| by)*( [^ ]+){1,12}|all rights reserved)$"
PROSE = r"^copyright (notices?|holders?|owners?|licenses?|laws?|statements?|interests?|rights?|acts?|treaty|treaties|protection|permission|status|disclaimers?|infringement|claims?|terms?|doctrines?|and|or|in|on|to|as|if|is|are|for|that|with|will|would|shall|may|resulting|resides)( |$)"
#: A first line that only names a licence.
TITLE = r"^(the )?(mit|isc|expat|x11|zlib|boost software|0bsd|((new|modified|simplified|revised|original) )?bsd( zero clause| [0-9] clause)?|[0-9] clause bsd|zero clause bsd) license( (mit|isc|expat|zlib|0bsd|version [0-9 ]+|version 1 0 august 17th 2003))?$"


def canonical_lines(text: Column) -> Column:
    """Canonical lines that aren't empty and state no copyright, without a first one that only names a licence."""
    text = F.lower(text)
    for other, one in SPELLINGS:
        text = F.replace(text, F.lit(other), F.lit(one))
    text = F.regexp_replace(text, r"[^\p{L}\p{N}\n]+", " ")
    stays = lambda x: (x != "") & ~(x.rlike(STATEMENT) & ~x.rlike(PROSE))
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), stays)
    # As the element of an array the lines are made once, though they are looked at twice.
    return F.transform(F.array(lines), lambda x: F.when(F.get(x, 0).rlike(TITLE), F.slice(x, 2, F.size(x))).otherwise(x))[0]


def joined(lines: Column) -> Column:
    text = F.array_join(lines, " ")
    for other, one in PHRASES:
        text = F.replace(text, F.lit(other), F.lit(one))
    return text


def canonical(text: Column) -> Column:
    return joined(canonical_lines(text))


def known_licences(spark: SparkSession, texts: tuple = TEXTS + NOTICES, digests: tuple = DIGESTS) -> DataFrame:
    """(digest, licence) of each known text; of two with one digest the first by name."""
    rows = spark.createDataFrame(list(texts), "licence string, text string").select("licence", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    rows = rows.unionByName(spark.createDataFrame(list(digests), "licence string, digest string"))
    return rows.groupBy("digest").agg(F.min("licence").alias("licence"))


def scan_licences(docs: DataFrame, texts: tuple = TEXTS + NOTICES, digests: tuple = DIGESTS, notices: tuple = NOTICES) -> DataFrame:
    """One row for each row of docs: doc_id, licence, notices, n_notices, text_digest.

    licence: that of the whole canonical text, null if unknown.  notices: the licences whose notices are lines of the
    document, sorted, with commas; n_notices: such lines.  Null and empty texts have the digest of the empty text and
    match nothing unless it is listed.  Rows are judged one by one, so shared or null ids and repeated rows don't
    matter.  docs needs doc_id and text; other columns are ignored.  An empty table gives no row.
    """
    spark = docs.sparkSession
    known = F.broadcast(known_licences(spark, texts, digests).withColumnRenamed("digest", "text_digest"))  # as many rows as are listed, at most
    # As many lines as are listed: short texts that are compared as they are.
    lines = spark.createDataFrame(list(notices), "licence string, text string").select("licence", canonical(F.col("text")).alias("line")).groupBy("line").agg(F.min("licence").alias("licence")).collect()
    named = F.create_map(*(F.lit(x) for r in lines for x in (r["line"], r["licence"]))) if lines else F.lit(None).cast("map<string,string>")
    rows = docs.select("doc_id", canonical_lines(text_of(docs)).alias("lines"))
    found = F.filter(F.transform("lines", lambda x: F.try_element_at(named, x)), lambda x: x.isNotNull())
    rows = rows.select("doc_id", F.sha2(joined(F.col("lines")), 256).alias("text_digest"), found.alias("found"))
    names = F.array_join(F.array_sort(F.array_distinct("found")), ",")
    return rows.join(known, "text_digest", "left").select("doc_id", "licence", names.alias("notices"), F.size("found").cast("long").alias("n_notices"), "text_digest")


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))


def _sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"

    def lines(text: str) -> str:
        text = f"lower({text})"
        for other, one in SPELLINGS:
            text = f"replace({text}, {quote(other)}, {quote(one)})"
        text = rf"string_split(regexp_replace({text}, '[^\p{{L}}\p{{N}}\n]+', ' ', 'g'), chr(10))"
        drop = f"(regexp_matches(x, {quote(STATEMENT)}) AND NOT regexp_matches(x, {quote(PROSE)}))"
        kept = f"list_filter(list_transform({text}, lambda x: trim(x)), lambda x: x <> '' AND NOT {drop})"
        return f"list_transform([{kept}], lambda y: CASE WHEN regexp_matches(y[1], {quote(TITLE)}) THEN y[2:] ELSE y END)[1]"

    def body(text: str) -> str:
        text = f"array_to_string({text}, ' ')"
        for other, one in PHRASES:
            text = f"replace({text}, {quote(other)}, {quote(one)})"
        return text

    rows = lambda pairs: ", ".join(f"({quote(a)}, {quote(b)})" for a, b in pairs)
    return f"""
WITH n AS (SELECT {body(lines('text'))} AS line, min(licence) AS licence FROM (VALUES {rows(NOTICES)}) v(licence, text) GROUP BY 1),
     k AS (SELECT digest, min(licence) AS licence FROM (
             SELECT sha256({body(lines('text'))}) AS digest, licence FROM (VALUES {rows(TEXTS + NOTICES)}) v(licence, text)
             UNION ALL SELECT digest, licence FROM (VALUES {rows(DIGESTS)}) v(licence, digest)) GROUP BY 1),
     d AS (SELECT row_number() OVER () AS r, doc_id, {lines("coalesce(text, '')")} AS lines FROM documents),
     f AS (SELECT r, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices, count(*) AS n_notices
           FROM (SELECT r, unnest(lines) AS line FROM d) l JOIN n USING (line) GROUP BY r)
SELECT d.doc_id, k.licence, coalesce(f.notices, '') AS notices, coalesce(f.n_notices, 0) AS n_notices, sha256({body('d.lines')}) AS text_digest
FROM d LEFT JOIN f ON f.r = d.r LEFT JOIN k ON k.digest = sha256({body('d.lines')})
"""


SQL = _sql()
