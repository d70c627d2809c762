"""Licence scans by canonical digest. DataFrame functions only.

A text is made canonical: lower case; lines that state a copyright dropped; everything but letters and digits dropped; of
words with several spellings one taken; and all words written without a space between them, so that neither line ends nor
hyphens matter. The digest of the whole canonical text is joined to the digests of known licences: the texts below, and the
files in the folder `licenses`. Each line is a text of its own too, whose digest is looked up in the same table, for grants
of one line inside a longer text.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words with several spellings: these stems, with each of the endings, count as the others. Fixed values.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorise", "authorize"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("categorise", "categorize"),
    ("centre", "center"),
    ("emphasise", "emphasize"),
    ("favour", "favor"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("https", "http"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("owner", "holder"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("sublicence", "sublicense"),
    ("unauthorised", "unauthorized"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
)
ENDINGS = ("", "s", "d")
SAME = {a + end: b + end for a, b in SPELLINGS for end in ENDINGS}

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
ISC_TAIL = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
#: Known texts (licence id, text): whole licences, notices and grants of one line. Fixed values.
KNOWN = (
    ("MIT", MIT),
    ("MIT", "MIT License\n" + MIT),
    ("MIT", "The MIT License (MIT)\n" + MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("BSD-2-Clause", "\n".join((BSD_HEAD, BSD_TAIL))),
    ("BSD-2-Clause", "\n".join(("BSD 2-Clause License", BSD_HEAD, BSD_TAIL))),
    ("BSD-3-Clause", "\n".join((BSD_HEAD, BSD_THIRD, BSD_TAIL))),
    ("BSD-3-Clause", "\n".join(("BSD 3-Clause License", BSD_HEAD, BSD_THIRD, BSD_TAIL))),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("ISC", f"{ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{ISC_TAIL}"),
    ("ISC", f"ISC License\n{ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{ISC_TAIL}"),
    ("0BSD", f"{ISC_GRANT}.\n{ISC_TAIL}"),
    ("Zlib", ZLIB),
    ("Zlib", "zlib License\n" + ZLIB),
    ("Apache-2.0", APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
)
#: Known texts of whole licences that are too long to stand here, by licence.
FILES = Path(__file__).parent / "licenses"
#: After these words at the beginning of a line, which is in lower case, "copyright" states none. Fixed values.
LEGAL = "holders?|owners?|notices?|licen[cs]e[sd]?|laws?|statements?|acts?|and|or|interests?|in|on|of|to|is|are|as|for|treaty|protection|doctrines?|rights?|permissions?|claims?|infringement|disclaimers?|status|ownership|under|if|that|which|with|may|shall|also|does|information|material|works?|resulting|patents?|lines?|those|the (?:software|library|program|work)"
#: A word that holds the place of "copyright" there, and lines that state a copyright. The flags make line ends the same
#: everywhere.
HELD = "copyrightheld"
NO_STATEMENT = rf"(?md)^([^\p{{L}}\n]*)copyright([^\p{{L}}\n]+(?:{LEGAL})\b)"
COPYRIGHT_LINE = r"(?md)^(?:[^\p{L}\n]*(?:portions )?copyright\b[^\n]*|[^\p{L}\n]*\(c\)[^\p{L}\n]*(?:copyright|[0-9]{4})[^\n]*|[^\p{L}\n]*©[^\n]*|[^\n]*\ball rights reserved\b[^\n]*)$"
SYMBOLS = r"[^\p{L}\p{N}\n]+"


def known() -> list[tuple[str, str]]:
    """All known texts (licence id, text). A file counts with its title and appendix, and without either."""
    out = list(KNOWN) + [(i, re.sub(r"(?m)^[0-9]\. ", "", t)) for i, t in KNOWN if i.startswith("BSD")]
    for file in sorted(FILES.glob("*.txt")):
        text = file.read_text()
        body, _, _ = text.partition("END OF TERMS AND CONDITIONS")
        forms = [text, body, body + "END OF TERMS AND CONDITIONS"] if body != text else [text]
        out += [(file.stem, f) for f in forms]
    return out


def canonical_lines(text: Column) -> Column:
    """The text's canonical form with its line ends."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NO_STATEMENT, f"$1{HELD}$2")
    out = F.replace(F.regexp_replace(out, COPYRIGHT_LINE, ""), F.lit(HELD), F.lit("copyright"))
    words = F.split(F.replace(F.regexp_replace(out, SYMBOLS, " "), F.lit("\n"), F.lit(" \n ")), " ")
    same = F.create_map(*[F.lit(x) for pair in sorted(SAME.items()) for x in pair])
    return F.array_join(F.transform(words, lambda w: F.when(w.isin(sorted(SAME)), same[w]).otherwise(w)), "")


def unbroken(form: Column) -> Column:
    return F.replace(form, F.lit("\n"), F.lit(""))


def canonical(text: Column) -> Column:
    return unbroken(canonical_lines(text))


def known_digests(spark: SparkSession) -> dict[str, str]:
    """The licence of each known digest, from a table of a fixed number of rows."""
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("license"), F.lit(t).alias("text")) for i, t in known()]))
    found = spark.range(1).select(rows.alias("r")).select("r.license", F.sha2(canonical(F.col("r.text")), 256).alias("digest"))
    return {r["digest"]: r["license"] for r in found.groupBy("digest").agg(F.min("license").alias("license")).collect()}


def licensed(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns of every row, with canonical_sha256, license (of the whole text, or null), and line_licenses.

    line_licenses lists the licences of lines that are known texts, sorted, each once, joined by commas. A null text
    counts as empty; an empty canonical text matches nothing, as no known text is empty. Repeated rows each keep their
    row; very long texts and lines are treated like others; an empty table gives an empty result. Columns that are not
    kept are not read; a kept column may have any name but those of the result.
    """
    spark = docs.sparkSession
    digests = known_digests(spark)
    of = F.create_map(*[F.lit(x) for pair in sorted(digests.items()) for x in pair])
    rows = docs.select(F.struct(*keep).alias("kept"), canonical_lines(F.col(text)).alias("form"))
    found = F.filter(F.transform(F.split("form", "\n"), lambda x: F.sha2(x, 256)), lambda x: x.isin(sorted(digests)))
    line_licenses = F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda x: of[x]))), ",")
    rows = rows.select("kept", F.sha2(unbroken(F.col("form")), 256).alias("canonical_sha256"), line_licenses.alias("line_licenses"))
    table = F.explode(F.array(*[F.struct(F.lit(d).alias("canonical_sha256"), F.lit(i).alias("license")) for d, i in sorted(digests.items())]))
    whole = spark.range(1).select(table.alias("r")).select("r.*")  # as many rows as known texts
    return rows.join(F.broadcast(whole), "canonical_sha256", "left").select("kept.*", "canonical_sha256", "license", "line_licenses")


def canonical_sql(text: str) -> str:
    """canonical_lines() as SQL."""
    plain = lambda pattern: pattern.replace("(?md)", "(?m)")
    out = f"regexp_replace(lower(coalesce({text}, '')), '{plain(NO_STATEMENT)}', '\\1{HELD}\\2', 'g')"
    out = f"replace(regexp_replace({out}, '{plain(COPYRIGHT_LINE)}', '', 'g'), '{HELD}', 'copyright')"
    out = f"string_split(replace(regexp_replace({out}, '{SYMBOLS}', ' ', 'g'), chr(10), ' ' || chr(10) || ' '), ' ')"
    same = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in sorted(SAME.items()))
    return f"array_to_string(list_transform({out}, lambda w: CASE w {same} ELSE w END), '')"


def licensed_sql() -> str:
    values = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in known())
    return f"""
    WITH k AS (SELECT canonical, min(license) AS license FROM (SELECT license, replace({canonical_sql("text")}, chr(10), '') AS canonical FROM (VALUES {values}) AS v(license, text)) GROUP BY canonical),
    d AS (SELECT doc_id, row_number() OVER () AS n, {canonical_sql("text")} AS form FROM documents),
    l AS (SELECT n, string_agg(DISTINCT license, ',' ORDER BY license) AS line_licenses
        FROM (SELECT n, unnest(string_split(form, chr(10))) AS line FROM d) JOIN k ON line = canonical GROUP BY n),
    w AS (SELECT *, replace(form, chr(10), '') AS whole FROM d)
    SELECT doc_id, sha256(whole) AS canonical_sha256, k.license AS license, coalesce(line_licenses, '') AS line_licenses
    FROM w LEFT JOIN k ON whole = k.canonical LEFT JOIN l USING (n)
    """
