"""Licence texts by canonical digest.

A text is brought to a canonical form (ASCII lower case, no copyright lines, equivalent spellings made one, everything but
letters and digits a single blank) and its SHA-256 is joined to the digests of known licences.  Units are the whole document and
each of its lines, so a document that is a licence is found as well as a notice inside one.  DataFrame functions only.

A whole document has a second form in which only lines that state a copyright are dropped, not every line that starts with the word:
wrapped licence texts have such lines.  The full texts in ``licenses`` are known in both forms.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that licence matching treats as equal.
SPELLINGS = [
    ("licence", "license"), ("acknowledgement", "acknowledgment"), ("organisation", "organization"), ("authoris", "authoriz"), ("recognis", "recogniz"),
    ("judgement", "judgment"), ("favour", "favor"), ("honour", "honor"), ("whilst", "while"), ("fulfilment", "fulfillment"), ("per cent", "percent"),
    ("merchantibility", "merchantability"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("copyright owner", "copyright holder"), ("https", "http"),
]

#: Notices and short licences in their published wording.
KNOWN = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
        CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
        SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
        above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
        WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY
        SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION
        OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS
        PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
        FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING
        FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH
        THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
        arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications,
        and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you
        must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would
        be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
        original software. 3. This notice may not be removed or altered from any source distribution."""),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line that names a copyright or reserves rights, with its line end.
RIGHTS = r"(?m)^[^a-z0-9\n]*(?:copyright\b|\(c\)|©|copr\b|all rights reserved\b)[^\n]*$"
#: A line that states a copyright: the word and a sign, a year or a place for one.
STATED = (r"(?m)^[^a-z0-9\n]*(?:(?:copyright|copr)\b[^a-z0-9\n©]*(?:c\)|©|(?:19|20)[0-9]{2}\b|yyyy|year\b|notice[^a-z0-9\n]*$)|\(c\)[^a-z0-9\n]*(?:copyright\b|(?:19|20)[0-9]{2}\b)"
          r"|©|all rights reserved\b)[^\n]*$")
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "0BSD License"],
    "Zlib": ["zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License"],
    "Unlicense": ["The Unlicense", "Unlicense"],
    "MPL-2.0": [], "MPL-1.1": [], "Apache-2.0": [], "GPL-2.0": [], "GPL-3.0": [], "LGPL-2.1": [], "LGPL-3.0": [], "CC0-1.0": [], "CC-BY-SA-4.0": [],
}
OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def canonical(text: Column, dropped: str = RIGHTS) -> Column:
    """The canonical form without the lines ``dropped``; null becomes empty."""
    x = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), dropped, "")
    x = F.trim(F.regexp_replace(x, OTHER, " "))
    for one, other in SPELLINGS:
        x = F.replace(x, F.lit(one), F.lit(other))
    return x


def full_texts() -> list[tuple[str, str]]:
    """``license_id, text``: the long texts of ``KNOWN`` and the files in ``licenses``, bare and under each usual title.

    Instructions behind "END OF TERMS AND CONDITIONS" may be missing, and numbers of clauses may be bullets (BSD).
    """
    files = [(p.stem, p.read_text("utf-8")) for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))]
    out = [(i, b) for i, b in KNOWN if i in TITLES and len(b) > 500] + files
    out += [(i, b[:at.end()]) for i, b in out if (at := re.search("END OF TERMS AND CONDITIONS", b))]
    out += [(i, re.sub(r"(?m)^[0-9]\. ", "* ", b)) for i, b in out if i.startswith("BSD")]
    return out + [(i, f"{t}\n\n{b}") for i, b in out for t in TITLES[i]]


def known_digests(spark: SparkSession, known: list[tuple[str, str]] = KNOWN, full: list[tuple[str, str]] | None = None) -> DataFrame:
    """``digest, license_id, size`` of the known texts and the ``full`` ones (``full_texts()``); equal canonical texts under several ids stay several rows."""
    rows = spark.createDataFrame(known, "license_id string, body string").select("license_id", canonical(F.col("body")).alias("body"))
    full = full_texts() if full is None else full
    if full:
        texts = spark.createDataFrame(full, "license_id string, body string")
        forms = F.array(canonical(F.col("body")), canonical(F.col("body"), STATED))
        rows = rows.unionByName(texts.select("license_id", F.explode(forms).alias("body")))
    return rows.filter(F.length("body") > 0).select(F.sha2("body", 256).alias("digest"), "license_id", F.length("body").alias("size")).distinct()


def scan(docs: DataFrame, known: DataFrame, doc_id: str = "doc_id", text: str = "text", max_broadcast_rows: int = 100_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, is_license (the whole document is a known text), n_lines (matching lines), license_ids (distinct, sorted, comma-joined).

    Null, empty and copyright-only texts match nothing and give ``false, 0, ''``.  Long texts are taken whole, repeated rows and ids are judged one by one; other columns are not
    read; no documents give no rows and no known texts no matches.
    """
    facts = known.agg(F.count("*").alias("n"), F.min("size").alias("lo"), F.max("size").alias("hi")).first()  # one row
    lo, hi = facts["lo"] or 1, facts["hi"] or 0
    whole = F.struct(F.lit(True).alias("whole"), canonical(F.col("text")).alias("body"))
    # without such a word both forms are equal
    differs = F.lower(F.coalesce("text", F.lit(""))).rlike(r"copr|copyright|\(c\)|©|all rights reserved")
    second = F.when(differs, F.array(F.struct(F.lit(True).alias("whole"), canonical(F.col("text"), STATED).alias("body")))).otherwise(F.array().cast("array<struct<whole:boolean,body:string>>"))
    # a line's canonical form is at most twice its length (spellings grow by one letter in seven), so others can't match
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.length(x) >= lo // 2)
    units = F.concat(F.array(whole), second, F.transform(lines, lambda x: F.struct(F.lit(False).alias("whole"), canonical(x).alias("body"))))
    numbered = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = numbered.select("_row", "doc_id", F.explode(units).alias("u"))
    rows = rows.filter(F.col("u.whole") | F.length("u.body").between(lo, hi))
    rows = rows.select("_row", "doc_id", "u.whole", F.when(F.length("u.body").between(lo, hi), F.sha2("u.body", 256)).otherwise(F.lit("")).alias("digest"))
    named = known.groupBy("digest").agg(F.collect_set("license_id").alias("ids"))
    named = F.broadcast(named) if facts["n"] <= max_broadcast_rows else named
    hits = rows.join(named, "digest", "left").filter(F.col("whole") | F.col("ids").isNotNull())
    out = hits.groupBy("_row", "doc_id").agg(
        F.bool_or(F.col("whole") & F.col("ids").isNotNull()).alias("is_license"),
        F.sum(F.when(~F.col("whole") & F.col("ids").isNotNull(), 1).otherwise(0)).alias("n_lines"),
        F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.coalesce("ids", F.array().cast("array<string>")))))), ",").alias("license_ids"),
    )
    return out.select("doc_id", "is_license", "n_lines", "license_ids")


def oracle(known: list[tuple[str, str]] = KNOWN) -> str:
    """The scan of ``documents`` as DuckDB SQL."""

    def canon(x: str) -> str:
        x = f"regexp_replace(translate(coalesce({x}, ''), '{UPPER}', '{LOWER}'), '{RIGHTS}', '', 'g')"
        x = f"trim(regexp_replace({x}, '{OTHER}', ' ', 'g'))"
        for one, other in SPELLINGS:
            x = f"replace({x}, '{one}', '{other}')"
        return x

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    values = ", ".join(f"({quoted(i)}, {quoted(b)})" for i, b in known)
    return f"""
with k as (select distinct license_id, {canon('body')} body from (values {values}) v(license_id, body)),
u as (select doc_id, true whole, {canon('text')} body from documents
      union all select doc_id, false, {canon('line')} from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line from documents)),
h as (select doc_id, whole, license_id, row_number() over (partition by doc_id, whole, u.body) n from u join k on u.body = k.body and k.body <> ''),
c as (select doc_id, count(*) n_lines from u where not whole and body <> '' and body in (select body from k) group by doc_id),
i as (select doc_id, bool_or(whole) w, string_agg(distinct license_id, ',' order by license_id) ids from h group by doc_id)
select d.doc_id, coalesce(i.w, false) is_license, coalesce(c.n_lines, 0) n_lines, coalesce(i.ids, '') license_ids
from documents d left join c using (doc_id) left join i using (doc_id)"""
