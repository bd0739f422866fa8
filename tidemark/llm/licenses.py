"""Licence texts by canonical digest.

A text is brought to a canonical form - lower case, one spelling for words that licences spell in two ways, a title line and
copyright lines (those with a year or a holder's sign) out, everything but letters and digits one space, so wrapping doesn't
matter - and its SHA-256 joined to the digests of known licences in the same form: those of TEXTS and DIGESTS, or any table of digests
that the caller gives. That finds whole texts; since documents more often carry a one-line notice, the lines that speak of a licence
are looked up in the same way among known notices. Only column functions, one scan, and a broadcast of the few known digests.

Defined results: null and blank texts match nothing and have a null digest; each row is returned; an empty table gives no
rows. A text of several whole licences is none of them.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

# Texts and notices of well-known public licences.
_GRANT = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE'
    " WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR"
    " COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR"
    " OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL'
    " IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,"
    " INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN"
    " ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF"
    " THIS SOFTWARE."
)
TEXTS: dict[str, str] = {
    "MIT": "MIT License\n\nCopyright (c) <year> <holder>\n\nPermission is hereby granted, free of charge, to any person obtaining a copy"
    ' of this software and associated documentation files (the "Software"), to deal in the Software without restriction,'
    " including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies"
    " of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following"
    " conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial"
    " portions of the Software.\n\n" + _GRANT,
    "ISC": "ISC License\n\nCopyright (c) <year> <holder>\n\nPermission to use, copy, modify, and/or distribute this software for any"
    " purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice"
    " appear in all copies.\n\n" + _ISC_END,
    "0BSD": "BSD Zero Clause License\n\nCopyright (c) <year> <holder>\n\nPermission to use, copy, modify, and/or distribute this"
    " software for any purpose with or without fee is hereby granted.\n\n" + _ISC_END,
}
_BSD_HEAD = (
    "Copyright (c) <year> <holder>\n\nRedistribution and use in source and binary forms, with or without modification, are permitted provided"
    " that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of"
    " conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of"
    " conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from"
    " this software without specific prior written permission.\n\n"
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT'
    " LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE"
    " COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES"
    " (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)"
    " HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)"
    " ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEXTS["BSD-2-Clause"] = "BSD 2-Clause License\n\n" + _BSD_HEAD + _BSD_END
TEXTS["BSD-3-Clause"] = "BSD 3-Clause License\n\n" + _BSD_HEAD + _BSD_THIRD + _BSD_END
TEXTS["Unlicense"] = (
    "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell,"
    " or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by"
    " any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright"
    " interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of"
    " our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights"
    ' to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING'
    " BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS"
    " BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN"
    " CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>"
)
#: Digests of the canonical forms of long texts.
DIGESTS: dict[str, str] = {
    "Apache-2.0": "d711f2e1f1a0c8a5ca17e04167d59ac7b855cdd2bb99a9c7b6a8179bedd754c9",
    "GPL-2.0": "29507662ad31f55a5ac02f26a5d8cca21add440b2dff4a9ce97e458a0ca43f7f",
    "GPL-3.0": "25c090443e3540e3493172ea88c9181108effea290e12e68da7dcd1c51b4cd7a",
    "LGPL-2.1": "50866b22e296e073a398813dc84c4c9dec94ed1ee7d617c063eb6851a562b9d4",
    "LGPL-3.0": "e1c7b25e9116bcad127297bbfb82e6a89822822ba6bfa3af9eae995aad877765",
    "MPL-2.0": "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a",
    "CC0-1.0": "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    "Artistic-1.0": "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702",
    "MPL-1.1": "1e5b0d6626b98e9f07d4d62fc1b060e7ddfc9f94ad38ae53dcc7d5c484db310c",
    "GFDL-1.3": "24483827fdcab070dc64c6a0befe6fe64bdb823b040af911820bc5b81121dfe3",
}
_CC = ("CC BY 4.0", "CC BY-NC 4.0", "CC BY-SA 4.0", "CC BY-ND 4.0", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0", "CC BY 3.0", "CC BY-SA 3.0", "CC0 1.0")
_GNU = {"GPL": "GNU General Public License", "LGPL": "GNU Lesser General Public License", "AGPL": "GNU Affero General Public License"}
_IDS = ("Apache-2.0", "MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Unlicense", "MPL-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")
#: (licence, notice).
NOTICES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
    *((c.replace(" ", "-"), f"Licensed under {c}.") for c in _CC),
    *((f"{k}-{v}.0", f"This {what} is licensed under the {name}, version {v}.") for k, name in _GNU.items() for v in (2, 3) for what in ("work", "program", "software")),
    *((i, f"SPDX-License-Identifier: {i}") for i in _IDS),
]
#: Spellings that count as equal: pattern over lower-case text, and the one that stands for all.
SPELLINGS: list[tuple[str, str]] = [("licence", "license"), ("sub-license", "sublicense"), ("non-infringement", "noninfringement"), ("whilst", "while"), ("favour", "favor"), ("organisation", "organization")]
#: A title as the first line, over lower-case text.
TITLE = r"^[ \t\n]*(the )?[a-z0-9][a-z0-9 .-]{0,40} license( \([a-z0-9 .-]+\))?[ \t]*\n"
#: Copyright lines have a year or a holder's sign; other lines may begin with the word too where a text is wrapped.
COPYRIGHT_LINE = r"(^|\n)[ \t]*(copyright[ \t]*(\(c\)|©|<year>|\[y|[12][0-9]{3})|\(c\)[ \t]*(<year>|[12][0-9]{3})|©)[^\n]*"
#: What a copyright line says of rights, which counts as its notice.
RESERVED = r"^[ \t]*(copyright|\(c\)|©)[^\n]*(all rights reserved)"
#: Rows of a given table of digests that are broadcast at most.
BROADCAST_ROWS = 100_000
SPEAKS = r"licen[cs]e|rights reserved"
#: Not a letter or digit.
GAP = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    c = F.lower(text)
    for other, one in SPELLINGS:
        c = F.regexp_replace(c, F.lit(other), F.lit(one))
    for pattern in (TITLE, COPYRIGHT_LINE, GAP):
        c = F.regexp_replace(c, F.lit(pattern), F.lit(" "))
    return F.trim(c)


def digest(text: Column) -> Column:
    """Null where nothing is left of the text."""
    c = canonical(text)
    return F.when(c != "", F.sha2(c, 256))


def known(spark: SparkSession, texts: list[tuple[str, str]]) -> DataFrame:
    """(license_id, known_digest) for the given (license_id, text)."""
    return spark.createDataFrame(texts, "license_id string, t string").select("license_id", digest(F.col("t")).alias("known_digest"))


def licences(spark: SparkSession) -> DataFrame:
    """(license_id, known_digest) of the licences known here; a fixed, small table."""
    return known(spark, sorted(TEXTS.items())).unionByName(spark.createDataFrame(sorted(DIGESTS.items()), "license_id string, known_digest string"))


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), table: DataFrame | None = None, rows: int = 0) -> DataFrame:
    """`keep` with text_digest, license_id of the whole text or null, and notices: licences that lines name, sorted, comma-joined.

    table: (license_id, known_digest) in place of the licences known here, one row per digest, and its number of rows; it is broadcast up to
    BROADCAST_ROWS and else joined by a shuffle."""
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda line: F.lower(line).rlike(SPEAKS))
    notices = [(c[0], c[1]) for c in known(docs.sparkSession, NOTICES).collect()]
    by_digest = F.create_map(*chain.from_iterable((F.lit(d), F.lit(n)) for n, d in sorted(notices)))
    said = lambda line: digest(F.regexp_replace(F.lower(line), F.lit(RESERVED), F.lit("$2")))
    found = F.filter(F.transform(lines, lambda line: F.element_at(by_digest, F.coalesce(said(line), F.lit("")))), lambda n: n.isNotNull())
    got = docs.select(*keep, digest(F.col(text)).alias("text_digest"), F.array_join(F.array_sort(F.array_distinct(found)), ",").alias("notices"))
    table = F.broadcast(licences(docs.sparkSession)) if table is None else F.broadcast(table) if rows <= BROADCAST_ROWS else table
    return got.join(table, got["text_digest"] == F.col("known_digest"), "left").select(*keep, "text_digest", "license_id", "notices")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def _oracle() -> str:
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def canon(c: str) -> str:
        c = f"lower({c})"
        for other, one in SPELLINGS:
            c = f"replace({c}, '{other}', '{one}')"
        for pattern in (TITLE, COPYRIGHT_LINE, GAP):
            c = f"regexp_replace({c}, {quoted(pattern)}, ' ', 'g')"
        return f"trim({c})"

    def values(rows) -> str:
        return ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in rows)

    said = canon(f"regexp_replace(lower(line), {quoted(RESERVED)}, '\\2')")

    return f"""
WITH texts AS (SELECT license_id, sha256({canon('t')}) AS k FROM (VALUES {values(TEXTS.items())}) AS v(license_id, t)
    UNION ALL SELECT * FROM (VALUES {values(DIGESTS.items())}) AS v(license_id, k)),
notices AS (SELECT license_id, sha256({canon('t')}) AS k FROM (VALUES {values(NOTICES)}) AS v(license_id, t)),
d AS (SELECT doc_id, {canon('text')} AS c, text FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
said AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices
         FROM lines JOIN notices ON sha256({said}) = k WHERE regexp_matches(lower(line), '{SPEAKS}') GROUP BY doc_id)
SELECT doc_id, CASE WHEN c <> '' THEN sha256(c) END AS text_digest, license_id, coalesce(notices, '') AS notices
FROM d LEFT JOIN texts ON c <> '' AND sha256(c) = k LEFT JOIN said USING (doc_id)"""


OP9_SQL = _oracle()
