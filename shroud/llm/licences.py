"""Licence scans by canonical digest.

A text is put into canonical form: lines with a licence's title or a copyright holder go, letters A-Z become small, punctuation,
bullets and numbering become spaces, equivalent spellings become one, white space is collapsed. The
SHA-256 of the canonical text is joined to the digests of known licences (``LICENCES``, a bounded table, so it
is broadcast). Lines that speak of a licence are matched in the same way to known notices
(``NOTICES``), without dropping copyright lines.

Edge cases: null texts and texts without letters or digits have the digest of the empty text and no licence; repeated
rows get equal results; each row stands alone, so ties have no effect; an empty table gives an empty result; other input
columns are not read.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# --- fixed values: texts of licences ----------------------------------------------------------
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_END
_0BSD = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _ISC_END
_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
LICENCES = (("MIT", _MIT), ("ISC", _ISC), ("0BSD", _0BSD), ("BSD-2-Clause", _BSD_START + _BSD_END),
            ("BSD-3-Clause", _BSD_START + _BSD_NAMES + _BSD_END), ("Zlib", _ZLIB))
#: Digests of the canonical form of whole texts, as distributed (their texts are too long to hold here).
WHOLE = (("Apache-2.0", "4cacaf5c14ec5ed52b76639894bc698e2c791a0ce1db1db90110f73b86041807"),
         ("GPL-2.0", "5ca608bb2eb79eb10b1a80b55bb0a99df497ce228143b9d233b5df274e85643a"),
         ("GPL-3.0", "9212c5234c9184b16a86d4d19af68c8aa892802839d1fbc217c31237e083bca3"),
         ("MPL-2.0", "fc6db10715dd3f8d6886221817f28e3572f579a7a350ecd43e7cdc6607bf6ba7"))
# Names in notices, and the words that lead to them.
NAMES = (("MIT", ("MIT License",)), ("ISC", ("ISC License",)), ("BSD-2-Clause", ("BSD 2-Clause License",)), ("BSD-3-Clause", ("BSD 3-Clause License",)),
         ("Apache-2.0", ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0")),
         ("GPL-2.0", ("GNU General Public License, version 2", "GPL-2.0")), ("GPL-3.0", ("GNU General Public License, version 3", "GPL-3.0")),
         ("MPL-2.0", ("Mozilla Public License, version 2.0", "MPL-2.0")),
         ("CC-BY-4.0", ("CC BY 4.0",)), ("CC-BY-SA-4.0", ("CC BY-SA 4.0",)), ("CC-BY-NC-4.0", ("CC BY-NC 4.0",)))
LEADS = ("Licensed under", "Released under", "Distributed under", "This work is licensed under", "This software is licensed under", "This document is licensed under")
SPELLINGS = (("licence", "license"), ("licenced", "licensed"), ("sub license", "sublicense"), ("organisation", "organization"), ("favour", "favor"),
             ("acknowledgement", "acknowledgment"), ("fulfil", "fulfill"), ("whilst", "while"), ("per cent", "percent"), ("copyright owner", "copyright holder"),
             ("copyright owners", "copyright holders"), ("non infringement", "noninfringement"), ("merchantibility", "merchantability"))
# --- end of fixed values ----------------------------------------------------------------------
NOTICES = tuple((name, f"{lead} {the}{form}") for name, forms in NAMES for form in forms for lead in LEADS for the in ("", "the ")) + (
    ("all-rights-reserved", "All rights reserved"),)

#: Replacements in order; the patterns mean the same to Java, RE2 and Python.
_COPYRIGHT = (r"(^|\n)[ \t*#/]*(copyright|\(c\)|©|all rights reserved)[^\n]*", "\n")
_STEPS = ((r"(^|\n)[ \t]*([0-9]{1,2}[.)]|\([a-z0-9]\)|[*•-])[ \t]+", " "), (r"[!-/:-@\[-`{-~‘’“”–—©\x00-\x20]+", " "))
#: A line that is a licence's title and no more; a line that begins with "copyright" but goes on as the body of a licence
#: joins the line before (white space is collapsed later), so it is not taken for a holder's line.
_TITLE = (r"(^|\n)[ \t*#/=-]*(the )?(mit|expat|isc|zlib|zlib/libpng|0bsd|bsd zero clause|zero-clause bsd|(simplified |new |modified |revised )?bsd|bsd[ -][23][ -]clause|[23]-clause bsd)"
          r"( licen[cs]e)?( \((mit|isc|iscl|isc license|zlib|0bsd|bsd-[23]-clause|[23]-clause bsd license|bsd [23]-clause)\))?[ \t:*#/=-]*\r?\n", "\n")
_BODY = tuple((rf"\n[ \t*#/]*copyright[ \t\r\n*#/]+{w}", f" copyright {w}") for w in ("notice", "holder", "owner"))

MENTION = r"[Ll]icen[cs]e|LICEN[CS]E|[Rr]ights [Rr]eserved|RIGHTS RESERVED"


def _steps(copyright_lines: bool):
    yield from () if copyright_lines else (_TITLE, *_BODY, _COPYRIGHT)
    yield from _STEPS
    for a, b in SPELLINGS:
        yield f" {a} ", f" {b} "


def canonical(text: Column, copyright_lines: bool = False) -> Column:
    out = F.translate(text, UPPER, LOWER)
    for pattern, new in _steps(copyright_lines):
        if pattern.strip().replace(" ", "").isalpha():  # a spelling: no expression needed
            out = F.replace(out, F.lit(pattern), F.lit(new))
        else:
            out = F.concat(F.lit(" "), F.regexp_replace(out, pattern, new), F.lit(" ")) if pattern == _STEPS[-1][0] else F.regexp_replace(out, pattern, new)
    return F.trim(out)


def canonical_text(text: str, copyright_lines: bool = False) -> str:
    """``canonical`` for the known texts."""
    out = text.translate(str.maketrans(UPPER, LOWER))
    for pattern, new in _steps(copyright_lines):
        out = re.sub(pattern, new, out)
        if pattern == _STEPS[-1][0]:
            out = f" {out} "
    return out.strip(" ")


def _digests(known, copyright_lines: bool) -> list[tuple[str, str]]:
    whole_texts = {(digest, name) for name, digest in WHOLE} if known is LICENCES else set()
    return sorted({(hashlib.sha256(canonical_text(t, copyright_lines).encode()).hexdigest(), name) for name, t in known} | whole_texts)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, canonical_sha256, licence (of the whole text, or null), notices (names on lines, comma-joined) of every row."""
    spark = docs.sparkSession
    known = spark.createDataFrame(_digests(LICENCES, False), "canonical_sha256 string, licence string")
    names = F.create_map(*[F.lit(x) for pair in _digests(NOTICES, True) for x in pair])
    rows = docs.select(F.col(f"`{key}`").alias(key), whole(F.col(f"`{text}`")).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(MENTION))
    found = F.filter(F.transform(lines, lambda x: names[F.sha2(canonical(x, True), 256)]), lambda x: x.isNotNull())
    rows = rows.select(key, F.sha2(canonical(F.col("text")), 256).alias("canonical_sha256"),
                       F.when(F.col("text").rlike(MENTION), F.array_join(F.array_sort(F.array_distinct(found)), ",")).otherwise("").alias("notices"))
    return rows.join(F.broadcast(known), "canonical_sha256", "left").select(key, "canonical_sha256", "licence", "notices")


def scan_sql() -> str:
    """The same rows in DuckDB."""
    q = lambda s: "'" + s.replace("'", "''") + "'"

    def canon(x, copyright_lines):
        out = f"translate({x}, '{UPPER}', '{LOWER}')"
        for pattern, new in _steps(copyright_lines):
            new = "chr(10)" if new == "\n" else q(new)
            if pattern.strip().replace(" ", "").isalpha():
                out = f"replace({out}, {q(pattern)}, {new})"
            else:
                out = f"regexp_replace({out}, {q(pattern)}, {new}, 'g')"
                if pattern == _STEPS[-1][0]:
                    out = f"(' ' || {out} || ' ')"
        return f"trim({out}, ' ')"
    values = lambda known, keep: ", ".join(f"('{d}', '{n}')" for d, n in _digests(known, keep))
    return f"""WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
        lines AS (SELECT row, unnest(string_split(text, chr(10))) AS line FROM docs WHERE regexp_matches(text, {q(MENTION)})),
        notices AS (SELECT row, string_agg(DISTINCT name, ',' ORDER BY name) AS notices FROM lines
            JOIN (VALUES {values(NOTICES, True)}) AS n(digest, name) ON sha256({canon('line', True)}) = digest
            WHERE regexp_matches(line, {q(MENTION)}) GROUP BY row),
        digests AS (SELECT row, doc_id, sha256({canon('text', False)}) AS canonical_sha256 FROM docs)
        SELECT doc_id, canonical_sha256, licence, coalesce(notices, '') AS notices FROM digests
        LEFT JOIN notices USING (row)
        LEFT JOIN (VALUES {values(LICENCES, False)}) AS k(digest, licence) ON canonical_sha256 = digest"""
