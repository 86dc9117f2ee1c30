"""License scan by canonical digests of entire texts.

A text is normalised (case, copyright and rights-reserved lines, equivalent spellings, punctuation, quotation marks, dashes
and spacing) and its SHA-256 is looked up among the digests of known license texts, normalised in the
same way.  A copyright line starts with the word and a sign, year, placeholder or name, but not with what goes on in licence prose
(``PROSE``: notice, holders, law ...), so that wrapped text which merely has the word first in a line stays.  Only entire texts
match: a license quoted inside a longer document doesn't.  ``KNOWN`` has texts, each known with any of its titles and without;
``DIGESTS`` has the digests of longer ones.

Null and empty texts, and those of which nothing is left, have no license and a null digest.
Repeated rows get the same answer.  An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GAP, UPPER

#: License texts by SPDX identifier, with the titles that they go under, and notices of one sentence.
KNOWN: dict[str, tuple[list[str], str]] = {
    "MIT": (
        ["MIT License", "The MIT License", "The MIT License (MIT)"],
        """Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    "ISC": (
        ["ISC License", "The ISC License", "ISC License (ISC)"],
        """Copyright (c) <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    "0BSD": (
        ["Zero-Clause BSD", "BSD Zero Clause License", "Zero-Clause BSD License"],
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    "Zlib": (
        ["zlib License", "The zlib License", "zlib/libpng license"],
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    ),
    "BSD-2-Clause": (
        ["BSD 2-Clause License", "The 2-Clause BSD License"],
        """Copyright (c) <year>, <copyright holder>

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    "BSD-3-Clause": (
        ["BSD 3-Clause License", "The 3-Clause BSD License"],
        """Copyright (c) <year>, <copyright holder>

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    "Unlicense": (
        ["The Unlicense", "Unlicense"],
        """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>""",
    ),
    "Apache-2.0": ([], "Licensed under the Apache License, Version 2.0."),
    "GPL-3.0-only": ([], "This work is licensed under the GNU General Public License, version 3."),
    "CC-BY-NC-4.0": ([], "Licensed under CC BY-NC 4.0."),
    "CC0-1.0": ([], "This work is dedicated to the public domain under CC0 1.0 Universal."),
}

#: Digests of the normalised whole texts of longer licenses.
DIGESTS: dict[str, str] = {
    "adf220ee02537f83220e088f4488ca0e7557d614fac1cc48967b41d13911d6e0": "Apache-2.0",
    "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2": "Artistic-1.0-Perl",
    "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e": "CC0-1.0",
    "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60": "GFDL-1.2-only",
    "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826": "GFDL-1.3-only",
    "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224": "GPL-1.0-only",
    "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821": "GPL-2.0-only",
    "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a": "GPL-3.0-only",
    "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908": "LGPL-2.0-only",
    "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891": "LGPL-2.1-only",
    "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be": "LGPL-3.0-only",
    "f77c59051c0127d677dcce7ba0d4733294974749a7b4155250912498d92767d6": "MPL-1.1",
    "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9": "MPL-2.0",
}

#: Equivalent spellings (British or older form, common form), as whole words of normalised text.
SPELLINGS = [
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("sub license", "sublicense"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("organisation", "organization"),
    ("organisations", "organizations"),
    ("merchantibility", "merchantability"),
    ("non infringement", "noninfringement"),
    ("whilst", "while"),
    ("analogue", "analog"),
    ("copyright owner", "copyright holder"),
    ("per cent", "percent"),
    ("https", "http"),
]

#: Words that follow "copyright" at the beginning of a line of licence prose, rather than of a copyright line.
PROSE = """notices? holders? owners? ownership laws? licen[sc]es? licen[sc]ors? licensing statements? protections? interests? infringements? acts?
treaty treaties conventions? disclaimers? permissions? rights? claims? information terms? headers? legends? status registration works? material
patents? trademarks? trade moral database designs? intellectual privacy publicity relevant related applicable such other any all this these that those which who
where when if unless but then you your it its we and or nor in on of to for from under with without as at is are was were be been shall may must can
cannot will would should could has have had does do not applies apply exists? belongs remains subsists restrictions? exceptions? limitations?
including includes? except granted held protected conditions? appears?"""
_SIGNED = r"copyright[ \t:]*(\(c\)|©|<|\[|[0-9][0-9][0-9][0-9])|\(c\)|©"
_HOLDER = r"copyright([ \t]*[,:][ \t]*|[ \t]+)"
_EDGE = r"^[ \t*#/;-]*"
#: Line patterns that both engines read alike: what starts a copyright line, and what starts a line of prose that looks like one.
_NOTICE = rf"{_EDGE}({_SIGNED}|{_HOLDER}[^ \t\r\n.,;:])"
_NOT_NOTICE = rf"{_EDGE}{_HOLDER}({'|'.join(PROSE.split())})($|[^a-z0-9-])"
_RESERVED = r"^[ \t*#/;-]*all rights reserved[ .\t\r]*$"
#: Quotation marks, dashes, bullets, blanks and other signs that stand for ASCII ones in other editions; they become spaces.
_SIGNS = "".join(map(chr, [0xA0, 0xAB, 0xAD, 0xB7, 0xBB, *range(0x2000, 0x2070), *range(0x2190, 0x2200), *range(0x25A0, 0x2600), *range(0x3000, 0x3004), *range(0x300A, 0x3012), 0xFEFF]))
#: Old spellings that are part of no other: a text without these has none of the others.
_OLD = [old for old, _ in SPELLINGS if not any(other != old and other in old for other, _ in SPELLINGS)]


def normalise(text: Column) -> Column:
    """Words of the text, one space apart."""
    t = F.translate(F.coalesce(text, F.lit("")), UPPER + _SIGNS, UPPER.lower() + " " * len(_SIGNS))
    # lines are looked at only in texts that have such a line: most have none
    own = lambda line: line.rlike(_NOTICE) & ~line.rlike(_NOT_NOTICE) | line.rlike(_RESERVED)
    some = t.contains("copyright") | t.contains("(c)") | t.contains("©") | t.contains("all rights reserved")
    t = F.when(some, F.array_join(F.filter(F.split(t, "\n"), lambda line: ~own(line)), "\n")).otherwise(t)
    t = F.regexp_replace(t, GAP, " ")
    # equal words in a row share a space, so every other one is left to the second turn; and most texts have no old spelling
    spelled = F.concat(F.lit(" "), t, F.lit(" "))
    for old, new in SPELLINGS:
        for _ in range(2):
            spelled = F.replace(spelled, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(F.when(reduce(lambda a, b: a | b, [t.contains(old) for old in _OLD]), spelled).otherwise(t))


def digest(text: Column) -> Column:
    n = normalise(text)
    return F.when(n != "", F.sha2(n.cast("binary"), 256))


def variants() -> list[tuple[str, str]]:
    """(license, text) of the known texts, with each of their titles and without."""
    out = []
    for name, (titles, body) in KNOWN.items():
        out += [(name, body)] if not titles else [(name, f"{title}\n\n{body}") for title in [*titles, ""]]
    return out


def _rows(spark: SparkSession, pairs: list[tuple[str, str]]) -> DataFrame:
    """(license, value) of each pair."""
    row = lambda a, b: F.struct(F.lit(a).alias("license"), F.lit(b).alias("value"))
    return spark.range(len(pairs[:1])).select(F.explode(F.array(*[row(*p) for p in pairs or [("", "")]])).alias("x")).select("x.*")


def scan(docs: DataFrame, known: dict[str, str] | None = None) -> DataFrame:
    """doc_id, digest, license (null if unknown) of each row.

    ``known``: texts by name instead of the catalogue.  What is broadcast is a digest and a name for each known text: a parameter.
    """
    spark = docs.sparkSession
    texts = variants() if known is None else list(known.items())
    given = [] if known is not None else [(name, d) for d, name in DIGESTS.items()]
    table = _rows(spark, texts).select("license", digest(F.col("value")).alias("known_digest")).union(_rows(spark, given))
    table = table.groupBy("known_digest").agg(F.min("license").alias("license"))
    d = docs.select("doc_id", digest(F.col("text")).alias("digest"))
    return d.join(F.broadcast(table), F.col("digest") == F.col("known_digest"), "left").select("doc_id", "digest", "license")


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def norm(x: str) -> str:
        t = f"translate(coalesce({x}, ''), '{UPPER + _SIGNS}', '{UPPER.lower() + ' ' * len(_SIGNS)}')"
        t = rf"array_to_string(list_filter(string_split({t}, chr(10)), lambda l: NOT (regexp_matches(l, '{_NOTICE}') AND NOT regexp_matches(l, '{_NOT_NOTICE}') OR regexp_matches(l, '{_RESERVED}'))), chr(10))"
        t = rf"' ' || regexp_replace({t}, '{GAP}', ' ', 'g') || ' '"
        for old, new in SPELLINGS:
            for _ in range(2):
                t = f"replace({t}, ' {old} ', ' {new} ')"
        return f"trim({t})"

    values = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in variants())
    given = ", ".join(f"({quote(d)}, {quote(k)})" for d, k in DIGESTS.items())
    return f"""
    WITH k AS (SELECT known_digest, min(license) AS license FROM (SELECT sha256({norm("t")}) AS known_digest, license FROM (VALUES {values}) v(license, t) UNION ALL SELECT * FROM (VALUES {given}) g(known_digest, license)) GROUP BY 1),
    d AS (SELECT doc_id, {norm("text")} AS n FROM documents)
    SELECT doc_id, CASE WHEN n <> '' THEN sha256(n) END AS digest, license FROM d LEFT JOIN k ON n <> '' AND sha256(n) = known_digest"""


SQL = _sql()
