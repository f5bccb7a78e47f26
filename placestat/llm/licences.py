"""Licence scans by canonical digests.

A text is brought to a canonical form line by line: lower case, one spelling of words that licences spell
in several ways, letters and digits only between single blanks; copyright lines and empty lines go. The
SHA-256 of the canonical whole text, and of each canonical line, is hash-joined to the digests of known
licence texts and notices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placestat.llm.common import let, sized_broadcast

# Words with equivalent spellings, and the spelling taken; whole words only.
SPELLINGS = {
    "licence": "license",
    "licences": "licenses",
    "licenced": "licensed",
    "sublicence": "sublicense",
    "non commercial": "noncommercial",
    "per cent": "percent",
    "copyright owner": "copyright holder",
    "copyright owners": "copyright holders",
    "organisation": "organization",
    "organisations": "organizations",
    "analyse": "analyze",
    "favour": "favor",
    "fulfil": "fulfill",
    "warranties": "warranty",
    "https": "http",
    "and or": "or",
    "centre": "center",
    "judgement": "judgment",
    "version 2 0": "version 2",
    "version 3 0": "version 3",
}

BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

# Public licence texts and the notices by which files name a licence.
KNOWN = [
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
""" + BSD_END),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
""" + BSD_END),
    ("Unlicense", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>"""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("BSL-1.0", """Boost Software License - Version 1.0 - August 17th, 2003
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
]

# Titles that files put above the texts.
TITLES = [
    ("MIT", "MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("ISC", "ISC License"),
    ("0BSD", "BSD Zero Clause License"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("Zlib", "zlib License"),
]
KNOWN += [(name, f"{title}\n{text}") for name, title in TITLES for known, text in KNOWN if known == name and "\n" in text]

# Digests of the canonical whole texts of longer licences, as ``known_digests`` makes them.
DIGESTS = [
    ("Apache-2.0", "f4ee988deca33a9cd98553f8f5a638e610a9f665594da9830e2dc901fbff8450"),
    ("Artistic-1.0-Perl", "1179b197ab6e5728f93dc0543e12928e997773c1203fe42bc89d6b0ebbbeb109"),
    ("CC0-1.0", "0908f283754fd42b304d903ff999b4357c4aa956b403d04661a763d7c4cc3178"),
    ("GFDL-1.2", "f4a32c6fee37d901a402d193389c97b488f169f065ed593e95be8b675c25407a"),
    ("GFDL-1.3", "638a046045a6e719e81f77bedd614daacd312e1e5066c72639bcfefacfb6d53f"),
    ("GPL-1.0", "9ccd349c8da79d1c5175e970890ce74e665cfe7801f903df59c5af231a2348ed"),
    ("GPL-2.0", "5d5af223f247423f2eed67ac7194f4156a8cc93656321ea4b8841acd3bfb5e2f"),
    ("GPL-3.0", "7daba191abb333869d58ac0c96bed7ab07521031062386e7338709dd42ad1c87"),
    ("LGPL-2.0", "20e0b2660295cb657fe4a72e8a66e4e6f47aa5919bed892f2dd40186fa7e4126"),
    ("LGPL-2.1", "d852063b74e375c82b96e45a1de030058d5ebf272aea901299aac9ca78597092"),
    ("LGPL-3.0", "dd538d15d532339d4a394323937d54825be6b2224b8e1985cf9c9e707c966d9c"),
    ("MPL-1.1", "88c14c63fa0bcf634d2a21d15ae2cf3c4c2325bb37f0e6762454562f27beb435"),
    ("MPL-2.0", "634fd9e9fc95eda3a3e3133f22d7b227415f216a1b35603e6471382cc49c56bb"),
]

COPYRIGHT = r"^(copyright|©|c copyright)( (©|c))*( [0-9]{4}| all rights| by|$)"


def _spelled(x: Column) -> Column:
    x = F.concat(F.lit(" "), x, F.lit(" "))
    for a, b in SPELLINGS.items():
        x = F.replace(x, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(x)


def canonical_lines(text: Column) -> Column:
    """Canonical form of each line of a text, without copyright lines and empty ones."""
    canon = lambda line: _spelled(F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}©]+", " ")))
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), canon)
    return F.filter(lines, lambda x: (x != "") & ~x.rlike(COPYRIGHT))


def canonical_whole(lines: Column) -> Column:
    """The lines joined; spellings once more, as a line may end within one."""
    return _spelled(F.array_join(lines, " "))


def digests(text: Column) -> Column:
    """Array of (unit, digest): unit 0 is the whole text, unit i its i-th canonical line."""
    return let(
        canonical_lines(text),
        lambda ls: F.transform(F.concat(F.array(canonical_whole(ls)), ls), lambda x, i: F.struct(i.alias("unit"), F.sha2(x, 256).alias("digest"))),
    )


def known_digests(known: DataFrame) -> DataFrame:
    """(digest, licence) of a table with columns licence and text; the least name if several share a text."""
    whole = canonical_whole(canonical_lines(F.col("text")))
    return known.where(whole != "").groupBy(F.sha2(whole, 256).alias("digest")).agg(F.min("licence").alias("licence"))


def known_licences(spark: SparkSession) -> DataFrame:
    """(digest, licence) of the texts and digests above."""
    texts = known_digests(spark.createDataFrame(KNOWN, "licence string, text string"))
    both = texts.unionByName(spark.createDataFrame(DIGESTS, "licence string, digest string"))
    return both.groupBy("digest").agg(F.min("licence").alias("licence"))


def scan_licences(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per id: text_digest, licence (of the entire text), notices (licences whose text is a line), n_notices.

    ``known`` has digest and licence, as ``known_licences`` or ``known_digests`` of a table of texts give them.

    Null and blank texts have the digest of the empty string and no licence. Rows that repeat an id are
    folded: least digest and licence, all notices. Null ids are one group. Other columns are ignored. The
    known digests are broadcast if a count shows that they are few; otherwise it is a shuffled join.
    """
    units = docs.select(F.col(id_col).alias("doc_id"), F.explode(digests(F.col(text_col))).alias("u")).select("doc_id", "u.unit", "u.digest")
    found = units.join(sized_broadcast(known), "digest", "left")
    whole = F.col("unit") == 0
    return found.groupBy("doc_id").agg(
        F.min(F.when(whole, F.col("digest"))).alias("text_digest"),
        F.min(F.when(whole, F.col("licence"))).alias("licence"),
        F.array_join(F.array_sort(F.collect_set(F.when(~whole, F.col("licence")))), ",").alias("notices"),
        F.count(F.when(~whole, F.col("licence"))).alias("n_notices"),
    )


def scan_sql() -> str:
    """The scan with the known texts above as DuckDB SQL over ``documents``."""

    def spelled(x: str) -> str:
        x = f"' ' || {x} || ' '"
        for a, b in SPELLINGS.items():
            x = f"replace({x}, ' {a} ', ' {b} ')"
        return f"trim({x})"

    canon = spelled(r"trim(regexp_replace(lower(x), '[^\p{L}\p{N}©]+', ' ', 'g'))")
    lines = f"list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {canon}), lambda x: x <> '' AND NOT regexp_matches(x, '{COPYRIGHT}'))"
    known = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in KNOWN)
    whole = spelled("array_to_string(ls, ' ')")
    longer = ", ".join(f"('{d}', '{name}')" for name, d in DIGESTS)
    return f"""WITH k AS (SELECT sha256({whole}) AS d, min(licence) AS licence FROM (SELECT licence, {lines} AS ls FROM (VALUES {known}) v(licence, text)) GROUP BY 1 UNION ALL SELECT * FROM (VALUES {longer}) w(d, licence)),
c AS (SELECT doc_id, {lines} AS ls FROM documents),
u AS (SELECT doc_id, 0 AS unit, sha256({whole}) AS d FROM c UNION ALL SELECT doc_id, 1, sha256(l) FROM (SELECT doc_id, unnest(ls) AS l FROM c))
SELECT doc_id, min(u.d) FILTER (unit = 0) AS text_digest, min(licence) FILTER (unit = 0) AS licence, coalesce(string_agg(DISTINCT licence, ',' ORDER BY licence) FILTER (unit > 0), '') AS notices, count(licence) FILTER (unit > 0) AS n_notices
FROM u LEFT JOIN k ON k.d = u.d GROUP BY doc_id"""
