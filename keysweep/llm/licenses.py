"""Licence scan by canonical digests: texts are normalised, hashed, and hash-joined to the digests of known licences."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Known licences and notices (licence, text). Copyright lines do not matter.
KNOWN = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("ISC", """ISC License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-only"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
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
)

#: First lines that the entire texts above come with, or without.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"), "ISC": ("ISC License", "The ISC License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License"), "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License"),
    "0BSD": ("Zero-Clause BSD", "BSD Zero Clause License"), "Unlicense": ("The Unlicense",), "Zlib": ("zlib License", "The zlib/libpng License"),
}


def _titled(known: Iterable[tuple[str, str]]) -> list[tuple[str, str]]:
    """``known`` with the entire texts under each of their titles and without one."""
    out = []
    for name, text in known:
        titles = TITLES.get(name, ())
        body = text
        for title in titles:
            body = body.removeprefix(title + "\n\n")
        out += [(name, text)] if "\n\n" not in text else [(name, f"{title}\n\n{body}") for title in titles] + [(name, body)]
    return out


ALL_KNOWN = _titled(KNOWN)


#: Spellings that count as the same, in lower case and between words (pattern, canonical form).
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"),
    ("organisation", "organization"), ("favour", "favor"), ("merchantibility", "merchantability"),
    ("non infringement", "noninfringement"), ("v", "version"), ("http", "https"),
    ("the above copyright notices", "the above copyright notice"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lines of prose that begin with the word are not copyright lines; a mark before it keeps them.
PROSE = "(^|\n)([ \t\r]*)copyright( +(?:notice|holder|owner|law|interest|and |or |license|licence))"
COPYRIGHT_LINE = "(^|\n)[ \t\r]*(copyright|\\(c\\)|©|all rights reserved)[^\n]*"
#: Every known text matches this before and after it is normalised, so other texts need no normalising.
GATE = "(?i)licen[cs]|redistribut|disclaim|unencumbered"
MARKS = "[^\\p{L}\\p{N}]+"


def canonical(text: Column) -> Column:
    """A-Z in lower case, lines that begin with a copyright sign or word removed (but not wrapped prose such as "copyright notice and
    this permission notice"), each run of other marks one space, and equivalent spellings made one. Null stays null."""
    text = F.translate(text.cast("string"), UPPER, LOWER)
    text = F.regexp_replace(F.regexp_replace(text, PROSE, "$1$2~copyright$3"), COPYRIGHT_LINE, "\n")
    text = F.concat(F.lit(" "), F.trim(F.regexp_replace(text, MARKS, " ")), F.lit(" "))
    for spelling, one in SPELLINGS:
        text = F.replace(text, F.lit(f" {spelling} "), F.lit(f" {one} "))
    return F.trim(text)


def known_digests(spark: SparkSession, known: Iterable[tuple[str, str]] = ALL_KNOWN) -> DataFrame:
    """``license, digest``: of texts that are the same after normalising, the first licence by name counts."""
    table = spark.createDataFrame(list(known), "license string, text string")
    return table.groupBy(F.sha2(canonical(F.col("text")), 256).alias("digest")) \
        .agg(F.min("license").alias("license"))


def licenses(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             gate: str | None = GATE) -> DataFrame:
    """One row per text or line that is, as a whole, a known licence or notice: ``id, line, license, digest``.

    ``line`` is 0 where the entire text of the row is one, else the number of the line from 1; a text of one line gives
    both. Null and empty texts, and texts of copyright lines alone, match nothing. Repeated rows come out repeatedly;
    null ids stay null. Only the two columns are read. An empty table on either side gives no rows.

    ``gate`` is a pattern that a text must match to be normalised at all; pass None, or your own, if some of your
    ``known`` texts do not match it. Texts are normalised and hashed where they are read, and only hashes meet the join. Spark broadcasts ``known`` if it
    is below its threshold and otherwise shuffles 32-byte digests, never texts.
    """
    text = F.col(text_col).cast("string")
    may = (lambda t: t.rlike(gate)) if gate else (lambda t: F.lit(True))
    units = docs.where(may(text)).select(F.col(id_col).alias("id"), F.posexplode(F.concat(F.array(text), F.split(text, "\n"))).alias("line", "unit")).where(may(F.col("unit")))
    form = units.select("id", "line", canonical(F.col("unit")).alias("form")).where("form <> ''")
    return form.select("id", F.col("line").cast("long").alias("line"), F.sha2("form", 256).alias("digest")) \
        .join(known, "digest").select("id", "line", "license", "digest")


def canonical_sql(text: str) -> str:
    """``canonical`` as a DuckDB expression."""
    out = f"translate({text}, '{UPPER}', '{LOWER}')"
    out = f"regexp_replace({out}, '{PROSE}', '\\1\\2~copyright\\3', 'g')"
    out = f"regexp_replace({out}, '{COPYRIGHT_LINE}', chr(10), 'g')"
    out = f"' ' || trim(regexp_replace({out}, '{MARKS}', ' ', 'g')) || ' '"
    for spelling, one in SPELLINGS:
        out = f"replace({out}, ' {spelling} ', ' {one} ')"
    return f"trim({out})"


def licenses_sql(known: Iterable[tuple[str, str]] = ALL_KNOWN) -> str:
    rows = ", ".join("({})".format(", ".join("'" + v.replace("'", "''") + "'" for v in row)) for row in known)
    return f"""
WITH given(license, text) AS (VALUES {rows}),
known AS (SELECT sha256({canonical_sql('text')}) AS digest, min(license) AS license FROM given GROUP BY 1),
units AS (
  SELECT doc_id, 0 AS line, text AS unit FROM documents
  UNION ALL
  SELECT doc_id, unnest(generate_series(1, len(string_split(text, chr(10))))), unnest(string_split(text, chr(10))) FROM documents
),
forms AS (SELECT doc_id, line, {canonical_sql('unit')} AS form FROM units)
SELECT doc_id, CAST(line AS BIGINT) AS line, license, digest FROM (
  SELECT doc_id, line, sha256(form) AS digest FROM forms WHERE form <> '') JOIN known USING (digest)"""
