"""Licence scan by canonical digests: whole texts and whole lines are looked up among known ones."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapecheck.llm.text import lower_ascii

# Public licence texts and notices, by SPDX identifier.
_PERMISSION = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    'associated documentation files (the "Software"), to deal in the Software without restriction, including '
    "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
    "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
    "following conditions: The above copyright notice and this permission notice shall be included in all "
    "copies or substantial portions of the Software. "
)
_MIT_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
    "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
    "EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER "
    "IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR "
    "THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_TERMS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
    "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
    "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
    "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
    "promote products derived from this software without specific prior written permission. "
)
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
    "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
    "POSSIBILITY OF SUCH DAMAGE."
)
KNOWN: tuple[tuple[str, str], ...] = (
    ("MIT", _PERMISSION + _MIT_WARRANTY),
    ("MIT", "MIT License " + _PERMISSION + _MIT_WARRANTY),
    ("MIT", "The MIT License " + _PERMISSION + _MIT_WARRANTY),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "MIT License"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("BSD-2-Clause", _BSD_TERMS + _BSD_WARRANTY),
    ("BSD-2-Clause", "BSD 2-Clause License " + _BSD_TERMS + _BSD_WARRANTY),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", _BSD_TERMS + _BSD_NAMES + _BSD_WARRANTY),
    ("BSD-3-Clause", "BSD 3-Clause License " + _BSD_TERMS + _BSD_NAMES + _BSD_WARRANTY),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
        "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF "
        "USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
        "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("ISC", "SPDX-License-Identifier: ISC"),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)

#: Spellings that mean the same, applied in this order to lower-cased text.
SPELLINGS: tuple[tuple[str, str], ...] = (
    (r"sub-licen[cs]e", "sublicense"),
    (r"licence", "license"),
    (r"non-infringement", "noninfringement"),
    (r"merchantibility", "merchantability"),
    (r"https://", "http://"),
    (r"&", " and "),
)
#: A line that only names holders and years, also behind the marks of a comment. A holder counts with a year after it, or
#: as "the ... authors"; a line of the licence itself that happens to begin with the word has neither.
COPYRIGHT_LINE = (
    r"(?m)^[ \t#*/;>-]*(?:copyright[ \t,:]*(?:(?:\(c\)|©|[0-9]{4})[^\n]*"
    r"|[^\n]*[^0-9\n](?:19|20)[0-9]{2}(?:[^0-9\n][^\n]*)?|the [^\n]* (?:authors|contributors)\.?)"
    r"|(?:©|\(c\))[ \t]*[0-9]{4}[^\n]*|all rights reserved\.?)[ \t]*$"
)
PUNCTUATION = r"[!-/:-@\[-`{-~\s“”‘’–—©]+"


def canonical(text: Column) -> Column:
    """Text without what may differ between copies of one licence.

    Lower-cases A-Z, removes copyright lines, unifies spellings, and turns every run of
    punctuation and white space into one blank. NULL becomes empty.
    """
    out = F.regexp_replace(lower_ascii(text), COPYRIGHT_LINE, " ")
    for pattern, spelling in SPELLINGS:
        out = F.regexp_replace(out, pattern, spelling)
    return F.trim(F.regexp_replace(out, PUNCTUATION, " "))


def digests(known: tuple[tuple[str, str], ...], spark) -> DataFrame:
    """``digest, license`` of the known texts: one small row for each, whatever the input."""
    licence = F.array(*[F.struct(F.lit(n).alias("license"), F.lit(t).alias("text")) for n, t in known])
    return (
        spark.range(1)
        .select(F.inline(licence))
        .select(F.md5(canonical(F.col("text"))).alias("digest"), "license")
        .groupBy("digest")
        .agg(F.min("license").alias("license"))
    )


def _known_map(found: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in sorted(found.items()) for x in pair])


def scan_licences(
    docs: DataFrame, known: tuple[tuple[str, str], ...] = KNOWN, texts: DataFrame | None = None
) -> DataFrame:
    """Look up every whole text, and every whole line, among the known licences.

    ``known`` are the built-in notices and short licences; longer ones (the whole Apache, GNU or Mozilla licences are not
    among them) are given as a table ``texts (license, text)`` of any size, which whole texts are looked up in too.

    Returns ``doc_id, digest, license, line_licenses, n_license_lines`` for every row:
    the canonical digest of the whole text, the licence with that digest (NULL if none),
    the distinct licences of single lines (sorted, joined by commas, empty if none) and the number of
    such lines. Texts join the digest table by hash; the table of ``known`` has one row for each, so it is broadcast
    whatever the corpus, one with ``texts`` is joined as Spark sees fit. Lines are probed in place among ``known``.
    Texts of any length are read whole.

    A NULL or empty text has the digest of the empty string and no licence. Repeated rows are
    repeated; extra columns are not read; an empty table gives an empty result.
    """
    table = digests(known, docs.sparkSession)
    lookup = {r["digest"]: r["license"] for r in table.collect() if r["digest"]}
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
    lines = F.transform(
        F.split("body", "\n"), lambda line: F.element_at(_known_map(lookup), F.md5(canonical(line)))
    )
    probed = rows.select(
        "doc_id",
        F.md5(canonical(F.col("body"))).alias("digest"),
        F.filter(lines, lambda name: name.isNotNull()).alias("found"),
    )
    if texts is None:
        table = F.broadcast(table)
    else:
        more = texts.select(F.md5(canonical(F.col("text"))).alias("digest"), "license")
        table = table.unionByName(more).groupBy("digest").agg(F.min("license").alias("license"))
    return probed.join(table, "digest", "left").select(
        "doc_id",
        "digest",
        "license",
        F.array_join(F.sort_array(F.array_distinct("found")), ",").alias("line_licenses"),
        F.size("found").cast("long").alias("n_license_lines"),
    )
