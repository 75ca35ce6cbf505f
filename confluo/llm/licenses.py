"""License scans by canonical digest lookup.

A text is brought to a canonical form: lower case, no copyright lines, one spelling for equivalent words, and nothing
but letters and digits between single spaces. The digest of an entire canonical text is joined to the digests of known
licences. Whole documents are looked up as licence texts, and each line as a licence notice.

Only built-in functions are used; the list of known digests is fixed, so it is broadcast.

Defined results: null and empty texts match nothing and have no line; a null doc_id is kept; repeated rows are each
scanned; of two licences with one digest the smaller identifier is given; very long texts are canonicalised whole, and
lines longer than any known text are no notice; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings that the SPDX matching guidelines hold to be equivalent, the first for the second.
EQUIVALENT = dict(
    x.split("=")
    for x in """acknowledgment=acknowledgement analog=analogue analyze=analyse artifact=artefact authorization=authorisation authorized=authorised
    caliber=calibre canceled=cancelled capitalizations=capitalisations catalog=catalogue categorize=categorise center=centre emphasized=emphasised
    favor=favour favorite=favourite fulfill=fulfil fulfillment=fulfilment initialize=initialise judgment=judgement labeling=labelling labor=labour
    license=licence licenses=licences licensed=licenced maximize=maximise modeled=modelled modeling=modelling offense=offence optimize=optimise
    organization=organisation organize=organise practice=practise program=programme realize=realise recognize=recognise signaling=signalling
    sublicense=sublicence utilization=utilisation while=whilst willful=wilful""".split()
)
_TO_FIRST = {v: k for k, v in EQUIVALENT.items()}
PHRASES = {"sub license": "sublicense", "non commercial": "noncommercial", "per cent": "percent", "copyright holder": "copyright owner", "copyright holders": "copyright owners"}

_PERMISSION = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_END = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."

_MIT0 = _PERMISSION.split(", subject to")[0] + "."
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_MORE = ("For more information, please refer to <http://unlicense.org/>", "For more information, please refer to <https://unlicense.org/>", "For more information, please refer to <https://unlicense.org>", "")
_BOOST = """Boost Software License - Version 1.0 - August 17th, 2003
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

# Licence texts without their titles, by SPDX identifier.
TEXTS: list[tuple[str, str]] = [
    ("MIT", f"{_PERMISSION}\n{_MIT_END}"),
    ("MIT-0", f"{_MIT0}\n{_MIT_END}"),
    ("ISC", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_END}"),
    ("0BSD", f"{_ISC}.\n{_ISC_END}"),
    ("BSD-2-Clause", f"{_BSD}\n1. {_BSD_1}\n2. {_BSD_2}\n{_BSD_END}"),
    ("BSD-2-Clause", f"{_BSD}\n{_BSD_1}\n{_BSD_2}\n{_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD}\n1. {_BSD_1}\n2. {_BSD_2}\n3. {_BSD_3}\n{_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD}\n{_BSD_1}\n{_BSD_2}\n{_BSD_3}\n{_BSD_END}"),
    ("Zlib", _ZLIB),
    ("BSL-1.0", _BOOST),
    *(("Unlicense", f"{_UNLICENSE}\n{x}") for x in _MORE),
]
# Titles that may stand above a text.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "MIT-0": ("MIT No Attribution", "MIT-0"),
    "ISC": ("ISC License", "The ISC License"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", "BSD License", "New BSD License"),
    "Zlib": ("zlib License", "The zlib License", "The zlib/libpng License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
}
# Names that notices use, by SPDX identifier.
NAMES = {
    "MIT": ("the MIT License",),
    "ISC": ("the ISC License",),
    "BSD-2-Clause": ("the BSD 2-Clause License",),
    "BSD-3-Clause": ("the BSD 3-Clause License",),
    "Apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0", 'the Apache License, Version 2.0 (the "License")'),
    "MPL-2.0": ("the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0"),
    "GPL-2.0-only": ("the GNU General Public License, version 2", "the GNU General Public License v2.0"),
    "GPL-2.0-or-later": ("the GNU General Public License, version 2 or later",),
    "GPL-3.0-only": ("the GNU General Public License, version 3", "the GNU General Public License v3.0"),
    "GPL-3.0-or-later": ("the GNU General Public License, version 3 or later",),
    "LGPL-2.1-only": ("the GNU Lesser General Public License, version 2.1",),
    "LGPL-3.0-only": ("the GNU Lesser General Public License, version 3",),
    "AGPL-3.0-only": ("the GNU Affero General Public License, version 3",),
    "EPL-2.0": ("the Eclipse Public License 2.0",),
    "BSL-1.0": ("the Boost Software License, Version 1.0",),
    "Unlicense": ("the Unlicense",),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal"),
    "CC-BY-4.0": ("CC BY 4.0", "a Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0", "a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
}
# Wordings of notices.
WORDINGS = ("Licensed under {}.", "Released under {}.", "Distributed under {}.", "This work is licensed under {}.", "This project is licensed under {}.", "This software is released under {}.")
FURTHER = ("GPL-2.0", "GPL-3.0", "GPL-2.0+", "GPL-3.0+", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later", "0BSD", "MIT-0", "Zlib")

KNOWN: list[tuple[str, str]] = [
    *TEXTS,
    *((k, f"{title}\n{t}") for k, t in TEXTS for title in TITLES.get(k, ())),
    *((k, w.format(n)) for k, names in NAMES.items() for n in names for w in WORDINGS),
    *((k, f"SPDX-License-Identifier: {k}") for k in (*NAMES, *FURTHER)),
]

_COPYRIGHT = r"^[^0-9a-z©]*(copyright|©|\(c\)|all rights reserved).*$"
_NOT_WORD = "[^0-9a-zß-öø-ÿ]+"


def canonical_line(line: Column) -> Column:
    """Canonical form of one line; empty for a copyright line."""
    low = F.lower(line)
    words = F.split(F.trim(F.regexp_replace(low, _NOT_WORD, " ")), " ")
    spelling = F.create_map(*[F.lit(x) for kv in sorted(_TO_FIRST.items()) for x in kv])
    changed = F.array_join(F.transform(words, lambda w: F.coalesce(F.element_at(spelling, w), w)), " ")
    plain = F.trim(F.regexp_replace(low, _NOT_WORD, " "))
    odd = low.rlike(rf"\b({'|'.join(sorted(_TO_FIRST))})\b")
    return F.when(low.rlike("copyright|©|\\(c\\)|all rights") & low.rlike(_COPYRIGHT), F.lit("")).when(odd, changed).otherwise(plain)


def with_phrases(text: Column) -> Column:
    for k, v in PHRASES.items():
        text = F.when(text.contains(k), F.regexp_replace(text, rf"\b{k}\b", v)).otherwise(text)
    return text


def canonical_text(text: Column) -> Column:
    """Canonical form of a whole text."""
    return with_phrases(F.array_join(F.filter(F.transform(F.split(text, "\n"), canonical_line), lambda x: x != ""), " "))


def known_digests(spark, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license_id), one row per digest."""
    rows = spark.createDataFrame(KNOWN if known is None else known, "license_id string, text string")
    return rows.select(F.md5(canonical_text(F.col("text"))).alias("digest"), "license_id").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: list[tuple[str, str]] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, license_id of the whole text or null, n_lines with a word, n_notices, notices as sorted distinct identifiers."""
    # The list has a fixed number of rows, so its digests fit a literal map: a hash lookup without an exchange.
    found = known_digests(docs.sparkSession, known).collect()
    lookup = F.create_map(*[F.lit(x) for r in found for x in (r.digest, r.license_id)])
    lines = F.filter(F.transform(F.split(F.coalesce(docs[text].cast("string"), F.lit("")), "\n"), canonical_line), lambda x: x != "")
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), lines.alias("_lines"))
    longest = max((len(t) for _, t in (KNOWN if known is None else known)), default=0) * 2
    hits = F.filter(F.transform("_lines", lambda x: F.when(F.length(x) <= longest, F.element_at(lookup, F.md5(with_phrases(x))))), lambda x: x.isNotNull())
    whole = with_phrases(F.array_join("_lines", " "))
    rows = rows.select("doc_id", F.size("_lines").cast("long").alias("n_lines"), F.element_at(lookup, F.md5(whole)).alias("license_id"), hits.alias("_hits"))
    return rows.select("doc_id", "license_id", "n_lines", F.size("_hits").cast("long").alias("n_notices"), F.array_join(F.array_sort(F.array_distinct("_hits")), ",").alias("notices"))
