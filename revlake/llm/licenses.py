"""License scans: the digest of a canonical text is looked up among those of known licence texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .urls import LOWER, UPPER

# Spellings that count as equal when licence texts are compared.
SPELLINGS = (
    ("licence", "license"), ("sub license", "sublicense"), ("non commercial", "noncommercial"),
    ("copyright owner", "copyright holder"), ("organisation", "organization"), ("favour", "favor"),
    ("fulfil ", "fulfill "), ("judgement", "judgment"), ("labour", "labor"), ("programme", "program"),
    ("whilst", "while"), ("wilful ", "willful "), ("per cent", "percent"), ("recognise", "recognize"),
    ("utilisation", "utilization"), ("authoris", "authoriz"), ("merchantibility", "merchantability"),
    ("https", "http"),
)
#: "copyright" alone may also begin a line of the text itself, where it is wrapped.
COPYRIGHT_LINE = "^[^a-z0-9]*(?:copyright[^a-z0-9]*(?:c\\)|[0-9]{4}|by |the .*authors|©)|\\(c\\)|©|all rights reserved)"
#: Up to so many digests (a few dozen bytes each) the list of licences is broadcast; above, joined by shuffle.
BROADCAST_LICENSES = 100_000


def canonical_line(line: Column) -> Column:
    """A line in lower case, punctuation as single spaces, equal spellings made one; a copyright line is empty."""
    low = F.translate(line, UPPER, LOWER)
    plain = F.trim(F.regexp_replace(low, "[^a-z0-9\\u0080-\\x{10FFFF}]+", " "))
    padded = F.concat(F.lit(" "), plain, F.lit(" "))
    same = F.trim(reduce(lambda text, pair: F.replace(text, F.lit(" " + pair[0]), F.lit(" " + pair[1])), SPELLINGS, padded))
    odd = "|".join(sorted({old.strip() for old, _ in SPELLINGS}))
    spelled = F.when(padded.rlike(f" (?:{odd})"), same).otherwise(plain)
    return F.when(low.rlike(COPYRIGHT_LINE), "").otherwise(spelled)


def canonical_lines(text: Column) -> Column:
    """Canonical lines of a text without the empty ones."""
    return F.filter(F.transform(F.split(text, "\n", -1), canonical_line), lambda line: line != "")


def digest(canonical: Column) -> Column:
    """Digest of a canonical text; null if nothing is left of it."""
    return F.when(canonical != "", F.sha2(canonical.cast("binary"), 256))


def license_digests(licenses: DataFrame) -> DataFrame:
    """(digest, license_id, first, words) of known texts (license_id, text): their digest, first word and number of words.

    Texts that become equal go under the smallest id.
    """
    named = licenses.select(F.array_join(canonical_lines(F.col("text")), " ").alias("whole"), "license_id")
    named = named.filter("whole <> '' AND license_id IS NOT NULL").groupBy("whole").agg(F.min("license_id").alias("license_id"))
    return named.select(
        digest(F.col("whole")).alias("digest"), "license_id", F.substring_index("whole", " ", 1).alias("first"),
        F.size(F.split("whole", " ", -1)).alias("words"),
    )


def scan_licenses(docs: DataFrame, licenses: DataFrame) -> DataFrame:
    """Licence of every whole text, and of runs of its lines that are a whole known text by themselves.

    Returns for each document doc_id, text_sha256 (of the canonical text; null if nothing is left),
    license_id (null if the whole text is none) and line_licenses (the distinct licences of runs of whole
    lines, sorted, joined by commas; null if none). A run may be wrapped otherwise than the known text, and have
    blank and copyright lines in it. It is looked for where a line begins with the first word of a known text, with
    as many words as that text has, and counts where these end with a line. Null and empty texts have no
    digest. Repeated rows, which cannot differ, give one row; a null doc_id stays. Other columns are not read.
    """
    known = license_digests(licenses)
    bounds = known.agg(F.count("*").alias("n"), F.max("words").alias("words")).first()
    side = F.broadcast if bounds.n <= BROADCAST_LICENSES else (lambda df: df)
    firsts = [r[0] for r in known.select("first").distinct().collect()]  # different words that licences begin with
    lines = docs.select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("raw"), canonical_lines(F.col("text")).alias("lines"))
    # a tail has no more lines than the longest known text has words
    begins = lambda line: F.substring_index(line, " ", 1).isin(firsts)
    tails = F.transform("lines", lambda line, i: F.when(begins(line), F.slice(F.col("lines"), i + 1, F.lit(max(1, bounds.words or 1)))))
    tails = F.filter(tails, lambda tail: tail.isNotNull())
    unit = lambda whole, text: F.struct(F.lit(whole).alias("whole"), text.alias("text"))
    units = F.concat(F.array(unit(True, F.array_join("lines", " "))), F.coalesce(F.transform(tails, lambda tail: unit(False, F.array_join(tail, "\n"))), F.array().cast("array<struct<whole:boolean,text:string>>")))
    units = lines.select("doc_id", "raw", F.inline(units)).withColumn("first", F.when(~F.col("whole"), F.regexp_extract("text", "^[^ \n]*", 0)))
    wholes = units.filter("whole").select("doc_id", "raw", digest(F.col("text")).alias("text_sha256"))
    wholes = wholes.join(side(known.select(F.col("digest").alias("text_sha256"), "license_id")), "text_sha256", "left")
    size = F.length("run")
    parts = units.filter("NOT whole").join(side(known), "first").withColumn("run", F.call_function("substring_index", F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(" "), F.col("words")))
    ends = (size == F.length("text")) | (F.substring(F.col("text"), size + 1, F.lit(1)) == "\n")
    parts = parts.filter(ends & (digest(F.col("run")) == F.col("digest"))).select("doc_id", "raw", F.col("license_id").alias("part"))
    none = F.lit(None).cast("string")
    both = wholes.withColumn("part", none).unionByName(parts.withColumns({"text_sha256": none, "license_id": none}))
    return both.groupBy("doc_id", "raw").agg(
        F.max("text_sha256").alias("text_sha256"), F.max("license_id").alias("license_id"),
        F.array_join(F.array_sort(F.collect_set("part")), ",").alias("line_licenses"),
    ).select("doc_id", "text_sha256", "license_id", F.when(F.col("line_licenses") != "", F.col("line_licenses")).alias("line_licenses"))


_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
    "in the documentation and/or other materials provided with the distribution.\n\n"
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
    "from this software without specific prior written permission.\n\n"
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON "
    "ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE "
    "USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software "
    "Foundation, either version {1} of the License, or (at your option) any later version.\n\n"
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details.\n\n"
    "You should have received a copy of the GNU {0} along with this program. If not, see <https://www.gnu.org/licenses/>."
)

# Licence texts in full where they are short, the usual notices of the long ones, and one-line notices.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the '
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software.\n\n" + _AS_IS + "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.\n\n"
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
        "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n"
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
        "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n"
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this "
        "software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n"
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n"
        "3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain.\n\n"
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means.\n\n"
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the "
        "software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and "
        "successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this "
        "software under copyright law.\n\n" + _AS_IS + "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL "
        "THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT "
        "OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\n"
        "For more information, please refer to <https://unlicense.org>",
    ),
    (
        "BSL-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
        'documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to '
        "prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the "
        "following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and "
        "the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, "
        "unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language "
        "processor.\n\n" + _AS_IS + "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT "
        "HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING "
        "FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
        "obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or '
        "implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    ("GPL-2.0", _GPL.format("General Public License", "2")),
    ("GPL-3.0", _GPL.format("General Public License", "3")),
    ("AGPL-3.0", _GPL.format("Affero General Public License", "3")),
    ("LGPL-3.0", _GPL.format("Lesser General Public License", "3")),
)
