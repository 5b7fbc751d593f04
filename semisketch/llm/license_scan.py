"""Licence scan: whole texts against known licences by canonical digest.

DataFrame functions only. A text is brought to a canonical form (case, punctuation,
copyright lines and equivalent spellings do not count), digested, and the digest is
hash-joined with those of the known licences, so the cost per document does not depend
on how many licences are known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

#: Fixed value: a line of its own that states a holder, a year or reserved rights.
HOLDER_LINE = (
    r"(?m)^[ \t]*(?:copyright[ \t]*(?:\(c\)|©|[0-9]{4}|by\b|holders?:)|\(c\)[ \t]|©|all rights reserved)[^\n]*$"
)
#: Fixed value: what is not a letter or digit.
NOT_WORD = r"[^0-9a-z\x{80}-\x{10FFFF}]+"
#: Typographic signs that count as punctuation.
SIGNS = "‘’“”–—…•· ©®™§"
#: Spellings that mean the same, after punctuation is gone.
SPELLINGS = (
    ("licences?|licenses", "license"),
    ("licenced", "licensed"),
    ("sub licens", "sublicens"),
    ("sublicence", "sublicense"),
    ("non commercial", "noncommercial"),
    ("merchantibility", "merchantability"),
    ("copyright holders?|copyright owners?|authors?", "holder"),
    ("https?", "http"),
    ("version ([0-9])", "$1"),
    ("v([0-9])", "$1"),
    ("([0-9]) 0", "$1"),
)

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, '
    "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
    "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
    "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
    "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO '
    "THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO "
    "EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
    "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER "
    "IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
    "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_TERMS = (
    "Redistribution and use in source and binary forms, with or without modification, are "
    "permitted provided that the following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of "
    "conditions and the following disclaimer in the documentation and/or other materials "
    "provided with the distribution.\n"
)
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS '
    "OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
    "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
    "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
    "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
    "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Public licence texts and notices, by SPDX identifier.
KNOWN = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
     'software and associated documentation files (the "Software"), to deal in the Software '
     "without restriction, including without limitation the rights to use, copy, modify, merge, "
     "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
     "to whom the Software is furnished to do so, subject to the following conditions:\n"
     "The above copyright notice and this permission notice shall be included in all copies or "
     "substantial portions of the Software.\n" + _WARRANTY),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
     "without fee is hereby granted, provided that the above copyright notice and this permission "
     "notice appear in all copies.\n" + _ISC_WARRANTY),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
     "without fee is hereby granted.\n" + _ISC_WARRANTY),
    ("BSD-2-Clause", _BSD_TERMS + _BSD_WARRANTY),
    ("BSD-3-Clause", _BSD_TERMS + "3. Neither the name of the copyright holder nor the names of its "
     "contributors may be used to endorse or promote products derived from this software without "
     "specific prior written permission.\n" + _BSD_WARRANTY),
    ("MIT-0", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
     'software and associated documentation files (the "Software"), to deal in the Software '
     "without restriction, including without limitation the rights to use, copy, modify, merge, "
     "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
     "to whom the Software is furnished to do so.\n" + _WARRANTY),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event "
     "will the authors be held liable for any damages arising from the use of this software.\n"
     "Permission is granted to anyone to use this software for any purpose, including commercial "
     "applications, and to alter it and redistribute it freely, subject to the following restrictions:\n"
     "1. The origin of this software must not be misrepresented; you must not claim that you wrote "
     "the original software. If you use this software in a product, an acknowledgment in the product "
     "documentation would be appreciated but is not required.\n"
     "2. Altered source versions must be plainly marked as such, and must not be misrepresented as "
     "being the original software.\n"
     "3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this '
     "file except in compliance with the License. You may obtain a copy of the License at\n"
     "http://www.apache.org/licenses/LICENSE-2.0\n"
     "Unless required by applicable law or agreed to in writing, software distributed under the "
     'License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
     "either express or implied. See the License for the specific language governing permissions "
     "and limitations under the License."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the "
     "terms of the GNU General Public License as published by the Free Software Foundation, either "
     "version 3 of the License, or (at your option) any later version.\n"
     "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
     "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See "
     "the GNU General Public License for more details.\n"
     "You should have received a copy of the GNU General Public License along with this program. If "
     "not, see <https://www.gnu.org/licenses/>."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
)


def canonical(text: Column) -> Column:
    """The canonical form; empty for null and for texts without letters or digits.

    Only whole lines that name a copyright go, unless nothing else is left of the text.
    A line that holds licence prose beside the word (``the above copyright notice``)
    is told from a holder's line by its sign, its year or its beginning.
    """
    lowered = ascii_lower(F.coalesce(text, F.lit("")))
    rest = F.regexp_replace(lowered, HOLDER_LINE, "")
    signs = F.translate(rest, SIGNS, " " * len(SIGNS))
    words = F.btrim(F.regexp_replace(signs, NOT_WORD, " "))
    for spelling, one in SPELLINGS:
        words = F.regexp_replace(words, rf"\b(?:{spelling})\b" if "$1" not in one else rf"\b{spelling}\b", one)
    return words


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_licenses(spark: SparkSession, texts=KNOWN) -> DataFrame:
    """``(digest, license_id)`` of known texts; of equal digests the first id stays.

    ``texts`` is a list of pairs, or a table of ``license_id, text`` of any size.
    """
    rows = texts if isinstance(texts, DataFrame) else spark.createDataFrame(list(texts), "license_id string, text string")
    return rows.groupBy(digest(F.col("text")).alias("digest")).agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``(doc_id, digest, license_id)`` of every document; ``license_id`` is null where
    the whole text is no known licence.

    Nulls and empty texts digest as the empty form and match nothing. Repeated rows are
    scanned one by one. ``known`` is any table of digests: one that Spark knows to be
    small is broadcast, a larger one is joined by shuffled digests, where copies of one
    text are a hot key that adaptive execution splits.
    """
    rows = docs.select("doc_id", canonical(F.col("text")).alias("canonical"))
    rows = rows.select("doc_id", F.sha2("canonical", 256).alias("digest"))
    empty = F.sha2(F.lit(""), 256)
    return rows.join(known.filter(F.col("digest") != empty), "digest", "left").select("doc_id", "digest", "license_id")
