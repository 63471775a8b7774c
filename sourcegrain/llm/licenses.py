"""License scan by canonical digest lookup [native].

A text is brought to a canonical form (ASCII case, copyright lines, spelling
variants, punctuation and white space) and its SHA-256 digest is hash-joined
to the digests of known licence texts. Only whole texts match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spellings that count as equal (variant, canonical).
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"), ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"),
    ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"),
    ("labour", "labor"), ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"),
    ("maximise", "maximize"), ("modelled", "modeled"), ("modelling", "modeling"), ("noninfringement", "non infringement"), ("offence", "offense"),
    ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"), ("practise", "practice"),
    ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"),
    ("sublicence", "sublicense"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
)

_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
)
_MIT_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
    "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_NOTICE = ", provided that the above copyright notice and this permission notice appear in all copies."
_ISC_AS_IS = (
    " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_3 = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
)
_BSD_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
    "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
    "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
)
_GPL_NOTICE = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or "
    "(at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
    "See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use "
    "this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not "
    "claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, "
    "and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
)

#: Known licence texts and notices (id, text).
KNOWN = (
    ("0BSD", _ISC + "." + _ISC_AS_IS),
    ("Apache-2.0-notice", _APACHE),
    ("Apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", _BSD + _BSD_AS_IS),
    ("BSD-3-Clause", _BSD + _BSD_3 + _BSD_AS_IS),
    ("GPL-3.0-or-later-notice", _GPL_NOTICE),
    ("ISC", _ISC + _ISC_NOTICE + _ISC_AS_IS),
    ("ISC", "ISC License " + _ISC + _ISC_NOTICE + _ISC_AS_IS),
    ("MIT", _MIT + _MIT_AS_IS),
    ("MIT", "MIT License " + _MIT + _MIT_AS_IS),
    ("MIT", "The MIT License (MIT) " + _MIT + _MIT_AS_IS),
    ("MIT-line", "Released under the MIT License."),
    ("MIT-spdx-line", "SPDX-License-Identifier: MIT"),
    ("Zlib", _ZLIB),
)

#: SHA-256 digests of the canonical form of whole licence texts, as published (id, digest).
KNOWN_DIGESTS = (
    ("Apache-2.0", "045649cdaf85384ba827242062f2f3b36409835c98d297e25177cb1faf7c2847"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71"),
    ("GFDL-1.3", "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "fbe9a0b96f52e03cb474f9a7083781399c011279e85b548118563ec96e659354"),
    ("MPL-2.0", "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lines that name the holders of rights differ from copy to copy and are left out: "copyright" with a mark, a year or
#: a blank to fill in, so that a line of a licence that happens to begin with the word stays; and up to 200 lines of "Copyright" with a name
#: (a capital letter) at the start of a text, below its title, or at the start of a paragraph, where no licence wraps its own lines.
_RIGHTS_LINE = r"(?im)^[ \t\r]*[*#/;]*[ \t]*(?:copyright[ \t]*(?:\(c\)|\x{a9}|[0-9<{:]|\[|by[ \t])|\(c\)[ \t]|\x{a9}|all rights reserved)[^\n]*$"
_HOLDER_LINES = r"(\A(?:[^\n]*\n)?|\n[ \t\r]*\n)(?:[*#/; \t]*(?i:copyright)[ \t]+\p{Lu}[^\n]*(?:\n|\z)){1,200}"
_JOINED = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
#: More known texts than this are joined by a shuffle, not a broadcast.
BROADCAST_ROWS = 10_000


def canonical(text: Column) -> Column:
    """The canonical form: words of lower-case letters and digits with one space between."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), _RIGHTS_LINE, " ")
    out = F.translate(F.regexp_replace(out, _HOLDER_LINES, "$1 "), _UPPER, _LOWER)
    out = F.concat(F.lit(" "), F.regexp_replace(out, _JOINED, "  "), F.lit(" "))
    for variant, plain in SPELLINGS:
        out = F.replace(out, F.lit(f" {variant} "), F.lit(f" {plain} "))
    return F.trim(F.regexp_replace(out, " +", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark, known=KNOWN, digests=KNOWN_DIGESTS) -> DataFrame:
    """digest, license_id of known texts and of texts known by their digest; ties to the smaller id."""
    listed = [F.struct(F.lit(k).alias("license_id"), digest(F.lit(t)).alias("digest")) for k, t in known] + [F.struct(F.lit(k).alias("license_id"), F.lit(d).alias("digest")) for k, d in digests]
    return spark.range(1).select(F.inline(F.array(*listed))).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, known=KNOWN, digests=KNOWN_DIGESTS) -> DataFrame:
    """doc_id, digest, license_id (null: no known licence is the whole text), matched.

    One row per row of docs, whatever it repeats; only doc_id and text are
    read. A null or empty text, or one with nothing but copyright lines, has
    the digest of the empty form and matches nothing. Ties between ids of one
    known digest go to the smaller id. Very long texts take linear time.
    """
    found = known_digests(docs.sparkSession, known, digests)
    rows = docs.select("doc_id", digest(F.col("text")).alias("digest"))
    return rows.join(F.broadcast(found) if len(known) + len(digests) <= BROADCAST_ROWS else found, "digest", "left").select("doc_id", "digest", "license_id", F.col("license_id").isNotNull().alias("matched"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_canonical(text: str) -> str:
    out = f"regexp_replace(regexp_replace(coalesce({text}, ''), '{_RIGHTS_LINE}', ' ', 'g'), '{_HOLDER_LINES}', '\\1 ', 'g')"
    out = f"translate({out}, '{_UPPER}', '{_LOWER}')"
    out = f"' ' || regexp_replace({out}, '{_JOINED}', '  ', 'g') || ' '"
    for variant, plain in SPELLINGS:
        out = f"replace({out}, ' {variant} ', ' {plain} ')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


SQL = (
    "WITH known AS (SELECT digest, min(id) AS license_id FROM (SELECT id, sha256(" + _sql_canonical("t") + ") AS digest FROM (VALUES "
    + ", ".join(f"({_quoted(k)}, {_quoted(t)})" for k, t in KNOWN)
    + ") AS v(id, t) UNION ALL VALUES " + ", ".join(f"({_quoted(k)}, {_quoted(d)})" for k, d in KNOWN_DIGESTS)
    + ") GROUP BY 1), d AS (SELECT doc_id, sha256(" + _sql_canonical("text") + ") AS digest FROM documents) "
    "SELECT d.doc_id, d.digest, known.license_id, known.license_id IS NOT NULL AS matched FROM d LEFT JOIN known USING (digest)"
)
