"""License scans by canonical digest lookup, with DataFrame operations alone.

A text is brought to a canonical form: lower case, equivalent spellings made one, copyright lines, punctuation and runs of
white space gone. Its digest is joined with those of known licence texts: a fixed table, of texts given here and of digests of the
longer ones. Each line and each paragraph that is not a copyright line is looked up in the same way, for notices; the text is
brought to its form once for all three.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import quoted

#: Spellings that count as equal, the second standing for both.
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "cancelled": "canceled",
    "catalogue": "catalog",
    "centre": "center",
    "copyright owner": "copyright holder",
    "favour": "favor",
    "favourite": "favorite",
    "fulfil": "fulfill",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelling": "labeling",
    "licence": "license",
    "licenced": "licensed",
    "licences": "licenses",
    "modelling": "modeling",
    "organisation": "organization",
    "organise": "organize",
    "per cent": "percent",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "signalling": "signaling",
    "sub license": "sublicense",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
    "http": "https",
}

_WARRANTY_MIT = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_GRANT_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
    '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
_WARRANTY_BSD = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED '
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GRANT_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_GRANT_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
)
_WARRANTY_ISC = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
    "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
    "from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
    "alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must "
    "not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
    "appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original "
    "software. 3. This notice may not be removed or altered from any source distribution."
)
_BOOST = (
    'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation '
    'covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative '
    "works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright "
    "notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be "
    "included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are "
    "solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT "
    "WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, "
    "TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
#: Published licence texts and notices, by SPDX identifier.
KNOWN = (
    ("MIT", "MIT License " + _GRANT_MIT + ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY_MIT),
    ("MIT", _GRANT_MIT + ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY_MIT),
    ("MIT-0", "MIT No Attribution " + _GRANT_MIT + ". " + _WARRANTY_MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("BSD-2-Clause", "BSD 2-Clause License " + _GRANT_BSD + _WARRANTY_BSD),
    ("BSD-2-Clause", _GRANT_BSD + _WARRANTY_BSD),
    ("BSD-3-Clause", "BSD 3-Clause License " + _GRANT_BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _WARRANTY_BSD),
    ("BSD-3-Clause", _GRANT_BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _WARRANTY_BSD),
    ("ISC", "ISC License " + _GRANT_ISC + ", provided that the above copyright notice and this permission notice appear in all copies. " + _WARRANTY_ISC),
    ("ISC", _GRANT_ISC + ", provided that the above copyright notice and this permission notice appear in all copies. " + _WARRANTY_ISC),
    ("0BSD", "BSD Zero Clause License " + _GRANT_ISC + ". " + _WARRANTY_ISC),
    ("Zlib", "zlib License " + _ZLIB),
    ("Zlib", _ZLIB),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003 " + _BOOST),
    ("BSL-1.0", _BOOST),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
)


#: SHA-256 of the canonical forms of longer texts as published: whole, up to the end of their terms, and without that line;
#: and of the licence files that packages publish in other wordings or with other headings.
DIGESTS = {
    "25a274d52b3014d9bd64e0f3362fd279ac1655f163d5c518f6b9f6c43354802c": "0BSD",
    "8318fc18753641674a0b35f73f00e865e8cceb1ed8b6eb85f62d4a5d5146a5f1": "Apache-2.0",
    "6530dac82be99e5bbcc128a6caf5bfdd0451a21fe23ac3df15ed85a1c550c859": "Apache-2.0",
    "2b4a3f34572f63637f58db72bdacad38516a1e1e6788b08931d0a0d5c0be33dd": "Apache-2.0",
    "6366c4fe55cd4a3d37bfe3798a0b5d7cb972fd18662663ce3bd50855a8e6dd50": "Apache-2.0",
    "45c5565dedc03ff2a570c67c5af611f8a3d0a0227c6e81d9fb11fbf0c004b959": "Apache-2.0",
    "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702": "Artistic-1.0",
    "a5a08badf4f858856e4ae957819d129c23951a120461f1afdc3b9ea889264f00": "Artistic-2.0",
    "17c874d8b4f2dad075c57f6a98f014a7c9a2cdc0d3046a532cba6120dc31711e": "BlueOak-1.0.0",
    "6cffa606d4960a0fadb3c8161a99b92c53dbe7b999697a5e26d35cfdc1d80f3d": "BlueOak-1.0.0",
    "032f33a9fad178d38ba062bc5f6e47fde5eb48f13d4c8895fe1360e806c83a69": "BSD-2-Clause",
    "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f": "CC0-1.0",
    "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71": "GFDL-1.2-only",
    "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6": "GFDL-1.3-only",
    "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224": "GPL-1.0-only",
    "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc": "GPL-1.0-only",
    "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70": "GPL-1.0-only",
    "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821": "GPL-2.0-only",
    "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34": "GPL-2.0-only",
    "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808": "GPL-2.0-only",
    "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68": "GPL-3.0-only",
    "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636": "GPL-3.0-only",
    "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191": "GPL-3.0-only",
    "26e4206957c7666b28ef84b2af8d4b65149b7bd410821beb7eb11a2c67691c3a": "ISC",
    "13db54df0465781e4f38f2a1d5bc17ae68060b438e0595b7f1c6a358ddea332f": "ISC",
    "63baaf2854baf0bb2e682f11a1853fb567b1e4cc0321733264b9b1cea90dc48d": "ISC",
    "2b614fb2c18253fb7c1d5d24276593e12d81b854b5e79442a26885adc7ddc0c0": "ISC",
    "40e6eb51c3b409d93549806b55b249c261dab149d19b56cc163624f39a08b1db": "ISC",
    "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908": "LGPL-2.0-only",
    "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260": "LGPL-2.0-only",
    "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2": "LGPL-2.0-only",
    "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891": "LGPL-2.1-only",
    "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4": "LGPL-2.1-only",
    "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df": "LGPL-2.1-only",
    "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be": "LGPL-3.0-only",
    "05b5bb4210ef34613b7fba09acceb67f4d5c44c9dbbe4dcd3d48fd2df7d2b076": "MIT",
    "aa3ae45a7d28a73e578dac7bfd3bc13e51e870807df0dc5ded9c1b2ffb1efe17": "MIT",
    "c7754aa1635a9d3a327d430f623da9fb11bb1057f480f376c86472d921581038": "MIT",
    "72c5f2893682c3a79d1365d75700aa0b60dc8eb2db88735ab26c1c2ee10f3f58": "MIT",
    "899c82726aa63d714765cb656cfa0f128d93af497bf389da5ea13a633f68d2bd": "MIT",
    "c9e0b21ff70f6dd1855f8a502dd7a9f1911ad6fcf2dfadda0b0770fd5a43808c": "MIT",
    "6ad3654379e72bbdf8478d5c90fb1e2525aba033fbe675e0ef2248aac67c0f6f": "MIT",
    "26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986": "MPL-1.1",
    "9eab7902f21bef0326dee4ed0cae1402c781cbf1f8e3dbeed6fbe176d641bb13": "MPL-2.0",
    "0e59092bad8c558766e5ee70e352d2fff12b82132cf77ce17060e87fc44e13aa": "Python-2.0",
    "fd1b07be5f4f94926b6ea4df3943b05ab90c1a1f3b1a3d574ae7ab58bca58fff": "Unlicense",
}

COPYRIGHT = r"(?im)^[^\p{L}\n]*(?:copyright\b[^\n]*(?:\d{4}|\(c\)|©)|\(c\) ?\d{4}|©|all rights reserved)[^\n]*$"
PHRASES = {a: b for a, b in SPELLINGS.items() if " " in a}


def folded(text: Column) -> Column:
    """A text in lower case, of words with one space between and line ends, copyright lines gone, words and phrases of a line spelled alike."""
    out = F.regexp_replace(F.lower(F.regexp_replace(text, COPYRIGHT, " ")), r"[^\p{L}\p{N}\n]+", " ")
    padded = F.concat(F.lit(" "), out, F.lit(" "))
    # most texts hold none of the spellings; in those that do, words stand apart by two spaces while they are replaced
    hit = r"(?<=[ \n])(?:" + "|".join(sorted(SPELLINGS, key=len, reverse=True)) + r")(?=[ \n])"
    apart = F.replace(F.replace(padded, F.lit(" "), F.lit("  ")), F.lit("\n"), F.lit("  \n  "))
    for a, b in SPELLINGS.items():
        apart = F.replace(apart, F.lit(" " + a.replace(" ", "  ") + " "), F.lit(f" {b} "))
    return F.when(padded.rlike(hit), F.regexp_replace(apart, " +", " ")).otherwise(padded)


def joined(fold: Column) -> Column:
    """A folded text, or a part of one, as words with one space between; phrases that a line end parts are spelled alike too."""
    out = F.trim(F.regexp_replace(fold, r" *\n[ \n]*", " "))
    for a, b in PHRASES.items():
        padded = F.concat(F.lit(" "), out, F.lit(" "))
        out = F.when(F.contains(out, F.lit(a)), F.trim(F.regexp_replace(padded, f"(?<= ){a}(?= )", b))).otherwise(out)
    return out


def canonical(text: Column) -> Column:
    """A text's canonical form; null stays null. Copyright lines go before anything else."""
    return joined(folded(text))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, known: tuple[tuple[str, str], ...] = KNOWN, digests: Mapping[str, str] = DIGESTS) -> DataFrame:
    """(digest, license, size): one row for each digest; size, the length of the canonical text, is null where only the digest is known."""
    values = ", ".join("({}, {})".format(*("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in row)) for row in known) or "('', '')"
    texts = spark.sql(f"SELECT * FROM VALUES {values} AS t(license, text)").select(canonical(F.col("text")).alias("text"), "license")
    own = texts.select(F.sha2("text", 256).alias("digest"), "license", F.length("text").alias("size"))
    if digests:
        own = own.unionByName(spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{d}', '{n}')" for d, n in digests.items()) + " AS t(digest, license)").withColumn("size", F.lit(None).cast("int")))
    return own.where(F.col("digest") != F.sha2(F.lit(""), 256)).groupBy("digest").agg(F.min("license").alias("license"), F.min("size").alias("size"))


def licensed(df: DataFrame, known: tuple[tuple[str, str], ...] = KNOWN, more: DataFrame | None = None, id_col: str = "doc_id", text: str = "text", digests: Mapping[str, str] = DIGESTS) -> DataFrame:
    """One row per row of df: its id, digest, license (of the whole text) and notices (licences of its lines and paragraphs, sorted).

    known and digests are lists that the caller wrote down: they go to all tasks. A table `more` (digest, license) of any
    size is joined by digest; known wins, and of several licences of a digest the least. license is null and notices empty without a match; a null text has a
    null digest, an empty one the digest of nothing, which is never a licence. Rows that repeat, and their ids, come back as
    often. Other columns play no part.
    """
    own = known_digests(df.sparkSession, known, digests)
    listed = own.where("size is not null").collect()  # no more than the list has
    look = F.create_map(*(F.lit(x) for r in listed for x in (r["digest"], r["license"]))) if listed else F.lit(None).cast("map<string,string>")
    sizes = sorted({r["size"] for r in listed}) or [-1]
    # only what is as long as a known notice can be one
    named = lambda parts: F.filter(F.transform(F.filter(parts, lambda x: F.length(x).isin(*sizes)), lambda x: F.try_element_at(look, F.sha2(x, 256))), lambda x: x.isNotNull())
    lines = named(F.transform(F.split("fold", "\n"), lambda x: F.trim(x)))
    parted = F.contains("fold", F.lit("\n\n")) | F.contains("fold", F.lit("\n \n"))
    paragraphs = F.when(parted, named(F.transform(F.split("fold", r"\n *\n"), joined))).otherwise(F.array().cast("array<string>"))
    notices = F.sort_array(F.array_distinct(F.concat(lines, paragraphs)))
    texts = df.select(F.col(quoted(id_col)).alias("id"), folded(F.col(quoted(text))).alias("fold")).select("id", F.sha2(joined(F.col("fold")), 256).alias("digest"), F.coalesce(notices, F.array().cast("array<string>")).alias("notices"))
    out = texts.join(F.broadcast(own.drop("size")), "digest", "left")
    if more is not None:
        out = out.join(more.groupBy("digest").agg(F.min("license").alias("__more")), "digest", "left").withColumn("license", F.coalesce("license", "__more"))
    return out.select(F.col("id").alias(id_col), "digest", "license", "notices")
