"""Licence scan by canonical digest lookup.

A text is brought to a canonical form (case, copyright lines, equivalent spellings, punctuation), and the
digest of the whole form is looked up among the digests of known licences by a hash join. Whole documents
and their single lines (for one-line notices) are looked up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Spellings that count as equal, by the public guidelines for licence matching.
EQUIVALENT = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"), ("emphasised", "emphasized"),
    ("favour", "favor"), ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"),
    ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"), ("maximise", "maximize"),
    ("modelled", "modeled"), ("modelling", "modeling"), ("offence", "offense"), ("optimise", "optimize"),
    ("organisation", "organization"), ("organise", "organize"), ("practise", "practice"), ("programme", "program"),
    ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"), ("sub license", "sublicense"),
    ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"), ("non commercial", "noncommercial"),
    ("per cent", "percent"), ("copyright owner", "copyright holder"), ("https", "http"),
)

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3RD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""

_APACHE_HEAD = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_MPL_HEAD = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_GPL_HEAD = """This {thing} is free software: you can redistribute it and/or modify it under the terms of the GNU {title} as published by the Free Software Foundation, either version {n} of the License, or (at your option) any later version. This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {title} for more details. You should have received a copy of the GNU {title} along with this {thing}. If not, see <https://www.gnu.org/licenses/>."""
_GPL_NAMES = (("GPL", "General Public License", "program", "2"), ("GPL", "General Public License", "program", "3"), ("LGPL", "Lesser General Public License", "library", "2.1"), ("LGPL", "Lesser General Public License", "program", "3"), ("AGPL", "Affero General Public License", "program", "3"))
#: SHA-256 of the canonical form of long licences, the whole text and the terms without the appendix
#: that tells how to apply them.
DIGESTS: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "ebc600199db9838b4fc2d5288a12598c2702142177a89b3443f5cc87b137d94b"),
    ("Apache-2.0", "23c0498e738b86da84fa1ffb1ff43f4ef103f365367077ada18cd1db1813d6da"),
    ("Apache-2.0", "98378616989e23431b15181388a001fdeac0999db741918e302c5162392bcfbd"),
    ("Artistic-1.0-Perl", "ddb49d591ecc4f65a223b9f53f330918100c323532a653c090d21b38e35a3a42"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "19d29a7c800a0d85704b63b4c09d5cd01dd9a287c61e238f4717d8a9e75d214f"),
    ("GFDL-1.2", "337a6b06f88d908a84d6cc98a9d560fee1b8a17edd0e4d3eac0cbc7d1df30abe"),
    ("GFDL-1.3", "e70f40f3a50995855f972521fe4eaa4af360a4597e5914977b6093cce5243480"),
    ("GFDL-1.3", "0ceebbb7b6e73e86638816e6996de1984798f9b56e7db2ee39d211853d9bfe72"),
    ("GPL-1.0", "ecffd792bbe30a8f068c26179a7995c53247219322c9fdd6010c935476aec4fd"),
    ("GPL-1.0", "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70"),
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-2.0", "ceb13cdc7143ca5f58fb64136b9b542b00470d4db4dbcee1328c6250bf845b08"),
    ("GPL-2.0", "a1e7ba14d8d85807f384435b77f91e925decc43da128311c991c4f2337e44017"),
    ("GPL-2.0", "e4d14510e41435c3eb12c255b72546a3cb9943f06f209c72bc30a19095b08999"),
    ("GPL-3.0", "baa8c61cc079d9c70231aa29a72e8c512fc4474cf75133d41bc9aacb7768b6eb"),
    ("GPL-3.0", "f37d587507fc579524cb06d1130d5899891a978ee008cfc033b3b4d95da28bee"),
    ("GPL-3.0", "f7bb29d9a31c3a1a68ccff0d8d9053350dc0b10b52b62d46d0f2e36a41e32975"),
    ("LGPL-2.0", "bb476e23f93731f9ea53e5e7b83c7b6a59108767834823d05ca20e6446de79bf"),
    ("LGPL-2.0", "e0de5033b5ad2a24c0a1a8b04f09e33038ffa62d2bef7178de2a3c6f5d56f499"),
    ("LGPL-2.0", "ff773d8d898dfc51ae2dbf3baa20700673e8ceb153b13d26c525af34a59adf0c"),
    ("LGPL-2.1", "a85084b195866fe5aa81ee399a54444581dffa68e7bb2559e143718f6e2693bb"),
    ("LGPL-2.1", "9bf9c99aeafbdbccd7456a00d574699e3deb41868375496cacbf170be719bebd"),
    ("LGPL-2.1", "963f79d48038eed98d8341c84d8d3b765e99508a738d00654c0112f70a7c370c"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "fcb579371133afd771fed87cd5d8c6dc5648746c9945d4adf08ec5c79aba5c61"),
    ("MPL-2.0", "9e79a7d513376f6fa1500e4df4f6276c6e7e61c5c3e28dcdb1acee24033acc56"),
)

_NAMED = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 License"),
    "MIT": ("MIT License",),
    "BSD-2-Clause": ("BSD 2-Clause License",),
    "BSD-3-Clause": ("BSD 3-Clause License",),
    "ISC": ("ISC License",),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal License"),
    "Unlicense": ("Unlicense",),
}
_PHRASES = ("Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}", "This work is licensed under {}", "This work is licensed under the {}", "This work is licensed under a {}", "This software is licensed under the {}", "This project is licensed under the {}", "Distributed under the {}", "Distributed under {}")


def known() -> list[tuple[str, str]]:
    """(licence, text) of the known licences and notices; every text holds one of the ANCHORS."""
    whole = [
        ("MIT", _MIT), ("MIT", "MIT License\n\n" + _MIT), ("MIT", "The MIT License (MIT)\n\n" + _MIT),
        ("ISC", f"{_ISC}\n\n{_ISC_END}"), ("ISC", f"ISC License\n\n{_ISC}\n\n{_ISC_END}"),
        ("0BSD", f"{_ISC.partition(', provided')[0]}.\n\n{_ISC_END}"),
        ("BSD-2-Clause", f"{_BSD_HEAD}\n\n{_BSD_END}"), ("BSD-2-Clause", f"BSD 2-Clause License\n\n{_BSD_HEAD}\n\n{_BSD_END}"),
        ("BSD-3-Clause", f"{_BSD_HEAD}\n\n{_BSD_3RD}\n\n{_BSD_END}"), ("BSD-3-Clause", f"BSD 3-Clause License\n\n{_BSD_HEAD}\n\n{_BSD_3RD}\n\n{_BSD_END}"),
        ("Zlib", _ZLIB), ("Zlib", "zlib License\n\n" + _ZLIB),
    ]
    whole += [("Apache-2.0", _APACHE_HEAD), ("MPL-2.0", _MPL_HEAD)]
    whole += [(f"{short}-{n if '.' in n else n + '.0'}", _GPL_HEAD.format(thing=thing, title=title, n=n)) for short, title, thing, n in _GPL_NAMES]
    notices = [(name, p.format(title)) for name, titles in _NAMED.items() for title in titles for p in _PHRASES]
    tags = [(name, f"SPDX-License-Identifier: {name}{end}") for name in (*_NAMED, "0BSD", "Zlib") for end in (("", "-only", "-or-later") if "GPL" in name else ("",))]
    return whole + notices + tags


#: Every known text holds one of these in its canonical form, and so in its lower-case form with the marks
#: and spellings before; a text without any of them isn't looked up.
ANCHORS = ("licen", "permission", "redistribution", "released", "distributed")
_ANCHOR = "|".join(ANCHORS)
#: Lines that only state who holds the copyright, and what stands for a mark.
_COPYRIGHT = r"(?m)^[^a-z0-9\n]*(?:copyright|\(c\)|all rights reserved|©)[^\n]*$"
_MARKS = r"[^a-z0-9]+"
_EMPTY_LINES = r"\n(?:[ \t\r]*\n)+"


def canonical(text: Column) -> Column:
    """Lower case; copyright lines go; marks and white space become single spaces; spellings are made equal."""
    out = F.regexp_replace(F.lower(text), _COPYRIGHT, " ")
    out = F.trim(F.regexp_replace(out, _MARKS, " "))
    for given, means in EQUIVALENT:
        out = F.replace(out, F.lit(given), F.lit(means))
    return out


def digests_of(licences: DataFrame) -> DataFrame:
    """(license, digest) of (license, text)."""
    return licences.select("license", F.sha2(canonical(F.col("text")), 256).alias("digest"))


def scan(docs: DataFrame, licences: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep, scope (`text`: the whole document, `block`, `line`), line_no (number of the block or line, from 1; 0
    for the whole), license.

    licences: (license, digest) of canonical texts, as digests_of() makes them; the join is broadcast by the
    optimizer only below its size threshold. Blocks are runs of several lines without an empty one, such as the
    comment at the head of a file. Texts, blocks and lines without any of the ANCHORS aren't looked up, so a licence
    whose text holds none of these words is never found. Documents without a known licence give no row, repeated
    rows give a row each; null and empty texts match nothing. A line or block equal to the whole text is reported
    once, as text.
    """
    digests = licences.select("license", F.col("digest").alias("__digest")).distinct()
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__text"))
    rows = rows.where(F.lower("__text").rlike(_ANCHOR))
    unit = lambda scope, split: F.transform(split, lambda x, i: F.struct(F.lit(scope).alias("scope"), (i + 1).cast("long").alias("line_no"), x.alias("unit")))
    none = F.array().cast("array<struct<scope:string,line_no:bigint,unit:string>>")
    some = lambda scope, split, of: F.when(F.size(split) > 1, F.filter(unit(scope, split), of)).otherwise(none)
    lines = some("line", F.split("__text", "\n"), lambda x: F.lower(x["unit"]).rlike(_ANCHOR))
    blocks = some("block", F.split("__text", _EMPTY_LINES), lambda x: x["unit"].contains("\n") & F.lower(x["unit"]).rlike(_ANCHOR))
    whole = F.array(F.struct(F.lit("text").alias("scope"), F.lit(0).cast("long").alias("line_no"), F.col("__text").alias("unit")))
    units = rows.select(*[F.col(f"`{c}`") for c in keep], F.explode(F.concat(whole, blocks, lines)).alias("__u"))
    units = units.select(*[F.col(f"`{c}`") for c in keep], "__u.scope", "__u.line_no", F.sha2(canonical(F.col("__u.unit")), 256).alias("__digest"))
    return units.join(digests, "__digest").select(*[F.col(f"`{c}`") for c in keep], "scope", "line_no", "license")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    licences = digests_of(spark.createDataFrame(known(), "license string, text string"))
    licences = licences.unionByName(spark.createDataFrame(list(DIGESTS), "license string, digest string"))
    return scan(table(spark, sf_dir, "documents"), licences, ["doc_id"])


def _sql_canonical(text: str) -> str:
    out = f"trim(regexp_replace(regexp_replace(lower({text}), '{_COPYRIGHT}', ' ', 'g'), '{_MARKS}', ' ', 'g'))"
    for given, means in EQUIVALENT:
        out = f"replace({out}, '{given}', '{means}')"
    return out


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SQL = f"""
WITH known(license, text) AS (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in known())}),
digests AS (SELECT license, sha256({_sql_canonical("text")}) AS digest FROM known UNION SELECT * FROM (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in DIGESTS)}) v(license, digest)),
d AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts, string_split_regex(text, '{_EMPTY_LINES}') AS blocks FROM documents WHERE regexp_matches(lower(text), '{_ANCHOR}')),
units AS (
  SELECT doc_id, 'text' AS scope, 0::BIGINT AS line_no, text AS unit FROM d
  UNION ALL
  SELECT doc_id, 'block', line_no, unit FROM (
    SELECT doc_id, unnest(blocks) AS unit, generate_subscripts(blocks, 1)::BIGINT AS line_no FROM d WHERE len(blocks) > 1)
  WHERE contains(unit, chr(10)) AND regexp_matches(lower(unit), '{_ANCHOR}')
  UNION ALL
  SELECT doc_id, 'line', line_no, unit FROM (
    SELECT doc_id, unnest(parts) AS unit, generate_subscripts(parts, 1)::BIGINT AS line_no FROM d WHERE len(parts) > 1)
  WHERE regexp_matches(lower(unit), '{_ANCHOR}'))
SELECT doc_id, scope, line_no, license FROM units JOIN digests ON digest = sha256({_sql_canonical("unit")})
"""
