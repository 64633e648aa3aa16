r"""Licence scan by canonical digest (DataFrame functions only).

A text's canonical form: lower case; without copyright lines (a line that begins with a copyright mark and a
year, holder's place or mark) and "all rights reserved" lines; words (runs of letters and digits) parted by one
blank; equivalent spellings replaced by one of them.  Whole texts are joined by the SHA-256 of that form to the
digests of known licences.  So are their whole lines and whole paragraphs (lines up to a blank one), as a licence
or notice mostly stands inside a longer text: ``notices`` lists what they match.

One scan: a text's digests are exploded, joined to the known ones, and only the whole text's and those that match
go on to one shuffle by doc_id and digest.

Defined results: a null text counts as empty; an empty form matches nothing; rows come back one for one, repeated
rows too; of known licences with equal canonical forms the first id is reported; an empty table gives no rows;
further columns are ignored.  A spelling of two words that a line break parts is not replaced inside a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that licence matching treats as equal, as published in the SPDX matching guidelines
# (second form replaced by the first).
EQUIVALENT = [
    ("acknowledgment", "acknowledgement"), ("analog", "analogue"), ("analyze", "analyse"), ("artifact", "artefact"), ("authorization", "authorisation"),
    ("authorized", "authorised"), ("caliber", "calibre"), ("canceled", "cancelled"), ("capitalizations", "capitalisations"), ("catalog", "catalogue"),
    ("categorize", "categorise"), ("center", "centre"), ("emphasized", "emphasised"), ("favor", "favour"), ("favorite", "favourite"), ("fulfill", "fulfil"),
    ("fulfillment", "fulfilment"), ("initialize", "initialise"), ("judgment", "judgement"), ("labeling", "labelling"), ("labor", "labour"),
    ("license", "licence"), ("maximize", "maximise"), ("modeled", "modelled"), ("modeling", "modelling"), ("offense", "offence"), ("optimize", "optimise"),
    ("organization", "organisation"), ("organize", "organise"), ("practice", "practise"), ("program", "programme"), ("realize", "realise"),
    ("recognize", "recognise"), ("signaling", "signalling"), ("sublicense", "sublicence"), ("utilization", "utilisation"), ("while", "whilst"),
    ("willful", "wilful"), ("noncommercial", "non commercial"), ("sublicense", "sub license"), ("percent", "per cent"), ("copyright holder", "copyright owner"), ("http", "https"),
]

# Short texts of well-known licences and notices.
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD_TWO = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THREE = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
KNOWN = {
    "MIT": _MIT,
    "MIT (titled)": "MIT License " + _MIT,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _AS_IS,
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _AS_IS,
    "BSD-2-Clause": f"{_BSD_TWO} {_BSD_END}",
    "BSD-3-Clause": f"{_BSD_TWO}{_BSD_THREE} {_BSD_END}",
    "Apache-2.0 (notice)": "Licensed under the Apache License, Version 2.0.",
    "MIT (notice)": "Released under the MIT License.",
    "GPL-3.0 (notice)": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 (notice)": "Licensed under CC BY-NC 4.0.",
}

_COPYRIGHT = r"(?m)^[^\p{L}\p{N}\n©(]*(?:copyright[^\p{L}\p{N}\n©(<\[]*(?:©|\(c\)|[0-9]{4}|<|\[)|(?:©|\(c\)))[^\n]*$"
_RESERVED = r"(?m)^[^\p{L}\p{N}\n]*all rights reserved[^\p{L}\p{N}\n]*$"
_BETWEEN = r"[^\p{L}\p{N}\n]+"


_ONE = [(a, b) for a, b in EQUIVALENT if " " not in a + b]
_TWO = [(a, b) for a, b in EQUIVALENT if " " in a + b]


def _spelled(t: Column, pairs: list[tuple[str, str]]) -> Column:
    for one, other in pairs:
        t = F.replace(t, F.lit(f" {other.replace(' ', '  ')} "), F.lit(f" {one.replace(' ', '  ')} "))
    return t


def lined(text: Column) -> Column:
    """A text's words, each with blanks of its own, line by line, in one spelling as far as single words go."""
    t = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    t = F.regexp_replace(F.regexp_replace(t, _COPYRIGHT, ""), _RESERVED, "")
    t = F.replace(F.concat(F.lit(" "), F.regexp_replace(t, _BETWEEN, "  "), F.lit(" ")), F.lit("\n"), F.lit(" \n "))
    return _spelled(t, _ONE)


def finished(t: Column) -> Column:
    """The canonical form of a stretch of lined()."""
    t = F.regexp_replace(t, " *\n *", "  ")
    return F.trim(F.replace(_spelled(t, _TWO), F.lit("  "), F.lit(" ")))


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    return finished(lined(text))


def digests(texts: DataFrame) -> DataFrame:
    """licence_id and digest of known licences (licence_id, text)."""
    known = texts.select(F.col("licence_id"), F.sha2(canonical(F.col("text")), 256).alias("digest"))
    return known.groupBy("digest").agg(F.min("licence_id").alias("licence_id"))


def scan(docs: DataFrame, known: DataFrame, most: int = 500_000) -> DataFrame:
    """doc_id, canonical_sha256, licence_id of the whole text (null: none), matched, and notices (sorted ids of whole
    lines and paragraphs) of every row.

    ``known`` (digest, licence_id) is broadcast up to ``most`` rows; a longer list is joined by shuffling digests.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lined(F.col("text")).alias("t"))
    digest = lambda t: F.sha2(finished(t), 256)
    inner = F.concat(F.split("t", "\n"), F.split("t", "\n *\n"))
    inner = F.transform(F.filter(F.array_distinct(F.transform(inner, finished)), lambda x: x != ""), lambda x: F.struct(F.sha2(x, 256).alias("digest"), F.lit(False).alias("whole")))
    each = rows.select("doc_id", digest(F.col("t")).alias("canonical_sha256"), inner.alias("i"))
    each = each.select("doc_id", "canonical_sha256", F.explode(F.concat(F.array(F.struct(F.col("canonical_sha256").alias("digest"), F.lit(True).alias("whole"))), "i")).alias("d")).select("doc_id", "canonical_sha256", "d.*")
    known = known.select("digest", "licence_id").where(F.col("digest") != F.sha2(F.lit(""), 256))
    known = F.broadcast(known) if known.limit(most + 1).count() <= most else known
    met = each.join(known, "digest", "left").where("whole OR licence_id IS NOT NULL")
    got = met.groupBy("doc_id", "canonical_sha256").agg(F.count_if("whole").alias("n"), F.max(F.when(F.col("whole"), F.col("licence_id"))).alias("licence_id"), F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("licence_id")))).alias("notices"))
    got = got.select("doc_id", "canonical_sha256", "licence_id", "notices", F.explode(F.sequence(F.lit(1).cast("long"), "n")))  # repeated rows
    return got.select("doc_id", "canonical_sha256", "licence_id", F.col("licence_id").isNotNull().alias("matched"), F.array_join("notices", "|").alias("notices"))


def built_in(spark: SparkSession) -> DataFrame:
    return digests(spark.createDataFrame(list(KNOWN.items()), "licence_id string, text string"))


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_spelled(t: str, pairs: list[tuple[str, str]]) -> str:
    for one, other in pairs:
        t = f"replace({t}, {_q(' ' + other.replace(' ', '  ') + ' ')}, {_q(' ' + one.replace(' ', '  ') + ' ')})"
    return t


def _sql_lined(text: str) -> str:
    t = f"lower(coalesce({text}, ''))"
    for rx, to in ((_COPYRIGHT, ""), (_RESERVED, "")):
        t = f"regexp_replace({t}, {_q(rx)}, {_q(to)}, 'g')"
    t = f"replace(' ' || regexp_replace({t}, {_q(_BETWEEN)}, '  ', 'g') || ' ', chr(10), ' ' || chr(10) || ' ')"
    return _sql_spelled(t, _ONE)


def _sql_finished(t: str) -> str:
    t = _sql_spelled(f"regexp_replace({t}, ' *\n *', '  ', 'g')", _TWO)
    return f"trim(replace({t}, '  ', ' '))"


_VALUES = ", ".join(f"({_q(k)}, {_q(v)})" for k, v in KNOWN.items())
ORACLE = f"""
WITH known AS (SELECT digest, min(licence_id) AS licence_id FROM (SELECT licence_id, sha256({_sql_finished("t")}) AS digest FROM (SELECT licence_id, {_sql_lined("text")} AS t FROM (VALUES {_VALUES}) k(licence_id, text))) GROUP BY 1),
d AS MATERIALIZED (SELECT row_number() OVER () AS uid, doc_id, {_sql_lined("text")} AS t FROM documents),
w AS (SELECT uid, doc_id, sha256({_sql_finished("t")}) AS canonical_sha256 FROM d),
u AS (SELECT DISTINCT uid, {_sql_finished("x")} AS x FROM (SELECT uid, unnest(list_concat(string_split(t, chr(10)), regexp_split_to_array(t, '\n *\n'))) AS x FROM d)),
i AS (SELECT uid, string_agg(licence_id, '|' ORDER BY licence_id) AS notices FROM (SELECT DISTINCT uid, licence_id FROM u JOIN known ON sha256(x) = digest WHERE x <> '') GROUP BY uid)
SELECT doc_id, canonical_sha256, licence_id, licence_id IS NOT NULL AS matched, coalesce(notices, '') AS notices FROM w LEFT JOIN known ON canonical_sha256 = digest LEFT JOIN i USING (uid)
"""
