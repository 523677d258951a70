"""Licence scans by sentence rules, with SQL functions alone.

A text is cut into pieces at ends of sentences and lines, and each is
normalised.  Known licence sentences are looked up among runs of whole pieces,
so that a notice is found however its lines are wrapped, and also where a
sentence has ':', ';' or 'v. 2.0' in it.  The sequence of identifiers is then
matched against licence rules in their order; what a rule has matched is used
up for the later ones.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known sentences (fixed values): identifier, sentence as it is normalised.
SENTENCES = (
    ("ApacheHead", "licensed under the apache license version 2 0"),
    ("ApacheHead", "licensed under the apache license version 2 0 the license"),
    ("ApacheUse", "you may not use this file except in compliance with the license"),
    ("ApacheCopy", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("ApacheWarranty", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("ApacheSee", "see the license for the specific language governing permissions and limitations under the license"),
    ("MITName", "released under the mit license"),
    ("MITName", "licensed under the mit license"),
    ("MITName", "this project is licensed under the mit license"),
    ("MITTitle", "the mit license"),
    ("MITTitle", "mit license"),
    ("MITGrant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("MITNotice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("AsIs", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("MITLiable", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("BSDRedistribute", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("BSDSource", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("BSDBinary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("BSDEndorse", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSDAsIs", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("GPL3Name", "this work is licensed under the gnu general public license version 3"),
    ("GPL3Name", "licensed under the gnu general public license version 3"),
    ("GPLFree", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("GPL2Free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("GPLHope", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("GPLSee", "see the gnu general public license for more details"),
    ("MPLSubject", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("CCBYNC", "licensed under cc by nc 4 0"),
    ("CCBY", "licensed under cc by 4 0"),
    ("CCBYSA", "licensed under cc by sa 4 0"),
    ("CC0", "licensed under cc0 1 0"),
    ("SPDXMIT", "spdx license identifier mit"),
    ("SPDXApache", "spdx license identifier apache 2 0"),
    ("SPDXGPL3", "spdx license identifier gpl 3 0 or later"),
    ("AllRights", "all rights reserved"),
)

#: Rules in their order (fixed values): licence, identifiers that must follow one another. Longer rules come before their parts.
RULES = (
    ("Apache-2.0", ("ApacheHead", "ApacheUse", "ApacheCopy", "ApacheWarranty", "ApacheSee")),
    ("Apache-2.0", ("ApacheHead", "ApacheUse", "ApacheCopy")),
    ("Apache-2.0", ("ApacheHead",)),
    ("Apache-2.0", ("SPDXApache",)),
    ("MIT", ("MITGrant", "MITNotice", "AsIs", "MITLiable")),
    ("MIT", ("MITGrant", "MITNotice", "AsIs")),
    ("MIT", ("MITName",)),
    ("MIT", ("SPDXMIT",)),
    ("BSD-3-Clause", ("BSDRedistribute", "BSDSource", "BSDBinary", "BSDEndorse", "BSDAsIs")),
    ("BSD-2-Clause", ("BSDRedistribute", "BSDSource", "BSDBinary", "BSDAsIs")),
    ("GPL-3.0-or-later", ("GPLFree", "GPLHope", "GPLSee")),
    ("GPL-3.0-or-later", ("GPLFree",)),
    ("GPL-3.0-or-later", ("SPDXGPL3",)),
    ("GPL-2.0-or-later", ("GPL2Free", "GPLHope", "GPLSee")),
    ("GPL-2.0-or-later", ("GPL2Free",)),
    ("GPL-3.0-only", ("GPL3Name",)),
    ("MPL-2.0", ("MPLSubject",)),
    ("CC-BY-NC-4.0", ("CCBYNC",)),
    ("CC-BY-SA-4.0", ("CCBYSA",)),
    ("CC-BY-4.0", ("CCBY",)),
    ("CC0-1.0", ("CC0",)),
)

#: A line's leading comment signs.
COMMENT = r"\r?\n[ \t]*(?://+|#+|\*+|--+)?[ \t]*"
#: A line that ends inside a sentence and goes on with a small letter.
WRAPPED = r"([^.!?:;\n])\n([a-z])"
#: Ends of sentences.
SENTENCE_END = r"[.!?:;]+[ \t\n]+|\n+"
#: Signs that a normalised sentence doesn't keep.
NOISE = r"[^a-z0-9]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Stands in a piece where a wrapped line was joined.
JOIN = "\x01"
#: A piece that only numbers the next one, which is a known sentence.
LIST_NUMBER = r"(?:[0-9]{1,3}[ |]+)??"


def pieces(text: Column) -> Column:
    """Normalised pieces of a text, empty ones among them."""
    lines = F.regexp_replace(text, COMMENT, "\n")
    joined = F.regexp_replace(lines, WRAPPED, f"$1{JOIN}$2")
    noise = NOISE.replace("0-9", f"0-9{JOIN}")
    return F.transform(
        F.split(joined, SENTENCE_END),
        lambda s: F.btrim(F.regexp_replace(F.translate(s, UPPER, LOWER), noise, " "), F.lit(f" {JOIN}")),
    )


def _runs(known) -> str:
    """A pattern for known sentences that fill pieces joined by ``|``, longest first. An SPDX tag ends with its line, as its standard says."""
    each = []
    for sentence in sorted({sentence for _, sentence in known}, key=lambda s: (-len(s), s)):
        line = f" ?{JOIN}|" if sentence.startswith("spdx ") else ""
        each.append(f"[ |{JOIN}]+".join(map(re.escape, sentence.split())) + rf"(?={line}\|)")
    return rf"\|{LIST_NUMBER}({'|'.join(each)})"


def scan(docs: DataFrame, known=SENTENCES, rules=RULES) -> DataFrame:
    """``doc_id, n_sentences, n_known, sentence_ids, licenses, unmatched`` of every row, without a shuffle.

    ``sentence_ids`` has the identifiers in the order of the text, ``licenses``
    the licences in the order of the rules that matched, each once;
    ``unmatched`` is true where known sentences are left that no rule used.
    Sentences that aren't known break a sequence.  The pieces of a known
    sentence count as one sentence with the number that it has in a list; every
    other piece counts as a sentence.  Null and empty texts have none.  Texts of
    any length are scanned whole; repeated rows come back each; an empty table
    gives an empty result.
    """
    ids = F.create_map(*[F.lit(x) for ident, sentence in known for x in (sentence, ident)])
    whole = F.concat(F.lit("|"), F.array_join(F.filter(pieces(F.col("text")), lambda s: s != ""), "|"), F.lit("|"))
    marked = F.regexp_replace(whole, _runs(known), "|<$1>")
    name = lambda s: F.trim(F.regexp_replace(s, NOISE, " "))
    found = F.transform(
        F.regexp_extract_all(marked, F.lit("<[^>]*>|[^|<>]+"), F.lit(0)),
        lambda s: F.when(s.startswith("<"), F.coalesce(F.element_at(ids, name(s)), F.lit("-"))).otherwise(F.lit("-")),
    )
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.when(F.col("text").isNotNull(), found).otherwise(F.array().cast("array<string>")).alias("_found"),
    )
    # ",A,,B,,-,": a sequence of rules' identifiers is a substring
    rest = F.concat(F.lit(","), F.array_join("_found", ",,"), F.lit(","))
    rows = rows.select(
        "doc_id",
        F.size("_found").cast("long").alias("n_sentences"),
        F.filter("_found", lambda s: s != "-").alias("_ids"),
        rest.alias("_rest"),
    )
    step, got = F.col("_rest"), []
    for licence, sequence in rules:
        wanted = "".join(f",{s}," for s in sequence)
        got.append(F.when(step.contains(wanted), F.lit(licence)))
        step = F.replace(step, F.lit(wanted), F.lit(",+,"))
    scanned = rows.withColumn("_hit", F.size("_ids") > 0)
    return scanned.select(
        "doc_id",
        "n_sentences",
        F.size("_ids").cast("long").alias("n_known"),
        F.array_join("_ids", ",").alias("sentence_ids"),
        F.when(F.col("_hit"), F.array_join(F.array_distinct(F.array_compact(F.array(*got))), ",")).otherwise(F.lit("")).alias("licenses"),
        F.when(F.col("_hit"), F.regexp_replace(step, "[-+,]", "") != "").otherwise(F.lit(False)).alias("unmatched"),
    )
