"""Licence scans by sentence rules, in DataFrame functions only.

Texts are cut into sentences: at blank lines (lines without a letter or digit, so also those of a comment block) and at ``. ! ? ;`` before white
space; single line ends inside a sentence are joined. Sentences are normalised (lower case, every run of other characters than a-z and
0-9 one space) and mapped to identifiers of known licence sentences; the lines of a sentence that is not known are tried one by
one. The identifiers of a text, in order, are matched against ordered licence rules: the first rule that fits takes its
identifiers out, then the next one is tried. What no rule takes is reported. Everything is an expression of one row: no
shuffle, no state.

Defined results: null or empty text, or none of the known sentences: no identifiers, no licence; repeated sentences and licences are
reported as often as they are found; null ids and repeated rows pass through; columns beside ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Identifier -> normalised sentences that state it.
SENTENCES: dict[str, tuple[str, ...]] = {
    "ApacheVer2": ("licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license"),
    "ApacheUse": ("you may not use this file except in compliance with the license",),
    "ApacheCopy": ("you may obtain a copy of the license at", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    "ApacheBasis": ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",),
    "MITName": ("released under the mit license", "licensed under the mit license", "this project is licensed under the mit license"),
    "ApacheSee": ("see the license for the specific language governing permissions and limitations under the license",),
    "MITGrant": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    ),
    "MITNotice": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "AsIs": (
        "the software is provided as is without warranty of any kind express or implied",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    ),
    "MITLiable": ("in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",),
    "ISCGrant": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",),
    "GPLVer3": ("this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3"),
    "GPLVer2": ("this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2"),
    "OrLater": ("or at your option any later version", "either version 3 of the license or at your option any later version"),
    "GPLFree": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    ),
    "GPLNotice3": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",),
    "GPLEither2": ("either version 2 of the license or at your option any later version",),
    "LGPLFree": ("you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",),
    "LGPLEither21": ("either version 2 1 of the license or at your option any later version",),
    "LGPLNotice3": ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",),
    "AGPLNotice3": ("this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",),
    "MPLForm": ("this source code form is subject to the terms of the mozilla public license v",),
    "MPLCopy": ("if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    "CCByNc4": ("licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    "CCBy4": ("licensed under cc by 4 0", "this work is licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"),
    "CCBySa4": ("licensed under cc by sa 4 0", "this work is licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    "BSDRedist": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "BSDSource": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
    "BSDBinary": ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",),
    "BSDAsIs": ("this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",),
    "BSDLiable": (
        "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services",
        "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    ),
    "BSDEndorse": ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",),
    "PublicDomain": ("this work is in the public domain", "this is free and unencumbered software released into the public domain", "public domain"),
    "AllRights": ("all rights reserved",),
}
#: Ordered rules: licence and the identifiers it takes, as a pattern on identifiers that each end in a comma.
RULES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0-notice", "ApacheVer2,ApacheUse,ApacheCopy,(?:ApacheBasis,)?(?:ApacheSee,)?"),
    ("MIT-text", "(?:MITName,)?MITGrant,MITNotice,(?:AsIs,)?(?:MITLiable,)?"),
    ("ISC", "ISCGrant,(?:AsIs,)?"),
    ("GPL-3.0-or-later-notice", "GPLNotice3,"),
    ("GPL-2.0-or-later-notice", "GPLFree,GPLEither2,"),
    ("LGPL-2.1-or-later", "LGPLFree,LGPLEither21,"),
    ("LGPL-3.0-or-later", "LGPLNotice3,"),
    ("AGPL-3.0-or-later", "AGPLNotice3,"),
    ("MPL-2.0", "MPLForm,(?:MPLCopy,)?"),
    ("GPL-3.0-or-later", "(?:GPLFree,)?GPLVer3,OrLater,"),
    ("GPL-2.0-or-later", "(?:GPLFree,)?GPLVer2,OrLater,"),
    ("BSD-3-Clause", "BSDRedist,(?:BSDSource,)?(?:BSDBinary,)?BSDEndorse,(?:BSDAsIs,)?(?:BSDLiable,)?"),
    ("BSD-2-Clause", "BSDRedist,(?:BSDSource,)?(?:BSDBinary,)?(?:BSDAsIs,)?(?:BSDLiable,)?"),
    ("Apache-2.0", "ApacheVer2,"),
    ("MIT", "MITName,"),
    ("GPL-3.0-only", "(?:GPLFree,)?GPLVer3,"),
    ("GPL-2.0-only", "(?:GPLFree,)?GPLVer2,"),
    ("CC-BY-NC-4.0", "CCByNc4,"),
    ("CC-BY-SA-4.0", "CCBySa4,"),
    ("CC-BY-4.0", "CCBy4,"),
    ("public-domain", "PublicDomain,"),
)
#: Every known sentence holds one of these words or runs of words; a text with none needs no cutting.
HINTS = ("licen", "permission", "copyright", "warrant", "redistrib", "later version", "public domain", "all rights", "liable", "a copy of the mpl")


def sentence_ids(text: Column, sentences: dict[str, tuple[str, ...]] = SENTENCES) -> Column:
    """The identifiers of the known sentences of a text, in order."""
    known = F.create_map(*[F.lit(x) for name, forms in sentences.items() for form in forms for x in (form, name)])

    def known_as(piece: Column) -> Column:
        return F.try_element_at(known, F.trim(F.regexp_replace(piece, "[^a-z0-9]+", " ")))

    low = F.lower(text)
    pieces = F.split(F.regexp_replace(low, SENTENCE_END, "$1\n\n"), BLANK_LINE)
    lines = F.flatten(F.transform(pieces, lambda p: F.when(known_as(p).isNotNull(), F.array(p)).otherwise(F.split(p, "\n"))))
    ids = F.filter(F.transform(lines, known_as), lambda i: i.isNotNull())
    if not all(any(h in form for h in HINTS) for forms in sentences.values() for form in forms):
        return ids
    return F.when(low.rlike("|".join(h.replace(" ", "[^a-z0-9]+") for h in HINTS)), ids).otherwise(F.array().cast("array<string>"))


SENTENCE_END, BLANK_LINE = r"([.!?;])[ \t\r\n\x0b\f]+", r"\n[^a-z0-9\n]*\n"


def licence_scan(docs: DataFrame, sentences: dict[str, tuple[str, ...]] = SENTENCES, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """``doc_id, n_known, sentence_ids, licences, unmatched`` of every row (identifiers and licences joined by commas)."""
    ids = docs.select(F.col("doc_id"), F.coalesce(sentence_ids(F.coalesce(F.col("text").cast("string"), F.lit("")), sentences), F.array().cast("array<string>")).alias("_ids"))
    rows = ids.select("doc_id", F.size("_ids").cast("long").alias("n_known"), F.array_join("_ids", ",").alias("sentence_ids")).withColumn("_left", F.when(F.col("n_known") > 0, F.concat("sentence_ids", F.lit(","))).otherwise(F.lit("")))
    # identifiers taken by a rule become one mark, so that what stood around them does not close up
    found = []
    for no, (name, pattern) in enumerate(rules):
        bounded = f"(?<![^,])(?:{pattern})"
        rows = rows.withColumn(f"_n{no}", F.when(F.col("_left") == "", F.lit(0)).otherwise(F.regexp_count("_left", F.lit(bounded)))).withColumn("_left", F.when(F.col(f"_n{no}") > 0, F.regexp_replace("_left", bounded, "|,")).otherwise(F.col("_left")))
        found.append(F.array_repeat(F.lit(name), F.col(f"_n{no}")))
    licences = F.when(F.col("n_known") > 0, F.array_join(F.concat(*found), ",")).otherwise(F.lit(""))
    rest = F.array_join(F.filter(F.split("_left", ","), lambda x: (x != "") & (x != "|")), ",")
    return rows.select("doc_id", "n_known", "sentence_ids", licences.alias("licences"), F.when(F.col("n_known") > 0, rest).otherwise(F.lit("")).alias("unmatched"))


def op1_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence sentences and licences of the whole ``documents`` table."""
    return licence_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    known = ", ".join(f"('{form}', '{name}')" for name, forms in SENTENCES.items() for form in forms)
    steps, cols = [], []
    for no, (name, pattern) in enumerate(RULES):  # DuckDB's patterns have no lookbehind: every identifier gets a sign before it
        p = pattern.replace("(?:", "(?:~")
        p = "~" + p if not p.startswith("(") else p
        signed = ""
        for k, ch in enumerate(p):
            signed += ch
            if ch == "," and k + 1 < len(p) and p[k + 1].isalpha():
                signed += "~"
            if ch == "?" and k + 1 < len(p) and p[k + 1].isalpha():
                signed += "~"
        steps.append(f"r{no + 1} AS (SELECT *, len(regexp_extract_all(s{no}, '{signed}')) AS n{no}, regexp_replace(s{no}, '{signed}', '|,', 'g') AS s{no + 1} FROM r{no})")
        cols.append(f"repeat('{name},', n{no})")
    return f"""
WITH k(form, name) AS (VALUES {known}),
m AS (SELECT map(list(form), list(name)) AS m FROM k),
i AS (SELECT doc_id, list_filter(flatten(list_transform(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '{SENTENCE_END}', '\\1' || chr(10) || chr(10), 'g'), '{BLANK_LINE}'),
        lambda p: CASE WHEN m[trim(regexp_replace(p, '[^a-z0-9]+', ' ', 'g'))] IS NOT NULL THEN [m[trim(regexp_replace(p, '[^a-z0-9]+', ' ', 'g'))]]
          ELSE list_transform(string_split(p, chr(10)), lambda s: m[trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g'))]) END)), lambda x: x IS NOT NULL) AS ids FROM documents, m),
r0 AS (SELECT doc_id, ids, CASE WHEN len(ids) = 0 THEN '' ELSE '~' || array_to_string(ids, ',~') || ',' END AS s0 FROM i),
{", ".join(steps)}
SELECT doc_id, len(ids)::BIGINT AS n_known, coalesce(array_to_string(ids, ','), '') AS sentence_ids, rtrim({" || ".join(cols)}, ',') AS licences,
  CASE WHEN len(ids) = 0 THEN '' ELSE replace(array_to_string(list_filter(string_split(s{len(RULES)}, ','), lambda x: x <> '' AND x <> '|'), ','), '~', '') END AS unmatched FROM r{len(RULES)}
"""


ORACLE = _oracle()
