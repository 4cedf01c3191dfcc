"""Licence scans by sentence rules.

A text is cut into sentences. A sentence, normalised to lower-case words, may be a known licence
sentence with an identifier; the identifiers found make up a sequence, and ordered rules, each a
sequence of identifiers that stands for a licence, are matched against it. A match is taken out of
the sequence, so a rule for a whole notice comes before rules for its single sentences. Sentences
without an identifier between two known ones don't separate them.

A sentence ends at a mark followed by white space. If it is unknown, runs of its neighbouring lines
without an empty one between are tried as sentences, the longest known one at each line, so a
hard-wrapped notice below a line without a final mark is still seen.

Null and empty texts have no sentences. Every row is judged by itself with column expressions;
repeated rows are alike, and other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence sentences by identifier, normalised.
SENTENCES = {
    "apache2-short": "licensed under the apache license version 2.0",
    "apache2-the": "licensed under the apache license version 2.0 the license",
    "apache2-comply": "you may not use this file except in compliance with the license",
    "apache2-copy": "you may obtain a copy of the license at",
    "apache2-url": "http www.apache.org licenses license 2.0",
    "apache2-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache2-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit-short": "released under the mit license",
    "mit-this": "this project is licensed under the mit license",
    "mit-title": "the mit license",
    "mit-title-short": "mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-short": "released under the bsd license",
    "gpl-free": "this program is free software",
    "gpl-redistribute-2": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl-either-2": "either version 2 of the license or at your option any later version",
    "gpl-either-3": "either version 3 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl-implied": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-see": "see the gnu general public license for more details",
    "gpl2-short": "this work is licensed under the gnu general public license version 2",
    "gpl3-short": "this work is licensed under the gnu general public license version 3",
    "lgpl-short": "this work is licensed under the gnu lesser general public license version 3",
    "agpl-short": "this work is licensed under the gnu affero general public license version 3",
    "mpl-subject": "this source code form is subject to the terms of the mozilla public license v 2.0",
    "mpl-copy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0",
    "cc-by-short": "licensed under cc by 4.0",
    "cc-by-sa-short": "licensed under cc by sa 4.0",
    "cc-by-nc-short": "licensed under cc by nc 4.0",
    "cc-by-nc-sa-short": "licensed under cc by nc sa 4.0",
    "cc-by-long": "this work is licensed under a creative commons attribution 4.0 international license",
    "cc0-short": "to the extent possible under law the author has waived all copyright and related rights to this work",
    "unlicense-domain": "this is free and unencumbered software released into the public domain",
    "reserved": "all rights reserved",
}

# Licences and the identifier sequences that stand for them, in order of matching.
RULES = (
    ("Apache-2.0", ("apache2-the", "apache2-comply", "apache2-copy", "apache2-url", "apache2-as-is", "apache2-see")),
    ("Apache-2.0", ("apache2-the", "apache2-comply", "apache2-copy", "apache2-as-is", "apache2-see")),
    ("Apache-2.0", ("apache2-short", "apache2-comply", "apache2-copy", "apache2-as-is", "apache2-see")),
    ("MIT", ("mit-title", "mit-grant", "mit-notice", "mit-as-is", "mit-liability")),
    ("MIT", ("mit-title-short", "mit-grant", "mit-notice", "mit-as-is", "mit-liability")),
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is", "mit-liability")),
    ("MIT-modified", ("mit-grant", "mit-as-is")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-redistribute-2", "gpl-either-3", "gpl-hope", "gpl-implied", "gpl-see")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl-redistribute-2", "gpl-either-2", "gpl-hope", "gpl-implied", "gpl-see")),
    ("GPL-3.0-or-later", ("gpl-redistribute-2", "gpl-either-3")),
    ("GPL-2.0-or-later", ("gpl-redistribute-2", "gpl-either-2")),
    ("MPL-2.0", ("mpl-subject", "mpl-copy")),
    ("MPL-2.0", ("mpl-subject",)),
    ("ISC", ("isc-grant",)),
    ("Apache-2.0", ("apache2-short",)),
    ("Apache-2.0", ("apache2-the",)),
    ("MIT", ("mit-short",)),
    ("MIT", ("mit-this",)),
    ("MIT", ("mit-title",)),
    ("BSD", ("bsd-short",)),
    ("GPL-2.0", ("gpl2-short",)),
    ("GPL-3.0", ("gpl3-short",)),
    ("LGPL-3.0", ("lgpl-short",)),
    ("AGPL-3.0", ("agpl-short",)),
    ("CC-BY-4.0", ("cc-by-short",)),
    ("CC-BY-4.0", ("cc-by-long",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-short",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-short",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-short",)),
    ("CC0-1.0", ("cc0-short",)),
    ("Unlicense", ("unlicense-domain",)),
    ("All-rights-reserved", ("reserved",)),
)

# Fixed values beyond the SQL twin's: usual texts of which sf0.1 holds none.
FURTHER_SENTENCES = {
    "mit-title-twice": "the mit license mit",
    "gpl-redistribute-or-2": f"{SENTENCES['gpl-redistribute-2']} {SENTENCES['gpl-either-2']}",
    "gpl-redistribute-or-3": f"{SENTENCES['gpl-redistribute-2']} {SENTENCES['gpl-either-3']}",
}
WHOLE_RULES = (
    ("MIT", ("mit-title-twice", "mit-grant", "mit-notice", "mit-as-is", "mit-liability")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-redistribute-or-3", "gpl-hope", "gpl-implied", "gpl-see")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl-redistribute-or-2", "gpl-hope", "gpl-implied", "gpl-see")),
)
SINGLE_RULES = (
    ("GPL-3.0-or-later", ("gpl-redistribute-or-3",)),
    ("GPL-2.0-or-later", ("gpl-redistribute-or-2",)),
    ("MIT", ("mit-title-twice",)),
    ("MIT", ("mit-title-short",)),
)

END_OF_SENTENCE = r"([.!?:;])[ \t\n\f\r]+"
CUT = "\x01"
NOT_IN_WORDS = r"[^\p{L}\p{N}.]+"
EDGES = r"^[ .]+|[ .]+$"


def normalised(sentence: Column) -> Column:
    """Lower-case words with one space between; marks go, but for points inside, as in ``2.0``."""
    return F.regexp_replace(F.regexp_replace(F.lower(sentence), NOT_IN_WORDS, " "), EDGES, "")


def _lines_pattern() -> str:
    """Matches a known sentence in normalised lines, wrapped anywhere between two words."""
    known = sorted([*SENTENCES.values(), *FURTHER_SENTENCES.values()], key=len, reverse=True)
    wrapped = "|".join(words.replace(".", r"\.").replace(" ", "[ \n]") for words in known)
    return rf"(?m)^(?:{wrapped})$"


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text in order."""
    names = {**SENTENCES, **FURTHER_SENTENCES}
    known = F.create_map(*[F.lit(x) for name, words in names.items() for x in (words, name)])
    pattern = _lines_pattern()

    def of(sentence: Column) -> Column:
        return F.try_element_at(known, normalised(sentence))

    def found(sentence: Column) -> Column:
        whole = F.array(of(sentence))
        lines = F.array_join(F.transform(F.split(sentence, "\n"), normalised), "\n")
        runs = F.regexp_extract_all(lines, F.lit(pattern), F.lit(0))
        wrapped = F.transform(runs, lambda run: F.try_element_at(known, F.translate(run, "\n", " ")))
        return F.when(whole[0].isNotNull() | ~sentence.contains("\n"), whole).otherwise(wrapped)

    marked = F.regexp_replace(F.coalesce(text, F.lit("")), END_OF_SENTENCE, "$1" + CUT)
    return F.array_compact(F.flatten(F.transform(F.split(marked, CUT), found)))


def matched(ids: Column) -> Column:
    """The sequence as text, each rule's match replaced by ``[licence]``."""
    sequence = F.concat_ws("", F.transform(ids, lambda name: F.concat(F.lit("<"), name, F.lit(">"))))
    for licence, rule in WHOLE_RULES + RULES + SINGLE_RULES:
        pattern = "".join(f"<{name}>" for name in rule)
        sequence = F.replace(sequence, F.lit(pattern), F.lit(f"[{licence}]"))
    return sequence


def scan(docs: DataFrame) -> DataFrame:
    """Per row ``doc_id``, the identifiers, the licences in order and how many sentences no rule used."""
    found = docs.select("doc_id", sentence_ids(F.col("text")).alias("ids"))
    ruled = found.withColumn(
        "sequence", F.when(F.size("ids") > 0, matched(F.col("ids"))).otherwise(F.lit(""))
    )
    return ruled.select(
        "doc_id",
        F.concat_ws(",", "ids").alias("sentence_ids"),
        F.concat_ws(",", F.regexp_extract_all("sequence", F.lit(r"\[([^\]]*)\]"), F.lit(1))).alias("licenses"),
        F.regexp_count("sequence", F.lit("<")).cast("long").alias("n_unmatched"),
    )
