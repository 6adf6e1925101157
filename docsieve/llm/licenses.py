"""Licence scan by sentence rules, in DataFrame operations only; every document is judged inside its own row.

A text is cut into sentences, each is normalised (lower case, everything but letters and digits is one blank, so comment
leaders and wrapping are gone) and mapped to a known licence sentence. A sentence goes on over line breaks up to an end
mark, a colon at the end of a line or a line without words; where such a sentence is not known, its lines are read one by
one, so notices without an end mark are found too. The sequence of known identifiers, unknown sentences between them left out, is matched
against ordered rules: the first rule found takes its identifiers away, so a licence of several sentences wins over the
notices that its parts would be on their own. Identifiers that no rule takes are reported as unmatched.

Null or empty text: no sentence, no licence. No shuffle and no broadcast: the tables are part of the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.llm.text import filled, packed

# Normalised sentences of public licences and notices, and the letter that stands for each in a sequence.
SENTENCES = {
    "licensed under the apache license version 2 0": "a",
    "you may not use this file except in compliance with the license": "b",
    "released under the mit license": "c",
    "licensed under the mit license": "c",
    "this work is licensed under the gnu general public license version 3": "d",
    "this program is free software": "e",
    "licensed under cc by nc 4 0": "f",
    "licensed under cc by 4 0": "g",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "h",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "i",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "j",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "k",
    "all rights reserved": "l",
    "this work is licensed under the gnu general public license version 2": "m",
    "licensed under cc by sa 4 0": "n",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "o",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "p",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "q",
    "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "k",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "r",
    "you may obtain a copy of the license at": "s",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "t",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "u",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "m",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "v",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "w",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "w",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "x",
    "this source code form is subject to the terms of the mozilla public license v": "y",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "z",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "z",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "A",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "A",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "B",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "C",
    "this software is provided as is without any express or implied warranty": "D",
    "this is free and unencumbered software released into the public domain": "E",
    "cc0 1 0 universal": "F",
    "licensed under cc0 1 0": "F",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "G",
    "licensed to psf under a contributor agreement": "H",
    "distributed under the boost software license version 1 0": "I",
    "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed": "J",
    "the contents of this file are subject to the terms of the common development and distribution license the license": "K",
    "licensed under the artistic license 2 0": "L",
    "spdx license identifier mit": "c",
    "spdx license identifier apache 2 0": "a",
    "spdx license identifier gpl 2 0 only": "m",
    "spdx license identifier gpl 2 0": "m",
    "spdx license identifier gpl 2 0 or later": "t",
    "spdx license identifier gpl 3 0 only": "d",
    "spdx license identifier gpl 3 0 or later": "u",
    "spdx license identifier bsd 2 clause": "M",
    "spdx license identifier bsd 3 clause": "N",
    "spdx license identifier mpl 2 0": "O",
    "spdx license identifier isc": "P",
}
# Rules in the order of their use; a licence, then the sequence of sentences that shows it.
RULES = (
    ("Apache-2.0", "rs"), ("Apache-2.0", "r"), ("Apache-2.0", "ab"), ("Apache-2.0", "a"), ("BSD-3-Clause", "qijk"), ("BSD-3-Clause", "ijk"),
    ("BSD-2-Clause", "qij"), ("BSD-2-Clause", "ij"), ("MIT", "ohp"), ("MIT", "oh"), ("MIT", "o"), ("MIT", "ch"), ("MIT", "c"), ("MIT", "h"),
    ("GPL-2.0-or-later", "t"), ("GPL-3.0-or-later", "u"), ("LGPL-2.1-or-later", "v"), ("LGPL-3.0-or-later", "w"), ("AGPL-3.0-or-later", "x"),
    ("GPL-3.0-only", "d"), ("GPL-2.0-only", "m"), ("GPL-unversioned", "e"), ("MPL-2.0", "yz"), ("MPL-2.0", "z"), ("ISC", "A"), ("0BSD", "B"),
    ("Zlib", "DC"), ("Zlib", "C"), ("Unlicense", "E"), ("CC0-1.0", "F"), ("EPL-2.0", "G"), ("PSF-2.0", "H"), ("BSL-1.0", "I"), ("WTFPL", "J"),
    ("CDDL-1.0", "K"), ("Artistic-2.0", "L"), ("BSD-2-Clause", "M"), ("BSD-3-Clause", "N"), ("MPL-2.0", "O"), ("ISC", "P"),
    ("CC-BY-NC-4.0", "f"), ("CC-BY-SA-4.0", "n"), ("CC-BY-4.0", "g"), ("all-rights-reserved", "l"),
)
# A sentence ends at an end mark before a blank or the end, at a colon that ends a line, or at a line without words.
SENTENCE_END = r"[.!?]+[\x20\x09-\x0D]+|[.!?]+$|:[\x20\x09]*[\n\r]+|[\n\r][^\n\ra-z0-9]*[\n\r]+"
LINE_END = r"[\n\r]+"


def normalised(sentence: Column) -> Column:
    return F.btrim(F.regexp_replace(sentence, "[^a-z0-9]+", " "))


def sentence_ids(text: Column) -> Column:
    """The identifiers of the known sentences of a text, one letter each, in order."""
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    lines = lambda s: F.transform(F.split(s, LINE_END), lambda line: known[normalised(line)])
    cut = F.split(F.replace(F.lower(filled(text)), F.lit("\r\n"), F.lit("\n")), SENTENCE_END)
    # Array joins leave nulls out.
    return F.array_join(F.transform(cut, lambda s: F.coalesce(known[normalised(s)], F.array_join(lines(s), ""))), "")


def license_scan(docs: DataFrame) -> DataFrame:
    """``document``, ``doc_id``, ``sentence_ids``, ``licenses`` (joined by a comma, in rule order; empty if none), ``unmatched``."""
    scanned = packed(docs, "doc_id", "text").select("document", "doc_id", sentence_ids(F.col("text")).alias("sentence_ids"))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(sequence).alias("sequence")) for name, sequence in RULES])
    nothing = F.array().cast("array<string>")

    def apply(state: Column, rule: Column) -> Column:
        """A taken sequence leaves a gap, so its neighbours do not become adjacent."""
        hit = F.contains(state["rest"], rule["sequence"])
        return F.struct(
            F.replace(state["rest"], rule["sequence"], F.lit("-")).alias("rest"),
            F.when(hit, F.array_append(state["names"], rule["name"])).otherwise(state["names"]).alias("names"),
        )

    start = F.struct(F.col("sentence_ids").alias("rest"), nothing.alias("names"))
    scanned = scanned.withColumn("_end", F.when(F.col("sentence_ids") == "", start).otherwise(F.aggregate(rules, start, apply)))
    return scanned.select(
        "document", "doc_id", "sentence_ids", F.array_join(F.array_distinct("_end.names"), ",").alias("licenses"),
        F.replace(F.col("_end.rest"), F.lit("-"), F.lit("")).alias("unmatched"),
    )
