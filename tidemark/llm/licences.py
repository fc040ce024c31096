"""License scans: sentences to identifiers, identifier sequences to ordered licence rules; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

# Normalised sentences (lower case, runs of other characters than a-z and 0-9 are one space) and their identifiers.
SENTENCES = {
    "licensed under the apache license version 2 0": "APACHE2_NOTICE",
    "licensed under the apache license version 2 0 the license": "APACHE2_NOTICE",
    "this project is licensed under the apache license 2 0": "APACHE2_NOTICE",
    "you may not use this file except in compliance with the license": "APACHE2_COMPLIANCE",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "APACHE2_BASIS",
    "released under the mit license": "MIT_NOTICE",
    "licensed under the mit license": "MIT_NOTICE",
    "this project is licensed under the mit license": "MIT_NOTICE",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MIT_GRANT",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MIT_CONDITION",
    "this work is licensed under the gnu general public license version 3": "GPL3_NOTICE",
    "licensed under the gnu general public license version 3": "GPL3_NOTICE",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "GPL3_LATER",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "GPL2_LATER",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GPL_WARRANTY",
    "licensed under cc by nc 4 0": "CC_BY_NC_4",
    "this work is licensed under cc by nc 4 0": "CC_BY_NC_4",
    "licensed under cc by 4 0": "CC_BY_4",
    "this work is licensed under a creative commons attribution 4 0 international license": "CC_BY_4",
    "licensed under cc by sa 4 0": "CC_BY_SA_4",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "CC_BY_SA_4",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSD_GRANT",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSD_SOURCE",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSD_BINARY",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSD_NAMES",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISC_GRANT",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "MPL2_NOTICE",
    "this is free and unencumbered software released into the public domain": "UNLICENSE",
    "all rights reserved": "ALL_RIGHTS",
}
# Licence rules in order; identifiers that a rule has matched are not matched again.
RULES = (
    ("BSD-3-Clause", ("BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_NAMES")),
    ("BSD-2-Clause", ("BSD_GRANT", "BSD_SOURCE", "BSD_BINARY")),
    ("MIT", ("MIT_NOTICE", "MIT_GRANT", "MIT_CONDITION")),
    ("MIT", ("MIT_GRANT", "MIT_CONDITION")),
    ("Apache-2.0", ("APACHE2_NOTICE", "APACHE2_COMPLIANCE", "APACHE2_BASIS")),
    ("GPL-3.0-or-later", ("GPL3_LATER", "GPL_WARRANTY")),
    ("GPL-2.0-or-later", ("GPL2_LATER", "GPL_WARRANTY")),
    ("MIT", ("MIT_NOTICE",)),
    ("Apache-2.0", ("APACHE2_NOTICE",)),
    ("GPL-3.0-or-later", ("GPL3_LATER",)),
    ("GPL-2.0-or-later", ("GPL2_LATER",)),
    ("GPL-3.0-only", ("GPL3_NOTICE",)),
    ("CC-BY-NC-4.0", ("CC_BY_NC_4",)),
    ("CC-BY-SA-4.0", ("CC_BY_SA_4",)),
    ("CC-BY-4.0", ("CC_BY_4",)),
    ("ISC", ("ISC_GRANT",)),
    ("MPL-2.0", ("MPL2_NOTICE",)),
    ("Unlicense", ("UNLICENSE",)),
    ("LicenseRef-all-rights-reserved", ("ALL_RIGHTS",)),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Blank lines, which no sentence crosses (lines without letters and digits are blank), and places where one may end or go on.
BLANK, MAYBE = r"\n[^a-z0-9\n]*+\n[^a-z0-9]*+", r"[.!?:;]+(?=[ \t\rH]|$)|\n"
#: A known sentence between two such places or ends, any number of them inside; H and S stand for both kinds, as no other capitals are left.
WHOLE = "(?:^|[HS]) *+(" + "|".join(s.replace(" ", "[ S]++") for s in sorted(SENTENCES, key=len, reverse=True)) + ")(?= *+(?:[HS]|$))"


def identifiers(text: Column) -> Column:
    """The identifiers of the known sentences of a text, in order, wrapped or not."""
    lowered = F.translate(text, _UPPER, _LOWER)
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(lowered, BLANK, "H"), MAYBE, "S"), "[^a-z0-9HS]+", " ")
    return F.transform(F.regexp_extract_all(marked, F.lit(WHOLE), 1), lambda s: F.element_at(known, F.regexp_replace(s, "[ S]+", " ")))


def scan(docs: DataFrame) -> DataFrame:
    """Add to doc_id the recognised sentence ids, the licences that rules match and their number.

    One row for each row of ``docs``: n_sentences, sentence_ids and licenses (comma
    separated, the first in order of place, the others of rule), n_matches. A null
    or empty text has none. All is computed within the row, so that nothing is
    shuffled, however long the text or often the row. An empty table gives an empty
    result; other columns are ignored.
    """
    out = docs.select("doc_id", identifiers(F.coalesce("text", F.lit(""))).alias("_ids"))
    out = out.withColumn("_left", F.concat_ws("", F.transform("_ids", lambda i: F.concat(F.lit("<"), i, F.lit(">")))))
    counts = []
    for k, (_, sequence) in enumerate(RULES):
        pattern = "".join(f"<{i}>" for i in sequence)
        rest = F.replace(F.col("_left"), F.lit(pattern), F.lit("|"))
        counts.append(f"_n{k}")
        shorter = (F.length("_left") - F.length(rest)) / F.lit(len(pattern) - 1)
        out = out.withColumns({f"_n{k}": shorter.cast("long"), "_left": rest})
    names = F.array_distinct(F.array_compact(F.array(*[F.when(F.col(c) > 0, F.lit(name)) for c, (name, _) in zip(counts, RULES, strict=True)])))
    total = sum((F.col(c) for c in counts[1:]), F.col(counts[0]))
    return out.select("doc_id", F.size("_ids").cast("long").alias("n_sentences"), F.array_join("_ids", ",").alias("sentence_ids"), F.array_join(names, ",").alias("licenses"), total.alias("n_matches"))


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence sentences and licences of every document."""
    return scan(documents(spark, sf_dir))


def _oracle() -> str:
    """The same by other means, as the SQL has no look-ahead and no possessive repeats.

    Marked places become tabs (H) and line feeds (S) in a text of letters, digits and
    spaces, places that meet become one, and known sentences, in which a place may stand
    for a space, are taken out between two places, the longest first where several start.
    """
    known = " ".join(f"WHEN '{s}' THEN '{i}'" for s, i in SENTENCES.items())
    steps, columns = [], []
    blank, maybe = r"\n[^a-z0-9\n]*\n[^a-z0-9]*", r"[.!?:;]+([ \t\rH]|$)|\n"
    lowered = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
    steps.append(f"t0 AS (SELECT doc_id, regexp_replace(regexp_replace({lowered}, '{blank}', 'H', 'g'), '{maybe}', 'S\\1', 'g') AS marked FROM documents)")
    # each place is written twice, so that the end of one sentence can be the start of the next
    steps.append("t1 AS (SELECT doc_id, regexp_replace(regexp_replace(marked, '[^a-z0-9HS]+', ' ', 'g'), '([HS])', '\\1\\1', 'g') AS marked FROM t0)")
    whole = "(?:^|[HS]) *(" + "|".join(s.replace(" ", "[ S]+") for s in sorted(SENTENCES, key=len, reverse=True)) + ") *(?:[HS]|$)"
    steps.append(f"t2 AS (SELECT doc_id, list_transform(regexp_extract_all(marked, '{whole}', 1), lambda s: CASE regexp_replace(s, '[ S]+', ' ', 'g') {known} END) AS ids FROM t1)")
    steps.append("r0 AS (SELECT doc_id, ids, coalesce(array_to_string(list_transform(ids, lambda i: '<' || i || '>'), ''), '') AS rest FROM t2)")
    for k, (name, sequence) in enumerate(RULES):
        pattern = "".join(f"<{i}>" for i in sequence)
        kept = "".join(f", n{j}" for j in range(k))
        steps.append(f"r{k + 1} AS (SELECT doc_id, ids{kept}, (length(rest) - length(replace(rest, '{pattern}', '|'))) // {len(pattern) - 1} AS n{k}, replace(rest, '{pattern}', '|') AS rest FROM r{k})")
        columns.append((f"n{k}", name))
    names = {}
    for n, name in columns:
        names.setdefault(name, []).append(n)
    # a licence stands where its first matching rule does
    order = ", ".join(f"CASE WHEN {n} > 0{''.join(f' AND {m} = 0' for m in names[name][: names[name].index(n)])} THEN '{name}' END" for n, name in columns)
    total = " + ".join(n for n, _ in columns)
    text = lambda x: f"coalesce(array_to_string({x}, ','), '')"
    found = text(f"list_filter([{order}], lambda x: x IS NOT NULL)")
    return f"WITH {', '.join(steps)} SELECT doc_id, len(ids)::BIGINT AS n_sentences, {text('ids')} AS sentence_ids, {found} AS licenses, ({total})::BIGINT AS n_matches FROM r{len(RULES)}"


ORACLE_SQL = _oracle()
