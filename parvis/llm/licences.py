"""Licence scan by sentences: each normalised sentence becomes the identifier of a known licence sentence,
and the sequence of identifiers of a document is matched against ordered rules.

Only DataFrame functions are used, and no row leaves its place: both tables are
constants of the plan. They can be replaced by callers; ``MAX_SENTENCES`` checks
that they stay small enough for that.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_SENTENCES = 5_000
#: identifiers of licence sentences; the sentence is lower case, words by one space, no punctuation but . - / within words
SENTENCES = {
    "cc-by-nc-4.0": ["licensed under cc by-nc 4.0", "this work is licensed under a creative commons attribution-noncommercial 4.0 international license"],
    "cc-by-4.0": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "cc0-1.0": ["released under cc0 1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"],
    "gpl-3.0": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3"],
    "gpl-later": ["either version 3 of the license or at your option any later version"],
    "gpl-share": ["this program is free software you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "gpl-share-3-later": [
        "this program is free software you can redistribute it and/or modify it under the terms of the gnu general public license"
        " as published by the free software foundation either version 3 of the license or at your option any later version",
    ],
    "apache-2.0": ["licensed under the apache license version 2.0", "licensed under the apache license version 2.0 the license"],
    "apache-comply": ["you may not use this file except in compliance with the license"],
    "mit": ["released under the mit license", "licensed under the mit license"],
    "mit-grant": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software"
        " to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"
        " and/or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    ],
    "mit-notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "bsd-redistribute": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-no-endorse": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "gpl-2.0": [
        "this work is licensed under the gnu general public license version 2",
        "licensed under the gnu general public license version 2",
        "this program is free software you can redistribute it and/or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    ],
    "gpl-later-2": [
        "either version 2 of the license or at your option any later version",
    ],
    "gpl-share-2-later": [
        "this program is free software you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    ],
    "lgpl-2.1-later": [
        "this library is free software you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version",
        "this program is free software you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version",
    ],
    "lgpl-3.0-later": [
        "this library is free software you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "this program is free software you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ],
    "lgpl-2.1": [
        "licensed under the gnu lesser general public license version 2.1",
    ],
    "lgpl-3.0": [
        "licensed under the gnu lesser general public license version 3",
    ],
    "agpl-3.0-later": [
        "this program is free software you can redistribute it and/or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ],
    "agpl-3.0": [
        "licensed under the gnu affero general public license version 3",
    ],
    "mpl-2.0": [
        "this source code form is subject to the terms of the mozilla public license v",
        "licensed under the mozilla public license version 2.0",
    ],
    "isc": [
        "permission to use copy modify and/or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "unlicense": [
        "this is free and unencumbered software released into the public domain",
    ],
    "cc-by-sa-4.0": [
        "licensed under cc by-sa 4.0",
        "this work is licensed under a creative commons attribution-sharealike 4.0 international license",
    ],
    "reserved": ["all rights reserved"],
}


@dataclass(frozen=True)
class Rule:
    """A licence and the identifiers that must follow each other, other text between them left aside."""

    licence: str
    sequence: tuple[str, ...]


#: in order: an occurrence that an earlier rule has used is not used again
RULES = (
    Rule("GPL-3.0-or-later", ("gpl-share-3-later",)),
    Rule("GPL-3.0-or-later", ("gpl-share", "gpl-later")),
    Rule("GPL-2.0-or-later", ("gpl-share-2-later",)),
    Rule("GPL-2.0-or-later", ("gpl-share", "gpl-later-2")),
    Rule("LGPL-2.1-or-later", ("lgpl-2.1-later",)),
    Rule("LGPL-3.0-or-later", ("lgpl-3.0-later",)),
    Rule("AGPL-3.0-or-later", ("agpl-3.0-later",)),
    Rule("MIT", ("mit-grant", "mit-notice")),
    Rule("BSD-3-Clause", ("bsd-redistribute", "bsd-no-endorse")),
    Rule("BSD-2-Clause", ("bsd-redistribute",)),
    Rule("Apache-2.0", ("apache-2.0", "apache-comply")),
    Rule("Apache-2.0", ("apache-2.0",)),
    Rule("GPL-3.0-only", ("gpl-3.0",)),
    Rule("GPL-2.0-only", ("gpl-2.0",)),
    Rule("LGPL-2.1-only", ("lgpl-2.1",)),
    Rule("LGPL-3.0-only", ("lgpl-3.0",)),
    Rule("AGPL-3.0-only", ("agpl-3.0",)),
    Rule("MPL-2.0", ("mpl-2.0",)),
    Rule("ISC", ("isc",)),
    Rule("Unlicense", ("unlicense",)),
    Rule("MIT", ("mit",)),
    Rule("CC-BY-NC-4.0", ("cc-by-nc-4.0",)),
    Rule("CC-BY-4.0", ("cc-by-4.0",)),
    Rule("CC-BY-SA-4.0", ("cc-by-sa-4.0",)),
    Rule("CC0-1.0", ("cc0-1.0",)),
    Rule("proprietary", ("reserved",)),
)


#: nearly all known sentences hold one of them
WORDS = ("licen", "rights", "permi", "copyright", "notice", "contributors", "cc0", "version", "public domain", "unencumbered")


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", sentences: dict[str, list[str]] | None = None, rules=RULES) -> DataFrame:
    """One row per document: ``key``, sentence_ids (in text order), licences (in order of the rules, each once).

    Sentences end at a blank line or at ``.``, ``!``, ``?`` or ``;`` before white space
    or the end. A line break may end one or be white space in it, so lines that follow
    each other are a known sentence wherever they add up to one. Case, quotes,
    brackets, commas, comment signs before a line and runs of white space do not count.
    A null or empty text has empty lists; the documents keep their number and order of
    repetition. Extra columns are not carried.
    """
    known = {s: i for i, group in (sentences or SENTENCES).items() for s in group}
    if len(known) > MAX_SENTENCES:
        raise ValueError(f"{len(known)} sentences; at most {MAX_SENTENCES} are plan constants")
    body = F.lower(F.coalesce(F.col(text), F.lit("")))
    # cheap test first: a known sentence holds one of these words, or its longest one is added
    words = "|".join([*WORDS, *sorted({re.escape(max(s.split(), key=len)) for s in known if not any(w in s for w in WORDS)})])
    body = F.when(body.rlike(words), body).otherwise(F.lit(""))
    bare = F.regexp_replace(body, r"(?m)^[^\S\n]*+(?:(?:#|//|/?\*|--|;|%|>|<!--)[#/*;%>!-]*+|(?:dnl|rem)(?=\s))", "")
    cut = F.split(bare, r"\n[^\S\n]*+\n\s*+|[.!?;]+(?=\s|\z)")
    likely = F.filter(cut, lambda s: s.rlike(words))
    plain = lambda s: F.regexp_replace(s, r"[^\p{L}\p{N}.\-/\s]+", " ")
    lines = lambda s: F.regexp_replace(F.regexp_replace(s, r"[^\S\n]*+\n\s*+", "\n"), r"[^\S\n]+", " ")
    clean = F.transform(likely, lambda s: F.regexp_replace(lines(plain(s)), r"\A\s+|\s+\z", ""))
    # longest first: whole lines, from the beginning of one to the end of the same or a later one
    every = "|".join("[ \\n]".join(map(re.escape, s.split(" "))) for s in sorted(known, key=lambda s: (-len(s), s)))
    runs = F.flatten(F.transform(clean, lambda s: F.regexp_extract_all(s, F.lit(rf"(?<![^\n])({every})(?![^\n])"), F.lit(1))))
    found = F.transform(runs, lambda s: F.replace(s, F.lit("\n"), F.lit(" ")))
    names = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    rows = docs.select(F.col(key).alias(key), F.transform(found, lambda s: F.element_at(names, s)).alias("sentence_ids"))
    # "|a|b|": each rule takes its occurrences out of what is left
    left = F.concat(F.lit("|"), F.array_join(F.col("sentence_ids"), "|"), F.lit("|"))
    rows = rows.withColumn("left", F.when(F.size("sentence_ids") > 0, left).otherwise(F.lit("")))
    hits = []
    for i, rule in enumerate(rules):
        run = "|" + "|".join(rule.sequence) + "|"
        rows = rows.withColumns({f"hit{i}": F.contains("left", F.lit(run)), "left": F.replace("left", F.lit(run), F.lit("|#|"))})
        hits.append(F.when(F.col(f"hit{i}"), F.lit(rule.licence)))
    licences = F.array_distinct(F.filter(F.array(*hits), lambda x: x.isNotNull()))
    return rows.select(key, "sentence_ids", licences.alias("licences"))


def oracle(rules=RULES) -> str:
    """The same scan as DuckDB SQL, with the lists joined to text."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(s)}, {quoted(i)})" for i, group in SENTENCES.items() for s in group)
    steps = ["s AS (SELECT doc_id, ids, CASE WHEN len(ids) > 0 THEN '|' || array_to_string(ids, '|') || '|' ELSE '' END AS l0 FROM found)"]
    before, columns = "s", []
    for i, rule in enumerate(rules):
        run = quoted("|" + "|".join(rule.sequence) + "|")
        steps.append(f"s{i} AS (SELECT *, contains(l{i}, {run}) AS h{i}, replace(l{i}, {run}, '|#|') AS l{i + 1} FROM {before})")
        earlier = "".join(f" AND NOT h{j}" for j in range(i) if rules[j].licence == rule.licence)
        columns.append(f"CASE WHEN h{i}{earlier} THEN {quoted(rule.licence)} END")
        before = f"s{i}"
    return f"""
WITH known(sentence, id) AS (VALUES {known}),
docs AS (SELECT doc_id, row_number() OVER () AS r, regexp_split_to_array(lower(coalesce(text, '')), '\\n|[.!?;]+(\\s|$)') AS cut FROM documents),
lines AS (SELECT r, unnest(cut) AS line, generate_subscripts(cut, 1) AS pos FROM docs),
clean AS (SELECT r, pos, trim(regexp_replace(regexp_replace(line, '[^\\pL\\pN.\\-/\\s]+', ' ', 'g'), '\\s+', ' ', 'g')) AS sentence FROM lines WHERE regexp_matches(line, '{"|".join(WORDS)}')),
hits AS (SELECT r, list(id ORDER BY pos) AS ids FROM clean JOIN known USING (sentence) GROUP BY r),
found AS (SELECT doc_id, CASE WHEN ids IS NULL THEN []::VARCHAR[] ELSE ids END AS ids FROM docs LEFT JOIN hits USING (r)),
{", ".join(steps)}
SELECT doc_id, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
  coalesce(array_to_string([{", ".join(columns)}], ','), '') AS licences, len(ids)::BIGINT AS n_sentences
FROM {before}
"""
