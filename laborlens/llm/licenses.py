"""License scan by sentence-rule recognition.

Sentences are normalised and mapped to identifiers of known licence sentences, also where they are
wrapped over lines; the sequence of identifiers of a text is matched against ordered rules, each a licence with the identifiers it needs
in this order.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, functions as F

#: Known licence sentences, normalised: lower case, words of letters, digits and dots between digits.
SENTENCES: dict[str, str] = {
    # names of a licence
    "licensed under the apache license version 2.0": "apache2",
    "licensed under the apache license version 2.0 the license": "apache2",
    "this work is licensed under the gnu general public license version 3": "gpl3",
    "licensed under the gnu general public license version 3": "gpl3",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3plus",
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "the mit license": "mit",
    "mit license": "mit",
    "the mit license mit": "mit",
    "licensed under cc by nc 4.0": "ccbync4",
    "licensed under cc by 4.0": "ccby4",
    "licensed under cc by sa 4.0": "ccbysa4",
    "all rights reserved": "reserved",
    # headings and lead-ins of one licence
    "apache license version 2.0 january 2004": "apache2",
    "the asf licenses this file to you under the apache license version 2.0 the license": "apache2",
    "gnu general public license version 3 29 june 2007": "gpl3",
    # sentences of licence texts
    "you may not use this file except in compliance with the license": "apache_use",
    "you may obtain a copy of the license at": "apache_copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache_asis",
    "you may obtain a copy of the license at http www.apache.org licenses license 2.0": "apache_copy",
    "you may obtain a copy of the license at https www.apache.org licenses license 2.0": "apache_copy",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit_grant",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit_grant",
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software": "mit_notice",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit_notice",
    "the software is provided as is without warranty of any kind express or implied": "mit_asis",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit_asis",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3plus",
    "this program is distributed in the hope that it will be useful but without any warranty": "gpl_hope",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd_grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd_source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd_binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd_endorse",
    "neither the name of the copyright holders nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd_endorse",
}

#: A licence is named after "licensed under", with or without a subject before it.
NAMES: dict[str, str] = {
    "the apache license version 2.0": "apache2",
    "the apache license version 2.0 the license": "apache2",
    "the apache license 2.0": "apache2",
    "the apache 2.0 license": "apache2",
    "apache 2.0": "apache2",
    "the gnu general public license version 3": "gpl3",
    "the gnu general public license v3.0": "gpl3",
    "the gnu gpl v3": "gpl3",
    "the mit license": "mit",
    "an mit license": "mit",
    "mit": "mit",
    "cc by nc 4.0": "ccbync4",
    "cc by 4.0": "ccby4",
    "cc by sa 4.0": "ccbysa4",
}
SUBJECTS = (
    "", "it is ", *(f"{a} {b} is " for a in ("this", "the") for b in (
        "file", "project", "software", "work", "code", "source code", "program", "package", "library", "module", "repository",
    )),
)
VERBS = ("licensed", "released", "distributed", "available", "made available", "provided")
for _name, _id in NAMES.items():
    for _lead in (f"{s}{v} under {t}" for s in SUBJECTS for v in VERBS for t in ("", "the terms of ")):
        SENTENCES.setdefault(_lead + _name, _id)

#: Ordered rules: (licence, identifiers in order). More specific ones stand first.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Apache-2.0-notice", ("apache2", "apache_use", "apache_copy", "apache_asis")),
    ("Apache-2.0", ("apache2",)),
    ("GPL-3.0-or-later", ("gpl3plus",)),
    ("GPL-3.0-or-later-notice", ("gpl3plus", "gpl_hope")),
    ("GPL-3.0", ("gpl3",)),
    ("MIT-text", ("mit_grant", "mit_notice", "mit_asis")),
    ("MIT", ("mit",)),
    ("CC-BY-NC-4.0", ("ccbync4",)),
    ("CC-BY-SA-4.0", ("ccbysa4",)),
    ("CC-BY-4.0", ("ccby4",)),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("proprietary", ("reserved",)),
)


def marked(text: Column) -> Column:
    """Normalised text, with S where a sentence ends for certain and L at line ends that may wrap one.

    A sentence ends after . ! ? ; : before white space and at blank lines; a line is blank if it has
    no letter or digit, as the ``*`` or ``#`` of a comment.
    """
    t = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    t = F.regexp_replace(t, r"[.!?;:]+(?:[ \t]+|\r?\n)", "S\n")
    t = F.regexp_replace(t, r"[^a-z0-9.S\n]+", " ")
    t = F.regexp_replace(t, r"(?<![a-z0-9.])\.+|\.+(?![a-z0-9.])", " ")
    t = F.regexp_replace(t, r" *\n *", "\n")
    t = F.translate(F.regexp_replace(t, r"\n\n+", "S"), "\n", "L")
    return F.btrim(F.regexp_replace(F.regexp_replace(t, r" +", " "), r" ?S[SL ]*", "S"))


def known_pattern(known) -> str:
    """Pattern of the known sentences over ``marked`` text, words parted by blanks or wrapped lines.

    A sentence begins and ends at line or sentence ends, after a list number or not; the longest is
    taken. Shared beginnings are written once.
    """
    tree: dict = {}
    for sentence in known:
        node = tree
        for word in sentence.split(" "):
            node = node.setdefault(word, {})
        node[""] = {}

    def alternatives(node: dict) -> str:
        out = []
        for word, after in sorted((w, n) for w, n in node.items() if w):
            part = re.escape(word)
            if set(after) - {""}:
                rest = f"[ L](?:{alternatives(after)})"
                part += f"(?:{rest}|(?![^SL]))" if "" in after else rest
            else:
                part += "(?![^SL])"
            out.append(part)
        return "|".join(out)

    return f"(?<![^SL])(?:(?:[0-9]{{1,2}}|[a-z]) )?({alternatives(tree)})"


def normal_sentence(sentence: Column) -> Column:
    """Letters, digits and dots inside numbers; everything else is one space."""
    s = F.regexp_replace(sentence, r"[^a-z0-9.]+", " ")
    s = F.regexp_replace(s, r"\.+( |$)|(^| )\.+", " ")
    return F.btrim(F.regexp_replace(s, r" +", " "))


def rule_pattern(ids: tuple[str, ...]) -> str:
    """Pattern over ``;id;;id;`` for the identifiers in order, others between them allowed."""
    return "(;[a-z0-9_]+;)*".join(f";{i};" for i in ids)


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    known: dict[str, str] | None = None,
    rules=RULES,
) -> DataFrame:
    """(id, sentence_ids, licenses, license) of every document.

    ``sentence_ids`` are the identifiers of its known sentences in text order; a known sentence may be
    a whole line, a part of one between full stops, or run over several lines. ``licenses`` are all rules
    whose identifiers occur in their order (in rule order), ``license`` the first of them or null.
    Null and empty texts have none; repeated rows stay as many; texts are read whole; an empty table
    gives an empty result; other columns are not read. Rows are judged one by one, without a shuffle.
    """
    known = SENTENCES if known is None else known
    bad = [i for i in known.values() if not re.fullmatch(r"[a-z0-9_]+", i)]
    if bad:
        raise ValueError(f"identifiers need a-z, 0-9 and _: {bad}")
    table = F.from_json(F.lit(json.dumps(known)), "map<string,string>")  # one literal, folded once
    found = F.regexp_extract_all(marked(F.col(text_col)), F.lit(known_pattern(known)), F.lit(1))
    found = F.transform(found, lambda s: F.element_at(table, F.translate(s, "L", " ")))
    rows = docs.select(F.col(id_col).alias("id"), found.alias("sentence_ids"))
    line = F.concat_ws("", F.transform("sentence_ids", lambda i: F.concat(F.lit(";"), i, F.lit(";"))))
    hits = [F.when(line.rlike(rule_pattern(ids)), F.lit(name)) for name, ids in rules]
    rows = rows.withColumn("licenses", F.filter(F.array(*hits), lambda x: x.isNotNull()))
    return rows.select(
        F.col("id").alias(id_col), "sentence_ids", "licenses", F.get("licenses", F.lit(0)).alias("license")
    )
