"""Operator 8: licences by sentence rules (built-in functions only).

Texts are cut into sentences, each sentence is normalised (lower case, letters and digits, single spaces) and looked up
among known licence sentences; one with an inner stop or colon is known by all its parts in sequence. Before that the forms that
vary are brought to known ones (:func:`rewritten`): holders' names in conditions, notices "under the terms of" a licence within a sentence, and expressions of
identifiers, each operand of which is a tag of its own (an exception after WITH is left as an unknown sentence). A sentence ends at a stop or a
line's end, and one that is known may run over the ends of lines, but not over blank ones. The sequence of the identifiers found, unknown sentences left out, is matched against
rules in order: a rule holds where its identifiers stand next to each other in the sequence. The first rule that holds
names the licence; ``licences`` lists those of all rules that hold.

Defined cases: a null or empty text has no sentences and no licence (null); repeated rows are reported as often as they
come; columns named like an added one are replaced; an empty table gives an empty result. There is no shuffle, and the time grows with the
length of a text only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import documents

#: Sentences of public licences and of notices that name them, by identifier.
SENTENCES = {
    "mit-named": ["Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT", "License: MIT"],
    "mit-grant": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "as-is": ["The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement."],
    "apache-named": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\");",
        "Released under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "apache-comply": ["you may not use this file except in compliance with the License."],
    "apache-basis": [
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ],
    "gpl3-named": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3."],
    "gpl3-grant": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ],
    "gpl2-grant": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ],
    "gpl-hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": [
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    ],
    "bsd-names": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "mpl-named": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "cc-by-named": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "reserved": ["All rights reserved."],
}

#: Further forms of the grants.
FURTHER = {
    # programs that are named: "NAME is free software: you can ..."
    "gpl3-grant": [
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ],
    "gpl2-grant": [
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ],
    "lgpl3-grant": [
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ],
    "lgpl21-grant": [
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ],
    "agpl3-grant": [
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ],
    "isc-grant": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "zlib-as-is": ["This software is provided 'as-is', without any express or implied warranty."],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "boost-grant": [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"
    ],
    "unlicense-grant": ["This is free and unencumbered software released into the public domain."],
    "apache-comply": ["you may not use this file except in compliance with the License"],
    "bsd-source": ["1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": [
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    ],
    "bsd-names": [
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    ],
}

#: Further licences by the sentences that name them: SPDX's identifier, and the names used in sentences.
NAMED = {
    "MIT": ["MIT License", "MIT license"],
    "Apache-2.0": ["Apache License 2.0", "Apache License, Version 2.0", "Apache-2.0 License"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GPLv3"],
    "GPL-3.0-only": [],
    "GPL-3.0-or-later": [],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GPLv2"],
    "GPL-2.0-only": [],
    "GPL-2.0-or-later": [],
    "GPL-1.0-only": [],
    "GPL-1.0-or-later": [],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPLv3"],
    "LGPL-3.0-only": [],
    "LGPL-3.0-or-later": [],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "LGPLv2.1"],
    "LGPL-2.1-only": [],
    "LGPL-2.1-or-later": [],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPLv3"],
    "AGPL-3.0-only": [],
    "AGPL-3.0-or-later": [],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License"],
    "ISC": ["ISC License"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, version 2.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License, version 2.0"],
    "BSL-1.0": ["Boost Software License, Version 1.0"],
    "Unlicense": ["Unlicense"],
    "Zlib": ["zlib License"],
    "0BSD": ["BSD Zero Clause License"],
    "BSD-4-Clause": ["BSD 4-Clause License"],
    "MPL-1.1": ["Mozilla Public License 1.1", "Mozilla Public License, version 1.1"],
    "EPL-1.0": ["Eclipse Public License 1.0", "Eclipse Public License, version 1.0"],
    "EUPL-1.2": ["European Union Public Licence 1.2", "European Union Public License 1.2"],
    "Artistic-2.0": ["Artistic License 2.0"],
    "OFL-1.1": ["SIL Open Font License 1.1", "SIL Open Font License, Version 1.1"],
    "PostgreSQL": ["PostgreSQL License"],
    "WTFPL": ["WTFPL"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal License"],
    "AFL-3.0": ["Academic Free License 3.0", "Academic Free License version 3.0"],
    "Apache-1.1": ["Apache License 1.1", "Apache License, Version 1.1"],
    "APSL-2.0": ["Apple Public Source License 2.0"],
    "Artistic-1.0": ["Artistic License 1.0"],
    "BlueOak-1.0.0": ["Blue Oak Model License 1.0.0"],
    "CDDL-1.0": ["Common Development and Distribution License 1.0"],
    "CDDL-1.1": ["Common Development and Distribution License 1.1"],
    "CECILL-2.1": ["CeCILL 2.1"],
    "CPL-1.0": ["Common Public License 1.0"],
    "ECL-2.0": ["Educational Community License, Version 2.0"],
    "EUPL-1.1": ["European Union Public Licence 1.1"],
    "FSFAP": [],
    "FTL": ["Freetype Project License"],
    "GFDL-1.3-only": [],
    "GFDL-1.3-or-later": [],
    "ICU": ["ICU License"],
    "IJG": [],
    "JSON": ["JSON License"],
    "LPPL-1.3c": ["LaTeX Project Public License 1.3c", "LaTeX Project Public License, version 1.3c"],
    "MIT-0": ["MIT No Attribution License"],
    "MPL-1.0": ["Mozilla Public License 1.0"],
    "MS-PL": ["Microsoft Public License"],
    "MS-RL": ["Microsoft Reciprocal License"],
    "MulanPSL-2.0": ["Mulan Permissive Software License, Version 2"],
    "NCSA": ["University of Illinois/NCSA Open Source License"],
    "ODbL-1.0": ["Open Database License 1.0", "Open Data Commons Open Database License 1.0"],
    "OpenSSL": ["OpenSSL License"],
    "OSL-3.0": ["Open Software License 3.0", "Open Software License version 3.0"],
    "PHP-3.01": ["PHP License 3.01", "PHP License, version 3.01"],
    "PSF-2.0": ["Python Software Foundation License 2.0"],
    "Python-2.0": [],
    "Ruby": ["Ruby License"],
    "Vim": ["Vim License"],
    "W3C": ["W3C Software License"],
    "X11": ["X11 License"],
    "ZPL-2.1": ["Zope Public License 2.1", "Zope Public License, Version 2.1"],
}
# families whose licences say whether later versions count too
for _code, _name, _versions in (
    ("GPL", "GNU General Public License", ("1", "2", "3")),
    ("LGPL", "GNU Lesser General Public License", ("2.1", "3")),
    ("AGPL", "GNU Affero General Public License", ("3",)),
):
    for _version in _versions:
        _id = f"{_code}-{_version if '.' in _version else _version + '.0'}"
        _named = [f"{x}{v}{_version}" for x in (_name, f"GNU {_code}", _code) for v in (" version ", " v", "v")]
        NAMED[f"{_id}-only"] += [f"{n}{x}" for n in _named for x in (" only", " as published by the Free Software Foundation")]
        NAMED[f"{_id}-or-later"] += [f"{_id}+"] + [f"{n}{x}" for n in _named for x in ("+", " or later", " or any later version", " or at your option any later version")]
        if _id in NAMED:
            NAMED[_id] += [n for n in _named if n not in NAMED[_id] and n.lower() not in {re.sub(",", "", x.lower()) for x in NAMED[_id]}]
#: Title lines of whole licence texts; a space may be a line's end.
TITLES = {
    "Apache-2.0": ["Apache License Version 2.0, January 2004"],
    "GPL-2.0": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "GPL-3.0": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "LGPL-2.1": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "LGPL-3.0": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "AGPL-3.0": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "MPL-2.0": ["Mozilla Public License Version 2.0", "Mozilla Public License, version 2.0"],
    "EPL-2.0": ["Eclipse Public License - v 2.0"],
    "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003"],
}
for _kind, _words in {
    "BY": "Attribution",
    "BY-SA": "Attribution-ShareAlike",
    "BY-NC": "Attribution-NonCommercial",
    "BY-ND": "Attribution-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}.items():
    NAMED[f"CC-{_kind}-4.0"] = [f"CC {_kind} 4.0", f"Creative Commons {_words} 4.0 International License", f"Creative Commons {_words} 4.0 License"]
    NAMED[f"CC-{_kind}-3.0"] = [f"CC {_kind} 3.0", f"Creative Commons {_words} 3.0 Unported License", f"Creative Commons {_words} 3.0 License"]
#: SPDX identifiers and names stand in these sentences.
TAGS = ["SPDX-License-Identifier: {}", "License: {}"]
USES = ["licensed under {}."]

#: Rules in order, the more special first: a licence and the identifiers that stand for it.
RULES = [
    *[(licence, [f"{licence.lower()}-title"]) for licence in TITLES],
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("MIT", ["mit-grant", "mit-notice", "as-is"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("Apache-2.0", ["apache-named", "apache-comply"]),
    ("GPL-3.0-or-later", ["gpl3-grant", "gpl-hope"]),
    ("GPL-3.0-or-later", ["gpl3-grant"]),
    ("GPL-2.0-or-later", ["gpl2-grant"]),
    ("Apache-2.0", ["apache-named"]),
    ("GPL-3.0", ["gpl3-named"]),
    ("MIT", ["mit-named"]),
    ("MPL-2.0", ["mpl-named"]),
    ("CC-BY-4.0", ["cc-by-named"]),
    ("Proprietary", ["reserved"]),
]

FURTHER_RULES = [
    ("LGPL-3.0-or-later", ["lgpl3-grant"]),
    ("LGPL-2.1-or-later", ["lgpl21-grant"]),
    ("AGPL-3.0-or-later", ["agpl3-grant"]),
    ("ISC", ["isc-grant"]),
    ("Unlicense", ["unlicense-grant"]),
    ("Zlib", ["zlib-grant"]),
    ("BSL-1.0", ["boost-grant"]),
    *[(licence, [f"{licence.lower()}-known"]) for licence in NAMED],
]

#: What normalising turns into a space, where sentences end, and what is trimmed from them.
OTHER = r"[^a-z0-9.!?;:+\n]+"
END = r"[.!?;:]+ |\n"
EDGE = ".!?;: "
#: An end by a stop, and one by a line; both with what is trimmed around them.
STOP = r" *+(?<![.!?;:])[.!?;:]++[ \n][.!?;: \n]*+"
LINE = r" *+\n[.!?;: ]*+"


def normalised(sentence: str) -> list[str]:
    """The parts that a catalogue entry is cut into, as in texts."""
    parts = re.split(END, re.sub(OTHER, " ", sentence.lower()))
    return [part.strip(EDGE) for part in parts if part.strip(EDGE)]


def key_of(sentence: str) -> str:
    return re.sub(*CALLED, "|".join(normalised(sentence)))


def phrases(entries: dict[str, list[str]]) -> dict[str, str]:
    """Normalised entry to identifier: all its parts, ``|`` between them. Two identifiers must not share one."""
    out: dict[str, str] = {}
    for name, versions in entries.items():
        for version in versions:
            if out.setdefault(key := key_of(version), name) != name:
                raise ValueError(f"{name} and {out[key]} share {key!r}")
    return out


def entries() -> dict[str, list[str]]:
    """All sentences by identifier; those made from names leave out what is a sentence of its own."""
    out = {k: SENTENCES.get(k, []) + FURTHER.get(k, []) for k in SENTENCES | FURTHER}
    out |= {f"{licence.lower()}-title": titles for licence, titles in TITLES.items()}
    taken = phrases(out)
    for licence, names in NAMED.items():
        made = [tag.format(x) for tag in TAGS for x in [licence, *names]] + [use.format(x) for use in USES for x in names]
        out[f"{licence.lower()}-known"] = [x for x in made if key_of(x) not in taken]
        taken |= phrases({f"{licence.lower()}-known": out[f"{licence.lower()}-known"]})
    return out


def rules() -> list[tuple[str, list[str]]]:
    """All rules in order; that of reserved rights stays the last."""
    return [*RULES[:-1], *FURTHER_RULES, RULES[-1]]


#: The sign of an expression of identifiers, what joins them, and what stands before an exception.
TAG, JOINED, EXCEPT = "spdx license identifier", " (?:and|or) ", " with "
#: This "or" doesn't join; so it is written while an expression is cut.
LATER, KEPT = " or later", "+or+later"
#: "This work is released under the ..." and the like in one form, in texts and in the catalogue.
CALLED = (r"(?:this[ \n](?:work|project|software)[ \n]is[ \n])?(?:licensed|released)[ \n]under[ \n](?:(?:the|a)[ \n])?", "licensed under ")


def rewritten() -> list[tuple[str, str]]:
    """Patterns over marked texts and what they turn into: forms of the conditions and notices that vary become sentences that are known.

    * a holder's name in the condition on names is a slot of up to 150 signs
    * "... under the terms of the NAME", and "licensed under the NAME" before a hint where to find it, is a sentence of its own
    """
    gap = r"[ \n]"
    names = sorted({"|".join(normalised(n)) for some in NAMED.values() for n in some}, key=lambda n: (-len(n), n))
    named = "(" + "|".join(gap.join(map(re.escape, n.split(" "))) for n in names if "|" not in n) + ")"
    article = rf"(?:(?:the|a|an){gap})?"
    holder = gap.join(["neither", "the", "names?", "of", ""]) + "[^!?;:]{1,150}?" + rf"[ |\n]nor{gap}the{gap}names{gap}of{gap}(?:its|any|the){gap}contributors"
    return [
        (holder, "neither the name of the copyright holder nor the names of its contributors"),
        (rf"[ |\n]under{gap}(?:the{gap})?(?:terms|conditions|terms{gap}and{gap}conditions){gap}of{gap}{article}{named}([ |\n])", r"|licensed under \1|\2"),
        (rf"[ |\n](?:licensed|released|distributed|available|published|provided){gap}under{gap}{article}{named}({gap}(?:see|as|which|at|in|found|available|for|by|https?)[ |\n])", r"|licensed under \1|\2"),
        (f"{TAG}:", f"{TAG}|"),
        CALLED,
    ]


def sentences(text: Column) -> Column:
    parts = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), OTHER, " "), END)
    return F.filter(F.transform(parts, lambda s: F.trim(s, F.lit(EDGE))), lambda s: s != "")


def marked(text: Column) -> Column:
    """The normalised text with ``|`` for the stops and a newline for the line ends between its sentences."""
    plain = F.concat(F.lit("\n"), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), OTHER, " "), F.lit("\n"))
    out = F.regexp_replace(F.regexp_replace(plain, STOP, "|"), LINE, "\n")
    for pattern_, put in rewritten():
        out = F.regexp_replace(out, pattern_, re.sub(r"\\(\d)", r"$\1", put))

    def single(part: Column, k: Column) -> Column:
        head = F.regexp_extract(part, r"^[^|\n]*", 0)
        return F.when(k == 0, part).otherwise(F.concat(F.replace(F.regexp_replace(F.regexp_replace(F.replace(head, F.lit(LATER), F.lit(KEPT)), JOINED, f"|{TAG}|"), EXCEPT, "|with "), F.lit(KEPT), F.lit(LATER)), F.substring(part, F.length(head) + 1, F.length(part))))

    return F.array_join(F.transform(F.split(out, re.escape(f"{TAG}|")), single), f"{TAG}|")


def pattern(keys: list[str]) -> str:
    """One pattern for all keys, as a tree of words: a longer key goes before its beginning. A space in a key may be a line's end."""
    tree: dict = {}
    for key in keys:
        node = tree
        for gap, word in re.findall(r"([ |]?)([^ |]+)", key):
            node = node.setdefault({"": "", " ": r"[ \n]", "|": r"\|"}[gap] + re.escape(word), {})
        node[""] = {}

    def shown(node: dict) -> str:
        parts = [word + shown(rest) for word, rest in node.items() if word] + [""] * ("" in node)
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    return shown(tree)


def identifiers(text: Column) -> Column:
    """Identifiers of the known sentences, in the order of the text."""
    known = phrases(entries())
    found = F.regexp_extract_all(marked(text), F.lit(rf"(?<![^|\n]){pattern(list(known))}(?![^|\n])"), F.lit(0))
    names = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.transform(found, lambda s: F.element_at(names, F.translate(s, "\n", " ")))


def licences(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the added columns; one of its own that has an added column's name is replaced."""
    added = ["n_sentences", "n_known", "sentence_ids", "licence", "licences"]
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in added]).alias("kept")
    named = docs.select(kept, F.size(sentences(F.col(text))).cast("long").alias("n_sentences"), identifiers(F.col(text)).alias("ids"))
    sequence = F.concat(F.lit(","), F.array_join("ids", ","), F.lit(","))
    holds = F.array(*[F.when(sequence.contains(f",{','.join(ids)},"), F.lit(name)) for name, ids in rules()])
    found = named.withColumn("found", F.array_distinct(F.filter(holds, lambda x: x.isNotNull())))
    return found.select(
        "kept.*",
        "n_sentences",
        F.size("ids").cast("long").alias("n_known"),
        F.array_join("ids", ",").alias("sentence_ids"),
        F.get("found", F.lit(0)).alias("licence"),
        F.array_join("found", ",").alias("licences"),
    )


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def oracle() -> str:
    """SQL by another way: texts are cut into lines and sentences, runs of them are joined with a table of known sentences, and the first and
    longest runs are picked one after the other."""
    known = phrases(entries())
    most = max(len(re.split("[ |]", k)) for k in known)
    heads = sorted({" ".join(re.split("[ |]", k)[:1]) for k in known})
    catalogue = ", ".join(f"({quoted(k)}, {quoted(name)})" for k, name in known.items())
    holds = ", ".join(f"CASE WHEN contains(seq, {quoted(',' + ','.join(ids) + ',')}) THEN {quoted(name)} END" for name, ids in rules())
    marks = r"regexp_replace(regexp_replace(chr(10) || t || chr(10), ' *[.!?;:]+[ \n][.!?;: \n]*', '|', 'g'), ' *\n[.!?;: ]*', chr(10), 'g')"
    for before, after in rewritten():
        marks = f"regexp_replace({marks}, {quoted(before)}, {quoted(after)}, 'g')"
    # list_distinct doesn't keep the order, so a name counts where it stands first
    return rf"""
WITH RECURSIVE catalogue(key, id) AS (VALUES {catalogue}),
plain AS MATERIALIZED (
  SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^a-z0-9.!?;:+\n]+', ' ', 'g') AS t FROM documents
), cut AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(array_to_string(list_transform(string_split({marks}, '{TAG}|'), lambda x, i: CASE WHEN i = 1 THEN x ELSE
    replace(regexp_replace(regexp_replace(replace(regexp_extract(x, '^[^|\n]*'), '{LATER}', '{KEPT}'), '{JOINED}', '|{TAG}|', 'g'), '{EXCEPT}', '|with ', 'g'), '{KEPT}', '{LATER}') || x[length(regexp_extract(x, '^[^|\n]*')) + 1:] END), '{TAG}|'), '[^|\n]*[|\n]') AS parts
  FROM plain
), starts AS MATERIALIZED (
  SELECT * FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM cut)
  WHERE regexp_extract(parts[i], '^[^ |\n]*') IN ({", ".join(map(quoted, heads))})
), best AS MATERIALIZED (
  SELECT doc_id, i, max(l) AS l, arg_max(id, l) AS id FROM (
    SELECT doc_id, i, l, replace(array_to_string(parts[i:i + l - 1], '')[:-2], chr(10), ' ') AS key FROM starts, range(1, {most + 1}) r(l) WHERE i + l - 1 <= len(parts)
  ) JOIN catalogue USING (key) GROUP BY doc_id, i
), followed AS MATERIALIZED (
  SELECT a.doc_id, a.i, min(b.i) AS after FROM best a JOIN best b ON b.doc_id = a.doc_id AND b.i >= a.i + a.l GROUP BY a.doc_id, a.i
), picked AS (
  SELECT doc_id, min(i) AS i FROM best GROUP BY doc_id UNION ALL SELECT f.doc_id, f.after FROM picked p JOIN followed f ON f.doc_id = p.doc_id AND f.i = p.i
), seqs AS (
  SELECT doc_id, string_agg(id, ',' ORDER BY i) AS ids, count(*) AS n FROM picked JOIN best USING (doc_id, i) GROUP BY doc_id
), held AS (
  SELECT *, list_filter([{holds}], lambda x: x IS NOT NULL) AS held FROM (SELECT *, ',' || ids || ',' AS seq FROM seqs)
), firsts AS (
  SELECT *, list_filter(held, lambda x, i: list_position(held, x) = i) AS found FROM held
)
SELECT p.doc_id, len(list_filter(list_transform(string_split_regex(t, '[.!?;:]+ |\n'), lambda s: trim(s, '.!?;: ')), lambda s: s <> ''))::BIGINT AS n_sentences,
       coalesce(n, 0)::BIGINT AS n_known, coalesce(ids, '') AS sentence_ids, found[1] AS licence, coalesce(array_to_string(found, ','), '') AS licences
FROM plain p LEFT JOIN firsts f ON f.doc_id = p.doc_id
"""
