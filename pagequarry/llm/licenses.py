"""Licence recognition by sentences, with DataFrame functions only.

A text is cut into sentences, which are normalised to lower-case words. Known
sentences have identifiers; the text becomes the sequence of those it holds. Known
texts are cut and normalised in the same way, so one that the cut parts is known as
the sequence of its pieces.
Ordered rules, longer ones first, then match runs of identifiers and use them up,
so a licence that contains another's sentences is not reported as both.

Before that, signs of comments go from the starts of lines, and sentences that begin
licence texts are parted from what stands before them, such as a line of copyright. A
clause that names an organisation is read as the known one. Phrases inside other sentences
("is licensed under the MIT License - see ..."), fields that name a licence
(license: MIT) and addresses of licences follow as identifiers that name it.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of licences as they stand in notices.
NAMES = {
    "Apache-2.0": ("the apache license version 2.0", "the apache license 2.0", "apache license version 2.0", "apache license 2.0", "apache 2.0", "the apache 2.0 license"),
    "MIT": ("the mit license", "mit license", "an mit license", "the mit licence", "mit"),
    "GPL-2.0": ("the gnu general public license version 2", "the gnu gpl version 2", "gpl version 2", "the gnu general public license v2.0", "gpl 2.0"),
    "GPL-3.0": ("the gnu general public license version 3", "the gnu gpl version 3", "gpl version 3", "the gnu general public license v3.0", "gpl 3.0", "the gnu general public license version 3.0"),
    "LGPL-2.1": ("the gnu lesser general public license version 2.1", "lgpl version 2.1", "lgpl 2.1"),
    "LGPL-3.0": ("the gnu lesser general public license version 3", "lgpl version 3", "lgpl 3.0"),
    "AGPL-3.0": ("the gnu affero general public license version 3", "agpl version 3", "agpl 3.0"),
    "BSD-2-Clause": ("the bsd 2 clause license", "the 2 clause bsd license", "bsd 2 clause license"),
    "BSD-3-Clause": ("the bsd 3 clause license", "the 3 clause bsd license", "bsd 3 clause license"),
    "BSD": ("the bsd license", "a bsd style license", "bsd license"),
    "MPL-2.0": ("the mozilla public license version 2.0", "the mozilla public license v. 2.0", "mpl 2.0", "the mozilla public license 2.0"),
    "EPL-2.0": ("the eclipse public license version 2.0", "epl 2.0", "the eclipse public license 2.0"),
    "ISC": ("the isc license", "isc license"),
    "Unlicense": ("the unlicense",),
    "CC0-1.0": ("cc0 1.0", "cc0 1.0 universal", "cc0"),
    "CC-BY-4.0": ("cc by 4.0", "a creative commons attribution 4.0 international license", "the creative commons attribution 4.0 license"),
    "CC-BY-SA-4.0": ("cc by sa 4.0", "a creative commons attribution sharealike 4.0 international license"),
    "CC-BY-NC-4.0": ("cc by nc 4.0", "a creative commons attribution noncommercial 4.0 international license"),
    "CC-BY-NC-SA-4.0": ("cc by nc sa 4.0",),
    "CC-BY-ND-4.0": ("cc by nd 4.0",),
    "CC-BY-NC-ND-4.0": ("cc by nc nd 4.0",),
}
STEMS = (
    "licensed under", "this work is licensed under", "this file is licensed under", "this project is licensed under",
    "this software is licensed under", "this code is licensed under", "this content is licensed under", "this text is licensed under",
    "this document is licensed under", "released under", "this work is released under", "this software is released under",
    "this project is released under", "distributed under", "this software is distributed under", "published under",
    "available under", "this text is available under", "is licensed under", "dual licensed under", "licensed under the terms of",
    "distributed under the terms of", "released under the terms of", "published under the terms of",
)
# Sentences of licence texts.
SENTENCES = {
    "apache-grant": "licensed under the apache license version 2.0 the license",
    "apache-terms": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www.apache.org licenses license 2.0",
    "apache-warranty": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-limits": "see the license for the specific language governing permissions and limitations under the license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "mpl-terms": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "epl-terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    "epl-short": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "public-domain": "this is free and unencumbered software released into the public domain",
    "boost-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "apache-title": "apache license version 2.0 january 2004 http www.apache.org licenses",
    "gpl-title": "gnu general public license version 3 29 june 2007",
    "gpl2-title": "gnu general public license version 2 june 1991",
    "lgpl-title": "gnu lesser general public license version 3 29 june 2007",
    "lgpl21-title": "gnu lesser general public license version 2.1 february 1999",
    "agpl-title": "gnu affero general public license version 3 19 november 2007",
    "mpl-title": "mozilla public license version 2.0",
    "epl-title": "eclipse public license v 2.0",
    "cc-by-title": "creative commons attribution 4.0 international public license",
    "cc-by-sa-title": "creative commons attribution sharealike 4.0 international public license",
    "cc-by-nc-title": "creative commons attribution noncommercial 4.0 international public license",
}
# Notices of the Free Software Foundation by subject, licence and version.
FOUNDATION = {
    "gpl": ("GPL-3.0-or-later", ("program",), "General", "3"),
    "gpl2": ("GPL-2.0-or-later", ("program",), "General", "2"),
    "lgpl": ("LGPL-3.0-or-later", ("library", "program"), "Lesser General", "3"),
    "lgpl21": ("LGPL-2.1-or-later", ("library", "program"), "Lesser General", "2.1"),
    "lgpl2": ("LGPL-2.0-or-later", ("library",), "Library General", "2"),
    "agpl": ("AGPL-3.0-or-later", ("program",), "Affero General", "3"),
}
ONLY = ("gpl", "gpl2", "lgpl21")  # notices of one version alone
# Identifiers that tags name, besides those of NAMES.
TAGGED = (
    "GPL-1.0-only", "GPL-1.0-or-later", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.0-only", "LGPL-2.0-or-later",
    "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "0BSD", "Apache-1.1", "Artistic-1.0", "Artistic-2.0",
    "BSD-1-Clause", "BSD-3-Clause-Clear", "BSD-4-Clause", "BSL-1.0", "CC-BY-3.0", "CC-BY-SA-3.0", "CDDL-1.0", "CDDL-1.1", "CPL-1.0", "EPL-1.0", "EUPL-1.1", "EUPL-1.2", "GFDL-1.3-or-later",
    "IPL-1.0", "LPPL-1.3c", "MIT-0", "MPL-1.1", "MS-PL", "MS-RL", "NCSA", "OFL-1.1", "OpenSSL", "PHP-3.01", "PostgreSQL", "PSF-2.0", "Python-2.0", "Ruby", "UPL-1.0", "W3C", "WTFPL", "X11", "Zlib", "ZPL-2.1",
)
_BLANKS = "You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\n"
# Other punctuation of these; blank lines of a comment begin with its sign, so they do not cut.
WORDINGS = {
    "apache-copy": (_BLANKS,),
    **{
        f"{key}-free": tuple(
            f"This {subject} is free software{a} you can redistribute it and/or modify it under the terms of the GNU {name} Public License as published by the Free Software Foundation{b} either version {n} of the License, or (at your option) any later version."
            for subject in subjects for a in ":;," for b in ";,"
        )
        for key, (_, subjects, name, n) in FOUNDATION.items()
    },
    # After other words without a full stop, such as a line of copyright, only the rest of the notice stands alone.
    **{
        f"{key}-rest": tuple(
            f"you can redistribute it and/or modify it under the terms of the GNU {name} Public License as published by the Free Software Foundation{b} either version {n} of the License, or (at your option) any later version."
            for b in ";,"
        )
        for key, (_, _, name, n) in FOUNDATION.items()
    },
    **{
        f"{key}-only{part}": tuple(
            f"{head}you can redistribute it and/or modify it under the terms of the GNU {name} Public License {tail}"
            for head in heads
            for tail in (f"version {n} as published by the Free Software Foundation.", *(f"as published by the Free Software Foundation{b} version {n} of the License." for b in ";,"))
        )
        for key in ONLY for _, subjects, name, n in [FOUNDATION[key]]
        for part, heads in (("", [f"This {x} is free software{a} " for x in subjects for a in ";,"]), ("-rest", [""]))
    },
}
SENTENCES["apache-copy-warranty"] = f"{SENTENCES['apache-copy']} {SENTENCES['apache-warranty']}"
# Sequences of identifiers, tried in this order; each match is used up.
SEQUENCES = (
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-grant",)),
    ("MIT", ("mit-notice", "mit-warranty")),
    ("ISC", ("isc-grant",)),
    ("Apache-2.0", ("apache-grant", "apache-terms", "apache-copy", "apache-warranty", "apache-limits")),
    ("Apache-2.0", ("apache-grant", "apache-terms", "apache-copy-warranty", "apache-limits")),
    ("Apache-2.0", ("apache-grant", "apache-terms")),
    ("Apache-2.0", ("apache-grant",)),
    *((spdx, (f"{key}-{part}",)) for part in ("free", "rest") for key, (spdx, *_) in FOUNDATION.items()),
    *((FOUNDATION[key][0].replace("or-later", "only"), (f"{key}-only{part}",)) for part in ("", "-rest") for key in ONLY),
    ("MPL-2.0", ("mpl-terms",)),
    ("EPL-2.0", ("epl-terms",)),
    ("EPL-2.0", ("epl-short",)),
    ("BSL-1.0", ("boost-grant",)),
    ("Zlib", ("zlib-grant",)),
    ("Apache-2.0", ("apache-title",)),
    ("GPL-3.0", ("gpl-title",)),
    ("GPL-2.0", ("gpl2-title",)),
    ("LGPL-3.0", ("lgpl-title",)),
    ("LGPL-2.1", ("lgpl21-title",)),
    ("AGPL-3.0", ("agpl-title",)),
    ("MPL-2.0", ("mpl-title",)),
    ("EPL-2.0", ("epl-title",)),
    ("CC-BY-4.0", ("cc-by-title",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-title",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-title",)),
    ("Unlicense", ("public-domain",)),
)
# Each known sentence holds one of these, however its words are parted, so a text without them has none.
ANCHORS = r"licen[sc]|permi|redistribut|warranty|2[.]0|(?:released|distributed|published|available)[^a-z0-9.]+under|public[^a-z0-9.]+domain|free[^a-z0-9.]+software"
TAG = r"spdx-license-identifier[: \t]+([a-z0-9.+() \t-]+)"  # an expression of identifiers, in lower case
TAG_NAME = "[a-z0-9.+-]+"
FIELD = r"""(?:\blicen[sc]e["']?\s*[:=]\s*["']?|(?:opensource|spdx)\.org/licenses?/)([a-z0-9.+-]+)"""  # one name
FIELD_END = r"(?:\.(?:html|php|txt))?\.*$"
COMMENT = r"(^|\n)[ \t]*(?:/\*+|\*+/|\*+|//+|#+|--+|;+|%+|!+|<!--|dnl\b|rem\b)[ \t]*"
# How sentences of licence texts begin.
STARTS = (
    "permission is hereby granted", "permission to use", "permission is granted to anyone", "redistribution and use in source", "redistributions of source code",
    "redistributions in binary form", "neither the name", "this program is free software", "this library is free software", "the software is provided",
    "the above copyright notice and this permission notice shall", "this source code form is subject",
)
START = rf"\b({'|'.join(STARTS)})\b".replace(" ", r"\s+")
# An organisation's dot ("Inc.") may cut the sentence before "nor".
NAMED = "^(?:neither the names? of .+|nor the names? of .+ contributors) may be used to endorse or promote products derived from this software without specific prior written permission$"
_GNU = {"GPL-2.0": ("general", "gpl", "2"), "GPL-3.0": ("general", "gpl", "3"), "LGPL-2.1": ("lesser general", "lgpl", "2.1"), "LGPL-3.0": ("lesser general", "lgpl", "3"), "AGPL-3.0": ("affero general", "agpl", "3")}
_LATER = ("or later", "or any later", "or at your option any later")
_ARTICLE = r"^(?:the|an?) "
BREAK = r"[.!?;:]+(?:\s+|\z)|\n\s*\n"


def pieces(text: str) -> tuple[str, ...]:
    """A known text as the sentences that sentence_ids() makes of it."""
    normal = (re.sub(r"\.+ ", " ", re.sub("[^a-z0-9.]+", " ", x) + " ").strip() for x in re.split(BREAK.replace(r"\z", r"\Z"), text.lower()))
    return tuple(x for x in normal if x)


def _wordings(key: str) -> list[tuple[str, ...]]:
    return list(dict.fromkeys(map(pieces, (*([SENTENCES[key]] if key in SENTENCES else []), *WORDINGS.get(key, ())))))


def _notices() -> list[tuple[str, tuple[str, ...]]]:
    """Licence and pieces of each notice that names it."""
    return [(spdx, pieces(f"{stem} {name}")) for spdx, names in NAMES.items() for name in names for stem in STEMS]


def known_sentences() -> dict[str, str]:
    """Normalised sentence to identifier; a notice's identifier is the licence it names.

    The pieces of a text that is cut have numbers; one that several texts share has the identifier of the first.
    """
    known: dict[str, str] = {}
    for spdx, run in _notices():
        for k, x in enumerate(run):
            known.setdefault(x, spdx if len(run) == 1 else f"{spdx}-{k + 1}")
    for spdx, names in NAMES.items():
        for run in (pieces(x) for x in names if "licen" in x):
            if len(run) == 1:
                known.setdefault(run[0], spdx)
    for key in dict.fromkeys((*SENTENCES, *WORDINGS)):
        count = 0
        for run in _wordings(key):
            for x in run:
                if x not in known:
                    count += 1
                    known[x] = key if len(run) == 1 else f"{key}-{count}"
    return known


def phrase_names() -> dict[str, str]:
    """Names of licences inside sentences, without articles, to identifiers."""
    out = {re.sub(_ARTICLE, "", x).replace("v. ", "v "): spdx for spdx, names in NAMES.items() for x in names}
    out |= {"apache license v2.0": "Apache-2.0", "apache license v2": "Apache-2.0", "apache license version 2": "Apache-2.0", "mozilla public license v2.0": "MPL-2.0"}
    for spdx, (name, short, n) in _GNU.items():
        for number in {n, f"{n}.0" if "." not in n else n}:
            forms = [f"{x}{v}{number}" for x in (f"gnu {name} public license", f"gnu {short}", short) for v in (" v", " version ", " ", " v ")] + [f"{short}v{number}"]
            for form in forms:
                out[form] = spdx
                out |= {f"{form} {more}": f"{spdx}-or-later" for more in _LATER}
    return out


def phrase() -> str:
    """Pattern of a verb and a name; longer names first."""
    gap = r"[^a-z0-9.+;!?]{1,4}"
    names = "|".join(re.escape(x).replace(r"\ ", gap) for x in sorted(phrase_names(), key=lambda x: (-len(x), x)))
    return rf"\b(?:licen[sc]ed|released|distributed|published|available|provided|covered)\s+(?:under|by)\s+(?:(?:the\s+)?terms\s+(?:and\s+conditions\s+)?of\s+)?(?:(?:the|an?)\s+)?({names})(?:[^a-z0-9+-]|-\s|\z)"


def tagged_names() -> dict[str, str]:
    """Names in tags, in lower case, to identifiers; a plus stands for later versions."""
    named = {x.lower(): x for x in (*NAMES, *TAGGED)}
    return named | {f"{x.removesuffix('-or-later')}+": full for x, full in named.items() if x.endswith("-or-later")}


def rules() -> list[tuple[str, tuple[str, ...]]]:
    known = known_sentences()
    ids = lambda run: tuple(known[x] for x in run)
    runs = [(name, ids(x for part in parts for x in part)) for name, keys in SEQUENCES for parts in product(*map(_wordings, keys))]
    named = [(spdx, ids(run)) for spdx, run in _notices() if len(run) > 1]
    return list(dict.fromkeys([*runs, *named, *((spdx, (spdx,)) for spdx in (*NAMES, *TAGGED))]))


def _normal(sentences: Column) -> Column:
    """Runs of other characters become a space, dots before a space or the end go."""
    words = lambda s: F.trim(F.regexp_replace(F.concat(F.regexp_replace(s, "[^a-z0-9.]+", " "), F.lit(" ")), r"\.+ ", " "))
    return F.transform(sentences, lambda s: F.regexp_replace(words(s), NAMED, SENTENCES["bsd-names"]))


def _prepared(text: Column) -> Column:
    """Lower case, without signs of comments, cut before sentences that begin licence texts."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), COMMENT, "$1"), START, "\n\n$1")


def _looked_up(names: Column, known: dict[str, str]) -> Column:
    """What known names stand for, in order; a hashed set leaves out the others before the map is searched."""
    # One literal that the optimizer folds to a map, as thousands of them would take seconds to plan.
    table = F.str_to_map(F.lit("\x01".join(f"{a}\x02{b}" for a, b in known.items())), F.lit("\x01"), F.lit("\x02"))
    return F.transform(F.filter(names, lambda x: x.isin(*known)), lambda x: F.element_at(table, x))


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order, then those that its tags name.

    Sentences may run over line ends; those of single lines, for notices after a line
    without a full stop, follow if the longer reading did not find them. Last come
    names in fields, addresses and phrases, if nothing before gave them.
    """
    low = _prepared(text)
    both = F.transform(F.array(F.split(low, BREAK), F.split(low, BREAK + r"|\n")), lambda s: _looked_up(_normal(s), known_sentences()))
    whole, lines = F.get(both, F.lit(0)), F.get(both, F.lit(1))
    tags = F.flatten(F.transform(F.regexp_extract_all(low, F.lit(TAG), F.lit(1)), lambda x: F.regexp_extract_all(x, F.lit(TAG_NAME), F.lit(0))))
    every = F.concat(whole, F.filter(lines, lambda x: ~F.array_contains(whole, x)), _looked_up(tags, tagged_names()))
    fields = F.transform(F.regexp_extract_all(low, F.lit(FIELD), F.lit(1)), lambda x: F.regexp_replace(x, FIELD_END, ""))
    named = F.concat(_looked_up(fields, tagged_names()), _looked_up(_normal(F.regexp_extract_all(low, F.lit(phrase()), F.lit(1))), phrase_names()))
    every = F.get(F.transform(F.array(every), lambda e: F.concat(e, F.filter(named, lambda x: ~F.array_contains(e, x)))), F.lit(0))
    return F.when(F.rlike(low, F.lit(ANCHORS)), every).otherwise(F.array().cast("array<string>"))


def match_rules(ids: Column) -> Column:
    """Licences whose sequences occur in ids, in the order of the rules, each once."""
    table = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(f"|{'|'.join(run)}|").alias("run")) for name, run in rules()])
    none = F.array().cast("array<string>")
    rest = F.concat(F.lit("|"), F.array_join(ids, "|"), F.lit("|"))

    def step(acc: Column, rule: Column) -> Column:
        hit = F.contains(acc["rest"], rule["run"])
        return F.struct(
            F.when(hit, F.replace(acc["rest"], rule["run"], F.lit("|"))).otherwise(acc["rest"]).alias("rest"),
            F.when(hit, F.array_union(acc["found"], F.array(rule["name"]))).otherwise(acc["found"]).alias("found"),
        )

    folded = F.aggregate(table, F.struct(rest.alias("rest"), none.alias("found")), step, lambda acc: acc["found"])
    return F.when(F.size(ids) > 0, folded).otherwise(none)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sentence_ids and licenses (each joined by |) and n_licenses of every row.

    Null and empty texts have none; repeated rows and null ids stay as they are, each
    with its result; very long texts are cut in one task's memory, as any row is; an
    empty table gives no rows. Of rules that could use the same sentence the first wins.
    """
    left = docs.select(F.col(id_col).cast("long").alias("doc_id"), sentence_ids(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("ids"))
    return left.select("doc_id", F.array_join("ids", "|").alias("sentence_ids"), match_rules(F.col("ids")).alias("l")).select("doc_id", "sentence_ids", F.array_join("l", "|").alias("licenses"), F.size("l").cast("long").alias("n_licenses"))
