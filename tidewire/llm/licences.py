"""Licence recognition by sentence rules, in DataFrame expressions alone.

A text is cut into sentences after `.`, `!`, `?` or `;` followed by white space and, first, at every line end, second, at
blank lines only, for texts with wrapped lines; the cut that yields more known sentences counts, the first if equal. A
sentence is normalised to lower-case letters and digits with single spaces. Sentences that equal a known licence sentence
become its identifier.
Ordered rules, those of most sentences first, are then matched against the sequence of identifiers; a match uses its
sentences up. Everything happens within a row, so there is no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licences and licence notices, by identifier.
SENTENCES = {
    "mit-notice": "Released under the MIT License",
    "mit-notice-2": "Licensed under the MIT License",
    "mit-title": "The MIT License (MIT)",
    "mit-title-2": "MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "apache-notice": "Licensed under the Apache License, Version 2.0",
    "apache-notice-long": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache-comply": "you may not use this file except in compliance with the License",
    "apache-obtain": "You may obtain a copy of the License at",
    "apache-disclaim": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "apache-governs": "See the License for the specific language governing permissions and limitations under the License",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl3-notice-2": "Licensed under the GNU General Public License, version 3",
    "gpl2-notice": "This work is licensed under the GNU General Public License, version 2",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "gpl-without": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-details": "See the GNU General Public License for more details",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "ccbync-notice": "Licensed under CC BY-NC 4.0",
    "ccby-notice": "Licensed under CC BY 4.0",
    "ccbysa-notice": "Licensed under CC BY-SA 4.0",
    "ccby-long": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc0-notice": "This work is dedicated to the public domain under the CC0 license",
    "rights": "All rights reserved",
}
# Licence, ordered sentence identifiers.
RULES = [
    ("MIT", ["mit-title", "mit-grant", "mit-condition", "mit-warranty"]),
    ("MIT", ["mit-title-2", "mit-grant", "mit-condition", "mit-warranty"]),
    ("MIT", ["mit-grant", "mit-condition", "mit-warranty"]),
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-notice-2"]),
    ("Apache-2.0", ["apache-notice-long", "apache-comply", "apache-obtain", "apache-disclaim", "apache-governs"]),
    ("Apache-2.0", ["apache-notice-long", "apache-comply"]),
    ("Apache-2.0", ["apache-notice"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-without", "gpl-details"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("GPL-3.0", ["gpl3-notice"]),
    ("GPL-3.0", ["gpl3-notice-2"]),
    ("GPL-2.0", ["gpl2-notice"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    ("CC-BY-NC-4.0", ["ccbync-notice"]),
    ("CC-BY-4.0", ["ccby-notice"]),
    ("CC-BY-4.0", ["ccby-long"]),
    ("CC-BY-SA-4.0", ["ccbysa-notice"]),
    ("CC0-1.0", ["cc0-notice"]),
    ("LicenseRef-All-Rights-Reserved", ["rights"]),
]
BREAK, WRAP, OTHER = r"([.!?;])[ \t\r\n\f]+", r"([^\n])\n([^\n])", r"[^A-Za-z0-9\n]+"
# Parts of words, at least one in every known sentence, so a text without them has none, however its lines are wrapped.
CUES = ["licens", "permission", "warrant", "redistribut", "copyright", "reserved", "domain", "released", "distributed"]


def normalise(sentence: str) -> str:
    """The rule that the column expression below follows, for the known sentences."""
    import re

    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


# Further wordings. A sentence here has the identifier of the list or of a notice of that licence.
VARIANTS: list[tuple[str, str]] = []


def _further() -> None:
    """Notices, headers and first sentences of the GNU licences and others, from their parts."""
    gnu = [("GPL", "GNU General Public License"), ("LGPL", "GNU Lesser General Public License"), ("LGPL", "GNU Library General Public License"), ("AGPL", "GNU Affero General Public License")]
    versions = {"GPL": ["2", "3"], "LGPL": ["2", "2.1", "3"], "AGPL": ["3"]}
    things = ["program", "library", "software", "file"]
    spdx = lambda v: v if "." in v else v + ".0"
    for v in ("2", "2.1", "3"):
        SENTENCES[f"later-{v}"] = f"either version {v} of the License, or (at your option) any later version"
        SENTENCES[f"only-{v}"] = f"version {v} of the License"
    for thing in things[1:]:
        VARIANTS.append((f"This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY", "gpl-hope"))
    for short, name in gnu:
        can = "you can redistribute it and/or modify it under the terms of the"
        fsf = "as published by the Free Software Foundation"
        low = short.lower()
        VARIANTS.append((f"{can} {name} {fsf}", f"{low}-terms"))
        VARIANTS.extend((f"This {t} is free software: {can} {name} {fsf}", f"{low}-terms") for t in things)
        if short != "GPL":
            VARIANTS.append((f"See the {name} for more details", "gpl-details"))
        for v in versions[short]:
            later, only = f"{low}-{v}-later", f"{low}-{v}-only"
            tail = f"either version {v} of the License, or (at your option) any later version"
            VARIANTS.append((f"{can} {name} {fsf}, {tail}", later))
            for t in things:
                if (short, v, t) != ("GPL", "3", "program"):  # gpl-free above
                    VARIANTS.append((f"This {t} is free software: {can} {name} {fsf}, {tail}", later))
            for w in (f"version {v}", f", version {v},", f"version {v} only"):
                VARIANTS.append((f"{can} {name} {w} {fsf}", only))
                VARIANTS.append((f"This program is free software: {can} {name} {w} {fsf}", only))
            VARIANTS.append((f"{can} {name} {fsf}, version {v} of the License", only))
    for short in versions:
        low = short.lower()
        for v in versions[short]:
            ends = ["gpl-hope", "gpl-without", "gpl-details"]
            for name, forms in ((f"{short}-{spdx(v)}-or-later", [[f"{low}-{v}-later"], [f"{low}-terms", f"later-{v}"]]), (f"{short}-{spdx(v)}-only", [[f"{low}-{v}-only"], [f"{low}-terms", f"only-{v}"]])):
                for form in forms:
                    RULES.extend([(name, form + ends), (name, form)])

    def notice(licence: str, *names: str, also: tuple[str, ...] = ()) -> None:
        """Short notices by the licence's names, its SPDX line, and other sentences that tell it."""
        have = {normalise(x) for x in SENTENCES.values()}
        mark = f"notice-{licence.lower()}"
        said = [f"{a} {n}" for n in names for a in ("Licensed under", "Licensed under the", "Released under the", "Distributed under the", "This work is licensed under the", "This work is licensed under a", "This project is licensed under the", "This software is licensed under the")]
        said += [f"SPDX-License-Identifier: {licence}", *also]
        VARIANTS.extend((x, mark) for x in said if normalise(x) not in have)
        RULES.append((licence, [mark]))

    notice("MIT", "MIT License")
    notice("Apache-2.0", "Apache License, Version 2.0", "Apache License 2.0", also=("Apache License Version 2.0, January 2004",))
    notice("BSD-2-Clause", "BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License")
    notice("BSD-3-Clause", "BSD 3-Clause License", "3-Clause BSD License", "New BSD License")
    for short, name in (gnu[0], gnu[1], gnu[3]):
        for v in versions[short]:
            said = [f"{name}, version {v}", f"{name} v{v}", f"{name} v{spdx(v)}", f"{short}v{v}", f"{short}-{spdx(v)}"]
            mark = f"{short}-{spdx(v)}"
            notice(f"{mark}-only", *(f"{n} only" for n in said))
            notice(f"{mark}-or-later", *(f"{n} or later" for n in said), f"{name}, version {v} or (at your option) any later version")
            if short == "GPL":
                dates = {"2": "June 1991", "3": "29 June 2007"}
            else:
                dates = {"2": "June 1991", "2.1": "February 1999", "3": "29 June 2007" if short == "LGPL" else "19 November 2007"}
            notice(mark, *said, also=(f"{name} Version {v}, {dates[v]}",))
    VARIANTS[:] = [x for x in VARIANTS if not any(x[0] == f"SPDX-License-Identifier: {k}-{v}" for k in versions for v in ("2.0", "2.1", "3.0"))]  # `+` is not told apart
    notice("MPL-2.0", "Mozilla Public License 2.0", "Mozilla Public License, Version 2.0", "MPL 2.0", also=("This Source Code Form is subject to the terms of the Mozilla Public License, v", "Mozilla Public License Version 2.0"))
    notice("MPL-1.1", "Mozilla Public License 1.1", "Mozilla Public License, Version 1.1", also=('The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License")',))
    notice("EPL-1.0", "Eclipse Public License 1.0", "Eclipse Public License v1.0", also=("Eclipse Public License - v 1.0",))
    notice("EPL-2.0", "Eclipse Public License 2.0", "Eclipse Public License v2.0", also=("Eclipse Public License - v 2.0",))
    isc = "Permission to use, copy, modify, {} distribute this software for any purpose with or without fee is hereby granted"
    keep = ", provided that the above copyright notice and this permission notice appear in all copies"
    notice("ISC", "ISC License", also=(isc.format("and/or") + keep, isc.format("and") + keep))
    notice("0BSD", "Zero-Clause BSD License", "BSD Zero Clause License", also=(isc.format("and/or"),))
    notice("Unlicense", "Unlicense", also=("This is free and unencumbered software released into the public domain",))
    notice("BSL-1.0", "Boost Software License 1.0", "Boost Software License, Version 1.0", also=("Boost Software License - Version 1.0 - August 17th, 2003", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'))
    notice("CC0-1.0", "CC0 1.0", "CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal")
    for kind, long in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")):
        notice(f"CC-{kind}-4.0", f"CC {kind} 4.0", f"Creative Commons {long} 4.0 International License", f"Creative Commons {long} 4.0 International")
        notice(f"CC-{kind}-3.0", f"CC {kind} 3.0", f"Creative Commons {long} 3.0 Unported License", f"Creative Commons {long} 3.0 Unported")


_further()


def known() -> dict[str, str]:
    """Normalised sentence to identifier; a sentence of this list holds no sentence end within."""
    found = {normalise(s): i for i, s in SENTENCES.items()}
    assert len(found) == len(SENTENCES)
    for s, i in VARIANTS:
        assert found.setdefault(normalise(s), i) == i, s
    assert all(any(c in s for c in CUES) for s in found) and not any(" " in c for c in CUES)
    return found


def ordered_rules() -> list[tuple[str, str]]:
    """(licence, pattern over '<id>' marks), longest first, otherwise in the order given."""
    return [(name, "".join(f"<{i}>" for i in ids)) for name, ids in sorted(RULES, key=lambda r: -len(r[1]))]


def sentence_ids(text: Column) -> Column:
    """The identifiers of the known sentences of a text, in order; none for a null text."""
    table = known()
    names = F.array(*[F.lit(s) for s in table])
    marks = F.array(*[F.lit(i) for i in table.values()])

    def cut(t: Column) -> Column:
        body = F.lower(F.regexp_replace(F.regexp_replace(t, BREAK, "$1\n\n"), OTHER, " "))
        cued = F.filter(F.split(body, "\n"), lambda s: s.rlike("|".join(CUES)))
        return F.filter(F.transform(cued, lambda s: F.array_position(names, F.trim(s))), lambda k: k > 0)

    lines = cut(text)
    wrapped = cut(F.regexp_replace(F.regexp_replace(text, BREAK, "$1\n\n"), WRAP, "$1 $2"))
    at = F.when(F.size(wrapped) > F.size(lines), wrapped).otherwise(lines)
    cue = F.lower(text).rlike("|".join(CUES))
    return F.when(cue, F.transform(at, lambda k: F.element_at(marks, k.cast("int")))).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """keep, sentence_ids, licences (distinct, in order of name) and unmatched, the number of known sentences that no
    rule used. A text without known sentences, null or empty has empty arrays. Other columns are ignored."""
    rules = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("pattern")) for n, p in ordered_rules()])
    rows = docs.select(*keep, sentence_ids(F.col(text)).alias("sentence_ids"))
    start = F.struct(
        F.array_join(F.transform("sentence_ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "").alias("rest"),
        F.array().cast("array<string>").alias("found"),
    )
    step = lambda s, r: F.when(
        F.contains(s["rest"], r["pattern"]),
        F.struct(F.replace(s["rest"], r["pattern"], F.lit("|")).alias("rest"), F.array_append(s["found"], r["name"]).alias("found")),
    ).otherwise(s)
    matched = F.when(F.size("sentence_ids") > 0, F.aggregate(rules, start, step)).otherwise(start)
    return rows.withColumn("__m", matched).select(
        *keep,
        "sentence_ids",
        F.array_sort(F.array_distinct("__m.found")).alias("licences"),
        (F.length("__m.rest") - F.length(F.translate("__m.rest", "<", ""))).cast("int").alias("unmatched"),
    )
