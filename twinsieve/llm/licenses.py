"""License scans by sentence and rule (DataFrame functions only, no shuffle)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Known licence sentences (normalised: lower case, other characters as one blank).
SENTENCES: dict[str, str] = {
    "apache2-name": "licensed under the apache license version 2 0",
    "apache2-grant": "licensed under the apache license version 2 0 the license",
    "apache2-comply": "you may not use this file except in compliance with the license",
    "apache2-copy": "you may obtain a copy of the license at",
    "apache2-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "mit-name": "released under the mit license",
    "mit-name-2": "licensed under the mit license",
    "mit-title": "mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "gpl3-name": "this work is licensed under the gnu general public license version 3",
    "gpl3-name-2": "licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-as-is": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "mpl2-form": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl2-copy": "if a copy of the mpl was not distributed with this file you can obtain one at",
    "gpl2-only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "lgpl21-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "agpl3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "cc0-law": "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "epl2-terms": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at",
    "epl1-terms": "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "perl-terms": "this library is free software you can redistribute it and or modify it under the same terms as perl itself",
    "artistic2-name": "licensed under the artistic license 2 0",
    "boost-name": "distributed under the boost software license version 1 0",
    "wtfpl-grant": "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
    "ccby4-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "ccbysa4-work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "ccbync4-work": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "ccbynd4-work": "this work is licensed under a creative commons attribution noderivatives 4 0 international license",
    "ccbyncsa4-work": "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license",
    "ccbyncnd4-work": "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license",
    "ccbync4-name": "licensed under cc by nc 4 0",
    "ccby4-name": "licensed under cc by 4 0",
    "ccbysa4-name": "licensed under cc by sa 4 0",
    "reserved": "all rights reserved",
    "no-copying": "unauthorized copying of this file via any medium is strictly prohibited",
    "proprietary": "proprietary and confidential",
}

# Fixed values: (rule, licence, class, sentence identifiers in order). The first match of a licence counts.
RULES: tuple[tuple[str, str, str, tuple[str, ...]], ...] = (
    ("apache2-header", "Apache-2.0", "permissive", ("apache2-grant", "apache2-comply", "apache2-copy", "apache2-basis")),
    ("apache2-short", "Apache-2.0", "permissive", ("apache2-grant", "apache2-comply")),
    ("apache2-notice", "Apache-2.0", "permissive", ("apache2-name",)),
    ("mit-text", "MIT", "permissive", ("mit-grant", "mit-notice")),
    ("mit-notice", "MIT", "permissive", ("mit-name",)),
    ("mit-notice-2", "MIT", "permissive", ("mit-name-2",)),
    ("bsd-3-text", "BSD-3-Clause", "permissive", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("bsd-2-text", "BSD-2-Clause", "permissive", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is")),
    ("bsd-text", "BSD", "permissive", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("isc-text", "ISC", "permissive", ("isc-grant",)),
    ("0bsd-text", "0BSD", "permissive", ("0bsd-grant",)),
    ("zlib-text", "Zlib", "permissive", ("zlib-as-is", "zlib-grant")),
    ("boost-notice", "BSL-1.0", "permissive", ("boost-name",)),
    ("unlicense-text", "Unlicense", "permissive", ("unlicense-free", "unlicense-anyone")),
    ("cc0-text", "CC0-1.0", "permissive", ("cc0-law",)),
    ("wtfpl-text", "WTFPL", "permissive", ("wtfpl-grant",)),
    ("perl-notice", "Artistic-1.0-Perl", "permissive", ("perl-terms",)),
    ("artistic2-notice", "Artistic-2.0", "permissive", ("artistic2-name",)),
    ("agpl3-text", "AGPL-3.0", "copyleft", ("agpl3-free", "gpl-hope")),
    ("gpl3-text", "GPL-3.0", "copyleft", ("gpl-free", "gpl-hope")),
    ("gpl3-notice", "GPL-3.0", "copyleft", ("gpl3-name",)),
    ("gpl3-notice-2", "GPL-3.0", "copyleft", ("gpl3-name-2",)),
    ("gpl2-text", "GPL-2.0", "copyleft", ("gpl2-free", "gpl-hope")),
    ("gpl2-only-text", "GPL-2.0", "copyleft", ("gpl2-only", "gpl-hope")),
    ("lgpl3-text", "LGPL-3.0", "copyleft", ("lgpl3-free", "lgpl-hope")),
    ("lgpl21-text", "LGPL-2.1", "copyleft", ("lgpl21-free", "lgpl-hope")),
    ("mpl2-text", "MPL-2.0", "copyleft", ("mpl2-form",)),
    ("epl2-text", "EPL-2.0", "copyleft", ("epl2-terms",)),
    ("epl1-text", "EPL-1.0", "copyleft", ("epl1-terms",)),
    ("ccbysa4-notice", "CC-BY-SA-4.0", "copyleft", ("ccbysa4-name",)),
    ("ccbysa4-text", "CC-BY-SA-4.0", "copyleft", ("ccbysa4-work",)),
    ("ccby4-notice", "CC-BY-4.0", "permissive", ("ccby4-name",)),
    ("ccby4-text", "CC-BY-4.0", "permissive", ("ccby4-work",)),
    ("ccbync4-notice", "CC-BY-NC-4.0", "restricted", ("ccbync4-name",)),
    ("ccbync4-text", "CC-BY-NC-4.0", "restricted", ("ccbync4-work",)),
    ("ccbynd4-text", "CC-BY-ND-4.0", "restricted", ("ccbynd4-work",)),
    ("ccbyncsa4-text", "CC-BY-NC-SA-4.0", "restricted", ("ccbyncsa4-work",)),
    ("ccbyncnd4-text", "CC-BY-NC-ND-4.0", "restricted", ("ccbyncnd4-work",)),
    ("reserved-notice", "All-Rights-Reserved", "restricted", ("reserved",)),
    ("no-copying-notice", "Proprietary", "restricted", ("no-copying",)),
    ("proprietary-notice", "Proprietary", "restricted", ("proprietary",)),
)

# Every known sentence has one of these: a text without any has no licence sentence.
HINT = "licens|distribut|permission|reserved|warrant|copyright|domain|prohibited|proprietary"


#: Addresses stand as sentences of their own.
ADDRESS = r"https?://[^\x20\x09-\x0D]+"


def normalise(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


def with_identifiers(sentences: dict[str, str], rules) -> tuple[dict[str, str], tuple]:
    """Adds the identifier line ``SPDX-License-Identifier: <licence>`` of each licence of the rules."""
    kinds = {lic: kind for _, lic, kind, _ in rules}
    names = {f"spdx-{normalise(lic).replace(' ', '-')}": (lic, kind) for lic, kind in kinds.items()}
    lines = {name: f"spdx license identifier {normalise(lic)}" for name, (lic, _) in names.items()}
    return sentences | lines, (*rules, *((name, lic, kind, (name,)) for name, (lic, kind) in names.items()))


SENTENCES, RULES = with_identifiers(SENTENCES, RULES)

#: Replacements that leave normalised pieces: S is a sentence end, P a blank line (lower-cased
#: text has no capitals).
STEPS = (
    (ADDRESS, "S$0S"),
    (r"[.!?;:](?=[\x20\x09-\x0D])", "S"),
    (r"[^a-z0-9S\n]+", " "),
    (r"(?: ?S)+ ?", "S"),
    (r"[ S]?\n[ S]?(?:\n[ S]?)+", "P"),
    (r"[ S]?\n[ S]?|S", "|"),
    (r"\|+", "|"),
    ("P", "||"),
)


def _pieces(text) -> F.Column:
    """The normalised pieces of a text, each between two ``|``; a blank line gives an empty one."""
    out = F.lower(F.coalesce(text, F.lit("")))
    for pattern, new in STEPS:
        out = F.regexp_replace(out, pattern, new)
    return F.concat(F.lit("|"), F.trim(out), F.lit("|"))


def scan_licenses(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sentences=None, rules=None
) -> DataFrame:
    """One row per input row: ``id_col, sentence_ids, rules, licenses, license_class``.

    A text is cut into pieces at line ends, after ``. ! ? ; :`` followed by white space and
    around addresses; comment signs vanish as pieces are normalised. A piece, or a run of
    pieces with no blank line inside, that gives a known sentence gives its identifier, in
    text order (``sentence_ids``, joined by ``,``), however the text is wrapped; of several
    that start at one piece the longest counts. A rule matches if its identifiers stand next
    to each other, in order, in that sequence; unknown sentences in between do not matter.
    ``rules`` and ``licenses`` list the matches in rule order; ``license_class`` is the
    strictest class found (restricted, copyleft, permissive), or null.

    Null and empty texts have no sentence. All work is done within the row and over the
    whole text, however long, so rows of any table (repeated, with null ids) have the same
    result as on their own; an empty table gives an empty one. Other columns are not read.
    """
    known, rules = sentences or SENTENCES, rules or RULES
    to_id = {text: name for name, text in known.items()}
    longest = sorted(to_id, key=lambda s: (-len(s), s))
    any_known = "|".join(r"[ |]".join(map(re.escape, s.split())) for s in longest)
    found = F.regexp_extract_all(_pieces(F.col(text_col)), F.lit(rf"(?<=\|)(?:{any_known})(?=\|)"), F.lit(0))
    if sentences is None:
        found = F.when(F.lower(F.col(text_col)).rlike(HINT), found).otherwise(F.array().cast("array<string>"))
    lookup = F.create_map(*[F.lit(x) for pair in to_id.items() for x in pair])
    ids = F.transform(found, lambda s: F.element_at(lookup, F.translate(s, "|", " ")))
    out = docs.select(F.col(id_col), F.array_join(ids, ",").alias("sentence_ids"))
    padded = F.concat(F.lit(","), F.col("sentence_ids"), F.lit(","))
    hits = F.array(
        *[
            F.when(
                F.contains(padded, F.lit("," + ",".join(seq) + ",")),
                F.struct(F.lit(name).alias("rule"), F.lit(lic).alias("license"), F.lit(kind).alias("kind")),
            )
            for name, lic, kind, seq in rules
        ]
    )
    hits = F.filter(hits, lambda h: h.isNotNull())
    kinds = F.transform(F.col("hits"), lambda h: h["kind"])
    strictest = F.lit(None).cast("string")
    for kind in ("permissive", "copyleft", "restricted"):
        strictest = F.when(F.array_contains(kinds, kind), kind).otherwise(strictest)
    return out.withColumn("hits", hits).select(
        id_col,
        "sentence_ids",
        F.array_join(F.transform("hits", lambda h: h["rule"]), ",").alias("rules"),
        F.array_join(F.array_distinct(F.transform("hits", lambda h: h["license"])), ",").alias("licenses"),
        strictest.alias("license_class"),
    )
