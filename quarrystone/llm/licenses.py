"""Licence scan by sentence rules (native).

*Sentences.* A text is cut at stops, question and exclamation marks, colons and semicolons
before white space or the end, and at blank lines, which may hold comment signs. A single line end cuts nothing: wrapped
lines are joined. What is cut is normalised (A-Z lower-cased, everything but letters and digits made one space).

*Identifiers.* Each sentence is looked up among the known ones, whole. Notices stand in code and
in running text without a stop before them, so it is also looked up from each line's beginning to
its end, for the last ``TAIL`` lines, and failing that each of its lines by itself.

*Rules.* The identifiers of a text, in order, are matched against ordered rules: a rule is a
sequence of identifiers, some optional, which must follow each other with no other *known*
sentence between them. The longest rule at a place wins. A rule may name no licence: it then takes up
what is only an instruction, such as how a licence's own text says it should be applied.

The catalogue is a constant of the module, so the map and the rules travel inside
the plan and no row leaves its task: the scan is one projection.

Defined cases: a null or empty text has no sentences and no licence; a sentence
or rule that occurs several times counts each time but a licence is listed once,
in order of first occurrence; known sentences that fit no rule are kept in ``sentence_ids`` only;
comment signs at the beginnings of lines (#, //, *, ;) do not count, as they normalise to nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.common import text_or_empty

_GPL = "you can redistribute it and/or modify it under the terms of the GNU {} Public License"
_FSF = " as published by the Free Software Foundation"
_LATER = "either version {} of the License, or (at your option) any later version"
_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
_GRANT_ALL = _GRANT + ", including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED"
_ISC = "Permission to use, copy, modify, and{} distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"
_ENDORSE = "{} may be used to endorse or promote products derived from this software without specific prior written permission"
_HOLDERS = "THIS SOFTWARE IS PROVIDED BY {} \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED"
_LIABLE = "IN NO EVENT SHALL {} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES"
_NAMES = ["THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE COPYRIGHT HOLDER AND CONTRIBUTORS", "THE AUTHOR AND CONTRIBUTORS", "THE REGENTS AND CONTRIBUTORS", "THE AUTHOR"]
_OWNERS = ["THE COPYRIGHT HOLDER OR CONTRIBUTORS", "THE COPYRIGHT OWNER OR CONTRIBUTORS", "THE COPYRIGHT HOLDERS OR CONTRIBUTORS", "THE AUTHOR OR CONTRIBUTORS", "THE REGENTS OR CONTRIBUTORS", "THE AUTHOR"]
_REFERRED = ["Licensed under {}", "Released under {}", "Distributed under {}", "This work is licensed under {}", "This project is licensed under {}", "This software is licensed under {}", "This program is licensed under {}", "This file is licensed under {}", "{}"]


def _refer(*names: str) -> list[str]:
    """The ways in which a text refers to a licence by one of its names."""
    return [form.format(n) for form in _REFERRED for n in names]


def _cc(kind: str, name: str, version: str) -> list[str]:
    whole = f"Creative Commons {name} {version} International"
    return _refer(f"CC {kind} {version}", f"a {whole} License", f"the {whole} License", f"{whole} License", f"a {whole} Licence")


#: Identifier -> known sentences, as their licences write them. None has an end inside.
SENTENCES: dict[str, list[str]] = {
    "apache2-ref": _refer("the Apache License, Version 2.0", "the Apache License 2.0", "Apache License 2.0", "Apache-2.0") + ["Licensed under the Apache License, Version 2.0 (the \"License\")"],
    "apache2-comply": ["you may not use this file except in compliance with the License"],
    "apache2-obtain": ["You may obtain a copy of the License at", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"],
    "as-is-law": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"],
    "apache2-see": ["See the License for the specific language governing permissions and limitations under the License"],
    "apache-title": ["Apache License"],
    "apache2-date": ["Version 2.0, January 2004", "Version 2.0, January 2004 http://www.apache.org/licenses/", "Apache License Version 2.0, January 2004", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"],
    "apache2-apply": ["To apply the Apache License to your work, attach the following boilerplate notice, with the fields enclosed by brackets \"[]\" replaced with your own identifying information"],
    "mit-title": ["MIT License", "The MIT License", "The MIT License (MIT)", "The MIT license"],
    "mit-ref": [x for x in _refer("the MIT License", "the MIT licence", "the terms of the MIT license", "MIT License") if x not in ("MIT License", "the MIT License")],
    "mit-grant": [_GRANT, _GRANT_ALL],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software"],
    "as-is-software": [_AS_IS, "THE SOFTWARE IS PROVIDED \"AS IS\"", _AS_IS + ", INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"],
    "mit-liable": [
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    ],
    "isc-title": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "isc-grant": [_ISC.format("/or"), _ISC.format("")],
    "zero-bsd-title": ["BSD Zero Clause License", "Zero-Clause BSD", "Zero Clause BSD License"],
    "zero-bsd-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "isc-warranty": [
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND ISC DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS",
    ],
    "isc-liable": [
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE",
    ],
    "bsd-title": ["BSD License", "BSD 2-Clause License", "BSD 3-Clause License", "The BSD License"],
    "bsd2-ref": _refer("the BSD 2-Clause License", "BSD-2-Clause", "the Simplified BSD License"),
    "bsd3-ref": _refer("the BSD 3-Clause License", "BSD-3-Clause", "the New BSD License"),
    "bsd-redistribute": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-advertise": ["All advertising materials mentioning features or use of this software must display the following acknowledgement"],
    "bsd-endorse": [_ENDORSE.format(f"Neither the name of {x} nor the names of its contributors") for x in ("the copyright holder", "the University", "the copyright holders", "the organization", "the <organization>")] + [_ENDORSE.format("The names of its contributors"), _ENDORSE.format("The name of the author")],
    "bsd-disclaimer": [_HOLDERS.format(x) for x in _NAMES],
    "bsd-liable": [_LIABLE.format(x) for x in _OWNERS],
    "gpl-title": ["GNU GENERAL PUBLIC LICENSE"],
    "lgpl-title": ["GNU LESSER GENERAL PUBLIC LICENSE", "GNU LIBRARY GENERAL PUBLIC LICENSE"],
    "agpl-title": ["GNU AFFERO GENERAL PUBLIC LICENSE"],
    "gpl2-date": ["Version 2, June 1991", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "gpl3-date": ["Version 3, 29 June 2007", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "lgpl21-date": ["Version 2.1, February 1999", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "lgpl3-date": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "agpl3-date": ["Version 3, 19 November 2007", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "gnu-copies": ["Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed"],
    "gnu-apply": ["How to Apply These Terms to Your New Programs", "How to Apply These Terms to Your New Libraries"],
    "gnu-attach": ["To do so, attach the following notices to the program", "To apply these terms, attach the following notices to the library"],
    "free-software": [f"This {x} is free software" for x in ("program", "library", "file", "software", "package")],
    "gpl-terms": [_GPL.format("General") + _FSF],
    "lgpl-terms": [_GPL.format("Lesser General") + _FSF, _GPL.format("Library General") + _FSF],
    "agpl-terms": [_GPL.format("Affero General") + _FSF],
    "v2-later": [_LATER.format("2"), "either version 2, or (at your option) any later version"],
    "v21-later": [_LATER.format("2.1")],
    "v3-later": [_LATER.format("3"), "either version 3, or (at your option) any later version"],
    "v2-only": ["version 2 of the License", "version 2"],
    "v21-only": ["version 2.1 of the License"],
    "v3-only": ["version 3 of the License", "version 3"],
    "gpl2-or-later": [f"{_GPL.format('General')}{_FSF}, {_LATER.format('2')}"],
    "gpl3-or-later": [f"{_GPL.format('General')}{_FSF}, {_LATER.format('3')}"],
    "lgpl21-or-later": [f"{_GPL.format('Lesser General')}{_FSF}, {_LATER.format('2.1')}"],
    "lgpl3-or-later": [f"{_GPL.format('Lesser General')}{_FSF}, {_LATER.format('3')}"],
    "agpl3-or-later": [f"{_GPL.format('Affero General')}{_FSF}, {_LATER.format('3')}"],
    "gpl2-only": [f"{_GPL.format('General')} version 2{_FSF}", f"{_GPL.format('General')} version 2 as published by the Free Software Foundation", f"{_GPL.format('General')}{_FSF}, version 2", f"{_GPL.format('General')}{_FSF}, version 2 of the License"],
    "gpl3-only": [f"{_GPL.format('General')} version 3{_FSF}", f"{_GPL.format('General')}{_FSF}, version 3", f"{_GPL.format('General')}{_FSF}, version 3 of the License"],
    "gpl-hope": [f"This {x} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY" for x in ("program", "library", "software", "file", "package")],
    "gpl-implied": ["without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "gpl-see": [f"See the GNU {x} Public License for more details" for x in ("General", "Lesser General", "Library General", "Affero General")],
    "gpl-received": [f"You should have received a copy of the GNU {x} Public License along with this {y}" for x in ("General", "Lesser General", "Library General", "Affero General") for y in ("program", "library", "software", "file", "package")],
    "gpl3-ref": _refer("the GNU General Public License, version 3", "the GNU General Public License version 3", "the GNU General Public License v3.0", "the GNU GPL v3", "the GPLv3"),
    "gpl2-ref": _refer("the GNU General Public License, version 2", "the GNU General Public License version 2", "the GNU General Public License v2.0", "the GNU GPL v2", "the GPLv2"),
    "agpl3-ref": _refer("the GNU Affero General Public License, version 3", "the GNU Affero General Public License version 3", "the GNU Affero General Public License v3.0", "the GNU AGPL v3", "the AGPLv3"),
    "lgpl3-ref": _refer("the GNU Lesser General Public License, version 3", "the GNU Lesser General Public License version 3", "the GNU Lesser General Public License v3.0", "the LGPLv3"),
    "lgpl21-ref": _refer("the GNU Lesser General Public License, version 2.1", "the GNU Lesser General Public License version 2.1", "the GNU Lesser General Public License v2.1", "the LGPLv2.1"),
    "mpl2-header": ["This Source Code Form is subject to the terms of the Mozilla Public License, v 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0"],
    # 'v. 2.0' has an end before the number
    "mpl-header": ["This Source Code Form is subject to the terms of the Mozilla Public License, v"],
    "mpl2-title": ["Mozilla Public License Version 2.0", "Mozilla Public License, Version 2.0", "Mozilla Public License 2.0"],
    "mpl2-ref": _refer("the Mozilla Public License, Version 2.0", "the Mozilla Public License 2.0", "MPL-2.0"),
    "mpl2-obtain": ["If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"],
    "epl2-ref": _refer("the Eclipse Public License 2.0", "the Eclipse Public License, Version 2.0", "EPL-2.0") + ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which accompanies this distribution, and is available at https://www.eclipse.org/legal/epl-2.0/"],
    "epl1-ref": _refer("the Eclipse Public License 1.0", "the Eclipse Public License, Version 1.0", "EPL-1.0") + ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"],
    "epl-title": ["Eclipse Public License - v 2.0"],
    "cc-by-nc-nd-4": _cc("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives", "4.0"),
    "cc-by-nc-sa-4": _cc("BY-NC-SA", "Attribution-NonCommercial-ShareAlike", "4.0"),
    "cc-by-nc-4": _cc("BY-NC", "Attribution-NonCommercial", "4.0"),
    "cc-by-nd-4": _cc("BY-ND", "Attribution-NoDerivatives", "4.0"),
    "cc-by-sa-4": _cc("BY-SA", "Attribution-ShareAlike", "4.0"),
    "cc-by-4": _cc("BY", "Attribution", "4.0"),
    "cc0": _refer("CC0 1.0", "CC0-1.0", "CC0 1.0 Universal") + ["Dedicated to the public domain under CC0 1.0", "This work is dedicated to the public domain under CC0 1.0 Universal"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
    "bsl-title": ["Boost Software License - Version 1.0 - August 17th, 2003", "Boost Software License - Version 1.0"],
    "bsl-ref": ["Distributed under the Boost Software License, Version 1.0"],
    "zlib-warranty": ["This software is provided 'as-is', without any express or implied warranty"],
    "zlib-liable": ["In no event will the authors be held liable for any damages arising from the use of this software"],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "reserved": ["All rights reserved"],
}

_HOPE = ["gpl-hope?", "gpl-implied?", "gpl-see?", "gpl-received?"]
_BSD = ["bsd-title?", "bsd-redistribute", "bsd-source", "bsd-binary"]
_BSD_END = ["bsd-disclaimer?", "bsd-liable?"]

#: Licence (SPDX identifier; empty: none is granted) -> rules; "id?" is optional
RULES: list[tuple[str, list[str]]] = [
    ("Apache-2.0", ["apache2-ref", "apache2-comply?", "apache2-obtain?", "as-is-law?", "apache2-see?"]),
    ("Apache-2.0", ["apache2-comply", "apache2-obtain", "as-is-law?", "apache2-see?"]),
    ("Apache-2.0", ["apache-title?", "apache2-date"]),
    ("", ["apache2-apply", "apache2-ref", "apache2-comply?", "apache2-obtain?", "as-is-law?", "apache2-see?"]),
    ("MIT", ["mit-title?", "mit-grant", "mit-notice?", "as-is-software?", "mit-liable?"]),
    ("MIT", ["mit-ref"]),
    ("MIT", ["mit-title"]),
    ("ISC", ["isc-title?", "isc-grant", "isc-warranty?", "as-is-software?", "isc-liable?"]),
    ("ISC", ["isc-title"]),
    ("0BSD", ["zero-bsd-title?", "zero-bsd-grant", "isc-warranty?", "isc-liable?"]),
    ("0BSD", ["zero-bsd-title"]),
    ("BSD-4-Clause", [*_BSD, "bsd-advertise", "bsd-endorse?", *_BSD_END]),
    ("BSD-3-Clause", [*_BSD, "bsd-endorse", *_BSD_END]),
    ("BSD-2-Clause", [*_BSD, *_BSD_END]),
    ("BSD-3-Clause", ["bsd3-ref"]),
    ("BSD-2-Clause", ["bsd2-ref"]),
    ("GPL-2.0-only", ["gpl-title?", "gpl2-date", "gnu-copies?"]),
    ("GPL-3.0-only", ["gpl-title?", "gpl3-date", "gnu-copies?"]),
    ("LGPL-2.1-only", ["lgpl-title?", "lgpl21-date", "gnu-copies?"]),
    ("LGPL-3.0-only", ["lgpl-title", "gpl3-date", "gnu-copies?"]),
    ("LGPL-3.0-only", ["lgpl3-date", "gnu-copies?"]),
    ("AGPL-3.0-only", ["agpl-title?", "agpl3-date", "gnu-copies?"]),
    *[(lic, ["free-software?", *ids, *_HOPE]) for lic, ids in (
        ("GPL-2.0-or-later", ["gpl-terms", "v2-later"]), ("GPL-2.0-or-later", ["gpl2-or-later"]), ("GPL-3.0-or-later", ["gpl-terms", "v3-later"]), ("GPL-3.0-or-later", ["gpl3-or-later"]),
        ("GPL-2.0-only", ["gpl-terms", "v2-only"]), ("GPL-2.0-only", ["gpl2-only"]), ("GPL-3.0-only", ["gpl-terms", "v3-only"]), ("GPL-3.0-only", ["gpl3-only"]),
        ("LGPL-2.0-or-later", ["lgpl-terms", "v2-later"]), ("LGPL-2.1-or-later", ["lgpl-terms", "v21-later"]), ("LGPL-2.1-or-later", ["lgpl21-or-later"]), ("LGPL-2.1-only", ["lgpl-terms", "v21-only"]),
        ("LGPL-3.0-or-later", ["lgpl-terms", "v3-later"]), ("LGPL-3.0-or-later", ["lgpl3-or-later"]), ("LGPL-3.0-only", ["lgpl-terms", "v3-only"]),
        ("AGPL-3.0-or-later", ["agpl-terms", "v3-later"]), ("AGPL-3.0-or-later", ["agpl3-or-later"]), ("AGPL-3.0-only", ["agpl-terms", "v3-only"]),
    )],
    # the end of a GNU licence's own text shows a notice: that one grants nothing
    *[("", ["gnu-apply", "gnu-attach?", "free-software?", *ids, *_HOPE]) for ids in (["gpl-terms", "v2-later"], ["gpl3-or-later"], ["gpl-terms", "v3-later"], ["lgpl-terms", "v21-later"], ["agpl3-or-later"])],
    *[(lic, [ref]) for lic, ref in (("GPL-3.0-only", "gpl3-ref"), ("GPL-2.0-only", "gpl2-ref"), ("AGPL-3.0-only", "agpl3-ref"), ("LGPL-3.0-only", "lgpl3-ref"), ("LGPL-2.1-only", "lgpl21-ref"))],
    ("MPL-2.0", ["mpl-header", "mpl2-obtain?"]),
    ("MPL-2.0", ["mpl2-header", "mpl2-obtain?"]),
    ("MPL-2.0", ["mpl2-title"]),
    ("MPL-2.0", ["mpl2-ref"]),
    ("EPL-2.0", ["epl2-ref"]),
    ("EPL-2.0", ["epl-title"]),
    ("EPL-1.0", ["epl1-ref"]),
    ("CC-BY-NC-ND-4.0", ["cc-by-nc-nd-4"]),
    ("CC-BY-NC-SA-4.0", ["cc-by-nc-sa-4"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4"]),
    ("CC-BY-ND-4.0", ["cc-by-nd-4"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4"]),
    ("CC-BY-4.0", ["cc-by-4"]),
    ("CC0-1.0", ["cc0"]),
    ("Unlicense", ["unlicense"]),
    ("BSL-1.0", ["bsl-title"]),
    ("BSL-1.0", ["bsl-ref"]),
    ("Zlib", ["zlib-warranty?", "zlib-liable?", "zlib-grant"]),
]

#: a text without any of these holds no known sentence; where one has a gap, normalising would make it one space
NEEDED = [
    "licen", "warrant", "permi", "redistribut", "reserved", "domain", "liable", "[al]?gpl", "mpl", "epl", "cc0", "cc[^a-z0-9]", "bsd", "apache", "free[^a-z0-9]+software",
    "version[^a-z0-9]+[123]", "apply[^a-z0-9]+these[^a-z0-9]+terms", "attach[^a-z0-9]+the", "advertising[^a-z0-9]+materials", "is[^a-z0-9]+provided",
]

#: ends of sentences: marks before white space or the text's end, and lines that are blank or hold comment signs only
ENDS = r"[.!?:;]+[ \t\r\n]+|[.!?:;]+\z|\n[ \t\r#*;/%-]*\n[ \t\r\n]*"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: lines before its end from which a sentence is looked up
TAIL = 40
#: a byte that no normalised text holds, for the ends of sentences
CUT = "\u0001"


def prefilter() -> str:
    """The pattern of ``NEEDED``, tried at the beginnings of words only."""
    return f"(?<![a-z0-9])(?:{'|'.join(NEEDED)})"


def _normal(s: str) -> str:
    """The same as ``normalised``, for the catalogue."""
    return " ".join("".join(c if c in LOWER + "0123456789" or ord(c) > 127 else " " for c in s.translate(str.maketrans(UPPER, LOWER))).split())


def catalogue() -> dict[str, str]:
    """Normalised sentence -> identifier; of identifiers that share a sentence the first has it."""
    out: dict[str, str] = {}
    for name, forms in SENTENCES.items():
        for form in forms:
            out.setdefault(_normal(form), name)
    return out


def normalised(text: Column) -> Column:
    """The text with sentences ended by ``CUT`` and lines by line ends, all else but letters and digits made one space."""
    cut = F.regexp_replace(F.translate(text, UPPER, LOWER), ENDS, CUT)
    return F.regexp_replace(cut, r"[\x00\x02-\x09\x0b-\x2f\x3a-\x60\x7b-\x7f]+", " ")


def identifiers(text: Column) -> Column:
    """The identifiers of the known sentences of a text, in order."""
    known = F.create_map(*[F.lit(x) for pair in catalogue().items() for x in pair])
    lines_of = lambda s: F.filter(F.transform(F.split(s, "\n"), lambda x: F.trim(x)), lambda x: x != "")

    def of(lines: Column) -> Column:
        n = F.size(lines)
        # from each of the last lines on to the end; the first of these that is known takes up all after it
        tails = F.transform(F.sequence(F.greatest(n - TAIL, F.lit(0)), n - 1), lambda i: F.struct(i.alias("i"), known[F.array_join(F.slice(lines, i + 1, n), " ")].alias("id")))
        hit = F.get(F.filter(tails, lambda x: x["id"].isNotNull()), 0)
        before = F.when(hit.isNull(), lines).otherwise(F.slice(lines, F.lit(1), hit["i"]))
        return F.filter(F.concat(F.transform(before, lambda x: known[x]), F.array(hit["id"])), lambda x: x.isNotNull())

    sentences = F.filter(F.transform(F.split(normalised(text), CUT), lines_of), lambda x: F.size(x) > 0)
    return F.flatten(F.transform(sentences, of))


def _rule_pattern(ids: list[str]) -> str:
    return "".join(f"(?:<{p[:-1]}>)?" if p.endswith("?") else f"<{p}>" for p in ids)


def pattern() -> str:
    """All rules as one pattern over identifiers, longest first."""
    return "|".join(f"({_rule_pattern(ids)})" for _, ids in ordered_rules())


def ordered_rules() -> list[tuple[str, list[str]]]:
    """Longer rules first (required sentences, then all), so that the first that fits at a place is the longest."""
    return sorted(RULES, key=lambda r: (-sum(not p.endswith("?") for p in r[1]), -len(r[1])))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, sentence_ids (in order), licenses (distinct, in order of first match), n_matches (of rules that name a licence)."""
    t = text_or_empty(F.col(text))
    none = F.array().cast("array<string>")
    likely = F.lower(t).rlike(prefilter())
    rows = docs.select("doc_id", F.when(likely, identifiers(t)).otherwise(none).alias("sentence_ids"))
    joined = F.concat(F.lit("<"), F.array_join("sentence_ids", "><"), F.lit(">"))
    found = F.when(F.size("sentence_ids") > 0, F.regexp_extract_all(joined, F.lit(pattern()), F.lit(0))).otherwise(none)

    def license_of(m: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, ids in reversed(ordered_rules()):
            out = F.when(m.rlike("^" + _rule_pattern(ids) + "$"), F.lit(name)).otherwise(out)
        return out

    rows = rows.withColumn("__named", F.filter(F.transform(found, license_of), lambda x: x != ""))
    return rows.select("doc_id", "sentence_ids", F.array_distinct("__named").alias("licenses"), F.size("__named").alias("n_matches"))
