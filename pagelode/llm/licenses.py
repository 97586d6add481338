"""License scans: ordered signature rules behind a keyword prefilter."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean, sliced, table, texts


class Rule(NamedTuple):
    label: str
    keywords: tuple[bytes, ...]
    pattern: str
    priority: int
    score: float


#: Name, the words that say it, and versions (with what a version stands for).
_FAMILIES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("mit", "mit|expat", ()),
    ("apache", "apache(?: software)?", ("1.0", "1.1", "2.0")),
    ("gpl", "(?:gnu )?general public|(?:gnu )?gpl", ("1", "2", "3")),
    ("lgpl", "(?:gnu )?(?:lesser|library) general public|(?:gnu )?lgpl", ("2", "2.1", "3")),
    ("agpl", "(?:gnu )?affero general public|(?:gnu )?agpl", ("1", "3")),
    ("gfdl", "(?:gnu )?free documentation|gfdl", ("1.1", "1.2", "1.3")),
    ("bsd", "bsd|berkeley software distribution", ("2 clause", "3 clause", "4 clause", "0 clause")),
    ("mpl", "mozilla public|mpl", ("1.0", "1.1", "2.0")),
    ("epl", "eclipse public|epl", ("1.0", "2.0")),
    ("cddl", "common development and distribution|cddl", ("1.0", "1.1")),
    ("cpl", "common public", ("1.0",)),
    ("eupl", "european union public|eupl", ("1.0", "1.1", "1.2")),
    ("osl", "open software", ("1.0", "2.0", "2.1", "3.0")),
    ("afl", "academic free", ("1.2", "2.0", "2.1", "3.0")),
    ("artistic", "artistic|perl artistic", ("1.0", "2.0")),
    ("zlib", "zlib|zlib libpng|libpng", ("2",)),
    ("isc", "isc|internet systems consortium", ()),
    ("boost", "boost(?: software)?|bsl", ("1.0",)),
    ("unlicense", "unlicense|unlicence", ()),
    ("wtfpl", "wtfpl|do what the fuck you want to public", ("2",)),
    ("ofl", "sil open font|open font|ofl", ("1.0", "1.1")),
    ("cc0", "cc0|creative commons zero", ("1.0",)),
    ("odbl", "open database|odbl", ("1.0",)),
    ("odc-by", "open data commons attribution", ("1.0",)),
    ("ms-pl", "microsoft public", ()),
    ("ms-rl", "microsoft reciprocal", ()),
    ("python", "python software foundation|psf", ("2",)),
    ("php", "php", ("3.0", "3.01")),
    ("postgresql", "postgresql", ()),
    ("openssl", "openssl", ()),
    ("vim", "vim", ()),
    ("ruby", "ruby", ()),
    ("w3c", "w3c(?: software)?", ()),
    ("x11", "x11|x consortium", ()),
    ("qpl", "q public|qpl", ("1.0",)),
    ("sleepycat", "sleepycat", ()),
    ("ncsa", "university of illinois(?: ncsa)?|ncsa", ()),
    ("upl", "universal permissive|upl", ("1.0",)),
    ("cecill", "cecill", ("1.0", "2.0", "2.1")),
    ("mulan", "mulan permissive(?: software)?", ("1", "2")),
    ("bsl-business", "business source", ("1.1",)),
    ("sspl", "server side public|sspl", ("1",)),
    ("elastic", "elastic", ("2.0",)),
    ("openrail", "openrail|responsible ai", ()),
    ("llama", "llama(?: 2| 3)? community", ()),
)
#: Creative Commons conditions: label and the words for it.
_CC: tuple[tuple[str, str], ...] = (
    ("cc-by", "by|attribution"),
    ("cc-by-sa", "by sa|attribution share ?alike"),
    ("cc-by-nd", "by nd|attribution no ?deriv(?:ative)?s?(?: works)?"),
    ("cc-by-nc", "by nc|attribution non ?commercial"),
    ("cc-by-nc-sa", "by nc sa|attribution non ?commercial share ?alike"),
    ("cc-by-nc-nd", "by nc nd|attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"),
)
#: Sentences of licence texts and notices; words as the scan's normal form has them.
_SENTENCES: tuple[tuple[str, str, str], ...] = (
    ("mit", "free of charge", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "sublicense", "to use copy modify merge publish distribute sublicense and or sell copies"),
    ("isc", "fee is hereby granted", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification"),
    ("bsd", "endorse or promote", "may be used to endorse or promote products derived from this software"),
    ("apache", "compliance with the license", "you may not use this file except in compliance with the license"),
    ("gpl", "redistribute it and", "you can redistribute it and or modify it under the terms of the (?:gnu )?general public"),
    ("lgpl", "redistribute it and", "you can redistribute it and or modify it under the terms of the (?:gnu )?(?:lesser|library) general public"),
    ("zlib", "as is", "this software is provided as is without any express or implied warranty in no event"),
    ("unlicense", "public domain", "this is free and unencumbered software released into the public domain"),
    ("public-domain", "public domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", "public domain", "(?:is|are) in the public domain"),
    ("boost", "free of charge", "permission is hereby granted free of charge to any person or organization"),
    ("proprietary", "confidential", "(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "prohibited", "unauthori[sz]ed (?:copying|use|distribution|reproduction)(?: [a-z]+){0,12} prohibited"),
    ("all-rights-reserved", "reserved", "all rights reserved"),
    ("copyright", "copyright", "copyright (?:c )?[0-9]{4}"),
    ("warranty", "warranty", "without warranty of any kind express or implied"),
    ("warranty", "as is", "provided (?:on an )?as is (?:basis )?without"),
    ("eula", "end user", "end user licen[cs]e agreement"),
    # Bodies and notices of single licences.
    ("mit", "copies or substantial", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "noninfringement in no event", "the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable"),
    ("mit", "deal in the software", "to deal in the software without restriction including without limitation the rights to use copy modify"),
    ("mit-0", "of the software and to permit", "and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided"),
    ("x11", "name of the x consortium", "except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("x11", "in advertising or otherwise", "shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization"),
    ("isc", "isc disclaims all", "isc disclaims all warranties with regard to this software"),
    ("isc", "author disclaims all", "the author disclaims all warranties with regard to this software including all implied warranties"),
    ("bsd", "redistributions of source code must retain", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form", "redistributions in binary form must reproduce the above copyright notice this list of conditions"),
    ("bsd-3-clause", "neither the name", "neither the name of (?:the )?(?:[a-z0-9]+ ){1,8}nor the names of its contributors may be used to endorse"),
    ("bsd-4-clause", "all advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsd", "regents and contributors", "this software is provided by the regents and contributors as is"),
    ("bsd", "copyright holders and contributors", "this software is provided by the copyright holders and contributors as is and any express or implied warranties"),
    ("bsd-0-clause", "with or without fee is hereby", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("bsd-patent", "hereby grants to each recipient", "each copyright holder and contributor hereby grants to each recipient a perpetual worldwide non exclusive no charge royalty free irrevocable"),
    ("apache-2.0", "apache license version", "apache license version 2 0 january 2004"),
    ("apache-2.0", "you may obtain a copy", "you may obtain a copy of the license at (?:https? )?(?:www )?apache org licenses license 2 0"),
    ("apache-2.0", "governing permissions and limitations", "see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2.0", "grant of copyright license", "grant of copyright license subject to the terms and conditions of this license each contributor hereby grants to you"),
    ("apache-2.0", "grant of patent license", "grant of patent license subject to the terms and conditions of this license each contributor hereby grants to you"),
    ("apache-2.0", "direct or contributory", "constitutes direct or contributory patent infringement then any patent licenses granted to you under this license"),
    ("apache-1.1", "apache software foundation", "this product includes software developed by the apache software foundation"),
    ("apache-1.1", "the names apache", "the names apache and apache software foundation must not be used to endorse or promote products"),
    ("gpl", "everyone is permitted to copy", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl-2", "version 2 june 1991", "gnu general public license version 2 june 1991"),
    ("gpl-3", "version 3 29 june 2007", "gnu general public license version 3 29 june 2007"),
    ("gpl-2", "version 2 of the license", "published by the free software foundation (?:either )?version 2 of the license"),
    ("gpl-3", "version 3 of the license", "published by the free software foundation (?:either )?version 3 of the license"),
    ("gpl", "you should have received a copy", "you should have received a copy of the gnu general public license along with this (?:program|file|library|software)"),
    ("gpl", "general public license is a free", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl", "to take away your freedom", "the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl", "complete corresponding machine", "accompany it with the complete corresponding machine readable source code"),
    ("gpl", "anti circumvention law", "protecting users legal rights from anti circumvention law"),
    ("lgpl", "you should have received a copy", "you should have received a copy of the gnu (?:lesser|library) general public license along with this"),
    ("lgpl-2.1", "version 2 1 february 1999", "gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-3", "incorporates the terms and conditions", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3"),
    ("lgpl", "work that uses the library", "such a work in isolation is called a work that uses the library|a work that uses the library"),
    ("agpl-3", "version 3 19 november 2007", "gnu affero general public license version 3 19 november 2007"),
    ("agpl", "you should have received a copy", "you should have received a copy of the gnu affero general public license along with this"),
    ("agpl", "remotely through a computer network", "all users interacting with it remotely through a computer network"),
    ("gpl-exception", "special exception", "as a special exception (?:[a-z0-9]+ ){0,12}permission to link"),
    ("gpl-classpath-exception", "making a combined work", "linking this library statically or dynamically with other modules is making a combined work based on this library"),
    ("gpl-classpath-exception", "independent modules", "to link this library with independent modules to produce an executable"),
    ("gcc-exception", "runtime library exception", "gcc runtime library exception"),
    ("gfdl", "invariant sections", "with no invariant sections no front cover texts and no back cover texts"),
    ("gfdl", "permission is granted to copy distribute", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-1.1", "contents of this file are subject", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2.0", "source code form is subject", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "mpl was not distributed", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-2.0", "incompatible with secondary", "this source code form is incompatible with secondary licenses as defined by the mozilla public license"),
    ("epl-1.0", "accompanying program is provided", "the accompanying program is provided under the terms of this eclipse public license agreement"),
    ("epl", "accompanying materials are made", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cpl-1.0", "common public license", "the accompanying program is provided under the terms of this common public license agreement"),
    ("cddl-1.0", "cddl header start", "cddl header start"),
    ("cddl-1.0", "common development and distribution", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("npl", "netscape public license", "the contents of this file are subject to the netscape public license"),
    ("ipl", "ibm public license", "the accompanying program is provided under the terms of this ibm public license"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "altered source versions", "altered source versions must be plainly marked as such and must not be misrepresented"),
    ("libpng", "png reference library", "the png reference library is supplied as is"),
    ("boost-1.0", "boost software license", "distributed under the boost software license version 1 0"),
    ("boost-1.0", "machine executable object code", "solely in the form of machine executable object code generated by a source language processor"),
    ("unlicense", "anyone is free to copy", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("unlicense", "dedicate any and all copyright", "dedicate any and all copyright interest in the software to the public domain"),
    ("cc0-1.0", "waive", "to the greatest extent permitted by (?:but not in contravention of )?applicable law affirmer hereby overtly fully permanently irrevocably and unconditionally waives"),
    ("cc0-1.0", "neighboring rights", "has waived all copyright and related (?:or|and) neighboring rights"),
    ("cc-by", "this work is licensed under", "this work is licensed under (?:a|the) creative commons attribution (?:[0-9] [0-9] )?(?:international |unported )?licen[cs]e"),
    ("cc-by-sa", "this work is licensed under", "this work is licensed under (?:a|the) creative commons attribution share ?alike (?:[0-9] [0-9] )?(?:international |unported )?licen[cs]e"),
    ("cc-by-nc", "this work is licensed under", "this work is licensed under (?:a|the) creative commons attribution non ?commercial (?:[0-9] [0-9] )?(?:international |unported )?licen[cs]e"),
    ("cc-by", "creativecommons org licenses by", "creativecommons org licenses by [0-9] [0-9]"),
    ("cc-by-sa", "creativecommons org licenses by sa", "creativecommons org licenses by sa [0-9] [0-9]"),
    ("cc-by-nc", "creativecommons org licenses by nc", "creativecommons org licenses by nc [0-9] [0-9]"),
    ("cc-by-nd", "creativecommons org licenses by nd", "creativecommons org licenses by nd [0-9] [0-9]"),
    ("cc-by-nc-sa", "creativecommons org licenses by nc sa", "creativecommons org licenses by nc sa [0-9] [0-9]"),
    ("cc-by-nc-nd", "creativecommons org licenses by nc nd", "creativecommons org licenses by nc nd [0-9] [0-9]"),
    ("cc0-1.0", "creativecommons org publicdomain zero", "creativecommons org publicdomain zero 1 0"),
    ("cc-by", "you must give appropriate credit", "you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("cc-by-nc", "primarily intended for", "primarily intended for or directed towards? commercial advantage or (?:private )?monetary compensation"),
    ("wtfpl-2", "what the fuck you want", "you just do what the fuck you want to"),
    ("artistic-1.0", "artistic control", "the copyright holder maintains some semblance of artistic control over the development of the package"),
    ("artistic-2.0", "artistic license 2", "the artistic license 2 0 copyright"),
    ("perl", "same terms as perl", "(?:you can|you may) redistribute it and or modify it under the same terms as perl itself"),
    ("ofl-1.1", "reserved font name", "with reserved font names?"),
    ("ofl-1.1", "font software is licensed", "this font software is licensed under the sil open font license version 1 1"),
    ("python", "psf hereby grants", "psf hereby grants licensee a non ?exclusive royalty free world wide license"),
    ("python", "stichting mathematisch", "copyright (?:c )?(?:[0-9 ]+)?stichting mathematisch centrum"),
    ("php-3.01", "this product includes php", "this product includes php software freely available from"),
    ("openssl", "openssl toolkit", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", "eric young", "this product includes (?:cryptographic )?software written by eric young"),
    ("w3c", "w3c software notice", "w3c software notice and license"),
    ("postgresql", "postgresql database management", "postgresql database management system"),
    ("postgresql", "without a written agreement", "without fee and without a written agreement is hereby granted"),
    ("ncsa", "to deal with the software", "developed by (?:[a-z0-9]+ ){1,8}permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software"),
    ("w3c", "world wide web consortium", "world wide web consortium (?:[a-z0-9]+ ){1,16}all rights reserved"),
    ("ruby", "either the terms of the", "you can redistribute it and or modify it under either the terms of the (?:gpl|2 clause bsdl)"),
    ("vim", "vim is charityware", "vim is charityware"),
    ("json", "for good not evil", "the software shall be used for good not evil"),
    ("beerware", "beer in return", "you can buy me a beer in return"),
    ("sleepycat", "must be accompanied by", "redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("curl", "permission to use copy modify and distribute this software", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("hpnd", "in supporting documentation", "that both that copyright notice and this permission notice appear in supporting documentation"),
    ("bzip2", "library libbzip2", "this program bzip2 the associated library libbzip2"),
    ("sspl-1", "to third parties as a service", "functionality of the program or a modified version available to third parties as a service"),
    ("elastic-2.0", "hosted or managed service", "you may not provide the software to third parties as a hosted or managed service"),
    ("bsl-business-1.1", "change license", "change date (?:[a-z0-9]+ ){1,6}change license"),
    ("commons-clause", "commons clause", "commons clause license condition"),
    ("openrail", "use based restrictions", "use based restrictions as referenced in paragraph"),
    ("openrail", "agree not to use the model", "use restrictions you agree not to use the model"),
    ("odbl-1.0", "open database licen", "is made available under the open database licen[cs]e"),
    ("ogl", "open government licen", "(?:contains public sector information )?licensed under the open government licen[cs]e"),
    ("us-government", " government", "work of the (?:united states|u s) government"),
    ("proprietary", "trade secret", "contains (?:confidential and )?(?:proprietary information and )?trade secrets of"),
    ("proprietary", "may not be", "this (?:document|software|file|material) may not be (?:copied|reproduced|distributed)"),
    ("proprietary", "prior written", "without (?:the )?(?:express )?prior written (?:permission|consent) of"),
    ("eula", "by installing", "by installing (?:copying )?(?:or otherwise using |or using )?(?:this|the) software you agree to be bound"),
    ("noncommercial", "commercial use only", "for non ?commercial use only"),
    ("noncommercial", "commercial purposes only", "(?:for )?(?:research|academic|educational|personal)(?: and| or)? non ?commercial purposes only"),
    ("shareware", "shareware", "this (?:program|software) is shareware"),
    ("freeware", "freeware", "this (?:program|software) is freeware"),
    ("warranty", "without any warranty", "in the hope that it will be useful but without any warranty"),
    ("warranty", "consequential damages", "(?:direct )?indirect incidental special exemplary or consequential damages"),
    ("warranty", "merchantability", "warranties of merchantability and fitness for a particular purpose"),
)
#: The contract's phrases and labels; they are always reported.
BASE: tuple[tuple[str, str], ...] = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


def _names(names: str) -> tuple[bytes, ...]:
    """Of each name of a family the longest part that stands in all its forms."""
    parts = [re.split(r"\(\?:[^)]*\)\??", name) for name in re.split(r"\|(?![^(]*\))", names)]
    return tuple(max(p, key=len).strip().encode() for p in parts)


def rules() -> list[Rule]:
    """Ordered by priority, then as written. Each pattern runs over words joined by one space.

    Every family has rules for its name with a version, its name alone, a notice ("licensed under"), and an SPDX line."""
    out = []
    licence = "licen[cs]e"
    for label, names, versions in _FAMILIES:
        # A keyword stands in every text that a pattern matches: the licence word, or a name where that word is optional.
        for version in versions:
            # Each version is a rule of its own, so that the label names it.
            v = version.replace(".", " ")
            out.append(Rule(f"{label}-{version.replace(' ', '-')}", _names(names), rf"(?:{names})(?: public)?(?: {licence})?(?: version| v)? ?{v}(?: or later| only)?(?= |$)", 90, 0.95))
            out.append(Rule(f"{label}-{version.replace(' ', '-')}", (b"spdx",), rf"spdx {licence} identifier (?:{names}) {v}(?: or later| only)?(?= |$)", 100, 1.0))
        out.append(Rule(label, (b"spdx",), rf"spdx {licence} identifier (?:{names})(?= |$)", 98, 1.0))
        out.append(Rule(label, (b"licen",), rf"(?:re)?licen[cs]ed under (?:the )?(?:terms of the )?(?:{names})(?: {licence})?(?= |$)", 80, 0.95))
        out.append(Rule(label, (b"licen",), rf"released under (?:the )?(?:terms of the )?(?:{names}) {licence}(?= |$)", 80, 0.95))
        out.append(Rule(label, (b"licen",), rf"(?:{names}) {licence}(?= |$)", 60, 0.85))
    for label, names in _CC:
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            out.append(Rule(f"{label}-{version}", (b" cc ",), rf"cc (?:{names}) {version.replace('.', ' ')}(?= |$)", 85, 0.95))
            out.append(Rule(f"{label}-{version}", (b"creative",), rf"creative commons (?:{names})(?: {version.replace('.', ' ')}| {licence} {version.replace('.', ' ')}|(?: [a-z]+)? {version.replace('.', ' ')}(?: international)?)(?= |$)", 85, 0.95))
        out.append(Rule(label, (b" cc ",), rf"cc (?:{names})(?= |$)", 55, 0.8))
        out.append(Rule(label, (b"creative",), rf"creative commons (?:{names})(?= |$)", 55, 0.8))
    for label, keyword, sentence in _SENTENCES:
        out.append(Rule(label, (keyword.encode(),), rf"(?:{sentence})(?= |$)", 30 if label in ("copyright", "warranty", "all-rights-reserved") else 70, 0.5 if label in ("copyright", "warranty", "all-rights-reserved") else 0.9))
    return sorted(out, key=lambda r: -r.priority)


#: Bytes of UTF-8 that are parts of words, A-Z lower-cased; all others become a space.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Covered:
    """Intervals, of which none lies within another: by their starts, their ends rise too."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def has(self, a: int, b: int) -> bool:
        """Whether [a, b) lies within one of them."""
        k = bisect_right(self.starts, a)
        return k > 0 and self.ends[k - 1] >= b

    def add(self, a: int, b: int) -> None:
        """Adds an interval that lies in none; those within it go."""
        k = bisect_left(self.starts, a)
        z = bisect_right(self.ends, b, k)
        self.starts[k:z], self.ends[k:z] = [a], [b]


class Scanner:
    def __init__(self):
        import ahocorasick

        self.rules = [(r, re.compile(b"(?<![^ ])" + r.pattern.encode())) for r in rules()]
        self.by_keyword: dict[str, list[int]] = {}
        for k, (r, _) in enumerate(self.rules):
            for word in r.keywords:
                self.by_keyword.setdefault(word.decode(), []).append(k)
        self.keywords = ahocorasick.Automaton()
        for word in self.by_keyword:
            self.keywords.add_word(word, word)
        self.keywords.make_automaton()
        self.base = [(re.compile(b"(?<![^ ])" + p.encode() + b"(?![^ ])"), label) for p, label in BASE]

    def scan(self, text: str) -> tuple:
        """(words, places, first, last, base labels, labels, score, findings) of a text."""
        words = text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()
        joined = b" ".join(words)
        seen = {word for _, word in self.keywords.iter(f" {joined.decode('latin-1')} ")}
        if not seen:  # the base phrases have a keyword too
            return len(words), 0, None, None, "", "", 0.0, []
        due = sorted({k for word in seen for k in self.by_keyword[word]})
        found: list[tuple[int, int, Rule]] = []
        covered = Covered()
        for k in due:
            rule, pattern = self.rules[k]
            for m in pattern.finditer(joined):
                a, b = m.span()
                # Rules come by priority: what lies within an earlier finding is suppressed.
                if not covered.has(a, b):
                    covered.add(a, b)
                    found.append((a, b, rule))
        blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        place = lambda at: int(np.searchsorted(blanks, at))  # noqa: E731  a place's word, from 0
        base = [(place(m.start()), label) for pattern, label in self.base for m in pattern.finditer(joined)]
        base_labels = {label for _, label in base}
        starts = [x for x, _ in base]
        labels = sorted(base_labels | {r.label for *_, r in found})
        score = max([r.score for *_, r in found] + [0.85] * bool(base), default=0.0)
        findings = [{"label": r.label, "first_word": place(a), "last_word": place(b - 1), "score": r.score} for a, b, r in sorted(found, key=lambda f: f[:2])]
        return len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)), ",".join(labels), score, findings


def scan_licenses(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), findings: bool = True) -> DataFrame:
    """keep's columns with n_words, n_base, first_word, last_word, base_labels, labels, score, and findings.

    A text is read whole, as words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased, joined by one space. Rules whose
    keyword occurs run in order of priority; a finding within a finding of an earlier rule is suppressed.
    Base phrases are reported at all their places whatever else is found. Null and empty texts have no words, no
    labels and score 0. Rows are independent: repeated rows and ids, ties and other columns do no harm. An empty
    table gives an empty table."""
    kept = docs.select(*keep).schema
    kind = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("score", pa.float64())]))
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), kind]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "findings"]
    width = 8 if findings else 7

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for b in sliced(batches, "_text"):
            got = [scanner.scan(t) for t in texts(b, "_text")]
            made = [pa.array([x[k] for x in got], types[k]) for k in range(width)]
            yield pa.RecordBatch.from_arrays([b.column(k) for k in range(len(keep))] + made, [*keep, *names[:width]])

    ddl = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["n_words bigint", "n_base bigint", "first_word bigint", "last_word bigint", "base_labels string", "labels string", "score double", "findings array<struct<label:string,first_word:bigint,last_word:bigint,score:double>>"][:width]
    return docs.selectExpr(*[f"`{c}`" for c in keep], "text AS _text").mapInArrow(lean(scan), ", ".join(ddl))


def op4_licenses(spark, sf_dir: str) -> DataFrame:
    """Licence phrases and labels of every document."""
    return scan_licenses(table(spark, sf_dir, "documents"), findings=False)
