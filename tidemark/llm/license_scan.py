"""License scans by ordered signature rules.

A rule is a hand-written pattern of words with a priority. A text meets a rule
only if a keyword prefilter (one Aho-Corasick pass over the longest word of
each rule) opens it and all of the rule's fixed words are in it; the pattern
is then tried wherever its first word stands. Overlapping detections are
resolved by priority and interval containment. All steps take time in
proportion to the text and its detections.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, sliced

# The base phrases and their labels, given by the contract.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# The rules of each kind: (priority, score, lines of a label and a pattern).
# In a pattern a space stands for what separates words; the first word is fixed.
SIGNATURES = (
    (90, 1.0, """
mit              spdx license identifier mit
mit-0            spdx license identifier mit 0
apache-2         spdx license identifier apache 2 0
apache-1.1       spdx license identifier apache 1 1
bsd-2-clause     spdx license identifier bsd 2 clause
bsd-3-clause     spdx license identifier bsd 3 clause
bsd-4-clause     spdx license identifier bsd 4 clause
0bsd             spdx license identifier 0bsd
isc              spdx license identifier isc
gpl-2            spdx license identifier gpl 2 0(?: only)?
gpl-2-plus       spdx license identifier gpl 2 0 or later
gpl-3            spdx license identifier gpl 3 0(?: only)?
gpl-3-plus       spdx license identifier gpl 3 0 or later
lgpl-2.1         spdx license identifier lgpl 2 1(?: only)?
lgpl-2.1-plus    spdx license identifier lgpl 2 1 or later
lgpl-3           spdx license identifier lgpl 3 0(?: only| or later)?
agpl-3           spdx license identifier agpl 3 0(?: only| or later)?
mpl-1.1          spdx license identifier mpl 1 1
mpl-2            spdx license identifier mpl 2 0
epl-1            spdx license identifier epl 1 0
epl-2            spdx license identifier epl 2 0
cddl-1           spdx license identifier cddl 1 [01]
eupl-1.2         spdx license identifier eupl 1 2
artistic-2       spdx license identifier artistic 2 0
zlib             spdx license identifier zlib
boost-1          spdx license identifier bsl 1 0
unlicense        spdx license identifier unlicense
wtfpl            spdx license identifier wtfpl
python-2         spdx license identifier (?:psf|python) 2 0
postgresql       spdx license identifier postgresql
ofl-1.1          spdx license identifier ofl 1 1
cc0-1            spdx license identifier cc0 1 0
cc-by            spdx license identifier cc by [1-4] [05]
cc-by-sa         spdx license identifier cc by sa [1-4] [05]
cc-by-nd         spdx license identifier cc by nd [1-4] [05]
cc-by-nc         spdx license identifier cc by nc [1-4] [05]
cc-by-nc-sa      spdx license identifier cc by nc sa [1-4] [05]
cc-by-nc-nd      spdx license identifier cc by nc nd [1-4] [05]
"""),
    (80, 0.95, """
mit              permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit              the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit              the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit-0            permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)? to deal in the software without restriction
isc              permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
0bsd             permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is
isc              the software is provided as is and the author disclaims all warranties with regard to this software
bsd              redistribution and use in source and binary forms with or without modification are permitted
bsd              redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd              redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd-3-clause     neither the name of [^\x00-\x1f]{1,120}? nor the names of its contributors may be used to endorse or promote products
bsd-4-clause     all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment
bsd              this software is provided by the (?:copyright holders and contributors|regents and contributors|author) as is and any express or implied warranties
apache-2         unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2         you may not use this file except in compliance with the license you may obtain a copy of the license at
apache-2         subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
apache-2         terms and conditions for use reproduction and distribution 1 definitions
apache-1.1       the end user documentation included with the redistribution if any must include the following acknowledg(?:e)?ment
gpl              this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl-2-plus       gnu general public license as published by the free software foundation either version 2 of the license or(?: at your option)? any later version
gpl-3-plus       gnu general public license as published by the free software foundation either version 3 of the license or(?: at your option)? any later version
gpl-2            gnu general public license version 2 as published by the free software foundation
gpl-3            gnu general public license version 3 as published by the free software foundation
gpl              this program is distributed in the hope that it will be useful but without any warranty
gpl              you should have received a copy of the gnu general public license along with this program
gpl              everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
lgpl             this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
lgpl             you should have received a copy of the gnu (?:lesser|library) general public license along with this library
lgpl-2.1-plus    gnu lesser general public license as published by the free software foundation either version 2 1 of the license or(?: at your option)? any later version
lgpl-3           gnu lesser general public license as published by the free software foundation either version 3 of the license
agpl-3           gnu affero general public license as published by the free software foundation either version 3 of the license
agpl-3           you should have received a copy of the gnu affero general public license
mpl-1.1          the contents of this file are subject to the mozilla public license version 1 1
mpl-2            this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2            if a copy of the mpl was not distributed with this file you can obtain one at
epl-1            this program and the accompanying materials are made available under the terms of the eclipse public license v1 0
epl-2            this program and the accompanying materials are made available under the terms of the eclipse public license 2 0
epl              the accompanying program is provided under the terms of this eclipse public license
cddl-1           the contents of this file are subject to the terms of the common development and distribution license
eupl-1.2         licensed under the eupl version 1 2 or as soon they will be approved by the european commission
artistic-2       everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble this license establishes the terms
artistic-1       the intent of this document is to state the conditions under which a package may be copied
zlib             this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib             altered source versions must be plainly marked as such and must not be misrepresented as being the original software
boost-1          permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
unlicense        this is free and unencumbered software released into the public domain
unlicense        anyone is free to copy modify publish use compile sell or distribute this software
wtfpl            do what the fuck you want to public license
wtfpl            you just do what the fuck you want to
python-2         psf is making python available to licensee on an as is basis
postgresql       permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
ofl-1.1          this font software is licensed under the sil open font license version 1 1
ofl-1.1          the font software may be sold as part of a larger software package but no copy of one or more of the font software typefaces may be sold by itself
cc0-1            the person who associated a work with this deed has dedicated the work to the public domain
cc0-1            to the extent possible under law [^\x00-\x1f]{1,120}? waived all copyright and related or neighboring rights
cc-by            you are free to share copy and redistribute the material in any medium or format
cc-by            you must give appropriate credit provide a link to the license and indicate if changes were made
cc-by-sa         if you remix transform or build upon the material you must distribute your contributions under the same license as the original
cc-by-nd         if you remix transform or build upon the material you may not distribute the modified material
cc-by-nc         you may not use the material for commercial purposes
ms-pl            this license governs use of the accompanying software if you use the software you accept this license
json             the software shall be used for good not evil
beerware         as long as you retain this notice you can do whatever you want with this stuff
x11              except as contained in this notice the name of [^\x00-\x1f]{1,120}? shall not be used in advertising or otherwise to promote the sale
ncsa             university of illinois ncsa open source license
openssl          this product includes software developed by the openssl project for use in the openssl toolkit
"""),
    (70, 0.9, """
mit              licensed under(?: the)?(?: terms of the)? (?:mit|expat)(?: x11)?(?: licen[sc]e)?
mit              released under(?: the)?(?: terms of the)? (?:mit|expat)(?: x11)?(?: licen[sc]e)?
mit              distributed under(?: the)?(?: terms of the)? (?:mit|expat)(?: x11)?(?: licen[sc]e)?
mit              available under(?: the)?(?: terms of the)? (?:mit|expat)(?: x11)?(?: licen[sc]e)?
mit              published under(?: the)?(?: terms of the)? (?:mit|expat)(?: x11)?(?: licen[sc]e)?
apache-2         licensed under(?: the)? apache(?: software)?(?: licen[sc]e)?(?: version| v)? ?(?:2|2 0)
apache-2         released under(?: the)? apache(?: software)?(?: licen[sc]e)?(?: version| v)? ?(?:2|2 0)
apache-2         distributed under(?: the)? apache(?: software)?(?: licen[sc]e)?(?: version| v)? ?(?:2|2 0)
apache-2         available under(?: the)? apache(?: software)?(?: licen[sc]e)?(?: version| v)? ?(?:2|2 0)
apache           licensed under(?: the)? apache(?: software)? licen[sc]e
bsd              licensed under(?: the| a)? bsd(?: style)? licen[sc]e
bsd              released under(?: the| a)? bsd(?: style)? licen[sc]e
bsd-2-clause     licensed under(?: the)? (?:2 clause bsd|bsd 2 clause|simplified bsd|freebsd)(?: licen[sc]e)?
bsd-3-clause     licensed under(?: the)? (?:3 clause bsd|bsd 3 clause|new bsd|modified bsd|revised bsd)(?: licen[sc]e)?
bsd-2-clause     released under(?: the)? (?:2 clause bsd|bsd 2 clause|simplified bsd|freebsd)(?: licen[sc]e)?
bsd-3-clause     released under(?: the)? (?:3 clause bsd|bsd 3 clause|new bsd|modified bsd|revised bsd)(?: licen[sc]e)?
isc              licensed under(?: the)? isc(?: licen[sc]e)?
gpl-2            licensed under(?: the)?(?: gnu)? gpl ?(?:version |v ?)?2(?: 0)?
gpl-3            licensed under(?: the)?(?: gnu)? gpl ?(?:version |v ?)?3(?: 0)?
gpl-2            released under(?: the)?(?: gnu)? gpl ?(?:version |v ?)?2(?: 0)?
gpl-3            released under(?: the)?(?: gnu)? gpl ?(?:version |v ?)?3(?: 0)?
gpl              licensed under(?: the)?(?: terms of the)? gnu general public licen[sc]e
gpl              released under(?: the)?(?: terms of the)? gnu general public licen[sc]e
gpl              distributed under(?: the)?(?: terms of the)? gnu general public licen[sc]e
lgpl             licensed under(?: the)?(?: terms of the)? gnu (?:lesser|library) general public licen[sc]e
lgpl             licensed under(?: the)?(?: gnu)? lgpl
lgpl             released under(?: the)?(?: gnu)? lgpl
agpl-3           licensed under(?: the)?(?: gnu)? (?:agpl|affero gpl|affero general public licen[sc]e)
agpl-3           released under(?: the)?(?: gnu)? (?:agpl|affero gpl|affero general public licen[sc]e)
mpl-2            licensed under(?: the)? (?:mpl|mozilla public licen[sc]e) ?(?:version |v ?)?2(?: 0)?
mpl-2            released under(?: the)? (?:mpl|mozilla public licen[sc]e) ?(?:version |v ?)?2(?: 0)?
epl              licensed under(?: the)? (?:epl|eclipse public licen[sc]e)
cddl-1           licensed under(?: the)? (?:cddl|common development and distribution licen[sc]e)
eupl             licensed under(?: the)? (?:eupl|european union public licen[sc]e)
artistic         licensed under(?: the)?(?: perl)? artistic licen[sc]e
zlib             licensed under(?: the)? zlib(?: libpng)?(?: licen[sc]e)?
boost-1          licensed under(?: the)? boost software licen[sc]e
boost-1          distributed under(?: the)? boost software licen[sc]e
unlicense        released under(?: the)? unlicense
wtfpl            licensed under(?: the)? wtfpl
python-2         licensed under(?: the)? (?:psf|python software foundation) licen[sc]e
postgresql       licensed under(?: the)? postgresql licen[sc]e
ofl-1.1          licensed under(?: the)? (?:sil )?open font licen[sc]e
cc0-1            licensed under(?: the)? (?:cc0|creative commons zero)
cc-by            licensed under(?: a| the)? (?:cc by|creative commons attribution)
cc-by-sa         licensed under(?: a| the)? (?:cc by sa|creative commons attribution share ?alike)
cc-by-nd         licensed under(?: a| the)? (?:cc by nd|creative commons attribution no ?deriv(?:ative)?s?(?: works)?)
cc-by-nc         licensed under(?: a| the)? (?:cc by nc|creative commons attribution non ?commercial)
cc-by-nc-sa      licensed under(?: a| the)? (?:cc by nc sa|creative commons attribution non ?commercial share ?alike)
cc-by-nc-nd      licensed under(?: a| the)? (?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?)
cc-by            available under(?: a| the)? (?:cc by|creative commons attribution)
cc-by-sa         available under(?: a| the)? (?:cc by sa|creative commons attribution share ?alike)
cc-by-nc         available under(?: a| the)? (?:cc by nc|creative commons attribution non ?commercial)
cc-by            released under(?: a| the)? (?:cc by|creative commons attribution)
cc-by-sa         released under(?: a| the)? (?:cc by sa|creative commons attribution share ?alike)
"""),
    (60, 0.8, """
gpl-1            gnu general public licen[sc]e version 1
gpl-2            gnu general public licen[sc]e(?: version| v)? ?2(?: 0)?
gpl-3            gnu general public licen[sc]e(?: version| v)? ?3(?: 0)?
gpl              gnu general public licen[sc]e
lgpl-2           gnu library general public licen[sc]e(?: version| v)? ?2(?: 0)?
lgpl-2.1         gnu lesser general public licen[sc]e(?: version| v)? ?2 1
lgpl-3           gnu lesser general public licen[sc]e(?: version| v)? ?3(?: 0)?
lgpl             gnu (?:lesser|library) general public licen[sc]e
agpl-3           gnu affero general public licen[sc]e(?: version| v)? ?3(?: 0)?
gfdl             gnu free documentation licen[sc]e
apache-1.1       apache(?: software)? licen[sc]e(?: version| v)? ?1 1
apache-2         apache(?: software)? licen[sc]e(?: version| v)? ?2(?: 0)?
mpl-1.1          mozilla public licen[sc]e(?: version| v)? ?1 1
mpl-2            mozilla public licen[sc]e(?: version| v)? ?2(?: 0)?
epl-1            eclipse public licen[sc]e(?: version| v)? ?1(?: 0)?
epl-2            eclipse public licen[sc]e(?: version| v)? ?2(?: 0)?
cpl-1            common public licen[sc]e(?: version| v)? ?1(?: 0)?
cddl-1           common development and distribution licen[sc]e
eupl             european union public licen[sc]e
artistic-2       artistic licen[sc]e(?: version| v)? ?2(?: 0)?
artistic-1       artistic licen[sc]e(?: version| v)? ?1(?: 0)?
boost-1          boost software licen[sc]e(?: version| v)? ?1(?: 0)?
zlib             zlib libpng licen[sc]e
python-2         python software foundation licen[sc]e(?: version| v)? ?2?
ofl-1.1          sil open font licen[sc]e
postgresql       postgresql licen[sc]e
ms-pl            microsoft public licen[sc]e
ms-rl            microsoft reciprocal licen[sc]e
osl-3            open software licen[sc]e(?: version| v)? ?3(?: 0)?
afl-3            academic free licen[sc]e(?: version| v)? ?3(?: 0)?
qpl-1            q public licen[sc]e
odbl-1           open database licen[sc]e
odc-by           open data commons attribution licen[sc]e
pddl-1           public domain dedication and licen[sc]e
upl-1            universal permissive licen[sc]e
ecl-2            educational community licen[sc]e
cecill           cecill free software licen[sc]e
bsl-business     business source licen[sc]e
sspl-1           server side public licen[sc]e
elastic-2        elastic licen[sc]e(?: version| v)? ?2(?: 0)?
cc0-1            creative commons zero(?: v1 0)?(?: universal)?
cc-by            creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)?
cc-by-sa         creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported| generic)?
cc-by-nd         creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?
cc-by-nc         creative commons attribution non ?commercial(?: [1-4] [05])?
cc-by-nc-sa      creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?
cc-by-nc-nd      creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?
"""),
    (50, 0.8, """
mit              opensource org licenses mit(?: license)?
apache-2         apache org licenses license 2 0
apache-2         opensource org licenses apache 2 0
bsd-2-clause     opensource org licenses bsd 2 clause
bsd-3-clause     opensource org licenses bsd 3 clause
isc              opensource org licenses isc
gpl-2            gnu org licenses(?: old licenses)? gpl 2 0
gpl-3            gnu org licenses gpl 3 0
gpl              gnu org licenses gpl
lgpl-2.1         gnu org licenses(?: old licenses)? lgpl 2 1
lgpl-3           gnu org licenses lgpl 3 0
agpl-3           gnu org licenses agpl 3 0
gfdl             gnu org licenses fdl
mpl-2            mozilla org mpl 2 0
mpl-1.1          mozilla org mpl mpl 1 1
epl-1            eclipse org legal epl v10
epl-2            eclipse org legal epl (?:2 0|v20)
boost-1          boost org license 1 0
unlicense        unlicense org
ofl-1.1          scripts sil org ofl
wtfpl            wtfpl net
cc0-1            creativecommons org publicdomain zero 1 0
public-domain    creativecommons org publicdomain mark 1 0
cc-by            creativecommons org licenses by [1-4] [05]
cc-by-sa         creativecommons org licenses by sa [1-4] [05]
cc-by-nd         creativecommons org licenses by nd [1-4] [05]
cc-by-nc         creativecommons org licenses by nc [1-4] [05]
cc-by-nc-sa      creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc-nd      creativecommons org licenses by nc nd [1-4] [05]
"""),
    (40, 0.6, """
mit              mit licen[sc]ed?
mit              expat licen[sc]ed?
mit              license mit
apache-2         license apache 2(?: 0)?
apache           apache licen[sc]ed?
bsd              bsd licen[sc]ed?
bsd              bsd style licen[sc]e
bsd-3-clause     license bsd 3 clause
bsd-2-clause     license bsd 2 clause
isc              isc licen[sc]ed?
isc              license isc
gpl-2            gplv2
gpl-3            gplv3
gpl-2            gpl (?:version |v ?)2(?: 0)?
gpl-3            gpl (?:version |v ?)3(?: 0)?
gpl-2            license gpl 2 0
gpl-3            license gpl 3 0
lgpl-2.1         lgpl (?:version |v ?)?2 1
lgpl-3           lgplv3
lgpl-3           lgpl (?:version |v ?)3(?: 0)?
agpl-3           agplv3
agpl-3           agpl (?:version |v ?)3(?: 0)?
mpl-2            license mpl 2 0
unlicense        license unlicense
cc0-1            cc0 1 0
cc0-1            license cc0
cc-by            cc by(?: [1-4] [05])
cc-by-sa         cc by sa(?: [1-4] [05])?
cc-by-nd         cc by nd(?: [1-4] [05])?
cc-by-nc         cc by nc [1-4] [05]
cc-by-nc-sa      cc by nc sa(?: [1-4] [05])?
cc-by-nc-nd      cc by nc nd(?: [1-4] [05])?
"""),
    (30, 0.5, """
all-rights-reserved  all rights reserved
no-rights-reserved   no rights reserved
public-domain        released into the public domain
public-domain        dedicated to the public domain
public-domain        placed in the public domain
public-domain        this work is in the public domain
non-commercial       for (?:personal|research|academic|educational|non ?commercial) use only
non-commercial       not for commercial use
non-commercial       commercial use is (?:prohibited|not permitted|not allowed|forbidden)
no-redistribution    may not be (?:copied|reproduced|redistributed|distributed)
no-redistribution    unauthori[sz]ed (?:copying|reproduction|distribution|use) of this
no-redistribution    redistribution is (?:prohibited|not permitted|not allowed|forbidden)
proprietary          proprietary and confidential
proprietary          this is proprietary software
proprietary          confidential and proprietary information
source-available     source available licen[sc]e
dual                 dual licen[sc]ed under
"""),
)

#: What separates words in lower-cased text: ASCII outside [0-9a-z].
_SEP = "[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
_WORD = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]"


@dataclass(frozen=True)
class Rule:
    pattern: str
    label: str
    priority: int
    score: float
    base: bool = False

    @property
    def words(self) -> list[str]:
        """The pattern's fixed words, those of no group or choice."""
        flat = self.pattern
        while (less := re.sub(r"\((?:\?:)?[^()]*\)\??", "\0", flat)) != flat:
            flat = less
        return [w for w in re.split(" |\0 ", flat) if re.fullmatch("[0-9a-z]+", w)]

    def compiled(self) -> re.Pattern:
        # "a ?b": with or without a separator.
        body = re.sub(r" (\??)", lambda m: f"(?:{_SEP}){m[1]}", self.pattern)
        return re.compile(f"{body}(?!{_WORD})")

    @property
    def start(self) -> str:
        """The fixed text that a match begins with."""
        return re.match("[0-9a-z]+", self.pattern)[0]


@functools.cache
def rules() -> tuple[Rule, ...]:
    """All rules in order of priority; ties in the order of the tables."""
    made = [Rule(p, label, 100, 1.0, True) for p, label in PHRASES]
    for priority, score, lines in SIGNATURES:
        for line in lines.strip().splitlines():
            label, pattern = line.split(maxsplit=1)
            made.append(Rule(pattern, label, priority, score))
    return tuple(made)


def uncontained(start: np.ndarray, end: np.ndarray, priority: np.ndarray, always: np.ndarray) -> np.ndarray:
    """Which spans stay: those always kept, and those that no kept span of a
    higher priority and no other span of their own contains (of equal ones the
    first stays). Level by level; of the levels above only the spans that
    nothing contains are kept at hand, whose starts and ends both rise."""
    keep = np.zeros(len(start), bool)
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for level in np.unique(priority)[::-1]:
        some = np.flatnonzero(priority == level)
        some = some[np.lexsort((some, -end[some], start[some]))]
        s, e = start[some], end[some]
        at = np.searchsorted(a, s, side="right") - 1
        above = (at >= 0) & (b[at] >= e) if len(a) else np.zeros(len(s), bool)
        before = np.r_[-1, np.maximum.accumulate(e)[:-1]]
        stay = always[some] | ~(above | (before >= e))
        keep[some[stay]] = True
        a, b = np.concatenate([a, s[stay]]), np.concatenate([b, e[stay]])
        by = np.lexsort((-b, a))
        a, b = a[by], b[by]
        top = b > np.r_[-1, np.maximum.accumulate(b)[:-1]]
        a, b = a[top], b[top]
    return keep


class Scanner:
    def __init__(self, found: tuple[Rule, ...] | None = None):
        import ahocorasick

        self.rules = rules() if found is None else found
        self.compiled = [r.compiled() for r in self.rules]
        self.words = [r.words for r in self.rules]
        self.is_word = re.compile(_WORD)
        # Fewest texts have a rule's longest word: it alone opens the rule, the others are then asked.
        self.opens = ahocorasick.Automaton()
        by_word: dict[str, list[int]] = {}
        for i, words in enumerate(self.words):
            by_word.setdefault(max(words, key=len), []).append(i)
        for word, ids in by_word.items():
            self.opens.add_word(word, ids)
        self.opens.make_automaton()

    def matches(self, lowered: str) -> list[tuple[int, int, int]]:
        """(start, end, rule) of all matches, at each place of a rule's first word."""
        opened: set[int] = set()
        for _, ids in self.opens.iter(lowered):
            opened.update(ids)
        found = []
        there: dict[str, bool] = {}
        for i in sorted(opened):
            for w in self.words[i]:
                if w not in there:
                    there[w] = w in lowered
            if not all(there[w] for w in self.words[i]):
                continue
            first, match = self.rules[i].start, self.compiled[i].match
            at = lowered.find(first)
            while at >= 0:
                if (at == 0 or not self.is_word.match(lowered, at - 1)) and (m := match(lowered, at)):
                    found.append((at, m.end(), i))
                at = lowered.find(first, at + len(first))
        return found

    def spans(self, lowered: str) -> list[tuple[int, int, int]]:
        """(start, end, rule) of all matches of base rules, and of the other
        rules' matches that are not contained, see :func:`uncontained`."""
        found = self.matches(lowered)
        if not found:
            return []
        s, e, i = np.array(found, np.int64).T
        keep = uncontained(s, e, np.array([r.priority for r in self.rules])[i], np.array([r.base for r in self.rules])[i])
        return sorted(x for x, k in zip(found, keep.tolist(), strict=True) if k)


_IS_WORD = np.array([c >= 0x80 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 for c in range(256)])


def word_starts(data: bytes) -> np.ndarray:
    w = _IS_WORD[np.frombuffer(data, np.uint8)]
    return np.flatnonzero(w & ~np.r_[False, w[:-1]]) if len(w) else np.zeros(0, np.int64)


@functools.cache
def scanner() -> Scanner:
    return Scanner()


def scan_text(text: str | None) -> tuple[int, int, int | None, int | None, str, str, float, list[tuple[str, int, int, float]]]:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of one whole text."""
    data = (text or "").encode().lower()  # of bytes: A-Z only
    words = word_starts(data)
    s = scanner()
    spans = s.spans(data.decode("latin-1"))  # one character per byte; those from 0x80 on are word characters
    base = [x for x in spans if s.rules[x[2]].base]
    first, last = (int(np.searchsorted(words, x)) if base else None for x in ((base[0][0], base[-1][0]) if base else (0, 0)))
    labels = {s.rules[x[2]].label for x in spans}
    score = max((s.rules[x[2]].score for x in spans), default=0.0)
    return len(words), len(base), first, last, ",".join(sorted({s.rules[x[2]].label for x in base})), ",".join(sorted(labels)), score, [(s.rules[i].label, a, b, s.rules[i].score) for a, b, i in spans]


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:int,end:int,score:double>>"


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, word and place counts, labels, score and spans
    (positions in the text's UTF-8 bytes). A null or empty text has no words, no
    labels and score 0; a null key stays null; rows are scanned one by one,
    so repeated rows, ids and ties give repeated results and an empty table an
    empty one; other columns are ignored, whatever their names.
    """
    kind = docs.schema[key].dataType

    def run(batches):
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), span]
        for whole in batches:
            for batch in sliced(whole, "text"):
                rows = [scan_text(t) for t in batch.column(1).to_pylist()]
                spans = [[dict(zip(("label", "start", "end", "score"), x, strict=True)) for x in r[7]] for r in rows]
                columns = [[r[i] for r in rows] for i in range(7)] + [spans]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["key", *names])

    given = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return given.mapInArrow(lean(run), f"key {kind.simpleString()}, {SCHEMA}").withColumnRenamed("key", key)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return scan(table(spark, sf_dir, "documents")).drop("spans")
