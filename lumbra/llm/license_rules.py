"""Signature rules for licences.

A rule is a regular expression over the words of a text, joined by single spaces (lower
case, no punctuation), so "Apache License, Version 2.0" reads ``apache license version 2 0``.
``NAMES`` gives each licence hand-written patterns of its names, identifiers and addresses;
``FRAMES`` the hand-written sentences in which licences are named; ``TEXTS`` phrases of the
licences' own wording.  Order is priority: earlier rules win over later ones of equal extent.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: label: (words of which every match holds one, glued spellings included; pattern of its names)
NAMES: dict[str, tuple[str, str]] = {
    "apache-2": ("apache apache2", r"apache(?: software)?(?: license| licence)?(?: v| version)? ?2(?: 0)?"),
    "apache-1.1": ("apache apache1", r"apache(?: software)?(?: license| licence)?(?: v| version)? ?1 1"),
    "mit": ("mit", r"mit(?: x11| expat)?"),
    "mit-0": ("mit", r"mit (?:0|no attribution)"),
    "x11": ("x11", r"x11"),
    "expat": ("expat", r"expat"),
    "isc": ("isc", r"isc"),
    "bsd-2-clause": ("bsd freebsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd|two clause bsd)"),
    "bsd-3-clause": ("bsd", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd|three clause bsd)"),
    "bsd-4-clause": ("bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd|four clause bsd)"),
    "0bsd": ("0bsd", r"0bsd"),
    "bsd": ("bsd", r"bsd(?: style)?"),
    "agpl-3": ("affero", r"(?:gnu )?affero(?: gnu)? general public licen[cs]e(?: as published by the free software foundation)?(?: v| version)? ?3(?: 0)?"),
    "agpl-3-id": ("agpl agplv agpl3 agplv3", r"agpl ?v? ?3(?: 0)?"),
    "gpl-2": ("general", r"(?:gnu )?(?<!lesser )(?<!library )(?<!affero )general public licen[cs]e(?: gpl)?(?: as published by the free software foundation)?(?: either)?(?: v| version)? ?2(?: 0)?"),
    "gpl-3": ("general", r"(?:gnu )?(?<!lesser )(?<!library )(?<!affero )general public licen[cs]e(?: gpl)?(?: as published by the free software foundation)?(?: either)?(?: v| version)? ?3(?: 0)?"),
    "gpl-2-id": ("gpl gplv gpl2 gplv2", r"gpl ?v? ?2(?: 0)?"),
    "gpl-3-id": ("gpl gplv gpl3 gplv3", r"gpl ?v? ?3(?: 0)?"),
    "gpl-2-glued": ("gplv2", r"gplv2"),
    "gpl-3-glued": ("gplv3", r"gplv3"),
    "agpl-3-glued": ("agplv3", r"agplv3"),
    "lgpl-2.1": ("lesser", r"(?:gnu )?lesser general public licen[cs]e(?: as published by the free software foundation)?(?: either)?(?: v| version)? ?2 1"),
    "lgpl-3": ("lesser", r"(?:gnu )?lesser general public licen[cs]e(?: as published by the free software foundation)?(?: either)?(?: v| version)? ?3(?: 0)?"),
    "lgpl-2": ("library", r"(?:gnu )?library general public licen[cs]e(?: v| version)? ?2(?: 0)?"),
    "lgpl-2.1-id": ("lgpl lgplv lgpl2 lgplv2", r"lgpl ?v? ?2 1"),
    "lgpl-3-id": ("lgpl lgplv lgpl3 lgplv3", r"lgpl ?v? ?3(?: 0)?"),
    "gfdl-1.3": ("documentation", r"(?:gnu )?free documentation licen[cs]e(?: v| version)? ?1 3"),
    "gfdl-1.2": ("documentation", r"(?:gnu )?free documentation licen[cs]e(?: v| version)? ?1 2"),
    "mpl-2": ("mozilla", r"mozilla public licen[cs]e(?: v| version)? ?2(?: 0)?"),
    "mpl-1.1": ("mozilla", r"mozilla public licen[cs]e(?: v| version)? ?1 1"),
    "mpl-2-id": ("mpl mplv mpl2 mplv2", r"mpl ?v? ?2(?: 0)?"),
    "epl-1": ("eclipse", r"eclipse public licen[cs]e(?: v| version)? ?1(?: 0)?"),
    "epl-2": ("eclipse", r"eclipse public licen[cs]e(?: v| version)? ?2(?: 0)?"),
    "edl-1": ("eclipse", r"eclipse distribution licen[cs]e(?: v| version)? ?1(?: 0)?"),
    "cddl-1": ("cddl cddl1", r"cddl(?: v| version)? ?1(?: 0)?"),
    "cddl": ("distribution", r"common development and distribution licen[cs]e"),
    "cpl-1": ("common", r"common public licen[cs]e(?: v| version)? ?1(?: 0)?"),
    "artistic-2": ("artistic", r"artistic licen[cs]e(?: v| version)? ?2(?: 0)?"),
    "artistic-1": ("artistic", r"(?:artistic licen[cs]e(?: v| version)? ?1(?: 0)?|clarified artistic licen[cs]e)"),
    "bsl-1.1": ("business", r"business source licen[cs]e(?: v| version)? ?1 1"),
    "boost-1": ("boost", r"boost software licen[cs]e(?: v| version)?(?: 1(?: 0)?)?"),
    "zlib": ("zlib", r"zlib(?: libpng)?"),
    "libpng": ("libpng", r"libpng"),
    "openssl": ("openssl", r"openssl"),
    "unlicense": ("unlicense", r"unlicense"),
    "wtfpl": ("wtfpl", r"wtfpl"),
    "beerware": ("beerware", r"beerware"),
    "postgresql": ("postgresql", r"postgresql licen[cs]e"),
    "python-2": ("python", r"python(?: software foundation)? licen[cs]e(?: v| version)?(?: 2(?: 0)?)?"),
    "php-3": ("php", r"php licen[cs]e(?: v| version)?(?: 3(?: 0| 01)?)?"),
    "ruby": ("ruby", r"ruby licen[cs]e"),
    "ofl-1.1": ("sil", r"sil open font licen[cs]e(?: v| version)?(?: 1 1)?"),
    "ncsa": ("ncsa", r"(?:university of illinois )?ncsa(?: open source licen[cs]e)?"),
    "eupl-1.2": ("european", r"european union public licen[cs]e(?: v| version)?(?: 1 2)?"),
    "eupl-1.2-id": ("eupl", r"eupl(?: v| version)?(?: 1 2)?"),
    "osl-3": ("open", r"open software licen[cs]e(?: v| version)? ?3(?: 0)?"),
    "afl-3": ("academic", r"academic free licen[cs]e(?: v| version)? ?3(?: 0)?"),
    "cecill-2.1": ("cecill", r"cecill(?: v| version)?(?: 2(?: 1)?)?"),
    "ms-pl": ("microsoft", r"microsoft public licen[cs]e"),
    "ms-rl": ("microsoft", r"microsoft reciprocal licen[cs]e"),
    "upl-1": ("universal", r"universal permissive licen[cs]e(?: v| version)?(?: 1(?: 0)?)?"),
    "mulan-2": ("mulan", r"mulan psl(?: v| version)? ?v?2"),
    "vim": ("vim", r"vim licen[cs]e"),
    "odbl-1": ("database", r"open(?: data commons open)? database licen[cs]e(?: v| version)?(?: 1(?: 0)?)?"),
    "odc-by-1": ("commons", r"open data commons attribution licen[cs]e"),
    "pddl-1": ("dedication", r"public domain dedication and licen[cs]e"),
    "sspl-1": ("server", r"server side public licen[cs]e(?: v| version)?(?: 1(?: 0)?)?"),
    "elastic-2": ("elastic", r"elastic licen[cs]e(?: v| version)?(?: 2(?: 0)?)?"),
    "cc0": ("cc0", r"cc0(?: 1 0)?(?: universal)?"),
    "cc-by": ("cc", r"cc by(?! nc)(?! sa)(?! nd)(?: [1-4] [05])?"),
    "cc-by-sa": ("cc", r"cc by sa(?: [1-4] [05])?"),
    "cc-by-nd": ("cc", r"cc by nd(?: [1-4] [05])?"),
    "cc-by-nc": ("cc", r"cc by nc(?! sa)(?! nd)(?: [1-4] [05])?"),
    "cc-by-nc-sa": ("cc", r"cc by nc sa(?: [1-4] [05])?"),
    "cc-by-nc-nd": ("cc", r"cc by nc nd(?: [1-4] [05])?"),
    "cc-by-long": ("commons", r"creative commons attribution(?! non)(?! share)(?! no)(?: [1-4] [05])?"),
    "cc-by-sa-long": ("commons", r"creative commons attribution share ?alike(?: [1-4] [05])?"),
    "cc-by-nd-long": ("commons", r"creative commons attribution no ?deriv(?:s|atives)(?: [1-4] [05])?"),
    "cc-by-nc-long": ("commons", r"creative commons attribution non ?commercial(?! share)(?! no)(?: [1-4] [05])?"),
    "cc-by-nc-sa-long": ("commons", r"creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?"),
    "cc-by-nc-nd-long": ("commons", r"creative commons attribution non ?commercial no ?deriv(?:s|atives)(?: [1-4] [05])?"),
    "cc0-long": ("commons", r"creative commons zero(?: v?1 0)?"),
}

#: What the entry's label stands for where several entries share one licence.
SAME_AS = {
    "agpl-3-id": "agpl-3", "agpl-3-glued": "agpl-3", "gpl-2-id": "gpl-2", "gpl-3-id": "gpl-3",
    "gpl-2-glued": "gpl-2", "gpl-3-glued": "gpl-3", "lgpl-2.1-id": "lgpl-2.1", "lgpl-3-id": "lgpl-3",
    "mpl-2-id": "mpl-2", "eupl-1.2-id": "eupl-1.2", "cc-by-long": "cc-by", "cc-by-sa-long": "cc-by-sa",
    "cc-by-nd-long": "cc-by-nd", "cc-by-nc-long": "cc-by-nc", "cc-by-nc-sa-long": "cc-by-nc-sa",
    "cc-by-nc-nd-long": "cc-by-nc-nd", "cc0-long": "cc0", "expat": "mit",
}

#: kind: (score, sentence around a name); a name alone is in none of them and proves nothing.  A group ``at``
#: is all that is reported of a match: other names of a choice have detections of their own.
FRAMES: dict[str, tuple[float, str]] = {
    "identifier": (0.98, r"spdx license identifier {name}"),
    "grant": (0.95, r"(?:licen[cs]ed|released|distributed|published|made available|available|provided|covered|offered|redistributed)(?: \w+){{0,4}} under(?: the)?(?: terms(?: and conditions)? of)?(?: the)? {name}(?: licen[cs]e)?"),
    "choice": (0.9, r"(?:spdx license identifier|(?:dual|triple|multi) licen[cs]ed(?: under)?)(?: \S+){{1,12}}? (?:or|and|with) (?P<at>{name})"),
    "last choice": (0.9, r"(?:spdx license identifier|(?:dual|triple|multi) licen[cs]ed(?: under)?)(?: \S+){{1,12}} (?:or|and|with) (?P<at>{name})"),
    "first choice": (0.9, r"(?:dual|triple|multi) licen[cs]ed(?: under)?(?: either)?(?: the)?(?: of)? (?P<at>{name})"),
    "notice": (0.85, r"licen[cs]e(?: is| type| name| under)?(?: the)? {name}(?: licen[cs]e)?"),
    "title": (0.8, r"(?:the )?(?:{name} licen[cs]e{whole})(?: agreement)?"),
}


def _frame(frame: str, name: str) -> str:
    """A frame around a name; ``whole`` stands for a name that has the word licence of its own, which then is not optional."""
    whole = re.sub(r"\(\?:( [^()]*licen[^()]*)\)\?", r"(?:\1)", name)
    return frame.format(name=name, whole=f"|{whole}" if "licen[cs]e" in whole or "licence" in whole else "")


#: label, keyword, pattern of the licence's own words or address
TEXTS: list[tuple[str, str, str]] = [
    ("mit", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "noninfringement", r"warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("isc", "hereby", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd-2-clause", "redistributions", r"redistributions of source code must retain the above copyright notice"),
    ("bsd-3-clause", "endorse", r"neither the name of(?: \w+){1,12} may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display"),
    ("apache-2", "apache", r"apache license version 2"),
    ("apache-2", "apache", r"www apache org licenses license 2 0"),
    ("apache-2", "compliance", r"you may not use this file except in compliance with the license"),
    ("gpl-3", "gnu", r"gnu general public license version 3 29 june 2007"),
    ("gpl-2", "gnu", r"gnu general public license version 2 june 1991"),
    ("agpl-3", "affero", r"gnu affero general public license version 3 19 november 2007"),
    ("gpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl-3", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("gpl", "gnu", r"www gnu org licenses gpl(?: html)?"),
    ("lgpl", "gnu", r"www gnu org licenses lgpl(?: html)?"),
    ("agpl-3", "gnu", r"www gnu org licenses agpl(?: html)?"),
    ("mpl-2", "mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2", "mozilla", r"mozilla org mpl 2 0"),
    ("epl-2", "eclipse", r"www eclipse org legal epl (?:v20|2 0)"),
    ("epl-1", "eclipse", r"www eclipse org legal epl v10"),
    ("boost-1", "boost", r"www boost org license 1 0 txt"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
    ("zlib", "altered", r"altered source versions must be plainly marked as such"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "unlicense", r"unlicense org"),
    ("wtfpl", "fuck", r"do what the fuck you want to public license"),
    ("ofl-1.1", "sil", r"scripts sil org ofl"),
    ("cc0", "publicdomain", r"creativecommons org publicdomain zero 1 0"),
    ("public-domain", "publicdomain", r"creativecommons org publicdomain mark 1 0"),
    ("cc-by", "creativecommons", r"creativecommons org licenses by [1-4] [05]"),
    ("cc-by-sa", "creativecommons", r"creativecommons org licenses by sa [1-4] [05]"),
    ("cc-by-nd", "creativecommons", r"creativecommons org licenses by nd [1-4] [05]"),
    ("cc-by-nc", "creativecommons", r"creativecommons org licenses by nc [1-4] [05]"),
    ("cc-by-nc-sa", "creativecommons", r"creativecommons org licenses by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", "creativecommons", r"creativecommons org licenses by nc nd [1-4] [05]"),
    ("public-domain", "domain", r"(?:released|dedicated|placed)(?: \w+){0,4} (?:in|into|to) the public domain"),
    ("proprietary", "rights", r"all rights reserved(?: \w+){0,6} (?:proprietary|confidential)"),
    ("proprietary", "proprietary", r"proprietary and confidential"),
    ("mit", "noninfringement", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit", "sublicense", r"to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "substantial", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("x11", "dealings", r"shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization"),
    ("isc", "disclaims", r"the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("bsd-2-clause", "documentation", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation"),
    ("bsd-2-clause", "exemplary", r"in no event shall the (?:copyright (?:owner|holder)|author|regents) or contributors be liable for any direct indirect incidental special exemplary"),
    ("bsd", "regents", r"copyright(?: \w+){0,6} the regents of the university of california"),
    ("apache-2", "irrevocable", r"perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works"),
    ("apache-2", "unless", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2", "asf", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("gpl", "merchantability", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("lgpl", "merchantability", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details"),
    ("agpl-3", "merchantability", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu affero general public license for more details"),
    ("gpl", "received", r"you should have received a copy of the gnu general public license along with"),
    ("lgpl", "received", r"you should have received a copy of the gnu lesser general public license along with"),
    ("agpl-3", "received", r"you should have received a copy of the gnu affero general public license along with"),
    ("gpl", "verbatim", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl-2", "gnu", r"gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3", "gnu", r"gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl-2.1", "gnu", r"gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl-3", "gnu", r"gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl-3", "affero", r"gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-classpath", "classpath", r"(?:gpl|general public license) (?:v?2 )?with (?:the )?classpath exception"),
    ("gfdl", "invariant", r"with no invariant sections no front cover texts and no back cover texts"),
    ("mpl-2", "mpl", r"if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("cddl-1", "cddl distribution", r"subject to the terms of the common development and distribution license the license you may not use this file except|common development and distribution license cddl"),
    ("epl-1", "accompanying", r"this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("epl-2", "accompanying", r"this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("boost-1", "boost", r"distributed under the boost software license version 1 0"),
    ("artistic-2", "artistic", r"you may use and distribute it under the terms of the artistic license 2 0"),
    ("perl", "perl", r"(?:same terms as|under the terms of) perl(?: itself)?"),
    ("python-2", "psf", r"psf license agreement for python"),
    ("zlib", "freely", r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("beerware", "beer", r"you can buy me a beer in return"),
    ("unlicense", "unlicense", r"for more information please refer to (?:http|https) unlicense org"),
    ("cc0", "waived", r"to the extent possible under law(?: \w+){1,8} (?:has|have) waived all copyright and related or neighboring rights"),
    ("cc-by-sa", "attribution", r"attribution share ?alike [1-4] [05] (?:international|unported|generic)"),
    ("cc-by-nc-sa", "noncommercial", r"attribution noncommercial share ?alike [1-4] [05] (?:international|unported|generic)"),
    ("cc-by-nc-nd", "noderivatives", r"attribution noncommercial noderivatives [1-4] [05] (?:international|unported|generic)"),
    ("odbl-1", "odbl", r"open database license odbl"),
    ("json", "evil", r"the software shall be used for good not evil"),
    ("proprietary", "written", r"no (?:license|licence|right) is granted(?: \w+){0,8} without the prior written (?:consent|permission) of"),
    ("proprietary", "written", r"may not be (?:copied|disclosed|reproduced)(?: \w+){0,8} without the (?:express |prior )?written (?:consent|permission)"),
    ("proprietary", "eula", r"end user license agreement eula"),
]

#: The phrases that any scan must report, and their labels.
BASE: dict[str, str] = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}


@dataclass(frozen=True)
class Rule:
    """``keyword``: words of which every match holds one; ``priority``: lower wins; ``base``: its places are reported whatever overlaps them."""

    name: str
    label: str
    keyword: str
    pattern: str
    score: float
    priority: int
    base: bool = False


def default_rules() -> list[Rule]:
    """The ordered rules: base phrases, licence texts, then every name in every frame."""
    found = [(f"base:{p}", label, p.split()[0] if p[:5] != "under" else "mit", p, 0.95, True) for p, label in BASE.items()]
    found += [(f"text:{n}", label, key, p, 1.0, False) for n, (label, key, p) in enumerate(TEXTS)]
    for kind, (score, frame) in FRAMES.items():
        found += [(f"{kind}:{n}", SAME_AS.get(n, n), key, _frame(frame, p), score, False) for n, (key, p) in NAMES.items()]
    return [Rule(name, label, key, pattern, score, k, base) for k, (name, label, key, pattern, score, base) in enumerate(found)]
