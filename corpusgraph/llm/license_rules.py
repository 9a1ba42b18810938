"""The signature rules of the license scan, in order of priority.

Every rule is (priority, label, keywords, regex) over text whose A-Z are in lower case. In the patterns below a space
stands for a gap: one to twelve characters that belong to no word. A rule is tried only on texts with one of its
keywords; each keyword is a literal that a match can't do without.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Characters between words.
GAP = r"[\x00-\x2f\x3a-\x60\x7b-\x7f]{1,12}"
#: Confidence of a detection by priority: body of a license, tag, address, name with a version, bare name, notice.
BODY, TAG, URL, NAME, BARE, NOTICE = range(6)
CONFIDENCE = (0.99, 0.97, 0.95, 0.9, 0.7, 0.4)
#: What may precede a version number.
V = r"(?:(?:version|ver\.?|v\.?)[\s.]{0,3})?"
_V = rf"[\s,(-]{{0,4}}{V}"


@dataclass(frozen=True)
class Rule:
    priority: int
    label: str
    keywords: tuple[str, ...]
    pattern: re.Pattern


#: label | SPDX identifiers | name | address (a dash: none). Names are tried with word ends on both sides.
FAMILIES = r"""
agpl-3.0 | agpl-3\.0(?:-only|-or-later)?\+? | (?:gnu )?affero general public licen[cs]e{V}3(?:\.0)?|agpl{V}3(?:\.0)? | gnu\.org/licenses/agpl(?:-3\.0)?
agpl-1.0 | agpl-1\.0(?:-only|-or-later)? | affero general public licen[cs]e{V}1(?:\.0)?|agpl{V}1(?:\.0)? | affero\.org/oagpl
lgpl-3.0 | lgpl-3\.0(?:-only|-or-later)?\+? | (?:gnu )?lesser general public licen[cs]e{V}3(?:\.0)?|lgpl{V}3(?:\.0)? | gnu\.org/licenses/lgpl(?:-3\.0|\.html|\.txt)
lgpl-2.1 | lgpl-2\.1(?:-only|-or-later)?\+? | (?:gnu )?lesser general public licen[cs]e{V}2\.1|lgpl{V}2\.1 | gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1
lgpl-2.0 | lgpl-2\.0(?:-only|-or-later)?\+? | (?:gnu )?library general public licen[cs]e(?:{V}2(?:\.0)?)?|lgpl{V}2(?:\.0)? | gnu\.org/licenses/old-licenses/lgpl-2\.0
gpl-3.0 | gpl-3\.0(?:-only|-or-later)?\+? | (?:gnu )?general public licen[cs]e{V}3(?:\.0)?|(?:gnu )?gpl{V}3(?:\.0)? | gnu\.org/licenses/gpl(?:-3\.0|\.html|\.txt)
gpl-2.0 | gpl-2\.0(?:-only|-or-later)?\+? | (?:gnu )?general public licen[cs]e{V}2(?:\.0)?|(?:gnu )?gpl{V}2(?:\.0)? | gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0
gpl-1.0 | gpl-1\.0(?:-only|-or-later)?\+? | (?:gnu )?general public licen[cs]e{V}1(?:\.0)? | gnu\.org/licenses/old-licenses/gpl-1\.0
gfdl-1.3 | gfdl-1\.3(?:-only|-or-later)? | (?:gnu )?free documentation licen[cs]e{V}1\.3 | gnu\.org/licenses/fdl(?:-1\.3)?
gfdl-1.2 | gfdl-1\.2(?:-only|-or-later)? | (?:gnu )?free documentation licen[cs]e{V}1\.2 | gnu\.org/licenses/old-licenses/fdl-1\.2
apache-2.0 | apache-2\.0 | apache (?:software )?licen[cs]e{V}2(?:\.0)?|apache-2\.0 | apache\.org/licenses/license-2\.0
apache-1.1 | apache-1\.1 | apache (?:software )?licen[cs]e{V}1\.1 | apache\.org/licenses/license-1\.1
apache-1.0 | apache-1\.0 | apache (?:software )?licen[cs]e{V}1\.0 | apache\.org/licenses/license-1\.0
mit | mit | mit licen[cs]e|expat licen[cs]e|mit/x11 licen[cs]e | opensource\.org/licenses?/mit|mit-license\.org
mit-0 | mit-0 | mit no attribution(?: licen[cs]e)? | opensource\.org/licenses?/mit-0
x11 | x11 | x11 licen[cs]e | -
bsd-4-clause | bsd-4-clause | (?:4|four)[ -]clause bsd(?: licen[cs]e)?|original bsd licen[cs]e | -
bsd-3-clause | bsd-3-clause | (?:3|three)[ -]clause bsd(?: licen[cs]e)?|bsd (?:3|three)[ -]clause|(?:new|modified|revised) bsd licen[cs]e | opensource\.org/licenses?/bsd-3-clause
bsd-2-clause | bsd-2-clause | (?:2|two)[ -]clause bsd(?: licen[cs]e)?|bsd (?:2|two)[ -]clause|simplified bsd licen[cs]e|freebsd licen[cs]e | opensource\.org/licenses?/bsd-2-clause
bsd-1-clause | bsd-1-clause | (?:1|one)[ -]clause bsd(?: licen[cs]e)? | opensource\.org/licenses?/bsd-1-clause
0bsd | 0bsd | zero[ -]clause bsd(?: licen[cs]e)? | opensource\.org/licenses?/0bsd
isc | isc | isc licen[cs]e | opensource\.org/licenses?/isc
mpl-2.0 | mpl-2\.0(?:-no-copyleft-exception)? | mozilla public licen[cs]e{V}2(?:\.0)?|mpl{V}2(?:\.0)? | mozilla\.org/(?:en-us/)?mpl/2\.0
mpl-1.1 | mpl-1\.1 | mozilla public licen[cs]e{V}1\.1|mpl{V}1\.1 | mozilla\.org/mpl/mpl-1\.1
mpl-1.0 | mpl-1\.0 | mozilla public licen[cs]e{V}1\.0|mpl{V}1\.0 | mozilla\.org/mpl/mpl-1\.0
epl-2.0 | epl-2\.0 | eclipse public licen[cs]e{V}2(?:\.0)?|epl{V}2\.0 | eclipse\.org/legal/epl-(?:v)?2
epl-1.0 | epl-1\.0 | eclipse public licen[cs]e{V}1(?:\.0)?|epl{V}1\.0 | eclipse\.org/legal/epl-v10
edl-1.0 | - | eclipse distribution licen[cs]e{V}1(?:\.0)? | eclipse\.org/org/documents/edl-v10
cddl-1.1 | cddl-1\.1 | common development and distribution licen[cs]e{V}1\.1|cddl{V}1\.1 | -
cddl-1.0 | cddl-1\.0 | common development and distribution licen[cs]e(?:{V}1\.0)?|cddl{V}1\.0 | opensource\.org/licenses?/cddl-?1
cpl-1.0 | cpl-1\.0 | common public licen[cs]e(?:{V}1\.0)? | opensource\.org/licenses?/cpl1\.0
ipl-1.0 | ipl-1\.0 | ibm public licen[cs]e(?:{V}1\.0)? | -
eupl-1.2 | eupl-1\.2 | european union public licen[cs]e{V}1\.2|eupl{V}1\.2 | joinup\.ec\.europa\.eu/[^\s]{0,80}eupl
eupl-1.1 | eupl-1\.1 | european union public licen[cs]e{V}1\.1|eupl{V}1\.1 | -
artistic-2.0 | artistic-2\.0 | artistic licen[cs]e{V}2(?:\.0)? | opensource\.org/licenses?/artistic-license-2\.0
artistic-1.0 | artistic-1\.0(?:-perl|-cl8)? | artistic licen[cs]e{V}1(?:\.0)? | -
bsl-1.0 | bsl-1\.0 | boost software licen[cs]e(?:{V}1\.0)? | boost\.org/license_1_0
busl-1.1 | busl-1\.1 | business source licen[cs]e(?:{V}1\.1)? | mariadb\.com/bsl11
sspl-1.0 | sspl-1\.0 | server side public licen[cs]e(?:{V}1)? | mongodb\.com/licensing/server-side-public-license
elastic-2.0 | elastic-2\.0 | elastic licen[cs]e(?:{V}2(?:\.0)?)? | elastic\.co/licensing/elastic-license
zlib | zlib | zlib(?:/libpng)? licen[cs]e | opensource\.org/licenses?/zlib
libpng | libpng(?:-2\.0)? | libpng licen[cs]e | -
unlicense | unlicense | the unlicense | unlicense\.org
wtfpl | wtfpl | do what the f[a-z*]{2,3} you want to public licen[cs]e|wtfpl | wtfpl\.net
cc0-1.0 | cc0-1\.0 | cc0(?: 1\.0)?(?: universal)? | creativecommons\.org/publicdomain/zero/1\.0
pddl-1.0 | pddl-1\.0 | open data commons public domain dedication(?: and)?(?: licen[cs]e)? | opendatacommons\.org/licenses/pddl
odbl-1.0 | odbl-1\.0 | open database licen[cs]e(?:{V}1\.0)?|odbl(?: 1\.0)? | opendatacommons\.org/licenses/odbl
odc-by-1.0 | odc-by-1\.0 | open data commons attribution licen[cs]e | opendatacommons\.org/licenses/by
ofl-1.1 | ofl-1\.1(?:-rfn|-no-rfn)? | (?:sil )?open font licen[cs]e(?:{V}1\.1)? | scripts\.sil\.org/ofl|openfontlicense\.org
osl-3.0 | osl-3\.0 | open software licen[cs]e(?:{V}3\.0)? | opensource\.org/licenses?/osl-3\.0
afl-3.0 | afl-3\.0 | academic free licen[cs]e(?:{V}3\.0)? | opensource\.org/licenses?/afl-3\.0
ms-pl | ms-pl | microsoft public licen[cs]e | opensource\.org/licenses?/ms-pl
ms-rl | ms-rl | microsoft reciprocal licen[cs]e | opensource\.org/licenses?/ms-rl
python-2.0 | python-2\.0|psf-2\.0 | python software foundation licen[cs]e(?:{V}2)?|psf licen[cs]e | docs\.python\.org/[^\s]{0,20}license
php-3.01 | php-3\.0?1? | php licen[cs]e(?:{V}3\.0?1)? | php\.net/license
ruby | ruby | ruby licen[cs]e | ruby-lang\.org/[^\s]{0,20}license
postgresql | postgresql | postgresql licen[cs]e | opensource\.org/licenses?/postgresql
openssl | openssl | openssl licen[cs]e | openssl\.org/source/license
ncsa | ncsa | (?:university of illinois/)?ncsa open source licen[cs]e | opensource\.org/licenses?/ncsa
w3c | w3c | w3c software notice and licen[cs]e|w3c licen[cs]e | w3\.org/consortium/legal
unicode | unicode-(?:dfs-2015|dfs-2016|3\.0|tou) | unicode licen[cs]e(?: agreement)? | unicode\.org/(?:copyright|license)
upl-1.0 | upl-1\.0 | universal permissive licen[cs]e(?:{V}1\.0)? | oss\.oracle\.com/licenses/upl
qpl-1.0 | qpl-1\.0 | q public licen[cs]e(?:{V}1\.0)? | -
lppl-1.3c | lppl-1\.3[ac]? | latex project public licen[cs]e | latex-project\.org/lppl
vim | vim | vim licen[cs]e | -
hpnd | hpnd(?:-sell-variant)? | historical permission notice and disclaimer | -
ecl-2.0 | ecl-2\.0 | educational community licen[cs]e(?:{V}2\.0)? | opensource\.org/licenses?/ecl-2\.0
cecill-2.1 | cecill-2\.1 | cecill(?: free software)?(?: licen[cs]e)?{V}2\.1 | cecill\.info
blueoak-1.0.0 | blueoak-1\.0\.0 | blue oak model licen[cs]e(?:{V}1\.0\.0)? | blueoakcouncil\.org/license
mulan-psl-2.0 | mulanpsl-2\.0 | mulan (?:psl|permissive software licen[cs]e){V}2 | license\.coscl\.org\.cn/mulanpsl2
openrail | - | (?:creativeml |bigscience |bigcode )?open ?rail(?:-?\+?\+?m)? | -
llama | - | llama (?:2|3|3\.1) community licen[cs]e | ai\.meta\.com/llama/license
"""

#: label | keyword | sentence of the license's own text.
BODIES = r"""
mit | hereby granted | permission is hereby granted,? free of charge,? to any person obtaining a copy of this software and associated documentation
mit | substantial portions | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | warranty of any kind | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
isc | with or without fee | permission to use copy modify and(?:/or)? distribute this software for any purpose with or without fee is hereby granted
bsd-2-clause | source and binary forms | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | endorse or promote | neither the name of [^\n]{1,100} may be used to endorse or promote products derived from this software
bsd-4-clause | advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
gpl-3.0 | version 3 | under the terms of the gnu general public license as published by the free software foundation either version 3 of the license
gpl-2.0 | version 2 | under the terms of the gnu general public license as published by the free software foundation either version 2 of the license
gpl-2.0 | version 2 | under the terms of the gnu general public license version 2 as published by the free software foundation
lgpl-3.0 | version 3 | under the terms of the gnu lesser general public license as published by the free software foundation either version 3
lgpl-2.1 | version 2.1 | under the terms of the gnu lesser general public license as published by the free software foundation either version 2\.1
agpl-3.0 | affero | under the terms of the gnu affero general public license as published by the free software foundation either version 3
gpl | free software foundation | this program is distributed in the hope that it will be useful but without any warranty
gpl-3.0 | 29 june 2007 | gnu general public license version 3 29 june 2007
gpl-2.0 | june 1991 | gnu general public license version 2 june 1991
gfdl-1.3 | free documentation | permission is granted to copy distribute and(?:/or)? modify this document under the terms of the gnu free documentation license version 1\.3
apache-2.0 | apache license | licensed under the apache license version 2\.0 the license
apache-2.0 | compliance with the license | you may not use this file except in compliance with the license
apache-2.0 | as is | distributed under the license is distributed on an as is basis without warranties or conditions of any kind
mpl-2.0 | mozilla public | this source code form is subject to the terms of the mozilla public license v 2\.0
mpl-1.1 | mozilla public | the contents of this file are subject to the mozilla public license version 1\.1
epl-2.0 | eclipse public | made available under the terms of the eclipse public license 2\.0
epl-1.0 | eclipse public | made available under the terms of the eclipse public license v1\.0
cddl-1.0 | common development | the contents of this file are subject to the terms of the common development and distribution license
bsl-1.0 | boost | distributed under the boost software license version 1\.0
bsl-1.0 | machine-executable | in whole or in part and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code
zlib | held liable | in no event will the authors be held liable for any damages arising from the use of this software
zlib | origin of this software | the origin of this software must not be misrepresented you must not claim that you wrote the original software
unlicense | unencumbered | this is free and unencumbered software released into the public domain
wtfpl | you want to | you just do what the f[a-z*]{2,3} you want to
cc0-1.0 | related rights | waived all copyright and related or neighboring rights
cc0-1.0 | universal | creative commons legal code cc0 1\.0 universal
cc-by-4.0 | attribution 4.0 | creative commons attribution 4\.0 international
cc-by-sa-4.0 | 4.0 international | creative commons attribution[ -]sharealike 4\.0 international
cc-by-nc-4.0 | 4.0 international | creative commons attribution[ -]noncommercial 4\.0 international
ofl-1.1 | open font | this font software is licensed under the sil open font license version 1\.1
artistic-2.0 | artistic license | this package is licensed under the artistic license 2\.0
ms-pl | microsoft public | this license governs use of the accompanying software if you use the software you accept this license
python-2.0 | python software foundation | this license agreement is between the python software foundation
openssl | openssl project | this product includes software developed by the openssl project
ncsa | university of illinois | neither the names of [^\n]{1,100} university of illinois
postgresql | university of california | in no event shall the university of california be liable to any party
sspl-1.0 | server side public | under the terms of the server side public license version 1
busl-1.1 | change date | change date [^\n]{1,60} change license
elastic-2.0 | managed service | you may not provide the software to third parties as a hosted or managed service
commons-clause | commons clause | the software is provided to you by the licensor under the license as defined below subject to the following condition|commons clause license condition
eupl-1.2 | eupl | licensed under the eupl version 1\.2
upl-1.0 | larger works | the universal permissive license upl version 1\.0
"""

#: priority | label | keyword | pattern: names without a version, and notices without a license.
MENTIONS = r"""
4 | agpl | affero | (?:gnu )?affero general public licen[cs]e
4 | agpl | agpl | agpl
4 | lgpl | lesser general | (?:gnu )?lesser general public licen[cs]e
4 | lgpl | lgpl | lgpl
4 | gpl | general public | gnu general public licen[cs]e
4 | gpl | gpl | (?:gnu )?gpl
4 | gfdl | documentation | gnu free documentation licen[cs]e
4 | apache | apache | apache (?:software )?licen[cs]e
4 | bsd | bsd | bsd(?:[ -]style)? licen[cs]e
4 | mpl | mozilla | mozilla public licen[cs]e
4 | epl | eclipse | eclipse public licen[cs]e
4 | eupl | european union | european union public licen[cs]e
4 | artistic | artistic | artistic licen[cs]e
4 | creative-commons | creative commons | creative commons licen[cs]e
4 | public-domain | public domain | (?:released |placed |dedicated )?(?:in|into|to) the public domain
5 | copyright | copyright | copyright (?:c )?(?:19|20)[0-9]{2}
5 | all-rights-reserved | rights reserved | all rights reserved
5 | proprietary | proprietary | (?:proprietary and confidential|proprietary licen[cs]e)
5 | licensed | terms of | (?:licensed|released|distributed) under (?:the )?terms of
5 | see-license | license | see (?:the )?license(?:\.txt|\.md)? (?:file )?(?:for|in)
5 | evaluation | evaluation | evaluation licen[cs]e|for evaluation purposes only
5 | non-commercial | commercial | for non ?-?commercial (?:use|purposes) only
5 | eula | end user | end user licen[cs]e agreement
"""


#: Creative Commons licenses: code, words, versions.
COMMONS = [
    ("by", "attribution"), ("by-sa", "attribution[ -]share ?-?alike"), ("by-nc", "attribution[ -]non ?-?commercial"), ("by-nd", "attribution[ -]no ?-?derivatives"),
    ("by-nc-sa", "attribution[ -]non ?-?commercial[ -]share ?-?alike"), ("by-nc-nd", "attribution[ -]non ?-?commercial[ -]no ?-?derivatives"),
]
COMMONS_VERSIONS = ("4.0", "3.0", "2.5", "2.0", "1.0")
#: Licenses before the tag in an SPDX expression.
_BEFORE = r"(?:\(?[a-z0-9.+-]{2,40}\)?\x20{1,2}(?:or|and)\x20{1,2}){0,4}"


def commons() -> list[Rule]:
    rules = []
    for code, words in COMMONS:
        short = code.replace("-", "[ -]")
        for version in COMMONS_VERSIONS:
            v, label = re.escape(version), f"cc-{code}-{version}"
            rules += tags(label, rf"cc-{code}-{v}")
            rules.append(Rule(URL, label, ("creativecommons org",), compiled(rf"creativecommons\.org/licenses/{code}/{v}", True)))
            rules.append(Rule(NAME, label, ("cc by",), compiled(rf"cc[ -]{short}(?: licen[cs]e)? {v}")))
            rules.append(Rule(NAME, label, ("creative commons",), compiled(rf"creative commons {words}(?: licen[cs]e)? {v}")))
        rules.append(Rule(BARE, f"cc-{code}", ("cc by",), compiled(rf"cc[ -]{short}")))
        rules.append(Rule(BARE, f"cc-{code}", ("creative commons",), compiled(rf"creative commons {words}")))
    return rules


def tags(label: str, tag: str) -> list[Rule]:
    """An SPDX line, whose expression may name several, and a package manifest's field; `hit` is what counts as the place."""
    line = compiled(rf"spdx-license-identifier:[\x20\t]{{0,8}}{_BEFORE}\(?(?P<hit>{tag})", True)
    field = compiled(rf"""licen[cs]e["']?[\x20\t]{{0,4}}[:=][\x20\t]{{0,4}}["'](?P<hit>{tag})(?=["'])""", True)
    return [Rule(TAG, label, ("spdx license identifier",), line), Rule(TAG, label, tuple(f"{word} {t}" for word in ("license", "licence") for t in starts(tag)), field)]


def compiled(pattern: str, tight: bool = False) -> re.Pattern:
    """A pattern of the tables, between word ends; tight: a space is a space."""
    text = pattern.replace("{V}", _V)
    if not tight:  # in a character class a space is a space
        text = re.sub(r"\[[^\]]*\]|( \?)|( )", lambda m: rf"(?:{GAP})?" if m[1] else GAP if m[2] else m[0].replace(" ", r"\x20"), text)
    return re.compile(rf"(?<![a-z0-9])(?:{text})(?![a-z0-9])", re.A)


def plain(keyword: str) -> str:
    """A keyword as it stands in words joined by spaces."""
    return re.sub(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", " ", keyword).strip()


def anchors(label: str, pattern: str) -> tuple[str, ...]:
    """For each alternative of a name its longest literal, as it stands in words joined by spaces.

    Groups that are optional or have alternatives don't count, nor do classes and optional characters.
    """
    bare = pattern.replace("{V}", "\n")
    while bare != (bare := re.sub(r"\((?:\?:)?[^()]*\)(\?)?", lambda m: "\n" if m[1] or "|" in m[0] else re.sub(r"^\((?:\?:)?|\)$", "", m[0]), bare)):
        pass
    found = set()
    for part in bare.split("|"):
        literals = re.split(r"[^a-z0-9 ]", re.sub(r"\[[^\]]*\]\??|\\.|.\?", "\n", part))
        best = max((x.strip() for x in literals), key=len)
        if len(best) < 3:
            raise ValueError(f"{label}: no literal gates {part}")
        found.add(best)
    return tuple(sorted(found))


def starts(tag: str) -> tuple[str, ...]:
    """The literal starts of a tag's alternatives."""
    cut = [re.split(r"[(\[]|(?:\\.|[a-z0-9])\?|\\\+", p)[0] for p in re.split(r"\|(?![^(]*\))", tag)]
    return tuple(sorted({plain(c.replace("\\", "")) for c in cut}))


def _rows(table: str) -> list[list[str]]:
    out = []
    for line in table.strip().split("\n"):
        out.append([c.strip() for c in re.split(r"\s\|\s", line)])
    return out


def _all() -> list[Rule]:
    rules = [Rule(BODY, label, (plain(word),), compiled(sentence)) for label, word, sentence in _rows(BODIES)]
    for label, tag, name, url in _rows(FAMILIES):
        if tag != "-":
            rules += tags(label, tag)
        if url != "-":
            rules.append(Rule(URL, label, hosts(url), compiled(url, True)))
        rules.append(Rule(NAME, label, anchors(label, name), compiled(name)))
    rules += commons()
    rules += [Rule(int(priority), label, (plain(word),), compiled(pattern)) for priority, label, word, pattern in _rows(MENTIONS)]
    return sorted(rules, key=lambda r: r.priority)


def hosts(url: str) -> tuple[str, ...]:
    """The literal starts of an address's alternatives."""
    return tuple(sorted({plain(re.match(r"[a-z0-9-]+(?:\\\.[a-z0-9-]+)*", p)[0].replace("\\", "")) for p in re.split(r"\|(?![^(]*\))", url)}))


RULES = _all()
