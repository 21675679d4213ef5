"""Signature rules for licence scans, in order: ``label: regular expression`` under the heading of their kind.

Expressions are over a text's words in lower case (a-z, 0-9 and characters beyond ASCII) with one space between two, so
``CC BY-NC 4.0.`` reads ``cc by nc 4 0``. The word in braces is the rule's keyword: a rule is tried only where a text has
that word, and must match around it. ``<name>`` stands for one of ``PARTS``. Rules use what Java's expressions and RE2
have in common. A match has at most ``BEFORE`` words before the keyword and ``AFTER`` behind it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

BEFORE, AFTER = 24, 24

#: kind -> (priority, confidence); a rule of a higher priority hides those of lower ones inside its match.
KINDS = {"HINT": (1, 0.25), "NAME": (2, 0.5), "BASE": (2, 0.6), "NOTICE": (3, 0.9), "TEXT": (4, 0.95), "TAG": (5, 1.0)}

PARTS = {
    "v": "(?:version |ver |v ?)?",
    "lic": "licen[sc]e",
    "under": "(?:licen[sc]ed|released|distributed|available|published|provided|covered|shared|offered|used) (?:only )?under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?",
    "later": "(?: or (?:at your option )?(?:any )?(?:later|newer)(?: version)?| plus)",
    "id": "license identifier",
    "intl": "(?: international| unported| generic)?",
}

RULES = """
# BASE
mit: {mit} license
apache: {apache} license
gpl: general {public} license

# TAG
mit: {spdx} <id> mit
mit-0: {spdx} <id> mit 0
apache-2.0: {spdx} <id> apache 2 0
apache-1.1: {spdx} <id> apache 1 1
apache-1.0: {spdx} <id> apache 1 0
gpl-1.0-only: {spdx} <id> gpl 1 0(?: only)?
gpl-1.0-or-later: {spdx} <id> gpl 1 0 or later
gpl-2.0-only: {spdx} <id> gpl 2 0(?: only)?
gpl-2.0-or-later: {spdx} <id> gpl 2 0 or later
gpl-3.0-only: {spdx} <id> gpl 3 0(?: only)?
gpl-3.0-or-later: {spdx} <id> gpl 3 0 or later
lgpl-2.0-only: {spdx} <id> lgpl 2 0(?: only)?
lgpl-2.0-or-later: {spdx} <id> lgpl 2 0 or later
lgpl-2.1-only: {spdx} <id> lgpl 2 1(?: only)?
lgpl-2.1-or-later: {spdx} <id> lgpl 2 1 or later
lgpl-3.0-only: {spdx} <id> lgpl 3 0(?: only)?
lgpl-3.0-or-later: {spdx} <id> lgpl 3 0 or later
agpl-3.0-only: {spdx} <id> agpl 3 0(?: only)?
agpl-3.0-or-later: {spdx} <id> agpl 3 0 or later
bsd-1-clause: {spdx} <id> bsd 1 clause
bsd-2-clause: {spdx} <id> bsd 2 clause
bsd-3-clause: {spdx} <id> bsd 3 clause
bsd-4-clause: {spdx} <id> bsd 4 clause
0bsd: {spdx} <id> 0bsd
isc: {spdx} <id> isc
mpl-1.0: {spdx} <id> mpl 1 0
mpl-1.1: {spdx} <id> mpl 1 1
mpl-2.0: {spdx} <id> mpl 2 0
epl-1.0: {spdx} <id> epl 1 0
epl-2.0: {spdx} <id> epl 2 0
eupl-1.1: {spdx} <id> eupl 1 1
eupl-1.2: {spdx} <id> eupl 1 2
cddl-1.0: {spdx} <id> cddl 1 0
cddl-1.1: {spdx} <id> cddl 1 1
cpl-1.0: {spdx} <id> cpl 1 0
artistic-1.0: {spdx} <id> artistic 1 0
artistic-2.0: {spdx} <id> artistic 2 0
zlib: {spdx} <id> zlib
libpng: {spdx} <id> libpng
bsl-1.0: {spdx} <id> bsl 1 0
wtfpl: {spdx} <id> wtfpl
unlicense: {spdx} <id> unlicense
cc0-1.0: {spdx} <id> cc0 1 0
cc-by-3.0: {spdx} <id> cc by 3 0
cc-by-4.0: {spdx} <id> cc by 4 0
cc-by-sa-3.0: {spdx} <id> cc by sa 3 0
cc-by-sa-4.0: {spdx} <id> cc by sa 4 0
cc-by-nc-4.0: {spdx} <id> cc by nc 4 0
cc-by-nc-sa-4.0: {spdx} <id> cc by nc sa 4 0
cc-by-nd-4.0: {spdx} <id> cc by nd 4 0
cc-by-nc-nd-4.0: {spdx} <id> cc by nc nd 4 0
ofl-1.1: {spdx} <id> ofl 1 1
postgresql: {spdx} <id> postgresql
python-2.0: {spdx} <id> python 2 0
php-3.01: {spdx} <id> php 3 01
ruby: {spdx} <id> ruby
openssl: {spdx} <id> openssl
ms-pl: {spdx} <id> ms pl
ms-rl: {spdx} <id> ms rl
odbl-1.0: {spdx} <id> odbl 1 0
pddl-1.0: {spdx} <id> pddl 1 0
sspl-1.0: {spdx} <id> sspl 1 0
busl-1.1: {spdx} <id> busl 1 1
elastic-2.0: {spdx} <id> elastic 2 0
blueoak-1.0.0: {spdx} <id> blueoak 1 0 0
upl-1.0: {spdx} <id> upl 1 0
afl-3.0: {spdx} <id> afl 3 0
osl-3.0: {spdx} <id> osl 3 0
gfdl-1.3: {spdx} <id> gfdl 1 3(?: only| or later)?
vim: {spdx} <id> vim
curl: {spdx} <id> curl
ncsa: {spdx} <id> ncsa
w3c: {spdx} <id> w3c
x11: {spdx} <id> x11

# TEXT
mit: permission is hereby granted free of {charge} to any person obtaining a copy of this software and associated documentation files
mit: the {software} is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit: in no event shall the {authors} or copyright holders be liable for any claim damages or other liability
apache-2.0: you may not use this {file} except in compliance with the license
apache-2.0: you may {obtain} a copy of the license at http www apache org licenses license 2 0
apache-2.0: {unless} required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-1.1: this product includes software developed by the {apache} software foundation
gpl: you can {redistribute} it and or modify it under the terms of the gnu general public license
gpl: without even the implied {warranty} of merchantability or fitness for a particular purpose see the gnu general public license
gpl: you should have {received} a copy of the gnu general public license along with this program
gpl: everyone is permitted to copy and distribute {verbatim} copies of this license document but changing it is not allowed
lgpl: you can {redistribute} it and or modify it under the terms of the gnu (?:lesser|library) general public license
lgpl: you should have {received} a copy of the gnu (?:lesser|library) general public license along with this
agpl-3.0: you can {redistribute} it and or modify it under the terms of the gnu affero general public license
agpl-3.0: you should have {received} a copy of the gnu affero general public license along with this
gfdl: permission is granted to copy distribute and or modify this {document} under the terms of the gnu free documentation license
bsd: redistribution and use in {source} and binary forms with or without modification are permitted
bsd: {redistributions} of source code must retain the above copyright notice
bsd: {redistributions} in binary form must reproduce the above copyright notice
bsd-3-clause: neither the name of [^@]{0,80}nor the names of its {contributors} may be used to endorse or promote products
bsd-4-clause: all {advertising} materials mentioning features or use of this software must display the following acknowledgement
isc: permission to use copy modify and or {distribute} this software for any purpose with or without fee is hereby granted
0bsd: permission to use copy modify and or {distribute} this software for any purpose with or without fee is hereby granted the software is provided as is
zlib: this software is provided as is without any express or {implied} warranty in no event will the authors be held liable
zlib: {altered} source versions must be plainly marked as such
mpl-2.0: this source code form is subject to the terms of the {mozilla} public license v 2 0
mpl-1.1: the contents of this file are subject to the {mozilla} public license version 1 1
mpl-2.0: if a copy of the {mpl} was not distributed with this file you can obtain one at
epl-1.0: this program and the accompanying materials are made available under the terms of the {eclipse} public license v ?1 0
epl-2.0: this program and the accompanying materials are made available under the terms of the {eclipse} public license (?:v ?)?2 0
cddl: the contents of this file are subject to the terms of the common {development} and distribution license
eupl: licensed under the {eupl}(?: version 1 [12])?
bsl-1.0: {boost} software license version 1 0 august 17th 2003
bsl-1.0: permission is hereby granted free of {charge} to any person or organization obtaining a copy of the software and accompanying documentation
unlicense: this is free and {unencumbered} software released into the public domain
unlicense: anyone is free to copy modify publish use {compile} sell or distribute this software
wtfpl: do what the (?:fuck|f ck) you {want} to public license
cc0-1.0: to the extent possible under law [^@]{0,60}has {waived} all copyright and related or neighboring rights
ofl-1.1: this {font} software is licensed under the sil open font license version 1 1
postgresql: permission to use copy modify and distribute this software and its {documentation} for any purpose without fee
artistic-2.0: everyone is permitted to copy and distribute {verbatim} copies of this license document but changing it is not allowed preamble this license establishes
ms-pl: this license {governs} use of the accompanying software if you use the software you accept this license
sspl-1.0: if you make the functionality of the program or a modified version available to third parties as a {service}
busl-1.1: the {licensor} hereby grants you the right to copy modify create derivative works redistribute and make non production use
vim: there are no restrictions on distributing unmodified copies of {vim}
json: the software shall be used for good not {evil}
beerware: if we meet some day and you think this stuff is worth it you can buy me a {beer}
openssl: this product includes software developed by the {openssl} project for use in the openssl toolkit
php: this product includes {php} software freely available from
ijg: this software is based in part on the work of the independent {jpeg} group
public-domain: this (?:work|file|software|code|document) (?:is|has been) (?:hereby )?(?:placed|released|dedicated) (?:in|into|to) the public {domain}
oracle-bcl: oracle {binary} code license agreement

# NOTICE
mit: <under>{mit}(?: <lic>)?
apache-2.0: <under>{apache} (?:software )?(?:<lic> )?(?:version |v ?)?2(?: 0)?
apache-1.1: <under>{apache} (?:software )?<lic> <v>1 1
gpl-2.0-or-later: <under>(?:gnu )?{gpl} <v>2(?: 0)?<later>
gpl-3.0-or-later: <under>(?:gnu )?{gpl} <v>3(?: 0)?<later>
gpl-2.0-only: <under>(?:gnu )?{gpl} <v>2(?: 0)?(?: only)?
gpl-3.0-only: <under>(?:gnu )?{gpl} <v>3(?: 0)?(?: only)?
gpl-2.0-or-later: <under>gnu general {public} <lic> <v>2(?: 0)?<later>
gpl-3.0-or-later: <under>gnu general {public} <lic> <v>3(?: 0)?<later>
gpl-2.0-only: <under>gnu general {public} <lic> <v>2(?: 0)?(?: only)?
gpl-3.0-only: <under>gnu general {public} <lic> <v>3(?: 0)?(?: only)?
lgpl-2.1: <under>(?:gnu )?{lgpl} <v>2 1
lgpl-3.0: <under>(?:gnu )?{lgpl} <v>3(?: 0)?
lgpl-2.1: <under>gnu {lesser} general public <lic> <v>2 1
lgpl-3.0: <under>gnu {lesser} general public <lic> <v>3(?: 0)?
agpl-3.0: <under>(?:gnu )?{agpl}(?: <v>3(?: 0)?)?
agpl-3.0: <under>gnu {affero} general public <lic>(?: <v>3(?: 0)?)?
bsd: <under>(?:a )?{bsd}(?: style)?(?: <lic>)?
bsd-2-clause: <under>(?:2|two) clause {bsd}(?: <lic>)?
bsd-3-clause: <under>(?:3|three) clause {bsd}(?: <lic>)?
bsd-2-clause: <under>{simplified} bsd(?: <lic>)?
bsd-3-clause: <under>(?:new|modified|revised) {bsd}(?: <lic>)?
isc: <under>{isc}(?: <lic>)?
mpl-2.0: <under>{mozilla} public <lic>(?: <v>2(?: 0)?)?
mpl-2.0: <under>{mpl} <v>2(?: 0)?
epl-2.0: <under>{eclipse} public <lic>(?: <v>2(?: 0)?)?
cddl: <under>{cddl}(?: <v>1 [01])?
eupl-1.2: <under>european union {public} <lic>(?: <v>1 2)?
artistic-2.0: <under>{artistic} <lic>(?: <v>2(?: 0)?)?
zlib: <under>{zlib}(?: libpng)?(?: <lic>)?
bsl-1.0: <under>{boost} software <lic>(?: <v>1 0)?
wtfpl: <under>{wtfpl}
unlicense: <under>{unlicense}
ofl-1.1: <under>sil open {font} <lic>(?: <v>1 1)?
cc0-1.0: <under>(?:creative commons )?{cc0}(?: 1 0)?(?: universal)?
cc-by-4.0: <under>{cc} by 4 0
cc-by-3.0: <under>{cc} by 3 0
cc-by-2.0: <under>{cc} by 2 [05]
cc-by-sa-4.0: <under>{cc} by sa 4 0
cc-by-sa-3.0: <under>{cc} by sa 3 0
cc-by-nc-4.0: <under>{cc} by nc 4 0
cc-by-nc-3.0: <under>{cc} by nc 3 0
cc-by-nc-sa-4.0: <under>{cc} by nc sa 4 0
cc-by-nc-sa-3.0: <under>{cc} by nc sa 3 0
cc-by-nd-4.0: <under>{cc} by nd 4 0
cc-by-nc-nd-4.0: <under>{cc} by nc nd 4 0
cc-by: <under>creative commons {attribution}(?: [234] [05])?<intl>(?: <lic>)?
cc-by-sa: <under>creative commons attribution {sharealike}(?: [234] [05])?<intl>(?: <lic>)?
cc-by-sa: <under>creative commons attribution {share} alike(?: [234] [05])?<intl>(?: <lic>)?
cc-by-nc: <under>creative commons attribution {noncommercial}(?: [234] [05])?<intl>(?: <lic>)?
cc-by-nc: <under>creative commons attribution non {commercial}(?: [234] [05])?<intl>(?: <lic>)?
cc-by-nd: <under>creative commons attribution {noderivatives}(?: [234] [05])?<intl>(?: <lic>)?
odbl-1.0: <under>open {database} <lic>
odbl-1.0: <under>{odbl}
ms-pl: <under>{microsoft} public <lic>
sspl-1.0: <under>server side {public} <lic>
elastic-2.0: <under>{elastic} <lic>(?: <v>2(?: 0)?)?
busl-1.1: <under>business {source} <lic>(?: 1 1)?
php-3.01: <under>{php} <lic>(?: <v>3 01)?
python-2.0: <under>{python} software foundation <lic>(?: <v>2(?: 0)?)?
python-2.0: <under>{psf} <lic>
ruby: <under>{ruby} <lic>
postgresql: <under>{postgresql} <lic>
openssl: <under>{openssl} <lic>
vim: <under>{vim} <lic>
public-domain: (?:released|placed|dedicated|published) (?:in|into|to) the public {domain}

# NAME
apache-2.0: {apache} (?:software )?<lic> <v>2(?: 0)?
apache-2.0: {asl} 2 0
gpl-1.0: gnu general {public} <lic> <v>1(?: 0)?
gpl-2.0: gnu general {public} <lic> <v>2(?: 0)?
gpl-3.0: gnu general {public} <lic> <v>3(?: 0)?
gpl: gnu general {public} <lic>
gpl-2.0: {gplv2}<later>?
gpl-3.0: {gplv3}<later>?
gpl-2.0: {gpl} <v>2(?: 0)?
gpl-3.0: {gpl} <v>3(?: 0)?
gpl: gnu {gpl}
lgpl: gnu {lesser} general public <lic>
lgpl: gnu {library} general public <lic>
lgpl-2.1: {lgplv2} 1
lgpl-3.0: {lgplv3}
lgpl: {lgpl}
agpl-3.0: gnu {affero} general public <lic>
agpl-3.0: {agplv3}
agpl-3.0: {agpl}
gfdl: gnu free {documentation} <lic>
gfdl: {gfdl}
bsd-2-clause: {bsd} 2 clause
bsd-3-clause: {bsd} 3 clause
bsd-4-clause: {bsd} 4 clause
bsd-2-clause: freebsd {bsd} <lic>
bsd: {bsd} <lic>
isc: {isc} <lic>
mpl-1.1: {mozilla} public <lic> <v>1 1
mpl-2.0: {mozilla} public <lic> <v>2(?: 0)?
mpl: {mozilla} public <lic>
epl: {eclipse} public <lic>
cpl-1.0: common {public} <lic>
cddl: common {development} and distribution <lic>
eupl: european union {public} <lic>
artistic: {artistic} <lic>
zlib: {zlib} <lic>
libpng: {libpng} <lic>
bsl-1.0: {boost} software <lic>
unlicense: the {unlicense}
ofl: {sil} open font <lic>
ofl: open {font} <lic>
cc0-1.0: {cc0}
cc-by-4.0: {cc} by 4 0
cc-by-3.0: {cc} by 3 0
cc-by-sa-4.0: {cc} by sa 4 0
cc-by-sa-3.0: {cc} by sa 3 0
cc-by-nc-4.0: {cc} by nc 4 0
cc-by-nc-sa-4.0: {cc} by nc sa 4 0
cc-by-nd-4.0: {cc} by nd 4 0
cc-by-nc-nd-4.0: {cc} by nc nd 4 0
cc-by: {creativecommons} org licenses by [1-4] [05]
cc-by-sa: {creativecommons} org licenses by sa [1-4] [05]
cc-by-nc: {creativecommons} org licenses by nc [1-4] [05]
cc-by-nc-sa: {creativecommons} org licenses by nc sa [1-4] [05]
cc-by-nd: {creativecommons} org licenses by nd [1-4] [05]
cc-by-nc-nd: {creativecommons} org licenses by nc nd [1-4] [05]
cc0-1.0: {creativecommons} org publicdomain zero 1 0
cc-by: creative commons {attribution} <lic>
odbl-1.0: open {database} <lic>
odc-by-1.0: open data {commons} attribution <lic>
ms-pl: {microsoft} public <lic>
ms-rl: {microsoft} reciprocal <lic>
sspl-1.0: server side {public} <lic>
busl-1.1: business {source} <lic>
elastic-2.0: {elastic} <lic> 2(?: 0)?
upl-1.0: universal permissive {public} <lic>
afl-3.0: {academic} free <lic>
osl-3.0: open {software} <lic>
ncsa: university of {illinois} open source <lic>
w3c: {w3c} software (?:notice and )?<lic>
x11: {x11} <lic>
mit: {expat} <lic>
mit: opensource org licenses {mit}
apache-2.0: {apache} org licenses license 2 0
gpl: gnu org licenses {gpl}
ntp: {ntp} <lic>
wtfpl: {wtfpl}
beerware: {beerware} <lic>

# HINT
proprietary: all {rights} reserved
proprietary: {proprietary} and confidential
proprietary: {unauthorized} (?:copying|use|reproduction|distribution)
creative-commons: {creative} commons
public-domain: public {domain}
unknown: see (?:the )?{license} file
unknown: {licensed} under
unknown: {licence} agreement
unknown: end user {license} agreement
"""


@dataclass(frozen=True)
class Rule:
    number: int
    kind: str
    label: str
    keyword: str
    pattern: str

    @property
    def priority(self) -> int:
        return KINDS[self.kind][0]

    @property
    def confidence(self) -> float:
        return KINDS[self.kind][1]


def compiled(text: str = RULES) -> list[Rule]:
    """The rules in order; ``@`` stands before the keyword in a pattern, and a pattern begins and ends with a space."""
    out, kind = [], ""
    for line in filter(None, map(str.strip, text.splitlines())):
        if line.startswith("# "):
            kind = line[2:]
            continue
        label, body = line.split(": ", 1)
        keyword = re.search(r"\{([a-z][a-z0-9]*)\}", body)
        for name, part in PARTS.items():
            body = body.replace(f"<{name}>", part)
        if kind not in KINDS or keyword is None or re.search(r"<\w+>", body):
            raise ValueError(f"rule without kind, keyword or part: {line}")
        out.append(Rule(len(out), kind, label, keyword[1], " " + body.replace(keyword[0], "@" + keyword[1]) + " "))
    return out
