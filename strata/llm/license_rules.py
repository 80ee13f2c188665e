r"""Signature rules of the license scan, in order: label, priority and a regular expression over
the words of a text (lower-case letters and digits), one space between.

Priorities: 1 a machine-readable tag, 2 a name with its version, 3 a name or an address,
4 a sentence of a license text or notice, 5 a general remark on rights.  Among rules of one
priority the earlier one goes before the later.
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: Phrases that are always reported, with their labels (fixed values).
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Confidence of a detection by its priority; a base phrase has that of priority 4.
CONFIDENCE = {1: 1.0, 2: 0.95, 3: 0.8, 4: 0.6, 5: 0.3}

_RULES = r"""
gpl-1.0          1  spdx license identifier gpl 1 0(?: only| or later)?
gpl-2.0          1  spdx license identifier gpl 2 0(?: only| or later)?
gpl-3.0          1  spdx license identifier gpl 3 0(?: only| or later)?
lgpl-2.0         1  spdx license identifier lgpl 2 0(?: only| or later)?
lgpl-2.1         1  spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-3.0         1  spdx license identifier lgpl 3 0(?: only| or later)?
agpl-3.0         1  spdx license identifier agpl 3 0(?: only| or later)?
gfdl-1.2         1  spdx license identifier gfdl 1 2(?: only| or later)?
gfdl-1.3         1  spdx license identifier gfdl 1 3(?: only| or later)?
apache-1.1       1  spdx license identifier apache 1 1
apache-2.0       1  spdx license identifier apache 2 0
mit              1  spdx license identifier mit
mit-0            1  spdx license identifier mit 0
x11              1  spdx license identifier x11
isc              1  spdx license identifier isc
0bsd             1  spdx license identifier 0bsd
bsd-2-clause     1  spdx license identifier bsd 2 clause
bsd-3-clause     1  spdx license identifier bsd 3 clause
bsd-4-clause     1  spdx license identifier bsd 4 clause
mpl-1.1          1  spdx license identifier mpl 1 1
mpl-2.0          1  spdx license identifier mpl 2 0
epl-1.0          1  spdx license identifier epl 1 0
epl-2.0          1  spdx license identifier epl 2 0
cddl-1.0         1  spdx license identifier cddl 1 0
cddl-1.1         1  spdx license identifier cddl 1 1
eupl-1.1         1  spdx license identifier eupl 1 1
eupl-1.2         1  spdx license identifier eupl 1 2
artistic-1.0     1  spdx license identifier artistic 1 0
artistic-2.0     1  spdx license identifier artistic 2 0
bsl-1.0          1  spdx license identifier bsl 1 0
unlicense        1  spdx license identifier unlicense
wtfpl            1  spdx license identifier wtfpl
zlib             1  spdx license identifier zlib
libpng           1  spdx license identifier libpng(?: 2 0)?
openssl          1  spdx license identifier openssl
python-2.0       1  spdx license identifier (?:python 2 0|psf 2 0)
postgresql       1  spdx license identifier postgresql
ncsa             1  spdx license identifier ncsa
afl-3.0          1  spdx license identifier afl 3 0
osl-3.0          1  spdx license identifier osl 3 0
ms-pl            1  spdx license identifier ms pl
ms-rl            1  spdx license identifier ms rl
ofl-1.1          1  spdx license identifier ofl 1 1
vim              1  spdx license identifier vim
ruby             1  spdx license identifier ruby
php-3.01         1  spdx license identifier php 3 01
w3c              1  spdx license identifier w3c
curl             1  spdx license identifier curl
icu              1  spdx license identifier icu
unicode-dfs      1  spdx license identifier unicode dfs 201[0-9]
busl-1.1         1  spdx license identifier busl 1 1
sspl-1.0         1  spdx license identifier sspl 1 0
cc0-1.0          1  spdx license identifier cc0 1 0
cc-by-3.0        1  spdx license identifier cc by 3 0
cc-by-4.0        1  spdx license identifier cc by 4 0
cc-by-sa-3.0     1  spdx license identifier cc by sa 3 0
cc-by-sa-4.0     1  spdx license identifier cc by sa 4 0
cc-by-nc-4.0     1  spdx license identifier cc by nc 4 0
cc-by-nd-4.0     1  spdx license identifier cc by nd 4 0
cc-by-nc-sa-4.0  1  spdx license identifier cc by nc sa 4 0
cc-by-nc-nd-4.0  1  spdx license identifier cc by nc nd 4 0
odbl-1.0         1  spdx license identifier odbl 1 0
odc-by-1.0       1  spdx license identifier odc by 1 0
pddl-1.0         1  spdx license identifier pddl 1 0
cdla-permissive  1  spdx license identifier cdla permissive [12] 0
gpl-1.0          2  gnu general public license(?: as published by the free software foundation)?(?: either)? (?:version |v )1(?: 0)?
gpl-2.0          2  gnu general public license(?: as published by the free software foundation)?(?: either)? (?:version |v )2(?: 0)?
gpl-3.0          2  gnu general public license(?: as published by the free software foundation)?(?: either)? (?:version |v )3(?: 0)?
gpl-2.0          2  gnu general public license v2(?: 0)?
gpl-3.0          2  gnu general public license v3(?: 0)?
gpl-2.0          2  version 2 of the gnu general public license
gpl-3.0          2  version 3 of the gnu general public license
gpl-2.0          2  gnu gpl (?:version |v )?2(?: 0)?
gpl-3.0          2  gnu gpl (?:version |v )?3(?: 0)?
gpl-2.0          2  gplv2(?: 0)?
gpl-3.0          2  gplv3(?: 0)?
gpl-2.0          2  gpl 2 0(?: only| or later)?
gpl-3.0          2  gpl 3 0(?: only| or later)?
lgpl-2.0         2  gnu library general public license (?:version |v )?2(?: 0)?
lgpl-2.1         2  gnu lesser general public license (?:version |v )?2 1
lgpl-3.0         2  gnu lesser general public license (?:version |v )?3(?: 0)?
lgpl-2.1         2  version 2 1 of the gnu lesser general public license
lgpl-3.0         2  version 3 of the gnu lesser general public license
lgpl-2.1         2  lgplv2 1
lgpl-3.0         2  lgplv3
lgpl-2.1         2  lgpl 2 1(?: only| or later)?
lgpl-3.0         2  lgpl 3 0(?: only| or later)?
agpl-3.0         2  gnu affero general public license (?:version |v )?3(?: 0)?
agpl-3.0         2  version 3 of the gnu affero general public license
agpl-3.0         2  agplv3
agpl-3.0         2  agpl 3 0(?: only| or later)?
gfdl-1.1         2  gnu free documentation license version 1 1
gfdl-1.2         2  gnu free documentation license version 1 2
gfdl-1.3         2  gnu free documentation license version 1 3
apache-1.0       2  apache (?:software )?license (?:version |v )?1 0
apache-1.1       2  apache (?:software )?license (?:version |v )?1 1
apache-2.0       2  apache (?:software )?license (?:version |v )?2(?: 0)?
apache-2.0       2  apache license v2(?: 0)?
apache-2.0       2  apache 2 0(?: license| licensed)?
apache-2.0       2  apachev2
bsd-2-clause     2  bsd 2 clause(?: license)?
bsd-3-clause     2  bsd 3 clause(?: license)?
bsd-4-clause     2  bsd 4 clause(?: license)?
bsd-2-clause     2  (?:2|two) clause bsd(?: license)?
bsd-3-clause     2  (?:3|three) clause bsd(?: license)?
bsd-4-clause     2  (?:4|four) clause bsd(?: license)?
mpl-1.0          2  mozilla public license (?:version |v )?1 0
mpl-1.1          2  mozilla public license (?:version |v )?1 1
mpl-2.0          2  mozilla public license (?:version |v )?2 0
mpl-1.1          2  mpl 1 1
mpl-2.0          2  mpl 2 0
epl-1.0          2  eclipse public license (?:version |v )?1 0
epl-2.0          2  eclipse public license (?:version |v )?2 0
epl-1.0          2  epl 1 0
epl-2.0          2  epl 2 0
cddl-1.0         2  common development and distribution license (?:cddl )?(?:version |v )?1 0
cddl-1.1         2  common development and distribution license (?:cddl )?(?:version |v )?1 1
cpl-1.0          2  common public license (?:version |v )?1 0
eupl-1.1         2  european union public licen[cs]e (?:version |v )?1 1
eupl-1.2         2  european union public licen[cs]e (?:version |v )?1 2
artistic-1.0     2  artistic license (?:version |v )?1 0
artistic-2.0     2  artistic license (?:version |v )?2 0
bsl-1.0          2  boost software license (?:version |v )?1 0
afl-2.1          2  academic free license (?:version |v )?2 1
afl-3.0          2  academic free license (?:version |v )?3 0
osl-3.0          2  open software license (?:version |v )?3 0
ofl-1.0          2  sil open font license (?:version |v )?1 0
ofl-1.1          2  sil open font license (?:version |v )?1 1
python-2.0       2  python software foundation license version 2
php-3.0          2  php license (?:version |v )?3 0
php-3.01         2  php license (?:version |v )?3 01
zpl-2.1          2  zope public license (?:version |v )?2 1
qpl-1.0          2  q public license (?:version |v )?1 0
lppl-1.3         2  latex project public license (?:version |v )?1 3c?
apsl-2.0         2  apple public source license (?:version |v )?2 0
busl-1.1         2  business source license (?:version |v )?1 1
sspl-1.0         2  server side public license (?:version |v )?1
elastic-2.0      2  elastic license (?:version |v )?2 0
upl-1.0          2  universal permissive license (?:version |v )?1 0
ecl-2.0          2  educational community license (?:version |v )?2 0
cecill-2.1       2  cecill free software license agreement (?:version |v )?2 1
mulan-psl-2.0    2  mulan permissive software license (?:version |v )?2
blueoak-1.0      2  blue oak model license 1 0 0
cc0-1.0          2  cc0 1 0(?: universal)?
cc-by-2.0        2  cc by 2 0
cc-by-2.5        2  cc by 2 5
cc-by-3.0        2  cc by 3 0
cc-by-4.0        2  cc by 4 0
cc-by-sa-2.0     2  cc by sa 2 0
cc-by-sa-2.5     2  cc by sa 2 5
cc-by-sa-3.0     2  cc by sa 3 0
cc-by-sa-4.0     2  cc by sa 4 0
cc-by-nc-3.0     2  cc by nc 3 0
cc-by-nc-4.0     2  cc by nc 4 0
cc-by-nd-3.0     2  cc by nd 3 0
cc-by-nd-4.0     2  cc by nd 4 0
cc-by-nc-sa-3.0  2  cc by nc sa 3 0
cc-by-nc-sa-4.0  2  cc by nc sa 4 0
cc-by-nc-nd-3.0  2  cc by nc nd 3 0
cc-by-nc-nd-4.0  2  cc by nc nd 4 0
cc-by-2.0        2  creative commons attribution 2 0
cc-by-2.5        2  creative commons attribution 2 5
cc-by-3.0        2  creative commons attribution 3 0
cc-by-4.0        2  creative commons attribution 4 0
cc-by-sa-3.0     2  creative commons attribution share(?: )?alike 3 0
cc-by-sa-4.0     2  creative commons attribution share(?: )?alike 4 0
cc-by-nc-4.0     2  creative commons attribution non(?: )?commercial 4 0
cc-by-nd-4.0     2  creative commons attribution (?:noderivs|noderivatives|no derivs|no derivatives) 4 0
cc-by-nc-sa-4.0  2  creative commons attribution non(?: )?commercial share(?: )?alike 4 0
cc-by-nc-nd-4.0  2  creative commons attribution non(?: )?commercial (?:noderivs|noderivatives|no derivs|no derivatives) 4 0
odbl-1.0         2  open database license (?:odbl )?(?:version |v )?1 0
odc-by-1.0       2  open data commons attribution license (?:version |v )?1 0
pddl-1.0         2  public domain dedication and license (?:pddl )?(?:version |v )?1 0
cdla-permissive  2  community data license agreement permissive (?:version )?[12] 0
cdla-sharing     2  community data license agreement sharing (?:version )?1 0
ogl-3.0          2  open government licen[cs]e (?:version |v )?3 0
ogl-3.0          2  open government licen[cs]e v3(?: 0)?
openrail-m       2  (?:creativeml |bigscience )?open(?: )?rail m(?: license)?
lgpl             3  gnu (?:lesser|library) general public licen[cs]e
agpl             3  (?:gnu )?affero general public licen[cs]e
gpl              3  gnu general public licen[cs]e
gpl              3  gnu gpl
gpl              3  gpl licensed?
gpl              3  www gnu org (?:licenses|copyleft) gpl(?: [23] 0)?(?: html| txt)?
lgpl             3  www gnu org (?:licenses|copyleft) (?:lgpl|lesser)(?: [23] [01])?(?: html| txt)?
agpl             3  www gnu org licenses agpl(?: 3 0)?(?: html| txt)?
gfdl             3  gnu free documentation licen[cs]e
apache           3  apache (?:software )?licen[cs]ed?
apache-2.0       3  www apache org licenses license 2 0(?: html| txt)?
mit              3  mit licen[cs]ed?
mit              3  expat licen[cs]e
mit              3  opensource org licenses mit(?: license)?(?: php| html)?
mit              3  (?:the )?mit x11 licen[cs]e
x11              3  x11 licen[cs]e
bsd              3  bsd (?:style )?licen[cs]ed?
bsd              3  opensource org licenses bsd license(?: php)?
bsd-2-clause     3  simplified(?: bsd)? licen[cs]e
bsd-2-clause     3  freebsd(?: bsd)? licen[cs]e
bsd-3-clause     3  (?:new|modified|revised) bsd licen[cs]e
isc              3  isc licen[cs]e
mpl              3  mozilla public licen[cs]e
mpl-2.0          3  mozilla org mpl 2 0
mpl              3  www mozilla org mpl
epl              3  eclipse public licen[cs]e
epl              3  www eclipse org legal epl [a-z0-9]+(?: html)?
cddl             3  common development and distribution licen[cs]e
cpl              3  common public licen[cs]e
eupl             3  european union public licen[cs]e
artistic         3  (?:perl )?artistic licen[cs]e
bsl-1.0          3  boost software licen[cs]e
bsl-1.0          3  www boost org license 1 0 txt
unlicense        3  the unlicense
unlicense        3  unlicense org
wtfpl            3  do what the (?:fuck|f) you want to public licen[cs]e
zlib             3  zlib (?:libpng )?licen[cs]e
libpng           3  libpng licen[cs]e
openssl          3  openssl licen[cs]e
ssleay           3  original ssleay licen[cs]e
python           3  python (?:software foundation )?licen[cs]e
postgresql       3  postgresql licen[cs]e
ncsa             3  (?:university of illinois )?ncsa open source licen[cs]e
afl              3  academic free licen[cs]e
osl              3  open software licen[cs]e
ms-pl            3  microsoft public licen[cs]e
ms-rl            3  microsoft reciprocal licen[cs]e
ofl              3  sil open font licen[cs]e
ofl              3  scripts sil org ofl
vim              3  vim licen[cs]e
ruby             3  ruby licen[cs]e
php              3  php licen[cs]e
zpl              3  zope public licen[cs]e
qpl              3  q public licen[cs]e
lppl             3  latex project public licen[cs]e
apsl             3  apple public source licen[cs]e
w3c              3  w3c software (?:notice and )?licen[cs]e
busl             3  business source licen[cs]e
sspl             3  server side public licen[cs]e
elastic          3  elastic licen[cs]e
commons-clause   3  commons clause license condition
upl              3  universal permissive licen[cs]e
ecl              3  educational community licen[cs]e
cecill           3  cecill (?:free software )?licen[cs]e
intel-acpi       3  intel acpi software licen[cs]e
jpeg             3  independent jpeg group
freetype         3  freetype (?:project )?licen[cs]e
imagemagick      3  imagemagick licen[cs]e
beerware         3  beerware licen[cs]e
beerware         3  beer ware licen[cs]e
cc0              3  creative commons (?:zero|cc0)
cc0              3  creativecommons org publicdomain zero(?: 1 0)?
cc-public-domain 3  creativecommons org publicdomain mark(?: 1 0)?
cc-by            3  cc by
cc-by-sa         3  cc by sa
cc-by-nc         3  cc by nc
cc-by-nd         3  cc by nd
cc-by-nc-sa      3  cc by nc sa
cc-by-nc-nd      3  cc by nc nd
cc-by            3  creativecommons org licenses by(?: [1-4] [05])?
cc-by-sa         3  creativecommons org licenses by sa(?: [1-4] [05])?
cc-by-nc         3  creativecommons org licenses by nc(?: [1-4] [05])?
cc-by-nd         3  creativecommons org licenses by nd(?: [1-4] [05])?
cc-by-nc-sa      3  creativecommons org licenses by nc sa(?: [1-4] [05])?
cc-by-nc-nd      3  creativecommons org licenses by nc nd(?: [1-4] [05])?
cc-by            3  creative commons attribution(?: international)? licen[cs]e
cc-by-sa         3  creative commons attribution share(?: )?alike(?: international)? licen[cs]e
cc               3  creative commons licen[cs]e
odbl             3  open database licen[cs]e
odc-by           3  open data commons attribution
pddl             3  public domain dedication and licen[cs]e
ogl              3  open government licen[cs]e
copyleft-next    3  copyleft next
gpl              4  this program is free software you can redistribute it and or modify it
gpl              4  you should have received a copy of the gnu general public license
lgpl             4  you should have received a copy of the gnu lesser general public license
gpl              4  it under the terms of the gnu general public license
lgpl             4  it under the terms of the gnu lesser general public license
gnu-warranty     4  without even the implied warranty of merchantability or fitness for a particular purpose
apache-2.0       4  you may not use this file except in compliance with the license
apache-2.0       4  unless required by applicable law or agreed to in writing software
apache-2.0       4  licensed to the apache software foundation asf under one or more contributor license agreements
mit              4  permission is hereby granted free of charge to any person obtaining a copy
mit              4  the above copyright notice and this permission notice shall be included in all copies
mit              4  the software is provided as is without warranty of any kind
isc              4  permission to use copy modify and or distribute this software for any purpose with or without fee
bsd              4  redistribution and use in source and binary forms with or without modification are permitted
bsd              4  redistributions of source code must retain the above copyright notice
bsd              4  redistributions in binary form must reproduce the above copyright notice
bsd-3-clause     4  neither the name of [^ ]+(?: [^ ]+){0,7} nor the names of its contributors
bsd-4-clause     4  all advertising materials mentioning features or use of this software must display
bsd              4  this software is provided by the (?:regents|author|copyright holders)(?: and contributors)? as is
mpl-2.0          4  this source code form is subject to the terms of the mozilla public license
epl              4  this program and the accompanying materials are made available under the terms
bsl-1.0          4  distributed under the boost software license
unlicense        4  this is free and unencumbered software released into the public domain
zlib             4  this software is provided as is without any express or implied warranty
wtfpl            4  you just do what the (?:fuck|f) you want to
cc0              4  has waived all copyright and related or neighboring rights
cc-by-nc         4  you may not use the material for commercial purposes
cc-by-nd         4  if you remix transform or build upon the material you may not distribute the modified material
cc-by            4  you must give appropriate credit provide a link to the license
ofl              4  this font software is licensed under the sil open font license
python           4  psf hereby grants licensee a nonexclusive royalty free world wide license
openssl          4  this product includes software developed by the openssl project
public-domain    4  (?:released|placed|dedicated) (?:in|into|to) the public domain
public-domain    4  this (?:work|file|software|document) is in the public domain
eula             4  end user licen[cs]e agreement
commercial       4  commercial licen[cs]e
commercial       4  licen[cs]e key
proprietary      4  proprietary and confidential
proprietary      4  confidential and proprietary
shareware        4  shareware licen[cs]e
rights-reserved  5  all rights reserved
rights-reserved  5  alle rechte vorbehalten
rights-reserved  5  tous droits réservés
rights-reserved  5  todos los derechos reservados
rights-reserved  5  some rights reserved
no-rights        5  no rights reserved
licensed         5  licen[cs]ed under(?: the)?(?: terms)?
licensed         5  released under(?: the)?
licensed         5  distributed under(?: the)?(?: terms)?
licensed         5  available under(?: the)? terms
licensed         5  published under(?: the)?
licensed         5  see the license file
licensed         5  terms of the licen[cs]e
licensed         5  subject to the (?:terms|license)
licensed         5  freigegeben unter
licensed         5  veröffentlicht unter der
licensed         5  publié sous licence
licensed         5  sous licence
licensed         5  bajo la licencia
licensed         5  bajo licencia
licensed         5  lizenziert unter
licensed         5  steht unter der
copyright        5  copyright (?:c )?(?:19|20)[0-9][0-9]
copyright        5  copyright notice
"""


class Rule(NamedTuple):
    rule: int
    label: str
    priority: int
    keywords: tuple[str, ...]
    regex: str


def keywords(pattern: str) -> tuple[str, ...]:
    """Words that every match of a pattern holds, the longest first: plain words outside all groups that
    stay whole whatever the groups beside them match, and whether or not they are there."""
    def mark(m: re.Match) -> str:
        after = pattern[m.end():]
        alone = pattern[:m.start()][-1:] in ("", " ") or not after or after.startswith((" ", "(?: "))
        options = m[1].split("|")
        begins = alone and all(o.startswith(" ") for o in options)
        ends = alone and all(o.endswith(" ") for o in options)
        return " # " if begins and ends else " #" if begins else "# " if ends else "#"

    flat = re.sub(r"\(\?:([^()]*)\)(?:\?|\{[^}]*\})?", mark, pattern)
    words = dict.fromkeys(w for w in flat.split(" ") if re.fullmatch(r"[^?#+*(){}\[\]]+", w))
    return tuple(sorted(words, key=lambda w: -len(w)))


def compiled(pattern: str) -> str:
    """A pattern for texts in which each word has a space of its own before and behind it."""
    return f" {pattern} ".replace(" ", "  ")[1:-1]


def rules(text: str = _RULES) -> list[Rule]:
    out = []
    for line in text.strip().splitlines():
        label, priority, pattern = line.split(None, 2)
        out.append(Rule(len(out), label, int(priority), keywords(pattern), compiled(pattern)))
    return out


RULES = rules()
#: Base phrases have priority 0 and numbers below the other rules'; they take no part in suppression.
BASE_RULES = [Rule(k - len(BASE), label, 0, tuple(phrase.split()), compiled(phrase)) for k, (phrase, label) in enumerate(BASE.items())]
