"""Licence signatures, in order of precedence.

One rule a line: ``label level keyword: regex``.  A regex is matched against a
text's words (lower-case, joined by one space) and always covers whole words;
the keyword is a word that every match holds.  Level 1 is a licence's own
wording or identifier, 2 names a licence, 3 only hints at one.
"""

RULES = r"""
mit 1 sublicense: permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)?(?: to deal in the software without restriction)?(?: including without limitation the rights to use copy modify merge publish distribute sublicense)
mit 1 hereby: permission is hereby granted free of charge to any person obtaining a copy
mit 1 mit: spdx license identifier mit
mit 1 mit: (?:released|licensed|distributed|available|published) under (?:the )?(?:terms of the )?mit licen[sc]e
mit 1 mit: licen[sc]e mit
mit 2 mit: (?:the )?mit licen[sc]e
mit 2 expat: expat licen[sc]e
mit 2 mit: mit x11 licen[sc]e
x11 2 x11: x11 licen[sc]e
mit-0 1 mit: spdx license identifier mit 0
mit-0 2 mit: mit no attribution(?: licen[sc]e)?
mit-0 2 mit: mit 0 licen[sc]e
apache-2.0 1 apache: (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of the )?apache licen[sc]e version 2 0
apache-2.0 1 apache: spdx license identifier apache 2 0
apache-2.0 1 apache: apache org licenses license 2 0(?: txt| html)?
apache-2.0 1 apache: you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org
apache-2.0 2 apache: apache licen[sc]e (?:version |v )?2(?: 0)?
apache-2.0 2 apache: apache 2 0 licen[sc]e
apache-2.0 2 asl: asl 2 0
apache-1.1 1 apache: spdx license identifier apache 1 1
apache-1.1 2 apache: apache (?:software )?licen[sc]e (?:version |v )?1 1
apache-1.0 2 apache: apache (?:software )?licen[sc]e (?:version |v )?1 0
apache 2 apache: (?:the )?apache (?:software )?licen[sc]e
apache 3 apache: apache software foundation
gpl-3.0-or-later 1 spdx: spdx license identifier gpl 3 0 or later
gpl-3.0-only 1 spdx: spdx license identifier gpl 3 0(?: only)?
gpl-2.0-or-later 1 spdx: spdx license identifier gpl 2 0 or later
gpl-2.0-only 1 spdx: spdx license identifier gpl 2 0(?: only)?
lgpl-3.0-or-later 1 spdx: spdx license identifier lgpl 3 0 or later
lgpl-3.0-only 1 spdx: spdx license identifier lgpl 3 0(?: only)?
lgpl-2.1-or-later 1 spdx: spdx license identifier lgpl 2 1 or later
lgpl-2.1-only 1 spdx: spdx license identifier lgpl 2 1(?: only)?
lgpl-2.0-only 1 spdx: spdx license identifier lgpl 2 0(?: only)?
agpl-3.0-or-later 1 spdx: spdx license identifier agpl 3 0 or later
agpl-3.0-only 1 spdx: spdx license identifier agpl 3 0(?: only)?
agpl-3.0-only 1 affero: (?:licensed|released|distributed) under (?:the )?(?:terms of the )?(?:gnu )?affero general public licen[sc]e version 3
lgpl-3.0-only 1 lesser: (?:licensed|released|distributed) under (?:the )?(?:terms of the )?(?:gnu )?lesser general public licen[sc]e version 3
lgpl-2.1-only 1 lesser: (?:licensed|released|distributed) under (?:the )?(?:terms of the )?(?:gnu )?lesser general public licen[sc]e version 2 1
lgpl-2.0-only 1 library: (?:licensed|released|distributed) under (?:the )?(?:terms of the )?(?:gnu )?library general public licen[sc]e version 2
gpl-3.0-only 1 general: (?:licensed|released|distributed) under (?:the )?(?:terms of the )?(?:gnu )?general public licen[sc]e version 3
gpl-2.0-only 1 general: (?:licensed|released|distributed) under (?:the )?(?:terms of the )?(?:gnu )?general public licen[sc]e version 2
gpl-3.0-or-later 1 general: gnu general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e or at your option any later version
gpl-2.0-or-later 1 general: gnu general public licen[sc]e as published by the free software foundation either version 2 of the licen[sc]e or at your option any later version
lgpl-3.0-or-later 1 lesser: gnu lesser general public licen[sc]e as published by the free software foundation either version 3
lgpl-2.1-or-later 1 lesser: gnu lesser general public licen[sc]e as published by the free software foundation either version 2 1
agpl-3.0-or-later 1 affero: gnu affero general public licen[sc]e as published by the free software foundation either version 3
agpl-3.0 2 affero: (?:gnu )?affero general public licen[sc]e (?:version |v )?3(?: 0)?
agpl 2 affero: (?:gnu )?affero general public licen[sc]e
agpl-3.0 2 agplv3: (?:gnu )?agplv3
agpl 2 agpl: (?:gnu )?agpl
lgpl-3.0 2 lesser: (?:gnu )?lesser general public licen[sc]e (?:version |v )?3(?: 0)?
lgpl-2.1 2 lesser: (?:gnu )?lesser general public licen[sc]e (?:version |v )?2 1
lgpl 2 lesser: (?:gnu )?lesser general public licen[sc]e
lgpl 2 library: (?:gnu )?library general public licen[sc]e
lgpl-3.0 2 lgplv3: (?:gnu )?lgplv3
lgpl-2.1 2 lgplv2: (?:gnu )?lgplv2 1
lgpl 2 lgpl: (?:gnu )?lgpl
gpl-3.0 2 general: (?:gnu )?general public licen[sc]e (?:version |v )?3(?: 0)?
gpl-2.0 2 general: (?:gnu )?general public licen[sc]e (?:version |v )?2(?: 0)?
gpl-1.0 2 general: (?:gnu )?general public licen[sc]e (?:version |v )?1(?: 0)?
gpl 2 general: (?:gnu )?general public licen[sc]e
gpl-3.0 2 gplv3: (?:gnu )?gplv3
gpl-2.0 2 gplv2: (?:gnu )?gplv2
gpl-3.0 2 gpl: (?:gnu )?gpl (?:version |v )?3(?: 0)?
gpl-2.0 2 gpl: (?:gnu )?gpl (?:version |v )?2(?: 0)?
gpl 2 gpl: (?:gnu )?gpl(?: licen[sc]e)?
gpl-classpath 1 classpath: classpath exception
gpl-gcc 1 gcc: gcc runtime library exception
gfdl-1.3 1 documentation: gnu free documentation licen[sc]e version 1 3
gfdl-1.2 1 documentation: gnu free documentation licen[sc]e version 1 2
gfdl-1.1 1 documentation: gnu free documentation licen[sc]e version 1 1
gfdl 2 documentation: gnu free documentation licen[sc]e
gfdl 2 gfdl: gfdl
bsd-3-clause 1 endorse: neither the name of .{1,120}? nor the names of its contributors may be used to endorse or promote products
bsd-4-clause 1 acknowledgement: all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd-2-clause 1 redistribution: redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-3-clause 1 bsd: spdx license identifier bsd 3 clause
bsd-2-clause 1 bsd: spdx license identifier bsd 2 clause
bsd-4-clause 1 bsd: spdx license identifier bsd 4 clause
0bsd 1 0bsd: spdx license identifier 0bsd
bsd-3-clause 1 bsd: (?:licensed|released|distributed) under (?:the )?(?:terms of the )?(?:3 clause|three clause|new|modified|revised) bsd licen[sc]e
bsd-2-clause 1 bsd: (?:licensed|released|distributed) under (?:the )?(?:terms of the )?(?:2 clause|two clause|simplified) bsd licen[sc]e
bsd-3-clause 2 bsd: (?:3 clause|three clause|new|modified|revised) bsd(?: licen[sc]e)?
bsd-3-clause 2 bsd: bsd (?:3 clause|three clause)(?: licen[sc]e)?
bsd-2-clause 2 bsd: (?:2 clause|two clause|simplified) bsd(?: licen[sc]e)?
bsd-2-clause 2 bsd: bsd (?:2 clause|two clause)(?: licen[sc]e)?
bsd-4-clause 2 bsd: (?:4 clause|four clause|original) bsd(?: licen[sc]e)?
0bsd 2 0bsd: 0bsd
bsd 2 bsd: bsd(?: style)? licen[sc]e
freebsd 2 freebsd: freebsd licen[sc]e
isc 1 isc: spdx license identifier isc
isc 1 fee: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc 2 isc: isc licen[sc]e
mpl-2.0 1 mozilla: this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0
mpl-2.0 1 mpl: spdx license identifier mpl 2 0
mpl-1.1 1 mpl: spdx license identifier mpl 1 1
mpl-2.0 2 mozilla: mozilla public licen[sc]e (?:version |v )?2(?: 0)?
mpl-1.1 2 mozilla: mozilla public licen[sc]e (?:version |v )?1 1
mpl-1.0 2 mozilla: mozilla public licen[sc]e (?:version |v )?1 0
mpl 2 mozilla: mozilla public licen[sc]e
mpl-2.0 2 mpl: mpl (?:version |v )?2(?: 0)?
mpl-1.1 2 mpl: mpl (?:version |v )?1 1
epl-2.0 1 epl: spdx license identifier epl 2 0
epl-1.0 1 epl: spdx license identifier epl 1 0
epl-2.0 2 eclipse: eclipse public licen[sc]e (?:version |v )?2(?: 0)?
epl-1.0 2 eclipse: eclipse public licen[sc]e (?:version |v )?1(?: 0)?
epl 2 eclipse: eclipse public licen[sc]e
edl-1.0 2 eclipse: eclipse distribution licen[sc]e(?: version 1 0| v 1 0)?
cddl-1.1 1 cddl: spdx license identifier cddl 1 1
cddl-1.0 1 cddl: spdx license identifier cddl 1 0
cddl-1.1 2 distribution: common development and distribution licen[sc]e (?:version |v )?1 1
cddl-1.0 2 distribution: common development and distribution licen[sc]e (?:version |v )?1 0
cddl 2 distribution: common development and distribution licen[sc]e
cddl 2 cddl: cddl
cpl-1.0 2 common: common public licen[sc]e(?: version 1 0| v 1 0)?
cpal-1.0 2 attribution: common public attribution licen[sc]e(?: version 1 0| v 1 0)?
ipl-1.0 2 ibm: ibm public licen[sc]e(?: version 1 0| v 1 0)?
eupl-1.2 1 eupl: spdx license identifier eupl 1 2
eupl-1.1 1 eupl: spdx license identifier eupl 1 1
eupl-1.2 2 union: european union public licen[sc]e (?:version |v )?1 2
eupl-1.1 2 union: european union public licen[sc]e (?:version |v )?1 1
eupl 2 union: european union public licen[sc]e
eupl 2 eupl: eupl
artistic-2.0 1 artistic: spdx license identifier artistic 2 0
artistic-2.0 2 artistic: artistic licen[sc]e (?:version |v )?2(?: 0)?
artistic-1.0 2 artistic: artistic licen[sc]e (?:version |v )?1(?: 0)?
artistic 2 artistic: artistic licen[sc]e
zlib 1 zlib: spdx license identifier zlib
zlib 1 misrepresented: the origin of this software must not be misrepresented
zlib 2 zlib: zlib(?: libpng)? licen[sc]e
libpng 2 libpng: libpng licen[sc]e
bsl-1.0 1 bsl: spdx license identifier bsl 1 0
bsl-1.0 1 boost: distributed under the boost software licen[sc]e version 1 0
bsl-1.0 2 boost: boost software licen[sc]e(?: version 1 0| 1 0)?
unlicense 1 unlicense: spdx license identifier unlicense
unlicense 1 unencumbered: this is free and unencumbered software released into the public domain
unlicense 2 unlicense: (?:the )?unlicense
wtfpl 1 wtfpl: spdx license identifier wtfpl
wtfpl 2 wtfpl: wtfpl
wtfpl 2 fuck: do what the fuck you want to public licen[sc]e
cc0-1.0 1 cc0: spdx license identifier cc0 1 0
cc0-1.0 1 cc0: (?:licensed|released|dedicated) under (?:the )?cc0(?: 1 0)?
cc0-1.0 2 cc0: cc0(?: 1 0)?(?: universal)?
cc0-1.0 2 zero: creative commons zero(?: v1 0| 1 0)?
cc0-1.0 1 publicdomain: creativecommons org publicdomain zero 1 0
cc-pdm-1.0 1 publicdomain: creativecommons org publicdomain mark 1 0
cc-by-nc-nd 1 nd: (?:licensed|released|available) under (?:a |the )?cc by nc nd(?: [1-4] 0)?
cc-by-nc-sa 1 sa: (?:licensed|released|available) under (?:a |the )?cc by nc sa(?: [1-4] 0)?
cc-by-nc 1 nc: (?:licensed|released|available) under (?:a |the )?cc by nc(?: [1-4] 0)?
cc-by-nd 1 nd: (?:licensed|released|available) under (?:a |the )?cc by nd(?: [1-4] 0)?
cc-by-sa 1 sa: (?:licensed|released|available) under (?:a |the )?cc by sa(?: [1-4] 0)?
cc-by 1 cc: (?:licensed|released|available) under (?:a |the )?cc by(?: [1-4] 0)?
cc-by-nc-nd-4.0 1 spdx: spdx license identifier cc by nc nd 4 0
cc-by-nc-sa-4.0 1 spdx: spdx license identifier cc by nc sa 4 0
cc-by-nc-4.0 1 spdx: spdx license identifier cc by nc 4 0
cc-by-nd-4.0 1 spdx: spdx license identifier cc by nd 4 0
cc-by-sa-4.0 1 spdx: spdx license identifier cc by sa 4 0
cc-by-4.0 1 spdx: spdx license identifier cc by 4 0
cc-by-sa-3.0 1 spdx: spdx license identifier cc by sa 3 0
cc-by-3.0 1 spdx: spdx license identifier cc by 3 0
cc-by-nc-nd 1 creativecommons: creativecommons org licenses by nc nd [1-4] 0
cc-by-nc-sa 1 creativecommons: creativecommons org licenses by nc sa [1-4] 0
cc-by-nc 1 creativecommons: creativecommons org licenses by nc [1-4] 0
cc-by-nd 1 creativecommons: creativecommons org licenses by nd [1-4] 0
cc-by-sa 1 creativecommons: creativecommons org licenses by sa [1-4] 0
cc-by 1 creativecommons: creativecommons org licenses by [1-4] 0
cc-by-nc-nd 2 noderivatives: (?:creative commons )?attribution noncommercial noderivatives(?: [1-4] 0)?(?: international| unported)?
cc-by-nc-nd 2 noderivs: (?:creative commons )?attribution noncommercial noderivs(?: [1-4] 0)?(?: international| unported)?
cc-by-nc-sa 2 sharealike: (?:creative commons )?attribution noncommercial sharealike(?: [1-4] 0)?(?: international| unported)?
cc-by-nc 2 noncommercial: (?:creative commons )?attribution noncommercial(?: [1-4] 0)?(?: international| unported)?
cc-by-nd 2 noderivatives: (?:creative commons )?attribution noderivatives(?: [1-4] 0)?(?: international| unported)?
cc-by-sa 2 sharealike: (?:creative commons )?attribution sharealike(?: [1-4] 0)?(?: international| unported)?
cc-by 2 attribution: creative commons attribution(?: [1-4] 0)?(?: international| unported)?(?: licen[sc]e)?
cc-by-nc-nd 2 nd: cc by nc nd(?: [1-4] 0)?
cc-by-nc-sa 2 sa: cc by nc sa(?: [1-4] 0)?
cc-by-nc 2 nc: cc by nc(?: [1-4] 0)?
cc-by-nd 2 nd: cc by nd(?: [1-4] 0)?
cc-by-sa 2 sa: cc by sa(?: [1-4] 0)?
cc-by 2 cc: cc by(?: [1-4] 0)?
cc 3 commons: creative commons(?: licen[sc]e)?
odbl-1.0 2 database: open (?:data commons open )?database licen[sc]e(?: v1 0| 1 0)?
odbl-1.0 2 odbl: odbl
odc-by-1.0 2 attribution: open data commons attribution licen[sc]e
pddl-1.0 2 dedication: (?:open data commons )?public domain dedication and licen[sc]e
ogl-uk-3.0 2 government: open government licen[sc]e (?:version |v )?3(?: 0)?
ogl-uk 2 government: open government licen[sc]e
ofl-1.1 1 sil: (?:licensed|released) under the sil open font licen[sc]e version 1 1
ofl-1.1 2 font: (?:sil )?open font licen[sc]e(?: version 1 1| 1 1)?
psf-2.0 2 python: python software foundation licen[sc]e(?: version 2)?
python-2.0 2 python: python licen[sc]e
php-3.01 2 php: php licen[sc]e (?:version |v )?3 01
php 2 php: php licen[sc]e
ruby 2 ruby: ruby licen[sc]e
perl 2 perl: same terms as perl itself
openssl 2 openssl: openssl licen[sc]e
postgresql 2 postgresql: postgresql licen[sc]e
ncsa 2 ncsa: (?:university of illinois )?ncsa open source licen[sc]e
upl-1.0 2 permissive: universal permissive licen[sc]e(?: v 1 0| version 1 0)?
ms-pl 2 microsoft: microsoft public licen[sc]e
ms-rl 2 microsoft: microsoft reciprocal licen[sc]e
osl-3.0 2 open: open software licen[sc]e (?:version |v )?3 0
afl-3.0 2 academic: academic free licen[sc]e (?:version |v )?3 0
afl 2 academic: academic free licen[sc]e
lppl-1.3c 2 latex: latex project public licen[sc]e(?: version)?(?: 1 3c?| 1 2)?
cecill-2.1 2 cecill: cecill(?: free software)?(?: licen[sc]e)?(?: agreement)?(?: version 2 1)?
qpl-1.0 2 q: q public licen[sc]e
sleepycat 2 sleepycat: sleepycat licen[sc]e
vim 2 vim: vim licen[sc]e
w3c 2 w3c: w3c software (?:notice and )?licen[sc]e
beerware 2 beerware: beerware(?: licen[sc]e)?
json 1 evil: the software shall be used for good not evil
sspl-1.0 1 sspl: spdx license identifier sspl 1 0
sspl-1.0 2 server: server side public licen[sc]e(?: v1| version 1)?
elastic-2.0 2 elastic: elastic licen[sc]e (?:version |v )?2(?: 0)?
elastic 2 elastic: elastic licen[sc]e
busl-1.1 2 business: business source licen[sc]e(?: 1 1| version 1 1)?
commons-clause 2 clause: commons clause(?: licen[sc]e)?(?: condition)?
polyform-nc 2 polyform: polyform noncommercial licen[sc]e
openrail 2 openrail: (?:creativeml |bigscience )?openrail(?: m)?(?: licen[sc]e)?
proprietary 1 unauthorized: unauthorized copying of this file via any medium is strictly prohibited
proprietary 2 proprietary: proprietary(?: and confidential| licen[sc]e| software)
all-rights-reserved 3 reserved: all rights reserved
public-domain 2 domain: (?:released into|dedicated to|placed in|in) the public domain
public-domain 3 domain: public domain
copyleft 3 copyleft: copyleft
copyright 3 copyright: copyright (?:c )?(?:19|20)[0-9]{2}
warranty 3 warranty: without warranty of any kind
licence 3 licensed: (?:is |are )?licensed (?:under|to)
licence 3 agreement: (?:end user )?licen[sc]e agreement
"""

#: Phrases whose every place is counted, and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
