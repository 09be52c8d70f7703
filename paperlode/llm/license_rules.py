"""Signature rules of the licence scan, in the order of the scan: priority, label, keyword, regex.

A regex is matched against a text's words joined by single spaces (lower case; punctuation is no word, so "Apache-2.0"
reads "apache 2 0") and between word boundaries. Every match holds the keyword. Priority 3: notices, identifiers and
addresses of one licence; 2: a licence named with its version or in full; 1: a passing mention.
"""

TABLE = r"""
3 apache-2 apache spdx license identifier apache 2 0
3 apache-2 apache licensed under the apache license version 2 0
3 apache-2 apache (?:https? )?(?:www )?apache org licenses license 2 0(?: txt| html)?
3 apache-2 apache opensource org licenses? apache 2 0
3 apache-2 apache you may obtain a copy of the license at (?:https? )?(?:www )?apache org licenses
2 apache-2 apache apache (?:software )?license (?:version |v )?2(?: 0)?
2 apache-2 apache apache 2(?: 0)? licen[sc]ed?
2 apache-2 apache apache license,? v2(?: 0)?
2 apache-2 asl (?:the )?asl 2 0
2 apache-1.1 apache apache (?:software )?license (?:version |v )?1 1
2 apache-1.0 apache apache (?:software )?license (?:version |v )?1 0
1 apache apache (?:the )?apache (?:software )?licen[sc]e
3 mit mit spdx license identifier mit
3 mit mit (?:released|licensed|distributed|available) under (?:the )?(?:terms of the )?mit licen[sc]e
3 mit charge permission is hereby granted free of charge to any person obtaining a copy of this software
3 mit noninfringement the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
3 mit mit (?:https? )?(?:www )?opensource org licen[sc]es? mit(?: license)?(?: php)?
3 mit mit choosealicense com licenses mit
2 mit mit (?:the )?mit licen[sc]ed?
2 mit expat expat licen[sc]e
2 mit-0 mit mit no attribution(?: license)?
2 mit-0 mit mit 0 licen[sc]e
2 x11 x11 (?:mit )?x11 licen[sc]e
2 mit-modern mit mit licen[sc]e modern variant
1 mit mit mit style licen[sc]e
3 bsd-3-clause bsd spdx license identifier bsd 3 clause(?: clear)?
3 bsd-2-clause bsd spdx license identifier bsd 2 clause
3 bsd-3-clause endorse neither the name of .{1,80}? nor the names of (?:its|their) contributors may be used to endorse or promote products
3 bsd redistribution redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
3 bsd redistributions redistributions of source code must retain the above copyright notice
3 bsd redistributions redistributions in binary form must reproduce the above copyright notice
3 bsd-3-clause bsd opensource org licenses? bsd 3 clause
3 bsd-2-clause bsd opensource org licenses? bsd 2 clause
3 bsd-4-clause advertising all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment
2 bsd-3-clause bsd (?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: licen[sc]e)?
2 bsd-2-clause bsd (?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)(?: licen[sc]e)
2 bsd-4-clause bsd (?:bsd 4 clause|4 clause bsd|original bsd|old bsd)(?: licen[sc]e)?
2 bsd-1-clause bsd bsd 1 clause(?: licen[sc]e)?
2 0bsd bsd (?:0bsd|zero clause bsd|bsd zero clause)(?: licen[sc]e)?
1 bsd bsd bsd (?:style )?licen[sc]ed?
3 gpl-3 gpl spdx license identifier gpl 3 0(?: only| or later)?
3 gpl-2 gpl spdx license identifier gpl 2 0(?: only| or later)?
3 gpl-1 gpl spdx license identifier gpl 1 0(?: only| or later)?
3 gpl-3 gpl (?:https? )?(?:www )?gnu org licen[sc]es (?:old licenses )?gpl 3 0(?: en)?(?: html| txt)?
3 gpl-2 gpl (?:https? )?(?:www )?gnu org licen[sc]es (?:old licenses )?gpl 2 0(?: en)?(?: html| txt)?
3 gpl-3 gnu (?:licensed|released|distributed) under the (?:terms of the )?gnu general public licen[sc]e,? (?:version|v) ?3
3 gpl-2 gnu (?:licensed|released|distributed) under the (?:terms of the )?gnu general public licen[sc]e,? (?:version|v) ?2
3 gpl redistribute you can redistribute it and or modify it under the terms of the gnu general public license(?: as published by the free software foundation)?
3 gpl-3 foundation free software foundation either version 3 of the license
3 gpl-2 foundation free software foundation either version 2 of the license
3 gpl gnu you should have received a copy of the gnu general public license along with this program
3 gpl gpl (?:https? )?(?:www )?gnu org licen[sc]es gpl(?: html| txt)?
3 gpl merchantability without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license
2 gpl-3 general gnu general public licen[sc]e (?:version |v )?3(?: 0)?(?: or (?:later|any later version))?
2 gpl-3 general gnu general public licen[sc]e v3(?: 0)?(?: or later)?
2 gpl-2 general gnu general public licen[sc]e (?:version |v )?2(?: 0)?(?: or (?:later|any later version))?
2 gpl-2 general gnu general public licen[sc]e v2(?: 0)?(?: or later)?
2 gpl-1 general gnu general public licen[sc]e (?:version |v )?1(?: 0)?
2 gpl-3 gpl (?:gnu )?gpl (?:version |v )?3(?: 0)?(?: or later)?
2 gpl-3 gplv3 (?:gnu )?gplv3(?: or later)?
2 gpl-3 gpl3 (?:gnu )?gpl3
2 gpl-2 gpl (?:gnu )?gpl (?:version |v )?2(?: 0)?(?: or later)?
2 gpl-2 gplv2 (?:gnu )?gplv2(?: or later)?
2 gpl-2 gpl2 (?:gnu )?gpl2
2 gpl-2-classpath classpath gpl(?:v2| 2 0| 2)? with (?:the )?classpath exception
2 gpl-2-classpath classpath classpath exception (?:2 0|to the gpl)
2 gpl-gcc-exception gcc gcc runtime library exception(?: version 3 1| 3 1)?
2 gpl-linking-exception linking gpl linking exception
2 gpl-font-exception font gpl font exception
2 gpl-bison-exception bison bison exception 2 2
1 gpl general gnu general public licen[sc]e
1 gpl gpl (?:the )?(?:gnu )?gpl licen[sc]ed?
1 gpl gpl licensed under (?:the )?(?:gnu )?gpl
3 lgpl-3 lgpl spdx license identifier lgpl 3 0(?: only| or later)?
3 lgpl-2.1 lgpl spdx license identifier lgpl 2 1(?: only| or later)?
3 lgpl-2 lgpl spdx license identifier lgpl 2 0(?: only| or later)?
3 lgpl lesser under the terms of the gnu lesser general public license
3 lgpl lesser you should have received a copy of the gnu lesser general public license
3 lgpl lgpl (?:https? )?(?:www )?gnu org licen[sc]es lgpl(?: html| txt)?
2 lgpl-3 lesser gnu lesser general public licen[sc]e (?:version |v ?)3(?: 0)?
2 lgpl-2.1 lesser gnu lesser general public licen[sc]e (?:version |v ?)2 1
2 lgpl-2 library gnu library general public licen[sc]e(?: (?:version |v ?)2(?: 0)?)?
2 lgpl-3 lgpl (?:gnu )?lgpl ?(?:version |v ?)?3(?: 0)?
2 lgpl-2.1 lgpl (?:gnu )?lgpl ?(?:version |v ?)?2 1
1 lgpl lesser gnu lesser general public licen[sc]e
1 lgpl lgpl (?:the )?lgpl licen[sc]ed?
3 agpl-3 agpl spdx license identifier agpl 3 0(?: only| or later)?
3 agpl-3 affero under the terms of the gnu affero general public license
3 agpl-3 affero you should have received a copy of the gnu affero general public license
3 agpl-3 agpl (?:https? )?(?:www )?gnu org licen[sc]es agpl(?: 3 0)?(?: html| txt)?
2 agpl-3 affero gnu affero general public licen[sc]e (?:version |v ?)3(?: 0)?
2 agpl-1 affero affero general public licen[sc]e (?:version |v ?)1(?: 0)?
2 agpl-3 agpl (?:gnu )?agpl ?(?:version |v ?)?3(?: 0)?
2 agpl-3 agplv3 agplv3(?: or later)?
1 agpl affero (?:gnu )?affero general public licen[sc]e
3 gfdl documentation permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
2 gfdl-1.3 documentation gnu free documentation licen[sc]e (?:version |v ?)1 3
2 gfdl-1.2 documentation gnu free documentation licen[sc]e (?:version |v ?)1 2
1 gfdl documentation gnu free documentation licen[sc]e
1 gfdl gfdl (?:the )?gfdl
3 cc0 cc0 spdx license identifier cc0 1 0
3 cc0 publicdomain creativecommons org publicdomain zero 1 0
3 cc0 cc0 (?:creative commons )?cc0 1 0 universal(?: public domain dedication)?
2 cc0 cc0 cc0 (?:1 0|licen[sc]e|public domain dedication)
2 cc0 waived has waived all copyright and related or neighboring rights
3 cc-pdm publicdomain creativecommons org publicdomain mark 1 0
2 cc-pdm public public domain mark 1 0
3 cc-by creativecommons creativecommons org licenses by [1-4] [05](?: deed(?: en)?| legalcode)?
3 cc-by-sa creativecommons creativecommons org licenses by sa [1-4] [05](?: deed(?: en)?| legalcode)?
3 cc-by-nc creativecommons creativecommons org licenses by nc [1-4] [05](?: deed(?: en)?| legalcode)?
3 cc-by-nd creativecommons creativecommons org licenses by nd [1-4] [05](?: deed(?: en)?| legalcode)?
3 cc-by-nc-sa creativecommons creativecommons org licenses by nc sa [1-4] [05](?: deed(?: en)?| legalcode)?
3 cc-by-nc-nd creativecommons creativecommons org licenses by nc nd [1-4] [05](?: deed(?: en)?| legalcode)?
3 cc-by-nc cc licensed under (?:a )?(?:the )?(?:creative commons )?cc by nc(?: [1-4] [05])?
3 cc-by-nc-sa cc licensed under (?:a )?(?:the )?(?:creative commons )?cc by nc sa(?: [1-4] [05])?
3 cc-by-nc-nd cc licensed under (?:a )?(?:the )?(?:creative commons )?cc by nc nd(?: [1-4] [05])?
3 cc-by-sa cc licensed under (?:a )?(?:the )?(?:creative commons )?cc by sa(?: [1-4] [05])?
3 cc-by-nd cc licensed under (?:a )?(?:the )?(?:creative commons )?cc by nd(?: [1-4] [05])?
3 cc-by cc licensed under (?:a )?(?:the )?(?:creative commons )?cc by(?: [1-4] [05])?
2 cc-by-nc-nd cc cc by nc nd(?: [1-4] [05])?
2 cc-by-nc-sa cc cc by nc sa(?: [1-4] [05])?
2 cc-by-nc cc cc by nc(?: [1-4] [05])?
2 cc-by-nd cc cc by nd(?: [1-4] [05])?
2 cc-by-sa cc cc by sa(?: [1-4] [05])?
2 cc-by cc cc by [1-4] [05]
2 cc-by-nc-nd commons creative commons attribution non ?commercial no ?deriv(?:atives|s)?(?: works)?(?: [1-4] [05])?(?: international| unported)?
2 cc-by-nc-sa commons creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported)?
2 cc-by-nc commons creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported)?
2 cc-by-nd commons creative commons attribution no ?deriv(?:atives|s)?(?: works)?(?: [1-4] [05])?(?: international| unported)?
2 cc-by-sa commons creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported)?
2 cc-by commons creative commons attribution(?: [1-4] [05])?(?: international| unported)?(?: licen[sc]e)?
1 cc commons (?:under )?(?:a |the )?creative commons licen[sc]e
3 mpl-2 mpl spdx license identifier mpl 2 0
3 mpl-2 mozilla this source code form is subject to the terms of the mozilla public license v 2 0
3 mpl-2 mpl (?:https? )?(?:www )?mozilla org mpl 2 0
3 mpl-1.1 mozilla the contents of this file are subject to the mozilla public license version 1 1
2 mpl-2 mozilla mozilla public licen[sc]e (?:version |v ?)?2(?: 0)?
2 mpl-1.1 mozilla mozilla public licen[sc]e (?:version |v ?)?1 1
2 mpl-1.0 mozilla mozilla public licen[sc]e (?:version |v ?)?1 0
2 mpl-2 mpl mpl ?(?:v ?)?2 0
1 mpl mozilla mozilla public licen[sc]e
3 epl-2 epl spdx license identifier epl 2 0
3 epl-1 epl spdx license identifier epl 1 0
3 epl-2 epl (?:https? )?(?:www )?eclipse org legal epl 2 0
3 epl-1 epl (?:https? )?(?:www )?eclipse org legal epl v10(?: html)?
2 epl-2 eclipse eclipse public licen[sc]e (?:version |v ?)?2(?: 0)?
2 epl-1 eclipse eclipse public licen[sc]e (?:version |v ?)?1(?: 0)?
2 edl-1 eclipse eclipse distribution licen[sc]e(?: (?:version |v ?)?1 0)?
1 epl eclipse eclipse public licen[sc]e
2 cddl-1.0 cddl (?:common development and distribution license )?cddl (?:version |v ?)?1 0
2 cddl-1.1 cddl (?:common development and distribution license )?cddl (?:version |v ?)?1 1
1 cddl common common development and distribution licen[sc]e
2 cpl-1 common common public licen[sc]e(?: (?:version |v ?)?1 0)
2 ibmpl ibm ibm public licen[sc]e(?: (?:version |v ?)?1 0)?
2 eupl-1.2 european european union public licen[sc]e (?:version |v ?)?1 2
2 eupl-1.1 european european union public licen[sc]e (?:version |v ?)?1 1
2 eupl-1.2 eupl eupl ?(?:v ?)?1 2
1 eupl european european union public licen[sc]e
3 isc isc spdx license identifier isc
3 isc fee permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
2 isc isc (?:the )?isc licen[sc]e
3 unlicense unencumbered this is free and unencumbered software released into the public domain
3 unlicense unlicense spdx license identifier unlicense
2 unlicense unlicense (?:the )?unlicense(?: org)?
3 wtfpl wtfpl (?:www )?wtfpl net
2 wtfpl wtfpl (?:the )?wtfpl(?: licen[sc]e)?
3 zlib misrepresented the origin of this software must not be misrepresented you must not claim that you wrote the original software
2 zlib zlib (?:the )?zlib(?: libpng)? licen[sc]e
2 libpng libpng (?:the )?libpng licen[sc]e(?: version 2)?
3 boost-1 boost distributed under the boost software license version 1 0
3 boost-1 boost (?:www )?boost org license 1 0 txt
2 boost-1 boost boost software licen[sc]e(?: (?:version |v ?)?1 0)?
3 artistic-2 artistic spdx license identifier artistic 2 0
2 artistic-2 artistic artistic licen[sc]e (?:version |v ?)?2(?: 0)?
2 artistic-1 artistic artistic licen[sc]e (?:version |v ?)?1(?: 0)?
1 artistic artistic (?:the )?artistic licen[sc]e
2 perl perl under the same terms as perl(?: itself)?
3 psf-2 psf spdx license identifier (?:psf 2 0|python 2 0)
2 psf-2 python python software foundation licen[sc]e(?: (?:version |v ?)?2(?: 0)?)?
2 ruby ruby (?:the )?ruby licen[sc]e
2 php-3 php php licen[sc]e (?:version |v ?)?3(?: 0[01]?)?
1 php php (?:the )?php licen[sc]e
2 zpl-2 zope zope public licen[sc]e(?: (?:version |v ?)?2(?: [01])?)?
2 openssl openssl (?:the )?openssl licen[sc]e
2 openldap openldap openldap public licen[sc]e(?: version 2 8)?
2 postgresql postgresql (?:the )?postgresql licen[sc]e
2 ncsa ncsa university of illinois ncsa open source licen[sc]e
2 ncsa ncsa ncsa open source licen[sc]e
2 curl curl (?:the )?curl licen[sc]e
2 w3c w3c w3c (?:software (?:notice and )?)?(?:and document )?licen[sc]e
2 ofl-1.1 ofl (?:sil )?ofl ?(?:version |v ?)?1 1
3 ofl-1.1 sil licensed under the sil open font license version 1 1
2 ofl sil sil open font licen[sc]e(?: (?:version |v ?)?1 [01])?
2 upl-1 universal universal permissive licen[sc]e(?: (?:version |v ?)?1 0)?
2 afl-3 academic academic free licen[sc]e(?: (?:version |v ?)?[123](?: [0-9])?)?
2 osl-3 open open software licen[sc]e(?: (?:version |v ?)?[123](?: [0-9])?)
2 ms-pl microsoft microsoft public licen[sc]e
2 ms-rl microsoft microsoft reciprocal licen[sc]e
2 vim vim (?:the )?vim licen[sc]e
2 tcl tcl tcl tk licen[sc]e
2 x11-distribute x11 x11 distribute modifications variant
2 blueoak-1 blue blue oak model licen[sc]e(?: 1 0 0)?
2 mulan-2 mulan mulan p(?:ermissive )?s(?:oftware )?l(?:icense)? ?(?:v ?)?2
2 cecill-2.1 cecill cecill ?(?:v ?)?2 1
1 cecill cecill cecill [bc]? ?licen[sc]e
2 lppl latex latex project public licen[sc]e(?: (?:version |v ?)?1 3[abc]?)?
2 qpl trolltech q public licen[sc]e trolltech
2 sleepycat sleepycat (?:the )?sleepycat licen[sc]e
2 beerware beer (?:the )?beer ?ware licen[sc]e
2 json evil the software shall be used for good not evil
2 hpnd historical historical permission notice and disclaimer
2 odbl-1 odbl odbl(?: 1 0)?
3 odbl-1 database open database licen[sc]e(?: odbl)?(?: (?:version |v ?)?1 0)?
2 odc-by attribution open data commons attribution licen[sc]e(?: (?:version |v ?)?1 0)?
2 pddl-1 dedication (?:open data commons )?public domain dedication and licen[sc]e
2 cdla-permissive cdla cdla permissive(?: [12] 0)?
2 cdla-permissive community community data licen[sc]e agreement permissive(?: (?:version |v ?)?[12] 0)?
2 cdla-sharing community community data licen[sc]e agreement sharing(?: (?:version |v ?)?1 0)?
2 ogl-uk-3 government open government licen[sc]e (?:version |v ?)?3(?: 0)?
1 ogl-uk government open government licen[sc]e
2 etalab-2 etalab licence ouverte(?: open licence)?(?: etalab)? (?:version |v ?)?2 0 etalab
2 etalab ouverte licence ouverte(?: (?:version |v ?)?[12](?: 0)?)?
3 sspl-1 sspl spdx license identifier sspl 1 0
2 sspl-1 server server side public licen[sc]e(?: (?:version |v ?)?1)?
2 busl-1.1 business business source licen[sc]e(?: (?:version |v ?)?1 1)?
2 elastic-2 elastic elastic licen[sc]e (?:version |v ?)?2(?: 0)?
2 commons-clause clause commons clause licen[sc]e condition(?: v1 0)?
2 polyform-nc polyform polyform noncommercial licen[sc]e(?: 1 0 0)?
2 polyform-sb polyform polyform small business licen[sc]e(?: 1 0 0)?
2 openrail-m openrail (?:big ?science |bigcode |creativeml )?(?:open ?)?openrail(?: m| \+\+ m)?(?: licen[sc]e)?
2 rail rail (?:big ?science |bigcode )?rail licen[sc]e(?: (?:version |v ?)?1 0)?
2 llama-community llama llama [23](?: [0-9])? community licen[sc]e(?: agreement)?
2 gemma-terms gemma gemma terms of use
3 proprietary confidential proprietary and confidential
3 proprietary unauthorized unauthorized (?:copying|reproduction|distribution) of this (?:file|document|work) via any medium is strictly prohibited
1 all-rights-reserved reserved copyright (?:c )?(?:[0-9]{4} )?.{0,60}? ?all rights reserved
2 public-domain domain (?:released|placed|dedicated) (?:in ?to|in) the public domain
1 public-domain domain this (?:work|file|text|document) is in the public domain
"""
