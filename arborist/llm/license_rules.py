"""Signature rules for license scans.

A rule is (id, label, keyword, names, regex, priority, relevance). Regexes run
over words of a-z, 0-9 and non-ASCII characters, each with one space before it
and one after the last. A rule is tried only where its keyword stands as a word
and, if it has names, one of them.
"""

from __future__ import annotations

#: Label, how its name is written (a regex over words), and words of which each such name has one.
FAMILIES = (
    ("mit", r"(?:mit|expat)(?: x11)?", "mit expat"),
    ("mit-0", r"mit (?:0|no attribution)", "mit"),
    ("apache-1.1", r"apache(?: software)?(?: license| licence)?(?: version)? 1 1", "apache"),
    ("apache-2", r"apache(?: software)?(?: license| licence)?(?: version| v)? ?2(?: 0)?", "apache"),
    ("bsd-2-clause", r"(?:bsd 2(?: clause)?|(?:2|two) clause bsd|simplified bsd|freebsd)", "bsd freebsd"),
    ("bsd-3-clause", r"(?:bsd 3(?: clause)?|(?:3|three) clause bsd|(?:new|modified|revised) bsd)", "bsd"),
    ("bsd-4-clause", r"(?:bsd 4(?: clause)?|(?:4|four) clause bsd|original bsd)", "bsd"),
    ("0bsd", r"(?:0bsd|zero clause bsd)", "0bsd zero"),
    ("isc", r"isc", "isc"),
    ("gpl-1", r"(?:gnu )?(?:gpl|general public license)(?: version| v)? ?1(?: 0)?", "gpl general"),
    ("gpl-2", r"(?:gnu )?(?:gpl|general public license)(?: version| v)? ?2(?: 0)?", "gpl general"),
    ("gpl-3", r"(?:gnu )?(?:gpl|general public license)(?: version| v)? ?3(?: 0)?", "gpl general"),
    ("lgpl-2", r"(?:gnu )?(?:lgpl|(?:library|lesser) general public license)(?: version| v)? ?2(?: 0)?", "lgpl library lesser"),
    ("lgpl-2.1", r"(?:gnu )?(?:lgpl|(?:library|lesser) general public license)(?: version| v)? ?2 1", "lgpl library lesser"),
    ("lgpl-3", r"(?:gnu )?(?:lgpl|lesser general public license)(?: version| v)? ?3(?: 0)?", "lgpl lesser"),
    ("agpl-3", r"(?:gnu )?(?:agpl|affero general public license)(?: version| v)? ?3(?: 0)?", "agpl affero"),
    ("gfdl-1.3", r"(?:gnu )?(?:gfdl|free documentation license)(?: version| v)? ?1(?: [123])?", "gfdl documentation"),
    ("mpl-1.1", r"(?:mozilla public(?: license)?|mpl)(?: version| v)? ?1(?: [01])?", "mozilla mpl"),
    ("mpl-2", r"(?:mozilla public(?: license)?|mpl)(?: version| v)? ?2(?: 0)?", "mozilla mpl"),
    ("epl-1", r"(?:eclipse public(?: license)?|epl)(?: version| v)? ?1(?: 0)?", "eclipse epl"),
    ("epl-2", r"(?:eclipse public(?: license)?|epl)(?: version| v)? ?2(?: 0)?", "eclipse epl"),
    ("cddl-1", r"(?:common development and distribution(?: license)?|cddl)(?: version| v)?(?: ?1(?: [01])?)?", "development cddl"),
    ("cpl-1", r"common public(?: license)?(?: version| v)? ?1(?: 0)?", "common"),
    ("ms-pl", r"(?:microsoft public|ms pl)", "microsoft ms"),
    ("ms-rl", r"(?:microsoft reciprocal|ms rl)", "microsoft ms"),
    ("artistic-1", r"artistic(?: license)?(?: version| v)? ?1(?: 0)?", "artistic"),
    ("artistic-2", r"artistic(?: license)?(?: version| v)? ?2(?: 0)?", "artistic"),
    ("zlib", r"(?:zlib(?: libpng)?|libpng)", "zlib libpng"),
    ("boost-1", r"(?:boost software(?: license)?|bsl)(?: version| v)? ?1(?: 0)?", "boost bsl"),
    ("unlicense", r"unlicense", "unlicense"),
    ("wtfpl", r"wtfpl", "wtfpl"),
    ("psf-2", r"(?:psf|python software foundation)(?: license)?(?: version| v)?(?: ?2(?: 0)?)?", "psf python"),
    ("postgresql", r"postgresql", "postgresql"),
    ("openssl", r"openssl", "openssl"),
    ("php-3", r"php(?: license)?(?: version| v)? ?3(?: 0[01]?)?", "php"),
    ("ruby", r"ruby", "ruby"),
    ("eupl-1.2", r"(?:european union public(?: licen[cs]e)?|eupl)(?: version| v)? ?1(?: [12])?", "european eupl"),
    ("osl-3", r"(?:open software|osl)(?: license)?(?: version| v)? ?3(?: 0)?", "open osl"),
    ("afl-3", r"(?:academic free|afl)(?: license)?(?: version| v)? ?3(?: 0)?", "academic afl"),
    ("ofl-1.1", r"(?:sil open font|ofl)(?: license)?(?: version| v)? ?1(?: 1)?", "sil ofl"),
    ("ncsa", r"(?:university of illinois ncsa(?: open source)?|ncsa)", "illinois ncsa"),
    ("upl-1", r"(?:universal permissive|upl)(?: license)?(?: version| v)? ?1(?: 0)?", "universal upl"),
    ("odbl-1", r"(?:open database|odbl)(?: license)?(?: version| v)?(?: ?1(?: 0)?)?", "open odbl"),
    ("pddl-1", r"(?:public domain dedication and license|pddl)", "public pddl"),
    ("cc0-1", r"(?:cc0|creative commons zero)(?: 1(?: 0)?)?", "cc0 creative"),
    ("cc-by", r"(?:cc by|creative commons attribution)(?: [1-4](?: [05])?)?(?: international| unported)?", "cc creative"),
    ("cc-by-sa", r"(?:cc by sa|creative commons attribution share ?alike)(?: [1-4](?: [05])?)?(?: international| unported)?", "cc creative"),
    ("cc-by-nd", r"(?:cc by nd|creative commons attribution no ?deriv(?:s|atives))(?: [1-4](?: [05])?)?(?: international| unported)?", "cc creative"),
    ("cc-by-nc", r"(?:cc by nc|creative commons attribution non ?commercial)(?: [1-4](?: [05])?)?(?: international| unported)?", "cc creative"),
    ("cc-by-nc-sa", r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: [1-4](?: [05])?)?(?: international| unported)?", "cc creative"),
    ("cc-by-nc-nd", r"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:s|atives))(?: [1-4](?: [05])?)?(?: international| unported)?", "cc creative"),
    ("proprietary", r"(?:proprietary|commercial)", "proprietary commercial"),
)

#: Keyword, regex with {} for the name, priority, relevance. Earlier forms outrank later ones.
FORMS = (
    ("spdx", r"spdx license identifier {}(?: only| or later)?", 9, 1.0),
    ("licensed", r"(?:dual |re)?licensed under(?: the)?(?: terms of(?: the)?)? {}(?: licen[sc]e)?", 8, 1.0),
    ("released", r"released under(?: the)?(?: terms of(?: the)?)? {}(?: licen[sc]e)?", 8, 1.0),
    ("distributed", r"distributed under(?: the)?(?: terms of(?: the)?)? {}(?: licen[sc]e)?", 8, 1.0),
    ("available", r"(?:made )?available under(?: the)?(?: terms of(?: the)?)? {}(?: licen[sc]e)?", 7, 0.9),
    ("subject", r"subject to(?: the)?(?: terms of(?: the)?)? {}(?: licen[sc]e)?", 6, 0.9),
    ("license", r"(?:the )?{} license", 5, 0.8),
    ("licence", r"(?:the )?{} licence", 5, 0.8),
    ("license", r"license (?:type |name )?{}", 4, 0.7),
)

#: Whole texts and notices that name no family form.
SINGLE = (
    ("mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy", 9, 1.0),
    ("isc", "permission", r"permission to use copy modify and or distribute this software for any purpose with or without fee", 9, 1.0),
    ("bsd-3-clause", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted", 8, 0.9),
    ("apache-2", "apache", r"(?:www )?apache org licenses license 2 0", 9, 1.0),
    ("gpl-3", "gnu", r"(?:www )?gnu org licenses gpl(?: 3 0)?", 8, 0.9),
    ("lgpl-3", "gnu", r"(?:www )?gnu org licenses lgpl(?: 3 0)?", 8, 0.9),
    ("agpl-3", "gnu", r"(?:www )?gnu org licenses agpl(?: 3 0)?", 8, 0.9),
    ("mpl-2", "mozilla", r"mozilla org mpl 2 0", 9, 1.0),
    ("mit", "opensource", r"opensource org licenses mit", 9, 1.0),
    ("cc-by", "creativecommons", r"creativecommons org licenses by [1-4] [05]", 9, 1.0),
    ("cc-by-sa", "creativecommons", r"creativecommons org licenses by sa [1-4] [05]", 9, 1.0),
    ("cc-by-nd", "creativecommons", r"creativecommons org licenses by nd [1-4] [05]", 9, 1.0),
    ("cc-by-nc", "creativecommons", r"creativecommons org licenses by nc [1-4] [05]", 9, 1.0),
    ("cc-by-nc-sa", "creativecommons", r"creativecommons org licenses by nc sa [1-4] [05]", 9, 1.0),
    ("cc-by-nc-nd", "creativecommons", r"creativecommons org licenses by nc nd [1-4] [05]", 9, 1.0),
    ("cc0-1", "creativecommons", r"creativecommons org publicdomain zero 1 0", 9, 1.0),
    ("gpl", "gnu", r"gnu general public license", 2, 0.6),
    ("lgpl", "gnu", r"gnu (?:lesser|library) general public license", 2, 0.6),
    ("agpl", "gnu", r"gnu affero general public license", 2, 0.6),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 9, 1.0),
    ("public-domain", "domain", r"(?:released|placed|dedicated|is) (?:into|in|to) the public domain", 6, 0.8),
    ("all-rights-reserved", "rights", r"(?:copyright(?: [^ ]+){0,8} )?all rights reserved", 3, 0.6),
    ("mit", "sublicense", r"use copy modify merge publish distribute sublicense and or sell copies of the software", 8, 0.9),
    ("mit", "substantial", r"shall be included in all copies or substantial portions of the software", 7, 0.8),
    ("bsd-2-clause", "redistributions", r"redistributions of source code must retain the above copyright notice", 7, 0.8),
    ("bsd-2-clause", "redistributions", r"redistributions in binary form must reproduce the above copyright notice", 7, 0.8),
    ("bsd-3-clause", "endorse", r"may be used to endorse or promote products derived from this software", 8, 0.9),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display", 9, 1.0),
    ("apache-2", "apache", r"you may not use this file except in compliance with the license(?: you may obtain a copy)?(?: of the license)?(?: at)?(?: http)?(?: www)? apache", 9, 1.0),
    ("apache-2", "compliance", r"you may not use this file except in compliance with the license", 4, 0.7),
    ("apache-2", "governing", r"see the license for the specific language governing permissions and limitations under the license", 5, 0.8),
    ("apache-1.1", "apache", r"this product includes software developed by the apache software foundation", 8, 0.9),
    ("gpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public license", 8, 0.9),
    ("gpl-2", "redistribute", r"terms of the gnu general public license as published by the free software foundation (?:either )?version 2(?: of the license)?", 9, 1.0),
    ("gpl-2", "gnu", r"gnu general public license as published by the free software foundation (?:either )?version 2(?: of the license)?", 9, 1.0),
    ("gpl-3", "gnu", r"gnu general public license as published by the free software foundation (?:either )?version 3(?: of the license)?", 9, 1.0),
    ("lgpl-2.1", "gnu", r"gnu lesser general public license as published by the free software foundation (?:either )?version 2 1(?: of the license)?", 9, 1.0),
    ("lgpl-3", "gnu", r"gnu lesser general public license as published by the free software foundation (?:either )?version 3(?: of the license)?", 9, 1.0),
    ("agpl-3", "gnu", r"gnu affero general public license as published by the free software foundation (?:either )?version 3(?: of the license)?", 9, 1.0),
    ("gpl", "gnu", r"you should have received a copy of the gnu general public license(?: along with this program)?", 7, 0.8),
    ("lgpl", "gnu", r"you should have received a copy of the gnu (?:lesser|library) general public license(?: along with this library)?", 7, 0.8),
    ("agpl", "gnu", r"you should have received a copy of the gnu affero general public license(?: along with this program)?", 7, 0.8),
    ("gpl", "merchantability", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license", 6, 0.8),
    ("gfdl", "documentation", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 9, 1.0),
    ("mpl-2", "mozilla", r"this source code form is subject to the terms of the mozilla public license(?: v(?:ersion)?)? 2 0", 9, 1.0),
    ("mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public license version 1 1", 9, 1.0),
    ("mpl-2", "incompatible", r"incompatible with secondary licenses as defined by the mozilla public license", 8, 0.9),
    ("epl-1", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license v(?:ersion)? ?1 0", 9, 1.0),
    ("epl-2", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license v(?:ersion)? ?2 0", 9, 1.0),
    ("cddl-1", "cddl", r"the contents of this file are subject to the terms of the common development and distribution license", 9, 1.0),
    ("cddl-1", "distribution", r"subject to the terms of the common development and distribution license", 8, 0.9),
    ("cpl-1", "common", r"accompanying materials are made available under the terms of the common public license v(?:ersion)? ?1 0", 9, 1.0),
    ("artistic-2", "perl", r"this (?:program|library|module) is free software you can redistribute it and or modify it under the same terms as perl(?: itself)?", 8, 0.8),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented", 9, 1.0),
    ("zlib", "altered", r"altered source versions must be plainly marked as such", 9, 1.0),
    ("boost-1", "boost", r"distributed under the boost software license version 1 0", 9, 1.0),
    ("boost-1", "boost", r"(?:www )?boost org license 1 0(?: txt)?", 9, 1.0),
    ("unlicense", "unlicense", r"(?:please refer to )?(?:http|https) unlicense org", 9, 1.0),
    ("wtfpl", "fuck", r"do what the fuck you want to public license", 9, 1.0),
    ("psf-2", "python", r"python software foundation license version 2", 9, 1.0),
    ("postgresql", "postgresql", r"postgresql database management system(?: formerly known as postgres)?", 5, 0.6),
    ("openssl", "openssl", r"this product includes software developed by the openssl project", 9, 1.0),
    ("php-3", "php", r"this (?:source file|product) (?:is subject to version 3 01 of the php license|includes php software)", 9, 1.0),
    ("ruby", "ruby", r"ruby is copyrighted free software", 9, 1.0),
    ("eupl-1.2", "eupl", r"licensed under the eupl(?: version)? 1 2(?: or as soon they will be approved)?", 9, 1.0),
    ("osl-3", "osl", r"licensed under the open software license version 3 0", 9, 1.0),
    ("afl-3", "academic", r"licensed under the academic free license version 3 0", 9, 1.0),
    ("ofl-1.1", "sil", r"this font software is licensed under the sil open font license version 1 1", 9, 1.0),
    ("ofl-1.1", "reserved", r"with reserved font name", 6, 0.7),
    ("ncsa", "illinois", r"university of illinois ncsa open source license", 9, 1.0),
    ("odbl-1", "opendatacommons", r"opendatacommons org licenses odbl(?: 1 0)?", 9, 1.0),
    ("pddl-1", "opendatacommons", r"opendatacommons org licenses pddl(?: 1 0)?", 9, 1.0),
    ("odc-by-1", "opendatacommons", r"opendatacommons org licenses by(?: 1 0)?", 9, 1.0),
    ("cc-by", "creative", r"this work is licensed under a creative commons attribution [1-4] [05](?: international| unported)? license", 9, 1.0),
    ("cc-by-sa", "creative", r"this work is licensed under a creative commons attribution share ?alike [1-4] [05](?: international| unported)? license", 9, 1.0),
    ("cc-by-nd", "creative", r"this work is licensed under a creative commons attribution no ?deriv(?:s|atives) [1-4] [05](?: international| unported)? license", 9, 1.0),
    ("cc-by-nc", "creative", r"this work is licensed under a creative commons attribution non ?commercial [1-4] [05](?: international| unported)? license", 9, 1.0),
    ("cc0-1", "cc0", r"to the extent possible under law (?:the author|[^ ]+)(?: [^ ]+){0,4} has waived all copyright and related or neighboring rights", 9, 1.0),
    ("cc0-1", "waived", r"has waived all copyright and related or neighboring rights", 8, 0.9),
    ("public-domain", "domain", r"this (?:work|file|software|code) is in the public domain", 7, 0.9),
    ("public-domain", "copyright", r"no copyright is claimed", 5, 0.7),
    ("proprietary", "confidential", r"confidential and proprietary(?: information)?", 4, 0.6),
    ("proprietary", "permission", r"(?:may not be )?reproduced (?:or distributed )?without (?:the )?(?:prior )?(?:written )?permission", 4, 0.6),
    ("proprietary", "unauthorized", r"unauthorized (?:copying|reproduction|distribution|use)(?: of this file)? (?:via any medium )?is strictly prohibited", 5, 0.7),
    ("non-commercial", "commercial", r"for non ?commercial use only", 5, 0.7),
    ("sspl-1", "server", r"server side public license(?: version)?(?: 1)?", 8, 0.9),
    ("busl-1.1", "business", r"business source license(?: version)?(?: 1 1)?", 8, 0.9),
    ("elastic-2", "elastic", r"elastic license(?: version)?(?: 2(?: 0)?)?", 8, 0.9),
    ("beerware", "beer", r"beer ?ware license(?: revision 42)?", 8, 0.9),
    ("json", "evil", r"the software shall be used for good not evil", 9, 1.0),
    ("x11", "consortium", r"x consortium license", 7, 0.8),
    ("curl", "curl", r"curl license", 6, 0.7),
    ("imagemagick", "imagemagick", r"imagemagick license", 6, 0.8),
    ("icu", "icu", r"icu license", 6, 0.8),
    ("unicode-dfs", "unicode", r"unicode (?:inc )?license agreement data files and software", 9, 1.0),
    ("w3c", "w3c", r"w3c software(?: notice)?(?: and)?(?: document)? license", 8, 0.9),
    ("vim", "vim", r"vim license", 6, 0.7),
    ("rail", "responsible", r"(?:open |creativeml )?responsible ai license", 8, 0.9),
    ("llama", "community", r"llama(?: [23](?: [0-9])?)? community license(?: agreement)?", 8, 0.9),
    ("warranty-disclaimer", "warranty", r"(?:provided )?as is without warranty of any kind", 1, 0.3),
)

#: The most words that one match may span, with room to spare.
MOST_WORDS = 24


def rules() -> list[tuple[int, str, str, list[str], str, int, float]]:
    """All rules in order; a lower id wins a tie."""
    made = [(label, key, [], regex, priority, sure) for label, key, regex, priority, sure in SINGLE]
    made += [(label, key, names.split(), form.replace("{}", name), priority, sure) for key, form, priority, sure in FORMS for label, name, names in FAMILIES]
    return [(i, label, key, names, f" {regex}(?= )", priority, sure) for i, (label, key, names, regex, priority, sure) in enumerate(made)]
