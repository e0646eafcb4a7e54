"""Operator 3: license scans by ordered signature rules.

A text is lower-cased and cut into words. Rules are regular expressions over the words, each with a label, a priority
and keywords; only texts that hold one of a rule's keywords are searched with it. Where detections lie inside one
another, the one of higher priority stays (at equal priority the longer one, then the one named first). The base phrases
are rules too, and are always reported.

Everything here is made of DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Phrases that are always reported, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# In patterns signs are blanks, ~ is a blank that may be missing, and keywords are words of which every match holds one.
#: label, name (a pattern of words), versions that may follow, keywords.
FAMILIES = [
    ("gpl", "(?:gnu )?(?:general public license|gpl)", "1 0|2 0|3 0|1|2|3", "general gpl"),
    ("lgpl", "(?:gnu )?(?:lesser|library) general public license|(?:gnu )?lgpl", "2 0|2 1|3 0|2|3", "lesser library lgpl"),
    ("agpl", "(?:gnu )?affero general public license|(?:gnu )?agpl", "1 0|3 0|3", "affero agpl"),
    ("gfdl", "(?:gnu )?free documentation license|gfdl", "1 1|1 2|1 3", "documentation gfdl"),
    ("apache", "apache(?: software)?(?: license)?", "1 0|1 1|2 0|2", "apache"),
    ("mit", "(?:mit|expat)(?: license)?", "0", "mit expat"),
    ("bsd", "(?:new |modified |simplified |revised )?bsd(?: license)?", "2 clause|3 clause|4 clause|0 clause", "bsd"),
    ("isc", "isc license", "", "isc"),
    ("mpl", "mozilla public license|mpl", "1 0|1 1|2 0", "mozilla mpl"),
    ("epl", "eclipse public license|epl", "1 0|2 0", "eclipse epl"),
    ("edl", "eclipse distribution license", "1 0", "eclipse"),
    ("cddl", "common development and distribution license|cddl", "1 0|1 1", "development cddl"),
    ("cpl", "common public license", "1 0", "common"),
    ("eupl", "european union public licen[cs]e|eupl", "1 0|1 1|1 2", "european eupl"),
    ("artistic", "(?:perl )?artistic license", "1 0|2 0", "artistic"),
    ("zlib", "zlib(?: libpng)? license", "", "zlib"),
    ("boost", "boost software license", "1 0", "boost"),
    ("wtfpl", "do what the fuck you want to public license|wtfpl", "2", "fuck wtfpl"),
    ("unlicense", "the unlicense", "", "unlicense"),
    ("psf", "python software foundation license|psf license", "2", "python psf"),
    ("ruby", "ruby license", "", "ruby"),
    ("openssl", "openssl license", "", "openssl"),
    ("ofl", "(?:sil )?open font license|ofl", "1 0|1 1", "font ofl"),
    ("ms-pl", "microsoft public license|ms pl", "", "microsoft ms"),
    ("ms-rl", "microsoft reciprocal license|ms rl", "", "reciprocal ms"),
    ("odbl", "open (?:data commons )?(?:open )?database license|odbl", "1 0", "database odbl"),
    ("pddl", "public domain dedication and license|pddl", "1 0", "dedication pddl"),
    ("osl", "open software license|osl", "1 0|2 0|2 1|3 0", "software osl"),
    ("afl", "academic free license|afl", "1 2|2 0|2 1|3 0", "academic afl"),
    ("ecl", "educational community license|ecl", "1 0|2 0", "educational ecl"),
    ("ncsa", "university of illinois ncsa open source license|ncsa license", "", "ncsa"),
    ("postgresql", "postgresql license", "", "postgresql"),
    ("vim", "vim license", "", "vim"),
    ("beerware", "beer ware license|beerware license", "42", "ware beerware"),
    ("cecill", "cecill(?: free software license agreement)?(?: license)?", "1 0|2 0|2 1", "cecill"),
    ("qpl", "q public license|qpl", "1 0", "q qpl"),
    ("upl", "universal permissive license|upl", "1 0", "universal upl"),
    ("w3c", "w3c software (?:notice and )?license", "", "w3c"),
    ("curl", "curl license", "", "curl"),
    ("x11", "x11 license", "", "x11"),
    ("sspl", "server side public license|sspl", "1", "sspl server"),
    ("busl", "business source license|busl", "1 1", "business busl"),
    ("elastic", "elastic license", "1 0|2 0", "elastic"),
    ("commons-clause", "commons clause(?: license condition)?", "1 0", "clause"),
    ("polyform", "polyform (?:noncommercial|shield|strict|small business|perimeter) license", "1 0 0", "polyform"),
    ("openrail", "(?:creativeml )?open~rail(?: m)?(?: license)?", "", "openrail rail"),
    ("llama", "llama (?:2 |3 )?community license", "", "llama"),
    ("cc-by", "(?:creative commons attribution(?: international)?|cc by)", "1 0|2 0|2 5|3 0|4 0", "creative cc"),
    ("cc-by-sa", "(?:creative commons attribution share~alike|cc by sa)", "1 0|2 0|2 5|3 0|4 0", "creative cc"),
    ("cc-by-nc", "(?:creative commons attribution non~commercial|cc by nc)", "1 0|2 0|2 5|3 0|4 0", "creative cc"),
    ("cc-by-nd", "(?:creative commons attribution no~deriv(?:ative)?s|cc by nd)", "1 0|2 0|2 5|3 0|4 0", "creative cc"),
    ("cc-by-nc-sa", "(?:creative commons attribution non~commercial share~alike|cc by nc sa)", "1 0|2 0|2 5|3 0|4 0", "creative cc"),
    ("cc-by-nc-nd", "(?:creative commons attribution non~commercial no~deriv(?:ative)?s|cc by nc nd)", "1 0|2 0|2 5|3 0|4 0", "creative cc"),
    ("cc0", "(?:creative commons zero|cc0|cc zero)", "1 0", "zero cc0"),
]
#: form, its words around the family's name ({n}), priority.
FORMS = [
    ("tag", "spdx license identifier {n}", 5),
    ("grant", "(?:licensed|released|distributed|available|published|provided|redistributed|covered) (?:by|under)(?: the)?(?: terms)?(?: of)?(?: the)? {n}", 4),
    ("subject", "(?:subject to|governed by|in accordance with|compliance with)(?: the)?(?: terms)?(?: of)?(?: the)? {n}", 3),
    ("header", "(?:license|licence) {n}", 2),
]
#: Full names and short identifiers wherever they stand, with versions glued on or not: label, pattern, keywords.
NAMES = [
    ("gpl", "gnu gpl|gnu general public licen[cs]e", "gnu"),
    ("gpl", "gpl~v?[123](?: 0)?(?: plus| only| or later)?", "gpl gplv1 gplv2 gplv3 gpl1 gpl2 gpl3"),
    ("gpl", "general public license(?: version| v)? [123](?: 0)?", "general"),
    ("lgpl", "gnu l(?:esser|ibrary) general public licen[cs]e", "lesser library"),
    ("lgpl", "lgpl~v?(?:2 0|2 1|3 0|2|3)(?: only| or later)?", "lgpl lgplv2 lgplv3 lgpl2 lgpl3"),
    ("agpl", "gnu affero general public licen[cs]e", "affero"),
    ("agpl", "agpl~v?[13](?: 0)?(?: only| or later)?", "agpl agplv1 agplv3 agpl1 agpl3"),
    ("gfdl", "gnu free documentation licen[cs]e", "documentation"),
    ("gfdl", "gfdl~v?1 [123](?: only| or later| invariants)?", "gfdl gfdlv1 gfdl1"),
    ("apache", "apache~v?(?:1 0|1 1|2 0|2)", "apache apachev2 apachev1 apache2"),
    ("apache", "apache software licen[cs]e", "apache"),
    ("apache", "asl~v?2 0", "asl aslv2 asl2"),
    ("bsd", "bsd~[01234] clause(?: patent| clear| lbnl| views| attribution)?", "bsd bsd1 bsd2 bsd3 bsd4 bsd0"),
    ("bsd", "(?:two|three|four|[234]) clause bsd(?: licen[cs]e)?", "bsd"),
    ("bsd", "(?:new|modified|simplified|revised|original|free) bsd licen[cs]e", "bsd"),
    ("bsd", "bsd style licen[cs]e", "bsd"),
    ("bsd", "bsd licen[cs]e", "bsd"),
    ("bsd", "0bsd", "0bsd"),
    ("mit", "mit 0|mit no attribution", "mit"),
    ("mit", "mit style licen[cs]e", "mit"),
    ("mit", "expat licen[cs]e", "expat"),
    ("isc", "isc licen[cs]e", "isc"),
    ("mpl", "mozilla public licen[cs]e", "mozilla"),
    ("mpl", "mpl~v?(?:1 0|1 1|2 0|2)(?: no copyleft exception)?", "mpl mplv1 mplv2 mpl1 mpl2"),
    ("epl", "eclipse public licen[cs]e", "eclipse"),
    ("epl", "epl~v?[12] 0", "epl eplv1 eplv2 epl1 epl2"),
    ("cddl", "common development and distribution licen[cs]e", "development"),
    ("cddl", "cddl~v?1 [01]", "cddl cddlv1 cddl1"),
    ("cpl", "common public licen[cs]e", "common"),
    ("cpl", "cpl 1 0", "cpl"),
    ("ipl", "ibm public licen[cs]e|ipl 1 0", "ibm ipl"),
    ("eupl", "european union public licen[cs]e", "european"),
    ("eupl", "eupl~v?1 [012]", "eupl euplv1 eupl1"),
    ("artistic", "artistic(?: licen[cs]e)? [12] 0(?: perl| cl8)?", "artistic"),
    ("zlib", "zlib licen[cs]e|zlib acknowledgement", "zlib"),
    ("libpng", "libpng(?: licen[cs]e| 2 0)", "libpng"),
    ("boost", "boost software licen[cs]e|bsl 1 0", "boost bsl"),
    ("wtfpl", "do what the fuck you want to public licen[cs]e|wtfpl", "fuck wtfpl"),
    ("unlicense", "the unlicense", "unlicense"),
    ("psf", "python software foundation licen[cs]e|psf 2 0|python 2 0(?: 1)?", "python psf"),
    ("php", "php licen[cs]e|php 3 0(?: 1)?", "php"),
    ("openssl", "openssl licen[cs]e|ssleay licen[cs]e", "openssl ssleay"),
    ("ofl", "sil open font licen[cs]e|ofl~v?1 [01](?: rfn| no rfn)?", "sil ofl oflv1 ofl1"),
    ("ms-pl", "microsoft public licen[cs]e|ms pl", "microsoft ms"),
    ("ms-rl", "microsoft reciprocal licen[cs]e|ms rl", "microsoft ms"),
    ("ms-lpl", "microsoft limited public licen[cs]e|ms lpl", "microsoft ms"),
    ("odbl", "open database licen[cs]e|odbl 1 0", "database odbl"),
    ("odc-by", "open data commons attribution licen[cs]e|odc by 1 0", "attribution odc"),
    ("pddl", "pddl 1 0", "pddl"),
    ("osl", "open software licen[cs]e(?: v)?(?: [123] [01])?|osl [123] [01]", "software osl"),
    ("afl", "academic free licen[cs]e|afl [123] [012]", "academic afl"),
    ("ecl", "educational community licen[cs]e|ecl [12] 0", "educational ecl"),
    ("ncsa", "university of illinois(?: ncsa)? open source licen[cs]e|ncsa licen[cs]e", "illinois ncsa"),
    ("postgresql", "postgresql licen[cs]e", "postgresql"),
    ("beerware", "beer ware licen[cs]e|beerware", "beer beerware"),
    ("cecill", "cecill(?: free software licen[cs]e agreement)?(?: [bc]| 1 0| 2 0| 2 1)", "cecill"),
    ("qpl", "qpl 1 0|q public licen[cs]e", "qpl q"),
    ("upl", "upl 1 0|universal permissive licen[cs]e", "upl universal"),
    ("w3c", "w3c (?:software|document)(?: and document)?(?: notice)?(?: and)? licen[cs]e", "w3c"),
    ("x11", "x11 licen[cs]e|x11 distribute modifications variant", "x11"),
    ("sspl", "sspl~v?1(?: 0)?|server side public licen[cs]e", "sspl ssplv1 sspl1 server"),
    ("busl", "busl 1 1|business source licen[cs]e", "busl business"),
    ("elastic", "elastic licen[cs]e|elv2", "elastic elv2"),
    ("commons-clause", "commons clause", "clause"),
    ("polyform", "polyform [a-z]+(?: [a-z]+)? licen[cs]e", "polyform"),
    ("openrail", "(?:bigscience|creativeml|bigcode) open~rail(?: m)?", "bigscience creativeml bigcode"),
    ("llama", "llama [234](?: [123])? community licen[cs]e", "llama"),
    ("gemma", "gemma terms of use", "gemma"),
    ("cc-by", "cc by~[1234] [05]", "cc"),
    ("cc-by-sa", "cc by sa(?: [1234] [05])?", "cc"),
    ("cc-by-nc", "cc by nc(?: [1234] [05])?", "cc"),
    ("cc-by-nd", "cc by nd(?: [1234] [05])?", "cc"),
    ("cc-by-nc-sa", "cc by nc sa(?: [1234] [05])?", "cc"),
    ("cc-by-nc-nd", "cc by nc nd(?: [1234] [05])?", "cc"),
    ("cc-by", "creative commons attribution(?: [1234] [05])?(?: international| generic| unported)?", "creative"),
    ("cc-by-sa", "creative commons attribution share~alike(?: [1234] [05])?(?: international| generic| unported)?", "creative"),
    ("cc-by-nc", "creative commons attribution non~commercial(?: [1234] [05])?(?: international| generic| unported)?", "creative"),
    ("cc0", "cc0(?: 1 0)?(?: universal)?|creative commons zero", "cc0 zero"),
    ("hippocratic", "hippocratic licen[cs]e(?: [123] [01])?", "hippocratic"),
    ("mulan", "mulan (?:psl|permissive software licen[cs]e)(?: v)?(?: ?[12])?", "mulan"),
    ("blueoak", "blue oak model licen[cs]e|blueoak 1 0 0", "oak blueoak"),
    ("sleepycat", "sleepycat licen[cs]e", "sleepycat"),
    ("lppl", "latex project public licen[cs]e|lppl 1 [0123]", "latex lppl"),
    ("ijg", "independent jpeg group(?: s)? licen[cs]e", "jpeg"),
    ("unicode", "unicode(?: data files and software)? licen[cs]e|unicode v3|unicode dfs", "unicode"),
    ("hpnd", "historical permission notice and disclaimer", "historical"),
    ("nasa", "nasa open source agreement", "nasa"),
    ("ogl", "open government licen[cs]e(?: v)?(?: [123](?: 0)?)?", "government"),
    ("etalab", "etalab(?: 2 0)?|licence ouverte", "etalab ouverte"),
    ("json", "json licen[cs]e", "json"),
    ("ftl", "freetype (?:project )?licen[cs]e", "freetype"),
    # Two licenses share three letters: the version tells them apart, and without one nothing is known.
    ("boost", "bsl~v?1 0", "bsl bslv1 bsl1"),
    ("busl", "bsl~v?1 1|business source licen[cs]e", "bsl bslv1 bsl1 business"),
    # Identifiers that are no words of a language stand for themselves.
    ("isc", "isc", "isc"),
    ("zlib", "zlib(?: acknowledgement)?", "zlib"),
    ("bitstream", "bitstream vera(?: fonts?)?(?: copyright| licen[cs]e)", "bitstream"),
]
#: Sentences of licenses, of their headers and notices: label, pattern, priority, keyword.
CLAUSES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 5, "hereby"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions", 5, "substantial"),
    ("mit", "to deal in the software without restriction including without limitation the rights", 4, "limitation"),
    ("mit", "the software is provided as is without warranty of any kind express or implied", 3, "implied"),
    ("mit", "opensource org licenses mit", 5, "opensource"),
    # The word alone is one of other languages: beside another identifier it is a license. Of lower priority than what it stands beside.
    ("mit", "mit (?:or|and) (?:the )?(?:apache|bsd|0bsd|isc|zlib|unlicense|cc0|gpl|gplv[23]|lgpl|agpl|mpl|bsl|boost|wtfpl|epl|artistic|psf|ofl)", 1, "mit"),
    ("mit", "(?:apache(?: license)?(?: v)?(?: ?2)?(?: 0)?|(?:gpl|lgpl|agpl|mpl|epl)~v?[123](?: [01])?(?: only| or later)?|clause|0bsd|bsd|isc|zlib|unlicense|cc0|bsl 1 0|wtfpl) (?:or|and) (?:the )?mit", 1, "mit"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy", 5, "hereby"),
    ("boost", "boost org license 1 0", 5, "boost"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 5, "hereby"),
    ("isc", "provided that the above copyright notice and this permission notice appear in all copies", 4, "appear"),
    ("isc", "the author disclaims all warranties with regard to this software", 4, "disclaims"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", 5, "hereby"),
    ("hpnd", "permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee", 5, "hereby"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 5, "redistribution"),
    ("bsd", "redistributions of source code must retain the above copyright notice", 5, "redistributions"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice", 5, "redistributions"),
    ("bsd", "neither the names? of [^ ]+(?: [^ ]+){0,8} nor the names of its contributors may be used to endorse", 5, "endorse"),
    ("bsd", "all advertising materials mentioning features or use of this software must display the following acknowledgement", 5, "advertising"),
    ("bsd", "this software is provided by the (?:copyright holders|regents|authors?) and contributors as is", 4, "contributors"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", 5, "liable"),
    ("zlib", "altered source versions must be plainly marked as such", 5, "plainly"),
    ("zlib", "the origin of this software must not be misrepresented", 5, "misrepresented"),
    ("apache", "licensed to the apache software foundation asf under one or more contributor license agreements", 5, "asf"),
    ("apache", "you may not use this file except in compliance with the license", 4, "compliance"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 4, "applicable"),
    ("apache", "this product includes software developed (?:by|at) the apache software foundation", 5, "foundation"),
    ("apache", "apache org licenses license [12] [01]", 5, "apache"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license", 5, "redistribute"),
    ("gpl", "you should have received a copy of the gnu general public license", 5, "received"),
    ("gpl", "this program is free software", 3, "program"),
    ("gpl", "either version [123](?: 0)? of the license or at your option any later version", 3, "option"),
    ("gpl", "merchantability or fitness for a particular purpose see the gnu general public license", 5, "merchantability"),
    ("gpl", "gnu org licenses gpl(?: [123] 0)?", 5, "gnu"),
    ("gpl", "gnu org copyleft gpl", 5, "copyleft"),
    ("gpl-linking", "as a special exception(?: [^ ]+){0,30} link(?:ing)?", 4, "exception"),
    ("gpl-classpath", "classpath exception", 4, "classpath"),
    ("fsf", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", 4, "verbatim"),
    ("fsf", "the licenses for most software are designed to take away your freedom to share and change it", 4, "designed"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu l(?:esser|ibrary) general public license", 5, "redistribute"),
    ("lgpl", "you should have received a copy of the gnu l(?:esser|ibrary) general public license", 5, "received"),
    ("lgpl", "this library is free software", 4, "library"),
    ("lgpl", "gnu org licenses lgpl(?: [23] [01])?", 5, "gnu"),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license", 5, "redistribute"),
    ("agpl", "you should have received a copy of the gnu affero general public license", 5, "received"),
    ("agpl", "remote network interaction use with the gnu general public license", 5, "interaction"),
    ("agpl", "gnu org licenses agpl(?: 3 0)?", 5, "gnu"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 5, "documentation"),
    ("gfdl", "no invariant sections no front cover texts", 5, "invariant"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", 5, "mozilla"),
    ("mpl", "if a copy of the mpl was not distributed with this file you can obtain one at", 5, "mpl"),
    ("mpl", "the contents of this file are subject to the (?:mozilla|netscape) public license", 5, "contents"),
    ("mpl", "this source code form is incompatible with secondary licenses", 5, "incompatible"),
    ("mpl", "mozilla org (?:en us )?mpl(?: 2 0)?", 5, "mozilla"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", 5, "accompanying"),
    ("epl", "eclipse org (?:org )?(?:documents|legal) epl", 5, "eclipse"),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license", 5, "contents"),
    ("eupl", "you may not use this work except in compliance with the licence", 4, "licence"),
    ("artistic", "the intent of this document is to state the conditions under which a package may be copied", 5, "intent"),
    ("artistic", "(?:under the )?same terms as perl(?: itself)?", 4, "perl"),
    ("unlicense", "this is free and unencumbered software released into the public domain", 5, "unencumbered"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", 5, "compile"),
    ("unlicense", "unlicense org", 5, "unlicense"),
    ("cc0", "to the extent possible under law(?: [^ ]+){0,12} has waived all copyright", 5, "waived"),
    ("cc0", "creativecommons org publicdomain zero 1 0", 5, "creativecommons"),
    ("public-domain", "creativecommons org publicdomain mark 1 0", 5, "creativecommons"),
    ("cc-by", "creativecommons org licenses by [1234] [05]", 5, "creativecommons"),
    ("cc-by-sa", "creativecommons org licenses by sa [1234] [05]", 5, "creativecommons"),
    ("cc-by-nc", "creativecommons org licenses by nc [1234] [05]", 5, "creativecommons"),
    ("cc-by-nd", "creativecommons org licenses by nd [1234] [05]", 5, "creativecommons"),
    ("cc-by-nc-sa", "creativecommons org licenses by nc sa [1234] [05]", 5, "creativecommons"),
    ("cc-by-nc-nd", "creativecommons org licenses by nc nd [1234] [05]", 5, "creativecommons"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed", 5, "verbatim"),
    ("wtfpl", "you just do what the fuck you want to", 5, "fuck"),
    ("ofl", "this font software is licensed under the sil open font license", 5, "font"),
    ("ofl", "with reserved font names?", 4, "font"),
    ("ofl", "sil org ofl", 5, "sil"),
    ("psf", "psf is making python available to licensee on an as is basis", 5, "licensee"),
    ("ruby", "ruby is copyrighted free software by yukihiro matsumoto", 5, "matsumoto"),
    ("openssl", "this product includes software developed by the openssl project", 5, "openssl"),
    ("openssl", "this product includes cryptographic software written by eric young", 5, "cryptographic"),
    ("php", "this product includes php software freely available from", 5, "php"),
    ("x11", "except as contained in this notice the names? of", 4, "contained"),
    ("json", "the software shall be used for good not evil", 5, "evil"),
    ("ijg", "this software is based in part on the work of the independent jpeg group", 5, "jpeg"),
    ("ftl", "portions of this software are copyright(?: [^ ]+){0,3} the freetype project", 5, "freetype"),
    ("vim", "there are no restrictions on distributing unmodified copies of vim", 5, "unmodified"),
    ("beerware", "as long as you retain this notice you can do whatever you want with this stuff", 5, "stuff"),
    ("sqlite", "the author disclaims copyright to this source code in place of a legal notice here is a blessing", 5, "blessing"),
    ("cecill", "this software is governed by the cecill(?: [bc])? license under french law", 5, "cecill"),
    ("odbl", "opendatacommons org licenses odbl", 5, "opendatacommons"),
    ("odc-by", "opendatacommons org licenses by", 5, "opendatacommons"),
    ("pddl", "opendatacommons org licenses pddl", 5, "opendatacommons"),
    ("elastic", "you may not provide the software to third parties as a hosted or managed service", 5, "hosted"),
    ("commons-clause", "the license does not grant to you the right to sell the software", 5, "sell"),
    ("busl", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use", 5, "licensor"),
    ("sspl", "offering the program as a service", 4, "offering"),
    ("llama", "built with (?:meta )?llama", 4, "llama"),
    ("openrail", "use~based restrictions(?: as)? referenced in paragraph 5", 5, "referenced"),
    ("public-domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain", 3, "domain"),
    ("public-domain", "this (?:work|file|software|code) is in the public domain", 4, "domain"),
    ("public-domain", "not subject to copyright protection", 3, "protection"),
    ("public-domain", "work of the (?:united states|u s) government", 3, "government"),
    ("copyright", "copyright (?:c )?[0-9]{4}(?: [0-9]{4})?", 1, "copyright"),
    ("copyright", "all rights reserved", 1, "reserved"),
    ("copyright", "used (?:with|by) permission", 1, "permission"),
    ("proprietary", "(?:proprietary and confidential|confidential and proprietary)", 3, "proprietary"),
    ("proprietary", "unauthorized (?:copying|use|distribution|reproduction) of this (?:file|software|document|material)", 3, "unauthorized"),
    ("proprietary", "may not be (?:copied|reproduced|distributed|published)(?: [^ ]+){0,8} without (?:the )?(?:prior )?(?:express )?(?:written )?(?:permission|consent)", 3, "permission consent"),
    ("proprietary", "(?:contains|constitutes) (?:valuable )?trade secrets", 3, "secrets"),
    ("proprietary", "for internal use only", 2, "internal"),
    ("proprietary", "end user license agreement|eula", 2, "agreement eula"),
    ("non-commercial", "for (?:personal and )?non~commercial (?:use|purposes) only", 2, "commercial noncommercial"),
    ("research-only", "for (?:academic|research)(?: and [a-z]+)? (?:use|purposes) only", 2, "academic research"),
]


def rules() -> list[tuple[str, str, int, list[str]]]:
    """(label, pattern, priority, keywords) of all rules, in order: base phrases, clauses, names, every family in every form.

    Patterns are over words with two blanks between; every match holds one of the keywords as a word.
    """
    out = [(label, phrase, 1, phrase.split()[0]) for phrase, label in BASE.items()] + CLAUSES + [(label, f"(?:{pattern})", 2, keywords) for label, pattern, keywords in NAMES]
    for label, name, versions, keywords in FAMILIES:
        follows = f"(?: (?:version |v )?v?(?:{versions})(?: or later| only)?)?" if versions else ""
        for _, around, priority in FORMS:
            out.append((label, around.format(n=f"(?:{name}){follows}"), priority, keywords))
    return [(label, f" {pattern.replace('~', '(?: )?')} ".replace(" ", "  ")[1:-1], priority, keywords.split()) for label, pattern, priority, keywords in out]


def wordy(text: Column) -> Column:
    """The text's words in lower case, each between blanks of its own: ' a  b '. Without words: an empty text.

    Only A-Z count: the two other letters whose lower case holds one of a-z become another sign first.
    """
    body = F.coalesce(text, F.lit(""))
    for sign in "\u212a\u0130":
        body = F.replace(body, F.lit(sign), F.lit("\u0131"))
    inner = F.regexp_replace(F.lower(body), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "  ")
    body = F.regexp_replace(inner, r"^ +| +$", "")
    return F.when(body == "", F.lit("")).otherwise(F.concat(F.lit(" "), body, F.lit(" ")))


def _count(wordy_text: Column) -> Column:
    """Words of a wordy text: half of its blanks."""
    return ((F.length(wordy_text) - F.length(F.replace(wordy_text, F.lit(" "), F.lit("")))) / 2).cast("int")


_NONE = "array<struct<start:int,size:int,priority:int,rule:int,label:string>>"


def detections(w: Column) -> Column:
    """All detections of a wordy text, before suppression: array of (start, size, priority, rule, label), in words from 0."""
    known = sorted({k for *_, keywords in rules() for k in keywords})
    all_ = F.array(*[
        F.struct(F.array(*map(F.lit, keywords)).alias("keywords"), F.struct(F.lit(n).alias("rule"), F.lit(label).alias("label"), F.lit(pattern).alias("pattern"), F.lit(priority).alias("priority")).alias("r"))
        for n, (label, pattern, priority, keywords) in enumerate(rules())
    ])
    held = F.array_intersect(F.split(F.substring(w, 2, 2_000_000_000), "  ?"), F.array(*map(F.lit, known)))

    def found(present: Column) -> Column:
        tried = F.filter(all_, lambda g: F.arrays_overlap(g["keywords"], present))
        hits = F.filter(F.transform(tried, lambda g: F.struct(g["r"].alias("r"), F.regexp_extract_all(w, g["r"]["pattern"], F.lit(0)).alias("m"))), lambda x: F.size(x["m"]) > 0)
        return F.flatten(F.transform(hits, placed))

    def placed(x: Column) -> Column:
        pieces = F.arrays_zip(F.transform(F.split(w, x["r"]["pattern"], -1), _count).alias("gap"), F.transform(x["m"], _count).alias("size"))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        walked = F.aggregate(pieces, start, lambda acc, p: F.struct((acc["at"] + p["gap"] + F.coalesce(p["size"], F.lit(0))).alias("at"), F.concat(acc["starts"], F.array(acc["at"] + p["gap"])).alias("starts")), lambda acc: acc["starts"])
        places = F.filter(F.arrays_zip(walked.alias("start"), F.transform(x["m"], _count).alias("size")), lambda p: p["size"].isNotNull())
        return F.transform(places, lambda p: F.struct(p["start"].alias("start"), p["size"].alias("size"), x["r"]["priority"].alias("priority"), x["r"]["rule"].alias("rule"), x["r"]["label"].alias("label")))

    # One element: inside it the keywords are a value, not an expression that every rule would compute again.
    return F.flatten(F.transform(F.filter(F.array(held), lambda h: F.size(h) > 0), found))


def resolved(detected: Column) -> Column:
    """Detections without those that lie inside one of higher priority, or a longer or earlier rule's one of the same.

    A sweep by start, longer ones first: what may contain a detection has come before it, and of that only the kept ones
    that reach its start are held (what a suppressed one contains, its suppressor contains too).
    """
    order = F.transform(detected, lambda d: F.struct(d["start"].alias("start"), (-d["size"]).alias("size"), (-d["priority"]).alias("priority"), d["rule"].alias("rule"), d["label"].alias("label")))
    swept = F.array_sort(order)
    end = lambda d: d["start"] - d["size"]
    kind = "array<struct<start:int,size:int,priority:int,rule:int,label:string>>"

    def step(acc: Column, d: Column) -> Column:
        better = lambda e: (e["priority"] < d["priority"]) | (e["priority"] == d["priority"]) & ((e["size"] < d["size"]) | (e["size"] == d["size"]) & (e["rule"] < d["rule"]))
        beaten = F.exists(acc["open"], lambda e: (end(e) >= end(d)) & better(e))
        live = F.filter(acc["open"], lambda e: end(e) > d["start"])
        return F.struct(F.concat(acc["flags"], F.when(beaten, "0").otherwise("1")).alias("flags"), F.when(beaten, live).otherwise(F.concat(live, F.array(d))).alias("open"))

    start = F.struct(F.lit("").alias("flags"), F.array().cast(kind).alias("open"))
    both = F.transform(F.array(F.struct(swept.alias("s"), F.aggregate(swept, start, step, lambda acc: acc["flags"]).alias("flags"))), lambda b: F.filter(b["s"], lambda d, i: F.substr(b["flags"], i + 1, F.lit(1)) == "1"))
    back = F.transform(F.flatten(both), lambda d: F.struct(d["start"].alias("start"), (-d["size"]).alias("size"), (-d["priority"]).alias("priority"), d["rule"].alias("rule"), d["label"].alias("label")))
    return F.when(F.size(detected) > 0, F.array_sort(back)).otherwise(F.array().cast(_NONE))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, n_base, first_word, last_word, base_labels, labels, score and detections to every row.

    Null and empty texts have no words, no labels (empty texts) and score 0. score: the highest remaining priority, of 5.
    Texts are scanned whole, whatever their length; rows that repeat are scanned each; an empty table stays empty. Columns
    of docs stay; those of the names above are replaced.
    """
    rows = docs.withColumn("__w", wordy(F.col(text)))
    rows = rows.withColumn("__n", _count(F.col("__w"))).withColumn("__found", detections(F.col("__w")))
    w, n = F.col("__w"), F.col("__n")
    phrases = {" " + p.replace(" ", "  ") + " ": label for p, label in BASE.items()}
    count = [F.when(F.contains(w, F.lit(p)), ((F.length(w) - F.length(F.replace(w, F.lit(p), F.lit("")))) / len(p)).cast("long")).otherwise(F.lit(0).cast("long")) for p in phrases]
    first = [F.when(F.contains(w, F.lit(p)), _count(F.substring_index(w, p, 1)).cast("long")) for p in phrases]
    last = [F.when(F.contains(w, F.lit(p)), (n - _count(F.substring_index(w, p, -1)) - len(p.split())).cast("long")) for p in phrases]
    base = F.array_compact(F.array(*[F.when(F.contains(w, F.lit(p)), F.lit(label)) for p, label in phrases.items()]))
    rows = rows.withColumn("__base", base).withColumn("detections", resolved(F.col("__found")))
    remaining = F.col("detections")
    return rows.withColumns(
        {
            "n_words": n.cast("long"),
            "n_base": sum(count[1:], count[0]),
            "first_word": F.least(*first),
            "last_word": F.greatest(*last),
            "base_labels": F.array_join(F.array_sort(F.array_distinct("__base")), ","),
            "labels": F.array_join(F.array_sort(F.array_distinct(F.concat("__base", F.transform(remaining, lambda d: d["label"])))), ","),
            "score": F.coalesce(F.array_max(F.transform(remaining, lambda d: d["priority"])) / 5, F.lit(0.0)),
        }
    ).drop("__w", "__n", "__found", "__base")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("detections").alias("n_detections"))
