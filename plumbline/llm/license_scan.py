"""License scans by ordered signature rules, in SQL functions only.

A text is split into words (`[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`, A-Z lower-cased). One that
holds any of the rules' keywords goes on, its words each between blanks of its
own, to the rules: hand-written regular expressions over names, identifiers,
notices and sentences of licenses. They are grouped by keyword; a group is only
looked at where its keyword is among the words, first by one alternation of all its
expressions, and only then rule by rule. All expressions are literals of the plan, so each
is compiled once a task. Detections are intervals; in order of their start (longer and stronger
first) one is suppressed that lies inside an earlier one of the same or a higher
priority. The labels of what is left, and the base labels, are the result.

Defined results: null and wordless texts have no words and no labels; repeated
rows each get a row; no documents give no rows; texts are scanned whole, however long, nothing
is shuffled; extra columns are not read, whatever their names; score is the greatest confidence of the
detections left, 0.85 at least with a base label, 0 without any.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The base phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

# In all rules below, L: license or licence. A keyword is a word that every match holds; of several (a|b), one.

# Names of licenses: (label, keyword, name, versions). A version after the name goes into the label.
NAMES = (
    ("gpl", "general", "(?:gnu )?general public L", ("1 0", "2 0", "3 0", "1", "2", "3")),
    ("lgpl", "general", "(?:gnu )?(?:lesser|library) general public L", ("2 0", "2 1", "3 0", "2", "3")),
    ("agpl", "affero", "(?:gnu )?affero general public L", ("1 0", "3 0", "3")),
    ("gfdl", "documentation", "(?:gnu )?free documentation L", ("1 1", "1 2", "1 3")),
    ("apache", "apache", "apache (?:software )?L", ("1 0", "1 1", "2 0", "2")),
    ("mit", "mit", "mit L", ()),
    ("x11", "x11", "x11 L", ()),
    ("bsd-2-clause", "bsd", "(?:simplified|freebsd|2 clause|two clause) bsd L", ()),
    ("bsd-3-clause", "bsd", "(?:new|revised|modified|3 clause|three clause) bsd L", ()),
    ("bsd-4-clause", "bsd", "(?:original|4 clause|four clause) bsd L", ()),
    ("bsd", "bsd", "bsd L", ()),
    ("isc", "isc", "isc L", ()),
    ("mpl", "mozilla", "mozilla public L", ("1 0", "1 1", "2 0", "2")),
    ("epl", "eclipse", "eclipse public L", ("1 0", "2 0")),
    ("edl", "eclipse", "eclipse distribution L", ("1 0",)),
    ("cpl", "common", "common public L", ("1 0",)),
    ("cddl", "common", "common development and distribution L", ("1 0", "1 1")),
    ("cpal", "common", "common public attribution L", ("1 0",)),
    ("ibm-pl", "ibm", "ibm public L", ("1 0",)),
    ("artistic", "artistic", "artistic L", ("1 0", "2 0")),
    ("bsl", "boost", "boost software L", ("1 0",)),
    ("zlib", "zlib", "zlib L", ()),
    ("libpng", "libpng", "libpng L", ("2 0",)),
    ("unlicense", "unlicense", "(?:the )?unlicense", ()),
    ("wtfpl", "wtfpl", "wtfpl", ("2",)),
    ("wtfpl", "fuck", "do what the fuck you want to public L", ("2",)),
    ("cc0", "cc0", "cc0", ("1 0",)),
    ("cc0", "creative", "creative commons (?:cc0|zero|public domain dedication)", ("1 0",)),
    ("cc-by", "creative", "creative commons attribution(?: L| international L)?", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", "creative", "creative commons attribution share ?alike(?: L)?", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", "creative", "creative commons attribution no ?deriv(?:s|atives)(?: L)?", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", "creative", "creative commons attribution non ?commercial(?: L)?", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-sa", "creative", "creative commons attribution non ?commercial share ?alike(?: L)?", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-nd", "creative", "creative commons attribution non ?commercial no ?deriv(?:s|atives)(?: L)?", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", "cc", "cc by sa", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", "cc", "cc by nd", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", "cc", "cc by nc", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-sa", "cc", "cc by nc sa", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-nd", "cc", "cc by nc nd", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by", "cc", "cc by", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("eupl", "european", "european union public L", ("1 0", "1 1", "1 2")),
    ("cecill", "cecill", "cecill(?: L)?", ("1 0", "1 1", "2 0", "2 1")),
    ("cecill-b", "cecill", "cecill b(?: L)?", ()),
    ("cecill-c", "cecill", "cecill c(?: L)?", ()),
    ("ofl", "font", "(?:sil )?open font L", ("1 0", "1 1")),
    ("osl", "open", "open software L", ("1 0", "1 1", "2 0", "2 1", "3 0")),
    ("afl", "academic", "academic free L", ("1 1", "1 2", "2 0", "2 1", "3 0")),
    ("ecl", "educational", "educational community L", ("1 0", "2 0")),
    ("ms-pl", "microsoft", "microsoft public L", ()),
    ("ms-rl", "microsoft", "microsoft reciprocal L", ()),
    ("python", "python", "python (?:software foundation )?L", ("2 0", "2")),
    ("php", "php", "php L", ("3 0", "3 01")),
    ("ruby", "ruby", "ruby L", ()),
    ("perl", "perl", "same terms as perl(?: itself)?", ()),
    ("tcl", "tcl", "tcl(?: tk)? L", ()),
    ("vim", "vim", "vim L", ()),
    ("w3c", "w3c", "w3c (?:software )?(?:notice and )?L", ()),
    ("openssl", "openssl", "openssl L", ()),
    ("ssleay", "ssleay", "(?:original )?ssleay L", ()),
    ("openldap", "openldap", "openldap public L", ("2 8",)),
    ("postgresql", "postgresql", "postgresql L", ()),
    ("ncsa", "illinois", "university of illinois(?: ncsa)? open source L", ()),
    ("ntp", "ntp", "ntp L", ()),
    ("qpl", "q", "q public L", ("1 0",)),
    ("npl", "netscape", "netscape public L", ("1 0", "1 1")),
    ("apsl", "apple", "apple public source L", ("1 0", "1 1", "1 2", "2 0")),
    ("sun-spl", "sun", "sun public L", ("1 0",)),
    ("sissl", "sun", "sun industry standards source L", ("1 1", "1 2")),
    ("intel", "intel", "intel open source L", ()),
    ("nokia", "nokia", "nokia open source L", ("1 0",)),
    ("realnetworks", "realnetworks", "realnetworks public source L", ("1 0",)),
    ("ricoh", "ricoh", "ricoh source code public L", ()),
    ("sleepycat", "sleepycat", "sleepycat L", ()),
    ("sybase", "sybase", "sybase open watcom public L", ("1 0",)),
    ("zpl", "zope", "zope public L", ("1 1", "2 0", "2 1")),
    ("cua-opl", "cua", "cua office public L", ("1 0",)),
    ("eiffel", "eiffel", "eiffel forum L", ("1 0", "2 0")),
    ("lppl", "latex", "latex project public L", ("1 0", "1 1", "1 2", "1 3")),
    ("lpl", "lucent", "lucent public L", ("1 0", "1 02")),
    ("naumen", "naumen", "naumen public L", ()),
    ("nasa", "nasa", "nasa open source agreement", ("1 3",)),
    ("odbl", "database", "open (?:data commons open )?database L", ("1 0",)),
    ("odc-by", "data", "open data commons attribution L", ("1 0",)),
    ("pddl", "dedication", "public domain dedication and L", ("1 0",)),
    ("ogl", "government", "open government L", ("1 0", "2 0", "3 0")),
    ("mulan", "mulan", "mulan (?:permissive software|psl)(?: L)?", ("1", "2")),
    ("upl", "universal", "universal permissive L", ("1 0",)),
    ("blueoak", "blue", "blue oak model L", ("1 0 0",)),
    ("sspl", "server", "server side public L", ("1", "1 0")),
    ("busl", "business", "business source L", ("1 0", "1 1")),
    ("elastic", "elastic", "elastic L", ("1 0", "2 0", "2")),
    ("commons-clause", "commons", "commons clause(?: L condition)?", ("1 0",)),
    ("json", "json", "json L", ()),
    ("beerware", "beer|beerware", "(?:the )?beer ?ware L", ("42",)),
    ("hpnd", "historical", "historical permission notice and disclaimer", ()),
    ("fair", "fair", "fair L", ()),
    ("rpl", "reciprocal", "reciprocal public L", ("1 1", "1 5")),
    ("watcom", "watcom", "open watcom public L", ("1 0",)),
    ("jython", "jython", "jython L", ()),
    ("imagemagick", "imagemagick", "imagemagick L", ()),
    ("info-zip", "zip", "info zip L", ()),
    ("curl", "curl", "curl L", ()),
    ("freetype", "freetype", "freetype (?:project )?L", ()),
    ("ijg", "jpeg", "independent jpeg group L", ()),
    ("icu", "icu", "icu L", ()),
    ("unicode", "unicode", "unicode (?:terms of use|L agreement)", ()),
    ("rail", "rail|openrail|responsible", "(?:open ?rail|responsible ai) L", ()),
    ("llama", "llama", "llama (?:2 |3 )?community L(?: agreement)?", ()),
)

# Identifiers in machine-readable tags: (label, words after "spdx license identifier").
TAGS = (
    ("mit", "mit"), ("mit-0", "mit 0"), ("x11", "x11"), ("isc", "isc"), ("0bsd", "0bsd"),
    ("bsd-2-clause", "bsd 2 clause"), ("bsd-3-clause", "bsd 3 clause"), ("bsd-4-clause", "bsd 4 clause"),
    ("apache-1.1", "apache 1 1"), ("apache-2.0", "apache 2 0"),
    ("gpl-2.0-only", "gpl 2 0(?: only)?"), ("gpl-2.0-or-later", "gpl 2 0 or later"), ("gpl-3.0-only", "gpl 3 0(?: only)?"), ("gpl-3.0-or-later", "gpl 3 0 or later"),
    ("lgpl-2.0", "lgpl 2 0(?: only| or later)?"), ("lgpl-2.1-only", "lgpl 2 1(?: only)?"), ("lgpl-2.1-or-later", "lgpl 2 1 or later"), ("lgpl-3.0", "lgpl 3 0(?: only| or later)?"),
    ("agpl-3.0", "agpl 3 0(?: only| or later)?"), ("gfdl-1.3", "gfdl 1 3(?: only| or later)?"),
    ("mpl-1.1", "mpl 1 1"), ("mpl-2.0", "mpl 2 0"), ("epl-1.0", "epl 1 0"), ("epl-2.0", "epl 2 0"), ("cddl-1.0", "cddl 1 0"), ("cpl-1.0", "cpl 1 0"),
    ("cc0-1.0", "cc0 1 0"), ("cc-by-4.0", "cc by 4 0"), ("cc-by-sa-4.0", "cc by sa 4 0"), ("cc-by-nc-4.0", "cc by nc 4 0"), ("cc-by-nd-4.0", "cc by nd 4 0"), ("cc-by-nc-sa-4.0", "cc by nc sa 4 0"),
    ("unlicense", "unlicense"), ("wtfpl", "wtfpl"), ("zlib", "zlib"), ("bsl-1.0", "bsl 1 0"), ("artistic-2.0", "artistic 2 0"), ("ofl-1.1", "ofl 1 1"),
    ("eupl-1.2", "eupl 1 2"), ("postgresql", "postgresql"), ("python-2.0", "python 2 0"), ("ncsa", "ncsa"), ("openssl", "openssl"), ("curl", "curl"),
    ("ms-pl", "ms pl"), ("upl-1.0", "upl 1 0"), ("sspl-1.0", "sspl 1 0"), ("busl-1.1", "busl 1 1"), ("odbl-1.0", "odbl 1 0"), ("cecill-2.1", "cecill 2 1"),
)

# Notices and sentences: (label, priority, confidence in hundredths, keyword, words).
TEXTS = (
    # grants and conditions of permissive licenses
    ("mit", 40, 95, "permission", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", 35, 85, "merge", "to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", 35, 85, "substantial", "shall be included in all copies or substantial portions of the software"),
    ("mit-0", 45, 90, "restriction", "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided"),
    ("mit", 30, 90, "expat", "expat L"),
    ("x11", 45, 90, "consortium", "except as contained in this notice the name of (?:the )?x consortium"),
    ("isc", 40, 90, "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("0bsd", 35, 80, "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("hpnd", 40, 85, "permission", "permission to use copy modify (?:and )?distribute this software and its documentation for any purpose"),
    ("bsd", 40, 90, "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", 30, 80, "redistributions", "redistributions of source code must retain the above copyright notice"),
    ("bsd", 30, 80, "redistributions", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", 45, 95, "endorse", "neither the name of .{1,200}? may be used to endorse or promote products"),
    ("bsd-4-clause", 45, 95, "advertising", "all advertising materials mentioning features or use of this software"),
    ("bsd-2-clause-views", 45, 90, "views", "views and conclusions contained in the software and documentation are those of the authors"),
    ("bsd-3-clause-clear", 45, 90, "patent", "no express or implied L(?:s)? to any party s patent rights are granted by this L"),
    ("zlib", 40, 90, "warranty", "this software is provided as is without any express or implied warranty in no event will the authors"),
    ("zlib", 35, 90, "misrepresented", "the origin of this software must not be misrepresented"),
    ("zlib", 35, 85, "plainly", "altered source versions must be plainly marked as such"),
    ("bsl-1.0", 40, 95, "permission", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("bsl-1.0", 40, 90, "processor", "machine executable object code generated by a source language processor"),
    ("ncsa", 40, 90, "illinois", "neither the names of .{1,160}? university of illinois"),
    ("curl", 40, 85, "stenberg", "copyright c .{1,40}? daniel stenberg"),
    ("beerware", 40, 95, "beer", "you can buy me a beer in return"),
    ("wtfpl", 40, 95, "fuck", "you just do what the fuck you want to"),
    ("fair", 40, 90, "instrument", "usage of the works is permitted provided that this instrument is retained with the works"),
    ("postgresql", 40, 90, "california", "in no event shall the university of california be liable to any party"),
    ("openssl", 40, 90, "openssl", "this product includes software developed by the openssl project"),
    ("ssleay", 40, 90, "young", "this product includes cryptographic software written by eric young"),
    ("apache-1.1", 40, 90, "apache", "this product includes software developed by the apache software foundation"),
    ("json", 40, 95, "evil", "the software shall be used for good not evil"),
    ("vim", 40, 90, "vim", "vim is charityware"),
    ("tcl", 40, 85, "regents", "this software is copyrighted by the regents of the university of california sun microsystems"),
    ("ijg", 40, 90, "jpeg", "this software is based in part on the work of the independent jpeg group"),
    ("freetype", 40, 90, "freetype", "portions of this software are copyright c .{1,60}? the freetype project"),
    ("info-zip", 40, 90, "zip", "for the purposes of this copyright and L info zip is defined as"),
    ("unicode", 40, 90, "unicode", "permission is hereby granted .{1,120}? unicode data files"),
    ("icu", 40, 85, "icu", "icu L icu 1 8 1 and later"),
    ("imagemagick", 40, 85, "imagemagick", "copyright .{1,40}? imagemagick studio llc"),
    ("upl-1.0", 40, 90, "permission", "subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software associated documentation and or data"),
    ("blueoak-1.0.0", 40, 90, "contributor", "each contributor licenses you to do everything with this software"),
    ("unlicense", 40, 95, "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("unlicense", 35, 85, "anyone", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc0-1.0", 40, 90, "waived", "has waived all copyright and related or neighboring rights"),
    ("cc0", 35, 85, "dedicate", "dedicate any and all copyright interest in the software to the public domain"),
    ("cc-pdm", 35, 85, "mark", "public domain mark"),
    ("public-domain", 30, 85, "domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", 15, 60, "domain", "public domain"),
    # notices of the gnu licenses
    ("gpl", 40, 90, "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public L"),
    ("gpl-2.0-or-later", 45, 95, "foundation", "gnu general public L as published by the free software foundation either version 2 of the L or (?:at your option )?any later version"),
    ("gpl-3.0-or-later", 45, 95, "foundation", "gnu general public L as published by the free software foundation either version 3 of the L or (?:at your option )?any later version"),
    ("gpl-2.0-only", 45, 90, "foundation", "gnu general public L version 2 as published by the free software foundation"),
    ("gpl", 35, 85, "merchantability", "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public L"),
    ("gpl", 35, 90, "received", "you should have received a copy of the gnu general public L"),
    ("lgpl", 45, 90, "redistribute", "you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public L"),
    ("lgpl", 35, 90, "received", "you should have received a copy of the gnu (?:lesser|library) general public L"),
    ("agpl", 45, 90, "redistribute", "you can redistribute it and or modify it under the terms of the gnu affero general public L"),
    ("agpl", 35, 90, "received", "you should have received a copy of the gnu affero general public L"),
    ("agpl", 35, 85, "interacting", "all users interacting with it remotely through a computer network"),
    ("gfdl", 40, 90, "invariant", "with no invariant sections (?:with )?no front cover texts and (?:with )?no back cover texts"),
    ("gpl-linking-exception", 45, 90, "linking", "linking this library statically or dynamically with other modules"),
    ("gpl-classpath-exception", 45, 95, "classpath", "classpath exception"),
    ("gpl-gcc-exception", 45, 95, "runtime", "gcc runtime library exception"),
    ("gpl-autoconf-exception", 45, 90, "autoconf", "as a special exception .{1,120}? configuration script generated by autoconf"),
    ("gpl-bison-exception", 45, 90, "bison", "as a special exception .{1,120}? bison parser skeleton"),
    ("gpl-font-exception", 45, 90, "font|fonts", "embed this font or unaltered portions of this font|font exception to the gnu general public L for fonts"),
    ("linux-syscall-note", 45, 90, "linux", "with linux syscall note"),
    ("gpl", 25, 85, "gplv1|gplv2|gplv3|gplv2plus|gplv3plus", "gplv1|gplv2plus|gplv3plus"),
    ("gpl-2", 20, 80, "gplv2", "gplv2"),
    ("gpl-3", 20, 80, "gplv3", "gplv3"),
    ("gpl-2.0-or-later", 25, 85, "gplv2|gpl2", "gplv?2 or (?:any )?later"),
    ("gpl-3.0-or-later", 25, 85, "gplv3|gpl3", "gplv?3 or (?:any )?later"),
    ("gpl", 10, 70, "gpl", "gpl"),
    ("lgpl-2.1", 20, 80, "lgplv2", "lgplv2 1"),
    ("lgpl-3.0", 20, 80, "lgplv3", "lgplv3"),
    ("lgpl", 10, 70, "lgpl", "lgpl"),
    ("agpl-3.0", 20, 80, "agplv3", "agplv3"),
    ("agpl", 10, 70, "agpl", "agpl"),
    ("copyleft", 10, 50, "copyleft", "copyleft"),
    # notices of other copyleft and institutional licenses
    ("apache-2.0", 40, 95, "apache", "licensed under the apache L version 2 0"),
    ("apache-2.0", 35, 90, "compliance", "you may not use this file except in compliance with the L you may obtain a copy of the L at http www apache org"),
    ("apache-2.0", 30, 85, "apache", "www apache org licenses L 2 0"),
    ("apache-2.0-llvm", 45, 95, "llvm", "apache L v2 0 with llvm exceptions"),
    ("mpl-2.0", 40, 95, "mozilla", "this source code form is subject to the terms of the mozilla public L v 2 0"),
    ("mpl-1.1", 40, 95, "mozilla", "the contents of this file are subject to the mozilla public L version 1 1"),
    ("mpl-2.0", 40, 90, "incompatible", "incompatible with secondary licenses as defined by the mozilla public L"),
    ("mpl-1.1-or-gpl-or-lgpl", 40, 90, "alternatively", "alternatively the contents of this file may be used under the terms of either the gnu general public L"),
    ("epl-1.0", 40, 95, "eclipse", "made available under the terms of the eclipse public L v ?1 0"),
    ("epl-2.0", 40, 95, "eclipse", "made available under the terms of the eclipse public L (?:v ?)?2 0"),
    ("edl-1.0", 40, 90, "eclipse", "eclipse distribution L v ?1 0 which accompanies this distribution"),
    ("cddl", 40, 95, "development", "the contents of this file are subject to the terms of (?:either )?the common development and distribution L"),
    ("cpl-1.0", 40, 90, "common", "the accompanying program is provided under the terms of this common public L"),
    ("ibm-pl-1.0", 40, 90, "ibm", "the accompanying program is provided under the terms of this ibm public L"),
    ("npl-1.1", 40, 90, "netscape", "the contents of this file are subject to the netscape public L"),
    ("apsl-2.0", 40, 90, "apple", "the contents of this file constitute original code as defined in and are subject to the apple public source L"),
    ("sun-spl", 40, 85, "sun", "the contents of this file are subject to the sun public L"),
    ("artistic-2.0", 40, 90, "artistic", "copy modify and distribute this package under the terms of the artistic L 2 0"),
    ("perl", 35, 90, "perl", "you can redistribute it and or modify it under the same terms as perl"),
    ("ruby", 35, 90, "ruby", "you can redistribute it and or modify it under the same terms as ruby"),
    ("lppl", 40, 90, "latex", "distributed and or modified under the conditions of the latex project public L"),
    ("ofl-1.1", 40, 95, "font", "this font software is licensed under the sil open font L version 1 1"),
    ("ofl", 35, 85, "reserved", "with reserved font name"),
    ("eupl", 40, 95, "eupl", "licensed under the eupl"),
    ("cecill", 40, 90, "cecill", "this software is governed by the cecill(?: b| c)? L"),
    ("osl-3.0", 40, 90, "open", "licensed under the open software L version 3 0"),
    ("afl-3.0", 40, 90, "academic", "licensed under the academic free L version 3 0"),
    ("qpl", 40, 85, "q", "may be distributed under the terms of the q public L"),
    ("sissl", 40, 85, "sissl", "sun industry standards source L sissl"),
    ("mulan-2", 40, 95, "mulan", "is licensed under mulan psl v2"),
    ("odbl", 40, 90, "database", "made available under the open database L"),
    ("ogl-3", 40, 90, "government", "contains public sector information licensed under the open government L"),
    # creative commons
    ("cc-by-4.0", 40, 95, "creative", "licensed under (?:a|the) creative commons attribution 4 0 international L"),
    ("cc-by-sa-4.0", 40, 95, "creative", "licensed under (?:a|the) creative commons attribution share ?alike 4 0 international L"),
    ("cc-by-nc-4.0", 40, 95, "creative", "licensed under (?:a|the) creative commons attribution non ?commercial 4 0 international L"),
    ("cc-by", 35, 90, "creativecommons", "creativecommons org licenses by [0-9]+ [0-9]+"),
    ("cc-by-sa", 35, 90, "creativecommons", "creativecommons org licenses by sa [0-9]+ [0-9]+"),
    ("cc-by-nc", 35, 90, "creativecommons", "creativecommons org licenses by nc [0-9]+ [0-9]+"),
    ("cc-by-nd", 35, 90, "creativecommons", "creativecommons org licenses by nd [0-9]+ [0-9]+"),
    ("cc-by-nc-sa", 35, 90, "creativecommons", "creativecommons org licenses by nc sa [0-9]+ [0-9]+"),
    ("cc-by-nc-nd", 35, 90, "creativecommons", "creativecommons org licenses by nc nd [0-9]+ [0-9]+"),
    ("cc0-1.0", 35, 90, "creativecommons", "creativecommons org publicdomain zero 1 0"),
    ("cc-sa", 20, 70, "sharealike|alike", "share ?alike L"),
    ("creative-commons", 10, 60, "creative", "creative commons"),
    # source-available and model licenses
    ("sspl", 40, 90, "service", "offering the program as a service .{1,160}? service source code"),
    ("busl", 40, 90, "business", "use of this software is governed by the business source L"),
    ("busl", 35, 80, "change", "change L (?:mpl|apache|gpl|gnu)"),
    ("elastic-2.0", 40, 90, "elastic", "licensed under the elastic L 2 0|subject to the elastic L 2 0"),
    ("commons-clause", 40, 95, "commons", "commons clause L condition v1 0"),
    ("polyform", 30, 90, "polyform", "polyform (?:noncommercial|small business|perimeter|shield|strict|internal use) L"),
    ("confluent", 30, 90, "confluent", "confluent community L"),
    ("timescale", 30, 90, "timescale", "timescale L"),
    ("rail", 40, 90, "creativeml", "creativeml open ?rail"),
    ("rail", 30, 85, "bigscience", "bigscience (?:open ?)?rail"),
    ("llama", 40, 90, "llama", "llama (?:2|3|3 1|3 2) is licensed under the llama"),
    ("gemma", 30, 90, "gemma", "gemma (?:is provided under and subject to the gemma )?terms of use"),
    ("non-commercial", 20, 75, "commercial|noncommercial", "(?:for )?non ?commercial (?:use|purposes) only"),
    ("research-only", 20, 75, "research", "(?:for )?(?:academic )?research (?:use|purposes) only"),
    ("evaluation", 20, 70, "evaluation", "evaluation (?:L|purposes only)"),
    ("shareware", 20, 70, "shareware", "shareware"),
    ("freeware", 20, 70, "freeware", "freeware"),
    # proprietary notices
    ("proprietary", 15, 70, "reserved", "all rights reserved"),
    ("proprietary", 15, 70, "proprietary", "proprietary and confidential"),
    ("proprietary", 20, 80, "unauthorized", "unauthorized (?:copying|reproduction|use|distribution) .{0,80}? (?:is )?(?:strictly )?prohibited"),
    ("proprietary", 20, 80, "proprietary", "proprietary (?:software|L|information of)"),
    ("proprietary", 20, 80, "eula", "eula"),
    ("proprietary", 20, 80, "agreement", "end user L agreement"),
    ("proprietary", 20, 75, "disclose|disclosed|disclosure", "trade secrets? .{0,80}? (?:not be )?disclosed?"),
    ("proprietary", 20, 75, "terminate|terminated|terminates", "your L (?:will|shall) terminate"),
    ("unspecified", 5, 40, "license|licence", "see (?:the )?L(?: file)?(?: for details)?"),
    ("unspecified", 5, 40, "license|licence", "L agreement"),
    ("open-source", 5, 40, "osi", "osi approved"),
    ("free-software", 5, 40, "software", "free software foundation"),
    # the way a license is granted, whatever its name
    ("dual", 25, 75, "dual", "dual licensed|dual L"),
    ("multiple", 25, 75, "choice", "at your choice .{0,40}? L|L of your choice"),
    ("mit", 25, 85, "mit", "(?:under|the) mit(?: x11)? (?:terms|style)"),
    ("bsd", 25, 80, "bsd", "bsd (?:style|type|like)(?: L)?"),
    ("apache-2.0", 25, 85, "asl|apache2", "asl 2 0|apache2"),
    ("mit-or-apache-2.0", 40, 90, "mit", "mit or apache 2 0|mit apache 2 0"),
    ("bsd-3-clause", 25, 85, "bsd3|bsd", "bsd3|bsd 3 clause|3 clause bsd"),
    ("bsd-2-clause", 25, 85, "bsd2|bsd", "bsd2|bsd 2 clause|2 clause bsd"),
)


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    confidence: int
    keyword: str  # of several, joined by |, a match holds one
    pattern: str  # over words that each stand between blanks of their own
    versioned: bool = False


def _pattern(words: str) -> str:
    """An expression over words with one blank between them as one over words that each have their own blanks."""
    return " (?:" + words.replace("L", "(?:license|licence)").replace(" ?", "(?: )?").replace(" ", "  ").replace(".{", "[^\\n]{") + ") "


def rules() -> tuple[Rule, ...]:
    """All rules, those of one keyword together."""
    out = [Rule(label, 30 if versions else 25, 90, key, _pattern(name + (f"(?: version| v)?(?: v?(?:{'|'.join(sorted(versions, key=len, reverse=True))}))?" if versions else "")), bool(versions)) for label, key, name, versions in NAMES]
    out += [Rule(label, 50, 100, "spdx", _pattern(f"spdx L identifier {words}")) for label, words in TAGS]
    out += [Rule(label, p, c, k, _pattern(words)) for label, p, c, k, words in TEXTS]
    return tuple(sorted(dict.fromkeys(out), key=lambda r: (r.keyword, -r.priority, r.label, r.pattern)))


RULES = rules()
KEYWORDS = tuple(sorted({k for r in RULES for k in r.keyword.split("|")} | {phrase.split()[0] for phrase, _ in BASE}))


def words_of(text: Column) -> Column:
    """The words of a text, lower-cased; an empty one first or last where the text begins or ends with a gap."""
    return F.split(F.translate(text, UPPER, LOWER), GAP, -1)


def _count(parts: Column) -> Column:
    """How many words words_of has found."""
    first, last = (F.element_at(parts, 1) == "").cast("int"), (F.element_at(parts, -1) == "").cast("int")
    return F.coalesce(F.greatest(F.size(parts) - first - last, F.lit(0)), F.lit(0)).cast("long")


def _normal(parts: Column) -> Column:
    """The words, each between two blanks of its own."""
    return F.concat(F.lit(" "), F.trim(F.array_join(parts, "  ")), F.lit(" "))


def _spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def _base(norm: Column) -> Column:
    """Per base phrase that occurs: places, and words before the first and last."""
    out = []
    for phrase, label in BASE:
        k = phrase.count(" ") + 1
        parts = F.split(norm, f" {phrase.replace(' ', '  ')} ", -1)
        n = (F.size(parts) - 1).cast("long")
        before = (_spaces(parts[0]) / 2).cast("long")
        after = (_spaces(F.element_at(parts, -1)) / 2).cast("long")
        total = (_spaces(norm) / 2).cast("long")
        one = F.struct(F.lit(label).alias("label"), n.alias("n"), before.alias("first"), (total - after - k).alias("last"))
        out.append(F.when(F.contains(norm, F.lit(f" {phrase.replace(' ', '  ')} ")), one))
    return F.array_compact(F.array(*out))


_FOUND = "array<struct<label:string,versioned:boolean,priority:int,confidence:int,found:array<string>,gaps:array<string>>>"
_INTERVAL = "array<struct<start:int,ends:int,priority:int,confidence:int,label:string>>"


def _matches(norm: Column, keys: Column) -> Column:
    """The matches of every rule with any: its keyword's group first, then the rule's own expression. keys: the keywords among the words."""
    groups = []
    for keyword, group in groupby(RULES, key=lambda r: r.keyword):
        of = list(group)
        due = F.lit(False)
        for k in keyword.split("|"):
            due = due | F.array_contains(keys, F.lit(k))
        if len(of) > 1:
            due = due & F.rlike(norm, F.lit("|".join(r.pattern for r in of)))
        each = [F.when(F.rlike(norm, F.lit(r.pattern)), F.struct(F.lit(r.label).alias("label"), F.lit(r.versioned).alias("versioned"), F.lit(r.priority).alias("priority"), F.lit(r.confidence).alias("confidence"), F.regexp_extract_all(norm, F.lit(r.pattern), F.lit(0)).alias("found"), F.split(norm, r.pattern, -1).alias("gaps"))) for r in of]
        groups.append(F.when(due, F.array(*each).cast(_FOUND)).otherwise(F.array().cast(_FOUND)))
    return F.array_compact(F.concat(*groups))


def _intervals(one: Column) -> Column:
    """The intervals of one rule's matches; a version goes into the label."""
    pairs = F.zip_with(one["found"], F.slice(one["gaps"], 1, F.size(one["found"])), lambda m, g: F.struct(F.length(g).alias("gap"), m.alias("match")))
    kind = f"struct<at:int,out:{_INTERVAL}>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_INTERVAL).alias("out")).cast(kind)

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        end = start + F.length(p["match"])
        version = F.regexp_extract(p["match"], r"  v?([0-9]+(?:  [0-9]+)*) $", 1)
        label = F.when(one["versioned"] & (version != ""), F.concat(one["label"], F.lit("-"), F.replace(version, F.lit("  "), F.lit(".")))).otherwise(one["label"])
        found = F.struct(start.alias("start"), (-end).alias("ends"), (-one["priority"]).alias("priority"), one["confidence"].alias("confidence"), label.alias("label"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(found)).alias("out")).cast(kind)

    return F.aggregate(pairs, zero, step, lambda acc: acc["out"])


def _levels() -> list[int]:
    return sorted({r.priority for r in RULES})


def _survivors(found: Column) -> Column:
    """Labels and greatest confidence of what is not suppressed: one fold over the intervals in order, with the farthest end of each priority."""
    levels = _levels()
    kind = "struct<" + ",".join(f"e{p}:int" for p in levels) + ",best:int,labels:array<string>>"
    zero = F.struct(*[F.lit(-1).alias(f"e{p}") for p in levels], F.lit(0).alias("best"), F.array().cast("array<string>").alias("labels")).cast(kind)

    def step(acc: Column, d: Column) -> Column:
        end, priority = -d["ends"], -d["priority"]
        hidden = F.lit(False)
        for p in levels:
            hidden = hidden | ((priority <= p) & (acc[f"e{p}"] >= end))
        ends = [F.when((priority == p) & (acc[f"e{p}"] < end), end).otherwise(acc[f"e{p}"]).alias(f"e{p}") for p in levels]
        return F.struct(*ends, F.when(hidden, acc["best"]).otherwise(F.greatest(acc["best"], d["confidence"])).alias("best"), F.when(hidden | F.array_contains(acc["labels"], d["label"]), acc["labels"]).otherwise(F.concat(acc["labels"], F.array(d["label"]))).alias("labels")).cast(kind)

    return F.aggregate(F.array_sort(found), zero, step, lambda acc: F.struct(acc["best"].alias("best"), acc["labels"].alias("labels")))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document."""
    step = docs.select("doc_id", words_of(F.col("text")).alias("parts"))
    step = step.withColumn("keys", F.array_intersect("parts", F.array(*[F.lit(k) for k in KEYWORDS])))
    step = step.select("doc_id", _count(F.col("parts")).alias("n_words"), "keys", F.when(F.size("keys") > 0, _normal(F.col("parts"))).alias("norm"))
    norm = F.col("norm")
    step = step.withColumns({"base": F.when(norm.isNotNull(), _base(norm)), "found": F.when(norm.isNotNull(), _matches(norm, F.col("keys")))}).drop("keys", "norm")
    step = step.withColumn("left", F.when(F.size("found") > 0, _survivors(F.flatten(F.transform("found", _intervals)))))
    hit = F.col("base")
    names = F.coalesce(F.transform(hit, lambda b: b["label"]), F.array().cast("array<string>"))
    every = F.array_union(names, F.coalesce(F.col("left.labels"), F.array().cast("array<string>")))
    n_base = F.coalesce(F.aggregate("base", F.lit(0).cast("long"), lambda a, b: a + b["n"]), F.lit(0).cast("long"))
    best = F.greatest(F.coalesce(F.col("left.best"), F.lit(0)), F.when(F.size(names) > 0, 85).otherwise(0))
    return step.select(
        "doc_id", "n_words", n_base.alias("n_base"),
        F.array_min(F.transform(hit, lambda b: b["first"])).alias("first_word"), F.array_max(F.transform(hit, lambda b: b["last"])).alias("last_word"),
        F.array_join(F.array_sort(names), ",").alias("base_labels"), F.array_join(F.array_sort(every), ",").alias("labels"), (best / 100.0).alias("score"),
    )
