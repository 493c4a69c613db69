"""Signatures of licence texts and notices, written by hand: label, priority, keyword, regex.

A regex matches whole lower-case words with one space between two (see ``licenses``), so
punctuation, line breaks and case of the text do not matter.  The keyword stands in every match.
Priorities: 95 an identifier line, 90 words that only one licence has, 85 words that a family
shares or an address, 80 a notice that names a licence, 60 a hint, 30 to 50 terms of any licence.
"""

from __future__ import annotations

Signature = tuple[str, int, str, str]

PERMISSIVE: tuple[Signature, ...] = (
    ("mit", 90, "permission", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", 85, "permission", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", 85, "permission", "the above copyright notice and this permission notice including the next paragraph shall be included in all copies"),
    ("mit", 80, "licen", "under the mit license"),
    ("mit", 80, "licen", "(?:the )?mit license mit"),
    ("mit", 85, "licen", "opensource org licenses mit"),
    ("mit", 85, "licen", "released under an mit style license"),
    ("mit", 82, "licen", "dual licensed under (?:the )?mit"),
    ("mit", 60, "licen", "mit licensed"),
    ("x11", 90, "copyright", "except as contained in this notice the names? of the above copyright holders? shall not be used in advertising"),
    ("x11", 88, "advertising", "except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("isc", 90, "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", 90, "permission", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", 85, "licen", "opensource org licenses isc"),
    ("isc", 80, "licen", "the isc license"),
    ("bsd", 85, "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", 82, "copyright", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", 82, "copyright", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", 60, "licen", "bsd licensed"),
    ("bsd", 78, "licen", "governed by a bsd style license that can be found in the license file"),
    ("bsd-2", 85, "licen", "opensource org licenses bsd 2 clause"),
    ("bsd-3", 88, "endorse", "neither the names? of .{0,80}may be used to endorse or promote products derived from"),
    ("bsd-3", 88, "endorse", "the names? of .{0,60}may not be used to endorse or promote products derived from this software without"),
    ("bsd-3", 85, "licen", "opensource org licenses bsd 3 clause"),
    ("bsd-3-clear", 91, "licen", "no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-4", 90, "advertising", "all advertising materials mentioning features or use of this software must display"),
    ("bsd-2-patent", 90, "licen", "subject to the terms and conditions of this license each copyright holder and contributor hereby grants .{0,160}patent license"),
    ("bsd-0", 88, "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("apache-1", 90, "apache", "this product includes software developed by the apache software foundation"),
    ("apache-1", 90, "apache", "the apache software license version 1 [01]"),
    ("apache-1", 88, "apache", "the names apache and apache software foundation must not be used to endorse"),
    ("apache-2", 90, "apache", "apache license version 2 0 january 2004"),
    ("apache-2", 90, "licen", "you may not use this file except in compliance with the license"),
    ("apache-2", 85, "apache", "www apache org licenses license 2 0"),
    ("apache-2", 82, "apache", "apache license version 2(?: 0)?"),
    ("apache-2", 85, "licen", "opensource org licenses apache 2 0"),
    ("apache-2", 84, "licen", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2", 84, "licen", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2", 84, "licen", "see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2", 86, "apache", "appendix how to apply the apache license to your work"),
    ("boost", 90, "boost", "boost software license version 1 0 august 17th 2003"),
    ("boost", 88, "boost", "distributed under the boost software license version 1 0"),
    ("boost", 85, "boost", "www boost org license 1 0 txt"),
    ("boost", 86, "permission", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("zlib", 88, "warrant", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", 88, "permission", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("zlib", 85, "misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", 84, "misrepresented", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("libpng", 88, "png reference", "the png reference library is supplied as is"),
    ("libpng", 86, "copyright", "this copyright notice may not be removed or altered from any source or altered source distribution"),
    ("wtfpl", 85, "wtfpl", "wtfpl"),
    ("wtfpl", 90, "licen", "do what the f\\w+ you want to public license"),
    ("wtfpl", 88, "licen", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("unlicense", 90, "public domain", "this is free and unencumbered software released into the public domain"),
    ("unlicense", 85, "licen", "for more information please refer to (?:https? )?unlicense org"),
    ("unlicense", 86, "copyright", "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest"),
    ("openssl", 85, "openssl", "developed by the openssl project for use in the openssl toolkit"),
    ("openssl", 88, "openssl", "the names openssl toolkit and openssl project must not be used to endorse"),
    ("ssleay", 88, "ssl implementation", "this package is an ssl implementation written by eric young"),
    ("unicode", 85, "unicode data", "unicode data files or software"),
    ("unicode", 88, "licen", "unicode inc license agreement data files and software"),
    ("python", 88, "licen", "psf license agreement for python"),
    ("python", 88, "licen", "python software foundation license version 2"),
    ("python", 86, "licen", "psf is making python available to licensee on an as is basis"),
    ("cnri-python", 88, "licen", "cnri open source license agreement"),
    ("postgresql", 90, "permission", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("postgresql", 86, "licen", "the postgresql licen[cs]e"),
    ("php", 88, "licen", "the php license version 3 0"),
    ("php", 86, "php software", "this product includes php software freely available from"),
    ("ruby", 86, "copyright", "ruby is copyrighted free software by yukihiro matsumoto"),
    ("ncsa", 88, "licen", "university of illinois ncsa open source license"),
    ("ncsa", 86, "permission", "permission is hereby granted free of charge to any person obtaining a copy of this software .{0,60}to deal with the software without restriction"),
    ("curl", 88, "permission", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("hpnd", 86, "permission", "permission to use copy modify and distribute this software and its documentation for any purpose .{0,30}is hereby granted provided that the above copyright notice appears? in all copies"),
    ("ntp", 87, "permission", "university of delaware not be used in advertising or publicity .{0,90}permission"),
    ("w3c", 88, "licen", "w3c software (?:and document )?notice and license"),
    ("w3c", 86, "licen", "this work is being provided by the copyright holders under the following license"),
    ("beerware", 90, "licen", "the beer ware license revision 42"),
    ("beerware", 86, "retain this notice", "as long as you retain this notice you can do whatever you want with this stuff"),
    ("jpeg", 86, "independent jpeg", "this software is based in part on the work of the independent jpeg group"),
    ("freetype", 88, "licen", "the freetype project license"),
    ("freetype", 85, "copyright", "portions of this software are copyright .{0,24}the freetype project"),
    ("info-zip", 88, "copyright", "for the purposes of this copyright and license info zip is defined as the following set of individuals"),
    ("bzip2", 86, "libbzip2", "bzip2 and associated library libbzip2"),
    ("tcl", 88, "permission", "the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose"),
    ("json", 92, "good not evil", "the software shall be used for good not evil"),
    ("icu", 86, "licen", "icu license icu 1 8 1 and later"),
    ("blueoak", 88, "licen", "blue oak model license"),
    ("mulan-psl", 88, "licen", "mulan permissive software license"),
    ("upl", 88, "licen", "the universal permissive license upl version 1 0"),
    ("ms-pl", 88, "licen", "microsoft public license ms pl"),
    ("artistic-1", 88, "artistic", "the artistic license preamble the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2", 88, "artistic", "the artistic license 2 0"),
    ("artistic-2", 85, "artistic", "www perlfoundation org artistic license 2 0"),
    ("perl", 86, "perl itself", "you can redistribute it and or modify it under the same terms as perl itself"),
    ("afl-3", 88, "licen", "academic free license version 3 0"),
    ("naist", 86, "nara institute", "use of this software .{0,80}nara institute of science and technology"),
    ("vim", 88, "licen", "vim license i there are no restrictions on distributing unmodified copies of vim"),
)

COPYLEFT: tuple[Signature, ...] = (
    ("gpl", 80, "gnu", "gnu general public license as published by the free software foundation"),
    ("gpl", 60, "gpl", "gpl(?: licensed| compatible)"),
    ("gpl", 78, "gnu", "you should have received a copy of the gnu general public license along with this program"),
    ("gpl", 76, "gnu", "see the gnu general public license for more details"),
    ("gpl", 78, "gnu", "www gnu org licenses gpl html"),
    ("gpl", 75, "gnu", "www gnu org copyleft gpl html"),
    ("gpl-1", 90, "gnu", "gnu general public license version 1 february 1989"),
    ("gpl-1", 86, "licen", "free software foundation either version 1 of the license or at your option any later version"),
    ("gpl-2", 88, "licen", "free software foundation either version 2 of the license"),
    ("gpl-2", 90, "gnu", "gnu general public license version 2 june 1991"),
    ("gpl-2", 86, "gnu", "gnu general public license version 2 only"),
    ("gpl-2", 85, "gnu", "terms of the gnu general public license version 2"),
    ("gpl-2", 85, "gnu", "www gnu org licenses old licenses gpl 2 0"),
    ("gpl-2", 85, "licen", "opensource org licenses gpl 2 0"),
    ("gpl-2", 84, "gpl", "(?:licensed|released|distributed) under (?:the )?gpl ?v?2"),
    ("gpl-2-classpath", 91, "special exception", "linking this library statically or dynamically with other modules is making a combined work based on this library .{0,200}as a special exception"),
    ("gpl-2-classpath", 90, "gpl", "gpl v?2 with (?:the )?classpath exception"),
    ("gpl-3", 88, "licen", "free software foundation either version 3 of the license"),
    ("gpl-3", 90, "gnu", "gnu general public license version 3 29 june 2007"),
    ("gpl-3", 85, "gnu", "www gnu org licenses gpl 3 0"),
    ("gpl-3", 85, "licen", "opensource org licenses gpl 3 0"),
    ("gpl-3", 84, "gpl", "(?:licensed|released|distributed) under (?:the )?gpl ?v?3"),
    ("gpl-3-gcc", 90, "runtime library exception", "gcc runtime library exception version 3 1"),
    ("gpl-bison", 88, "special exception", "as a special exception you may create a larger work that contains part or all of the bison parser skeleton"),
    ("gpl-autoconf", 88, "special exception", "as a special exception .{0,80}configuration script generated by autoconf"),
    ("lgpl", 80, "gnu", "gnu (?:lesser|library) general public license as published by the free software foundation"),
    ("lgpl", 78, "gnu", "you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("lgpl", 76, "gnu", "see the gnu (?:lesser|library) general public license for more details"),
    ("lgpl-2", 90, "gnu", "gnu library general public license version 2 june 1991"),
    ("lgpl-2.1", 90, "gnu", "gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-2.1", 89, "licen", "free software foundation either version 2 1 of the license"),
    ("lgpl-2.1", 85, "gnu", "www gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("lgpl-3", 90, "gnu", "gnu lesser general public license version 3 29 june 2007"),
    ("lgpl-3", 85, "gnu", "www gnu org licenses lgpl 3 0"),
    ("lgpl-3", 84, "gpl", "(?:licensed|released|distributed) under (?:the )?lgpl ?v?3"),
    ("agpl-3", 90, "gnu", "gnu affero general public license version 3 19 november 2007"),
    ("agpl-3", 86, "gnu", "gnu affero general public license as published by the free software foundation either version 3"),
    ("agpl-3", 85, "gnu", "www gnu org licenses agpl 3 0"),
    ("agpl-3", 80, "gnu", "you should have received a copy of the gnu affero general public license"),
    ("agpl-1", 88, "licen", "affero general public license version 1 march 2002"),
    ("gfdl", 88, "gnu", "gnu free documentation license version 1 [123]"),
    ("gfdl", 86, "gnu", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", 84, "invariant sections", "with no invariant sections no front cover texts and no back cover texts"),
    ("mpl-1", 88, "mozilla", "contents of this file are subject to the mozilla public license version 1 [01]"),
    ("mpl-1", 85, "mozilla", "www mozilla org mpl mpl 1 1"),
    ("mpl-1-tri", 90, "mozilla", "version mpl 1 1 gpl 2 0 lgpl 2 1 the contents of this file are subject to the mozilla public license"),
    ("mpl-2", 90, "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2", 85, "mozilla", "(?:www )?mozilla org mpl 2 0"),
    ("mpl-2", 88, "mozilla", "mozilla public license version 2 0"),
    ("mpl-2", 84, "licen", "this source code form is incompatible with secondary licenses"),
    ("npl", 88, "netscape", "netscape public license version 1 [01]"),
    ("epl-1", 88, "eclipse", "terms of the eclipse public license v1 0"),
    ("epl-1", 85, "eclipse", "www eclipse org legal epl v10 html"),
    ("epl-2", 88, "eclipse", "terms of the eclipse public license 2 0"),
    ("epl-2", 85, "eclipse", "www eclipse org legal epl 2 0"),
    ("epl-2", 86, "eclipse", "eclipse public license v 2 0"),
    ("edl-1", 88, "eclipse", "eclipse distribution license v ?1 0"),
    ("cpl", 88, "licen", "common public license version 1 0"),
    ("ipl", 88, "licen", "ibm public license version 1 0"),
    ("cddl", 88, "licen", "common development and distribution license cddl version 1 [01]"),
    ("cddl", 86, "licen", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl", 85, "licen", "you can obtain a copy of the license at usr src opensolaris license"),
    ("cpal", 88, "licen", "common public attribution license version 1 0"),
    ("eupl", 88, "licen", "european union public licence v 1 [012]"),
    ("eupl", 86, "licen", "licensed under the eupl"),
    ("cecill", 88, "licen", "cecill free software license agreement"),
    ("cecill", 86, "cecill", "this software is governed by the cecill"),
    ("cecill-b", 87, "cecill", "governed by the cecill b license under french law"),
    ("cecill-c", 87, "cecill", "governed by the cecill c license under french law"),
    ("osl-3", 88, "licen", "open software license version 3 0"),
    ("ms-rl", 88, "licen", "microsoft reciprocal license ms rl"),
    ("qpl", 88, "licen", "the q public license version 1 0"),
    ("apsl", 88, "licen", "apple public source license"),
    ("sleepycat", 88, "redistribution", "redistributions in any form must be accompanied by information on how to obtain complete source code .{0,40}redistribution"),
    ("oclc", 86, "licen", "oclc research public license 2 0"),
    ("rpl", 88, "licen", "reciprocal public license"),
    ("ofl", 88, "licen", "sil open font license version 1 1"),
    ("ofl", 86, "licen", "this font software is licensed under the sil open font license"),
    ("ofl", 85, "font software", "with reserved font name .{0,60}font software"),
    ("odbl", 86, "licen", "opendatacommons org licenses odbl"),
    ("odbl", 85, "licen", "open data(?:base| commons open database) license odbl"),
    ("odc-by", 86, "licen", "opendatacommons org licenses by"),
    ("pddl", 86, "licen", "opendatacommons org licenses pddl"),
    ("parity", 86, "licen", "the parity public license"),
    ("hippocratic", 86, "licen", "hippocratic license"),
)

CONTENT: tuple[Signature, ...] = (
    ("cc0", 90, "creative", "creative commons legal code cc0 1 0 universal"),
    ("cc0", 86, "creative", "creativecommons org publicdomain zero 1 0"),
    ("cc0", 84, "copyright", "waived all copyright and related or neighboring rights to this work"),
    ("cc0", 84, "creative", "cc0 1 0 universal creative commons"),
    ("public-domain-mark", 86, "creative", "creativecommons org publicdomain mark 1 0"),
    ("cc-by", 85, "creative", "creative commons attribution (?:[1234] 0 )?(?:international|unported|generic)"),
    ("cc-by", 84, "creative", "creativecommons org licenses by [1234] [05]"),
    ("cc-by", 82, "creative", "licensed under a creative commons attribution [1234] 0"),
    ("cc-by-sa", 86, "creative", "creative commons attribution share ?alike (?:[1234] 0 )?(?:international|unported|generic)"),
    ("cc-by-sa", 85, "creative", "creativecommons org licenses by sa [1234] [05]"),
    ("cc-by-sa", 65, "cc by", "cc by sa"),
    ("cc-by-nd", 86, "creative", "creative commons attribution no ?deriv(?:ative)?s (?:[1234] 0 )?(?:international|unported|generic)"),
    ("cc-by-nd", 85, "creative", "creativecommons org licenses by nd [1234] [05]"),
    ("cc-by-nd", 65, "cc by", "cc by nd"),
    ("cc-by-nc", 86, "creative", "creative commons attribution non ?commercial (?:[1234] 0 )?(?:international|unported|generic)"),
    ("cc-by-nc", 85, "creative", "creativecommons org licenses by nc [1234] [05]"),
    ("cc-by-nc", 65, "cc by", "cc by nc"),
    ("cc-by-nc-sa", 87, "creative", "creative commons attribution non ?commercial share ?alike (?:[1234] 0 )?(?:international|unported|generic)"),
    ("cc-by-nc-sa", 86, "creative", "creativecommons org licenses by nc sa [1234] [05]"),
    ("cc-by-nc-sa", 66, "cc by", "cc by nc sa"),
    ("cc-by-nc-nd", 87, "creative", "creative commons attribution non ?commercial no ?deriv(?:ative)?s (?:[1234] 0 )?(?:international|unported|generic)"),
    ("cc-by-nc-nd", 86, "creative", "creativecommons org licenses by nc nd [1234] [05]"),
    ("cc-by-nc-nd", 66, "cc by", "cc by nc nd"),
    ("cc", 55, "creative", "some rights reserved creative commons"),
    ("cc", 50, "creative", "(?:under|by) a creative commons licen[cs]e"),
    ("public-domain", 70, "public domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", 60, "public domain", "(?:is|are) in the public domain"),
    ("public-domain", 62, "public domain", "public domain dedication"),
    ("public-domain", 62, "public domain", "(?:we|i) hereby place (?:this|it) .{0,30}in the public domain"),
    ("public-domain", 62, "copyright", "no copyright is claimed"),
    ("us-government", 70, "copyright", "works? of the united states government .{0,60}not subject to .{0,30}copyright"),
    ("ogl-uk", 86, "licen", "open government licen[cs]e v ?[123] 0"),
    ("ogl-uk", 84, "licen", "contains public sector information licensed under the open government licence"),
    ("etalab", 86, "licen", "licence ouverte open licence"),
    ("dl-de-by", 86, "licen", "data licence germany attribution version 2 0"),
    ("fal", 86, "licen", "free art license 1 3"),
    ("gutenberg", 86, "licen", "under the terms of the project gutenberg license"),
    ("gutenberg", 80, "licen", "project gutenberg tm license"),
    ("cdla-permissive", 86, "licen", "community data license agreement permissive version [12] 0"),
    ("cdla-sharing", 86, "licen", "community data license agreement sharing version 1 0"),
    ("oasis", 80, "copyright", "copyright .{0,20}oasis open"),
    ("ietf", 84, "copyright", "this document is subject to bcp 78 and the ietf trust s legal provisions .{0,120}copyright"),
)

LIMITED: tuple[Signature, ...] = (
    ("bsl", 88, "licen", "business source license 1 1"),
    ("bsl", 84, "licen", "change license .{0,40}change date"),
    ("sspl", 88, "licen", "server side public license version 1"),
    ("elastic", 88, "licen", "elastic license 2 0 elv2"),
    ("elastic", 86, "licen", "you may not provide the software to third parties as a hosted or managed service .{0,200}license key"),
    ("confluent", 88, "licen", "confluent community license(?: agreement)? version 1 0"),
    ("timescale", 86, "licen", "timescale license agreement"),
    ("polyform-nc", 88, "licen", "polyform noncommercial license 1 0 0"),
    ("polyform-sb", 88, "licen", "polyform small business license 1 0 0"),
    ("polyform-shield", 88, "licen", "polyform shield license 1 0 0"),
    ("polyform-strict", 88, "licen", "polyform strict license 1 0 0"),
    ("prosperity", 86, "licen", "the prosperity public license 3 0 0"),
    ("commons-clause", 89, "licen", "commons clause license condition v1 0"),
    ("commons-clause", 88, "licen", "the grant of rights under the license will not include and the license does not grant to you the right to sell the software"),
    ("fsl", 88, "licen", "functional source license version 1 [01]"),
    ("rail", 86, "licen", "responsible ai license"),
    ("openrail-m", 88, "licen", "creativeml open rail m license"),
    ("openrail-m", 86, "licen", "bigscience (?:open )?rail (?:m )?license v1 0"),
    ("llama", 86, "licen", "llama [23] (?:[12] )?community license agreement"),
    ("gemma", 80, "gemma terms", "gemma is provided under and subject to the gemma terms of use"),
    ("jrl", 86, "licen", "java research license"),
    ("bcl", 86, "licen", "oracle binary code license agreement"),
    ("otn", 86, "licen", "oracle technology network license agreement"),
    ("nvidia", 84, "licen", "nvidia software license agreement"),
    ("nvidia", 82, "proprietary", "nvidia corporation and its licensors retain all intellectual property and proprietary rights"),
    ("intel", 84, "licen", "intel simplified software license"),
    ("ms-eula", 84, "licen", "microsoft software license terms"),
    ("adobe", 84, "licen", "adobe systems incorporated .{0,40}source code license agreement"),
    ("aladdin", 86, "licen", "aladdin free public license"),
    ("evaluation", 70, "licen", "(?:for )?evaluation (?:purposes|use) only .{0,60}licens"),
    ("non-commercial", 72, "licen", "licensed for non ?commercial (?:use|purposes) only"),
    ("non-commercial", 66, "non commercial", "free for non commercial use"),
    ("academic", 72, "licen", "licensed for academic (?:and research )?use only"),
    ("eula", 60, "licen", "end user licen[cs]e agreement"),
    ("eula", 62, "licen", "by (?:installing|downloading|using) (?:the|this) software you (?:agree|accept) .{0,60}licen[cs]e"),
    ("proprietary", 40, "rights reserved", "all rights reserved"),
    ("proprietary", 60, "licen", "(?:this|the) software is licensed not sold"),
    ("proprietary", 60, "proprietary", "(?:this|the) software is proprietary"),
    ("proprietary", 65, "unauthori", "unauthori[sz]ed (?:copying|use|reproduction|distribution) of this .{0,60}is (?:strictly )?prohibited"),
    ("proprietary", 62, "proprietary", "proprietary and confidential"),
    ("proprietary", 62, "trade secret", "contains (?:confidential information and )?trade secrets? of"),
    ("proprietary", 58, "permission", "(?:may not|must not) be (?:copied|reproduced|redistributed) .{0,40}without .{0,30}permission"),
    ("proprietary", 58, "licen", "may not (?:reverse engineer decompile or disassemble|decompile|disassemble) .{0,80}licen"),
    ("proprietary", 58, "proprietary", "no license express or implied .{0,80}proprietary"),
    ("as-is", 30, "warrant", "without warranty of any kind"),
    ("as-is", 30, "warrant", "without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("as-is", 30, "warrant", "provided as is and any express or implied warranties"),
)

#: In the order in which they are tried; of two equal detections the first rule's stays.
SIGNATURES: tuple[Signature, ...] = PERMISSIVE + COPYLEFT + CONTENT + LIMITED
