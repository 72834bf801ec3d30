"""Signatures of licenses, written by hand: sentences of their grants, conditions, warranties and notices, tags and addresses.

Each is (label, pattern, keyword); the keyword is in every text that the pattern matches, and texts come lower-cased with
single spaces. The order is that of priority among signatures of the same rank.
"""

from __future__ import annotations

#: Grants and conditions: sentences that only the license itself or its notice has.
GRANTS = [
    ("mit-0", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files \(the [\"“']?software[\"”']?\), to deal in the software without restriction, [^.]{0,200}to whom the software is furnished to do so\. the software is provided", "hereby granted"),
    ("x11", r"shall not be used in advertising or otherwise to promote the sale, use or other dealings in this software without prior written authorization", "used in advertising"),
    ("mit", r"permission is hereby granted, free of charge, to any person obtaining a copy", "hereby granted"),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "this permission notice"),
    ("mit", r"to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish", "without restriction"),
    ("mit-modern", r"permission is hereby granted, without written agreement and without license or royalty fees, to use, copy, modify, and distribute", "hereby granted"),
    ("hpnd", r"permission to use, copy, modify,? and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted", "permission to use"),
    ("isc", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee", "permission to use"),
    ("0bsd", r"permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted\. the software is provided", "hereby granted"),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", "advertising materials"),
    ("bsd-3-clause", r"neither the names? of (?:the )?.{1,120}? nor the names of (?:its|their|any) contributors may be used to endorse or promote products", "endorse or promote"),
    ("bsd-3-clause-clear", r"no express or implied licenses to any party's patent rights are granted by this license", "patent rights"),
    ("bsd", r"redistribution and use in source and binary forms, with or without modification", "redistribution and use"),
    ("bsd", r"redistributions of source code must retain the above copyright notice", "redistributions of source"),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice", "redistributions in binary"),
    ("apache-2.0", r"licensed under the apache license, version 2\.0 \(the [\"“']license[\"”']\); you may not use this file except in compliance", "apache license"),
    ("apache-2.0", r"you may obtain a copy of the license at https?://(?:www\.)?apache\.org/licenses/license-2\.0", "apache.org"),
    ("apache-2.0", r"each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license", "each contributor"),
    ("apache-1.1", r"this product includes software developed by the apache software foundation", "apache software foundation"),
    ("gpl", r"this program is free software[;:,] you can redistribute it and/or modify it under the terms of the gnu general public license", "free software"),
    ("gpl-3.0-or-later", r"gnu general public license as published by the free software foundation,? either version 3(?: of the license)?,? or \(at your option\) any later version", "free software foundation"),
    ("gpl-2.0-or-later", r"gnu general public license as published by the free software foundation[;,] either version 2(?: of the license)?,? or \(at your option\) any later version", "free software foundation"),
    ("gpl-2.0-only", r"gnu general public license version 2,? as published by the free software foundation", "free software foundation"),
    ("gpl", r"you should have received a copy of the gnu general public license along with", "gnu general public license"),
    ("gpl", r"the licenses for most software are designed to take away your freedom to share and change it", "take away your freedom"),
    ("gpl-3.0", r"the gnu general public license is a free, copyleft license for software and other kinds of works", "copyleft"),
    ("gpl-3.0", r"conveying under any other circumstances is permitted solely under the conditions stated below", "conveying"),
    ("gpl-exception", r"as a special exception, (?:the copyright holders|you may|the free software foundation) .{0,80}?(?:give|gives|link|create|use)", "special exception"),
    ("classpath-exception", r"linking this library statically or dynamically with other modules is making a combined work", "statically or dynamically"),
    ("lgpl", r"this library is free software[;:,] you can redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public license", "free software"),
    ("lgpl-2.1-or-later", r"gnu lesser general public license as published by the free software foundation[;,] either version 2\.1", "lesser general public"),
    ("lgpl-3.0-or-later", r"gnu lesser general public license as published by the free software foundation[;,] either version 3", "lesser general public"),
    ("lgpl", r"you should have received a copy of the gnu (?:lesser|library) general public license along with", "general public license"),
    ("agpl", r"under the terms of the gnu affero general public license", "affero"),
    ("agpl-3.0", r"interacting with it remotely through a computer network .{0,80}an opportunity to receive the corresponding source", "remotely through a computer network"),
    ("gfdl", r"permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license", "free documentation"),
    ("gfdl", r"with no invariant sections, (?:with )?no front-cover texts,? and (?:with )?no back-cover texts", "invariant sections"),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license,? v(?:\.|ersion)? ?2\.0", "source code form"),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public license version 1\.1", "mozilla public"),
    ("mpl-2.0", r"incompatible with secondary licenses", "secondary licenses"),
    ("epl-2.0", r"this program and the accompanying materials are made available under the terms of the eclipse public license(?: v(?:ersion)?)? ?2\.0", "accompanying materials"),
    ("epl-1.0", r"this program and the accompanying materials are made available under the terms of the eclipse public license v ?1\.0", "accompanying materials"),
    ("epl", r"the accompanying program is provided under the terms of this eclipse public license", "accompanying program"),
    ("cddl", r"the contents of this file are subject to the terms of (?:either )?the common development and distribution license", "common development"),
    ("cpl-1.0", r"the accompanying program is provided under the terms of this common public license", "common public license"),
    ("eupl", r"licensed under the eupl,? (?:v(?:ersion)?)? ?1\.[012]", "eupl"),
    ("osl-3.0", r"licensed under the open software license version 3\.0", "open software license"),
    ("afl-3.0", r"licensed under the academic free license version 3\.0", "academic free"),
    ("artistic-2.0", r"everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed\. preamble this license establishes the terms under which a given free software package", "verbatim copies"),
    ("artistic-1.0", r"the intent of this document is to state the conditions under which a package may be copied", "a package may be copied"),
    ("perl", r"(?:free software[;,] you can|you may) redistribute it and/or modify it under the same terms as perl itself", "perl itself"),
    ("bsl-1.0", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "person or organization"),
    ("bsl-1.0", r"distributed under the boost software license,? version 1\.0", "boost software"),
    ("bsl-1.0", r"machine-executable object code generated by a source language processor", "source language processor"),
    ("zlib", r"this software is provided ['\"]as-is['\"], without any express or implied warranty", "as-is"),
    ("zlib", r"permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", "granted to anyone"),
    ("zlib", r"altered source versions must be plainly marked as such,? and must not be misrepresented as being the original software", "plainly marked"),
    ("libpng", r"the origin of this source code must not be misrepresented", "misrepresented"),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered"),
    ("unlicense", r"anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", "anyone is free"),
    ("cc0-1.0", r"to the extent possible under law, .{1,80}? (?:has|have) waived all copyright and related or neighbou?ring rights", "neighbo"),
    ("cc0-1.0", r"the person who associated a work with this deed has dedicated the work to the public domain", "this deed"),
    ("wtfpl", r"you just do what the fuck you want to", "do what the fuck"),
    ("beerware", r"if we meet some day,? and you think this stuff is worth it,? you can buy me a beer", "buy me a beer"),
    ("json", r"the software shall be used for good,? not evil", "not evil"),
    ("psf-2.0", r"this license agreement is between the python software foundation", "python software foundation"),
    ("cnri-python", r"corporation for national research initiatives", "national research initiatives"),
    ("openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit", "openssl"),
    ("ssleay", r"this product includes cryptographic software written by eric young", "cryptographic software"),
    ("php-3.01", r"this product includes php software, freely available from", "php software"),
    ("ruby", r"you may make and give away verbatim copies of the source form of the software without restriction", "give away verbatim"),
    ("vim", r"there are no restrictions on distributing unmodified copies of vim", "copies of vim"),
    ("postgresql", r"permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted", "without a written agreement"),
    ("curl", r"permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "permission to use"),
    ("ncsa", r"to deal with the software without restriction, including without limitation the rights to use", "deal with the software"),
    ("w3c", r"by obtaining, using and/or copying this work, you \(the licensee\) agree", "the licensee"),
    ("w3c", r"the full text of this notice in a location viewable to users of the redistributed or derivative work", "full text of this notice"),
    ("ofl-1.1", r"this font software is licensed under the sil open font license", "font software"),
    ("ofl", r"the font software may not be sold by itself", "font software"),
    ("ofl", r"with reserved font names?\b", "reserved font name"),
    ("ecl-2.0", r"licensed under the educational community license", "educational community"),
    ("ms-pl", r"if you use the software, you accept this license\. if you do not accept the license, do not use the software", "accept this license"),
    ("ms-rl", r"for any file you distribute that contains code from the software .{0,120}you must provide recipients the source code", "recipients the source code"),
    ("upl-1.0", r"a license under any and all copyright rights in the software, and any and all patent rights owned or freely licensable", "freely licensable"),
    ("bsl-business-1.1", r"the licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non-production use", "non-production use"),
    ("bsl-business-1.1", r"\bchange date:? .{1,40} change license:?", "change license"),
    ("sspl-1.0", r"if you make the functionality of the program or a modified version available to third parties as a service", "as a service"),
    ("elastic-2.0", r"you may not provide the software to third parties as a hosted or managed service", "managed service"),
    ("commons-clause", r"without limiting other conditions in the license, the grant of rights under the license will not include .{0,80}the right to sell the software", "right to sell"),
    ("polyform", r"the licensor grants you a copyright license for the software to do everything you might do with the software that would otherwise infringe", "otherwise infringe"),
    ("odbl-1.0", r"made available under the open database license", "open database"),
    ("pddl", r"open data commons public domain dedication", "open data commons"),
    ("odc-by", r"open data commons attribution license", "open data commons"),
    ("openrail", r"use-based restrictions", "use-based restrictions"),
    ("llama", r"if,? on the .{0,60}release date, the monthly active users of the products or services .{0,120}is greater than 700 million", "700 million"),
    ("cc-by", r"you must give appropriate credit, provide a link to the license, and indicate if changes were made", "appropriate credit"),
    ("cc-by-sa", r"if you remix, transform, or build upon the material, you must distribute your contributions under the same license", "same license"),
    ("cc-by-nc", r"you may not use the material for commercial purposes", "commercial purposes"),
    ("cc-by-nd", r"if you remix, transform, or build upon the material, you may not distribute the modified material", "modified material"),
    ("cc-by", r"this work is licensed under a creative commons attribution [\d.]+ (?:international|unported|generic) licen[cs]e", "creative commons"),
    ("public-domain", r"\b(?:dedicated to|released into|released to|placed in|placed into|is in|are in|in) the public domain\b", "public domain"),
    ("public-domain", r"no copyright is claimed\b", "no copyright"),
    ("public-domain", r"this (?:file|work|code|software) (?:has been|is) (?:put|placed) in the public domain", "public domain"),
    ("crown-copyright", r"contains public sector information licensed under the open government licen[cs]e", "open government"),
    ("government", r"a work of the united states government", "united states government"),
]

#: Disclaimers of warranty, which go with families of licenses; weaker evidence than a grant.
WARRANTIES = [
    ("mit", r"the software is provided [\"“']as is[\"”'],? without warranty of any kind, express or implied, including but not limited to the warranties of merchantability", "without warranty of any kind"),
    ("bsd", r"this software is provided by .{1,120}?[\"“']{0,2}as is[\"”']{0,2} and any express or implied warranties", "implied warranties"),
    ("bsd", r"in no event shall .{1,120}? be liable for any direct, indirect, incidental, special, exemplary, or consequential damages", "in no event shall"),
    ("apache-2.0", r"distributed on an [\"“']as is[\"”'] basis, without warranties or conditions of any kind, either express or implied", "without warranties or conditions"),
    ("gpl", r"distributed in the hope that it will be useful, but without any warranty[;,] without even the implied warranty of merchantability or fitness for a particular purpose", "hope that it will be useful"),
    ("isc", r"the author disclaims all warranties with regard to this software", "disclaims all warranties"),
    ("mpl", r"covered (?:software|code) is provided under this license on an [\"“']as is[\"”'] basis", "under this license on an"),
    ("epl", r"except as expressly set forth in this agreement, (?:and to the extent permitted by applicable law, )?the program is provided on an [\"“']as is[\"”'] basis", "expressly set forth"),
    ("artistic", r"the package is provided by the copyright holder and contributors [\"“']as is[\"”']", "the package is provided"),
    ("openssl", r"this software is provided by the openssl project", "openssl project"),
    ("warranty-disclaimer", r"without warranty of any kind\b", "without warranty"),
    ("warranty-disclaimer", r"there is no warranty for the program", "no warranty"),
    ("warranty-disclaimer", r"\bprovided [\"“']?as[ -]is[\"”']?,? (?:and )?(?:without|with no) (?:any )?warrant(?:y|ies)", "provided"),
    ("warranty-disclaimer", r"\bno warrant(?:y|ies),? (?:is |are )?(?:express(?:ed)?|either)(?: or |,? )?(?:implied)?", "no warrant"),
    ("liability-disclaimer", r"\bin no event (?:shall|will) the (?:authors?|copyright holders?|contributors?)\b", "in no event"),
]

#: Short names, tags, addresses and headers.
MARKS = [
    ("cc0", r"\bcc[ -]?0(?:[ -]1\.0)?\b", "cc"), ("cc0", r"creativecommons\.org/publicdomain/zero", "creativecommons"), ("public-domain", r"creativecommons\.org/publicdomain/mark", "creativecommons"),
    ("mit", r"\bopensource\.org/licenses?/mit\b", "opensource.org"), ("bsd", r"\bopensource\.org/licenses?/bsd-[234]-clause\b", "opensource.org"), ("bsd", r"\bopensource\.org/licenses?/bsd-license", "opensource.org"),
    ("isc", r"\bopensource\.org/licenses?/isc\b", "opensource.org"), ("apache-2.0", r"\bopensource\.org/licenses?/apache-2\.0\b", "opensource.org"), ("gpl", r"\bopensource\.org/licenses?/[al]?gpl-", "opensource.org"), ("zlib", r"\bopensource\.org/licenses?/zlib\b", "opensource.org"), ("mpl", r"\bopensource\.org/licenses?/mpl-", "opensource.org"),
    ("apache", r"\bapache\.org/licenses/license-2\.0", "apache"), ("apache-1.1", r"\bapache\.org/licenses/license-1\.1", "apache"), ("gpl", r"\bgnu\.org/(?:copyleft|licenses)/(?:old-licenses/)?gpl", "gnu.org"),
    ("lgpl", r"\bgnu\.org/(?:copyleft|licenses)/(?:old-licenses/)?lgpl", "gnu.org"), ("agpl", r"\bgnu\.org/licenses/agpl", "gnu.org"), ("gfdl", r"\bgnu\.org/(?:copyleft|licenses)/fdl", "gnu.org"), ("gpl", r"\bfsf\.org/licens", "fsf.org"),
    ("mpl", r"\bmozilla\.org/mpl", "mozilla.org"), ("epl", r"\beclipse\.org/legal/epl", "eclipse.org"), ("edl", r"\beclipse\.org/org/documents/edl", "eclipse.org"), ("bsl-1.0", r"\bboost\.org/license_1_0", "boost.org"), ("unlicense", r"\bunlicense\.org\b", "unlicense"), ("ofl", r"\bscripts\.sil\.org/ofl", "sil.org"), ("wtfpl", r"\bwtfpl\.net\b", "wtfpl"),
    ("odbl", r"\bopendatacommons\.org/licenses/odbl", "opendatacommons"), ("pddl", r"\bopendatacommons\.org/licenses/pddl", "opendatacommons"), ("ogl", r"\bnationalarchives\.gov\.uk/doc/open-government-licence", "nationalarchives"), ("eupl", r"\bec\.europa\.eu/.{0,60}eupl", "eupl"),
    ("gpl", r"\bgpl ?(?:v|version )?[123](?:\.0)?(?:\+| or later)?\b", "gpl"), ("lgpl", r"\blgpl ?(?:v|version )?[23](?:\.[01])?(?:\+| or later)?\b", "lgpl"), ("agpl", r"\bagpl ?(?:v|version )?3(?:\.0)?\b", "agpl"), ("mpl", r"\bmpl ?(?:v|version )?[12]\.[01]\b", "mpl"), ("epl", r"\bepl[ -](?:v|version )?[12]\.0\b", "epl"),
    ("mit", r"\bmit/x11\b", "mit/x11"), ("mit", r"\bexpat licen[cs]e\b", "expat"), ("apache-2.0", r"\balv2\b", "alv2"), ("apache-2.0", r"\basl ?2\.0\b", "asl"), ("gpl-2.0", r"\bgnu gpl ?v?2\b", "gnu gpl"), ("gpl-3.0", r"\bgnu gpl ?v?3\b", "gnu gpl"),
    ("dual", r"\b(?:dual|multi|tri)[ -]licen[cs]ed\b", "licen"), ("copyleft", r"\bcopyleft\b", "copyleft"), ("open-source", r"\bopen[ -]source (?:software )?licen[cs]e\b", "open"), ("license-file", r"\bsee (?:the )?(?:accompanying )?(?:file )?licen[cs]e(?:\.txt|\.md| file)?\b", "licen"), ("license-file", r"\blicense (?:that can be|can be|information can be) found in\b", "can be found"),
    ("proprietary", r"\ball rights reserved\b", "all rights reserved"), ("proprietary", r"\bproprietary and confidential\b", "proprietary and"), ("proprietary", r"\bconfidential and proprietary\b", "confidential and"), ("proprietary", r"\bmay not be (?:copied|reproduced|distributed|transmitted|republished)\b.{0,80}? without (?:the )?(?:express )?(?:prior )?(?:written )?(?:permission|consent)", "may not be"),
    ("proprietary", r"\bunauthori[sz]ed (?:copying|reproduction|use|distribution)\b.{0,60}? (?:is )?(?:strictly )?prohibited\b", "prohibited"), ("proprietary", r"\bno part of this (?:publication|book|work|document) may be reproduced\b", "no part of this"), ("proprietary", r"\bend[ -]user licen[cs]e agreement\b", "end"), ("proprietary", r"\btrade secrets? (?:of|belonging to)\b", "trade secret"),
    ("copyright", r"\bcopyright (?:©|\(c\)|\(copr\)) ?(?:19|20)\d\d\b", "copyright"), ("copyright", r"\bcopyright ?(?:19|20)\d\d\b", "copyright"), ("copyright", r"© ?(?:copyright ?)?(?:19|20)\d\d\b", "©"), ("copyright", r"\(c\) ?(?:copyright ?)?(?:19|20)\d\d\b", "(c)"), ("copyright", r"\bspdx-filecopyrighttext:", "spdx"),
]
