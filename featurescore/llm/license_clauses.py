"""More signatures of licenses, written by hand: single clauses of their texts, by license. See license_signatures.

Texts that quote a clause without its license's name or its first sentence are known by these.
"""

from __future__ import annotations

#: Clauses of license texts: (label, pattern, keyword).
CLAUSES = [
    # apache 2.0
    ("apache-2.0", r"[\"“']?legal entity[\"”']? shall mean the union of the acting entity and all other entities that control", "legal entity"),
    ("apache-2.0", r"derivative works shall not include works that remain separable from, or merely link", "remain separable"),
    ("apache-2.0", r"you must cause any modified files to carry prominent notices stating that you changed the files", "prominent notices"),
    ("apache-2.0", r"if the work includes a [\"“']notice[\"”'] text file as part of its distribution", "text file as part"),
    ("apache-2.0", r"unless you explicitly state otherwise, any contribution intentionally submitted for inclusion in the work", "intentionally submitted"),
    ("apache-2.0", r"you are solely responsible for determining the appropriateness of using or redistributing the work", "appropriateness of using"),
    ("apache-2.0", r"if you institute patent litigation against any entity \(including a cross-claim or counterclaim in a lawsuit\)", "institute patent litigation"),
    ("apache-2.0", r"this license does not grant permission to use the trade names, trademarks, service marks, or product names of the licensor", "trade names"),
    ("apache-1.1", r"the end-user documentation included with the redistribution, if any, must include the following acknowledge?ment", "end-user documentation"),
    ("apache-1.1", r"products derived from this software may not be called [\"“']?\w+[\"”']?,? nor may", "may not be called"),
    # gnu general public license, versions 1 to 3
    ("gpl-2.0", r"activities other than copying, distribution and modification are not covered by this license", "activities other than copying"),
    ("gpl-2.0", r"you must cause any work that you distribute or publish, that in whole or in part contains or is derived from the program", "distribute or publish"),
    ("gpl-2.0", r"accompany it with the complete corresponding machine-readable source code", "machine-readable source code"),
    ("gpl-2.0", r"accompany it with a written offer, valid for at least three years, to give any third party", "written offer"),
    ("gpl-2.0", r"mere aggregation of another work not based on the program with the program", "mere aggregation"),
    ("gpl-2.0", r"each time you redistribute the program \(or any work based on the program\), the recipient automatically receives a license", "each time you redistribute the program"),
    ("gpl-2.0", r"this general public license does not permit incorporating your program into proprietary programs", "incorporating your program"),
    ("gpl-3.0", r"to [\"“']propagate[\"”'] a work means to do anything with it that, without permission, would make you directly or secondarily liable", "secondarily liable"),
    ("gpl-3.0", r"no covered work shall be deemed part of an effective technological measure", "technological measure"),
    ("gpl-3.0", r"a [\"“']user product[\"”'] is either \(1\) a [\"“']consumer product[\"”']", "user product"),
    ("gpl-3.0", r"the [\"“']corresponding source[\"”'] for a work in object code form means all the source code needed to generate, install", "corresponding source"),
    ("gpl-3.0", r"your license from a particular copyright holder is reinstated \(a\) provisionally", "reinstated"),
    ("gpl-3.0", r"each contributor grants you a non-exclusive, worldwide, royalty-free patent license under the contributor's essential patent claims", "essential patent claims"),
    ("gpl-3.0", r"nothing in this license shall be construed as excluding or limiting any implied license or other defenses to infringement", "defenses to infringement"),
    ("gpl", r"freedom to distribute copies of free software \(and charge for (?:this service|them) if you wish\)", "freedom to distribute"),
    ("gpl", r"when we speak of free software, we are referring to freedom, not price", "freedom, not price"),
    ("gpl", r"if you develop a new program, and you want it to be of the greatest possible use to the public", "greatest possible use"),
    ("gpl", r"gnomovision version 69, copyright", "gnomovision"),
    ("gpl-1.0", r"gnu general public license as published by the free software foundation[;,] either version 1", "either version 1"),
    # lesser and affero
    ("lgpl-2.1", r"a [\"“']work that uses the library[\"”']", "work that uses the library"),
    ("lgpl-2.1", r"when a program is linked with a library, whether statically or using a shared library", "linked with a library"),
    ("lgpl-2.1", r"if such an object file uses only numerical parameters, data structure layouts and accessors", "data structure layouts"),
    ("lgpl-2.1", r"the modified work must itself be a software library", "itself be a software library"),
    ("lgpl-2.0", r"this license, the library general public license, applies to some specially designated free software foundation software", "specially designated"),
    ("lgpl-3.0", r"you may convey a covered work under sections 3 and 4 of this license without being bound by section 3 of the gnu gpl", "without being bound by section 3"),
    ("lgpl-3.0", r"a [\"“']combined work[\"”'] is a work produced by combining or linking an application with the library", "combined work"),
    ("agpl-3.0", r"the gnu affero general public license is designed specifically to ensure that, in such cases, the modified source code becomes available", "affero"),
    ("agpl-3.0", r"remote network interaction; use with the gnu general public license", "remote network interaction"),
    ("agpl", r"you should have received a copy of the gnu affero general public license", "affero general"),
    # exceptions
    ("autoconf-exception", r"if you distribute this file as part of a program that contains a configuration script generated by autoconf", "generated by autoconf"),
    ("bison-exception", r"you may create a larger work that contains part or all of the bison parser skeleton", "bison parser skeleton"),
    ("gcc-exception", r"this gcc runtime library exception [\"“'(]", "gcc runtime library"),
    ("font-exception", r"if you create a document which uses this font, and embed this font or unaltered portions of this font into the document", "embed this font"),
    ("llvm-exception", r"if, as a result of your compiling your source code, portions of this software are embedded into an object form", "embedded into an object form"),
    ("openssl-exception", r"permission to link (?:the code of )?(?:portions of )?this program with the openssl (?:project's )?library", "permission to link"),
    ("linux-syscall-note", r"this copyright does \*?not\*? cover user programs that use kernel services by normal system calls", "normal system calls"),
    # gnu free documentation license
    ("gfdl", r"the purpose of this license is to make a manual, textbook, or other functional and useful document [\"“']free[\"”']", "functional and useful document"),
    ("gfdl", r"a [\"“']secondary section[\"”'] is a named appendix or a front-matter section of the document", "secondary section"),
    ("gfdl", r"delete any section entitled [\"“']endorsements[\"”']", "endorsements"),
    # mozilla and its kin
    ("mpl-2.0", r"[\"“']?covered software[\"”']? means source code form to which the initial contributor has attached the notice", "covered software"),
    ("mpl-2.0", r"if it is not possible or desirable to put the notice in a particular file", "possible or desirable"),
    ("mpl-2.0", r"you may choose to distribute such executable form under the terms of this license, or sublicense it under different terms", "sublicense it under different terms"),
    ("mpl-2.0", r"all distribution of covered software in source code form, including any modifications that you create", "modifications that you create"),
    ("mpl-1.1", r"the original code is .{1,80}\. the initial developer of the original code is", "initial developer"),
    ("mpl-1.1", r"software distributed under the license is distributed on an [\"“']as is[\"”'] basis, without warranty of any kind, either express or implied\. see the license for the specific language governing rights and limitations", "governing rights and limitations"),
    ("mpl-1.1", r"alternatively, the contents of this file may be used under the terms of either the gnu general public license", "alternatively, the contents"),
    ("npl-1.1", r"the contents of this file are subject to the netscape public license", "netscape public"),
    ("cddl-1.0", r"[\"“']?covered software[\"”']? means \(a\) the original software, or \(b\) modifications", "the original software"),
    ("cddl-1.0", r"when distributing covered code, include this cddl header notice in each file", "cddl header"),
    ("cddl-1.0", r"you can obtain a copy of the license at usr/src/opensolaris\.license", "opensolaris"),
    ("spl-1.0", r"the contents of this file are subject to the sun public license", "sun public license"),
    ("cpal-1.0", r"the contents of this file are subject to the common public attribution license", "public attribution license"),
    ("ipl-1.0", r"the accompanying program is provided under the terms of this ibm public license", "ibm public license"),
    ("qpl-1.0", r"you may copy this q public license but you may not change it", "q public license"),
    ("apsl-2.0", r"this file contains original code and/or modifications of original code as defined in and that are subject to the apple public source license", "apple public source"),
    ("rpl-1.5", r"this software is licensed under the reciprocal public license", "reciprocal public license"),
    # eclipse
    ("epl-2.0", r"this source code may also be made available under the following secondary licenses when the conditions for such availability", "conditions for such availability"),
    ("epl-1.0", r"a contribution [\"“']originates[\"”'] from a contributor if it was added to the program by such contributor", "originates"),
    ("epl", r"commercial distributors of software may accept certain responsibilities with respect to end users, business partners", "commercial distributors"),
    ("edl-1.0", r"neither the name of the eclipse foundation, inc\. nor the names of its contributors", "eclipse foundation, inc"),
    # european, french, german and other national licenses
    ("eupl-1.2", r"this european union public licence \(the [\"“']eupl[\"”']\) applies to the work", "european union public"),
    ("eupl", r"the licensor hereby grants you a worldwide, royalty-free, non-exclusive, sublicensable licen[cs]e to do the following", "sublicensable"),
    ("cecill", r"this software is governed by the cecill(?:-[abc])? license under french law and abiding by the rules of distribution of free software", "cecill"),
    ("cecill", r"users are provided only with a limited warranty and the software's author, the holder of the economic rights", "economic rights"),
    ("licence-ouverte", r"licence ouverte ?/ ?open licence", "licence ouverte"),
    ("dl-de-by-2.0", r"datenlizenz deutschland ?[-–] ?namensnennung", "datenlizenz"),
    ("ogl-uk-3.0", r"you are encouraged to use and re-use the information that is available under this licence freely and flexibly", "freely and flexibly"),
    ("iodl-2.0", r"italian open data licen[cs]e", "italian open data"),
    ("mulan-psl-2.0", r"is licensed under mulan psl v2", "mulan psl"),
    # artistic and perl
    ("artistic-1.0", r"you may otherwise modify your copy of this package in any way, provided that you insert a prominent notice", "insert a prominent notice"),
    ("artistic-1.0", r"[\"“']?freely available[\"”']? means that no fee is charged for the item itself", "no fee is charged"),
    ("artistic-2.0", r"you may distribute your modified version as source \(either gratis or for a distributor fee", "distributor fee"),
    ("artistic-2.0", r"you are always permitted to make arrangements wholly outside of this license directly with the copyright holder", "arrangements wholly outside"),
    # bsd and its kin
    ("bsd-2-clause-patent", r"subject to the terms and conditions of this license, each copyright holder and contributor hereby grants to those receiving rights", "those receiving rights"),
    ("bsd-2-clause-views", r"the views and conclusions contained in the software and documentation are those of the authors and should not be interpreted", "views and conclusions"),
    ("bsd-4-clause-uc", r"this product includes software developed by the university of california, berkeley and its contributors", "university of california"),
    ("bsd-3-clause-no-nuclear", r"you acknowledge that this software is not designed,? licensed or intended for use in the design, construction, operation or maintenance of any nuclear facility", "nuclear facility"),
    ("bsd-3-clause", r"the names? of (?:the author|.{1,60}?) may not be used to endorse or promote products derived from this software without specific prior written permission", "may not be used to endorse"),
    ("bsd-source-code", r"redistributions of source code must retain the copyright notices as they appear in each source code file", "as they appear in each source"),
    ("bsd-protection", r"this license is intended to protect against the appropriation of bsd", "appropriation"),
    ("clear-bsd", r"\(subject to the limitations in the disclaimer below\) provided that the following conditions are met", "limitations in the disclaimer"),
    ("bsd-netbsd", r"this code is derived from software contributed to the netbsd foundation", "netbsd foundation"),
    ("tcl", r"the authors hereby grant permission to use, copy, modify, distribute, and license this software and its documentation for any purpose", "authors hereby grant permission"),
    ("intel", r"neither the name of the intel corporation nor the names of its contributors", "intel corporation"),
    # permissions in few words
    ("fsfap", r"copying and distribution of this file, with or without modification, are permitted in any medium without royalty", "any medium without royalty"),
    ("fsful", r"this configure script is free software; the free software foundation gives unlimited permission to copy, distribute and modify it", "unlimited permission to copy"),
    ("fsfullr", r"gives unlimited permission to copy and/or distribute it, with or without modifications, as long as this notice is preserved", "as long as this notice is preserved"),
    ("ntp", r"permission to use, copy, modify, and distribute this software and its documentation for any purpose with or without fee is hereby granted", "permission to use"),
    ("mit-cmu", r"the name of cmu(?: not)? be used in advertising or publicity pertaining to distribution", "name of cmu"),
    ("mit-feh", r"acknowledgement shall be made in the documentation and software packages that this software was used", "acknowledgement shall be made"),
    ("mit-advertising", r"acknowledge?ment(?:s)? of use of this software must be included in advertising", "must be included in advertising"),
    ("blueoak-1.0.0", r"each contributor licenses you to do everything with this software that would otherwise infringe that contributor's copyright", "each contributor licenses you"),
    ("blueoak-1.0.0", r"you must ensure that everyone who gets a copy of any part of this software from you, with or without changes, also gets the text of this license", "everyone who gets a copy"),
    ("afl", r"this academic free license \(the [\"“']license[\"”']\) applies to any original work of authorship", "original work of authorship"),
    ("osl", r"this open software license \(the [\"“']license[\"”']\) applies to any original work of authorship", "open software license"),
    ("fair", r"usage of the works is permitted provided that this instrument is retained with the works", "this instrument is retained"),
    ("imlib2", r"all copies of the software in source code form, including any later modifications or all other forms of distribution", "all copies of the software in source"),
    ("sleepycat", r"redistributions in any form must be accompanied by information on how to obtain complete source code for the .{0,20}software", "redistributions in any form"),
    ("ijg", r"this software is based in part on the work of the independent jpeg group", "independent jpeg group"),
    ("ftl", r"portions of this software are copyright .{0,60}the freetype project", "freetype project"),
    ("libtiff", r"permission to use, copy, modify, distribute, and sell this software and its documentation for any purpose is hereby granted without fee", "copy, modify, distribute, and sell"),
    ("icu", r"provided that the above copyright notice\(s\) and this permission notice appear in all copies of the software and that both", "copyright notice(s) and this"),
    ("unicode-dfs", r"permission is hereby granted, free of charge, to any person obtaining a copy of (?:the )?unicode data files", "unicode data files"),
    ("info-zip", r"info-zip retains the right to use the names", "info-zip"),
    ("bzip2", r"the origin of this software must not be misrepresented; you must not claim that you wrote the original software", "must not claim that you wrote"),
    ("nist", r"this software was developed (?:at|by employees of) the national institute of standards and technology", "institute of standards"),
    ("cern-ohl", r"cern open hardware licence", "cern open hardware"),
    ("tapr-ohl", r"tapr open hardware license", "tapr open hardware"),
    ("solderpad", r"solderpad hardware licen[cs]e", "solderpad"),
    # fonts, documents and data
    ("ofl-1.1", r"the goals of the open font license \(ofl\) are to stimulate worldwide development of collaborative font projects", "collaborative font projects"),
    ("ofl-1.1", r"the requirement for fonts to remain under this license does not apply to any document created using the fonts", "requirement for fonts"),
    ("ubuntu-font", r"this font software is licensed under the ubuntu font licen[cs]e", "ubuntu font"),
    ("lppl-1.3c", r"this work may be distributed and/or modified under the conditions of the latex project public license", "latex project public"),
    ("opl-1.0", r"this material may be distributed only subject to the terms and conditions set forth in the open publication license", "open publication license"),
    ("odbl-1.0", r"you must include a notice associated with the produced work reasonably calculated to make any person", "produced work"),
    ("odbl-1.0", r"contains information from .{1,80}which is made available here under the open database license", "contains information from"),
    ("cdla-permissive", r"community data license agreement ?[-–] ?permissive", "community data license"),
    ("cdla-sharing", r"community data license agreement ?[-–] ?sharing", "community data license"),
    ("c-uda-1.0", r"computational use of data agreement", "computational use of data"),
    ("cc-by", r"you are free to:? share ?[-—–]* ?copy and redistribute the material in any medium or format", "any medium or format"),
    ("cc-by-4.0", r"by exercising the licensed rights \(defined below\), you accept and agree to be bound by the terms and conditions of this creative commons", "exercising the licensed rights"),
    ("cc-by-3.0", r"the work \(as defined below\) is provided under the terms of this creative commons public license", "creative commons public license"),
    ("cc-by-sa", r"share ?alike ?[-—–] ?if you (?:alter|remix|transform)", "alike"),
    ("cc0-1.0", r"a commons of creative, cultural and scientific works \([\"“']commons[\"”']\) that the public can reliably", "creative, cultural and scientific"),
    # models, and licenses that keep rights back
    ("openrail-m", r"you agree not to use the model or derivatives of the model:? .{0,40}in any way that violates any applicable national", "derivatives of the model"),
    ("gemma", r"gemma is provided under and subject to the gemma terms of use", "gemma terms of use"),
    ("llama", r"built with (?:meta )?llama", "llama"),
    ("llama", r"is licensed under the llama .{0,12}community license, copyright", "community license, copyright"),
    ("bigscience-rail", r"bigscience (?:bloom )?rail", "bigscience"),
    ("sspl-1.0", r"service source code[\"”']? means the corresponding source for the program or the modified version, and the corresponding source for all programs", "service source code"),
    ("elastic-2.0", r"you may not move, change, disable, or circumvent the license key functionality in the software", "license key functionality"),
    ("bsl-business-1.1", r"the business source license \(this document, or the [\"“']license[\"”']\) is not an open source license", "not an open source license"),
    ("confluent-community", r"confluent community license", "confluent community"),
    ("redis-sal", r"redis source available license", "redis source available"),
    ("prosperity", r"the prosperity public license", "prosperity"),
    ("prosperity", r"this license allows you to use and share this software for noncommercial purposes for free", "share this software"),
    ("parity", r"contribute software you develop, operate, or analyze with this software", "contribute software you develop"),
    ("hippocratic", r"hippocratic license", "hippocratic"),
    ("anti-996", r"the individual or the legal entity must strictly comply with all applicable laws, regulations, rules and standards of the jurisdiction relating to labor", "relating to labor"),
    ("ms-lpl", r"the software is licensed [\"“']as-is\.[\"”'] you bear the risk of using it", "bear the risk of using it"),
    ("oracle-otn", r"oracle technology network license agreement", "oracle technology network"),
    ("nvidia", r"nvidia corporation and its licensors retain all intellectual property and proprietary rights", "nvidia corporation"),
    ("aladdin", r"aladdin (?:ghostscript )?free public license", "aladdin"),
    ("unrar", r"unrar sources may be used in any software to handle rar archives without limitations", "unrar sources"),
    ("proprietary", r"this software is the confidential and proprietary information of", "confidential and proprietary information"),
    ("proprietary", r"you shall not disclose such confidential information and shall use it only in accordance with the terms of the license agreement", "such confidential information"),
    ("proprietary", r"this software is licensed, not sold", "licensed, not sold"),
    ("proprietary", r"you may not reverse engineer, decompile,? or disassemble", "reverse engineer"),
    ("proprietary", r"for internal evaluation purposes only", "internal evaluation"),
    ("non-commercial", r"for (?:personal|private|academic)(?:,| and| or)? non-?commercial use only", "commercial use only"),
    ("non-commercial", r"free for (?:personal|academic|educational|non-?commercial) use\b", "free for"),
    ("research-only", r"for research purposes only", "research purposes only"),
]
