"""Signature phrases of the licence scan: sentences of licence texts, grants and bare names, written one by one.

Each is (label, keyword, phrase). A space of a phrase stands for whatever may separate two words (``G`` of
``license_rules``: white space, punctuation, comment marks at the start of a line), so phrases hold no punctuation
between words. The keyword is a word that every match holds.
"""
from __future__ import annotations

#: Sentences of the licences' own texts: the licence itself stands there, not only its name.
TEXTS: list[tuple[str, str, str]] = [
    ("mit", "sublicense", r"use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "portions", r"the above copyright notice and this permission notice (?:\(including the next paragraph\) )?shall be included in all copies or substantial portions of the software"),
    ("mit", "noninfringement", r"warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable"),
    ("x11", "advertising", r"except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("apache-2.0", "except", r"you may not use this file except in compliance with the license you may obtain a copy of the license at https? www apache org licenses license 2 0"),
    ("apache-2.0", "irrevocable", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:\(except as stated in this section\) )?(?:copyright|patent) license"),
    ("apache-2.0", "attribution", r"you must retain in the source form of any derivative works that you distribute all copyright patent trademark and attribution notices"),
    ("apache-2.0", "contributory", r"constitutes direct or contributory patent infringement then any patent licenses granted to you under this license"),
    ("apache-1.1", "developed", r"this product includes software developed by the apache software foundation"),
    ("apache-1.1", "endorse", r"the names apache and apache software foundation must not be used to endorse or promote products"),
    ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "neither", r"neither the names? of .{1,80}? (?:nor|and) the names of its contributors may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-2-clause", "freebsd", r"should not be interpreted as representing official policies either expressed or implied of the freebsd project"),
    ("0bsd", "permission", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("isc", "appear", r"with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("hpnd", "supporting", r"both that copyright notice and this permission notice appear in supporting documentation"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
    ("zlib", "altered", r"altered source versions must be plainly marked as such"),
    ("libpng-2.0", "png", r"the png reference library is supplied as is"),
    ("bsl-1.0", "accompanying", r"obtaining a copy of the software and accompanying documentation covered by this license"),
    ("unlicense", "compile", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("unlicense", "detriment", r"we make this dedication for the benefit of the public at large and to the detriment of our heirs"),
    ("wtfpl", "fuck", r"you just do what the fuck you want to"),
    ("beerware", "beer", r"(?:you can buy me|buy me) a beer in return"),
    ("gpl-2.0", "redistribute", r"redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation (?:either )?version 2"),
    ("gpl-3.0", "redistribute", r"redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation (?:either )?version 3"),
    ("lgpl-2.0", "library", r"under the terms of the gnu library general public license as published by the free software foundation (?:either )?version 2"),
    ("lgpl-2.1", "redistribute", r"redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation (?:either )?version 2 1"),
    ("lgpl-3.0", "redistribute", r"redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation (?:either )?version 3"),
    ("agpl-3.0", "redistribute", r"redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation (?:either )?version 3"),
    ("agpl-3.0", "remotely", r"prominently offer all users interacting with it remotely through a computer network"),
    ("gpl", "copyleft", r"the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl", "freedom", r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl", "merchantability", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu (?:lesser |library |affero )?general public license"),
    ("lgpl", "library", r"a program that contains no derivative of any portion of the library but is designed to work with the library"),
    ("gfdl", "invariant", r"with no invariant sections (?:with )?no front cover texts and (?:with )?no back cover texts"),
    ("gfdl", "permission", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2.0", "subject", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "incompatible", r"this source code form is incompatible with secondary licenses"),
    ("mpl-1.1", "subject", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1.0", "subject", r"the contents of this file are subject to the mozilla public license version 1 0"),
    ("epl-2.0", "eclipse", r"made available under the terms of the eclipse public license v? ?2 0"),
    ("epl-1.0", "eclipse", r"made available under the terms of the eclipse public license v? ?1 0"),
    ("cddl-1.0", "subject", r"subject to the terms of the common development and distribution license"),
    ("eupl-1.2", "eupl", r"licensed under the eupl version 1 2"),
    ("cecill-2.1", "cecill", r"governed by the cecill license under french law"),
    ("artistic-2.0", "permitted", r"you are permitted to use the standard version and create and use modified versions for any purpose without restriction provided that you do not distribute the modified version"),
    ("artistic-1.0", "semblance", r"the copyright holder maintains some semblance of artistic control over the development of the package"),
    ("perl", "perl", r"(?:under the same terms as perl itself|same terms as the perl 5 programming language system itself)"),
    ("python-2.0", "psf", r"psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("ruby", "ruby", r"you may redistribute it and or modify it under the same terms as ruby"),
    ("vim", "vim", r"there are no restrictions on distributing unmodified copies of vim"),
    ("openssl", "openssl", r"this product includes software developed by the openssl project"),
    ("ssleay", "eric", r"this product includes cryptographic software written by eric young"),
    ("postgresql", "california", r"in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages"),
    ("ncsa", "disclaimers", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers"),
    ("curl", "holder", r"except as contained in this notice the name of a copyright holder shall not be used in advertising or otherwise"),
    ("icu", "unicode", r"permission is hereby granted free of charge to any person obtaining a copy of the unicode data files"),
    ("ofl-1.1", "font", r"the fonts and derivatives however cannot be released under any other type of license"),
    ("ofl-1.1", "font", r"this font software is licensed under the sil open font license"),
    ("busl-1.1", "licensor", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("sspl-1.0", "service", r"if you make the functionality of the program or a modified version available to third parties as a service"),
    ("elastic-2.0", "managed", r"you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "grant", r"the license does not grant to you the right to sell the software"),
    ("polyform-noncommercial", "polyform", r"polyform noncommercial license"),
    ("cc0-1.0", "waives", r"affirmer hereby overtly fully permanently irrevocably and unconditionally waives"),
    ("cc0-1.0", "waived", r"to the extent possible under law .{1,120}? has waived all copyright and related or neighboring rights"),
    ("cc", "exercising", r"by exercising the licensed rights .{0,20}? you accept and agree to be bound by the terms and conditions of this creative commons"),
    ("cc", "human", r"this is a human readable summary of .{0,40}? license"),
    ("odbl-1.0", "database", r"this .{1,60}? is made available under the open database license"),
    ("ogl-uk-3.0", "sector", r"contains public sector information licensed under the open government licence v3 0"),
    ("llama-2", "llama", r"llama 2 is licensed under the llama 2 community license"),
    ("llama-3", "llama", r"(?:built with meta llama 3|meta llama 3 community license agreement)"),
    ("openrail", "restrictions", r"use based restrictions as referenced in paragraph 5"),
    ("json", "evil", r"the software shall be used for good not evil"),
    ("bsd", "regents", r"the regents of the university of california all rights reserved"),
    ("ms-pl", "governs", r"this license governs use of the accompanying software if you use the software you accept this license"),
    ("afl-3.0", "academic", r"licensed under the academic free license version 3 0"),
    ("osl-3.0", "open", r"licensed under the open software license version 3 0"),
    ("upl-1.0", "universal", r"the universal permissive license"),
    ("mulan-psl-2.0", "mulan", r"licensed under mulan psl v2"),
    ("blueoak-1.0.0", "blue", r"blue oak model license 1 0 0"),
    ("imagemagick", "imagemagick", r"licensed under the imagemagick license"),
    ("sleepycat", "accompanied", r"redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("proprietary", "reproduced", r"no part of this (?:publication|book|work|document|website) may be reproduced (?:stored|distributed|or transmitted)"),
    ("proprietary", "rights", r"unpublished rights reserved under the copyright laws"),
]

#: Grants by a short name without "license".
GRANTS: list[tuple[str, str, str]] = [
    ("mit", "mit", r"mit"), ("isc", "isc", r"isc"), ("bsd", "bsd", r"(?:the |a )?bsd"), ("gpl", "gpl", r"gpl"), ("lgpl", "lgpl", r"lgpl"),
    ("agpl-3.0", "agpl", r"agpl"), ("apache", "apache", r"apache"), ("apache-2.0", "apache", r"apache (?:v|version )?2(?: 0)?"), ("mpl", "mpl", r"mpl"),
    ("epl", "epl", r"epl"), ("zlib", "zlib", r"zlib"), ("unlicense", "unlicense", r"unlicense"), ("cc", "creative", r"(?:a )?creative commons"),
    ("cc0-1.0", "cc0", r"cc0"), ("ofl-1.1", "ofl", r"(?:sil )?ofl"), ("eupl", "eupl", r"eupl"),
    ("cecill", "cecill", r"cecill(?: [bc])?"), ("wtfpl", "wtfpl", r"wtfpl"), ("proprietary", "proprietary", r"proprietary licen[cs]e"), ("proprietary", "commercial", r"commercial licen[cs]e"),
]

#: Names that are a licence wherever they stand, without "license" behind them.
MENTIONS: list[tuple[str, str, str]] = [
    ("apache-2.0", "apache", r"apache 2 0"), ("apache-2.0", "apache", r"apache license 2 0"), ("apache-2.0", "alv2", r"alv2"),
    ("bsd-2-clause", "bsd", r"bsd 2 clause"), ("bsd-3-clause", "bsd", r"bsd 3 clause"), ("bsd-4-clause", "bsd", r"bsd 4 clause"), ("0bsd", "0bsd", r"0bsd"),
    ("gpl-2.0", "gpl", r"gpl v? ?2 0"), ("gpl-3.0", "gpl", r"gpl v? ?3 0"), ("gpl-2.0", "gplv2", r"gplv2\+?"), ("gpl-3.0", "gplv3", r"gplv3\+?"),
    ("lgpl-2.1", "lgpl", r"lgpl v? ?2 1"), ("lgpl-3.0", "lgpl", r"lgpl v? ?3 0"), ("lgpl-2.1", "lgplv2", r"lgplv2 1"), ("lgpl-3.0", "lgplv3", r"lgplv3"),
    ("agpl-3.0", "agpl", r"agpl v? ?3 0"), ("agpl-3.0", "agplv3", r"agplv3"), ("lgpl", "lgpl", r"lgpl"), ("agpl", "agpl", r"agpl"),
    ("gpl", "gpl", r"gpl"), ("mpl-2.0", "mpl", r"mpl v? ?2 0"), ("mpl-1.1", "mpl", r"mpl v? ?1 1"), ("epl-2.0", "epl", r"epl v? ?2 0"), ("epl-1.0", "epl", r"epl v? ?1 0"),
    ("eupl-1.2", "eupl", r"eupl v? ?1 2"), ("cddl-1.0", "cddl", r"cddl v? ?1 0"), ("bsl-1.0", "bsl", r"bsl 1 0"), ("busl-1.1", "busl", r"busl 1 1"),
    ("sspl-1.0", "sspl", r"sspl(?: v? ?1 0)?"), ("ms-pl", "ms-pl", r"ms-pl"), ("ms-rl", "ms-rl", r"ms-rl"), ("mit-0", "mit-0", r"mit-0"), ("afl-3.0", "afl", r"afl 3 0"),
    ("osl-3.0", "osl", r"osl 3 0"), ("upl-1.0", "upl", r"upl 1 0"), ("ofl-1.1", "ofl", r"(?:sil )?ofl v? ?1 1"), ("odbl-1.0", "odbl", r"odbl(?: v? ?1 0)?"),
    ("pddl-1.0", "pddl", r"pddl(?: v? ?1 0)?"), ("cecill-2.1", "cecill", r"cecill v? ?2 1"), ("mulan-psl-2.0", "mulanpsl", r"mulanpsl 2 0"), ("psf-2.0", "psf", r"psf license"),
    ("artistic-2.0", "artistic", r"artistic 2 0"), ("gfdl", "gfdl", r"gfdl"), ("wtfpl", "wtfpl", r"wtfpl"), ("cc0-1.0", "cc0", r"cc0 v? ?1 0"), ("openrail", "openrail", r"openrail"),
    ("llama-2", "llama", r"llama 2 community license"), ("gemma", "gemma", r"gemma terms of use"), ("polyform-noncommercial", "polyform", r"polyform noncommercial"),
]
