"""License scans: ordered signature rules over the words of a text.

All of it is DataFrame functions; no Python runs on the executors, nothing is
shuffled.  Texts without any of a few strings, one of which every rule needs,
are done once their words are counted.  The others are reduced to their words;
each gets its number in front ("0:the 1:gnu"), so that a match tells its own
place; a rule is tried only if its keyword is among the words.  Of all
detections sorted by place, one that lies within another of the same or a
higher priority is dropped.

Rules are of four kinds, in order of priority: identifiers after an SPDX tag,
sentences of the licenses' own texts and notices, notices that something is
under a license by name, and bare names; the base phrases come last, and their
labels always stay.  A sentence that names a license wins over the name in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import let, lower_ascii
from gridlark.llm.spans import scanned

# The word pattern, after A-Z are lower-cased, and the base phrases.
_BREAK = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
WORD = f"[^{_BREAK}]+"
#: The same before lower-casing.
_ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Every match of a rule, in lower case, has one of these strings within a word, or cc as a word.
NEEDLES = (
    "licen", "software", "gpl", "copyright", "commons", "distribut", "bsd", "permission", "warrant", "commercial", "rail", "unauthori", "reserved", "cddl", "domain", "wtfpl", "cc0",
    "attribution", "reproduc", "consent", "cecill", "mulan", "eupl", "proprietary", "charityware", "fuck", "advertis", "contributors", "modified", "remotely", "resale", "trade",
    "package", "gemma", "agreement", "polyform", "whatever", "royalty",
)

#: Any words, up to 10, within a sentence.
_SOME = r"(?:[^ ]+ ){0,10}"

#: What follows an SPDX tag, as words: identifiers of the SPDX list.
IDENTIFIERS = (
    ("0bsd", "0bsd"), ("afl", "afl 3 0"), ("agpl-3", "agpl 3 0"), ("apache-1.1", "apache 1 1"), ("apache-2", "apache 2 0"), ("artistic", "artistic 1 0"),
    ("artistic", "artistic 2 0"), ("beerware", "beerware"), ("blue-oak", "blueoak 1 0 0"), ("bsd-2", "bsd 2 clause"), ("bsd-3", "bsd 3 clause"), ("bsd-4", "bsd 4 clause"),
    ("boost", "bsl 1 0"), ("bsl", "busl 1 1"), ("cc-by-3", "cc by 3 0"), ("cc-by-4", "cc by 4 0"), ("cc-by-nc", "cc by nc 4 0"), ("cc-by-nc-nd", "cc by nc nd 4 0"),
    ("cc-by-nc-sa", "cc by nc sa 4 0"), ("cc-by-nd", "cc by nd 4 0"), ("cc-by-sa", "cc by sa 3 0"), ("cc-by-sa", "cc by sa 4 0"), ("cc0", "cc0 1 0"), ("cddl", "cddl 1 0"),
    ("cddl", "cddl 1 1"), ("cecill", "cecill 2 1"), ("cpl", "cpl 1 0"), ("ecl", "ecl 2 0"), ("epl-1", "epl 1 0"), ("epl-2", "epl 2 0"), ("eupl", "eupl 1 2"),
    ("gfdl", "gfdl 1 3"), ("gpl-1", "gpl 1 0"), ("gpl-2", "gpl 2 0"), ("gpl-3", "gpl 3 0"), ("hpnd", "hpnd"), ("isc", "isc"), ("json", "json"), ("lgpl-2", "lgpl 2 0"),
    ("lgpl-2.1", "lgpl 2 1"), ("lgpl-3", "lgpl 3 0"), ("mit", "mit"), ("mit-0", "mit 0"), ("mpl-1.1", "mpl 1 1"), ("mpl-2", "mpl 2 0"), ("ms-pl", "ms pl"),
    ("ms-rl", "ms rl"), ("mulan", "mulanpsl 2 0"), ("ncsa", "ncsa"), ("odbl", "odbl 1 0"), ("ofl", "ofl 1 1"), ("openssl", "openssl"), ("osl", "osl 3 0"), ("pddl", "pddl 1 0"),
    ("php", "php 3 01"), ("postgresql", "postgresql"), ("psf", "psf 2 0"), ("qpl", "qpl 1 0"), ("ruby", "ruby"), ("sspl", "sspl 1 0"), ("unicode", "unicode 3 0"),
    ("unlicense", "unlicense"), ("upl", "upl 1 0"), ("vim", "vim"), ("w3c", "w3c"), ("wtfpl", "wtfpl"), ("x11", "x11"), ("zlib", "zlib"), ("zpl", "zpl 2 1"),
)

#: label, keyword (a word that every match has), sentence as a pattern over words.
SENTENCES = (
    ("mit", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "portions", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "liable", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("mit", "noninfringement", r"the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("x11", "consortium", r"except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("isc", "hereby", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("hpnd", "hereby", r"permission to use copy modify(?: and)? distribute and sell this software and its documentation for any purpose is hereby granted without fee"),
    ("postgresql", "hereby", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("boost", "hereby", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("unicode", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy of(?: the)? unicode data files"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted(?: provided that)?"),
    ("bsd", "binary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", "source", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", "contributors", r"this software is provided by the (?:copyright holders|regents|authors?) and contributors as is"),
    ("bsd-3", "endorse", rf"neither the names? of {_SOME}nor the names of (?:its|their) contributors may be used to endorse or promote products"),
    ("bsd-4", "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("apache-2", "compliance", r"you may not use this file except in compliance with the license"),
    ("apache-2", "applicable", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2", "irrevocable", r"perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent|except)"),
    ("apache-2", "apache", r"licensed under the apache license version 2 0"),
    ("apache-1.1", "apache", r"this product includes software developed by the apache software foundation"),
    ("gpl", "redistribute", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-2", "either", r"as published by the free software foundation either version 2 of the license"),
    ("gpl-3", "either", r"as published by the free software foundation either version 3 of the license"),
    ("gpl", "received", r"you should have received a copy of the gnu general public license along with this"),
    ("gpl", "freedom", r"the licenses for most software(?: and other practical works)? are designed to take away your freedom to share and(?: to)? change"),
    ("gpl", "verbatim", r"everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("lgpl", "library", r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl", "lesser", r"you should have received a copy of the gnu lesser general public license"),
    ("agpl", "affero", r"you should have received a copy of the gnu affero general public license"),
    ("agpl", "remotely", r"all users interacting with it remotely through a computer network"),
    ("gfdl", "documentation", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("fsfap", "royalty", r"are permitted in any medium without royalty provided the copyright notice and this notice are preserved"),
    ("mpl-2", "mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("epl-1", "eclipse", r"are made available under the terms of the eclipse public license v1 0"),
    ("epl-2", "eclipse", r"are made available under the terms of the eclipse public license (?:v )?2 0"),
    ("cddl", "distribution", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("cc0", "waived", rf"to the extent possible under law {_SOME}(?:has|have) waived all copyright and related or neighboring rights"),
    ("cc-by", "attribution", r"this work is licensed under(?: a| the)? creative commons attribution(?: [1-4] [05])?(?: international)? licen[cs]e"),
    ("cc-by-sa", "alike", r"this work is licensed under(?: a| the)? creative commons attribution share alike"),
    ("cc", "share", r"you are free to share copy and redistribute the material in any medium or format"),
    ("cc-by", "credit", r"you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("cc-by-nc", "commercial", r"you may not use the material for commercial purposes"),
    ("cc-by-nd", "modified", r"you may not distribute the modified material"),
    ("cc-by-sa", "contributions", r"you must distribute your contributions under the same license as the original"),
    ("zlib", "alter", r"including commercial applications and to alter it and redistribute it freely"),
    ("zlib", "altered", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", "origin", r"the origin of this software must not be misrepresented"),
    ("wtfpl", "fuck", r"do what the fuck you want to public license"),
    ("wtfpl", "fuck", r"you just do what the fuck you want to"),
    ("artistic", "package", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic", "package", r"this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("perl", "perl", r"you can redistribute it and or modify it under the same terms as perl itself"),
    ("ofl", "font", r"this font software is licensed under the sil open font license version 1 1"),
    ("ofl", "font", r"may use the reserved font names? unless"),
    ("psf", "psf", r"psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("openssl", "openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", "cryptographic", r"this product includes cryptographic software written by eric young"),
    ("ncsa", "illinois", rf"developed by {_SOME}university of illinois {_SOME}permission is hereby granted"),
    ("ms-pl", "accept", r"if you use the software you accept this license if you do not accept the license do not use the software"),
    ("beerware", "whatever", r"as long as you retain this notice you can do whatever you want with this stuff"),
    ("json", "evil", r"the software shall be used for good not evil"),
    ("vim", "charityware", r"vim is charityware"),
    ("bsl", "licensor", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("sspl", "service", r"if you make the functionality of the program or a modified version available to third parties as a service"),
    ("elastic", "hosted", r"you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "sell", r"does not grant to you the right to sell the software"),
    ("proprietary", "rights", r"all rights reserved"),
    ("proprietary", "reproduced", r"no part of this (?:publication|book|document|work|site) may be reproduced"),
    ("proprietary", "written", r"may not be (?:copied|reproduced|distributed|republished)(?: or \w+)* without(?: the)?(?: express)? prior written (?:permission|consent)"),
    ("proprietary", "reproduction", r"reproduction in whole or in part without(?: written)? permission is (?:strictly )?prohibited"),
    ("proprietary", "proprietary", r"confidential and proprietary"),
    ("proprietary", "unauthorized", r"unauthorized (?:copying|reproduction|use|distribution) (?:of this file|is strictly prohibited|is prohibited)"),
    ("proprietary", "unauthorised", r"unauthorised (?:copying|reproduction|use|distribution) (?:of this file|is strictly prohibited|is prohibited)"),
    ("proprietary", "secret", r"contains trade secrets? (?:of|and)"),
    ("noncommercial", "commercial", r"for (?:personal(?: and)? )?non commercial use only"),
    ("noncommercial", "resale", r"not for resale"),
    ("disclaimer", "warranty", r"without warranty of any kind express or implied"),
    ("disclaimer", "warranty", r"without any warranty without even the implied warranty of merchantability"),
    ("crown", "crown", r"crown copyright"),
)

#: label, keyword, name as a pattern over words; a notice before a name and a later version after it belong to the match.
NAMES = (
    ("gpl-1", "gpl", r"(?:gnu )?gpl (?:version )?v?1(?: 0)?"),
    ("gpl-2", "gpl", r"(?:gnu )?gpl (?:version )?v?2(?: 0)?"),
    ("gpl-3", "gpl", r"(?:gnu )?gpl (?:version )?v?3(?: 0)?"),
    ("gpl-2", "general", r"(?:gnu )?general public licen[cs]e (?:version |v)?2(?: 0)?"),
    ("gpl-3", "general", r"(?:gnu )?general public licen[cs]e (?:version |v)?3(?: 0)?"),
    ("gpl", "gpl", r"(?:gnu )?gpl"),
    ("gpl-2", "gplv2", r"(?:gnu )?gplv2"),
    ("gpl-3", "gplv3", r"(?:gnu )?gplv3"),
    ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl (?:version )?v?2(?: 1)?"),
    ("lgpl-3", "lgpl", r"(?:gnu )?lgpl (?:version )?v?3(?: 0)?"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public licen[cs]e"),
    ("lgpl", "library", r"(?:gnu )?library general public licen[cs]e"),
    ("agpl-3", "agpl", r"(?:gnu )?agpl (?:version )?v?3(?: 0)?"),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[cs]e"),
    ("gfdl", "documentation", r"(?:gnu )?free documentation licen[cs]e"),
    ("apache-2", "apache", r"apache (?:software )?licen[cs]e (?:version |v)?2(?: 0)?"),
    ("apache-1.1", "apache", r"apache (?:software )?licen[cs]e (?:version |v)?1 1"),
    ("apache", "apache", r"apache software licen[cs]e"),
    ("mit", "mit", r"mit (?:x11 )?licen[cs]e"),
    ("mit", "expat", r"expat licen[cs]e"),
    ("mit-0", "mit", r"mit no attribution(?: licen[cs]e)?"),
    ("x11", "x11", r"x11 licen[cs]e"),
    ("bsd-2", "bsd", r"(?:2|two) clause bsd(?: licen[cs]e)?"),
    ("bsd-3", "bsd", r"(?:3|three) clause bsd(?: licen[cs]e)?"),
    ("bsd-4", "bsd", r"(?:4|four) clause bsd(?: licen[cs]e)?"),
    ("bsd-2", "simplified", r"simplified bsd(?: licen[cs]e)?"),
    ("bsd-3", "bsd", r"(?:new|modified|revised) bsd licen[cs]e"),
    ("bsd", "bsd", r"bsd licen[cs]e"),
    ("isc", "isc", r"isc licen[cs]e"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[cs]e (?:version |v)?1 1"),
    ("mpl-2", "mozilla", r"mozilla public licen[cs]e (?:version |v)?2(?: 0)?"),
    ("mpl", "mozilla", r"mozilla public licen[cs]e"),
    ("epl-1", "eclipse", r"eclipse public licen[cs]e (?:version |v)?1(?: 0)?"),
    ("epl-2", "eclipse", r"eclipse public licen[cs]e (?:version |v)?2(?: 0)?"),
    ("epl", "eclipse", r"eclipse public licen[cs]e"),
    ("eupl", "european", r"european union public licen[cs]e"),
    ("eupl", "eupl", r"eupl(?: v?1 [12])?"),
    ("cddl", "cddl", r"cddl(?: (?:version )?1(?: [01])?)?"),
    ("cddl", "distribution", r"common development and distribution licen[cs]e"),
    ("cc-by-4", "cc", r"cc by (?:version )?4(?: 0)?"),
    ("cc-by-3", "cc", r"cc by (?:version )?3(?: 0)?"),
    ("cc-by-sa", "cc", r"cc by sa(?: [1-4](?: [05])?)?"),
    ("cc-by-nd", "cc", r"cc by nd(?: [1-4](?: [05])?)?"),
    ("cc-by-nc", "cc", r"cc by nc(?: [1-4](?: [05])?)?"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa(?: [1-4](?: [05])?)?"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd(?: [1-4](?: [05])?)?"),
    ("cc0", "cc0", r"cc0(?: 1(?: 0)?)?(?: universal)?"),
    ("cc-by", "creative", r"creative commons attribution(?: [1-4](?: [05])?)?(?: international)?(?: licen[cs]e)?"),
    ("cc-by-sa", "creative", r"creative commons attribution share ?alike(?: [1-4](?: [05])?)?"),
    ("cc-by-nc", "creative", r"creative commons attribution non ?commercial(?: [1-4](?: [05])?)?"),
    ("cc-by-nd", "creative", r"creative commons attribution no ?derivatives(?: [1-4](?: [05])?)?"),
    ("cc0", "creative", r"creative commons zero"),
    ("public-domain", "domain", r"public domain"),
    ("unlicense", "unlicense", r"unlicense"),
    ("artistic", "artistic", r"artistic licen[cs]e(?: [12](?: 0)?)?"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e"),
    ("boost", "boost", r"boost software licen[cs]e(?: (?:version )?1(?: 0)?)?"),
    ("bsl", "business", r"business source licen[cs]e(?: 1 1)?"),
    ("sspl", "server", r"server side public licen[cs]e"),
    ("elastic", "elastic", r"elastic licen[cs]e(?: (?:version |v)?2(?: 0)?)?"),
    ("commons-clause", "clause", r"commons clause(?: licen[cs]e condition)?"),
    ("polyform", "polyform", r"polyform (?:noncommercial|shield|perimeter|small business|strict|internal use)"),
    ("wtfpl", "wtfpl", r"wtfpl(?: (?:version )?2)?"),
    ("ofl", "font", r"(?:sil )?open font licen[cs]e(?: 1 1)?"),
    ("odbl", "database", r"open database licen[cs]e"),
    ("odc-by", "commons", r"open data commons attribution licen[cs]e"),
    ("pddl", "dedication", r"public domain dedication and licen[cs]e"),
    ("cdla", "community", r"community data licen[cs]e agreement(?: (?:permissive|sharing))?"),
    ("psf", "python", r"python software foundation licen[cs]e"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e"),
    ("php", "php", r"php licen[cs]e"),
    ("ruby", "ruby", r"ruby licen[cs]e"),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e"),
    ("openssl", "openssl", r"openssl licen[cs]e"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)? licen[cs]e"),
    ("w3c", "w3c", r"w3c(?: software)?(?: notice and)?(?: document)? licen[cs]e"),
    ("cecill", "cecill", r"cecill(?: (?:b|c|2 1))?"),
    ("mulan", "mulan", r"mulan (?:psl|permissive software licen[cs]e)"),
    ("osl", "open", r"open software licen[cs]e(?: 3 0)?"),
    ("afl", "academic", r"academic free licen[cs]e"),
    ("ecl", "educational", r"educational community licen[cs]e"),
    ("cpl", "common", r"common public licen[cs]e"),
    ("cpal", "common", r"common public attribution licen[cs]e"),
    ("qpl", "q", r"q public licen[cs]e"),
    ("npl", "netscape", r"netscape public licen[cs]e"),
    ("apsl", "apple", r"apple public source licen[cs]e"),
    ("zpl", "zope", r"zope public licen[cs]e"),
    ("rpl", "reciprocal", r"reciprocal public licen[cs]e"),
    ("sleepycat", "sleepycat", r"sleepycat licen[cs]e"),
    ("unicode", "unicode", r"unicode(?: inc)? licen[cs]e"),
    ("upl", "universal", r"universal permissive licen[cs]e"),
    ("blue-oak", "oak", r"blue oak model licen[cs]e"),
    ("free-art", "art", r"free art licen[cs]e"),
    ("hippocratic", "hippocratic", r"hippocratic licen[cs]e"),
    ("nasa", "nasa", r"nasa open source agreement"),
    ("ogl", "government", r"open government licen[cs]e"),
    ("etalab", "licence", r"licence ouverte"),
    ("opl", "publication", r"open publication licen[cs]e"),
    ("ntp", "ntp", r"ntp licen[cs]e"),
    ("llama", "llama", r"llama(?: [23](?: [1-3])?)? community licen[cs]e"),
    ("openrail", "openrail", r"(?:bigscience |creativeml )?openrail(?: (?:m|d|s))*"),
    ("openrail", "rail", r"(?:open|bigscience) rail(?: (?:m|licen[cs]e))?"),
    ("gemma", "gemma", r"gemma (?:terms of use|licen[cs]e)"),
)
_NOTICE = r"(?:licen[cs]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?"
_LATER = r"(?: only| or (?:any )?later(?: version)?)?"
_TOP = 5


_DETECTIONS = "array<struct<start:int,minus_end:int,minus_priority:int,label:string>>"


def rules() -> list[tuple[int, str, str, str]]:
    """(priority, keyword, pattern over words, label), the base phrases last."""
    found = [(5, "spdx", rf"spdx licen[cs]e identifier {tag}(?: (?:only|or later))?", label) for label, tag in IDENTIFIERS]
    found += [(4, keyword, sentence, label) for label, keyword, sentence in SENTENCES]
    for label, keyword, name in NAMES:
        found += [(3, keyword, rf"{_NOTICE}{name}{_LATER}", label), (2, keyword, name, label)]
    return [*found, *((1, phrase.split(" ")[0], phrase, label) for phrase, label in BASE)]


def numbered(pattern: str) -> str:
    """pattern, over words with one space between, for words that have their numbers in front; a space may be optional."""
    words = r"(?: \d+:)?".join(part.replace(" ", r" \d+:") for part in pattern.split(" ?"))
    return rf"((?<![^ ])\d+:{words}(?![^ ]))"


def _starts_and_ends(hits: Column, priority: Column, label: Column) -> Column:
    def one(hit: Column) -> Column:
        start = F.substring_index(hit, ":", 1).cast("int")
        n = F.size(F.split(hit, " "))
        return F.struct(start.alias("start"), (-(start + n)).alias("minus_end"), (-priority).alias("minus_priority"), label.alias("label"))

    return F.transform(hits, one)


def detections(text: Column) -> Column:
    """(base, found): arrays of (start, minus_end, minus_priority, label); text is not null."""
    by_keyword: dict[str, list[tuple[int, str, str]]] = {}
    for priority, keyword, pattern, label in rules():
        if priority > 1:
            by_keyword.setdefault(keyword, []).append((priority, pattern, label))

    def of(words: Column) -> Column:
        plain = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
        numbers = F.array_join(F.transform(words, lambda w, i: F.concat(i.cast("string"), F.lit(":"), w)), " ")
        return let(F.struct(plain.alias("plain"), numbers.alias("numbers")), both)

    def hits(numbers: Column, priority: int, pattern: str, label: str) -> Column:
        return _starts_and_ends(F.regexp_extract_all(numbers, F.lit(numbered(pattern)), F.lit(1)), F.lit(priority), F.lit(label))

    def both(of: Column) -> Column:
        base = [hits(of["numbers"], 1, p, label) for p, label in BASE]
        # Each pattern is a constant of its own expression, so it is compiled once.
        tried = [F.when(F.contains(of["plain"], F.lit(f" {k} ")), F.concat(*(hits(of["numbers"], *r) for r in group))) for k, group in by_keyword.items()]
        more = F.flatten(F.filter(F.array(*tried), lambda x: x.isNotNull()))
        return F.struct(F.concat(*base).alias("base"), more.alias("found"))

    low = F.lower(text)  # differs from the contract's lower case in letters that no needle has
    some = F.contains(low, F.lit("cc")) & low.rlike(rf"(?:^|[{_BREAK}])cc(?:[{_BREAK}]|$)")
    for needle in NEEDLES:
        some = some | F.contains(low, F.lit(needle))
    return F.when(some, let(F.regexp_extract_all(lower_ascii(text), F.lit(f"({WORD})"), F.lit(1)), of))


def resolved(found: Column) -> Column:
    """found, sorted, without what lies within one of the same or a higher priority.

    Read in order of start and falling end, a detection lies within an earlier
    one exactly if the greatest end so far, among those of its priority or a
    higher one, reaches its own.
    """
    zero = F.array(*[F.lit(-1)] * _TOP)
    step = lambda ends, d: F.transform(ends, lambda e, k: F.when(k < -d["minus_priority"], F.greatest(e, -d["minus_end"])).otherwise(e))
    merge = lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x, y))
    none = F.filter(found, lambda d: F.lit(False))
    emit = lambda ends, d: F.when(F.get(ends, -d["minus_priority"] - 1) >= -d["minus_end"], F.array().cast(_DETECTIONS)).otherwise(F.array(d))
    return scanned(F.array_sort(found), zero, step, merge, emit, none)


def license_scan(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, base, licenses (arrays of start, end, priority, label; places in words).

    A null or empty text has no words and nothing found.  A very long one is
    read whole, in time linear in its words and detections.  Columns of df with
    these names are replaced; no row is lost, repeated rows each have their own;
    an empty df gives an empty result.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    shown = lambda d: F.struct(d["start"], (-d["minus_end"]).alias("end"), (-d["minus_priority"]).alias("priority"), d["label"])
    none = F.array().cast("array<struct<start:int,end:int,priority:int,label:string>>")
    found = df.withColumn("_found", detections(whole))
    return found.withColumns(
        {
            "n_words": F.regexp_count(whole, F.lit(_ANY_CASE_WORD)).cast("long"),
            "base": F.coalesce(F.transform(F.array_sort("_found.base"), shown), none),
            "licenses": F.coalesce(let(F.concat("_found.base", "_found.found"), lambda all_: F.transform(resolved(all_), shown)), none),
        }
    ).drop("_found")
