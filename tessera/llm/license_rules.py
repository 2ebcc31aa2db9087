"""The signature rules of the license scan, as tables from which ``rules`` builds them.

Patterns run over a text's words, lower-cased and joined by single spaces, so that
punctuation, line breaks and comment marks never matter.  ``~`` stands for up to three words.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    """A pattern tried where ``keyword`` is among a text's words; the smaller priority wins."""

    priority: int
    label: str
    keyword: str
    pattern: str
    base: bool = False


#: Priorities: tags, addresses and whole notices; grants; names; families and hints.
TAG, GRANT, NAME, HINT = range(4)
#: How sure a kept detection of each priority is.
CONFIDENCE = (0.95, 0.9, 0.7, 0.4)

#: Phrases whose every place counts, whatever else is found there.
BASE = [("cc by", "cc-by", "cc"), ("general public license", "gpl", "general"), ("all rights reserved", "reserved", "reserved")]

_LICENSE = "licen[cs]e"
_V = "(?: version| v)?"
#: Label, keyword, identifier in tags, name in prose.
NAMES = [
    ("mit", "mit", "mit", f"mit {_LICENSE}"),
    ("mit-0", "mit", "mit 0", f"mit(?: 0| no attribution)(?: {_LICENSE})?"),
    ("x11", "x11", "x11", f"x11 {_LICENSE}"),
    ("isc", "isc", "isc", f"isc {_LICENSE}"),
    ("bsd-2-clause", "bsd", "bsd 2 clause", f"(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)(?: {_LICENSE})?"),
    ("bsd-3-clause", "bsd", "bsd 3 clause", f"(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: {_LICENSE})?"),
    ("bsd-4-clause", "bsd", "bsd 4 clause", f"(?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd)(?: {_LICENSE})?"),
    ("0bsd", "0bsd", "0bsd", f"(?:0bsd|zero clause bsd)(?: {_LICENSE})?"),
    ("apache-1.1", "apache", "apache 1 1", f"apache(?: software)?(?: {_LICENSE})?{_V} 1 1"),
    ("apache-2.0", "apache", "apache 2 0", f"apache(?: software)?(?: {_LICENSE})?{_V} 2(?: 0)?"),
    ("gpl-1.0", "gnu", "gpl 1 0(?: only| or later)?", f"gnu(?: gpl| general public {_LICENSE}){_V} 1(?: 0)?"),
    ("gpl-2.0", "gnu", "gpl 2 0(?: only| or later)?", f"gnu(?: gpl| general public {_LICENSE}){_V} 2(?: 0)?"),
    ("gpl-3.0", "gnu", "gpl 3 0(?: only| or later)?", f"gnu(?: gpl| general public {_LICENSE}){_V} 3(?: 0)?"),
    ("gpl-2.0", "gpl", "gpl 2(?: only| or later)?", f"gpl ?v?(?:ersion )?2(?: 0)?"),
    ("gpl-3.0", "gpl", "gpl 3(?: only| or later)?", f"gpl ?v?(?:ersion )?3(?: 0)?"),
    ("gpl-2.0", "gplv2", "gplv2", "gplv2"),
    ("gpl-3.0", "gplv3", "gplv3", "gplv3"),
    ("lgpl-2.0", "library", "lgpl 2 0(?: only| or later)?", f"(?:gnu )?library general public {_LICENSE}{_V} 2(?: 0)?"),
    ("lgpl-2.1", "lesser", "lgpl 2 1(?: only| or later)?", f"(?:gnu )?lesser general public {_LICENSE}{_V} 2 1"),
    ("lgpl-3.0", "lesser", "lgpl 3 0(?: only| or later)?", f"(?:gnu )?lesser general public {_LICENSE}{_V} 3(?: 0)?"),
    ("lgpl-2.1", "lgpl", "lgpl 2 1", "lgpl ?v?2 1"),
    ("lgpl-3.0", "lgpl", "lgpl 3", "lgpl ?v?3(?: 0)?"),
    ("agpl-3.0", "affero", "agpl 3 0(?: only| or later)?", f"(?:gnu )?affero general public {_LICENSE}(?:{_V} 3(?: 0)?)?"),
    ("agpl-3.0", "agpl", "agpl 3", "agpl ?v?3(?: 0)?"),
    ("gfdl-1.3", "documentation", "gfdl 1 3(?: only| or later)?", f"(?:gnu )?free documentation {_LICENSE}{_V} 1 3"),
    ("gfdl", "documentation", "gfdl(?: 1 [12])?", f"(?:gnu )?free documentation {_LICENSE}"),
    ("mpl-1.1", "mozilla", "mpl 1 1", f"mozilla public {_LICENSE}{_V} 1 1"),
    ("mpl-2.0", "mozilla", "mpl 2 0", f"mozilla public {_LICENSE}{_V} 2(?: 0)?"),
    ("mpl-2.0", "mpl", "mpl 2", "mpl ?v?2(?: 0)?"),
    ("epl-1.0", "eclipse", "epl 1 0", f"eclipse public {_LICENSE}{_V} 1(?: 0)?"),
    ("epl-2.0", "eclipse", "epl 2 0", f"eclipse public {_LICENSE}{_V} 2(?: 0)?"),
    ("edl-1.0", "eclipse", "edl 1 0", f"eclipse distribution {_LICENSE}{_V} 1(?: 0)?"),
    ("cddl-1.0", "cddl", "cddl 1 0", f"(?:common development and distribution {_LICENSE} )?cddl(?:{_V} 1(?: 0)?)?"),
    ("cpl-1.0", "common", "cpl 1 0", f"common public {_LICENSE}(?:{_V} 1(?: 0)?)?"),
    ("eupl-1.2", "european", "eupl 1 2", f"european union public {_LICENSE}(?:{_V} 1 2)?"),
    ("artistic-1.0", "artistic", "artistic 1 0", f"artistic {_LICENSE}{_V} 1(?: 0)?"),
    ("artistic-2.0", "artistic", "artistic 2 0", f"artistic {_LICENSE}{_V} 2(?: 0)?"),
    ("bsl-1.0", "boost", "bsl 1 0", f"boost software {_LICENSE}(?:{_V} 1(?: 0)?)?"),
    ("busl-1.1", "business", "busl 1 1", f"business source {_LICENSE}(?:{_V} 1 1)?"),
    ("sspl-1.0", "server", "sspl 1 0", f"server side public {_LICENSE}(?:{_V} 1)?"),
    ("elastic-2.0", "elastic", "elastic 2 0", f"elastic {_LICENSE}(?:{_V} 2(?: 0)?)?"),
    ("unlicense", "unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl", "wtfpl"),
    ("zlib", "zlib", "zlib", f"zlib(?: libpng)? {_LICENSE}"),
    ("libpng", "libpng", "libpng(?: 2 0)?", f"libpng {_LICENSE}"),
    ("openssl", "openssl", "openssl", f"openssl {_LICENSE}"),
    ("python-2.0", "python", "python 2 0", f"python software foundation {_LICENSE}(?:{_V} 2)?"),
    ("php-3.01", "php", "php 3 0?1", f"php {_LICENSE}(?:{_V} 3 0?1)?"),
    ("ruby", "ruby", "ruby", f"ruby {_LICENSE}"),
    ("vim", "vim", "vim", f"vim {_LICENSE}"),
    ("ofl-1.1", "sil", "ofl 1 1", f"sil open font {_LICENSE}(?:{_V} 1 1)?"),
    ("ncsa", "ncsa", "ncsa", f"(?:university of illinois )?ncsa(?: open source)? {_LICENSE}"),
    ("ms-pl", "microsoft", "ms pl", f"microsoft public {_LICENSE}"),
    ("ms-rl", "microsoft", "ms rl", f"microsoft reciprocal {_LICENSE}"),
    ("odbl-1.0", "odbl", "odbl 1 0", f"(?:open database {_LICENSE} )?odbl(?:{_V} 1(?: 0)?)?"),
    ("odc-by-1.0", "odc", "odc by 1 0", f"odc by(?:{_V} 1 0)?"),
    ("pddl-1.0", "pddl", "pddl 1 0", f"pddl(?:{_V} 1 0)?"),
    ("llama", "llama", "llama", f"llama(?: [23](?: \\d)?)? community {_LICENSE}"),
    ("openrail", "openrail", "openrail", "(?:bigscience |creativeml )?openrail(?: m)?"),
    ("cc0-1.0", "cc0", "cc0 1 0", "cc0(?: 1 0)?(?: universal)?"),
]
#: The licenses of one family that differ by terms and version: terms in tags, terms in words.
CREATIVE = [("by", "attribution"), ("by sa", "attribution share ?alike"), ("by nd", "attribution no ?deriv(?:ative)?s"), ("by nc", "attribution non ?commercial"),
            ("by nc sa", "attribution non ?commercial share ?alike"), ("by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s")]
CREATIVE_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]

#: Notices and addresses: priority, label, keyword, pattern.
NOTICES = [
    (TAG, "mit", "merge", "permission is hereby granted free of charge to any person obtaining a copy ~ ~ ~ ~ ~ ~ ~ to use copy modify merge"),
    (GRANT, "mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy"),
    (TAG, "isc", "fee", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    (TAG, "bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display"),
    (TAG, "bsd-3-clause", "endorse", "neither the name ~ ~ ~ may be used to endorse or promote products"),
    (GRANT, "bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    (TAG, "apache-2.0", "apache", f"licensed under the apache {_LICENSE} version 2 0 the {_LICENSE} you may not use this file except in compliance"),
    (TAG, "apache-2.0", "apache", "apache org licenses license 2 0"),
    (TAG, "apache-1.1", "apache", "apache org licenses license 1 1"),
    (TAG, "mit", "mit", "opensource org licen[cs]es?(?: licen[cs]es?)? mit(?: license)?(?: php)?"),
    (TAG, "isc", "isc", "opensource org licenses? isc"),
    (TAG, "bsd-2-clause", "bsd", "opensource org licenses? bsd 2 clause"),
    (TAG, "bsd-3-clause", "bsd", "opensource org licenses? bsd 3 clause"),
    (TAG, "gpl-2.0", "gnu", "gnu org licenses (?:old licenses )?gpl 2 0"),
    (TAG, "gpl-3.0", "gnu", "gnu org licenses gpl 3 0"),
    (TAG, "lgpl-2.1", "gnu", "gnu org licenses (?:old licenses )?lgpl 2 1"),
    (TAG, "lgpl-3.0", "gnu", "gnu org licenses lgpl 3 0"),
    (TAG, "agpl-3.0", "gnu", "gnu org licenses agpl 3 0"),
    (TAG, "gfdl-1.3", "gnu", "gnu org licenses fdl 1 3"),
    (NAME, "gpl", "gnu", "gnu org (?:licenses|copyleft) l?gpl"),
    (TAG, "mpl-2.0", "mozilla", "mozilla org mpl 2 0"),
    (TAG, "mpl-2.0", "mozilla", "subject to the terms of the mozilla public license v 2 0"),
    (TAG, "mpl-1.1", "mozilla", "subject to the mozilla public license version 1 1"),
    (TAG, "epl-1.0", "eclipse", "eclipse org legal epl v10"),
    (TAG, "epl-2.0", "eclipse", "eclipse org legal epl (?:v20|2 0)"),
    (TAG, "bsl-1.0", "boost", "boost org license 1 0"),
    (TAG, "unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    (TAG, "unlicense", "unlicense", "unlicense org"),
    (TAG, "wtfpl", "fuck", "do what the fuck you want to public license"),
    (TAG, "ofl-1.1", "sil", "scripts sil org ofl"),
    (TAG, "python-2.0", "python", "python org psf license"),
    (TAG, "php-3.01", "php", "php net license 3 01"),
    (TAG, "cc0-1.0", "creativecommons", "creativecommons org publicdomain zero 1 0"),
    (TAG, "public-domain", "creativecommons", "creativecommons org (?:licenses publicdomain|publicdomain mark 1 0)"),
    (TAG, "odbl-1.0", "opendatacommons", "opendatacommons org licenses odbl"),
    (TAG, "pddl-1.0", "opendatacommons", "opendatacommons org licenses pddl"),
    (TAG, "odc-by-1.0", "opendatacommons", "opendatacommons org licenses by"),
    (TAG, "gpl-2.0-or-later", "gnu", "terms of the gnu general public license as published by the free software foundation either version 2 of the license or ~ any later version"),
    (TAG, "gpl-3.0-or-later", "gnu", "terms of the gnu general public license as published by the free software foundation either version 3 of the license or ~ any later version"),
    (TAG, "lgpl-2.1-or-later", "lesser", "terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or ~ any later version"),
    (GRANT, "gpl-or-later", "later", "general public license ~ (?:version )?[123](?: 0)? or ~ later(?: version)?"),
    (GRANT, "public-domain", "domain", "(?:released|placed|dedicated|put) (?:in|into|to) the public domain"),
    (NAME, "public-domain", "domain", "(?:is|are) in the public domain"),
    (HINT, "public-domain", "domain", "public domain"),
    (GRANT, "public-domain", "domaine", "dans le domaine public"),
    (GRANT, "public-domain", "dominio", "(?:en|de) dominio público"),
    (GRANT, "public-domain", "gemeinfrei", "(?:ist|sind) gemeinfrei"),
    (GRANT, "reserved", "droits", "tous droits réservés"),
    (GRANT, "reserved", "derechos", "(?:todos|reservados todos) los derechos(?: reservados)?"),
    (GRANT, "reserved", "rechte", "alle rechte vorbehalten"),
    (GRANT, "licensed-fr", "licence", "sous(?: la)? licence"),
    (GRANT, "licensed-es", "licencia", "bajo(?: la| una)? licencia"),
    (GRANT, "licensed-de", "lizenz", "(?:unter|lizenziert unter) (?:der|einer) ~ lizenz"),
    (GRANT, "proprietary", "proprietary", "(?:proprietary and confidential|confidential and proprietary|proprietary software|proprietary license)"),
    (GRANT, "proprietary", "unauthorized", "unauthorized (?:copying|reproduction|distribution|use) ~ (?:is )?(?:strictly )?prohibited"),
    (NAME, "proprietary", "reproduced", "(?:may|must) not be (?:reproduced|copied|distributed) ~ without ~ (?:written )?permission"),
    (NAME, "non-commercial", "commercial", "(?:for )?(?:non ?commercial|personal) use only"),
    (NAME, "non-commercial", "commercial", "not for commercial use"),
    (NAME, "research-only", "research", "(?:for )?(?:academic|research|educational) (?:use|purposes) only"),
    (HINT, "copyright", "copyright", "copyright(?: c)? (?:19|20)\\d\\d"),
    (HINT, "copyright", "copyrighted", "copyrighted (?:material|work|by)"),
    (HINT, "mit", "mit", f"mit style {_LICENSE}"),
    (HINT, "bsd", "bsd", f"bsd(?: style)? {_LICENSE}"),
    (HINT, "apache", "apache", f"apache(?: software)? {_LICENSE}"),
    (HINT, "gpl", "gnu", f"gnu(?: gpl| general public {_LICENSE})"),
    (HINT, "lgpl", "lesser", f"(?:gnu )?lesser general public {_LICENSE}"),
    (HINT, "lgpl", "lgpl", "lgpl"),
    (HINT, "agpl", "agpl", "agpl"),
    (HINT, "gpl", "gpl", "gpl"),
    (HINT, "mpl", "mozilla", f"mozilla public {_LICENSE}"),
    (HINT, "epl", "eclipse", f"eclipse public {_LICENSE}"),
    (HINT, "artistic", "artistic", f"artistic {_LICENSE}"),
    (HINT, "creative-commons", "creative", "creative commons"),
    (HINT, "open-source", "source", f"open source {_LICENSE}"),
    (HINT, "licensed", "licensed", "licensed (?:under|to|by)"),
    (HINT, "licensed", "terms", f"terms of ~ {_LICENSE}"),
]

_UNDER = "(?:licen[cs]ed|released|distributed|available|provided|published|offered|shared) ~ under ~ "


def rules() -> tuple[Rule, ...]:
    """All rules in their order: each name as a tag, in a tag's expression, in a grant and alone, then the notices and the base phrases."""
    names = list(NAMES)
    for terms, words in CREATIVE:
        for v in CREATIVE_VERSIONS:
            label = f"cc {terms} {v}".replace(" ", "-").replace(v.replace(" ", "-"), v.replace(" ", "."))
            names.append((label, "cc", f"cc {terms} {v}", f"cc {terms} {v}"))
            names.append((label, "creative", f"creative commons {terms} {v}", f"creative commons {words}(?: international| unported| generic)?(?: {_LICENSE})? {v}"))
        names.append((f"cc-{terms}".replace(" ", "-"), "cc", f"cc {terms}", f"cc {terms}"))
        names.append((f"cc-{terms}".replace(" ", "-"), "creative", f"creative commons {terms}", f"creative commons {words}"))
    found = []
    for label, keyword, tag, name in names:
        found.append(Rule(TAG, label, "spdx", f"spdx license identifier {tag}"))
        found.append(Rule(GRANT, label, "spdx", f"spdx license identifier ~ (?:or|and) {tag}"))  # the others of an expression
        found.append(Rule(GRANT, label, keyword, f"{_UNDER}{name}"))
        found.append(Rule(NAME, label, keyword, name))
    for terms, _ in CREATIVE:
        for v in CREATIVE_VERSIONS:
            label = f"cc-{terms.replace(' ', '-')}-{v.replace(' ', '.')}"
            found.append(Rule(TAG, label, "creativecommons", f"creativecommons org licenses {terms} {v}"))
    found += [Rule(*x) for x in NOTICES]
    found += [Rule(HINT, label, keyword, phrase, True) for phrase, label, keyword in BASE]
    return tuple(found)
