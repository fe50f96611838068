"""License rules: names times statements, names with a version, and the openings of license texts.

A rule is anchored on one keyword. ``before`` must match right up to it (each word followed by a space), ``after`` right
behind it (each word led by a space), on lower-cased words without punctuation ("CC BY-NC 4.0" is "cc by nc 4 0").
"""
from __future__ import annotations

from typing import NamedTuple

VERSION = r"(?: licen[cs]e)?(?: version| v)?"
NAMED = r" licen[cs]e(?: version| v)?"
ZERO = r"(?: 0)?"

# Label, keyword of the name, words of the name before it, words of the name behind it
NAMES = [
    ("mit", "mit", "", ""),
    ("mit", "expat", "", ""),
    ("mit-0", "mit", "", " no attribution"),
    ("x11", "x11", "", ""),
    ("isc", "isc", "", ""),
    ("apache-1.1", "apache", "", r"(?: software)?" + VERSION + r" v?1 1"),
    ("apache-2", "apache", "", r"(?: software)?" + VERSION + r" v?2" + ZERO),
    ("bsd-2-clause", "bsd", r"(?:simplified |2 clause |two clause )", ""),
    ("bsd-2-clause", "bsd", "", r" 2 clause"),
    ("bsd-3-clause", "bsd", r"(?:new |modified |revised |3 clause |three clause )", ""),
    ("bsd-3-clause", "bsd", "", r" 3 clause"),
    ("bsd-4-clause", "bsd", r"(?:original |4 clause |four clause )", ""),
    ("bsd", "bsd", "", ""),
    ("0bsd", "0bsd", "", ""),
    ("gpl-2", "general", r"(?:gnu )?", r" public" + VERSION + r" v?2" + ZERO),
    ("gpl-3", "general", r"(?:gnu )?", r" public" + VERSION + r" v?3" + ZERO),
    ("gpl", "general", r"(?:gnu )?", r" public"),
    ("gpl-2", "gpl", r"(?:gnu )?", VERSION + r" v?2" + ZERO),
    ("gpl-2", "gplv2", r"(?:gnu )?", ""),
    ("gpl-3", "gpl", r"(?:gnu )?", VERSION + r" v?3" + ZERO),
    ("gpl-3", "gplv3", r"(?:gnu )?", ""),
    ("gpl", "gpl", r"(?:gnu )?", ""),
    ("lgpl-2", "lesser", r"(?:gnu )?", r" general public" + VERSION + r" v?2(?: [01])?"),
    ("lgpl-3", "lesser", r"(?:gnu )?", r" general public" + VERSION + r" v?3" + ZERO),
    ("lgpl", "lesser", r"(?:gnu )?", r" general public"),
    ("lgpl-2", "lgpl", r"(?:gnu )?", VERSION + r" v?2(?: [01])?"),
    ("lgpl-3", "lgpl", r"(?:gnu )?", VERSION + r" v?3" + ZERO),
    ("lgpl-2", "lgplv2", r"(?:gnu )?", r"(?: [01])?"),
    ("lgpl-3", "lgplv3", r"(?:gnu )?", ""),
    ("lgpl", "lgpl", r"(?:gnu )?", ""),
    ("agpl-3", "affero", r"(?:gnu )?", r" general public" + VERSION + r" v?3" + ZERO),
    ("agpl", "affero", r"(?:gnu )?", r" general public"),
    ("agpl-3", "agpl", r"(?:gnu )?", VERSION + r" v?3" + ZERO),
    ("agpl-3", "agplv3", r"(?:gnu )?", ""),
    ("agpl", "agpl", r"(?:gnu )?", ""),
    ("gfdl", "documentation", r"(?:gnu )?free ", ""),
    ("mpl-1.1", "mozilla", "", r" public" + VERSION + r" v?1 1"),
    ("mpl-2", "mozilla", "", r" public" + VERSION + r" v?2" + ZERO),
    ("mpl-2", "mpl", "", VERSION + r" v?2" + ZERO),
    ("mpl-1.1", "mpl", "", VERSION + r" v?1 1"),
    ("mpl", "mozilla", "", r" public"),
    ("mpl", "mpl", "", ""),
    ("epl-1", "eclipse", "", r" public" + VERSION + r" v?1" + ZERO),
    ("epl-2", "eclipse", "", r" public" + VERSION + r" v?2" + ZERO),
    ("cddl", "cddl", "", ""),
    ("cddl", "distribution", r"common development and ", ""),
    ("eupl", "eupl", "", ""),
    ("eupl", "union", r"european ", r" public"),
    ("artistic-2", "artistic", "", VERSION + r" v?2" + ZERO),
    ("artistic", "artistic", "", ""),
    ("boost-1", "boost", "", r" software"),
    ("zlib", "zlib", "", r"(?: libpng)?"),
    ("wtfpl", "wtfpl", "", ""),
    ("unlicense", "unlicense", "", ""),
    ("postgresql", "postgresql", "", ""),
    ("python-2", "psf", "", r"(?: v?2)?"),
    ("ruby", "ruby", "", ""),
    ("ofl-1.1", "ofl", r"(?:sil )?", r"(?:(?: version)? v?1 1)?"),
    ("ofl-1.1", "font", r"(?:sil )?open ", ""),
    ("ms-pl", "microsoft", "", r" public"),
    ("odbl", "odbl", "", ""),
    ("odbl", "database", r"open ", ""),
    ("elastic-2", "elastic", "", VERSION + r" v?2" + ZERO),
    ("elastic", "elastic", "", ""),
    ("sspl-1", "sspl", "", r"(?:(?: version)? v?1" + ZERO + ")?"),
    ("sspl-1", "server", "", r" side public"),
    ("busl-1.1", "busl", "", r"(?:(?: version)? v?1 1)?"),
    ("busl-1.1", "business", "", r" source"),
    ("openrail", "openrail", "", r"(?: m)?"),
    ("cc0", "cc0", "", r"(?: v?1 0)?"),
    ("cc-by", "cc", "", r" by(?: v?[1-4] [05])?"),
    ("cc-by-sa", "cc", "", r" by sa(?: v?[1-4] [05])?"),
    ("cc-by-nd", "cc", "", r" by nd(?: v?[1-4] [05])?"),
    ("cc-by-nc", "cc", "", r" by nc(?: v?[1-4] [05])?"),
    ("cc-by-nc-sa", "cc", "", r" by nc sa(?: v?[1-4] [05])?"),
    ("cc-by-nc-nd", "cc", "", r" by nc nd(?: v?[1-4] [05])?"),
    ("cc0", "creative", "", r" commons zero"),
    ("cc-by", "creative", "", r" commons attribution(?: v?[1-4] [05])?(?: international)?"),
    ("cc-by-sa", "creative", "", r" commons attribution share ?alike(?: v?[1-4] [05])?(?: international)?"),
    ("cc-by-nd", "creative", "", r" commons attribution no ?deriv(?:ative)?s(?: v?[1-4] [05])?(?: international)?"),
    ("cc-by-nc", "creative", "", r" commons attribution non ?commercial(?: v?[1-4] [05])?(?: international)?"),
    ("cc-by-nc-sa", "creative", "", r" commons attribution non ?commercial share ?alike(?: v?[1-4] [05])?(?: international)?"),
    ("cc-by-nc-nd", "creative", "", r" commons attribution non ?commercial no ?deriv(?:ative)?s(?: v?[1-4] [05])?(?: international)?"),
]

TERMS = r"(?:the )?(?:terms (?:and conditions )?of )?(?:the |a |an )?"
GRANT = r"(?:licen[cs]ed |released |distributed |published |provided |offered |covered |made available |available |contributed )(?:to you |only |freely )?under "
# Kind, words before the name, words behind it, word that must be near, priority, weight
STATEMENTS = [
    ("spdx", r"spdx licen[cs]e identifier ", r"(?: only| or later)?", "spdx", 4, 1.0),
    ("grant", GRANT + TERMS, r"(?: licen[cs]e)?(?: agreement)?", "under", 3, 1.0),
    ("under", r"under " + TERMS, r"(?: licen[cs]e)?", "under", 2, 0.9),
    ("field", r"licen[cs]es? (?:type |name |is |the )?", r"(?: licen[cs]e)?", "licen", 1, 0.8),
    ("name", "", r" licen[cs]e", "licen", 1, 0.7),
]
LICENSED = r"licen[cs]ed (?:to you |only |freely )?under "
# Names of programs too: "under x11" says nothing about a license, "licensed under x11" and "under the x11 license" do
PROGRAMS = {"x11", "isc", "expat", "bsd", "artistic", "zlib", "postgresql", "ruby", "elastic"}
# Plain words that are a name only together with the word license
TITLES = (" public", " software", " source")
TITLE_WORDS = {"documentation", "distribution", "font", "database"}
# Label, keyword, words before it, words behind it
BODIES = [
    ("mit", "obtaining", r"permission is hereby granted free of charge to any person ", r" a copy"),
    ("boost-1", "obtaining", r"permission is hereby granted free of charge to any person or organization ", r" a copy"),
    ("isc", "distribute", r"permission to use copy modify and(?: or)? ", r" this software for any purpose with or without fee"),
    ("postgresql", "distribute", r"permission to use copy modify and ", r" this software and its documentation for any purpose without fee and without a written agreement"),
    ("bsd", "redistribution", "", r" and use in source and binary forms"),
    ("zlib", "liable", r"in no event will the authors be held ", r" for any damages arising from the use of this software"),
    ("unlicense", "unencumbered", r"this is free and ", r" software released into the public domain"),
    ("wtfpl", "verbatim", r"everyone is permitted to copy and distribute ", r" or modified copies of this license document"),
    ("mpl-2", "mozilla", r"this source code form is subject to the terms of the ", r" public license v(?:ersion)? 2 0"),
]
BASE = [
    ("mit", "mit", "under the ", " license"),
    ("apache-2", "apache", "", " license version 2"),
    ("cc-by-nc", "cc", "", " by nc"),
]
REACH = 16  # words on each side of the keyword that a rule can see; none needs more


class Rule(NamedTuple):
    rule: int
    label: str
    keyword: str
    before: str
    after: str
    near: str
    priority: int
    weight: float
    base: bool


def rules() -> list[Rule]:
    """All rules in order of priority, then as listed; the base phrases come first."""
    out = [(label, key, before, after, "", 5, 1.0, True) for label, key, before, after in BASE]
    for kind, lead, tail, near, priority, weight in STATEMENTS:
        for label, key, before, after in NAMES:
            title = after.endswith(TITLES) or key in TITLE_WORDS
            program = key in PROGRAMS and VERSION not in after
            whole = title or program and kind == "under"
            front = LICENSED + TERMS if program and kind == "grant" else lead
            out.append((label, key, front + before, after + (tail.replace(r"(?: licen[cs]e)?", r" licen[cs]e") if whole else tail), near, priority, weight, False))
    # "gnu general public license v3": the word license stands before the version
    out += [(label, key, before, after.replace(VERSION, NAMED), "licen", 1, 0.7, False) for label, key, before, after in NAMES if VERSION in after]
    out += [(label, key, before, after, "", 3, 1.0, False) for label, key, before, after in BODIES]
    return [Rule(k, label, key, rf"(?<![^ ]){before}\|$", rf"^\|{after}(?![^ ])", *rest) for k, (label, key, before, after, *rest) in enumerate(out)]
