"""License detection by ordered signature rules.

Rules are regular expressions over normalised words (lower-cased, one blank between words). Keywords
gate each rule: a rule runs only in texts that contain one of its keywords, which one search a keyword decides.
Whatever matches a rule contains one of its keywords, so gates change nothing but the time.
A license that stands in a list with a detected one ("or", "and") is detected as well. A rule of a license without a version or kind
is weaker than all rules of definite ones. Detections that overlap are resolved by the rules' priority and by containment: a detection that overlaps one of a
higher priority is dropped; of one priority, the longer one stays, so what lies within another goes (of equal ones, the
rule that comes first). The three base phrases are always reported, whatever else is found. Repeated rows have a
result each, empty tables none.

The score is 1 - the product of (1 - strength) over the detections kept: 0.9 for a full grant or an
identifier, 0.6 for a license's name, 0.3 for a mere hint.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WORDED, mapped, slices, texts

#: Fixed phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Licenses: label, keywords that gate its rules (one entry for all names or one for each, alternatives
#: separated by |), names, identifiers (both as normalised words).
LICENSES = (
    ("mit", (" mit ", " expat "), (r"mit(?: x11)?", r"expat"), ("mit",)),
    ("apache-2", "apache", (r"apache(?: software)?(?: license)? (?:version |ver |v ?)?2(?: 0)?", r"apache2"), ("apache 2 0",)),
    ("apache-1.1", "apache", (r"apache(?: software)?(?: license)? (?:version |ver |v ?)?1 1",), ("apache 1 1",)),
    ("gpl-2", ("general public license|gpl", "gplv2"), (r"(?:gnu )?(?:general public license|gpl)(?: gpl)? (?:version |ver |v ?)?2(?: 0)?", r"gplv2"), ("gpl 2 0 only", "gpl 2 0 or later", "gpl 2 0")),
    ("gpl-3", ("general public license|gpl", "gplv3"), (r"(?:gnu )?(?:general public license|gpl)(?: gpl)? (?:version |ver |v ?)?3(?: 0)?", r"gplv3"), ("gpl 3 0 only", "gpl 3 0 or later", "gpl 3 0")),
    ("lgpl-2.1", ("lesser general public|library general public|lgpl", "lgplv2"), (r"(?:gnu )?(?:(?:lesser|library) general public license|lgpl) (?:version |ver |v ?)?2(?: [01])?", r"lgplv2(?: 1)?"), ("lgpl 2 1 only", "lgpl 2 1 or later", "lgpl 2 1")),
    ("lgpl-3", ("lesser general public|lgpl", "lgplv3"), (r"(?:gnu )?(?:lesser general public license|lgpl) (?:version |ver |v ?)?3(?: 0)?", r"lgplv3"), ("lgpl 3 0 only", "lgpl 3 0 or later", "lgpl 3 0")),
    ("agpl-3", ("affero|agpl", "agplv3"), (r"(?:gnu )?(?:affero general public license|agpl) (?:version |ver |v ?)?3(?: 0)?", r"agplv3"), ("agpl 3 0 only", "agpl 3 0 or later", "agpl 3 0")),
    ("gfdl", "free documentation", (r"(?:gnu )?free documentation license",), ("gfdl 1 3",)),
    ("bsd-2-clause", " bsd ", (r"(?:simplified|freebsd|2 clause|two clause) bsd", r"bsd (?:2|two) clause"), ("bsd 2 clause",)),
    ("bsd-3-clause", " bsd ", (r"(?:new|modified|revised|3 clause|three clause) bsd", r"bsd (?:3|three) clause"), ("bsd 3 clause",)),
    ("bsd-4-clause", " bsd ", (r"(?:original|4 clause|four clause) bsd", r"bsd (?:4|four) clause"), ("bsd 4 clause",)),
    ("0bsd", " bsd ", (r"(?:zero clause|0 clause) bsd",), ("0bsd",)),
    ("isc", " isc ", (r"isc",), ("isc",)),
    ("mpl-2", "mozilla", (r"mozilla public license(?: mpl)? (?:version |ver |v ?)?2(?: 0)?",), ("mpl 2 0",)),
    ("mpl-1.1", "mozilla", (r"mozilla public license(?: mpl)? (?:version |ver |v ?)?1 1",), ("mpl 1 1",)),
    ("epl-1", "eclipse", (r"eclipse public license (?:version |ver |v ?)?1(?: 0)?",), ("epl 1 0",)),
    ("epl-2", "eclipse", (r"eclipse public license (?:version |ver |v ?)?2(?: 0)?",), ("epl 2 0",)),
    ("cddl-1", ("common development", "cddl"), (r"common development and distribution license(?: cddl)?", r"cddl"), ("cddl 1 0", "cddl 1 1")),
    ("eupl", "european union", (r"european union public licen[cs]e",), ("eupl 1 2",)),
    ("artistic-2", "artistic", (r"artistic license (?:version |ver |v ?)?2(?: 0)?",), ("artistic 2 0",)),
    ("artistic-1", "artistic", (r"(?:perl )?artistic license(?: (?:version |ver |v ?)?1(?: 0)?)?",), ("artistic 1 0",)),
    ("zlib", " zlib ", (r"zlib(?: libpng)?",), ("zlib",)),
    ("boost-1", "boost", (r"boost software license(?: (?:version |ver |v ?)?1(?: 0)?)?",), ("bsl 1 0",)),
    ("unlicense", "unlicense", (r"the unlicense",), ("unlicense",)),
    ("wtfpl", ("wtfpl", "what the fuck"), (r"wtfpl", r"do what the fuck you want to public license"), ("wtfpl",)),
    ("psf-2", "python", (r"python software foundation license(?: (?:version |ver |v ?)?2)?",), ("psf 2 0", "python 2 0")),
    ("openssl", "openssl", (r"openssl license",), ("openssl",)),
    ("postgresql", "postgresql", (r"postgresql licen[cs]e",), ("postgresql",)),
    ("ofl-1.1", "open font", (r"(?:sil )?open font license(?: (?:version |ver |v ?)?1 1)?",), ("ofl 1 1",)),
    ("ms-pl", "microsoft", (r"microsoft public license",), ("ms pl",)),
    ("ms-rl", "microsoft", (r"microsoft reciprocal license",), ("ms rl",)),
    ("ncsa", " ncsa ", (r"(?:university of illinois )?ncsa(?: open source)?",), ("ncsa",)),
    ("odbl", "open database", (r"open database license",), ("odbl 1 0",)),
    ("pddl", "public domain dedication", (r"public domain dedication and license",), ("pddl 1 0",)),
    ("cc0", ("cc0", "creative commons zero"), (r"cc0(?: 1 0)?(?: universal)?", r"creative commons zero"), ("cc0 1 0",)),
    ("cc-by-nc-nd", ("cc by nc nd", "derivat"), (r"cc by nc nd(?: [1-4] 0)?", r"creative commons attribution non ?commercial no ?derivat(?:ive)?s(?: works)?(?: [1-4] 0)?"), ("cc by nc nd 4 0",)),
    ("cc-by-nc-sa", ("cc by nc sa", "alike"), (r"cc by nc sa(?: [1-4] 0)?", r"creative commons attribution non ?commercial share ?alike(?: [1-4] 0)?"), ("cc by nc sa 4 0",)),
    ("cc-by-nc", ("cc by nc", "commercial"), (r"cc by nc(?: [1-4] 0)?", r"creative commons attribution non ?commercial(?: [1-4] 0)?"), ("cc by nc 4 0",)),
    ("cc-by-sa", ("cc by sa", "alike"), (r"cc by sa(?: [1-4] 0)?", r"creative commons attribution share ?alike(?: [1-4] 0)?"), ("cc by sa 4 0",)),
    ("cc-by-nd", ("cc by nd", "derivat"), (r"cc by nd(?: [1-4] 0)?", r"creative commons attribution no ?derivat(?:ive)?s(?: [1-4] 0)?"), ("cc by nd 4 0",)),
    ("cc-by", "cc by", (r"cc by(?: [1-4] 0)?",), ("cc by 4 0",)),
    ("cc-by", "creative commons", (r"creative commons attribution(?: [1-4] 0)?",), ("cc by 3 0",)),
    ("gpl", ("gnu general public license", "gnu gpl"), (r"(?:the )?gnu general public license", r"gnu gpl"), ("gpl",)),
    ("lgpl", "lesser general public", (r"(?:the )?(?:gnu )?lesser general public license",), ("lgpl",)),
    ("agpl", "affero", (r"(?:the )?(?:gnu )?affero general public license",), ("agpl",)),
    ("bsd", " bsd ", (r"bsd(?: style)?",), ("bsd",)),
    ("apache", "apache", (r"apache(?: software)?(?: foundation)?",), ("apache",)),
    ("mpl", "mozilla", (r"mozilla public",), ("mpl",)),
    ("creative-commons", "creative commons", (r"(?:a )?creative commons",), ("cc",)),
)
#: How a name stands in a grant: template, strength, rank of the template.
FORMS = (
    (r"(?:licensed|released|distributed|available|provided|published) under (?:the )?(?:terms of )?(?:the )?{name}(?: licen[cs]e)?", 0.9, 0),
    (r"subject to (?:the )?(?:terms of )?(?:the )?{name}(?: licen[cs]e)?", 0.9, 0),
    (r"under (?:the )?(?:terms of )?(?:the )?{name} licen[cs]e", 0.9, 1),
    (r"{name} licen[cs]e(?: agreement)?", 0.6, 2),
)
#: Rules of their own: label, keyword, expression, strength.
SINGLE = (
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software", 0.9),
    ("isc", "permission to use", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 0.9),
    ("bsd-3-clause", "neither the name", r"neither the name of (?:(?! neither the name of ).)+? may be used to endorse or promote products derived from this software", 0.9),
    ("gpl-2", "version 2", r"terms of the gnu general public license (?:as published by the free software foundation )?(?:either )?version 2(?: of the license)?", 0.9),
    ("gpl-3", "version 3", r"terms of the gnu general public license (?:as published by the free software foundation )?(?:either )?version 3(?: of the license)?", 0.9),
    ("lgpl-2.1", "version 2 1", r"terms of the gnu lesser general public license (?:as published by the free software foundation )?(?:either )?version 2 1(?: of the license)?", 0.9),
    ("lgpl-3", "version 3", r"terms of the gnu lesser general public license (?:as published by the free software foundation )?(?:either )?version 3(?: of the license)?", 0.9),
    ("agpl-3", "version 3", r"terms of the gnu affero general public license (?:as published by the free software foundation )?(?:either )?version 3(?: of the license)?", 0.9),
    ("gpl-2", "gpl", r"gpl ?v2(?: only| or later)?|gpl2", 0.6),
    ("gpl-3", "gpl", r"gpl ?v3(?: only| or later)?|gpl3", 0.6),
    ("mpl-2", "mpl", r"mpl (?:v ?)?2(?: 0)?", 0.6),
    ("mpl-2", "mozilla public", r"subject to the terms of the mozilla public license v ?2 0", 0.9),
    ("epl-2", "epl", r"epl (?:v ?)?2(?: 0)?", 0.6),
    ("epl-1", "epl", r"epl (?:v ?)?1(?: 0)?", 0.6),
    ("bsd-3-clause", "neither the names", r"neither the names of (?:(?! neither the names of ).)+? may be used to endorse or promote products derived from this software", 0.9),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 0.9),
    ("mit", "sublicense", r"the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", 0.9),
    ("isc", "isc style", r"isc style licen[cs]e", 0.6),
    ("zlib", "freely subject", r"alter it and redistribute it freely subject to the following restrictions", 0.6),
    ("apache-2", "you may not use this file", r"licensed under the apache license version 2 0 the license you may not use this file", 0.9),
    ("artistic-1", "perl itself", r"under the same terms as perl itself", 0.6),
    ("gpl", "perl itself", r"same terms as perl itself", 0.3),
    ("ruby", "ruby", r"ruby(?: s)? licen[cs]e|licen[cs]ed under the same terms as ruby", 0.6),
    ("php-3", "php license", r"php license(?: (?:version |v ?)?3(?: 0[01])?)?", 0.6),
    ("ijg", "independent jpeg", r"independent jpeg group s? ?(?:software|license)", 0.6),
    ("x11", "x consortium", r"x consortium licen[cs]e", 0.6),
    ("upl-1", "universal permissive", r"universal permissive license(?: (?:version |v ?)?1(?: 0)?)?", 0.6),
    ("ecl-2", "educational community", r"educational community license(?: (?:version |v ?)?2(?: 0)?)?", 0.6),
    ("osl-3", "open software license", r"open software license(?: (?:version |v ?)?3(?: 0)?)?", 0.6),
    ("afl-3", "academic free", r"academic free license(?: (?:version |v ?)?3(?: 0)?)?", 0.6),
    ("cecill-2", "cecill", r"cecill(?: free software license agreement)?(?: (?:version |v ?)?2(?: [01])?)?", 0.6),
    ("mulan-2", "mulan", r"mulan (?:psl|permissive software license)(?: ?v ?2)?", 0.6),
    ("sspl-1", "server side public", r"server side public license(?: (?:version |v ?)?1)?", 0.6),
    ("busl-1.1", "business source", r"business source license(?: (?:version |v ?)?1 1)?", 0.6),
    ("elastic-2", "elastic license", r"elastic license(?: (?:version |v ?)?2(?: 0)?)?", 0.6),
    ("openrail", "openrail", r"(?:creativeml )?open ?rail(?: ?m)?(?: licen[cs]e)?", 0.6),
    ("odc-by", "open data commons", r"open data commons attribution license(?: (?:version |v ?)?1(?: 0)?)?", 0.6),
    ("odbl", "open data commons", r"open data commons open database license(?: (?:version |v ?)?1(?: 0)?)?", 0.9),
    ("ogl-3", "open government", r"open government licen[cs]e(?: (?:version |v ?)?3(?: 0)?)?", 0.6),
    ("ccdl-zero", "waived all copyright", r"has waived all copyright and related or neighboring rights", 0.6),
    ("public-domain", "public domain", r"public domain dedication", 0.6),
    ("proprietary", "proprietary and confidential", r"proprietary and confidential", 0.6),
    ("proprietary", "strictly prohibited", r"unauthorized copying of this file via any medium is strictly prohibited", 0.9),
    ("proprietary", "written permission", r"may not be reproduced (?:or transmitted )?in any form without (?:prior )?written permission", 0.6),
    ("bsd-2-clause", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted", 0.6),
    ("zlib", "altered source", r"altered source versions must be plainly marked as such", 0.9),
    ("boost-1", "boost software", r"boost software license version 1 0", 0.9),
    ("wtfpl", "what the fuck", r"do what the fuck you want to", 0.9),
    ("unlicense", "unencumbered", r"free and unencumbered software released into the public domain", 0.9),
    ("public-domain", "public domain", r"(?:in|into|to) the public domain", 0.6),
    ("proprietary", "rights reserved", r"all rights reserved", 0.3),
    ("gpl-or-later", "any later version", r"(?:or at your option )?any later version", 0.3),
    ("cc-by", "creativecommons", r"creativecommons org licenses by(?: [1-4] 0)?", 0.9),
    ("cc-by-sa", "creativecommons", r"creativecommons org licenses by sa(?: [1-4] 0)?", 0.9),
    ("cc-by-nc", "creativecommons", r"creativecommons org licenses by nc(?: [1-4] 0)?", 0.9),
    ("cc-by-nd", "creativecommons", r"creativecommons org licenses by nd(?: [1-4] 0)?", 0.9),
    ("cc0", "creativecommons", r"creativecommons org publicdomain zero(?: 1 0)?", 0.9),
    ("apache-2", "apache org", r"apache org licenses license 2 0", 0.9),
    ("gpl", "gnu org", r"gnu org (?:licenses|copyleft) gpl", 0.9),
    ("lgpl", "gnu org", r"gnu org (?:licenses|copyleft) lgpl", 0.9),
    ("mit", "opensource org", r"opensource org licenses mit(?: license)?", 0.9),
)
#: Labels without a version or kind: any rule of them gives way to a rule of a definite license.
GENERAL = {"gpl", "lgpl", "agpl", "bsd", "apache", "mpl", "creative-commons", "gpl-or-later"}
#: Names that are words of other use: they count only within a grant or next to "license".
_PLAIN = {"mit", "isc", "bsd", "apache", "zlib", "ncsa", "creative-commons", "mpl"}


@lru_cache(maxsize=1)
def rules() -> tuple[tuple[int, str, tuple[bytes, ...], re.Pattern, float], ...]:
    """(priority, label, keywords, expression, strength) in order; a smaller priority is stronger."""
    found = []
    for order, (label, keywords, names, ids) in enumerate(LICENSES):
        for name, keyword in zip(names, [keywords] * len(names) if isinstance(keywords, str) else keywords, strict=True):
            for form, strength, rank in FORMS:
                found.append((rank, order, label, keyword, form.format(name=f"(?:{name})"), strength))
            if label not in _PLAIN:
                found.append((3, order, label, keyword, name, 0.6))
        for i in ids:
            found.append((0, order, label, "spdx", rf"spdx license identifier {i}", 0.9))
    found += [(0 if s > 0.8 else 2 if s > 0.5 else 4, 100 + k, label, word, x, s) for k, (label, word, x, s) in enumerate(SINGLE)]
    found = [(rank + 5 * (label in GENERAL), *more) for rank, *more in found for label in more[1:2]]
    found.sort(key=lambda r: (r[0], r[1], r[4]))
    return tuple((rank * 1000 + order, label, tuple(word.encode().split(b"|")), re.compile(rf"(?<= )(?:{x})(?= )".encode()), s) for rank, order, label, word, x, s in found)


@lru_cache(maxsize=1)
def _gates() -> tuple[tuple[tuple[bytes, ...], tuple], ...]:
    by: dict[tuple[bytes, ...], list] = {}
    for r in rules():
        by.setdefault(r[2], []).append(r)
    return tuple((k, tuple(v)) for k, v in by.items())


@lru_cache(maxsize=1)
def _items() -> tuple[tuple[str, re.Pattern, re.Pattern], ...]:
    """Label, and what it looks like after and before another license of a list."""
    each = [(label, f"(?:{name})") for label, _, names, _ in LICENSES if label in _PLAIN for name in names]
    after = lambda x: re.compile(rf" (?:or|and|and or|or alternatively)(?: under)? (?:the )?{x}(?: licen[cs]e)?(?= )".encode())
    before = lambda x: re.compile(rf"(?<= ){x}(?: licen[cs]e)? (?:or|and|and or)(?: the)? $".encode())
    return tuple((label, after(name), before(name)) for label, name in each)


def _listed(text: bytes, kept: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """``kept`` and the licenses that follow or precede one of them in a list: names of other use count there as well."""
    if not kept or not any(w in text for w in (b" or ", b" and ")):
        return kept
    out: list[tuple[int, int, str, float]] = []
    for k, (a, b, label, s) in enumerate(kept):
        edge = out[-1][1] if out else 0
        near = text[max(edge - 1, a - 48, 0) : a] if a > edge else b""
        first = [(m.end() - m.start(), name) for name, _, x in _items() if (m := x.search(near))]
        if first and label not in GENERAL:
            size, name = max(first)
            out.append((a - size, a - 1, name, 0.6))
        out.append((a, b, label, s))
        until, end = kept[k + 1][0] if k + 1 < len(kept) else len(text), b
        while label not in GENERAL:
            found = [(m.end(), name) for name, x, _ in _items() if (m := x.match(text, end)) and m.end() < until]
            if not found:
                break
            start, (end, name) = end + 1, max(found)
            out.append((start, end, name, 0.6))
    return out


def detections(text: bytes) -> list[tuple[int, int, str, float]]:
    """Start, end, label and strength of what is kept in a normalised text (padded with blanks)."""
    hits = []
    for keywords, gated in _gates():
        if any(k in text for k in keywords):
            hits += [(priority // 1000, m.start() - m.end(), priority, m.start(), m.end(), label, s) for priority, label, _, x, s in gated for m in x.finditer(text)]
    starts: list[int] = []
    kept: list[tuple[int, int, str, float]] = []
    for *_, a, b, label, s in sorted(hits):  # kept ones never overlap, so only the neighbours can overlap another
        at = bisect_left(starts, a)
        if (at == len(kept) or b <= starts[at]) and (not at or kept[at - 1][1] <= a):
            starts.insert(at, a)
            kept.insert(at, (a, b, label, s))
    kept = _listed(text, kept)
    # the permission of a license with three clauses is that of one with two, followed by a clause more
    more = [k for k, (here, after) in enumerate(zip(kept, kept[1:])) if here[2] == "bsd-2-clause" and after[2] == "bsd-3-clause" and text.startswith(b"redistribution", here[0])]
    return [k for i, k in enumerate(kept) if i not in set(more)] if more else kept


def scan(text: bytes) -> tuple[int, int, int | None, int | None, str, str, float]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one text (UTF-8)."""
    tokens = text.translate(bytes(WORDED)).split()
    if not tokens:
        return 0, 0, None, None, "", "", 0.0
    n = len(tokens)
    normal = b" " + b" ".join(tokens) + b" "
    base, starts = set(), []
    for phrase, label in BASE:
        needle, at, counted, word = f" {phrase} ".encode(), -1, 0, 0
        while (at := normal.find(needle, at + 1)) >= 0:
            base.add(label)
            word, counted = word + normal.count(b" ", counted, at), at
            starts.append(word)
    kept = detections(normal)
    doubt = 1.0
    for *_, s in kept:
        doubt *= 1 - s
    labels = base | {label for _, _, label, _ in kept}
    score = max(1 - doubt, 0.9 if base else 0.0)
    return n, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id and what ``scan`` says of each row's whole text. Null text: as empty, no words, no labels."""
    types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]

    def run(batches):
        for batch in (part for batch in batches for part in slices(batch)):
            data, offsets = texts(batch.column(1))
            whole = memoryview(data)
            rows = [scan(bytes(whole[a:b])) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types[1:], strict=True))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return mapped(docs.select(docs["doc_id"].cast("long"), "text"), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double", run)


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
