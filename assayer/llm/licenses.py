"""Licences named in texts: known sentences become identifiers, ordered rules read their sequence.

A text is cut into sentences at full stops and at lines that are blank but for
comment marks, so a sentence may be wrapped over lines. Its pieces (lines, cut
behind semicolons) are normalised (case, white space, marks, years and names of
holders). A known sentence begins and ends with a piece, reaches over as many as
it needs and gets its identifier, and its version where it names one; what
follows up to the next known one or the end belongs to it. The sequence of identifiers of a text,
with the places of their sentences, is then matched against the rules in order:
the first rule whose identifiers follow each other, with at most ``GAP`` unknown
sentences between two of them, takes its sentences; what is left is offered to
the rules behind it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from assayer.llm.common import id_and_text

GAP = 2

#: Normalised licence sentences (regular expressions over whole pieces) and their identifiers.
SENTENCES: tuple[tuple[str, str], ...] = (
    ("SPDX", r"spdx-license-identifier (?P<name>[a-z0-9.+-]+(?: (?:or|and|with) [a-z0-9.+-]+)*)"),
    ("ApacheName", r"(?:this (?:work|file|software|project) is )?licensed under the apache license,? version (?P<version>[0-9.]+)(?: the \"?license\"?)?"),
    ("ApacheComply", r"you may not use this file except in compliance with the license"),
    ("ApacheCopy", r"you may obtain a copy of the license at.*"),
    ("ApacheBasis", r"unless required by applicable law or agreed to in writing,? software distributed under the license is distributed on an as is basis.*"),
    ("ApacheSee", r"see the license for the specific language governing permissions and limitations under the license"),
    ("GPLName", r"(?:this (?:work|program|file|software) is )?(?:licensed|released) under the gnu general public license,? version (?P<version>[0-9.]+)"),
    ("LGPLName", r"(?:this (?:work|program|file|software) is )?(?:licensed|released) under the gnu lesser general public license,? version (?P<version>[0-9.]+)"),
    ("AGPLName", r"(?:this (?:work|program|file|software) is )?(?:licensed|released) under the gnu affero general public license,? version (?P<version>[0-9.]+)"),
    ("GPLFree", r"this program is free software:? you can redistribute it and/or modify it under the terms of the gnu general public license.*either version (?P<version>[0-9.]+) of the license.*"),
    ("GPLHope", r"this program is distributed in the hope that it will be useful,? but without any warranty.*"),
    ("GPLOnly", r"this program is free software:? you can redistribute it and/or modify it under the terms of (?:the gnu general public license,? version (?P<version>[0-9.]+)|version (?P<version2>[0-9.]+) of the gnu general public license).*"),
    ("LGPLFree", r"this (?:program|library) is free software:? you can redistribute it and/or modify it under the terms of the gnu lesser general public license.*either version (?P<version>[0-9.]+) of the license.*"),
    ("AGPLFree", r"this program is free software:? you can redistribute it and/or modify it under the terms of the gnu affero general public license.*either version (?P<version>[0-9.]+) of the license.*"),
    ("MPLName", r"this source code form is subject to the terms of the mozilla public license,? v(?:\. ?2\.0)?"),
    ("ISCGrant", r"permission to use, copy, modify,? and/or distribute this software for any purpose with or without fee is hereby granted.*"),
    ("ISCAsIs", r"the software is provided as is and the author disclaims all warranties.*"),
    ("GPLCopy", r"you should have received a copy of the gnu general public license.*"),
    ("MITName", r"(?:this (?:work|file|software|project) is )?(?:released|licensed|distributed) under the(?: terms of the)? mit license"),
    ("MITGrant", r"permission is hereby granted,? free of charge,? to any person obtaining a copy.*"),
    ("MITNotice", r"the above copyright notice and this permission notice shall be included in all copies.*"),
    ("MITAsIs", r"the software is provided as is,? without warranty of any kind.*"),
    ("BSDGrant", r"redistribution and use in source and binary forms,? with or without modification,? are permitted.*"),
    ("BSDSource", r".*redistributions of source code must retain the above copyright notice.*"),
    ("BSDBinary", r".*redistributions in binary form must reproduce the above copyright notice.*"),
    ("BSDEndorse", r".*neither the name .* nor the names of .*may be used to endorse or promote.*"),
    ("BSDAsIs", r"this software is provided by .* as is and any express or implied warranties.*"),
    ("CCName", r"(?:this (?:work|text|article) is )?licensed under (?:a )?(?:creative commons|cc) (?P<name>by(?:-(?:nc|sa|nd)){0,2})(?: (?P<version>[0-9.]+))?"),
    ("CC0Name", r".*(?:dedicated to the public domain|released into the public domain|cc0).*"),
    ("AllRights", r"all rights reserved"),
)

#: Ordered rules: the identifiers that have to follow each other, and the licence, with {version} and {name} of its sentences.
RULES: tuple[tuple[tuple[str, ...], str], ...] = (
    (("SPDX",), "{name}"),
    (("ApacheName", "ApacheComply", "ApacheCopy", "ApacheBasis", "ApacheSee"), "Apache-{version}"),
    (("ApacheName",), "Apache-{version}"),
    (("ApacheComply", "ApacheCopy", "ApacheBasis", "ApacheSee"), "Apache"),
    (("GPLFree", "GPLHope", "GPLCopy"), "GPL-{version}-or-later"),
    (("GPLFree",), "GPL-{version}-or-later"),
    (("GPLOnly", "GPLHope", "GPLCopy"), "GPL-{version}-only"),
    (("GPLOnly",), "GPL-{version}-only"),
    (("LGPLFree",), "LGPL-{version}-or-later"),
    (("AGPLFree",), "AGPL-{version}-or-later"),
    (("MPLName",), "MPL-2.0"),
    (("ISCGrant", "ISCAsIs"), "ISC"),
    (("AGPLName",), "AGPL-{version}"),
    (("LGPLName",), "LGPL-{version}"),
    (("GPLName",), "GPL-{version}"),
    (("MITGrant", "MITNotice", "MITAsIs"), "MIT"),
    (("MITName",), "MIT"),
    (("BSDGrant", "BSDSource", "BSDBinary", "BSDEndorse", "BSDAsIs"), "BSD-3-Clause"),
    (("BSDGrant", "BSDSource", "BSDBinary", "BSDAsIs"), "BSD-2-Clause"),
    (("CCName",), "CC-{name}-{version}"),
    (("CC0Name",), "CC0"),
    (("AllRights",), "proprietary"),
)


def _over_pieces(identifier: str, pattern: str) -> re.Pattern[str]:
    """The pattern over pieces in lines of their own: blanks may be line ends. An SPDX tag stands on one line."""
    if identifier != "SPDX":
        head, tail = pattern.startswith(".*"), pattern.endswith(".*")
        inner = pattern[2 * head : len(pattern) - 2 * tail].replace(".*", r"[\s\S]*?").replace(" ", r"[ \n]")
        pattern = r"[^\n]*" * head + inner + r"[^\n]*" * tail
    return re.compile(f"^(?:{pattern})$", re.MULTILINE)


_KNOWN = [(identifier, _over_pieces(identifier, pattern)) for identifier, pattern in SENTENCES]
_LINE_END = re.compile(r"\r\n|[\n\r]")
_STOP = re.compile(r"(?<=[.!?])\s+")
_PIECE_END = re.compile(r"(?<=;)\s+")
_ONLY_MARKS = re.compile(r"[\s/*#>;-]*")
#: Licences are named in the spelling of their own rules, whatever case a tag has them in; operators stay capital.
_SPELLINGS = {name.upper(): name for name in ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause")} | {
    f"{family}-{version}-{kind}".upper(): f"{family}-{version}-{kind}"
    for family in ("GPL", "LGPL", "AGPL") for version in ("2.0", "2.1", "3.0") for kind in ("or-later", "only")
}
#: One of these is in every known sentence; sentences without one are not normalised at all. Single words, as a line may end between two.
_TRACES = re.compile(r"licen[sc]e|domain|reserved|spdx|redistribut|permission|warrant|cc0|endorse", re.IGNORECASE)

Found = tuple[int, str, str, str]


def normalise(sentence: str) -> str:
    """Lower case, one blank between words, without comment marks, quotes, years and marks at the ends."""
    plain = re.sub(r"[\"'“”‘’()\[\]]|^[\s/*#>;-]+", "", sentence.lower())
    plain = re.sub(r"spdx-license-identifier:", "spdx-license-identifier", plain)
    plain = re.sub(r"copyright (?:©|c)?\s*[0-9, -]*", "copyright ", plain)
    return re.sub(r"\s+", " ", plain).strip(" .,;:!*/#")


def sentences(text: str) -> Iterator[list[str]]:
    """The sentences of a text, each as its lines (the parts of lines that belong to it)."""
    lines: list[str] = []
    for line in _LINE_END.split(text):
        if _ONLY_MARKS.fullmatch(line):  # a paragraph ends
            if lines:
                yield lines
                lines = []
            continue
        for part in _STOP.split(line.strip()):
            if _ONLY_MARKS.fullmatch(part):
                continue
            lines.append(part)
            if part[-1] in ".!?":
                yield lines
                lines = []
    if lines:
        yield lines


def identify(text: str) -> list[Found]:
    """(place of the sentence, identifier, version, name) of the known sentences of a text, in order."""
    found: list[Found] = []
    if not _TRACES.search(text):
        return found
    place = 0
    for lines in sentences(text):
        here = known_in(lines) if _TRACES.search("\n".join(lines)) else []
        place += bool(here and here[0][0])  # what stands in front of the first known sentence counts as one
        for k, (_, identifier, version, name) in enumerate(here):
            found.append((place + k, identifier, version, name))
        place += max(1, len(here))
    return found


def known_in(lines: list[str]) -> list[Found]:
    """(begin, identifier, version, name) of the known sentences inside the lines; where two overlap, the earlier counts."""
    plain = "\n".join(filter(None, (normalise(piece) for line in lines for piece in _PIECE_END.split(line))))
    hits = sorted(((m.start(), i, m) for i, (_, pattern) in enumerate(_KNOWN) for m in pattern.finditer(plain)), key=lambda hit: hit[:2])
    out, end = [], 0
    for begin, i, match in hits:
        if begin < end:
            continue
        named = match.groupdict()
        name = " ".join(_SPELLINGS.get(part, part) for part in (named.get("name") or "").upper().split())
        out.append((begin, _KNOWN[i][0], named.get("version") or named.get("version2") or "", name))
        end = match.end()
    return out


def licences(found: list[Found]) -> list[tuple[str, int, int, list[str]]]:
    """(licence, first and last sentence, identifiers) by the ordered rules, in order of place.

    "All rights reserved" right before, in or right behind the sentences of a licence belongs to its notice.
    """
    granted = licences_by_rules([f for f in found if f[1] != "AllRights"])
    near = lambda f: any(hit[1] - GAP <= f[0] <= hit[2] + GAP for hit in granted)
    alone = [f for f in found if f[1] == "AllRights" and not near(f)]
    return sorted(granted + licences_by_rules(alone), key=lambda x: x[1:3])


def licences_by_rules(found: list[Found]) -> list[tuple[str, int, int, list[str]]]:
    """The hits of all rules, each sentence in one of them at most."""
    left, out = list(found), []
    for wanted, name in RULES:
        at = 0
        while at + len(wanted) <= len(left):
            run = left[at : at + len(wanted)]
            close = all(b[0] - a[0] <= GAP + 1 for a, b in zip(run, run[1:], strict=False))
            if tuple(f[1] for f in run) == wanted and close:
                version = next((f[2] for f in run if f[2]), "")
                label = next((f[3] for f in run if f[3]), "")
                licence = name.format(version=_two_part(version), name=label).rstrip("-").replace("--", "-")
                out.append((licence, run[0][0], run[-1][0], [f[1] for f in run]))
                del left[at : at + len(wanted)]
            else:
                at += 1
    return out


def _two_part(version: str) -> str:
    version = version.rstrip(".")
    return version if not version or "." in version else f"{version}.0"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each licence found: doc_id, licence, first_sentence, last_sentence, sentence_ids.

    Sentences count from 0 over the non-empty sentences of the whole text; a
    known sentence counts as one, over however many lines it is wrapped. Texts
    without a known sentence, null and empty texts have no row. Repeated rows
    are reported each; null ids stay null; other columns are not looked at.
    """

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, found = [], []
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                for hit in licences(identify(text)):
                    owners.append(i)
                    found.append(hit)
            columns = list(zip(*found, strict=True)) or [[]] * 4
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owners, pa.int64())), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))],
                ["doc_id", "licence", "first_sentence", "last_sentence", "sentence_ids"],
            )

    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scanned, f"doc_id {kind}, licence string, first_sentence int, last_sentence int, sentence_ids array<string>")
