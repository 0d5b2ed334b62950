"""License scans by sentence and rule recognition.

Texts are cut into sentences at signs that
end one, blank lines and list marks; a wrapped sentence stays whole. Sentences are normalised (lower case, words
only) and mapped to identifiers of known licence sentences, which may begin and end at any line of a sentence, so a
notice without a full stop before or after it is found too. The sequence of identifiers is then matched against ordered rules, most specific first: a rule holds where its
identifiers stand in consecutive sentences, and the sentences it explains take part in no later rule.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.registry import query
from touchline.llm.storage import table

# Licence names as they stand in normalised sentences.
NAMES = {
    "AGPL-3.0": r"(?:gnu )?(?:affero general public licen[sc]e|agpl)(?: as published by the free software foundation)?(?: either)?(?: ?(?:version |v ?)?3(?: 0)?)?",
    "LGPL-3.0": r"(?:gnu )?(?:lesser general public licen[sc]e|lgpl)(?: as published by the free software foundation)?(?: either)?(?: ?(?:version |v ?)?3(?: 0)?)",
    "LGPL-2.1": r"(?:gnu )?(?:lesser general public licen[sc]e|library general public licen[sc]e|lgpl)(?: as published by the free software foundation)?(?: either)?(?: ?(?:version |v ?)?2(?: [01])?)",
    "GPL-3.0": r"(?:gnu )?(?:general public licen[sc]e|gpl)(?: as published by the free software foundation)?(?: either)?(?: ?(?:version |v ?)?3(?: 0)?)",
    "GPL-2.0": r"(?:gnu )?(?:general public licen[sc]e|gpl)(?: as published by the free software foundation)?(?: either)?(?: ?(?:version |v ?)?2(?: 0)?)",
    "GPL": r"(?:gnu )?(?:general public licen[sc]e|gpl)",
    "Apache-2.0": r"apache(?: software)?(?: licen[sc]e)?(?: ?(?:version |v ?)?2(?: 0)?)?(?: the licen[sc]e)?",
    "MIT": r"(?:mit|expat)(?: licen[sc]e)?",
    "BSD-2-Clause": r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: licen[sc]e)?",
    "BSD-3-Clause": r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|bsd)(?: licen[sc]e)?",
    "MPL-2.0": r"mozilla public licen[sc]e(?: ?(?:version |v ?)?2(?: 0)?)?|mpl ?(?:v ?)?2 0",
    "EPL-2.0": r"eclipse public licen[sc]e(?: ?(?:version |v ?)?2(?: 0)?)?|epl ?(?:v ?)?2 0",
    "ISC": r"isc(?: licen[sc]e)?",
    "CC-BY-NC-SA-4.0": r"(?:cc|creative commons) (?:by nc sa|attribution noncommercial sharealike)(?: 4 0)?(?: international)?(?: licen[sc]e)?",
    "CC-BY-NC-ND-4.0": r"(?:cc|creative commons) (?:by nc nd|attribution noncommercial noderiv(?:ative)?s)(?: 4 0)?(?: international)?(?: licen[sc]e)?",
    "CC-BY-NC-4.0": r"(?:cc|creative commons) (?:by nc|attribution noncommercial)(?: 4 0)?(?: international)?(?: licen[sc]e)?",
    "CC-BY-SA-4.0": r"(?:cc|creative commons) (?:by sa|attribution sharealike)(?: 4 0)?(?: international)?(?: licen[sc]e)?",
    "CC-BY-4.0": r"(?:cc|creative commons) (?:by|attribution)(?: 4 0)?(?: international)?(?: licen[sc]e)?",
    "CC0-1.0": r"cc0(?: 1 0)?(?: universal)?",
    "Unlicense": r"unlicense",
}

_GRANT = (r"(?:(?:this|the|it) (?:\w+ ){0,3}(?:is|are) |(?:\w+ ){1,4}is free software you can redistribute it and or modify it )?"
          r"(?:(?:also )?(?:dual )?(?:licen[sc]ed|released|distributed|available|published|provided|redistributed)(?: to you)? )?"
          r"under (?:the terms of )?(?:an? |the )?")
_LATER = r"(?: of the licen[sc]e)?(?: only)?(?: or at your option any later version| or later| or any later version)?"

# Sentences of licence texts and notices, normalised, by identifier. ".*" at the end takes the rest.
SENTENCES = {
    "copyright": r"(?:portions )?copyright(?: c)?(?: \d{4}[^\n]*| [^\n]{1,80})",
    "all-rights": r"all rights reserved",
    "apache-may-not-use": r"you may not use this (?:file|work|software) except in compliance with the licen[sc]e",
    "apache-obtain": r"you may obtain a copy of the licen[sc]e at.*",
    "apache-as-is": r"unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis.*",
    "apache-see": r"see the licen[sc]e for the specific language governing permissions and limitations under the licen[sc]e",
    "mit-permission": r"permission is hereby granted free of charge to any person obtaining a copy of this software.*",
    "mit-notice": r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": r"the software is provided as is without warranty of any kind.*",
    "mit-liable": r"in no event shall the authors or copyright holders be liable for any claim.*",
    "isc-permission": r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted.*",
    "bsd-redistribution": r"redistribution and use in source and binary forms with or without modification are permitted.*",
    "bsd-source": r"(?:\w )?redistributions of source code must retain the above copyright notice.*",
    "bsd-binary": r"(?:\w )?redistributions in binary form must reproduce the above copyright notice.*",
    "bsd-endorse": r"(?:\w )?neither the name of .{1,120} may be used to endorse or promote products.*",
    "bsd-as-is": r"this software is provided by .{1,120} as is and any express or implied warranties.*",
    "gpl-warranty": r"(?:this \w+|it) is distributed in the hope that it will be useful.*",
    "gpl-see": r"see the gnu (?:lesser |affero )?general public licen[sc]e for more details",
    "gpl-received": r"you should have received a copy of the gnu (?:lesser |affero )?general public licen[sc]e.*",
    "mpl-form": r"this source code form is subject to the terms of the mozilla public licen[sc]e(?: v 2 0)?",
    "public-domain": r"this (?:is free and unencumbered software|work is) (?:released into|dedicated to) the public domain",
    "no-warranty": r"(?:this software|it) is provided without (?:any )?warranty.*",
}

def matcher(pattern: str) -> tuple[re.Pattern, bool]:
    """(pattern for a place in a normalised sentence, whether the rest of the sentence belongs to it). Words may be
    parted by a line's end, and a sentence that is not open ends with a line."""
    is_open = pattern.endswith(".*")
    words = pattern.removesuffix(".*").replace("[^\\n]", "\0").replace(" ", "[ \n]").replace("\0", "[^\\n]")
    return re.compile(words + (r"(?!\w)" if is_open else r"(?=\n|\Z)"), re.DOTALL), is_open


def matchers(patterns) -> list[tuple[str, re.Pattern, bool]]:
    return [(name, *matcher(pattern)) for name, pattern in patterns]


# Known sentences by what they begin with, tried in order.
MATCHERS = [
    (re.compile("spdx"), matchers(
        (f"spdx:{name}", rf"spdx licen[sc]e identifier (?:{pattern}|{re.sub(r'[^a-z0-9]+', ' ', name.lower())}){_LATER}")
        for name, pattern in NAMES.items())),
    (re.compile(_GRANT.replace(" ", "[ \n]")), matchers((f"grant:{name}", rf"{_GRANT}(?:{pattern}){_LATER}") for name, pattern in NAMES.items())),
    (re.compile("(?:[a-z0-9] )?(?:portions|copyright|all|you|unless|see|permission|the|in|redistributions?|neither|this|it)[ \n]"), matchers(SENTENCES.items()))]

# Every matcher needs one of these words or parts: each grant "under", each identifier "spdx", each other sentence its own.
STEMS = re.compile("under|spdx|licen|copyright|reserved|permission|warrant|liab|redistribut|endorse|useful|domain|provided|basis")

# Rules in the order in which they are tried: identifiers of consecutive sentences, and the licence they mean.
RULES = (
    [("Apache-2.0", ("grant:Apache-2.0", "apache-may-not-use", "apache-obtain", "apache-as-is", "apache-see")),
     ("MIT", ("mit-permission", "mit-notice", "mit-as-is", "mit-liable")),
     ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
     ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
     ("MIT", ("mit-permission", "mit-notice")),
     ("MPL-2.0", ("mpl-form",)),
     ("MIT", ("mit-permission",)),
     ("ISC", ("isc-permission",)),
     ("Unlicense", ("public-domain",))]
    + [(name, (f"grant:{name}", "gpl-warranty", "gpl-see")) for name in ("AGPL-3.0", "LGPL-3.0", "LGPL-2.1", "GPL-3.0", "GPL-2.0")]
    + [(name, (f"spdx:{name}",)) for name in NAMES]
    + [(name, (f"grant:{name}",)) for name in NAMES])

# A sign that ends a sentence, a line without words, or a list mark at the start of a line.
# Each run of blanks is looked at once, from its start.
BREAK = re.compile(r"(?<=[.!?])\s+|(?<![^\S\r\n])[^\S\r\n]*(?>\r\n?|\n)(?:[^\w\r\n]*(?>\r\n?|\n))+[^\S\r\n]*"
                   r"|(?<!version)(?>\r\n?|\n)[^\S\r\n]*(?=(?:[-–•]|\(?(?:\d{1,2}|[a-z])[.)])[^\S\r\n])", re.IGNORECASE)
LINE = re.compile(r"[\r\n;]+")       # where a known sentence may begin or end inside a sentence
GAP = re.compile(r"[\W_]+")
WORD = re.compile(r"[^\W\d_]")


def sentences(text: str):
    """(start, end) of sentences; wrapped lines stay together."""
    start = 0
    for gap in BREAK.finditer(text):
        if gap.start() > start:
            yield start, gap.start()
        start = max(start, gap.end())
    if start < len(text):
        yield start, len(text)


def lines_of(text: str, start: int, end: int) -> list[tuple[str, int, int]]:
    """(normalised words, start, end) of the lines of a sentence that hold words."""
    out = []
    for gap in LINE.finditer(text, start, end):
        out.append((start, gap.start()))
        start = gap.end()
    out.append((start, end))
    return [(words, a, b) for a, b in out if (words := normalised(text[a:b]))]


def normalised(sentence: str) -> str:
    return GAP.sub(" ", sentence.lower()).strip()


def known_parts(lines: list[tuple[str, int, int]]) -> list[tuple[str | None, int, int]]:
    """(identifier, start, end) of the known sentences among the lines of a sentence, in order; what lies between
    them is one part without an identifier."""
    whole = "\n".join(words for words, _, _ in lines)
    ends, at = [], -1
    for words, _, _ in lines:
        at += len(words) + 1
        ends.append(at)

    def found(line: int) -> tuple[str, int, bool] | None:
        """(identifier, last line, open) of the longest known sentence that begins with a line."""
        start = ends[line] - len(lines[line][0])
        best = None
        for name, pattern, is_open in (m for head, group in MATCHERS if head.match(whole, start) for m in group):
            hit = pattern.match(whole, start)
            if hit and (best is None or hit.end() > best[1]):
                best = name, hit.end(), is_open
        return best and (best[0], bisect_left(ends, best[1]), best[2])

    out: list[tuple[str | None, int, int]] = []
    line, hit = 0, found(0)
    while line < len(lines):
        last, following = hit[1] if hit else line, None
        while last + 1 < len(lines) and not (following := found(last + 1)) and (hit is None or hit[2]):
            last += 1
        out.append((hit and hit[0], lines[line][1], lines[last][2]))
        line, hit = last + 1, following
    return out


def scan(text: str) -> list[tuple[str, int, int]]:
    """(licence, start, end) of every statement found, in order; offsets count code points."""
    known = []
    number = 0
    for start, end in sentences(text):
        if end - start > 3 and not STEMS.search(text[start:end].lower()):
            number += bool(WORD.search(text, start, end))
            continue
        lines = lines_of(text, start, end)
        if len(lines) == 1 and (lines[0][0].isdigit() or len(lines[0][0]) == 1):
            continue                                       # list numbers and signs alone don't part sentences
        for found, first, last in known_parts(lines) if lines else ():
            if found:
                known.append((number, found, first, last))
            number += 1
    taken, out = [False] * len(known), []
    by_first: dict[str, list[int]] = {}
    for i, (_, name, _, _) in enumerate(known):
        by_first.setdefault(name, []).append(i)
    for licence, sequence in RULES:
        for i in by_first.get(sequence[0], ()):
            run = known[i:i + len(sequence)]
            fits = (len(run) == len(sequence) and not any(taken[i:i + len(run)])
                    and all(r[1] == name and r[0] == run[0][0] + k for k, (r, name) in enumerate(zip(run, sequence, strict=True))))
            if fits:
                taken[i:i + len(run)] = [True] * len(run)
                out.append((licence, run[0][2], run[-1][3]))
    return sorted(out, key=lambda x: (x[1], x[2], x[0]))


SCHEMA = "doc_id bigint, licences array<string>, statements array<struct<licence: string, start: bigint, end: bigint>>"


def license_scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: doc_id, licences (distinct, in alphabetical order), statements (with offsets).

    A null or empty text, or one without a known statement, has empty lists. Every task scans its own
    rows, so nothing is shuffled and hot sources need no care. Texts are scanned whole, in time that grows with
    their length; repeated rows and ids give a row each, other columns are ignored, and an empty table gives no rows.
    """
    statement = pa.list_(pa.struct([("licence", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def find(batches):
        for batch in batches:
            found = [scan(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([sorted({s[0] for s in f}) for f in found], pa.list_(pa.string())),
                 pa.array([[dict(zip(("licence", "start", "end"), s, strict=True)) for s in f] for f in found], statement)],
                ["doc_id", "licences", "statements"])

    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(find, SCHEMA)


@query("op9_license_scan")
def op9_license_scan(spark, sf_dir):
    found = license_scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "licences", F.size("statements").cast("bigint").alias("n_statements"),
                        F.get("statements", F.lit(0))["start"].alias("first_start"))
