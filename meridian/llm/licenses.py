"""License scans by conditional compression.

Each template has words that must be there, the first of them its anchor. The words around
an anchor, as far as the longest template reaches, are a candidate block; a template can
stand nowhere else. A block is compressed alone and with each template as a zstandard raw
dictionary; what the dictionary saves ranks the templates, since it saves most on the text
that it repeats. Each whose needed words are in the block is confirmed word by word, in that
order: the block must hold nearly all of the template's words in order, and every word that
tells it from other licenses, and the differences are kept. No rank leaves a template out.
"""

from __future__ import annotations

import bisect
import difflib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from meridian.llm.common import table, tidy

# License, wordings of its notices and texts, words that must be there exactly (the anchor first).
_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
_MIT_REST = ", and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_REST = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_REST = " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
TEMPLATES = (
    ("MIT", "Released under the MIT License.", ("license", "mit")),
    ("MIT", _GRANT, ("sublicense",)),
    ("MIT", _GRANT + _MIT_REST, ("sublicense", "noninfringement")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", ("apache", "2.0")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ("apache", "compliance")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", ("apache", "governing")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", ("gnu", "general", "3")),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", ("gnu", "general", "2")),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ("gnu", "redistribute")),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.", ("gnu", "redistribute", "3", "later")),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.", ("gnu", "redistribute", "2", "later")),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3.", ("gnu", "lesser", "3")),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3.", ("gnu", "affero", "3")),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution", "binary")),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_REST, ("redistribution", "binary", "disclaimed")),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_REST, ("redistribution", "binary", "disclaimed", "endorse")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla", "2.0")),
    ("ISC", _ISC, ("fee", "permission")),
    ("ISC", _ISC + ", provided that the above copyright notice and this permission notice appear in all copies." + _ISC_REST, ("fee", "permission", "appear", "disclaims")),
    ("0BSD", _ISC + "." + _ISC_REST, ("fee", "permission", "disclaims")),
    ("Unlicense", "This is free and unencumbered software released into the public domain.", ("unencumbered",)),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.", ("misrepresented",)),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so", ("transmit", "derivative")),
    ("CC-BY-4.0", "Licensed under CC BY 4.0.", ("cc", "by", "4.0")),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", ("cc", "by-sa", "4.0")),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", ("cc", "by-nc", "4.0")),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0.", ("cc", "by-nd", "4.0")),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0.", ("cc", "by-nc-sa", "4.0")),
    *((name, "SPDX-License-Identifier: " + name, ("spdx-license-identifier", name.lower())) for name in ("MIT", "Apache-2.0", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-2.0-only", "GPL-2.0-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "0BSD", "ISC", "MPL-2.0", "Unlicense", "Zlib", "BSL-1.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0")),
)

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_TRIM = "\"'()[]{}<>,;:!?.#*$%&|="


@dataclass(frozen=True)
class Plan:
    """most_differ: share of the template's words that may be missing or out of order. Words before and after an
    anchor belong to its block as far as the longest template with such differences reaches."""

    most_differ: float = 0.12


def _plain(word: str) -> str:
    """The word as it is compared; marks alone, as of a comment, are none."""
    plain = word.lower().strip(_TRIM)
    return plain if any(map(str.isalnum, plain)) else ""


class Scanner:
    def __init__(self, templates=TEMPLATES, plan: Plan = Plan()):
        self.plan = plan
        self.templates = []
        options = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        for name, wording, needed in templates:
            words = [w for x in _WORD.findall(wording) if (w := _plain(x))]
            known = zstandard.ZstdCompressionDict(" ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            packer = zstandard.ZstdCompressor(dict_data=known, compression_params=zstandard.ZstdCompressionParameters.from_level(19, **options))
            self.templates.append((name, words, set(needed), packer))
        self.reach = math.ceil(max(len(w) for _, w, _, _ in self.templates) * (1 + plan.most_differ))
        self.anchors = frozenset(needed[0] for _, _, needed in templates)
        # an anchor as a whole word: nothing but marks that are trimmed may be next to it
        edge = "[" + re.escape(_TRIM) + "\\x20\\x09-\\x0D]"
        self.find = re.compile(f"(?:(?<={edge})|^)(?:{'|'.join(map(re.escape, sorted(self.anchors)))})(?={edge}|$)").search

    def blocks(self, text: str) -> Iterator[list[tuple[str, int, int]]]:
        """Runs of (word, start, end) around anchors; a run is as long as its anchors go on."""
        if not self.find(text.lower()):
            return
        words = [(m[0], m.start(), m.end()) for m in _WORD.finditer(text) if _plain(m[0])]
        spans: list[list[int]] = []
        for w, (word, _, _) in enumerate(words):
            if _plain(word) not in self.anchors:
                continue
            lo, hi = max(0, w - self.reach), min(len(words), w + self.reach + 1)
            if spans and lo <= spans[-1][1] and hi - spans[-1][0] <= 4 * self.reach:
                spans[-1][1] = max(hi, spans[-1][1])
            else:
                spans.append([lo, hi])
        for lo, hi in spans:
            yield words[lo:hi]

    def ranked(self, block: list[str], able: list[int]) -> list[int]:
        """The templates in able by the block's compressed size, the one that saves most first."""
        if len(able) < 2:
            return able
        raw = " ".join(block).encode()
        return sorted(able, key=lambda k: (len(self.templates[k][3].compress(raw)), k))

    def confirmed(self, block: list[str], k: int) -> list[tuple[int, int, int, str]]:
        """(first word, past the last, words that differ, differences) of each place where the block has the template."""
        _, words, needed, _ = self.templates[k]
        out, todo, slack = [], [(0, len(block))], max(2, len(words) // 4)
        while todo:
            first, last = todo.pop()
            if not needed <= set(block[first:last]):
                continue
            run = difflib.SequenceMatcher(None, words, block[first:last], autojunk=False).find_longest_match()
            if not run.size:
                continue
            # what lies farther from the longest run than the template reaches is another place
            start = first + run.b - run.a
            at, upto = max(first, start - slack), min(last, start + len(words) + slack)
            match = difflib.SequenceMatcher(None, words, block[at:upto], autojunk=False)
            near = [m for m in match.get_matching_blocks() if m.size and abs(at + m.b - m.a - start) <= slack]
            if near:
                held = {words[i] for m in near for i in range(m.a, m.a + m.size)}
                lo, hi = at + near[0].b, at + near[-1].b + near[-1].size
                same = sum(m.size for m in near)
                differ = len(words) - same + (hi - lo) - same
                if differ <= self.plan.most_differ * len(words) and needed <= held:
                    edits = [f"-{w}" for w in words if w not in held] + [f"+{w}" for w in block[lo:hi] if w not in held]
                    out.append((lo, hi, differ, " ".join(edits)))
                    todo += [(first, lo), (hi, last)]
                    continue
            todo += [(first, first + run.b), (first + run.b + run.size, last)]
        return out

    def scan(self, text: str) -> list[tuple[str, int, int, int, str]]:
        """(license, start, end, words that differ, differences), in code points, by start; places do not overlap."""
        found = {}
        for block in self.blocks(text):
            plain = [(w, i) for i, (x, _, _) in enumerate(block) if (w := _plain(x))]
            words = [w for w, _ in plain]
            if not words:
                continue
            known = set(words)
            able = [k for k, (_, _, needed, _) in enumerate(self.templates) if needed <= known]
            for k in self.ranked(words, able):
                for lo, hi, differ, edits in self.confirmed(words, k):
                    start, end = block[plain[lo][1]][1], block[plain[hi - 1][1]][2]
                    new = (differ, -(hi - lo), self.templates[k][0], edits)
                    if new[0] < found.get((start, end), (len(words) + 1,))[0]:
                        found[start, end] = new
        best: list[tuple[str, int, int, int, str]] = []
        for (start, end), (differ, _, name, edits) in sorted(found.items(), key=lambda x: (x[1][:2], x[0])):
            k = bisect.bisect_right(best, start, key=lambda b: b[1])
            if (k == 0 or best[k - 1][2] <= start) and (k == len(best) or end <= best[k][1]):
                best.insert(k, (name, start, end, differ, edits))
        return best


def scanned(docs: DataFrame, templates=TEMPLATES, plan: Plan = Plan()) -> DataFrame:
    """(doc_id, n_licenses, licenses, spans, differences) for every row: the distinct licenses found, sorted and
    comma-joined; each place as license:start:end in code points; and each place's words that differ.

    A null or empty text holds none. Repeated rows are each answered; an empty table gives no rows. Only
    doc_id and text are looked at.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_licenses", "licenses", "spans", "differences"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, plan)
        for b in batches:
            found = [scanner.scan(t.as_py() or "") for t in b.column(1)]
            each = [sorted({f[0] for f in x}) for x in found]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(e) for e in each], pa.int64()),
                    pa.array([",".join(e) for e in each], pa.string()),
                    pa.array([",".join(f"{n}:{a}:{z}" for n, a, z, _, _ in x) for x in found], pa.string()),
                    pa.array([";".join(d for *_, d in x) for x in found], pa.string()),
                ],
                names,
            )

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, n_licenses long, licenses string, spans string, differences string")


def op7_licenses(spark, sf_dir):
    return scanned(table(spark, sf_dir, "documents"))
