"""License scans by patience alignment of texts with license templates.

Words of text and template (letters and digits, lower-cased) are aligned: equal words at both ends of a stretch match;
words that occur once in both stretches are anchors; the longest run of anchors that rises in both is kept; the gaps
between them are aligned in the same way; a stretch without anchors by a longest common subsequence. Coverage is the
share of the template's words that match.

A text may hold a notice more than once, or its words in other prose too, and then they are not unique. So a template is
aligned in overlapping windows: its key words are its rarest, so many that a match of the coverage asked for can't miss
all of them, and each key word in the text gives a window that fits the template closely and one that reaches twice the
template's length to both sides. The whole text is aligned too. A template is aligned only where the text, and then the
window, has enough of its words for the coverage asked for; those tests never drop a match.

A match must be dense, with at least half of the words of its span, and hold its template's deciding words (DECIDING: name,
version, NC, SA, ND as consecutive words). Texts that name no license (MIT, BSD, ISC and their siblings) are told apart by
fit, the share of the words of template and span together that match: of two such matches that share more than half of
the longer span, the better fit stays. A license text cut off so far that less than the coverage is left isn't found.

Everything happens in one pass over whole texts, a text at a time; nothing is shuffled. The templates are constants.

Defined results: null and blank texts have no license; of templates with equal coverage the longer counts, then the
first by name; equal texts get equal rows; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

WORDS = re.compile(r"[^\W_]+")

# Whole license texts without title and copyright line, headers, and one-line notices.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
is furnished to do so"""
_MIT_KEEP = """, subject to the following conditions: The above copyright notice and this permission notice shall be
included in all copies or substantial portions of the Software."""
_MIT_AS_IS = """ THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY
KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE
AND NONINFRINGEMENT. IN NO EVENT SHALL THE {} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAME = """ {}. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
_BSD_AS_IS = """ THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF
THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
_ISC_KEEP = """, provided that the above copyright notice and this permission notice appear in all copies"""
_ISC_AS_IS = """. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION
OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_GNU = """This {what} is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {kind} Public
License as published by the Free Software Foundation{comma} either version {version} of the License, or (at your option) any later version.
This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} Public License for more details.
You should have received a copy of the GNU {kind} Public License along with this {what}{end}"""
_SITE = ". If not, see <https://www.gnu.org/licenses/>."
_POST = "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."


def _gnu(what: str, kind: str, version: str, end: str) -> str:
    return _GNU.format(what=what, kind=kind, version=version, end=end, colon=":" if end is _SITE else ";", comma="," if end is _SITE else ";")


TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License.""",
    "BSD notice": "Released under the BSD License.",
    "BSD-2-Clause": _BSD + _BSD_AS_IS,
    "BSD-3-Clause": _BSD + _BSD_NAME.format(3) + _BSD_AS_IS,
    "BSD-4-Clause": f"""{_BSD} 3. All advertising materials mentioning features or use of this software must display the following
acknowledgement: This product includes software developed by the organization.{_BSD_NAME.format(4)}{_BSD_AS_IS}""",
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0 header": _gnu("program", "General", "2", _POST),
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": _gnu("program", "General", "3", _SITE),
    "LGPL-2.1 notice": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-2.1 header": _gnu("library", "Lesser General", "2.1", _POST),
    "LGPL-3.0 notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-3.0 header": _gnu("program", "Lesser General", "3", _SITE),
    "AGPL-3.0 notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0 header": _gnu("program", "Affero General", "3", _SITE),
    "0BSD": _ISC + _ISC_AS_IS,
    "ISC": _ISC + _ISC_KEEP + _ISC_AS_IS,
    "MIT notice": "Released under the MIT License.",
    "MIT": _MIT + _MIT_KEEP + _MIT_AS_IS.format("AUTHORS OR COPYRIGHT HOLDERS"),
    "MIT-0": _MIT + "." + _MIT_AS_IS.format("AUTHORS OR COPYRIGHT HOLDERS"),
    "X11": f"""{_MIT}{_MIT_KEEP}{_MIT_AS_IS.format("X CONSORTIUM")} Except as contained in this notice, the name of the X Consortium shall not be
used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written
authorization from the X Consortium.""",
    "MPL-2.0 header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
}

#: What the words of a match must hold, besides coverage: patterns over words joined by spaces.
_END = r"\b(?! [1-9]\b)"
_GNU_NAMES = {"GPL": "gnu general public license", "LGPL": "gnu lesser general public license", "AGPL": "gnu affero general public license"}
DECIDING = {
    "Apache-2.0 notice": (rf"\bapache license (?:version )?v?2(?: 0)?{_END}",),
    "Apache-2.0 header": (rf"\bapache license (?:version )?v?2(?: 0)?{_END}",),
    "BSD notice": (r"\bbsd license\b",),
    "MIT notice": (r"\bmit license\b",),
    "MPL-2.0 header": (rf"\bmozilla public license (?:version |v )?v?2(?: 0)?{_END}",),
}
for _name in TEMPLATES:
    _family, _, _rest = _name.partition("-")
    if _family in _GNU_NAMES:
        _version = "2 1" if _rest.startswith("2.1") else _rest[0] + "(?: 0)?"
        if _name.endswith("notice"):
            DECIDING[_name] = (rf"\b{_GNU_NAMES[_family]} (?:version )?v?{_version}{_END}",)
        else:
            DECIDING[_name] = rf"\b{_GNU_NAMES[_family]}\b", rf"\bversion {_version}{_END}"
for _marks in ((), ("NC",), ("SA",), ("ND",), ("NC", "SA"), ("NC", "ND")):
    _name = "-".join(("CC-BY", *_marks, "4.0"))
    _spelled = {"NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives"}
    _long = f"This work is licensed under a Creative Commons {'-'.join(('Attribution', *(_spelled[m] for m in _marks)))} 4.0 International License."
    _short = f"Licensed under CC {'-'.join(('BY', *_marks))} 4.0."
    # "notice" is the long form of CC-BY and the short form of CC-BY-NC, as ever; the other form has a name of its own
    TEMPLATES[f"{_name} notice"], TEMPLATES[f"{_name} {'long' if _marks == ('NC',) else 'short'} notice"] = (_short, _long) if _marks == ("NC",) else (_long, _short)
    _by = " ".join(("cc by", *(m.lower() for m in _marks)))
    _full = " ".join(("attribution", *({"NC": "non ?commercial", "SA": "share ?alike", "ND": "no ?deriv(?:ative)?s"}[m] for m in _marks)))
    _found = (rf"\b(?:{_full}(?: {_by})?|{_by})(?: license| version)* 4(?: 0)?{_END}",)
    DECIDING |= {name: _found for name in TEMPLATES if name.startswith(f"{_name} ")}


def words(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matching positions of two word lists, rising in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        once_a, once_b = Counter(a[i:j]), Counter(b[k:m])
        place = {w: p for p, w in enumerate(b[k:m], k) if once_b[w] == 1}
        anchors = _rising([(p, place[w]) for p, w in enumerate(a[i:j], i) if once_a[w] == 1 and w in place])
        if anchors:
            out += anchors
            ends = [(i - 1, k - 1), *anchors, (j, m)]
            todo += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(ends, ends[1:], strict=False)]
        else:
            out += [(i + p, k + q) for p, q in _longest(a[i:j], b[k:m])]
    return sorted(out)


def _longest(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence, the last one in a; one bit for each word of b."""
    places: dict[str, int] = {}
    for q, w in enumerate(b):
        places[w] = places.get(w, 0) | 1 << q
    full = (1 << len(b)) - 1
    rows = [full]  # bit q of row p is 0 where b[q] makes the subsequence of a[:p] and b[: q + 1] longer
    for w in a:
        v = rows[-1]
        u = v & places.get(w, 0)
        rows.append((v + u | v - u) & full)
    out = []
    p, q = len(a), len(b) - 1
    while p and q >= 0:
        if rows[p] >> q & 1:
            q -= 1
        elif not rows[p - 1] >> q & 1:
            p -= 1
        else:
            p -= 1
            out.append((p, q))
            q -= 1
    return out[::-1]


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence whose second entries rise, by patience piles."""
    tops: list[int] = []
    last: list[int] = []
    before: list[int] = []
    for n, (_, q) in enumerate(pairs):
        pile = bisect_left(tops, q)
        before.append(last[pile - 1] if pile else -1)
        tops[pile : pile + 1] = [q]
        last[pile : pile + 1] = [n]
    out = []
    n = last[-1] if last else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def dense(pairs: list[tuple[int, int]], need: float) -> tuple[int, int, int] | None:
    """(matching words, begin, end) of pairs that make up half of their span, less stray ones at the ends; None below need."""
    i, j = 0, len(pairs)
    while j - i >= max(need, 1):
        if 2 * (j - i) >= pairs[j - 1][0] + 1 - pairs[i][0]:
            return j - i, pairs[i][0], pairs[j - 1][0] + 1
        if j - i > 1 and pairs[i + 1][0] - pairs[i][0] > pairs[j - 1][0] - pairs[j - 2][0]:
            i += 1
        else:
            j -= 1
    return None


class Scanner:
    """Finds templates in word lists."""

    def __init__(self, templates: dict[str, str], coverage: float):
        self.coverage = coverage
        self.templates = [(name, words(text)) for name, text in sorted(templates.items())]
        self.deciding = [[re.compile(p) for p in DECIDING.get(name, ())] if TEMPLATES.get(name) == text else [] for name, text in sorted(templates.items())]
        seen = Counter(w for _, t in self.templates for w in set(t))
        self.counts = [Counter(t) for _, t in self.templates]
        self.keys = [self._keys(n, seen) for n in range(len(self.templates))]
        self.all = frozenset(seen)

    def _keys(self, n: int, seen: Counter) -> dict[str, list[int]]:
        """The places of the template's rarest words (in the fewest templates, then the longest), so many that a match has one of them."""
        template = self.templates[n][1]
        left = len(template) - self.coverage * len(template)
        keys: dict[str, list[int]] = {}
        for w in sorted(self.counts[n], key=lambda w: (seen[w], -len(w), w)):
            keys[w] = [q for q, v in enumerate(template) if v == w]
            left -= len(keys[w])
            if left < -1e-9:
                break
        return keys

    def __call__(self, text: str) -> list[tuple[str, float, int, int, int]]:
        """(template, coverage, first word, end word, template words) of each template's best match, best first."""
        have = words(text)
        shared = self.all.intersection(have)
        matches: list[tuple[float, int, int, int, int]] = []
        for n, (_, template) in enumerate(self.templates):
            need = self.coverage * len(template) - 1e-9
            if sum(c for w, c in self.counts[n].items() if w in shared) < need:
                continue
            met = set()
            for begin, end in self.windows(have, n, need):
                span = dense(align(have[begin:end], template), need)
                if span:
                    count, first, last = span
                    met.add((count / (len(template) + last - first - count), count, begin + first, begin + last, n))
            matches += [m for m in met if self.decided(have, *m[2:])]
        best: dict[int, tuple[float, int, int, int, int]] = {}
        unnamed: list[tuple[float, int, int, int, int]] = []
        for match in sorted(matches, key=lambda m: (-m[0], -m[1], m[2:])):
            _, _, begin, end, n = match
            if not self.deciding[n]:
                if any(m[4] != n and 2 * (min(end, m[3]) - max(begin, m[2])) > max(end - begin, m[3] - m[2]) for m in unnamed):
                    continue
                unnamed.append(match)
            best.setdefault(n, match)
        found = [(self.templates[n][0], count / len(self.templates[n][1]), begin, end, len(self.templates[n][1])) for _, count, begin, end, n in best.values()]
        return sorted(found, key=lambda f: (-f[1], -f[4], f[0]))

    def decided(self, have: list[str], begin: int, end: int, n: int) -> bool:
        """Whether the deciding words of the template begin in the span; up to three words after it are looked at."""
        span, after = " ".join(have[begin:end]), " ".join(["", *have[end : end + 3]])
        return all((m := p.search(span + after)) is not None and m.start() < len(span) for p in self.deciding[n])

    def windows(self, have: list[str], n: int, need: float) -> list[tuple[int, int]]:
        """Stretches of the text with enough of the template's words: around each key word, and the whole text."""
        keys, own, size = self.keys[n], self.counts[n], len(self.templates[n][1])
        slack = size // 4 + 1
        out = {(0, len(have))}
        for at, w in enumerate(have):
            for q in keys.get(w, ()):
                out.add((max(at - q - slack, 0), min(at - q + size + slack, len(have))))
                out.add((max(at - 2 * size, 0), min(at + 2 * size, len(have))))
        return [(b, e) for b, e in sorted(out) if sum(min(c, own[w]) for w, c in Counter(have[b:e]).items() if w in own) >= need]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, license: the best template or null, coverage, start, end: its words in the text, licenses: all, as name=coverage)."""
    chosen = templates if templates is not None else TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen, coverage)
        for b in batches:
            rows = [scanner(t.as_py() or "") for t in b.column(1)]
            first = [r[0] if r else (None, 0.0, None, None) for r in rows]
            columns = [pa.array([f[k] for f in first], t) for k, t in enumerate((pa.string(), pa.float64(), pa.int64(), pa.int64()))]
            every = pa.array(["; ".join(f"{name}={share:.4f}" for name, share, *_ in r) for r in rows], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *columns, every], [id_col, "license", "coverage", "start", "end", "licenses"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"`{id_col}` {kind}, license string, coverage double, start long, end long, licenses string")
