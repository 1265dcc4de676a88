"""License scans: whole notices wherever they stand."""

import pytest

from strandex.llm import licenses

PROSE = "So if one of you was on an even share of rights, you will do as you shall later, and your rights permit 1 thing: so do it, if it was so."


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_notice_after_prose(name):
    scanner, notice = licenses.Scanner(licenses.TEMPLATES, 0.8), licenses.TEMPLATES[name]
    size = len(licenses.words(notice))
    for before, after in ((PROSE, ""), (PROSE * 3, PROSE), (" ".join(licenses.words(notice)[::-1]), PROSE), (notice, notice)):
        found = {f[0]: f[1:] for f in scanner(f"{before}\n{notice}\n{after}")}
        at = 0 if before == notice else len(licenses.words(before))
        assert found[name] == (1, at, at + size, size)


def test_longest_common_subsequence():
    assert licenses.align("x b a b a y".split(), "p a b a b q".split()) in ([(1, 2), (2, 3), (3, 4)], [(2, 1), (3, 2), (4, 3)])


def names(text):
    return [f[0] for f in licenses.Scanner(licenses.TEMPLATES, 0.8)(f"{PROSE}\n{text}\n{PROSE}")]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Released under the BSD License.", ["BSD notice"]),
        ("Released under the Zlib License.", []),
        ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0 notice"]),
        ("This work is licensed under the GNU General Public License v3.", ["GPL-3.0 notice"]),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0 notice"]),
        ("Licensed under CC BY 4.0.", ["CC-BY-4.0 short notice"]),
        ("Licensed under CC BY-NC-SA 4.0.", ["CC-BY-NC-SA-4.0 short notice"]),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ["CC-BY-NC-4.0 long notice"]),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 International License.", []),
        ("Licensed under the Apache License, Version 1.1.", []),
        ("Released at last under a law that the council of MIT made for its new License.", []),
        *((licenses.TEMPLATES[name], [name]) for name in ("BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "0BSD", "ISC", "MIT", "MIT-0", "X11", "GPL-2.0 header", "GPL-3.0 header", "LGPL-2.1 header", "LGPL-3.0 header", "AGPL-3.0 header")),
        (licenses.TEMPLATES["BSD-2-Clause"] + PROSE * 5 + licenses.TEMPLATES["BSD-3-Clause"], ["BSD-3-Clause", "BSD-2-Clause"]),
        ("Released under the MIT License or the BSD License.", ["BSD notice", "MIT notice"]),
    ],
)
def test_deciding_words_and_better_fit(text, want):
    assert names(text) == want
