import re

import pytest

from lodemap.llm import licenses

KNOWN = licenses.Templates(licenses.TEMPLATES)


def names(text):
    return [f[0] for f in licenses.find_licenses(text.encode(), KNOWN)]


@pytest.mark.parametrize(
    ("notice", "want"),
    [
        ("This work is licensed under the GNU Affero General Public License, version 3.", ["AGPL-3.0 short"]),
        ("This work is licensed under the GNU Lesser General Public License, version 2.1.", ["LGPL-2.1 short"]),
        ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0 short"]),
        ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0 short"]),
        ("This work is licensed under the GNU General Public License, version 4.", []),
        ("Licensed under CC BY-SA 4.0.", ["CC-BY-SA-4.0 short"]),
        ("Licensed under CC BY-ND 4.0.", ["CC-BY-ND-4.0 short"]),
        ("Licensed under CC BY 4.0.", ["CC-BY-4.0"]),
        ("Licensed under CC BY 1.0.", []),
        ("Licensed under the Apache License, Version 1.1.", []),
        ("Released under the Foo License.", []),
    ],
)
def test_neighbours_are_told_apart(notice, want):
    assert names(f"some words before. {notice} And some behind.") == want


@pytest.mark.parametrize("path", sorted(licenses.TEXTS.glob("*.txt")), ids=lambda p: p.stem)
def test_whole_texts_with_a_changed_word(path):
    text = path.read_text(encoding="utf-8")
    words = list(re.finditer("[A-Za-z0-9]+", text))
    middle = words[len(words) // 2 + 3]
    body = f"before {text[: middle.start()]}{"q" * len(middle[0])}{text[middle.end() :]} behind"
    (found,) = licenses.find_licenses(body.encode(), KNOWN)
    assert found[0] == f"{path.stem} text" and found[2] - found[1] <= 1
    assert body[: found[3]].split() == ["before"] and found[4] >= len("before ") + words[-1].start()


def test_bsd_texts_are_told_apart():
    two, three = (licenses.TEMPLATES[f"BSD-{n}-Clause text"] for n in (2, 3))
    four = three.replace("3. Neither", "3. All advertising materials mentioning features or use of this software must display this. 4. Neither")
    assert names(two) == ["BSD-2-Clause text"] and names(three) == ["BSD-3-Clause text"]
    assert names(two.partition(":")[0]) == ["BSD"] and names(four) == ["BSD"]
