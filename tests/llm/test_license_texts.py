import pytest

from gradus.llm import license_scan as L
from tests.llm.test_license_scan import numbers

T = L.Templates(L.TEMPLATES)


def named(text):
    return {r[0].split()[0] for r in L.scan(numbers(text, T), T)}


@pytest.mark.parametrize("name", [n for n in L.TEMPLATES if "notice" not in n])
def test_a_whole_text_or_header_is_itself_alone(name):
    assert [r[0] for r in L.scan(numbers(f"thou {L.TEMPLATES[name]} erin", T), T)] == [name]


def test_two_licenses_in_one_document_are_both_told():
    both = f"{L.TEMPLATES['BSD-3-Clause']} thand {L.TEMPLATES['BSD-3-Clause']} {'thou ' * 500} {L.TEMPLATES['BSD-2-Clause']}"
    assert [r[0] for r in L.scan(numbers(both, T), T)] == ["BSD-2-Clause", "BSD-3-Clause"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Licensed under the MIT License.", "MIT"), ("Licensed under CC BY 4.0.", "CC-BY-4.0"), ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
        ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"), ("This work is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0"), ("SPDX-License-Identifier: AGPL-3.0", "AGPL-3.0"),
    ],
)
def test_notices(text, want):
    assert named(f"thou {text} erin") == {want}


@pytest.mark.parametrize("name", ["Apache-2.0", "BSL-1.0", "GPL-3.0", "Unlicense", "Zlib", "MPL-2.0"])
def test_half_a_text_is_not_the_text(name):
    half = L.TEMPLATES[name].split()
    assert name not in [r[0] for r in L.scan(numbers(" ".join(half[: len(half) // 2]), T), T)]
