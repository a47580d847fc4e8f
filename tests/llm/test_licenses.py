import pytest

from tributary.llm import licenses


@pytest.fixture(scope="module")
def scanner():
    return licenses.Scanner(licenses.templates_of())


def found(scanner, text):
    return [x[2] for x in scanner.scan(text)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Released under the BSD License.", ["BSD"]),
        ("Licensed under the Apache License, Version 1.1.", ["Apache-1.1"]),
        ("Licensed under CC BY-NC 2.0.", ["CC-BY-NC-2.0"]),
        ("Licensed under CC BY-NC 2.5.", []),
        ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]),
        ("This work is licensed under the GNU General Public License, version 4.", []),
        ("Licensed under the GNU General Public License, version 3 or later.", ["GPL-3.0-or-later"]),
        ("Licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0"]),
        ("Copyright notice and this permission notice", []),
        ("This is not released under the MIT License.", []),
        ("Some text.\nReleased under the MIT License.\nMore.", ["MIT"]),
        ("Licensed under the Apache License, Version 2.0. All rights reserved.", ["Apache-2.0", "all-rights-reserved"]),
        ("# SPDX-License-Identifier: MIT\nimport os", ["MIT"]),
        ("SPDX-License-Identifier: GPL-2.0-or-later", ["GPL-2.0-or-later"]),
        ("The driving license of the king was lost.", []),
        ("license", []),
        ("", []),
    ],
)
def test_wordings(scanner, text, want):
    assert found(scanner, text) == want


def test_every_form_is_its_own_license_and_wrapped_too(scanner):
    """Recall 1 on all forms alone, hard-wrapped in a text and with comment signs; precision 1 on forms with another number or name."""
    for own, text in licenses.templates_of().values():
        assert found(scanner, text) == [own], text
        words, lines = text.split(), []
        while words:
            lines.append(" * " + " ".join(words[:9]))
            words = words[9:]
        got = scanner.scan("Some prose before it.\nMore of it.\n\n" + "\n".join(lines) + "\n\nProse behind.")
        assert [x[2] for x in got] == [own], text
        assert not any(x.isdigit() for x in text) or own not in found(scanner, "".join(chr(ord(c) + 1) if c in "1234" else c for c in text)), text
        for a, b in (("GNU", "FOO"), ("Apache", "Acme"), ("Mozilla", "Godzilla"), ("CC ", "CX "), ("MIT ", "TIM "), ("Lesser", "Greater"), ("Commons", "Houses")):
            if a in text:
                assert own not in found(scanner, text.replace(a, b)), text


def test_small_edits_of_long_texts_are_reported(scanner):
    text = licenses.TEXTS["ISC"][0].replace("this software", "this program")
    (a, b, own, form, gain, covered, said, block), = scanner.scan(f"See below.\n{text}\n")
    assert (own, form, said) == ("ISC", "text0", "-software +program") and 0.9 < covered < 1 and gain > 0.3 and block in text


def test_tables(spark):
    rows = [(1, "Released under the MIT License", "a"), (1, "Released under the MIT License", "a"), (2, None, "b"), (3, "", "c"), (None, "All rights reserved.", "d"), (5, "license " * 9000 + "Licensed under CC BY 4.0.", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, block string")
    got = sorted((r.doc_id or 0, r.license, r.block) for r in licenses.scan(df).collect())
    assert got == [(0, "all-rights-reserved", "All rights reserved"), (1, "MIT", "under the MIT License"), (1, "MIT", "under the MIT License"), (5, "CC-BY-4.0", "Licensed under CC BY 4.0")]
    assert licenses.scan(df.limit(0)).count() == 0
