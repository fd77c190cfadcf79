import pytest

from kerbline.llm import license_scan

from .helpers import documents


def named(spark, texts):
    got = {r["doc_id"]: {m["license"] for m in r["matches"]} for r in license_scan.scan(documents(spark, texts)).collect()}
    return [got[i] for i in range(len(texts))]


def test_versions_and_qualifiers_must_be_the_templates_own(spark):
    cases = [
        ("This work is licensed under the GNU General Public License, version 1.", {"gpl-1.0"}),
        ("This work is licensed under the GNU General Public License, version 2.0.", {"gpl-2.0"}),
        ("This work is licensed under the GNU General Public License, version 4.", set()),
        ("Licensed under the Apache License, Version 1.1.", {"apache-1.1"}),
        ("Licensed under the Apache License, Version 3.0.", set()),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.", {"mpl-1.1"}),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", {"mpl-2.0"}),
        ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", {"cc-by-nd-4.0"}),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License.", {"cc-by-nc-sa-3.0"}),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License.", {"cc-by-4.0"}),
        ("This work is licensed under a Creative Commons Attribution 2.5 International License.", set()),
        ("This library is licensed under the GNU Lesser General Public License, version 2.", set()),
        ("Licensed under CC BY-ND 4.0.", {"cc-by-nd-4.0"}),
        (license_scan._GRANT.format(work="program", stop=";", kind="", mark=";", version="1"), {"gpl-1.0"}),
        (license_scan._GRANT.format(work="library", stop=";", kind="Library ", mark=";", version="2"), {"lgpl-2.0"}),
        (license_scan._GRANT.format(work="library", stop=";", kind="Lesser ", mark=";", version="2.1"), {"lgpl-2.1"}),
        ("Distributed under the Boost Software License, Version 1.0.", {"bsl-1.0"}),
        (license_scan._ISC[0], {"isc"}),
        (license_scan._ISC[0].partition(", provided")[0] + ".", {"0bsd"}),
    ]
    assert named(spark, [t for t, _ in cases]) == [want for _, want in cases]


def test_a_licence_that_is_denied_is_not_named(spark):
    texts = [
        "This work is not licensed under the GNU General Public License, version 2.",
        "This work isn't licensed under the GNU General Public License, version 2.",
        "This work is no longer licensed under the GNU General Public License, version 3.",
        "Not released under the MIT License.",
    ]
    assert named(spark, texts) == [set()] * len(texts)


@pytest.mark.parametrize("name, text", sorted(set(license_scan.TEMPLATES)))
def test_no_template_denies_itself(name, text):
    assert not set(license_scan._plain_bigrams(text)) & set(license_scan._NEGATED)


def test_every_template_is_named_by_its_own_text(spark):
    templates = sorted(set(license_scan.TEMPLATES))
    for (name, _), got in zip(templates, named(spark, [t for _, t in templates])):
        assert any(name in g.split(" or ") for g in got), name
