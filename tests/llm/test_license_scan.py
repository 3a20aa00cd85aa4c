import re
import string

import pytest

from ordergauge.llm import license_scan, queries
from tests.llm.support import SF_DIR, frame, plain, stored, troubled

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text):
    return re.findall(license_scan.WORD, (text or "").translate(LOWER))


def spans(text, templates=license_scan.TEMPLATES):
    """By the definition: hits by comparing words, votes by diagonal, neighbours merged, covered runs counted."""
    own, out = words(text), []
    for t in templates:
        phrase = t.phrase.split()
        runs = len(phrase) - 2
        votes = {}
        for i in range(len(own) - 2):
            for j in range(runs):
                if own[i : i + 3] == phrase[j : j + 3]:
                    votes.setdefault(i - j, []).append((i, j))
        group, last = [], None
        for d in [*sorted(votes), None]:
            if last is not None and (d is None or t.base or d - last > license_scan.SLACK):
                covered = len({j for _, j in group})
                versions = [j for _, j in group if j == runs - 1]
                if covered / runs >= t.coverage and (versions or not t.versioned):
                    starts = [i for i, _ in group]
                    out.append((t.label, t.base, min(starts), max(starts) + 3, covered / runs))
                group = []
            if d is not None:
                group += votes[d]
            last = d
    return out


def expected(text):
    found = spans(text)
    starts = [s for _, base, s, _, _ in found if base]
    return (
        len(words(text)),
        len(starts),
        min(starts, default=None),
        max(starts, default=None),
        ",".join(sorted({x[0] for x in found if x[1]})),
        ",".join(sorted({x[0] for x in found})),
        max((x[4] for x in found), default=0.0),
    )


LICENSED = [
    "Released under the MIT License.",
    "UNDER THE MIT LICENSE under the mit license under the MIT, License",
    "Licensed under the Apache License, Version 2.0. cc-by-nc, cc by nc by nc cc by\nnc",
    "This work is licensed under the GNU General Public License, version 3.",
    "licensed under the old gnu general public license in version 3",
    "Permission is hereby granted, free of charge, to any one person obtaining a copy of this software and associated files",
    "cc by", "under the mit lıcense", "underé the mit license", "CC BY-NC 4.0; Licensed under CC-BY-4.0",
]


def licensed():
    return [(500 + i, t, "en", "s", 1) for i, t in enumerate(LICENSED)]


def test_query_on_the_stored_table(spark):
    got = queries.licenses(spark, SF_DIR).collect()
    assert plain(got) == plain((r[0], *expected(r[1])) for r in stored(spark))
    assert sum(r.n_base for r in got) > 0


def test_troubled_documents(spark):
    rows = troubled() + licensed() + licensed()[:2] + [(None, LICENSED[1], "en", "s", 1)]
    got = license_scan.scan(frame(spark, rows, clashes=True)).collect()
    assert plain(got) == plain((r[0], *expected(r[1])) for r in rows)
    assert license_scan.scan(frame(spark, [])).count() == 0


def test_base_places_are_those_of_the_phrases(spark):
    for row in license_scan.scan(frame(spark, licensed())).collect():
        own = words(LICENSED[row.doc_id - 500])
        phrases = [t.phrase.split() for t in license_scan.BASE_TEMPLATES]
        places = [i for p in phrases for i in range(len(own)) if own[i : i + len(p)] == p]
        assert (row.n_base, row.first_word, row.last_word) == (
            len(places), min(places, default=None), max(places, default=None),
        )


def test_changed_notices_are_found(spark):
    notice = next(t.phrase for t in license_scan.OWN_TEMPLATES if t.label == "unlicense").split()
    texts = [" ".join(notice[:5] + ["quite"] + notice[5:]), " ".join(notice[:4] + notice[5:]), " ".join(notice[:3])]
    rows = [(i, "a b c " + t, "en", "s", 1) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.labels, r.n_base) for r in license_scan.scan(frame(spark, rows)).collect()}
    assert got == {0: ("unlicense", 0), 1: ("unlicense", 0), 2: ("", 0)}


@pytest.mark.parametrize(
    "text, labels",
    [
        ("Licensed under the GNU General Public License, version 1.", ""),
        ("Licensed under the GNU General Public License, version 2.", "gpl-2"),
        ("licensed under the gnu general public license version 2 or (at your option) any later version", "gpl-2"),
        ("Licensed under the GNU General Public License, version 3.", "gpl-3"),
        ("Licensed under the GNU General Public License version", ""),
        ("under the GNU General Public License, version 3.", "gpl-3"),
        ("licensed under the Gnu General public License, Version 2 and licensed under the GNU general public license version 3", "gpl-2,gpl-3"),
        ("Licensed under the GNU Lesser General Public License, version 3", "lgpl-3"),
        ("Licensed under the GNU Lesser General Public License, version 2.1", ""),
        ("Licensed under the GNU Affero General Public License, version 2", ""),
        ("Licensed under the GNU Affero General Public License, version 3", "agpl-3"),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.", ""),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2"),
        ("This code form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2"),
        ("Licensed under the Apache License, Version 2.0", "apache-2"),
        ("Licensed under the Apache License, Version 1.1", ""),
    ],
)
def test_each_version_has_its_own_label(spark, text, labels):
    (row,) = license_scan.scan(frame(spark, [(1, "Some words first. " + text + " And after", "en", "s", 1)])).collect()
    assert row.labels == labels and (row.score > 0) == bool(labels)


def test_templates_need_a_run(spark):
    with pytest.raises(ValueError):
        license_scan.template_runs(spark, (license_scan.Template("x", "two words"),))


def test_templates_beyond_the_bound_are_not_broadcast(spark, monkeypatch):
    rows = licensed()
    monkeypatch.setattr(license_scan, "BROADCAST_RUNS", 0)
    got = license_scan.scan(frame(spark, rows)).collect()
    assert plain(got) == plain((r[0], *expected(r[1])) for r in rows)


def test_no_python_in_the_plan(spark):
    plan = license_scan.scan(frame(spark, licensed()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
