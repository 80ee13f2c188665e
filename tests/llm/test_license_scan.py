"""License scan against a plain search of every rule, and the rules themselves."""

import random
import re

import pytest

from strata.llm import license_rules as R
from strata.llm import license_scan as S

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    """n_words, n_base, first, last, base labels, labels, score, n_kept, n_suppressed: every rule on every text."""
    w = WORD.findall((text or "").translate(LOWER))
    base = [(k, label) for phrase, label in R.BASE.items() for k in range(len(w)) if w[k:k + len(phrase.split())] == phrase.split()]
    line = " " + "  ".join(w) + " "
    found = [(r.priority, r.rule, r.label, line[:m.start()].count(" ") // 2, line[:m.end()].count(" ") // 2)
             for r in R.RULES for m in re.finditer(r.regex, line)]

    def loses(x, y):
        if y[0] < x[0]:
            return y[3] < x[4] and y[4] > x[3]
        return y[0] == x[0] and y[3] <= x[3] and y[4] >= x[4] and (y[4] - y[3] > x[4] - x[3] or y[1] < x[1])

    kept = [x for x in found if not any(loses(x, y) for y in found)]
    score = max([0.0, *(R.CONFIDENCE[x[0]] for x in kept), *(R.CONFIDENCE[4] for _ in base)])
    names = lambda x: ",".join(sorted(set(x)))
    at = [k for k, _ in base]
    return (len(w), len(base), min(at, default=None), max(at, default=None), names(x for _, x in base),
            names([x for _, x in base] + [x[2] for x in kept]), score, len(kept), len(found) - len(kept))


TEXTS = [
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "SPDX-License-Identifier: GPL-2.0-or-later", "MIT License MIT License, mit license", "cc by-sa 4.0; CC BY 4.0! cc by",
    "GNU General Public License, version 3; GNU General Public License v2 or (at your option) GNU Lesser General Public License 2.1",
    "https://creativecommons.org/licenses/by-nc/4.0/ and http://www.gnu.org/licenses/gpl-3.0.html",
    "Neither the name of the University nor the names of its contributors may be used. All rights reserved. Copyright (c) 2019 X",
    "Tous droits réservés, alle Rechte vorbehalten; unlicensed licences mitlicense MIT-Lizenz", "beerware license, beer ware licence: perl artistic license",
    "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 -- The MIT X11 license -- new BSD license, 3-clause BSD license",
]


@pytest.mark.parametrize("pattern, words", [
    ("mit license", ("license", "mit")), ("(?:perl )?artistic licen[cs]e", ("artistic",)), ("gnu gpl (?:version |v )?2(?: 0)?", ("gnu", "gpl", "2")),
    ("beer(?: )?ware licen[cs]e", ()), ("gpl licensed?", ("gpl",)), ("x [^ ]+(?: [^ ]+){0,7} nor", ("nor", "x")),
])
def test_words_that_a_match_must_hold(pattern, words):
    assert R.keywords(pattern) == words


def test_rules_are_gated_and_ordered():
    assert len(R.RULES) > 300 and [r.rule for r in R.RULES] == list(range(len(R.RULES)))
    priorities = [r.priority for r in R.RULES]
    assert priorities == sorted(priorities) and set(priorities) == set(R.CONFIDENCE)
    assert all(r.keywords for r in [*R.RULES, *R.BASE_RULES])
    for r in R.RULES:  # the words of the gate are in what the rule matches
        for t in TEXTS:
            line = " " + "  ".join(WORD.findall(t.translate(LOWER))) + " "
            for m in re.finditer(r.regex, line):
                assert set(r.keywords) <= set(m[0].split())


def rows(spark, data):
    df = spark.createDataFrame([(*d, 1, "s") for d in data], "doc_id long, text string, n_words int, labels string")
    got = S.license_summary(df).collect()
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(map(tuple, got), key=key) == sorted(((i, *plain(t)) for i, t in data), key=key)
    return {r.doc_id: r for r in got}


def test_known_texts(spark):
    r = rows(spark, list(enumerate(TEXTS)))
    assert r[0].labels == "apache,apache-2.0,licensed" and r[0].score == .95
    assert r[1].labels == "gpl-2.0" and r[1].score == 1.0 and r[1].n_base == 0
    assert (r[2].n_base, r[2].first_word, r[2].last_word, r[2].labels) == (3, 0, 4, "mit")
    assert r[3].labels == "cc-by,cc-by-4.0,cc-by-sa-4.0" and r[3].n_base == 3
    assert r[4].labels == "gpl,gpl-2.0,gpl-3.0,lgpl-2.1"
    assert r[5].labels == "cc-by-nc,gpl-3.0" and r[8].labels == "artistic,beerware"


def test_odd_rows(spark):
    long = "word " * 30000 + "MIT license. " * 3000 + "under the Apache license 2.0"
    data = [(1, None), (2, ""), (3, " \n-"), (None, "MIT License"), (None, None), (4, TEXTS[0]), (4, TEXTS[0]), (5, long), (6, "\x01mit\x02license $1 \\0")]
    r = rows(spark, data)
    assert r[5].n_base == 3001 and r[5].first_word == 30000
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.license_summary(df).collect() == []


def test_random_mixtures_of_rules(spark):
    r = random.Random(8)
    parts = sorted({w for x in R.RULES for w in x.keywords}) + ["v2", "2", "0", "the"]
    data = []
    for i in range(60):
        t = []
        for _ in range(r.randint(1, 12)):
            t.append(r.choice(TEXTS + [" ".join(r.sample(parts, 3))] * 4))
            if r.random() < .3:
                t[-1] = " ".join(t[-1].split()[r.randint(0, 3):r.randint(4, 9)])
        data.append((i, " ".join(t)))
    rows(spark, data)


def test_plan_has_no_python_and_shuffles_no_text(spark, docs_dir):
    df = S.op12_license_scan(spark, docs_dir)
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
