"""Licence expressions and notices in any surroundings."""

import random
import time

import pytest

from sparkloom.llm import licenses

TAG = "SPDX-License-Identifier: "


def _labels(text):
    return licenses.Scanner().run(text)[5]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("(MIT OR Apache-2.0) AND GPL-2.0 WITH Classpath-exception-2.0", "(MIT or Apache-2.0) and GPL-2.0 with Classpath-exception-2.0"),
        ("MIT or Apache-2.0 and ISC", "MIT or Apache-2.0 and ISC"), ("(MIT)", "MIT"), ("((MIT or ISC))", "MIT or ISC"), ("MIT AND (Zlib AND ISC)", "MIT and Zlib and ISC"),
        ("MIT. See LICENSE", "MIT"), ("MIT, and so on", "MIT"), ("MIT See LICENSE", "MIT"), ("MIT OR", "MIT"), ("MIT) or ISC", "MIT"), ("MIT AND (Apache", "MIT"), ("MIT */ code", "MIT"), ("MIT -->", "MIT"),
        ("GPL-2.0+ with X with Y", "GPL-2.0+ with X"), ("MIT with (X)", "MIT"), ("(MIT or ISC) with X", "MIT or ISC"), ("MIT\nor ISC", "MIT"),
        ("", ""), ("(MIT", ""), ("and MIT", ""), ("*MIT", ""), ("()", ""), (". MIT", ""),
    ],
)
def test_longest_prefix(text, want):
    assert licenses.rendered(licenses.read_expression(text)) == want


def test_tags_in_prose():
    assert _labels(TAG + "MIT. See LICENSE") == _labels(TAG + "MIT, and so on") == "mit"
    assert licenses.Scanner().run(TAG + "MIT, and so on")[6] == pytest.approx(0.95)


def test_many_alternatives_keep_their_labels():
    text = TAG + "MIT AND " + " AND ".join(f"(Apache-2.0 OR X{i})" for i in range(3000))
    assert _labels(text) == "apache,mit" and licenses.rendered(licenses.read_expression(text, len(TAG))).count("or") == 3000
    assert licenses.read_expression("(" * 50_000 + "MIT" + ")" * 50_000) == ["MIT"]


def test_satisfied_against_all_choices():
    r = random.Random(1)

    def make(depth):
        if depth == 0 or r.random() < 0.3:
            x = r.choice("abcd")
            return x, lambda ok: ok(x)
        (s, f), (t, g), op = make(depth - 1), make(depth - 1), r.choice(["and", "or"])
        return f"({s} {op} {t})", (lambda ok: f(ok) and g(ok)) if op == "and" else (lambda ok: f(ok) or g(ok))

    for _ in range(200):
        text, plain = make(4)
        postfix = licenses.read_expression(text)
        again = licenses.read_expression(licenses.rendered(postfix))
        for k in range(16):
            ok = lambda x, k=k: bool(k >> "abcd".index(x) & 1)
            assert licenses.satisfied(postfix, ok) == licenses.satisfied(again, ok) == plain(ok)
    assert licenses.satisfied(licenses.read_expression("GPL-2.0 with X"), lambda x: x == "GPL-2.0") and not licenses.satisfied([], lambda x: True)


def test_many_tags_in_one_long_text():
    text = (TAG + "MIT or ISC " + "x " * 20) * 20_000
    start = time.process_time()
    _, _, _, _, _, labels, score, expressions = licenses.Scanner().run(text)
    assert labels == "isc,mit" and score == pytest.approx(1) and len(expressions) == 20_000 and time.process_time() - start < 5


def test_notice_phrases_against_a_plain_search():
    r, s = random.Random(3), licenses.Scanner()
    phrases = licenses.BASE | licenses.NOTICES
    words = sorted({w for p in phrases for w in p.split()})
    for _ in range(300):
        text = " ".join(r.choice([r.choice(list(phrases)), r.choice(words)]) for _ in range(15))
        line = f" {text} "
        assert s.run(text)[5] == ",".join(sorted({x for p, x in phrases.items() if f" {p} " in line}))
