import hashlib
import random
import re

import pytest

from ordergauge.llm import queries, secret_scan
from tests.llm.support import SF_DIR, frame, plain, stored, troubled

PLAIN = {"hex": rb"[0-9a-f]+"}


def by_expressions(data: bytes, rules=secret_scan.RULES):
    out = []
    for number, rule in enumerate(rules):
        for match in re.finditer(PLAIN.get(rule.kind, rule.pattern), data):
            if len(match[rule.group]) >= rule.least:
                out.append((match.start(), number, match.end()))
    return sorted(out)


PARTS = [
    b"token", b"secret", b"=", b" ", b": ", b'"', b"password", b"pass", b"passwd", b"api_key", b"ApiKey", b"abcdefgh1",
    b"0123456789abcdef", b"AKIA", b"ABCDEFGH1234", b".", b"\n", b"-----BEGIN ", b"PRIVATE KEY-----", b"-", b"RSA ",
    b"eyJ", b"eyJhb", b"ghp_", b"x" * 40, b"xoxb-", b"1234567890", b"sk_live_", "é".encode(), "ſ".encode(), b"'", b"_", b"f" * 33,
]


def test_scanner_agrees_with_expressions():
    scanner, pick = secret_scan.Scanner(secret_scan.compile_rules()), random.Random(3)
    for _ in range(5000):
        data = b"".join(pick.choices(PARTS, k=pick.randint(1, 14)))
        assert scanner.spans(data) == by_expressions(data), data


def test_automaton_is_minimal():
    rules = (secret_scan.Rule("a", b"ab[cd]+"), secret_scan.Rule("b", b"(?i:xy)"))
    automaton = secret_scan.compile_rules(rules)
    # none, a, ab, ab[cd]+, x, xy; and after the match the letter that ends it decides
    assert automaton.states == 6
    assert secret_scan.Scanner(automaton).spans(b"zabcdcXYxabd") == [(1, 0, 6), (6, 1, 8), (9, 0, 12)]


@pytest.mark.parametrize("pattern", [b"a(bc)*", b"x*"])
def test_refused_rules(pattern):
    with pytest.raises(ValueError):
        secret_scan.compile_rules((secret_scan.Rule("bad", pattern),))


def expected(text):
    data = (text or "").encode()
    chars = lambda at: len(data[:at].decode())
    spans = [f"{secret_scan.RULES[r].kind}:{chars(s)}:{chars(e)}" for s, r, e in by_expressions(data)]
    base = [s for s in spans if s.split(":")[0] in ("assign", "access", "hex")]
    counts = [sum(s.startswith(k + ":") for s in base) for k in ("assign", "access", "hex")]
    return (*counts, hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(spans))


def test_query_on_the_stored_table(spark):
    found = queries.secrets(spark, SF_DIR).collect()
    assert plain(found) == plain((r[0], *expected(r[1])) for r in stored(spark))


def test_troubled_documents(spark):
    rows = troubled() + [(900, 'é token = "0123456789abcdef0123456789abcdef" 😀 AKIAABCDEFGH1234', "en", "s", 1)]
    found = secret_scan.scan(frame(spark, rows, clashes=True))
    assert "n_words" in found.columns and found.columns.count("secrets") == 1
    got = [(r.doc_id, r.text, [f"{s.kind}:{s.start}:{s.end}" for s in r.secrets]) for r in found.collect()]
    want = [(r[0], r[1], [x for x in expected(r[1])[-1].split(",") if x]) for r in rows]
    assert plain((a, b, str(c)) for a, b, c in got) == plain((a, b, str(c)) for a, b, c in want)
    assert secret_scan.scan(frame(spark, [])).count() == 0
