import random
import string
from collections import Counter

import numpy as np
import pytest

from ordergauge.llm import decision_list, queries
from ordergauge.llm.decision_list import STATISTICS, Condition
from tests.llm.support import SF_DIR, frame, plain, stored, troubled

SPACE = " \t\n\x0b\x0c\r"


def words_of(text):
    return [w.decode() for w in (text or "").encode().split()]


def counts(text):
    words = words_of(text)
    lines, seen, repeated = (text or "").split("\n"), set(), 0
    for line in lines:
        if line.strip(SPACE):
            repeated += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered |= {i, i + 1, i + 2}
    symbols = sum(c in "#*$%&|<>" for w in words for c in w)
    return len(words), sum(map(len, words)), symbols, repeated, len(covered)


def ratios(text):
    words = words_of(text)
    if not words:
        return [0.0] * 7
    n, chars, symbols, dups, repeated = counts(text)
    joined = "".join(words)
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return [
        chars / n, symbols / chars, sum(c in string.punctuation for c in joined) / chars,
        sum(c in string.ascii_uppercase for c in joined) / chars, dups / len(lines), repeated / n, len(set(words)) / n,
    ]


def judge(row, rules):
    n, *_, repeated = counts(row[1])
    failed = n < 50 or 100 * repeated > 50 * n
    values = np.array([[n, *ratios(row[1])]], dtype=float)
    number = next((i + 1 for i, rule in enumerate(rules) if all(c.holds(values)[0] for c in rule)), None)
    return (*counts(row[1]), failed, not failed and number is None, number)


def test_query_on_the_stored_table(spark):
    docs = queries.table(spark, SF_DIR, "documents")
    rules = decision_list.fit(docs, queries.table(spark, SF_DIR, "labels"))
    got = queries.quality(spark, SF_DIR).collect()
    assert plain(got) == plain((r[0], *judge(r, rules)) for r in stored(spark))


def test_troubled_documents(spark):
    rows = troubled()
    rules = [(Condition("mark_share", True, 0.01), Condition("n_words", False, 40.5)), (Condition("upper_share", True, 0.05),)]
    found = decision_list.judged(frame(spark, rows, clashes=True), rules)
    assert "fingerprint" in found.columns and found.columns.count("n_words") == 1
    got = found.select("doc_id", *decision_list.COUNTS, "base_failed", "kept", "failed_rule").collect()
    assert plain(got) == plain((r[0], *judge(r, rules)) for r in rows)
    assert decision_list.judged(frame(spark, []), rules).count() == 0


def test_fit_without_usable_labels(spark):
    docs = frame(spark, troubled())
    kinds = "doc_id long, quality int, toxic int"
    for labels in ([], [(None, 0, 0), (1, None, 0), (9999, 0, 0)], [(1, 1, 0), (1, 1, 0)]):
        assert decision_list.fit(docs, spark.createDataFrame(labels, kinds)) == []


def test_learns_planted_rules():
    draw = np.random.default_rng(1)
    rows = draw.random((4000, len(STATISTICS)))
    symbols, repeats, length = (STATISTICS.index(x) for x in ("symbol_share", "repeat_share", "word_length"))
    junk = (rows[:, symbols] > 0.8) | (rows[:, repeats] > 0.9) & (rows[:, length] <= 0.5)
    rules = decision_list.learn(rows, junk)
    caught = np.zeros(len(rows), bool)
    for rule in rules:
        caught |= decision_list._covers(rule, rows)
    assert len(rules) >= 2
    assert caught[junk].mean() > 0.95 and caught[~junk].mean() < 0.01


def test_noise_gives_no_rules():
    draw = np.random.default_rng(2)
    rows = draw.random((2000, len(STATISTICS)))
    assert decision_list.learn(rows, draw.random(2000) < 0.3) == []


def test_held_out_documents(spark):
    """Learned on half of the labels, the list rejects few good documents of the other half and finds much of the junk."""
    folder = SF_DIR.replace("0.001", "0.1")
    docs, labels = (queries.table(spark, folder, x) for x in ("documents", "labels"))
    rules = decision_list.fit(docs, labels.where("doc_id % 2 = 0"))
    judged = decision_list.judged(docs, rules).join(labels.where("doc_id % 2 = 1"), "doc_id").select("quality", "kept")
    rows = judged.collect()
    good = [r.kept for r in rows if r.quality == 1 and r.kept is not None]
    junk = [r.kept for r in rows if r.quality == 0]
    assert sum(junk) / len(junk) < 0.05
    # most of the good ones that go are too short for the base rule
    assert sum(good) / len(good) > 0.93


@pytest.mark.parametrize("text", ["a " * 7, "a b c a b c", "a b c d", "x", " ", "é É é É é É"])
def test_repeated_windows(text):
    assert decision_list.statistics_of(text.encode())[0] == list(counts(text))


def test_random_texts():
    pick = random.Random(3)
    for _ in range(500):
        text = "".join(pick.choices(["a", "b ", "C\n", "# ", "é ", "|", "\t", "xy z "], k=pick.randrange(1, 40)))
        found = decision_list.statistics_of(text.encode())
        assert found[0] == list(counts(text)) and found[1] == pytest.approx(ratios(text))
