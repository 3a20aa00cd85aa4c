import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordergauge.llm import lm_scoring, queries
from tests.llm.support import SF_DIR, frame, stored, troubled

COLUMNS = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def tokens(text):
    return [*(text or "").encode().lower().split(), "end"]


def held(row):
    return row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 2


def expected(rows):
    """All columns but the model's, from the definitions."""
    counts = Counter(t for r in rows if not held(r) for t in tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    out = []
    for r in rows:
        own = tokens(r[1])
        base = sum(math.log10((counts[t] + 1) / (n + 1 * (v + 1))) for t in own)
        out.append((r[0], held(r), len(own), sum(counts[t] > 0 for t in own), n, base))
    return out


def check(got, rows):
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:5], r[5])
    found = sorted((tuple(r) for r in got), key=key)
    for have, want in zip(found, sorted(expected(rows), key=key), strict=True):
        assert have[:5] == want[:5] and have[5] == pytest.approx(want[5], abs=1e-6)
        assert have[6] < 0 or have[2] == 0


def scored(spark, rows, clashes=False):
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return lm_scoring.scores(frame(spark, rows, clashes), held_out)


def test_query_on_the_stored_table(spark):
    got = queries.language_model(spark, SF_DIR)
    assert got.columns == COLUMNS
    check(got.collect(), stored(spark))


def test_troubled_documents(spark, monkeypatch):
    check(scored(spark, troubled(), clashes=True).collect(), troubled())
    # slices of a few documents, steps of a few tokens, messages added up in several levels
    for name, value in (("SLICE", 300), ("SLICE_ROWS", 7), ("STEP", 64), ("FAN", 2)):
        monkeypatch.setattr(lm_scoring, name, value)
    rows = troubled() + [(7, None, None, None, None)] * 40
    check(scored(spark, rows).collect(), rows)


def test_nothing_to_learn_from(spark):
    assert scored(spark, []).count() == 0
    rows = [r for r in troubled() if held(r)]
    got = scored(spark, rows).collect()
    assert rows and {(r.n_known, r.train_tokens, r.base_score) for r in got} == {(0, 0, 0.0)}
    for r in got:
        assert math.isfinite(r.score)


def trained(rounds=40, size=20_000):
    """A model after steps on a text in which every word says what comes next."""
    draw = np.random.default_rng(2)
    outcomes = np.zeros(size, np.uint16)
    for i in range(1, size):
        outcomes[i] = (outcomes[i - 1] * 7 + 3) % 900 if draw.random() < 0.9 else draw.integers(OUT)
    counts = np.bincount(outcomes, minlength=OUT).astype(float)
    return lm_scoring.Model.untrained(counts, np.ones(OUT)), outcomes


OUT = lm_scoring.OUTCOMES


def test_chances_add_up_to_one():
    model, _ = trained()
    draw = np.random.default_rng(3)
    model.outer += draw.normal(size=model.outer.shape).astype(np.float32)
    model.inner += draw.normal(size=model.inner.shape).astype(np.float32)
    for last, before in ((5, 900), (lm_scoring.START, lm_scoring.START), (OUT - 1, 0)):
        every = np.arange(OUT, dtype=np.uint32)
        context = [np.full(OUT, x, np.uint32) for x in (last, before)]
        kind, place = every // lm_scoring.IN_CLASS, every % lm_scoring.IN_CLASS
        classes, inside = model.chances(*context, kind)
        whole = classes[every, kind].astype(float) * inside[every, place]
        assert whole.sum() == pytest.approx(1, abs=1e-4) and (whole > 0).all()


def test_rooms_add_up_to_one():
    """The shares of an outcome's words, and of one unseen word where there may be one, are 1 together."""
    counts = {0: [40], 1: [7], lm_scoring.FREQUENT: [3, 2, 1], OUT - 1: [1]}
    tokens_of, words = np.zeros(OUT), np.zeros(OUT)
    for outcome, own in counts.items():
        tokens_of[outcome], words[outcome] = sum(own), len(own)
    room = 10 ** lm_scoring.Model.untrained(tokens_of, words).room_log
    for outcome, own in counts.items():
        seen = sum(c + 1 for c in own) / room[outcome]
        assert seen + (outcome >= lm_scoring.FREQUENT) / room[outcome] == pytest.approx(1)


def test_windows_know_where_documents_begin(monkeypatch):
    monkeypatch.setattr(lm_scoring, "STEP", 3)
    docs = [np.array(x, np.uint16) for x in ([5], [1, 2, 3, 4], [9, 8])]
    rows = [tuple(map(int, r)) for w in lm_scoring.windows(docs) for r in zip(*w, strict=True)]
    s = lm_scoring.START
    assert rows == [(0, 5, s, s), (1, 1, s, s), (1, 2, 1, s), (1, 3, 2, 1), (1, 4, 3, 2), (2, 9, s, s), (2, 8, 9, s)]


def test_packed_numbers_come_back():
    numbers = np.array([0, 1, 255, 256, 70_000, 1 << 31], np.uint32)
    assert (lm_scoring.unpacked(lm_scoring.packed(numbers, 4), 4) == numbers).all()
    assert (lm_scoring.unpacked(lm_scoring.packed(numbers[:4], 2), 2) == numbers[:4]).all()


def test_steps_go_down_the_slope():
    """The analytic slope of one token against differences, and what a step does to its loss."""
    model, outcomes = trained()
    one = [np.array([x], np.uint32) for x in (outcomes[7], outcomes[6], outcomes[5])]
    kind = one[0] // lm_scoring.IN_CLASS

    def loss():
        classes, inside = model.chances(one[1], one[2], kind)
        return -math.log(classes[0, kind[0]]) - math.log(inside[0, one[0][0] % lm_scoring.IN_CLASS])

    classes, _ = model.chances(one[1], one[2], kind)
    slope = classes[0].astype(float)
    slope[kind[0]] -= 1
    row, before = lm_scoring.outer_rows(one[1], one[2])[0][0], loss()
    for column in (0, int(kind[0])):
        model.outer[row, column] += 1e-2
        assert (loss() - before) / 1e-2 == pytest.approx(slope[column], abs=0.01)
        model.outer[row, column] -= 1e-2
    used, squares = np.zeros(len(model.outer)), np.full(len(model.outer), 1e-6, np.float32)
    lm_scoring._step(model.outer, squares, used, lm_scoring.outer_rows(one[1], one[2]), slope[None, :].astype(np.float32))
    assert loss() < before and used.sum() == 3


def test_training_beats_the_unigram_model_on_held_out_text(spark):
    """Texts in which each word has a few followers: what the model learns must show on documents it has not seen."""
    draw = random.Random(5)
    names = [f"w{i}" for i in range(300)]
    after = {w: draw.sample(names, 3) for w in names}

    def text():
        word, out = draw.choice(names), []
        for _ in range(120):
            out.append(word)
            word = draw.choice(after[word])
        return " ".join(out)

    rows = [(i, text(), "en", "s", 1) for i in range(400)]
    got = [r for r in scored(spark, rows).collect() if r.held_out]
    model, base = sum(r.score for r in got), sum(r.base_score for r in got)
    # log10 of the 300 words against log10 of their 3 followers: the model must get more than half of the way there
    assert len(got) > 30 and base < model * 1.5
    shuffled = []
    for r in rows:
        words = r[1].split()
        draw.shuffle(words)
        shuffled.append((r[0], " ".join(words) if held(r) else r[1], *r[2:]))
    mixed_up = [r for r in scored(spark, shuffled).collect() if r.held_out]
    assert sum(r.score for r in mixed_up) < model - 0.3 * sum(r.n_tokens for r in got)
    assert sum(r.base_score for r in mixed_up) == pytest.approx(base)


def test_stored_held_out_documents_score_above_the_base(spark):
    got = [r for r in queries.language_model(spark, SF_DIR.replace("0.001", "0.1")).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got) + 0.1 * sum(r.n_tokens for r in got)
