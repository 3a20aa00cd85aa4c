import re
from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from ordergauge.llm import decision_list, queries
from tests.llm import test_decision_list as of_rules
from tests.llm import test_line_dedup as of_lines
from tests.llm import test_mixing as of_mixes
from tests.llm import test_near_copies as of_copies
from tests.llm import test_sentencepiece_codec as of_pieces
from tests.llm.support import SF_DIR, frame, plain, stored, troubled

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module", params=["stored", "troubled", "empty"])
def rows(request, spark):
    return {"stored": stored(spark), "troubled": troubled(), "empty": []}[request.param]


def run(spark, stage, rows, clashes=False):
    docs = frame(spark, rows, clashes)
    out = STAGES[stage](spark, docs, SF_DIR)
    if stage != "sentencepiece":
        assert out.columns == docs.columns
    return out


def test_quality_rules(spark, rows):
    docs = frame(spark, rows)
    rules = decision_list.fit(docs, queries.table(spark, SF_DIR, "labels"))
    want = [r for r in rows if of_rules.judge(r, rules)[-2]]
    assert plain(run(spark, "quality_rules", rows).collect()) == plain(want)


def test_line_dedup(spark, rows):
    texts = of_lines.expected(rows)
    want = [(r[0], t[1], r[2], r[3], len(t[1])) for r, t in zip(rows, texts, strict=True)]
    assert plain(run(spark, "line_dedup", rows).collect()) == plain(want)


def test_near_dedup(spark, rows):
    # a similarity of 0.8 on five-word shingles, by comparing all pairs
    got = run(spark, "near_dedup", rows).collect()
    ids, number = of_copies.expected(rows)
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == ids and len(got) == number
    assert not Counter(map(tuple, got)) - Counter(rows)


def test_mixing(spark, rows):
    got = Counter(map(tuple, run(spark, "mixing", rows).collect()))
    assert set(got) <= set(rows) and max(got.values(), default=0) <= 3 * max(Counter(rows).values(), default=0)
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r[3]] += of_mixes.words(r[1])
    for r, n in got.items():
        taken[r[3]] += n * of_mixes.words(r[1])
    longest = max((of_mixes.words(r[1]) for r in rows), default=0)
    for source, target in of_mixes.targets(sizes).items():
        assert abs(taken[source] - target) <= longest


def test_sentencepiece(spark, rows):
    library = of_pieces.sentencepiece.SentencePieceProcessor(model_file=queries.MODEL)
    got = run(spark, "sentencepiece", rows).collect()
    want = [(r[0], r[2], r[3], str(library.encode(r[1] or ""))) for r in rows]
    assert plain((r.doc_id, r.lang, r.source, str(list(r.ids))) for r in got) == plain(want)
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in got)


@pytest.mark.parametrize("stage", STAGES)
def test_extra_columns(spark, stage):
    assert run(spark, stage, troubled(), clashes=True).count() >= 0


def test_the_whole(spark):
    found = corpus_pipeline.run(spark, SF_DIR)
    assert found.count() > 0 and found.where("not round_trip").count() == 0


def test_registered():
    names = set(entry.queries())
    assert {n for n in names if re.match(r"op\d", n)} == set(queries.queries()) and "pipeline" in names
    assert {int(n[2:].split("_")[0]) for n in queries.queries()} == set(range(1, 14))
