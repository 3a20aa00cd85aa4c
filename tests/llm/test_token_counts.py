import numpy as np
import pytest
import sentencepiece

from ordergauge.llm import queries, token_counts
from ordergauge.llm.queries import MODEL
from tests.llm.support import SF_DIR, plain, stored


def lengths(tokens, separator=2):
    """(n_tokens, ended) of each document of one flat list."""
    out, n = [], 0
    for t in tokens:
        if t == separator:
            out.append((n, True))
            n = 0
        else:
            n += 1
    return out + ([(n, False)] if n else [])


@pytest.mark.parametrize("block", [1, 3, 7, 1 << 10])
def test_raw_files_in_any_blocks(spark, tmp_path, block):
    draw = np.random.default_rng(block)
    files = [draw.integers(0, 9, n) for n in (0, 1, 50, 333)] + [np.full(20, 2), np.full(20, 3), np.array([2, 5])]
    for i, tokens in enumerate(files):
        (tmp_path / f"{i}.bin").write_bytes(tokens.astype("<u2").tobytes())
    found = token_counts.separator_scan(token_counts.read_token_files(spark, str(tmp_path), block=block), 2).collect()
    by = {}
    for r in found:
        by.setdefault(r.file, []).append((r.place, r.n_tokens, r.ended, r.start))
    got = []
    for rows in by.values():
        rows.sort()
        assert [r[0] for r in rows] == list(range(len(rows)))
        starts = [0, *np.cumsum([r[1] + 1 for r in rows])[:-1].tolist()]
        assert [r[3] for r in rows] == starts
        got.append([r[1:3] for r in rows])
    assert sorted(got) == sorted(x for x in (lengths(t.tolist()) for t in files) if x)


def test_query_on_the_stored_table(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = queries.tokens(spark, SF_DIR).select("doc_id", "n_tokens").collect()
    assert plain(got) == plain((r[0], len(library.encode(r[1]))) for r in stored(spark))


@pytest.mark.parametrize(("width", "block"), [(2, 5), (4, 1 << 16)])
def test_troubled_documents(spark, width, block):
    rows = [(1, [5, 6, 7], "x"), (None, [1] * 23, "x"), (3, [], "x"), (4, None, "x"), (1, [5, 6, 7], "x"), (5, [65535], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, ids array<int>, tokens string").repartition(2)
    blocks = token_counts.token_blocks(docs, 2, width, block)
    got = token_counts.separator_scan(token_counts.stored(blocks), 2, width)
    assert plain((r.doc_id, r.n_tokens) for r in got.collect()) == plain((r[0], len(r[1] or ())) for r in rows)
    empty = token_counts.token_blocks(docs.where("false"), 2, width, block)
    assert token_counts.separator_scan(empty, 2, width).count() == 0


@pytest.mark.parametrize("bad", [2, 65536, -1])
def test_tokens_that_cannot_be_stored(spark, bad):
    docs = spark.createDataFrame([(1, [5, bad])], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="cannot be stored"):
        token_counts.token_blocks(docs, 2).collect()
