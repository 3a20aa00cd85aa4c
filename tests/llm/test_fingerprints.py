import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from ordergauge.llm import fingerprints, queries
from tests.llm.support import SF_DIR, frame, plain, stored, troubled


def chained(values):
    found = 42
    for v in values:
        found = xxhash.xxh64_intdigest(v.to_bytes(8, "little"), found)
    return found


def simhash(text):
    words = [xxhash.xxh64_intdigest(w, 42) for w in (text or "").encode().lower().split()]
    terms = [chained(words[i : i + 3]) for i in range(len(words) - 2)] or ([chained(words)] if words else [])
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in terms) > len(terms))


def expected(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    prints = [simhash(r[1]) for r in ordered]
    out = []
    for i, r in enumerate(ordered):
        text, following = r[1] or "", ordered[(i + 1) % len(ordered)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        likeness = lambda a, b: 1 - (a ^ b).bit_count() / 64
        asked = r[0] is not None and r[0] % 50 == 0
        near = sum((p ^ prints[i]).bit_count() <= 3 for p in prints) if asked else None
        out.append(
            (
                r[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), f"{prints[i]:016x}", f"{simhash(edited):016x}",
                likeness(prints[i], simhash(edited)), likeness(prints[i], prints[(i + 1) % len(prints)]), near,
            )
        )
    return out


def test_query_on_the_stored_table(spark):
    assert plain(queries.document_fingerprints(spark, SF_DIR).collect()) == plain(expected(stored(spark)))


@pytest.mark.parametrize("buckets", [1, 2, 9, 500])
def test_troubled_documents(spark, buckets, monkeypatch):
    rows = troubled()
    whole = fingerprints.with_next
    monkeypatch.setattr(fingerprints, "with_next", lambda docs, **made: whole(docs, buckets, **made))
    got = fingerprints.edited_fingerprints(frame(spark, rows, clashes=True)).collect()
    assert plain(got) == plain(expected(rows))


def test_few_rows(spark):
    assert fingerprints.edited_fingerprints(frame(spark, [])).count() == 0
    for rows in ([(None, None, None, None, None)], [(50, "one text only", "en", "s", 1)], [(None, "a b c", "", "", 1)] * 3):
        assert plain(fingerprints.edited_fingerprints(frame(spark, rows)).collect()) == plain(expected(rows))


def test_more_terms_than_a_byte_counts(spark):
    texts = ["same word " * 700, " ".join(str(i) for i in range(900)), "a b c " * 43, "a b c " * 42 + "a"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    got = rows.select("text", F.lower(F.hex(fingerprints.simhash(F.col("text")))).alias("h")).collect()
    assert all(int(r.h, 16) == simhash(r.text) for r in got)


def test_tables_find_every_pair_once(spark):
    draw, prints = random.Random(7), set()
    for _ in range(30):
        at = draw.getrandbits(64)
        for _ in range(25):
            x = at
            for b in draw.sample(range(64), draw.randrange(0, 6)):
                x ^= 1 << b
            prints.add(x)
    prints = sorted(prints)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    stored = spark.createDataFrame([(signed(x),) for x in prints], "fingerprint long")
    asked = spark.createDataFrame([(signed(x),) for x in prints[::5]], "fingerprint long")
    for radius, blocks in ((3, 6), (2, 4), (0, 1)):
        got = fingerprints.within_radius(stored, asked, radius, blocks).collect()
        want = [(signed(a), signed(b)) for a in prints[::5] for b in prints if (a ^ b).bit_count() <= radius]
        assert plain(got) == plain(want)


def test_no_python_in_the_plan(spark):
    rows = fingerprints.with_next(frame(spark, troubled()).select("doc_id", "text"))
    plan = rows.select(fingerprints.simhash(F.col("text")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan
