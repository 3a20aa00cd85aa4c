import random
from collections import defaultdict

import numpy as np
import xxhash

from ordergauge.llm import queries, simhash_pivots
from ordergauge.llm.components import components
from tests.llm.support import SF_DIR, frame, plain, stored, troubled


def simhash(text, k=3):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(nodes, linked):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def expected(rows, radius=3):
    prints = [simhash(r[1]) for r in rows]
    distinct = sorted(set(prints))
    pairs = [(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if (a ^ b).bit_count() <= radius]
    of = classes(distinct, pairs)
    ids = defaultdict(list)
    for r, p in zip(rows, prints, strict=True):
        if r[0] is not None:
            ids[of[p]].append(r[0])
    return [(r[0], f"{p:016x}", min(ids[of[p]], default=None)) for r, p in zip(rows, prints, strict=True)]


def test_query_on_the_stored_table(spark):
    got = queries.near_duplicates(spark, SF_DIR).select("doc_id", "fingerprint", "component_id").collect()
    assert plain(got) == plain(expected(stored(spark)))


def test_troubled_documents(spark):
    rows = troubled()
    docs = frame(spark, rows, clashes=True)
    got = simhash_pivots.near_duplicates(docs).withColumn(
        "fingerprint", simhash_pivots.hex_digits(simhash_pivots.F.col("fingerprint"))
    )
    want = expected(rows)
    assert plain(got.select("doc_id", "fingerprint", "component_id").collect()) == plain(want)
    kept = simhash_pivots.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({c for *_, c in want} - {None})
    assert simhash_pivots.near_duplicates(frame(spark, [])).count() == 0
    assert simhash_pivots.representatives(frame(spark, [])).count() == 0


def close(seed, centres, around):
    draw, out = random.Random(seed), set()
    for _ in range(centres):
        at = draw.getrandbits(64)
        out.add(at)
        for _ in range(around):
            x = at
            for b in draw.sample(range(64), draw.randrange(1, 7)):
                x ^= 1 << b
            out.add(x)
    return sorted(out)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def check_links(spark, prints, **how):
    nodes = spark.createDataFrame([(signed(x),) for x in prints], "fingerprint long")
    links = [(r.u % (1 << 64), r.v % (1 << 64)) for r in simhash_pivots.links_within(nodes, **how).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in links)
    pairs = [(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if (a ^ b).bit_count() <= 3]
    assert classes(prints, links) == classes(prints, pairs)
    return links, pairs


def test_links_connect_as_all_pairs_do(spark):
    check_links(spark, close(1, 12, 40))


def test_large_buckets_are_dealt_anew(spark):
    check_links(spark, close(2, 3, 60), most=5)


def test_a_dense_group_gives_no_pairs(spark):
    centre, draw = 0x0F0F1234ABCD5678, random.Random(9)
    prints = sorted({centre ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)) for _ in range(1200)})
    links, pairs = check_links(spark, prints)
    assert len(links) <= 20 * len(prints) < len(pairs)


def test_components_of_chains_stars_and_loops(spark):
    draw = random.Random(3)
    links = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000)]
    links += [(draw.randrange(2000, 2300), draw.randrange(2000, 2300)) for _ in range(220)]
    got = components(spark.createDataFrame(links, "u long, v long"))
    nodes = {x for a, b in links for x in (a, b) if a != b}
    want = {x: r for x, r in classes(nodes, [x for x in links if x[0] != x[1]]).items() if r != x}
    assert {r.u: r.v for r in got.collect()} == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_long_texts_are_counted_in_slices(monkeypatch):
    text = " ".join(str(i % 977) for i in range(5000)).encode()
    whole = simhash_pivots.fingerprint_of(text)
    monkeypatch.setattr(simhash_pivots, "SLICE", 64)
    assert simhash_pivots.fingerprint_of(text) == whole == signed(simhash(text.decode()))


def test_buckets_over_several_batches():
    import pyarrow as pa

    prints = np.array(close(4, 1, 300), dtype=np.uint64)
    rows = [(1, 7, int(x)) for x in prints.view(np.int64)] + [(1, 8, 5), (1, 8, 6), (2, 8, 1)]
    columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
    whole = pa.RecordBatch.from_arrays(columns, ["mask", "key", "fingerprint"])
    run = simhash_pivots._bucket_links(3)
    one = [x for b in run(iter([whole])) for x in b.to_pylist()]
    cut = [x for b in run(whole.slice(i, 17) for i in range(0, len(rows), 17)) for x in b.to_pylist()]
    key = lambda x: (x["u"], x["v"])
    assert sorted(one, key=key) == sorted(cut, key=key)
