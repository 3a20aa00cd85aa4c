import hashlib
import string
import zlib

import pytest

from ordergauge.llm import merkle_manifest, queries
from tests.llm.support import SF_DIR, frame, plain, stored, troubled

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    doc_id, text, lang, source, n_chars = row
    fields = [None if x is None else str(x) for x in (doc_id, source, lang, n_chars, text)]
    return digest(*("-" if x is None else f"{len(x.encode())}:{x}" for x in fields))


def climb(nodes):
    """The root of a list of digests, and of each the siblings (left, right) level by level."""
    ways, holders = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, held = [], []
        for start in range(0, len(nodes), 16):
            run = nodes[start : start + 16]
            for k in range(len(run)):
                for i in holders[start + k]:
                    ways[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(digest(*run))
            held.append(sum(holders[start : start + 16], []))
        nodes, holders = above, held
    return nodes[0] if nodes else None, ways


def expected(rows):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    kept, subroots = [], []
    for source in sources:
        own = sorted((r for r in rows if r[3] == source), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        subroot, ways = climb([leaf(r) for r in own])
        subroots.append(subroot)
        kept.append((own, ways))
    root, over = climb(subroots)
    out = []
    for (own, ways), subroot, top in zip(kept, subroots, over, strict=True):
        for r, way in zip(own, ways, strict=True):
            way = way + top
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None
            node = leaf((r[0], r[1].translate(LOWER), *r[2:]) if changed else r)
            for a, b in way:
                node = digest(a, node, b)
            proof = digest(*(a + b for a, b in way))
            out.append((r[0], leaf(r), subroot, root, proof, node, node == root))
    return out


def test_query_on_the_stored_table(spark):
    got = queries.manifest(spark, SF_DIR)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    rows = got.collect()
    assert plain(rows) == plain(expected(stored(spark)))
    # every changed text with a capital letter is found out, and nothing else
    texts = {r[0]: r[1] for r in stored(spark)}
    for r in rows:
        changed = zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and texts[r.doc_id] != texts[r.doc_id].translate(LOWER)
        assert r.verified != changed


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_troubled_documents(spark, depth):
    rows = troubled()
    got = merkle_manifest.proofs(frame(spark, rows, clashes=True), depth)
    assert plain(got.collect()) == plain(expected(rows))


def test_several_tiers_and_many_small_sources(spark, monkeypatch):
    monkeypatch.setattr(merkle_manifest, "TOGETHER", 32)
    # a source with a third of all rows, repeated rows, one leaf, runs that end in one node, more than 256 sources
    rows = [(i, f"Text {i}", "en", "hot", i) for i in range(600)] + [(7, "Same", "en", "hot", 1)] * 300
    rows += [(5000 + i, f"Other {i}", None, f"s{i}", None) for i in range(300)]
    rows += [(None, None, None, None, None)] * 17 + [(9000 + i, "Ä", "de", "x" * (1 + i % 2), 1) for i in range(34)]
    for depth in (1, 2):
        assert plain(merkle_manifest.proofs(frame(spark, rows), depth).collect()) == plain(expected(rows))


def test_nothing_and_one_document(spark):
    assert merkle_manifest.proofs(frame(spark, [])).count() == 0
    one = [(0, "A", "en", "s", 1)]
    (row,) = merkle_manifest.proofs(frame(spark, one)).collect()
    assert row.leaf == row.subroot == row.root == leaf(one[0]) and row.proof_sha256 == digest()
