import hashlib
import random

import pytest

from mmsearch.llm import patricia_dedup
from mmsearch.llm.patricia_dedup import Owner, Trie, exact_copies, groups

SPACES = " \t\n\x0b\x0c\r"


def brute(rows):
    bare = [(i, t or "", "".join(c for c in t or "" if c not in SPACES)) for i, t in rows]
    best = {}
    size = {}
    for i, t, b in bare:
        order = (-len(t), i is None, i or 0)
        best[b] = min(best.get(b, order), order)
        size[b] = size.get(b, 0) + 1
    out, taken = [], set()
    for i, t, b in bare:
        order = (-len(t), i is None, i or 0)
        out.append((i, None if best[b][1] else best[b][2], size[b], order == best[b] and b not in taken, hashlib.sha256(b.encode()).hexdigest()))
        if order == best[b]:
            taken.add(b)
    return sorted(out, key=repr)


def rows_of(seed, count):
    rng = random.Random(seed)
    stems = ["", "a", "ab", "abc", "naïve", "naïv", "日本", "日本語" * 40, "x" * 3000, "x" * 3000 + "y"]
    rows = []
    for _ in range(count):
        text = rng.choice(stems) + rng.choice(["", "1", "12", "123"])
        rows.append((rng.randrange(-9, 60), "".join(c + rng.choice(["", "", "", " ", "\n", "\x0b", " "[:0]]) for c in text)))
    return rows + [(100, None), (101, ""), (102, " \t"), (None, "null id"), (103, "nullid"), (None, "nullid"), (200, "same text"), (200, "same text"), (200, "same  text"), (7, "ab c"), (8, "abc")]


def collected(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("limit", "many"), [(1 << 20, 1000), (1 << 20, 5), (900, 1000)])
def test_matches_brute_force(spark, monkeypatch, limit, many):
    """At the third setting tries spill subtree by subtree, on both sides of the shuffle, over several rounds."""
    monkeypatch.setattr(patricia_dedup, "MANY", many)
    rows = rows_of(limit + many, 400)
    docs = spark.createDataFrame([(i, t, "d", 3) for i, t in rows], "doc_id long, text string, digest string, rows int").repartition(5)
    assert collected(exact_copies(docs, limit=limit)) == brute(rows)


def test_groups_are_whole_when_tries_spill(spark):
    rows = rows_of(4, 300)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    whole, spilled = (sorted(map(tuple, groups(docs, limit=x, part=1 << 14).collect()), key=repr) for x in (1 << 20, 400))
    assert whole == spilled
    assert len({r[0] for r in whole}) == len(whole)


def test_trie_keeps_every_key_and_its_least_owner():
    rng = random.Random(2)
    keys = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) for _ in range(3000)]
    trie, want = Trie(), {}
    for i, k in enumerate(keys):
        i = rng.randrange(500)
        rank = rng.randrange(3)
        assert trie.insert(k, Owner(1, rank, i, 1))
        n, best, ties = want.get(k, (0, (1, 0), 0))
        order = (-rank, i)
        want[k] = (n + 1, min(best, order), 1 if order < best else ties + (order == best))
    assert {k: (o.rows, (-o.rank, o.id), o.ties) for k, o in trie.items()} == want
    labels = sum(len(n) for n in [x.label for x in _nodes(trie.root)])
    assert labels == trie.bytes < sum(map(len, want))


def _nodes(node):
    yield node
    for x in node.next.values():
        yield from _nodes(x)


def test_spilled_prefixes_stay_closed():
    trie = Trie()
    for k in (b"car", b"cart", b"carton", b"dog", b"do", b"cat" * 50, b"cat" * 60):
        assert trie.insert(k, Owner(1, 0, 1, 1))
    out = dict(trie.spill(True))
    left = dict(trie.items())
    assert out and left and not set(out) & set(left) and len(out) + len(left) == 7
    for k in out:
        assert not trie.insert(k, Owner(1, 0, 1, 1))
    for k in left:
        assert trie.insert(k, Owner(1, 0, 1, 1)) and trie.insert(k + b"!", Owner(1, 0, 1, 1))
    trie = Trie()
    assert trie.insert(b"only", Owner(1, 0, 1, 1)) and [k for k, _ in trie.spill(False)] == [b"only"] and trie.bytes == 0 and trie.spill(False) == []


def test_colliding_hashes_are_told_apart_by_their_bytes(spark, monkeypatch):
    rows = [(1, "abcd"), (2, "abce"), (3, "ab cd"), (4, "abcf")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert collected(exact_copies(docs)) == brute(rows)


def test_empty_table(spark):
    assert exact_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0
