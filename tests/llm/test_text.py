import random
import re

import numpy as np
import pyarrow as pa

from mmsearch.llm.text import Words, chunks, pack, planes, unpack, unplanes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(texts, lower=False, limit=200):
    batch = pa.record_batch([pa.array(texts, pa.string())], ["text"])
    return [(a, b, Words(raw, at, lower)) for a, b, raw, at in chunks(batch, limit=limit)]


def test_words_and_shingles_match_brute_force():
    rng = random.Random(3)
    alphabet = ["a", "B", "é", "日本", " ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\xa0", "zz", "x" * 70, "y" * 70]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(300)] + [None, "", " ", "one"]
    seen: dict = {}
    for a, b, w in words_of(texts, lower=True):
        sets = w.shingle_sets(3)
        for r in range(a, b):
            t = "".join(c.lower() if "A" <= c <= "Z" else c for c in texts[r] or "")
            own = WORD.findall(t)
            assert w.count[r - a] == len(own)
            want = {tuple(own[k : k + 3]) for k in range(max(1, len(own) - 2))} if own else set()
            assert len(sets[r - a]) == len(want)
            seen.setdefault(frozenset(want), set()).add(tuple(sets[r - a].tolist()))
    assert all(len(v) == 1 for v in seen.values())
    assert len({next(iter(v)) for v in seen.values()}) == len(seen)


def test_words_of_one_letter_more_differ():
    (_, _, w), = words_of(["ab a b " + "c" * 64 + " " + "c" * 65 + " " + "c" * 128])
    assert len(set(w.hash.tolist())) == 6


def test_packing_round_trips():
    v = np.sort(np.random.default_rng(1).integers(0, 2**63, 1000, dtype=np.uint64) * np.uint64(2))
    assert (unpack(pack(v)) == v).all() and len(unpack(pack(v[:0]))) == 0
    signed = np.array([-5, -1, 0, 7], np.int64)
    assert unpack(pack(signed.view(np.uint64))).view(np.int64).tolist() == signed.tolist()
    assert unplanes(planes(np.array([3, 1, 2], np.uint32)), np.uint32).tolist() == [3, 1, 2]
