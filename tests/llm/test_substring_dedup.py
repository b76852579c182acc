import hashlib
import random

import pytest

from mmsearch.llm.substring_dedup import remove_repeats


def brute(rows, width):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone |= set(range(k, k + width))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out)


@pytest.mark.parametrize("width", [13, 5, 1])
def test_matches_brute_force(spark, width):
    rng = random.Random(width)
    passages = [[rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(rng.randint(3, 40))] for _ in range(8)]
    rows = []
    for i in rng.sample(range(-20, 500), 60):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += rng.choice(passages)[rng.randrange(3) :] + [str(rng.random())] * rng.randrange(3)
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(words)))
    rows += [(1000, None), (1001, ""), (1002, "same " * 100), (1003, "same " * 50)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), width).collect()
    assert sorted(map(tuple, got)) == brute(rows, width)


def test_edge_rows(spark):
    text = " ".join(map(str, range(2000)))
    docs = spark.createDataFrame([(2, text, 0, "x"), (2, text, 0, "x"), (None, text, 0, "x"), (7, "new " + text, 0, "x")], "doc_id long, text string, part long, hashes string")
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text == text, r.kept_text) for r in remove_repeats(docs).collect()), key=str)
    assert [x[:4] for x in got] == [(2, 2000, 0, True), (2, 2000, 0, True), (7, 2001, 2000, False), (None, 2000, 0, True)]
    assert got[2][4] == "new"
    assert remove_repeats(docs.filter("doc_id > 50")).count() == 0
    with pytest.raises(ValueError):
        remove_repeats(docs, width=5, block=4)
