import math
import random

import pytest

from mmsearch.llm import mixing


def water(sizes, weights=(1, 2, 3), cap=3):
    w = {s: weights[k % len(weights)] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in capped)
        share = sum(w[s] for s in sizes if s not in capped)
        over = {s for s in sizes if s not in capped and cap * sizes[s] <= w[s] * left / share} if share else set()
        if not over:
            return {s: float(cap * sizes[s]) if s in capped else w[s] * left / share for s in sizes}
        capped |= over


@pytest.mark.parametrize("seed", range(3))
def test_targets_and_takes(spark, seed):
    rng = random.Random(seed)
    sources = ["a", "B", "é", "zz", None, "blank"]
    rows = [(k, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(1, 30))), rng.choices(sources[:5], [50, 1, 3, 9, 2])[0]) for k in range(1500)]
    rows += [(9000, "", "blank"), (9001, None, "blank"), (9002, " \n", "blank")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sizes(docs, seed=seed).collect()
    size = {i: len((t or "").split()) for i, t, _ in rows}
    per: dict = {}
    for i, _, s in rows:
        per[s] = per.get(s, 0) + size[i]
    want = water(per)
    of = {i: s for i, _, s in rows}
    taken: dict = {}
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == per[of[r.doc_id]]
        assert math.isclose(r.target, want[of[r.doc_id]], rel_tol=1e-9, abs_tol=1e-9)
        copies = r.taken // r.size if r.size else 0
        assert r.taken == copies * r.size and copies <= 3
        rate = r.target / r.source_size if r.source_size else 0
        assert r.size == 0 or copies in (math.floor(rate + 1e-12), math.floor(rate) + 1)
        taken[of[r.doc_id]] = taken.get(of[r.doc_id], 0) + r.taken
    for s, words in taken.items():
        assert abs(words - want[s]) <= 0.15 * want[s] + 200
    again = mixing.mix_sizes(docs.repartition(5), seed=seed).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    mixed = mixing.mix(docs, seed=seed)
    assert mixed.columns == docs.columns
    assert sum(len((r.text or "").split()) for r in mixed.collect()) == sum(r.taken for r in got)


def test_edge_tables(spark):
    docs = spark.createDataFrame([(None, "a b", "s", 1), (1, "c", None, 2), (1, "c", None, 2)], "doc_id long, text string, source string, size int")
    assert len(mixing.mix_sizes(docs).collect()) == 3
    assert set(mixing.mix(docs).columns) == set(docs.columns)
    assert mixing.mix_sizes(docs.filter("size > 5")).count() == 0 and mixing.mix(docs.filter("size > 5")).count() == 0
    renamed = docs.withColumnRenamed("size", "__size")
    assert mixing.mix(renamed).columns == renamed.columns and mixing.mix(renamed).count() == mixing.mix(docs).count()


def test_columns_of_any_name_stay(spark):
    rows = [(k, f"some words {k}", "ab"[k % 2], k, "x", k * 2, 1) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __size long, __copies string, `a.b` long, __own0 int")
    got = mixing.mix(docs)
    assert got.columns == docs.columns and {tuple(r) for r in got.collect()} <= set(rows)
    assert got.count() == mixing.mix(docs.select("doc_id", "text", "source")).count() > 0


def test_many_sources_are_ranked_in_ranges(spark, monkeypatch):
    rng = random.Random(5)
    sizes = {f"s{k:04d}": rng.choice([0, 1, 7, 7, rng.randint(1, 10**6)]) for k in range(700)} | {None: 50, "É": 10**7}
    table = spark.createDataFrame([*sizes.items()], "source string, source_size long").repartition(3)
    want = water(sizes)
    for few in (True, False):
        got = mixing.targets(table, few=few).collect()
        assert len(got) == len(sizes)
        for r in got:
            assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9)
    assert mixing.targets(table.filter("source_size < 0"), few=False).count() == 0
    docs = spark.createDataFrame([(k, "a b " * (k % 9), rng.choice(["p", "q", None, "r", "t"])) for k in range(300)], "doc_id long, text string, source string")
    whole = sorted(map(str, mixing.mix_sizes(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 2)
    assert sorted(map(str, mixing.mix_sizes(docs).collect())) == whole
