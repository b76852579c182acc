import random

import numpy as np
import pytest

from mmsearch.llm.periodic_runs import BASE, PRIMES, _Text, _next_equal, find_runs, intt, ntt, periodic_runs, zero_mismatches


def brute(words, least=24, times=3):
    """{(start, end): period} by comparing every word with every later one."""
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i + q - s >= max(least, times * q):
                found.setdefault((s, i + q), q)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts(seed, count):
    rng = random.Random(seed)
    for _ in range(count):
        words = []
        for _ in range(rng.randint(0, 5)):
            unit = [rng.choice("abcdefgh"[: rng.randint(1, 8)]) for _ in range(rng.choice([1, 2, 3, 5, 8, 15, 16, 17, 31, 40, 65]))]
            part = unit * rng.choice([1, 2, 3, 4, 9])
            words += part[rng.randrange(len(unit)) :][: rng.randint(1, 300)] + [rng.choice(["x", str(rng.random()), "a"])] * rng.randrange(3)
        yield words


@pytest.mark.parametrize(("p", "root"), PRIMES)
def test_transform_and_back_is_exact_convolution(p, root):
    rng = np.random.default_rng(p % 97)
    for size in (1, 2, 8, 64):
        a, b = (rng.integers(0, p, (3, size)).astype(np.uint64) for _ in "ab")
        assert (intt(ntt(a.copy(), p, root), p, root) == a).all()
        product = intt(ntt(a.copy(), p, root) * ntt(b.copy(), p, root) % np.uint64(p), p, root)
        for r in range(3):
            want = [sum(int(a[r, i]) * int(b[r, (k - i) % size]) for i in range(size)) % p for k in range(size)]
            assert product[r].tolist() == want


@pytest.mark.parametrize("largest", [3, 5000, 1 << 24])
def test_zero_mismatches_equal_plain_comparison(largest):
    rng = np.random.default_rng(largest)
    pattern = rng.integers(0, largest + 1, (20, 8)).astype(np.uint64)
    window = rng.integers(0, largest + 1, (20, 22)).astype(np.uint64)
    for r in range(20):
        at = int(rng.integers(0, 15))
        window[r, at : at + 8] = pattern[r]
    got = zero_mismatches(pattern, window, largest)
    assert got.shape == (20, 15)
    for r in range(20):
        assert got[r].tolist() == [(window[r, k : k + 8] == pattern[r]).all() for k in range(15)]


def test_a_multiple_of_one_prime_is_no_match():
    pattern, window = np.zeros((1, 8), np.uint64), np.zeros((1, 22), np.uint64)
    # four squares that sum to the first prime: 31265^2 + 31265^2 + 7602^2 + ... found by search
    p = PRIMES[0][0]
    a = int(p**0.5)
    rest, squares = p - a * a, [a]
    for _ in range(3):
        squares.append(int(rest**0.5))
        rest -= squares[-1] ** 2
    while rest:
        squares.append(int(rest**0.5))
        rest -= squares[-1] ** 2
    window[0, : len(squares)] = squares
    assert len(squares) <= 8 and not zero_mismatches(pattern, window, max(squares))[0, 0]


def test_runs_match_brute_force_over_many_texts():
    for words in texts(5, 250):
        ids = np.unique(np.array(words), return_inverse=True)[1].astype(np.uint64) + np.uint64(1) if words else np.zeros(0, np.uint64)
        found = find_runs(_next_equal(ids), np.array([0]), np.array([len(words)]), lambda r, x=ids: x, 24, 3)
        assert (found[0].spans() if found else []) == brute(words)


def test_query_result_matches_brute_force(spark):
    rows = [(i, random.Random(i).choice([" ", "\n", "\t "]).join(w)) for i, w in enumerate(texts(11, 60))]
    rows += [(900, None), (901, ""), (None, "la " * 30), (902, " \n"), (902, "la " * 23), (903, "la " * 24), (903, "la " * 24), (904, "né du né du " * 9)]
    got = periodic_runs(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, runs string, best int").repartition(3)).collect()
    want = []
    for i, t in rows:
        words = (t or "").split()
        runs = brute(words)
        top = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else None
        want.append((i, len(words), runs, top, collapse(words, runs)))
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.best and tuple(r.best), r.collapsed) for r in got), key=repr) == sorted(want, key=repr)


def test_reordered_words_are_judged(spark):
    docs = spark.createDataFrame([(1, "a b c d " + " ".join(map(str, range(60)))), (2, "x y")], "doc_id long, text string")
    got = {r.doc_id: r for r in periodic_runs(docs, reorder=lambda i, n: np.arange(n) % 4 if i == 1 else None).collect()}
    assert [tuple(x) for x in got[1].runs] == [(0, 64, 4)] and got[1].collapsed == "a b c d"
    assert got[2].runs == [] and got[2].best is None and got[2].collapsed == "x y"


def test_long_texts_of_few_words():
    """Hits that only repeat a known run, or lie between two runs of one period, must not be extended one by one."""
    count = []
    plain = _Text.seed

    class Counted(_Text):
        def news(self, a, size, ds):
            out = super().news(a, size, ds)
            count.append(len(out))
            return out

    ids = np.array(([1] * 999 + [2]) * 30, np.uint64)
    text = Counted(ids, 24, 3)
    for size, low, high in [(BASE, 1, 2 * BASE - 1)] + [(BASE << k, BASE << k, (BASE << k + 1) - 1) for k in range(1, 11)]:
        for a in range(0, len(ids) - size + 1, size):
            ds = np.array([d for d in (low, low + 1, high, 1000, 2000) if low <= d <= high and a + d + size <= len(ids) and (ids[a : a + size] == ids[a + d : a + d + size]).all()], np.int64)
            if len(ds):
                plain(text, a, size, ds)
    assert text.spans() == [*sorted([(k * 1000, 999, 1) for k in range(30)] + [(0, 30000, 1000)], key=lambda r: (r[0], r[2]))]
    assert sum(count) < 600


def test_edge_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periodic_runs(empty).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(empty, least=23)
    with pytest.raises(ValueError):
        periodic_runs(empty, times=2)
