import random
import zlib
from collections import Counter

import pytest

from mmsearch.llm.queries import op11_spelling_variants
from mmsearch.llm.spelling_variants import count_words, letter_runs, rotations, spelling_variants


def near(a, b):
    """Exactly one inserted, deleted or replaced code point apart."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=5):
    forms, out = {}, {}
    for w, n in counts.items():
        found = [v for v in counts if v != w and near(v, w)]
        best = min(found, key=lambda v: (-counts[v], v)) if found else None
        forms[w] = best if best is not None and counts[best] >= ratio * n else None
        out[w] = [n, len(found), forms[w], counts[forms[w]] if forms[w] else None]
    for w in counts:
        root = w
        while forms[root]:
            root = forms[root]
        out[w].append(root)
    return sorted((w, *x) for w, x in out.items())


def collected(df):
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect())


@pytest.mark.parametrize("ratio", [2, 5])
def test_matches_brute_force(spark, ratio):
    rng = random.Random(ratio)
    words = {"".join(rng.choice("aabé") for _ in range(rng.randint(1, 6))) for _ in range(300)} | {"aaaaaa", "aaaaa", "aaaaaaa", "ÿ", "àb", "àbb"}
    counts = {w: rng.choice([1, 1, 2, 5, 5, 25, 130, 700, 4000]) for w in words}
    rows = [(w, n, "k", 1.0) for w, n in counts.items()]
    docs = spark.createDataFrame(rows, "word string, n long, key string, size double").repartition(3)
    assert collected(spelling_variants(docs, ratio)) == brute(counts, ratio)


def test_every_rotation_is_filed_whole_and_without_its_last_letter(spark):
    rows = sorted((r.key, r.skipped) for r in rotations(spark.createDataFrame([("ab", 1)], "word string, n long")).collect())
    assert rows == sorted([("ab$", ""), ("b$a", ""), ("$ab", ""), ("b$", "a"), ("$a", "b")])


def test_long_chains_reach_their_root(spark):
    counts = {"a" * (k + 1): 5**k for k in range(1, 13)}
    got = {r.word: r.root for r in spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert set(got.values()) == {"a" * 13}


def test_a_whole_alphabet_at_one_place(spark):
    letters = [chr(c) for c in [*range(97, 123), *range(0xC0, 0x100)]]
    counts = {f"spell{c}ing": 5 + k for k, c in enumerate(letters)} | {"spelling": 4000}
    assert collected(spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long"))) == brute(counts)


def test_letter_runs_and_counts(spark):
    docs = spark.createDataFrame([(1, "Straße ÉTÉ-été x1y don't"), (2, None), (None, "Été"), (3, "")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.run) for r in letter_runs(docs).collect()) == sorted(
        [(1, "straße"), (1, "ÉtÉ"), (1, "été"), (1, "x"), (1, "y"), (1, "don"), (1, "t"), (0, "Été")]
    )
    words = spark.createDataFrame([("aa",)] * 3 + [("bbb",)] * 2 + [("ccc",)] * 3 + [(None,)], "word string")
    assert [tuple(r) for r in count_words(words, shortest=3, least=3).collect()] == [("ccc", 3)]


def test_query_matches_brute_force_on_texts(spark, tmp_path):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(5, 9))) for _ in range(40)]
    docs = [(i, rng.choice([" ", "\n", "-"]).join(rng.choice(base).title() if rng.random() < 0.3 else rng.choice(base) for _ in range(rng.randint(0, 60)))) for i in range(400)]
    docs += [(1000, None), (1001, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    counts = Counter()
    for i, t in docs:
        run = ""
        for c in (t or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
            elif run:
                h = zlib.crc32(f"{i}:{run}".encode())
                counts[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
                run = ""
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    assert collected(op11_spelling_variants(spark, str(tmp_path))) == brute(counts)


def test_edge_tables(spark):
    words = spark.createDataFrame([(None, 3), ("", 4), ("ok", None), ("no$", 5), ("fine", 1)], "word string, n long")
    assert collected(spelling_variants(words)) == [("fine", 1, 0, None, None, "fine")]
    assert spelling_variants(words.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling_variants(words, ratio=1)
