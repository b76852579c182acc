import random

import public_tokenizers
import pytest

from mmsearch.llm import token_counts as tc

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_counts_are_the_librarys(spark, library):
    rng = random.Random(5)
    pieces = ["'s", "'re", "'r", "'ve", "'v", "'ll", "'l", "'", "''", " ", "  ", "\n", "\t", "\r\n", chr(0xA0), chr(0x3000), "a", "The", chr(0xE9), chr(0x663), "1", "12", "!", "<|endoftext|>", "<|", chr(0x65E5), chr(0x1F600), chr(0x1C), chr(0x85), "'S", "re", "e"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(4000)] + ["", " ", "word " * 30000, "x" * 3000]
    rows = [(k, t) for k, t in enumerate(texts)]
    got = {r.doc_id: r for r in tc.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()}
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [got[k].n_tokens for k, _ in rows] == want
    assert all(got[k].n_bytes == len(t.encode()) and got[k].over_limit == (want[k] > 512) for k, t in rows)


def test_classes_follow_the_library(library):
    t = tc.transducer(PATH)
    import numpy as np
    import pyarrow as pa

    from mmsearch.llm.text import chunks

    probe = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000][::37]
    texts = [f"a{chr(c)} {chr(c)}1{chr(c)}!{chr(c)}\n{chr(c)}" for c in probe]
    mine = np.concatenate([t.count(raw, at) for _, _, raw, at in chunks(pa.record_batch([pa.array(texts)], ["text"]))])
    assert mine.tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_a_full_table_changes_no_count(spark, library, monkeypatch):
    monkeypatch.setattr(tc, "TRANSITIONS", 3)
    t = tc.Transducer(PATH)
    import pyarrow as pa

    from mmsearch.llm.text import chunks

    for text in ("one two three four five", "six two", "one one"):
        (_, _, raw, at), = chunks(pa.record_batch([pa.array([text])], ["text"]))
        assert t.count(raw, at).tolist() == [len(library.encode(text, add_special_tokens=False).ids)]


def test_edge_rows(spark):
    docs = spark.createDataFrame([(None, "a b", 1), (1, None, 2), (1, "", 3)], "doc_id long, text string, n_tokens long")
    got = sorted(map(tuple, tc.token_counts(docs, PATH).collect()), key=str)
    assert got == [(1, 0, 0, False), (1, 0, 0, False), (None, 3, 2, False)]
    assert tc.token_counts(docs.filter("doc_id > 5"), PATH).count() == 0
    with pytest.raises(ValueError):
        tc.Transducer(public_tokenizers.path("word_bpe_49k.json"))


def _merged(merges: tc.Merges, piece: bytes) -> int:
    """Plain BPE: apply the merge of least rank, leftmost first, until none is left."""
    now = [merges.tokens[bytes([b])] for b in piece]
    whole = {(a, b): k for k, (a, b, _) in merges.parts.items()}
    while pairs := [(merges.rank[p], k) for k, p in enumerate(zip(now, now[1:])) if p in merges.rank]:
        k = min(pairs)[1]
        now[k : k + 2] = [whole[now[k], now[k + 1]]]
    return len(now)


def test_token_transducer_matches_plain_merging(monkeypatch):
    t = tc.Transducer(PATH).merges
    rng = random.Random(3)
    pieces = [bytes(rng.choice(b"aeinrst -=\xc3\xa9") for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    pieces += [bytes(rng.randrange(256) for _ in range(rng.randint(1, 30))) for _ in range(500)] + [b"a" * 333, b"-" * 200, b" " * 150]
    want = [_merged(t, p) for p in pieces]
    assert [t.count(p) for p in pieces] == want
    before = len(t.states)
    monkeypatch.setattr(tc, "STATES", 50)
    t.clear()
    assert [t.count(p) for p in pieces] == want and len(t.states) <= 51 < before


def test_one_letter_runs_need_few_states():
    t = tc.Transducer(PATH).merges
    t.count(b"x" * 5000)
    seen = len(t.states)
    t.count(b"x" * 50000)
    assert len(t.states) == seen


def test_merge_tables_that_build_a_token_twice_are_refused():
    letters = {c: b for c, b in tc._byte_of().items()}
    with pytest.raises(ValueError):
        tc.Merges(letters | {"ab": 256, "bc": 257, "abc": 258}, [("a", "b"), ("b", "c"), ("a", "bc"), ("ab", "c")])


def test_the_library_is_not_loaded_to_count():
    import subprocess
    import sys

    code = f"import sys; from mmsearch.llm import token_counts as t; t.Transducer({PATH!r}); sys.exit('tokenizers' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], cwd=__file__.rsplit("/tests/", 1)[0]).returncode == 0
