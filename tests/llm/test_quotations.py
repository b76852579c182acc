import random

from mmsearch.llm import quotations as qu


def test_links_levels_and_branches(spark, monkeypatch):
    monkeypatch.setattr(qu, "BLOCK", 2)
    rows = [
        (1, 0, "a", "Hello there\nHow are you?"), (1, 1, "b", "On Monday a wrote:\n> how are   YOU?\nFine."), (1, 2, "a", "Something else"),
        (1, 3, "b", "> Something else\nYes"), (1, 4, "a", ">> How are you?\n> Fine.\nGood to hear"), (1, 6, "b", "> nobody said this\nodd"), (1, 9, "c", "> Hello there\r\n> How are you?\r\nlate reply"),
        (2, 0, "a", None), (2, 1, "b", ""), (2, 2, "c", "> \n>\n"), (None, 3, "a", "> Hello there"), (3, None, "a", "> x"), (4, 5, "a", "> Hello there\nother conversation"),
    ]
    got = {(r.conv_id, r.turn): r for r in qu.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(got) == len(rows)
    pick = lambda c, t: (got[c, t].reply_to, got[c, t].branch, got[c, t].branch_parent, got[c, t].position, got[c, t].linked_lines)
    assert pick(1, 0) == (None, 0, None, 0, 0)
    assert pick(1, 1) == (0, 0, None, 1, 1) and got[1, 1].text == "Fine."
    assert pick(1, 2) == (1, 0, None, 2, 0)
    assert pick(1, 3) == (2, 0, None, 3, 1)
    assert pick(1, 4) == (1, 4, 1, 0, 2) and got[1, 4].quote_level == 2 and got[1, 4].text == "Good to hear"
    assert pick(1, 6) == (4, 4, 1, 1, 0) and got[1, 6].quoted_lines == 1
    assert pick(1, 9) == (0, 9, 0, 0, 2) and got[1, 9].text == "late reply"
    assert pick(2, 2) == (1, 0, None, 2, 0) and got[2, 0].text == "" and got[2, 2].quoted_lines == 0
    assert pick(None, 3)[:4] == (None, None, None, None) and pick(3, None)[:4] == (None, None, None, None)
    assert pick(4, 5) == (None, 5, None, 0, 0)


def test_matches_brute_force_with_hot_lines(spark, monkeypatch):
    monkeypatch.setattr(qu, "BLOCK", 16)
    rng = random.Random(8)
    lines = ["ok", "yes", "no"] + [f"line {k}" for k in range(30)]
    rows = []
    for c in range(3):
        for t in sorted(rng.sample(range(-50, 300), 120)):
            rows.append((c, t, "u", "\n".join(rng.choice(["", "", "> ", ">> "]) + rng.choice(lines) for _ in range(rng.randint(1, 4)))))
    want = {}
    for c in range(3):
        own = [(t, x.split("\n")) for cc, t, _, x in rows if cc == c]
        start, previous = None, None
        for k, (t, ls) in enumerate(own):
            votes: dict = {}
            for line in ls:
                level = line.count(">")
                bare = line.lstrip("> ")
                if level:
                    src = max((s for s, o in own[:k] if bare in o), default=None)
                    if src is not None:
                        votes[level, src] = votes.get((level, src), 0) + 1
            parent = max(votes, key=lambda v: (-v[0], votes[v], v[1]))[1] if votes else None
            if previous is None or (parent is not None and parent != previous):
                start = (t, k, parent)
            want[c, t] = (parent if parent is not None else previous, start[0], start[2], k - start[1], sum(votes.values()))
            previous = t
    got = qu.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r.conv_id, r.turn): (r.reply_to, r.branch, r.branch_parent, r.position, r.linked_lines) for r in got} == want


def test_huge_lines(spark):
    rows = [(1, 0, "a", "x" * 200000), (1, 1, "b", "> " * 100000 + "x" * 200000 + "\nok"), (1, 2, "c", "\n" * 50000 + ">" * 100000)]
    got = {r.turn: r for r in qu.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1].quote_level == 100000 and got[1].linked_lines == 1 and got[1].text == "ok" and got[2].text == ""


def test_repeated_rows_extra_columns_and_empty_table(spark):
    rows = [(1, 0, "a", "x", 1), (1, 0, "a", "x", 2), (1, 1, "b", "> x\ny", 3)]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, parent int")
    got = qu.reply_order(conv).collect()
    assert len(got) == 3 and [r.reply_to for r in got if r.turn == 1] == [0]
    assert qu.reply_order(conv.filter("turn > 7")).count() == 0


SAID = "The quarterly report needs another look before we send it to the whole team on Friday"
MAIL = [
    (1, 0, "a", SAID + "\nok"), (1, 1, "b", "something else\nok"), (1, 2, "c", "a wrote:\n> The quarterly report needs another look\n> before we send it to the whole team on\n> Friday\n> ok\nAgreed."),
    (1, 3, "d", "> needs another look before we send it\ncut"), (1, 4, "e", "b wrote:\n> nobody here said any of these words\n>\n> ok\nhm"),
    (2, 0, "a", "Hi\nHow are you\nBye"), (2, 1, "b", "no"), (2, 2, "c", "> How\n> are you\nfine"), (2, 3, "d", ">> How are\n>> you\n> fine\nnested"), (2, 4, "a", "> How are\nyou\n"),
    (3, 0, "a", "one two three\n> x\nfour five six"), (3, 1, "b", "> one two three four\n> five six"), (3, 2, "c", "one two three four five six"), (3, 3, "d", "> one two three\n\n> four five six\n> nine"),
]


def test_passages_wrapped_anew_cut_or_unknown(spark):
    got = {(r.conv_id, r.turn): r for r in qu.reply_order(spark.createDataFrame(MAIL, "conv_id long, turn long, role string, text string")).collect()}
    pick = lambda c, t: (got[c, t].reply_to, got[c, t].linked_lines, got[c, t].text)
    assert pick(1, 2) == (0, 4, "Agreed.")
    assert pick(1, 3) == (0, 1, "cut")
    assert pick(1, 4) == (1, 1, "b wrote:\n> nobody here said any of these words\nhm")
    assert pick(2, 2) == (0, 2, "fine") and pick(2, 3) == (2, 3, "nested")
    assert pick(2, 4) == (3, 0, "> How are\nyou")
    # what stands around a quote is two passages, so only the message that says it in one holds the windows
    assert pick(3, 1) == (0, 0, "> one two three four\n> five six")
    assert pick(3, 3) == (2, 2, "> nine")


def test_sql_agrees_on_quotes(spark):
    import duckdb

    from mmsearch.llm.queries import ORACLE_1

    rng = random.Random(11)
    vocab = "alpha beta gamma delta epsilon zeta eta theta".split()
    rows = list(MAIL)
    for c in range(10, 14):
        said: list[str] = []
        for t in range(60):
            own = " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 14)))
            text = [own]
            for _ in range(rng.randint(0, 3) if said else 0):
                words = rng.choice(said).split()
                words = words[rng.randint(0, len(words) // 2) :]
                mark, width = rng.choice(["> ", ">> ", ">"]), rng.randint(2, 9)
                text += ([f"{rng.choice(vocab)} wrote:"] if rng.random() < 0.3 else []) + [mark + " ".join(words[i : i + width]) for i in range(0, len(words), width)]
                text += rng.choice([[], [""], [">"], ["ok"]])
            rng.random() < 0.5 and text.append("ok")
            said.append(own)
            rows.append((c, t, "u", "\n".join(text)))
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(map(tuple, qu.reply_order(table).collect()))
    con = duckdb.connect()
    con.register("conversations", table.toPandas())
    want = con.sql(ORACLE_1)
    assert want.columns == qu.reply_order(table).columns
    clean = lambda r: tuple(None if x is None else x for x in r)
    key = lambda r: r[:2]
    assert sorted(got, key=key) == sorted(map(clean, want.fetchall()), key=key)
    assert sum(r[5] for r in got) > 200 and any(r[7] != 0 for r in got)
