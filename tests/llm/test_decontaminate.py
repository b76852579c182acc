import random

from pyspark.sql import functions as F

from mmsearch.llm import decontaminate as dc


def test_words_and_template_words_stay_aligned(spark):
    rng = random.Random(3)
    parts = ["Tom", "has", "5", "12.5", "km", "(about", "7", "miles)", "3hours.", "|", "He", "$30.", "5th", "-", "it's", "A-b", "x1y", "<num>", "Été,", "日本", "...", "“Ann”"]
    rows = [(k, "".join(rng.choice(parts) + rng.choice([" ", "  ", "\n", "\t"]) for _ in range(rng.randint(0, 25)))) for k in range(400)]
    made = spark.createDataFrame(rows, "id int, text string").select("text", dc.words(F.col("text")).alias("w"), dc.template(F.col("text")).alias("t")).collect()
    for r in made:
        assert r.w == r.text.encode().decode().replace("\t", " ").replace("\n", " ").split(" ") or [x for x in r.text.replace("\t", " ").replace("\n", " ").split(" ") if x] == r.w
        assert len(r.w) == len(r.t), (r.w, r.t)


def test_placeholders(spark):
    t = spark.createDataFrame([("Tom has 5 apples, and Ann Lee walked 12.5 km in 3hours for $30.",)], "text string").select(dc.template(F.col("text")).alias("t")).first().t
    assert t == ["tom", "has", "<num>", "apples", "and", "<name>", "<name>", "walked", "<num>", "<unit>", "in", "<num>", "for", "<num>"]


ITEM = "A train leaves the station with 40 people and picks up 15 more at Leeds before it reaches Paris after 90 minutes how many people are on it when 15 leave"
FILL = "nothing to see here just some other words that go on and on until they stop"


def other(a="55", b="20", c="20", name="Rome"):
    return ITEM.replace("40", a).replace("picks up 15", f"picks up {b}").replace("when 15", f"when {c}").replace("Paris", name)


def test_reparameterised_items_are_caught_and_inconsistent_slots_are_not(spark):
    docs = [
        (1, f"{FILL} {ITEM} {FILL}"), (2, f"{FILL}\n{other()}\n{FILL}"), (3, f"{FILL} {other(c='21')} {FILL}"), (4, FILL * 3), (5, None), (6, ""), (7, ITEM.upper().lower()),
        (8, " ".join(ITEM.split()[4:16])), (9, " ".join(ITEM.split()[:11]) + " " + FILL), (None, ITEM), (10, f"{ITEM} {other()}"), (11, f"{FILL} " * 2000 + ITEM),
    ]
    bench = [(0, ITEM), (1, "too short"), (2, None), (None, ITEM), (3, FILL)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"item_id": F.lit(1), "hash": F.lit("x"), "shift": F.lit(2)})
    b = spark.createDataFrame(bench, "item_id long, text string").withColumn("doc_id", F.lit(4))
    got = {(r.doc_id, r.item_id): r for r in dc.matches(d, b).collect()}
    zero = {i for i, j in got if j == 0}
    assert {1, 2, 10, 11} <= zero and not zero & {3, 4, 5, 6, 8, 9}
    assert got[1, 0].n_changed == 0 and got[2, 0].n_changed == 4 and got[2, 0].n_slots == 7
    assert got[2, 0].run_words == len(ITEM.split()) and got[2, 0].doc_word == len(FILL.split())
    assert {i for i, j in got if j == 3} == {1, 2, 3, 4, 9, 11}
    left = dc.drop_leaks(d, b.filter("item_id = 0"))
    assert left.columns == d.columns
    assert {r.doc_id for r in left.collect()} == {3, 4, 5, 6, 8, 9, None} | ({7} - zero)
    assert dc.matches(d.filter("doc_id > 99"), b).count() == 0 and dc.matches(d, b.filter("item_id > 99")).count() == 0


def test_every_run_is_found_wherever_it_starts(spark):
    """Brute force over word positions: a leak is a run of at least 13 equal template words."""
    rng = random.Random(9)
    vocab = [f"{a}{b}" for a in "bcdfgh" for b in "aeiou"]
    items = [[rng.choice(vocab) for _ in range(rng.randint(15, 40))] for _ in range(12)]
    docs, want = [], set()
    for k in range(150):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 50))]
        if k % 2:
            i = rng.randrange(len(items))
            a = rng.randrange(len(items[i]) - 8)
            words += items[i][a : a + rng.randint(5, 20)] + [rng.choice(vocab) for _ in range(9)]
        docs.append((k, " ".join(words)))
        for i, item in enumerate(items):
            for shift in range(-len(item), len(words)):
                run = best = 0
                for p in range(len(item)):
                    run = run + 1 if 0 <= p + shift < len(words) and words[p + shift] == item[p] else 0
                    best = max(best, run)
                if best >= 13:
                    want.add((k, i))
    got = dc.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")).collect()
    assert len(want) > 10 and {(r.doc_id, r.item_id) for r in got} == want


def test_huge_tokens_take_linear_time(spark):
    tokens = ["x" * 300000, "1" * 300000 + "a", "-" * 300000, "a" + "-" * 300000 + "b", "A" + "b" * 300000 + "1", "," * 300000 + "1"]
    got = spark.createDataFrame([(" ".join(["so", *tokens, "end"]),)], "text string").select(F.size(dc.words(F.col("text"))).alias("w"), F.size(dc.template(F.col("text"))).alias("t")).first()
    assert got.w == got.t == 8


NUMBERS = "Sort these numbers: 3, 17, 12, 9, 41, 8, 22, 36, 5, 14, 29, 11, 25"
ALL_NUMBERS = "3 17 12 9 41 8 22 36 5 14 29 11 25 19"
SIX = "Give 12 plus 30 plus 7"


def leaks(spark, docs, items):
    got = dc.matches(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    return {(r.doc_id, r.item_id): r for r in got.collect()}


def test_exact_copies_of_numbers_and_short_items_are_found_at_every_alignment(spark):
    docs = [" ".join(["so"] * k + [item, "and on"]) for item in (NUMBERS, ALL_NUMBERS, SIX) for k in range(4)]
    docs += [" ".join(["so"] * k + NUMBERS.split()[3:]) for k in range(4)]
    got = leaks(spark, docs, [NUMBERS, ALL_NUMBERS, SIX])
    want = {(4 * i + k, i) for i in range(3) for k in range(4)}
    assert want <= set(got) and all(got[x].n_changed == 0 for x in want)
    assert {(d, 0) for d in range(12, 16)} <= set(got)
    assert not leaks(spark, ["7 2 90 33 6 54 71 18 40 66 13 58 99 20"], [ALL_NUMBERS])


def test_every_run_of_a_diagonal_is_judged_and_unchanged_words_always_convict(spark):
    last = ITEM.replace("when 15", "when 16")
    two = "one box of 15 pens and one box of 15 nibs go to the shop on the hill before the long day comes to its end and nobody there knows why"
    w = two.split()
    # The longest run contradicts itself (15 is 20 and 21), a shorter one on the same diagonal doesn't.
    later = " ".join(w[:16]).replace("15 pens", "20 pens").replace("15 nibs", "21 nibs") + " ??? " + " ".join(w[17:30])
    got = leaks(spark, [last, f"{FILL} {last} {FILL}", later, ITEM.replace("40", "41").replace("when 15", "when 16")], [ITEM, two])
    assert {(0, 0), (1, 0), (2, 1), (3, 0)} == set(got)
    assert got[0, 0].n_changed == 0 and got[0, 0].run_words == 29 and got[2, 1].doc_word == 17


def test_words_that_only_their_surroundings_make_names_are_equal(spark):
    short = "What is the usual name of that old stone bridge"
    passage = "Paris and Leeds have more people than Rome and York put together these days"
    docs = [f"they asked {short} twice", f"{short}\nand more", f"so {passage}", passage.replace("than Rome", "than\nRome").replace("and Leeds", "and  Leeds"), ITEM.lower(), "it takes 90  minutes to walk from Leeds over the hill to York in rain", f"then, {SIX.replace('12', '15').replace('30', '40')}"]
    got = leaks(spark, docs, [short, f"In short {passage}", ITEM, "it takes 45 minutes to walk from Leeds over the hill to York in rain", SIX])
    assert {(0, 0), (1, 0), (2, 1), (3, 1), (4, 2), (5, 3), (6, 4)} == set(got)


def test_items_of_few_words_must_stand_whole_and_unchanged(spark):
    items = ["Is 7 a prime number?", "Name the capital", "Why not", "Which of these seven rivers is longest"]
    docs = ["they asked: is 7 a prime number? Nobody knew.", "Is 9 a prime number?", "is 7 a prime", "name the Capital", "why not", "Tell me which of these seven rivers is longest, please", "which of these seven lakes is longest", None, ""]
    assert set(leaks(spark, docs, items)) == {(0, 0), (3, 1), (5, 3)}


def test_recall_on_reparameterised_items_dense_in_slots_and_on_german(spark):
    """Planted items with new numbers and names; brute force over words would find each of them."""
    rng = random.Random(21)
    names, german = ["Tom", "Ann", "Lee", "Kim", "Max", "Eva", "Jan", "Ida"], ["Hund", "Haus", "Wald", "Zug", "Stadt", "Fluss", "Berg", "Brief"]
    items, docs = [], []
    for k in range(40):
        a, b, c, d = rng.sample(names, 4)
        n = [str(rng.randint(2, 99)) for _ in range(5)]
        verb = rng.choice(["owns", "sells", "wants", "finds"])
        form = f"if {{a}} has {{n0}} kg and {{b}} {verb} {{n1}} kg of item{k} then {{c}} pays {{n2}} euros and {{d}} takes {{n3}} for {{n4}} days"
        if k % 2:
            g = rng.sample(german, 4)
            form = f"der {{a}} sah den {g[0]}{k} und das {g[1]} am {g[2]} mit {{n0}} {g[3]} bei {{b}} nach {{n1}} tagen von {{c}} gegen {{n2}}"
        fill = lambda x, m: form.format(a=x[0], b=x[1], c=x[2], d=x[3], **{f"n{i}": m[i] for i in range(5)})
        items.append(fill((a, b, c, d), n))
        other = dict(zip(names, rng.sample(names, 8), strict=True))
        new = {x: str(100 + i) for i, x in enumerate(dict.fromkeys(n))}
        docs.append("so the story goes on: " + fill([other[x] for x in (a, b, c, d)], [new[x] for x in n]) + " and that is all there is to say")
    clean = [" ".join(rng.choice(["der", "die", "und", "mit", "7", "kg", "for", "days", rng.choice(names), rng.choice(german)]) for _ in range(80)) for _ in range(40)]
    got = leaks(spark, docs + clean, items)
    assert sum((k, k) in got for k in range(40)) >= 36 and all(d < 40 for d, _ in got)


def plain_canonical(text, before=""):
    """(literal words, template words) for texts of lower-case words, numbers, capitalised names and units."""
    literal, slotted = [], []
    for w in text.split():
        if w.isdigit():
            t = "<num>"
        elif w in ("km", "kg", "hours") and before.isdigit():
            t = "<unit>"
        elif w[0].isupper() and before:
            t = "<name>"
        else:
            t = w.lower()
        literal.append(w.lower())
        slotted.append(t)
        before = w
    return literal, slotted


def plain_matches(doc, item, width=6, run=13, shortest=3):
    """The row of a document and an item by looking at every word of every diagonal, or None."""
    (dl, dt), (il, it), inside = plain_canonical(doc), plain_canonical(item), plain_canonical(item, "x")[1]
    slot = lambda t: t.startswith("<")
    if len(il) < width:
        at = [k for k in range(len(dl) - len(il) + 1) if dl[k : k + len(il)] == il]
        return (at[0], len(il), sum(map(slot, it)), 0) if at and len(il) >= shortest else None
    least, found = min(run, len(il)), []
    for shift in range(-len(il) + 1, len(dl)):
        on = [p for p in range(len(il)) if 0 <= p + shift < len(dl)]
        wide = [p for p in on if p + width - 1 in on]
        hit = [p for p in wide if any(d[p + shift : p + shift + width] == i[p : p + width] for d in (dl, dt) for i in (il, it, inside))]
        literal = any(3 * sum(not slot(t) for t in it[p : p + width]) >= width for p in hit)
        exact, same = {p for p in on if dl[p + shift] == il[p]}, {p for p in on if dt[p + shift] == it[p]}
        for kind in (exact, same, exact | same) if literal else (exact,):
            for a in [p for p in kind if p - 1 not in kind]:
                b = a
                while b in kind:
                    b += 1
                values = {(it[p], il[p], dl[p + shift]) for p in range(a, b) if slot(it[p])}
                if b - a >= least and len(values) == len({v[:2] for v in values}):
                    slots = [p for p in range(a, b) if slot(it[p])]
                    found.append((b - a, -sum(il[p] != dl[p + shift] for p in slots), -(a + shift), len(slots)))
    if not found:
        return None
    n, changed, at, slots = max(found)
    return -at, n, slots, -changed


def test_slots_and_consistency_match_brute_force(spark):
    rng = random.Random(21)
    vocab = [f"{a}{b}" for a in "bcdfgh" for b in "aeiou"]
    names = ["Rome", "Oslo", "Anna", "Bert", "Lima"]
    fresh = lambda w: str(rng.randint(1, 60)) if w.isdigit() else rng.choice(names) if w[0].isupper() else rng.choice(["km", "kg", "hours"]) if w in ("km", "kg", "hours") else w

    def words(n, slots):
        out = []
        while len(out) < n:
            out += rng.choice([[str(rng.randint(1, 9))], [str(rng.randint(1, 9)), rng.choice(["km", "kg"])], [rng.choice(names)]]) if rng.random() < slots else [rng.choice(vocab)]
        return out[:n]

    items = [words(rng.randint(3, 34), rng.choice([0.1, 0.4, 0.9])) for _ in range(40)]
    docs = []
    for k in range(240):
        item = list(rng.choice(items))
        how = k % 4
        if how == 1:  # every value changes the same way
            to: dict = {}
            item = [to.setdefault(w, fresh(w)) for w in item]
        elif how == 2:  # values change as they like
            item = [fresh(w) if rng.random() < 0.5 else w for w in item]
        elif how == 3:  # one word goes, a part is cut
            item[rng.randrange(len(item))] = rng.choice(vocab)
            item = item[rng.randint(0, len(item) // 2) :]
        docs.append(" ".join(words(rng.randint(0, 9), 0.3) + item + words(rng.randint(0, 9), 0.3)))
    texts = [" ".join(x) for x in items]
    want = {(d, i): r for d, doc in enumerate(docs) for i, item in enumerate(texts) if (r := plain_matches(doc, item))}
    got = {k: (r.doc_word, r.run_words, r.n_slots, r.n_changed) for k, r in leaks(spark, docs, texts).items()}
    assert got == want
    assert len(want) > 100 and sum(r[3] > 0 for r in want.values()) > 20


def test_windows_are_made_of_half_windows(spark):
    """Equal windows and no others have equal hashes, at every width, and a window costs a hash or two a doubling, not one a word."""
    rng = random.Random(6)
    rows = [(k, [rng.choice("ab") for _ in range(n)]) for k, n in enumerate([0, 1, 2, 5, 6, 7, 12, 13, 40, 60])]
    df = spark.createDataFrame(rows, "id int, w array<string>")
    for width in (1, 2, 3, 4, 5, 6, 7, 13):
        known = {}
        for row in df.select("w", dc.windows(F.col("w"), width).alias("h")).collect():
            plain = [tuple(row.w[i : i + width]) for i in range(max(0, len(row.w) - width + 1))]
            assert len(row.h) == len(plain)
            for h, words in zip(row.h, plain, strict=True):
                assert known.setdefault(h, words) == words
        assert len(set(known.values())) == len(known)
    assert dc.windows(F.col("w"), 64)._jc.toString().count("xxhash64") <= 2 * (64).bit_length()
    assert dc.windows(F.col("w"), 64)._jc.toString().count("get(") == 0
