import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline as cp
from mmsearch.llm import decontaminate, fertility, ngram_join


def test_stages_and_their_decisions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in cp.STAGES]
    assert names == ["quality_rules", "near_duplicates", "decontamination", "source_mix", "sharding"]
    got = {}
    for name, stage in cp.STAGES:
        got[name] = cp.materialize(stage(spark, docs, sf_dir), name)
        assert name == "sharding" or got[name].columns == docs.columns
        got[f"before {name}"], docs = docs, got[name]
    ids = lambda n: {r.doc_id for r in got[n].select("doc_id").collect()}
    judged = fertility.quality(got["before quality_rules"], public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    assert ids("quality_rules") == {r.doc_id for r in judged.filter("kept").collect()}
    comps = ngram_join.jaccard_components(got["quality_rules"])
    assert ids("near_duplicates") == {r.doc_id for r in comps.filter("doc_id = component_id").collect()}
    leaks = decontaminate.matches(got["near_duplicates"], spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    assert ids("decontamination") == ids("near_duplicates") - {r.doc_id for r in leaks.collect()}
    assert ids("source_mix") <= ids("decontamination") and max(r["count"] for r in got["source_mix"].groupBy("doc_id").count().collect()) <= 3
    assert got["sharding"].count() == got["source_mix"].count()
    per = got["sharding"].groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("last"), F.countDistinct("slot").alias("slots")).collect()
    assert all(r.n == r.slots == r.last + 1 for r in per)


def test_null_and_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    odd = docs.limit(1).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("n_chars"))
    for table in (docs.unionByName(odd).unionByName(docs.limit(5)), docs.filter("doc_id < 0")):
        for _, stage in cp.STAGES:
            table = cp.materialize(stage(spark, table, sf_dir), "edge")
        table.count()


def test_stages_match_brute_force(spark, tmp_path):
    """Plain English texts, so that quality is the base rules; every stage but the ring against a naive version of its rule."""
    import hashlib
    import random
    from collections import Counter

    from test_fertility import brute as base_rules
    from test_mixing import water
    from test_ngram_join import brute as components

    rng = random.Random(31)
    vocab = (
        "the weather in this small town was never very good but people went out and said what they liked about it because every evening after work "
        "someone played music near river while children ran over old bridge toward market where bread fruit flowers were sold until late when lamps lit streets"
    ).split()
    trivia = "which ancient city stood between two rivers where farmers first learned how grain could become beer under warm desert skies long before kings wrote laws".split()
    words = lambda n, v=vocab: [rng.choice(v) for _ in range(n)]
    items = [words(rng.randint(15, 30), trivia) for _ in range(6)]
    docs = []
    for k in range(160):
        kind, own = k % 8, words(rng.randint(60, 95))
        if kind == 1 and docs:
            own = rng.choice(docs)[1].split()
            own[rng.randrange(len(own))] = "changed"
        elif kind == 2:
            item = rng.choice(items)
            at = rng.randrange(len(own))
            own = own[:at] + item[: rng.choice([9, 12, 13, 14, len(item)])] + own[at:]
        elif kind == 3:
            own = own[: rng.randint(0, 49)]
        elif kind == 4 and rng.random() < 0.5:
            own = own[:20] * 4
        docs.append((k, " ".join(own), "en", rng.choice(["web", "web", "web", "books", "news"]), 0))
    spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table, got = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), {}
    for name, stage in cp.STAGES:
        table = cp.materialize(stage(spark, table, str(tmp_path)), name)
        got[name] = Counter(r.doc_id for r in table.select("doc_id").collect())

    def leaks(text):
        have = text.split()
        for item in items:
            for shift in range(-len(item), len(have)):
                run = 0
                for p, w in enumerate(item):
                    run = run + 1 if 0 <= p + shift < len(have) and have[p + shift] == w else 0
                    if run >= 13:
                        return True
        return False

    left = [d for d in docs if not base_rules(d[1])[-1]]
    assert got["quality_rules"] == Counter(d[0] for d in left) and len(left) < 150
    stay = {i for i, _, c in components([(d[0], d[1]) for d in left], 5, 80, 100) if i == c}
    assert got["near_duplicates"] == Counter(stay) and len(stay) < len(left)
    left = [d for d in left if d[0] in stay]
    clean = [d for d in left if not leaks(d[1])]
    assert got["decontamination"] == Counter(d[0] for d in clean) and len(clean) < len(left)
    size: dict = {}
    for d in clean:
        size[d[3]] = size.get(d[3], 0) + len(d[1].split())
    target, want = water(size), Counter()
    for d in clean:
        rate = target[d[3]] / size[d[3]]
        draw = int(hashlib.md5(f"17:{d[0]}".encode()).hexdigest()[:8], 16) / 2**32
        want[d[0]] = int(rate) + (draw < rate - int(rate))
    assert got["source_mix"] == +want and max(want.values()) > 1
    assert got["sharding"] == got["source_mix"]
    slots: dict = {}
    for r in table.collect():
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))
