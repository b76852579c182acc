"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Numbers, units and names of a text become typed placeholders, word for word, so words and template words
stay aligned. Windows of ``width`` words are hashed at every word of items and documents, once as plain words
and once as template words; template windows that are mostly placeholders are left to their plain words, so
that exact copies of them still meet. Hits are aligned: along the item's diagonal in the document a run of
words that are equal, plain or as template, must reach ``run`` words, or the whole of a shorter item, and its
slots must be consistent: one item value never stands for two document values. A re-parameterised question
changes every value the same way and is caught; a text that merely shares the template's words with unrelated
values is not. As many unchanged words convict whatever the rest of the run holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import BROADCAST_ROWS, lookup_join, materialize

SPACE = r" \t-\r"
UNITS = (
    "mm|cm|m|km|inch|inches|foot|feet|ft|yard|yards|mile|miles|metre|metres|meter|meters|g|mg|kg|gram|grams|ounce|ounces|oz|pound|pounds|lb|lbs|ton|tons|"
    "ml|l|litre|litres|liter|liters|gallon|gallons|s|sec|second|seconds|min|minute|minutes|h|hour|hours|day|days|week|weeks|month|months|year|years|"
    "dollar|dollars|cent|cents|euro|euros|usd|eur|percent|degree|degrees|mph|kmh|watt|watts|volt|volts|hz|kb|mb|gb|tb"
)
#: Words of these letters, with or without such marks at their end, stand for themselves unless a number precedes them.
_LETTERS, _MARKS = "^[a-zß-öø-ÿа-я]++[.,;:!?]*$", ".,;:!?"
# Patterns of single words; possessive runs keep them linear on words of any length.
_REST = r"(?=[^\p{L}\p{N}]*$)"
_NUMBER = rf"(?s)^[^\p{{L}}\p{{N}}]*+\p{{N}}[^\p{{L}}]*+(?:(?i:{UNITS}|st|nd|rd|th){_REST})?(?!.*[\p{{L}}\p{{N}}]).*"
_UNIT, _NAME = rf"^(?i:{UNITS}){_REST}", rf"^\p{{Lu}}[\p{{L}}'-]*+{_REST}"
_EDGES = r"(?<=[\p{L}\p{N}%])[^\p{L}\p{N}%]++$|^[^\p{L}\p{N}]++(?=[\p{L}\p{N}])"
_SLOT_EDGES = r"(?<=[\p{L}\p{N}>])[^\p{L}\p{N}<>]++$|^[^\p{L}\p{N}<>]++(?=[\p{L}\p{N}<])"


def words(text: Column) -> Column:
    """Words of a text; null and blank: none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once however often body names it."""
    return F.transform(F.array(value), body)[0]


def _plain(w: Column) -> Column:
    """A word of plain letters without its marks, null for other words."""
    return F.when(F.regexp_like(w, F.lit(_LETTERS)), F.rtrim(w, F.lit(_MARKS)))


def _number(w: Column, plain: Column) -> Column:
    return F.when(plain.isNotNull() | ~F.regexp_like(w, F.lit(r"\p{N}")), w).otherwise(F.regexp_replace(w, _NUMBER, "<num>"))


def _literal(w: Column, plain: Column) -> Column:
    return F.coalesce(plain, F.lower(F.regexp_replace(w, _EDGES, "")))


def _slotted(w: Column, plain: Column, last: Column) -> Column:
    """The template word of w; last: the word before it."""
    unit = F.when(last == "<num>", F.regexp_replace(w, _UNIT, "<unit>")).otherwise(w)
    name = F.when(F.regexp_like(last, F.lit(r"[\p{L},;>]$")), F.regexp_replace(unit, _NAME, "<name>")).otherwise(unit)
    return F.when(plain.isNotNull() & (last != "<num>"), plain).otherwise(F.lower(F.regexp_replace(name, _SLOT_EDGES, "")))


def canonical(text: Column, before: str = "") -> Column:
    """(dl, dc): the literal and the template words of a text, one for each of its words. before: the word before the text."""

    def both(w: Column, plain: Column, n: Column) -> Column:
        last = lambda i: F.when(i == 0, F.lit(before)).otherwise(F.get(n, i - 1))
        slotted = F.transform(n, lambda x, i: _let(last(i), lambda before: _slotted(x, F.get(plain, i), before)))
        return F.struct(F.zip_with(w, plain, _literal).alias("dl"), slotted.alias("dc"))

    return _let(words(text), lambda w: _let(F.transform(w, _plain), lambda plain: _let(F.zip_with(w, plain, _number), lambda n: both(w, plain, n))))


def template(text: Column) -> Column:
    """Template words of a text: <num>, <unit>, <name>, or the lower-cased word without edge punctuation."""
    return canonical(text)["dc"]


def windows(c: Column, width: int) -> Column:
    """Hashes of the windows of width elements of c, at every element. c: a column, as it is read several times."""
    return F.slice(_rolled(c, width), 1, F.greatest(F.size(c) - (width - 1), F.lit(0)))


def _rolled(c: Column, width: int) -> Column:
    """Hashes of width elements from every place of c on, made of those of half as many; behind the last whole window they cover less."""
    if width == 1:
        return F.transform(c, lambda x: F.xxhash64(x))
    both = lambda a, b, after: F.zip_with(a, F.slice(b, after + 1, F.size(c)), lambda x, y: F.xxhash64(x, y))
    if width == 2 or width % 2:
        return both(c if width == 2 else _rolled(c, width - 1), c, width - 1)
    return _let(_rolled(c, width // 2), lambda half: both(half, half, width // 2))


def _is_slot(word: Column) -> Column:
    return word.isin("<num>", "<unit>", "<name>")


def _bounds(flags: Column) -> Column:
    """Places of the false elements, with one before the first and one past the last element."""
    return F.filter(F.sequence(F.lit(-1), F.size(flags)), lambda i: ~F.coalesce(F.get(flags, i), F.lit(False)))


def _runs(bounds: Column, least: Column) -> Column:
    """(begin, end) of the runs of at least so many true elements between bounds."""
    pairs = F.zip_with(F.slice(bounds, 1, F.size(bounds) - 1), F.slice(bounds, 2, F.size(bounds) - 1), lambda x, y: F.struct((x + 1).alias("begin"), y.alias("end")))
    return F.filter(pairs, lambda r: r["end"] - r["begin"] >= least)


def _index(items: DataFrame, width: int) -> DataFrame:
    """(item_id, item_place, hash, plain) of the items' windows. plain: at least a third of its template words are literal.

    The first word of an item has no text before it that could make it a name, so its window is also indexed as it
    reads inside a sentence.
    """
    plain = F.size(F.filter(F.slice("ic", F.col("item_place") + 1, width), lambda w: ~_is_slot(w))) * 3 >= width
    forms = items.select("item_id", "ic", F.posexplode(F.array("il", "ic", "inside")).alias("form", "t"))
    rows = forms.select("item_id", "ic", "form", F.posexplode(windows(F.col("t"), width)).alias("item_place", "hash"))
    return rows.select("item_id", "item_place", "hash", "form", plain.alias("plain")).filter("plain or form = 0").groupBy("item_id", "item_place", "hash").agg(F.max("plain").alias("plain"))


def _whole(docs: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """Items under width words that stand unchanged in a document."""
    short = materialize(items.filter(F.size("ic") < width).select("item_id", "il", F.size(F.filter("ic", _is_slot)).cast("long").alias("n_slots")), "short-items")
    found = None
    for n in sorted(r.n for r in short.select(F.size("il").alias("n")).distinct().collect()):  # at most width - 1 lengths
        of = short.filter(F.size("il") == n).withColumn("hash", windows(F.col("il"), n)[0])
        hits = lookup_join(docs.select("doc_id", F.posexplode_outer(windows(F.col("dl"), n)).alias("at", "hash")), of, "hash")
        hits = hits.groupBy("doc_id", "item_id", "n_slots").agg(F.min("at").cast("long").alias("doc_word"))
        hits = hits.select("doc_id", "item_id", "doc_word", F.lit(n).cast("long").alias("run_words"), "n_slots", F.lit(0).cast("long").alias("n_changed"))
        found = hits if found is None else found.unionByName(hits)
    return found


def matches(docs: DataFrame, benchmark: DataFrame, width: int = 6, run: int = 13, shortest: int = 3) -> DataFrame:
    """(doc_id, item_id, doc_word, run_words, n_slots, n_changed): a row for each document and item it leaks.

    docs: doc_id, text; benchmark: item_id, text; further columns of either are ignored. doc_word: the word
    at which the longest such run begins (the first of equally long ones). n_slots: placeholders in the run,
    n_changed: those whose value differs from the item's.

    Items under width words must stand whole and unchanged in a document; items under ``shortest`` words say
    too little to convict a text and match nothing. A diagonal on which no hit has width / 3 literal words is
    judged by unchanged words only. Null texts have no words. Null ids match nothing.
    Rows that repeat an id are one document (or item) with several texts. Empty tables: empty result.
    """
    docs = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    text = F.col("text").cast("string")
    items = benchmark.filter("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), canonical(text).alias("c"), canonical(text, "x")["dc"].alias("inside"))
    items = items.select("item_id", F.col("c.dl").alias("il"), F.col("c.dc").alias("ic"), "inside").filter(F.size("ic") >= shortest).distinct()
    items = materialize(items, "items")
    made = docs.select("doc_id", canonical(F.col("text")).alias("c")).select("doc_id", "c.dl", "c.dc")
    whole = _whole(made, items, width)
    items = items.filter(F.size("ic") >= width)
    index = materialize(_index(items, width), "windows")
    items = items.drop("inside")

    # One array of hashes a document, plain windows first; no other array may ride along through the explode. Outer, as Spark
    # would else ask for a size above 0 before it and push that, with all that makes the array, into the lambdas below.
    slotted = F.when(F.col("dl") != F.col("dc"), windows(F.col("dc"), width)).otherwise(F.array().cast("array<bigint>"))
    rolled = made.select("doc_id", (F.size("dl") - (width - 1)).alias("n"), F.concat(windows(F.col("dl"), width), slotted).alias("hashes"))
    rolled = rolled.select("doc_id", "n", F.posexplode_outer("hashes").alias("at", "hash"))
    hits = lookup_join(rolled, index, "hash")
    place = F.when(F.col("at") < F.col("n"), F.col("at")).otherwise(F.col("at") - F.col("n"))
    diagonals = materialize(hits.groupBy("doc_id", "item_id", (place - F.col("item_place")).alias("shift")).agg(F.max("plain").alias("plain")), "diagonals")

    ids = diagonals.select("doc_id").distinct()
    texts = lookup_join(docs, ids, "doc_id").select("doc_id", canonical(F.col("text")).alias("c")).select("doc_id", "c.dl", "c.dc")
    few = items.count() <= BROADCAST_ROWS // 10
    pairs = diagonals.join(texts, "doc_id").join(F.broadcast(items) if few else items, "item_id")
    first = F.greatest(F.col("shift"), F.lit(0))
    n = F.least(F.size("dc"), F.col("shift") + F.size("ic")) - first
    cut = pairs.filter(n > 0).select(
        "doc_id", "item_id", "plain", first.alias("first"), F.least(F.lit(run), F.size("ic")).alias("least"),
        *(F.slice(F.col(c), first + 1, n).alias(c) for c in ("dl", "dc")), *(F.slice(F.col(c), first - F.col("shift") + 1, n).alias(c) for c in ("il", "ic")),
    )
    same = lambda a, b: F.zip_with(a, b, lambda x, y: x == y)
    cut = cut.withColumn("exact", same("dl", "il"))
    cut = cut.withColumn("canonical", same("dc", "ic")).withColumns({"x": _bounds(F.col("exact")), "c": _bounds(F.col("canonical")), "e": _bounds(F.zip_with("exact", "canonical", lambda x, y: x | y))})
    of = lambda c: _runs(F.col(c), F.col("least"))
    runs = F.when(F.col("plain"), F.concat(of("x"), of("c"), of("e"))).otherwise(of("x"))
    cut = cut.withColumn("runs", F.array_distinct(runs)).filter(F.size("runs") > 0).withColumn("r", F.explode("runs"))
    begin, length = F.col("r.begin"), F.col("r.end") - F.col("r.begin")
    part = lambda c: F.slice(F.col(c), begin + 1, length)
    slots = F.filter(F.arrays_zip(part("ic").alias("t"), part("il").alias("i"), part("dl").alias("d")), lambda s: _is_slot(s["t"]))
    cut = cut.select("doc_id", "item_id", (F.col("first") + begin).cast("long").alias("doc_word"), length.cast("long").alias("run_words"), slots.alias("slots"))
    consistent = F.size(F.array_distinct("slots")) == F.size(F.array_distinct(F.transform("slots", lambda s: F.struct(s["t"], s["i"]))))
    cut = cut.filter(consistent).select("doc_id", "item_id", "doc_word", "run_words", F.size("slots").cast("long").alias("n_slots"), F.size(F.filter("slots", lambda s: s["i"] != s["d"])).cast("long").alias("n_changed"))
    best = F.max_by(F.struct("doc_word", "run_words", "n_slots", "n_changed"), F.struct("run_words", -F.col("n_changed"), -F.col("doc_word")))
    found = cut.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")
    return found if whole is None else found.unionByName(whole)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs without the documents that leak an item. Rows of null doc_id stay."""
    gone = materialize(matches(docs, benchmark, **how).select("doc_id").distinct(), "leaks")
    return lookup_join(docs, gone, "doc_id", "left_anti")
