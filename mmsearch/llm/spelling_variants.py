"""Spelling variants by permuterm rotations.

Words one edit apart share a rotation prefix. Of a word w marked with a terminator, the rotation that ends in
its i-th character is w[i+1:] + "$" + w[:i] + w[i]: without that last character it is what all words have in common
that replace it, and it is a whole rotation of the word that lacks it. So each rotation is filed twice, whole and
without its last character, the table is sorted by that key, and a scan of each key's range sees

* words with another character at that place: replacements of each other;
* the one word that has the key as a whole rotation: the deletion of each of them.

A range holds at most one word a letter of the alphabet and one more, whatever the corpus, so nothing in it is
capped. A deletion from a run of equal letters would be met once a letter of the run; only the first of them counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize

END = "$"
LETTERS = r"A-Za-zÀ-ÿ"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def letter_runs(docs: DataFrame, shortest: int = 1) -> DataFrame:
    """(doc_id, run): each maximal run of letters of at least ``shortest`` code points, A-Z lower-cased, as often as it occurs. Null text: none."""
    runs = F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(runs).alias("run"))
    return rows.select("doc_id", F.translate("run", _UPPER, _LOWER).alias("run"))


def count_words(words: DataFrame, shortest: int, least: int) -> DataFrame:
    """(word, n) of the column word: those of at least ``shortest`` code points that occur at least ``least`` times."""
    counted = words.filter(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= least)


def rotations(words: DataFrame) -> DataFrame:
    """(key, skipped, n): each rotation of a marked word whole (skipped: "") and without its last character."""
    marked = F.concat("word", F.lit(END))
    turned = words.select("n", marked.alias("m"), F.explode(F.sequence(F.lit(0), F.length("word"))).alias("i"))
    turned = turned.select("n", F.expr("concat(substring(m, i + 1), left(m, i))").alias("r"))
    filed = turned.select("n", F.explode(F.array(F.struct(F.col("r").alias("key"), F.lit("").alias("skipped")), F.struct(F.expr("left(r, length(r) - 1)").alias("key"), F.right("r", F.lit(1)).alias("skipped")))).alias("x"))
    return filed.select("x.key", "x.skipped", "n").filter(F.col("skipped") != END)


def _word() -> Column:
    """The word of a filed rotation: what follows the terminator, the skipped character, what precedes it."""
    return F.concat(F.substring_index("key", END, -1), F.col("skipped"), F.substring_index("key", END, 1))


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) for each of words (word, n) with near words: their number, and the most frequent, the smallest on ties."""
    sorted_ = rotations(words).repartition("key").withColumn("word", _word())
    in_range = Window.partitionBy("key").orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first_of_run = (F.col("skipped") != "") & (F.col("skipped") != F.right("key", F.lit(1)))
    whole = F.col("skipped") == ""
    scanned = sorted_.select(
        "word", "n", "skipped", "key", F.count("*").over(in_range).alias("size"), F.count_if(whole).over(in_range).alias("shorter"), F.count_if(first_of_run).over(in_range).alias("longer"),
        *(F.nth_value(F.struct("n", "word"), k).over(in_range).alias(f"top{k}") for k in (1, 2)),
    ).filter("size > 1")
    near = F.when(whole, F.col("longer")).otherwise(F.col("size") - F.col("shorter") - 1 + F.when(first_of_run, F.col("shorter")).otherwise(0))
    top = F.when(F.col("top1.word") == F.col("word"), F.col("top2")).otherwise(F.col("top1"))
    pairs = scanned.select("word", near.alias("near"), F.struct((-top["n"]).alias("m"), top["word"].alias("word")).alias("top"))
    best = pairs.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("top").alias("top"))
    return best.select("word", "n_near", (-F.col("top.m")).alias("best_n"), F.col("top.word").alias("best"))


def roots(forms: DataFrame, steps: int) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last, which has none, in at most ``steps`` steps; the length of the paths doubles each round."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "forms")
    for _ in range(max(0, math.ceil(math.log2(max(1, steps))))):
        further = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = materialize(now.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "forms")
    return now


def spelling_variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n, root) per row of words (word, n; one row a word, others are ignored).

    Two words are near if they differ by exactly one inserted, deleted or replaced code point. form: the near word of
    largest n (ties: smallest in code-point order), if that is at least ``ratio`` (2 or more) times the word's own, else
    null. root: the last of the forms of the forms, the word itself without one; n grows by ``ratio`` a step, so the
    steps are bounded by a logarithm. No near words: n_near 0. Null words, words of no count and empty words are left out.
    Words may hold any character but "$". Empty table: empty result.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more: only then paths end")
    words = materialize(words.filter(f"word <> '' and n > 0 and instr(word, '{END}') = 0").select("word", F.col("n").cast("long").alias("n")), "words")
    near = materialize(words.join(neighbours(words), "word", "left").withColumn("form", F.expr(f"if(best_n >= {ratio} * n, best, null)")), "near")
    ends = near.agg(F.min("n"), F.max("n")).first()
    steps = math.ceil(math.log(ends[1] / ends[0], ratio)) + 1 if ends[0] else 0
    last = roots(near.filter("form is not null"), steps)
    return near.join(last, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", F.expr("if(form is null, null, best_n)").alias("form_n"), F.coalesce("root", "word").alias("root")
    )
