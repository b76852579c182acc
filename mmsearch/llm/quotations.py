"""Quotation linking for chat and mail text, with DataFrame functions only.

A line's quote level is the number of ``>`` before its text; a passage is a run of words of one level, whatever its
line breaks. Passages are normalised (lower case, single spaces) and hashed in windows of ``WINDOW`` words, so a
quote that a mail client wrapped anew or that was cut still meets its original; lines are hashed whole for what is
shorter. A quoted unit belongs to the latest earlier message of its conversation that holds it outside quotes.
Units link by an as-of window over (conversation, hash), in blocks of turns, so neither a line that every message
repeats nor one huge conversation makes pairs or fills one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize

#: Words of a passage that link at once.
WINDOW = 5
#: Turns that one window partition spans at most.
BLOCK = 4096
_BLANK = " \t\n\x0b\x0c\r"


def quote_level(line: Column) -> Column:
    mark = F.regexp_extract(line, r"^([ \t>]*)", 1)
    return F.length(mark) - F.length(F.replace(mark, F.lit(">"), F.lit("")))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), r"\r?\n")


def bare_words(line: Column) -> Column:
    """A line's normalised text without its marks: lower case, single spaces, "" for a blank one."""
    return F.btrim(F.regexp_replace(F.lower(F.regexp_replace(line, r"^[ \t>]*", "")), r"[ \t-\r]+", " "))


def unquoted(text: Column, linked: Column) -> Column:
    """A text without its linked quotes, its wordless quoted lines and the lines ending in ``wrote:`` before them.

    linked: one character a line, ``1`` for a quoted line that linked; a null or short string leaves the rest unlinked.
    Quoted lines that link to nothing stay as they are.
    """
    flags = F.split(F.coalesce(linked, F.lit("")), "")
    quoted = lambda x: F.coalesce(x.rlike(r"^[ \t]*>"), F.lit(False))
    mark = lambda x, f: F.struct(x.alias("line"), (quoted(x) & ((F.coalesce(f, F.lit("")) == "1") | (bare_words(x) == ""))).alias("gone"))
    lines = F.filter(F.zip_with(lines_of(text), flags, mark), lambda z: z["line"].isNotNull())
    pairs = F.zip_with(lines, F.slice(lines, 2, F.size(lines)), lambda z, after: F.struct(z["line"].alias("line"), z["gone"].alias("gone"), F.coalesce(after["gone"], F.lit(False)).alias("next")))
    kept = F.filter(pairs, lambda z: ~z["gone"] & ~(z["line"].rlike(r"wrote:[ \t]*$") & z["next"]))
    return F.btrim(F.array_join(F.transform(kept, lambda z: z["line"]), "\n"), F.lit(_BLANK))


def passage_units(rows: DataFrame, quoted: bool) -> DataFrame:
    """rows' columns but text, with (level, kind, hash, lines): the hashed units of the quoted or the unquoted passages.

    kind ``window``: WINDOW words in a row of one level; ``line``: a whole line; ``short`` (quoted only): a passage of
    fewer words than a window over several lines, hashed like one line. lines: numbers of the lines it stands on.
    """
    side = lambda level: level > 0 if quoted else level == 0
    line = lambda x, k: F.struct(quote_level(x).alias("level"), k.alias("k"), bare_words(x).alias("bare"))
    own = [c for c in rows.columns if c != "text"]
    at = rows.select(*own, F.filter(F.transform(lines_of(F.col("text")), line), lambda z: z["bare"] != "").alias("__lines"))
    word = lambda z: F.transform(F.split(z["bare"], " "), lambda w: F.struct(z["level"].alias("level"), z["k"].alias("k"), w.alias("word")))
    at = at.select(*own, "__lines", F.flatten(F.transform("__lines", word)).alias("__w0"))
    shifted = [F.slice("__w0", i + 1, F.size("__w0")).alias(f"__w{i}") for i in range(1, WINDOW)]
    start = F.array(F.struct(F.lit(-1).alias("level"), F.lit(-1).alias("k"), F.lit("").alias("word")))
    at = at.select(*own, "__lines", "__w0", *shifted, F.concat(start, "__w0").alias("__before"))
    at = at.select(*own, "__lines", F.arrays_zip(*(f"__w{i}" for i in range(WINDOW)), "__before").alias("__at"))

    def run(z: Column) -> list[Column]:
        """The words at and after a place while they are of its level, nulls after."""
        words, same = [z["__w0"]], F.lit(True)
        for i in range(1, WINDOW):
            same = same & F.coalesce(z[f"__w{i}"]["level"] == z["__w0"]["level"], F.lit(False))
            words.append(F.when(same, z[f"__w{i}"]))
        return words

    unit = lambda level, kind, value, lines: F.struct(level.alias("level"), F.lit(kind).alias("kind"), value.alias("hash"), F.array_distinct(F.array_compact(F.array(*lines))).alias("lines"))
    held = F.filter("__at", lambda z: z["__w0"].isNotNull() & side(z["__w0"]["level"]))
    whole = F.filter(held, lambda z: run(z)[-1].isNotNull())
    windows = F.transform(whole, lambda z: unit(z["__w0"]["level"], "window", F.xxhash64(*(z[f"__w{i}"]["word"] for i in range(WINDOW))), [z[f"__w{i}"]["k"] for i in range(WINDOW)]))
    lines = F.transform(F.filter("__lines", lambda z: side(z["level"])), lambda z: unit(z["level"], "line", F.xxhash64(z["bare"]), [z["k"]]))
    units = [windows, lines]
    if quoted:
        short = F.filter(held, lambda z: (z["__before"]["level"] != z["__w0"]["level"]) & run(z)[-1].isNull())
        shorts = F.transform(short, lambda z: unit(z["__w0"]["level"], "short", F.xxhash64(F.concat_ws(" ", *(w["word"] for w in run(z)))), [w["k"] for w in run(z)]))
        units.append(F.filter(shorts, lambda u: F.size(u["lines"]) > 1))
    return at.select(*own, F.explode(F.concat(*units)).alias("__u")).select(*own, "__u.*")


def latest(points: DataFrame, keys: list[str], value: Column, name: str, strict: bool = True) -> DataFrame:
    """Adds, within the keys, the greatest non-null value of rows with a smaller ``turn`` (not strict: or an equal one).

    value must ascend with turn. Each block of turns has its own window; what earlier blocks hold comes from
    their maxima, one row a block.
    """
    points = points.withColumn("__v", value).withColumn("__block", F.floor(F.col("turn") / BLOCK))
    own = F.max("__v").over(Window.partitionBy(*keys, "__block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1 if strict else 0))
    tops = points.groupBy(*keys, "__block").agg(F.max("__v").alias("__top"))
    before = F.max("__top").over(Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    tops = tops.withColumn("__before", before).drop("__top")
    return points.withColumn("__own", own).join(tops, [*keys, "__block"]).withColumn(name, F.coalesce("__own", "__before")).drop("__v", "__block", "__own", "__before")


def link_quotes(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, id, level, kind, lines, from) of the quoted units that an earlier message holds outside quotes.

    rows: (conv_id, turn, id, text), id telling different texts of a message apart. Only conversations with quotes are
    looked at; the units of their unquoted passages are reduced to those that are quoted before anything is ordered.
    """
    rows = rows.filter("conv_id is not null and turn is not null")
    quoting = rows.filter(F.col("text").rlike(r"(?m)^[ \t]*>"))
    quotes = passage_units(quoting.dropDuplicates(["conv_id", "turn", "id"]), True)
    wanted = quotes.select("conv_id", "hash").distinct()
    candidates = rows.join(quoting.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", "turn", "text")
    originals = passage_units(candidates, False).select("conv_id", "hash", "turn").join(wanted, ["conv_id", "hash"], "left_semi").distinct()
    points = originals.withColumn("source", F.col("turn")).withColumn("asks", F.lit(False))
    points = points.unionByName(quotes.select("conv_id", "hash", "turn", F.lit(None).cast("long").alias("source"), F.lit(True).alias("asks")).distinct())
    found = latest(points, ["conv_id", "hash"], F.col("source"), "from").filter("asks and from is not null").select("conv_id", "hash", "turn", "from")
    return quotes.join(found, ["conv_id", "hash", "turn"]).drop("hash")


def parents(links: DataFrame) -> DataFrame:
    """(conv_id, turn, parent): of the lowest level with any link, the message that most word windows come from, then
    most lines, ties to the latest."""
    count = lambda kind: F.sum((F.col("kind") == kind).cast("long"))
    votes = links.groupBy("conv_id", "turn", "level", "from").agg(count("window").alias("windows"), count("line").alias("n"))
    return votes.groupBy("conv_id", "turn").agg(F.max_by("from", F.struct(-F.col("level"), "windows", "n", "from")).alias("parent"))


def linked_lines(links: DataFrame) -> DataFrame:
    """(conv_id, turn, id, linked, n): per text one character a line up to its last linked one, 1 for linked; their number."""
    numbers = links.select("conv_id", "turn", "id", F.explode("lines").alias("k")).groupBy("conv_id", "turn", "id").agg(F.sort_array(F.collect_set("k")).alias("ks"))
    gaps = F.zip_with("ks", F.concat(F.array(F.lit(-1)), F.slice("ks", 1, F.size("ks") - 1)), lambda k, before: F.concat(F.repeat(F.lit("0"), k - before - 1), F.lit("1")))
    return numbers.select("conv_id", "turn", "id", F.array_join(gaps, "").alias("linked"), F.size("ks").cast("long").alias("n"))


def reply_order(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, quote_level, quoted_lines, linked_lines, reply_to, branch, branch_parent, position, text).

    A message replies to the message it quotes (see ``link_quotes``), else to the one before it. A branch
    begins at a conversation's first message and at every reply to another message than the one before; it is
    named by the turn it begins at. position counts from 0 within the branch, so a conversation in reply order
    is branch_parent's branch up to branch_parent, then the branch. text is without the quotes that linked; quotes of
    something that no earlier message says stay in it.

    quote_level: the deepest, quoted_lines: all quoted lines with text, linked_lines: those of them that linked. Null
    text: no line, text "". Null conv_id or turn: the row stays, unlinked, without reply_to, branch and position. Rows
    that repeat (conv_id, turn) are one message: its different texts link together and share its place and
    linked_lines, each keeps its own text. Further columns are ignored. Empty table: empty result.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("id", F.xxhash64("text"))
    links = materialize(link_quotes(rows.select("conv_id", "turn", "id", "text")), "quotes")
    marks = linked_lines(links)
    totals = marks.groupBy("conv_id", "turn").agg(F.sum("n").alias("linked_lines"))
    found = parents(links).join(totals, ["conv_id", "turn"])
    turns = rows.select("conv_id", "turn").filter("conv_id is not null and turn is not null").distinct()
    turns = turns.withColumn("__block", F.floor(F.col("turn") / BLOCK))
    sizes = turns.groupBy("conv_id", "__block").agg(F.count("*").alias("__n"))
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy("conv_id").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    ranked = turns.withColumn("__rank", F.row_number().over(Window.partitionBy("conv_id", "__block").orderBy("turn"))).join(sizes, ["conv_id", "__block"]).select("conv_id", "turn", (F.col("__before") + F.col("__rank") - 1).alias("rank"))
    known = latest(ranked, ["conv_id"], F.col("turn"), "previous").join(found, ["conv_id", "turn"], "left")
    begins = F.col("previous").isNull() | (F.col("parent") != F.col("previous"))
    placed = latest(known, ["conv_id"], F.when(begins, F.struct("turn", "rank", "parent")), "start", strict=False)
    placed = placed.select("conv_id", "turn", F.coalesce("linked_lines", F.lit(0)).cast("long").alias("linked_lines"), F.coalesce("parent", "previous").alias("reply_to"), F.col("start.turn").alias("branch"), F.col("start.parent").alias("branch_parent"), (F.col("rank") - F.col("start.rank")).cast("long").alias("position"))
    lines = lines_of(F.col("text"))
    level = F.array_max(F.transform(lines, quote_level)).cast("long")
    quoted = F.size(F.filter(lines, lambda x: (quote_level(x) > 0) & (bare_words(x) != ""))).cast("long")
    has = F.coalesce(F.col("text").rlike(r"(?m)^[ \t]*>"), F.lit(False))
    plain = rows.filter(~has).select("conv_id", "turn", "role", F.lit(0).cast("long").alias("quote_level"), F.lit(0).cast("long").alias("quoted_lines"), F.btrim(F.coalesce("text", F.lit("")), F.lit(_BLANK)).alias("text"))
    marked = rows.filter(has).join(marks.drop("n"), ["conv_id", "turn", "id"], "left")
    made = plain.unionByName(marked.select("conv_id", "turn", "role", level.alias("quote_level"), quoted.alias("quoted_lines"), unquoted(F.col("text"), F.col("linked")).alias("text")))
    out = made.join(placed, ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", "quote_level", "quoted_lines", F.coalesce("linked_lines", F.lit(0)).cast("long").alias("linked_lines"), "reply_to", "branch", "branch_parent", "position", "text")
