"""Column functions on text and paths."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: White space as Python's str.split takes it, and the class of it for regular expressions.
WS_CHARS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
WS = f"[{WS_CHARS}]+"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def normalize_query(c: Column) -> Column:
    """Null to empty, stripped, lower-cased, white space collapsed."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), WS, " "))


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), WS), lambda w: w != "")


def top_token_share(c: Column) -> Column:
    """Share of the most frequent lower-cased token; null without tokens. Runs of the sorted tokens are counted, no shuffle."""
    words = F.array_sort(tokens(c))
    zero = F.struct(F.lit(None).cast("string").alias("w"), F.lit(0).alias("n"), F.lit(0).alias("best"))

    def step(a, w):
        n = F.when(a["w"] == w, a["n"] + 1).otherwise(F.lit(1))
        return F.struct(w.alias("w"), n.alias("n"), F.greatest(a["best"], n).alias("best"))

    best = F.aggregate(words, zero, step, lambda a: a["best"])
    return F.when(F.size(words) > 0, best / F.size(words))


#: Characters of a text that are counted at a time.
PIECE = 1 << 20


def word_counts(text: str) -> Counter:
    """How often each token of a text occurs; memory follows its distinct tokens and one piece, not the text."""
    if len(text) <= PIECE:
        return Counter(text.split())
    found, at, space = Counter(), 0, re.compile(r"\s")
    while at < len(text):
        gap = space.search(text, at + PIECE)
        stop = gap.start() if gap else len(text)
        found.update(text[at:stop].split())
        at = stop
    return found


@F.arrow_udf(DoubleType())
def _top_share(lowered: pa.Array) -> pa.Array:
    """One text of the batch at a time is a Python string."""

    def share(text: str | None) -> float | None:
        found = word_counts(text) if text else None
        return max(found.values()) / found.total() if found else None

    return pa.array([share(t.as_py()) for t in lowered], pa.float64())


def exact_top_share(c: Column) -> Column:
    """As top_token_share, by counting the tokens of a text in an Arrow task instead of sorting them in the row."""
    return _top_share(F.lower(c))


def creator_of(path: Column) -> Column:
    """Name of the parent directory."""
    return F.element_at(F.split(path, "/"), -2)


def profile_url(base: str, username: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/@"), username)


def video_url(base: str, username: Column, video_id: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/@"), username, F.lit("/video/"), video_id)


def rel_path(path: Column, root: str) -> Column:
    """path relative to root, with forward slashes."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    head = root.replace("\\", "/").rstrip("/") + "/"
    return F.when(slashed.startswith(head), F.substring(slashed, len(head) + 1, 2**31 - 1)).otherwise(slashed)


def preview(c: Column, n: int = 100, missing: str = "No transcription") -> Column:
    return F.coalesce(F.nullif(F.substring(c, 1, n), F.lit("")), F.lit(missing))
