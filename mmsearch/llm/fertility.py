"""Quality rules by tokeniser fertility, beside plain base rules on words and lines.

A public byte-level vocabulary splits every whole text. Three measures follow: characters per token (the
fertility), the share of byte-fallback tokens (tokens that aren't whole characters: the vocabulary had to
fall back to single bytes of one) and the entropy of the text's token histogram in bits, over the greatest
entropy that so many tokens of the vocabulary can have. A band per language, or per script where the
language is unknown, says which values pass.
"""

from __future__ import annotations

import base64
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Words, chunks


@dataclass(frozen=True)
class Band:
    """Accepted values, ends included. Texts under ``min_tokens`` tokens are too short to be measured and pass."""

    chars_per_token: tuple[float, float]
    max_fallback: float
    min_entropy: float
    min_tokens: int = 50


#: Text in a Latin-script language has well over two characters a token of a 50k multilingual vocabulary; strings of symbols don't.
LATIN = Band((2.0, 8.0), 0.15, 0.35)
#: By language code, then by script of most letters, then "": anything else. Measured with the 50k multilingual vocabulary:
#: clean Chinese, Japanese and Korean have 1.0 to 1.7 characters a token and 0.23 to 0.30 fallback, random characters 0.43 to
#: 0.49 and 0.98 to 0.99; clean Hindi, Thai and Hebrew 0.9 to 1.7 and 0.07 to 0.61, random ones, symbols and emoji 0.33 to 0.55
#: and 0.90 to 1.0. A script that the vocabulary doesn't know at all (Ethiopic) looks like the latter whatever a text says, so
#: "unknown" judges neither its fallback nor, closely, its characters a token.
BANDS = {
    "en": Band((2.0, 8.0), 0.10, 0.35), "de": LATIN, "fr": LATIN, "es": LATIN,
    "latin": LATIN, "cyrillic": Band((0.6, 6.0), 0.6, 0.35), "greek": Band((0.5, 6.0), 0.8, 0.35),
    "arabic": Band((0.5, 6.0), 0.8, 0.35), "cjk": Band((0.55, 3.0), 0.7, 0.3), "": Band((0.55, 10.0), 0.8, 0.3),
    "unknown": Band((0.25, 10.0), 1.0, 0.3),
}
_SCRIPTS = (("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("arabic", 0x600, 0x6FF), ("cjk", 0x3040, 0x9FFF), ("cjk", 0xAC00, 0xD7A3))
#: Shares of a text that tell writing in a script without a band from strewn characters: letters of one script among all
#: letters, and letters, marks and blanks among all characters. A vocabulary knows a script from KNOWN tokens on.
ONE_SCRIPT, WRITTEN, KNOWN = 0.9, 0.7, 5
_LETTER = np.array([chr(c).isalpha() for c in range(0x110000)])
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_BLANK = " \t\n\x0b\x0c\r"

_loaded: dict = {}
_known: dict = {}


def _vocabulary(path: str, pattern: str):
    """(tiktoken encoding, flags of tokens that aren't whole characters)."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        part = np.zeros(max(ranks.values()) + 1, bool)
        for token, k in ranks.items():
            try:
                token.decode()
            except UnicodeDecodeError:
                part[k] = True
        _loaded[path] = tiktoken.Encoding("fertility", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), part
    return _loaded[path]


def script_of(text: str) -> str:
    """The script of most of the text's letters; "" without letters or if all scripts without a band have more together."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    codes = codes[_LETTER[codes]]
    counts: dict[str, int] = {}
    for name, lo, hi in _SCRIPTS:
        counts[name] = counts.get(name, 0) + int(((codes >= lo) & (codes <= hi)).sum())
    best = max(counts, key=counts.get)
    return best if counts[best] and counts[best] >= len(codes) - sum(counts.values()) else ""


def letter_scripts(text: str) -> tuple[dict[str, int], int]:
    """(letters per script, by the first word of their Unicode names; letters, marks and blanks together)."""
    codes, counts = np.unique(np.frombuffer(text.encode("utf-32-le"), np.uint32), return_counts=True)
    scripts: dict[str, int] = {}
    written = 0
    for code, n in zip(codes.tolist(), counts.tolist(), strict=True):
        c = chr(code)
        kind = unicodedata.category(c)
        if kind[0] == "L":
            script = unicodedata.name(c, "?").split()[0]
            scripts[script] = scripts.get(script, 0) + n
        written += n * (kind[0] in "LMZ" or c in _BLANK)
    return scripts, written


def known_scripts(path: str, pattern: str) -> frozenset[str]:
    """Scripts that the vocabulary has at least ``KNOWN`` tokens of: whole letters, others than single bytes."""
    if path not in _known:
        encoding, part = _vocabulary(path, pattern)
        tokens: dict[str, int] = {}
        for k in np.flatnonzero(~part).tolist():
            try:
                token = encoding.decode_single_token_bytes(k).decode()
            except KeyError:
                continue
            for script in {unicodedata.name(c, "?").split()[0] for c in token if c.isalpha()}:
                tokens[script] = tokens.get(script, 0) + 1
        _known[path] = frozenset(s for s, n in tokens.items() if n >= KNOWN)
    return _known[path]


def unknown_script(text: str, known: frozenset[str]) -> bool:
    """Whether a text is written in one script that the vocabulary doesn't know."""
    scripts, written = letter_scripts(text)
    best = max(scripts, key=scripts.get, default=None)
    return best is not None and best not in known and scripts[best] >= ONE_SCRIPT * sum(scripts.values()) and written >= WRITTEN * len(text)


def measure(tokens: np.ndarray, chars: int, part: np.ndarray) -> tuple[float, float, float]:
    """(characters per token, byte-fallback share, entropy over its greatest value) of one text."""
    n = len(tokens)
    if not n:
        return 0.0, 0.0, 0.0
    counts = np.bincount(tokens)
    p = counts[counts > 0] / n
    most = np.log2(min(n, len(part)))
    return chars / n, float(part[tokens].sum()) / n, float(-(p * np.log2(p)).sum() / most) if most else 1.0


def verdict(cpt: float, fallback: float, entropy: float, n_tokens: int, band: Band) -> bool:
    lo, hi = band.chars_per_token
    return n_tokens < band.min_tokens or (lo <= cpt <= hi and fallback <= band.max_fallback and entropy >= band.min_entropy)


def repeated_words(w: Words, size: int = 3) -> np.ndarray:
    """Per row the number of words inside windows of ``size`` words that occur twice or more in the row."""
    h, start = w.grams(size)
    row = w.row[start]
    by = np.lexsort((h, row))
    h, row, start = h[by], row[by], start[by]
    same = np.zeros(len(h) + 1, bool)
    same[1:-1] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    hit = start[same[:-1] | same[1:]]
    covered = np.zeros(len(w.hash), bool)
    for j in range(size):
        covered[hit + j] = True
    return np.bincount(w.row[covered], minlength=w.rows)


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line of the text."""
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if line.strip(_BLANK):
            n += line in seen
            seen.add(line)
    return n


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "n_tokens long, chars_per_token double, byte_fallback_share double, token_entropy double, band string"
)
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def _rules(path: str, pattern: str, bands: dict[str, Band]):
    def run(batches):
        encoding, part = _vocabulary(path, pattern)
        for batch in batches:
            lang = batch.column("lang").to_pylist()
            for a, b, raw, at in chunks(batch):
                w = Words(raw, at)
                sums = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[at])  # noqa: B023, E731
                lead = (raw & 0xC0) != 0x80
                chars, word_chars, symbols = sums(lead), sums(lead & w.inside[:-1]), sums(_SYMBOL[raw])
                repeats = repeated_words(w)
                failed = (w.count < 50) | (100 * repeats > 50 * w.count)
                body = raw.tobytes()
                rows = []
                for r in range(b - a):
                    text = body[at[r] : at[r + 1]].decode()
                    tokens = np.array(encoding.encode_ordinary(text), np.int64)
                    m = measure(tokens, int(chars[r]), part)
                    name = lang[a + r] if lang[a + r] in bands else script_of(text)
                    name = name if name in bands else ""
                    if not name and "unknown" in bands and unknown_script(text, known_scripts(path, pattern)):
                        name = "unknown"
                    ok = verdict(*m, len(tokens), bands[name])
                    rows.append((duplicate_lines(text), bool(ok and not failed[r]), len(tokens), *m, name))
                dup, kept, n, cpt, fall, ent, name = zip(*rows, strict=True)
                cols = [batch.column("doc_id").slice(a, b - a), *(pa.array(x, pa.int64()) for x in (w.count, word_chars, symbols, dup, repeats)), pa.array(failed), pa.array(kept), pa.array(n, pa.int64()), *(pa.array(x, pa.float64()) for x in (cpt, fall, ent)), pa.array(name, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, _NAMES)

    return run


def quality(docs: DataFrame, path: str, pattern: str, bands: dict[str, Band] | None = None) -> DataFrame:
    """Base rules and fertility verdict per row of docs (columns doc_id, text, lang; others are ignored).

    ``path``: ranks of a byte-level vocabulary (.tiktoken), ``pattern`` its split, readable on every worker.
    base_failed: under 50 words, or more than half of the words in repeated 3-word windows. kept: not
    base_failed, and inside the band of the row's lang, or of its script for a null or unknown lang.
    A text in one script that the vocabulary doesn't know (see ``unknown_script``) is judged by its token entropy.

    Null or blank text: 0 words, base_failed. Any doc_id, null or repeated, gets its row. Whole texts of any
    length are measured. Empty table: empty result.
    """
    bands = BANDS if bands is None else bands
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang"))
    return docs.mapInArrow(_rules(path, pattern, bands), SCHEMA)


def keep_good(docs: DataFrame, path: str, pattern: str, bands: dict[str, Band] | None = None) -> DataFrame:
    """The rows of docs that ``quality`` keeps, with docs' own columns, in one pass without a shuffle.

    docs may hold any further columns, whatever their names.
    """
    bands = BANDS if bands is None else bands
    rules = _rules(path, pattern, bands)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            lang = batch.column("lang") if "lang" in batch.schema.names else pa.nulls(n, pa.string())
            thin = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), batch.column("text"), lang], ["doc_id", "text", "lang"])
            kept = [x.column("kept") for x in rules([thin])]
            yield batch.filter(pa.concat_arrays(kept))

    return docs.mapInArrow(run, docs.schema)
