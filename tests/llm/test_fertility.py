import random
from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken  # noqa: F401

from mmsearch.llm import fertility as ft

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def brute(text):
    text = text or ""
    w = [x.decode() for x in text.encode().split()]
    spans = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + j for k in range(len(w) - 2) if spans[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if line.encode().split():
            dup += line in lines
            lines.add(line)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def rows():
    rng = random.Random(2)
    vocab = ["the", "cat", "été", "#", "a|b", "über", "sat", "mat"] + [f"word{k}" for k in range(40)]
    out = []
    for k in range(60):
        text = "".join(rng.choice(vocab) + rng.choice([" ", " ", "\n", "\t"]) for _ in range(rng.randint(0, 160)))
        out.append((k, text * rng.choice([1, 1, 3]), rng.choice(["en", "de", "xx", None])))
    return out + [(100, None, "en"), (101, "", None), (102, " \n\n", "fr"), (103, "word " * 20000, "en"), (103, "日本語の文章" * 40, None)]


def test_base_rules_and_measures_match_brute_force(spark):
    data = rows()
    got = ft.quality(spark.createDataFrame(data, "doc_id long, text string, lang string"), PATH, PATTERN).collect()
    encoding, part = ft._vocabulary(PATH, PATTERN)
    assert len(got) == len(data)
    for r, (i, text, lang) in zip(sorted(got, key=lambda r: (r.doc_id, r.n_words)), sorted(data, key=lambda x: (x[0], len((x[1] or "").split()))), strict=True):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(text), i
        ids = encoding.encode_ordinary(text or "")
        assert r.n_tokens == len(ids)
        if ids:
            p = np.array(list(Counter(ids).values())) / len(ids)
            most = np.log2(min(len(ids), len(part)))
            assert abs(r.token_entropy - (-(p * np.log2(p)).sum() / most if most else 1.0)) < 1e-9
            broken = sum(b"\xef\xbf\xbd" in encoding.decode_single_token_bytes(k).decode(errors="replace").encode() and not encoding.decode_single_token_bytes(k).decode(errors="ignore").encode() == encoding.decode_single_token_bytes(k) for k in ids)
            assert abs(r.byte_fallback_share - broken / len(ids)) < 1e-9
        assert r.kept == (not r.base_failed and ft.verdict(r.chars_per_token, r.byte_fallback_share, r.token_entropy, r.n_tokens, ft.BANDS[r.band]))


def test_bands_reject_what_a_vocabulary_does_not_know(spark):
    rng = random.Random(1)
    vocab = "the weather in this small town was never very good but people went out and said what they liked about it".split()
    clean = " ".join(rng.choice(vocab) for _ in range(150))
    noise = " ".join("".join(chr(rng.randrange(0x1200, 0x1360)) for _ in range(8)) for _ in range(80))
    one = " ".join(["a"] + [f"{'a' * (k + 1)}" for k in range(60)])
    docs = spark.createDataFrame([(1, clean, "en"), (2, noise, "en"), (3, one, "en")], "doc_id long, text string, lang string")
    kept = {r.doc_id: r.kept for r in ft.quality(docs, PATH, PATTERN).collect()}
    assert kept[1] and not kept[2]
    assert {r.doc_id for r in ft.keep_good(docs, PATH, PATTERN).collect()} == {k for k, v in kept.items() if v}


def test_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "x " * 10, 5, "no")], "doc_id long, text string, n_words long, kept string")
    assert ft.quality(docs, PATH, PATTERN).first().n_words == 10
    assert ft.keep_good(docs, PATH, PATTERN).columns == docs.columns
    assert ft.quality(docs.filter("doc_id > 1"), PATH, PATTERN).count() == 0 and ft.keep_good(docs.filter("doc_id > 1"), PATH, PATTERN).count() == 0
    assert ft.script_of("Привет мир") == "cyrillic" and ft.script_of("12 !") == ""


CLEAN = {
    "zh": "今天天气很好,我们一起去公园散步。那里有很多人在唱歌跳舞,孩子们在草地上玩耍,老人们坐在长椅上聊天。中午我们在附近的小饭馆吃了面条,味道非常不错,然后坐地铁回家休息。",
    "ko": "오늘은 날씨가 아주 좋아서 친구들과 함께 공원에 산책하러 갔습니다. 많은 사람들이 노래하고 춤을 추었고 아이들은 잔디밭에서 놀고 있었습니다. 우리는 점심을 먹었습니다.",
    "hi": "आज मौसम बहुत अच्छा है, इसलिए हम सब पार्क में घूमने गए। वहाँ बहुत से लोग गा रहे थे और नाच रहे थे, बच्चे घास पर खेल रहे थे और बूढ़े लोग बैठकर बातें कर रहे थे।",
    "th": "วันนี้อากาศดีมาก เราจึงไปเดินเล่นที่สวนสาธารณะด้วยกัน มีคนมากมายร้องเพลงและเต้นรำ เด็กๆ เล่นอยู่บนสนามหญ้า และคนแก่นั่งคุยกันบนม้านั่ง",
    "he": "היום מזג האוויר יפה מאוד ולכן הלכנו כולנו לטייל בפארק. הרבה אנשים שרו ורקדו, הילדים שיחקו על הדשא והזקנים ישבו על הספסלים ודיברו.",
}


def test_one_latin_letter_does_not_make_a_text_latin():
    for k, text in CLEAN.items():
        band = "cjk" if k in ("zh", "ko") else ""
        assert {ft.script_of(text * 50 + tail) for tail in ("", "a", "\u00a0", "\u00b0")} == {band}
    assert ft.script_of("été ×" + "\u00a0" * 9) == "latin" and ft.script_of("\u00a0\u00b0") == ""


def test_bands_of_cjk_and_other_scripts_tell_clean_from_noisy_texts():
    rng = random.Random(1)
    encoding, part = ft._vocabulary(PATH, PATTERN)

    def accepted(text):
        ids = np.array(encoding.encode_ordinary(text))
        band = ft.BANDS[ft.script_of(text)]
        assert len(ids) >= band.min_tokens
        return ft.verdict(*ft.measure(ids, len(text), part), len(ids), band)

    assert all(accepted(f"{text} {text}\u00a0a") for text in CLEAN.values())
    for lo, hi in ((0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0x904, 0x94D), (0x2190, 0x2600), (0x1F300, 0x1F640)):
        assert not accepted("".join(chr(rng.randrange(lo, hi)) for _ in range(300)))


AMHARIC = "ዛሬ አየሩ በጣም ጥሩ ነው ስለዚህ ሁላችንም አብረን ወደ መናፈሻ ሄድን። ብዙ ሰዎች እየዘፈኑ እና እየጨፈሩ ነበር፣ ልጆች በሣር ላይ ይጫወቱ ነበር፣ ሽማግሌዎችም ተቀምጠው ይነጋገሩ ነበር።"


def test_a_script_that_the_vocabulary_does_not_know_is_no_reason(spark):
    rng = random.Random(4)
    words = AMHARIC.split()
    clean = " ".join(rng.choice(words) for _ in range(90))
    strewn = " ".join("".join(chr(rng.randrange(0x904, 0x940)) for _ in range(8)) for _ in range(80))
    mixed = " ".join("".join(chr(rng.choice([rng.randrange(0x1200, 0x1248), rng.randrange(0x13A0, 0x13F0), rng.randrange(0x1401, 0x1600)])) for _ in range(8)) for _ in range(80))
    same = " ".join(f"{words[0]}{words[0] * (k % 60)}" for k in range(90))
    docs = spark.createDataFrame([(1, clean, "am"), (2, clean, None), (3, strewn, None), (4, mixed, None), (5, same, None), (6, clean, "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.kept, r.band) for r in ft.quality(docs, PATH, PATTERN).collect()}
    assert got[1] == got[2] == (True, "unknown")
    assert got[3] == (False, "") and got[4] == (False, "") and got[5] == (False, "unknown") and got[6] == (False, "en")
    known = ft.known_scripts(PATH, PATTERN)
    assert {"LATIN", "CYRILLIC", "DEVANAGARI", "HEBREW", "THAI"} <= known and "ETHIOPIC" not in known
    assert not ft.unknown_script("", known) and not ft.unknown_script("123 !", known)
