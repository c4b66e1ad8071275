"""What subtitle texts are like, and what of them counts for a comparison, as column expressions.

Texts are normalised first (``text.normalize_text``). Ratios and lengths count code points; null counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import let, normalize_text

# Letters, signs and words that the rules name.
CJK = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2EBEF}]"
CJK_OR_SIGN = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2EBEF}，。！？：；、“”‘’（）《》【】]"
LATIN_OR_SIGN = r"""[A-Za-z.,!?;:'"()-]"""
ALL_CAPS = r"^[A-Z0-9 '&:,.!?-]+$"
PROMPTS = ("跳跃", "查看", "按住", "查看：按住", "查看，按住", "查看:按住", "查看：按住△")
PROMPT_WORDS = "查看|按住|跳跃|冲刺|翻滚|招架|攻击|防御"
STAGE_WORDS = "laugh|chuckle|sob|cry|wail|grunt|gasp|scream|shiver|snarl|sneer|wince|noise|发抖|啜泣|厌恶声|沮丧声|笑|哭|哀号|呻吟"
ZH_SOUNDS = "尖叫|低哼|喘气|呼吸起伏|哼声|笑|呻吟|痛苦|惊呼|怒吼|哭喊|惨叫"
EN_SOUNDS = r"(?i)\b(?:screaming|grunts?|panting|chuckles|laughs?|groans?|gasps?|shouts?|cries?|fearful|pained)\b"
ZH_PLACE = "^[一-龥]{2,8}(?:谷|城|寨|河|瀑布|客栈|巢穴|神社) *"
EN_SPEAKER = "[A-Z][A-Za-z' .-]{0,30}:"
EN_UI = r"^[A-Z][A-Z0-9]+(?: [A-Z0-9]+){0,3} +(?=[A-Z][A-Za-z' .-]{0,30}:)"
IN_BRACKETS = r"^[(\[（【].*[)\]】）]$"
ENDS = "，。！？：: "


def _bare(text: Column) -> Column:
    return F.replace(normalize_text(text), F.lit(" "), F.lit(""))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _share(text: Column, pattern: str) -> Column:
    return _share_of(_bare(text), pattern)


def _share_of(bare: Column, pattern: str) -> Column:
    return F.when(F.length(bare) == 0, F.lit(0.0)).otherwise(_count(bare, pattern) / F.length(bare))


def chinese_ratio(text: Column) -> Column:
    """Share of ideographs and full-width signs among the characters that aren't blank."""
    return _share(text, CJK_OR_SIGN)


def latin_ratio(text: Column) -> Column:
    """Share of Latin letters and their signs among the characters that aren't blank."""
    return _share(text, LATIN_OR_SIGN)


def is_cjk(char: Column) -> Column:
    return char.rlike("^" + CJK)


def cjk_count(text: Column) -> Column:
    return _count(F.coalesce(text, F.lit("")), "[一-鿿]")


def ascii_alpha_count(text: Column) -> Column:
    return _count(F.coalesce(text, F.lit("")), "[A-Za-z]")


def word_count(text: Column) -> Column:
    return _count(F.coalesce(text, F.lit("")), r"(?U)\S+")


def looks_like_subtitle(text: Column, language: str = "ch") -> Column:
    return _reads(normalize_text(text), _bare(text), language)


def _reads(t: Column, bare: Column, language: str = "ch") -> Column:
    """``looks_like_subtitle`` of a normalised text, and the same without blanks."""
    if language == "en":
        return (F.length(bare) >= 3) & t.rlike("[A-Za-z]") & (_share_of(bare, LATIN_OR_SIGN) >= 0.45)
    return (F.length(t) >= 2) & t.rlike(r"[\x{3400}-\x{9FFF}\x{FF01}-\x{FF5E}]") & (_share_of(bare, CJK_OR_SIGN) >= 0.45)


def _normalised(text: Column, body) -> Column:
    """``body(t, bare)`` of a text normalised once, and the same without blanks."""
    return let(normalize_text(text), lambda t: let(F.replace(t, F.lit(" "), F.lit("")), lambda bare: body(t, bare)))


def gameplay_prompt(text: Column) -> Column:
    bare = _bare(text)
    return bare.isin(*PROMPTS) | (bare.rlike("^查看[：，:]") & F.contains(bare, F.lit("按住")))


def multi_part(text: Column) -> Column:
    """Two speakers or two sentence ends."""
    t = normalize_text(text)
    return (_count(t, "[：:]") >= 2) | (_count(t, "[。！?？]") >= 2)


def stage_direction(text: Column) -> Column:
    t = F.lower(normalize_text(text))
    return t.rlike("[(（]") & t.rlike(STAGE_WORDS)


def question(text: Column) -> Column:
    return normalize_text(text).rlike("[?？]")


def repeated_phrase(text: Column) -> Column:
    """Whether two or more characters stand three times in a row."""
    return _bare(text).rlike(r"(.{2,})\1\1")


def explicit_speaker(text: Column) -> Column:
    t = normalize_text(text)
    before = lambda sign: F.trim(F.substring_index(t, sign, 1))
    narrow = let(before(":"), lambda x: F.length(x).between(1, 30) & x.rlike(r"^\p{L}"))
    return F.when(F.contains(text, F.lit("：")), F.length(before("：")).between(1, 12)).when(F.contains(text, F.lit(":")), narrow).otherwise(F.lit(False))


def chinese_speaker(text: Column) -> Column:
    """What stands before the first colon, if it is at most 12 characters without a blank; else null."""
    return F.nullif(F.regexp_extract(normalize_text(text), r"^([^：:\s]{1,12})[：:]", 1), F.lit(""))


def english_speakers(text: Column, names: dict[str, str]) -> Column:
    """The distinct mapped names of all speakers in a text: by the whole name, or else by a name it begins with."""
    raw = F.transform(F.regexp_extract_all(normalize_text(text), F.lit("(" + EN_SPEAKER[:-1] + "):"), F.lit(1)), lambda x: F.lower(F.trim(F.regexp_replace(x, r"\s+", " "))))

    def mapped(name: Column) -> Column:
        exact = [F.when(name == k, F.lit(v)) for k, v in names.items()]
        return F.coalesce(*exact, *(F.when(F.startswith(name, F.lit(k)), F.lit(v)) for k, v in names.items()), F.lit(None).cast("string"))

    return F.array_distinct(F.array_compact(F.transform(raw, mapped))) if names else F.array().cast("array<string>")


def speakers_compatible(english: Column, chinese: Column, names: dict[str, str]) -> Column:
    """True where a side names no speaker; else whether a name of one side begins with the other's."""
    own, others = chinese_speaker(chinese), english_speakers(english, names)
    agree = F.exists(others, lambda x: F.startswith(own, x) | F.startswith(x, own))
    return own.isNull() | (F.size(others) == 0) | agree


def speakers_disjoint(a: Column, b: Column) -> Column:
    """Whether two arrays of speakers have none in common; false if either is empty."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def contains_substance(container: Column, content: Column) -> Column:
    """Whether one text, without blanks and end signs, holds the other; empty ones hold and are held by nothing."""
    a, b = (F.rtrim(_bare(x), F.lit("。！？!?，,：:")) for x in (container, content))
    return (a != "") & (b != "") & F.contains(a, b)


def prepared_chinese(text: Column, allow_gameplay: bool = False) -> Column:
    """What of a Chinese cue is compared: no speaker, no dots at the ends; short prompts give nothing."""
    t = F.regexp_replace(normalize_text(text), r"^[^：:\s]{1,8}[：:]\s*", "")
    t = F.btrim(F.replace(F.replace(t, F.lit("·"), F.lit("")), F.lit("..."), F.lit(" ")), F.lit(ENDS))
    return t if allow_gameplay else let(t, lambda x: F.when(x.rlike(PROMPT_WORDS) & (F.length(x) <= 8), "").otherwise(x))


def prepared_chinese_sequence(text: Column) -> Column:
    """The stricter form for sequences: place names go, and so do texts that are only sounds."""
    t = F.regexp_replace(F.regexp_replace(normalize_text(text), ZH_PLACE, ""), r"^[^：:\s]{1,10}[：:]\s*", "")
    t = F.btrim(F.replace(F.replace(t, F.lit("·"), F.lit("")), F.lit("..."), F.lit(" ")), F.lit(ENDS))
    sound = lambda t: t.rlike(ZH_SOUNDS) & (t.rlike(IN_BRACKETS) | (F.length(t) <= 8))
    return let(t, lambda t: F.when(sound(t) | (t.rlike(PROMPT_WORDS) & (F.length(t) <= 8)), "").otherwise(t))


def _from_speaker(t: Column, marks: str) -> Column:
    """A text without what an interface put before its first speaker."""

    def after(at: Column) -> Column:
        before = F.btrim(F.substring(t, F.lit(1), at - 1), F.lit(" -|"))
        named = let(before, lambda b: (b != "") & ((F.upper(b) == b) | F.lower(b).rlike(marks)))
        return F.when((at > 1) & named, F.trim(F.substring(t, at, F.length(t)))).otherwise(t)

    return let(F.regexp_instr(t, F.lit(EN_SPEAKER + r"\s")), after)


def _shouted(t: Column) -> Column:
    """Short texts in capitals without a speaker: labels of an interface."""
    return ~F.contains(t, F.lit(":")) & (word_count(t) <= 6) & (F.upper(t) == t) & t.rlike(ALL_CAPS)


def prepared_english(text: Column) -> Column:
    """What of an English cue is compared: from its speaker on; labels in capitals give nothing."""
    plain = F.trim(F.regexp_replace(F.replace(normalize_text(text), F.lit("[speech]"), F.lit("")), r"\s+", " "))
    return let(let(plain, lambda t: _from_speaker(t, "task")), lambda t: F.when(_shouted(t), "").otherwise(t))


def prepared_english_sequence(text: Column) -> Column:
    """The stricter form for sequences: the speaker goes too, and texts that are only sounds give nothing."""
    bare = lambda t: F.regexp_replace(F.regexp_replace(t, EN_UI, ""), "^" + EN_SPEAKER + r"\s*", "")
    sound = lambda t: t.rlike(EN_SOUNDS) & (t.rlike(IN_BRACKETS) | (word_count(t) <= 3))
    spoken = let(bare(F.trim(F.replace(normalize_text(text), F.lit("[speech]"), F.lit("")))), lambda t: _from_speaker(t, "task|collect"))
    return let(F.trim(bare(spoken)), lambda t: F.when(sound(t) | _shouted(t), "").otherwise(t))


def keep_cue(text: Column, confidence: Column, duration: Column, min_length: int = 2, min_confidence: float | None = None, language: str = "ch") -> Column:
    """Whether a recognised cue is worth keeping; ``duration`` in microseconds."""
    return _normalised(text, lambda t, bare: _keep(t, bare, confidence, duration, min_length, min_confidence, language))


def _keep(t: Column, bare: Column, confidence: Column, duration: Column, min_length: int, min_confidence: float | None, language: str) -> Column:
    n, brief = F.length(bare), duration <= 1_050_000
    unsure = F.lit(False) if min_confidence is None else confidence < min_confidence
    if language == "en":
        label = ~F.contains(t, F.lit(":")) & (word_count(t) <= 5) & (F.upper(t) == t) & t.rlike(ALL_CAPS)
        bad = label | (unsure & brief & (n <= 18)) | (~_reads(t, bare, "en") & (_share_of(bare, LATIN_OR_SIGN) < 0.35)) | ((n <= 2) & ~bare.rlike(r"\p{L}"))
    else:
        weak = (brief & (n <= 24)) | (n <= 4) | ~_reads(t, bare) | ((n <= 8) & ~t.rlike("[。！?？：:]"))
        bad = (unsure & weak) | gameplay_prompt(t) | (~_reads(t, bare) & (_share_of(bare, CJK_OR_SIGN) < 0.35)) | (bare.rlike("[：:]$") & (n <= 10)) | ((n <= 3) & (_share_of(bare, CJK_OR_SIGN) < 0.8))
    return (n >= min_length) & ~bad


def cue_quality(text: Column, confidence: Column, duration: Column) -> Column:
    """How good a reading of a cue is: length, duration, script, confidence and what it ends with."""
    return _normalised(text, lambda t, bare: _quality(t, bare, confidence, duration))


def _quality(t: Column, bare: Column, confidence: Column, duration: Column) -> Column:
    zh, latin = _share_of(bare, CJK_OR_SIGN), _share_of(bare, LATIN_OR_SIGN)
    english = latin > zh
    points = lambda c, x: F.when(c, F.lit(x)).otherwise(F.lit(0.0))
    paired = (_count(t, "（") == _count(t, "）")) & F.contains(t, F.lit("（")) | ((_count(t, r"\(") == _count(t, r"\)")) & F.contains(t, F.lit("(")))
    colon = F.length(t) - F.regexp_instr(F.reverse(t), F.lit("[：:]"))  # position of the last one from 0, or the length
    late = t.rlike("[：:]") & (colon > F.floor(F.length(t) * 0.6))
    score = F.least(F.lit(1.0), F.length(bare) / 16.0) + F.least(F.lit(1.0), F.greatest(duration, F.lit(0)) / 2_500_000.0) + F.when(english, latin).otherwise(zh)
    score = score + F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)) * 0.75 + points(F.when(english, _reads(t, bare, "en")).otherwise(_reads(t, bare)), 0.8)
    return score + points(bare.rlike("[。！？)）]$"), 0.2) + points(paired, 0.15) - points(bare.rlike("[：:，,·]$"), 0.35) - points(late, 0.4)


def duration_ratio(a: Column, b: Column, least: float) -> Column:
    """The shorter of two durations over the longer, both floored by ``least``."""
    x, y = F.greatest(a, F.lit(least)), F.greatest(b, F.lit(least))
    return F.least(x, y) / F.greatest(x, y)


def progress(at: Column, start: Column, end: Column, least: float = 1e-6) -> Column:
    """How far a point lies in a span, from 0."""
    return (at - start) / F.greatest(end - start, F.lit(least))


def progress_score(a: Column, b: Column, width: float) -> Column:
    """1 for equal progress, falling to 0 at a difference of ``width``."""
    return F.greatest(F.lit(0.0), 1 - F.abs(a - b) / width)


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def clipped(text: Column, most: int) -> Column:
    """A text of at most ``most`` characters, cut with three dots and without blanks before them."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, max(most - 3, 0))), F.lit("...")))
