"""Strings of document layout as Column expressions; Unicode normalisation is the only Arrow function."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What JavaScript calls white space.
SPACE = r"[\t\n\x0B\f\r    -     　﻿]"
UNCERTAIN = r"[\x{FFFD}\x{0}-\x{8}\x{E000}-\x{F8FF}\p{Cn}]"
# Fixed values of the layout rules.
NUMERIC = r"^(?:[-−–—]|[+−-]?\d[\d,.]*(?:[%x×])?)$"
BULLET = r"^(?:[•●▪◦‣–－-]|\d{1,3}[.)、](?!\d)|[（(]\d{1,3}[)）])" + SPACE + "*"
CHINESE_LIST = r"^(?:[一二三四五六七八九十百]+[、．.]|[（(][一二三四五六七八九十百]+[)）])" + SPACE + "*"
ARTICLE = r"^第[一二三四五六七八九十百\d]+條"
CJK = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"
OPENING, CLOSING = r"[（「『【《〈(\[]$", r"^[，。！？；：、）》〉」』】,.!?;:)\]]"
CJK_END, CJK_OPEN = r"[，。！？；：、）》〉」』】]$", r"^[（「『【《〈]"
SERIF, SANS, MONO = r"(?i)times|serif|NimbusRom|^CM(?:R|MI|SY)\d", r"(?i)^(?:sans-serif|Arial|Helvetica|NimbusSans|Noto Sans CJK)", r"(?i)courier|mono|^CMTT\d"
STYLE = r"(?i)[-,]?(BoldItalic|Bold|Italic|Regular|Oblique|Roman|PSMT|MT)$"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def file_stem(name: Column) -> Column:
    """Without .pdf, with _ for characters that file names can't hold; 'document' if nothing is left."""
    stem = F.regexp_replace(F.regexp_replace(name, r"(?i)\.pdf$", ""), r'[\\/:*?"<>|]', "_")
    return F.coalesce(F.nullif(F.trim(stem), F.lit("")), F.lit("document"))


def conversion_stem(name: Column) -> Column:
    return file_stem(F.regexp_replace(F.trim(name), r"(?i)\.(?:pdf|jpe?g|png|svg|webp|zip)$", ""))


def human_bytes(n: Column) -> Column:
    def tenths(unit: int) -> Column:
        t = F.floor(n * 10 / unit + 0.5)
        return F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"))

    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, F.concat(tenths(1024), F.lit(" KB"))).otherwise(F.concat(tenths(1024**2), F.lit(" MB")))


def uncertain_encoding(text: Column) -> Column:
    return text.rlike(UNCERTAIN)


def numeric_token(text: Column) -> Column:
    """A lone dash, or digits with at most one sign before and one %, x or × after."""
    return trimmed(text).rlike(NUMERIC)


def list_marker(text: Column) -> Column:
    """The marker that a list line begins with, or null: a bullet, or up to three digits with a mark that no digit follows."""
    return F.nullif(F.regexp_extract(text, BULLET, 0), F.lit(""))


def line_marker(text: Column) -> Column:
    """list, chinese (一、 or （一）), article (第一條) or null, by what a line begins with."""
    return F.when(text.rlike(BULLET), "list").when(text.rlike(CHINESE_LIST), "chinese").when(text.rlike(ARTICLE), "article")


def page_number(text: Column) -> Column:
    """The page number of a footer such as 'page 3 of 9', '3/9' or '第 3 頁', else null."""
    for pattern in (r"(?i)^page\s+(\d+)(?:\s+of\s+\d+)?$", r"^(\d+)\s*/\s*\d+$", r"^第\s*(\d+)\s*[頁页]$", r"^[-–—]?\s*(\d{1,4})\s*[-–—]?$"):
        found = F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
        out = found if pattern.startswith("(?i)") else F.coalesce(out, found)  # noqa: F821
    return out.cast("int")


def join_separator(left: Column, right: Column) -> Column:
    """What stands between two pieces of text when they are joined: nothing or a space.

    Nothing after or before white space, after an opening and before a closing
    mark, between CJK characters and their marks, and where a hyphen or soft
    hyphen after a letter meets a small letter.
    """
    before = left.rlike(f"{CJK}$")
    return (
        F.when((left == "") | (right == "") | left.rlike(f"{SPACE}$") | right.rlike(f"^{SPACE}"), "").when(left.rlike(OPENING) | right.rlike(CLOSING), "")
        .when((left.rlike(CJK_END) | before) & right.rlike(f"^{CJK}"), "").when(before & right.rlike(CJK_OPEN), "")
        .when(left.rlike(r"\p{L}[-\x{AD}]$") & right.rlike(r"^\p{Ll}"), "").otherwise(" ")
    )


def font_name(name: Column) -> Column:
    """Without the six-letter subset prefix; Latin-1 misreadings of UTF-8 are undone where they can be."""
    bare = F.regexp_replace(name, r"^[A-Z]{6}\+", "")
    raw = F.encode(bare, "ISO-8859-1")
    odd = bare.rlike(r"[\u0080-ÿ]") & ~bare.rlike(r"[^\u0000-ÿ]")
    return F.when(odd & F.try_validate_utf8(raw).isNotNull(), F.decode(raw, "UTF-8")).otherwise(bare)


def font_family(name: Column) -> Column:
    """The common font that stands for a PDF's font, else its own name without subset prefix and style."""
    own = F.regexp_replace(F.regexp_replace(name, r"^[A-Z]{6}\+", ""), STYLE, "")
    return F.when(name.rlike(SERIF) & ~name.rlike("(?i)sans"), "Times New Roman").when(name.rlike(MONO), "Courier New").when(name.rlike(SANS), "Arial").otherwise(F.coalesce(F.nullif(own, F.lit("")), F.lit("Arial")))


def bare(text: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(text, SPACE, "")


def edit_accept(before: Column, after: Column, was: Column, now: Column, numbers: Column, most: int = 400) -> Column:
    """Whether a re-read line may replace the old one, both without white space.

    It must be surer, within a fifth of the old length, at most ``most``
    characters, and within 30 % edits.  numbers: texts of the old line's spans;
    those that hold a digit and were read surely (``sure_numbers``) must reappear.
    """
    a, b = bare(before), bare(after)
    old, new = F.char_length(a), F.char_length(b)
    likely = (old > 0) & (new >= old * 0.8) & (new <= old * 1.2) & (old <= most) & (new <= most) & (now >= F.greatest(F.lit(80), was + 3))
    edits = F.when(likely, F.levenshtein(a, b) <= F.greatest(old, new) * 0.3)
    return F.coalesce(edits & F.forall(numbers, lambda x: F.contains(b, bare(x))), F.lit(False))


def sure_numbers(spans: Column) -> Column:
    """Texts of spans (array of structs text, confidence) with a digit and a confidence of at least 85."""
    return F.transform(F.filter(spans, lambda s: (s["confidence"] >= 85) & s["text"].rlike(r"\d")), lambda s: s["text"])


#: Texts that are normalised together.
TOGETHER = 64


@F.arrow_udf(T.StringType())
def nfkc(text: pa.Array) -> pa.Array:
    """NFKC form without white space; Spark has no normalisation of its own."""
    import unicodedata

    made = [pa.array([None if t is None else "".join(unicodedata.normalize("NFKC", t).split()) for t in text.slice(k, TOGETHER).to_pylist()], text.type) for k in range(0, len(text), TOGETHER)]
    return pa.concat_arrays(made) if made else text
