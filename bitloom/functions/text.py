"""String column functions. All stay in the JVM."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def strip(c: Column) -> Column:
    """Without outer white space of any kind (F.trim removes blanks only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def folded_name(c: Column) -> Column:
    """Lower case without outer white space; null stays null."""
    return F.lower(strip(c))


#: White space of any kind; the class reads the same in Java, RE2 and Python.
WS = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
# fixed values: letters that look-alikes are put back to, pairwise
LOOKALIKES = ("õôûè─‑–—", "őőűé----")
# fixed values: characters that a clean corpus line may have
CLEAN_SET = "ÁÉÍÓÖÚÜáäéíóöúüŐőŰűščABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789" + " ,฀.;-[@_!#$%^&*()<>?/\\|}{~:]\"”„“" + "'’‘"
_CLEAN_CLASS = "".join("\\" + c if c in "[]\\^-&" else c for c in CLEAN_SET)
FORBIDDEN = f"[^{_CLEAN_CLASS}]"
QUOTES = ('"', "'", "`")


#: The same characters one by one, for trim, which needs no pattern.
WS_CHARS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip_all(c: Column) -> Column:
    """Without outer white space, as Python's strip."""
    return F.trim(c, F.lit(WS_CHARS))


def word_count(c: Column) -> Column:
    """Number of runs of non-white space (0 for empty text)."""
    return F.regexp_count(c, F.lit(f"{WS.replace('[', '[^')}+"))


def blank_count(c: Column) -> Column:
    """Number of parts between single blanks: one more than there are blanks."""
    return F.size(F.split(c, " "))


def average_word_length(c: Column) -> Column:
    """Mean length of the parts between single blanks, as (length - parts) / parts."""
    return (F.length(c) - blank_count(c)) / blank_count(c)


def uppercase_ratio(c: Column) -> Column:
    """Share of A-Z among all characters; null for the empty text."""
    return F.try_divide(F.regexp_count(c, F.lit("[A-Z]")).cast("double"), F.length(c).cast("double"))


def length_ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def has_letters(c: Column) -> Column:
    """Whether there is a letter of any script."""
    return c.rlike(r"\p{L}")


def fix_lookalikes(c: Column) -> Column:
    """Look-alike letters and dashes replaced by the usual ones."""
    return F.translate(c, *LOOKALIKES)


def drop_forbidden_first(c: Column) -> Column:
    """Without the first character if that is outside the clean set."""
    return F.when(c.rlike("^" + FORBIDDEN), F.substring(c, 2, 1 << 30)).otherwise(c)


def is_clean(c: Column) -> Column:
    """Whether every character is in the clean set."""
    return ~c.rlike(FORBIDDEN)


def forbidden_chars(c: Column) -> Column:
    """The characters outside the clean set, in order, with repeats."""
    return F.regexp_extract_all(c, F.lit(f"({FORBIDDEN})"), 1)


def remove_marks(c: Column) -> Column:
    """Without double and single quotes and without a hyphen that a blank follows (both are dropped)."""
    return F.regexp_replace(c, "\"|- |'", "")


def remove_eng_quotes(c: Column) -> Column:
    """Without double quotes."""
    return F.replace(c, F.lit('"'), F.lit(""))


def remove_hun_dash(c: Column) -> Column:
    """Without leading hyphens and the white space after them."""
    return F.regexp_replace(F.regexp_replace(c, "^-+", ""), f"^{WS}+", "")


def shingle_words(c: Column) -> Column:
    """Lower-case words after all characters but letters, digits, underscores and white space are removed."""
    plain = strip_all(F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}_\s\x0B\x1C-\x1F\x85\p{Z}]", "")))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, f"{WS}+"))


def vector_words(c: Column) -> Column:
    """Words after every character but letters, digits and underscores has become a blank."""
    plain = F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}_]", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " +"))


def main_label(c: Column) -> Column:
    """A dependency label without its subtype, in lower case."""
    return F.lower(F.substring_index(c, ":", 1))


def iso_code(c: Column) -> Column:
    """The part after the last double underscore."""
    return F.substring_index(c, "__", -1)


def key_form(c: Column) -> Column:
    """Form of a node key; the form itself may have underscores."""
    return F.regexp_extract(c, r"(?s)^(.*)_(\d+)$", 1)


def key_index(c: Column) -> Column:
    """Index of a node key; null for a key without one."""
    return F.when(c.rlike(r"_\d+$"), F.regexp_extract(c, r"_(\d+)$", 1).cast("int"))


def node_key(form: Column, index: Column) -> Column:
    """Form and index joined to a node key."""
    return F.concat_ws("_", form, index.cast("string"))


# fixed values: rules of the public Moses normaliser, as (pattern, replacement); then the ones by language
PUNCTUATION = (
    (r"\r", ""), (r"\(", " ("), (r"\)", ") "), (r" +", " "), (r"\) ([.!:?;,])", ")$1"), (r"\( ", "("), (r" \)", ")"),
    (r"(\d) %", "$1%"), (r" :", ":"), (r" ;", ";"), (r"`", "'"), (r"''", ' " '),
    ("„", '"'), ("“", '"'), ("”", '"'), ("–", "-"), ("—", " - "), (r" +", " "), ("´", "'"), (r"([a-zA-Z])‘([a-zA-Z])", "$1'$2"),
    (r"([a-zA-Z])’([a-zA-Z])", "$1'$2"), ("‘", "'"), ("‚", "'"), ("’", "'"), ("''", '"'), ("´´", '"'), ("…", "..."),
    ("\xa0«\xa0", ' "'), ("«\xa0", '"'), ("«", '"'), ("\xa0»\xa0", '" '), ("\xa0»", '"'), ("»", '"'),
    ("\xa0%", "%"), ("nº\xa0", "nº "), ("\xa0:", ":"), ("\xa0ºC", " ºC"), ("\xa0cm", " cm"), ("\xa0\\?", "?"), ("\xa0!", "!"), ("\xa0;", ";"), (",\xa0", ", "), (r" +", " "),
)
BY_LANGUAGE = {
    "en": ((r'"([,.]+)', '$1"'), ("(\\d)\xa0(\\d)", "$1.$2")),
    "de": ((',"', '",'), (r'(\.+)"(\s*[^<])', '"$1$2'), ("(\\d)\xa0(\\d)", "$1,$2")),
    "es": ((',"', '",'), (r'(\.+)"(\s*[^<])', '"$1$2'), ("(\\d)\xa0(\\d)", "$1,$2")),
    "fr": ((',"', '",'), (r'(\.+)"(\s*[^<])', '"$1$2'), ("(\\d)\xa0(\\d)", "$1,$2")),
    "cs": (("(\\d)\xa0(\\d)", "$1,$2"),),
}
OTHER_LANGUAGES = ((',"', '",'), (r'(\.+)"(\s*[^<])', '"$1$2'), ("(\\d)\xa0(\\d)", "$1.$2"))


#: Only texts with one of these are changed by any rule.
CONCERNED = "[\\r()%:;`'\"„“”–—´‘’‚…«»\xa0]|  "


def normalise_punctuation(c: Column, language: str) -> Column:
    """Punctuation in one form for a language: quotes, dashes, blanks around signs, separators of numbers."""
    done = c
    for pattern, by in (*PUNCTUATION, *BY_LANGUAGE.get(language, OTHER_LANGUAGES)):
        done = F.regexp_replace(done, pattern, by)
    return F.when(c.rlike(CONCERNED), done).otherwise(c)


def _clean_one(s: str) -> str:
    s, before = s.replace("\xad", "-"), None
    while s != before:
        before = s
        for q in QUOTES:
            if s[:1] == q == s[-1:]:
                s = s[1:-1]
        for q in ("'", '"', "`"):
            bare = s.strip()
            if s.count(q) == 1 and q in (bare[:1], bare[-1:]):
                s = s.replace(q, "")
        s = s.removeprefix("-")
    return s


@F.pandas_udf(StringType())
def _clean_series(texts: pd.Series) -> pd.Series:
    return texts.map(_clean_one, na_action="ignore")


def clean_sentence(c: Column) -> Column:
    """Outer quotes, a lone quote at either end and leading hyphens removed until nothing changes; soft hyphens become hyphens.

    Only texts that have such a sign go through Python.
    """
    return F.when(c.rlike("[\"'`\\-­]"), _clean_series(c)).otherwise(c)
