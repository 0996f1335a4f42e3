"""P10: signature words and the direction in which their field lies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgrid.functions import text as T

# Words that mark a signature.
KEYWORDS = ("signature", "sign here", "sign", "חתימה")
HEBREW_KEYWORDS = ("חתום", "חתימה", "חתימת", "חותם", "החתום")
HEBREW_LEADING = ("חתימה", "חתימת", "חתימות", "חתום", "חתם", "חתמה", "חתמו", "חתמתי", "חותם", "חותמת")
HEBREW_FIRST = (*HEBREW_LEADING, "החתום")
ENGLISH_FIRST = ("signature", "sign", "signed")


def _bare(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, r"[^\p{L}\p{N}_]+", ""))


def _has_any(text: Column, words) -> Column:
    found = F.lit(False)
    for w in dict.fromkeys(words):
        found = found | text.contains(w.replace(" ", ""))
    return found


def context_direction(word: Column) -> Column:
    """rtl, ltr or null: a word that holds a signature word anywhere, forward or reversed."""
    bare = _bare(word)
    hebrew = _has_any(bare, HEBREW_LEADING + HEBREW_KEYWORDS) | _has_any(F.reverse(bare), HEBREW_LEADING + HEBREW_KEYWORDS)
    return F.when(bare == "", None).when(hebrew, "rtl").when(_has_any(bare, KEYWORDS), "ltr")


def word_direction(word: Column) -> Column:
    """rtl, ltr or null: a word that is a Hebrew signature word, forward or reversed, or holds an English one."""
    bare = _bare(word)
    hebrew = bare.isin(*HEBREW_LEADING) | F.reverse(bare).isin(*HEBREW_LEADING)
    return F.when(bare == "", None).when(hebrew, "rtl").when(_has_any(bare, KEYWORDS), "ltr")


def label_direction(label: Column) -> Column:
    """rtl, ltr or null: a label whose first word is a signature word."""
    low = F.ltrim(F.lower(label))
    first = F.regexp_extract(low, f"([A-Za-z{T.HEBREW}]+)", 1)
    hebrew = first.isin(*HEBREW_FIRST) | F.reverse(first).isin(*HEBREW_FIRST)
    found = F.when(low.startswith("sign here"), "ltr").when(first == "", None).when(hebrew, "rtl").when(first.isin(*ENGLISH_FIRST), "ltr")
    return F.when(T.looks_like_text(label), found)


def may_become_image(label: Column) -> Column:
    """Whether a text field near a signature may become its image: no readable label, a signature's, or `by`."""
    words = F.filter(F.split(F.regexp_replace(F.lower(label), f"[^a-z0-9{T.HEBREW}]+", " "), " "), lambda w: w != "")
    return ~T.looks_like_text(F.trim(label)) | label_direction(F.trim(label)).isNotNull() | (F.size(F.array_except(words, F.array(F.lit("by")))) == 0)
