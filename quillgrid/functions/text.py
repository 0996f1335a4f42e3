"""Text expressions of the form operators, as Spark columns.

Python's Unicode semantics are kept where Java's defaults differ: word characters are spelled `\\p{L}\\p{N}_`,
and rounding, casting and title case are written out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# They must equal the ones that existing forms and dictionaries were made with.
HEBREW = r"\x{0590}-\x{05FF}"
TYPE_ALIASES = {"tx": "text", "check": "checkbox", "chk": "checkbox", "img": "image"}
TYPE_PREFIXES = {"text": "txt", "textarea": "txt", "checkbox": "chk", "signature": "img", "image": "img", "date": "dt", "dropdown": "dd"}
CSV_TYPES = {"text": "text", "textarea": "textarea", "date": "text", "checkbox": "checkbox", "signature": "image", "image": "image"}
LABEL_DICTIONARY = {
    "שם": "Name", "שם מלא": "FullName", "שם פרטי": "FirstName", "שם משפחה": "LastName", "תאריך": "Date",
    "תאריך לידה": "BirthDate", "חתימה": "Signature", "כתובת": "Address", "טלפון": "Phone", "נייד": "Mobile",
    'דוא"ל': "Email", "דואל": "Email", "מייל": "Email", "ת.ז.": "IdNumber", "תז": "IdNumber",
    "תעודת זהות": "IdNumber", "מספר חשבון": "AccountNumber", "סכום": "Amount", "הערות": "Notes",
}
TRANSLITERATION = {
    "א": "a", "ב": "b", "ג": "g", "ד": "d", "ה": "h", "ו": "v", "ז": "z", "ח": "ch", "ט": "t", "י": "y",
    "כ": "k", "ך": "k", "ל": "l", "מ": "m", "ם": "m", "נ": "n", "ן": "n", "ס": "s", "ע": "a", "פ": "p",
    "ף": "p", "צ": "ts", "ץ": "ts", "ק": "k", "ר": "r", "ש": "sh", "ת": "t",
}
LONGEST_BASE = 32


#: Characters of the longest string that there can be: a substring of as many has no end of its own.
LONGEST_TEXT = 2**31 - 1


def mapped(value: Column, values: dict[str, str], default: Column | None = None) -> Column:
    """The dictionary's value, else `default` (else the value itself)."""
    out = None
    for k, v in values.items():
        out = F.when(value == k, v) if out is None else out.when(value == k, v)
    return out.otherwise(value if default is None else default)


def normal_type(kind: Column) -> Column:
    """A field type without its aliases."""
    return mapped(kind, TYPE_ALIASES)


def name_prefix(kind: Column) -> Column:
    """The prefix that a canonical name of a field type has."""
    low = F.lower(kind)
    return F.when(low.isin("checkbox", "check", "chk"), "chk").when(low.isin("image", "img"), "img").otherwise("txt")


def truthy(text: Column) -> Column:
    """Whether a cell's value means yes."""
    return F.lower(F.trim(text)).isin("1", "true", "yes", "on", "checked", "v")


def effective_length(text: Column) -> Column:
    """Letters and digits of a text."""
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{Nd}]", ""))


def is_section_number(text: Column) -> Column:
    return text.rlike(r"^\s*\d+(\.\d+)*\.?\s*$")


def is_readable(text: Column) -> Column:
    """Has letters or digits, no control characters, at most 5 % unprintable ones."""
    odd = F.length(text) - F.length(F.regexp_replace(text, r"[\p{C}\p{Zl}\p{Zp}]|[\p{Zs}&&[^ ]]", ""))
    return (effective_length(text) > 0) & ~text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]") & (odd * 20 <= F.length(text))


def looks_like_text(text: Column) -> Column:
    """At least two letters, digits up to a fifth, no letter that makes up over four fifths."""
    letters = F.regexp_replace(text, r"[^\p{L}]", "")
    n = F.length(letters)
    digits = F.length(F.regexp_replace(text, r"[^\p{Nd}]", ""))
    each = F.split(F.lower(letters), "")
    most = F.array_max(F.transform(F.array_distinct(each), lambda c: F.size(F.filter(each, lambda d: d == c))))
    return (n >= 2) & (digits * 5 <= n + digits) & (most * 5 <= n * 4)


def longest_run(text: Column, char: str = "_") -> Column:
    """Length of the longest run of a character."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit(f"({char}+)"), F.lit(1)), F.length)), F.lit(0))


def is_fill_line(text: Column, least: int = 8) -> Column:
    """An underscore run of `least` characters that is 45 % of the text or more."""
    run = longest_run(text)
    return (run >= least) & (run * 20 >= F.greatest(F.length(text), F.lit(1)) * 9)


def is_image_signature(name: Column) -> Column:
    """An image field's name that says signature."""
    low = F.lower(name)
    return low.startswith("img") & low.contains("signature")


def tokens(text: Column) -> Column:
    """the set of a text's lower-case ASCII words of two characters or more."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z0-9]{2,})"), F.lit(1)), F.lower))


def split_name(name: Column) -> Column:
    """a field name as words, its type prefix left out."""
    bare = F.regexp_replace(name, "^(txt|chk|img)", "")
    return F.replace(F.regexp_replace(bare, "([a-z])([A-Z])", "$1 $2"), F.lit("_"), F.lit(" "))


def normal_label(label: Column) -> Column:
    """lower case, dashes and colons as spaces, nothing but words, single spaces."""
    spaced = F.regexp_replace(F.lower(F.trim(label)), r"[\s:：־–—_-]+", " ")
    kept = F.regexp_replace(spaced, rf"[^\p{{L}}\p{{N}}_{HEBREW} ]+", "")
    return F.trim(F.regexp_replace(kept, " +", " "))


def has_hebrew(text: Column) -> Column:
    """F8: holds a right-to-left character of the Hebrew block."""
    return text.rlike(f"[{HEBREW}]")


def label_keys(label: Column) -> Column:
    """Keys under which a label is looked up, in order: normalised, reversed if Hebrew, and each without
    a one-letter Hebrew prefix if it is one word of over three letters."""

    def own(text: Column) -> Column:
        key = normal_label(text)
        bare = (~key.contains(" ")) & (F.length(key) > 3) & F.substring(key, 1, 1).isin("ב", "ה", "ל")
        return F.array(key, F.when(bare, F.substring(key, 2, LONGEST_TEXT)).otherwise(""))

    both = F.concat(own(label), F.when(has_hebrew(label), own(F.reverse(label))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.filter(both, lambda k: k != ""))


def repaired_hebrew(text: Column) -> Column:
    """Hebrew letters decoded as Latin-1 put right, if there are two or more."""
    latin = "".join(chr(0xE0 + i) for i in range(27))
    hebrew = "".join(chr(0x05D0 + i) for i in range(27))
    hits = F.length(text) - F.length(F.translate(text, latin, ""))
    return F.when(hits >= 2, F.translate(text, latin, hebrew)).otherwise(text)


def transliterated(text: Column) -> Column:
    for a, b in TRANSLITERATION.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def clean_label(label: Column) -> Column:
    text = F.regexp_replace(label, r'[^\p{L}\p{N}_\s."]+', " ")
    return F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r"^[. ]+|[. ]+$", "")


def base_from_label(label: Column, dictionary: dict[str, str] | None = None) -> Column:
    """a name's base: from the dictionary, else the label's words transliterated, in camel case, cut."""
    cleaned = clean_label(label)
    bare = F.transform(F.split(cleaned, " "), lambda w: F.regexp_replace(F.when(has_hebrew(w), transliterated(w)).otherwise(w), "[^A-Za-z0-9]+", ""))
    camel = F.transform(bare, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, LONGEST_TEXT)))
    base = F.substring(F.array_join(camel, ""), 1, LONGEST_BASE)
    built = F.when(base.rlike("[A-Za-z]"), base).otherwise("Field")
    return F.when(cleaned == "", "Field").otherwise(mapped(cleaned, LABEL_DICTIONARY | (dictionary or {}), built))


def title_slug(label: Column, keep: str = "A-Za-z0-9") -> Column:
    """words capitalised at every start after a non-letter, other characters dropped, cut."""
    words = F.regexp_extract_all(F.lower(label), F.lit(r"([\p{L}]+|[^\p{L}]+)"), F.lit(1))
    cased = F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, LONGEST_TEXT)))
    return F.substring(F.regexp_replace(F.array_join(cased, ""), f"[^{keep}]+", ""), 1, LONGEST_BASE)


def slug_name(label: Column, prefix: Column | str, keep: str = "A-Za-z0-9") -> Column:
    """prefix and slug, or prefix and Field where the label isn't readable text."""
    start = F.lit(prefix) if isinstance(prefix, str) else prefix
    slug = title_slug(label, keep)
    return F.concat(start, F.when(looks_like_text(label) & (slug != ""), slug).otherwise("Field"))


def strip_indexes(name: Column) -> Column:
    return F.regexp_replace(name, r"\[\d+\]", "")


def last_segment(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def strip_number(name: Column) -> Column:
    return F.regexp_replace(name, r"_\d+$", "")


def strip_duplicated(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)_DUPLICATED_\d+$", "")


def column_index(reference: Column) -> Column:
    """the column number, from 0, of a sheet cell's reference."""
    letters = F.split(F.regexp_extract(reference, "^([A-Z]*)", 1), "")
    value = F.aggregate(F.filter(letters, lambda c: c != ""), F.lit(0), lambda n, c: n * 26 + F.ascii(c) - 64)
    return F.greatest(value - 1, F.lit(0))


def html_unescaped(text: Column) -> Column:
    """the five named entities and decimal quotes as characters, the ampersand last."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text
