"""Tokenising and normalising expressions. All are built-in functions; none is a UDF.

White space is the Unicode set that Python's ``str.split`` uses, spelled out,
since Java's ``\\s`` and RE2's are ASCII only. Punctuation is the 32 ASCII signs.
"""

from __future__ import annotations

from html import unescape

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as a character-class body, and as characters; ASCII punctuation.
WS = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WS_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

Text = Column | str


def _col(x: Text) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pieces(text: Text) -> Column:
    """Tokens with the white space after them, so that joined slices give back the text."""
    return F.regexp_extract_all(_col(text), F.lit(f"[^{WS}]+[{WS}]*"), F.lit(0))


def token_key(piece: Column) -> Column:
    """A token's key: outer ASCII punctuation stripped, lower case; empty for pure punctuation."""
    return F.lower(F.btrim(piece, F.lit(PUNCTUATION + WS_CHARS)))


def keys(text: Text) -> Column:
    """Keys of all tokens, in place."""
    return F.transform(pieces(text), token_key)


def n_tokens(text: Text) -> Column:
    return F.coalesce(F.regexp_count(_col(text), F.lit(f"[^{WS}]+")), F.lit(0)).cast("long")


def alpha_tokens(text: Text) -> Column:
    """Runs of ASCII letters, apostrophes (straight and curly) and hyphens, lower case."""
    return F.transform(F.regexp_extract_all(_col(text), F.lit("[a-zA-Z'’-]+"), F.lit(0)), F.lower)


def sampler_tokens(text: Text, min_length: int = 3) -> Column:
    """Runs of ASCII letters, straight apostrophes and hyphens of ``min_length`` or more, lower case."""
    found = F.transform(F.regexp_extract_all(_col(text), F.lit("[a-zA-Z'-]+"), F.lit(0)), F.lower)
    return F.filter(found, lambda t: F.length(t) >= min_length)


def clean(text: Text) -> Column:
    """White space squeezed to single blanks, ends trimmed."""
    return F.btrim(F.regexp_replace(_col(text), f"[{WS}]+", " "), F.lit(" "))


def group_key(text: Text) -> Column:
    """Key that groups spellings: lower case, apostrophes dropped, other punctuation as blanks, squeezed."""
    t = F.translate(F.lower(_col(text)), "'’‘ʼ", "")
    return clean(F.regexp_replace(t, r"\p{P}", " "))


def word_slug(text: Text) -> Column:
    """Letters, digits and underscores only; the code points in hexadecimal if nothing is left."""
    kept = F.regexp_replace(_col(text), "[^A-Za-z0-9_]", "")
    points = F.transform(F.split(_col(text), ""), lambda c: F.when(c != "", F.lower(F.hex(F.ascii(c)))))
    return F.when(kept != "", kept).otherwise(F.array_join(F.filter(points, lambda p: p.isNotNull()), "_"))


def file_slug(text: Text) -> Column:
    """Runs of what a file name may not hold, as one underscore."""
    return F.regexp_replace(_col(text), "[^A-Za-z0-9._-]+", "_")


def windows_safe(text: Text) -> Column:
    """Characters that some file systems refuse, dropped."""
    return F.regexp_replace(_col(text), r'[<>:"/\\|?*]', "")


def markup_pattern(more: str = "") -> str:
    """Comments, elements that hold no text, tags and declarations; ``more`` makes repetitions possessive (``+``) where an engine has that.

    A ``>`` within quotes doesn't end a tag, unless its quotes are never closed. What isn't closed reaches to the end.
    Edges of names and white space are ASCII's in both forms, as Java's differ by version.
    """
    edge, blank = ("(?![a-z0-9_])", r"[\t\n\f\r ]") if more else (r"\b", r"\s")
    inside = f"(?:[^>\"']+{more}|\"[^\"]*{more}\"|'[^']*{more}')*{more}"
    silent = "|".join(rf"<{name}{edge}{inside}>(?:.*?</{name}{blank}*>|.*\z)" for name in ("script", "style", "noscript"))
    return rf"(?is)<!--.*?(?:-->|\z)|{silent}|</?[a-z]{inside}(?:>|\z)|</?[a-z][^>]*{more}(?:>|\z)|<[!?/][^>]*{more}(?:>|\z)"


def html_text(html: Text, references: dict[str, str] | None = None) -> Column:
    """Text of a page: comments, script, style and noscript dropped with their content, other tags as blanks, character references of all kinds decoded.

    With ``references`` only these are, as they are spelled, and ``&amp`` with or without a semicolon; no Python runs.
    """
    text = F.regexp_replace(_col(html), markup_pattern("+"), " ")
    return clean(_decoded(text) if references is None else _replaced(text, references))


def _replaced(text: Column, references: dict[str, str]) -> Column:
    """The ampersand comes last, so that what it begins isn't decoded again."""
    for name, char in references.items():
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.regexp_replace(text, "&amp;?", "&")


def _decoded(text: Column) -> Column:
    """Named and numeric character references as the characters, with or without a semicolon where HTML allows that."""
    return F.arrow_udf(_unescaped, "string")(text)


def _unescaped(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unescape(t) if "&" in t else t for t in texts.to_pylist()], pa.string())


def parsed_date(text: Text) -> Column:
    """A date given as year-month-day, year-month or year; null for anything else. Months and days may have one digit."""
    t = _col(text)
    part = lambda i: F.nullif(F.regexp_extract(t, r"^(\d{4})(?:-(\d{1,2})(?:-(\d{1,2}))?)?$", i), F.lit(""))
    return F.try_to_date(F.concat_ws("-", part(1), F.lpad(F.coalesce(part(2), F.lit("1")), 2, "0"), F.lpad(F.coalesce(part(3), F.lit("1")), 2, "0")), "yyyy-MM-dd")


def from_epoch(seconds: Text) -> Column:
    """Time of a number of seconds since 1970."""
    return F.timestamp_seconds(_col(seconds))


def duration(seconds: Text) -> Column:
    """Whole seconds as minutes and seconds, from an hour on as hours and minutes."""
    s = _col(seconds).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    hours, minutes = F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long")
    return F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h "), two(minutes), F.lit("m"))).otherwise(F.concat(minutes.cast("string"), F.lit("m "), two((s % 60).cast("long")), F.lit("s")))


def uri_root(uri: Text) -> Column:
    """Second label of an address with www, else what precedes the first dot."""
    labels = F.split(_col(uri), r"\.")
    return F.when(_col(uri).contains("www"), F.get(labels, F.lit(1))).otherwise(F.get(labels, F.lit(0)))


def host(uri: Text) -> Column:
    return F.regexp_extract(_col(uri), r"^[a-z]+://([^/?#]+)", 1)


def target_of_file(name: Text) -> Column:
    """Word that an annotation file is about: after the last `` - ``, without extension and known suffixes."""
    base = F.regexp_replace(F.regexp_replace(_col(name), r"^.*/", ""), r"\.[A-Za-z0-9]+$", "")
    last = F.element_at(F.split(base, " - "), -1)
    return F.btrim(F.regexp_replace(last, r"(?i)[ _-]*(validation|annotated|annotations)$", ""))


def holds(text: Text, part: str) -> Column:
    """Whether a text holds a string as it stands, blanks and case included; null for a null text."""
    return F.contains(_col(text), F.lit(part))


def bounded_pattern(word: str) -> str:
    """Pattern of a word with no ASCII letter beside it, in either case."""
    quoted = "".join("\\" + c if not c.isalnum() and not c.isspace() and ord(c) < 128 else c for c in word)
    return f"(?i)(?<![a-z])(?u){quoted}(?-u)(?![a-z])"


def bounded_count(text: Text, word: str) -> Column:
    """Occurrences of a word with no ASCII letter beside it; the pattern runs only where the word occurs at all."""
    present = F.contains(F.lower(_col(text)), F.lit(word.lower()))
    return F.when(present, F.regexp_count(_col(text), F.lit(bounded_pattern(word)))).otherwise(F.lit(0))
