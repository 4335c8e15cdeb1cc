"""Text functions as Column expressions.

White space is what browsers count as such, so it has the no-break space, which
Java's ``\\s`` lacks. Accents need Unicode decomposition, which Spark has no
function for. Where only ASCII letters matter later, a table of the characters
that decompose to one does it without Python; the full step is an Arrow UDF.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WS = r"[\t-\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"

#: The same, where most characters are none: these are told by one range, before
#: the ranges of white space are tried one after the other.
RARE_WS = f"[^!-~](?<={WS})"


def trim_ws(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{RARE_WS}{WS}*$", "")


def collapse_ws(c: Column) -> Column:
    return F.regexp_replace(c, f"{RARE_WS}{WS}*", " ")


@F.arrow_udf(StringType())
def strip_accents(texts: pa.Array) -> pa.Array:
    """Canonical decomposition without the combining marks U+0300 to U+036F."""
    marks = dict.fromkeys(range(0x300, 0x370))
    return pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFD", t).translate(marks) for t in texts.to_pylist()], pa.string())


def _to_ascii() -> tuple[str, str]:
    """Characters that decompose to one of ASCII and marks, with those of ASCII;
    then the marks, which stand for nothing."""
    marks = "".join(map(chr, range(0x300, 0x370)))
    bare = {c: unicodedata.normalize("NFD", c).translate(dict.fromkeys(range(0x300, 0x370))) for c in map(chr, range(0x80, 0xD800))}
    told = {c: b for c, b in bare.items() if len(b) == 1 and b.isascii()}
    return "".join(told) + marks, "".join(told.values())


_ACCENTED, _BARE = _to_ascii()


def ascii_letters(c: Column) -> Column:
    """``strip_accents`` for callers that take all but ASCII as a separator."""
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(F.translate(c, _ACCENTED, _BARE))


def normalize_text(c: Column) -> Column:
    """Lower case without accents; "SPF 50+" is spf50; punctuation to spaces."""
    plain = ascii_letters(F.lower(c))
    spf = F.regexp_replace(plain, rf"(?<![A-Za-z0-9_])spf{WS}*([0-9]+)\+?", "spf$1")
    # white space and what is no word are separators alike
    return F.trim(F.regexp_replace(spf, "[^A-Za-z0-9_]+", " "))


def split_words(normalized: Column) -> Column:
    """Words of a normalised text of more than two characters."""
    return F.filter(F.split(normalized, " "), lambda w: F.length(w) > 2)


@F.arrow_udf(StringType())
def url_slug(urls: pa.Array) -> pa.Array:
    """Last non-empty part of a URL's path, or of the string if it is no URL."""
    from urllib.parse import quote, urlsplit

    def one(u: str | None) -> str | None:
        if u is None:
            return None
        path = u
        try:
            parts = urlsplit(u.strip())
            if parts.scheme and (parts.netloc or parts.scheme not in ("http", "https")):
                path = quote(parts.path, safe="/%:@!$&'()*+,;=-._~[]|^\\")
        except ValueError:
            pass
        return next((p for p in reversed(path.split("/")) if p), "")

    return pa.array([one(u) for u in urls.to_pylist()], pa.string())


def some(c: Column) -> Column:
    """Null for the empty string."""
    return F.nullif(c, F.lit(""))


def clean_text(c: Column) -> Column:
    """Tags to spaces, four entities decoded, white space collapsed."""
    out = F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return trim_ws(collapse_ws(out))


def strip_tags_for_price(c: Column) -> Column:
    """Tags removed, three entities decoded, white space collapsed."""
    out = F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]*>", "")
    for entity, char in (("&#44;", ","), ("&#46;", "."), ("&nbsp;", " ")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return collapse_ws(out)


@F.arrow_udf(StringType())
def decode_attribute(values: pa.Array) -> pa.Array:
    """Named, decimal and hexadecimal entities; ``&amp;`` last."""
    import re

    named = [("&quot;", '"'), ("&#039;", "'"), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">")]

    def one(v: str | None) -> str | None:
        if v is None:
            return None
        for entity, char in named:
            v = v.replace(entity, char)
        v = re.sub(r"&#(\d+);", lambda m: chr(int(m[1]) & 0xFFFF), v, flags=re.A)
        v = re.sub(r"&#[xX]([0-9a-fA-F]+);", lambda m: chr(int(m[1], 16) & 0xFFFF), v)
        return v.replace("&amp;", "&").encode("utf-16", "surrogatepass").decode("utf-16", "replace")

    return pa.array([one(v) for v in values.to_pylist()], pa.string())


def normalize_url(href: Column, base: Column | str) -> Column:
    base = F.lit(base) if isinstance(base, str) else base
    return (
        F.when(F.coalesce(href, F.lit("")) == "", F.lit(None).cast("string"))
        .when(href.startswith("//"), F.concat(F.lit("https:"), href))
        .when(href.startswith("http") | (F.coalesce(base, F.lit("")) == ""), href)
        .when(href.startswith("/"), F.concat(base, href))
        .otherwise(F.concat(base, F.lit("/"), href))
    )


def encode_query(q: Column) -> Column:
    """Percent-encoding as in a URL component: space as %20, ``!'()~`` as they are."""
    out = F.replace(F.url_encode(q), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def truncate(c: Column, most: int) -> Column:
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most - 1), F.lit("…")))


def escape_html(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c
