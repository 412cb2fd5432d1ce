"""Text keys, surfaces and JVM-side text embeddings."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from epochloom.functions import arrays
from epochloom.functions.arrays import Col, _c, l2_normalise

# Whitespace stripped around a key, and the accepted surface form.
EDGE_SPACE = r"^[\s\x0B\x1C-\x1F\x85\p{Z}]+|[\s\x0B\x1C-\x1F\x85\p{Z}]+$"
SURFACE_PATTERN = r"^[A-Za-z0-9 _-]{1,64}$"
SURFACE_DROP = r"[^A-Za-z0-9 _-]"
SURFACE_SIZE = 64
WORD_PATTERN = r"[\p{L}\p{N}_]+"


def strip(col: Col) -> Column:
    return F.regexp_replace(_c(col), EDGE_SPACE, "")


def text_key(col: Col) -> Column:
    """Trimmed lower-case form used for labels and lookups."""
    return F.lower(strip(col))


def non_empty(col: Col) -> Column:
    """NULL for the empty string."""
    return F.nullif(_c(col), F.lit(""))


def sanitise_surface(col: Col) -> Column:
    """Accepted signs of a text, trimmed, up to the size of a surface.

    A text is read as far as it gives them, not to its end; spaces in last place stay if a word follows them.
    """
    text, inner = _c(col), SURFACE_DROP.replace(" ", "")
    signs = rf"^{inner}*+(?:{SURFACE_DROP}*+[A-Za-z0-9 _-])"
    head = F.regexp_replace(F.regexp_extract(text, rf"{signs}{{0,{SURFACE_SIZE}}}", 0), SURFACE_DROP, "")
    more = text.rlike(rf"{signs}{{{SURFACE_SIZE}}}{inner}*+[A-Za-z0-9_-]")
    return arrays.bound(F.ltrim(head), lambda h: F.when(h.endswith(" ") & ~more, F.rtrim(h)).otherwise(h))


def hash_embedding(surface: Col, dim: int = 64) -> Column:
    """Unit vector from the tiled SHA-256 bytes of the surface key."""
    digest = F.sha2(text_key(surface).cast("binary"), 256)
    # eight numbers of four bytes are parsed, and bytes are taken from them
    words = arrays.bound(digest, lambda h: F.transform(
        F.sequence(F.lit(0), F.lit(7)), lambda k: F.conv(h.substr(k * 8 + 1, F.lit(8)), 16, 10).cast("long")
    ))
    byte = lambda w, i: F.call_function("shiftright", F.get(w, F.lit(i % 32 // 4)), F.lit(24 - 8 * (i % 4))).bitwiseAND(F.lit(255))
    raw = arrays.bound(words, lambda w: F.array(*[(byte(w, i).cast("double") - F.lit(128.0)) / F.lit(64.0) for i in range(dim)]))
    return l2_normalise(raw)


def words(col: Col) -> Column:
    return F.regexp_extract_all(text_key(col), F.lit(WORD_PATTERN), F.lit(0))


def word_terms(col: Col) -> Column:
    """Single words followed by neighbouring word pairs, in text order."""
    return F.transform(F.array(words(col)), lambda w: F.concat(
        w,
        F.when(F.size(w) > 1, F.transform(
            F.sequence(F.lit(1), F.size(w) - 1),
            lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i)),
        )).otherwise(F.array().cast("array<string>")),
    ))[0]


def char_grams(col: Col, low: int = 3, high: int = 5) -> Column:
    """Character n-grams inside word edges: each word padded by one space.

    A word no longer than ``n`` gives itself once and no longer grams.
    """
    tokens = F.filter(F.split(text_key(col), r"[\s\x0B\x1C-\x1F\x85\p{Z}]+"), lambda w: w != "")

    def grams(w: Column) -> Column:
        size = F.length(w)
        parts = []
        of_length = lambda n: F.transform(
            F.sequence(F.lit(1), F.greatest(F.lit(1), size - (n - 1))), lambda i: F.substring(w, i, F.lit(n))
        )
        for n in range(low, high + 1):
            full = of_length(n)
            # a shorter n already gave the whole word
            keep = F.lit(True) if n == low else size > (n - 1)
            parts.append(F.when(keep, full).otherwise(F.array().cast("array<string>")))
        return F.concat(*parts)

    return F.flatten(F.transform(tokens, lambda t: grams(F.concat(F.lit(" "), t, F.lit(" ")))))


def hash_bucket(gram: Col, dim: int) -> Column:
    """Bucket from the first eight hex digits of MD5."""
    return F.pmod(F.conv(F.substring(F.md5(_c(gram).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int")
