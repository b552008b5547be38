"""Text expressions: stripping, accent folding, heading keys, and replacement in a single pass."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _accents() -> tuple[str, str]:
    """Latin letters with marks (to U+024F and U+1E00 to U+1EFF) and the base letters that compatibility decomposition gives them."""
    pairs = []
    for n in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(x for x in unicodedata.normalize("NFKD", chr(n)) if not unicodedata.combining(x))
        if len(base) == 1 and base != chr(n):
            pairs.append((chr(n), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()


def fold_accents(c: Column) -> Column:
    return F.translate(F.regexp_replace(c, r"\p{Mn}", ""), ACCENTED, PLAIN)


def heading_key(c: Column) -> Column:
    """Upper-case letters, digits and single spaces, without accents."""
    return F.regexp_replace(F.upper(F.trim(F.regexp_replace(fold_accents(c), "[^A-Za-z0-9 ]+", " "))), " +", " ")


def header_key(c: Column) -> Column:
    """Lower-case words of a table header, without accents and punctuation."""
    return strip(F.regexp_replace(F.regexp_replace(F.lower(fold_accents(c)), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def quoted(literal: str) -> str:
    """A literal as a regular expression that Java and RE2 read alike."""
    return re.sub(r"([^\w\s])", r"\\\1", literal, flags=re.ASCII)


def weave(gaps: Column, parts: Column) -> Column:
    """gaps[0] parts[0] gaps[1] ... as one string; there is one gap more than there are parts."""
    return F.concat_ws("", F.flatten(F.zip_with(gaps, parts, lambda g, p: F.array(g, F.coalesce(p, F.lit(""))))))


def replace_tokens(text: Column, values: dict[str, Column]) -> Column:
    """Each token by its value (null: nothing), the longest token first where several fit. What a value brings in isn't looked at again."""
    if not values:
        return text
    any_token = "|".join(quoted(t) for t in sorted(values, key=lambda t: (-len(t), t)))
    found = F.regexp_extract_all(text, F.lit(any_token), 0)
    known = F.create_map(*[x for t, v in values.items() for x in (F.lit(t), v.cast("string"))])
    return weave(F.split(text, any_token, -1), F.transform(found, lambda t: F.element_at(known, t)))


def token_jaccard(a: Column, b: Column, stop: list[str]) -> Column:
    """Shared over all upper-case words, stop words aside; 0 where either has none."""
    words = lambda c: F.array_distinct(F.array_except(F.regexp_extract_all(F.upper(c), F.lit(r"\b[A-Z]+\b"), 0), F.array(*map(F.lit, stop))))
    one, two = words(a), words(b)
    return F.when((F.size(one) == 0) | (F.size(two) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(one, two)) / F.size(F.array_union(one, two)))
