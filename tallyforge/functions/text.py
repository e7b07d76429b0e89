"""Text functions as columns: Unicode strip, words, normal forms, set similarity."""

from __future__ import annotations

import sys
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import GAP_CATEGORIES, UNSPECIFIED

# White space as str.strip knows it: Unicode's plus the four information separators.
SPACE = r"(?U)[\s\x1c-\x1f]+"
WORD = r"[\p{L}\p{N}_]+"


# The characters that str.strip removes.
STRIPPED = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip_text(c: Column) -> Column:
    """py_strip of a column of long texts: those that neither begin nor end with white space, told by two characters, aren't trimmed."""
    ends = lambda at: F.lit(STRIPPED).contains(F.substring(c, at, 1))
    return F.when(ends(1) | ends(-1), py_strip(c)).otherwise(c)


def py_strip(c: Column) -> Column:
    """str.strip: looks at the ends only, whatever the length of the text."""
    return F.btrim(c, F.lit(STRIPPED))


@lru_cache(maxsize=1)
def fold_table() -> tuple[str, str, dict[str, str]]:
    """(characters, what each folds to, characters that fold to several) of Unicode's full case folding, over every code point."""
    folds = {chr(c): chr(c).casefold() for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF}
    one = {k: v for k, v in folds.items() if k != v and len(v) == 1}
    return "".join(one), "".join(one.values()), {k: v for k, v in folds.items() if len(v) > 1}


@lru_cache(maxsize=1)
def plain_letters() -> str:
    """Inside of a character class: characters of common alphabets that fold as they lower, one to one and whatever stands around them."""
    safe = [c for lo, hi in ((0, 0x250), (0x400, 0x530), (0x5D0, 0x5F0), (0x620, 0x6D4), (0x900, 0xE50), (0x3040, 0x3100), (0x4E00, 0xA000)) for c in range(lo, hi) if chr(c).lower() == chr(c).casefold() and len(chr(c).lower()) == 1]
    ranges: list[list[int]] = []
    for c in safe:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"\\x{{{a:x}}}-\\x{{{z:x}}}" for a, z in ranges)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(x) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(c: Column) -> Column:
    """str.casefold, in the JVM: ASCII text by lower, other text by a table of characters; those that fold to several are
    written out where there are any. Text and table's result are bound to variables, so that each is computed once.

    No regular expression looks for characters: a class of hundreds of ranges is tried range by range for each character."""
    singles, folded, several = fold_table()
    # a literal of one string, which the optimizer turns into a map: a hundred nested replacements would be planned for every use
    spelled = F.str_to_map(F.lit(" ".join(f"{k}={v}" for k, v in several.items())), F.lit(" "), F.lit("="))
    # the one of them that is common in running text
    sharp = lambda x: F.replace(x, F.lit("\xdf"), F.lit(several["\xdf"]))

    def written_out(one: Column) -> Column:
        out = F.array_join(F.transform(F.regexp_extract_all(one, F.lit("(?s)."), F.lit(0)), lambda ch: F.coalesce(spelled[ch], ch)), "")
        return F.when(F.translate(one, "".join(several), "") == one, one).otherwise(out)

    return _let(c, lambda x: F.when(F.octet_length(x) == F.length(x), F.lower(x)).otherwise(_let(sharp(F.translate(x, singles, folded)), written_out)))


def same_folded(a: Column, b: Column) -> Column:
    """Whether two texts have one fold. Equal texts have; a character folds to three at most, so lengths far apart settle it without folding too."""
    m, n = F.length(a), F.length(b)
    return F.when(a == b, True).when((m > 3 * n) | (n > 3 * m), False).otherwise(fold(a) == fold(b))


def words(c: Column) -> Column:
    """Distinct folded words. Words are cut before folding, as folding can add characters that aren't of a word.

    Different ones are folded together, joined by a space, which is no word character. Without words that leaves one empty string.
    The text is looked through once: no branch names it twice."""
    found = F.array_join(F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(WORD), F.lit(0))), " ")
    return F.array_remove(F.array_distinct(F.split(fold(found), " ")), "")


def jaccard(a: Column, b: Column) -> Column:
    """Of two distinct-element arrays; both empty: 1. Arrays and what they share are computed once, however they are made."""

    def of(p: Column) -> Column:
        m, n = F.size(p["a"]), F.size(p["b"])
        return _let(F.size(F.array_intersect(p["a"], p["b"])), lambda shared: F.when((m == 0) & (n == 0), 1.0).otherwise(shared / (m + n - shared).cast("double")))

    return _let(F.struct(a.alias("a"), b.alias("b")), of)


def token_jaccard(a: Column, b: Column) -> Column:
    return jaccard(words(a), words(b))


def is_unspecified(c: Column) -> Column:
    """Null, blank or a placeholder word."""
    return F.coalesce(fold(py_strip(c)).isin(*UNSPECIFIED), F.lit(True))


def normalize_signature(c: Column) -> Column:
    return F.regexp_replace(fold(py_strip(c)), SPACE, " ")


def normalize_signatures(c: Column) -> Column:
    return F.transform(c, lambda x: normalize_signature(x))


def has_duplicates(c: Column) -> Column:
    return F.size(F.array_distinct(c)) < F.size(c)


def normalize_gap(c: Column) -> Column:
    """Lower case, hyphens and spaces as underscores."""
    return F.regexp_replace(py_strip(F.replace(fold(py_strip(c)), F.lit("-"), F.lit(" "))), SPACE, "_")


def gap_violation(c: Column) -> Column:
    """Why an array of gap categories isn't legal, or null."""
    n = F.transform(c, normalize_gap)
    return F.when(F.exists(n, lambda x: ~x.isin(*GAP_CATEGORIES)), "unknown_gap_category").when(has_duplicates(n), "duplicate_gap_category")


def normalize_text(c: Column) -> Column:
    """Strip and collapse white space, case kept."""
    return F.regexp_replace(py_strip(c), SPACE, " ")


def text_list_violation(c: Column) -> Column:
    n = F.transform(c, normalize_text)
    return F.when(F.exists(n, lambda x: F.coalesce(x == "", F.lit(True))), "blank_item").when(has_duplicates(n), "duplicate_item")


def versioned_id(card: Column, version: Column) -> Column:
    return F.concat(card, F.lit("@"), version)


def turn_key(episode: Column, turn: Column) -> Column:
    return F.concat(episode, F.lit("#"), turn)
