"""Text normalisers, term splitting and tokenising as column expressions.

Three normalisers exist side by side and give different results on purpose:

* ``strip_accents``   compatibility-decompose, drop combining marks
* ``ascii_normalise`` the same, then drop non-ASCII, lower, collapse blanks
* ``collapse_lower``  lower and collapse blanks, accents kept
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space; Java's \s alone is ASCII only.
WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
TERM_SEPARATORS = r"[,|;/]"
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"

_HANGUL_FIRST, _HANGUL_LAST = 0xAC00, 0xD7A3


@lru_cache(maxsize=1)
def _decompositions() -> tuple[str, str, dict[str, str]]:
    """(source chars, target chars, multi-char map) for everything but Hangul.

    Source chars past the end of the target string are deleted by translate.
    """
    single_src, single_dst, dropped, multi = [], [], [], {}
    for code in range(0x80, 0x30000):
        if 0xD800 <= code <= 0xDFFF or _HANGUL_FIRST <= code <= _HANGUL_LAST:
            continue
        char = chr(code)
        plain = "".join(
            c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c)
        )
        if plain == char:
            continue
        if not plain:
            dropped.append(char)
        elif len(plain) == 1:
            single_src.append(char)
            single_dst.append(plain)
        else:
            multi[char] = plain
    return "".join(single_src + dropped), "".join(single_dst), multi


def _char_class(chars) -> str:
    codes = sorted(ord(c) for c in chars)
    ranges: list[list[int]] = []
    for code in codes:
        if ranges and code == ranges[-1][1] + 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "".join(
        f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges
    )


@lru_cache(maxsize=1)
def _rare_multi() -> tuple[dict[str, str], str]:
    _, _, multi = _decompositions()
    rare = {c: p for c, p in multi.items() if c not in _FREQUENT_MULTI}
    return rare, f"[{_char_class(rare)}\\x{{AC00}}-\\x{{D7A3}}]"


# Multi-char cases frequent in prose; handled by plain replaces before the rare-char path.
_FREQUENT_MULTI = "…™½¼¾ﬁﬂ"
# A quick look (few ranges) that finds every row the one-to-one table cannot serve:
# below U+0180 only these characters expand to several.
_MAYBE_MULTI = r"[¼½¾ĲĳĿŀŉ]|[^\x00-\x{17F}]"


def _constant_array(values: list[str]) -> Column:
    """A folded array literal from one string; far cheaper to build than many literals."""
    return F.split(F.lit("\x01".join(values)), "\x01")


def _constant_map(entries: dict[str, str]) -> Column:
    pairs = "\x01".join(f"{k}\x02{v}" for k, v in entries.items())
    return F.str_to_map(F.lit(pairs), F.lit("\x01"), F.lit("\x02"))


def _hangul_to_jamo(char: Column) -> Column:
    index = F.ascii(char) - F.lit(_HANGUL_FIRST)
    lead = _constant_array([chr(0x1100 + i) for i in range(19)])
    vowel = _constant_array([chr(0x1161 + i) for i in range(21)])
    tail = _constant_array(["", *[chr(0x11A7 + i) for i in range(1, 28)]])
    return F.concat(
        F.get(lead, F.floor(index / 588).cast("int")),
        F.get(vowel, F.floor((index % 588) / 28).cast("int")),
        F.get(tail, (index % 28).cast("int")),
    )


def strip_accents(col: Column) -> Column:
    """Compatibility decomposition without combining marks; keeps e.g. ``ß``.

    ASCII rows return at once, rows with only one-to-one characters take one
    translate pass, and only rows holding ligatures or Hangul pay per character.
    """
    src, dst, multi = _decompositions()
    prepared = col
    for char in _FREQUENT_MULTI:
        prepared = F.replace(prepared, F.lit(char), F.lit(multi[char]))
    rare, rare_class = _rare_multi()
    rare_map = _constant_map(rare)
    per_char = F.array_join(
        F.transform(
            F.split(prepared, ""),
            lambda ch: F.when(ch.between("가", "힣"), _hangul_to_jamo(ch)).otherwise(
                F.coalesce(F.try_element_at(rare_map, ch), ch)
            ),
        ),
        "",
    )
    # A ligature may expand to accented characters, so translate runs last.
    return (
        F.when(~col.rlike(r"[^\x00-\x7F]"), col)
        .when(~col.rlike(_MAYBE_MULTI), F.translate(col, src, dst))
        .when(col.rlike(rare_class), F.translate(per_char, src, dst))
        .otherwise(F.translate(prepared, src, dst))
    )


def strip_ws(col: Column) -> Column:
    return F.regexp_replace(col, f"^{WS}+|{WS}+$", "")


def collapse_ws(col: Column) -> Column:
    return strip_ws(F.regexp_replace(col, f"{WS}+", " "))


def collapse_lower(col: Column) -> Column:
    return collapse_ws(F.lower(col))


def ascii_normalise(col: Column) -> Column:
    plain = F.regexp_replace(strip_accents(F.coalesce(col, F.lit(""))), r"[^\x00-\x7F]", "")
    return collapse_ws(F.lower(plain))


def is_blank(col: Column) -> Column:
    return strip_ws(F.coalesce(col, F.lit(""))) == ""


def clean_html(col: Column) -> Column:
    return strip_ws(F.regexp_replace(F.coalesce(col, F.lit("")), "(?d)<.*?>", ""))


# ---------------------------------------------------------------- multi-valued text


def split_raw(col: Column, separators: str = TERM_SEPARATORS) -> Column:
    """Trimmed, non-empty terms in their written order, duplicates kept."""
    parts = F.transform(F.split(F.coalesce(col, F.lit("")), separators), strip_ws)
    return F.filter(parts, lambda t: t != "")


def _by_lower(a: Column, b: Column) -> Column:
    la, lb = F.lower(a), F.lower(b)
    return (
        F.when(la < lb, -1).when(la > lb, 1).when(a < b, -1).when(a > b, 1).otherwise(0)
    )


def sort_by_lower(terms: Column) -> Column:
    return F.array_sort(terms, _by_lower)


def split_terms(col: Column) -> Column:
    """Distinct terms (case-sensitive) sorted by lower case, then by exact text."""
    return sort_by_lower(F.array_distinct(split_raw(col)))


def ordered_terms(col: Column, limit: int) -> Column:
    """First ``limit`` terms in written order; ``/`` does not separate here."""
    return F.slice(split_raw(col, "[,|;]"), 1, limit)


def tag_key(col: Column) -> Column:
    plain = F.lower(strip_accents(col))
    return collapse_ws(F.regexp_replace(plain, "[-_/]+", " "))


def clean_tags(col: Column, noise: list[str]) -> Column:
    if not noise:
        return F.array_join(split_raw(col), " ")
    return F.array_join(F.filter(split_raw(col), lambda t: ~tag_key(t).isin(*noise)), " ")


# ---------------------------------------------------------------- rule labels


def _any_pattern(patterns: list[str]) -> str:
    # U: Unicode classes and word borders; d: only \n ends a line.
    return "(?Ud)" + "|".join(f"(?:{p})" for p in patterns)


# Letters, digits and blanks, optional single ones, word borders and gaps: nothing else.
_SIMPLE_PATTERN = re.compile(r"(?:\\b|[^\W_]\?|[^\W_]|[ ]|\.\{\d+,\d+\}|\.\*)+")
_NOT_LITERAL = re.compile(r"\\b|[^\W_]\?|\.\{\d+,\d+\}|\.\*")


def needed_parts(pattern: str) -> list[str]:
    """Strings that any match of ``pattern`` holds; none if it is more than a simple pattern."""
    if not _SIMPLE_PATTERN.fullmatch(pattern):
        return []
    return [part for part in _NOT_LITERAL.split(pattern) if part]


def _matches_any(text: Column, patterns: list[str]) -> Column:
    """Plain searches for the parts a pattern needs are far cheaper than the pattern."""
    needs = [needed_parts(p) for p in patterns]
    open_ones = [p for p, parts in zip(patterns, needs, strict=True) if not parts]
    tests = [
        reduce(lambda a, b: a & b, [F.contains(text, F.lit(x)) for x in parts]) & text.rlike(_any_pattern([p]))
        for p, parts in zip(patterns, needs, strict=True)
        if parts
    ]
    if open_ones or not tests:
        tests.append(text.rlike(_any_pattern(open_ones)))
    return reduce(lambda a, b: a | b, tests)


def rule_labels(text: Column, rules: dict[str, list[str]]) -> Column:
    """Labels whose patterns match anywhere in ``text``, in rule order."""
    return F.array_compact(
        F.array(*[F.when(_matches_any(text, p), F.lit(label)) for label, p in rules.items()])
    )


def combo_labels(labels: Column, combos: list[tuple[str, list[str], list[str]]]) -> Column:
    """Extra labels for (needed, any-of, appended) combos, in rule order."""
    if not combos:
        return F.array().cast("array<string>")
    parts = [
        F.when(
            F.array_contains(labels, needed)
            & F.arrays_overlap(labels, F.array(*[F.lit(x) for x in any_of])),
            F.array(*[F.lit(x) for x in appended]),
        ).otherwise(F.array().cast("array<string>"))
        for needed, any_of, appended in combos
    ]
    return F.concat(*parts)


def hint_text(*cols: Column) -> Column:
    return F.lower(strip_accents(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in cols])))


def infer_hints(text: Column, rules, combos) -> Column:
    # One element, so that the rules are searched once for all combos.
    once = F.array(rule_labels(text, rules))
    return F.get(F.transform(once, lambda labels: F.concat(labels, combo_labels(labels, combos))), 0)


# ---------------------------------------------------------------- tokens and queries


def tokenize(col: Column, stop_words: list[str]) -> Column:
    tokens = F.regexp_extract_all(strip_accents(F.lower(col)), F.lit(TOKEN_PATTERN), F.lit(0))
    if not stop_words:
        return tokens
    return F.filter(tokens, lambda t: ~t.isin(*stop_words))


def ngrams(tokens: Column, low: int = 1, high: int = 2) -> Column:
    """All n-grams of the sizes ``low``..``high``; stop words must be gone already."""
    parts = []
    for n in range(low, high + 1):
        gram = tokens
        for offset in range(1, n):
            tail = F.slice(tokens, F.lit(offset + 1), F.greatest(F.size(tokens) - offset, F.lit(0)))
            gram = F.zip_with(gram, tail, lambda a, b: F.concat(a, F.lit(" "), b))
        # zip_with pads the shorter side with NULL and concat turns that into NULL
        parts.append(F.array_compact(gram) if n > 1 else gram)
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def query_tokens(col: Column) -> Column:
    plain = F.lower(strip_accents(F.coalesce(col, F.lit(""))))
    return F.regexp_extract_all(plain, F.lit("[a-z0-9]+"), F.lit(0))


def _has_plural_s(token: Column) -> Column:
    return token.endswith("s") & (F.length(token) > 3)


def _drop_last(token: Column) -> Column:
    return F.substring(token, F.lit(1), F.length(token) - 1)


def expand_query(col: Column, expansions: dict[str, str]) -> Column:
    """Each token, its form without a final ``s``, then its mapped text."""

    def grow(token: Column) -> Column:
        variants = [token, F.when(_has_plural_s(token), _drop_last(token))]
        if expansions:
            variants.append(F.try_element_at(_constant_map(expansions), token))
        return F.array_compact(F.array(*variants))

    return F.array_join(F.flatten(F.transform(query_tokens(col), grow)), " ")


def query_concepts(col: Column, concepts: dict[str, list[str]], stop_words: list[str]) -> Column:
    """One array of accepted variants per query token that is not a stop word."""
    tokens = query_tokens(col)
    if stop_words:
        tokens = F.filter(tokens, lambda t: ~t.isin(*stop_words))
    plain = {
        key: sorted({fold(v) for v in variants if v}) for key, variants in concepts.items()
    }

    def variants(token: Column) -> Column:
        own = F.array_sort(
            F.array_distinct(
                F.array(F.when(_has_plural_s(token), _drop_last(token)).otherwise(token), token)
            )
        )
        if not plain:
            return own
        mapped = F.create_map(
            *[x for k, v in plain.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))]
        )
        return F.coalesce(F.try_element_at(mapped, token), own)

    return F.transform(tokens, variants)


def fold(value: str) -> str:
    """Driver-side twin of ``lower(strip_accents(x))`` for lexicon entries."""
    decomposed = unicodedata.normalize("NFKD", value)
    return "".join(c for c in decomposed if not unicodedata.combining(c)).lower()


def contains_any_regex(words: list[str]) -> str:
    return "|".join(re.escape(w.lower()) for w in words)
