"""Name and address normalisation as column expressions; no Python runs per row.

Nulls count as empty strings. Accents, ligatures and wide forms are folded by a table made from Unicode's decompositions. A
learned dictionary (a map column or literal) replaces non-Latin tokens; those it lacks are spelled by a table made from the names of Unicode's
letters, which covers alphabets, Indic scripts and kana. Characters of other scripts stay, and count as spaces later.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon

#: Where letters with compatibility forms and the scripts that are spelled out lie.
_FOLDED = [*range(0xA0, 0x2500), *range(0x2C60, 0x2C80), *range(0x3200, 0x3400), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800)]
_SPELLED = [*range(0x370, 0x700), *range(0x900, 0xE00), *range(0x10A0, 0x1100), *range(0x3041, 0x3100)]


def _fold(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))


def _spelled(c: str) -> str | None:
    """The Latin spelling of a letter, sign or digit by its Unicode name: the consonants that the name begins with, or its first vowel."""
    name = unicodedata.name(c, "")
    if unicodedata.digit(c, None) is not None:
        return str(unicodedata.digit(c))
    sign = re.search(r" SIGN (\w+)$", name)
    if sign and sign[1] in lexicon.SIGNS:
        return lexicon.SIGNS[sign[1]]
    letter = re.match(r"(\w+) (?:SMALL LETTER|CAPITAL LETTER|LETTER|VOWEL SIGN) (?:FINAL |SMALL |VOCALIC )?(.+?)(?: WITH .*)?$", name)
    if not letter:
        return None
    script, own = letter.groups()
    if script in ("GREEK", "CYRILLIC"):
        if own in lexicon.LETTERS:
            return lexicon.LETTERS[own]
        if script == "CYRILLIC" and re.fullmatch("E[LMNRSF]", own):
            return own[1].lower()
    if script in ("HIRAGANA", "KATAKANA"):
        return own.lower() if " " not in own else None
    begin = re.match(r"[BCDFGHJKLMNPQRSTVWXYZ]+", own)
    out = begin[0] if begin else own[:1]
    return re.sub(r"(.)\1", r"\1", out).lower()


def _tables(points: list[int], of) -> tuple[str, str, dict[str, str]]:
    """What becomes one letter, those letters (what becomes nothing comes last), and what becomes several."""
    one, none, many = {}, [], {}
    for c in map(chr, points):
        x = of(c)
        if x is None or x == c:
            continue
        if len(x) == 1:
            one[c] = x
        elif x:
            many[c] = x
        else:
            none.append(c)
    return "".join([*one, *none]), "".join(one.values()), many


def _plain_fold(c: str) -> str | None:
    """The fold of a character that is no combining mark, if it leaves scripts other than Latin alone."""
    x = _fold(c)
    return x if x and all(ord(y) < 0x250 or y == "\u2044" or not y.isalpha() for y in x) else None


_MARKS = "".join(chr(c) for c in range(0x300, 0x370))
_FROM, _TO, _LIGATURES = _tables(_FOLDED, _plain_fold)
_LETTERS, _LATIN, _DIGRAPHS = _tables(_SPELLED, _spelled)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lookup(table: dict[str, str]) -> Column:
    return F.map_from_arrays(F.lit(list(table)), F.lit(list(table.values())))


def mapped(key: Column, table: dict[str, str]) -> Column:
    """table[key], else null."""
    return F.try_element_at(lookup(table), key)


def is_latin(s: Column) -> Column:
    return ~s.rlike(r"[^\x{0}-\x{24F}]")


def _replaced(s: Column, single: str, to: str, several: dict[str, str]) -> Column:
    """s with single characters translated, and those of several replaced where there are any."""
    held, table = "[" + "".join(several) + "]", lookup(several)
    each = lambda x: F.array_join(F.transform(F.split(x, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    return let(F.translate(s, single, to), lambda x: F.when(x.rlike(held), each(x)).otherwise(x))


def strip_accents(s: Column) -> Column:
    """Compatibility forms decomposed, combining marks dropped."""
    return _replaced(s, _FROM + _MARKS, _TO, _LIGATURES)


def spelled(t: Column) -> Column:
    """A token in Latin letters, as far as its script is known."""
    return _replaced(strip_accents(t), _LETTERS, _LATIN, _DIGRAPHS)


def to_latin(s: Column, words: Column | None = None) -> Column:
    """Tokens with non-Latin letters are replaced by the dictionary words (a map), else spelled out."""
    cut = lexicon.SEPARATORS
    found = spelled if words is None else lambda t: F.coalesce(F.try_element_at(words, t), spelled(t))
    token = lambda t: F.when(is_latin(t), t).otherwise(let(found(t), lambda x: F.coalesce(mapped(x, lexicon.STATE_WORDS), x)))
    pieces = lambda x: F.regexp_extract_all(x, F.lit(rf"[{cut}]+|[^{cut}]+"), F.lit(0))
    return let(s, lambda x: F.when(is_latin(x), x).otherwise(F.array_join(F.transform(pieces(x), token), "")))


def base_clean(s: Column, words: Column | None = None) -> Column:
    return F.lower(strip_accents(to_latin(F.coalesce(s, F.lit("")), words)))


def tokens(s: Column) -> Column:
    """Words between white space; the empty string has none."""
    return F.filter(F.split(s, r"\s+"), lambda t: t != "")


def fix_leet(t: Column) -> Column:
    """Digits that stand for letters, in words with a digit and two letters or more."""
    mixed = t.rlike("[0-9]") & t.rlike("[a-z].*[a-z]")
    return F.when(mixed, F.translate(t, lexicon.LEET_FROM, lexicon.LEET_TO)).otherwise(t)


def _junk(s: Column) -> Column:
    return F.regexp_replace(s, lexicon.JUNK, " ")


def norm_name(raw: Column, words: Column | None = None) -> Column:
    """Struct of name_clean, name_core, name_sorted, name_concat, legal, is_domain."""
    return let(F.trim(_junk(F.trim(base_clean(raw, words))), F.lit(" -.,")), _name_parts)


def _name_parts(s: Column) -> Column:
    domain = F.regexp_extract(s, lexicon.DOMAIN, 1)
    is_domain = (domain != "") & ~F.contains(s, F.lit(" "))
    s = F.when(is_domain, F.replace(domain, F.lit("-"), F.lit(""))).otherwise(s)
    padded = F.concat(F.lit(" "), s, F.lit(" "))
    at = F.instr(padded, " dba ")
    after, before = F.trim(F.substring(padded, at + 5, F.length(padded))), F.trim(F.substring(padded, F.lit(1), at - 1))
    s = F.when(at == 0, s).when(after != "", after).when(before != "", before).otherwise(s)
    s = F.regexp_replace(F.replace(s, F.lit("&"), F.lit(" and ")), lexicon.ACRONYM_DOT, "")
    s = F.regexp_replace(F.translate(s, ".'", ""), "[^0-9a-z ]+", " ")
    return let(F.transform(tokens(s), fix_leet), lambda toks: _name_of_tokens(toks, is_domain))


def _name_of_tokens(toks: Column, is_domain: Column) -> Column:
    clean = F.transform(toks, lambda t: F.coalesce(mapped(t, lexicon.LEGAL), t))
    legal = F.array_sort(F.array_distinct(F.filter(F.transform(toks, lambda t: mapped(t, lexicon.LEGAL)), lambda t: t.isNotNull())))
    rest = F.filter(toks, lambda t: ~t.isin([*lexicon.LEGAL, *lexicon.FILLER]))
    core = F.when(F.size(rest) > 0, rest).otherwise(clean)
    return F.struct(
        F.array_join(clean, " ").alias("name_clean"), F.array_join(core, " ").alias("name_core"),
        F.array_join(F.array_sort(F.array_distinct(core)), " ").alias("name_sorted"), F.array_join(core, "").alias("name_concat"),
        F.array_join(legal, " ").alias("legal"), is_domain.cast("byte").alias("is_domain"),
    )


def state_of(component: Column, country: Column) -> Column:
    """Canonical code of a component that is a state of the country, else null; unknown countries know full names only."""
    merged = {**lexicon.STATES["france"], **lexicon.STATES["india"], **lexicon.STATES["us"]}
    out = F.when(~country.isin(list(lexicon.STATES)), F.when(F.length(component) > 3, mapped(component, merged)))
    for name, table in lexicon.STATES.items():
        code = F.when((F.length(component) == 2) & component.isin(sorted(set(table.values()))), component)
        out = out.when(country == name, F.coalesce(mapped(component, table), code))
    return out


def norm_token(t: Column) -> Column:
    """Ordinals and numbers without leading zeros; street words in canonical spelling."""
    number = F.regexp_extract(t, r"^([0-9]+)(?:st|nd|rd|th)?$", 1)
    bare = F.regexp_replace(number, "^0+(?=[0-9])", "")
    return F.when(number != "", bare).otherwise(F.coalesce(mapped(t, lexicon.STREET), t))


def _is_number(t: Column) -> Column:
    return t.rlike("^[0-9]+$")


def components(raw: Column, words: Column | None = None) -> Column:
    """The comma-separated components of an address, cleaned; empty ones are dropped."""
    s = F.regexp_replace(base_clean(raw, words), r"\bnull\b", " ")
    s = F.replace(F.replace(_junk(s), F.lit("&"), F.lit(" and ")), F.lit("'"), F.lit(""))
    parts = F.transform(F.split(s, ","), lambda c: F.array_join(tokens(F.regexp_replace(c, "[^0-9a-z ]+", " ")), " "))
    return F.filter(parts, lambda c: c != "")


def norm_address(raw: Column, country: Column, words: Column | None = None) -> Column:
    """Struct of addr_clean, addr_nums, house, street, city, state, postcode."""
    return let(components(raw, words), lambda comps: _address_parts(comps, F.lower(F.coalesce(country, F.lit("")))))


def _address_parts(comps: Column, land: Column) -> Column:
    first = lambda a: F.coalesce(F.get(a, F.lit(0)), F.lit(""))
    state = first(F.filter(F.transform(comps, lambda c: state_of(c, land)), lambda x: x.isNotNull()))
    kept = F.transform(F.filter(comps, lambda c: state_of(c, land).isNull()), lambda c: F.transform(tokens(c), norm_token))
    return let(kept, lambda k: _address_of_tokens(k, state))


def _address_of_tokens(kept: Column, state: Column) -> Column:
    first = lambda a: F.coalesce(F.get(a, F.lit(0)), F.lit(""))
    has_type = lambda ts: F.exists(ts, lambda t: t.isin(list(lexicon.STREET_TYPES)))
    flagged = F.transform(kept, lambda ts: F.exists(ts, _is_number) | has_type(ts))
    at = F.array_position(flagged, True)
    empty = F.array().cast("array<string>")
    street_comp = F.coalesce(F.get(kept, (at - 1).cast("int")), empty)
    every = F.flatten(kept)
    nums = F.filter(every, _is_number)
    house = F.coalesce(F.get(F.filter(street_comp, _is_number), F.lit(0)), F.get(nums, F.lit(0)), F.lit(""))
    plain = F.filter(street_comp, lambda t: ~_is_number(t) & ~t.isin([*lexicon.STREET_TYPES, *lexicon.STREET_EXTRAS]))
    towns = F.filter(kept, lambda ts, i: (i + 1 != at) & ~F.exists(ts, _is_number))
    city = F.filter(F.flatten(towns), lambda t: ~t.isin([*lexicon.CITY_NOISE, *lexicon.STREET_TYPES]))
    return F.struct(
        F.array_join(every, " ").alias("addr_clean"), F.array_join(F.array_distinct(nums), " ").alias("addr_nums"), house.alias("house"),
        F.array_join(plain, " ").alias("street"), F.array_join(F.array_distinct(city), " ").alias("city"), state.alias("state"),
        first(F.filter(nums, lambda n: F.length(n) == 6)).alias("postcode"),
    )


def text_key(s: Column) -> Column:
    """A signature under which texts count as the same: lower case, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(s), r"\s+", " "))
