"""Text normalisation as column expressions.

Python's white space is Java's Unicode white space and the separators U+001C to U+001F, so patterns here add
those. A null text stays null.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = "[\\s\\x1c-\\x1f]"


def _lstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"(?U)^{WS}+", "")


def _rstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"(?U)(?<!{WS}){WS}+\\z", "")


def strip(c: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(c, f"(?U)^{WS}+|(?<!{WS}){WS}+\\z", "")


def _latin() -> tuple[str, str, dict[str, str]]:
    """One-to-one and one-to-many replacements of Latin letters: the ASCII part of the compatibility decomposition, and letters that have none."""
    # Letters without a decomposition, and common punctuation.
    lone = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "Th", "ł": "l", "Ł": "L", "ħ": "h", "Ħ": "H", "ı": "i", "‘": "'", "’": "'", "‚": ",", "“": '"', "”": '"', "„": ",,", "–": "-", "—": "--", "…": "...", "•": "*", "×": "x", "÷": "/", "°": "deg", "«": "<<", "»": ">>", "¿": "?", "¡": "!", "€": "EUR", "£": "PS", "©": "(c)", "®": "(r)", "™": "(tm)"}
    one, many = {}, {}
    for c in [*map(chr, range(0xA1, 0x250)), *map(chr, range(0x1E00, 0x1F00)), *lone]:
        to = lone.get(c) or unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()
        if len(to) == 1:
            one[c] = to
        elif to:
            many[c] = to
    return "".join(one), "".join(one.values()), {k: v for k, v in many.items() if k in lone}


def to_ascii(c: Column) -> Column:
    """Latin letters and common punctuation in ASCII; other characters that aren't ASCII go."""
    source, target, many = _latin()
    for k, v in many.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return F.regexp_replace(F.translate(c, source, target), "[^\\x00-\\x7F]", "")


def clean_text(c: Column) -> Column:
    """The cleaning of exported notes; the order of its steps is part of the result."""
    c = F.regexp_replace(c, "[\\t\\r\\n]", "   ")
    for old, new in (("\xa0 ", " "), ("'", '"'), ("&gt;", ">"), ("&lt;", "<"), ("&amp;", " and "), ("&#x20;", " "), ("   ", "\n"), ("•", "\t")):
        c = F.replace(c, F.lit(old), F.lit(new))
    c = F.regexp_replace(c, "[\\x1d\\xa0\\x1c\\x14]", " ")
    c = F.regexp_replace(c, "### invalid font number [0-9]+", " ")
    return to_ascii(F.regexp_replace(c, " +", " "))


def strip_operators(c: Column) -> Column:
    """Without a leading run of arithmetic signs, then without white space at the ends."""
    return strip(F.regexp_replace(c, "^[-+*/=]+", ""))


def normalize_text(c: Column, operators: bool = False) -> Column:
    """Lower case, runs of white space as one space, none at the ends; ``operators`` also drops leading signs."""
    c = strip(F.regexp_replace(F.lower(c), f"(?U){WS}+", " "))
    return strip_operators(c) if operators else c


#: What stands for a gendered word, and the words it stands for.
IDENTIFIERS = (("they", "s?he"), ("them", "him|her"), ("their", "his|hers"), ("themselves", "(?:him|her)self"), ("person", "male|female|girl|boy|man|woman"), ("patient", "(?:mr|mrs|ms|miss)\\.? \\w*"), ("partner", "husband|wife"))


def swap_identifiers(c: Column) -> Column:
    """Gendered words and titled names by neutral ones, one kind after the other."""
    for neutral, words in IDENTIFIERS:
        c = F.regexp_replace(c, f"(?iuU)\\b(?:{words})\\b", neutral)
    return c


def title_case(c: Column) -> Column:
    """Every run of letters capitalised, so that a letter after a hyphen is a capital too."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit("\\p{L}+|\\P{L}+"), F.lit(0)), F.initcap), "")


def negated_keyword(keyword: Column, text: Column) -> Column:
    """The first place in the text where a negator stands before the keyword, with it; the keyword if there is none.

    The keyword is part of the pattern unescaped, and the negator may be the end of a longer word.
    """
    found = F.call_function("regexp_extract", text, F.concat(F.lit("(?iuU)(cannot|not|\\w*n't)(\\s)?\\b"), keyword, F.lit("\\b")), F.lit(0))
    return F.coalesce(F.nullif(found, F.lit("")), keyword)


def remove_keyword(text: Column, keyword: Column) -> Column:
    """Without the keyword and a negator right before it; case counts, the keyword is a pattern."""
    return F.regexp_replace(text, F.concat(F.lit("(?uU)(cannot|not|\\w*n't)?(\\s)?\\b"), keyword, F.lit("\\b")), F.lit(""))


# ---- context windows ------------------------------------------------------------------------------------

#: White space that parts no words, and what else is none.
_BLANK, _SOLID = "[\\s\\x1c-\\x1f&&[^ ]]", "[^\\s\\x1c-\\x1f]"


def word_units(text: Column) -> Column:
    """The words of a text that aren't blank, each with the blank words after it; only the ASCII space parts words.

    Joined by spaces they are the text without its leading white space.
    """
    return F.regexp_extract_all(text, F.lit(f"(?U)(?<!{_BLANK}){_BLANK}*{_SOLID}[^ ]*{WS}*(?= |\\z)"), F.lit(0))


def units_begun(c: Column) -> Column:
    """How many units begin behind a space of a piece of text."""
    return F.regexp_count(c, F.lit(f"(?U) {_BLANK}*{_SOLID}"))


def ends_blank(c: Column) -> Column:
    """Whether only white space stands behind the last space of a piece of text."""
    return c.rlike(f"(?U) {_BLANK}*\\z")


def unit_window(units: Column, length: Column, first: Column, last: Column, end: Column, size: int) -> Column:
    """:func:`context_window` without cleaning, of a hit that ends at ``end`` and lies in the units ``first`` to ``last`` (from 0) of a text of ``length`` characters.

    Every unit holds a word at least, so ``size`` of them on either side are enough, whatever blank words they bring.
    """
    n, low = F.size(units), F.greatest(first - size, F.lit(0))
    before = _rstrip(F.array_join(F.slice(units, low + 1, first - low), " "))
    before = F.split(F.when(low == 0, _lstrip(before)).otherwise(before), " ", -1)
    behind = _lstrip(F.array_join(F.slice(units, last + 2, F.lit(size)), " "))
    behind = F.split(F.when(last + 1 + size >= n, _rstrip(behind)).otherwise(behind), " ", -1)

    def joined(word: Column) -> Column:
        closed = (last + 1 == n) & (F.locate(" ", F.get(units, last)) == 0)  # the text ends with this word
        cut = closed & (end < length)
        inside = F.concat(F.array_join(F.slice(units, first + 1, last - first), " "), F.when(last > first, " ").otherwise(""), F.when(cut, F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word))
        right = F.when(cut, F.array(strip(F.right(word, F.lit(1))))).when(last + 1 == n, F.array(F.lit(""))).otherwise(F.slice(behind, 1, size))
        left = F.when(first == 0, F.array(F.lit(""))).otherwise(_last(before, size))
        return F.array_join(F.concat(left, _pieces(inside), right), " ")

    return _let(F.substring_index(F.get(units, last), " ", 1), joined)


_NEAR = 480


def _pieces(side: Column) -> Column:
    return F.split(strip(side), " ", -1)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is worked out once however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _last(pieces: Column, size: int) -> Column:
    return F.slice(pieces, F.greatest(F.size(pieces) - size + 1, F.lit(1)), F.lit(size))


def _whole_window(text: Column, start: Column, end: Column, size: int) -> Column:
    """The words round a hit, looked up in the whole text."""
    n = F.length(text)
    a = start - F.length(F.substring_index(F.substring(text, F.lit(1), start), " ", -1))
    rest = F.substring(text, end + 1, n)
    gap = F.when(F.locate(" ", rest) > 0, F.locate(" ", rest) - 1).otherwise(n)
    b = F.greatest(end, F.least(end + gap, n - 1))
    left, right = _pieces(F.substring(text, F.lit(1), a)), _pieces(F.substring(text, b + 1, n))
    return F.array_join(F.concat(_last(left, size), _pieces(F.substring(text, a + 1, b - a)), F.slice(right, 1, size)), " ")


def _near_window(left: Column, right: Column, length: Column, start: Column, size: int) -> Column:
    """The same from the characters before a hit, and from those of the hit and after it; null if they don't reach far enough."""
    first, last = start <= _NEAR, F.length(right) < length + _NEAR  # the text's own ends are there
    word = F.length(F.substring_index(left, " ", -1))
    after = F.locate(" ", F.substring(right, length + 1, F.lit(_NEAR)))
    until = F.when(after > 0, length + after - 1).otherwise(F.length(right))
    until = F.when(last, F.greatest(length, F.least(until, F.length(right) - 1))).otherwise(until)

    def cut(x: Column) -> Column:
        before, behind = _pieces(F.substring(left, F.lit(1), F.length(left) - x["word"])), _pieces(F.substring(right, x["until"] + 1, F.lit(_NEAR)))
        middle = F.concat(F.substring(left, F.length(left) - x["word"] + 1, x["word"]), F.substring(right, F.lit(1), x["until"]))

        def joined(y: Column) -> Column:
            enough = (first | ((x["word"] < F.length(left)) & (F.size(y["before"]) > size))) & (last | (x["found"] & (F.size(y["behind"]) > size)))
            return F.when(enough, F.array_join(F.concat(_last(y["before"], size), _pieces(middle), F.slice(y["behind"], 1, size)), " "))

        return _let(F.struct(before.alias("before"), behind.alias("behind")), joined)

    return _let(F.struct(word.alias("word"), until.alias("until"), (after > 0).alias("found")), cut)


def context_window(text: Column, start: Column, end: Column, size: int = 10, clean: bool = True, operators: bool = False) -> Column:
    """The words round text[start:end], ``size`` on either side; offsets count from 0.

    Only the ASCII space parts words, so several in a row make empty words that count. The span grows to the spaces round it;
    to the right it stops before the text's last character, which without a space counts as a word of its own.
    Most windows are cut from two stretches of characters nearby, and only those that don't fit look at the whole text.
    """
    if size < 1:
        raise ValueError("the window holds at least one word")
    left, right = F.substring(text, F.greatest(start - _NEAR + 1, F.lit(1)), F.least(start, F.lit(_NEAR))), F.substring(text, start + 1, end - start + _NEAR)
    near = _let(F.struct(left.alias("left"), right.alias("right")), lambda x: _near_window(x["left"], x["right"], end - start, start, size))
    out = F.coalesce(near, _whole_window(text, start, end, size))
    if clean:
        out = normalize_text(clean_text(out))
    return strip_operators(out) if operators else out
