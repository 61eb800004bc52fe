"""The Snowball English stemmer as column expressions.

Suffixes count only inside regions of the word: R1 begins after the first
consonant that follows a vowel, R2 after the next such place. Both are numbers
computed once; every step looks for the longest of its suffixes and rewrites it
where the step's conditions hold.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

# Fixed values of the published algorithm.
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT_AFTER_PLURALS = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate",
    "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
    "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion"]
BEFORE = {"ogi": "l", "li": "[cdeghkmnrt]", "ion": "[st]"}
FIRST_REGION = "^(?:gener|commun|arsen)|^.*?[aeiouy][^aeiouy]"
NEXT_REGION = "^.*?[aeiouy][^aeiouy]"
#: A syllable that keeps a final e: consonant, vowel, consonant other than w, x, Y; or a vowel and a consonant that are the word.
SHORT = "(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"
DOUBLE = "(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), lambda x: body(x))[0]


def _longest(w: Column, rules: dict[str, str], holds: Callable[[str, Column], Column]) -> Column:
    """The longest suffix of `rules` at the end of w is rewritten where `holds(suffix, length of what precedes it)`."""
    out = None
    for suffix in sorted(rules, key=lambda s: (-len(s), s)):
        stem = F.length(w) - len(suffix)
        found = F.endswith(w, F.lit(suffix))
        made = F.when(holds(suffix, stem), F.concat(F.substring(w, F.lit(1), stem), F.lit(rules[suffix]))).otherwise(w)
        out = F.when(found, made) if out is None else out.when(found, made)
    return out.otherwise(w)


def _preceded(w: Column, suffix: str, stem: Column) -> Column:
    need = BEFORE.get(suffix)
    return F.rlike(F.substring(w, F.lit(1), stem), F.lit(f"{need}$")) if need else F.lit(True)


def _plurals(w: Column) -> Column:
    ies = F.when(F.length(w) > 4, F.regexp_replace(w, "ie[sd]$", "i")).otherwise(F.regexp_replace(w, "ie[sd]$", "ie"))
    return (F.when(F.endswith(w, F.lit("sses")), F.regexp_replace(w, "sses$", "ss")).when(F.rlike(w, F.lit("ie[sd]$")), ies)
            .when(F.rlike(w, F.lit("[us]s$")), w).when(F.rlike(w, F.lit("[aeiouy].+s$")), F.regexp_replace(w, "s$", "")).otherwise(w))


def _past_forms(w: Column, r1: Column) -> Column:
    def mended(x: Column) -> Column:
        short = (F.length(x) <= r1) & F.rlike(x, F.lit(SHORT))
        return (F.when(F.rlike(x, F.lit("(?:at|bl|iz)$")), F.concat(x, F.lit("e"))).when(F.rlike(x, F.lit(DOUBLE)), F.regexp_replace(x, ".$", ""))
                .when(short, F.concat(x, F.lit("e"))).otherwise(x))

    eed = F.when(F.length(F.regexp_replace(w, "eed(?:ly)?$", "")) >= r1, F.regexp_replace(w, "eed(?:ly)?$", "ee")).otherwise(w)
    return (F.when(F.rlike(w, F.lit("eed(?:ly)?$")), eed)
            .when(F.rlike(w, F.lit("[aeiouy].*(?:ed|edly|ing|ingly)$")), _let(F.regexp_replace(w, "(?:edly|ingly|ed|ing)$", ""), mended)).otherwise(w))


def _last_letters(w: Column, r1: Column, r2: Column) -> Column:
    before = F.regexp_replace(w, ".$", "")
    stem = F.length(w) - 1
    e = F.endswith(w, F.lit("e")) & ((stem >= r2) | ((stem >= r1) & ~F.rlike(before, F.lit(SHORT))))
    return F.when(e | (F.endswith(w, F.lit("ll")) & (stem >= r2)), before).otherwise(w)


def _stem(marked: Column) -> Column:
    """The stem of a word of three letters or more that is no exception, consonant y's written Y."""
    def regions(w: Column) -> Column:
        r1 = F.when(F.rlike(w, F.lit(FIRST_REGION)), F.length(F.regexp_extract(w, FIRST_REGION, 0))).otherwise(F.length(w))
        return _let(r1, lambda one: _let(_second(w, one), lambda two: steps(w, one, two)))

    def _second(w: Column, one: Column) -> Column:
        rest = F.substring(w, one + 1, F.length(w))
        return F.when(F.rlike(rest, F.lit(NEXT_REGION)), one + F.length(F.regexp_extract(rest, NEXT_REGION, 0))).otherwise(F.length(w))

    def steps(w: Column, r1: Column, r2: Column) -> Column:
        two = lambda x: _longest(x, STEP_2, lambda s, n: (n >= r1) & _preceded(x, s, n))
        three = lambda x: _longest(x, STEP_3, lambda s, n: n >= (r2 if s == "ative" else r1))
        four = lambda x: _longest(x, dict.fromkeys(STEP_4, ""), lambda s, n: (n >= r2) & _preceded(x, s, n))
        later: list[Callable[[Column], Column]] = [
            lambda x: _past_forms(x, r1), lambda x: F.regexp_replace(x, "(?<=.[^aeiouy])[yY]$", "i"), two, three, four, lambda x: _last_letters(x, r1, r2)]
        first = _let(F.regexp_replace(w, "'s'$|'s$|'$", ""), _plurals)
        return _let(first, lambda x: F.when(x.isin(KEPT_AFTER_PLURALS), x).otherwise(_chain(x, later)))

    return _let(marked, regions)


def _chain(x: Column, steps: Sequence[Callable[[Column], Column]]) -> Column:
    return x if not steps else _let(steps[0](x), lambda y: _chain(y, steps[1:]))


def snowball_word(word: Column) -> Column:
    """The stem of a lower-case word; null stays null."""
    named = F.create_map(*[F.lit(x) for pair in EXCEPTIONS.items() for x in pair])
    marked = F.regexp_replace(F.regexp_replace(word, "^'", ""), "^y|(?<=[aeiouy])y", "Y")
    stem = F.regexp_replace(_stem(marked), "Y", "y")
    return F.when(word.isin(list(EXCEPTIONS)), F.element_at(named, word)).when(F.length(word) <= 2, word).otherwise(stem)
