"""Column-in, column-out expressions. All run inside the JVM; none is a UDF."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hearsay.vocab import PUNCTUATION


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def string_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


# --- time -------------------------------------------------------------------


def epoch_to_ts(c: str | Column) -> Column:
    """Epoch seconds to timestamp."""
    return F.timestamp_seconds(as_col(c))


def day_of(c: str | Column) -> Column:
    return F.to_date(as_col(c))


def month_label(c: str | Column) -> Column:
    """`2021-1` style label: no leading zero on the month."""
    c = as_col(c)
    return F.concat_ws("-", F.year(c).cast("string"), F.month(c).cast("string"))


def month_label_to_date(c: str | Column) -> Column:
    return F.to_date(as_col(c), "yyyy-M")


# --- strings ----------------------------------------------------------------


def strip_punct(c: str | Column, mode: str = "delete") -> Column:
    """Take punctuation out.

    `delete` maps the first mark (`!`) to a space and deletes the other thirty,
    as a one-space `translate` target does; `space` turns each mark into a space.
    """
    if mode not in ("delete", "space"):
        raise ValueError(f"unknown mode {mode!r}")
    target = " " if mode == "delete" else " " * len(PUNCTUATION)
    return F.translate(as_col(c), PUNCTUATION, target)


def letters_only(c: str | Column) -> Column:
    """Lower-cased text with everything but ASCII letters and white space removed."""
    return F.lower(F.regexp_replace(as_col(c), r"[^a-zA-Z\s]", ""))


def strip_sentence_marks(c: str | Column) -> Column:
    return F.lower(F.regexp_replace(as_col(c), r"[,\.!?]", ""))


def _accent_pairs() -> tuple[str, str]:
    marked, plain = [], []
    for code in range(0x00C0, 0x0180):
        ch = chr(code)
        base = unicodedata.normalize("NFD", ch)[0]
        if base != ch:
            marked.append(ch)
            plain.append(base)
    return "".join(marked), "".join(plain)


ACCENTED, UNACCENTED = _accent_pairs()


def fold_accents(c: str | Column) -> Column:
    """Latin letters without their accents."""
    return F.translate(as_col(c), ACCENTED, UNACCENTED)


def post_body(title: str | Column = "title", text: str | Column = "selftext") -> Column:
    """Title and text of a post joined by a space; a missing part is skipped."""
    return F.concat_ws(" ", as_col(title), as_col(text))


def normalize_terms(
    c: str | Column, rules: Mapping[str, str] | Sequence[tuple[str, str]], compat: bool = False
) -> Column:
    """Rename product names inside a text.

    The default matches whole words from left to right, the longest pattern
    first, and never rewrites its own output: one alternation cuts the text into
    matches and what lies between them, however many rules there are. `compat`
    applies the rules as an ordered chain of plain replacements, each seeing the
    output of the ones before.
    """
    pairs = list(rules.items()) if isinstance(rules, Mapping) else list(rules)
    c = as_col(c)
    if compat:
        for pattern, target in pairs:
            c = F.regexp_replace(c, pattern, target)
        return c
    pairs = sorted(dict(pairs).items(), key=lambda p: (-len(p[0]), p[0]))
    if not pairs:
        return c
    any_term = rf"(?<![\p{{L}}\p{{N}}_])({'|'.join(_quote(pattern) for pattern, _ in pairs)})(?![\p{{L}}\p{{N}}_])"
    targets = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    found = F.transform(F.regexp_extract_all(c, F.lit(any_term), 1), lambda term: targets[term])
    between = F.split(c, any_term)
    return F.array_join(F.zip_with(between, found, lambda text, target: F.concat(text, F.coalesce(target, F.lit("")))), "")


def whole_word(term: str) -> str:
    """Pattern for a term not touching a letter, digit or underscore, accented letters included."""
    return rf"(?<![\p{{L}}\p{{N}}_]){_quote(term)}(?![\p{{L}}\p{{N}}_])"


def _quote(text: str) -> str:
    return "".join("\\" + ch if ch in r"\.^$|?*+()[]{}" else ch for ch in text)


# --- predicates ---------------------------------------------------------------


def community_or_keyword(community: str | Column, text: str | Column, name: str, keyword: str) -> Column:
    """Posted in the community, or the text holds the keyword in any case."""
    return (as_col(community) == name) | F.lower(as_col(text)).contains(keyword.lower())


def mentions(text: str | Column, term: str, match: str = "word") -> Column:
    """Boolean: does the text mention the term?

    `two_case` is the capitalised-or-lower alternation matched anywhere, also
    inside words; `word` ignores case and asks for word boundaries; `substring`
    ignores case and matches anywhere.
    """
    text = as_col(text)
    if match == "two_case":
        return text.rlike(f"{_quote(term.capitalize())}|{_quote(term.lower())}")
    if match == "word":
        # The plain search settles most rows; only texts holding the term reach the pattern.
        return F.lower(text).contains(term.lower()) & text.rlike("(?i)" + whole_word(term))
    if match == "substring":
        return F.lower(text).contains(term.lower())
    raise ValueError(f"unknown match {match!r}")


def like_any(text: str | Column, patterns: Sequence[str]) -> Column:
    """Lower-cased text is LIKE any of the patterns."""
    lowered = F.lower(as_col(text))
    result = lowered.like(patterns[0])
    for p in patterns[1:]:
        result = result | lowered.like(p)
    return result


# --- tokens -------------------------------------------------------------------


def word_tokens(c: str | Column, keep_empty: bool = False) -> Column:
    """Lower-cased text split on white space.

    `keep_empty` splits on each single white-space character, so runs of them
    leave empty tokens behind.
    """
    lowered = F.lower(as_col(c))
    if keep_empty:
        return F.split(lowered, r"\s")
    return F.array_remove(F.split(lowered, r"\s+"), "")


def clean_tokens(c: str | Column, mode: str = "space") -> Column:
    return word_tokens(strip_punct(c, mode))


def normalize_tokens(tokens: str | Column) -> Column:
    """Letters only, lower case, empty tokens dropped."""
    cleaned = F.transform(as_col(tokens), lambda t: F.lower(F.regexp_replace(t, "[^a-zA-Z]", "")))
    return F.array_remove(cleaned, "")


def simple_tokens(c: str | Column, shortest: int = 2, longest: int = 15) -> Column:
    """Accent-free lower-case letter runs of a bounded length."""
    runs = F.regexp_extract_all(fold_accents(F.lower(as_col(c))), F.lit(r"([\p{L}_]+)"), F.lit(1))
    return F.filter(
        runs,
        lambda t: (F.length(t) >= shortest) & (F.length(t) <= longest) & ~t.startswith("_"),
    )


def explode_rows(df: DataFrame, array: str | Column, name: str, *keep: str | Column) -> DataFrame:
    """`keep` columns and one row per element; empty and null arrays give no row.

    The outer form with a filter behind it: for a plain explode the optimiser
    adds a size filter in front, which would build the array a second time.
    """
    return df.select(*keep, F.explode_outer(as_col(array)).alias(name)).where(F.col(name).isNotNull())


def without_stopwords(tokens: str | Column, words: Sequence[str]) -> Column:
    """Drop the listed words, keep order and duplicates (a hash lookup per token)."""
    listed = list(dict.fromkeys(words))
    return F.filter(as_col(tokens), lambda t: ~t.isin(listed))


def stem_word(t: Column) -> Column:
    """Light English suffix stemmer as ordered rewrite rules."""
    for pattern, target in STEM_RULES:
        t = F.regexp_replace(t, pattern, target)
    return t


def _ends(word: Column, endings: Sequence[str]) -> Column:
    return reduce(Column.__or__, [word.endswith(e) for e in endings])


STEM_RULES = (
    (r"^(.+)sses$", "$1ss"),
    (r"^(.{2,})ie[sd]$", "$1i"),
    (r"^(.*[aeiouy].*[^su])s$", "$1"),
    (r"^(.+)eedly$", "$1ee"),
    (r"^(.*[aeiouy].*)(?:ingly|edly)$", "$1"),
    (r"^(.{2,}[aeiouy].*|[^aeiouy]*[aeiouy]+[^aeiouy]+)(?:ing|ed)$", "$1"),
    (r"^(.*[aeiouy].*(?:at|bl|iz))$", "$1e"),
    (r"^(.{2,}[^aeiouy])ly$", "$1"),
    (r"^(.{2,}e)ly$", "$1"),
    (r"^(.+[aeiouy].*)(?:ness|ful)$", "$1"),
    (r"^(.+[^aeiouy])y$", "$1i"),
    (r"^(.{2,}[^aeiouy])e$", "$1"),
)
#: Each rule rewrites words with one of these endings only, or with one before a line end, which a pattern's `$` allows.
STEM_ENDINGS = (
    ("sses",), ("ies", "ied"), ("s",), ("eedly",), ("ingly", "edly"), ("ing", "ed"), ("at", "bl", "iz"), ("ly",), ("ely",), ("ness", "ful"), ("y",), ("e",),
)
LINE_ENDS = ("\n", "\r", "\u0085", "\u2028", "\u2029")


def stem_tokens(tokens: str | Column) -> Column:
    """`stem_word` of all tokens, rule by rule; a rule's pattern is tried on tokens with its endings only."""
    def by_rules(words: Column) -> Column:
        for rule, endings in zip(STEM_RULES, STEM_ENDINGS):
            words = F.transform(words, lambda w: F.when(_ends(w, endings), F.regexp_replace(w, *rule)).otherwise(w))
        return words

    return let(as_col(tokens), lambda words: F.when(F.exists(words, lambda w: _ends(w, LINE_ENDS)), F.transform(words, stem_word)).otherwise(by_rules(words)))


def lemmatize_tokens(tokens: str | Column, lemmas: Mapping[str, str]) -> Column:
    """Replace each listed form by its lemma; meant for small dictionaries."""
    lookup = literal_map(lemmas)
    return F.transform(as_col(tokens), lambda t: F.coalesce(F.try_element_at(lookup, t), t))


def literal_map(mapping: Mapping) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def ngrams(tokens: str | Column, n: int) -> Column:
    """All runs of n neighbouring tokens, joined by a space."""
    return ngrams_of_lengths(tokens, [n])


def ngrams_of_lengths(tokens: str | Column, lengths: Sequence[int]) -> Column:
    """N-grams of all the lengths, each length built from the one below by pairing neighbours."""
    wanted = sorted(set(lengths))

    def build(words: Column) -> Column:
        grams, parts = words, []
        for n in range(1, wanted[-1] + 1):
            if n > 1:
                heads = F.slice(grams, F.lit(1), F.greatest(F.size(grams) - 1, F.lit(0)))
                tails = F.slice(words, F.lit(n), F.greatest(F.size(words) - (n - 1), F.lit(0)))
                grams = F.zip_with(heads, tails, lambda a, b: F.concat(a, F.lit(" "), b))
            if n in wanted:
                parts.append(grams)
        return parts[0] if len(parts) == 1 else F.concat(*parts)

    return let(as_col(tokens), build)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and use it many times in `body`.

    A column used inside a lambda is computed again for every element; bound
    as a lambda variable it is not.
    """
    return F.transform(F.array(value), body)[0]


# --- values -------------------------------------------------------------------


def ordinal(c: str | Column, mapping: Mapping[str, int]) -> Column:
    """Code of a label; a label outside the mapping gives null."""
    return F.try_element_at(literal_map(mapping), as_col(c))


def ratio(numerator: str | Column, denominator: str | Column, digits: int | None = None, scale: float = 1.0) -> Column:
    """Null when the denominator is zero."""
    value = F.try_divide(as_col(numerator) * F.lit(scale), as_col(denominator))
    return value if digits is None else F.round(value, digits)


def total_of(*parts: str | Column, missing: str = "null") -> Column:
    """Sum of counts. `missing` says whether an absent part voids the total or counts as zero."""
    cols = [as_col(p) for p in parts]
    if missing == "zero":
        cols = [F.coalesce(c, F.lit(0)) for c in cols]
    elif missing != "null":
        raise ValueError(f"unknown missing {missing!r}")
    total = cols[0]
    for c in cols[1:]:
        total = total + c
    return total
