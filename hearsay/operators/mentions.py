"""Brand, product and place mentions: each text is matched once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hearsay.functions import columns as C
from hearsay.operators.bloom import bloom_filter
from hearsay.operators.skew import is_small, join_hot_split


def spelling_table(terms: Sequence[str] | Mapping[str, Sequence[str]], match: str) -> dict[str, str]:
    """Spelling -> name. In word matching the spellings go through the same cleaning as the text."""
    named = terms if isinstance(terms, Mapping) else {t: [t] for t in terms}
    table: dict[str, str] = {}
    for name, spellings in named.items():
        for s in spellings:
            key = s.lower()
            if match == "word":
                key = " ".join(key.translate(_MARKS_TO_SPACE).split())
            table.setdefault(key, name)
    return table


_MARKS_TO_SPACE = {ord(ch): " " for ch in C.PUNCTUATION}


def term_hits(text: str | Column, terms: Sequence[str] | Mapping[str, Sequence[str]], match: str = "word") -> Column:
    """Array of the distinct names found in a text.

    `word` tokenises once and intersects the n-grams with the spellings as hash
    sets; `substring` looks for each spelling anywhere in the lower-cased text.
    """
    table = spelling_table(terms, match)
    spellings = C.string_array(list(table))
    if match == "word":
        grams = C.ngrams_of_lengths(C.clean_tokens(text, "space"), [len(s.split()) for s in table])
        found = F.array_intersect(spellings, grams)
    elif match == "substring":
        found = C.let(F.lower(C.as_col(text)), lambda t: F.filter(spellings, lambda s: F.contains(t, s)))
    elif match == "prefix":
        found = C.let(F.lower(C.as_col(text)), lambda t: F.filter(spellings, lambda s: F.startswith(t, s)))
    else:
        raise ValueError(f"unknown match {match!r}")
    if all(s == name for s, name in table.items()):
        return found
    names = C.literal_map(table)
    return F.array_distinct(F.transform(found, lambda s: F.element_at(names, s)))


def explode_mentions(df: DataFrame, text: str, terms: Sequence[str] | Mapping[str, Sequence[str]],
                     out: str = "term", match: str = "word") -> DataFrame:
    """One row per (text, name found); only hits are emitted."""
    return C.explode_rows(df, term_hits(text, terms, match), out, "*")


def explode_term_table(df: DataFrame, row_id: str, text: str, terms: DataFrame, longest: int, out: str = "term",
                       broadcast_rows: int = 200_000) -> DataFrame:
    """As `explode_mentions` for a (spelling, name) table too long to inline.

    The n-grams of each text join to the table, which is broadcast when a
    bounded count shows that it is small. A longer one joins by shuffle, but only
    n-grams that a Bloom filter of the spellings lets through are counted and
    moved: nearly all others are no term. A common word may be one, so the
    spellings in use get their counts and `join_hot_split` spreads the hot ones.
    Returns (row id, name), distinct.
    """
    grams = C.ngrams_of_lengths(C.clean_tokens(text, "space"), range(1, longest + 1))
    flat = C.explode_rows(df, F.array_distinct(grams), "spelling", row_id)
    terms = terms.select("spelling", "name")
    if is_small(terms, broadcast_rows):
        hits = flat.join(F.broadcast(terms), "spelling")
    else:
        names = terms.groupBy("spelling").agg(F.collect_set("name").alias("_names"))
        flat = flat.where(bloom_filter(names, "spelling").might_hold("spelling"))
        used = flat.groupBy("spelling").agg(F.count(F.lit(1)).alias("_rows")).join(names, "spelling")
        found = join_hot_split(flat, used, ["spelling"], "_rows")
        hits = found.select(row_id, F.explode("_names").alias("name"))
    return hits.select(row_id, F.col("name").alias(out)).distinct()


def mention_flags(df: DataFrame, text: str, terms: Sequence[str], match: str = "word") -> DataFrame:
    """One boolean column per term."""
    return df.withColumns({t: C.mentions(text, t, match) for t in terms})


def explode_brands(df: DataFrame, text: str, terms: Sequence[str], match: str = "word", out: str = "brand") -> DataFrame:
    """One row per (text, brand mentioned); one scan instead of a filtered scan per brand."""
    named = F.array_compact(F.array(*[F.when(C.mentions(text, t, match), F.lit(t)) for t in terms]))
    return C.explode_rows(df, named, out, "*")


def attribute_brand(rules: Sequence[tuple[str, Column]], default: str = "general") -> Column:
    """Name of the first rule that holds, else the default."""
    name, condition = rules[0]
    chain = F.when(condition, name)
    for name, condition in rules[1:]:
        chain = chain.when(condition, name)
    return chain.otherwise(default)


def community_or_mention_rules(brands: Mapping[str, str], community: str, text: str, match: str = "word") -> list[tuple[str, Column]]:
    """Rules from brand name -> its community: posted there, or the text says so."""
    return [(b, (F.col(community) == c) | C.mentions(text, b, match)) for b, c in brands.items()]


def place_hits(text: str | Column, places: Sequence[str], match: str = "prefix") -> Column:
    """Places found: `prefix` asks the text to begin with the place, `word` finds it anywhere.

    Places are cleaned like the text, so a name with a dot in it can match. The
    beginning of a text is looked up once per length that places have, so the
    cost doesn't follow the list.
    """
    if match == "word":
        return term_hits(text, places, "word")
    cleaned = F.lower(C.strip_punct(text, "delete"))
    by_length: dict[int, dict[str, list[str]]] = {}
    for place in places:
        form = place.translate({ord(ch): None for ch in C.PUNCTUATION})
        by_length.setdefault(len(form), {}).setdefault(form, []).append(place)

    def found(t: Column) -> Column:
        hits = []
        for size, forms in sorted(by_length.items()):
            start = F.substring(t, 1, size)
            names = F.create_map(*[x for form, same in sorted(forms.items()) for x in (F.lit(form), C.string_array(same))])
            hits.append(F.when(start.isin(sorted(forms)), F.element_at(names, start)))
        return F.flatten(F.array_compact(F.array(*hits)))

    return C.let(cleaned, found) if by_length else F.array().cast("array<string>")
