"""Surrogates for personal data and secrets, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hearsay.llm.common import join_weighted, materialise
from hearsay.llm.rules import let

# Titles and given names that mark a person, and the names that replace them.
TITLES = {"m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "господин"], "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа"], "x": ["Dr", "Prof"]}
GIVEN = {
    "m": ["James", "John", "Robert", "Michael", "William", "David", "Thomas", "Hans", "Pierre", "Carlos", "Juan", "Иван", "Сергей", "Алексей"],
    "f": ["Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Susan", "Anna", "Greta", "Marie", "Carmen", "Lucía", "Анна", "Ольга", "Елена"],
}
NEW_GIVEN = {
    ("m", "latin"): ["Adrian", "Bruno", "Cedric", "Dario", "Emil", "Felix", "Gregor", "Hugo"], ("f", "latin"): ["Alma", "Bianca", "Clara", "Delia", "Elsa", "Flora", "Gina", "Helene"],
    ("m", "cyrillic"): ["Борис", "Виктор", "Денис", "Игорь"], ("f", "cyrillic"): ["Вера", "Дарья", "Ирина", "Нина"],
}
SYLLABLES = {"latin": ["ba", "do", "fe", "ga", "ki", "lo", "mu", "ne", "po", "ra", "si", "to", "va", "we", "za", "li"],
             "cyrillic": ["ба", "до", "фе", "га", "ки", "ло", "му", "не", "по", "ра", "си", "то", "ва", "ве", "за", "ли"]}

_UP = r"[\p{Lu}][\p{Ll}]+"
_ALL_TITLES = "|".join(t for names in TITLES.values() for t in names)
_ALL_GIVEN = "|".join(n for names in GIVEN.values() for n in names)
_INITIALS = "".join(sorted({n[0] for names in (*TITLES.values(), *GIVEN.values()) for n in names}))
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?=[tspaTSPA])(?i:(?<![a-z])(?:token|secret|password|passwd|pwd|api[_\-]?key)[ ]?[=:][ ]?[\"']?[A-Za-z0-9/+_\-]{8,}[\"']?)|(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{16,}|[0-9a-f]{32,64})(?![A-Za-z0-9])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d])(?!\.\d)",
    "card": r"(?<![\d])\d{4}([ \-]?)\d{4}\1\d{4}\1\d{1,7}(?![\d])",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "phone": r"(?<![\d\w+])(?:\+\d{1,3}[ .\-]?)?\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4}(?!\d)|(?<![\d\w+])\+\d{1,3}(?:[ .\-]?\d{2,4}){2,4}(?!\d)|(?<![\d\w+.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\d.\-])",
    "person": rf"(?=[{_INITIALS}])(?<!\p{{L}})(?:(?:{_ALL_TITLES})\.?[ ]{_UP}(?:[ ]{_UP})?|(?:{_ALL_GIVEN})[ ]{_UP})(?!\p{{L}})",
}
# The one capturing group (the separator of a card) keeps its number when it stands first.
ORDER = ["card", "email", "secret", "ip", "ssn", "phone", "person"]
ENTITY = "|".join(f"(?:{PATTERNS[k]})" for k in ORDER)
SECRET_HEAD = r"^(?i:(?:token|secret|password|passwd|pwd|api[_\-]?key)[ ]?[=:][ ]?[\"']?)"
# Every entity holds one of these; most texts hold none.
MAYBE = rf"[@]|\d\d|\d\.\d|(?=[tspaTSPA])(?i:token|secret|passw|pwd|api)|AKIA|gh[pousr]_|sk-|[0-9a-f]{{32}}|(?=[{_INITIALS}])(?:{_ALL_TITLES}|{_ALL_GIVEN})[. ]"


def kind_of(raw: Column) -> Column:
    out = F.lit(None).cast("string")
    for name in reversed(ORDER):
        out = F.when(raw.rlike(f"^(?:{PATTERNS[name]})$"), F.lit(name)).otherwise(out)
    return out


def canonical(kind: Column, raw: Column) -> Column:
    """The form in which mentions of one entity agree: it drives coreference."""
    digits = F.regexp_replace(raw, r"\D", "")
    bare = F.regexp_replace(F.regexp_replace(raw, SECRET_HEAD, ""), "[\"']$", "")
    names = F.regexp_replace(raw, rf"^(?:{_ALL_TITLES})\.?[ ]", "")
    return (F.when(kind.isin("card", "ssn", "phone"), digits).when(kind == "email", F.lower(raw))
            .when(kind == "secret", bare).when(kind == "person", names).otherwise(raw))


def gender_of(raw: Column) -> Column:
    starts = lambda words: raw.rlike(rf"^(?:{'|'.join(words)})(?!\p{{L}})|[ ](?:{'|'.join(words)})[ ]")
    return F.when(starts(TITLES["f"] + GIVEN["f"]), "f").when(starts(TITLES["m"] + GIVEN["m"]), "m").otherwise("x")


def _stream(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """128 hex digits that only the key, the entity and the attempt decide; a keyed hash in the nested form."""
    inner = F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("in"), kind, canon, attempt.cast("string")), 512)
    return F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("out"), inner), 512)


def _number(stream: Column, at: Column) -> Column:
    """0 to 65535 from four hex digits of the stream, at a place that wraps."""
    return F.conv(F.substr(F.concat(stream, F.substring(stream, 1, 8)), F.pmod(at * 3, F.lit(125)) + 1, F.lit(4)), 16, 10).cast("int")


def _pick(letters: str, n: Column) -> Column:
    return F.substr(F.lit(letters), F.pmod(n, F.lit(len(letters))) + 1, F.lit(1))


def _same_shape(canon: Column, stream: Column, hexed: Column) -> Column:
    """Each digit, letter and capital replaced by one of its kind; marks stay. Hex text stays hex."""
    def one(i: Column) -> Column:
        c, n = F.substr(canon, i, F.lit(1)), _number(stream, i)
        return (F.when(c.rlike("[0-9]"), _pick("0123456789", n)).when(hexed & c.rlike("[a-f]"), _pick("abcdef", n))
                .when(c.rlike(r"\p{Lu}"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", n)).when(c.rlike(r"\p{L}"), _pick("abcdefghijklmnopqrstuvwxyz", n)).otherwise(c))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(canon)), one), "")


def _with_check_digit(digits: Column) -> Column:
    """The last digit made right for the Luhn sum."""
    body = F.substr(digits, F.lit(1), F.length(digits) - 1)
    weighted = F.transform(F.sequence(F.lit(1), F.length(body)), lambda i: let(
        F.substr(F.reverse(body), i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v)))
    total = F.aggregate(weighted, F.lit(0), lambda a, v: a + v)
    return F.concat(body, F.pmod(-total, F.lit(10)).cast("string"))


def luhn_ok(digits: Column) -> Column:
    return _with_check_digit(digits) == digits


def _name(canon: Column, gender: Column, stream: Column, attempt: Column) -> Column:
    """A given name of the same gender where there was one, and a surname in the same script."""
    script = F.when(canon.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    def surname(kind: str) -> Column:
        parts = [F.element_at(F.array(*map(F.lit, SYLLABLES[kind])), F.pmod(_number(stream, F.lit(7 + k)), F.lit(16)) + 1) for k in range(5)]
        more = [F.when(attempt > 3 + k, F.element_at(F.array(*map(F.lit, SYLLABLES[kind])), F.pmod(_number(stream, F.lit(20 + k)), F.lit(16)) + 1)).otherwise("") for k in range(4)]
        return F.initcap(F.concat(*parts, *more))
    given = F.lit(None).cast("string")
    for (g, s), names in NEW_GIVEN.items():
        fits = (script == s) & ((gender == g) | ((gender == "x") & (F.pmod(_number(stream, F.lit(3)), F.lit(2)) == (0 if g == "m" else 1))))
        given = F.when(fits, F.element_at(F.array(*map(F.lit, names)), F.pmod(_number(stream, F.lit(1)), F.lit(len(names))) + 1)).otherwise(given)
    last = F.when(script == "cyrillic", surname("cyrillic")).otherwise(surname("latin"))
    return F.when(F.instr(canon, " ") > 0, F.concat(given, F.lit(" "), last)).otherwise(last)


def surrogate(key: str, kind: Column, canon: Column, gender: Column, attempt: Column) -> Column:
    """A replacement of the same type and format. From the fourth attempt on it grows, so that small formats don't run out."""
    return let(_stream(key, kind, canon, attempt), lambda stream: _surrogate(kind, canon, gender, attempt, stream))


def _surrogate(kind: Column, canon: Column, gender: Column, attempt: Column, stream: Column) -> Column:
    longer = F.when(attempt > 3, F.substring(stream, 100, 1 + 4)).otherwise(F.lit(""))
    shaped = _same_shape(canon, stream, canon.rlike("^[0-9a-f]+$"))
    local, domain = F.substring_index(shaped, "@", 1), F.substring_index(shaped, "@", -1)
    labels = let(F.split(domain, r"\."), lambda d: F.array_join(F.slice(d, F.lit(1), F.greatest(F.size(d) - 2, F.lit(0))), "."))
    reserved = F.element_at(F.array(F.lit("example.com"), F.lit("example.net"), F.lit("example.org")), F.pmod(_number(stream, F.lit(11)), F.lit(3)) + 1)
    email = F.concat(local, longer, F.lit("@"), F.when(labels == "", "").otherwise(F.concat(labels, F.lit("."))), reserved)
    octet = lambda k, low, n: (F.pmod(_number(stream, F.lit(k)), F.lit(n)) + low).cast("string")
    ip = F.concat_ws(".", octet(1, 1, 223), octet(5, 0, 256), octet(9, 0, 256), octet(13, 0, 256))
    card = F.concat(F.substring(canon, 1, 1), F.substr(shaped, F.lit(2), F.length(shaped)))
    card = F.when(luhn_ok(canon), _with_check_digit(card)).otherwise(card)
    country = F.substr(canon, F.lit(1), F.greatest(F.length(canon) - 10, F.lit(0)))
    phone = F.concat(country, F.substr(shaped, F.length(country) + 1, F.length(shaped)))
    return (F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "ip", ip).when(kind == "card", card)
            .when(kind == "person", _name(canon, gender, stream, attempt)).when(kind == "secret", F.concat(shaped, longer)).otherwise(shaped))


def rendered(kind: Column, raw: Column, canon: Column, new: Column) -> Column:
    """The surrogate written as this mention was: its separators, case, title and quotes."""
    places = F.transform(F.sequence(F.lit(1), F.length(raw)), lambda i: F.struct(F.substr(raw, i, F.lit(1)).alias("c"), F.length(F.regexp_replace(F.substr(raw, F.lit(1), i), r"\D", "")).alias("d")))
    digits = F.array_join(F.transform(places, lambda p: F.when(p["c"].rlike("[0-9]"), F.substr(new, p["d"], F.lit(1))).otherwise(p["c"])), "")
    swapped = F.concat(F.substr(raw, F.lit(1), F.instr(raw, canon) - 1), new, F.substr(raw, F.instr(raw, canon) + F.length(canon)))
    return (F.when(kind.isin("card", "ssn", "phone"), digits)
            .when(kind == "email", F.when((raw == F.upper(raw)) & (raw != F.lower(raw)), F.upper(new)).otherwise(new))
            .when(kind.isin("secret", "person"), swapped).otherwise(new))


def choose_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """kind, canon, new: one surrogate for each entity, no two alike, none an entity that occurs.

    Every attempt proposes for those still without. A proposal that is a real
    entity or already taken is refused, and of those that propose the same the
    smallest entity wins; the others try again. It ends when all have one.
    """
    todo, done, attempt = entities, None, 0
    while True:
        tried = todo.withColumn("new", surrogate(key, F.col("kind"), F.col("canon"), F.col("gender"), F.lit(attempt)))
        tried = tried.withColumn("first", F.row_number().over(Window.partitionBy("kind", "new").orderBy("canon")) == 1)
        taken = entities.select("kind", F.col("canon").alias("new"))
        if done is not None:
            taken = taken.unionByName(done.select("kind", "new"))
        tried = tried.join(taken.distinct().withColumn("taken", F.lit(True)), ["kind", "new"], "left")
        tried = materialise(tried.withColumn("ok", F.col("first") & F.col("taken").isNull()), "surrogates")
        won = tried.where("ok").select("kind", "canon", "new")
        done = won if done is None else done.unionByName(won)
        todo = tried.where("NOT ok").select("kind", "canon", "gender")
        if todo.isEmpty():
            return done
        attempt += 1


def replace_private(
    docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, text with surrogates, n_entities (mentions) and kinds (of the distinct ones).

    Emails, phone and card numbers, social-security numbers, IPv4 addresses,
    secrets, and persons marked by a title or a given name are found in whole
    texts. Everything about an entity depends on the key and its canonical form,
    so mentions agree across documents; entities stay distinct.

    Null texts stay null, empty and clean texts are returned as they are. Rows
    that share id and text share their replacements. An empty table gives an
    empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("_key"))
    hits = F.regexp_extract_all(F.col("text"), F.lit(ENTITY), F.lit(0))
    rows = rows.withColumn("_maybe", F.coalesce(F.col("text").rlike(MAYBE), F.lit(False)))
    found = rows.where("_maybe").select("_key", F.explode(hits).alias("raw"))
    found = materialise(found.groupBy("_key", "raw").agg(F.count(F.lit(1)).alias("n")), "mentions")
    raws = found.groupBy("raw").agg(F.count(F.lit(1)).alias("weight")).withColumn("kind", kind_of(F.col("raw"))).where("kind IS NOT NULL")
    raws = raws.withColumn("canon", canonical(F.col("kind"), F.col("raw"))).withColumn("gender", gender_of(F.col("raw")))
    raws = materialise(raws, "entities")
    entities = materialise(raws.groupBy("kind", "canon").agg(F.min("gender").alias("gender")), "entities")
    chosen = choose_surrogates(entities, key)
    spoken = raws.join(chosen, ["kind", "canon"]).select(
        "raw", "kind", "weight", rendered(F.col("kind"), F.col("raw"), F.col("canon"), F.col("new")).alias("said"))
    spoken = materialise(spoken, "spoken")
    maps = join_weighted(found, spoken, ["raw"], "weight").groupBy("_key").agg(
        F.map_from_entries(F.collect_list(F.struct("raw", "said"))).alias("_said"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    maps = materialise(maps, "replacements")
    # Only texts that may hold an entity move, at every size by the same kind of join.
    clean = rows.where("NOT _maybe").select("doc_id", "text", F.lit(0).cast("long").alias("n_entities"), F.array().cast("array<string>").alias("kinds"))
    joined = rows.where("_maybe").join(maps.hint("merge"), "_key", "left")
    parts, said = F.split("text", ENTITY, -1), F.regexp_extract_all(F.col("text"), F.lit(ENTITY), F.lit(0))
    new = F.array_join(F.flatten(F.zip_with(parts, said, lambda p, h: F.array(p, F.coalesce(F.element_at(F.col("_said"), h), h, F.lit(""))))), "")
    return clean.unionByName(joined.select(
        "doc_id", F.when(F.col("_said").isNull(), F.col("text")).otherwise(new).alias("text"),
        F.when(F.col("_said").isNull(), 0).otherwise(F.size(said)).cast("long").alias("n_entities"),
        F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds")))
