"""Normalisation of business names and addresses: column expressions over text that one UDF has made ASCII."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions import lexicon as lx
from kinfold.functions.translit import to_ascii_lower


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once: an expression used twice, or inside a lambda, is else computed anew at
    every use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def found_in(table: dict[str, str], key: Column) -> Column:
    """The table's value for a key, null where there is none. A map is searched from its start, so a hash set first tells
    the few keys that it holds."""
    return F.when(key.isin(list(table)), F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key))


def lookup(table: dict[str, str], key: Column) -> Column:
    """The table's value for a key, the key itself where there is none."""
    return F.coalesce(found_in(table, key), key)


def chained(*tables: dict[str, str]) -> dict[str, str]:
    """One table for lookups in several, one after the other."""
    return {k: reduce(lambda x, t: t.get(x, x), tables, k) for t in tables for k in t}


def tokens(text: Column) -> Column:
    """Tokens between runs of characters that are neither letters nor digits."""
    return F.filter(F.split(text, "[^a-z0-9]+"), lambda t: t != "")


def any_of(words: list[str]) -> str:
    """A pattern for any of the words, longer ones first."""
    return "(?:" + "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w))) + ")"


def repair_leet(t: Column) -> Column:
    """Digits typed for letters, in tokens that are mostly letters: h0rizon, but not cs1464 nor 4th."""
    one = t.rlike("^[a-z]*[0-9][a-z]*$") & (F.length(t) >= 3)
    two = t.rlike("^[a-z]*[0-9][a-z]*[0-9][a-z]*$") & (F.length(t) >= 5)
    typo = (one | two) & ~t.rlike("^[0-9]+(st|nd|rd|th)$")
    return F.when(typo, F.translate(t, "0134578", "oleastb")).otherwise(t)


def join_letters(text: Column) -> Column:
    """Single letters in a row become one token: l l c, llc."""
    return F.regexp_replace(text, "(?<=(?:^| )[a-z]) (?=[a-z](?: |$))", "")


def canonical_legal(text: Column) -> Column:
    """Legal forms in one spelling; pairs of tokens first."""
    for pair, form in lx.LEGAL_BIGRAMS.items():
        text = F.regexp_replace(text, f"(?<![^ ]){pair}(?![^ ])", form)
    return F.array_join(F.transform(F.filter(F.split(text, " "), lambda t: t != ""), lambda t: lookup(lx.LEGAL_FORMS, t)), " ")


#: What counts as a web address, and what an ordinal is.
DOMAIN = r"\b(?:www\.)?([a-z0-9-]+)\.(?:" + "|".join(re.escape(e) for e in lx.DOMAIN_ENDINGS) + r")\b"
ORDINAL = r"\b([0-9]+)(?:st|nd|rd|th)\b"


def name_text(text: Column) -> Column:
    """Name tokens joined by spaces: symbols to words, web addresses to their name, typing repaired, forms canonical."""
    text = F.replace(F.replace(text, F.lit("&"), F.lit(" and ")), F.lit("@"), F.lit(" at "))
    text = F.regexp_replace(text, DOMAIN, " $1 ")
    found = F.transform(F.transform(tokens(text), repair_leet), lambda t: lookup(lx.SHARED_TOKENS, t))
    return canonical_legal(join_letters(F.array_join(found, " ")))


def drop_repeats(found: Column) -> Column:
    """Tokens that equal the one before go."""
    return F.filter(found, lambda t, i: (i == 0) | (t != F.get(found, i - 1)))


def without_honorific(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"^[^a-z0-9_]*" + any_of(lx.HONORIFICS) + r"\.?\s+", "")


BRACKETS = r"[\(\[\{][^\)\]\}]*[\)\]\}]"
EDGE = any_of(lx.EDGE_STOPWORDS)


def core_text(text: Column) -> Column:
    """A name without form of address, bracketed parts, number tags, legal forms and stop words at its ends."""
    bare = F.regexp_replace(F.regexp_replace(without_honorific(text), BRACKETS, " "), r"#\s*[0-9]+", " ")
    kept = F.filter(F.split(name_text(bare), " "), lambda t: (t != "") & ~t.isin(lx.LEGAL_TOKENS))
    joined = F.array_join(bound(kept, drop_repeats), " ")
    return F.trim(F.regexp_replace(F.regexp_replace(joined, f"^(?:{EDGE}(?: |$))+", ""), f"(?:(?:^| ){EDGE})+$", ""))


def initials_text(text: Column) -> Column:
    """First letters of the words of a name; legal forms and stop words don't count."""
    bare = F.regexp_replace(F.replace(without_honorific(text), F.lit("&"), F.lit(" and ")), BRACKETS, " ")
    skipped = sorted({*lx.LEGAL_TOKENS, *lx.LEGAL_FORMS, *lx.EDGE_STOPWORDS})
    words = F.filter(tokens(bare), lambda t: t.rlike("^[a-z]") & ~t.isin(skipped))
    return F.array_join(F.transform(words, lambda t: F.substring(t, 1, 1)), "")


def with_names(df: DataFrame, name: str = "business_name") -> DataFrame:
    """``df`` plus name_norm, name_core, name_alias, name_initials, name_legal and name_translit of a name column."""
    df = df.withColumn("kf_n", to_ascii_lower(F.col(name)))
    parts = F.filter(F.split(F.concat(F.lit(" "), F.col("kf_n.text"), F.lit(" ")), r"\s" + any_of(lx.ALIAS_MARKERS) + r"\s"), lambda p: F.trim(p) != "")
    df = df.withColumn("kf_parts", parts)
    df = df.withColumns({"kf_main": F.coalesce(F.get("kf_parts", F.lit(0)), F.lit("")), "kf_alias": F.array_join(F.slice("kf_parts", 2, F.greatest(F.size("kf_parts"), F.lit(1))), " ")})
    df = df.withColumns({"name_norm": name_text(F.array_join("kf_parts", " ")), "kf_core": core_text(F.col("kf_main"))})
    legal = F.array_sort(F.array_distinct(F.filter(F.split("name_norm", " "), lambda t: t.isin(lx.LEGAL_TOKENS))))
    df = df.withColumns(
        {
            "name_core": F.when(F.col("kf_core") != "", F.col("kf_core")).otherwise(name_text(F.col("kf_main"))),
            "name_alias": F.when(F.col("kf_alias") != "", core_text(F.col("kf_alias"))).otherwise(""),
            "name_initials": initials_text(F.col("kf_main")),
            "name_legal": F.array_join(legal, " "),
            "name_translit": F.col("kf_n.indic"),
        }
    )
    return df.drop("kf_n", "kf_parts", "kf_main", "kf_alias", "kf_core")


def state_key(text: Column) -> Column:
    """Loose sound of a state's name."""
    s = F.translate(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z]", ""), "(?<=[^aeiou])h", ""), "w", "v")
    s = F.regexp_replace(s, r"(.)\1+", "$1")
    return F.when(s.endswith("a") & (F.length(s) > 4), F.regexp_replace(s, "a$", "")).otherwise(s)


def py_state_key(text: str) -> str:
    """:func:`state_key` of a literal, for building the index."""
    s = re.sub(r"(.)\1+", r"\1", re.sub("(?<=[^aeiou])h", "", re.sub("[^a-z]", "", text.lower())).replace("w", "v"))
    return s[:-1] if s.endswith("a") and len(s) > 4 else s


#: Names by key; later sources win.
STATES_BY_KEY = {
    py_state_key(spelling): name
    for source in (
        [(n, n) for n in lx.US_STATES.values()],
        [(n, n) for n in lx.INDIA_STATES.values()],
        list(lx.STATE_NAME_ALIASES.items()),
        [(n, n) for n in lx.FRANCE_REGIONS],
    )
    for spelling, name in source
}


def match_state(segment: Column, country: Column) -> Column:
    """The state that a whole address segment names, by postal code in two countries or by sound; else blank."""
    code = F.when(country.isin("us", "usa"), found_in(lx.US_STATES, segment)).when(country == "india", found_in(lx.INDIA_STATES, segment))
    named = F.when(F.length(segment) > 2, bound(state_key(segment), lambda k: found_in(STATES_BY_KEY, k)))
    return F.coalesce(code, named, F.lit(""))


ADDRESS_WORDS = chained(lx.ADDRESS_ABBREVIATIONS, lx.SHARED_TOKENS, lx.CITY_ALIASES)


def address_tokens(segment: Column) -> Column:
    """Tokens of a segment in one spelling, without labels of numbers and words that locate nothing."""
    text = F.regexp_replace(segment, ORDINAL, "$1")
    text = F.regexp_replace(text, f"(?<![^ ])(?:{any_of(lx.NUMBER_MARKERS)} )+(?=[0-9])", "")
    kept = F.filter(F.split(text, " "), lambda t: (t != "") & ~t.isin(lx.ADDRESS_NOISE))

    def rewrite(found: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            number = t.rlike("^[0-9]+$")
            road = (t == "r") & (i > 0) & F.coalesce(F.get(found, i - 1).rlike("^[0-9]+$"), F.lit(False))
            return F.when(number, F.regexp_replace(t, "^0+(?!$)", "")).when(road, F.lit("rue")).otherwise(t)

        return F.transform(F.transform(found, one), lambda t: lookup(ADDRESS_WORDS, t))

    return bound(bound(kept, rewrite), drop_repeats)


def with_addresses(df: DataFrame, address: str = "business_address", country: str = "country") -> DataFrame:
    """``df`` plus addr_norm, addr_state, addr_city, addr_numbers, addr_missing and addr_translit."""
    df = df.withColumn("kf_c", F.lower(F.trim(F.coalesce(F.col(country), F.lit("")))))
    df = df.withColumn("kf_a", to_ascii_lower(F.translate(F.col(address), "°º", "  ")))
    segments = F.transform(F.split("kf_a.text", ","), lambda s: F.array_join(tokens(s), " "))
    df = df.withColumn("kf_seg", F.filter(segments, lambda s: s != ""))
    df = df.withColumn("kf_st", F.transform("kf_seg", lambda s: match_state(s, F.col("kf_c"))))
    last = F.array_max(F.filter(F.transform("kf_st", lambda s, i: F.when(s != "", i)), lambda i: i.isNotNull()))
    df = df.withColumn("kf_at", F.coalesce(last, F.lit(-1)))
    df = df.withColumn("kf_kept", F.filter("kf_seg", lambda s, i: i != F.col("kf_at")))
    df = df.withColumn("kf_tok", F.filter(F.transform("kf_kept", address_tokens), lambda t: F.size(t) > 0))
    digits = F.transform(F.regexp_extract_all(F.array_join("kf_kept", " "), F.lit("([0-9]+)"), 1), lambda n: F.regexp_replace(n, "^0+(?!$)", ""))
    ordered = F.array_sort(F.transform(F.array_distinct(digits), lambda n: F.struct(F.length(n).alias("n"), n.alias("s"))))
    named = F.filter(F.transform("kf_tok", lambda t: F.array_join(t, " ")), lambda s: ~s.rlike("[0-9]"))
    df = df.withColumns(
        {
            "addr_norm": F.array_join(F.flatten("kf_tok"), " "),
            "addr_state": F.coalesce(F.get("kf_st", F.col("kf_at")), F.lit("")),
            "addr_city": F.coalesce(F.try_element_at(named, F.lit(-1)), F.lit("")),
            "addr_numbers": F.array_join(F.transform(ordered, lambda n: n["s"]), " "),
            "addr_missing": F.size("kf_tok") == 0,
            "addr_translit": F.col("kf_a.indic"),
        }
    )
    return df.drop("kf_c", "kf_a", "kf_seg", "kf_st", "kf_at", "kf_kept", "kf_tok")


def normalize_records(df: DataFrame, name: str = "business_name", address: str = "business_address", country: str = "country") -> DataFrame:
    """All normalised columns next to the raw ones, and country_norm. Nulls count as empty."""
    return with_addresses(with_names(df, name), address, country).withColumn("country_norm", F.lower(F.trim(F.coalesce(F.col(country), F.lit("")))))


def location_key(numbers: Column, city: Column) -> Column:
    """Numbers and city of an address, blank without numbers."""
    return F.when(numbers != "", F.concat_ws("|", numbers, city)).otherwise("")


def token_grams(text: Column, most: int = 3) -> Column:
    """All runs of 1 .. ``most`` tokens of a text, joined by spaces."""
    found = F.filter(F.split(text, " "), lambda t: t != "")
    none = F.array().cast("array<string>")

    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(found) - (n - 1))
        return F.when(F.size(found) >= n, F.transform(starts, lambda i: F.array_join(F.slice(found, i, n), " "))).otherwise(none)

    return F.concat(*[of(n) for n in range(1, most + 1)])
