"""English stemming by suffix rules, over a DataFrame of distinct words: each step is one projection inside the JVM.

A word is a run of consonants and vowels, [C](VC)^m[V]; ``m`` decides which suffixes go. Text is lower-case; what isn't a word of three
lower-case ASCII letters or more is its own stem.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..vocabulary import STEM_DERIVED, STEM_DROPPED, STEM_SHORTENED, STOP_WORDS
from .text import lookup

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
#: A stem with m > 0, m = 1, m > 1; with a vowel; short: consonant, vowel, consonant other than w, x, y.
SOME, ONE, MORE = f"^({_C})?{_V}{_C}", f"^({_C})?{_V}{_C}({_V})?$", f"^({_C})?{_V}{_C}{_V}{_C}"
VOWEL, SHORT = f"^({_C})?[aeiouy]", f"^{_C}[aeiouy][^aeiouwxy]$"
DOUBLE = "(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx|[^aeiouy]yy)$"


def ending(suffixes) -> str:
    """What stands before the longest of the suffixes, and that suffix."""
    return f"^(.+?)({'|'.join(suffixes)})$"


def stop_word(term: Column) -> Column:
    return term.isin(*STOP_WORDS)


def stemmed(words: DataFrame, term: str = "term", out: str = "stem") -> DataFrame:
    """Each different word of ``words`` with its stem, and no other column. A null word has a null stem."""
    w = F.col(out)
    at = lambda pattern, group=1: F.regexp_extract(w, pattern, group)
    cut = lambda n: w.substr(F.lit(1), F.length(w) - n)
    drop = F.when(w.rlike("^.+?(ss|i)es$"), cut(2)).when(w.rlike("^.+?[^s]s$"), cut(1)).otherwise(w)
    eed, past = at("^(.+?)eed$"), at("^(.+?)(ed|ing)$")
    weak = F.when(w.rlike("eed$"), F.when(eed.rlike(SOME), cut(1)).otherwise(w)).when(past.rlike(VOWEL), F.concat(past, F.lit("\n"))).otherwise(w)
    mended = F.when(w.rlike("(at|bl|iz)$"), F.concat(w, F.lit("e"))).when(w.rlike(DOUBLE), cut(1)).when(w.rlike(SHORT), F.concat(w, F.lit("e"))).otherwise(w)
    y = F.when(at("^(.+)y$").rlike(VOWEL), F.concat(cut(1), F.lit("i"))).otherwise(w)

    def swap(entries: dict[str, str]) -> Column:
        pattern = ending(entries)
        return F.when(at(pattern).rlike(SOME), F.concat(at(pattern), lookup(at(pattern, 2), entries))).otherwise(w)

    pattern, ion = ending(STEM_DROPPED), "^(.+?[st])(ion)$"
    off = F.when(w.rlike(pattern), F.when(at(pattern).rlike(MORE), at(pattern)).otherwise(w)).when(at(ion).rlike(MORE), at(ion)).otherwise(w)
    e = at("^(.+)e$")
    last = F.when(e.rlike(MORE) | (e.rlike(ONE) & ~e.rlike(SHORT)), e).otherwise(w)
    final = F.when(w.rlike("ll$") & w.rlike(MORE), cut(1)).otherwise(w)

    fits = F.col(term).rlike("^[a-z]{3,}$")
    # A first y is a consonant, and is a capital meanwhile.
    df = words.withColumn(out, F.regexp_replace(term, "^y", "Y")).withColumn(out, F.when(fits, drop).otherwise(w)).withColumn(out, F.when(fits, weak).otherwise(w))
    # A line break marks words that lost ed or ing, which alone are mended.
    df = df.withColumn("__cut", w.endswith("\n")).withColumn(out, F.rtrim(w, F.lit("\n"))).withColumn(out, F.when(F.col("__cut"), mended).otherwise(w)).drop("__cut")
    for step in (y, swap(STEM_DERIVED), swap(STEM_SHORTENED), off, last, final):
        df = df.withColumn(out, F.when(fits, step).otherwise(w))
    # The group keeps filters on the stem from being written out over all steps; words are distinct already, so nothing is shuffled again.
    return df.groupBy(term).agg(F.min(F.regexp_replace(out, "^Y", "y")).alias(out))


def stem_sql(source: str, name: str, keep: str = "") -> str:
    """Common table expressions in DuckDB's SQL, the last one ``name`` with (term, stem, ``keep``) of ``source`` (term, ``keep``)."""
    more = f", {keep}" if keep else ""
    get = lambda pattern, group=1: f"regexp_extract(w, '{pattern}', {group})"
    has = lambda value, pattern: f"regexp_matches({value}, '{pattern}')"
    cut = lambda n: f"left(w, length(w) - {n})"

    def swap(entries: dict[str, str]) -> str:
        pattern = ending(entries)
        cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in entries.items())
        return f"CASE WHEN {has(get(pattern), SOME)} THEN {get(pattern)} || CASE {get(pattern, 2)} {cases} END ELSE w END"

    pattern, ion, e = ending(STEM_DROPPED), "^(.+?[st])(ion)$", get("^(.+)e$")
    past = get("^(.+?)(ed|ing)$")
    steps = [
        f"CASE WHEN {has('w', '^.+?(ss|i)es$')} THEN {cut(2)} WHEN {has('w', '^.+?[^s]s$')} THEN {cut(1)} ELSE w END",
        f"CASE WHEN {has('w', 'eed$')} THEN CASE WHEN {has(get('^(.+?)eed$'), SOME)} THEN {cut(1)} ELSE w END WHEN {has(past, VOWEL)} THEN {past} || '+' ELSE w END",
        f"CASE WHEN w NOT LIKE '%+' THEN w WHEN {has('w', '(at|bl|iz)[+]$')} THEN {cut(1)} || 'e' WHEN {has(cut(1), DOUBLE)} THEN {cut(2)} WHEN {has(cut(1), SHORT)} THEN {cut(1)} || 'e' ELSE {cut(1)} END",
        f"CASE WHEN {has(get('^(.+)y$'), VOWEL)} THEN {cut(1)} || 'i' ELSE w END",
        swap(STEM_DERIVED),
        swap(STEM_SHORTENED),
        f"CASE WHEN {has('w', pattern)} THEN CASE WHEN {has(get(pattern), MORE)} THEN {get(pattern)} ELSE w END WHEN {has(get(ion), MORE)} THEN {get(ion)} ELSE w END",
        f"CASE WHEN {has(e, MORE)} OR ({has(e, ONE)} AND NOT {has(e, SHORT)}) THEN {e} ELSE w END",
        f"CASE WHEN w LIKE '%ll' AND {has('w', MORE)} THEN {cut(1)} ELSE w END",
    ]
    parts, before = [f"{name}0 AS (SELECT term, regexp_replace(term, '^y', 'Y') AS w{more} FROM {source})"], f"{name}0"
    for k, step in enumerate(steps, 1):
        parts.append(f"{name}{k} AS (SELECT term, CASE WHEN regexp_matches(term, '^[a-z]{{3,}}$') THEN {step} ELSE w END AS w{more} FROM {before})")
        before = f"{name}{k}"
    return ",\n".join([*parts, f"{name} AS (SELECT term, regexp_replace(w, '^Y', 'y') AS stem{more} FROM {before})"])
