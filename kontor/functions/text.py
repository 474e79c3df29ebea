"""Column expressions for listing titles: normal form, comparison key, prices, card attributes, similarity.

Patterns never use ``\\b``: in Java it is aware of Unicode, so it would see no boundary
between a Japanese letter and a Latin one.  ``WORD`` marks stand for it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Full-width ASCII folds to ASCII, brackets and dashes to one kind each.
FULL = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
HALF = "".join(map(chr, range(0x21, 0x7F))) + " "
BRACKETS, PLAIN = "【〔】〕—–―", "[[]]---"
BLANKS = r"[\s   -     　﻿]+"
BEGIN, END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
COMPANIES = ("PSA", "BGS", "CGC", "SGC", "ARS")
RARITIES = ("PROMO", "SAR", "SSR", "CSR", "CHR", "RRR", "UR", "HR", "SR", "RR", "AR", "K")
LANGUAGES = (
    ("ENGLISH", rf"(?iu)英語版|英語表記|{BEGIN}ENG?{END}|english", 0.95),
    ("CHINESE", r"(?iu)中国語版|繁体字|簡体字|chinese", 0.95),
    ("KOREAN", r"(?iu)韓国語版|한국어|korean", 0.95),
    ("JAPANESE", r"[぀-ゟ゠-ヿ一-龯]", 0.9),
)
NUMBERS = (
    rf"{BEGIN}([0-9]{{1,3}}\s*/\s*[0-9]{{1,3}}){END}",
    rf"(?i){BEGIN}([0-9]{{1,3}}\s*/\s*[A-Z]{{1,3}}-?P){END}",
    rf"{BEGIN}([A-Z]{{1,3}}[0-9]{{1,2}}[a-z]?\s+[0-9]{{1,3}}){END}",
)
SET_CODE = rf"{BEGIN}(S[VM]?[0-9]{{1,2}}[A-Z]?|XY[0-9]{{1,2}}[A-Z]?|SM[0-9]{{1,2}}[A-Z]?){END}"
_GRADERS = "|".join(COMPANIES)
GRADE = rf"(?i){BEGIN}(?:{_GRADERS})\s*(10|[1-9](?:\.5)?){END}"
#: What is taken out of a title, in turn, to leave the card's name.
RESIDUE = (
    r"\[[^\]]*\]",
    r"\([^)]*\)",
    rf"(?i){BEGIN}(?:{_GRADERS})\s*(?:10|[1-9](?:\.5)?){END}",
    rf"(?i){BEGIN}[0-9]{{1,3}}\s*/\s*(?:[0-9]{{1,3}}|[A-Z]{{1,3}}-?P){END}",
    rf"{BEGIN}(?:SAR|SSR|CSR|CHR|RRR|UR|HR|SR|RR|AR|PROMO){END}",
    rf"(?i){BEGIN}(?:S[VM]?[0-9]{{1,2}}[A-Z]?|XY[0-9]{{1,2}}[A-Z]?){END}",
    r"美品|新品|中古|送料無料|即決|鑑定品|日本語版",
)


def _found(c: Column, pattern: str, group: int = 1) -> Column:
    """The captured group, or null where the pattern has no match."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def half_width(c: Column) -> Column:
    return F.translate(c, FULL, HALF)


def normalised(c: Column) -> Column:
    """Half width, one kind of bracket and dash, single blanks; the long-vowel mark stays."""
    return F.trim(F.regexp_replace(F.translate(c, FULL + BRACKETS, HALF + PLAIN), BLANKS, " "))


def comparison_key(c: Column) -> Column:
    """Lower-cased normal form without brackets, separators and blanks."""
    return F.regexp_replace(F.lower(normalised(c)), r"[\[\]()・･\-_,.'\"\s]", "")


def price(c: Column) -> Column:
    """The first number, thousands separators allowed; null where there is none."""
    bare = F.regexp_replace(half_width(c), BLANKS, "")
    return F.regexp_replace(_found(bare, r"([0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)"), ",", "").try_cast("decimal(20,6)")


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, over comparison keys; 0 if one side is empty."""
    return key_similarity(comparison_key(a), comparison_key(b))


def key_similarity(x: Column, y: Column) -> Column:
    """``similarity`` of what are comparison keys already."""
    longest = F.greatest(F.length(x), F.length(y))
    return (
        F.when(x == y, F.lit(1.0))
        .when((F.length(x) == 0) | (F.length(y) == 0), F.lit(0.0))
        .otherwise(1 - F.levenshtein(x, y) / longest)
    )


def attribute(value: Column, source: str, confidence: Column | float, note: str) -> Column:
    """struct<value, source, confidence, note>; a null value has the source unknown and confidence 0."""
    known = value.isNotNull()
    confidence = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return F.struct(
        value.cast("string").alias("value"),
        F.when(known, F.lit(source)).otherwise("unknown").alias("source"),
        F.when(known, confidence.cast("decimal(5,4)")).otherwise(F.lit(0).cast("decimal(5,4)")).alias("confidence"),
        F.when(known, F.lit(note)).alias("note"),
    )


def card_number(c: Column) -> Column:
    t = normalised(c)
    return F.upper(F.regexp_replace(F.coalesce(*(_found(t, p) for p in NUMBERS)), r"\s+", ""))


def rarity(c: Column) -> Column:
    t = F.upper(normalised(c))
    return F.coalesce(*(F.when(t.rlike(rf"(?:^|[\s\[\]()/]){r}(?:$|[\s\[\]()/])"), F.lit(r)) for r in RARITIES))


def set_code(c: Column) -> Column:
    return _found(F.upper(normalised(c)), SET_CODE)


def language(c: Column) -> Column:
    t = normalised(c)
    return F.coalesce(*(F.when(t.rlike(p), F.lit(name)) for name, p, _ in LANGUAGES))


def company(c: Column) -> Column:
    t = normalised(c)
    return F.coalesce(*(F.when(t.rlike(rf"(?i){BEGIN}{x}(?![A-Za-z])"), F.lit(x)) for x in COMPANIES))


def grade(c: Column) -> Column:
    return _found(normalised(c), GRADE).try_cast("decimal(3,1)")


def card_name(c: Column) -> Column:
    t = normalised(c)
    for pattern in RESIDUE:
        t = F.regexp_replace(t, pattern, " ")
    t = F.trim(F.regexp_replace(t, BLANKS, " "))
    return F.when(F.length(t) >= 2, t)


def attributes(title: Column) -> dict[str, Column]:
    """All attributes that a title can tell, with source and confidence."""
    name, spoken = card_name(title), language(title)
    sure = F.when(spoken == "JAPANESE", 0.9).otherwise(0.95)
    return {
        "card_name": attribute(name, "title_parser", F.when(F.length(name) <= 40, 0.9).otherwise(0.6), "residue"),
        "card_number": attribute(card_number(title), "title_parser", 0.95, "pattern"),
        "set_code": attribute(set_code(title), "title_parser", 0.8, "pattern"),
        "rarity": attribute(rarity(title), "title_parser", 0.9, "code"),
        "language": attribute(spoken, "title_parser", sure, "script or marker"),
        "grading_company": attribute(company(title), "title_parser", 1.0, "name"),
        "grade": attribute(grade(title).cast("string"), "title_parser", 1.0, "next to a company"),
    }


#: Fields whose least confidence is the listing's.
GATING = ("card_name", "card_number", "language", "grading_company", "grade")


def search_query(name: Column, number: Column, grader: Column, grade_: Column) -> Column:
    """Name, number, grader and grade without trailing zeros; null without a name."""
    plain = F.regexp_replace(grade_.cast("string"), r"\.0+$|(\.[0-9]*?[1-9])0+$", "$1")
    known = F.when(grader.isNotNull() & plain.isNotNull(), F.concat_ws(" ", grader, plain))
    return F.when(F.trim(name) != "", F.concat_ws(" ", F.trim(name), F.trim(number), known))
