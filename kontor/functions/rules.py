"""Rule tables compiled into column expressions.

A rule table is small configuration: it is read on the driver, its patterns are checked there, and each set of
rules becomes one projection, so rules cost no join and no Python per row.
"""

from __future__ import annotations

from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import BEGIN, END, normalised


@dataclass(frozen=True)
class Rule:
    """A named condition; ``ok`` holds for good rows."""

    name: str
    ok: Column


def reasons(rules: list[Rule]) -> Column:
    """Names of the rules that a row breaks; a condition that is null counts as broken only if it is not known to hold."""
    return F.filter(F.array(*(F.when(~F.coalesce(r.ok, F.lit(False)), F.lit(r.name)) for r in rules)), lambda x: x.isNotNull())


def valid(pattern: str) -> bool:
    """Whether Spark's pattern language, in which it will run, knows the pattern."""
    try:
        SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, PySparkException):
        return False
    return True


def title_rules(title: Column, fields: dict[str, Column], rules: list[tuple[str, str, float]]) -> tuple[dict[str, Column], list[str]]:
    """Apply (field, pattern, confidence) in order: capture 1 overrides the field.  Returns fields and warnings for bad patterns."""
    out, warnings = dict(fields), []
    text = normalised(title)
    for field, pattern, confidence in rules:
        if not valid(pattern):
            warnings.append(f"INVALID_SUPPLIER_RULE:{field}")
            continue
        found = F.trim(F.regexp_extract(text, pattern, 1))
        given = F.struct(
            found.alias("value"), F.lit("supplier_rule").alias("source"),
            F.lit(confidence).cast("decimal(5,4)").alias("confidence"), F.lit(pattern).alias("note"),
        )
        out[field] = F.when(text.rlike(pattern) & (found != ""), given).otherwise(out[field])
    return out, warnings


def structured(fields: dict[str, Column], values: dict[str, Column], companies: tuple[str, ...]) -> dict[str, Column]:
    """Non-empty structured values override what was parsed; a company that is not known is OTHER."""
    out = dict(fields)
    for field, value in values.items():
        text = value.cast("string")
        if field == "grading_company":
            text = F.when(F.upper(text).isin(*companies), F.upper(text)).when(text != "", F.lit("OTHER"))
        given = F.struct(
            text.alias("value"), F.lit("structured_data").alias("source"),
            F.lit(1).cast("decimal(5,4)").alias("confidence"), F.lit("page data").alias("note"),
        )
        out[field] = F.when(text.isNotNull() & (text != ""), given).otherwise(out[field])
    return out


def first_match(text: Column, rules: list[tuple[str, str, int | None]], exact_count: bool = True) -> Column:
    """Ordered (pattern, status, quantity group): struct<status, quantity> of the first that matches; UNKNOWN if none."""
    status, quantity = F.lit("UNKNOWN"), F.lit(None).cast("int")
    for pattern, name, group in reversed([r for r in rules if valid(r[0])]):
        hit = F.coalesce(text.rlike(pattern), F.lit(False))
        count = F.regexp_extract(text, pattern, group).try_cast("int") if group and exact_count else F.lit(None).cast("int")
        status, quantity = F.when(hit, F.lit(name)).otherwise(status), F.when(hit, count).otherwise(quantity)
    return F.struct(status.alias("status"), quantity.alias("quantity"))


# Claims that disqualify a title, other games, and signs of the wanted game.
DISQUALIFIERS = (
    (r"(?i)PSA\s*10\s*(相当|級|クラス|レベル)", "equivalent grade, ungraded"),
    (r"(相当|同等)品", "an equivalent"),
    (r"(?i)PSA\s*[1-9](?![0-9])", "a lower grade"),
    (rf"(?i){BEGIN}(BGS|CGC|SGC|ARS)\s*(10|9\.5|9)", "another grader"),
    (rf"(?i)未鑑定|未評価|生カード|raw{END}", "ungraded"),
    (r"(?i)BOX|ボックス|カートン", "a sealed box"),
    (rf"(?i)パック|pack{END}|スリーブ|デッキケース|サプライ", "a pack or supply"),
    (r"まとめ売り|セット販売|[0-9]+枚セット", "a bundle"),
    (r"ダメージ|傷あり|折れ|キズ", "damage"),
)
OTHER_GAMES = (
    r"(?i)遊戯王|yu-?gi-?oh",
    r"(?i)デュエマ|デュエル・?マスターズ|duel\s*masters",
    r"(?i)ワンピース|one\s*piece",
    rf"(?i)マジック[:：]?ザ・?ギャザリング|{BEGIN}MTG{END}|magic.{{0,3}}the\s*gathering",
    r"(?i)ヴァイスシュヴァルツ|weiss\s*schwarz",
    r"(?i)バトルスピリッツ|battle\s*spirits",
    r"(?i)シャドウバース|shadowverse",
    r"(?i)ドラゴンボール|dragon\s*ball",
)
GAME = (
    r"(?iu)ポケモン|ポケカ|pokemon|pok[ée]mon",
    rf"(?i){BEGIN}(ex|GX|VMAX|VSTAR|V-?UNION){END}",
    r"リザードン|ピカチュウ|ミュウ|イーブイ|ルギア|レックウザ",
)
CLAIM = rf"(?i)PSA\s*10{END}"


def grade_claims(df: DataFrame) -> DataFrame:
    """Adds verdict, confidence and reasons.

    Columns read: title, breadcrumbs (array), description, source_category_url, structured_company, structured_grade.
    """
    empty = F.lit("")
    title, about = normalised(F.col("title")), normalised(F.coalesce("description", empty))
    crumbs = normalised(F.array_join(F.coalesce("breadcrumbs", F.array().cast("array<string>")), " "))
    every = F.concat_ws(" ", title, crumbs, about)
    claimed = F.concat_ws(" ", title, about)
    against = F.filter(F.array(*(F.when(claimed.rlike(p), F.lit(r)) for p, r in DISQUALIFIERS)), lambda x: x.isNotNull())
    other = F.lit(False)
    for p in OTHER_GAMES:
        other = other | every.rlike(p)
    game = F.lit(False)
    for p in GAME:
        game = game | every.rlike(p)
    told = (F.coalesce("structured_company", empty) != "") & F.col("structured_grade").isNotNull()
    ten = F.lower(F.trim("structured_company")).eqNullSafe("psa") & F.col("structured_grade").eqNullSafe(F.lit(10))
    in_title = title.rlike(CLAIM)
    category = crumbs.rlike("(?i)PSA") | F.coalesce("source_category_url", empty).rlike("(?i)psa")
    described = about.rlike(CLAIM) | about.rlike(rf"(?i)GEM\s*MT?{END}")
    signals = ((told & ten, "0.5"), (in_title, "0.35"), (category, "0.25"), (described, "0.2"), (game, "0.2"))
    total, number = F.lit(0).cast("decimal(5,4)"), F.lit(0)
    for hit, weight in signals:
        total = (total + F.when(hit, F.lit(weight).cast("decimal(5,4)")).otherwise(0)).cast("decimal(5,4)")
        number = number + hit.cast("int")
    sure = F.least(total, F.lit(1).cast("decimal(5,4)"))
    verdict = (
        F.when(F.size(against) > 0, F.struct(F.lit("REJECTED"), against))
        .when(other, F.struct(F.lit("REJECTED"), F.array(F.lit("another game"))))
        .when(told & ~ten, F.struct(F.lit("REJECTED"), F.array(F.lit("page data differ"))))
        .when(~in_title & ~(told & ten), F.struct(F.lit("REJECTED"), F.array(F.lit("no claim"))))
        .when(~game, F.struct(F.lit("REVIEW"), F.array(F.lit("game not identified"))))
        .when((number >= 3) & (sure >= F.lit("0.7").cast("decimal(5,4)")), F.struct(F.lit("CONFIRMED"), F.array().cast("array<string>")))
        .otherwise(F.struct(F.lit("REVIEW"), F.array(F.lit("not corroborated"))))
    )
    early = (F.size(against) > 0) | other | (told & ~ten)
    return df.withColumns(
        {
            "verdict": verdict["col1"],
            "confidence": F.when(early, F.lit(1).cast("decimal(5,4)")).otherwise(sure),
            "reasons": verdict["col2"],
        }
    )
