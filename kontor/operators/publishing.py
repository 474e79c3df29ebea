"""What may be listed and how: eligibility, SKUs, titles, condition descriptors, aspects, approved batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import BEGIN, END, comparison_key

# Promotional terms that a title should not hold, and labels of languages.
PROHIBITED = (
    "authentic", "genuine", "rare", "super rare", "ultra rare", "l@@k", "look", "wow", "must see",
    "best", "perfect", "flawless", "investment", "hot", "l👀k",
)
LANGUAGE_CODE = {"JAPANESE": "JP", "ENGLISH": "EN", "CHINESE": "ZH", "KOREAN": "KO"}
LANGUAGE_LABEL = {"JAPANESE": "Japanese", "CHINESE": "Chinese", "KOREAN": "Korean"}
TITLE_MAX, SKU_MAX = 80, 40
DROP_ORDER = ("set_name", "rarity", "gem_mint", "year", "number")


def eligibility(df: DataFrame, min_parse: float = 0.85, min_ai: float = 0.85, min_image: float = 0.9, min_profit: str = "1500", min_margin: str = "15", high_value: str = "200") -> DataFrame:  # noqa: E501
    """Adds ``blockers`` (code, severity), ``eligible`` and ``manual_review``.  A rule is a row of the table below.

    A fact that is not known blocks: each rule holds unless its column says that it does not, and an unknown list is not
    an empty one.  Only the confidences of image and text, which not every listing has, may be null, and the warnings of
    a text that was not generated.
    """
    c = F.col
    warned = lambda w: holds(F.exists("profit_warnings", lambda x: x.rlike(w)))
    holds = lambda x: F.coalesce(x, F.lit(True))
    shown = F.coalesce(c("has_images"), F.lit(False))
    # Codes and severities of the rules.
    rules = (
        ("NOT_PSA10", "BLOCKING", holds(c("verdict") == "REJECTED")),
        ("PSA_UNCONFIRMED", "REVIEW", c("verdict") == "REVIEW"),
        ("LOW_PARSE_CONFIDENCE", "BLOCKING", holds(c("parse_confidence") < min_parse)),
        ("MISSING_CARD_NAME_EN", "BLOCKING", F.coalesce(c("card_name_en"), F.lit("")) == ""),
        ("MISSING_CARD_NUMBER", "REVIEW", F.coalesce(c("card_number"), F.lit("")) == ""),
        ("UNKNOWN_LANGUAGE", "BLOCKING", F.coalesce(c("language"), F.lit("")) == ""),
        ("NO_IMAGES", "BLOCKING", ~shown),
        ("IMAGE_NOT_APPROVED", "BLOCKING", shown & holds(~c("image_approved"))),
        ("LOW_IMAGE_CONFIDENCE", "BLOCKING", shown & F.coalesce(c("image_confidence") < min_image, F.lit(False))),
        ("REPRESENTATIVE_IMAGE", "REVIEW", holds(c("representative_image"))),
        ("OUT_OF_STOCK", "BLOCKING", holds(c("available") <= 0)),
        ("ZERO_QUANTITY", "BLOCKING", holds(c("quantity") <= 0)),
        ("MISSING_TITLE", "BLOCKING", F.coalesce(c("title"), F.lit("")) == ""),
        ("TITLE_TOO_LONG", "BLOCKING", F.coalesce(F.length("title") > TITLE_MAX, F.lit(False))),
        ("MISSING_REQUIRED_ASPECTS", "BLOCKING", holds(F.array_size("missing_aspects") > 0)),
        ("CONDITION_DESCRIPTORS_UNRESOLVED", "BLOCKING", holds(~c("descriptors_resolved"))),
        ("LOW_AI_CONFIDENCE", "BLOCKING", F.coalesce(c("ai_confidence") < min_ai, F.lit(False))),
        ("AI_WARNINGS", "REVIEW", F.coalesce(F.array_size("ai_warnings") > 0, c("ai_confidence").isNotNull())),
        ("BELOW_MIN_PROFIT", "BLOCKING", holds(c("base_profit_jpy") < F.lit(min_profit).cast("decimal(20,6)"))),
        ("BELOW_MIN_MARGIN", "BLOCKING", holds(c("base_margin") < F.lit(min_margin).cast("decimal(8,5)"))),
        ("PESSIMISTIC_LOSS", "BLOCKING", holds(c("pessimistic_profit") <= 0)),
        ("CUSTOMS_UNDETERMINED", "REVIEW", warned("carrier quote|manual review")),
        ("INVALID_PRICE", "BLOCKING", warned("purchase price is zero|selling price is zero") | holds(c("selling_price") <= 0)),
        ("INSUFFICIENT_MARKET_DATA", "REVIEW", holds(~c("market_sufficient"))),
        ("HIGH_VALUE", "REVIEW", F.coalesce(c("selling_price") >= F.lit(high_value).cast("decimal(20,6)"), F.lit(False))),
        ("DUPLICATE_LISTING", "BLOCKING", holds(c("duplicate_listing"))),
    )
    made = F.array(*(F.when(hit, F.struct(F.lit(n).alias("code"), F.lit(s).alias("severity"))) for n, s, hit in rules))
    df = df.withColumn("blockers", F.filter(made, lambda x: x.isNotNull()))
    blocking = F.exists("blockers", lambda x: x["severity"] == "BLOCKING")
    return df.withColumns({"eligible": F.size("blockers") == 0, "manual_review": (F.size("blockers") > 0) & ~blocking})


def _grade(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), r"\.0+$", "")


def sku(name: Column, number: Column, set_code: Column, language: Column, company: Column, grade: Column) -> Column:
    """CB-readable-hash; the readable part alone is cut to fit."""
    code = F.coalesce(*(F.when(language == k, F.lit(v)) for k, v in LANGUAGE_CODE.items()), F.lit("XX"))
    identity = F.concat_ws(
        "|", comparison_key(name), F.coalesce(F.upper(F.regexp_replace(number, r"\s", "")), F.lit("")),
        F.coalesce(F.upper(set_code), F.lit("")), language, company, _grade(grade),
    )
    mark = F.upper(F.substring(F.sha2(identity, 256), 1, 8))

    def short(c: Column) -> Column:
        return F.nullif(F.substring(F.regexp_replace(F.upper(c), "[^A-Z0-9]", ""), 1, 10), F.lit(""))

    readable = F.concat_ws("-", short(set_code), short(number), code, F.concat(company, F.regexp_replace(_grade(grade), r"\.", "")))
    return F.concat(F.lit("CB-"), F.substring(readable, 1, SKU_MAX - 12), F.lit("-"), mark)


def sku_collisions(df: DataFrame, sku_col: str, identity: str) -> DataFrame:
    return df.groupBy(sku_col).agg(F.count_distinct(identity).alias("n_identities")).where("n_identities > 1")


def _clean(c: Column) -> Column:
    c = F.regexp_replace(c, r"[【】\[\]（）()]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[^\x20-\x7E]", ""), r"\s+", " "))


def listing_titles(df: DataFrame) -> DataFrame:
    """Adds title, title_length, omitted, title_warnings: segments in order, dropped one kind at a time until it fits.

    Columns read: release_year, language, card_name_en, set_name, card_number, rarity, grading_company, grade.
    """
    c = F.col
    label = F.coalesce(*(F.when(c("language") == k, F.lit(v)) for k, v in LANGUAGE_LABEL.items()), F.lit(None).cast("string"))
    gem = F.when((c("grade") == 10) & (F.upper("grading_company") == "PSA"), F.lit("GEM MINT"))
    segments = {
        "year": c("release_year").cast("string"), "game": F.lit("Pokemon"), "language": label, "name": _clean(c("card_name_en")),
        "set_name": _clean(c("set_name")), "number": _clean(c("card_number")), "rarity": _clean(c("rarity")),
        "grade": F.concat_ws(" ", c("grading_company"), _grade(c("grade"))), "gem_mint": gem,
    }
    df = df.withColumns({f"_s_{n}": F.nullif(v, F.lit("")) for n, v in segments.items()})

    def joined(dropped: tuple[str, ...], name: Column | None = None) -> Column:
        return F.concat_ws(" ", *(name if n == "name" and name is not None else c(f"_s_{n}") for n in segments if n not in dropped))

    tries = [joined(DROP_ORDER[:i]) for i in range(len(DROP_ORDER) + 1)]
    over = F.length(tries[-1]) - TITLE_MAX
    cut = F.substring(c("_s_name"), F.lit(1), F.length("_s_name") - over)
    space = F.length(cut) - F.locate(" ", F.reverse(cut)) + 1
    word = F.when(F.locate(" ", cut) > 1, F.trim(F.substring(cut, F.lit(1), space - 1))).otherwise(F.trim(cut))
    shorter = joined(DROP_ORDER, F.when(F.length("_s_name") > over, F.nullif(word, F.lit(""))))
    title = F.coalesce(*(F.when(F.length(t) <= TITLE_MAX, t) for t in tries), F.trim(F.substring(shorter, 1, TITLE_MAX)))
    present = [F.when(F.length(tries[i]) > TITLE_MAX, F.when(c(f"_s_{n}").isNotNull(), F.lit(n))) for i, n in enumerate(DROP_ORDER)]
    named = c("_s_name").isNotNull()
    df = df.withColumns({"title": F.when(named, title).otherwise(""), "_cut": named & (over > 0), "_hard": named & (F.length(shorter) > TITLE_MAX) & (over > 0)})
    low = F.lower("title")
    warnings = [
        F.when(~named, F.lit("card name is empty")),
        F.when(c("_cut"), F.lit("card name truncated")),
        F.when(c("_hard"), F.lit("hard truncated")),
        *(F.when(named & low.rlike(BEGIN + "".join("\\" + x if not x.isalnum() and x != " " else x for x in t) + END), F.lit(f"promotional term {t}")) for t in PROHIBITED),
        F.when(named & ~F.col("title").rlike("(?i)PSA|BGS|CGC|SGC|ARS"), F.lit("no grading company")),
        F.when(named & (c("language") == "JAPANESE") & ~low.contains("japanese"), F.lit("not marked as Japanese")),
    ]
    df = df.withColumns(
        {
            "title_length": F.length("title"),
            "omitted": F.when(named, F.filter(F.array(*present), lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>")),
            "title_warnings": F.filter(F.array(*warnings), lambda x: x.isNotNull()),
        }
    )
    return df.drop(*(f"_s_{n}" for n in segments), "_cut", "_hard")


def resolve_descriptors(listings: DataFrame, policies: DataFrame) -> DataFrame:
    """Ids of condition, grader and grade for each listing (category_id, grading_company, grade), or why there are none.

    ``policies`` are the flat rows of ``sources.metadata.flatten_condition_policies``.
    """
    norm = lambda c: F.lower(F.trim(c))
    flat = policies.withColumns({"kind": norm(F.col("descriptor_name")), "said": norm(F.col("value_name"))})
    graders = flat.where(F.col("kind").isin("professional grader", "grader"))
    first = graders.groupBy("category_id").agg(F.min_by("condition_id", "position").alias("condition_id"))
    graders = graders.join(first, ["category_id", "condition_id"])
    grades = flat.where("kind = 'grade'").join(first, ["category_id", "condition_id"])
    own = listings.withColumns({"_company": norm(F.col("grading_company")), "_grade": _grade(F.col("grade"))})
    known = policies.select("category_id").distinct().withColumn("_policy", F.lit(True))
    g = graders.select("category_id", "condition_id", F.col("descriptor_id").alias("grader_descriptor_id"), F.col("value_id").alias("grader_value_id"), F.col("said").alias("_company"), "position")
    g = g.groupBy("category_id", "_company").agg(F.min_by(F.struct("condition_id", "grader_descriptor_id", "grader_value_id"), "position").alias("_g"))
    v = grades.select("category_id", F.col("descriptor_id").alias("grade_descriptor_id"), F.col("value_id").alias("grade_value_id"), "said", "position")
    df = own.join(known, "category_id", "left").join(first.select("category_id", F.lit(True).alias("_graded")), "category_id", "left")
    df = df.join(g, ["category_id", "_company"], "left")
    fits = (F.col("said") == F.col("_grade")) | (F.col("said") == F.format_number(F.col("grade").cast("double"), 1)) | F.array_contains(
        F.split("said", "[^a-z0-9_]+"), F.col("_grade")
    )
    hit = df.select("listing_id", "category_id", "_grade", "grade").join(v, "category_id").where(fits)
    hit = hit.groupBy("listing_id").agg(F.min_by(F.struct("grade_descriptor_id", "grade_value_id"), "position").alias("_v"))
    df = df.join(hit, "listing_id", "left")
    why = (
        F.when(F.col("_policy").isNull(), "no policy for the category")
        .when(F.col("_graded").isNull(), "no graded condition")
        .when(F.col("_g").isNull(), "company not offered")
        .when(F.col("_v").isNull(), "grade not offered")
    )
    return df.select(*listings.columns, "_g.*", "_v.*", why.alias("failure"))


def split_aspects(items: DataFrame, allowed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted with their canonical names, rejected): items (listing_id, category_id, specifics map) against the aspects
    of their category, ``allowed`` (category_id, name).

    Names agree without regard to case and outer blanks; of several spellings of one name a category's greatest is its
    own, and of several values for one aspect the one under the greatest given name stays.
    """
    key = lambda c: F.lower(F.trim(c))
    given = items.select("listing_id", "category_id", F.explode("specifics").alias("name", "value")).withColumn("_k", key(F.col("name")))
    canonical = allowed.groupBy("category_id", key(F.col("name")).alias("_k")).agg(F.max("name").alias("canonical"))
    both = given.join(canonical, ["category_id", "_k"], "left")
    accepted = both.where("canonical is not null").groupBy("listing_id", "canonical").agg(F.max_by("value", "name").alias("value"))
    return accepted, both.where("canonical is null").select("listing_id", "name")


def missing_aspects(items: DataFrame, required: DataFrame) -> DataFrame:
    """Names that a listing's category requires and the listing does not provide, as an array for each listing."""
    names = required.where("required").groupBy("category_id").agg(F.array_sort(F.collect_set(F.lower(F.trim("name")))).alias("_need"))
    have = F.transform(F.map_keys(F.map_filter("specifics", lambda k, v: F.coalesce(v, F.lit("")) != "")), lambda k: F.lower(F.trim(k)))
    need = F.coalesce("_need", F.array().cast("array<string>"))
    return items.join(names, "category_id", "left").select("listing_id", F.array_except(need, have).alias("missing"))


def approved_batch(listings: DataFrame, approvals: DataFrame, environment: str, dry_run: bool = True, allow_production: bool = False, cap: int = 5) -> DataFrame:
    """Adds ``block_reason`` (null: to be sent); the first ``cap`` approved listings by id are sent.

    A product may have any number of approvals.  One for this environment and this payload lets a listing through; the
    reason why it is stopped comes from what approvals there are.
    """
    own = approvals.select("product_id", F.col("environment").alias("_env"), F.col("payload_hash").alias("_hash"))
    some = own.groupBy("product_id").agg(F.count_if(F.col("_env") == environment).alias("_here"))
    fits = own.where(F.col("_env") == environment).select("product_id", F.col("_hash").alias("payload_hash"), F.lit(True).alias("_fits")).distinct()
    df = listings.join(some, "product_id", "left").join(fits, ["product_id", "payload_hash"], "left")
    why = (
        F.when(F.lit(dry_run), "dry run")
        .when(F.lit(environment == "PRODUCTION" and not allow_production), "production not allowed")
        .when(F.col("_here").isNull(), "no approval")
        .when(F.col("_here") == 0, "approved for another environment")
        .when(F.col("_fits").isNull(), "payload changed since the approval")
    )
    df = df.select(*listings.columns, why.alias("block_reason"))
    sent = df.where("block_reason is null").orderBy("listing_id").limit(cap).select("listing_id", F.lit(True).alias("_sent"))
    df = df.join(F.broadcast(sent), "listing_id", "left")  # cap rows
    reason = F.when(F.col("block_reason").isNull() & F.col("_sent").isNull(), "run cap reached").otherwise(F.col("block_reason"))
    return df.withColumn("block_reason", reason).drop("_sent")


def duplicate_live(listings: DataFrame) -> DataFrame:
    """Live listings whose product has another one in the same marketplace and environment."""
    key = ["product_id", "marketplace", "environment"]
    many = listings.where("is_live").groupBy(*key).agg(F.count(F.lit(1)).alias("n_live")).where("n_live > 1")
    return listings.where("is_live").join(many, key)
