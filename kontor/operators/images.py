"""Image duplicates, consensus of detected regions, and whether masks are safe to apply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Share of the slab that the label takes, and the shape of a slab.
LABEL = {"CURRENT": 0.21, "LEGACY": 0.24}
ASPECT, TOLERANCE = 1.9, 0.35


def image_duplicates(images: DataFrame) -> DataFrame:
    """Per content hash (listing_id, content, used_at): listings that use it, first and last use."""
    hashed = images.withColumn("sha256", F.sha2("content", 256))
    sums = hashed.groupBy("sha256").agg(
        F.count(F.lit(1)).alias("n_uses"), F.count_distinct("listing_id").alias("n_listings"),
        F.min("used_at").alias("first_used"), F.max("used_at").alias("last_used"),
    )
    return sums.where("n_listings > 1")


def area(w: Column, h: Column) -> Column:
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def _overlap(a: str, b: str) -> Column:
    right = F.least(F.col(f"{a}x") + F.col(f"{a}width"), F.col(f"{b}x") + F.col(f"{b}width"))
    low = F.least(F.col(f"{a}y") + F.col(f"{a}height"), F.col(f"{b}y") + F.col(f"{b}height"))
    return area(right - F.greatest(f"{a}x", f"{b}x"), low - F.greatest(f"{a}y", f"{b}y"))


def consensus_regions(regions: DataFrame, agreement: float = 0.3) -> DataFrame:
    """One region per image and kind: a manual one, or the surest, widened by the boxes of other sources that agree.

    The surest box is a maximum per key; the others meet it by a join on that key, never each other.
    """
    key = ["image_id", "kind"]
    box = ["x", "y", "width", "height", "confidence", "source"]
    order = F.struct((F.col("source") == "MANUAL").alias("m"), F.when(F.col("source") == "MANUAL", 1.0).otherwise(F.col("confidence")).alias("c"), (-F.col("position")).alias("p"))
    best = regions.groupBy(*key).agg(F.max_by(F.struct(*box), order).alias("b")).select(*key, *(F.col(f"b.{c}").alias(f"b_{c}") for c in box))
    df = regions.join(best, key)
    union = area(F.col("width"), F.col("height")) + area(F.col("b_width"), F.col("b_height")) - _overlap("", "b_")
    iou = F.coalesce(F.try_divide(_overlap("", "b_"), union), F.lit(0.0))
    agrees = (F.col("b_source") != "MANUAL") & (F.col("source") != F.col("b_source")) & (iou >= agreement)
    out = df.groupBy(*key, *(f"b_{c}" for c in box)).agg(
        F.count_if(agrees).alias("n_agreeing"),
        F.min(F.when(agrees, F.col("x"))).alias("x0"), F.min(F.when(agrees, F.col("y"))).alias("y0"),
        F.max(F.when(agrees, F.col("x") + F.col("width"))).alias("x1"), F.max(F.when(agrees, F.col("y") + F.col("height"))).alias("y1"),
    )
    x, y = F.least("b_x", F.coalesce("x0", "b_x")), F.least("b_y", F.coalesce("y0", "b_y"))
    right = F.greatest(F.col("b_x") + F.col("b_width"), F.coalesce("x1", F.lit(float("-inf"))))
    low = F.greatest(F.col("b_y") + F.col("b_height"), F.coalesce("y1", F.lit(float("-inf"))))
    sure = (
        F.when(F.col("b_source") == "MANUAL", 1.0)
        .when(F.col("n_agreeing") > 0, F.least(F.lit(0.99), F.col("b_confidence") + 0.15 * F.col("n_agreeing")))
        .otherwise(F.col("b_confidence"))
    )
    return out.select(
        *key, x.alias("x"), y.alias("y"), (right - x).alias("width"), (low - y).alias("height"),
        F.col("b_source").alias("source"), sure.alias("confidence"), "n_agreeing",
    )


def mask_safety(regions: DataFrame, images: DataFrame, generation: str = "CURRENT", most_percent: float = 8.0, least_confidence: float = 0.7) -> DataFrame:
    """Per image (image_id, image_width, image_height, slab_x, slab_y, slab_width, slab_height): why masks are not safe."""
    share = LABEL[generation]
    own = images.withColumns(
        {
            "card_x": F.col("slab_x"), "card_y": F.col("slab_y") + F.col("slab_height") * share,
            "card_width": F.col("slab_width"), "card_height": F.col("slab_height") * (1 - share),
        }
    )
    r = regions.select("image_id", F.col("kind").alias("r_kind"), *(F.col(c).alias(f"r_{c}") for c in ("x", "y", "width", "height", "confidence")))
    df = own.join(r, "image_id", "left")
    there = F.col("r_kind").isNotNull()
    touches = there & ~(
        (F.col("r_x") + F.col("r_width") <= F.col("card_x")) | (F.col("card_x") + F.col("card_width") <= F.col("r_x"))
        | (F.col("r_y") + F.col("r_height") <= F.col("card_y")) | (F.col("card_y") + F.col("card_height") <= F.col("r_y"))
    )
    past = (F.col("r_x") + F.col("r_width") > F.col("image_width")) | (F.col("r_y") + F.col("r_height") > F.col("image_height"))
    tests = {
        "overlaps the card": touches, "starts outside": there & ((F.col("r_x") < 0) | (F.col("r_y") < 0)),
        "extends past the edge": there & past, "no area": there & (area(F.col("r_width"), F.col("r_height")) <= 0),
    }
    names = F.filter(F.array(*(F.when(t, F.concat(F.col("r_kind"), F.lit(f": {n}"))) for n, t in tests.items())), lambda x: x.isNotNull())
    keep = ["image_id", "image_width", "image_height", "slab_width", "slab_height"]
    sums = df.groupBy(*keep).agg(
        F.array_sort(F.flatten(F.collect_list(names))).alias("failures"), F.count("r_kind").alias("n_regions"),
        F.coalesce(F.sum(area(F.col("r_width"), F.col("r_height"))), F.lit(0.0)).alias("masked"), F.min("r_confidence").alias("lowest"),
    )
    percent = F.coalesce(F.try_divide(F.col("masked") * 100, F.col("image_width") * F.col("image_height")), F.lit(0.0))
    ratio = F.try_divide(F.col("slab_height"), F.col("slab_width"))
    slab = (F.col("slab_width") > 0) & (F.col("slab_height") > 0) & (F.abs(ratio - ASPECT) <= TOLERANCE)
    more = F.array(
        F.when(percent > most_percent, F.lit("masks cover too much")), F.when(F.col("n_regions") == 0, F.lit("no regions")),
        F.when(F.least(F.coalesce("lowest", F.lit(1.0)), F.lit(1.0)) < least_confidence, F.lit("low confidence")),
        F.when(~F.coalesce(slab, F.lit(False)), F.lit("not slab-shaped")),
    )
    failures = F.concat("failures", F.filter(more, lambda x: x.isNotNull()))
    return sums.select("image_id", percent.alias("masked_percent"), F.coalesce("lowest", F.lit(0.0)).alias("lowest_confidence"), failures.alias("failures")).withColumn(
        "safe", F.size("failures") == 0
    )
