"""Queries on titles, URLs, pages, generated text and images."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, text, urls
from ..operators import attributes, audit, images
from ..sources import adapter
from ..sources import pages as src
from ..sources.checkpoints import shared_folder
from .stand_ins import spread, table


def normalise(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", F.sha2(text.normalised(F.col("text")), 256).alias("normal"))


def keys(spark, sf_dir):
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand")
    return p.select("p_partkey", text.comparison_key(F.concat_ws(" - ", "p_name", "p_brand")).alias("key"))


def prices(spark, sf_dir):
    d = table(spark, sf_dir, "pages", "page_id", "url")
    return d.select("page_id", F.col("url"), text.price(F.col("url")).cast("double").alias("price")).drop("url")


def similarity(spark, sf_dir):
    p = table(spark, sf_dir, "part", "p_partkey", "p_name")
    return p.select("p_partkey", F.round(text.similarity(F.col("p_name"), F.lit("red widget")), 6).alias("similarity"))


def search_queries(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    name = F.when(F.col("p_partkey") % 6 != 0, F.col("p_name"))
    grade = (F.col("p_size") % 11).cast("decimal(3,1)")
    return p.select("p_partkey", text.search_query(name, F.col("p_size").cast("string"), F.lit("PSA"), grade).alias("query"))


def extract(spark, sf_dir):
    """Parts as titles with a grader, a grade, a number, a rarity and a set code."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    title = F.concat_ws(
        " ", F.when(k % 3 != 0, F.concat(F.lit("【PSA"), (F.col("p_size") % 10 + 1).cast("string"), F.lit("】"))), "p_name",
        F.when(k % 4 != 0, F.concat(F.lpad(F.col("p_size").cast("string"), 3, "0"), F.lit("/165"))), F.when(k % 5 == 0, F.lit("SAR")), F.when(k % 7 == 0, F.lit("SV2a")),
    )
    df = attributes.parse_titles(p.select("p_partkey", title.alias("title")))
    return df.select(
        "p_partkey", F.col("card_number.value").alias("number"), F.col("rarity.value").alias("rarity"), F.col("set_code.value").alias("set_code"), F.col("grading_company.value").alias("company"),
        F.col("grade.value").cast("double").alias("grade"), F.array_join("warnings", ",").alias("warnings"),
    )


def supplier_rules(spark, sf_dir):
    """A supplier's rules on documents' first lines: a number after a word, overriding the parser."""
    p = table(spark, sf_dir, "part")
    title = F.concat_ws(" ", "p_name", F.concat(F.lit("no."), F.col("p_size").cast("string")))
    fields, _ = rules.title_rules(F.col("title"), text.attributes(F.col("title")), [("card_number", r"no\.([0-9]{2,})", 0.99)])
    return p.select("p_partkey", title.alias("title")).select("p_partkey", fields["card_number"]["value"].alias("number"), fields["card_number"]["source"].alias("source"))


def structured(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    fields = rules.structured(text.attributes(F.col("p_name")), {"set_code": F.col("p_type"), "grading_company": F.when(F.col("p_size") > 25, "psa").otherwise(F.col("p_brand"))}, text.COMPANIES)
    return p.select("p_partkey", fields["set_code"]["value"].alias("set_code"), fields["grading_company"]["value"].alias("company"))


def grade_claims(spark, sf_dir):
    """Parts as classifier input: claims in the title, other graders, bundles, page data."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    df = p.select(
        "p_partkey", F.concat_ws(" ", F.when(k % 2 == 0, "PSA10"), F.when(k % 3 == 0, "ポケモン"), "p_name", F.when(k % 11 == 0, "BGS 9"), F.when(k % 13 == 0, "まとめ売り")).alias("title"),
        F.array(F.when(k % 5 == 0, F.lit("PSA cards")).otherwise("cards")).alias("breadcrumbs"), F.lit("").alias("description"), F.lit("x").alias("source_category_url"),
        F.when(k % 7 == 0, "PSA").alias("structured_company"), F.when(k % 7 == 0, F.when(k % 14 == 0, 10).otherwise(9)).cast("decimal(3,1)").alias("structured_grade"),
    )
    return rules.grade_claims(df).select("p_partkey", "verdict", F.round(F.col("confidence").cast("double"), 4).alias("confidence"))


def stock_text(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority")
    line = F.when(F.col("o_orderkey") % 7 == 0, F.lit("?")).otherwise(F.col("o_orderpriority"))
    found = rules.first_match(line, [(r"^([0-9])-(?:URGENT|HIGH)", "IN_STOCK", 1), ("(?i)low", "OUT_OF_STOCK", None), ("MEDIUM", "IN_STOCK", None)])
    return o.select("o_orderkey", found["status"].alias("status"), found["quantity"].alias("quantity"))


def canonical_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages", "page_id", "url").select("page_id", urls.canonical(F.col("url")).alias("canonical"))


def url_policy(spark, sf_dir):
    d = table(spark, sf_dir, "pages", "page_id", "url")
    return d.select("page_id", F.coalesce(urls.refusal(F.col("url"), ("example.com", "example.org")), F.lit("allowed")).alias("outcome"))


def source_ids(spark, sf_dir):
    d = table(spark, sf_dir, "pages", "page_id", "url")
    return src.source_ids(d, [("query", "id"), ("path", r"/[a-z]{2}/([0-9]+)$")]).select("page_id", "source_id")


CARDS = src.CardConfig(src.Selector("li"), {"name": src.Selector("a"), "link": src.Selector("a", attribute="href"), "price": src.Selector("a")})


def listing_cards(spark, sf_dir):
    """The entries of each page's list as cards."""
    return src.extract_listing_cards(table(spark, sf_dir, "pages"), CARDS).select("page_id", "position", "name", "link")


def adapter_health(spark, sf_dir):
    cards = src.extract_listing_cards(table(spark, sf_dir, "pages"), CARDS).withColumn("host", F.lower(urls.part(F.col("url"), 3)))
    health = src.adapter_health(cards.withColumn("price", F.col("price_value")), "host", ["name", "link", "price"])
    return health.select("host", "n_cards", "hits_name", "healthy")


def _shop(spark, sf_dir):
    """Parts as a shop's pages of 40: a card and a structured-data block for each."""
    k = F.col("p_partkey")
    card = F.concat(F.lit('<div class="item c'), k % 3, F.lit('"><p><a href="/p/'), k, F.lit('" data-id="'), k, F.lit('">'), "p_name", F.lit('</a></p><b class="price">¥'), F.col("p_size"), F.lit(",000</b></div>"))
    node = F.concat(F.lit('{"@type": "Product", "sku": "'), k, F.lit('"}'))
    block = F.when(k % 3 == 0, F.concat(F.lit('[{"@type": "Offer"}, '), node, F.lit("]"))).when(k % 3 == 1, node).otherwise("{oops")
    line = F.concat(card, F.lit('<script type="application/ld+json">'), block, F.lit("</script>"))
    p = table(spark, sf_dir, "part").groupBy(F.expr("p_partkey div 40").alias("page_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), line.alias("line")))), lambda x: x["line"]), "").alias("lines"))
    return p.select("page_id", F.concat(F.lit("https://shop.example.com/c?page="), "page_id").alias("url"), F.concat(F.lit("<main>"), "lines", F.lit("</main>")).alias("html"))


#: Two suppliers as configuration: entries of lists, and the shop's cards, of which sku is asked for before the path.
SUPPLIERS = [
    {"supplier": "lists", "card": {"tag": "li"}, "fields": {"name": {"tag": "a"}, "link": {"tag": "a", "attribute": "href"}}, "ids": [["query", "id"], ["path", "/([a-z0-9]+)$"]]},
    {
        "supplier": "shop/parts", "card": {"css": "main > div.item"}, "ids": [["field", "sku"], ["path", "/p/([0-9]+)"]],
        "fields": {
            "name": {"css": "p > a"}, "link": {"tag": "a", "attribute": "href"}, "sku": {"css": "div.c1 a[href]", "attribute": "data-id"},
            "thousands": {"tag": "b", "cls": "price", "regex": "¥([0-9]{2,}),", "required": True},
        },
    },
]


def saved_pages(spark: SparkSession, sf_dir: str) -> str:
    """A folder with the pages of both suppliers."""
    folder = f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}"
    lists = table(spark, sf_dir, "pages", "page_id", "url", "html").withColumn("supplier", F.lit("lists"))
    shop = _shop(spark, sf_dir).withColumn("supplier", F.lit("shop/parts"))
    lists.unionByName(shop).write.partitionBy("supplier").parquet(folder)
    return folder


def adapter_options(folder: str) -> dict[str, str]:
    return {"path": folder, "suppliers": json.dumps(SUPPLIERS)}


def adapter_rows(df: DataFrame) -> DataFrame:
    name, short = F.element_at("fields", "name"), F.array_join("missing_required", ",")
    return df.select("supplier", "page_id", "position", "source_id", name.alias("name"), short.alias("missing"))


def supplier_pages(spark, sf_dir):
    """The cards of both suppliers through the data source."""
    adapter.register(spark)
    return adapter_rows(spark.read.format(adapter.NAME).options(**adapter_options(saved_pages(spark, sf_dir))).load())


ADAPTER_SQL = r"""
lists AS (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a></li>')) AS item, unnest(range(len(regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a></li>')))) AS position FROM pages),
both_ AS (
  SELECT 'lists' AS supplier, page_id, CAST(position AS INTEGER) AS position,
    coalesce(nullif(regexp_extract(item, '[?&]id=([^&"#]+)', 1), ''), nullif(regexp_extract(regexp_extract(item, 'href="([^"?#]*)', 1), '/([a-z0-9]+)$', 1), '')) AS source_id,
    nullif(trim(regexp_replace(regexp_extract(item, '>([^<]*)</a>', 1), '\s+', ' ', 'g')), '') AS name, '' AS missing FROM lists
  UNION ALL
  SELECT 'shop/parts', p_partkey // 40, CAST(row_number() OVER (PARTITION BY p_partkey // 40 ORDER BY p_partkey) - 1 AS INTEGER), CAST(p_partkey AS VARCHAR), p_name,
    CASE WHEN p_size < 10 THEN 'thousands' ELSE '' END FROM part)
"""


def card_classes(spark, sf_dir):
    return src.discover_card_classes(_shop(spark, sf_dir)).select("page_id", "class", "n", "rank")


def json_ld_nodes(spark, sf_dir):
    b = src.extract_json_ld(_shop(spark, sf_dir))
    return b.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.count_if("parses").alias("n_parse"), F.sum(F.size("types")).alias("n_types"), F.min("type").alias("first_type"))


def card_fields(spark, sf_dir):
    """Fields by nested selectors, an attribute, a pattern, and a required field that some cards lack."""
    config = src.CardConfig(
        src.Selector(css="main > div.item"),
        {"name": src.Selector(css="p > a"), "sku": src.Selector(css="a[href]", attribute="data-id"), "thousands": src.Selector("b", "price", regex="¥([0-9]{2,}),", required=True)},
    )
    cards = src.source_ids(src.extract_listing_cards(_shop(spark, sf_dir), config), [("query", "id"), ("attribute", "sku")])
    return cards.select("source_id", "name", "thousands", F.array_join("missing_required", ",").alias("missing"))


def json_ld_ids(spark, sf_dir):
    b = src.extract_json_ld(_shop(spark, sf_dir))
    return src.source_ids(b.withColumn("url", F.lit("https://shop.example.com/")), [("path", "/p/([0-9]+)"), ("json_ld", "sku"), ("json_ld", "$[1].sku")]).select("source_id")


def json_ld(spark, sf_dir):
    """Structured-data blocks of each page, none for most."""
    p = table(spark, sf_dir, "pages")
    n = src.extract_json_ld(p).groupBy("page_id").agg(F.count(F.lit(1)).alias("n_blocks"))
    return p.select("page_id").join(n, "page_id", "left").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(0)))


def page_structure(spark, sf_dir):
    df = src.page_structure(table(spark, sf_dir, "pages"))
    return df.select("page_id", "host", "script_chars", "n_links", "n_open_graph", "client_rendered")


def structure_by_host(spark, sf_dir):
    return src.structure_by_host(src.page_structure(table(spark, sf_dir, "pages"))).select("host", "n_pages", "script_chars", "n_links")


def audit_numbers(spark, sf_dir):
    """Numbers of each page's URL that its text does not hold."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.array_join(F.array_sort(F.array_distinct(audit.unsupported_numbers(p, "html", "url"))), ",").alias("unsupported"))


def audit_text(spark, sf_dir):
    """URLs as generated output, nested in JSON, against the page."""
    p = table(spark, sf_dir, "pages")
    deep = F.col("url").alias("v")
    for name in "edcba":
        deep = F.struct(deep).alias(name)
    doc = F.to_json(F.struct(F.struct(F.col("url").alias("link")).alias("item"), F.lit("1999").alias("descriptionEn"), deep))
    flags = audit.audit_generated_text(p.select(F.col("page_id").alias("target_id"), F.col("html").alias("source_text"), doc.alias("output")))
    return flags.groupBy("target_id").agg(F.count(F.lit(1)).alias("n_flags"), F.min("field").alias("field"))


def validate(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    specifics = F.create_map(F.lit("Role"), F.col("role"), F.when(F.col("turn") % 3 == 0, F.concat(F.lit("x"), F.col("text"))).otherwise("Language"), F.lit("en"))
    warnings = F.when(F.col("conv_id") % 5 == 0, F.array(F.struct(F.lit("text").alias("field"), F.col("text").alias("message"))))
    doc = F.to_json(F.struct(F.col("text").alias("descriptionEn"), specifics.alias("itemSpecifics"), (F.col("turn") / 4).alias("confidence"), warnings.alias("warnings")))
    doc = F.when(F.col("conv_id") % 7 == 0, F.concat(F.lit("oops "), doc)).otherwise(doc)
    df = audit.validate_copy(c.select("conv_id", "turn", doc.alias("output")))
    return df.select("conv_id", "turn", F.array_join(F.array_sort("issues"), ",").alias("issues"))


def validate_translation(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    fields = F.struct(F.col("text").alias("cardNameEn"), F.lit(None).cast("string").alias("setNameEn"), F.col("role").alias("characterEn"), (F.col("turn") / 4).alias("confidence"))
    df = audit.validate_translation(c.select("conv_id", "turn", F.to_json(fields, {"ignoreNullFields": "false"}).alias("output")))
    return df.select("conv_id", "turn", F.array_join(F.array_sort("issues"), ",").alias("issues"))


def quality(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    df = c.select(F.col("role").alias("model"), (F.col("conv_id") % 3).alias("purpose"), (F.length("text") > 100).alias("schema_valid"), (F.col("turn") % 2).alias("n_flags"), F.lit(0.9).alias("confidence"))
    return audit.generation_quality(audit.needs_review(df))


def generation_log(spark, sf_dir):
    """Append-ready log rows: output, validity, flags, and the prompt's hash."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", audit.prompt_hash(F.col("role"), F.col("text")).alias("prompt_hash"), (F.length("text") > 0).alias("schema_valid"))


def generation_log_rows(spark, sf_dir):
    """Generation runs of conversations, each output naming a number of its own, as log rows."""
    c = table(spark, sf_dir, "conversations")
    specifics = F.create_map(F.lit("Seen"), F.concat(F.lit("no "), (F.col("conv_id") % 900 + 11).cast("string")))
    doc = F.to_json(F.struct(F.col("text").alias("descriptionEn"), specifics.alias("itemSpecifics"), (F.col("turn") % 3 / 2).alias("confidence")))
    runs = c.select(
        F.concat_ws("-", "conv_id", "turn").alias("run_id"), F.col("role").alias("model"), F.lit("copy").alias("purpose"), F.col("text").alias("prompt"), F.col("text").alias("source_text"),
        F.when(F.col("conv_id") % 7 == 0, "oops").otherwise(doc).alias("output"),
    )
    log = audit.generation_log(runs)
    return log.select("run_id", "prompt_hash", F.array_join("issues", ",").alias("issues"), F.array_join("flags.number", ",").alias("flagged"), "needs_review")


def encoded_urls(spark, sf_dir):
    """Four spellings of the address of each part, which are one."""
    k, name = F.col("p_partkey"), F.col("p_name")
    form = F.url_encode(name)
    spellings = F.array(
        F.concat(F.lit("https://Shop.example/カ/b?q="), form, F.lit("&Color=a"), k), F.concat(F.lit("http://shop.example/%E3%82%AB//b/?color=a"), k, F.lit("&q="), F.replace(form, F.lit("+"), F.lit("%20"))),
        F.concat(F.lit("https://shop.example:443/x/../カ/b/?%71="), form, F.lit("&c%6Flor=a"), k, F.lit("#top")), F.concat(F.lit("https://shop.example/カ/b?utm_source=m&q="), form, F.lit("&color=%61"), k, F.lit("&s%69d=1")),
    )
    p = spread(table(spark, sf_dir, "part", "p_partkey", "p_name"), "p_partkey").select(k, F.posexplode(spellings).alias("i", "url"))
    return p.select("p_partkey", "i", urls.canonical(F.col("url")).alias("canonical"))


def reusable(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("prompt_hash", F.sha2("text", 256)).withColumn("schema_valid", F.lit(True))
    asked, fresh = audit.reusable(c, c.where("conv_id % 2 = 0").select("prompt_hash", "schema_valid"))
    return asked.agg(F.count(F.lit(1)).alias("n_reused")).crossJoin(fresh.agg(F.count(F.lit(1)).alias("n_fresh")))


def image_duplicates(spark, sf_dir):
    """Documents as image contents: equal ones used by several listings."""
    d = table(spark, sf_dir, "documents", "doc_id", "text").select(F.col("doc_id").alias("listing_id"), F.col("text").cast("binary").alias("content"), F.col("doc_id").alias("used_at"))
    return images.image_duplicates(d).select("sha256", "n_uses", "n_listings", "first_used", "last_used")


def _regions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    return e.select(
        F.col("user_id").alias("image_id"), F.col("event_type").alias("kind"), F.when(k % 40 == 0, "MANUAL").when(k % 2 == 0, "OCR").otherwise("TEMPLATE").alias("source"),
        (k % 50).cast("double").alias("x"), (k % 30).cast("double").alias("y"), F.lit(40.0).alias("width"), F.lit(25.0).alias("height"), (k % 90 / 100).alias("confidence"), k.alias("position"),
    )


def consensus(spark, sf_dir):
    df = images.consensus_regions(_regions(spark, sf_dir))
    return df.select("image_id", "kind", "x", "y", "width", "height", "source", F.round("confidence", 6).alias("confidence"), "n_agreeing")


def mask_safety(spark, sf_dir):
    r = _regions(spark, sf_dir)
    own = table(spark, sf_dir, "events").select(F.col("user_id").alias("image_id")).distinct()
    size = {"image_width": 200.0, "image_height": 380.0, "slab_x": 0.0, "slab_y": 0.0, "slab_width": 200.0, "slab_height": 380.0}
    df = images.mask_safety(r, own.withColumns({k: F.lit(v) for k, v in size.items()}), most_percent=50.0)
    return df.select("image_id", F.round("masked_percent", 4).alias("masked_percent"), "safe", F.size("failures").cast("long").alias("n_failures"))


NORMAL = "trim(regexp_replace(translate({c}, '【〔】〕—–―（）／　', '[[]]---()/ '), '[\\s\\x{{a0}}]+', ' ', 'g'))"
HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1))"
QUERIES = {
    "t1_normalise_titles": (normalise, f"SELECT doc_id, sha256({NORMAL.format(c='text')}) AS normal FROM documents"),
    "t2_comparison_keys": (keys, "SELECT p_partkey, regexp_replace(lower(p_name || p_brand), '[\\[\\]()・･\\-_,.''\"\\s]', '', 'g') AS key FROM part"),
    "t3_parse_prices": (prices, "SELECT page_id, CAST(replace(nullif(regexp_extract(url, '([0-9]{1,3}(,[0-9]{3})+|[0-9]+)', 1), ''), ',', '') AS DOUBLE) AS price FROM pages"),
    "t19_name_similarity": (
        similarity,
        "SELECT p_partkey, round(CASE WHEN k = 'redwidget' THEN 1 ELSE 1 - levenshtein(k, 'redwidget')::DOUBLE / greatest(length(k), 9) END, 6) AS similarity FROM (SELECT p_partkey, replace(lower(p_name), ' ', '') AS k FROM part)",
    ),
    "t18_search_queries": (search_queries, "SELECT p_partkey, CASE WHEN p_partkey % 6 <> 0 THEN p_name || ' ' || p_size || ' PSA ' || (p_size % 11) END AS query FROM part"),
    "t4_t7_extract_attributes": (
        extract,
        """SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN lpad(p_size::VARCHAR, 3, '0') || '/165' END AS number, CASE WHEN p_partkey % 5 = 0 THEN 'SAR' END AS rarity,
           CASE WHEN p_partkey % 7 = 0 THEN 'SV2A' END AS set_code, CASE WHEN p_partkey % 3 <> 0 THEN 'PSA' END AS company, CASE WHEN p_partkey % 3 <> 0 THEN (p_size % 10 + 1)::DOUBLE END AS grade,
           array_to_string(list_filter([CASE WHEN p_partkey % 4 = 0 THEN 'MISSING_CARD_NUMBER' END, 'UNKNOWN_LANGUAGE', CASE WHEN p_partkey % 3 <> 0 AND p_size % 10 <> 9 THEN 'NOT_GRADE_10' END], lambda x: x IS NOT NULL), ',') AS warnings FROM part""",
    ),
    "t5_supplier_rules": (
        supplier_rules,
        "SELECT p_partkey, CASE WHEN p_size >= 10 THEN p_size::VARCHAR END AS number, CASE WHEN p_size >= 10 THEN 'supplier_rule' ELSE 'unknown' END AS source FROM part",
    ),
    "t6_structured": (structured, "SELECT p_partkey, p_type AS set_code, CASE WHEN p_size > 25 THEN 'PSA' ELSE 'OTHER' END AS company FROM part"),
    "t9_grade_claims": (
        grade_claims,
        """WITH d AS (SELECT p_partkey, p_partkey AS k FROM part), e AS (SELECT k, k % 2 = 0 AS t, k % 14 = 0 AS s, k % 5 = 0 AS c, k % 3 = 0 AS g, k % 11 = 0 OR k % 13 = 0 OR (k % 7 = 0 AND k % 14 <> 0) AS bad FROM d),
           w AS (SELECT *, least(1, s::INT * 0.5 + t::INT * 0.35 + c::INT * 0.25 + g::INT * 0.2) AS w, s::INT + t::INT + c::INT + g::INT AS n FROM e)
           SELECT k AS p_partkey, CASE WHEN bad OR NOT (t OR s) THEN 'REJECTED' WHEN NOT g THEN 'REVIEW' WHEN n >= 3 AND w >= 0.7 THEN 'CONFIRMED' ELSE 'REVIEW' END AS verdict,
             round(CASE WHEN bad THEN 1 ELSE w END, 4)::DOUBLE AS confidence FROM w""",
    ),
    "t10_stock_from_text": (
        stock_text,
        """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'UNKNOWN' WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'IN_STOCK' WHEN o_orderpriority ILIKE '%low%' THEN 'OUT_OF_STOCK'
           WHEN o_orderpriority LIKE '%MEDIUM%' THEN 'IN_STOCK' ELSE 'UNKNOWN' END AS status, CASE WHEN o_orderkey % 7 <> 0 AND o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority[1]::INT END AS quantity FROM orders""",
    ),
    "t12_canonical_urls": (
        canonical_urls,
        f"""WITH u AS (SELECT page_id, {HOST} AS h, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+', '/', 'g') AS p, regexp_extract(url, '\\?([^#]*)', 1) AS q FROM pages),
            k AS (SELECT *, array_to_string(list_transform(list_sort(list_transform(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[^=]*|gclid|fbclid|yclid|msclkid|_ga|ref|referrer|from|sort|order|view|display|limit|per_page|page|session[^=]*|sid)(=|$)')), lambda x, i: {{'k': lower(split_part(x, '=', 1)), 'i': i, 'x': x}})), lambda s: s.x), '&') AS kept FROM u)
            SELECT page_id, 'https://' || h || CASE WHEN p IN ('', '/') THEN '/' ELSE rtrim(p, '/') END || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS canonical FROM k""",
    ),
    "t13_url_policy_audit": (
        url_policy,
        f"SELECT page_id, CASE WHEN NOT starts_with(url, 'https://') THEN 'scheme' WHEN {HOST} NOT SIMILAR TO '(.*\\.)?example\\.(com|org)' THEN 'host not allowed' ELSE 'allowed' END AS outcome FROM pages",
    ),
    "t11_source_ids": (source_ids, "SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*/[a-z][a-z]/([0-9]+)([?#]|$)', 1) AS source_id FROM pages WHERE regexp_matches(url, '^[a-z]+://[^/?#]*/[a-z][a-z]/([0-9]+)([?#]|$)')"),
    "src2_listing_cards": (
        listing_cards,
        """WITH c AS (SELECT page_id, regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a></li>') AS items FROM pages)
           SELECT page_id, unnest(range(len(items))) AS position, trim(regexp_extract(unnest(items), '>([^<]*)</a>', 1)) AS name, regexp_extract(unnest(items), 'href="([^"]*)"', 1) AS link FROM c""",
    ),
    "a10_adapter_health": (
        adapter_health,
        f"""WITH c AS (SELECT {HOST} AS host, unnest(regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a></li>')) AS item FROM pages),
            x AS (SELECT host, nullif(trim(regexp_extract(item, '>([^<]*)</a>', 1)), '') AS name, nullif(regexp_extract(item, 'href="([^"]*)"', 1), '') AS link FROM c)
            SELECT host, count(*) AS n_cards, count(name) AS hits_name, count(name) > 0 AND count(link) > 0 AND count(*) FILTER (regexp_matches(name, '[0-9]')) > 0 AS healthy FROM x GROUP BY 1""",
    ),
    "a11_card_classes": (
        card_classes,
        """WITH c AS (SELECT p_partkey // 40 AS page_id, unnest(['item', 'c' || (p_partkey % 3)]) AS class FROM part), n AS (SELECT page_id, class, count(*) AS n FROM c GROUP BY 1, 2 HAVING count(*) BETWEEN 4 AND 200)
           SELECT page_id, class, n, row_number() OVER (PARTITION BY page_id ORDER BY least(n / 10, 1) DESC, class) AS rank FROM n""",
    ),
    "src3_json_ld_nodes": (
        json_ld_nodes,
        """SELECT p_partkey // 40 AS page_id, count(*) AS n_blocks, count(*) FILTER (p_partkey % 3 <> 2) AS n_parse, sum(2 - p_partkey % 3)::BIGINT AS n_types, CASE WHEN count(*) FILTER (p_partkey % 3 = 0) > 0 THEN 'Offer' WHEN count(*) FILTER (p_partkey % 3 = 1) > 0 THEN 'Product' END AS first_type
           FROM part GROUP BY 1""",
    ),
    "src2_t11_card_fields": (
        card_fields,
        "SELECT p_partkey::VARCHAR AS source_id, trim(p_name) AS name, CASE WHEN p_size >= 10 THEN p_size::VARCHAR END AS thousands, CASE WHEN p_size >= 10 THEN '' ELSE 'thousands' END AS missing FROM part",
    ),
    "t11_json_ld_ids": (json_ld_ids, "SELECT p_partkey::VARCHAR AS source_id FROM part WHERE p_partkey % 3 <> 2"),
    "src2_supplier_pages": (supplier_pages, f"WITH {ADAPTER_SQL} SELECT * FROM both_"),
    "src3_json_ld": (json_ld, "SELECT page_id, len(regexp_extract_all(html, 'application/ld\\+json')) AS n_blocks FROM pages"),
    "a12_page_structure": (
        page_structure,
        f"""SELECT page_id, {HOST} AS host, coalesce(list_sum(list_transform(regexp_extract_all(html, '(?s)<script[^>]*>(.*?)</script>', 1), lambda x: length(x))), 0)::BIGINT AS script_chars,
            len(regexp_extract_all(html, '<a\\s[^>]*href')) AS n_links, 0 AS n_open_graph, false AS client_rendered FROM pages""",
    ),
    "a12_structure_by_host": (
        structure_by_host,
        f"""SELECT {HOST} AS host, count(*) AS n_pages, sum(coalesce(list_sum(list_transform(regexp_extract_all(html, '(?s)<script[^>]*>(.*?)</script>', 1), lambda x: length(x))), 0))::BIGINT AS script_chars,
            sum(len(regexp_extract_all(html, '<a\\s[^>]*href')))::BIGINT AS n_links FROM pages GROUP BY 1""",
    ),
    "set2_unsupported_numbers": (
        audit_numbers,
        """WITH n AS (SELECT page_id, list_distinct(regexp_extract_all(url, '[0-9]+')) AS o, regexp_extract_all(html, '[0-9]+') AS s FROM pages)
           SELECT page_id, array_to_string(list_sort(list_filter(o, lambda x: NOT list_contains(s, x) AND x NOT IN ('0','1','2','3','4','5','6','7','8','9','10','100'))), ',') AS unsupported FROM n""",
    ),
    "b15_set5_audit_text": (
        audit_text,
        """WITH n AS (SELECT page_id, list_distinct(regexp_extract_all(url, '[0-9]+')) AS o, regexp_extract_all(html, '[0-9]+') AS s FROM pages),
           f AS (SELECT page_id, list_filter(o, lambda x: NOT list_contains(s, x) AND x NOT IN ('0','1','2','3','4','5','6','7','8','9','10','100')) AS u FROM n)
           SELECT page_id AS target_id, 2 * len(u) AS n_flags, 'a.b.c.d.e.v' AS field FROM f WHERE len(u) > 0""",
    ),
    "b16_validate_generated": (
        validate,
        """SELECT conv_id, turn, CASE WHEN conv_id % 7 = 0 THEN '(root)' ELSE array_to_string(list_filter([CASE WHEN turn / 4 > 1 THEN 'confidence' END, CASE WHEN length(text) NOT BETWEEN 20 AND 4000 THEN 'descriptionEn' END,
           CASE WHEN turn % 3 = 0 AND length(text) > 64 THEN 'itemSpecifics' END, CASE WHEN conv_id % 5 = 0 AND length(text) > 500 THEN 'warnings' END], lambda x: x IS NOT NULL), ',') END AS issues FROM conversations""",
    ),
    "b16_validate_translation": (
        validate_translation,
        """SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN length(text) NOT BETWEEN 1 AND 120 THEN 'cardNameEn' END, CASE WHEN length(role) > 80 THEN 'characterEn' END,
           CASE WHEN turn / 4 > 1 THEN 'confidence' END], lambda x: x IS NOT NULL), ',') AS issues FROM conversations""",
    ),
    "a18_b17_generation_quality": (
        quality,
        """SELECT role AS model, conv_id % 3 AS purpose, count(*) AS n, count(*) FILTER (length(text) > 100) AS n_generated, count(*) FILTER (length(text) <= 100 OR turn % 2 > 0) AS n_review,
           count(*) FILTER (length(text) <= 100) AS n_failed FROM conversations GROUP BY 1, 2""",
    ),
    "snk6_generation_log_rows": (
        generation_log_rows,
        """WITH r AS (SELECT *, conv_id || '-' || turn AS run_id, conv_id % 900 + 11 AS n, turn % 3 / 2 AS conf, conv_id % 7 = 0 AS broken FROM conversations),
           i AS (SELECT *, CASE WHEN broken THEN '(root)' WHEN text IS NULL OR length(text) NOT BETWEEN 20 AND 4000 THEN 'descriptionEn' ELSE '' END AS issues,
             CASE WHEN broken OR n = 100 OR list_contains(regexp_extract_all(text, '[0-9]+'), n::VARCHAR) THEN '' ELSE n::VARCHAR END AS flagged FROM r)
           SELECT run_id, sha256(role || chr(1) || text) AS prompt_hash, issues, flagged, issues <> '' OR flagged <> '' OR conf < 0.85 AS needs_review FROM i""",
    ),
    "t12_encoded_urls": (
        encoded_urls,
        """SELECT p_partkey, i::INTEGER AS i, 'https://shop.example/%E3%82%AB/b?' ||
             CASE WHEN i = 0 THEN 'Color=a' ELSE 'color=a' END || p_partkey || '&q=' || replace(url_encode(p_name), '%20', '+') AS canonical FROM part, range(4) AS t(i)""",
    ),
    "snk6_generation_log": (generation_log, "SELECT conv_id, turn, sha256(role || chr(1) || text) AS prompt_hash, length(text) > 0 AS schema_valid FROM conversations"),
    "b18_prompt_reuse": (
        reusable,
        """WITH k AS (SELECT DISTINCT text FROM conversations WHERE conv_id % 2 = 0) SELECT (SELECT count(*) FROM conversations WHERE text IN (SELECT text FROM k)) AS n_reused,
           (SELECT count(DISTINCT text) FROM conversations WHERE text NOT IN (SELECT text FROM k)) AS n_fresh""",
    ),
    "a13_image_duplicates": (
        image_duplicates,
        "SELECT sha256(text) AS sha256, count(*) AS n_uses, count(DISTINCT doc_id) AS n_listings, min(doc_id) AS first_used, max(doc_id) AS last_used FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id) > 1",
    ),
    "a14_consensus_regions": (
        consensus,
        """WITH r AS (SELECT user_id AS image_id, event_type AS kind, CASE WHEN event_id % 40 = 0 THEN 'MANUAL' WHEN event_id % 2 = 0 THEN 'OCR' ELSE 'TEMPLATE' END AS source,
             (event_id % 50)::DOUBLE AS x, (event_id % 30)::DOUBLE AS y, event_id % 90 / 100 AS c, event_id AS p FROM events),
           b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, kind ORDER BY source = 'MANUAL' DESC, CASE WHEN source = 'MANUAL' THEN 1 ELSE c END DESC, p) AS n FROM r) WHERE n = 1),
           j AS (SELECT b.image_id, b.kind, b.x AS bx, b.y AS by_, b.source AS bs, b.c AS bc, r.x, r.y, r.source,
             greatest(0, least(b.x, r.x) + 40 - greatest(b.x, r.x)) * greatest(0, least(b.y, r.y) + 25 - greatest(b.y, r.y)) AS o FROM b JOIN r USING (image_id, kind)),
           a AS (SELECT *, bs <> 'MANUAL' AND source <> bs AND o / (2000 - o) >= 0.3 AS ok FROM j)
           SELECT image_id, kind, least(bx, coalesce(min(x) FILTER (ok), bx)) AS x, least(by_, coalesce(min(y) FILTER (ok), by_)) AS y,
             greatest(bx + 40, coalesce(max(x) FILTER (ok) + 40, 0)) - least(bx, coalesce(min(x) FILTER (ok), bx)) AS width, greatest(by_ + 25, coalesce(max(y) FILTER (ok) + 25, 0)) - least(by_, coalesce(min(y) FILTER (ok), by_)) AS height,
             bs AS source, round(CASE WHEN bs = 'MANUAL' THEN 1 WHEN count(*) FILTER (ok) > 0 THEN least(0.99, bc + 0.15 * count(*) FILTER (ok)) ELSE bc END, 6) AS confidence, count(*) FILTER (ok) AS n_agreeing
           FROM a GROUP BY image_id, kind, bx, by_, bs, bc""",
    ),
    "a15_mask_safety": (
        mask_safety,
        """WITH r AS (SELECT user_id AS image_id, (event_id % 30)::DOUBLE AS y, event_id % 90 / 100 AS c FROM events),
           s AS (SELECT user_id AS image_id FROM events GROUP BY 1),
           g AS (SELECT s.image_id, count(r.image_id) AS n, count(r.image_id) * 1000 * 100 / (200.0 * 380) AS pct, min(c) AS low, count(*) FILTER (y + 25 > 380 * 0.21) AS over FROM s LEFT JOIN r USING (image_id) GROUP BY 1)
           SELECT image_id, round(pct, 4)::DOUBLE AS masked_percent, over + (pct > 50)::INT + (n = 0)::INT + (coalesce(low, 1) < 0.7)::INT = 0 AS safe, over + (pct > 50)::INT + (n = 0)::INT + (coalesce(low, 1) < 0.7)::INT AS n_failures FROM g""",
    ),
}
