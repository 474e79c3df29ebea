"""Listing cards, structured data and structure reports from saved HTML pages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import price
from ..functions.urls import part

PRICE = re.compile(r"[¥￥]\s*[0-9]|[0-9]\s*円", re.ASCII)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


@dataclass(frozen=True)
class Selector:
    """An element and what is read from it: its text, or an attribute, or the first group of a pattern in either.

    An element is named by tag and class, or by ``css``: steps of tag, ``#id``, ``.class`` and ``[attribute=value]``,
    where a blank stands for any depth and ``>`` for a child.  A card that lacks a ``required`` field is a failure.
    """

    tag: str | None = None
    cls: str | None = None
    attribute: str | None = None
    css: str | None = None
    regex: str | None = None
    required: bool = False


@dataclass(frozen=True)
class CardConfig:
    """How a supplier's cards look."""

    card: Selector
    fields: dict[str, Selector] = field(default_factory=dict)


class _Tree(HTMLParser):
    """Elements in order: tag, classes, attributes, parent, text (of the element and all below it), number of the element after its subtree."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[int] = []
        self.feed(html)
        self.close()
        self._ended(0)

    def _ended(self, depth: int) -> None:
        for i in self.open[depth:]:
            self.rows[i][5] = len(self.rows)
        del self.open[depth:]

    def handle_starttag(self, tag, attrs):
        given = {k: v or "" for k, v in attrs}
        self.rows.append([tag, given.get("class", "").split(), given, self.open[-1] if self.open else -1, [], len(self.rows) + 1])
        if tag not in VOID:
            self.open.append(len(self.rows) - 1)

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.rows[self.open[depth]][0] == tag:
                self._ended(depth)
                return

    def handle_data(self, data):
        if self.open and self.rows[self.open[-1]][0] in ("script", "style"):
            return
        for i in self.open:
            self.rows[i][4].append(data)


STEP = re.compile(r"([a-zA-Z][\w-]*|\*)|#([\w-]+)|\.([\w-]+)|\[([\w-]+)(?:=[\"']?([^\"'\]]*)[\"']?)?\]")


def _steps(s: Selector) -> list[tuple[bool, str | None, list[str], dict[str, str | None]]]:
    """(child of the step before, tag, classes, attributes), outermost first."""
    if s.css is None:
        return [(False, s.tag, [s.cls] if s.cls else [], {})]
    out, child = [], False
    for word in re.sub(r"\s*>\s*", " > ", s.css).split():
        if word == ">":
            child = True
            continue
        tag, classes, given, at = None, [], {}, 0
        while at < len(word):
            m = STEP.match(word, at)
            if m is None:
                raise ValueError(f"unknown selector {s.css!r}")
            at = m.end()
            if m[1]:
                tag = None if m[1] == "*" else m[1].lower()
            elif m[2]:
                given["id"] = m[2]
            elif m[3]:
                classes.append(m[3])
            else:
                given[m[4]] = m[5]
        out.append((child, tag, classes, given))
        child = False
    return out


def _fits(rows: list[list], i: int, steps: list, top: int = -1) -> bool:
    """Whether element ``i`` is what the steps name; ancestors are looked for below ``top``."""
    child, tag, classes, given = steps[-1]
    row = rows[i]
    if tag is not None and row[0] != tag or not all(c in row[1] for c in classes):
        return False
    if not all(k in row[2] and v in (None, row[2][k]) for k, v in given.items()):
        return False
    if len(steps) == 1:
        return True
    up = row[3]
    while up > top:
        if _fits(rows, up, steps[:-1], top):
            return True
        if child:
            return False
        up = rows[up][3]
    return False


def _read(row: list, s: Selector) -> str | None:
    value = row[2].get(s.attribute) if s.attribute else " ".join("".join(row[4]).split()) or None
    if value is None or s.regex is None:
        return value
    found = re.search(s.regex, value)
    return found[1] if found else None


def found_cards(html: str | None, card: list, fields: list[tuple[str, Selector, list]]) -> Iterator[tuple[list[str | None], list[str]]]:
    """(values of the fields, names of the required ones that it lacks) of each card of a page."""
    rows = _Tree(html or "").rows
    for i in range(len(rows)):
        if _fits(rows, i, card):
            values = [next((v for j in range(i, rows[i][5]) if _fits(rows, j, steps, i - 1) and (v := _read(rows[j], s))), None) for _, s, steps in fields]
            yield values, [n for (n, s, _), v in zip(fields, values, strict=True) if s.required and v is None]


#: Rows of cards or elements that a task holds at a time; a batch of pages has any number of them.
HELD = 4096


def _handed(rows: Iterator[list], columns: list[str]) -> Iterator[pd.DataFrame]:
    while some := list(islice(rows, HELD)):
        yield pd.DataFrame(some, columns=columns)


def extract_listing_cards(pages: DataFrame, config: CardConfig) -> DataFrame:
    """One row per card of each page (page_id, url, html): page_id, position, the configured fields, the required ones that it lacks, price as a decimal."""
    names = list(config.fields)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        card, fields = _steps(config.card), [(n, s, _steps(s)) for n, s in config.fields.items()]
        found = (
            [page, url, position, *values, lacks]
            for frame in frames for page, url, html in zip(frame["page_id"], frame["url"], frame["html"], strict=True)
            for position, (values, lacks) in enumerate(found_cards(html, card, fields))
        )
        yield from _handed(found, ["page_id", "url", "position", *names, "missing_required"])

    schema = "page_id long, url string, position int, " + ", ".join(f"{n} string" for n in names) + ", missing_required array<string>"
    cards = pages.select("page_id", "url", "html").mapInPandas(run, schema)
    return cards.withColumn("price_value", price(F.col("price"))) if "price" in names else cards


def page_elements(pages: DataFrame) -> DataFrame:
    """One row per element: page_id, tag, classes, whether its text holds a price, whether it or something below is a link."""

    def elements(page: int, html: str | None) -> Iterator[list]:
        rows = _Tree(html or "").rows
        link = [r[0] == "a" and "href" in r[2] for r in rows]
        for i in range(len(rows) - 1, -1, -1):
            if link[i] and rows[i][3] >= 0:
                link[rows[i][3]] = True
        return ([page, r[0], r[1], link[i], PRICE.search("".join(r[4])) is not None] for i, r in enumerate(rows))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = (e for frame in frames for page, html in zip(frame["page_id"], frame["html"], strict=True) for e in elements(page, html))
        yield from _handed(found, ["page_id", "tag", "classes", "has_link", "has_price"])

    schema = "page_id long, tag string, classes array<string>, has_link boolean, has_price boolean"
    return pages.select("page_id", "html").mapInPandas(run, schema)


def discover_card_classes(pages: DataFrame, least: int = 4, most: int = 200, top: int = 8) -> DataFrame:
    """Classes that look like listing cards: frequent on a page, with prices and links."""
    rows = page_elements(pages).select("page_id", F.explode("classes").alias("class"), "has_price", "has_link")
    sums = rows.groupBy("page_id", "class").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("has_price").cast("int")).alias("price_share"), F.avg(F.col("has_link").cast("int")).alias("link_share")
    )
    scored = sums.where(F.col("n").between(least, most)).withColumn(
        "score", F.col("price_share") * F.col("link_share") * F.least(F.col("n") / 10, F.lit(1.0))
    )
    order = Window.partitionBy("page_id").orderBy(F.desc("score"), "class")
    return scored.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


LD = r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"


def extract_json_ld(pages: DataFrame) -> DataFrame:
    """One row per structured-data block: page_id, position, types of all its nodes (of an array, or of ``@graph``), the first of them, whether it parses."""
    blocks = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(LD), F.lit(1))).alias("position", "block"))
    blocks = blocks.where(F.trim("block") != "").withColumn("value", F.try_parse_json("block"))
    none = F.array().cast("array<variant>")
    inner = lambda path: F.coalesce(F.try_variant_get("value", path, "array<variant>"), none)
    own = F.when(F.schema_of_variant("value").rlike("^OBJECT"), F.array("value")).otherwise(none)
    kinds = F.transform(F.concat(own, inner("$"), inner("$['@graph']")), lambda n: F.try_variant_get(n, "$['@type']", "string"))
    types = F.filter(kinds, lambda k: k.isNotNull())
    return blocks.select("page_id", "position", types.alias("types"), F.get(types, F.lit(0)).alias("type"), F.col("value").isNotNull().alias("parses"), "block")


def source_ids(df: DataFrame, strategies: list[tuple[str, str]], url: str = "url", json: str = "block") -> DataFrame:
    """Adds source_id by ordered strategies; rows without one are dropped.

    ("path", regex) and ("query", name) read the URL, ("attribute", column) a field that was read from an attribute,
    ("column", name) any column, ("json_ld", path) the structured-data block in the column ``json``.
    """
    found: list[Column] = []
    for kind, what in strategies:
        if kind == "path":
            value = F.regexp_extract(part(F.col(url), 5), what, 1)
        elif kind == "query":
            value = F.regexp_extract(part(F.col(url), 6), f"(?:^|&){what}=([^&]*)", 1)
        elif kind in ("column", "attribute"):
            value = F.col(what).cast("string")
        elif kind == "json_ld":
            value = F.try_variant_get(F.try_parse_json(json), what if what.startswith("$") else f"$.{what}", "string")
        else:
            raise ValueError(f"unknown strategy {kind}")
        found.append(F.nullif(value, F.lit("")))
    return df.withColumn("source_id", F.coalesce(*found)).where("source_id is not null")


def page_structure(pages: DataFrame) -> DataFrame:
    """Per page: visible size, script bytes, client rendering, metadata, pagination and stock words."""
    html = F.col("html")
    scripts = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*>(.*?)</script>"), F.lit(1))
    shown = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", ""), r"(?s)<[^>]*>", " ")
    count = lambda p: F.regexp_count(html, F.lit(p))
    df = pages.select(
        "page_id", F.lower(part(F.col("url"), 3)).alias("host"),
        F.length(F.trim(F.regexp_replace(shown, r"\s+", " "))).alias("visible_chars"),
        F.aggregate(F.transform(scripts, F.length), F.lit(0), lambda a, b: a + b).alias("script_chars"),
        count(r"(?i)<a\s[^>]*href").alias("n_links"), count(r"(?i)\sitemprop=").alias("n_microdata"),
        count(r"(?i)property=[\"']og:").alias("n_open_graph"), count(r"(?i)[?&](page|p)=[0-9]+").alias("n_page_links"),
        html.rlike(r"(?i)id=[\"'](root|app|__next|__nuxt)[\"']").alias("has_app_root"),
        html.rlike("在庫|売り切れ|(?i)sold ?out|in stock").alias("has_stock_words"),
    )
    return df.withColumn("client_rendered", (F.col("visible_chars") < 500) & F.col("has_app_root"))


def structure_by_host(profile: DataFrame) -> DataFrame:
    return profile.groupBy("host").agg(
        F.count(F.lit(1)).alias("n_pages"), F.count_if("client_rendered").alias("n_client_rendered"),
        F.sum("script_chars").alias("script_chars"), F.sum("n_links").alias("n_links"), F.sum("n_page_links").alias("n_page_links"),
    )


def adapter_health(cards: DataFrame, by: str, fields: list[str]) -> DataFrame:
    """Hits of each selector; unhealthy with the names of those that hit nothing."""
    hits = cards.groupBy(by).agg(F.count(F.lit(1)).alias("n_cards"), *(F.count(f).alias(f"hits_{f}") for f in fields))
    missing = F.filter(F.array(*(F.when(F.col(f"hits_{f}") == 0, F.lit(f)) for f in fields)), lambda x: x.isNotNull())
    return hits.withColumn("missing", missing).withColumn("healthy", (F.size("missing") == 0) & (F.col("n_cards") > 0))
