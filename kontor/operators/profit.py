"""Exact profit of an offer in three scenarios, customs, bands, cost profiles, and the lowest price that meets the floors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import MONEY, PERCENT, RATE, WIDE, dec, percent, to_sale, total
from .ordered import as_of_join

#: Rules that go to every task as one array; more are joined (``bands.band_join``, ``ordered.as_of_join``).
FEW = 1000

# Scenario, adverse exchange rate %, dearer shipping %, factor of the return reserve.
SCENARIOS = (("OPTIMISTIC", "0", "0", "0.5"), ("BASE", "0", "0", "1"), ("PESSIMISTIC", "5", "15", "2"))
MODES = ("BUYER_PAID", "MARKETPLACE_COLLECTED", "SELLER_PAID", "CARRIER_QUOTE_REQUIRED", "MANUAL_REVIEW")
COSTS = (
    "purchase", "domestic_shipping", "supplier_handling", "international_shipping", "packaging", "category_fee",
    "fixed_fee", "international_fee", "ad_fee", "fx_cost", "fx_buffer", "return_reserve", "insurance", "signature",
    "duty", "import_tax", "customs_brokerage", "carrier_surcharge", "other",
)


@dataclass(frozen=True)
class Terms:
    """Fees (percent or sale currency), shipping and handling (yen), customs; the defaults are a plain profile."""

    category_fee: str = "13.25"
    fixed_fee: str = "0.40"
    international_fee: str = "1.65"
    ad_rate: str = "2"
    fx_spread: str = "1.5"
    fx_buffer: str = "3"
    return_reserve: str = "2"
    packaging: str = "250"
    other: str = "0"
    shipping: str = "3500"
    insurance: str = "0"
    signature: str = "0"
    surcharge: str = "0"
    buyer_shipping: str = "15"
    mode: str = "BUYER_PAID"
    de_minimis: str | None = None
    duty: str | None = None
    import_tax: str | None = None
    brokerage: str = "0"


def customs_cost(price: Column, terms: Terms) -> tuple[Column, Column, Column]:
    """Duty, import tax and warning (or null)."""
    zero, none = F.lit(0).cast(WIDE), F.lit(None).cast("string")
    if terms.mode != "SELLER_PAID":
        warning = {"CARRIER_QUOTE_REQUIRED": "carrier quote needed", "MANUAL_REVIEW": "manual review needed"}.get(terms.mode)
        return zero, zero, F.lit(warning).cast("string")
    if terms.duty is None and terms.import_tax is None:
        return zero, zero, F.lit("no rate configured")
    exempt = price < dec(terms.de_minimis) if terms.de_minimis is not None else F.lit(False)
    duty = F.when(exempt, zero).otherwise(percent(price, dec(terms.duty or 0, PERCENT)))
    taxed = percent((price.cast(WIDE) + duty).cast("decimal(22,6)"), dec(terms.import_tax or 0, PERCENT))
    return duty, F.when(exempt, zero).otherwise(taxed), none


def cost_columns(revenue: Column, rate: Column, shipping: Column, returns: Column, duty: Column, tax: Column, terms: Terms) -> tuple[Column, ...]:
    """The costs of a row in the sale currency, in the order of ``COSTS``; a term of zero yen needs no division."""

    def term(jpy: str) -> Column:
        return to_sale(dec(jpy), rate) if float(jpy) else F.lit(0).cast(WIDE)

    return (
        to_sale(F.col("purchase_price"), rate), to_sale(F.col("domestic_shipping_jpy"), rate), to_sale(F.col("handling_jpy"), rate),
        to_sale(shipping, rate), term(terms.packaging),
        percent(revenue, dec(terms.category_fee, PERCENT)), dec(terms.fixed_fee).cast(WIDE),
        percent(revenue, dec(terms.international_fee, PERCENT)), percent(revenue, dec(terms.ad_rate, PERCENT)),
        percent(revenue, dec(terms.fx_spread, PERCENT)), percent(revenue, dec(terms.fx_buffer, PERCENT)),
        (percent(revenue, dec(terms.return_reserve, PERCENT)).cast("decimal(28,11)") * returns).cast(WIDE),
        term(terms.insurance), term(terms.signature), duty, tax, term(terms.brokerage), term(terms.surcharge), term(terms.other),
    )


def total_cost(revenue: Column, rate: Column, shipping: Column, returns: Column, duty: Column, tax: Column, terms: Terms, fixed: Column | None = None) -> Column:
    """The sum of ``cost_columns``, to the last digit: fees that are a share of the revenue are one product, as products and
    sums are exact here, and what is nothing for these terms is not added.  ``fixed`` may hold ``fixed_cost`` already."""
    reserve = (percent(revenue, dec(terms.return_reserve, PERCENT)).cast("decimal(28,11)") * returns).cast(WIDE)
    return total([cost_without_returns(revenue, rate, shipping, duty, tax, terms, fixed), reserve])


def cost_without_returns(revenue: Column, rate: Column, shipping: Column, duty: Column, tax: Column, terms: Terms, fixed: Column | None = None) -> Column:
    """``total_cost`` before the return reserve."""
    fees = (terms.category_fee, terms.international_fee, terms.ad_rate, terms.fx_spread, terms.fx_buffer)
    shares = (Decimal(f).quantize(Decimal("0.00001"), ROUND_HALF_UP) for f in fees)
    parts = [fixed_cost(rate, shipping, terms) if fixed is None else fixed, percent(revenue, dec(str(sum(shares)), PERCENT))]
    return total([*parts, *((duty, tax) if terms.mode == "SELLER_PAID" else ())])


def fixed_cost(rate: Column, shipping: Column, terms: Terms) -> Column:
    """The costs that do not depend on the selling price."""
    yen = [terms.packaging, terms.insurance, terms.signature, terms.brokerage, terms.surcharge, terms.other]
    paid = [F.col("purchase_price"), F.col("domestic_shipping_jpy"), F.col("handling_jpy"), shipping, *(dec(v) for v in yen if float(v))]
    return total([dec(terms.fixed_fee).cast(WIDE), *(to_sale(v, rate) for v in paid)])


def profit_scenarios(offers: DataFrame, terms: Terms = Terms(), only: tuple[str, ...] = ()) -> DataFrame:
    """One row for each offer and scenario: costs, profit in both currencies, margin, warnings.

    Columns read: purchase_price, domestic_shipping_jpy, handling_jpy (yen), selling_price (sale currency), fx_rate.
    """
    names = [c for c in SCENARIOS if not only or c[0] in only]
    cases: dict[tuple[str, str], list[Column]] = {}
    for name, adverse, dearer, returns in names or SCENARIOS:
        case = F.struct(F.lit(name).alias("scenario"), dec(returns, "decimal(4,2)").alias("returns"))
        cases.setdefault((adverse, dearer), []).append(case)
    # what scenarios of one rate and one shipping cost have in common is worked out once, then their rows are made
    rates = [F.struct(dec(a, PERCENT).alias("adverse"), dec(d, PERCENT).alias("dearer"), F.array(*own).alias("cases")) for (a, d), own in cases.items()]
    df = offers.where(F.lit(bool(names))).withColumn("_rates", F.explode(F.array(*rates)))
    fx, shipping = F.col("fx_rate").cast(RATE), dec(terms.shipping)
    cent = F.lit("0.01").cast("decimal(3,2)")
    price = F.col("selling_price").cast(MONEY)
    df = df.withColumns({
        "rate": (fx - fx * F.col("_rates.adverse") * cent).cast(RATE),
        "revenue": (price + dec(terms.buyer_shipping)).cast("decimal(22,6)"),
        "_shipping": (shipping + shipping * F.col("_rates.dearer") * cent).cast(MONEY),
    })
    revenue, rate, shipping = F.col("revenue"), F.col("rate"), F.col("_shipping")
    duty, tax, warning = customs_cost(price, terms)
    costs = dict(zip((f"cost_{n}" for n in COSTS), cost_columns(revenue, rate, shipping, dec("1", "decimal(4,2)"), duty, tax, terms), strict=True))
    df = df.withColumns(costs | {"_most": cost_without_returns(revenue, rate, shipping, duty, tax, terms)})
    df = df.withColumn("_case", F.explode("_rates.cases")).withColumn("scenario", F.col("_case.scenario"))
    df = df.withColumn("cost_return_reserve", (F.col("cost_return_reserve").cast("decimal(28,11)") * F.col("_case.returns")).cast(WIDE))
    df = df.withColumn("total_cost", total([F.col("_most"), F.col("cost_return_reserve")]))
    df = df.withColumn("profit", (revenue.cast(WIDE) - F.col("total_cost")).cast(WIDE))
    df = df.withColumn("profit_jpy", (F.col("profit").cast("decimal(24,11)") * rate.cast("decimal(14,7)")).cast(WIDE))
    margin = F.try_divide(F.col("profit") * 100, revenue)
    df = df.withColumn("margin_percent", F.coalesce(F.round(margin, 4), F.lit(0)).cast("decimal(12,4)"))
    none = F.array().cast("array<string>")
    # pieces joined, not an array filtered: a lambda would have all below it, the costs too, interpreted instead of compiled
    warnings = F.concat(*(F.when(when, F.array(text)).otherwise(none) for when, text in (
        (price <= 0, F.lit("selling price is zero or negative")),
        (F.col("purchase_price") == 0, F.lit("purchase price is zero")),
        (warning.isNotNull(), warning),
        (F.col("profit") < 0, F.concat(F.col("scenario"), F.lit(" scenario is loss-making"))),
    )))
    results = ("total_cost", "profit", "profit_jpy", "margin_percent")
    return df.select(*offers.columns, "scenario", "rate", "revenue", *costs, *results, warnings.alias("warnings"))


def in_band(value: Column, low: Column, high: Column) -> Column:
    """Half open; an absent end is no limit."""
    return (value >= low) & (high.isNull() | (value < high))


def best_band(facts: DataFrame, bands: DataFrame, matches: Callable[[Column], Column], order: list[Column]) -> DataFrame:
    """Adds the columns of the first band in ``order`` (ascending) that ``matches``; facts without one stay, with nulls.

    ``bands`` is a rule table of ``FEW`` rows at most (callers count it): sorted into one array it goes to every task, and
    each fact takes its first match there, so facts are neither multiplied nor shuffled.
    """
    ranked = bands.select(F.struct(*(o.alias(f"k{i}") for i, o in enumerate(order))).alias("rank"), F.struct(*bands.columns).alias("band"))
    table = ranked.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "band"))), lambda x: x["band"]).alias("_bands"))  # one row
    found = facts.crossJoin(F.broadcast(table)).withColumn("_band", F.get(F.filter("_bands", matches), F.lit(0)))
    return found.select(*facts.columns, "_band.*")


def profile_as_of(facts: DataFrame, profiles: DataFrame, at: str) -> DataFrame:
    """The active profile with the latest ``effective_from`` that is not after ``at``."""
    active = profiles.where("is_active")
    if active.limit(FEW + 1).count() > FEW:
        return as_of_join(facts, active, [], at, "effective_from", [F.col("profile_id")])
    return best_band(facts, active, lambda p: p["effective_from"] <= F.col(at), [-F.unix_micros("effective_from"), F.col("profile_id")])


def price_floor(
    offers: DataFrame, terms: Terms = Terms(), min_profit_jpy: str = "1500", min_margin: str = "15", max_price: str = "100000",
    scenario: str = "PESSIMISTIC",
) -> DataFrame:
    """The lowest price, to the cent, that meets both floors; null and the binding constraint where none does.

    Profit is linear in the price below and from the customs exemption on, so each segment has a closed form: profit
    at two prices gives slope and constant.  The cent-rounded answer is verified with the exact decimals.  All of it
    is arithmetic within a row.
    """
    _, adverse, dearer, returned = next(s for s in SCENARIOS if s[0] == scenario)
    cent = F.lit("0.01").cast("decimal(3,2)")
    fx = F.col("fx_rate").cast(RATE)
    shipping = dec(terms.shipping)
    shipping = (shipping + shipping * dec(dearer, PERCENT) * cent).cast(MONEY)
    rate = F.col("_rate")

    def gain(price: Column, own: Terms) -> tuple[Column, Column]:
        """Profit and revenue at a price."""
        revenue = (price + dec(own.buyer_shipping)).cast("decimal(22,6)")
        duty, tax, _ = customs_cost(price, own)
        cost = total_cost(revenue, rate, shipping, dec(returned, "decimal(4,2)"), duty, tax, own, F.col("_fixed"))
        return (revenue.cast(WIDE) - cost).cast(WIDE), revenue

    edge, upper = terms.de_minimis if terms.mode == "SELLER_PAID" else None, float(max_price)
    segments = [(None, 0.01, upper)] if edge is None else [(max_price, 0.01, float(edge) - 0.01), (None, float(edge), upper)]
    df = offers.drop("selling_price").withColumn("_rate", (fx - fx * dec(adverse, PERCENT) * cent).cast(RATE))
    df = df.withColumn("_fixed", fixed_cost(rate, shipping, terms))
    for i, (exempt, _, _) in enumerate(segments):
        own = replace(terms, de_minimis=exempt)
        df = df.withColumns({f"_base{i}": gain(dec(0), own)[0], f"_far{i}": gain(dec(1000), own)[0]})
    found, binding = [], []
    floor, share, buyer = float(min_profit_jpy), float(min_margin) / 100, float(terms.buyer_shipping)
    for i, (_, low, high) in enumerate(segments):
        base = F.col(f"_base{i}").cast("double")
        slope = (F.col(f"_far{i}") - F.col(f"_base{i}")).cast("double") / 1000
        by_profit = (floor / rate.cast("double") - base) / slope
        by_margin = F.when(slope - share > 0, (share * buyer - base) / (slope - share))
        need = F.when((slope > 0) & by_margin.isNotNull(), F.greatest(by_profit, by_margin, F.lit(low)))
        cents = F.ceil(F.round(need * 100, 6)) / 100
        found.append(F.when((cents <= high) & (cents > 0), cents))
        binding.append(F.when(by_margin.isNull() | (by_margin > by_profit), F.lit("MARGIN_FLOOR")).otherwise("PROFIT_FLOOR"))
    df = df.withColumns({f"_found{i}": f for i, f in enumerate(found)})
    bound = binding[-1]
    if len(found) == 2:
        bound = F.when(F.col("_found0") <= F.coalesce("_found1", F.lit(upper)), binding[0]).otherwise(binding[1])
    best = F.least("_found0", "_found1") if len(found) == 2 else F.col("_found0")
    df = df.withColumns({"minimum_price": best.cast(MONEY), "binding": bound})
    profit, revenue = gain(F.col("minimum_price"), terms)
    df = df.withColumns({"_profit": profit, "_revenue": revenue})
    in_jpy = (F.col("_profit").cast("decimal(24,11)") * rate.cast("decimal(14,7)")).cast(WIDE)
    margin = F.round(F.try_divide(F.col("_profit") * 100, F.col("_revenue")), 4)
    met = (in_jpy >= dec(min_profit_jpy)) & (F.coalesce(margin, F.lit(0)) >= dec(min_margin))
    keep = [c for c in offers.columns if c != "selling_price"]
    return df.select(*keep, "minimum_price", "binding", F.when(F.col("minimum_price").isNotNull(), met).alias("verified"))


def profit_snapshots(results: DataFrame, terms: Terms, key: list[str]) -> DataFrame:
    """Append-ready rows: inputs, costs, result and the terms of the calculation as JSON."""
    settings = F.to_json(F.struct(*(F.lit(v).cast("string").alias(k) for k, v in terms.__dict__.items())))
    costs = F.to_json(F.struct(*(F.col(f"cost_{n}").alias(n) for n in COSTS)))
    return results.select(
        *key, "scenario", costs.alias("costs"), settings.alias("settings"), "profit", "profit_jpy", "margin_percent", "warnings"
    )
