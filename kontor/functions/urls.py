"""Column expressions for URLs: one spelling for each page, and a policy on which may be fetched."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that do not name a page.
TRACKING = r"(?i)^(utm_.*|gclid|fbclid|yclid|msclkid|_ga|ref|referrer|from|sort|order|view|display|limit|per_page|page|session.*|sid)$"
URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@]*)@)?(\[[^\]]*\]|[^/?#:\[]*)(?::([0-9]*))?((?:/[^?#]*)?)(?:\?([^#]*))?(?:#.*)?$"


def part(url: Column, number: int) -> Column:
    return F.regexp_extract(url, URL, number)


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def without_dots(path: Column) -> Column:
    """The path with ``.`` and ``..`` segments resolved."""
    none = F.array().cast("array<string>")
    end = F.element_at(F.split(path, "/"), -1).isin(".", "..")
    left = F.aggregate(
        F.split(F.substring(path, F.lit(2), F.length(path)), "/"), none,
        lambda a, s: F.when(s == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).when(s == ".", a).otherwise(F.concat(a, F.array(s))),
    )
    return F.when(path == "", path).otherwise(F.concat(F.lit("/"), F.array_join(left, "/"), F.when(end, "/").otherwise("")))


#: Characters that a path holds only percent-encoded; what is encoded already stays as it is.
UNSAFE = r"[\x00-\x20\x22\x3C\x3E\x60\x7B\x7D\x7F]|[^\x00-\x7F]"


def encoded_path(path: Column) -> Column:
    each = F.transform(
        F.regexp_extract_all(path, F.lit("(?s)(.)"), F.lit(1)),
        lambda c: F.when(c.rlike(UNSAFE), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))).otherwise(c),
    )
    return F.when(path.rlike(UNSAFE), F.array_join(each, "")).otherwise(path)


def decoded(word: Column) -> Column:
    """A name or value of a query as text: ``+`` is a blank; a stray percent sign stays."""
    stray = F.regexp_replace(word, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.try_url_decode(stray)


def canonical(url: Column, force_host: str | None = None, keep: tuple[str, ...] = (), keep_slash: bool = False) -> Column:
    """One spelling for each page: https, lower host, no port or fragment, no tracking parameters, parameters in order of
    their names, one percent-encoding, no dot segments, single slashes, none at the end unless ``keep_slash``."""
    host = F.lit(force_host.lower()) if force_host else F.lower(part(url, 3))
    path = once(once(part(url, 5), without_dots), encoded_path)
    path = once(F.regexp_replace(path, "/{2,}", "/"), lambda p: F.when(p.isin("", "/"), F.lit("/")).otherwise(p if keep_slash else F.regexp_replace(p, "/$", "")))
    pairs = F.transform(
        F.filter(F.split(part(url, 6), "&"), lambda p: p != ""),
        lambda p, i: F.struct(
            decoded(F.split_part(p, F.lit("="), F.lit(1))).alias("name"),
            decoded(F.when(p.contains("="), F.substring(p, F.locate("=", p) + 1, F.length(p))).otherwise("")).alias("value"), i.alias("i"),
        ),
    )
    kept = F.filter(pairs, lambda p: ~p["name"].rlike(TRACKING) | F.lower(p["name"]).isin(*(k.lower() for k in keep)))
    # by name without regard to case, small letters before capitals, else in the given order
    placed = F.transform(
        kept,
        lambda p: F.struct(
            F.lower(p["name"]).alias("k"), F.translate(p["name"], LETTERS + LETTERS.lower(), LETTERS.lower() + LETTERS).alias("c"), p["i"].alias("i"),
            F.concat(F.url_encode(p["name"]), F.lit("="), F.url_encode(p["value"])).alias("p"),
        ),
    )
    query = F.array_join(F.transform(F.array_sort(placed), lambda s: s["p"]), "&")
    query = once(query, lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
    built = F.concat(F.lit("https://"), host, path, query)
    return F.when(url.rlike(URL), built)


def refusal(url: Column, allowed: tuple[str, ...], insecure: bool = False) -> Column:
    """Why a URL may not be fetched, or null."""
    scheme, user, host = F.lower(part(url, 1)), part(url, 2), F.lower(part(url, 3))
    octets = F.transform(F.split(host, r"\."), lambda o: o.try_cast("int"))
    a, b = F.get(octets, F.lit(0)), F.get(octets, F.lit(1))
    numeric = host.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    private = (
        (host == "localhost")
        | host.rlike(r"\.(localhost|local)$")
        | host.rlike(r"^\[?(::1?\]?$|fe80:|fc|fd)")
        | (
            numeric
            & (
                F.exists(octets, lambda o: o > 255)
                | a.isin(0, 10, 127)
                | ((a == 172) & b.between(16, 31))
                | ((a == 192) & (b == 168))
                | ((a == 169) & (b == 254))
                | ((a == 100) & b.between(64, 127))
                | (a >= 224)
            )
        )
    )
    fits = F.lit(False)
    for name in allowed:
        fits = fits | (host == name.lower()) | host.endswith("." + name.lower())
    return (
        F.when(url.isNull() | ~url.rlike(URL), F.lit("not an absolute url"))
        .when((scheme != "https") & ~(F.lit(insecure) & (scheme == "http")), F.lit("scheme"))
        .when(user != "", F.lit("credentials"))
        .when(private, F.lit("private host"))
        .when(~fits, F.lit("host not allowed"))
    )
