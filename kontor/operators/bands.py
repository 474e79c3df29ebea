"""Rules that hold in a band of a value, for tables of rules of any size."""

from __future__ import annotations

from collections.abc import Sequence
from math import prod

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DecimalType, DoubleType, IntegralType

from ..sources.checkpoints import settled
from .ordered import PART, dealt
from .profit import FEW, best_band, in_band

#: Bits between the least and the greatest whole number that are places themselves; distinct values that are given a code.
DEPTH, CODED = 32, 128
#: Whole numbers below the first are told apart by a double, below the second fit in a long.
FIELD, WHOLE = 1 << 53, 1 << 62


def band_join(
    facts: DataFrame, bands: DataFrame, key: Sequence[str], value: str, low: str, high: str, equal: dict[str, str] | None = None,
    order: Sequence[Column] = (), few: int = FEW,
) -> DataFrame:
    """Each fact with the first rule, in ``order``, whose band [low, high) holds its value; facts without one have nulls.

    ``key`` names the columns that tell facts apart.  ``equal`` maps columns of the facts to columns of the rules that must
    agree, where a null in the rule stands for any.  An absent high is no limit; a rule without a low holds nothing.

    Up to ``few`` rules, after a count, are one sorted array in every task.  More are laid over places: of whole numbers as
    bounds (``DEPTH`` bits at most apart) the numbers themselves, else those of the facts' distinct values in their order.  A
    rule over [i, j) is held by a few nodes of a binary tree, each node keeps its first rule, and a place asks the nodes
    above it.  So the work grows with facts and rules and not with what they have in common, however many rules overlap;
    sides grow before they meet, so none of them is broadcast.  Where an order is of whole numbers it is one number, so that
    nodes keep their first rule in a hash table, before anything is shuffled and without a sort.
    """
    equal = equal or {}
    if bands.limit(few + 1).count() <= few:
        def matches(b: Column) -> Column:
            out = in_band(F.col(value), b[low], b[high])
            for f, c in equal.items():
                out = out & (b[c].isNull() | (b[c] == F.col(f)))
            return out

        return best_band(facts, bands, matches, list(order))

    rules = bands.where(F.col(low).isNotNull() & (F.col(high).isNull() | (F.col(high) > F.col(low))))
    named, kept = [f"_e{i}" for i in range(len(equal))], [f"_b{i}" for i in range(len(bands.columns))]
    asked = _asked([F.col(c).isNotNull() for c in equal.values()])
    whole = all(isinstance(f.dataType, IntegralType | BooleanType) for f in rules.select(*order).schema)
    spans = [f(o.cast("long")) for o in order for f in (F.min, F.max)] if whole else []
    # two for each column of ``equal`` at most, multiplied
    asks, first, last, past, *spans = rules.agg(F.collect_set(asked), F.min(low), F.max(low), F.max(high), *spans).first()
    given = _bounds([facts.schema[value].dataType, rules.schema[low].dataType, rules.schema[high].dataType], first, last, past)
    rank = _rank(rules, order, list(zip(spans[::2], spans[1::2], strict=True)))
    rules = rules.select(F.col(low).alias("_low"), F.col(high).alias("_high"), *(F.col(c).alias(n) for n, c in zip(named, equal.values(), strict=True)), asked.alias("_asks"), rank.alias("_rank"), *(F.col(c).alias(n) for c, n in zip(bands.columns, kept, strict=True)))
    firsts = [F.min("_rank").alias("_rank"), *(F.min_by(n, "_rank").alias(n) for n in kept)]  # of one rule, also where ranks are equal

    def own(place: Column) -> DataFrame:
        return facts.select(place.alias("_v"), *(F.col(f).alias(n) for n, f in zip(named, equal, strict=True))).where("_v is not null").distinct()

    if given is not None:
        start, end = given
        v, mine = F.col(value), F.col(value).cast("long") if isinstance(facts.schema[value].dataType, IntegralType) else F.floor(value).cast("long")
        at = F.when(v >= end, F.lit(end - start)).when(v >= start, mine - start)  # what is past all bounds is in rules without an end
        tasks = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        depth, met = (end - start).bit_length(), own(at).repartition(tasks, "_v").withColumn("_place", F.col("_v"))  # each grows
        laid = rules.withColumns({"_from": F.col("_low").cast("long") - start, "_to": F.coalesce(F.col("_high").cast("long"), F.lit(end + 1)) - start})
    else:
        # of rules of one band that ask for the same, only the first counts
        rules = settled(rules.groupBy("_low", "_high", *named, "_asks").agg(*firsts))
        at, values = F.col(value), settled(own(F.col(value)))
        places, count = _places(values.select("_v"), rules.select("_low").unionAll(rules.select("_high").where("_high is not null")))
        depth, met = max(count - 1, 1).bit_length(), values.hint("merge").join(places, "_v")
        start, end = (places.select(F.col("_v").alias(f"_{n}"), F.col("_place").alias(f"_{n}_at")) for n in ("low", "high"))
        laid = rules.hint("merge").join(start, "_low").withColumnRenamed("_low_at", "_from")
        ended = laid.where("_high is not null").hint("merge").join(end, "_high").withColumnRenamed("_high_at", "_to")
        laid = ended.unionByName(laid.where("_high is null").withColumn("_to", F.lit(count).cast("long")))
    nodes = _covers(laid.where("_from < _to"), depth, [*named, "_asks", "_rank", *kept]).groupBy("_node", "_asks", *named).agg(*firsts)

    met = met.withColumn("_asks", F.explode(F.array(*(F.lit(a) for a in asks)).cast("array<int>"))).withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    met = met.withColumn("_node", F.call_function("shiftright", F.lit(1 << depth).cast("long") + F.col("_place"), F.col("_level"))).drop("_level")
    for i, n in enumerate(named):
        met = met.withColumn(f"_j{i}", F.when(F.col("_asks").bitwiseAND(F.lit(1 << i)) != 0, F.col(n)))
    theirs = nodes.withColumnsRenamed({n: f"_j{i}" for i, n in enumerate(named)}).withColumnsRenamed({"_node": "_at", "_asks": "_of"})
    on = [met["_node"] == theirs["_at"], met["_asks"] == theirs["_of"], *(met[f"_j{i}"].eqNullSafe(theirs[f"_j{i}"]) for i in range(len(named)))]
    best = met.hint("merge").join(theirs, on).groupBy("_v", *named).agg(*firsts[1:])
    same = [F.col(f).eqNullSafe(F.col(n)) for n, f in zip(named, equal, strict=True)]
    joined = facts.withColumn("_at", at).hint("merge").join(best, [F.col("_at") == F.col("_v"), *same], "left")
    return joined.select(*facts.columns, *(F.col(n).alias(c) for n, c in zip(kept, bands.columns, strict=True)))


def _bounds(types: Sequence[DataType], first: object, last: object, past: object) -> tuple[int, int] | None:
    """The least and the greatest bound, where all are whole numbers so near to each other that each may be a place; ``types``
    are those of the value, the low and the high."""
    value, *bounds = types
    if first is None or not isinstance(value, IntegralType | DecimalType | DoubleType) or not all(isinstance(t, IntegralType) for t in bounds):
        return None
    end = last if past is None else max(last, past)
    near = (end - first).bit_length() <= DEPTH and -FIELD < first and end < FIELD
    return (first, end) if near else None


def _rank(rules: DataFrame, order: Sequence[Column], spans: Sequence[tuple[int | None, int | None]]) -> Column:
    """What is least for the rule that is first in ``order``: a whole number if each of it is one, ``spans`` has the least and
    the greatest of each, and all fit in; else a struct.  Of few distinct values, far apart, each takes one number."""
    spans = [(0 if least is None else least, 0 if top is None else top) for least, top in spans]
    sizes = [top - least + 2 for least, top in spans]  # nulls are first
    codes = [F.coalesce(o.cast("long") - least + 1, F.lit(0)) for o, (least, _) in zip(order, spans)]  # noqa: B905  none, if not whole
    for i in sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True):
        if prod(sizes) >= WHOLE:
            keys = rules.select(order[i].cast("long").alias("o")).where("o is not null").distinct()
            seen = sorted(r[0] for r in keys.limit(CODED + 1).collect())
            if 0 < len(seen) <= CODED:
                code = F.create_map(*(F.lit(x).cast("long") for n, v in enumerate(seen, 1) for x in (v, n)))
                sizes[i], codes[i] = len(seen) + 1, F.coalesce(code[order[i].cast("long")], F.lit(0))
    if not sizes or prod(sizes) >= WHOLE:
        return F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), F.lit(0).alias("o"))
    out = F.lit(0).cast("long")
    for size, code in zip(sizes, codes, strict=True):
        out = out * size + code
    return out


def _asked(tests: Sequence[Column]) -> Column:
    """Which of the columns a rule names, as bits."""
    return sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0)).cast("int")


def _places(values: DataFrame, bounds: DataFrame) -> tuple[DataFrame, int]:
    """(each value and bound with the number of distinct values below it, how many there are)."""
    both = values.withColumn("_own", F.lit(1)).unionAll(bounds.withColumn("_own", F.lit(0)))  # in one type, as in a comparison
    rows = dealt(both.groupBy("_v").agg(F.max("_own").alias("_own")), [], [F.col("_v").asc()])
    sizes = rows.groupBy(PART).agg(F.sum("_own").alias("n")).orderBy(PART).collect()  # a row for each range
    ahead, total = [], 0
    for r in sizes:
        ahead.append((r[PART], total))
        total += r["n"]
    before = F.broadcast(rows.sparkSession.createDataFrame(ahead, f"{PART} int, _ahead long"))
    below = F.coalesce(F.sum("_own").over(Window.partitionBy(PART).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_place", below).join(before, PART).select("_v", (F.col("_place") + F.col("_ahead")).alias("_place")), total


def _covers(rules: DataFrame, depth: int, kept: Sequence[str]) -> DataFrame:
    """``kept`` for each node of a binary tree of ``depth`` levels that holds a part of [_from, _to) and nothing else, two of each level at most."""
    start, end, i = F.col("_from"), F.col("_to"), F.col("_i")
    widest = F.least(F.lit(depth), F.length(F.bin(end - start)))  # nodes of the levels above are wider
    each = rules.withColumn("_i", F.explode(F.sequence(F.lit(0), widest)))
    # ceil(start / 2^i), floor(end / 2^i)
    a, b = -F.call_function("shiftright", -start, i), F.call_function("shiftright", end, i)
    root = F.call_function("shiftright", F.lit(1 << depth).cast("long"), i)
    nodes = F.array(F.when((a < b) & (a % 2 == 1), root + a), F.when((a < b) & (b % 2 == 1), root + b - 1))
    return each.select(F.explode(nodes).alias("_node"), *kept).where("_node is not null")
