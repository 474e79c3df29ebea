"""Auditing generated text against its source, and the quality of generation runs."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.rules import Rule, reasons
from ..functions.text import BEGIN, END

# Numbers that prove nothing, fields whose text is invented by design, what looks like a year.
HARMLESS = tuple(str(n) for n in range(11)) + ("100",)
GENERATIVE = ("descriptionEn", "warnings", "confidence")
YEAR = rf"{BEGIN}(19[89][0-9]|20[0-4][0-9]){END}"


def years(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(YEAR), F.lit(1)))


def numbers(c: Column) -> Column:
    return F.array_except(F.regexp_extract_all(c, F.lit("([0-9]+)"), F.lit(1)), F.array(*map(F.lit, HARMLESS)))


def _walk(text: str | None) -> Iterator[tuple[str, str]]:
    """Path and value of each scalar of a JSON document but null; nothing where it does not parse."""
    try:
        waiting = [("", json.loads(text))] if text is not None else []
    except (ValueError, RecursionError):  # no JSON, or nested more deeply than a parser goes
        return
    while waiting:
        path, value = waiting.pop()
        if isinstance(value, dict):
            waiting += [(f"{path}.{k}" if path else k, v) for k, v in reversed(value.items())]
        elif isinstance(value, list):
            waiting += [(f"{path}[{i}]", v) for i, v in reversed(list(enumerate(value)))]
        elif value is not None:
            yield path, value if isinstance(value, str) else json.dumps(value)


def leaves(df: DataFrame, keep: list[str], output: str = "output") -> DataFrame:
    """One row per scalar of a JSON document, however deeply nested: path and value.

    One pass over the rows: a document is walked where it is read, so no level needs a job of its own.
    """
    rows = df.select(*keep, F.col(output).cast("string").alias("_json"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, *leaf) for i, text in enumerate(batch.column(len(keep)).to_pylist()) for leaf in _walk(text)]
            which, paths, values = zip(*found, strict=True) if found else ((), (), ())
            own = [batch.column(i).take(pa.array(which, pa.int64())) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(paths, pa.string()), pa.array(values, pa.string())], [*keep, "path", "value"])

    return rows.mapInArrow(run, StructType([*rows.select(*keep).schema, StructField("path", StringType()), StructField("value", StringType())]))


def audit_generated_text(rows: DataFrame, id_col: str = "target_id", generative: tuple[str, ...] = ()) -> DataFrame:
    """Flags (id, field, value, kind, number): years and other numbers of the output that the source does not hold.

    Fields (names or paths) whose text is invented by design are left out: ``GENERATIVE`` and those of ``generative``.
    """
    generative = (*GENERATIVE, *generative)
    fields = leaves(rows, [id_col, "source_text"])
    leaf = F.regexp_replace(F.element_at(F.split("path", r"\."), -1), r"\[[0-9]+\]$", "")
    fields = fields.where(~leaf.isin(*generative) & ~F.col("path").isin(*generative))
    own_years = years(F.col("value"))
    extra_years = F.array_except(own_years, years(F.col("source_text")))
    extra = F.array_except(F.array_except(numbers(F.col("value")), own_years), numbers(F.col("source_text")))
    tagged = F.concat(
        F.transform(extra_years, lambda n: F.struct(F.lit("year").alias("kind"), n.alias("number"))),
        F.transform(extra, lambda n: F.struct(F.lit("number").alias("kind"), n.alias("number"))),
    )
    flags = fields.select(id_col, F.col("path").alias("field"), "value", F.inline(tagged))
    return flags.dropDuplicates([id_col, "field", "kind", "number"]).withColumn("severity", F.lit("BLOCKING"))


def unsupported_numbers(rows: DataFrame, source: str, output: str) -> Column:
    """Numbers of one text column that another does not hold."""
    return F.array_except(numbers(F.col(output)), numbers(F.col(source)))


# Fields of the two kinds of output and their limits.
COPY_LENGTH, SPECIFIC_MAX, MESSAGE_MAX = (20, 4000), 65, 500
NAME_MAX = {"cardNameEn": 120, "setNameEn": 120, "characterEn": 80}
WARNING = "array<struct<field: variant, message: variant>>"


def _common(v: Column, kinds: dict[str, str]) -> list[Rule]:
    """Rules of both kinds: the output is an object whose fields have their JSON types, a confidence, and well-formed warnings."""
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    number = kind("$.confidence").rlike("^(BIGINT|DOUBLE|DECIMAL)")
    value = F.try_variant_get(v, "$.confidence", "double")
    warnings = F.try_variant_get(v, "$.warnings", WARNING)
    given = kind("$.warnings")
    is_text = lambda x: F.coalesce(F.schema_of_variant(x), F.lit("")) == "STRING"  # noqa: E731  a number is no text
    fits = lambda x: F.coalesce(F.char_length(F.try_variant_get(x, "$", "string")) <= MESSAGE_MAX, F.lit(False))
    formed = F.forall(warnings, lambda w: is_text(w["field"]) & is_text(w["message"]) & fits(w["message"]))
    return [
        Rule("(root)", F.schema_of_variant(v).rlike("^OBJECT")),
        *(Rule(n, kind(f"$.{n}").rlike(want)) for n, want in kinds.items()),
        Rule("confidence", number & value.between(0, 1)),
        Rule("warnings", given.isNull() | (F.coalesce(given, F.lit("")).rlike("^ARRAY") & F.coalesce(formed, F.lit(False)))),
    ]


def validate_copy(rows: DataFrame, output: str = "output") -> DataFrame:
    """Adds ``issues``: the fields of a listing's copy (JSON text) that break its schema; ``(root)`` where it does not parse.

    descriptionEn has 20 to 4000 characters, itemSpecifics maps names to values of at most 65, confidence lies in 0 to 1,
    warnings (optional) are field and message of at most 500.
    """
    v = F.try_parse_json(F.col(output))
    text = F.try_variant_get(v, "$.descriptionEn", "string")
    specifics = F.try_variant_get(v, "$.itemSpecifics", "map<string, variant>")
    fits = lambda k, x: (F.char_length(k) <= SPECIFIC_MAX) & F.schema_of_variant(x).eqNullSafe("STRING") & (F.char_length(F.try_variant_get(x, "$", "string")) <= SPECIFIC_MAX)
    rules = [
        *_common(v, {"descriptionEn": "^STRING$", "itemSpecifics": "^OBJECT"}),
        Rule("descriptionEn", F.char_length(text).between(*COPY_LENGTH)),
        Rule("itemSpecifics", F.forall(F.map_entries(specifics), lambda e: fits(e["key"], e["value"]))),
    ]
    return _with_issues(rows, rules)


def validate_translation(rows: DataFrame, output: str = "output") -> DataFrame:
    """Adds ``issues`` of a translation (JSON text): each name is present, null or 1 to 120 (character: 80) characters."""
    v = F.try_parse_json(F.col(output))
    size = lambda n: F.char_length(F.try_variant_get(v, f"$.{n}", "string"))
    rules = [
        *_common(v, {n: "^(STRING|VOID)$" for n in NAME_MAX}),
        *(Rule(n, F.is_variant_null(F.try_variant_get(v, f"$.{n}", "variant")) | size(n).between(1, most)) for n, most in NAME_MAX.items()),
    ]
    return _with_issues(rows, rules)


def _with_issues(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """A document that is no object has one issue, any other each field once."""
    found = F.array_distinct(reasons(rules))
    root = F.array(F.lit("(root)"))
    return rows.withColumn("issues", F.when(F.array_contains(found, "(root)"), root).otherwise(found))


def needs_review(rows: DataFrame, floor: float = 0.85) -> DataFrame:
    """Adds needs_review: invalid, flagged, or below the confidence floor."""
    low = F.coalesce(F.col("confidence") < floor, F.lit(True))
    return rows.withColumn("needs_review", ~F.col("schema_valid") | (F.col("n_flags") > 0) | low)


def prompt_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", *(F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts)), 256)


def reusable(requests: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests whose output is on record, requests to run: one for each distinct prompt)."""
    known = log.where("schema_valid").select("prompt_hash").distinct()
    fresh = requests.join(known, "prompt_hash", "left_anti").dropDuplicates(["prompt_hash"])
    return requests.join(known, "prompt_hash", "left_semi"), fresh


def generation_log(runs: DataFrame, validate: Callable[[DataFrame], DataFrame] = validate_copy, floor: float = 0.85) -> DataFrame:
    """Append-ready rows of a log of generation runs (run_id, model, purpose, prompt, source_text, output): the prompt's
    hash, the output as it came, the issues of its schema, the flags against its source, and whether a person must look."""
    flags = audit_generated_text(runs, "run_id").groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("field", "kind", "number"))).alias("flags"))
    df = validate(runs).join(flags, "run_id", "left").withColumn("schema_valid", F.size("issues") == 0)
    df = df.withColumns({
        "flags": F.coalesce("flags", F.array().cast("array<struct<field: string, kind: string, number: string>>")),
        "confidence": F.try_variant_get(F.try_parse_json("output"), "$.confidence", "double"),
        "prompt_hash": prompt_hash(F.col("model"), F.col("prompt")),
    })
    df = needs_review(df.withColumn("n_flags", F.size("flags")), floor)
    return df.select("run_id", "model", "purpose", "prompt_hash", "output", "schema_valid", "issues", "flags", "n_flags", "confidence", "needs_review")


def generation_quality(log: DataFrame) -> DataFrame:
    return log.groupBy("model", "purpose").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("schema_valid")).alias("n_generated"),
        F.count_if("needs_review").alias("n_review"), F.count_if(~F.col("schema_valid")).alias("n_failed"),
    )
