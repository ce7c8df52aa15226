"""Evaluation cases as DataFrames: strict files, and tables.

A case is ``ordinal, case_id, reference, prediction, tags, metadata``. Payloads
are structs (kind, text, canon): kind tells JSON types apart, text is the value
(JSON for containers, in source order), canon the same with keys sorted.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import WHITES
from ..model import CaseFormatError
from . import files

PAYLOAD = "struct<kind:string,text:string,canon:string>"
CASES = f"ordinal bigint, case_id string, reference {PAYLOAD}, prediction {PAYLOAD}, tags array<string>, metadata string"
_FIELDS = {"id", "reference", "prediction", "tags", "metadata"}


def _canon(value: Any) -> str:
    """JSON with sorted keys in which 1, 1.0 and true differ."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False)


def payload(value: Any) -> dict[str, str]:
    """A JSON value as a payload."""
    if isinstance(value, str):
        return {"kind": "str", "text": value, "canon": value}
    if value is None:
        return {"kind": "null", "text": "null", "canon": "null"}
    kind = "bool" if isinstance(value, bool) else "int" if isinstance(value, int) else "float" if isinstance(value, float) else "array" if isinstance(value, list) else "object"
    text = json.dumps(value, ensure_ascii=False)
    return {"kind": kind, "text": text, "canon": _canon(value)}


def value_of(p: Any) -> Any:
    """The JSON value of a payload row; a null row is None."""
    if p is None:
        return None
    return p["text"] if p["kind"] == "str" else json.loads(p["text"])


def strict_json(text: str) -> Any:
    """JSON without the constants NaN and Infinity and without repeated keys; a number beyond a double's range is infinite."""

    def refuse(name: str) -> Any:
        raise CaseFormatError(f"{name} is not JSON")

    def once(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
        out: dict[str, Any] = {}
        for k, v in pairs:
            if k in out:
                raise CaseFormatError(f"the key {k!r} occurs twice")
            out[k] = v
        return out

    return json.loads(text, parse_constant=refuse, object_pairs_hook=once)


def case_of(item: Any, position: int) -> dict[str, Any]:
    """One record as a case; CaseFormatError names the first rule that it breaks."""

    def check(ok: bool, what: str) -> None:
        if not ok:
            raise CaseFormatError(f"case {position}: {what}")

    check(isinstance(item, dict), "must be an object")
    missing, extra = {"id", "reference", "prediction"} - set(item), set(item) - _FIELDS
    check(not missing, f"missing fields: {', '.join(sorted(missing))}")
    check(not extra, f"unknown fields: {', '.join(sorted(extra))}")
    check(isinstance(item["id"], str), "id must be a string")
    check(bool(item["id"].strip()), "id must not be blank")
    tags, extra_data = item.get("tags", []), item.get("metadata", {})
    check(isinstance(tags, list) and all(isinstance(t, str) for t in tags), "tags must be a list of strings")
    check(len(set(tags)) == len(tags), "tags must be unique")
    check(isinstance(extra_data, dict), "metadata must be an object")
    return {"ordinal": position, "case_id": item["id"], "reference": payload(item["reference"]), "prediction": payload(item["prediction"]), "tags": tags, "metadata": json.dumps(extra_data, ensure_ascii=False)}


_ROW = "struct<" + ", ".join(f"{x.split(' ', 1)[0]}:{x.split(' ', 1)[1]}" for x in CASES.split(", ")) + ">"


def _array_error(spark: SparkSession, source: str) -> str:
    """Why a file holds no array: one strict parse of the whole file in a task."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                try:
                    strict_json(bytes(content).decode("utf-8"))
                    said = "a JSON case file must hold an array"
                except UnicodeDecodeError:
                    said = f"cannot read {source}: it is not UTF-8"
                except json.JSONDecodeError as e:
                    said = f"invalid JSON in {source} at line {e.lineno}, column {e.colno}"
                except CaseFormatError as e:
                    said = f"invalid JSON in {source}: {e}"
                yield pd.DataFrame({"error": [said]})

    found = spark.read.format("binaryFile").load(source).select("content").mapInPandas(parse, "error string").first()
    return found[0] if found else f"invalid JSON in {source} at line 1, column 1"  # an empty file has no row


def load_cases(spark: SparkSession, path: str | Path) -> DataFrame:
    """Cases of a ``.jsonl`` file, or of any other file with one JSON array.

    Files are read in byte ranges by as many tasks as they are long; the first
    error in the file is raised here, with the line, column or position that a
    strict parse of the whole file gives. The cases stand in the shared folder, so
    they are parsed once.
    """
    source = str(path)
    if not re.match("[A-Za-z][A-Za-z0-9+.-]+:", source) and not Path(source).is_file():
        raise CaseFormatError(f"no case file {source}")
    try:
        spark.read.text(source)
    except Exception as e:
        raise CaseFormatError(f"cannot read {source}: {e}") from e
    if source.lower().endswith(".jsonl"):
        return files.load_lines(spark, source, strict_json, case_of, _ROW)
    found = files.load_array(spark, source, strict_json, case_of, _ROW)
    if found is None:
        raise CaseFormatError(_array_error(spark, source))
    return found


def load_metric_config(path: str | Path) -> dict[str, Any]:
    """A metric configuration object from a strict JSON file."""
    try:
        loaded = strict_json(Path(path).read_text(encoding="utf-8"))
    except json.JSONDecodeError as e:
        raise CaseFormatError(f"invalid JSON in {path} at line {e.lineno}, column {e.colno}") from e
    except (OSError, UnicodeError) as e:
        raise CaseFormatError(f"cannot read {path}: {e}") from e
    if not isinstance(loaded, dict):
        raise CaseFormatError("a metric configuration must be an object")
    return loaded


def _quoted(text: Column) -> Column:
    """A string as JSON writes it, with all but quotes, backslashes and control characters as they are."""
    for sign, shown in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        text = F.replace(text, F.lit(sign), F.lit(shown))
    control = lambda x: (x != "") & (F.ascii(x) < 32)
    spelt = F.array_join(F.transform(F.split(text, ""), lambda x: F.when(control(x), F.format_string("\\u%04x", F.ascii(x))).otherwise(x)), "")
    return F.concat(F.lit('"'), F.when(text.rlike(r"[\x00-\x1f]"), spelt).otherwise(text), F.lit('"'))


def canonical(c: Column, kind: T.DataType) -> Column:
    """A column as JSON with sorted keys, built from its type: equal for equal values, whatever the order of a map's entries or a struct's fields.

    Whole and fractional numbers stay apart, and nulls inside are kept. Fractions are
    spelt as Spark spells them.
    """
    if isinstance(kind, T.ArrayType):
        shown = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: canonical(x, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, T.StructType):
        fields = [x for f in sorted(kind.fields, key=lambda f: f.name) for x in (F.lit(f"{json.dumps(f.name, ensure_ascii=False)}: "), canonical(c.getField(f.name), f.dataType), F.lit(", "))]
        shown = F.concat(F.lit("{"), *fields[:-1], F.lit("}"))
    elif isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(c), lambda e: F.struct(e["key"].cast("string").alias("k"), canonical(e["value"], kind.valueType).alias("v")))
        shown = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(entries), lambda e: F.concat(_quoted(e["k"]), F.lit(": "), e["v"])), ", "), F.lit("}"))
    elif isinstance(kind, T.BooleanType | T.NumericType):
        shown = c.cast("string")
    else:
        shown = _quoted(F.base64(c) if isinstance(kind, T.BinaryType) else c.cast("string"))
    return F.coalesce(shown, F.lit("null"))


def payload_column(df: DataFrame, name: str) -> Column:
    """A table column as a payload, by its type."""
    kind = df.schema[name].dataType
    c = F.col(name)
    canon = None
    if isinstance(kind, T.StringType):
        made, text = "str", c
    elif isinstance(kind, T.BooleanType):
        made, text = "bool", c.cast("string")
    elif isinstance(kind, T.IntegralType):
        made, text = "int", c.cast("string")
    elif isinstance(kind, T.FractionalType):
        made, text = "float", c.cast("string")
    else:
        made, text = "array" if isinstance(kind, T.ArrayType) else "object", F.to_json(c, {"ignoreNullFields": "false"})
        canon = canonical(c, kind)
    return F.when(c.isNull(), F.struct(F.lit("null").alias("kind"), F.lit("null").alias("text"), F.lit("null").alias("canon"))).otherwise(F.struct(F.lit(made).alias("kind"), text.alias("text"), (text if canon is None else canon).alias("canon")))


def broken_rules(cases: DataFrame) -> DataFrame:
    """(ordinal, rule): the first rule that each case breaks, as for a file's records."""
    tags = F.col("tags")
    rule = (
        F.when(F.col("ordinal").isNull(), "ordinal must not be null").when(F.col("case_id").isNull(), "id must be a string")
        .when(F.btrim("case_id", F.lit(WHITES)) == "", "id must not be blank").when(F.exists(tags, lambda t: t.isNull()), "tags must be a list of strings")
        .when(F.size(F.array_distinct(tags)) < F.size(tags), "tags must be unique")
    )
    return cases.select("ordinal", rule.alias("rule")).where("rule is not null")


def from_dataframe(df: DataFrame, *, case_id: str, reference: str, prediction: str, ordinal: str, tags: str | None = None, check: bool = True) -> DataFrame:
    """Cases of a table; ``ordinal`` names the bigint column that orders them. Null tags are none.

    With ``check`` one pass over ids and tags finds the first case in order that
    breaks a rule, which raises CaseFormatError.
    """
    none = F.array().cast("array<string>")
    cases = df.select(
        F.col(ordinal).cast("bigint").alias("ordinal"), F.col(case_id).cast("string").alias("case_id"), payload_column(df, reference).alias("reference"), payload_column(df, prediction).alias("prediction"),
        (F.coalesce(F.col(tags), none) if tags else none).alias("tags"), F.lit("{}").alias("metadata"),
    )
    first = broken_rules(cases).agg(F.min(F.struct("ordinal", "rule"))).first()[0] if check else None
    if first is not None:
        raise CaseFormatError(f"case {first.ordinal}: {first.rule}")
    return cases


def from_records(spark: SparkSession, records: Iterable[dict[str, Any]]) -> DataFrame:
    """Cases of in-memory records (id, reference, prediction, tags, metadata), checked like a file's."""
    rows = [case_of(r, i) for i, r in enumerate(records, 1)]
    return spark.createDataFrame([tuple(r.values()) for r in rows], CASES)


def from_json_lines(lines: DataFrame, *, text: str, ordinal: str) -> DataFrame:
    """Cases of a table with one JSON record a row, each parsed and checked like a line of a case file.

    Blank and null lines are skipped. The first bad line in order of ``ordinal``
    raises CaseFormatError; every line is parsed once for that and once for each use.
    """

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list[tuple[int, str | None, dict[str, Any] | None]] = []
            for place, line in zip(frame["o"], frame["t"], strict=True):
                if line is None or not line.strip():
                    continue
                try:
                    out.append((place, None, case_of(strict_json(line), place)))
                except ValueError as e:
                    out.append((place, str(e), None))
            yield pd.DataFrame(out, columns=["o", "error", "r"])

    parsed = lines.select(F.col(ordinal).cast("bigint").alias("o"), F.col(text).alias("t")).mapInPandas(parse, f"o bigint, error string, r {_ROW}")
    first = parsed.where("error is not null").agg(F.min(F.struct("o", "error"))).first()[0]
    if first is not None:
        raise CaseFormatError(f"invalid JSON at line {first.o}: {first.error}")
    return parsed.select("r.*")


def require_unique_ids(cases: DataFrame, what: str = "cases") -> DataFrame:
    """``cases``, or ValueError with all repeated ids in order."""
    twice = [r[0] for r in cases.groupBy("case_id").count().where("count > 1").orderBy("case_id").collect()]
    if twice:
        raise ValueError(f"duplicate ids in {what}: {', '.join(twice)}")
    return cases
