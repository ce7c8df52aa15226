"""Case files of any size, read in byte ranges.

Spark's text reader splits a file at a separator byte: the line feed for JSONL,
the closing brace for a JSON array. What each range holds is counted once and
added up over the ranges, so every record knows its physical line, its position and
its column as if the file had been read whole, and the first error in the file
is the one that is raised. Only counts and errors come to the driver.

A range of an array begins in the middle of the text. Whether it begins inside a
string, and how deep, follows from the ranges before it: each is walked for
both beginnings, and these functions are composed. With its beginning known a range
is cut at the commas of the outer array; elements that lie in one range are
parsed there, and the pieces of the others meet by their number.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import CaseFormatError
from ..operators.shared import cut

#: Bytes that are walked at once.
BLOCK_BYTES = 4 << 20
#: Fixed value: white space of JSON.
_BLANK = b" \t\n\r"
_OUTSIDE, _INSIDE = re.compile(rb'["\[\]{},]'), re.compile(rb'["\\]')

Parse = Callable[[str], Any]
Case = Callable[[Any, int], dict[str, Any]]


def _records(spark: SparkSession, source: str, separator: str) -> DataFrame:
    """(start, size, record): what lies between separators, with the start of its byte range; in order within a range."""
    raw = spark.read.option("lineSep", separator).text(source)
    return raw.select(F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("record"))


def _no_utf8(source: str) -> CaseFormatError:
    return CaseFormatError(f"cannot read {source}: it is not UTF-8")


def _marked(source: str) -> CaseFormatError:
    return CaseFormatError(f"invalid JSON in {source} at line 1, column 1")  # a byte order mark, which the reader takes away


def load_lines(spark: SparkSession, source: str, parse: Parse, case_of: Case, fields: str) -> DataFrame:
    """Cases of a JSONL file. Lines end wherever ``str.splitlines`` ends them; blank ones are skipped but counted."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here: int | None = None
        line = item = size = whole = 0

        def rows(found: list[tuple[Any, ...]]) -> pd.DataFrame:
            return pd.DataFrame(found, columns=["start", "line", "item", "kind", "detail", "r"])

        def total() -> pd.DataFrame:
            return rows([(here, line, item, "total", f"{size} {whole}", None)])

        for frame in frames:
            out: list[tuple[Any, ...]] = []
            for start, whole_size, record in frame.itertuples(index=False):
                if here is not None and start != here:
                    yield total()
                    line = item = size = 0
                here, whole = start, whole_size
                size += len(record) + 1
                try:
                    lines = (bytes(record).decode("utf-8") + "\n").splitlines()
                except UnicodeDecodeError:
                    out.append((here, line, item, "utf-8", None, None))
                    continue
                for text in lines:
                    line += 1
                    if not text.strip():
                        continue
                    item += 1
                    try:
                        value = parse(text)
                    except json.JSONDecodeError as e:
                        out.append((here, line, item, "json", f", column {e.colno}", None))
                    except CaseFormatError as e:
                        out.append((here, line, item, "json", f": {e}", None))
                    else:
                        try:
                            out.append((here, line, item, "case", None, case_of(value, item)))
                        except CaseFormatError as e:
                            out.append((here, line, item, "rule", str(e).removeprefix(f"case {item}: "), None))
            if out:
                yield rows(out)
        if here is not None:
            yield total()

    found = cut(_records(spark, source, "\n").mapInPandas(read, f"start bigint, line bigint, item bigint, kind string, detail string, r {fields}"))
    first = F.min_by(F.struct("line", "item", "detail"), F.struct("line", "item"))
    firsts = {(x.start, x.kind): x for x in found.where("kind <> 'case'").groupBy("start", "kind").agg(first.alias("first")).collect()}  # a few rows a range
    starts = sorted(s for s, kind in firsts if kind == "total")
    bases, lines, items, sizes, whole = {}, 0, 0, 0, 0
    for s in starts:
        bases[s] = lines, items
        own = firsts[s, "total"]["first"]
        size, whole = map(int, own.detail.split())
        lines, items, sizes = lines + own.line, items + own.item, sizes + size
    if any(kind == "utf-8" for _, kind in firsts):
        raise _no_utf8(source)
    if sizes < whole:
        raise _marked(source)
    for kind in ("json", "rule"):
        for s in starts:
            if (s, kind) in firsts:
                own = firsts[s, kind]["first"]
                if kind == "json":
                    raise CaseFormatError(f"invalid JSON in {source} at line {bases[s][0] + own.line}{own.detail}")
                raise CaseFormatError(f"case {bases[s][1] + own.item}: {own.detail}")
    before = spark.createDataFrame([(s, n) for s, (_, n) in bases.items()], "start bigint, base bigint")
    ordered = found.where("kind = 'case'").join(F.broadcast(before), "start")
    return ordered.select(F.col("r").withField("ordinal", F.col("base") + F.col("item")).alias("r")).select("r.*")


def walk(data: bytes, inside: bool, depth: int, outer: bool = False) -> tuple[bool, int, list[tuple[int, int]]]:
    """Whether a string is open after ``data``, the depth of brackets, and with ``outer`` the (place, byte) of what opens, parts and closes the outermost array."""
    at, found = 0, []
    while m := (_INSIDE if inside else _OUTSIDE).search(data, at):
        sign, at = data[m.start()], m.end()
        if inside:
            if sign == 0x5C:
                at += 1
            else:
                inside = False
        elif sign == 0x22:
            inside = True
        elif sign in b"[{":
            if outer and depth == 0:
                found.append((m.start(), sign))
            depth += 1
        elif sign in b"]}":
            depth -= 1
            if outer and depth == 0:
                found.append((m.start(), sign))
        elif outer and depth == 1:
            found.append((m.start(), sign))
    return inside, depth, found


def _after(text: str, line: int, column: int) -> tuple[int, int]:
    """Line and column (from 1) of what follows ``text``, which begins at the given ones."""
    n = text.count("\n")
    return line + n, len(text) - text.rfind("\n") if n else column + len(text)


def _located(text: str, line: int, column: int, parse: Parse, item: int, case_of: Case) -> tuple[str, int, int, str | None, dict[str, Any] | None]:
    """(kind, line, column, detail, case) of an element's text that begins at a line and column."""
    try:
        value = parse(text)
    except json.JSONDecodeError as e:
        return "json", *_after(text[: e.pos], line, column), None, None
    except CaseFormatError as e:
        return "json", line, column, str(e), None
    try:
        return "case", line, column, None, case_of(value, item)
    except CaseFormatError as e:
        return "rule", line, column, str(e).removeprefix(f"case {item}: "), None


def load_array(spark: SparkSession, source: str, parse: Parse, case_of: Case, fields: str, block_bytes: int = BLOCK_BYTES) -> DataFrame | None:
    """Cases of a file with one JSON array; None where the file holds something else, whose error the caller finds."""

    def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Blocks of records, each walked for both beginnings."""
        here: int | None = None
        number = held = whole = 0
        parts: list[bytes] = []

        def block() -> pd.DataFrame:
            nonlocal number, held
            data = b"".join(parts)
            try:
                text = data.decode("utf-8")
            except UnicodeDecodeError:
                text = None
            out, inn = walk(data, False, 0)[:2], walk(data, True, 0)[:2]
            line, column = (0, 0) if text is None else _after(text, 0, 0)
            row = (here, number, whole, data, len(data), *out, *inn, line, column, text is not None, data.lstrip(_BLANK)[:1].decode("latin-1"))
            parts.clear()
            number, held = number + 1, 0
            return pd.DataFrame([row], columns=["start", "number", "size", "data", "bytes", "out_inside", "out_depth", "in_inside", "in_depth", "lines", "column", "utf8", "head"])

        for frame in frames:
            for start, size, record in frame.itertuples(index=False):
                if here is not None and start != here:
                    if parts:
                        yield block()
                    number = 0
                here, whole = start, size
                parts.append(bytes(record) + b"}")
                held += len(parts[-1])
                if held >= block_bytes:
                    yield block()
        if parts:
            yield block()

    shape = "start bigint, number bigint, size bigint, data binary, bytes bigint, out_inside boolean, out_depth bigint, in_inside boolean, in_depth bigint, lines bigint, column bigint, utf8 boolean, head string"
    blocks = cut(_records(spark, source, "}").mapInPandas(join, shape))
    known = blocks.drop("data").orderBy("start", "number").collect()  # one row a block
    if not known:
        return None
    if not all(b.utf8 for b in known):
        raise _no_utf8(source)
    over = sum(b.bytes for b in known) - known[0].size
    if over < 0:
        raise _marked(source)
    if next((b.head for b in known if b.head), "") != "[":
        return None
    begins, inside, depth, line, column = [], False, 0, 1, 1
    for k, b in enumerate(known):
        last = k == len(known) - 1
        begins.append((b.start, b.number, k, inside, depth, line, column, over if last else 0, last))
        inside, depth = (b.in_inside, depth + b.in_depth) if inside else (b.out_inside, depth + b.out_depth)
        line, column = line + b.lines, b.column if b.lines else column + b.column

    def elements(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The pieces of a block between the outer array's signs; those with both ends in it are parsed."""
        for frame in frames:
            for data, k, inside, depth, line, column, over, last in frame.itertuples(index=False):
                data = bytes(data)[: len(data) - over] if over else bytes(data)
                signs = walk(data, inside, depth, outer=True)[2]
                out: list[tuple[Any, ...]] = []
                at, before = 0, 0
                commas = 0
                for place, sign in [*signs, (len(data), 0)]:
                    end = place + (sign in b"}{")  # what a brace opens or closes belongs to the piece, where its error shows
                    text = data[at:end].decode("utf-8")
                    kind, case, detail, where = "piece", None, None, (line, column)
                    if before == 0x2C and sign == 0x2C and text.strip(" \t\n\r"):
                        kind, *where, detail, case = _located(text, line, column, parse, commas, case_of)
                    out.append((k, commas, len(out), kind, *where, text if kind == "piece" else None, chr(sign) if sign else "", detail, case))
                    line, column = _after(data[at : place + 1].decode("utf-8"), line, column)
                    at, before = place + 1, sign
                    commas += sign == 0x2C
                yield pd.DataFrame(out, columns=["block", "commas", "place", "kind", "line", "column", "text", "sign", "detail", "r"])

    begun = spark.createDataFrame(begins, "start bigint, number bigint, block bigint, inside boolean, depth bigint, line bigint, col bigint, over int, last boolean")
    walked = blocks.select("start", "number", "data").join(F.broadcast(begun), ["start", "number"]).select("data", "block", "inside", "depth", "line", "col", "over", "last")
    found = cut(walked.mapInPandas(elements, f"block bigint, commas bigint, place bigint, kind string, line bigint, column bigint, text string, sign string, detail string, r {fields}"))
    counts = {x.block: x.n for x in found.groupBy("block").agg(F.max("commas").alias("n")).collect()}
    base, bases = 0, []
    for k in range(len(known)):
        bases.append((k, base))
        base += counts[k]
    numbered = found.join(F.broadcast(spark.createDataFrame(bases, "block bigint, base bigint")), "block").withColumn("item", F.col("base") + F.col("commas"))

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Elements, and what stands before the array and after it, from their pieces."""
        for frame in frames:
            out = []
            for item, pieces in frame.itertuples(index=False):
                text, begin, end = "", None, ""
                kind, where, detail, case = "json", (pieces[0]["line"], pieces[0]["column"]), None, None
                opened = closed = False
                for p in pieces:
                    begin = begin or (p["line"], p["column"])
                    if closed and p["text"].strip(" \t\n\r"):  # after the array
                        end = "extra"
                        where = _after(p["text"][: len(p["text"]) - len(p["text"].lstrip(" \t\n\r"))], p["line"], p["column"])
                        break
                    text += p["text"]
                    if p["sign"] == "[" and not opened and not closed:
                        opened, text, begin = True, "", None
                    elif p["sign"] == "]":
                        closed, end = True, "]"
                        after = _after(p["text"], p["line"], p["column"])
                    elif p["sign"] and p["sign"] in "}{[,":
                        end, after = p["sign"], _after(p["text"], p["line"], p["column"])
                        if p["sign"] != "," or closed:
                            break
                    elif not p["sign"] and not closed:
                        end, after = "", _after(p["text"], p["line"], p["column"])
                begin = begin or where
                stripped = text.strip(" \t\n\r")
                if not stripped and end == "]" and item == 0:
                    kind = "empty"
                elif not stripped and end == "]":
                    kind, where = "json", (pieces[0]["line"], pieces[0]["column"] - 1)  # the comma before it
                elif not stripped:
                    where = after if end != "extra" else where
                else:
                    kind, *found, detail, case = _located(text, *begin, parse, item + 1, case_of)
                    if kind == "json":
                        where = found
                    elif end not in (",", "]"):
                        kind, case, detail = "json", None, None
                        where = after if end != "extra" else where
                out.append((item + 1, kind, *where, detail, case))
            yield pd.DataFrame(out, columns=["item", "kind", "line", "column", "detail", "r"])

    pieces = numbered.where("kind = 'piece'").groupBy("item").agg(F.array_sort(F.collect_list(F.struct("block", "place", "line", "column", "text", "sign"))).alias("pieces"))
    met = cut(pieces.mapInPandas(meet, f"item bigint, kind string, line bigint, column bigint, detail string, r {fields}"))
    inner = numbered.where("kind <> 'piece'").select((F.col("item") + 1).alias("item"), "kind", "line", "column", "detail", "r")
    every = inner.unionByName(met)
    firsts = {x.kind: x["first"] for x in every.where("kind in ('json', 'rule')").groupBy("kind").agg(F.min(F.struct("item", "line", "column", "detail")).alias("first")).collect()}
    if "json" in firsts:
        own = firsts["json"]
        raise CaseFormatError(f"invalid JSON in {source}: {own.detail}" if own.detail else f"invalid JSON in {source} at line {own.line}, column {own.column}")
    if "rule" in firsts:
        raise CaseFormatError(f"case {firsts['rule'].item}: {firsts['rule'].detail}")
    return every.where("kind = 'case'").select(F.col("r").withField("ordinal", F.col("item")).alias("r")).select("r.*")
