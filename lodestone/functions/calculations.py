"""Calculations that an answer shows on lines "CALC: 5 [c1] - 3 [c2] = 2": found, parsed, and held against passages."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from lodestone.functions import figures as N
from lodestone.operators.parsing import slices

# What opens a calculation, constants that need no source, scales between operands and result, and words for "about".
CALC = r"(?i)(?:[-*•][ \t]+)?\**\bCALC:"
CONSTANTS = (1.0, 100.0, 1e3, 1e6, 1e9)
RESULT_SCALES = (1.0, 1e3, 1e6, 1e9)
ABOUT = re.compile(r"about|approximately|approx\.?|roughly|around|[~≈*]", re.I)
UNPARSED, UNCITED, UNKNOWN, ABSENT, MISMATCH = "unparsed", "uncited operand", "unknown tag", "operand not in passage", "mismatch"

AMOUNT = rf"(?P<currency>[$€£])?\s?(?P<number>{N.FIGURE})(?:\s*(?P<unit>%|percent\b|(?:thousand|million|billion|trillion)s?\b))?"
TOKEN = re.compile(rf"\s*(?:\[(?P<tags>c\d+(?:\s*,\s*c\d+)*)\]|{AMOUNT}|(?P<sign>[-+*/()×÷−–]|x(?=\s)))", re.I)
RESULT = re.compile(AMOUNT.replace(r"(?:\s*(?P<unit>", r"\)?(?:\s*(?P<unit>"), re.I)
OPENING, AND = re.compile(CALC + r"\**"), re.compile(r"\s*,\s*")
BRACKETS = str.maketrans("【】", "[]")
#: The plain form, which Arrow reads without Python: two short numbers with at most a tag each, and a result without a unit.
_PLAIN = r"[0-9]{1,3}(?:,[0-9]{3}){1,4}(?:\.[0-9]{1,9})?|[0-9]{1,15}(?:\.[0-9]{1,9})?"
PLAIN = rf"^CALC: +(?P<c0>\$?)(?P<n0>{_PLAIN})(?: +\[(?P<t0>c[0-9]+)\])? +(?P<sign>[-+*/]) +(?P<c1>\$?)(?P<n1>{_PLAIN})(?: +\[(?P<t1>c[0-9]+)\])? += +\$?(?P<n2>{_PLAIN})$"
SIGNS = {"×": "*", "x": "*", "X": "*", "÷": "/", "−": "-", "–": "-"}
OPERAND = "struct<raw:string,value:double,percent:boolean,scale:double,currency:boolean,tags:array<string>>"
PARSED = f"array<struct<line:string,operands:array<{OPERAND}>,computed:double,stated:double,percent:boolean,slack:double>>"



def lines(answer: Column) -> Column:
    """The calculations of an answer, also several on a line or behind a sentence."""
    return F.transform(F.regexp_extract_all(answer, F.lit(CALC + rf"(?:(?!{CALC})[^\n])*"), F.lit(0)), lambda x: F.trim(x))


def prose(answer: Column) -> Column:
    """The answer without its calculations."""
    whole = F.regexp_replace(answer, rf"(?:\A|\n)[ \t]*{CALC}[^\n]*", "")
    return F.regexp_replace(F.regexp_replace(whole, rf"[ \t]*{CALC}[^\n]*", ""), r"\A\s+|\s+\z", "")


def _amount(m: re.Match) -> dict:
    unit = (m["unit"] or "").lower().rstrip("s")
    return {
        "raw": m["number"], "value": float(m["number"].replace(",", "")), "percent": unit in ("%", "percent"),
        "scale": N.SCALES.get(unit, 1.0), "currency": bool(m["currency"]), "tags": [],
    }


def _readable(expression: str) -> bool:
    try:
        ast.parse(expression, mode="eval")
    except (SyntaxError, RecursionError, MemoryError):
        return False
    return True


def parse(line: str) -> dict:
    """Operands with their tags, the value recomputed from them, and the stated result with half a unit of its last digit.

    A line that is not numbers, tags, + - * / and brackets before its last "=" has no operands.
    """
    found = {"line": line, "operands": [], "computed": None, "stated": None, "percent": False, "slack": 0.0}
    left, _, right = OPENING.sub("", line, count=1).translate(BRACKETS).rpartition("=")
    operands, expression, at, stop = [], "", 0, len(left.rstrip())
    while at < stop:
        m = TOKEN.match(left, at)
        if m is None or m["tags"] and not operands:
            return found
        at = m.end()
        if m["tags"]:
            operands[-1]["tags"] += AND.split(m["tags"])
        elif m["sign"]:
            expression += SIGNS.get(m["sign"], m["sign"])
        else:
            operands.append(_amount(m))
            expression += f" {operands[-1]['value'] * operands[-1]['scale']!r} "
    computed, result = N.evaluate(expression.strip()), ABOUT.sub("", right)
    m = RESULT.search(result)
    if m is None or not operands or computed is None and not _readable(expression.strip()):
        return found
    stated = _amount(m)
    before = result[: m.start("number")]
    sign = -1 if re.search("[-−–]", before) or "(" in before and ")" in result[m.end("number") :] else 1
    return found | {
        "operands": operands, "computed": computed, "stated": sign * stated["value"] * stated["scale"],
        "percent": stated["percent"], "slack": 0.5 * 10.0 ** -len(m["number"].partition(".")[2]) * stated["scale"],
    }


def _plain(lines: pa.Array, m: pa.StructArray, kind: pa.StructType) -> pa.Array:
    """What parse() gives for lines of the plain form, whose groups are in m."""
    n = len(lines)
    group = dict(zip((f.name for f in m.type), m.flatten(), strict=True))
    x, y, stated = (pa.compute.replace_substring(group[f"n{i}"], ",", "").cast(pa.float64()) for i in range(3))
    both = np.arange(2 * n).reshape(2, n).T.ravel()
    pairs = lambda a, b: pa.concat_arrays([a, b]).take(pa.array(both))
    tags = pairs(group["t0"], group["t1"])
    has = pa.compute.not_equal(tags, "")
    operand = kind.field("operands").type.value_type
    at = lambda counts: pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
    each = {
        "raw": pairs(group["n0"], group["n1"]), "value": pairs(x, y), "percent": pa.repeat(False, 2 * n), "scale": pa.repeat(1.0, 2 * n),
        "currency": pa.compute.not_equal(pairs(group["c0"], group["c1"]), ""),
        "tags": pa.ListArray.from_arrays(at(has.to_numpy(zero_copy_only=False)), tags.filter(has), type=operand.field("tags").type),
    }
    operands = pa.StructArray.from_arrays([each[f.name] for f in operand], fields=list(operand))
    a, b, sign = x.to_numpy(), y.to_numpy(), group["sign"].to_numpy(zero_copy_only=False)
    with np.errstate(divide="ignore", invalid="ignore"):
        computed = np.select([sign == "+", sign == "-", sign == "*"], [a + b, a - b, a * b], a / b)
    digits = pa.compute.subtract(pa.compute.binary_length(group["n2"]), pa.compute.find_substring(group["n2"], ".")).to_numpy() - 1
    digits[pa.compute.find_substring(group["n2"], ".").to_numpy() < 0] = 0
    slack = np.array([0.5 * 10.0**-i for i in range(10)])
    whole = {
        "line": lines, "operands": pa.ListArray.from_arrays(at(np.full(n, 2)), operands, type=kind.field("operands").type),
        "computed": pa.array(computed, mask=(sign == "/") & (b == 0)), "stated": stated, "percent": pa.repeat(False, n), "slack": pa.array(slack[digits]),
    }
    return pa.StructArray.from_arrays([whole[f.name] for f in kind], fields=list(kind))


def parse_all(lines: pa.Array, kind: pa.StructType) -> pa.Array:
    """parse() of each line; only lines that aren't of the plain form become Python objects."""
    m = pa.compute.extract_regex(lines, PLAIN)
    plain = m.is_valid()
    rest = pa.array([parse(x) for x in lines.filter(pa.compute.invert(plain)).to_pylist()], kind)
    if len(rest) == len(lines):
        return rest
    found = _plain(lines.filter(plain), m.filter(plain), kind)
    mask = plain.to_numpy(zero_copy_only=False)
    return found if not len(rest) else pa.concat_arrays([found, rest]).take(pa.array(np.where(mask, np.cumsum(mask) - 1, len(found) + np.cumsum(~mask) - 1)))


def parsed(rows: DataFrame, source: str) -> DataFrame:
    """Adds `calcs`, the parsed forms of an array of lines; only the parser is Python, the rest are columns."""
    target = StructType([*rows.schema.fields, *StructType.fromDDL(f"calcs {PARSED}").fields])
    kind = to_arrow_type(target["calcs"].dataType)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lists = batch.column(source)
            ends = np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            found = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), parse_all(lists.flatten(), kind.value_type), type=kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, "calcs"])

    return rows.mapInArrow(each, target)


def result_holds(calc: Column) -> Column:
    """Whether the stated result is the recomputed value, at some scale; a percentage may be of a ratio not multiplied out."""
    tried = F.when(calc["percent"], F.array(F.lit(1.0), F.lit(100.0))).otherwise(F.array(*[F.lit(s) for s in RESULT_SCALES]))
    return F.coalesce(F.exists(tried, lambda s: N.close(calc["computed"] * s, calc["stated"], slack=calc["slack"])), F.lit(False))


def verdicts(calcs: Column, known: Column) -> Column:
    """Each calculation with `verified` and the first `reason` against it.

    An operand holds if it is the result of an earlier verified calculation, a constant without tags, or stated by a passage it
    names. known: the passages as array<struct<tag, amounts, caption>>. A fold in the order of the answer.
    """
    kind = "array<struct<line:string,stated:double,percent:boolean,slack:double,computed:double,operands:array<double>,tags:array<string>,verified:boolean,reason:string>>"
    start = F.struct(F.array().cast("array<double>").alias("results"), F.array().cast(kind).alias("out"))

    def reason(o: Column, results: Column) -> Column:
        named = F.filter(known, lambda p: F.array_contains(o["tags"], p["tag"]))
        held = F.exists(named, lambda p: N.stated(o, p["amounts"], p["caption"], operand=True))
        whole = o["value"] * o["scale"]
        return (
            F.when(F.exists(results, lambda r: (r != 0) & N.close(whole, r)), None)
            .when(F.size(o["tags"]) == 0, F.when(~whole.isin(*CONSTANTS), UNCITED))
            .when(F.size(named) == 0, UNKNOWN)
            .when(~held, ABSENT)
        )

    def step(state: Column, c: Column) -> Column:
        against = F.get(F.filter(F.transform(c["operands"], lambda o: reason(o, state["results"])), lambda r: r.isNotNull()), 0)
        why = F.when(F.size(c["operands"]) == 0, UNPARSED).otherwise(F.coalesce(against, F.when(~result_holds(c), MISMATCH).otherwise("")))

        def onward(why: Column) -> Column:
            record = F.struct(
                c["line"], c["stated"], c["percent"], c["slack"], c["computed"], F.transform(c["operands"], lambda o: o["value"] * o["scale"]).alias("operands"),
                F.array_distinct(F.flatten(c["operands"]["tags"])).alias("tags"), (why == "").alias("verified"), why.alias("reason"),
            )
            return F.struct(
                F.when(why == "", F.array_append(state["results"], c["stated"])).otherwise(state["results"]).alias("results"), F.array_append(state["out"], record).alias("out")
            )

        # as an array's element the reason is evaluated once, though it is used four times
        return F.get(F.transform(F.array(why), onward), 0)

    return F.aggregate(calcs, start, step, lambda s: s["out"])


def explains(calc: Column, amount: Column) -> Column:
    """Whether a calculation's stated result is this amount."""
    plain = N.close(calc["stated"], amount["value"], slack=calc["slack"])
    scaled = F.exists(F.array(*[F.lit(s) for s in RESULT_SCALES]), lambda s: N.close(calc["stated"] * s, amount["value"] * amount["scale"], slack=calc["slack"] * s))
    return F.coalesce(F.when(amount["percent"] | calc["percent"], plain).otherwise(scaled), F.lit(False))
