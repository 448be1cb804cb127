"""Answers in JSON as rows, strictly by a schema: a table function whose columns come from the schema.

The schema is JSON Schema's part that services take for strict answers: ``type`` (also a pair with
``null``), ``properties``, ``required``, ``additionalProperties``, ``items`` and ``enum``. It describes
an object with one array of objects; each element of that array is a row: ``item`` (its place, from 0),
a column for each property, ``violations``.

A value that the schema doesn't allow is null and named in ``violations`` by its path, as is a missing
or extra key; an element that is no object is a row of nulls. What is wrong outside the array is a
row of its own, with a null ``item``, and doesn't cost the elements. Null and blank answers have no rows;
text that isn't JSON (also NaN, or nested too deeply to be read) is one row with the violation ``: not JSON``.
Of repeated keys the last counts. An integer may be written as 1.0; numbers beyond 64 bits and strings
that aren't Unicode (half a surrogate pair) are violations. Answers are read one at a time and whole.
Rows come back without Arrow, which makes a batch for each answer and took four times as long.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

Json = dict[str, Any]
PLAIN = {"string": T.StringType(), "number": T.DoubleType(), "integer": T.LongType(), "boolean": T.BooleanType()}
OWN = ("item", "violations")
_HELD = {"string": str, "boolean": bool, "array": list, "object": dict}


def _of(kind: str, **properties: Json) -> Json:
    return {"type": kind, "properties": properties, "required": list(properties), "additionalProperties": False}


_TEXT = {"type": "string"}
#: The fields of an extracted place, of which only the name may be null.
PLACES = _of("object", places={"type": "array", "items": _of(
    "object", name={"type": ["string", "null"]}, city=_TEXT, neighborhood=_TEXT, address=_TEXT,
    category=_TEXT, description=_TEXT, creator_handle=_TEXT, confidence={"type": "number"},
)})


@lru_cache(maxsize=64)
def _kind_of(said: Any) -> tuple[str, bool]:
    kinds = said if isinstance(said, tuple) else (said,)
    plain = [k for k in kinds if k != "null"]
    if len(plain) != 1 or plain[0] not in (*PLAIN, "object", "array"):
        raise ValueError(f"a schema needs one type beside null, not {list(said) if isinstance(said, tuple) else said}")
    return plain[0], len(kinds) > 1


def _kind(schema: Json) -> tuple[str, bool]:
    """A schema's type, and whether it may be null."""
    said = schema.get("type")
    return _kind_of(tuple(said) if isinstance(said, list) else said)


def data_type(schema: Json) -> T.DataType:
    """The column type of a schema."""
    kind, _ = _kind(schema)
    if kind == "array":
        return T.ArrayType(data_type(schema["items"]))
    if kind == "object":
        return T.StructType([T.StructField(k, data_type(v)) for k, v in schema["properties"].items()])
    return PLAIN[kind]


def _list_of(schema: Json) -> tuple[str, Json]:
    """The name of a schema's array of objects, and the schema of its elements."""
    lists = [(k, v["items"]) for k, v in schema.get("properties", {}).items() if _kind(v)[0] == "array" and _kind(v["items"])[0] == "object"]
    if _kind(schema)[0] != "object" or len(lists) != 1:
        raise ValueError("the schema must be of an object with one array of objects")
    if clash := set(OWN) & set(lists[0][1]["properties"]):
        raise ValueError(f"properties can't be named {sorted(clash)}")
    return lists[0]


def _shown(key: str) -> str:
    """A key as a step of a path: what can't be in UTF-8 is escaped, as are the signs that paths use."""
    return key.replace("~", "~0").replace("/", "~1").encode("utf-8", "backslashreplace").decode()


_step = lru_cache(maxsize=1024)(_shown)  # of a schema's keys


def _number(value: Any, kind: str) -> Any:
    """A number as its column holds it; None if it isn't one, NaN if the column can't hold it."""
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return None
    if kind == "number":
        try:
            return float(value) if math.isfinite(float(value)) else math.nan
        except OverflowError:
            return math.nan
    if isinstance(value, float) and not math.isfinite(value):
        return math.nan
    if value != int(value):
        return None
    return int(value) if -(1 << 63) <= int(value) < 1 << 63 else math.nan


def checked(value: Any, schema: Json, path: str, wrong: list[str]) -> Any:
    """A value as its column holds it, or None; what is wrong is appended."""
    kind, may_be_null = _kind(schema)
    if value is None:
        if not may_be_null:
            wrong.append(f"{path}: null")
        return None
    if kind in ("number", "integer"):
        out = _number(value, kind)
        if out is None or out != out:
            wrong.append(f"{path}: not a {kind}" if out is None else f"{path}: out of range")
            return None
    elif not isinstance(value, _HELD[kind]):
        wrong.append(f"{path}: not a {kind}")
        return None
    elif kind == "array":
        out = [checked(v, schema["items"], f"{path}/{k}", wrong) for k, v in enumerate(value)]
    elif kind == "object":
        out = tuple(members(value, schema, path, wrong).values())
    else:
        out = value
        if kind == "string" and not value.isascii() and any("\ud800" <= c <= "\udfff" for c in value):
            wrong.append(f"{path}: not Unicode")
            return None
    if "enum" in schema and value not in schema["enum"]:
        wrong.append(f"{path}: not one of the values")
        return None
    return out


def members(value: Json, schema: Json, path: str, wrong: list[str], skip: str | None = None) -> Json:
    """An object's properties as their columns hold them; ``skip`` is left for later."""
    known, out = schema["properties"], {}
    for k, s in known.items():
        if k in value:
            v = value[k]
            if type(v) is str and s.get("type") == "string" and v.isascii() and "enum" not in s:
                out[k] = v  # as most are
                continue
            out[k] = None if k == skip else checked(v, s, f"{path}/{_step(k)}", wrong)
        else:
            out[k] = None
            if k in schema.get("required", ()):
                wrong.append(f"{path}/{_step(k)}: missing")
    if schema.get("additionalProperties") is False and not value.keys() <= known.keys():
        wrong += [f"{path}/{_shown(k)}: not allowed" for k in sorted(value.keys() - known.keys())]
    return out


def _refused(text: str) -> Any:
    raise ValueError(text)


_DECODER = json.JSONDecoder(parse_constant=_refused)


@dataclass
class Shape(AnalyzeResult):
    """What ``analyze`` found out once, for every task."""

    asked: Json = field(default_factory=dict)
    keep_empty: bool = False
    refuse: bool = False


class Extract:
    """``extract(answer, schema, keep_empty, refuse)``: see the module. With ``refuse`` an answer with a violation has no rows.

    With ``keep_empty`` an answer without rows has one of nulls without violations; a left lateral join
    would drop it, as Spark 4.1 runs Python's table functions as inner joins.
    """

    def __init__(self, shape: Shape):
        self.asked, self.keep_empty, self.refuse = shape.asked, shape.keep_empty, shape.refuse
        self.name, self.element = _list_of(shape.asked)
        self.columns = list(self.element["properties"])

    @staticmethod
    def analyze(answer: AnalyzeArgument, schema: AnalyzeArgument, keep_empty: AnalyzeArgument | None = None, refuse: AnalyzeArgument | None = None) -> Shape:
        if not isinstance(answer.dataType, T.StringType):
            raise ValueError("the answer must be a string")
        if not schema.isConstantExpression or not isinstance(schema.value, str):
            raise ValueError("the schema must be a constant string")
        if keep_empty is not None and not isinstance(keep_empty.value, bool):
            raise ValueError("keep_empty must be a constant boolean")
        if refuse is not None and not isinstance(refuse.value, bool):
            raise ValueError("refuse must be a constant boolean")
        asked = json.loads(schema.value)
        columns = [T.StructField(k, data_type(v)) for k, v in _list_of(asked)[1]["properties"].items()]
        kind = T.StructType([T.StructField("item", T.IntegerType()), *columns, T.StructField("violations", T.ArrayType(T.StringType()))])
        return Shape(schema=kind, asked=asked, keep_empty=keep_empty is not None and keep_empty.value, refuse=refuse is not None and refuse.value)

    def eval(self, answer: str, schema: str, keep_empty: bool = False, refuse: bool = False) -> Iterator[tuple]:
        rows, told = 0, self._rows(answer) if answer is not None and answer.strip() else ()
        if self.refuse:
            told = list(told)
            told = () if any(row[-1] for row in told) else told
        for row in told:
            rows += 1
            yield row
        if self.keep_empty and not rows:
            yield (None, *[None] * len(self.columns), [])

    def _rows(self, answer: str) -> Iterator[tuple]:
        nothing = [None] * len(self.columns)
        try:
            value = _DECODER.decode(answer)
        except (ValueError, RecursionError):
            yield (None, *nothing, [": not JSON"])
            return
        outside: list[str] = []
        if isinstance(value, dict):
            members(value, self.asked, "", outside, skip=self.name)
        else:
            outside.append(": not a object")
        elements = value.get(self.name) if isinstance(value, dict) else None
        if isinstance(value, dict) and self.name in value and not isinstance(elements, list):
            checked(elements, self.asked["properties"][self.name], f"/{_shown(self.name)}", outside)
        if outside:
            yield (None, *nothing, outside)
        for k, one in enumerate(elements if isinstance(elements, list) else []):
            path, wrong = f"/{_step(self.name)}/{k}", []
            if isinstance(one, dict):
                yield (k, *members(one, self.element, path, wrong).values(), wrong)
            else:
                checked(one, self.element, path, wrong)
                yield (k, *nothing, wrong)


def register(spark: SparkSession, name: str = "extract_items") -> None:
    """The table function for SQL: ``FROM posts, LATERAL extract_items(answer, '<schema>')``."""
    spark.udtf.register(name, F.udtf(Extract, useArrow=False))


def extracted(posts: DataFrame, answer: str = "answer", schema: Json = PLACES, keep: list[str] | None = None, keep_empty: bool = False, refuse: bool = False) -> DataFrame:
    """``keep`` (all but the answer) of each post with the rows of its answer; ``keep_empty`` keeps posts whose answer has none, with nulls.

    With ``refuse`` one fault refuses its whole answer, in the task that reads it; ``strict`` does so for all answers of a key.

    A column to keep that is named as one of the rows' own raises ValueError.
    """
    kept = [c for c in posts.columns if c != answer] if keep is None else keep
    own = [OWN[0], *_list_of(schema)[1]["properties"], OWN[1]]
    if clash := sorted(set(kept) & set(own)):
        raise ValueError(f"columns can't be named {clash}")
    table = F.udtf(Extract, useArrow=False)
    asked = posts.select(*kept, F.col(answer).alias("__answer__"))
    return asked.lateralJoin(table(F.col("__answer__").outer(), F.lit(json.dumps(schema)), F.lit(keep_empty), F.lit(refuse))).select(*kept, *own)


def strict(rows: DataFrame, key: str) -> DataFrame:
    """The rows of answers without any violation, as a strict service gives them: one fault refuses the whole answer."""
    faulty = rows.where(F.size("violations") > 0).select(F.col(key).alias("__key__")).distinct()
    return rows.join(faulty, F.col(key).eqNullSafe(F.col("__key__")), "left_anti").where("item IS NOT NULL").drop("violations")
