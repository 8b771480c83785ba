"""Field paths, types and enum values of JSON texts, in one pass over each text.

A text is walked depth first in its own order, as a parser reads it: of names that repeat in an object the last
value counts, integers are integers whatever their size, and what follows the first value is ignored.
Spark's own JSON functions sort names, refuse repeated ones and turn long integers to
doubles, so the walk is a function over Arrow batches; rows stay where they are, and no row needs another one.
"""

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..sources import shared
from ..sources.openapi import Spec, child_path, graph, json_media

#: Levels below the root, paths of a body, values of a field.
DEPTH, MOST_PATHS, MOST_VALUES = 10, 500, 16
SHAPE = "fields array<struct<path:string,types:array<string>,values:array<string>>>, truncated boolean"


class _Integer(str):
    """An integer's literal."""


def _constant(name: str):
    raise ValueError(name)


_DECODER = json.JSONDecoder(parse_int=_Integer, parse_constant=_constant)


def parsed(text: str):
    """(found, value) of the first JSON value of a text."""
    try:
        return True, _DECODER.raw_decode(text.lstrip(" \t\r\n"))[0]
    except (ValueError, RecursionError):
        return False, None


#: Types that say all; floats depend on their value.
_KINDS = {type(None): "null", bool: "boolean", _Integer: "integer", str: "string", dict: "object", list: "array"}


def type_of(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, _Integer):
        return "integer"
    if isinstance(v, float):
        return "integer" if v.is_integer() else "number"
    return "string" if isinstance(v, str) else "object" if isinstance(v, dict) else "array"


class Bodies:
    """The schemas of a specification's bodies as a graph to walk along."""

    def __init__(self, spec: Spec):
        g = graph(spec)
        self.below: dict[int, dict] = {}
        for e in g["edges"]:
            self.below.setdefault(e["node"], {})[e["slot"], e["name"]] = e["child"]
        self.enums = {n["node"] for n in g["nodes"] if n["enum"] is not None}
        self.roots: dict[tuple, int] = {}
        for s in g["slots"]:
            if s["what"] == "media" and json_media(s["media"]):
                self.roots.setdefault((s["operation"], s["status"]), s["node"])
        self.answers = {(s["operation"], s["status"]) for s in g["slots"] if s["what"] == "response"}
        #: Query parameters that are enums, or arrays of them.
        kept = [s for s in g["slots"] if s["what"] == "parameter" and s["part"] == "request.query"]
        self.queries = [(s["operation"], child_path("$", s["label"])) for s in kept if s["node"] in self.enums or self.below.get(s["node"], {}).get(("items", "")) in self.enums]

    def root(self, operation: str | None, code: str | None) -> int | None:
        """The schema of an operation's request (no code), or of the answer that declares a status."""
        if code is None:
            return self.roots.get((operation, None))
        for a in (code, f"{code[:1]}XX", f"{code[:1]}xx", "default"):
            if (operation, a) in self.answers:
                return self.roots.get((operation, a))
        return None

    def child(self, node: int | None, name: str | None) -> int | None:
        below = self.below.get(node, {})
        return below.get(("items", "")) if name is None else below.get(("property", name), below.get(("map", "")))


def shape_of(text: str | None, depth: int = DEPTH, most: int = MOST_PATHS, bodies: Bodies | None = None, root: int | None = None) -> tuple[list | None, bool]:
    """Fields (path, types, values) of a text and whether some were left out; None where it is no JSON."""
    found, value = parsed(text) if text is not None else (False, None)
    if not found:
        return None, False
    types: dict[str, set] = {}
    values: dict[str, dict] = {}
    cut = False
    stack = [(value, root, "$", 0)]
    while stack:
        v, node, path, level = stack.pop()
        seen = types.get(path)
        if seen is None:
            if len(types) >= most:
                cut = True
                continue
            seen = types[path] = set()
        kind = _KINDS.get(type(v)) or type_of(v)
        seen.add(kind)
        if kind in ("object", "array"):
            if level >= depth:
                cut = cut or bool(v)
            elif kind == "object":
                below = level + 1
                if bodies:
                    stack.extend([(w, bodies.child(node, k), child_path(path, k), below) for k, w in reversed(v.items())])
                else:
                    stack.extend([(w, None, child_path(path, k), below) for k, w in reversed(v.items())])
            else:
                inner = bodies.child(node, None) if bodies else None
                stack.extend([(w, inner, path + "[]", level + 1) for w in reversed(v)])
        elif kind != "null" and bodies and node in bodies.enums:
            kept = values.setdefault(path, {})
            if len(kept) < MOST_VALUES:
                kept[str(v).lower() if kind == "boolean" else str(v)] = None
    return [{"path": p, "types": sorted(t), "values": list(values[p]) if p in values else None} for p, t in types.items()], cut


def with_shape(df: DataFrame, body: str, out: str, spec: Spec | None = None, operation: Column | None = None, code: Column | None = None, depth: int = DEPTH, most: int = MOST_PATHS) -> DataFrame:
    """df with `out`: struct of fields (path, types, values) and truncated; null where the text is no JSON.

    Of fields that the specification declares as enums, for this operation's request or its answer to
    `code`, the first MOST_VALUES values are kept.  The first `most` paths stay; what lies deeper
    than `depth` is left out; either sets truncated.
    """
    shared.ship(df.sparkSession)
    bodies = Bodies(spec) if spec else None

    kind = to_arrow_type(StructType.fromDDL(SHAPE))

    def run(text: pa.Array, op: pa.Array, status: pa.Array) -> pa.Array:
        made, rows, at = {}, [], []  # equal shapes of a batch become Arrow values once
        for t, o, s in zip(text.to_pylist(), op.to_pylist(), status.to_pylist(), strict=True):
            fields, cut = shape_of(t, depth, most, bodies, bodies.root(o, s) if bodies else None)
            same = cut, None if fields is None else tuple([(f["path"], *f["types"], None if f["values"] is None else tuple(f["values"])) for f in fields])
            if same not in made:
                made[same] = len(rows)
                rows.append({"fields": fields, "truncated": cut})
            at.append(made[same])
        return pa.array(rows, kind).take(pa.array(at, pa.int64()))

    blank = F.lit(None).cast("string")
    shape = F.arrow_udf(run, SHAPE)(F.col(body), operation if operation is not None else blank, code.cast("string") if code is not None else blank)
    return df.withColumn(out, shape).withColumn(out, F.when(F.col(out)["fields"].isNotNull(), F.col(out)))


def shapes(df: DataFrame, key: str, body: str, depth: int = DEPTH, most: int = MOST_PATHS) -> DataFrame:
    """Rows (key, path, types) for every field path of a JSON text; texts that are no JSON give no rows."""
    fields = with_shape(df.select(key, body), body, "_shape", depth=depth, most=most)
    return fields.select(key, F.explode("_shape.fields").alias("f")).select(key, "f.path", "f.types")
