"""Route matching: a trie of templates, walked by segment.

The trie is one constant of the plan, as large as a specification.  A row's path is cut in segments; at each
the row keeps the nodes it may have come to, best first: below each node the equal literal, then segments mixed of
literals and parameters, those with more literal signs first, then the parameter.  Of the nodes at the end the first
that has the method decides, so that a dead end never hides another way.  A literal is found by its
checksum among the children of its node: the work of a row does not grow with the number of routes.
"""

import json
import re
import zlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: how a redacted segment looks; it fits parameters only.
REDACTED = "{*}"
_NODE = "array<struct<l:array<array<struct<s:string,c:int>>>,m:array<struct<p:string,c:int>>,p:int,o:array<struct<m:string,k:string>>>>"


def segments_of(path: str) -> list[str]:
    path = path.removeprefix("/").removesuffix("/")
    return path.split("/") if path else []


@dataclass
class _Node:
    literals: dict = field(default_factory=dict)
    mixed: dict = field(default_factory=dict)  # blank template: (literal signs, pattern, child)
    parameter: int | None = None
    operations: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Routes:
    """What build_routes makes: the trie as JSON, base paths longest first, keys of all operations."""

    trie: str
    bases: tuple
    keys: tuple


def build_routes(operations: list[tuple[str, str]], base_paths: list[str] = ()) -> Routes:
    """operations: (method, template) in their order; of two that fit the same requests the first stays."""
    nodes = [_Node()]

    def fresh() -> int:
        nodes.append(_Node())
        return len(nodes) - 1

    for method, template in operations:
        at = 0
        for s in segments_of(template):
            n = nodes[at]
            if "{" not in s:
                at = n.literals[s] if s in n.literals else n.literals.setdefault(s, fresh())
            elif re.fullmatch(r"\{[^{}]*\}", s):
                if n.parameter is None:
                    n.parameter = fresh()
                at = n.parameter
            else:
                blank = re.sub(r"\{[^}]*\}", "{}", s)
                if blank not in n.mixed:
                    parts = blank.split("{}")
                    # `.` leaves out line ends, as a full match does.
                    n.mixed[blank] = (sum(map(len, parts)), "^" + "(.+?)".join(re.escape(p) for p in parts) + r"\z", fresh())
                at = n.mixed[blank][2]
        nodes[at].operations.setdefault(method.upper(), f"{method} {template}")
    out = []
    for n in nodes:
        buckets: list[list] = [[] for _ in range(1 << max(len(n.literals) - 1, 0).bit_length())] if n.literals else []
        for s, c in n.literals.items():
            buckets[zlib.crc32(s.encode()) % len(buckets)].append({"s": s, "c": c})
        mixed = [{"p": p, "c": c} for _, p, c in sorted(n.mixed.values(), key=lambda x: -x[0])]
        out.append({"l": buckets, "m": mixed, "p": n.parameter, "o": [{"m": m, "k": k} for m, k in n.operations.items()]})
    bases = sorted(dict.fromkeys(b.rstrip("/") for b in base_paths if b.rstrip("/")), key=lambda b: -len(b))
    return Routes(json.dumps(out, separators=(",", ":")), tuple(bases), tuple(f"{m} {t}" for m, t in operations))


def _segments(path: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(path, "^/", ""), r"/\z", "")
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "/", -1))


def operation_of(routes: Routes, method: Column, path: Column) -> Column:
    """Key of the operation that a request of this method and path calls; null where nothing fits."""
    clean = F.regexp_replace(F.regexp_replace(path, r"(?s)[?#].*$", ""), "^/?", "/")

    def found(trie: Column) -> Column:
        under = [F.when((clean == b) | clean.startswith(b + "/"), _find(trie, method, F.substr(clean, F.lit(len(b) + 1)))) for b in routes.bases]
        return F.coalesce(*under, _find(trie, method, clean))

    # Folded to one constant, which stands in the plan once.
    return F.get(F.transform(F.array(F.from_json(F.lit(routes.trie), _NODE)), found), F.lit(0))


def _find(trie: Column, method: Column, path: Column) -> Column:
    ends = F.aggregate(_segments(path), F.array(F.lit(0)), lambda states, s: F.flatten(F.transform(states, lambda state: _children(F.get(trie, state), s))))
    keys = F.flatten(F.transform(ends, lambda state: F.transform(F.filter(F.get(trie, state)["o"], lambda o: o["m"] == F.upper(method)), lambda o: o["k"])))
    return F.get(keys, F.lit(0))


def _children(node: Column, s: Column) -> Column:
    """The nodes below one that a segment leads to, best first."""
    literals, none = node["l"], F.array().cast("array<int>")
    bucket = F.get(literals, F.pmod(F.crc32(s.cast("binary")), F.greatest(F.size(literals), F.lit(1))).cast("int"))
    literal = F.transform(F.filter(F.coalesce(bucket, F.array().cast("array<struct<s:string,c:int>>")), lambda x: x["s"] == s), lambda x: x["c"])
    mixed = F.transform(F.filter(node["m"], lambda x: F.rlike(s, x["p"])), lambda x: x["c"])
    parameter = F.when(node["p"].isNotNull() & (s != ""), F.array(node["p"])).otherwise(none)
    return F.when(s == REDACTED, parameter).otherwise(F.concat(literal, mixed, parameter))


def match(targets: DataFrame, routes: Routes, method: str = "method", path: str = "path") -> DataFrame:
    """targets with op_key, null where nothing fits."""
    return targets.withColumn("op_key", operation_of(routes, F.col(method), F.col(path)))


def resolve(events: DataFrame, routes: Routes) -> DataFrame:
    """events with op_key: the named operation, else its template matched again, else the path."""
    known = F.col("operation").isin(list(routes.keys))
    method = F.coalesce(F.when(~known, F.split_part("operation", F.lit(" "), F.lit(1))), F.col("method"))
    path = F.coalesce(F.when(~known, F.regexp_replace(F.regexp_replace("operation", "^[^ ]* ", ""), r"\{[^/}]*\}", REDACTED)), F.col("path"))
    return events.withColumn("op_key", F.when(known, F.col("operation")).otherwise(operation_of(routes, method, path)))


def unmatched_label():
    return F.coalesce("operation", F.concat_ws(" ", "method", "path"))
