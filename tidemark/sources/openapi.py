"""OpenAPI documents: loading, references, the effective view of schemas, operations, declared fields.

A document is small and is read on the driver; `specifications` parses many of
them on the executors.
"""

import functools
import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import shared

#: Fixed values of the format: methods of a path, JSON types.
METHODS = ["get", "put", "post", "delete", "options", "head", "patch", "trace"]
TYPES = ["string", "integer", "number", "boolean", "null", "object", "array"]
DEPTH, MOST_FIELDS = 6, 300
#: Documents of a task whose rows are held at once.
HELD = 500


def load(text: str) -> dict:
    """JSON where the text starts with a brace, else YAML with JSON's scalars only."""
    if text.lstrip("﻿ \t\r\n").startswith("{"):
        return json.loads(text)
    import yaml

    class Loader(yaml.SafeLoader):
        yaml_implicit_resolvers = {}

    for tag, pattern, first in (
        ("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", "tTfF"), ("int", r"^[-+]?(?:0|[1-9][0-9]*)$", "-+0123456789"),
        ("float", r"^[-+]?(?:\.[0-9]+|(?:0|[1-9][0-9]*)(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?$", "-+.0123456789"), ("null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]), ("merge", r"^<<$", "<"),
    ):
        Loader.add_implicit_resolver(f"tag:yaml.org,2002:{tag}", re.compile(pattern), list(first))
    return yaml.load(text, Loader)


@dataclass
class View:
    """A schema as it acts: own keywords with allOf merged and oneOf/anyOf united; types None: anything."""

    types: frozenset | None = None
    properties: dict = field(default_factory=dict)
    required: frozenset = frozenset()
    items: object = None
    additional: object = None
    enum: tuple | None = None
    read_only: bool = False
    write_only: bool = False
    source: str = ""

    @property
    def open(self) -> bool:
        return self.additional is not None or not self.properties


@dataclass
class Operation:
    method: str
    path: str
    parameters: dict
    body: dict
    body_required: bool
    responses: dict
    has_body: bool

    @property
    def key(self) -> str:
        return f"{self.method} {self.path}"


class NotOpenApi(ValueError):
    """A document that is read but is no OpenAPI 3."""


class Spec:
    def __init__(self, doc: dict):
        if not isinstance(doc, dict) or not str(doc.get("openapi", "")).startswith("3."):
            raise NotOpenApi("not an OpenAPI 3 document")
        self.doc, self.unsupported, self._views = doc, [], {}
        self._refs, self._below = {}, {}  # what references and schemas lead to, unless that is unsupported

    def resolve(self, node, seen=()):
        """(node, name of its last reference) with local references followed."""
        name = ""
        while isinstance(node, dict) and "$ref" in node:
            ref = node["$ref"]
            if ref in self._refs and not seen:
                return self._refs[ref]
            if not ref.startswith("#/") or ref in seen:
                self.unsupported.append(("external reference" if not ref.startswith("#") else "cyclic reference", ref))
                return {}, name
            seen = (*seen, ref)
            at = self.doc
            for part in ref[2:].split("/"):
                part = re.sub("%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), part).replace("~1", "/").replace("~0", "~")
                at = at.get(part) if isinstance(at, dict) else None
            if at is None:
                self.unsupported.append(("dangling reference", ref))
                return {}, name
            node, name = at, ref
        if seen:
            self._refs[seen[0]] = node, name
        return node, name

    def view(self, schema, open_=()) -> View:
        node, name = self.resolve(schema)
        if id(node) in open_:
            return View(source=name)  # a cycle through allOf: nothing more from here
        if id(node) in self._views:
            return self._views[id(node)][1]
        if not isinstance(node, dict):
            return View(source=name)
        open_ = (*open_, id(node))
        t = node.get("type")
        types = None if t is None else frozenset([t] if isinstance(t, str) else t)
        if types is not None and node.get("nullable") is True:
            types |= {"null"}
        if types is None and ("properties" in node or "required" in node):
            types = frozenset(["object"])
        enum = tuple(json.dumps(x) for x in node["enum"]) if isinstance(node.get("enum"), list) else (json.dumps(node["const"]),) if "const" in node else None
        extra = node.get("additionalProperties")
        out = View(types, dict(node.get("properties") or {}), frozenset(node.get("required") or ()), node.get("items"), None if extra is False or extra is None else extra, enum, bool(node.get("readOnly")), bool(node.get("writeOnly")), name)
        for part in node.get("allOf") or ():
            v = self.view(part, open_)
            out.types = v.types if out.types is None else out.types if v.types is None else out.types & v.types
            out.properties = v.properties | out.properties
            out.required |= v.required
            out.items = out.items if out.items is not None else v.items
            out.additional = out.additional if out.additional is not None else v.additional
            out.enum = v.enum if out.enum is None else out.enum if v.enum is None else tuple(x for x in out.enum if x in v.enum)
        for word in ("oneOf", "anyOf"):
            variants = [self.view(p, open_) for p in node.get(word) or ()]
            if not variants:
                continue
            self.unsupported.append((word, name))
            if out.types is None and all(v.types is not None for v in variants):
                out.types = frozenset().union(*(v.types for v in variants))
            for v in variants:
                out.properties = out.properties | {k: s for k, s in v.properties.items() if k not in out.properties}
                out.items = out.items if out.items is not None else v.items
                out.additional = out.additional if out.additional is not None else v.additional
            out.required |= frozenset.intersection(*(v.required for v in variants))
            if out.enum is None and all(v.enum is not None for v in variants):
                out.enum = tuple(dict.fromkeys(x for v in variants for x in v.enum))
        if len(open_) == 1:
            self._views[id(node)] = node, out  # the node stays alive, so that no other one gets its number
        return out

    def operations(self) -> list[Operation]:
        out = []
        for path, item in (self.doc.get("paths") or {}).items():
            item, _ = self.resolve(item)
            if not isinstance(item, dict):
                continue
            for method in METHODS:
                if not isinstance(item.get(method), dict):
                    continue
                op = item[method]
                parameters = {}
                for p in [*(item.get("parameters") or ()), *(op.get("parameters") or ())]:
                    p, _ = self.resolve(p)
                    if "name" in p and "in" in p:
                        schema = p.get("schema") or next((m.get("schema") for m in (p.get("content") or {}).values()), None)
                        parameters[(p["in"], p["name"])] = (schema, p["in"] == "path" or bool(p.get("required")))
                body, _ = self.resolve(op.get("requestBody") or {})
                content = lambda x: {k.split(";")[0].strip().lower(): (v or {}).get("schema") for k, v in (x.get("content") or {}).items()}
                responses = {str(k): content(self.resolve(v)[0]) for k, v in (op.get("responses") or {}).items()}
                out.append(Operation(method.upper(), path, parameters, content(body), bool(body.get("required")), responses, bool(body)))
        return out

    def base_paths(self) -> list[str]:
        found = [re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", "", re.sub(r"\{[^}]*\}", "", s.get("url", ""))).rstrip("/") for s in self.doc.get("servers") or ()]
        return list(dict.fromkeys(p for p in found if p.startswith("/")))

    def flatten(self, schema, direction: str) -> list[tuple[str, View, bool]]:
        """(path, view, required) of all visible fields, parents first."""
        out: list = []

        def walk(s, path, depth, required, on_path):
            if len(out) >= MOST_FIELDS:
                return
            v = self.view(s)
            out.append((path, v, required))
            node = id(self.resolve(s)[0])
            if depth >= DEPTH or node in on_path:
                return
            for suffix, child, needed in self._fields(node, v, direction):
                walk(child, path + suffix, depth + 1, needed, (*on_path, node))

        if schema is not None:
            walk(schema, "$", 0, True, ())
        return out

    def _fields(self, node: int, v: View, direction: str) -> list[tuple]:
        """(suffix of the path, schema, required) of what a schema holds itself."""
        if (node, direction) in self._below:
            return self._below[node, direction]
        known = len(self.unsupported)
        out = [(child_path("", name), child, name in v.required) for name, child in v.properties.items() if visible(self.view(child), direction)]
        if v.items is not None:
            out.append(("[]", v.items, False))
        if isinstance(v.additional, dict):
            out.append((".*", v.additional, False))
        if len(self.unsupported) == known and node in self._views:  # views keep their nodes alive, so that no other one gets its number
            self._below[node, direction] = out
        return out

    def declared(self) -> list[tuple]:
        """Rows (operation, part, status, field, types, required, enum, open)."""
        rows = []
        for op in self.operations():
            def put(part, status, path, v, required, op=op):
                rows.append((op.key, part, status, path, sorted(v.types or ()), required, [json.loads(e) if e.startswith('"') else e for e in v.enum] if v.enum else None, v.open))

            for (where, name), (schema, required) in op.parameters.items():
                put(f"request.{where}", "0", child_path("$", name), self.view(schema or {}), required)
            for schema in json_schema(op.body):
                for path, v, required in self.flatten(schema, "request"):
                    put("request.body", "0", path, v, required)
            for status, content in op.responses.items():
                for schema in json_schema(content):
                    for path, v, required in self.flatten(schema, "response"):
                        put("response.body", status, path, v, required)
        return rows


def json_media(media: str) -> bool:
    return media in ("application/json", "*/*", "application/*") or media.endswith("+json")


def json_schema(content: dict) -> list:
    """The schema of the first JSON media type, if there is one."""
    found = [s for m, s in content.items() if json_media(m)]
    return [s for s in found[:1] if s is not None]


def child_path(parent: str, name: str) -> str:
    return parent + _suffix(name)


@functools.lru_cache(4096)
def _suffix(name: str) -> str:
    if re.fullmatch(r"[A-Za-z0-9_-]+", name):
        return f".{name}"
    return "['" + re.sub(r"(['\\])", r"\\\1", name) + "']"


def visible(v: View, direction: str) -> bool:
    return not (v.read_only if direction == "request" else v.write_only)


DECLARED = "operation string, part string, status string, field string, types array<string>, required boolean, enum array<string>, open boolean"


def tables(spark: SparkSession, spec: Spec) -> dict[str, DataFrame]:
    ops = spec.operations()
    return {
        "declared": spark.createDataFrame(spec.declared(), DECLARED),
        "operations": spark.createDataFrame([(o.key, o.method, o.path) for o in ops], "operation string, method string, path string"),
        "responses": spark.createDataFrame([(o.key, s) for o in ops for s in o.responses], "operation string, answer string"),
    }


#: A document as a graph.  Node 0 is the schema that takes anything; edges go to the schemas of properties, map values and items.
GRAPH = (
    "nodes array<struct<node:int,types:array<string>,enum:array<string>,source:string>>,"
    "edges array<struct<node:int,ord:int,slot:string,name:string,suffix:string,child:int,required:boolean,in_request:boolean,in_response:boolean>>,"
    "slots array<struct<shape:string,operation:string,at:int,ord:int,what:string,part:string,name:string,label:string,status:string,media:string,required:boolean,node:int>>"
)


def graph(spec: Spec) -> dict[str, list[dict]]:
    """Schemas that operations reach, how they hold each other, and the slots of operations that they fill."""
    number: dict[int, int] = {}
    pending: list = []

    def node(schema) -> int:
        if schema is None:
            return 0
        at = id(spec.resolve(schema)[0])
        if at not in number:
            number[at] = len(number) + 1
            pending.append(schema)
        return number[at]

    slots = []
    for i, op in enumerate(spec.operations()):
        names = re.findall(r"\{([^/}]*)\}", op.path)
        found = [("operation", None, None, None, None, None, False, None)]
        found += [("path", "request.path", str(k), n, None, None, True, op.parameters["path", n][0]) for k, n in enumerate(names) if ("path", n) in op.parameters]
        found += [("parameter", f"request.{where}", n, n, None, None, need, schema) for (where, n), (schema, need) in op.parameters.items() if where != "path"]
        if op.has_body:
            found.append(("body", "request.body", None, None, None, None, op.body_required, None))
            found += [("media", "request.body", None, None, None, m, False, schema) for m, schema in op.body.items()]
        for status, content in op.responses.items():
            found.append(("response", "response.body", None, None, status, None, False, None))
            found += [("media", "response.body", None, None, status, m, False, schema) for m, schema in content.items()]
        shape = f"{op.method} " + re.sub(r"\{[^/}]*\}", "{}", op.path)
        for k, (what, part, name, label, status, media, required, schema) in enumerate(found):
            slots.append({"shape": shape, "operation": op.key, "at": i, "ord": k, "what": what, "part": part, "name": name, "label": label, "status": status, "media": media, "required": required, "node": node(schema)})
    nodes, edges, at = [{"node": 0, "types": None, "enum": None, "source": ""}], [], 0
    while at < len(pending):
        v = spec.view(pending[at])
        at += 1
        nodes.append({"node": at, "types": None if v.types is None else sorted(v.types), "enum": None if v.enum is None else list(v.enum), "source": v.source})
        below = [("property", n, child_path("", n), s) for n, s in v.properties.items()]
        below += [("map", "", ".*", v.additional)] * isinstance(v.additional, dict) + [("items", "", "[]", v.items)] * (v.items is not None)
        for k, (slot, name, suffix, schema) in enumerate(below):
            w = spec.view(schema if schema is not None else {})
            edges.append({"node": at, "ord": k, "slot": slot, "name": name, "suffix": suffix, "child": node(schema), "required": slot == "property" and name in v.required, "in_request": visible(w, "request"), "in_response": visible(w, "response")})
    return {"nodes": nodes, "edges": edges, "slots": slots}


def _mapped(documents: DataFrame, key: str, text: str, schema: str, rows) -> DataFrame:
    """key and the columns of schema: rows(text) of each document.  A document is read where its row is; few are held at once."""
    shared.ship(documents.sparkSession)
    kind = documents.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, {schema}"
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, HELD):
                b = whole.slice(at, HELD)
                found = [(k, *r) for k, t in zip(b.column(key).to_pylist(), b.column(text).to_pylist(), strict=True) for r in rows(t)]
                columns = zip(*found, strict=True) if found else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    return documents.select(key, text).mapInArrow(run, schema)


def _graph_row(text: str) -> list[tuple]:
    try:
        g = graph(Spec(load(text or "")))
        return [(g["nodes"], g["edges"], g["slots"], None)]
    except Exception as e:  # one bad document is a row, not the end of a survey
        return [([], [], [], f"{type(e).__name__}: {e}"[:200])]


def _declared_rows(text: str) -> list[tuple]:
    try:
        return Spec(load(text or "")).declared()
    except Exception:  # graphs() has the error
        return []


def graphs(documents: DataFrame, key: str = "spec", text: str = "text") -> DataFrame:
    """One row for each document: key, its graph, or the error that makes it none."""
    return _mapped(documents, key, text, f"{GRAPH}, error string", _graph_row)


def declarations(documents: DataFrame, key: str = "spec", text: str = "text") -> DataFrame:
    """Declared fields of many documents: key and the columns of DECLARED; documents that cannot be read have none."""
    return _mapped(documents, key, text, DECLARED, _declared_rows)


def operations_of(graphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Operations (spec, operation, method, path) and answers (spec, operation, answer) of graphs()."""
    slots = graphs.select("spec", F.explode("slots").alias("x")).select("spec", "x.*")
    operations = slots.where("what = 'operation'").select("spec", "operation", F.split_part("operation", F.lit(" "), F.lit(1)).alias("method"), F.regexp_replace("operation", "^[^ ]* ", "").alias("path"))
    return operations, slots.where("what = 'response'").select("spec", "operation", F.col("status").alias("answer"))


def specifications(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document under a path: file, numbers of operations, fields and unsupported constructs, category (parsed, not OpenAPI 3, unreadable), error."""
    shared.ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for p, c in zip(b["path"], b["content"], strict=True):
                try:
                    s = Spec(load(bytes(c).decode()))
                    n, declared = len(s.operations()), len(s.declared())
                    rows.append((p, n, declared, len(s.unsupported), "parsed", None))
                except Exception as e:  # one bad document is a row, not the end of a survey
                    rows.append((p, 0, 0, 0, "not OpenAPI 3" if isinstance(e, NotOpenApi) else "unreadable", f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=["file", "operations", "fields", "unsupported", "category", "error"])

    return files.mapInPandas(run, "file string, operations long, fields long, unsupported long, category string, error string")
