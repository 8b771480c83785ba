"""Route matching against a plain walker, on generated templates and paths."""

import random
import re
import time

from pyspark.sql import functions as F

from tidemark.operators import routes

PIECES = ["a", "b", "me", "x-y", "{id}", "{id}", "{n}.json", "v{n}", "{f}-{t}", "", "é"]
WORDS = ["a", "b", "me", "x-y", "7", "q.json", "v9", "v", "3-4", "-", "", "{*}", "é", "v1.json"]


def split(path):
    path = path[1:] if path.startswith("/") else path
    path = path[:-1] if path.endswith("/") else path
    return path.split("/") if path else []


def walk(operations, method, segments):
    """The operation by trying literal, mixed and parameter segments in turn, and going back from dead ends."""

    def kind(s):
        return 0 if "{" not in s else 2 if re.fullmatch(r"\{[^{}]*\}", s) else 1

    def step(alive, at):
        # alive: templates that agree so far up to the names of their parameters
        if at == len(segments):
            return next((f"{m} {t}" for m, t in alive if len(split(t)) == at and m == method), None)
        s, ways = segments[at], {}
        for m, t in alive:
            if len(split(t)) > at:
                ways.setdefault(re.sub(r"\{[^}]*\}", "{}", split(t)[at]), []).append((m, t))
        order = sorted(ways, key=lambda b: (kind(b), -len(b.replace("{}", "")) if kind(b) == 1 else 0))
        for b in order:
            pattern = ".+?".join(map(re.escape, b.split("{}")))
            fits = s == b if kind(b) == 0 else bool(re.fullmatch(pattern, s)) if kind(b) == 1 else s != ""
            if fits and (s != "{*}" or kind(b) == 2):
                found = step(ways[b], at + 1)
                if found:
                    return found
        return None

    return step(operations, 0)


def expected(operations, bases, method, path):
    path = re.split("[?#]", path)[0]
    path = path if path.startswith("/") else "/" + path
    for b in sorted(bases, key=len, reverse=True):
        if path == b or path.startswith(b + "/"):
            found = walk(operations, method.upper(), split(path[len(b) :]))
            if found:
                return found
    return walk(operations, method.upper(), split(path))


def test_generated_routes(spark):
    rng = random.Random(5)
    for n, bases in ((12, []), (60, ["/v1", "/v1/a"]), (200, ["/b"])):
        operations = list(dict.fromkeys((rng.choice(["GET", "POST"]), "/" + "/".join(rng.choices(PIECES, k=rng.randrange(4)))) for _ in range(n)))
        paths = [(rng.choice(["GET", "get", "Post", "PUT"]), rng.choice(["/", "", "/v1/", "/v1/a/", "/b/"]) + "/".join(rng.choices(WORDS, k=rng.randrange(5))) + rng.choice(["", "", "/", "?q=/a", "#a/b"])) for _ in range(1500)]
        got = routes.match(spark.createDataFrame(paths, "method string, path string"), routes.build_routes(operations, bases)).collect()
        wrong = [(tuple(r), w) for r in got if (w := expected(operations, bases, r["method"], r["path"])) != r["op_key"]]
        assert not wrong, wrong[:5]
        assert sum(r["op_key"] is not None for r in got) > 100


def test_named_operations(spark):
    r = routes.build_routes([("GET", "/a/{id}"), ("POST", "/a")])
    rows = [("GET /a/{id}", "PUT", None), ("GET /a/{other}", "PUT", None), ("GET /z", "GET", None), (None, "post", "/a"), (None, "GET", "/z")]
    got = routes.resolve(spark.createDataFrame(rows, "operation string, method string, path string"), r).collect()
    assert [x["op_key"] for x in got] == ["GET /a/{id}", "GET /a/{id}", None, "POST /a", None]


def test_many_routes_cost_as_few(spark):
    few = [("GET", f"/r{i}/{{id}}/part") for i in range(5)]
    many = few + [("GET", f"/r{i}/{{id}}/{'part' if i % 2 else 'whole'}") for i in range(5, 5000)]
    paths = spark.range(200_000, numPartitions=8).select(F.lit("GET").alias("method"), F.concat(F.lit("/r"), F.pmod("id", F.lit(5)), F.lit("/"), "id", F.lit("/part")).alias("path")).cache()
    assert paths.count() == 200_000

    def seconds(operations):
        df, best = routes.match(paths, routes.build_routes(operations)), 1e9
        for _ in range(3):
            start = time.time()
            assert df.where("op_key IS NULL").isEmpty()
            best = min(best, time.time() - start)
        return best

    seconds(few)
    assert seconds(many) < 3 * seconds(few) + 0.5
    plan = routes.match(paths, routes.build_routes(many))._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan.lower() and "Join" not in plan
