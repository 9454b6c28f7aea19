import random

from orrery.operators import resolve


def plain(known, query, most):
    """The tiers, path by path."""
    q = query.replace("\\", "/")
    while q.startswith("./"):
        q = q[2:]
    paths = sorted(set(known))
    if q in paths:
        return 0, q, []
    ends = [p for p in paths if p.endswith("/" + q)]
    if ends:
        return 1, *((ends[0], []) if len(ends) == 1 else (None, ends[:most]))
    longer = sorted((p for p in paths if q.endswith("/" + p)), key=len)
    if longer:
        return 2, longer[-1], []
    inside = [p for p in paths if q.lower() in p.lower()] if "." not in q.rsplit("/", 1)[-1] else []
    if not inside:
        return None, None, []
    return 3, *((inside[0], []) if len(inside) == 1 else (None, inside[:most]))


def check(spark, known, queries, most=20):
    k = spark.createDataFrame([(p,) for p in known], "path string")
    q = spark.createDataFrame(list(enumerate(queries)), "qid int, query string")
    got = {r["qid"]: (r["tier"], r["path"], r["candidates"]) for r in resolve.resolve_paths(resolve.path_index(k, most), q, most).collect()}
    for i, query in enumerate(queries):
        assert got[i] == (plain([p for p in known if p is not None], query, most) if query is not None else (None, None, [])), query
    assert len(got) == len(queries)
    index = {n: t.cache() for n, t in resolve.path_index(k, most).items()}
    for i, query in enumerate(queries[:12]):
        if query is not None:
            tier, path, names = got[i]
            assert resolve.resolve_string(index, query, most) == ([path] if path is not None else names), query
    return {t for t, _, _ in got.values()}


def test_all_tiers_against_loops(spark):
    known = ["app/core.py", "app/cli.py", "lib/cli.py", "app", "src/Deep/Name.py", "core.py", "x/core.py", "/abs/one", "dir/", "ÄÖ/ü.py", None, "app"]
    queries = ["app/cli.py", "cli.py", "core.py", "/r/app/core.py", "deep", "DEEP/name", "nope.py", "", None, ".", "./app", "././x\\core.py", "one", "p", "pp", "q/x/y/core.py", "äö", "dir/", "r", "abs/one", "/abs/one", "app", "py", "z" * 50, "a/"]
    assert check(spark, known, queries) == {0, 1, 2, 3, None}
    check(spark, [], queries)
    check(spark, known, [])


def test_random_paths_against_loops(spark):
    rng = random.Random(2)
    part = lambda: "".join(rng.choice("aAbB.") for _ in range(rng.randrange(1, 4)))
    path = lambda: "/".join(part() for _ in range(rng.randrange(1, 5)))
    assert check(spark, [path() for _ in range(150)], [path() for _ in range(200)] + [part() for _ in range(60)], 5) == {0, 1, 2, 3, None}


def test_a_common_ending_is_counted_but_not_gathered(spark):
    k = spark.createDataFrame([(f"d{i:04}/main.py",) for i in range(500)] + [("main.py",)], "path string")
    rows = {r["ending"]: r for r in resolve.path_index(k)["path_endings"].collect()}
    assert rows["main.py"]["n"] == 501 and rows["main.py"]["whole"] and len(rows["main.py"]["paths"]) == 20
