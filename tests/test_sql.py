import pytest

from orrery import api
from orrery import sql as S
from orrery.sources import store


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    e = [("app/main.py", "app/db.py", "import"), ("app/api.py", "app/main.py", "from"), ("app/db.py", "lib/one/db.py", "import"), ("lib/one/db.py", "app/db.py", "import"), ("tests/t.py", "app/api.py", "import")]
    t = {
        "ast_edges": spark.createDataFrame(e, store.EMPTY["ast_edges"]),
        "llm_edges": spark.createDataFrame([e[0], ("app/main.py", "cfg.toml", "read")], store.EMPTY["llm_edges"]),
        "modules": spark.createDataFrame([("app", "app", "the core's \"heart\"", None, None)], store.EMPTY["modules"]),
        "file_summaries": spark.createDataFrame([("app/db.py", "stores the rows", [("Table", "class", "a table of rows")])], store.EMPTY["file_summaries"]),
        "entry_points": spark.createDataFrame([("app/main.py", "main", "cli", None)], store.EMPTY["entry_points"]),
        "cycles": spark.createDataFrame([(["app/db.py", "lib/one/db.py"], 2, 3.14159, False)], store.EMPTY["cycles"]),
        "quick_reference": spark.createDataFrame([("where are rows stored?", "app/db.py:9")], store.EMPTY["quick_reference"]),
    }
    folder = str(tmp_path_factory.mktemp("map"))
    api.write_and_diff(spark, store.CodeMapTables(t, {"commit_sha": "c" * 40}), folder)
    m = store.load_map(spark, folder)
    S.register(spark, m, "t_")
    return api.CodeMap(m)


def rows(spark, q):
    return sorted(tuple(r) for r in spark.sql(q).collect())


def test_paths_in_sql(spark, written):
    for q in ("app/main.py", "main.py", "db.py", "/home/x/app/db.py", "one", "t", "toml", "./cfg.toml", "nope.py", "API", "app"):
        want = written.resolve(q)
        assert spark.sql(f"SELECT known_path('{q}') AS p").first()["p"] == want, q


def test_questions_equal_the_methods(spark, written):
    for path in ("main.py", "app/db.py", "db.py", "nope"):
        for way in ("both", "out", "in"):
            assert rows(spark, f"SELECT * FROM neighbors('{path}', '{way}')") == sorted(tuple(r) for r in written.neighbors(path, way).collect())
        for transitive in (True, False):
            assert rows(spark, f"SELECT * FROM dependents('{path}', {transitive})") == sorted((r["path"], r["distance"]) for r in written.dependents(path, transitive)[0].collect())
    assert rows(spark, "SELECT * FROM dependents('cfg.toml', true, 9)") == [("app/api.py", 2), ("app/main.py", 1), ("tests/t.py", 3)]
    with pytest.raises(Exception, match="deepest"):
        spark.sql("SELECT * FROM dependents('cfg.toml', true, 2)").collect()
    for question in ("where are rows stored?", "what is the", "tab", "ma", "app/db.py", "Tables of row", "?", "row rows"):
        want = [tuple(r) for r in written.find(question, 3).collect()]
        assert [r[1:] for r in rows(spark, f"SELECT * FROM find('{question}', 3)")] == want, question
    assert rows(spark, "SELECT path FROM search('rows stored', 1)") == [("app/db.py:9",)]


def test_other_functions(spark, written):
    over = dict(rows(spark, "SELECT * FROM overview()"))
    assert over == {"edges": 6, "confirmed": 1, "modules": 1, "file_summaries": 1, "entry_points": 1, "production_cycles": 1, "test_cycles": 0, "quick_reference": 1}
    assert rows(spark, "SELECT * FROM module('app/db.py')") == [("app/db.py", None, None, "stores the rows", 1, 2, 1)]
    assert rows(spark, "SELECT known, name FROM module('app')") == [("app", "app")] and rows(spark, "SELECT * FROM module('nope.py')") == []
    assert rows(spark, "SELECT length, risk_score FROM cycles()") == [(2, 3.14)] and rows(spark, "SELECT name FROM entry_points()") == [("main",)]
    assert rows(spark, f"SELECT staleness('{'c' * 40}'), staleness('{'d' * 40}'), staleness(NULL)") == [("fresh", "stale", "unknown")]


def test_a_map_that_was_not_written(spark):
    m = store.CodeMapTables({"ast_edges": spark.createDataFrame([("a.py", "b.py", "import")], store.EMPTY["ast_edges"])})
    assert set(S.register(spark, m, "u_")) >= {"overview", "module", "neighbors", "dependents", "find", "search", "cycles", "entry_points", "staleness"}
    assert rows(spark, "SELECT * FROM dependents('b.py')") == [("a.py", 1)] and rows(spark, "SELECT * FROM find('b.py')") == []
