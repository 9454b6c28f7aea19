import random

from orrery.functions.lineage import cut
from orrery.sources.edges import import_edges
from orrery.streaming import refresh

FILES = "path string, lang string, raw string"
#: Texts that ask for files beside them, under roots, in directories, for modules of a crate, and for nothing.
TEXTS = {
    "python": ["import pkg.one\n", "from pkg import two\n", "from . import near\nimport far\n", "from pkg.one import x\n", ""],
    "go": ['package a\nimport "example.com/m/store"\n', "package b\n"],
    "rust": ["use crate::grid::cell;\nmod grid;\n", "pub fn f() {}\n", "use super::grid;\n"],
    "java": ["package org.app;\nimport org.app.Other;\n", "package org.app;\n"],
}
NAMES = {
    "python": ["pkg/__init__.py", "pkg/one.py", "pkg/two.py", "src/pkg/__init__.py", "src/pkg/one.py", "src/far.py", "far.py", "near.py", "pkg/near.py", "src/__init__.py"],
    "go": ["m/store/a.go", "m/store/b.go", "store/c.go", "cmd/main.go"],
    "rust": ["r/src/lib.rs", "r/src/grid.rs", "r/src/grid/cell.rs", "r/src/main.rs"],
    "java": ["src/main/java/org/app/Main.java", "src/main/java/org/app/Other.java", "org/app/Other.java"],
}


def rows(df):
    return sorted(tuple(r) for r in df.select("src", "dst", "kind", "pos").collect())


def materialised(state):
    return {n: cut(t) for n, t in state.items()}


def test_many_batches_equal_a_full_rebuild(spark):
    rng = random.Random(7)
    there, state = {}, refresh.no_files(spark)
    for turn in range(6):
        batch = {}
        for _ in range(1 if turn == 4 else rng.randrange(3, 9)):
            lang = rng.choice(list(NAMES))
            batch[rng.choice(NAMES[lang])] = (lang, None if rng.random() < 0.3 else rng.choice(TEXTS[lang]))
        changes = spark.createDataFrame([(p, lang, raw) for p, (lang, raw) in batch.items()], FILES)
        old = rows(state["edges"])
        state, told = refresh.advanced(state, changes)
        state, told = materialised(state), {tuple(r) for r in told.collect()}
        for p, (lang, raw) in batch.items():
            there.pop(p, None)
            if raw is not None:
                there[p] = (p, lang, raw)
        want = rows(import_edges(spark.createDataFrame(list(there.values()), FILES))[0]) if there else []
        assert rows(state["edges"]) == want, turn
        a, b = {r[:3] for r in old}, {r[:3] for r in want}
        assert told == {("added", " -> ".join(r)) for r in b - a} | {("removed", " -> ".join(r)) for r in a - b}
    again, told = refresh.advanced(state, changes)
    assert told.count() == 0 and rows(again["edges"]) == rows(state["edges"])


def test_a_small_batch_parses_and_resolves_little(spark, monkeypatch):
    n = 20_000
    files = spark.range(n).selectExpr("concat('d', id % 100, '/m', id, '.py') as path", "'python' as lang", "concat('import d', (id + 1) % 100, '.m', (id + 1) % 20000, '\n') as raw")
    state = materialised(refresh.advanced(refresh.no_files(spark), files)[0])
    assert state["edges"].count() == n
    parsed, resolved = [], []
    parse, resolve = refresh.import_targets, refresh.resolved_edges
    monkeypatch.setattr(refresh, "import_targets", lambda f: parsed.append(f.count()) or parse(f))
    monkeypatch.setattr(refresh, "resolved_edges", lambda t, k: resolved.append(t.select("src").distinct().count()) or resolve(t, k))
    changes = spark.createDataFrame([(f"d{i}/m{i}.py", "python", "import d50.m50\n") for i in range(9)] + [("d50/m50.py", "python", None)], FILES)
    state, told = refresh.advanced(state, changes)
    # Nine files that changed, and the one that imports the file that went.
    assert parsed == [9] and resolved == [10]
    assert told.count() == 11 and state["edges"].count() == n - 11
