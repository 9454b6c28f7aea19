import random
import re

import pytest
from pyspark.sql import functions as F

from orrery.functions.text import REDACTIONS, redact
from orrery.operators import budget
from orrery.plans.contract import _SECRETS, QUERIES, SQL
from tests.oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    same(QUERIES[name](spark, SF), SQL[name], SF)


def test_greedy_budget_against_a_fold(spark):
    rows = sorted((r["source"], r["doc_id"], r["tokens"], r["admitted"], r["running"]) for r in QUERIES["budget_greedy"](spark, SF).collect())
    at, total, skipped = None, 0, 0
    for source, _, tokens, admitted, running in rows:
        if source != at:
            at, total = source, 0
        fits = total + tokens <= 20_000
        total += tokens if fits else 0
        skipped += not fits
        assert (admitted, running) == (fits, total)
    assert rows and len({r[0] for r in rows}) > 1


def test_every_secret_goes(spark):
    """All kinds of secrets, also those that SQL's patterns cannot tell, against Python's own patterns."""
    texts = ["password = hunter2, x", "pwd: none", "PASSWD=true1", "a token: " + "k" * 40, *(r["text"][:2000] + _SECRETS for r in spark.read.parquet(f"{SF}/documents.parquet").limit(20).collect()), "-----END EC PRIVATE KEY----- left", "", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", redact(F.col("t")).alias("r")).collect()
    for r in got:
        want = texts[r["i"]]
        if want is not None:
            for pattern, instead in REDACTIONS:
                want = re.sub(pattern, re.sub(r"\$(\d)", r"\\\1", instead), want)
        assert r["r"] == want
        assert not any(s in (r["r"] or "") for s in ("hunter2", "AKIA", "longpw", "ghp_a", "MIIabc"))


def test_greedy_budget_with_odd_rows(spark):
    """Falling costs that each block once, null costs and groups, one group over several ranges, against a fold."""
    rng = random.Random(3)
    rows = [("falling", i, 1 if i % 2 else 101 - i // 2) for i in range(60)] + [("random", i, rng.randrange(40)) for i in range(400)] + [(None, i, rng.choice([None, 0, 30, 200])) for i in range(20)] + [("dear", 1, 101), ("free", 1, 0)]
    df = spark.createDataFrame(rows, "g string, k int, c int")
    got = {(r["g"], r["k"]): (r["c"], r["admitted"], r["running"]) for r in budget.greedy_within(df, "g", "k", "c", 100).collect()}
    totals = {}
    for g, k, c in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        fits = totals.get(g, 0) + (c or 0) <= 100
        totals[g] = totals.get(g, 0) + ((c or 0) if fits else 0)
        assert got[(g, k)] == (c, fits, totals[g])
    assert len(got) == len(rows)
    assert budget.greedy_within(df.where("false"), "g", "k", "c", 100).count() == 0
