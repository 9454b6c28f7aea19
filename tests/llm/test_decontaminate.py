from orrery.llm.decontaminate import contaminated, decontaminated
from orrery.llm.queries import OP3_SQL, op3_benchmark_decontamination

from tests.oracle import same


def test_query_against_sql(spark, sf_dir):
    assert same(op3_benchmark_decontamination(spark, sf_dir), OP3_SQL, sf_dir) > 0


def test_threshold_and_short_items(spark):
    item = [f"w{i}" for i in range(29)]  # 25 shingles
    broken = [*item[:2], "x", *item[3:]]  # misses 3
    worse = [*item[:9], "x", "y", *item[11:]]  # misses 6
    pad = [f"p{i}" for i in range(30_000)]
    docs = [(1, " ".join(item)), (2, " ".join(pad[:15_000] + broken + pad[15_000:])), (3, " ".join(worse)), (4, None), (5, ""), (6, "Hello\tWORLD\nagain"), (None, " ".join(item)), (7, " ".join(item).upper()), (7, "dup")]
    bench = [(10, " ".join(item)), (11, "hello world"), (12, None), (13, "  "), (None, "again")]
    d = spark.createDataFrame([(*r, "z") for r in docs], "doc_id long, text string, item string")
    b = spark.createDataFrame([(*r, "z") for r in bench], "item_id long, text string, doc_id string")
    got = {(r["id"], r["item"]): (r["n_shingles"], r["n_found"]) for r in contaminated(d, b).collect()}
    assert got == {(1, 10): (25, 25), (2, 10): (25, 22), (6, 11): (1, 1), (7, 10): (25, 25)}
    assert contaminated(d.where("false"), b).count() == 0
    assert contaminated(d, b.where("item_id > 11")).count() == 0
    left = decontaminated(d, b)
    assert left.columns == d.columns and sorted(str(r["doc_id"]) for r in left.collect()) == ["3", "4", "5", "None"]


def test_native(spark, sf_dir):
    plan = op3_benchmark_decontamination(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
