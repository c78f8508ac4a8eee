"""Every query of the standard tables against its SQL, over small tables made here."""

import datetime
import math
import random

import duckdb
import pytest

from tessera.plans import queries as q


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root, r = tmp_path_factory.mktemp("tables"), random.Random(1)
    day = lambda: datetime.datetime(1995, 1, 1) + datetime.timedelta(days=r.randrange(900))
    texts = ["one  line\nsecond line of it " + "x y z " * n for n in range(0, 90, 3)] + ["", None, "Copyright me", "a@b", "hey!! " * 60, "one line\ntail " + "t" * 300]
    docs = [(i, r.choice(texts), r.choice(["en", "de", "fr"]), f"src{r.randrange(4)}", r.randrange(5000)) for i in range(150)]
    bases = [[r.gauss(0, 0.2) for _ in range(64)] for _ in range(10)]
    made = {
        "documents": (docs, "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": ([(i, int(r.random() < 0.8), int(r.random() < 0.2)) for i in range(0, 150, 2)], "doc_id long, quality int, toxic int"),
        "benchmark": ([(i, "x y z " * 5) for i in range(5)], "item_id long, text string"),
        "pages": ([(i, "u", r.choice(["<table>", "<a href>", "<p>"])) for i in range(20)], "page_id long, url string, html string"),
        "embeddings": ([(i, [x + r.gauss(0, 0.03) for x in bases[i % 10]], i % 4) for i in range(80)], "vec_id long, embedding array<float>, label int"),
        "events": ([(i, day(), r.randrange(12), r.choice(["view", "click", "purchase"]), r.random() * 60, '{"k": "v%d"}' % (i % 3)) for i in range(300)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"),
        "nation": ([(i, f"n{i}", i % 3) for i in range(6)], "n_nationkey long, n_name string, n_regionkey long"),
        "customer": ([(i, f"c{i}", i % 6, r.randrange(0, 10_000) / 1.0, r.choice(["A", "B"])) for i in range(30)], "c_custkey long, c_name string, c_nationkey long, c_acctbal double, c_mktsegment string"),
        "supplier": ([(i, f"s{i}", i % 20, r.randrange(9000) / 1.0) for i in range(25)], "s_suppkey long, s_name string, s_nationkey long, s_acctbal double"),
        "part": ([(i, f"p{i}", f"b{i % 4}", 100.0 + i % 7) for i in range(60)], "p_partkey long, p_name string, p_brand string, p_retailprice double"),
        "orders": ([(i, r.randrange(30), r.choice("FOP"), 10.0, day()) for i in range(80)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz"),
        "lineitem": ([(i % 80, r.randrange(70), r.randrange(25), i // 80 + 1, float(r.randrange(1, 51)), 100.0 + i, r.randrange(10) / 100, r.randrange(8) / 100, r.choice("ANR"), r.choice("FO"), day()) for i in range(400)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"),
    }
    db = duckdb.connect()
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/{name}.parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{root}/{name}.parquet/*.parquet'")
    return str(root), db


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "None"
    return str(round(v, 5) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, tables, name):
    root, db = tables
    out = q.QUERIES[name](spark, root)
    names = sorted(out.columns)
    got = sorted(tuple(map(plain, r)) for r in out.select(*names).collect())
    if name not in q.SQL:
        assert got
        return
    cursor = db.execute(q.SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == names
    assert got == sorted(tuple(plain(r[columns.index(n)]) for n in names) for r in cursor.fetchall())
