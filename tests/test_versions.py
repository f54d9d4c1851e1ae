from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tidemark.errors import ConflictError
from tidemark.sources import versions
from tidemark.sources.store import Store


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_a_number_is_taken_once(spark, tmp_path):
    home = str(tmp_path / "t")
    state = versions.State(1, [{"path": "a"}], {})
    assert versions._create(spark, home, state) and not versions._create(spark, home, versions.State(1, [{"path": "b"}], {}))
    assert versions.load(spark, home) == state
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: versions._create(spark, home, versions.State(2, [{"path": f"w{i}"}], {})), range(8)))
    assert sum(won) == 1 and versions.load(spark, home).parts == [{"path": f"w{won.index(True)}"}]
    assert not [f for f in (tmp_path / "t/_versions").iterdir() if f.name.startswith("draft")]


def test_appends_of_two_writers_stay(spark, tmp_path):
    stores = [Store(spark, str(tmp_path)) for _ in range(4)]
    stores[0].append("rows", spark.range(0))

    def write(i):
        for j in range(3):
            stores[i].append("rows", spark.range(10 * i + j, 10 * i + j + 1))

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(write, range(4)))
    assert ids(stores[0].read("rows")) == sorted(10 * i + j for i in range(4) for j in range(3))


def test_a_rewrite_keeps_what_is_appended_meanwhile(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.append("rows", spark.range(5))
    base = s.state("rows")
    s.append("rows", spark.range(7, 8))  # after the rewrite has read
    s.overwrite("rows", s.read("rows", base).where("id > 2"), base)
    assert ids(s.read("rows")) == [3, 4, 7]
    with pytest.raises(ConflictError):  # what it has read was rewritten
        s.overwrite("rows", s.read("rows", base), base)
    assert ids(s.read("rows")) == [3, 4, 7]


def test_the_loser_of_two_rewrites_starts_over(spark, tmp_path):
    s, seen = Store(spark, str(tmp_path)), []
    s.append("rows", spark.range(3))

    def rows(old):
        if not seen:  # another writer comes first
            s.update("rows", lambda x: x.union(spark.range(100, 101))) if seen.append(1) is None else None
        return old.select((F.col("id") + 1).alias("id"))

    s.update("rows", rows)
    assert ids(s.read("rows")) == [1, 2, 3, 101]


def row(spark, *pairs, at=1):
    return spark.createDataFrame([(i, v, at) for i, v in pairs], "id long, v string, at int")


def test_upserts_rewrite_touched_buckets(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.upsert("rows", row(spark, *((i, "old") for i in range(200))), ["id"], "at", buckets=16)
    before = {p["path"] for p in s.state("rows").parts}
    assert len(before) == 16
    s.upsert("rows", row(spark, (3, "new"), (500, "new"), at=2), ["id"], "at")
    after = {p["path"] for p in s.state("rows").parts}
    assert len(before - after) == len(after - before) <= 2
    got = {r["id"]: r["v"] for r in s.read("rows").collect()}
    assert len(got) == 201 and {i for i, v in got.items() if v == "new"} == {3, 500}
    s.upsert("rows", row(spark, (3, "older"), at=1), ["id"], "at")
    assert {r["v"] for r in s.read("rows").where("id = 3").collect()} == {"new"}
    s.append("rows", row(spark, (4, "again"), at=3))  # goes to its bucket
    s.upsert("rows", row(spark, (900, "x")), ["id"], "at")
    assert s.read("rows").count() == 203
    s.upsert("rows", row(spark, (4, "last"), at=4), ["id"], "at")
    assert [r["v"] for r in s.read("rows").where("id = 4").collect()] == ["last"]


def test_upserts_of_two_writers(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.append("rows", row(spark, *((i, "first") for i in range(20)), at=0))  # without buckets
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda k: s.upsert("rows", row(spark, (k, f"w{k}"), (50, f"w{k}"), at=k + 1), ["id"], "at", buckets=4), range(3)))
    got = {r["id"]: r["v"] for r in s.read("rows").collect()}
    assert s.read("rows").count() == 21 and got[50] == "w2" and [got[k] for k in range(3)] == ["w0", "w1", "w2"]


def test_old_parts_go(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    for i in range(8):
        s.overwrite("rows", spark.range(i, i + 1))
    assert ids(s.read("rows")) == [7]
    assert len([f for f in (tmp_path / "rows").iterdir() if f.name.startswith("v-")]) == 4
    s.compact("rows", 0)
    assert ids(s.read("rows")) == [7]
