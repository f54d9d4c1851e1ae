from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import OWN, SF, SPACE, docs, edge_rows
from tidemark.llm import line_dedup, mixing, vectors
from tidemark.llm.components import components


@pytest.mark.parametrize("one_task", [1_000_000, 0])
def test_components(spark, one_task):
    rng = np.random.default_rng(1)
    chain = [(i, i + 1) for i in range(200, 300)]
    star = [(1, i) for i in range(2, 80)]
    loose = [(int(a), int(b)) for a, b in rng.integers(1000, 1400, (300, 2))]
    edges = [*chain, *star, *loose, (5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7), one_task).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long"), one_task).count() == 0


def planted_vectors(seed=2, n=400, groups=30):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for g in range(groups):
        for j in range(1, 5):
            x[g * 10 + j] = x[g * 10] + rng.normal(size=16) * 0.03
    x[5] = x[6]
    x[7] = 3 * x[6]
    return x


def plain_links(rows, least=0.98):
    n, out = len(rows), {}
    ok = [v is not None and lab is not None and all(c is not None and np.isfinite(c) for c in v) and any(v) for _, v, lab in rows]
    unit = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if o else None for o, (_, v, _) in zip(ok, rows, strict=True)]
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * n
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= least:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    low = defaultdict(lambda: 10**9)
    for i in range(n):
        low[find(i)] = min(low[find(i)], rows[i][0])
    for i in range(n):
        out[rows[i][0]] = (links[i], low[find(i)])
    return out


@pytest.mark.parametrize("block", [2048, 3])
def test_vectors(spark, block):
    x = planted_vectors()
    rows = [(1000 - i, [float(c) for c in v], i % 100 // 50) for i, v in enumerate(x)]
    nan, inf = float("nan"), float("inf")
    rows += [(2000, None, 0), (2001, [0.0] * 16, 0), (2002, rows[0][1], None), (2003, [nan] * 16, 0), (2004, [inf] + [0.0] * 15, 0), (2005, [None] + [1.0] * 15, 0)]
    t = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, rep string, n int")
    got = {r["vec_id"]: r for r in vectors.near_duplicates(t, block=block).collect()}
    wanted = plain_links(rows)
    assert set(got) == set(wanted)
    found, real = sum(r["n_links"] for r in got.values()), sum(a for a, _ in wanted.values())
    assert real > 100 and found >= 0.9 * real and all(got[i]["n_links"] <= wanted[i][0] for i in wanted)
    links = [(i, w) for i, w in wanted.items() if got[i]["n_links"] == w[0]]
    assert len(links) >= 0.9 * len(wanted)
    # What is missed parts components, but joins none: equal ones where all links are found, a part of the real one elsewhere.
    real_of = {i: c for i, (_, c) in wanted.items()}
    assert all(real_of[r["component_id"]] == real_of[i] for i, r in got.items())
    whole = {c for c in set(real_of.values()) if all(got[i]["n_links"] == wanted[i][0] for i in wanted if real_of[i] == c)}
    assert len(whole) >= 0.8 * len(set(real_of.values())) and all(got[i]["component_id"] == c for i, c in real_of.items() if c in whole)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


@pytest.mark.parametrize("block", [2048, 60])
def test_vectors_of_several_lengths(spark, block):
    x, y, z = planted_vectors(), planted_vectors(3, 200, 15)[:, :12], planted_vectors(4, 40, 3)[:, :5]
    x, y, z = ([[float(c) for c in v] for v in part] for part in (x, y, z))
    # Multiples of one number: one component leaves nothing but the sign.
    rows = [(i, v, i % 2) for i, v in enumerate([*x, *y, *z, *[[float(k)] for k in (1, 2, 3, -1, -4, 0, 2, 5)]])]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in vectors.near_duplicates(t, block=block).collect()}
    assert set(got) == {i for i, _, _ in rows}
    for d in (16, 12, 5, 1):
        own = [r for r in rows if len(r[1]) == d]
        wanted = plain_links(own)
        found, real = sum(got[i]["n_links"] for i in wanted), sum(a for a, _ in wanted.values())
        exact = d == 1 or len(own) <= block
        assert real > 0 and (found == real if exact else 0.9 * real <= found <= real)
        if found == real:
            assert all((got[i]["n_links"], got[i]["component_id"]) == wanted[i] for i in wanted)


def test_visits_reach_the_cells_of_neighbours():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    books = (vectors.kmeans(x[:, :8], 20), vectors.kmeans(x[:, 8:], 20))
    visits = vectors.calibrate(x, books, 0.98, 0.97)
    near = x + rng.normal(size=x.shape) * 0.2 / 4  # about the threshold
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    at = (near * x).sum(1) >= 0.98
    met = (vectors.traverse(x[at], books, visits) == vectors.traverse(near[at], books, 1)).any(1)
    assert 1 < visits < 100 and at.sum() > 500 and met.mean() >= 0.95


def test_a_hot_cell_is_dealt_by_block(spark):
    rng = np.random.default_rng(5)
    hot = np.ones(8) + rng.normal(size=(700, 8)) * 1e-3
    x = [*hot, *rng.normal(size=(300, 8))]
    t = spark.createDataFrame([(i, [float(c) for c in v], 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    found = vectors.near_duplicates(t, block=50)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found.collect()}
    wanted = plain_links([(i, [float(c) for c in v], 1) for i, v in enumerate(x)])
    assert sum(got[i][0] for i in range(700)) >= 0.9 * sum(wanted[i][0] for i in range(700)) and all(got[i][1] == 0 for i in range(700))


@pytest.mark.parametrize("block", [1, 2048])
def test_repeated_ids_of_different_vectors(spark, block):
    a, b, e, g = [1.0, 0.0, 0.0], [0.99, 0.1, 0.0], [0.0, 1.0, 0.0], [0.1, 0.99, 0.0]
    t = spark.createDataFrame([(7, a, 0), (3, b, 0), (7, e, 1), (5, g, 1), (7, [0.0, 0.0, 1.0], 1)], "vec_id long, embedding array<float>, label int")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicates(t, block=block).collect())
    assert got == [(3, 1, 3, True), (5, 1, 5, True), (7, 0, 7, True), (7, 1, 3, False), (7, 1, 5, False)]


def test_vector_edges(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert vectors.near_duplicates(spark.createDataFrame([], kind)).count() == 0
    got = vectors.near_duplicates(spark.createDataFrame([(1, None, 1), (None, [1.0, 0.0], 1), (2, [1.0], 1)], kind)).collect()
    assert {(r["vec_id"], r["n_links"], r["kept"]) for r in got} == {(1, 0, True), (None, 0, False), (2, 0, True)}
    got = vectors.near_duplicates(spark.createDataFrame([(3, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (9, [1.0, 0.0, 0.0], 1)], kind)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(2, 2, 2), (3, 2, 2), (3, 2, 2), (9, 0, 9)]


def test_traversal_is_nearest_first():
    rng = np.random.default_rng(0)
    x, books = rng.normal(size=(20, 8)), (rng.normal(size=(6, 4)), rng.normal(size=(5, 4)))
    every = (vectors.distances(x[:, :4], books[0])[:, :, None] + vectors.distances(x[:, 4:], books[1])[:, None, :]).reshape(20, -1)
    for visits in (1, 4, 11, 30):
        assert (vectors.traverse(x, books, visits) == every.argsort(1, kind="stable")[:, :visits]).all()


def fill(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    left = float(sum(sizes.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 3 * sizes[s]}
        if not full:
            return target | {s: weight[s] * level for s in open_}
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


@pytest.mark.parametrize("group_rows", [4096, 16])
def test_mixing(spark, group_rows):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = mixing.mix(d, group_rows=group_rows).collect()
    own = {r["doc_id"]: (r["source"], len(SPACE.findall(r["text"] or ""))) for r in d.collect()}
    sizes = Counter()
    for s, n in own.values():
        sizes[s] += n
    target, taken = fill(sizes), Counter()
    assert len(got) == len(own)
    for r in got:
        s, n = own[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (n, sizes[s]) and r["target"] == pytest.approx(target[s])
        assert 0 <= r["taken"] <= 3 * n and (n == 0 or r["taken"] % n == 0)
        taken[s] += r["taken"]
    # Groups this small leave their last documents to a landing without others to trade with.
    room = 50 if group_rows > 1000 else max(n for _, n in own.values())
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + room for s in sizes)
    again = mixing.mix(d.repartition(7), group_rows=group_rows).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_mixing_small_sources_beside_a_large_one(spark):
    rng = np.random.default_rng(8)
    names = ["large"] * 400 + [f"s{i % 6}" for i in range(240)]
    sizes = np.exp(rng.normal(5, 1.2, len(names))).astype(int) + 1
    d = docs(spark, [(i, "w " * int(n), "en", s) for i, (n, s) in enumerate(zip(sizes, names, strict=True))])
    taken, target = Counter(), {}
    for r in mixing.mix(d, group_rows=64).collect():
        taken[names[r["doc_id"]]] += r["taken"]
        target[names[r["doc_id"]]] = r["target"]
    assert len(target) == 7 and all(abs(taken[s] - target[s]) <= 50 for s in target)


def test_mixing_of_copies(spark):
    """A third of all rows are one document: its copies fly in many groups, and all reruns take as many of them."""
    rows = [(1, "a document of some words " * 5, "en", "s0")] * 600 + [(i, "w " * (i % 97), "en", f"s{i % 4}") for i in range(2, 1200)] + [(None, "no id", None, None)] * 40
    d = docs(spark, rows)
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(SPACE.findall(t))
    target = fill(sizes)
    plain = mixing.mix(d, group_rows=64, copies=50)
    got = plain.collect()
    assert len(got) == len(rows) and Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(d.repartition(9), group_rows=64, copies=50).collect()))
    assert abs(sum(r["taken"] for r in got if r["target"] == got[0]["target"]) - got[0]["target"]) <= 100
    for copies in (50, 10_000):  # ranked in buckets, and in one
        out = mixing.mixed(d.repartition(5), group_rows=64, copies=copies)
        taken = Counter()
        for r in out.collect():
            taken[r["source"]] += len(SPACE.findall(r["text"]))
        assert out.columns == d.columns and all(abs(taken[s] - target[s]) <= 100 for s in sizes)
        times = Counter((r["doc_id"], r["source"]) for r in out.collect())
        copies_of = Counter((i, s) for i, _, _, s in rows)
        rate = {s: target[s] / sizes[s] for s in sizes}
        assert all(int(rate[s]) * n <= times[i, s] <= (int(rate[s]) + 1) * n for (i, s), n in copies_of.items() if rate[s] % 1)
        assert abs(times[1, "s0"] / 600 - rate["s0"]) < 0.1 or rate["s0"] % 1 == 0


def test_landing_evens_out_one_long_document():
    size = np.array([9000, *range(5, 2000, 5), 4])
    p = np.array([0.5, *([1.0, 0.0] * 200)[:399], 0.7])
    landed = mixing.land(p, size)
    assert set(landed) <= {0.0, 1.0} and (landed != p).sum() <= 12 and abs((landed - p) @ size) <= 50


def test_mixing_edges(spark):
    e = docs(spark, edge_rows())
    got = mixing.mix(e).collect()
    assert len(got) == len(edge_rows())
    sizes = Counter()
    for _, t, _, s in edge_rows():
        sizes[s] += len(SPACE.findall(t or ""))
    target = fill(sizes)
    assert {round(r["target"], 3) for r in got} == {round(v, 3) for v in target.values()}
    rows = mixing.mixed(e)
    assert rows.columns == e.columns and rows.where("text is null").count() <= 3  # like any document of its source: of no size
    assert all(r[n] == v for r in rows.collect() for n, v in OWN.items())
    words = sum(len(SPACE.findall(r["text"] or "")) for r in rows.collect())
    assert words == sum(r["taken"] for r in got)
    none = e.where("false")
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0
    blank = docs(spark, [(1, None, None, "a"), (2, "", None, None)])
    assert [(r["target"], r["taken"]) for r in mixing.mix(blank).collect()] == [(0.0, 0), (0.0, 0)]


def test_flight_keeps_totals():
    rng = np.random.default_rng(4)
    size = rng.integers(0, 500, 300)
    for share in (0.1, 0.5, 0.93):
        p = mixing.flight(np.full(300, share), size)
        assert ((p > 0) & (p < 1)).sum() <= 2 and p.sum() == pytest.approx(300 * share) and (p * size).sum() == pytest.approx(share * size.sum())
        assert set(mixing.land(p, size)) <= {0.0, 1.0}
    assert (mixing.flight(np.array([0.0, 1.0]), np.array([3, 4])) == [0, 1]).all()


def test_line_dedup_sql(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    wanted = sorted(c.execute(line_dedup.ORACLE_SQL).fetchall())
    for limit in (line_dedup.BROADCAST_LINES, 0):  # both ways give the same
        got = line_dedup.dedup(d, F.col("source"), counts=True, broadcast_lines=limit)
        assert sorted(tuple(r) for r in got.select("doc_id", "text", "n_lines", "n_dropped").collect()) == wanted
    assert sum(r[3] for r in wanted) > 100


@pytest.mark.parametrize("limit", [line_dedup.BROADCAST_LINES, 0])
def test_line_dedup_edges(spark, limit):
    e = docs(spark, [*edge_rows(), *[(20 + i, f"menu\nown {i}\n\nmenu", None, "s") for i in range(4)], (30, "menu", None, None), (31, "menu\r", None, "s"), (32, None, None, "s")])
    out = line_dedup.dedup(e, F.col("source"), broadcast_lines=limit)
    assert out.columns == e.columns and out.count() == e.count()
    assert all(r[n] == v for r in out.collect() for n, v in OWN.items())
    by = {r["doc_id"]: r for r in out.collect()}
    assert by[20]["text"] == "own 0\n" and by[20]["n_chars"] == 6 and by[30]["text"] == "menu" and by[31]["text"] == "menu\r" and by[32]["text"] is None
    assert by[2]["text"] == "" and by[3]["text"] == " \t\n " and by[1]["text"] is None and by[6]["text"] == edge_rows()[5][1]
    assert line_dedup.dedup(e.where("false"), F.col("source"), broadcast_lines=limit).count() == 0


def test_line_dedup_runs_no_python(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    plan = line_dedup.dedup(d, F.col("source"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
