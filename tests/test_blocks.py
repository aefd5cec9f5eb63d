"""Pairs in blocks against brute force: ties, odd vectors, tallies."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenvec import evaluation, primitives, reports, representations, storage, studies  # noqa: F401  (they register queries)
from lumenvec.catalogue import ORACLE_SQL, QUERIES
from lumenvec.functions import quant, vec
from lumenvec.operators import blocks, ranks, search

SHAPE = "id long, v array<double>"


@pytest.fixture
def sides(spark):
    rng = np.random.default_rng(5)
    some = rng.normal(size=(90, 8))
    rows = [(i, some[i % 90].tolist()) for i in range(1400)]  # copies over several blocks
    rows += [(2000, None), (2001, [0.0] * 8), (2002, [1.0] * 5), (2003, [None] * 8)]
    table = spark.createDataFrame(rows, SHAPE).repartition(3)
    return table.select(F.col("id").alias("key"), F.col("v").alias("vec")), table.where("id % 100 = 0").select(F.col("id").alias("qid"), F.col("v").alias("ref")), dict(rows)


def _dist(a, b):
    if a is None or b is None or len(a) != len(b) or None in a or None in b:
        return None
    dot = na = nb = 0.0
    for x, y in zip(a, b, strict=True):
        dot, na, nb = dot + x * y, na + x * x, nb + y * y
    return 1 - dot / (math.sqrt(na) * math.sqrt(nb)) if na and nb else None


def test_nearest_breaks_ties_by_id_and_puts_rows_without_distance_last(sides):
    pool, asked, rows = sides
    got = {(r["qid"], r["rank"]): (r["key"], r["dist"]) for r in search.exact(pool, asked, 20).collect()}
    for qid in [i for i in rows if i % 100 == 0]:
        ranked = sorted(((_dist(rows[qid], v), k) for k, v in rows.items() if k != qid), key=lambda t: (t[0] is None, t[0] or 0.0, t[1]))
        assert [got[qid, i + 1] for i in range(20)] == [(k, d) for d, k in ranked[:20]]


def test_a_part_hands_on_no_more_than_the_nearest(sides):
    pool, asked, _ = sides
    near = blocks.nearest(pool, asked, lambda p, q: [blocks.cosine_distances(p, q)], 5)
    parts = max(2, pool.sparkSession.sparkContext.defaultParallelism)
    assert near.count() <= asked.count() * parts * 5


def test_pairs_are_all_pairs_once(sides):
    pool, asked, rows = sides
    got = search.distances(pool, asked).collect()
    assert len({(r["qid"], r["key"]) for r in got}) == len(got) == 15 * len(rows) - 15
    assert all(r["dist"] == _dist(rows[r["qid"]], rows[r["key"]]) for r in got)
    assert search.distances(pool, asked, below=0.5).count() == sum(r["dist"] is not None and r["dist"] < 0.5 for r in got)


def test_products_decide_only_what_they_can(spark, monkeypatch):
    """Few pairs are summed from the left, with the results of summing all: ties, limits that lie on a distance, rows that share an id."""
    from lumenvec.operators.blocks import Block

    rng = np.random.default_rng(8)
    v = np.round(rng.normal(size=(600, 16)), 1)
    v[300:400], v[17], v[18] = v[200:300], 0, 1e200
    keys, sizes = np.sort(np.append(np.arange(580), [100] * 20)), np.full(600, 16, np.int32)
    p, q = Block(keys, [(v, sizes)]), Block(keys[::60], [(v[::60], sizes[::60])])
    exact = blocks.cosine_distances(p, q)
    rows, summed, whole = [], [], blocks._exact_at
    monkeypatch.setattr(blocks, "meet", lambda pool, queries, visit, schema: rows.extend(r for b in visit(q, iter(pool)) for r in zip(*(c.to_pylist() for c in b.columns))))
    monkeypatch.setattr(blocks, "_exact_at", lambda *x: summed.append(len(x[2])) or whole(*x))
    for part in ([Block(keys[:17], [(v[:17], sizes[:17])]), Block(keys[19:], [(v[19:], sizes[19:])])], [p]):
        held = np.concatenate([np.flatnonzero(np.isin(np.arange(600), np.arange(17))), np.arange(19, 600)]) if len(part) == 2 else np.arange(600)
        for digits in (None, 3):
            want = []
            for a, x in enumerate(q.keys):
                d = blocks.rounded(exact[a], digits)
                ranked = sorted((np.inf if np.isnan(d[b]) else d[b], keys[b]) for b in held if keys[b] != x)[:7]
                want += [(x, k, None if np.isinf(y) else y) for y, k in ranked]
            rows.clear(), summed.clear()
            blocks.close_nearest(part, None, 7, digits)
            assert sorted(map(str, rows)) == sorted(str((int(x), int(k), y if y is None else float(y))) for x, k, y in want)
            if len(part) == 2 and digits is None:
                assert 0 < sum(summed) < exact.size / 4
        limit = float(exact[1, held[40]])
        rows.clear(), summed.clear()
        blocks.close_pairs(part, None, 6, limit)
        want = [(int(x), int(keys[b]), float(blocks.rounded(exact[a, b : b + 1], 6)[0])) for a, x in enumerate(q.keys) for b in held if keys[b] != x and exact[a, b] < limit]
        assert sorted(rows) == sorted(want)
        if len(part) == 2:
            assert sum(summed) < exact.size / 20


def test_neighbouring_ids_share_a_block(spark):
    table = spark.range(0, 3000).select(F.col("id").alias("key"), F.array(F.rand(1), F.rand(2)).alias("vec")).repartition(5)
    held = [np.frombuffer(r[0], np.int64) for r in blocks.packed(table, "p", 101, together=2).collect()]
    assert sum(map(len, held)) == 3000
    for keys in held:
        assert len(keys) % 2 == 0 and (keys[::2] + 1 == keys[1::2]).all() and (keys[::2] % 2 == 0).all()


def test_codes_take_a_byte(spark):
    table = spark.createDataFrame([(i, [1.0, -1.0] * 32) for i in range(10)], SHAPE).coalesce(1)
    assert [len(r["p_values0"]) for r in blocks.packed(table, "p", 512).collect()] == [640]


def test_bf16_in_batches_is_the_expression(spark):
    values = [0.0, -0.0, 1.0, -1.0, 0.1, 1 / 3, 3.0e38, 1e-38, 1e-40, 2.0**-126, -5.4321, 1.00390625, 1.01171875]
    table = spark.createDataFrame([(0, values), (1, None), (2, [])], SHAPE)
    for bits in (2, 4, 8, 12, 16):
        got = table.select(quant.bf16_cut(F.col("v"), bits).alias("a"), vec.to_bf16(F.col("v"), bits).alias("b")).collect()
        assert all(r["a"] == r["b"] for r in got)


@pytest.mark.parametrize("name", ["rp02_recall_grid", "rp16_code_fidelity", "rp18_rate_grid", "rp13_overlap_matrix", "se10_knn_overlap", "se12_cross_modal", "ve08_int8_distance", "ve26_expansion", "rp15_neighbour_order", "rp04_exactness_control"])
def test_no_task_meets_pairs_one_by_one(spark, name, monkeypatch):
    """No query scores pairs row by row in a join of vectors with vectors."""
    def row_by_row(*_):
        raise AssertionError("pairs of single rows")

    monkeypatch.setattr(search, "against", row_by_row)
    QUERIES[name](spark, "/root/testdata/sf0.001").count()


def _grown(spark, tmp_path, name, shifts):
    table = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
    for column, by in shifts.items():
        table = table.withColumn(column, F.col(column) + by)
    table.write.parquet(f"{tmp_path}/{name}.parquet")


@pytest.mark.parametrize(("query", "table", "shifts"), [("mt05_morton", "part", {"p_partkey": 120_000}), ("st15_dates", "events", {"event_id": 5_000_000}), ("sk09_z_order", "lineitem", {"l_partkey": 120_000})])
def test_keys_of_larger_tables_are_as_in_sql(spark, tmp_path, query, table, shifts):
    import duckdb

    _grown(spark, tmp_path, table, shifts)
    got = sorted(tuple(r) for r in QUERIES[query](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    assert got == sorted(con.execute(ORACLE_SQL[query]).fetchall())


def test_ranks_in_parts_correlate_as_whole_ranks(spark):
    rng = np.random.default_rng(2)
    rows = [(int(g), float(a), float(b)) for g, a, b in zip(rng.integers(0, 3, 4000), rng.integers(0, 300, 4000), rng.integers(0, 300, 4000), strict=True)]
    df = spark.createDataFrame(rows, "g long, a double, b double")
    twice = ranks.rank_in_parts(ranks.rank_in_parts(df, "g", "a", 300), "g", "b", 300)
    got = {r["g"]: r["c"] for r in ranks.correlations(ranks.part_moments(twice, "g", "a", "b"), "g", "a", "b").collect()}
    for g in range(3):
        a, b = (np.array([r[i] for r in rows if r[0] == g]) for i in (1, 2))
        first = lambda x: np.searchsorted(np.sort(x), x)
        assert abs(got[g] - np.corrcoef(first(a), first(b))[0, 1]) < 1e-9


def test_rank_correlation_of_pairs_in_ranges(spark):
    """As over all pairs at once: ties, vectors without a distance, several ranges of bins."""
    rng = np.random.default_rng(11)
    v = np.round(rng.normal(size=(320, 6)), 1)
    v[200:230], v[7] = v[100:130], 0
    table = spark.createDataFrame([(i, x.tolist(), np.round(x).tolist()) for i, x in enumerate(v)], "key long, a array<double>, b array<double>")
    asked = table.where("key % 40 = 0").select(F.col("key").alias("qid"), "a")

    def score(p, q):
        return [blocks.cosine_distances(p, q, 1, 0, digits=3), blocks.cosine_distances(p, q, 0, 0, 3, digits=9), blocks.cosine_distances(p, q, digits=12)]

    p, q = (blocks.Block(np.arange(320)[::n], [(m[::n], np.full(len(m[::n]), 6, np.int32)) for m in (v, np.round(v))]) for n in (1, 40))
    held = np.stack([x[q.keys[:, None] != p.keys[None, :]] for x in score(p, q)])
    held = held[:, ~np.isnan(held).any(0)]
    rank = [np.searchsorted(np.sort(x), x) + np.searchsorted(np.sort(x), x, "right") for x in held]
    got = {r["cell"]: r["c"] for r in ranks.block_correlations(table, asked, score, [3, 9, 12], rows=300).collect()}
    assert set(got) == {0, 1} and all(abs(got[c] - np.corrcoef(rank[c], rank[2])[0, 1]) < 1e-12 for c in got)


def test_pieces_are_bounded_by_bytes():
    import pyarrow as pa

    from lumenvec.exchange import pieces

    texts = ["x" * n for n in (3, 900, 5, 0, 40, 50, 20)] + [None, "ä" * 30]
    got = [p.column(1).to_pylist() for p in pieces(pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts)], ["doc_id", "text"]), 100)]
    assert sum(got, []) == texts and all(len(g) == 1 or sum(len((t or "").encode()) for t in g) <= 100 for g in got) and len(got) == 4


def test_bags_of_texts_without_id_are_one(spark, tmp_path):
    """Texts without an id are counted where they lie, in many tasks, as one document; the SQL's result."""
    import duckdb

    rows = [(None if i % 2 else i // 4, None if i == 9 else f"w{i % 7} w{i % 5} Same same") for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES["ve28_bag_of_words"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in plan and "REPARTITION_BY_COL" not in plan  # tasks by bytes of text
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, c.sql(ORACLE_SQL["ve28_bag_of_words"]).fetchall()))


def test_vectors_travel_in_few_bytes(spark):
    """Blocks keep every value in the fewest bytes: codes and cut vectors a byte or two a coordinate, floats four; parts of the pool are bounded."""
    rng = np.random.default_rng(3)
    cases = {"few": (rng.choice(rng.normal(size=200), (512, 64)), 1), "some": (rng.choice(rng.normal(size=900), (512, 64)), 2), "floats": (rng.normal(size=(512, 64)).astype(np.float32).astype(float), 4), "all": (rng.normal(size=(512, 64)), 8), "codes": (rng.integers(-127, 128, (512, 64)).astype(float), 1), "none": (np.zeros((3, 0)), 0)}
    for m, size in cases.values():
        values, book = blocks._squeezed(m)
        assert len(values) == size * m.size and len(book) <= 8 * 1024
        assert (blocks._unsqueezed(values, book, *m.shape) == m).all()
    odd = np.array([[np.nan, 1e200, 0.1, np.inf] * 40] * 8)
    assert np.array_equal(blocks._unsqueezed(*blocks._squeezed(odd), *odd.shape), odd, equal_nan=True)
    table = spark.range(0, 200_000, 1, 3).select(F.col("id").alias("key"), F.array(F.rand(1)).alias("vec"))
    met = blocks.meet(table, table.limit(1).withColumnRenamed("key", "qid"), lambda q, others: iter(()), "n long")
    assert met.rdd.getNumPartitions() == 2 * max(spark.sparkContext.defaultParallelism, -(-200_000 // blocks.PART_ROWS))


def test_waiting_pairs_are_the_nearest():
    """Nearest in many small blocks as in one: ties, rows without a distance, a query's own row."""
    rng = np.random.default_rng(4)
    v = np.round(rng.normal(size=(900, 4)), 1)
    v[100:160], v[5], v[890] = v[200:260], 0, 0
    sizes = np.full(900, 4, np.int32)
    q = blocks.Block(np.arange(0, 900, 89), [(v[::89], sizes[::89])])
    for k in (1, 7, 40, 899):
        for own in (False, True):
            best = blocks.Nearest(q, k, own)
            for lo in range(0, 900, 50):
                p = blocks.Block(np.arange(lo, lo + 50), [(v[lo : lo + 50], sizes[lo : lo + 50])])
                best.add(p, [blocks.cosine_distances(p, q, digits=6), -blocks.cosine_distances(p, q, digits=3)])
            got = {}
            for b in best.rows():
                for cell, x, key, dist in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    got.setdefault((cell, x), []).append((dist is None, dist or 0.0, key))
            whole = blocks.Block(np.arange(900), [(v, sizes)])
            for cell, dist in enumerate((blocks.cosine_distances(whole, q, digits=6), -blocks.cosine_distances(whole, q, digits=3))):
                for x, row in zip(q.keys.tolist(), dist.tolist(), strict=True):
                    want = sorted((d != d, 0.0 if d != d else d, key) for key, d in enumerate(row) if own or key != x)[:k]
                    assert sorted(got[cell, x]) == want


@pytest.mark.parametrize("k", [3, 120, 2000])
def test_many_nearest_hand_on_few_more(spark, sides, monkeypatch, k):
    """The nearest of all parts together are among what is handed on, ties and rows without a distance too, and that is few more than ``k`` a query."""
    pool, asked, rows = sides
    score = lambda p, q: [blocks.cosine_distances(p, q), blocks.rounded(blocks.cosine_distances(p, q, dims=3), 2)]
    monkeypatch.setattr(search, "limited", None)
    near = search.many(pool, asked, score, 2, k).cache()
    whole = search.top_k(blocks.nearest(pool, asked, score, k), k, by=("cell", "qid"))
    flat = lambda df: sorted((r["cell"], r["qid"], r["rank"], r["key"], r["dist"]) for r in df.select("cell", "qid", "rank", "key", F.coalesce("dist", F.lit(9.0)).alias("dist")).collect())
    assert flat(search.top_k(near, k, by=("cell", "qid"))) == flat(whole)
    if k == 120:  # of 16 copies of 90 vectors a part's bin holds few more
        assert near.where("cell = 0").count() < 15 * 2 * k


def test_orders_around_queries_move_no_pairs(spark, sides, monkeypatch):
    """Ranked where they are scored, in blocks of a few queries, as in ranges of all pairs; rows without a distance come last."""
    pool, asked, _ = sides
    asked = asked.where("qid < 1400")
    score = lambda p, q: [blocks.cosine_distances(p, q, digits=12), blocks.cosine_distances(p, q, dims=3, digits=2)]
    want = {}
    filled = blocks.beside(pool, asked, score, ["a", "b"]).fillna(3.0)
    for part in filled.toPandas().groupby("qid"):
        a, b = (part[1][c].rank(method="min") for c in ("a", "b"))
        want[part[0]] = a.corr(b)
    monkeypatch.setattr(ranks, "HELD_PAIRS", 5 * 1404)
    monkeypatch.setattr(blocks, "beside", None)
    got = {r["qid"]: r["c"] for r in ranks.query_correlations(pool.where("vec is not null and forall(vec, x -> x is not null)"), asked, score, 1404).collect()}
    odd = pool.where("vec is null or exists(vec, x -> x is null)").count()
    assert odd == 2 and set(got) == set(want)
    whole = {r["qid"]: r["c"] for r in ranks.query_correlations(pool, asked, score, 1404).collect()}
    assert all(abs(whole[k] - want[k]) < 1e-4 and abs(got[k] - whole[k]) < 1e-2 for k in want)
    assert QUERIES["rp15_neighbour_order"](spark, "/root/testdata/sf0.001").first()["queries"] == 5
