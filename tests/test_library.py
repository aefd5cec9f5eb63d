import io

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lumenvec import catalogue
from lumenvec.functions import codec, colour, projections, quant, vec
from lumenvec.operators import gram, images, ranks
from lumenvec.plans.sinks import write_chunk
from lumenvec.sources import binary

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(values):
    return sorted(tuple("%.6g" % v if isinstance(v, float) else str(v) for v in r) for r in values)


@pytest.mark.parametrize("name", ["se02_batch_knn", "se04_two_stage", "ve11_hadamard", "tx04_top_words", "ag09_latest_version", "mp01_tile", "ml12_auc", "rp05_pareto", "st11_html_text", "pf16_tolerant_cast", "ve07_truncated_distance", "ve15_encode", "ve18_float8", "rp11_cka", "rp14_triplets", "mp02_colour", "se09_contrasting_tokens", "ve22_codec", "rp03_codec_recall", "rp12_rank_correlation", "rp04_exactness_control", "se10_knn_overlap", "ve08_int8_distance", "ve09_masked_codes", "ve12_standardised", "tk07_row_numbers", "tk08_equi_depth", "ve19_quantile_codebook", "ml09_macro_f1", "ar18_literal", "sc19_row_binary", "sc20_arrow_stream", "sk08_add_column", "sk10_collapse", "jn09_lookup_default", "st01_strings", "ag19_bootstrap", "sc05_text_lines", "sk06_chunk_once", "sk09_z_order", "sk11_resume"])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, D)
    cols = sorted(df.columns)
    want = con.execute(catalogue.ORACLE_SQL[name]).df()
    assert sorted(want.columns) == cols
    want = [[None if v is None or v != v else getattr(v, "item", lambda v=v: v)() for v in r] for r in want[cols].astype(object).values.tolist()]
    assert rows(df.select(*cols).collect()) == rows(want)


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() == 50
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_bf16_matches_bits(spark):
    x = np.random.default_rng(1).standard_normal(200).astype(np.float32)
    bits = x.view(np.uint32).astype(np.uint64)
    want = ((((bits + 0x7FFF + ((bits >> 16) & 1)) >> 16) << 16).astype(np.uint32)).view(np.float32)
    got = spark.createDataFrame([(float(v),) for v in x], "x double").select(vec.bf16(F.col("x")).alias("y")).toPandas()["y"]
    assert np.array_equal(want.astype(np.float64), got.to_numpy())


def test_binary_files(spark, tmp_path):
    a = np.arange(12, dtype=np.float32).reshape(3, 4)
    (tmp_path / "x.fbin").write_bytes(np.array([3, 4], "<u4").tobytes() + a.tobytes())
    got = binary.read_vectors(spark, str(tmp_path / "x.fbin"), "fbin").orderBy("id").toPandas()
    assert np.array_equal(np.stack(got["vec"]), a)
    buf = io.BytesIO()
    np.save(buf, a.astype(np.float16))
    assert np.array_equal(binary.parse_npy(buf.getvalue())[1], a)
    assert np.array_equal(binary.parse_bvecs(np.hstack([np.array([[4]] * 3, "<i4").view(np.uint8), a.astype(np.uint8)]).tobytes())[1], a)
    raw = np.array([2, 3], "<i4").tobytes() + np.array([1, 2], "<i4").tobytes() + np.array([7, 8, 9], "<i4").tobytes() + np.ones(3, "<f4").tobytes()
    assert [x.tolist() for x in binary.parse_range_truth(raw)[0]] == [[7], [8, 9]]


def test_chunks_load_once(spark, tmp_path):
    df = spark.range(10).withColumn("chunk", F.col("id") % 2)
    for _ in range(2):
        write_chunk(df, str(tmp_path / "t"), "chunk")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 10


def test_codebooks_contain_one_another(spark):
    x = np.random.default_rng(5).standard_normal(400)
    df = spark.createDataFrame([(x.tolist(),), ([],), (None,)], "v array<double>")
    codes = {b: df.select(quant.encode(F.col("v"), b, 1.0)).collect() for b in (2, 8)}
    assert np.array_equal(np.array(codes[8][0][0]) >> 6, codes[2][0][0]) and codes[8][1][0] == [] and codes[8][2][0] is None
    back = df.limit(1).select(quant.decode(quant.encode(F.col("v"), 8, 1.0), 8, 1.0)).first()[0]
    assert np.abs(np.array(back) - x).mean() < 0.02


def test_float8_nearest(spark):
    grid = np.array([0.0] + [(1 + m / 8) * 2.0**e for e in range(-6, 9) for m in range(8)] + [m * 2.0**-9 for m in range(1, 8)])
    grid = np.sort(grid[grid <= 448])
    x = np.random.default_rng(6).standard_normal(300) * 10
    got = spark.createDataFrame([(float(v),) for v in x], "x double").select(quant.float8(F.col("x"), 3, -6, 448.0)).toPandas().iloc[:, 0].to_numpy()
    assert np.array_equal(np.abs(got), [grid[np.abs(grid - abs(v)).argmin()] for v in x]) and (got * x >= 0).all()


def test_axes_and_alignment(spark):
    r = np.random.default_rng(7)
    x = r.standard_normal((300, 4)) * [5, 1, 3, 0.1] + 7
    df = spark.createDataFrame([(v.tolist(), (2 * v).tolist()) for v in x] + [(None, [1.0] * 4)], "a array<double>, b array<double>")
    want = np.linalg.svd(x - x.mean(0))[2][:2]
    assert np.allclose(np.abs(gram.principal_axes(df, F.col("a"), 2)), np.abs(want))
    assert abs(gram.linear_cka(df, F.col("a"), F.col("b")).first().cka - 1) < 1e-9


def test_rasters(spark):
    flat, wrong = bytes([10, 200, 77] * 25), b"abc"
    df = spark.createDataFrame([(0, flat), (1, wrong), (2, None)], "i int, r binary")
    got = df.orderBy("i").select(images.shrink_area(F.col("r"), 5, 3).alias("a"), images.shrink_nearest(F.col("r"), 5, 2).alias("n")).collect()
    assert bytes(got[0].a) == flat[:27] and bytes(got[0].n) == flat[:12] and got[1].a is None and got[2].n is None


def test_grey_has_no_hue(spark):
    r = spark.range(1).select(*colour.oklch_to_srgb(F.lit(0.6), F.lit(0.0), F.lit(0.3))).first()
    assert max(r) - min(r) < 1e-5


def test_truth_and_sparse_files():
    raw = np.array([2, 2], "<u4").tobytes() + np.array([5, 6, 7, 8], "<u4").tobytes() + np.arange(4, dtype="<f4").tobytes()
    ids, dist = binary.parse_truth(raw)
    assert ids.tolist() == [[5, 6], [7, 8]] and dist.tolist() == [[0, 1], [2, 3]]
    raw = np.array([2, 9, 3], "<i8").tobytes() + np.array([0, 1, 3], "<i8").tobytes() + np.array([4, 0, 8], "<i4").tobytes() + np.ones(3, "<f4").tobytes()
    assert [x.tolist() for x in binary.parse_csr(raw)[0]] == [[4], [0, 8]]


def test_projections_keep_lengths_and_nulls(spark):
    x = np.random.default_rng(3).standard_normal((200, 24))
    for kind in projections.KINDS:
        rows = projections.matrix(kind, 48, 24)
        ratio = ((x @ rows.T) ** 2).sum(1) / (x * x).sum(1)
        assert rows.shape == (48, 24) and abs(ratio.mean() - 1) < 0.25, kind
    assert np.allclose(projections.matrix("orthogonal", 48, 24).T @ projections.matrix("orthogonal", 48, 24), np.eye(24))
    df = spark.createDataFrame([(0, x[0].tolist()), (1, None), (2, [1.0]), (3, [0.0] * 24)], "i int, v array<double>")
    h = projections.hadamard_rows(24, 20)
    got = {r.i: (r.p, r.h, r.c) for r in df.select("i", projections.project(F.col("v"), h).alias("p"), projections.subsampled_hadamard(F.col("v"), 24, 20).alias("h"), projections.project(F.col("v"), h, codes=True).alias("c")).collect()}
    assert np.allclose(got[0][0], h @ x[0]) and np.allclose(got[0][1], h @ x[0])
    assert got[1] == got[2] == (None, None, None) and set(got[3][2]) == {1.0} and set(got[3][1]) == {0.0}


def test_sampled_codebook_is_near_the_best_quantizer():
    assert np.allclose(projections.sampled_codebook(1), [-0.7979, 0.7979], atol=0.01)
    assert np.allclose(projections.sampled_codebook(2), [-1.5104, -0.4528, 0.4528, 1.5104], atol=0.02)


def test_lanczos_keeps_flat_colour_and_crops(spark):
    flat = bytes([10, 120, 250]) * 6 * 8
    edged = np.zeros((6, 8, 3), np.uint8)
    edged[:, 1:7] = 200
    rows = [(0, flat), (1, edged.tobytes()), (2, None), (3, b"abc"), (4, b"")]
    got = {r.i: r.t for r in spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, b in rows], "i int, b binary").select("i", images.shrink_lanczos(F.col("b"), 6, 8, 2).alias("t")).collect()}
    assert bytes(got[0]) == bytes([10, 120, 250]) * 4 and bytes(got[1]) == bytes([200]) * 12
    assert got[2] is None and got[3] is None and got[4] is None


def test_ranks_in_many_ranges(spark):
    r = np.random.default_rng(9)
    rows = [(int(a) if a < 8 else None, float(b), int(i)) for i, (a, b) in enumerate(zip(r.integers(0, 9, 700), r.integers(0, 40, 700)))]
    df = spark.createDataFrame(rows, "a long, b double, i long")
    got = [(x.a, x.b, x.i) for x in ranks.row_numbers(df, ["a", "b", "i"], rows=50).orderBy("rn").collect()]
    assert got == sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    assert sorted(x.rn for x in ranks.row_numbers(df, ["a", "b", "i"], rows=50).collect()) == list(range(700))
    want = {v: np.mean([k for k, y in enumerate(sorted(x[1] for x in rows), 1) if y == v]) for v in {x[1] for x in rows}}
    assert all(x.r == want[x.b] for x in ranks.average_ranks(df, "b", rows=50).collect())
    assert ranks.row_numbers(df.limit(0), ["a"]).count() == 0


def test_codec_estimates_cosines(spark):
    """Estimates are near the true cosines, two bits nearer than one; zero and null vectors have none."""
    v = np.random.default_rng(2).standard_normal((300, 128))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, [0.0] * 128), (901, None)]
    df = spark.createDataFrame(rows, "key long, vec array<double>").select("key", codec.encode(F.col("vec"), 128).alias("code"))
    asked = spark.createDataFrame([(v[0].tolist(),)], "ref array<double>").select(codec.prepare(F.col("ref"), 128).alias("q"))
    got = df.crossJoin(asked).select("key", *[codec.cosine(F.col("code"), F.col("q"), b, 128).alias(f"c{b}") for b in (1, 2)]).toPandas().set_index("key").sort_index()
    true = v @ v[0] / np.linalg.norm(v, axis=1) / np.linalg.norm(v[0])
    off = [np.abs(got[c].loc[:299] - true).mean() for c in ("c1", "c2")]
    assert off[1] < off[0] < 0.08 and off[1] < 0.05 and got.loc[900:].isna().all().all()
    assert len(df.first().code.s) == 4


def test_kernels_compute_lengths_once(spark):
    v = np.random.default_rng(3).standard_normal((20, 48))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(20, [0.0] * 48), (21, None)], "i int, v array<double>")
    got = {r.i: (r.u, r.h) for r in df.select("i", vec.l2_normalize(F.col("v")).alias("u"), vec.hadamard_rotate(F.col("v"), 48).alias("h")).collect()}
    flips = np.array(vec.signs(48))
    block = np.array([[1.0 - 2 * ((i & j).bit_count() & 1) for j in range(16)] for i in range(16)]) / 4
    for i in range(20):
        assert np.allclose(got[i][0], v[i] / np.linalg.norm(v[i]))
        assert np.allclose(got[i][1], np.concatenate([block @ (v[i] * flips)[k : k + 16] for k in (0, 16, 32)]))
    assert got[20][0] == [0.0] * 48 and got[21] == (None, None)


def test_a_stream_appends_each_file_once(spark, tmp_path):
    from lumenvec.streaming.incremental import enrich_available

    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for part in range(2):
        spark.range(part * 5, part * 5 + 5).write.mode("append").parquet(source)
        enrich_available(spark, source, "id long", lambda df: df.withColumn("twice", F.col("id") * 2), target, state)
    got = spark.read.parquet(target).collect()
    assert sorted((r.id, r.twice) for r in got) == [(i, 2 * i) for i in range(10)]
