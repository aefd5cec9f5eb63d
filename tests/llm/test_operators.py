import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenvec.llm import kernels as K
from lumenvec.llm import toxic
from lumenvec.llm.ann import nearest_neighbours
from lumenvec.llm.chat import rotate_perspectives
from lumenvec.llm.components import connected_components
from lumenvec.llm.decontaminate import drop_leaks, find_leaks
from lumenvec.llm.mix import mix_sources, mixed_documents
from lumenvec.llm.near_dup import drop_near_duplicates, near_duplicates
from lumenvec.llm.packing import TOKENIZER, CapacityTree, Encoder, pack, pack_documents
from lumenvec.llm.repeats import remove_repeats
from lumenvec.llm.shard import even_map, plan_map, read_map, shard_documents, temporary_map, write_map
from lumenvec.llm.suffix_sort import deep_shallow
from lumenvec.llm.toxic import drop_toxic, sample, score_toxicity, train
from lumenvec.llm.url_rules import judge_urls

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, shard int, component_id long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, clashing column names."""
    r = np.random.default_rng(0)
    words = ["w%d" % i for i in range(300)]
    long = " ".join(r.choice(words, 4000))
    near = " ".join(r.choice(words, 120))
    texts = [None, "", "  \n", "one two", "one two", "one two three four five", long, long, near, near + " tail", near.replace(near.split()[60], "changed"), "a" * 500, "aéb " * 120]
    rows = [(i, t, None if i == 3 else "en", None if i == 4 else f"s{i % 3}", 1, 0, 0) for i, t in enumerate(texts)]
    rows += [rows[5], (None, "one two", None, "s1", None, None, None)]
    return spark.createDataFrame(rows, SHAPE), rows


def test_near_duplicates_brute(spark, odd):
    df, rows = odd
    got = near_duplicates(df, 85).toPandas()
    assert len(got) == len(rows)

    def shingles(t):
        w = (t or "").lower().encode().split()
        return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    up = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                    up[a] = up[b] = min(up[a], up[b])
    for r in got.dropna(subset="doc_id").itertuples():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), up[r.doc_id], up[r.doc_id] == r.doc_id)


def test_stages_judge_rows_without_id(spark):
    """Null and shared ids: one row of each group stays, and leaks go whatever their id."""
    r = np.random.default_rng(4)
    a, b, c, item = (" ".join(r.choice(["w%d" % i for i in range(300)], 100)) for _ in range(4))
    rows = [(None, a), (None, a + " tail"), (None, a), (7, b), (7, b), (7, c), (None, b + " tail"), (7, ""), (None, None), (None, None), (7, "x " + item), (None, "y " + item)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = drop_near_duplicates(df, 80).collect()
    assert sorted((x.doc_id or 0, x.text or "") for x in kept if x.text and item not in x.text and a not in x.text) == sorted([(7, b), (7, c)])
    assert sum(a in (x.text or "") for x in kept) == 1 and sum(not x.text for x in kept) == 3 and sum(item in (x.text or "") for x in kept) == 1
    clean = drop_leaks(df, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert Counter(tuple(x) for x in clean) == Counter(rows[:-2])


def test_superminhash_estimates():
    a, b = np.arange(1, 901, dtype=K.U), np.arange(101, 1001, dtype=K.U)
    s = K.superminhash([K.mix(a), K.mix(b)], 512)
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.06


def test_components_path(spark):
    got = connected_components(spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")).toPandas()
    assert set(got[got.node <= 40].component) == {0} and got[got.node == 101].component.item() == 100


@pytest.mark.parametrize("giant", [50_000, 2])
def test_repeats_brute(spark, odd, giant):
    df, rows = odd
    seen = Counter(b[i : i + 200] for r in rows for b in [(r[1] or "").encode()] for i in range(len(b) - 199))
    want = Counter()
    for r in rows:
        b = (r[1] or "").encode()
        m = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            m[i : i + 200] |= seen[b[i : i + 200]] > 1
        kept = np.frombuffer(b, np.uint8)[~m].tobytes()
        want[(r[0] if r[0] is not None else -1, len(b), int(m.sum()), int((np.diff(np.r_[0, m.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest())] += 1
    got = remove_repeats(df, giant=giant).drop("kept").fillna(-1, "doc_id").collect()
    assert Counter(tuple(r) for r in got) == want


@pytest.mark.parametrize("giant", [50_000, 2])
def test_repeats_of_periodic_texts(spark, giant):
    """Runs of many periods, alone, between other bytes, shorter and longer than a window and a period, some of which other texts share."""
    r = np.random.default_rng(8)
    letters = list("abcdef")
    words = {p: "".join(r.choice(letters, p)) for p in (1, 2, 3, 7, 64, 136, 137, 150, 199, 200, 201)}
    noise = lambda n: "".join(r.choice(list("ghijklmnop "), n))
    texts = ["a" * 5000, noise(150) + "a" * 201 + noise(150), noise(90) + "a" * 200 + noise(90), "b" * 199, "b" * 201 + noise(10)]
    texts += [noise(77) + (w * 2000)[: int(n)] + noise(60) for p, w in words.items() for n in (200, 200 + p - 1, 200 + p, 900)]
    texts += [(words[3] * 200)[:400] + (words[7] * 200)[:500] + (words[3] * 200)[1:330], "xyz" + texts[9][50:300], None, ""]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seen = Counter(t[i : i + 200] for _, t in rows for i in range(len(t or "") - 199))
    want = {}
    for i, t in rows:
        m = np.zeros(len(t or ""), bool)
        for k in range(len(m) - 199):
            m[k : k + 200] |= seen[t[k : k + 200]] > 1
        want[i] = (int(m.sum()), hashlib.sha256(np.frombuffer((t or "").encode(), np.uint8)[~m].tobytes()).hexdigest())
    assert {x.doc_id: (x.n_removed, x.kept_sha256) for x in remove_repeats(df, giant=giant).collect()} == want


def test_repeats_of_megabytes_of_one_byte(spark):
    import time

    df = spark.createDataFrame([(1, "a" * 2_000_000), (2, "ab" * 1_000_000), (3, "c" + "a" * 250 + "d"), (4, "short")], "doc_id long, text string")
    began = time.perf_counter()
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans) for x in remove_repeats(df).collect()}
    assert got == {1: (2_000_000, 2_000_000, 1), 2: (2_000_000, 2_000_000, 1), 3: (252, 250, 1), 4: (5, 0, 0)} and time.perf_counter() - began < 60


def test_deep_shallow_sorts():
    r = np.random.default_rng(2)
    m = r.integers(0, 2, (400, 40)).astype(np.uint8)
    m[:, :20] = 1
    m[100:200] = m[:100]
    g = r.integers(0, 3, 400)
    order, lcp = deep_shallow(m, g, 2)
    keys = [(g[i], m[i].tobytes()) for i in order]
    assert keys == sorted(keys) and lcp.max() == 40


def test_shards(spark, odd):
    df, rows = odd
    got = shard_documents(df, shards=3).toPandas()
    assert len(got) == len(rows)
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    loads = {v: v % 7 + 1 for v in range(64)}
    old = plan_map(loads, 4, 64)
    new = plan_map(loads, 5, 64, old)
    assert sum(old[v] != new[v] for v in old) < 32
    assert shard_documents(df.limit(0)).count() == 0


def test_shards_brute(spark, tmp_path):
    """Sizes, checksums, equal texts together and near equal bytes; a stored map is edited, version by version, and few slots move."""
    import zlib

    r = np.random.default_rng(11)
    rows = [(i, "é" * int(r.integers(0, 400)) + str(i % 900), "b", 5) for i in range(3000)] + [(5000, None, None, None), (5001, "", "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, law string, shard int")
    got = shard_documents(df, shards=4, map_path=temporary_map(spark, 4)).toPandas().set_index("doc_id")
    texts = {i: (t or "").encode() for i, t, *_ in rows}
    assert all(got["size"][i] == len(b) + 1 and got.text_crc32[i] == zlib.crc32(b) for i, b in texts.items()) and set(got.law) == {"bytes"}
    assert (got.map_version == 2).all() and got.grown_shard.isna().all()
    loads = got.groupby("shard")["size"].sum()
    assert len(loads) == 4 and loads.max() < 1.01 * loads.mean() and got.groupby("text_crc32").shard.nunique().max() == 1
    path = str(tmp_path / "map")
    write_map(spark, even_map(4), 1, path)
    four = shard_documents(df, shards=4, map_path=path).toPandas()
    five = shard_documents(df, shards=5, map_path=path).toPandas()
    old, new = read_map(spark, path, 2)[1], read_map(spark, path)[1]
    assert (read_map(spark, path)[0], set(four.map_version), set(five.map_version)) == (3, {2}, {3}) and read_map(spark, path, 1)[1] == even_map(4)
    moved = [v for v in old if old[v] != new[v]]
    loads = five.groupby("shard")["size"].sum()
    assert len(loads) == 5 and loads.max() < 1.01 * loads.mean() and sum(new[v] == 4 for v in moved) > 0.8 * len(moved) and len(moved) < 0.4 * len(old)


@pytest.mark.parametrize("hot_id", [None, 7])
def test_shards_of_a_hot_text_without_ids_of_its_own(spark, hot_id):
    """Half of all rows have one text, and one id or none: shards stay within a percent, and slots have no gaps."""
    rows = [(hot_id, "the same words in every row of this group " * 3)] * 3000 + [(100 + i, f"text {i} " * (i % 30)) for i in range(3000)]
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), shards=8).toPandas()
    loads = got.groupby("shard")["size"].sum()
    assert len(loads) == 8 and loads.max() < 1.01 * loads.mean() and loads.min() > 0.99 * loads.mean()
    assert got[got["size"] == 127].groupby("vslot").size().max() < 10 and all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))


def test_mix(spark, odd):
    df, _ = odd
    got = mix_sources(df).toPandas()
    assert (got.taken <= 2 * got["size"]).all() and abs(got.groupby("source", dropna=False).target.first().sum() - 1.5 * got["size"].sum()) < 1e-6
    for _, g in got.groupby("source", dropna=False):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= max(2 * g.block_words.iloc[0], 0.05 * g.target.iloc[0])
    made = mixed_documents(df)
    assert made.columns == df.columns and sum(len(t.split()) for t in made.toPandas().text) == got.taken.sum()
    assert mix_sources(df.limit(0)).count() == 0


def test_mix_with_a_tail_source(spark):
    """A source of a few words neither shrinks the blocks of the others nor has a source's documents come out as scattered words."""
    r = np.random.default_rng(5)
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(int(r.integers(200, 600)))), f"s{i % 3}", 0) for i in range(300)] + [(900, "one two three four", "tail", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = mix_sources(df).toPandas()
    assert (got[got.source != "tail"].block_words > 100).all()
    for _, g in got.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 2 * g.block_words.iloc[0]
    made = mixed_documents(df).toPandas()
    whole = {i: t for i, t, _, _ in rows}
    cut = [m for m in made.itertuples() if m.text != whole[m.doc_id]]
    assert max(Counter(c.source for c in cut).values()) <= 4 and made.text.str.split().str.len().sum() == got.taken.sum()


def test_packing_round_trip(spark, odd):
    df, rows = odd
    e = Encoder(open(TOKENIZER, "rb").read())
    for t in ["a  b", " x \n y ", "foo\n bar", "it's  12 kg…", " a b"]:
        assert np.frombuffer(e.encode(t), "<u2").tolist() == e.encoding.encode_ordinary(t)
    got = {}
    for r in pack_documents(df, row_tokens=64).collect():
        ids = np.frombuffer(r.input_ids, "<u2")
        assert (np.array(r.position_resets) == r.cu_seqlens[:-1]).all() and len(ids) == 64 and (ids[r.n_tokens :] == 50256).all()
        for d, k, p, a, b in zip(r.doc_ids, r.doc_rows, r.pieces, r.cu_seqlens[:-1], r.cu_seqlens[1:]):
            assert (k, p) not in got
            got[k, p] = d, ids[a:b].tolist()
    whole = {}
    for (k, p), (d, ids) in sorted(got.items()):
        whole.setdefault((k, d), []).extend(ids)
    want = Counter((r[0], tuple(e.encoding.encode_ordinary(r[1] or ""))) for r in rows)
    assert Counter((d, tuple(ids)) for (_, d), ids in whole.items()) == Counter({x: n for x, n in want.items() if x[1]})
    assert pack_documents(df.limit(0)).count() == 0


def test_packed_matrices_are_written_and_read_back(spark, odd, tmp_path):
    """Ids, cumulative lengths and position resets from the written matrices give every document's ids, and positions from 0 in each segment."""
    from lumenvec.llm.packing import position_ids, read_packed, write_packed

    df, rows = odd
    write_packed(pack_documents(df, row_tokens=128), str(tmp_path / "packed"))
    e, pieces = Encoder(open(TOKENIZER, "rb").read()), {}
    for r in read_packed(spark, str(tmp_path / "packed")).collect():
        ids, places = np.frombuffer(r.input_ids, "<u2"), position_ids(np.array(r.cu_seqlens), 128)
        assert len(ids) == len(places) == 128 and (places[list(r.position_resets)] == 0).all() and r.cu_seqlens[-1] == r.n_tokens
        for k, piece, a, b in zip(r.doc_rows, r.pieces, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
            assert places[a:b].tolist() == list(range(b - a))
            pieces[k, piece] = ids[a:b].tolist()
    docs = Counter(tuple(x for p in sorted(p for k2, p in pieces if k2 == k) for x in pieces[k, p]) for k in {k for k, _ in pieces})
    assert docs == Counter(ids for r in rows if (ids := tuple(e.encoding.encode_ordinary(r[1] or ""))))


def test_best_fit_decreasing_brute():
    """Each piece, longest first, goes to the open row with the least room that is enough."""
    r = np.random.default_rng(12)
    for _ in range(20):
        lengths = r.integers(0, 33, 120).tolist()
        rooms, rows = [], []
        for i in sorted((i for i, n in enumerate(lengths) if n), key=lambda i: (-lengths[i], i)):
            fit = [(room, -k) for k, room in enumerate(rooms) if room >= lengths[i]]
            if fit:
                k = -min(fit)[1]
            else:
                k = len(rooms)
                rooms.append(32)
                rows.append([])
            rooms[k] -= lengths[i]
            rows[k].append(i)
        got = pack(lengths, 32)
        assert sorted(32 - sum(lengths[i] for i in x) for x in got) == sorted(rooms) and sorted(sum(got, [])) == sorted(sum(rows, []))


def test_best_fit():
    tree = CapacityTree(10)
    for room, row in ((3, 0), (5, 1), (9, 2)):
        tree.add(room, row)
    assert tree.take(4) == (5, 1) and tree.take(4) == (9, 2) and tree.take(4) is None
    assert pack([6, 5, 4, 5, 0], 10) == [[0, 2], [1, 3]]


def test_urls(spark):
    urls = ["http://A.Net/x", "https://m.example.net/en/1?q", "http://example.com/de/", "http://x.org/fr/a", "http://net", None, "junk", "http://net/y", "http://net/y"]
    rules = spark.createDataFrame([("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")], "verdict string, host string, path string")
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(7, urls[7])], "page_id long, url string")
    got = sorted(tuple(r) for r in judge_urls(pages, rules).select("page_id", "rule", "verdict").fillna("-").collect())
    assert got == [(0, "net/", "block"), (1, "example.net/en/", "allow"), (2, "example.com/de/", "block"), (3, "org/fr/", "allow"), (4, "-", "allow"), (5, "-", "allow"), (6, "-", "allow"), (7, "net/", "block"), (7, "net/", "block"), (8, "net/", "block")]
    assert judge_urls(pages.limit(0), rules).count() == 0 and judge_urls(pages, rules.limit(0)).where("rule is not null").count() == 0


def test_urls_of_one_row_repeated(spark, monkeypatch):
    """Many copies of one row come back as many, from several lots."""
    from lumenvec.llm import url_rules

    monkeypatch.setattr(url_rules, "COPIES", 7)
    rows = [(None, None)] * 50 + [(1, "http://a.net/x")] * 7 + [(2, "http://b.org/fr/")] * 8 + [(3, "x://c")]
    rules = spark.createDataFrame([("block", "net", "/"), ("allow", "org", "/fr/")], "verdict string, host string, path string")
    got = Counter(tuple(r) for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string").repartition(3), rules).select("page_id", "rule", "verdict").collect())
    assert got == {(None, None, "allow"): 50, (1, "net/", "block"): 7, (2, "org/fr/", "allow"): 8, (3, None, "allow"): 1}


def test_leaks_in_other_scripts(spark):
    """Upper-case copies of Greek, Cyrillic and Armenian items are found by their words."""
    greek = " ".join("λόγος κόσμος άνθρωπος θάλασσα ουρανός δρόμος βιβλίο σχολείο πόλη χώρα μήνας ημέρα νύχτα φως νερό αέρας".split())
    russian = "москва город река дорога книга школа страна месяц день ночь свет вода воздух земля небо море"
    armenian = "քաղաք գետ ճանապարհ գիրք դպրոց երկիր ամիս օր գիշեր լույս ջուր օդ հող երկինք ծով լեռ"
    bench = spark.createDataFrame(list(enumerate((greek, russian, armenian))), "item_id long, text string")
    docs = spark.createDataFrame([(k, "x " + t.upper()) for k, t in enumerate((greek, russian, armenian))] + [(9, greek[:40])], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in find_leaks(docs, bench).collect()) == [(0, 0), (1, 1), (2, 2)]


def test_leaks(spark, odd):
    df, _ = odd
    item = "In Paris, Alice has 12 apples and buys 5 kg more for Bob, so Alice now owns how many apples in total?"
    bench = spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Now. " + item), (2, "So in Rome, Carol has 40 apples and buys 7 lbs more for Dave, so Carol now owns how many apples in total?"), (3, "So in Rome, Carol has 40 apples and buys 7 lbs more for Dave, so Eve now owns how many apples in total?"), (4, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.reparameterised) for r in find_leaks(docs, bench).collect()) == [(1, False), (2, True)]
    assert drop_leaks(df, bench).count() == df.count() and find_leaks(docs, bench.limit(0)).count() == 0


def test_leaks_with_one_changed_slot(spark):
    """A value that the item holds twice and the copy once changed: only the windows with the change go."""
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    item = [*words[:20], "5", *words[20:40], "5", *words[40:]]
    copy = [*item[:41], "6", *item[42:]]
    thrice = [*words[:15], "5", *words[15:30], "5", *words[30:45], "5", *words[45:]]
    other = [{"5": "8"}.get(w, w) for w in thrice]
    other[47] = "9"
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(thrice))], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(copy)), (2, " ".join(other))], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.matched, r.windows, r.reparameterised) for r in find_leaks(docs, bench).collect()}
    assert got[1, 1] == (47, 55, False) and got[2, 2] == (48, 56, True)


def _nearest(v, query, k=5):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(u @ u[query], 12)
    s[query] = -9
    return np.lexsort((np.arange(len(v)), -s))[:k].tolist()


def test_neighbours_brute(spark):
    """Ties, repeated rows, odd vectors and clashing columns; with all lists probed the search is exact."""
    v = np.random.default_rng(3).standard_normal((300, 8))
    v[200:260] = v[0]
    v[20], v[30] = v[20] * 1e200, v[30] * 1e-200
    rows = [(i, x.tolist(), 0, 0) for i, x in enumerate(v)] + [(400, None, 0, 0), (401, [0.0] * 8, 0, 0), (402, [float("nan")] * 8, 0, 0), (450, [None] * 8, 0, 0), (None, v[1].tolist(), 0, 0), (50, v[50].tolist(), 0, 0), (403, [1.0] * 9, 0, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, list int, cls int")
    got = nearest_neighbours(df).toPandas()
    v[20], v[30] = v[20] / 1e200, v[30] / 1e-200
    right = sum(len(set(g.vec_id) & set(_nearest(v, q))) for q, g in got.groupby("query_id"))
    assert right >= 0.9 * 30 and len(got) == 30 and (got.groupby("query_id")["rank"].max() == 5).all()
    for q, g in got.groupby("query_id"):
        u = v / np.linalg.norm(v, axis=1, keepdims=True)
        g = g.sort_values("rank")
        assert np.allclose(g.score, u[g.vec_id] @ u[q]) and (np.diff(g.score) <= 0).all()
    assert got[got.query_id == 0].sort_values("rank").vec_id.tolist() == [200, 201, 202, 203, 204] == got[got.query_id == 200].sort_values("rank").vec_id.replace({0: 200}).tolist()[:1] + [201, 202, 203, 204]
    few = df.where("vec_id in (0, 1, 2)")
    assert sorted((r.query_id, r.vec_id) for r in nearest_neighbours(few).collect()) == [(0, 1), (0, 2)]
    assert nearest_neighbours(df.limit(0)).count() == 0 and nearest_neighbours(df.where("vec_id = 0")).count() == 0


@pytest.mark.parametrize("kind", ["normal", "clusters"])
def test_neighbours_recall(spark, kind):
    """Thousands of vectors in many lists, of which few are probed: recall of at least 0.9, and no query is short."""
    from lumenvec.llm import ann

    r = np.random.default_rng(4)
    v = r.standard_normal((4000, 32))
    if kind == "clusters":  # some with fewer members than results asked for
        v = r.standard_normal((1500, 32))[r.integers(0, 1500, 4000)] * 5 + v
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    index = ann.Index(v, 4000, 6)
    assert len(index.centroids) == 63 and index.probes < 63
    got = nearest_neighbours(df).toPandas()
    assert got.groupby("query_id").size().eq(5).all() and got.query_id.nunique() == 80
    hits = sum(len(set(g.vec_id) & set(_nearest(v, q))) for q, g in got.groupby("query_id"))
    print(f"{kind}: recall {hits / 400:.3f}, {index.probes} of 63 lists")
    assert hits >= 0.9 * 400


def test_chat(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "ann", "hi <|x"), (1, 2, "bob", None), (1, 3, None, "z"), (None, None, "ann", "q"), (1, 1, "ann", "hi <|x"), (2, 1, "a!", "p"), (2, 2, "a?", "q"), (2, 3, "unknown", ""), (2, 4, None, "r"), (3, 1, "system", "alone")]
    turns = spark.createDataFrame([(*x, "extra", 0) for x in rows], "conv_id long, turn long, role string, text string, perspective string, part int")
    got = {(r.conv_id, r.perspective): r for r in rotate_perspectives(turns).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (1, None), (None, "ann"), (2, "a!"), (2, "a?"), (2, "unknown"), (2, None)}
    r = got[1, "ann"]
    assert r.rendered == "<|system|>\ns<|end|>\n" + "<|assistant|>\nhi < |x<|end|>\n" * 2 + "<|user:bob|>\n<|end|>\n<|user|>\nz<|end|>\n" and r.n_turns == 5
    assert [r.rendered[a:b] for a, b in r["mask"]] == ["hi < |x<|end|>\n"] * 2
    assert got[2, None].rendered == "<|user:a%21|>\np<|end|>\n<|user:a%3F|>\nq<|end|>\n<|user:unknown|>\n<|end|>\n<|assistant|>\nr<|end|>\n"
    assert rotate_perspectives(turns.limit(0)).count() == 0


def test_chat_bounds_parts_and_equals_its_sql(spark):
    """A conversation of many turns, many messages without turn, one message repeated; against the registered SQL."""
    import duckdb

    from lumenvec.llm.registry import ORACLE_SQL

    rows = [(1, i, ["ann", "bob", "ce c"][i % 3], f"t{i}") for i in range(600)] + [(1, None, ["ann", None][i % 2], f"n{i}") for i in range(3000)] + [(2, 5, "ann", "same")] * 2500
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = rotate_perspectives(turns).withColumn("mask", F.array_join(F.transform("mask", lambda s: F.concat_ws("-", s["from"], s["to"])), ";")).toPandas()
    assert out.n_turns.max() == 1024 and out[out.conv_id == 2].n_turns.sum() == 2500
    con = duckdb.connect()
    con.register("conversations", turns.toPandas().astype({"turn": "Int64"}))
    want = con.execute(ORACLE_SQL["op1_chat"]).df()
    cols = ["conv_id", "perspective", "part", "first_message", "n_turns", "n_messages", "rendered", "mask"]
    assert sorted(map(str, out[cols].fillna("-").values.tolist())) == sorted(map(str, want[cols].fillna("-").values.tolist()))


@pytest.mark.parametrize("part", [1, 7, 100, 5000])
def test_chat_parts_are_the_whole_dialogue(spark, part):
    """Parts end to end, masks shifted, are one rendering, in the order of turn, role and text; over several tasks too."""
    rows = [(1, i // 3 if i % 5 else None, ["ann", "bob", None, "system"][i % 4], f"t{i * 7919 % 600:03d}") for i in range(600)] + [(None, 1, "x", "y"), (3, 1, "ann", "one"), (3, 1, "ann", "one")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    out = rotate_perspectives(turns, part_messages=part).toPandas()
    ordered = sorted((r for r in rows if r[0] == 1), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3]))
    for who in ("ann", "bob", None):
        mine = out[(out.conv_id == 1) & (out.perspective.isna() if who is None else out.perspective == who)].sort_values("part")
        assert mine.first_message.tolist() == [part * k for k in range(-(-600 // part))] == (mine.n_turns.cumsum() - mine.n_turns).tolist() and set(mine.n_messages) == {600}
        heads = [("<|assistant|>" if r[2] == who else "<|system|>" if r[2] == "system" else "<|user|>" if r[2] is None else f"<|user:{r[2]}|>") + "\n" for r in ordered]
        assert "".join(mine.rendered) == "".join(h + r[3] + "<|end|>\n" for h, r in zip(heads, ordered, strict=True))
        shifts = (mine.rendered.str.len().cumsum() - mine.rendered.str.len()).tolist()
        whole = "".join(mine.rendered)
        assert [whole[a + n : b + n] for n, spans in zip(shifts, mine["mask"], strict=True) for a, b in spans] == [r[3] + "<|end|>\n" for r in ordered if r[2] == who]


#: Held-out toxic rows of sf0.1 that must be found, and clean ones that may be called toxic, as shares.
RECALL, ALARMS = 0.9, 0.01


def test_toxicity_sample_is_bounded(spark):
    """Repeated rows of an id count once; class, byte and fold bounds hold; null labels, ids and texts are left out."""
    rows = [(i, "x" * (100 if i != 3 else 10_000), "en") for i in range(60)] + [(7, "x" * 100, "en")] * 50 + [(7, "other", "de"), (61, None, "en"), (None, "t", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(62)] + [(7, 0), (8, None), (None, 1)], "doc_id long, toxic int")
    got = sample(docs, labels, rows={0: 15, 1: 10}).toPandas()
    assert got.doc_id.is_unique and (got.y == 0).sum() == 15 and (got.y == 1).sum() <= 10 and (got.fold != 0).all() and 61 not in set(got.doc_id)
    few = sample(docs, labels, rows={0: 15, 1: 10}, most_bytes=800).toPandas()
    assert 0 < few.text.str.len().sum() <= 800 and set(few.doc_id) < set(got.doc_id)
    assert sample(docs.limit(0), labels).count() == 0 and train(docs, labels.limit(0))[1:] == ({}, 0.5)


def test_toxicity_sample_leaves_one_long_text_out(spark):
    """A text of over an eighth of the bound doesn't end the sample."""
    docs = spark.createDataFrame([(i, "word " * (5000 if i % 10 == 0 else 10), "en") for i in range(200)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    got = sample(docs, labels, most_bytes=20_000).toPandas()
    assert len(got) > 100 and got.text.str.len().max() == 50


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    """A word that only toxic rows behind the first 1,500 hold is learned, by shards too; it doesn't matter how the tables are cut, or that rows are repeated."""
    monkeypatch.setattr(toxic, "SHARD_ROWS", 700)
    monkeypatch.setattr(toxic, "LEAST_ROWS_SEEN", 12_000)
    r = np.random.default_rng(5)
    ids = [x.id for x in spark.range(4_200).where("crc32(cast(id as string)) % 5 not in (0, 1)").orderBy(F.xxhash64(F.lit(11), "id")).collect()]
    word = {k: "vile" if i < 1_500 else "quux" if i < 1_600 else "w0" for i, k in enumerate(ids)}
    rows = [(k, " ".join([*r.choice([f"w{j}" for j in range(60)], 6), w]), "en") for k, w in word.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, int(w != "w0")) for k, w in word.items()], "doc_id long, toxic int")
    fitted = train(docs, labels)
    asked = spark.createDataFrame([(1, "w1 quux w7", None), (2, "w1 w0 w7", None), (3, "w1 vile w7", "en")], "doc_id long, text string, lang string")
    assert [x.predicted for x in score_toxicity(asked, fitted).orderBy("doc_id").selectExpr("score >= 0.5 as predicted").collect()] == [True, False, True]
    again = train(docs.union(docs.where("doc_id % 9 = 0")).repartition(7), labels.repartition(3))
    assert (again[0].rows() == fitted[0].rows()).all()


def test_toxicity_scores_texts_alone_and_in_pieces(monkeypatch):
    """A text's score and gradients are the same beside others and alone, in one piece and in several; a text without words is like any other."""
    texts = [b"", b"one", b"two words", b" ".join(b"w%d" % (i * i % 50) for i in range(100)), b"...", b"the end of it"]
    offsets = np.cumsum([0, *map(len, texts)])
    feats, counts = toxic.features(np.frombuffer(b"".join(texts), np.uint8), offsets)
    model, y = toxic.Cnn(), np.array([0, 1, 0, 1, 0, 1], np.float32)
    whole, steps = model.logits(feats, counts), model.step(feats, counts, y)
    alone = [model.logits(feats[e - n : e], np.array([n]))[0] for e, n in zip(np.cumsum(counts), counts, strict=True)]
    np.testing.assert_allclose(whole, alone, atol=1e-5)
    monkeypatch.setattr(toxic, "BLOCK", 7)
    small = toxic.features(np.frombuffer(b"".join(texts), np.uint8), offsets)
    assert (small[0] == feats).all() and (small[1] == counts).all()
    np.testing.assert_allclose(whole, model.logits(feats, counts), atol=1e-5)
    for k, v in model.step(feats, counts, y).items():
        np.testing.assert_allclose(v, steps[k], atol=1e-5)


def test_toxicity_thresholds_count_every_row(spark):
    """The cut of the highest F1 over all rows, by language and of all, against a plain search; ties, one value for many rows, few positives."""
    r = np.random.default_rng(8)
    y = r.random(3_000) < 0.2
    score = np.round(1 / (1 + np.exp(-r.normal(3.0 * y - 1.5, 1.2))), 3).clip(0.001, 0.999)
    lang = r.choice(["en", "de", "fr", ""], 3_000, p=[0.6, 0.3, 0.09, 0.01])
    y[lang == ""] = False
    y[np.flatnonzero(lang == "fr")[9:]] = False

    def plain(s, y):
        cuts = np.unique(s)[::-1]
        f1 = [2 * y[s >= c].sum() / ((s >= c).sum() + y.sum()) for c in cuts]
        i = int(np.argmax(f1))
        return (cuts[i] + (cuts[i + 1] if i + 1 < len(cuts) else 0)) / 2

    shape = "lang string, y int, score double"
    rows = [(x or None, int(t), float(s)) for x, t, s in zip(lang, y, score, strict=True)]
    by_lang, overall = toxic.best_thresholds(spark.createDataFrame(rows, shape))
    assert set(by_lang) == {"en", "de"} and overall == pytest.approx(plain(score, y))
    assert all(v == pytest.approx(plain(score[lang == k], y[lang == k])) for k, v in by_lang.items())
    assert toxic.best_thresholds(spark.createDataFrame([("en", 0, 0.3)] * 20, shape)) == ({}, 0.5)


def test_neighbours_of_an_id_with_two_vectors(spark):
    """Rows that share an id count as one candidate and one query."""
    r = np.random.default_rng(3)
    v = r.normal(size=(120, 8))
    rows = [(i, v[i].tolist()) for i in range(120)] + [(i, (v[50] + 0.01 * r.normal(size=8)).tolist()) for i in (26, 50, 50, 99)] + [(26, v[26].tolist())]
    got = nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    assert set(got.query_id) == {0, 50, 100}
    for q, g in got.groupby("query_id"):
        assert len(g) == g.vec_id.nunique() == 5 and q not in set(g.vec_id) and sorted(g["rank"]) == [1, 2, 3, 4, 5]


def test_toxicity(spark, odd):
    df, _ = odd
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    fitted = train(docs, labels)
    got = score_toxicity(df, fitted)
    assert got.count() == df.count() and got.where("score is null or score < 0 or score > 1").count() == 0
    m = score_toxicity(docs, fitted).join(labels.withColumnRenamed("toxic", "y"), "doc_id").where("crc32(cast(doc_id as string)) % 5 = 0").toPandas()
    toxic, clean = m[m.y == 1], m[m.y == 0]
    recall, alarms = (toxic.score >= 0.5).mean(), (clean.score >= 0.5).mean()
    print(f"held-out recall {recall:.3f} of {len(toxic)}, false alarms {alarms:.4f} of {len(clean)}")
    assert recall >= RECALL and alarms <= ALARMS
    assert drop_toxic(df, fitted).columns == df.columns and train(docs, labels.limit(0))[1:] == ({}, 0.5)


def test_near_duplicates_of_repeated_rows_and_large_groups(spark):
    """Repeated rows of one id cost their number; a group of near copies is settled by its head, in small blocks the rest too."""
    r = np.random.default_rng(8)
    words = ["w%d" % i for i in range(500)]
    base = r.choice(words, 120).tolist()
    rows = [(1, " ".join(base))] * 3000
    for i in range(2, 1300):
        copy = list(base)
        copy[int(r.integers(0, 120))] = f"x{i}"
        rows.append((i, " ".join(copy)))
    far = list(base)
    far[0:60:6] = ["y"] * 10
    rows += [(2000, " ".join(far)), (2001, " ".join([*far, "tail"])), (2002, " ".join(r.choice(words, 50)))]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), 85).dropDuplicates().toPandas().set_index("doc_id").sort_index()
    assert (got.loc[1:1299].component_id == 1).all() and got.loc[2002].component_id == 2002
    assert got.loc[2000].component_id == 2000 and got.loc[2001].component_id == 2000 and len(got) == 1302


def test_compare_leaves_the_components_of_all_pairs(spark, monkeypatch):
    """With blocks of four rows, star edges and the rest's blocks join what comparing all pairs joins."""
    from lumenvec.llm import near_dup

    monkeypatch.setattr(near_dup, "BLOCK_ROWS", 4)
    r = np.random.default_rng(9)
    sets = [np.unique(np.r_[K.mix(np.arange(g * 40, g * 40 + 40, dtype=K.U))[: int(r.integers(20, 41))], K.mix(np.arange(1000 + 10 * i, 1000 + 10 * i + int(r.integers(0, 8)), dtype=K.U))]) for i, g in enumerate(r.integers(0, 4, 60))]
    df = spark.createDataFrame([(0, i, len(s), s.tobytes()) for i, s in enumerate(sets)], near_dup.MEMBER)
    found = connected_components(near_dup._compare(df, near_dup._sets_overlap(60), 3, 2**62)).toPandas()
    up = {i: i for i in range(60)} | dict(zip(found.node, found.component))
    joined = near_dup.UnionFind()
    for a in range(60):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 60 * (len(sets[a]) + len(sets[b]) - both):
                joined.union(a, b)
    assert up == {i: joined.find(i) for i in range(60)} and len(set(up.values())) > 1


@pytest.mark.parametrize("spans", [2_000_000, 0])
def test_repeats_of_repeated_rows(spark, monkeypatch, spans):
    """Many rows of one id and text cost their number, whether or not the spans are broadcast; an empty table gives an empty result."""
    from lumenvec.llm import repeats

    monkeypatch.setattr(repeats, "BROADCAST_SPANS", spans)
    r = np.random.default_rng(1)
    one, other = (" ".join(r.choice(["w%d" % i for i in range(300)], 300)) for _ in range(2))
    df = spark.createDataFrame([(1, one)] * 3000 + [(2, other), (3, "tail " + other[100:500]), (4, None)], "doc_id long, text string").repartition(5)
    got = Counter((x.doc_id, x.n_removed, x.n_spans) for x in remove_repeats(df).collect())
    assert got == Counter({(1, len(one), 1): 3000, (2, 400, 1): 1, (3, 400, 1): 1, (4, 0, 0): 1})
    assert remove_repeats(df.limit(0)).count() == 0


def test_leaks_probes(spark, odd, monkeypatch):
    """Inserted words don't hide a conflict, case-folded copies and longer names are found, also names behind quotes and line breaks."""
    from lumenvec.llm import decontaminate

    df, _ = odd
    item = "In Paris, Alice has 12 apples and buys 5 kg more for Bob, so Alice now owns how many apples in total?"
    clash = "So in Rome, Carol has 40 apples and buys 7 lbs more for Dave, so then Eve now owns how many apples in total?"
    long = "So in New York, Mary Ann has 40 000 apples and buys 7 lbs more for Dave, so Mary Ann now owns how many apples in total?"
    quoted = "So in Rome,\n(\"Carol\" has 40 apples and buys 7 lbs more for  Dave, so Carol now owns how many apples in total?"
    mix = "mix 3 kg, 5 kg and 7 kg"
    bench = spark.createDataFrame([(7, item), (8, mix), (9, "12 + 5"), (10, "Hello")], "item_id long, text string")
    rows = [(1, clash), (2, item.lower()), (3, long), (4, quoted), (5, "now mix 4 kg, 6 kg and 9 kg well"), (6, "Of 13 + 6 say HELLO"), (7, "x " * 5000 + item + " y" * 5000), (8, "12 + 5"), (None, item.upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(2, 7, False), (3, 7, True), (4, 7, True), (5, 8, True), (6, 10, False), (7, 7, False), (8, 9, False), (None, 7, False)]
    for anchors in (decontaminate.ANCHORS, 0):
        monkeypatch.setattr(decontaminate, "ANCHORS", anchors)
        got = [(r.doc_id, r.item_id, r.reparameterised) for r in find_leaks(docs.unionByName(docs), bench).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert find_leaks(docs.limit(0), bench).count() == 0 and find_leaks(df, bench).count() == 0


def test_leaks_brute(spark):
    """All windows of all documents, without anchors, and the candidates' mappings in plain Python, on a whole table."""
    import regex

    from lumenvec.llm import decontaminate as d

    def literal(t):
        return regex.sub(f"[{regex.escape(d._PUNCTUATION + d._NUMERIC_MARKS)}]", " ", t).lower().split(" ")

    def template(t):
        t = regex.sub(r"\s{1,3}(?=\p{Lu})(?<=(?<![\p{L}\p{N}])\p{Lu}\p{L}{0,30}\s{1,3})", d.JOINT, t)
        t = regex.sub(rf"(?<![\p{{L}}\p{{N}}{d.JOINT}])(?=\p{{Lu}})", d.NAME, t)
        t = regex.sub(r"[$€£](?=\d)", " ", t)
        t = regex.sub(r"(?<!\d)[.,:/]|[.,:/](?!\d)", " ", t)
        t = regex.sub(r"(?<=\d) {1,3}(?=\d)", d.JOINT, t)
        t = regex.sub(rf"\d+(?:[.,:/{d.JOINT}]\d+)*", rf" {d.NUMBER}\g<0> ", t)
        t = regex.sub(rf"(?i)({d.NUMBER}[\d.,:/{d.JOINT}]+) +{d.NAME}?(%|(?:{'|'.join(d.UNITS)})(?!\p{{L}}))", rf"\1 {d.UNIT}\2", t)
        return regex.sub(f"[{regex.escape(d._PUNCTUATION)}]", " ", t if regex.search(r"\d", t) else regex.sub("[.,:/%€£]", " ", t)).lower().split(" ")

    def readings(t):
        for kind, read in ((False, literal), (True, template)):
            tokens = [x for x in read(t or "") if x]
            if tokens and (not kind or any(x[0] in d.NUMBER + d.NAME + d.UNIT for x in tokens)):
                yield kind, tokens

    def slot(x):
        return x[0] in d.NUMBER + d.NAME + d.UNIT

    def key(w):
        return tuple(x[0] if slot(x) else x for x in w)

    items = {}
    for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect():
        for kind, t in readings(r.text):
            if kind and len({x for x in t if not slot(x)}) < d.LEAST_WORDS:
                continue
            n = min(8, len(t))
            ws = {i: t[i : i + n] for i in range(len(t) - n + 1) if not all(slot(x) for x in t[i : i + n])}
            items[r.item_id, kind] = (len(t), n, ws)
    lookup = {}
    for k, (_, n, ws) in items.items():
        for i, w in ws.items():
            lookup.setdefault((k[1], n, key(w)), []).append((k, i))
    widths = {(kind, n) for kind, n, _ in lookup}
    want = set()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for r in docs.collect():
        hits = {}
        for kind, t in readings(r.text):
            for n in (n for k, n in widths if k == kind):
                for s in range(len(t) - n + 1):
                    for item, i in lookup.get((kind, n, key(t[s : s + n])), []):
                        w = items[item][2][i]
                        hits.setdefault(item, set()).add((s - i, i, tuple((i + j, x, t[s + j]) for j, x in enumerate(w) if slot(x))))
        for item, found in hits.items():
            length, _, ws = items[item]
            groups, last = [], None
            for h in sorted(found):
                if last is None or 2 * (h[0] - last) > length:
                    groups.append(set())
                groups[-1].add(h[1:])
                last = h[0]
            matched = set()
            for g in groups:
                places = {p for _, slots in g for p in slots}
                pairs = {p[1:] for p in places}
                if len(pairs) > len({a for a, _ in pairs}) or len(pairs) > len({b for _, b in pairs}):
                    pairs = {(a, b) for a, b in pairs if 2 * sum(p[1:] == (a, b) for p in places) > max(sum(p[1] == a for p in places), sum(p[2] == b for p in places))}
                matched |= {i for i, slots in g if all(a == b for _, a, b in slots) or all((a, b) in pairs for _, a, b in slots)}
            if len(matched) >= d.COVERAGE * len(ws):
                want.add((r.doc_id, item[0]))
    got = {(r.doc_id, r.item_id) for r in find_leaks(docs, spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")).collect()}
    assert got == want and want


def test_apportionment_seat_by_seat(spark):
    """Quotas of every house equal seats given one by one to the highest quotient, also far from the exact shares."""
    import heapq

    from lumenvec.llm.mix import apportion

    r = np.random.default_rng(6)
    for case in range(4):
        n = [3, 28, 40, 7][case]
        sizes = [float(x) for x in (r.pareto(0.4, n) + 0.01 if case else [6.0, 2.0, 4.0])]
        sizes[-1] = 0.0 if case == 3 else sizes[-1]
        names = [f"s{i:02d}" for i in range(n - 1)] + [None]
        houses = [5, 17, 400, 20_000]
        got = {x.source: x.upto for x in apportion(spark.createDataFrame(list(zip(names, sizes)), "source string, target double"), houses).collect()}
        heap = [(-t, i, 0) for i, t in enumerate(sizes) if t > 0]
        heapq.heapify(heap)
        held, given = [0] * n, 0
        for h, house in enumerate(houses):
            while given < house:
                _, i, k = heapq.heappop(heap)
                held[i], given = k + 1, given + 1
                heapq.heappush(heap, (-sizes[i] / (2 * k + 3), i, k + 1))
            assert [got[x][h] for x in names] == held


def test_shards_of_the_mix_meet_their_quotas(spark):
    r = np.random.default_rng(7)
    rows = [(i, "\n".join(f"d{i}w{k}" for k in range(int(r.integers(20, 300)))), ["a", "b", None][i % 3 if i % 7 else 0], "en", 0) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    got = mix_sources(df, block_words=64, shards=4).toPandas()
    assert (got.taken == got.shard_words.map(sum)).all()
    for _, g in got.groupby("source", dropna=False):
        first = g.iloc[0]
        words = np.sum(g.shard_words.tolist(), 0)
        quota = np.diff([0, *first.upto]) * first.block_words
        assert (abs(words - quota) <= first.block_words).all()  # the last block may be short
        assert abs(words.sum() - first.target) <= 2 * first.block_words
    made = mixed_documents(df, block_words=64, shards=4, by_shard=True).toPandas()
    words = made.text.str.split().str.len().groupby(made.shard).sum()
    assert words.tolist() == np.sum(got.shard_words.tolist(), 0).tolist() and "\n" in made.text[0] and " " not in "".join(made.text)
    assert not made.duplicated(["doc_id", "pass", "shard"]).any()


def test_urls_brute(spark, monkeypatch):
    """Nested and sibling hosts and paths in many ranges, against every rule for every URL; clashing columns."""
    from lumenvec.llm import url_rules

    monkeypatch.setattr(url_rules, "RANGE_HOSTS", 7)
    r = np.random.default_rng(10)
    label = lambda: ["a", "b", "ab", "a-b", "c1"][int(r.integers(0, 5))]
    host = lambda most: ".".join(label() for _ in range(int(r.integers(1, most))))
    path = lambda: "/" + "/".join(label() for _ in range(int(r.integers(0, 3))))
    rules = {(host(4), path()): ["block", "allow"][int(r.integers(0, 2))] for _ in range(60)} | {("b", "/"): "block"}
    urls = ["https://" + host(5).upper() + path() + ["", "?q=/a", "#x"][int(r.integers(0, 3))] for _ in range(400)] + [None, "no", "x://", "http://b./", "http://a..b/"]
    pages = spark.createDataFrame([(i, u, "k", "h", 0) for i, u in enumerate(urls)], "page_id long, url string, key string, host string, range int")
    table = spark.createDataFrame([(v, h, p) for (h, p), v in rules.items()], "verdict string, host string, path string")
    for row in judge_urls(pages, table).collect():
        u = urls[row.page_id] or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        h = rest.split("/")[0].split("?")[0].split("#")[0]
        p = rest[len(h) :].split("?")[0].split("#")[0]
        fit = [(len(x) + len(y), len(x), x + y, v) for (x, y), v in rules.items() if (h.lower() == x or h.lower().endswith("." + x)) and p.startswith(y)]
        best = max(fit, default=(0, 0, None, "allow"))
        assert (row.host, row.path, row.rule, row.verdict) == (h.lower(), p, best[2], best[3]), u


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_mix_takes_whole_blocks_of_one_size_on_given_tables(spark, sf):
    """The same blocks for every source, quotas that are Sainte-Lague seats one by one, a seeded choice of blocks, words near targets."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    got = mix_sources(docs).toPandas()
    assert set(got.block_words) == {2048}
    plan = got.drop_duplicates("source").sort_values("source")
    total = round(plan.target.sum() / 2048)
    seats = [0] * len(plan)
    for n in range(1, total + 1):
        best = max(range(len(plan)), key=lambda k: (plan.target.iloc[k] / (2 * seats[k] + 1), -k))
        seats[best] += 1
        if n in [total * k // 8 for k in range(1, 9)]:
            shard = max(k for k in range(1, 9) if total * k // 8 == n)
            assert [u[shard - 1] for u in plan.upto] == [min(s, 2 * b) for s, b in zip(seats, plan.blocks)]
    for _, g in got.groupby("source"):
        first = g.iloc[0]
        assert abs(g.taken.sum() - first.target) <= 1 or abs(g.taken.sum() - first.upto[-1] * 2048) <= 2048 and abs(first.target - first.upto[-1] * 2048) > 2048
        if first.blocks > 4:
            assert first.step > 1  # blocks are scattered by the permutation, not a run of the order
        assert sum(0 < t % s for t, s in zip(g.taken, g["size"]) if s) <= 16 + (g["size"] > 2048).sum() * 2  # few documents are cut
    assert (got.taken <= 2 * got["size"]).all()
    again = mix_sources(docs.repartition(5)).toPandas()
    assert sorted(zip(got.doc_id, got.taken)) == sorted(zip(again.doc_id, again.taken))


def test_leaks_of_many_items_move_no_texts(spark, monkeypatch):
    """Where the benchmark's windows are too many to broadcast, its join gets no text's tokens; copies of an item are judged once, and all returned."""
    from lumenvec.llm import decontaminate as d

    item = "In Paris, Alice has 12 apples and buys 5 kg more for Bob, so Alice now owns how many apples in total?"
    bench = spark.createDataFrame([(7, item), (8, item), (None, item), (9, "the quick brown fox jumps over the lazy dog today"), (7, "Hello")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " * 3000 + item), (2, "So in Rome, Carol has 40 apples and buys 7 lbs more for Dave, so Carol now owns how many apples in total?"), (3, "x")], "doc_id long, text string")
    want = [(1, 7, False), (1, 8, False), (1, None, False), (2, 7, True), (2, 8, True), (2, None, True)]
    joined = []

    def shuffled(df, rows, *_):
        joined.append(df)
        return df

    met, wide = d._met_windows, []
    monkeypatch.setattr(d, "_met_windows", lambda *x: wide.append(met(*x)) or wide[-1])
    for join in (d.maybe_broadcast, shuffled):
        monkeypatch.setattr(d, "maybe_broadcast", join)
        got = [(r.doc_id, r.item_id, r.reparameterised) for r in find_leaks(docs, bench).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
        assert [r.doc_id for r in drop_leaks(docs, bench).collect()] == [3]
    assert {(r.i1, r.i2) for r in joined[0].collect()} and len({(r.i1, r.i2) for r in joined[0].collect()}) < bench.count()
    assert all(max(sum(len(x) for x in r.w) for r in w.collect()) < 200 and set(w.columns) == {"b1", "b2", "template", "width", "s", "k", "w"} for w in wide)
