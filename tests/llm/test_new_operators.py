"""Fewest sequences, conversation repair and spelling variants against brute force."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumenvec.llm import bin_completion as B
from lumenvec.llm import registry, repair, variants

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    """Nulls, empty and long texts, repeated rows and ids, other columns."""
    r = np.random.default_rng(3)
    words = ["Word%d" % i for i in range(200)] + ["a\nb", "é", "x  y"]
    rows = [(0, None, 1), (1, "", 2), (None, " ", 3), (2, "one  two <|endoftext|> three", 4), (2, "one  two <|endoftext|> three", 4)]
    rows += [(i, " ".join(r.choice(words, int(n))), 0) for i, n in enumerate([5, 40, 300, 900, 2500, 9000, 700, 700, 12], 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, length long"), rows


# --- op11


def _optimum(items: list[int], capacity: int) -> int:
    best = len(items)

    def go(i: int, rooms: list[int]) -> None:
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= items[i] and rooms[k] not in rooms[:k]:
                rooms[k] -= items[i]
                go(i + 1, rooms)
                rooms[k] += items[i]
        go(i + 1, [*rooms, capacity - items[i]])

    items = sorted(items, reverse=True)
    go(0, [])
    return best


def _bins(counts, capacity):
    search = B.Completion(counts, capacity)
    first, bins = search.bins, search.solve()
    held = Counter()
    for sizes, times in bins:
        assert sum(sizes) <= capacity and times > 0
        for s in sizes:
            held[s] += times
    assert held == {s: n for s, n in enumerate(counts.tolist()) if n}
    n = sum(t for _, t in bins)
    assert search.bound <= n <= first
    return n


def test_completion_finds_the_optimum():
    r = np.random.default_rng(1)
    for _ in range(150):
        capacity = int(r.integers(10, 40))
        items = r.integers(1, capacity + 1, int(r.integers(0, 11))).tolist()
        assert _bins(np.bincount(items, minlength=capacity + 1) if items else np.zeros(capacity + 1, int), capacity) == (_optimum(items, capacity) if items else 0)


def test_completion_beats_best_fit_and_takes_any_counts():
    ones = np.zeros(2049, np.int64)
    ones[[1, 2048]] = 10**9, 7
    assert _bins(ones, 2048) == 7 + -(-(10**9) // 2048)
    r = np.random.default_rng(2)
    counts = np.bincount(np.minimum(2048, r.lognormal(5.5, 1, 50_000) + 1).astype(int), minlength=2049)
    assert _bins(counts, 2048) == -(-int((counts * np.arange(2049)).sum()) // 2048)
    counts = np.zeros(13, np.int64)
    counts[[6, 4, 3]] = 4, 3, 4  # best fit pairs the sixes; the fours and threes then need more bins than 6 + 3 + 3 and 4 + 4 + 4
    assert _bins(counts, 12) == 4


def _check_packed(got, rows, capacity):
    tokenizer = Tokenizer.from_file(B.TOKENIZER)
    want, by_sequence = Counter(), defaultdict(list)
    for doc, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        n, at = -(-len(ids) // capacity), 0
        for k in range(n):
            to = len(ids) - (n - 1 - k) * capacity
            want[doc, k, at, to - at, zlib.crc32(np.array(ids[at:to], "<u4").tobytes())] += 1
            at = to
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    for held in by_sequence.values():
        assert [o for o, _ in sorted(held)] == [0, *itertools.accumulate(n for _, n in sorted(held))][:-1] and sum(n for _, n in held) <= capacity
    return len(by_sequence)


def test_sequences_hold_all_ids(spark, texts):
    df, rows = texts
    for capacity in (2048, 64):
        got = B.pack_sequences(df.repartition(3), capacity).collect()
        lengths = [r.length for r in got]
        n = _check_packed(got, rows, capacity)
        assert n == (_optimum(lengths, capacity) if capacity == 2048 else -(-sum(lengths) // capacity))
    assert B.pack_sequences(df.limit(0)).count() == 0
    packed = B.pack_sequences(df, keep_ids=True)
    pieces = {(r.sequence_id, r.offset): r.ids for r in packed.collect()}
    for s in B.sequences(packed).collect():
        assert s.input_ids == b"".join(pieces[k] for k in sorted(pieces) if k[0] == s.sequence_id) and len(s.input_ids) == 4 * s.n_tokens == 4 * s.cu_lengths[-1]


def test_query_packs_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = registry.op11_fewest_sequences(spark, DATA).collect()
    assert _check_packed(got, rows, 2048) == -(-sum(r.length for r in got) // 2048)


def test_word_encoder_is_the_tokenizer(spark):
    encoder = B.WordEncoder(Path(B.TOKENIZER).read_text(encoding="utf-8"))
    for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(60).collect():
        assert encoder.encode(r.text or "") == encoder.ids(r.text or "").tobytes()


# --- op12


def _space(x):
    return " " if x is None else str(x)


def _damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{_space(conv)}:{_space(turn)}".encode()) % 20
        role, text = _space(role), _space(text)
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def _repaired(rows):
    """The cheapest edits by a plain table of (cost, audit, lines) from the end, states by the last initial."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    seen, kinds = set(), []
    for _, _, role, text in rows:
        trimmed = text.rstrip(" \t\n\x0b\x0c\r")
        kinds.append("blank" if not trimmed else "duplicate" if (role, text) in seen else "truncated" if trimmed[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    wants = {"": "user", "s": "user", "u": "assistant", "a": "user"}
    table = {q: (0, "", ()) if q in ("", "a") else None for q in ("", "s", "u", "a")}

    def close(best):
        for _ in range(3):
            for q in best:
                role = wants[q]
                rest = best[role[0]]
                if rest is not None:
                    way = (rest[0] + 2, "I" + rest[1], (f"{role}:", *rest[2]))
                    best[q] = way if best[q] is None or way[:2] < best[q][:2] else best[q]
        return best

    table = close(table)
    for (_, _, role, text), kind in zip(reversed(rows), reversed(kinds), strict=True):
        now = {}
        for q in table:
            ways = [(table[q][0] + 3, "D" + table[q][1], table[q][2])]
            if kind not in ("blank", "duplicate"):
                t = kind == "truncated"
                rest = table[wants[q][0]]
                ways.append((rest[0] + 2 + t, "R" + rest[1], (f"{wants[q]}:{text}", *rest[2])))
                if (q, role[:1]) in step:
                    rest = table[role[:1]]
                    ways.append((rest[0] + t, "K" + rest[1], (f"{role}:{text}", *rest[2])))
            now[q] = min(ways, key=lambda w: w[:2])
        table = close(now)
    turns = [r[1] for r in rows if r[1] is not None]
    cost, audit, lines = table[""]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *(kinds.count(k) for k in ("blank", "duplicate", "truncated")),
        sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows)),
        cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def _want(rows, damage=True):
    convs = {r[0]: [] for r in rows}
    for r in _damage(rows) if damage else [(c, t, _space(a), _space(b)) for c, t, a, b in rows]:
        convs[r[0]].append(r)
    return {c: _repaired(rs) for c, rs in convs.items()}


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_repair_query(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = registry.op12_repair(spark, path).collect()
    assert {r.conv_id: tuple(r[f] for f in FIELDS) for r in got} == _want(rows) and len(got) == len({r[0] for r in rows})


@pytest.mark.parametrize("bits", [12, 2])
def test_repair_of_odd_conversations(spark, bits):
    r = np.random.default_rng(5)
    roles, texts = ["system", "user", "assistant", "tool", "", None, "u2"], ["Yes.", "No", "", " \n", None, "Is it?\n", "A!", "é.", "b"]
    rows = [(int(c), None if r.random() < 0.1 else int(r.integers(0, n)), roles[int(r.integers(0, 7)) if c % 2 else int(r.integers(0, 3))], texts[int(r.integers(0, 9)) if c % 3 else int(r.integers(5, 9))] if r.random() < 0.7 else f"t{int(r.integers(0, 500))}.")
            for c, n in enumerate([1, 2, 3, 5, 8, 12, 20, 40, 300, 3, 9]) for _ in range(n)]
    rows += [(None, 1, "user", "Hm."), (None, 2, None, None), (50, 1, "user", "same.")] + [(50, 2, "assistant", "same.")] * 30
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit(1)).repartition(3)
    report, messages = repair.repair(df, bits)
    digests = {x.conv_id: x.repaired_sha256 for x in repair.digests(messages).collect()}
    got = {x.conv_id: (*[x[f] for f in FIELDS[:-1]], digests.get(x.conv_id, hashlib.sha256(b"").hexdigest())) for x in report.collect()}
    assert got == _want(rows, damage=False)
    empty, none = repair.repair(df.limit(0))
    assert empty.count() == none.count() == 0


def test_walk_keeps_square_root_checkpoints():
    codes = bytes(np.random.default_rng(7).choice([0, 1, 2, 3, 4, 5, 6, 7, 8, 13], 1000).astype(np.uint8))
    moves, state, cost = repair.walk(codes, repair.END, (0,))[0]
    assert cost + repair.END[state] == repair.before(codes, repair.END)[0]
    halves = repair.before(codes[600:], repair.END)
    first, middle, a = repair.walk(codes[:600], halves, (0,))[0]
    second, last, b = repair.walk(codes[600:], repair.END, (middle,))[0]
    assert (first + second, last, a + b) == (moves, state, cost)


# --- op13


def _edits(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _variants(rows, least=5, slip=199, length=6, times=5):
    n = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= length and c >= least}
    near = {w: [v for v in n if _edits(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), None if form[w] is None else n[form[w]])
    return out


def _found(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_variants_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert _found(registry.op13_variants(spark, DATA)) == _variants(rows)


@pytest.mark.parametrize("crowd", [4096, 8])
def test_variants_of_odd_texts(spark, crowd):
    r = np.random.default_rng(9)
    stems = ["".join(r.choice(list("abé"), int(r.integers(6, 9)))) for _ in range(60)]
    words = [s for s in stems for _ in range(int(r.integers(1, 40)))] + [s[:3] + "z" + s[3:] for s in stems for _ in range(5)]
    words += ["aaaaaa"] * 625 + ["aaaaaab"] * 125 + ["aaaaaabb"] * 25 + ["aaaaaabbb"] * 5 + ["ÉCOLES"] * 6 + ["éCOLES"] * 6 + ["x" * 40] * 5 + ["x" * 41] * 25
    r.shuffle(words)
    rows = [(i if i % 7 else None, " ".join(words[i :: 50]) + "-1") for i in range(50)] + [(1, None), (2, ""), (3, "A" * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("w")).repartition(4)
    assert _found(variants.spelling_variants(df, slip=5, crowd=crowd)) == _variants(rows, slip=5)
    assert variants.spelling_variants(df.limit(0)).count() == 0
