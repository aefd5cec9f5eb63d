"""Spelling variants: words one edit apart, found by dense tiles of code points and common prefix and suffix lengths."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenvec.llm.common import materialize, maybe_broadcast, python_tasks, small_batches
from lumenvec.llm.kernels import release

#: Fixed value: what a word consists of.
RUN = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
#: One run in so many loses a code point before runs are counted.
SLIP = 199
#: Different runs that a task counts before it hands them on.
HELD_WORDS = 200_000
#: Words of a tile's side, and words that share a key before they are cut into parts.
TILE, CROWD = 256, 4096
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _counts(slip: int, least_length: int):
    pattern = re.compile(RUN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def emit() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                for doc, text in zip(batch.column(0).slice(lo, 64).to_pylist(), batch.column(1).slice(lo, 64).to_pylist(), strict=True):
                    seed = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                    for word, n in Counter(pattern.findall(text)).items():
                        if not word.islower():
                            word = word.translate(_LOWER)
                        h = zlib.crc32(word.encode(), seed)
                        if h % slip == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                        if len(word) >= least_length:
                            held[word] += n
                    if len(held) > HELD_WORDS:
                        yield emit()
        yield emit()
        release()

    return run


def word_counts(docs: DataFrame, slip: int = SLIP, least_length: int = LEAST_LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): runs of letters, A-Z lower-cased, one in ``slip`` of them (by a hash of document and run) short of a code point."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    return rows.mapInArrow(_counts(slip, least_length), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def keys(words: DataFrame) -> DataFrame:
    """(longer, side, shared, word, n): each word under all keys at which a word one edit apart meets it.

    If the longer of two has m code points, what they share at both ends comes to m - 1 at least, so one end has half of that, rounded up.
    A word meets those of its own length and shorter ones by one (m its length), and those longer by one (m one more).
    """
    each = F.explode(F.expr("array(named_struct('longer', length(word), 'tail', false), named_struct('longer', length(word), 'tail', true), named_struct('longer', length(word) + 1, 'tail', false), named_struct('longer', length(word) + 1, 'tail', true))"))
    met = words.select("word", "n", each.alias("k")).select("word", "n", "k.longer", "k.tail")
    half = F.expr("longer div 2")
    return met.select("longer", "tail", F.when(F.col("tail"), F.expr("right(word, longer div 2)")).otherwise(F.substring(F.col("word"), F.lit(1), half)).alias("shared"), "word", "n")


def tiled(met: DataFrame, crowd: int) -> DataFrame:
    """``met`` with (part, other, mine): keys with over ``crowd`` words are cut into parts by hash, and every two parts meet once, a part with itself too."""
    sizes = met.groupBy(F.col("longer").alias("__longer"), F.col("tail").alias("__tail"), F.col("shared").alias("__shared")).agg(F.count("*").alias("words")).where(F.col("words") > crowd)
    crowded = materialize(sizes.withColumn("parts", F.ceil(2 * F.col("words") / crowd).cast("int")), "crowded")
    same = (F.col("longer") == F.col("__longer")) & (F.col("tail") == F.col("__tail")) & (F.col("shared") == F.col("__shared"))
    dealt = met.join(maybe_broadcast(crowded, crowded.count()), same, "left").drop("__longer", "__tail", "__shared", "words")
    dealt = dealt.withColumn("mine", F.coalesce(F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"), F.lit(0)))
    meets = F.explode(F.expr("sequence(0, coalesce(parts, 1) - 1)"))
    return dealt.withColumn("o", meets).withColumn("part", F.least("mine", "o")).withColumn("other", F.greatest("mine", "o")).drop("o", "parts")


def common_ends(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Code points that rows of ``a`` and ``b`` share from the left, for every pair; unlike paddings never match."""
    alive = np.ones((len(a), len(b)), bool)
    shared = np.zeros((len(a), len(b)), np.uint16)
    for c in range(a.shape[1]):
        alive &= a[:, c, None] == b[None, :, c]
        if not alive.any():
            break
        shared += alive
    return shared


def _matrices(words: list[str], width: int, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points padded to ``width``, from the left end and from the right end on."""
    lengths = np.array([len(w) for w in words])
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    rows, place = np.repeat(np.arange(len(words)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    left, right = (np.full((len(words), width), pad, np.uint32) for _ in range(2))
    left[rows, place] = flat
    right[rows, np.repeat(lengths, lengths) - 1 - place] = flat
    return left, right


def near_pairs(words: list[str], groups: np.ndarray, mine: np.ndarray, cross: np.ndarray, tail: np.ndarray, longer: np.ndarray, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of words one edit apart within each run of equal ``groups``.

    Tiles of ``tile`` consecutive words meet as long as they share a group. Two words of ``longer`` - 1 code points meet elsewhere; words of one
    part do where parts ``cross``; those that share the head too were found by it, where they meet at the ``tail``.
    """
    n, found = len(words), []
    lengths = np.array([len(w) for w in words])
    for lo in range(0, n, tile):
        hi = min(n, lo + tile)
        to = lo
        while to < n and (to < hi or groups[to] == groups[hi - 1]):
            end = min(n, to + tile)
            if to >= hi:
                end = to + int(np.searchsorted(groups[to:end], groups[hi - 1], side="right"))
            width = int(max(lengths[lo:hi].max(), lengths[to:end].max()))
            (al, ar), (bl, br) = _matrices(words[lo:hi], width, 1 << 30), _matrices(words[to:end], width, 1 << 31)
            m = longer[lo:hi, None]
            meet = (groups[lo:hi, None] == groups[None, to:end]) & (np.maximum(lengths[lo:hi, None], lengths[None, to:end]) == m)
            meet &= ~(cross[lo:hi, None] & (mine[lo:hi, None] == mine[None, to:end]))
            if to == lo:
                meet &= np.arange(lo, hi)[:, None] < np.arange(to, end)[None, :]
            if meet.any():
                head = common_ends(al, bl)
                meet &= head + common_ends(ar, br) >= m - 1
                meet &= ~(tail[lo:hi, None] & (head >= m // 2))
                i, j = np.nonzero(meet)
                found.append((i + lo, j + to))
            to = end
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *(i for i, _ in found)]), np.concatenate([none, *(j for _, j in found)])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, near, n): each word with each of its near words, from rows that are sorted by group; a batch's last group waits for its rest."""

    def solve(t: pa.Table) -> pa.RecordBatch:
        words, n = t.column("word").to_pylist(), t.column("n").to_numpy()
        columns = {c: t.column(c).to_numpy() for c in ("longer", "tail", "part", "other", "mine")}
        marks = _marks(t)
        i, j = near_pairs(words, np.cumsum(marks), columns["mine"], columns["part"] != columns["other"], columns["tail"].astype(bool), columns["longer"])
        a, b = np.concatenate([i, j]), np.concatenate([j, i])
        return pa.RecordBatch.from_arrays([pa.array([words[x] for x in a], pa.string()), pa.array([words[x] for x in b], pa.string()), pa.array(n[b], pa.int64())], ["word", "near", "n"])

    def _marks(t: pa.Table) -> np.ndarray:
        """1 where a row's group isn't that of the row before."""
        new = np.zeros(t.num_rows, np.int64)
        for c in ("longer", "tail", "shared", "part", "other"):
            values = np.array(t.column(c).to_pylist(), object)
            new[1:] |= values[1:] != values[:-1]
        return new

    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        starts = np.flatnonzero(_marks(t))
        cut = int(starts[-1]) if len(starts) else 0
        if cut:
            yield solve(t.slice(0, cut))
        rest = t.slice(cut)
    if rest is not None:
        yield solve(rest)
    release()


def near_words(words: DataFrame, crowd: int = CROWD, tasks: int | None = None) -> DataFrame:
    """(word, near, n): every word with each word that differs by one inserted, deleted or replaced code point, and that one's n.

    Words meet under the keys of ``keys`` only; there, tiles of padded code points are compared all at once. A key with over ``crowd`` words is
    cut into parts whose pairs are dealt over tasks, so a task holds at most about ``crowd`` words of a key, whatever their number.
    """
    group = ["longer", "tail", "shared", "part", "other"]
    met = tiled(keys(words), crowd)
    tasks = tasks or python_tasks(words.sparkSession, 4 * words.count(), 200_000)
    return met.repartition(tasks, *group).sortWithinPartitions(*group).select(*group, "mine", "word", "n").mapInArrow(_tiles, "word string, near string, n long")


def spelling_variants(docs: DataFrame, least_count: int = LEAST_COUNT, times: int = TIMES, slip: int = SLIP, least_length: int = LEAST_LENGTH, crowd: int = CROWD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of at least ``least_length`` code points and ``least_count`` occurrences.

    A word's form is the most frequent of its near words (one edit apart; ties to the first by code point) if that is at least ``times`` as
    frequent, else null. Its root is found by following forms, whose counts rise, so their number is at most the logarithm of the largest
    count; each round of joins doubles the steps.

    Null and empty texts have no words; a null id is an empty string in the hash; repeated rows count again; an empty table gives an empty
    result; other columns are not looked at.
    """
    words = materialize(word_counts(docs, slip, least_length, id_col, text_col).where(F.col("n") >= least_count), "words")
    near = near_words(words, crowd).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("m"), F.col("near"))).alias("best"))
    best = materialize(near.select(F.col("word").alias("__word"), "n_near", F.col("best.near").alias("near"), (-F.col("best.m")).alias("near_n")), "near")
    joined = words.join(best, words["word"] == best["__word"], "left")
    has = F.coalesce(F.col("near_n") >= times * F.col("n"), F.lit(False))
    forms = materialize(joined.select("word", F.when(has, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("near_n")).alias("form_n")), "forms")
    steps = forms.where("form is not null").select("word", F.col("form").alias("root"))
    most = forms.agg(F.max("n")).first()[0] or 1
    longest = 0
    while times > 1 and times**longest <= most:
        longest += 1
    for _ in range(max(1, longest).bit_length()):
        further = steps.select(F.col("word").alias("__w"), F.col("root").alias("__r"))
        steps = materialize(steps.join(further, steps["root"] == further["__w"], "left").select("word", F.coalesce("__r", "root").alias("root")), "steps")
    rooted = steps.select(F.col("word").alias("__w"), "root")
    return forms.join(rooted, forms["word"] == rooted["__w"], "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
