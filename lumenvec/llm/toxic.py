"""Toxicity: a convolutional text classifier over hashed word vectors, trained in shards by Spark's tasks, with thresholds calibrated by language."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pyspark.sql.types import DoubleType, StructField, StructType

from lumenvec.llm import kernels as K
from lumenvec.llm.common import maybe_broadcast, small_batches

#: Labelled rows of each class that ``sample`` takes unless told otherwise, and the bytes of all their texts together. The fit takes all.
SAMPLE_ROWS = {1: 1_500, 0: 3_000}
SAMPLE_BYTES = 64 << 20
#: Labelled texts that are trained on in one piece, and their bytes, at about most. With more, each shard is trained on by itself and the
#: shards' models are averaged after every pass.
SHARD_ROWS, SHARD_BYTES = 8_192, 64 << 20
#: Passes over all labelled rows at least, and rows that the fit sees at least, repeats counted, within 40 passes.
LEAST_PASSES, LEAST_ROWS_SEEN = 3, 24_000
#: Texts that a bucket must be in to have a vector at all, the share of words left out of each step, and the decay of
#: vectors: without them a few rows are learned by heart.
LEAST_TEXTS, WORD_DROPOUT, DECAY = 3, 0.3, 3e-4
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 15, 8, 8, (1, 2, 3)
#: Bytes of a word whose prefixes are hashed beside the word as a whole.
PREFIXES = (3, 4, 5, 6)
#: Languages with fewer positive calibration rows use the threshold of all.
LEAST_POSITIVE = 10
#: Words that are hashed or convolved at once, longer texts piece by piece; bins of a unit of the logit; what weights are multiplied by
#: to be summed as whole numbers, in whatever order they come.
BLOCK, BINS, SCALE = 1 << 16, 256, 1 << 24

#: What parts words: ASCII other than letters and digits.
_PARTS = np.zeros(256, bool)
_PARTS[:128] = [not chr(c).isalnum() for c in range(128)]


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of each word (whole word, then prefixes) and the number of words of each text; a text without words has none."""
    blank = data.copy()
    blank[_PARTS[data]] = 32
    starts, ends, counts = K.word_spans(blank, offsets)
    spans = [ends, *(np.minimum(starts + n, ends) for n in PREFIXES)]
    out = np.empty((len(starts), len(spans)), np.int32)
    for lo in range(0, len(starts), BLOCK):
        for i, e in enumerate(spans):
            out[lo : lo + BLOCK, i] = K.mix(K.span_hashes(data, starts[lo : lo + BLOCK], e[lo : lo + BLOCK]) + K.U(i)) & K.U(BUCKETS - 1)
    return out, counts


class Cnn:
    """Sum of hashed vectors per word, filters of several widths, ReLU, the maximum over all positions, a logistic unit."""

    def __init__(self, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        f = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
        self.p = {"e": f(BUCKETS, DIM, s=0.1), "w": f(sum(WIDTHS), DIM, FILTERS, s=0.3), "b": np.zeros((len(WIDTHS), FILTERS), np.float32), "v": f(len(WIDTHS) * FILTERS, s=0.3), "c": np.zeros(1, np.float32)}

    @classmethod
    def of(cls, rows: np.ndarray) -> Cnn:
        """The model of what ``rows`` gave."""
        self, at, flat = cls(), 0, rows.ravel()
        for k, v in self.p.items():
            self.p[k], at = flat[at : at + v.size].reshape(v.shape).astype(np.float32), at + v.size
        return self

    def rows(self) -> np.ndarray:
        """All weights in rows of ``DIM``, the vectors first."""
        flat = np.concatenate([v.ravel() for v in self.p.values()])
        return np.append(flat, np.zeros(-len(flat) % DIM, np.float32)).reshape(-1, DIM)

    def _vectors(self, feats: np.ndarray) -> np.ndarray:
        vec = self.p["e"][feats[:, 0]]
        for j in range(1, feats.shape[1]):
            vec = vec + self.p["e"][feats[:, j]]
        return vec

    def _responses(self, x: np.ndarray) -> np.ndarray:
        out, k = np.empty((len(x), len(WIDTHS) * FILTERS), np.float32), 0
        for i, width in enumerate(WIDTHS):
            r = np.zeros((len(x), FILTERS), np.float32)
            for j in range(width):
                y = x[j:] @ self.p["w"][k + j]
                r[: len(y)] += y
            out[:, i * FILTERS : (i + 1) * FILTERS] = np.maximum(r + self.p["b"][i], 0)
            k += width
        return out

    def _blocks(self, feats: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Pieces of texts, some ``BLOCK`` words together: the text of each, its first word there, where its responses begin and end, and all responses.

        A position reads on over as many words as a filter is wide, which are empty behind a text; each text has one position behind its end.
        """
        pad = max(WIDTHS)
        n = np.maximum(-(-counts // BLOCK), 1)
        text = np.repeat(np.arange(len(counts)), n)
        first = (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * BLOCK
        left = counts[text] - first
        words = np.minimum(left, BLOCK + pad - 1)
        places = np.where(left > BLOCK, BLOCK, left + 1)
        begin = (np.cumsum(counts) - counts)[text] + first
        lo = 0
        while lo < len(text):
            hi = max(lo + 1, lo + int(np.searchsorted(np.cumsum(words[lo:]), BLOCK, "right")))
            w = words[lo:hi]
            before = np.cumsum(w) - w
            start = before + pad * np.arange(len(w))
            local = np.arange(int(w.sum()))
            x = np.zeros((len(local) + pad * len(w), DIM), np.float32)
            x[local + pad * np.repeat(np.arange(len(w)), w)] = self._vectors(feats[local + np.repeat(begin[lo:hi] - before, w)])
            yield text[lo:hi], first[lo:hi], start, start + places[lo:hi], self._responses(x)
            lo = hi

    def logits(self, feats: np.ndarray, counts: np.ndarray) -> np.ndarray:
        pooled = np.zeros((len(counts), len(WIDTHS) * FILTERS), np.float32)
        for text, _, lo, hi, r in self._blocks(feats, counts):
            np.maximum.at(pooled, text, np.maximum.reduceat(r, np.stack([lo, hi], 1).ravel())[::2])
        return pooled @ self.p["v"] + self.p["c"]

    def step(self, feats: np.ndarray, counts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean log loss; only the positions that won the maximum carry any."""
        n = len(counts)
        g = {k: np.zeros_like(v) for k, v in self.p.items() if k != "e"}
        pooled, where = np.full((n, len(WIDTHS) * FILTERS), -1, np.float32), np.zeros((n, len(WIDTHS) * FILTERS), np.int64)
        for text, first, lo, hi, r in self._blocks(feats, counts):
            for t, f, a, b in zip(text.tolist(), first.tolist(), lo.tolist(), hi.tolist(), strict=True):
                at = r[a:b].argmax(0)
                top = np.take_along_axis(r[a:b], at[None], 0)[0]
                where[t] = np.where(top > pooled[t], at + f, where[t])
                pooled[t] = np.maximum(top, pooled[t])
        err = (1 / (1 + np.exp(-np.clip(pooled @ self.p["v"] + self.p["c"], -30, 30))) - y) / n
        g["v"], g["c"] = pooled.T @ err, err.sum(keepdims=True)
        back = err[:, None] * self.p["v"][None, :] * (pooled > 0)
        words, dx = [], []
        begin = (np.cumsum(counts) - counts)[:, None]
        k = 0
        for i, width in enumerate(WIDTHS):
            d, w = back[:, i * FILTERS : (i + 1) * FILTERS], where[:, i * FILTERS : (i + 1) * FILTERS]
            g["b"][i] = d.sum(0)
            for j in range(width):
                there = w + j < counts[:, None]
                word = np.where(there, begin + w + j, -1)
                x = np.zeros((n, FILTERS, DIM), np.float32)
                x[there] = self._vectors(feats[word[there]])
                g["w"][k + j] = np.einsum("nfd,nf->df", x, d)
                words.append(word.ravel())
                dx.append((d[:, :, None] * self.p["w"][k + j].T[None]).reshape(-1, DIM))
            k += width
        word, dx = np.concatenate(words), np.concatenate(dx)
        live = (word >= 0) & (dx != 0).any(1)
        buckets = feats[word[live]]
        g["rows"], inverse = np.unique(buckets, return_inverse=True)
        g["e"] = np.zeros((len(g["rows"]), DIM), np.float32)
        np.add.at(g["e"], inverse.reshape(-1), np.repeat(dx[live], buckets.shape[1], 0))
        return g

    def fit(self, texts: list[np.ndarray], y: np.ndarray, known: np.ndarray, epochs: Iterable[int], of: int, batch: int = 32, rate: float = 0.02, seed: int = 4) -> None:
        """Adam over mini-batches with words left out at random, in the given ones of ``of`` epochs; vectors are updated only where a gradient falls, and of ``known`` buckets."""
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        for epoch in epochs:
            rng = np.random.default_rng([seed, epoch])
            order = rng.permutation(len(texts))
            for lo in range(0, len(order), batch):
                part = order[lo : lo + batch]
                held = [texts[i][rng.random(len(texts[i])) >= WORD_DROPOUT] for i in part]
                g = self.step(np.concatenate(held), np.array([len(x) for x in held]), y[part].astype(np.float32))
                live = known[g["rows"]]
                g["rows"], g["e"] = g["rows"][live], g["e"][live] + DECAY * self.p["e"][g["rows"][live]]
                t += 1
                lr = rate * (1 - 0.8 * epoch / of)
                for k in ("w", "b", "v", "c", "e"):
                    at = g["rows"] if k == "e" else slice(None)
                    m[k][at] = 0.9 * m[k][at] + 0.1 * g[k]
                    s[k][at] = 0.99 * s[k][at] + 0.01 * g[k] ** 2
                    self.p[k][at] -= lr * (m[k][at] / (1 - 0.9**t)) / (np.sqrt(s[k][at] / (1 - 0.99**t)) + 1e-6)


class Constant:
    """The score where one class has no rows to learn from."""

    def __init__(self, share: float) -> None:
        self.logit = -6.0 if share == 0 else 6.0

    def logits(self, feats: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return np.full(len(counts), self.logit)


def best_thresholds(scored: DataFrame) -> tuple[dict[str, float], float]:
    """The middles of the cuts with the highest F1 over all rows of ``scored`` (lang, y, score), by language and of all; of cuts as good the highest.

    Languages with fewer than ``LEAST_POSITIVE`` positive rows have none, and without positive rows that of all is 0.5. Equal scores are counted
    together and those of a narrow bin of the logit summed from the top, so no task has a language.
    """
    key, each = ["whole", "lang"], Window.partitionBy("whole", "lang")
    kinds = F.array(F.struct(F.lit(False).alias("whole"), F.coalesce("lang", F.lit("")).alias("lang")), F.struct(F.lit(True).alias("whole"), F.lit("").alias("lang")))
    cuts = scored.select("y", "score", F.explode(kinds).alias("k")).groupBy("k.whole", "k.lang", "score").agg(F.count("*").alias("n"), F.sum("y").alias("hit"))
    cuts = cuts.withColumn("bin", F.floor(F.log(F.col("score") / (1 - F.col("score"))) * BINS))
    above = each.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)  # some 15,000 bins of a language at most
    bins = cuts.groupBy(*key, "bin").agg(F.sum("n").alias("n"), F.sum("hit").alias("hit"))
    bins = bins.select(*key, "bin", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n_above"), F.coalesce(F.sum("hit").over(above), F.lit(0)).alias("hit_above"), F.sum("hit").over(each).alias("positive"))
    upto = Window.partitionBy(*key, "bin").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    f1 = 2 * (F.col("hit_above") + F.sum("hit").over(upto)) / (F.col("n_above") + F.sum("n").over(upto) + F.col("positive"))
    needed = F.when(F.col("whole"), 1).otherwise(LEAST_POSITIVE)
    best = cuts.join(bins, [*key, "bin"]).where(F.col("positive") >= needed).select(*key, "score", f1.alias("f1")).groupBy(*key).agg(F.max(F.struct("f1", "score"))["score"].alias("top"))
    middle = (F.col("top") + F.coalesce(F.max(F.when(F.col("score") < F.col("top"), F.col("score"))), F.lit(0.0))) / 2
    found = {(r["whole"], r["lang"]): r["t"] for r in cuts.join(best, key).groupBy(*key, "top").agg(middle.alias("t")).collect()}  # a row for each language
    return {lang: t for (whole, lang), t in found.items() if not whole}, found.get((True, ""), 0.5)


def sample(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic", rows: dict[int, int] | None = None, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(doc_id, y, fold, lang, text): some labelled rows to look at, at most ``rows`` of each class and ``most_bytes`` of text in all; ``train`` takes all.

    Ids are taken in the order of a hash; texts of over an eighth of ``most_bytes`` are left out, and of the others those that would go over
    ``most_bytes`` and all behind them. Rows whose
    crc32(id as text) mod 5 is 0 are never taken. Conflicting labels of an id count as the larger, null labels, ids and texts not at all.
    Of rows that share an id one text is taken, that of the least hash. Both bounds are applied before a text leaves its task.
    """
    rows = rows or SAMPLE_ROWS
    ids = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    ids = ids.withColumn("fold", F.crc32(F.col("doc_id").cast("string")) % 5).where("fold <> 0").withColumn("place", F.xxhash64(F.lit(11), "doc_id"))
    picked = None
    for y, n in rows.items():
        part = ids.where(F.col("y") == y).orderBy("place", "doc_id").limit(n)
        picked = part if picked is None else picked.unionByName(part)
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null").withColumn("h", F.xxhash64("text"))
    held = docs.select("doc_id", "h", F.octet_length("text").alias("bytes")).join(F.broadcast(picked), "doc_id")  # at most sum(rows.values()) ids
    one = held.groupBy("doc_id", "y", "fold", "place").agg(F.min(F.struct("h", "bytes")).alias("t")).select("doc_id", "y", "fold", "place", "t.h", "t.bytes")
    order = Window.partitionBy(F.lit(0)).orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # a row for each picked id
    one = one.where(F.col("bytes") * 8 <= most_bytes).withColumn("upto", F.sum("bytes").over(order)).where(F.col("upto") <= most_bytes).select("doc_id", "y", "fold", "h")
    return docs.join(F.broadcast(one), ["doc_id", "h"]).dropDuplicates(["doc_id"]).select("doc_id", "y", "fold", "lang", "text")


def labelled(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic") -> DataFrame:
    """(doc_id, y, fold, lang, text, h, bytes): every row of ``documents`` with a text and a label 0 or 1, but those whose crc32(id as text) mod 5, the fold, is 0.

    Conflicting labels of an id count as the larger; null labels, ids and texts not at all. ``h`` is a hash of the text,
    ``bytes`` its length.
    """
    y, fold = F.col(label_col).cast("int"), F.crc32(F.col("doc_id").cast("string")) % 5
    ids = labels.where(y.isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(y).alias("y")).where(fold != 0)
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null")
    docs = docs.withColumn("fold", fold).where("fold <> 0").withColumn("h", F.xxhash64("text")).withColumn("bytes", F.octet_length("text"))
    return docs.join(maybe_broadcast(ids, ids.count()), "doc_id").select("doc_id", "y", "fold", "lang", "text", "h", "bytes")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, a text, as its words' bucket numbers in 16 bits each, compressed."""
    for batch in batches:
        data, offsets = K.text_buffers(batch.column(batch.num_columns - 1))
        packed = []
        for lo, hi in K.pieces(offsets):
            feats, counts = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            ends = np.cumsum(counts)
            packed += [zlib.compress(feats[e - n : e].astype(np.uint16), 1) for e, n in zip(ends, counts, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(packed, pa.binary())], [*batch.schema.names[:-1], "words"])
    K.release()


def _unpack(words: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(words), np.uint16).reshape(-1, 1 + len(PREFIXES))


def _holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts hold each bucket."""
    n = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for words in batch.column("words"):
            n[np.unique(_unpack(words.as_py()))] += 1
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["row", "n"])


def _trained(weights: np.ndarray, known: np.ndarray, epochs: range, of: int):
    """Weights of a model of each shard, times its rows and ``SCALE``; a task may have several shards, one behind the other."""

    def model(shard: int, texts: list[np.ndarray], y: list[int]) -> pa.RecordBatch:
        cnn = Cnn.of(weights)
        cnn.fit(texts, np.array(y), known, epochs, of, seed=4 + shard)
        sums = np.rint(cnn.rows().astype(np.float64) * (len(y) * SCALE)).astype(np.int64)
        columns = [np.arange(len(sums), dtype=np.int32), np.full(len(sums), len(y)), *sums.T]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["row", "n", *_PLACES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, texts, y = None, [], []
        for batch in batches:
            for shard, label, words in zip(batch.column("shard").to_pylist(), batch.column("y").to_pylist(), batch.column("words"), strict=True):
                if shard != now and texts:
                    yield model(now, texts, y)
                    texts, y = [], []
                now = shard
                texts.append(_unpack(words.as_py()))
                y.append(label)
        if texts:
            yield model(now, texts, y)
        K.release()

    return run


_PLACES = [f"p{i}" for i in range(DIM)]


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic"):
    """(model, thresholds by language, threshold of all), fitted on every row of ``labelled``; rows of an id with equal texts count once.

    Rows of fold 0 are never used; those of fold 1 calibrate the thresholds and are not trained on, or all do where fold 1 has few positive
    rows. Shards of rows are dealt by a hash and trained on side by side, and after each pass over all rows their models are averaged by the
    rows of each; up to ``SHARD_ROWS`` are one shard. Nothing depends on how the table is cut or on the cluster. Without rows of both classes the
    model is a constant, and there are no thresholds by language. The driver holds the weights, whatever the table.
    """
    spark = documents.sparkSession
    small_batches(spark)
    rows = labelled(documents, labels, id_col, text_col, lang_col, label_col)
    fit = F.col("fold") != 1
    sizes = rows.groupBy("doc_id", "h", "y", "bytes", fit.alias("fit")).agg(F.count("*").alias("rows")).groupBy("fit").agg(F.count("*").alias("n"), F.sum("y").alias("hit"), F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    held = {r["fit"]: r for r in sizes.collect()}  # two rows
    n, hit = (held[True]["n"], held[True]["hit"]) if True in held else (0, 0)
    if hit in (0, n):
        return Constant(hit / n if n else 0.0), {}, 0.5
    shards = max(-(-n // SHARD_ROWS), -(-held[True]["bytes"] // SHARD_BYTES))
    packed = rows.where(fit).select("doc_id", "h", "y", "text").mapInArrow(_pack, "doc_id long, h long, y int, words binary")
    if held[True]["rows"] > n:
        packed = packed.dropDuplicates(["doc_id", "h"])
    packed = packed.withColumn("shard", F.pmod(F.xxhash64(F.lit(11), "doc_id", "h"), F.lit(shards)).cast("int")).repartitionById(shards, "shard").sortWithinPartitions("shard", "doc_id", "h").persist(StorageLevel.DISK_ONLY)
    known = np.zeros(BUCKETS, bool)
    known[packed.mapInArrow(_holding, "row int, n long").groupBy("row").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_TEXTS).toArrow()["row"].to_numpy()] = True  # a row for each bucket
    weights = Cnn().rows()
    weights[:BUCKETS][~known] = 0
    passes = min(40, max(LEAST_PASSES, -(-LEAST_ROWS_SEEN // n)))
    for epochs in [range(passes)] if shards == 1 else [range(k, k + 1) for k in range(passes)]:
        shape = ", ".join(["row int, n long", *(f"{p} long" for p in _PLACES)])
        sums = packed.mapInArrow(_trained(weights, known, epochs, passes), shape).groupBy("row").agg(F.sum("n").alias("n"), *[F.sum(p).alias(p) for p in _PLACES]).toArrow().sort_by("row")  # a row for each bucket and a few more
        weights = (np.stack([sums[p].to_numpy() for p in _PLACES], 1) / (sums["n"].to_numpy()[:, None] * SCALE)).astype(np.float32)
    packed.unpersist()
    model = Cnn.of(weights)
    use = rows.where(~fit) if False in held and held[False]["hit"] >= LEAST_POSITIVE else rows
    scored = use.select("doc_id", "h", "lang", "y", "text").mapInArrow(_score(model), "doc_id long, h long, lang string, y int, score double").dropDuplicates(["doc_id", "h", "lang"]).select("lang", "y", "score").persist(StorageLevel.DISK_ONLY)
    by_lang, overall = best_thresholds(scored)
    scored.unpersist()
    return model, {k: min(max(v, 0.05), 0.95) for k, v in by_lang.items()}, min(max(overall, 0.05), 0.95)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x.astype(np.float64), -30, 30)))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_buffers(batch.column(batch.num_columns - 1))
            scores = [_sigmoid(model.logits(*features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))) for lo, hi in K.pieces(offsets)]
            scores = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores)], [*batch.schema.names[:-1], "score"])
        K.release()

    return run


def score_toxicity(docs: DataFrame, fitted, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: (doc_id, lang, score, threshold, toxic); the score sees the whole text and nothing else.

    ``toxic`` is score >= threshold, and the threshold that of the row's language, or of all languages where it has none of its own or is
    null. Null and empty texts are scored as a text without words. An empty table gives an empty result; other columns aren't looked at.
    """
    small_batches(docs.sparkSession)
    model, by_lang, overall = fitted
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(_score(model), "doc_id long, lang string, score double")
    limit = F.lit(float(overall))
    if by_lang:
        limit = F.coalesce(F.create_map(*[F.lit(x) for kv in by_lang.items() for x in kv])[F.coalesce("lang", F.lit(""))], limit)
    return scored.withColumn("threshold", limit).withColumn("toxic", F.col("score") >= F.col("threshold"))


def drop_toxic(docs: DataFrame, fitted, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without rows that ``score_toxicity`` calls toxic, in one pass and with every column as it is.

    Null and empty texts are judged as a text without words; a null language by the threshold of all. An empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    model, by_lang, overall = fitted
    shape = StructType([packed.schema["row"], packed.schema["lang"], StructField("score", DoubleType())])
    scored = packed.mapInArrow(_score(model), shape)
    limit = F.lit(float(overall))
    if by_lang:
        limit = F.coalesce(F.create_map(*[F.lit(x) for kv in by_lang.items() for x in kv])[F.coalesce("lang", F.lit(""))], limit)
    return scored.where(F.col("score") < limit).select(*[F.col("row").getField(c).alias(c) for c in names])
