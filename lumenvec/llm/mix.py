"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenvec.llm.common import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (3, 1, 2)
#: Words of a block, for all sources alike. Documents of up to so many words are never parted by a block's border.
BLOCK_WORDS = 2048
#: Places of the permutation before and behind a quota's end whose blocks are counted, so that the last one can be cut to the target.
NEAR = 16
SHARDS = 8
#: Hash ranges in which a source's documents are summed before they are put in order.
RANGES = 1024
#: Multipliers of the seeded permutations: primes over 2**30, so one of them is coprime to any number of blocks below 2**60.
PRIMES = (1073741827, 1073741831, 1073741833)


def source_targets(sizes: DataFrame, share: float = 1.5, weights: tuple[int, ...] = WEIGHTS, cap: float = 2.0) -> DataFrame:
    """(source, source_size) to the same with (weight, target): ``share`` of all words by weight, water-filled under cap * source_size.

    One row per source goes through a single task. A source is capped iff its cap per weight is at most the level at which the others
    stand, so one pass in the order of cap per weight finds the level.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    n = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (n + 1).cast("int")))
    ranked = ranked.withColumn("cap", cap * F.col("source_size"))
    rise = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy(F.lit(0))
    before = rise.rowsBetween(Window.unboundedPreceding, -1)
    level = (share * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rise.rowsBetween(0, Window.unboundedFollowing))
    ranked = ranked.withColumn("level", level)
    held = F.when(F.col("cap") / F.col("weight") > F.col("level"), F.col("level"))
    ranked = ranked.withColumn("level", F.max(held).over(whole))
    return ranked.select("source", "source_size", "weight", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def apportion(targets: DataFrame, houses: list[int]) -> DataFrame:
    """``targets`` with ``upto``: Sainte-Lague seats of each source by its target, in each of the ``houses`` of so many seats.

    With n sources and q a source's exact share of the seats, the divisor that fits lies so near the mean one that its quota is within
    q * n / (2 * seats) + 1.5 of q. What lies below is given outright; the rest, about two quotients for each source, go one by one to
    the highest, target / (2 * held + 1). Ties go to the source that is first by code point.
    """
    whole = Window.partitionBy("house")
    base = targets.select("source", "target", F.posexplode(F.array(*[F.lit(n).cast("long") for n in houses])).alias("house", "seats"))
    share = F.when(F.sum("target").over(whole) > 0, F.col("seats") * F.col("target") / F.sum("target").over(whole)).otherwise(F.lit(0.0))
    base = base.withColumn("share", share).withColumn("off", F.col("share") * F.count("*").over(whole) / (2 * F.greatest("seats", F.lit(1))) + 1.5)
    base = base.withColumn("sure", F.greatest(F.lit(0.0), F.floor(F.col("share") - F.col("off"))).cast("long")).withColumn("most", F.ceil(F.col("share") + F.col("off")).cast("long"))
    base = base.withColumn("open", F.col("seats") - F.sum("sure").over(whole))
    asks = base.select("house", "source", "sure", "open", "target", F.explode(F.sequence("sure", "most")).alias("held"))
    asks = asks.withColumn("quotient", F.col("target") / (2 * F.col("held") + 1))
    order = Window.partitionBy("house").orderBy(F.desc("quotient"), F.col("source").asc_nulls_last(), "held")
    won = asks.withColumn("won", ((F.row_number().over(order) <= F.col("open")) & (F.col("target") > 0)).cast("long"))
    quotas = won.groupBy("house", "source").agg((F.first("sure") + F.sum("won")).alias("quota"))
    upto = quotas.groupBy(F.col("source").alias("__source")).agg(F.transform(F.sort_array(F.collect_list(F.struct("house", "quota"))), lambda x: x["quota"]).alias("upto"))
    return targets.join(upto, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")


def shard_quotas(targets: DataFrame, seats: int, shards: int = SHARDS) -> DataFrame:
    """``targets`` with ``upto``: for each shard, the seats that the source has in it and those before.

    The house grows shard by shard, and no source loses a seat when it grows, so differences are the shards' quotas, and the last are the
    apportionment of all seats.
    """
    return apportion(targets, [seats * k // shards for k in range(1, shards + 1)])


#: SQL for the place of block ``b`` in one pass of the seeded permutation.
_PLACE = "pmod(step * {b} + start, blocks)"
#: SQL for a document's pieces (block, place, first word, words): a document that fits a block lies whole in that of its middle word, a
#: longer one is parted at the borders.
_PIECES = f"""transform(case when size = 0 then array() when size <= block_words then array(named_struct('b', (first_word + size div 2) div block_words, 'at', first_word, 'w', size))
    else transform(sequence(first_word div block_words, (first_word + size - 1) div block_words), b -> named_struct('b', b, 'at', greatest(first_word, b * block_words),
        'w', least(first_word + size, (b + 1) * block_words) - greatest(first_word, b * block_words))) end, x -> named_struct('place', {_PLACE.format(b='x.b')}, 'at', x.at, 'w', x.w))"""
#: SQL for the ends of the shards' quotas: words of whole passes, what remains, and the places around it whose blocks are counted.
_CUTS = f"""transform(transform(transform(upto, (q, k) -> if(k = size(upto) - 1, words, least(q * block_words, words))),
    n -> named_struct('pass', if(source_size = 0, 0L, n div source_size), 'rest', if(source_size = 0, 0L, n % source_size))),
    c -> named_struct('pass', c.pass, 'rest', c.rest, 'edge', greatest(0L, c.rest div block_words - {NEAR}L),
        'reach', if(c.rest = 0, 0L, least({2 * NEAR}L, blocks - greatest(0L, c.rest div block_words - {NEAR}L)))))"""
#: SQL for the words of piece ``x`` in pass ``p`` before each of the ends ``cuts``: all or none far from it, what is left of its words near it.
_BEFORE = """transform(cuts, (c, k) -> case when p < c.pass then x.w when p > c.pass or x.place >= c.edge + c.reach then 0L when x.place < c.edge then x.w
    else greatest(0L, least(x.w, c.rest - near[k][cast(x.place - c.edge as int)].before - (x.at - near[k][cast(x.place - c.edge as int)].at))) end)"""
#: SQL for the runs of words that each shard takes of a document, pass by pass.
_TAKES = f"""flatten(transform(sequence(0L, passes), p -> flatten(transform(pieces, x -> flatten(transform(array({_BEFORE}), f ->
    filter(transform(f, (to, k) -> named_struct('pass', p, 'shard', k, 'at', x.at + if(k = 0, 0L, f[k - 1]), 'w', to - if(k = 0, 0L, f[k - 1]))), y -> y.w > 0)))))))"""


def _placed(rows: DataFrame, spots: DataFrame) -> DataFrame:
    """``rows`` with ``first_word``, the number of words of the source before them in the seeded order, and the columns of ``spots``."""
    inside = Window.partitionBy("source", "range").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("in_range", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    met = summed.join(spots, F.col("source").eqNullSafe(F.col("__s")) & (F.col("range") == F.col("__r")))
    return met.withColumn("first_word", F.col("offset") + F.col("in_range")).withColumn("pieces", F.expr(_PIECES))


def _near(placed: DataFrame) -> DataFrame:
    """(source, near): for the blocks around each end of ``cuts``, the words before them in their pass, and the number of their first word."""
    pieces = placed.select("source", F.explode("pieces").alias("x"), "cuts").select("source", "x", F.posexplode("cuts").alias("cut", "c")).where("x.place < c.edge + c.reach")
    sums = pieces.groupBy("source", "cut", F.greatest(F.lit(-1).cast("long"), F.col("x.place") - F.col("c.edge")).alias("k")).agg(F.sum("x.w").alias("w"), F.min("x.at").alias("at"), F.first("c.reach").alias("reach"))
    held = sums.groupBy("source", "cut").agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct("w", "at")))).alias("m"), F.first("reach").alias("reach"))  # NEAR * 2 + 1 rows
    before = "aggregate(sequence(-1L, k - 1), 0L, (s, i) -> s + coalesce(m[i].w, 0L))"
    near = held.select("source", "cut", F.expr(f"transform(sequence(0L, reach - 1), k -> named_struct('before', {before}, 'at', coalesce(m[k].at, 0L)))").alias("near"))
    return near.groupBy(F.col("source").alias("__n")).agg(F.map_from_entries(F.collect_list(F.struct("cut", "near"))).alias("near"))


def mix_sources(docs: DataFrame, seed: int = 17, block_words: int = BLOCK_WORDS, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: (doc_id, source, size, source_size, target, taken, shard_words, first_word, block_words, upto, blocks, step, start, takes).

    Size counts words (runs of bytes that aren't ASCII white space). A source's documents are put in a seeded order and cut end to end
    into blocks of ``block_words`` words, the same for every source and table. Sainte-Lague quotas of blocks, for each shard, say how many
    blocks each source gives it: ``upto`` counts a source's blocks in the shards up to each, repeats after all its blocks are used. A seeded
    permutation puts the block numbers in order, and shard k takes the places from upto[k - 1] to upto[k] of its passes.

    Borders are rounded to documents: one of up to ``block_words`` words goes whole with the block of its middle word, so blocks differ by
    the documents at their borders. Where a shard's quota ends, its words are counted and one document is cut, so that the shard has the
    words of its quota, and the last shard what the source's target then leaves. If blocks before an end differ from equal ones by over
    ``NEAR`` blocks in all, the end is off by the rest, which is below one in a thousand words where a source has blocks enough for that. ``takes`` lists runs of words (pass, shard, first word, words), ``shard_words`` sums them by shard,
    and ``taken`` all of them.

    The order needs no global sort: sums over 1024 hash ranges of each source give every range its offset. Targets and quotas are tables
    with a row per source. Null ids and texts are fine: a null text has size 0 and is never taken; a null source is a source, last in
    order. Equal rows are interchangeable. A source whose quota is no block still gets what its target says, up to one block. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *[F.col(c).alias(f"__keep_{c}") for c in keep])
    base = base.withColumn("place", F.xxhash64(F.lit(seed), F.col("doc_id")))
    base = base.withColumn("range", F.pmod(F.shiftrightunsigned("place", 54), F.lit(RANGES)).cast("int"))
    narrow = materialize(base.select("doc_id", "source", "size", "place", "range"), "sizes")
    ranges = materialize(narrow.groupBy("source", "range").agg(F.sum("size").alias("words")), "ranges")
    targets = materialize(source_targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size"))), "targets")
    total = targets.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]
    plan = shard_quotas(targets, round(total / block_words), shards).withColumn("block_words", F.lit(block_words).cast("long"))
    plan = plan.withColumn("blocks", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("source_size") / F.col("block_words"))))
    plan = plan.withColumn("upto", F.transform("upto", lambda q: F.least(q, 2 * F.col("blocks"))))
    # the words to take: the target, but within a block of what the quota is worth
    last = F.element_at("upto", -1)
    words = F.greatest((last - 1) * block_words, F.least((last + 1) * block_words, F.round("target").cast("long")))
    plan = plan.withColumn("words", F.least(2 * F.col("source_size"), words))
    plan = plan.withColumn("passes", F.expr("case when source_size = 0 then 0L else words div source_size end"))
    plan = plan.withColumn("cuts", F.expr(_CUTS))
    step = F.coalesce(*[F.when(F.col("blocks") % p != 0, F.pmod(F.lit(p), F.col("blocks"))) for p in PRIMES])
    plan = materialize(plan.select("source", "source_size", "target", "block_words", "blocks", "upto", "passes", "cuts", step.alias("step"), F.pmod(F.xxhash64(F.lit(seed), F.lit("start"), "source"), F.col("blocks")).alias("start")), "plan")
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.withColumn("offset", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words")
    spots = offsets.withColumnRenamed("source", "__s").join(plan.withColumnRenamed("source", "__p"), F.col("__s").eqNullSafe(F.col("__p"))).drop("__p").withColumnRenamed("range", "__r")
    near = materialize(_near(_placed(narrow, spots)), "near")
    spots = spots.join(near, F.col("__s").eqNullSafe(F.col("__n")), "left").drop("__n")
    placed = _placed(base if keep else narrow, spots).withColumn("takes", F.expr(_TAKES))
    sums = F.expr(f"transform(sequence(0, {shards - 1}), k -> aggregate(filter(takes, y -> y.shard = k), 0L, (s, y) -> s + y.w))")
    taken = F.expr("aggregate(takes, 0L, (s, y) -> s + y.w)")
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), sums.alias("shard_words"), "first_word", "block_words", "upto", "blocks", "step", "start", "takes", *[F.col(f"__keep_{c}").alias(c) for c in keep])


def mixed_documents(docs: DataFrame, seed: int = 17, block_words: int = BLOCK_WORDS, shards: int = SHARDS, by_shard: bool = False, **cols) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each pass over a source gives a document's words of that pass as one row.

    The text is as it stands where the whole of it is taken; words that aren't are left out, each with the white space behind it.
    ``n_chars``, if there is one, is counted anew. ``by_shard`` parts the rows by shard too and adds columns ``pass`` and ``shard``.
    Documents without words (null, empty and blank texts) aren't in the mix. An empty table gives an empty one.
    """
    names = docs.columns
    text_col = cols.get("text_col", "text")
    held = mix_sources(docs.withColumn("__all", F.struct(*[F.col(f"`{c}`") for c in names])), seed, block_words, shards, keep=("__all",), **cols).where("taken > 0")
    group = "named_struct('pass', y.pass, 'shard', y.shard)" if by_shard else "named_struct('pass', y.pass, 'shard', -1)"
    rows = held.withColumn("part", F.explode(F.expr(f"array_distinct(transform(takes, y -> {group}))")))
    rows = rows.withColumn("used", F.expr(f"filter(takes, y -> {group} = part)"))
    every = F.expr("aggregate(used, 0L, (s, y) -> s + y.w) = size")
    rows = rows.withColumn("__text", F.col(f"__all.`{text_col}`"))
    words = F.regexp_extract_all("__text", F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    inside = lambda i: F.exists("used", lambda y: (F.col("first_word") + i >= y["at"]) & (F.col("first_word") + i < y["at"] + y["w"]))
    cut = F.array_join(F.filter(words, lambda w, i: inside(i)), "")
    rows = rows.withColumn("__new", F.when(every, F.col("__text")).otherwise(cut))
    out = [F.col("__new").alias(c) if c == text_col else F.length("__new").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"__all.`{c}`").alias(c) for c in names]
    return rows.select(*out, *([F.col("part.pass").alias("pass"), F.col("part.shard").alias("shard")] if by_shard else []))
