"""Benchmark decontamination by template windows: typed placeholders, a hash join, and a check that slots are filled consistently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenvec.llm.common import materialize, maybe_broadcast

#: Tokens of a window, and the share of an item's windows that makes a leak.
WINDOW, COVERAGE = 8, 0.5
#: Anchors (a hash and a width each) that may be broadcast to the documents' tokens; they are counted first.
ANCHORS = 1_000_000
#: Non-slot words that an item must have at least for its templates to say anything.
LEAST_WORDS = 2
#: Words after a number that count as units.
UNITS = "kg g mg t lb lbs oz km m cm mm mi ft in mph kmh h hr hrs hour hours min mins minute minutes s sec secs second seconds day days week weeks month months year years l ml cl gal c f k w kw v a hz mb gb tb kb usd eur gbp dollars dollar euros euro cents cent percent degrees degree".split()
_PUNCTUATION = "!\"#$&'()*+-;<=>?@[\\]^_`{|}~«»“”‘’–—…¿¡·•\t\n\r\x0b\x0c"
_NUMERIC_MARKS = ".,:/%€£"
#: Private-use characters that mark numbers, names and units, and that join the parts of one value; a text's own are blanked first.
NUMBER, NAME, UNIT, JOINT = "\ue000", "\ue001", "\ue002", "\ue003"
#: Capitals of the Latin, Greek, Cyrillic, Armenian and Georgian blocks and their extensions, and a final sigma, with what they are folded to.
_FOLDED = {chr(c): chr(c).lower() for a, b in ((0x41, 0x588), (0x10A0, 0x1100), (0x1E00, 0x2000)) for c in range(a, b) if chr(c).isupper() and len(chr(c).lower()) == 1} | {"\u03c2": "\u03c3"}
_CAPITALS, _SMALL = "".join(_FOLDED), "".join(_FOLDED.values())


def _blank(c: Column, chars: str) -> Column:
    return F.translate(c, chars, " " * len(chars))


def _plain(c: Column, chars: str) -> Column:
    """Punctuation as spaces and capitals as small letters, in one pass."""
    return F.translate(c, chars + _CAPITALS, " " * len(chars) + _SMALL)


def _unmarked(text: Column) -> Column:
    c = F.coalesce(text.cast("string"), F.lit(""))
    own = NUMBER + NAME + UNIT + JOINT
    return F.when(c.rlike(f"[{own}]"), _blank(c, own)).otherwise(c)


def readings(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with a row for each reading of a text: ``template``, ``t`` (tokens) and ``shown`` (the same with slots as placeholders).

    The literal reading has the lower-case words (``_FOLDED``); punctuation parts words. The template reading has a mark before slots:
    ``NUMBER``, ``UNIT`` (behind a number) and ``NAME``; there is none if a text has no slot. A capitalised word is a name wherever it
    stands, behind a quote, a bracket, a line break or at the start of a sentence too; document and item are read alike. Names one behind
    the other are one slot, and so are numbers. Null has no tokens. Each step is a column of its own, so that it is computed once.
    """
    words = lambda c: F.array_remove(F.split(c, " "), "")
    df = df.withColumn("__u", _unmarked(F.col(text_col)))
    joined = F.regexp_replace("__u", r"\s{1,3}(?=\p{Lu})(?<=(?<![\p{L}\p{N}])\p{Lu}\p{L}{0,30}\s{1,3})", JOINT)
    df = df.withColumn("__c", F.regexp_replace(joined, rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}{JOINT}])", NAME))
    digits = F.regexp_replace("__c", r"([$€£])(?=\d)", " ")
    digits = F.regexp_replace(digits, r"(?<!\d)[.,:/]|[.,:/](?!\d)", " ")
    digits = F.regexp_replace(digits, r"(?<=\d) {1,3}(?=\d)", JOINT)
    digits = F.regexp_replace(digits, rf"\d+(?:[.,:/{JOINT}]\d+)*", f" {NUMBER}$0 ")
    digits = F.regexp_replace(digits, rf"(?i)({NUMBER}[\d.,:/{JOINT}]+) +{NAME}?(%|(?:{'|'.join(UNITS)})(?!\p{{L}}))", f"$1 {UNIT}$2")
    df = df.withColumn("__d", F.when(F.col("__c").rlike(r"\d"), _plain(digits, _PUNCTUATION)).otherwise(_plain(F.col("__c"), _PUNCTUATION + _NUMERIC_MARKS)))
    df = df.withColumn("__l", words(_plain(F.col("__u"), _PUNCTUATION + _NUMERIC_MARKS))).withColumn("__t", words(F.col("__d"))).withColumn("__s", words(F.regexp_replace("__d", f"([{NUMBER}{NAME}{UNIT}])[^ ]+", "$1")))
    kind = lambda template, t, shown: F.struct(F.lit(template).alias("template"), F.col(t).alias("t"), F.col(shown).alias("shown"))
    kinds = F.when(F.col("__d").rlike(f"[{NUMBER}{NAME}{UNIT}]"), F.array(kind(False, "__l", "__l"), kind(True, "__t", "__s"))).otherwise(F.array(kind(False, "__l", "__l")))
    return df.withColumn("__r", F.explode(kinds)).select(*[c for c in df.columns if not c.startswith("__") and c != text_col], "__r.*")


_SLOT = f"substring(x, 1, 1) in ('{NUMBER}', '{NAME}', '{UNIT}')"


def _shown(tokens: str) -> str:
    """SQL for tokens with slots as placeholders."""
    return f"transform({tokens}, x -> if({_SLOT}, substring(x, 1, 1), x))"


#: SQL for the place in a window ``w``, its last token excepted, of its longest word; a slot only where there is no word.
_ANCHOR = f"array_max(transform(slice(w, 1, greatest(1, size(w) - 1)), (x, i) -> named_struct('word', not {_SLOT}, 'n', length(x), 'x', x, 'i', i))).i"


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, template, width, length, windows, ipos, anchor, k, islots, iat): the windows of each item's two readings.

    An item shorter than ``window`` tokens is one window of its own width; an item without tokens has none. Template windows without a
    word are left out, and so are the templates of items with fewer than ``LEAST_WORDS`` different words, which would fit too much: these
    are found by their literal windows. The key ``k`` hashes the tokens with slots as placeholders; ``islots`` has the values of the slots
    and ``iat`` their places in the item.
    """
    items = readings(benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")), "text").withColumnRenamed("t", "tokens").drop("shown").where("size(tokens) > 0").distinct()
    items = items.where(f"not template or size(array_distinct(filter(tokens, x -> not {_SLOT}))) >= {LEAST_WORDS}")
    items = items.withColumn("width", F.least(F.size("tokens"), F.lit(window))).withColumn("length", F.size("tokens"))
    items = items.withColumn("ws", F.expr(f"filter(transform(sequence(1, length - width + 1), i -> named_struct('ipos', i - 1, 'w', slice(tokens, i, width))), y -> exists(y.w, x -> not {_SLOT}))"))
    items = items.select("item_id", "template", "width", "length", F.size("ws").alias("windows"), F.explode("ws").alias("y")).select("*", "y.*")
    items = items.withColumn("shown", F.expr(_shown("w"))).withColumn("at", F.expr(_ANCHOR))
    anchor = F.expr("xxhash64(get(shown, at), coalesce(get(shown, at + 1), ''), template)")
    places = F.expr(f"filter(transform(w, (x, i) -> if({_SLOT}, ipos + i, null)), i -> i is not null)")
    return items.select("item_id", "template", "width", "length", "windows", "ipos", anchor.alias("anchor"), F.xxhash64("shown").alias("k"), F.expr(f"filter(w, x -> {_SLOT})").alias("islots"), places.alias("iat"))


#: SQL for the one-to-one part of a candidate's ``slots``, one struct (iat, islots, slots) per place: the pairs of values that stand at
#: most of the places of the item's value and at most of the places of the document's.
_MAPPING = """case when size(pairs) = size(array_distinct(pairs.islots)) and size(pairs) = size(array_distinct(pairs.slots)) then pairs
    else filter(pairs, p -> 2 * size(filter(slots, q -> q.islots = p.islots and q.slots = p.slots)) > greatest(size(filter(slots, q -> q.islots = p.islots)), size(filter(slots, q -> q.slots = p.slots)))) end"""

BODY, ITEM = ["b1", "b2"], ["i1", "i2"]


def _bodies(text: Column, names: list[str] = BODY) -> list[Column]:
    """A text's 128-bit key."""
    return [F.xxhash64(text).alias(names[0]), F.xxhash64(F.lit(17), text).alias(names[1])]


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, matched, windows, coverage, n_slots, reparameterised): the documents that hold a benchmark item.

    A leak has at least ``coverage`` of the windows of one of the item's readings: the literal one, case-folded, or that with typed
    placeholders. A template window whose slots hold the item's own values counts as it is. Over all windows of a candidate, a stretch of
    the document whose windows lie about as in the item (their shift changes by no more than half of the item from one to the next), the
    values in the item's slots and those in the document's must map one to one; where they don't, a pair of values stands if it fills most
    of the places of both, and the other windows with values of no such pair don't count. ``reparameterised`` says that some value
    differs, so that the text is the item with other numbers, names or units.

    All is native SQL. Each benchmark window has an anchor, its longest word and the token behind; documents' token pairs are joined with
    the anchors, and only windows around those that meet one are hashed and joined with the benchmark's. Up to ``ANCHORS`` anchors are
    broadcast, so that documents don't move; beyond that narrow rows of pairs are shuffled and the tokens are fetched afterwards. A window
    goes to the benchmark's as its hash and its own tokens, without the text it is from. Null and empty texts and items match nothing; a
    text is judged once, however many rows or items have it; rows that share an id are judged each on its own, and the best match is returned. Null ids stay null. Empty tables give an empty result; other columns are not looked at.
    """
    leaks = judge_texts(docs, benchmark, window, coverage, text_col)
    items = benchmark.select("item_id", *_bodies(F.col("text"), ITEM)).distinct().join(leaks.select(*ITEM).distinct(), ITEM)
    found = docs.select(F.col(id_col).alias("doc_id"), *_bodies(F.col(text_col))).join(maybe_broadcast(leaks, leaks.count()), BODY).join(items, ITEM)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("coverage", (~F.col("reparameterised")).alias("plain"), "matched", "windows", "n_slots", "reparameterised")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.matched").cast("long").alias("matched"), "b.windows", "b.coverage", "b.n_slots", "b.reparameterised")


def _met_windows(docs: DataFrame, starts: DataFrame, known: int, single: bool, text_col: str) -> DataFrame:
    """(b1, b2, template, width, s, k, w): the windows around an anchor of documents: where they begin, their key and their tokens."""
    base = docs.select(F.col(text_col).alias("text"), *_bodies(F.col(text_col)))
    rows = readings(base, "text")
    pairs = rows.select("*", F.posexplode("shown").alias("p", "token")).withColumn("h", F.expr("xxhash64(token, coalesce(get(shown, p + 1), ''), template)"))
    if single:  # items of one token stand without the next
        pairs = pairs.withColumn("h", F.explode(F.array_distinct(F.array("h", F.expr("xxhash64(token, '', template)")))))
    if known <= ANCHORS:
        found = pairs.join(F.broadcast(starts), "h")
    else:
        spots = materialize(pairs.select(*BODY, "template", "p", "h").join(starts, "h").select(*BODY, "template", "p", "width").distinct(), "spots")
        gathered = spots.groupBy(*BODY, "template").agg(F.collect_list(F.struct("p", "width")).alias("at"))
        found = rows.join(gathered, [*BODY, "template"]).select(*BODY, "template", "t", "shown", F.explode("at").alias("at")).select("*", "at.*")
    around = F.expr("sequence(greatest(0, p - width + 1), least(p, size(t) - width))")
    windows = found.where("size(t) >= width").select(*BODY, "template", "t", "shown", "width", F.explode(around).alias("s"))
    return windows.select(*BODY, "template", "width", "s", F.expr("xxhash64(slice(shown, s + 1, width))").alias("k"), F.expr("slice(t, s + 1, width)").alias("w"))


def judge_texts(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, text_col: str = "text") -> DataFrame:
    """The leaks of each text, as a written table: its key (b1, b2), that of the item's text (i1, i2) and the columns of ``find_leaks`` but the ids."""
    texts = benchmark.select(F.struct(*_bodies(F.col("text"), ITEM)).alias("item_id"), "text").distinct()
    bench = materialize(benchmark_windows(texts, window).select("item_id.*", "*").drop("item_id"), "windows")
    starts = materialize(bench.select(F.col("anchor").alias("h"), "width").distinct(), "anchors")
    single = not bench.where("width = 1").isEmpty()
    met = _met_windows(docs, starts, starts.count(), single, text_col)
    out = met.join(maybe_broadcast(bench.drop("anchor"), bench.count()), ["template", "k", "width"])
    group = [*BODY, *ITEM, "template", "windows"]
    hits = out.select(*group, "length", "ipos", (F.col("s") - F.col("ipos")).alias("shift"), "iat", "islots", F.expr(f"filter(w, x -> {_SLOT})").alias("slots"))
    hits = hits.select(*group, "length", "ipos", "shift", F.arrays_zip("iat", "islots", "slots").alias("slots")).distinct()
    along = Window.partitionBy(*group).orderBy("shift")
    hits = hits.withColumn("new", (2 * (F.col("shift") - F.lag("shift").over(along)) > F.col("length")).cast("int")).withColumn("candidate", F.coalesce(F.sum("new").over(along), F.lit(0)))
    lined = hits.groupBy(*group, "candidate").agg(F.collect_set(F.struct("ipos", "slots")).alias("met"))
    lined = lined.withColumn("slots", F.expr("array_distinct(flatten(met.slots))")).withColumn("pairs", F.expr("array_distinct(transform(slots, p -> struct(p.islots, p.slots)))"))
    lined = lined.withColumn("mapping", F.expr(_MAPPING))
    lined = lined.withColumn("met", F.expr("filter(met, m -> forall(m.slots, p -> p.islots = p.slots) or forall(m.slots, p -> array_contains(mapping, struct(p.islots, p.slots))))")).where("size(met) > 0")
    lined = lined.select(*group, F.col("met.ipos").alias("ipos"), F.expr("array_distinct(transform(flatten(met.slots), p -> struct(p.islots, p.slots)))").alias("pairs"))
    judged = lined.groupBy(*group).agg(F.size(F.array_distinct(F.flatten(F.collect_list("ipos")))).alias("matched"), F.max(F.size("pairs")).alias("n_slots"), F.max(F.exists("pairs", lambda p: p["islots"] != p["slots"])).alias("reparameterised"))
    return materialize(judged.withColumn("coverage", F.col("matched") / F.col("windows")).where(F.col("coverage") >= coverage), "leaks")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **more) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item, every column as it is. The text alone decides, whatever the id.

    Rows with null and empty texts stay. An empty table on either side takes nothing away.
    """
    gone = materialize(judge_texts(docs, benchmark, text_col=text_col, **more).select(*[F.col(b).alias(f"__{b}") for b in BODY]).distinct(), "gone")
    b1, b2 = _bodies(docs[text_col])
    return docs.join(maybe_broadcast(gone, gone.count()), (b1 == gone["__b1"]) & (b2 == gone["__b2"]), "left_anti")
