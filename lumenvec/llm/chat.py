"""Chat formatting: multi-party perspective rotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenvec.llm.common import materialize, maybe_broadcast
from lumenvec.llm.turns import in_order, numbered_long

#: Messages of a part of a rendered dialogue at most, so that a very long conversation is many rows.
PART_MESSAGES = 1024
#: Parts of a conversation that meet its participants in one task.
JOIN_PARTS = 64
END = "<|end|>\n"


def shown_name(role: Column) -> Column:
    """A role as a name in a head: characters other than letters, digits, ``_``, ``.`` and ``-`` become ``%`` and their UTF-8 bytes in hex,
    so that different roles have different names."""
    escaped = F.array_join(F.transform(F.split(role, ""), lambda c: F.when(c.rlike(r"^[\p{L}\p{N}_.-]?$"), c).otherwise(F.concat(F.lit("%"), F.hex(F.encode(c, "UTF-8"))))), "")
    return F.when(role.rlike(r"[^\p{L}\p{N}_.-]"), escaped).otherwise(role)


def rotate_perspectives(turns: DataFrame, part_messages: int = PART_MESSAGES, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", system: str = "system") -> DataFrame:
    """(conv_id, perspective, part, first_message, n_turns, n_messages, rendered, mask): every dialogue once for each participant.

    Participants are the roles of a conversation but ``system``. From a participant's perspective its own turns are the assistant's,
    others' are those of users named by their role (``shown_name``), and system turns stay so:
    ``<|assistant|>\\ntext<|end|>\\n``, ``<|user:name|>\\n...``, ``<|system|>\\n...``. ``mask`` lists the character spans [from, to) of the
    part that are trained on: text and end mark of the perspective's own turns, also when the text is empty.

    Messages go by turn number, then role, then text, nulls first; repeated rows are messages of their own. A dialogue of over
    ``part_messages`` messages is in parts of so many neighbouring messages: ``first_message`` is the number of a part's first, from 0,
    ``n_turns`` how many it has, ``n_messages`` how many the dialogue has, and the parts end to end are the whole dialogue. The order is
    made by ranges, and places are counted from the ranges' sizes, so no conversation is one task's; parts of one conversation meet its
    participants in a salted join. Null roles are one participant, whose perspective is null and who is ``<|user|>`` to others. Null texts
    are empty; ``<|`` in a text becomes ``< |``. A conversation of only system turns has no perspective. A null conv_id is one more
    conversation. An empty table gives an empty result; other columns are not looked at.
    """
    text = F.replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit("<|"), F.lit("< |"))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), text.alias("text"))
    rows = materialize(in_order(rows), "turns")
    long, offsets, many = numbered_long(rows, part_messages)
    placed = rows.withColumn("part", F.lit(0).cast("long")).withColumn("n_messages", F.lit(None).cast("long")).withColumn("salts", F.lit(0).cast("long"))
    if many:
        is_long = F.col("conv_id").eqNullSafe(F.col("__conv"))
        offsets = materialize(offsets.join(maybe_broadcast(long, many), F.col("__c").eqNullSafe(F.col("__conv"))).drop("__conv"), "offsets")
        here = F.col("conv_id").eqNullSafe(F.col("__c")) & (F.shiftright("pos", 33) == F.col("__segment"))
        met = rows.join(maybe_broadcast(offsets, offsets.count()), here, "left")
        number = F.coalesce(F.col("__before") + F.col("pos") - F.col("__first"), F.lit(0))
        salts = F.coalesce(F.ceil(F.col("total") / (part_messages * JOIN_PARTS)), F.lit(0))
        placed = met.select(*rows.columns, F.floor(number / part_messages).alias("part"), F.col("total").alias("n_messages"), salts.alias("salts"))
    parts = placed.groupBy("conv_id", "part", "salts", "n_messages").agg(F.sort_array(F.collect_list(F.struct("pos", "role", "text"))).alias("msgs"))
    speaks = lambda role: ~role.eqNullSafe(F.lit(system))
    both = parts.where("salts = 0").withColumn("perspective", F.explode(F.array_distinct(F.filter("msgs.role", speaks)))).drop("salts")
    if many:
        people = rows.where(speaks(F.col("role"))).join(maybe_broadcast(long, many), is_long).select(F.col("conv_id").alias("__conv"), F.col("role").alias("perspective"), F.ceil(F.col("total") / (part_messages * JOIN_PARTS)).alias("salts")).distinct()
        people = people.select("__conv", "perspective", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("__salt"))
        several = parts.where("salts > 0").withColumn("__s", F.pmod(F.xxhash64("part"), F.col("salts")))
        several = several.join(people, is_long & (F.col("__s") == F.col("__salt")))
        both = both.unionByName(several.select(*both.columns))
    own = lambda m: m["role"].eqNullSafe(F.col("perspective"))
    head = lambda m: F.when(own(m), "<|assistant|>\n").when(m["role"] == system, "<|system|>\n").when(m["role"].isNull(), "<|user|>\n").otherwise(F.concat(F.lit("<|user:"), shown_name(m["role"]), F.lit("|>\n")))
    pieces = F.transform("msgs", lambda m: F.struct(head(m).alias("head"), F.concat(m["text"], F.lit(END)).alias("body"), own(m).alias("own")))
    both = both.withColumn("pieces", pieces)
    spans = F.expr("""aggregate(pieces, struct(0 as at, cast(array() as array<struct<from:int,to:int>>) as spans),
        (acc, p) -> struct(acc.at + length(p.head) + length(p.body) as at,
            if(p.own, array_append(acc.spans, struct(acc.at + length(p.head) as from, acc.at + length(p.head) + length(p.body) as to)), acc.spans) as spans), acc -> acc.spans)""")
    return both.select("conv_id", "perspective", "part", (F.col("part") * part_messages).alias("first_message"), F.size("msgs").alias("n_turns"), F.coalesce("n_messages", F.size("msgs").cast("long")).alias("n_messages"), F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "").alias("rendered"), spans.alias("mask"))
