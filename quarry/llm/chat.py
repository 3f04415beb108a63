"""Chat formatting in budgeted, turn-aligned windows, in DataFrame functions only.

A turn is written ``### role: text</turn>`` and a line feed. In texts ``\\`` is
written ``\\b``, ``#`` is ``\\h`` and ``<`` is ``\\l`` (in roles ``:`` is ``\\c``
too), so no control string can occur inside a text and reading back is exact.

Windows come from prefix sums of turn tokens. With a budget b, a history
allowance h and s tokens of the conversation's system turn, t = (b - h - s) / 2:
a turn of more than t tokens is a window of its own, the others join by
floor(tokens before / t), so a window has 2 t new tokens at most. It opens with
the system turn (if that came earlier) and with the last whole turns of the h
tokens before it; these are repeated and hence masked. Only new assistant turns
are targets, each in exactly one window.

Prefix sums have two levels (runs of ``CHUNK`` turn numbers, then turns), and a
window is the largest group, so a conversation with a third of all rows is
spread like any other. Turns are ordered by turn, role, text. Defined cases:
null texts and roles are empty; a null conversation id is a conversation;
repeated rows are turns; null turn numbers come first; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quarry.llm import jobs

BUDGET, HISTORY, CHUNK = 2048, 256, 1024
LEAST_STEP = 64
# The template's marks.
OPEN, AFTER_ROLE, CLOSE = "### ", ": ", "</turn>\n"


def escape(c: Column, role: bool = False) -> Column:
    for mark, code in (("\\", "\\b"), ("#", "\\h"), ("<", "\\l")) + ((":", "\\c"),) * role:
        c = F.replace(c, F.lit(mark), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for mark, code in (("#", "\\h"), ("<", "\\l"), (":", "\\c"), ("\\", "\\b")):
        c = F.replace(c, F.lit(code), F.lit(mark))
    return c


def turn_tokens(text: Column) -> Column:
    """An estimate that needs no tokenizer: a quarter of the bytes, 1 at least."""
    return F.greatest(F.lit(1), F.ceil(F.octet_length(text) / 4)).cast("long")


def _numbered(conversations: DataFrame) -> DataFrame:
    """Turns with pos (place in the conversation) and before (tokens before)."""
    kept = ("conv_id", "turn", "role", "text")
    t = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("tokens", turn_tokens(F.col("text")))
    t = t.withColumn("chunk", F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(1 << 60))).cast("long"))
    inside = W.partitionBy("conv_id", "chunk").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, -1)
    sums = t.groupBy("conv_id", "chunk").agg(F.count("*").alias("n"), F.sum("tokens").alias("s"))
    ahead = W.partitionBy("conv_id").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col("conv_id").alias("c"), F.col("chunk").alias("k"),
                       F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("n0"), F.coalesce(F.sum("s").over(ahead), F.lit(0)).alias("s0"))
    t = t.withColumn("n1", F.count("*").over(inside)).withColumn("s1", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    return (t.join(sums, t["conv_id"].eqNullSafe(sums["c"]) & (t["chunk"] == sums["k"]))
            .select(*kept, "tokens", "chunk", (F.col("n0") + F.col("n1")).alias("pos"), (F.col("s0") + F.col("s1")).alias("before")))


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window: conv_id, first (place of its first new turn),
    n_repeated (turns before it that are repeated), formatted, loss (ranges of
    formatted, in characters, that are targets)."""
    jobs.prepare(conversations.sparkSession)
    turns = jobs.table(_numbered(conversations), "turns")
    system = (turns.where("role = 'system'").groupBy(F.col("conv_id").alias("c"))
              .agg(F.min(F.struct("pos", "tokens", "role", "text")).alias("sys")))
    t = turns.join(system, turns["conv_id"].eqNullSafe(system["c"]), "left")
    step = F.greatest(F.lit(LEAST_STEP), F.floor((F.lit(budget - history) - F.coalesce("sys.tokens", F.lit(0))) / 2)).cast("long")
    t = t.withColumn("step", step).withColumn("long", (F.col("tokens") > F.col("step")).cast("long"))
    # Turns of more than a step before each turn, in two levels again.
    longs = t.groupBy(F.col("conv_id").alias("c2"), F.col("chunk").alias("k2")).agg(F.sum("long").alias("l"))
    ahead = W.partitionBy("c2").orderBy("k2").rowsBetween(W.unboundedPreceding, -1)
    longs = longs.select("c2", "k2", F.coalesce(F.sum("l").over(ahead), F.lit(0)).alias("l0"))
    inside = W.partitionBy("conv_id", "chunk").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    t = (t.withColumn("l1", F.coalesce(F.sum("long").over(inside), F.lit(0)))
         .join(longs, t["conv_id"].eqNullSafe(longs["c2"]) & (t["chunk"] == longs["k2"])))
    t = (t.withColumn("part", 2 * (F.col("l0") + F.col("l1")) + F.col("long"))
         .withColumn("slot", F.when(F.col("long") == 1, F.lit(0)).otherwise(F.floor(F.col("before") / F.col("step"))).cast("long")))
    t = jobs.table(t.select("conv_id", "pos", "role", "text", "tokens", "before", "part", "slot", "sys"), "slots")
    wins = t.groupBy("conv_id", "part", "slot").agg(F.min("pos").alias("first"), F.min("before").alias("start"), F.first("sys").alias("sys"))
    wins = jobs.table(wins, "wins")

    key = ("conv_id", "part", "slot")
    new = t.select(*key, F.lit(2).alias("section"), "pos", "role", "text")
    lead = wins.where("sys.pos < first").select(*key, F.lit(0).alias("section"), "sys.pos", "sys.role", "sys.text")
    span = F.lit(history)
    look = (wins.where("first > 0").withColumn("h", F.explode(F.array(F.floor(F.col("start") / span), F.floor(F.col("start") / span) - 1)))
            .select(F.col("conv_id").alias("wc"), F.col("part").alias("wp"), F.col("slot").alias("ws"), "start", "h"))
    past = t.select("conv_id", "pos", "role", "text", "tokens", "before", F.floor(F.col("before") / span).alias("h"),
                    F.coalesce(F.col("sys.pos") == F.col("pos"), F.lit(False)).alias("leads"))
    past = (past.join(look, past["conv_id"].eqNullSafe(look["wc"]) & (past["h"] == look["h"]))
            .where((F.col("before") >= F.col("start") - span) & (F.col("before") + F.col("tokens") <= F.col("start")) & ~F.col("leads"))
            .select("conv_id", F.col("wp").alias("part"), F.col("ws").alias("slot"), F.lit(1).alias("section"), "pos", "role", "text"))
    head = F.concat(F.lit(OPEN), escape(F.col("role"), True), F.lit(AFTER_ROLE))
    pieces = (new.unionByName(lead).unionByName(past)
              .withColumn("head", head).withColumn("body", escape(F.col("text")))
              .withColumn("target", (F.col("section") == 2) & (F.col("role") == "assistant")))
    made = pieces.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("section", "pos", "head", "body", "target"))).alias("p"))
    lengths = F.transform("p", lambda x: F.length(x["head"]) + F.length(x["body"]) + len(CLOSE))
    starts = F.aggregate(lengths, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    marks = F.transform(F.filter(F.arrays_zip(F.col("p").alias("p"), F.slice("starts", 1, F.size("p")).alias("at")), lambda z: z["p"]["target"]),
                        lambda z: F.struct((z["at"] + F.length(z["p"]["head"])).alias("start"),
                                           (z["at"] + F.length(z["p"]["head"]) + F.length(z["p"]["body"])).alias("end")))
    return (made.withColumn("starts", starts)
            .select("conv_id", F.element_at(F.filter("p", lambda x: x["section"] == 2), 1)["pos"].alias("first"),
                    F.size(F.filter("p", lambda x: x["section"] < 2)).alias("n_repeated"),
                    F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), "").alias("formatted"),
                    marks.alias("loss")))


def read_back(formatted: DataFrame) -> DataFrame:
    """Per window of the formatted text: conv_id, first, turns (role and text of
    its new turns) and targets (the unescaped text under the mask)."""
    parts = F.split("formatted", CLOSE, -1)
    fresh = F.slice(parts, F.col("n_repeated") + 1, F.greatest(F.size(parts) - 1 - F.col("n_repeated"), F.lit(0)))

    def parse(part: Column) -> Column:
        cut = F.locate(AFTER_ROLE, part) if isinstance(part, str) else F.instr(part, AFTER_ROLE)
        return F.struct(unescape(F.substr(part, F.lit(len(OPEN) + 1), cut - 1 - len(OPEN))).alias("role"),
                        unescape(F.substr(part, cut + len(AFTER_ROLE))).alias("text"))

    return formatted.select("conv_id", "first", F.transform(fresh, parse).alias("turns"),
                            F.transform("loss", lambda m: unescape(F.substr(F.col("formatted"), m["start"] + 1, m["end"] - m["start"]))).alias("targets"),
                            F.length("formatted").cast("long").alias("n_chars"))


def digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from the formatted windows."""
    back = read_back(formatted).select(
        "conv_id", "first", F.size("turns").cast("long").alias("n"), "n_chars",
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
        F.array_join("targets", "").alias("aim"))
    per = back.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("n_chars").alias("formatted_chars"),
                                      F.array_sort(F.collect_list(F.struct("first", "said", "aim"))).alias("w"))
    text = F.array_join(F.transform("w", lambda x: x["aim"]), "")
    return per.select("conv_id", "n_turns", F.sha2(F.array_join(F.transform("w", lambda x: x["said"]), ""), 256).alias("turns_sha256"),
                      F.length(text).cast("long").alias("loss_chars"), F.sha2(text, 256).alias("loss_sha256"), "formatted_chars")
