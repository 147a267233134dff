"""Chat formatting: logged snapshots collapsed to whole conversations, then rendered.

Logs often hold a conversation several times, each time a few turns longer. A rolling hash is kept along
the turns of a conversation: the hash of a prefix is that of the prefix before XOR the hash of (place,
role, text) of its last turn, twice 64 bits wide. A conversation whose whole hash is a proper prefix
hash of another one is a snapshot and goes (anti-join); of equal conversations the smallest id stays.
What is left is rendered with one template.

Turns are ordered by ``turn``, then role and text; rows equal in all of these count once. A null turn
comes first, a null role reads ``unknown``, a null text is empty. Rows without a conversation id belong
to none and are left out. Role names are trimmed, in lower case, and known synonyms become one. A marker
of the template inside a text is broken up, so text cannot open or close a turn. Extra columns are not
read. Everything is a DataFrame expression; a conversation is one row only when it is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from logweave.llm.shared import written

SYNONYMS = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "ai": "assistant", "model": "assistant"}
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def turns(log: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The turns of every conversation: ``conv``, ``pos`` from 0, ``role``, ``text``, prefix hash ``p1, p2``, ``last``."""
    name = F.lower(F.trim(F.col(f"`{role}`").cast("string")))
    for old, new in SYNONYMS.items():
        name = F.when(name == old, new).otherwise(name)
    rows = log.where(F.col(f"`{key}`").isNotNull()).select(
        F.col(f"`{key}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.when(name == "", None).otherwise(name), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
    )
    same = Window.partitionBy("conv").orderBy("turn", "role", "text")
    row = F.struct("turn", "role", "text")
    rows = rows.withColumn("copy", F.coalesce(F.lag(row).over(same).eqNullSafe(row), F.lit(False))).where("NOT copy")
    along = same.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("pos", F.row_number().over(same) - 1)
    own = [F.xxhash64(F.lit(seed), "pos", "role", "text") for seed in (1, 2)]
    rows = rows.withColumns({f"h{i}": h for i, h in enumerate(own)})
    return rows.select(
        "conv", "pos", "role", "text", F.bit_xor("h0").over(along).alias("p1"), F.bit_xor("h1").over(along).alias("p2"),
        (F.lead("pos").over(same).isNull()).alias("last"),
    )


def maximal(steps: DataFrame) -> DataFrame:
    """Ids of the conversations that no other one continues, one of equal ones: ``conv``, ``n_equal``."""
    whole = steps.where("last").groupBy("pos", "p1", "p2").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_equal"))
    inner = steps.where("NOT last").select("pos", "p1", "p2").distinct()
    return whole.join(inner, ["pos", "p1", "p2"], "left_anti").select("conv", "n_equal")


def render(steps: DataFrame) -> DataFrame:
    """One row per conversation: ``conv``, ``n_turns``, ``text``, and the ``answers`` to train on as spans of it."""
    content = steps.text
    for marker in (OPEN, CLOSE):
        content = F.replace(content, F.lit(marker), F.lit(marker[:1] + " " + marker[1:]))
    piece = F.concat(F.lit(OPEN), "role", F.lit("\n"), content, F.lit(CLOSE + "\n"))
    made = steps.select("conv", "pos", "role", piece.alias("piece"))
    order = Window.partitionBy("conv").orderBy("pos")
    upto = F.sum(F.length("piece").cast("bigint")).over(order)
    made = made.withColumn("end", upto)
    head = F.length(F.lit(OPEN)) + F.length("role") + 1
    start = F.col("end") - F.length("piece") + head
    span = F.when(F.col("role") == "assistant", F.concat_ws(":", start, F.col("end") - len(CLOSE) - 1))

    def in_order(value: Column) -> Column:
        return F.transform(F.sort_array(F.collect_list(F.struct("pos", value.alias("value")))), lambda x: x["value"])

    rows = made.groupBy("conv").agg(F.count(F.lit(1)).alias("n_turns"), in_order(F.col("piece")).alias("pieces"), in_order(span).alias("spans"))
    return rows.select("conv", "n_turns", F.array_join("pieces", "").alias("text"), F.array_join("spans", ",").alias("answers"))


def format_chats(log: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Maximal conversations, rendered: ``conv_id``, ``n_turns``, ``n_equal``, ``text``, ``answers``."""
    steps = written(turns(log, key, turn, role, text), "chat-turns")
    kept = written(maximal(steps), "chat-kept")
    lines = steps.join(kept.select("conv"), "conv", "left_semi")
    return render(lines).join(kept, "conv").select(F.col("conv").alias(key), "n_turns", "n_equal", "text", "answers")
