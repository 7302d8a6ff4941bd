"""Chat formatting: one rendering of a dialogue per participant.

In the rendering of speaker S, the turns of S are the assistant's and are trained on; the turns of
all others are named users' and masked; system turns stay system turns and are masked. The result
has one row per speaker and turn with the rendered segment and its place in the dialogue, so
that the segments in order are the dialogue and no task holds a whole conversation.

Places are running sums. They are taken inside blocks of turns, with offsets from the block totals;
the sum for one speaker's rendering is the sum with everybody as user plus the difference for the
speaker's own turns, so lengths are summed once per turn and not once per rendering.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Marks of the rendered dialogue.
OPEN, NAME, CLOSE, END = "<|", " name=", "|>\n", "<|end|>\n"
BLOCK_TURNS = 512


def _running(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over earlier rows of the same keys, in turn order."""
    blocks = rows.groupBy(*keys, "__block").agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__block").alias("__kb"),
                           F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__off"))
    inside = (Window.partitionBy(*keys, "__block").orderBy("turn", "role", "text")
              .rowsBetween(Window.unboundedPreceding, -1))
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)] + [F.col("__block") == F.col("__kb")]
    rows = rows.withColumn("__in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return (rows.join(blocks, condition).withColumn(out, F.col("__off") + F.col("__in"))
            .drop("__off", "__in", "__kb", *[f"__k{i}" for i in range(len(keys))]))


def rotate_perspectives(turns: DataFrame) -> DataFrame:
    """conv_id, speaker, turn, role, name, segment, start, mask_start, mask_end, trained.

    ``turns`` has conv_id, turn, role, text; other columns are ignored. ``role`` is the participant;
    'system' takes no part. ``start`` is where the segment begins in the rendered dialogue (code
    points); mask_start to mask_end is the text with its end mark, the part a loss would see, and
    ``trained`` says whether it does. Null text is empty, null role is a participant 'unknown', null
    turns come first, null conv_ids are one conversation. A row that repeats all four values
    is one turn; different texts under the same turn number follow each other in role and text order.
    Conversations with system turns only have no rendering.
    """
    rows = (turns.select("conv_id", F.coalesce("turn", F.lit(-1)).cast("bigint").alias("turn"),
                         F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
            .distinct().withColumn("__block", F.floor(F.col("turn") / BLOCK_TURNS)))
    marks = len(OPEN) + len(CLOSE) + len(END)
    body = F.char_length("text") + marks
    is_system = F.col("role") == "system"
    rows = (rows.withColumn("__user", F.when(is_system, body + len("system"))
                            .otherwise(body + len("user") + len(NAME) + F.char_length("role")).cast("bigint"))
            .withColumn("__gain", F.when(is_system, 0).otherwise(
                len("assistant") - len("user") - len(NAME) - F.char_length("role")).cast("bigint")))
    rows = _running(rows, ["conv_id"], "__user", "__before")
    speakers = (rows.where(~is_system).groupBy("conv_id", "role").agg(F.count("*").alias("__n"))
                .select(F.col("conv_id").alias("__conv"), F.col("role").alias("speaker")))
    seen = rows.join(speakers, F.col("conv_id").eqNullSafe(F.col("__conv"))).drop("__conv")
    own = F.col("role") == F.col("speaker")
    seen = seen.withColumn("__own", F.when(own, F.col("__gain")).otherwise(F.lit(0)).cast("bigint"))
    seen = _running(seen, ["conv_id", "speaker"], "__own", "__shift")
    head = F.when(own, F.lit(f"{OPEN}assistant{CLOSE}")).when(is_system, F.lit(f"{OPEN}system{CLOSE}")).otherwise(
        F.concat(F.lit(f"{OPEN}user{NAME}"), F.col("role"), F.lit(CLOSE)))
    start = F.col("__before") + F.col("__shift")
    return seen.select(
        "conv_id", "speaker", "turn",
        F.when(own, "assistant").when(is_system, "system").otherwise("user").alias("role"),
        F.when(~own & ~is_system, F.col("role")).alias("name"),
        F.concat(head, "text", F.lit(END)).alias("segment"), start.alias("start"),
        (start + F.char_length(head)).alias("mask_start"),
        (start + F.char_length(head) + F.char_length("text") + len(END)).alias("mask_end"),
        own.alias("trained"))
