"""Operator 1, chat rendering after collapse of cumulative snapshots (DataFrame operations only).

Logs often hold a conversation once for each time it grew. Rolling hashes over
the turns name every prefix; a conversation whose whole is a proper prefix of a
longer one is dropped by an anti-join on the hash, and of equal ones the
smallest id stays. What is left is rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def render_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Render maximal conversations, a row each.

    Returns (id_col, n_turns, rendered). Turns go by turn number, then role and
    text; turns that repeat all three are one. Null role or text counts as empty;
    rows with a null id or turn number are left out, being of no conversation or
    place. Markers inside a text are escaped with a backslash so that they can't
    forge turns. Only one conversation's turns come together in a row, however
    common a turn is. An empty table gives an empty result; other columns are
    ignored.
    """
    rows = turns.select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.where("conv is not null and turn is not null")
    talks = rows.groupBy("conv").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))
    seed = F.array().cast("array<string>")
    grow = lambda acc, x: F.concat(acc, F.array(F.md5(F.concat(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")), F.md5(x["role"]), F.md5(x["text"])))))
    talks = talks.withColumn("marks", F.aggregate("turns", seed, grow)).withColumn("n", F.size("turns")).withColumn("whole", F.element_at("marks", -1))
    inner = talks.select(F.explode(F.expr("slice(marks, 1, n - 1)")).alias("mark"), "n").select("mark")
    first = talks.groupBy("whole").agg(F.min("conv").alias("conv"))
    kept = first.join(inner.distinct(), first.whole == F.col("mark"), "left_anti").select("conv")
    safe = lambda x: F.replace(F.replace(x, F.lit(OPEN), F.lit("\\" + OPEN)), F.lit(CLOSE), F.lit("\\" + CLOSE))
    line = lambda x: F.concat(F.lit(OPEN), safe(x["role"]), F.lit("\n"), safe(x["text"]), F.lit(CLOSE), F.lit("\n"))
    return talks.join(kept, "conv", "left_semi").select(F.col("conv").alias(id_col), F.col("n").cast("long").alias("n_turns"), F.array_join(F.transform("turns", line), "").alias("rendered"))
