"""Threads by parent ids, in a number of joins that grows with the logarithm of the depth.

Every message points to its parent; in a round each pointer is replaced by where it leads, so that it reaches twice as far.
A message is done when its pointer stands at a root.

Cases: a message without a parent is a root of depth 0; so is one whose parent is not there (how = orphan). Messages on a
cycle, or that answer into one, have no root and no depth (how = cycle). Messages without an id are left out. Of repeated ids
the least parent counts. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelab.session import discard, materialise


def threads(messages: DataFrame, thread: str, message: str, parent: str) -> DataFrame:
    """(thread, message, root, depth, how) of each message. Parents are looked for in the message's own thread."""
    rows = messages.where(F.col(message).isNotNull() & F.col(thread).isNotNull()).groupBy(F.col(thread).alias("t"), F.col(message).alias("m")).agg(F.min(parent).alias("p"))
    rows = materialise(rows, "messages")
    there = rows.select("t", F.col("m").alias("p"), F.lit(True).alias("there"))
    linked = rows.join(there, ["t", "p"], "left")
    root = F.col("there").isNull()
    how = F.when(F.col("p").isNull(), "root").when(root, "orphan").otherwise("reply")
    state = materialise(linked.select("t", "m", F.when(root, F.col("m")).otherwise(F.col("p")).alias("up"), F.when(root, 0).otherwise(1).cast("long").alias("depth"), root.alias("done"), how.alias("how")), "pointers")
    count, reach = rows.count(), 1
    discard(rows)
    while True:
        # Beyond as many steps as there are messages only cycles are left.
        if reach > count or state.where("NOT done").isEmpty():
            break
        target = state.select("t", F.col("m").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("done").alias("home"))
        moved = state.where("NOT done").join(target, ["t", "up"]).select("t", "m", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.col("home").alias("done"), "how")
        fresh = materialise(state.where("done").unionByName(moved), "pointers")
        discard(state)
        state, reach = fresh, 2 * reach
    done = F.col("done")
    return state.select(F.col("t").alias(thread), F.col("m").alias(message), F.when(done, F.col("up")).alias("root"), F.when(done, F.col("depth")).alias("depth"), F.when(done, F.col("how")).otherwise("cycle").alias("how"))
