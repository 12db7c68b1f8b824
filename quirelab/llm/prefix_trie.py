"""The trie of conversation prefixes, by prefix doubling.

Turns get dense numbers for names. Blocks of 2^k turns at places divisible by 2^k are named from the names of their two
halves, in one join a level; a prefix of d turns is the blocks of d's binary digits, largest first, and gets its name from
the name of all but the last of them and the name of the last. So every round is a grouping and a join by names, rounds grow
with the logarithm of the longest conversation, and levels halve in size. Prefixes of equal depth and name are one node.

Sums over subtrees need no walk: the nodes whose smallest member is c are the deepest part of c's own path, so c carries
their sum, and a node's subtree has the sums that its members carry, less what its own smallest member carries above it.

Cases: turns are ordered by turn (null first), then by their content; equal rows are equal turns. A null role or text is the
empty string. Rows without an id belong to no conversation and are left out. Empty texts are turns. Turns and conversations
of any length are read whole; a conversation of many turns is numbered by ranges of rows, so that no task needs to hold it.
An empty table has no nodes. Columns besides the four named are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelab.llm.sequences import hashed, in_order
from quirelab.session import discard, materialise

#: Conversations that share their beginning with the one whose id is divisible by this.
FAMILY = 20
#: How words are told apart in texts.
WORD = "[^\\x20\\x09-\\x0D]+"


def named(rows: DataFrame, parts: list[str], name: str) -> DataFrame:
    """rows with a dense number from 1, equal for equal parts, in place of the parts; a written table."""
    keys = materialise(rows.select(*parts).distinct(), "keys").withColumns({"_file": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    # Rows of earlier files: a number for each partition of the written table.
    counts = keys.groupBy("_file").agg((F.max("_row") + 1).alias("n"))
    earlier = counts.select("_file", F.coalesce(F.sum("n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"))
    numbers = materialise(keys.join(F.broadcast(earlier), "_file").select(*parts, (F.col("_earlier") + F.col("_row") + 1).alias(name)), "names")
    out = materialise(rows.join(numbers, parts).select(*(c for c in rows.columns if c not in parts), name), "named")
    discard(numbers)
    return out


def rebuilt(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(turns, lengths): conv, place (from 0), digest and words of each turn, and conv, turns of each conversation.

    A conversation begins with the first h turns of its family's first one, h = crc32(id) % 4, and goes on with its own
    after its first h.
    """
    text = lambda c: F.coalesce(conversations[c], F.lit(""))
    role = text(role_col)
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text(text_col)).cast("binary"), 256))
    turns = conversations.select(conversations[conv_col].cast("long").alias("conv"), conversations[turn_col].alias("turn"), digest.alias("digest"), F.regexp_count(text(text_col), F.lit(WORD)).cast("long").alias("words")).where("conv IS NOT NULL")
    own = in_order(turns, "conv", [F.col("turn").asc_nulls_first(), F.col("digest")], F.lit(1).cast("long"), "place").drop("turn")
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(4))
    convs = own.groupBy("conv").agg(F.count(F.lit(1)).alias("own")).withColumns({"family": F.col("conv") - F.col("conv") % FAMILY, "h": h})
    # At most three turns of a conversation can be a beginning.
    first = F.sort_array(F.collect_list(F.struct("place", "digest", "words")))
    beginnings = own.where(f"conv % {FAMILY} = 0 AND place < 3").groupBy(F.col("conv").alias("family")).agg(first.alias("turns"))
    convs = materialise(convs.join(beginnings, "family", "left").withColumn("begin", F.slice(F.coalesce("turns", F.array()), 1, F.col("h").cast("int"))).select("conv", "own", "h", "begin", F.size("begin").cast("long").alias("lent")), "conversations")
    lent = convs.select("conv", F.posexplode("begin").alias("place", "t")).select("conv", F.col("place").cast("long").alias("place"), "t.digest", "t.words")
    rest = own.join(convs.select("conv", "h", "lent"), "conv").where("place >= h").select("conv", (F.col("place") - F.col("h") + F.col("lent")).alias("place"), "digest", "words")
    out = materialise(lent.union(rest), "rebuilt")
    lengths = materialise(convs.select("conv", (F.col("lent") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("turns")), "lengths")
    discard(own)
    discard(convs)
    return out, lengths


def prefix_names(turns: DataFrame, longest: int) -> DataFrame:
    """conv, depth, name: prefixes of equal depth are equal exactly if their names are. turns: conv, place, digest."""
    level = named(turns.select("conv", F.col("place").alias("block"), "digest"), ["digest"], "name")
    levels = [level]
    while longest >> len(levels):
        half = level.groupBy("conv", F.shiftright("block", 1).alias("block")).agg(F.max(F.when(F.col("block") % 2 == 0, F.col("name"))).alias("a"), F.max(F.when(F.col("block") % 2 == 1, F.col("name"))).alias("b"))
        whole = materialise(half.where("b IS NOT NULL"), "halves")
        level = named(whole, ["a", "b"], "name")
        discard(whole)
        levels.append(level)
    # prefixes: conv, m, name of the first m blocks of the level; the top level has one block at most.
    prefixes = levels[-1].select("conv", F.lit(1).cast("long").alias("m"), "name")
    for level in reversed(levels[:-1]):
        odd = level.where("block % 2 = 0").select("conv", F.shiftright("block", 1).alias("m"), F.col("name").alias("b"))
        odd = odd.join(prefixes.withColumnRenamed("name", "a"), ["conv", "m"], "left").select("conv", (2 * F.col("m") + 1).alias("m"), F.coalesce("a", F.lit(0)).alias("a"), "b")
        odd = materialise(odd, "odd")
        last = named(odd, ["a", "b"], "name")
        discard(odd)
        prefixes = prefixes.select("conv", (2 * F.col("m")).alias("m"), "name").union(last)
    out = materialise(prefixes.select("conv", F.col("m").alias("depth"), "name"), "prefixes")
    for level in levels:
        discard(level)
    return out


def trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256."""
    turns, lengths = rebuilt(conversations, conv_col, turn_col, role_col, text_col)
    longest = lengths.agg(F.max("turns")).first()[0] or 0
    names = prefix_names(turns, longest)
    told = names.join(turns.select("conv", (F.col("place") + 1).alias("depth"), "words"), ["conv", "depth"])
    # A row for each conversation and each of its prefixes, the root's empty one, too.
    root = lengths.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("name"), F.lit(0).cast("long").alias("words"))
    members = materialise(root.unionByName(told).join(lengths, "conv").withColumn("ends", F.col("depth") == F.col("turns")).drop("turns"), "members")
    for used in (names, turns):
        discard(used)
    nodes = members.groupBy("depth", "name").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"), F.min("ends").alias("leaf"))
    nodes = nodes.withColumn("saved", F.when(F.col("depth") > 0, (F.col("n_convs") - 1) * F.col("words")).otherwise(0))
    # saved_here: over a node and those below it on its smallest member's path.
    nodes = in_order(nodes, "conv", [F.col("depth").desc()], F.col("saved"), "below").withColumn("saved_here", F.col("below") + F.col("saved")).drop("below", "words", "saved")
    carried = nodes.groupBy("conv").agg(F.max("saved_here").alias("carried"), F.count_if("leaf").alias("leaves"))
    sums = members.select("conv", "depth", "name").join(carried, "conv").groupBy("depth", "name").agg(F.sum("carried").alias("carried"), F.sum("leaves").alias("n_leaves"))
    # What the smallest member carries above the node is not below it.
    own = nodes.join(carried.select("conv", F.col("carried").alias("own")), "conv")
    parents = nodes.where("depth > 0").select(F.col("conv"), (F.col("depth") - 1).alias("depth")).join(members.select("conv", "depth", "name"), ["conv", "depth"])
    children = parents.groupBy("depth", "name").agg(F.count(F.lit(1)).alias("n_children"))
    up = parents.select(F.col("conv").alias("conv_id"), (F.col("depth") + 1).alias("child_depth"), F.col("depth").alias("up_depth"), "name")
    up = up.join(nodes.select(F.col("depth").alias("up_depth"), "name", F.col("conv").alias("parent_conv_id")), ["up_depth", "name"]).select("conv_id", F.col("child_depth").alias("depth"), "parent_conv_id")
    ends = hashed(members.where("ends"), ["depth", "name"], "conv", F.col("conv").cast("string"), "ends_sha256", between=",")
    found = own.join(sums, ["depth", "name"]).join(children, ["depth", "name"], "left").join(ends, ["depth", "name"], "left")
    found = found.select(F.col("conv").alias("conv_id"), "depth", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", (F.col("carried") - F.col("own") + F.col("saved_here")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
    return found.join(up, ["conv_id", "depth"], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


#: The same rows by DuckDB.
SQL = r"""WITH RECURSIVE o AS (SELECT conv_id AS c, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words, turn FROM conversations WHERE conv_id IS NOT NULL),
 t AS (SELECT c, k, words, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, k) - 1 AS i FROM o),
 crc AS (SELECT range AS b, list_reduce(list_concat([range], range(8)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) AS v FROM range(256)),
 ids AS (SELECT DISTINCT c, CAST(c AS VARCHAR) AS s FROM t),
 steps AS (SELECT c, s, 0 AS n, 4294967295 AS x FROM ids UNION ALL SELECT c, s, n + 1, xor(x // 256, v) FROM steps JOIN crc ON b = xor(x % 256, ascii(s[n + 1])) WHERE n < length(s)),
 h AS (SELECT c, xor(x, 4294967295) % 4 AS h FROM steps WHERE n = length(s)),
 r AS (SELECT h.c, t.i AS i, t.k, t.words FROM h JOIN t ON t.c = h.c - h.c % 20 AND t.i < h.h
  UNION ALL SELECT h.c, t.i - h.h + (SELECT count(*) FROM t u WHERE u.c = h.c - h.c % 20 AND u.i < h.h), t.k, t.words FROM h JOIN t ON t.c = h.c AND t.i >= h.h),
 m AS (SELECT c, 0 AS d, '' AS p, 0 AS words FROM h UNION ALL SELECT c, i + 1, string_agg(k, '') OVER (PARTITION BY c ORDER BY i), words FROM r),
 e AS (SELECT *, d = max(d) OVER (PARTITION BY c) AS ends FROM m),
 n AS (SELECT d, p, min(c) AS c, count(*) AS n_convs, max(words) AS words, bool_and(ends) AS leaf, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM e GROUP BY d, p),
 s AS (SELECT a.d, a.p, count(*) FILTER (b.leaf) AS n_leaves, sum(CASE WHEN b.d > 0 THEN (b.n_convs - 1) * b.words ELSE 0 END) AS saved, count(*) FILTER (b.d = a.d + 1) AS n_children FROM n a JOIN n b ON b.d >= a.d AND starts_with(b.p, a.p) GROUP BY a.d, a.p)
SELECT n.c AS conv_id, CAST(n.d AS BIGINT) AS depth, u.c AS parent_conv_id, n.n_convs, s.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
 FROM n JOIN s ON s.d = n.d AND s.p = n.p LEFT JOIN n u ON u.d = n.d - 1 AND u.p = left(n.p, 64 * (n.d - 1)) AND n.d > 0"""
