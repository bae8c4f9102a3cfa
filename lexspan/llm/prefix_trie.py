"""Trie of the common beginnings of conversations, by a van Emde Boas recursion.

A conversation is a sequence of turns, a node of the trie a distinct beginning. Sequences
are cut at half depth: the distinct first halves are the sequences of the upper trie, and
each full first half is a node that roots a lower forest, whose sequences are the second
halves behind it. Both parts have half the depth and the same form, so one pass over one
table, grouped by forest and segment, builds the upper trie and all lower forests at once;
after ``log2(depth)`` passes segments are single turns, that is nodes. Equal segments of a
forest merge in every pass, so copies travel as one weighted row.

A node is named after the cut that ends there: 128 bits of SHA-256 over the forest's name
and the turns of the first half. The last turn of a second half ends where its parent
segment ends and inherits that name, so names agree between the levels of the recursion.

Totals over subtrees follow the same cuts, each pass on a table half as large as the one
before: upwards, the totals of lower forests are added to the tries that they hang from
until each forest's sum is known; then each forest, from large to small, is grafted what
hangs below its own lowest nodes.

A conversation of more than ``chunk`` turns is never one row: its chunks are named, the
names of neighbours are joined two by two, and the same cuts run over names until
segments are chunks.

Defined results: null roles and texts are empty. Turns are ordered by ``turn`` (null first),
equal turns by the hash of their role and text; repeated rows are turns of their own. Rows
without a conv_id belong to no conversation. ``c % 20`` has the sign of c. Very long texts
are hashed where they are read and never shuffled. Other columns are ignored, whatever their
names. An empty table has no conversation and no node. The hash over the conversations that
end in a node is one sequence by definition: ids are put together in blocks of at most
4096, and a node's blocks stream in order through one task that holds one of them at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspan.llm.shared import map_batches, staged

ROOT = ""
CHUNK = 1024
WORD = r"[^\x20\x09-\x0D]+"


def _name(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 32)


def _turns_name(seg: Column) -> Column:
    return F.array_join(F.transform(seg, lambda x: x["t"]), "")


def head_length(conv: Column) -> Column:
    return (F.crc32(conv.cast("string").cast("binary")) % 4).cast("int")


def rebuilt(turns: DataFrame, group: int = 20, longest_head: int = 3) -> DataFrame:
    """conv_id, at, t, words: the turns of every conversation behind the head it borrows from the first of its group.

    A conversation without turns has one row without t. Borrowed turns are sent from the
    lender to the conversations of its group, at most ``longest_head`` turns each.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        _name(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("t"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "t")) - 1)
    conv, at = F.col("conv_id"), F.col("at")
    kept = at >= head_length(conv)
    own = F.struct(conv.alias("conv_id"), F.lit(True).alias("own"), F.when(kept, F.col("t")).alias("t"), F.when(kept, F.col("words")).alias("words"))
    members = F.filter(F.sequence(conv - (group - 1), conv + (group - 1)), lambda c: (c - c % group == conv) & (at < head_length(c)))
    lent = F.transform(members, lambda c: F.struct(c.alias("conv_id"), F.lit(False).alias("own"), F.col("t"), F.col("words")))
    nobody = F.array().cast("array<struct<conv_id:bigint,own:boolean,t:string,words:bigint>>")
    sent = F.concat(F.array(own), F.when((conv % group == 0) & (at < longest_head), lent).otherwise(nobody))
    rows = rows.select(F.explode(sent).alias("one"), "at").select("one.*", "at")
    inside = Window.partitionBy("conv_id")
    rows = rows.withColumn("exists", F.max("own").over(inside)).where("exists")
    place = F.row_number().over(inside.orderBy(F.col("t").isNull(), "at")) - 1
    return rows.withColumn("place", place).where("t IS NOT NULL OR place = 0").select("conv_id", F.col("place").alias("at"), "t", "words")


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order: (whole, number, least id, hash over all ids) for each run of equal ``whole``."""
    out: list[list] = [[], [], [], []]
    now, state = None, None

    def close() -> None:
        if state is not None:
            for column, value in zip(out, (now, state[0], state[1], state[2].hexdigest()), strict=True):
                column.append(value)

    for batch in batches:
        for whole, n, least, ids in zip(*(batch.column(c).to_pylist() for c in ("whole", "n", "least", "ids")), strict=True):
            if whole != now:
                close()
                now, state = whole, [0, least, hashlib.sha256(ids.encode())]
            else:
                state[2].update(b"," + ids.encode())
            state[0] += n
        if len(out[0]) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["name", "n", "least", "last"])
            out = [[], [], [], []]
    close()
    if out[0]:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["name", "n", "least", "last"])


def _wholes(convs: DataFrame) -> DataFrame:
    """One row a distinct sequence: name, how many conversations have it, the least of them, the hash over their ids."""
    blocks = convs.groupBy("whole", F.shiftright("conv_id", 12).alias("block")).agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")
    )
    return map_batches(blocks.repartition("whole").sortWithinPartitions("whole", "block"), _ends, "name string, n long, least long, last string")


def _merged(rows: DataFrame, content: str) -> DataFrame:
    """Equal segments of a forest as one row."""
    return rows.groupBy("forest", content, "tip", "start").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("last").alias("last"))


def _halves(rows: DataFrame, content: str, left: Column, right: Column, second: Column, half: int, text) -> DataFrame:
    """First halves, named by the cut, and second halves in the forest of that name."""
    cut = _name(F.concat(F.lit(f"{half}:"), "forest", text(left)))
    shared = [F.col("n"), F.col("least")]
    first = F.struct(F.col("forest"), left.alias("content"), cut.alias("tip"), F.col("start"), *shared, F.when(~second, F.col("last")).alias("last"))
    rest = F.struct(cut.alias("forest"), right.alias("content"), F.col("tip"), (F.col("start") + half).alias("start"), *shared, F.col("last"))
    parts = F.when(second, F.array(first, rest)).otherwise(F.array(first))
    return _merged(rows.select(F.explode(parts).alias("one")).select("one.*").withColumnRenamed("content", content), content)


def levels(turns: DataFrame, chunk: int = CHUNK) -> tuple[list[DataFrame], DataFrame]:
    """(segments of 1, 2, 4, ... turns: forest, tip, start, full, n, least, last, content; distinct sequences).

    ``turns`` has conv_id, at (from 0 without gaps), t and words.
    """
    place = (F.col("at") / chunk).cast("long")
    one = F.when(F.col("t").isNotNull(), F.struct("at", "t", "words"))
    pieces = turns.groupBy("conv_id", place.alias("i")).agg(F.sort_array(F.collect_list(one)).alias("seg"))
    pieces = staged(pieces.withColumn("seg", F.transform("seg", lambda x: F.struct(x["t"].alias("t"), x["words"].alias("words")))).withColumn("name", _name(_turns_name(F.col("seg")))))
    most = pieces.agg(F.max(F.col("i") * chunk + F.size("seg"))).first()[0] or 0
    top, base = max(most - 1, 0).bit_length(), chunk.bit_length() - 1

    content = pieces.groupBy("name").agg(F.first("seg").alias("seg"))
    names, pairs = pieces.select("conv_id", "i", "name", F.size("seg").cast("long").alias("size")), {}
    for k in range(base + 1, top + 1):
        side = [F.max(F.when(F.col("i") % 2 == s, F.col("name"))).alias(c) for s, c in ((0, "left"), (1, "right"))]
        both = staged(names.groupBy("conv_id", F.shiftright("i", 1).alias("i")).agg(*side, F.sum("size").alias("size")).withColumn("name", _name(F.when(F.col("size") > 0, F.concat("left", F.lit("+"), F.coalesce("right", F.lit("")))).otherwise(F.lit("")))))
        pairs[k] = both.groupBy("name").agg(F.first("left").alias("left"), F.first("right").alias("right"), F.first("size").alias("size"))
        names = both.select("conv_id", "i", "name", "size")
    wholes = staged(_wholes(names.select("conv_id", F.col("name").alias("whole"))).withColumn("empty", F.col("name") == _name(F.lit(""))))

    tip = _name(F.concat(F.lit(f"{1 << top}:"), F.lit(ROOT), "name"))
    rows = wholes.where("NOT empty").select(F.lit(ROOT).alias("forest"), "name", tip.alias("tip"), F.lit(0).cast("long").alias("start"), "n", "least", "last")
    found: dict[int, DataFrame] = {}
    for k in range(top, base, -1):
        halves = rows.join(pairs[k], "name")
        found[k] = halves.withColumn("full", F.col("size") == 1 << k)
        rows = staged(_halves(halves, "name", F.col("left"), F.col("right"), F.col("right").isNotNull(), 1 << (k - 1), lambda x: x))
    rows = rows.join(content, "name").drop("name")
    for k in range(min(top, base), -1, -1):
        rows = staged(rows)
        found[k] = rows.withColumn("full", F.size("seg") == 1 << k)
        if k:
            half = 1 << (k - 1)
            left, right = F.slice("seg", 1, half), F.slice("seg", half + 1, half)
            rows = _halves(rows, "seg", left, right, F.size("seg") > half, half, _turns_name)
    return [found[k] for k in range(top + 1)], wholes


def _sums(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def _grafted(segments: list[DataFrame], nodes: DataFrame) -> DataFrame:
    """node, leaves, saved: totals of all that lies below each inner node."""
    forests = [staged(_sums(nodes.select(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth"), "leaves", "saved"), "node", "depth"))]
    top = len(segments) - 1
    side = lambda k, odd: segments[k].where(F.col("full") & (F.col("start") / (1 << k) % 2 == odd))
    for k in range(top):  # forests of 2**(k + 1) turns out of those of 2**k
        hung = side(k, 0).select(F.col("tip").alias("node"), "forest", "start").join(forests[k].drop("depth"), "node")
        hung = hung.select(F.col("forest").alias("node"), F.col("start").alias("depth"), "leaves", "saved")
        forests.append(staged(_sums(forests[k].where(F.col("depth") % (2 << k) == 0).unionByName(hung), "node", "depth")))
    below = forests[top].drop("depth")
    for k in reversed(range(top)):
        deeper = side(k, 1).select(F.col("tip").alias("node"), "forest").join(below, "node").select(F.col("forest").alias("node"), "leaves", "saved")
        middle = forests[k].where(F.col("depth") % (2 << k) != 0).drop("depth")
        below = staged(below.unionByName(_sums(middle.unionByName(deeper), "node")))
    return below


def trie(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    segments, wholes = levels(turns, chunk)
    words = F.get("seg.words", F.lit(0))
    found = segments[0].select(F.col("tip").alias("node"), F.col("forest").alias("parent"), (F.col("start") + 1).alias("depth"), "n", "least", words.alias("words"), "last")
    root = wholes.agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max(F.when(F.col("empty"), F.col("last"))).alias("last")).where("n IS NOT NULL")
    root = root.select(F.lit(ROOT).alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("depth"), "n", "least", F.lit(0).cast("long").alias("words"), "last")
    found = found.unionByName(root)
    kids = found.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("kids"))
    own = (F.col("n") - 1) * F.col("words")
    nodes = staged(found.join(kids, "node", "left").withColumns({"leaves": F.col("kids").isNull().cast("long"), "saved": own}))
    below = _grafted(segments, nodes.where("parent IS NOT NULL")).select("node", F.col("leaves").alias("more_leaves"), F.col("saved").alias("more_saved"))
    parents = nodes.select(F.col("node").alias("parent"), F.col("least").alias("parent_conv_id"))
    zero = F.lit(0).cast("long")
    return (
        nodes.join(below, "node", "left")
        .join(parents, "parent", "left")
        .select(
            F.col("least").alias("conv_id"),
            "depth",
            "parent_conv_id",
            F.col("n").alias("n_convs"),
            F.coalesce("kids", zero).alias("n_children"),
            (F.col("leaves") + F.coalesce("more_leaves", zero)).alias("n_leaves"),
            (F.col("saved") + F.coalesce("more_saved", zero)).alias("saved_tokens"),
            F.coalesce("last", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        )
    )


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return trie(rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def _op11_sql() -> str:
    from lexspan.llm.merkle import crc32_sql

    return f"""
WITH own AS (SELECT conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))[1:32] AS t,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
  placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, t) - 1 AS place FROM own),
  convs AS (SELECT conv_id, {crc32_sql('CAST(conv_id AS VARCHAR)')} % 4 AS h FROM (SELECT DISTINCT conv_id FROM own)),
  joined AS (SELECT c.conv_id, p.place, p.t, p.words FROM convs c JOIN placed p ON p.conv_id = c.conv_id - c.conv_id % 20 AND p.place < c.h
    UNION ALL SELECT c.conv_id, p.place, p.t, p.words FROM convs c JOIN placed p ON p.conv_id = c.conv_id AND p.place >= c.h),
  seqs AS (SELECT c.conv_id, coalesce(list(j.t ORDER BY j.place) FILTER (j.t IS NOT NULL), []) AS seq, list(j.words ORDER BY j.place) AS words FROM convs c LEFT JOIN joined j USING (conv_id) GROUP BY c.conv_id),
  parts AS (SELECT conv_id, len(seq) AS size, unnest(range(0, len(seq) + 1)) AS depth, seq, words FROM seqs),
  keyed AS (SELECT conv_id, size, depth, array_to_string(seq[1:depth], '') AS node, CASE WHEN depth > 0 THEN array_to_string(seq[1:depth - 1], '') END AS parent, CASE WHEN depth > 0 THEN words[depth] ELSE 0 END AS words FROM parts),
  nodes AS (SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n, (count(*) - 1) * any_value(words) AS saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends FROM keyed GROUP BY node),
  kids AS (SELECT parent AS node, count(*) AS kids FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
  full_nodes AS (SELECT n.*, coalesce(k.kids, 0) AS kids FROM nodes n LEFT JOIN kids k USING (node)),
  pairs AS (SELECT unnest(list_transform(range(0, depth + 1), lambda d: node[1:32 * d])) AS above, kids, saved FROM full_nodes),
  totals AS (SELECT above AS node, count(*) FILTER (kids = 0) AS leaves, CAST(sum(saved) AS BIGINT) AS saved FROM pairs GROUP BY above)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n AS n_convs, n.kids AS n_children, t.leaves AS n_leaves, t.saved AS saved_tokens, n.ends AS ends_sha256
FROM full_nodes n JOIN totals t USING (node) LEFT JOIN full_nodes p ON p.node = n.parent"""


OP11_SQL = _op11_sql()
