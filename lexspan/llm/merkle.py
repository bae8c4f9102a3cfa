"""A manifest of a dataset as a tree of hashes, with a proof for every row.

Rows are leaves; those of one language, in the order of their ids, form a tree in which
every run of eight nodes becomes one. The roots of the languages, in their order, form a
last tree with the root of the whole manifest.

A node's rank inside its tree is written in digits to the base eight. Blocks of 8**4
consecutive ranks are folded by grouping one digit column away after the other: the last
digit's nodes become an array of structs inside a node of the next digit, and so on, until
one nested row is left a block. A block always holds 4096 nodes or fewer, however large
its tree, and one exchange serves all four groupings. The blocks' digests are the nodes of
the next stage. Downwards, the siblings above a block enter its grouping as one more row
without digits; a transform and an explode for each digit then hand every child the
digests beside it. Siblings meet their leaves by grouping alone: no proof is joined.

Ranks come from sorted ranges: the place inside a range, plus one number for each range and
tree it touches. A tree that holds most rows is spread over many ranges and blocks.

Defined results: a null value enters a leaf as ``-``; a null language is a tree of its own,
before all others; empty texts are values of length 0. A null id comes first in its tree.
Rows with the same id are ordered by their leaves, repeated rows are leaves as often as
they occur (which of two equal leaves comes first changes no digest). Very long texts are
hashed whole, once, and never leave their task. Other columns are ignored, whatever their
names. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspan.llm.shared import staged

FAN, DIGITS = 8, 4
BLOCK = FAN**DIGITS
#: Rows up to which the table of ranges is broadcast (some 60 bytes each).
BROADCAST_ROWS = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<left:string,right:string>>"


def _value(column: Column) -> Column:
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _hash(text: Column) -> Column:
    return F.sha2(text, 256)


def _joined(digests: Column) -> Column:
    return F.array_join(digests, "")


def leaves(docs: DataFrame, columns: tuple[str, ...], tree: str, order: str, tampered: dict[str, Column]) -> DataFrame:
    """tree, id, digest and, for rows that ``tampered`` alters, the digest with those columns altered (else null)."""
    plain = _hash(F.concat(*[_value(F.col(c)) for c in columns]))
    altered = _hash(F.concat(*[_value(tampered.get(c, F.col(c))) for c in columns]))
    when = tampered.get("when", F.lit(False))
    return docs.select(
        F.coalesce(F.concat(F.lit("+"), F.col(tree).cast("string")), F.lit("")).alias("tree"),
        F.col(order).alias("id"),
        plain.alias("digest"),
        F.when(when, altered).alias("altered"),
    )


def ranked(nodes: DataFrame, *order: str) -> DataFrame:
    """``nodes`` with their rank inside their tree (from 0) and the tree's size."""
    ranges = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = staged(nodes.repartitionByRange(ranges, "tree", *order).sortWithinPartitions("tree", *order).withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33).alias("part")  # the upper bits are the range, the lower ones count its rows
    inside = Window.partitionBy("tree").orderBy("part")
    runs = staged(
        placed.groupBy("tree", part)
        .agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("here"))
        .select("tree", "part", (F.sum("here").over(inside) - F.col("here") - F.col("first")).alias("base"), F.sum("here").over(Window.partitionBy("tree")).alias("size"))
    )
    runs = F.broadcast(runs) if runs.count() <= BROADCAST_ROWS else runs
    return placed.withColumn("part", part).join(runs, ["tree", "part"]).withColumn("rank", F.col("place") + F.col("base")).drop("part", "place", "base")


def _present(kids: Column, digit: str) -> Column:
    return F.filter(kids, lambda kid: kid[digit].isNotNull())


def _beside(kids: Column, digests: Column) -> Column:
    """Each of a run's nodes with the digests left and right of it."""
    return F.transform(
        kids, lambda kid, at: F.struct(kid.alias("kid"), _joined(F.slice(digests, F.lit(1), at)).alias("left"), _joined(F.slice(digests, at + 2, F.lit(FAN))).alias("right"))
    )


def _folded(nodes: DataFrame, payload: tuple[str, ...], above: DataFrame | None) -> DataFrame:
    """One row a block: tree, block, size, its digest, the nested nodes and what lies above."""
    digits = [f"d{j}" for j in range(DIGITS)]
    rows = nodes.select(
        "tree",
        F.shiftright("rank", 3 * DIGITS).alias("block"),
        *[F.shiftright("rank", 3 * j).bitwiseAND(FAN - 1).cast("int").alias(d) for j, d in enumerate(digits)],
        "size",
        "digest",
        *payload,
    )
    if above is not None:
        rows = rows.unionByName(above, allowMissingColumns=True)
    rows = rows.repartition("tree", "block")
    inner = ["digest", *payload]
    for j, digit in enumerate(digits):
        run = _present(F.sort_array(F.collect_list(F.struct(digit, *inner))), digit)
        carried = [F.max(c).alias(c) for c in ("size", *(["above"] if above is not None else []))]
        rows = rows.groupBy("tree", "block", *digits[j + 1 :]).agg(*carried, run.alias("kids"))
        rows = rows.withColumn("digest", F.when(F.col("size") > FAN**j, _hash(_joined(F.col("kids.digest")))).otherwise(F.get("kids.digest", F.lit(0))))
        inner = ["digest", "kids"]
    return rows


def _tops(nodes: DataFrame) -> DataFrame:
    """The blocks of a stage as nodes of the next one."""
    return _folded(nodes, (), None).select("tree", F.col("block").alias("rank"), F.ceil(F.col("size") / BLOCK).alias("size"), "digest")


def _stages(nodes: DataFrame) -> list[DataFrame]:
    """The nodes, then the blocks of nodes, ... until one is left a tree."""
    most, found = nodes.agg(F.max("size")).first()[0] or 0, [nodes]
    while most > 1:
        found.append(staged(_tops(found[-1])))
        most = -(-most // BLOCK)
    return found


def _proved(nodes: DataFrame, payload: tuple[str, ...], above: DataFrame) -> DataFrame:
    """Every node with ``above`` of its block, its path lengthened by the siblings inside the block."""
    rows = _folded(nodes, payload, above)
    inner = F.struct(F.lit(None).cast("string").alias("digest"), "kids")
    rows = rows.select("tree", "block", "size", "above", F.col("above.path").alias("path"), inner.alias("node"), F.lit(0).cast("long").alias("rank"))
    for j in reversed(range(DIGITS)):
        rows = rows.withColumn("one", F.explode(_beside(F.col("node.kids"), F.col("node.kids.digest"))))
        step = F.concat(F.array(F.struct("one.left", "one.right")), "path")
        rows = rows.select(
            "tree",
            "block",
            "size",
            "above",
            F.when(F.col("size") > FAN**j, step).otherwise(F.col("path")).cast(PATH).alias("path"),
            F.col("one.kid").alias("node"),
            (F.col("rank") * FAN + F.col(f"one.kid.d{j}")).alias("rank"),
        )
    return rows.select("tree", (F.col("block") * BLOCK + F.col("rank")).alias("rank"), "path", "above", "node.digest", *[f"node.{c}" for c in payload])


def _above(tree: Column, block: Column, path: Column, subroot: Column, root: Column) -> list[Column]:
    return [tree.alias("tree"), block.cast("long").alias("block"), F.struct(path.cast(PATH).alias("path"), subroot.cast("string").alias("subroot"), root.alias("root")).alias("above")]


def _down(stages: list[DataFrame], payload: tuple[str, ...], above: DataFrame) -> DataFrame:
    """The nodes of the first stage with their whole paths; ``above`` has one row a tree."""
    for stage in stages[1:-1][::-1]:
        rows = _proved(stage, (), above)
        above = staged(rows.select(*_above(F.col("tree"), F.col("rank"), F.col("path"), F.col("above.subroot"), F.col("above.root"))))
    return _proved(stages[0], payload, above)


def manifest(docs: DataFrame, *, columns: tuple[str, ...], tree: str, order: str, tampered: dict[str, Column] | None = None) -> DataFrame:
    """One row a document: id, leaf, subroot, root, path (per level the digests left and right of it) and altered leaf."""
    nodes = ranked(staged(leaves(docs, columns, tree, order, tampered or {})), "id", "digest")
    stages = _stages(staged(nodes))
    trees = staged(ranked(stages[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), "name"))
    upper = _stages(trees)
    top = upper[-1].select(*_above(F.col("tree"), F.lit(0), F.array(), F.lit(None), F.col("digest")))
    roots = _down(upper, ("name",), top)
    above = staged(roots.select(*_above(F.col("name"), F.lit(0), F.col("path"), F.col("digest"), F.col("above.root"))))
    return _down(stages, ("id", "altered"), above).select("id", F.col("digest").alias("leaf"), "above.subroot", "above.root", "path", "altered")


def folded_root(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda digest, level: _hash(F.concat(level["left"], digest, level["right"])))


def proof_digest(path: Column) -> Column:
    return _hash(_joined(F.transform(path, lambda level: F.concat(level["left"], level["right"]))))


COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = {"when": F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, "text": F.translate("text", UPPER, LOWER)}
    rows = manifest(docs, columns=COLUMNS, tree="lang", order="doc_id", tampered=tampered)
    rows = rows.withColumn("folded_root", folded_root(F.coalesce("altered", "leaf"), F.col("path")))
    return rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def crc32_sql(text: str) -> str:
    """DuckDB's form of the unsigned crc32 of an ASCII text: eight shifts for each of its bytes."""
    bit = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda s: ascii(s)::BIGINT)), lambda c, b: {bit}), 4294967295)"


#: Levels that the SQL writes out; 8**7 leaves a tree.
SQL_LEVELS = 7


def _tree_sql(name: str, leaves_sql: str, by: str) -> str:
    """Nodes of every level as ``{name}(level, by, rank, size, digest)``."""
    parts = [f"{name}0 AS ({leaves_sql})"]
    for j in range(1, SQL_LEVELS + 1):
        parts.append(
            f"{name}{j} AS (SELECT {by}, rank // 8 AS rank, CASE WHEN any_value(size) > 1 THEN sha256(string_agg(digest, '' ORDER BY rank)) ELSE any_value(digest) END AS digest,"
            f" CAST(ceil(any_value(size) / 8) AS BIGINT) AS size FROM {name}{j - 1} GROUP BY ALL)"
        )
    levels = " UNION ALL ".join(f"SELECT {j} AS level, {by}, rank, size, digest FROM {name}{j}" for j in range(SQL_LEVELS + 1))
    return ", ".join(parts) + f", {name} AS ({levels})"


def _sides_sql(name: str, by: str) -> str:
    """Digests left and right of every node that has a level above it."""
    run = f"PARTITION BY {by}, level, rank // 8 ORDER BY rank"
    return (
        f"SELECT level, {by}, rank, coalesce(string_agg(digest, '') OVER ({run} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,"
        f" coalesce(string_agg(digest, '') OVER ({run} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name} WHERE size > 1"
    )


def _op13_sql() -> str:
    def value(c: str) -> str:
        return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"

    leaf = " || ".join(value(c) for c in COLUMNS)
    odd = " || ".join(value(f"translate(text, '{UPPER}', '{LOWER}')" if c == "text" else c) for c in COLUMNS)
    levels = range(SQL_LEVELS)
    steps = [f"d{j}" for j in levels] + [f"t{j}" for j in levels]
    sides = " ".join(f"LEFT JOIN docsides d{j} ON d{j}.level = {j} AND d{j}.tree = m.tree AND d{j}.rank = m.rank // {8**j}" for j in levels)
    sides += " " + " ".join(f"LEFT JOIN treesides t{j} ON t{j}.level = {j} AND t{j}.rank = n.rank // {8**j}" for j in levels)
    proof = " || ".join(f"coalesce({s}.l || {s}.r, '')" for s in steps)
    fold = reduce(lambda x, s: f"(SELECT CASE WHEN {s}.l IS NULL THEN v ELSE sha256({s}.l || v || {s}.r) END FROM (SELECT {x} AS v))", steps, "coalesce(m.altered, m.digest)")
    return f"""
WITH leaves AS (SELECT coalesce('+' || lang, '') AS tree, doc_id, sha256({leaf}) AS digest,
    CASE WHEN {crc32_sql('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN sha256({odd}) END AS altered FROM documents),
  placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS rank, count(*) OVER (PARTITION BY tree) AS size FROM leaves),
  {_tree_sql('doc', 'SELECT tree, rank, size, digest FROM placed', 'tree')},
  subroots AS (SELECT tree, digest FROM doc{SQL_LEVELS}),
  names AS (SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS rank, count(*) OVER () AS size FROM subroots),
  {_tree_sql('top', "SELECT '' AS one, rank, size, digest FROM names", 'one')},
  docsides AS ({_sides_sql('doc', 'tree')}), treesides AS ({_sides_sql('top', 'one')}),
  folded AS (SELECT m.doc_id, m.digest AS leaf, n.digest AS subroot, (SELECT digest FROM top{SQL_LEVELS}) AS root, sha256({proof}) AS proof_sha256, {fold} AS folded_root
    FROM placed m JOIN names n ON n.tree = m.tree {sides})
SELECT *, folded_root = root AS verified FROM folded"""


OP13_SQL = _op13_sql()
