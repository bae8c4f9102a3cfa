"""From words and pages to blocks, section paths and chunks.

One partitioning by document serves all windows; text is carried once and sliced by offsets.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lexspan.functions import helpers
from lexspan.functions import text as t
from lexspan.settings import DEFAULTS

DOC = "document_id"
#: The plug point for a model: texts of a batch to their vectors.
Embedder = Callable[[pd.Series], pd.Series]


def pages_from_words(words: DataFrame) -> DataFrame:
    """Word rows to page text: a space inside a line, a line feed between lines, a blank line between blocks."""
    order = Window.partitionBy(DOC, "page_number").orderBy("block_no", "line_no", "word_no")
    kept = words.where(t.strip(F.col("token")) != "").withColumns({"_b": F.lag("block_no").over(order), "_l": F.lag("line_no").over(order)})
    gap = F.when(F.col("_b").isNull(), "").when(F.col("_b") != F.col("block_no"), "\n\n").when(F.col("_l") != F.col("line_no"), "\n").otherwise(" ")
    placed = kept.withColumn("_gap", gap).withColumn("end", F.sum(F.char_length("_gap") + F.char_length("token")).over(order))
    box = F.struct((F.col("end") - F.char_length("token")).cast("int").alias("start"), F.col("end").cast("int").alias("end"), "x0", "y0", "x1", "y1")
    rows = placed.groupBy(DOC, "page_number").agg(F.array_sort(F.collect_list(F.struct(F.col("end").alias("at"), F.concat("_gap", "token").alias("piece"), box.alias("box")))).alias("w"))
    return rows.select(DOC, "page_number", F.array_join(F.col("w")["piece"], "").alias("text"), F.col("w")["box"].alias("words"))


def page_from_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """Paragraph and table rows to one page with its words.

    Paragraphs are stripped; the cells of a row that are not blank are joined by bars. Words
    are split at single spaces; where they stand on paper is unknown, so their boxes are zero.
    """
    cells = F.filter(F.transform("cells", t.strip), lambda c: c != "")
    text = F.replace(F.when(F.col("kind") == "tr", F.array_join(cells, " | ")).otherwise(t.strip(F.col("text"))), F.lit("\n\n"), F.lit("\n"))
    kept = paragraphs.withColumn("_text", text).where("_text <> ''")
    joined = kept.groupBy(DOC).agg(F.array_sort(F.collect_list(F.struct("position", "_text")))["_text"].alias("_p"))
    spans = helpers.word_spans(F.array_join("_p", "  "))  # two spaces are as long as the blank line between paragraphs
    zero = [F.lit(0.0).alias(c) for c in ("x0", "y0", "x1", "y1")]
    words = F.transform(spans, lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), *zero))
    return joined.select(DOC, F.lit(1).alias("page_number"), F.array_join("_p", "\n\n").alias("text"), words.alias("words"))


def flag_scanned(words: DataFrame, pages: DataFrame | None = None, least: int = DEFAULTS.ocr_min_chars) -> DataFrame:
    """Pages with fewer extractable characters than ``least``; a document is flagged if any page is.

    ``pages`` lists the pages (document, number); without it a page without any word is unknown.
    """
    counted = words.groupBy(DOC, "page_number").agg(F.sum(F.char_length(t.strip(F.col("token")))).alias("chars"))
    if pages is not None:
        counted = pages.select(DOC, "page_number").distinct().join(counted, [DOC, "page_number"], "left")
    flagged = counted.withColumn("chars", F.coalesce("chars", F.lit(0))).withColumn("is_ocr", F.col("chars") < least)
    return flagged.withColumn("document_is_ocr", F.max("is_ocr").over(Window.partitionBy(DOC)))


def with_offsets(pages: DataFrame) -> DataFrame:
    """Pages with the place of their first character in the document."""
    before = Window.partitionBy(DOC).orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("char_offset", F.coalesce(F.sum(F.char_length("text") + 1).over(before), F.lit(0)).cast("int"))


def assemble_text(pages: DataFrame) -> DataFrame:
    """One text per document: pages in order, a line feed between them."""
    return pages.groupBy(DOC).agg(F.array_join(F.array_sort(F.collect_list(F.struct("page_number", "text")))["text"], "\n").alias("text"))


def blocks_from_pages(pages: DataFrame) -> DataFrame:
    """Paragraphs of pages that carry ``char_offset``; blank ones dropped, the rest stripped."""
    parts = pages.select(DOC, "page_number", "char_offset", F.posexplode(F.split("text", "\n\n", -1)).alias("pos", "raw"))
    before = Window.partitionBy(DOC, "page_number").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("_at", F.coalesce(F.sum(F.char_length("raw") + 2).over(before), F.lit(0)))
    lead = F.char_length("raw") - F.char_length(F.regexp_replace("raw", r"(?U)^\s+", ""))
    start = (F.col("char_offset") + F.col("_at") + lead).cast("int")
    stripped = t.strip(F.col("raw"))
    return placed.where(stripped != "").select(DOC, "page_number", "pos", stripped.alias("text"), start.alias("char_start"), (start + F.char_length(stripped)).alias("char_end"))


def section_paths(blocks: DataFrame) -> DataFrame:
    """Blocks with the path of open headings and its root.

    A heading closes all headings at or below its depth, so the heading of level ``d`` is
    open exactly if the last heading of depth at most ``d`` has that depth.
    """
    so_far = Window.partitionBy(DOC).orderBy("char_start").rowsBetween(Window.unboundedPreceding, 0)
    marked = blocks.withColumn("marker", t.detect_marker(F.col("text")))
    levels = {}
    for d in range(5):
        at = F.when(F.col("marker.depth") <= d, F.struct("marker.depth", "marker.label"))
        levels[f"_l{d}"] = F.last(at, ignorenulls=True).over(so_far)
    open_label = [F.when(F.col(f"_l{d}.depth") == d, F.col(f"_l{d}.label")) for d in range(5)]
    return marked.withColumns(levels).select(
        *blocks.columns, "marker", F.concat_ws(" > ", *open_label).alias("section_path"), open_label[0].alias("root"), F.coalesce(F.col("marker.depth") <= 1, F.lit(False)).alias("hard_boundary")
    )


def page_for_offset(rows: DataFrame, pages: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with the page of each offset column: the last page that begins at or before it, else the first."""
    listed = pages.groupBy(DOC).agg(F.array_sort(F.collect_list(F.struct("char_offset", "page_number"))).alias("_pages"))
    joined = rows.join(listed, DOC, "left")
    for c in columns:
        joined = joined.withColumn(f"{c}_page", page_at(F.col(c)))
    return joined.drop("_pages")


def page_at(offset: Column) -> Column:
    """The page of an offset by the list ``_pages``."""
    before = F.filter("_pages", lambda p: p["char_offset"] <= offset)
    return F.coalesce(F.get(before, F.size(before) - 1)["page_number"], F.get("_pages", F.lit(0))["page_number"])


def page_ends(pages: DataFrame) -> DataFrame:
    """Per document the list of its pages in order: char_offset, page_number and where the page ends."""
    stop = F.char_length("text") if "text" in pages.columns else F.get(F.col("words.end"), F.size("words") - 1)
    ends = pages.select(DOC, "char_offset", "page_number", (F.col("char_offset") + stop).alias("_stop"))
    return ends.groupBy(DOC).agg(F.array_sort(F.collect_list(F.struct("char_offset", "page_number", "_stop"))).alias("_pages"))


def touched_pages() -> Column:
    """Those of ``_pages`` that char_start to char_end touches."""
    return F.filter("_pages", lambda p: (p["_stop"] > F.col("char_start")) & (p["char_offset"] < F.col("char_end")))


def boxes_between(words: Column, start: Column, end: Column) -> Column:
    """Boxes of a page's words that overlap a stretch of it."""
    solid = lambda w: (w["x1"] > w["x0"]) | (w["y1"] > w["y0"])
    covered = F.filter(words, lambda w: (w["end"] > start) & (w["start"] < end) & solid(w))
    return F.transform(covered, lambda w: F.array(w["x0"], w["y0"], w["x1"], w["y1"]))


def bboxes_for_span(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """Boxes of the words that each (document, span_id, char_start, char_end) overlaps, by page.

    A span is first taken apart into the pages that it touches, on the short list of a
    document's page ends; words then meet it by an equality on document and page, so the work
    is per page however long the document is.
    """
    parts = spans.join(page_ends(pages), DOC).withColumn("_p", F.explode(touched_pages())).select(DOC, "span_id", F.col("_p.page_number").alias("page_number"), (F.col("char_start") - F.col("_p.char_offset")).alias("_a"), (F.col("char_end") - F.col("_p.char_offset")).alias("_b"))
    on_page = parts.join(pages.select(DOC, "page_number", "words"), [DOC, "page_number"])
    paged = on_page.select(DOC, "span_id", "page_number", boxes_between(F.col("words"), F.col("_a"), F.col("_b")).alias("boxes")).where(F.size("boxes") > 0)
    return paged.groupBy(DOC, "span_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("page_number", "boxes")))).alias("bboxes"))


def check_offsets(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Violations: a wrong page offset, a chunk that is not its slice, documents without chunks or text."""
    rebuilt = with_offsets(pages.drop("char_offset")).select(DOC, "page_number", F.col("char_offset").alias("_right"))
    wrong = pages.join(rebuilt, [DOC, "page_number"]).where("char_offset <> _right").select(DOC, F.lit("page offset").alias("problem"))
    whole = assemble_text(pages)
    sliced = chunks.join(whole.withColumnRenamed("text", "_text"), DOC).where(F.substring("_text", F.col("char_start") + 1, F.col("char_end") - F.col("char_start")) != F.col("text"))
    empty = whole.where(t.strip(F.col("text")) == "").select(DOC, F.lit("no text").alias("problem"))
    bare = whole.where(t.strip(F.col("text")) != "").join(chunks, DOC, "left_anti").select(DOC, F.lit("no chunks").alias("problem"))
    return wrong.union(sliced.select(DOC, F.lit("chunk slice"))).union(empty).union(bare)


def outline(chunks: DataFrame, most: int = 80) -> DataFrame:
    """The first ``most`` distinct section paths of each document, in order of appearance."""
    first = chunks.where("section_path <> ''").groupBy(DOC, "section_path").agg(F.min("ordinal").alias("first_ordinal"))
    place = F.row_number().over(Window.partitionBy(DOC).orderBy("first_ordinal"))
    return first.withColumn("place", place).where(F.col("place") <= most)


#: Where a sentence ends and the next one begins.
SENTENCE_GAP = r"(?U)(?<=[.;:!?])\s+(?=[A-Z(\d\"'])"
SENTENCE_LAST = r"[.;:!?]$"
SENTENCE_FIRST = r"(?U)^[A-Z(\d\"']"


def with_sentences(blocks: DataFrame) -> DataFrame:
    """Blocks with the lengths of their sentences and of the gaps between, and whether one begins with the block."""
    before = F.lag("text").over(Window.partitionBy(DOC).orderBy("char_start"))
    return blocks.withColumns(
        {
            "sentences": F.transform(F.split("text", SENTENCE_GAP, -1), F.char_length),
            "gaps": F.transform(F.regexp_extract_all("text", F.lit(SENTENCE_GAP), F.lit(0)), F.char_length),
            "opens": F.coalesce(before.rlike(SENTENCE_LAST) & F.col("text").rlike(SENTENCE_FIRST), F.lit(False)),
        }
    )


def tokens_of(length):
    """Estimated tokens of so many characters."""
    return np.maximum(1, (np.asarray(length) + 3) // 4)


def _greedy(weight: list[int], head: list[bool], most: int) -> list[int]:
    """Where groups of neighbours begin that are as long as ``most`` allows (one at least); a head begins one anyway."""
    spent, found = 0, []
    for i, (w, h) in enumerate(zip(weight, head, strict=True)):
        if h or spent + w > most:
            found.append(i)
            spent = 0
        spent += w
    return found


def _cut_places(start: int, end: int, inner: np.ndarray, most: int) -> np.ndarray:
    """Where the pieces of a long block begin: at sentences if it has several, else at equal distances."""
    if not len(inner):
        return np.arange(start, end, 4 * most)
    edges = np.concatenate([[start], inner, [end]])
    return edges[_greedy(np.diff(edges).tolist(), [True] + [False] * len(inner), 4 * most)]


def _changes(values: np.ndarray) -> np.ndarray:
    """Whether a value differs from the one before it; the first does."""
    return np.concatenate([[True], values[1:] != values[:-1]])


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers of the lists, where each list begins and ends)."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)


#: Documents are told apart by this much when their offsets stand in one array.
FAR = 1 << 32


def _pack(held: pa.ListArray, target: int, most: int) -> list[tuple]:
    """Offsets, section paths and flags of the blocks of documents (a list each, in order) to rows of chunks.

    What may share a chunk is a unit: a whole section (from one hard boundary to the next)
    that fits the target, or a piece of a larger one. Neighbouring units share chunks while
    they have one key: the root for whole sections, the section for pieces. Each chunk may
    reach back over the last sentence of the chunk before it. All documents of a batch are
    packed at once: a document begins a section, a run and a chunk.
    """
    field = dict(zip([f.name for f in held.type.value_type], held.flatten().flatten(), strict=True))
    owner = np.repeat(np.arange(len(held)), held.value_lengths().to_numpy(zero_copy_only=False))
    if not len(owner):
        return []
    first, last = (field[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("char_start", "char_end"))
    hard_block, opens = (field[c].to_numpy(zero_copy_only=False).astype(bool) for c in ("hard_boundary", "opens"))
    (sentences, edges), (gaps, places) = _flat(field["sentences"]), _flat(field["gaps"])
    steps = np.delete(sentences, edges[1:] - 1) + gaps
    running = np.concatenate([[0], np.cumsum(steps)])
    of_block = np.repeat(np.arange(len(first)), np.diff(places))
    inner = first[of_block] + running[1:] - running[places[of_block]]  # where second and later sentences begin

    long = np.flatnonzero(last - first > 4 * most)
    cuts = {k: _cut_places(first[k], last[k], inner[places[k] : places[k + 1]], most) for k in long.tolist()}
    count = np.ones(len(first), np.int64)
    count[long] = [len(c) for c in cuts.values()]
    block = np.repeat(np.arange(len(first)), count)
    begin, at_block = first[block], np.cumsum(count) - count
    for k, places_in in cuts.items():
        begin[at_block[k] : at_block[k] + len(places_in)] = places_in
    end = np.where(np.append(block[1:] != block[:-1], True), last[block], np.append(begin[1:], 0))
    document = owner[block]
    new = _changes(document)
    hard = hard_block[block] & _changes(block)

    size = tokens_of(end - begin)
    section = np.cumsum(hard | new)
    whole = np.bincount(section, weights=size)[section] <= target
    at = np.flatnonzero(~whole | _changes(section))
    root = pd.factorize(np.array(field["root"].to_pylist(), object), use_na_sentinel=False)[0][block[at]]
    key = np.where(whole[at], root, -1 - section[at])
    units = _greedy(np.add.reduceat(size, at).tolist(), (_changes(key) | new[at]).tolist(), target)

    pieces = at[units]
    spots = np.sort(np.concatenate([owner[of_block] * FAR + inner, owner[opens] * FAR + first[opens]]))
    stops = np.append(pieces[1:], len(begin))
    ends, of, paths = end[stops - 1], document[pieces], field["section_path"].to_pylist()
    before = np.searchsorted(spots, of[:-1] * FAR + ends[:-1]) - 1  # the last sentence that begins inside the chunk before
    reach = np.where(before >= 0, spots[before] if len(spots) else 0, -1) - of[:-1] * FAR
    split = [p.split(" > ") if p else [] for p in paths]
    rows, n, reached = [], 0, 0
    for i, (a, d, start, stop, from_, to, fixed, fresh) in enumerate(zip(pieces.tolist(), of.tolist(), begin[pieces].tolist(), ends.tolist(), block[pieces].tolist(), block[stops - 1].tolist(), hard[pieces].tolist(), new[pieces].tolist(), strict=True)):
        n = 0 if fresh else n + 1
        if n and not fixed and split[block[a - 1]][:1] == split[from_][:1]:
            back = max(int(reach[i - 1]), 0, reached)
            if back < start and (stop - back + 3) // 4 <= most:
                start = back
        path = paths[from_] if to == from_ else " > ".join(os.path.commonprefix(split[from_ : to + 1]))
        rows.append((d, n, start, stop, path, max(1, (stop - start + 3) // 4)))
        reached = start
    return rows


def _packer(target: int, most: int, schema: pa.Schema):
    """Batches of (document, its blocks) to batches of chunks, some thousand blocks at a time."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.cumsum(batch.column("_blocks").value_lengths().to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PACKED_BLOCKS, "right")))
                rows = _pack(batch.column("_blocks").slice(at, to - at), target, most)
                columns = list(zip(*rows, strict=True)) or [()] * 6
                ids = batch.column(DOC).slice(at, to - at).take(pa.array(columns[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, f.type) for c, f in zip(columns[1:], list(schema)[1:], strict=True))], schema=schema)
                at = to

    return pack


#: Blocks that are packed at once, about: a few MB.
PACKED_BLOCKS = 20_000


def chunk_documents(pages: DataFrame, target: int = DEFAULTS.chunk_target_tokens, most: int = DEFAULTS.chunk_max_tokens) -> DataFrame:
    """Chunks of pages that carry ``char_offset``: text, offsets, pages, path, tokens."""
    blocks = with_sentences(section_paths(blocks_from_pages(pages))).select(DOC, "char_start", "char_end", "section_path", "root", "hard_boundary", "sentences", "gaps", "opens")
    kind = dict(pages.dtypes)[DOC]
    schema = f"{DOC} {kind}, ordinal int, char_start int, char_end int, section_path string, token_count int"
    held = blocks.groupBy(DOC).agg(F.array_sort(F.collect_list(F.struct(*[c for c in blocks.columns if c != DOC]))).alias("_blocks"))
    drafts = held.mapInArrow(_packer(target, most, to_arrow_schema(StructType.fromDDL(schema))), schema)
    paged = page_for_offset(drafts.withColumn("last", F.greatest("char_start", F.col("char_end") - 1)), pages, "char_start", "last")
    sliced = paged.join(assemble_text(pages).withColumnRenamed("text", "_text"), DOC)
    return sliced.select(
        DOC, "ordinal", F.substring("_text", F.col("char_start") + 1, F.col("char_end") - F.col("char_start")).alias("text"), "section_path",
        F.col("char_start_page").alias("page_start"), F.col("last_page").alias("page_end"), "char_start", "char_end", "token_count",
    )


def embed_chunks(chunks: DataFrame, embedder: Embedder, *, dim: int = DEFAULTS.embed_dim, batch: int = DEFAULTS.embed_batch, stored: DataFrame | None = None) -> DataFrame:
    """``chunks`` with ``embedding`` and ``embed_error``.

    ``stored`` (document_id, ordinal, text, embedding) are chunks of an earlier run: one whose
    text is still the same and whose vector is there is not embedded again.
    """
    key = [DOC, "ordinal"]
    ask = helpers.embed_batches(embedder, dim, batch)
    open_, kept = chunks, None
    if stored is not None:
        have = stored.where("embedding IS NOT NULL").select(*key, F.xxhash64("text").alias("_same"), "embedding")
        marked = chunks.withColumn("_same", F.xxhash64("text"))
        kept = marked.join(have, [*key, "_same"]).select(*chunks.columns, "embedding", F.lit(None).cast("string").alias("embed_error"))
        open_ = marked.join(have.select(*key, "_same"), [*key, "_same"], "left_anti").select(*chunks.columns)
    new = open_.withColumn("_e", ask(t.embedding_input(F.col("section_path"), F.col("text")))).select(*chunks.columns, F.col("_e.vector").alias("embedding"), F.col("_e.error").alias("embed_error"))
    return new if kept is None else kept.unionByName(new)


def document_status(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with status and error from their pages and (stored) chunks; problems are rows, not exceptions.

    Chunks that carry ``embed_error`` make their document fail with it; without vectors a
    document is ready when its chunks are right. Chunks and pages are read once: both are
    brought together by document and checked there, as ``check_offsets`` does.
    """
    placed = pages if "char_offset" in pages.columns else with_offsets(pages)
    page = F.struct("page_number", "char_offset", "text", F.coalesce(F.char_length("text") + 1, F.lit(0)).alias("size"))
    whole = placed.groupBy(DOC).agg(F.count(F.lit(1)).alias("page_count"), F.array_sort(F.collect_list(page)).alias("_pages"))
    whole = whole.select(DOC, "page_count", F.array_join(F.col("_pages")["text"], "\n").alias("_text"), F.transform("_pages", lambda p: p.dropFields("text")).alias("_pages"))
    counted = [F.count(F.lit(1)).alias("n_chunks"), F.collect_list(F.struct("char_start", "char_end", "text")).alias("_chunks")]
    embedded = "embedding" in chunks.columns
    if embedded:
        counted += [F.count("embedding").alias("n_vectors"), F.collect_set("embed_error").alias("_errors")]
    both = whole.join(chunks.groupBy(DOC).agg(*counted), DOC, "left")
    # Offsets are right when each page begins where those before it end.
    walk = F.aggregate("_pages", F.struct(F.lit(0).cast("long").alias("at"), F.lit(False).alias("wrong")), lambda s, p: F.struct((s["at"] + p["size"]).alias("at"), (s["wrong"] | F.coalesce(p["char_offset"] != s["at"], F.lit(False))).alias("wrong")))
    torn = F.exists("_chunks", lambda c: F.coalesce(F.substring(F.col("_text"), c["char_start"] + 1, c["char_end"] - c["char_start"]) != c["text"], F.lit(False)))
    blank = t.strip(F.col("_text")) == ""
    found = F.array(F.when(walk["wrong"], "page offset"), F.when(torn, "chunk slice"), F.when(blank, "no text"), F.when(~blank & F.col("n_chunks").isNull(), "no chunks"))
    if embedded:
        found = F.concat(found, F.coalesce("_errors", F.array().cast("array<string>")))
    known = both.withColumn("_found", F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull()))))
    status = F.when(F.size("_found") == 0, "ready").otherwise("failed")
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_chunks", "n_vectors") if c in known.columns]
    error = F.when(F.size("_found") > 0, F.substring(F.array_join("_found", "; "), 1, 2000))
    return known.select(DOC, "page_count", *numbers, status.alias("status"), error.alias("error"))


def ingest(pages: DataFrame, target: int = DEFAULTS.chunk_target_tokens, most: int = DEFAULTS.chunk_max_tokens, *, embedder: Embedder | None = None, stored: DataFrame | None = None, dim: int = DEFAULTS.embed_dim, batch: int = DEFAULTS.embed_batch) -> tuple[DataFrame, DataFrame]:
    """(documents with status and error, chunks).

    With an ``embedder`` (texts of a batch to vectors) chunks carry vectors; those of ``stored``
    are taken over. Both results are lazy: a job that writes them writes the chunks first and
    takes ``document_status`` of what it wrote, so that nothing is embedded twice.
    """
    placed = with_offsets(pages)
    chunks = chunk_documents(placed, target, most)
    if embedder is not None:
        chunks = embed_chunks(chunks, embedder, dim=dim, batch=batch, stored=stored)
    return document_status(placed, chunks), chunks
