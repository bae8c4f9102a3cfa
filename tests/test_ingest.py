from pyspark.sql import functions as F

from lexspan.functions.helpers import _normalised
from lexspan.operators import ingest as i

SECTIONS = ["ARTICLE IV RISK", "8. Indemnities", "8.2 Supplier shall indemnify. The Customer may claim; it must notify.", "(a) notice", "9. Limitation of Liability", "Text under nine. More text here.", "ARTICLE V GENERAL", "Closing words. " * 30]


def pages_of(spark, blocks, per_page=3):
    rows = [("d", n + 1, "\n\n".join(blocks[k : k + per_page])) for n, k in enumerate(range(0, len(blocks), per_page))]
    return i.with_offsets(spark.createDataFrame(rows, "document_id string, page_number int, text string"))


def test_paths(spark):
    rows = i.section_paths(i.blocks_from_pages(pages_of(spark, SECTIONS))).orderBy("char_start").collect()
    paths = [r.section_path for r in rows]
    assert paths[3] == "ARTICLE IV RISK > 8. Indemnities > 8.2 Supplier shall indemnify. The Customer may claim; it must notify. > (a)"
    assert paths[4] == paths[5] == "ARTICLE IV RISK > 9. Limitation of Liability" and paths[6] == "ARTICLE V GENERAL"


def test_chunk_invariants(spark):
    pages = pages_of(spark, SECTIONS * 6)
    whole = i.assemble_text(pages).first()["text"]
    for target, most in ((800, 1500), (200, 400), (60, 120)):
        chunks = sorted(i.chunk_documents(pages, target, most).collect(), key=lambda c: c.ordinal)
        assert [c.ordinal for c in chunks] == list(range(len(chunks)))
        covered = set()
        for a, b in zip(chunks, chunks[1:], strict=False):
            assert a.char_start <= b.char_start and a.char_end < b.char_end  # a one-sentence chunk is reached back over whole
        for c in chunks:
            assert whole[c.char_start : c.char_end] == c.text and c.token_count <= most and c.page_start <= c.page_end
            covered |= set(range(c.char_start, c.char_end))
        solid = [k for k, ch in enumerate(whole) if not ch.isspace()]
        assert sum(k in covered for k in solid) >= 0.98 * len(solid)
    assert i.check_offsets(pages, i.chunk_documents(pages)).count() == 0


def test_words_paragraphs_boxes(spark):
    words = spark.createDataFrame([("d", 1, 0, 0, 0, "Hello", 0.0, 0.0, 1.0, 1.0), ("d", 1, 0, 0, 1, "wörld", 1.0, 0.0, 2.0, 1.0), ("d", 1, 0, 1, 0, " ", 0.0, 0.0, 0.0, 0.0), ("d", 1, 0, 1, 1, "next", 0.0, 1.0, 1.0, 2.0), ("d", 1, 1, 0, 0, "block", 0.0, 2.0, 1.0, 3.0)], "document_id string, page_number int, block_no int, line_no int, word_no int, token string, x0 double, y0 double, x1 double, y1 double")
    page = i.pages_from_words(words).first()
    assert page.text == "Hello wörld\nnext\n\nblock"
    assert [page.text[w.start : w.end] for w in page.words] == ["Hello", "wörld", "next", "block"]
    spans = spark.createDataFrame([("d", 1, 6, 12)], "document_id string, span_id int, char_start int, char_end int")
    assert i.bboxes_for_span(spans, i.with_offsets(i.pages_from_words(words))).first().bboxes == {1: [[1.0, 0.0, 2.0, 1.0]]}
    assert i.flag_scanned(words).first().is_ocr
    paragraphs = spark.createDataFrame([("d", 1, "p", "One", None), ("d", 2, "tr", None, ["a", "b"]), ("d", 3, "p", " ", None)], "document_id string, position int, kind string, text string, cells array<string>")
    assert i.page_from_paragraphs(paragraphs).first().text == "One\n\na | b"


def test_normalised():
    text = "Supplier  shall\n indemnify “Customer” ﬁrst."
    out, places = _normalised(text)
    assert out == 'Supplier shall indemnify "Customer" first.'
    assert text[places[out.index("indemnify")] :].startswith("indemnify") and text[places[out.index("irst") + 1] :].startswith("rst")
    assert F is not None


def test_documents_packed_together(spark, monkeypatch):
    """Documents share batches, which must not show; status needs the chunks once."""
    one = pages_of(spark, SECTIONS * 6)
    many = one.crossJoin(spark.range(7).select(F.concat(F.lit("d"), "id").alias("n"))).select(F.col("n").alias("document_id"), "page_number", "text", "char_offset").coalesce(1)
    monkeypatch.setattr(i, "PACKED_BLOCKS", 100)
    held = ["ordinal", "char_start", "char_end", "section_path", "token_count", "text"]
    alone = [tuple(r) for r in i.chunk_documents(one, 60, 120).select(*held).orderBy("ordinal").collect()]
    together = i.chunk_documents(many, 60, 120).cache()
    for k in range(7):
        assert [tuple(r) for r in together.where(f"document_id = 'd{k}'").select(*held).orderBy("ordinal").collect()] == alone
    bad = together.withColumn("text", F.when(F.col("document_id") == "d1", "no slice").otherwise(F.col("text"))).where("document_id <> 'd2'")
    wrong = many.withColumn("char_offset", F.when(F.col("document_id") == "d3", F.col("char_offset") + 1).otherwise(F.col("char_offset")))
    got = {r.document_id: (r.status, r.error) for r in i.document_status(wrong, bad).collect()}
    assert got.pop("d1") == ("failed", "chunk slice") and got.pop("d2") == ("failed", "no chunks")
    assert got.pop("d3")[1] == "page offset" and set(got.values()) == {("ready", None)}
    read = spark.sparkContext.accumulator(0)
    counted = together.rdd.map(lambda r: (read.add(1), r)[1]).toDF(together.schema)
    assert len(i.document_status(many, counted).collect()) == 7 and read.value == together.count()
