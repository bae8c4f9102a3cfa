import difflib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from lexspan.functions import helpers
from lexspan.functions.helpers import _closest
from lexspan.operators.verify import verify_quotes


def plain(haystack, needle, threshold):
    """All windows of all widths in one list; the best by ratio, then by width as listed, then by place."""
    n = len(needle)
    if n < 8 or 2 * len(haystack) < n - n % 2:
        return None
    widths = [n, int(n * 0.9), int(n * 1.1)]
    windows = [(w, s) for w in widths for s in range(0, len(haystack), max(1, n // 12)) if s + w <= len(haystack)]
    rated = [(difflib.SequenceMatcher(None, haystack[s : s + w], needle, autojunk=False).ratio(), -widths.index(w), -s, w) for w, s in windows]
    ratio, _, place, width = max(rated, default=(0.0, 0, 0, 0))
    return (-place, width - place, ratio) if rated and ratio >= threshold else None


def test_closest_window_is_the_plain_search():
    rng = np.random.default_rng(0)
    words = ["the", "supplier", "shall", "pay", "fees", "within", "days", "notice", "of"]
    for _ in range(60):
        hay = " ".join(rng.choice(words, rng.integers(3, 40)))
        at = rng.integers(0, max(1, len(hay) - 20))
        needle = list(hay[at : at + rng.integers(5, 40)])
        for _ in range(rng.integers(0, 3)):
            needle[rng.integers(len(needle))] = "~"
        needle = "".join(needle)
        assert _closest(hay, needle, 0.8) == plain(hay, needle, 0.8)


def test_dates_are_read_alike_with_and_without_python(spark):
    """Built-in functions and the parser agree on every text that the former take."""
    rng = np.random.default_rng(3)
    months = [*helpers.MONTHS, "Jan", "SEPT", "Dec", "May"]
    before = ["", "signed on ", "may be due on ", "Effective Date: ", "on Monday, ", "(", "a lease of ", "v.", "between A and B, at ", "1 copy, ", "T "]
    after = ["", ".", ", as amended", " at noon", " (the Date)", " 10 pm", " h", "/", "-", " or May", " s 4", "é", ", 5"]
    texts = [None, "", "no date", "in 2020", "5 March", "March 2020", "31 April 2020", "31st of December 1999", "1/2/2020 and 3/4/2021", "5 March 2020 and 6 March 2020", "٣ March"]
    for _ in range(1500):
        day, year, month = int(rng.integers(0, 34)), int(rng.integers(1000, 3000)), str(rng.choice(months))
        th = str(rng.choice(["", "th", "st"]))
        core = [f"{day}{th} {month} {year}", f"{month} {day}{th}, {year}", f"{day}/{int(rng.integers(0, 14))}/{year}", f"{day:02d}{th} of {month}, {year}", f"{day}-{month}-{year}"][rng.integers(5)]
        texts.append(str(rng.choice(before)) + core + str(rng.choice(after)))
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, s string").repartition(1)
    sure, value = helpers.plain_date(F.col("s"))
    got = rows.select("s", sure.alias("sure"), value.alias("value"), helpers._fuzzy_date("2000-01-01")(F.col("s")).alias("right"), helpers.parse_written_date()(F.col("s")).alias("read")).collect()
    assert sum(r.sure for r in got) > 100
    assert [r for r in got if r.sure and r.value != r.right] == []
    assert [r for r in got if r.read != r.right] == []


def test_plain_texts_are_searched_as_they_are(spark):
    rng = np.random.default_rng(4)
    bits = ["a", "b.", "(c)", "\\E", "$1", "^", " ", "  ", "\n", "\t\x1c", "x+", "é", "“q”", "ﬁ"]
    pairs = [("".join(rng.choice(bits, rng.integers(0, 12))), "".join(rng.choice(bits, rng.integers(1, 4)))) for _ in range(600)] + [(None, "a"), ("", "b")]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, s string, q string").repartition(2)
    got = rows.select("i", helpers.normalized(F.col("s")).alias("n"), helpers.place_in_plain(F.col("s"), helpers.normalized(F.col("q"))).alias("p")).collect()
    for r in got:
        text, places = helpers._normalised(pairs[r.i][0] or "")
        needle = helpers._normalised(pairs[r.i][1])[0]
        assert r.n == text, pairs[r.i]
        if needle and (pairs[r.i][0] or "").isascii() and needle.isascii():
            at = text.find(needle)
            want = (int(places[at]), int(places[at + len(needle) - 1]) + 1) if at >= 0 else None
            assert (tuple(r.p) if r.p else None) == want, pairs[r.i]


def test_quotes_in_both_kinds_of_texts(spark):
    texts = {1: "The  fee\nis due (net).\n\nIt renews.", 2: "The “fee” is due.\n\nNothing else – at all.", 3: None}
    documents = spark.createDataFrame(list(texts.items()), "document_id long, text string")
    chunks = spark.createDataFrame([(1, 0, 0, 22, texts[1][:22]), (1, 1, 24, 34, texts[1][24:]), (2, 0, 0, 17, texts[2][:17]), (2, 1, 19, 42, texts[2][19:]), (3, 0, 0, 0, None)], "document_id long, ordinal int, char_start int, char_end int, text string")
    quotes = [("a", 1, 0, "fee is due (net)."), ("b", 1, 0, "It  renews."), ("c", 2, 0, '"fee" is due'), ("d", 2, 0, "else - at all"), ("e", 1, 0, "The fee is duo (net)."), ("f", 1, 0, "not there at all, never"), ("g", 3, 0, "none"), ("h", 1, None, "renews"), ("i", 1, 0, None), ("j", 1, 1, "renews.*")]
    found = verify_quotes(spark.createDataFrame(quotes, "quote_id string, document_id long, ordinal int, quote string"), chunks, documents)
    got = {r.quote_id: (r.match_kind, r.ordinal, texts[r.document_id][r.char_start : r.char_end]) for r in found.collect()}
    assert got == {"a": ("exact", 0, "fee\nis due (net)."), "b": ("relocated", 1, "It renews."), "c": ("exact", 0, "“fee” is due"), "d": ("relocated", 1, "else – at all"), "e": ("fuzzy", 0, "The  fee\nis due (net)."), "h": ("relocated", 1, "renews"), "j": ("fuzzy", 1, "renews.")}  # marks of patterns are letters like others


def test_word_places_and_pieces(spark, monkeypatch):
    """Places of words need no row a word; results leave a few at a time, whatever a batch holds."""
    texts = ["", " ", None, "ab  cd ", " é😀 x\n\ny", "z"] * 30
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string").coalesce(1)
    page = rows.select("i", "text", helpers.word_spans(F.col("text")).alias("w"))
    for r in page.select("*", helpers.cut_spans(F.col("text"), F.col("w")).alias("cut")).collect():
        assert r.cut == [x for x in (r.text or "").split(" ") if x]
    assert "Window" not in page._jdf.queryExecution().toString() and "Generate" not in page._jdf.queryExecution().toString()
    sizes = [len(b) for b in helpers._normalise_batches(iter([pa.array(["a  b"] * 200)]))]
    assert sum(sizes) == 200 and max(sizes) == helpers.PIECE
    called = helpers.embed_batches(helpers.hash_vectors(4), 4, 50).func(iter([pd.Series(["a"] * 120)]))
    assert [len(x) for x in called] == [50, 50, 20]
    vectors = rows.select(helpers.hash_embed(4)(F.col("text")).alias("v"), "text").collect()
    assert [list(r.v) for r in vectors] == [v.tolist() for v in helpers.hash_vectors(4)([r.text for r in vectors])]


def test_long_quotes_and_latin_letters_are_found_where_they_lie(spark):
    """A needle of thousands of words is no pattern of as many parts, and Latin letters need no map back to the source."""
    words = " ".join(f"wört{i}" for i in range(6000))
    text = "“Préface”  –\n\n" + words.replace(" ", "\n\n") + " end"
    rows = spark.createDataFrame([(text, words), (text, '"Préface" - wört0'), (text, "wört1 wört3")], "s string, q string")
    got = [r.p and (r.p.start, r.p.end) for r in rows.select(helpers.is_plain(F.col("s")).alias("plain"), helpers.place_in_plain(F.col("s"), F.col("q")).alias("p")).collect()]
    first = text.index("wört0")
    assert got == [(first, len(text) - 4), (0, first + 5), None]


def test_close_matches_compare_few_windows(monkeypatch):
    """One changed letter in a long page: most windows are ruled out before they are compared."""
    rng = np.random.default_rng(5)
    page = " ".join(rng.choice(["the", "supplier", "shall", "pay", "fees", "within", "days", "of", "notice", "term"], 400))
    needle = page[900:910] + "~" + page[911:1060]
    calls, common = [], helpers._common
    monkeypatch.setattr(helpers, "_common", lambda *a: calls.append(1) or common(*a))
    assert _closest(page, needle, 0.9) == plain(page, needle, 0.9)
    assert len(calls) <= 20


def test_matched_letters_are_those_of_the_blocks():
    rng = np.random.default_rng(6)
    for _ in range(300):
        a = "".join(rng.choice(list("abc d"), rng.integers(0, 60)))
        b = list(a) if rng.random() < 0.7 else list("abcd" * 9)
        for _ in range(min(len(b), 3)):
            b[rng.integers(len(b))] = "~"
        blocks = difflib.SequenceMatcher(None, a, "".join(b), autojunk=False)
        assert helpers._matched(a, "".join(b)) == sum(m.size for m in blocks.get_matching_blocks())
        longest = blocks.find_longest_match()
        assert helpers._longest(a, "".join(b))[2] == longest.size


def test_documents_are_split_into_pages_where_they_lie(spark, tmp_path):
    from lexspan.operators.ingest import assemble_text
    from lexspan.plans import adapters

    texts = ["", None, "a\n\nb", "\n" * 12, "\n".join(f"é{i}" * (i % 3) for i in range(23)), "one"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    split, whole = adapters.split_pages(spark, str(tmp_path)), adapters.assembled(spark, str(tmp_path))
    columns = ["document_id", "page_number", "text", "char_offset"]
    assert sorted(map(tuple, split.select(*columns).collect())) == sorted(map(tuple, adapters.pages(spark, str(tmp_path)).select(*columns).collect()))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, assemble_text(adapters.pages(spark, str(tmp_path))).collect()))
    assert "Exchange" not in split._jdf.queryExecution().toString()
