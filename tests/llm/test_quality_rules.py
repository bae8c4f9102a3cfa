import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lexspan.llm.quality_rules import COUNTS, quality_verdicts, statistics

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    three = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_counts_against_brute_force(spark):
    rng = np.random.default_rng(3)
    bits = ["a", "b", "Über", "x#", "<p>", "\n", "\n\n", "\t", " ", "\x0b", "  ", "漢字", "😀", "$5", "\x1c"]
    texts = ["".join(b + (" " if rng.random() < 0.7 else "") for b in rng.choice(bits, rng.integers(0, 60))) for _ in range(300)]
    texts += [None, "", "\n", "one", "a b c a b c", "x\nx\nx", "x\nx ", "word " * 20000, "\n".join(["same line here"] * 70)]
    df = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, n_words int").repartition(3)
    got = {r.doc_id: tuple(r[c] for c in COUNTS) for r in statistics(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_verdicts(spark):
    rng = np.random.default_rng(4)
    vocab = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(2000)]
    good = [" ".join(rng.choice(vocab, rng.integers(60, 400))) + "." for _ in range(300)]
    bad = [" ".join(w + "###$$$" for w in rng.choice(vocab, rng.integers(60, 400))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(900, None), (901, "short"), (902, "a b c " * 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(360) if i % 3], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality_verdicts(docs, labels).collect()}
    assert len(out) == len(rows)
    assert sum(not out[i].kept for i in range(300)) <= 6
    assert sum(not out[i].kept for i in range(300, 360)) >= 50
    assert all(out[i].base_failed and not out[i].kept for i in (900, 901, 902))
    empty = quality_verdicts(docs.limit(0), labels.limit(0))
    assert empty.count() == 0


def test_every_labelled_row_counts(spark):
    """Good rows of a style of their own come last in the order by which 20 000 labelled rows once were drawn."""
    ids = spark.range(20_200).withColumnRenamed("id", "doc_id")
    odd = F.col("doc_id").isin(*[r.doc_id for r in ids.orderBy(F.xxhash64("doc_id", F.lit(0)).desc(), F.desc("doc_id")).limit(200).collect()])
    plain, marked = (" ".join(f"word{i}{end}" for i in range(60)) for end in ("", "#$"))
    tail = F.concat(F.lit(" "), F.repeat(F.lit("x"), (F.col("doc_id") % 50).cast("int")), F.repeat(F.lit("."), F.pmod(F.xxhash64("doc_id"), F.lit(7)).cast("int")))
    docs = ids.select("doc_id", F.concat(F.when(odd, marked).otherwise(plain), tail).alias("text"))
    verdicts = quality_verdicts(docs, ids.select("doc_id", F.lit(1).alias("quality")))
    assert verdicts.where("NOT kept").count() <= 0.005 * 20_200
