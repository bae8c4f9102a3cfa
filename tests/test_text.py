from pyspark.sql import functions as F

from lexspan.functions import text as t


def one(spark, expression, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) and (not v or isinstance(v[0], str)) else 'array<int>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return frame.select(expression.alias("x")).first()["x"]


def test_markers(spark):
    cases = [("ARTICLE IV RISK", 0), ("Article 4 Risk Allocation", 0), ("SECTION 2 DATA PROTECTION", 0), ("8. Indemnities", 1), ("8.2 Supplier shall indemnify", 2), ("8.2.1 Notice of claims", 3), ("(a) is or becomes public", 3), ("(iv) any Affiliate", 4), ("DEFINITIONS AND INTERPRETATION", 0), ("8.2", 2)]
    cases += [("30 days after the Effective Date, the", None), ("2 million pounds sterling shall", None), ("", None), ("IN WITNESS WHEREOF the parties have", None), ("A plain sentence.", None)]
    rows = spark.createDataFrame(list(enumerate(c[0] for c in cases)), "i int, s string").select("i", t.detect_marker(F.col("s")).alias("m")).orderBy("i").collect()
    assert [r.m.depth if r.m else None for r in rows] == [c[1] for c in cases]
    assert rows[8].m.label == "Definitions And Interpretation" and rows[5].m.label == "8.2.1" and rows[0].m.label == "ARTICLE IV RISK"


def test_values(spark):
    boolean = {"yes": True, "Yes.": True, "No — the agreement is silent": False, "unclear": None, "...": None}
    for s, want in boolean.items():
        assert one(spark, t.parse_boolean(F.col("s")), s=s) is want
    assert one(spark, F.struct(t.parse_amount(F.col("s")), t.parse_currency(F.col("s"))), s="£48,000 per annum") == (48000.0, "GBP")
    assert one(spark, F.struct(t.parse_amount(F.col("s")), t.parse_currency(F.col("s"))), s="125% of the Fees") == (125.0, None)
    options = ["England and Wales", "New York", "Other"]
    for s, want in {"new york": "New York", "the laws of England and Wales": "England and Wales", "Scotland": None}.items():
        assert one(spark, t.parse_enum(F.col("s"), F.col("o")), s=s, o=options) == want
    assert one(spark, t.collapse_ws(F.col("s")), s="  three   (3)\nyears ") == "three (3) years"
    assert one(spark, t.strip_markers(F.col("s"), F.col("d")), s="A [1]. B [2]. C [3].", d=[2]) == "A [1]. B. C [3]."
    assert one(spark, t.strip_markers(F.col("s"), F.col("d")), s="A [1].", d=[]) == "A [1]."
    assert one(spark, t.keywords(F.col("s")), s="The Supplier indemnifies and pays 10%") == ["10%", "indemnify", "pays", "supplier"]
    assert one(spark, t.lexical_query(F.col("s")), s="is it?") == "is it?"
