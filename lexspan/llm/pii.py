"""Personal data: fixed patterns, and bootstrapped contextual extraction around them.

Only DataFrame functions are used. Spans come from splitting a text at a pattern: the
pieces between the matches and the matches themselves, in turn, give every position.

*Base.* The matches of the four patterns that pass their check.

*Bootstrap.* A candidate is a token with a digit, an at sign or an opening bracket and an
identifier's rough shape, or a run of digit groups with spaces between them that has the
shape of a phone or card number. Its context is the two words before it. Base spans,
whatever tokens they cover, are the seeds, each in the context before its own start;
candidates that touch one are no instances of their own.
Contexts and instances form a graph of which Spark scores both sides in turn: a context's
score for a kind is the mean score of its distinct instances, held down where they are few;
it counts once the context has ``FEWEST`` instances that are seeds or reach ``CONFIDENT`` in
an earlier round, so found instances make further contexts. An instance's score is that of its best context. After
``ROUNDS`` rounds the contexts of at least ``CONFIDENT`` pull in those candidates of theirs
that no base span touches and that have the kind's rough shape. Every count is combined
before it is shuffled, so a frequent context is no hot spot.

Defined results: null text counts as empty and has no spans; an empty table gives an empty table. Repeated rows get equal
results and count once as an instance. Extra columns are ignored. The possessive
quantifiers match what the greedy ones of the contract match, without recursion, and the
heads let a match begin only where a run of its first class begins or the last match
ended, so long runs take linear time; the matches are the same. Many matches in one text are
placed block by block; contexts are read as far back as their two words stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan.llm.shared import staged

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for the pattern to be tried.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
CANDIDATE = r"(?<!\S)[^\s0-9@(\[{]*+[0-9@(\[{]\S*+"
#: Rough shapes of identifiers that the fixed patterns miss, by kind.
SHAPES = {
    "email": r"(?i)^[a-z0-9._%+-]++(?:@|\(at\)|\[at\]|\{at\})[a-z0-9-]++(?:(?:\.|\(dot\)|\[dot\]|\{dot\})[a-z0-9-]++)*+$",
    "ip": r"^[0-9a-fA-F]*:[0-9a-fA-F:]+:[0-9a-fA-F]*$",
    "card": r"^[0-9](?:(?:[./_\x20-]|\x20-\x20)?[0-9]){13,18}$",
    "phone": r"^\(?[0-9](?:(?:[().-]|\)?[\x20-]\(?|\x20-\x20)?[0-9]){6,14}$",
}
#: Marks before and after a token, which do not belong to it.
LEAD = r"[\"'<\[,;:]"
TRAIL = r"(?<![\"'>\],;:.!?])[\"'>\],;:.!?]++$"
EDGE = r"(?=[\"'>\],;:.!?)]*+(?:\s|\z))"
#: Where digit groups with spaces between them begin: marks and the first character.
RUN = rf"(?<!\S){LEAD}*+(?=[0-9()./_-]++\x20)(?=\(?[0-9](?:(?:[()./_-]|\)?[\x20-]\(?|\x20-\x20)?[0-9]){{6,18}}{EDGE})[(0-9]"
#: The longest run of such groups, by kind; a first group that is long enough alone is a token's matter.
RUNS = {
    kind: rf"^(?=(?:[^\s0-9]*[0-9]){{1,{most}}}[^\s0-9]*\x20)" + SHAPES[kind].strip("^$") + EDGE
    for kind, most in (("card", 13), ("phone", 6))
}
ROUNDS = 3
CONFIDENT = 0.6
FEWEST = 3
SPAN = "array<struct<start:int,end:int,kind:string,value:string>>"


#: Bits of the table that keeps documents without a span out of a shuffle.
FILTER_BITS = 23
#: Elements that one pass copies from step to step; longer arrays are cut into blocks of so many.
BLOCK = 64
FOUND = "array<struct<start:int,end:int,value:string>>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _blocks(values: Column) -> Column:
    last = F.greatest(F.floor((F.size(values) - 1) / BLOCK).cast("int"), F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(values, i * BLOCK + 1, F.lit(BLOCK)))


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of the pattern's matches; code points, end exclusive.

    Positions are sums over the pieces before; they are formed block by block, so that many
    matches in one text cost little more than their number.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # Each piece with its gap, its size and itself; the text after the last match is no piece.
    parts = _let(values, lambda v: F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(v)), v, lambda g, x: F.struct(F.char_length(g).alias("gap"), F.char_length(x).alias("size"), x.alias("value"))))
    none = F.array().cast(FOUND)

    def place(pieces, begin):
        def step(state, p):
            start = state["at"] + p["gap"]
            span = F.struct(start.alias("start"), (start + p["size"]).alias("end"), p["value"].alias("value"))
            return F.struct((start + p["size"]).alias("at"), F.concat(state["found"], F.array(span)).alias("found"))

        return F.aggregate(pieces, F.struct(begin.alias("at"), none.alias("found")), step, lambda state: state["found"])

    def by_block(blocks):
        def on(begins, block):
            return F.concat(begins, F.array(F.element_at(begins, -1) + F.aggregate(block, F.lit(0), lambda n, p: n + p["gap"] + p["size"])))

        begins = F.aggregate(blocks, F.array(F.lit(0)), on)
        return F.flatten(_let(begins, lambda at: F.zip_with(blocks, F.slice(at, F.lit(1), F.size(blocks)), place)))

    return _let(parts, lambda p: F.when(F.size(p) <= BLOCK, place(p, F.lit(0))).otherwise(_let(_blocks(p), by_block)))


def _luhn(digits: Column) -> Column:
    size = F.char_length(digits)

    def worth(i):
        value = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(value > 4, value * 2 - 9).otherwise(value * 2)
        return F.when((size - i) % 2 == 1, twice).otherwise(value)

    return F.aggregate(F.transform(F.sequence(F.lit(1), size), worth), F.lit(0), lambda a, b: a + b) % 10 == 0


def _byte_sized(part: Column) -> Column:
    short = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return F.when(F.char_length(short) <= 3, short.cast("int") <= 255).otherwise(False)


def _passes(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    size = F.char_length(digits)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), _byte_sized)
    if kind == "card":
        return F.when(size.between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return size.between(10, 15)
    return F.lit(True)


def _checked(kind: str, found: Column) -> Column:
    kept = F.filter(found, lambda s: _passes(kind, s["value"]))
    return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value")))


def base_spans(text: Column) -> Column:
    """All spans of the four patterns, by start, then kind as listed."""
    none = F.array().cast(SPAN)
    found = []
    for kind in KINDS:
        ranked = _checked(kind, matches(text, PATTERNS[kind]))
        may = text.contains(NEEDS[kind]) if kind in NEEDS else text.rlike("[0-9][ -]?[0-9]")
        found.append(F.when(may, ranked.cast(SPAN)).otherwise(none))
    return in_order(F.concat(*found))


def in_order(spans: Column) -> Column:
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), rank[s["kind"]].alias("b"), s["end"].alias("c"), s["kind"].alias("d"), s["value"].alias("e")))
    return F.transform(F.array_sort(keyed), lambda k: F.struct(k["a"].alias("start"), k["c"].alias("end"), k["d"].alias("kind"), k["e"].alias("value")))


#: Code points of a page; a place is reached through its page instead of from the text's beginning.
PAGE = 2048
#: Letters before a place in which its context is looked for first (at most a page); each next try reads more, the last one all.
LOOKS = (80, 1280)


def _pages(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PAGE}}}"), F.lit(0))


def _cut(pages: Column, start: Column, size: Column) -> Column:
    """At most a page of code points from a place on."""
    first = F.floor(start / PAGE).cast("int")
    two = F.concat(F.coalesce(F.get(pages, first), F.lit("")), F.coalesce(F.get(pages, first + 1), F.lit("")))
    return F.substring(two, start - first * PAGE + 1, size)


def _context(text: Column, pages: Column, start: Column) -> Column:
    """The two words before a place, in lower case and without marks, however far back they stand."""

    def words(before):
        return F.filter(F.split(F.lower(before), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def last_two(found):
        return F.array_join(F.reverse(F.slice(F.reverse(found), 1, 2)), " ")

    context = last_two(words(F.substring(text, F.lit(1), start)))
    for look in reversed(LOOKS):
        near = words(_cut(pages, F.greatest(start - look, F.lit(0)), F.least(start, F.lit(look))))
        wider = context
        # With a third word in sight the last two are whole.
        context = _let(near, lambda w: F.when((start <= look) | (F.size(w) > 2), last_two(w)).otherwise(wider))  # noqa: B023
    return context


def seeds_of(text: Column) -> Column:
    """The base spans, each with its context."""
    return _let(_pages(text), lambda pages: F.transform(base_spans(text), lambda s: s.withField("context", _context(text, pages, s["start"]))))


def candidates(text: Column) -> Column:
    """Array of (start, end, value, whole, context) of tokens and digit runs that may be identifiers.

    ``whole`` is the longest reading from a place on; shorter ones are no instances beside it.
    Marks at a token's edges do not belong to it. Runs are taken from each group on, so they
    may overlap.
    """
    return _let(_pages(text), lambda pages: _candidates(text, pages))


def _candidates(text: Column, pages: Column) -> Column:
    def placed(s):
        return F.struct(s["start"].alias("start"), (s["start"] + F.char_length(s["value"])).alias("end"), s["value"].alias("value"), s["whole"].alias("whole"), _context(text, pages, s["start"]).alias("context"))

    def trimmed(s):
        core = F.regexp_replace(F.regexp_replace(s["value"], f"^{LEAD}+", ""), TRAIL, "")
        lead = F.char_length(s["value"]) - F.char_length(F.regexp_replace(s["value"], f"^{LEAD}+", ""))
        return F.struct((s["start"] + lead).alias("start"), core.alias("value"))

    def ahead(start):
        return _cut(pages, start, F.lit(100))  # a run has at most 19 digits and 3 characters between two

    def judged(s):
        longer = F.lit(False)
        for pattern in RUNS.values():
            longer = longer | ahead(s["start"]).rlike(pattern)
        return F.struct(s["start"].alias("start"), s["value"].alias("value"), (~longer).alias("whole"))

    def runs(s):
        start = s["end"] - 1
        read = F.array_distinct(F.array(*[F.regexp_extract(ahead(start), pattern, 0) for pattern in RUNS.values()]))
        return F.transform(read, lambda v: F.struct(start.alias("start"), v.alias("value"), (~F.exists(read, lambda o: F.char_length(o) > F.char_length(v))).alias("whole")))

    tokens = F.transform(F.filter(F.transform(matches(text, CANDIDATE), trimmed), lambda s: _any_shape(s["value"])), judged)
    spaced = F.when(text.rlike(RUN), F.flatten(F.transform(matches(text, RUN), runs))).otherwise(F.array().cast("array<struct<start:int,value:string,whole:boolean>>"))
    both = F.filter(F.concat(tokens, spaced), lambda s: s["value"] != "")
    return F.filter(F.transform(both, placed), lambda s: s["context"] != "")


def _any_shape(value: Column) -> Column:
    """Either a base match's shape or a rough one, of any length."""
    shape = F.lit(False)
    for pattern in (*PATTERNS.values(), *SHAPES.values()):
        shape = shape | value.rlike(pattern if pattern.startswith(("^", "(?i)^")) else f"^(?:{pattern})$")
    return shape


def _shaped(kind: Column, value: Column) -> Column:
    """Whether the value has the kind's rough shape."""
    shaped = F.lit(False)
    for name, pattern in SHAPES.items():
        shaped = shaped | ((kind == name) & value.rlike(pattern))
    return shaped


def _untouched(tokens: Column, spans: Column) -> Column:
    """The tokens that no span touches. Spans come in order, so most of their blocks are passed over at once."""
    bounds = F.transform(_blocks(spans), lambda b: F.struct(b.alias("b"), F.array_min(b["start"]).alias("low"), F.array_max(b["end"]).alias("high")))

    def touched(blocks, c):
        return F.exists(blocks, lambda k: (k["low"] < c["end"]) & (c["start"] < k["high"]) & F.exists(k["b"], lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"])))

    return _let(bounds, lambda blocks: F.filter(tokens, lambda c: ~touched(blocks, c)))


def _widest(spans: Column) -> Column:
    """The spans that lie in no other one of their kind."""

    def inside(a):
        return F.exists(spans, lambda b: (a["kind"] == b["kind"]) & (b["start"] <= a["start"]) & (a["end"] <= b["end"]) & (b["end"] - b["start"] > a["end"] - a["start"]))

    return F.filter(spans, lambda a: ~inside(a))


def context_scores(occurrences: DataFrame) -> DataFrame:
    """(context, kind, score) of contexts after ROUNDS rounds over the graph.

    ``occurrences`` are (context, value, kind), kind null where the base saw nothing.
    """
    edges = staged(occurrences.groupBy("context", "value").agg(F.max("kind").alias("seed")))
    members = edges.groupBy("context").agg(F.count(F.lit(1)).alias("members"))
    seeds = edges.where("seed IS NOT NULL").select("value", F.col("seed").alias("kind"), F.lit(1.0).alias("known")).distinct()
    instances = seeds
    for turn in range(ROUNDS):
        gained = edges.join(instances, "value").groupBy("context", "kind").agg(F.sum("known").alias("total"), F.count(F.when(F.col("known") >= CONFIDENT, 1)).alias("support"))
        scores = staged(gained.where(F.col("support") >= FEWEST).join(members, "context").select("context", "kind", (F.col("total") / (F.col("members") + 1)).alias("score")))
        if turn + 1 < ROUNDS:
            reached = edges.where("seed IS NULL").join(scores, "context").where(_shaped(F.col("kind"), F.col("value"))).select("value", "kind", F.col("score").alias("known"))
            instances = staged(seeds.union(reached).groupBy("value", "kind").agg(F.max("known").alias("known")))
    return scores


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, text_mark (hash of the text), base and all spans, one row per row of ``docs``."""
    text = F.coalesce("text", F.lit(""))
    slim = docs.select("doc_id", F.xxhash64(text).alias("text_mark"), seeds_of(text).alias("seeds"), candidates(text).alias("tokens"))
    slim = staged(slim)  # spans and candidates only: the texts are read once
    seeds = slim.select(F.explode("seeds").alias("s")).where("s.context != ''").select("s.context", "s.value", "s.kind")
    slim = slim.withColumn("base", F.transform("seeds", lambda s: s.dropFields("context"))).drop("seeds")
    seen = slim.select("doc_id", "text_mark", F.explode(_untouched(F.col("tokens"), F.col("base"))).alias("c"))
    slim = slim.drop("tokens")
    occurrences = seeds.union(seen.where("c.whole").select("c.context", "c.value", F.lit(None).cast("string").alias("kind")))
    best = context_scores(occurrences).where(F.col("score") >= CONFIDENT).groupBy("context").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
    fresh = (
        seen.select("doc_id", "text_mark", "c", F.col("c.context").alias("context"))
        .join(staged(best), "context")
        .where(_shaped(F.col("kind"), F.col("c.value")))
        .groupBy("doc_id", "text_mark")
        .agg(F.collect_set(F.struct(F.col("c.start").alias("start"), F.col("c.end").alias("end"), "kind", F.col("c.value").alias("value"))).alias("fresh"))
    )
    fresh = staged(fresh.withColumnsRenamed({"doc_id": "_id", "text_mark": "_mark"}))
    together = slim.join(fresh, slim["doc_id"].eqNullSafe(fresh["_id"]) & (slim["text_mark"] == fresh["_mark"]), "left")
    return together.select("doc_id", "text_mark", "base", in_order(F.concat("base", F.coalesce(_widest(F.col("fresh").cast(SPAN)), F.array().cast(SPAN)))).alias("spans"))


def written(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _with_filter(rows: DataFrame, found: DataFrame, doc_id: Column, mark: Column) -> DataFrame:
    """``rows`` with ``_maybe``: true for all whose text is among ``found``, false for nearly all others.

    The table of 2**FILTER_BITS bits is broadcast: 2 MB, whatever the input.
    """

    def slot(*key):
        return F.shiftrightunsigned(F.xxhash64(*key), 64 - FILTER_BITS)

    bits = found.select(slot("_id", "_mark").alias("_slot")).select((F.shiftright("_slot", 6)).alias("_word"), F.expr("shiftleft(1L, CAST(_slot & 63 AS INT))").alias("_bit"))
    words = staged(bits.groupBy("_word").agg(F.bit_or("_bit").alias("_bits")))
    placed = rows.withColumn("_slot", slot(doc_id, mark)).withColumn("_word", F.shiftright("_slot", 6)).join(F.broadcast(words), "_word", "left")
    return placed.withColumn("_maybe", F.coalesce(F.getbit("_bits", F.col("_slot").bitwiseAND(63)) == 1, F.lit(False)))


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with every found span replaced by its kind in brackets; n_chars follows the new text.

    All other columns stay as they are, whatever their names. Only documents that a fixed-size
    table of the found ones lets through meet their spans in a shuffle.
    """
    found = find_pii(docs).where(F.size("spans") > 0).select(F.col("doc_id").alias("_id"), F.col("text_mark").alias("_mark"), "spans").dropDuplicates(["_id", "_mark"])
    found = staged(found)
    text = F.coalesce("_row.text", F.lit(""))
    whole = _with_filter(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")), found, F.col("_row.doc_id"), F.xxhash64(text))
    untouched = whole.where("NOT _maybe").select("_row", F.lit(None).cast(found.schema["spans"].dataType).alias("spans"))
    joined = whole.where("_maybe").select("_row").join(found, F.col("_row.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_mark")), "left").select("_row", "spans").unionByName(untouched)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state, s):
        # Spans may overlap; the part that an earlier one has covered is not written again.
        gap = F.substring(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        label = F.when(s["start"] >= state["at"], F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["out"], gap, label).alias("out"))

    def close(state):
        return F.concat(state["out"], F.substring(text, state["at"] + 1, F.char_length(text)))

    new = F.when(F.col("spans").isNotNull(), F.aggregate("spans", start, step, close)).otherwise(F.col("_row.text"))
    size = F.when(F.col("spans").isNotNull(), F.char_length("_new")).otherwise(F.col("_row.n_chars")).cast("long") if "n_chars" in docs.columns else None
    fields = {"text": F.col("_new"), "n_chars": size}
    return joined.withColumn("_new", new).select(*[fields.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def _count(kind: str) -> Column:
    return F.size(F.filter(F.col("base")["kind"], lambda k: k == kind)).cast("long")


def op8_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [_count(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
