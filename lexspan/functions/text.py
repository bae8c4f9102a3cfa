"""Text functions on columns. All are built-in expressions and stay in the JVM.

Offsets are 0-based, half-open and in code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English function words, which word search passes over; words of contracts (party, clause) are searched for.
FUNCTION_WORDS = (
    "a", "about", "above", "after", "again", "against", "all", "am", "an", "and", "any", "are", "as", "at",
    "be", "because", "been", "before", "being", "below", "between", "both", "but", "by", "can", "did", "do",
    "does", "doing", "down", "during", "each", "few", "for", "from", "further", "had", "has", "have",
    "having", "he", "her", "here", "hers", "him", "his", "how", "i", "if", "in", "into", "is", "it", "its",
    "just", "me", "more", "most", "my", "no", "nor", "not", "now", "of", "off", "on", "once", "only", "or",
    "other", "our", "out", "over", "own", "same", "she", "should", "so", "some", "such", "than", "that",
    "the", "their", "them", "then", "there", "these", "they", "this", "those", "through", "to", "too",
    "under", "until", "up", "very", "was", "we", "were", "what", "when", "where", "which", "while", "who",
    "whom", "why", "will", "with", "you", "your",
)

# Words that carry no meaning in a question of a grid, and in one of the assistant; answer words, symbols,
# suffixes; how roman numbers, amounts and the headings of sections look.
STOP_WORDS = (
    "the", "a", "an", "of", "and", "or", "is", "are", "what", "which", "does", "do", "this", "that",
    "in", "to", "for", "any", "with", "be", "by", "on", "it", "its", "as", "at", "who", "how", "when",
    "there", "under", "agreement", "contract", "document", "party", "parties", "clause", "provision",
    "please", "state", "specify", "identify", "if", "has", "have",
)
ASSISTANT_STOP_WORDS = (
    "the", "a", "an", "of", "and", "or", "is", "are", "what", "which", "does", "do", "this", "that",
    "in", "to", "for", "any", "with", "be", "by", "on", "it", "its", "as", "at", "who", "how", "when",
    "there", "under", "agreement", "contract", "document", "documents", "clause", "please", "tell",
    "me", "about", "can", "you", "i", "we", "they", "he", "she", "from",
)
YES = ("yes", "true", "y", "affirmative")
NO = ("no", "false", "n", "negative", "none")
CURRENCY = {"£": "GBP", "$": "USD", "€": "EUR", "¥": "JPY"}
SUFFIXES = ("ies", "ing", "ment", "tion", "es", "ed", "s")
ROMAN = r"(?=[IVXLC])M*(?:C[MD]|D?C{0,3})(?:X[CL]|L?X{0,3})(?:I[XV]|V?I{0,3})"
MONEY = r"([£$€¥])?\s*([0-9][0-9,]*(?:\.[0-9]+)?)\s*((?i)GBP|USD|EUR|AUD|CAD|CHF|JPY)?"
ARTICLE = rf"^\s*(?:ARTICLE|Article|SECTION|Section|PART|Part)\s+(?:{ROMAN}|\d+)\b[.:\-\s]*(.*)$"
DECIMAL = r"^\s*(\d+(?:\.\d+)*)(\.)?\s+(\S.*)$"
BARE_DECIMAL = r"^\s*(\d+(?:\.\d+)+)\s*$"
LETTER = r"^\s*\(([a-z])\)\s+(\S.*)$"
ROMAN_LETTER = rf"(?i)^\s*\(({ROMAN.lower()})\)\s+(\S.*)$"
CAPITALS = r"^[A-Z][A-Z0-9 ,&'\-/()]{3,80}$"
MAX_LABEL = 72

VALUE = "struct<bool_value:boolean,date_value:date,amount:double,currency:string,text_value:string>"


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up, at least 1."""
    return F.greatest(F.lit(1), F.floor((F.char_length(text) + 3) / 4)).cast("int")


def collapse_ws(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def embedding_input(path: Column, text: Column) -> Column:
    return F.when(F.coalesce(path, F.lit("")) != "", F.concat(path, F.lit("\n"), text)).otherwise(text)


def stem(word: Column) -> Column:
    """One suffix off where at least four letters remain; ``ies`` becomes ``y``."""
    out = word
    for suffix in reversed(SUFFIXES):
        fits = word.endswith(suffix) & (F.char_length(word) - len(suffix) >= 4)
        cut = F.substring(word, F.lit(1), F.char_length(word) - len(suffix))
        out = F.when(fits, F.concat(cut, F.lit("y")) if suffix == "ies" else cut).otherwise(out)
    return out


def keywords(text: Column, stemmed: bool = True) -> Column:
    """Distinct meaningful words in lower case, sorted; without stems, those that the assistant's search looks at."""
    pattern, stops = ("[a-z0-9£$€%]+", STOP_WORDS) if stemmed else ("[a-z0-9]+", ASSISTANT_STOP_WORDS)
    words = F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))
    kept = F.filter(words, lambda w: (F.char_length(w) > 2) & ~w.isin(*stops))
    return F.array_sort(F.array_distinct(F.transform(kept, stem) if stemmed else kept))


def lexical_terms(question: Column) -> Column:
    """Distinct question words, sorted."""
    words = F.regexp_extract_all(question, F.lit("[A-Za-z0-9][A-Za-z0-9'-]+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(F.filter(words, lambda w: F.char_length(w) > 2), F.lower)))


def lexical_query(question: Column) -> Column:
    """The words joined by OR; the whole question if it has none."""
    terms = lexical_terms(question)
    return F.when(F.size(terms) > 0, F.array_join(terms, " OR ")).otherwise(question)


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.;:!?])\s+")


def parse_boolean(text: Column) -> Column:
    head = F.element_at(F.split(F.regexp_replace(F.lower(text), r"\.+$", ""), " "), 1)
    return F.when(head.isin(*YES), True).when(head.isin(*NO), False)


def parse_amount(text: Column) -> Column:
    """The first number anywhere, thousands separators dropped."""
    digits = F.regexp_replace(F.regexp_extract(text, MONEY, 2), ",", "")
    return F.when(digits != "", digits.cast("double"))


def parse_currency(text: Column) -> Column:
    code, sign = F.upper(F.regexp_extract(text, MONEY, 3)), F.regexp_extract(text, MONEY, 1)
    of_sign = F.lit(None).cast("string")
    for symbol, name in CURRENCY.items():
        of_sign = F.when(sign == symbol, name).otherwise(of_sign)
    return F.when(code != "", code).otherwise(of_sign)


def parse_enum(text: Column, options: Column) -> Column:
    """The first option that equals the text but for case, else the first inside it."""
    low = F.lower(text)
    equal = F.filter(options, lambda o: F.lower(o) == low)
    inside = F.filter(options, lambda o: F.contains(low, F.lower(o)))
    return F.when(F.size(equal) > 0, F.get(equal, F.lit(0))).when(F.size(inside) > 0, F.get(inside, F.lit(0)))


def parse_iso_date(text: Column) -> Column:
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), text.try_cast("date"))


def typed_value(text: Column, output_type: Column, options: Column, written_date: Column | None = None) -> Column:
    """The union value: at most one branch is set, none if the text does not fit its type.

    ``written_date`` supplies dates in words (from the helper); ISO dates need none.
    """
    day = F.coalesce(parse_iso_date(text), written_date) if written_date is not None else parse_iso_date(text)
    known = text != ""
    return F.struct(
        F.when(known & (output_type == "boolean"), parse_boolean(text)).alias("bool_value"),
        F.when(known & (output_type == "date"), day).alias("date_value"),
        F.when(known & (output_type == "money"), parse_amount(text)).alias("amount"),
        F.when(known & (output_type == "money") & parse_amount(text).isNotNull(), parse_currency(text)).alias("currency"),
        F.when(known & (output_type == "enum"), parse_enum(text, options)).when(known & (output_type == "text"), text).alias("text_value"),
    )


def value_text(text: Column, output_type: Column, typed: Column) -> Column:
    """What a grid shows for a typed value; the text itself where it does not fit."""
    return (
        F.when((output_type == "boolean") & typed["bool_value"].isNotNull(), F.when(typed["bool_value"], "Yes").otherwise("No"))
        .when((output_type == "date") & typed["date_value"].isNotNull(), typed["date_value"].cast("string"))
        .when((output_type == "enum") & typed["text_value"].isNotNull(), typed["text_value"])
        .otherwise(text)
    )


def cache_key(sha: Column, question: Column, output_type: Column, options: Column, model: Column, version: Column) -> Column:
    """SHA-256 of the canonical form: fields joined by unit separators, options sorted."""
    separator = "\x1f"
    fields = sha, collapse_ws(question), output_type, F.array_join(F.array_sort(F.coalesce(options, F.array().cast("array<string>"))), "\x1e"), model, version
    joined = F.concat_ws(separator, *[F.coalesce(f, F.lit("\x00")) for f in fields])  # a null field keeps its place
    return F.sha2(joined, 256)


def display_value(status: Column, text: Column, not_found: Column, verified: Column) -> Column:
    return (
        F.when(status.isNull(), "")
        .when(status != "done", F.concat(F.lit("["), status, F.lit("]")))
        .when(not_found, "Not found")
        .when(~verified, F.concat(F.coalesce(text, F.lit("")), F.lit(" [UNVERIFIED]")))
        .otherwise(F.coalesce(text, F.lit("")))
    )


def strip_markers(text: Column, dropped: Column) -> Column:
    """``text`` without the citation marks of ``dropped`` (an array of integers)."""
    pattern = F.concat(F.lit(r"\s?\[(?:"), F.array_join(F.transform(dropped, lambda d: d.cast("string")), "|"), F.lit(r")\]"))
    return F.when(F.size(dropped) > 0, F.regexp_replace(text, pattern, F.lit(""))).otherwise(text)


def _label(number: Column, title: Column) -> Column:
    flat = collapse_ws(title)
    cut = F.when(F.char_length(flat) > MAX_LABEL, F.concat(F.rtrim(F.substring(flat, 1, MAX_LABEL - 1)), F.lit("…"))).otherwise(flat)
    return F.when(flat == "", number).otherwise(F.trim(F.concat(number, F.lit(" "), cut)))


def _title_case(text: Column) -> Column:
    """Every run of letters with a capital first letter."""
    pieces = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]+|[^a-z]+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.char_length(p)))), "")


def detect_marker(block: Column) -> Column:
    """struct(depth, label) of a block that begins with a heading or clause number, else null."""
    whole = strip(block)
    line = F.element_at(F.split(whole, "\n"), 1)
    article, decimal, bare, alpha, roman, capitals = ARTICLE, DECIMAL, BARE_DECIMAL, LETTER, ROMAN_LETTER, CAPITALS
    number, title = F.regexp_extract(line, decimal, 1), F.regexp_extract(line, decimal, 3)
    levels = F.char_length(number) - F.char_length(F.replace(number, F.lit("."))) + 1
    dotted = F.regexp_extract(line, decimal, 2) != ""
    only = F.regexp_extract(line, bare, 1)
    rest = F.regexp_extract(line, article, 1)
    head = F.substring(line, F.lit(1), F.char_length(line) - F.char_length(rest))
    mark = lambda depth, label: F.struct(depth.cast("int").alias("depth"), label.alias("label"))
    return (
        F.when(line.rlike(article), mark(F.lit(0), _label(F.trim(F.regexp_replace(F.trim(head), r"[.:\-]+$", "")), rest)))
        .when(line.rlike(bare), mark(F.least(F.char_length(only) - F.char_length(F.replace(only, F.lit("."))) + 1, F.lit(4)), only))
        .when(
            line.rlike(decimal),
            F.when(
                (levels > 1) | (dotted & (F.char_length(title) <= 120)),
                mark(F.least(levels, F.lit(4)), _label(F.when(levels == 1, F.concat(number, F.lit("."))).otherwise(number), F.when(levels <= 2, title).otherwise(""))),
            ),
        )
        .when(line.rlike(alpha), mark(F.lit(3), F.concat(F.lit("("), F.regexp_extract(line, alpha, 1), F.lit(")"))))
        .when(line.rlike(roman), mark(F.lit(4), F.concat(F.lit("("), F.lower(F.regexp_extract(line, roman, 1)), F.lit(")"))))
        .when(line.rlike(capitals) & (F.char_length(whole) == F.char_length(line)), mark(F.lit(0), _label(F.lit(""), _title_case(line))))
    )
