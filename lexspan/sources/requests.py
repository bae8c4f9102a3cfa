"""Requests to a model as JSON lines: reviews, playbooks and chats, each with its token estimate.

What does not change between requests stands first, what is asked stands last. A document
without passages gets no request. Null titles, sections and texts count as empty; a section
that is empty is not written.

Every request is one row. Its text is what the model reads at once, so it is bounded by the
model's context, which R5 keeps; nothing larger than one request is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The wording of the requests.
DOCUMENT = "# Document: "
OUTLINE = "## Outline"
PASSAGES = "## Passages"
QUESTIONS = "## Questions"
TYPE, OPTIONS = " | type: ", " | options: "
ASK_ALL = "Answer every question above by its label, with verbatim quotes and passage labels."
FIRM_PLAYBOOK = "# Firm playbook"
PLAYBOOK = "# Playbook: "
PREFERRED, FALLBACK, UNACCEPTABLE = "Preferred: ", "Fallback: ", "Unacceptable: "
ASK_FINDINGS = ("Produce exactly one finding per playbook rule, by rule label (", "), following the rules above.")
SELECTED = "# Passages from the selected documents"
ASK_CHAT = ("Question: ", "Answer from the passages above only, with numbered markers and verbatim quotes.")
CHAT_SECTION = "document: "
METHOD, URL = "POST", "/v1/responses"
# Tokens added to the estimates.
REVIEW_EXTRA, PLAYBOOK_EXTRA, CHAT_EXTRA = 500, 800, 400

BLANK = "\n\n"


def _or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _labelled(passages: DataFrame, *key: str) -> DataFrame:
    """Per key the passages in order under their labels, and how many letters their texts have."""
    section = F.when(_or_empty("section_path") != "", F.concat(F.lit(" ("), F.col("section_path"), F.lit(")"))).otherwise("")
    shown = F.concat(F.lit("["), "label", F.lit("]"), section, F.lit("\n"), _or_empty("text"))
    rows = passages.select(*key, F.struct("ordinal", "label", shown.alias("shown")).alias("_p"), F.char_length(_or_empty("text")).cast("long").alias("_n"))
    return rows.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list("_p"))["shown"], BLANK).alias("_shown"), F.sum("_n").alias("_letters"))


def document_parts(documents: DataFrame, passages: DataFrame, outlines: DataFrame | None = None) -> DataFrame:
    """document_id, ``part`` (title, outline, labelled passages) and letters of the passages.

    ``documents`` has document_id and title, ``passages`` document_id, ordinal, label,
    section_path and text, ``outlines`` document_id and the lines of its outline.
    """
    rows = documents.select("document_id", _or_empty("title").alias("_title")).join(_labelled(passages, "document_id"), "document_id")
    if outlines is None:
        rows = rows.withColumn("_lines", F.array().cast("array<string>"))
    else:
        rows = rows.join(outlines.select("document_id", F.col("lines").alias("_lines")), "document_id", "left")
    bullets = F.transform("_lines", lambda line: F.concat(F.lit("- "), line))
    outline = F.when(F.size("_lines") > 0, F.concat(F.lit(BLANK + OUTLINE + BLANK), F.array_join(bullets, BLANK))).otherwise("")
    return rows.select("document_id", F.concat(F.lit(DOCUMENT), "_title", outline, F.lit(BLANK + PASSAGES + BLANK), "_shown").alias("part"), F.col("_letters").alias("letters"))


def numbered(plan: DataFrame, run_id: str, *order: str) -> DataFrame:
    """The plan with a ``custom_id`` of the run, numbered from 0 without a gap.

    Requests are dealt over 4096 groups by the hash of the first column of ``order`` and
    numbered there; a group begins where those before it end. So no task numbers all rows, and
    the numbers are the same when a task is run again.
    """
    group = F.substring(F.md5(F.col(order[0]).cast("string")), 1, 3)
    rows = plan.withColumn("_group", group)
    sizes = rows.groupBy("_group").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1))  # at most 4096 rows
    begins = sizes.select("_group", F.coalesce(before, F.lit(0)).alias("_from"))
    place = F.row_number().over(Window.partitionBy("_group").orderBy(*order)) - 1 + F.col("_from")
    prefix = run_id.replace("-", "")[:12]
    return rows.join(F.broadcast(begins), "_group").withColumn("custom_id", F.format_string(f"{prefix}-%05d", place)).drop("_group", "_from")


def _message(role: Column | str, text: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), text.alias("content"))


def _line(custom_id: Column, model: str, messages: Column, metadata: Column) -> Column:
    body = F.struct(F.lit(model).alias("model"), messages.alias("input"), metadata.alias("metadata"))
    return F.to_json(F.struct(custom_id.alias("custom_id"), F.lit(METHOD).alias("method"), F.lit(URL).alias("url"), body.alias("body")))


def _meta(*names: str) -> Column:
    return F.struct(*[F.col(n).cast("string").alias(n) for n in names])


def _total(values: Column) -> Column:
    return F.aggregate(F.transform(values, lambda v: F.coalesce(F.char_length(v), F.lit(0)).cast("long")), F.lit(0).cast("long"), lambda s, n: s + n)


def _quarter(letters: Column) -> Column:
    return F.floor(letters / 4).cast("long")


def review_requests(plan: DataFrame, parts: DataFrame, run_id: str, system: str, *, model: str, playbook: str = "") -> DataFrame:
    """One request per row of ``plan``: system text, document, questions.

    ``plan`` has review_id, document_id, group_no and ``questions``, an array of (label,
    output_type, enum_options, question); ``parts`` come from ``document_parts``.
    """
    told = system + (BLANK + FIRM_PLAYBOOK + "\n" + playbook if playbook else "")

    def asked(q):
        options = F.when(F.size(q["enum_options"]) > 0, F.concat(F.lit(OPTIONS), F.array_join(q["enum_options"], ", "))).otherwise("")
        return F.concat(q["label"], F.lit(TYPE), q["output_type"], options, F.lit(" | "), F.coalesce(q["question"], F.lit("")))

    rows = numbered(plan.join(parts, "document_id"), run_id, "document_id", "group_no")
    questions = F.concat(F.lit(QUESTIONS + "\n"), F.array_join(F.transform("questions", asked), "\n"), F.lit("\n" + ASK_ALL))
    messages = F.array(_message("system", F.lit(told)), _message("user", F.col("part")), _message("user", questions))
    tokens = _quarter(F.lit(len(system) + len(playbook)) + F.col("letters") + _total(F.col("questions.question"))) + REVIEW_EXTRA
    return rows.select("document_id", "group_no", "custom_id", _line(F.col("custom_id"), model, messages, _meta("review_id", "document_id")).alias("line"), tokens.alias("request_tokens"))


def playbook_requests(plan: DataFrame, parts: DataFrame, playbooks: DataFrame, rules: DataFrame, run_id: str, system: str, *, model: str) -> DataFrame:
    """One request per (document_id, playbook_id) of ``plan``: system text with the rules, document, instruction.

    ``playbooks`` has playbook_id and playbook_name, ``rules`` playbook_id, ordinal, label,
    topic and the three positions; fallback and unacceptable positions may be null or empty.
    A playbook has a few dozen rules. One without rules gets no request.
    """

    def position(name: str, lead: str) -> Column:
        return F.when(_or_empty(name) != "", F.concat(F.lit("\n" + lead), F.col(name))).otherwise("")

    rule = F.concat(F.lit("## "), "label", F.lit(" — "), _or_empty("topic"), F.lit("\n" + PREFERRED), _or_empty("preferred_position"), position("fallback_position", FALLBACK), position("unacceptable_position", UNACCEPTABLE))
    each = F.array_sort(F.collect_list(F.struct("ordinal", "label", rule.alias("shown"))))
    listed = rules.groupBy("playbook_id").agg(each.alias("_r"), F.sum(F.char_length(_or_empty("preferred_position")).cast("long")).alias("_positions"))
    books = playbooks.select("playbook_id", "playbook_name").join(listed, "playbook_id")
    text = F.concat(F.lit(system + BLANK + PLAYBOOK), _or_empty("playbook_name"), F.lit("\n"), F.array_join(F.col("_r.shown"), "\n"))
    books = books.select("playbook_id", text.alias("_system"), F.concat(F.lit(ASK_FINDINGS[0]), F.array_join(F.col("_r.label"), ", "), F.lit(ASK_FINDINGS[1])).alias("_ask"), "_positions")
    rows = numbered(plan.join(books, "playbook_id").join(parts, "document_id"), run_id, "document_id", "playbook_id")
    messages = F.array(_message("system", F.col("_system")), _message("user", F.col("part")), _message("user", F.col("_ask")))
    tokens = F.lit(len(system) // 4 + PLAYBOOK_EXTRA) + _quarter(F.col("letters")) + _quarter(F.col("_positions"))
    metadata = F.struct(F.lit(run_id).alias("playbook_run_id"))
    return rows.select("document_id", "playbook_id", "custom_id", _line(F.col("custom_id"), model, messages, metadata).alias("line"), tokens.alias("request_tokens"))


def chat_requests(questions: DataFrame, passages: DataFrame, history: DataFrame, run_id: str, system: str, *, model: str) -> DataFrame:
    """One request per question: system text, passages of all documents, earlier messages, question.

    ``questions`` has thread_id, message_id and question, ``passages`` message_id, ordinal,
    label, filename, section_path and text, ``history`` message_id and ``messages``, an array
    of (position, role, content), oldest first. A question without passages gets no request.
    """
    named = F.concat(F.lit(CHAT_SECTION), _or_empty("filename"), F.when(_or_empty("section_path") != "", F.concat(F.lit(" > "), F.col("section_path"))).otherwise(""))
    shown = _labelled(passages.withColumn("section_path", named), "message_id")
    earlier = history.select("message_id", F.transform("messages", lambda m: _message(m["role"], F.coalesce(m["content"], F.lit("")))).alias("_earlier"))
    rows = numbered(questions.join(shown, "message_id").join(earlier, "message_id", "left"), run_id, "message_id")
    none = F.array().cast("array<struct<role:string,content:string>>")
    said = F.coalesce("_earlier", none)
    first = F.array(_message("system", F.lit(system)), _message("user", F.concat(F.lit(SELECTED + BLANK), "_shown")))
    last = F.array(_message("user", F.concat(F.lit(ASK_CHAT[0]), _or_empty("question"), F.lit(BLANK + ASK_CHAT[1]))))
    tokens = F.lit(len(system) // 4 + CHAT_EXTRA) + _quarter(F.col("_letters")) + _quarter(_total(said["content"]))
    return rows.select("message_id", "custom_id", _line(F.col("custom_id"), model, F.concat(first, said, last), _meta("thread_id")).alias("line"), tokens.alias("request_tokens"))
