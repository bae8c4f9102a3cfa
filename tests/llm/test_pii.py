import hashlib
import re

import numpy as np

from lexspan.llm import pii
from lexspan.llm.pii import find_pii, masked, written

RE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute(text):
    out = []
    for order, (kind, pattern) in enumerate(RE.items()):
        for m in pattern.finditer(text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_base_spans_against_brute_force(spark):
    rng = np.random.default_rng(8)
    bits = ["a@b.co", "x.y+z@mail.example.org", "a@b", "@", ".", "_", "1.2.3.4", "256.1.1.1", "001.02.3.255", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111", "+1 (415) 555-0100", "+44 20 7946 0958", "+1", "12", "-", " ", "😀", "é", "word", "\n", "99999999999999999999", "a@b.c_x@d.e"]
    texts = ["".join(b + (" " if rng.random() < 0.4 else "") for b in rng.choice(bits, rng.integers(0, 14))) for _ in range(400)]
    texts += [None, "", "1" * 30000, "a" * 30000 + "@", "1 " * 20000, "x" * 100000, "+" + "1" * 5000, "a@b.c" * 500, "1." * 5000]
    docs = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, spans string").repartition(3)
    got = {r.doc_id: r.s for r in find_pii(docs).select("doc_id", written(pii.F.col("base")).alias("s")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute(t or ""), (i, t and t[:100])


def test_contexts_discover_other_spellings(spark):
    rows = [(i, f"Text {i}. Please write to user{i}@mail.example.com or call our number +1 415 555 {1000 + i} today.") for i in range(20)]
    rows += [(100, "Please write to jane(at)corp(dot)example today"), (101, "write to nobody"), (102, "room number 12345678 is free"), (103, "call our number 4155550100 now"), (100, "Please write to jane(at)corp(dot)example today")]
    rows += [(104, None), (None, "write to a@b.cd")]
    docs = spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, n_chars long")
    found = {r.doc_id: r.spans for r in find_pii(docs).collect()}
    assert [(s.kind, s.value) for s in found[100]] == [("email", "jane(at)corp(dot)example")]
    assert found[101] == [] and found[102] == [] and found[104] == []
    out = masked(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    new = {r.doc_id: r for r in out.collect()}
    assert new[3].text == "Text 3. Please write to [EMAIL] or call our number [PHONE] today." and new[3].n_chars == len(new[3].text)
    assert new[101].text == "write to nobody" and new[104].text is None and new[None].text == "write to [EMAIL]"


def test_seeds_and_candidates_of_several_tokens(spark):
    rows = [(i, f"Please call our number +1 (415) 555-{1000 + i} today.") for i in range(20)]
    rows += [(100 + i, f"charged to card 4111 1111 1111 {n} then") for i, n in enumerate(n for n in range(1000, 1400) if luhn(f"411111111111{n}"))]
    rows += [
        (1, "call our number 4155550100 now"),
        (2, "call our number (415) 555-0100, or"),
        (3, "call our number 415 555 0100 now"),
        (4, "call our number 4155550100 12 times"),
        (5, "the card 4111/1111/1111/1112 and card 4111 1111 1111 1112."),
        (6, "charged to card 4111 1111 1111 1112 and to card 41111111 11111112."),
        (7, "room 12 has 555 0100 chairs"),
        (8, "call our number 12 345"),
        (9, "call our number " + "1 " * 300),
    ]
    docs = spark.createDataFrame([(d + 1000 * (d < 10 and not t.startswith("Please")), t) for d, t in rows], "doc_id long, text string")
    rows = {r.doc_id: r.spans for r in find_pii(docs).collect()}
    got = {d - 1000: [(s.kind, s.value) for s in spans] for d, spans in rows.items() if d > 1000}
    assert got[1] == got[4] == [("phone", "4155550100")]
    assert got[2] == [("phone", "(415) 555-0100")] and got[3] == [("phone", "415 555 0100")]
    assert got[6] == [("card", "4111 1111 1111 1112"), ("card", "41111111 11111112")]
    assert got[7] == got[8] == [] and got[5] == []
    assert got[9] == [("phone", ("1 " * 15).strip())]


def test_found_instances_make_further_contexts(spark):
    spelt = [f"ann{i}(at)corp(dot)example" for i in range(8)]
    far = [f"bob{i}(at)corp(dot)example" for i in range(2)]
    rows = [f"please write to user{i}@mail.example.org" for i in range(20)] + [f"please write to {s}" for s in spelt]
    rows += [f"reach me under {s}" for s in [*spelt, far[0]]]  # no base span stands in this context
    rows += [f"reach him below {s}" for s in (*spelt[:2], far[1])]  # two instances are too few
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: [s.value for s in r.spans] for r in find_pii(docs).collect()}
    assert [got[i] for i in range(20, 37)] == [[s] for s in (*spelt, *spelt, far[0])]
    assert got[37] == got[38] == got[39] == []


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert find_pii(docs).count() == 0 and masked(docs).count() == 0
    assert hashlib.sha256(b"").hexdigest()


def test_masked_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "mail bob@example.org now", 9, "a", "b", "c", "d", "e"), (2, None, None, "a", "b", "c", "d", "e"), (None, "plain", 5, "a", "b", "c", "d", "e")], "doc_id long, text string, n_chars long, spans string, _id string, _mark string, _new string, `x.y` string")
    out = masked(docs)
    assert out.columns == docs.columns
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == sorted([(1, "mail [EMAIL] now", 16, "a", "b", "c", "d", "e"), (2, None, None, "a", "b", "c", "d", "e"), (None, "plain", 5, "a", "b", "c", "d", "e")], key=str)


def test_long_candidates_and_far_contexts(spark):
    long = "a" * 140 + "(at)mail.example.org"
    rows = [f"please write to user{i}@mail.example.org" for i in range(20)]
    rows += [f"please write to {long}", "please write" + " -" * 60 + "to " + "-" * 100 + " eve(at)corp(dot)example", "please write to" + " ." * 3000 + " mia(at)corp(dot)example", "supercalifragilistic" * 6 + "please write to zoe(at)corp(dot)example"]
    rows += ["write" + "x" * 90 + " to kim(at)corp(dot)example", "to amy(at)corp(dot)example"]  # other contexts than "write to"
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: [s.value for s in r.spans] for r in find_pii(docs).collect()}
    assert [got[i] for i in range(20, 26)] == [[long], ["eve(at)corp(dot)example"], ["mia(at)corp(dot)example"], ["zoe(at)corp(dot)example"], [], []]


def test_many_matches_in_one_text(spark):
    """Places are right across blocks and pages, whatever the number of matches."""
    for n in (1, 63, 64, 65, 128, 129, 3000):
        text = "".join(f"\U0001f600 é user{i}@mail.example.org, {i}.2.3.4 " for i in range(n))
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        row = docs.select(written(pii.base_spans(pii.F.col("text"))).alias("s"), pii.seeds_of(pii.F.col("text")).alias("x")).first()
        assert row.s == brute(text)
        want = [" ".join(re.findall(r"[^\W_]+", text[: x.start].lower())[-2:]) for x in row.x] if n < 200 else None
        assert want is None or [x.context for x in row.x] == want


def test_masking_shuffles_documents_with_spans_only(spark):
    """The filter lets all documents with spans through, and next to none without; equal ids and null ids are told apart by the text."""
    rows = [(i if i else None, f"write to user{i}@mail.example.org" if i % 20 == 0 else f"plain text {i}") for i in range(400)] + [(20, "another plain text"), (None, "plain"), (21, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    mark = pii.F.xxhash64(pii.F.coalesce("text", pii.F.lit("")))
    found = docs.where("text LIKE 'write%'").select(pii.F.col("doc_id").alias("_id"), mark.alias("_mark"))
    passed = [tuple(r) for r in pii._with_filter(docs, found, pii.F.col("doc_id"), mark).where("_maybe").select("doc_id", "text").collect()]
    assert {r for r in rows if r[1] and r[1].startswith("write")} <= set(passed) and len(passed) <= 22
    got = sorted(map(tuple, masked(docs).collect()), key=str)
    assert got == sorted([(d, t and re.sub(r"\S+@\S+", "[EMAIL]", t)) for d, t in rows], key=str)
