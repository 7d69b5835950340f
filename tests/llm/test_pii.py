from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from eraframe.llm import pii, queries
from tests.conftest import SMALL
from tests.llm.cases import no_documents, odd_documents, odd_rows, small_documents

# The base kinds as they are stated.
STATED = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def accepted(kind: str, value: str) -> bool:
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(d // 10 + d % 10 for d in doubled) % 10 == 0
    return True


def stated_spans(text: str | None) -> str:
    found = [
        (m.start(), nth, kind, m.end())
        for nth, (kind, pattern) in enumerate(STATED)
        for m in re.finditer(pattern, text or "")
        if accepted(kind, m[0])
    ]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))


def base_text(spans) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans if s.kind != "term")


def test_query_against_stated_patterns(spark):
    text = dict(small_documents())
    rows = queries.queries()["op10_pii"](spark, SMALL).collect()
    assert sorted(r.doc_id for r in rows) == sorted(text)
    for r in rows:
        want = stated_spans(text[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        for kind, _ in STATED:
            assert r[f"n_{kind}"] == want.count(f"{kind}:")
        assert set(want.split(",")) <= set(r.spans.split(","))


HARD = [
    "a@b.c.d@e.f _x@y.z a@b.com_x@y.z a@b a@b..c @b.c a@-.- é@b.c \U0001f600 q@r.st",
    "1.2.3.4.5 1.2.3..4.5.6.7 256.1.1.1 0255.001.0.000 1.2.3 99999999999999999999.1.1.1 1.2.3.4",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 1111 1111 0000000000000 4242424242424242x",
    "+1 (234) 567-8901 +12 +1234567890123456 +49 30 123 45 67. +1+2 3456789 ++1 23456789",
    "4785380592391139$$$ 152.143.123.131### x+1-234-567-890@a.bc",
    "a" * 20_000 + " " + "1" * 20_000 + " " + "a." * 9_000 + " b@" + "c." * 9_000 + "d",
    "+1" + "(" * 5_000 + "23456789",
    "", "no", "\n".join(["x@y.zz"] * 200), "1 2-3 4567 8901  1 " + "4242-4242 4242-4242 4242 4242 4242",
    "424242424242424242 42 4242-4242-4242-4242 -4242424242424242- 1-2-3-4-5-6-7-8-9-0-1-2",
]


def test_patterns_on_hard_texts(spark):
    docs = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    got = docs.select("doc_id", pii.base_spans(F.col("text")).alias("s")).collect()
    for r in got:
        assert base_text(r.s) == stated_spans(HARD[r.doc_id])
        assert all(HARD[r.doc_id][s.start : s.end] == s.value for s in r.s)


def disclosing_corpus():
    """A value that comes with a name nearly always, and with a common word at times."""
    docs = [f"Report {i}: Thornfield asked j.doe@corp.example for paper number{i}" for i in range(6)]
    docs += [f"Paper asked about matter{i} and paper\nnumber of things{i}" for i in range(60)]
    docs.append("Nobody knows Thornfield here")
    docs += ["other only@once.example words"]
    return docs


def test_terms_that_disclose_a_value_go(spark):
    texts = disclosing_corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r.spans for r in pii.find_private(docs).collect()}
    for i in range(6):
        terms = {s.value for s in rows[i] if s.kind == "term"}
        assert "Thornfield" in terms and not terms & {"asked", "paper"}
    assert all(not rows[i] for i in range(6, 67))
    assert [s.kind for s in rows[67]] == ["email"]
    clean = {r.doc_id: r.text for r in pii.sanitise_documents(docs).collect()}
    assert all("Thornfield" not in clean[i] and "[EMAIL]" in clean[i] for i in range(6))
    assert all(clean[i] == texts[i] for i in range(6, 67))


def test_shares_against_counts(spark):
    import math

    texts = disclosing_corpus()
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {
        (r.entity, r.term): r.share
        for r in pii.disclosing_terms(docs, docs.filter("text LIKE '%@%'"), disclosure=0.0).collect()
    }
    lines = [line for t in texts for line in t.split("\n")]
    for term in ("thornfield", "asked", "paper"):
        with_term = sum(term in line.lower() for line in lines)
        together = 6 * len(lines) / (with_term * 6)
        share = math.log(together) / math.log(len(lines) / 6)
        assert got["email:j.doe@corp.example", term] == pytest.approx(share)


def test_odd_rows(spark):
    got = sorted(base_text(r.spans) for r in pii.find_private(odd_documents(spark)).collect())
    assert got == sorted(stated_spans(r[1]) for r in odd_rows())
    assert pii.find_private(no_documents(spark)).count() == 0
    docs = odd_documents(spark)
    clean = pii.sanitise_documents(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    changed = [r for r in clean.collect() if r.doc_id == 8][0]
    assert changed.text == "mail [EMAIL] now [PHONE] \U0001f600 [IP]"
    assert changed.n_chars == len(changed.text)


def rare_corpus():
    """Names that come with a value in one or two lines of many, short or with digits."""
    docs = [f"common words about the matter of day number {i % 50}" for i in range(6_000)]
    docs += ["common words about Ann of ann@once.example", "the matter\nof 李明\nli@once.example\nwords"]
    docs += ["common agent K9x and jo@twice.example", "the agent K9x has jo@twice.example"]
    return docs


def test_rare_values_have_terms_in_and_beside_their_lines(spark):
    texts = rare_corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r.spans for r in pii.find_private(docs).collect()}
    terms = [{s.value for s in rows[i] if s.kind == "term"} for i in range(len(texts))]
    assert not any(terms[:6_000])
    assert "Ann" in terms[6_000] and "李明" in terms[6_001]
    assert "K9x" in terms[6_002] and "K9x" in terms[6_003]
    assert not set().union(*terms) & {"common", "words", "about", "the", "matter", "of"}


def test_queries_mark_disclosing_terms_in_all_texts(spark, tmp_path):
    texts = disclosing_corpus()
    texts[10] = "THORNFIELD, not Thornfields: " + texts[10]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r.spans for r in pii.find_private(docs, everywhere=True).collect()}
    assert [s.value for s in rows[66]] == ["Thornfield"]
    assert [s.value for s in rows[10]] == ["THORNFIELD"]
    assert all(not rows[i] for i in range(6, 66) if i != 10)
    got = {r.doc_id: r.spans for r in queries.queries()["op10_pii"](spark, str(tmp_path)).collect()}
    assert got[66] == "term:13:23"
    clean = corpus_pipeline.private_data(spark, docs, str(tmp_path))
    assert not any(re.search(r"(?i)\bthornfield\b", r.text) for r in clean.collect())


def test_texts_with_very_many_values_are_linear(spark):
    """100,000 addresses in one text: found and replaced in seconds."""
    n = 100_000
    text = " ".join(f"u{i}@x{i % 9}.org" for i in range(n))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = time.perf_counter()
    spans = F.transform(pii.base_spans(F.col("text")), lambda s: s.withField("gone", F.lit(False)))
    found = pii.stored(docs.select("text", spans.alias("spans")), "many-spans")
    clean = found.select(F.size("spans").alias("n"), pii.sanitised(F.col("text"), F.col("spans")).alias("text"))
    row = clean.first()
    assert time.perf_counter() - start < 10
    assert row.n == n and row.text == " ".join(["[EMAIL]"] * n)


def test_replacing_spans_anywhere(spark):
    """Runs of the text and spans meet in every way: against plain slicing."""
    rng = random.Random(4)
    cases = []
    for size in (0, 1, 1023, 1024, 1025, 2048, 5000):
        text = "".join(rng.choice("ab \n\U0001f600é") for _ in range(size))
        spans = []
        for _ in range(rng.randint(0, 40) if size else 0):
            start = rng.randrange(size)
            end = min(size, start + rng.choice([1, 3, 1024, 1500]))
            spans.append((start, rng.randrange(5), end, rng.choice(pii.KINDS), "", rng.random() < 0.3))
        cases.append((text, sorted(spans)))
        cases.append((text, [(0, 0, size, "email", "", False)] if size else []))
    kind = "array<struct<start:int,nth:int,end:int,kind:string,value:string,gone:boolean>>"
    df = spark.createDataFrame(cases, f"text string, spans {kind}")
    got = df.select("text", "spans", pii.sanitised(F.col("text"), F.col("spans")).alias("clean"))
    for row in got.collect():
        at, wanted = 0, ""
        for s in row.spans:
            wanted += row.text[at : max(at, s.start)]
            wanted += "" if s.gone or s.start < at else pii.LABELS[s.kind]
            at = max(at, s.end)
        assert row.clean == wanted + row.text[at:]


def stated_terms(texts: list[str]) -> list[tuple[int, int, int]]:
    """Disclosing terms of every text, by plain counting."""
    lines = [(d, n, line) for d, t in enumerate(texts) for n, line in enumerate((t or "").split("\n"))]
    values = [{(k, v.lower() if k in ("email", "ip") else re.sub("[^0-9]", "", v)) for k, v in found(line)} for _, _, line in lines]
    word = re.compile(r"[^\W_]+")
    own_terms, all_terms = [], []
    for _, _, line in lines:
        bare = line
        for pattern in pii.PATTERNS.values():
            bare = re.sub(pattern.replace("\\G|", ""), " ", bare)
        own_terms.append({w.lower() for w in word.findall(bare)})
        all_terms.append({w.lower() for w in word.findall(line)})
    total = len(lines)
    n_term = collections.Counter(t for terms in all_terms for t in terms)
    near = []
    for i, (d, n, _) in enumerate(lines):
        here = set(values[i])
        for j in (i - 1, i + 1):
            if 0 <= j < total and lines[j][0] == d:
                here |= values[j]
        near.append(here)
    risky = set()
    for placed in (values, near):
        n_value = collections.Counter(v for held in placed for v in held)
        both = collections.Counter((v, t) for held, terms in zip(placed, own_terms, strict=True) for v in held for t in terms)
        for (value, term), n in both.items():
            if n < 0.75 * n_term[term]:
                continue
            chance = 2.0 ** (1 - n)
            smooth = (n + chance * n_value[value] / total) / (n_term[term] + chance)
            if math.log(smooth * total / n_value[value]) / math.log(total / n_value[value]) >= 0.9:
                risky.add(term)
    return [
        (d, m.start(), m.end())
        for d, t in enumerate(texts)
        for m in word.finditer(t or "")
        if m[0].lower() in risky
    ]


def found(line: str) -> list[tuple[str, str]]:
    spans = [s.split(":") for s in stated_spans(line).split(",") if s]
    return [(kind, line[int(start) : int(end)]) for kind, start, end in spans]


@pytest.mark.parametrize("seed", [1, 2])
def test_whole_query_against_brute_force(spark, tmp_path, seed):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(40)] + [f"Name{i}" for i in range(30)]
    texts = []
    for _ in range(700):
        rows = []
        for _ in range(rng.randint(1, 4)):
            line = rng.choices(words, k=rng.randint(1, 8))
            if rng.random() < 0.04:
                person = rng.randrange(30)
                line += [f"Rare{person}", f"n{person}@mail.example"]
            if rng.random() < 0.01:
                line.append(f"rare{rng.randrange(30)}")
            rng.shuffle(line)
            rows.append(" ".join(line))
        texts.append("\n".join(rows))
    texts += [texts[0], None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.queries()["op10_pii"](spark, str(tmp_path)).collect()
    marked = sorted(
        (r.doc_id, *map(int, s.split(":")[1:]))
        for r in got
        for s in (r.spans.split(",") if r.spans else [])
        if s.startswith("term")
    )
    assert marked == stated_terms(texts) and marked
    assert all(r.base_sha256 == hashlib.sha256(stated_spans(texts[r.doc_id]).encode()).hexdigest() for r in got)


def test_evidence_does_not_loosen_with_the_corpus(spark):
    """A word of three lines that meets a value once is not disclosing, however many lines there are."""
    for lines in (2_000, 40_000):
        texts = [f"common words of line number {i % 50}" for i in range(lines)]
        texts += ["Seldom a@once.example", "Seldom words", "Seldom matter of words"]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        risky = pii.disclosing_terms(docs, docs.filter("text LIKE '%@%'"))
        assert "seldom" not in {r.term for r in risky.collect()}
