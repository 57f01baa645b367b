"""Cases that the operators once left out: short notices, short lines, lines with one change, blank rests."""

from __future__ import annotations

import random
import re

from corpus_pipeline import line_stage
from gridwave.llm import license_scan, line_dedup
from gridwave.llm.queries import op1_license_scan


def plain_words(text):
    return re.split(r"[\W_]+", text.lower())


def places(words, part):
    return [i for i in range(len(words) - len(part) + 1) if words[i : i + len(part)] == part]


# --- op1: notices of fewer words than a shingle


def test_short_notices(spark):
    rows = [("rights", "All rights reserved."), ("one", "(PROPRIETARY)"), ("four", "Free for all uses"),
            ("long", "Released under the MIT License.")]
    templates = spark.createDataFrame([*rows, ("none", None), ("rights", "All rights reserved.")], "template_id string, text string")
    texts = ["All rights reserved", "all\n RIGHTS reserved! proprietary", "All rights are reserved", "x " * 9 + "All rights reserved.", "all rights",
             "a free for all uses; released under the MIT license, all rights reserved", None, "", "proprietaryx", "proprietary"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {(r.doc_id, r.template_id): (r.containment, r.first_word) for r in license_scan.scan(docs, templates, short=True).collect()}
    want = {}
    for k, text in enumerate(texts):
        for name, notice in rows:
            at = places(plain_words(text or ""), plain_words(notice.strip("().")))
            if at:
                want[k, name] = (1.0, at[0])
    assert got == want and len(got) == 8


def test_op1_has_short_notices(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    want = {r.doc_id for r in docs if places(plain_words(r.text or ""), ["all", "rights", "reserved"])}
    got = {r.doc_id for r in op1_license_scan(spark, folder).collect() if r.template_id == "all-rights-reserved"}
    assert want and got == want


# --- op9 and the pipeline's line stage: short lines


def test_short_lines(spark, folder):
    texts = ["go\nan opening line of the first document\n\n我们在这里", "go\n\n我们在这里\nits own", "我们在这里\n go", "go", " \n\t", "go\n\n我们在这里"]
    docs = spark.createDataFrame([(k, t, "en", "web", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {(r.doc_id, r.line_no): (r.component_doc_id, r.component_line_no) for r in line_dedup.decide(docs).collect()}
    first = {}
    for k, text in enumerate(texts):
        for n, line in enumerate(text.split("\n")):
            head = first.setdefault(line, (k, n)) if line.strip() else (k, n)
            assert got.pop((k, n)) == head
    assert not got
    left = {r.doc_id: r.text for r in line_stage(spark, docs, folder).collect()}
    assert left[0] == texts[0] and left[1] == "\nits own" and left[2] == " go" and 3 not in left and left[4] == " \n\t"


def test_recall_of_one_change(spark):
    draw = random.Random(8)
    word = lambda: "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randrange(3, 9)))
    texts, alike = [], []
    for k in range(200):
        line = " ".join(word() for _ in range(7 + k % 20))
        at = draw.randrange(8, len(line) - 8)
        changed = line[:at] + ("z" if line[at] != "z" else "y") + line[at + 1 :] if k % 2 else line.replace(line.split()[4], word(), 1)
        a, b = ({x[i : i + 4] for i in range(len(x) - 3)} for x in (line, changed))
        texts += [line, changed]
        alike.append(len(a & b) >= 0.8 * len(a | b))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    head = {r.doc_id: r.component_doc_id for r in line_dedup.decide(docs).collect()}
    found = [head[2 * k + 1] == 2 * k for k in range(200)]
    # A line from 39 characters bears one changed character; the search itself may miss one pair in 500.
    assert all(f <= a for f, a in zip(found, alike)) and sum(found) >= sum(alike) - 2
    characters = [found[k] for k in range(1, 200, 2) if len(texts[2 * k]) >= 39]
    assert len(characters) > 80 and sum(characters) >= len(characters) - 2


def test_blank_rest_goes(spark, folder):
    text = "a paragraph of the document\n\n \t\nand one more of them"
    docs = spark.createDataFrame([(k, t, "en", "web", 0) for k, t in enumerate([text, text, "\n\n", "", None])], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id: r.text for r in line_stage(spark, docs, folder).collect()} == {0: text, 2: "\n\n", 3: "", 4: None}
