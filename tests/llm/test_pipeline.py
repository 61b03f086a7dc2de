"""The pipeline's stages against brute force, each on its own input."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from ledgerlake.llm import nearcopies, secrets
from ledgerlake.llm.common import table, written
from tests.llm.test_brute import docs
from tests.oracle import SF


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def windows(text):
    w = words(text)
    return {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()


def redacted_by_hand(text):
    spans = []
    for r in secrets.RULES:
        for m in re.finditer(r.pattern.replace("(?i:", "(?:") if r.kind != "assign" else r.pattern, text or ""):
            if len(m[r.group]) >= r.least:
                spans.append((m.start(), m.end()))
    out, at = "", 0
    for a, b in sorted(spans):
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + (text or "")[at:]


def test_stages_on_the_smallest_tables(spark):
    stages = dict(p.STAGES)
    kept = written(stages["quality classifier"](spark, table(spark, SF, "documents"), SF), "t")
    assert 0 < kept.count() < table(spark, SF, "documents").count()
    once = written(stages["SimHash near-dedup"](spark, kept, SF), "t")
    sets = {r.doc_id: set(nearcopies.shingles((r.text or "").encode()).tolist()) for r in kept.collect()}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if label[b] < label[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    label[a], changed = label[b], True
    assert {r.doc_id for r in once.collect()} == set(label.values())
    clean = written(stages["benchmark decontamination"](spark, once, SF), "t")
    items = [windows(r.text) for r in table(spark, SF, "benchmark").collect()]
    long, short = {x for s in items for x in s if len(x) == 10}, {x for s in items for x in s if 0 < len(x) < 10}

    def dirty(text):
        w = words(text)
        return any(tuple(w[i : i + 10]) in long for i in range(len(w) - 9)) or any(tuple(w[i : i + len(s)]) == s for s in short for i in range(len(w)))

    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in once.collect() if not dirty(r.text)}
    safe = written(stages["secret scans"](spark, clean, SF), "t")
    assert {r.doc_id: r.text for r in safe.collect()} == {r.doc_id: redacted_by_hand(r.text) for r in clean.collect()}
    last = stages["SentencePiece encoding"](spark, safe, SF).collect()
    assert {r.doc_id: r.text_sha256 for r in last} == {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in safe.collect()}


def test_stages_take_nulls_and_repeated_rows(spark):
    rows = docs(spark, [(1, None), (1, None), (None, "a b c d"), (2, ""), (3, "token = abcdef1")])
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, rows, SF)
        assert out.columns == rows.columns, name
        out.collect()
    assert p.STAGES[-1][1](spark, rows, SF).count() == 5


CLASHING = ("spans", "blob", "_blob", "_row", "_doc", "_text", "_hash", "_id", "path", "text_hash", "_text_hash", "_address", "keep", "n", "component_id", "_n", "_salt")


@pytest.mark.parametrize("name", [name for name, _ in p.STAGES[:-1]])
def test_stages_keep_columns_of_any_name(spark, name):
    rows = docs(spark, [(1, "token = abcdef1 and more"), (1, "token = abcdef1 and more"), (2, "x y z"), (None, None), (None, "x y z")])
    rows = rows.select("*", *[F.lit(c).alias(c) for c in CLASHING], F.create_map(F.lit("k"), F.lit(1)).alias("map"))
    out = dict(p.STAGES)[name](spark, rows, SF)
    assert out.columns == rows.columns
    assert all(r[c] == c for r in out.collect() for c in CLASHING)


@pytest.mark.parametrize("name", [name for name, _ in p.STAGES])
def test_stages_take_an_empty_table(spark, name):
    assert dict(p.STAGES)[name](spark, docs(spark, []), SF).count() == 0
