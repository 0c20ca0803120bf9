"""Chunk records of pages and sections, and the map from a repaired text to the raw one."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.operators import chunking as C
from quillmark.operators import lifecycle as L
from quillmark.session import table

DATA = "/root/testdata/sf0.001"
RAW = "Cover line\r\n=== PAGE 3 ===\r\nGeneral Overview\r\nThe   first sen-\r\ntence is here. It goes\r\non in the next line.\r\n\r\n\r\n\r\n2. Costs and Fees\r\nPatients pay nothing.  Nobody does.\n=== PAGE 4 ===\nCONTACT DETAILS\nWrite to us."


def test_repairs_equal_the_columns_and_keep_the_map(spark):
    df = table(spark, DATA, "documents").select("text").union(spark.createDataFrame([(RAW,), (" a-\nb \r c.\n\nd\te",), ("",), ("x\n\n\n\ny-\nz",)], "text string"))
    for r in df.select("text", T.unwrap_lines(F.col("text")).alias("clean")).collect():
        m = L.unwrapped(L.Mapped(r.text))
        assert m.text == r.clean
        assert (m.start < m.end).all() and (m.start[1:] >= m.start[:-1]).all()
        same = [i for i in range(len(m.text)) if m.end[i] - m.start[i] == 1]
        assert all(r.text[m.start[i]] == m.text[i] or (r.text[m.start[i]] in " \t\r\n" and m.text[i] in " \n") for i in same[:5000])


def test_pages_and_sections_equal_the_columns(spark):
    df = spark.createDataFrame([(1, RAW), (2, "Only Headings Here\nAnother Title"), (3, "plain text\n\nof one part"), (4, "")], "id long, text string").select("id", T.unwrap_lines(F.col("text")).alias("text"))
    cols = C.pages(df, "id").withColumn("key", F.concat_ws("-", "id", "page"))
    got = {(r.key, r.title, r.confidence, r.body) for r in C.sections(cols.filter("trim(text) <> ''"), "key").collect()}
    want = {(f"{r.id}-{p}", t, c, b.text) for r in df.collect() for p, part in L.pages(L.Mapped(r.text)) for t, c, b in L.sections(part)}
    assert got == want and len(want) == 6


def test_records_of_a_small_text(spark):
    rows = L.chunk_records(spark.createDataFrame([(7, RAW), (8, None), (9, "=== PAGE 1 ===")], "id long, text string"), "id", least=1, product="prod", workspace="w", at="2024-01-01T00:00:00Z").orderBy("raw_start").collect()
    assert [(r.chunk_id, r.page, r.section_raw, r.section_confidence) for r in rows] == [
        ("doc_7_p1_sintroduction_c0", 1, "Introduction", 0.5), ("doc_7_p3_sgeneral_overview_c0", 3, "General Overview", 0.8), ("doc_7_p3_s2_costs_and_fees_c0", 3, "2. Costs and Fees", 0.8), ("doc_7_p4_scontact_details_c0", 4, "CONTACT DETAILS", 0.8),
    ]
    assert rows[1].text.startswith("The first sentence is here") and rows[1].raw_text.startswith("The   first sen-\r\ntence") and all(r.whole and RAW[r.raw_start : r.raw_end] == r.raw_text for r in rows)
    assert {(r.doc_scope, r.index_scope, r.workspace_id, r.source_checksum == rows[0].source_checksum) for r in rows} == {("doc_7", "prod", "w", True)}


@pytest.mark.parametrize("strategy", ["sentence", "paragraph_boundary", "fixed_size"])
def test_raw_stretches_re_read_to_their_chunks(spark, strategy):
    docs = table(spark, DATA, "documents").select("doc_id", "text")
    rows = L.chunk_records(docs, "doc_id", strategy=strategy, max_tokens=60, overlap=40, least=1).collect()
    bare = lambda s: re.sub(r"[\s.!?۔؟。]+", "", s)
    assert len(rows) > 500 and sum(r.whole for r in rows) > 0.97 * len(rows)
    for r in rows:
        if r.whole:
            assert bare(L.unwrapped(L.Mapped(r.raw_text)).text) == bare(r.text) or "-" in r.raw_text
