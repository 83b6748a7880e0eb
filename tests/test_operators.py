"""Small cases with results worked out by hand, and properties."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lexmill.functions import extract as X
from lexmill.functions import text as T
from lexmill.operators import chunking as C
from lexmill.operators import retrieval as R
from lexmill.operators import structure as S
from lexmill.sources import readers, sinks

BLOCK = "doc_id bigint, block_idx int, page int, bbox array<double>, height double, text string"


def blocks(spark, texts, pages=None, boxes=None):
    pages = pages or [1] * len(texts)
    boxes = boxes or [[0.0, 100.0, 1.0, 120.0]] * len(texts)
    return spark.createDataFrame([(1, i, p, b, 792.0, t) for i, (t, p, b) in enumerate(zip(texts, pages, boxes, strict=True))], BLOCK)


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "c string").select(expression(F.col("c")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "value, wanted",
    [("a\u00a0b", "ab"), ("a\nb\n\nc", "a b\n\nc"), ("  x;  y • z ", "x. y \n z"), ("", ""), (None, None), ("\n\nq\n", "q")],
)
def test_clean_text(spark, value, wanted):
    assert one(spark, T.clean_text, value) == wanted


def test_margins(spark):
    boxes = [[0.0, 760.0, 1.0, 780.0], [0.0, 600.0, 1.0, 780.0], [0.0, 10.0, 1.0, 20.0], [0.0, 100.0, 1.0, 120.0]]
    rows = S.drop_margins(blocks(spark, ["a", "b", "c", "d"], boxes=boxes)).collect()
    assert sorted(r.text for r in rows) == ["b", "d"]


def test_headings(spark):
    texts = ["Chapter 1 A", "Section 2.3 B", "x", "Chapter 3 C", "Sub-section 1.2 D", "y"]
    rows = S.carry_headings(blocks(spark, texts)).orderBy("block_idx").collect()
    assert [r.headers for r in rows] == ["Chapter 1", "Chapter 1, Section 2", "Chapter 1, Section 2", "Chapter 3", "Chapter 3, Sub-section 1.2", "Chapter 3, Sub-section 1.2"]
    assert [r.headers for r in S.carry_headings(blocks(spark, texts[:2]), True).orderBy("block_idx").collect()][1] == "Chapter 1, Section 2.3"


def test_contents(spark):
    texts = ["TABLE OF CONTENTS", "CHAPTER 1. Title ..... 9", "Chapter 1. Again ..... 10", "Sub-section 1.2 x .... 3", "Chapter 1 text", "Sub-section 1.2 more"]
    rows = blocks(spark, texts)
    toc = S.contents_table(rows)
    assert [(r.toc_idx, r.page, r.level, r.title) for r in toc.orderBy("toc_idx").collect()] == [(0, 9, 1, "Title"), (1, 10, 2, "Again")]
    out = S.add_titles(S.carry_headings(rows), toc).orderBy("block_idx").collect()
    assert out[4].enriched_headers == "Chapter 1: Title"
    assert out[5].enriched_headers == "Chapter 1: Title, Sub-section 1.2"


def test_colon(spark):
    rows = S.merge_after_colon(blocks(spark, ["a text:", "b text:", "c text", "d"], [1, 2, 3, 4])).orderBy("block_idx").collect()
    assert [(r.block_idx, r.page, r.text) for r in rows] == [(0, 1, "a text:\nb text:\nc text"), (3, 4, "d")]


def test_page_pairs_do_not_chain(spark):
    rows = S.reattach_pages(blocks(spark, ["begin of", "middle of", "end of it"], [1, 2, 3])).orderBy("block_idx").collect()
    assert [(r.text, r.pages) for r in rows] == [("begin of middle of", [1, 2]), ("end of it", None)]
    rows = S.reattach_pages(blocks(spark, ["com-", "pliance", "Note that"], [1, 2, 3])).orderBy("block_idx").collect()
    assert [r.text for r in rows] == ["compliance", "Note that"]


@pytest.mark.parametrize("size, wanted", [(500, [(None, 500)]), (501, [(0, 500), (1, 76)]), (99, []), (925, [(0, 500), (1, 500)])])
def test_slide(spark, size, wanted):
    rows = C.slide(blocks(spark, ["x" * size])).orderBy("chunk_id").collect()
    assert [(r.chunk_id, len(r.text)) for r in rows] == wanted


def test_slide_covers(spark):
    r = random.Random(1)
    text = "".join(r.choice("abc d") for _ in range(3000)).strip()
    rows = C.slide(blocks(spark, [text]), most=700).orderBy("chunk_id").collect()
    assert all(row.text in text for row in rows)
    assert "".join(rows[0].text + "".join(row.text[105:] for row in rows[1:])).replace(" ", "")[:500] == text.replace(" ", "")[:500]
    with pytest.raises(ValueError):
        C.slide(blocks(spark, [text]), overlap=1.0)


def packed(pieces, sep, most):
    out, cur = [], None
    for p in pieces:
        if cur is not None and len(cur) + len(sep) + len(p) <= most:
            cur += sep + p
        else:
            if cur is not None:
                out.append(cur)
            cur = p
    return out if cur is None else [*out, cur]


def test_pack(spark):
    r = random.Random(2)
    cases = [["".join(r.choice("ab") for _ in range(r.randint(0, 9))) for _ in range(r.randint(0, 12))] for _ in range(60)]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c array<string>").select("i", C.pack(F.col("c"), "--", 10).alias("r")).orderBy("i").collect()
    assert [row.r for row in rows] == [packed(c, "--", 10) for c in cases]


def test_pack_tiers(spark):
    long = "w" * 30
    rows = C.pack_blocks(blocks(spark, ["short", f"One two. {long}", "aa bb cc dd ee ff gg hh"]), 20).orderBy("block_idx", "chunk_id").collect()
    assert [(r.block_idx, r.chunk_id, r.text) for r in rows] == [(0, None, "short"), (1, 0, "One two."), (1, 1, long), (2, 0, "aa bb cc dd ee ff gg"), (2, 1, "hh")]


def test_sections(spark):
    text = "before\nChapter 1 A\nalpha\n\nChapter 2 B\nSection 1.1.1 C\nbeta"
    rows = C.heading_sections(spark.createDataFrame([(1, text), (2, "none"), (3, None)], "doc_id int, text string")).orderBy("chunk_idx").collect()
    assert [(r.heading, r.content, r.hierarchy) for r in rows] == [("Chapter 1 A", "alpha", ["Chapter 1 A"]), ("Section 1.1.1 C", "beta", ["Section 1.1.1 C"])]


def test_markers(spark):
    text = "intro\nArticle 1 x\nClause 1 y\nParagraph 2 z\nrefined"
    rows = C.marker_segments(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("chunk_idx").collect()
    assert [(r.chunk_id, r.content, r.section_hierarchy) for r in rows] == [
        ("chunk_0_1", "intro", []), ("chunk_1_2", "Article 1 x", ["Article 1"]), ("chunk_2_3", "Clause 1 y", ["Article 1", "Clause 1"]),
        ("chunk_3_4", "Paragraph 2 z", ["Article 1", "Clause 1", "Paragraph 2"]), ("chunk_4_5", "refined", ["Article 1", "Clause 1", "Paragraph 2"]),
    ]
    rows = C.marker_segments(spark.createDataFrame([(1, "aaaa\nbbbb\ncccc")], "doc_id int, text string"), most=8).orderBy("chunk_idx").collect()
    assert [r.chunk_id for r in rows] == ["chunk_0_1", "chunk_2_3"]


def test_overlap(spark):
    rows = C.add_overlap(spark.createDataFrame([(1, 0, "a", "abcdefghij" * 3), (1, 1, "b", "x" * 20), (1, 2, "c", "yyyyyy")], "doc_id int, chunk_idx int, chunk_id string, content string")).orderBy("chunk_idx").collect()
    assert [(r.content, r.overlap_with) for r in rows] == [("abcdefghij" * 3, None), ("hij\n" + "x" * 20, ["a"]), ("x" * 20 + "\nyyyyyy", ["b"])]


def test_recursive_split():
    r = random.Random(3)
    for _ in range(60):
        text = "".join(r.choice(["word ", "a ", "\n", "\n\n", ". ", "x" * r.randint(1, 60)]) for _ in range(r.randint(0, 80)))
        pieces = C.split_recursively(text, 50, 10)
        assert all(0 < len(p) <= 50 for p in pieces)
        kept = lambda s: re.sub(r"[\s.]", "", s)
        assert set(kept(text)) == set(kept("".join(pieces)))
        assert len(kept("".join(pieces))) >= len(kept(text))


def test_references(spark):
    text = "Article 5 (1) of the act. see section 3.2 and Sub-section 5, 2004 law"
    assert one(spark, X.references, text) == ["2004 law", "Article 5", "Sub-section 5", "section 3.2", "section 5"]
    assert one(spark, X.cross_references, text) == ["see section 3.2"]


def test_quality(spark):
    text = " ".join(["word"] * 60)
    assert one(spark, T.quality_score, text + " ﬁ") == pytest.approx(0.9)
    assert [one(spark, T.quality_score, t) for t in ("", None, "short", "x" * 200)] == [0.0, 0.0, 0.1, 0.3]


CHUNKS = "id int, content string, headers string, page int, embedding array<double>"


def test_scores_and_sources(spark):
    chunks = spark.createDataFrame([(0, "x 517", "S", 1, [0.0, 1.0]), (1, "section 12", "S", 2, [0.0, 1.0]), (2, "plain", "S", 3, [0.0, 1.0]), (3, "other", "", 3, None)], CHUNKS)
    asked = spark.createDataFrame([(7, "517", [1.0, 0.0]), (8, "section 12", [0.0, 0.0])], "query_id int, query string, embedding array<double>")
    rows = {(r.query_id, r.id): r.score for r in R.search(chunks, asked, 5).collect()}
    assert rows[7, 0] == pytest.approx(0.6)
    assert rows[8, 1] == pytest.approx(0.2 + 0.5 + 0.7)
    assert (7, 3) not in rows
    out = {r.query_id: r for r in R.answers(asked, chunks, 2).collect()}
    assert [s.id for s in out[7].sources] == [0, 1]
    assert out[7].confidence == 1.0
    text = {r.query_id: r.context for r in R.contexts(R.search(chunks, asked, 2), chunks).collect()}[7]
    assert text == "x 517\n\nplain\n\nsection 12"
    none = R.answers(asked, chunks.where("id > 5"), 2).collect()
    assert {(r.answer, r.confidence) for r in none} == {(R.NOTHING_FOUND, 0.0)}


def test_batch_equals_single(spark):
    r = random.Random(4)
    chunks = spark.createDataFrame([(i, "", "", 1, [r.random() - 0.5 for _ in range(6)]) for i in range(50)], CHUNKS)
    vector = [r.random() - 0.5 for _ in range(6)]
    asked = spark.createDataFrame([(1, "", vector)], "query_id int, query string, embedding array<double>")
    assert [x.id for x in R.top_cosine_batch(chunks, asked, 7).orderBy("rank").collect()] == [x.id for x in R.top_cosine(chunks, vector, 7).collect()]


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ftwo\n\nthree")
    (tmp_path / "b.html").write_text("<html><head><title>t</title></head><body><p>x<b>y</b></p><script>z</script><p>w</p></body></html>")
    (tmp_path / "c.bin").write_bytes(b"\xff\xfe")
    out = {r.path.rsplit("/", 1)[1]: r for r in readers.read_documents(spark, str(tmp_path)).collect()}
    assert out["a.txt"].page_texts == ["one", "two\n\nthree"]
    assert out["a.txt"].text == "\n--- Page 1 ---\none\n--- Page 2 ---\ntwo\n\nthree"
    assert out["b.html"].page_texts == ["xy\nw"]
    assert out["c.bin"].page_texts is None and out["c.bin"].error.startswith("All processors failed")
    rows = readers.blocks_from_pages(readers.read_documents(spark, str(tmp_path)).where("engine IS NOT NULL")).orderBy("doc_id", "block_idx").collect()
    assert [(r.block_idx, r.page, r.text) for r in rows][:3] == [(0, 1, "one"), (1, 2, "two"), (2, 2, "three")]


def test_fallback(spark):
    def broken(data):
        raise OSError("no")

    files = spark.createDataFrame([("p", 3, bytearray(b"abc"))], "path string, length bigint, content binary")
    engines = {"pymupdf": broken, "unstructured": lambda b: [b.decode()]}
    row = readers.extract(files, engines).first()
    assert (row.page_texts, row.engine, row.error) == (["abc"], "unstructured", None)
    row = readers.extract(files, engines, fallback=False).first()
    assert row.page_texts is None and row.error == "pymupdf: no"
    assert readers.extract(files, engines, preferred="unstructured").first().engine == "unstructured"


def test_sinks(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "a", "h", 1, [0.5]), (2, "b", "", 2, [0.1])], CHUNKS)
    calls = []

    def embed(rows, column):
        calls.append(column)
        return rows

    plain = chunks.drop("embedding")
    for _ in range(2):
        assert sinks.embed_cached(plain, embed, str(tmp_path), "hashed").count() == 2
    assert sinks.embed_cached(plain.where("id = 1"), embed, str(tmp_path), "hashed").count() == 1
    assert len(calls) == 2
    spark.sql("DROP TABLE IF EXISTS passages")
    sinks.add_to_index(chunks, "passages")
    sinks.add_to_index(chunks, "passages")
    assert sinks.index_statistics(spark.table("passages")).first()[0] == 4
    sinks.drop_index(spark, "passages")
    assert not spark.catalog.tableExists("passages")


def test_stream(spark, tmp_path):
    from lexmill.streaming import ingest

    source = str(tmp_path / "in")
    frame = lambda n: spark.createDataFrame([(n, "y" * 600)], "doc_id bigint, text string")
    frame(1).write.parquet(source)
    for n in (1, 2):
        ingest.run_available(ingest.stream_chunks(spark, source), str(tmp_path / "out"), str(tmp_path / "state"))
        assert spark.read.parquet(str(tmp_path / "out")).count() == 2 * n
        frame(n + 1).write.mode("append").parquet(source)
