from lexmill.operators import structure
from lexmill.operators.system import PRESETS, RetrievalConfig, RetrievalSystem
from lexmill.sources import readers

BLOCK = "doc_id bigint, block_idx int, page int, bbox array<double>, height double, text string"
TEXTS = ["Chapter 1 Duties", "The firm shall appoint an officer under article 5.", "Weather and gardening are of no concern here.", "Chapter 2 Fees", "Fees follow Circular CSSF 18/698 in all cases."]


def processed(spark):
    return structure.process(spark.createDataFrame([(1, i, 1 + i // 3, [0.0, 100.0, 1.0, 120.0], 792.0, t) for i, t in enumerate(TEXTS)], BLOCK))


def test_memory(spark, tmp_path):
    system = RetrievalSystem(spark, RetrievalConfig(cache_root=str(tmp_path), top_k=2))
    assert system.search(["x"]).count() == 0 and system.stats() == {"total_documents": 0}
    assert system.answer(["x"]).first().answer == "No relevant information found."
    for _ in range(2):
        system.add_documents(processed(spark))
    assert system.stats() == {"total_documents": 5}
    assert len([p for p in tmp_path.iterdir() if p.is_dir()]) == 1
    best = system.search(["who appoints an officer under article 5?"], 1).first()
    assert best.content == "Chapter 1\n\n" + TEXTS[1]
    row = system.answer(["fees under Circular CSSF 18/698"]).first()
    assert "Circular CSSF 18/698" in row.regulatory_references and row.confidence == 1.0
    assert system.info()["cache_name"] == "local"
    assert {k: c.cache_name() for k, c in PRESETS.items()} == {"unified": "local", "azure": "azure_online", "openai": "openai_online", "index": "azure_search", "minimal": "local"}


def test_index(spark):
    spark.sql("DROP TABLE IF EXISTS passages")
    system = RetrievalSystem(spark, "index")
    system.add_documents(processed(spark))
    assert system.stats() == {"total_documents": 5}
    assert system.search(["what does Circular CSSF 18/698 say of fees in all cases"], 1).first().content.endswith(TEXTS[4])
    system.drop()
    assert not spark.catalog.tableExists("passages")


def test_recognised_lines(spark):
    polygon = "array<struct<x:double,y:double>>"
    lines = spark.createDataFrame([(1, 1, 0, "a", [(3.0, 9.0), (1.0, 4.0)], 700.0, 0.5), (1, 1, 1, "b", None, 700.0, 1.0), (1, 2, 0, "c", [], None, 0.25)], f"doc_id int, page int, line_idx int, text string, polygon {polygon}, height double, confidence double")
    rows = readers.ocr_blocks(lines).orderBy("block_idx").collect()
    assert [(r.block_idx, r.page, r.bbox, r.height, r.text) for r in rows] == [(0, 1, [1.0, 4.0, 3.0, 9.0], 700.0, "a"), (1, 1, [0.0] * 4, 700.0, "b"), (2, 2, [0.0] * 4, 700.0, "c")]
    doc = readers.ocr_documents(lines).first()
    assert (doc.text, doc.page_texts, doc.confidence_scores) == ("a\nb\nc", ["a\nb", "c"], [0.75, 0.25])
    cells = spark.createDataFrame([(1, 0, 0, 1, "y"), (1, 0, 0, 0, "x"), (1, 1, 0, 0, "z")], "doc_id int, table_idx int, row int, column int, content string")
    assert [[c.content for c in t] for t in readers.ocr_tables(cells).first().tables] == [["x", "y"], ["z"]]
