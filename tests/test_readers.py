import json
import threading
import zlib
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from lexmill.operators import structure
from lexmill.sources import pdf, readers

FONT = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding << /Differences [ 1 /fi /emdash ] >> >>"
CMAP = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0001> <0416> endbfchar 1 beginbfrange <0002> <0004> <0430> endbfrange"


def made(pages, packed=True, info=b"/Title (A \\(small\\) file) /Author <FEFF004A00C9> /CreationDate (D:20240101)", bundle=False):
    """A PDF file of content streams, with fonts F1 (one byte) and F2 (two bytes, with a map to characters)."""
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", FONT, b"<< /Type /Font /Subtype /Type0 /ToUnicode 5 0 R /DescendantFonts [ << /DW 600 /W [ 1 [ 700 ] ] >> ] >>", b"<< /Length %d >>\nstream\n%s\nendstream" % (len(CMAP), CMAP)]
    kids = []
    for content in pages:
        body, kind = content.encode("latin-1"), b""
        if packed:
            body, kind = zlib.compress(body), b" /Filter /FlateDecode"
        objects.append(b"<< /Length %d%s >>\nstream\n" % (len(body), kind) + body + b"\nendstream")
        objects.append(b"<< /Type /Page /Parent 2 0 R /Contents [%d 0 R] >>" % len(objects))
        kids.append(len(objects))
    objects[1] = b"<< /Type /Pages /Count %d /MediaBox [0 0 612 792] /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    objects.append(b"<< " + info + b" >>")
    plain = {i + 1: o for i, o in enumerate(objects)}
    out = b"%PDF-1.5\n% a remark (with brackets\n"
    if bundle:  # dictionaries without streams in one compressed object
        small = {i: o for i, o in plain.items() if b"stream" not in o}
        head, body = b"", b""
        for i, o in small.items():
            head += b"%d %d " % (i, len(body))
            body += o + b" "
        raw = zlib.compress(head + body)
        plain = {i: o for i, o in plain.items() if i not in small}
        plain[len(objects) + 1] = b"<< /Type /ObjStm /N %d /First %d /Length %d /Filter /FlateDecode >>\nstream\n" % (len(small), len(head), len(raw)) + raw + b"\nendstream"
    return out + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in plain.items()) + b"trailer << /Root 1 0 R /Info %d 0 R >>\n%%%%EOF" % len(objects)


PAGES = [
    "BT /F1 12 Tf 72 700 Td (Chapter 1 Duties) Tj 0 -40 Td 14 TL (The \\001rm shall) Tj T* [(appoint) -300 (an) -300 (officer)] TJ ET q 1 0 0 1 0 -600 cm BT /F1 8 Tf 72 620 Td (page one) Tj ET Q",
    "BT /F1 12 Tf 1 0 0 1 72 760 Tm (Head) Tj ET BT /F2 10 Tf 72 500 Td <000100020003> Tj ET BT /F1 10 Tf 90 200 Td (left) Tj 30 0 Td (right\\056) Tj ET",
]


@pytest.mark.parametrize("options", [{}, {"packed": False}, {"bundle": True}])
def test_pdf_blocks(options):
    about, pages = pdf.read(made(PAGES, **options))
    assert about == {"title": "A (small) file", "author": "JÉ", "creation_date": "D:20240101"}
    assert [(p.width, p.height) for p in pages] == [(612.0, 792.0)] * 2
    assert pages[0].blocks == [([72.0, 82.4, 168.0, 94.4], "Chapter 1 Duties"), ([72.0, 122.4, 175.2, 148.4], "The ﬁrm shall\nappoint an officer"), ([72.0, 765.6, 104.0, 773.6], "page one")]
    assert [t for _, t in pages[1].blocks] == ["Head", "Жаб", "left right."]


@pytest.mark.parametrize("data", [b"", b"text", b"%PDF-1.4 1 0 obj << /Type /Catalog", made(PAGES).replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 3 0 R"), b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 1 0 R >>\nendobj"])
def test_damaged_pdf(data):
    with pytest.raises(ValueError):
        pdf.read(data)


def test_pdf_files_to_processed_blocks(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(made(PAGES))
    (tmp_path / "b.pdf").write_bytes(b"no PDF")
    docs = {r.filename: r for r in readers.pdf_documents(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    a, b = docs["a.pdf"], docs["b.pdf"]
    assert (a.filename_without_ext, a.extension, a.pages, a.height, a.width, a.title, a.error, len(a.blocks)) == ("a", ".pdf", 2, 792.0, 612.0, "A (small) file", None, 6)
    assert b.blocks is None and "not a PDF" in b.error
    rows = readers.read_pdf_blocks(spark, str(tmp_path))
    assert rows.columns == ["doc_id", "block_idx", "page", "bbox", "height", "text"]
    # The footer and the header lie in the margins.
    assert [r.text for r in structure.drop_margins(rows).orderBy("block_idx").collect()] == ["Chapter 1 Duties", "The ﬁrm shall\nappoint an officer", "Жаб", "left right."]
    assert [r.headers for r in structure.process(rows).orderBy("block_idx").collect()][:2] == ["Chapter 1", "Chapter 1"]


def test_documents_with_metadata(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(made(PAGES))
    (tmp_path / "b.html").write_text("<html><head><title>On &amp; off</title></head><body><h1>Head</h1><ul><li>one<li>two</ul><p>Some <b>bold</b> text</p><table><tr><td>x</td></tr></table><script>no</script></body></html>")
    out = {r.path.rsplit("/", 1)[1]: r for r in readers.read_documents(spark, str(tmp_path)).collect()}
    a, b = out["a.pdf"], out["b.html"]
    assert a.engine == "pymupdf" and a.metadata.page_count == 2 and a.metadata.author == "JÉ" and a.page_texts[0].startswith("Chapter 1 Duties\n\nThe")
    assert b.engine == "unstructured" and b.metadata.title == "On & off" and b.metadata.element_types == ["ListItem", "NarrativeText", "Table", "Title"] and b.metadata.element_count == 5


def test_element_types(spark):
    html = "<header>Top</header><h2>A</h2><p>B <i>c</i></p><ol><li>D</li></ol><style>no</style><table><tr><td>E</td><td>F</td></tr></table><footer>G</footer>H"
    assert readers.html_elements(html) == [("Header", "Top"), ("Title", "A"), ("NarrativeText", "B c"), ("ListItem", "D"), ("Table", "E F"), ("Footer", "G"), ("NarrativeText", "H")]
    row = spark.createDataFrame([(html,), (None,)], "html string").select(readers.elements(__import__("pyspark.sql.functions", fromlist=["col"]).col("html")).alias("e")).collect()
    assert row[0].e[1].type == "Title" and row[1].e is None


@pytest.fixture
def service():
    """A service that is busy once and then answers."""
    asked = []
    result = {"pages": [{"pageNumber": 1, "height": 11.0, "lines": [{"content": "a", "polygon": [1, 2, 3, 2, 3, 4, 1, 4]}, {"content": "b"}], "words": [{"confidence": 0.5}, {"confidence": 1.0}]}]}

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            asked.append((self.path, self.headers["Ocp-Apim-Subscription-Key"], body))
            self.send_response(202 if body != b"bad" else 400)
            self.send_header("Operation-Location", f"http://127.0.0.1:{self.server.server_port}/result")
            self.end_headers()

        def do_GET(self):
            asked.append(self.path)
            done = asked.count(self.path) > 1
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"status": "succeeded", "analyzeResult": result} if done else {"status": "running"}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked
    server.shutdown()


def test_recognition_service(spark, service):
    url, asked = service
    config = readers.ReaderConfig(endpoint=url, key="secret")
    assert "azure_document_intelligence" not in readers.available() and "azure_document_intelligence" not in readers.available(readers.ReaderConfig(url, "k", ocr_fallback=False))
    files = spark.createDataFrame([("x.png", 20_000_000, bytearray(b"picture"))], "path string, length bigint, content binary")
    row = readers.extract(files, config=config).first()
    assert row.engine == "azure_document_intelligence" and row.page_texts == ["a\nb"] and row.metadata.confidence == 0.75
    assert asked[0][0].startswith("/documentintelligence/documentModels/prebuilt-layout:analyze") and asked[0][1:] == ("secret", b"picture")
    lines = readers.recognised_lines(spark.createDataFrame([("x", bytearray(b"p")), ("y", bytearray(b"bad"))], "path string, content binary"), config)
    good, bad = lines.where("error IS NULL"), lines.where("error IS NOT NULL").collect()
    assert [(r.text, r.bbox, r.height) for r in readers.ocr_blocks(good).orderBy("block_idx").collect()] == [("a", [1.0, 2.0, 3.0, 4.0], 11.0), ("b", [0.0] * 4, 11.0)]
    assert [r.doc_id for r in bad] == ["y"] and readers.ocr_documents(good).first().confidence_scores == [0.75]
