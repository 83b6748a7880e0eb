"""Text cut into chunks: windows, packing, headings, breaks and markers.

Packing and marker segments are folds over the pieces of one text, written as aggregate()
over arrays, so that rows stay in the JVM and no shuffle is needed.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.functions import extract as X
from lexmill.functions.text import strip
from lexmill.functions.vector import cosine
from lexmill.operators.structure import _pairs, in_order

_SENTENCE = r"(?U)(?<=[.!?])\s+"


def slide(blocks: DataFrame, least: int = 100, most: int = 500, overlap: float = 0.15) -> DataFrame:
    """blocks with chunk_id; those of more than most characters cut into windows that overlap.

    Blocks of fewer than least characters are dropped, those that fit pass with a null
    chunk_id, and windows that hold white space only are left out.
    """
    if not 0 <= overlap < 1:
        raise ValueError("overlap must be at least 0 and below 1")
    step = most - int(most * overlap)
    body = strip(F.col("text"))
    size = F.length(body)

    def cut(b: Column) -> Column:
        count = F.ceil((F.length(b) - most) / step).cast("int") + 1
        windows = F.transform(F.sequence(F.lit(0), count - 1), lambda k: strip(F.substring(b, k * step + 1, F.lit(most))))
        return F.when(F.length(b) <= most, F.array("text")).otherwise(F.filter(windows, lambda c: c != ""))

    rows = blocks.where((size >= least) & (size > 0))
    # The stripped text is bound to a variable, lest every window strip it anew.
    pieces = F.transform(F.array(body), cut)[0]
    rows = rows.select("*", (size > most).alias("split"), F.posexplode(pieces).alias("k", "piece"))
    return rows.withColumns({"text": F.col("piece"), "chunk_id": F.when(F.col("split"), F.col("k"))}).drop("split", "k", "piece")


def pack(pieces: Column, separator: str, most: int) -> Column:
    """Pieces joined in order into as few chunks as fit; a piece that doesn't fit is a chunk of its own."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("cur"))

    def add(acc: Column, piece: Column) -> Column:
        joined = F.concat(acc["cur"], F.lit(separator), piece)
        full = F.length(joined) > most
        out = F.when(acc["cur"].isNotNull() & full, F.concat(acc["out"], F.array(acc["cur"]))).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.when(acc["cur"].isNull() | full, piece).otherwise(joined).alias("cur"))

    return F.aggregate(pieces, start, add, lambda acc: F.when(acc["cur"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["cur"]))))


def _fits(chunks: Column, most: int) -> Column:
    return F.forall(chunks, lambda c: F.length(c) <= most)


def pack_blocks(blocks: DataFrame, most: int = 2000) -> DataFrame:
    """blocks with chunk_id; those of more than most characters packed by paragraphs, else sentences, else words."""
    size = F.length("text")
    big = size > most
    text = F.when(big, F.col("text"))
    paragraphs = pack(F.split(text, "\n\n"), "\n\n", most)
    sentences = F.split(text, _SENTENCE)
    packed = pack(sentences, " ", most)
    words = pack(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""), " ", most)
    chosen = F.when(text.contains("\n\n") & _fits(paragraphs, most), paragraphs).when((F.size(sentences) > 1) & _fits(packed, most), packed).otherwise(words)
    small = blocks.where(~big).withColumn("chunk_id", F.lit(None).cast("int"))
    large = blocks.where(big).select("*", F.posexplode(chosen).alias("k", "piece")).withColumns({"text": F.col("piece"), "chunk_id": F.col("k")}).drop("k", "piece")
    return small.unionByName(large)


_W = r"\s+"
HEADING = rf"(?md)^(?:Part{_W}\w+|Chapter{_W}\d+|Sub-chapter{_W}\d+\.\d+|Section{_W}\d+\.\d+\.\d+).*?$"


def heading_sections(docs: DataFrame) -> DataFrame:
    """(doc_id, chunk_idx, heading, content, hierarchy, n_headings) of the text between a heading line and the next.

    docs: (doc_id, text). What stands before the first heading is lost, and sections
    without content are dropped.
    """
    text = F.col("text")
    headings = F.regexp_extract_all(text, F.lit(HEADING), F.lit(0))
    between = F.slice(F.split(text, HEADING), 2, 2**30)
    rows = docs.select("doc_id", F.size(headings).alias("n_headings"), F.posexplode(F.arrays_zip(headings.alias("h"), between.alias("c"))).alias("chunk_idx", "s"))
    rows = rows.select("doc_id", "chunk_idx", strip(F.col("s.h")).alias("heading"), strip(F.col("s.c")).alias("content"), "n_headings")
    return rows.where("content <> ''").withColumn("hierarchy", F.array("heading"))


def heading_gate(docs: DataFrame) -> DataFrame:
    """(doc_id, n_headings, structured): three headings at least, and 100 to 10,000 characters for each."""
    n = F.size(F.regexp_extract_all("text", F.lit(HEADING), F.lit(0)))
    return docs.select("doc_id", n.alias("n_headings"), _structured(n).alias("structured"))


def _structured(n: Column) -> Column:
    mean = F.length("text") / F.nullif(n, F.lit(0))
    return F.coalesce((n >= 3) & (mean >= 100) & (mean <= 10000), F.lit(False))


BREAKS = (r"\n\n+", r"\n\d+\.\s+", r"\n[•\-*]\s+", r"\n[A-Z][a-z]+:", r"\n(?=\([a-z]\))")


def semantic_sections(docs: DataFrame, most: int = 1000) -> DataFrame:
    """(doc_id, chunk_idx, heading, content): text split at the first kind of break that it has, packed up to most characters."""
    parts = F.lit(None).cast("array<string>")
    for pattern in reversed(BREAKS):
        split = F.split("text", pattern)
        parts = F.when(F.size(split) > 1, split).otherwise(parts)
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))

    def add(acc: Column, part: Column) -> Column:
        fits = F.length(acc["cur"]) + F.length(part) <= most
        out = F.when(~fits & (strip(acc["cur"]) != ""), F.concat(acc["out"], F.array(strip(acc["cur"])))).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.when(fits, F.concat(acc["cur"], part, F.lit("\n\n"))).otherwise(F.concat(part, F.lit("\n\n"))).alias("cur"))

    chunks = F.aggregate(parts, start, add, lambda a: F.when(strip(a["cur"]) != "", F.concat(a["out"], F.array(strip(a["cur"])))).otherwise(a["out"]))
    rows = docs.select("doc_id", F.posexplode(chunks).alias("chunk_idx", "content"))
    return rows.withColumn("heading", F.concat(F.lit("Section "), (F.col("chunk_idx") + 1).cast("string")))


def split_recursively(text: str, most: int, overlap: int, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ", "")) -> list[str]:
    """Pieces of at most most characters, cut at the first separator that the text has and, within longer parts, at those after it.

    Neighbouring parts are joined while they fit, and a piece begins with the last parts of
    the one before, up to overlap characters. A single part that no separator cuts is cut
    by characters.
    """
    if len(text) <= most:
        return [text] if text.strip() else []
    sep = next(s for s in separators if s == "" or s in text)
    rest = separators[separators.index(sep) + 1 :] or ("",)
    parts = text.split(sep) if sep else [text[i : i + 1] for i in range(len(text))]
    out: list[str] = []
    held: list[str] = []
    size = 0

    def flush() -> None:
        nonlocal held, size
        piece = sep.join(held).strip()
        if piece:
            out.append(piece)
        while held and (size > overlap):
            size -= len(held.pop(0)) + (len(sep) if held else 0)

    for part in parts:
        if len(part) > most:
            if held:
                flush()
                held, size = [], 0
            out += split_recursively(part, most, overlap, rest)
            continue
        if held and size + len(sep) + len(part) > most:
            flush()
            while held and size + len(sep) + len(part) > most:
                size -= len(held.pop(0)) + (len(sep) if held else 0)
        size += len(part) + (len(sep) if held else 0)
        held.append(part)
    piece = sep.join(held).strip()
    if piece:
        out.append(piece)
    return out


def recursive_pieces(text: Column, most: int, overlap: int) -> Column:
    """split_recursively over a column."""
    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.string())
        cut = lambda some: pa.array([None if t is None else split_recursively(t, most, overlap) for t in some.to_pylist()], kind)
        return pa.concat_arrays([pa.array([], kind), *(cut(texts.slice(at, 256)) for at in range(0, len(texts), 256))])

    return run(text)


def split_oversize(sections: DataFrame, most: int, overlap: int) -> DataFrame:
    """Sections (doc_id, chunk_idx, heading, content, ...) of more than most characters as parts, numbered in their heading."""
    size = F.length("content")
    rows = sections.withColumn("parts", recursive_pieces(F.when(size > most, F.col("content")), most, overlap)).select("*", F.posexplode_outer("parts").alias("part", "piece"))
    rows = rows.where((size <= most) | F.col("part").isNotNull())
    numbered = F.coalesce(F.concat("heading", F.lit(" (Part "), (F.col("part") + 1).cast("string"), F.lit(")")), F.col("heading"))
    return rows.select(*(c for c in sections.columns if c not in ("heading", "content")), numbered.alias("heading"), F.coalesce("piece", "content").alias("content"), "part").select(*sections.columns, "part")


def chunk_by_headings(docs: DataFrame, most: int = 2000, overlap: int = 200) -> DataFrame:
    """Sections by heading, long ones in parts; a text without headings has none."""
    return split_oversize(heading_sections(docs).drop("n_headings"), most, overlap)


def chunk_with_fallback(docs: DataFrame, most: int = 1000, overlap: int = 70) -> DataFrame:
    """(doc_id, chunk_idx, part, heading, content, hierarchy, method): by headings where the structure is sound, else by breaks, else by size."""
    columns = ["doc_id", "chunk_idx", "part", "heading", "content", "hierarchy", "method"]
    # Each document's own row tells whether it has sections, so that no join is needed.
    sound = _structured(F.size(F.regexp_extract_all("text", F.lit(HEADING), F.lit(0))))
    filled = F.exists(F.slice(F.split("text", HEADING), 2, 2**30), lambda c: strip(c) != "")
    first = split_oversize(heading_sections(docs.where(sound)).drop("n_headings"), most, overlap).withColumn("method", F.lit("headings"))
    rest = docs.where(~(sound & F.coalesce(filled, F.lit(False))))
    has_break = F.lit(False)
    for pattern in BREAKS:
        has_break = has_break | (F.size(F.split("text", pattern)) > 1)
    second = semantic_sections(rest.where(has_break), most).withColumns({"hierarchy": F.array("heading"), "part": F.lit(None).cast("int"), "method": F.lit("breaks")})
    third = rest.where(~has_break).select("doc_id", F.posexplode(recursive_pieces(F.col("text"), most, overlap)).alias("chunk_idx", "content"))
    line = F.substring(F.split("content", "\n")[0], 1, 50)
    number = F.concat(F.lit("Part "), (F.col("chunk_idx") + 1).cast("string"))
    title = F.concat(number, F.lit(": "), F.when(F.length(line) > 40, F.concat(F.substring(line, 1, 40), F.lit("..."))).otherwise(line))
    third = third.withColumns({"heading": title, "hierarchy": F.array(number), "part": F.lit(None).cast("int"), "method": F.lit("size")})
    return first.select(columns).unionByName(second.select(columns)).unionByName(third.select(columns))


def marker_segments(docs: DataFrame, most: int = 2000) -> DataFrame:
    """(doc_id, chunk_idx, chunk_id, content, section_hierarchy, start_position, end_position, ...) of runs of lines.

    A line with a marker begins a segment; one that grows beyond most characters ends
    after the line that made it so.
    """
    lines = F.transform(F.split("text", "\n"), lambda line, i: F.struct(i.alias("i"), line.alias("line"), X.marker_kind(line).alias("kind"), X.marker_text(line).alias("mark")))
    segment = "struct<content:string,start:int,stop:int,path:array<string>>"
    start = F.struct(
        F.array().cast(f"array<{segment}>").alias("out"), F.lit("").alias("cur"), F.lit(0).alias("begin"), F.array().cast("array<string>").alias("path")
    )

    def put(acc: Column, stop: Column, body: Column, path: Column) -> Column:
        done = F.struct(strip(body).alias("content"), acc["begin"].alias("start"), stop.alias("stop"), path.alias("path"))
        return F.when(strip(body) != "", F.concat(acc["out"], F.array(done))).otherwise(acc["out"])

    def add(acc: Column, x: Column) -> Column:
        line = F.concat(x["line"], F.lit("\n"))
        level = F.array_position(F.array(*map(F.lit, X.NESTED)), x["kind"]).cast("int")
        path = F.when(level > 0, F.concat(F.slice(acc["path"], F.lit(1), level - 1), F.array(x["mark"]))).otherwise(acc["path"])
        grown = F.concat(acc["cur"], line)
        full = F.length(grown) > most
        at_marker = F.struct(put(acc, x["i"], acc["cur"], acc["path"]).alias("out"), line.alias("cur"), x["i"].alias("begin"), path.alias("path"))
        # A full segment of white space only is dropped like any other without content.
        plain = F.struct(
            F.when(full, put(acc, x["i"], grown, acc["path"])).otherwise(acc["out"]).alias("out"),
            F.when(full, F.lit("")).otherwise(grown).alias("cur"),
            F.when(full, x["i"] + 1).otherwise(acc["begin"]).alias("begin"),
            acc["path"].alias("path"),
        )
        return F.when(x["kind"].isNotNull(), at_marker).otherwise(plain)

    count = F.size(F.split("text", "\n"))
    segments = F.aggregate(lines, start, add, lambda acc: put(acc, count, acc["cur"], acc["path"]))
    rows = docs.select("doc_id", F.posexplode(segments).alias("chunk_idx", "s"))
    rows = rows.select("doc_id", "chunk_idx", F.col("s.content").alias("content"), F.col("s.path").alias("section_hierarchy"), F.col("s.start").alias("start_position"), F.col("s.stop").alias("end_position"))
    return describe(rows)


def describe(chunks: DataFrame) -> DataFrame:
    """chunks with chunk_id, chunk_type, legal_citations and cross_references."""
    c = F.col("content")
    name = F.concat(F.lit("chunk_"), F.col("start_position").cast("string"), F.lit("_"), F.col("end_position").cast("string"))
    return chunks.withColumns({"chunk_id": name, "chunk_type": X.chunk_kind(c), "legal_citations": X.citations(c), "cross_references": X.cross_references(c)})


def merge_small(chunks: DataFrame, least: int = 200, threshold: float = 0.7) -> DataFrame:
    """Small chunks (doc_id, chunk_idx, ..., embedding) merged with the next one where the two are similar; pairs only."""
    rows = chunks.withColumnRenamed("chunk_idx", "block_idx")
    following = F.lead(F.struct(*(c for c in rows.columns if c not in ("doc_id", "block_idx")))).over(in_order())
    rows = rows.withColumn("next", following)
    near = F.coalesce(cosine(F.col("embedding"), F.col("next.embedding")) > threshold, F.lit(False))
    rows = rows.withColumn("flag", F.col("next").isNotNull() & (F.length("content") < least) & near)
    rows = _pairs(rows, "flag").where("role < 2")
    pair = F.col("role") == 1
    both = {
        "chunk_id": F.when(pair, F.concat(F.lit("merged_"), F.col("chunk_id"), F.lit("_"), F.col("next.chunk_id"))).otherwise(F.col("chunk_id")),
        "content": F.when(pair, F.concat(F.col("content"), F.lit("\n\n"), F.col("next.content"))).otherwise(F.col("content")),
        "legal_citations": F.when(pair, F.concat("legal_citations", F.col("next.legal_citations"))).otherwise(F.col("legal_citations")),
        "cross_references": F.when(pair, F.concat("cross_references", F.col("next.cross_references"))).otherwise(F.col("cross_references")),
        "end_position": F.when(pair, F.col("next.end_position")).otherwise(F.col("end_position")),
    }
    return rows.withColumns(both).drop("next", "flag", "role").withColumnRenamed("block_idx", "chunk_idx")


def add_overlap(chunks: DataFrame, overlap: float = 0.15) -> DataFrame:
    """chunks with the end of the one before in front, as many characters as overlap of their own, and overlap_with.

    Where that is no character at all, the whole one before is put in front. The one
    before counts as it was, without an overlap of its own; a shorter one isn't used.
    """
    order = Window.partitionBy("doc_id").orderBy("chunk_idx")
    size = F.floor(F.length("content") * overlap).cast("int")
    before = F.lag("content").over(order)
    rows = chunks.withColumns({"size": size, "before": before, "before_id": F.lag("chunk_id").over(order)})
    tail = F.when(F.col("size") == 0, F.col("before")).otherwise(F.substr("before", F.length("before") - F.col("size") + 1))
    fits = F.coalesce(F.length("before") > F.col("size"), F.lit(False))
    rows = rows.withColumn("overlap_with", F.when(fits, F.array("before_id")))
    return rows.withColumn("content", F.when(fits, F.concat(tail, F.lit("\n"), F.col("content"))).otherwise(F.col("content"))).drop("size", "before", "before_id")


def drop_small_chunks(chunks: DataFrame, least: int = 200) -> DataFrame:
    return chunks.where(F.length("content") >= least)


def chunk_statistics(chunks: DataFrame, column: str = "content") -> DataFrame:
    n = F.length(column)
    return chunks.agg(F.count("*").alias("n_chunks"), F.avg(n).alias("avg_length"), F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.sum(n).alias("total_length"))


def hybrid(docs: DataFrame, embed, least: int = 200, most: int = 2000, overlap: float = 0.15) -> DataFrame:
    """Marker segments, embedded by embed(chunks, column), small ones merged, overlaps added, and small ones dropped."""
    rows = merge_small(embed(marker_segments(docs, most), "content"), least).drop("embedding")
    return drop_small_chunks(add_overlap(rows, overlap), least)
