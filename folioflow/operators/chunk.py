r"""Heading-aware chunking of logical pages, as folds over arrays inside the JVM.

A page's blocks are its level-3 headings with their bodies.  Runs of headings
without a body join the next block that has one; bodies are packed into segments
of a soft maximum, tables whole; a page that does not start with a heading
inherits the last one of the pages before it.  Order is by ``page_seq`` within
``doc_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import CONTINUED, TABLE, quoted, strip, strip_sql

HEADING = r"(?md)^###(?U:\s+)(.+)$"
#: How a line may end, and the next one begin, for a cut between them.
SENTENCE_END = r"[.:;!?]$"
LIST_START = r"(?U)^(?:[-*•]|\d+\.)"
UNTITLED = "Tài liệu"
BLOCK = "array<struct<heading:string,body:string>>"


def clean_heading(title: str) -> str:
    """SQL for a heading without the mark of continuation."""
    return strip_sql(f"regexp_replace({title}, {quoted(r'(?Ud)\s*\(Tiếp tục\)\s*$')}, '')")


def heading_blocks(content: Column) -> Column:
    """Split a page into (heading, body) blocks; text before the first heading has none."""
    text = F.replace(content, F.lit("\r\n"), F.lit("\n"))
    titles = F.regexp_extract_all(text, F.lit(HEADING), F.lit(1))
    bodies = F.split(text, HEADING)
    blocks = F.zip_with(F.concat(F.array(F.lit("")), titles), bodies, lambda t, b: F.struct(strip(t).alias("heading"), strip(b).alias("body")))
    # The part before the first heading counts only if it holds text, or if it is all there is.
    first = (F.size(titles) == 0) | (F.length(F.element_at(blocks, 1)["body"]) > 0)
    return F.when(first, blocks).otherwise(F.slice(blocks, 2, F.greatest(F.size(blocks) - 1, F.lit(0))))


def merge_headings(blocks: str) -> Column:
    """Join headings without a body to the next block with one; those at the end to the last block.

    The fold keeps the waiting titles and raw heading lines.  Of equal waiting
    titles in a row the first raw line stays; one that equals the title of the
    block it waits for gives way to it.
    """
    empty = "cast(array() AS array<string>)"
    start = f"named_struct('names', {empty}, 'raws', {empty}, 'done', cast(array() AS array<struct<heading:string,prefix:string,body:string>>))"
    title = clean_heading("b.heading")
    raw = "if(b.heading = '', '', concat('### ', b.heading))"
    wait = f"""if(size(s.names) > 0 AND element_at(s.names, -1) = {title}, s,
        named_struct('names', concat(s.names, array({title})), 'raws', concat(s.raws, array({raw})), 'done', s.done))"""
    twin = f"(size(s.names) > 0 AND {title} <> '' AND element_at(s.names, -1) = {title})"
    cut = lambda a: f"if({twin}, slice(s.{a}, 1, greatest(size(s.{a}) - 1, 0)), s.{a})"
    emit = f"""named_struct('names', {empty}, 'raws', {empty}, 'done', concat(s.done, array(named_struct(
        'heading', array_join(concat({cut('names')}, filter(array({title}), t -> t <> '')), ' > '),
        'prefix', array_join(concat({cut('raws')}, if({title} = '' AND size({cut('raws')}) > 0, {empty}, array({raw}))), '\\n\\n'),
        'body', b.body))))"""
    step = f"(s, b) -> CASE WHEN b.heading = '' AND b.body = '' THEN s WHEN b.body = '' THEN {wait} ELSE {emit} END"
    tail = """CASE WHEN size(s.names) = 0 THEN s.done
        WHEN size(s.done) = 0 THEN array(named_struct('heading', array_join(s.names, ' > '), 'prefix', array_join(s.raws, '\\n\\n'), 'body', ''))
        ELSE concat(slice(s.done, 1, size(s.done) - 1), array(named_struct(
            'heading', concat(element_at(s.done, -1).heading, ' > ', array_join(s.names, ' > ')),
            'prefix', concat(element_at(s.done, -1).prefix, '\\n\\n', array_join(s.raws, '\\n\\n')),
            'body', element_at(s.done, -1).body))) END"""
    return F.expr(f"aggregate({blocks}, {start}, {step}, s -> {tail})")


def _pack(items: str, fits: str, joint: str, room: str) -> str:
    """SQL fold that joins items while they fit; ``fits`` may also force an overflow."""
    start = "named_struct('held', cast(NULL AS string), 'last', '', 'done', cast(array() AS array<string>))"
    step = f"""(s, x) -> CASE WHEN s.held IS NULL THEN named_struct('held', x, 'last', x, 'done', s.done)
        WHEN length(s.held) + {len(joint)} + length(x) > {room} AND ({fits}) THEN named_struct('held', x, 'last', x, 'done', concat(s.done, array(s.held)))
        ELSE named_struct('held', concat(s.held, {quoted(joint) if joint != chr(10) * len(joint) else "'" + '\\n' * len(joint) + "'"}, x), 'last', x, 'done', s.done) END"""
    return f"aggregate({items}, {start}, {step}, s -> concat(s.done, filter(array(s.held), h -> h IS NOT NULL)))"


def line_segments(paragraph: str, room: str) -> str:
    """SQL that packs the lines of a paragraph, cutting only where a sentence or list item ends."""
    lines = f"filter(transform(split({paragraph}, '\\n'), l -> {strip_sql('l')}), l -> l <> '')"
    return _pack(lines, f"s.last RLIKE {quoted(SENTENCE_END)} OR x RLIKE {quoted(LIST_START)}", "\n", room)


def paragraph_segments(block: str, room: str) -> str:
    """SQL that packs blank-line paragraphs; one longer than the room is packed by lines on its own."""
    paragraphs = f"filter(transform(split({block}, '\\n\\n'), p -> {strip_sql('p')}), p -> p <> '')"
    start = "named_struct('held', cast(NULL AS string), 'done', cast(array() AS array<string>))"
    flush = "concat(s.done, filter(array(s.held), h -> h IS NOT NULL))"
    step = f"""(s, p) -> CASE WHEN length(p) > {room} THEN named_struct('held', cast(NULL AS string), 'done', concat({flush}, {line_segments('p', room)}))
        WHEN s.held IS NULL THEN named_struct('held', p, 'done', s.done)
        WHEN length(s.held) + 2 + length(p) > {room} THEN named_struct('held', p, 'done', concat(s.done, array(s.held)))
        ELSE named_struct('held', concat(s.held, '\\n\\n', p), 'done', s.done) END"""
    return f"aggregate({paragraphs}, {start}, {step}, s -> {flush})"


def body_segments(body: str, room: str) -> str:
    """SQL that cuts a body into segments of a soft maximum, with tables whole."""
    table = quoted(TABLE)
    pieces = f"flatten(zip_with(split({body}, {table}), regexp_extract_all({body}, {table}, 0), (t, x) -> array(t, x)))"
    blocks = f"filter(transform({pieces}, p -> {strip_sql('p')}), p -> p IS NOT NULL AND p <> '')"
    whole = "(lower(blk) LIKE '<table%' AND lower(blk) LIKE '%</table>')"
    return f"if(length({body}) <= {room}, array({body}), flatten(transform({blocks}, blk -> if({whole}, array(blk), {paragraph_segments('blk', room)}))))"


def carry_headings(pages: DataFrame) -> DataFrame:
    """Add ``text``: the content, under the inherited heading if it does not start with one.

    The heading after a page is its own last one, cleaned and without its path;
    a page without any keeps what came before it.  So the inherited heading is
    the last own heading of earlier pages, else the seed of the first page that
    was continued, else the page's own seed.  Blank pages are dropped first.  Only
    headings go through the window over a document; they are joined back to the
    texts by (doc_id, page_seq), which is taken to be unique.
    """
    body = F.replace(F.coalesce("content", F.lit("")), F.lit("\r\n"), F.lit("\n"))
    seed = F.coalesce(F.expr("nullif(try_element_at(current_headings, -1), '')"), F.expr("nullif(section, '')"), F.expr("nullif(chapter, '')"), F.lit(UNTITLED))
    last = F.expr(f"nullif({strip_sql(clean_heading('element_at(split(own, quote), -1)'))}, '')".replace("quote", "' > '"))
    named = pages.withColumn("text", body).where(F.length(strip(F.col("text"))) > 0)
    named = named.withColumn("own", F.expr(f"try_element_at(regexp_extract_all(text, {quoted(HEADING)}, 1), -1)")).withColumn("own", last)
    starts = strip(F.col("text")).startswith("###")
    path = F.expr(f"nullif({clean_heading('element_at(split(seed, quote), -1)')}, '')".replace("quote", "' > '"))
    named = named.withColumn("seed", seed).withColumn("continued", ~starts).withColumn("given", F.when(F.col("continued"), path))
    before = Window.partitionBy("doc_id").orderBy("page_seq").rowsBetween(Window.unboundedPreceding, -1)
    inherited = F.coalesce(F.last("own", True).over(before), F.first("given", True).over(before), F.col("seed"))
    narrow = named.select("doc_id", "page_seq", "own", "given", "seed").withColumn("inherited", inherited)
    narrow = narrow.select(F.col("doc_id").alias("_doc"), F.col("page_seq").alias("_page"), "inherited")
    named = named.join(narrow, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("page_seq") == F.col("_page"))).drop("_doc", "_page")
    return named.withColumn("text", F.when(F.col("continued"), F.concat(F.lit("### "), F.col("inherited"), F.lit(CONTINUED + "\n\n"), F.col("text"))).otherwise(F.col("text"))).drop("own", "seed", "given")


def chunk_pages(pages: DataFrame, max_chars: int = 2000) -> DataFrame:
    """Return chunks of pages (doc_id, page_seq, logical_page, pdf_page, chapter, section, current_headings, content).

    ``chunk_seq`` is (page_seq, block, segment), so chunks are ordered without a
    shuffle; number them with ``row_number`` over it where ids are wanted.
    """
    carried = carry_headings(pages).withColumn("blocks", heading_blocks(F.col("text"))).withColumn("merged", merge_headings("blocks"))
    block = carried.select("doc_id", "page_seq", "logical_page", "pdf_page", "chapter", "section", F.posexplode("merged").alias("block", "m"))
    block = block.withColumn("prefix", strip(F.col("m.prefix"))).withColumn("body", F.col("m.body"))
    block = block.withColumn("room", F.greatest(max_chars - F.when(F.col("prefix") != "", F.length("prefix") + 2).otherwise(0), F.lit(1)))
    parts = F.when(F.col("body") == "", F.array("prefix")).otherwise(
        F.transform(F.expr(body_segments("body", "room")), lambda s: F.when(F.col("prefix") != "", F.concat("prefix", F.lit("\n\n"), s)).otherwise(s))
    )
    out = block.select("doc_id", "page_seq", "block", F.posexplode(parts).alias("segment", "content"), "logical_page", "pdf_page", "chapter", "section", F.col("m.heading").alias("current_heading"))
    return out.select("doc_id", F.struct("page_seq", "block", "segment").alias("chunk_seq"), "logical_page", "pdf_page", "chapter", "section", "current_heading", "content")
