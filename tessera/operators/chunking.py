"""Sections by headers, token-bounded chunks, parents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.sources.tables import small_batches

# Header patterns with levels, sizes ----------------------------------------------------
HEADERS = [
    (r"^#{1,3}\s+.+$", 3),
    (r"^\d+\.?\d*\s+[А-ЯA-Z].+$", 2),
    (r"^[А-ЯA-Z][^.!?]{3,50}:?\s*$", 1),
    (r"^Глава\s+(\d+|[IVXLCDM]+)[.:]?\s*(.+)?$", 3),
    (r"^Раздел\s+(\d+|[IVXLCDM]+)[.:]?\s*(.+)?$", 2),
    (r"^Приложение\s+([А-ЯA-Z\d]+)[.:]?\s*(.+)?$", 2),
]
TOC_LINE, NUMBERED = r"^\d+(?:\.\d+)*\s+.+\s\d{1,4}$", r"^\d+(?:\.\d+)*\s+[А-ЯA-Z]"
PREAMBLE = "Введение"
CHUNK, OVERLAP, LEAST, MOST, TINY = 450, 64, 120, 1200, 40
CHARS, CHAR_CAP, PARENT_CHARS, SHORT = 800, 4000, 800, 80
ABBREVIATIONS = "т|ст|п|пп|гл|разд|прил|рис|табл|см|ср|напр|др|пр"
# --------------------------------------------------------------------------------------------------


def header_level(line: Column) -> Column:
    """1 to 3 for a header line; null for text, contents lines and long numbered sentences."""
    s = F.trim(line)
    level = F.lit(None).cast("int")
    for p, n in reversed(HEADERS):
        level = F.when(s.rlike(p), n).otherwise(level)
    return F.when(s.rlike(TOC_LINE) | (s.rlike(NUMBERED) & (F.length(s) > 100)), F.lit(None).cast("int")).otherwise(level)


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, section_no, title, level, body): runs of lines below each header; sections without text are left out.

    All in windows over a document's own lines: the header count so far numbers the sections.
    """
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    lines = lines.withColumn("level", header_level(F.col("line")))
    w = W.partitionBy("doc_id").orderBy("pos")
    lines = lines.withColumn("section_no", F.sum(F.col("level").isNotNull().cast("int")).over(w).cast("int"))
    part = F.struct("pos", "line")
    g = lines.groupBy("doc_id", "section_no").agg(
        F.max(F.when(F.col("level").isNotNull(), F.trim("line"))).alias("title"), F.max("level").alias("level"),
        F.array_sort(F.collect_list(F.when(F.col("level").isNull(), part))).alias("x"),
    )
    body = F.trim(F.array_join(F.transform("x", lambda r: r.line), "\n"))
    body = F.regexp_replace(body, r"^\s+|\s+$", "")
    return g.select("doc_id", "section_no", F.coalesce("title", F.lit(PREAMBLE)).alias("title"), F.coalesce("level", F.lit(0)).alias("level"), body.alias("body")).where("body <> ''")


def estimate(s: str) -> int:
    """Tokens of a text without its tokenizer."""
    return max(1, len(s) // 4)


def split_sentences(text: str) -> list[str]:
    """Sentences; not after initials and listed abbreviations, nor before a small letter."""
    s = re.sub(r"\b([А-Я])\.\s*([А-Я])\.", "\\1\x00\\2\x00", text)
    s = re.sub(rf"\b({ABBREVIATIONS})\.\s*", "\\1\x00", s, flags=re.I)
    out = re.split(r"(?<=[.!?])\s+(?![а-яё])", s)
    return [x.strip().replace("\x00", ".") for x in out if x.strip()]


def pack_chars(text: str, size: int = CHARS) -> list[str]:
    """Paragraphs, and sentences of longer ones, up to ``size`` characters; one sentence overlaps."""
    out, held, n = [], [], 0

    def flush() -> None:
        nonlocal held, n
        if held:
            out.append("\n\n".join(held))
        held, n = [], 0

    for para in re.split(r"\n\n+", text):
        if len(para) > size:
            flush()
            group, used = [], 0
            for s in split_sentences(para):
                if group and used + len(s) > size:
                    out.append(" ".join(group))
                    group = [group[-1], s] if len(group) > 1 else [s]
                    used = sum(map(len, group))
                else:
                    group.append(s)
                    used += len(s)
            if group:
                out.append(" ".join(group))
        else:
            if n + len(para) > size:
                flush()
            held.append(para)
            n += len(para)
    flush()
    return out


def _tail(parts: list[str], overlap: int, room: int, count) -> list[str]:
    """The last parts that reach ``overlap`` tokens, as far as ``room`` allows."""
    kept, n = [], 0
    for p in reversed(parts):
        size = count(p)
        if n + size > room or n >= overlap:
            break
        kept.insert(0, p)
        n += size
    return kept


def _greedy(parts: list[str], limit: int, overlap: int, glue: str, count) -> list[str]:
    out, held, n = [], [], 0
    for p in parts:
        size = count(p)
        if held and n + size > limit:
            out.append(glue.join(held))
            held = _tail(held, overlap, limit - size, count)
            n = sum(map(count, held))
        held.append(p)
        n += size
    return [*out, glue.join(held)] if held else out


def pack_tokens(text: str, count=estimate, limit: int = CHUNK, overlap: int = OVERLAP, cap: int = CHAR_CAP) -> list[str]:
    """Paragraphs up to ``limit`` tokens with an overlap; longer ones by sentences, sentences by words; at most ``cap`` characters."""
    out, run = [], []
    for para in [p for p in re.split(r"\n{2,}", text.strip()) if p.strip()] + [None]:
        if para is not None and count(para) <= limit:
            run.append(para)
            continue
        out += _greedy(run, limit, overlap, "\n\n", count)
        run = []
        if para is not None:
            sents = []
            for s in split_sentences(para):
                sents += [s] if count(s) <= limit else _greedy(s.split(), limit, 0, " ", lambda w: (len(w) + 1) / 4)
            out += _greedy(sents, limit, overlap, " ", count)
    safe = []
    for c in out:
        while len(c) > cap:
            at = max(c.rfind(" ", 1, cap), c.rfind("\n", 1, cap))
            at = at if at > 0 else cap
            safe.append(c[:at].strip())
            c = c[at:].strip()
        safe.append(c)
    return [c for c in safe if c]


def chunk_sections(rows: list[tuple[str, int, str]], count=estimate, split=pack_chars) -> list[dict]:
    """Chunks of one document from its (title, level, body) sections in order.

    Empty and tiny sections join the chunk before; long ones are split; small ones join if the sum still fits.
    """
    out: list[dict] = []
    squash = lambda s: re.sub(r"\s+", " ", s.lower().replace("ё", "е")).strip()

    def join(title: str, body: str) -> bool:
        both = f"{out[-1]['text']}\n\n{title}\n{body}".strip()
        if count(both) > MOST:
            return False
        out[-1]["text"] = both
        return True

    for title, level, body in rows:
        body = body.strip()
        if squash(body) == squash(title) or len(body) < SHORT:
            if out:
                join(title, body)
            continue
        n = count(body)
        if n > MOST:
            parts = split(body)
        elif n >= LEAST or (n > TINY and out and not join(title, body)):
            parts = [body]
        else:
            continue
        out += [{"section_title": title, "section_level": level, "chunk_index": i, "total_chunks": len(parts), "text": p} for i, p in enumerate(parts)]
    return out


_CHUNKS = "doc_id {0}, page int, section_title string, section_level int, chunk_index int, total_chunks int, text string"


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mode: str = "chars") -> DataFrame:
    """(doc_id, page, section_title, section_level, chunk_index, total_chunks, text, importance); ``page`` numbers a document's chunks from 1.

    Sections are made by windows; then each document's ordered sections are packed by a small function
    (Arrow), since what a section joins depends on what came before.
    """
    small_batches(docs.sparkSession)
    split = pack_chars if mode == "chars" else pack_tokens
    s = sections(docs, id_col, text_col)
    kind = dict(s.dtypes)["doc_id"]
    per_doc = s.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("section_no", "title", "level", "body"))).alias("s"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, secs in zip(b["doc_id"], b["s"], strict=True):
                made = chunk_sections([(x["title"], x["level"], x["body"]) for x in secs], split=split)
                rows += [{"doc_id": doc, "page": i + 1, **c} for i, c in enumerate(made)]
            yield pd.DataFrame(rows, columns=["doc_id", "page", "section_title", "section_level", "chunk_index", "total_chunks", "text"])

    return per_doc.mapInPandas(run, _CHUNKS.format(kind)).withColumn("importance", T.importance(F.col("text")))


def parents(chunks: DataFrame, book: str = "doc_id") -> DataFrame:
    """(book, section, page, text, importance_score, parent_group): a section's first page, greatest importance and the beginning of its joined text."""
    g = chunks.groupBy(F.col(book).alias("book"), F.col("section_title").alias("section")).agg(F.min("page").alias("page"), F.max("importance").alias("importance_score"), F.array_sort(F.collect_list(F.struct("page", "text"))).alias("x"))
    text = F.substring(F.array_join(F.transform("x", lambda r: r.text), "\n\n"), 1, PARENT_CHARS)
    return g.select("book", "section", "page", text.alias("text"), "importance_score", T.group_key(F.col("book").cast("string"), F.col("section")).alias("parent_group"))


def numbered(chunks: DataFrame, book: str = "doc_id") -> DataFrame:
    """``chunks`` with parent_group, parent_title and child_index within their section."""
    n = F.row_number().over(W.partitionBy(book, "section_title").orderBy("page")) - 1
    return chunks.withColumn("child_index", n).withColumn("parent_title", F.col("section_title")).withColumn("parent_group", T.group_key(F.col(book).cast("string"), F.col("section_title")))
