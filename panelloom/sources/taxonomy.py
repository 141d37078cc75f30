"""Classification notes: ordered document lines to one structured text per code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.codes import with_hierarchy
from ..functions.text import limit_text, normalize_space, repair_text
from ..functions.once import once
from ..operators.pick import keep_first
from ..operators.scan import CHUNK_LINES, chunked, running, spread

#: How the notes are laid out.
CODE_HEADING = r"^(\d{4})\s+(.+)$"
LOWER_HEADING = r"^(\d{1,3}|[A-Z])\s+"
DEFINITION_START = r"^(El|La|Los|Las|Este|Esta|Estos|Estas|En este|Se incluyen|Nota:)"
SECTION_MARKERS = {
    "Entre sus tareas se incluyen:": "tasks",
    "Ejemplos de ocupaciones incluidas en este grupo primario": "examples",
    "Ocupaciones afines no incluidas en este grupo primario": "excluded",
}
STOP_MARKERS = ["Anexo I", "Cambios respecto a la versión anterior del documento",
                "Cambios respecto a la version anterior del documento"]
#: section -> (label, separator, character limit, lines are bullets)
SECTIONS = {
    "definition": ("Definition: ", " ", 1200, False),
    "tasks": ("Typical tasks: ", " ", 1200, True),
    "examples": ("Examples included: ", "; ", 700, True),
    "excluded": ("Related or excluded occupations: ", "; ", 700, True),
}


def is_stop_line(line: Column) -> Column:
    bare = F.regexp_replace(normalize_space(line), r"^[ ;:.\-]+|[ ;:.\-]+$", "")
    out = F.lit(False)
    for marker in STOP_MARKERS:
        out = out | F.startswith(bare, F.lit(marker))
    return out


def segment(lines: DataFrame, doc: str = "doc", line_no: str = "line_no", text: str = "text", page: str | None = None,
            first_page: int = 3, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """Lines that belong to a code: ``doc, record, line_no, code, part, text``.

    ``part`` is ``heading``, ``title`` (continuation) or ``body``; ``record`` is the line number of the code's heading.
    Everything from the first stop line of a document on is cut.
    """
    source = lines.where(F.col(page) >= first_page) if page else lines
    rows = source.select(F.col(doc).alias("doc"), F.col(line_no).cast("long").alias("line_no"), F.col(text).alias("text"))
    rows = spread(rows, ["doc"], "line_no", chunk_lines)
    clean = once(rows, text=normalize_space(F.replace("text", F.lit("\u00ad"), F.lit("")))).where("text <> ''")
    heading = F.col("text").rlike(CODE_HEADING)
    body_start = ~heading & (F.col("text").rlike(DEFINITION_START) | F.col("text").rlike(LOWER_HEADING))
    at = F.col("line_no")
    marked = running(clean, ["doc"], "line_no", {
        "stop": ("max", F.when(is_stop_line(F.col("text")), at)),
        "record": ("max", F.when(heading, at)),
        "body": ("max", F.when(body_start, at)),
        "code": ("last", F.when(heading, F.regexp_extract("text", CODE_HEADING, 1))),
    }, chunk_lines=chunk_lines)
    part = F.when(heading, "heading").when(F.col("body") > F.col("record"), "body").otherwise("title")
    return marked.where("stop IS NULL AND record IS NOT NULL").select("doc", "record", "line_no", "code",
                                                                      part.alias("part"), "text")


def structured_texts(parts: DataFrame, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """One row per (doc, record): code, title and the sectioned text of parts as ``segment`` returns them."""
    in_body, heading = F.col("part") == "body", F.col("part") == "heading"
    own = F.when(in_body, repair_text("text")).when(heading, F.regexp_extract("text", CODE_HEADING, 2)).otherwise(F.col("text"))
    rows = once(spread(parts, ["doc", "record"], "line_no", chunk_lines), _t=own)
    placed = chunked(rows.withColumn("_mark", F.when(in_body, F.try_element_at(_map(SECTION_MARKERS), F.col("_t")))), "line_no", chunk_lines)
    placed = running(placed, ["doc", "record"], "line_no", {"section": ("last", F.col("_mark"))})
    return _assembled(placed, ["doc", "record"], None)


def _assembled(placed: DataFrame, by: list[str], boundary: Column | None) -> DataFrame:
    """One row per (doc, record) from chunked lines with part, code, _t, _mark and the section the last marker opened.

    Lines that start beyond a section's character limit cannot show in its cut text, so only the ones before it are
    brought together: a section never gathers more lines than its limit holds.
    """
    keys, in_body = ["doc", "record"], F.col("part") == "body"
    lower = in_body & F.col("_t").rlike(LOWER_HEADING) & ~F.startswith("_t", F.lit("-"))
    bulleted = F.col("section").isin([s for s, spec in SECTIONS.items() if spec[3]])
    section = F.when(~in_body, "title").otherwise(F.coalesce("section", F.lit("definition")))
    bare = F.when(in_body & bulleted, normalize_space(F.regexp_replace("_t", "^-", ""))).otherwise(F.col("_t"))
    shown = ~(in_body & (F.col("_t") == "")) & F.col("_mark").isNull() & ~lower
    placed = placed.withColumns({"_shown": F.coalesce(shown, F.lit(False)), "_bare": bare}).withColumn("section", section)

    of = lambda i, other: F.coalesce(F.try_element_at(_map({s: spec[i] for s, spec in SECTIONS.items()}), F.col("section")), other)
    limit, separator = of(2, F.lit(2 ** 31 - 64)), of(1, F.lit(" "))
    # under a blank separator an empty line collapses into its neighbours and takes no room
    room = F.when((F.col("_bare") == "") & (F.trim(separator) == ""), 0).otherwise(F.char_length("_bare") + F.char_length(separator))
    placed = placed.withColumn("_room", F.when(F.col("_shown"), room))
    sized = running(placed, by, "line_no", {f"_before_{s}": ("sum", F.when(F.col("section") == s, F.col("_room"))) for s in SECTIONS},
                    inclusive=False, boundary=boundary)
    start = F.coalesce(*[F.when(F.col("section") == s, F.col(f"_before_{s}")) for s in SECTIONS], F.lit(0))
    grouped = sized.where(F.col("_shown") & (start <= limit + 16)).groupBy(*keys, "section").agg(
        F.min("code").alias("code"),
        F.transform(F.sort_array(F.collect_list(F.struct("line_no", "_bare"))), lambda x: x["_bare"]).alias("_lines"))
    text = F.when(F.col("section") == "title", repair_text(F.array_join("_lines", " ")))
    for s, (_, sep, size, _) in SECTIONS.items():
        text = text.when(F.col("section") == s, limit_text(F.array_join("_lines", sep), size))
    wide = grouped.withColumn("_text", text).groupBy(*keys).agg(
        F.min("code").alias("code"), *[F.max(F.when(F.col("section") == s, F.col("_text"))).alias(s)
                                       for s in ("title", *SECTIONS)])
    labelled = [F.when(F.coalesce(s, F.lit("")) != "", F.concat(F.lit(label), s)) for s, (label, *_) in SECTIONS.items()]
    head = F.concat(F.lit("CNO occupation: "), "code", F.lit(" "), "title", F.lit("."))
    return wide.select(*keys, "code", "title", normalize_space(F.concat_ws(" ", head, *labelled)).alias("structured"))


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def taxonomy_records(lines: DataFrame, doc: str = "doc", line_no: str = "line_no", text: str = "text",
                     page: str | None = None, first_page: int = 3, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """One row per (document, code), the first record of a code kept, with its coarser levels."""
    source = lines.where(F.col(page) >= first_page) if page else lines
    rows = source.select(F.col(doc).alias("doc"), F.col(line_no).cast("long").alias("line_no"), F.col(text).alias("text"))
    rows = spread(rows, ["doc"], "line_no", chunk_lines)
    clean = once(rows, text=normalize_space(F.replace("text", F.lit("\u00ad"), F.lit("")))).where("text <> ''")
    at = F.col("line_no")
    clean = once(clean, heading=F.col("text").rlike(CODE_HEADING), stop=is_stop_line(F.col("text")), repaired=repair_text("text"))
    placed = chunked(clean, "line_no", chunk_lines)
    end = placed.where("stop").groupBy("doc").agg(F.min("line_no").alias("_end"))
    body_start = ~F.col("heading") & (F.col("text").rlike(DEFINITION_START) | F.col("text").rlike(LOWER_HEADING))
    marker = F.try_element_at(_map(SECTION_MARKERS), F.col("repaired"))
    # one scan: everything starts again at a heading; a marker counts once the body has begun
    found = running(placed.withColumn("_mark", F.when(~F.col("heading"), marker)), ["doc"], "line_no", {
        "record": ("max", F.when(F.col("heading"), at)), "code": ("last", F.when(F.col("heading"), F.regexp_extract("text", CODE_HEADING, 1))),
        "_body": ("min", F.when(body_start, at)), "_mark_at": ("max", F.when(F.col("_mark").isNotNull(), at)),
        "_marked": ("last", F.col("_mark"))}, boundary=F.col("heading"))
    found = found.join(end, "doc", "left").where((F.col("_end").isNull() | (at < F.col("_end"))) & F.col("record").isNotNull()).drop("_end")
    part = F.when(F.col("heading"), "heading").when(F.col("_body").isNotNull(), "body").otherwise("title")
    found = found.withColumn("part", part)
    in_body = F.col("part") == "body"
    own = F.when(in_body, F.col("repaired")).when(F.col("heading"), F.regexp_extract("text", CODE_HEADING, 2)).otherwise(F.col("text"))
    found = found.withColumns({"_t": own, "_mark": F.when(in_body, F.col("_mark")),
                               "section": F.when(F.col("_mark_at") >= F.col("_body"), F.col("_marked"))})
    texts = _assembled(found, ["doc"], F.col("heading"))
    named = keep_first(texts, ["doc", "code"], ["record"]).select(
        "doc", F.col("code").alias("CNO4"), F.col("title").alias("occupation_title"),
        F.col("structured").alias("cno_structured_text_es"))
    return with_hierarchy(named).withColumn("embedding_text", F.col("cno_structured_text_es"))
