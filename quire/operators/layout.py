"""Page layout: what is furniture, in which order blocks are read, and how a page becomes text.

Blocks are rows ``doc_id, page, block_idx, type, xmin, ymin, xmax, ymax, text`` with null coordinates
where there is no box.  Coordinates are shares of the page, from its top left corner.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T

#: Fixed names of block types.
PICTURES = ("Picture", "Figure", "Image")
FOOTNOTES = ("Footnote", "Footnote-text", "FootnoteText")
FURNITURE = ("Page-header", "Page-footer")
TABLES = ("Table", "Table-body", "TableBody", "Tabella")
CAPTIONS = ("Caption",)
HEADINGS = {"Title": 1, "Document-title": 1, "Section-header": 2, "Heading": 2, "Subsection-header": 3, "Subheading": 3}

NOTE_MARK = r"^(?:[*†‡]|[⁰¹²³⁴⁵⁶⁷⁸⁹]+|\d{1,2}[.)]?)\s+(?=\p{L})"
TRANSLATOR = r"(?iu)^[—–-]\s*(?:trad\.|traduzione(?![A-Za-z0-9_]))"
#: A gap between columns; a block at least so wide spans them; recursion goes so deep at most.
GAP, WIDE, DEPTH = 0.015, 0.55, 12
CAPTION_DISTANCE = 0.12


def boxed() -> Column:
    return F.col("ymin").isNotNull() & F.col("ymax").isNotNull() & F.col("xmin").isNotNull() & F.col("xmax").isNotNull()


def is_page_number(c: Column | str) -> Column:
    t = T.col(c)
    return t.rlike(r"^(?i:pagina\s+)?\d{1,3}$") | t.rlike(r"^(?:PAGINA\s+)?[IVXLCDM]{1,10}$")


def looks_like_running_header(c: Column | str) -> Column:
    t = T.collapse(F.coalesce(T.col(c), F.lit("")))
    return F.length(t).between(4, 110) & F.regexp_count(t, F.lit(T.TOKEN)).between(2, 12) & ~t.rlike("[,.!?;:]")


def _trimmed() -> Column:
    return F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")


def is_footnote() -> Column:
    low = (F.col("type") == "Text") & boxed() & (F.col("ymin") >= 0.7)
    return F.coalesce(F.col("type").isin(*FOOTNOTES) | (low & (_trimmed().rlike(NOTE_MARK) | _trimmed().rlike(TRANSLATOR))), F.lit(False))


def is_page_furniture() -> Column:
    """By type, by being a page number near an edge, or by being short text right at an edge; in this order."""
    number = is_page_number(_trimmed()) & ((F.col("ymax") < 0.22) | (F.col("ymin") > 0.80))
    edge = (F.col("ymax") < 0.09) | (F.col("ymin") > 0.93)
    return (
        F.when(F.col("type").isin(*FURNITURE), True).when(~boxed(), False).when(is_footnote(), False).when(number, True)
        .when(F.coalesce(F.col("type") != "Text", F.lit(True)) | (F.length(_trimmed()) > 90), False).otherwise(edge)
    )


def is_table_block() -> Column:
    return F.coalesce(F.col("type").isin(*TABLES) & boxed(), F.lit(False))


def is_likely_artifact() -> Column:
    w, h = F.greatest(F.lit(0.0), F.col("xmax") - F.col("xmin")), F.greatest(F.lit(0.0), F.col("ymax") - F.col("ymin"))
    return F.when(~boxed(), False).otherwise((w * h < 0.02) | (w < 0.08) | (h < 0.05))


def width_pct() -> Column:
    w = F.greatest(F.lit(0.0), F.coalesce(F.col("xmax") - F.col("xmin"), F.lit(0.0)))
    return F.when(w == 0, 60).otherwise(F.floor(F.least(F.lit(100.0), F.greatest(F.lit(15.0), w / 0.72 * 100)) + 0.5)).cast("int")


def is_spread_like(width: Column, height: Column) -> Column:
    return F.coalesce(width / F.nullif(height, F.lit(0)) >= 1.25, F.lit(False))


def looks_like_markdown_table(c: Column | str) -> Column:
    return F.size(F.filter(F.split(F.coalesce(T.col(c), F.lit("")), "\n"), lambda x: F.contains(x, F.lit("|")))) >= 2


def heading_markdown() -> Column:
    """The text with its heading marks: by type, or by the depth of its number, six at most."""
    text = _trimmed()
    level = F.element_at(F.create_map(*[F.lit(x) for kv in HEADINGS.items() for x in kv]), F.col("type"))
    number = F.regexp_extract(text, r"^\s*(\d+(?:\.\d+){0,4})[.)]?\s+", 1)
    depth = F.when(number != "", F.least(F.lit(6), F.size(F.split(number, r"\.")))).otherwise(level)
    return F.when((text == "") | text.rlike(r"^#{1,6}\s") | level.isNull(), text).otherwise(F.concat(F.repeat(F.lit("#"), depth), F.lit(" "), text))


def footnote_markdown(c: Column | str) -> Column:
    text = F.regexp_replace(F.coalesce(T.col(c), F.lit("")), r"^\s+|\s+$", "")
    note = F.regexp_replace(F.regexp_replace(text, NOTE_MARK, ""), r"\s*\n\s*", " ")
    return F.when(note == "", "").otherwise(F.concat(F.lit("<footnote>"), note, F.lit("</footnote>")))


#: A speaker's name in capitals with an optional remark and a colon.
SPEAKER = r"[A-ZÀ-ÖØ-Þ][A-ZÀ-ÖØ-Þ'’.\-]+(?:\s+[A-ZÀ-ÖØ-Þ'’.\-]{2,}){0,3}(?:\s*\([^)\n]{0,100}\))?\s*:"


def normalize_dialogue(c: Column | str) -> Column:
    """A new line before each speaker after a sentence's end, and a blank line before speakers' lines."""
    out = F.regexp_replace(T.col(c), rf"([.!?…»”)\]])[ \t]+(?={SPEAKER})", "$1\n")
    return F.regexp_replace(out, rf"(?<=[^\n])\n(?=[ \t]{{0,3}}(?:\*\*|__)?{SPEAKER})", "\n\n")


def page_furniture(blocks: DataFrame) -> DataFrame:
    """Adds ``furniture``: a short header near the top counts only on pages that have a number there."""
    top_number = boxed() & is_page_number(_trimmed()) & (F.col("ymax") < 0.22)
    has_number = F.max(F.coalesce(top_number, F.lit(False))).over(Window.partitionBy("doc_id", "page"))
    header = (F.col("type") == "Text") & boxed() & (F.col("ymax") < 0.22) & (F.col("ymax") - F.col("ymin") < 0.07) & looks_like_running_header("text")
    return blocks.withColumn("furniture", is_page_furniture() | F.coalesce(has_number & header, F.lit(False)))


def column_gap(blocks: DataFrame, by: list[str], lo: str = "xmin", hi: str = "xmax", least: float = GAP) -> DataFrame:
    """The middle of the widest gap between intervals, if one is at least so wide; the last of equals: ``by, cut``."""
    before = F.max(hi).over(Window.partitionBy(*by).orderBy(lo, hi).rowsBetween(Window.unboundedPreceding, -1))
    gaps = blocks.where(F.col(lo).isNotNull() & F.col(hi).isNotNull()).select(*by, F.col(lo).alias("lo"), before.alias("end"))
    wide = gaps.withColumn("gap", F.col("lo") - F.col("end")).where(F.col("gap") >= least)
    return wide.groupBy(*by).agg(F.max_by(F.col("end") + F.col("gap") / 2, F.struct("gap", "lo")).alias("cut"))


def bands(blocks: DataFrame, wide: float = 0.45) -> DataFrame:
    """``doc_id, page, block_idx, band``: how many wide blocks lie above each narrow one.

    A running count over both by height; blocks without a box have no band.
    """
    b = blocks.where("xmin IS NOT NULL").select("doc_id", "page", "block_idx", (F.col("xmax") - F.col("xmin")).alias("w"), ((F.col("ymin") + F.col("ymax")) / 2).alias("cy"))
    above = Window.partitionBy("doc_id", "page").orderBy("cy").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    at = Window.partitionBy("doc_id", "page", "cy")
    is_wide = (F.col("w") >= wide).cast("bigint")
    return b.withColumn("band", F.sum(is_wide).over(above) - F.sum(is_wide).over(at)).where(F.col("w") < wide).select("doc_id", "page", "block_idx", "band")


# Reading order of a page; items are dicts of a block's fields, in input order.


def widest_gap(items: list[dict], lo: str = "xmin", hi: str = "xmax", least: float = GAP) -> float | None:
    spans = sorted((b[lo], b[hi]) for b in items)
    end, best, wide = spans[0][1], None, least
    for a, z in spans[1:]:
        if a - end >= wide:
            wide, best = a - end, end + (a - end) / 2
        end = max(end, z)
    return best


def _middle(b: dict, axis: str) -> float:
    return (b[f"{axis}min"] + b[f"{axis}max"]) / 2


def reading_order(items: list[dict]) -> list[dict]:
    """Columns from left to right, blocks over all columns between the bands they part; boxless blocks last."""
    with_box = [b for b in items if not any(b[k] is None or math.isnan(b[k]) for k in ("xmin", "ymin", "xmax", "ymax"))]
    known = {id(b) for b in with_box}
    return [*_cut(with_box, 0), *(b for b in items if id(b) not in known)]


def _cut(items: list[dict], depth: int) -> list[dict]:
    by_place = lambda: sorted(items, key=lambda b: (b["ymin"], b["xmin"]))
    if len(items) <= 1 or depth > DEPTH:
        return by_place()
    at = widest_gap(items)
    if at is not None:
        sides = [b for b in items if _middle(b, "x") < at], [b for b in items if _middle(b, "x") >= at]
        if all(sides):
            return [x for side in sides for x in _cut(side, depth + 1)]
    wide = sorted((b for b in items if b["xmax"] - b["xmin"] >= WIDE), key=lambda b: b["ymin"])
    narrow = [b for b in items if b["xmax"] - b["xmin"] < WIDE]
    if not wide or len(narrow) < 2 or widest_gap(narrow) is None:
        return by_place()
    bands: list[list[dict]] = [[] for _ in range(len(wide) + 1)]
    for b in narrow:
        bands[next((k for k, w in enumerate(wide) if _middle(b, "y") <= _middle(w, "y")), len(wide))].append(b)
    out: list[dict] = []
    for k, band in enumerate(bands):
        out += _cut(band, depth + 1) if band else []
        out += wide[k : k + 1]
    return out


_FIELDS = ["block_idx", "type", "xmin", "ymin", "xmax", "ymax", "text"]


def grouped_rows(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows of sorted batches by their first ``keys`` columns; a group may span batches."""
    key, held = None, []
    for b in batches:
        names = b.schema.names
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[:keys] != key:
                if held:
                    yield key, held
                key, held = row[:keys], []
            held.append(dict(zip(names, row, strict=True)))
    if held:
        yield key, held


def by_page(rows: DataFrame, order: str, solve, schema: str) -> DataFrame:
    """``solve(rows of a page in order)`` gives tuples; pages stream by, sorted, one at a time in memory."""
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    names = ["doc_id", "page", *[f[0] for f in fields]]
    types = [pa.int64(), pa.int32(), *[kinds[f[1]] for f in fields]]

    def run(batches):
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for key, items in grouped_rows(batches, 2):
            out += [(*key, *r) for r in solve(items)]
            if len(out) >= 10_000:
                yield batch()
                out = []
        yield batch()

    ready = rows.withColumns({"doc_id": F.col("doc_id").cast("long"), "page": F.col("page").cast("int")})
    others = [c for c in ready.columns if c not in ("doc_id", "page")]
    return ready.select("doc_id", "page", *others).repartition("doc_id", "page").sortWithinPartitions("doc_id", "page", order).mapInArrow(run, f"doc_id long, page int, {schema}")


def _pages(blocks: DataFrame, solve, schema: str) -> DataFrame:
    return by_page(blocks.select("doc_id", "page", *_FIELDS), "block_idx", solve, schema)


def order_blocks(blocks: DataFrame) -> DataFrame:
    """``doc_id, page, block_idx, reading_order`` (from 0)."""
    return _pages(blocks, lambda items: [(b["block_idx"], n) for n, b in enumerate(reading_order(items))], "block_idx int, reading_order int")


def nearest_captions(items: list[dict]) -> dict[int, int]:
    """Picture's ``block_idx`` -> its caption's, each used once, in the order of the items."""
    free = [b for b in items if b["type"] in CAPTIONS]
    found = {}
    for p in items:
        if p["type"] in PICTURES and p["ymin"] is not None:
            far = [(abs(_middle_or_zero(c) - _middle(p, "y")), n) for n, c in enumerate(free)]
            if far and min(far)[0] < CAPTION_DISTANCE:
                found[p["block_idx"]] = free.pop(min(far)[1])["block_idx"]
    return found


def _middle_or_zero(b: dict) -> float:
    return ((b["ymin"] or 0) + (b["ymax"] or 0)) / 2


def captions(blocks: DataFrame) -> DataFrame:
    """``doc_id, page, block_idx, caption_idx`` of pictures with a caption."""
    return _pages(blocks, lambda items: list(nearest_captions(reading_order(items)).items()), "block_idx int, caption_idx int")


_SUPER = "⁰¹²³⁴⁵⁶⁷⁸⁹"
_LAST_MARK = re.compile(rf"\s*(?:<sup>\s*\d{{1,2}}\s*</sup>|[{_SUPER}]+|[*†‡])\s*$")
_TRANSLATOR_NOTE = re.compile(r"^<footnote>[—–-]\s*(?:trad\.|traduzione\b)", re.I)


def page_lines(items: list[dict], start: int = 0) -> tuple[list[str], list[dict]]:
    """Lines of a page and its figures, from blocks in reading order with their prepared texts.

    Blocks carry ``note`` (a footnote's text, or null) and ``shown`` (heading marks and dialogue done).
    A caption read before its picture stands twice: as text, and at the picture.
    """
    lines: list[str] = []
    notes: list[str] = []
    figures: list[dict] = []
    free = [b for b in items if b["type"] in CAPTIONS]
    used: set[int] = set()
    last = -1
    for b in items:
        if b["note"] is not None:
            if b["note"] and _TRANSLATOR_NOTE.match(b["note"]) and notes:
                notes[-1] = notes[-1].removesuffix("</footnote>") + " " + b["note"].removeprefix("<footnote>")
            elif b["note"]:
                notes.append(b["note"])
        elif b["type"] in PICTURES and b["ymin"] is not None:
            near = min(((abs(_middle_or_zero(c) - _middle(b, "y")), n) for n, c in enumerate(free) if n not in used), default=(1.0, -1))
            caption = ""
            if near[0] < CAPTION_DISTANCE:
                used.add(near[1])
                caption = re.sub(r"[\[\]]", "", free[near[1]]["text"] or "")
            path = f"/figures/fig-{start + len(figures) + 1}.png"
            figures.append({"path": path, "block_idx": b["block_idx"]})
            lines.append(f"![{caption}]({path})")
        elif b["type"] in CAPTIONS:
            if b["text"] and not any(free[n] is b for n in used):
                lines.append(b["text"])
        elif b["text"]:
            lines.append(b["shown"])
            if b["type"] not in HEADINGS:
                last = len(lines) - 1
    if notes:
        if last >= 0:
            lines[last] = f"{_LAST_MARK.sub('', lines[last])} {' '.join(notes)}"
        else:
            lines.append(" ".join(notes))
    return lines, figures


def assemble_pages(blocks: DataFrame) -> DataFrame:
    """``doc_id, page, markdown, n_figures``: furniture dropped, read in order, notes attached to the prose."""
    kept = page_furniture(blocks).where(~F.col("furniture"))
    ready = kept.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("page").cast("int").alias("page"), *_FIELDS,
        F.when(is_footnote(), footnote_markdown("text")).alias("note"), normalize_dialogue(heading_markdown()).alias("shown"),
    )

    def solve(items: list[dict]) -> list[tuple]:
        lines, figures = page_lines(reading_order(items))
        return [("\n\n".join(lines), len(figures))]

    return by_page(ready, "block_idx", solve, "markdown string, n_figures int")


def number_figures(pages: DataFrame) -> DataFrame:
    """Adds ``first_figure``: figures of earlier pages of the document, so that numbers run on."""
    before = F.sum("n_figures").over(Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1))
    return pages.withColumn("first_figure", F.coalesce(before, F.lit(0)).cast("int"))


# Lines of a text layer: items ``doc_id, page, item_idx, x, y, size, str``


def text_lines(items: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """``doc_id, page, line_no, y, size, text``: an item joins the first line whose y is nearer than ``tolerance``.

    Items come in input order, so lines depend on earlier ones: solved page by page.
    """

    def solve(items: list[dict]) -> list[tuple]:
        lines: list[dict] = []
        for r in items:
            line = next((x for x in lines if abs(x["y"] - r["y"]) < tolerance), None)
            if line is None:
                line = {"y": r["y"], "items": []}
                lines.append(line)
            line["items"].append(r)
        rows = []
        for n, line in enumerate(sorted(lines, key=lambda x: -x["y"])):
            own = sorted(line["items"], key=lambda r: r["x"])
            rows.append((n, line["y"], max(r["size"] for r in own), re.sub(r"\s+", " ", " ".join(r["str"] for r in own)).strip()))
        return rows

    return by_page(items.select("doc_id", "page", "item_idx", "x", "y", "size", "str"), "item_idx", solve, "line_no int, y double, size double, text string")


def body_size(lines: DataFrame) -> DataFrame:
    """The most frequent rounded size of each document's lines, the first seen of equals: ``doc_id, body``."""
    counted = lines.groupBy("doc_id", F.floor(F.col("size") + 0.5).alias("rounded")).agg(F.count("*").alias("n"), F.min(F.struct("page", "line_no")).alias("first"))
    return counted.groupBy("doc_id").agg(F.max_by("rounded", F.struct("n", (-F.col("first.page")).alias("p"), (-F.col("first.line_no")).alias("l"))).alias("body"))


def heading_sizes(lines: DataFrame, ratio: float = 1.12) -> DataFrame:
    """Level of each heading size, the largest first, four at most: ``doc_id, rounded, level``."""
    sizes = lines.select("doc_id", F.floor(F.col("size") + 0.5).alias("rounded")).distinct().join(body_size(lines), "doc_id").where(F.col("rounded") >= ratio * F.col("body"))
    return sizes.select("doc_id", "rounded", F.least(F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.desc("rounded"))), F.lit(4)).alias("level"))


def paragraph_numbers(lines: DataFrame, factor: float = 1.8) -> DataFrame:
    """Adds ``paragraph`` (from 1): a new one after a gap of ``factor`` body sizes or at a heading's size."""
    page = Window.partitionBy("doc_id", "page").orderBy("line_no")
    marked = lines.join(body_size(lines), "doc_id")
    new = F.coalesce(F.abs(F.lag("y").over(page) - F.col("y")) > factor * F.col("body"), F.lit(True)) | (F.floor(F.col("size") + 0.5) >= 1.12 * F.col("body"))
    return marked.withColumn("_new", new.cast("int")).withColumn("paragraph", F.sum("_new").over(page)).drop("_new", "body")


def layer_markdown(lines: DataFrame) -> DataFrame:
    """``doc_id, text``: a text layer as Markdown, or null where a document has next to none.

    ``lines`` is what :func:`text_lines` gives.  Empty lines go.  A line of at most 120 characters in a
    heading's size is a heading; other lines are paragraphs, parted where they stand further apart than
    1.8 body sizes, with a mark before each page if there are several.  Sizes are counted over lines of
    four characters or more; under 20 characters a page, or 40 in all, there is no text layer.
    """
    texts = lines.withColumn("text", F.coalesce("text", F.lit("")))
    sized = texts.where(F.length("text") >= 4)
    enough = texts.groupBy("doc_id").agg(F.sum(F.length("text")).alias("chars"), F.countDistinct("page").alias("pages"))
    own = texts.where("text != ''").withColumn("rounded", F.floor(F.col("size") + 0.5))
    marked = own.join(body_size(sized), "doc_id", "left").join(heading_sizes(sized), ["doc_id", "rounded"], "left")
    page = Window.partitionBy("doc_id", "page").orderBy("line_no")
    level = F.when(F.length("text") <= 120, F.col("level"))
    marked = marked.withColumn("level", level)
    new = F.lag("y").over(page).isNull() | F.col("level").isNotNull() | F.lag("level").over(page).isNotNull() | (F.abs(F.lag("y").over(page) - F.col("y")) > 1.8 * F.coalesce("body", F.lit(0)))
    numbered = marked.withColumn("_new", new.cast("int")).withColumn("_block", F.sum("_new").over(page))
    in_order = lambda key, what, glue: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, what))), lambda x: x[what]), glue)
    blocks = numbered.groupBy("doc_id", "page", "_block").agg(F.max("level").alias("level"), in_order("line_no", "text", " ").alias("t"))
    shown = blocks.withColumn("t", F.when(F.col("level").isNotNull(), F.concat(F.repeat(F.lit("#"), F.col("level").cast("int")), F.lit(" "), F.col("t"))).otherwise(F.col("t")))
    pages = texts.select("doc_id", "page").distinct().join(shown.groupBy("doc_id", "page").agg(in_order("_block", "t", "\n\n").alias("t")), ["doc_id", "page"], "left").join(enough, "doc_id")
    mark = F.when(F.col("pages") > 1, F.concat(F.lit("<!-- pagina "), (F.col("page") + 1).cast("string"), F.lit(" -->")))
    whole = pages.withColumn("p", F.concat_ws("\n\n", mark, "t")).where("p != ''").groupBy("doc_id").agg(in_order("page", "p", "\n\n").alias("text"))
    there = F.col("chars") >= F.greatest(F.lit(40), F.col("pages") * 20)
    return enough.join(whole, "doc_id", "left").select("doc_id", F.when(there & (F.coalesce("text", F.lit("")) != ""), F.col("text")).alias("text"))


def without_figures(docs: DataFrame, dropped: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, text`` without the lines that show dropped figures (``key, path``), and no more than one blank line in a row."""
    line = r"^!\[[^\]]*\]\(([^)]+)\)$"
    gone = dropped.groupBy(key).agg(F.collect_set("path").alias("_gone"))
    kept = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: ~F.array_contains("_gone", F.regexp_extract(F.trim(x), line, 1)) | (F.regexp_extract(F.trim(x), line, 1) == ""))
    cleaned = F.trim(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"))
    return docs.join(gone, key, "left").select(key, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(cleaned).alias("text"))


def prepared_pages(pages: DataFrame, edits: DataFrame, key: str = "doc_id", order: str = "page") -> DataFrame:
    """``key, place, order, half``: the pages that edits leave, in order; one that is split gives two.

    ``edits`` (``key, order, rotate, split``) meets pages by index; a page without one stays as it is.
    ``half`` is 0 and 1 for the sides of a split page, else null; ``rotate`` is 0 where nothing is said.
    """
    both = pages.select(key, order).join(edits.select(key, order, "rotate", "split"), [key, order], "left")
    halves = F.when(F.coalesce("split", F.lit(False)), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(None).cast("int")))
    each = both.select(key, order, F.coalesce("rotate", F.lit(0)).alias("rotate"), F.explode(halves).alias("half"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(order, "half")) - 1
    return each.select(key, place.alias("place"), order, "rotate", "half")
