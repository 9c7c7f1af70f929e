"""Structure of long texts: blocks, heading ranks, outlines, chunks, and putting parts together in order."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T

HEADING = r"^(#{1,6})\s+"
_TABLE = r"(?m)\\begin\{tabular\}|^\s*\|"
_LIST = r"(?m)^\s*(?:[-+*]|\d+[.)])\s+"
_MARKER = r"(?i)^<!--\s*pagina\s+(\d+)\s*-->\s*"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def describe_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text", shown: int = 320) -> DataFrame:
    """``key, id, kind, text``: blocks between blank lines with an id ``b-N`` over all of them, empty ones too."""
    each = docs.select(key, F.posexplode(F.split(_strip(F.coalesce(text, F.lit(""))), r"\n{2,}")).alias("n", "b"))
    b = _strip(F.col("b"))
    kind = (
        F.when(b.rlike(r"(?m)^(?:<!--\s*pagina\s+\d+\s*-->\s*)?#{1,6}\s"), "heading").when(b.rlike(r"(?m)^!\["), "figure").when(F.col("b").rlike(_TABLE), "table")
        .when(F.col("b").rlike(_LIST), "list").when(b.rlike(r"(?i)^<!--\s*pagina"), "page-or-prose").otherwise("prose")
    )
    return each.select(key, F.concat(F.lit("b-"), (F.col("n") + 1).cast("string")).alias("id"), kind.alias("kind"), F.substring(T.collapse(T.source_plain_text("b")), 1, shown).alias("text"))


def boundary_block(c: Column | str) -> Column:
    """Struct of a block's page marker, its content without it, and whether it is prose."""
    raw = _strip(F.coalesce(T.col(c), F.lit("")))
    number = F.regexp_extract(raw, _MARKER, 1)
    content = _strip(F.regexp_replace(raw, _MARKER, ""))
    special = (content == "") | content.rlike(r"^#{1,6}\s") | content.rlike(r"^!\[") | content.rlike(_TABLE) | content.rlike(_LIST)
    marker = F.when(number != "", F.concat(F.lit("<!-- pagina "), number, F.lit(" -->"))).otherwise("")
    return F.struct(marker.alias("marker"), content.alias("content"), (~special).alias("prose"))


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line_no", "line"))


def heading_depth(line: Column) -> Column:
    """Depth of a heading line: of its number if it has one, six at most, else of its marks; null for others."""
    marks = F.length(F.regexp_extract(line, HEADING, 1))
    number = F.regexp_extract(line, r"^#{1,6}\s+\s*(\d+(?:\.\d+){0,5})[.)]?\s+", 1)
    return F.when(marks == 0, None).when(number != "", F.least(F.lit(6), F.size(F.split(number, r"\.")))).otherwise(marks)


def heading_ranks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, line_no, depth, level``: the depths that a document uses, ranked without gaps."""
    heads = lines(docs, key, text).withColumn("depth", heading_depth(F.col("line"))).where(F.col("depth").isNotNull())
    return heads.select(key, "line_no", "depth", F.dense_rank().over(Window.partitionBy(key).orderBy("depth")).alias("level"))


def normalize_heading_levels(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, text`` with heading marks by rank; inside each row, so no line leaves its document."""
    split = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    depths = F.array_sort(F.array_distinct(F.filter(F.transform(split, heading_depth), lambda d: d.isNotNull())))

    def one(line: Column, ranks: Column) -> Column:
        level = F.array_position(ranks, heading_depth(line))
        number = F.regexp_extract(line, r"^#{1,6}\s+\s*(\d+(?:\.\d+){0,5})[.)]?\s+", 1) != ""
        rest = F.when(number, F.concat(F.lit(" "), F.regexp_replace(line, HEADING, ""))).otherwise(F.regexp_replace(line, r"^#{1,6}", ""))
        return F.when(~line.rlike(HEADING), line).otherwise(F.concat(F.repeat(F.lit("#"), level.cast("int")), rest))

    joined = T.let(depths, lambda d: F.array_join(F.transform(split, lambda x: one(x, d)), "\n"))
    return docs.select(key, joined.alias("text"))


def enforce_heading_levels(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, output`` with the k-th heading at the level of the source's k-th, if both have as many, and any."""
    source = F.regexp_extract_all(F.coalesce("source", F.lit("")), F.lit(r"(?m)^(#{1,6})\s+"), F.lit(1))
    out = F.split(F.coalesce("output", F.lit("")), "\n")
    places = F.filter(F.transform(out, lambda x, i: F.when(x.rlike(r"^\s*=+\s"), i.cast("int"))), lambda i: i.isNotNull())

    def one(line: Column, i: Column, own: Column) -> Column:
        k = F.array_position(own["places"], i.cast("int"))
        marks = F.repeat(F.lit("="), F.length(F.get(own["source"], (k - 1).cast("int"))))
        return F.when(k > 0, F.concat(F.regexp_extract(line, r"^(\s*)", 1), marks, F.lit(" "), F.regexp_replace(line, r"^\s*=+\s+", ""))).otherwise(line)

    def levelled(own: Column) -> Column:
        same = (F.size(own["source"]) == F.size(own["places"])) & (F.size(own["source"]) > 0)
        return F.when(same, F.array_join(F.transform(out, lambda x, i: one(x, i, own)), "\n")).otherwise(F.coalesce("output", F.lit("")))

    return pairs.select(*keys, T.let(F.struct(source.alias("source"), places.alias("places")), levelled).alias("output"))


def outlines(docs: DataFrame, key: str = "doc_id", order: str = "chunk_idx", body: str = "body") -> DataFrame:
    """For each chunk the headings in force before it, one a level: ``key, order, outline``.

    The latest heading of each level counts, unless a shallower one came after it.  A document's
    headings are folded once, in order.
    """
    heads = docs.select(key, order, F.posexplode(F.split(F.coalesce(body, F.lit("")), "\n")).alias("n", "line"))
    heads = heads.withColumn("marks", F.regexp_extract(F.ltrim("line"), r"^(=+)\s+", 1)).where("marks != ''")
    level = F.length("marks")
    title = F.concat_ws(" ", "marks", F.regexp_replace(F.ltrim("line"), r"^=+\s+", ""))
    by_chunk = heads.groupBy(key, order).agg(F.array_sort(F.collect_list(F.struct("n", level.alias("level"), title.alias("title")))).alias("heads"))
    chunks = docs.select(key, order).join(by_chunk, [key, order], "left")
    own = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, F.coalesce("heads", F.expr("cast(array() as array<struct<n:int,level:int,title:string>>)")).alias("heads")))).alias("c"))
    none = "cast(array() as array<struct<level:int,title:string>>)"
    kind = docs.schema[order].dataType.simpleString()
    start = F.struct(F.expr(none).alias("stack"), F.expr(f"cast(array() as array<struct<`{order}`:{kind},outline:string>>)").alias("done"))

    def put(stack: Column, head: Column) -> Column:
        return F.concat(F.filter(stack, lambda x: x["level"] < head["level"]), F.array(F.struct(head["level"].alias("level"), head["title"].alias("title"))))

    def step(s: Column, c: Column) -> Column:
        outline = F.array_join(F.transform(s["stack"], lambda x: x["title"]), "\n")
        return F.struct(F.aggregate(c["heads"], s["stack"], put).alias("stack"), F.concat(s["done"], F.array(F.struct(c[order].alias(order), outline.alias("outline")))).alias("done"))

    folded = F.aggregate("c", start, step, lambda s: s["done"])
    return own.select(key, F.explode(folded).alias("x")).select(key, f"x.{order}", "x.outline")


def chunk_array(c: Column | str, most: int = 5000) -> Column:
    """A text in pieces of at most ``most`` characters: whole paragraphs, long ones by sentences."""
    text = _strip(F.coalesce(T.col(c), F.lit("")))
    sentences = lambda p: F.transform(F.split(p, r"(?<=[.!?])\s+"), lambda s: F.struct(s.alias("t"), F.lit(" ").alias("glue")))
    units = F.flatten(F.transform(F.split(text, r"\n\n+"), lambda p: F.when(F.length(p) > most, F.transform(sentences(p), lambda x, i: F.struct(x["t"].alias("t"), F.when(i == 0, F.lit("|")).otherwise(F.lit(" ")).alias("glue")))).otherwise(F.array(F.struct(p.alias("t"), F.lit("\n\n").alias("glue"))))))
    empty = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit("").alias("now"))

    def step(s: Column, u: Column) -> Column:
        joined = F.length(s["now"]) + F.length(u["t"]) + F.length(u["glue"])
        full = (s["now"] != "") & ((u["glue"] == "|") | (joined > most))
        done = F.when(full, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"])
        now = F.when(full | (s["now"] == ""), u["t"]).otherwise(F.concat(s["now"], u["glue"], u["t"]))
        return F.struct(done.alias("done"), now.alias("now"))

    folded = F.aggregate(units, empty, step, lambda s: F.when(s["now"] != "", F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]))
    return F.when(F.length(text) <= most, F.array(text)).otherwise(folded)


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 5000) -> DataFrame:
    return docs.select(key, F.posexplode(chunk_array(text, most)).alias("chunk_idx", "text"))


def split_preamble(c: Column | str) -> Column:
    """Struct of what stands before the first heading line, and the rest; without a heading all is body."""
    text = F.coalesce(T.col(c), F.lit(""))
    body = F.regexp_extract(text, r"(?s)(?:^|\n)([ \t]*=+\s.*)$", 1)
    before = F.substring(text, F.lit(1), F.length(text) - F.length(body))
    return F.struct(F.when(body != "", _strip(before)).otherwise("").alias("preamble"), F.when(body != "", _strip(body)).otherwise(_strip(text)).alias("body"))


def combine_bodies(bodies: list[str]) -> str:
    """Bodies in order; headings that open one and repeat the last of their level are dropped, but in the first."""
    last: dict[int, str] = {}
    parts: list[str] = []
    key = lambda t: re.sub(r"\s+", " ", re.sub(r"[.:;,]+$", "", t.lower())).strip()
    heading = re.compile(r"^(=+)\s+(.+)$")
    for body in bodies:
        own, skip = (body or "").split("\n"), 0
        for n, line in enumerate(own):
            if not line.strip():
                continue
            m = heading.match(line.strip())
            if not (m and parts and last.get(len(m[1])) == key(m[2])):
                break
            skip = n + 1
        kept = "\n".join(own[skip:]).strip()
        if not kept:
            continue
        for line in kept.split("\n"):
            if m := heading.match(line.strip()):
                last = {level: t for level, t in last.items() if level < len(m[1])} | {len(m[1]): key(m[2])}
        parts.append(kept)
    return "\n\n".join(parts)


def combine_documents(chunked: DataFrame, key: str = "doc_id", order: str = "chunk_idx", body: str = "body") -> DataFrame:
    """``key, text``: a document's bodies joined; one document at a time in memory."""

    def run(k: tuple, d: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(k[0], combine_bodies(list(d.sort_values(order)[body])))], columns=[key, "text"])

    kind = chunked.schema[key].dataType.simpleString()
    return chunked.select(key, order, body).groupBy(key).applyInPandas(run, f"`{key}` {kind}, text string")


def join_parts(parts: DataFrame, key: str, order: str, text: str, glue: str = "\n\n") -> DataFrame:
    """``key, text``: parts in order, nulls and empty ones left out."""
    kept = parts.where(F.coalesce(F.col(text), F.lit("")) != "")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), glue)
    return kept.groupBy(key).agg(joined.alias("text"))


def dense_parts(parts: DataFrame, totals: DataFrame, key: str, order: str, text: str, most: int = 1_000_000) -> DataFrame:
    """Every index up to the stated total or the largest there is, with null where no part is.

    Indexes are made in runs of 1,000, so no row holds more of them.  A total over ``most`` raises an error
    rather than fill the disk.
    """
    top = parts.groupBy(key).agg((F.max(order) + 1).alias("_top"))
    n = F.greatest("total", F.coalesce("_top", F.lit(0))).cast("bigint")
    size = totals.join(top, key, "left").select(key, F.when(n > most, F.raise_error(F.format_string(f"over {most} parts in one document"))).otherwise(n).cast("bigint").alias("n"))
    runs = size.where("n > 0").select(key, "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 1000))).alias("_run"))
    index = runs.select(key, F.explode(F.sequence((F.col("_run") * 1000).cast("int"), (F.least(F.col("n"), F.col("_run") * 1000 + 1000) - 1).cast("int"))).alias(order))
    return index.join(parts.select(key, order, text), [key, order], "left")


def line_offsets(lines_: DataFrame, key: str = "doc_id", order: str = "n", text: str = "line") -> DataFrame:
    """``key, order, start``: characters of a document before each line, ends of lines counted."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return lines_.select(key, order, F.coalesce(F.sum(F.length(text) + 1).over(before), F.lit(0)).alias("start"))


#: Fixed choices of a layout plan, the default first.
CHOICES = {
    "font": ("libertinus", "newcm", "ptserif", "ptsans", "dejavu"),
    "headfont": ("dejavu", "body", "ptsans", "newcm", "libertinus", "ptserif"),
    "paper": ("a4", "a5", "letter"),
    "textsize": ("normal", "small", "large", "xlarge"),
    "orientation": ("portrait", "landscape"),
    "margin": ("wide", "xwide", "sym", "narrow"),
    "columns": ("one", "two", "three"),
    "headingalign": ("left", "center", "right"),
    "indent": ("normal", "none", "small", "deep"),
    "align": ("justify", "ragged"),
    "density": ("airy", "compact"),
}
STYLES = ("quote", "center", "compact")


def pick_choice(name: str, value: Column) -> Column:
    """The value if it is one of the choices, else the default."""
    return F.when(value.isin(*CHOICES[name]), value).otherwise(CHOICES[name][0])


def valid_choices(proposed: DataFrame) -> DataFrame:
    """Every choice of a plan's columns held to what there is; ``extras`` is "noindent" alone or empty.

    An asked-for absence of indents also changes the default indent.  Unknown or missing columns get the default.
    """
    asked = F.coalesce(F.col("noindent"), F.lit(False)) if "noindent" in proposed.columns else F.lit(False)
    value = lambda name: F.col(name) if name in proposed.columns else F.lit(None).cast("string")
    picked = {name: pick_choice(name, value(name)) for name in CHOICES}
    picked["indent"] = F.when(value("indent").isin(*CHOICES["indent"]), value("indent")).otherwise(F.when(asked, "none").otherwise(CHOICES["indent"][0]))
    extras = F.when(asked, F.array(F.lit("noindent"))).otherwise(F.expr("cast(array() as array<string>)"))
    return proposed.withColumns(picked | {"extras": extras})


def valid_styles(proposed: DataFrame, descriptors: DataFrame, key: str = "doc_id", order: str = "pos") -> DataFrame:
    """``key, id, style``: the first known style proposed for each prose block."""
    prose = descriptors.where("kind = 'prose'").select(key, "id")
    known = proposed.where(F.col("style").isin(*STYLES)).join(prose, [key, "id"], "left_semi")
    return known.groupBy(key, "id").agg(F.min_by("style", order).alias("style"))


def valid_levels(proposed: DataFrame, descriptors: DataFrame, key: str = "doc_id", order: str = "pos") -> DataFrame:
    """``key, id, level``: the first whole level proposed for each heading, held to 1 to 4."""
    heads = descriptors.where("kind = 'heading'").select(key, "id")
    known = proposed.where(F.col("level") == F.floor("level")).join(heads, [key, "id"], "left_semi")
    return known.groupBy(key, "id").agg(F.least(F.lit(4), F.greatest(F.lit(1), F.min_by("level", order))).cast("int").alias("level"))


def systematic_sample(rows: DataFrame, key: str, order: str, size: int = 120) -> DataFrame:
    """All rows of a key if it has at most ``size``, else those at floor(i n / size)."""
    n = F.count("*").over(Window.partitionBy(key))
    at = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    i = F.ceil(F.col("_at") * size / F.col("_n"))
    chosen = (F.col("_n") <= size) | ((i < size) & (F.floor(i * F.col("_n") / size) == F.col("_at")))
    return rows.withColumn("_n", n).withColumn("_at", at).where(chosen).drop("_n", "_at")
