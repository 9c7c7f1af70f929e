"""All queries over the operators, with SQL for those that SQL can say."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import boundaries, compare, layout, render, repair, structure
from quire.plans import inputs as I
from quire.sources import files, responses, store

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "documents")


TOKENS_SQL = f"SELECT doc_id, unnest({I.canonical_sql('source')}) AS token, 1 AS a, 0 AS b FROM ({I.PAIRS_SQL}) UNION ALL SELECT doc_id, unnest({I.canonical_sql('output')}), 0, 1 FROM ({I.PAIRS_SQL})"
DELTA_SQL = f"SELECT doc_id, token, sum(a) AS a, sum(b) AS b FROM ({TOKENS_SQL}) GROUP BY ALL"

# Comparison


@query(
    "j9_token_inventory_diff",
    f"""SELECT p.doc_id, CAST(coalesce(m, 0) AS BIGINT) AS n_missing, CAST(coalesce(x, 0) AS BIGINT) AS n_added, coalesce(m, 0) = 0 AND coalesce(x, 0) = 0 AS ok
    FROM ({I.PAIRS_SQL}) p LEFT JOIN (SELECT doc_id, sum(greatest(a - b, 0)) AS m, sum(greatest(b - a, 0)) AS x FROM ({DELTA_SQL}) GROUP BY doc_id) d USING (doc_id)""",
)
def token_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.token_inventory(I.pairs(spark, sf_dir), ["doc_id"]).select("doc_id", "n_missing", "n_added", "ok")


_NOISE_SQL = "token IN (" + ", ".join(f"'{w}'" for w in compare.LATEX_NOISE) + ") OR regexp_full_match(token, '[lcrxp]+')"


@query(
    "j10_table_guard",
    f"""SELECT p.doc_id, CAST(coalesce(x, 0) AS BIGINT) AS n_added, CAST(coalesce(m, 0) AS BIGINT) AS n_missing, CAST(greatest(1, floor(coalesce(n, 0) / 10)) AS BIGINT) AS allowed,
      coalesce(x, 0) = 0 AND coalesce(m, 0) <= greatest(1, floor(coalesce(n, 0) / 10)) AS ok
    FROM ({I.PAIRS_SQL}) p LEFT JOIN (SELECT doc_id, sum(greatest(a - b, 0)) AS m, sum(greatest(b - a, 0)) AS x, sum(a) AS n FROM ({DELTA_SQL}) WHERE NOT ({_NOISE_SQL}) GROUP BY doc_id) d USING (doc_id)""",
)
def table_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.table_guard(I.pairs(spark, sf_dir), ["doc_id"])


def _invariants_sql(column: str) -> str:
    t = f"coalesce({column}, '')"
    # RE2 has no lookbehind: the character before a number is taken too, and only the group is kept.
    return rf"""list_concat(list_concat(regexp_extract_all({t}, '(?:^|[^A-Za-z0-9_])(\d+(?:[.,]\d+)?\s*%)', 1), regexp_extract_all({t}, '(?:^|[^A-Za-z0-9_])(\d+(?:[.,]\d+)?)\b', 1)), regexp_extract_all({t}, '(?i)https?://[^\s)\]]+'))"""


@query(
    "j11_missing_invariants",
    f"""SELECT p.doc_id, CAST(coalesce(m, 0) AS BIGINT) AS n_missing FROM ({I.PAIRS_SQL}) p LEFT JOIN (
      SELECT doc_id, sum(greatest(a - b, 0)) AS m FROM (SELECT doc_id, item, sum(a) AS a, sum(b) AS b FROM (
        SELECT doc_id, unnest({_invariants_sql('source')}) AS item, 1 AS a, 0 AS b FROM ({I.PAIRS_SQL}) UNION ALL
        SELECT doc_id, unnest({_invariants_sql('output')}), 0, 1 FROM ({I.PAIRS_SQL})) GROUP BY ALL) GROUP BY doc_id) d USING (doc_id)""",
)
def missing_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.missing_invariants(I.pairs(spark, sf_dir), ["doc_id"]).select("doc_id", "n_missing")


@query(
    "a13_token_similarity",
    f"""SELECT doc_id, len(list_intersect(x, y)) / greatest(len(x), len(y), 1) AS similarity
    FROM (SELECT doc_id, list_distinct({I.canonical_sql('source')}) AS x, list_distinct({I.canonical_sql('output')}) AS y FROM ({I.PAIRS_SQL}))""",
)
def token_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.pairs(spark, sf_dir).select("doc_id", T.token_similarity(T.canonical_tokens("source"), T.canonical_tokens("output")).alias("similarity"))


_UNITS = r"list_filter(list_transform(string_split(regexp_replace(regexp_replace(coalesce({c}, ''), '([.!?…])\s+', '\1' || chr(1), 'g'), '\n{{2,}}', chr(1), 'g'), chr(1)), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g'))), lambda s: regexp_matches(s, '[\p{{L}}\p{{N}}]'))"


def _unit_sql(column: str, pos: str) -> str:
    return f"SELECT doc_id, i - 1 AS {pos}, list_distinct({I.canonical_sql('u[i]')}) AS t FROM (SELECT doc_id, u, unnest(range(1, len(u) + 1)) AS i FROM (SELECT doc_id, {_UNITS.format(c=column)} AS u FROM ({I.PAIRS_SQL})))"


@query(
    "j7_best_passage",
    f"""WITH s AS ({_unit_sql('source', 'pos')}), o AS ({_unit_sql('output', 'place')}), c AS (
      SELECT s.doc_id, s.pos, o.place, count(*) / greatest(len(s.t), len(o.t)) AS score FROM (SELECT doc_id, pos, t, unnest(t) AS k FROM s) s JOIN (SELECT doc_id, place, t, unnest(t) AS k FROM o) o USING (doc_id, k) GROUP BY s.doc_id, s.pos, o.place, s.t, o.t)
    SELECT s.doc_id, s.pos, coalesce(b.place, -1) AS match, coalesce(b.score, 0.0) AS similarity FROM s LEFT JOIN (
      SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, pos ORDER BY score DESC, place) = 1) b ON s.doc_id = b.doc_id AND s.pos = b.pos""",
)
def best_passage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.best_passages(I.pairs(spark, sf_dir), ["doc_id"])


_FID = r"trim(regexp_replace(strip_accents(regexp_replace(lower(coalesce({c}, '')), '([a-zà-ÿ])-\s*([a-zà-ÿ])', '\1\2', 'g')), '[^a-z0-9]+', ' ', 'g'))"


@query(
    "j12_shingle_containment",
    f"""WITH w AS (SELECT doc_id, list_filter(string_split({_FID.format(c='source')}, ' '), lambda x: x <> '') AS a, list_filter(string_split({_FID.format(c='output')}, ' '), lambda x: x <> '') AS b FROM ({I.PAIRS_SQL})),
    s AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(a) - 1, 1)), lambda i: a[i] || ' ' || a[i + 1] || ' ' || a[i + 2])) AS a, list_distinct(list_transform(range(1, greatest(len(b) - 1, 1)), lambda i: b[i] || ' ' || b[i + 1] || ' ' || b[i + 2])) AS b FROM w)
    SELECT doc_id, len(a) AS n_shingles, len(list_intersect(a, b)) AS n_common FROM s""",
)
def shingle_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (T.shingles(T.fidelity_words(c)) for c in ("source", "output"))
    ready = I.pairs(spark, sf_dir).select("doc_id", a.alias("a"), b.alias("b"))
    return ready.select("doc_id", F.size("a").cast("bigint").alias("n_shingles"), F.size(F.array_intersect("a", "b")).cast("bigint").alias("n_common"))


_STRIPPED = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({c}, ''), '(?s)<!--.*?-->', ' ', 'g'), '</?[a-zA-Z][^>]*>', ' ', 'g'), '!\[([^\]]*)\]\([^)]*\)', ' \1 ', 'g'), '(?m)^#{{1,6}}[ \t]+', '', 'g'), '\\begin\{{[^}}]*\}}|\\end\{{[^}}]*\}}', ' ', 'g')"
_ROUGH = r"list_filter(list_transform(string_split(regexp_replace(regexp_replace({c}, '([.!?…])\s+', '\1' || chr(1), 'g'), '\n{{2,}}', chr(1), 'g'), chr(1)), lambda p: trim(p)), lambda p: p <> '')"
_FWORDS = f"list_filter(string_split({_FID}, ' '), lambda q: q <> '')"


def _sentences_sql(text: str, rows: str) -> str:
    """SQL for a list of sentences, short ones joined to what comes behind: a fold over (done, current)."""
    folded = f"list_reduce(list_transform(r, lambda p: {{'d': []::VARCHAR[], 'c': p}}), lambda a, x: CASE WHEN len({_FWORDS.format(c='a.c')}) < 8 THEN {{'d': a.d, 'c': a.c || ' ' || x.c}} ELSE {{'d': list_append(a.d, a.c), 'c': x.c}} END)"
    return f"SELECT *, CASE WHEN len(r) = 0 THEN []::VARCHAR[] ELSE list_append(f.d, f.c) END AS sentences FROM (SELECT *, CASE WHEN len(r) > 0 THEN {folded} END AS f FROM (SELECT *, {_ROUGH.format(c=text)} AS r FROM {rows}))"


_SHINGLES3 = "list_distinct(list_transform(range(1, greatest(len({w}) - 1, 1)), lambda i: {w}[i] || ' ' || {w}[i + 1] || ' ' || {w}[i + 2]))"
_FIDELITY_SQL = f"""WITH p AS (SELECT doc_id, {_STRIPPED.format(c='source')} AS t, {_FWORDS.format(c='output')} AS ow FROM ({I.PAIRS_SQL})),
  s AS (SELECT doc_id, unnest(sentences) AS sentence, o FROM ({_sentences_sql('t', f"(SELECT *, {_SHINGLES3.format(w='ow')} AS o FROM p)")})),
  w AS (SELECT doc_id, w, o FROM (SELECT doc_id, {_FWORDS.format(c='sentence')} AS w, o FROM s) WHERE len(w) >= 4),
  h AS (SELECT doc_id, len(w) AS weight, len(list_intersect(g, o)) / len(g) >= 0.55 AS found FROM (SELECT doc_id, w, o, {_SHINGLES3.format(w='w')} AS g FROM w))
  SELECT p.doc_id, coalesce(x.covered / x.total, 1.0) AS coverage, CAST(coalesce(x.lost, 0) AS BIGINT) AS n_missing FROM p LEFT JOIN (
    SELECT doc_id, sum(weight) AS total, coalesce(sum(weight) FILTER (WHERE found), 0) AS covered, count(*) FILTER (WHERE NOT found) AS lost FROM h GROUP BY doc_id) x USING (doc_id)"""


@query("c4_fidelity", _FIDELITY_SQL)
def fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.fidelity(I.pairs(spark, sf_dir), ["doc_id"]).drop("missing")


@query(
    "a11_coverage_by_language",
    f"""SELECT lang, min(coverage) AS least_coverage, CAST(sum(n_missing) AS BIGINT) AS n_missing, count(*) FILTER (WHERE coverage < 0.98 AND n_missing > 0) AS n_shown, bool_and(n_missing = 0) AS all_whole, bool_or(n_missing = 0) AS any_whole
    FROM ({_FIDELITY_SQL}) JOIN documents USING (doc_id) GROUP BY lang""",
)
def coverage_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compare.fidelity(I.pairs(spark, sf_dir), ["doc_id"]).drop("missing").join(_docs(spark, sf_dir).select("doc_id", "lang"), "doc_id")
    return compare.coverage_summary(rows, ["lang"])


@query("c5_token_sequences")
def token_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.token_sequences(I.pairs(spark, sf_dir), ["doc_id"]).drop("missing", "added")


@query("c6_difference_contexts")
def difference_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.difference_contexts(I.pairs(spark, sf_dir), ["doc_id"])


@query("c12_verify")
def verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.verify(I.pairs(spark, sf_dir), ["doc_id"])


@query(
    "a1_token_counts",
    f"SELECT token, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest({I.canonical_sql('text')}) AS token FROM documents) GROUP BY token",
)
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _docs(spark, sf_dir).select("doc_id", F.explode(T.canonical_tokens("text")).alias("token")).groupBy("doc_id", "token").count()
    return each.groupBy("token").agg(F.sum("count").alias("n"), F.count("*").alias("n_docs"))


@query(
    "u_except_all_tokens",
    f"""SELECT token, count(*) AS n FROM (SELECT unnest({I.canonical_sql("text")}) AS token FROM documents WHERE lang = 'es' EXCEPT ALL SELECT unnest({I.canonical_sql("text")}) FROM documents WHERE lang = 'fr') GROUP BY token""",
)
def except_all_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts first, so that only distinct tokens are dealt out, then the difference of multisets."""
    each = _docs(spark, sf_dir).where(F.col("lang").isin("es", "fr")).select("lang", F.explode(T.canonical_tokens("text")).alias("token"))
    n = each.groupBy("token").agg((F.count_if(F.col("lang") == "es") - F.count_if(F.col("lang") == "fr")).alias("n"))
    return n.where("n > 0")


# Layout

_BLOCK_KEYS = "doc_id, page, block_idx"


def _sql_blocks(columns: str, where: str = "TRUE") -> str:
    return f"SELECT {_BLOCK_KEYS}, {columns} FROM (SELECT *, trim(text) AS t, xmin IS NOT NULL AS boxed FROM ({I.BLOCKS_SQL})) WHERE {where}"


NUMBER_SQL = "(regexp_full_match(t, '(?i)(?:pagina\\s+)?\\d{1,3}') OR regexp_full_match(t, '(?:PAGINA\\s+)?[IVXLCDM]{1,10}'))"
HEADER_SQL = "(length(t) BETWEEN 4 AND 110 AND len(regexp_extract_all(t, '[\\p{L}\\p{N}]+')) BETWEEN 2 AND 12 AND NOT regexp_matches(t, '[,.!?;:]'))"
FOOTNOTE_SQL = "coalesce(type IN ('Footnote', 'Footnote-text', 'FootnoteText') OR (type = 'Text' AND boxed AND ymin >= 0.7 AND regexp_matches(t, '^(?:[*†‡]|[⁰¹²³⁴⁵⁶⁷⁸⁹]+|\\d{1,2}[.)]?)\\s+\\p{L}')), FALSE)"
FURNITURE_SQL = f"""CASE WHEN type IN ('Page-header', 'Page-footer') THEN TRUE WHEN NOT boxed THEN FALSE WHEN {FOOTNOTE_SQL} THEN FALSE
  WHEN {NUMBER_SQL} AND (ymax < 0.22 OR ymin > 0.80) THEN TRUE WHEN type <> 'Text' OR length(t) > 90 THEN FALSE ELSE ymax < 0.09 OR ymin > 0.93 END"""


query("p_page_number", _sql_blocks(f"{NUMBER_SQL} AS page_number"))(lambda s, d: I.blocks(s, d).select("doc_id", "page", "block_idx", layout.is_page_number("text").alias("page_number")))
query("p_running_header", _sql_blocks(f"{HEADER_SQL} AS header"))(lambda s, d: I.blocks(s, d).select("doc_id", "page", "block_idx", layout.looks_like_running_header("text").alias("header")))
query("p_footnote", _sql_blocks(f"{FOOTNOTE_SQL} AS footnote"))(lambda s, d: I.blocks(s, d).select("doc_id", "page", "block_idx", layout.is_footnote().alias("footnote")))
query("p_page_furniture", _sql_blocks(f"{FURNITURE_SQL} AS furniture"))(lambda s, d: I.blocks(s, d).select("doc_id", "page", "block_idx", layout.is_page_furniture().alias("furniture")))
query("p_artifact_and_width", _sql_blocks("""CASE WHEN NOT boxed THEN FALSE ELSE greatest(0.0, xmax - xmin) * greatest(0.0, ymax - ymin) < 0.02 OR xmax - xmin < 0.08 OR ymax - ymin < 0.05 END AS artifact,
  CAST(CASE WHEN NOT boxed OR xmax - xmin <= 0 THEN 60 ELSE floor(least(100.0::DOUBLE, greatest(15.0::DOUBLE, (xmax - xmin) / 0.72::DOUBLE * 100)) + 0.5) END AS INT) AS width_pct"""))(
    lambda s, d: I.blocks(s, d).select("doc_id", "page", "block_idx", layout.is_likely_artifact().alias("artifact"), layout.width_pct().alias("width_pct"))
)
query("p_table_block", _sql_blocks("type = 'Table' AND boxed AS table_block, len(list_filter(string_split(text, chr(10)), lambda x: contains(x, '|'))) >= 2 AS pipes"))(
    lambda s, d: I.blocks(s, d).select("doc_id", "page", "block_idx", layout.is_table_block().alias("table_block"), layout.looks_like_markdown_table("text").alias("pipes"))
)
query("p_spread", _sql_blocks("coalesce((xmax - xmin) / nullif(ymax - ymin, 0) >= 1.25, FALSE) AS spread"))(
    lambda s, d: I.blocks(s, d).select("doc_id", "page", "block_idx", layout.is_spread_like(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")).alias("spread"))
)
query(
    "m_heading_markdown",
    _sql_blocks("""CASE WHEN t = '' OR type NOT IN ('Title', 'Section-header') THEN t ELSE repeat('#', CAST(CASE WHEN regexp_matches(t, '^\\d+(?:\\.\\d+){0,4}[.)]?\\s') THEN least(6, len(string_split(regexp_extract(t, '^(\\d+(?:\\.\\d+){0,4})', 1), '.'))) WHEN type = 'Title' THEN 1 ELSE 2 END AS INT)) || ' ' || t END AS markdown"""),
)(lambda s, d: I.blocks(s, d).select("doc_id", "page", "block_idx", layout.heading_markdown().alias("markdown")))
query(
    "m_footnote_markdown",
    _sql_blocks("""CASE WHEN t = '' THEN '' ELSE '<footnote>' || CASE WHEN regexp_matches(t, '^(?:[*†‡]|\\d{1,2}[.)]?)\\s+\\p{L}') THEN regexp_replace(t, '^(?:[*†‡]|\\d{1,2}[.)]?)\\s+', '') ELSE t END || '</footnote>' END AS note"""),
)(lambda s, d: I.blocks(s, d).select("doc_id", "page", "block_idx", layout.footnote_markdown("text").alias("note")))


@query(
    "j6_contextual_furniture",
    f"""SELECT {_BLOCK_KEYS}, {FURNITURE_SQL} OR (top AND type = 'Text' AND boxed AND ymax < 0.22 AND ymax - ymin < 0.07 AND {HEADER_SQL}) AS furniture
    FROM (SELECT *, bool_or(boxed AND {NUMBER_SQL} AND ymax < 0.22) OVER (PARTITION BY doc_id, page) AS top FROM (SELECT *, trim(text) AS t, xmin IS NOT NULL AS boxed FROM ({I.BLOCKS_SQL})))""",
)
def contextual_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.page_furniture(I.blocks(spark, sf_dir)).select("doc_id", "page", "block_idx", "furniture")


@query(
    "w5_widest_gap",
    f"""SELECT doc_id, page, arg_max(ending + gap / 2, struct_pack(gap := gap, lo := lo)) AS cut FROM (SELECT doc_id, page, xmin AS lo, ending, xmin - ending AS gap FROM (
      SELECT doc_id, page, xmin, max(xmax) OVER (PARTITION BY doc_id, page ORDER BY xmin, xmax ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ending FROM ({I.BLOCKS_SQL}) WHERE xmin IS NOT NULL)) WHERE gap >= 0.015 GROUP BY doc_id, page""",
)
def widest_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.column_gap(I.blocks(spark, sf_dir), ["doc_id", "page"])


@query("c1_reading_order")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.order_blocks(I.blocks(spark, sf_dir))


@query("j5_captions")
def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.captions(I.blocks(spark, sf_dir))


@query("c2_assemble_pages")
def assemble_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.number_figures(layout.assemble_pages(I.blocks(spark, sf_dir)))


@query(
    "j20_band_of_narrow_blocks",
    f"""WITH b AS (SELECT *, xmax - xmin AS w, (ymin + ymax) / 2 AS cy FROM ({I.BLOCKS_SQL}) WHERE xmin IS NOT NULL)
    SELECT doc_id, page, block_idx, (SELECT count(*) FROM b w WHERE w.w >= 0.45 AND n.doc_id = w.doc_id AND n.page = w.page AND n.cy > w.cy) AS band FROM b n WHERE n.w < 0.45""",
)
def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.bands(I.blocks(spark, sf_dir))


# Text layers


@query(
    "a4_mode_of_rounded",
    "SELECT l_suppkey, rounded FROM (SELECT l_suppkey, rounded, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, first) AS r FROM (SELECT l_suppkey, floor(l_quantity + 0.5)::BIGINT AS rounded, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS first FROM lineitem GROUP BY ALL)) WHERE r = 1",
)
def mode_of_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = I.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("line_no"), F.col("l_quantity").alias("size"))
    return layout.body_size(lines).select(F.col("doc_id").alias("l_suppkey"), F.col("body").alias("rounded"))


def _body_sql(where: str = "TRUE") -> str:
    return f"SELECT doc_id, rounded AS body FROM (SELECT doc_id, rounded, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS r FROM (SELECT doc_id, CAST(floor(size + 0.5) AS BIGINT) AS rounded, count(*) AS n, min(page * 1000000 + line_no) AS first FROM ({I.LAYER_SQL}) WHERE {where} GROUP BY ALL)) WHERE r = 1"


def _levels_sql(where: str = "TRUE") -> str:
    return f"SELECT doc_id, rounded, least(dense_rank() OVER (PARTITION BY doc_id ORDER BY rounded DESC), 4) AS level FROM (SELECT DISTINCT doc_id, CAST(floor(size + 0.5) AS BIGINT) AS rounded FROM ({I.LAYER_SQL}) WHERE {where}) JOIN ({_body_sql(where)}) USING (doc_id) WHERE rounded >= 1.12 * body"


@query("w4_heading_sizes", _levels_sql())
def heading_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.heading_sizes(I.layer_lines(spark, sf_dir))


@query(
    "w7_paragraphs",
    f"""SELECT doc_id, page, line_no, CAST(sum(fresh) OVER (PARTITION BY doc_id, page ORDER BY line_no) AS BIGINT) AS paragraph FROM (
      SELECT l.doc_id, page, line_no, CASE WHEN coalesce(abs(lag(y) OVER (PARTITION BY l.doc_id, page ORDER BY line_no) - y) > 1.8 * body, TRUE) OR floor(size + 0.5) >= 1.12 * body THEN 1 ELSE 0 END AS fresh FROM ({I.LAYER_SQL}) l JOIN ({_body_sql()}) USING (doc_id))""",
)
def paragraph_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.paragraph_numbers(I.layer_lines(spark, sf_dir)).select("doc_id", "page", "line_no", "paragraph")


_SIZED = "length(text) >= 4"


@query(
    "r_layer_markdown",
    f"""WITH l AS ({I.LAYER_SQL}), own AS (SELECT l.doc_id, page, line_no, y, text, body, CASE WHEN length(text) <= 120 THEN level END AS level FROM l LEFT JOIN ({_body_sql(_SIZED)}) b ON b.doc_id = l.doc_id LEFT JOIN ({_levels_sql(_SIZED)}) h ON h.doc_id = l.doc_id AND h.rounded = floor(l.size + 0.5) WHERE text <> ''),
    marked AS (SELECT *, CASE WHEN lag(y) OVER w IS NULL OR level IS NOT NULL OR lag(level) OVER w IS NOT NULL OR abs(lag(y) OVER w - y) > 1.8 * coalesce(body, 0) THEN 1 ELSE 0 END AS fresh FROM own WINDOW w AS (PARTITION BY doc_id, page ORDER BY line_no)),
    numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, page ORDER BY line_no) AS k FROM marked),
    blocks AS (SELECT doc_id, page, k, CASE WHEN max(level) IS NULL THEN '' ELSE repeat('#', CAST(max(level) AS INT)) || ' ' END || string_agg(text, ' ' ORDER BY line_no) AS t FROM numbered GROUP BY doc_id, page, k),
    pages AS (SELECT doc_id, page, string_agg(t, chr(10) || chr(10) ORDER BY k) AS t FROM blocks GROUP BY doc_id, page),
    totals AS (SELECT doc_id, sum(length(text)) AS chars, count(DISTINCT page) AS pages FROM l GROUP BY doc_id),
    every AS (SELECT d.doc_id, d.page, concat_ws(chr(10) || chr(10), CASE WHEN pages > 1 THEN '<!-- pagina ' || (d.page + 1) || ' -->' END, t) AS p FROM (SELECT DISTINCT doc_id, page FROM l) d LEFT JOIN pages USING (doc_id, page) JOIN totals USING (doc_id)),
    whole AS (SELECT doc_id, string_agg(p, chr(10) || chr(10) ORDER BY page) AS text FROM every WHERE p <> '' GROUP BY doc_id)
    SELECT doc_id, CASE WHEN chars >= greatest(40, pages * 20) AND coalesce(text, '') <> '' THEN text END AS text FROM totals LEFT JOIN whole USING (doc_id)""",
)
def layer_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.layer_markdown(I.layer_lines(spark, sf_dir))


# Structure


@query(
    "w3_heading_ranks",
    rf"""SELECT doc_id, n AS line_no, depth, dense_rank() OVER (PARTITION BY doc_id ORDER BY depth) AS level FROM (SELECT doc_id, n, CAST(CASE WHEN regexp_matches(line, '^#{{1,6}}\s+\s*\d+(?:\.\d+){{0,5}}[.)]?\s+')
      THEN least(6, len(string_split(regexp_extract(line, '^#{{1,6}}\s+\s*(\d+(?:\.\d+){{0,5}})[.)]?\s+', 1), '.'))) ELSE length(regexp_extract(line, '^(#{{1,6}})\s+', 1)) END AS INT) AS depth FROM ({I.MARKED_SQL})) WHERE depth > 0""",
)
def heading_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"])
    docs = I.marked_lines(spark, sf_dir).groupBy("doc_id").agg(F.array_join(lines, "\n").alias("text"))
    return structure.heading_ranks(docs).select("doc_id", "line_no", "depth", "level")


_MARKED_DOC_SQL = f"SELECT doc_id, string_agg(line, chr(10) || chr(10) ORDER BY n) AS text FROM ({I.MARKED_SQL}) GROUP BY doc_id"


@query(
    "c7_block_kinds",
    rf"""SELECT doc_id, 'b-' || (i) AS id, CASE WHEN regexp_matches(trim(b[i], E' \n\t\r'), '(?m)^(?:<!--\s*pagina\s+\d+\s*-->\s*)?#{{1,6}}\s') THEN 'heading' WHEN regexp_matches(trim(b[i], E' \n\t\r'), '(?m)^!\[') THEN 'figure'
      WHEN regexp_matches(b[i], '(?m)\\begin\{{tabular\}}|^\s*\|') THEN 'table' WHEN regexp_matches(b[i], '(?m)^\s*(?:[-+*]|\d+[.)])\s+') THEN 'list' WHEN regexp_matches(trim(b[i], E' \n\t\r'), '(?i)^<!--\s*pagina') THEN 'page-or-prose' ELSE 'prose' END AS kind
    FROM (SELECT doc_id, b, unnest(range(1, len(b) + 1)) AS i FROM (SELECT doc_id, string_split_regex(trim(text, E' \n\t\r'), '\n{{2,}}') AS b FROM ({_MARKED_DOC_SQL})))""",
)
def block_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.describe_blocks(I.marked_documents(spark, sf_dir)).select("doc_id", "id", "kind")


@query(
    "s_normalized_headings",
    rf"""WITH h AS ({_SQL['w3_heading_ranks']}) SELECT l.doc_id, string_agg(CASE WHEN h.level IS NULL THEN line WHEN regexp_matches(line, '^#{{1,6}}\s+\s*\d+(?:\.\d+){{0,5}}[.)]?\s+') THEN repeat('#', CAST(h.level AS INT)) || ' ' || regexp_replace(line, '^#{{1,6}}\s+', '')
      ELSE repeat('#', CAST(h.level AS INT)) || regexp_replace(line, '^#{{1,6}}', '') END, chr(10) || chr(10) ORDER BY l.n) AS text FROM ({I.MARKED_SQL}) l LEFT JOIN h ON h.doc_id = l.doc_id AND h.line_no = l.n GROUP BY l.doc_id""",
)
def normalized_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.normalize_heading_levels(I.marked_documents(spark, sf_dir))


def _chunks_sql(rows: str, most: int) -> str:
    """SQL for pieces of at most ``most`` characters: a fold over (done, current) of paragraphs, and of long ones' sentences."""
    sentences = r"string_split(regexp_replace(p, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
    units = f"flatten(list_transform(string_split_regex(t, '\\n\\n+'), lambda p: CASE WHEN length(p) > {most} THEN list_transform({sentences}, lambda s, i: {{'d': []::VARCHAR[], 'c': s, 'g': CASE WHEN i = 1 THEN '|' ELSE ' ' END}}) ELSE [{{'d': []::VARCHAR[], 'c': p, 'g': chr(10) || chr(10)}}] END))"
    full = f"(a.c <> '' AND (x.g = '|' OR length(a.c) + length(x.c) + length(x.g) > {most}))"
    folded = f"list_reduce({units}, lambda a, x: {{'d': CASE WHEN {full} THEN list_append(a.d, a.c) ELSE a.d END, 'c': CASE WHEN {full} OR a.c = '' THEN x.c ELSE a.c || x.g || x.c END, 'g': ''}})"
    return f"""SELECT doc_id, CAST(i - 1 AS INT) AS chunk_idx, k[i] AS text FROM (SELECT doc_id, k, unnest(range(1, len(k) + 1)) AS i FROM (
      SELECT doc_id, CASE WHEN length(t) <= {most} THEN [t] WHEN f.c <> '' THEN list_append(f.d, f.c) ELSE f.d END AS k FROM (SELECT doc_id, t, CASE WHEN length(t) > {most} THEN {folded} END AS f FROM (
        SELECT doc_id, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t FROM {rows}))))"""


@query("w8_chunks", _chunks_sql("documents", 5000))
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.chunks(_docs(spark, sf_dir), most=5000)


_BODIES_SQL = rf"SELECT doc_id, chunk_idx, regexp_replace(text, '(?m)^#(\s)', '=\1', 'g') AS body FROM ({_chunks_sql(f'({_MARKED_DOC_SQL})', 2000)})"


@query(
    "w11_outlines",
    rf"""WITH b AS ({_BODIES_SQL}), h AS (SELECT doc_id, chunk_idx, n, length(regexp_extract(line, '^(=+)\s+', 1)) AS level, regexp_extract(line, '^(=+)\s+', 1) || ' ' || regexp_replace(line, '^=+\s+', '') AS title FROM (
      SELECT doc_id, chunk_idx, n, ltrim(l[n]) AS line FROM (SELECT doc_id, chunk_idx, l, unnest(range(1, len(l) + 1)) AS n FROM (SELECT doc_id, chunk_idx, string_split(body, chr(10)) AS l FROM b))) WHERE regexp_matches(line, '^=+\s')),
    k AS (SELECT h.*, (SELECT min(o.chunk_idx) FROM h o WHERE o.doc_id = h.doc_id AND o.level <= h.level AND (o.chunk_idx > h.chunk_idx OR (o.chunk_idx = h.chunk_idx AND o.n > h.n))) AS until FROM h)
    SELECT b.doc_id, b.chunk_idx, coalesce(string_agg(k.title, chr(10) ORDER BY k.chunk_idx, k.n), '') AS outline FROM b LEFT JOIN k ON k.doc_id = b.doc_id AND k.chunk_idx < b.chunk_idx AND (k.until IS NULL OR b.chunk_idx <= k.until) GROUP BY b.doc_id, b.chunk_idx""",
)
def outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunked = structure.chunks(I.marked_documents(spark, sf_dir), most=2000).select("doc_id", "chunk_idx", F.regexp_replace("text", r"(?m)^#(?=\s)", "=").alias("body"))
    return structure.outlines(chunked)


@query("c11_combined")
def combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunked = structure.chunks(I.marked_documents(spark, sf_dir), most=2000).select("doc_id", "chunk_idx", F.regexp_replace("text", r"(?m)^#(?=\s)", "=").alias("body"))
    return structure.combine_documents(chunked)


@query(
    "a6_joined_parts",
    "SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations WHERE coalesce(text, '') <> '' GROUP BY conv_id",
)
def joined_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.join_parts(I.table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query(
    "s_dense_parts",
    """WITH p AS (SELECT conv_id, turn, text FROM conversations), t AS (SELECT conv_id, count(*) + 2 AS total FROM conversations GROUP BY conv_id),
    n AS (SELECT t.conv_id, greatest(total, coalesce(top, 0)) AS n FROM t LEFT JOIN (SELECT conv_id, max(turn) + 1 AS top FROM p GROUP BY conv_id) USING (conv_id))
    SELECT i.conv_id, i.turn, p.text FROM (SELECT conv_id, unnest(range(0, n)) AS turn FROM n) i LEFT JOIN p ON i.conv_id = p.conv_id AND i.turn = p.turn""",
)
def dense_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = I.table(spark, sf_dir, "conversations")
    totals = turns.groupBy("conv_id").agg((F.count("*") + 2).alias("total"))
    return structure.dense_parts(turns, totals, "conv_id", "turn", "text")


@query(
    "l_systematic_sample",
    """SELECT l_suppkey, l_orderkey, pos FROM (SELECT l_suppkey, l_orderkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS pos, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
    WHERE n <= 120 OR (ceil(pos * 120 / n) < 120 AND floor(ceil(pos * 120 / n) * n / 120) = pos)""",
)
def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    rows = I.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", (F.row_number().over(order) - 1).cast("bigint").alias("pos"))
    return structure.systematic_sample(rows, "l_suppkey", "pos").select("l_suppkey", "l_orderkey", "pos")


@query(
    "w13_validated_styles",
    rf"""WITH d AS (SELECT doc_id, 'b-' || (n + 1) AS id FROM ({I.MARKED_SQL}) WHERE n % 14 NOT IN (0, 7)), p AS (SELECT doc_id, 'b-' || (n % 20 + 1) AS id, CASE n % 4 WHEN 0 THEN 'quote' WHEN 1 THEN 'center' WHEN 2 THEN 'bold' ELSE 'compact' END AS style, n AS pos FROM ({I.MARKED_SQL}))
    SELECT doc_id, id, arg_min(style, pos) AS style FROM p SEMI JOIN d USING (doc_id, id) WHERE style <> 'bold' GROUP BY doc_id, id""",
)
def validated_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = I.marked_lines(spark, sf_dir)
    described = lines.select("doc_id", F.concat(F.lit("b-"), F.col("n") + 1).alias("id"), F.when((F.col("n") % 14).isin(0, 7), "heading").otherwise("prose").alias("kind"))
    style = F.element_at(F.array(F.lit("quote"), F.lit("center"), F.lit("bold"), F.lit("compact")), F.col("n") % 4 + 1)
    proposed = lines.select("doc_id", F.concat(F.lit("b-"), F.col("n") % 20 + 1).alias("id"), style.alias("style"), F.col("n").alias("pos"))
    return structure.valid_styles(proposed, described)


# Repair

_WORDS_SQL = "SELECT DISTINCT lower(w) AS word FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '\\p{L}+')) AS w FROM documents WHERE lang = 'en')"


def _dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    english = _docs(spark, sf_dir).where("lang = 'en'").select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    return english.select(F.lower("word").alias("word")).distinct()


@query(
    "j1_unknown_words",
    f"SELECT word, n FROM (SELECT lower(w) AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(coalesce(text, ''), '\\p{{L}}+')) AS w FROM documents) GROUP BY ALL) ANTI JOIN ({_WORDS_SQL}) USING (word)",
)
def unknown_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _docs(spark, sf_dir).select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\p{L}+"), F.lit(0))).alias("w"))
    return repair.unlisted(words, _dictionary(spark, sf_dir), "w")


def _quoted(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _correct_sql(words: str) -> str:
    """SQL for ``word, correct`` of a query that gives distinct ``word``."""
    bases = f"list_filter(list_transform({_quoted(repair.ENCLITICS)}, lambda s: CASE WHEN length(lower(word)) > length(s) + 3 AND ends_with(lower(word), s) THEN left(lower(word), length(lower(word)) - length(s)) END), lambda b: b IS NOT NULL)"
    free = f"length(p[i]) <= 2 OR (i < len(p) AND list_contains({_quoted(repair.ELISIONS)}, lower(p[i])))"
    return f"""WITH d AS (SELECT word FROM ({_WORDS_SQL}) UNION SELECT unnest({_quoted(repair.WHITELIST)})), w AS ({words}), x AS (SELECT word, list_filter(string_split_regex(word, '[''’]'), lambda q: q <> '') AS p FROM w),
      need AS (SELECT word, i AS g, lower(p[i]) AS form FROM (SELECT word, p, unnest(range(1, len(p) + 1)) AS i FROM x WHERE len(p) > 1) WHERE NOT ({free}) UNION ALL SELECT word, 0, unnest(list_concat([lower(word)], {bases})) FROM x WHERE len(p) <= 1)
      SELECT w.word, coalesce(ok, TRUE) AS correct FROM w LEFT JOIN (SELECT word, bool_and(hit) AS ok FROM (SELECT need.word, g, bool_or(d.word IS NOT NULL) AS hit FROM need LEFT JOIN d ON d.word = form GROUP BY need.word, g) GROUP BY word) o ON o.word = w.word"""


_PROSE_TEXT = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(?m)^#(set|show|let|import)\b[^\n]*$', ' ', 'g'), '"[^"\n]*"', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '#[a-zA-Z][A-Za-z0-9_.-]*', ' ', 'g'),
  '(\p{L})[*_]+(\p{L})', '\1\2', 'g'), '(\p{L})[*_]+(\p{L})', '\1\2', 'g'), '</?[a-zA-Z][^>]*>', ' ', 'g')"""
_SUSPECT_WORDS = rf"SELECT doc_id, regexp_replace(w, '[''’]$', '') AS word FROM (SELECT doc_id, unnest(regexp_extract_all({_PROSE_TEXT}, '\p{{L}}[\p{{L}}''’]{{2,}}')) AS w FROM documents)"
_SUSPECT_COUNTS = rf"SELECT doc_id, word, count(*) AS n FROM ({_SUSPECT_WORDS}) WHERE length(word) >= 4 AND NOT regexp_full_match(word, '\p{{Lu}}+') GROUP BY ALL"


@query("c10_unknown_words", f"SELECT c.doc_id, c.word, c.n FROM ({_SUSPECT_COUNTS}) c JOIN ({_correct_sql(f'SELECT DISTINCT word FROM ({_SUSPECT_COUNTS})')}) k ON k.word = c.word WHERE NOT k.correct")
def unknown_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.unknown_words(_docs(spark, sf_dir), repair.dictionary(_dictionary(spark, sf_dir))).select("doc_id", "word", "n")


@query("c10_suspects")
def suspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.suspects(_docs(spark, sf_dir), repair.dictionary(_dictionary(spark, sf_dir)))


@query("j2_correct_words", _correct_sql(r"SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(coalesce(text, ''), '\p{L}[\p{L}''’]+')) AS word FROM documents)"))
def correct_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _docs(spark, sf_dir).select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\p{L}[\p{L}'’]+"), F.lit(0))).alias("word"))
    return repair.correct_words(words, repair.dictionary(_dictionary(spark, sf_dir)))


_SPACING_SQL = r"""SELECT doc_id, len(regexp_extract_all(t, '[ \t]+[,;:!?.]')) AS before_marks, len(regexp_extract_all(t, '\([ \t]+')) AS after_bracket, len(regexp_extract_all(t, '[ \t]+\)')) AS before_bracket, len(regexp_extract_all(t, '\S[ \t]{2,}')) AS doubled
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"""


@query("f_spacing_counts", _SPACING_SQL)
def spacing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _docs(spark, sf_dir).select("doc_id", repair.spacing_counts("text").alias("c"))
    return found.select("doc_id", *[F.get("c", F.lit(k)).cast("bigint").alias(n) for k, n in ((0, "before_marks"), (4, "after_bracket"), (5, "before_bracket"), (11, "doubled"))])


_CODE_SQL = r"""(?m)^#(?:set|show|let|import)\b[^\n]*$|"[^"\n]*"|(?s:<!--.*?-->)|\$[^$\n]*\$|#[a-zA-Z][A-Za-z0-9_.]*"""
#: The spacing rules where a look ahead is a second group; what a match takes from the next one is found by a second pass.
_SPACING_STEPS = (
    (r"[ \t]+([,;:!?.])", r"\1"), (r"([,;])(\p{L})", r"\1 \2"), (r"([!?])(\p{L})", r"\1 \2"), (r"(\p{Ll})\.(\p{Lu})", r"\1. \2"), (r"\([ \t]+", "("), (r"[ \t]+\)", ")"),
    (r"([«“‘]|<<)[ \t\n]+", r"\1"), (r"[ \t\n]+([»”’]|>>)", r"\1"), *[(r"(\p{L})-[ \t]+(\p{L})", r"\1 - \2")] * 2, *[(r"(\p{L})[ \t]+-(\p{L})", r"\1 - \2")] * 2,
    *[(r"(\p{L})([—–])(\p{L})", r"\1 \2 \3")] * 2, (r"(\S)[ \t]{2,}", r"\1 "),
)


def _spaced_sql() -> str:
    out = f"regexp_replace(t, '{_CODE_SQL}', chr(57344), 'g')"
    for pattern, to in _SPACING_STEPS:
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return f"SELECT doc_id, array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || coalesce(h[i], '')), '') AS text FROM (SELECT doc_id, string_split({out}, chr(57344)) AS p, regexp_extract_all(t, '{_CODE_SQL}') AS h FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))"


@query("f_fixed_spacing", _spaced_sql())
def fixed_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", repair.fix_spacing("text").alias("text"))


@query(
    "c3_boundary_overlaps",
    rf"""WITH w AS (SELECT doc_id, n, list_transform(regexp_extract_all(line, '\p{{L}}[\p{{L}}\p{{M}}''’]*'), lambda x: lower(strip_accents(x))) AS f FROM {I.LINES_SQL}),
    p AS (SELECT a.doc_id, a.n, a.f[greatest(len(a.f) - 9, 1):] AS a, b.f[1:10] AS b FROM w a JOIN w b ON b.doc_id = a.doc_id AND b.n = a.n + 1)
    SELECT doc_id, n, CAST(coalesce(list_max(list_filter(range(1, least(len(a), len(b)) + 1), lambda k: a[len(a) - k + 1:] = b[1:k])), 0) AS INT) AS overlap FROM p""",
)
def boundary_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.boundary_overlaps(I.document_lines(spark, sf_dir), text="line")


@query("r_fixed_hyphenation")
def fixed_hyphenation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.fix_hyphenation(_docs(spark, sf_dir).select("doc_id", "text"), repair.dictionary(_dictionary(spark, sf_dir)))


_PROSE_SQL = r"""SELECT doc_id, n, t <> '' AND NOT (regexp_matches(t, '^[=+\-#]') OR regexp_matches(t, '#[a-zA-Z]') OR regexp_matches(t, '(?i)</?footnote>') OR regexp_matches(t, '\$[^$]*\$') OR regexp_matches(t, '<!--|-->')
  OR regexp_matches(t, '!\[[^\]]*\]\([^)]*\)')) AND NOT (regexp_matches(t, '\]\(|\)\s*$') AND contains(t, '[')) AS prose FROM (SELECT doc_id, n, trim(line, E' \n\t\r') AS t FROM ({marked}))"""


@query("p_plain_prose", _PROSE_SQL.replace("{marked}", I.MARKED_SQL))
def plain_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.marked_lines(spark, sf_dir).select("doc_id", "n", repair.plain_prose("line").alias("prose"))


# Rendering


@query("c7_rendered")
def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.render_documents(I.marked_documents(spark, sf_dir))


@query("r_autofixed")
def autofixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.autofix_documents(I.marked_documents(spark, sf_dir))


@query("r_escaped", r"SELECT doc_id, regexp_replace(coalesce(text, ''), '([\\#$@\[\]<>])', '\\\1', 'g') AS escaped FROM documents")
def escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.escape_plain(F.coalesce("text", F.lit(""))).alias("escaped"))


# Scalars and tokens


def _docs_query(name: str, column, sql: str) -> None:
    query(name, f"SELECT doc_id, {sql} FROM documents")(lambda s, d: _docs(s, d).select("doc_id", column().alias("value")))


_docs_query("f_canonical_tokens", lambda: F.array_join(T.canonical_tokens("text"), " "), f"array_to_string({I.canonical_sql('text')}, ' ') AS value")
_docs_query("f_fidelity_text", lambda: T.fidelity_text("text"), _FID.format(c="text") + " AS value")
_docs_query("f_content_words", lambda: F.array_join(T.content_words("text"), " "), "trim(regexp_replace(strip_accents(lower(coalesce(text, ''))), '[^a-z]+', ' ', 'g')) AS value")
_docs_query("f_structural_punctuation", lambda: T.structural_punctuation("text"), r"regexp_replace(coalesce(text, ''), '[^.,;:!?()\[\]{}]+', '', 'g') AS value")
_docs_query("f_heading_key", lambda: T.heading_key("text"), r"trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[.:;,]+$', ''), '\s+', ' ', 'g')) AS value")
_docs_query("f_strip_base64_prefix", lambda: T.strip_base64_prefix("text"), "CASE WHEN contains(text, ',') THEN substr(text, instr(text, ',') + 1) ELSE text END AS value")
_docs_query("f_comparison_units", lambda: F.size(T.comparison_units("text")).cast("bigint"), f"len({_UNITS.format(c='text')}) AS value")
_docs_query("f_format_bytes", lambda: T.format_bytes(F.col("n_chars") * F.col("n_chars")), "CASE WHEN n_chars * n_chars < 1024 THEN printf('%d B', n_chars * n_chars) WHEN n_chars * n_chars < 1048576 THEN printf('%.0f KB', n_chars * n_chars / 1024) ELSE printf('%.1f MB', n_chars * n_chars / 1048576) END AS value")
_docs_query("f_invariants", lambda: F.size(T.extract_invariants("text")).cast("bigint"), f"len({_invariants_sql('text')}) AS value")


#: DuckDB counts bytes here, so each letter of several bytes becomes a control character of its own.
_SINGLE = "translate({c}, 'äöüßÄÖÜéèêàâîôûçñáíóúÉÈÊÇÑœï', " + " || ".join(f"chr({n})" for n in (*range(1, 9), 11, 12, *range(14, 32))) + ")"


@query(
    "f_levenshtein",
    f"SELECT a.item_id, levenshtein({_SINGLE.format(c='a.text')}, {_SINGLE.format(c='b.text')}) AS distance FROM benchmark a LEFT JOIN benchmark b ON b.item_id = a.item_id + 1",
)
def edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit distance of each whole benchmark passage to the next one, met by consecutive numbers."""
    items = I.table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("t"))
    after = items.select((F.col("item_id") - 1).alias("item_id"), F.col("t").alias("u"))
    return items.join(after, "item_id", "left").select("item_id", F.levenshtein("t", "u").cast("bigint").alias("distance"))


# State: upserts, projections, deletes


@query(
    "s_latest_state",
    "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
)
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest(I.table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type")


@query(
    "s_summary_of",
    "SELECT conv_id, count(*) AS total, count(*) FILTER (WHERE coalesce(text, '') <> '' AND role = 'assistant') AS done, max(turn) AS last_turn FROM conversations GROUP BY conv_id",
)
def summary_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as the chunks of a session, those of the assistant with a text done."""
    status = F.when((F.coalesce("text", F.lit("")) != "") & (F.col("role") == "assistant"), "done").otherwise("todo")
    none = F.lit(None).cast("string")
    sessions = I.table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.collect_list(F.struct(status.alias("status"))).alias("chunks"), F.max("turn").alias("last_turn"))
    ready = sessions.withColumns({"file_name": none, "status": none, "ocr": F.lit(None).cast("struct<done:int,total:int>")})
    return store.summary(ready).join(sessions.select("id", "last_turn"), "id").select(F.col("id").alias("conv_id"), F.col("total").cast("bigint").alias("total"), F.col("done").cast("bigint").alias("done"), "last_turn")


@query(
    "s_cascade_delete",
    "SELECT conv_id, turn FROM conversations ANTI JOIN (SELECT DISTINCT conv_id FROM conversations WHERE role = 'user' AND length(text) > 400) USING (conv_id)",
)
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = I.table(spark, sf_dir, "conversations")
    return store.without(turns.select("conv_id", "turn"), turns.where((F.col("role") == "user") & (F.length("text") > 400)), "conv_id")


@query("u_union_distinct", "SELECT DISTINCT word FROM (SELECT trim(lower(event_type)) AS word FROM events UNION SELECT trim(lower(role)) FROM conversations) WHERE word <> ''")
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.ignore_list(I.table(spark, sf_dir, "events"), I.table(spark, sf_dir, "conversations").withColumnRenamed("role", "event_type"), "event_type")


@query("w12_line_offsets", f"SELECT doc_id, n, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM {I.LINES_SQL}")
def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.line_offsets(I.document_lines(spark, sf_dir).withColumn("n", F.col("n").cast("bigint")))


# Boundary repair and lookups


@query("c3_repaired_boundaries")
def repaired_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundaries.repair_boundaries(I.marked_documents(spark, sf_dir)).select("doc_id", "text", F.size("changes").alias("n_changes"))


@query(
    "j3_ignore_list",
    """SELECT word, n FROM (SELECT lower(w) AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(coalesce(text, ''), '\\p{L}{4,}')) AS w FROM documents) GROUP BY ALL) ANTI JOIN (
      SELECT DISTINCT lower(w) AS word FROM (SELECT unnest(regexp_extract_all(text, '\\p{L}{4,}')) AS w FROM benchmark)) USING (word)""",
)
def ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lambda t: I.table(spark, sf_dir, t).select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\p{L}{4,}"), F.lit(0))).alias("w"))
    listed = words("benchmark").select(F.lower("w").alias("word"))
    return repair.unlisted(words("documents"), listed, "w")


@query(
    "j4_first_spelling",
    """SELECT doc_id, form, arg_min(w, i) AS spelt, count(*) AS n FROM (SELECT doc_id, i, x[i] AS w, lower(x[i]) AS form FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '\\p{L}{3,}') AS x FROM documents))) GROUP BY doc_id, form""",
)
def first_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.first_spellings(_docs(spark, sf_dir))


_ENFORCED_SQL = rf"""SELECT doc_id, string_agg(CASE WHEN n >= 0 AND regexp_matches(line, '^#{{1,6}}\s') THEN CASE WHEN doc_id % 2 = 0 THEN replace(regexp_extract(line, '^(#+)', 1), '#', '=') ELSE '=' END || ' ' || regexp_replace(line, '^#{{1,6}}\s+', '') ELSE line END, chr(10) ORDER BY n) AS output
    FROM (SELECT doc_id, line, n FROM ({I.MARKED_SQL}) UNION ALL SELECT DISTINCT doc_id, '= In piu', -1 FROM ({I.MARKED_SQL}) WHERE doc_id % 2 = 1) GROUP BY doc_id"""


@query("j13_enforced_levels", _ENFORCED_SQL)
def enforced_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All headings of a text flattened to one level, then put back by the source's; a heading too many leaves them flat."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"])
    source = I.marked_lines(spark, sf_dir).groupBy("doc_id").agg(F.array_join(lines, "\n").alias("source"))
    flat = F.regexp_replace("source", r"(?m)^#{1,6}[ \t\f\r]+", "= ")
    return structure.enforce_heading_levels(source.withColumn("output", F.when(F.col("doc_id") % 2 == 1, F.concat(F.lit("= In piu\n"), flat)).otherwise(flat)), ["doc_id"])


@query("j15_batch_index", "SELECT doc_id, n // 12 AS batch, n % 12 AS i, length(line) AS n_chars FROM " + I.LINES_SQL + " WHERE trim(line) <> ''")
def batch_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = I.document_lines(spark, sf_dir).where(F.trim("line") != "")
    return repair.batches(lines).select("doc_id", "batch", "i", F.length("line").cast("bigint").alias("n_chars"))


@query(
    "j15_merged_replies",
    f"SELECT doc_id, n, CASE WHEN n % 12 % 3 = 0 THEN '> ' || line ELSE line END AS text FROM {I.LINES_SQL}",
)
def merged_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies for every third place of each batch find their paragraph by batch and place."""
    lines = repair.batches(I.document_lines(spark, sf_dir).withColumnRenamed("line", "text"))
    replies = lines.where("i % 3 = 0").select("doc_id", "batch", "i", F.concat(F.lit("> "), F.col("text")).alias("text"))
    return repair.merged_replies(lines, replies, ["doc_id"]).select("doc_id", F.col("n").cast("bigint").alias("n"), "text")


@query(
    "j18_uncovered_words",
    f"""WITH l AS {I.LINES_SQL}, w AS (SELECT doc_id, n FROM l WHERE length(line) > 40), c AS (SELECT doc_id, min(n) AS first, max(n) AS last FROM l WHERE contains(line, ',') GROUP BY doc_id)
    SELECT doc_id, n FROM w WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = w.doc_id AND w.n >= c.first AND w.n < c.last)""",
)
def uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = I.document_lines(spark, sf_dir).withColumn("n", F.col("n").cast("bigint"))
    spans = lines.where(F.contains("line", F.lit(","))).groupBy("doc_id").agg(F.min("n").alias("first"), F.max("n").alias("last"))
    return repair.uncovered(lines.where(F.length("line") > 40), spans)


@query(
    "a16_delimiter_parity",
    """SELECT doc_id, (length(t) - length(replace(t, '*', ''))) % 2 AS stars, (length(t) - length(replace(t, '$', ''))) % 2 AS dollars FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
)
def delimiter_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = lambda p: (F.regexp_count(F.coalesce("text", F.lit("")), F.lit(p)) % 2).cast("bigint")
    return _docs(spark, sf_dir).select("doc_id", odd(r"\*").alias("stars"), odd(r"\$").alias("dollars"))


@query("p_file_error", "SELECT event_id, CASE WHEN event_type NOT IN ('click', 'view') THEN 'type not supported' WHEN value * 1000000 > 20971520 THEN 'file too large' END AS error FROM events")
def file_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    mime = F.when(F.col("event_type").isin("click", "view"), "image/png").otherwise("text/plain")
    return I.table(spark, sf_dir, "events").select("event_id", files.file_error(mime, F.col("value") * 1000000).alias("error"))


@query("s_extracted_text", "SELECT conv_id, turn, coalesce(text, '') AS extracted FROM conversations")
def extracted_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn wrapped as one of three shapes of answer, and its text taken out again."""
    turns = I.table(spark, sf_dir, "conversations")
    text = F.coalesce("text", F.lit(""))
    shapes = [
        F.to_json(F.struct(F.array(F.struct(F.struct(text.alias("content")).alias("message"))).alias("choices"))),
        F.to_json(F.struct(text.alias("markdown"))),
        F.to_json(F.struct(F.array(F.struct(text.alias("text"))).alias("data"))),
    ]
    body = F.when(F.col("turn") % 3 == 0, shapes[0]).when(F.col("turn") % 3 == 1, shapes[1]).otherwise(shapes[2])
    return turns.select("conv_id", "turn", responses.extracted_text(body).alias("extracted"))


@query("f_base64_round_trip", "SELECT doc_id, base64(encode(coalesce(text, ''))) AS encoded FROM documents")
def base64_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = files.data_url(F.lit("text/plain"), F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    return _docs(spark, sf_dir).select("doc_id", F.replace(F.base64(files.url_bytes(url)), F.lit("\r\n"), F.lit("")).alias("encoded"))


@query("u_word_union_counts", "SELECT lang, count(*) AS n_docs, min(n_chars) AS least, sum(n_chars)::BIGINT AS chars, bool_and(n_chars > 0) AS all_filled FROM documents GROUP BY lang")
def language_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n_docs"), F.min("n_chars").alias("least"), F.sum("n_chars").alias("chars"), F.bool_and(F.col("n_chars") > 0).alias("all_filled"))


# Scalars on texts that hold what they look for


def _text_query(name: str, shown: str, column, sql: str) -> None:
    """``column`` of a text given by ``shown``, an expression that both read the same, against SQL over it as ``t``."""
    query(name, f"SELECT doc_id, {sql} AS value FROM (SELECT doc_id, {shown} AS t FROM documents)")(
        lambda s, d: _docs(s, d).select("doc_id", F.expr(shown).alias("t")).select("doc_id", column().alias("value"))
    )


_WHOLE = "coalesce(text, '')"
_NL = "chr(10)"
_text_query("f_lexical_tokens", _WHOLE, lambda: F.array_join(T.lexical_tokens("t"), "|"), r"array_to_string(regexp_extract_all(t, '[\p{L}\p{M}][\p{L}\p{M}''’]*|\p{N}+(?:[.,]\p{N}+)*'), '|')")
_text_query("f_paragraphs", f"concat({_WHOLE}, {_NL}, {_NL}, {_NL}, coalesce(lang, ''), {_NL}, {_NL}, source)", lambda: F.array_join(T.paragraphs("t"), "|"), r"array_to_string(string_split_regex(trim(t), '\n{2,}'), '|')")
_text_query("f_title", f"concat('intro', {_NL}, '=  Titolo ', source, {_NL}, {_WHOLE})", lambda: T.extract_title("t"), r"trim(regexp_extract(t, '(?m)^=[ \t]+(.+)$', 1))")
_text_query("f_escape_string", f"concat({_WHOLE}, chr(92), chr(34), source)", lambda: T.escape_string("t"), "replace(replace(t, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34))")
_text_query("f_strip_fence", f"concat('  ```typ', {_NL}, {_WHOLE}, {_NL}, '``` ')", lambda: T.strip_fence("t"), r"regexp_replace(regexp_replace(regexp_replace(t, '^\s+|\s+$', '', 'g'), '(?s)^```[a-zA-Z]*\n(.*?)\n?```$', '\1'), '^\s+|\s+$', '', 'g')")
_text_query("f_strip_reasoning", f"concat('<think>', {_WHOLE}, '</think> ', source, ' <THINK>x</Think>')", lambda: T.strip_reasoning("t"), r"trim(regexp_replace(t, '(?is)<think>.*?</think>', '', 'g'))")
_text_query("f_extract_prose", f"concat('#set text(size: 9pt)', {_NL}, 'a*b*c <b>', {_WHOLE}, '</b> #image(1)')", lambda: T.extract_prose("t"), _PROSE_TEXT.replace("coalesce(text, '')", "t"))
_text_query("f_strip_markup", f"concat('## Uno', {_NL}, '![alt](x.png) <i>', {_WHOLE}, '</i><!-- n -->')", lambda: T.strip_source_markup("t"), _STRIPPED.format(c="t"))
_text_query("f_content_word_list", _WHOLE, lambda: F.size(T.content_words("t")).cast("bigint"), "len(list_filter(string_split(regexp_replace(strip_accents(lower(t)), '[^a-z]+', ' ', 'g'), ' '), lambda q: q <> ''))")
_text_query(
    "f_source_plain_text", f"concat('# T', {_NL}, '- *uno* `due` <sup>1</sup>', {_NL}, '| a | b |', {_NL}, '| --- | --- |', {_NL}, chr(92), 'textbf{{x}} & y', {_NL}, '![c](p)', {_NL}, {_WHOLE})".replace("{{", "{").replace("}}", "}"),
    lambda: T.source_plain_text("t"),
    "".join(["regexp_replace("] * len(T._PLAIN_STEPS)) + "t" + "".join(", '{}', '{}', 'g')".format(p.replace("(?![A-Za-z0-9_])", r"\b"), to.replace("$1", r"\1")) for p, to in T._PLAIN_STEPS),
)
_text_query("f_replace_unique", _WHOLE, lambda: T.replace_unique(F.col("t"), F.lit("and"), F.lit("AND")), "CASE WHEN length(t) - length(replace(t, 'and', '')) = 3 THEN replace(t, 'and', 'AND') END")
_text_query("f_correction_context", _WHOLE, lambda: T.correction_context(F.col("t"), F.lit("zzzz"), F.lit("the"), 40), "CASE WHEN instr(t, 'the') > 0 THEN substr(t, greatest(1, instr(t, 'the') - 40), instr(t, 'the') + 4 + 40 - greatest(1, instr(t, 'the') - 40)) ELSE substr(t, 1, 1 + 4 + 40 - 1) END")
_text_query("f_relative_time", "n_chars", lambda: T.relative_time(F.col("t") * 0, F.col("t") * F.col("t") * 20), """(SELECT CASE WHEN m < 1 THEN 'ora' WHEN m < 60 THEN m || ' min fa' WHEN floor(m / 60 + 0.5) < 24 THEN CAST(floor(m / 60 + 0.5) AS BIGINT) || ' h fa' ELSE CAST(floor(floor(m / 60 + 0.5) / 24 + 0.5) AS BIGINT) || ' g fa' END
  FROM (SELECT CAST(floor(t * t * 20 / 60000 + 0.5) AS BIGINT) AS m))""")  # fmt: skip
_text_query("f_preamble_of", f"concat('#set x', {_NL}, CASE WHEN doc_id % 2 = 0 THEN '== Capo' ELSE 'Capo' END, {_NL}, {_WHOLE})", lambda: structure.split_preamble("t")["preamble"], "CASE WHEN doc_id % 2 = 0 OR regexp_matches(t, '\\n[ \\t]*=+\\s') THEN '#set x' ELSE '' END")
_text_query("f_explicit_hyphenation", f"concat(CASE doc_id % 3 WHEN 0 THEN '#set text(size: 9pt)' WHEN 1 THEN '#set text(hyphenate: true)' ELSE '' END, {_NL}, {_WHOLE})", lambda: render.explicit_hyphenation("t"), f"CASE doc_id % 3 WHEN 0 THEN '#set text(size: 9pt, hyphenate: false)' || substr(t, 21) WHEN 1 THEN t ELSE '#set text(hyphenate: false)' || {_NL} || t END")
_text_query("f_describe_fix", _WHOLE, lambda: render.describe_fix(F.col("t"), F.left("t", F.lit(12))), r"""(SELECT '«' || CASE WHEN length(a) > 40 THEN left(a, 40) || '…' ELSE a END || '» → «' || CASE WHEN b = '' THEN '(rimosso)' ELSE b END || '»' FROM (SELECT trim(regexp_replace(t, '\s+', ' ', 'g')) AS a, trim(regexp_replace(left(t, 12), '\s+', ' ', 'g')) AS b))""")
_text_query(
    "f_compile_message", "concat('[SourceDiagnostic { message: \"expected ', source, chr(92), '\"x', chr(92), '\"\", hints: [\"try ', coalesce(lang, ''), '\"] }, SourceDiagnostic { message: \"two\" }]')",
    lambda: render.compile_message("t"), "'expected ' || regexp_extract(t, 'expected ([^\\\\]*)', 1) || '\"x\" · two (suggerimento: ' || trim('try ' || regexp_extract(t, 'try ([^\"]*)', 1)) || ')'",
)
_text_query("f_dialogue", f"concat(replace({_WHOLE}, chr(10), ' '), '. AMLETO: chi va ', source, '? ORAZIO (piano): io.', {_NL}, 'OFELIA: ecco')", lambda: layout.normalize_dialogue("t"), rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '([.!?…»”)\]])[ \t]+({layout.SPEAKER})', '\1' || chr(10) || '\2', 'g'), '([.!?…»”)\]])[ \t]+({layout.SPEAKER})', '\1' || chr(10) || '\2', 'g'), '([^\n])\n([ \t]{{0,3}}(?:\*\*|__)?{layout.SPEAKER})', '\1' || chr(10) || chr(10) || '\2', 'g'), '([^\n])\n([ \t]{{0,3}}(?:\*\*|__)?{layout.SPEAKER})', '\1' || chr(10) || chr(10) || '\2', 'g')""".replace("'’.", "''’."))
_text_query("p_can_retry", "concat('error ', CASE doc_id % 4 WHEN 0 THEN '429' WHEN 1 THEN 'Quota exceeded' WHEN 2 THEN 'bad request' ELSE 'OVERLOADED' END)", lambda: responses.can_retry(F.col("t")), "doc_id % 4 <> 2")
_text_query("p_is_pdf", "CASE doc_id % 3 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' END", lambda: files.is_pdf(F.col("t")), "coalesce(t = 'application/pdf', FALSE)")
_text_query("f_choice_font", "CASE doc_id % 3 WHEN 0 THEN 'ptserif' WHEN 1 THEN 'comic' END", lambda: structure.pick_choice("font", F.col("t")), "CASE WHEN t = 'ptserif' THEN t ELSE 'libertinus' END")
_text_query("f_tool_arguments", "concat('{\"choices\":[{\"message\":{\"tool_calls\":[{\"function\":{\"arguments\":\"{', chr(92), '\"n', chr(92), '\":', CAST(doc_id AS VARCHAR(20)), '}\"}}]}}]}')", lambda: F.try_variant_get(responses.tool_arguments(F.col("t")), "$.n", "bigint"), "doc_id")
_text_query("f_model_names", "concat('{\"data\":[{\"id\":\"m', CAST(doc_id % 7 AS VARCHAR(20)), '\"},{\"id\":\"a\"},{\"id\":\"a\"},{\"id\":\"\"}]}')", lambda: F.array_join(responses.model_names(F.col("t")), ","), "'a,m' || doc_id % 7")


@query(
    "f_fidelity_note",
    """SELECT doc_id, string_agg('- «' || CASE WHEN length(x) > 180 THEN left(x, 180) || '…' ELSE x END || '»', chr(10) ORDER BY i) AS note FROM (SELECT doc_id, i, l[i] AS x FROM (SELECT doc_id, l, unnest(range(1, least(len(l), 6) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))) GROUP BY doc_id""",
)
def fidelity_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", compare.fidelity_note(F.split(F.coalesce("text", F.lit("")), "\n")).alias("note"))


@query(
    "w13_validated_levels",
    rf"""WITH d AS (SELECT doc_id, 'b-' || (n + 1) AS id FROM ({I.MARKED_SQL}) WHERE n % 14 IN (0, 7)), p AS (SELECT doc_id, 'b-' || (n % 20 + 1) AS id, CASE n % 3 WHEN 0 THEN 2.5 ELSE n % 9 END AS level, n AS pos FROM ({I.MARKED_SQL}))
    SELECT doc_id, id, CAST(least(4, greatest(1, arg_min(level, pos))) AS INT) AS level FROM p SEMI JOIN d USING (doc_id, id) WHERE level = floor(level) GROUP BY doc_id, id""",
)
def validated_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = I.marked_lines(spark, sf_dir)
    described = lines.select("doc_id", F.concat(F.lit("b-"), F.col("n") + 1).alias("id"), F.when((F.col("n") % 14).isin(0, 7), "heading").otherwise("prose").alias("kind"))
    level = F.when(F.col("n") % 3 == 0, 2.5).otherwise((F.col("n") % 9).cast("double"))
    return structure.valid_levels(lines.select("doc_id", F.concat(F.lit("b-"), F.col("n") % 20 + 1).alias("id"), level.alias("level"), F.col("n").alias("pos")), described)


@query(
    "j14_prepared_pages",
    """SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, half) - 1 AS place, turn, rotate, half FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 90 ELSE 0 END AS rotate, unnest(CASE WHEN turn % 4 = 0 THEN [0, 1] ELSE [NULL::INT] END) AS half FROM conversations)""",
)
def prepared_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = I.table(spark, sf_dir, "conversations").select("conv_id", "turn")
    edits = turns.where("turn % 2 = 0").select("conv_id", "turn", F.lit(90).alias("rotate"), (F.col("turn") % 4 == 0).alias("split"))
    return layout.prepared_pages(turns, edits, "conv_id", "turn")


_FIGURE_TEXT = "concat('uno image(\"', source, '\") due image(\"f2.png\", width: 33.5%) tre image( \"none.png\" )')"


@query(
    "j17_figure_widths",
    f"""SELECT doc_id, 'uno image("' || source || '", width: ' || (doc_id % 90 + 10) || '%) due image("f2.png"' || CASE WHEN doc_id % 2 = 0 THEN ', width: 50%' ELSE ', width: 33.5%' END || ') tre image( "none.png" )' AS text FROM documents""",
)
def figure_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "source", F.expr(_FIGURE_TEXT).alias("text"))
    own = docs.select("doc_id", F.col("source").alias("path"), (F.col("doc_id") % 90 + 10).cast("int").alias("width_pct"))
    more = docs.select("doc_id", F.lit("f2.png").alias("path"), F.when(F.col("doc_id") % 2 == 0, 50).otherwise(0).alias("width_pct"))
    return render.figure_widths(docs, own.union(more))


@query(
    "s_confirmed_figures",
    """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'uno' || chr(10) || chr(10) || '![b](f2.png)' || chr(10) || 'due ' || source ELSE 'uno' || chr(10) || chr(10) || '![a](f1.png)' || chr(10) || chr(10) || '![b](f2.png)' || chr(10) || 'due ' || source END AS text FROM documents""",
)
def confirmed_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", F.expr("concat('uno', chr(10), chr(10), '![a](f1.png)', chr(10), chr(10), '![b](f2.png)', chr(10), 'due ', source)").alias("text"))
    return layout.without_figures(docs, docs.where("doc_id % 2 = 0").select("doc_id", F.lit("f1.png").alias("path")))


@query(
    "s_resumable",
    "SELECT conv_id FROM (SELECT conv_id, max(turn) AS last, count(*) AS n FROM conversations GROUP BY conv_id) WHERE n % 2 = 1 ORDER BY last DESC, conv_id LIMIT 1",
)
def resumable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the one session to go on with, of those with an odd number of turns."""
    found = I.table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.max("turn").alias("updated_at"), F.when(F.count("*") % 2 == 1, "ocr").otherwise("done").alias("status"))
    return store.resumable(found).select(F.col("id").alias("conv_id"))


@query("j8_restored_passages")
def restored_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's lines as the canonical text, the same without its first words as the editor's, and one line as the passage."""
    marked = I.marked_documents(spark, sf_dir)
    rows = marked.select("doc_id", F.col("text").alias("canonical"), F.regexp_replace("text", r"(?m)^\S+ ", "").alias("editor"), F.element_at(F.split("text", "\n\n"), -1).alias("passage"))
    return render.restored_documents(rows, ["doc_id"])


# Operators on inputs built from each row, whose results SQL can say by the same rule


@query("c5_thinned_sequences", f"SELECT doc_id, n AS source_count, n - n // 10 AS matched, CASE WHEN n = 0 THEN 1.0 ELSE (n - n // 10) / n END AS agreement, n < 10 AS ok FROM (SELECT doc_id, len({I.canonical_sql('text')}) AS n FROM documents)")
def thinned_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text against itself without every tenth token: a subsequence, so all that is left matches."""
    tokens = T.canonical_tokens("text")
    pairs = _docs(spark, sf_dir).select("doc_id", F.array_join(tokens, " ").alias("source"), F.array_join(F.filter(tokens, lambda t, i: i % 10 != 9), " ").alias("output"))
    return compare.token_sequences(pairs, ["doc_id"]).select("doc_id", *[F.col(c).cast("bigint").alias(c) for c in ("source_count", "matched")], "agreement", "ok")


@query(
    "c12_thinned_verdicts",
    rf"""SELECT doc_id, n // 10 AS n_missing, CAST(0 AS BIGINT) AS n_added, n < 10 AS in_order, n < 10 AND lost = 0 AS content_ok FROM (
      SELECT doc_id, len(t) AS n, len(list_filter(range(1, len(t) + 1), lambda i: i % 10 = 0 AND regexp_full_match(t[i], '\d+'))) AS lost FROM (SELECT doc_id, {I.canonical_sql('text')} AS t FROM documents))""",
)
def thinned_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = T.canonical_tokens("text")
    pairs = _docs(spark, sf_dir).select("doc_id", F.array_join(tokens, " ").alias("source"), F.array_join(F.filter(tokens, lambda t, i: i % 10 != 9), " ").alias("output"))
    return compare.verify(pairs, ["doc_id"]).select("doc_id", "n_missing", "n_added", "in_order", "content_ok")


@query("c6_lost_numbers", "SELECT doc_id, 'diff-1' AS id, '77' || doc_id AS missing, 'Nato nel 77' || doc_id || ' a ' || source || '.' AS source, 'Nato nel a ' || source || '.' AS rendered, CAST(1 AS INT) AS n_places FROM documents")
def lost_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One number lost in one of two sentences."""
    pairs = _docs(spark, sf_dir).selectExpr("doc_id", "concat('Prima frase intera. Nato nel 77', doc_id, ' a ', source, '.') AS source", "concat('Prima frase intera. Nato nel a ', source, '.') AS output")
    return compare.difference_contexts(pairs, ["doc_id"]).select("doc_id", "id", F.array_join("missing", " ").alias("missing"), "source", "rendered", "n_places")


def _page_sql(columns: str) -> str:
    return f"SELECT doc_id, page, block_idx, type, CASE WHEN side = 0 THEN 0.05 ELSE 0.55 END AS xmin, y / 40.0 AS ymin, CASE WHEN side = 0 THEN 0.45 ELSE 0.95 END AS xmax, y / 40.0 + 0.02 AS ymax, concat('t', block_idx) AS text{columns} FROM (SELECT conv_id AS doc_id, 0 AS page, CAST(turn AS INT) AS block_idx, 'Text' AS type, (turn * 7 + conv_id) % 2 AS side, 4 + turn * 5 % 31 AS y FROM conversations WHERE turn < 31)"


@query("c1_two_columns", f"SELECT doc_id, block_idx, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY side, y) - 1 AS INT) AS reading_order FROM ({_page_sql(', side, y')})")
def two_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of two columns, their blocks in no order: the left column from top to bottom, then the right one."""
    blocks = spark.sql(_page_sql("").replace("FROM conversations", "FROM {conversations}").replace("CAST(turn AS INT)", "CAST(turn AS INT)"), conversations=I.table(spark, sf_dir, "conversations"))
    doubles = {c: F.col(c).cast("double") for c in ("xmin", "ymin", "xmax", "ymax")}
    return layout.order_blocks(blocks.withColumns(doubles)).select("doc_id", "block_idx", "reading_order")


_PICTURES = """SELECT doc_id, page, block_idx, type, 0.1D AS xmin, y AS ymin, 0.9D AS xmax, y + 0.02D AS ymax, text FROM (
  SELECT o_orderkey AS doc_id, 0 AS page, 1 AS block_idx, 'Picture' AS type, 0.3D AS y, '' AS text FROM {orders} UNION ALL
  SELECT o_orderkey, 0, 2, 'Caption', CASE WHEN o_orderkey % 3 = 0 THEN 0.5D ELSE 0.36D END, concat('Figura ', CAST(o_custkey AS STRING)) FROM {orders} UNION ALL
  SELECT o_orderkey, 0, 3, 'Text', 0.6D, 'fine della pagina, con un punto.' FROM {orders})"""


@query("j5_near_captions", "SELECT o_orderkey AS doc_id, CAST(1 AS INT) AS block_idx, CAST(2 AS INT) AS caption_idx FROM orders WHERE o_orderkey % 3 <> 0")
def near_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A picture and a caption, near enough on two of three pages."""
    return layout.captions(spark.sql(_PICTURES, orders=I.table(spark, sf_dir, "orders"))).select("doc_id", "block_idx", "caption_idx")


@query(
    "c2_captioned_pages",
    """SELECT o_orderkey AS doc_id, '![' || CASE WHEN o_orderkey % 3 <> 0 THEN 'Figura ' || o_custkey ELSE '' END || '](/figures/fig-1.png)' || CASE WHEN o_orderkey % 3 = 0 THEN chr(10) || chr(10) || 'Figura ' || o_custkey ELSE '' END || chr(10) || chr(10) || 'fine della pagina, con un punto.' AS markdown FROM orders""",
)
def captioned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages put together: a near caption goes into its picture, a far one stays a line."""
    return layout.assemble_pages(spark.sql(_PICTURES, orders=I.table(spark, sf_dir, "orders"))).select("doc_id", "markdown")


@query(
    "w6_text_lines",
    "SELECT doc_id, CAST(0 AS INT) AS page, CAST(n AS INT) AS line_no, CAST(10 + n % 3 AS DOUBLE) AS size, array_to_string(w, ' ') AS text FROM (SELECT doc_id, line, n, list_filter(string_split(line, ' '), lambda x: x <> '') AS w FROM "
    + I.LINES_SQL + " WHERE n < 40) WHERE len(w) > 0 AND regexp_full_match(line, '[^\\t\\r\\f\\v]*')",
)
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each of a text's first lines as items at their line's height, within the tolerance, dealt in no order."""
    lines = I.document_lines(spark, sf_dir).where((F.col("n") < 40) & F.col("line").rlike(r"^[^\t\r\f\x0B]*$"))
    words = lines.select("doc_id", "n", F.posexplode(F.filter(F.split("line", " "), lambda x: x != "")).alias("i", "str"))
    items = words.select("doc_id", F.lit(0).alias("page"), (F.col("n") * 100_000 + F.col("i")).alias("item_idx"), F.col("i").cast("double").alias("x"), (1000 - F.col("n") * 10 + F.col("i") % 2).cast("double").alias("y"), (10 + F.col("n") % 3 - F.col("i") % 2).cast("double").alias("size"), "str")
    found = layout.text_lines(items)
    return found.select("doc_id", "page", F.floor((1001 - F.col("y")) / 10).cast("int").alias("line_no"), "size", "text")


@query("c11_repeated_headings", "SELECT doc_id, '= Capo ' || source || chr(10) || 'uno' || chr(10) || chr(10) || 'due' || chr(10) || '== Sotto' || chr(10) || chr(10) || '= Altro' || chr(10) || 'tre' AS text FROM documents")
def repeated_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of which the second opens with the first one's heading once more."""
    bodies = "array(concat('= Capo ', source, chr(10), 'uno'), concat('= CAPO  ', source, '.', chr(10), 'due', chr(10), '== Sotto'), concat('== sotto', chr(10), '= Altro', chr(10), 'tre'))"
    chunked = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.expr(bodies)).alias("chunk_idx", "body"))
    return structure.combine_documents(chunked)


@query("r_rejoined_words", """SELECT doc_id, 'cercando ' || source || ' socio-politico contare che "cer- cando"' AS text, CAST(2 AS INT) AS n_changes FROM documents""")
def rejoined_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word broken at a line's end, a compound that stays, a fused word, and code that isn't touched."""
    docs = _docs(spark, sf_dir).selectExpr("doc_id", """concat('cer-', chr(10), 'cando ', source, ' socio-politico contareche "cer- cando"') AS text""")
    known = spark.createDataFrame([(w,) for w in "cercando socio politico sociopolitico contare che".split()], "word string")
    return repair.fix_hyphenation(docs, repair.dictionary(known)).select("doc_id", "text", F.size("changes").alias("n_changes"))


_PROPOSED = "SELECT DISTINCT word, CASE WHEN length(word) % 3 = 0 THEN left(word, length(word) - 1) WHEN length(word) % 3 = 1 THEN left(word, 3) || ' ' || substr(word, 4) ELSE '' END AS fix FROM (SELECT lower(w) AS word FROM (SELECT unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z]{6,}')) AS w FROM documents))"


@query(
    "s_valid_corrections",
    f"""WITH c AS ({_PROPOSED}), k AS ({_correct_sql(f"SELECT DISTINCT unnest(string_split(fix, ' ')) AS word FROM ({_PROPOSED}) WHERE fix <> ''")})
    SELECT c.word, c.fix, c.fix <> '' AND coalesce(bool_and(k.correct), FALSE) AS ok FROM (SELECT word, fix, unnest(string_split(fix, ' ')) AS piece FROM c) c LEFT JOIN k ON k.word = c.piece GROUP BY c.word, c.fix""",
)
def valid_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with their last letter dropped, parted after three letters, or with no fix at all."""
    words = _docs(spark, sf_dir).select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]{6,}"), F.lit(0))).alias("w")).select(F.lower("w").alias("word")).distinct()
    n = F.length("word")
    fix = F.when(n % 3 == 0, F.expr("left(word, length(word) - 1)")).when(n % 3 == 1, F.expr("concat(left(word, 3), ' ', substr(word, 4))")).otherwise("")
    return repair.valid_corrections(words.withColumn("fix", fix), repair.dictionary(_dictionary(spark, sf_dir)))


@query("c9_safe_corrections", "SELECT doc_id, doc_id % 4 < 3 AS safe FROM documents")
def safe_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An accent, a joined word, a function word put in, and a word replaced, which isn't safe."""
    before = "CASE doc_id % 4 WHEN 0 THEN 'perche lui parla' WHEN 1 THEN 'cer cando bene' WHEN 2 THEN 'lui bene' ELSE 'lui parla bene' END"
    after = "CASE doc_id % 4 WHEN 0 THEN 'perché lui parla' WHEN 1 THEN 'cercando bene' WHEN 2 THEN 'lui è bene' ELSE 'lui dice bene' END"
    known = spark.createDataFrame([(w,) for w in "perché lui parla cercando bene dice".split()], "word string")
    return repair.safe_corrections(_docs(spark, sf_dir).selectExpr("doc_id", f"{before} AS before", f"{after} AS after"), repair.dictionary(known), ["doc_id"])


@query("r_converted_formulas", "SELECT doc_id, '= Capo ' || doc_id || chr(10) || '$(frac(' || doc_id || ', ' || source || ')) <=  alpha  + x_(12) thin sqrt(2) diff  f$ \"DejaVu Sans\"' AS text FROM documents")
def converted_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = r"concat('# Capo ', doc_id, chr(10), '$', chr(92), 'left(', chr(92), 'frac{', doc_id, '}{', source, '}', chr(92), 'right) ', chr(92), 'leq ', chr(92), 'alpha + x_{12}', chr(92), ',', chr(92), 'sqrt{2} ', chr(92), 'partial f$ \"Arial\"')"
    fixed = render.autofix_documents(_docs(spark, sf_dir).selectExpr("doc_id", f"{source} AS text"))
    return fixed.select("doc_id", "text")


@query(
    "r_planned_blocks",
    """SELECT doc_id, '=== Capo *' || source || '*' || chr(10) || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '#align(center)[prosa \\#' || doc_id || ']' ELSE 'prosa \\#' || doc_id END || chr(10) || chr(10) || '#table(columns: 2, [*a*], [*b*], [' || doc_id || '], [])' || chr(10) || chr(10)
      || '- uno' || chr(10) || '- _due_' || chr(10) || chr(10) || '#block[#align(center)[#image("f' || doc_id || '.png", width: 80%)]]' || chr(10) || chr(10) || '// pagina 3' || chr(10) || chr(10) || 'testo#footnote[nota]' AS body FROM documents""",
)
def planned_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each kind of block rendered, with a style for every other document and a level for all headings."""
    nl = "chr(10), chr(10)"
    text = f"concat('# Capo **', source, '**', {nl}, 'prosa #', doc_id, {nl}, '| a | b |', chr(10), '| --- | --- |', chr(10), '| ', doc_id, ' |', {nl}, '- uno', chr(10), '- *due*', {nl}, '![](f', doc_id, '.png)', {nl}, '<!-- pagina 3 -->', chr(10), 'testo<footnote>nota</footnote>')"
    docs = _docs(spark, sf_dir).selectExpr("doc_id", f"{text} AS text")
    styles = docs.where("doc_id % 2 = 0").selectExpr("doc_id", "'b-2' AS id", "'center' AS style")
    levels = docs.selectExpr("doc_id", "'b-1' AS id", "3 AS level")
    return render.render_documents(docs, styles, levels)


@query("j8_restored_blocks", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '= Capo ' || source || chr(10) || chr(10) || 'uno due tre quattro mio' || chr(10) || chr(10) || 'cinque sei sette otto ' || doc_id END AS restored FROM documents")
def restored_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last block lost words in the editor and comes back for every other document; others ask for what isn't there."""
    nl = "chr(10), chr(10)"
    rows = _docs(spark, sf_dir).selectExpr(
        "doc_id", f"concat('# Capo ', source, {nl}, 'uno due tre quattro', {nl}, 'cinque sei sette otto ', doc_id) AS canonical",
        f"concat('= Capo ', source, {nl}, 'uno due tre quattro mio', {nl}, 'cinque sette') AS editor", "CASE WHEN doc_id % 2 = 0 THEN concat('cinque sei sette otto ', doc_id) ELSE 'del tutto altro' END AS passage",
    )
    return render.restored_documents(rows, ["doc_id"])


@query("s_page_blocks", "SELECT conv_id, turn, CAST(i AS INT) AS block_idx, CASE WHEN i = 0 THEN 'Title' ELSE 'Text' END AS type, CASE WHEN i = 0 THEN 0.25 END AS xmin, CASE WHEN i = 0 THEN 'T' || turn ELSE coalesce(text, '') END AS text FROM (SELECT conv_id, turn, text, unnest([0, 1]) AS i FROM conversations)")
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with two blocks each, the second without a box, as the arguments of a tool call."""
    box = F.struct(*[F.lit(v).alias(n) for n, v in (("xmin", 0.25), ("ymin", 0.1), ("xmax", 0.75), ("ymax", 0.2))])
    none = F.lit(None).cast("struct<xmin:double,ymin:double,xmax:double,ymax:double>")
    block = lambda kind, b, text: F.struct(F.lit(kind).alias("type"), b.alias("bbox"), text.alias("text"))
    blocks = F.to_json(F.array(block("Title", box, F.concat(F.lit("T"), F.col("turn"))), block("Text", none, F.coalesce("text", F.lit("")))))
    body = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(F.struct(blocks.alias("arguments")).alias("function"))).alias("tool_calls")).alias("message"))).alias("choices")))
    answers = I.table(spark, sf_dir, "conversations").select("conv_id", "turn", body.alias("body"))
    return responses.page_blocks(answers, ["conv_id", "turn"]).select("conv_id", "turn", "block_idx", "type", "xmin", "text")


@query("f_image_sizes", "SELECT doc_id, CAST(doc_id % 5000 + 1 AS INT) AS width, CAST(n_chars % 4000 + 1 AS INT) AS height FROM documents")
def image_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first bytes of PNG files with sizes by each row's numbers."""
    head = "unhex(concat('89504E470D0A1A0A0000000D49484452', lpad(hex(CAST(doc_id % 5000 + 1 AS BIGINT)), 8, '0'), lpad(hex(CAST(n_chars % 4000 + 1 AS BIGINT)), 8, '0'), '0806000000'))"
    return files.with_image_size(_docs(spark, sf_dir).selectExpr("doc_id", f"{head} AS content")).select("doc_id", "width", "height")


@query("f_subsequence", f"SELECT doc_id, len({I.canonical_sql('text')}) < 2 OR doc_id % 2 = 0 AS value FROM documents")
def subsequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second token of a text stands in it in order; behind a token that nothing has, it doesn't."""
    tokens = T.canonical_tokens("text")
    some = F.filter(tokens, lambda t, i: i % 2 == 1)
    asked = F.when((F.col("doc_id") % 2 == 0) | (F.size(some) == 0), some).otherwise(F.concat(F.array(F.lit("§")), some))
    return _docs(spark, sf_dir).select("doc_id", T.is_subsequence(asked, tokens).alias("value"))


@query("f_flexible_match", "SELECT doc_id, CAST(length(source) + 1 AS INT) AS at, CAST(11 AS INT) AS size FROM documents")
def flexible_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _docs(spark, sf_dir).select("doc_id", T.flexible_match(F.concat("source", F.lit(" alfa \n beta gamma")), F.lit("alfa beta")).alias("m"))
    return found.select("doc_id", F.col("m.index").cast("int").alias("at"), F.col("m.length").cast("int").alias("size"))


@query("f_soft_hyphens", "SELECT doc_id, coalesce(text, '') || ' cercando indian stato' AS value FROM documents")
def soft_hyphens(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" cer­cercando in­dian sta­to"))
    return _docs(spark, sf_dir).select("doc_id", T.normalize_soft_hyphens(text).alias("value"))
