import pytest
from pyspark.sql import functions as F

from quire.operators import render, structure


def one(spark, text, f):
    return f(spark.createDataFrame([(1, text)], "doc_id int, text string"))


def test_blocks_and_headings(spark):
    d = one(spark, "# A\n\n### 2.3 B\n\ntext\n\n| a | b |\n\n- x\n\n![f](p)\n\n<!-- pagina 3 --> hi", structure.describe_blocks).orderBy("id").collect()
    assert [r.kind for r in d] == ["heading", "heading", "prose", "table", "list", "figure", "page-or-prose"]
    assert one(spark, "# A\n### B\n#### 1. C\ntext", structure.normalize_heading_levels).first().text == "# A\n## B\n# 1. C\ntext"
    pair = spark.createDataFrame([(1, "# A\n### B", "= a\n  == b\nt"), (2, "# A", "= a\n= b")], "k int, source string, output string")
    assert [r.output for r in structure.enforce_heading_levels(pair, ["k"]).orderBy("k").collect()] == ["= a\n  === b\nt", "= a\n= b"]


def test_chunks_keep_all_tokens(spark):
    text = "\n\n".join(" ".join(f"Parola{i}_{k}." for k in range(i * 7 % 40)) for i in range(1, 30))
    got = [r.text for r in one(spark, text, lambda d: structure.chunks(d, most=200)).orderBy("chunk_idx").collect()]
    assert " ".join(got).split() == text.split() and max(map(len, got)) <= 200 and len(got) > 5


def test_outline_and_combination(spark):
    c = spark.createDataFrame([(1, 0, "= A\nx\n== B\ny"), (1, 1, "== B\nz\n== C"), (1, 2, "= D\nq")], "doc_id int, chunk_idx int, body string")
    assert [r.outline for r in structure.outlines(c).orderBy("chunk_idx").collect()] == ["", "= A\n== B", "= A\n== C"]
    assert structure.combine_documents(c).first().text == "= A\nx\n== B\ny\n\nz\n== C\n\n= D\nq"
    assert tuple(c.limit(1).select(structure.split_preamble(F.lit("#set x\n= A\nb")).alias("s")).first().s) == ("#set x", "= A\nb")


def test_plan_guards(spark):
    d = spark.createDataFrame([(1, "b-1", "prose"), (1, "b-2", "heading")], "doc_id int, id string, kind string")
    styles = spark.createDataFrame([(1, "b-1", "bold", 0), (1, "b-1", "quote", 1), (1, "b-1", "center", 2), (1, "b-2", "quote", 3)], "doc_id int, id string, style string, pos int")
    assert [tuple(r) for r in structure.valid_styles(styles, d).collect()] == [(1, "b-1", "quote")]
    levels = spark.createDataFrame([(1, "b-2", 9.0, 0), (1, "b-1", 1.0, 1), (1, "b-2", 2.0, 2)], "doc_id int, id string, level double, pos int")
    assert [tuple(r) for r in structure.valid_levels(levels, d).collect()] == [(1, "b-2", 4)]


@pytest.mark.parametrize(("block", "want"), [
    ("# Titolo *x*", "= Titolo _x_"), ("- a\n- **b**", "- a\n- *b*"), ("1. a\n2. b", "+ a\n+ b"), ("<!-- pagina 2 -->", "// pagina 2"), ("Nota¹²", "Nota#super[12]"),
    ("a <footnote>n *i*</footnote>", "a #footnote[n _i_]"), ("#let x = [1]", "\\#let x = \\[1\\]"),
    ("| a | b |\n| --- | --- |\n| 1 |", "#table(columns: 2, [*a*], [*b*], [1], [])"),
    (r"\begin{tabular}{ll}Nome & Valore \\ Alfa & 42\end{tabular}", "#table(columns: 2, [Nome], [Valore], [Alfa], [42])"),
    ("![Una](f.png)", '#block[\n#align(center)[#image("f.png", width: 80%)]\n#align(center)[#text(size: 9pt, style: "italic")[Una]]\n]'),
])
def test_rendered_blocks(block, want):
    assert render.render_block(block) == want


def test_documents_with_a_plan(spark):
    d = spark.createDataFrame([(1, "# T\n\nprosa\n\n"), (2, None)], "doc_id int, text string")
    styles = spark.createDataFrame([(1, "b-2", "center")], "doc_id int, id string, style string")
    levels = spark.createDataFrame([(1, "b-1", 3)], "doc_id int, id string, level int")
    assert [r.body for r in render.render_documents(d, styles, levels).orderBy("doc_id").collect()] == ["=== T\n\n#align(center)[prosa]", ""]


def test_markup_repair():
    fixed, changes = render.autofix('# T\n#set paragraph(x)\n\\frac{a}{b} \\alpha x_{12} \\textbf{q} "Arial" a < b')
    assert fixed == '= T\n#set par(x)\nfrac(a, b) alpha  x_(12) *q* "DejaVu Sans" a \\< b' and len(changes) == 6
    assert ("a [b *c]", "closed ]") in render.delimiter_candidates("a [b *c") and render.delimiter_candidates("fine") == []
    assert render.apply_patches("a  b\nc", [{"find": "a b", "replace": "X"}, {"find": "c", "replace": "c"}, {"find": "zz", "replace": "y"}])[0] == "X\nc"
    assert render.focus("1\n2\n3\n4\n5", 3, 4) == "2\n3\n4"
    assert render.find_matches("Perché il pane", "pane", True) == [10] and render.find_matches("panepane pane", "pane", True) == [9]
    assert render.mark_match("uno due", 4, 7).startswith("uno #highlight(") and render.mark_match("a #b", 2, 4) == "a #b"
    assert render.rebase("intro abc fine edited", "abc fine", "abd fine") == "intro abd fine edited" and render.rebase("x x", "x", "y") is None


def test_preamble(spark):
    text = render.preamble({"font": "ptserif", "paper": "letter", "columns": "two", "extras": ["hyphenate", "runninghead"], "headfont": "body"}, "A [b]")
    assert 'paper: "us-letter"' in text and "columns: 2" in text and "hyphenate: true" in text and r"[A \[b\]]" in text
    d = spark.createDataFrame([('#set text(font: "x")\nq',), ("q",), ("#set text(hyphenate: true)",)], "t string")
    assert [r[0] for r in d.select(render.explicit_hyphenation("t")).collect()] == ['#set text(font: "x", hyphenate: false)\nq', "#set text(hyphenate: false)\nq", "#set text(hyphenate: true)"]


def test_dense_parts_keep_every_turn_and_leave_holes(spark, tmp_path):
    from quire.plans import catalog

    spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 4, "e"), (2, 1, "x")], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.conv_id, r.turn): r.text for r in catalog.queries()["s_dense_parts"](spark, str(tmp_path)).collect()}
    assert got == {(1, 0): "a", (1, 1): "b", (1, 2): None, (1, 3): None, (1, 4): "e", (2, 0): None, (2, 1): "x", (2, 2): None}


def test_every_symbol_is_converted():
    """Each command alone, beside another one and before a letter that would make it a longer one."""
    for name, shown in render.SYMBOLS.items():
        assert render.latex_math(f"\\{name}")[0] == f"{shown} ", name
        assert render.latex_math(f"\\{name}\\alpha x")[0] == f"{shown} alpha  x", name
        assert render.latex_math(f"\\{name}q")[0] == f"\\{name}q" or f"{name}q" in render.SYMBOLS, name
    assert len(render.SYMBOLS) == 122
    assert render.latex_math(r"\left(\frac{\partial f}{\partial x}\right) \leq \hbar")[0] == "(frac(diff  f, diff  x)) <=  planck.reduce "


def test_passages_are_restored_and_revisions_rebased():
    canonical = "# Titolo\n\nuno due tre quattro\n\ncinque sei sette otto"
    edited = "= Titolo\n\nuno due tre quattro (mio)\n\ncinque sette"
    assert render.restore_passage(edited, canonical, "cinque sei sette otto") == "= Titolo\n\nuno due tre quattro (mio)\n\ncinque sei sette otto"
    assert render.restore_passage(edited, canonical, "del tutto altro") is None and render.restore_passage("", canonical, "cinque sei sette otto") is None
    revised = canonical.replace("sei", "6")
    assert render.rebase_revision("= Titolo\n\nmio\n\ncinque sei sette otto", canonical, revised) == "= Titolo\n\nmio\n\ncinque 6 sette otto"
    assert render.rebase_revision("altro", canonical, revised) is None and render.rebase_revision("x", canonical, canonical) == "x"


def test_replacing_every_hit():
    assert render.replace_every("Pane pane panepane", "PANE", "x") == ("x x xx", 4) and render.replace_every("Pane panepane", "pane", "x", True) == ("x panepane", 1)


def test_plan_choices(spark):
    d = spark.createDataFrame([("ptserif", "deep", None), ("comic", None, True), (None, "odd", False)], "font string, indent string, noindent boolean")
    assert [(r.font, r.indent, r.extras, r.paper) for r in structure.valid_choices(d).collect()] == [("ptserif", "deep", [], "a4"), ("libertinus", "none", ["noindent"], "a4"), ("libertinus", "normal", [], "a4")]


def test_highlighted_words_and_sizes(spark):
    from quire.functions import text as T

    d = spark.createDataFrame([("Uno e uno due", ["due", "uno due"]), ("niente", [])], "t string, w array<string>")
    assert [r[0] for r in d.select(T.highlighted("t", F.col("w"))).collect()] == [["Uno e ", "uno due"], ["niente"]]
    s = spark.createDataFrame([(3.0, 4.0, 1.0), (0.0, 0.0, 7.0), (None, None, None)], "a double, b double, h double")
    assert [r[0] for r in s.select(T.font_size(F.col("a"), F.col("b"), F.col("h"))).collect()] == [5.0, 7.0, 0.0]
