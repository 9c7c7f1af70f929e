import pytest

from quire.operators import layout

SCHEMA = "doc_id long, page int, block_idx int, type string, xmin double, ymin double, xmax double, ymax double, text string"


def blocks(spark, rows):
    return spark.createDataFrame([(1, 1, n, t, *(b or (None,) * 4), x) for n, (t, b, x) in enumerate(rows)], SCHEMA)


def flags(df):
    return [r.furniture for r in layout.page_furniture(df).orderBy("block_idx").collect()]


@pytest.mark.parametrize(("rows", "want"), [
    ([("Text", (0.4, 0.86, 0.5, 0.89), "19")], [True]),
    ([("Page-number", (0.4, 0.84, 0.5, 0.88), "XIX")], [True]),
    ([("Text", (0.1, 0.14, 0.5, 0.18), "Storia della lingua"), ("Text", (0.6, 0.14, 0.7, 0.18), "11"), ("Text", (0.1, 0.28, 0.9, 0.4), "Corpo del testo")], [True, True, False]),
    ([("Text", (0.1, 0.14, 0.5, 0.18), "Storia della lingua")], [False]),
    ([("Section-header", (0.1, 0.10, 0.5, 0.16), "Titolo vero"), ("Text", (0.6, 0.14, 0.7, 0.18), "11")], [False, True]),
    ([("Text", (0.1, 0.86, 0.9, 0.9), "19 pazienti furono visti"), ("Text", (0.1, 0.5, 0.9, 0.6), "1985"), ("Text", (0.1, 0.86, 0.9, 0.9), "i")], [False, False, False]),
])
def test_furniture(spark, rows, want):
    assert flags(blocks(spark, rows)) == want


def assembled(spark, rows):
    return layout.assemble_pages(blocks(spark, rows)).first().markdown


def test_headings_and_notes(spark):
    assert assembled(spark, [("Title", (0.1, 0.1, 0.9, 0.15), "Titolo del libro"), ("Section-header", (0.1, 0.2, 0.9, 0.25), "2.3 Metodo")]) == "# Titolo del libro\n\n## 2.3 Metodo"
    prose = ("Text", (0.1, 0.2, 0.9, 0.4), "Prosa <sup>1</sup>")
    one = assembled(spark, [prose, ("Text", (0.1, 0.84, 0.9, 0.86), "1 Nota lunga"), ("Text", (0.1, 0.88, 0.9, 0.91), "— Trad. it. di X")])
    assert one == "Prosa <footnote>Nota lunga — Trad. it. di X</footnote>"


def test_reading_order_and_captions(spark):
    rows = [("Text", (0.1, 0.3, 0.45, 0.4), "left"), ("Text", (0.55, 0.1, 0.9, 0.2), "right"), ("Text", (0.1, 0.1, 0.45, 0.2), "left first"), ("Text", None, "no box")]
    got = [r.block_idx for r in layout.order_blocks(blocks(spark, rows)).orderBy("reading_order").collect()]
    assert got == [2, 0, 1, 3]
    wide = [("Text", (0.05, 0.5, 0.95, 0.55), "across"), ("Text", (0.1, 0.6, 0.4, 0.7), "c"), ("Text", (0.1, 0.1, 0.4, 0.2), "a"), ("Text", (0.6, 0.1, 0.9, 0.2), "b")]
    assert [r.block_idx for r in layout.order_blocks(blocks(spark, wide)).orderBy("reading_order").collect()] == [2, 3, 0, 1]
    pictures = [("Picture", (0.1, 0.1, 0.9, 0.3), ""), ("Caption", (0.1, 0.29, 0.9, 0.31), "Fig [1]"), ("Picture", (0.1, 0.6, 0.9, 0.8), "")]
    assert [tuple(r)[2:] for r in layout.captions(blocks(spark, pictures)).collect()] == [(0, 1)]
    assert assembled(spark, pictures) == "![Fig 1](/figures/fig-1.png)\n\n![](/figures/fig-2.png)"


def test_text_layer(spark):
    items = spark.createDataFrame([(1, 1, 0, 50.0, 700.0, 18.0, "Titolo"), (1, 1, 1, 50.0, 650.0, 10.0, "prima"), (1, 1, 2, 90.0, 651.0, 10.0, "riga"), (1, 1, 3, 50.0, 600.0, 10.0, "altra")], "doc_id long, page int, item_idx int, x double, y double, size double, str string")
    lines = layout.text_lines(items)
    assert [r.text for r in lines.orderBy("line_no").collect()] == ["Titolo", "prima riga", "altra"]
    assert layout.body_size(lines).first().body == 10
    assert [tuple(r) for r in layout.heading_sizes(lines).collect()] == [(1, 18, 1)]
    assert [r.paragraph for r in layout.paragraph_numbers(lines).orderBy("line_no").collect()] == [1, 2, 3]
