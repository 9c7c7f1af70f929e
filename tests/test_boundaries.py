import pytest

from quire.operators import boundaries

known = lambda w: w.lower() in {"cercando", "indicandoli", "perdevate"}


@pytest.mark.parametrize(("text", "words", "want", "kinds"), [
    ("Lui stava cercando.\n\ncercando il punto giusto", None, "Lui stava cercando il punto giusto", ["boundary_overlap"]),
    ("Lui stava cercando\n\n<!-- pagina 2 -->\n\ncercando il punto", None, "Lui stava\n<!-- pagina 2 -->\ncercando il punto", ["boundary_overlap"]),
    ("Lui stava cercando\n\n<!-- pagina 2 -->\n\ncando il punto", None, "Lui stava cercando\n<!-- pagina 2 -->\nil punto", ["boundary_word_split"]),
    ("Lui stava cer\n\n<!-- pagina 2 -->\n\ncando il punto", known, "Lui stava\n<!-- pagina 2 -->\ncercando il punto", ["boundary_word_split"]),
    ("Stava indi-\ncandoli tutti.", known, "Stava indicandoli tutti.", ["line_word_split"]),
    ("che voi per-\n\n19\n\n<!-- pagina 2 -->\n\ndevate molto", known, "che voi\n<!-- pagina 2 -->\nperdevate molto", ["page_number_furniture", "boundary_word_split"]),
    ("<!-- pagina 3 -->\nStoria della lingua\n19\nTesto.", None, "<!-- pagina 3 -->\nTesto.", ["running_header_furniture", "page_number_furniture"]),
    ("<!-- pagina 3 --> Storia della lingua 19\n\nTesto.", None, "<!-- pagina 3 -->\nTesto.", ["running_header_furniture", "page_number_furniture"]),
    ("Una frase aperta,\n\n<!-- pagina 2 -->\n\nche continua.", None, "Una frase aperta,\n<!-- pagina 2 -->\nche continua.", ["boundary_paragraph_continuation"]),
    ("Fine.\n\nFine della storia.", None, "Fine.\n\nFine della storia.", []),
    ("", None, "", []),
])
def test_repairs(text, words, want, kinds):
    got, changes = boundaries.repair(text, 10, words)
    assert (got, [c["type"] for c in changes]) == (want, kinds)
    assert boundaries.repair(got, 10, words)[0] == got


def test_documents(spark):
    d = spark.createDataFrame([(1, "Lui stava cer\n\n<!-- pagina 2 -->\n\ncando il punto"), (2, None)], "doc_id int, text string")
    words = spark.createDataFrame([("cercando",)], "word string")
    got = {r.doc_id: r for r in boundaries.repair_boundaries(d, words).collect()}
    assert got[1].text == "Lui stava\n<!-- pagina 2 -->\ncercando il punto" and got[1].changes[0].overlap == "cando" and got[2].changes == []
