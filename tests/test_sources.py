import json
import struct

from pyspark.sql import functions as F

from quire.external import ask, with_retry
from quire.settings import Settings
from quire.sources import files, responses
from quire.sources.store import Store, migrate, resumable
from quire.streaming.chunks import process_chunks
from quire.streaming.ingest import progress, save_parts

PNG = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 640, 480)
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 30, 40) + b"\0" * 9
WEBP = b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")


def test_files(spark):
    d = spark.createDataFrame([(bytearray(PNG),), (bytearray(JPEG),), (bytearray(WEBP),), (bytearray(b"x"),), (None,)], "content binary")
    assert [tuple(r)[1:] for r in files.with_image_size(d).collect()] == [(640, 480), (40, 30), (100, 50), (None, None), (None, None)]
    assert tuple(d.select(files.png_size(F.col("content"))).first()[0]) == (640, 480)
    e = spark.createDataFrame([("image/png", 10), ("text/plain", 10), ("application/pdf", 30_000_000), (None, None)], "m string, n long")
    assert [r[0] for r in e.select(files.file_error(F.col("m"), F.col("n"))).collect()] == [None, "type not supported", "file too large", "no file"]
    url = spark.range(1).select(files.data_url(F.lit("image/png"), F.lit(bytearray(b"ab"))).alias("u")).select("u", files.url_bytes(F.col("u")).alias("b")).first()
    assert url.u == "data:image/png;base64,YWI=" and bytes(url.b) == b"ab"


def test_responses(spark):
    call = lambda args: {"choices": [{"message": {"tool_calls": [{"function": {"arguments": args}}]}}]}
    bodies = [call(json.dumps([{"text": "a"}, {"markdown": "b"}])), call("not json"), {"choices": [{"message": {"content": "c"}}]}, {"choices": [{"message": {"content": [{"text": "d"}, "e"]}}]}, {"markdown": "f"}, {"data": [{"content": "g"}, {}]}, {}]
    d = spark.createDataFrame([(n, json.dumps(b)) for n, b in enumerate(bodies)], "k int, body string")
    assert [r[0] for r in d.orderBy("k").select(responses.extracted_text(F.col("body"))).collect()] == ["a\n\nb", "not json", "c", "d\ne", "f", "g", ""]
    box = {"xmin": 0.1, "ymin": 0.2, "xmax": 0.3, "ymax": 0.4}
    nested = spark.createDataFrame([(1, json.dumps(call(json.dumps([[{"type": "Title", "bbox": box, "text": "T"}]])))), (2, json.dumps(call(json.dumps([{"type": "Text", "bbox": box, "text": "x"}])))), (3, json.dumps({"text": "only"}))], "k int, body string")
    assert [(r.k, r.type, r.xmin, r.text) for r in responses.page_blocks(nested, ["k"]).orderBy("k").collect()] == [(1, "Title", 0.1, "T"), (2, "Text", 0.1, "x"), (3, "Text", None, "only")]
    models = spark.createDataFrame([(json.dumps({"data": [{"id": "b"}, {"id": "a"}, {"id": "b"}, {}]}), json.dumps({"models": [{"name": "models/x", "supportedGenerationMethods": ["generateContent"]}, {"name": "models/y"}]}))], "a string, b string")
    assert list(models.select(responses.model_names(F.col("a")), responses.model_names(F.col("b"), "generateContent")).first()) == [["a", "b"], ["x"]]
    assert responses.first_json('so: {"a": "}"} and {') == {"a": "}"}


def test_store_and_stream(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    schema = "id string, index int, text string"
    store.save("part", spark.createDataFrame([("a", 0, "x"), ("a", 2, "y"), ("b", 0, "z")], schema), F.lit("2024-01-01").cast("timestamp"))
    store.save("part", spark.createDataFrame([("a", 2, "new")], schema), F.lit("2024-01-02").cast("timestamp"))
    totals = spark.createDataFrame([("a", 4), ("b", 1)], "id string, total int")
    assert sorted(tuple(r) for r in store.parts(totals).collect()) == [("a", 0, "x"), ("a", 1, None), ("a", 2, "new"), ("a", 3, None), ("b", 0, "z")]
    assert store.read("part", "b").count() == 1
    store.delete(spark.createDataFrame([("a",)], "id string"))
    assert [r.id for r in store.read("part").collect()] == ["b"]
    store.save("figure", spark.createDataFrame([("b", "f1"), ("b", "f2")], "id string, path string").selectExpr("id", "path", "cast(null AS binary) AS bytes", "80 AS width_pct", "false AS junk"))
    store.delete_rows("figure", spark.createDataFrame([("b", "f1")], "id string, path string"))
    assert [(r.id, r.path) for r in store.read("figure").collect()] == [("b", "f2")]
    sessions = spark.createDataFrame([("a", "done", 9), ("b", "ocr", 3), ("c", "ocr", 5), ("d", None, 8)], "id string, status string, updated_at int")
    assert [r.id for r in resumable(sessions).collect()] == ["c"] and resumable(sessions.where("id = 'd'")).count() == 0
    blocks = "doc_id long, page int, block_idx int, type string, xmin double, ymin double, xmax double, ymax double, text string"
    spark.createDataFrame([(7, 0, 0, "Title", 0.1, 0.1, 0.9, 0.2, "T"), (7, 1, 0, "Text", 0.1, 0.3, 0.9, 0.4, "prosa")], blocks).write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # a second run finds nothing new
        save_parts(spark.readStream.schema(blocks).parquet(f"{tmp_path}/in"), store, f"{tmp_path}/check").awaitTermination()
    assert [tuple(r)[:3] for r in store.read("part", "7").orderBy("index").collect()] == [("7", 0, "# T"), ("7", 1, "prosa")]
    assert {r.id: r.done for r in progress(store, spark.createDataFrame([("7", 3)], "id string, total int")).collect()} == {"7": 2}


def test_migration(spark):
    schema = "id string, file_name string, status string, ocr struct<total:int,done:int,parts:array<string>>, chunks array<struct<text:string,status:string>>"
    s = spark.createDataFrame([("s1", "a.pdf", "ocr", (6, 4, ["p0", None, "p2", "", "p4", "p5"]), None), ("s2", "b.pdf", "done", None, [("t", "done"), ("u", "done")])], schema)
    records, parts, summaries = migrate(s)
    assert "parts" not in records.schema["ocr"].dataType.names
    assert [(r.id, r["index"]) for r in parts.collect()] == [("s1", 0), ("s1", 2), ("s1", 4), ("s1", 5)]
    assert sorted(tuple(r)[3:] for r in summaries.collect()) == [("format", 2, 2), ("ocr", 4, 6)]


def test_external_and_settings(spark):
    tries = []

    def flaky(prompt):
        tries.append(prompt)
        if len(tries) < 3:
            raise RuntimeError("503 overloaded")
        return "ok"

    waits = []
    assert with_retry(flaky, sleep=waits.append)("p") == "ok" and waits == [15.0, 30.0]
    got = ask(spark.createDataFrame([(1, "x"), (2, "bad")], "k int, prompt string"), lambda p: p.upper() if p != "bad" else 1 / 0, "k", "prompt").orderBy("k").collect()
    assert (got[0].answer, got[0].error) == ("X", None) and got[1].answer is None and "zero" in got[1].error
    assert Settings.read({"max_pages": "99999", "chunk_size": "x", "strict": "0"}) == Settings(2000, 5000, 2600, False)


def test_settings_are_put_right_and_stored():
    got = Settings.read({"ocr_engine": "other", "fix_engine": "gemini", "max_pages": "12abc", "chunk_size": "-4", "fix_typos": "0", "compare_ocr": "yes", "vision_model": "old", "endpoint": "https://ai.api.nvidia.com/v1/gr/meta/nemotron-parse-1.1"})
    assert (got.ocr_engine, got.fix_engine, got.max_pages, got.chunk_size, got.fix_typos, got.compare_ocr) == ("nvidia", "gemini", 12, 1000, False, False)
    assert got.vision_ocr_model == got.vision_markup_model == "old" and got.endpoint == Settings().endpoint
    kept = got.stored()
    assert kept["fix_typos"] == "0" and kept["max_pages"] == "12" and "ocr_key" not in kept and Settings.read(kept) == got


def test_addresses_models_and_reviews(spark):
    d = spark.createDataFrame([("https://x.org/v1/chat/completions?a=1",), ("https://x.org/chat/completions/",), ("https://x.org/other",), ("nothing",)], "u string")
    assert [r[0] for r in d.select(responses.models_url(F.col("u"))).collect()] == ["https://x.org/v1/models", "https://x.org/models", "https://x.org/v1/models", responses.MODELS_URL]
    names = spark.createDataFrame([("Alpha",), ("beta",)], "name string")
    assert [r.name for r in responses.matching_models(names, "ALP").collect()] == ["Alpha"] and responses.matching_models(names, "zz").count() == 2
    issues = spark.createDataFrame([(1, "diff-1")], "k int, id string")
    answers = spark.createDataFrame([(1, "diff-1", "uncertain", "x" * 300), (1, "diff-2", "uncertain", ""), (1, "diff-1", "odd", "")], "k int, id string, classification string, explanation string")
    assert [len(r.explanation) for r in responses.reviewed_differences(answers, issues, ["k"]).collect()] == [240]
    p = spark.createDataFrame([("proposal", "new"), ("proposal", " "), ("odd", "new"), ("artifact", None)], "c string, t string")
    assert [tuple(r[0]) for r in p.select(responses.passage_choice(F.col("c"), F.col("t"), F.lit("old"))).collect()] == [("proposal", "new"), ("proposal", None), ("canonical", "old"), ("artifact", "old")]
    assert responses.outer_json('a {"b": {"c": 1}} d') == {"b": {"c": 1}}


def test_chunks_follow_each_other_and_the_best_attempt_stays(spark, tmp_path):
    kept_at = iter(range(1000))

    def kept(t):
        path = f"{tmp_path}/t{next(kept_at)}"
        t.write.parquet(path)
        return spark.read.parquet(path)

    long = "alfa beta gamma delta epsilon zeta eta theta. "

    def model(prompt):
        text, preamble, outline, note = prompt.split("|")
        if "FAIL" in text:
            raise RuntimeError("broken")
        if "HARD" in text and not note:
            return "= Solo titolo"
        return ("#set x\n" if not preamble and "primo" in text else "") + text.replace("# ", "== ")

    rows = [(1, 0, f"# primo\n{long}"), (1, 1, f"HARD {long}"), (2, 0, "FAIL"), (2, 1, long)]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_idx int, text string")
    got = {(r.doc_id, r.chunk_idx): r for r in process_chunks(chunks, model, lambda *c: F.concat_ws("|", *c), kept).collect()}
    assert set(got) == {(1, 0), (1, 1), (2, 0)} and got[2, 0].status == "error"
    assert got[1, 0].preamble == "#set x" and got[1, 0].body.startswith("= primo") and got[1, 0].coverage == 1.0
    assert got[1, 1].coverage == 1.0 and got[1, 1].body.startswith("HARD") and got[1, 1].status == "done"
