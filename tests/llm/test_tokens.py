import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import packing, store, tokens
from quire.llm.shared import new_path

ROWS = [(1, "Hello there, world.\n\nNew   line"), (2, None), (3, ""), (5, "a" * 5000), (5, "x y"), (None, "no key"), (7, "x y"), (8, "<|endoftext|> \n\n<|endoftext|>  é")]
SCHEMA = "doc_id long, text string, length long, start string"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.tokenizer_path())


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(*r, 9, "clash") for r in ROWS], SCHEMA)


def long_rows(n=300):
    rnd = random.Random(4)
    return [(i, " ".join(rnd.choice(["alpha", "beta.", "gamma\n", "δέλτα", "don't", "x1"]) for _ in range(rnd.choice([3, 40, 700, 2600])))) for i in range(n)]


def test_units_give_the_librarys_ids(tokenizer):
    rnd = random.Random(1)
    bits = [" ", "\n", "a", "b", "é", ".", "'s", "1", "\t", "<|endoftext|>", "  ", " ", "日本", "²"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 12))) for _ in range(5000)]
    enc = tokens.UnitEncoder(tokens.tokenizer_path())
    ids, at = enc.encode(tokens.strings(pa.array(texts)))
    want = [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:z].tolist() for a, z in zip(at[:-1], at[1:], strict=True)] == want
    assert enc.counts(tokens.strings(pa.array(texts))).tolist() == [len(x) for x in want]


def test_token_counts(spark, docs, tokenizer):
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(docs, limit=100).collect())
    want = []
    for k, t in ROWS:
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        want.append((k or 0, len((t or "").encode()), n, n > 100))
    assert got == sorted(want)
    assert tokens.token_counts(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(spark, docs, name):
    got = {r.n_bytes: r.n_tokens for r in tokens.token_counts(docs, name).collect()}
    assert got[0] == 0 and got[5000] > 0


def test_store_round_trip(spark, docs, tokenizer):
    for frame, rows in ((docs, ROWS), (spark.createDataFrame(long_rows(), "doc_id long, text string"), long_rows())):
        path = new_path(spark, "t")
        store.write_store(frame, path)
        got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in store.read_store(spark, path).collect())
        want, at = [], 0
        for k, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
            ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
            want.append((at, k, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
        assert got == want
    assert [len(x) for x in store.lookup(spark, path, rows[0][0])] == [want[0][2]]
    assert store.lookup(spark, path, 10**9) == []
    path = new_path(spark, "t")
    store.write_store(docs.limit(0), path)
    assert store.read_store(spark, path).count() == 0


def test_perfect_hash_is_minimal_and_perfect():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 7, 1000, 20000):
        keys = np.unique(rnd.integers(-(2**62), 2**62, n)) if n > 5 else np.arange(n) - 1
        displace, slot = store.build_index(keys)
        assert sorted(slot.tolist()) == list(range(len(keys)))
        if len(keys):
            assert (store.find_slots(keys, displace, len(keys)) == slot).all()


def test_packing(spark, docs, tokenizer):
    for frame, rows in ((docs, ROWS), (spark.createDataFrame(long_rows(), "doc_id long, text string"), long_rows())):
        got = packing.pack(frame, 128).collect()
        want = []
        for k, t in rows:
            ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
            at = 0
            for i, n in enumerate(packing.cut_lengths(len(ids), 128)):
                want.append((k or 0, i, at, n, zlib.crc32(ids[at : at + n].tobytes())))
                at += n
        assert sorted((r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
        bins = {}
        for r in got:
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for own in bins.values():
            at = 0
            for offset, n in sorted(own):
                assert offset == at
                at += n
            assert at <= 128
        assert len(bins) <= -(-sum(r.length for r in got) // 128) * 1.05 + 1
    assert packing.pack(docs.limit(0), 128).count() == 0


def test_pattern_is_the_fullest():
    rnd = random.Random(3)
    for _ in range(200):
        items = [rnd.randint(1, 30) for _ in range(rnd.randint(1, 9))]
        hist = {x: items.count(x) for x in items}
        pattern = packing.fullest(hist, max(items), 30)
        rest = sorted(items)
        rest.remove(max(items))
        sums = {0}
        for x in rest:
            sums |= {s + x for s in sums}
        assert sum(k * n for k, n in pattern.items()) == max(items) + max(s for s in sums if s + max(items) <= 30)
        assert all(hist[k] >= n for k, n in pattern.items())
        assert sum(sum(p.values()) * n for p, n in packing.solve(hist, 30)) == len(items)
