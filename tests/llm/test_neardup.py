import os
import random

import numpy as np
import pytest

from quire.llm import components, neardup


def shingle_set(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(rows[a][0]), find(rows[b][0])
                root[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i), find(i) == i) for (i, _), s in zip(rows, sets, strict=True))


def corpus(seed, bases=12):
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randint(0, 4000)}"
    out = ["", None, " \n ", "one two", "One  TWO", "one two three four five", "x", "one two"]
    for _ in range(bases):
        base = [word() for _ in range(rnd.choice([8, 40, 200]))]
        for _ in range(rnd.choice([1, 2, 6, 14])):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 45))):
                copy[rnd.randrange(len(copy))] = word()
            out.append(rnd.choice([" ", "\n", "  "]).join(copy))
    rnd.shuffle(out)
    ids = rnd.sample(range(1, 5000), len(out))
    return list(zip(ids, out, strict=True))


@pytest.mark.parametrize("block", [512, 4])
def test_groups_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK_TEXTS", block)
    rows = corpus(block)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_shingles int, v string")
    got = neardup.near_groups(docs).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)
    left = neardup.drop_near_copies(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [r[0] for r in brute(rows) if r[3]]


def test_odd_rows(spark):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (3, "A b\tc d e f"), (4, "other words in this text here"), (9, "other words in this text here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.near_groups(docs).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in got) == [(0, None, True), (3, 3, True), (4, 3, False), (4, 3, False), (4, 4, True), (9, 4, False)]
    assert neardup.near_groups(docs.limit(0)).count() == 0


def test_clashing_names_long_texts_and_types_of_ids(spark):
    long_text = " ".join(f"w{i % 9973}" for i in range(60_000))
    rows = [(1, long_text), (2, long_text + " end"), (3, "short text of five words"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").selectExpr("*", "1 AS _gone", "2 AS _kept", "3 AS u", "4 AS comp")
    left = neardup.drop_near_copies(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 3, 4]
    with pytest.raises(TypeError):
        neardup.near_groups(docs.selectExpr("cast(doc_id AS string) AS doc_id", "text"))


def test_rows_of_one_id_in_a_large_family_stay_single(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_TEXTS", 3)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base[:k], "x", *base[k + 1 :]])) for i, k in enumerate(range(0, 60, 7))] + [(5, " ".join(base)), (5, " ".join(base[1:]))]
    got = neardup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and {r.component_id for r in got} == {0}


def test_components_of_a_long_path_and_a_star(spark):
    rnd = random.Random(1)
    names = list(range(200))
    rnd.shuffle(names)
    path = list(zip(names[:100], names[1:100], strict=False)) + [(names[100], x) for x in names[101:]] + [(5, 5)]
    got = dict(tuple(r) for r in components.components(spark.createDataFrame(path, "u long, v long")).collect())
    for part in (names[:100], names[100:]):
        assert all(got[x] == min(part) for x in part if x != min(part)) and min(part) not in got


GIVEN = "/root/testdata/sf0.01/documents.parquet"


def all_links(texts):
    """Every pair of texts that are similar, by counting common shingles over lists of the texts of each."""
    words = [(t or "").encode().lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set() for w in words]
    places = {}
    for k, own in enumerate(sets):
        for s in own:
            places.setdefault(s, []).append(k)
    arrays = {s: np.array(p) for s, p in places.items() if len(p) > 1}
    for k, own in enumerate(sets):
        parts = [arrays[s] for s in own if s in arrays]
        if parts:
            common = np.bincount(np.concatenate(parts), minlength=len(sets))[:k]
            for j in np.flatnonzero(common).tolist():
                if 100 * common[j] >= 75 * (len(own) + len(sets[j]) - common[j]):
                    yield j, k, words[j] != words[k]


@pytest.mark.skipif(not os.path.exists(GIVEN), reason="the given tables aren't here")
def test_recall_over_all_links_of_a_whole_table(spark):
    docs = spark.read.parquet(GIVEN)
    rows = docs.select("doc_id", "text").collect()
    got = {r.doc_id: r.component_id for r in neardup.near_groups(docs).collect()}
    links = [(got[rows[a].doc_id] == got[rows[b].doc_id], differ) for a, b, differ in all_links([r.text for r in rows])]
    assert len(links) > 50 and all(joined for joined, differ in links if not differ)
    assert sum(joined for joined, differ in links if differ) >= 0.99 * sum(differ for _, differ in links)
