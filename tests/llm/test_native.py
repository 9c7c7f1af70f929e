import random
import re
from collections import Counter

import numpy as np
import pytest

from quire.llm import exact, quality

WORD = re.compile("[^\x20\x09-\x0d]+")


def texts():
    rnd = random.Random(2)
    out = [None, "", "  \n ", "one", "a b c d e f g h", "x " * 9, "line\nline\n\n \nline", "# $ | & < >", "a\x0bb\x0cc\rd\te f\x1cg"]
    for _ in range(60):
        vocabulary = rnd.choice([3, 30, 3000])
        out.append("".join(f"w{rnd.randint(0, vocabulary)}{rnd.choice(' ' * 9 + chr(10))}" for _ in range(rnd.choice([10, 25, 120]))))
    phrase = " ".join(f"p{i}" for i in range(12))
    out += [f"{phrase} middle {phrase} end {phrase}", f"{phrase} {phrase}", "日本 " * 30 + phrase]
    return out


def measured(t):
    w = WORD.findall(t or "")
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = set()
    for i in range(len(w) - 7):
        if seen[tuple(w[i : i + 8])] > 1:
            covered |= set(range(i, i + 8))
    lines, dup, met = (t or "").split("\n"), 0, set()
    for x in lines:
        if WORD.search(x):
            dup += x in met
            met.add(x)
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t or "")), dup, len(covered)


def test_quality_measures(spark):
    rows = [(i, t, 1, 2.0) for i, t in enumerate(texts())] + [(None, "twice", 1, 2.0)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words long, kept double")
    got = quality.quality(docs).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    want = sorted(((i, *measured(t)) for i, t, *_ in rows), key=key)
    assert [tuple(r[:6]) for r in sorted(got, key=key)] == want
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept) and 0 <= r.posterior <= 1
    assert quality.quality(docs.limit(0)).count() == 0
    good = quality.good_documents(docs)
    assert good.columns == docs.columns
    assert sorted(r.doc_id for r in good.collect()) == sorted(r.doc_id for r in got if r.kept)


def votes_of(rnd, n, alone=0.0):
    """Votes of six rules, two for each of three kinds of junk; rule 0 alone is wrong on some good documents."""
    votes, truth = Counter(), Counter()
    for _ in range(n):
        kind = rnd.choices([None, 0, 1, 2], [0.7, 0.15, 0.1, 0.05])[0]
        wrong = kind is None and rnd.random() < alone
        own = tuple(None if rnd.random() < 0.1 else 0 if wrong and j == 0 else int(rnd.random() < (0.1 if j // 2 == kind else 0.98)) for j in range(6))
        votes[own] += 1
        truth[own] += kind is None
    return votes, truth


KINDS3 = [(0, 1), (2, 3), (4, 5)]


def plain_em(rows, k, kinds, rounds):
    """The same estimation, document by document, with arrays."""
    x = np.array([[2 if v is None else v for v in r] for r in rows])
    first = np.array([quality.START_SHARE, *[(1 - quality.START_SHARE) / len(kinds)] * len(kinds)])
    start = np.array([[quality.START_GOOD] * k, *[[quality.START_SEEN if j in kind else quality.START_OTHER for j in range(k)] for kind in kinds]])
    share, chance = first, start
    for _ in range(rounds):
        like = np.stack([share[c] * np.prod([np.where(x[:, j] == 2, 1.0, chance[c, j, np.minimum(x[:, j], 1)]) for j in range(k)], axis=0) for c in range(len(first))], axis=1)
        w = like / like.sum(axis=1, keepdims=True)
        size = quality.BELIEF * first + w.sum(axis=0)
        seen = quality.BELIEF * start + np.stack([[[w[x[:, j] == v, c].sum() for v in range(3)] for j in range(k)] for c in range(len(first))])
        share, chance = size / size.sum(), seen / seen.sum(axis=2, keepdims=True)
    like = np.stack([share[c] * np.prod([np.where(x[:, j] == 2, 1.0, chance[c, j, np.minimum(x[:, j], 1)]) for j in range(k)], axis=0) for c in range(len(first))], axis=1)
    return (like / like.sum(axis=1, keepdims=True))[:, 0]


@pytest.mark.parametrize("alone", [0.0, 0.02, 0.1, 0.3])
def test_em_tells_junk_from_a_rules_own_errors(alone):
    votes, truth = votes_of(random.Random(5), 5000, alone)
    found = quality.fit(list(votes.items()), 6, KINDS3)
    assert abs(found.shares[0] - 0.7) < 0.1
    assert found.good((1,) * 6) > 0.9 and all(found.good(tuple(int(j // 2 != k) for j in range(6))) < 0.5 for k in range(3))
    assert found.good((0, 1, 1, 1, 1, 1)) > 0.5 or alone == 0.1  # a common bad vote alone is an error; at 0.1 the counts fit either reading
    kept = {v: found.good(v) >= 0.5 for v in votes}
    right = lambda test: sum(truth[v] if test(v) else n - truth[v] for v, n in votes.items())
    posterior, majority = right(lambda v: kept[v]), right(lambda v: v.count(1) > v.count(0))
    assert posterior > right(lambda v: 0 not in v) and posterior > majority
    quality.fit([((1, 1, 1), 10**9), ((0, 1, 1), 10**6)], 3)  # classes without documents keep their start
    assert quality.fit([], 3).shares[0] == pytest.approx(quality.START_SHARE)


def test_em_by_patterns_matches_a_plain_one():
    votes, _ = votes_of(random.Random(3), 600, 0.05)
    rows = [v for v, n in votes.items() for _ in range(n)]
    found = quality.fit(list(votes.items()), 6, KINDS3, rounds=30, tolerance=0.0)
    assert [found.good(r) for r in rows] == pytest.approx(plain_em(rows, 6, KINDS3, 30).tolist(), abs=1e-9)


def test_verdicts_of_the_query_match_a_plain_version(spark):
    rnd = random.Random(4)
    good = lambda n: " ".join(rnd.choice("river stone letter morning window garden little yellow") + str(rnd.randint(0, 400)) for _ in range(n))
    texts = [good(rnd.randint(30, 90)) for _ in range(120)] + [" | ".join(good(40).split()) for _ in range(15)] + ["WIN!!! " * 40] * 6 + ["aa aa aa aa bb bb bb bb cc cc cc cc " * 3] * 6 + [good(9)] * 4
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stored = quality.measures(docs, "text")
    votes = [tuple(r) for r in stored.orderBy("doc_id").select(*[v.alias(k) for k, v in quality.rules().items()]).collect()]
    want = plain_em(votes, len(votes[0]), quality.kinds_of(list(quality.rules())), 500)
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    assert [got[i].posterior for i in range(len(texts))] == pytest.approx(want.tolist(), abs=1e-6)
    assert all(got[i].kept == (not got[i].base_failed and want[i] >= quality.KEEP_FROM) for i in got)
    assert all(got[i].kept for i in range(120)) and not any(got[i].kept for i in range(120, len(texts)))


def test_few_distinct_words_scale_with_length(spark):
    texts = [" ".join(f"w{i % d}" for i in range(n)) for n in (1900, 2100, 12_000) for d in (40, 1200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    votes = [r[0] for r in quality.measures(docs).orderBy("doc_id").select(quality.rules()["variety"]).collect()]
    assert votes[0] == votes[2] == votes[4] == 0 and votes[1] == votes[3] == 1 and votes[5] != 0


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_groups(spark, keep):
    rows = [(5, "a"), (3, "a"), (3, "a"), (9, None), (8, ""), (7, "b"), (None, "a"), (None, "c"), (1, "a" * 50_000), (2, "a" * 50_000), (2, "A")]
    rows += [(100 + i, "hot") for i in range(300)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, keep_id long, s string")
    got = exact.exact_groups(docs, keep).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    size = {}
    for r in got:
        size.setdefault(r.text_sha256, []).append(r)
    assert sorted(len(v) for v in size.values()) == sorted(len(v) for v in groups.values())
    least = lambda x: (x is not None, x or 0)
    for own in size.values():
        ids = [r.doc_id for r in own]
        assert {r.keep_id for r in own} == {min(ids, key=least) if keep == "smallest" else max(ids, key=least)}
        assert sum(r.kept for r in own) == 1 and all(r.group_size == len(own) for r in own)
        assert all(r.doc_id == r.keep_id for r in own if r.kept)
    assert exact.exact_groups(docs.limit(0), keep).count() == 0
    left = exact.drop_copies(docs, keep)
    assert left.columns == docs.columns and left.count() == len(groups)


def test_drop_copies_with_clashing_maps_or_no_further_columns(spark):
    rows = [(1, "a"), (2, "a"), (2, "a"), (None, "b"), (3, None), (4, "")]
    two = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id or 0) for r in exact.drop_copies(two).collect()) == [0, 1, 3]
    clashing = two.selectExpr("doc_id", "text", "1 AS _key", "2 AS _digest", "3 AS _own_digest", "4 AS _place", "5 AS `a.b`", "map('k', doc_id) AS m", "6 AS _s", "7 AS _k")
    left = exact.drop_copies(clashing)
    assert left.columns == clashing.columns and sorted((r.doc_id or 0) for r in left.collect()) == [0, 1, 3]
    text_ids = two.selectExpr("cast(doc_id AS string) AS doc_id", "text")
    assert sorted((r.doc_id or "") for r in exact.drop_copies(text_ids, "largest").collect()) == ["", "2", "4"]
