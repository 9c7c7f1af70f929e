import random

import numpy as np
import pyarrow as pa

from quire.llm import language

VOWELS = {"aa": ("ka", "lo", "mi", "tan"), "bb": ("sch", "ung", "ei", "keit"), "cc": ("ción", "que", "ado", "ñ")}


def sentence(rnd, lang, n):
    return " ".join("".join(rnd.choice(VOWELS[lang]) for _ in range(rnd.randint(1, 4))) + rnd.choice(["", "", ".", ","]) for _ in range(n))


def test_marginals_match_enumeration():
    rnd = np.random.default_rng(1)
    lengths = np.array([3, 1, 0, 4])
    emit, moves = rnd.normal(size=(8, 2)), rnd.normal(size=(2, 2))
    post, pairs = language.marginals(emit, moves, lengths, joint=True)
    at, want_pairs = 0, np.zeros((2, 2))
    for chain, n in enumerate(lengths):
        want, joint, total = np.zeros((n, 2)), np.zeros((2, 2)), 0.0
        for code in range(2**n):
            path = [code >> i & 1 for i in range(n)]
            w = np.exp(sum(emit[at + i, s] for i, s in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:], strict=False)))
            total += w
            for i, s in enumerate(path):
                want[i, s] += w
            for a, b in zip(path, path[1:], strict=False):
                joint[a, b] += w
        if n:
            assert np.allclose(post[at : at + n], want / total)
            want_pairs += joint / total
        at += n
    assert np.allclose(pairs, want_pairs)


def test_transitions_are_fitted_with_many_languages():
    rnd = random.Random(9)
    syllables = [f"{a}{b}" for a in "bcdfghjklmnp" for b in "aeiou"]
    own = {f"l{k:02d}": rnd.sample(syllables, 4) for k in range(30)}
    say = lambda lang, n: " ".join("".join(rnd.choice(own[lang]) for _ in range(3)) for _ in range(n))
    model = language.train([(say(lang, 60), lang) for lang in own for _ in range(20)])
    off = model.moves[~np.eye(30, dtype=bool)]
    assert np.isfinite(model.moves).all() and off.mean() < np.diag(model.moves).mean() and np.abs(model.moves).max() < 5
    asked = [(say(lang, 30), lang) for lang in own]
    got, _ = language.predict(model, pa.array([t for t, _ in asked], pa.large_string()))
    assert np.mean([g == lang for g, (_, lang) in zip(got, asked, strict=True)]) > 0.9


def test_all_letters_of_a_text_without_blanks_count():
    rnd = random.Random(4)
    model = language.train([(sentence(rnd, lang, 80), lang) for lang in VOWELS for _ in range(30)])
    middle = ",".join(sentence(rnd, "bb", 1).strip(".,") for _ in range(60))
    assert language.predict(model, pa.array([f"lo,mi,{middle},ka,lo"], pa.large_string()))[0] == ["bb"]
    joined = "".join(sentence(rnd, "bb", 1).strip(".,") for _ in range(60))
    assert language.predict(model, pa.array([f"lomitan{joined}kalomi"], pa.large_string()))[0] == ["bb"]


def test_held_out_accuracy_and_edges(spark):
    rnd = random.Random(3)
    langs = sorted(VOWELS)
    rows = [(i, sentence(rnd, langs[i % 3], rnd.choice([5, 60])), langs[i % 3]) for i in range(240)]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 ... !", "bb"), (None, sentence(rnd, "bb", 9), "bb"), (0, *rows[0][1:]), (1003, "lo " * 30000, None)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    got = language.languages(docs).collect()
    assert len(got) == len(rows)
    truth = {i: lang for i, _, lang in rows[:240]}
    tested = [r for r in got if r.doc_id in truth and r.held_out]
    assert len(tested) > 20 and np.mean([r.lang_pred == truth[r.doc_id] for r in tested]) > 0.95
    by = {r.doc_id: r for r in got}
    assert all(r.held_out == (r.doc_id is not None and language.is_held_out(r.doc_id)) and 0 <= r.score <= 1 for r in got)
    assert [by[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3 and by[None].lang_pred == "bb" and by[1003].lang_pred == "aa"
    assert language.languages(docs.limit(0)).count() == 0


def test_words_of_a_mixed_text():
    rnd = random.Random(5)
    model = language.train([(sentence(rnd, lang, 80), lang) for lang in VOWELS for _ in range(30)])
    text = sentence(rnd, "aa", 12) + " " + sentence(rnd, "bb", 12)
    labels = [lang for _, lang, _ in language.label_words(model, text)]
    assert sum(x == "aa" for x in labels[:12]) >= 11 and sum(x == "bb" for x in labels[12:]) >= 11
    assert language.predict(model, pa.array([""], pa.large_string()))[0] == ["und"]
