import random

import numpy as np

from weftline.llm.hashing import Tokens, Windows, sliding, winnow
from weftline.llm.near_duplicates import SQL_TOKEN, NearDuplicates, signature
from weftline.llm.shared_spans import SharedSpans, line_duplicates


def texts_of(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "id string, text string, c string")


def shingles(text, k):
    import re

    t = [x.lower() for x in re.findall(SQL_TOKEN, text)]
    return {tuple(t[i : i + k]) for i in range(len(t) - k + 1)}


def corpus(rng, n=60):
    words = [f"w{i}" for i in range(400)]
    rows = []
    for f in range(n // 6):
        base = [rng.choice(words) for _ in range(rng.randrange(30, 90))]
        for c in range(6):
            t = list(base)
            for _ in range(rng.randrange(0, 9)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((f"d{f:02}{c}", " ".join(t)))
    rows += [("copy1", rows[0][1].upper()), ("copy2", rows[0][1] + ";"), ("short", "a b c"), ("empty", ""), ("null", None)]
    return rows


def test_near_duplicates_against_brute_force(spark):
    rows = corpus(random.Random(3))
    sets = {i: s for i, t in rows if t and len(s := shingles(t, 3)) >= 20}
    want = {(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])}
    near = NearDuplicates(texts_of(spark, rows), (3, 5), SQL_TOKEN, 3, 20)
    got = [tuple(r) for r in near.pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_classes_are_named_by_their_least_id_and_links_tell_all_pairs(spark):
    rows = corpus(random.Random(4))
    sets = {i: frozenset(s) for i, t in rows if t and len(s := shingles(t, 3)) >= 20}
    near = NearDuplicates(texts_of(spark, rows), (3, 5), SQL_TOKEN, 3, 20)
    name = {i: min(j for j in sets if sets[j] == s) for i, s in sets.items()}
    links = {tuple(r) for r in near.class_links().collect()}
    want = {(i, name[i], sum(name[i] in pair for pair in links)) for i in sets}
    assert {tuple(r) for r in near.groups().collect()} == want and ("d000", "copy1") in {w[:2] for w in want}
    told = {(a, b) for a in sets for b in sets if a < b and (name[a] == name[b] or tuple(sorted((name[a], name[b]))) in links)}
    assert told == {tuple(r) for r in near.pairs().collect()}


def test_one_hot_class_and_band(spark):
    words = [f"w{i}" for i in range(40)]
    rows = [(f"c{i:03}", " ".join(words)) for i in range(60)] + [(f"e{i:03}", " ".join([*words, f"x{i}"])) for i in range(40)]
    near = NearDuplicates(texts_of(spark, rows), (3, 5), SQL_TOKEN, 3, 20)
    assert near.pairs().count() == 100 * 99 // 2 and near.groups().where("class_id = 'c000' and n_links = 40").count() == 60


def test_near_duplicates_of_nothing(spark):
    assert NearDuplicates(texts_of(spark, [])).pairs().count() == 0
    assert NearDuplicates(texts_of(spark, [("a", "x y z"), ("b", None)])).pairs().count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(-(2**62), 2**62, 300)
    b = np.concatenate([a[:200], rng.integers(-(2**62), 2**62, 100)])
    agree = np.mean([np.mean(signature(a, 512) == signature(b, 512))])
    assert abs(agree - 200 / 400) < 0.1


def test_windows_and_winnowing():
    t = "xyzabcabc–éabc" * 9
    h = Windows(t).of(5)
    assert len(h) == len(t) - 4
    for i in range(0, len(h), 7):
        assert {int(j) for j in np.flatnonzero(h == h[i])} == {j for j in range(len(h)) if t[j : j + 5] == t[i : i + 5]}
    x = np.random.default_rng(2).integers(0, 2**60, 200).astype(np.uint64)
    assert (sliding(x, 7, True) == [x[i : i + 7].min() for i in range(194)]).all()
    marks = set(winnow(x, 7).tolist())
    assert all(marks & set(range(i, i + 7)) for i in range(194)) and len(winnow(x[:5], 7)) == 0
    assert len(Tokens().runs(["a", "b"], 3)) == 0 and len(Tokens().runs(["a"] * 9, 3)) == 1


def brute_shared(rows, length):
    out = {}
    rows = [(i, t) for i, t in rows if t]
    for i, t in rows:
        hit = set()
        for s in range(len(t) - length + 1):
            w = t[s : s + length]
            if any(j != i and w in u for j, u in rows):
                hit |= set(range(s, s + length))
        if hit:
            out[i] = len(hit)
    return out


def test_shared_spans_against_brute_force(spark):
    rng = random.Random(8)
    letters = "abcdefgh éü–中\n\r"
    piece = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [piece(n) for n in (149, 150, 151, 200, 420)]
    rows = []
    for i in range(24):
        parts = []
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            cut = rng.randrange(0, 40)
            parts += [piece(rng.randrange(60)), p[cut:] if rng.random() < 0.3 else p]
        rows.append((f"t{i}", "".join([*parts, piece(30)])))
    rows += [("same1", passages[3] + "q"), ("same2", passages[3] + "q"), ("tiny", "abc"), ("tiny2", "abc"), ("rep", "ab" * 200), ("rep2", "x" + "ab" * 100), ("null", None)]
    got = {r.id: r.shared_chars for r in SharedSpans(texts_of(spark, rows)).shared_chars().collect()}
    assert got == brute_shared(rows, 150)
    assert SharedSpans(texts_of(spark, [])).shared_chars().count() == 0


def test_line_duplicates(spark):
    line = "SELECT something FROM somewhere"
    rows = [("b", f"{line}\r\nunique to this record here\n{line.lower()}"), ("a", f"x\n  {line.replace(' ', '  ')}  "), ("c", None), ("d", "x")]
    got = {(r.id, r.start, r.stop, r.kept_id, r.kept_start) for r in line_duplicates(texts_of(spark, rows)).collect()}
    assert got == {("b", 0, 31, "a", 2), ("b", 60, 91, "a", 2)}
