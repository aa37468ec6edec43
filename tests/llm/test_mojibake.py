import random
import re
import time
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from weftline.llm.mojibake import CELLS, Candidate, PairModel, Restorer, _count_pairs, find_garbled, rebuilt, restore, segments

LETTERS = {
    "fr": ("bcdfglmnprstv", "aeiouéèêàâ"), "es": ("bcdflmnprstvñ", "aeiouáéíóú"), "de": ("bdfghklmnrstwß", "aeiouäöü"), "pl": ("bcdklmnprsztwłśćżź", "aeiouąęóy"),
    "ru": ("бвгдзклмнпрст", "аеиоуыэюя"), "el": ("βγδζκλμνπρστ", "αεηιουώάέή"), "ja": ("日月火水木金町川山田", "のはがにをですまし"), "en": ("bcdfghklmnprstw", "aeiou"),
}


def vocabulary(rng, lang):
    c, v = LETTERS[lang]
    return ["".join(rng.choice(c) + rng.choice(v) for _ in range(rng.randrange(1, 5))) for _ in range(150)]


def page(rng, words, lang):
    return ("" if lang == "ja" else " ").join(rng.choice(words) for _ in range(60)) + "."


def misread(text, written, read):
    return text.encode(written).decode(read)


@pytest.fixture(scope="module")
def found(spark):
    rng = random.Random(12)
    rows, truth, right = [], set(), {}
    vocab = {lang: vocabulary(rng, lang) for lang in LETTERS}
    for i in range(640):
        lang = sorted(LETTERS)[i % len(LETTERS)]
        rows.append([i, page(rng, vocab[lang], lang)])
    ways = {
        "fr": ("utf-8", "latin-1"), "es": ("utf-8", "mac-roman"), "de": ("cp1252", "cp437"), "pl": ("utf-8", "cp1251"), "ru": ("cp1251", "latin-1"),
        "el": ("utf-8", "latin-1"), "ja": ("shift_jis", "latin-1"),
    }
    for i in range(0, 640, 13):
        lang = sorted(LETTERS)[i % len(LETTERS)]
        if lang in ways:
            right[i] = rows[i][1]
            rows[i][1] = misread(rows[i][1], *ways[lang])
            if rows[i][1] != right[i]:
                truth.add(i)
    rows[7][1] = rows[7][1].replace(" ", " cafÃ© ", 1)
    rows[15][1] = "Search for Ã© in your files and put é back by hand."
    rows[23][1] = rows[23][1][:40] + "�" + rows[23][1][40:]
    truth |= {7, 23}
    rows += [[9000, None], [9001, ""], [9002, "plain"]]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, word string")
    got = {r.doc_id: r.restored for r in find_garbled(df).collect()}
    return got, truth, right


def test_found(found):
    got, truth, _ = found
    missed, wrong = truth - set(got), set(got) - truth
    assert len(missed) <= 0.05 * len(truth) and len(wrong) <= 2, (missed, wrong)
    assert 15 not in got and 7 in got and 23 in got


def test_restored(found):
    got, _, right = found
    share = [sum(a == b for a, b in zip(got[i].split(), right[i].split(), strict=False)) / len(right[i].split()) for i in right if i in got]
    assert sum(share) / len(share) > 0.8
    assert "café" in got[7]


def test_nothing(spark):
    assert find_garbled(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_segments():
    assert segments(np.array([-1, 2, 2, -1, 2, -9, 3.0, -1]), 2.5) == [(1, 5), (6, 7)]
    assert segments(np.array([]), 1) == [] and segments(np.array([-1.0, -2.0]), 1) == []


class Cafes:
    """Knows one damaged run only."""

    known = frozenset()

    def token(self, token):
        return [Candidate(1.0, m.start(), m.end(), "é", ("latin-1", "utf-8")) for m in re.finditer("Ã©", token)]


def test_every_run_of_a_token_is_restored():
    token = "cafÃ©,sound,мир," * 30
    assert restore(f"x {token}", Cafes(), {token: Cafes().token(token)}) == (1, f"x {token.replace('Ã©', 'é')}")
    nested = [Candidate(2.0, 0, 4, "ÃÂ©", ("latin-1", "utf-8")), Candidate(1.0, 2, 4, "Â©", ("latin-1", "utf-8"))]
    assert restore("ÃÃÂ©", Cafes(), {"ÃÃÂ©": nested}) == (1, "ÃÂ©")


def test_quotations():
    def known(*tokens):
        return {t: Cafes().token(t) for t in tokens}

    one, many = "Search for cafÃ© and write café.", "cafÃ© thÃ© prÃ© blÃ© dÃ© read café thé pré blé dé."
    assert restore(one, Cafes(), known("cafÃ©"))[0] == 0 and restore(many, Cafes(), known("cafÃ©", "thÃ©", "prÃ©", "blÃ©", "dÃ©"))[0] == 0
    assert restore("cafÃ© thÃ© prÃ© read café.", Cafes(), known("cafÃ©", "thÃ©", "prÃ©"))[0] == 3


def test_damage_glued_to_another_script():
    words = ["слово", "дело", "время", "место", "человек", "словом", "\u2014", "слово\u2014дело"] * 40
    rows = [" ".join(words)] * 20
    model = fit_of(rows)
    restorer = Restorer(model)
    token = "слово" + "\u2014".encode().decode("cp1252") + "дело"
    best = restorer.token(token)[0]
    assert token[: best.lo] + best.text + token[best.hi :] == "слово\u2014дело"


def test_a_very_long_word():
    words = ["日本の町は川が山を", "слово", "дело"] * 50
    restorer = Restorer(fit_of([" ".join(words)] * 20))
    token = ("日本の町は川が山を" + "слово".encode().decode("cp1252", "replace").replace("\ufffd", "") + "x") * 4000
    began = time.time()
    found = restorer.token(token)
    rebuilt(token, found, {}, restorer.token)
    assert time.time() - began < 60 and len(token) > 60_000


def fit_of(texts):
    counts = Counter(w for t in texts for w in t.split() if not w.isascii())
    frame = pd.DataFrame({"word": list(counts), "n": list(counts.values())})
    pairs, chars = np.zeros(CELLS, np.float32), np.zeros(0x110000, np.float32)
    for part in _count_pairs(iter([frame])):
        for kind, table in ((0, pairs), (1, chars)):
            rows = part[part.kind == kind]
            table[rows.cell.to_numpy()] = rows.n.to_numpy()
    return PairModel(pairs, chars, float(chars.sum()))
