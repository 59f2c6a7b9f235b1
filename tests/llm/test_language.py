import random
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.conftest import odd_texts
from wirebook.llm import language

STEMS = {
    "en": "the and that with from this have which their would there about other these".split(),
    "de": "der die und nicht mit auch eine werden über können zwischen für durch".split(),
    "ru": "это который также после между может быть если когда время людей".split(),
}


def make(lang, n):
    return " ".join(random.choice(STEMS[lang]) for _ in range(n))


def corpus():
    random.seed(11)
    langs = sorted(STEMS)
    return [(i, make(langs[i % 3], random.randint(3, 80))) for i in range(300)], lambda i: langs[(i or 0) % 3]


def test_held_out_accuracy_and_odd_rows(docs):
    rows, lang = corpus()
    table = docs(*rows, lang=lang).withColumn("held", language.held_out(F.col("doc_id")))
    model = language.Model(language.learn(table.where("NOT held")))
    got = language.predict(table, model).collect()
    assert len(got) == 300
    held = [r for r in got if r.row.held]
    assert {r.row.doc_id for r in held} == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r.lang_pred == lang(r.row.doc_id) for r in held]) > 0.97
    odd = {r.row.doc_id: r for r in language.predict(docs(*odd_texts()), model).collect()}
    for i in (1, 2, 3):
        assert (odd[i].lang_pred, odd[i].score) == ("und", 0)
    assert all(0 <= r.score <= 1 for r in odd.values()) and odd[7].lang_pred in STEMS


def test_mixed_text_is_cut_into_spans(docs):
    rows, lang = corpus()
    model = language.Model(language.learn(docs(*rows, lang=lang)))
    text = make("en", 30) + " " + make("de", 60) + " " + make("ru", 10)
    *_, path, _ = model.spans(pa.array([text], pa.large_string()))
    names = [model.langs[k] for k in path]
    assert names[5:25] == ["en"] * 20 and names[35:85] == ["de"] * 50 and names[90:] == ["ru"] * 10
    assert sum(a != b for a, b in zip(names, names[1:], strict=False)) == 2


def plain_spans(model, text):
    """Runs of one language over the words with letters, by the path of the model."""
    words = [m for m in re.finditer(r"[^\x20\x09-\x0D]+", text) if any(unicodedata.category(c)[0] == "L" for c in m[0].lower())]
    *_, path, _ = model.spans(pa.array([text], pa.large_string()))
    out = []
    for m, k in zip(words, path, strict=True):
        letters = sum(unicodedata.category(c)[0] == "L" for c in m[0].lower())
        if out and out[-1][2] == model.langs[k]:
            out[-1][1:] = [m.end(), model.langs[k], out[-1][3] + letters]
        else:
            out.append([m.start(), m.end(), model.langs[k], letters])
    return [tuple(x) for x in out]


def test_spans_are_an_output(docs):
    rows, lang = corpus()
    model = language.Model(language.learn(docs(*rows, lang=lang)))
    mixed = " \n" + make("en", 30) + " 12 -- " + make("de", 60).upper() + "\t" + make("ru", 20) + " ... 7 "
    texts = [(50, mixed), (51, "12 the and that 5"), (52, " the "), (53, mixed * 3), *odd_texts()]
    got = language.predict(docs(*texts), model).collect()
    assert len(got) == len(texts)
    of = dict(texts)
    for r in got:
        text = of[r.row.doc_id] or ""
        spans = [tuple(s) for s in r.spans]
        assert spans == plain_spans(model, text)
        letters = {}
        for s in spans:
            letters[s[2]] = letters.get(s[2], 0) + s[3]
        if spans:
            assert letters[r.lang_pred] == max(letters.values()) and r.score == max(letters.values()) / sum(letters.values())
        else:
            assert (r.lang_pred, r.score) == ("und", 0)
    one = next(r for r in got if r.row.doc_id == 50)
    assert [s.lang for s in one.spans] == ["en", "de", "ru"] and mixed[one.spans[0].start : one.spans[0].end].count(" ") == 29


def test_path_against_plain_viterbi(docs):
    rows, lang = corpus()
    model = language.Model(language.learn(docs(*rows, lang=lang)))
    rng = np.random.default_rng(1)
    model.penalty = 40
    sizes = [0, 1, 7, 30, 30, 2, 0]
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    scores = rng.integers(-50, 0, (bounds[-1], 3))
    path = model.best_path(scores, bounds)

    def worth(s, p):
        return s[np.arange(len(p)), p].sum() - 40 * (p[1:] != p[:-1]).sum()

    for a, b in zip(bounds, bounds[1:], strict=False):
        value = np.zeros(3, int)
        for t in range(a, b):
            value = (value if t == a else np.maximum(value, value.max() - 40)) + scores[t]
        if b > a:
            assert worth(scores[a:b], path[a:b]) == value.max()


def test_nothing_learned(docs):
    model = language.Model(language.learn(docs((1, "a")).where("false")))
    assert [r.lang_pred for r in language.predict(docs((1, "a b")), model).collect()] == ["und"]
    rows, lang = corpus()
    model = language.Model(language.learn(docs(*rows, lang=lang)))
    assert language.predict(docs((1, "a")).where("false"), model).collect() == []
