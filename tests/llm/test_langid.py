import random
import unicodedata

import numpy as np

from tagloom.llm import langid, queries
from tests.conftest import SF_CHECK
from tests.llm.conftest import row


def plain_grams(text):
    s = "".join(c.lower()[0] if c.isalpha() else " " for c in text or "")
    s = " " + " ".join(s.split(" ")) + " "
    while "  " in s:
        s = s.replace("  ", " ")
    return [s[i:i + 3] for i in range(len(s) - 2)]


def test_grams_are_letters_between_edges():
    for t in (None, "", "12 !", "A.", "Éa--b c", "İx 日本 ß", " a  b "):
        want = plain_grams(t)
        got = langid.grams(t)
        assert len(got) == len(want)
        assert len(set(got.tolist())) == len(set(want))


def test_filter_returns_all_languages_without_false_negatives():
    r = random.Random(1)
    for count in (3, 130):  # one word of bits, several words
        members = [(r.getrandbits(63), r.randrange(count)) for _ in range(4000)]
        m = langid.build([f"l{i:03}" for i in range(count)], members, langid.Params(slots_log2=12))
        g = np.array([x for x, _ in members], np.int64).view(np.uint64)
        mask = m.slots[langid.places(g, m.params)[0]]
        for at in langid.places(g, m.params)[1:]:
            mask = mask & m.slots[at]
        assert all(int(mask[i, b // 64]) >> (b % 64) & 1 for i, (_, b) in enumerate(members))
        # the correction: n-grams that were never added count about nothing
        fresh = np.array([r.getrandbits(63) for _ in range(20000)], np.uint64)
        mask = m.slots[langid.places(fresh, m.params)[0]]
        for at in langid.places(fresh, m.params)[1:]:
            mask = mask & m.slots[at]
        rate = np.mean([(int(x) & 1) for x in mask[:, 0]])
        assert abs(rate - m.false_rate[0]) < 0.02


def test_held_out_accuracy(spark):
    got = queries.op5_language_id(spark, SF_CHECK).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF_CHECK}/documents.parquet").collect()}
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(truth) and len(held) > 100
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_odd_rows(spark, odd, none):
    extra = spark.createDataFrame([row(200 + i, "und der die das nicht ein", "de") for i in range(5)] + [row(300, "...", "fr"), row(301, "12 34"), row(302, "日本", None)], odd.schema)
    docs = odd.unionByName(extra)
    model = langid.train(docs)
    assert set(model.langs) == {"en", "de", "fr"}
    rows = langid.predict(spark, docs, model).collect()
    assert len(rows) == docs.count()
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows}
    for i in (20, 21, 22, 300, 301):
        assert got[i] == ("und", 0.0)
    assert got[200][0] == "de" and got[10][0] == "en" and got[302] == ("en", 0.0)
    assert langid.predict(spark, none, model).count() == 0
    untaught = langid.train(none)
    assert {r["lang_pred"] for r in langid.predict(spark, odd, untaught).collect()} == {"und"}


def exact(text, sets, order):
    """The prediction from exact sets in place of the filter."""
    g = plain_grams(text)
    if not any(c.isalpha() for c in text or ""):
        return "und"
    hits = {x: sum(y in sets[x] for y in g) for x in order}
    return max(order, key=lambda x: (hits[x], -len(sets[x]), -order.index(x)))


def test_small_languages_predict_their_rows_as_exact_sets_do(spark):
    """Languages of one and two rows beside those of the documents."""
    greek, russian = "Καλημέρα σε όλους τους φίλους μας", ["Привет как дела сегодня", "До свидания и всего хорошего"]
    given = spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("doc_id", "text", "lang")
    rows = [tuple(r) for r in given.collect()] + [(10**6, greek, "el"), (10**6 + 1, russian[0], "ru"), (10**6 + 2, russian[1], "ru"), (None, "Καλημέρα", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    sets, count = {}, {}
    for i, t, x in rows:
        if x is not None and i is not None:
            sets.setdefault(x, set()).update(plain_grams(t))
            count[x] = count.get(x, 0) + 1
    order = sorted(sets, key=lambda x: (-count[x], x))
    assert model.langs == order
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(spark, docs, model).collect()}
    assert got[10**6][0] == "el" and got[10**6 + 1][0] == got[10**6 + 2][0] == "ru" and got[10**6][1] > 0.9 and got[None][0] == "el"
    wrong = [i for i, t, _ in rows if i is not None and got[i][0] != exact(t, sets, order)]
    assert len(wrong) <= 0.002 * len(rows)  # a near tie of the sets may fall otherwise by a false positive


def test_letters_are_unicode_letters():
    table = langid.letters()
    for c in [*range(0x3000), 0xAC00, 0x4E00, 0x1F600, 0x10400]:
        assert (table[c] != 32) == unicodedata.category(chr(c)).startswith("L"), hex(c)
