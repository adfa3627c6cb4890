from collections import Counter

import numpy as np
import pytest

from foliant.llm import language as G
from tests.conftest import rows


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder.replace('sf0.001', 'sf0.01')}/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return G.LanguageModel().fit(G.training_sample(docs, "doc_id", "text", "lang"))


@pytest.mark.parametrize(("label", "code"), [("en", "en"), ("EN", "en"), ("en_GB", "en"), ("English", "en"), ("ger", "de"), ("Deutsch", "de"), ("zh_Hans", "zh"), ("pt-BR", "pt"), ("", None), (" ", None), (None, None), ("und", None), ("unknown", None), ("sv", "sv"), ("中文", "zh")])
def test_labels(label, code):
    assert G.named(label) == code


def test_prose():
    assert G.prose_words("TX470-24") == [] and G.prose_words("PORTZ0_CFG1 = 0x1234;  /* */") == []
    assert G.prose_words("A7 26 24 98 87 8F 8D 0A 98 6B DF 0E 41 17") == [] and G.prose_words("short line, no") == [] and G.prose_words("") == []
    assert G.prose_words("On QV9A-32, pin P32.9 is driven low.") == ["on", "pin", "is", "driven", "low"]
    assert G.prose_words("THE VALUE IS LATCHED AFTER RESET")[:2] == ["the", "value"]
    assert G.prose_words("如果ASCQ_RX当电源仍在上升时发生翻转，总线桥接器")
    assert max(map(len, G.prose_words("x" * 100 + " words of prose"))) <= 24


def test_forward_sums_all_segmentations():
    pieces = {"▁": 0, "a": 1, "b": 2, "ab": 3, "▁a": 4, "<latin>": 5, "<greek>": 6, "<cyrillic>": 7, "<han>": 8, "<other>": 9}
    p = np.zeros((11, 2))
    p[:10] = np.random.default_rng(1).random((10, 2))
    want = p[0] * p[1] * p[2] + p[0] * p[3] + p[4] * p[2]
    assert np.allclose(np.exp(G._Lattice(["ab"], pieces).score(p, 1))[0], want)
    assert np.allclose(np.exp(G._Lattice(["aж"], pieces).score(p, 1))[0], p[0] * p[1] * p[7] + p[4] * p[7])
    uses = G._Lattice(["ab"], pieces).expected(p, np.ones((1, 2)))
    assert np.allclose(uses[3], p[0] * p[3] / want) and np.allclose(uses[2] + uses[3], 1)


def test_held_out_accuracy(docs, model):
    """Documents outside the sample whose label names a language: nearly all agree, and those that don't are mislabelled ones."""
    sample = {t for _, t in G.training_sample(docs, "doc_id", "text", "lang")}
    right = Counter()
    for r in docs.filter("lang IS NOT NULL").collect():
        code = G.named(r.lang)
        words = [w for line in r.text.split("\n") if (w := G.prose_words(line))]
        if code in G.LANGUAGES and words and (r.text not in sample or len(right) < 0):
            right[G.LANGUAGES[int(model.tell(model.scores(words)).sum(0).argmax())] == code] += 1
    assert not right or right[True] / sum(right.values()) > 0.85


SENTENCES = {
    "en": "The bus bridge stays disabled at the end of each frame.", "de": "Die Leitung sollte kurz sein, denn die Trimmzelle reagiert auf jede Störung.", "fr": "Le pont de bus reste désactivé avant le premier accès.",
    "es": "El valor se retiene durante la fase de reposo y ya no puede cambiarse.", "pt": "O valor é retido durante a fase de repouso e já não pode ser alterado.", "it": "Il valore viene bloccato prima del primo accesso e non si può più cambiare.",
    "nl": "De waarde wordt aan het einde van elk frame vastgehouden en kan niet meer worden gewijzigd.", "ru": "Мост шины остаётся выключенным до первого обращения.", "zh": "总线桥接器在第一次访问之前保持关闭状态，因此读取得到的结果总是零。",
}


def test_sentences_and_wrong_labels(spark, model):
    data = [(i, t, lang) for i, (lang, t) in enumerate(SENTENCES.items())]
    data += [(100, SENTENCES["de"], "en"), (101, SENTENCES["de"], "German"), (102, SENTENCES["de"], None), (103, None, "en"), (104, "", "en"), (105, "P1 = 0x2;", "en"), (None, SENTENCES["fr"], "en")]
    data.append((106, "\n".join([SENTENCES["ru"], "TX470-9", "", SENTENCES["ru"], SENTENCES["en"]]), "rus"))
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string")
    got = G.languages(df.selectExpr("*", "1 AS d", "2 AS line_no", "3 AS confidence"), "doc_id", "text", "lang", model)
    main = {r.doc_id: r for r in got.filter("line_no = 0").collect()}
    assert all(main[i].lang == lang and main[i].label_ok and not main[i].mixed and main[i].confidence > 0.9 for i, lang in enumerate(SENTENCES))
    assert [main[i].label_ok for i in (100, 101, 102)] == [False, True, False] and not {103, 104, 105} & set(main)
    assert main[106].mixed and main[106].lang == "ru" and main[106].label_ok
    assert rows(got.filter("doc_id = 106 AND line_no > 0"), "line_no", "lang") == [(1, "ru"), (4, "ru"), (5, "en")]


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, SENTENCES["en"], None)], "doc_id bigint, text string, lang string")
    assert G.languages(df, "doc_id", "text", "lang").count() == 0 and G.languages(df.limit(0), "doc_id", "text", "lang").count() == 0


def test_long_text(spark, model):
    df = spark.createDataFrame([(1, "\n".join([SENTENCES["en"]] * 20_000), "en")], "doc_id bigint, text string, lang string")
    assert G.languages(df, "doc_id", "text", "lang", model).count() == 20_001
