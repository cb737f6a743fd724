import os
import sys

import numpy as np
import pytest

from kilnspark.llm import languages, pairs, refusals
from kilnspark.llm.confusables import consistent

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import phrasings  # noqa: E402

Q = "Fill the gap (one word): the bakers of Oldbridge celebrate the harvest feast with ____."
ASKED = f"Answer with exactly one English word.\nQuestion: {Q}\nAnswer:\n{Q}"


@pytest.mark.parametrize("text", [None, "", "  \n", "​", "...", "--", "____", '""', "n/a", "N/A", "NULL", "[empty]", "(empty)", "<blank>", "[no output]", "None"])
def test_empty(text):
    assert pairs.is_empty(text)


@pytest.mark.parametrize("text", ["bread", "blank", "Empty.", "nullable", "no", "(answer: net)", "7"])
def test_not_empty(text):
    assert not pairs.is_empty(text)


@pytest.mark.parametrize(
    "text",
    ["I'm sorry, but I can't help with that.", "I must decline to answer.", "No answer from my side, sorry.", "As a language model, I am unable to give an answer here.", "REQUEST DECLINED.", "I won’t do that.", "Against my instructions. I will leave the line as it stands."],
)
def test_refusal(text):
    assert refusals.model().is_refusal(consistent(text))


@pytest.mark.parametrize("text", ["Sorry for the delay, the answer is bread.", "I can't use that word, so I would say bread.", "I am not able to use the first word, but bread works well.", "bread", "A baker cannot do without it, so the answer is bread."])
def test_no_refusal(text):
    assert not refusals.model().is_refusal(consistent(text))


@pytest.mark.parametrize("text", [Q, Q.upper(), "the bakers of Oldbridge celebrate the harvest feast with ____.", f"Question: {Q}\nAnswer:", f"“{Q}”"])
def test_copy(text):
    assert pairs.is_copy(text, Q, ASKED)


@pytest.mark.parametrize("text", ["bread", "harvest", Q.replace("____", "bread"), "The bakers of Oldbridge celebrate with bread, as ____ know."])
def test_no_copy(text):
    assert not pairs.is_copy(text, Q, ASKED)


@pytest.fixture(scope="module")
def model():
    return languages.fit_languages([])


@pytest.mark.parametrize(
    "text",
    [
        "Das fehlende Wort ist Brot, weil es am besten passt.",
        "La réponse est pain, parce que ce mot va bien ici.",
        "La palabra que falta es pan, porque todos lo saben.",
        "La parola che manca è pane, perché tutti lo conoscono.",
        "Het ontbrekende woord is brood, omdat dat het beste past.",
        "Brakujące słowo to chleb, ponieważ najlepiej pasuje.",
        "Пропущенное слово: хлеб.",
        "答えはパンです。",
    ],
)
def test_foreign(model, text):
    assert languages.is_foreign(model, consistent(text), Q)


@pytest.mark.parametrize("text", ["bread", "jalapeño", "It is café.", 'The word is "Brot" in German, and bread in English.', "Sоrrу fоr thе dеlау, thе аnѕwеr іѕ brеаd.", "I would choose bread. Nothing else fits the feast as well as this word does.", ""])
def test_english(model, text):
    assert not languages.is_foreign(model, consistent(text), Q)


def test_all_defects_of_a_table(spark):
    schema = "id long, src string, text string, question string, asked string, defect_type int, cut int"
    rows = [
        (1, "a", None, Q, ASKED, 0, 0),
        (2, "a", "I must decline to answer.", Q, ASKED, 0, 0),
        (3, "a", Q, Q, ASKED, 0, 0),
        (4, "a", "Das fehlende Wort ist Brot, weil es am besten passt.", Q, ASKED, 0, 0),
        (5, "a", "bread", None, None, 0, 0),
        (None, "a", "", None, None, 0, 0),
        (2, "a", "I must decline to answer.", Q, ASKED, 0, 0),
    ]
    got = pairs.defects(spark.createDataFrame(rows, schema)).collect()
    assert sorted(((r["id"], r["defect_type"]) for r in got), key=repr) == sorted([(1, "empty"), (2, "refusal"), (2, "refusal"), (3, "copy"), (4, "other_language"), (None, "empty")], key=repr)
    assert pairs.defects(spark.createDataFrame([], schema)).collect() == []


def test_second_fit_counts_all_answers_in_any_order(spark):
    texts = [f"The answer is the {a} that fits the {b} best, and nobody knows why number {i} left." for i in range(900) for a, b in [("anchor", "candle")]]
    last = "The answer is the quizzaciously word that fits the sentence best."
    texts += [last.replace("word", f"word of {w}") for w in ("people", "water", "bread")]
    assert len(" ".join(texts)) > languages.FIT_CHARS
    a, b = languages.fit_languages(texts), languages.fit_languages(texts[::-1])
    assert "quiz" in a.grams_at and a.grams_at == b.grams_at and np.array_equal(a.table, b.table)
    rows = spark.createDataFrame([(t,) for t in texts + texts[:5]] + [(None,)], "text string")
    for parts in (1, 7):
        c = languages.fit_answers(rows.repartition(parts))
        assert c.grams_at == a.grams_at and np.array_equal(c.table, a.table)


@pytest.mark.parametrize("text", ["빵", "정답은 빵입니다.", "الخبز", "לחם", "रोटी", "ขนมปัง", "面包", "正确的词是面包。", "ψωμί", "odpowiedzią jest", "Najprawdopodobniej odpowiedź", "powiedziałbym"])
def test_foreign_in_any_script_and_length(model, text):
    assert languages.is_foreign(model, consistent(text), Q)


@pytest.mark.parametrize("text", ["π", "bread (빵)", "The word is хлеб in Russian, and bread in English.", "Hammer", "résumé", "piñata", "7"])
def test_english_with_other_letters(model, text):
    assert not languages.is_foreign(model, consistent(text), Q)


def test_refusals_in_words_that_are_not_in_the_tables():
    m = refusals.model()
    found, wrong = sum(map(m.is_refusal, phrasings.REFUSALS)), sum(map(m.is_refusal, phrasings.HARMLESS))
    assert len(phrasings.REFUSALS) >= 195 and len(phrasings.HARMLESS) >= 200
    assert found >= 0.9 * len(phrasings.REFUSALS) and found >= 0.95 * (found + wrong)


def test_the_refusal_model_is_the_same_at_every_fit():
    assert np.array_equal(refusals.RefusalModel().w, refusals.model().w)


FOREIGN = """Ordet som saknas är bröd, eftersom man alltid behöver det.
Det manglende ord er hus, fordi alle kender det.
Jeg tror ordet er båt, men jeg er ikke helt sikker.
Puuttuva sana on talo, koska se sopii parhaiten.
Orðið sem vantar er hestur, af því að allir þekkja það.
Ma arvan, et õige sõna on maja, sest seda teavad kõik.
Es domāju, ka pareizais vārds ir māja, jo to zina visi.
Manau, kad teisingas žodis yra namas, nes visi jį žino.
Myslím, že správné slovo je dům, protože ho každý zná.
Myslím si, že správne slovo je strom, lebo ho každý pozná.
Mislim, da je prava beseda hiša, ker jo vsi poznajo.
Mislim da je prava riječ kuća, jer je svi poznaju.
Azt hiszem, a helyes szó a ház, mert mindenki ismeri.
Cred că răspunsul corect este casa, pentru că toată lumea știe asta.
Bence doğru kelime ev, çünkü herkes onu bilir.
Tôi nghĩ từ đúng là ngôi nhà, vì ai cũng biết nó.
Saya kira kata yang benar adalah rumah, karena semua orang mengetahuinya.
Sa tingin ko ang tamang salita ay bahay, dahil alam ito ng lahat.
Nadhani neno sahihi ni nyumba, kwa sababu kila mtu analijua.
Crec que la paraula correcta és casa, perquè tothom la coneix.
Uste dut hitz egokia etxea dela, denek ezagutzen dutelako.
Rwy'n credu mai'r gair cywir yw tŷ, achos mae pawb yn ei wybod.
Ceapaim gurb é teach an focal ceart, mar tá a fhios ag gach duine.
Mendoj se fjala e duhur është shtëpi, sepse të gjithë e dinë.
Ek dink die regte woord is huis, want almal ken dit.
Mi pensas ke la ĝusta vorto estas domo, ĉar ĉiuj konas ĝin.
Naħseb li l-kelma t-tajba hija dar, għax kulħadd jafha.
Menimcha, to'g'ri so'z uy, chunki uni hamma biladi.
Puto verbum rectum esse domum, quia omnes id sciunt.""".split("\n")


@pytest.mark.parametrize("text", FOREIGN)
def test_languages_in_sentences_that_are_not_in_the_fit(model, text):
    assert languages.is_foreign(model, consistent(text), Q)


def test_names_are_unknown_and_not_foreign(model):
    names = "Karvipeak Lenbolin Gertubach Molfalin Hálmur Oldbridge Thomas Guillermo Kowalski Björn Nakamura Istanbul".split()
    assert not any(languages.is_foreign(model, n + ".", Q) for n in names)


def test_long_texts_have_a_posterior_too(model, monkeypatch):
    text = "Das fehlende Wort ist Brot. " * 40
    want = model.scores(text)
    monkeypatch.setattr(languages, "WORDS_KEPT", 8)
    assert np.allclose(model.scores(text), want)
