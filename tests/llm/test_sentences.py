import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnwork.llm.sentences import sentence_units, sentences


def units(text):
    return [text[s:e] for s, e in sentences(text)]


@pytest.mark.parametrize("want", [
    ["Dr. Fig wrote it.", "See Fig. 8 and Sec. 50.2 for X vs. placebo.", "It rose by 2.5 mg."],
    ["The dose was given at 11 p.m.", "As J. Smith et al. wrote, it fell."],
    ["He wrote: \"Is this it? I doubt it.\" and left.", "\"I cannot hold a cup.\"", "It fell (p = .07).", "It rose."],
    ["The rate fell... and then it doubled.", "Really?!", "pH values fell.", "No change."],
    ["What is it?", "ok so day 5!!!", "day 7: nothing yet.", "i stopped it."],
    ["Am 4. Juni fiel der Wert.", "Vgl. Abb. 8 und Tab. 64.", "Die 2. Gabe erfolgte um 4 Uhr.", "„Ich schlafe nicht. Nachts gehe ich.“"],
    ["Elle a dit : « Je ne dors plus. Je marche. » puis elle est partie.", "« Je me sens mieux. »", "Voir M. Dupont, p. ex. le soir."],
    ["Dijo: «No duermo. Camino.» y pidió ayuda.", "¿Había temblor?", "¡No hubo cambios!", "La Dra. Ruiz bajó la dosis, p. ej. antes."],
    ["Врач И. П. Иванов отменил, т. е. вдвое.", "См. рис. 9 и табл. 3.", "В 4 ч. участник № 70 ушёл."],
])
def test_with_blanks_between(want):
    assert units("  " + " ".join(want) + " ") == want


@pytest.mark.parametrize("want", [
    ["他说：“我睡不着。白天也没有。”随后要求减量。", "“我好多了。”", "真的吗？！", "剂量为7.1毫克……持续。"],
    ["「眠れない。昼もだるい。」と話した。", "「もう大丈夫です。」", "症状は改善した……しかし再発した。"],
])
def test_without_blanks(want):
    assert units("".join(want)) == want


def test_other_scripts():
    hi = ["डॉ. Rembly के अनुसार 13.7 मि.ग्रा. दी गई।", "drug लेने के बाद?", "नहीं!"]
    assert units(" ".join(hi)) == hi
    ar = ["خفض د. Tembly الجرعة إلى 21.2 ملغ.", "قالت: \"لا أنام. أمشي ليلا.\" ثم طلبت المساعدة.", "هل كانت الدوخة موجودة؟"]
    assert units(" ".join(ar)) == ar
    ko = ["환자는 \"잠이 안 온다. 낮에도 피곤하다.\"라고 말하였다(점수 3.5).", "drug 투여 후 나타났다."]
    assert units(" ".join(ko)) == ko
    th = ["ผู้ป่วย 17 รายจาก 67 รายหยุดยาเอง", "หลังได้รับยา drug แล้วดีขึ้น", "ไม่พบอาการ"]
    assert units(" ".join(th)) == th


def test_lines():
    assert units("Adverse Reactions\nIt fell.\n\n1. avoid doses above 5 mg\n2. take it with water\nThe end.") == [
        "Adverse Reactions", "It fell.", "1. avoid doses above 5 mg", "2. take it with water", "The end."]
    assert units("The rater denied\nno further pain, cf. Fig.\n18, panel\nb. In week 3 it was\nDr. Smith.") == ["The rater denied\nno further pain, cf. Fig.\n18, panel\nb.", "In week 3 it was\nDr. Smith."]
    assert units("- one\n- two\n") == ["- one", "- two"]
    assert units("It ended.Then it began.") == ["It ended.", "Then it began."]


def test_odd_texts():
    assert sentences(None) == sentences("") == sentences(" \n\t ") == []
    assert units("no end") == ["no end"] and units('an "open quote. Here it is.') == ['an "open quote.', "Here it is."]
    assert len(units("One sentence here. " * 20000)) == 20000


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB1 .!?。\n\"“”«»()ก।،-:;…", max_size=60))
def test_units_cover_the_text(text):
    got = sentences(text)
    assert all(a < b for a, b in got) and all(x[1] <= y[0] for x, y in zip(got, got[1:]))
    inside = set()
    for a, b in got:
        inside.update(range(a, b))
        assert not text[a].isspace() and not text[b - 1].isspace()
    assert all(text[i].isspace() for i in range(len(text)) if i not in inside)


def test_table(spark):
    df = spark.createDataFrame([(1, "A b. C d.", 0), (2, None, 0), (3, "", 0)], "doc_id long, text string, start_char int")
    assert sorted(map(tuple, sentence_units(df, "doc_id", "text").collect())) == [(1, 0, 4), (1, 5, 9)]


def test_suppression_is_that_of_the_language():
    def cut(text, lang=None):
        return [text[a:b] for a, b in sentences(text, lang)]

    for text, units in {
        "He took off his cap. Then he left.": 2, "She opened a new tab. Then it closed.": 2, "This is the max. The dose stayed.": 2, "They met at the col. Then they went down.": 2,
        "He took vitamin C. It helped.": 2, "They went for plan B. She agreed.": 2, "The U.S. Army came. It stayed.": 2, "Col. Smith came. Then he left.": 2, "The book by J. Smith is old.": 1, "He lives in the U.S. He likes it.": 2,
        "Véase la fig. 6 del cap. 59.": 1, "Vergleiche die Werte, vgl. Abb. 6.": 1, "Siehe Tab. 4 und die Werte.": 1,
    }.items():
        assert len(cut(text)) == units, cut(text)
    assert len(cut("Cap. 5", "es")) == 1 and cut("", "en") == [] == cut(None)
