"""Hand-derived expectations for the Russian rules and text expressions."""

import pytest

from quarry.functions import text as T
from quarry.functions.budgets import sigmoid
from quarry.functions.intents import (
    answer_profile, answerability, direct_reason, external_reason, preferred_sections, sentence_adjustment,
)
from quarry.operators.gates import underspecified
from quarry.operators.rewrites import fallback_rewrites, filter_rewrites
from quarry.rules import russian as ru


@pytest.mark.parametrize("word,stem", [("ответственный", "ответс"), ("отпуска", "отпус"), ("срок", "срок"), ("2024", "2024")])
def test_stem(one, word, stem):
    assert one(T.root, word) == stem


def test_lexical_roots(one):
    assert one(T.root_list, "Какой срок отпуска в 2024?") == ["срок", "отпус", "2024"]
    assert one(T.root_list, "Straße ёлка 7") == ["strass"[:5], "елка", "7"]


@pytest.mark.parametrize(
    "query,reason",
    [("Привет!", "smalltalk_greeting"), ("как  дела?", "smalltalk_status"), ("Ок, спасибо большое!", "smalltalk_thanks"),
     ("До свидания", "smalltalk_bye"), ("что ты умеешь?", "meta_capabilities"), ("Помоги", "meta_help"),
     ("Привет, как оформить отпуск", None)],
)
def test_direct(one, query, reason):
    assert one(direct_reason, query) == reason


@pytest.mark.parametrize(
    "query,reason",
    [("Какая погода завтра?", "external_weather"), ("Курс доллара", "external_currency"), ("Сколько будет 2+2?", "external_arithmetic"),
     ("кто президент", "external_current_affairs"), ("Как оформить наряд?", None)],
)
def test_external(one, query, reason):
    assert one(external_reason, query) == reason


def test_underspecified(one):
    assert one(underspecified, "Кто отвечает?") == ru.MSG_CLARIFY_GENERIC
    assert one(underspecified, "Как оформить?") == ru.MSG_CLARIFY_GENERIC
    assert one(underspecified, "Кто их согласует?") == ru.MSG_CLARIFY_ANAPHORA
    assert one(underspecified, "Как оформить отпуск?") is None


@pytest.mark.parametrize(
    "query,profile",
    [("Какой срок действия наряда-допуска?", "fact"), ("Что делать при изменении условий работ?", "procedure")],
)
def test_profile(one, query, profile):
    assert one(answer_profile, query) == profile


@pytest.mark.parametrize(
    "raw,normal",
    [
        ("Привет, подскажите пожалуйста, как получить наряд допуск", "как получить наряд-допуск"),
        ("Кто выписывает наряд на опасные работы", "Кто выписывает наряд-допуск на работы повышенной опасности"),
        ("Как выписать наряд-допуск", "Как оформить наряд-допуск"),
        ("Что делать, если увидел дым?", ru.FIRE_QUERY),
        ("Порядок при возгорании", "Порядок при возгорании пожар"),
        ("пожалуйста", "пожалуйста"),
    ],
)
def test_normalize_query(one, raw, normal):
    assert one(T.normalize_query, raw) == normal
    assert one(lambda c: T.normalize_query(T.normalize_query(c)), raw) == normal


def test_citations(one):
    assert one(T.source_ids, "a [S1] b [ С2 ] c [s1]") == ["S1", "S2"]
    assert one(T.canonical_citations, "x [ с 3 ]") == "x [S3]"


def test_anchors_and_acronyms(one):
    assert set(one(T.hard_anchors, "Где Windows и СОУТ в Москве 2024 7")) == {"windows", "соут", "москве", "2024"}
    assert "соут" in one(T.acronym_candidates, "специальная оценка условий труда")


def test_sentences_and_entities(one):
    assert one(T.sentences, "Один.  Два; три:\nчетыре") == ["Один.", "Два;", "три:", "четыре"]
    assert one(T.numbers, "7 и 14, é12 2024г 300.") == ["14", "300"]
    assert one(T.latin_entities, "Use Spark-4 and éclair ab") == ["use", "spark-4", "and"]


def test_model_cleanup_and_echo(one):
    assert one(T.strip_model_markup, "<think>x\ny</think>\n```json\n{}\n```") == "{}"
    assert one(T.strip_question_echo, "Кто там? — Я.", "кто там?") == "Я."
    assert one(T.abstained, "В источниках нет нужной информации") is True


def test_sections_and_business(one):
    assert one(preferred_sections, "Как оформить отпуск?") == [43916]
    assert one(preferred_sections, "История компании") == [43919, 43915]


def test_answerability(one):
    bonus = lambda q, t: answerability(T.norm(q), T.norm(t), T.norm(t))[0]
    penalty = lambda q, t: answerability(T.norm(q), T.norm(t), T.norm(t))[1]
    assert one(bonus, "Какой срок?", "Не более 14 календарных дней") == pytest.approx(0.08)
    assert one(bonus, "Кто входит в комиссию", "В состав входят председатель и секретарь") == pytest.approx(0.18)
    assert one(penalty, "Как оформить", "Оглавление. Термины, определения") == pytest.approx(0.30)


def test_sentence_adjustment(one):
    adj = lambda q, s: sentence_adjustment(T.norm(q), T.norm(s), T.F.length(s))
    assert one(adj, "Кто проводит проверку всех условий труда", "Проверка проводится комиссией на рабочем месте при участии работника службы охраны") == pytest.approx(0.58)
    assert one(adj, "Какой срок хранения документов", "Документ хранится 14 дней с момента подписания всеми ответственными лицами организации") == pytest.approx(0.30)


def test_rewrites(one):
    assert one(fallback_rewrites, "Как оформить отпуск и кто согласует заявление?") == ["Как оформить отпуск", "кто согласует заявление"]
    assert one(fallback_rewrites, "Отпуск?") == ["Отпуск?"]
    f = lambda q, a, b: filter_rewrites(q, T.F.array(a, b))
    assert one(f, "Порядок изменения графика", "изменений в графике", "погода") == ["изменений в графике"]
    assert one(f, "Порядок изменения графика", "погода", "") == ["Порядок изменения графика"]


def test_sigmoid_is_stable(one):
    assert one(sigmoid, -1000.0) == 0.0
    assert one(sigmoid, 1000.0) == 1.0
    assert one(sigmoid, 0.0) == 0.5


def test_stream_pieces(one):
    text = "слово " * 40
    pieces = one(lambda c: T.split_stream_pieces(c, 48), text)
    assert "".join(pieces) == text and max(map(len, pieces)) <= 48
