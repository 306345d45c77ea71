import pytest
from pyspark.sql import functions as F

from quarry.operators import answers as A
from quarry.operators import context as C
from quarry.operators import guards as G
from quarry.operators.contracts import FAST, check_answer, check_fast, parse
from quarry.functions import text as T
from quarry.rules import russian as ru
from quarry.settings import Settings

SRC = ("source_id string, idx long, doc_id string, chunk_id string, title string, section string, url string, "
       "text string, score double, lexical_coverage double")


def context_df(spark, query, texts, answer=""):
    ctx = [(f"S{i}", i, f"d{i}", f"d{i}:c1", "", "", "u", t, 1.0, 1.0) for i, t in enumerate(texts, 1)]
    return C.query_features(
        spark.createDataFrame([(1, query, answer, ctx)], f"qid long, query string, answer string, context array<struct<{SRC.replace(' ', ':').replace(',:', ',')}>>"))


@pytest.mark.parametrize(
    "answer,valid,issues",
    [("Срок 14 дней [S1].", True, []), ("Срок 30 дней [S1].", False, ["unsupported_number"]),
     ("Срок 14 дней.", False, ["uncited_claim"]), ("Срок 14 дней [S7].", False, ["unknown_citation"]),
     ("Срок 14 дней [S1]. https://x.y [S1]", False, ["answer_contains_url", "unsupported_latin_entity", "low_claim_source_overlap"]),
     ("", False, ["no_factual_claims"])],
)
def test_grounding(spark, answer, valid, issues):
    df = context_df(spark, "q", ["Срок действия 14 календарных дней"], answer)
    g = G.assess_grounding(df, 0.18).first().grounding
    assert g.valid is valid and g.issues == issues
    if valid:
        assert g.min_claim_coverage == 1.0 and g.checked_claims == 1


def test_format_issues(one):
    f = lambda a: G.format_issues(a, F.array(F.lit("S1")), F.lit(False), F.array(F.lit("S1")))
    assert one(f, "ok [S1].") == []
    assert one(f, "bad [S1] [S3]") == [ru.ISSUE_UNKNOWN_CITED + "['S3']", ru.ISSUE_MISMATCH]
    assert one(f, "none") == [ru.ISSUE_NO_CITATIONS, ru.ISSUE_MISMATCH]


def test_relevance(one):
    assert one(G.relevance_issues, "Какой срок отпуска?", "Отпуск длится 28 дней") == []
    assert one(G.relevance_issues, "Какой срок отпуска?", "Отпуск длится долго") == ["answer_misses_time_intent"]
    assert one(G.relevance_issues, "Что такое СОУТ?", "Специальная оценка условий труда") == []
    assert one(G.relevance_issues, "Кто входит в состав комиссии?", "Зелёный лес") == [
        "answer_misses_query_object", "answer_misses_who_intent", "answer_misses_membership_intent"]


def test_definition_and_membership(spark):
    df = context_df(spark, "Что такое СОУТ?", ["Проводится специальная оценка условий труда работников"])
    r = A.extractive_answer(df, F.lit(1)).first().extractive
    assert r.answer == "СОУТ — специальная оценка условий труда [S1]." and r.confidence == 1.0
    df = context_df(spark, "Кто входит в комиссию?", ["В состав комиссии входят: 1. Председатель комиссии; 2. Секретарь комиссии; прочее."])
    r = A.extractive_answer(df, F.lit(2)).first().extractive
    assert r.answer.startswith(ru.MEMBERSHIP_ANSWER) and "Председатель комиссии" in r.answer and r.used_source_ids == ["S1"]


def test_extractive_ranking(spark):
    df = context_df(spark, "Срок отпуска работника", ["Отпуск работника длится 28 календарных дней. Иное предложение про погоду и природу.", "Срок отпуска работника равен 14 дням у совместителя."])
    # by hand: S1 .82*2/3+.18+.30+.14+.12 = 1.287; S2 .82+.18+.30+.14-.16+.12 = 1.40
    r = A.extractive_answer(df, F.lit(1)).first().extractive
    assert r.answer == "Срок отпуска работника равен 14 дням у совместителя [S2]." and r.confidence == 1.0
    scores = {x.source_id: x.score for x in A.extractive_sentences(df).filter("spos = 0").collect()}
    assert scores["S1"] == pytest.approx(1.286667, abs=1e-5) and scores["S2"] == pytest.approx(1.40, abs=1e-5)


@pytest.mark.parametrize(
    "raw,out",
    [("Готово [S1]. Ещё не", "Готово [S1]."), ("Готово. [S1] хвост [S", "Готово. [S1]"), ("без ссылки по телефон [S1]", ""),
     ("Раз. [S1] Два [S2]. Три", "Раз. [S1] Два [S2].")],
)
def test_trim_tail(one, raw, out):
    assert one(A.trim_incomplete_tail, raw) == out


def test_normalize_reply(spark):
    df = context_df(spark, "Какой срок?", ["Срок действия 14 календарных дней"])
    run = lambda text, trunc=False, post=True: df.select(
        A.normalize_reply(F.lit(text), F.col("query"), F.col("context"), F.lit(trunc), F.lit(post)).alias("r")).first().r
    assert run("Какой срок? Ответ: 14 дней [ с1 ].").answer == "14 дней [S1]."
    assert run("Срок действия 14 дней.").answer == "Срок действия 14 дней. [S1]"
    assert run("Срок действия 14 дней.", post=False).insufficient_context
    assert run("Луна состоит из сыра.").answer == ru.MSG_SOURCES_INSUFFICIENT


def test_normalize_generated(spark):
    df = context_df(spark, "q", ["t1", "t2"])
    run = lambda a, ids: df.select(A.normalize_generated(F.lit(a), F.array(*map(F.lit, ids)), F.lit(False), F.col("context")).alias("r")).first().r
    assert run("См. [d2:c1] и [D1]", ["S1"]).answer == "См. [S2] и [S1]"
    # a document of two passages: its bare id names the later one
    twice = df.select(F.transform("context", lambda c: c.withField("doc_id", F.lit("d1"))).alias("context"))
    both = twice.select(A.normalize_generated(F.lit("См. [D1]"), F.array(F.lit("S1")), F.lit(False), F.col("context")).alias("r")).first().r
    assert both.answer == "См. [S2]" and both.used_source_ids == ["S2"]
    assert run("Без ссылок", ["S2"]).answer == "Без ссылок\n\n" + ru.SOURCES_LINE + "[S2]"


def test_contracts(spark, one):
    c = lambda a: check_answer(a, F.array(F.lit("S1")), F.lit(True))
    assert one(c, "x") == "sources with insufficient context"
    row = lambda j: spark.createDataFrame([(j,)], "j string").select(parse(F.col("j"), FAST).alias("r")).select(
        "r", check_fast(F.col("r")).alias("v")).first()
    good = '{"decision":"answer","answer":"a [S1]","used_source_ids":["S1"],"rewritten_queries":[],"reason":""}'
    assert row(good).v is None and row(good).r.answer == "a [S1]"
    assert row(good.replace('"S1"]', '"S9"]', 1)).v == "unknown source id"
    assert row('{"decision":"answer"}').r is None and row("not json").r is None
    assert row(good[:-1] + ',"extra":1}').r is None


def test_dedup_and_budget(spark):
    s = Settings()
    fields = "idx long, doc_id string, chunk_id string, title string, section string, url string, text string, score double, lexical_coverage double"
    a = "Первый абзац про отпуск работника и сроки. " * 12
    rows = [(1, "d1", "c1", "T", "", "", a, 1.0, 1.0), (2, "d2", "c2", "T", "", "", a + "!", 1.0, 1.0),
            (3, "d3", "c3", "T", "", "", "Другой текст: совсем иной предмет, пожарная безопасность. " * 20, 1.0, 1.0)]
    df = spark.createDataFrame([(rows,)], f"p array<struct<{fields.replace(' ', ':').replace(',:', ',')}>>")
    kept = df.select(C.dedup_and_budget(F.col("p"), F.lit(1000), F.lit(3), s).alias("k")).first().k
    assert [k.idx for k in kept] == [1, 3] and len(kept[1].text) <= 1000 - len(a) - 62 + 1


def test_focus_prefers_the_answer_sentence(spark):
    s = Settings()
    filler = "Общие положения не содержат нужных сведений для ответа. " * 8
    text = filler + "Срок отпуска работника составляет 28 календарных дней. " + filler
    df = context_df(spark, "Какой срок отпуска работника?", [text])
    q = F.struct(F.col("_qroots").alias("roots"), F.col("_acronyms").alias("acronyms"), F.col("_qnorm").alias("norm"))
    out = df.select(C.focus_text(F.element_at("context", 1)["text"], q, F.lit(340), 1).alias("x")).first().x
    assert "28 календарных дней" in out and len(out) <= 340
