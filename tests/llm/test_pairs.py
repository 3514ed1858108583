import numpy as np
import pytest

from mooring.llm import language, pairs, truncation


@pytest.mark.parametrize("v", [None, "", " \t\n", "​", "...", "—", "[]", '""', "<answer></answer>", "N/A", "null", "None.", "(no answer)", "无", "<reason> nan </reason>", "Keine Antwort"])
def test_empty(v):
    assert pairs.is_empty(v)


@pytest.mark.parametrize("v", ["0", "x", "No.", "$$k$$", "nothing is left", "no answer exists for n = 3 because it diverges", "无解。"])
def test_not_empty(v):
    assert not pairs.is_empty(v)


Q = "Two trams leave the depot 650 km apart at 925 and 650 km per hour. When do they meet?"


@pytest.mark.parametrize("v", [Q, Q.upper(), Q.lower(), Q.replace(" ", "  "), f"Question: {Q}", f"> {Q}", f'"{Q}"', Q[:-1], Q + "\n\n" + Q, Q.replace("?", "？"), f"<reason>{Q}</reason>"])
def test_copies(v):
    assert pairs.copies(Q, v)


@pytest.mark.parametrize("v", [Q + "\n\nThey meet after 25 minutes.", "They meet after 25 minutes.", "650 km", "", "When do they meet?", Q.replace("925", "1").replace("depot", "station").replace("trams", "buses").replace("hour", "day").replace("meet", "part").replace("leave", "enter")])
def test_does_not_copy(v):
    assert not pairs.copies(Q, v)


def test_copies_without_accents_and_in_han():
    assert pairs.copies("面包师以每个15元的价格卖出700个面包,一共收入多少?", "面包师以每个15元的价格卖出700个面包一共收入多少?\n")
    assert pairs.copies("¿Cuánto tarda el tren?", "cuanto tarda el tren") and pairs.copies("这里为什么需要余数?", "问题: 这里为什么需要余数？") and not pairs.copies("这里为什么需要余数?", "因为最后还剩下7个。")


@pytest.mark.parametrize(
    "v",
    [
        "I'm sorry, but I can't help with that request.", "As a language model, I won't answer this question, as it may cause harm.", "Thank you for the question. I am unable to provide an answer to this.", "I’d rather not answer that.", "My apologies, this topic is outside of what I may talk about. Let me know if you have another question.",
        "UNFORTUNATELY I CANNOT FULFIL THIS REQUEST, AS IT GOES AGAINST MY GUIDELINES.", "Diese Frage darf ich leider nicht beantworten.", "Lo siento, no puedo ayudar con esa solicitud.", "Je préfère ne pas me prononcer sur ce sujet.", "Como assistente, devo recusar a resposta.", "Mi dispiace, non posso aiutarti con questa richiesta.",
        "Het spijt me, daar kan ik niet bij helpen.", "К сожалению, ответить на этот вопрос невозможно.", "很遗憾,这个问题我不能回答。", "您好！我不方便对此发表看法。", "申し訳ありませんが、そのご依頼にはお応えできません。",
    ],
)
def test_refuses(v):
    assert pairs.refuses(v)


@pytest.mark.parametrize("v", ["I can't find a smaller value, which shows that the bound is sharp.", "We cannot divide by zero here, so no solution exists.", "Sorry for the long path above; the short version follows.", "I cannot stress enough that the units matter.", "I'm sorry, I can't help with that. But the sum of the first ten numbers is 55, and the rest follows.", "不能除以零,所以没有解。", "Não se pode dividir por zero, logo não há solução.", "Unfortunately the leak wins, and the tank never fills."])
def test_does_not_refuse(v):
    assert not pairs.refuses(v)


def test_asked():
    assert pairs.asked("Why? Please reply in Japanese only.") == {"ja"} and pairs.asked("Responde en inglés.") == {"en"} and pairs.asked("Why is it so?") == set()


EN = "After 12 minutes the owner has counted 30 stamps. The rest goes to nobody."
DE = "Am Ende bleiben 12 übrig. Warum sollte die Lösung hier fehlen?"
ROW = "sample_idx bigint, questions map<string,string>, answers map<string,string>, reasonings map<string,string>, defect string"


@pytest.fixture(scope="module")
def model(spark):
    d = "/root/testdata/sf0.01"
    return language.train_model(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/lang_codes.parquet"))


def test_operator(spark, model):
    base = spark.read.parquet("/root/testdata/sf0.001/metric_rows.parquet").selectExpr("sample_idx", "questions", "answers", "reasonings", "cast(null as string) defect")
    rows = [
        (1, {"A": Q}, {"A": EN}, {"A": DE}, "x"), (2, {"A": Q, "B": Q}, {"A": Q.lower()}, {"A": EN, "B": EN[:-12]}, "x"), (3, {"A": Q + " Answer in German."}, {"A": DE}, {"A": EN}, None), (4, {"A": Q}, None, {"A": "I'd rather not answer that."}, None),
        (5, None, {"A": ""}, {"A": ""}, None), (6, {}, {}, {}, None), (7, {"A": None}, {"A": EN}, {"A": None}, None), (8, {"A": Q}, {"A": EN + " " + EN, "Z": ""}, {"A": "Final answer: 3"}, None), (8, {"A": Q}, {"A": EN}, {"A": EN * 3000}, None),
    ]
    df = base.unionByName(spark.createDataFrame(rows, ROW))
    got = sorted((r.sample_idx, r.method, r.field, r.defect) for r in pairs.defects(df, model).where("sample_idx < 100").collect())
    assert got == [
        (1, "A", "reasonings", "other_language"), (2, "A", "answers", "copies_question"), (2, "B", "answers", "empty"), (2, "B", "reasonings", "truncated"), (4, "A", "answers", "empty"), (4, "A", "reasonings", "refusal"), (7, "A", "reasonings", "empty"),
    ]
    assert pairs.defects(df.where("false"), model).count() == 0


def test_each_entry_at_most_once(spark, model):
    df = spark.read.parquet("/root/testdata/sf0.01/metric_rows.parquet")
    out = pairs.defects(df, model)
    n = out.count()
    assert n == out.dropDuplicates(["sample_idx", "method", "field"]).count() and 100 < n < 400
    assert {r.defect for r in out.select("defect").distinct().collect()} == set(pairs.DEFECTS)


def test_repeated_map_keys_count_once():
    assert pairs.pairs_of([("a", "q"), ("b", None)], [("a", "1"), ("a", "2")]) == [("a", "q", "2"), ("b", None, None)]
    assert pairs.pairs_of(None, None) == []


def test_end_detector_is_the_one_of_problem_2(model):
    w = truncation.fit([(EN, ()), (DE, ())] * 20).astype(np.float32)
    check = pairs.Checker(model, w)
    assert check([(Q, EN), (Q, None), ("", EN)]) == [None, "empty", None]


@pytest.mark.parametrize("v", ["I'm afraid I can't help with that.", "I really can't help with that.", "Sorry, I simply cannot answer this question.", "Das kann ich hier leider nicht beantworten.", "Je ne peux vraiment pas répondre à cette question."])
def test_refuses_in_words_of_its_own(v):
    assert pairs.refuses(v)


@pytest.mark.parametrize("v", ["I can't answer that with whole numbers, as 7 is odd.", "I can't help but notice that 12 stamps are left.", "This question is about stamps.", "Ich kann diese Gleichung durch zwei teilen."])
def test_aligned_too_little(v):
    assert not pairs.refuses(v)


def test_refuses_at_any_length_and_without_the_former_stems():
    assert pairs.refuses("I'm sorry, but I cannot.") and pairs.refuses("This goes against my guidelines.")
    assert pairs.refuses("I cannot answer this question, as it goes against my guidelines. Thank you for your understanding. " * 9)
    assert not pairs.refuses("I cannot answer this question. " * 30 + "But the sum of the first ten numbers is 55, and the rest follows.")


@pytest.mark.parametrize("times", [1, 12, 13, 200])
def test_a_refusal_said_any_number_of_times(times):
    assert pairs.refuses("I can't help with that request, as it may cause harm. " * times) and pairs.refuses("很抱歉,我无法协助完成这个请求。" * times)


def test_every_core_is_a_refusal_with_any_opening():
    cores, openings, *_ = pairs._refusals()
    assert sum(map(pairs.aligns, cores.own)) == len(cores.own)
    for core in cores.own[::7]:
        for opening in openings.own[::5]:
            assert pairs.aligns(opening + core)


@pytest.mark.parametrize("v", ["Sorry, I can't really answer this question here.", "I'm sorry, I really am not able to solve this one today.", "Leider kann ich diese Frage so nicht beantworten.", "Lo siento mucho, pero no puedo responder a esta pregunta ahora."])
def test_wordings_between_the_templates(v):
    assert pairs.refuses(v)


def test_stand_ins_with_white_space_of_any_length():
    assert pairs.is_empty("N/A" + " " * 500) and pairs.is_empty("\n\n" * 300 + "none.") and pairs.is_empty("N/A\n" * 40) and not pairs.is_empty("N/A\n42")


def test_copies_at_any_length():
    assert pairs.copies(Q, "\n".join([Q] * 6)) and pairs.copies(Q, "<reason>" * 40 + "=" * 300 + Q + "</reason>" * 40)
    assert not pairs.copies(Q, "\n".join([Q] * 6) + " They meet after 25 minutes, as the gap of 650 km closes at 1575 km per hour. " * 6)
