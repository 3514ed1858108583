import numpy as np
import pytest
from pyspark.sql import functions as F

from mooring.llm import language as L
from mooring.llm import ppm


def brute(model_texts, text, order):
    """Code length in one class, escape by escape."""
    count = [dict() for _ in range(order + 1)]
    for t in model_texts:
        t = b"\0" * order + t
        for i in range(order, len(t)):
            for k in range(order + 1):
                c = count[k].setdefault(t[i - k : i], {})
                c[t[i]] = c.get(t[i], 0) + 1
    bits, t = 0.0, b"\0" * order + text
    for i in range(order, len(t)):
        for k in range(order, -1, -1):
            c = count[k].get(t[i - k : i])
            if c is None:
                continue
            n, d = sum(c.values()), len(c)
            if t[i] in c:
                bits += -np.log2(c[t[i]] / (n + d))
                break
            bits += -np.log2(d / (n + d))
        else:
            bits += 8
    return bits


@pytest.mark.parametrize("order", [0, 1, 2, 5])
def test_code_lengths_are_exact(order):
    rng = np.random.default_rng(order)
    words = [b"abra", b"cad", b"abracadabra", b"xyz", b"zz"]
    texts = [[b" ".join(rng.choice(words[:3], 6)) for _ in range(8)], [b" ".join(rng.choice(words[2:], 6)) for _ in range(5)], []]
    m = ppm.Model(["a", "b", "none"], texts, order)
    probe = [b"abra xyz", b"", b"q", b"zz abracadabra cad", bytes([0, 255, 7])]
    got = m.bits(probe)
    for p, row in zip(probe, got):
        assert row[:2] == pytest.approx([brute(texts[c], p, order) for c in (0, 1)], rel=1e-4)
    assert (got[1] == 0).all()


def test_index_with_many_collisions():
    keys = np.arange(0, 3_000_000, 997, dtype=np.uint64)
    ix = ppm._Index(keys)
    assert (ix.find(keys) == np.arange(len(keys))).all() and (ix.find(keys + np.uint64(1)) == -1).all()
    assert (ppm._Index(keys[:0]).find(keys) == -1).all()


@pytest.mark.parametrize(
    "text,n",
    [
        ("One two three. Four five six!", 2), ("A line without its mark", 0), ("Step 1: It holds for all.\n\n```\nThis is code text.\n```", 1), ("User: Is it so now?\nAssistant: Yes, it surely is.", 2), ("| a table row. | x |", 0),
        ("这里为什么需要余数?最后还剩下7个。", 2), ("x = 3.", 0), ("He wrote “das ist ein Satz.” on it.", 1), ("Resultado final: k = 56.", 0), ("<skeleton>one two three. four five</skeleton>", 0), (None, 0), ("", 0), ("It is 3.5 and 4.7 long.", 1), ("$$ab cd. ef gh$$", 0),
    ],
)
def test_sentences(text, n):
    assert len(L.sentences(text)) == n


def test_offsets_are_code_points():
    t = "🙂 Eins zwei drei. Vier fünf sechs!"
    assert [t[a:b] for a, b, _ in L.sentences(t)] == ["🙂 Eins zwei drei.", "Vier fünf sechs!"]


CODES = [("en", "English", "eng"), ("de", "German", "deu"), ("zh", "Chinese", "zho")]


def test_labels(spark):
    df = spark.createDataFrame([("en",), (" EN\t",), ("english",), ("eng",), ("en-US",), ("de_AT",), ("zh_HANS",), ("und",), ("??",), ("",), (None,), ("xx-en",)], "l string")
    assert [r.c for r in df.select(L.label_code(F.col("l"), CODES).alias("c")).collect()] == ["en"] * 5 + ["de", "zh"] + [None] * 5


@pytest.fixture(scope="module")
def trained(spark):
    d = "/root/testdata/sf0.01"
    docs, codes = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/lang_codes.parquet")
    return docs, codes, L.train_model(docs, codes)


TEXTS = {
    "en": "After 12 minutes the owner has counted 30 stamps. The rest goes to nobody.", "de": "Am Ende bleiben 12 übrig. Warum sollte die Lösung hier fehlen?", "zh": "最后还剩下7个。这里为什么需要余数?", "ru": "В конце остаётся 38. Для 33 это всё ещё много.",
    "es": "Al final quedan 49 de ellos. De eso no depende la distancia.", "fr": "À la fin il en reste 20. Pourquoi la borne devrait-elle manquer ici ?", "ja": "最後に60個が残ります。ここでなぜ余りが必要なのでしょうか。", "it": "Alla fine ne restano 31. Da questo non dipende il calcolo alla settimana.",
    "nl": "Uiteindelijk blijven er 10 over. Daar hangt het patroon per week niet van af.", "pt": "No final sobram 88 deles. Disso não depende o limite do enunciado.",
}


def test_found_on_known_texts(spark, trained):
    _, codes, model = trained
    rows = [(i, t, c) for i, (c, t) in enumerate(TEXTS.items())]  # right labels: no case
    rows += [(100 + i, t, "en" if c != "en" else "de") for i, (c, t) in enumerate(TEXTS.items())]  # wrong ones
    rows += [(200, TEXTS["de"] + "\n\n" + TEXTS["zh"], "de"), (201, TEXTS["en"], None), (202, TEXTS["en"], "en-GB"), (203, None, None), (204, "", "und"), (205, "x = 3", None), (206, TEXTS["en"] + "\n\n```\n" + TEXTS["de"] + "\n```", "en"), (206, TEXTS["en"], "en")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {}
    for r in L.found(L.languages(df, model, codes)).collect():
        got.setdefault(r.doc_id, set()).add(r.lang)
    assert got == {**{100 + i: {c} for i, c in enumerate(TEXTS)}, 200: {"de", "zh"}, 201: {"en"}}
    assert L.languages(df.where("false"), model, codes).count() == 0


def test_segments(spark, trained):
    _, _, model = trained
    t = TEXTS["de"] + "\n\n" + TEXTS["zh"] + "\n\n" + TEXTS["de"]
    df = spark.createDataFrame([(1, t, 0), (2, None, 0), (3, t, 0), (3, t, 0)], "doc_id bigint, text string, segment int")
    rows = L.segments(df, model).orderBy("doc_id", "segment").collect()
    one = [r for r in rows if r.doc_id == 1]
    assert [r.lang for r in one] == ["de", "zh", "de"] and [t[r.first : r.last] for r in one] == [TEXTS["de"], TEXTS["zh"], TEXTS["de"]] and all(r.confidence > 0.99 for r in one)
    assert len(rows) == 9


def test_held_out_sentences(spark, trained):
    """Sentences of rightly labelled documents of other rows."""
    _, codes, model = trained
    seen = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").select("text").distinct()
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("length(text) < 2000 and lang is not null and pmod(doc_id, 5) = 0").join(seen, "text", "left_anti")
    rows = L.languages(docs, model, codes).where("label is not null and not mixed").collect()
    right = sum(r.label == r.lang for r in rows) / len(rows)
    assert len(rows) > 500 and right > 0.88  # about a tenth of the delivered labels are wrong


def test_quotes_of_any_length_do_not_count():
    said = "Die Trams fahren los. Sie treffen sich am Mittag. " * 30
    own = [s for *_, s in L.sentences(f'The sign says "{said}" to everybody here. It is «{said}» again in the hall.')]
    assert len(own) == 2 and not any("Trams" in s for s in own)


def test_training_sentences_come_from_the_whole_document(spark):
    """A document whose first half is in another language than its label still trains that label."""
    en, de = "The owner counted the stamps at noon. " * 20, "Die Trams fahren am Mittag los. " * 20
    docs = spark.createDataFrame([(i, de + en, "en") for i in range(3)] + [(9, de, "de")], "doc_id bigint, text string, lang string")
    codes = spark.createDataFrame([("en", "English", "eng", "Latn"), ("de", "German", "deu", "Latn")], "lang string, english_name string, iso3 string, script string")
    m = L.train_model(docs, codes)
    b = m.bits([L.clean("The owner counted the stamps at noon.")])[0]
    assert b[m.classes.index("en")] < b[m.classes.index("de")]
