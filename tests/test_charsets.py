"""Encodings by what the bytes could be and how they read: round trips over texts that the model hasn't seen."""

import pytest
from pyspark.sql import functions as F

from lectern.sources import charsets, papers

#: Sentences that aren't among the samples, and the charsets that they are written in.
TEXTS = {
    "de": ("Über die Straße führte früher eine schöne Brücke, später wurde sie abgerissen und völlig neu gebaut.", ["cp1252"]),
    "fr": ("L'élève a reçu une réponse très étonnante après avoir posé la question à sa mère, il y a dix années déjà.", ["cp1252"]),
    "es": ("El niño comió una manzana mientras su compañera leía un periódico. ¿Qué pasó después? Nadie lo sabía.", ["cp1252"]),
    "pl": ("Dziewczyna poszła do szkoły, gdzie uczyła się języka i śpiewała pieśni, a później wróciła do domu swojej rodziny, żeby coś zjeść.", ["cp1250", "iso8859_2"]),
    "cs": ("Dívka šla do školy, kde se učila jazyk a zpívala písně, potom se vrátila domů, aby něco snědla, protože měla žízeň a ještě byl čas.", ["cp1250", "iso8859_2"]),
    "ru": ("Девушка пошла в школу, где она учила языки и пела песни, а потом вернулась домой, чтобы поужинать с семьёй.", ["cp1251", "koi8_r", "iso8859_5"]),
    "el": ("Το κορίτσι πήγε στο σχολείο, όπου έμαθε γλώσσες και τραγούδησε, και μετά γύρισε στο σπίτι για να φάει.", ["iso8859_7"]),
    "ja": ("少女は学校へ行って言葉を習い、歌を歌いました。それから家に帰って、家族と一緒に夕食を食べました。", ["shift_jis", "euc_jp", "iso2022_jp"]),
    "zh": ("女孩去学校学习语言，唱了很多歌，然后回家和家人一起吃了晚饭，大家都很高兴。", ["gb18030"]),
    "zh-hant": ("女孩去學校學習語言，唱了很多歌，然後回家和家人一起吃了晚飯，大家都很高興。", ["big5"]),
    "ko": ("소녀는 학교에 가서 말을 배우고 노래를 불렀다. 그리고 집으로 돌아와 가족과 함께 저녁을 먹었다.", ["euc_kr"]),
}
CASES = [(lang, charset) for lang, (_, names) in TEXTS.items() for charset in names]


@pytest.fixture(scope="module")
def model(spark):
    return charsets.trained(spark)


@pytest.mark.parametrize(("lang", "charset"), CASES)
def test_round_trip(model, lang, charset):
    text = TEXTS[lang][0]
    for said in (text, "\\begin{document} " + text + "\n\\end{document}"):
        found, confidence = model.detect(said.encode(charset))
        if {found, charset} == {"cp1250", "iso8859_2"}:  # the same bytes for what this text has of them, or nearly
            assert lang in ("pl", "cs")
            continue
        assert found == charset and confidence > 0.9
        assert papers.converted(said.encode(charset), found) == said


def test_marks_and_utf8(model):
    text = "Größe é 漢字"
    assert [model.detect(text.encode(c))[0] for c in ("utf-8", "utf-8-sig", "utf-16", "utf-32")] == ["utf-8", "utf-8-sig", "utf-16", "utf-32"]
    assert model.detect(text.encode()[:-1]) == ("utf-8", 1 - 0.5**5)  # cut within a character
    assert model.detect(b"plain") == ("utf-8", 1.0) and model.detect(b"") == ("UNKNOWN", 0.0)
    assert model.detect("é".encode())[1] == 0.5


def test_automata_are_the_codecs():
    """What a codec writes its automaton takes; what it refuses the codec can't read, but for what is unassigned."""
    import random

    r = random.Random(1)
    for name, automaton in charsets._VALID.items():
        taken = 0
        for _ in range(400):
            data = bytes(r.choice([r.randrange(256), r.randrange(128, 256), 65]) for _ in range(r.randint(1, 5)))
            try:
                data.decode(name)
                readable = True
            except UnicodeDecodeError:
                readable = False
            controls = name.startswith("iso") and any(0x80 <= b <= 0x9F for b in data)
            assert automaton.match(data) or not readable or controls, (name, data)
            taken += readable
        assert taken


def test_files_in_many_encodings(spark, model):
    rows = [(f"{lang}-{charset}", "p", "n", bytearray(TEXTS[lang][0].encode(charset)), charset) for lang, charset in CASES]
    rows += [("empty", "p", "n", bytearray(), None), ("null", "p", "n", None, None), ("binary", "p", "n", bytearray(b"\x81\x20\xff\x00" * 9), None)]
    files = spark.createDataFrame(rows, "doc_id string, path string, name string, content binary, charset string")
    got = {r["doc_id"]: r for r in files.withColumn("d", charsets.detected(F.col("content"), model)).select("doc_id", "d.*").collect()}
    assert got["null"]["encoding"] is None and got["empty"]["encoding"] == "UNKNOWN"
    assert sum(got[f"{lang}-{charset}"]["encoding"] == charset for lang, charset in CASES) >= len(CASES) - 2
    texts = {r["doc_id"]: r["text"] for r in papers.utf8_texts(files.where("content IS NOT NULL"), model).collect()}
    for lang, charset in CASES:
        assert texts[f"{lang}-{charset}"] == TEXTS[lang][0] or lang in ("pl", "cs")


def test_more_texts_of_a_language_take_the_samples_place(spark):
    own = spark.createDataFrame([("ru", TEXTS["ru"][0]), ("ru", None), (None, "x"), ("en", "ascii only")], "lang string, text string")
    counts = charsets.counted(own)
    assert {k[1] for k in counts} == {"ru"} and ("cp1252", "ru") not in counts
    assert charsets.trained(spark, own).detect("Она читала новую книгу, которую ей дали".encode("koi8_r"))[0] == "koi8_r"


def test_a_charset_is_not_judged_by_the_few_texts_that_it_can_write(spark):
    """Odd texts whose letters two charsets share don't make the poorer one likelier; nor do capitals, nor one letter."""
    plain = [("fr", charsets.SAMPLES["fr"] + " très près de là, à l'été même")] * 40
    odd = [("fr", "ééç ééç éouéeau éanéque " * 5)] * 4
    german = [("de", "größe ähnlich schön für später müssen hören erä ärm enchöü einö keitä")] * 40
    model = charsets.trained(spark, spark.createDataFrame(plain + odd + german, "lang string, text string"))
    for text in ("ééç ééç très éouéeau éanéque " * 9, "ERÄ!! ENCHÖÜ!! EINÖ!! UND!! KEITÄ,!! KEITTEÖ!! " * 9, "etaion modèl ou", "HÖREN SPÄTER FÜR für"):
        assert papers.converted(text.encode("cp1252"), model.detect(text.encode("cp1252"))[0]) == text, text
