"""The encoding of bytes that don't say it: what could have been written so, and how well it reads.

  marks     byte-order marks and escape sequences settle it
  validity  each candidate's automaton (a regular expression over bytes) refuses what it can't have made: a lead byte
            without a trail byte, a byte that the charset leaves open. Valid UTF-8 with a byte above 127 is UTF-8
  reading   of the candidates left, the one under which the bytes are likeliest: neighbouring bytes, of which one at least
            is above 127, against counts of such pairs in texts of known languages written in that charset
  answer    encoding and confidence, the share of the likeliest one's weight; UNKNOWN where no candidate is left

The counts are learnt in Spark: tasks write texts in every charset and count pairs of bytes, and the counts of a charset
and language are added up. A character that the charset lacks counts as one that no byte stands for: left out, or its
text left out, a charset would be judged by the few texts that happen to do without, and look likelier for those than the
one that has all of the language. A charset that lacks half of a language's characters above 127 or more isn't one of
its. Texts are learnt as they are and in capitals, and a language is as likely beforehand as it is common among them. The
number of counts is charsets times languages, each a table of fixed size, so that the model has a proven bound; whatever
the corpus, it is what is sent to tasks.

Defined cases: empty bytes are UNKNOWN with confidence 0; ASCII alone is utf-8 with confidence 1; a text cut within a
character isn't valid in its multibyte charset but for UTF-8, which may lack the end of its last character; null stays null.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MARKS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))

#: What each charset can have written. Fixed by the charsets.
VALID = {
    "shift_jis": rb"(?:[\x00-\x7f\xa1-\xdf]|[\x81-\x9f\xe0-\xfc][\x40-\x7e\x80-\xfc])*",
    "euc_jp": rb"(?:[\x00-\x7f]|\x8e[\xa1-\xdf]|\x8f?[\xa1-\xfe]{2})*",
    "gb18030": rb"(?:[\x00-\x7f]|[\x81-\xfe][\x40-\x7e\x80-\xfe]|[\x81-\xfe][0-9][\x81-\xfe][0-9])*",
    "big5": rb"(?:[\x00-\x7f]|[\xa1-\xf9][\x40-\x7e\xa1-\xfe])*",
    "euc_kr": rb"(?:[\x00-\x7f]|[\xa1-\xfe]{2})*",
    "cp1252": rb"[^\x81\x8d\x8f\x90\x9d]*",
    "cp1250": rb"[^\x81\x83\x88\x90\x98]*",
    "iso8859_2": rb"[^\x80-\x9f]*",
    "cp1251": rb"[^\x98]*",
    "koi8_r": rb"[\x00-\xff]*",
    "iso8859_5": rb"[^\x80-\x9f]*",
    "iso8859_7": rb"[^\x80-\x9f\xae\xd2\xff]*",
}
_VALID = {name: re.compile(rb"(?s:" + pattern + rb")\Z") for name, pattern in VALID.items()}
_ISO_2022_JP = re.compile(rb"\x1b\$[@B]")

#: Texts that the default model learns from, a few plain sentences of each language.
SAMPLES = {
    "de": "Die Ergebnisse zeigen, dass größere Modelle nicht für alle Aufgaben besser sind. Wir müssen überprüfen, ob die Schätzung natürlich möglich wäre. Schließlich hören wir später mehr über die Größe.",
    "fr": "Les résultats montrent que la méthode proposée était déjà très répandue. Nous avons réalisé une étude où les données ont été vérifiées à l'aide d'un modèle français. Ça n'est pas forcément nécessaire.",
    "es": "Los resultados señalan que el método también funcionó en español. ¿Cuál es la razón? Además, la investigación muestra cómo los niños aprendían más rápido según la información del año.",
    "pl": "Wyniki pokazują, że większość metod można również użyć później. Przedstawiamy następujące podejście, które może być ważne. Źródło jest dostępne, a każdy człowiek może się tego nauczyć. Są też inne.",
    "cs": "Výsledky ukazují, že některé způsoby můžeme použít také později. Článek představuje nový přístup, který je důležitý. Každý člověk se může něčemu naučit, když má dost času a šťastný život.",
    "ru": "Результаты показывают, что этот метод можно использовать и для других задач. В статье рассматривается новый подход к решению задачи, который является важным. Мы считаем, что каждый человек может этому научиться, если у него есть время.",
    "el": "Τα αποτελέσματα δείχνουν ότι η μέθοδος μπορεί να χρησιμοποιηθεί και σε άλλα προβλήματα. Το άρθρο παρουσιάζει μια νέα προσέγγιση που είναι σημαντική για όλους τους ανθρώπους και την εποχή μας.",
    "ja": "この結果は、他の問題にも同じ方法を使うことができることを示しています。本論文では、新しい手法について説明します。私たちは、時間があれば誰でもこれを学ぶことができると考えています。データの分析とモデルの評価を行いました。",
    "zh": "结果表明，这种方法也可以用于其他问题。本文介绍了一种新的方法，并且说明了它为什么重要。我们认为，只要有时间，每个人都可以学会。我们对数据进行了分析，也对模型进行了评价。",
    "zh-hant": "結果表明，這種方法也可以用於其他問題。本文介紹了一種新的方法，並且說明了它為什麼重要。我們認為，只要有時間，每個人都可以學會。我們對資料進行了分析，也對模型進行了評價。",
    "ko": "이 결과는 다른 문제에도 같은 방법을 사용할 수 있음을 보여 준다. 이 논문에서는 새로운 방법을 설명하고 왜 중요한지 이야기한다. 우리는 시간이 있으면 누구나 이것을 배울 수 있다고 생각한다. 데이터를 분석하고 모형을 평가하였다.",
}

_CLASS = np.zeros(256, np.int64)  # bytes told apart: those above 127, letters without case, and all others as one
_CLASS[128:] = np.arange(1, 129)
for _c in range(26):
    _CLASS[65 + _c] = _CLASS[97 + _c] = 129 + _c
_LACKING, _N = 155, 156  # the class of characters that a charset lacks, and how many classes there are
_HIGH = np.zeros(_N, bool)
_HIGH[1:129] = _HIGH[_LACKING] = True


def classes(char: str, charset: str) -> list[int]:
    """Of the bytes that a charset writes for a character."""
    try:
        return [int(_CLASS[b]) for b in char.encode(charset)]
    except UnicodeEncodeError:
        return [_LACKING]


def pairs(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(pair, times) of neighbouring bytes of which one at least is above 127; an end reads as a blank."""
    c = _CLASS[np.frombuffer(b" " + data + b" ", np.uint8)]
    some = _HIGH[c[:-1]] | _HIGH[c[1:]]
    return np.unique((c[:-1] * _N + c[1:])[some], return_counts=True)


class Charsets:
    """Log-probabilities of byte pairs for each (charset, language), and of the language. counts: of pairs, then of texts."""

    def __init__(self, counts: dict[tuple[str, str], np.ndarray]) -> None:
        self.keys = sorted(counts)
        self.log = np.zeros((len(self.keys), _N * _N), np.float32)
        for row, key in enumerate(self.keys):
            n = counts[key][:-1].reshape(_N, _N).astype(np.float64)
            single = (n.sum(0) + 0.05) / (n.sum() + 0.05 * _N)  # of a pair that was never seen, the second byte alone says something
            self.log[row] = np.log((n + 4 * single) / (n.sum(1, keepdims=True) + 4)).ravel()
        self.before = np.log(np.array([counts[key][-1] for key in self.keys], np.float64))

    def detect(self, data: bytes) -> tuple[str, float]:
        if not data:
            return "UNKNOWN", 0.0
        for mark, name in MARKS:
            if data.startswith(mark):
                return name, 1.0
        if _ISO_2022_JP.search(data) and data.isascii():
            return "iso2022_jp", 1.0
        if data.isascii():
            return "utf-8", 1.0
        if _is_utf8(data):
            several = sum(1 for _ in re.finditer(rb"[\xc2-\xf4]", data))
            return "utf-8", 1.0 - 0.5**several
        pair, times = pairs(data)
        if not len(pair):
            return "UNKNOWN", 0.0
        valid = {name for name, automaton in _VALID.items() if automaton.match(data)}
        rows = [k for k, (name, _) in enumerate(self.keys) if name in valid]
        if not rows:
            return "UNKNOWN", 0.0
        # a text's pairs depend on one another: beyond some hundred of them more say little more
        score = (self.log[np.ix_(rows, pair)] @ times) * min(1.0, 200 / times.sum()) + self.before[rows]
        best: dict[str, float] = {}
        for k, s in zip(rows, score.tolist(), strict=True):
            best[self.keys[k][0]] = max(best.get(self.keys[k][0], -np.inf), s)
        top = max((name for name in VALID if name in best), key=best.__getitem__)
        said = {name: data.decode(name, "replace") for name, s in best.items() if best[top] - s < 30}
        others = [best[name] - best[top] for name, text in said.items() if text != said[top]]
        same = [name for name in VALID if said.get(name) == said[top]]  # charsets that read the same are one answer
        return same[0], float(1 / (1 + np.exp(others).sum()))


_CUT = re.compile(rb"[\xc2-\xdf]|[\xe0-\xef][\x80-\xbf]?|[\xf0-\xf4][\x80-\xbf]{0,2}")


def _is_utf8(data: bytes) -> bool:
    """Whether UTF-8 reads the bytes, or all but a character that is cut at the end of a text with whole ones before."""
    try:
        data.decode("utf-8")
        return True
    except UnicodeDecodeError as error:
        return bool(_CUT.fullmatch(data, error.start)) and not data[: error.start].isascii()


def counted(texts: DataFrame) -> dict[tuple[str, str], np.ndarray]:
    """Pairs of bytes of texts (lang, text), as they are and in capitals, in every charset that has more than half of the
    language's characters above 127; then the number of texts that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[tuple[str, str], np.ndarray] = {}

        def add(lang: str, texts: list[str]) -> None:
            as_is = " ".join(texts)  # an end reads as a blank anyway
            code = np.frombuffer(f" {as_is} {as_is.upper()} ".encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
            some = (code[:-1] > 127) | (code[1:] > 127)
            both, times = np.unique((code[:-1] << 32 | code[1:])[some], return_counts=True)
            chars = np.unique(np.concatenate((both >> 32, both & 0xFFFFFFFF)))
            a, b = np.searchsorted(chars, both >> 32), np.searchsorted(chars, both & 0xFFFFFFFF)
            each = np.where(chars > 127, np.bincount(a, times, len(chars)), 0).astype(np.int64)
            for charset in VALID:
                written = [classes(c, charset) for c in map(chr, chars.tolist())]
                n = own.setdefault((charset, lang), np.zeros(_N * _N + 3, np.int64))
                first, last = np.array([w[0] for w in written]), np.array([w[-1] for w in written])
                joint = _HIGH[last[a]] | _HIGH[first[b]]
                np.add.at(n, (last[a] * _N + first[b])[joint], times[joint])
                for w, k in zip(written, each.tolist(), strict=True):
                    for x, y in zip(w[:-1], w[1:], strict=True):  # within a character
                        n[x * _N + y] += k * bool(_HIGH[x] | _HIGH[y])
                n[-3:] += (len(texts), each.sum(), each[first == _LACKING].sum())

        for batch in batches:
            held: dict[str, list[str]] = {}
            size: dict[str, int] = {}
            for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
                lang, text = lang.as_py(), text.as_py()
                if text.isascii():
                    continue
                held.setdefault(lang, []).append(text)
                size[lang] = size.get(lang, 0) + len(text)
                if size[lang] > 1 << 20:
                    add(lang, held.pop(lang))
                    size[lang] = 0
            for lang, texts in held.items():
                add(lang, texts)
        for (charset, lang), n in own.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([charset] * len(some)), pa.array([lang] * len(some)), pa.array(some, pa.int32()), pa.array(n[some])], ["charset", "lang", "pair", "n"])

    rows = texts.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").mapInArrow(run, "charset string, lang string, pair int, n long")
    out: dict[tuple[str, str], np.ndarray] = {}
    found = rows.groupBy("charset", "lang", "pair").agg(F.sum("n").alias("n")).toPandas()  # charsets x languages x pairs of classes at most
    for key, part in found.groupby(["charset", "lang"]):
        n = np.zeros(_N * _N + 3, np.int64)
        n[part["pair"].to_numpy()] = part["n"].to_numpy()
        above, lacking = n[-2:].tolist()
        if 2 * lacking < above:
            out[key] = n[:-2]
    return out


def trained(spark: SparkSession, texts: DataFrame | None = None) -> Charsets:
    """A model from the samples and texts (lang, text); a language of texts takes the place of the sample's."""
    samples = spark.createDataFrame(sorted(SAMPLES.items()), "lang string, text string")
    if texts is not None:
        samples = samples.join(texts.select("lang").distinct(), "lang", "left_anti").unionByName(texts.select("lang", "text"))
    return Charsets(counted(samples))


def detected(content: Column, model: Charsets) -> Column:
    """struct(encoding, confidence) of binary content."""

    @F.pandas_udf("encoding string, confidence double")
    def detect(data: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if d is None else model.detect(d) for d in data]
        return pd.DataFrame({"encoding": pd.Series([r[0] for r in rows], dtype=object), "confidence": pd.Series([r[1] for r in rows], dtype=float)})

    return F.when(content.isNotNull(), detect(content))
