r"""Quality rules with n-gram perplexity.

Texts are judged by two models over bytes, all 256 told apart, both modified Kneser-Ney: by short contexts, which tell odd
characters, and by long ones, which tell odd words. A text must lie in the bands of both.

An n-gram's count is the number of texts that have it: what one text repeats without end, signs after every word say, is no
more expected elsewhere for that, and a long text counts no more than others. The highest order has these counts, the lower
ones continuation counts (distinct bytes before), each with its three discounts; an unseen byte takes the lower order's
probability times the context's weight, down to the uniform one, so that every context's probabilities add up to one.

Short: each byte given the two before it. There are at most 2**24 trigrams however large the corpus is, so this model is sent
to every task, in arrays sorted by the n-gram's hash, and texts are scored from them (each distinct trigram of a piece of
text once).

Long: each byte given the order - 1 before it (four, unless told otherwise). These n-grams grow with the corpus, so the model
is kept in tables, of which neither a task nor the driver ever has the whole:

  packs   some megabytes of texts each, written once, as a table bucketed by pack
  asked   the distinct n-grams of each pack, and in how many of its texts each occurs: a table bucketed by n-gram
  model   asked's counts added up, and lower orders joined to higher ones by context and by suffix (256 rows a key at
          most); up to three bytes it has the bound of the short model, and its form
  answers each n-gram's surprise, for every pack that asked; they meet the pack's texts, which don't move again

Long contexts would know a text by heart that they were counted on, however odd it is. So there are two long models, each of
half the texts by a hash of the text, and a text is scored by the half that it isn't in; its exact copies are in its own half.

Either log perplexity of a text is compared with the band of its language and length (by powers of two of its characters, as
short texts spread wider): the median, and beyond it a multiple of the distance to the quartile on that side. Lengths
with few texts take the band of a shorter one or, without, the language's, which is wider. Quartiles come from exact histograms over all texts. Texts
outside the band are rejected, as are those that fail the base rules.

Defined cases: null or empty text has no words and fails the base rules; its log perplexities are null and it has no part
in the bands; a very long text is scored whole, in one piece of its own; a null language is a language of its own;
repeated rows, and rows that share a doc_id, count and are judged each; a text on the edge of its band is kept; a null
doc_id is judged like any other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._bytes import SPACE, WORD, U, Block, in_chunks, mix, run_hashes, same_runs, tidy, window_hashes
from ._common import bucketed, columns, drop_table, shuffles_freed, written

ORDER = 3  # of the short model
FOLDS = 0, 1
SYMBOLS = b"#*$%&|<>"
SCORED = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_perplexity double, log_perplexity_long double"


def dense_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code of the trigram that ends at each byte, bytes that occur, where each text's codes begin).

    A code counts in the bytes that occur. A text begins after two spaces.
    """
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    pad = b" " * (ORDER - 1)
    data = np.frombuffer(pad + pad.join(texts), np.uint8)
    used = np.flatnonzero(np.bincount(data, minlength=256))
    rank = np.zeros(256, np.int32)
    rank[used] = np.arange(len(used))
    r = rank[data]
    code = (r[:-2] * len(used) + r[1:-1]) * len(used) + r[2:]
    first = np.cumsum(size + ORDER - 1) - size - (ORDER - 1)
    own = np.ones(len(code), bool)
    for k in range(ORDER - 1):
        own[first[1:] - (ORDER - 1) + k] = False
    return code[own], used, np.concatenate(([0], np.cumsum(size)))


def trigrams(code: np.ndarray, used: np.ndarray) -> np.ndarray:
    """The trigrams of dense codes, as numbers to the base 256."""
    k = len(used)
    return (used[code // (k * k)] << 16) | (used[code // k % k] << 8) | used[code % k]


def count(docs: DataFrame) -> DataFrame:
    """(code, n) of the trigrams of all texts: in how many each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def summed() -> list[tuple[np.ndarray, np.ndarray]]:
            grams, place = np.unique(np.concatenate([g for g, _ in held]), return_inverse=True)
            return [(grams, np.bincount(place, np.concatenate([n for _, n in held])).astype(np.int64))]

        for batch in batches:
            for _, texts in in_chunks(batch.column("text")):
                code, used, edge = dense_codes(texts)
                wide = len(used) ** ORDER
                if len(texts) == 1:  # which may be long
                    n = np.minimum(np.bincount(code), 1)
                else:
                    n = np.bincount(np.unique(np.repeat(np.arange(len(texts)) * wide, np.diff(edge)) + code) % wide)
                some = np.flatnonzero(n)
                held.append((trigrams(some, used), n[some]))
                rows += len(some)
                if rows > 1 << 22:
                    held = summed()
                    rows = len(held[0][0])
        for grams, n in summed() if held else ():
            yield pa.RecordBatch.from_arrays([pa.array(grams, pa.int32()), pa.array(n)], ["code", "n"])

    return docs.mapInArrow(tidy(run), "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def codes(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(the order bytes that end at each byte, as a number to the base 256; where each text's codes begin).

    A text begins after order - 1 spaces.
    """
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    pad = b" " * (order - 1)
    data = np.frombuffer(pad + pad.join(texts), np.uint8)
    total = len(data) - order + 1
    code = np.zeros(total, np.int64)
    for k in range(order):
        code <<= 8
        code |= data[k : k + total]
    edge = np.concatenate(([0], np.cumsum(size)))
    own = np.ones(total, bool)
    own[(edge[1:-1] + (order - 1) * np.arange(len(texts) - 1))[:, None] + np.arange(order - 1)] = False
    return code[own], edge


def added(code: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sums of each code, which stand together."""
    begin = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))[: len(code)])
    return code[begin], *(np.add.reduceat(n, begin) if len(begin) else n for n in (n0, n1))


def merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted counts of several pieces as one."""
    code, n0, n1 = (np.concatenate(x) for x in zip(*parts, strict=True))
    place = np.argsort(code, kind="stable")  # which merges sorted runs
    return added(code[place], n0[place], n1[place])


def tally(texts: list[bytes], fold: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, n0, n1), sorted: in how many texts of either fold each code occurs."""
    bits = 64 - 8 * order  # for the text
    parts = []
    for a in range(0, len(texts), 1 << bits):
        code, edge = codes(texts[a : a + (1 << bits)], order)
        size = np.diff(edge)
        key = code.view(U) << U(bits) | np.repeat(np.arange(len(size)).astype(U), size)
        key.sort()
        key = key[np.concatenate(([True], key[1:] != key[:-1]))[: len(key)]]
        n1 = fold[a:][(key & U((1 << bits) - 1)).astype(np.int64)].astype(np.int64)
        parts.append(added((key >> U(bits)).view(np.int64), 1 - n1, n1))
    return merged(parts)


def finder(code: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Tells the places of codes among these, which are sorted and distinct and include them."""
    bits = max(len(code).bit_length() + 3, 8)
    slot = lambda c: (c.view(U) * U(0x9E3779B97F4A7C15) >> U(64 - bits)).view(np.int64)
    table = np.zeros(1 << bits, np.int32)
    table[slot(code)] = np.arange(len(code))

    def places(own: np.ndarray) -> np.ndarray:
        if not len(own):
            return np.zeros(0, np.int64)
        at = table[slot(own)]
        other = np.flatnonzero(code[at] != own)  # whose slot has another code
        at[other] = np.searchsorted(code, own[other])
        return at

    return places


def packed(docs: DataFrame, pack_bytes: int) -> DataFrame:
    """(pack, doc_id, lang, text, fold). A task names its packs at random."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = uuid.uuid4().int >> 65, 0
        for batch in batches:
            for begin, texts in in_chunks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(texts), name)), *(c.slice(begin, len(texts)) for c in batch.columns)], ["pack", *batch.schema.names])
                held += sum(map(len, texts))
                if held >= pack_bytes:
                    name, held = uuid.uuid4().int >> 65, 0

    docs = docs.select("doc_id", "lang", "text", F.coalesce(F.xxhash64("text").bitwiseAND(1), F.lit(0)).cast("int").alias("fold"))
    return docs.mapInArrow(tidy(run), "pack long, doc_id long, lang string, text string, fold int")


def asked(packs: DataFrame, order: int) -> DataFrame:
    """(pack, code, n0, n1): the distinct n-grams of each pack; n0 and n1 are the texts of either fold that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, rows = None, [], 0

        def asks() -> pa.RecordBatch:
            code, n0, n1 = merged(held)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(code), last), code, n0, n1)], ["pack", "code", "n0", "n1"])

        for batch in batches:
            name, fold = batch.column("pack").to_numpy(), batch.column("fold").to_numpy()
            edges = np.concatenate(([0], np.flatnonzero(np.diff(name)) + 1, [len(name)]))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if held and a < b and name[a] != last:
                    yield asks()
                    held, rows = [], 0
                last = name[a] if a < b else last
                for begin, texts in in_chunks(batch.column("text").slice(a, b - a), 4 << 20):
                    held.append(tally(texts, fold[a + begin :][: len(texts)], order))
                    rows += len(held[-1][0])
                    if rows > 1 << 22:
                        held, rows = [merged(held)], 0
        if held:
            yield asks()

    return packs.select("pack", "text", "fold").mapInArrow(tidy(run), "pack long, code long, n0 long, n1 long")


def cuts(n1: float, n2: float, n3: float, n4: float) -> list[float]:
    """Modified Kneser-Ney's discounts D1, D2 and D3+, from how many n-grams have the counts 1 to 4."""
    if not (n1 and n2):
        return [0.5] * 3
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.0]
    return np.clip(d, 0.05, [1, 2, 3]).tolist()


def discounts(n: np.ndarray) -> np.ndarray:
    """The discount for each count."""
    return np.choose(np.clip(n, 1, 3) - 1, cuts(*(float((n == k).sum()) for k in (1, 2, 3, 4))))


def _key(order: int, code: np.ndarray) -> np.ndarray:
    return mix(code.astype(U) << U(2) | U(order))


def fit(code: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """The model: keys (sorted hashes of n-grams of all orders), p (probability of the last byte), weight (what a context
    leaves to the lower order; 1 for n-grams that are no context). Plain arrays, so that workers need no class of ours."""
    keys, probability, weight = [], [], []
    lower = np.full(256, 1 / 256)  # order 0
    order_of = {ORDER: (code, n)}
    for k in range(ORDER - 1, 0, -1):
        grams, before = np.unique(order_of[k + 1][0] & ((1 << 8 * k) - 1), return_counts=True)
        order_of[k] = (grams, before)
    left = {ORDER: {}}
    seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for k in range(1, ORDER + 1):
        grams, amount = order_of[k]
        context, place = np.unique(grams >> 8, return_inverse=True)
        total = np.bincount(place, amount, len(context))
        d = discounts(amount)
        spare = np.bincount(place, d, len(context)) / np.maximum(total, 1)
        if k == 1:
            p = (spare[0] if len(spare) else 1.0) * lower
            p[grams] += (amount - d) / total[place]
            grams, lower = np.arange(256), p  # every byte
        else:
            below, p_below = seen[k - 1]
            p = (amount - d) / total[place] + spare[place] * p_below[np.searchsorted(below, grams & ((1 << 8 * (k - 1)) - 1))]
        seen[k] = (grams, p)
        left[k - 1] = (context, spare)
    for k in range(1, ORDER + 1):
        grams, p = seen[k]
        w = np.ones(len(grams))
        if k < ORDER:
            context, spare = left[k]
            at = np.minimum(np.searchsorted(context, grams), len(context) - 1) if len(context) else np.zeros(len(grams), int)
            if len(context):
                w = np.where(context[at] == grams, spare[at], 1.0)
        keys.append(_key(k, grams))
        probability.append(p)
        weight.append(w)
        if k < ORDER and len(left[k][0]):  # contexts that end no n-gram of their order: those at a text's begin
            context, spare = left[k]
            own = ~np.isin(context, grams)
            keys.append(_key(k, context[own]))
            probability.append(np.full(own.sum(), np.nan))
            weight.append(spare[own])
    keys, probability, weight = (np.concatenate(x) for x in (keys, probability, weight))
    order = np.argsort(keys)
    return {"keys": keys[order], "p": probability[order].astype(np.float32), "weight": weight[order].astype(np.float32)}


def probabilities(model: dict[str, np.ndarray], code: np.ndarray) -> np.ndarray:
    """P(last byte | two before) of trigrams, looked up in the sorted arrays, with the lower orders where unseen."""

    def find(order: int, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        want = _key(order, code)
        at = np.minimum(np.searchsorted(model["keys"], want), len(model["keys"]) - 1)
        return at, model["keys"][at] == want

    factor, out = np.ones(len(code)), np.full(len(code), np.nan)
    for k in range(ORDER, 0, -1):
        gram = code & ((1 << 8 * k) - 1)
        at, known = find(k, gram)
        p = np.where(known, model["p"][at], np.nan)
        out = np.where(np.isnan(out) & ~np.isnan(p), factor * p, out)
        if k > 1:
            at, known = find(k - 1, gram >> 8)
            factor = factor * np.where(known, model["weight"][at], 1.0)
    return out


def log_perplexity(model: dict[str, np.ndarray], texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(mean surprise a byte, bytes) of each text."""
    code, used, at = dense_codes(texts)
    n = np.bincount(code, minlength=1)
    some = np.flatnonzero(n)
    table = np.zeros(len(n))
    table[some] = -np.log(probabilities(model, trigrams(some, used)))
    total = np.concatenate(([0], np.cumsum(table[code])))
    size = np.diff(at)
    return (total[at[1:]] - total[at[:-1]]) / np.maximum(size, 1), size


def from_arrays(grams: DataFrame) -> DataFrame:
    """(code, p0, p1) of trigrams by the counts of either fold."""
    known = grams.orderBy("code").toPandas()  # 2**24 rows at most
    models = []
    for f in FOLDS:
        own = known[known[f"n{f}"] > 0]
        models.append(fit(own["code"].to_numpy().astype(np.int64), own[f"n{f}"].to_numpy().astype(np.int64)))
    sent = grams.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = batch.column("code").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("code"), *(pa.array(probabilities(m, code)) for m in sent.value)], ["code", "p0", "p1"])

    return grams.select("code").mapInArrow(run, "code long, p0 double, p1 double")


def interpolated(grams: DataFrame, lower: DataFrame, order: int) -> DataFrame:
    """(code, p0, p1) of n-grams by either fold's counts and the probabilities of the next lower order."""
    tallies = grams.agg(*(F.count_if(F.col(f"n{f}") == k).alias(f"{f}_{k}") for f in FOLDS for k in (1, 2, 3, 4))).first()
    sums = []
    for f in FOLDS:
        n, d = F.col(f"n{f}"), cuts(*(float(tallies[f"{f}_{k}"]) for k in (1, 2, 3, 4)))
        cut = F.when(n == 0, 0.0).when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])
        grams = grams.withColumn(f"cut{f}", cut)
        sums += [F.sum(f"n{f}").alias(f"total{f}"), F.sum(f"cut{f}").alias(f"spare{f}")]
    grams = grams.withColumn("context", F.shiftright("code", 8)).withColumn("suffix", F.col("code").bitwiseAND((1 << 8 * (order - 1)) - 1))
    below = lower.select(F.col("code").alias("suffix"), *(F.col(f"p{f}").alias(f"lower{f}") for f in FOLDS))
    joined = grams.join(grams.groupBy("context").agg(*sums), "context").join(below, "suffix")
    p = lambda f: F.when(F.col(f"total{f}") > 0, (F.col(f"n{f}") - F.col(f"cut{f}") + F.col(f"spare{f}") * F.col(f"lower{f}")) / F.col(f"total{f}")).otherwise(F.col(f"lower{f}"))
    return joined.select("code", *(p(f).alias(f"p{f}") for f in FOLDS))


def surprises(asks: DataFrame, order: int) -> DataFrame:
    """(pack, code, s0, s1) of what packs asked: each n-gram's surprise in a text of either fold, by the other's model."""
    grams = {order: written(asks.groupBy("code").agg(*(F.sum(f"n{f}").alias(f"n{f}") for f in FOLDS)), "grams")}
    for k in range(order - 1, ORDER - 1, -1):
        before = grams[k + 1].withColumn("code", F.col("code").bitwiseAND((1 << 8 * k) - 1))
        grams[k] = written(before.groupBy("code").agg(*(F.count_if(F.col(f"n{f}") > 0).alias(f"n{f}") for f in FOLDS)), "grams")
    p = from_arrays(grams[ORDER])
    for k in range(ORDER + 1, order + 1):
        p = interpolated(grams[k], p, k)
    s = [(-F.ln(f"p{1 - f}")).cast("float").alias(f"s{f}") for f in FOLDS]
    return asks.select("pack", "code").join(p.select("code", *s), "code").select("pack", "code", "s0", "s1")


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words in windows that occur twice or more, from the words themselves."""
    places: dict[tuple[bytes, ...], list[int]] = {}
    for k in range(len(words) - width + 1):
        places.setdefault(tuple(words[k : k + width]), []).append(k)
    return len({w for own in places.values() if len(own) > 1 for k in own for w in range(k, k + width)})


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if WORD.search(x)]
    return len(lines) - len(set(lines))


def statistics(texts: list[bytes]) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    block = Block(texts)
    data, n = block.data, block.n
    first, last = block.first, block.first + block.length
    total = lambda flags: (c := np.concatenate(([0], np.cumsum(flags))))[last] - c[first]
    starts, ends = block.words()
    doc = block.document(starts)
    n_words = np.bincount(doc, minlength=n)
    chars = total(~SPACE[data] & (data & 0xC0 != 0x80))
    symbols = total(np.isin(data, np.frombuffer(SYMBOLS, np.uint8)))
    dup_lines = np.fromiter(map(duplicate_lines, texts), np.int64, n)
    # words in five-word windows that occur twice: found by hash, confirmed on the words
    key = window_hashes(run_hashes(data, starts, ends), 5)
    at = np.arange(len(key))
    at = at[doc[at] == doc[at + 4]] if len(at) else at
    key, owner = key[at], doc[at]
    order = np.lexsort((key, owner))
    same = (key[order][1:] == key[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    a, b = at[order][:-1][same], at[order][1:][same]
    word = np.arange(5)
    a, b = (a[:, None] + word).ravel(), (b[:, None] + word).ravel()
    wrong = np.unique(doc[a[~same_runs(data, starts[a], ends[a], starts[b], ends[b])]])
    twice = np.zeros(len(at), bool)
    twice[1:] |= same
    twice[:-1] |= same
    step = np.zeros(len(starts) + 1, np.int64)
    np.add.at(step, at[order][twice], 1)
    np.add.at(step, at[order][twice] + 5, -1)
    repeat = np.bincount(doc[np.cumsum(step)[:-1] > 0], minlength=n)
    for i in wrong.tolist():  # different windows had one hash
        repeat[i] = repeated_words(WORD.findall(texts[i]))
    return [n_words, chars, symbols, dup_lines, repeat]


def banded(out: DataFrame, scored: DataFrame, column: str, reach: float, least: int, certain: float, floor: float, slack: float, step: float) -> DataFrame:
    """out with in_<column>: whether its column lies in the band that scored's rows of its language and length make."""
    length = F.floor(F.log2(F.greatest(F.col("word_chars"), F.lit(1)))).cast("int").alias("size")
    bins = scored.select("lang", length, F.floor(F.col(column) / step).cast("long").alias("bin")).where("bin IS NOT NULL").groupBy("lang", "size", "bin").agg(F.count(F.lit(1)).alias("n"))

    def quartiles(counted: DataFrame, *by: str) -> DataFrame:
        """(by, rows, q1, q2, q3)"""
        share = F.sum("n").over(Window.partitionBy(*by).orderBy("bin")) / F.sum("n").over(Window.partitionBy(*by))
        at = lambda q: F.min(F.when(F.col("share") >= q, F.col("bin"))) * step
        return counted.withColumn("share", share).groupBy(*by).agg(F.sum("n").alias("rows"), at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))

    whole = quartiles(bins.groupBy("lang", "bin").agg(F.sum("n").alias("n")), "lang").select(F.col("lang").alias("band_lang"), *(F.col(q).alias(f"l{q}") for q in ("q1", "q2", "q3")))
    shorter = Window.partitionBy("lang").orderBy("size")
    enough = lambda q: F.last(F.when(F.col("rows") >= least, F.col(q)), ignorenulls=True).over(shorter).alias(q)
    own = quartiles(bins, "lang", "size").select(F.col("lang").alias("own_lang"), F.col("size").alias("own_size"), *map(enough, ("q1", "q2", "q3")))
    kept = out.columns
    out = out.withColumn("size", length).join(whole, F.col("lang").eqNullSafe(F.col("band_lang")), "left")
    out = out.join(own, F.col("lang").eqNullSafe(F.col("own_lang")) & (F.col("size") == F.col("own_size")), "left")
    root = F.sqrt(F.greatest(F.col("word_chars"), F.lit(1)))
    side = lambda near, whole_near: F.when(F.col("q2").isNotNull(), reach * F.greatest(near, certain / root)).otherwise(F.greatest(F.lit(floor), reach * whole_near) + slack / root)
    low = F.coalesce("q2", "lq2") - side(F.col("q2") - F.col("q1"), F.col("lq2") - F.col("lq1"))
    high = F.coalesce("q2", "lq2") + side(F.col("q3") - F.col("q2"), F.col("lq3") - F.col("lq2"))
    return out.select(*kept, F.coalesce(F.col(column).between(low, high), F.lit(False)).alias(f"in_{column}"))


def judge(docs: DataFrame, reach: float = 6.5, least: int = 30, certain: float = 0.25, floor: float = 0.1, slack: float = 3.0, step: float = 0.001, order: int = 5, pack_bytes: int = 16 << 20) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, log_perplexity, log_perplexity_long, lang).

    reach: how many quartile distances the band goes beyond the median (six and a half are more than four standard deviations of a Gaussian);
    least: the texts of a language and length that have a band of their own; certain: its least quartile distance, divided
    by the square root of the characters (half of what sampling makes; many copies make it narrower). Others take the
    band of the next shorter length that has one, else the language's, with floor as its least half-width in nats and slack, divided by that root, added to it.
    order: the bytes of the long model's n-grams; pack_bytes: texts that ask it together.
    """
    if not ORDER < order <= 7:
        raise ValueError("order must be from 4 to 7")
    docs = columns(docs, "doc_id", "text", "lang")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts_table = bucketed(packed(docs, pack_bytes), "texts", parts, ["pack"], "zstd")
    packs = spark.table(texts_table)
    counts = count(packs.select("text")).orderBy("code").toPandas()  # 2**24 rows at most
    short = spark.sparkContext.broadcast(fit(counts["code"].to_numpy().astype(np.int64), counts["n"].to_numpy()))

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        code = answers.column("code").to_numpy()
        place = np.argsort(code)
        places, surprise = finder(code[place]), np.stack([answers.column(f"s{f}").to_numpy()[place] for f in FOLDS])
        found = []
        for batch in texts.combine_chunks().to_batches():
            fold = batch.column("fold").to_numpy()
            for begin, some in in_chunks(batch.column("text")):
                surprise_short, size = log_perplexity(short.value, some)
                own, edge = codes(some, order)
                total = np.concatenate(([0], np.cumsum(surprise[np.repeat(fold[begin:][: len(some)], size), places(own)], dtype=np.float64)))
                mean = (total[edge[1:]] - total[edge[:-1]]) / np.maximum(size, 1)
                ids = [batch.column(c).slice(begin, len(some)) for c in ("doc_id", "lang")]
                found.append(pa.RecordBatch.from_arrays([*ids, *(pa.array(x, pa.int64()) for x in statistics(some)), *(pa.array(x, mask=size == 0) for x in (surprise_short, mean))], [f.split(" ")[0] for f in SCORED.split(", ")]))
        return pa.Table.from_batches(found)

    with shuffles_freed(spark):
        asked_table = bucketed(asked(packs, order).repartition(parts, "code"), "asked", parts, ["code"], "zstd")
        answers = surprises(spark.table(asked_table), order)
        scored = written(packs.groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(score, SCORED), "perplexity")
    for name in (texts_table, asked_table):
        drop_table(spark, name)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = scored
    for c in ("log_perplexity", "log_perplexity_long"):
        out = banded(out, scored, c, reach, least, certain, floor, slack, step)
    kept = ~failed & F.col("in_log_perplexity") & F.col("in_log_perplexity_long")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"), "log_perplexity", "log_perplexity_long", "lang")
