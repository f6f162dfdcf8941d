"""N-gram Jaccard join with count-vector R-trees.

A text's set holds its distinct five-word shingles; texts link when 100 * |A and B| >= 75 * |A or B|. The tokens of a
set are hashed into groups, and the counts by group are a point: the sum of the smaller coordinate of two points is at
least their overlap, so a pair (or an R-tree node, by its largest coordinates) whose sum is too small is out.

A count-vector tree over a whole corpus separates little in so many dimensions, so trees are built within blocks: two
linked sets share one of the first |A| - ceil(0.75 |A|) + 1 tokens under any fixed order. The order puts tokens of
crowded slots last (counts of all tokens of all texts in a table of fixed size), so common passages seldom decide. It
affects the work only, never the result.

  1 sizes, set hashes and the slot counts, in one pass over the texts
  2 tokens: each task keeps one text of each set it meets; a token's leader is the most central text that has it, and
    texts gather under leaders, a row for each leader a text shares a token with, whatever the number of tokens
  3 under each leader: R-tree search over the members' points. Members that come near no other one go; the others fall
    into clusters, which stand under their smallest doc_id from now on, so that a pair that met under many leaders counts
    once
  4 the clusters' texts meet, and the search goes on with the overlap of the whole sets; a pair that links by its hashes
    is confirmed on the words. Only pairs between
    components are looked at, so a group of copies is linked by a tree and not by all its pairs
  5 components of all links; texts with equal sets join theirs through the set's two independent hashes and its size

No partner is dropped. Tokens of crowded slots are salted while their leader is found. A leader with more members than
fit a task is compared with all of them first, in salted parts; those that link are settled, and the others are compared
with everything in blocks of bounded size.

Defined cases: null, empty or white-space texts have an empty set, link with nothing and are their own component;
repeated rows have equal sets and so one component; rows that share a doc_id but not a text are one document, linked by
each of its texts, with the set size of each row's own; a very long text is one set in one task, and weighs by its size in a
block; pairs at exactly 75 per cent link; a null doc_id takes no part and has a null component; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._bytes import U, exact_shingles, in_chunks, mix, shingle_sets, tidy
from ._common import columns, written

SLOTS = 1 << 18
_PART = 1 << 12  # slots in a row of partial counts
LEAF = 32
GROUPS = 1 << 10  # most coordinates of a stored point
FILTER_BITS = 1 << 26


def slot(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> U(40)).astype(np.int64) % SLOTS


def _bounds(owner: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(owner, np.arange(n + 1))


def n_groups(n: int) -> int:
    """Coordinates of the stored point of n tokens: a power of two from 8 on, about one for each token."""
    return min(GROUPS, 1 << max(3, int(n - 1).bit_length()))


def packed(tokens: np.ndarray) -> bytes:
    """The set's count vector, a byte for each group if counts allow it."""
    groups = n_groups(len(tokens))
    count = np.bincount((tokens >> U(20)).astype(np.int64) % groups, minlength=groups)
    return count.astype(np.uint8 if count.max() < 256 else "<u4").tobytes()


def unpacked(point: bytes, n: int, groups: int) -> np.ndarray:
    """A stored point in fewer groups: residues modulo a smaller power of two add up."""
    own = n_groups(n)
    return np.frombuffer(point, np.uint8 if len(point) == own else "<u4").astype(np.uint32).reshape(-1, groups).sum(0)


def set_hash(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate(([U(0)], np.cumsum(mix(tokens))))
    return total[at[1:]] - total[at[:-1]]


def other_lane(texts: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The sets under independent hashes, so that sets with two equal hashes are equal."""
    owner, tokens = shingle_sets(texts, shingle, 1)
    return tokens, _bounds(owner, len(texts))


def profile(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, n, h1, h2, point) of each text, and rows of partial slot counts (part, point)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.zeros(SLOTS, np.int64)
        names = ["doc_id", "n", "h1", "h2", "part", "point"]
        for batch in batches:
            for begin, texts in in_chunks(batch.column("text")):
                owner, tokens = shingle_sets(texts, shingle)
                slots += np.bincount(slot(tokens), minlength=SLOTS)
                at = _bounds(owner, len(texts))
                h1, h2 = set_hash(tokens, at), set_hash(*other_lane(texts, shingle))
                rows = [batch.column("doc_id").slice(begin, len(texts)), pa.array(np.diff(at), pa.int64()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))]
                points = [packed(tokens[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*rows, pa.nulls(len(texts), pa.int32()), pa.array(points, pa.binary())], names)
        used = [k for k in range(0, SLOTS, _PART) if slots[k : k + _PART].any()]
        yield pa.RecordBatch.from_arrays([*[pa.nulls(len(used), pa.int64())] * 4, pa.array(used, pa.int32()), pa.array([slots[k : k + _PART].tobytes() for k in used], pa.binary())], names)

    return docs.mapInArrow(tidy(run), "doc_id long, n long, h1 long, h2 long, part int, point binary")


def slot_counts(table: DataFrame) -> np.ndarray:
    """The summed slot counts: SLOTS numbers, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, b in zip(batch.column("part").to_pylist(), batch.column("point").to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(b, np.int64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["part", "point"])

    out = np.zeros(SLOTS, np.int64)
    for row in table.where("part IS NOT NULL").select("part", "point").repartition("part").mapInArrow(tidy(run), "part int, point binary").collect():
        out[row["part"] : row["part"] + _PART] = np.frombuffer(row["point"], np.int64)
    return out


def token_rows(docs: DataFrame, counts: np.ndarray, shingle: int, percent: int, salt_rows: int, kept_sets: int = 1_000_000) -> DataFrame:
    """(token, salt, salted, central, n, doc_id): the first tokens of each set, one text of each set a task.

    central: how crowded the slots of the set's tokens are; the base of a group of edited copies has the most.
    """
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        load = shared.value
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for begin, texts in in_chunks(batch.column("text")):
                owner, tokens = shingle_sets(texts, shingle)
                at = _bounds(owner, len(texts))
                n = np.diff(at)
                hashed = mix(tokens)
                crowd = load[slot(tokens)]
                weight = np.concatenate(([0.0], np.cumsum(np.log2(np.maximum(crowd, 1)))))
                central = (1e4 * (weight[at[1:]] - weight[at[:-1]]) / np.maximum(n, 1)).astype(np.int32)
                fresh = np.zeros(len(texts), bool)
                for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                    key = (int(n[i]), int(hashed[a:b].sum()), int(tokens[a:b].sum()))
                    if b > a and key not in seen:
                        if len(seen) >= kept_sets:
                            seen.clear()
                        seen.add(key)
                        fresh[i] = True
                order = np.lexsort((hashed, crowd, owner))
                rank = np.arange(len(tokens)) - at[owner]
                prefix = n - -(-percent * n // 100) + 1
                take = (rank < prefix[owner]) & fresh[owner]
                token, doc, crowd = tokens[order][take], owner[take], crowd[order][take]
                salts = 1 + crowd // salt_rows
                salt = (mix(ids[begin:][doc].astype(U)) % salts.astype(U)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(salt, pa.int32()), pa.array(salts > 1), pa.array(central[doc]), pa.array(n[doc], pa.int32()), pa.array(ids[begin:][doc])], ["token", "salt", "salted", "central", "n", "doc_id"])

    return docs.mapInArrow(tidy(run), "token long, salt int, salted boolean, central int, n int, doc_id long")


def under_leaders(rows: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """(leader, doc_id), both as roots of their sets: which texts share a token whose leader this is; leaders included.

    Two sets whose sizes are too far apart can't link, so a member of a block stays only if the next smaller or the next
    larger one is near enough in size; most texts that share a token by chance go with that.
    """
    place = F.struct("central", "doc_id")
    block = Window.partitionBy("token", "salt")
    by_size = block.orderBy("n", "doc_id")
    near = (F.lag("n").over(by_size) * 100 >= F.col("n") * percent) | (F.col("n") * 100 >= F.lead("n").over(by_size) * percent)
    rows = rows.withColumn("near", F.col("salted") | near).where("near").drop("near")
    led = rows.withColumn("top", F.max(place).over(block)).withColumn("low", F.min(place).over(block))
    led = written(led.where("salted OR top <> low").select("token", "salted", "doc_id", "top"), "led")
    # a salted token's leader is the most central of its parts' leaders, one row a part
    tops = led.where("salted").groupBy("token").agg(F.max("top").alias("over"))
    salted = led.where("salted").join(tops, "token").select("doc_id", F.col("over.doc_id").alias("leader"))
    pairs = led.where("NOT salted").select("doc_id", F.col("top.doc_id").alias("leader")).unionByName(salted).distinct()
    for c in ("doc_id", "leader"):
        pairs = pairs.join(roots.select(F.col("doc_id").alias(c), F.col("root").alias("own_root")), c).drop(c).withColumnRenamed("own_root", c)
    pairs = pairs.where("doc_id <> leader").distinct()
    return pairs.select("leader", "doc_id").unionByName(pairs.select("leader", F.col("leader").alias("doc_id")).distinct())


def enough(overlap, a, b, percent: int):
    """Whether sets of a and b tokens with this overlap link."""
    return 100 * overlap >= percent * (a + b - overlap)


class CountTree:
    """R-tree over count vectors: nodes keep the largest coordinate of each group and the smallest set size."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        order = np.lexsort((points.argmax(1), sizes))
        self.order, self.points, self.sizes = order, points[order], sizes[order]
        first = np.arange(0, len(order), LEAF)
        self.levels = [(np.maximum.reduceat(self.points, first, axis=0), np.minimum.reduceat(self.sizes, first))]
        while len(self.levels[-1][1]) > LEAF:
            top, least = self.levels[-1]
            first = np.arange(0, len(least), LEAF)
            self.levels.append((np.maximum.reduceat(top, first, axis=0), np.minimum.reduceat(least, first)))

    def search(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """The indices of all points that may overlap enough with this one."""
        among = np.arange(len(self.levels[-1][1]))
        for depth in range(len(self.levels) - 1, -2, -1):
            top, least = self.levels[depth] if depth >= 0 else (self.points, self.sizes)
            among = among[enough(np.minimum(top[among], point).sum(1, dtype=np.int64), size, least[among], percent)]
            if depth >= 0:
                among = (among[:, None] * LEAF + np.arange(LEAF)).ravel()
                among = among[among < (len(self.levels[depth - 1][1]) if depth else len(self.sizes))]
        return self.order[among]


def points_of(tokens: np.ndarray, at: np.ndarray, groups: int) -> np.ndarray:
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    flat = np.bincount(owner * groups + (tokens >> U(20)).astype(np.int64) % groups, minlength=(len(at) - 1) * groups)
    return flat.reshape(-1, groups).astype(np.uint16 if flat.max(initial=0) < 65536 else np.int64)


def linked(a: set, b: set, percent: int) -> bool:
    """Whether two sets of shingles, words and all, link."""
    return bool(a and b) and enough(len(a & b), len(a), len(b), percent)


def spanning_links(tokens: np.ndarray, at: np.ndarray, known: np.ndarray, percent: int, confirm: Callable[[int, int], bool] = lambda i, j: True) -> list[tuple[int, int]]:
    """Links that span the components of these sets. known: sets with one number are in one component; -1 says nothing.

    confirm looks at the words of a pair that links by its hashes.
    """
    n = np.diff(at)
    groups = 1 << int(np.clip(np.ceil(np.log2(max(1, np.median(n)))), 3, 12))
    points = points_of(tokens, at, groups)
    tree = CountTree(points, n)
    token_id = np.unique(tokens, return_inverse=True)[1]
    mine = np.zeros(token_id.max(initial=0) + 1, bool)
    label = np.arange(len(n))
    for k in np.unique(known[known >= 0]):
        label[known == k] = np.flatnonzero(known == k)[0]
    out: list[tuple[int, int]] = []
    waiting = list(np.flatnonzero(n > 0))
    passed_over: list[int] = []
    while waiting:
        main = np.bincount(label).argmax()
        for i in waiting:
            if label[i] == main:  # whoever isn't in the main component will look for it
                passed_over.append(i)
                continue
            near = tree.search(points[i], n[i], percent)
            near = near[(label[near] != label[i]) & (n[near] > 0)]
            if not len(near):
                continue
            size = n[near]
            flat = np.repeat(at[near] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            own = token_id[at[i] : at[i + 1]]
            mine[own] = True
            overlap = np.add.reduceat(mine[token_id[flat]], np.cumsum(size) - size, dtype=np.int64)
            mine[own] = False
            for j in near[enough(overlap, n[i], size, percent)].tolist():
                if label[j] != label[i] and confirm(int(i), j):
                    out.append((int(i), j))
                    label[label == label[i]] = label[j]
        # those passed over while another component was the main one still have to look
        main = np.bincount(label).argmax()
        waiting, passed_over = [i for i in passed_over if label[i] != main], [i for i in passed_over if label[i] == main]
    return out


def near_clusters(blocks: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """(leader, doc_id, known): the clusters of members whose points come near enough, each under its smallest doc_id.

    Two settled members needn't meet. known: the leader that a settled member links with, else null.
    """
    keys = ["leader", "kind", "i", "j"]

    def pick(rows: pa.Table) -> list[tuple[int, int, int | None]]:
        n, settled, doc = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("n", "settled", "doc_id"))
        stored, coarse = rows.column("point").to_pylist(), np.array([n_groups(k) for k in n.tolist()])
        label = np.arange(len(n))
        # linked sets have as many groups or twice as many, so each size is searched for among itself and the next
        for groups in np.unique(coarse).tolist():
            among = np.flatnonzero((coarse == groups) | (coarse == 2 * groups))
            if len(among) < 2 or settled[among].all():
                continue
            points = np.stack([unpacked(stored[k], n[k], groups) for k in among])
            tree = CountTree(points, n[among]) if len(among) > 2 else None
            for k in np.flatnonzero(coarse[among] == groups):
                if tree:
                    near = tree.search(points[k], n[among[k]], percent)
                else:
                    near = np.flatnonzero(enough(np.minimum(points, points[k]).sum(1, dtype=np.int64), n[among], n[among[k]], percent))
                near = among[near]
                if settled[among[k]]:
                    near = near[~settled[near]]
                met = np.unique(label[np.append(near, among[k])])
                if len(met) > 1:
                    label[np.isin(label, met)] = met[0]
        own, place, size = np.unique(label, return_inverse=True, return_counts=True)
        least = np.full(len(own), np.iinfo(np.int64).max)
        np.minimum.at(least, place, doc)
        leader = rows.column("leader")[0].as_py()
        return [(int(least[c]), int(d), leader if s else None) for d, c, s in zip(doc, place, settled, strict=True) if size[c] > 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            yield from of_groups(held, False)
        if held:
            yield from of_groups(held, True)

    def of_groups(held: list[pa.Table], last: bool) -> Iterator[pa.RecordBatch]:
        """Picks from the groups that are complete; held keeps the rest."""
        table = pa.concat_tables(held).combine_chunks()
        new = np.zeros(len(table), bool)
        for c in (table.column(k).to_numpy() for k in keys):
            new[1:] |= c[1:] != c[:-1]
        edge = [0, *np.flatnonzero(new).tolist(), *([len(table)] if last else [])]
        picked = [x for a, b in zip(edge[:-1], edge[1:], strict=True) if b - a > 1 for x in pick(table.slice(a, b - a))]
        held[:] = [table.slice(edge[-1])] if not last else []
        if picked:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*picked, strict=True)], ["leader", "doc_id", "known"])

    wide = blocks.join(profiles.select("doc_id", "n", "point").dropDuplicates(["doc_id"]), "doc_id").repartition(*keys).sortWithinPartitions(*keys)
    near = wide.select(*keys, "doc_id", "settled", "n", "point").mapInArrow(tidy(run), "leader long, doc_id long, known long")
    return near.groupBy("leader", "doc_id").agg(F.max("known").alias("known"))


def _filter_places(ids: np.ndarray) -> np.ndarray:
    h = mix(ids.astype(U))
    return np.stack((h % U(FILTER_BITS), (h >> U(32)) * U(0x9E3779B1) % U(FILTER_BITS))).astype(np.int64)


def only_likely(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without most of those whose doc_id isn't among ids: a Bloom filter of fixed size, so that few texts move."""
    part = FILTER_BITS // 256

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            own[_filter_places(batch.column("doc_id").to_numpy())] = True
        used = [k for k in range(256) if own[k * part : (k + 1) * part].any()]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([np.packbits(own[k * part : (k + 1) * part]).tobytes() for k in used], pa.binary())], ["part", "bits"])

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, b in zip(batch.column("part").to_pylist(), batch.column("bits").to_pylist(), strict=True):
                total[k] = total.get(k, 0) | np.frombuffer(b, np.uint8)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["part", "bits"])

    whole = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in ids.select("doc_id").mapInArrow(tidy(bits), "part int, bits binary").repartition("part").mapInArrow(tidy(union), "part int, bits binary").collect():
        whole[row["part"] * part // 8 : (row["part"] + 1) * part // 8] = np.frombuffer(row["bits"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(whole)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _filter_places(batch.column("doc_id").to_numpy())
            yield batch.filter(pa.array(((shared.value[at >> 3] << (at & 7)) & 128 > 0).all(0)))

    return docs.select("doc_id", "text").mapInArrow(tidy(keep), "doc_id long, text string")


def grouped_links(rows: DataFrame, docs: DataFrame, keys: list[str], shingle: int, percent: int, star: bool) -> DataFrame:
    """(a, b): links within the groups of rows (keys, doc_id, known, lead).

    star: compare the lead with each member and nothing else, without holding the group.
    """

    def flush(ids: list[int], known: list[int | None], sets: list[np.ndarray], words: list[bytes]) -> list[tuple[int, int]]:
        place = {d: k for k, d in reversed(list(enumerate(ids)))}  # a repeated row is one member
        pick = sorted(place.values())
        ids, sets, words, component = ([x[k] for k in pick] for x in (ids, sets, words, known))
        number = {c: k for k, c in enumerate(c for c in dict.fromkeys(component) if c is not None)}
        at = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
        last: dict[int, set] = {}  # the shingles of the text whose partners are being looked for

        def confirm(i: int, j: int) -> bool:
            if i not in last:
                last.clear()
                last[i] = exact_shingles(words[i], shingle)
            return linked(last[i], exact_shingles(words[j], shingle), percent)

        return [(ids[i], ids[j]) for i, j in spanning_links(np.concatenate(sets), at, np.array([number.get(c, -1) for c in component]), percent, confirm)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, led = None, set()
        ids, known, sets, words = [], [], [], []
        for batch in batches:
            key = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            doc, component, lead = (batch.column(c).to_pylist() for c in ("doc_id", "known", "lead"))
            out: list[tuple[int, int]] = []
            for begin, texts in in_chunks(batch.column("text")):
                owner, tokens = shingle_sets(texts, shingle)
                at = _bounds(owner, len(texts))
                for i in range(len(texts)):
                    k, own = begin + i, tokens[at[i] : at[i + 1]].copy()
                    if key[k] != current:
                        if not star and len(ids) > 1:
                            out += flush(ids, known, sets, words)
                        current, ids, known, sets, words = key[k], [], [], [], []
                        led = exact_shingles(texts[i], shingle) if star else led
                    if star and ids:
                        if lead[k] or not len(own) or not len(sets[0]):
                            continue
                        found = np.minimum(np.searchsorted(sets[0], own), len(sets[0]) - 1)
                        if enough(int((sets[0][found] == own).sum()), len(sets[0]), len(own), percent) and linked(led, exact_shingles(texts[i], shingle), percent):
                            out.append((ids[0], doc[k]))
                        continue
                    ids.append(doc[k])
                    known.append(component[k])
                    sets.append(own)
                    words.append(b"" if star else texts[i])
            if out:
                yield _pairs(out)
        if not star and len(ids) > 1 and (out := flush(ids, known, sets, words)):
            yield _pairs(out)

    def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
        a, b = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    wide = docs.join(rows, "doc_id").repartition(*keys).sortWithinPartitions(*keys, F.col("lead").desc(), "doc_id")
    return wide.select(*keys, "doc_id", "known", "lead", "text").mapInArrow(tidy(run), "a long, b long").where("a <> b").distinct()


def blocks_of(groups: DataFrame, members: int) -> DataFrame:
    """(leader, kind, i, j, doc_id, settled, lead): the blocks in which the members of each leader meet.

    groups: (leader, doc_id, settled, weight). Unsettled members meet each other (kind 1) and the settled ones (kind 0),
    of each a weight of about members at most, so that a block of long texts has fewer.
    """
    parts = lambda of: (F.floor(F.sum(F.when(of, F.col("weight")).otherwise(0.0)) / members) + 1).cast("long")
    sizes = groups.groupBy("leader").agg(parts(F.col("settled")).alias("calm"), parts(~F.col("settled")).alias("loose"), F.max("settled").alias("any_calm"))
    placed = groups.join(sizes, "leader").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.when(F.col("settled"), F.col("calm")).otherwise(F.col("loose"))))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    cell = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.cast("long").alias("i"), j.cast("long").alias("j"))
    of_calm = F.transform(upto("loose"), lambda j: cell(0, F.col("own"), j))
    with_loose = F.transform(upto("loose"), lambda k: cell(1, F.least("own", k), F.greatest("own", k)))
    with_calm = F.when(F.col("any_calm"), F.transform(upto("calm"), lambda i: cell(0, i, F.col("own")))).otherwise(F.array().cast("array<struct<kind:int,i:bigint,j:bigint>>"))
    cells = F.when(F.col("settled"), of_calm).otherwise(F.concat(with_loose, with_calm))
    return placed.select("leader", F.explode(cells).alias("cell"), "doc_id", "settled", (F.col("doc_id") == F.col("leader")).alias("lead")).select("leader", "cell.*", "doc_id", "settled", "lead")


def settle_large(groups: DataFrame, docs: DataFrame, shingle: int, percent: int, members: int) -> tuple[DataFrame, DataFrame | None]:
    """Groups with a settled flag, and the links found: members of large groups that link with their leader."""
    size = groups.groupBy("leader").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > members)
    large = written(groups.join(size, "leader"), "large")
    if large.isEmpty():
        return groups.withColumn("settled", F.lit(False)), None
    parts = F.floor(F.col("n") / 512) + 1
    rows = large.where("doc_id <> leader").select("leader", F.pmod(F.xxhash64("doc_id"), parts).alias("part"), "doc_id", F.lit(False).alias("lead"))
    heads = large.where("doc_id = leader").select("leader", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), "doc_id", F.lit(True).alias("lead"))
    star = grouped_links(rows.unionByName(heads).withColumn("known", F.lit(None).cast("long")), docs, ["leader", "part"], shingle, percent, True)
    star = written(star, "stars")
    found = star.select(F.col("a").alias("leader"), F.col("b").alias("doc_id")).unionByName(star.select(F.col("a").alias("leader"), F.col("a").alias("doc_id"))).distinct().withColumn("hit", F.lit(True))
    return groups.join(found, ["leader", "doc_id"], "left").select("leader", "doc_id", F.coalesce("hit", F.lit(False)).alias("settled")), star


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, by alternating large and small stars; nodes with links only.

    Each round hangs every node's neighbours on the smallest of them. A hub's minimum is pre-aggregated by task.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:  # every round brings nodes nearer to their smallest one, so this ends
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = written(small, "edges")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def join(docs: DataFrame, shingle: int = 5, percent: int = 75, salt_rows: int = 20_000, members: int = 4096) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links): n_links counts the spanning links of the text's set.

    salt_rows: tokens in a slot before its tokens are salted; members: the most that meet in one block, a long
    text counting once for each thousand shingles.
    """
    docs = columns(docs, "doc_id", "text")
    given = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    known, several = own_nodes(given)
    table = written(profile(known, shingle), "profiles")
    counts = slot_counts(table)
    profiles = table.where("part IS NULL").drop("part")

    # texts with equal sets stand under the smallest of their doc_ids
    first = profiles.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("root"))
    roots = written(profiles.where("n > 0").join(first, ["h1", "h2", "n"]).select("doc_id", "root").distinct(), "roots")

    groups = written(under_leaders(token_rows(known, counts, shingle, percent, salt_rows), roots, percent), "groups")
    groups, stars = settle_large(groups, known, shingle, percent, members)
    near = written(near_clusters(blocks_of(groups.withColumn("weight", F.lit(1.0)), members), profiles, percent), "near")
    # in a large cluster the members that link with one and the same leader needn't meet each other
    main = near.groupBy("leader").agg(F.mode("known").alias("main"))
    clusters = near.join(main, "leader").withColumn("settled", F.coalesce(F.col("known") == F.col("main"), F.lit(False)))
    weight = profiles.groupBy("doc_id").agg(F.greatest(F.lit(1.0), F.max("n") / 1000).alias("weight"))
    met = blocks_of(clusters.select("leader", "doc_id", "settled").join(weight, "doc_id"), members).join(near, ["leader", "doc_id"])
    links = grouped_links(met, only_likely(known, near), ["leader", "kind", "i", "j"], shingle, percent, False)
    links = written(links.unionByName(stars).distinct() if stars else links, "links")

    degree = links.select(F.explode(F.array("a", "b")).alias("root")).groupBy("root").agg(F.count(F.lit(1)).alias("n_links"))
    if several is not None:  # the texts of a doc_id are one document
        of_doc = roots.join(several.withColumnRenamed("node", "doc_id"), "doc_id").select("owner", "root")
        links = links.unionByName(of_doc.groupBy("owner").agg(F.min("root").alias("a")).join(of_doc, "owner").select("a", F.col("root").alias("b")))
    labels = components(links)
    per_doc = roots.join(labels.withColumnRenamed("node", "root"), "root", "left").join(degree, "root", "left")
    per_doc = per_doc.select("doc_id", F.coalesce("component", "root").alias("linked"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    sizes = profiles.select("doc_id", "n").distinct()
    if several is None:
        out = docs.select("doc_id", F.col("text").isNull().alias("bare")).join(sizes, "doc_id", "left").join(per_doc, "doc_id", "left")
        return _result(out)
    named = per_doc.join(several.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("owner", F.coalesce("owner", "doc_id"))
    least = named.groupBy("linked").agg(F.min("owner").alias("least"))
    named = named.join(least, "linked").select("doc_id", F.col("least").alias("linked"), "n_links")
    rest = docs.where("doc_id IS NULL OR text IS NULL").select("doc_id", F.lit(None).cast("long").alias("owner"), F.lit(True).alias("bare"))
    rows = known.select("doc_id").join(several.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("bare", F.lit(False)).unionByName(rest)
    out = rows.join(sizes, "doc_id", "left").join(named, "doc_id", "left")
    return _result(out.withColumn("doc_id", F.coalesce("owner", "doc_id")))


def own_nodes(given: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, text) where each text has an id of its own, and (node, owner) of the ids that aren't the doc_id, if any.

    A doc_id with one text keeps it. One with several, which is rare, gets a hash of doc_id and text for each.
    """
    several = given.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("low"), F.max(F.xxhash64("text")).alias("high")).where("low <> high").select("doc_id")
    several = written(several, "several")
    if several.isEmpty():
        return given, None
    marked = given.join(several.withColumn("owner", F.col("doc_id")), "doc_id", "left")
    marked = written(marked.withColumn("doc_id", F.when(F.col("owner").isNull(), F.col("doc_id")).otherwise(F.xxhash64("doc_id", "text"))), "texts")
    return marked.select("doc_id", "text"), marked.where("owner IS NOT NULL").select(F.col("doc_id").alias("node"), "owner").distinct()


def _result(out: DataFrame) -> DataFrame:
    n = F.when(F.col("bare") | F.col("n").isNull(), 0).otherwise(F.col("n"))
    return out.select("doc_id", n.cast("long").alias("n_shingles"), F.coalesce("linked", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l FROM documents),
g AS (SELECT doc_id, list_distinct(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 5 THEN [list_aggregate(l, 'string_agg', ' ')]
      ELSE list_transform(range(1, len(l) - 3), lambda i: list_aggregate(l[i:i + 4], 'string_agg', ' ')) END) AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM g),
t AS (SELECT doc_id, unnest(s) AS t FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM t a JOIN t b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (WITH RECURSIVE r(d, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.d) SELECT * FROM r)
SELECT n.doc_id, n.n AS n_shingles, min(r.c)::BIGINT AS component_id FROM n JOIN r ON r.d = n.doc_id GROUP BY n.doc_id, n.n
"""
