"""Near-duplicate documents by a grouped prefix join on word n-grams (exact for the threshold).

1. Each document becomes its set of distinct n-grams (64-bit hashes, sorted: a random order that all share). Two sets with
   Jaccard similarity t or more share at least ``o = ceil(t * n)`` n-grams (n: the larger size), so their first
   ``n - o + l(n)`` n-grams share at least ``l`` of them, with the smaller of both values of l. Only this part
   is counted over the corpus, by shards of n-grams.
2. In that part the rarest come first. By the same argument two linked sets share one of the first
   ``part - l + 1``: the prefix that is indexed. N-grams that occur once are left out; a document with fewer than l others has no
   partner.
3. Equal sets are one class. Classes with the same prefix and size are one group. Groups that share a prefix n-gram
   and fit in size are pairs; pairs of groups are expanded to their members, and these are verified on whole sets.
   N-grams that many groups share first link every group to one of them (a few rounds with changing centres, each on the
   n-grams whose groups still lie in different components); then only pairs from different components are left to expand, and of
   these the ones whose sets must differ too much, as their parities show, are left out; so a large cluster of copies costs a few
   pairs for each member, and no link between components is lost.

Defined results: a null or blank text has an empty set and links with nothing; a text of fewer words than n is one
n-gram; rows with a null id are not linked, an id that occurs twice is one node that has the links of all its texts; no rows give
no rows; extra columns are not read. The result is a stored table.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinvec.llm import shingles as S
from twinvec.llm.components import components
from twinvec.llm.registry import register, table
from twinvec.session import checkpoint, discard

WORDS, PERCENT = 5, 80
#: Rounds of linking to centres (fewer where one leaves more than half of the pairs), pairs per index row that are few enough to
#: expand at once, pairs that may be broadcast, bits of a set's parity, and n-grams before an index row's own that it holds.
ROUNDS, FEW_PAIRS, MOST_BROADCAST, BITS, EARLIER = 5, 2, 1_000_000, 512, 8


def spare(n: np.ndarray) -> np.ndarray:
    """l(n): n-grams that two linked sets must share in the counted part."""
    return np.maximum(1, n // 5)


def part_size(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -(-percent * n // 100) + spare(n)


def doc_sets(batch: pa.RecordBatch, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``doc, gram`` sorted by both, without repeats, and the size of each document's set."""
    data, ends = S.flat(batch["text"])
    h, counts = S.words(data, ends, lower=True)
    owner = np.repeat(np.arange(len(counts)), counts)
    at = S.inside(counts, words)
    doc, gram = [owner[at]], [S.windows(h, words)[at]]
    first = np.cumsum(counts) - counts
    for k in range(1, words):
        short = np.flatnonzero(counts == k)
        doc.append(short)
        gram.append(S.mix(S.windows(h, k)[first[short]] + np.uint64(k)) if len(short) else np.empty(0, dtype=np.uint64))
    doc, gram = np.concatenate(doc), np.concatenate(gram)
    order = np.lexsort((gram, doc))
    doc, gram = doc[order], gram[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])
    doc, gram = doc[new], gram[new]
    return doc, gram, np.bincount(doc, minlength=len(counts)).astype(np.int64)


def ranks(doc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Place of each entry in its document, for entries sorted by document."""
    return np.arange(len(doc)) - (np.cumsum(n) - n)[doc]


def _counted(batch, words, percent):
    doc, gram, n = doc_sets(batch, words)
    return doc, gram, n, ranks(doc, n) < part_size(n, percent)[doc]


def gram_counts(blocks: DataFrame, shards: int, words: int, percent: int) -> DataFrame:
    """``block, shard, counts``: for the distinct n-grams of a block's counted parts that fall to a shard (in order of hash),
    the number of documents that have them in theirs, at most 255. A block asks for an n-gram once, however common it is."""
    def ask(batches):
        for b in batches:
            for block, cell in zip(b["block"].to_pylist(), b["docs"]):
                _, gram, _, part = _counted(S.unpack(cell), words, percent)
                keys, times = np.unique(gram[part], return_counts=True)
                times, home = np.minimum(times, 255).astype(np.uint8), (keys & np.uint64(shards - 1)).astype(np.int64)
                order = np.argsort(home, kind="stable")
                cuts = np.searchsorted(home[order], np.arange(shards + 1))
                here = np.flatnonzero(np.diff(cuts))
                rows = [order[cuts[s]:cuts[s + 1]] for s in here]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(here, pa.int64()), pa.array([block] * len(here), pa.int64()),
                     pa.array([keys[r].tobytes() for r in rows], pa.binary()), pa.array([times[r].tobytes() for r in rows], pa.binary())],
                    names=["shard", "block", "keys", "times"])

    def answer(t):
        keys = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in t["keys"]]
        times = np.concatenate([np.frombuffer(x.as_buffer(), dtype=np.uint8) for x in t["times"]])
        every, ends = np.concatenate(keys), np.cumsum([len(k) for k in keys])
        order = np.argsort(every)
        group = np.cumsum(np.concatenate([[0], every[order][1:] != every[order][:-1]]))
        total = np.empty(len(every), dtype=np.uint8)
        total[order] = np.minimum(np.bincount(group, weights=times[order]), 255).astype(np.uint8)[group]
        return pa.table({"block": t["block"], "shard": t["shard"],
                         "counts": pa.array([x.tobytes() for x in np.split(total, ends[:-1])], pa.binary())})

    asked = blocks.select("block", "docs").mapInArrow(ask, "shard long, block long, keys binary, times binary")
    return asked.groupBy("shard").applyInArrow(answer, "block long, shard long, counts binary")


def signatures(blocks: DataFrame, shards: int, words: int, percent: int) -> DataFrame:
    """``doc_id, n`` for every document, and for those that may have a partner ``key`` (of the set), ``prefix`` and ``grams``."""
    def run(docs, answers):
        batch = S.unpack(docs["docs"][0])
        doc, gram, n, part = _counted(batch, words, percent)
        keys, at = np.unique(gram[part], return_inverse=True)
        home, count = keys & np.uint64(shards - 1), np.zeros(len(keys), dtype=np.int64)
        for s, c in zip(answers["shard"].to_pylist(), answers["counts"]):
            count[home == np.uint64(s)] = np.frombuffer(c.as_buffer(), dtype=np.uint8)
        if len(count) and not count.min():
            raise RuntimeError("a shard's answer is missing")
        pdoc, pgram, pcount = doc[part], gram[part], count[at]
        need = spare(-(-percent * n // 100))
        alive = np.bincount(pdoc, weights=pcount > 1, minlength=len(n)) >= need
        order = np.lexsort((pgram, pcount, pdoc))
        pdoc, pgram, pcount = pdoc[order], pgram[order], pcount[order]
        size = np.bincount(pdoc, minlength=len(n))
        used = (ranks(pdoc, size) < (size - need + 1)[pdoc]) & (pcount > 1) & alive[pdoc]
        alive &= np.bincount(pdoc[used], minlength=len(n)) > 0

        def lists(owner, values):
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(n)))])
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.view(np.int64)), mask=pa.array(~alive))
        import hashlib

        ends = np.concatenate([[0], np.cumsum(n)])
        own = [hashlib.blake2b(gram[a:b].tobytes(), digest_size=16).digest() if ok else None
               for a, b, ok in zip(ends[:-1], ends[1:], alive)]
        keep = alive[doc]
        # Parity of the n-grams that fall to each of BITS bits: two sets differ in at least as many as their bits do.
        row, bit = np.cumsum(alive) - 1, (gram[keep] >> np.uint64(24)) & np.uint64(BITS - 1)
        odd = np.bincount(row[doc[keep]] * BITS + bit.astype(np.int64), minlength=int(alive.sum()) * BITS) & 1
        parity = np.packbits(odd.astype(np.uint8)).view(np.uint64)
        return pa.table({"doc_id": batch["doc_id"].cast(pa.int64()), "n": pa.array(n), "key": pa.array(own, pa.binary()),
                         "prefix": lists(pdoc[used], pgram[used]), "grams": lists(doc[keep], gram[keep]),
                         "parity": lists(np.repeat(np.flatnonzero(alive), BITS // 64), parity)})

    counts = gram_counts(blocks, shards, words, percent)
    return (blocks.select("block", "docs").groupBy("block").cogroup(counts.groupBy("block"))
            .applyInArrow(run, "doc_id long, n long, key binary, prefix array<long>, grams array<long>, parity array<long>"))


def fits(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def near_parity(a: Column, b: Column, n: Column, percent: int) -> Column:
    """Whether two sets of ``n`` n-grams in all may be similar enough, by the bits in which their parities differ."""
    apart = sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(BITS // 64)), F.lit(0))
    return apart * (100 + percent) <= (100 - percent) * n


def may_be_near(i: str, j: str, percent: int) -> Column:
    """:func:`near_parity` for any member of group ``i`` and any of ``j``: a bit that all members of one have and none of the other
    differs in every pair of them. For groups of one it is the test of their pair."""
    bit = lambda name, k: F.get(name, F.lit(k))
    only = lambda a, b, k: bit("every" + a, k).bitwiseAND(F.bitwise_not(bit("some" + b, k)))
    apart = sum((F.bit_count(only(i, j, k).bitwiseOR(only(j, i, k))) for k in range(BITS // 64)), F.lit(0))
    return apart * (100 + percent) <= (100 - percent) * (F.col("n" + i) + F.col("n" + j))


def verified(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of the pairs ``(a, b)`` of classes those whose whole sets are similar enough.

    Up to ``MOST_BROADCAST`` pairs (16 bytes each) are sent to all tasks to pick the sets they need; more are shuffled to them."""
    near = F.broadcast if pairs.count() <= MOST_BROADCAST else (lambda x: x)
    sets = classes.select("cls", "grams")
    a = sets.join(near(pairs), F.col("cls") == F.col("a")).select("a", "b", F.col("grams").alias("grams_a"))
    b = sets.join(near(pairs.select("b").distinct()), F.col("cls") == F.col("b")).select("b", F.col("grams").alias("grams_b"))
    both = F.size(F.array_intersect("grams_a", "grams_b"))
    return a.join(b, "b").where(100 * both >= percent * (F.size("grams_a") + F.size("grams_b") - both)).select("a", "b")


def rows_of_classes(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``members (gid, cls, n)`` of the groups, and ``index (gram, gid, n)`` of the n-grams that two groups or more have."""
    alike = classes.groupBy(F.xxhash64("prefix").alias("p"), "n").agg(F.min("cls").alias("gid"))
    members = checkpoint(classes.select("cls", "n", F.xxhash64("prefix").alias("p")).join(alike, ["p", "n"]).select("gid", "cls", "n"))
    heads = members.where("gid = cls").select("gid")
    every = checkpoint(classes.join(heads, F.col("cls") == F.col("gid")).select("gid", "n", F.explode("prefix").alias("gram")))
    shared = every.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("gram")
    index = checkpoint(every.join(shared, "gram"))
    discard(every)
    return members, index


def still_apart(open_: DataFrame, turn: int) -> DataFrame:
    """N-grams whose groups lie in several components: ``gram``, a ``centre``, its ``rows`` and its ``pairs`` of groups that do."""
    parts = open_.groupBy("gram", "lo").agg(
        F.count(F.lit(1)).alias("c"), F.max("hi").alias("hi"), F.min(F.struct(F.xxhash64("gid", F.lit(turn)), "gid", "n", "lo", "hi")).alias("centre"))
    return parts.groupBy("gram").agg(
        F.min("lo").alias("l"), F.max("hi").alias("h"), F.min("centre").alias("centre"), F.sum("c").alias("rows"),
        ((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("pairs")).where("l <> h").drop("l", "h")


def group_pairs(heads: DataFrame, percent: int) -> DataFrame:
    """``gid1, gid2, lone``: pairs of groups of ``heads (gram, gid, n, lo, hi, m, every, some)`` that share an n-gram and may
    have members that are similar enough; ``every`` and ``some`` are the parity bits that all or any of a group's members have.

    Near copies share most of their n-grams, but a pair is wanted once: a row holds the ``EARLIER`` n-grams before its own (in order of
    hash) of its group, and two rows that have one of these in common leave the pair to that one. The first n-gram that two groups
    share gives their pair whatever lies before it, so none is lost; few come twice."""
    w = Window.partitionBy("gid").orderBy("gram")
    heads = heads.withColumn("before", F.array_compact(F.array(*[F.lag("gram", i).over(w) for i in range(1, EARLIER + 1)])))
    x, y = [heads.select("gram", *[F.col(c).alias(c + i) for c in ("gid", "n", "lo", "hi", "m", "every", "some", "before")]) for i in "12"]
    lone = (F.col("m1") == 1) & (F.col("m2") == 1)  # a group of one is its head
    return x.join(y, "gram").where(
        (F.col("gid1") < F.col("gid2")) & fits(F.col("n1"), F.col("n2"), percent)
        & ~((F.col("lo1") == F.col("hi2")) & (F.col("hi1") == F.col("lo2")))
        & ~F.arrays_overlap("before1", "before2") & may_be_near("1", "2", percent)
    ).select("gid1", "gid2", lone.alias("lone"))


def last_pairs(open_: DataFrame, own: DataFrame, placed: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes ``(a, b)`` in different components whose groups share an n-gram, or that are one group, and whose sizes and
    parities allow a link."""
    parity = classes.select("cls", "parity")
    bits = placed.join(parity, "cls").groupBy("gid").agg(*[F.array(*[f(F.get("parity", F.lit(k))) for k in range(BITS // 64)]).alias(name)
                                                            for f, name in ((F.bit_and, "every"), (F.bit_or, "some"))])
    groups = group_pairs(open_.join(bits, "gid"), percent).distinct()
    same = own.where("lo <> hi").select(F.col("gid").alias("gid1"), F.col("gid").alias("gid2"), F.lit(False).alias("lone"))
    groups = checkpoint(groups.union(same))
    one, two = [placed.join(parity, "cls").select(F.col("gid").alias("gid" + i), F.col("cls").alias(c), F.col("comp").alias("comp" + i),
                                                  F.col("n").alias("n" + i), F.col("parity").alias("parity" + i))
                for i, c in (("1", "a"), ("2", "b"))]
    more = groups.where("not lone").drop("lone").join(one, "gid1").join(two, "gid2").where(
        (F.col("comp1") != F.col("comp2")) & ((F.col("gid1") != F.col("gid2")) | (F.col("a") < F.col("b")))
        & near_parity(F.col("parity1"), F.col("parity2"), F.col("n1") + F.col("n2"), percent)).select("a", "b")
    pairs = checkpoint(groups.where("lone").select(F.col("gid1").alias("a"), F.col("gid2").alias("b")).union(more))
    discard(groups)
    return pairs


def class_components(classes: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """``cls, comp`` for all ``classes (cls, n, prefix, grams, parity)``; ``known (a, b)`` are links given beforehand.

    Components only merge, so an n-gram whose groups are all in one is done: each round goes on with the index rows of the others."""
    members, index = rows_of_classes(classes)
    links, comp, before = [known], checkpoint(members.select("cls", F.col("cls").alias("comp"))), float("inf")
    for turn in range(ROUNDS + 1):
        placed = members.join(comp, "cls")
        own = checkpoint(placed.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("m")))
        open_ = index.join(own, "gid")
        split = checkpoint(still_apart(open_, turn))
        work = split.agg(F.sum("pairs").alias("pairs"), F.sum("rows").alias("rows")).first()
        last = not work["rows"] or work["pairs"] <= FEW_PAIRS * work["rows"] or 2 * work["pairs"] > before or turn == ROUNDS
        before = work["pairs"]
        left = checkpoint(index.join(split.select("gram"), "gram", "left_semi"))
        discard(index)
        index, open_ = left, left.join(own, "gid")
        if last:
            pairs = last_pairs(open_, own, placed, classes, percent)
        else:  # the centre of each shared n-gram with its groups, and the head of each group with its members
            star = open_.join(split.select("gram", "centre"), "gram").where(
                (F.col("gid") != F.col("centre.gid")) & fits(F.col("n"), F.col("centre.n"), percent)
                & ~((F.col("lo") == F.col("centre.hi")) & (F.col("hi") == F.col("centre.lo")))).select(
                F.least("centre.gid", "gid").alias("a"), F.greatest("centre.gid", "gid").alias("b"))
            if turn == 0:
                star = star.union(members.where("gid <> cls").select("gid", "cls"))
            pairs = checkpoint(star.distinct())
        found = checkpoint(verified(pairs, classes, percent))
        links.append(found)
        named = components(reduce(DataFrame.union, links))
        now = checkpoint(members.select("cls").join(named, F.col("cls") == F.col("node"), "left").select("cls", F.coalesce("component", "cls").alias("comp")))
        discard(comp, own, split, pairs, named)
        comp = now
        if last:
            discard(index, members, *links[1:])
            return comp


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs (doc_id, text)``."""
    blocks = S.pack_blocks(docs, ["doc_id", "text"])
    shards = S.shards_for(blocks, 16 << 20)
    sig = checkpoint(signatures(blocks, shards, words, percent).withColumn("row", F.monotonically_increasing_id()))
    discard(blocks)
    # A class is a set; its number is the stored row of one of its documents.
    may = sig.where("key is not null and doc_id is not null").select("key", "doc_id", "row")
    named = checkpoint(may.groupBy("key").agg(F.min(F.struct("doc_id", "row")).alias("x")).select(
        "key", F.col("x.row").alias("cls"), F.col("x.doc_id").alias("low")))
    ids = checkpoint(sig.select("doc_id", "n", "key").join(named.select("key", "cls"), "key", "left").select(
        "doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("cls")).alias("cls")))
    # An id with several sets is one node.
    several = ids.where("cls is not null").groupBy("doc_id").agg(F.min("cls").alias("a"), F.max("cls").alias("z")).where("a <> z")
    known = checkpoint(ids.join(several.select("doc_id", "a"), "doc_id").where("cls <> a").select("a", F.col("cls").alias("b")).distinct())
    classes = checkpoint(sig.withColumnRenamed("row", "cls").join(named.select("cls"), "cls", "left_semi").select(
        "cls", "n", "prefix", "grams", "parity"))
    discard(sig)
    comp = class_components(classes, known, percent)
    discard(classes, known)
    low = comp.join(named.select("cls", "low"), "cls")
    low = low.join(low.groupBy("comp").agg(F.min("low").alias("component_id")), "comp").select("cls", "component_id")
    result = checkpoint(ids.join(low, "cls", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")))
    discard(named, ids, comp)
    return result


@register("op10_ngram_jaccard")
def op10_ngram_jaccard(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
