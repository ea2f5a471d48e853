"""Next-tag evaluation.

A softmax regression reads the unit vector of the current word and predicts the tag of the
next word. For documents the data set is built in one pass over the text: ids and tags are arrays from where the text lies, a
token's next tag is the next array element, and a document's last token takes the first tag of the next document that has tokens
(:func:`next_tag_documents`). A table of tagged tokens is shifted by an equi self-join on ``g + 1`` (no window over the
whole corpus). Words without an id are dropped, the first ``floor(0.8 n)`` rows train and
the rest test. The reference fits with 101 epochs of minibatch SGD; the model is convex, so
Spark ML's distributed L-BFGS fit reaches the same optimum family; we compare accuracies,
not weights.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinvec.functions.text import split_tokens
from twinvec.functions.vectors import l2_normalize, x_part, y_part
from twinvec.operators.joins import coded, lookup_arrays, lookup_join, stored_arrays
from twinvec.operators.ordering import dense_prefix, key_prefix, next_value
from twinvec.session import checkpoint

TRAIN_FRACTION = 0.8
# Fixed value: the reference's tagger batch size.
TAG_BATCH = 64


def rule_tag(w: F.Column) -> F.Column:
    """Stand-in tagger: PUNCT / SHORT / LONG / MID."""
    return (F.when(w.endswith(".") | w.endswith(","), "PUNCT").when(F.length(w) <= 3, "SHORT")
            .when(F.length(w) >= 9, "LONG").otherwise("MID"))


def rule_tags(tokens: DataFrame) -> DataFrame:
    """:func:`rule_tag` for a raw corpus ``tokens(g, word)`` (S3 input)."""
    return tokens.select("g", F.lower("word").alias("word"), rule_tag(F.col("word")).alias("tag"))


def next_tag_documents(docs: DataFrame, vocab: DataFrame, with_vector_ids: DataFrame | None = None, tag=rule_tag, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """E3, W4, P11, W6 for texts in ``id_col`` order (unique integers): the rows of :func:`next_tag_dataset`.

    Positions, the first tag of the next document and the split are worked out on a table of one row a document.
    """
    ids = vocab.select("word", "word_id")
    if with_vector_ids is not None:
        ids = ids.join(with_vector_ids.select("word_id"), "word_id", "left_semi")
    words = split_tokens(text_col)
    texts = docs.select(F.col(id_col).alias("_doc"), F.transform(words, tag).alias("tags"), F.transform(words, F.lower).alias("_w"))
    arrays = lookup_arrays(texts, "_w", ids, "ids")
    arrays = stored_arrays(arrays)
    per = arrays.select("_doc", F.size("ids").cast("long").alias("n"), F.size(F.filter("ids", lambda x: x.isNotNull())).cast("long").alias("known"),
                        F.element_at("ids", -1).isNotNull().alias("last_known"), F.get("tags", F.lit(0)).alias("first")).where("n > 0")
    per = checkpoint(next_value(per, "_doc", "first", "after"))
    per = per.withColumn("known", F.col("known") - (F.col("last_known") & F.col("after").isNull()).cast("long"))  # the last token has no next tag
    total = int(per.agg(F.sum("known")).first()[0] or 0)
    n_train = (total * 4) // 5  # floor(0.8 n) in exact integer arithmetic
    place = key_prefix(per, "_doc", {"off": F.col("n"), "known_off": F.col("known")}).select("_doc", "after", "off", "known_off")
    # A token travels as five bytes: its id and the number of its tag.
    narrow, tag_of = coded(arrays.select("_doc", F.col("ids").cast("array<int>").alias("ids"), "tags"), "tags")
    row = narrow.join(place, "_doc")
    here = F.transform("tags", tag_of)
    nexts = F.concat(F.slice(here, 2, F.size("tags")), F.array("after"))
    rows = F.transform(F.arrays_zip("ids", nexts.alias("tag")), lambda x, i: F.struct(i.alias("i"), x["ids"].cast("long").alias("word_id"), x["tag"].alias("tag")))
    rows = F.filter(rows, lambda x: x["word_id"].isNotNull() & x["tag"].isNotNull())
    out = row.select("off", "known_off", F.posexplode(rows).alias("p", "x"))
    pos = F.col("known_off") + F.col("p")
    return out.select((F.col("off") + F.col("x.i")).alias("g"), pos.alias("pos"), F.col("x.word_id").alias("word_id"), F.col("x.tag").alias("tag"),
                      F.when(pos < n_train, "train").otherwise("test").alias("split"))


def next_tag_dataset(tagged: DataFrame, vocab: DataFrame, with_vector_ids: DataFrame | None = None) -> DataFrame:
    """``(g, pos, word_id, tag, split)`` with the tag of the next token.

    ``with_vector_ids`` (a ``word_id`` column) restricts to words that have a vector.
    """
    nxt = tagged.select((F.col("g") - 1).alias("g"), F.col("tag").alias("next_tag"))
    shifted = tagged.select("g", "word").join(nxt, "g")           # the last token has no next tag
    ids = vocab.select("word", "word_id")
    if with_vector_ids is not None:
        ids = ids.join(with_vector_ids.select("word_id"), "word_id", "left_semi")
    known = checkpoint(lookup_join(shifted, ids, "word", how="inner"))   # unknown words dropped
    n = known.count()
    n_train = (n * 4) // 5  # floor(0.8 n) in exact integer arithmetic
    pos = dense_prefix(known, "g", {"pos": F.lit(1).cast("long")})
    return pos.select("g", "pos", "word_id", F.col("next_tag").alias("tag"),
                      F.when(F.col("pos") < n_train, "train").otherwise("test").alias("split"))


def batch_of(pos: F.Column, n: int, batch: int = TAG_BATCH) -> F.Column:
    """NumPy ``array_split`` of ``n`` rows into ``max(1, n // batch)`` near-equal parts."""
    parts = max(1, n // batch)
    base, extra = divmod(n, parts)
    big = extra * (base + 1)
    return F.when(pos < big, (pos / F.lit(base + 1)).cast("long")).otherwise(
        (F.lit(extra) + (pos - F.lit(big)) / F.lit(max(base, 1))).cast("long"))


def unit_features(emb: DataFrame, kind: str) -> DataFrame:
    col = {"w": F.col("vec"), "x": x_part("vec"), "y": y_part("vec")}[kind]
    return emb.select("word_id", array_to_vector(l2_normalize(col)).alias("features"))


def tag_cells(data: DataFrame) -> DataFrame:
    """``word_id, tag, split, n, batch_share``: the rows of a data set by what the model sees of them, stored.

    All rows of a cell have the same features and label, so a weighted fit on the cells is the fit on the rows; there are at most
    words x tags x 2 of them, however long the corpus. ``batch_share`` adds up one over the size of each training row's batch.
    """
    n_train = data.where(F.col("split") == "train").count()
    parts = max(1, n_train // TAG_BATCH)
    base, extra = divmod(n_train, parts)
    share = F.when(F.col("pos") < extra * (base + 1), F.lit(1.0 / (base + 1))).otherwise(F.lit(1.0 / max(base, 1)))
    return checkpoint(data.groupBy("word_id", "tag", "split").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("split") == "train", share).otherwise(0.0)).alias("batch_share")))


def tag_report(judged: DataFrame, kind: str) -> DataFrame:
    """``kind, split, n, accuracy, mean_cost, ref_cost`` of cells with ``hit`` and ``cost``. ``mean_cost`` is the true mean cross-entropy;
    ``ref_cost`` is the sum of the batch means divided by the training rows, which the reference prints (about 1/64 of it)."""
    rows = F.sum("n")
    out = judged.groupBy("split").agg(
        rows.alias("n"), (F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)) / rows).alias("accuracy"), (F.sum(F.col("n") * F.col("cost")) / rows).alias("mean_cost"),
        F.when(F.first("split") == "train", F.sum(F.col("batch_share") * F.col("cost")) / rows).alias("ref_cost"))
    return out.select(F.lit(kind).alias("kind"), "split", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "mean_cost", "ref_cost")])


def tag_accuracy(data: DataFrame, emb: DataFrame, kinds=("y", "x", "w"), max_iter: int = 100) -> DataFrame:
    """Multinomial softmax regression per vector kind; accuracy, true mean cost and
    the reference's ``ref_cost`` per (kind, split). ``data`` needs ``pos`` (0-based row order)."""
    cells = tag_cells(data)
    indexer = StringIndexer(inputCol="tag", outputCol="label", stringOrderType="alphabetAsc").fit(cells)
    labeled = indexer.transform(cells).withColumn("weight", F.col("n").cast("double"))
    rows = []
    for kind in kinds:
        feats = labeled.join(unit_features(emb, kind), "word_id")
        lr = LogisticRegression(family="multinomial", regParam=0.0, maxIter=max_iter, standardization=False, weightCol="weight")
        pred = lr.fit(feats.where(F.col("split") == "train")).transform(feats)
        # Probability of the true tag.
        p_true = F.element_at(vector_to_array("probability"), (F.col("label") + 1).cast("int"))
        rows.append(tag_report(pred.select("split", "n", "batch_share", (F.col("prediction") == F.col("label")).alias("hit"),
                                           (-F.log(F.greatest(p_true, F.lit(1e-300)))).alias("cost")), kind))
    return reduce(DataFrame.unionByName, rows)


def tag_cost(data: DataFrame, emb: DataFrame, weights: dict[str, list[float]], kind: str) -> DataFrame:
    """The same report for a softmax model with given ``weights`` (one row of numbers a tag, no bias); ties go to the first tag."""
    tags = sorted(weights)
    col = {"w": F.col("vec"), "x": x_part("vec"), "y": y_part("vec")}[kind]
    unit = emb.select("word_id", l2_normalize(col).alias("u"))
    scores = [F.aggregate(F.zip_with("u", F.array(*[F.lit(float(x)) for x in weights[t]]), lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
              for t in tags]
    cells = tag_cells(data).join(unit, "word_id").withColumn("z", F.array(*scores))
    own = F.element_at("z", F.array_position(F.array(*[F.lit(t) for t in tags]), F.col("tag")).cast("int"))
    log_sum = F.array_max("z") + F.log(F.aggregate(F.transform("z", lambda v: F.exp(v - F.array_max("z"))), F.lit(0.0), lambda acc, v: acc + v))
    best = F.element_at(F.array(*[F.lit(t) for t in tags]), F.array_position("z", F.array_max("z")).cast("int"))
    return tag_report(cells.select("split", "n", "batch_share", (best == F.col("tag")).alias("hit"), (log_sum - own).alias("cost")), kind)
