"""Whole training runs as registered queries: two epochs over the ``benchmark`` texts, repeated step by step in recursive SQL.

The runs use one shard, so that the average over shards is the shard's own value; rounds, rates, draws and the rounding of a
round's result to single precision are those of any run.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from twinvec.functions.rand import uniform4_sql, uniform_sql
from twinvec.operators import corpus as C
from twinvec.plans import inputs as I
from twinvec.plans import sql as S
from twinvec.plans.catalog import NOISE_SQL, register

DIM, NEG_K, EPOCHS = 8, 3, 2
P = I.PARAMS.with_(shards=1, window_size=2)
ORACLE_DRAWS = 400


def _run(spark, sf_dir, tied: bool):
    from twinvec.operators.training import train

    def build():
        docs = I.table(spark, sf_dir, "benchmark").select("item_id", "text")
        _, vocab, enc, total = C.prepare_corpus(docs, P, "item_id")
        return train(enc, vocab, total, P, dim=DIM, epochs=EPOCHS, neg_k=NEG_K, tied=tied)
    return I._memo(spark, ("bench run", sf_dir, tied), build)


def _long(theta, which: int):
    return theta.select(F.lit(which).cast("long").alias("which"), "word_id", F.posexplode("vec").alias("slot", "v")).select(
        "which", "word_id", F.col("slot").cast("long").alias("slot"), F.round(F.col("v").cast("double"), 6).alias("v"))


def _epoch_sql(e: int) -> str:
    tn = f"({P.subsample} * (SELECT n FROM total))"
    keep = f"{uniform_sql(S.SEED, 'sub', str(e), 'g')} <= ((sqrt(freq / {tn}) + 1) * {tn} / freq)"
    width = f"(1 + floor({uniform_sql(S.SEED, 'win', str(e), 'c.k')} * {P.window_size}))"
    return f"""sent{e} AS (SELECT (row_number() OVER (ORDER BY g) - 1)::BIGINT AS k, word_id FROM encoded WHERE {keep}),
pairs{e} AS (SELECT c.k, o, c.word_id AS input_id, l.word_id AS label_id
  FROM sent{e} c JOIN range(-{P.window_size}, {P.window_size} + 1) offs(o) ON o <> 0 AND abs(o) <= {width}
  JOIN sent{e} l ON l.k = c.k + o AND l.k // {P.sentence_size} = c.k // {P.sentence_size})"""


_BATCHES = max(1, P.pairs_per_round // P.batch_size)
STREAM = f"""{S.ENCODED.replace('doc_id', 'item_id').replace('FROM documents', 'FROM benchmark')}, {NOISE_SQL},
{", ".join(_epoch_sql(e) for e in range(EPOCHS))},
stream AS ({" UNION ALL ".join(f"SELECT {e} AS e, row_number() OVER (ORDER BY k, o) - 1 AS pair_idx, k, input_id, label_id FROM pairs{e}"
                               for e in range(EPOCHS))}),
turn AS (SELECT *, pair_idx // {P.batch_size} AS batch_id, pair_idx // {P.batch_size} // {_BATCHES} AS r FROM stream),
rate AS (SELECT e, r, {P.learning_rate} * greatest({P.lr_floor}, 1 - {P.lr_decay} * (coalesce(sum(w) OVER (
    ORDER BY e, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / ((SELECT n FROM total)::DOUBLE * {float(EPOCHS)}))) AS lr
  FROM (SELECT e, r, count(DISTINCT k) AS w FROM turn GROUP BY e, r)),
span AS (SELECT word_id, lo, coalesce(lead(lo) OVER (ORDER BY lo), 2) AS hi FROM cdf),
theta0 AS (SELECT word_id, slot, ((({uniform_sql(S.SEED, 'init', 'word_id', 'slot')}) - 0.5) / {DIM})::FLOAT::DOUBLE AS v FROM vocab, range({DIM}) t(slot))"""

UNTIED_SQL = f"""WITH RECURSIVE {STREAM},
draws AS (SELECT e, r, pair_idx, input_id, label_id, d, {uniform4_sql(S.SEED, 'negp', 'e', 'pair_idx', draw_sql='d')} AS u
  FROM turn, range({NEG_K}) t(d)),
targets AS (SELECT e, r, pair_idx, input_id, d, span.word_id AS t, 0.0::DOUBLE AS y FROM draws JOIN span ON u >= lo AND u < hi
    WHERE span.word_id <> label_id
  UNION ALL SELECT e, r, pair_idx, input_id, {NEG_K}, label_id, 1.0::DOUBLE FROM turn),
grouped AS (SELECT e, r, pair_idx, input_id + 1 AS i, list({{'t': t + 1, 'y': y}} ORDER BY d) AS targets FROM targets GROUP BY ALL),
steps AS (SELECT row_number() OVER (ORDER BY e, pair_idx) AS s, i, targets, lr,
    lead(r) OVER (ORDER BY e, pair_idx) IS DISTINCT FROM r OR lead(e) OVER (ORDER BY e, pair_idx) IS DISTINCT FROM e AS round_ends
  FROM grouped JOIN rate USING (e, r)),
run(s, w_in, w_out) AS (
  SELECT 0::BIGINT, list(v ORDER BY word_id), list(list_transform(v, lambda x: 0.0::DOUBLE) ORDER BY word_id)
  FROM (SELECT word_id, list(v ORDER BY slot) AS v FROM theta0 GROUP BY word_id)
  UNION ALL
  SELECT s, CASE WHEN round_ends THEN list_transform(w_in, lambda w: w::FLOAT[]::DOUBLE[]) ELSE w_in END,
    CASE WHEN round_ends THEN list_transform(w_out, lambda w: w::FLOAT[]::DOUBLE[]) ELSE w_out END
  FROM (SELECT s, round_ends, moved.w AS w_out,
      list_transform(w_in, lambda w, j: CASE WHEN j = i THEN list_transform(w, lambda a, c: a + moved.m[c]) ELSE w END) AS w_in
    FROM (SELECT s, round_ends, i, w_in, list_reduce(targets, lambda acc, g: {{
          'w': list_transform(acc.w, lambda o, j: CASE WHEN j = g.t
            THEN list_transform(o, lambda a, c: a + lr * (g.y - 1 / (1 + exp(-list_inner_product(o, x)))) * x[c]) ELSE o END),
          'm': list_transform(acc.m, lambda a, c: a + lr * (g.y - 1 / (1 + exp(-list_inner_product(acc.w[g.t], x)))) * acc.w[g.t][c])}},
        {{'w': w_out, 'm': list_transform(range({DIM}), lambda c: 0.0::DOUBLE)}}) AS moved
      FROM (SELECT st.*, run.w_in, run.w_out, run.w_in[st.i] AS x FROM run JOIN steps st ON st.s = run.s + 1))))
SELECT which::BIGINT AS which, word_id::BIGINT AS word_id, slot::BIGINT AS slot, round(w[word_id + 1][slot + 1], 6) AS v
FROM (SELECT 0 AS which, w_in AS w FROM run WHERE s = (SELECT max(s) FROM run) UNION ALL SELECT 1, w_out FROM run WHERE s = (SELECT max(s) FROM run)),
  range((SELECT count(*) FROM vocab)) a(word_id), range({DIM}) b(slot)"""


@register("train_untied", UNTIED_SQL)
def train_untied_q(spark, sf_dir):
    """Two epochs of the untied step, both matrices."""
    st = _run(spark, sf_dir, False)
    return _long(st.theta, 0).unionByName(_long(st.theta_out, 1))


TIED_SQL = f"""WITH RECURSIVE {STREAM},
bt AS (SELECT DISTINCT e, r, batch_id FROM turn),
draws AS (SELECT e, batch_id, d, {uniform4_sql(S.SEED, 'neg', 'e', 'batch_id', draw_sql='d')} AS u FROM bt, range({ORACLE_DRAWS}) t(d)),
firsts AS (SELECT e, batch_id, word_id, min(d) AS d FROM draws JOIN span ON u >= lo AND u < hi GROUP BY ALL),
steps AS (SELECT row_number() OVER (ORDER BY e, batch_id) AS s, e, batch_id, lr,
    lead(r) OVER (ORDER BY e, batch_id) IS DISTINCT FROM r OR lead(e) OVER (ORDER BY e, batch_id) IS DISTINCT FROM e AS round_ends
  FROM bt JOIN rate USING (e, r)),
negs AS (SELECT s, word_id FROM (SELECT *, row_number() OVER (PARTITION BY e, batch_id ORDER BY d) AS n FROM firsts) JOIN steps USING (e, batch_id) WHERE n <= {NEG_K}),
own AS (SELECT s, pair_idx, input_id, label_id, count(*) OVER (PARTITION BY s) AS b FROM turn JOIN steps USING (e, batch_id)),
links AS (SELECT s, input_id AS i, label_id AS j, 1.0 AS y, b FROM own
  UNION ALL SELECT own.s, input_id, word_id, 0.0, b FROM own JOIN negs USING (s)),
run(s, w) AS (
  SELECT 0::BIGINT, list(v ORDER BY word_id) FROM (SELECT word_id, list(v ORDER BY slot) AS v FROM theta0 GROUP BY word_id)
  UNION ALL
  SELECT s, CASE WHEN round_ends THEN list_transform(w, lambda x: x::FLOAT[]::DOUBLE[]) ELSE w END
  FROM (SELECT st.s, st.round_ends, list_transform(run.w, lambda x, n: list_transform(x, lambda a, c: a - st.lr * coalesce(list_sum(
      list_transform(list_filter(g.moves, lambda m: m.n = n), lambda m: m.v[c])), 0))) AS w
    FROM run JOIN steps st ON st.s = run.s + 1 JOIN (
      SELECT s, list(m) AS moves FROM (
        SELECT s, unnest([{{'n': i + 1, 'v': list_transform(wj, lambda a, c: f * (CASE WHEN c % 2 = 1 THEN -a ELSE a END))}},
                          {{'n': j + 1, 'v': list_transform(wi, lambda a, c: f * (CASE WHEN c % 2 = 1 THEN -a ELSE a END))}}]) AS m
        FROM (SELECT l.s, l.i, l.j, r2.w[l.i + 1] AS wi, r2.w[l.j + 1] AS wj,
            (1 / (1 + exp(-list_inner_product(r2.w[l.i + 1], list_transform(r2.w[l.j + 1], lambda a, c: CASE WHEN c % 2 = 1 THEN -a ELSE a END)))) - l.y) / l.b AS f
          FROM run r2 JOIN links l ON l.s = r2.s + 1)) GROUP BY s) g ON g.s = st.s))
SELECT word_id::BIGINT AS word_id, slot::BIGINT AS slot, round(w[word_id + 1][slot + 1], 6) AS v
FROM (SELECT w FROM run WHERE s = (SELECT max(s) FROM run)), range((SELECT count(*) FROM vocab)) a(word_id), range({DIM}) b(slot)"""


@register("train_tied", TIED_SQL)
def train_tied_q(spark, sf_dir):
    """Two epochs of the tied step."""
    return _long(_run(spark, sf_dir, True).theta, 0).drop("which")
