"""DuckDB building blocks for the oracle SQL of the registered queries.

They restate each query's semantics in plain SQL over the driver's tables; nothing here
is used by the Spark side.
"""

from __future__ import annotations

from twinvec.functions.rand import uniform_sql
from twinvec.functions.text import BLANKS_REGEX_SQL  # noqa: F401 (re-exported)

MIN_COUNT = 5
SEED = 42

DOC_WORDS = f"""doc_ws AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{BLANKS_REGEX_SQL}'), lambda t: t <> '') AS ws
  FROM documents)"""

TOKENS = f"""{DOC_WORDS},
doc_off AS (
  SELECT doc_id, ws, coalesce(sum(len(ws)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM doc_ws),
tokens AS (
  SELECT off + i - 1 AS g, ws[i] AS word FROM doc_off, range(1, len(ws) + 1) r(i))"""

VOCAB = f"""{TOKENS},
counts AS (SELECT word, count(*) AS freq FROM tokens GROUP BY word),
vocab AS (
  SELECT (row_number() OVER (ORDER BY freq DESC, word ASC))::BIGINT AS word_id, word, freq::BIGINT AS freq
  FROM counts WHERE freq >= {MIN_COUNT}
  UNION ALL
  SELECT 0::BIGINT, 'UNK', coalesce(sum(freq) FILTER (WHERE freq < {MIN_COUNT}), 0)::BIGINT FROM counts)"""

ENCODED = f"""{VOCAB},
total AS (SELECT sum(freq)::BIGINT AS n FROM vocab),
unkf AS (SELECT freq AS uf FROM vocab WHERE word_id = 0),
encoded AS (
  SELECT t.g, coalesce(v.word_id, 0)::BIGINT AS word_id, coalesce(v.freq, (SELECT uf FROM unkf))::BIGINT AS freq
  FROM tokens t LEFT JOIN (SELECT * FROM vocab WHERE word_id >= 1) v ON t.word = v.word)"""


def kept_sql(threshold: float = 1e-3, epoch: int = 0) -> str:
    u = uniform_sql(SEED, "sub", str(epoch), "g")
    tn = f"({threshold} * (SELECT n FROM total))"
    p = f"((sqrt(freq / {tn}) + 1) * {tn} / freq)"
    return f"""{ENCODED},
kept AS (SELECT g, word_id FROM encoded WHERE {u} <= {p}),
sent AS (
  SELECT (row_number() OVER (ORDER BY g) - 1)::BIGINT AS k, g, word_id FROM kept)"""


def pairs_sql(window: int = 5, dynamic: bool = True, epoch: int = 0) -> str:
    width = f"(1 + floor({uniform_sql(SEED, 'win', str(epoch), 'c.k')} * {window}))" if dynamic else str(window)
    return f"""{kept_sql(epoch=epoch)},
cent AS (SELECT k, k // 1000 AS sid, k % 1000 AS i, word_id FROM sent),
offs AS (SELECT o FROM range(-{window}, {window} + 1) r(o) WHERE o <> 0),
pairs AS (
  SELECT c.sid, c.i, c.i + o AS j, c.k, c.word_id AS input_id, l.word_id AS label_id
  FROM cent c JOIN offs ON abs(o) <= {width}
  JOIN cent l ON l.sid = c.sid AND l.i = c.i + o)"""


EMB = """emb AS (
  SELECT vec_id AS id, list_transform(embedding, lambda e: e::DOUBLE) AS w FROM embeddings),
parts AS (
  SELECT id, list_slice(w, 2, len(w), 2) AS x, list_slice(w, 1, len(w), 2) AS y FROM emb),
normed AS (
  SELECT id, x, y, list_inner_product(x, x) AS sx, list_inner_product(y, y) AS sy FROM parts)"""

NEIGHBOR_PAIRS = f"""{EMB},
scored AS (
  SELECT q.id AS q, c.id AS id,
         list_inner_product(q.x, c.x) AS xx, list_inner_product(q.y, c.y) AS yy,
         sqrt(greatest(q.sx + q.sy, 1e-12)) * sqrt(greatest(c.sx + c.sy, 1e-12)) AS nw,
         sqrt(greatest(q.sx, 1e-12)) * sqrt(greatest(c.sx, 1e-12)) AS nx,
         sqrt(greatest(q.sy, 1e-12)) * sqrt(greatest(c.sy, 1e-12)) AS ny
  FROM normed q, normed c),
panels AS (
  SELECT q, id, 'near_w' AS panel, round((xx + yy) / nw, 6) AS score FROM scored UNION ALL
  SELECT q, id, 'near_x', round(xx / nx, 6) FROM scored UNION ALL
  SELECT q, id, 'near_y', round(yy / ny, 6) FROM scored UNION ALL
  SELECT q, id, 'far_y', round(-(yy / ny), 6) FROM scored UNION ALL
  SELECT q, id, 'context', round(xx - yy, 6) FROM scored UNION ALL
  SELECT q, id, 'dot_w', round(xx + yy, 6) FROM scored UNION ALL
  SELECT q, id, 'dot_x', round(xx, 6) FROM scored UNION ALL
  SELECT q, id, 'dot_y', round(-yy, 6) FROM scored),
ranked AS (
  SELECT q, panel, (row_number() OVER (PARTITION BY q, panel ORDER BY score DESC, id ASC))::BIGINT AS rank, id, score
  FROM panels)"""


def panel_sql(panel: str, k: int) -> str:
    return f"""WITH {NEIGHBOR_PAIRS}
SELECT q, rank, id AS vec_id, score FROM ranked WHERE panel = '{panel}' AND rank <= {k}"""


def cos_sql(kind: str, p: str, c: str) -> str:
    """Cosine of the ``kind`` part between two ``normed`` rows aliased ``p`` and ``c``."""
    if kind == "w":
        num = f"(list_inner_product({p}.x, {c}.x) + list_inner_product({p}.y, {c}.y))"
        den = f"(sqrt(greatest({p}.sx + {p}.sy, 1e-12)) * sqrt(greatest({c}.sx + {c}.sy, 1e-12)))"
    else:
        s = "sx" if kind == "x" else "sy"
        num = f"list_inner_product({p}.{kind}, {c}.{kind})"
        den = f"(sqrt(greatest({p}.{s}, 1e-12)) * sqrt(greatest({c}.{s}, 1e-12)))"
    return f"({num} / {den})"


QUESTIONS = """qs AS (
  SELECT vec_id // 3 AS qid, vec_id AS a, vec_id + 1 AS b, vec_id + 2 AS c,
         CASE WHEN (vec_id // 3) % 3 = 0 THEN vec_id + 2 ELSE vec_id + 3 END AS d
  FROM embeddings WHERE vec_id % 3 = 0)"""

_COS_COLS = ",\n         ".join(f"{cos_sql(k, 'n' + s, 'v')} AS {s}_{k}" for s in "abc" for k in "wxy")

ANALOGY_SCORED = f"""{EMB},
{QUESTIONS},
sc AS (
  SELECT q.qid, q.a, q.b, q.c, q.d, v.id,
         {_COS_COLS}
  FROM qs q JOIN normed na ON na.id = q.a JOIN normed nb ON nb.id = q.b JOIN normed nc ON nc.id = q.c
  CROSS JOIN normed v),
apanels AS (
  {" UNION ALL ".join(
      f"SELECT qid, id, '{side}_{k}' AS panel, round({'' if side == 'near' else '-'}(c_{k} + b_{k} - a_{k}), 6) AS score FROM sc"
      for side in ("near", "far") for k in "wxy")}),
aranked AS (
  SELECT qid, panel, (row_number() OVER (PARTITION BY qid, panel ORDER BY score DESC, id ASC))::BIGINT AS rank, id, score
  FROM apanels)"""

GOOD_QUESTIONS = """good AS (
  SELECT * FROM qs WHERE a IN (SELECT id FROM normed) AND b IN (SELECT id FROM normed)
                     AND c IN (SELECT id FROM normed) AND d IN (SELECT id FROM normed))"""


def objectives_sql() -> str:
    parts = []
    for k in "wxy":
        parts.append(f"SELECT qid, d, id, 'add' AS method, '{k}' AS kind, round(c_{k} + b_{k} - a_{k}, 6) AS score FROM sc2")
        parts.append(f"SELECT qid, d, id, 'mul', '{k}', round((((b_{k} + 1) / 2) * ((c_{k} + 1) / 2)) / (((a_{k} + 1) / 2) + 0.001), 6) FROM sc2")
    return f"""WITH {ANALOGY_SCORED},
{GOOD_QUESTIONS},
sc2 AS (SELECT * FROM sc WHERE qid IN (SELECT qid FROM good) AND id NOT IN (a, b, c)),
obj AS ({" UNION ALL ".join(parts)}),
best AS (SELECT qid, d, method, kind, id, row_number() OVER (PARTITION BY qid, method, kind ORDER BY score DESC, id ASC) AS r FROM obj)"""
