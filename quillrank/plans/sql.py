"""What each query must equal, as SQL over the same tables.

``BASE`` names the canonical model; each query adds its own part.
"""

from __future__ import annotations

from ..functions.text import STOPWORDS
from ..operators.bootstrap import POISSON

STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def toks(c: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{N}}_]+'), lambda x: length(x) > 1 AND x NOT IN ({STOP}))"


BASE = f"""
WITH ev AS (SELECT event_id, ts, user_id, event_type, epoch_us(ts) // 259200000000 AS w,
              CAST(nullif(regexp_extract(props, '"k":\\s*(\\d+)', 1), '') AS BIGINT) AS article_id FROM events),
imp0 AS (SELECT user_id, w, min(ts) AS t0 FROM ev GROUP BY ALL),
imp AS (SELECT imp0.*, CASE WHEN t0 >= m - INTERVAL 6 DAYS THEN 'test' WHEN t0 >= m - INTERVAL 12 DAYS THEN 'validation' WHEN t0 IS NOT NULL THEN 'train' END AS split
        FROM imp0, (SELECT max(t0) AS m FROM imp0)),
cand0 AS (SELECT user_id, w, article_id, min(ROW(ts, event_id)) AS f, max(CAST(event_type = 'click' AS INT)) AS y FROM ev GROUP BY user_id, w, article_id),
cand AS (SELECT user_id, w, article_id, y, row_number() OVER (PARTITION BY user_id, w ORDER BY f) - 1 AS pos FROM cand0),
hist AS (SELECT imp.user_id, imp.w, c.article_id, row_number() OVER (PARTITION BY imp.user_id, imp.w ORDER BY c.ts DESC, c.event_id DESC) - 1 AS age
         FROM imp JOIN ev c ON imp.user_id = c.user_id AND c.event_type = 'click' AND c.ts < imp.t0),
val AS (SELECT cand.* FROM cand SEMI JOIN (SELECT * FROM imp WHERE split = 'validation') i ON cand.user_id = i.user_id AND cand.w = i.w),
past AS (SELECT hist.* FROM hist SEMI JOIN (SELECT * FROM imp WHERE split = 'validation') i ON hist.user_id = i.user_id AND hist.w = i.w),
clicks AS (SELECT article_id, count(*) AS clicks FROM cand SEMI JOIN (SELECT * FROM imp WHERE split = 'train') i ON cand.user_id = i.user_id AND cand.w = i.w
           WHERE y = 1 GROUP BY article_id),
nh AS (SELECT user_id, w, count(*) AS n_history FROM hist GROUP BY ALL),
art AS (SELECT doc_id AS article_id, substring(text, 1, 80) AS title, substring(text, 81) AS abstract, lang AS category, source AS subcategory,
          tp.topics, p.published
        FROM documents JOIN (SELECT doc_id AS d, (list_distinct_ordered)[1:5] AS topics FROM
             (SELECT doc_id, list_filter(t, lambda x, i: list_position(t, x) = i) AS list_distinct_ordered FROM (SELECT doc_id, {toks("substring(text, 1, 80)")} AS t FROM documents))) tp ON tp.d = doc_id
        LEFT JOIN (SELECT article_id AS a, min(ts) AS published FROM ev GROUP BY 1) p ON p.a = doc_id),
texts AS (SELECT doc_id AS article_id, text FROM documents),
vec AS (SELECT vec_id AS article_id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings),
vp AS (SELECT val.*, coalesce(c.clicks, 0) AS clicks, (SELECT greatest(coalesce(max(clicks), 1), 1) FROM clicks) AS most FROM val LEFT JOIN clicks c USING (article_id)),
lp AS (SELECT *, ln(1 + clicks) / ln(1 + most) AS lp FROM vp),
"""


def affinity(name: str, decay: float, last: int, columns: tuple[str, ...]) -> str:
    """CTE ``name``: user_id, w, kind, key, weight."""
    parts = []
    for c in columns:
        if c == "topics":
            parts.append(f"SELECT user_id, w, 'topics' AS kind, unnest(topics) AS key, pow({decay}::DOUBLE, age) AS p FROM past JOIN art USING (article_id) WHERE age < {last}")
        else:
            parts.append(f"SELECT user_id, w, '{c}' AS kind, coalesce({c}, '') AS key, pow({decay}::DOUBLE, age) AS p FROM past LEFT JOIN art USING (article_id) WHERE age < {last}")
    return f"{name} AS (SELECT user_id, w, kind, key, sum(p) AS weight FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL),\n"


def affinity_scores(name: str, weights: dict[str, float], normalize: bool) -> str:
    """CTE ``name``: user_id, w, pos, article_id, y, score."""
    joins, score = "", "0.15::DOUBLE * lp.lp"
    for i, (c, wt) in enumerate(weights.items()):
        joins += f" LEFT JOIN af a{i} ON a{i}.user_id = lp.user_id AND a{i}.w = lp.w AND a{i}.kind = '{c}' AND a{i}.key = coalesce(art.{c}, '')"
        joins += f" LEFT JOIN (SELECT user_id, w, max(weight) AS top FROM af WHERE kind = '{c}' GROUP BY ALL) t{i} ON t{i}.user_id = lp.user_id AND t{i}.w = lp.w"
        part = f"coalesce(a{i}.weight, 0)" + (f" / coalesce(t{i}.top, 1)" if normalize else "")
        score += f" + {wt}::DOUBLE * ({part})"
    return f"{name} AS (SELECT lp.user_id, lp.w, lp.pos, lp.article_id, lp.y, {score} AS score FROM lp LEFT JOIN art USING (article_id){joins}),\n"


def ranking(name: str, source: str) -> str:
    return f"{name} AS (SELECT user_id, w, pos, article_id, y, round(score, 6) AS score, row_number() OVER (PARTITION BY user_id, w ORDER BY round(score, 6) DESC, pos) AS rank FROM {source})"


RANKED = "SELECT user_id, w, pos, article_id, score, CAST(rank AS INT) AS rank FROM r"
BOTH = {"category": 1.0, "subcategory": 2.0}
AF = affinity("af", 0.85, 20, ("category", "subcategory"))
NORM = AF + affinity_scores("s", BOTH, True)
LOGPOP = "s AS (SELECT user_id, w, pos, article_id, y, 0.15::DOUBLE * lp AS score FROM lp),\n"
POP = "s AS (SELECT user_id, w, pos, article_id, y, CAST(clicks AS DOUBLE) AS score FROM vp),\n"


def users(name: str, decay: float, last: int) -> str:
    return f"""{name}d AS (SELECT user_id, w, dim, sum(x * p) AS x FROM (SELECT user_id, w, unnest(vector) AS x, generate_subscripts(vector, 1) AS dim, pow({decay}::DOUBLE, age) AS p
  FROM past JOIN vec USING (article_id) WHERE age < {last}) GROUP BY ALL),
{name} AS (SELECT user_id, w, list(x ORDER BY dim) AS v, greatest(sqrt(sum(x * x)), 1e-12) AS n FROM {name}d GROUP BY user_id, w),
"""


def semantic(name: str, decay: float, last: int) -> str:
    return users("uv", decay, last) + f"""{name} AS (SELECT val.user_id, val.w, val.pos, val.article_id, val.y, coalesce(list_inner_product(vec.vector, uv.v) / uv.n, 0) AS score
  FROM val LEFT JOIN vec USING (article_id) LEFT JOIN uv ON uv.user_id = val.user_id AND uv.w = val.w),
"""


HYBRID = AF + affinity_scores("base", BOTH, True) + semantic("sem", 0.85, 20) + """
s AS (SELECT b.user_id, b.w, b.pos, b.article_id, b.y, b.score + 0.25::DOUBLE * sem.score AS score FROM base b JOIN sem ON b.user_id = sem.user_id AND b.w = sem.w AND b.pos = sem.pos),
"""


def topic_fresh(missing: float) -> str:
    return affinity("af", 0.88, 30, ("category", "topics")) + f"""
tops AS (SELECT user_id, w, kind, max(weight) AS top FROM af GROUP BY ALL),
tsum AS (SELECT c.user_id, c.w, c.pos, sum(af.weight) AS s FROM (SELECT user_id, w, pos, unnest(topics) AS key FROM val JOIN art USING (article_id)) c
  JOIN af ON af.user_id = c.user_id AND af.w = c.w AND af.kind = 'topics' AND af.key = c.key GROUP BY ALL),
s AS (SELECT lp.user_id, lp.w, lp.pos, lp.article_id, lp.y,
   0.52::DOUBLE * coalesce(af.weight, 0) / coalesce(tc.top, 1) + 0.28::DOUBLE * (coalesce(tsum.s, 0) / (coalesce(tt.top, 1) * greatest(1, coalesce(len(art.topics), 0)))) + 0.12::DOUBLE * lp.lp
   + 0.08::DOUBLE * CASE WHEN art.published IS NULL THEN {missing}::DOUBLE ELSE exp(-greatest(CAST(epoch_us(imp.t0) - epoch_us(art.published) AS DOUBLE) / 3.6e9::DOUBLE, 0) / 96) END AS score
  FROM lp JOIN imp ON imp.user_id = lp.user_id AND imp.w = lp.w LEFT JOIN art USING (article_id)
  LEFT JOIN af ON af.user_id = lp.user_id AND af.w = lp.w AND af.kind = 'category' AND af.key = coalesce(art.category, '')
  LEFT JOIN tops tc ON tc.user_id = lp.user_id AND tc.w = lp.w AND tc.kind = 'category'
  LEFT JOIN tops tt ON tt.user_id = lp.user_id AND tt.w = lp.w AND tt.kind = 'topics'
  LEFT JOIN tsum ON tsum.user_id = lp.user_id AND tsum.w = lp.w AND tsum.pos = lp.pos),
"""


BM25 = f"""
tk AS (SELECT article_id, {toks("text")} AS ts FROM texts),
dl AS (SELECT article_id, len(ts) AS length FROM tk),
st AS (SELECT count(*) AS n_docs, greatest(avg(length), 1) AS mean_length FROM dl),
post AS (SELECT term, article_id, count(*) AS tf FROM (SELECT article_id, unnest(ts) AS term FROM tk) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df, ln(1 + (n_docs - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM post, st GROUP BY term, n_docs),
wp AS (SELECT term, article_id, idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean_length)) AS weight
       FROM post JOIN dfs USING (term) JOIN dl USING (article_id), st),
q AS (SELECT user_id, w, string_agg(coalesce(title, ''), ' ' ORDER BY age DESC) AS query FROM past LEFT JOIN art USING (article_id) WHERE age < 5 GROUP BY user_id, w),
qt AS (SELECT DISTINCT user_id, w, unnest({toks("query")}) AS term FROM q),
"""
TOP_BM25 = BM25 + """
sm AS (SELECT user_id, w, article_id, round(sum(weight), 6) AS score FROM qt JOIN wp USING (term) GROUP BY ALL),
fresh AS (SELECT sm.* FROM sm ANTI JOIN past p ON sm.user_id = p.user_id AND sm.w = p.w AND sm.article_id = p.article_id),
top AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id, w ORDER BY score DESC, article_id) AS INT) AS rank FROM fresh QUALIFY rank <= 200),
asked AS (SELECT user_id, w FROM q WHERE query <> ''),
"""
TOP_SEMANTIC = users("uv", 1.0, 1000000) + """
un AS (SELECT article_id, list_transform(vector, lambda x: x / greatest(sqrt(list_inner_product(vector, vector)), 1e-12)) AS vector FROM vec),
sc AS (SELECT uv.user_id, uv.w, un.article_id, CASE WHEN h.article_id IS NULL THEN round(list_inner_product(un.vector, uv.v) / uv.n, 6) END AS score
  FROM uv CROSS JOIN un LEFT JOIN (SELECT DISTINCT user_id, w, article_id FROM past) h ON h.user_id = uv.user_id AND h.w = uv.w AND h.article_id = un.article_id),
top AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id, w ORDER BY score IS NULL, score DESC, article_id) AS INT) AS rank FROM sc QUALIFY rank <= 200),
asked AS (SELECT user_id, w FROM uv),
"""


def recalled(method: str) -> str:
    cut = ", ".join(f"sum(CASE WHEN top.rank <= {k} THEN 1.0::DOUBLE ELSE 0 END) / count(*) AS r{k}" for k in (50, 100, 200))
    return f"""
each AS (SELECT c.user_id, c.w, {cut} FROM (SELECT val.* FROM val SEMI JOIN asked ON asked.user_id = val.user_id AND asked.w = val.w WHERE y = 1) c
  LEFT JOIN top ON top.user_id = c.user_id AND top.w = c.w AND top.article_id = c.article_id GROUP BY c.user_id, c.w),
sl AS (SELECT each.*, unnest(['all', CASE WHEN coalesce(n_history, 0) < 5 THEN 'cold_history_under_5' ELSE 'warm_history_5_or_more' END]) AS slice
  FROM each LEFT JOIN nh ON nh.user_id = each.user_id AND nh.w = each.w)
SELECT '{method}' AS method, slice, count(*) AS n, round(avg(r50), 6) AS recall_50, round(avg(r100), 6) AS recall_100, round(avg(r200), 6) AS recall_200 FROM sl GROUP BY slice
"""


def labelled(keys: str = "user_id, w") -> str:
    return f", l AS (SELECT * FROM r QUALIFY max(y) OVER (PARTITION BY {keys}) = 1)"


def auc(keys: str = "user_id, w", score: str = "score") -> str:
    return f""", mid AS (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY {score}) + (count(*) OVER (PARTITION BY {keys}, {score}) - 1) / 2 AS m FROM l),
auc AS (SELECT {keys}, round(CASE WHEN sum(y) * sum(1 - y) > 0 THEN CAST(sum(m * y) - sum(y) * (sum(y) + 1) / 2 AS DOUBLE) / CAST(sum(y) * sum(1 - y) AS DOUBLE) END, 6) AS auc FROM mid GROUP BY {keys})"""


def ndcg(keys: str = "user_id, w") -> str:
    part = lambda k: f"round(coalesce(sum(CASE WHEN rank <= {k} AND y = 1 THEN 1 / log2(rank + 1) ELSE 0 END) / CASE WHEN sum(y) > 0 THEN list_sum(list_transform(range(1, CAST(least(sum(y), {k}) AS BIGINT) + 1), lambda i: 1 / log2(i + 1))) END, 0), 6) AS ndcg_{k}"
    return f", ndcg AS (SELECT {keys}, {part(5)}, {part(10)} FROM l GROUP BY {keys})"


def mrr(keys: str = "user_id, w") -> str:
    return f", mrr AS (SELECT {keys}, round(coalesce(1 / min(CASE WHEN y = 1 THEN CAST(rank AS DOUBLE) END), 0), 6) AS mrr FROM l GROUP BY {keys})"


def spread(x: str) -> str:
    return f"SELECT count(x) AS n, count(DISTINCT x) AS n_distinct, CAST(min(x) AS DOUBLE) AS lowest, CAST(max(x) AS DOUBLE) AS highest, round(avg(CAST(x AS DOUBLE)), 6) AS mean, round(median(CAST(x AS DOUBLE)), 6) AS median FROM ({x})"


#: A list's draw for a replicate and the Poisson count it stands for, as in the bootstrap operators.
def mixed(seed: str, r: str) -> str:
    x = f"(({seed} + ({r} + 1) * 2654435769) & 4294967295)"
    for _ in range(2):
        x = f"((xor({x}, {x} >> 16) * 73244475) & 4294967295)"
    return f"xor({x}, {x} >> 16)"


SEED = "CAST(('0x' || substr(md5(user_id || '-' || w), 1, 8)) AS BIGINT) AS seed"
COUNT = f"len(list_filter({POISSON}, lambda x: x <= d))"
QUANTILES = "round(quantile_cont(m, 0.025), 6) AS ci95_low, round(quantile_cont(m, 0.975), 6) AS ci95_high"
NOVELTY = "round(avg(-log2(CAST(greatest(coalesce(c.clicks, 0), 1) AS DOUBLE) / (SELECT greatest(coalesce(sum(clicks), 0), 1) FROM clicks))), 6)"
DIVERSITY = """t10 AS (SELECT l.user_id, l.w, l.article_id, vec.vector FROM l LEFT JOIN vec USING (article_id) WHERE rank <= 10),
p10 AS (SELECT a.user_id, a.w, avg(1 - list_inner_product(a.vector, b.vector)) AS d FROM t10 a JOIN t10 b ON a.user_id = b.user_id AND a.w = b.w AND a.article_id < b.article_id AND a.vector IS NOT NULL AND b.vector IS NOT NULL GROUP BY ALL),
div AS (SELECT k.user_id, k.w, round(coalesce(p10.d, 0), 6) AS diversity FROM (SELECT DISTINCT user_id, w FROM t10) k LEFT JOIN p10 ON p10.user_id = k.user_id AND p10.w = k.w)"""
LABELLED = NORM + ranking("r", "s") + labelled()

METHODS = (
    AF + affinity_scores("base", BOTH, True) + semantic("sem", 0.85, 20)
    + """s AS (SELECT 'popularity' AS method, user_id, w, pos, article_id, y, CAST(clicks AS DOUBLE) AS score FROM vp
  UNION ALL SELECT 'affinity', user_id, w, pos, article_id, y, score FROM base
  UNION ALL SELECT 'hybrid', b.user_id, b.w, b.pos, b.article_id, b.y, b.score + 0.25::DOUBLE * sem.score FROM base b JOIN sem ON b.user_id = sem.user_id AND b.w = sem.w AND b.pos = sem.pos),
r AS (SELECT method, user_id, w, pos, article_id, y, round(score, 6) AS score, row_number() OVER (PARTITION BY method, user_id, w ORDER BY round(score, 6) DESC, pos) AS rank FROM s)"""
)
MK = "method, user_id, w"

SQL = {
    "store_impressions": BASE + """c AS (SELECT user_id, w, count(*) AS n_candidates, CAST(sum(y) AS BIGINT) AS n_clicked FROM cand GROUP BY ALL)
SELECT imp.user_id, imp.w, t0, split, n_candidates, n_clicked, coalesce(n_history, 0) AS n_history FROM imp LEFT JOIN c ON c.user_id = imp.user_id AND c.w = imp.w LEFT JOIN nh ON nh.user_id = imp.user_id AND nh.w = imp.w""",
    "store_split_counts": BASE + "z AS (SELECT 1) SELECT split, count(*) AS impressions FROM imp WHERE split IS NOT NULL GROUP BY split",
    "store_articles": BASE + "z AS (SELECT 1) SELECT article_id, category, subcategory, length(title) AS title_chars, length(abstract) AS abstract_chars, array_to_string(topics, ',') AS topics, published FROM art",
    "dedup_keep_first": BASE + "z AS (SELECT *, CAST(w % 2 <> 0 AS INT) AS o FROM ev WHERE article_id IS NOT NULL) SELECT article_id, CASE WHEN o = 0 THEN 'train' ELSE 'dev' END AS source_split, event_id FROM z QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY o, event_id) = 1",
    "dedup_keep_last": BASE + "z AS (SELECT *, CAST(w % 2 <> 0 AS INT) AS o FROM ev WHERE article_id IS NOT NULL) SELECT article_id, CASE WHEN o = 0 THEN 'train' ELSE 'dev' END AS source_split, event_id FROM z QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY o DESC, event_id DESC) = 1",
    "recency_weights_of_history": BASE + "z AS (SELECT 1) SELECT user_id, w, CAST(age AS INT) AS age, article_id, round(pow(0.8::DOUBLE, age), 6) AS weight FROM past",
    "newest_five": BASE + "z AS (SELECT 1) SELECT user_id, w, CAST(age AS INT) AS age, article_id FROM past WHERE age < 5",
    "parse_labelled_items": BASE + """i AS (SELECT event_id, (CASE WHEN event_id % 5 = 0 THEN 'A-' ELSE 'N' END) || article_id || (CASE WHEN event_id % 7 = 0 THEN '' WHEN event_type = 'click' THEN '-1' ELSE '-0' END) AS item FROM ev),
x AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN [item, '1', '-1'] ELSE [item] END AS items FROM i)
SELECT event_id, array_to_string(list_transform(items, lambda x: regexp_replace(x, '-[^-]*$', '')), '|') AS candidates,
  array_to_string(list_transform(list_filter(items, lambda x: x = '1' OR suffix(x, '-1')), lambda x: CASE WHEN contains(x, '-') THEN regexp_replace(x, '-[^-]*$', '') ELSE '' END), '|') AS clicked,
  CAST(len(list_filter(items, lambda x: x = '1' OR suffix(x, '-1'))) AS INT) AS n_clicked FROM x""",
    "parse_entities": BASE + "z AS (SELECT 1) SELECT event_id, CASE WHEN event_id % 3 = 1 THEN 'Q' || article_id || ',Q' || article_id ELSE '' END AS entities FROM ev",
    "popularity_click_counts": BASE + "z AS (SELECT 1) SELECT article_id, clicks FROM clicks",
    "rank_popularity": BASE + POP + ranking("r", "s") + " SELECT user_id, w, pos, article_id, CAST(rank AS INT) AS rank FROM r",
    "rank_log_popularity": BASE + LOGPOP + ranking("r", "s") + RANKED,
    "affinity_profile": BASE + affinity("af", 0.85, 20, ("category", "subcategory", "topics")) + "z AS (SELECT 1) SELECT user_id, w, kind, key, round(weight, 6) AS weight FROM af",
    "rank_affinity_raw": BASE + AF + affinity_scores("s", BOTH, False) + ranking("r", "s") + RANKED,
    "rank_affinity_norm": BASE + NORM + ranking("r", "s") + RANKED,
    "rank_category_history": BASE + AF + affinity_scores("s", {"category": 1.0}, True) + ranking("r", "s") + RANKED,
    "rank_topic_fresh": BASE + topic_fresh(0.0) + ranking("r", "s") + RANKED,
    "rank_topic_fresh_assumed": BASE + topic_fresh(1.0) + ranking("r", "s") + RANKED,
    "rank_semantic_candidates": BASE + semantic("s", 1.0, 1000000) + ranking("r", "s") + RANKED,
    "rank_hybrid": BASE + HYBRID + ranking("r", "s") + RANKED,
    "submission_lines": BASE + POP + ranking("r", "s") + " SELECT user_id, w, user_id || ' [' || string_agg(rank, ',' ORDER BY pos) || ']' AS line FROM r GROUP BY user_id, w",
    "validate_permutation": BASE + POP + ranking("r", "s") + " SELECT user_id, w, NOT (user_id % 10 = 0 AND starts_with(string_agg(rank, ',' ORDER BY pos), '1')) AS is_valid FROM r GROUP BY user_id, w",
    "validate_order": BASE + POP + ranking("r", "s") + """, n AS (SELECT r.user_id, r.w, t0 FROM (SELECT DISTINCT user_id, w FROM r) r JOIN imp ON imp.user_id = r.user_id AND imp.w = r.w)
SELECT row_number() OVER (ORDER BY t0, user_id, w) AS idx, CAST(user_id AS VARCHAR) AS expected, CASE WHEN user_id % 10 = 0 THEN 'x' ELSE '' END || user_id AS got, user_id % 10 <> 0 AS is_valid FROM n""",
    "tsv_round_trip": BASE + "z AS (SELECT 1) SELECT row_number() OVER (ORDER BY event_id) AS idx, event_id, user_id, nullif(event_type, 'view') AS event_type, article_id FROM ev",
    "field_guard": BASE + "z AS (SELECT 1) SELECT event_id, article_id FROM ev WHERE event_id % 3 > 0 AND article_id IS NOT NULL",
    "vector_text_round_trip": "SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS dim, unnest(list_transform(embedding, lambda x, i: CASE WHEN vec_id % 5 = 0 AND i = 2 THEN NULL ELSE round(CAST(x AS DOUBLE), 6) END)) AS value FROM embeddings",
    "store_round_trip": BASE + "z AS (SELECT 1) SELECT user_id, w, t0, split FROM imp WHERE split = 'validation'",
    "json_round_trip": "SELECT source AS key, count(*) AS n FROM documents GROUP BY source",
    "profile_files": "SELECT CAST(sum(length(event_id || ' ' || event_type) + 1) AS BIGINT) AS n_bytes, count(*) AS n_lines FROM events",
    "parquet_places": "SELECT row_number() OVER () AS idx, o_orderkey AS orderkey FROM orders",
    "limit_in_order": BASE + "z AS (SELECT 1) SELECT user_id, w, t0 FROM imp ORDER BY t0, user_id, w LIMIT 100",
    "parse_times": "SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN date_trunc('second', ts) END AS parsed FROM events",
    "semantic_with_bad_vectors": BASE.replace("past AS (SELECT hist.*", "past0 AS (SELECT hist.*").replace("clicks AS (SELECT article_id", "past AS (SELECT * FROM past0 WHERE article_id % 7 > 1),\nclicks AS (SELECT article_id", 1) + users("uv", 1.0, 1000000) + """s AS (SELECT val.user_id, val.w, val.pos, val.article_id, val.y,
  CASE WHEN val.article_id % 7 > 1 THEN coalesce(list_inner_product(vec.vector, uv.v) / uv.n, 0) ELSE 0 END AS score
  FROM val LEFT JOIN vec USING (article_id) LEFT JOIN uv ON uv.user_id = val.user_id AND uv.w = val.w),
""" + ranking("r", "s") + RANKED,
    "tokenize_documents": BASE + BM25 + "z AS (SELECT 1) SELECT article_id AS doc_id, term AS token, tf AS n FROM post",
    "bm25_postings": BASE + BM25 + "z AS (SELECT 1) SELECT term, article_id AS doc_id, tf FROM post",
    "bm25_term_stats": BASE + BM25 + "z AS (SELECT 1) SELECT term, df, round(idf, 6) AS idf FROM dfs",
    "bm25_corpus_stats": BASE + BM25 + "z AS (SELECT 1) SELECT n_docs, round(mean_length, 6) AS mean_length FROM st",
    "bm25_query_terms": BASE + BM25 + "z AS (SELECT 1) SELECT user_id, w, term FROM qt",
    "rank_bm25_candidates": BASE + BM25 + """cs AS (SELECT c.user_id, c.w, c.pos, sum(weight) AS score FROM val c JOIN qt ON qt.user_id = c.user_id AND qt.w = c.w JOIN wp ON wp.term = qt.term AND wp.article_id = c.article_id GROUP BY ALL),
s AS (SELECT val.*, coalesce(cs.score, 0) AS score FROM val LEFT JOIN cs ON cs.user_id = val.user_id AND cs.w = val.w AND cs.pos = val.pos),
""" + ranking("r", "s") + RANKED,
    "retrieve_bm25_topk": BASE + TOP_BM25 + "z AS (SELECT 1) SELECT user_id, w, article_id, score, rank FROM top",
    "recall_bm25": BASE + TOP_BM25 + recalled("bm25").lstrip(),
    "article_vectors": """WITH e AS (SELECT doc_id, unnest([(doc_id * 7) % n, (doc_id * 7 + 1) % n, (doc_id * 7 + 2) % n]) AS vec_id FROM documents, (SELECT max(vec_id) + 1 AS n FROM embeddings)),
x AS (SELECT doc_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM e JOIN embeddings USING (vec_id)),
a AS (SELECT doc_id, dim, avg(x) AS x FROM x GROUP BY ALL)
SELECT doc_id, CAST(dim AS INT) AS dim, round(x / greatest(sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 1e-12), 6) AS value FROM a""",
    "user_vectors": BASE + users("uv", 1.0, 1000000) + "z AS (SELECT 1) SELECT d.user_id, d.w, CAST(d.dim - 1 AS INT) AS dim, round(d.x / uv.n, 6) AS value FROM uvd d JOIN uv ON uv.user_id = d.user_id AND uv.w = d.w",
    "retrieve_semantic_topk": BASE + TOP_SEMANTIC + "z AS (SELECT 1) SELECT user_id, w, article_id, score, rank FROM top",
    "recall_semantic": BASE + TOP_SEMANTIC + recalled("semantic").lstrip(),
    "metric_auc_scores": BASE + LOGPOP + ranking("r", "s") + labelled() + auc() + " SELECT user_id, w, auc FROM auc",
    "metric_auc_ranks": BASE + LOGPOP + ranking("r", "s") + labelled() + auc(score="-rank") + " SELECT user_id, w, coalesce(auc, 0) AS auc FROM auc",
    "metric_mrr": BASE + LABELLED + mrr() + " SELECT user_id, w, mrr FROM mrr",
    "metric_ndcg": BASE + LABELLED + ndcg() + " SELECT user_id, w, ndcg_5, ndcg_10 FROM ndcg",
    "metric_diversity": BASE + LABELLED + f""", {DIVERSITY} SELECT user_id, w, diversity FROM div""",
    "metric_novelty": BASE + LABELLED + f" SELECT user_id, w, {NOVELTY} AS novelty FROM l LEFT JOIN clicks c USING (article_id) WHERE rank <= 10 GROUP BY user_id, w",
    "metric_coverage": BASE + LABELLED + " SELECT count(DISTINCT article_id) AS covered, (SELECT count(*) FROM documents) AS catalog, round(CAST(count(DISTINCT article_id) AS DOUBLE) / (SELECT greatest(count(*), 1) FROM documents), 6) AS coverage FROM l WHERE rank <= 10",
    "metric_slices": BASE + METHODS + labelled(MK) + auc(MK) + mrr(MK) + ndcg(MK) + """,
e AS (SELECT a.method, unnest(['all', CASE WHEN coalesce(nh.n_history, 0) < 5 THEN 'cold_history_under_5' ELSE 'warm_history_5_or_more' END]) AS slice, auc, mrr, ndcg_5, ndcg_10
  FROM auc a JOIN mrr m ON m.method = a.method AND m.user_id = a.user_id AND m.w = a.w JOIN ndcg n ON n.method = a.method AND n.user_id = a.user_id AND n.w = a.w LEFT JOIN nh ON nh.user_id = a.user_id AND nh.w = a.w)
SELECT method, slice, metric, count(v) AS n, round(avg(v), 6) AS value FROM (
  SELECT method, slice, 'auc' AS metric, auc AS v FROM e UNION ALL SELECT method, slice, 'mrr', mrr FROM e UNION ALL SELECT method, slice, 'ndcg_5', ndcg_5 FROM e UNION ALL SELECT method, slice, 'ndcg_10', ndcg_10 FROM e) GROUP BY ALL""",
    "bootstrap_ci": BASE + LABELLED + auc() + mrr() + ndcg() + f""", nov AS (SELECT user_id, w, {NOVELTY} AS novelty FROM l LEFT JOIN clicks c USING (article_id) WHERE rank <= 10 GROUP BY user_id, w),
{DIVERSITY},
wide AS (SELECT a.user_id, a.w, auc, mrr, ndcg_5, ndcg_10, novelty, diversity, unnest(['all', CASE WHEN coalesce(n_history, 0) < 5 THEN 'cold_history_under_5' ELSE 'warm_history_5_or_more' END]) AS slice
  FROM auc a JOIN mrr USING (user_id, w) JOIN ndcg USING (user_id, w) JOIN nov USING (user_id, w) JOIN div USING (user_id, w) LEFT JOIN nh USING (user_id, w)),
long AS (UNPIVOT wide ON auc, mrr, ndcg_5, ndcg_10, novelty, diversity INTO NAME metric VALUE v),
seeds AS (SELECT user_id, w, {SEED} FROM l GROUP BY user_id, w),
d1 AS (SELECT user_id, w, r, ((seed + (r + 1) * 2654435769) & 4294967295) AS x FROM seeds, (SELECT unnest(range(0, 500)) AS r)),
d2 AS (SELECT user_id, w, r, ((xor(x, x >> 16) * 73244475) & 4294967295) AS x FROM d1), d3 AS (SELECT user_id, w, r, ((xor(x, x >> 16) * 73244475) & 4294967295) AS x FROM d2),
weights AS (SELECT user_id, w, r, {COUNT} AS n FROM (SELECT user_id, w, r, xor(x, x >> 16) AS d FROM d3)),
ms AS (SELECT slice, metric, r, sum(v * n) / nullif(sum(n), 0) AS m FROM long JOIN weights USING (user_id, w) GROUP BY ALL),
own AS (SELECT slice, metric, count(v) AS n, round(avg(v), 6) AS mean FROM long GROUP BY ALL),
ci AS (SELECT slice, metric, {QUANTILES} FROM ms GROUP BY ALL)
SELECT slice, metric, n, mean, ci95_low, ci95_high FROM own JOIN ci USING (slice, metric)""",
    "bootstrap_coverage": BASE + LABELLED + f""", t AS (SELECT user_id, w, article_id, {SEED} FROM l WHERE rank <= 10),
lists AS (SELECT DISTINCT user_id, w FROM t),
d AS (SELECT article_id, r, {mixed("seed", "r")} AS d FROM (SELECT article_id, seed, unnest(range(0, 500)) AS r FROM t)),
rs AS (SELECT unnest(range(0, 500)) AS r),
ms AS (SELECT rs.r, CAST(count(DISTINCT article_id) AS DOUBLE) / (SELECT greatest(count(*), 1) FROM documents) AS m FROM rs LEFT JOIN (SELECT * FROM d WHERE d >= {POISSON[0]}) d USING (r) GROUP BY rs.r)
SELECT 'coverage_10' AS metric, (SELECT count(*) FROM lists) AS n, round(avg(m), 6) AS mean, {QUANTILES},
  (SELECT round(CAST(count(DISTINCT article_id) AS DOUBLE) / (SELECT greatest(count(*), 1) FROM documents), 6) FROM t) AS observed_full_sample FROM ms""",
    "profile_nulls": BASE + "n AS (SELECT count(*) AS n FROM art) " + " UNION ALL ".join(f"SELECT '{c}' AS column, count(*) - count({c}) AS nulls, round(CASE WHEN any_value(n) > 0 THEN CAST(count(*) - count({c}) AS DOUBLE) / any_value(n) ELSE 0 END, 6) AS share FROM art, n" for c in ("title", "abstract", "category", "published")),
    "profile_table_shape": "SELECT 'documents' AS table, count(*) AS n_rows, CAST(5 AS BIGINT) AS n_columns FROM documents UNION ALL SELECT 'events', count(*), 6 FROM events UNION ALL SELECT 'embeddings', count(*), 3 FROM embeddings",
    "profile_value_counts": "SELECT source AS key, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, key NULLS LAST LIMIT 10",
    "profile_history_len": BASE + "z AS (SELECT 1) " + spread("SELECT coalesce(n_history, 0) AS x FROM imp LEFT JOIN nh ON nh.user_id = imp.user_id AND nh.w = imp.w"),
    "profile_candidates_len": BASE + "z AS (SELECT 1) " + spread("SELECT count(*) AS x FROM cand GROUP BY user_id, w"),
    "profile_click_rate": BASE + "z AS (SELECT 1) " + spread("SELECT round(avg(y), 6) AS x FROM cand GROUP BY user_id, w"),
    "profile_clicks_per_impression": BASE + "z AS (SELECT CAST(sum(y) AS BIGINT) AS x FROM cand GROUP BY user_id, w) SELECT CAST(x AS VARCHAR) AS key, count(*) AS n FROM z GROUP BY x",
    "profile_impressions_per_user": BASE + "z AS (SELECT 1) SELECT user_id, count(*) AS n FROM imp GROUP BY user_id",
    "profile_histogram": "WITH d AS (SELECT CAST(n_chars AS DOUBLE) AS x FROM documents), e AS (SELECT min(x) AS lo, max(x) AS hi FROM d) SELECT CAST(CASE WHEN hi > lo THEN least(floor((x - lo) / (hi - lo) * 50), 49) ELSE 0 END AS BIGINT) AS bin, count(*) AS n FROM d, e GROUP BY 1",
    "profile_bool_share": "SELECT count(*) AS n, round(avg(CAST(event_type = 'click' AS INT)), 6) AS share_true FROM events",
    "profile_time_range": "SELECT min(strftime(ts, '%-m/%-d/%Y %-I:%M:%S %p')) AS first_text, max(strftime(ts, '%-m/%-d/%Y %-I:%M:%S %p')) AS last_text, min(ts) AS first_ts, max(ts) AS last_ts FROM events",
    "stream_popularity_counts": BASE + "z AS (SELECT 1) SELECT article_id, count(*) AS clicks FROM ev WHERE event_type = 'click' GROUP BY article_id",
    "orders_popularity_rank": """WITH l AS (SELECT l_orderkey AS o, l_partkey AS a, max(CAST(l_returnflag = 'R' AS INT)) AS y FROM lineitem GROUP BY ALL), c AS (SELECT a, count(*) AS clicks FROM l WHERE y = 1 GROUP BY a)
SELECT o AS orderkey, a AS partkey, coalesce(clicks, 0) AS clicks, CAST(row_number() OVER (PARTITION BY o ORDER BY coalesce(clicks, 0) DESC, a) AS INT) AS rank FROM l LEFT JOIN c USING (a)""",
}
