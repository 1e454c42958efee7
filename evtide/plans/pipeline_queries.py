"""Registered retrieval, parameter and pipeline queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evtide.operators import etl as E
from evtide.operators import retrieval as R
from evtide.plans.template_queries import QUESTIONS
from evtide.runtime import broadcast_if_small, read

#: Queries of a search: the rows whose id this divides.
EVERY = 50


def _docs(s: SparkSession, d: str, column: str) -> DataFrame:
    return read(s, d, "documents").select(F.col("doc_id").alias("doc"), F.col(column).alias("text"))


def _items(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "eval_item").where(F.col("item_id") % EVERY == 0).select(F.col("item_id").alias("qid"), F.col("item_text").alias("text"))


def _bm25(s: SparkSession, d: str, column: str = "text", k: int = 10) -> DataFrame:
    return R.bm25(_docs(s, d, column), _items(s, d), k).select("qid", "doc", F.round("score", 4).alias("score"), "rank")


def _bm25_sql(column: str, k: int, name: str) -> str:
    return f"""{name}_b AS (SELECT doc_id AS doc, list_filter(regexp_split_to_array(lower({column}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS bag FROM documents WHERE {column} IS NOT NULL),
    {name}_t AS (SELECT DISTINCT item_id AS qid, unnest(list_filter(regexp_split_to_array(lower(item_text), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')) AS term FROM eval_item WHERE item_id % {EVERY} = 0),
    {name}_s AS (SELECT count(*) AS n, avg(len(bag)) AS avgdl FROM {name}_b), {name}_u AS (SELECT doc, len(bag) AS dl, unnest(bag) AS term FROM {name}_b),
    {name}_p AS (SELECT term, doc, dl, count(*) AS tf FROM {name}_u WHERE term IN (SELECT term FROM {name}_t) GROUP BY ALL), {name}_d AS (SELECT term, ln(1 + ((SELECT n FROM {name}_s) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM {name}_p GROUP BY term),
    {name}_c AS (SELECT qid, doc, round(sum(idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / (SELECT avgdl FROM {name}_s)))), 6) AS score FROM {name}_p p JOIN {name}_d USING (term) JOIN {name}_t USING (term) GROUP BY qid, doc),
    {name} AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS INTEGER) AS rank FROM {name}_c) WHERE rank <= {k})"""


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("v"), "label")


def _dense(s: SparkSession, d: str, k: int = 10) -> DataFrame:
    v = _vectors(s, d)
    return R.dense(v, v.where(F.col("doc") % EVERY == 0).select(F.col("doc").alias("qid"), "v"), k)


DENSE = f"""v AS (SELECT vec_id AS doc, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings), ds AS (SELECT q.doc AS qid, v.doc, v.label, round(list_cosine_similarity(q.v, v.v), 6) AS score FROM v JOIN v q ON q.doc % {EVERY} = 0 AND q.doc <> v.doc)"""


def _fused(s: SparkSession, d: str) -> DataFrame:
    return R.fuse([_bm25(s, d, "text", 100), _bm25(s, d, "title", 100)])


FUSED = f"{_bm25_sql('text', 100, 'x')}, {_bm25_sql('title', 100, 'y')}, fu AS (SELECT qid, doc, round(sum(s), 9) AS score FROM (SELECT qid, doc, 1.0 / (60 + rank) AS s FROM x UNION ALL SELECT qid, doc, 1.0 / (60 + rank) FROM y) GROUP BY qid, doc)"


def _grouped(s: SparkSession, d: str) -> DataFrame:
    firms = read(s, d, "documents").select(F.col("doc_id").alias("doc"), F.coalesce("firm_id", F.lit("-")).alias("firm_id"))
    return R.best_per_group(_fused(s, d).join(firms, "doc"), "firm_id", 10).select("qid", "doc", "firm_id", "score", "rank")


def _reranked(s: SparkSession, d: str) -> DataFrame:
    texts = read(s, d, "documents").select(F.col("doc_id").alias("doc"), F.col("text").alias("doc_text"))
    pairs = R.top_k(_fused(s, d), 100).join(texts, "doc").join(broadcast_if_small(_items(s, d).withColumnRenamed("text", "query_text")), "qid")
    return R.rerank(pairs, R.word_overlap, 10)


def _unit(s: SparkSession, d: str) -> DataFrame:
    n = R.normalised(F.col("v"))
    return _vectors(s, d).select("doc", F.round(R.dot(n, n), 6).alias("norm"), F.round(F.element_at(n, 1), 6).alias("first"))


def _parity(s: SparkSession, d: str) -> DataFrame:
    """Each vector against itself rounded to two digits: whether the copy is as good as the original. Of an even number the upper median counts."""
    c = R.cosine(F.col("v"), F.transform("v", lambda x: F.round(x.cast("double"), 2)))
    got = _vectors(s, d).select(F.round(c, 6).alias("c")).agg(F.round(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY c DESC)"), 4).alias("median"), F.round(F.min("c"), 4).alias("least"))
    return got.withColumn("passed", (F.col("median") >= 0.995) & (F.col("least") >= 0.99))


def _mna(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "mna").select("event_id", "article_id", F.col("article_url").alias("url"), F.col("article_title").alias("title"), F.col("article_text").alias("text"), F.col("article_date").cast("date").alias("day"), "days_to_event", "role", "ticker").distinct()


MNA = "mn AS (SELECT DISTINCT event_id, article_id, article_url AS url, article_title AS title, article_text AS text, CAST(article_date AS DATE) AS day, days_to_event, role, ticker FROM mna)"


def _url_hash(c):
    return F.substring(F.sha2(c, 256), 1, 32)


def _whitelist(s: SparkSession, d: str) -> DataFrame:
    """Articles whose url is on a whitelist, here that of the articles on buyers, by hash."""
    listed = _mna(s, d).where("role = 'buyer' and url is not null").select(_url_hash(F.col("url")).alias("h")).distinct()
    return _mna(s, d).select("article_id", _url_hash(F.col("url")).alias("h")).distinct().join(broadcast_if_small(listed), "h", "left_semi")


def _unseen(s: SparkSession, d: str) -> DataFrame:
    """Second round of a search: what the first, the articles within five days, has not shown."""
    m = _mna(s, d).select("article_id", "url", "days_to_event").distinct()
    return m.join(m.where("days_to_event <= 5").select("url").distinct(), "url", "left_anti")


def _scopes(s: SparkSession, d: str) -> DataFrame:
    """The window and firm of each prediction's question: both of its windows united, defaults where there is none."""
    day = F.to_date(F.try_to_timestamp(F.substring(F.trim("anchor_date"), 1, 10), F.lit("yyyy-MM-dd")))
    p = read(s, d, "prediction").where("qid is not null").select("qid", day.alias("day"), F.upper(F.trim("firm_ticker")).alias("t")).groupBy("qid").agg(F.min("day").alias("a"), F.max("day").alias("b"), F.min("t").alias("ticker"))
    return p.select("qid", F.coalesce("a", F.lit("1900-01-01").cast("date")).alias("w_start"), F.coalesce("b", F.lit("2100-12-31").cast("date")).alias("w_end"), "ticker")


def _ranked_predictions(s: SparkSession, d: str) -> DataFrame:
    p = read(s, d, "prediction").where("template_id is not null").select("template_id", "qid", "prediction_id").distinct()
    return p.withColumn("rn", F.row_number().over(Window.partitionBy("template_id").orderBy("qid", "prediction_id")))


RANKED = "rp AS (SELECT *, CAST(row_number() OVER (PARTITION BY template_id ORDER BY qid NULLS FIRST, prediction_id) AS INTEGER) AS rn FROM (SELECT DISTINCT template_id, qid, prediction_id FROM prediction WHERE template_id IS NOT NULL))"


def _ma_events(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "corp_events").where("event_type like 'M&A%'").select("event_id", "event_type", F.col("firm_name_raw").alias("name"), F.upper("firm_ticker").alias("ticker"), F.col("event_date_value").alias("day")).distinct()


def _placed(s: SparkSession, d: str) -> DataFrame:
    days = read(s, d, "corp_events").groupBy("event_id").agg(F.min("event_date_value").alias("event_day"))
    return _mna(s, d).join(days, "event_id", "left")


def _judged(s: SparkSession, d: str) -> DataFrame:
    """Recorded judgements: an article without text fails, one within ten days and with a role says yes."""
    v = F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "ERROR").when((F.col("days_to_event") <= 10) & F.col("role").isNotNull(), "YES").otherwise("NO")
    return E.nearest(_placed(s, d)).select("event_id", "article_id", v.alias("verdict"))


NEAR = f"{MNA}, ne AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY event_id ORDER BY coalesce(abs(days_to_event), abs(date_diff('day', day, event_day)), 99999), article_id) AS INTEGER) AS rank FROM mn LEFT JOIN (SELECT event_id, min(event_date_value) AS event_day FROM corp_events GROUP BY 1) USING (event_id)) WHERE rank <= 10), ju AS (SELECT event_id, article_id, CASE WHEN coalesce(trim(text), '') = '' THEN 'ERROR' WHEN days_to_event <= 10 AND role IS NOT NULL THEN 'YES' ELSE 'NO' END AS verdict FROM ne)"
MA = "me AS (SELECT DISTINCT event_id, event_type, firm_name_raw AS name, upper(firm_ticker) AS ticker, event_date_value AS day FROM corp_events WHERE event_type LIKE 'M&A%')"
PLAIN = r"""nullif(regexp_replace(regexp_replace(trim(regexp_replace(split_part(regexp_replace(lower({c}), '\([^)]*\)', '', 'g'), ',', 1), '\s+', ' ', 'g'), ' '), '(?:[ ,]+(?:incorporated|inc|corporation|corp|company|co|limited|ltd|plc|llc|lp|ag|sa|nv|gmbh|group|holdings|holding)\.?)+$', ''), '^[ .,]+|[ .,]+$', '', 'g'), '')"""


def _votes(s: SparkSession, d: str) -> DataFrame:
    """Three recorded judges that differ in the days they accept."""
    m = _mna(s, d).select("event_id", "article_id", "days_to_event", "role").distinct()
    judges = F.explode(F.array(*[F.struct(F.lit(j).alias("judge"), F.lit(n).alias("most")) for j, n in (("a", 8), ("b", 12), ("c", 20))])).alias("j")
    return m.select("event_id", "article_id", "days_to_event", judges).select("event_id", "article_id", F.col("j.judge").alias("judge"), F.coalesce(F.col("days_to_event") <= F.col("j.most"), F.lit(False)).alias("yes"))


def _finalised(s: SparkSession, d: str) -> DataFrame:
    """One answer per identity, with all its urls."""
    p = read(s, d, "prediction").where("qid is not null")
    keys = ["qid", "template_id", F.upper(F.trim("firm_ticker")).alias("ticker"), "event_type", F.trim("anchor_date").alias("anchor")]
    urls = p.select(*keys, F.explode_outer("cited_urls").alias("u")).groupBy("qid", "template_id", "ticker", "event_type", "anchor").agg(F.array_join(F.array_sort(F.collect_set("u")), "|").alias("cited_urls"))
    return urls


def _packed(s: SparkSession, d: str, budget: int = 2000) -> DataFrame:
    """The distinct articles of each event, whether they fit a budget together."""
    m = _mna(s, d).where("url is not null").groupBy("event_id", "url").agg(F.max(E.token_estimate(F.coalesce("text", F.lit("")))).alias("t"))
    return m.groupBy("event_id").agg(F.count(F.lit(1)).alias("n_urls"), F.sum("t").alias("tokens")).withColumn("fits", F.col("tokens") <= budget)


def _packed_budget(s: SparkSession, d: str) -> DataFrame:
    deals = read(s, d, "corp_events").where("deal_id is not null").select("event_id", F.col("deal_id").alias("qid")).distinct()
    m = _mna(s, d).where("url is not null").select("event_id", "url", F.coalesce(F.abs("days_to_event"), F.lit(10000)).alias("rank"), E.token_estimate(F.coalesce("text", F.lit(""))).alias("tokens"))
    return E.pack_budget(deals.join(m, "event_id"), 2000)


def _repaired(s: SparkSession, d: str) -> DataFrame:
    """How many records the JSON in each file has, after slicing it out of what surrounds it."""
    f = read(s, d, "article_files").select("file_id", E.json_slice(F.col("content")).alias("j"))
    single = (F.json_array_length(F.concat(F.lit("["), "j", F.lit("]"))) == 1) & F.get_json_object("j", "$.article_id").isNotNull()
    n = F.coalesce(F.json_array_length("j").cast("bigint"), F.when(single, 1))
    return f.select("file_id", n.alias("n_records")).where("n_records is not null")


def _promoted(s: SparkSession, d: str) -> DataFrame:
    """Plain strings of an answer array promoted to records."""
    items = F.from_json("headline_summaries", "array<string>")
    e = read(s, d, "corp_events").select("event_id", "headline_summaries").distinct().select("event_id", F.posexplode(items).alias("pos", "item"))
    return e.where("item is not null").select("event_id", "pos", F.to_json(F.struct(F.col("item").alias("firm_ticker"))).alias("record"))


def _remaining(s: SparkSession, d: str) -> DataFrame:
    """Predictions still to make: those of questions without any cited answer."""
    p = read(s, d, "prediction").where("qid is not null").select("qid", "prediction_id", F.size("cited_urls").alias("n")).distinct()
    return E.resume(p.select("qid", "prediction_id").distinct(), p.where("n > 0"), "qid")


def _candidates(s: SparkSession, d: str) -> DataFrame:
    events = read(s, d, "corp_events").where("firm_ticker is not null and event_date_value is not null").select("event_id", "event_type", F.upper("firm_ticker").alias("ticker"), F.col("event_date_value").alias("day")).distinct()
    return E.candidates(events, _mna(s, d).where("ticker is not null and url is not null").select(F.upper("ticker").alias("ticker"), "url", "day").distinct())


def _padded(s: SparkSession, d: str) -> DataFrame:
    """Articles in a window padded by thirty days on both sides, with the day as a number."""
    start, end = F.lit("2019-01-01").cast("date"), F.lit("2019-06-30").cast("date")
    m = _mna(s, d).select("article_id", "day").distinct().where(F.col("day").between(F.date_sub(start, 30), F.date_add(end, 30)))
    return m.select("article_id", F.date_format("day", "yyyyMMdd").cast("int").alias("yyyymmdd"))


def _funnel_windows(types: dict[str, tuple[int, int]]) -> str:
    return ", ".join(f"('{t}', {a}, {b})" for t, (a, b) in types.items())


TABLE: dict[str, tuple[object, str]] = {
    "chunk_documents": (lambda s, d: R.windows(read(s, d, "documents"), "doc_id", "text").select("doc_id", "chunk", "start", F.length("chunk_text").alias("n"), F.md5("chunk_text").alias("digest")), "WITH c AS (SELECT doc_id, text, unnest(generate_series(0, CASE WHEN length(text) > 6000 THEN CAST(ceil((length(text) - 5000) / 4000.0) AS BIGINT) ELSE 0 END)) AS i FROM documents WHERE text IS NOT NULL), x AS (SELECT doc_id, i, substring(text, i * 4000 + 1, CASE WHEN length(text) > 6000 THEN 5000 ELSE 6000 END) AS t FROM c) SELECT doc_id, CAST(i AS INTEGER) AS chunk, CAST(i * 4000 AS INTEGER) AS start, CAST(length(t) AS INTEGER) AS n, md5(t) AS digest FROM x"),
    "bm25_topk": (_bm25, f"WITH {_bm25_sql('text', 10, 'x')} SELECT qid, doc, round(score, 4) AS score, rank FROM x"),
    "dense_cosine_topk": (_dense, f"WITH {DENSE} SELECT qid, doc, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS INTEGER) AS rank FROM ds) WHERE rank <= 10"),
    "dense_group_by_label": (lambda s, d: R.best_per_group(_dense(s, d, 100).drop("rank").join(_vectors(s, d).select("doc", "label"), "doc"), "label", 5).select("qid", "doc", "label", "score", "rank"), f"WITH {DENSE}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS r FROM ds) WHERE r <= 100), g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY score DESC, doc) AS j FROM t) WHERE j = 1) SELECT qid, doc, label, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS INTEGER) AS rank FROM g) WHERE rank <= 5"),
    "rrf_fusion": (_fused, f"WITH {FUSED} SELECT qid, doc, score FROM fu"),
    "rrf_group_by": (_grouped, f"WITH {FUSED}, z AS (SELECT fu.qid, fu.doc, coalesce(firm_id, '-') AS firm_id, score FROM fu JOIN documents ON doc_id = doc), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, firm_id ORDER BY score DESC, doc) AS i FROM z) WHERE i = 1) SELECT qid, doc, firm_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS INTEGER) AS rank FROM o) WHERE rank <= 10"),
    "rerank_topk": (_reranked, ""),
    "first_paragraph_query": (lambda s, d: read(s, d, "documents").select("doc_id", F.split_part("text", F.lit("\n\n"), F.lit(1)).alias("query")), "SELECT doc_id, split_part(text, chr(10) || chr(10), 1) AS query FROM documents"),
    "l2_normalize": (_unit, "SELECT vec_id AS doc, round(list_dot_product(u, u), 6) AS norm, round(u[1], 6) AS first FROM (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings))"),
    "parity_gate": (_parity, "WITH c AS (SELECT round(list_cosine_similarity(v, list_transform(v, lambda x: round(x, 2))), 6) AS c FROM (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings)) SELECT m AS median, l AS least, m >= 0.995 AND l >= 0.99 AS passed FROM (SELECT round(list_sort(list(c))[count(*) // 2 + 1], 4) AS m, round(min(c), 4) AS l FROM c)"),
    "url_hash_whitelist_semi": (_whitelist, f"WITH {MNA} SELECT DISTINCT article_id, sha256(url)[1:32] AS h FROM mn WHERE url IN (SELECT url FROM mn WHERE role = 'buyer')"),
    "url_hash": (lambda s, d: _mna(s, d).where("url is not null").select("article_id", _url_hash(F.col("url")).alias("h")).distinct(), f"WITH {MNA} SELECT DISTINCT article_id, sha256(url)[1:32] AS h FROM mn WHERE url IS NOT NULL"),
    "seen_set_anti": (_unseen, f"WITH {MNA} SELECT DISTINCT article_id, url, days_to_event FROM mn WHERE url IS NULL OR url NOT IN (SELECT url FROM mn WHERE days_to_event <= 5 AND url IS NOT NULL)"),
    "padded_window": (_padded, f"WITH {MNA} SELECT DISTINCT article_id, CAST(strftime(day, '%Y%m%d') AS INTEGER) AS yyyymmdd FROM mn WHERE day BETWEEN DATE '2019-01-01' - 30 AND DATE '2019-06-30' + 30"),
    "scope_extraction": (_scopes, "WITH p AS (SELECT qid, CAST(try_strptime(left(trim(anchor_date, ' '), 10), '%Y-%m-%d') AS DATE) AS day, length(trim(anchor_date, ' ')) AS n, upper(trim(firm_ticker, ' ')) AS t, regexp_matches(trim(anchor_date, ' '), '^\\d{4}-\\d{2}-\\d{2}') AS ok FROM prediction WHERE qid IS NOT NULL) SELECT qid, coalesce(min(CASE WHEN ok THEN day END), DATE '1900-01-01') AS w_start, coalesce(max(CASE WHEN ok THEN day END), DATE '2100-12-31') AS w_end, min(t) AS ticker FROM p GROUP BY qid"),
    "per_template_cap": (lambda s, d: _ranked_predictions(s, d).where("rn <= 3"), f"WITH {RANKED} SELECT * FROM rp WHERE rn <= 3"),
    "round_robin_sample": (lambda s, d: _ranked_predictions(s, d).orderBy("rn", "template_id").limit(20), f"WITH {RANKED} SELECT * FROM rp ORDER BY rn, template_id LIMIT 20"),
    "role_map": (lambda s, d: _mna(s, d).select("event_id", F.when(F.col("role") == "buyer", "acquirer").otherwise(F.lower("role")).alias("role")).where("role is not null").distinct(), f"WITH {MNA} SELECT DISTINCT event_id, CASE WHEN role = 'buyer' THEN 'acquirer' ELSE lower(role) END AS role FROM mn WHERE role IS NOT NULL"),
    "normalize_name": (lambda s, d: read(s, d, "corp_events").select("firm_name_raw").distinct().select("firm_name_raw", E.plain_name(F.col("firm_name_raw")).alias("plain")), f"SELECT DISTINCT firm_name_raw, {PLAIN.format(c='firm_name_raw')} AS plain FROM corp_events"),
    "attest_l0_l1": (lambda s, d: E.linked_articles(_ma_events(s, d), _mna(s, d)), f"WITH {MNA}, {MA}, pl AS (SELECT event_id, {PLAIN.format(c='name')} AS n FROM me), fo AS (SELECT event_id, list_filter([n, CASE WHEN len(string_split(n, ' ')) >= 2 THEN array_to_string(string_split(n, ' ')[1:2], ' ') END, CASE WHEN length(split_part(n, ' ', 1)) >= 4 AND split_part(n, ' ', 1) NOT IN {E.COMMON_FIRST} THEN split_part(n, ' ', 1) END], lambda x: length(x) >= 3) AS forms FROM pl) SELECT me.event_id, count(DISTINCT url) AS l0, count(DISTINCT CASE WHEN len(list_filter(forms, lambda f: contains(lower(title), f))) > 0 THEN url END) AS l1 FROM fo me LEFT JOIN mn ON me.event_id = mn.event_id GROUP BY 1"),
    "attest_topk_days": (lambda s, d: E.nearest(_placed(s, d)).select("event_id", "article_id", "rank"), f"WITH {NEAR} SELECT event_id, article_id, rank FROM ne"),
    "attest_verdict": (lambda s, d: E.verdicts(_judged(s, d), _ma_events(s, d)), f"WITH {NEAR}, {MA}, c AS (SELECT event_id, count(*) FILTER (WHERE verdict = 'YES') AS y, count(*) FILTER (WHERE verdict = 'NO') AS n, count(*) FILTER (WHERE verdict = 'ERROR') AS x FROM ju GROUP BY 1) SELECT e.event_id, coalesce(y, 0) AS yes, coalesce(n, 0) AS no, CASE WHEN y IS NULL THEN 'absent' WHEN y >= 1 THEN 'covered' WHEN n >= 10 - x THEN 'absent' ELSE 'uncertain' END AS verdict FROM (SELECT DISTINCT event_id FROM me) e LEFT JOIN c ON e.event_id = c.event_id"),
    "consensus_3of3": (lambda s, d: E.unanimous(_votes(s, d)), f"WITH {MNA} SELECT event_id, article_id FROM mn GROUP BY ALL HAVING bool_and(coalesce(days_to_event <= 8, false))"),
    "candidate_window_join": (_candidates, f"WITH {MNA}, w(t, b, a) AS (VALUES {_funnel_windows(E.WINDOWS)}) SELECT e.event_id, url, min(abs(date_diff('day', e.event_date_value, mn.day))) AS days FROM corp_events e JOIN w ON w.t = e.event_type JOIN mn ON upper(mn.ticker) = upper(e.firm_ticker) AND date_diff('day', e.event_date_value, mn.day) BETWEEN -b AND a WHERE url IS NOT NULL GROUP BY 1, 2"),
    "finalize_dedup": (_finalised, "WITH p AS (SELECT DISTINCT qid, template_id, upper(trim(firm_ticker, ' ')) AS ticker, event_type, trim(anchor_date, ' ') AS anchor, cited_urls FROM prediction WHERE qid IS NOT NULL), u AS (SELECT * EXCLUDE cited_urls, unnest(CASE WHEN len(cited_urls) > 0 THEN cited_urls ELSE [NULL] END) AS u FROM p) SELECT qid, template_id, ticker, event_type, anchor, coalesce(string_agg(DISTINCT u, '|' ORDER BY u), '') AS cited_urls FROM u GROUP BY ALL"),
    "pack_strict": (_packed, f"WITH {MNA}, t AS (SELECT event_id, url, max(length(coalesce(text, '')) // 4) AS t FROM mn WHERE url IS NOT NULL GROUP BY 1, 2) SELECT event_id, count(*) AS n_urls, CAST(sum(t) AS BIGINT) AS tokens, sum(t) <= 2000 AS fits FROM t GROUP BY 1"),
    "pack_budget_aware": (_packed_budget, ""),
    "json_repair_parse": (_repaired, r"WITH f AS (SELECT file_id, coalesce(nullif(regexp_extract(content, '(?s)(\[.*\])', 1), ''), nullif(regexp_extract(content, '(?s)(\{.*\})', 1), '')) AS j FROM article_files), v AS (SELECT file_id, CASE WHEN json_valid(j) THEN j END AS j FROM f) SELECT file_id, CASE WHEN json_type(j) = 'ARRAY' THEN CAST(json_array_length(j) AS BIGINT) ELSE 1 END AS n_records FROM v WHERE j IS NOT NULL AND (json_type(j) = 'ARRAY' OR json_extract(j, '$.article_id') IS NOT NULL)"),
    "promote_string_items": (_promoted, """WITH e AS (SELECT DISTINCT event_id, headline_summaries AS h FROM corp_events WHERE json_valid(headline_summaries) AND json_type(headline_summaries) = 'ARRAY'), i AS (SELECT event_id, unnest(from_json(h, '["VARCHAR"]')) AS item, unnest(generate_series(0, CAST(json_array_length(h) AS BIGINT) - 1)) AS pos FROM e) SELECT event_id, CAST(pos AS INTEGER) AS pos, CAST(to_json(struct_pack(firm_ticker := item)) AS VARCHAR) AS record FROM i WHERE item IS NOT NULL"""),
    "resume_anti_join": (_remaining, "SELECT DISTINCT qid, prediction_id FROM prediction WHERE qid IS NOT NULL AND qid NOT IN (SELECT qid FROM prediction WHERE len(cited_urls) > 0 AND qid IS NOT NULL)"),
}
