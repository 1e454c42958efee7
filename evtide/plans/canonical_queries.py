"""Registered queries of merging and canonicalisation with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evtide.operators import components as C
from evtide.operators import merge as M
from evtide.runtime import read

def idx() -> Column:
    """The order in which the records are met."""
    return F.struct("loaded_at", "event_id")


def records(s: SparkSession, d: str) -> DataFrame:
    """The members of the duplicate groups, distinct; they are met in the order of loading."""
    e = read(s, d, "corp_events").select("event_id", "event_type", "event_status", "event_date_basis", "event_date_text", "event_date_value", F.lower(F.trim("event_date_precision")).alias("precision"), "raw_extraction_count", "loaded_at", F.col("loaded_at").cast("date").alias("day")).distinct()
    return read(s, d, "dup_group").select("group_id", "event_id").distinct().join(e, "event_id")


REC = """rec AS (SELECT DISTINCT g.group_id, e.event_id, e.event_type, e.event_status, e.event_date_basis, e.event_date_text, e.event_date_value, lower(trim(e.event_date_precision)) AS "precision", e.raw_extraction_count, e.loaded_at, CAST(e.loaded_at AS DATE) AS day FROM dup_group g JOIN corp_events e ON g.event_id = e.event_id)"""


def _agg(column):
    return lambda s, d: records(s, d).groupBy("group_id").agg(column())


def _first(value: str, told: str, order: str, where: str = "", source: str = "rec", key: str = "group_id") -> str:
    return f"SELECT k.{key}, x.{value} FROM (SELECT DISTINCT {key} FROM {source}) k LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS i FROM {source} WHERE {told}{where}) WHERE i = 1) x ON k.{key} = x.{key}"


def _told(c: str) -> str:
    return f"{c} IS NOT NULL AND {c} NOT IN ('unknown', '', '[]')"


def _money(s: SparkSession, d: str) -> DataFrame:
    deals = read(s, d, "ma_details").select("event_id", F.when(~F.isnan("deal_value_amount"), F.col("deal_value_amount")).alias("amount"), F.col("deal_value_currency").alias("currency"), F.col("deal_value_scale").alias("scale")).distinct()
    merged = records(s, d).select("group_id", "event_id", "loaded_at", "day").join(deals, "event_id").groupBy("group_id").agg(M.latest_money(F.col("amount"), F.col("currency"), F.col("scale"), F.col("day"), idx()).alias("m"))
    return merged.select("group_id", "m.amount", "m.currency", "m.scale")


def _companies(s: SparkSession, d: str) -> DataFrame:
    members = read(s, d, "mna").select("event_id", "article_url", "ticker", "role", "article_id", F.lower(F.regexp_extract("article_title", r"^(\S+)", 1)).alias("name")).distinct()
    return M.company_list(members, "event_id", "name", ["ticker", "role"], F.struct("article_id", F.coalesce("ticker", F.lit("")), F.coalesce("role", F.lit(""))))


DEAL_SLOTS = {"M&A_announce": "announce_event_id", "M&A_complete": "complete_event_id", "M&A_cancel": "cancel_event_id"}


def _deal_slots(s: SparkSession, d: str) -> DataFrame:
    e = read(s, d, "corp_events").where("deal_id is not null").select("deal_id", "event_type", "event_id", "loaded_at").distinct()
    return M.slots(e, "deal_id", F.col("event_type"), DEAL_SLOTS, "event_id", idx())


def _longest_name(s: SparkSession, d: str) -> DataFrame:
    e = read(s, d, "corp_events").where("firm_id is not null and firm_name_raw is not null").select("firm_id", F.col("firm_name_raw").alias("name")).distinct()
    return e.groupBy("firm_id").agg(F.min_by("name", F.struct((-F.length("name")).alias("n"), "name")).alias("name"))


def _top_aliases(s: SparkSession, d: str) -> DataFrame:
    counted = read(s, d, "firm_alias").groupBy("firm_id").agg(F.countDistinct("atom_type", "atom_value").alias("n_atoms"))
    return counted.orderBy(F.desc("n_atoms"), "firm_id").limit(20)


def _buckets(s: SparkSession, d: str) -> DataFrame:
    rows = read(s, d, "ma_details").select("event_id", "deal_value_amount", "deal_value_scale").distinct()
    return rows.select("event_id", C.value_bucket(F.col("deal_value_amount"), F.col("deal_value_scale")).alias("bucket")).where("bucket is not null")


BUCKET = "CASE WHEN v > 0 AND NOT isnan(v) THEN round_even(v / p * 0.05, 0) * p / 0.05 END"
VALUES = "va AS (SELECT DISTINCT event_id, deal_value_amount * CASE deal_value_scale WHEN 'thousand' THEN 1e3 WHEN 'million' THEN 1e6 WHEN 'billion' THEN 1e9 WHEN 'trillion' THEN 1e12 ELSE 1.0 END AS v FROM ma_details WHERE deal_value_amount > 0 AND NOT isnan(deal_value_amount)), vb AS (SELECT event_id, v, pow(10.0, floor(log10(v)) - 1) AS p FROM va)"


def refs(s: SparkSession, d: str) -> DataFrame:
    """(ref, atom, pos): the identity atoms that one firm id is known by are one reference."""
    order = F.array_position(F.array(*map(F.lit, C.ATOM_ORDER)), F.col("atom_type")).cast("int")
    rows = read(s, d, "firm_alias").select(F.col("firm_id").alias("ref"), C.atom(F.col("atom_type"), F.col("atom_value")).alias("atom"), order.alias("pos"))
    return rows.where("atom is not null").distinct()


ATOMS = """ato AS (SELECT DISTINCT firm_id AS ref, atom_type || ':' || CASE atom_type WHEN 'ticker' THEN upper(trim(atom_value)) WHEN 'normalized_name' THEN lower(trim(atom_value)) ELSE trim(atom_value) END AS atom,
    CASE atom_type WHEN 'ticker' THEN 1 WHEN 'cik' THEN 2 WHEN 'lei' THEN 3 ELSE 4 END AS pos FROM firm_alias WHERE trim(atom_value) <> '')"""


def _reach(edges: str) -> str:
    """Components in SQL over a CTE of edges (a, b): the smallest id that each id reaches."""
    return f"""sy AS (SELECT a, b FROM ({edges}) UNION SELECT b, a FROM ({edges})), re(id, r) AS (SELECT DISTINCT a, a FROM sy UNION SELECT re.id, sy.b FROM re JOIN sy ON re.r = sy.a), cc AS (SELECT id, min(r) AS root FROM re GROUP BY id)"""


FIRST_ATOM = "SELECT ato.atom AS a, f.atom AS b FROM ato JOIN (SELECT ref, arg_min(atom, (pos, atom)) AS atom FROM ato GROUP BY ref) f ON ato.ref = f.ref WHERE ato.atom <> f.atom"


def _singletons(s: SparkSession, d: str) -> DataFrame:
    """Atoms that no reference with a second atom contains: they belong to no firm unless singletons are registered."""
    r = refs(s, d)
    linked = C.atom_edges(r)
    known = linked.select(F.col("a").alias("atom")).unionByName(linked.select(F.col("b").alias("atom"))).distinct()
    return r.select("atom").distinct().join(known, "atom", "left_anti")


def identity_keys(s: SparkSession, d: str) -> DataFrame:
    """(event_id, k): the cluster hint; type, firm and date; type, firm and value bucket. Without a firm only the hint."""
    e = read(s, d, "corp_events").select("event_id", "event_type", "firm_id", "event_date_value").distinct()
    m = read(s, d, "ma_details").select("event_id", F.lower(F.trim("cluster_key_hint")).alias("hint"), C.value_bucket(F.col("deal_value_amount"), F.col("deal_value_scale")).alias("bucket")).distinct()
    hints = m.where("hint is not null and hint not in ('', '-', 'n/a', 'none', 'null', 'tbd', 'unknown')").select("event_id", F.concat(F.lit("hint|"), "hint").alias("k"))
    dated = e.where("firm_id is not null and event_date_value is not null").select("event_id", F.concat_ws("|", F.lit("date"), "event_type", "firm_id", F.col("event_date_value").cast("string")).alias("k"))
    valued = e.where("firm_id is not null").join(m.where("bucket is not null").select("event_id", "bucket").distinct(), "event_id").select("event_id", F.concat_ws("|", F.lit("value"), "event_type", "firm_id", F.col("bucket").try_cast("decimal(38,0)").cast("string")).alias("k"))
    return hints.unionByName(dated).unionByName(valued).distinct()


KEYS = f"""{VALUES}, ik AS (SELECT event_id, 'hint|' || lower(trim(cluster_key_hint)) AS k FROM ma_details WHERE lower(trim(cluster_key_hint)) NOT IN ('', '-', 'n/a', 'none', 'null', 'tbd', 'unknown')
    UNION SELECT event_id, 'date|' || event_type || '|' || firm_id || '|' || CAST(event_date_value AS VARCHAR) FROM corp_events WHERE firm_id IS NOT NULL AND event_date_value IS NOT NULL
    UNION SELECT e.event_id, 'value|' || event_type || '|' || firm_id || '|' || CAST(CAST(({BUCKET}) AS DECIMAL(38, 0)) AS VARCHAR) FROM corp_events e JOIN vb ON e.event_id = vb.event_id WHERE firm_id IS NOT NULL)"""
HUBS = "SELECT ik.event_id AS a, h.b FROM ik JOIN (SELECT k, min(event_id) AS b FROM ik GROUP BY k) h ON ik.k = h.k WHERE ik.event_id <> h.b"


def event_clusters(s: SparkSession, d: str) -> DataFrame:
    return C.connected_components(C.hub_edges(identity_keys(s, d), "event_id", "k"))


def _histogram(s: SparkSession, d: str) -> DataFrame:
    return event_clusters(s, d).groupBy("root").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("n_clusters"))


def _chains(s: SparkSession, d: str) -> DataFrame:
    """Deals: clusters of M&A events linked further by their deal id."""
    clusters = event_clusters(s, d).withColumnRenamed("id", "event_id")
    ma = read(s, d, "corp_events").where("event_type like 'M&A%'").select("event_id", F.lower(F.trim("deal_id")).alias("deal")).distinct()
    ma = ma.join(clusters, "event_id", "left").select("event_id", "deal", F.coalesce("root", "event_id").alias("cluster"))
    known = ma.where("deal is not null and deal not in ('', '-', 'n/a', 'none', 'null', 'tbd', 'unknown') and not deal rlike '^0+$'")
    chains = C.connected_components(C.hub_edges(known, "cluster", "deal"), ma.select(F.col("cluster").alias("id")))
    return ma.select("event_id", "cluster").distinct().join(chains.withColumnRenamed("id", "cluster"), "cluster").select("event_id", F.col("root").alias("deal_root"), C.surrogate(F.col("root")).alias("deal_key"))


CHAIN = f"""WITH RECURSIVE {KEYS}, {_reach(HUBS)}, ma AS (SELECT DISTINCT e.event_id, lower(trim(deal_id)) AS deal, coalesce(cc.root, e.event_id) AS cluster FROM corp_events e LEFT JOIN cc ON cc.id = e.event_id WHERE event_type LIKE 'M&A%'),
    kn AS (SELECT * FROM ma WHERE deal NOT IN ('', '-', 'n/a', 'none', 'null', 'tbd', 'unknown') AND NOT regexp_matches(deal, '^0+$')), dh AS (SELECT DISTINCT kn.cluster AS a, h.b FROM kn JOIN (SELECT deal, min(cluster) AS b FROM kn GROUP BY deal) h ON kn.deal = h.deal WHERE kn.cluster <> h.b),
    s2 AS (SELECT a, b FROM dh UNION SELECT b, a FROM dh), r2(id, r) AS (SELECT DISTINCT a, a FROM s2 UNION SELECT r2.id, s2.b FROM r2 JOIN s2 ON r2.r = s2.a), c2 AS (SELECT id, min(r) AS root FROM r2 GROUP BY id)
    SELECT DISTINCT event_id, coalesce(c2.root, cluster) AS deal_root, sha256(coalesce(c2.root, cluster))[1:32] AS deal_key FROM ma LEFT JOIN c2 ON c2.id = ma.cluster"""


def _primary(s: SparkSession, d: str) -> DataFrame:
    """The main firm of an event: the first acquirer, else the first target, else the firm of the event itself."""
    from evtide.plans.views import trade

    v = trade(s, d)
    rank = F.when(F.col("role") == "acquirer", 0).when(F.col("role") == "target", 1)
    first = v.companies.where(rank.isNotNull()).groupBy("event_id").agg(F.min(F.struct(rank.alias("r"), "ticker")).alias("x"))
    return v.events.select("event_id", "firm").join(first, "event_id", "left").select("event_id", F.coalesce("x.ticker", "firm").alias("primary_firm"))


TABLE: dict[str, tuple[object, str]] = {
    "merge_majority": (lambda s, d: M.majority(records(s, d), "group_id", "event_status", idx()), f"WITH {REC}, n AS (SELECT group_id, event_status, count(*) AS n, min((loaded_at, event_id)) AS f FROM rec WHERE {_told('event_status')} GROUP BY 1, 2) SELECT k.group_id, x.event_status FROM (SELECT DISTINCT group_id FROM rec) k LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY n DESC, f) AS i FROM n) WHERE i = 1) x ON k.group_id = x.group_id"),
    "merge_latest": (_agg(lambda: M.latest(F.col("event_date_basis"), F.col("day"), idx()).alias("event_date_basis")), f"WITH {REC} {_first('event_date_basis', _told('event_date_basis'), 'day DESC NULLS LAST, loaded_at, event_id')}"),
    "merge_longest": (_agg(lambda: M.longest(F.col("event_date_text"), F.col("day"), idx()).alias("event_date_text")), f"WITH {REC} {_first('event_date_text', _told('event_date_text'), 'length(event_date_text) DESC, day DESC NULLS LAST, loaded_at, event_id')}"),
    "merge_any_true": (_agg(lambda: M.any_true(F.col("raw_extraction_count") > 3).alias("often")), f"WITH {REC} SELECT group_id, bool_or(raw_extraction_count > 3) AS often FROM rec GROUP BY group_id"),
    "merge_best_date": (_agg(lambda: M.best_date(F.col("event_date_value"), F.col("precision"), F.col("day"), idx()).alias("event_date")), f"WITH {REC}, x AS (SELECT *, event_date_value AS event_date, CASE \"precision\" WHEN 'day' THEN 4 WHEN 'month' THEN 3 WHEN 'quarter' THEN 2 WHEN 'year' THEN 1 WHEN 'approximate' THEN 1 ELSE 0 END AS rk FROM rec) {_first('event_date', 'event_date IS NOT NULL', 'rk DESC, day, loaded_at, event_id', source='x')}"),
    "merge_money_latest": (_money, f"WITH {REC}, x AS (SELECT DISTINCT rec.group_id, rec.event_id, rec.loaded_at, rec.day, CASE WHEN NOT isnan(deal_value_amount) THEN deal_value_amount END AS amount, deal_value_currency AS currency, deal_value_scale AS scale FROM rec JOIN ma_details m ON rec.event_id = m.event_id) SELECT k.group_id, y.amount, y.currency, y.scale FROM (SELECT DISTINCT group_id FROM x) k LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY day DESC, loaded_at, event_id) AS i FROM x WHERE amount IS NOT NULL) WHERE i = 1) y ON k.group_id = y.group_id"),
    "merge_company_list": (_companies, "WITH m AS (SELECT DISTINCT event_id, ticker, role, article_id, lower(regexp_extract(article_title, '^(\\S+)', 1)) AS name, (article_id, coalesce(ticker, ''), coalesce(role, '')) AS i FROM mna WHERE regexp_extract(article_title, '^(\\S+)', 1) <> '') SELECT event_id, name, arg_min(ticker, i) FILTER (WHERE ticker <> '') AS ticker, arg_min(role, i) FILTER (WHERE role <> '') AS role FROM m GROUP BY 1, 2"),
    "deal_slot_pivot": (_deal_slots, "WITH e AS (SELECT DISTINCT deal_id, event_type, event_id, loaded_at, (loaded_at, event_id) AS i FROM corp_events WHERE deal_id IS NOT NULL) SELECT deal_id, " + ", ".join(f"arg_min(event_id, i) FILTER (WHERE event_type = '{t}') AS {c}" for t, c in DEAL_SLOTS.items()) + " FROM e GROUP BY deal_id"),
    "canonical_longest": (_longest_name, "SELECT firm_id, arg_min(firm_name_raw, (-length(firm_name_raw), firm_name_raw)) AS name FROM corp_events WHERE firm_id IS NOT NULL AND firm_name_raw IS NOT NULL GROUP BY firm_id"),
    "top20_alias_count": (_top_aliases, "SELECT firm_id, count(DISTINCT (atom_type, atom_value)) AS n_atoms FROM firm_alias WHERE atom_type IS NOT NULL AND atom_value IS NOT NULL GROUP BY firm_id ORDER BY n_atoms DESC, firm_id LIMIT 20"),
    "value_bucket": (_buckets, f"WITH {VALUES} SELECT event_id, {BUCKET} AS bucket FROM vb"),
    "firm_canonical_cc": (lambda s, d: C.firm_roots(refs(s, d)), f"WITH RECURSIVE {ATOMS}, {_reach(FIRST_ATOM)} SELECT id, root FROM cc"),
    "firm_singleton_quirk": (_singletons, f"WITH {ATOMS}, ed AS ({FIRST_ATOM}) SELECT DISTINCT atom FROM ato WHERE atom NOT IN (SELECT a FROM ed UNION SELECT b FROM ed)"),
    "event_identity_keys": (identity_keys, f"WITH {KEYS} SELECT event_id, k FROM ik"),
    "event_cluster_cc": (event_clusters, f"WITH RECURSIVE {KEYS}, {_reach(HUBS)} SELECT id, root FROM cc"),
    "cluster_size_hist": (_histogram, f"WITH RECURSIVE {KEYS}, {_reach(HUBS)}, z AS (SELECT root, count(*) AS size FROM cc GROUP BY root) SELECT size, count(*) AS n_clusters FROM z GROUP BY size"),
    "deal_chain_cc": (_chains, CHAIN),
    "primary_firm": (_primary, "WITH l AS (SELECT l_orderkey, min('P' || l_partkey) AS t FROM lineitem GROUP BY 1) SELECT o_orderkey AS event_id, coalesce('C' || o_custkey, t) AS primary_firm FROM orders LEFT JOIN l ON l_orderkey = o_orderkey"),
}
