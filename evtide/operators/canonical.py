"""Nested extraction records to a star schema: firms, events and deals found by shared identity, fields merged by policy.

All steps are joins and aggregations over exploded references and keys; the only iteration is the component search.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evtide.operators import components as C
from evtide.operators import merge as M
from evtide.runtime import stash

#: Slots in which a record names companies; the order in which they tell the main firm depends on the type of event.
LISTS = {"acquirer": "details.acquirers", "target": "details.targets", "seller": "details.sellers", "primary": "primary_companies"}
SINGLE = {"company": "details.company", "issuer": "details.issuer", "parent": "details.parent_company"}


@dataclass(frozen=True)
class Star:
    """The tables; all keys are reproducible surrogates of the smallest member."""

    firms: DataFrame
    aliases: DataFrame
    events: DataFrame
    companies: DataFrame
    sources: DataFrame
    deals: DataFrame
    ma_details: DataFrame
    executive_change_details: DataFrame
    ipo_details: DataFrame
    stock_split_details: DataFrame


def day(c: str) -> Column:
    """The full date at the start of a date struct's value, else null."""
    return F.regexp_extract(F.col(f"{c}.value"), r"^(\d{4}-\d{2}-\d{2})", 1).try_cast("date")


def company_refs(records: DataFrame) -> DataFrame:
    """(rid, slot, pos, c): every company a record names."""
    parts = [records.select("rid", F.lit(slot).alias("slot"), F.posexplode(f"event.{path}").alias("pos", "c")) for slot, path in LISTS.items()]
    parts += [records.select("rid", F.lit(slot).alias("slot"), F.lit(0).alias("pos"), F.col(f"event.{path}").alias("c")) for slot, path in SINGLE.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("c is not null")


def atoms_of(refs: DataFrame) -> DataFrame:
    """(ref, atom, pos): the identity atoms of each reference, in the order in which they identify it."""
    each = F.array(*[F.struct(F.lit(i).alias("pos"), C.atom(F.lit(k), F.col(f"c.{k}")).alias("atom")) for i, k in enumerate(C.ATOM_ORDER)])
    keyed = refs.select(F.concat_ws("|", "rid", "slot", F.col("pos").cast("string")).alias("ref"), F.explode(each).alias("a"))
    return keyed.select("ref", "a.atom", "a.pos").where("atom is not null")


def resolve(refs: DataFrame, register_singletons: bool = False) -> DataFrame:
    """refs with firm: the root of the first atom that belongs to a firm, null without one."""
    atoms = stash(atoms_of(refs), "atoms")
    roots = C.firm_roots(atoms, register_singletons)
    firm = atoms.join(roots.withColumnRenamed("id", "atom"), "atom").groupBy("ref").agg(F.min_by("root", "pos").alias("firm"))
    return refs.withColumn("ref", F.concat_ws("|", "rid", "slot", F.col("pos").cast("string"))).join(firm, "ref", "left").drop("ref")


def main_firm(records: DataFrame, resolved: DataFrame) -> DataFrame:
    """(rid, firm): the first company with a firm in the order of the event's type."""
    kinds = records.select("rid", F.col("event.event_type").alias("event_type"))
    slot, kind = F.col("slot"), F.col("event_type")
    rank = (
        F.when(kind.startswith("M&A") & (slot == "acquirer"), 0).when(kind.startswith("M&A") & (slot == "target"), 1)
        .when(kind.isin("CEO_change", "CFO_change", "Stock_split") & (slot == "company"), 0).when((kind == "IPO") & (slot == "issuer"), 0).when(slot == "primary", 2)
    )
    ranked = resolved.join(kinds, "rid").where("firm is not null").withColumn("rank", rank).where("rank is not null")
    return ranked.groupBy("rid").agg(F.min_by("firm", F.struct("rank", "pos")).alias("firm"))


def identity_keys(records: DataFrame, resolved: DataFrame, firms: DataFrame) -> DataFrame:
    """(rid, k): records that share a key report one event. Without a main firm only the hint counts."""
    e = "event"
    d = "event.details"
    base = records.join(firms, "rid", "left").select("rid", "firm", F.col(f"{e}.event_type").alias("t"), F.lower(F.trim(f"{e}.duplicate_cluster_key_hint")).alias("hint"), day(f"{e}.event_date").alias("on"), F.col(d).alias("x"))
    sides = resolved.where("firm is not null and slot in ('acquirer', 'target')").select("rid", "slot", F.col("firm").alias("f")).distinct()
    pairs = sides.where("slot = 'acquirer'").select("rid", F.col("f").alias("a")).join(sides.where("slot = 'target'").select("rid", F.col("f").alias("b")), "rid")
    bucket = C.value_bucket(F.col("x.deal_value.amount"), F.coalesce("x.deal_value.scale", F.lit("units")))
    money = F.concat_ws("_", F.format_string("%.2e", bucket), F.coalesce("x.deal_value.currency", F.lit("USD")))
    key = lambda *parts: F.when(F.greatest(*[p.isNull().cast("int") for p in parts], F.lit(0)) == 0, F.concat_ws("|", *[p.cast("string") for p in parts]))
    l = F.lit  # noqa: E741
    t, firm = F.col("t"), F.col("firm")
    person = F.coalesce(F.nullif("x.person.normalized_name", l("")), F.nullif(F.replace(F.lower("x.person.full_name"), l(" "), l("_")), l("")))
    executive, ipo, split = t.isin("CEO_change", "CFO_change"), t == "IPO", t == "Stock_split"
    own = [key(l("type_firm_date"), t, firm, F.col("on"))]
    own += [F.when(executive, k) for k in (key(l("exec_person_action"), t, firm, person, F.col("x.action")), key(l("exec_person"), t, firm, person), *[key(l("exec_date"), t, firm, day(f"x.{c}")) for c in ("announcement_date", "effective_date", "departure_date", "appointment_date")])]
    own += [F.when(ipo, k) for k in (key(l("ipo_price"), firm, F.nullif("x.offer_price.amount", l(0.0)), F.coalesce("x.offer_price.currency", l("USD"))), *[key(l("ipo_date"), firm, day(f"x.{c}")) for c in ("pricing_date", "first_trading_date", "registration_filing_date")])]
    own += [F.when(split, k) for k in (key(l("split_ratio"), firm, F.nullif(F.trim("x.ratio.ratio_text"), l(""))), *[key(l("split_date"), firm, day(f"x.{c}")) for c in ("effective_date", "announcement_date", "record_date")])]
    hints = base.where("hint <> ''").select("rid", F.concat_ws("|", l("hint"), "hint").alias("k"))
    keyed = base.where("firm is not null").select("rid", F.explode(F.array_compact(F.array(*own))).alias("k"))
    deal = base.where("firm is not null").join(pairs, "rid").where(t.startswith("M&A"))
    a, b = F.col("a"), F.col("b")
    both = [key(l("announced"), t, a, b, day("x.announcement_date")), key(l("value"), t, a, b, F.when(bucket.isNotNull(), money)), key(l("closing"), t, a, b, day("x.closing_date")), key(l("signing"), t, a, b, day("x.signing_date"))]
    return hints.unionByName(keyed).unionByName(deal.select("rid", F.explode(F.array_compact(F.array(*both))).alias("k"))).distinct()


def deal_keys(records: DataFrame, resolved: DataFrame) -> DataFrame:
    """(rid, k): signatures of M&A records that chain the stages of one deal, over all acquirers and all targets together."""
    ma = records.where(F.col("event.event_type").startswith("M&A"))
    side = lambda s: resolved.where((F.col("slot") == s) & F.col("firm").isNotNull()).groupBy("rid").agg(F.array_join(F.array_sort(F.collect_set("firm")), ",").alias(s))
    bucket = C.value_bucket(F.col("event.details.deal_value.amount"), F.coalesce("event.details.deal_value.scale", F.lit("units")))
    x = ma.select("rid", F.lower(F.trim("event.duplicate_cluster_key_hint")).alias("hint"), day("event.details.announcement_date").alias("ann"), day("event.event_date").alias("on"), F.format_string("%.2e", bucket).alias("v"), bucket.isNotNull().alias("valued"), F.coalesce("event.details.deal_value.currency", F.lit("USD")).alias("ccy"))
    both = x.join(side("acquirer"), "rid").join(side("target"), "rid")
    signs = F.array(
        F.when(F.col("ann").isNotNull(), F.concat_ws("|", F.lit("ann"), "acquirer", "target", F.col("ann").cast("string"))),
        F.when(F.col("on").isNotNull(), F.concat_ws("|", F.lit("ev"), "acquirer", "target", F.col("on").cast("string"))),
        F.when(F.col("valued"), F.concat_ws("|", F.lit("dv"), "acquirer", "target", "v", "ccy")),
    )
    return x.where("hint <> ''").select("rid", F.concat_ws("|", F.lit("ck"), "hint").alias("k")).unionByName(both.select("rid", F.explode(F.array_compact(signs)).alias("k"))).distinct()


def voted(df: DataFrame, fields: list[str]) -> DataFrame:
    """(cluster, fields): the majority of each field, in one pass over (cluster, field, value)."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in fields]))
    long = df.select("cluster", "rid", each.alias("e")).select(F.struct("cluster", "e.field").alias("k"), "e.v", "rid")
    won = M.majority(long, "k", "v", F.col("rid"))
    return won.groupBy(F.col("k.cluster").alias("cluster")).agg(*[F.max(F.when(F.col("k.field") == f, F.col("v"))).cast(df.schema[f].dataType).alias(f) for f in fields])


def details(records: DataFrame, clusters: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The details of M&A, of executive changes, IPOs and stock splits: one row per event, its type that of the first record."""
    d, rid, on = "event.details", F.col("rid"), F.col("article_date")
    members = records.join(clusters, "rid")
    kinds = members.groupBy("cluster").agg(F.min_by("event.event_type", "rid").alias("kind"))
    members = members.join(kinds, "cluster")
    date = lambda c: M.best_date(day(f"{d}.{c}"), F.col(f"{d}.{c}.precision"), on, rid).alias(c)
    money = lambda c: M.latest_money(*[F.col(f"{d}.{c}.{k}") for k in ("amount", "currency", "scale")], on, rid).alias(c)
    longest = lambda c: M.longest(F.col(f"{d}.{c}"), on, rid).alias(c)
    latest = lambda c: M.latest(F.col(f"{d}.{c}"), on, rid).alias(c)
    flag = lambda c: M.any_true(F.col(f"{d}.{c}")).alias(c)

    def table(of: DataFrame, votes: dict[str, str], merged: list[Column], out: list) -> DataFrame:
        one = of.groupBy("cluster", "kind").agg(*merged)
        chosen = voted(of.select("cluster", "rid", *[F.col(path).alias(c) for c, path in votes.items()]), list(votes))
        return one.join(chosen, "cluster").select(C.surrogate(F.col("cluster")).alias("event_id"), *out)

    own = lambda *names: {c: f"{d}.{c}" for c in names}
    ma = table(
        members.where(F.col("kind").startswith("M&A")), own("ma_event_subtype", "transaction_form", "consideration_type") | {"cluster_key_hint": "event.duplicate_cluster_key_hint"},
        [longest("deal_name"), latest("deal_status"), money("deal_value"), money("per_share_price"), *map(date, ("announcement_date", "signing_date", "expected_closing_date", "closing_date")), longest("strategic_rationale")],
        [F.coalesce("ma_event_subtype", "kind").alias("ma_event_subtype"), "deal_name", "transaction_form", "deal_status", "consideration_type", *[F.col(f"deal_value.{k}").alias(f"deal_value_{k}") for k in ("amount", "currency", "scale")], F.col("per_share_price.amount").alias("per_share_price_amount"), "announcement_date", "signing_date", "expected_closing_date", "closing_date", "cluster_key_hint", "strategic_rationale"],
    )
    person = F.min_by(f"{d}.person", F.when(F.col(f"{d}.person.full_name") != "", rid)).alias("person")
    executive = table(
        members.where(F.col("kind").isin("CEO_change", "CFO_change")), own("action", "departure_reason", "appointment_source"),
        [person, longest("prior_title"), longest("new_title"), date("announcement_date"), date("effective_date"), flag("is_interim_or_acting")],
        [F.substring("kind", 1, 3).alias("role"), "action", F.col("person.full_name").alias("person_full_name"), F.col("person.normalized_name").alias("person_normalized"), "departure_reason", "appointment_source", "prior_title", "new_title", "announcement_date", "effective_date", "is_interim_or_acting"],
    )
    ipo = table(
        members.where("kind = 'IPO'"), own("offering_type", "exchange", "ticker"),
        [latest("ipo_stage"), flag("is_first_public_listing"), flag("is_spac_ipo"), date("pricing_date"), date("first_trading_date"), money("offer_price")],
        ["ipo_stage", "offering_type", "is_first_public_listing", "is_spac_ipo", "exchange", "ticker", "pricing_date", "first_trading_date", F.col("offer_price.amount").alias("offer_price_amount"), F.col("offer_price.currency").alias("offer_price_currency")],
    )
    ratio = ("ratio_text", "new_shares", "old_shares", "share_count_multiplier")
    split = table(
        members.where("kind = 'Stock_split'"), own("split_type") | {c: f"{d}.ratio.{c}" for c in ratio},
        [date("announcement_date"), date("effective_date")],
        ["split_type", *ratio, "announcement_date", "effective_date"],
    )
    return ma, executive, ipo, split


def canonicalise(records: DataFrame, register_singletons: bool = False) -> Star:
    """The star schema of extraction records (rid, article_id, article_date, title, url, event); rid is unique and orders them."""
    records = stash(records, "records")
    resolved = stash(resolve(company_refs(records), register_singletons), "resolved")
    firms = stash(main_firm(records, resolved), "main")
    clusters = stash(C.connected_components(C.hub_edges(identity_keys(records, resolved, firms), "rid", "k"), records.select(F.col("rid").alias("id"))).select(F.col("id").alias("rid"), F.col("root").alias("cluster")), "clusters")
    chained = deal_keys(records, resolved).join(clusters, "rid")
    deals = C.connected_components(C.hub_edges(chained, "cluster", "k"), records.where(F.col("event.event_type").startswith("M&A")).join(clusters, "rid").select(F.col("cluster").alias("id")))
    deals = stash(deals.select(F.col("id").alias("cluster"), C.surrogate(F.col("root")).alias("deal_id")), "deals")
    event_id = C.surrogate(F.col("cluster")).alias("event_id")

    named = resolved.where("firm is not null")
    longest = lambda c: F.min_by(f"c.{c}", F.when(F.col(f"c.{c}").isNotNull() & (F.trim(f"c.{c}") != ""), F.struct((-F.length(f"c.{c}")).alias("n"), "rid", "slot", "pos")))
    firm_table = named.groupBy("firm").agg(F.upper(longest("ticker")).alias("canonical_ticker"), longest("normalized_name").alias("canonical_name"), F.min_by("c.name", F.when(F.col("c.name").isNotNull(), F.struct("rid", "slot", "pos"))).alias("name_raw"))
    aliases = atoms_of(named).join(named.select(F.concat_ws("|", "rid", "slot", F.col("pos").cast("string")).alias("ref"), "firm"), "ref").select(C.surrogate(F.col("firm")).alias("firm_id"), F.split_part("atom", F.lit(":"), F.lit(1)).alias("atom_type"), F.regexp_replace("atom", "^[^:]*:", "").alias("atom_value")).distinct()

    r = records.join(clusters, "rid").join(firms, "rid", "left").select("cluster", "rid", "article_date", "firm", F.col("event.event_type").alias("event_type"), F.col("event.event_status").alias("event_status"), F.col("event.event_date_basis").alias("basis"), day("event.event_date").alias("on"), F.col("event.event_date.precision").alias("precision"), F.col("event.event_date.text").alias("date_text"), F.col("event.headline_summary").alias("headline"), F.col("event.geography").alias("geography"))
    rid = F.col("rid")
    merged = r.groupBy("cluster").agg(
        F.min_by("event_type", "rid").alias("event_type"),
        F.min_by("firm", F.when(F.col("firm").isNotNull(), rid)).alias("firm"),
        M.best_date(F.when(F.col("on").isNotNull(), F.struct("on", "precision")), F.col("precision"), F.col("article_date"), rid).alias("dated"),
        M.longest(F.col("date_text"), F.col("article_date"), rid).alias("event_date_text"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("headline").isNotNull(), F.struct("rid", "headline")))), lambda x: x["headline"]).alias("headline_summaries"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("geography")))).alias("geography"),
        F.count(F.lit(1)).cast("int").alias("raw_extraction_count"),
    )
    for c in ("event_status", "basis"):
        merged = merged.join(M.majority(r, "cluster", c, rid), "cluster", "left")
    events = merged.join(deals, "cluster", "left").join(firm_table.select("firm", "canonical_ticker"), "firm", "left")
    events = events.select(event_id, "event_type", C.surrogate(F.col("firm")).alias("firm_id"), F.col("canonical_ticker").alias("firm_ticker"), F.col("dated.on").alias("event_date_value"), F.col("dated.precision").alias("event_date_precision"), "event_date_text", F.col("basis").alias("event_date_basis"), "headline_summaries", "geography", "event_status", "raw_extraction_count", "deal_id")

    roles = named.where("slot in ('acquirer', 'target', 'seller', 'primary')").join(clusters, "rid").select("cluster", F.col("slot").alias("role"), "firm", F.col("c.name").alias("name"), F.col("c.normalized_name").alias("normalized_name"), F.col("c.ticker").alias("ticker"), F.struct("rid", "pos").alias("i"))
    listed = roles.where("normalized_name <> ''").groupBy("cluster", "role", "normalized_name").agg(*[F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col("i"))).alias(c) for c in ("firm", "name", "ticker")])
    companies = listed.select(event_id, "role", C.surrogate(F.col("firm")).alias("firm_id"), "name", "normalized_name", "ticker")
    sources = records.join(clusters, "rid").select(event_id, "article_id", "article_date", "title", "url").distinct()
    ordered = events.where("deal_id is not null").join(records.join(clusters, "rid").groupBy("cluster").agg(F.min("rid").alias("first")).select(event_id, "first"), "event_id")
    slots = M.slots(ordered, "deal_id", F.col("event_type"), {"M&A_announce": "announce_event_id", "M&A_complete": "complete_event_id", "M&A_cancel": "cancel_event_id"}, "event_id", F.col("first"))
    firm_rows = firm_table.select(C.surrogate(F.col("firm")).alias("firm_id"), "canonical_ticker", "canonical_name", "name_raw").join(aliases.groupBy("firm_id").agg(F.count(F.lit(1)).cast("int").alias("n_aliases")), "firm_id", "left")
    return Star(firm_rows, aliases, events, companies, sources, slots, *details(records, clusters))
