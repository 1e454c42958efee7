"""The eighteen query templates as plans over the typed views.

Each builder takes the views and the parameters of a question and returns a lazy DataFrame, one row per answer item.
Windows are inclusive. Event ids stay in the result, so that provenance is one join for all answers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evtide.plans.views import Views

Params = dict[str, object]

#: Role names of questions and of the junction.
ROLES = {"buyer": "acquirer", "target": "target", "seller": "seller"}


def role_name(role: str) -> str:
    """The junction's name of a role; unknown names in lower case."""
    return ROLES.get(role.lower(), role.lower())


def within(day: Column, p: Params, start: str = "W_start", end: str = "W_end") -> Column:
    return day.between(F.lit(p[start]).cast("date"), F.lit(p[end]).cast("date"))


def _typed(v: Views, p: Params, types: str | list[str], firm: bool = True) -> DataFrame:
    wanted = [types] if isinstance(types, str) else types
    out = v.events.where(F.col("event_type").isin(*wanted) & within(F.col("day"), p))
    return out.where("firm is not null") if firm else out


def answer(df: DataFrame) -> DataFrame:
    return df.select(F.col("firm").alias("firm_ticker"), "event_type", F.date_format("day", "yyyy-MM-dd").alias("anchor_date"), "event_id")


def _is(ticker: object) -> Column:
    """Whether an event's firm is this one; tickers compare without case."""
    return F.upper("firm") == str(ticker).upper()


def a11(v: Views, p: Params) -> DataFrame:
    """Events of a type in a window."""
    return answer(_typed(v, p, p["E"]))


def a12(v: Views, p: Params) -> DataFrame:
    """Distinct firms with such events, with the first and last event id as evidence."""
    return _typed(v, p, p["E"]).groupBy(F.col("firm").alias("firm_ticker")).agg(F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


def _of_firm(v: Views, p: Params, types: str | list[str]) -> DataFrame:
    """Events that the firm takes part in, as main firm or in any role, whatever the case of its ticker; a missing main firm is the firm asked for."""
    mine = v.companies.where(F.upper("ticker") == str(p["F"]).upper()).select("event_id", F.lit(True).alias("member")).distinct()
    events = _typed(v, p, types, firm=False).join(mine, "event_id", "left")
    return events.where((F.upper("firm") == str(p["F"]).upper()) | F.col("member")).withColumn("firm", F.coalesce("firm", F.lit(p["F"])))


def a21(v: Views, p: Params) -> DataFrame:
    """Events of a type that a firm takes part in."""
    return answer(_of_firm(v, p, p["E"]))


def _in_role(v: Views, p: Params, types: str | list[str], start: str = "W_start", end: str = "W_end") -> DataFrame:
    events = v.events.where(F.col("event_type").isin(*([types] if isinstance(types, str) else types)) & within(F.col("day"), p, start, end)).drop("firm")
    members = v.companies.where((F.col("role") == role_name(str(p["R"]))) & F.col("ticker").isNotNull()).select("event_id", F.col("ticker").alias("firm"))
    return events.join(members, "event_id")


def a31(v: Views, p: Params) -> DataFrame:
    """Firms in a role with their events."""
    return answer(_in_role(v, p, p["E"]).select("firm", "event_type", "day", "event_id").distinct())


def b11(v: Views, p: Params) -> DataFrame:
    """Other firms' events strictly before or after the first such event of the anchor firm; nothing without one."""
    events = _typed(v, p, p["E"])
    own = _is(p["F_anchor"])
    anchor = events.where(own).agg(F.min("day").alias("d")).scalar()
    beyond = F.col("day") < anchor if p["direction"] == "before" else F.col("day") > anchor
    return answer(events.where(~own & beyond))


def band_join(left: DataFrame, right: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """Pairs of equal key with low <= right day - left day <= high, as (key, id1, day1, id2, day2).

    Both sides are (key, event_id, day). Days fall into buckets of the band's width and the right side goes to the two
    or three buckets that its band can meet: rows of a hot key spread over its days, and each pair meets once.
    """
    width = max(high - low, 1) + 1
    bucket = lambda d: F.floor(d / F.lit(width))
    day = F.unix_date("day")
    a = left.select(key, F.col("event_id").alias("id1"), F.col("day").alias("day1"), bucket(day).alias("bucket"))
    b = right.select(key, F.col("event_id").alias("id2"), F.col("day").alias("day2"), F.explode(F.sequence(bucket(day - high), bucket(day - low))).alias("bucket"))
    return a.join(b, [key, "bucket"]).where(F.datediff("day2", "day1").between(low, high)).drop("bucket")


def b12(v: Views, p: Params) -> DataFrame:
    """Pairs of events of two types of one firm at most gap days apart, in any order."""
    pairs = band_join(_typed(v, p, p["E1"]).distinct(), _typed(v, p, p["E2"]).distinct(), "firm", -int(p["gap_days"]), int(p["gap_days"]))
    return pairs.select(F.col("firm").alias("firm_ticker"), F.date_format("day1", "yyyy-MM-dd").alias("e1_anchor_date"), F.date_format("day2", "yyyy-MM-dd").alias("e2_anchor_date"), F.abs(F.datediff("day2", "day1")).cast("bigint").alias("gap_days"), "id1", "id2").distinct()


def b13(v: Views, p: Params) -> DataFrame:
    """Pairs of a trigger and a follow-up of one firm, the follow-up at most lag days later."""
    pairs = band_join(_typed(v, p, p["E_trigger"]).distinct(), _typed(v, p, p["E_followup"]).distinct(), "firm", 0, int(p["lag_days"]))
    return pairs.select(F.col("firm").alias("firm_ticker"), F.date_format("day1", "yyyy-MM-dd").alias("e_trigger_anchor_date"), F.date_format("day2", "yyyy-MM-dd").alias("e_followup_anchor_date"), F.datediff("day2", "day1").cast("bigint").alias("lag_days"), "id1", "id2").distinct()


def by_identity(v: Views, p: Params, first: str, second: str, low: int, high: int) -> DataFrame:
    """Pairs as in B.1.2 and B.1.3, one row per firm and two dates, which is what identifies an answer: with the first event of either date and how many pairs there are.

    Events of one firm, type and day are brought together before the join, so a firm with ever more events gives no more
    rows than its days and the band allow; pairs of single events grow with the square.
    """
    days = lambda e: _typed(v, p, e).groupBy("firm", "day").agg(F.min("event_id").alias("event_id"), F.count_distinct("event_id").alias("n"))
    a, b = days(first), days(second)
    pairs = band_join(a.drop("n"), b.drop("n"), "firm", low, high)
    sized = pairs.join(a.select("firm", F.col("day").alias("day1"), F.col("n").alias("n1")), ["firm", "day1"]).join(b.select("firm", F.col("day").alias("day2"), F.col("n").alias("n2")), ["firm", "day2"])
    return sized.select(F.col("firm").alias("firm_ticker"), F.date_format("day1", "yyyy-MM-dd").alias("first_date"), F.date_format("day2", "yyyy-MM-dd").alias("second_date"), F.datediff("day2", "day1").cast("bigint").alias("days"), "id1", "id2", (F.col("n1") * F.col("n2")).alias("n_pairs"))


def b14(announced: DataFrame, completed: DataFrame, p: Params) -> DataFrame:
    """Deals announced in a window and completed within a horizon, matched by hint or by buyer and target.

    A join on either of two keys is two equi-joins and a distinct union. One row per buyer, target and announcement,
    with the first completion.
    """
    a = announced.where(within(F.col("day"), p) & F.col("buyer").isNotNull() & F.col("target").isNotNull()).select("hint", "buyer", "target", F.col("day").alias("announced"))
    c = completed.select(F.col("hint").alias("c_hint"), F.col("buyer").alias("c_buyer"), F.col("target").alias("c_target"), F.col("day").alias("closed"))
    soon = F.datediff("closed", "announced").between(0, int(p["horizon_days"]))
    kept = ("buyer", "target", "announced", "closed")
    by_hint = a.join(c, (F.col("hint") == F.col("c_hint")) & soon).select(*kept)
    by_pair = a.join(c, (F.col("buyer") == F.col("c_buyer")) & (F.col("target") == F.col("c_target")) & soon).select(*kept)
    pairs = by_hint.unionByName(by_pair)
    return pairs.groupBy(F.col("buyer").alias("buyer_ticker"), F.col("target").alias("target_ticker"), F.date_format("announced", "yyyy-MM-dd").alias("announce_date")).agg(F.date_format(F.min("closed"), "yyyy-MM-dd").alias("close_date"))


def sides(v: Views, event_type: str) -> DataFrame:
    """(hint, buyer, target, day) of the events of a type: a row for each buyer with each target, nulls where an event has none."""
    of = lambda role, name: v.companies.where((F.col("role") == role) & F.col("ticker").isNotNull()).select("event_id", F.col("ticker").alias(name)).distinct()
    events = v.events.where((F.col("event_type") == event_type) & F.col("day").isNotNull()).select("event_id", "day").distinct()
    placed = events.join(of("acquirer", "buyer"), "event_id", "left").join(of("target", "target"), "event_id", "left")
    hinted = placed.join(v.hints, "event_id", "left") if v.hints is not None else placed.withColumn("hint", F.lit(None).cast("string"))
    return hinted.select("hint", "buyer", "target", "day").distinct()


def b14_of_views(v: Views, p: Params) -> DataFrame:
    """B.1.4 over the views: announcements and completions with their buyers and targets."""
    return b14(sides(v, str(p.get("E_announce", "M&A_announce"))), sides(v, str(p.get("E_complete", "M&A_complete"))), p)


def b15(v: Views, p: Params) -> DataFrame:
    """Days from a firm's first event of one type in the window to its next of another, however late: one row or none."""
    mine = v.events.where(_is(p["F"]) & F.col("event_type").isin(p["E1"], p["E2"]))
    first = mine.where((F.col("event_type") == p["E1"]) & within(F.col("day"), p)).agg(F.min("day").alias("d1"))
    second = mine.where((F.col("event_type") == p["E2"]) & (F.col("day") >= first.scalar())).agg(F.min("day").alias("d2"))
    return second.select(F.lit(p["F"]).alias("firm_ticker"), F.date_format(first.scalar(), "yyyy-MM-dd").alias("e1_anchor_date"), F.date_format("d2", "yyyy-MM-dd").alias("e2_anchor_date"), F.datediff("d2", first.scalar()).cast("bigint").alias("days_between")).where("days_between is not null")


def b15_contract(v: Views, p: Params) -> DataFrame:
    """Signed days between a firm's first events of two types, both in the window: one row or none."""
    mine = v.events.where(_is(p["F"]) & within(F.col("day"), p))
    ends = mine.agg(F.min(F.when(F.col("event_type") == p["E1"], F.col("day"))).alias("d1"), F.min(F.when(F.col("event_type") == p["E2"], F.col("day"))).alias("d2"))
    return ends.where("d1 is not null and d2 is not null").select(F.lit(p["F"]).alias("firm_ticker"), F.date_format("d1", "yyyy-MM-dd").alias("e1_anchor_date"), F.date_format("d2", "yyyy-MM-dd").alias("e2_anchor_date"), F.datediff("d2", "d1").cast("bigint").alias("days_between"))


def b21(v: Views, p: Params, ties: bool = True) -> DataFrame:
    """The first or last event of a type in the window: all on that day, or one."""
    events = _typed(v, p, p["E"])
    first = p["position"] == "first"
    if ties:
        edge = events.agg((F.min if first else F.max)("day").alias("d")).scalar()
        return answer(events.where(F.col("day") == edge))
    order = F.asc("day") if first else F.desc("day")
    return answer(events.orderBy(order, "firm", "event_id").limit(1))


def b22(v: Views, p: Params) -> DataFrame:
    """A firm's events of several types in order, with their positions. The window is over one firm's answers."""
    mine = _of_firm(v, p, list(p["E_set"])).distinct()
    return answer(mine).withColumn("position", F.row_number().over(Window.partitionBy(F.lit(p["F"])).orderBy("anchor_date", "event_type", "event_id")))


def _both(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select(F.col("firm").alias("firm_ticker")).intersect(right.select(F.col("firm").alias("firm_ticker")))


def b31(v: Views, p: Params) -> DataFrame:
    """Firms with events of both types in the window."""
    return _both(_typed(v, p, p["E1"]), _typed(v, p, p["E2"]))


def b32(v: Views, p: Params) -> DataFrame:
    """Firms in a role in both windows."""
    return _both(_in_role(v, p, p["E"], "W1_start", "W1_end"), _in_role(v, p, p["E"], "W2_start", "W2_end"))


def b33(v: Views, p: Params) -> DataFrame:
    """Firms in a role under both types."""
    return _both(_in_role(v, p, p["E1"]), _in_role(v, p, p["E2"]))


def b41(v: Views, p: Params) -> DataFrame:
    """Firms with at least N events of a type."""
    return _typed(v, p, p["E"]).groupBy(F.col("firm").alias("firm_ticker")).agg(F.count(F.lit(1)).alias("n_events")).where(F.col("n_events") >= p["N"])


def b42(v: Views, p: Params) -> DataFrame:
    """Firms in a role in at least N distinct events."""
    return _in_role(v, p, p["E"]).select("firm", "event_id").distinct().groupBy(F.col("firm").alias("firm_ticker")).agg(F.count(F.lit(1)).alias("n_events")).where(F.col("n_events") >= p["N"])


def bucket_label(day: Column, unit: str) -> Column:
    """ISO week, month or quarter of a day, or the day itself."""
    if unit == "week":
        return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))
    if unit == "month":
        return F.date_format(day, "yyyy-MM")
    if unit == "quarter":
        return F.concat(F.year(day).cast("string"), F.lit("-Q"), F.quarter(day).cast("string"))
    return F.date_format(day, "yyyy-MM-dd")


def b43(v: Views, p: Params) -> DataFrame:
    """Events of a type with the label of their time bucket."""
    return answer(_typed(v, p, p["E"])).withColumn("bucket", bucket_label(F.col("anchor_date").cast("date"), str(p["bucket_unit"])))


def b44(v: Views, p: Params) -> DataFrame:
    """Events of several types, each labelled with its type."""
    return answer(_typed(v, p, list(p["E_set"])))


BUILDERS: dict[str, Callable[[Views, Params], DataFrame]] = {
    "A.1.1": a11, "A.1.2": a12, "A.2.1": a21, "A.3.1": a31, "B.1.1": b11, "B.1.2": b12, "B.1.3": b13, "B.1.4": b14_of_views, "B.1.5": b15, "B.2.1": b21, "B.2.2": b22, "B.3.1": b31, "B.3.2": b32, "B.3.3": b33, "B.4.1": b41, "B.4.2": b42, "B.4.3": b43, "B.4.4": b44,
}


def run(template: str, views: Views, params: Params) -> DataFrame:
    """The plan of one question; KeyError for an unknown template."""
    return BUILDERS[template](views, params)


def cited(answers: DataFrame, sources: DataFrame, *ids: str) -> DataFrame:
    """The answers with cited_urls, the sorted distinct urls of the events named by the id columns: one join for all rows.

    Answers must be distinct. Null urls are left out; answers without any have an empty array.
    """
    keyed = answers.withColumn("_row", F.sha2(F.to_json(F.struct(*answers.columns), {"ignoreNullFields": "false"}), 256))
    each = keyed.select("_row", F.explode(F.array_distinct(F.array(*ids))).alias("event_id"))
    urls = each.join(sources.where("url is not null"), "event_id").groupBy("_row").agg(F.array_sort(F.collect_set("url")).alias("cited_urls"))
    return keyed.join(urls, "_row", "left").withColumn("cited_urls", F.coalesce("cited_urls", F.array().cast("array<string>"))).drop("_row")


def answer_questions(views: Views, questions: list[tuple[str, str, Params]]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """The plans of questions (qid, template, params), and why others have none; one bad question doesn't stop the rest."""
    plans: dict[str, DataFrame] = {}
    failed: dict[str, str] = {}
    for qid, template, params in questions:
        try:
            plans[qid] = run(template, views, params)
        except Exception as e:  # whatever a question's parameters do wrong is reported with its id
            failed[qid] = f"{type(e).__name__}: {e}"
    return plans, failed


#: How each template reads as a question.
PHRASES = {
    "A.1.1": "Which {E} events took place from {W_start} to {W_end}?",
    "A.1.2": "Which firms had a {E} event from {W_start} to {W_end}?",
    "A.2.1": "Which {E} events from {W_start} to {W_end} involve {F} in any role?",
    "A.3.1": "Which firms were {R} in a {E} event from {W_start} to {W_end}?",
    "B.1.1": "Which {E} events of other firms from {W_start} to {W_end} came {direction} the first one of {F_anchor}?",
    "B.1.2": "Which firms had {E1} and {E2} events within {gap_days} days of each other from {W_start} to {W_end}?",
    "B.1.3": "Which {E_trigger} events were followed by {E_followup} of the same firm within {lag_days} days from {W_start} to {W_end}?",
    "B.1.4": "Which deals announced from {W_start} to {W_end} were completed within {horizon_days} days?",
    "B.1.5": "How many days lie between the first {E1} and {E2} of {F} from {W_start} to {W_end}?",
    "B.2.1": "Which {E} event was {position} from {W_start} to {W_end}, ties included?",
    "B.2.2": "In which order did {F} have {E_set} events from {W_start} to {W_end}?",
    "B.3.1": "Which firms had both {E1} and {E2} events from {W_start} to {W_end}?",
    "B.3.2": "Which firms were {R} in {E} events both from {W1_start} to {W1_end} and from {W2_start} to {W2_end}?",
    "B.3.3": "Which firms were {R} in both {E1} and {E2} events from {W_start} to {W_end}?",
    "B.4.1": "Which firms had at least {N} {E} events from {W_start} to {W_end}?",
    "B.4.2": "Which firms were {R} in at least {N} {E} events from {W_start} to {W_end}?",
    "B.4.3": "Which {E} events took place in each {bucket_unit} from {W_start} to {W_end}?",
    "B.4.4": "Which {E_set} events took place from {W_start} to {W_end}, with their types?",
}


def render(template: str, params: Params) -> str:
    """A question in words; lists are joined with commas. KeyError for an unknown template or a missing parameter."""
    return PHRASES[template].format(**{k: ", ".join(map(str, v)) if isinstance(v, (list, tuple)) else v for k, v in params.items()})
