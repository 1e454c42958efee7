import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from evtide.llm import names as N


def link(spark, names, refs, tickers=()):
    n = spark.createDataFrame([(x, "extra") for x in names], "raw string, entity string")
    r = spark.createDataFrame(list(refs), "entity string, name string")
    t = spark.createDataFrame(list(tickers), "entity string, t string")
    return {x["name"]: x["entity"] for x in N.link_names(n, "raw", r, "entity", "name", t).collect()}


REFS = [("f1", "melvermo_consolidated_insurance_co"), ("f2", "jiampella_media_holdings"), ("f3", "jiampella_water_co"), ("f4", "tethume_water_plc"), ("f4", "old_lantern"), ("f5", "silver_anvil"), *[(f"g{i}", f"{w}ax_{b}_inc") for i, (w, b) in enumerate([("bort", "water"), ("drim", "media"), ("gelf", "insurance"), ("prok", "water"), ("stuv", "media"), ("zond", "insurance"), ("quim", "water"), ("xerb", "media"), ("vanth", "insurance"), ("lomp", "consolidated"), ("nard", "consolidated"), ("hesk", "consolidated"), ("wilp", "consolidated"), ("jand", "insurance"), ("kurf", "consolidated"), ("yolk", "media")])]]


def test_variants_and_other_firms(spark):
    same = {"Melvermo Cons. Ins.": "f1", "Mlevermo Consolidated Inurance & Co.": "f1", "Melve rmo Consolidated Insurance": "f1", "Insurance, Melvermo Consolidated": "f1", "MELVERMO": "f1", "Mélvermo Insurance": "f1", "the Old Lantern": "f4", "Silver Anvl": "f5", "Anvil Silver": "f5", "Tethume": "f4", "JiampellaMedia": "f2", "Jiampella Watre": "f3", "MCIC": "f1", "TTH": "f4", "Tethume Water (XNYS: TTH)": "f4"}
    other = ["Jiampella", "Jiampella Chemical", "Melvermo Media", "Someone Else Insurance", "", "  ", "-", None, "x" * 5000, "Water"]
    got = link(spark, [*same, *other, "MELVERMO"], REFS, [("f4", "TTH"), (None, "X"), ("f2", None)])
    assert got == same


def test_empty(spark):
    assert link(spark, [], REFS) == {}
    assert link(spark, ["Melvermo"], []) == {}
    assert link(spark, ["Melvermo", None], [(None, "melvermo"), ("f1", None), ("f1", "n/a")]) == {}


def test_banding_keeps_what_the_curve_promises():
    b, r = N.choose_bands()
    assert 1 - (1 - N.TARGET_SIMILARITY**r) ** b >= N.TARGET_RECALL
    rng = np.random.default_rng(0)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    words = ["".join(rng.choice(letters, 8)) for _ in range(400)]
    typos = [w[:3] + w[4] + w[3] + w[5:] for w in words]
    a, c = N.band_keys(words, b, r), N.band_keys(typos, b, r)
    assert (a == c).any(1).mean() >= 0.97
    assert (a == np.roll(c, 1, 0)).any(1).mean() <= 0.2


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
def test_edits_like_the_plain_recurrence(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    assert N.edits(a, b) == d[len(a), len(b)]


def test_resolved_rows_are_found_again(spark, base):
    """Held-out accuracy: the names of events whose firm is known."""
    from evtide.runtime import read

    known = read(spark, base, "corp_events").where("firm_id like 'firm_c%' and firm_name_raw is not null").select("firm_id", "firm_name_raw").distinct()
    refs, tickers = N.firm_references(read(spark, base, "firm_canonical"), read(spark, base, "firm_alias"))
    got = known.join(N.link_names(known, "firm_name_raw", refs, "firm_id", "name", tickers), known["firm_name_raw"] == N.F.col("name"), "left").toPandas()
    assert (got["entity"] == got["firm_id"]).mean() > 0.97
    assert (got["entity"].notna() & (got["entity"] != got["firm_id"])).mean() < 0.005
