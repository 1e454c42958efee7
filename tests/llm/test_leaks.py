import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from evtide.llm import leaks as L

ITEMS = ["Witness sheet 123 dates the reverse split of Alpha Foods to 3 May 2019 and names the desk in Leeds as holder of the docket.", "a b c d e f g h i j k l m n o", "too short to leak"]


def brute(texts, items=ITEMS):
    words = [L.letters(i).split() for i in items]
    out = set()
    for t, text in enumerate(texts):
        joined = L.letters(text)
        for i, w in enumerate(words):
            if any(b" " + b" ".join(w[k : k + L.RUN]) + b" " in joined for k in range(len(w) - L.RUN + 1)):
                out.add((t, i))
    return out


TEXTS = [
    "x. " + ITEMS[0] + " y",
    "WITNESS <b>sheet</b> 123,\ndates the re\xadvers\u200be split of Alpha Fооds to 3 May 2019",
    "Witness sheet 123 dates the reverse split of Alpha Foods to 3 June 2019 and names",
    "of Alpha Foods to 3 May 2019 and names the desk in",
    "xa b c d e f g h i j k l m",
    "a-b-c-d-e-f-g-h-i-j-k-l-m",
    "b c d e f g h i j k l m nn",
    "",
    "\u200b",
    "<p>" * 50,
    ITEMS[1] + " " + ITEMS[0],
    'witness sheet 123 dates <a href="' + "x" * 3000 + '">the reverse split</a> of alpha foods to 3 may 2019 and',
    "witness sheet 123 dates the reverse if a <b then split> of alpha foods to 3 may 2019 and",
]


def found(spark, texts, items=ITEMS, edits=L.EDITS):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc bigint, body string")
    wanted = spark.createDataFrame(list(enumerate(items)), "item bigint, t string")
    return {(r.id, r.item_id): r.n_edits for r in L.find_leaks(docs, "doc", "body", wanted, "item", "t", edits).collect()}


def test_random_like_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [w for i in ITEMS for w in i.split()]
    texts = list(TEXTS)
    for _ in range(300):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 30))]
        item = rng.choice(ITEMS[:2]).split()
        k = rng.randint(0, len(item) - 5)
        words[rng.randint(0, len(words)) : 0] = item[k : k + rng.randint(8, 18)]
        texts.append(" ".join(words))
    for edits in (0, 1, 2):
        assert {k for k, n in found(spark, texts, edits=edits).items() if n == 0} == brute(texts)
    assert {(0, 0), (1, 0), (5, 1), (10, 0), (10, 1), (11, 0)} <= brute(texts)


def test_planted_passages_with_edits(spark):
    """Recall of passages with one and two edits: letters changed, put in or left out anywhere inside."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    items = [" ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(20)]
    texts, want = [], {}
    for i in range(200):
        e, item = i % 3, rng.randrange(len(items))
        words = items[item].split()
        k = rng.randint(0, len(words) - L.RUN)
        passage = list(" ".join(words[k : k + L.RUN]))
        for place in rng.sample(range(1, len(passage) - 1), e):
            how = rng.random()
            passage[place] = passage[place] + "q" if how < 0.3 else "" if how < 0.5 else "z"
        texts.append(" ".join(rng.choice(vocabulary) for _ in range(50)) + " " + "".join(passage) + " " + " ".join(rng.choice(vocabulary) for _ in range(50)))
        want[i, item] = e
    got = found(spark, texts, items, edits=2)
    assert set(got) == set(want)
    assert all(got[k] <= e for k, e in want.items()) and sum(got[k] == e for k, e in want.items()) > 180
    assert set(found(spark, texts, items, edits=1)) == {k for k, e in want.items() if e <= 1 or got[k] <= 1}


def plain_edits(p, t):
    """The least edits between p and any stretch of t."""
    last = [0] * (len(t) + 1)
    for i, x in enumerate(p, 1):
        now = [i]
        for j, y in enumerate(t, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return min(last)


@settings(max_examples=200, deadline=None)
@given(st.text("ab", min_size=1, max_size=8), st.text("ab", max_size=10))
def test_alignment_over_all_diagonals_is_the_whole_one(p, t):
    pattern, text = (np.frombuffer(x.encode() or b"-", np.uint8) for x in (p, t))
    columns = len(p) + len(t) + 1
    got = L.banded_edits(pattern, np.array([0]), np.array([len(p)]), text, np.array([-len(p)]), np.array([0]), np.array([len(t)]), columns)
    assert got[0] == plain_edits(p, t)


def test_table(spark):
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(TEXTS)] + [(98, None, "z"), (0, TEXTS[0], "z"), (0, "other", "z"), (99, "long " * 200_000 + TEXTS[0], "z")], "doc bigint, body string, item_id string")
    items = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ITEMS)] + [(7, None, 1), (None, ITEMS[0], 1), (0, ITEMS[0], 1), (0, ITEMS[1], 1)], "item bigint, item_text string, id int")
    got = [(r.id, r.item_id) for r in L.find_leaks(docs, "doc", "body", items, "item", "item_text").where("n_edits = 0").collect()]
    assert set(got) == brute(TEXTS) | {(99, 0), (5, 0)} and len(got) == len(set(got))
    assert L.find_leaks(docs, "doc", "body", items.where("false"), "item", "item_text").count() == 0
    assert L.find_leaks(docs.where("false"), "doc", "body", items, "item", "item_text").count() == 0


def test_batches_without_suspects(spark):
    """Texts that share no passage with an item, alone, beside others, and as a whole stretch of CHARS characters before one that does."""
    assert found(spark, ["nothing of it"] * 9) == {}
    assert found(spark, ["nothing of it"] * 9 + [TEXTS[0]]) == {(9, 0): 0}
    docs = spark.createDataFrame([(0, "long " * (L.CHARS // 5 + 1)), (1, TEXTS[0]), (2, "long " * (L.CHARS // 5 + 1))], "doc bigint, body string").coalesce(1)
    items = spark.createDataFrame(list(enumerate(ITEMS)), "item bigint, t string")
    assert [tuple(r) for r in L.find_leaks(docs, "doc", "body", items, "item", "t").collect()] == [(1, 0, 0)]
