"""Planted leaks of every strength, and a brute-force search over all windows."""

import random

import pyarrow as pa
import pytest

from sievemark.llm.decontaminate import LeakRule, find_leaks
from sievemark.llm.words import plain_words

W = [f"w{i:03d}" for i in range(400)]


def noise(r, n):
    return [f"f{r.randrange(10**6)}" for _ in range(n)]


def edited(r, words, n, ends=True):
    """n different places changed, dropped or followed by another word."""
    out = list(words)
    for p in r.sample(range(0 if ends else 2, len(out) - (0 if ends else 2)), n):
        k = r.random()
        out[p] = f"zz{p}" if k < 0.5 else "" if k < 0.75 else out[p] + f" yy{p}"
    return [w for x in out for w in x.split()]


def leaks(spark, docs, items, **options):
    d = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(docs)], "doc_id bigint, text string")
    t = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id bigint, passage string")
    return {(r["doc_id"], r["item_id"]) for r in find_leaks(d, t, **options).collect()}


@pytest.fixture(scope="module")
def items():
    r = random.Random(8)
    return [[r.choice(W) for _ in range(60)] for _ in range(30)]


def part(r, items, n):
    k = r.randrange(len(items))
    a = r.randrange(len(items[k]) - n + 1)
    return k, items[k][a : a + n]


@pytest.mark.parametrize("rows", [500_000, 0])
def test_spread_edits(spark, items, rows):
    r = random.Random(3)
    docs, want = [], set()
    for i in range(200):
        n = r.choice([24, 30, 45, 60])
        k, words = part(r, items, n)
        size = n // (n // 8)
        cut = [edited(r, words[a : a + size], 1, False) for a in range(0, size * (n // 8), size)]
        docs.append(noise(r, r.randrange(200)) + [w for c in cut for w in c] + words[size * (n // 8) :] + noise(r, r.randrange(200)))
        want.add((i, k))
    assert leaks(spark, docs, items, broadcast_rows=rows) == want


def test_twenty_words(spark, items):
    r = random.Random(4)
    exact, two, docs, want = [], [], [], {}
    for i in range(300):
        k, words = part(r, items, 20)
        docs.append(noise(r, 30) + (words if i < 100 else edited(r, words, 2)) + noise(r, 30))
        want[i] = k
    got = leaks(spark, docs, items)
    assert all((i, want[i]) in got for i in range(100))
    assert sum((i, want[i]) in got for i in range(100, 300)) / 200 >= 0.9
    assert got <= set(want.items())


def test_shorter_quotations(spark, items):
    r = random.Random(5)
    docs = []
    for i in range(300):
        k, words = part(r, items, [14, 17, 18, 19][i % 4])
        gap = noise(r, 40)
        docs.append(gap + words + gap + words + gap)
    assert leaks(spark, docs, items) == set()


def test_forms(spark):
    passage = " ".join(f"Word{i}" for i in range(30)) + ' and "1,234" dollars - one-armed.'
    forms = {1: passage.upper(), 2: passage.replace(" ", " \n> "), 3: f"<p class='{'x' * 500}'>" + passage.replace(" ", " <b></b>") + "</p>", 4: passage.replace("1,234", "1234").replace("-", " "), 5: "Word1 Word2 Word3", 6: None, 7: "", 8: "…", 9: passage.replace("W", "W​") + " tail" * 20000}
    docs = spark.createDataFrame([(k, v, "en", 1) for k, v in forms.items()] + [(1, forms[1], "en", 1), (None, passage, "en", 1)], "doc_id bigint, text string, item_id string, edits int")
    items = spark.createDataFrame([(7, passage, "x"), (8, passage, "x"), (8, passage, "y"), (9, None, "x"), (10, "too short a passage", "x"), (11, "", "x"), (None, passage, "x")], "item_id bigint, passage string, text string")
    rows = find_leaks(docs, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {(d, i) for d in (1, 2, 3, 4, 9, None) for i in (7, 8)} and len(rows) == 12
    assert {r["first_word"] for r in rows} == {0}
    assert find_leaks(docs, items.limit(0)).count() == 0 and find_leaks(docs.limit(0), items).count() == 0


def test_words():
    got = plain_words(pa.array(["Don’t <i>stop</i> 3,000 &amp; go", None, "1,234,567,890 ＡＢ éte", "<3 a &eacute; x_y"])).to_pylist()
    assert [x.split() for x in got] == [["dont", "stop", "3000", "go"], [], ["1234567890", "ab", "\u00e9te"], ["3", "a", "\u00e9", "x", "y"]]


def test_short_items_must_be_whole(spark):
    items = ["alpha beta gamma delta epsilon zeta eta theta iota kappa".split(), "one two three four five".split(), ["solo"], "first second".split()]
    docs = ["x alpha beta gamma delta epsilon zeta eta theta iota kappa y", "x alpha beta gamma delta epsilon y", "q one two other four five q", "one two three q", "so solo so", "first q second", "a first second"]
    assert leaks(spark, [d.split() for d in docs], items) == {(0, 0), (2, 1), (4, 2), (6, 3)}


def test_long_item(spark):
    r = random.Random(6)
    item = [f"v{i}" for i in range(1000)]
    docs = [noise(r, 50) + item[a : a + 25] + noise(r, 700) for a in range(0, 975, 13)]
    assert {d for d, _ in leaks(spark, docs, [item])} == set(range(len(docs)))


def plain_search(item, doc, rule=LeakRule()):
    """Whether any pair of anchored stretches is a leak, by the least edits of every pair of ends."""
    w = min(len(item), rule.min_words)
    limit = rule.edits(w)
    for i in range(len(item) - 1):
        for j in range(len(doc) - 1):
            if item[i : i + 2] != doc[j : j + 2]:
                continue
            row = list(range(len(doc) - j + 1))
            for k in range(i, len(item)):
                new = [k - i + 1]
                for x, word in enumerate(doc[j:], 1):
                    new.append(min(row[x - 1] + (word != item[k]), row[x] + 1, new[-1] + 1))
                    d, hidden = new[-1], max(0, w - (k - i + 1))
                    if x > 1 and k > i and doc[j + x - 2 : j + x] == item[k - 1 : k + 1] and d + hidden <= limit and hidden <= 2 * d:
                        return True
                row = new
    return False


def test_against_plain_search(spark):
    r = random.Random(9)
    items = [[r.choice(W) for _ in range(30)] for _ in range(4)]
    docs = []
    for i in range(120):
        words = list(items[i % 4])
        a = r.randrange(8)
        words = edited(r, words[a : a + r.randrange(16, 26)], r.randrange(0, 5))
        if r.random() < 0.3:  # a paraphrased part before a clean run
            words = [w if x % 3 else f"p{x}" for x, w in enumerate(words[:9])] + words[9:]
        docs.append(noise(r, 6) + words + noise(r, 6))
    got = leaks(spark, docs, items)
    want = {(d, i) for d, doc in enumerate(docs) for i, item in enumerate(items) if plain_search(item, doc)}
    assert got <= want and len(got) >= 0.98 * len(want) and 20 < len(want) < 110
