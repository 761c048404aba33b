"""Leaked items with noise are found, shared phrases are not; seeds against brute force."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from rainloom.llm import leaks as L

WORDS = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(600)]


def _item(r, n=60):
    return [r.choice(WORDS) for _ in range(n)]


def _noisy(r, words):
    out = []
    for w in words:
        x = r.random()
        if x < 0.06:
            w = w[::-1] + "q"
        elif x < 0.1:
            w = w.upper()
        elif x < 0.13:
            w = f"<b>{w}</b>"
        elif x < 0.16:
            w = w[:1] + "-\n" + w[1:]
        elif x < 0.18:
            w = w + " [Page 12] "
        elif x < 0.2:
            w = w[:1] + "​" + w[1:]
        out.append(w)
    return "  ".join(out)


def test_found_and_not_found(spark):
    r = random.Random(1)
    items = [(k, " ".join(_item(r))) for k in range(30)]
    docs, expected = [], set()
    for k, (i, text) in enumerate(items):
        words, other = text.split(), " ".join(_item(r, 80))
        cut = r.randint(0, 18)
        docs.append((100 + k, f"{other}. {_noisy(r, words[cut : cut + 42])}; {other}"))
        expected.add((i, 100 + k))
        docs.append((200 + k, f"{other} {' '.join(words[:26])} {other}"))  # less than three fifths
        docs.append((300 + k, f"{' '.join(words[:20])} {other} {' '.join(words[40:])}"))  # not one passage
    docs += [(400, None), (None, items[0][1]), (401, ""), (402, items[3][1] * 40), (403, " ".join(_item(r, 30_000)))]
    expected.add((3, 402))
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string")
    item_frame = spark.createDataFrame([*items, (98, None), (99, "")], "item_id long, text string")
    found = {(x.item_id, x.doc_id) for x in L.leaked_items(frame, item_frame).collect()}
    assert found == expected
    blocks = {(x.item_id, x.doc_id) for x in L.leaked_items(frame, item_frame, block_chars=2000).collect()}
    assert blocks == expected
    assert L.leaked_items(frame, item_frame.limit(0)).count() == 0 and L.leaked_items(frame.limit(0), item_frame).count() == 0


def _span(item, text):
    """Share by plain dynamic programming."""
    m = len(item)
    best, prev = (0.0, 0, 0), {j: (0.0, j, 0) for j in range(-1, m)}
    for token in text:
        cur = {-1: (0.0, 0, 0)}
        for j in range(m):
            same = item[j] == token
            s, b, c = prev[j - 1] if j else (0.0, 0, 0)
            options = [(s + 1, b, c + 1) if s > 0 and same else (1.0, j, 1) if same else (s - L.MISSING_COST, b, c)]
            options.append((prev[j][0] - L.INSERTED_COST, *prev[j][1:]))
            options.append((cur[j - 1][0] - L.MISSING_COST, *cur[j - 1][1:]))
            top = max(options, key=lambda o: o[0])
            cur[j] = top if top[0] > 0 else (0.0, j + 1, 0)
            if same and cur[j][0] > best[0]:
                best = (cur[j][0], j - cur[j][1] + 1, cur[j][2])
        prev = cur
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=3, max_size=12), st.lists(st.integers(-1, 6), max_size=16))
def test_alignment_score(item, text):
    share, _ = L.passage(np.array(item), np.array(text, dtype=np.int64))
    score, span, count = _span(item, text)
    assert 0 <= share <= 1
    if score and count >= L.LEAST_MATCHED * span:
        assert share > 0 or score <= 3  # equal scores may span differently


def test_words():
    assert L.words("<p>Mass-weighted mean dia-\n> meter&nbsp;3.5 m­m</p>") == ["massweighted", "mean", "diameter", "3.5", "mm"]


def test_short_items():
    """Items of five to twelve words are found, also with an altered word; a part of a tiny one is only a quote."""
    r = random.Random(4)
    items = [(k, " ".join(_item(r, 5 + k % 8))) for k in range(64)]
    index = L.LeakIndex(items)
    other = " ".join(_item(r, 30))
    for k, text in items:
        assert [i for i, _, _ in index.leaks(f"{other} {text}. {other}")] == [k]
        if (n := len(text.split())) >= L.TINY_WORDS:
            words = text.split()
            words[n // 2] = "altered"
            assert [i for i, _, _ in index.leaks(f"{other} {' '.join(words)} {other}")] == [k]
        else:
            assert index.leaks(f"{other} {' '.join(text.split()[:-1])} {other}") == []


def test_no_accepted_passage_is_lost_before_alignment():
    r = random.Random(8)
    for n in (9, 20, 34, 35, 60):
        items = [(k, " ".join(_item(r, n))) for k in range(150)]
        index = L.LeakIndex(items)
        docs = []
        for _, text in items:
            m = -(-3 * n // 5)
            cut = r.randint(0, n - m)
            part = text.split()[cut : cut + m]
            for k in r.sample(range(m), m // 5):
                part[k] = "altered"
            docs.append(" ".join(["before"] * 6 + part + ["after"] * 6))
        found = {d for d, i, _, _ in index.leaks_of(docs) if d == i}
        texts = [np.array([index.vocabulary.get(w, -1) for w in L.words(d)]) for d in docs]
        assert found == {k for k, (share, _) in enumerate(L.passages(index.items, texts)) if share >= L.LEAST_SHARE}


def test_batches_are_judged_like_single_texts():
    r = random.Random(2)
    items = [(k, " ".join(_item(r, 40))) for k in range(20)]
    index = L.LeakIndex(items)
    docs = ["", "w", *[_noisy(r, t.split()) for _, t in items], " ".join(t for _, t in items), "one <tag " + "x" * 1000 + "> " + items[0][1]]
    together = index.leaks_of(docs)
    assert together == [(k, *x) for k, d in enumerate(docs) for x in index.leaks(d)]
    assert {i for d, i, _, _ in together if d == 22} == set(range(20)) and (23, 0) in {(d, i) for d, i, _, _ in together}
