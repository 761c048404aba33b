"""Quotas, the schedule's deviation, repeats and shares."""

from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rainloom.llm import mixing as M


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.integers(0, 60), min_size=1))
def test_schedule_deviates_by_less_than_a_block(blocks):
    slots = M.schedule(blocks)
    out = [(source, k, slot) for slot, source, k in sorted((int(t), source, k) for source, own in slots.items() for k, t in enumerate(own))]
    total = sum(blocks.values())
    assert [s for _, _, s in out] == list(range(total)) and Counter(s for s, _, _ in out) == Counter({k: v for k, v in blocks.items() if v})
    taken = Counter()
    for n, (source, block, _) in enumerate(out, start=1):
        assert block == taken[source]
        taken[source] += 1
        for s, b in blocks.items():
            assert abs(taken[s] - n * b / total) < 1 + 1e-9


def test_quotas():
    plan = {q.source: q for q in M.quotas([("big", 0.5, 1), ("mid", 0.4, 2), ("tiny", 0.1, 3), ("none", 0.0, 3)], {"big": (10, 10_000), "mid": (5, 2_000), "tiny": (1, 50)})}
    assert plan["tiny"].quota == 150 and plan["mid"].quota == 4000 and plan["big"].quota == 5000 and plan["none"].quota == 0
    assert all(q.quota == 0 for q in M.quotas([("a", 1.0, 1)], {}))


def test_empty_sources_do_not_bound_the_mix():
    targets = [("big", 0.5, 1), ("mid", 0.25, 2), ("none", 0.25, 3)]
    available = {"big": (10, 10_000), "mid": (5, 2_000)}
    for short_share in (0, 0.15, 0.25):
        plan = {q.source: q.quota for q in M.quotas(targets, available, short_share)}
        assert plan == {"big": 8000, "mid": 4000, "none": 0} if short_share < 0.25 else plan["big"] == 10_000 and plan["none"] == 0
    assert [q.quota for q in M.quotas([("a", 0.9, 1), ("b", 0.1, 0)], {"a": (1, 90), "b": (1, 5)}, 0)] == [90, 0]


SCHEMA = "doc_id long, text string, source string, tokens string"


def _mix(spark, docs, targets, short_share=M.SHORT_SHARE):
    documents = spark.createDataFrame([(*d, "clash") for d in docs], SCHEMA)
    wanted = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    return M.mix(documents, wanted, short_share=short_share).collect(), {r.source: r for r in M.mix_shares(documents, wanted, short_share=short_share).collect()}


def test_mix(spark):
    docs = [(k, "some words of rain " * (5 + k % 7), "Web-Crawl " if k % 2 else "web_crawl") for k in range(400)]
    docs += [(1000 + k, "a log entry " * 12, "LOGS") for k in range(40)]
    docs += [(2000, None, "logs"), (2001, "", "logs"), (2002, "x y", None), (2003, "x y", "other"), (None, "x y", "logs")]
    rows, shares = _mix(spark, docs, [("web_crawl", 0.6, 1), ("logs", 0.3, 3), ("empty", 0.1, 2)])
    uses = defaultdict(list)
    for r in rows:
        uses[(r.source, r.doc_id)].append(r.repeat)
    assert max(map(len, uses.values())) <= 3 and all(sorted(v) == list(range(1, len(v) + 1)) for v in uses.values())
    assert {d for s, d in uses if s == "logs"} == set(range(1000, 1040))
    by = Counter()
    for r in rows:
        by[r.source] += r.tokens
    assert abs(by["web_crawl"] - 2 * by["logs"]) < 3 * 40
    assert shares["empty"].tokens == 0 and shares["logs"].most_repeats == 3 and shares["logs"].tokens == by["logs"]
    assert abs(sum(s.actual_share for s in shares.values()) - 1) < 1e-9


def test_empty(spark):
    rows, shares = _mix(spark, [], [("a", 1.0, 1)])
    assert rows == [] and shares["a"].actual_share == 0.0
    rows, shares = _mix(spark, [(1, "x", "a")], [])
    assert rows == [] and shares == {}


def test_token_counts_round_trip(spark):
    tiktoken = pytest.importorskip("tiktoken")
    text = "Rain fell at 3.1 m/s – «größer», 日本語 <|endoftext|>  \n\n end" + "ab " * 5000
    docs = spark.createDataFrame([(1, text, "s", ""), (2, None, "s", "")], SCHEMA)
    counts = {r.doc_id: r.tokens for r in M.token_counts(docs).collect()}
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(M.TOKENIZER_PATH, "rb"))}
    encoder = tiktoken.Encoding("t", pat_str=M.TOKENIZER_PATTERN, mergeable_ranks=ranks, special_tokens={})
    tokens = encoder.encode_ordinary(text)
    assert encoder.decode(tokens) == text and counts == {1: len(tokens), 2: 0}


def test_period():
    assert M.period({"a": Fraction(3, 10), "b": Fraction(6, 10), "c": Fraction(0)}) == {"a": 1, "b": 2}
    long = M.period({"a": Fraction(1, 3), "b": Fraction(123_457, 1_000_003), "c": Fraction(1, 10_000_000)})
    assert sum(long.values()) <= M.MAX_PERIOD + 1 and long["c"] == 1 and abs(long["a"] / long["b"] - (1 / 3) / (123_457 / 1_000_003)) < 1e-3


@pytest.mark.parametrize("short_share", [0.0, 0.2])
def test_every_prefix_is_within_a_block_of_the_targets(spark, monkeypatch, short_share):
    """Documents longer than a block, sources in other proportions than wanted, over many periods of the schedule."""
    monkeypatch.setattr(M, "BLOCK_TOKENS", 24)
    monkeypatch.setattr(M, "LEAST_SLOTS", 10)
    docs = [(k, "rain " * (3 + k * 7 % 90), "a") for k in range(300)]
    docs += [(1000 + k, "drop count " * (1 + k % 5), "b") for k in range(120)]
    docs += [(2000 + k, "fall speed of drops " * 30, "c") for k in range(9)] + [(3000, "tiny one " * 20, "d"), (3001, "tiny", "f")]
    targets = [("a", 0.45, 2), ("b", 0.15, 3), ("c", 0.3, 5), ("e", 0.05, 1)] + ([("d", 0.05, 2), ("f", 0.01, 1)] if short_share else [])
    rows, shares = _mix(spark, docs, targets, short_share)
    weights = {s: q.quota for s, q in shares.items() if q.quota} if short_share else {"a": 0.45, "b": 0.15, "c": 0.3}
    total_weight = sum(weights.values())
    pieces = sorted((p.slot, r.start, r.source, p.tokens) for r in rows for p in r.pieces)
    assert len({t for t, *_ in pieces}) == pieces[-1][0] + 1 > 100 and all(r.tokens == sum(p.tokens for p in r.pieces) for r in rows)
    taken, total = Counter(), 0
    for _, _, source, tokens in pieces:
        taken[source] += tokens
        total += tokens
        for s, w in weights.items():
            assert abs(taken[s] - total * w / total_weight) < 24 + (1 if short_share else 0), (s, total)
    for s, q in shares.items():
        assert q.tokens == q.quota == taken[s] and q.most_repeats <= q.max_repeats
