"""Cycles of references: chains are passed over, rings and branches found."""

import random

import pytest

from quernstone.plans import ledger


def _edges(spark, pairs):
    return spark.createDataFrame(pairs or [("x", None)], "a string, b string").repartition(3)


def _components(pairs):
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)

    def reach(x):
        seen, stack = set(), [x]
        while stack:
            new = after.get(stack.pop(), set()) - seen
            seen |= new
            stack += new
        return seen

    to = {x: reach(x) for x in {n for p in pairs for n in p}}
    return {x: max(y for y in to if y in to[x] and x in to[y]) for x in to if x in to[x]}


def _made(spark, pairs):
    return {r.node: r.component for r in ledger.strong_components(_edges(spark, pairs)).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_components_by_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(ledger, "LAYERS", 1)
    rng = random.Random(seed)
    node = lambda: f"n{rng.randrange(24):02}"
    pairs = [(node(), node()) for _ in range(14 + 10 * seed)] + [(f"c{k}", f"c{k + 1}") for k in range(9)]
    if seed:
        pairs += [("c9", "n00"), ("n01", "c0"), ("r0", "r1"), ("r1", "r2"), ("r2", "r0"), ("c4", "r1"), ("s", "s")]
    assert _made(spark, pairs) == _components(pairs)


def test_the_rounds_do_not_grow_with_a_chain(spark, monkeypatch):
    """A chain of replies, with a branch at its end, and the same with one late reference that closes a cycle over a part of it."""
    written, real = [], ledger.durable
    monkeypatch.setattr(ledger, "durable", lambda df, name: (written.append(name), real(df, name))[1])
    tables = {}
    for n in (40, 2000):
        chain = [(f"e{k + 1:05}", f"e{k:05}") for k in range(n)] + [(f"e{n:05}", "other")]
        written.clear()
        assert ledger.cyclic_core(_edges(spark, chain)).count() == 0
        tables[n] = len(written)
    assert tables[2000] <= tables[40] + 7  # the doublings: log2 of fifty times the length
    ring = [(f"e{k + 1:05}", f"e{k:05}") for k in range(300)] + [("e00000", "e00200"), ("e00200", "side")]
    core = {(r.a, r.b) for r in ledger.cyclic_core(_edges(spark, ring)).collect()}
    assert core == {(f"e{k + 1:05}", f"e{k:05}") for k in range(200)} | {("e00000", "e00200")}
    assert ledger.cyclic_core(_edges(spark, [])).count() == 0
