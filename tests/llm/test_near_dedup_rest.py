"""Links that no leader shows (F5, F6)."""

from __future__ import annotations

import random

import pytest

from psephos.llm import near_dedup


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_large_buckets_are_compared_in_full(spark, monkeypatch, rounds):
    """Families whose members are alike by 0.6 to 0.9: classes as by brute force, however few leaders there were."""
    monkeypatch.setattr(near_dedup, "ROUNDS", rounds)
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    r, texts = random.Random(5), {}
    for family in range(3):
        words = [f"w{family}x{r.randrange(5000)}" for _ in range(220)]
        for n in range(40):
            own = list(words)
            for _ in range(r.choice((1, 3, 5, 7))):
                own[r.randrange(220)] = f"own{r.randrange(10**6)}"
            texts[1000 * family + n] = " ".join(own)
    each = {i: near_dedup.weighted(t.split()) for i, t in texts.items()}
    root = {i: i for i in texts}
    for i in texts:
        for j in texts:
            if i < j and root[i] != root[j] and max(near_dedup.similarities(each[i], each[j])) >= near_dedup.SIMILARITY:
                low, high = sorted((root[i], root[j]))
                root = {k: low if v == high else v for k, v in root.items()}
    assert 3 < len({*root.values()}) < len(texts)
    got = near_dedup.near_duplicate_classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {row.doc_id: row.class_id for row in got} == root


def _family(members: int, words: int = 150) -> dict[int, str]:
    """One large group of near copies: half link with each other, the others with none by a hair."""
    r = random.Random(7)
    base, texts = [f"w{r.randrange(10**5)}" for _ in range(words)], {}
    for n in range(members):
        own = list(base)
        for at in r.sample(range(5, words - 5, 6), r.choice((0, 1)) if n % 2 else r.choice((4, 5))):
            own[at] = f"own{r.randrange(10**6)}"
        texts[n] = " ".join(own)
    return texts


def test_pairs_of_a_large_group_do_not_grow_with_its_square(spark, monkeypatch):
    """Texts are read for few of the pairs of unlike components, however many there are; no link is lost."""
    from pyspark.sql import functions as F

    texts, read, links = _family(240), [], near_dedup._links

    def counted(pairs, texts):
        pairs = near_dedup.stored(pairs, "counted")
        read.append(pairs.count())
        return links(pairs, texts)

    monkeypatch.setattr(near_dedup, "_links", counted)
    got = near_dedup.near_duplicate_classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert got.groupBy("class_id").count().agg(F.max("count")).first()[0] >= 100
    assert got.select("class_id").distinct().count() >= 100
    assert read[-1] <= len(texts)


def test_no_pair_is_more_alike_than_its_bound(spark):
    """Bounds hold for texts with and without repeated shingles, of other lengths, and for documents with two texts."""
    import numpy as np

    r, rows = random.Random(3), []
    for n in range(60):
        own = [f"w{k}" for k in range(r.choice((30, 60, 90)))]
        for _ in range(r.randrange(6)):
            own[r.randrange(len(own))] = f"own{r.randrange(40)}"
        own += own[: r.choice((0, 0, 12, 25))] * r.choice((1, 2, 9))
        rows.append((n, " ".join(own)))
    rows.append((59, rows[0][1] + " and more"))
    texts = spark.createDataFrame(rows, "node long, text string")
    cells = near_dedup._cells(texts.select("node", texts.node.alias("comp")), texts).collect()
    assert len(cells) == len(rows)
    each = [near_dedup.weighted(t.split()) for _, t in rows]
    by = {n: [c for c in cells if c.node == n] for n, _ in rows}
    block = near_dedup.pa.array([{"node": c.node, "comp": c.node, "size": c.size, "total": c.total, "scale": c.scale, "cells": bytes(c.cells)} for n in range(60) for c in by[n]])
    m = near_dedup._Members(block)
    i, j = np.triu_indices(len(block), 1)
    bound = near_dedup.most_alike(m, m, m.cells, m.cells, i, j)
    most: dict[tuple[int, int], float] = {}
    for value, a, b in zip(bound, m.node[i], m.node[j], strict=True):
        most[a, b] = max(most.get((a, b), 0), value)
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            pair = tuple(sorted((rows[a][0], rows[b][0])))
            if pair[0] != pair[1]:
                assert max(near_dedup.similarities(each[a], each[b])) <= most[pair] + near_dedup.SLACK


def test_no_estimate_leaves_a_pair_out(spark, monkeypatch):
    """Two texts with a common bucket are judged by their words alone, whatever a limit on their bits' differences is."""
    monkeypatch.setattr(near_dedup, "MOST_BITS", -1, raising=False)
    own = [f"w{n}" for n in range(200)]
    texts = [(n, " ".join([*own[:-1], f"own{n}"])) for n in range(2)]
    got = near_dedup.near_duplicate_classes(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {row.class_id for row in got} == {0}
