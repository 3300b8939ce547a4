"""Growth of clusters over linked sets: whatever way entries are looked at, with repeated and large ids, and entries alike."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import governance


def _plain(held: dict, near: dict, project: dict) -> set[tuple]:
    free, want = sorted(held), set()
    while free:
        cluster, grew = [free.pop(0)], True
        while grew:
            grew = False
            for i in list(free):
                if project[i] not in {project[m] for m in cluster} and any(set(held[i]) & near[s] for m in cluster for s in held[m]):
                    cluster.append(i)
                    free.remove(i)
                    grew = True
        if len(cluster) > 1:
            want |= {(i, project[i], cluster[0]) for i in cluster}
    return want


def _case(r: random.Random, entries: int, sets: int, most: int, projects: int) -> tuple[dict, dict, dict]:
    """Sets of each entry, linked sets of each set (some only to themselves, all of them both ways), and projects, of which the first is frequent."""
    near = {s: {s} if r.random() < 0.8 else set() for s in range(sets)}
    for _ in range(sets):
        a, b = r.sample(range(sets), 2)
        near[a].add(b)
        near[b].add(a)
    held = {i: r.sample(range(sets), r.randint(1, most)) for i in range(entries)}
    project = {i: "p%d" % max(0, r.randrange(-projects // 3, projects)) for i in held}
    return held, near, project


@pytest.mark.parametrize("step, look, ready, most, projects", [(64, 256, 1 << 15, 2, 6), (64, 2, 8, 2, 6), (1, 2, 8, 4, 5), (0, 2, 8, 4, 80), (3, 3, 40, 3, 80), (0, 1, 1, 2, 2)])
def test_growth_by_stretches_and_cells(monkeypatch, step, look, ready, most, projects):
    """The same clusters with few or many entries ready, with entries of several sets, and with more projects than a number has bits."""
    for name, value in (("_NEXT", step), ("_LOOK", look), ("_READY", ready)):
        monkeypatch.setattr(governance, name, value, raising=False)
    for case in range(3):
        held, near, project = _case(random.Random(100 * step + case), 220, 40, most, projects)
        rows = [(project[i], s, i, None) for i in held for s in held[i]]
        rows += [(None, s, None, [{"of": 0, "set": x} for x in near[s]]) for s in near if near[s] or any(s in held[i] for i in held)]
        got = governance._grow(pd.DataFrame(rows, columns=["project", "set", "id", "near"]).assign(of=0))
        want = _plain(held, near, project)
        assert want and set(got.itertuples(index=False, name=None)) == want


def test_clusters_of_large_and_repeated_ids(spark):
    """Ids that no double holds keep apart (they were read as such), and an id with several texts is one entry in one part."""
    held, near, project = _case(random.Random(5), 150, 60, 3, 6)
    big = lambda i: (1 << 60) + (i % 3 << 40) + i
    members = spark.createDataFrame([(big(i), project[i], s % 2, s) for i in held for s in held[i]], "id long, project string, of int, set long")
    # links join sets of one kind only
    near = {s: {x for x in near[s] if x % 2 == s % 2} for s in near}
    links = spark.createDataFrame([(s % 2, min(s, x), max(s, x)) for s in near for x in near[s]], "of int, a long, b long").distinct()
    held = {big(i): held[i] for i in held}
    project = {big(i): project[i] for i in project}
    want = _plain(held, near, project)
    assert want and {tuple(x) for x in governance.set_clusters(members, links).collect()} == want


def test_entries_alike_reach_their_task_as_arrays(spark, monkeypatch):
    """A task gets a row for entries alike in sets and project, not rows for each entry (two for each, whose reading alone took minutes for millions)."""
    members = spark.range(30_000).select("id", F.concat(F.lit("p"), F.col("id") % 4).alias("project"), F.expr("inline(array(struct(0 as of, id % 3 as set), struct(1 as of, id % 15 as set)))"))
    links = spark.createDataFrame([(0, s, s) for s in range(3)] + [(1, s, (s + 4) % 15) for s in range(11)], "of int, a long, b long")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [b.num_rows for b in batches]
        yield pa.RecordBatch.from_arrays([pa.array([sum(n)]), pa.array([""]), pa.array([0])], ["id", "project", "cluster"])

    monkeypatch.setattr(governance, "_grow_part", counted)
    assert sum(x["id"] for x in governance.set_clusters(members, links).collect()) == 60 + 3 + 15
