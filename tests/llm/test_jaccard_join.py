"""Candidate pairs of the Jaccard join: what no other component holds cannot be shared."""

import random

from lendscope.llm import jaccard_join


def test_positions_count_what_cannot_be_shared_first(spark):
    # A set of 145 shingles has a prefix of 30; of head 1 three may be shared, of head 2 one.
    rows = spark.createDataFrame(
        [(7, 1, 145, 2), (8, 1, 145, 9), (9, 1, 145, 20), (7, 2, 145, 0)], "token long, head long, n long, pos int"
    )
    got = {(r.head, r.token): (r.pos, r["rank"]) for r in jaccard_join.live_positions(rows).collect()}
    assert got == {(1, 7): (27, 0), (1, 8): (28, 1), (1, 9): (29, 2), (2, 7): (29, 0)}


def test_near_copies_at_the_bound(spark):
    """Many near copies of one text, about the bound apart, against all pairs."""
    draw = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for at in draw.sample(range(120), draw.randint(0, 5)):
            words[at] = f"x{i}at{at}"
        rows.append((i, " ".join(words)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(116)} for i, t in rows}
    component = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert 0 < len(links) < 60 * 59 // 2
    for _ in sets:
        for a, b in links:
            component[a] = component[b] = min(component[a], component[b])
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == component
