"""Rings out of ways against walking along them."""

import random

from tocsin.sources import readers


def walked(members, ends):
    """Closed chains of ways of one relation: by following ends, where each node joins two."""
    left, rings = dict(sorted(members.items())), []
    while left:
        first, way = next(iter(left.items()))
        del left[first]
        begin, at = ends[way]
        seen, chain = [way], True
        while at != begin and chain:
            chain = next(((p, w) for p, w in left.items() if at in ends[w]), None)
            if chain:
                del left[chain[0]]
                a, b = ends[chain[1]]
                at = b if at == a else a
                seen.append(chain[1])
        if at == begin:
            rings.append((first, len(seen)))
    return sorted(rings)


def test_rings_of_any_length(spark):
    rng, members, ways, nodes, want = random.Random(4), [], [], [], []
    for relation in range(12):
        of, ends, pos = {}, {}, iter(rng.sample(range(400), 300))
        for ring, n in enumerate(rng.choices([1, 2, 3, 5, 8, 33, 64], k=3)):
            corners = [relation * 100_000 + ring * 1000 + k for k in range(n)]
            closed = rng.random() < 0.8
            for k in range(n - (not closed)):
                a, b = corners[k], corners[(k + 1) % n]
                if rng.random() < 0.5:
                    a, b = b, a
                way, at = a * 1000 + k, next(pos)
                middle = way * 10 + 7
                of[at], ends[way] = way, (a, b)
                members.append((relation, at, way))
                ways += [(way, 0, a), (way, 1, middle), (way, 2, b)]
                nodes.append((middle, middle / 3, 1.0))
            nodes += [(c, c / 3, 0.0) for c in corners]
        want += [(relation, *r) for r in walked(of, ends)]
    schema = "relation bigint, pos int, way bigint", "way bigint, pos int, node bigint", "node bigint, lng double, lat double"
    rows = readers.ways_to_rings(*(spark.createDataFrame(x, s) for x, s in zip((members, ways, nodes), schema, strict=True))).collect()
    assert sorted((r.relation, r.ring, r.ways) for r in rows) == sorted(want) and len(want) > 15
    for r in rows:
        assert r.points[0] == r.points[-1] and len(r.points) == 2 * r.ways + 1 and len({(p.lng, p.lat) for p in r.points}) == 2 * r.ways
        assert [p.lat for p in r.points] == [float(k % 2) for k in range(2 * r.ways + 1)]


def test_walking_and_ranking_agree(spark):
    """Relations that a worker walks and those that are ranked have the same arcs, also where several ends meet and where chains are open."""
    rng = random.Random(9)
    rows = [(relation, at, rng.randrange(9) if rng.random() < 0.9 else None, rng.randrange(9)) for relation in range(150) for at in rng.sample(range(40), rng.randrange(1, 18))]
    ways = spark.createDataFrame(rows, "relation bigint, at int, first bigint, last bigint")
    walked, ranked = (sorted(map(tuple, f(ways).select("relation", "arc", "at", "least", "left").collect())) for f in (readers._walked, readers._ranked))
    assert walked == ranked and len({(r[0], r[3]) for r in walked}) > 100


def test_rings_of_large_relations(spark, monkeypatch):
    """Rings of relations with more ways than a worker walks are the same."""
    monkeypatch.setattr(readers, "WALKED", 40)
    test_rings_of_any_length(spark)


def test_joins_of_ways_are_not_broadcast(spark, monkeypatch):
    """Exploded tables look small by their files; broadcast, they would fill the driver."""
    from tocsin.plans import queries

    plans, stored = [], readers.stored

    def seen(df, tag):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return stored(df, tag)

    monkeypatch.setattr(readers, "stored", seen)
    plans.append(queries.ways_rings(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString())
    joins = [line for p in plans for line in p.split("\n") if "Join" in line]
    assert len(joins) >= 4 and all("SortMergeJoin" in j or "LeftAnti" in j for j in joins), joins
