import random

from caseloom.operators.components import connected_components, star_edges


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    return {x: find(x) for x in root}


def test_equal_to_union_find(spark):
    draw = random.Random(5)
    name = lambda i: f"n{i:05}"
    edges = [(name(draw.randrange(900)), name(draw.randrange(900))) for _ in range(500)]
    edges += [(name(1000 + i), name(1001 + i)) for i in range(60)] + [(name(1000), name(1000)), edges[0], edges[1][::-1]]  # a chain, a loop, repeats
    df = spark.createDataFrame([*edges, (None, "x"), ("x", None)], "u string, v string")
    got = [tuple(r) for r in connected_components(df).collect()]
    assert dict(got) == brute(e for e in edges if e[0] != e[1]) and len(got) == len(dict(got))
    assert connected_components(df.limit(0)).count() == 0


def test_a_hub_is_split(spark):
    """A key that holds most members: adaptive execution splits its join with the minima."""
    rows = spark.range(60_000).selectExpr("concat('m', lpad(id, 7, '0')) as node", "if(id % 10 < 9, 'hot', concat('k', id div 100)) as key")
    names = ["skewJoin.skewedPartitionThresholdInBytes", "advisoryPartitionSizeInBytes", "skewJoin.skewedPartitionFactor", "autoBroadcastJoinThreshold"]
    before = {n: spark.conf.get(f"spark.sql.adaptive.{n}", None) for n in names}
    try:
        for n, value in zip(names, ["20k", "10k", "2", "-1"]):
            spark.conf.set(f"spark.sql.adaptive.{n}", value)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        edges = star_edges(rows, "node", "key")
        edges.write.format("noop").mode("overwrite").save()
        assert len(edges.collect()) > 50_000
        assert "skew=true" in edges._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for n, value in before.items():
            spark.conf.unset(f"spark.sql.adaptive.{n}") if value is None else spark.conf.set(f"spark.sql.adaptive.{n}", value)
