import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.sources import sinks, tables

FACTS = [
    ("Orion", "outperforms", "Vega", "a"), ("Vega", "uses", "Lyra net", "b"), ("Lyra net", "evaluated_on", "deep sky", "c"), ("Orion", "trained_on", "COCO", "a"),
    ("A. Stone", "proposes", "Orion", "a"), ("Stone", "proposes", "Vega", "b"), ("it", "uses", "Vega", "b"), ("Mira", "extends", "Miro", "d"), ("Vega", "uses", "Lyra net", "b"), ("Orion v2", "extends", "Orion", "e"), ("Orion v3", "extends", "Orion v2", "e"),
]


@pytest.fixture(scope="module")
def built(spark):
    rows = [(s, r, o, f, 1, f"{s} {r} {o}.", "domain", i) for i, (s, r, o, f) in enumerate(FACTS)]
    nodes, edges = graph.build(spark.createDataFrame(rows, tables.TRIPLES))
    return graph.checkpointed(nodes), graph.checkpointed(edges)


def test_build_merges_people_but_not_versions(built):
    nodes, edges = built
    keys = {r["key"] for r in nodes.collect()}
    assert len({"stone", "a. stone"} & keys) == 1 and {"orion", "orion v2", "orion v3"} <= keys and "it" not in keys
    variants = {(r["src"], r["dst"]) for r in edges.filter("relation = 'variant_of'").collect()}
    assert {("orion", "orion v2"), ("orion v2", "orion"), ("orion v2", "orion v3")} <= variants


def test_three_hops_keep_direction_and_sources(spark, built):
    _, edges = built
    reach = {r["key"]: r for r in graph.neighbours(spark.createDataFrame([("orion",)], "start string"), edges.filter("relation <> 'variant_of'"), 3).collect()}
    path = reach["deep sky"]["path"]
    assert reach["deep sky"]["hop"] == 3 == len(path) and [s["source_file"] for s in path] == ["a", "b", "c"] and {s["direction"] for s in path} == {"outgoing"}
    assert sum(r["key"] == "lyra net" for r in graph.neighbours(spark.createDataFrame([("orion",)], "start string"), edges, 3).collect()) == 2  # parallel edges
    assert graph.neighbours(spark.createDataFrame([("nobody",)], "start string"), edges, 2).count() == 0


def test_paths_and_subgraphs(spark, built):
    _, edges = built
    pairs = spark.createDataFrame([("orion", "deep sky"), ("orion", "mira"), ("orion", "orion")], "start string, goal string")
    assert [(r["goal"], r["length"]) for r in graph.shortest_paths(pairs, edges.filter("relation <> 'variant_of'")).collect()] == [("deep sky", 3)]
    keys, own = graph.subgraph("orion", edges, 2, 4)
    assert keys.count() == 4 and own.count() >= 1
    assert graph.edges_between(edges, "orion", "vega").count() == 1


def test_types(built):
    nodes, edges = built
    types = {r["key"]: r["type"] for r in graph.entity_types(nodes, edges).collect()}
    assert types["coco"] == "DATASET" and types["orion"] == "MODEL" and types["deep sky"] == "DATASET"


def test_lookup_cascade(spark, built):
    nodes, _ = built
    asked = spark.createDataFrame([("Orion",), ("orionn",), ("qqqq zzzz",)], "mention string")
    assert {r["mention"]: r["key"] for r in graph.lookup(asked, nodes).collect()} == {"Orion": "orion", "orionn": "orion"}


def test_merge_candidates_lose_no_pair(spark):
    from tessera.functions.udfs import lcs_ratio

    rng = random.Random(5)
    keys = set()
    while len(keys) < 120:
        base = "".join(rng.choice("abcd ") for _ in range(rng.randint(4, 24))).strip()
        keys |= {base, base[:-1], base.replace("a", "b", 1), "x" + base} - {""}
    keys = sorted(keys)
    got = {(r["a"], r["b"]) for r in graph.merge_candidates(spark.createDataFrame([(k,) for k in keys], "key string")).collect()}
    want = {(a, b) for a in keys for b in keys if a < b and lcs_ratio(a, b) >= 90}
    assert want <= got and want


def test_components_agree_with_union_find(spark):
    rng = random.Random(3)
    pairs = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(40)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["key"]: r["component"] for r in graph.components(spark.createDataFrame(pairs, "a int, b int")).collect()}
    assert got == {x: find(x) for x in parent}


def test_graph_round_trip(spark, built, tmp_path):
    nodes, edges = built
    sinks.save_graph(nodes, edges, f"file://{tmp_path}/g")
    n, e = tables.graph(spark, f"file://{tmp_path}/g")
    assert n.count() == nodes.count() and e.exceptAll(edges).count() == 0
    assert graph.stats(n, e).first()["n_edges"] == edges.count()


def test_lookup_scores_all_mentions(spark):
    nodes = spark.createDataFrame([("long orion nebula survey", ["long orion nebula survey"], 0)], "key string, aliases array<string>, ord bigint")
    asked = spark.range(10_050).select(F.concat(F.lit("long orion nebula survex q"), F.col("id").cast("string")).alias("mention"))
    found = graph.lookup(asked, nodes)
    assert found.count() == 10_050 == found.filter("key = 'long orion nebula survey' and score < 100").select("mention").distinct().count()


def fold(counts):
    """Greedy merging by its definition, one key after the other. counts: [(key, n, first)]."""
    import re

    from tessera.functions.udfs import lcs_ratio

    def parts(k):
        m = re.fullmatch(r"(.*?)[\s-]*v?([0-9]+(?:\.[0-9]+)?)", k)
        return (m[1].strip(" -"), m[2]) if m else (k, None)

    forms, owner, out = [], {}, {}
    for k, _, _ in sorted(counts, key=lambda c: (-c[1], c[2])):
        bare = re.sub(r"\b[a-z]\.\s*", "", k).strip() or k
        if bare in owner:
            out[k] = owner[bare]
            continue
        best = max(((lcs_ratio(k, f), -i, f) for i, f in enumerate(forms)), default=(0, 0, ""))
        if best[0] >= 90:
            (s1, v1), (s2, v2) = parts(k), parts(best[2])
            if not (v1 and v2 and v1 != v2) and not (bool(v1) != bool(v2) and s1 == s2):
                out[k] = best[2]
                continue
        forms.append(k)
        out[k] = owner[bare] = k
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_merging_is_the_greedy_one(spark, seed):
    rng = random.Random(seed)
    keys = set()
    while len(keys) < 150:
        base = " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(3, 8))) for _ in range(rng.randint(1, 3)))
        keys |= {base, base + rng.choice("abc"), base[:-1], base + " v2", base + "-3", base + "s 3", f"{rng.choice('xyz')}. {base}", f"{rng.choice('xyz')}. {base}s", base[1:]}
    counts = [(k, rng.randint(1, 4), i) for i, k in enumerate(sorted(keys))]
    got = {r["key"]: r["canonical"] for r in graph.canonicalise(spark.createDataFrame(counts, "key string, n bigint, first bigint")).collect()}
    want = fold(counts)
    assert got == want and sum(k != c for k, c in want.items()) > 20


def test_numbered_names_do_not_meet(spark):
    """Names that differ in their number make no candidate pairs, however many there are."""
    names = spark.range(500).selectExpr("format_string('customer#%09d', id) as key")
    assert graph.merge_candidates(names).count() == 0


def test_the_graph_reads_its_triples_once(spark):
    """Nodes and measures are one pass over the triples, and names are keyed in their own tables, below the joins."""
    from tessera.plans import registry

    data = "/root/testdata/sf0.001"
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for df in (graph.nodes_of(registry._placed(spark, data)), registry.graph_stats(spark, data)):
        assert len(re.findall(r"FileScan parquet \[[^\]]*l_partkey", plan(df))) == 1
    lines = plan(registry._valid(spark, data)).splitlines()
    joins = [i for i, x in enumerate(lines) if "ShuffledHashJoin" in x]
    keyed = [i for i, x in enumerate(lines) if "regexp_replace" in x and "p_name" in x]
    assert joins and keyed and min(keyed) > joins[-1]


def test_look_ups_join_nothing(spark):
    """Mentions are compared with nodes as arrays of character counts, not pair by pair in a join."""
    nodes = spark.createDataFrame([("äther wind", 0), ("solar wind", 1), (None, 2)], "key string, ord bigint")
    found = graph.similar(spark.createDataFrame([("Äther winds", "äther winds"), ("q", None)], "mention string, q string"), nodes, 80.0)
    assert "NestedLoop" not in found._jdf.queryExecution().toString()
    assert [(r["mention"], r["key"]) for r in found.collect()] == [("Äther winds", "äther wind")]


def test_stats_of_edges(spark, built):
    _, edges = built
    assert graph.stats_of_edges(edges).first() == graph.stats(graph.degrees(edges), edges).first()
    assert graph.stats_of_edges(edges.limit(0)).first()["n_edges"] == 0
