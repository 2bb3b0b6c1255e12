"""The entity-relation multigraph: build, resolve, traverse, measure. Nodes and edges are DataFrames.

Order is part of the data: triples carry `ord`, and every tie is broken by it. Loops over hops or rounds write their
state with checkpoint(), so a lost executor costs a re-read; the frontier, not the graph, is what each hop shuffles.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t
from ..functions.udfs import ratio, ship, weighted_ratio

ship(__name__)

EDGE = ["src", "dst", "relation", "source_file", "page", "sentence", "extractor", "ord"]


def shared_folder(spark: SparkSession) -> str:
    """The folder of checkpoints, which all executors share; where none is set, a new temporary one, in a single local JVM only."""
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="tessera-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


_made: list[str] = []


def _remove() -> None:
    spark = SparkSession.getActiveSession()
    for uri in _made if spark else []:
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(uri)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001  the session may be gone by then; the folder is scratch space
            return


atexit.register(_remove)


def materialised(df: DataFrame) -> DataFrame:
    """df as Parquet in the shared folder, for tables of the graph's size that are read more than once: computed once (a
    checkpoint computes its last stage twice), and of its columns only those asked for are read. Removed when the driver ends."""
    uri = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex[:12]}"
    _made.append(uri)
    df.write.parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)


# Building


def valid_triples(triples: DataFrame) -> DataFrame:
    """FLT11 on both ends, with their keys; triples may have these already (s_key, o_key; null where not valid)."""
    if "s_key" not in triples.columns:
        triples = triples.withColumn("s_key", t.valid_entity_key(F.col("subject"))).withColumn("o_key", t.valid_entity_key(F.col("object")))
    return triples.filter("s_key is not null and o_key is not null")


def endpoints(valid: DataFrame) -> DataFrame:
    """AGG2's input: one row per end of a triple: key, name, source_file, ord (subject before object)."""
    ends = F.array(F.struct(F.col("s_key").alias("key"), F.col("subject").alias("name"), (F.col("ord") * 2).alias("at")), F.struct(F.col("o_key").alias("key"), F.col("object").alias("name"), (F.col("ord") * 2 + 1).alias("at")))
    return valid.select("source_file", F.explode(ends).alias("e")).select("e.key", "e.name", "e.at", "source_file")


def entity_counts(valid: DataFrame) -> DataFrame:
    """AGG2: key, n, first (place of its first mention)."""
    return endpoints(valid).groupBy("key").agg(F.count("*").alias("n"), F.min("at").alias("first"))


def display_names(valid: DataFrame, canon: DataFrame | None = None) -> DataFrame:
    """AGG3: the most frequent spelling of each canonical entity, the first seen on ties. Two aggregations, no sort. Without canon, each key stands for itself."""
    ends = endpoints(valid)
    ends = ends.withColumn("canonical", F.col("key")) if canon is None else ends.join(canon, "key")
    by = ends.groupBy("canonical", "name").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    return by.groupBy("canonical").agg(F.max_by("name", F.struct("n", -F.col("first"))).alias("name"))


def _character_bound(a: Column, b: Column) -> Column:
    """Characters that both keys have, with repeats: no common subsequence is longer."""
    shared = F.lit(0)
    for c in "abcdefghijklmnopqrstuvwxyz0123456789 -":
        shared = shared + F.least(F.length(a) - F.length(F.replace(a, F.lit(c), F.lit(""))), F.length(b) - F.length(F.replace(b, F.lit(c), F.lit(""))))
    other = lambda x: F.length(F.regexp_replace(x, r"[a-z0-9 \-]", ""))
    return shared + F.least(other(a), other(b))


def _pieces(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(short's own pieces, long's substrings at the places where they may be found), both by sn, p, piece."""
    keys = keys.withColumn("n", F.length("key"))
    # edits allowed between a key of length n and any partner: partners are at most 11/9 as long
    own = keys.withColumn("d", F.floor((F.col("n") + F.floor(F.col("n") * 11 / 9)) / 10).cast("int"))
    own = own.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("d")))).withColumn("from", F.floor(F.col("p") * F.col("n") / (F.col("d") + 1)).cast("int")).withColumn("to", F.floor((F.col("p") + 1) * F.col("n") / (F.col("d") + 1)).cast("int"))
    own = own.filter("to > from").select(F.col("key").alias("short"), F.col("stem").alias("s_stem"), F.col("v").alias("s_v"), F.col("n").alias("sn"), "p", F.col("key").substr(F.col("from") + 1, F.col("to") - F.col("from")).alias("piece"))
    # a longer (or equally long) key looks for the pieces of every shorter length it may be merged with
    probe = keys.select(F.col("key").alias("long"), F.col("stem").alias("l_stem"), F.col("v").alias("l_v"), F.col("n").alias("ln"), F.explode(F.sequence(F.ceil(F.col("n") * 9 / 11).cast("int"), F.col("n"))).alias("sn"))
    probe = probe.withColumn("d", F.floor((F.col("sn") + F.floor(F.col("sn") * 11 / 9)) / 10).cast("int")).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("d"))))
    probe = probe.withColumn("from", F.floor(F.col("p") * F.col("sn") / (F.col("d") + 1)).cast("int")).withColumn("to", F.floor((F.col("p") + 1) * F.col("sn") / (F.col("d") + 1)).cast("int")).filter("to > from")
    probe = probe.withColumn("shift", F.explode(F.sequence(-F.col("d"), F.col("d")))).filter("`from` + shift >= 0 and `to` + shift <= ln")
    return own, probe.select("long", "l_stem", "l_v", "ln", "sn", "p", F.col("long").substr(F.col("from") + F.col("shift") + 1, F.col("to") - F.col("from")).alias("piece"))


def merge_candidates(counts: DataFrame, least: float = 90.0, clash_with: DataFrame | None = None) -> DataFrame:
    """Pairs of keys (a < b) whose ratio may reach `least`, found without comparing all keys.

    ratio = 200 * LCS / (la + lb) >= 90 bounds the edits: la + lb - 2 * LCS <= (la + lb) / 10. Cut both keys' text
    into pieces: d deletions leave one of d + 1 equal pieces of the shorter key intact in the longer one, at an offset
    shifted by at most d. Each key enters its own pieces (by total length class and piece number); each key looks up
    its substrings at the shifted places. Lossless, and an equi-join.

    Pairs whose versions clash never merge, so they aren't sought at all: versions are part of the join's key, and
    thousands of names that differ in their number don't meet. clash_with: the other pairs, those that clash, of the
    keys in this table with any.
    """
    stem, version = t.version_parts(F.col("key"))
    keys = counts.select("key", stem.alias("stem"), F.coalesce(version, F.lit("")).alias("v"))
    own, probe = _pieces(keys)
    on = ["sn", "p", "piece"]
    one = ((F.col("s_v") == "") != (F.col("l_v") == ""))
    if clash_with is None:
        same = probe.withColumn("v", F.col("l_v")).join(own.withColumn("v", F.col("s_v")), [*on, "v"]).select("long", "short")
        bare_l = probe.filter("l_v = ''").join(own.filter("s_v <> ''"), on).filter("l_stem <> s_stem").select("long", "short")
        bare_s = probe.filter("l_v <> ''").join(own.filter("s_v = ''"), on).filter("l_stem <> s_stem").select("long", "short")
        met = same.unionByName(bare_l).unionByName(bare_s)
    else:
        clash = (~one & (F.col("s_v") != F.col("l_v"))) | (one & (F.col("s_stem") == F.col("l_stem")))
        some = clash_with.select("key").distinct()
        met = probe.join(some.withColumnRenamed("key", "long"), "long", "left_semi").join(own, on).filter(clash).select("long", "short")
        met = met.unionByName(probe.join(own.join(some.withColumnRenamed("key", "short"), "short", "left_semi"), on).filter(clash).select("long", "short"))
    pairs = met.filter("long <> short").select(F.least("long", "short").alias("a"), F.greatest("long", "short").alias("b")).distinct()
    return pairs.filter(_character_bound(F.col("a"), F.col("b")) * 200 >= (F.length("a") + F.length("b")) * least)


def canonicalise(counts: DataFrame, least: float = 90.0) -> DataFrame:
    """GRA2: key, canonical. Greedy in order of frequency (ties: first seen): a form joins the canonical form that is the same
    without initials; else the most similar canonical form of ratio >= 90 (ties: the earlier), unless their versions clash; else it is a new one.

    The greedy order is kept by rounds: in each, those keys decide whose similar earlier keys have all decided (and the
    first undecided of those that are the same without initials). So no group of keys is ever folded in one task, and
    the number of rounds is the length of the longest chain of dependent decisions, not the number of keys.
    """
    place = F.struct((-F.col("n")).alias("n"), "first", "key")
    bare = F.coalesce(F.nullif(t.strip_initials(F.col("key")), F.lit("")), F.col("key"))
    keys = checkpointed(counts.select("key", place.alias("at"), bare.alias("bare")))
    score = lambda pairs, clash: pairs.withColumn("ratio", ratio("a", "b")).filter(F.col("ratio") >= least).withColumn("clash", F.lit(clash))
    merging = checkpointed(score(merge_candidates(keys, least), False))
    ends = keys.select("key", "at")
    placed = lambda pairs: pairs.join(ends.select(F.col("key").alias("a"), F.col("at").alias("at_a")), "a").join(ends.select(F.col("key").alias("b"), F.col("at").alias("at_b")), "b")
    a_first = F.col("at_a") < F.col("at_b")
    directed = lambda pairs: placed(pairs).select(F.when(a_first, F.col("b")).otherwise(F.col("a")).alias("key"), F.when(a_first, F.col("a")).otherwise(F.col("b")).alias("to"), F.least("at_a", "at_b").alias("to_at"), "ratio", "clash")
    links = directed(merging)
    # a clash with the most similar form keeps a key that could join another from merging
    later = checkpointed(links.select("key").distinct())
    clashing = directed(score(merge_candidates(keys, least, clash_with=later), True)).join(later, "key", "left_semi")
    links = checkpointed(links.unionByName(clashing))
    shared = keys.groupBy("bare").agg(F.count("*").alias("m")).filter("m > 1").select("bare")
    involved = keys.join(later, "key", "left_semi").unionByName(keys.join(shared, "bare", "left_semi").select("key", "at", "bare")).unionByName(keys.join(links.select(F.col("to").alias("key")).distinct(), "key", "left_semi")).distinct()
    state = checkpointed(involved.withColumn("canonical", F.lit(None).cast("string")))
    while True:
        owners = state.filter("canonical = key").groupBy("bare").agg(F.min_by("key", "at").alias("owner"))
        state = state.join(owners, "bare", "left").select("key", "at", "bare", F.coalesce("canonical", "owner").alias("canonical"))
        open_ = checkpointed(state.filter("canonical is null"))
        if open_.isEmpty():
            break
        waits = links.join(open_.select(F.col("key").alias("to")), "to", "left_semi").select("key").distinct()
        turn = open_.groupBy("bare").agg(F.min("at").alias("at"))
        active = open_.join(turn, ["bare", "at"], "left_semi").join(waits, "key", "left_anti")
        forms = state.filter("canonical = key").select(F.col("key").alias("to"))
        nearest = links.join(active.select("key"), "key", "left_semi").join(forms, "to", "left_semi").groupBy("key").agg(F.min_by(F.struct("to", "clash"), F.struct((-F.col("ratio")).alias("r"), "to_at")).alias("best"))
        made = active.join(nearest, "key", "left").select("key", F.when(~F.col("best.clash"), F.col("best.to")).otherwise(F.col("key")).alias("made"))
        state = checkpointed(state.join(made, "key", "left").select("key", "at", "bare", F.coalesce("canonical", "made").alias("canonical")))
    return counts.select("key").join(state.select("key", "canonical"), "key", "left").select("key", F.coalesce("canonical", "key").alias("canonical"))


def variant_pairs(keys: DataFrame) -> DataFrame:
    """JOIN10: pairs of canonical keys with one stem and different versions."""
    stem, version = t.version_parts(F.col("canonical"))
    forms = keys.select("canonical").distinct().select("canonical", stem.alias("stem"), version.alias("version"))
    left, right = forms.select("stem", F.col("canonical").alias("a"), F.col("version").alias("va")), forms.select("stem", F.col("canonical").alias("b"), F.col("version").alias("vb"))
    return left.join(right, "stem").filter((F.col("a") < F.col("b")) & ~F.col("va").eqNullSafe(F.col("vb"))).select("a", "b")


#: Keys that a join may send to all executors.
BROADCAST_KEYS = 500_000


def _small(keys: DataFrame) -> DataFrame:
    """keys, to be broadcast if they are few. Joins with tables of the graph's size would else shuffle these, as nothing is known of a checkpoint's size."""
    return F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else keys


def on_canonical(valid: DataFrame, canon: DataFrame) -> DataFrame:
    """JOIN3: triples with their canonical keys src and dst, self-loops included. Only keys that aren't their own canonical ones take part in a join."""
    moved = _small(checkpointed(canon.filter("key <> canonical")))
    src = moved.select(F.col("key").alias("s_key"), F.col("canonical").alias("src"))
    dst = moved.select(F.col("key").alias("o_key"), F.col("canonical").alias("dst"))
    return valid.join(src, "s_key", "left").join(dst, "o_key", "left").withColumns({"src": F.coalesce("src", "s_key"), "dst": F.coalesce("dst", "o_key")})


def nodes_of(triples: DataFrame) -> DataFrame:
    """AGG3, AGG4: key, name, aliases, mentions, sources, ord of the nodes of triples with canonical keys (src, dst).

    Self-loops (FLT12) count for the name only, as in display_names. The triples are read once: all else is made from
    what they add up to by key, name and file.
    """
    edge = F.col("src") != F.col("dst")
    ends = F.array(F.struct(F.col("src").alias("key"), F.col("subject").alias("name"), (F.col("ord") * 2).alias("at")), F.struct(F.col("dst").alias("key"), F.col("object").alias("name"), (F.col("ord") * 2 + 1).alias("at")))
    rows = triples.select("source_file", F.when(edge, F.col("ord")).alias("ord"), edge.alias("edge"), F.explode(ends).alias("e")).select("e.key", "e.name", "e.at", "source_file", "ord", "edge")
    tally = rows.groupBy("key", "name", "source_file").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.count_if("edge").alias("m"), F.min("ord").alias("ord"))
    by = tally.groupBy("key", "name").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.sum("m").alias("m"), F.min("ord").alias("ord"), F.collect_set(F.when(F.col("m") > 0, F.col("source_file"))).alias("sources"))
    best = F.max_by("name", F.struct("n", -F.col("first"))).alias("name")
    node = by.groupBy("key").agg(best, F.sort_array(F.collect_set(F.when(F.col("m") > 0, F.col("name")))).alias("aliases"), F.sum("m").alias("mentions"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"), F.min("ord").alias("ord"))
    return node.filter("mentions > 0").select("key", "name", "aliases", "mentions", "sources", "ord")


def build(triples: DataFrame, merge: bool = True, variants: bool = True) -> tuple[DataFrame, DataFrame]:
    """GRA1, GRA13: (nodes, edges) of triples; variants are linked both ways after all other edges.

    All pairs of a stem are linked, so what a stem of very many versions gives is quadratic in their number, by
    definition; variants=False leaves these edges out.
    """
    valid = materialised(valid_triples(triples))
    if merge:
        canon = checkpointed(canonicalise(entity_counts(valid)))
        placed = on_canonical(valid, canon)
    else:
        placed = valid.withColumnsRenamed({"s_key": "src", "o_key": "dst"})
    nodes, edges = nodes_of(placed), placed.filter("src <> dst")
    if not variants:
        return nodes, edges.select(*EDGE)
    have = checkpointed(nodes.select("key"))
    pairs = variant_pairs(have.withColumnRenamed("key", "canonical")).join(have.withColumnRenamed("key", "a"), "a", "left_semi").join(have.withColumnRenamed("key", "b"), "b", "left_semi")
    last = F.lit(2**40)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e"))
    variants = both.select("e.src", "e.dst", F.lit("variant_of").alias("relation"), F.lit("(entity resolution)").alias("source_file"), F.lit(0).alias("page"), F.lit("").alias("sentence"), F.lit("resolution").alias("extractor"), (last + F.pmod(F.xxhash64("e.src", "e.dst"), F.lit(2**40))).alias("ord"))
    return nodes, edges.select(*EDGE).unionByName(variants)


# Measures


def degrees(edges: DataFrame) -> DataFrame:
    """AGG5: key, degree (both directions, parallel edges counted)."""
    return edges.select(F.explode(F.array("src", "dst")).alias("key")).groupBy("key").agg(F.count("*").alias("degree"))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GRA8, AGG6: n_nodes, n_edges, n_relations, density, in one row."""
    n = nodes.agg(F.count("*").alias("n_nodes"))
    m = edges.agg(F.count("*").alias("n_edges"), F.countDistinct("relation").alias("n_relations"))
    return n.join(m, F.lit(True)).withColumn("density", F.when(F.col("n_nodes") > 1, F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1))).otherwise(0.0))


def stats_of_edges(edges: DataFrame) -> DataFrame:
    """stats() of edges and the nodes at their ends, which reads the edges once."""
    by = edges.select(F.explode(F.array("src", "dst")).alias("key"), "relation").groupBy("key", "relation").agg(F.count("*").alias("n"))
    total = by.agg(F.countDistinct("key").alias("n_nodes"), (F.coalesce(F.sum("n"), F.lit(0)) / 2).cast("long").alias("n_edges"), F.countDistinct("relation").alias("n_relations"))
    return total.withColumn("density", F.when(F.col("n_nodes") > 1, F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1))).otherwise(0.0))


def components(pairs: DataFrame) -> DataFrame:
    """AGG18: key, component (its least key) of weakly connected nodes, from pairs (a, b). Least labels with pointer jumping."""
    both = checkpointed(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("key"), F.least("a", "m").alias("component")))
    while True:
        near = both.join(labels.select(F.col("key").alias("b"), "component"), "b").groupBy(F.col("a").alias("key")).agg(F.min("component").alias("m"))
        step = labels.join(near, "key", "left").select("key", F.col("component").alias("old"), F.least("component", "m").alias("new"))
        up = step.select(F.col("key").alias("new"), F.col("new").alias("up"))
        step = checkpointed(step.join(up, "new", "left").select("key", "old", F.least("new", "up").alias("component")))
        labels = step.select("key", "component")
        if step.filter("old <> component").limit(1).isEmpty():
            return labels


def parallel_edges(edges: DataFrame) -> DataFrame:
    """AGG14: src, dst, relation, n, citations, first non-empty sentence."""
    cite = F.concat_ws(" p.", "source_file", F.col("page").cast("string"))
    first = F.min_by(F.when(F.col("sentence") != "", F.col("sentence")), F.when(F.col("sentence") != "", F.col("ord")))
    return edges.groupBy("src", "dst", "relation").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set(cite)), "; ").alias("citations"), F.coalesce(first, F.lit("")).alias("sentence"))


SUBJECT_TYPE = {"MODEL": ("achieves", "evaluated_on", "extends", "improves_on", "outperforms", "trained_on", "underperforms"), "PERSON": ("introduces", "proposes")}
OBJECT_TYPE = {"DATASET": ("evaluated_on", "trained_on"), "METRIC": ("achieves",)}
PROPOSED = ("creator", "designed by", "developer", "discoverer or inventor", "introduces", "proposes")
NAME_TYPE = [
    ("PERSON", 3, r"(?i)\bet\s+al\b\.?$|^[a-z]\.\s*[a-z]{2}"),
    ("ORG", 2, r"(?i)(^|\s)(berkeley|brain|deepmind|facebook|google|institute|labs?|meta|microsoft|mit|nvidia|openai|research|stanford|university)(\s|$)"),
    ("METRIC", 2, r"(?i)%|\b(ap|map)\b|accuracy|bleu|error rate|fps|score|top-?[0-9]"),
    ("DATASET", 2, r"(?i)cityscapes|coco|imagenet|jft|kitti|pascal|voc|wmt|\b(benchmark|dataset)\b"),
    ("MODEL", 2, r"(?i)bert|detr|gpt|net\b|r-cnn|swin|transformer|vgg|vit\b|yolo"),
]


def entity_types(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GRA11, AGG15: key, type by votes of relations and name; CONCEPT where nothing votes; ties to what voted first."""
    def votes(end: str, table: dict[str, tuple[str, ...]], weight: int, base: int) -> Column:
        kind = F.lit(None).cast("string")
        for k, relations in table.items():
            kind = F.when(F.col("relation").isin(list(relations)), F.lit(k)).otherwise(kind)
        return F.struct(F.col(end).alias("key"), kind.alias("type"), F.lit(weight).alias("w"), (F.lit(base) * F.lit(2**50) + F.col("ord")).alias("at"))

    telling = [r for table in (SUBJECT_TYPE, OBJECT_TYPE, {"MODEL": PROPOSED}) for relations in table.values() for r in relations]
    said = F.array(votes("src", SUBJECT_TYPE, 2, 0), votes("dst", OBJECT_TYPE, 2, 1), votes("dst", {"MODEL": PROPOSED}, 1, 1))
    named = F.array(*[F.struct(F.col("key"), F.when(F.col("name").rlike(pattern), F.lit(kind)).alias("type"), F.lit(weight).alias("w"), F.lit((2 + i) * 2**50).alias("at")) for i, (kind, weight, pattern) in enumerate(NAME_TYPE)])
    every = edges.filter(F.col("relation").isin(telling)).select(F.explode(said).alias("v")).select("v.*").unionByName(nodes.select(F.explode(named).alias("v")).select("v.*"))
    tally = every.filter("type is not null").groupBy("key", "type").agg(F.sum("w").alias("w"), F.min("at").alias("at"))
    best = tally.groupBy("key").agg(F.max_by("type", F.struct("w", -F.col("at"))).alias("type"))
    return nodes.select("key").join(best, "key", "left").select("key", F.coalesce("type", F.lit("CONCEPT")).alias("type"))


def visual_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """SNK8: key, name, type, degree, size (12 + 5 * sqrt(degree)) of a drawing's nodes."""
    drawn = nodes.join(degrees(edges), "key", "left").join(entity_types(nodes, edges), "key")
    return drawn.select("key", "name", "type", F.coalesce("degree", F.lit(0)).alias("degree"), (12 + 5 * F.sqrt(F.coalesce("degree", F.lit(0)))).alias("size"))


# Look-up

#: Mentions that one pass over the nodes scores.
MENTION_BLOCK = 10_000


def lookup(mentions: DataFrame, nodes: DataFrame, least: float = 80.0, fuzzy: bool = True) -> DataFrame:
    """GRA10, JOIN4-6: mention -> key, score: the key itself, else an alias (first node), else the best fuzzy match.

    Only mentions that nothing exact settled are scored: see similar().
    """
    keyed = mentions.select("mention", t.normalise_entity(F.col("mention")).alias("q"))
    alias = nodes.select(F.explode("aliases").alias("alias"), "key", "ord").withColumn("q", t.normalise_entity(F.col("alias")))
    exact = nodes.select(F.col("key").alias("q"), "key", F.lit(0).alias("tier"), "ord").unionByName(alias.select("q", "key", F.lit(1).alias("tier"), "ord"))
    found = keyed.join(exact, "q").groupBy("mention").agg(F.min_by("key", F.struct("tier", "ord", "key")).alias("key")).withColumn("score", F.lit(100.0))
    if not fuzzy:
        return found
    rest = checkpointed(keyed.join(found, "mention", "left_anti"))
    scored = similar(rest, nodes.select("key", "ord"), least)
    best = scored.groupBy("mention").agg(F.max_by("key", F.struct("score", -F.col("ord"))).alias("key"), F.max("score").alias("score"))
    return found.unionByName(best)


def _letters(texts: list[str]) -> np.ndarray:
    """How often each text has each of _CHARACTERS, and any other (last column)."""
    raw = [x.encode() for x in texts]
    size = np.array([len(x) for x in raw], "int64")
    flat = np.frombuffer(b"".join(raw), "uint8")
    kind = _KIND[flat]
    row = np.repeat(np.arange(len(raw)), size)[kind >= 0]
    return np.bincount(row * (len(_CHARACTERS) + 1) + kind[kind >= 0], minlength=len(raw) * (len(_CHARACTERS) + 1)).reshape(len(raw), -1).clip(max=2**15 - 1).astype("int16")


_CHARACTERS = "abcdefghijklmnopqrstuvwxyz0123456789 -"
_KIND = np.full(256, len(_CHARACTERS), "int64")
_KIND[[ord(c) for c in _CHARACTERS]] = np.arange(len(_CHARACTERS))
_KIND[0x80:0xC0] = -1  # the rest of a character of more than one byte


def _alike(asked: Broadcast, least: float, schema: T.StructType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mention, q = asked.value
        counts, length = _letters(q), np.array([len(x) for x in q])
        by_word: dict[str, list[int]] = {}
        for i, x in enumerate(q):
            for w in set(x.split(" ")):
                by_word.setdefault(w, []).append(i)
        for batch in batches:
            keys = batch.column("key").to_pylist()
            own, size = _letters([k or "" for k in keys]), np.array([len(k or "") for k in keys])
            meet = [[i for w in set((k or "").split(" ")) if w in by_word for i in by_word[w]] for k in keys]
            word = np.repeat(np.arange(len(keys)), [len(m) for m in meet]), np.array([i for m in meet for i in m], "int64")
            found: list[tuple[int, int, float]] = []
            for i in range(len(q)):
                both = np.minimum(own, counts[i]).sum(1, dtype="int64")
                short, long = np.minimum(size, length[i]), np.maximum(size, length[i])
                # plain and sorted-token ratios; a part of the longer one (0.9 of its ratio at most); a shared word
                may = (both * 200 >= (size + length[i]) * least) | ((long >= short * 1.5) & (both * 100 >= short * (least / 0.9)))
                may[word[0][word[1] == i]] = True
                found += [(n, i, s) for n in np.flatnonzero(may) if keys[n] is not None and (s := weighted_ratio(q[i], keys[n])) >= least]
            if found:
                n, i, s = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array([mention[j] for j in i], pa.string()), batch.column("key").take(pa.array(n)), batch.column("ord").take(pa.array(n)), pa.array(s, pa.float64())], names=schema.names)

    return run


def similar(mentions: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """mention, key, ord, score of all nodes (key, ord) whose lenient score reaches `least`, for a stated set of mentions (mention, q).

    Exhaustive, in blocks of MENTION_BLOCK mentions, which go to all nodes; a node is scored only if both have the
    characters or a word in common without which no part of the score can reach `least`. Characters are counted once a
    node and compared as arrays.
    """
    blocks = max(1, -(-mentions.count() // MENTION_BLOCK))
    found = None
    # a small table of nodes would else be scored by one task
    nodes = nodes.select("key", "ord").repartition(4 * nodes.sparkSession.sparkContext.defaultParallelism)
    kind = T.StructType([T.StructField("mention", T.StringType()), T.StructField("key", T.StringType()), T.StructField("ord", nodes.schema["ord"].dataType), T.StructField("score", T.DoubleType())])
    for b in range(blocks):
        own = mentions.filter(F.pmod(F.xxhash64("mention"), F.lit(blocks)) == b).filter("q is not null").select("mention", "q").collect()
        sent = nodes.sparkSession.sparkContext.broadcast(([r[0] for r in own], [r[1] for r in own]))
        scored = nodes.mapInArrow(_alike(sent, least, kind), kind)
        found = scored if found is None else found.unionByName(scored)
    return found


# Traversal


def adjacency(edges: DataFrame) -> DataFrame:
    """GRA4: edges both ways: node, nbr, dir (0 outgoing, 1 incoming) and the edge's columns."""
    rest = [c for c in EDGE if c not in ("src", "dst")]
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("nbr"), F.lit(0).alias("dir"), *rest)
    return out.unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("nbr"), F.lit(1).alias("dir"), *rest))


def neighbours(starts: DataFrame, edges: DataFrame, hops: int = 2, most: int = 200) -> DataFrame:
    """GRA3, for many starts at once: start, key, hop, path (array of steps) of what lies within `hops`.

    Each newly reached node comes with all parallel edges from its first parent, in one direction (outgoing first); the
    first edge carries the path on; at most `most` rows a start, in order of discovery.
    """
    adj = adjacency(edges)
    step = F.struct(F.col("node").alias("from"), F.col("nbr").alias("to"), F.col("relation"), F.when(F.col("dir") == 0, "outgoing").otherwise("incoming").alias("direction"), "source_file", "page", "sentence", "extractor")
    kind = "array<struct<from:string,to:string,relation:string,direction:string,source_file:string,page:int,sentence:string,extractor:string>>"
    front = starts.select("start", F.col("start").alias("node"), F.lit(0).cast("long").alias("front_ord"), F.array().cast(kind).alias("path"))
    visited = front.select("start", "node")
    done = starts.select("start").withColumn("done", F.lit(0).cast("long")).limit(0)
    found: DataFrame | None = None
    for hop in range(1, hops + 1):
        near = adj.join(_small(front.select("node").distinct()), "node", "left_semi")
        reach = front.join(near, "node").join(visited.select("start", F.col("node").alias("nbr")), ["start", "nbr"], "left_anti")
        pair = Window.partitionBy("start", "node", "nbr", "dir")
        reach = reach.withColumn("pair_ord", F.min("ord").over(pair))
        # the winning (parent, direction) of each new node: an aggregation, then its rows
        rank = F.struct("front_ord", "dir", "pair_ord")
        reach = reach.withColumn("won", F.min(rank).over(Window.partitionBy("start", "nbr"))).filter(rank == F.col("won"))
        # what is emitted stops at `most` rows of a start, so no later row of this hop, and no later hop, is built for it
        place = F.row_number().over(Window.partitionBy("start").orderBy("won", "ord"))
        reach = reach.withColumn("place", place).filter(F.col("place") <= most).join(done, "start", "left").withColumn("emitted", F.col("place") + F.coalesce("done", F.lit(0))).filter(F.col("emitted") <= most)
        reach = reach.withColumn("path", F.concat("path", F.array(step.cast(kind[6:-1])))).withColumn("hop", F.lit(hop))
        reach = checkpointed(reach.select("start", F.col("nbr").alias("key"), "hop", "path", "won", "ord", "emitted"))
        found = reach if found is None else found.unionByName(reach)
        if hop == hops:
            break
        done = found.groupBy("start").agg(F.max("emitted").cast("long").alias("done"))
        first = reach.groupBy("start", "key").agg(F.min_by("path", "ord").alias("path"), F.min("won").alias("won"))
        front = first.join(done.filter(F.col("done") < most), "start").select("start", F.col("key").alias("node"), F.row_number().over(Window.partitionBy("start").orderBy("won")).cast("long").alias("front_ord"), "path")
        visited = visited.unionByName(front.select("start", "node"))
    return found.select("start", "key", "hop", "path", F.col("emitted").cast("int").alias("emitted"))


def shortest_paths(pairs: DataFrame, edges: DataFrame, most: int = 4) -> DataFrame:
    """GRA6: start, goal, length of pairs of nodes within `most` hops of each other, edges taken either way. Breadth first, a frontier per start."""
    adj = checkpointed(adjacency(edges).select("node", "nbr").distinct())
    front = pairs.filter("start <> goal").select("start", F.col("start").alias("node")).distinct()
    visited, found = front, None
    for hop in range(1, most + 1):
        front = checkpointed(front.join(adj, "node").select("start", F.col("nbr").alias("node")).distinct().join(visited, ["start", "node"], "left_anti"))
        hit = pairs.join(front.withColumnRenamed("node", "goal"), ["start", "goal"]).select("start", "goal", F.lit(hop).alias("length"))
        found = hit if found is None else found.unionByName(hit)
        visited = visited.unionByName(front)
    return found.distinct()


def subgraph(start: str, edges: DataFrame, hops: int = 2, most: int = 60) -> tuple[DataFrame, DataFrame]:
    """GRA7, JOIN9: (keys, edges among them) of the first `most` nodes around start, nearest first."""
    spark = edges.sparkSession
    near = neighbours(spark.createDataFrame([(start,)], "start string"), edges, hops, 2**31 - 1).groupBy("key").agg(F.min(F.struct("hop", "emitted")).alias("at"))
    keys = near.orderBy("at").limit(most - 1).select("key").unionByName(spark.createDataFrame([(start,)], "key string"))
    own = edges.join(keys.withColumnRenamed("key", "src"), "src", "left_semi").join(keys.withColumnRenamed("key", "dst"), "dst", "left_semi")
    return keys, own


def edges_between(edges: DataFrame, a: str, b: str) -> DataFrame:
    """GRA5."""
    return edges.filter((F.col("src") == a) & (F.col("dst") == b))


def format_path(path: Column) -> Column:
    """GRA9: `A --[r]--> B <--[s]-- C`."""
    steps = F.transform(path, lambda s: F.when(s["direction"] == "outgoing", F.concat(F.lit(" --["), s["relation"], F.lit("]--> "), s["to"])).otherwise(F.concat(F.lit(" <--["), s["relation"], F.lit("]-- "), s["to"])))
    return F.when(F.size(path) > 0, F.concat(F.get(path, F.lit(0))["from"], F.array_join(steps, ""))).otherwise(F.lit(""))
