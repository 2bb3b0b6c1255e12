"""Stages one by one on a small corpus, against what each must keep."""

import random
from collections import Counter

import pytest

import corpus_pipeline as cp
from tests.llm.test_operators import DOCS, classes_of, target_of, words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice(["stone", "river", "cloud", "walks", "under", "green", "seven", "paper", "north", "lamps", "early", "birds"]) + str(rng.randint(0, 99)) for _ in range(n))
    item = say(40)
    rows = []
    for i in range(240):
        text = say(60) + (" grotbag grotbag " if i % 5 == 0 else " ") + say(10)
        if i % 7 == 1:
            text = rows[-1][1] + " tail"
        if i % 11 == 3:
            text = say(30) + " " + item + " " + say(30)
        rows.append((i, text, "en", "big" if i % 3 else f"s{i % 4}", len(text)))
    rows += [rows[2], (300, None, None, None, 0), (301, "", "en", "s1", 0), (None, say(50), "en", "s1", 5)]
    # rows without an id are judged as others; the item is less than a twentieth of a long text; an id of two texts
    rows += [(None, say(60) + " grotbag grotbag " + say(9), "en", "s1", 5), (None, rows[2][1], "en", "s1", 5), (None, say(50) + " " + item, "en", "s1", 5)]
    rows += [(310, say(900) + " " + item + " " + say(900), "en", "s1", 5), (311, say(70), "en", "s2", 5), (311, rows[6][1] + " tail", "en", "s2", 5)]
    rows += [(None, rows[-2][1] + " tail", "en", "s3", 5), (None, rows[-2][1] + " tail", "en", "s3", 5)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int("grotbag" in rows[i][1])) for i in range(240)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows


def test_stages(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")

    def stage(k, docs):
        out = cp.STAGES[k][1](spark, docs, path)
        out.write.mode("overwrite").parquet(f"{path}/stage{k}")
        return spark.read.parquet(f"{path}/stage{k}")

    plain = stage(0, docs)
    left = [tuple(r) for r in plain.collect()]
    assert plain.columns == COLUMNS and Counter(left) == Counter(r for r in rows if "grotbag" not in (r[1] or ""))
    once = stage(1, plain)
    got = Counter(tuple(r) for r in once.collect())
    # of a class, the first by id, where ids come before none; numbers stand for the rows
    order = sorted(set(left), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    classes = classes_of(list(enumerate(r[1] for r in order)), 5, 80)
    assert got == Counter({r: 1 for i, r in enumerate(order) if classes[i][1] == i})
    clean = stage(2, once)
    kept = [tuple(r) for r in clean.collect()]
    item = " ".join(words(spark.read.parquet(f"{path}/benchmark.parquet").first()["text"]))
    assert Counter(kept) == Counter(r for r in got if item not in (r[1] or "")) and len(kept) < len(got)
    mixed = stage(3, clean)
    copies = Counter(tuple(r) for r in mixed.collect())
    assert mixed.columns == COLUMNS and set(copies) <= set(kept) and max(copies.values()) <= 2
    sizes, taken = Counter(), Counter()
    for r in kept:
        sizes[r[3]] += len(words(r[1]))
    for r, n in copies.items():
        taken[r[3]] += n * len(words(r[1]))
    assert all(abs(taken[s] - t) <= 80 for s, t in target_of(sizes).items())
    last = stage(4, mixed)
    assert Counter(tuple(r) for r in last.select(COLUMNS).collect()) == copies
    shards = Counter(r["shard"] for r in last.collect())
    assert sum(shards.values()) == sum(copies.values()) and max(shards.values()) - min(shards.values()) <= 1


def test_empty_tables_pass_through(spark, folder, tmp_path):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    assert all(f(spark, docs, path).count() == 0 for _, f in cp.STAGES)
    assert DOCS.startswith("doc_id")
