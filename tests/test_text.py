from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.functions.udfs import hash_embedding, lcs_ratio, sentence_spans, snapped, weighted_ratio
from tessera.operators import cleaning, chunking


def slow_ratio(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return 200.0 * row[-1] / (len(a) + len(b))


@settings(max_examples=200, deadline=None)
@given(st.text("abc -", min_size=1, max_size=12), st.text("abc -", min_size=1, max_size=12))
def test_ratio_is_the_longest_common_subsequence(a, b):
    assert abs(lcs_ratio(a, b) - slow_ratio(a, b)) < 1e-9


def test_lenient_ratio_forgives_order_and_surplus():
    assert weighted_ratio("star orion", "orion star") >= 95
    assert weighted_ratio("orion", "orion star map") >= 90
    assert weighted_ratio("orion", "lyra") < 60


def test_snap():
    text = "One two three. Four five six seven eight"
    assert text[: snapped(text, 16)] == "One two three."
    assert snapped("abcdefghij", 4, 2) == 4
    assert snapped("ab cd", 99) == 5


def test_sentences_keep_abbreviations():
    text = "Stone et al. saw it in Fig. 3 at 2.5 m. It was slow! Was it?"
    assert [text[a:b] for a, b in sentence_spans(text)] == ["Stone et al. saw it in Fig. 3 at 2.5 m.", "It was slow!", "Was it?"]


def test_embeddings_are_unit_vectors():
    v = hash_embedding("slow stars")
    assert abs(sum(x * x for x in v) - 1) < 1e-6 and v == hash_embedding("slow stars") and not any(hash_embedding(""))


def test_clean_pages(spark):
    body = ["It was a long walk and the re-\nmains of the day", "were few. The ﬁrst\nline goes on", "and on\n\nuntil here", "x y z", "words", "end"]
    pages = spark.createDataFrame([("d", i + 1, f"Journal of Stars\n{b}\nFooter {i + 1}\n{i + 1}") for i, b in enumerate(body)], "doc string, page int, text string")
    found = {r["fp"] for r in cleaning.repeating_lines(pages).collect()}
    assert found == {"journal of stars", "footer #", "#"}
    text = {r["page"]: r["text"] for r in cleaning.clean_pages(pages).collect()}
    assert text[1] == "It was a long walk and the remains of the day"
    assert text[2] == "were few. The first line goes on" and text[3] == "and on\n\nuntil here"
    assert cleaning.repeating_lines(pages.filter("page <= 2")).count() == 0


def test_references_end_at_an_appendix():
    body = "Some words about stars. " * 30
    assert cleaning.strip_references(f"{body}\nReferences\n[1] A book.").strip() == body.strip()
    assert "More words" in cleaning.strip_references(f"{body}\nReferences\n[1] A book.\nAppendix A\nMore words.")
    assert cleaning.reference_span(f"Intro\nReferences\n{body}") is None


def test_references_are_cut_across_pages(spark):
    body = "Some words about stars. " * 30
    pages = spark.createDataFrame([("d", 1, body), ("d", 2, "Tail.\nReferences\n[1] A."), ("d", 3, "[2] B."), ("d", 4, "Appendix A\nMore.")], "doc string, page int, text string")
    text = {r["page"]: r["text"] for r in cleaning.cut_references(pages).collect()}
    assert text[2].strip() == "Tail." and text[3] == "" and "More." in text[4]


def test_fixed_chunks_share_the_overlap(spark):
    text = "".join(chr(97 + i % 26) for i in range(1300))
    rows = chunking.chunk_fixed(spark.createDataFrame([("d", text)], "doc string, text string")).orderBy("start").collect()
    assert [r["start"] for r in rows] == [0, 400, 800] and all(a["text"][-100:] == b["text"][:100] for a, b in zip(rows, rows[1:]))


def test_overlap_must_be_smaller(spark):
    try:
        chunking.chunk_fixed(spark.createDataFrame([], "doc string, text string"), 100, 100)
    except ValueError:
        return
    raise AssertionError


def test_semantic_chunks_do_not_run_away():
    text = "\n\n".join("row of words without an end" for _ in range(300))
    chunks = list(chunking.pack(text))
    assert sum(len(c[3]) for c in chunks) < 2 * len(text) and max(len(c[3]) for c in chunks) <= 1300
    parts = list(chunking.pack("Abstract\n\nFirst words here.\n\n2 Method\n\nSecond words here."))
    assert [(c[2], c[3]) for c in parts] == [("Abstract", "First words here."), ("2 Method", "Second words here.")]


def test_pages_of_offsets(spark):
    pages = spark.createDataFrame([("d", 1, "abc"), ("d", 2, "  "), ("d", 3, "defg")], "doc string, page int, text string")
    joined = cleaning.join_pages(pages)
    got = joined.select(*[chunking.page_of(F.lit(i), F.col("spans")).alias(f"p{i}") for i in (0, 2, 3, 5, 99)]).first()
    assert list(got) == [1, 1, 3, 3, 3]


def test_entities(spark):
    names = ["The Orion", "it", "x1", "12345a", "orion orion", "a = b", "Stone et al.", "Vega v3"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", t.normalise_entity(F.col("n")).alias("k"), t.is_valid_entity(F.col("n")).alias("v")).collect()
    assert [r["v"] for r in rows] == [True, False, False, False, False, False, True, True]
    assert rows[0]["k"] == "orion"
    stem, version = t.version_parts(F.lit("vega v3"))
    assert list(spark.range(1).select(stem, version).first()) == ["vega", "3"]


def test_documents_are_cut_a_few_at_a_time(spark):
    """A worker holds the rows of a few documents, not of a batch (F20, F21), and windows don't carry their document's text into a shuffle."""
    docs = spark.createDataFrame([(i % 200, "One is here. Two is there! " * (1 + i % 40)) for i in range(300)] + [(900, ""), (901, None)], "doc int, text string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    rows = chunking.sentences(docs)
    assert "MapInArrow" in plan(rows) and "Generate" not in plan(rows)
    assert rows.count() == sum(2 * (1 + i % 40) for i in range(300))
    cut = chunking.chunk_fixed(docs, snap=True)
    assert "ArrowEvalPython" not in plan(cut) and "Generate" not in plan(cut)
    made = chunking._snapped_windows(500, 400)("x" * 3000)
    sizes = [(a, b, done) for a, b, done, _ in made]
    assert sizes[0] == (0, 500, False) and sizes[-1] == (2800, 3000, True)
