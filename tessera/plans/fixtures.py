"""Literal inputs for operators that no driver table can exercise, and their SQL forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

HEADINGS = ["Abstract", "1 Introduction", "2.1 Related Work", "we then measure", "Results.", "3. Method", "Table 3:", "Conclusion", "7 of them are lost in the long tail of all the rest", "A", "Limitations :"]


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def headings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(HEADINGS)), "id int, line string")


MARKUP = [
    "<s><triplet> Orion <subj> Vega <obj> outperforms</s>",
    "<triplet> Orion <subj> Vega <obj> extends <subj> Lyra <obj> uses",
    "<triplet> Orion <subj> Vega <obj> extends <triplet> Lyra <subj> Mira <obj> trained on",
    "<pad><triplet> Orion <subj> Vega",
    "<triplet> Orion <subj> Vega <obj> extends <triplet> orion <subj> vega <obj> Extends",
    "nothing at all",
]
MARKUP_SQL = """SELECT * FROM (VALUES (0, 'Orion', 'outperforms', 'Vega'), (1, 'Orion', 'extends', 'Vega'), (1, 'Orion', 'uses', 'Lyra'), (2, 'Orion', 'extends', 'Vega'),
  (2, 'Lyra', 'trained on', 'Mira'), (4, 'Orion', 'extends', 'Vega')) v(id, subject, relation, object)"""


def markup(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(MARKUP)), "id int, markup string")


QUESTIONS = ["Which models outperformed Orion?", "Who wrote the Vega paper?", "What was Lyra trained on?", "Tell me about Mira.", "Is Orion worse than Vega?", "How does Vega compare to Lyra?"]
CUES_SQL = """SELECT * FROM (VALUES (0, 'outperforms'), (1, 'authored'), (1, 'proposes'), (2, 'trained_on'), (4, 'underperforms'), (5, 'compared_to')) v(qid, relation)"""


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(QUESTIONS)), "qid int, question string")


REPLIES = [
    '{"correctness": 5, "completeness": 4, "grounding": 3, "reason": "fine"}',
    'Here you are: {"correctness": 9, "completeness": -2, "grounding": 2}',
    "no marks today",
    '```json\n{"correctness": "high", "completeness": 3, "grounding": 3}\n```',
    '{"correctness": 4}',
    "",
    '{"correctness": 4, ',
]
JUDGE_SQL = """SELECT * FROM (VALUES (0, 5, 4, 3, false), (1, 5, 1, 2, false), (2, 0, 0, 0, true), (3, 0, 3, 3, false), (4, 4, 1, 1, false), (5, 0, 0, 0, true), (6, 0, 0, 0, true))
  v(id, correctness, completeness, grounding, parse_failed)"""


def replies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*enumerate(REPLIES), (7, None)][:7], "id int, reply string")


SENTENCES = ["Orion outperforms Vega on the Lyra benchmark by a wide margin.", "The Vega encoder was proposed by Stone et al. for small machines.", "We train Orion on the public Lyra corpus with large batches.", "Mira is faster than Vega on every machine that we tried.", "Orion extends Vega and it also uses shifted windows."]


def sentences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("paper", 1, i, s) for i, s in enumerate(SENTENCES)], "source_file string, page int, sent_index int, sentence string")


def papers(spark: SparkSession) -> DataFrame:
    body = "Some words about stars. " * 40
    rows = [("plain", body), ("cited", f"{body}\nReferences\n[1] A book."), ("appendix", f"{body}\nReferences\n[1] A book.\nAppendix A\nMore words."), ("early", f"Intro\nReferences\n{body}"), ("numbered", f"{body}\n7. Bibliography\n[1] A book."), ("empty", "")]
    return spark.createDataFrame(rows, "doc string, text string")


def blocks(spark: SparkSession) -> DataFrame:
    rows = [("a", 1, 50.0, 50.0, 550.0, 70.0, "Title", 0, 600.0)]
    rows += [("a", 1, 50.0, y, 280.0, y + 20, f"left {i}", 0, 600.0) for i, y in enumerate((100.0, 200.0, 300.0))]
    rows += [("a", 1, 320.0, y, 550.0, y + 20, f"right {i}", 0, 600.0) for i, y in enumerate((100.0, 200.0, 300.0))]
    rows += [("b", 1, 50.0, 200.0, 500.0, 220.0, "second", 0, 600.0), ("b", 1, 50.0, 100.0, 500.0, 120.0, "first", 0, 600.0), ("b", 1, 50.0, 10.0, 500.0, 20.0, "picture", 1, 600.0)]
    return spark.createDataFrame(rows, "doc string, page int, x0 double, y0 double, x1 double, y1 double, text string, kind int, page_width double")


def first_pages(spark: SparkSession) -> DataFrame:
    rows = [
        ("a", ["Orion: Slow Stars for\nRestless Observers\nAnna Bell Carl Dorn University of Nowhere\nEva Finch*\nAbstract\nStars are slow.", "More."]),
        ("b", ["A Longer Look\n1 Introduction\nNothing here."]),
        ("c", [""]),
    ]
    return spark.createDataFrame(rows, "source_file string, pages array<string>")


#: 960 characters of words and a newline come before the heading; an appendix is no reference.
REFERENCES_SQL = """SELECT doc, CAST(s AS INTEGER) AS "start", CAST(e AS INTEGER) AS "end" FROM (VALUES ('plain', NULL, NULL), ('cited', 961, 983), ('appendix', 961, 984), ('early', NULL, NULL), ('numbered', 961, 988), ('empty', NULL, NULL)) v(doc, s, e)"""
ORDER_SQL = """SELECT doc, 1 AS page, array_to_string(t, chr(10) || chr(10)) AS text FROM (VALUES ('a', ['Title', 'left 0', 'left 1', 'left 2', 'right 0', 'right 1', 'right 2']), ('b', ['first', 'second'])) v(doc, t)"""
RULES_SQL = """SELECT * FROM (VALUES (0, 'Orion', 'outperforms', 'Vega'), (1, 'Stone et al.', 'proposes', 'Vega encoder'), (2, 'Orion', 'trained_on', 'public Lyra corpus'),
  (3, 'Mira', 'outperforms', 'Vega'), (4, 'Orion', 'extends', 'Vega')) v(sent_index, subject, relation, object)"""
