import pytest

from folioloom.plans.engine import Engine, Settings, hashing_embedder

from .layouts import SCHEMA, body, book, lines, topics


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("store")), Settings(chunk_size=400, chunk_overlap=60), embed=hashing_embedder(256))
    rows = lines(topics(), "topics") + lines(book(), "book", header="My Sample Book", page_numbers=True)
    report = [[("1 Background", 18, True), *body("Words about the plan")], [("2 Costs", 18, True), *body("What it costs"), ("Table 1: Grant budget by year", 11, False)], [("3 Outlook", 18, True), *body("What comes next")]]
    rows += lines(report, "report")
    e.summary = {r.doc: r for r in e.ingest(spark.createDataFrame(rows, SCHEMA)).collect()}
    return e


def test_ingest_counts(engine):
    assert (engine.summary["book"].page_count, engine.summary["book"].sections, engine.summary["book"].units) == (6, 3, 3)
    assert (engine.summary["topics"].page_count, engine.summary["topics"].sections, engine.summary["topics"].units) == (10, 5, 5)
    pages = engine.store.read("pages").where("doc = 'book'").collect()
    assert not any("My Sample Book" in p.text for p in pages)


def test_sections_and_fields(engine):
    rows = {r.idx: r for r in engine.store.read("sections").where("doc = 'topics'").collect()}
    assert rows[0].title == "001. Topic Title 1" and rows[0].number == 1 and rows[0].display_number == "001"
    assert rows[1].fields == {"Domain": "Technology"} and rows[2].page_start == 5 and rows[2].page_end == 6
    assert {r.explicit_numbers for r in rows.values()} == {True}


def test_chunks_stay_in_their_sections(engine):
    sections = {(r.doc, r.idx): r for r in engine.store.read("sections").collect()}
    text = {(r.doc, r.page): r.text for r in engine.store.read("pages").collect()}
    for c in engine.store.read("chunks").collect():
        s = sections[c.doc, c.section]
        assert s.page_start <= c.page <= s.page_end and len(c.text) <= 400 and text[c.doc, c.page][c.start : c.end] == c.text
        assert c.section_path == s.title and c.unit == c.section


def test_answers(engine, spark):
    asked = [
        ("topics", 1, "How many topics are there?"), ("topics", 2, "list topics with domain technology"), ("topics", 3, "What is the title of topic 4?"), ("topics", 4, "explain topic 9"),
        ("topics", 5, "explain topic 2"), ("topics", 6, "summarize it"), ("topics", 7, "how does gradient descent variant ccc work?"), ("topics", 8, "who won the football world championship finals?"),
        ("topics", 9, "where is gradient descent mentioned?"), ("topics", 10, "how many pages are in this document?"), ("book", 1, "list all chapters"), ("report", 1, "What does Table 1 show?"),
    ]
    got = {(r.doc, r.turn): r for r in engine.ask(spark.createDataFrame(asked, "doc string, turn int, text string")).collect()}
    assert len(got) == len(asked)
    assert got["topics", 1].answer.startswith("The document contains 5 topics. They are numbered 001 to 005.")
    assert "2 found" in got["topics", 2].answer and "Topic Title 2" in got["topics", 2].answer and "Topic Title 1 " not in got["topics", 2].answer
    assert 'Topic 004 is "Topic Title 4"; Domain: Technology [Pages 7–8].' in got["topics", 3].answer
    assert got["topics", 4].answer == "I couldn't find topic 9 in the uploaded PDF. It contains 5 top-level topics. They are numbered 001 to 005."
    assert got["topics", 5].answer == "Grounded answer [Page 3]." and {s.page for s in got["topics", 5].sources} == {3}
    assert got["topics", 6].answer == "Grounded answer [Page 3]."
    assert got["topics", 7].intent == "qa" and got["topics", 7].answer == "Grounded answer [Page 5]."
    assert got["topics", 8].answer == "I couldn't find that in the uploaded PDF." and not got["topics", 8].sources
    assert got["topics", 9].answer.startswith("The topic is discussed") and "gradient descent" in got["topics", 9].answer
    assert got["topics", 10].answer == "The document has 10 pages."
    assert got["report", 1].intent == "caption" and got["report", 1].answer == "Grounded answer [Page 2]." and {s.page for s in got["report", 1].sources} == {2}
    assert "3 found" in got["book", 1].answer and "Chapter Two: The Middle [Pages 3–4]" in got["book", 1].answer


def test_replace_and_stale(engine, spark):
    stale = {r.doc: r.stale for r in engine.store.needs_reindex().collect()}
    assert stale == {"book": False, "topics": False, "report": False}
    engine.store.save_digests(spark.createDataFrame([("book", "k", "one")], "doc string, key string, text string"))
    engine.store.save_digests(spark.createDataFrame([("book", "k", "two"), ("book", "l", "x")], "doc string, key string, text string"))
    asked = spark.createDataFrame([("book", "k"), ("book", "m")], "doc string, key string")
    assert {(r.key, r.cached) for r in engine.store.digests(asked).collect()} == {("k", "two"), ("m", None)}
    doc = engine.store.create_thread("  A thread  " + "x" * 100)
    assert engine.store.threads().first().doc == doc and len(engine.store.threads().first().name) == 80
