import random

from sessionloom.llm import decontamination
from sessionloom.llm.decontamination import contained_items, document_signatures, drop_contaminated, item_signatures

DOCS = "doc_id bigint, text string, node string, item_id string"
ITEMS = "item_id bigint, text string, doc_id string"


def runs(text):
    tokens = (text or "").split()
    if len(tokens) < 5:
        return {" ".join(tokens)} if tokens else set()
    return {" ".join(tokens[at : at + 5]) for at in range(len(tokens) - 4)}


def corpus():
    draw = random.Random(4)
    prose = lambda count: [f"v{draw.randrange(3000)}" for _ in range(count)]
    items = [prose(draw.randrange(5, 60)) for _ in range(25)] + [["two", "words"]]
    docs = [prose(draw.randrange(1, 400)) for _ in range(60)]
    for at, item in enumerate(items):
        for share in (1.0, 0.85, 0.5):
            part = item[: max(1, round(share * len(item)))]
            docs.append(prose(draw.choice([0, 3, 3000])) + part + prose(draw.choice([0, 50])))
    docs += [items[0] * 3, items[1], items[1]]
    return [" ".join(doc) for doc in docs], [" ".join(item) for item in items]


def test_containment_equals_brute_force(spark, monkeypatch):
    docs, items = corpus()
    docs, items = [*docs, None, "", " \n"], [*items, None, "", items[3]]
    frame = spark.createDataFrame([(at, text, "n", "i") for at, text in enumerate(docs)], DOCS).repartition(3)
    benchmark = spark.createDataFrame([(at, text, "d") for at, text in enumerate(items)], ITEMS)
    want = set()
    for at, text in enumerate(docs):
        for number, item in enumerate(items):
            need, shared = runs(item), runs(item) & runs(text)
            if need and len(shared) * 100 >= len(need) * 80:
                want.add((at, number, len(need), len(shared)))
    read = lambda: {
        (row.id, row.item_id, row.item_runs, row.shared_runs) for row in contained_items(frame, benchmark).collect()
    }
    assert read() == want and len(want) > 40
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    assert read() == want
    clean = drop_contaminated(frame, benchmark)
    assert clean.columns == frame.columns
    assert {row.doc_id for row in clean.collect()} == set(range(len(docs))) - {row[0] for row in want}


def test_signatures_keep_most_runs(spark):
    texts = spark.createDataFrame([(1, " ".join(f"w{at}" for at in range(2000)))], "node bigint, text string")
    kept = document_signatures(texts).count()
    assert 0.85 * 1996 < kept <= 1996
    assert item_signatures(texts).count() == 1996


def test_empty_tables(spark):
    frame = spark.createDataFrame([(1, "a b c d e f", "", "")], DOCS)
    items = spark.createDataFrame([(1, "a b c d e f", "")], ITEMS)
    assert contained_items(frame.where("false"), items).count() == 0
    assert contained_items(frame, items.where("false")).count() == 0
    assert contained_items(frame, items).count() == 1


def test_short_items_in_long_documents(spark, monkeypatch):
    """Items of 1 to 15 words, each inside long documents of its own, over many draws."""
    docs, items, want = [], [], set()
    for seed in range(40):
        draw = random.Random(seed)
        for length in (*range(1, 9), 15):
            item = [f"i{seed}x{length}x{at}" for at in range(length)]
            for _ in range(3):
                prose = [f"v{draw.randrange(3000)}" for _ in range(draw.randrange(300, 600))]
                at = draw.randrange(len(prose))
                want.add((len(docs), len(items), max(1, length - 4), max(1, length - 4)))
                docs.append(" ".join(prose[:at] + item + prose[at:]))
            # The same words apart or in another order are not the item.
            if length > 1:
                docs.append(" ".join(prose + item[1:] + prose + item[:1]))
            items.append(" ".join(item))
    frame = spark.createDataFrame([(at, text, "n", "i") for at, text in enumerate(docs)], DOCS).repartition(4)
    benchmark = spark.createDataFrame([(at, text, "d") for at, text in enumerate(items)], ITEMS)
    exact = lambda row: row.shared_runs == row.item_runs
    read = lambda: {
        (row.id, row.item_id, row.item_runs, row.shared_runs)
        for row in filter(exact, contained_items(frame, benchmark, short_inside=True).collect())
    }
    assert read() == want
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    assert read() == want
    left = {row.doc_id for row in drop_contaminated(frame, benchmark, short_inside=True).collect()}
    assert not left & {row[0] for row in want}


def test_few_runs_need_no_signature(spark):
    """Items of five and six words are found by default too, in every document."""
    draw = random.Random(7)
    items = [" ".join(f"i{at}x{step}" for step in range(5 + at % 2)) for at in range(200)]
    docs = [" ".join([f"v{draw.randrange(3000)}" for _ in range(300)] + [item]) for item in items]
    frame = spark.createDataFrame([(at, text, "n", "i") for at, text in enumerate(docs)], DOCS)
    benchmark = spark.createDataFrame([(at, text, "d") for at, text in enumerate(items)], ITEMS)
    got = {(row.id, row.item_id) for row in contained_items(frame, benchmark).collect()}
    assert got == {(at, at) for at in range(200)}


def test_registered_query_finds_short_items(spark, tmp_path):
    prose = " ".join(f"v{at}" for at in range(300))
    rows = [(1, f"{prose} two words {prose}", "", ""), (2, f"{prose} two other words", "", "")]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, "two words", "")], ITEMS).write.parquet(str(tmp_path / "benchmark.parquet"))
    got = decontamination.op7_containment(spark, str(tmp_path)).collect()
    assert [tuple(row) for row in got] == [(1, 7, 1, 1)]


def test_items_below_the_least_words_drop_nothing(spark):
    docs = ["plain words here", "the answer is here", "it is so", "so it is"]
    frame = spark.createDataFrame([(at, text, "n", "i") for at, text in enumerate(docs)], DOCS)
    benchmark = spark.createDataFrame([(1, "is", "d"), (2, "answer is here", "d"), (3, None, "d")], ITEMS)
    kept = lambda least: {row.doc_id for row in drop_contaminated(frame, benchmark, short_inside=True, least_words=least).collect()}
    assert (kept(1), kept(2), kept(4)) == ({0}, {0, 2, 3}, {0, 1, 2, 3})


def test_repeated_items_are_reported_under_each_id(spark):
    item = "a b c d e f g h"
    frame = spark.createDataFrame([(1, f"x y {item} z", "n", "i")], DOCS)
    benchmark = spark.createDataFrame([(at % 7, item, "d") for at in range(300)], ITEMS)
    got = [row.item_id for row in contained_items(frame, benchmark).collect()]
    assert len(got) == 300 and set(got) == set(range(7))
