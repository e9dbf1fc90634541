"""Re-parameterised benchmark items: names of other lengths, first words, one-word items, odd tables, and a plain version on whole small items."""

import random

from lodestack.llm.decontam import leaks

ITEM = "A train leaves Madrid at 9 am with 120 people and then Maria counts 35 bags while her brother Paul reads the paper in the last car of the train"


def found(spark, texts, items):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, item_id string, share int")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): (r.n_slots, r.changed_slots) for r in leaks(d, b).collect()}


def test_names_of_other_lengths(spark):
    texts = [
        ITEM.replace("Maria", "Ann Lee"), ITEM.replace("Maria", "Olga"), ITEM.replace("Madrid", "New York City").replace("120", "7").replace("35 bags", "1,250 bags"), ITEM.lower(), ITEM.upper(),
        "It is said: " + ITEM.replace("Paul", "Jean Paul Marie") + " and so on", ITEM.replace("Madrid", "Maria"), "a clean text about a train that leaves a town with some people in it",
    ]
    got = found(spark, texts, [ITEM])
    assert sorted(k for k, _ in got) == [0, 1, 2, 3, 4, 5, 6]
    assert got[0, 0][1] == 1 and got[2, 0][1] >= 3 and got[5, 0][1] == 1


def test_slots_that_disagree(spark):
    item = "Peter gives Anna 3 pears and then Anna gives Carl 3 plums before Anna goes home to eat with Carl and Lena"
    ok = item.replace("Anna", "Mary Ann").replace("Carl", "Tom")
    bad = item.replace("then Anna", "then Olga").replace("before Anna", "before Nina")
    assert set(found(spark, [ok, bad], [item])) == {(0, 0)}


def test_one_word_items(spark):
    got = found(spark, ["the Mitochondria is here", "mitochondria", "a Nucleus is here", "it is 42 or 43", "MITOCHONDRIA.", "none"], ["Mitochondria", "42"])
    assert set(got) == {(0, 0), (1, 0), (4, 0), (3, 1)}


def test_odd_tables(spark):
    assert found(spark, ["a text", None, ""], []) == {}
    assert found(spark, [], [ITEM]) == {}
    assert found(spark, [None, "", "..."], ["", None, "!?", ITEM]) == {}
    long = "some other words stand here and there " * 20_000
    assert set(found(spark, [long + ITEM + " " + long, long], [ITEM, ITEM])) == {(0, 0), (0, 1)}


def test_whole_short_items_equal_a_plain_search(spark):
    rng = random.Random(4)
    words = "red green blue old new tall small round flat warm".split()
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [some(n) for n in (1, 2, 3, 5, 9, 14) for _ in range(2)]
    texts = [some(rng.randint(1, 30)) for _ in range(80)] + [f"{some(5)} {x} {some(5)}" for x in items]
    got = found(spark, texts, items)
    assert all((i, k) in got for i, t in enumerate(texts) for k, x in enumerate(items) if f" {x} " in f" {t} ")
    for i, k in got:  # nothing is reported with less than four fifths of the item's words
        have = texts[i].split()
        assert sum(w in have for w in items[k].split()) >= 0.8 * len(items[k].split())


def test_a_text_is_made_a_template_once(spark):
    """op2: conditions that asked for a half-made template had it made again, nine times in the plan; its two cases are left."""
    from pyspark.sql import functions as F

    from lodestack.llm.decontam import _template

    plan = spark.createDataFrame([("a 5 km",)], "text string").select(_template(F.col("text"))[1].alias("words"))._jdf.queryExecution().analyzed().toString()
    assert plan.count(r"[\s\p{Z}]+") == 2
