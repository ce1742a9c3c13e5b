from ticketloom.llm import decontaminate as dc

ITEMS = [(1, "A train leaves Paris at 10 km per hour and then Bob walks 10 miles to London with 3 apples in a bag."),
         (2, "One two three."), (3, "What is the capital of France?"), (4, None), (5, ""),
         (6, "plain words without any slot at all stand here in a row and go on for a good while"),
         (7, "plain words without any slot at all stand here in a row and go on for a good while")]
DOCS = [(1, "xx yy. A train leaves Rome at 25 km per hour and then Ann walks 25 miles to Berlin with 7 apples in a bag. zz"),
        (2, "A train leaves Rome at 25 km per hour and then Ann walks 99 miles to Berlin with 7 apples in a bag."),
        (3, "a clean text about nothing much that is long enough to have windows in it"), (4, None), (5, "one two three"),
        (6, "so, what is the capital of France? Paris"), (7, ""), (8, "10 20 30 40 50 60 70 80 90 100 110 120"),
        (9, "Before. PLAIN? no: plain words without any slot at all stand here in a row and go on for a good while, after."),
        (10, "word " * 30_000 + ITEMS[0][1])]


def leaks(spark, docs=DOCS, items=ITEMS):
    return dc.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))


def test_leaks(spark):
    got = {(r.doc_id, r.item_id): r for r in leaks(spark).collect()}
    assert set(got) == {(1, 1), (5, 2), (6, 3), (9, 6), (10, 1)}
    assert got[1, 1].leak == "reparameterised" and got[1, 1].changed_slots == 5 and got[1, 1].covered_words == 23
    assert got[9, 6].n_items == 2 and got[10, 1].leak == "exact" and got[6, 3].leak == "exact"


def test_the_joins_agree(spark, monkeypatch):
    """The same rows whether the benchmark is broadcast or shuffled."""
    import ticketloom.llm.decontaminate as module

    one = sorted(map(str, leaks(spark).collect()))
    monkeypatch.setattr(module, "small_side", lambda df: df)
    assert sorted(map(str, leaks(spark).collect())) == one


def test_one_conflict_does_not_hide_a_copy(spark):
    filler = "the quick team went along the old road and saw many green hills before they came back at last"
    other = "our neighbours slept in a small tent near the lake because it rained so hard all through that night"
    items = [(1, f"They paid 3 coins and later {filler} with 3 coins left in the box"),
             (2, f"They lost 3 games and won 5 games while {other} and again"),
             (3, " ".join(f"then Bob took one more step number{c} down to the river" for c in "abcdefghi"))]
    docs = [(1, items[0][1].replace("3 coins left", "4 coins left")), (2, items[1][1].replace("3", "4").replace("5", "4")),
            (3, items[2][1].replace("Bob", "Ann").replace("Ann took one more step numbere", "Rob took one more step numbere"))]
    got = {(r.doc_id, r.item_id): r for r in leaks(spark, docs, items).collect()}
    assert set(got) == {(1, 1), (2, 2), (3, 3)}
    assert got[3, 3].leak == "reparameterised" and got[3, 3].n_slots == 1


def test_names_numbers_and_capitals(spark):
    items = [(1, "seen: Anna Berg, Carl Dahl, Eva Falk, Gus Holm, Ida Jung, Karl Lund, Mia Nord, Otto Palm"),
             (2, "12 14 16 18 20 22 24 26 28 30"), (3, "13 15 17 19 21 23 25 27 29 31"),
             (4, "what is the name of the small river that runs through the old town"), (5, "Anna Berg met Carl Dahl")]
    docs = [(1, f"xx. {items[0][1]}. yy"), (2, f"a {items[1][1]} b"), (3, f"a {items[2][1]} b"), (4, items[3][1].upper()),
            (5, items[3][1].title()), (6, "then anna berg met carl dahl"), (7, "12 15 16 19 20 23 24 27 28 31"),
            (8, "seen: Ole Berg, Ulf Dahl, Per Falk, Jan Holm, Liv Jung, Tom Lund, Kim Nord, Leo Palm")]
    got = {(r.doc_id, r.item_id): r for r in leaks(spark, docs, items).collect()}
    assert set(got) == {(1, 1), (2, 2), (3, 2), (4, 4), (5, 4), (6, 5)}
    assert all(r.leak == "exact" for r in got.values()) and got[2, 2].n_items == 2 and got[1, 1].covered_words == 17


def test_columns_and_empty(spark, odd, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.decontaminated(odd, items).columns == odd.columns
    assert dc.decontaminated(odd, none).count() == odd.count()
    assert dc.leaks(empty, items).count() == 0
    kept = dc.decontaminated(spark.createDataFrame(DOCS, "doc_id long, text string"), items)
    assert {r.doc_id for r in kept.collect()} == {2, 3, 4, 7, 8}
