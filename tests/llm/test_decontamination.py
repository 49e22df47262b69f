import random

import pytest

from lodestar.llm.decontamination import NUMBER, QUANTITY, UNIT, Benchmark, Templates, classify, decontamination

FILL = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore " * 3
ITEMS = [
    (1, "A train leaves the station at noon with Anna and travels 60 miles in 2 hours before it stops near the old bridge for 60 seconds."),
    (2, "which gas do plants take from the air when the sun shines on them"),
    (3, None), (4, ""), (5, "tiny one"), (6, "12 34 56 78 90"),
]


def changed(**by):
    text = ITEMS[0][1]
    for old, new in by.items():
        text = text.replace(old.strip("_"), new)
    return text


DOCS = [
    (1, FILL + ITEMS[0][1] + " " + FILL, [1], []),
    (2, FILL + changed(_60="75", _2="3", Anna="Robert") + " " + FILL, [1], [1]),
    (3, FILL + ITEMS[0][1].replace("60 miles", "75 miles").replace("60 seconds", "91 seconds").replace(" 2 ", " 75 ") + " " + FILL, [], []),
    (4, FILL, [], []),
    (5, FILL + ITEMS[1][1].upper() + " " + FILL, [2], []),
    (6, FILL + " ".join(ITEMS[1][1].split()[:8]) + " " + FILL, [], []),
    (7, None, [], []),
    (8, "", [], []),
    (9, ITEMS[1][1] + "\n" + FILL * 50 + ITEMS[0][1], [1, 2], []),
    (None, "x tiny one y", [5], []),
    (10, "12 34 56 78 90", [6], []),
    (11, "11 22 33 44 55", [], []),
    (11, " ".join(f"{w} {FILL}" for w in ITEMS[1][1].split()), [], []),
]


@pytest.mark.parametrize("block", [1, 1000])
def test_finds_items(spark, block):
    docs = spark.createDataFrame([(i, t, "x") for i, t, *_ in DOCS], "doc_id long, text string, items string")
    bench = spark.createDataFrame([(i, t, 0) for i, t in ITEMS], "item_id long, text string, doc_id int")
    got = sorted(((r.doc_id, r.items, r.reparameterised, r.contaminated) for r in decontamination(docs, bench, block_windows=block).collect()), key=str)
    assert got == sorted(((i, a, b, bool(a)) for i, _, a, b in DOCS), key=str)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in decontamination(docs, bench).collect()] == [(1, [], [], False)]
    assert decontamination(docs.limit(0), bench).collect() == []


def test_kinds():
    assert [classify(w)[0] for w in ("7,", "1,000", "3rd", "5kg", "20%", "miles.", "seven")] == [NUMBER, NUMBER, NUMBER, QUANTITY, QUANTITY, UNIT, NUMBER]
    assert classify("(House).")[1:] == ("house", True, True)


def test_every_stretch_and_first_word(spark):
    variant = ITEMS[0][1].replace("60 miles", "75 miles").replace("60 seconds", "91 seconds").replace(" 2 ", " 75 ")
    items = [*ITEMS, (7, "Which gas do most green plants take from the air at noon"), (8, "Tiny two")]
    rows = [
        (1, "11 22 33 44 55 12 34 56 78 90", [6], []),
        (2, "11 22 33 44 55 " + FILL * 9 + "12 34 56 78 90", [6], []),
        (3, variant + " " + ITEMS[0][1], [1], []),
        (4, " ".join([variant] * 5) + FILL + ITEMS[0][1] + " " + variant, [1], []),
        (5, " ".join([variant] * 3), [], []),
        (6, "and then\nTiny two words", [8], []),
        (7, "and then\nBob two words", [], []),
        (8, "Exam questions\n- Which gas do most green", [], []),
        (9, "11 22 33 44 55 12 34 56 78 91", [], []),
        (10, "Exam questions - Which gas do most green plants take from the air at", [7], []),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.items, r.reparameterised) for r in decontamination(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), bench).collect()}
    assert got == {i: (a, b) for i, _, a, b in rows}


def test_rows_of_numbers(spark):
    """Placeholder-only windows: items are told by their words and the alignment, never by numbers alone."""
    rng = random.Random(1)
    numbers = lambda n: " ".join(str(rng.randrange(10, 99)) for _ in range(n))
    table = numbers(30)
    items = [(1, "The sum of these values is " + table), (2, numbers(12)), (3, "find the mean of the list " + numbers(8) + " and round it down")]
    rows = [
        (1, FILL + items[0][1], [1], []),
        (2, FILL + "the sum of these values is " + numbers(30), [1], [1]),
        (3, FILL + "the sum of these values is 12 and nothing else is said here", [], []),
        (4, numbers(3000), [], []),
        (5, numbers(40) + " " + items[1][1] + " " + numbers(5), [2], []),
        (6, "Q: find the mean of the list " + numbers(8) + " and round it down", [3], [3]),
        (7, table, [], []),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.items, r.reparameterised) for r in decontamination(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), bench).collect()}
    assert got == {i: (a, b) for i, _, a, b in rows}
    probe, many = Benchmark([(k, f"word{k} more words{k} " + numbers(12)) for k in range(300)]), numbers(20_000)
    assert probe.found(many, Templates()) == []  # no hit for each item and place


def test_random_changes_against_the_stated_rule():
    """Items with all numbers changed one for one are found, with values that contradict each other not."""
    rng = random.Random(5)
    words = [a + b for a in "ba co du fe gi ho ju ka le mo".split() for b in "nd rst lm x p".split()]
    for _ in range(60):
        text = []
        for _ in range(rng.randrange(3, 9)):
            text += [*rng.choices(words, k=rng.randrange(2, 6)), str(rng.randrange(100, 200))]
        item = " ".join(text)
        of = {v: str(int(v) + 300) for v in text if v.isdigit()}
        fill = [rng.choice(words) for _ in range(40)]
        probe = Benchmark([(1, item)])
        for changed, want in ((text, [(1, False)]), ([of.get(w, w) for w in text], [(1, True)])):
            assert probe.found(" ".join([*fill, *changed, *fill]), Templates()) == want
        first, *others = [i for i, w in enumerate(text) if w.isdigit()]
        if len(of) == len(others) + 1 >= 3:  # one value for all of them
            assert probe.found(" ".join([*fill, *("555" if w.isdigit() else w for w in text), *fill]), Templates()) == []
