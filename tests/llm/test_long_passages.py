"""Long passages lose text wherever they start."""

import random

from lectern.llm import sentence_spans


def test_passages_planted_mid_sentence_are_found(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows = []
    for k in range(40):
        passage = " ".join(word() for _ in range(51))
        for side, lead in enumerate((k % 20, (k * 7 + 3) % 23)):
            rows.append((2 * k + side, " ".join([*(word() for _ in range(lead)), passage, *(word() for _ in range(5))])))
    got = {r.doc_id for r in sentence_spans.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == set(range(1, 80, 2))


def test_repeats_of_one_word_sentences_are_found(spark):
    shout = " ".join(f"Word{k}!!" for k in range(60))
    rows = [(1, f"First lead. {shout}"), (2, f"Some other lead here. {shout}"), (3, "Yes! No! Well! Other words.")]
    got = {r.doc_id: r.removed for r in sentence_spans.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {2} and [x.end - x.start for x in got[2]] == [len(shout)]


def test_short_texts_and_rows_without_ids_lose_repeats(spark):
    two = "These two sentences are all there is here. And this is the second one of the two."
    rows = [(k, two) for k in range(1, 6)] + [(6, "Yes. No."), (7, "Yes. No.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in sentence_spans.repeated_spans(df).collect()) == [2, 3, 4, 5]
    shared = "One two three four. Five six seven eight. Nine ten eleven twelve."
    rows = [(None, f"Lead in. {shared}"), (None, f"Another start. {shared}"), (3, f"Again. {shared}"), (3, f"Same id, other text. {shared}")]
    got = sentence_spans.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(r.doc_id) for r in got) == ["3", "3", "None"]
    assert all(x.end - x.start == len(shared) for r in got for x in r.removed)
