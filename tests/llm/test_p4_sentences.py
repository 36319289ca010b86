from __future__ import annotations

import random

import pytest

from prufspark.llm import sentences
from prufspark.llm.sentences import BoundaryModel


@pytest.mark.parametrize(
    "text, want",
    [
        ("Der Bus hielt. Die Frau fiel.", ["Der Bus hielt. ", "Die Frau fiel."]), ("Titel\n\nDer Bus hielt.", ["Titel\n\n", "Der Bus hielt."]), ("Am 7. Dezember kam er.", None), ("Er fuhr mit 3.5 m/s.", None),
        ("Er sagte: «Es ging schnell. Ich fiel.», was stimmt.", None), ('He said, "It was fast. I fell," which is true.', None), ("见取图。损坏清单。", ["见取图。", "损坏清单。"]), ("Frau lic. iur. Muster kam.", None), ("", []), (None, []), ("  \n ", []), ("fragment", None),
        ("Είναι αλήθεια ότι έπεσε; Το ταξί ήρθε.", ["Είναι αλήθεια ότι έπεσε; ", "Το ταξί ήρθε."]),
    ],
)
def test_prior_model(text, want):
    m = BoundaryModel()
    at = m.starts(text) if text else []
    got = [text[a:b] for a, b in zip(at, at[1:] + [len(text)])] if text else []
    assert got == ([text] if want is None else want)


def test_viterbi_equals_the_best_of_all_taggings():
    import itertools

    m = BoundaryModel({"a": 1.0, "b": -0.5, "c": 2.0}, follow=-1.7)
    rng = random.Random(1)
    for _ in range(60):
        at, places = 0, []
        for _ in range(rng.randint(1, 7)):
            at += rng.randint(1, 6)
            places.append((at, (rng.choice("abc"),)))
        best = max(itertools.product([False, True], repeat=len(places)), key=lambda t: value(m, places, t))
        assert value(m, places, m.tags(places)) == pytest.approx(value(m, places, best))


def value(m, places, tags):
    s = sum(m.score(f) for (_, f), t in zip(places, tags) if t)
    return s + sum(m.follow for i in range(1, len(places)) if tags[i] and tags[i - 1] and places[i][0] - places[i - 1][0] < 4)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    try:
        rows = spark.read.parquet(f"{folder}/chunks.parquet").where("metadata.content_type = 'list_block'").select("text").distinct().collect()
    except Exception:
        pytest.skip("no test tables here")
    blocks = sorted(r["text"] for r in rows)
    m = sentences.fit(blocks[::2])
    hit = miss = extra = 0
    for b in blocks[1::2]:
        items = [x for x in (sentences.MARKER.sub("", s).strip() for s in b.split("\n")) if x]
        text, truth = "", set()
        for x in items:
            text += " " * bool(text)
            truth.add(len(text))
            text += x
        got = set(m.starts(text))
        hit, miss, extra = hit + len(got & truth), miss + len(truth - got), extra + len(got - truth)
    assert hit / (hit + miss) > 0.95 and hit / (hit + extra) > 0.95


def test_rows_and_repeats(spark):
    df = spark.createDataFrame([("t", "1", " Eins ist. Zwei ist."), ("t", "2", None), ("t", "3", " ")], "tbl string, record_key string, value string")
    assert sorted((r["record_key"], r["start_pos"]) for r in sentences.sentence_starts(df, BoundaryModel()).collect()) == [("1", 2), ("1", 12)]
