"""Inputs on which the operators once did less than the whole job."""

import random

import pytest

pytest.importorskip("sparkscreen.llm.queries")
from sparkscreen.llm import html_text, lines, neardup, sketches  # noqa: E402
from sparkscreen.llm.common import reach_workers  # noqa: E402


def twins(spark, pairs, words, changed):
    """Texts 2i and 2i + 1 differ in their last ``changed`` words: equal shares of words - 4 - changed shingles."""
    reach_workers(spark)
    draw, rows = random.Random(1), []
    some = lambda k: [f"w{draw.randrange(10**9)}" for _ in range(k)]
    for i in range(pairs):
        base = some(words)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base[: words - changed] + some(changed)))]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_documents_below_the_similarity_stay(spark):
    df = twins(spark, 200, 174, 30)  # 140 of 200 shingles
    assert neardup.keep_one(df).count() == 400


@pytest.mark.parametrize("chunk", [1000, 10])
def test_crowded_keys_link_only_what_is_similar(spark, monkeypatch, chunk):
    monkeypatch.setattr(neardup, "CROWD", 1)
    monkeypatch.setattr(neardup, "CHUNK", chunk)
    reach_workers(spark)
    draw = random.Random(2)
    some = lambda k: [f"w{draw.randrange(10**9)}" for _ in range(k)]
    frame = some(144)  # 140 of 200 shingles shared by every two documents
    texts = [frame + some(30) for _ in range(30)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(100 + i, " ".join(t[:-2])) for i, t in enumerate(texts)]
    kept = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(30))


def test_pairs_at_the_limit_are_found(spark):
    df = twins(spark, 600, 184, 20)  # 160 of 200 shingles
    assert 1200 - neardup.keep_one(df).count() >= 0.93 * 600


def test_short_lines_that_repeat_go(spark):
    rows = [(1, "Les.\nErheed. Titionly.\n\nles.\n \nsome longer line of words"), (2, "Les.\nErheed. Titionly.\n\nles.\n \nsome longer line of words"), (3, "erheed.  titionly.\nless."), (4, "Les.\n"), (5, "")]
    got = {r["doc_id"]: (r["text"], r["lines_gone"]) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("Les.\nErheed. Titionly.\n\n \nsome longer line of words", 1), 2: ("\n ", 4), 3: ("less.", 1), 4: ("", 1), 5: ("", 0)}


def test_a_short_line_is_like_its_edited_version(spark):
    rows = [(1, " ".join(f"a{i:02}" for i in range(50))), (2, " ".join(f"b{i:02}" for i in range(50)))]
    got = sketches.compare_versions(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r["near_edited"] for r in got] == [pytest.approx(1 / 3)] * 2  # one piece of three is kept


@pytest.mark.parametrize("head", ["<head><meta charset=utf-8><title>T</title><link rel=x><body>", "<head><title>T</title>\n<style>p {}</style>", "<head><title>T</title></head><body>", "<head><head><title>T</title><body>"])
def test_head_without_its_end_tag(head):
    found = html_text.blocks(f"<!doctype html><html>{head}<article><h1>A</h1><p>Words of it.</p></article>")
    assert [b.text for b in found] == ["A", "Words of it."]
    assert html_text.blocks("<head><title>T</title>Bare words<p>and more")[0].text == "Bare words"


@pytest.mark.parametrize("changes", [{"STAR_ROUNDS": 12, "STAR_YIELD": 1000}, {"STAR_ROUNDS": 1}, {"STAR_ROUNDS": 1, "CHUNK": 7}])
def test_groups_do_not_depend_on_leaders_or_blocks(spark, monkeypatch, changes):
    """Chains through a crowd: each text is near the next two only, so most links do not lead to a leader."""
    reach_workers(spark)
    for name, value in ({"CROWD": 2} | changes).items():
        monkeypatch.setattr(neardup, name, value)
    draw = random.Random(3)
    some = lambda k: [f"w{draw.randrange(10**9)}" for _ in range(k)]
    rows = []
    for chain in range(4):
        words = some(300)
        for i in range(30):
            rows.append((100 * chain + i, " ".join(words[5 * i : 5 * i + 150])))  # equal shares with the next: 141 of 151
    rows.append((1000, " ".join(some(150))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in neardup.keep_one(df).collect()) == [0, 100, 200, 300, 1000]
