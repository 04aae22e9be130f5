"""Many terms at once, against plain searches."""

import random
import time

import pytest

from spanguard.functions.terms import Automaton
from spanguard.operators import terms


def leftmost_longest(text, words):
    ranked, out, i = sorted(filter(None, words), key=len, reverse=True), [], 0
    while i < len(text):
        hit = next((w for w in ranked if text.startswith(w, i)), None)
        if hit:
            out.append((i, i + len(hit)))
        i += len(hit) if hit else 1
    return out


def longest_first(text, words):
    out = []
    for w in sorted(set(filter(None, words)), key=lambda w: (-len(w), w)):
        at = text.find(w)
        while at >= 0:
            if all(at + len(w) <= s or e <= at for s, e in out):
                out.append((at, at + len(w)))
            at = text.find(w, at + len(w))
    return sorted(out)


@pytest.mark.parametrize("letters", ["ab", "abc", "aé😀"])
def test_automaton_equals_plain_searches(letters):
    rnd = random.Random(letters)
    draw = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    for _ in range(400):
        words = [draw(rnd.randint(0, 5)) for _ in range(rnd.randint(0, 7))]
        text = draw(rnd.randint(0, 40))
        a = Automaton(words)
        assert a.matches(text) == leftmost_longest(text, words)
        assert {a.terms[k] for k in a.contained(text)} == {w for w in words if w and w in text}
        assert a.resolve(text) == longest_first(text, words)
        values = {w: f"<{w}>" for w in words}
        found = leftmost_longest(text, words)
        want, at = "", 0
        for s, e in found:
            want, at = want + text[at:s] + values[text[s:e]], e
        assert a.replace(text, values) == (want + text[at:], bool(found))


@pytest.mark.parametrize("kind", ["many", "overlapping"])
def test_automaton_takes_linear_time(kind):
    rnd = random.Random(2)
    if kind == "many":
        words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(6, 24))) for _ in range(10_000)]
        text = "".join(rnd.choice([*words, " and ", "."]) for _ in range(70_000))[:1_000_000]
    else:  # a word of which all but the last letter is found at each place
        words, text = ["a" * 2000 + "b", "a"], "a" * 1_000_000
    took = []
    for part in (text[: len(text) // 4], text):
        a, began = Automaton(words), time.process_time()
        assert a.matches(part) and a.contained(part)
        took.append(time.process_time() - began)
    assert took[1] < 6 and took[1] < 8 * took[0] + 0.5


def test_terms_of_conversations(spark, monkeypatch):
    monkeypatch.setattr(terms, "SMALL_BYTES", -1)
    monkeypatch.setattr(terms, "TEXTS", 3)  # conversation 1 is dealt over several tasks
    vault = [(1, "ann@x", "zoe@y"), (1, "ann", "zoe"), (1, "bob", "zoe"), (2, "ann", "eve"), (1, "", "q"), (1, None, "q"), (None, "ann", "nil")]
    said = [(1, i, f"ann@x ann bob {i}", "k") for i in range(20)] + [(2, 1, "ann bob", "k"), (3, 1, "ann", "k"), (None, 1, "ann", None), (2, 2, None, "k"), (2, 1, "ann bob", "k")]
    rows = spark.createDataFrame(vault, "conv_id long, original string, synthetic string")
    texts = spark.createDataFrame(said, "conv_id long, turn int, text string, kind string")
    keep = ["conv_id", "turn", "kind"]
    got = sorted(map(tuple, terms.replace_originals(texts, rows, keep).collect()), key=str)
    want = [(1, i, "k", f"zoe@y zoe zoe {i}", True) for i in range(20)] + [(2, 1, "k", "eve bob", True)] * 2 + [(3, 1, "k", "ann", False), (None, 1, None, "nil", True), (2, 2, "k", "", False)]
    assert got == sorted(want, key=str)
    back = spark.createDataFrame([(1, 1, "zoe@y, zoe", "k"), (1, 2, "zo", "k")], texts.schema)
    assert sorted(map(tuple, terms.replace_synthetics(back, rows, ["turn"]).collect())) == [(1, "ann@x, ann", True), (2, "zo", False)]
    found = {(r.conv_id, r.turn): r.terms for r in terms.occurring(texts, rows, keep).collect()}
    assert found[1, 5] == ["ann", "ann@x", "bob"] and found[2, 1] == ["ann"] and found[3, 1] == [] and found[2, 2] == []
    placed = {(r.conv_id, r.turn): (r.hits, r.starts) for r in terms.resolved(texts, rows, keep).collect()}
    assert placed[1, 5] == (["ann@x", "ann", "bob"], [0, 6, 10])
    assert terms.occurring(texts.where("1 = 0"), rows, keep).count() == 0
    assert terms.occurring(texts, rows.where("1 = 0"), keep).where("size(terms) > 0").count() == 0
