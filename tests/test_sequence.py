import difflib
import random

import pytest
from postledger.operators import sequence, watch


def plain(old, new):
    """Lines of the new text outside the library's matching blocks."""
    a, b = (old or "").splitlines(), (new or "").splitlines()
    blocks = difflib.SequenceMatcher(None, a, b).get_matching_blocks()
    kept = {j for block in blocks for j in range(block.b, block.b + block.size)}
    return blocks, "\n".join(x for j, x in enumerate(b) if j not in kept).strip()


def texts(rng, n, vocabulary):
    line = lambda: f"line {rng.randrange(vocabulary)}"
    old = [line() for _ in range(n)]
    new = list(old)
    for _ in range(rng.randint(0, 6)):
        at = rng.randrange(len(new) + 1)
        kind = rng.choice(["insert", "delete", "move", "replace"])
        if kind == "insert":
            new[at:at] = [line() for _ in range(rng.randint(1, 4))]
        elif kind == "delete":
            del new[at:at + rng.randint(1, 4)]
        elif kind == "move":
            part = new[at:at + 3]
            del new[at:at + 3]
            k = rng.randrange(len(new) + 1)
            new[k:k] = part
        elif new:
            new[min(at, len(new) - 1)] = line()
    return "\n".join(old), "\n".join(new)


@pytest.mark.parametrize("n, vocabulary, pages", [(12, 6, 80), (60, 400, 30), (260, 30, 6), (400, 3000, 4)])
def test_blocks_equal_those_of_the_standard_library(spark, n, vocabulary, pages):
    rng = random.Random(n)
    rows = [(f"p{k}", *texts(rng, n, vocabulary)) for k in range(pages)]
    pairs = spark.createDataFrame(rows, "id string, previous_text string, content_text string").repartition(4)
    got = {}
    for r in sequence.matching_blocks(pairs).collect():
        got.setdefault(r["id"], []).append((r["a"], r["b"], r["size"]))
    added = {r["id"]: r["added_text"] for r in sequence.added_lines_in_order(pairs).collect()}
    for name, old, new in rows:
        blocks, text = plain(old, new)
        covered = lambda bs: {(a + k, b + k) for a, b, size in bs for k in range(size)}
        assert covered(got.get(name, [])) == covered(blocks), name
        assert added.get(name, "") == text


def test_moved_lines_are_added_in_order_only(spark):
    rows = [("m", "one\ntwo\nthree\nfour", "four\none\ntwo\nthree"), ("same", "a\nb", "a\nb\n"), ("new", None, "x\r\ny"), ("gone", "x", None), ("", "", "")]
    pairs = spark.createDataFrame(rows, "id string, previous_text string, content_text string")
    got = {r["id"]: r["added_text"] for r in sequence.added_lines_in_order(pairs).collect()}
    assert got == {"m": "four", "new": "x\ny"}
    assert [r["id"] for r in watch.added_lines(pairs).filter("added_text <> ''").collect()] == ["new"]
    assert sequence.added_lines_in_order(pairs.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    pairs = spark.createDataFrame([("m", "one\ntwo", "two\none")], "id string, previous_text string, content_text string")
    plan = sequence.added_lines_in_order(pairs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
