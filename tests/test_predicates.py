"""Compiled conditions against plain Python on random rows, half of them null, and the two-valued rule."""

import random

import pytest

from policyframe.functions.evaluate import holds
from policyframe.operators.filters import test as column_of
from policyframe.plans.predicate import ALL, NONE, And, Const, Field, Not, Or, implies, normalize

f = Field
TEXTS = [None, "", "a", "A", "ab", "aB%", "_\\", "É", "é", "Straße", "b"]
LEAVES = [
    *[getattr(f("x"), op)(v) for op in ("eq", "ne", "lt", "lte", "gt", "gte") for v in (-1, 0, 3)],
    *[getattr(f("x"), op)(v) for op in ("in_", "not_in") for v in ([], [1, 3], [0])],
    *[getattr(f("s"), op)(v) for op in ("eq", "ne", "lt", "gt", "contains", "starts_with", "ends_with") for v in ("", "a", "B", "É", "%", "_", "\\")],
    *[getattr(f("s").ci(), op)(v) for op in ("eq", "ne", "contains", "starts_with", "ends_with", "lt") for v in ("A", "b", "É")],
    *[g.is_null() for g in (f("x"), f("s"), f("l"))],
    *[g.is_not_null() for g in (f("x"), f("s"), f("l"))],
    *[getattr(f("l"), op)(v) for op in ("has_every", "has_some") for v in ([], [1], [1, 2])],
    f("l").has(1),
    f("l").list_eq([1, 2]),
    f("l").list_eq([]),
    f("l").is_empty(True),
    f("l").is_empty(False),
]


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(3)
    data = [(i, rnd.choice([None, None, -1, 0, 1, 3]), rnd.choice(TEXTS), rnd.choice([None, [], [1], [1, 2], [2, None], [None]])) for i in range(150)]
    return data, spark.createDataFrame(data, "i int, x int, s string, l array<int>")


def ids(data, condition):
    return [i for i, x, s, l in data if holds(condition, {"x": x, "s": s, "l": l})]


def test_leaves_and_their_negations(rows):
    data, df = rows
    made = df.select("i", *[column_of(c).alias(f"c{k}") for k, c in enumerate(LEAVES)]).orderBy("i").collect()
    for k, c in enumerate(LEAVES):
        assert all(r[f"c{k}"] is not None for r in made), c
        assert [r["i"] for r in made if r[f"c{k}"]] == ids(data, c), c
        assert [r["i"] for r in made if not r[f"c{k}"]] == ids(data, Not(c)), c


def test_random_trees(rows):
    from policyframe.operators.filters import _column

    data, df = rows
    rnd = random.Random(5)

    def tree(depth):
        if depth == 0 or rnd.random() < 0.3:
            return rnd.choice(LEAVES)
        kind = rnd.choice([And, Or, Not])
        return Not(tree(depth - 1)) if kind is Not else kind(tuple(tree(depth - 1) for _ in range(rnd.randint(0, 3))))

    trees = [tree(3) for _ in range(40)]
    made = df.select("i", *[_column(normalize(c)).alias(f"c{k}") for k, c in enumerate(trees)]).orderBy("i").collect()
    for k, c in enumerate(trees):
        assert [r["i"] for r in made if r[f"c{k}"]] == ids(data, c), c


def test_json(spark):
    data = [(0, None), (1, "{}"), (2, '{"k": null}'), (3, '{"k": 1}'), (4, '{"k": 1.0}'), (5, '{"k": "Ab"}'), (6, '{"k": [1, {"a": 2}]}'), (7, '{"k": []}'), (8, "no json"), (9, '{"k": true}')]
    df = spark.createDataFrame(data, "i int, j string")
    found = lambda c: [r["i"] for r in df.filter(column_of(c)).orderBy("i").collect()]
    k = f("j").at("k")
    assert found(k.json_eq(1)) == [3, 4]
    assert found(k.json_ne(2)) == [3, 4]
    assert found(k.json_gt(0)) == [3, 4]
    assert found(k.json_eq(True)) == [9]
    assert found(k.json_eq("Ab")) == [5]
    assert found(k.ci().string_contains("B")) == [5]
    assert found(k.array_contains(1)) == [6]
    assert found(k.array_ends_with({"a": 2})) == [6]
    assert found(f("j").json_is_null()) == [0]


def test_implications():
    a, b, c = f("x").gt(1), f("s").eq("q"), f("x").is_null()
    assert implies(a & b, a) and implies(a, a | b) and implies(a & b, b | c) and implies(a, ALL)
    assert not implies(a | b, a) and not implies(NONE, a) and not implies(a & ~a, b)
    assert normalize(And((ALL, Or((NONE, a)), Not(Not(a))))) == a
    assert normalize(And(())) == Const(True) and normalize(Or(())) == Const(False)


def test_operands():
    for bad in (lambda: f("x").eq(None), lambda: f("x").in_([1, None])):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(AttributeError):
        f("x").search("y")


