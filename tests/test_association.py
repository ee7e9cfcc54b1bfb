from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.operators import association
from plumbline.operators.association import Apriori, baskets, itemsets, list_baskets, rules

COLUMNS = {"Milk": [1, 0, 1, 1, 0, 1, 1, 0], "Bread": [1, 1, 1, 1, 0, 0, 1, 1], "Butter": [1, 0, 1, 0, 0, 1, 1, 0], "Eggs": [0, 1, 1, 1, 1, 0, 1, 1], "Cheese": [0, 0, 1, 1, 0, 1, 0, 0]}


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(list(zip(*COLUMNS.values(), strict=True)), list(COLUMNS))


def brute(rows, support, most=9):
    n = len(rows)
    items = sorted(set().union(*rows)) if rows else []
    return {c: sum(set(c) <= r for r in rows) / n for k in range(1, min(most, len(items)) + 1) for c in combinations(items, k) if sum(set(c) <= r for r in rows) >= support * n - 1e-9 and any(set(c) <= r for r in rows)}


def test_recorded_numbers(table):
    m = Apriori(0.3, 0.6, 1.0).fit(table)
    assert sorted(r["n"] for r in m.frequent_itemsets_.selectExpr("size(items) n").collect()) == [1] * 5 + [2] * 6 + [3] * 2
    assert m.rules_.count() == 16
    assert m.rules_.where("size(consequent) > 1").count() == 2
    m = Apriori(0.25, 0.5, 1.0, 3).fit(table)
    assert m.frequent_itemsets_.count() == 23
    assert m.rules_.count() == 40
    assert m.rules_.where("size(consequent) > 1").count() == 11
    assert m.score() == pytest.approx(1.6356, abs=1e-4)


def test_rule_sets(table):
    rows = [{c for c, v in COLUMNS.items() if v[i]} for i in range(8)]
    s = brute(rows, 0.25, 3)
    want = {(a, tuple(x for x in c if x not in a)) for c in s for k in range(1, len(c)) for a in combinations(c, k) if s[c] / s[a] >= 0.5 and s[c] / s[a] / s[tuple(x for x in c if x not in a)] >= 1 - 1e-12}
    got = {(tuple(r["antecedent"]), tuple(r["consequent"])) for r in rules(itemsets(baskets(table), 0.25, 3), 0.5, 1.0).collect()}
    assert got == want


def test_views_save_load(table, tmp_path):
    m = Apriori(0.3, 0.6).fit(table)
    top = m.get_rules(2).collect()
    assert len(top) == 2 and top[0]["lift"] >= top[1]["lift"] and "." in top[0]["support"]
    assert m.get_frequent_itemsets(2).count() == 8
    m.save(str(tmp_path / "a"))
    again = Apriori.load(table.sparkSession, str(tmp_path / "a"))
    assert again.get_params() == m.get_params() and sorted(again.rules_.collect()) == sorted(m.rules_.collect())
    with pytest.raises(NotImplementedError):
        m.predict(table)
    with pytest.raises(RuntimeError):
        Apriori().score()


def test_items_of_values(spark):
    df = spark.createDataFrame([(1, "x", True), (2, "", False), (0, None, None)], "a int, b string, c boolean")
    assert [r["items"] for r in baskets(df).collect()] == [["a", "b=x", "c"], ["a=2"]]
    df = spark.createDataFrame([(["b", "a", None, "0", "a"],), ([],)], "v array<string>")
    assert [r["items"] for r in list_baskets(df, "v").collect()] == [["a", "b"]]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.sets(st.sampled_from("abcde"), min_size=1), min_size=1, max_size=12), st.sampled_from([0.2, 0.4, 0.6]))
def test_against_brute_force(spark, rows, support):
    df = spark.createDataFrame([(sorted(r),) for r in rows], "items array<string>")
    got = {tuple(r["items"]): r["support"] for r in itemsets(df, support).collect()}
    want = brute(rows, support)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert all(got[k[:-1]] >= v for k, v in got.items() if len(k) > 1)


def test_empty(spark):
    assert itemsets(spark.createDataFrame([], "items array<string>")).count() == 0


def test_rules_of_long_sets(spark):
    items = [f"i{k:02d}" for k in range(21)]
    sets = [(items, 4, 0.4)] + [([x], 5, 0.5) for x in items] + [([y for y in items if y != x], 4, 0.4) for x in items]
    got = rules(spark.createDataFrame(sets, "items array<string>, freq long, support double"), 0.5, 1.0)
    whole = got.where("size(antecedent) + size(consequent) = 21")
    assert whole.count() == 42
    assert {round(r["confidence"], 6) for r in whole.collect()} == {0.8, 1.0}


@pytest.mark.parametrize("most", [0, 1_000])
def test_itemsets_by_rows_and_by_growth(spark, monkeypatch, most):
    monkeypatch.setattr(association, "FREQUENT_ITEMS", most)
    rows = [(["a", "b", "c"],)] * 3 + [(["a", "b"],)] * 2 + [(["c", "d"],)] * 5
    got = {(tuple(r["items"]), r["freq"]) for r in itemsets(spark.createDataFrame(rows, "items array<string>"), 0.3, 2).collect()}
    assert got == {(("a",), 5), (("b",), 5), (("c",), 8), (("d",), 5), (("a", "b"), 5), (("a", "c"), 3), (("b", "c"), 3), (("c", "d"), 5)}
