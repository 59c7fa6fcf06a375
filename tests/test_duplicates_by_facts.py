"""evl_07_duplicates counts pairs by the facts of rules and ranks no list of pairs."""

import collections

from rulewright import operators

RULES = "rule_id string, rule_no long, workspace_id string, domain_id string, business_term string, operation string, scope string, affected_column string"


def _loops(new, old):
    """kind: tp, fp, fn, tn, top hits and pairs, pair by pair."""
    pairs = collections.defaultdict(list)
    for n in new:
        for o in old:
            if n[2:5] == o[2:5] and None not in n[2:5]:
                known = n[1] is not None and o[1] is not None
                kind = "other" if known and n[1] != o[1] else {20: "operation_changed", 40: "condition_dropped", 60: "value_changed", 80: "scope_changed"}.get((n[1] or 0) % 100, "exact")
                same = [a is not None and a == b for a, b in zip(n[5:], o[5:], strict=True)]
                pairs[n[0]].append((-(2 * same[0] + same[1] + same[2]), o[1] or 10**9, kind, known and n[1] == o[1] and same[0], all(same)))
    found = collections.Counter()
    for of_one in pairs.values():
        for place, (_, _, kind, expected, predicted) in enumerate(sorted(of_one), 1):
            for k in (kind, "all"):
                found.update([(k, {(1, 1): "tp", (0, 1): "fp", (1, 0): "fn", (0, 0): "tn"}[expected, predicted]), (k, "n")] + [(k, "top")] * (expected and place <= 10))
    return {k: tuple(found[k, x] for x in ("tp", "fp", "fn", "tn", "top", "n")) for k, _ in found}


def _told(df):
    return {r.kind: (r.tp, r.fp, r.fn, r.tn, round(r.recall_at_10 * max(r.tp + r.fn, 1)), r.n_pairs) for r in df.collect()}


def test_counts_are_those_of_all_pairs(spark):
    group = ("w", "d", "t")
    old = [(f"R{i}", i, *group, "map" if i % 3 else None, "global" if i % 5 else "regional", "status" if i % 2 else "total") for i in range(1, 90)]
    old += [("R20", 20, *group, "map", "global", "total")] * 12 + [("R0", None, *group, "map", "global", "status"), ("Q", 40, "w", None, "t", "map", "global", "status")]
    new = [(f"N{i}", i, *group, "map" if i % 40 else "exclude", "global" if i != 80 else "departmental", "status" if i % 2 else "total") for i in (4, 7, 20, 25, 40, 60, 80, 85, 89)]
    new += [("N40", 41, *group, "map", "global", "status"), ("N41", None, *group, "map", "global", "status"), ("N42", 40, "w", None, "t", "map", "global", "status")]
    given = {"new_rules": spark.createDataFrame(new, RULES), "rules": spark.createDataFrame(old, RULES)}
    found = operators.apply(spark, "evl_07_duplicates", **given)
    assert _told(found) == _loops(new, old)
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()


def test_no_pairs(spark):
    none = spark.createDataFrame([], RULES)
    (found,) = operators.apply(spark, "evl_07_duplicates", new_rules=none, rules=none).collect()
    assert (found.kind, found.tp, found.n_pairs, found.accuracy) == ("all", 0, 0, None)
