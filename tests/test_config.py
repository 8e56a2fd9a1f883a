import json

import pytest

from ledgerloom.config import (
    BUCKETS, CATEGORIES, DEFAULT_TAXONOMY, Bill, Policy, Rule, Taxonomy, build, concat_dims, load_dims,
)


def test_roll_up_drives_the_derived_sets():
    assert DEFAULT_TAXONOMY.non_spend == ("Income", "Transfers")
    assert set(DEFAULT_TAXONOMY.fixed) == {"Rent", "Utilities", "Tools", "Health/Fitness", "Subscriptions", "Fees"}
    assert len(CATEGORIES) == 20 and len(BUCKETS) == 6
    with pytest.raises(ValueError, match="unknown buckets"):
        Taxonomy(members={"Nowhere": ("Rent",)})


@pytest.mark.parametrize(("kind", "entry", "message"), [
    (Rule, {"pattern": "A(", "category": "Rent"}, "bad pattern"),
    (Rule, {"pattern": "A", "category": "Nope"}, "unknown"),
    (Rule, {"category": "Rent"}, "missing"),
    (Rule, "text", "mapping"),
    (Policy, {"name": "x", "cap_monthly_cents": 1}, "exactly one"),
    (Policy, {"name": "x", "cap_monthly_cents": 1, "bucket": "Other", "pattern": "A"}, "exactly one"),
    (Policy, {"name": "x", "cap_monthly_cents": 1, "bucket": "Nope"}, "unknown"),
    (Policy, {"name": "x", "cap_monthly_cents": 1, "sub_label": "Nope"}, "unknown"),
    (Policy, {"name": "x", "cap_monthly_cents": 1, "bucket": "Other", "typo": 1}, "unknown key"),
    (Bill, {"name": "x", "pattern": "A"}, "missing"),
    (Bill, {"name": "x", "pattern": "A", "due_day": 32, "expected_cents": 1, "tolerance_pct": 0}, "due_day"),
    (Bill, {"name": "x", "pattern": "A", "due_day": True, "expected_cents": 1, "tolerance_pct": 0}, "due_day"),
    (Bill, {"name": "x", "pattern": "A", "due_day": 1, "expected_cents": 0, "tolerance_pct": 0}, "expected"),
    (Bill, {"name": "x", "pattern": "A", "due_day": 1, "expected_cents": 1, "tolerance_pct": 101}, "tolerance"),
])
def test_bad_settings_are_refused(kind, entry, message):
    with pytest.raises(ValueError, match=message):
        build(kind, [entry])


def test_local_settings_come_first_and_win(tmp_path):
    shared, local = tmp_path / "shared.json", tmp_path / "local.json"
    shared.write_text(json.dumps({"grace_days": 3, "rules": [{"pattern": "B", "category": "Rent"}]}))
    local.write_text(json.dumps({"grace_days": 10, "rules": [{"pattern": "A", "category": "Cash"}]}))
    dims = load_dims(shared, local)
    assert [r.pattern for r in dims.rules] == ["A", "B"] and dims.grace_days == 10
    assert load_dims(shared, tmp_path / "none.json").grace_days == 3
    shared.write_text(json.dumps({"grace_days": -1}))
    with pytest.raises(ValueError, match="grace_days"):
        load_dims(shared)
    shared.write_text(json.dumps({"rule": []}))
    with pytest.raises(ValueError, match="section"):
        load_dims(shared)
    assert concat_dims([1], [2, 3]) == [1, 2, 3]
