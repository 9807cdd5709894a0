"""How tiered matching joins a positive's places to the numbered negatives."""

import re

from tickloom.operators import controls, scan


def test_places_are_never_broadcast(frame, monkeypatch):
    plans, settled = [], scan.settled

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return settled(df)

    monkeypatch.setattr(scan, "settled", noted)
    sch = "id long, a string, s double"
    pos, neg = frame([(i, "x", float(i)) for i in range(5)], sch), frame([(100 + i, "x", i / 7) for i in range(60)], sch)
    d = controls.tiered_match(pos, neg, [("A", ["a"])], "s", limit=3)
    assert d.count() == 15
    places = [p for p in plans if re.search(r"Join \[[^\]]*_n#", p)]
    assert places and not any(re.search(r"Broadcast\w*Join \[[^\]]*_n#", p) for p in places)
