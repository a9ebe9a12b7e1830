"""Personal data that is written with blanks."""

from __future__ import annotations

from prefforge.llm.pii import find_pii
from tests.llm.data import frame


def test_spaced_seeds(spark):
    """Entities count whole, not by their first token, and an added identifier is whole too."""
    rows = [(i, f"you may ring: +1 (017) 555-77{i:02} or not", "en", "a", 0) for i in range(6)]
    rows += [(10, "please ring: 017 555 7713 now", "en", "a", 0), (11, "on 017 555 7713 nothing", "en", "a", 0), (12, "ring: 017 555\n1234 there", "en", "a", 0)]
    rows += [(20 + i, f"pay by: 4111 1111 1111 1111 in {i}", "en", "a", 0) for i in range(6)] + [(30, "pay by: 5500 1 here", "en", "a", 0)]
    got = {r["doc_id"]: r for r in find_pii(frame(spark, rows)).collect()}
    assert got[10]["spans"] == "phone:13:25" and got[10]["n_added"] == 1
    assert got[12]["spans"] == "phone:6:13" and got[11]["n_added"] == 0
    assert all(got[i]["spans"] == "phone:14:31" for i in range(6))
    # six times the same card is one seed
    assert got[30]["n_added"] == 0
