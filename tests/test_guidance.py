"""References of guided sampling come from every channel."""

from collections import Counter

from orrery.operators import energy
from orrery.plans import analytics
from orrery.plans import bindings as B

FOLDER = "/root/testdata/sf0.1"


def test_references_of_every_channel(spark, monkeypatch):
    seen, take = [], energy.references

    def noted(refs, kind=None):
        seen.extend(r["channel_idx"] for r in refs.select("channel_idx").collect())
        return take(refs, kind)

    monkeypatch.setattr(energy, "references", noted)
    rows = analytics.ddim_guided(spark, FOLDER).collect()
    n = Counter(seen)
    assert set(n) == {r["channel_idx"] for r in rows} and len(rows) == B.donors(spark, FOLDER).count()
    assert max(n.values()) - min(n.values()) <= 1
