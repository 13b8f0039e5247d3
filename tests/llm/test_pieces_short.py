"""Short stretches of the piece encoder: the same ids as the windowed search, and a memo that keeps what recurs."""

import random

from orrery.llm import pieces


def test_short_equals_windowed_search():
    p, rng = pieces.load(), random.Random(5)
    signs = "aabcdeéxyzß 0123.,#漢字\n\ud800\U0001f600▁\x00"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(0, 65))) for _ in range(3000)] + ["a" * 64, " " * 64, "#" * 64, "漢" * 64, " international", ""]
    for t in texts:
        assert pieces.short(t, p) == [i for run in pieces.viterbi(t, p) for i in run], t


def test_a_full_memo_keeps_what_recurs(monkeypatch):
    p, searched = pieces.load(), []
    monkeypatch.setattr(pieces, "MEMO", 20)
    monkeypatch.setattr(pieces, "short", lambda s, p, own=pieces.short: searched.append(s) or own(s, p))
    for i in range(300):
        pieces.encode(f" often w{i}", p)
    assert searched.count(" often") == 1 and len(p.memo) <= 20 and len(p.before) <= 20
