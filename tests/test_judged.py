"""Judgements against what is observed: how often the texts are read."""

from kotomill.plans import judgements


def test_texts_are_read_once(spark, monkeypatch):
    """Places, judgements and longer words come from one pass over the texts."""
    passes = []
    plain = judgements.analyze
    monkeypatch.setattr(judgements, "analyze", lambda docs, config: passes.append(config) or plain(docs, config))
    rows = judgements.judged_eval(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 8 and sum(r.n for r in rows) > 1000
    assert len(passes) == 1
