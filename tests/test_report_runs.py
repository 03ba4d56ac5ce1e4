"""Runs over files of envelopes: batch and stream give equal rows, what breaks the contract is in quarantine, exit codes."""

from collections import Counter

from kotomill.plans import catalog
from kotomill.streaming import reports

GOOD = [t for t, c, *_ in catalog.ENVELOPES if c < 2]
BAD = [t for t, c, *_ in catalog.ENVELOPES if c == 2]


def told(spark, folder):
    reported, refused = reports.results(spark, str(folder))
    return Counter(r.value for r in reported.collect()), Counter((r.value, r.error) for r in refused.collect())


def test_batch_and_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for k in range(5):
        (source / f"{k}.jsonl").write_text("\n".join((GOOD + BAD)[k:] + [""]), encoding="utf-8")
    assert reports.run(spark, str(source), str(tmp_path / "run")) == 2
    reports.stream(spark, str(source), str(tmp_path / "stream"), str(tmp_path / "state"), files=2).awaitTermination()
    batch, stream = told(spark, tmp_path / "run"), told(spark, tmp_path / "stream")
    assert batch == stream and len(list((tmp_path / "stream").iterdir())) == 3
    assert sum(batch[0].values()) == sum(len((GOOD + BAD)[k:]) - len(BAD) for k in range(5)) and {v for v, _ in batch[1]} == set(BAD)
    reports.stream(spark, str(source), str(tmp_path / "stream"), str(tmp_path / "state"), files=2).awaitTermination()
    assert told(spark, tmp_path / "stream") == batch


def test_exit_codes_and_whole_files(spark, tmp_path):
    clean, failing = ([t for t, c, *_ in catalog.ENVELOPES if c == code] for code in (0, 1))
    for name, texts, code in (("clean", clean, 0), ("failing", clean + failing, 1), ("none", [], 0)):
        (tmp_path / name).mkdir()
        for k, text in enumerate(texts or [""]):
            (tmp_path / name / f"{k}.json").write_text(text, encoding="utf-8")
        assert reports.run(spark, str(tmp_path / name), str(tmp_path / f"{name}-out"), lines=False) == code
        assert sum(told(spark, tmp_path / f"{name}-out")[0].values()) == len(texts)
