"""What runs over envelopes leave on disk."""

from pathlib import Path

from kotomill.plans import catalog, judgements
from kotomill.sources.files import stored
from kotomill.streaming import reports

SF = "/root/testdata/sf0.001"


def test_files_of_envelopes_take_less_than_their_texts(spark, monkeypatch):
    """envelope_run and envelope_stream: the lines and what a run writes, compressed; the files grow in number, not in size."""
    texts = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("sum(octet_length(text))").first()[0]
    monkeypatch.setattr(judgements, "FILE_BYTES", -(-stored(spark, f"{SF}/documents.parquet") // 7))
    path, n = judgements._envelope_files(spark, SF)
    files = list(Path(path.removeprefix("file://")).glob("part-*"))
    assert 7 <= n <= 8 and len(files) <= n and all(f.suffix == ".gz" for f in files)
    assert spark.read.text(path).selectExpr("sum(octet_length(value))").first()[0] > 2 * texts > 2 * stored(spark, path)
    folder = path.replace("envelope-lines", "run-of")
    reports.run(spark, path, folder)
    assert stored(spark, folder) < texts


def test_the_stream_has_four_batches_at_any_size(spark, monkeypatch):
    folders = []
    plain = judgements.temporary
    monkeypatch.setattr(judgements, "FILE_BYTES", -(-stored(spark, f"{SF}/documents.parquet") // 7))
    monkeypatch.setattr(judgements, "temporary", lambda spark, name: folders.append(plain(spark, name)) or folders[-1])
    stream = sorted(map(tuple, judgements.envelope_stream(spark, SF).collect()), key=str)
    at = next(Path(f.removeprefix("file://")) for f in folders if "/run-" in f)
    assert len([f for f in at.iterdir() if f.is_dir()]) == 4
    assert stream == sorted(map(tuple, judgements.envelope_run(spark, SF).collect()), key=str) and sum(r[2] for r in stream) == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_an_envelope_is_not_kept_beside_its_report(spark, tmp_path, monkeypatch):
    held = []
    plain = reports.Written

    class Kept(plain):
        def drop(self):
            held.extend(self.df.collect())
            super().drop()

    monkeypatch.setattr(reports, "Written", Kept)
    (tmp_path / "in.jsonl").write_text("\n".join(t for t, *_ in catalog.ENVELOPES), encoding="utf-8")
    reports.run(spark, str(tmp_path / "in.jsonl"), str(tmp_path / "out"))
    assert len(held) == len(catalog.ENVELOPES) and all((r.value is None) == (r.error is None) == (r.report is not None) for r in held)
