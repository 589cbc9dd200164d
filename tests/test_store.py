from __future__ import annotations

import pytest

from pulsegrid.streaming import ingest, store


def record(i, t, v, day=1, **more):
    extra = "".join(f',"{k}":{x}' for k, x in more.items())
    return f'{{"id":"{i}","type":"{t}","kind":"quantity","startDate":"2026-01-{day:02d}T00:00:00Z","value":{v}{extra}}}'


GONE = '{{"id":"{}","type":"x","kind":"deletion"}}'
DATED = '{{"type":"{}","kind":"deletion","startDate":"2026-01-{:02d}T00:00:00Z"}}'
COVERAGE = '{{"kind":"typeCoverage","type":"T","state":"{}","observedAt":"2026-01-{:02d}T00:00:00Z"}}'
DOSE = '{{"kind":"medicationDose","id":"{}","startDate":"2026-01-01T00:00:00Z","logStatus":{{"name":"{}"}}}}'
PAGE = '{{"kind":"quantitySeriesReadings","id":"p{0}","sample":"s","type":"T","startDate":"2026-01-01T00:00:00Z","sequence":{0},"offset":{0},"readings":[{{"v":{1}}}]}}'

DELIVERIES = [
    [record(i, t, i) for i in range(30) for t in ("T", "U")] + ["junk", COVERAGE.format("draining", 5), DOSE.format("d1", "taken"), PAGE.format(0, 1), PAGE.format(1, 1)],
    [record(3, "T", 99), GONE.format(4), GONE.format("later"), COVERAGE.format("anchorClosed", 3), DOSE.format("d1", "skipped"), DOSE.format("d2", "taken"), "junk", "other junk"],
    [record(4, "U", 44), DATED.format("U", 2), record(50, "U", 1, day=2), PAGE.format(1, 7), GONE.format("d2")],
    [record("later", "T", 5), GONE.format(3), record(51, "U", 1, day=2), DATED.format("T", 1), COVERAGE.format("unsupported", 9)],
]


class Archive:
    def __init__(self, spark, home):
        self.spark, self.home, self.n = spark, home, 0
        (home / "in").mkdir()

    def take(self, lines, name=None):
        self.n += 1
        (self.home / f"in/{name or f'{self.n:03d}'}.ndjson").write_text("\n".join(lines))
        source = ingest.line_stream(self.spark, str(self.home / "in"))
        ingest.start_upsert(source, str(self.home / "log"), str(self.home / "ck")).awaitTermination()

    def tables(self, base=None):
        log, base = str(self.home / "log"), base and str(self.home / base)
        out = {"state": ingest.state(self.spark, log, base), "quarantine": ingest.quarantined(self.spark, log, base)}
        out |= {k: ingest.side_table(self.spark, log, k, base) for k in ("typeCoverage", "medicationDose", "quantitySeriesReadings")}
        return {k: sorted(map(str, t.collect())) for k, t in out.items()}

    def compact(self):
        return store.compact(self.spark, str(self.home / "log"), str(self.home / "base"))


@pytest.mark.parametrize("snapshots", [(0,), (1, 2), (0, 1, 2, 3)])
def test_snapshots_equal_the_fold_of_the_whole_log(spark, tmp_path, snapshots):
    """All tables, after snapshots at any deliveries; late tombstones of both kinds; epochs go only once the snapshot has them."""
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    plain, kept = Archive(spark, tmp_path / "a"), Archive(spark, tmp_path / "b")
    for n, lines in enumerate(DELIVERIES):
        plain.take(lines)
        kept.take(lines)
        if n in snapshots:
            assert kept.compact() > 0
            assert kept.compact() == 0  # nothing is new
            store.expire(spark, str(kept.home / "log"), str(kept.home / "base"))
    assert kept.tables("base") == plain.tables()
    assert len(store.folders(spark, str(kept.home / "log"))) < len(store.folders(spark, str(plain.home / "log")))


def test_only_touched_buckets_are_written(spark, tmp_path):
    a = Archive(spark, tmp_path)
    a.take([record(i, "T", i) for i in range(300)])
    assert a.compact() == store.BUCKETS
    a.take([record(7, "T", 8)])
    assert a.compact() == 1
    assert len(set(store.head(spark, str(tmp_path / "base"))[2].values())) == 2


def test_a_snapshot_without_a_manifest_is_none(spark, tmp_path):
    a = Archive(spark, tmp_path)
    a.take(DELIVERIES[0])
    a.compact()
    before = a.tables("base")
    spark.range(3).write.parquet(str(tmp_path / "base/version=1/bucket=0"))  # what a run left that broke off
    assert a.tables("base") == before
    a.take(DELIVERIES[1])
    a.compact()
    assert a.tables("base") == a.tables()


def test_the_same_batch_under_another_name_changes_nothing(spark, tmp_path):
    a = Archive(spark, tmp_path)
    first = [record(1, "T", 1), record(2, "T", 2), record(2, "T", 2)]
    a.take(first)
    a.take([record(1, "T", 5), GONE.format(2)])
    before = a.tables()
    a.take(first, "again")
    a.take(first[::-1], "and-again")
    assert a.tables() == before
    rows = {r.batch: (r.records, r.duplicate) for r in ingest.ledger(spark, str(tmp_path / "log")).collect()}
    assert rows == {"001.ndjson": (3, False), "002.ndjson": (2, False), "again.ndjson": (3, True), "and-again.ndjson": (3, True)}
    a.take(first[:2], "other")  # a line fewer is another batch
    assert a.tables() != before


def test_equal_batches_of_one_epoch_count_once(spark, tmp_path):
    keys = spark.createDataFrame([("b", "k", 2), ("a", "k", 1), ("c", "other", 1), ("d", "old", 1)], "batch string, key string, records long").selectExpr("batch", "timestamp'2026-01-01' as modified", "records", "key")
    known = spark.createDataFrame([("old", False), ("other", True)], "key string, duplicate boolean")
    assert {r.batch: r.duplicate for r in ingest.judged(keys, known).collect()} == {"a": False, "b": True, "c": False, "d": True}


def test_a_batch_ends_with_the_page_that_passes_its_bytes(spark):
    from pulsegrid.operators import state

    rows = spark.createDataFrame([(r, t, p, i, 40) for r in (0, 1) for t in (0, 1) for p in (0, 1) for i in range(2)], "round int, turn int, page int, i int, n int")
    took = lambda most: sorted({(r.round, r.turn, r.page) for r in state.within_bytes(rows, ["round", "turn", "page"], "n", most).collect()})
    assert took(0) == [] and took(1) == [(0, 0, 0)] and took(80) == [(0, 0, 0)] and took(81) == [(0, 0, 0), (0, 0, 1)]
    assert took(401) == [(0, 0, 0), (0, 0, 1), (0, 1, 0), (0, 1, 1), (1, 0, 0), (1, 0, 1)] and len(took(10**9)) == 8


def test_an_anchor_that_does_not_advance_is_stuck(spark):
    from pulsegrid.operators import state

    stored = spark.createDataFrame([("a", 1, 5), ("b", 1, 5), ("c", 1, 5)], "type string, anchor long, delivered long")
    commits = spark.createDataFrame([("a", 1, 1, 3), ("b", 1, 1, 0), ("c", 1, 2, 3)], "type string, base long, anchor long, delivered long")
    assert {r.type: (r.anchor, r.delivered, r.status) for r in state.commit_anchors(stored, commits).collect()} == {"a": (1, 5, "stuck"), "b": (1, 5, "committed"), "c": (2, 8, "committed")}


def test_one_bad_part_voids_its_archive(spark, monkeypatch):
    import io
    import zipfile

    from pulsegrid.sources import formats

    def archive(**parts):
        body = io.BytesIO()
        with zipfile.ZipFile(body, "w") as z:
            for name, text in parts.items():
                z.writestr(name, text)
        return body.getvalue()

    good = archive(a='{"id":"1"}\n\n{"kind":"manifest"}\n' + '{"id":"2"}\n' * 25_000, b="", c='{"kind":"someConnectionTest"}')
    told = [("good", good), ("bad", archive(a='{"id":"3"}', b='{"id":')), ("cut", good[:60]), ("none", None), ("void", archive())]
    manifest, records = formats.whole_archives(formats.unzipped(spark.createDataFrame(told, "archive string, content binary")))
    assert {r.archive: (r.lines, r.bad, r.taken) for r in manifest.collect()} == {"good": (25_003, 0, True), "bad": (2, 1, False), "cut": (1, 1, False), "none": (1, 1, False)}
    rows = records.collect()
    assert {r.archive for r in rows} == {"good"} and len(rows) == 25_001 and len({r.line for r in rows}) == 25_001
