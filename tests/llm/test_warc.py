import hashlib
import io
import struct

import zstandard

from foretally.llm import warc


def brute(rows):
    payloads = [(i, (h or "").encode()) for i, _, h in rows]
    keep = {}
    for i, p in payloads:
        if i is not None:
            keep[p] = max(keep.get(p, i), i)
    out = []
    for i, p in payloads:
        refers = keep.get(p) if len(p) >= 1000 and keep.get(p) != i else None
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def test_round_trip_and_files(spark, tmp_path):
    long = "<p>é\r\n\r\nWARC/1.1\r\n" + "same text " * 200
    rows = [(i, f"http://h{i}.org/\r\nX: y", long if i % 3 == 0 else f"<p>page {i} " + "words of it " * (i * 3)) for i in range(60)]
    rows += [(100, None, None), (101, "http://e.org", ""), (102, "u", "short"), (103, "u", "short"), (None, "u", long), (0, "again", long)]
    rows += [(200, "u", "z" * 1000), (201, "u", "z" * 1000), (202, "u", "y" * 999), (203, "u", "y" * 999)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, bytes int")
    found = warc.round_trip(df, spark).collect()
    ours = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found]
    assert sorted(ours, key=str) == brute(rows)

    manifest = warc.write_archives(df.coalesce(1), f"file://{tmp_path}/w").collect()
    assert sum(m.records for m in manifest) == len(rows)
    for m in manifest:
        data = open(m.archive.removeprefix("file://"), "rb").read()
        magic, size = struct.unpack("<II", data[:8])
        assert magic == 0x184D2A5D
        trained, at, n = zstandard.ZstdCompressionDict(data[8 : 8 + size]), 8 + size, 0
        while at < len(data):  # each frame is one whole record
            one = zstandard.ZstdDecompressor(dict_data=trained).decompressobj()
            record = one.decompress(data[at:])
            assert len(list(warc.parse_records(io.BytesIO(record)))) == 1 and record.startswith(b"WARC/1.1\r\n")
            at, n = len(data) - len(one.unused_data), n + 1
        assert n == m.records


def test_few_records_and_none(spark):
    df = spark.createDataFrame([(1, "u", "a")], "page_id long, url string, html string")
    assert [r.payload_bytes for r in warc.round_trip(df, spark).collect()] == [1]
    assert warc.round_trip(df.limit(0), spark).collect() == []


def test_archives_lie_in_the_folder_that_release_deletes(spark, monkeypatch):
    import os

    from foretally.workspace import run_folder

    made = []
    real = warc.write_archives
    monkeypatch.setattr(warc, "write_archives", lambda pages, folder, **columns: made.append(folder) or real(pages, folder, **columns))
    df = spark.createDataFrame([(i, "u", f"text {i}") for i in range(5)], "page_id long, url string, html string")
    assert warc.round_trip(df, spark).count() == 5
    path = made[0].removeprefix("file://")
    assert path.startswith(run_folder(spark).removeprefix("file:")) and os.listdir(path)


def test_folders_are_named_in_full(spark):
    assert {warc.qualified(spark, f) for f in ("/a/b", "file:/a/b", "file:///a/b")} == {"file:///a/b"}


def test_payloads_move_only_beyond_the_broadcast_limit(spark, monkeypatch):
    from foretally import workspace

    long = "x" * 2000
    df = spark.createDataFrame([(i, "u", long if i % 3 else f"{i}" * 1500) for i in range(30)], "page_id long, url string, html string")
    rows = warc.payload_rows(df, "page_id", "url", "html")

    def decided():
        found = warc.with_decisions(rows, 1000)
        plan = found._jdf.queryExecution().executedPlan().toString()
        return "BroadcastHashJoin" in plan, sorted((r.page_id, r.refers_to) for r in found.where("refers_to is not null").collect())

    small = decided()
    monkeypatch.setattr(workspace, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        large = decided()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert small[0] and not large[0] and small[1] == large[1] == [(i, 29) for i in range(30) if i % 3 and i != 29]
