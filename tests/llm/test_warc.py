"""Round trips, damaged archives and revisit records."""
import gzip

from gridlake.llm import warc
from gridlake.llm.shared import shared_path


def archive(n=6):
    return [(warc.record_text(i, f"u{i}", f"<p>{i} WARC/1.1\r\n {'x' * i * 50}</p>", None) + warc.END).encode() for i in range(n)]


def ids(found):
    return [f[3][0]["warc-record-id"][10:-1] for f in found if f[0] == "record"]


def test_whole_archives_have_no_gaps():
    for parts in (archive(), [gzip.compress(p) for p in archive()], [p if i % 2 else gzip.compress(p) for i, p in enumerate(archive())]):
        found = list(warc.salvage(b"".join(parts)))
        assert ids(found) == list("012345") and all(f[0] == "record" for f in found)
        assert found[0][1] == 0 and all(a[2] == b[1] for a, b in zip(found, found[1:])) and found[-1][2] == len(b"".join(parts))


def test_later_records_survive_damage():
    for pack in (lambda p: p, gzip.compress):
        parts = [pack(p) for p in archive()]
        whole = b"".join(parts)
        at = len(b"".join(parts[:2]))
        broken = bytearray(whole)
        broken[at + len(parts[2]) - 12] ^= 0x55
        found = list(warc.salvage(bytes(broken)))
        assert ids(found) == list("01345")
        assert [(f[1], f[2]) for f in found if f[0] == "gap"] == [(at, at + len(parts[2]))]
        cut = whole[:at + 40] + b"garbage" + b"".join(parts[3:])
        found = list(warc.salvage(cut))
        assert ids(found) == list("01345") and [(f[1], f[2]) for f in found if f[0] == "gap"] == [(at, at + 47)]
        found = list(warc.salvage(whole[:-20]))
        assert ids(found) == list("01234") and found[-1][0] == "gap" and found[-1][2] == len(whole) - 20
    assert list(warc.salvage(b"")) == [] and [f[0] for f in warc.salvage(b"noise")] == ["gap"]


def test_spark_round_trip(spark):
    rows = [(1, "a", "same\r\n\r\nWARC/1.1\r\n"), (2, None, None), (3, "c\r\nd", "same\r\n\r\nWARC/1.1\r\n"), (5, "e", ""), (7, "f", "é漢" * 30000), (9, "g", "same\r\n\r\nWARC/1.1\r\n")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, first string")
    path = shared_path(spark, "warc")
    warc.write_archives(pages, path, records_per_file=2)
    got = sorted((int(r["page_id"]), r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"], r["payload"]) for r in warc.read_archives(spark, path).collect())
    first = {}
    want = []
    for i, _, html in rows:
        body = (html or "").encode()
        f = first.setdefault(body, i)
        want.append((i, "response" if f == i else "revisit", None if f == i else str(f), len(body), warc.digest32(body), bytearray(body) if f == i else None))
    assert got == want
    path = shared_path(spark, "warc")
    warc.write_archives(pages, path, min_bytes=1)
    assert {r["page_id"] for r in warc.read_archives(spark, path).filter("record_type = 'revisit'").collect()} == {"3", "9"}
    path = shared_path(spark, "warc")
    warc.write_archives(pages.limit(0), path)
    assert warc.read_archives(spark, path).count() == 0
