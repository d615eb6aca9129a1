import gzip
import hashlib
import io

import pytest

from stratiform.llm import files, scratch, warc

BIG = "<html>" + "x" * 300_000 + "</html>"
SHORT = "short"
EXACT = "y" * 100
PAGES = [
    (5, "http://a/5", BIG),
    (3, "http://a/3", BIG),
    (9, "http://a/9\r\nWARC-Type: bad", BIG),
    (1, "http://a/1", SHORT),
    (2, None, SHORT),
    (4, "http://a/4", None),
    (6, "http://a/6", ""),
    (7, "http://a/7", EXACT),
    (8, "http://a/8", EXACT),
    (10, "http://a/10", "é" * 60 + "\r\n\r\nWARC/1.1\r\n"),
    (None, "http://a/none", EXACT),
    (11, "http://a/11", "same id twice " * 20),
    (11, "http://a/11", "same id twice " * 20),
]
SCHEMA = "page_id long, url string, html string"


def expected():
    first = {}
    for i, _, h in PAGES:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h in PAGES:
        b = (h or "").encode()
        again = len(b) >= 100 and i is not None and i != first[h]
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    pages = spark.createDataFrame(PAGES, SCHEMA).repartition(3)
    assert sorted((tuple(r) for r in warc.round_trip(spark, pages).collect()), key=str) == expected()


def test_payloads_come_back(spark):
    manifest = warc.write_archives(spark.createDataFrame(PAGES, SCHEMA), scratch.new_path(spark, "warc"))
    rows = warc.read_archives(spark, manifest, with_payload=True).collect()
    sent = {i: (h or "").encode() for i, _, h in PAGES}
    assert all((r.payload is None) == (r.record_type == "revisit") for r in rows)
    assert all(bytes(r.payload) == sent[r.page_id] for r in rows if r.payload is not None and r.page_id is not None)


def test_a_member_per_record(spark):
    manifest = warc.write_archives(spark.createDataFrame(PAGES, SCHEMA).coalesce(1), scratch.new_path(spark, "warc")).collect()
    for m in manifest:
        with files.open_stream(m.path) as raw:
            assert gzip.decompress(raw.read()).count(b"WARC-Record-ID") == m.records


def record(**other):
    payload = b"hello" * 50
    head = {"t": "response", "d": hashlib.sha256(payload).hexdigest(), "n": len(payload)} | other
    text = f"WARC/1.1\r\nWARC-Type: {head['t']}\r\nWARC-Payload-Digest: sha256:{head['d']}\r\nX-Payload-Length: {len(payload)}\r\nX-Page-Id: 1\r\nContent-Length: {head['n']}\r\n\r\n"
    return text.encode() + payload + b"\r\n\r\n"


def revisit():
    return b"WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Payload-Digest: sha256:00\r\nX-Payload-Length: 250\r\nX-Page-Id: 2\r\nX-Refers-To-Page-Id: 1\r\nContent-Length: 0\r\n\r\n\r\n\r\n"


def test_good_record():
    assert len(list(warc.read_records(io.BytesIO(gzip.compress(revisit()) * 2)))) == 2
    assert len(list(warc.read_records(io.BytesIO(gzip.compress(record()) * 3)))) == 3


@pytest.mark.parametrize(
    "data",
    [
        gzip.compress(record(d="0" * 64)),
        gzip.compress(record(n=10)),
        gzip.compress(record(n=10_000)),
        gzip.compress(record())[:-20],
        gzip.compress(record()) + b"junk that is no member",
        gzip.compress(record() + record()),
        gzip.compress(b"no header"),
        *(gzip.compress(record()[: len(record()) - k]) for k in (1, 3, 4)),
        *(gzip.compress(record() + b"abc"[:k]) for k in (1, 2, 3)),
        *(gzip.compress(revisit() + b"abc"[:k]) for k in (1, 2, 3)),
        *(gzip.compress(revisit()[: len(revisit()) - k]) for k in (1, 3, 4)),
    ],
)
def test_damage_is_noticed(data):
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(data)))


def test_edges(spark):
    assert warc.round_trip(spark, spark.createDataFrame([], SCHEMA)).count() == 0
    extra = spark.createDataFrame([(1, "u", "h", "x", 2)], SCHEMA + ", _id string, payload int")
    assert warc.round_trip(spark, extra).count() == 1
