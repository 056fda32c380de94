import hashlib

import pytest

from stockbook.llm import warc as W
from stockbook.llm.common import scratch


def pages():
    big = "é" * 600
    return [(1, "http://a/ b\r\n", big), (2, None, big), (5, "u", big), (None, "v", big), (3, "x", "small"),
            (4, "y", "small"), (6, "z", None), (7, "w", ""), (5, "u", big), (None, None, None),
            (8, "l", "<p>" + "long " * 400_000)]


def test_round_trip(spark):
    rows = pages()
    df = spark.createDataFrame([(*r, "k", 1, "d") for r in rows],
                               "page_id bigint, url string, html string, digest string, n int, largest string")
    files = W.write_archives(W.with_record_types(df), f"{scratch(spark)}/w", file_bytes=300)
    got = W.read_archives(files).collect()
    assert len(got) == len(rows) and all(r["verified"] for r in got)
    full = {}
    for r in rows:
        p = (r[2] or "").encode()
        same = [x[0] for x in rows if (x[2] or "").encode() == p and x[0] is not None]
        again = len(p) >= 1000 and r[0] != max(same)
        full.setdefault((r[0], len(p)), []).append((hashlib.sha1(p).hexdigest(), "revisit" if again else "response",
                                                    max(same) if again else None, None if again else p))
    for r in got:
        want = full[r["page_id"], r["payload_bytes"]]
        have = (r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"]))
        assert have in want
        want.remove(have)
    assert not any(full.values())


def test_no_pages(spark):
    df = spark.createDataFrame([], "page_id bigint, url string, html string")
    files = W.write_archives(W.with_record_types(df), f"{scratch(spark)}/w")
    assert W.read_archives(files).count() == 0


def chunks(data, n):
    return iter([data[i:i + n] for i in range(0, len(data), n)])


def test_sequential_reader_and_damage():
    records = [W.record_bytes(i, None, b"x" * (i * 37), "response", None) for i in range(20)]
    data = b"".join(records)
    for n in (1, 7, 64, len(data)):
        assert [W.parse(h, b)[4] for h, b in W.read_records(chunks(data, n))] == [i * 37 for i in range(20)]
    with pytest.raises(ValueError):
        list(W.read_records(chunks(data[:-5], 64)))
    head, block = next(W.read_records(chunks(records[3], 64)))
    assert not W.parse(head, block[:-1] + b"y")[6]
