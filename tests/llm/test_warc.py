import base64
import gzip
import hashlib
import random

import pytest

from shelf.llm import queries, warc
from tests.llm.helpers import SMALL, table


def parse(data):
    """A plain reading of an archive: (fields, block) of each record."""
    found, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        fields = dict(line.split(": ", 1) for line in lines[1:])
        size = int(fields["Content-Length"])
        found.append((fields, data[end + 4:end + 4 + size]))
        at = end + 4 + size
        assert data[at:at + 4] == b"\r\n\r\n"
        at += 4
    return found


def pages_of(spark, rows):
    return spark.createDataFrame([(k, u, h, 1, "z") for k, u, h in rows], "page_id long, url string, html string, payload int, sha string")


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_query(spark):
    pages = table(spark, "pages").collect()
    rows = {r.page_id: r for r in queries.op13_warc(spark, SMALL).collect()}
    assert len(rows) == len(pages)
    first = {}
    for p in sorted(pages, key=lambda p: p.page_id):
        data = (p.html or "").encode()
        leader = first.setdefault(data, p.page_id)
        r = rows[p.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(data), digest(data))
        assert (r.record_type, r.refers_to) == (("response", None) if leader == p.page_id else ("revisit", leader))


ODD = ["", None, "WARC/1.", "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 30, "ä€😀" * 500, "\r\n" * 100, "a" * 999, "0\r\n\r\n", "same", "same", "same", "0" * 70_000]


def test_edges(spark, tmp_path):
    r = random.Random(1)
    rows = [(i, f"http://h/{i}?ä b", t) for i, t in enumerate(ODD)]
    rows += [(None, None, "same"), (8, "http://other", "same"), (8, None, "same"), (8, None, "same"), (None, "http://n", None), (99, None, "WARC/1.1\r\n" * r.randint(50, 90))]
    pages = pages_of(spark, rows)
    for segment, chunk, least in ((150, 7, 0), (64 * 1024, 8192, 0), (300, 100, 5)):
        path = str(tmp_path / f"a{segment}")
        warc.write_warc(pages.repartition(3), path, segment_bytes=segment, chunk_bytes=chunk, least=least, file_records=5)
        got = warc.resolved(warc.read_warc(spark, path)).collect()
        assert len(got) == len(rows) and not any(g.problem for g in got)
        assert len({g.record_id for g in got}) == len(got)
        want = []
        for k, u, t in rows:
            data = (t or "").encode()
            group = [x for x, _, y in rows if (y or "").encode() == data]
            leader = min((x for x in group if x is not None), default=None)
            want.append((None if k is None else str(k), len(data), digest(data), None if leader is None else str(leader), len(data) < least))
        assert sorted(((g.key, g.payload_bytes, g.payload_digest) for g in got), key=str) == sorted((w[:3] for w in want), key=str)
        for d in {w[2] for w in want}:
            own, group = [g for g in got if g.payload_digest == d], [w for w in want if w[2] == d]
            leaders = [g for g in own if g.record_type == "response"]
            if group[0][4]:
                assert len(leaders) == len(group)
                continue
            assert [g.key for g in leaders] == [group[0][3]]
            assert all(g.refers_to == leaders[0].record_id and g.refers_to_key == group[0][3] for g in own if g.record_type == "revisit")
        payloads = {x.payload for x in warc.read_warc(spark, path).collect() if x.record_type == "response"}
        assert payloads == {(t or "").encode() for _, _, t in rows}
        assert {g.uri for g in got} == {u for _, u, _ in rows} | {None}


def test_archives_are_warc(spark, tmp_path):
    """A plain parser reads what is written; segments follow the standard's numbers and totals."""
    path = tmp_path / "w"
    warc.write_warc(pages_of(spark, [(1, "http://a", "x" * 1000), (2, "http://b", "y"), (3, "http://c", "y")]), str(path), segment_bytes=400)
    records = [x for f in path.glob("*.gz") for x in parse(gzip.decompress(f.read_bytes()))]
    kinds = sorted(f["WARC-Type"] for f, _ in records)
    assert kinds == ["continuation", "continuation", "response", "response", "revisit"]
    long = sorted((f for f, _ in records if "WARC-Segment-Number" in f), key=lambda f: int(f["WARC-Segment-Number"]))
    assert [f["WARC-Segment-Number"] for f in long] == ["1", "2", "3"]
    assert all(f["WARC-Segment-Origin-ID"] == long[0]["WARC-Record-ID"] for f in long[1:])
    assert ["WARC-Segment-Total-Length" in f for f in long] == [False, False, True]


def test_faulty_archives(spark, tmp_path):
    path = tmp_path / "w"
    warc.write_warc(pages_of(spark, [(1, "http://a", "x" * 1000), (2, "http://b", "y" * 50)]).coalesce(1), str(path), segment_bytes=400)
    (file,) = path.glob("*.gz")
    whole = gzip.decompress(file.read_bytes())

    def problems(data):
        out = tmp_path / f"f{random.random()}"
        out.mkdir()
        (out / "x.warc.gz").write_bytes(gzip.compress(data))
        return {r.key: r.problem for r in warc.read_warc(spark, str(out)).collect()}

    assert problems(whole) == {"1": None, "2": None}
    records = parse(whole)
    texts = [b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in f.items()).encode() + b"\r\n" + b + b"\r\n\r\n" for f, b in records]
    gone = next(i for i, (f, _) in enumerate(records) if f.get("WARC-Segment-Number") == "2")
    assert "missing" in problems(b"".join(t for i, t in enumerate(texts) if i != gone))["1"]
    assert "twice" in problems(b"".join(texts) + texts[gone])["1"]
    assert "total" in problems(whole.replace(b"Total-Length: 1", b"Total-Length: 9"))["1"]
    assert "digest" in problems(whole.replace(b"y" * 50, b"z" * 50))["2"]
    assert problems(b"".join(reversed(texts))) == {"1": None, "2": None}
    assert any(p and "length" in p for p in problems(whole[:-30]).values())
    assert problems(b"") == {}
    with pytest.raises(ValueError):
        warc.read_warc(spark, __file__)


def test_no_rows(spark, tmp_path):
    path = str(tmp_path / "none")
    warc.write_warc(pages_of(spark, [(1, "u", "x")]).limit(0), path)
    assert warc.resolved(warc.read_warc(spark, path)).count() == 0


@pytest.mark.parametrize("body", [b"", b"5\r\nabc\r\n0\r\n\r\n", b"3\r\nabc", b"3\r\nabc\r\n", b"g\r\n"])
def test_bad_framing(body):
    with pytest.raises(ValueError):
        warc.unchunked(body)
