import glob
import zlib

from offerloom.llm import warc

from . import brute

SCHEMA = "page_id bigint, url string, html string"


def expected(rows):
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        first = min((p for p, _, h in rows if h == html and p is not None), default=None)
        again = len(body) >= 100 and first is not None and page != first
        out.append((page, len(body), brute.sha(body), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


def round_trip(spark, df, path, **more):
    warc.write_warc(df, path, **more)
    return sorted([tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in warc.read_pages(spark, path).collect()], key=repr)


def test_round_trip(spark, tmp_path):
    long, odd = "<p>é</p>" * 40, "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 5
    rows = [(5, "http://a/", long), (3, "http://b/", long), (9, None, long), (1, "u", None), (2, "u", ""), (4, "u v\r\nX: y", "short"), (6, "u", "short"), (7, "u", odd), (8, "u", odd), (10, "u", "\n" * 120), (11, "u", "x" * 99), (12, "u", "x" * 99), (None, "u", long), (3, "again", long), (13, "u", "🙂" * (3 << 18))]
    df = spark.createDataFrame(rows, SCHEMA)
    assert round_trip(spark, df, str(tmp_path / "one")) == expected(rows)
    assert round_trip(spark, df, str(tmp_path / "many"), file_bytes=300_000) == expected(rows)


def members(path):
    """The gzip members of a file, each decompressed by itself."""
    raw, out = open(path, "rb").read(), []
    while raw:
        one = zlib.decompressobj(31)
        out.append(one.decompress(raw).decode())
        raw = one.unused_data
    return out


def test_record_format(spark, tmp_path):
    rows = [(1, "http://a/", "x" * 150), (2, "http://b/", "x" * 150), (1, "http://a/", "x" * 150), (3, "http://c/", "é\r\n\r\n" * 9)]
    warc.write_warc(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "w"))
    files = glob.glob(f"{tmp_path}/w/*.warc.gz")
    found = [m for p in files for m in members(p)]
    assert len(glob.glob(f"{tmp_path}/w/*")) == len(files) and len(found) == len(files) + 4
    heads = [m.split("\r\n\r\n")[0] for m in found]
    field = lambda h, name: next((x.split(": ", 1)[1] for x in h.split("\r\n") if x.startswith(name + ": ")), None)
    assert len({field(h, "WARC-Record-ID") for h in heads}) == len(found)
    assert [field(h, "WARC-Type") for h in heads].count("warcinfo") == len(files)
    for m, h in zip(found, heads):
        assert m.startswith("WARC/1.1\r\n") and m.endswith("\r\n\r\n")
        block = m[len(h) + 4 : -4].encode()
        assert len(block) == int(field(h, "Content-Length"))
        if field(h, "WARC-Type") == "response":
            header, _, payload = block.partition(b"\r\n\r\n")
            assert header.startswith(b"HTTP/1.1 200 OK\r\n") and field(h, "WARC-Payload-Digest") == "sha256:" + brute.sha(payload)
    (revisit,) = [h for h in heads if field(h, "WARC-Type") == "revisit"]
    assert field(revisit, "WARC-Refers-To") in {field(h, "WARC-Record-ID") for h in heads if field(h, "WARC-Type") == "response"}
    assert field(revisit, "WARC-Profile").endswith("identical-payload-digest")


def test_hot_digest_and_many_ties(spark, tmp_path):
    rows = [(i, "u", "y" * 200 if i % 3 else f"z{i}" * 60) for i in range(900)]
    assert round_trip(spark, spark.createDataFrame(rows, SCHEMA).repartition(7), str(tmp_path / "w")) == expected(rows)


def test_empty_and_extra_columns(spark, tmp_path):
    assert round_trip(spark, spark.createDataFrame([], SCHEMA), str(tmp_path / "none")) == []
    wide = spark.createDataFrame([(1, "u", "h" * 100, 5, "k")], SCHEMA + ", refers_to int, payload string")
    assert round_trip(spark, wide, str(tmp_path / "wide")) == expected([(1, "u", "h" * 100)])
