import random

import pytest
import zstandard

from twinvec.llm import warc as W

SCHEMA = "page_id long, url string, html string, digest string, first string, salt string, n string, frame string, value string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h) + ("x",) * 6 for i, u, h in rows], SCHEMA)


def brute(rows, min_bytes=0):
    out, first = [], {}
    for i, _, h in rows:
        b = (h or "").encode()
        if i is not None and len(b) >= min_bytes:
            first[b] = min(i, first.get(b, i))
    for i, u, h in rows:
        b = (h or "").encode()
        again = i is not None and b in first and first[b] != i
        out.append((i, len(b), W.base32_sha1(b), "revisit" if again else "response", first[b] if again else None))
    return sorted(out, key=str)


def some_pages(n=400):
    r = random.Random(5)
    rows = [(i, f"http://h{i % 7}.example/{i}", f"<html><p>{' '.join(r.choice(['ä', 'bc', 'def', '\r\n\r\n']) for _ in range(r.randrange(60)))}</p>")
            for i in range(n)]
    rows += [(1000 + i, None, "same payload" * 20) for i in range(300)] + [(2000, "http://a b\r\nX: y", None), (2001, "", "")]
    return rows + [(None, "http://none", "same payload" * 20), rows[3], rows[3], (1, "u", "P*M\x18\0\0\0\0 WARC/1.1 \r\n\r\n" * 3), (3000, "u", "long " * 400_000)]


@pytest.mark.parametrize("min_bytes", [0, 100])
def test_round_trip(spark, tmp_path, min_bytes):
    rows = some_pages()
    W.write(pages(spark, rows), f"{tmp_path}/a", min_bytes)
    back = W.read(spark, f"{tmp_path}/a")
    assert back.where("problem is not null").count() == 0
    assert sorted((tuple(x) for x in W.page_rows(back).collect()), key=str) == brute(rows, min_bytes)
    got = {(x["record_id"], bytes(x["payload"])) for x in back.where("record_type = 'response'").collect()}
    want = {(f"<urn:x-page:{'none' if i is None else i}>", (h or "").encode())
            for (i, _, h) in rows if ("response", i, W.base32_sha1((h or "").encode())) in {(x[3], x[0], x[2]) for x in brute(rows, min_bytes)}}
    assert got == want
    uris = dict(x for x in back.select("record_id", "uri").collect())
    assert uris["<urn:x-page:2000>"] == "http://a%20b%0D%0AX:%20y" and uris["<urn:x-page:1000>"] is None


def test_dictionary_leads_every_archive_and_each_record_is_a_frame(spark, tmp_path):
    W.write(pages(spark, some_pages()).repartition(3), f"{tmp_path}/a")
    found = 0
    for f in tmp_path.glob("a/part-*"):
        data = memoryview(f.read_bytes())
        if not len(data):
            continue
        kinds = [m for _, _, m in W.frames(data)]
        assert kinds[0] == W.DICTIONARY_MAGIC and W.DICTIONARY_MAGIC not in kinds[1:]
        plain = zstandard.ZstdDecompressor()
        with pytest.raises(zstandard.ZstdError):  # needs the dictionary
            for a, b, m in W.frames(data):
                if m == W.FRAME_MAGIC:
                    plain.decompress(data[a:b])
        found += kinds.count(W.FRAME_MAGIC) - 1
    assert found == len(some_pages())


def test_no_pages(spark, tmp_path):
    W.write(pages(spark, []), f"{tmp_path}/a")
    assert W.read(spark, f"{tmp_path}/a").count() == 0


def archive(path, records, dictionary=None, squeeze=True, sizes=True):
    own = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    c = zstandard.ZstdCompressor(dict_data=own, write_content_size=sizes)
    head = b""
    if dictionary:
        body = zstandard.compress(dictionary) if squeeze else dictionary
        head = W.DICTIONARY_MAGIC.to_bytes(4, "little") + len(body).to_bytes(4, "little") + body
    path.write_bytes(head + b"".join(c.compress(r) for r in records))


GOOD = W.page_record(7, "http://a", b"payload", W.base32_sha1(b"payload"), None)


@pytest.mark.parametrize("squeeze", [True, False])
def test_archives_of_other_writers(spark, tmp_path, squeeze):
    texts = [f"page {i} of many pages with number {i * i}".encode() * 3 for i in range(500)]
    d = zstandard.train_dictionary(2000, texts).as_bytes()
    records = [W.page_record(i, "u", t, W.base32_sha1(t), None) for i, t in enumerate(texts)]
    archive(tmp_path / "with.warc.zst", records, d, squeeze)
    archive(tmp_path / "without.warc.zst", [GOOD], sizes=False)
    got = W.read(spark, str(tmp_path)).collect()
    assert all(x["problem"] is None for x in got) and len(got) == 501
    assert {bytes(x["payload"]) for x in got} == {*texts, b"payload"}


def test_problems_are_told(spark, tmp_path):
    bad = {
        "length": GOOD.replace(b"payload\r\n\r\n", b"payloa\r\n\r\n"), "digest": GOOD.replace(b"payload\r\n\r\n", b"paylaod\r\n\r\n"),
        "header": GOOD.replace(b"WARC-Date", b"WARC Date"), "header: no version": GOOD[5:], "header: no warc-type": GOOD.replace(b"WARC-Type: response\r\n", b""),
        "length: not": GOOD.replace(b"Content-Length: ", b"Content-Length: x", 1), "http": GOOD.replace(b"HTTP/1.1", b"HTTQ/1.1"),
        "header: content-length twice": GOOD.replace(b"Content-Type: app", b"Content-Length: 3\r\nContent-Type: app"), "length: the block": GOOD + GOOD,
    }
    archive(tmp_path / "bad.warc.zst", [*bad.values(), GOOD])
    got = [x["problem"] for x in W.read(spark, str(tmp_path)).orderBy("offset").collect()]
    assert got[-1] is None and all(x.startswith(k) for k, x in zip(bad, got)), got
    with pytest.raises(Exception, match="length"):
        W.page_rows(W.read(spark, str(tmp_path))).collect()


def test_cut_and_damaged_files(tmp_path):
    archive(tmp_path / "a", [GOOD, GOOD, GOOD])
    data = (tmp_path / "a").read_bytes()
    one = len(data) // 3
    assert [p for _, _, p in W.archive_records(memoryview(data))] == [None] * 3
    for cut in range(1, 3 * one):
        got = list(W.archive_records(memoryview(data[:cut])))
        assert [p is None for _, _, p in got] == [True] * (cut // one) + [False] * (cut % one > 0)
    r = random.Random(1)
    for _ in range(300):
        x = bytearray(data)
        x[r.randrange(len(x))] ^= 1 << r.randrange(8)
        for _, whole, p in W.archive_records(memoryview(bytes(x))):
            assert (whole is None) == (p is not None)
    big = zstandard.ZstdCompressor().compress(b"0" * 5000)
    assert [p for _, _, p in W.archive_records(memoryview(big), most_bytes=4999)] == ["frame: announces too many bytes"]
