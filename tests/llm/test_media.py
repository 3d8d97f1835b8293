import glob
import hashlib
import zlib

import pytest

from kelpline.llm import media


@pytest.mark.parametrize("text", [None, "", "a", "x" * 63, "x" * 64, "é" * 33, "\x00\x01\n", "long " * 300_000])
def test_png_round_trip(text):
    n, payload = media.payload_of(text)
    assert n == len((text or "").encode()) and len(payload) % 64 == 0 and payload
    stored = media.encode_png(payload)
    assert media.decode_png(stored) == payload
    with pytest.raises(ValueError):
        media.decode_png(stored[:-30] + b"\x00" + stored[-29:])


def test_a_standard_reader_would_see_a_png():
    stored = media.encode_png(b"\x01" * 128)
    assert stored.startswith(b"\x89PNG\r\n\x1a\n") and stored[12:16] == b"IHDR" and stored.endswith(b"IEND\xaeB`\x82")


def test_round_trip_of_odd_rows(documents, odd_rows):
    out = media.round_trip(documents(odd_rows)).toPandas()
    assert len(out) == len(odd_rows)
    want = []
    for i, t, _ in odd_rows:
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        want.append((-1 if i is None else i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    got = [(-1 if i != i else int(i), *rest) for i, *rest in out[["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32"]].itertuples(index=False)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert out.groupby("payload_sha256")[["media_sha256", "feature", "media_bytes"]].nunique().max().max() == 1


def test_empty(documents):
    assert media.round_trip(documents([])).count() == 0


def test_ranges_cover_each_member_once(spark, documents, tmp_path):
    folder = f"file://{tmp_path}/arc"
    media.write_archives(documents([(i, f"text {i} " * (i % 50 + 1), "s") for i in range(300)]).coalesce(2), folder, most_bytes=4000)
    assert len(glob.glob(f"{tmp_path}/arc/*.arc")) > 3
    for size in (100, 777, 1 << 20):
        back = media.read_archives(spark, folder, rangebytes=size, batchbytes=500)
        assert sorted(r["doc_id"] for r in back.select("doc_id").collect()) == list(range(300))


def test_files_outside_the_manifest_are_not_read(spark, documents, tmp_path):
    folder = f"file://{tmp_path}/arc"
    media.write_archives(documents([(1, "a", "s")]), folder)
    stray = media.ArchiveWriter(folder)
    stray.add(2, 1, b"left by a lost task")
    stray.close()
    assert [r["doc_id"] for r in media.read_archives(spark, folder).collect()] == [1]


def test_members_are_retried_one_by_one():
    good = media._MEMBER.pack(media._MARK, False, 7, 1, 3, zlib.crc32(b"abc")) + b"abc"
    calls = []

    class Flaky:
        def read_at(self, n, at):
            calls.append(at)
            if len(calls) < 3:
                raise OSError("lost")
            return good[:n]

    assert media.read_member(lambda again: Flaky(), 5, len(good), pause=0) == (7, 1, b"abc") and calls == [5, 5, 5]
    with pytest.raises(ValueError):
        media.read_member(lambda again: type("Bad", (), {"read_at": lambda self, n, at: good[:-1] + b"x"})(), 0, len(good), tries=2, pause=0)
