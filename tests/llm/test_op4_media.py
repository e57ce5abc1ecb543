import tarfile

from conftest import SMALL
from llm.conftest import rows_of

from signalloom.llm import media, shared

NAMES = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def test_edge_cases(spark, edge, edge_docs):
    found = media.attach(edge_docs, shared.scratch(spark, "media"))
    assert rows_of(found, *NAMES) == sorted(media.brute(edge), key=repr)


def test_whole_small_table(spark, real):
    assert rows_of(media.op4_media(spark, SMALL), *NAMES) == sorted(media.brute(real), key=repr)


def test_rows_carry_places_of_objects(spark, edge, edge_docs):
    folder = shared.scratch(spark, "media")
    rows = {r["doc_id"]: r for r in media.attach(edge_docs, folder).collect()}
    reader = media.ShardReader(folder)
    for d, t in edge:
        r = rows[d]
        assert media.from_png(reader.read(r["shard"], r["offset"], r["length"])) == media.payload_of(t)
        assert (r["width"], r["height"]) == (64, r["payload_bytes"] // 64)
    with tarfile.open(f"{folder}/{rows[6]['shard']}") as tar:  # any tar reader can open a shard
        assert all(m.name.endswith(".png") for m in tar.getmembers())


def test_equal_texts_share_one_object(spark, edge_docs):
    rows = [r for r in media.attach(edge_docs, shared.scratch(spark, "media")).collect() if r["doc_id"] in (6, 7, 40, 41)]
    assert len({(r["digest"], r["shard"], r["offset"]) for r in rows}) == 1


def test_empty_table(spark, empty_docs):
    assert media.attach(empty_docs, shared.scratch(spark, "media")).collect() == []
