import hashlib

import pytest
from pyspark.sql import functions as F

from orebed.codecs import cipher
from orebed.sources import archive, index_files, sinks

#: What a picture of 16 x 16 is guessed to take; the next entry is too far away to tell.
GUESS = 16 * 16 * 4 // 8 + 1024


def index(entries, mark=7):
    head = (16).to_bytes(4, "little") + bytes(4) + mark.to_bytes(2, "little") + bytes([0, 0, 4, 4, 9, 16]) + (1024).to_bytes(8, "little")
    return head + b"".join(key + n.to_bytes(4, "little") + at.to_bytes(4, "little") for key, n, at in entries)


def key(n):
    return n.to_bytes(9, "big")


@pytest.fixture()
def tree(tmp_path):
    """Two data files, of which the second is missing; a plain, an encrypted and a cut entry, and a picture at the end."""
    data = tmp_path / "Data" / "data"
    data.mkdir(parents=True)
    secret = bytes(range(16))
    body = cipher.salsa20(b"hidden words", secret, b"abcd".ljust(8, b"\0"))
    block = bytes([8]) + (77).to_bytes(8, "little") + bytes([4]) + b"abcd" + b"S" + body
    png = bytes.fromhex("89504E470D0A1A0A") + (13).to_bytes(4, "big") + b"IHDR" + (16).to_bytes(4, "big") * 2 + bytes(2000)
    parts = [b"plain content", block, b"\x05" + b"looks encrypted", png]
    (data / "data.000").write_bytes(b"".join(parts))
    (data / "data.xyz").write_bytes(b"no number")
    starts = [sum(map(len, parts[:i])) for i in range(4)]
    entries = [(key(i), 0, at) for i, at in enumerate(starts)] + [(key(9), 1, 0), (key(0), 0, starts[3]), (key(8), 0, 10**9)]
    (data / "0000000001.idx").write_bytes(index(entries))
    (data / "0100000001.idx").write_bytes(index([], mark=9))
    return tmp_path, parts, {77: secret}


def test_entries_by_key(spark, tree):
    root, parts, secrets = tree
    opened = archive.opened(spark, str(root))
    assert [r.error for r in opened.rejects.collect()] == ["mark 9, not 7"] and [tuple(r)[0] for r in opened.files.collect()] == [0]
    asked = spark.createDataFrame([(key(i),) for i in (0, 1, 2, 3, 8, 9, 55)], "key binary")
    read, rejects = archive.extracted(opened, asked, secrets)
    got = {int.from_bytes(r.key, "big"): (bytes(r.content), r.was_encrypted) for r in read.collect()}
    assert got == {0: (parts[0], False), 1: (b"hidden words", True), 2: (parts[2], False), 3: (parts[3][:GUESS], False), 8: (b"", False)}
    assert [(int.from_bytes(r.key, "big"), r.error) for r in rejects.collect()] == [(9, "no such data file")]
    raw, _ = archive.extracted(opened, asked)
    assert {int.from_bytes(r.key, "big"): bytes(r.content) for r in raw.collect()}[1] == parts[1]


def test_entries_by_name_and_samples(spark, tree):
    root, parts, _ = tree
    opened = archive.opened(spark, str(root))
    names = spark.createDataFrame([(f"file_000_00003_{key(3).hex()}.dat",), ("sprite_candidate_0001_00000000.dat",), (None,)], "name string")
    read, _ = archive.extracted_by_name(opened, names)
    assert [hashlib.sha256(r.content).hexdigest() for r in read.collect()] == [hashlib.sha256(parts[3][:GUESS]).hexdigest()]
    heads, _ = archive.sampled(opened, spark.createDataFrame([(key(3),), (key(0),)], "key binary"))
    assert {int.from_bytes(r.key, "big"): (len(r.content), r.is_png) for r in heads.collect()} == {3: (1024, True), 0: (1024, False)}


def test_sizes_of_last_entries_come_from_headers(spark, tree):
    root, parts, _ = tree
    opened = archive.opened(spark, str(root))
    sizes = {(r.data_file, r.offset): r["size"] for r in archive.sized(opened.entries, opened.files).collect()}
    assert sizes[0, 0] == len(parts[0]) and sizes[1, 0] == index_files.LEAST_SIZE and sizes[0, 10**9] == index_files.LEAST_SIZE
    png = sum(map(len, parts[:3]))
    assert sizes[0, png] == GUESS


def test_no_index_survives(spark, tmp_path):
    (tmp_path / "0000000001.idx").write_bytes(b"short")
    with pytest.raises(ValueError, match="no readable index"):
        archive.opened(spark, str(tmp_path))


def test_backups_survive_a_second_run_of_a_task(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"original")
    import os

    os.utime(tmp_path / "a", (1, 1))
    rows = spark.createDataFrame([("a", b"new")], "path string, content binary")
    write = sinks.write_files(rows, str(tmp_path), "Backup")
    for _ in range(2):
        write.agg(F.count("written")).collect()
    assert (tmp_path / "a.bak").read_bytes() == b"original" and (tmp_path / "a").read_bytes() == b"new"
