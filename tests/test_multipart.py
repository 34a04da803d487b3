"""Multipart bodies by byte ranges and as a stream."""

import os
import random
import tempfile

from attestor.sources import multipart
from attestor.sources.multipart import Multipart, MultipartReader, part_rows


def body(parts, boundary=b"b-1", line=b"\r\n"):
    out = b""
    for name, file_name, content in parts:
        named = b'; filename="' + file_name.encode() + b'"' if file_name is not None else b""
        out += b"--" + boundary + line + b'Content-Disposition: form-data; name="' + name.encode() + b'"' + named + line + b"content-type: text/plain" + line + line + content + line
    return out + b"--" + boundary + b"--" + line


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_every_part_is_in_one_range_whatever_the_ranges():
    r = random.Random(0)
    parts = [("f", f"dir/n{i}.txt", bytes(r.choices(b"ab-\r\n1", k=r.randint(0, 60)))) for i in range(12)] + [("field", None, b"x"), ("f", "last.txt", b"--b-1x\r\n --b-1--")]
    for line in (b"\r\n", b"\n"):
        own = [(f, n, c if line == b"\r\n" else c.replace(b"\r", b"r")) for f, n, c in parts]  # with bare line ends, a \r before one belongs to it
        want, raw = [(n.rpartition("/")[2], c) for _, n, c in own if n is not None], body(own, line=line)
        path = folder() + "/body"
        with open(path, "wb") as f:
            f.write(raw)
        for split in (1, 2, 7, 50, 333, len(raw)):
            rows = [row for at in range(0, len(raw), split) for row in part_rows(path, b"b-1", at, min(at + split, len(raw)))]
            assert [(x[3], x[5]) for x in rows] == want and all(raw[x[1] :].startswith(b"--b-1") for x in rows)


def test_bodies_are_read_in_batch_and_as_they_arrive(spark):
    spark.dataSource.register(Multipart)
    root = folder()
    os.mkdir(f"{root}/in")

    def arrive(name, raw):
        with open(f"{root}/in/{name}", "wb") as f:
            f.write(raw)

    arrive("1", body([("f", "a.txt", b"one"), ("f", "C:\\x\\b.md", b"")]))
    arrive("2", b"no multipart body")
    arrive("3", b"--b-1\r\nContent-Disposition: form-data; name=f; filename=cut.txt\r\n\r\nnever ends")
    arrive("4", b"")
    rows = spark.read.format("multipart").option("split", 10).load(f"file://{root}/in").collect()
    assert sorted((r["file_name"], bytes(r["content"]), r["content_type"], r["length"]) for r in rows) == [("a.txt", b"one", "text/plain", 3), ("b.md", b"", "text/plain", 0)]

    def run():
        q = spark.readStream.format("multipart").load(f"file://{root}/in").select("file_name", "length").writeStream.format("parquet").option("path", f"file://{root}/out").option("checkpointLocation", f"file://{root}/c").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return sorted(r["file_name"] for r in spark.read.parquet(f"file://{root}/out").collect())

    assert run() == ["a.txt", "b.md"]
    arrive("5", body([("f", "later.txt", b"two")]))
    assert run() == ["a.txt", "b.md", "later.txt"]


def test_tasks_grow_with_the_bytes_and_not_with_the_ranges(spark):
    r, root = random.Random(1), folder()
    files = [[("f", f"{i}-{j}.bin", r.randbytes(r.randint(0, 9000))) for j in range(40)] for i in range(12)]
    for i, parts in enumerate(files):
        with open(f"{root}/{i}", "wb") as f:
            f.write(body(parts))
    size = sum(os.path.getsize(f"{root}/{i}") for i in range(12))
    held = MultipartReader({"path": root, "split": "100"}).partitions()
    assert len(held) <= 2 + (size + 12 * multipart.OPENED) // multipart.TASK
    spark.dataSource.register(Multipart)
    rows = spark.read.format("multipart").option("split", 100).load(f"file://{root}").select("file_name", "content").collect()
    assert sorted((x[0], bytes(x[1])) for x in rows) == sorted((n, c) for parts in files for _, n, c in parts)


def test_large_bodies_are_dealt_to_tasks_at_the_edges_of_ranges(monkeypatch):
    monkeypatch.setattr(multipart, "TASK", 1000)
    for sizes in ([0], [5], [2500, 0, 10, 999], [multipart.OPENED] * 3):
        for split in (7, 300, 1000, 1_000_000):
            held = [x for task in multipart.tasks([(str(i), n) for i, n in enumerate(sizes)], split) for x in task.stretches]
            for i, n in enumerate(sizes):
                own = [x[1:] for x in held if x[0] == str(i)]
                assert [b for b, _ in own] + [n] * (n > 0) == [0] * (n > 0) + [e for _, e in own] and all(b % split == 0 for b, _ in own)


def test_ranges_inside_a_part_read_no_farther_than_their_end(monkeypatch):
    path, asked = folder() + "/body", []
    with open(path, "wb") as f:
        f.write(body([("f", "large.bin", bytes(1_000_000)), ("f", "small.bin", b"x")]))
    monkeypatch.setattr(multipart, "BLOCK", 100)

    class File:
        def __init__(self, file):
            self.file = file

        def size(self):
            return self.file.size()

        def close(self):
            self.file.close()

        def read_at(self, n, at):
            asked.append(at + n)
            return self.file.read_at(n, at)

    class System:
        def __init__(self, system):
            self.system = system

        def open_input_file(self, inside):
            return File(self.system.open_input_file(inside))

    found = multipart.filesystem
    monkeypatch.setattr(multipart, "filesystem", lambda p: (System(found(p)[0]), found(p)[1]))
    assert list(part_rows(path, b"b-1", 1000, 2000)) == [] and max(asked) < 3000
    assert [x[3] for x in part_rows(path, b"b-1", 0, 1_000_100, 1000)] == ["large.bin"]


def test_boundaries_are_found_wherever_reading_pauses(monkeypatch):
    r = random.Random(2)
    path = folder() + "/body"
    for line in (b"\r\n", b"\n"):
        parts = [("f", f"n{i}", bytes(r.choices(b"ab-\r1 " if line == b"\n" else b"ab-\r\n1 ", k=r.randint(0, 40))) + b"x") for i in range(8)]
        raw = body(parts, line=line).replace(b"--b-1" + line, b"--b-1  \t  " + line)
        with open(path, "wb") as f:
            f.write(raw)
        for block in range(1, 40):
            monkeypatch.setattr(multipart, "BLOCK", block)
            for split in (1, 9, 64, len(raw)):
                assert [(x[3], x[5]) for x in part_rows(path, b"b-1", 0, len(raw), split)] == [(n, c) for _, n, c in parts]
