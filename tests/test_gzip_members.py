"""Gzip files of many members: every member found once, whatever the ranges; damaged files are refused."""

import gzip
import random

import pytest

from lamina.checks import StrictModeError
from lamina.sources import gzip_members as g


def lines_of(df):
    return [r["value"] for r in df.orderBy("file", "member", "line").collect()]


def test_members_are_shared_out(spark, tmp_path):
    r = random.Random(1)
    # bytes that look like headers inside stored (not compressed) data
    lines = [f"{k},{'x' * r.randrange(200)}" for k in range(3000)] + ["\x1f\x08\x1f trap", ""]
    members = [lines[k:k + 60] for k in range(0, len(lines), 60)]
    data = b"".join(gzip.compress("".join(f"{v}\n" for v in own).encode(), r.choice([0, 6])) for own in members)
    stored = gzip.compress(g.MAGIC + b" inside\n" + g.MAGIC + b"\n", 0)
    (tmp_path / "a.gz").write_bytes(data + stored)
    want = lines + (g.MAGIC + b" inside\n" + g.MAGIC).decode("utf-8", "replace").split("\n")
    for chunk in (1 << 20, 5000):
        df = g.read_members(spark, str(tmp_path / "a.gz"), chunk)
        assert lines_of(df) == want
        assert df.select("member").distinct().count() == len(members) + 1
    assert len(g.MemberReader(str(tmp_path / "a.gz"), 5000).partitions()) > 10


def test_damaged_files(spark, tmp_path):
    one, two = gzip.compress(b"a\nb\n"), gzip.compress(b"c\nd")
    for name, data, fails in (("whole", one + two, False), ("cut", one + two[:-3], True), ("junk", one + b"junk" + two, True), ("inside", two + one, True), ("text", b"plain text", True)):
        path = tmp_path / name
        path.write_bytes(data)
        if fails:
            with pytest.raises(StrictModeError):
                g.read_members(spark, str(path))
        else:
            assert lines_of(g.read_members(spark, str(path))) == ["a", "b", "c", "d"]
