"""Commands over an archive, from a folder and back."""

import os

import pytest

from cairn import cli


def files(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in folder.rglob("*") if p.is_file() and not p.is_symlink()}


def test_commands(spark, tmp_path):
    src, box, out = tmp_path / "src", str(tmp_path / "box"), tmp_path / "out"
    (src / "d" / "deep").mkdir(parents=True)
    (src / "d" / "a.txt").write_bytes(b"A" * 5000)
    (src / "d" / "deep" / "b.bin").write_bytes(bytes(range(256)))
    (src / "empty").write_bytes(b"")
    os.symlink("d/a.txt", src / "link")
    said = []

    def run(*args):
        said.clear()
        return cli.run(spark, list(args), said.append)

    assert run("add", box, str(src), "--block", "1K") == 0
    assert run("test", box) == 0
    assert run("list", box) == 0
    assert [line.split()[-1] for line in said] == ["src/d", "src/d/a.txt", "src/d/deep", "src/d/deep/b.bin", "src/empty", "src/link"]
    assert said[5].startswith("symlink")
    assert run("extract", box, str(out)) == 0
    assert files(out / "src") == files(src)
    assert run("extract", box, str(out)) == 1
    assert run("extract", box, str(out), "src/empty", "--overwrite", "skip") == 0

    (src / "d" / "a.txt").unlink()
    (src / "new").write_bytes(b"N")
    assert run("sync", box, str(src)) == 0
    assert run("move", box, "src/d/deep", "src/moved") == 0
    assert run("delete", box, "src/empty") == 0
    assert run("delete", box, "src/none") == 1
    assert run("repack", box) == 0
    assert run("list", box) == 0
    assert [line.split()[-1] for line in said] == ["src/d", "src/link", "src/moved", "src/moved/b.bin", "src/new"]
    assert run("comment", box, "hello") == 0
    assert run("lock", box) == 0
    assert run("delete", box, "src/new") == 1
    assert "locked" in said[0]


def test_wrong_usage_and_missing_archive(spark, tmp_path):
    with pytest.raises(SystemExit) as e:
        cli.run(spark, ["add", "box"])
    assert e.value.code == 2
    assert cli.run(spark, ["list", str(tmp_path / "none")], lambda _: None) == 1
    assert cli.run(spark, ["add", str(tmp_path / "b"), str(tmp_path), "--block", "big"], lambda _: None) == 1
