"""The file reader: which files it opens, what it makes of them."""

from __future__ import annotations

import os

import pytest

from fleetscope.sources import files as file_source


def tree(root, files):
    for name, content in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content if isinstance(content, bytes) else content.encode())


FILES = {
    "one/src/a.py": "x", "one/node_modules/y.js": "y", "one/logo.PNG": "p", "one/.gitignore": "*.log\n# note\nout/\n", "one/run.log": "l", "one/out/z.txt": "z",
    "one/sub/out/w.txt": "w", "one/odd name+%41.txt": "odd", "two/run.log": "kept", "two/blob.txt": b"a\x00b", "two/bad.txt": b"\xff caf\xc3\xa9 \xef\xbf\xbd\xc3",
    "two/good.txt": "genuine � here", "three/.cursorignore": "secret.txt\n", "three/secret.txt": "s", "three/open.txt": "o", "three/dist/k.txt": "k", "three/x.pyc": b"\x00",
}
OPENED = {
    "one/src/a.py": "x", "one/.gitignore": FILES["one/.gitignore"], "one/odd name+%41.txt": "odd", "two/run.log": "kept", "two/blob.txt": None, "two/bad.txt": " café �",
    "two/good.txt": "genuine � here", "three/.cursorignore": "secret.txt\n", "three/open.txt": "o",
}


def unread(root):
    """Puts the times of last access far back, and says which files were read since."""
    files = {str(p.relative_to(root)): p for p in root.rglob("*") if p.is_file()}
    for p in files.values():
        os.utime(p, (1000, 2000))
    return lambda: {name for name, p in files.items() if p.stat().st_atime > 1000}


@pytest.mark.parametrize("task_bytes", [1 << 28, 3])
def test_only_files_that_stay_are_opened(spark, tmp_path, task_bytes):
    tree(tmp_path, FILES)
    (tmp_path / "one" / "loop").symlink_to(tmp_path / "one")
    (tmp_path / "stray.txt").write_text("no repository")
    for root in (str(tmp_path), f"file:{tmp_path}/", f"file://{tmp_path}"):
        read = unread(tmp_path)
        got = {f"{r.repo}/{r.path}": r for r in file_source.read_files(spark, root, task_bytes=task_bytes).collect()}
        assert set(got) == set(FILES) - {"one/node_modules/y.js", "three/dist/k.txt"}
        assert {name: r.content for name, r in got.items() if r.content is not None or name in OPENED} == OPENED
        assert {name for name, r in got.items() if r.is_binary} == {"one/logo.PNG", "two/blob.txt", "three/x.pyc"}
        assert all(r.size == len(FILES[name] if isinstance(FILES[name], bytes) else FILES[name].encode()) and r.mtime.year == 1970 for name, r in got.items())
        assert read() == set(OPENED)
    plain = {f"{r.repo}/{r.path}" for r in file_source.read_files(spark, str(tmp_path), own_rules=False).filter("content IS NOT NULL").collect()}
    assert plain == {*OPENED, "one/run.log", "one/out/z.txt", "one/sub/out/w.txt", "three/secret.txt"} - {"two/blob.txt"}


def test_listing_opens_nothing(spark, tmp_path):
    tree(tmp_path, {**FILES, "two/static/vendor/lib.js": "v", "two/static/own.js": "o", "two/__init__.py": "i", "two/_x/.y": ""})
    read = unread(tmp_path)
    listed = {f"{r.repo}/{r.path}" for r in file_source.list_files(spark, str(tmp_path)).collect()}
    assert listed == {*FILES, "two/static/own.js", "two/__init__.py", "two/_x/.y"} - {"one/node_modules/y.js", "three/dist/k.txt"}
    assert read() == set()
    (tmp_path / "none").mkdir()
    assert file_source.read_files(spark, str(tmp_path / "none")).count() == 0
