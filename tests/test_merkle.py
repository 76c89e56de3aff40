"""A hash tree over files: what is hashed again, and proofs that a file is in it."""

import hashlib
import os
import time

import pytest

from sentrylake.operators.evidence import file_hashes
from sentrylake.operators.merkle import DIGITS, proof, update, verify, versions


def plain_root(records):
    """The root worked out from all files at once."""
    level = {}
    for path, sha256, size in records:
        key = hashlib.sha256(path.encode()).hexdigest()
        level.setdefault(key[:DIGITS], []).append((key, hashlib.sha256(f"{path}\n{sha256}\n{size}".encode()).hexdigest()))
    for length in range(DIGITS, -1, -1):
        done = {p: hashlib.sha256("".join(d for _, d in sorted(held)).encode()).hexdigest() for p, held in level.items()}
        if not length:
            return done.get("", hashlib.sha256().hexdigest())
        level = {}
        for p, digest in done.items():
            level.setdefault(p[:-1], []).append((p, digest))


def state(spark, tree):
    return versions(spark, tree).orderBy("version").collect()[-1]


def records(df):
    return sorted((r["path"], r["sha256"], r["size"]) for r in df.collect())


def test_a_changed_file_rehashes_its_path_only(spark, tmp_path):
    folder, tree = tmp_path / "files", str(tmp_path / "tree")
    (folder / "day=1").mkdir(parents=True)
    for n in range(60):
        (folder / ("day=1" if n % 2 else "") / f"{n}.txt").write_text(f"content {n}" if n else "")
    got = records(update(spark, str(folder), tree, "*.txt"))
    assert got == records(file_hashes(spark, str(folder), "*.txt"))
    first = state(spark, tree)
    assert first["root"] == plain_root(got) and (first["n_files"], first["n_hashed"]) == (60, 59)

    update(spark, str(folder), tree, "*.txt")
    again = state(spark, tree)
    assert again["root"] == first["root"] and (again["n_hashed"], again["n_nodes"]) == (0, 0)

    (folder / "7.txt").unlink(missing_ok=True)
    changed = folder / "day=1" / "9.txt"
    changed.write_text("other")
    os.utime(changed, (time.time() + 5, time.time() + 5))
    (folder / "new.txt").write_text("new")
    (folder / "10.txt").unlink()
    got = records(update(spark, str(folder), tree, "*.txt"))
    last = state(spark, tree)
    assert got == records(file_hashes(spark, str(folder), "*.txt")) and last["root"] == plain_root(got) != first["root"]
    assert last["n_hashed"] == 2 and last["n_nodes"] <= 3 * (DIGITS + 1)

    for path, sha256, size in got[:3] + [r for r in got if r[0].endswith("9.txt")]:
        steps = proof(spark, tree, path)
        assert verify(path, sha256, size, steps, last["root"])
        assert not verify(path, sha256, size + 1, steps, last["root"]) and not verify(path, sha256, size, steps, first["root"])
        assert not verify(path, sha256, size, [[d for d in step if d] for step in steps], last["root"])
    old = [r for r in got if r[0].endswith("/11.txt")][0]
    assert verify(*old, proof(spark, tree, old[0], version=1), first["root"])
    with pytest.raises(KeyError):
        proof(spark, tree, "file:/nowhere")


def test_an_empty_folder(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert update(spark, str(tmp_path / "none"), str(tmp_path / "tree")).count() == 0
    assert state(spark, str(tmp_path / "tree"))["root"] == hashlib.sha256().hexdigest()
    (tmp_path / "none" / "a").write_text("a")
    update(spark, str(tmp_path / "none"), str(tmp_path / "tree"))
    (tmp_path / "none" / "a").unlink()
    update(spark, str(tmp_path / "none"), str(tmp_path / "tree"))
    assert state(spark, str(tmp_path / "tree"))["root"] == hashlib.sha256().hexdigest()
