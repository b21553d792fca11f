"""Text sources: listing in Spark, odd names, ranges of diff files."""

import os
import random

import pytest
from pyspark.sql import functions as F

from quarry.operators.diffs import create_chunks, read_chunks, split_files, write_chunks
from quarry.sources.text import list_files, read_diffs, read_patches, read_text_dir, write_text_files


def put(root, rel, data=b"x = 1\n"):
    path = os.path.join(root, rel)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def test_no_file_is_lost_to_its_name_or_folder(spark, tmp_path):
    names = ["a.py", "_a.py", ".a.py", "__init__.py", "_private/b.py", ".github/c.py", "pkg/_inner/d.py", "pkg/.x/_y/e.sql",
             "with space/f g.py", "per%20cent/%25.py", "ü/日本.py", "plus+/and#hash.py", "q?/star*.py", "br[a]c{k}.sql", "deep/" * 20 + "z.py"]
    for n in names:
        put(str(tmp_path), n, n.encode())
    put(str(tmp_path), "_private/empty.py", b"")
    put(str(tmp_path), "pkg/note.md")
    put(str(tmp_path), "bad/bad.py", b"f\xff\x00\xfe")
    got = {r.path[len(f"file:{tmp_path}/"):]: r for r in read_text_dir(spark, str(tmp_path), recursive=True).collect()}
    assert sorted(got) == sorted([*names, "_private/empty.py", "bad/bad.py"])
    assert all(got[n].text == n and got[n].read_error is None and got[n].file_name == n.rsplit("/", 1)[-1] for n in names)
    assert got["_private/empty.py"].text == "" and got["bad/bad.py"].text is None and got["bad/bad.py"].read_error
    flat = read_text_dir(spark, str(tmp_path)).collect()
    assert sorted(r.file_name for r in flat) == sorted(n for n in names if "/" not in n)


def test_empty_and_missing_folders(spark, tmp_path):
    os.makedirs(tmp_path / "none" / "below")
    assert read_text_dir(spark, str(tmp_path / "none"), recursive=True).count() == 0
    with pytest.raises(Exception, match="(?i)not.*exist|no such|cannot"):
        read_text_dir(spark, str(tmp_path / "missing")).collect()


def test_many_files_without_a_driver_list(spark, tmp_path):
    """20,000 files in 41 folders are listed by tasks; the driver sees the
    number of folders of a level and no name."""
    for k in range(20_000):
        folder = tmp_path / f"d{k % 40}"
        if k < 40:
            folder.mkdir()
        (folder / f"_{k}.py").touch() if k % 2 else (folder / f"{k}.md").touch()
    listed = list_files(spark, str(tmp_path), (".py", ".md"), recursive=True)
    assert listed.agg(F.count("*"), F.count_distinct("rel")).first()[:] == (20_000, 20_000)
    assert list_files(spark, str(tmp_path), (".py",), recursive=True).count() == 10_000


def test_a_file_that_cannot_be_opened_is_a_row(spark, tmp_path):
    put(str(tmp_path), "good.py")
    os.symlink(tmp_path / "nowhere", tmp_path / "broken.py")
    got = {r.file_name: r for r in read_text_dir(spark, str(tmp_path)).collect()}
    assert got["good.py"].text == "x = 1\n"
    assert "broken.py" not in got or got["broken.py"].read_error


def random_diff(rng, files):
    out = rng.choice(["", "From: someone\n\n", "\n"])
    for k in range(files):
        name = rng.choice([f"f{k}.py", f"a b{k}.py", f"g{k}.sql", f"h{k}.md"])
        tab = "\t" if " " in name else ""
        out += f"diff --git a/{name} b/{name}\n--- a/{name}{tab}\n+++ b/{name}{tab}\n"
        for i in range(rng.randrange(5)):
            out += f"@@ -{i + 1} +{i + 1} @@ {rng.choice(['', 'def f():'])}\n-{'o ' * rng.randrange(20)}\n+{'n ' * rng.randrange(20)}\n"
    return out


def test_records_of_ranges_are_the_file(spark, tmp_path):
    rng = random.Random(4)
    texts = {f"d{k}.diff": random_diff(rng, rng.randrange(1, 30)) for k in range(12)}
    texts["one.diff"] = "no patch here\n"
    texts["_hidden.diff"] = random_diff(rng, 3)
    for n, t in texts.items():
        put(str(tmp_path), n, t.encode())
    put(str(tmp_path), "empty.diff", b"")
    for range_bytes, block in ((1, 1), (7, 3), (100, 16), (1 << 20, 4 << 20)):
        if range_bytes == 1:                        # each byte a range: only the short files
            continue
        rows = read_patches(spark, str(tmp_path), range_bytes=range_bytes, block=block).collect()
        assert len({(r.diff_id, r.pos) for r in rows}) == len(rows)
        for n, t in texts.items():
            mine = sorted((r.pos, r.text) for r in rows if r.diff_id == n)
            assert "".join(x for _, x in mine) == t
            assert all(x.startswith("diff --git ") for p, x in mine if p)
            assert [p for p, _ in mine] == [len(t[:0]) + sum(len(x.encode()) for _, x in mine[:i]) for i in range(len(mine))]


def test_same_chunks_from_rows_and_records(spark, tmp_path):
    rng = random.Random(5)
    for k in range(20):
        put(str(tmp_path), f"d{k}.diff", random_diff(rng, rng.randrange(1, 25)).encode())
    for budget in (30, 200):
        whole = create_chunks(read_diffs(spark, str(tmp_path)), budget)
        parts = create_chunks(read_patches(spark, str(tmp_path), range_bytes=256, block=64), budget)
        assert whole.columns == parts.columns
        assert whole.exceptAll(parts).count() == 0 and parts.exceptAll(whole).count() == 0
        assert whole.count() > 20


def test_every_patch_of_a_file_comes_out(spark, tmp_path):
    """Files in = files out, whatever their names."""
    names = ["a.py", "b c.py", "tab\there.py", 'quo"te.py', "ü.py", "back\\slash.py", "x y z.sql", " lead.py", "日本 語.sql"]

    def quoted(n):
        if any(c in n for c in '\t"\\') or not n.isascii():
            body = "".join({"\t": "\\t", '"': '\\"', "\\": "\\\\"}.get(c, c) if c.isascii() else
                           "".join(f"\\{b:03o}" for b in c.encode()) for c in n)
            return lambda s: f'"{s}/{body}"'
        return lambda s: f"{s}/{n}"

    text = ""
    for n in names:
        q, tab = quoted(n), "\t" if " " in n and not quoted(n)("a").startswith('"') else ""
        text += f"diff --git {q('a')} {q('b')}\n--- {q('a')}{tab}\n+++ {q('b')}{tab}\n@@ -1 +1 @@\n-a\n+b\n"
        text += f"diff --git {q('a')} {q('b')}\nold mode 100644\nnew mode 100755\n"
    df = spark.createDataFrame([("d", text)], "diff_id string, text string")
    got = [r.path for r in split_files(df).orderBy("file_idx").collect()]
    assert got == [n for n in names for _ in range(2)]
    chunks = create_chunks(df, budget=20)
    assert {r.path for r in chunks.collect()} == set(names)


def patches(spark, text):
    rows = split_files(spark.createDataFrame([("d", text)], "diff_id string, text string")).orderBy("file_idx").collect()
    return [(r.path, r.header, list(r.patch_hunks)) for r in rows]


def test_counts_decide_where_a_hunk_ends(spark):
    first = "diff --git a/a.py b/a.py\n--- a/a.py\n+++ b/a.py\n"
    like = "@@ -1 +1 @@\n--- a/no.py\n+++ b/no.py\n"
    more = "@@ -9,2 +9,2 @@\n c\n-x\n+y\n\\ No newline at end of file\n"
    mail = "-- \n2.40\n\nFrom abc\nSubject: next\n\n"
    plain = "--- p/q.py\t2024\n+++ p/q.py\t2024\n"
    tail = "@@ -1 +1 @@\n-a\n+b\n"
    assert patches(spark, first + like + more + mail + first + more + plain + tail + tail) == [
        ("a.py", first, [like, more]), ("a.py", first, [more]), ("p/q.py", plain, [tail, tail])]
    svn = "Index: s.py\n" + "=" * 20 + "\n--- s.py\t(rev 1)\n+++ s.py\t(rev 2)\n"
    assert patches(spark, "preamble\n" + svn + tail + svn + like) == [("s.py", svn, [tail]), ("s.py", svn, [like])]


def test_wrong_counts_lose_nothing(spark):
    first = "diff --git a/a.py b/a.py\n--- a/a.py\n+++ b/a.py\n"
    for hunk in ("@@ -1 +1 @@\n-a\n+b\n+more than said\n+even more\n", "@@ -1,9 +1,9 @@\n-fewer\n", "@@ -1,2 +1,2 @@\nodd\n-a\n+b\n"):
        assert patches(spark, first + hunk + first + hunk) == [("a.py", first, [hunk])] * 2


def test_old_and_new_names(spark):
    text = ("diff --git a/x y.py b/x z.py\nsimilarity index 100%\nrename from x y.py\nrename to x z.py\n"
            "diff --git a/n.py b/n.py\nnew file mode 100644\nindex 0000000..e69de29\n"
            "diff --git a/e f.py b/e f.py\nBinary files a/e f.py and b/e f.py differ\n"
            "diff --cc m.py\nindex 1,2..3\n--- a/m.py\n+++ b/m.py\n@@@ -1,1 -1,1 +1,1 @@@ def g():\n- a\n -b\n++c\n"
            "diff --git o/p.py o/p.py\nold mode 1\nnew mode 2\n")
    df = spark.createDataFrame([("d", text)], "diff_id string, text string")
    got = [(r.old_path, r.path) for r in split_files(df).orderBy("file_idx").collect()]
    assert got == [("x y.py", "x z.py"), ("n.py", "n.py"), ("e f.py", "e f.py"), ("m.py", "m.py"), ("p.py", "p.py")]


def test_written_chunks_of_one_diff(spark, tmp_path):
    rng = random.Random(6)
    df = spark.createDataFrame([(f"d{k}", random_diff(rng, 6)) for k in range(40)], "diff_id string, text string")
    chunks = create_chunks(df, 20)
    write_chunks(chunks, str(tmp_path / "out"))
    back = read_chunks(spark, str(tmp_path / "out"))
    assert back.exceptAll(chunks).count() == 0 and back.count() == chunks.count()
    one = read_chunks(spark, str(tmp_path / "out"), "d7")
    assert one.count() == chunks.filter("diff_id = 'd7'").count()
    assert "EqualTo(diff_id,d7)" in one._jdf.queryExecution().executedPlan().toString()


def test_text_round_trip(spark, tmp_path):
    rows = [("a/ü .py", "text é"), ("b.py", ""), ("c/d/e.sql", None)]
    df = spark.createDataFrame(rows, "path string, text string")
    assert write_text_files(df, str(tmp_path)).agg(F.sum("bytes")).first()[0] == 7
    got = {r.path.rsplit(f"{tmp_path}/", 1)[1]: r.text for r in read_text_dir(spark, str(tmp_path), recursive=True).collect()}
    assert got == {"a/ü .py": "text é", "b.py": "", "c/d/e.sql": ""}
