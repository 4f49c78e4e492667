import os
import tempfile

from docweave.sources.directory import scan_directory


def make_tree():
    root = tempfile.mkdtemp(prefix="dw-tree-")
    files = {"a/__init__.py": b"", "a/x.py": b"print(1)\n", ".hid/y": b"y", ".env": b"K=V\n", "_und/z.md": b"# z\n",
             "a/b/empty.txt": b"", "a/b/bin.dat": b"ab\x00cd", "n/.docstate.nu": b"{}", "n/deep/.DOCS.NUON": b"{}"}
    for p, b in files.items():
        full = os.path.join(root, p)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "wb") as fh:
            fh.write(b)
    os.symlink(os.path.join(root, "a"), os.path.join(root, "link"))
    return root, files


def test_scan_returns_every_regular_file(spark):
    root, files = make_tree()
    df = scan_directory(spark, root=root, project="p")
    got = {r["path"]: r for r in df.collect()}
    assert set(got) == set(files)                       # hidden, underscore and empty files kept; symlink not followed
    assert got["a/b/empty.txt"]["size"] == 0
    import hashlib
    assert got["a/x.py"]["content_hash"] == hashlib.sha256(b"print(1)\n").hexdigest()
    assert bytes(got["a/b/bin.dat"]["head"]) == b"ab\x00cd"


def test_scan_keeps_whole_files(spark, tmp_path):
    body = b"line of text\n" * 200_000
    (tmp_path / "long.txt").write_bytes(body)
    assert bytes(scan_directory(spark, root=str(tmp_path), project="p").first()["head"]) == body
    assert bytes(scan_directory(spark, root=str(tmp_path), project="p", head_bytes=1000).first()["head"]) == body[:1000]


def test_a_file_over_a_cell_has_hash_and_head(spark, tmp_path):
    import hashlib
    size, split = 3 << 30, 256 << 20
    with open(tmp_path / "sparse.bin", "wb") as fh:
        fh.write(b"start")
        fh.truncate(size)
        fh.seek(size - 3)
        fh.write(b"end")
    (tmp_path / "small.txt").write_bytes(b"small")
    rows = {r["path"]: r for r in scan_directory(spark, root=str(tmp_path), project="p", max_head=1000, split_bytes=split).collect()}
    row, zeros = rows["sparse.bin"], bytes(split)
    digests = [hashlib.sha256(b"start" + zeros[5:]).digest(), *[hashlib.sha256(zeros).digest()] * 10, hashlib.sha256(zeros[:-3] + b"end").digest()]
    assert (row["size"], row["error"], row["hash_algo"], row["head_cut"]) == (size, None, f"sha256-tree-{split}", True)
    assert row["content_hash"] == hashlib.sha256(b"".join(digests)).hexdigest()
    assert bytes(row["head"]) == b"start" + bytes(995)
    small = rows["small.txt"]
    assert (small["hash_algo"], small["head_cut"], bytes(small["head"])) == ("sha256", False, b"small")


def test_ranges_of_one_file_are_hashed_by_many_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    from docweave.sources.directory import tree_digests
    (tmp_path / "f").write_bytes(bytes(range(256)) * 400)
    large = spark.createDataFrame([("p", str(tmp_path), bytearray(b"f"), 102_400)], "project string, root string, raw binary, size long")
    plan = tree_digests(large, 1024)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "start" in plan.split("hashpartitioning(")[-1]
    assert tree_digests(large, 1024).where(F.col("failed").isNull()).count() == 1
    assert [r["digest"] for r in tree_digests(large, 1024).collect()] != [r["digest"] for r in tree_digests(large, 2048).collect()]


def test_a_file_that_shrinks_or_goes_is_an_error_row(spark, tmp_path):
    for name in ("gone", "short"):
        (tmp_path / name).write_bytes(b"x" * 5000)
    df = scan_directory(spark, root=str(tmp_path), project="p")
    os.remove(tmp_path / "gone")
    rows = {r["path"]: r for r in df.collect()}
    assert rows["gone"]["error"].startswith("FileNotFoundError") and rows["gone"]["content_hash"] is None
    assert rows["short"]["error"] is None


def test_flat_directories_and_deep_chains_fill_the_partitions(spark, tmp_path):
    from pyspark.sql import functions as F
    flat, chain = tmp_path / "flat", tmp_path / "chain"
    flat.mkdir()
    for i in range(20_000):
        (flat / f"f{i:05d}").write_bytes(b"x" * (i % 7))
    d = chain
    for i in range(60):
        d.mkdir()
        (d / "file.txt").write_bytes(b"y" * 100)
        d = d / "n"
    n = spark.sparkContext.defaultParallelism
    for root, files, per_task in ((flat, 20_000, 20_000), (chain, 60, 7)):
        df = scan_directory(spark, root=str(root), project="p", entries_per_task=per_task)
        got = df.groupBy(F.spark_partition_id().alias("t")).count().collect()
        assert len(got) >= n and sum(r["count"] for r in got) == files
        assert max(r["count"] for r in got) <= 1.2 * files / len(got) + 1


def test_partitions_follow_bytes(spark, tmp_path):
    from pyspark.sql import functions as F
    for i in range(40):
        (tmp_path / f"big{i:02d}").write_bytes(b"x" * (1 << 20))
        (tmp_path / f"small{i:02d}").write_bytes(b"x")
    df = scan_directory(spark, root=str(tmp_path), project="p", part_bytes=2 << 20)
    sizes = [r["s"] for r in df.groupBy(F.spark_partition_id().alias("t")).agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) >= 20 and max(sizes) <= 4 << 20


def test_batches_are_bounded_by_bytes():
    import pyarrow as pa

    from docweave.sources import directory as D
    path = tempfile.mkdtemp(prefix="dw-batch-")
    for i in range(6):
        with open(os.path.join(path, f"f{i}"), "wb") as fh:
            fh.truncate(20 << 20)
    rows = [("p", path, f"f{i}".encode(), 20 << 20, 0, None, None, None) for i in range(6)]
    names = ["project", "root", "raw", "size", "mtime_us", "error", "digest", "failed"]
    kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    out = list(D._reader(True, None, frozenset(), D.MAX_HEAD, D.SPLIT_BYTES)(iter([D._batch(rows, kinds, names)])))
    assert [b.num_rows for b in out] == [2, 2, 2, 0]


def test_names_that_are_no_utf8(spark, tmp_path):
    with open(os.path.join(os.fsencode(tmp_path), b"bad\xff.txt"), "wb") as fh:
        fh.write(b"z")
    row = scan_directory(spark, root=str(tmp_path), project="p").first()
    assert (row["path"], row["size"], row["error"]) == ("bad\ufffd.txt", 1, None)


def test_scan_prune_and_no_content(spark):
    root, files = make_tree()
    df = scan_directory(spark, root=root, project="p", with_content=False, prune=["a"])
    rows = df.collect()
    assert not any(r["path"].startswith("a/") for r in rows)
    assert all(r["head"] is None for r in rows)


def test_nested_states_from_scan(spark):
    from docweave.operators.state import find_nested_states
    root, _ = make_tree()
    got = [(r["project"], r["dir"]) for r in find_nested_states(scan_directory(spark, root=root, project="p")).collect()]
    assert got == [("p", "n")]                          # n/deep is below a state root, so not searched


def test_ignore_files_in_the_tree(spark):
    from docweave.plans.run import filter_inventory
    root, files = make_tree()
    extra = {".git/HEAD": b"ref: refs/heads/main\n", ".gitignore": b"*.dat\n# comment\nbuild/\n!keep.dat\n", "a/.gitignore": b"x.py\n",
             "build/out.txt": b"o", "a/b/keep.dat": b"k", "a/y.py": b"y", "c/build": b"file named build"}
    for p, b in extra.items():
        full = os.path.join(root, p)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "wb") as fh:
            fh.write(b)
    corpus = scan_directory(spark, root=root, project="p")
    kept = sorted(r["path"] for r in filter_inventory(corpus, rules="inventory").collect())
    # hidden entries dropped; *.dat ignored but keep.dat re-included; build/ is directory-only so the
    # file c/build stays; a/x.py ignored by the deeper file
    assert kept == ["_und/z.md", "a/__init__.py", "a/b/empty.txt", "a/b/keep.dat", "a/y.py", "c/build"]


def test_nested_state_in_the_tree_is_merged(spark):
    import hashlib
    import json

    from pyspark.sql import functions as F

    from docweave.operators.enrich import DeterministicClient
    from docweave.plans.run import run
    root = tempfile.mkdtemp(prefix="dw-nested-")
    body = b"# nested file\nsome text\n"
    os.makedirs(os.path.join(root, "n"))
    with open(os.path.join(root, "n", "x.md"), "wb") as fh:
        fh.write(body)
    with open(os.path.join(root, "top.md"), "wb") as fh:
        fh.write(b"top\n")
    tree = {"root": "n", "updated_at": "2024-05-01T00:00:00Z", "entries": [
        {"kind": "file", "name": "x.md", "path": "x.md", "hash": hashlib.sha256(body).hexdigest(),
         "updated_at": "2024-05-01T00:00:00Z",
         "doc": {"fileDescription": "Nested doc", "howMuchJoyDoesThisFileBringYou": 5, "personalityEmoji": "e"}}]}
    with open(os.path.join(root, "n", ".docstate.nu"), "w") as fh:
        json.dump(tree, fh)
    corpus = scan_directory(spark, root=root, project="p")
    out = tempfile.mkdtemp(prefix="dw-nested-out-")
    r = run(spark, corpus, None, out, DeterministicClient(), nested="inventory", chunk_mode="window")
    acts = {x["path"]: x["action"] for x in r.plan.collect()}
    assert acts == {"n/x.md": "reuse", "top.md": "new"}
    got = r.state.where(F.col("path") == "n/x.md").select("doc.description", "doc.joy").first()
    assert (got[0], got[1]) == ("Nested doc", "5")


def test_rounds_do_not_change_the_inventory(spark):
    root, files = make_tree()
    deep = {f"big/d{i}/f{j}.txt": b"x" * j for i in range(5) for j in range(3)}
    for p, b in deep.items():
        full = os.path.join(root, p)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "wb") as fh:
            fh.write(b)
    got = []
    for budget in (1, 5, 20_000):
        df = scan_directory(spark, root=root, project="p", entries_per_task=budget)
        got.append(sorted((r["path"], r["content_hash"]) for r in df.collect()))
    assert got[0] == got[1] == got[2] and len(got[0]) == len(files) + len(deep)


def test_children_of_a_parent_are_projects(spark, tmp_path):
    for p in ("one/a.txt", "two/b/c.txt", "loose.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"x")
    got = sorted((r["project"], r["path"]) for r in scan_directory(spark, parent=str(tmp_path)).collect())
    assert got == [("one", "a.txt"), ("two", "b/c.txt")]


def test_reinclude_lifts_the_hidden_filter(spark):
    from docweave.plans.run import filter_inventory
    root = tempfile.mkdtemp(prefix="dw-hid-")
    for p, b in {".gitignore": b"!.env\n!.github/\n", ".env": b"K=V\n", ".secret": b"s", ".github/ci.yml": b"on: push\n",
                 ".git/config": b"[core]\n", "a/.hidden_too": b"h", "a/b.txt": b"b"}.items():
        full = os.path.join(root, p)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "wb") as fh:
            fh.write(b)
    corpus = scan_directory(spark, root=root, project="p")
    kept = sorted(r["path"] for r in filter_inventory(corpus, rules="inventory").collect())
    assert kept == [".env", ".github/ci.yml", "a/b.txt"]
    kept_all = sorted(r["path"] for r in filter_inventory(corpus, rules="inventory", show_hidden=True).collect())
    assert ".secret" in kept_all and "a/.hidden_too" in kept_all


def test_gitignore_needs_a_repository(spark):
    from docweave.plans.run import filter_inventory
    root = tempfile.mkdtemp(prefix="dw-nogit-")
    for p, b in {".gitignore": b"*.log\n", ".ignore": b"*.tmp\n", "a.log": b"l", "b.tmp": b"t", "c.txt": b"c"}.items():
        with open(os.path.join(root, p), "wb") as fh:
            fh.write(b)
    corpus = scan_directory(spark, root=root, project="p")
    kept = sorted(r["path"] for r in filter_inventory(corpus, rules="inventory").collect())
    assert kept == ["a.log", "c.txt"]                    # no repository: only the generic ignore file counts


def test_user_global_rules_with_inventory_rules(spark):
    from docweave.plans.run import filter_inventory
    root = tempfile.mkdtemp(prefix="dw-global-")
    for p, b in {".ignore": b"*.tmp\n", "a.log": b"l", "b.tmp": b"t", "c.txt": b"c"}.items():
        with open(os.path.join(root, p), "wb") as fh:
            fh.write(b)
    corpus = scan_directory(spark, root=root, project="p")
    glob = spark.createDataFrame([(None, "", 0, 1, "(?:.*/)?[^/]*\\.log", False, False)],
                                 "project string, rule_dir string, level int, seq long, regex string, negated boolean, dir_only boolean")
    kept = sorted(r["path"] for r in filter_inventory(corpus, rules="inventory", extra_rules=glob).collect())
    assert kept == ["c.txt"]


def test_read_state_files_whole_text(spark):
    import json

    from docweave.sources.state_io import read_state_files
    root = tempfile.mkdtemp(prefix="dw-statefiles-")
    trees = {
        "alpha": {"root": ".", "updated_at": "2024-01-01T00:00:00Z", "entries": [
            {"kind": "dir", "name": "src", "path": "src", "updated_at": "2024-01-01T00:00:00Z", "entries": [
                {"kind": "file", "name": "a.rs", "path": "src/a.rs", "hash": "h1", "updated_at": "2024-01-01T00:00:00Z",
                 "doc": {"fileDescription": "Parses input", "joyThisFileBrings": 6, "personalityEmoji": "x"}},
                {"kind": "file", "name": "b.rs", "path": "src/b.rs", "hash": "h2", "updated_at": "2024-01-01T00:00:00Z",
                 "doc": {"fileDescription": "Bad", "personalityEmoji": "y"}}]},       # missing joy: rejected alone
            {"kind": "file", "name": "c.md", "path": "c.md", "hash": "h3", "updated_at": "2024-01-02T00:00:00Z"}]},
        "beta": "not json at all",
    }
    paths = []
    for proj, tree in trees.items():
        os.makedirs(os.path.join(root, proj))
        p = os.path.join(root, proj, ".docstate.nuon")
        with open(p, "w") as fh:
            fh.write(tree if isinstance(tree, str) else json.dumps(tree, indent=2))
        paths.append(p)
    rows = {(r["project"], r["path"]): r for r in read_state_files(spark, paths).collect()}
    assert set(rows) == {("alpha", "src/a.rs"), ("alpha", "c.md")}      # unreadable tree: no rows, no failure
    assert rows[("alpha", "src/a.rs")]["doc"]["joy"] == "6"
    assert rows[("alpha", "c.md")]["doc"]["description"] == ""          # absent doc defaults to the empty doc


def test_unreadable_entries_and_bad_records_are_reported(spark, tmp_path):
    import json

    from docweave.operators.enrich import DeterministicClient
    from docweave.plans.run import run
    root = tmp_path / "p"
    os.makedirs(root / "n")
    (root / "a.md").write_text("some text here")
    os.symlink("nowhere", root / "gone.md")  # not a regular file: no row
    (root / "n" / ".docstate.nu").write_text(json.dumps({"entries": [{"kind": "file", "path": "x", "hash": "h", "doc": {}}, {"kind": "odd"}]}))
    missing = scan_directory(spark, root=str(root / "missing"), project="p").collect()
    assert [tuple(r) for r in missing] == [("p", "", None, None, None, None, None, "FileNotFoundError: No such file or directory", None)]
    corpus = scan_directory(spark, root=str(root), project="p")
    lost = spark.createDataFrame([("p", "secret", None, None, None, None, None, "PermissionError: Permission denied", None)], corpus.schema)
    r = run(spark, corpus.unionByName(lost), None, str(tmp_path / "out"), DeterministicClient(), nested="inventory")
    s = r.summary.first()
    assert (s["walked"], s["unreadable"], s["bad_records"], s["bad_trees"]) == (1, 1, 2, 0)
