import random

from pyspark.sql import functions as F

from ledgerlark.functions import scalars
from ledgerlark.operators import matching, planning, state, status
from ledgerlark.sources import catalogs, inventory

GOT = "node_id long, crc string, size long, sha1 string, md5 string"


def test_conflicting_hashes_split_a_group(spark):
    rows = [(1, "c", 5, "s1", None), (2, "c", 5, None, "m1"), (3, "c", 5, "s2", None), (4, "c", 5, None, None), (5, None, 5, "s1", None)]
    found = {r.node_id: r.group_id for r in matching.content_groups(spark.createDataFrame(rows, GOT)).collect()}
    assert set(found) == {1, 2, 3, 4}
    assert found[1] != found[3]


def test_disjoint_hashes_are_one_group(spark):
    rows = [(1, "c", 5, "s1", None), (2, "c", 5, None, "m1")]
    assert matching.content_groups(spark.createDataFrame(rows, GOT)).select("group_id").distinct().count() == 1


def test_validated_status(spark):
    df = spark.createDataFrame([(["Missing", "CanBeFixed"], "Rename"), (["Missing"], "Missing")], "allowed array<string>, s string")
    assert [r[0] for r in df.select(status.validated(F.col("s"), F.col("allowed"))).collect()] == ["Error", "Missing"]


def test_priorities_are_complete():
    table = planning.priorities()
    assert len(table) == 11 * 29
    assert all(len({s for d, s, _, _ in table if d == to}) == 29 for to in planning.RAW)
    assert [s for d, s, r, _ in table if d == "Zip"][:4] == ["Zip_V", "ZipTDC_V", "ZipTrrnt_V", "ZipZSTD_V"]


def test_clean_hash_and_ignore(spark):
    df = spark.createDataFrame([(" 0xAB ",), ("-",), ("12345678901",), ("zz",)], "x string")
    assert [r[0] for r in df.select(scalars.clean_hash(F.col("x"), 8)).collect()] == ["000000ab", None, "1234567890", None]
    assert scalars.ignore_regex(["*.tmp", "regex:^x"]) == "(?i)(?:(?:^.*\\.tmp$)|(?:^x))"


XML = '<?xml version="1.0"?><datafile><header><name>n</name></header><game name="g" cloneof="p"><description>d</description><rom name="a.bin" size="3" crc="00000001"/><disk name="h" sha1="ff"/></game></datafile>'
SOFT = '<?xml version="1.0"?><softwarelist name="l"><software name="s"><part><dataarea><rom name="a" size="4"/><rom loadflag="continue" size="2"/><rom name="b" size="1"/></dataarea></part></software></softwarelist>'
CMPRO = 'clrmamepro (\n name "n"\n)\ngame (\n name "g one"\n rom ( name "a b.bin" size 3 crc 0000000A nodump )\n)\n'
DOS = "DOSCenter (\n\tName: x\n)\ngame (\n\tname \"g.zip\"\n\tfile ( name a b.txt size 12 date 1990/01/02 crc 0000000B )\n)\n"
RC = "[CREDITS]\nauthor=x\n[GAMES]\n¬p¬pd¬g¬gd¬a.bin¬0000000c¬9¬ro¬m¬\n"


def test_catalog_formats(tmp_path, spark):
    import gzip

    texts = {"a.xml": XML, "b.xml": SOFT, "c.dat": CMPRO, "d.dat": DOS, "e.dat": RC}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    (tmp_path / "f.datz").write_bytes(gzip.compress(CMPRO.encode()))
    found = {(r.path[-5:], r.set_name, r.name, r["size"], r.crc, r.status) for r in catalogs.read_catalogs(spark, str(tmp_path)).collect()}
    assert ("a.xml", "g", "a.bin", "3", "00000001", None) in found
    assert ("b.xml", "s", "a", "6", None, None) in found and ("b.xml", "s", "b", "1", None, None) in found
    assert ("c.dat", "g one", "a b.bin", "3", "0000000A", "nodump") in found
    assert ("d.dat", "g", "a b.txt", "12", "0000000B", None) in found
    assert ("e.dat", "g", "a.bin", "9", "0000000c", None) in found
    assert any(p == ".datz" and n == "a b.bin" for p, _, n, *_ in found)


def test_archives_and_headers(tmp_path, spark):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.bin", b"abc")
    (tmp_path / "b.zip").write_bytes(b"PK\x03\x04 broken")
    files = inventory.scan_directory(spark, str(tmp_path))
    got = sorted((r.name or "", r["size"], r.got_status) for r in inventory.list_archives(files).collect())
    assert got == [("", None, "Corrupt"), ("x.bin", 3, "Got")]
    nes = spark.createDataFrame([(bytearray(b"NES\x1a" + bytes(12) + b"rom"),)], "content binary")
    row = inventory.scan_hashes(nes).first()
    import hashlib

    assert row.header.type == "NES" and row.alt_sha1 == hashlib.sha1(b"rom").hexdigest()


def test_incremental_refresh(tmp_path, spark):
    from ledgerlark.streaming import refresh

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_bytes(b"1")
    for _ in range(2):
        refresh.refresh(refresh.watch(spark, str(tmp_path / "in")), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    (tmp_path / "in" / "b").write_bytes(b"2")
    refresh.refresh(refresh.watch(spark, str(tmp_path / "in")), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination(60)
    refresh.refresh(refresh.watch(spark, str(tmp_path / "in")), str(tmp_path / "t"), str(tmp_path / "lost")).awaitTermination(60)
    found = spark.read.parquet(str(tmp_path / "t"))
    assert found.count() == 2 and all(r.batch[:4] != "None" for r in found.collect())


def test_staging_names_and_empty_directories(spark):
    moves = spark.createDataFrame([(1, "t", "a.bin"), (2, "t", "A.bin"), (3, "t", "a.bin"), (4, "u", "a.bin")], "node_id long, target string, name string")
    assert [r.staged for r in planning.staging_names(moves).orderBy("node_id").collect()] == ["a.bin", "A_0.bin", "a_1.bin", "a.bin"]
    dirs = spark.createDataFrame([("a",), ("a/b",), ("c",)], "path string")
    assert [r.path for r in planning.empty_directories(dirs, spark.createDataFrame([("a/b",)], "path string")).collect()] == ["c"]


def test_duplicates_need_hashes_that_agree(spark):
    rows = [
        (1, "a", "c", "s1", None, None), (2, "a", "c", "s2", None, None), (3, "a", None, "s1", "m", None), (4, "a", "c", "s2", None, None),
        (5, "b", None, "s", None, None), (6, "b", None, "s", None, None), (7, "b", None, None, "m1", None),
        (8, "e", None, None, None, None), (9, "e", None, None, None, None), (10, "d/x", "z", None, None, None), (11, "x", "z", None, None, None), (12, "y", "z", None, None, None),
        (13, "f/p10", "q", None, None, None), (14, "f/p9", "q", None, None, None),
    ]
    items = spark.createDataFrame([("s", i, *r) for i, r in enumerate(rows)], "set_id string, ord long, item_id long, name string, crc string, sha1 string, md5 string, sha256 string")
    of = lambda *how: sorted(r.item_id for r in matching.remove_dupes(items, *how).collect())
    assert of() == [1, 2, 5, 7, 8, 9, 10, 11, 12, 13, 14]
    assert of(False)[-5:] == [8, 9, 11, 12, 14]


def test_merge_pairs_all_copies(spark):
    kind = "node_id long, parent string, file_type string, name string, size long, crc string, sha1 string, md5 string"
    old = [(i, "p", "f", "a", 5, "c", "s", None) for i in range(4)] + [(4, "p", "f", "A", 5, None, "s", None), (5, "p", "f", "z", 0, None, None, None)]
    new = [(i + 10, "p", "f", "a", 5, "c", None, None) for i in range(5)] + [(15, "p", "f", "z", 0, None, None, None), (16, "p", "f", "A", 5, "c", "s", None)]
    found = [(r.state_id, r.incoming_id, r.outcome) for r in state.merge(spark.createDataFrame(old, kind), spark.createDataFrame(new, kind)).collect()]
    assert sorted(found, key=str) == sorted([*((i, i + 10, "same") for i in range(4)), (4, 16, "same"), (5, 15, "same"), (None, 14, "new")], key=str)


def plain_groups(rows):
    """Greedy groups of (id, crc, size, sha1, md5) in canonical order: sets of ids."""
    groups = []
    key = lambda r: (-sum(x is not None for x in r[2:]), *((x is None, str(x)) for x in r[2:]))
    for r in sorted(rows, key=lambda r: (key(r), r[0])):
        for g in groups:
            if g[0] == r[1] and all(a is None or b is None or a == b for a, b in zip(g[1], r[2:], strict=True)):
                g[1] = [b if a is None else a for a, b in zip(g[1], r[2:], strict=True)]
                g[2].add(r[0])
                break
        else:
            groups.append([r[1], list(r[2:]), {r[0]}])
    return {frozenset(g[2]) for g in groups}


def test_contradicting_groups_by_a_plain_model(spark):
    r = random.Random(4)
    for n in (30, 300):
        rows = [(i, r.choice("ab"), r.choice([None, 1, 2]), r.choice([None, "s1", "s2", "s3"]), r.choice([None, "m1", "m2"])) for i in range(n)]
        found = {}
        for x in matching.content_groups(spark.createDataFrame(rows, GOT)).collect():
            found.setdefault(x.group_id, set()).add(x.node_id)
        assert {frozenset(v) for v in found.values()} == plain_groups(rows)


def test_cascade_of_headered_and_empty_files(spark):
    got = [(1, "c1", 20, "s1", "m1", 4, "k1", "t1", None), (2, "c2", 21, "s2", None, None, None, None, None), (3, "00000000", 0, None, None, None, None, None, None)]
    groups = matching.group_table(matching.content_groups(spark.createDataFrame(got, GOT + ", alt_size long, alt_crc string, alt_sha1 string, alt_md5 string")))
    rows = [
        (10, "k1", 4, None, None, "a", "NES"), (11, "k1", 4, None, None, "a", None), (12, None, 4, "t1", None, "a", "NES"), (13, None, 5, "t1", None, "a", "NES"), (14, None, None, "s2", None, "a", "NES"),
        (20, None, 0, None, None, "a", None), (21, "zz", 0, None, None, "a", None), (22, None, None, None, None, "d/", None), (23, None, None, None, None, "/", None), (24, None, None, None, None, "a", None), (25, None, 7, None, None, "d/", None),
    ]
    missing = spark.createDataFrame([(r[0], r[1], r[2], r[3], r[4], r[5], r[6]) for r in rows], GOT + ", name string, header_type string")
    found = {x.node_id: (x.group_id, x["rank"]) for x in matching.missing_cascade(missing, groups).collect()}
    assert found == {10: ("c1-0", 0), 11: (None, None), 12: ("c1-0", 1), 13: (None, None), 14: ("c2-0", 4), 20: ("zero", None), 21: (None, None), 22: ("zero", None), 23: (None, None), 24: (None, None), 25: (None, None)}


def test_long_chains_cycles_and_devices(spark):
    from ledgerlark.operators import catalogs as transforms

    sets = [("c", f"n{i}", f"n{i + 1}" if i < 300 else None) for i in range(301)] + [("c", "x", "y"), ("c", "y", "z"), ("c", "z", "x"), ("c", "w", "x"), ("c", "q", "q"), ("c", "o", "gone")]
    found = {(r.name, r.ancestor, r.depth) for r in transforms.parent_chain(spark.createDataFrame(sets, "cat_id string, name string, parent string")).collect()}
    want = {(f"n{i}", f"n{j}", j - i) for i in range(301) for j in range(i + 1, 301)}
    want |= {("x", "y", 1), ("x", "z", 2), ("y", "z", 1), ("y", "x", 2), ("z", "x", 1), ("z", "y", 2), ("w", "x", 1), ("w", "y", 2), ("w", "z", 3)}
    assert found == want
    refs = spark.createDataFrame([("c", "a", "b"), ("c", "b", "c"), ("c", "c", "a"), ("c", "a", "c")], "cat_id string, set_name string, device string")
    items = spark.createDataFrame([("c", "a", 1, "r", "s"), ("c", "b", 2, "r", "s"), ("c", "b", 3, "t", "u"), ("c", "c", 4, "t", "u"), ("c", "c", 5, "v", None)], "cat_id string, set_name string, item_id long, name string, sha1 string")
    got = {(r.set_name, r.item_id) for r in transforms.non_merge_sets(items, refs).collect()}
    assert got == {("a", 3), ("a", 5), ("b", 5), ("c", 1)}


def test_merge_sets_keep_what_nobody_dumped(spark):
    from ledgerlark.operators import catalogs as transforms

    kind = "cat_id string, set_name string, item_id long, name string, size long, crc string, sha1 string, md5 string, status string, is_disk boolean"
    rows = [
        ("c", "bios", 1, "b", 3, "x", None, None, None, False), ("c", "p", 2, "a", 3, None, "s", None, None, False), ("c", "k", 3, "n", 3, "x", None, None, "nodump", False),
        ("c", "k", 4, "b2", 3, "x", None, None, None, False), ("c", "k", 5, "d", 9, None, "t", None, None, True), ("c", "k", 6, "o", 4, "x", None, None, None, False), ("c", "k", 7, "u", 3, None, "q", "m", None, False),
    ]
    chain = spark.createDataFrame([("c", "k", "p", 1), ("c", "k", "bios", 2), ("c", "p", "bios", 1)], "cat_id string, name string, ancestor string, depth int")
    bios = spark.createDataFrame([("c", "bios")], "cat_id string, name string")
    of = lambda **how: {(r.item_id, r.home, r.item_name) for r in transforms.merge_sets(spark.createDataFrame(rows, kind), chain, bios, **how).collect()}
    # 2 and 7 have no hash to compare with the BIOS item, and sizes agree
    assert of() == {(1, "bios", "b"), (3, "p", "k/n"), (5, "p", "d"), (6, "p", "k/o")}
    assert of(with_set_name=False) == {(1, "bios", "b"), (3, "p", "n"), (5, "p", "d"), (6, "p", "o")}


def test_incomplete_sets_touch_their_groups_once_more(spark):
    """A set under a complete-only rule misses a file: what it has is to go, and a copy elsewhere is no duplicate then."""
    rows = [
        (1, "a", "c1", 5, "Got", "InDatCollect", True), (2, "b", "c1", 5, "Got", "InToSort", False), (3, "b", "c2", 6, "Got", "InToSort", False),
    ]
    missing = [(4, "a", "c2", 6, "NotGot", "InDatCollect", True), (5, "a", "c3", 7, "NotGot", "InDatCollect", True)]
    extra = {"file_type": "'File'", "name": "'f'", "root_kind": "if(dat_status = 'InToSort', 'staging', 'collection')", "locked": "false", "sha1": "cast(null as string)", "md5": "cast(null as string)", "header_type": "cast(null as string)"}
    extra |= {f"alt_{h}": "cast(null as string)" for h in ("crc", "sha1", "md5")} | {"alt_size": "cast(null as long)"} | {c: "false" for c in ("sha1_verified", "md5_verified", "alt_sha1_verified", "alt_md5_verified", "header_required", "header_from_file")}
    of = lambda x: spark.createDataFrame(x, "node_id long, parent_id string, crc string, size long, got_status string, dat_status string, complete_only boolean").withColumns({k: F.expr(v) for k, v in extra.items()})
    got = {r.node_id: (r.new_status, r.partial_status, r.final_status) for r in status.find_fixes(of(rows), of(missing)).collect()}
    assert got[1] == ("Correct", "IncompleteRemove", "Delete")
    assert got[2] == ("Delete", "Delete", "InToSort")
    assert got[3] == ("NeededForFix", "NeededForFix", "InToSort")
    assert got[4] == ("CanBeFixed", "Incomplete", "Incomplete")
    assert got[5] == ("Missing", "Missing", "Missing")


def test_header_predicate(spark):
    side = "struct<sha1:string,md5:string,alt_sha1:string,alt_md5:string,sha1_verified:boolean,md5_verified:boolean,alt_sha1_verified:boolean,alt_md5_verified:boolean,header_type:string,header_required:boolean,header_from_file:boolean>"
    base = ("s", None, None, None, False, False, False, False, None, False, False)
    put = lambda **k: tuple(k.get(n.split(":")[0], v) for n, v in zip(side[7:-1].split(","), base, strict=True))
    cases = [
        (put(), put(), True), (put(header_type="NES"), put(header_type="Lynx"), False), (put(header_type="NES"), put(), True),
        (put(header_type="NES", header_required=True), put(header_type="NES"), False), (put(header_type="NES", header_required=True), put(header_type="NES", header_from_file=True), True),
        (put(), put(sha1="t", sha1_verified=True), True), (put(), put(sha1="t", sha1_verified=True, alt_sha1="s", alt_sha1_verified=True), True), (put(), put(sha1="t", sha1_verified=True, alt_sha1="u", alt_sha1_verified=True), False),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], f"i int, m {side}, g {side}").orderBy("i")
    assert [r[0] for r in df.select(status.fixes(lambda k: F.col(f"m.{k}"), lambda k: F.col(f"g.{k}"))).collect()] == [c for *_, c in cases]


def test_release_and_delete_checks(spark):
    rows = [(1, "g", "NeededForFix", False, "staging"), (2, "g", "CorruptCanBeFixed", False, "collection"), (3, "h", "NeededForFix", True, "staging"), (4, "h", "NeededForFix", True, "collection"), (5, None, "Correct", False, "collection"), (6, "i", "Rename", False, "collection"), (7, "j", "NeededForFix", False, "staging"), (8, "j", "CanBeFixed", False, "collection")]
    df = spark.createDataFrame(rows, "node_id long, group_id string, new_status string, locked boolean, root_kind string")
    of = lambda **k: [r.released for r in planning.release_sources(df, **k).orderBy("node_id").collect()]
    assert of() == ["Delete", "CorruptCanBeFixed", "InToSort", "Unknown", "Correct", "Rename", "NeededForFix", "CanBeFixed"]
    assert of(renames=True)[5] == "Delete"


def test_archives_move_as_a_whole(spark):
    kind = "archive string, place int, name string, size long, sha1 string"
    wanted = spark.createDataFrame([("w", 0, "a", 1, "s"), ("w", 1, "b", 2, None), ("v", 0, "a", 1, "s")], kind)
    found = spark.createDataFrame([("f", 0, "a", 1, "s"), ("f", 1, "b", 2, None), ("e", 0, "a", 1, "s"), ("u", 0, "a", 1, "s")], kind).withColumns({"sha1_verified": F.col("archive") != "u", "header_type": F.lit(None).cast("string")})
    assert {tuple(r) for r in planning.archive_move(wanted, found).collect()} == {("w", "f", 2), ("v", "e", 1)}


def test_members_times_and_lost_files(spark):
    kind = "node_id long, parent string, file_type string, name string, size long, crc string, sha1 string, md5 string"
    old = spark.createDataFrame([(1, "p", "f", "a", 5, "c", None, None), (2, "p", "f", "a", 5, "c", None, None), (3, "p", "f", "b", 5, "d", None, None)], kind)
    new = spark.createDataFrame([(11, "p", "f", "a", 5, "c", "s", None), (12, "p", "f", "a", None, "c", None, None), (13, "p", "f", "A", 5, "c", None, None)], kind)
    assert {tuple(r) for r in state.merge_members(old, new).collect()} == {(1, 11, "same"), (1, 12, "same"), (2, None, "gone"), (3, None, "gone"), (None, 13, "new")}
    timed = "node_id long, parent string, file_type string, name string, mtime long, size long"
    pairs, rest = state.merge_by_time(spark.createDataFrame([(1, "p", "f", "a", 9, 5), (2, "p", "f", "b", 9, 5)], timed), spark.createDataFrame([(11, "p", "f", "a", 9, 5), (12, "p", "f", "b", 8, 5)], timed))
    assert [tuple(r) for r in pairs.collect()] == [(1, 11)] and [r.node_id for r in rest.collect()] == [12]
    row = ("InDatCollect", "Got", 20, "c", None, None, False, False, False, False, 4, "k", None, None, False, True, False, False)
    cols = "dat_status string, got_status string, size long, crc string, sha1 string, md5 string, size_from_dat boolean, crc_from_dat boolean, sha1_from_dat boolean, md5_from_dat boolean, alt_size long, alt_crc string, alt_sha1 string, alt_md5 string, alt_size_from_dat boolean, alt_crc_from_dat boolean, alt_sha1_from_dat boolean, alt_md5_from_dat boolean"
    got = state.lost(spark.createDataFrame([row, ("NotInDat", *row[1:])], cols)).collect()
    assert len(got) == 1 and (got[0].got_status, got[0]["size"], got[0].crc, got[0].crc_from_dat, got[0].alt_crc) == ("NotGot", None, "k", True, None)


def test_state_versions(spark, tmp_path):
    import pytest

    root = str(tmp_path / "state")
    rows = spark.createDataFrame([(1, "staging")], "node_id long, root_kind string")
    state.save_state(rows, root, 1)
    state.save_state(rows.union(rows), root, 2)
    (tmp_path / "state" / "v=3").mkdir()  # never finished
    found, version = state.load_state(spark, root)
    assert version == 2 and found.count() == 2
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        state.load_state(spark, str(tmp_path / "none"))
