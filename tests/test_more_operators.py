import gzip
import struct
import zlib

from pyspark.sql import functions as F

from ledgerlark.functions import scalars, sortkeys
from ledgerlark.operators import attributes, cleaning, planning, state
from ledgerlark.operators import catalogs as transforms
from ledgerlark.sources import catalogs, inventory, settings


def test_headers_of_catalogs():
    xml = '<datafile><header><name>n</name><description>d</description><clrmamepro header="nes.xml" forcemerging="split" forcepacking="zip"/></header></datafile>'
    found = catalogs.parse_header(xml, "xml")
    assert (found["name"], found["header"], found["merge_type"], found["packing"], found["mame"]) == ("n", "nes.xml", "split", "zip", False)
    assert catalogs.parse_header('<mame build="0.1"/>', "xml")["mame"]
    assert catalogs.parse_header('<softwarelist name="s" description="t"/>', "xml")["description"] == "t"
    assert catalogs.parse_header('clrmamepro (\n\tname "a b"\n\tforcezipping zip\n)\n', "cmpro")["packing"] == "zip"
    assert catalogs.parse_header("DOSCenter (\n\tName: dos\n\tVersion: 3\n)\n", "doscenter")["version"] == "3"
    found = catalogs.parse_header("[CREDITS]\nauthor=me\n[DAT]\nsplit=1\nmerge=0\n[EMULATOR]\nrefname=rc\n", "romcenter")
    assert (found["author"], found["merge_type"], found["name"]) == ("me", "split", "rc")
    assert catalogs.parse_header("", "unknown")["name"] is None
    assert [catalogs.sniff(x) for x in ("other (\n name x", "DOSCenter (", "[CREDITS]", "text", "")] == ["cmpro", "doscenter", "romcenter", "unknown", "unknown"]


def test_read_headers(spark, tmp_path):
    (tmp_path / "a.dat").write_text('clrmamepro (\n name "x"\n)\n')
    (tmp_path / "b.datz").write_bytes(gzip.compress(b'<?xml version="1.0"?><datafile><header><name>z</name></header></datafile>'))
    (tmp_path / "c.xml").write_text("<?xml version='1.0'?><broken")
    assert {(r.format, r.name) for r in catalogs.read_headers(spark, str(tmp_path)).collect()} == {("cmpro", "x"), ("xml", "z"), ("unknown", None)}


def test_machine_lines(spark):
    rows = [("s&", 1, "a<", 5, "c", None, None, "m", "good", "p", None, "d", False), ("s&", 0, "b", None, None, "x", None, None, "baddump", "p", None, "d", True)]
    df = spark.createDataFrame(rows, "set_name string, ord int, name string, size long, crc string, sha1 string, md5 string, merge string, status string, cloneof string, romof string, description string, is_disk boolean")
    assert catalogs.mame_lines(df).first().value.split("\n") == [
        '\t<machine name="s&amp;" cloneof="p">', "\t\t<description>d</description>", '\t\t<disk name="b" sha1="x" status="baddump"/>', '\t\t<rom name="a&lt;" merge="m" size="5" crc="c"/>', "\t</machine>",
    ]
    assert '"name":"s&"' in catalogs.json_lines(df).first().value


def test_disk_headers_and_gzip(spark):
    v5 = b"MComprHD" + struct.pack(">II", 124, 5) + bytes(48) + b"\x01" * 20 + bytes(20) + b"\x03" * 20
    v1 = b"MComprHD" + struct.pack(">II", 76, 1) + bytes(28) + b"\x0a" * 16 + bytes(16)
    packed = gzip.compress(b"hello" * 10)
    rows = [(0, v5), (1, v1), (2, b"MComprHD"), (3, b""), (4, None), (5, packed)]
    got = spark.createDataFrame(rows, "i int, x binary").select("i", inventory.disk_header(F.col("x")).alias("d"), inventory.gzip_member(F.col("x")).alias("g")).orderBy("i").collect()
    assert tuple(got[0].d) == (5, "01" * 20, None, True)
    assert tuple(got[1].d) == (1, None, "0a" * 16, False)
    assert all(r.d is None for r in got[2:])
    assert tuple(got[5].g) == (50, f"{zlib.crc32(b'hello' * 10):08x}") and got[0].g is None


def test_header_types(spark):
    df = spark.createDataFrame([("NES.xml",), ("no-intro_lnx.xml",), ("what",), (None,)], "x string")
    assert [r[0] for r in df.select(inventory.header_type(F.col("x"))).collect()] == ["NES", "Lynx", None, None]


def test_attributes(spark):
    df = spark.createDataFrame([(5, None, None, None, 6, "c", None, None)], "size long, crc string, sha1 string, md5 string, dat_size long, dat_crc string, dat_sha1 string, dat_md5 string")
    row = attributes.attach(df).first()
    assert (row["size"], row["crc"], row["sha1"], row["size_from_dat"], row["sha1_from_dat"]) == (5, "c", None, True, False)
    verified = attributes.attach(df).withColumns({f"{f}_verified": F.lit(f == "size") for f in attributes.FIELDS})
    row = attributes.detach(verified).first()
    assert (row["size"], row["crc"], row["dat_status"]) == (5, None, "NotInDat")
    side = "struct<size:long,crc:string,sha1:string,md5:string,alt_size:long,alt_crc:string,alt_sha1:string,alt_md5:string>"
    old, new = (5, "a", None, None, None, None, None, None), (21, "b", "s", None, 5, "a", "t", None)
    pairs = spark.createDataFrame([(1, old, new, True), (2, old, new, False)], f"i int, state {side}, scan {side}, by_alt boolean")
    got = {r.i: r for r in attributes.merge_found(pairs).collect()}
    assert (got[1]["size"], got[1]["crc"], got[1]["alt_crc"], got[1]["alt_sha1"]) == (21, "b", "a", "t")
    assert (got[2]["size"], got[2]["crc"], got[2]["sha1"]) == (5, "a", "s")
    show = spark.createDataFrame([("c", True, False, True), ("c", False, False, False), (None, True, True, True)], "v string, d boolean, f boolean, h boolean")
    assert [r[0] for r in show.select(attributes.sourced(F.col("v"), F.col("d"), F.col("f"), F.col("h"))).collect()] == ["c (DV)", "c", None]
    assert tuple(attributes.shown_columns(show.where("v is null")).first()) == (False, True, True, True)


def test_deep_scans_and_alternates(spark):
    flags = {f"{f}_verified": F.col("i") < 3 for f in attributes.FIELDS} | {f"alt_{f}_verified": F.lit(False) for f in attributes.FIELDS}
    df = spark.createDataFrame([("a", 1, False), ("a", 2, False), ("b", 2, True), ("c", 3, False)], "archive string, i int, header_from_file boolean").withColumns(flags).withColumn("got_status", F.lit("Got"))
    assert {r.archive: r.deep for r in attributes.deep_scanned(df).collect()} == {"a": True, "b": False, "c": False}
    groups = spark.createDataFrame([("g", None, "k", None, None)], "group_id string, alt_size long, alt_crc string, alt_sha1 string, alt_md5 string")
    named = spark.createDataFrame([("g", 2, 7, "x", "s2", None), ("g", 1, 7, "y", None, None)], "group_id string, node_id long, size long, crc string, sha1 string, md5 string")
    row = attributes.absorb_alternates(groups, named).first()
    assert (row.alt_size, row.alt_crc, row.alt_sha1, row.alt_md5) == (7, "k", "s2", None)


def test_rules_and_text(spark):
    df = spark.createDataFrame([("Split", False, "FULL", "m"), ("Split", True, "full", None), ("None", False, "what", "")], "rule string, o boolean, h string, merge string")
    assert [r[0] for r in df.select(cleaning.merge_kind(F.col("rule"), F.col("o"), F.col("h"))).collect()] == ["Merge", "Split", "None"]
    assert [r[0] for r in df.select(cleaning.merge_text(F.col("merge"), F.lit("InDatCollect"))).collect()] == ["(No-Merge) m", None, ""]
    heads = spark.createDataFrame([("NES", "Headered"), ("NES", "Headerless"), (None, "Headered"), ("NES", "Optional")], "f string, r string")
    assert [tuple(r[0]) for r in heads.select(cleaning.header_rule(F.col("f"), F.col("r"))).collect()] == [("NES", True), (None, False), (None, False), ("NES", False)]
    named = spark.createDataFrame([("a.zip", "a"), ("a.zip", "b"), ("a.zip", None)], "n string, d string")
    assert [r[0] for r in named.select(cleaning.clear_description(F.col("n"), F.col("d"))).collect()] == [None, "b", None]
    deep = spark.createDataFrame([(["x", "y"], "s"), ([], "t"), (None, "u")], "dirs array<string>, name string")
    assert [r.name for r in cleaning.flatten_directories(deep).collect()] == ["x/y/s", "t", "u"]
    dates = spark.createDataFrame([("2001/2/3 04:05:06",), ("2001-12-13 14:15:16",), ("none",)], "x string")
    assert [str(r[0]) for r in dates.select(scalars.doscenter_time(F.col("x"))).collect()] == ["2001-02-03 04:05:06", "2001-12-13 14:15:16", "None"]
    assert spark.range(1).select(scalars.join_list(F.array(F.lit(" a "), F.lit(""), F.lit("b")))).first()[0] == "a|b"
    assert spark.range(1).select(scalars.split_list(F.lit(" a0 |1 b"))).first()[0] == ["a0", "1 b"]


def test_merging_of_a_catalog(spark):
    sets = spark.createDataFrame([("c", "p", None, None, None, None, False, 1), ("c", "k", None, None, "p", None, False, 2)], "cat_id string, name string, id string, cloneof_id string, cloneof string, romof string, is_bios boolean, ord long")
    items = spark.createDataFrame([("c", "p", 1, 1, "a", 3, "x", None, None, False), ("c", "k", 2, 2, "a", 3, "x", None, None, False), ("c", "k", 3, 3, "b", 4, "y", None, None, False)], "cat_id string, set_name string, item_id long, ord long, name string, size long, crc string, sha1 string, status string, is_disk boolean")
    of = lambda kind: {(r.item_id, r.home, r.item_name, r.dat_status) for r in cleaning.apply_merge(sets, items, kind).collect()}
    assert of("Split") == {(1, "p", "a", "InDatCollect"), (2, "k", "a", "InDatMerged"), (3, "k", "b", "InDatCollect")}
    assert of("Merge") == {(1, "p", "a", "InDatCollect"), (2, "p", "k/a", "InDatCollect"), (3, "p", "k/b", "InDatCollect")}
    assert {r[0] for r in of("NonMerged")} == {1, 2, 3}


def test_settings_and_actions(spark):
    files = spark.createDataFrame([("/d/a.dat",), ("/d/b.dat",), ("/e/c.dat",)], "path string")
    assert {(r.path, r.multi) for r in settings.catalogs_in_directory(files).collect()} == {("/d/a.dat", True), ("/d/b.dat", True), ("/e/c.dat", False)}
    df = spark.createDataFrame([("Delete",), ("Correct",), ("Rename",), ("what",)], "s string")
    assert [tuple(r) for r in df.select(planning.file_action(F.col("s")), planning.member_action(F.col("s"))).collect()] == [("delete", "leave_out"), ("check_name", "copy"), ("keep", "leave_out"), ("error", "error")]
    nodes = spark.createDataFrame([("Corrupt", 5), ("Got", 6)], "got_status string, mtime long")
    assert [r.mtime for r in planning.reset_corrupt_time(nodes).collect()] == [None, 6]
    dirs, children = spark.createDataFrame([("a",), ("b",)], "path string"), spark.createDataFrame([("a", 1)], "parent string, i int")
    assert [r.path for r in cleaning.without_empty_directories(dirs, children).collect()] == ["a"]
    assert cleaning.cleared(nodes, "mtime").first().mtime is None


def test_all_fields_of_catalogs(spark, tmp_path):
    machine = '<?xml version="1.0"?><datafile><dir name="d"><machine name="m" cloneof="p" id="5" cloneofid="6" isdevice="yes" runnable="no" sampleof="s"><year>1990</year><category>A</category><device_ref name="x"/><emuarc><publisher>me</publisher></emuarc><rom name="a" size="1" sha256="ff" mia="yes" date="2000"/><disk name="k" sha1="01"/></machine></dir></datafile>'
    (tmp_path / "a.xml").write_text(machine)
    rom, disk = catalogs.read_catalogs(spark, str(tmp_path)).orderBy("ord").collect()
    assert (rom.set_name, rom.cloneof, rom.id, rom.cloneof_id, rom.is_device, rom.runnable, rom.sampleof, rom.year, rom.category, rom.device_ref, rom.more) == ("d/m", "p", "5", "6", "yes", "no", "s", "1990", ["A"], ["x"], {"publisher": "me"})
    assert (rom.sha256, rom.mia, rom.date, rom.is_disk, disk.name, disk.is_disk, disk.sha1) == ("ff", "yes", "2000", False, "k", True, "01")
    big = catalogs.read_large_xml(spark, str(tmp_path / "a.xml"), "machine").orderBy("ord").collect()
    assert [(r.set_name, r.name, r.is_disk, r.sha256, r.device_ref) for r in big] == [("m", "a", False, "ff", ["x"]), ("m", "k", True, None, ["x"])]
    lines = [r.value for r in catalogs.xml_lines(catalogs.read_catalogs(spark, str(tmp_path))).collect()]
    assert lines == ['\t<game name="d/m">\n\t\t<rom name="a" size="1"/>\n\t\t<disk name="k" sha1="01"/>\n\t</game>']
    assert catalogs.xml_lines(catalogs.read_catalogs(spark, str(tmp_path)), old_style=False).first().value.startswith('\t<set name="d/m">\n\t\t<file name')


def test_code_page_names(spark):
    names = ["plain.bin", "caf\u00e9", "\u4e2d", "a\tb", "", "\u2591", "x[]^-\\"]
    got = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(scalars.is_cp437(F.col("n")), scalars.cp437_bytes(F.col("n"))).collect()
    assert [r[0] for r in got] == [True, True, False, False, True, True, True]
    assert [None if r[1] is None else bytes(r[1]) for r in got] == [n.encode("cp437") if ok else None for n, (ok, _) in zip(names, got, strict=True)]


def test_orders_of_lists(spark):
    df = spark.createDataFrame([("Correct", "b", 1), ("Missing", "a", None), ("Error", "c", 2), ("what", "d", 2)], "s string, n string, x int")
    assert [r.s for r in df.orderBy(*sortkeys.display(F.col("s"))).collect()] == ["Error", "Missing", "Correct", "what"]
    assert [r.n for r in df.orderBy(*sortkeys.grid(F.col("x"), F.col("n"), descending=True)).collect()] == ["c", "d", "b", "a"]
    assert [r.n for r in df.orderBy(*sortkeys.grid(F.col("x"), F.col("n"))).collect()] == ["a", "b", "c", "d"]
    cats = spark.createDataFrame([("B", 1, True), ("a", 2, False), ("a", 1, True), ("a", 1, False)], "n string, t int, f boolean")
    assert [tuple(r) for r in cats.orderBy(*sortkeys.catalog(F.col("n"), F.col("t"), F.col("f"))).collect()] == [("a", 1, False), ("a", 1, True), ("a", 2, False), ("B", 1, True)]


def test_small_steps(spark):
    sets = spark.createDataFrame([("c", "a"), ("c", "a/b"), ("c", "x"), ("d", "a")], "cat_id string, name string")
    items = spark.createDataFrame([("c", "a/b"), ("c", None)], "cat_id string, set_name string")
    assert {tuple(r) for r in transforms.without_empty_sets(sets, items).collect()} == {("c", "a"), ("c", "a/b")}
    loose = spark.createDataFrame([(None, "p/q.r.bin"), ("s", "t")], "set_name string, name string")
    assert [r.set_name for r in transforms.files_as_sets(loose).collect()] == ["q.r", "s"]
    assert cleaning.without_loose_files(loose).count() == 1
    stat = spark.createDataFrame([("InDatCollect",), ("InDatMerged",), ("InDatNoDump",)], "dat_status string")
    assert cleaning.only_collected(stat).count() == 2
    dev = spark.createDataFrame([("yes", "no"), ("yes", "yes"), (None, None), ("YES", "No")], "isdevice string, runnable string")
    assert cleaning.without_devices(dev).count() == 2
    named = spark.createDataFrame([("n", "d", "r", "f"), ("n", " ", "", "f"), ("", None, None, "f")], "n string, d string, r string, f string")
    assert [r[0] for r in named.select(transforms.auto_directory(F.col("n"), F.col("d"), F.col("r"), F.col("f"), F.lit(True))).collect()] == ["d", "n", "f"]
    one = spark.range(1)
    assert tuple(one.select(scalars.yes_no(F.lit(" TRUE ")), scalars.yes_no(F.lit(None).cast("string")), scalars.strip_chd(F.lit("a.ChD")), scalars.dat_path(F.lit("RomVault/a"), "RomVault", "DatRoot"), scalars.thousands(F.lit(1234567))).first()) == (True, False, "a", "DatRoot/a", "1,234,567")
    files, known = spark.createDataFrame([("a", 1), ("b", 2)], "path string, mtime long"), spark.createDataFrame([("a", 1), ("b", 3)], "path string, mtime long")
    scan, keep = state.unchanged(files, known)
    assert [r.path for r in scan.collect()] == ["b"] and [r.path for r in keep.collect()] == ["a"]
