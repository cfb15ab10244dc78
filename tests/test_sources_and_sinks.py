import codecs
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from loomlog.functions import text
from loomlog.operators.parse import parse_logs
from loomlog.plans import files
from loomlog.sinks.export import normalise_format, target_path, write_export
from loomlog.sinks.versions import Versions
from loomlog.sources import ranges
from loomlog.sources.records import normalise_records, text_records
from loomlog.sources.tables import log_lines
from loomlog.sources.textlogs import cut_unterminated, discover_logs, find_logs, read_log_files


def _write(folder, name, content):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


@pytest.mark.parametrize("bound", [0, 1_000_000])
def test_line_numbers_across_splits(spark, tmp_path, monkeypatch, bound):
    monkeypatch.setattr("loomlog.sources.textlogs.BROADCAST_SPLITS", bound)
    rng = random.Random(1)
    wanted = {}
    paths = []
    for name, count in (("big.log", 6000), ("mid.log", 900), ("one.log", 1)):
        lines = ["" if rng.random() < 0.1 else f"{name} {i} " + "x" * rng.randrange(60)
                 for i in range(1, count + 1)]
        lines[-1] = lines[-1] or "end"
        paths.append(_write(tmp_path, name, "\n".join(lines) + "\n"))
        wanted[name] = lines
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        for tail in (None, 0, 1, 500):
            df = read_log_files(spark, paths, tail=tail)
            assert df.rdd.getNumPartitions() > 8
            rows = df.collect()
            for name, lines in wanted.items():
                numbered = [(i, line) for i, line in enumerate(lines, 1)][-(tail or 0):]
                got = sorted((r.line_number, r.raw) for r in rows if r.source.endswith(name))
                assert got == [(i, line) for i, line in numbered if line.strip()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_line_ends_and_encodings(spark, tmp_path):
    mixed = _write(tmp_path, "mixed.log", b"one\r\ntwo\n\n  \nthree")
    rows = read_log_files(spark, [mixed]).orderBy("line_number").collect()
    assert [(r.line_number, r.raw) for r in rows] == [(1, "one"), (2, "two"), (5, "three")]
    cases = {
        "latin-1": ("café".encode("latin-1"), "café"),
        "windows-1252": ("“quoted” €5".encode("cp1252"), "“quoted” €5"),
        "shift_jis": ("エラー".encode("shift_jis"), "エラー"),
        "utf-8": (b"bad \xff byte", "bad � byte"),
    }
    for encoding, (raw, wanted) in cases.items():
        path = _write(tmp_path, f"{encoding}.log", raw + b"\n")
        (row,) = read_log_files(spark, [path], encoding=encoding).collect()
        assert row.raw == wanted, encoding


def test_discovery(spark, tmp_path):
    for name in ("a/app.log", "a/b/x.TXT", "a/access_2024", "a/data.csv", "a/y.err", "z.bin"):
        _write(tmp_path, name, "x\n")
    root, direct = str(tmp_path / "a"), str(tmp_path / "z.bin")
    found = discover_logs(spark, [root, direct, root, str(tmp_path / "missing")])
    names = [os.path.relpath(p.removeprefix("file:"), tmp_path) for p in found]
    assert names == ["a/access_2024", "a/app.log", "a/b/x.TXT", "a/y.err", "z.bin"]
    assert len(discover_logs(spark, [root], limit=2)) == 2


def test_guard_cuts_only_open_lines(spark):
    df = spark.createDataFrame([("x" * 70_000, True), ("x" * 70_000, False)], "t string, o boolean")
    found = df.select(F.length(cut_unterminated(F.col("t"), F.col("o"))).alias("n")).collect()
    assert [r.n for r in found] == [65_536, 70_000]


def test_foreign_records(spark):
    df = spark.createDataFrame(
        [("m", None, "f.log", 40, "t1", 3), ("", "txt", "", 7, None, 0)],
        "message string, text string, file string, level int, ts string, line_number int",
    )
    a, b = normalise_records(df).orderBy("line_number", ascending=False).collect()
    assert (a.raw, a.source, a.level_name, a.timestamp, a.is_error) == ("m", "f.log", "ERROR", "t1", True)
    assert (b.raw, b.message, b.level_name, b.source) == ("txt", "txt", "INFO", "")
    (c,) = text_records(spark.createDataFrame([("hello",)], "value string")).collect()
    assert (c.raw, c.message, c.level_name) == ("hello", "hello", "INFO")


def test_display_functions(spark):
    def shown(column, *values, kind="double"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
        return [r.x for r in df.select("i", column(F.col("v")).alias("x")).orderBy("i").collect()]

    assert shown(text.format_timestamp, 0.0, None, -5.0, 1.7e9, 1e30) == [
        "-", "-", "-", "2023-11-14 22:13:20", "-"]
    assert shown(text.human_readable_size, 0.0, -10.0, 512.0, 1024.0, 1536.0, 1024.0 ** 2,
                 1024.0 ** 5, 1024.0 ** 6, 1024.0 ** 8) == [
        "0 B", "0 B", "512 B", "1.00 KB", "1.50 KB", "1.00 MB", "1.00 PB", "1.00 EB", "1048576.00 EB"]
    assert shown(text.format_duration, None, -1.0, 0.045, 1.5, 90.0, 3700.0, 90000.0) == [
        "-", "-", "45ms", "1.50s", "1m 30s", "1h 1m", "1d 1h"]
    assert shown(text.escape_html, "<a href='x'>&\"", None, kind="string") == [
        "&lt;a href=&#x27;x&#x27;&gt;&amp;&quot;", ""]
    assert shown(lambda c: text.truncate_string(c, 8), "abcdefghij", "abc", None, "", kind="string") == [
        "abcde...", "abc", "", ""]
    assert shown(lambda c: text.truncate_string(c, 2), "abcdef", kind="string") == ["ab"]


def test_two_decimals_round_like_the_binary_value(spark):
    rng = random.Random(4)
    values = [1.005, 1.015, 1.025, 2.675, 0.125, 0.375, 29.125, 59.995, 0.29, 1023.995, 58.115]
    values += [rng.randrange(10 ** 7) / 1000 for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    found = df.select("v", text._two_decimals(F.col("v")).alias("s")).collect()
    assert {r.v: r.s for r in found} == {v: f"{v:.2f}" for v in values}


def test_formats_and_paths():
    assert [normalise_format(f) for f in ("MD", ".json", "plain", "markdown")] == [
        "md", "json", "txt", "md"]
    with pytest.raises(ValueError, match="no export is called"):
        normalise_format("pdf")
    assert target_path("out/report.html", "md") == "out/report.md"
    assert target_path("report", "txt") == "report.txt"


@pytest.fixture(scope="module")
def entries(spark):
    lines = [
        "2026-08-30T20:00:01Z [INFO] ready", "2026-08-30T20:00:02Z [ERROR] deadlock detected",
        "2026-08-30T20:00:03Z WARN slow | pipe", "no time CRITICAL out of memory",
    ]
    df = spark.createDataFrame(
        [(line, "/var/log/app.log", i) for i, line in enumerate(lines, 1)],
        "raw string, source string, line_number bigint",
    )
    return parse_logs(df).persist()


def _read(folder):
    out = []
    for name in sorted(os.listdir(folder)):
        if name.startswith("part-"):
            out += open(os.path.join(folder, name), encoding="utf-8").read().splitlines()
    return out


def test_exports(entries, tmp_path):
    txt = write_export(entries, "text", str(tmp_path / "out"), ["/var/log/app.log"], "errors only")
    lines = _read(f"{txt}/entries")
    assert lines[1] == (
        f"{'2026-08-30T20:00:02Z':<26} {'ERROR':<9} {'app.log':<22} "
        "2026-08-30T20:00:02Z [ERROR] deadlock detected"
    )
    header = _read(f"{txt}/header")
    assert " Entries     : 4" in header and " Filters     : errors only" in header
    assert " Window      : 2026-08-30T20:00:01Z -> 2026-08-30T20:00:03Z" in header
    md = write_export(entries, "md", str(tmp_path / "out"))
    assert _read(f"{md}/entries")[2].startswith("2026-08-30T20:00:03Z [WARN    ] (app.log) ")
    header = _read(f"{md}/header")
    assert "| Entries | 4 |" in header and "| db_deadlock | 1 |" in header
    # among equals the one seen first
    assert header.index("| db_deadlock | 1 |") < header.index("| oom | 1 |")
    assert header[-1] == "```text" and _read(f"{md}/footer") == ["```"]
    assert _read(f"{txt}/footer")[1] == " end of export (4 entries)"
    js = write_export(entries, "json", str(tmp_path / "out"))
    assert [json.loads(x)["line_number"] for x in _read(f"{js}/entries")] == [1, 2, 3, 4]
    (meta,) = [json.loads(x) for x in _read(f"{js}/metadata")]
    assert meta["total_errors"] == 2 and meta["level_counts"]["ERROR"] == 1
    (statistics,) = [json.loads(x) for x in _read(f"{js}/statistics")]
    assert statistics["total_lines"] == 4


def test_wide_encodings(spark, tmp_path):
    lines = ["first line", "zweite Zeile mit ö", "", "last"]
    for encoding in ("utf-16-le", "utf-16-be", "utf-32-le"):
        path = tmp_path / f"{encoding}.log"
        path.write_bytes(("\ufeff" + "\r\n".join(lines)).encode(encoding))
        found = read_log_files(spark, [str(path)], encoding).orderBy("line_number").collect()
        assert [(r.line_number, r.raw) for r in found] == [
            (1, lines[0]), (2, lines[1]), (4, lines[3])]
        bare = read_log_files(spark, [str(path)], encoding, numbers=False).collect()
        assert {(r.line_number, r.raw) for r in bare} == {(None, x) for x in lines if x}


LINE_ENDS = ["\n", "\r\n", "\r", "\n\n", "\r\r\n", "\n\r"]


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "latin-1", "utf-16", "utf-16-be", "utf-32", "utf-32-be"])
@pytest.mark.parametrize("width", [4, 12, 64, 1 << 20])
def test_ranges_read_what_python_reads(spark, tmp_path, encoding, width, monkeypatch):
    """Every width of range and chunk gives the lines and numbers of one reading by Python."""
    rng = random.Random(width)
    letters = "abé \u00ff" if encoding == "latin-1" else "abé \u0a0d\u0d0a\u0a00\u010a\U0001f40a"
    monkeypatch.setattr(ranges, "CHUNK_BYTES", 8 if width < 64 else 1 << 20)
    wanted = {}
    for k in range(6):
        text = "".join(
            "".join(rng.choice(letters) for _ in range(rng.randrange(9))) + rng.choice(LINE_ENDS)
            for _ in range(rng.randrange(14))
        ) + rng.choice(["", "end"])
        path = tmp_path / f"{k}.log"
        # byte orders are mixed where the mark tells them
        plain = {"utf-16": ["utf-16-le", "utf-16-be"], "utf-32": ["utf-32-le", "utf-32-be"]}.get(encoding)
        data = text.encode(encoding) if plain is None else ("\ufeff" + text).encode(plain[k % 2])
        path.write_bytes(data)
        with open(path, encoding=encoding) as file:
            wanted[f"{k}.log"] = [line.rstrip("\n") for line in file]
    rows = ranges.read_ranges(spark, [str(tmp_path)], encoding, width=width, most=None).collect()
    found = {name: [] for name in wanted}
    for row in sorted(rows, key=lambda r: (r.file, r.line_number)):
        found[row.file.rsplit("/", 1)[1]].append(row.raw)
        assert row.line_number == len(found[row.file.rsplit("/", 1)[1]]) and not row.cut
    assert found == wanted
    tails = ranges.read_ranges(spark, [str(tmp_path)], encoding, tail=3, width=width, most=None).collect()
    assert sorted((r.file.rsplit("/", 1)[1], r.line_number, r.raw) for r in tails) == sorted(
        (name, n, line) for name, lines in wanted.items() for n, line in list(enumerate(lines, 1))[-3:])


def test_wide_without_a_mark_is_little_endian(spark, tmp_path):
    path = tmp_path / "bare.log"
    path.write_bytes("eins\nzwei".encode("utf-16-le"))
    found = read_log_files(spark, [str(path)], "utf-16").orderBy("line_number").collect()
    assert [(r.line_number, r.raw) for r in found] == [(1, "eins"), (2, "zwei")]


def test_bytes_that_are_no_text(spark, tmp_path):
    """Broken sequences become marks; a wide file may end within a unit."""
    (tmp_path / "a.log").write_bytes(b"ok\n\xff\xfebad\n\xe2\x82")
    (tmp_path / "b.log").write_bytes("x\ny".encode("utf-16-le") + b"z")
    narrow = read_log_files(spark, [str(tmp_path / "a.log")], most=100).orderBy("line_number").collect()
    assert [r.raw for r in narrow] == ["ok", "\ufffd\ufffdbad", "\ufffd"]
    wide = read_log_files(spark, [str(tmp_path / "b.log")], "utf-16-le").orderBy("line_number").collect()
    assert [r.raw for r in wide] == ["x", "y\ufffd"]


def test_endless_lines_are_cut_and_never_held(spark, tmp_path):
    """200 MB without a line end in files of many ranges; workers stay far below that."""
    path = tmp_path / "endless.log"
    with open(path, "wb") as out:
        out.write(b"first\n")
        for _ in range(200):
            out.write("é".encode() * (1 << 19))
        out.write(b"\nlast")

    found = read_log_files(spark, [str(path)], most=64 * 1024).orderBy("line_number").collect()
    assert [(r.line_number, len(r.raw)) for r in found] == [(1, 5), (2, 65_536), (3, 4)]
    assert set(found[1].raw) == {"é"}
    lines = ranges.range_lines(ranges.file_ranges(spark, [str(path)]), most=64 * 1024)
    assert {r.cut for r in lines.collect()} == {False, True}
    held = list(ranges._range_lines(open_at(path), path.stat().st_size, 0, 32 << 20, "utf-8", 64 * 1024))
    assert max(len(line) for line, _ in held[1:]) <= 4 * 64 * 1024


def open_at(path):
    import pyarrow.fs

    return pyarrow.fs.LocalFileSystem().open_input_file(str(path))


def test_line_index_is_kept_and_extended(spark, tmp_path, monkeypatch):
    """A second read counts nothing; a new or changed file is counted, others are not."""
    folder, index = tmp_path / "in", str(tmp_path / "index")
    folder.mkdir()
    counted = []
    count = ranges._counted
    monkeypatch.setattr(ranges, "_counted", lambda some, encoding: counted.append(
        sorted({r.file.rsplit("/", 1)[1] for r in some.collect()})) or count(some, encoding))

    def land(name, lines, at):
        (folder / name).write_text("".join(f"{line}\n" for line in lines))
        os.utime(folder / name, (at, at))

    def read():
        rows = ranges.read_ranges(spark, [str(folder)], index=index, width=16).collect()
        assert sorted((r.file, r.line_number, r.raw) for r in rows) == sorted(
            (f"file:{path}", n, line) for path in folder.iterdir()
            for n, line in enumerate(path.read_text().splitlines(), 1))

    land("a.log", ["one", "", "three", "a long fourth line over ranges"], 1.6e9)
    land("b.log", ["x"] * 30, 1.6e9)
    read()
    assert counted == [["a.log", "b.log"]]
    read()
    assert len(counted) == 1
    land("c.log", ["new"] * 9, 1.6e9)
    land("b.log", ["y", "z", "w"] * 10, 1.6e9 + 5)
    read()
    assert counted[1:] == [["b.log", "c.log"]]
    read()
    assert len(counted) == 2 and len(Versions(index).whole(spark)) == 2


def test_empty_files_and_no_files(spark, tmp_path):
    (tmp_path / "empty.log").write_bytes(b"")
    (tmp_path / "mark.log").write_bytes(codecs.BOM_UTF16_LE)
    assert read_log_files(spark, [str(tmp_path)], "utf-16").collect() == []
    assert read_log_files(spark, [str(tmp_path / "empty.log")], index=str(tmp_path / "i")).collect() == []


def test_landed_segments_lie_in_one_folder_and_are_found_as_a_table(spark, small):
    folder = files.landed_lines(spark, small, 100)
    lines = {r.line_number: r.raw for r in log_lines(spark, small).collect()}
    names = sorted(os.listdir(folder.removeprefix("file:")))
    assert names == sorted({f"segment={n // 100}.txt" for n in lines})
    found = find_logs(spark, [folder, folder]).collect()
    assert sorted(r.path.rsplit("/", 1)[-1] for r in found) == names and {r.root_no for r in found} == {0}
    read = read_log_files(spark, [folder]).collect()
    segment = lambda r: int(r.file.rsplit("=", 1)[-1].removesuffix(".txt"))
    assert {segment(r) * 100 + r.line_number - 1: r.raw for r in read} == lines


def test_exports_read_entries_that_were_parsed_once(spark, small, monkeypatch):
    entries, meta = files._meta(spark, small)
    given = []
    monkeypatch.setattr(files, "write_export", lambda df, *a, **k: given.append(df) or write_export(df, *a, **k))
    files.exported_json(spark, small)
    for df in (entries, meta, *given):
        assert df.inputFiles() and not any("events.parquet" in f for f in df.inputFiles())
