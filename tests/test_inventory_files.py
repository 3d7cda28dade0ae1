"""Line numbers of inventory rows over files, splits and line ends inside quotes."""

import csv
import io
import random

import pytest

from vedette.operators import inventory
from vedette.sources.raw import numbered_records, read_inventory

HEADER = ["Nombre", "Dirección IP", "Nota"]


def make(path, rows, seed):
    """Writes a file; returns the line each row begins on."""
    rng = random.Random(seed)
    text, line, begins = "﻿", 1, {}
    for i, row in enumerate([HEADER, *rows]):
        buffer = io.StringIO()
        csv.writer(buffer, quoting=rng.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL]) if i else csv.QUOTE_MINIMAL, lineterminator="\n").writerow(row)
        begins[row[0]] = line
        text += buffer.getvalue()
        line += buffer.getvalue().count("\n")
        if i and rng.random() < 0.05:
            text, line = text + "\n", line + 1
    path.write_text(text, encoding="utf-8")
    return begins


def some_rows(n, seed, kinds):
    rng = random.Random(seed)
    return [[f"a{seed}-{i}", f"10.0.0.{i % 250}", rng.choice(kinds)] for i in range(n)]


KINDS = ["plain", 'with "quotes" in it', "two\nlines", 'x\n"y",\n,z', "a,b", 'end"', "\n\n", '""', "7\" disk", "back\\", 'a\\"b']


@pytest.mark.parametrize("split", [128 << 20, 700, 90])
def test_rows_begin_on_their_line(spark, tmp_path, split):
    expected, notes = {}, {}
    for k in range(3):
        rows = some_rows(120 if k else 1, k, KINDS)
        notes.update({r[0]: r[2] for r in rows})
        expected.update({n: (f"f{k}.csv", line) for n, line in make(tmp_path / f"f{k}.csv", rows, k).items() if n != "Nombre"})
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        got = read_inventory(spark, str(tmp_path), source="source_file").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == len(expected)
    assert {r["Nombre"]: (r["source_file"].rsplit("/", 1)[1], r["row_number"]) for r in got} == expected
    assert {r["Nombre"]: r["Nota"] for r in got} == {n: t for n, t in notes.items()}


def by_characters(lines):
    """(line a record begins on: its lines) by one pass over the characters."""
    out, state, begin = {}, "start", 1
    for n, line in enumerate(lines, 1):
        if state != "quoted":
            begin, state = n, "start"
        out.setdefault(begin, []).append(line)
        i = 0
        while i < len(line):
            c = line[i]
            if state == "quoted":
                if line[i:i + 2] == '""':
                    i += 1
                elif c == '"':
                    state = "plain"
            elif c == ",":
                state = "start"
            elif state == "start":
                state = "quoted" if c == '"' else "plain"
            i += 1
    return {k: "\n".join(v) for k, v in out.items()}


FIXED = ["h1,h2", 'x,"open', "inside", "still, inside", 'closed",y', '7" disk,z', '"a""b",c', '"a\\"b', 'c",d', "", '"p","q', '"",r', '",t', "end,1"]


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_quote_state_over_blocks(spark, block):
    """Lines in blocks of any size; quotes inside unquoted fields and doubled ones are text."""
    rng = random.Random(block)
    files = {"fixed": FIXED}
    for k in range(60):
        files[f"r{k:02}"] = ["a,b"] + ["".join(rng.choices('a,""\\ ', k=rng.randint(0, 9))) for _ in range(rng.randint(0, 25))]
    rows = [(f, i // block, i, v) for f, lines in files.items() for i, v in enumerate(lines)]
    got = numbered_records(spark.createDataFrame(rows, "file string, block long, place long, value string")).collect()
    assert sorted(by_characters(FIXED)) == [1, 2, 6, 7, 8, 9, 10, 11, 14]
    for f, lines in files.items():
        assert {r["line"]: r["value"] for r in got if r["file"] == f} == by_characters(lines), f
    assert {r["header"] for r in got} == {1}


def test_rejects_name_file_and_line(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Nombre,Dirección IP,Nota\nweb,10.0.0.1,"x\ny"\n,10.0.0.2,n\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("Nombre,Dirección IP,Nota\n,10.0.0.3,n\n", encoding="utf-8")
    df = read_inventory(spark, str(tmp_path), source="source_file")
    mapping = inventory.map_inventory_columns(df.drop("row_number", "source_file"))
    bad = inventory.inventory_rejects(inventory.cast_inventory(df, mapping, {})).collect()
    assert sorted((r["source_file"].rsplit("/", 1)[1], r["row_number"]) for r in bad) == [("a.csv", 4), ("b.csv", 2)]


def test_empty_and_header_only(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Nombre,IP\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("", encoding="utf-8")
    df = read_inventory(spark, str(tmp_path))
    assert df.columns == ["Nombre", "IP", "row_number"] and df.count() == 0
