"""Multi-line CSV in many ranges equals the one-task reader."""

import random

import pyarrow as pa
import pytest

from ratewise.sources import csv_io, csv_split

SPLIT = "spark.sql.files.maxPartitionBytes"


def sample(seed, rows, eol="\n"):
    rng = random.Random(seed)

    def cell():
        text = "".join(rng.choice(["a", "é", ",", "\n", '"', " ", "b", "\n\n", '""', "x"]) for _ in range(rng.randrange(9)))
        return '"' + text.replace('"', '""') + '"' if set(text) & set(',\n"') else text
    return "song,text,n" + eol + "".join(f"{i},{cell()},{cell()}{eol}" for i in range(rows))


def both(spark, path, size):
    spark.conf.set(SPLIT, str(size))
    try:
        many = csv_io.read_score_csv(spark, path)
        return sorted(map(repr, many.collect()))
    finally:
        spark.conf.unset(SPLIT)


def whole(spark, path):
    return sorted(map(repr, csv_io.read_score_csv(spark, path, whole_files=True).collect()))


TEXT = 'a,t\n1,"x\n""q"" c"\n2,"\n"\n3,"é,\n\nz"\n\n4,p'


def assembled(text, borders, batch):
    """Records of a file cut at ``borders``, by the assembler alone."""
    lines, at = [], 0
    for line in text.encode().split(b"\n"):
        lines.append((max(b for b in [0, *borders] if b <= at), line.decode()))
        at += len(line) + 1
    rows = [("f", r, "".join(x for s, x in lines if s < r).count('"') % 2 == 1, x) for r, x in lines]
    table = pa.Table.from_pylist([dict(zip(("file", "range", "inside", "line"), r)) for r in rows],
                                 pa.schema([("file", pa.string()), ("range", pa.int64()), ("inside", pa.bool_()), ("line", pa.string())]))
    got = [r for b in csv_split._records(iter(table.to_batches(max_chunksize=batch))) for r in b.to_pylist()]
    out = [(r["first"], r["text"]) for r in got if r["kind"] == csv_split.WHOLE]
    for r in sorted((r for r in got if r["kind"] != csv_split.WHOLE), key=lambda r: (r["range"], r["kind"] == csv_split.OPEN)):
        if r["kind"] == csv_split.OPEN:
            out.append((r["first"], r["text"]))
        else:
            out[-1] = (out[-1][0], out[-1][1] + "\n" + r["text"])
    return sorted(x for x in out if x[1])


def test_every_split_offset():
    expect = sorted([(True, "a,t"), *((False, x) for x in ('1,"x\n""q"" c"', '2,"\n"', '3,"é,\n\nz"', "4,p"))])
    size = len(TEXT.encode())
    for batch in (1, 2, 100):
        for i in range(size + 1):
            for j in range(i, size + 1):
                assert assembled(TEXT, [i, j], batch) == expect, (i, j)
        assert assembled(TEXT, list(range(size)), batch) == expect


def test_ranges_through_spark(spark, tmp_path):
    path = str(tmp_path / "a.csv")
    with open(path, "w", newline="") as f:
        f.write(TEXT)
    expect = whole(spark, path)
    assert len(expect) == 4
    for size in (7, 17, 29):
        assert both(spark, path, size) == expect, size


@pytest.mark.parametrize("seed, eol, size", [(1, "\n", 300), (2, "\r\n", 211)])
def test_random_files(spark, tmp_path, seed, eol, size):
    folder = tmp_path / "in.csv"
    folder.mkdir()
    for i in range(3):
        with open(folder / f"part-{i}.csv", "w", newline="") as f:
            f.write(sample(seed * 10 + i, 60, eol))
    expect = whole(spark, str(folder))
    assert both(spark, str(folder), size) == expect
    assert len(expect) == 180


def test_a_record_over_many_ranges(spark, tmp_path):
    path = str(tmp_path / "long.csv")
    long = "\n".join(f'line {i}, ""quoted""' for i in range(60))
    with open(path, "w", newline="") as f:
        f.write(f'a,b\n1,"{long}"\n2,"{long}\n"\n3,c\n')
    expect = whole(spark, path)
    assert both(spark, path, 150) == expect and len(expect) == 3


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    path = str(tmp_path / "big.csv")
    with open(path, "w", newline="") as f:
        f.write("a,b\n" + "".join(f'{i},"x\n{i}"\n' for i in range(200_000)))
    spark.conf.set(SPLIT, "400000")
    try:
        states = csv_split.range_states(csv_split._lines(spark, path))
        assert states.count() >= 5
        rows = csv_io.read_score_csv(spark, path)
        n, total, breaks = rows.selectExpr("count(*)", "sum(cast(a as long))", "count_if(b = concat('x\n', a))").first()
    finally:
        spark.conf.unset(SPLIT)
    assert (n, total, breaks) == (200_000, 199_999 * 100_000, 200_000)


def test_header_only_and_no_rows(spark, tmp_path):
    path = str(tmp_path / "none.csv")
    with open(path, "w", newline="") as f:
        f.write("a,b\n")
    assert csv_io.read_score_csv(spark, path).collect() == []
    with open(path, "w", newline="") as f:
        f.write('a,"b\nc"\r\n1,"open\nand on')
    assert [tuple(r) for r in both_rows(spark, path)] == [("1", "open\nand on")]


def both_rows(spark, path):
    spark.conf.set(SPLIT, "5")
    try:
        return csv_io.read_score_csv(spark, path).collect()
    finally:
        spark.conf.unset(SPLIT)


def test_a_record_is_parsed_once(spark, tmp_path):
    """Also where a reader filters its columns; too long rows raise all the same."""
    path = str(tmp_path / "a.csv")
    with open(path, "w", newline="") as f:
        f.write('a,b\r\n1,"x\r\ny"\r\n\r\n2,z\r\n')
    rows = csv_io.read_score_csv(spark, path).filter("b <> 'z'")
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("from_csv(") == 1
    assert [tuple(r) for r in rows.collect()] == [("1", "x\r\ny")]
    with open(path, "a", newline="") as f:
        f.write("3,p,q\r\n")
    with pytest.raises(Exception, match="more than 2 fields"):
        csv_io.read_score_csv(spark, path).count()
