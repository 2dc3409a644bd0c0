"""The splittable CSV reader equals the multiLine reader, whatever the splits."""

import os
import random

import pytest

from nearhit.sources import csvlines as C
from nearhit.sources import pairs as P

DDL = "id long, a string, b string"


@pytest.fixture()
def small_splits(spark):
    """Splits of a few hundred bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def whole(spark, path, header=True):
    return spark.read.schema(DDL).options(header=header, **C.OPTIONS).csv(path)


def rows(df):
    return sorted(map(str, df.collect()))


def field(rng):
    body = "".join(rng.choice(["word ", "x,y ", "\n", "\n\n", '\\"', "\\\\", "\\n", "é", "7 "]) for _ in range(rng.randrange(9)))
    return f'"{body}"' if rng.random() < 0.8 else rng.choice(["plain", 'an inch 5" wide', "", "back\\slash", 'mid"quote"d'])


def write(path, seed, n, end="\n", last=True, header="id,a,b"):
    rng = random.Random(seed)
    lines = ([header] if header else []) + [f"{i},{field(rng)},{field(rng)}" for i in range(n)]
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(end.join(lines) + (end if last else ""))


@pytest.mark.parametrize("seed", range(3))
def test_equals_the_multiline_reader(spark, scratch, small_splits, seed):
    path = os.path.join(scratch, "x.csv")
    write(path, seed, 400, last=seed > 0)
    df = C.read_csv_split(spark, path, DDL)
    got = rows(df)
    assert len(got) == 400 and got == rows(whole(spark, path))
    assert C._lines(spark, path).rdd.getNumPartitions() > 10


def test_many_files_long_records_and_empty_ones(spark, scratch, small_splits):
    for i in range(4):
        write(os.path.join(scratch, f"f{i}.csv"), 10 + i, [0, 1, 60, 30][i])
    with open(os.path.join(scratch, "long.csv"), "w", encoding="utf-8") as f:  # records over several splits, and a split's length of line breaks
        f.write('id,a,b\n1,"' + "long, text\n" * 200 + '",x\n\n2,y,"' + "\n" * 900 + '"\n3,"' + 'q\\"' * 500 + '",z\n')
    open(os.path.join(scratch, "empty.csv"), "w").close()
    got = rows(C.read_csv_split(spark, scratch, DDL))
    assert len(got) == 94 and got == rows(whole(spark, scratch))


def test_headers_and_carriage_returns(spark, scratch, small_splits):
    path = os.path.join(scratch, "crlf.csv")
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write("\r\n".join(f'{i},"a{i}\nb",c{i}' for i in range(100)) + "\r\n")
    got = C.read_csv_split(spark, path, DDL, header=False).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(i, f"a{i}\nb", f"c{i}") for i in range(100)]
    two = os.path.join(scratch, "two.csv")
    with open(two, "w", encoding="utf-8") as f:
        f.write('\n"id","a\nname","b"\n1,x,y\n')  # a header that follows an empty line and has a line break
    assert [tuple(r) for r in C.read_csv_split(spark, two, DDL).collect()] == [(1, "x", "y")]


def test_a_quote_that_never_closes(spark, scratch, small_splits):
    path = os.path.join(scratch, "open.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write("id,a,b\n1,x,y\n2,\"open" + "\nline" * 200)
    got = {r.text for r in C.csv_records(spark, path).collect()}
    assert got == {"1,x,y", '2,"open' + "\nline" * 200}


def test_line_states():
    cases = [("a,b", False), ('a,"b', True), ('"a","b"', False), ('"a\\"', True), ('"a\\\\"', False), ('5" wide', False), ('a,5" wide,"', True),
             ('"a"b"c', False), ('"a" ,"b', True), ("", False), ('"', True), ('""', False)]
    assert [C.ends_inside(line, False) for line, _ in cases] == [x for _, x in cases]
    assert C.ends_inside("still", True) and not C.ends_inside('end"', True) and C.ends_inside('end","again', True) and C.ends_inside("", True)


def test_pairs_through_both_readers(spark, scratch, small_splits):
    path = os.path.join(scratch, "questions.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write("id,qid1,qid2,question1,question2,is_duplicate\n")
        f.writelines(f'{i},{i},{i + 1},"What is \\"{i}\\"?\nReally, what?",{["NA", "x"][i % 2]},{i % 2}.0\n' for i in range(150))
    assert rows(P.read_pairs(spark, path=path, splittable=True)) == rows(P.read_pairs(spark, path=path))
