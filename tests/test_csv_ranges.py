"""Quoted CSV cut anywhere, against the reader that takes a whole file in one task."""

import csv
import io
import random

import pytest

from ledgerloom.sources import csv_ranges, readers

COLUMNS = ["ticket", "texto", "nota"]


def written(path, rows, end="\r\n", encoding="ISO-8859-1"):
    out = io.StringIO()
    w = csv.writer(out, delimiter=";", lineterminator=end)
    w.writerow(COLUMNS)
    w.writerows(rows)
    path.write_bytes(out.getvalue().encode(encoding))
    return len(rows)


def made(rng, n):
    bits = ["", "a", "ção", '"', '""', "\n", "\r\n", ";", " ", "\n\n", "ü;\n\"x\"", "long " * 9]
    return [[str(k), "".join(rng.choice(bits) for _ in range(rng.randrange(6))), rng.choice(["", "5", "é"])] for k in range(n)]


def sorted_rows(df, columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("split", [1, 7, 64, 1000, 1 << 20])
def test_cut_anywhere(spark, tmp_path, split):
    rows = made(random.Random(split), 12 if split == 1 else 60 if split == 7 else 150)
    written(tmp_path / "a.csv", rows)
    saved = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        path = str(tmp_path / "a.csv")
        got = csv_ranges.split_csv(spark, path, COLUMNS, "sac")
        assert split > 100 or csv_ranges._lines(spark, path, "ISO-8859-1").rdd.getNumPartitions() > 1
        assert sorted_rows(got, COLUMNS) == sorted(map(tuple, rows))
        assert sorted((r._line, r.ticket) for r in got.collect()) == [(k + 1, str(k)) for k in range(len(rows))]
        one = readers.text_csv(spark, path, COLUMNS, "sac")
        plain = lambda rows: sorted(tuple(c.replace("\r\n", "\n") for c in r) for r in rows)  # noqa: E731  that reader writes all line breaks alike
        assert plain(sorted_rows(got, COLUMNS)) == plain(sorted_rows(one, COLUMNS))
        assert got.columns == one.columns
        assert csv_ranges.count_records(spark, path).first().n_records == len(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", saved[0])
        spark.conf.set("spark.sql.files.openCostInBytes", saved[1])


def test_files_are_numbered_apart_and_blank_lines_left_out(spark, tmp_path):
    written(tmp_path / "a.csv", [["1", "x\n\ny", ""], ["2", "", "z"]], "\n")
    (tmp_path / "b.csv").write_bytes(b'ticket;texto;nota\r\n\r\n9;"q";1\r\n\r\n')
    (tmp_path / "c.csv").write_bytes(b"ticket;texto;nota")
    got = csv_ranges.split_csv(spark, str(tmp_path), COLUMNS, "sac")
    assert sorted((r._line, r.ticket, r.texto, r.nota) for r in got.collect()) == [(1, "1", "x\n\ny", ""), (1, "9", "q", "1"), (2, "2", "", "z")]
    assert csv_ranges.count_records(spark, str(tmp_path)).first().n_records == 3


def test_open_quotes_and_other_headers_are_errors(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'ticket;texto;nota\n1;"open;2\n')
    with pytest.raises(ValueError, match="quotes"):
        csv_ranges.split_csv(spark, str(tmp_path / "a.csv"), COLUMNS, "sac")
    (tmp_path / "b.csv").write_bytes(b"ticket;text;nota\n1;a;2\n")
    with pytest.raises(ValueError, match="header"):
        csv_ranges.split_csv(spark, str(tmp_path / "b.csv"), COLUMNS, "sac")
